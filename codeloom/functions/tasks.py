"""Keywords of task texts, as a column and for one string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no keywords, and signs that separate words.
STOP_WORDS = [
    "a", "an", "the", "and", "or", "but", "if", "then", "else", "when", "at", "by", "for", "with", "about", "against",
    "between", "into", "through", "during", "before", "after", "above", "below", "to", "from", "up", "down", "in", "out",
    "on", "off", "over", "under", "again", "further", "once", "here", "there", "all", "any", "both", "each", "few", "more",
    "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "can", "will",
    "just", "should", "now", "fix", "update", "implement", "add", "make", "create", "modify", "bug", "issue",
]
SEPARATORS = "/\\:;,.()[]{}\"'`"


def keywords(task: Column) -> Column:
    """Sorted distinct terms: words of two bytes or more that say something, compounds whole and in parts.

    Null gives null; a text without terms an empty array.
    """
    words = F.split(F.trim(F.regexp_replace(F.translate(task, SEPARATORS, " " * len(SEPARATORS)), r"(?U)\s+", " ")), " ")
    parts = F.flatten(
        F.transform(
            words,
            lambda w: F.when(w.rlike("[-_]"), F.concat(F.array(w), F.split(w, "[-_]"))).otherwise(F.array(w)),
        )
    )
    low = F.transform(parts, F.lower)
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.array_sort(F.array_distinct(F.filter(low, lambda w: (F.octet_length(w) >= 2) & ~F.array_contains(stop, w))))


def keywords_of(task: str) -> list[str]:
    for s in SEPARATORS:
        task = task.replace(s, " ")
    found = set()
    for word in task.split():
        forms = [word, *word.replace("_", "-").split("-")] if "-" in word or "_" in word else [word]
        found |= {w.lower() for w in forms if len(w.lower().encode()) >= 2 and w.lower() not in STOP_WORDS}
    return sorted(found)
