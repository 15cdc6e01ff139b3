"""Queries on references whose symbols do not exist."""

from __future__ import annotations

from codeloom.operators import orphans
from codeloom.plans.registry import Registry, table

R = Registry()

_SIDES = """
  sides AS (
    SELECT ref_id, 'source' AS side, repo_id, source_symbol_id AS id, recorded_at FROM symbol_references
    UNION ALL
    SELECT ref_id, 'target' AS side, repo_id, target_symbol_id AS id, recorded_at FROM symbol_references),
  judged AS (
    SELECT s.ref_id, s.side, s.recorded_at, NOT EXISTS (
      SELECT 1 FROM symbols p WHERE p.repo_id = s.repo_id AND p.id = s.id AND p.indexed_at <= s.recorded_at
        AND (p.deleted_at IS NULL OR p.deleted_at > s.recorded_at)) AS orphan
    FROM sides s WHERE s.id IS NOT NULL AND regexp_matches(s.id, '\\S'))
"""


def _tracked(spark, folder, snapshot):
    return orphans.replay(spark, table(spark, folder, "symbol_references"), table(spark, folder, "symbols"), snapshot=snapshot)


@R.query("p1_found", f"WITH {_SIDES} SELECT DISTINCT ref_id, side FROM judged WHERE orphan")
def p1_found(spark, folder):
    """Distinct (ref_id, side) of references to symbols that do not live at the time."""
    return _tracked(spark, folder, False).orphans()


@R.query(
    "p1_orphan_counts",
    f"""WITH {_SIDES}, once AS (
      SELECT ref_id, side, strftime(recorded_at AT TIME ZONE 'UTC', '%Y-%m') AS month, bool_or(orphan) AS orphan
      FROM judged GROUP BY ALL)
    SELECT 'symbol_references' AS table_name, side, month, count(*) AS n_refs, count(*) FILTER (orphan) AS n_orphans
    FROM once GROUP BY side, month""",
)
def p1_orphan_counts(spark, folder):
    """Orphans per table, side and month of recorded_at: the last snapshot of the tracker."""
    return _tracked(spark, folder, True).snapshot().drop("batch")
