"""Readers: worktrees, Git, claim logs, configuration."""
