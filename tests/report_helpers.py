from __future__ import annotations

from srcatlas.operators.reports import REPORT_ORDER


def report_text(rows, repo):
    """One small document as a string."""
    picked = rows.where(rows.repo == repo).orderBy(*REPORT_ORDER).select("text")
    return "\n".join(r.text for r in picked.collect())
