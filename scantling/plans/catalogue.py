"""All reference-side queries by name, and the SQL that states each of them."""

from __future__ import annotations

from . import aims, base, mixed, ranking, reports, resampling, runs, scoring, search  # noqa: F401  the modules register their queries

FLAGSHIP = "auc_ties"


def queries():
    return dict(base.QUERIES)


def oracle_sql():
    return dict(base.SQL)
