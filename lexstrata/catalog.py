"""All registered queries of the engine's own operators, with SQL for each that SQL can express."""

from __future__ import annotations

from .plans import answering, contexts, corpus, generation, models, text_search  # noqa: F401 - they register their queries
from .plans.registered import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
