"""Name -> (Spark query, SQL twin). The twin may use any view of ``sql_views``."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cardweir.plans.sql_views import VIEWS
from cardweir.session import use_utc

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def wrap(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(use_utc(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return wrap


def with_views(body: str) -> str:
    """Prefix ``body`` with the views it names, and the views those name, as CTEs."""
    wanted: set[str] = set()

    def visit(text: str) -> None:
        for view in VIEWS:
            if view not in wanted and re.search(rf"\b{view}\b", text):
                wanted.add(view)
                visit(VIEWS[view])

    visit(body)
    ctes = [f"{view} AS MATERIALIZED ({VIEWS[view]})" for view in VIEWS if view in wanted]
    text = body.strip()
    if not ctes:
        return text
    match = re.match(r"WITH\s+(RECURSIVE\s+)?", text)
    if match:
        keyword = "WITH RECURSIVE " if match.group(1) else "WITH "
        return keyword + ",\n".join(ctes) + ",\n" + text[match.end():]
    return "WITH " + ",\n".join(ctes) + "\n" + text
