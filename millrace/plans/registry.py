"""Every query of the engine with its SQL (None where SQL cannot express it)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.plans import board_queries, corpus_queries, feature_queries, play_queries, report_queries


def registry() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    return {**board_queries.QUERIES, **feature_queries.QUERIES, **corpus_queries.QUERIES, **play_queries.QUERIES, **report_queries.QUERIES}
