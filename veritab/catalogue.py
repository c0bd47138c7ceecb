"""Registered queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import banks, companies, discovery, pages, runs, texts, verdicts, websites

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = pages.QUERIES | texts.QUERIES | companies.QUERIES | discovery.QUERIES | runs.QUERIES | verdicts.QUERIES | banks.QUERIES | websites.QUERIES
SQL: dict[str, str] = pages.SQL | texts.SQL | companies.SQL | discovery.SQL | runs.SQL | verdicts.SQL | banks.SQL | websites.SQL
