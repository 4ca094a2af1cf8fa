"""The registered queries opN_<name> over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules that hold one query each: NAME, query(spark, sf_dir) and, where SQL can express it, SQL.
MODULES = ["op1_fixity", "op2_jaccard", "op3_tokens", "op4_chat", "op5_decontaminate", "op6_search", "op7_packing", "op8_toxicity", "op9_quality", "op10_license"]


def _modules() -> list:
    return [importlib.import_module(f"{__package__}.{m}") for m in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {m.NAME: m.query for m in _modules()}


def oracle_sql() -> dict[str, str]:
    return {m.NAME: m.SQL for m in _modules() if m.SQL}
