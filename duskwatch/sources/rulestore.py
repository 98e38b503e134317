"""Rule and settings documents in files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.rules import active_rules
from ..schema import RULE_DDL


def load_rules(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Rule documents (JSON lines). With ``kind`` (``cep`` or ``ueba``) only those switched on for it."""
    rules = spark.read.schema(RULE_DDL).json(path)
    return rules if kind is None else active_rules(rules, kind)
