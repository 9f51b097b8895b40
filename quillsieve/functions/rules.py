"""Rules as data, compiled into one pass over a table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sql import duck_sql, spark_sql


@dataclass(frozen=True)
class Rule:
    """An issue `rule_id` of a severity where the predicate holds; a null predicate raises none. `area` groups rules, `oracle`
    restates the predicate for an engine without look-arounds."""

    rule_id: str
    severity: int
    predicate: str
    area: str = "format"
    oracle: str | None = None


def apply_rules(df: DataFrame, rules: list[Rule], keys: list[str], areas: tuple[str, ...] | None = None) -> DataFrame:
    """(keys, rule_id, severity) of all rules in one scan and one explode; rules of other areas are not compiled at all."""
    used = [r for r in rules if areas is None or r.area in areas]
    hits = [F.when(F.expr(spark_sql(r.predicate)), F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(min(5, max(1, r.severity))).alias("severity"))) for r in used]
    if not hits:
        return df.select(*keys, F.lit("").alias("rule_id"), F.lit(0).alias("severity")).where("false")
    return df.select(*keys, F.inline(F.filter(F.array(*hits), lambda x: x.isNotNull())))


def rules_sql(source: str, rules: list[Rule], keys: list[str], areas: tuple[str, ...] | None = None) -> str:
    """The same as a union of filters."""
    used = [r for r in rules if areas is None or r.area in areas]
    return " union all ".join(f"select {', '.join(keys)}, '{r.rule_id}' rule_id, {min(5, max(1, r.severity))} severity from {source} where {duck_sql(r.oracle or r.predicate)}" for r in used)
