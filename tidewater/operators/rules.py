"""Rules over fact rows: which hold, in what order, and which message a page shows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A condition over columns; one that can't be judged (null) doesn't hold."""

    name: str
    kind: str
    priority: int
    condition: Column
    page: str = ""


def evaluate(facts: DataFrame, rules: list[Rule]) -> DataFrame:
    """The facts with one row per rule that holds: rule, kind, priority, page. All rules are judged in one pass."""
    held = F.array(*(F.when(F.coalesce(r.condition, F.lit(False)), F.struct(F.lit(r.name).alias("rule"), F.lit(r.kind).alias("kind"), F.lit(r.priority).alias("priority"), F.lit(r.page).alias("page"))) for r in rules))
    return facts.select("*", F.inline(F.filter(held, lambda x: x.isNotNull())))


def best_for_page(matches: DataFrame, key: list[str], page: Column) -> DataFrame:
    """Per key, the match for this page with the highest priority, else the best without a page."""
    fits = matches.filter((F.col("page") == page) | (F.col("page") == ""))
    order = W.partitionBy(*key).orderBy((F.col("page") == "").cast("int"), F.desc("priority"), "rule")
    return fits.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").drop("_nth")
