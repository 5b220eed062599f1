"""Corpus and decision reports: ranked counts, flatness, adjudication and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLAG_BELOW, RULE_SURE, REFEREE_MIN = 0.60, 0.75, 0.60


def ranked(rows: DataFrame, key: str, where: Column | None = None) -> DataFrame:
    """key, n ordered by count descending, then key."""
    rows = rows if where is None else rows.where(where)
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key)


def flatness(outcomes: DataFrame) -> DataFrame:
    return outcomes.where("ok").groupBy("genre").agg(F.count("*").alias("total"), F.count_if("flat").alias("flat")).orderBy(F.desc("flat"), "genre")


def adjudicate(decisions: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Adds flagged, consulted, abstained, overridden, agreed and final to (kind, doc, rule_verdict, rule_confidence, key).

    Answers (key, verdict, confidence) are joined on the cache key; a missing one is an
    abstention. Without answers nothing is consulted and every rule stands.
    """
    rows = decisions.withColumn("flagged", F.col("rule_confidence") < FLAG_BELOW)
    if answers is None:
        rows = rows.withColumn("verdict", F.lit(None).cast("string")).withColumn("confidence", F.lit(None).cast("double")).withColumn("consulted", F.lit(False))
    else:
        rows = rows.join(answers.select("key", "verdict", "confidence"), "key", "left").withColumn("consulted", F.col("flagged"))
    rows = rows.withColumn("abstained", F.col("consulted") & F.col("verdict").isNull())
    sure = F.col("consulted") & (F.col("rule_confidence") < RULE_SURE) & (F.coalesce("confidence", F.lit(0.0)) >= REFEREE_MIN) & F.col("verdict").isNotNull()
    rows = rows.withColumn("overridden", sure & (F.col("verdict") != F.col("rule_verdict")))
    rows = rows.withColumn("agreed", F.col("consulted") & F.coalesce(F.col("verdict") == F.col("rule_verdict"), F.lit(False)))
    return rows.withColumn("final", F.when(F.col("overridden"), F.col("verdict")).otherwise(F.col("rule_verdict")))


def summary(adjudicated: DataFrame) -> DataFrame:
    """One row: the counts of a decision log and their percentages."""
    counts = adjudicated.agg(
        F.count("*").alias("total"), F.count_if(~F.col("flagged")).alias("rule_only"), F.count_if("flagged").alias("flagged"), F.count_if("consulted").alias("consulted"),
        F.count_if("agreed").alias("agreed"), F.count_if("overridden").alias("overrode"),
        F.count_if(F.col("consulted") & ~F.col("abstained") & ~F.col("overridden") & ~F.col("agreed")).alias("overruled"), F.count_if("abstained").alias("abstained"),
    )

    def share(part, whole):
        return F.coalesce(F.round(100.0 * F.col(part) / F.nullif(F.col(whole), F.lit(0)), 1), F.lit(0.0)).alias(f"{part}_pct")

    return counts.select("*", share("flagged", "total"), share("rule_only", "total"), share("agreed", "consulted"), share("overrode", "consulted"))


def reconciled(counts: DataFrame) -> DataFrame:
    """The summary with ``balanced``: whether its identities hold."""
    return counts.withColumn(
        "balanced",
        (F.col("rule_only") + F.col("flagged") == F.col("total")) & (F.col("agreed") + F.col("overrode") + F.col("overruled") + F.col("abstained") == F.col("consulted")) & (F.col("consulted") <= F.col("flagged")),
    )
