"""The alert view of the events table, which most queries read, and its scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import attack_classifier


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ts, user_id, rule_id, level, description, groups, techniques, data, full_log, score, is_attack of each event."""
    e = table(spark, sf_dir, "events")
    level = F.least(F.lit(15), F.floor(F.col("value") / 30).cast("int"))
    view = e.select(
        F.col("event_id").alias("id"),
        "ts",
        "user_id",
        F.col("event_type").alias("rule_id"),
        level.alias("level"),
        F.concat("event_type", F.lit(" event")).alias("description"),
        F.array("event_type", F.when(level >= 12, "severe").otherwise("routine")).alias("groups"),
        F.array().cast("array<string>").alias("techniques"),
        F.from_json("props", "map<string,string>").alias("data"),
        F.concat_ws(" ", "event_type", F.col("value").cast("string"), "props").alias("full_log"),
        F.least(F.lit(100), F.floor(F.col("value") / 5).cast("int")).alias("score"),
        "value",
    )
    return view.withColumn("is_attack", attack_classifier(F.col("rule_id"), F.col("level"), F.col("description"), F.col("groups"), F.col("techniques")))


#: The same view in SQL, for the oracles.
ALERTS_SQL = """alerts AS (
  SELECT event_id AS id, ts, user_id, event_type AS rule_id, least(15, floor(value / 30))::INT AS level, event_type || ' event' AS description,
    [event_type, CASE WHEN floor(value / 30) >= 12 THEN 'severe' ELSE 'routine' END] AS groups, least(100, floor(value / 5))::INT AS score, value, props,
    floor(value / 30) >= 8 OR event_type = 'error' AS is_attack
  FROM events
)"""
