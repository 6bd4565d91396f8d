"""Utterance tables from the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Meetings templated from `events`; the same text runs on Spark and DuckDB.
UTTERANCES_SQL = """
SELECT concat('m-', meeting_date, '-', CAST(team AS STRING)) AS meeting_id, meeting_date,
  concat('Project ', project, ' Sync') AS title, speaker,
  CAST(row_number() OVER (PARTITION BY meeting_date, team ORDER BY ts, event_id) - 1 AS INT) AS utterance_index,
  CASE event_type
    WHEN 'purchase' THEN concat('We decided to build Project ', project, ' on ', CASE k % 3 WHEN 0 THEN 'postgres' WHEN 1 THEN 'kafka' ELSE 'redis' END, '.')
    WHEN 'signup' THEN concat('I will set up artifact ', CAST(k AS STRING), ' for Project ', project, ' by Friday.')
    WHEN 'error' THEN concat('There is a risk that dependency ', CAST(k AS STRING), ' might delay Project ', project, '.')
    WHEN 'click' THEN CASE WHEN k < 4 THEN concat('Should we expand Project ', project, ' pilot ', CAST(k AS STRING), '?')
      ELSE concat('We are assuming budget ', CAST(k AS STRING), ' holds for Project ', project, '.') END
    ELSE CASE WHEN k < 4 THEN concat('Item ', CAST(k AS STRING), ' is still open and pending for Project ', project, '.')
      ELSE concat('Customer Acme', CAST(k AS STRING), ' drives ', CAST(k*10 AS STRING), '% of usage.') END
  END AS text
FROM (SELECT event_id, ts, event_type, CAST(user_id % 5 AS INT) AS team, CAST(event_id % 7 AS INT) AS k,
    substr(CAST(ts AS STRING), 1, 10) AS meeting_date, concat('Person', CAST(user_id % 16 AS STRING)) AS speaker,
    CASE CAST(user_id % 5 AS INT) WHEN 0 THEN 'Atlas' WHEN 1 THEN 'Borealis' WHEN 2 THEN 'Cobalt' WHEN 3 THEN 'Dynamo' ELSE 'Everest' END AS project
  FROM {events}) e
"""


def event_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dealt by meeting, so that what follows (extraction, windows in a meeting) runs in all tasks and without a shuffle."""
    return read_events(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "meeting_id")


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As they lie in the file, for what needs no meeting in one task, such as sums that begin before a shuffle."""
    return spark.sql(UTTERANCES_SQL, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def conversation_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.select(F.col("conv_id").cast("string").alias("meeting_id"), F.lit(None).cast("string").alias("meeting_date"), F.lit(None).cast("string").alias("title"), F.col("role").alias("speaker"), F.col("turn").cast("int").alias("utterance_index"), "text")
