"""The driver's tables as cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histomill.model import Cohort
from histomill.operators.samples import Samples

SECTION_PIXELS = 50
FEATURES = tuple(f"m{i:03d}" for i in range(64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixel_cohort(spark: SparkSession, sf_dir: str) -> Cohort:
    """``embeddings``: sections of 50 pixels on a 10 x 5 grid, 64 positive features; the label is
    the cluster, the lower half of the sections the responders."""
    e = table(spark, sf_dir, "embeddings")
    half = e.agg(((F.max(F.expr("vec_id div 50")) + 1) / 2).alias("half"))
    section, place = F.expr("vec_id div 50"), F.col("vec_id") % SECTION_PIXELS
    pixels = e.crossJoin(F.broadcast(half)).select(  # one row
        section.cast("string").alias("section"),
        F.col("vec_id").alias("pixel_id"),
        (place % 10).cast("double").alias("x"),
        F.expr("(vec_id % 50) div 10").cast("double").alias("y"),
        F.col("label").cast("string").alias("cluster"),
        F.when(section < F.col("half"), "R").otherwise("NR").alias("response"),
        F.concat(F.lit("p"), (section % 5).cast("string")).alias("patient"),
        (F.col("label") < 8).alias("is_tissue"),
        (F.col("label") >= 8).alias("is_background"),
        F.transform("embedding", lambda v: v.cast("double") + 1).alias("values"),
    )
    return Cohort(pixels, FEATURES)


#: ``px`` (a row a pixel) and ``lg`` (a row a pixel and feature) in SQL.
PIXELS_SQL = """
e0 AS (SELECT vec_id, label, embedding FROM embeddings),
px AS (
  SELECT CAST(vec_id // 50 AS VARCHAR) AS section, vec_id AS pixel_id, CAST((vec_id % 50) % 10 AS DOUBLE) AS x,
         CAST((vec_id % 50) // 10 AS DOUBLE) AS y, CAST(label AS VARCHAR) AS cluster,
         CASE WHEN vec_id // 50 < (SELECT (max(vec_id // 50) + 1) / 2e0 FROM embeddings) THEN 'R' ELSE 'NR' END AS response,
         'p' || CAST((vec_id // 50) % 5 AS VARCHAR) AS patient, label < 8 AS is_tissue, label >= 8 AS is_background
  FROM e0),
fv AS (SELECT vec_id AS pixel_id, unnest(range(64)) AS i, unnest(embedding) AS v FROM e0),
lg AS (
  SELECT px.*, CAST(fv.i AS INTEGER) AS feature_idx, 'm' || lpad(CAST(fv.i AS VARCHAR), 3, '0') AS metabolite, CAST(fv.v AS DOUBLE) + 1e0 AS value
  FROM px JOIN fv USING (pixel_id))"""


def event_samples(spark: SparkSession, sf_dir: str, by_time: bool = False) -> Samples:
    """``events``: users are samples, event types features, their mean value the profile; even and
    odd users are the groups. With ``by_time`` a sample is a user in the first or second half of
    the time covered, and its values are added up in the order of ``event_id`` (a sample's events of
    a type are held at once): the last bits of a mean decide which changes are ties, and so the
    signed ranks, whatever the partitions."""
    e = table(spark, sf_dir, "events").where("value IS NOT NULL")
    sample = F.col("user_id").cast("string")
    if by_time:
        span = e.agg(((F.unix_micros(F.min("ts").cast("timestamp")) + F.unix_micros(F.max("ts").cast("timestamp"))) / 2).alias("mid"))
        e = e.crossJoin(F.broadcast(span)).withColumn("time", F.when(F.unix_micros(F.col("ts").cast("timestamp")) < F.col("mid"), "t0").otherwise("t1"))  # one row
        sample = F.concat_ws("/", sample, "time")
    else:
        e = e.withColumn("time", F.lit("t0"))
    e = e.withColumn("sample", sample)
    in_order = F.array_sort(F.collect_list(F.struct("event_id", F.col("value").cast("double").alias("value"))))
    mean = F.aggregate(in_order, F.lit(0.0), lambda s, v: s + v["value"]) / F.count("value") if by_time else F.avg("value")
    values = e.groupBy("sample", F.col("event_type").alias("metabolite")).agg(mean.alias("value"))
    samples = e.groupBy("sample").agg(F.count(F.lit(1)).alias("n_pixels"), F.any_value("user_id").alias("user"), F.any_value("time").alias("time"))
    samples = samples.withColumn("grp", F.when(F.col("user") % 2 == 0, "even").otherwise("odd"))
    return Samples(values.select("sample", F.lit("abundance").alias("metric"), "metabolite", "value"), samples)


#: ``ev``: profiles of users in SQL.
EVENTS_SQL = """
ev AS (
  SELECT user_id, event_type AS metabolite, avg(value) AS value, CASE WHEN user_id % 2 = 0 THEN 1 ELSE 2 END AS grp
  FROM events WHERE value IS NOT NULL GROUP BY user_id, event_type)"""


def scattered_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``supplier`` accounts as points without a lattice: ``section, id, x, y``."""
    s = table(spark, sf_dir, "supplier")
    return s.select(F.lit("s").alias("section"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").cast("double").alias("x"), (F.col("s_suppkey") * 7919 % 9973).cast("double").alias("y"))
