"""Storm views over the shipped tables, in Spark and as DuckDB text.

The tables hold no fields or tracks; these derive them by the same arithmetic in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

#: Rows and columns of the field view.
SHAPE = (32, 32)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track observations from ``events``: a user is a track, its events in time order are its steps."""
    k = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", k.cast("int").alias("k"))
    return rows.select(*[F.expr(e) for e in _OBS])


_OBS = (
    "user_id as tid", "k", "event_id as id", "event_type", "45290 + (user_id % 12)*30.5e0 + 0.25e0*k as time",
    "25 + (user_id*7) % 35 + 0.2e0*k + 0.05e0*(event_id % 4) as lat", "((user_id*106 + k) % 720)/2.0e0 - 180 as lon",
    "case when event_id % 11 <> 0 then 101000 - value*60 end as p_cent", "case when event_id % 11 <> 0 then 101000 - value*60 + 200*(1 + event_id % 5) end as p_edge",
    "case when event_id % 11 <> 0 then value/100 end as dsqp", "case when event_id % 11 = 0 then 0 else 1 + event_id % 17 end as area",
    "case when event_id % 11 = 0 then 0 when event_id % 5 = 0 then 2 else 1 end as centers", "case when event_id % 11 = 0 then 0 when event_id % 7 = 0 then 2 else 1 end as type",
    "cast(floor((25 + (user_id*7) % 35 + 0.2e0*k + 0.05e0*(event_id % 4) - 20)/2.0e0) as int) as y", "cast(floor((((user_id*106 + k) % 720)/2.0e0)/10.0e0) as int) as x",
)

#: Rows and columns of the cells of ``obs``.
CELLS = (40, 36)

OBS_SQL = "obs AS (SELECT " + ", ".join(_OBS) + " FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS k FROM events))"


def track_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Life-cycle events from the same rows: signup ge, error ly, click sp, purchase mg; others none."""
    rows = obs(spark, sf_dir)
    # the number of tracks is one number of the plan
    n = read(spark, sf_dir, "events").agg(F.countDistinct("user_id").alias("tracks"))
    kind = F.create_map(*[F.lit(x) for x in ("signup", "ge", "error", "ly", "click", "sp", "purchase", "mg")])
    named = rows.withColumn("event", F.try_element_at(kind, F.col("event_type"))).where(F.col("event").isNotNull())
    return named.join(F.broadcast(n)).select("tid", "time", "id", "event", (1 + F.col("id") % 3).cast("int").alias("etype"), F.pmod(F.col("tid") + 1 + F.col("k"), F.col("tracks")).alias("otid"), "x", "y")


EVENTS_SQL = OBS_SQL + """, ev AS (SELECT * FROM (SELECT tid, time, id, CASE event_type WHEN 'signup' THEN 'ge' WHEN 'error' THEN 'ly' WHEN 'click' THEN 'sp' WHEN 'purchase' THEN 'mg' END AS event,
  CAST(1 + id % 3 AS INTEGER) AS etype, (tid + 1 + k) % (SELECT count(DISTINCT user_id) FROM events) AS otid, x, y FROM obs) WHERE event IS NOT NULL)"""


def field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 32 x 32 field for each 16 vectors of ``embeddings``: every vector is an 8 x 8 tile; the last step is partial."""
    cells = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    return cells.select(F.expr("vec_id div 16 as t"), F.expr("cast(((vec_id % 16) div 4)*8 + i div 8 as int) as y"), F.expr("cast((vec_id % 16 % 4)*8 + i % 8 as int) as x"), F.col("e").cast("double").alias("v"))


FIELD_SQL = """field AS (SELECT vec_id // 16 AS t, CAST(((vec_id % 16) // 4)*8 + i // 8 AS INTEGER) AS y, CAST((vec_id % 16 % 4)*8 + i % 8 AS INTEGER) AS x, v
  FROM (SELECT vec_id, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings))"""


def season_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region, year, month, value from orders, customers and nations."""
    orders, customer, nation = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).join(F.broadcast(nation), customer["c_nationkey"] == nation["n_nationkey"])
    return joined.select(F.col("n_regionkey").alias("region"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), F.col("o_totalprice").alias("value"), F.col("c_acctbal").alias("bal"))


SEASON_SQL = """sy AS (SELECT n_regionkey AS region, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, o_totalprice AS value, c_acctbal AS bal
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
