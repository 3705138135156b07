"""Road-segment, point and polygon views derived from the driver tables.

The driver data has no road tables; ``segments`` gives every scale the shape of a
labelled road table (see FIXTURES.md section 3). The same definition is kept as
SQL text (``SEGMENTS_SQL``) so the DuckDB oracle reads identical inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT_COLUMNS = [
    "segment_id", "state", "Damage_Status", "Distance_to_Coast_m", "Z_Min", "Z_Max",
    "Max_Height", "Rel_Elev_Min", "Inundation_Duration_Min", "surfc_type", "x", "y",
]

SEGMENTS_SQL = """
SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR),
                 CAST(l_suppkey AS VARCHAR), CAST(CAST(l_quantity AS INT) AS VARCHAR)) AS segment_id,
  r_name AS state,
  CASE WHEN l_returnflag = 'R' THEN 'Damage' WHEN l_returnflag = 'A' OR l_linestatus = 'F' THEN 'No Damage' END AS Damage_Status,
  CAST((l_partkey * 37 + l_orderkey * 11) % 403 AS DOUBLE) AS Distance_to_Coast_m,
  CAST(round(l_discount * 100, 2) AS DOUBLE) AS Z_Min,
  CAST(round(l_discount * 100 + l_tax * 50, 2) AS DOUBLE) AS Z_Max,
  CAST(round(l_tax * 40, 2) AS DOUBLE) AS Max_Height,
  CAST(round(l_discount * 100 - l_tax * 40, 2) AS DOUBLE) AS Rel_Elev_Min,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity * 30 END AS Inundation_Duration_Min,
  CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_brand END AS surfc_type,
  CAST((l_partkey * 13 + l_linenumber * 101) % 1000 AS DOUBLE) AS x,
  CAST((l_suppkey * 29 + l_orderkey * 7) % 1000 AS DOUBLE) AS y
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey
"""


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supplier_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier -> state (region name); the dimension side of the segment join."""
    sup = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nat = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    reg = read_table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("state"))
    return (sup.join(nat, sup.s_nationkey == nat.n_nationkey)
            .join(reg, F.col("n_regionkey") == reg.r_regionkey)
            .select("s_suppkey", "state"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled road-segment view over lineitem (one row per line)."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand")
    joined = (li.join(supplier_states(spark, sf_dir), li.l_suppkey == F.col("s_suppkey"))
              .join(part, li.l_partkey == part.p_partkey))
    rf, ls = F.col("l_returnflag"), F.col("l_linestatus")
    seg_id = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
                         F.col("l_quantity").cast("int").cast("string"))
    return joined.select(
        seg_id.alias("segment_id"),
        F.col("state"),
        F.when(rf == "R", "Damage").when((rf == "A") | (ls == "F"), "No Damage").alias("Damage_Status"),
        ((F.col("l_partkey") * 37 + F.col("l_orderkey") * 11) % 403).cast("double").alias("Distance_to_Coast_m"),
        F.round(F.col("l_discount") * 100, 2).cast("double").alias("Z_Min"),
        F.round(F.col("l_discount") * 100 + F.col("l_tax") * 50, 2).cast("double").alias("Z_Max"),
        F.round(F.col("l_tax") * 40, 2).cast("double").alias("Max_Height"),
        F.round(F.col("l_discount") * 100 - F.col("l_tax") * 40, 2).cast("double").alias("Rel_Elev_Min"),
        F.when(F.col("l_linenumber") == 7, F.lit(None)).otherwise(F.col("l_quantity") * 30).cast("double").alias("Inundation_Duration_Min"),
        F.when(F.col("p_size") % 10 == 0, F.lit(None)).otherwise(F.col("p_brand")).alias("surfc_type"),
        ((F.col("l_partkey") * 13 + F.col("l_linenumber") * 101) % 1000).cast("double").alias("x"),
        ((F.col("l_suppkey") * 29 + F.col("l_orderkey") * 7) % 1000).cast("double").alias("y"),
    )


def segments_cte() -> str:
    """``WITH segments AS (...)`` prefix for oracle SQL."""
    return f"WITH segments AS ({SEGMENTS_SQL})"


# --- inundation polygons derived from the nation table ----------------------------

# FIXED VALUES of the fixture polygons: an eight-point star (offsets from the
# centre, in order around the ring); centres and sizes come from the nation key.
STAR_OFFSETS = [(0, 60), (15, 15), (60, 0), (15, -15), (0, -60), (-15, -15), (-60, 0), (-15, 15)]


def inundation_edges(spark: SparkSession, sf_dir: str, scenarios: list[float]) -> DataFrame:
    """One star polygon per nation and scenario, growing with the scenario's rise in feet.

    centre = (100 + 137k mod 800, 100 + 251k mod 800), size = (0.5 + 0.25 (k mod 4)) * (1 + ft / 4).
    Output is the edge table (scenario_ft, poly_id, ring_id, edge_id, x1, y1, x2, y2).
    """
    nat = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("poly_id"))
    tmpl = F.array(*[F.struct(F.lit(i).alias("edge_id"), F.lit(float(a[0])).alias("ox1"), F.lit(float(a[1])).alias("oy1"),
                              F.lit(float(b[0])).alias("ox2"), F.lit(float(b[1])).alias("oy2"))
                     for i, (a, b) in enumerate(zip(STAR_OFFSETS, STAR_OFFSETS[1:] + STAR_OFFSETS[:1]))])
    k = F.col("poly_id")
    d = (nat.withColumn("scenario_ft", F.explode(F.array(*[F.lit(float(s)) for s in scenarios])))
         .withColumn("_e", F.explode(tmpl))
         .withColumn("_cx", (F.lit(100) + (k * 137) % 800).cast("double"))
         .withColumn("_cy", (F.lit(100) + (k * 251) % 800).cast("double"))
         .withColumn("_r", (F.lit(0.5) + (k % 4).cast("double") * F.lit(0.25)) * (F.lit(1.0) + F.col("scenario_ft") / F.lit(4.0))))
    return d.select("scenario_ft", "poly_id", F.lit(0).alias("ring_id"), F.col("_e.edge_id").alias("edge_id"),
                    (F.col("_cx") + F.col("_e.ox1") * F.col("_r")).alias("x1"),
                    (F.col("_cy") + F.col("_e.oy1") * F.col("_r")).alias("y1"),
                    (F.col("_cx") + F.col("_e.ox2") * F.col("_r")).alias("x2"),
                    (F.col("_cy") + F.col("_e.oy2") * F.col("_r")).alias("y2"))


def inundation_edges_sql(scenarios: list[float]) -> str:
    """The same edge table as SQL (for the oracle)."""
    tmpl = ", ".join(f"({i}, {float(a[0])}, {float(a[1])}, {float(b[0])}, {float(b[1])})"
                     for i, (a, b) in enumerate(zip(STAR_OFFSETS, STAR_OFFSETS[1:] + STAR_OFFSETS[:1])))
    sc = ", ".join(f"({float(s)!r})" for s in scenarios)
    return f"""
    SELECT scenario_ft, poly_id, 0 AS ring_id, edge_id, cx + ox1 * r AS x1, cy + oy1 * r AS y1, cx + ox2 * r AS x2, cy + oy2 * r AS y2
    FROM (
      SELECT s.scenario_ft, n.n_nationkey AS poly_id, t.edge_id, t.ox1, t.oy1, t.ox2, t.oy2,
             CAST(100 + (n.n_nationkey * 137) % 800 AS DOUBLE) AS cx, CAST(100 + (n.n_nationkey * 251) % 800 AS DOUBLE) AS cy,
             (0.5 + CAST(n.n_nationkey % 4 AS DOUBLE) * 0.25) * (1.0 + s.scenario_ft / 4.0) AS r
      FROM nation n CROSS JOIN (VALUES {sc}) s(scenario_ft)
      CROSS JOIN (VALUES {tmpl}) t(edge_id, ox1, oy1, ox2, oy2)
    ) g"""
