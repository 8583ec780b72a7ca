"""Level-shaped views over the driver's tables, each with its SQL twin for the oracle.

``VIEWS`` maps a view name to (Spark builder, SQL text). The SQL is written for the
oracle engine and uses views only by name, so it can be prefixed as CTEs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from levelloom.plans.ordered import Track, position
from levelloom.session import cut

EPOCH0 = 1704067200.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _n_maps(spark, sf_dir):
    return table(spark, sf_dir, "supplier").agg(F.count("*").alias("n")).scalar()


def maps(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    bpm = (90 + k % 90).cast("double")
    return s.select(
        k.alias("map_id"), bpm.alias("bpm"), F.col("s_nationkey").alias("mapper_id"),
        F.when(k % 10 == 0, "noodle").when(k % 10 == 1, "mapping_extensions")
        .when((k % 10).isin(2, 3), "chroma").otherwise("vanilla").alias("category"),
        F.floor(F.lit(320.0) * 60.0 / bpm * 44100.0 / 512.0).cast("int").alias("n_frames"),
    )


MAPS = """SELECT s_suppkey map_id, CAST(90 + s_suppkey % 90 AS DOUBLE) bpm, s_nationkey mapper_id,
 CASE WHEN s_suppkey % 10 = 0 THEN 'noodle' WHEN s_suppkey % 10 = 1 THEN 'mapping_extensions'
  WHEN s_suppkey % 10 IN (2,3) THEN 'chroma' ELSE 'vanilla' END category,
 CAST(FLOOR(320e0 * 60e0 / CAST(90 + s_suppkey % 90 AS DOUBLE) * 44100e0 / 512e0) AS INTEGER) n_frames
FROM supplier"""


def objects(spark, sf_dir):
    return shape_objects(table(spark, sf_dir, "lineitem"))


def shape_objects(l: DataFrame) -> DataFrame:
    """Level objects from line items (batch or stream)."""
    o, p = F.col("l_orderkey"), F.col("l_partkey")
    return l.select(
        F.col("l_suppkey").alias("map_id"),
        F.when(F.col("l_linenumber") <= 5, "Expert").otherwise("Hard").alias("difficulty"),
        # in order of order key and line; the low bits only part the few rows that share both
        ((o * 8 + F.col("l_linenumber")) * 1048576 + (p * 64 + F.col("l_quantity").cast("long")) % 1048576).alias("seq"),
        (F.datediff(F.col("l_shipdate"), F.lit("1995-01-01")) / F.lit(8.0)).alias("beat"),
        F.when(p % 20 == 0, "bomb").when(p % 20 == 1, "wall").when(p % 20 == 2, "arc")
        .when(p % 20 == 3, "chain").otherwise("note").alias("kind"),
        (o % 4).cast("int").alias("x"), (F.floor(p / 4) % 3).cast("int").alias("y"),
        (F.col("l_quantity").cast("int") % 2).alias("color"), (o % 9).cast("int").alias("direction"),
        ((o % 7 - 3) * 15).cast("int").alias("angle_offset"), (F.col("l_quantity") / 8.0).alias("duration"),
    )


OBJECTS = """SELECT l_suppkey map_id, CASE WHEN l_linenumber <= 5 THEN 'Expert' ELSE 'Hard' END difficulty,
 (l_orderkey * 8 + l_linenumber) * 1048576 + (l_partkey * 64 + CAST(l_quantity AS BIGINT)) % 1048576 seq,
 DATE_DIFF('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) / CAST(8 AS DOUBLE) beat,
 CASE l_partkey % 20 WHEN 0 THEN 'bomb' WHEN 1 THEN 'wall' WHEN 2 THEN 'arc' WHEN 3 THEN 'chain' ELSE 'note' END kind,
 CAST(l_orderkey % 4 AS INTEGER) x, CAST(FLOOR(l_partkey / 4) % 3 AS INTEGER) y,
 CAST(l_quantity AS INTEGER) % 2 color, CAST(l_orderkey % 9 AS INTEGER) direction,
 CAST((l_orderkey % 7 - 3) * 15 AS INTEGER) angle_offset, l_quantity / CAST(8 AS DOUBLE) duration FROM lineitem"""


def full_events(spark, sf_dir):
    """Objects with every attribute of their kind filled in."""
    o = objects(spark, sf_dir)
    s = F.col("seq")
    return o.select(
        "*", (F.col("beat") + F.floor(F.col("duration") * 8) / 8.0).alias("tail_beat"),
        ((F.col("x") + 1) % 4).alias("tail_x"), ((F.col("y") + 1) % 3).alias("tail_y"), ((F.col("direction") + 1) % 9).alias("tail_direction"),
        ((F.col("x") + 1) * 0.5).alias("mu"), ((F.col("y") + 1) * 0.5).alias("tail_mu"), (F.col("x") % 3).alias("mid_anchor"),
        (2 + s % 31).cast("int").alias("slice_count"), ((s % 11) / 10.0).alias("squish"),
        (F.col("x") + 1).alias("width"), (F.col("y") + 1).alias("height"),
    )


FULL_SQL = """SELECT *, beat + FLOOR(duration * 8) / CAST(8 AS DOUBLE) tail_beat, (x + 1) % 4 tail_x, (y + 1) % 3 tail_y, (direction + 1) % 9 tail_direction,
 (x + 1) * 5e-1 mu, (y + 1) * 5e-1 tail_mu, x % 3 mid_anchor, CAST(2 + seq % 31 AS INTEGER) slice_count, (seq % 11) / CAST(10 AS DOUBLE) squish,
 x + 1 width, y + 1 height FROM objects"""


def notes(spark, sf_dir):
    return objects(spark, sf_dir).where("kind = 'note'").drop("kind", "duration")


NOTES_SQL = "SELECT map_id, difficulty, seq, beat, x, y, color, direction, angle_offset FROM objects WHERE kind = 'note'"


def frames(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    e = e.select(
        (F.col("user_id") % _n_maps(spark, sf_dir)).alias("map_id"), "ts", "event_id",
        (F.col("value") / 500.0).alias("rms"), ((F.col("event_id") % 101).cast("int") / 100.0).alias("onset_strength"),
        ((F.col("user_id") * 31 % 97).cast("int") / 97.0).alias("bass"),
        ((F.col("event_id") * 37 % 1000).cast("int") / 1000.0).alias("prob"),
    )
    days = "datediff(ts, date'2024-01-01')"
    e = position(e, Track(("map_id",), ("ts", "event_id"), days))
    # the series is an input table of the reference's jobs, so it is written as one
    return cut(e.select("map_id", (F.col("pos") - 1).cast("int").alias("frame"), "rms", "onset_strength", "bass", "prob"))


FRAMES_SQL = """SELECT map_id, CAST(ROW_NUMBER() OVER (PARTITION BY map_id ORDER BY ts, event_id) - 1 AS INTEGER) frame,
 value / CAST(500 AS DOUBLE) rms, CAST(event_id % 101 AS INTEGER) / CAST(100 AS DOUBLE) onset_strength,
 CAST(user_id * 31 % 97 AS INTEGER) / CAST(97 AS DOUBLE) bass, CAST(event_id * 37 % 1000 AS INTEGER) / CAST(1000 AS DOUBLE) prob
 FROM (SELECT user_id % (SELECT COUNT(*) FROM supplier) map_id, ts, event_id, value, user_id FROM events) e"""


def lights(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    sec = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6) - F.lit(EPOCH0)
    return e.select(
        (F.col("user_id") % _n_maps(spark, sf_dir)).alias("map_id"), F.col("event_id").alias("seq"),
        (F.floor(sec / 1036.8) / F.lit(8.0)).alias("beat"), (F.col("event_id") % 15).cast("int").alias("event_type"),
        (F.col("event_id") % 8).cast("int").alias("value"), (F.col("value") / 500.0).alias("float_value"),
    )


LIGHTS_SQL = """SELECT user_id % (SELECT COUNT(*) FROM supplier) map_id, event_id seq,
 FLOOR((epoch_us(ts)/CAST(1e6 AS DOUBLE) - CAST(1704067200 AS DOUBLE)) / CAST(1036.8 AS DOUBLE)) / CAST(8 AS DOUBLE) beat,
 CAST(event_id % 15 AS INTEGER) event_type, CAST(event_id % 8 AS INTEGER) "value", value / CAST(500 AS DOUBLE) float_value FROM events"""


def tempo_change(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        (k % _n_maps(spark, sf_dir)).alias("map_id"), (k * 7 % 312).cast("double").alias("at_beat"),
        (60 + k % 120).cast("double").alias("new_bpm"), k.alias("seq"),
        F.when(k % 7 < 4, "Expert").otherwise("Hard").alias("difficulty"),
    )


TEMPO_SQL = """SELECT c_custkey % (SELECT COUNT(*) FROM supplier) map_id, CAST(c_custkey * 7 % 312 AS DOUBLE) at_beat,
 CAST(60 + c_custkey % 120 AS DOUBLE) new_bpm, c_custkey seq, CASE WHEN c_custkey % 7 < 4 THEN 'Expert' ELSE 'Hard' END difficulty FROM customer"""


def catalogue(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("map_id"), F.col("o_custkey").alias("mapper_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("uploaded"),
        ((F.col("o_orderkey") % 1000) / 1000.0).alias("score"),
        F.when(F.col("o_orderstatus") == "P", "Assisted").otherwise("None").alias("declared_ai"),
        (F.col("o_orderkey") % 23 == 0).alias("automapper"),
    )


CATALOGUE_SQL = """SELECT o_orderkey map_id, o_custkey mapper_id, strftime(o_orderdate, '%Y-%m-%d') uploaded,
 (o_orderkey % 1000) / CAST(1000 AS DOUBLE) score, CASE o_orderstatus WHEN 'P' THEN 'Assisted' ELSE 'None' END declared_ai,
 o_orderkey % 23 = 0 automapper FROM orders"""


def catalogue_diff(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    return l.select(
        F.col("l_orderkey").alias("map_id"),
        F.when(F.col("l_returnflag") == "R", "Lawless").otherwise("Standard").alias("characteristic"),
        F.when(n >= 5, "ExpertPlus").when(n >= 3, "Expert").otherwise("Hard").alias("difficulty"),
        (F.col("l_quantity") / 2.0).alias("nps"), (F.col("l_partkey") % 50 == 0).alias("ne"),
        (F.col("l_partkey") % 40 == 0).alias("me"), (F.col("l_partkey") % 15 == 0).alias("chroma"),
        n.alias("pos"), F.col("l_partkey").alias("part"),
    )


CATALOGUE_DIFF_SQL = """SELECT l_orderkey map_id, CASE l_returnflag WHEN 'R' THEN 'Lawless' ELSE 'Standard' END characteristic,
 CASE WHEN l_linenumber >= 5 THEN 'ExpertPlus' WHEN l_linenumber >= 3 THEN 'Expert' ELSE 'Hard' END difficulty,
 l_quantity / CAST(2 AS DOUBLE) nps, l_partkey % 50 = 0 ne, l_partkey % 40 = 0 me, l_partkey % 15 = 0 chroma,
 l_linenumber pos, l_partkey part FROM lineitem"""


def bucket_member(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    a = n.select(F.col("n_regionkey").alias("bucket_id"), F.col("n_nationkey").alias("mapper_id"))
    b = n.where("n_nationkey % 3 = 0").select(((F.col("n_regionkey") + 1) % 5).alias("bucket_id"), F.col("n_nationkey").alias("mapper_id"))
    return a.unionByName(b)


BUCKET_SQL = """SELECT n_regionkey bucket_id, n_nationkey mapper_id FROM nation
 UNION ALL SELECT (n_regionkey + 1) % 5 bucket_id, n_nationkey mapper_id FROM nation WHERE n_nationkey % 3 = 0"""


def experiment_log(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    c = F.col("o_custkey").cast("string")
    return o.select(
        F.col("o_orderkey").alias("line_pos"), F.concat(F.lit("exp"), c).alias("experiment_id"),
        F.concat(F.lit("cohort:"), (F.col("o_custkey") % 25).cast("string")).alias("data_source"),
        (F.col("o_totalprice") % 1000 / 1000.0).alias("composite_score"),
        (F.col("o_orderkey") % 97 / 97.0).alias("parity_rate"), F.col("o_orderdate").alias("logged_at"),
    )


EXPERIMENT_SQL = """SELECT o_orderkey line_pos, 'exp' || CAST(o_custkey AS VARCHAR) experiment_id,
 'cohort:' || CAST(o_custkey % 25 AS VARCHAR) data_source, o_totalprice % 1000 / CAST(1000 AS DOUBLE) composite_score,
 o_orderkey % 97 / CAST(97 AS DOUBLE) parity_rate, o_orderdate logged_at FROM orders"""


def token_pred(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return l.select(
        (F.col("l_partkey") % 11).cast("int").alias("pred"), (F.col("l_orderkey") % 11).cast("int").alias("target"),
        F.col("l_suppkey").alias("map_id"),
    )


TOKEN_PRED_SQL = """SELECT CAST(l_partkey % 11 AS INTEGER) pred, CAST(l_orderkey % 11 AS INTEGER) target, l_suppkey map_id FROM lineitem"""


VIEWS = {
    "maps": (maps, MAPS), "objects": (objects, OBJECTS), "notes": (notes, NOTES_SQL), "full_events": (full_events, FULL_SQL),
    "frames": (frames, FRAMES_SQL), "lights": (lights, LIGHTS_SQL), "tempo_change": (tempo_change, TEMPO_SQL),
    "catalogue": (catalogue, CATALOGUE_SQL), "catalogue_diff": (catalogue_diff, CATALOGUE_DIFF_SQL),
    "bucket_member": (bucket_member, BUCKET_SQL), "experiment_log": (experiment_log, EXPERIMENT_SQL),
    "token_pred": (token_pred, TOKEN_PRED_SQL),
}


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the views it names (and those they name) as CTEs.

    Names that begin with z are stages of a chain, each read several times: they are kept.
    """
    known = {k: v[1] for k, v in VIEWS.items()} | (extra or {})
    order: list[str] = []

    seen: set[str] = set()

    def need(text: str) -> None:
        for name in known:
            if name not in seen and re.search(rf"\b{name}\b", text):
                seen.add(name)
                need(known[name])
                order.append(name)

    need(sql)
    if not order:
        return sql
    ctes = ", ".join(f"{n} AS {'MATERIALIZED ' if n[0] == 'z' else ''}({known[n]})" for n in order)
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    body = f", {sql[own.end():]}" if own else f" {sql}"
    return f"WITH RECURSIVE {ctes}{body}"
