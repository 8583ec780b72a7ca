"""From archives to training tables as one job that can be run again and again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from levelloom.operators.curation import unseen, with_manifest
from levelloom.operators.samples import preprocess
from levelloom.session import Steps, stored
from levelloom.sources.documents import dead_maps, find_member, find_members, info_levels, level_events, parse_info, parse_levels, rejects, tempo_changes

TABLES = ("onsets", "lights", "labels", "maps")
LOG_SCHEMA = "map_id string, status string, run string"


def standard_documents(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Info rows, and the level documents (map_id, difficulty, text) of the Standard characteristic."""
    info = parse_info(find_member(members, "Info.dat"))
    levels = info_levels(info, "Standard").dropDuplicates(["map_id", "difficulty"])
    return info, find_members(members, levels.select("map_id", "difficulty", "filename")).select("map_id", "difficulty", "text")


def preprocess_archives(
    members: DataFrame, frames: DataFrame, out: str, *, manifest: DataFrame | None = None, force: bool = False, **grid
) -> str | None:
    """Parse, align, encode and store the maps of ``members`` that ``out`` does not have yet.

    ``members`` has (map_id, member, pos, text), as archives give it; ``frames`` has (map_id,
    n_frames) of maps whose audio is known; ``manifest`` may add (map_id, category, genre).
    Each run stores its tables (onsets, lights, labels, maps) under its own name and then its
    log: one row per map with ``done`` or why it was refused. Readers go by the log, so a run
    that dies half-way leaves nothing visible, and is simply started again. What a run stored
    on its way is deleted at its end. With ``force``
    known maps are done again; the newest run of a map counts. Returns the run, or None if
    there was nothing new.
    """
    spark = members.sparkSession
    run = f"{_next(spark, out):06d}-{uuid.uuid4().hex[:8]}"
    known = stored(spark, f"{out}/log", LOG_SCHEMA)
    steps = Steps(spark)
    new = steps.keep("new", unseen(members.withColumn("map_id", F.col("map_id").cast("string")), known, force))
    if new.isEmpty():
        steps.drop("new")
        return None
    info, docs = standard_documents(new)
    frames = frames.select(F.col("map_id").cast("string").alias("map_id"), "n_frames")
    info = steps.keep("info", info.select("map_id", "bpm", "song_time_offset"))
    maps = steps.keep("maps", info.join(frames, "map_id"))
    parsed = steps.keep("parsed", parse_levels(docs.join(maps.select("map_id"), "map_id", "left_semi"), stored=False))
    dead = steps.keep("dead", dead_maps(parsed))
    tables = preprocess(level_events(parsed, dead), maps, tempo_changes(parsed, dead), **grid)
    sidecar = manifest.select(F.col("map_id").cast("string").alias("map_id"), "category", "genre") if manifest is not None else spark.createDataFrame([], "map_id string, category string, genre string")
    alive = steps.keep("alive", tables["onsets"].groupBy("map_id").agg(F.count_distinct("difficulty").alias("n_levels"), F.count("*").alias("n_onsets")))
    tables = {**tables, "maps": with_manifest(maps.join(alive, "map_id"), sidecar)}
    for name in TABLES:
        tables[name].write.mode("overwrite").parquet(f"{out}/{name}/run={run}")
    refused = rejects(parsed).groupBy("map_id").agg(F.max("reject").alias("why"))
    status = F.when(F.col("n_onsets").isNotNull(), "done").when(~F.col("has_info"), "no_info").when(~F.col("has_frames"), "no_audio").otherwise(F.coalesce("why", F.lit("empty")))
    log = new.select("map_id").distinct()
    log = log.join(info.select("map_id", F.lit(True).alias("has_info")), "map_id", "left").join(maps.select("map_id", F.lit(True).alias("has_frames")), "map_id", "left")
    log = log.na.fill(False, ["has_info", "has_frames"]).join(alive, "map_id", "left").join(refused, "map_id", "left")
    log.select("map_id", status.alias("status")).write.mode("overwrite").parquet(f"{out}/log/run={run}")
    steps.drop("new", "info", "maps", "parsed", "dead", "alive")
    return run


def _next(spark: SparkSession, out: str) -> int:
    last = stored(spark, f"{out}/log", LOG_SCHEMA).agg(F.max("run")).first()[0]
    return int(last.split("-")[0]) + 1 if last else 1


def map_log(spark: SparkSession, out: str) -> DataFrame:
    """The newest run of every map and how it went."""
    log = stored(spark, f"{out}/log", LOG_SCHEMA)
    return log.groupBy("map_id").agg(F.max_by(F.struct("status", "run"), "run").alias("r")).select("map_id", "r.*")


def preprocessed(spark: SparkSession, out: str, table: str) -> DataFrame:
    """A stored table: of every map the rows of its newest run that was committed."""
    rows = spark.read.parquet(f"{out}/{table}").withColumn("map_id", F.col("map_id").cast("string"))
    return rows.join(map_log(spark, out).where("status = 'done'").select("map_id", "run"), ["map_id", "run"], "left_semi").drop("run")
