"""Streaming forms of the append-only inputs: ingest, utilisation, leaderboard, sessions, parity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from levelloom.functions.scalars import is_neutral, parity_class
from levelloom.plans.ordered import Track, scan
from levelloom.session import cut, move, remove, stored
from levelloom.sources.documents import level_events, parse_levels, rejects


def ingest_levels(docs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Parse level documents as their files appear; each file is read once.

    A micro-batch holds whole maps, as rejects are decided per map. Batches write under
    their own id, so a batch that is retried replaces its own output. Few large files may make
    a batch, so its documents are dealt to all tasks before they are parsed.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        dealt = batch.repartition(F.xxhash64("map_id", "difficulty", "text"))
        parsed = parse_levels(dealt)  # stored: two sinks, one parse
        level_events(parsed).write.mode("overwrite").parquet(f"{out}/events/batch={batch_id}")
        rejects(parsed).write.mode("overwrite").parquet(f"{out}/rejects/batch={batch_id}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def utilisation(samples: DataFrame, *, width: str = "5 minutes", slide: str | None = None, late: str = "10 minutes", keys=("device",)) -> DataFrame:
    """Mean and peak utilisation per window; samples behind the watermark are dropped."""
    w = F.window("t", width, slide) if slide else F.window("t", width)
    g = samples.withWatermark("t", late).groupBy(w.alias("w"), *keys)
    g = g.agg(F.count("*").alias("n"), F.avg("util").alias("mean_util"), F.max("util").alias("peak_util"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "mean_util", "peak_util")


def live_leaderboard(log: DataFrame, at: str = "line_pos") -> DataFrame:
    """Latest row per experiment as a running aggregate; update mode writes changed experiments only."""
    row = F.struct(*[F.col(c) for c in log.columns if c != "experiment_id"])
    return log.groupBy("experiment_id").agg(F.max_by(row, F.col(at)).alias("r")).select("experiment_id", "r.*")


def heartbeat_sessions(beats: DataFrame, *, gap: str = "30 minutes", late: str = "1 hour", key: str = "run") -> DataFrame:
    """Liveness sessions of a run: beats no further apart than ``gap``."""
    g = beats.withWatermark("t", late).groupBy(key, F.session_window("t", gap).alias("s")).agg(F.count("*").alias("n"))
    return g.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


HAND = ["map_id", "difficulty", "color"]
PARITY_STATE = "map_id bigint, difficulty string, color int, last_beat double, last_cls string, idle int"
PARITY_OUT = "map_id bigint, difficulty string, color int, violations bigint, checks bigint, late bigint, batch int"


def parity_step(notes: DataFrame, state: DataFrame, max_gap: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """What the notes of one trigger add per hand, and the last swing of each of these hands.

    Notes before the last swing of their hand would reorder decided pairs; they are only
    counted. Inside the trigger neighbours come from a sliced scan, so a hand of any length
    is spread over tasks; only its last swing meets the state.
    """
    n = notes.where(~is_neutral("direction")).select(*HAND, "beat", "seq", parity_class("direction").alias("cls"))
    n = cut(n.join(state.select(*HAND, "last_beat", "last_cls"), HAND, "left"))
    old = F.coalesce(F.col("beat") < F.col("last_beat"), F.lit(False))
    d = scan(n.where(~old), Track(tuple(HAND), ("beat", "seq"), "floor(beat / 32)"), prev={"prev_beat": "beat", "prev_cls": "cls"})
    before, cls = F.coalesce("prev_beat", "last_beat"), F.coalesce("prev_cls", "last_cls")
    check = cls.isNotNull() & ~(F.col("beat") - before > max_gap)
    last = F.max_by(F.struct(F.col("beat").alias("last_beat"), F.col("cls").alias("last_cls")), F.struct("beat", "seq"))
    d = d.groupBy(*HAND).agg(F.count_if(check & (cls == F.col("cls"))).alias("violations"), F.count_if(check).alias("checks"), last.alias("last"))
    late = n.groupBy(*HAND).agg(F.count_if(old).alias("late"))
    added = cut(late.join(d, HAND, "left").na.fill(0, ["violations", "checks"]))
    return added.select(*HAND, "violations", "checks", "late"), added.where("last is not null").select(*HAND, "last.last_beat", "last.last_cls")


def running_parity(notes: DataFrame, out: str, checkpoint: str, *, max_gap: float = 3.0, idle_triggers: int = 1000) -> StreamingQuery:
    """Parity with gap reset per hand over a stream of notes; each trigger stores what it adds.

    ``out/added`` gets one row per hand and trigger (sum them up with ``parity_totals``) and
    ``out/state`` holds the last swing of every live hand: a hand without notes for
    ``idle_triggers`` triggers leaves it, and starts anew if it ever comes back. Both are stored
    under the trigger's number and the state of the trigger before is kept, so a trigger that
    is run again replaces its own output only.
    """
    spark = notes.sparkSession

    def step(batch: DataFrame, batch_id: int) -> None:
        state = stored(spark, f"{out}/state/batch={batch_id - 1}", PARITY_STATE)
        added, last = parity_step(batch, state, max_gap)
        added.write.mode("overwrite").parquet(f"{out}/added/batch={batch_id}")
        rest = state.join(last, HAND, "left_anti").withColumn("idle", F.col("idle") + 1).where(F.col("idle") < idle_triggers)
        last.withColumn("idle", F.lit(0)).unionByName(rest).write.mode("overwrite").parquet(f"{out}/state/batch={batch_id}")
        remove(spark, f"{out}/state/batch={batch_id - 2}")

    return notes.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(step).start()


def parity_totals(out: str, spark: SparkSession) -> DataFrame:
    """Totals per hand over all triggers so far."""
    added = spark.read.schema(PARITY_OUT).parquet(f"{out}/added")
    return added.groupBy(*HAND).agg(*[F.sum(c).alias(c) for c in ("violations", "checks", "late")])


def newest(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows that a reader of an update table sees: per key the one of its last trigger."""
    row = F.struct(*[F.col(c) for c in table.columns if c not in keys])
    return table.groupBy(*keys).agg(F.max_by(row, "batch").alias("r")).select(*keys, "r.*").drop("batch")


def compact(spark: SparkSession, out: str, keys: Sequence[str], upto: int) -> None:
    """Fold the triggers up to ``upto`` of an update table into that trigger: each key's newest row is left.

    The result is written beside the table first, then takes the folder's place. Run it
    between triggers, for numbers that are already stored.
    """
    found = spark.read.option("basePath", out).parquet(out).where(F.col("batch") <= upto)
    row = F.struct(*[F.col(c) for c in found.columns if c not in keys])
    folded = found.groupBy(*keys).agg(F.max_by(row, F.col("batch")).alias("r")).select(*keys, "r.*").drop("batch")
    batches = [r.batch for r in found.select("batch").distinct().collect()]  # one number per trigger since the last time
    folded.write.mode("overwrite").parquet(f"{out}.compacting")
    for b in batches:
        remove(spark, f"{out}/batch={b}")
    move(spark, f"{out}.compacting", f"{out}/batch={upto}")


def run_to_table(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all available input and return the resulting table.

    Append results go to a file sink. Complete results replace the table per trigger.
    Update results are stored per trigger; readers take the newest (``batch`` column).
    """
    spark: SparkSession = df.sparkSession
    w = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        q = w.format("parquet").option("path", out).start()
    else:
        def write(batch: DataFrame, batch_id: int) -> None:
            target = out if mode == "complete" else f"{out}/batch={batch_id}"
            batch.write.mode("overwrite").parquet(target)

        q = w.outputMode(mode).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.schema(df.schema if mode != "update" else StructType([*df.schema.fields, StructField("batch", IntegerType())])).parquet(out)
