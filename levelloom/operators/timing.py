"""Beat and frame alignment, with and without tempo changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from levelloom.constants import HOP_LENGTH, SAMPLE_RATE
from levelloom.functions.scalars import seconds_to_frame
from levelloom.plans.ordered import asof
from levelloom.session import cut


#: changes belong to one difficulty's document
LEVEL = ("map_id", "difficulty")


def tempo_segments(changes: DataFrame, maps: DataFrame) -> DataFrame:
    """Each change of a level with the seconds elapsed before it; several on one beat apply in order.

    Only the last change of a beat matters afterwards: zero-length segments add nothing.
    Seconds are added change by change, as a player does: sums of slices differ from that in
    their last bits, and events between two frames then fall to the other one. The window
    streams over one row per beat with a change and spills, so a level's changes need not fit.
    """
    c = changes.groupBy(*LEVEL, "at_beat").agg(F.max_by("new_bpm", "seq").alias("new_bpm"))
    c = c.join(maps.select("map_id", "bpm"), "map_id")
    along = W.partitionBy(*LEVEL).orderBy("at_beat")
    took = (F.col("at_beat") - F.coalesce(F.lag("at_beat").over(along), F.lit(0.0))) * 60.0 / F.coalesce(F.lag("new_bpm").over(along), F.col("bpm"))
    seconds = F.sum("took").over(along.rowsBetween(W.unboundedPreceding, 0))
    return c.withColumn("took", took).select(*LEVEL, "at_beat", "new_bpm", seconds.alias("seconds"))


def beat_frames(events: DataFrame, maps: DataFrame, changes: DataFrame | None = None, *, sample_rate=SAMPLE_RATE, hop=HOP_LENGTH) -> DataFrame:
    """Add ``seconds`` and ``frame`` to events; a change takes effect strictly after its beat.

    Levels without a change keep the base tempo, so only the others are searched for segments.
    """
    if changes is not None:
        changing = cut(changes.select(*LEVEL).distinct())
        grid = {"sample_rate": sample_rate, "hop": hop}
        if changing.isEmpty():
            return beat_frames(events, maps, **grid)
        still = beat_frames(events.join(changing, list(LEVEL), "left_anti"), maps, **grid)
        return still.unionByName(_frames(events.join(changing, list(LEVEL), "left_semi"), maps, changes, sample_rate, hop))
    return _frames(events, maps, None, sample_rate, hop)


def _frames(events: DataFrame, maps: DataFrame, changes: DataFrame | None, sample_rate, hop) -> DataFrame:
    cols = ["map_id", "bpm", *([c for c in ("song_time_offset",) if c in maps.columns])]
    m = maps.select(*cols)
    offset = F.coalesce("song_time_offset", F.lit(0.0)) if len(cols) == 3 else F.lit(0.0)
    e = events
    if changes is None:
        e = e.join(m, "map_id").withColumn("seconds", F.col("beat") * 60.0 / F.col("bpm") + offset)
    else:
        seg = tempo_segments(changes, maps).withColumnRenamed("at_beat", "beat")
        # the distinct beats of a level carry the search; events then join back by key
        beats = e.select(*LEVEL, "beat").distinct()
        hit = asof(beats, seg, LEVEL, "beat", ["new_bpm", "seconds"], slice="floor(beat / 64)", strict=True).join(m, "map_id")
        sec = (
            F.coalesce("seconds", F.lit(0.0))
            + (F.col("beat") - F.coalesce("match_beat", F.lit(0.0))) * 60.0 / F.coalesce("new_bpm", F.col("bpm")) + offset
        )
        e = e.join(hit.select(*LEVEL, "beat", sec.alias("seconds")), [*LEVEL, "beat"])
    drop = [c for c in cols[1:] if c in e.columns and c not in events.columns]
    return e.withColumn("frame", seconds_to_frame("seconds", sample_rate, hop)).drop(*drop)


def in_range(events: DataFrame, maps: DataFrame) -> DataFrame:
    """Events whose frame lies inside the map; levels and maps left empty vanish."""
    m = maps.select("map_id", "n_frames")
    return events.join(m, "map_id").where((F.col("frame") >= 0) & (F.col("frame") < F.col("n_frames"))).drop("n_frames")


def map_seconds(events: DataFrame, maps: DataFrame) -> DataFrame:
    """Level length from its last beat at the base tempo."""
    last = events.groupBy("map_id", "difficulty").agg(F.max("beat").alias("last_beat"))
    return last.join(maps.select("map_id", "bpm"), "map_id").select("map_id", "difficulty", (F.col("last_beat") / (F.col("bpm") / 60.0)).alias("seconds"))
