"""Swing-parity rules. Each rule keeps its own treatment of dots, gaps and memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from levelloom.functions.scalars import alternates, direction_vector, is_neutral, parity_class
from levelloom.plans.ordered import NOTES, Track, scan

K_COLS = ["map_id", "difficulty"]
HANDS = NOTES.by("color")


def _rate(df: DataFrame, keys, violation: Column, check: Column) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.sum(violation.cast("long")).alias("violations"), F.sum(check.cast("long")).alias("checks")
    )


def listed_alternation(notes: DataFrame, order=("beat", "x", "y", "seq")) -> DataFrame:
    """Adjacent non-dot notes of one hand must follow the listed alternation table."""
    track = Track(HANDS.keys, tuple(order), HANDS.slice)
    n = scan(notes.where("direction <> 8"), track, prev={"prev_dir": "direction"})
    check = F.col("prev_dir").isNotNull()
    return _rate(n, K_COLS, check & ~alternates("prev_dir", "direction"), check)


def _same_class(notes: DataFrame, track: Track) -> DataFrame:
    n = notes.where(~is_neutral("direction")).withColumn("cls", parity_class("direction"))
    return scan(n, track, prev={"prev_cls": "cls", "prev_beat": "beat"})


def remembered_pairs(notes: DataFrame, keys=K_COLS, order=("beat", "seq")) -> DataFrame:
    """Same hand side twice, remembering the last non-neutral swing across neutral ones."""
    n = _same_class(notes, Track(HANDS.keys, tuple(order), HANDS.slice))
    check = F.col("prev_cls").isNotNull()
    return _rate(n, keys, check & (F.col("prev_cls") == F.col("cls")), check)


def gap_reset(notes: DataFrame, max_gap: float = 3.0) -> DataFrame:
    """As ``remembered_pairs``, forgetting the last swing after a long pause."""
    n = _same_class(notes, HANDS)
    check = F.col("prev_cls").isNotNull() & ~(F.col("beat") - F.col("prev_beat") > max_gap)
    return _rate(n, K_COLS, check & (F.col("prev_cls") == F.col("cls")), check)


def adjacent_only(notes: DataFrame) -> DataFrame:
    """Only directly adjacent swings count; a neutral one breaks the chain."""
    n = scan(notes, HANDS, prev={"prev_dir": "direction"})
    check = F.col("prev_dir").isNotNull() & ~is_neutral("prev_dir") & ~is_neutral("direction")
    return _rate(n, K_COLS, check & (parity_class("prev_dir") == parity_class("direction")), check)


def cross_onset(notes: DataFrame, max_gap_sec: float = 3.0) -> DataFrame:
    """Every note of an onset against the last swing of its hand in the onset before.

    ``notes`` carries ``frame``. The onset before is the previous one with any note;
    onsets more than ``max_gap_sec`` apart (frames at the rounded rate) are skipped.
    """
    at = F.struct("x", "y", "seq")
    onset = notes.groupBy(*K_COLS, "beat").agg(
        F.min("frame").alias("frame"),
        *[F.max_by(F.when(F.col("color") == c, F.col("direction")), F.when(F.col("color") == c, at)).alias(f"last{c}") for c in (0, 1)],
    )
    track = Track(NOTES.keys, ("beat",), NOTES.slice)
    onset = scan(onset, track, prev={"p0": "last0", "p1": "last1", "prev_frame": "frame"})
    near = (F.col("frame") - F.col("prev_frame")) / 86.0 <= max_gap_sec
    onset = onset.where(near).select(*K_COLS, "beat", "p0", "p1")
    n = notes.join(onset, [*K_COLS, "beat"])
    before = F.when(F.col("color") == 0, F.col("p0")).otherwise(F.col("p1"))
    check = before.isNotNull() & ~is_neutral(before)
    return _rate(n, K_COLS, check & ~is_neutral("direction") & (parity_class(before) == parity_class("direction")), check)


def within_onset(notes: DataFrame) -> DataFrame:
    """Same-hand notes of one onset in cell order, skipping neutral swings for memory."""
    track = Track((*HANDS.keys, "beat"), ("x", "y", "seq"), "x")
    cls = F.when(~is_neutral("direction"), parity_class("direction"))
    n = scan(notes.withColumn("cls", cls), track, prev={"prev_cls": ("cls", F.col("cls").isNotNull())})
    check = F.col("prev_cls").isNotNull()
    return _rate(n, K_COLS, F.coalesce(check & (F.col("prev_cls") == F.col("cls")), F.lit(False)), check)


def follow_through(notes: DataFrame) -> DataFrame:
    """Mean misalignment of the swing with the hand's travel; dots count one half."""
    n = scan(notes, HANDS, prev={"px": "x", "py": "y"})
    dx, dy = (F.col("x") - F.col("px")).cast("double"), (F.col("y") - F.col("py")).cast("double")
    dist = F.sqrt(dx * dx + dy * dy)
    vx, vy = direction_vector("direction")
    miss = F.when(F.col("direction") == 8, 0.5).otherwise((1.0 - (vx * dx / dist + vy * dy / dist)) * 0.5)
    n = n.where(dist >= 0.5).withColumn("miss", miss)
    return n.groupBy(*K_COLS).agg(F.round(F.avg("miss"), 8).alias("misalignment"), F.count("*").alias("moves"))


def wrong_side(notes: DataFrame) -> DataFrame:
    """Share of notes on the other hand's half of the grid."""
    off = ((F.col("color") == 0) & (F.col("x") >= 2)) | ((F.col("color") == 1) & (F.col("x") <= 1))
    return notes.groupBy(*K_COLS).agg(F.avg(off.cast("double")).alias("wrong_share"), F.count("*").alias("n_notes"))
