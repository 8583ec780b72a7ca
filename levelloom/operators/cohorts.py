"""Cohorts and buckets: membership, style reference, and the comparison table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from levelloom.constants import DIFFICULTY_PREFERENCE
from levelloom.functions.scalars import direction_name, frames_seconds, split_fine
from levelloom.operators.parity import K_COLS, remembered_pairs


def bucket_members(bucket: DataFrame, registry: DataFrame) -> DataFrame:
    """Bucket to member names; ids the registry does not know are dropped."""
    return bucket.join(registry, "mapper_id")


def bucket_maps(bucket: DataFrame, maps: DataFrame) -> DataFrame:
    """One row per (bucket, map) with its split, however many members share the map."""
    j = bucket.join(maps.select("map_id", "mapper_id"), "mapper_id")
    return j.select("bucket_id", "map_id").distinct().withColumn("split", split_fine(F.col("map_id").cast("string")))


def missing_cohorts(bucket: DataFrame, maps: DataFrame) -> DataFrame:
    return bucket.join(maps.select("mapper_id").distinct(), "mapper_id", "left_anti")


def bucket_info(bucket: DataFrame, maps: DataFrame) -> DataFrame:
    """Map and split counts per bucket, with member and missing lists (registry sized)."""
    names = bucket.groupBy("bucket_id").agg(F.sort_array(F.collect_set("mapper_id")).alias("members"))
    gone = missing_cohorts(bucket, maps).groupBy("bucket_id").agg(F.sort_array(F.collect_set("mapper_id")).alias("missing"))
    n = bucket_maps(bucket, maps).groupBy("bucket_id").agg(
        F.count("*").alias("n_maps"), *[F.count_if(F.col("split") == s).alias(f"n_{s}") for s in ("train", "val", "test")]
    )
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_maps", "n_train", "n_val", "n_test")]
    j = names.join(n, "bucket_id", "left").join(gone, "bucket_id", "left")
    return j.select("bucket_id", "members", F.coalesce("missing", F.array().cast("array<int>")).alias("missing"), *zero)


def preferred_difficulty(index: DataFrame, allowed=None) -> DataFrame:
    """The difficulty a map is judged by: the first preferred one that has onsets."""
    place = F.array_position(F.array(*[F.lit(d) for d in DIFFICULTY_PREFERENCE]), F.col("difficulty"))
    d = index.where((F.col("n_onsets") > 0) & (place > 0))
    if allowed:
        d = d.where(F.col("difficulty").isin(*allowed))
    return d.groupBy("map_id").agg(F.min_by("difficulty", place).alias("difficulty"))


def first_slots(notes: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` notes of every onset in canonical order."""
    w = W.partitionBy(*K_COLS, "beat").orderBy("x", "y", "seq")
    return notes.withColumn("_slot", F.row_number().over(w)).where(F.col("_slot") <= n).drop("_slot")


def cohort_reference(notes: DataFrame, index: DataFrame, maps: DataFrame, cohort: str = "mapper_id") -> DataFrame:
    """Style statistics per cohort: sizes, density, direction shares, parity, balance.

    Every map is reduced to one small row first; cohorts only add up map rows.
    """
    chosen = preferred_difficulty(index)
    n = first_slots(notes.join(chosen, K_COLS, "left_semi"))
    per_map = n.groupBy("map_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("color") == 0).alias("red"), F.count_if(F.col("color") == 1).alias("blue"),
        *[F.count_if(F.col("direction") == d).alias(f"d{d}") for d in range(9)],
    )
    pairs = remembered_pairs(n, ["map_id"], order=("beat", "x", "y", "seq"))
    m = maps.join(chosen, "map_id").join(per_map, "map_id", "left").join(pairs, "map_id", "left").na.fill(0)
    g = m.groupBy(cohort).agg(
        F.count("*").alias("n_maps"), F.sum("n").alias("n_notes_total"),
        F.round(F.sum(frames_seconds("n_frames")), 6).alias("total_song_sec"),
        F.sum("red").alias("red_count"), F.sum("blue").alias("blue_count"),
        F.sum("violations").alias("_v"), F.sum("checks").alias("_c"), *[F.sum(f"d{d}").alias(f"_d{d}") for d in range(9)],
    )
    one = F.lit(1)
    return g.select(
        cohort, "n_maps", "n_notes_total", "total_song_sec", "red_count", "blue_count",
        F.round(F.col("n_notes_total") / F.greatest(F.col("total_song_sec"), F.lit(1.0)), 9).alias("mean_nps"),
        (F.col("_v") / F.greatest("_c", one)).alias("parity_rate_baseline"),
        (F.col("red_count") / F.greatest(F.col("red_count") + F.col("blue_count"), one)).alias("color_balance"),
        *[(F.col(f"_d{d}") / F.greatest("n_notes_total", one)).alias(f"dir_{d}") for d in range(9)],
    )


def direction_map() -> Column:
    """The nine share columns as a map from direction to share."""
    return F.map_from_arrays(F.array(*[F.lit(d) for d in range(9)]), F.array(*[F.col(f"dir_{d}") for d in range(9)]))


def top_directions(k: int = 2) -> Column:
    """The ``k`` largest direction shares as text, equal shares in direction order."""
    e = F.array(*[F.struct((-F.col(f"dir_{d}")).alias("neg"), F.lit(d).alias("d")) for d in range(9)])
    part = F.transform(F.slice(F.array_sort(e), 1, k), lambda s: F.format_string("%s=%d%%", direction_name(s.d), F.rint(-s.neg * 100).cast("int")))
    return F.array_join(part, " ")


SORT_KEYS = {"n_maps": "n_maps", "nps": "mean_nps", "parity": "parity_rate_baseline", "notes": "n_notes_total"}


def cohort_table(reference: DataFrame, sort: str = "n_maps", desc: bool = False, cohort: str = "mapper_id") -> DataFrame:
    key = F.col(SORT_KEYS[sort])
    order = key.desc() if desc or sort in ("n_maps", "notes") else key.asc()
    return reference.withColumn("top_dirs", top_directions()).orderBy(order, cohort)


def one_source(df: DataFrame, cohort: str | None = None, bucket: str | None = None) -> DataFrame:
    """Rows of exactly one cohort or bucket; both tables are partitioned by these columns."""
    if (cohort is None) == (bucket is None):
        raise ValueError("give exactly one of cohort and bucket")
    return df.where(F.col("cohort") == cohort) if cohort is not None else df.where(F.col("bucket") == bucket)
