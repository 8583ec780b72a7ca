"""Level quality: metrics per level, composite score, exact score cut and blacklist."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from levelloom.constants import QUALITY_PENALTIES as QP, SHORT_MAP_FRAMES
from levelloom.functions.scalars import frames_seconds
from levelloom.operators.parity import K_COLS, listed_alternation
from levelloom.plans.ordered import Track, scan
from levelloom.session import cut


def entropy(counts: list[Column]) -> Column:
    """Shannon entropy in bits of counts held in columns."""
    total = sum(counts[1:], counts[0])
    terms = [F.when(c > 0, -(c / total) * F.log2(c / total)).otherwise(0.0) for c in counts]
    return sum(terms[1:], terms[0])


def onset_rows(events: DataFrame) -> DataFrame:
    """Every place that opens an onset: objects and arc tails, not lights and boosts."""
    objects = events.where(F.col("kind").isin("note", "bomb", "wall", "arc", "chain")).select(*K_COLS, "beat", "kind")
    if "tail_beat" not in events.columns:
        return objects
    return objects.unionByName(events.where("kind = 'arc'").select(*K_COLS, F.col("tail_beat").alias("beat"), F.lit("arc_end").alias("kind")))


def onset_counts(events: DataFrame) -> DataFrame:
    """Onsets of a level, how many hold no note, and the spread of notes per onset."""
    per = onset_rows(events).groupBy(*K_COLS, "beat").agg(F.count_if(F.col("kind") == "note").alias("n"))
    return per.groupBy(*K_COLS).agg(
        F.count("*").alias("n_onsets"), F.count_if(F.col("n") == 0).alias("n_empty"),
        F.avg("n").alias("mean_n"), F.stddev_pop("n").alias("sd_n"),
    )


def note_counters(notes: DataFrame) -> DataFrame:
    """Cell, direction and colour counters per level in one map-side-combined pass."""
    cells = [F.count_if((F.col("x") == x) & (F.col("y") == y)).alias(f"cell_{x}{y}") for x in range(4) for y in range(3)]
    dirs = [F.count_if(F.col("direction") == d).alias(f"dir_{d}") for d in range(9)]
    return notes.groupBy(*K_COLS).agg(F.count("*").alias("total_notes"), F.count_if(F.col("color") == 0).alias("red"), *cells, *dirs)


def quality_metrics(events: DataFrame, maps: DataFrame) -> DataFrame:
    """Ten quality metrics per (map, difficulty), plus flags for unusable levels.

    A level whose events open no onset at all (lights only) comes back flagged ``empty``.
    """
    levels = events.select(*K_COLS).distinct()
    in_range = "kind = 'note' and color between 0 and 1 and x between 0 and 3 and y between 0 and 2 and direction between 0 and 8"
    notes = events.where(in_range)
    m = (
        levels.join(onset_counts(events), K_COLS, "left")
        .join(note_counters(notes), K_COLS, "left")
        .join(listed_alternation(notes), K_COLS, "left")
        .join(maps.select("map_id", "n_frames"), "map_id")
    )
    cells = [F.col(f"cell_{x}{y}") for x in range(4) for y in range(3)]
    dirs = [F.col(f"dir_{d}") for d in range(8)]
    used = sum([(c > 0).cast("int") for c in cells[1:]], (cells[0] > 0).cast("int"))
    n_dirs = sum(dirs[1:], dirs[0])
    total = F.coalesce("total_notes", F.lit(0))
    r = lambda c: F.round(c, 9)  # noqa: E731  order-dependent float sums are compared at 9 digits
    return m.select(
        *K_COLS,
        r(F.coalesce("violations", F.lit(0)) / F.greatest(F.coalesce("checks", F.lit(0)), F.lit(1))).alias("parity_rate"),
        r(F.abs(F.col("red") / F.nullif(total, F.lit(0)) - 0.5) * 2).alias("color_imbalance"),
        r(F.when(used <= 1, 0.0).otherwise(entropy(cells) / F.log2(F.greatest(used, F.lit(2))))).alias("grid_entropy"),
        r(F.when(F.col("n_onsets") > 1, F.col("sd_n") / F.greatest("mean_n", F.lit(0.01))).otherwise(0.0)).alias("nps_cv"),
        r(F.col("n_empty") / F.col("n_onsets")).alias("empty_ratio"),
        r(F.when(n_dirs > 0, entropy(dirs) / 3.0).otherwise(0.0)).alias("dir_entropy"),
        r(F.col("dir_8") / F.nullif(total, F.lit(0))).alias("dot_ratio"),
        r(total / F.greatest(frames_seconds("n_frames"), F.lit(1.0))).alias("nps"),
        total.alias("total_notes"), F.coalesce("n_onsets", F.lit(0)).alias("n_onsets"), (total < 5).alias("too_few_notes"),
        (F.coalesce("n_onsets", F.lit(0)) == 0).alias("empty"),
    )


def quality_score(m: Mapping[str, Column] | None = None) -> Column:
    """Composite 0-1 score of one level from its metrics."""
    c = F.col

    def share(name, limit):
        return F.least(c(name) / limit, F.lit(1.0))

    s = (
        1.0
        - QP["parity"] * share("parity_rate", 0.5)
        - QP["color"] * share("color_imbalance", 0.8)
        - QP["grid"] * (1.0 - c("grid_entropy"))
        - QP["direction"] * (1.0 - c("dir_entropy"))
        - QP["dots"] * share("dot_ratio", 0.3)
        - QP["empty"] * share("empty_ratio", 0.2)
        - F.when((c("nps") > 20) | (c("nps") < 0.5), QP["nps"]).otherwise(0.0)
    )
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))
    return F.round(F.when(c("too_few_notes"), 0.0).otherwise(s), 9)


def song_scores(metrics: DataFrame) -> DataFrame:
    """Best score over a map's difficulties."""
    return metrics.groupBy("map_id").agg(F.max(quality_score()).alias("score"))


def pick_by_index(df: DataFrame, value: str, picks: Mapping[str, float | None]) -> DataFrame:
    """One row with the values at index ``int(n * fraction)`` of the sorted column.

    Exact: equal values are counted first, counts are accumulated in value slices,
    and only slice totals meet in one place. ``None`` picks the last value.
    """
    counted = df.groupBy(value).agg(F.count("*").alias("n"))
    # slices of one thousandth hold for scores in [0, 1]
    cum = scan(counted, Track((), (value,), f"floor({value} * 1000)"), sums={"upto": "n"})
    total = df.agg(F.count("*").alias("n")).scalar()

    def at(fraction):
        idx = total - 1 if fraction is None else F.least(F.floor(total * float(fraction)), total - 1)
        return F.max(F.when((F.col("upto") - F.col("n") <= idx) & (idx < F.col("upto")), F.col(value)))

    return cum.agg(*[at(f).alias(name) for name, f in picks.items()])


def score_distribution(scores: DataFrame) -> DataFrame:
    return pick_by_index(scores, "score", {"min": 0.0, "p10": 0.10, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.90, "max": None})


def metadata_blacklist(index: DataFrame) -> DataFrame:
    """First matching metadata rule per map; ``index`` has n_frames, category, difficulties."""
    rule = (
        F.when(F.col("n_frames") < SHORT_MAP_FRAMES, F.concat(F.lit("short_song ("), F.col("n_frames").cast("string"), F.lit(" frames)")))
        .when(F.col("category").isin("noodle", "mapping_extensions"), F.concat(F.lit("modded ("), F.col("category"), F.lit(")")))
        .when(~F.array_contains("difficulties", "Expert") & ~F.array_contains("difficulties", "ExpertPlus"), "no_expert_difficulty")
    )
    return index.select("map_id", rule.alias("reason")).where("reason is not null")


def quality_blacklist(index: DataFrame, metrics: DataFrame, threshold: float = 0.15) -> DataFrame:
    """Metadata rules, then every remaining map whose score is at or below the cut."""
    meta = metadata_blacklist(index)
    scored = cut(song_scores(metrics).join(meta, "map_id", "left_anti"))  # read twice below
    cutoff = pick_by_index(scored, "score", {"cutoff": threshold}).scalar()
    low = scored.where(F.col("score") <= cutoff).select(
        "map_id", F.format_string("low_quality (score=%.3f)", "score").alias("reason")
    )
    return meta.unionByName(low)


def reason_summary(blacklist: DataFrame) -> DataFrame:
    kind = F.split("reason", " \\(").getItem(0)
    return blacklist.groupBy(kind.alias("kind")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")


def map_index(events: DataFrame, lights: DataFrame, maps: DataFrame) -> DataFrame:
    """Frames, category, genre and per-difficulty onset and light counts; one row per (map, difficulty).

    ``maps`` has (map_id, n_frames, category) and may have genre; what is missing is unknown.
    """
    onsets = onset_rows(events).groupBy(*K_COLS, "beat").agg(F.lit(1).alias("one")).groupBy(*K_COLS).agg(F.count("*").alias("n_onsets"))
    keys = [c for c in K_COLS if c in lights.columns]  # lights of one level, or of all levels of a map
    lit = lights.select(*keys, "beat").distinct().groupBy(*keys).agg(F.count("*").alias("n_lights"))
    known = F.coalesce("genre", F.lit("unknown")) if "genre" in maps.columns else F.lit("unknown")
    return (
        onsets.join(maps.where("n_frames is not null").select("map_id", "n_frames", "category", known.alias("genre")), "map_id")
        .join(lit, keys, "left")
        .select(*K_COLS, "n_frames", F.coalesce("category", F.lit("unknown")).alias("category"), "genre", "n_onsets", F.coalesce("n_lights", F.lit(0)).alias("n_lights"))
    )


def nested_index(index: DataFrame) -> DataFrame:
    """One row per map with its difficulties as a list (bounded by the difficulty names)."""
    return index.groupBy("map_id").agg(
        F.max("n_frames").alias("n_frames"), F.max("category").alias("category"), F.max("genre").alias("genre"),
        F.sort_array(F.collect_set("difficulty")).alias("difficulties"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("difficulty", F.struct("n_onsets", "n_lights").alias("n"))))).alias("counts"),
    )
