"""Catalogue curation: filters, mod categories, genres, quotas, splits, joins to sidecars."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from levelloom.constants import GENRE_RULES
from levelloom.functions.scalars import difficulty_id, genre_id, upload_year
from levelloom.plans.ordered import Track, scan

EXPERTS = ("Expert", "ExpertPlus")


# ---- document predicates ---------------------------------------------------
def _human_made() -> Column:
    ai = F.coalesce(F.col("declaredAi"), F.lit("None"))
    return ~F.coalesce(F.col("automapper"), F.lit(False)) & ai.isin("", "None")


def _recent(min_year: int) -> Column:
    year = upload_year("uploaded")
    return year.isNull() | (year >= min_year)


def _diffs() -> Column:
    return F.flatten(F.transform("versions", lambda v: v.diffs))


def _standard() -> Column:
    return F.filter(_diffs(), lambda d: d.characteristic == "Standard")


def passes_quality(min_rating: float, max_nps: float, min_year: int, exclude_ai: bool = True) -> Column:
    """Rating, year, human-made, has a Standard level, no over-dense Expert level."""
    fast = F.exists(_standard(), lambda d: d.difficulty.isin(*EXPERTS) & (F.coalesce(d.nps, F.lit(0.0)) > max_nps))
    ok = (
        (F.coalesce(F.col("stats.score"), F.lit(0.0)) >= min_rating) & _recent(min_year)
        & (F.coalesce(F.size(_standard()), F.lit(0)) > 0) & ~F.coalesce(fast, F.lit(False))
    )
    return ok & _human_made() if exclude_ai else ok


def passes_cohort(min_year: int, exclude_ai: bool = True) -> Column:
    """No rating or density cap, but an Expert Standard level is required."""
    ok = _recent(min_year) & F.coalesce(F.exists(_standard(), lambda d: d.difficulty.isin(*EXPERTS)), F.lit(False))
    return ok & _human_made() if exclude_ai else ok


def flag_category() -> Column:
    """Mod category from catalogue flags on any level."""

    def has(field):
        return F.coalesce(F.exists(_diffs(), lambda d: F.coalesce(d[field], F.lit(False))), F.lit(False))

    return F.when(has("ne"), "noodle").when(has("me"), "mapping_extensions").when(has("chroma"), "chroma").otherwise("vanilla")


def latest_hash() -> Column:
    return F.get("versions", F.size("versions") - 1).hash


def raw_tags() -> Column:
    return F.coalesce(F.col("tags"), F.array().cast("array<string>"))


def declared_mods(mods: DataFrame) -> DataFrame:
    """Distinct sorted requirements and suggestions per map and the resulting category.

    ``mods`` has one row per Info level (and one for the document top) with two arrays.
    """
    each = mods.select("map_id", F.explode_outer(F.concat(
        F.transform("requirements", lambda m: F.struct(m.alias("mod"), F.lit("r").alias("k"))),
        F.transform("suggestions", lambda m: F.struct(m.alias("mod"), F.lit("s").alias("k"))),
    )).alias("m"))
    each = each.groupBy("map_id").agg(
        *[F.sort_array(F.collect_set(F.when(F.col("m.k") == k, F.col("m.mod")))).alias(n) for k, n in (("r", "requirements"), ("s", "suggestions"))]
    )
    either = F.array_union("requirements", "suggestions")

    def named(arr, text):
        return F.exists(arr, lambda m: F.lower(m).contains(text))

    return each.withColumn(
        "category",
        F.when(named(either, "vivify"), "vivify").when(named("requirements", "noodle extensions"), "noodle")
        .when(named("requirements", "mapping extensions"), "mapping_extensions").when(named(either, "chroma"), "chroma").otherwise("vanilla"),
    )


def genre_of(tags) -> Column:
    """Canonical genre of a tag list: the first rule that contains, or lies in, any tag."""
    rules = F.array(*[F.struct(F.lit(n).alias("needle"), F.lit(g).alias("genre")) for n, g in GENRE_RULES])
    clean = F.transform(F.col(tags) if isinstance(tags, str) else tags, lambda t: F.lower(F.trim(t)))
    hit = F.filter(rules, lambda r: F.exists(clean, lambda t: t.contains(r.needle) | r.needle.contains(t)))
    return F.coalesce(F.get(hit, F.lit(0)).genre, F.lit("unknown"))


# ---- quotas ----------------------------------------------------------------
def accept_by_quota(
    docs: DataFrame, quotas: Mapping[str, int | None], *, existing: Mapping[str, int] | None = None, count: int | None = None
) -> DataFrame:
    """Accept maps in rating order until every capped category is full.

    ``docs`` has ``map_id, score, category`` and holds only maps that pass the filters
    and are not stored yet. Uncapped categories stop with the last filled cap; with no
    caps, the first ``count`` maps are taken.
    """
    existing = existing or {}
    caps = {c: q - existing.get(c, 0) for c, q in quotas.items() if q is not None}
    d = docs.withColumn("_worse", -F.col("score"))
    track = Track((), ("_worse", "map_id"), "floor(_worse * 1000)")
    d = scan(d, track, sums={"pos": F.lit(1).cast("long"), **{f"_n_{c}": (F.col("category") == c).cast("long") for c in caps}})
    keep = F.lit(True)
    for c, left in caps.items():
        keep = keep & ((F.col("category") != c) | (F.col(f"_n_{c}") <= max(left, 0)))
    if caps:
        full = [F.when(F.max(f"_n_{c}") >= left, F.coalesce(F.min(F.when(F.col(f"_n_{c}") >= max(left, 1), F.col("pos"))), F.lit(0))) if left > 0
                else F.lit(0) for c, left in caps.items()]
        # null while any cap stays open: then nothing stops the intake
        stop = d.agg(F.array_max(F.transform(F.array(*full), lambda x: F.coalesce(x, F.lit(2**62)))).alias("stop")).scalar()
        keep = keep & (F.col("pos") <= stop)
    else:
        keep = F.col("pos") <= (count or 0)
    return d.where(keep).select("map_id", "score", "category", "pos")


# ---- sidecar joins ---------------------------------------------------------
def with_manifest(archives: DataFrame, manifest: DataFrame, default: str = "unknown") -> DataFrame:
    """Archives with their manifest row; maps without one get the default category."""
    j = archives.join(manifest, "map_id", "left")
    return j.withColumn("category", F.coalesce("category", F.lit(default))).withColumn("genre", F.coalesce("genre", F.lit("unknown")))


def exclude_categories(df: DataFrame, names, default: str = "unknown") -> DataFrame:
    return df.where(~F.coalesce("category", F.lit(default)).isin(*names))


def training_maps(
    index: DataFrame, *, split: DataFrame | None = None, blacklist: DataFrame | None = None, whitelist: DataFrame | None = None,
    exclude=(), difficulties=(),
) -> DataFrame:
    """Index rows left after the optional sidecars, with embedding ids attached."""
    d = index
    if split is not None:
        d = d.join(split.select("map_id"), "map_id", "left_semi")
    if blacklist is not None:
        d = d.join(blacklist.select("map_id"), "map_id", "left_anti")
    if whitelist is not None:
        d = d.join(whitelist.select("map_id"), "map_id", "left_semi")
    if exclude:
        d = exclude_categories(d, exclude, "vanilla")
    if difficulties:
        d = d.where(F.col("difficulty").isin(*difficulties))
    genre = F.col("genre") if "genre" in d.columns else F.lit("unknown")
    return d.withColumn("difficulty_id", difficulty_id("difficulty")).withColumn("genre_id", genre_id(genre))


def unseen(incoming: DataFrame, done: DataFrame, force: bool = False) -> DataFrame:
    """Rows whose map is not processed yet; everything when forced."""
    return incoming if force else incoming.join(done.select("map_id").distinct(), "map_id", "left_anti")


def backfill_manifest(manifest: DataFrame, classified: DataFrame) -> DataFrame:
    """Manifest plus archives it does not list yet."""
    new = classified.join(manifest.select("map_id"), "map_id", "left_anti")
    return manifest.unionByName(new, allowMissingColumns=True)


def category_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("category").agg(F.count("*").alias("n"))


def ingest_stats(docs: DataFrame, passed: Column, stored: DataFrame, failed: DataFrame) -> DataFrame:
    """Per-mapper intake counters and their grand total (mapper null).

    ``docs`` has ``mapper_id`` and ``map_id``; ``stored``/``failed`` list map ids.
    """
    d = (
        docs.withColumn("passed", passed)
        .join(stored.select("map_id").distinct().withColumn("old", F.lit(True)), "map_id", "left")
        .join(failed.select("map_id").distinct().withColumn("bad", F.lit(True)), "map_id", "left")
    )
    old, bad = F.coalesce("old", F.lit(False)), F.coalesce("bad", F.lit(False))
    ok = F.col("passed")
    return d.rollup("mapper_id").agg(
        F.count("*").alias("maps_seen"), F.count_if(ok).alias("maps_passed"), F.count_if(ok & old).alias("maps_skipped_existing"),
        F.count_if(ok & ~old & ~bad).alias("maps_downloaded"), F.count_if(ok & ~old & bad).alias("maps_failed"),
    )


def validate_registry(registry: DataFrame, users: DataFrame) -> DataFrame:
    """Registry entries against the user table: ok, mismatch, not_found or error."""
    u = users.select(F.col("user_id"), F.col("name").alias("user_name"), F.col("error").alias("lookup_error"))
    j = registry.join(u, registry["mapper_id"] == u["user_id"], "left")
    status = (
        F.when(F.col("lookup_error").isNotNull(), "error").when(F.col("user_id").isNull(), "not_found")
        .when(F.lower("user_name") == F.lower("stated_name"), "ok").otherwise("mismatch")
    )
    return j.select("mapper_id", "stated_name", "user_name", status.alias("status"))


def status_counts(validated: DataFrame) -> DataFrame:
    return validated.groupBy("status").agg(F.count("*").alias("n"))
