"""Level and info documents from tables, and the small table sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from levelloom.constants import DIFFICULTY_RANK_SPEED
from levelloom.functions.scalars import lookup
from levelloom.operators.parity import K_COLS
from levelloom.plans.ordered import NOTES, SLICE, position
from levelloom.sources.documents import EVENT_FIELDS, V3_ARRAYS

#: events of one text part
PART_ROWS = 1024
EMPTY_GROUPS = ["lightColorEventBoxGroups", "lightRotationEventBoxGroups", "lightTranslationEventBoxGroups", "vfxEventBoxGroups"]
#: what stands before the first and behind the last event array of a document
DOCUMENT_HEAD = '{"version":"3.3.0",'
DOCUMENT_TAIL = ",".join(f'"{g}":[]' for g in EMPTY_GROUPS) + ',"_fxEventsCollection":{"_fl":[],"_il":[]},"useNormalEventsAsCompatibilityEvents":true}'


def _wire(kind: str, extra: Column | None = None) -> Column:
    _, spec = V3_ARRAYS[kind]
    cols = [F.col(name).alias(key) for name, (key, _) in spec.items()]
    return F.to_json(F.struct(*cols, *([extra] if extra is not None else [])))


def wire_events(events: DataFrame) -> DataFrame:
    """Every event as the JSON text of its wire object.

    A column ``rgba`` (array) on lighting rows becomes their custom colour.
    """
    missing = [F.lit(None).cast(t).alias(n) for n, t in EVENT_FIELDS if n not in events.columns]
    events = events.select("*", *missing)
    tint = F.struct(F.col("rgba").alias("_color")).alias("_customData") if "rgba" in events.columns else None
    text = F.when(F.col("kind") == "note", _wire("note"))
    for kind in list(V3_ARRAYS)[1:]:
        text = text.when(F.col("kind") == kind, _wire(kind, tint if kind == "light" else None))
    return events.select(*K_COLS, "kind", "beat", "seq", text.alias("json"))


def _joined(events: str) -> Column:
    return F.array_join(F.transform(events, lambda s: s.json), ",")


def level_fragments(events: DataFrame, rows: int = PART_ROWS) -> DataFrame:
    """Documents of any size as ordered text pieces: ``(level, array, part, text)``.

    A part holds at most ``rows`` events by their position in the array, however they lie in
    time. Joining the parts of an array with commas gives its exact content.
    """
    w = position(wire_events(events), NOTES.by("kind"))
    w = w.withColumn("part", F.floor((F.col("pos") - 1) / rows))
    g = w.groupBy(*K_COLS, "kind", "part").agg(F.sort_array(F.collect_list(F.struct("pos", "json"))).alias("e"))
    return g.select(*K_COLS, "kind", "part", F.size("e").alias("n"), _joined("e").alias("text"))


def level_documents(events: DataFrame, rows: int = PART_ROWS) -> DataFrame:
    """Finished v3 documents of all levels, put together from their parts.

    Here a level is one value; ``level_files.write_level_files`` writes the same text to a file
    without ever holding it. Empty arrays are written as such.
    """
    # parts end at the borders of slices too, so events are shuffled once, and then only texts
    w = wire_events(events).withColumn(SLICE, F.expr(NOTES.slice).cast("long"))
    w = w.withColumn("pos", F.row_number().over(W.partitionBy(*K_COLS, "kind", SLICE).orderBy(*NOTES.order)))
    g = w.groupBy(*K_COLS, "kind", SLICE, F.floor((F.col("pos") - 1) / rows).alias("part")).agg(F.sort_array(F.collect_list(F.struct("pos", "json"))).alias("e"))
    g = g.select(*K_COLS, "kind", F.struct(SLICE, "part", _joined("e").alias("text")).alias("piece")).groupBy(*K_COLS).agg(
        *[F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.col("piece")))).alias(k) for k in V3_ARRAYS]
    )
    arrays = [F.concat(F.lit(f'"{name}":['), F.array_join(F.transform(k, lambda s: s.text), ","), F.lit("]")) for k, (name, _) in V3_ARRAYS.items()]
    doc = F.concat(F.lit(DOCUMENT_HEAD), F.concat_ws(",", *arrays, F.lit(DOCUMENT_TAIL)))
    return g.select(*K_COLS, doc.alias("text"))


def info_documents(maps: DataFrame, levels: DataFrame, *, chroma: bool = True, author: str = "levelloom") -> DataFrame:
    """Info documents from ``maps`` (map_id, song_name, song_author, bpm) and (map_id, difficulty)."""
    ranks = {d: r for d, (r, _) in DIFFICULTY_RANK_SPEED.items()}
    speeds = {d: s for d, (_, s) in DIFFICULTY_RANK_SPEED.items()}
    d = F.col("difficulty")
    entry = F.struct(
        lookup(ranks, d, 7).alias("_difficultyRank"), d.alias("_difficulty"), F.concat(d, F.lit("Standard.dat")).alias("_beatmapFilename"),
        lookup(speeds, d, 16.0).alias("_noteJumpMovementSpeed"), F.lit(0).alias("_noteJumpStartBeatOffset"),
    )
    # distinct difficulty names bound this list
    lv = levels.select("map_id", "difficulty").distinct().groupBy("map_id").agg(F.sort_array(F.collect_list(entry)).alias("levels"))
    free = F.create_map().cast("map<string,string>").alias("_customData")  # maps do not sort, so it joins afterwards
    fields = ["_difficultyRank", "_difficulty", "_beatmapFilename", "_noteJumpMovementSpeed", "_noteJumpStartBeatOffset"]
    lv = lv.withColumn("levels", F.transform("levels", lambda e: F.struct(*[e[f].alias(f) for f in fields], free)))
    body = F.struct(
        F.lit("2.1.0").alias("_version"), F.col("song_name").alias("_songName"), F.lit("").alias("_songSubName"), F.col("song_author").alias("_songAuthorName"),
        F.lit(author).alias("_levelAuthorName"), F.col("bpm").alias("_beatsPerMinute"), F.lit(0).alias("_shuffle"), F.lit(0.5).alias("_shufflePeriod"),
        F.lit(12.0).alias("_previewStartTime"), F.lit(10.0).alias("_previewDuration"), F.lit("song.ogg").alias("_songFilename"), F.lit("cover.png").alias("_coverImageFilename"),
        F.lit("DefaultEnvironment").alias("_environmentName"), F.lit(0.0).alias("_songTimeOffset"),
        F.array(F.struct(F.lit("Standard").alias("_beatmapCharacteristicName"), F.col("levels").alias("_difficultyBeatmaps"))).alias("_difficultyBeatmapSets"),
        *([F.struct(F.array(F.lit("Chroma")).alias("_suggestions")).alias("_customData")] if chroma else []),
    )
    return maps.join(lv, "map_id").select("map_id", F.to_json(body).alias("text"))


def write_table(df: DataFrame, path: str, *, partition: str | None = None, mode: str = "overwrite", fmt: str = "parquet") -> None:
    """Index, blacklist, split, reference, bucket and manifest tables; the commit protocol makes it atomic."""
    w = df.write.mode(mode).format(fmt)
    (w.partitionBy(partition) if partition else w).save(path)


def append_log(df: DataFrame, path: str) -> None:
    """Append experiment or evaluation rows as JSON lines."""
    df.write.mode("append").json(path)


def upsert_manifest(current: DataFrame, incoming: DataFrame, key: str = "map_id", at: str = "downloaded_at") -> DataFrame:
    """Newest row per map over the stored and the incoming manifest."""
    u = current.unionByName(incoming, allowMissingColumns=True)
    newest = F.max_by(F.struct(*[F.col(c) for c in u.columns]), F.col(at)).alias("r")
    return u.groupBy(key).agg(newest).select("r.*")
