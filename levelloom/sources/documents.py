"""Level archives and documents: archive members, info documents, both level generations."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from levelloom.session import cut

MEMBER_SCHEMA = "map_id string, member string, pos int, text string"


# ---- archives --------------------------------------------------------------
def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """Archive files with the map id taken from the file name; contents stay lazy."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    return f.withColumn("map_id", F.regexp_extract("path", r"([^/]+)\.zip$", 1))


def _members(content: bytes) -> Iterator[tuple[str, int, str]]:
    with zipfile.ZipFile(io.BytesIO(content)) as zf:
        for pos, name in enumerate(zf.namelist()):
            if name.lower().endswith(".dat"):
                yield name, pos, zf.read(name).decode("utf-8", "replace")


def archive_members(archives: DataFrame) -> DataFrame:
    """Text members of every archive in archive order; broken archives give one null row.

    ``archives`` has ``map_id, content``; join or filter it on ``map_id`` first, so
    that unwanted archives are never opened. Audio members are skipped unread.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for map_id, content in zip(b["map_id"], b["content"]):
                try:
                    rows += [(str(map_id), m, p, t) for m, p, t in _members(content)]
                except (zipfile.BadZipFile, KeyError, OSError):
                    rows.append((str(map_id), None, None, None))
            yield pd.DataFrame(rows, columns=["map_id", "member", "pos", "text"])

    return archives.select("map_id", "content").mapInPandas(read, MEMBER_SCHEMA)


def find_member(members: DataFrame, target: str) -> DataFrame:
    """First member whose base name matches ``target`` whatever its case."""
    base = F.lower(F.element_at(F.split("member", "/"), -1))
    return members.where(base == target.lower()).groupBy("map_id").agg(
        F.min_by("member", "pos").alias("member"), F.min_by("text", "pos").alias("text")
    )


def find_members(members: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each row of ``wanted`` (map_id, filename, ...) the first member of that base name, whatever its case."""
    base = F.lower(F.element_at(F.split("member", "/"), -1))
    places = members.where("member is not null").groupBy("map_id", base.alias("_base"), "pos").agg(F.count("*").alias("_n"))
    first = places.groupBy("map_id", "_base").agg(F.min("pos").alias("pos"), F.min_by("_n", "pos").alias("_n"))
    # names are matched without their texts, and what is found is stored: texts then stay where they lie if it is small
    found = wanted.withColumn("_base", F.lower(F.element_at(F.split("filename", "/"), -1))).join(first, ["map_id", "_base"]).drop("_base")
    found, texts = cut(found), members.select("map_id", "pos", "text")
    out = found.where("_n = 1").join(texts, ["map_id", "pos"]).select(*wanted.columns, "text")
    twice = found.where("_n > 1")  # several archives of one map
    if not twice.isEmpty():
        out = out.unionByName(twice.join(texts, ["map_id", "pos"]).groupBy(*wanted.columns).agg(F.min("text").alias("text")))
    return out


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Text members of all archives under ``path``, on any storage Spark reads.

    The reader lists and splits the files itself, many small archives to a task.
    """
    return archive_members(archive_files(spark, path))


# ---- info documents --------------------------------------------------------
_LEVEL = "struct<_difficulty:string,_difficultyRank:double,_beatmapFilename:string,_noteJumpMovementSpeed:double,_noteJumpStartBeatOffset:double,_customData:struct<_requirements:array<string>,_suggestions:array<string>>>"
INFO_SCHEMA = (
    "struct<_songName:string,_songSubName:string,_songAuthorName:string,_levelAuthorName:string,_beatsPerMinute:string,_songFilename:string,"
    "_coverImageFilename:string,_environmentName:string,_songTimeOffset:string,_previewStartTime:string,_previewDuration:string,"
    "_customData:struct<_requirements:array<string>,_suggestions:array<string>>,"
    f"_difficultyBeatmapSets:array<struct<_beatmapCharacteristicName:string,_difficultyBeatmaps:array<{_LEVEL}>>>>"
)


def parse_info(docs: DataFrame) -> DataFrame:
    """Info documents (``map_id, text``) with defaults for missing keys; levels stay nested."""
    d = docs.select("map_id", F.from_json("text", INFO_SCHEMA).alias("i")).where("i is not null")
    i = lambda k: F.col(f"i.{k}")

    def text(k, default):
        return F.coalesce(i(k), F.lit(default))

    def num(k, default):
        return F.coalesce(i(k).try_cast("double"), F.lit(float(default)))

    return d.select(
        "map_id", text("_songName", "").alias("song_name"), text("_songSubName", "").alias("song_sub_name"),
        text("_songAuthorName", "").alias("song_author"), text("_levelAuthorName", "").alias("level_author"),
        num("_beatsPerMinute", 120).alias("bpm"), text("_songFilename", "song.ogg").alias("song_filename"),
        text("_coverImageFilename", "").alias("cover_filename"), text("_environmentName", "DefaultEnvironment").alias("environment_name"),
        num("_songTimeOffset", 0).alias("song_time_offset"), num("_previewStartTime", 0).alias("preview_start"),
        num("_previewDuration", 10).alias("preview_duration"), i("_customData").alias("mods"), i("_difficultyBeatmapSets").alias("sets"),
    )


def info_levels(info: DataFrame, characteristic: str | None = None) -> DataFrame:
    """One row per level listed by the info documents."""
    d = info.select("map_id", F.explode("sets").alias("s"))
    d = d.select("map_id", F.coalesce("s._beatmapCharacteristicName", F.lit("Standard")).alias("characteristic"), F.posexplode("s._difficultyBeatmaps").alias("pos", "l"))
    if characteristic:
        d = d.where(F.col("characteristic") == characteristic)
    l = lambda k, v: F.coalesce(F.col(f"l.{k}"), F.lit(v))
    return d.select(
        "map_id", "characteristic", "pos", l("_difficulty", "").alias("difficulty"), l("_difficultyRank", 0.0).cast("int").alias("difficulty_rank"),
        l("_beatmapFilename", "").alias("filename"), l("_noteJumpMovementSpeed", 16.0).alias("note_jump_speed"),
        l("_noteJumpStartBeatOffset", 0.0).alias("note_jump_offset"), F.col("l._customData").alias("mods"),
    )


def info_mods(info: DataFrame) -> DataFrame:
    """Requirement and suggestion lists of the document top and of every level."""
    none = F.array().cast("array<string>")
    top = info.select("map_id", "mods")
    rows = top.unionByName(info_levels(info).select("map_id", "mods"))
    return rows.select("map_id", F.coalesce("mods._requirements", none).alias("requirements"), F.coalesce("mods._suggestions", none).alias("suggestions"))


# ---- level documents -------------------------------------------------------
EVENT_FIELDS = [
    ("beat", "double"), ("x", "int"), ("y", "int"), ("color", "int"), ("direction", "int"), ("angle_offset", "int"), ("duration", "double"),
    ("width", "int"), ("height", "int"), ("mu", "double"), ("tail_beat", "double"), ("tail_x", "int"), ("tail_y", "int"), ("tail_direction", "int"),
    ("tail_mu", "double"), ("mid_anchor", "int"), ("slice_count", "int"), ("squish", "double"), ("event_type", "int"), ("value", "int"),
    ("float_value", "double"), ("boost", "boolean"),
]
# fixed values: wire array per kind, then (wire key, default) per field
V3_ARRAYS = {
    "note": ("colorNotes", {"beat": ("b", 0), "x": ("x", 0), "y": ("y", 0), "color": ("c", 0), "direction": ("d", 0), "angle_offset": ("a", 0)}),
    "bomb": ("bombNotes", {"beat": ("b", 0), "x": ("x", 0), "y": ("y", 0)}),
    "wall": ("obstacles", {"beat": ("b", 0), "duration": ("d", 0), "x": ("x", 0), "y": ("y", 0), "width": ("w", 1), "height": ("h", 1)}),
    "arc": ("sliders", {"color": ("c", 0), "beat": ("b", 0), "x": ("x", 0), "y": ("y", 0), "direction": ("d", 0), "mu": ("mu", 1), "tail_beat": ("tb", 0), "tail_x": ("tx", 0),
                        "tail_y": ("ty", 0), "tail_direction": ("tc", 0), "tail_mu": ("tmu", 1), "mid_anchor": ("m", 0)}),
    "chain": ("burstSliders", {"color": ("c", 0), "beat": ("b", 0), "x": ("x", 0), "y": ("y", 0), "direction": ("d", 0), "tail_beat": ("tb", 0), "tail_x": ("tx", 0), "tail_y": ("ty", 0),
                               "slice_count": ("sc", 3), "squish": ("s", 0.5)}),
    "light": ("basicBeatmapEvents", {"beat": ("b", 0), "event_type": ("et", 0), "value": ("i", 0), "float_value": ("f", 1)}),
    "boost": ("colorBoostBeatmapEvents", {"beat": ("b", 0), "boost": ("o", 0)}),
}
V2_ARRAYS = {
    "v2_note": ("_notes", {"beat": ("_time", 0), "x": ("_lineIndex", 0), "y": ("_lineLayer", 0), "color": ("_type", 0), "direction": ("_cutDirection", 0)}),
    "v2_wall": ("_obstacles", {"beat": ("_time", 0), "x": ("_lineIndex", 0), "color": ("_type", 0), "duration": ("_duration", 0), "width": ("_width", 1)}),
    "v2_light": ("_events", {"beat": ("_time", 0), "event_type": ("_type", 0), "value": ("_value", 0), "float_value": ("_floatValue", 1)}),
}
_ARRAYS = {**V3_ARRAYS, **V2_ARRAYS}
# one element type for all arrays, every leaf as text: quoted and bare numbers both read
_KEYS = sorted({key for _, spec in _ARRAYS.values() for key, _ in spec.values()} | {"_customData", "_BPM"})
_ELEMENT = "struct<" + ",".join(f"{k}:string" for k in _KEYS) + ">"
DOC_SCHEMA = "struct<_corrupt:string,version:string,_version:string,_customData:string," + ",".join(f"{a}:array<{_ELEMENT}>" for a, _ in _ARRAYS.values()) + ">"
_MAP_SCHEMA = "struct<" + ",".join(f"{a}:array<map<string,string>>" for a, _ in _ARRAYS.values()) + ">"
_TEMPO_SCHEMA = f"struct<_BPMChanges:array<{_ELEMENT}>>"
#: kind of the rows that hold tempo changes: their beat, and the new tempo as float_value
TEMPO = "tempo"


def generation() -> Column:
    """v3 / v2 by the version keys of a parsed document ``d``; null means refused."""
    v, u = F.coalesce("d.version", F.lit("")), F.coalesce("d._version", F.lit(""))
    return F.when((v != "") & ~v.startswith("2"), "v3").when(u != "", "v2")


def _has_null(keys: Column):
    return lambda e: F.size(F.array_intersect(F.map_keys(F.map_filter(e, lambda k, v: v.isNull())), keys)) > 0


def _explicit_null() -> Column:
    """Whether a read key is present with JSON null (a missing key is fine).

    Only documents whose text holds a null at all are looked at again, as maps.
    """
    m = F.from_json("text", _MAP_SCHEMA)
    hit = F.lit(False)
    for array, spec in _ARRAYS.values():
        keys = F.array(*[F.lit(k) for k, _ in spec.values()])
        hit = hit | F.coalesce(F.exists(m.getField(array), _has_null(keys)), F.lit(False))
    return F.when(F.col("text").rlike(r":\s*null"), hit).otherwise(False)


def parse_levels(docs: DataFrame, stored: bool = True) -> DataFrame:
    """Level documents (``map_id, difficulty, text``) to flat rows, one pass over the text.

    Every event and every tempo change is one row; a document without any keeps one row with
    null ``kind``. ``reject`` tells why a document or event is refused. ``level_events``,
    ``tempo_changes`` and ``rejects`` split the rows; as a bad value drops its whole map, they
    read them twice, so the rows are stored in the shared folder unless told otherwise.
    """
    d = docs.withColumn("d", F.from_json("text", DOC_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt"}))
    gen = generation()
    empty = F.array().cast(f"array<struct<kind:string,seq:int,e:{_ELEMENT}>>")

    def tag(kind):
        return lambda e, i: F.struct(F.lit(kind).alias("kind"), i.alias("seq"), e.alias("e"))

    def tagged(arrays):
        return F.concat(*[F.coalesce(F.transform(F.col(f"d.{a}"), tag(k)), empty) for k, (a, _) in arrays.items()])

    reject = F.when(F.col("d").isNull() | F.col("d._corrupt").isNotNull(), "unreadable").when(gen.isNull(), "no_version").when(_explicit_null(), "bad_value")
    tempo = F.coalesce(F.transform(F.from_json("d._customData", _TEMPO_SCHEMA)["_BPMChanges"], tag(TEMPO)), empty)
    raw = F.when(gen == "v3", tagged(V3_ARRAYS)).when(gen == "v2", F.concat(tagged(V2_ARRAYS), tempo)).otherwise(empty)
    r = d.select("map_id", "difficulty", gen.alias("generation"), reject.alias("doc_reject"), raw.alias("raw"))
    r = r.select("map_id", "difficulty", "generation", "doc_reject", F.inline_outer("raw"))

    kind = F.col("kind")
    values, bad = {}, F.lit(False)
    for name, typ in EVENT_FIELDS:
        per_kind = [(k, spec[name]) for k, (_, spec) in _ARRAYS.items() if name in spec]
        value = None
        for key, default in sorted({v for _, v in per_kind}, key=str):
            kinds = [k for k, v in per_kind if v == (key, default)]
            leaf = F.col(f"e.{key}")
            mine = kind.isin(*kinds)
            num = leaf.isin("true", "1") if typ == "boolean" else leaf.try_cast("double")
            if typ != "boolean":
                bad = bad | (mine & leaf.isNotNull() & num.isNull())
            got = F.coalesce(num, F.lit(False) if typ == "boolean" else F.lit(float(default)))
            value = F.when(mine, got) if value is None else value.when(mine, got)
        values[name] = value.cast(typ).alias(name)
    for name, key in (("beat", "_time"), ("float_value", "_BPM")):  # what is no number here is no change, and harms nothing
        values[name] = F.when(kind == TEMPO, F.col(f"e.{key}").try_cast("double")).otherwise(values[name]).alias(name)
    fake = F.lower(F.coalesce(F.get_json_object("e._customData", "$._fake"), F.lit("false")))
    r = r.select(
        "map_id", "difficulty", "generation", kind, F.col("seq").cast("long").alias("seq"),
        F.coalesce("doc_reject", F.when(F.coalesce(bad, F.lit(False)), "bad_value")).alias("reject"), fake.alias("fake"), *values.values(),
    )
    rows = _older_generation(r)
    return cut(rows) if stored else rows


def _older_generation(r: DataFrame) -> DataFrame:
    """Older events on the newer model: bombs split off, fakes and unknown types dropped, cells clamped."""
    c = F.col
    note, wall = c("kind") == "v2_note", c("kind") == "v2_wall"
    crouch = c("color") == 1
    typ = c("color")
    keep = ~note | (c("fake").isin("false", "0", "null", "") & typ.isin(0, 1, 3)) | c("reject").isNotNull()
    bomb = note & (typ == 3)

    def clamp(col, lo, hi):
        return F.greatest(F.lit(lo), F.least(F.lit(hi), col))

    return r.where(c("kind").isNull() | keep).select(
        "map_id", "difficulty", "generation", "reject",
        F.when(bomb, "bomb").when(note, "note").when(wall, "wall").when(c("kind") == "v2_light", "light").otherwise(c("kind")).alias("kind"),
        "seq", "beat", F.when(note | wall, clamp(c("x"), 0, 3)).otherwise(c("x")).alias("x"),
        F.when(note, clamp(c("y"), 0, 2)).when(wall, F.when(crouch, 2).otherwise(0)).otherwise(c("y")).alias("y"),
        F.when(~(bomb | wall), c("color")).alias("color"), F.when(~bomb, c("direction")).alias("direction"),
        F.when(note & ~bomb, F.lit(0)).otherwise(c("angle_offset")).alias("angle_offset"), "duration",
        F.when(wall, clamp(c("width"), 1, 4)).otherwise(c("width")).alias("width"),
        F.when(wall, F.when(crouch, 3).otherwise(5)).otherwise(c("height")).alias("height"), *[n for n, _ in EVENT_FIELDS[9:]],
    )


def dead_maps(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reject").isin("unreadable", "bad_value")).select("map_id").distinct()


def level_events(parsed: DataFrame, dead: DataFrame | None = None) -> DataFrame:
    """Event rows. A bad value or unreadable text drops the whole map, a missing version one level.

    ``dead`` are the maps to drop, where the caller has stored them.
    """
    dead = dead_maps(parsed) if dead is None else dead
    return parsed.where(f"reject is null and kind is not null and kind <> '{TEMPO}'").join(dead, "map_id", "left_anti").drop("reject", "generation")


def rejects(parsed: DataFrame) -> DataFrame:
    return parsed.where("reject is not null").groupBy("map_id", "difficulty").agg(F.max("reject").alias("reject"))


def tempo_changes(parsed: DataFrame, dead: DataFrame | None = None) -> DataFrame:
    """Tempo changes of older documents that are read at all, in document order.

    A document of another or no generation has none, nor has any of a map that
    ``level_events`` drops.
    """
    t = parsed.where(f"reject is null and kind = '{TEMPO}'").join(dead_maps(parsed) if dead is None else dead, "map_id", "left_anti")
    return t.select("map_id", "difficulty", "seq", F.col("beat").alias("at_beat"), F.col("float_value").alias("new_bpm"))
