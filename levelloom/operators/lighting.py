"""Section classification, section-based light shows, and colouring of light events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from levelloom import constants as K
from levelloom.functions.scalars import clamp, hue_shifted, lookup, palette_color
from levelloom.operators.series import min_max, same_convolution
from levelloom.plans.ordered import Track, islands, position, scan
from levelloom.session import cut

BEATS = Track(("map_id",), ("b",), "floor(b / 256)")


def beat_energy(frames: DataFrame, maps: DataFrame, fps: float) -> DataFrame:
    """Smoothed, normalised loudness and bass at every beat, with the beat's raw frame."""
    m = maps.select("map_id", "bpm")
    fpb = 60.0 / F.greatest(F.col("bpm"), F.lit(1.0)) * fps
    f = frames.select("map_id", "frame", "rms", "bass").join(m, "map_id").withColumn("_fpb", fpb)
    width = F.greatest(F.lit(1), F.floor(F.col("_fpb") * 4))
    f = cut(same_convolution(f, "rms", width, "e_rms"))
    f = cut(same_convolution(f, "bass", width, "e_bass"))
    f = min_max(min_max(f.drop("rms", "bass"), "e_rms", "e_rms"), "e_bass", "e_bass")
    size = frames.groupBy("map_id").agg(F.count("*").alias("n")).join(m, "map_id").withColumn("_fpb", fpb)
    beats = size.withColumn("n_beats", F.floor(F.col("n") / F.greatest(F.col("_fpb"), F.lit(1.0))) + 1)
    beats = beats.select("map_id", "n", "n_beats", "_fpb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_beats") - 1)).alias("b"))
    beats = beats.withColumn("raw", F.floor(F.col("b") * F.col("_fpb"))).withColumn("frame", F.least(F.col("raw"), F.col("n") - 1).cast("int"))
    return beats.join(f.select("map_id", "frame", "e_rms", "e_bass"), ["map_id", "frame"]).drop("_fpb", "frame")


def beat_sections(energy: DataFrame, fps: float) -> DataFrame:
    """Section label of every beat.

    A breakdown needs a drop on the beat right before it, so it never follows itself and
    the label needs no recursion.
    """
    e = cut(energy)
    before = e.select("map_id", (F.col("b") + 4).alias("b"), F.col("e_rms").alias("e4"))
    e = e.join(before, ["map_id", "b"], "left")
    edge = int(15.0 * fps)
    r = F.col("e_rms")
    mid = (r > 0.4) & (r < 0.7) & (F.col("b") >= 4)
    base = (
        F.when(F.col("raw") < edge, "intro").when(F.col("raw") > F.col("n") - edge, "outro")
        .when((r > 0.65) & (F.col("e_bass") > 0.5), "drop").when(mid & (r > F.col("e4") + 0.1), "buildup").otherwise("calm")
    )
    e = cut(e.withColumn("base", base).withColumn("_low", (base == "calm") & ~mid & (r < 0.4)))
    e = scan(e, BEATS, prev={"_was": "base"})
    label = F.when(F.col("_low") & (F.col("_was") == "drop"), "breakdown").otherwise(F.col("base"))
    return e.select("map_id", "b", "n_beats", label.alias("section_type"))


def merge_short(sections: DataFrame, min_beats: float = 4.0) -> DataFrame:
    """Merge sections shorter than ``min_beats`` into the one before (the first stays)."""
    s = sections.withColumn("_long", (F.col("end_beat") - F.col("start_beat") >= min_beats) | (F.col("start_beat") == 0))
    s = islands(s, Track(("map_id",), ("start_beat",), "floor(start_beat / 1024)"), F.col("_long"), "_g")
    g = s.groupBy("map_id", "_g").agg(
        F.min("start_beat").alias("start_beat"), F.max("end_beat").alias("end_beat"), F.min_by("section_type", "start_beat").alias("section_type")
    )
    return g.drop("_g")


def classify_sections(frames: DataFrame, maps: DataFrame, fps: float = K.SAMPLE_RATE / K.HOP_LENGTH) -> DataFrame:
    """Half-open beat ranges with their section type."""
    b = cut(beat_sections(beat_energy(frames, maps, fps), fps))
    b = scan(b, BEATS, prev={"_was": "section_type"})
    b = islands(cut(b), BEATS, F.col("_was").isNull() | (F.col("_was") != F.col("section_type")), "_run")
    s = b.groupBy("map_id", "_run").agg(
        F.min("b").cast("double").alias("start_beat"), (F.max("b") + 1).cast("double").alias("end_beat"), F.min("section_type").alias("section_type")
    ).drop("_run")
    return merge_short(cut(s))


def _steps(start: Column, end: Column) -> Column:
    """Event offsets inside a section.

    Constant steps, except in a build-up: there the step shrinks linearly with the
    position, which sums to a geometric approach with ratio ``r``.
    """
    kind, length = F.col("section_type"), end - start
    step = 1.0 / lookup({k: float(v) for k, v in K.SECTION_DENSITY.items()}, kind, 0.5)
    d = F.greatest(length, F.lit(1.0))
    r = 1.0 - step / (2.0 * d)
    n_geo = F.ceil(F.log(1.0 - length / (2.0 * d)) / F.log(r))
    n = F.when(kind == "buildup", n_geo).otherwise(F.ceil(length / step)).cast("int")
    idx = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    return F.transform(idx, lambda i: F.struct(i.alias("i"), F.when(kind == "buildup", 2.0 * d * (1.0 - F.pow(r, i))).otherwise(i * step).alias("at")))


def section_lights(sections: DataFrame) -> DataFrame:
    """Light events of every section from its template; ``kind`` is light or boost."""
    s = sections.where("end_beat > start_beat")
    start, end = F.col("start_beat"), F.col("end_beat")
    e = s.select("*", F.inline(_steps(start, end)))
    kind, i = F.col("section_type"), F.col("i")
    even = i % 2 == 0
    share = F.col("at") / F.greatest(end - start, F.lit(1.0))
    group = F.get(F.array(*[F.lit(g) for g in K.LIGHT_GROUPS]), (i % len(K.LIGHT_GROUPS)).cast("int"))

    def ev(typ, value, bright):
        as_col = lambda v, t: (v if isinstance(v, Column) else F.lit(v)).cast(t)
        return F.struct(as_col(typ, "int").alias("event_type"), as_col(value, "int").alias("value"), as_col(bright, "double").alias("float_value"))

    def pick(a, b):
        return F.when(even, a).otherwise(b)

    ring = ev(K.RING_ROTATION, 1, 1.0)
    slow = i % 4 < 2
    drop = [ev(g, pick(K.FLASH_RED if j % 2 == 0 else K.FLASH_BLUE, K.ON_BLUE if j % 2 == 0 else K.ON_RED), 1.0) for j, g in enumerate(K.LIGHT_GROUPS)]
    zoom = F.when(even, ev(K.RING_ZOOM, 1, 1.0))
    some = lambda *c: F.filter(F.array(*c), lambda v: v.isNotNull())
    show = (
        F.when(kind == "intro", F.array(ev(group, pick(K.FADE_RED, K.FADE_BLUE), 0.5)))
        .when(kind == "calm", F.array(ev(group, F.when(slow, K.ON_BLUE).otherwise(K.FADE_RED), F.when(slow, 0.6).otherwise(0.4))))
        .when(kind == "buildup", some(ev(group, pick(K.FLASH_RED, K.FLASH_BLUE), F.least(F.lit(1.0), 0.5 + share * 0.5)), F.when(i % 4 == 0, ring)))
        .when(kind == "drop", some(*drop, ring, zoom))
        .when(kind == "breakdown", F.array(ev(group, pick(K.FADE_BLUE, K.FADE_RED), F.greatest(F.lit(0.2), 1.0 - share * 0.8))))
        .otherwise(F.array(ev(group, K.FADE_BLUE, F.greatest(F.lit(0.1), 0.5 * (1.0 - share)))))
    )
    lights = e.select("map_id", F.lit("light").alias("kind"), F.round(start + F.col("at"), 4).alias("beat"), F.inline(show))
    boosts = s.select("map_id", F.lit("boost").alias("kind"), F.round(start, 4).alias("beat"), kind.isin("drop", "buildup").alias("boost"))
    return lights.unionByName(boosts, allowMissingColumns=True)


def light_show(frames: DataFrame, maps: DataFrame, fps: float = K.SAMPLE_RATE / K.HOP_LENGTH) -> DataFrame:
    """Rule-based lights of whole maps from their energy series."""
    return section_lights(classify_sections(frames, maps, fps))


def with_lights(events: DataFrame, lights: DataFrame) -> DataFrame:
    """Events of all levels with their map's generated lights as rows of their own.

    Every difficulty of a map gets the map's lights, numbered in time order per kind.
    """
    levels = events.select("map_id", "difficulty").distinct()
    made = position(lights, Track(("map_id", "kind"), ("beat", "event_type"), "floor(beat / 32)"), "seq").withColumn("seq", F.col("seq") - 1)
    # both sides grow with the maps; their shuffled bytes say little about their size in memory
    return events.unionByName(made.join(levels.hint("merge"), "map_id"), allowMissingColumns=True)


def palette_names(frames: DataFrame, genres: DataFrame) -> DataFrame:
    """Palette per map: genre hints first, then mean loudness and bass.

    Means are rounded: one that lies on a limit must not fall to either side by the order of its sum.
    """
    g = frames.groupBy("map_id").agg(F.round(F.avg("rms"), 12).alias("_r"), F.round(F.avg("bass"), 12).alias("_b"))
    hint = F.lower(F.coalesce("genre", F.lit("unknown")))
    by_genre = None
    for name, words in K.PALETTE_HINTS:
        named = hint.rlike("|".join(words))
        by_genre = F.when(named, name) if by_genre is None else by_genre.when(named, name)
    r, b = F.col("_r"), F.col("_b")
    by_energy = (
        F.when(r.isNull(), "synthwave").when((r > 0.5) & (b > 0.5), "edm").when(r < 0.2, "ambient").when(b > 0.4, "rock").when(r < 0.35, "chill").otherwise("synthwave")
    )
    return genres.join(g, "map_id", "left").select("map_id", F.coalesce(by_genre, by_energy).alias("palette"))


def color_lights(lights: DataFrame, frames: DataFrame, maps: DataFrame, palettes: DataFrame, *, fps: float = K.SAMPLE_RATE / K.HOP_LENGTH) -> DataFrame:
    """RGBA per light from the energy at its (clamped) frame; maps without frames get mid energy."""
    n = frames.groupBy("map_id").agg(F.count("*").alias("_n"))
    l = lights.join(maps.select("map_id", "bpm"), "map_id").join(palettes, "map_id").join(n, "map_id", "left")
    at = F.rint(F.col("beat") * 60.0 / F.greatest(F.col("bpm"), F.lit(1.0)) * fps)
    l = l.withColumn("_frame", clamp(at, F.lit(0), F.col("_n") - 1).cast("int"))
    f = frames.select("map_id", F.col("frame").alias("_frame"), F.col("rms").alias("_e"), F.col("onset_strength").alias("_o"))
    l = l.join(f, ["map_id", "_frame"], "left")
    tinted = hue_shifted(palette_color("palette", "_e"), "event_type")
    known = F.col("_n").isNotNull()
    rgb = F.when(known, tinted).otherwise(palette_color("palette", F.lit(0.5)))
    alpha = F.when(known, clamp(0.5 + F.col("_o") * 0.5, 0.3, 1.0)).otherwise(1.0)
    rgba = F.transform(F.concat(rgb, F.array(alpha)), lambda v: F.round(v, 4))
    return l.select(*lights.columns, "palette", rgba.alias("rgba"))
