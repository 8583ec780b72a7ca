"""Training samples: windows, contexts, history, nearest onsets, subsampling, whole preprocessing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from levelloom.constants import CONTEXT_FRAME_RATE, FIRST_ONSET_GAP
from levelloom.functions.scalars import difficulty_id, hash_order, pad_tokens
from levelloom.operators.parity import K_COLS
from levelloom.operators.tokens import encode_levels, encode_lights, mirrored
from levelloom.operators.timing import beat_frames, in_range
from levelloom.plans.ordered import NOTES, Track, asof, position, scan, with_halo
from levelloom.plans.selecting import smallest
from levelloom.session import cut

ONSETS = Track(NOTES.keys, ("frame", "beat"), "floor(frame / 1024)")


def training_windows(n: Column, w: int, hop: int, dedupe_tail: bool = False) -> Column:
    """Window starts of a series; the tail window follows and may repeat the last one."""
    body = F.when(n >= w, F.sequence(F.lit(0), n - w, F.lit(hop))).otherwise(F.array().cast("array<int>"))
    after = (F.floor((n - w) / hop) + 1) * hop
    tail = F.when((n > w) & (after < n), F.array(n - w)).otherwise(F.array().cast("array<int>"))
    starts = F.concat(body, tail)
    return F.array_distinct(starts) if dedupe_tail else starts


def covering_starts(frame: Column, n: Column, w: int, hop: int) -> Column:
    """Distinct starts among a series' windows that cover ``frame``."""
    lo = F.greatest(F.lit(0), F.ceil((frame - w + 1) / hop).cast("int") * hop)
    hi = F.least(F.floor(frame / hop).cast("int") * hop, F.floor((n - w) / hop).cast("int") * hop)
    none = F.array().cast("array<int>")
    body = F.when((n >= w) & (hi >= lo), F.sequence(lo, hi, F.lit(hop))).otherwise(none)
    tail = F.when((n > w) & (frame >= n - w), F.array(n - w)).otherwise(none)
    return F.array_distinct(F.concat(body, tail))


def window_onsets(onsets: DataFrame, n_frames: DataFrame, w: int, hop: int, cap: int = 256) -> DataFrame:
    """Onsets of every window relative to its start; a window keeps its first ``cap``."""
    o = onsets.select(*K_COLS, "frame").join(n_frames.select("map_id", "n_frames"), "map_id")
    o = o.select(*K_COLS, "frame", F.explode(covering_starts(F.col("frame"), F.col("n_frames"), w, hop)).alias("start"))
    # a window is at most ``w`` frames wide; repeated onsets on a frame are counted, then spread again
    g = o.groupBy(*K_COLS, "start", (F.col("frame") - F.col("start")).alias("at")).agg(F.least(F.count("*"), F.lit(cap)).cast("int").alias("n"))
    g = g.groupBy(*K_COLS, "start").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("a"))
    return g.select(*K_COLS, "start", F.slice(F.flatten(F.transform("a", lambda e: F.array_repeat(e.at, e.n))), 1, cap).alias("onsets"))


def window_series(frames: DataFrame, n_frames: DataFrame, w: int, hop: int, values) -> DataFrame:
    """Frame values of every window as ordered arrays (one per column), ``w`` entries at most."""
    f = frames.select("map_id", "frame", *values).join(n_frames.select("map_id", "n_frames"), "map_id")
    f = f.select("*", F.explode(covering_starts(F.col("frame"), F.col("n_frames"), w, hop)).alias("start"))
    g = f.repartition("map_id", "start").groupBy("map_id", "start").agg(F.sort_array(F.collect_list(F.struct("frame", *values))).alias("s"))
    return g.select("map_id", "start", *[F.transform("s", _field(v)).alias(v) for v in values])


def _field(name):
    return lambda e: e[name]


def onset_windows(levels: DataFrame, onsets: DataFrame, frames: DataFrame, n_frames: DataFrame, w: int = 1024, hop: int = 512, values=("rms",)) -> DataFrame:
    """Onset training samples: a row per window with its onsets and frame features.

    ``levels`` lists the (map, difficulty) pairs that survive the sidecar filters.
    """
    s = levels.select(*K_COLS).join(n_frames.select("map_id", "n_frames"), "map_id")
    s = s.select(*K_COLS, F.posexplode(training_windows(F.col("n_frames"), w, hop)).alias("window", "start"))
    s = s.join(window_onsets(onsets, n_frames, w, hop), [*K_COLS, "start"], "left").join(window_series(frames, n_frames, w, hop, values), ["map_id", "start"], "left")
    real = F.coalesce("onsets", F.array().cast("array<int>"))
    return s.select(*K_COLS, "window", "start", difficulty_id("difficulty").alias("difficulty_id"), F.size(real).alias("n_onsets"), real.alias("onsets"), *values)


def context_window(frame: Column, n: Column, width: int) -> tuple[Column, Column]:
    """Start and end of a window centred on ``frame``, shifted to stay inside the map."""
    start = F.greatest(F.lit(0), frame - width // 2)
    end = start + width
    over = end > n
    return F.when(over, F.greatest(F.lit(0), n - width)).otherwise(start), F.when(over, n).otherwise(end)


def with_context(samples: DataFrame, frames: DataFrame, values=("rms",), width: int = 128) -> DataFrame:
    """Add the frame rows of each sample's context, one array per value, padded right with zeros.

    Frames are gathered in blocks of ``width``, so a context lies in two blocks at most and
    every sample meets two rows, however long the map.
    """
    entry = F.struct("frame", *values)
    blocks = frames.groupBy("map_id", F.floor(F.col("frame") / width).alias("_b")).agg(F.sort_array(F.collect_list(entry)).alias("_rows"))
    s = samples.withColumn("_b", F.floor(F.col("ctx_start") / width))
    for name, step in (("_first", 0), ("_second", 1)):
        part = blocks.select("map_id", (F.col("_b") - step).alias("_b"), F.col("_rows").alias(name))
        s = s.join(part, ["map_id", "_b"], "left")
    none = F.array().cast(blocks.schema["_rows"].dataType)
    rows = F.concat(F.coalesce("_first", none), F.coalesce("_second", none))
    s = s.withColumn("_rows", F.filter(rows, lambda r: (r["frame"] >= F.col("ctx_start")) & (r["frame"] < F.col("ctx_end"))))
    pad = F.array_repeat(F.lit(0.0), F.lit(width) - F.size("_rows"))
    return s.select(*samples.columns, *[F.concat(F.transform("_rows", _field(v)), pad).alias(f"context_{v}") for v in values])


def previous_rows(df: DataFrame, keys, order, value: str, k: int, *, slice: str, out: str = "history", block: int = 256, pos: str | None = None) -> DataFrame:
    """Array of the ``k`` values before each row, oldest first (shorter at the start).

    Rows are numbered (or carry ``pos`` already), cut into blocks, and each block also receives the last ``k`` rows
    of the block before, so a window inside the block sees all it needs.
    """
    d = df if pos else cut(position(df, Track(tuple(keys), tuple(order), slice), "_pos"))
    at = pos or "_pos"
    d = with_halo(d, keys, at, before=k, block=max(block, k))
    w = W.partitionBy(*keys, "_block").orderBy(at).rowsBetween(-k, -1)
    return d.select(*df.columns, "_copy", F.collect_list(value).over(w).alias(out)).where("not _copy").drop("_copy")


def time_gaps(onsets: DataFrame, pos: str | None = None) -> DataFrame:
    """Seconds since the onset before, at the rounded frame rate; a large value for the first.

    ``pos`` also numbers the onsets, in the same scan.
    """
    o = scan(onsets, ONSETS, prev={"_pf": "frame"}, sums={pos: F.lit(1).cast("long")} if pos else None)
    return o.withColumn("time_gap", F.coalesce((F.col("frame") - F.col("_pf")) / CONTEXT_FRAME_RATE, F.lit(FIRST_ONSET_GAP))).drop("_pf")


def sequence_samples(onsets: DataFrame, n_frames: DataFrame, *, context: int = 128, max_len: int = 64, prev_k: int = 8, mirror_epoch: int | None = None) -> DataFrame:
    """Token samples with context bounds, padded tokens, padded history and time gap.

    With ``mirror_epoch`` half of the samples (by hash of key and epoch) are mirrored,
    history included.
    """
    # every array is mirrored and padded once, before neighbours pick it up
    forms = {"plain": pad_tokens("tokens", max_len), **({"mirror": pad_tokens(mirrored("tokens"), max_len)} if mirror_epoch is not None else {})}
    length = F.least(F.size("tokens"), F.lit(max_len)).alias("token_length")
    o = cut(onsets.select(*K_COLS, "frame", "beat", length, F.struct(*[c.alias(n) for n, c in forms.items()]).alias("form")))
    o = cut(time_gaps(o, pos="_pos"))
    o = previous_rows(o, K_COLS, ("frame", "beat"), "form", prev_k, slice=ONSETS.slice, pos="_pos")
    coin = F.lit(False) if mirror_epoch is None else F.pmod(F.xxhash64(*K_COLS, "frame", "beat", F.lit(mirror_epoch)), F.lit(2)) == 1

    def chosen(s):
        return s.plain if mirror_epoch is None else F.when(coin, s.mirror).otherwise(s.plain)

    start, end = context_window(F.col("frame"), F.col("n_frames"), context)
    blank = F.array_repeat(F.lit(0), max_len)
    hist = F.concat(F.array_repeat(blank, F.lit(prev_k) - F.size("history")), F.transform("history", chosen))
    return o.join(n_frames.select("map_id", "n_frames"), "map_id").select(
        *K_COLS, "frame", "beat", start.alias("ctx_start"), end.alias("ctx_end"), chosen(F.col("form")).alias("tokens"),
        "token_length", difficulty_id("difficulty").alias("difficulty_id"), hist.alias("prev_tokens"), "time_gap",
    )


def lighting_samples(lights: DataFrame, onsets: DataFrame, n_frames: DataFrame, *, context: int = 128, max_light: int = 32, max_note: int = 64) -> DataFrame:
    """Lighting samples: each lit frame with the tokens of the nearest onset of its level."""
    l, r = cut(lights.withColumnRenamed("tokens", "light_tokens")), cut(onsets)
    # frames alone go through the search; tokens join by the frame it finds
    near = asof(l.select(*K_COLS, "frame").distinct(), r.select(*K_COLS, "frame"), K_COLS, "frame", [], slice="floor(frame / 1024)", direction="nearest")
    tokens = r.groupBy(*K_COLS, F.col("frame").alias("match_frame")).agg(F.min_by("tokens", "beat").alias("note_tokens"))
    j = l.join(near.join(tokens, [*K_COLS, "match_frame"], "left"), [*K_COLS, "frame"])
    start, end = context_window(F.col("frame"), F.col("n_frames"), context)
    none = F.array().cast("array<int>")
    return j.join(n_frames.select("map_id", "n_frames"), "map_id").select(
        *K_COLS, "frame", "beat", start.alias("ctx_start"), end.alias("ctx_end"), F.col("match_frame").alias("onset_frame"),
        pad_tokens(F.coalesce("note_tokens", none), max_note).alias("note_tokens"), pad_tokens("light_tokens", max_light).alias("light_tokens"),
    )


def song_samples(onsets: DataFrame, part: int = 1024) -> DataFrame:
    """Level-long samples in order, cut into parts of ``part`` onsets so no row grows without bound."""
    o = position(cut(onsets), ONSETS)
    p = F.floor((F.col("pos") - 1) / part).alias("part")
    g = o.groupBy(*K_COLS, p).agg(F.sort_array(F.collect_list(F.struct("pos", "frame", "tokens"))).alias("s"))
    return g.select(*K_COLS, "part", F.transform("s", lambda e: e.frame).alias("frames"), F.transform("s", lambda e: e.tokens).alias("token_sequences"))


def epoch_sample(df: DataFrame, keys, n: int, epoch: int) -> DataFrame:
    """Exactly ``n`` rows (or all) chosen by hash of key and epoch, without replacement.

    The hash is the first 60 bits of an MD5, so other engines can draw the same rows. Rows
    are counted by ranges of it; only those of the range in which the cut lies are ordered.
    """
    d = df.withColumn("_h", hash_order(*keys, F.lit(epoch)))
    return smallest(d, [], "_h", n, keys).drop("_h")


def structured_notes(preds: DataFrame, keys) -> DataFrame:
    """Notes from slot predictions: best class per head, idle slots and repeated cells dropped.

    Each head (color, col, row, direction, angle) is an array of score arrays, one per slot.
    """
    heads = ("color", "col", "row", "direction", "angle")
    s = preds.select(*keys, F.posexplode(F.arrays_zip(*heads)).alias("slot", "p"))

    def best(h):
        p = F.col(f"p.{h}")
        return (F.array_position(p, F.array_max(p)) - 1).cast("int")

    s = s.select(*keys, "slot", best("col").alias("x"), best("row").alias("y"), best("color").alias("color"), best("direction").alias("direction"),
                 ((best("angle") - 3) * 15).alias("angle_offset")).where("color < 2")
    row = F.min_by(F.struct("slot", "color", "direction", "angle_offset"), "slot").alias("r")
    return s.groupBy(*keys, "x", "y").agg(row).select(*keys, "x", "y", "r.*")


def pad_channels(df: DataFrame, names=("section_id", "section_progress")) -> DataFrame:
    """Feature rows of the older six-channel layout get the two later channels as zero."""
    cols = [F.coalesce(F.col(n), F.lit(0.0)).alias(n) if n in df.columns else F.lit(0.0).alias(n) for n in names]
    return df.select(*[c for c in df.columns if c not in names], *cols)


def level_onsets(events: DataFrame, maps: DataFrame, changes: DataFrame | None = None, **grid) -> DataFrame:
    """Token arrays with their frame; onsets outside the map's frames are dropped."""
    return in_range(beat_frames(encode_levels(events), maps, changes, **grid), maps).drop("seconds")


def level_lights(lights: DataFrame, maps: DataFrame, changes: DataFrame | None = None, *, boosts: DataFrame | None = None, **grid) -> DataFrame:
    return in_range(beat_frames(encode_lights(lights, boosts, tuple(K_COLS)), maps, changes, **grid), maps).drop("seconds")


def preprocess(events: DataFrame, maps: DataFrame, changes: DataFrame | None = None, **grid) -> dict[str, DataFrame]:
    """All training tables of a parsed corpus: onsets, lights and labels, keyed by level."""
    from levelloom.operators.series import onset_labels

    onsets = cut(level_onsets(events, maps, changes, **grid))  # lights and labels read them too
    alive = onsets.select(*K_COLS).distinct()  # a level without onsets goes with its lights
    lit = events.where("kind = 'light'")
    boosts = events.where("kind = 'boost'")
    return {"onsets": onsets, "lights": level_lights(lit, maps, changes, boosts=boosts, **grid).join(alive, list(K_COLS), "left_semi"), "labels": onset_labels(onsets, maps)}
