"""Per-frame series: smoothing, normalisation, peaks, grid snapping, density, sections."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, functions as F

from levelloom.constants import HOP_LENGTH, ONSET_DENSITY, SAMPLE_RATE, SONG_SECTION_ID
from levelloom.functions.scalars import clamp, lookup, snap_frame
from levelloom.plans.ordered import FRAMES, Fold, Track, islands, scan, stream_folds
from levelloom.session import cut

M = ["map_id"]


def steady(v: Column, digits: int = 9) -> Column:
    """Round with a nudge, so that decimal ties fall alike in any order of summation."""
    return F.round(v + 1e-12, digits)


def moving_sum(frames: DataFrame, value: str, lo: Column, hi: Column, out: str) -> DataFrame:
    """Sum of ``value`` over frames ``lo..hi`` of the same map; both may differ per map.

    One running sum per map, then two key lookups; bounds are clamped to the series.
    Needs the column ``n`` (frames of the map).
    """
    f = cut(scan(frames, FRAMES, sums={"_s": value}))  # read three times
    f = f.withColumn("_hi", F.least(hi, F.col("n") - 1).cast("int")).withColumn("_lo", (F.greatest(lo, F.lit(0)) - 1).cast("int"))
    s = f.select("map_id", F.col("frame").alias("_at"), F.col("_s").alias("_v"))
    up = s.select("map_id", F.col("_at").alias("_hi"), F.col("_v").alias("_up"))
    dn = s.select("map_id", F.col("_at").alias("_lo"), F.col("_v").alias("_dn"))
    f = f.join(up, ["map_id", "_hi"], "left").join(dn, ["map_id", "_lo"], "left")
    return f.select(*frames.columns, (F.col("_up") - F.coalesce("_dn", F.lit(0.0))).alias(out))


def with_length(frames: DataFrame) -> DataFrame:
    """Frames with the frame count of their map."""
    return frames.join(frames.groupBy("map_id").agg(F.count("*").alias("n")), "map_id")


def moving_average(frames: DataFrame, value: str = "rms", kernel: int = 200, out: str = "smooth") -> DataFrame:
    """Centred mean over at most ``kernel`` frames; at the edges only existing frames count."""
    f = with_length(frames)
    k = F.least(F.lit(kernel), F.col("n")).cast("int")
    lo = F.col("frame") - F.floor(k / 2)
    hi = lo + k - 1
    size = F.least(hi, F.col("n") - 1) - F.greatest(lo, F.lit(0)) + 1
    f = moving_sum(f, value, lo, hi, "_sum")
    return f.select(*frames.columns, steady(F.when(k > 1, F.col("_sum") / size).otherwise(F.col(value))).alias(out))


def reflected_mean_energy(frames: DataFrame, value: str = "rms", kernel: int = 200) -> DataFrame:
    """Per map: mean of the min-max-normalised running mean with mirrored edges."""
    f = with_length(frames).select("map_id", "frame", F.col(value).alias("v"), "n")
    half = F.floor(F.least(F.lit(kernel), F.col("n")) / 2).cast("int")
    copies = F.array(
        F.col("frame"), F.when(F.col("frame") < half, -1 - F.col("frame")), F.when(F.col("frame") >= F.col("n") - half, 2 * F.col("n").cast("int") - 1 - F.col("frame"))
    )
    ext = f.select("map_id", "v", "n", half.alias("half"), F.explode(F.filter(copies, lambda c: c.isNotNull())).alias("_f"))
    ext = ext.select("map_id", (F.col("_f") + F.col("half")).cast("int").alias("frame"), "v", F.col("n").alias("real"), (F.col("n") + 2 * F.col("half")).alias("n"), "half")
    k = F.least(F.lit(kernel), F.col("real")).cast("int")
    lo = F.col("frame") - F.floor(k / 2)
    s = moving_sum(ext, "v", lo, lo + k - 1, "_sum")
    s = s.where((F.col("frame") >= F.col("half")) & (F.col("frame") < F.col("half") + F.col("real")))
    s = s.select("map_id", steady(F.col("_sum") / k).alias("v"))
    # the mean of a min-max-normalised series follows from its three aggregates
    g = s.groupBy("map_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("avg"), F.count("*").alias("n"))
    return g.select("map_id", "n", F.when(F.col("hi") > F.col("lo"), (F.col("avg") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.5).alias("mean_energy"))


def same_convolution(frames: DataFrame, value: str, width: Column, out: str) -> DataFrame:
    """Box filter of ``width`` frames in "same" mode: edges still divide by the full width."""
    f = with_length(frames).withColumn("_w", width.cast("int"))
    w = F.col("_w")
    lo = F.col("frame") - (w - 1 - F.floor((w - 1) / 2))
    hi = F.col("frame") + F.floor((w - 1) / 2)
    f = moving_sum(f, value, lo, hi, "_sum")
    return f.select(*frames.columns, steady(F.when(F.col("n") < w, F.col(value)).otherwise(F.col("_sum") / w)).alias(out))


def min_max(df: DataFrame, value: str, out: str) -> DataFrame:
    """Min-max normalisation per map; a constant series becomes one half."""
    g = df.groupBy("map_id").agg(F.min(value).alias("_mn"), F.max(value).alias("_mx"))
    v = F.when(F.col("_mx") > F.col("_mn"), (F.col(value) - F.col("_mn")) / (F.col("_mx") - F.col("_mn"))).otherwise(0.5)
    return df.join(g, "map_id").withColumn(out, v).drop("_mn", "_mx")


def peak_normalised(df: DataFrame, *values: str) -> DataFrame:
    """Each column divided by its maximum in the map plus 1e-8."""
    g = df.groupBy("map_id").agg(*[F.max(v).alias(f"_mx_{v}") for v in values])
    j = df.join(g, "map_id")
    return j.select(*[(F.col(c) / (F.col(f"_mx_{c}") + 1e-8)).alias(c) if c in values else F.col(c) for c in df.columns])


def decibel_share(db) -> Column:
    """Decibels at or below zero to 0-1 over an 80 dB range."""
    return clamp((F.col(db) if isinstance(db, str) else db) / 80.0 + 1.0, 0.0, 1.0)


def band_means(mel: str, n_mels: int = 80) -> list[Column]:
    """Mean of the low quarter, the next three eighths and the rest of a band array."""
    b, m = n_mels // 4, n_mels * 5 // 8

    def mean(lo, n):
        return F.aggregate(F.slice(mel, lo + 1, n), F.lit(0.0), lambda a, v: a + v) / float(n)

    return [mean(0, b).alias("bass"), mean(b, m - b).alias("mid"), mean(m, n_mels - m).alias("high")]


def normalised_centroid(hz: str, sample_rate: int = SAMPLE_RATE) -> Column:
    return F.col(hz) / (sample_rate / 2.0)


# ---- onset series ----------------------------------------------------------
def window_starts(n: Column, w: int, hop: int) -> Column:
    """Window starts that cover a series, the tail once; one window for a short series."""
    body = F.sequence(F.lit(0), F.greatest(n - w, F.lit(0)), F.lit(hop))
    tail = F.greatest(n - w, F.lit(0))
    return F.array_distinct(F.concat(body, F.array(tail)))


def overlap_average(window_probs: DataFrame) -> DataFrame:
    """Mean over overlapping windows: ``(map_id, start, offset, prob)`` to one value per frame."""
    return window_probs.groupBy("map_id", (F.col("start") + F.col("offset")).cast("int").alias("frame")).agg(steady(F.avg("prob")).alias("prob"))


def adaptive_threshold(frames: DataFrame, base: float = 0.25, spread: float = 0.20) -> DataFrame:
    """Per-frame threshold: low where the smoothed energy is high."""
    f = cut(moving_average(frames, "rms", 200, "smooth"))
    return min_max(f, "smooth", "energy").withColumn("threshold", steady(base + (1.0 - F.col("energy")) * spread)).drop("smooth", "energy")


def local_maxima(frames: DataFrame, prob: str = "prob", threshold: float = 0.5) -> DataFrame:
    """Frames at or above the threshold and not below either neighbour."""
    f = scan(frames, FRAMES, prev={"_l": prob}, nxt={"_r": prob})
    low = F.lit(-1.0)
    p = F.col(prob)
    return f.where((p >= threshold) & (p >= F.coalesce("_l", low)) & (p >= F.coalesce("_r", low))).drop("_l", "_r")


def keep_best(peaks: Sequence[tuple[int, float, bool]], reach: int, kept_outside: Sequence[int | None] = ()) -> list[int]:
    """Frames of ``peaks`` (frame, prob, own) that survive, best first, none closer than ``reach`` to another.

    Peaks that are not own lie outside the slice; those listed in ``kept_outside`` are kept, others dropped.
    """
    kept: list[int] = []
    for frame, _, own in sorted(peaks, key=lambda r: (-r[1], r[0])):
        i = bisect_left(kept, frame)
        if own and ((i > 0 and frame - kept[i - 1] < reach) or (i < len(kept) and kept[i] - frame < reach)):
            continue
        if own or frame in kept_outside:
            kept.insert(i, frame)
    own = {f for f, _, o in peaks if o}
    return [f for f in kept if f in own]


class _Slice(Fold):
    """The peaks of one slice and of its two margins, one per frame."""

    def __init__(self, key, reach: int, width: int):
        super().__init__(key)
        self.reach, self.start, self.end_ = reach, key[-1] * width, (key[-1] + 1) * width
        self.probs: dict[int, float] = {}

    def row(self, row):
        frame, prob = row[2], row[3]
        self.probs[frame] = max(prob, self.probs.get(frame, prob))
        return ()

    def peaks(self) -> list[tuple[int, float, bool]]:
        return [(f, p, self.start <= f < self.end_) for f, p in sorted(self.probs.items())]

    def settled(self) -> tuple[int, int]:
        """Number of peaks before the first and up to the last certain survivor inside the slice.

        A peak that no peak within reach beats is kept whatever happens elsewhere, so what
        lies on its two sides is independent.
        """
        ps = self.peaks()
        sure = []
        for i, (f, p, own) in enumerate(ps):
            near = []
            for step in (-1, 1):
                j = i + step
                while 0 <= j < len(ps) and abs(ps[j][0] - f) < self.reach:
                    near.append(ps[j])
                    j += step
            if own and all((-q[1], q[0]) > (-p, f) for q in near):
                sure.append(i)
        return (sure[0], sure[-1]) if sure else (len(ps), -1)


class _SliceTable(_Slice):
    """What leaves the slice at both borders, for every way its neighbours' margins can turn out.

    Kept peaks are ``reach`` apart, so a margin of ``reach - 1`` frames holds one at most:
    a border state is the kept frame in that margin or none.
    """

    def end(self):
        ps = self.peaks()
        first, last = self.settled()
        lefts = [None, *(f for f, _, own in ps if not own and f < self.start)]
        rights = [None, *(f for f, _, own in ps if not own and f >= self.end_)]
        r = self.reach
        left_of = lambda kept: next((f for f in kept if f < self.start + r - 1), None)
        right_of = lambda kept: next((f for f in kept if f >= self.end_ - r + 1), None)
        out = []
        if first > last:
            for a in lefts:
                for b in rights:
                    kept = keep_best(ps, r, (a, b))
                    out.append((a, b, left_of(kept), right_of(kept)))
        else:
            # both sides of a certain survivor are independent: each is tried by itself
            heads = {a: left_of(keep_best(ps[:first + 1], r, (a,))) for a in lefts}
            tails = {b: right_of(keep_best(ps[last:], r, (b,))) for b in rights}
            inner = keep_best(ps[first:last + 1], r)
            wide = [left_of(inner), right_of(inner)]
            out = [(a, b, heads[a] if heads[a] is not None else wide[0], tails[b] if tails[b] is not None else wide[1]) for a in lefts for b in rights]
        yield (*self.key, *[[o[i] for o in out] for i in range(4)])


def _none(values) -> list[int | None]:
    return [None if v is None or v != v else int(v) for v in values]


class _Ahead(Fold):
    """Walk slices forwards: for each way the next slice's margin can turn out, the state this slice leaves there."""

    def __init__(self, key):
        super().__init__(key)
        self.slice, self.leaves = None, {}

    def row(self, row):
        table = {(a, b): (l, r) for a, b, l, r in zip(*map(_none, row[2:]))}
        solved = {}
        for b in {b for _, b in table}:
            if self.slice != row[1] - 1:  # nothing lies before
                solved[b] = (None, *table[None, b])
                continue
            # the one state of the left border that agrees with both sides
            margin, state = next((m, s) for m, s in self.leaves.items() if table[s, b][0] == m)
            solved[b] = (state, *table[state, b])
        self.slice, self.leaves = row[1], {b: right for b, (_, _, right) in solved.items()}
        bs = list(solved)
        yield (*row[:2], bs, [solved[b][0] for b in bs], [solved[b][1] for b in bs])


class _Back(Fold):
    """Walk slices backwards: the states at both borders of every slice."""

    def __init__(self, key):
        super().__init__(key)
        self.slice, self.left = None, None

    def row(self, row):
        right = self.left if self.slice == row[1] + 1 else None
        at = _none(row[2]).index(right)
        outside, self.left, self.slice = _none(row[3])[at], _none(row[4])[at], row[1]
        yield (*row[:2], outside, right)


class _Keep(_Slice):
    outside = (None, None)

    def row(self, row):
        self.outside = tuple(_none(row[4:6]))
        return super().row(row)

    def end(self):
        for f in keep_best(self.peaks(), self.reach, self.outside):
            yield (self.key[0], f)


def suppress_close(peaks: DataFrame, min_distance: int = 5, prob: str = "prob", width: int = 2048) -> DataFrame:
    """Keep peaks by confidence, dropping any closer than ``min_distance`` to a kept one.

    Equal confidences go to the earlier frame; of several peaks on one frame the best counts.
    A map is cut into slices of ``width`` frames with margins. What a slice leaves at its
    borders is tabulated for every state of its neighbours' margins (a margin holds one kept
    peak at most), two walks over these tables settle all borders, and slices are then decided
    on their own. No task holds more than a slice, even where all peaks of a map are close.
    """
    r = max(int(min_distance), 1)
    if width < r:
        raise ValueError("slices must not be narrower than the distance")
    at, i = F.floor(F.col("frame") / width).cast("long"), F.pmod(F.col("frame"), F.lit(width))
    homes = F.array_compact(F.array(at, F.when(i < r - 1, at - 1), F.when(i >= width - r + 1, at + 1)))
    own = peaks.select("map_id", at.alias("slice"), F.col("frame").cast("int").alias("frame"), F.col(prob).cast("double").alias("prob")).where("frame is not null and prob is not null")
    p = cut(own.select("map_id", F.explode(homes).alias("slice"), "frame", "prob"))
    p = p.join(own.select("map_id", "slice").distinct(), ["map_id", "slice"], "left_semi")  # no slice of margins alone
    key = "map_id bigint, slice bigint"
    ints = lambda *names: ", ".join(f"{n} array<int>" for n in names)
    tables = stream_folds(p, ["map_id", "slice"], ["frame"], partial(_SliceTable, reach=r, width=width), f"{key}, {ints('a', 'b', 'l', 'r')}")
    ahead = stream_folds(tables, ["map_id"], ["slice"], _Ahead, f"{key}, {ints('b', 'outside', 'l')}")
    borders = stream_folds(cut(ahead), ["map_id"], ["slice"], _Back, f"{key}, a int, b int", descending=True)
    rows = p.join(borders, ["map_id", "slice"]).select("map_id", "slice", "frame", "prob", "a", "b")
    return stream_folds(rows, ["map_id", "slice"], ["frame"], partial(_Keep, reach=r, width=width), "map_id bigint, frame int")


def snap_to_grid(onsets: DataFrame, maps: DataFrame, subdivision: int = 8, sample_rate=SAMPLE_RATE, hop=HOP_LENGTH) -> DataFrame:
    """Distinct onset frames on the beat grid."""
    j = onsets.join(maps.select("map_id", "bpm"), "map_id")
    return j.select("map_id", snap_frame("frame", "bpm", subdivision, sample_rate, hop).cast("int").alias("frame")).distinct()


def density_curve(onsets: DataFrame, frames: DataFrame, difficulty: str, prob: str = "prob", sample_rate=SAMPLE_RATE, hop=HOP_LENGTH) -> DataFrame:
    """Thin each map's onsets to its energy-scaled density, least confident first."""
    lo, hi = ONSET_DENSITY.get(difficulty, (4.0, 10.0))
    fps = sample_rate / hop
    energy = reflected_mean_energy(frames)
    quota = energy.select("map_id", F.floor((lo + F.round("mean_energy", 9) * (hi - lo)) * (F.col("n") / fps)).cast("long").alias("quota"))
    o = onsets.join(frames.select("map_id", "frame", F.col(prob).alias("conf")), ["map_id", "frame"], "left")
    o = o.withColumn("_doubt", -F.coalesce("conf", F.lit(0.5))).join(quota, "map_id")
    o = scan(o, Track(("map_id",), ("_doubt", "frame"), "floor(_doubt * 256)"), sums={"pos": F.lit(1).cast("long")})
    return o.where(F.col("pos") <= F.col("quota")).select("map_id", "frame")


def predict_onsets(window_probs: DataFrame, frames: DataFrame, maps: DataFrame, difficulty: str, *, adaptive: bool = True, threshold: float = 0.5,
                   base: float = 0.25, spread: float = 0.20, min_distance: int = 5, sample_rate=SAMPLE_RATE, hop=HOP_LENGTH) -> DataFrame:
    """Model window probabilities to final onset frames: average, pick, snap, thin, clamp."""
    avg = cut(overlap_average(window_probs))
    if adaptive:
        t = adaptive_threshold(frames, base, spread).select("map_id", "frame", "threshold")
        a = avg.join(t, ["map_id", "frame"], "left")
        masked = F.when(F.col("prob") > F.coalesce("threshold", F.lit(threshold)), F.col("prob")).otherwise(0.0)
        peaks = local_maxima(a.select("map_id", "frame", masked.alias("prob")), threshold=0.01)
    else:
        peaks = local_maxima(avg, threshold=threshold)
    onsets = snap_to_grid(suppress_close(cut(peaks), min_distance), maps, 8, sample_rate, hop)
    scored = frames.drop("prob").join(avg, ["map_id", "frame"], "left")
    onsets = density_curve(cut(onsets), cut(scored), difficulty, "prob", sample_rate, hop)
    return clamp_frames(onsets, frames)


def clamp_frames(onsets: DataFrame, frames: DataFrame) -> DataFrame:
    """Onset frames clamped into their map, duplicates removed."""
    n = frames.groupBy("map_id").agg((F.max("frame")).alias("last"))
    return onsets.join(n, "map_id").select("map_id", clamp("frame", F.lit(0), F.col("last")).alias("frame")).distinct()


def top_p(probs: DataFrame, keys, p: float = 0.9) -> DataFrame:
    """Nucleus truncation of probability rows: drop once the mass before a row exceeds ``p``."""
    track = Track(tuple(keys), ("_neg", "token"), "floor(_neg * 1024)")
    d = scan(probs.withColumn("_neg", -F.col("prob")), track, sums={"_cum": "prob"})
    d = d.where(~(F.col("_cum") - F.col("prob") > p)).drop("_neg", "_cum")
    total = d.groupBy(*keys).agg(F.sum("prob").alias("_t"))
    return d.join(total, list(keys)).withColumn("prob", F.col("prob") / F.col("_t")).drop("_t")


# ---- labels and song sections ----------------------------------------------
def onset_labels(onsets: DataFrame, n_frames: DataFrame, keys=("map_id", "difficulty"), sigma: float = 3.0) -> DataFrame:
    """Frames within four sigma of an onset with their largest Gaussian; others are zero and not stored.

    The largest is that of the nearest onset, so every onset makes the frames up to half-way to
    its neighbours and none is made twice: onsets are shuffled, frames are not. Blocks of time
    hold copies of the onsets just beyond their borders.
    """
    from pyspark.sql import Window as W

    reach = int(4 * sigma)
    halo = 2 * reach  # onsets farther apart than this share no frame
    block = max(1024, 2 * halo)
    o = onsets.select(*keys, "frame").distinct().join(n_frames.select("map_id", "n_frames"), "map_id").where("frame >= 0 and frame < n_frames")
    b, at = F.floor(F.col("frame") / block), F.col("frame") % block
    homes = F.array(b, F.when(at < halo, b - 1), F.when(at >= block - halo, b + 1))
    o = o.withColumn("_home", b).withColumn("_block", F.explode(F.filter(homes, lambda h: h.isNotNull())))
    along = W.partitionBy(*keys, "_block").orderBy("frame")
    half = lambda other: F.shiftright(F.col("frame") + other, 1)  # noqa: E731  # a frame half-way is the earlier onset's
    first = F.greatest(F.lit(0), F.col("frame") - reach, half(F.lag("frame").over(along)) + 1)
    last = F.least(F.col("n_frames") - 1, F.col("frame") + reach, half(F.lead("frame").over(along)))
    o = o.select(*keys, F.col("frame").alias("_o"), "_home", "_block", first.alias("_first"), last.alias("_last")).where("_home = _block")
    o = o.select(*keys, "_o", F.explode(F.sequence("_first", "_last")).alias("frame"))
    dist = (F.col("frame") - F.col("_o")) / sigma
    return o.select(*keys, "frame", F.exp(-0.5 * dist * dist).alias("label"))


def label_ranges(labels: DataFrame, label: str, order: str = "frame") -> DataFrame:
    """Runs of equal labels as half-open ranges, numbered per map."""
    track = Track(("map_id",), (order,), f"floor({order} / 1024)")
    d = scan(labels, track, prev={"_was": label})
    d = islands(d, track, F.col("_was").isNull() | (F.col("_was") != F.col(label)), "section")
    return d.groupBy("map_id", "section").agg(F.min(label).alias(label), F.min(order).alias("start"), (F.max(order) + 1).alias("end"))


def cluster_energy_rank(frames: DataFrame, cluster: str = "cluster", energy: str = "rms") -> DataFrame:
    """Clusters of a map by mean energy, loudest first (rank 0), with the cluster count."""
    from pyspark.sql import Window as W

    g = frames.groupBy("map_id", cluster).agg(F.round(F.avg(energy), 9).alias("energy"))
    w = W.partitionBy("map_id")  # a handful of clusters per map
    return g.withColumn("rank", F.row_number().over(w.orderBy(F.desc("energy"), cluster)) - 1).withColumn("n_clusters", F.count("*").over(w))


def typed_sections(frames: DataFrame, duration: DataFrame, seconds_per_frame: float, cluster: str = "cluster") -> DataFrame:
    """Song sections from cluster labels: type by energy rank and place, times in seconds."""
    ranges = label_ranges(frames.select("map_id", "frame", cluster), cluster)
    last = ranges.groupBy("map_id").agg(F.max("section").alias("_last"))
    d = ranges.join(last, "map_id").join(duration.select("map_id", "duration"), "map_id").join(cluster_energy_rank(frames, cluster), ["map_id", cluster])
    start = F.col("start") * seconds_per_frame
    end = F.when(F.col("section") == F.col("_last"), F.col("duration")).otherwise(F.col("end") * seconds_per_frame)
    d = d.withColumn("start_sec", start).withColumn("end_sec", end)
    k, r, mid = F.col("n_clusters"), F.col("rank"), (F.col("start_sec") + F.col("end_sec")) / 2 / F.col("duration")
    quiet = r >= F.floor(k / 2)
    kind = (
        F.when((F.col("section") == 1) & quiet, "intro").when((F.col("section") == F.col("_last")) & quiet, "outro")
        .when(r == 0, F.when(mid > 0.3, "drop").otherwise("chorus")).when(r <= F.floor(k / 3), "chorus")
        .when(r >= F.floor(k * 2 / 3), F.when((mid > 0.4) & (mid < 0.8), "bridge").otherwise("verse")).otherwise("verse")
    )
    return d.select("map_id", "section", kind.alias("section_type"), "start_sec", "end_sec")


def section_features(sections: DataFrame, n_frames: DataFrame, sample_rate=SAMPLE_RATE, hop=HOP_LENGTH) -> DataFrame:
    """Section id and linear progress per covered frame; a later section overwrites."""
    s = sections.join(n_frames.select("map_id", "n_frames"), "map_id")

    def at(c):
        return clamp((F.col(c) * float(sample_rate) / float(hop)).cast("int"), F.lit(0), F.col("n_frames")).cast("int")

    s = s.select("map_id", "section", "section_type", at("start_sec").alias("a"), at("end_sec").alias("b")).where("b > a")
    s = s.select("*", F.posexplode(F.sequence(F.col("a"), F.col("b") - 1)).alias("i", "frame"))
    size = F.col("b") - F.col("a")
    val = F.struct(lookup(SONG_SECTION_ID, "section_type", 1).alias("section_id"), F.when(size > 1, F.col("i") / (size - 1)).otherwise(0.0).alias("section_progress"))
    g = s.groupBy("map_id", "frame").agg(F.max_by(val, "section").alias("v"))
    return g.select("map_id", "frame", "v.*")
