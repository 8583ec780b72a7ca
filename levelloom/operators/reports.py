"""Playability reports, issue lists, style distance, content metrics, prediction accuracy."""

from __future__ import annotations

import math
from bisect import bisect_left
from functools import partial

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from levelloom.constants import COMPOSITE_WEIGHTS as CW, EOS, PAD
from levelloom.functions.scalars import density_score
from levelloom.operators.parity import K_COLS, gap_reset, remembered_pairs
from levelloom.plans.ordered import NOTES, Fold, Track, asof, key_schema, scan, stream_folds
from levelloom.session import cut

KINDS = ("note", "bomb", "wall", "arc", "chain")


def object_counts(events: DataFrame) -> DataFrame:
    return events.groupBy(*K_COLS).agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}s") for k in KINDS])


def excess(notes: DataFrame, digits: int, *by: str, over: int = 1) -> DataFrame:
    """Notes beyond ``over`` that share a rounded beat and ``by``, summed per level.

    Beats are counted before levels are, so a crowded beat never travels whole.
    """
    g = notes.groupBy(*K_COLS, F.bround("beat", digits).alias("at"), *by).agg(F.count("*").alias("n"))
    return g.groupBy(*K_COLS).agg(F.sum(F.greatest(F.col("n") - over, F.lit(0))).alias("excess"), F.count_if(F.col("n") > over).alias("places"))


def playability_report(events: DataFrame, seconds: DataFrame) -> DataFrame:
    """Counts, crowding, direction counts, balance, density and parity per level, with derived rates."""
    notes = events.where("kind = 'note'")
    hist = notes.groupBy(*K_COLS).agg(
        F.count_if(F.col("color") == 0).alias("red"), *[F.count_if(F.col("direction") == d).alias(f"dir_{d}") for d in range(9)]
    )
    r = (
        object_counts(events).join(hist, K_COLS, "left")
        .join(excess(notes, 3, "color").withColumnRenamed("excess", "n_same_color_same_beat").drop("places"), K_COLS, "left")
        .join(excess(notes, 3, "x", "y").withColumnRenamed("excess", "n_collisions").drop("places"), K_COLS, "left")
        .join(remembered_pairs(notes).select(*K_COLS, F.col("violations").alias("n_parity_violations")), K_COLS, "left")
        .na.fill(0).join(seconds, K_COLS, "left")
    )
    n = F.col("n_notes")
    return r.select(
        "*", (F.col("red") / F.greatest(n, F.lit(1))).alias("color_balance"),
        F.when(F.col("seconds") > 0, n / F.col("seconds")).otherwise(0.0).alias("notes_per_sec"),
        (F.col("n_parity_violations") / F.greatest(n - 1, F.lit(1))).alias("parity_rate"),
        (F.col("n_collisions") / F.greatest(n, F.lit(1))).alias("collision_rate"),
    ).drop("red", "seconds")


def pick_document(members: DataFrame) -> DataFrame:
    """The member a map is judged by: names with "expert" first, info skipped, notes required."""
    name = F.lower("member")
    ok = name.endswith(".dat") & ~name.contains("info") & F.get_json_object("text", "$.colorNotes").isNotNull()
    place = F.struct((~name.contains("expert")).cast("int").alias("a"), F.col("pos").alias("b"))
    return members.where(ok).groupBy("map_id").agg(F.min_by("member", place).alias("member"), F.min_by("text", place).alias("text"))


# ---- style distance and composite ------------------------------------------
def kl_divergence(p: list[Column], q: list[Column], eps: float = 1e-6) -> Column:
    """KL(p || q) over matching bins, each floored, not renormalised."""
    f = [(F.greatest(a, F.lit(eps)), F.greatest(b, F.lit(eps))) for a, b in zip(p, q)]
    terms = [a * F.log(a / b) for a, b in f]
    return sum(terms[1:], terms[0])


def style_gaps(report: DataFrame, reference: DataFrame, on) -> DataFrame:
    """Distance of each level to its cohort's style; no reference leaves the gaps null."""
    ref = reference.select(*[F.col(c).alias(c if c == on else f"ref_{c}") for c in reference.columns])
    j = report.join(ref, on, "left")
    dirs = [F.col(f"dir_{d}") for d in range(9)]
    total = F.greatest(sum(dirs[1:], dirs[0]), F.lit(1))
    known = F.col("ref_n_maps").isNotNull()
    kl = kl_divergence([d / total for d in dirs], [F.col(f"ref_dir_{d}") for d in range(9)])
    return j.select(
        *report.columns, F.when(known, kl).alias("direction_kl"), F.abs(F.col("notes_per_sec") - F.col("ref_mean_nps")).alias("nps_gap"),
        F.abs(F.col("parity_rate") - F.col("ref_parity_rate_baseline")).alias("parity_rate_gap"),
        F.abs(F.col("color_balance") - F.col("ref_color_balance")).alias("color_balance_gap"),
    )


def composite_score(weights: dict[str, float] | None = None) -> Column:
    """Weighted 0-1 score of a report row with style gaps; missing style counts one half."""
    w = weights or CW
    c = F.col

    def left(v):
        return F.greatest(F.lit(0.0), 1.0 - F.least(v, F.lit(1.0)))

    half = lambda v: F.coalesce(v, F.lit(0.5))
    parts = {
        "parity": left(c("parity_rate")), "collision": left(c("collision_rate")), "density": density_score("n_notes"),
        "walls": left(c("n_walls") / F.greatest("n_notes", F.lit(1))), "style_dir": half(F.exp(-c("direction_kl"))),
        "style_nps": half(F.exp(-c("nps_gap") / 3.0)),
        "style_parity": half(F.when(c("parity_rate_gap").isNotNull(), left(c("parity_rate_gap") * 5.0))),
        "style_color": half(F.when(c("color_balance_gap").isNotNull(), left(c("color_balance_gap") * 2.0))),
    }
    terms = [w[k] * v for k, v in parts.items()]
    return sum(terms[1:], terms[0])


# ---- content metrics -------------------------------------------------------
def content_metrics(events: DataFrame, lights: DataFrame | None = None) -> DataFrame:
    """Coverage, patterns, directions, balance and length per level, plus per-map totals (difficulty null).

    ``lights`` are rows of levels (map_id, difficulty); a map's total is the sum over its levels.
    """
    notes = events.where("kind = 'note'")
    # distinct (color, cell, direction) patterns first: at most 216 rows per level afterwards
    pat = notes.groupBy(*K_COLS, "color", "x", "y", "direction").agg(F.count("*").alias("n"))
    cell = pat.groupBy(*K_COLS, "x", "y").agg(F.sum("n").alias("n"), F.count("*").alias("p")).groupBy(*K_COLS).agg(
        F.count("*").alias("grid_coverage"), F.sum("p").alias("unique_patterns"),
        F.sort_array(F.collect_list(F.struct("x", "y"))).alias("grid_cells"),  # distinct cells, a dozen on the grid
    )
    dirs = pat.groupBy(*K_COLS, "direction").agg(F.sum("n").alias("n")).groupBy(*K_COLS).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("direction", "n")))).alias("directions")
    )
    per = notes.groupBy(*K_COLS).agg(
        F.count_if(F.col("color") == 0).alias("red_notes"), F.count_if(F.col("color") == 1).alias("blue_notes"),
        F.bround(F.max("beat") - F.min("beat"), 2).alias("duration_beats"),
    )
    totals = object_counts(events).rollup("map_id", "difficulty").agg(*[F.sum(f"n_{k}s").alias(f"n_{k}s") for k in KINDS]).where("map_id is not null")
    r = totals.join(cell, K_COLS, "left").join(dirs, K_COLS, "left").join(per, K_COLS, "left").join(median_interval(notes), K_COLS, "left")
    if lights is not None:
        lit = lights.rollup("map_id", "difficulty").agg(F.count("*").alias("n_lights")).where("map_id is not null")
        lit = lit.select(*[F.col(c).alias(f"_{c}") for c in K_COLS], "n_lights")
        same = (F.col("map_id") == F.col("_map_id")) & F.col("difficulty").eqNullSafe(F.col("_difficulty"))
        r = r.join(lit, same, "left").drop(*[f"_{c}" for c in K_COLS]).na.fill(0, ["n_lights"])
    return r.withColumn("color_balance", F.col("red_notes") / F.greatest(F.lit(1), F.col("red_notes") + F.col("blue_notes")))


def note_intervals(notes: DataFrame) -> DataFrame:
    """Positive gaps to the next note in document order, which need not be beat order."""
    n = scan(notes.select(*K_COLS, "beat", "seq"), Track(NOTES.keys, ("seq",), "floor(seq / 4096)"), nxt={"next_beat": "beat"})
    return n.select(*K_COLS, (F.col("next_beat") - F.col("beat")).alias("gap")).where("gap > 0")


def median_interval(notes: DataFrame) -> DataFrame:
    """Upper median of the positive gaps: gap values are counted, not collected."""
    g = note_intervals(notes).groupBy(*K_COLS, "gap").agg(F.count("*").alias("n"))
    g = scan(g, Track(NOTES.keys, ("gap",), "floor(gap * 4)"), sums={"upto": "n"})
    total = g.groupBy(*K_COLS).agg(F.sum("n").alias("total"))
    hit = g.join(total, K_COLS).where((F.col("upto") > F.floor(F.col("total") / 2)) & (F.col("upto") - F.col("n") <= F.floor(F.col("total") / 2)))
    return hit.select(*K_COLS, F.bround("gap", 4).alias("median_note_interval"))


# ---- checks ----------------------------------------------------------------
def _issue(df: DataFrame, severity, check, message, beat=None) -> DataFrame:
    sev = severity if isinstance(severity, Column) else F.lit(severity)
    chk = check if isinstance(check, Column) else F.lit(check)
    return df.select(*K_COLS, sev.alias("severity"), chk.alias("check"), message.alias("message"), (beat if beat is not None else F.lit(None)).cast("double").alias("beat"))


def check_bounds(notes: DataFrame) -> DataFrame:
    c = F.col
    off_grid = ~(c("x").between(0, 3) & c("y").between(0, 2))
    off_dir = ~c("direction").between(0, 8)
    found = F.filter(F.array(F.when(off_grid, F.lit("grid_bounds")), F.when(off_dir, F.lit("direction_bounds"))), lambda v: v.isNotNull())
    n = notes.where(off_grid | off_dir).select("*", F.explode(found).alias("check"))
    what = F.when(c("check") == "grid_bounds", F.format_string("position (%d, %d)", "x", "y")).otherwise(F.format_string("direction %d", "direction"))
    return _issue(n, "error", c("check"), F.concat(F.lit("note has invalid "), what), c("beat"))


def check_overlaps(notes: DataFrame) -> DataFrame:
    """One error per note on an already used cell of its beat, and per hand with over two notes."""
    at = F.bround("beat", 2).alias("at")
    cells = notes.groupBy(*K_COLS, at, "x", "y").agg(F.count("*").alias("n")).where("n > 1")
    cells = cells.select("*", F.explode(F.sequence(F.lit(2), F.col("n").cast("int"))).alias("i"))
    over = _issue(cells, "error", "overlap", F.format_string("overlapping notes at cell (%d, %d)", "x", "y"), F.col("at"))
    hand = notes.groupBy(*K_COLS, at, "color").agg(F.count("*").alias("n")).where("n > 2")
    side = F.when(F.col("color") == 0, "red").otherwise("blue")
    many = _issue(hand, "error", "same_color_excess", F.concat(F.col("n").cast("string"), F.lit(" "), side, F.lit(" notes on one beat")), F.col("at"))
    return over.unionByName(many)


def check_density(notes: DataFrame) -> DataFrame:
    g = notes.groupBy(*K_COLS, F.bround("beat", 2).alias("at")).agg(F.count("*").alias("n")).groupBy(*K_COLS).agg(
        F.count_if(F.col("n") > 3).alias("clump"), F.count_if(F.col("n") > 4).alias("extreme")
    )
    a = _issue(g.where("clump > 0"), "warning", "note_clumping", F.concat(F.col("clump").cast("string"), F.lit(" beats have >3 notes")))
    b = _issue(g.where("extreme > 0"), "error", "extreme_clumping", F.concat(F.col("extreme").cast("string"), F.lit(" beats have >4 notes")))
    return a.unionByName(b)


def check_parity(notes: DataFrame) -> DataFrame:
    g = gap_reset(notes).where("checks > 0")
    rate = F.col("violations") / F.col("checks")
    sev = F.when(rate > 0.1, "error").when(rate > 0.02, "warning").otherwise("info")
    return _issue(g, sev, "parity", F.concat_ws("/", F.col("violations").cast("string"), F.col("checks").cast("string")))


def check_color_balance(notes: DataFrame) -> DataFrame:
    g = notes.groupBy(*K_COLS).agg(F.count_if(F.col("color") == 0).alias("red"), F.count_if(F.col("color") == 1).alias("blue")).where("red + blue > 0")
    ratio = F.col("red") / (F.col("red") + F.col("blue"))
    sev = F.when((ratio < 0.3) | (ratio > 0.7), "warning").otherwise("info")
    return _issue(g, sev, "color_balance", F.concat_ws("/", F.col("red").cast("string"), F.col("blue").cast("string")))


def check_dots(notes: DataFrame) -> DataFrame:
    g = notes.groupBy(*K_COLS).agg(F.count_if(F.col("direction") == 8).alias("dots"), F.count("*").alias("n")).where(F.col("dots") / F.col("n") > 0.15)
    return _issue(g, "warning", "dot_overuse", F.concat_ws("/", F.col("dots").cast("string"), F.col("n").cast("string")))


def check_playability(notes: DataFrame, levels: DataFrame) -> DataFrame:
    """All checks; a listed level without notes gets the single warning ``empty``."""
    empty = levels.select(*K_COLS).distinct().join(notes.select(*K_COLS).distinct(), K_COLS, "left_anti")
    out = _issue(empty, "warning", "empty", F.lit("no notes found"))
    for check in (check_bounds, check_overlaps, check_density, check_parity, check_color_balance, check_dots):
        out = out.unionByName(check(notes))
    return out


def summarize_issues(issues: DataFrame) -> DataFrame:
    sev = F.col("severity")
    return issues.groupBy(*K_COLS).agg(*[F.count_if(sev == s).alias(s) for s in ("error", "warning", "info")], F.count("*").alias("total"))


# ---- predictions -----------------------------------------------------------
def token_accuracy(pairs: DataFrame, keys=()) -> DataFrame:
    """Accuracy over non-padding targets, and over end marks only."""
    hit = (F.col("pred") == F.col("target")).cast("double")
    real = F.col("target") != PAD
    return pairs.groupBy(*keys).agg(
        F.coalesce(F.avg(F.when(real, hit)), F.lit(0.0)).alias("token_acc"), F.avg(F.when(F.col("target") == EOS, hit)).alias("eos_acc"),
        F.count_if(real).alias("n_tokens"),
    )


def slot_accuracy(pairs: DataFrame, attributes) -> DataFrame:
    """Per-attribute accuracy on active slots: columns ``pred_<a>`` and ``target_<a>``, -1 inactive."""
    return pairs.agg(*[
        F.avg(F.when(F.col(f"target_{a}") != -1, (F.col(f"pred_{a}") == F.col(f"target_{a}")).cast("double"))).alias(f"{a}_acc") for a in attributes
    ])


#: states of a border that are walked at once; borders with more are not cut
MAX_STATES = 512


def _nudge(reach: float) -> float:
    """Slack for rounded sums and differences: what is a little out of reach may be looked at, never missed."""
    return 1e-6 * reach + 1e-9


class _Walk:
    """One still distinct course of a matching: taken truths, pairs so far, and the states it began in."""

    def __init__(self, taken: list[int], begun: int):
        self.taken, self.pairs, self.begun = taken, 0, {begun: 0}


class _Matching(Fold):
    """Match one segment of a group for every state it may begin in, without holding the segment.

    A state says how many truths are taken at each position that both sides of a border can
    reach. All distinct courses are walked together; most meet after a few predictions.
    Result: begins, pairs and ends, entry by entry.
    """

    def __init__(self, key: tuple, reach: float):
        super().__init__(key)
        self.reach, self.far = reach, reach + _nudge(reach)
        self.at: list[float] = []
        self.size: list[int] = []
        self.on: list[bool] = []  # handed on to the next segment
        self.passed = 0  # handed on, but out of reach of all later predictions
        self.begins: list[tuple[int, ...]] = [()]
        self.walks: list[_Walk] | None = None

    def row(self, row):
        at, side, n, inherited, on = row[-5:]
        if side:
            self._start()
            self._predict(at, int(n))
            return ()
        if inherited:
            self.begins = [(*s, t) for s in self.begins for t in range(int(n) + 1)]
        else:
            self._start()
            for w in self.walks:
                w.taken.append(0)
        self.at.append(at)
        self.size.append(int(n))
        self.on.append(bool(on))
        return ()

    def _start(self) -> None:
        if self.walks is None:
            self.walks = [_Walk(list(s), i) for i, s in enumerate(self.begins)]

    def _predict(self, x: float, n: int) -> None:
        gone = bisect_left(self.at, x - self.far)
        if gone:
            self.passed += sum(self.on[:gone])
            del self.at[:gone], self.size[:gone], self.on[:gone]
        j = bisect_left(self.at, x)
        for w in self.walks:
            del w.taken[:gone]
            for _ in range(n):
                left = j - 1
                while left >= 0 and w.taken[left] == self.size[left]:
                    left -= 1
                right = j
                while right < len(self.at) and w.taken[right] == self.size[right]:
                    right += 1
                if left >= 0 and (right == len(self.at) or x - self.at[left] <= self.at[right] - x):
                    right = left
                if right == len(self.at) or abs(self.at[right] - x) > self.reach:
                    break
                w.taken[right] += 1
                w.pairs += 1
        if len(self.walks) > 1:
            met: dict[tuple[int, ...], _Walk] = {}
            for w in self.walks:
                first = met.setdefault(tuple(w.taken), w)
                if first is not w:
                    first.begun.update({b: pairs + w.pairs - first.pairs for b, pairs in w.begun.items()})
            self.walks = list(met.values())

    def end(self):
        self._start()
        pairs, ends = [0] * len(self.begins), [""] * len(self.begins)
        for w in self.walks:
            state = ",".join(map(str, [0] * self.passed + [t for t, on in zip(w.taken, self.on) if on]))
            for b, before in w.begun.items():
                pairs[b], ends[b] = before + w.pairs, state
        yield (*self.key, [",".join(map(str, s)) for s in self.begins], pairs, ends)


class _Total(Fold):
    """Follow the states from segment to segment and add up the pairs."""

    def __init__(self, key: tuple):
        super().__init__(key)
        self.state, self.pairs = "", 0

    def row(self, row):
        begins, pairs, ends = map(list, row[-3:])
        i = begins.index(self.state)
        self.pairs, self.state = self.pairs + int(pairs[i]), ends[i]
        return ()

    def end(self):
        yield (*self.key, self.pairs)


def onset_matches(pred: DataFrame, truth: DataFrame, keys, on: str, tolerance: float, width: float | None = None) -> DataFrame:
    """Matched pairs per group: predictions in order take the nearest free truth within reach.

    A truth enters the stream when the first prediction can reach it. The stream is cut into
    slices of ``width``; what passes a border is only which truths near it are taken, so each
    slice is matched for every such state and the slices are then chained, one row each. A
    border with more than ``MAX_STATES`` states (many truths within reach) is not cut. Rows of
    a slice are streamed; only truths within reach of one prediction are held.
    """
    keys = list(keys)
    reach = float(tolerance)
    width = width or max(reach * 512, 64.0)
    if width <= 4 * reach:
        raise ValueError("slices must be wider than four tolerances")
    p = pred.select(*keys, F.col(on).cast("double").alias("at"), F.lit(1).alias("side"))
    t = truth.select(*keys, F.col(on).cast("double").alias("at"), F.lit(0).alias("side"))
    u = p.unionByName(t).where("at is not null").groupBy(*keys, "at", "side").agg(F.count("*").alias("n"))
    far = reach + _nudge(reach)
    enters = F.when(F.col("side") == 0, F.col("at") - far).otherwise(F.col("at"))
    u = u.withColumn("enters", enters).withColumn("slice", F.floor(F.col("enters") / width).cast("long"))
    shared = (F.col("side") == 0) & (F.col("enters") >= (F.col("slice") + 1) * width - 2 * far)
    u = cut(u.withColumn("shared", shared))
    ways = F.sum(F.when(F.col("shared"), F.log(F.col("n") + 1.0)).otherwise(0.0))
    slices = u.groupBy(*keys, "slice").agg((ways <= math.log(MAX_STATES) + 1e-9).cast("long").alias("cut"))
    before = W.partitionBy(*keys).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    slices = slices.withColumn("segment", F.coalesce(F.sum("cut").over(before), F.lit(0)))
    named = u.join(slices, [*keys, "slice"])
    on_ = F.col("shared") & (F.col("cut") == 1)
    own = named.select(*keys, "segment", "at", "side", "n", "enters", F.lit(False).alias("inherited"), on_.alias("on"))
    copies = named.where(on_).select(*keys, (F.col("segment") + 1).alias("segment"), "at", "side", "n", "enters", F.lit(True).alias("inherited"), F.lit(False).alias("on"))
    rows = own.unionByName(copies).select(*keys, "segment", "enters", "at", "side", "n", "inherited", "on")
    schema = f"{key_schema(rows, [*keys, 'segment'])}, begins array<string>, pairs array<bigint>, ends array<string>"
    segments = stream_folds(rows, [*keys, "segment"], ["enters", "side"], partial(_Matching, reach=reach), schema)
    return stream_folds(segments, keys, ["segment"], _Total, f"{key_schema(rows, keys)}, tp bigint")


def onset_scores(pred: DataFrame, truth: DataFrame, keys, on: str = "frame", tolerance: float = 3.0, groups: DataFrame | None = None) -> DataFrame:
    """Precision, recall and F1 per group, with the agreed values for empty sides.

    ``groups`` lists all groups (say, windows): those empty on both sides are in perfect
    agreement. Without it only groups that have a row on either side are scored.
    """
    keys = list(keys)
    n_p = pred.groupBy(*keys).agg(F.count("*").alias("n_pred"))
    n_t = truth.groupBy(*keys).agg(F.count("*").alias("n_true"))
    d = n_p.join(n_t, keys, "full").join(onset_matches(pred, truth, keys, on, tolerance), keys, "left").na.fill(0, ["n_pred", "n_true", "tp"])
    if groups is not None:
        d = groups.select(*keys).distinct().join(d, keys, "left").na.fill(0, ["n_pred", "n_true", "tp"])
    both = (F.col("n_pred") > 0) & (F.col("n_true") > 0)
    none = (F.col("n_pred") == 0) & (F.col("n_true") == 0)
    d = d.withColumn("precision", F.when(both, F.col("tp") / F.col("n_pred")).when(F.col("n_pred") > 0, 0.0).otherwise(1.0))
    d = d.withColumn("recall", F.when(both, F.col("tp") / F.col("n_true")).when(F.col("n_true") > 0, 0.0).otherwise(1.0))
    s = F.col("precision") + F.col("recall")
    return d.withColumn("f1", F.when(none, 1.0).when(both & (s > 0), 2 * F.col("precision") * F.col("recall") / F.when(s > 0, s)).otherwise(0.0))


def mean_scores(scores: DataFrame, keys=()) -> DataFrame:
    return scores.groupBy(*keys).agg(*[F.avg(c).alias(f"mean_{c}") for c in ("precision", "recall", "f1")])


# ---- coverage statistics ---------------------------------------------------
def gap_histogram(notes: DataFrame) -> DataFrame:
    """Share of note gaps by note value."""
    g = F.col("gap")
    name = F.when(g < 0.3, "sixteenth").when(g < 0.6, "eighth").when(g < 1.1, "quarter").when(g < 2.1, "half").otherwise("longer")
    c = note_intervals(notes).groupBy(name.alias("gap_type")).agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("t")).scalar()
    return c.withColumn("share", F.col("n") / total)


def row_shares(notes: DataFrame) -> DataFrame:
    c = notes.groupBy("y").agg(F.count("*").alias("n"))
    return c.withColumn("share", F.col("n") / c.agg(F.sum("n").alias("t")).scalar())


def kind_coverage(events: DataFrame) -> DataFrame:
    """Share of levels that use each object kind."""
    return object_counts(events).agg(*[F.avg((F.col(f"n_{k}s") > 0).cast("double")).alias(f"{k}_share") for k in KINDS])
