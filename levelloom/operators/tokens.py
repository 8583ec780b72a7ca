"""Level events to token sequences and back, and checks on token sequences."""

from __future__ import annotations

from collections import deque
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from levelloom import constants as K
from levelloom.functions.scalars import clamp, dequantize, is_neutral, lookup, parity_class, quantize
from levelloom.operators.parity import K_COLS
from levelloom.plans.ordered import Fold, Track, scan, stream_folds
from levelloom.session import cut

PRIORITY = {"note": 0, "bomb": 1, "wall": 2, "arc_start": 3, "arc_end": 4, "chain": 5}
_NO_INTS = "array<int>"


def _c(v) -> Column:
    return F.col(v) if isinstance(v, str) else v


def _tok(rng, v) -> Column:
    return (F.lit(rng[0]) + v).cast("int")


# ---- encoding --------------------------------------------------------------
def token_events(events: DataFrame, spread: bool = False) -> DataFrame:
    """One row per token event; an arc yields its head and its tail.

    ``spread`` shuffles by (level, beat) before the tokens are built: gathering nearly
    unique beats gains nothing from a map-side pass, and the rows are narrower here.
    """
    head = F.struct(F.when(F.col("kind") == "arc", "arc_start").otherwise(F.col("kind")).alias("ev"), F.col("beat").alias("at"), F.col("x").alias("ex"), F.col("y").alias("ey"))
    tail = F.struct(F.lit("arc_end").alias("ev"), F.col("tail_beat").alias("at"), F.col("tail_x").alias("ex"), F.col("tail_y").alias("ey"))
    e = events.where(F.col("kind").isin("note", "bomb", "wall", "arc", "chain"))
    e = e.select("*", F.explode(F.when(F.col("kind") == "arc", F.array(head, tail)).otherwise(F.array(head))).alias("e"))
    if spread:
        e = e.repartition(*K_COLS, "e.at")
    c = F.col
    dur = F.least(c("duration").cast("int"), F.lit(64))
    arr = F.array
    toks = {
        "note": arr(F.lit(K.NOTE), _tok(K.COLOR, c("color")), _tok(K.COL, c("x")), _tok(K.ROW, c("y")), _tok(K.DIR, c("direction")), _tok(K.ANGLE, quantize(c("angle_offset"), K.ANGLE_BINS))),
        "bomb": arr(F.lit(K.BOMB), _tok(K.COL, c("x")), _tok(K.ROW, c("y"))),
        "wall": arr(F.lit(K.WALL), _tok(K.COL, c("x")), _tok(K.ROW, c("y")), _tok(K.WIDTH, c("width") - 1), _tok(K.HEIGHT, c("height") - 1), _tok(K.DUR_INT, dur), _tok(K.DUR_FRAC, quantize(c("duration") - dur, K.DUR_FRAC_BINS))),
        "arc_start": arr(F.lit(K.ARC_START), _tok(K.COLOR, c("color")), _tok(K.COL, c("x")), _tok(K.ROW, c("y")), _tok(K.DIR, c("direction")), _tok(K.MU, quantize(c("mu"), K.MU_BINS))),
        "arc_end": arr(F.lit(K.ARC_END), _tok(K.COLOR, c("color")), _tok(K.COL, c("tail_x")), _tok(K.ROW, c("tail_y")), _tok(K.DIR, c("tail_direction")), _tok(K.MU, quantize(c("tail_mu"), K.MU_BINS)), _tok(K.MID_ANCHOR, c("mid_anchor"))),
        "chain": arr(F.lit(K.CHAIN), _tok(K.COLOR, c("color")), _tok(K.COL, c("x")), _tok(K.ROW, c("y")), _tok(K.DIR, c("direction")), _tok(K.COL, c("tail_x")), _tok(K.ROW, c("tail_y")),
                     _tok(K.SLICE, clamp(c("slice_count"), K.SLICE_MIN, K.SLICE_MAX) - K.SLICE_MIN), _tok(K.SQUISH, quantize(c("squish"), K.SQUISH_BINS)),
                     _tok(K.CHAIN_TAIL, quantize(F.greatest(F.lit(0.0), c("tail_beat") - c("beat")), K.CHAIN_TAIL_BINS))),
    }
    ev = c("e.ev")
    tokens = F.when(ev == "note", toks["note"])
    for name in list(toks)[1:]:
        tokens = tokens.when(ev == name, toks[name])
    return e.select(*K_COLS, c("e.at").alias("beat"), lookup(PRIORITY, ev, 99).alias("prio"), c("e.ex").alias("x"), c("e.ey").alias("y"), "seq", tokens.alias("tokens"))


def join_tokens(parts: Column) -> Column:
    """Concatenate token arrays with separators between and the end mark behind."""
    body = F.flatten(F.transform(parts, lambda t, i: F.when(i > 0, F.concat(F.array(F.lit(K.SEP)), t)).otherwise(t)))
    return F.concat(body, F.array(F.lit(K.EOS)))


def encode_levels(events: DataFrame) -> DataFrame:
    """Token array per (level, beat) in canonical order: type, column, row, document order."""
    t = token_events(events, spread=True).groupBy(*K_COLS, "beat").agg(F.array_sort(F.collect_list(F.struct("prio", "x", "y", "seq", "tokens"))).alias("ev"))
    return t.select(*K_COLS, "beat", join_tokens(F.transform("ev", lambda e: e.tokens)).alias("tokens"))


# ---- reading token arrays --------------------------------------------------
#: a null token, which no int is
_NULL = -(2**40)


def _flat(tokens: pa.ListArray, drop: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """A column of token arrays as one run of tokens and the border of each row in it. Null rows are empty."""
    rows = tokens.fill_null([])
    size = rows.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = rows.flatten().cast(pa.int64()).fill_null(_NULL).to_numpy(zero_copy_only=False)
    if drop:
        keep = ~np.isin(flat, drop)
        size = np.bincount(np.repeat(np.arange(len(size)), size)[keep], minlength=len(size))
        flat = flat[keep]
    return flat, np.concatenate([[0], np.cumsum(size)])


def _by_token(tok: np.ndarray, table: Mapping[int, int], default: int) -> np.ndarray:
    known = np.full(K.VOCAB_SIZE, default, np.int64)
    known[list(table)] = list(table.values())
    return np.where((tok >= 0) & (tok < K.VOCAB_SIZE), known[np.clip(tok, 0, K.VOCAB_SIZE - 1)], default)


def _walk(flat, border, need, step, *, ends=(), short_ends=(), skip=(), limit=None) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of every event, rows in order: all rows of a batch take their steps together.

    A token of ``ends`` stops a row, as does a short event of a kind in ``short_ends``; kinds in
    ``skip`` are passed over whole; ``limit`` events end a row.
    """
    need_, step_ = _by_token(flat, need, 0), _by_token(flat, step, 1)
    stop, halt, silent = np.isin(flat, ends), np.isin(flat, short_ends), np.isin(flat, skip)
    row = np.flatnonzero(border[1:] > border[:-1])
    at, taken = border[row], np.zeros(len(row), np.int64)
    rows, places = [], []
    while len(row):
        event = need_[at] > 0
        whole = event & (border[row + 1] - at >= need_[at])
        hit = whole & ~silent[at]
        rows.append(row[hit])
        places.append(at[hit])
        taken = taken + hit
        on = ~stop[at] & ~(event & ~whole & halt[at])
        at = at + np.where(whole, step_[at], 1)
        on &= at < border[row + 1]
        if limit is not None:
            on &= taken < limit
        row, at, taken = row[on], at[on], taken[on]
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows, places = np.concatenate(rows), np.concatenate(places)
    order = np.argsort(places, kind="stable")  # rows follow each other in the run of tokens
    return rows[order], places[order]


def _lists(rows: np.ndarray, n: int, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]), pa.int32()), values)


def event_starts(tokens, need: Mapping[int, int], step: Mapping[int, int], *, eos_ends: bool, short_ends: bool) -> Column:
    """0-based positions of events in a token array.

    An event token counts when ``need`` tokens remain from it; the walk then moves on
    by ``step``. A short event ends the walk or is passed over; other tokens are
    passed over; the end mark may end the walk.
    """
    @F.arrow_udf("array<int>")
    def run(tokens: pa.Array) -> pa.Array:
        flat, border = _flat(tokens)
        rows, places = _walk(flat, border, need, step, ends=(K.EOS,) if eos_ends else (), short_ends=tuple(need) if short_ends else ())
        return _lists(rows, len(tokens), pa.array(places - border[rows], pa.int32()))

    return run(_c(tokens))


def decode_events(tokens: DataFrame) -> DataFrame:
    """Token arrays back to events; arc heads and tails stay separate (see ``pair_arcs``)."""
    full = K.EVENT_LENGTH
    starts = event_starts("tokens", full, full, eos_ends=True, short_ends=True)
    e = tokens.select(*K_COLS, "beat", "tokens", F.posexplode(starts).alias("ord", "at"))

    def attr(k, rng):
        return clamp(F.get("tokens", F.col("at") + k) - rng[0], 0, rng[1] - 1)

    kind = F.get("tokens", F.col("at"))
    colored = kind.isin(K.NOTE, K.ARC_START, K.ARC_END, K.CHAIN)
    arc = kind.isin(K.ARC_START, K.ARC_END)
    cell = F.when(colored, F.lit(2)).otherwise(1)

    def at(k, rng, cond):
        return F.when(cond, attr(k, rng))

    return e.select(
        *K_COLS, "beat", "ord",
        F.get(F.array(*[F.lit(s) for s in ("note", "bomb", "wall", "arc_start", "arc_end", "chain")]), kind - K.NOTE).alias("kind"),
        at(1, K.COLOR, colored).alias("color"),
        clamp(F.get("tokens", F.col("at") + cell) - K.COL[0], 0, 3).alias("x"),
        clamp(F.get("tokens", F.col("at") + cell + 1) - K.ROW[0], 0, 2).alias("y"),
        at(4, K.DIR, colored).alias("direction"),
        F.when(kind == K.NOTE, dequantize(attr(5, K.ANGLE), K.ANGLE_BINS).cast("int")).alias("angle_offset"),
        (at(3, K.WIDTH, kind == K.WALL) + 1).alias("width"), (at(4, K.HEIGHT, kind == K.WALL) + 1).alias("height"),
        F.when(kind == K.WALL, attr(5, K.DUR_INT) + dequantize(attr(6, K.DUR_FRAC), K.DUR_FRAC_BINS)).alias("duration"),
        F.when(arc, dequantize(attr(5, K.MU), K.MU_BINS)).alias("mu"), at(6, K.MID_ANCHOR, kind == K.ARC_END).alias("mid_anchor"),
        at(5, K.COL, kind == K.CHAIN).alias("tail_x"), at(6, K.ROW, kind == K.CHAIN).alias("tail_y"),
        F.when(kind == K.CHAIN, F.col("beat") + dequantize(attr(9, K.CHAIN_TAIL), K.CHAIN_TAIL_BINS)).alias("tail_beat"),
        (at(7, K.SLICE, kind == K.CHAIN) + K.SLICE_MIN).alias("slice_count"),
        F.when(kind == K.CHAIN, dequantize(attr(8, K.SQUISH), K.SQUISH_BINS)).alias("squish"),
    )


_ARC_OUT = (
    "map_id bigint, difficulty string, color int, beat double, x int, y int, direction int, mu double, "
    "tail_beat double, tail_x int, tail_y int, tail_direction int, tail_mu double, mid_anchor int"
)


#: tails further apart than this never compete for a head: the largest grid term of the cost, and some slack
_RIVALS = 0.05 + 1e-9
_LATE = 1000.0


def _cost(h: tuple, t: tuple) -> float:
    """Cost of a tail for a head; both begin (beat, x, y)."""
    return abs(t[0] - h[0]) + (_LATE if t[0] < h[0] else 0.0) + (abs(t[1] - h[1]) + abs(t[2] - h[2])) * 0.01


def _int(v) -> int | None:
    return None if v is None or v != v else int(v)


class _Ends(Fold):
    """Base of both folds over arc ends: rows end with (beat, x, y, ord, direction, mu, mid_anchor, is_head)."""

    def __init__(self, key: tuple):
        super().__init__(key)
        self.heads: deque[tuple] = deque()
        self.tails: list[tuple] = []

    def out(self, found: str, h: tuple | None, t: tuple | None) -> tuple:
        """A pair, or an end that is still alone, in the columns of ``_ENDS``."""
        parts = []
        for e in (h, t):
            parts += [None] * 5 if e is None else [e[0], _int(e[1]), _int(e[2]), _int(e[4]), e[5]]
        return (*self.key[:3], found, *parts, None if t is None else _int(t[6]), _int((h or t)[3]))


class _Forward(_Ends):
    """Heads in time order take the cheapest free tail at or after them; ends left over are given out."""

    def row(self, row):
        end = row[-8:]
        if self.tails and end[0] - self.tails[-1][0] > _RIVALS:
            yield from self.settle()
        (self.heads if end[-1] else self.tails).append(end)

    def settle(self):
        while self.heads and self.tails:
            h = self.heads[0]
            free = [(_cost(h, t), i) for i, t in enumerate(self.tails) if t[0] >= h[0]]
            if not free:
                break
            yield self.out("pair", self.heads.popleft(), self.tails.pop(min(free)[1]))
        for t in self.tails:
            yield self.out("tail", None, t)
        self.tails = []

    def end(self):
        yield from self.settle()
        for h in self.heads:
            yield self.out("head", h, None)


class _Backward(_Ends):
    """Heads without a tail at or after them take the cheapest of a few rival tails before them."""

    def row(self, row):
        (self.heads if row[-1] else self.tails).append(row[-8:])
        return ()

    def end(self):
        for h in self.heads:
            if not self.tails:
                break
            i = min(range(len(self.tails)), key=lambda i: _cost(h, self.tails[i]))
            yield self.out("pair", h, self.tails.pop(i))


_HAND = [*K_COLS, "color"]
_ENDS = (
    "map_id bigint, difficulty string, color int, found string, beat double, x int, y int, direction int, mu double, "
    "tail_beat double, tail_x int, tail_y int, tail_direction int, tail_mu double, mid_anchor int, ord int"
)
_END = ["beat", "x", "y", "ord", "direction", "mu", "mid_anchor", "is_head"]


def pair_arcs(decoded: DataFrame) -> DataFrame:
    """Match arc heads to tails per hand: nearest tail at or after, then grid distance.

    Heads wait in line, so the tail a head gets follows from counting: a tail nobody waits
    for is left over, any other serves the next head in line. Ranks bring a head together with
    the few rival tails among which grid distance decides, so neither an unmatched head nor
    crowded tails make runs longer. Heads that wait for ever take the latest tails left over,
    matched by rank from the end. Only where a head lies between two rival tails do counts
    depend on the grid; such a hand is streamed in order, holding the waiting heads alone.
    """
    need = [*_HAND, "beat", "ord", "kind", "x", "y", "direction", "mu", "mid_anchor"]
    a = decoded.where(F.col("kind").isin("arc_start", "arc_end")).select(*need).na.fill({"mid_anchor": 0})
    a = cut(a.withColumn("is_head", F.col("kind") == "arc_start").drop("kind").withColumn("_tail", (~F.col("is_head")).cast("int")))
    track = Track(tuple(_HAND), ("beat", "_tail", "ord"), "floor(beat / 64)")
    head, tail = F.col("is_head"), ~F.col("is_head")
    one = F.lit(1).cast("long")
    a = scan(a, track, sums={"_heads": head.cast("long"), "_tails": tail.cast("long")}, prev={"_was": ("beat", tail)}, nxt={"_next": ("beat", tail)})
    a = cut(a.withColumn("_open", F.col("_heads") - F.col("_tails")))  # below zero once tails came for nobody
    new = tail & F.coalesce(F.col("beat") - F.col("_was") > _RIVALS, F.lit(True))
    lowest = F.col("_open") - F.when(head, 1).otherwise(-1)  # as it was before the row
    a = cut(scan(a, track, lows={"_low": lowest}, sums={"group": new.cast("long")}))
    mixed = a.where(head & (F.col("_next") - F.col("_was") <= _RIVALS)).select(*_HAND).distinct()
    a = a.join(mixed.withColumn("_mixed", F.lit(True)), _HAND, "left").withColumn("_mixed", F.coalesce("_mixed", F.lit(False)))
    # a tail nobody waits for makes a new lowest; their number is the lowest so far
    wanted = a.where(tail & (F.col("_open") >= F.col("_low")))
    wanted = wanted.select(*_HAND, (F.col("_tails") + F.col("_low")).alias("_heads"), F.col("group").alias("_group"))
    cols = [*_HAND, "group", "_tail", *_END]
    heads = a.where(head & ~F.col("_mixed")).drop("group").join(wanted, [*_HAND, "_heads"], "left").withColumn("group", F.coalesce("_group", F.lit(-1).cast("long")))
    rows = heads.select(*cols).unionByName(a.where(tail & ~F.col("_mixed")).select(*cols))
    rows = rows.unionByName(a.where("_mixed").withColumn("group", F.lit(-2).cast("long")).select(*cols))
    found = cut(stream_folds(rows, [*_HAND, "group"], ["beat", "_tail", "ord"], _Forward, _ENDS))
    pairs = found.where("found = 'pair'")
    late = found.where("found = 'head'").select(*_HAND, "beat", "ord", "x", "y", "direction", "mu", F.lit(0).alias("mid_anchor"), F.lit(True).alias("is_head"))
    left = found.where("found = 'tail'").select(
        *_HAND, F.col("tail_beat").alias("beat"), "ord", F.col("tail_x").alias("x"), F.col("tail_y").alias("y"), F.col("tail_direction").alias("direction"),
        F.col("tail_mu").alias("mu"), "mid_anchor", F.lit(False).alias("is_head"))
    left = left.join(late.select(*_HAND).distinct(), _HAND, "left_semi")
    order = Track(tuple(_HAND), ("beat", "ord"), "floor(beat / 64)")
    back = Track(tuple(_HAND), ("_back", "_last"), "floor(_back / 64)")
    left = left.withColumn("_back", -F.col("beat")).withColumn("_last", -F.col("ord"))
    left = scan(left, back, sums={"_nth": one}, prev={"_was": "beat"})
    left = cut(scan(left, back, sums={"group": F.coalesce(F.col("_was") - F.col("beat") > _RIVALS, F.lit(True)).cast("long")}))
    late = scan(late, order, sums={"_nth": one}).join(left.select(*_HAND, "_nth", "group"), [*_HAND, "_nth"])
    both = late.select(*_HAND, "group", *_END).unionByName(left.select(*_HAND, "group", *_END))
    more = stream_folds(both, [*_HAND, "group"], ["beat", "ord"], _Backward, _ENDS)
    return pairs.unionByName(more).select(*[c.split()[0] for c in _ARC_OUT.split(", ")])


def _notes(tokens: pa.ListArray, need: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Row, and colour, column, row and direction of every note with ``need`` tokens."""
    flat, border = _flat(tokens)
    rows, places = _walk(flat, border, {K.NOTE: need}, {K.NOTE: 6})
    return rows, [flat[places + k] - r[0] for k, r in ((1, K.COLOR), (2, K.COL), (3, K.ROW), (4, K.DIR))]


def note_tuples(tokens, *, loose: bool = False) -> Column:
    """In-range notes of a token array as structs (color, x, y, direction).

    The strict reader wants the whole note; the loose one only up to its direction.
    """
    @F.arrow_udf("array<struct<color:int,x:int,y:int,direction:int>>")
    def run(tokens: pa.Array) -> pa.Array:
        rows, parts = _notes(tokens, 5 if loose else 6)
        ok = np.logical_and.reduce([(p >= 0) & (p < r[1]) for p, r in zip(parts, (K.COLOR, K.COL, K.ROW, K.DIR))])
        found = pa.StructArray.from_arrays([pa.array(p[ok], pa.int32()) for p in parts], ["color", "x", "y", "direction"])
        return _lists(rows[ok], len(tokens), found)

    return run(_c(tokens))


def _last_per_row(n: int, rows: np.ndarray, values: np.ndarray) -> pa.Array:
    """The last value of every row, null where there is none."""
    out, none = np.zeros(n, np.int64), np.ones(n, bool)
    out[rows], none[rows] = values, False
    return pa.array(out, pa.int32(), mask=none)


def first_direction(tokens) -> Column:
    """Direction of the first note token whose direction is in range."""
    @F.arrow_udf("int")
    def run(tokens: pa.Array) -> pa.Array:
        flat, border = _flat(tokens)
        at = np.flatnonzero(flat == K.NOTE)
        rows = np.searchsorted(border, at, side="right") - 1
        whole = at + 4 < border[rows + 1]
        rows, d = rows[whole], flat[at[whole] + 4] - K.DIR[0]
        ok = (d >= 0) & (d < K.DIR[1])
        return _last_per_row(len(tokens), rows[ok][::-1], d[ok][::-1])

    return run(_c(tokens))


def last_direction(tokens, color: int) -> Column:
    """Direction of the last note of one hand."""
    @F.arrow_udf("int")
    def run(tokens: pa.Array) -> pa.Array:
        rows, (c, _, _, d) = _notes(tokens, 5)
        mine = (c == color) & (d >= 0) & (d < K.DIR[1])
        return _last_per_row(len(tokens), rows[mine], d[mine])

    return run(_c(tokens))


_SLOT = ("color", "col", "row", "direction", "angle", "event_type")
_IDLE = (2, 0, 0, 0, 3, 0)


def structured_slots(tokens, max_slots: int = 3) -> Column:
    """Struct (n_notes, slots): the first note-like events, padded with inactive slots.

    Walls are passed over; a chain needs nine tokens although it spans ten.
    """
    need = {K.NOTE: 6, K.BOMB: 3, K.WALL: 7, K.ARC_START: 6, K.ARC_END: 7, K.CHAIN: 9}
    kinds = {K.NOTE: 0, K.BOMB: 1, K.ARC_START: 2, K.ARC_END: 3, K.CHAIN: 4}

    @F.arrow_udf(f"struct<n_notes:int,slots:array<struct<{','.join(f'{c}:int' for c in _SLOT)}>>>")
    def run(tokens: pa.Array) -> pa.Array:
        flat, border = _flat(tokens, drop=(K.PAD, K.EOS, K.BOS, _NULL))
        rows, i = _walk(flat, border, need, K.EVENT_LENGTH, short_ends=(K.WALL,), skip=(K.WALL,), limit=max_slots)
        tok = flat[i]
        bomb = tok == K.BOMB

        def at(k, r, where=True):
            return np.clip(flat[np.where(where, i + k, i)] - r[0], 0, r[1] - 1)

        cell = np.where(bomb, 1, 2)
        parts = (
            np.where(bomb, 2, at(1, K.COLOR)), at(cell, K.COL), at(cell + 1, K.ROW), np.where(bomb, 0, at(4, K.DIR, ~bomb)),
            np.where(tok == K.NOTE, at(5, K.ANGLE, tok == K.NOTE), 3), _by_token(tok, kinds, 0),
        )
        n = len(tokens)
        found = np.bincount(rows, minlength=n)
        place = rows * max_slots + np.arange(len(rows)) - np.repeat(np.cumsum(found) - found, found)
        slots = []
        for part, idle in zip(parts, _IDLE):
            each = np.full(n * max_slots, idle)
            each[place] = part
            slots.append(pa.array(each, pa.int32()))
        slots = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * max_slots, pa.int32()), pa.StructArray.from_arrays(slots, list(_SLOT)))
        return pa.StructArray.from_arrays([pa.array(np.bincount(rows[~bomb], minlength=n), pa.int32()), slots], ["n_notes", "slots"])

    return run(_c(tokens))


def masked_slots(slots: Column) -> Column:
    """Training targets: every attribute of an inactive slot becomes -1."""
    names = ("color", "col", "row", "direction", "angle", "event_type")
    return F.transform(slots, lambda s: F.struct(*[F.when(s.color == 2, -1).otherwise(s[n]).alias(n) for n in names]))


def mirrored(tokens) -> Column:
    """Left-right mirror of a token array: hands, columns, directions and angles.

    Attributes are recognised by their place in an event; out-of-range ids stay.
    """
    t = _c(tokens)
    n = F.size(t)
    lengths = K.EVENT_LENGTH
    dirs = F.array(*[F.lit(d) for d in K.MIRROR_DIRECTION])

    def move(acc, i):
        v, ev, k = F.get(t, i), acc.ev, acc.k
        inside = k < lookup(lengths, ev, 0)
        length = lookup(lengths, v, 0)
        opens = ~inside & (length > 0) & (n - i >= length)
        colored = ev.isin(K.NOTE, K.ARC_START, K.ARC_END, K.CHAIN)

        def swap(rng, image):
            return F.when((v >= rng[0]) & (v < rng[0] + rng[1]), rng[0] + image(v - rng[0])).otherwise(v)

        col = swap(K.COL, lambda x: 3 - x)
        image = (
            F.when(~inside, v)
            .when(colored & (k == 1), swap(K.COLOR, lambda x: 1 - x))
            .when((colored & (k == 2)) | (~colored & (k == 1)), col)
            .when(colored & (k == 4), swap(K.DIR, lambda x: F.get(dirs, x)))
            .when((ev == K.NOTE) & (k == 5), swap(K.ANGLE, lambda x: 6 - x))
            .when((ev == K.CHAIN) & (k == 5), col).otherwise(v)
        )
        return F.struct(
            F.when(opens, v).when(inside, ev).otherwise(0).cast("int").alias("ev"),
            F.when(opens, 1).otherwise(k + 1).cast("int").alias("k"), F.array_append(acc.out, image.cast("int")).alias("out"),
        )

    start = F.struct(F.lit(0).alias("ev"), F.lit(0).alias("k"), F.array().cast(_NO_INTS).alias("out"))
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), start, move, lambda a: a.out)).otherwise(t)


def _grammatical(tokens: pa.Array) -> pa.Array:
    """Whether events with in-range attributes, separators between, one end mark and then only padding make a token array."""
    flat, border = _flat(tokens)
    width = max(len(g) for g in K.EVENT_GRAMMAR.values())
    low, high = np.full((K.VOCAB_SIZE, width), -1), np.full((K.VOCAB_SIZE, width), np.iinfo(np.int64).max)
    for ev, attrs in K.EVENT_GRAMMAR.items():
        for k, (off, cnt) in enumerate(attrs):
            low[ev, k], high[ev, k] = off, off + cnt - 1
    length = _by_token(flat, K.EVENT_LENGTH, 0)
    other = np.concatenate([[0], np.cumsum(flat != K.PAD)])  # tokens before a place that are no padding
    valid = np.zeros(len(tokens), bool)
    row = np.flatnonzero(border[1:] > border[:-1])
    at = border[row]
    while len(row):
        # an event and the token behind it lie in the row
        on = (length[at] > 0) & (at + length[at] < border[row + 1])
        row, at = row[on], at[on]
        ev, behind, ok = flat[at], at + length[at], np.ones(len(at), bool)
        for k in range(width):
            v = flat[np.minimum(at + 1 + k, len(flat) - 1)]
            ok &= (v >= low[ev, k]) & (v <= high[ev, k]) | (k + 1 >= length[at])
        end = border[row + 1]
        done = ok & (flat[behind] == K.EOS)
        valid[row[done]] = other[end[done]] == other[behind[done] + 1]
        on = ok & (flat[behind] == K.SEP) & (behind + 1 < end)
        row, at = row[on], behind[on] + 1
    return pa.array(valid, mask=tokens.is_null().to_numpy(zero_copy_only=False))


def grammar_report(tokens, difficulty=None) -> Column:
    """Struct (valid, n_notes, over_cap, collisions) for one token array.

    An onset holds two notes, one of each colour; on the hardest difficulty three, two of a colour.

    Valid means: events with in-range attributes, separators between, one end mark,
    nothing but padding behind it.
    """
    t = _c(tokens)
    notes = note_tuples(t)
    cells = F.transform(notes, lambda s: s.x + s.y * K.COL[1])
    reds = F.size(F.filter(notes, lambda s: s.color == 0))
    hardest = F.lit(False) if difficulty is None else F.coalesce(_c(difficulty) == "ExpertPlus", F.lit(False))
    max_notes, max_per_color = F.when(hardest, 3).otherwise(2), F.when(hardest, 2).otherwise(1)
    over = (F.size(notes) > max_notes) | (reds > max_per_color) | (F.size(notes) - reds > max_per_color)
    return F.struct(
        F.arrow_udf(_grammatical, "boolean")(t).alias("valid"), F.size(notes).alias("n_notes"), over.alias("over_cap"),
        (F.size(notes) - F.size(F.array_distinct(cells))).alias("collisions"),
    )


def grammar_parity(onsets: DataFrame, out: str = "parity") -> DataFrame:
    """Add the number of notes of each onset that swing to the side their hand is on already.

    ``onsets`` has (map_id, difficulty, beat, tokens). A hand's side is that of its last note,
    in the onset or in any before it; a neutral direction leaves it free. What an onset hands
    on is one direction per hand, carried by a sliced scan.
    """
    track = Track(tuple(K_COLS), ("beat",), "floor(beat / 32)")
    lasts = {f"_last{c}": last_direction("tokens", c) for c in (0, 1)}
    d = cut(onsets.withColumns(lasts))
    d = scan(d, track, prev={f"_was{c}": (f"_last{c}", F.col(f"_last{c}").isNotNull()) for c in (0, 1)})

    def step(acc, note):
        was = F.when(note.color == 0, acc.red).otherwise(acc.blue)
        same = F.coalesce(~is_neutral(was) & ~is_neutral(note.direction) & (parity_class(was) == parity_class(note.direction)), F.lit(False))
        return F.struct(
            F.when(note.color == 0, note.direction).otherwise(acc.red).alias("red"), F.when(note.color == 1, note.direction).otherwise(acc.blue).alias("blue"),
            (acc.n + same.cast("int")).alias("n"))

    start = F.struct(F.col("_was0").cast("int").alias("red"), F.col("_was1").cast("int").alias("blue"), F.lit(0).alias("n"))
    return d.withColumn(out, F.aggregate(note_tuples("tokens"), start, step, lambda a: a.n)).drop(*lasts, "_was0", "_was1")


# ---- lighting --------------------------------------------------------------
def encode_lights(lights: DataFrame, boosts: DataFrame | None = None, keys=("map_id",)) -> DataFrame:
    """Lighting token array per beat; basic events first, each in document order."""
    b = lights.select(
        *keys, "beat", F.lit(0).alias("rank"), "seq",
        F.array(F.lit(K.LIGHT_BASIC), _tok(K.LIGHT_TYPE, clamp("event_type", 0, 14)), _tok(K.LIGHT_VALUE, clamp("value", 0, 7)), _tok(K.LIGHT_BRIGHT, quantize(F.col("float_value"), K.BRIGHT_BINS))).alias("tokens"),
    )
    if boosts is not None:
        b = b.unionByName(boosts.select(*keys, "beat", F.lit(1).alias("rank"), "seq", F.array(F.lit(K.LIGHT_BOOST), _tok(K.LIGHT_ONOFF, F.col("boost").cast("int"))).alias("tokens")))
    g = b.repartition(*keys, "beat").groupBy(*keys, "beat").agg(F.array_sort(F.collect_list(F.struct("rank", "seq", "tokens"))).alias("ev"))
    return g.select(*keys, "beat", join_tokens(F.transform("ev", lambda e: e.tokens)).alias("tokens"))


def decode_lights(tokens: DataFrame, keys=("map_id",)) -> DataFrame:
    """Lighting tokens back to events; ``kind`` is basic or boost."""
    size = {K.LIGHT_BASIC: 4, K.LIGHT_BOOST: 2}
    starts = event_starts("tokens", size, size, eos_ends=True, short_ends=True)
    e = tokens.select(*keys, "beat", "tokens", F.posexplode(starts).alias("ord", "at"))
    basic = F.get("tokens", F.col("at")) == K.LIGHT_BASIC

    def attr(k, r):
        return clamp(F.get("tokens", F.col("at") + k) - r[0], 0, r[1] - 1)

    return e.select(
        *keys, "beat", "ord", F.when(basic, "basic").otherwise("boost").alias("kind"),
        F.when(basic, attr(1, K.LIGHT_TYPE)).alias("event_type"), F.when(basic, attr(2, K.LIGHT_VALUE)).alias("value"),
        F.when(basic, dequantize(attr(3, K.LIGHT_BRIGHT), K.BRIGHT_BINS)).alias("float_value"),
        F.when(~basic, attr(1, K.LIGHT_ONOFF) == 1).alias("boost"),
    )
