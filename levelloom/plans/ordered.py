"""Ordered scans over groups of any size.

Most rules here look at neighbours in time inside one level. A plain window
``PARTITION BY map ORDER BY beat`` sends a whole map to one task, so one huge map
stalls the job. The scans below cut every group into slices of time first:

1. each (group, slice) is reduced to one small carry row (map-side combined),
2. a window over the carry rows alone gives each slice what came before/after it,
3. an ordinary window inside each slice does the row work, seeded by the carry.

The row data is shuffled once, by (group, slice); only carry rows are ever gathered
per group. Results do not depend on where the slice borders lie.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import StructType

from levelloom.session import Steps

SLICE = "_slice"


@dataclass(frozen=True)
class Track:
    """Rows of many groups in a total order; ``slice`` must not decrease along it."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    slice: str

    def by(self, *more: str) -> "Track":
        """The same order inside finer groups."""
        return replace(self, keys=(*self.keys, *more))


NOTES = Track(("map_id", "difficulty"), ("beat", "seq"), "floor(beat / 32)")
FRAMES = Track(("map_id",), ("frame",), "floor(frame / 1024)")
LIGHTS = Track(("map_id",), ("beat", "seq"), "floor(beat / 32)")

_FIRST, _LAST = W.unboundedPreceding, W.unboundedFollowing


def _pair(spec) -> tuple[Column, Column | None]:
    expr, cond = spec if isinstance(spec, tuple) else (spec, None)
    return (F.col(expr) if isinstance(expr, str) else expr), cond


def scan(
    df: DataFrame,
    track: Track,
    *,
    prev: Mapping[str, object] | None = None,
    upto: Mapping[str, object] | None = None,
    nxt: Mapping[str, object] | None = None,
    sums: Mapping[str, object] | None = None,
    lows: Mapping[str, object] | None = None,
) -> DataFrame:
    """Add neighbour values and running sums along ``track``.

    ``prev``/``nxt`` map an output name to ``expr`` or ``(expr, cond)``: the value of
    ``expr`` on the nearest earlier/later row (where ``cond`` holds). ``upto`` is
    ``prev`` that may also pick the row itself. ``sums`` are running sums and ``lows``
    running minima, up to and including the row. All outputs share one shuffle of the rows.
    """
    prev, upto, nxt, sums, lows = prev or {}, upto or {}, nxt or {}, sums or {}, lows or {}
    ks = [*track.keys, SLICE]
    order = [F.col(c) for c in track.order]
    back = [F.col(c).desc() for c in track.order]
    at = F.struct(*order)
    rows = df if track.slice == SLICE else df.withColumn(SLICE, F.expr(track.slice).cast("long"))
    part = W.partitionBy(*ks)

    def masked(cond, value):
        return value if cond is None else F.when(cond, value)

    # outputs with one direction and one condition travel together in one struct
    packs: list[tuple[str, Column | None, dict[str, Column]]] = []
    for how_, group in (("prev", prev), ("upto", upto), ("nxt", nxt)):
        for out, spec in group.items():
            expr, cond = _pair(spec)
            for kind, c, fields in packs:
                if kind == how_ and c is cond:
                    fields[out] = expr
                    break
            else:
                packs.append((how_, cond, {out: expr}))

    local, carries, seeds, final = {}, [], {}, []
    for i, (kind, cond, fields) in enumerate(packs):
        name = f"_p{i}"
        val = F.struct(*[e.alias(o) for o, e in fields.items()])
        back_w, fore_w = part.orderBy(*back), part.orderBy(*order)
        if kind == "upto":
            local[name] = F.last(masked(cond, val), True).over(fore_w.rowsBetween(_FIRST, 0))
        elif cond is None:
            local[name] = F.lag(val, 1).over(fore_w) if kind == "prev" else F.lead(val, 1).over(fore_w)
        else:
            local[name] = F.last(masked(cond, val), True).over((fore_w if kind == "prev" else back_w).rowsBetween(_FIRST, -1))
        pick = F.min_by if kind == "nxt" else F.max_by
        carries.append(pick(masked(cond, val), masked(cond, at)).alias(name))
        seeds[name] = "ahead" if kind == "nxt" else "back"
        final += [F.coalesce(F.col(f"_local_{name}"), F.col(f"_carry_{name}")).getField(o).alias(o) for o in fields]
    for out, spec in sums.items():
        expr, _ = _pair(spec)
        local[out] = F.sum(expr).over(part.orderBy(*order).rowsBetween(_FIRST, 0))
        carries.append(F.sum(expr).alias(out))
        seeds[out] = "sum"
        final.append((F.coalesce(F.col(f"_local_{out}"), F.lit(0)) + F.coalesce(F.col(f"_carry_{out}"), F.lit(0))).alias(out))
    for out, spec in lows.items():
        expr, _ = _pair(spec)
        local[out] = F.min(expr).over(part.orderBy(*order).rowsBetween(_FIRST, 0))
        carries.append(F.min(expr).alias(out))
        seeds[out] = "low"
        final.append(F.least(f"_local_{out}", f"_carry_{out}").alias(out))

    along = W.partitionBy(*track.keys).orderBy(SLICE).rowsBetween(_FIRST, -1)
    against = W.partitionBy(*track.keys).orderBy(F.col(SLICE).desc()).rowsBetween(_FIRST, -1)
    how = {
        "back": lambda c: F.last(c, True).over(along),
        "ahead": lambda c: F.last(c, True).over(against),
        "sum": lambda c: F.sum(c).over(along),
        "low": lambda c: F.min(c).over(along),
    }
    carry = rows.groupBy(*ks).agg(*carries).select(
        *ks, *[how[kind](out).alias(f"_carry_{out}") for out, kind in seeds.items()]
    )
    rows = rows.select("*", *[c.alias(f"_local_{o}") for o, c in local.items()]).join(carry.hint("merge"), ks, "left")  # carry rows grow with the input; the rows are sorted by these keys already

    made = {*prev, *upto, *nxt, *sums, *lows}
    return rows.select(*[c for c in df.columns if c not in made], *final)


def sliced(df: DataFrame, track: Track, steps: Steps, name: str) -> tuple[DataFrame, Track]:
    """``df`` stored in buckets by (group, slice), with the track along the stored rows.

    Scans along that track shuffle carry rows only, and leave the rows lying as they are, so
    what they give is stored again without a shuffle.
    """
    ks, n = [*track.keys, SLICE], int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if track.slice != SLICE:
        df = df.withColumn(SLICE, F.expr(track.slice).cast("long")).repartition(n, *ks)
    return steps.bucket(name, df, ks, n), replace(track, slice=SLICE)


def position(df: DataFrame, track: Track, out: str = "pos") -> DataFrame:
    """1-based row number along ``track``."""
    return scan(df, track, sums={out: F.lit(1).cast("long")})


def with_halo(df: DataFrame, keys: Sequence[str], pos: str, before: int = 0, after: int = 0, block: int = 256) -> DataFrame:
    """Cut numbered rows into blocks that also hold copies of their neighbours' edge rows.

    Adds ``_block`` and ``_copy``. Windows over (keys, _block) then see ``before`` rows
    back and ``after`` rows ahead of every original row; drop the copies afterwards.
    """
    if max(before, after) > block:
        raise ValueError("halo must not exceed the block")
    i, b = F.col(pos) - 1, F.floor((F.col(pos) - 1) / block)

    def place(blk, copy):
        return F.struct(blk.alias("_block"), F.lit(copy).alias("_copy"))

    homes = F.array(place(b, False), F.when(i % block >= block - before, place(b + 1, True)), F.when(i % block < after, place(b - 1, True)))
    return df.select("*", F.inline(F.filter(homes, lambda h: h.isNotNull())))


def islands(df: DataFrame, track: Track, changed: Column, out: str = "island") -> DataFrame:
    """Number runs of rows; a row where ``changed`` is true (or null) starts a new run."""
    return scan(df, track, sums={out: F.coalesce(changed.cast("int"), F.lit(1)).cast("long")})


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    on: str,
    cols: Sequence[str],
    *,
    slice: str,
    direction: str = "backward",
    strict: bool = False,
    tolerance: float | None = None,
    tie: str | None = None,
    unique: bool = False,
) -> DataFrame:
    """Nearest-in-order join; ``right`` columns come back as ``cols`` plus ``match_<on>``.

    ``tie`` names the right column whose smallest value wins among right rows at one
    position; ``unique`` says that there is one at most. ``nearest`` prefers the earlier side on equal distance. ``tolerance`` is
    exclusive. Left rows without a match keep nulls. Runs as one union and one
    sliced scan, never as a range join inside a key.
    """
    val = F.struct(F.col(on).alias("_on"), *[F.col(c) for c in cols])
    packed = F.min_by(val, F.col(tie)) if tie else F.first(val)
    r = right.select(*keys, on, val.alias("_right")) if unique else right.groupBy(*keys, on).agg(packed.alias("_right"))
    lcols = left.columns
    l = left.withColumn("_row", F.struct(*[F.col(c) for c in lcols]))
    l = l.select(*keys, on, "_row", F.lit(None).cast(r.schema["_right"].dataType).alias("_right"))
    r = r.select(*keys, on, F.lit(None).cast(l.schema["_row"].dataType).alias("_row"), "_right")
    # among equal positions, the side that may match comes first in scan direction
    left_rank = 0 if (direction != "forward") == strict else 1
    u = l.withColumn("_side", F.lit(left_rank)).unionByName(r.withColumn("_side", F.lit(1 - left_rank)))
    hit = F.col("_right").isNotNull()
    track = Track(tuple(keys), (on, "_side"), slice)
    want = {"backward": ["prev"], "forward": ["nxt"], "nearest": ["prev", "nxt"]}[direction]
    u = scan(u, track, **{w: {f"_{w}": (F.col("_right"), hit)} for w in want})
    u = u.where(F.col("_row").isNotNull())
    dist = {w: F.abs(F.col(f"_{w}._on") - F.col(on)) for w in want}
    if direction == "nearest":
        later = F.col("_prev").isNull() | (dist["nxt"] < dist["prev"])
        best = F.when(later & F.col("_nxt").isNotNull(), F.col("_nxt")).otherwise(F.col("_prev"))
    else:
        best = F.col(f"_{want[0]}")
    if tolerance is not None:
        best = F.when(F.abs(best.getField("_on") - F.col(on)) < tolerance, best)
    u = u.withColumn("_best", best)
    return u.select(
        *[F.col(f"_row.{c}").alias(c) for c in lcols],
        F.col("_best._on").alias(f"match_{on}"),
        *[F.col(f"_best.{c}").alias(c if c not in lcols else f"match_{c}") for c in cols],
    )


def fold_runs(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    step: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
) -> DataFrame:
    """Run ``step`` over each run of rows that share ``keys``, in ``order``.

    For rules whose input is their own output. ``keys`` must already cut groups into
    independent runs (see ``islands``), so a run is short even in a huge group. One
    shuffle and one sort; a task streams Arrow batches and holds one run at a time.
    """
    names = list(keys)

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if batch.empty:
                continue
            new_run = (batch[names] != batch[names].shift()).any(axis=1).to_numpy()
            if held and (held[-1][names].iloc[-1] == batch[names].iloc[0]).all():
                new_run[0] = False
            cuts = new_run.nonzero()[0].tolist()
            if not cuts:
                held.append(batch)
                continue
            held.append(batch.iloc[: cuts[0]])
            done = pd.concat(held)
            if len(done):
                yield step(done)
            if len(cuts) > 1:
                body = batch.iloc[cuts[0]: cuts[-1]]
                yield step(body)
            held = [batch.iloc[cuts[-1]:]]
        if held:
            yield step(pd.concat(held))

    return df.repartition(*names).sortWithinPartitions(*names, *order).mapInPandas(stream, schema)


class Fold:
    """What ``stream_folds`` does with the rows of one key: override ``row`` and ``end``.

    An instance lives for one key and sees its rows in order, so what it keeps is all the
    memory that the key takes. Both methods give out any number of result tuples.
    """

    def __init__(self, key: tuple):
        self.key = key

    def row(self, row: tuple) -> Iterable[tuple]:
        return ()

    def end(self) -> Iterable[tuple]:
        return ()


def stream_folds(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], fold: Callable[[tuple], Fold], schema: str, descending: bool = False) -> DataFrame:
    """Run one ``Fold`` per key over its rows in ``order``, without ever holding the rows of a key.

    Rows reach ``Fold.row`` as tuples in the column order of ``df``; result tuples follow
    ``schema``. One shuffle and one sort.
    """
    cols = df.columns
    at = [cols.index(k) for k in keys]
    names = [f.name for f in StructType.fromDDL(schema).fields]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names, dtype=object)

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        now: Fold | None = None
        for batch in batches:
            for row in zip(*[batch[c].tolist() for c in cols]):
                key = tuple(row[i] for i in at)
                if now is None or key != now.key:
                    if now is not None:
                        out.extend(now.end())
                    now = fold(key)
                out.extend(now.row(row))
                if len(out) >= 10_000:
                    yield frame(out)
                    out = []
        if now is not None:
            out.extend(now.end())
        if out:
            yield frame(out)

    sort = [F.col(o) if isinstance(o, str) else o for o in order]
    if descending:
        sort = [c.desc() for c in sort]
    return df.repartition(*keys).sortWithinPartitions(*keys, *sort).mapInPandas(stream, schema)


def key_schema(df: DataFrame, keys: Sequence[str]) -> str:
    """The DDL of some columns of ``df``."""
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
