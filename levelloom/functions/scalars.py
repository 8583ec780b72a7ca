"""Column functions: text, hashing, time, quantisation and swing lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from levelloom import constants as K


def _c(v) -> Column:
    return F.col(v) if isinstance(v, str) else v if isinstance(v, Column) else F.lit(v)


# ---- text, hashing, dates --------------------------------------------------
def slug(name) -> Column:
    """Lower-case identifier: other characters become one underscore, ends trimmed."""
    return F.lower(F.regexp_replace(F.regexp_replace(_c(name), "[^A-Za-z0-9_-]+", "_"), "^_+|_+$", ""))


def md5_mod(value, m: int) -> Column:
    """MD5 of the text as a 128-bit number, modulo ``m`` (Horner over 32-bit words)."""
    digest = F.md5(_c(value).cast("binary"))
    r = F.lit(0).cast("long")
    for i in range(4):
        word = F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")
        r = (r * (2**32 % m) + word) % m
    return r


def hash_order(*values) -> Column:
    """An order by chance that other engines can compute: 60 bits of the MD5 of the texts, joined by slashes."""
    digest = F.md5(F.concat_ws("/", *[_c(v).cast("string") for v in values]).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def split_percent(value, train: float = 0.85, val: float = 0.10) -> Column:
    """Split by hash percentile; borders are whole percents."""
    h = md5_mod(value, 100)
    return F.when(h < int(train * 100), "train").when(h < int((train + val) * 100), "val").otherwise("test")


def split_fine(value, train: float = 0.85, val: float = 0.10) -> Column:
    """Split by hash in ten-thousandths."""
    h = md5_mod(value, 10000) / 10000.0
    return F.when(h < train, "train").when(h < train + val, "val").otherwise("test")


def content_id(pairs: Sequence[tuple[str, Column]]) -> Column:
    """First 12 hex digits of the SHA-256 of a key-sorted JSON object.

    ``pairs`` holds (key, already JSON-rendered value); separators are ", " and ": ".
    """
    body = F.concat_ws(", ", *[F.concat(F.lit(f'"{k}": '), F.coalesce(v, F.lit("null"))) for k, v in sorted(pairs, key=lambda p: p[0])])
    return F.substring(F.sha2(F.concat(F.lit("{"), body, F.lit("}")), 256), 1, 12)


def upload_year(uploaded) -> Column:
    return F.substring(_c(uploaded), 1, 4).try_cast("int")


def failure_class(text, timed_out) -> Column:
    """timeout / oom / error from a run log; the markers are searched in the whole text."""
    oom = F.lit(False)
    for marker in K.OUT_OF_MEMORY_MARKERS:
        oom = oom | F.coalesce(_c(text).contains(marker), F.lit(False))
    return F.when(_c(timed_out), "timeout").when(oom, "oom").otherwise("error")


# ---- lookups ---------------------------------------------------------------
def lookup(table: dict, key, default) -> Column:
    """Literal map lookup with a default."""
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(m, _c(key)), F.lit(default))


def difficulty_id(name) -> Column:
    return lookup(K.DIFFICULTY_ID, name, 3)


def genre_id(name) -> Column:
    return lookup(K.GENRE_ID, name, 0)


def parity_class(direction) -> Column:
    d = _c(direction)
    return F.when(d.isin(*K.FOREHAND), "fore").when(d.isin(*K.BACKHAND), "back").otherwise("neutral")


def is_neutral(direction) -> Column:
    return ~_c(direction).isin(*K.FOREHAND, *K.BACKHAND)


def alternates(prev_direction, direction) -> Column:
    """Whether ``direction`` is a listed follow-up of ``prev_direction`` (0-7)."""
    table = F.create_map(*[x for d, s in K.ALTERNATIONS.items() for x in (F.lit(d), F.array(*[F.lit(v) for v in s]))])
    return F.array_contains(F.try_element_at(table, _c(prev_direction)), _c(direction))


def axis(direction) -> Column:
    """Swing axis shared by a direction and its opposite; null for dots."""
    m = F.create_map(*[F.lit(x) for kv in K.AXIS.items() for x in kv])
    return F.try_element_at(m, _c(direction))


def direction_vector(direction) -> tuple[Column, Column]:
    xs = F.array(*[F.lit(v[0]) for v in K.DIRECTION_VECTORS])
    ys = F.array(*[F.lit(v[1]) for v in K.DIRECTION_VECTORS])
    return F.get(xs, _c(direction)), F.get(ys, _c(direction))


def direction_name(direction) -> Column:
    return F.get(F.array(*[F.lit(n) for n in K.DIRECTION_NAMES]), _c(direction))


def _flow_table() -> list[int]:
    """Swing choice for (forehand?, x 0-3, next dx -3..3 or none=4, y 0-2), flattened.

    Lateral moves lean towards the next note: always from two columns on, for one
    column only where x+y is even. Otherwise outer columns lean inwards on even rows
    and swing straight on the middle row; inner columns swing straight except at the
    far row for the swing (top for forehand, bottom for backhand).
    """
    straight, right, left = {True: 1, False: 0}, {True: 7, False: 5}, {True: 6, False: 4}
    out = []
    for fore in (False, True):
        for x in range(4):
            inward = right[fore] if x < 2 else left[fore]
            for dx in (-3, -2, -1, 0, 1, 2, 3, None):
                for y in range(3):
                    lateral = dx is not None and (abs(dx) >= 2 or (abs(dx) == 1 and (x + y) % 2 == 0))
                    if lateral:
                        out.append(right[fore] if dx > 0 else left[fore])
                    elif x in (0, 3):
                        out.append(inward if y % 2 == 0 else straight[fore])
                    else:
                        out.append(inward if y == (2 if fore else 0) else straight[fore])
    return out


def flow_direction(need_forehand, x, next_x, y) -> Column:
    """Swing direction for the wanted hand side from the note's cell and the next column."""
    table = F.array(*[F.lit(v) for v in _flow_table()])
    dx = F.coalesce(_c(next_x) - _c(x) + 3, F.lit(7))
    i = ((_c(need_forehand).cast("int") * 4 + _c(x)) * 8 + dx) * 3 + _c(y)
    return F.get(table, i.cast("int"))


def token_weight(token, rhythm=3.0, eos=1.0, rare=1.0, bomb=1.0) -> Column:
    """Per-token weight: rhythm tokens heavier, padding weightless."""
    t = _c(token)
    return (
        F.when(t == K.PAD, 0.0).when(t == K.EOS, eos).when(t == K.BOMB, rhythm * bomb)
        .when(t.isin(K.ARC_START, K.ARC_END, K.CHAIN), rhythm * rare)
        .when(t.isin(K.SEP, K.NOTE, K.WALL), rhythm).otherwise(1.0)
    )


# ---- time ------------------------------------------------------------------
def seconds_to_frame(sec, sample_rate=K.SAMPLE_RATE, hop=K.HOP_LENGTH) -> Column:
    return F.rint(_c(sec) * float(sample_rate) / float(hop)).cast("long")


def beat_to_frame(beat, bpm, offset=0.0, sample_rate=K.SAMPLE_RATE, hop=K.HOP_LENGTH) -> Column:
    return seconds_to_frame(_c(beat) * 60.0 / _c(bpm) + _c(offset), sample_rate, hop)


def frame_to_beat(frame, bpm, offset=0.0, sample_rate=K.SAMPLE_RATE, hop=K.HOP_LENGTH) -> Column:
    return (_c(frame) * float(hop) / float(sample_rate) - _c(offset)) * _c(bpm) / 60.0


def frames_seconds(n_frames, sample_rate=K.SAMPLE_RATE, hop=K.HOP_LENGTH) -> Column:
    return _c(n_frames) * float(hop) / float(sample_rate)


def snap_frame(frame, bpm, subdivision=8, sample_rate=K.SAMPLE_RATE, hop=K.HOP_LENGTH) -> Column:
    """Nearest beat-grid frame, ties to the lower; unchanged where the grid is finer than a frame."""
    g = (F.lit(60.0) / _c(bpm)) * float(sample_rate) / float(hop) / float(subdivision)
    k = F.floor(_c(frame) / g)
    lower, upper = k * g, (k + 1) * g
    near = F.when(_c(frame) - lower <= upper - _c(frame), lower).otherwise(upper)
    return F.when((_c(bpm) <= 0) | (g < 1), _c(frame)).otherwise(F.rint(near)).cast("long")


def beat_strength(beat) -> Column:
    f = F.pmod(_c(beat), F.lit(1.0))

    def close(v):
        return F.abs(f - v) < 0.01

    return F.when(close(0.0) | close(1.0), 1.0).when(close(0.5), 0.75).when(close(0.25) | close(0.75), 0.5).otherwise(0.25)


# ---- numbers ---------------------------------------------------------------
def clamp(v, lo, hi) -> Column:
    return F.greatest(_c(lo), F.least(_c(hi), _c(v)))


def quantize(value, bins: Sequence[float]) -> Column:
    """Index of the nearest of ascending bins; ties go to the lower index.

    Evenly spaced bins: the bin at or below the value, or the next if strictly closer.
    Others (few): one step up for every bin that is strictly closer than the one before.
    """
    v, n = _c(value), len(bins)
    step = (bins[-1] - bins[0]) / (n - 1)
    if any(abs(b - bins[0] - i * step) > 1e-9 for i, b in enumerate(bins)):
        closer = [(F.abs(v - float(b)) < F.abs(v - float(a))).cast("int") for a, b in zip(bins, bins[1:])]
        return sum(closer[1:], closer[0])
    at = F.array(*[F.lit(float(b)) for b in bins])
    k = F.greatest(F.lit(0), F.least(F.lit(n - 2), F.floor((v - float(bins[0])) / float(step)).cast("int")))
    return k + (F.abs(v - F.get(at, k + 1)) < F.abs(v - F.get(at, k))).cast("int")


def dequantize(index, bins: Sequence[float]) -> Column:
    return F.get(F.array(*[F.lit(float(b)) for b in bins]), clamp(_c(index), 0, len(bins) - 1).cast("int"))


def log_floor(v, floor: float = 1e-9) -> Column:
    return F.log(F.greatest(_c(v), F.lit(floor)))


def density_score(n) -> Column:
    n = _c(n)
    return F.when(n < 40, n / 40.0).when(n > 2000, F.greatest(F.lit(0.0), 1.0 - (n - 2000) / 2000.0)).otherwise(1.0)


def pad_tokens(tokens, n: int) -> Column:
    """Cut or zero-pad to ``n`` entries and clamp ids to the vocabulary."""
    t = F.slice(F.concat(_c(tokens), F.array_repeat(F.lit(0), n)), 1, n)
    fits = (F.array_min(t) >= 0) & (F.array_max(t) < K.VOCAB_SIZE)
    return F.when(fits, t).otherwise(F.transform(t, lambda v: clamp(v, 0, K.VOCAB_SIZE - 1)))


def palette_color(palette, energy) -> Column:
    """RGB array interpolated along the named palette's five stops; unknown names use the default."""
    stops = F.create_map(*[
        x for name, ps in K.PALETTES.items()
        for x in (F.lit(name), F.array(*[F.array(*[F.lit(v) for v in p]) for p in ps]))
    ])
    p = F.coalesce(F.try_element_at(stops, _c(palette)), F.try_element_at(stops, F.lit("synthwave")))
    at = clamp(energy, 0.0, 1.0) * 4
    lo = F.floor(at).cast("int")
    hi = F.least(lo + 1, F.lit(4))
    t = at - lo
    return F.zip_with(F.get(p, lo), F.get(p, hi), lambda a, b: a + (b - a) * t)


def hue_shifted(rgb, event_type) -> Column:
    s = (_c(event_type) % 5) * 0.04 - 0.08
    return F.array(
        clamp(F.get(rgb, F.lit(0)) + s * 0.5, 0.0, 1.0),
        clamp(F.get(rgb, F.lit(1)) - s * 0.3, 0.0, 1.0),
        clamp(F.get(rgb, F.lit(2)) + s * 0.2, 0.0, 1.0),
    )
