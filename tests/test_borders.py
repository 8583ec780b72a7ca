"""Rules that feed on their own output, over saturated groups: no task may hold such a group whole."""

import random

import pytest
from pyspark.sql import functions as F

from levelloom.operators import repair, series
from levelloom.plans import ordered


def suppressed(peaks, reach):
    """One map, best first, peaks as (frame, prob)."""
    kept = []
    for f, _ in sorted(peaks, key=lambda r: (-r[1], r[0])):
        if all(abs(f - k) >= reach for k in kept):
            kept.append(f)
    return kept


def test_suppression_of_saturated_maps(spark):
    r = random.Random(4)
    maps = {
        1: [(f, 1.0) for f in range(700)],  # all equal: one chain through the whole map
        2: [(f, f / 700) for f in range(700)],  # rising: the chain runs backwards
        3: [(f, -f / 700) for f in range(700)],
        4: [(f, r.choice([0.2, 0.5, 0.9])) for f in range(900)],
        5: [(f, r.random()) for f in range(0, 900) if r.random() < 0.4],
        6: [(f, abs(450 - f) / 450) for f in range(900)],
        7: [(f, 1 - abs(450 - f) / 450) for f in range(900) if f % 7],
        8: [(5, 0.1)], 9: [(8 * i + j, 0.5) for i in range(30) for j in (0, 7)],
    }
    d = spark.createDataFrame([(m, f, p) for m, ps in maps.items() for f, p in ps], "map_id long, frame int, prob double")
    for reach, width in ((5, 8), (4, 64), (1, 16), (12, 12), (5, 2048)):
        got = series.suppress_close(d, reach, width=width).collect()
        for m, ps in maps.items():
            assert sorted(x.frame for x in got if x.map_id == m) == sorted(suppressed(ps, reach)), (m, reach, width)


def test_suppression_takes_the_best_of_one_frame_and_no_rows(spark):
    d = spark.createDataFrame([(1, 3, 0.2), (1, 3, 0.9), (1, 5, 0.5), (1, None, 0.5), (1, 40, None)], "map_id long, frame int, prob double")
    assert [x.frame for x in series.suppress_close(d, 4).collect()] == [3]
    assert series.suppress_close(d.where("false"), 4).count() == 0


def walked(values):
    out = []
    for v in values:
        out.append(v if not out else repair.limited(v, out[-1]))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_composed_limiter_is_the_walk(seed):
    r = random.Random(seed)
    pool = [[0.0, 1.0], [0.0, 0.3, 0.9, 1.5], [5.0, -5.0], [0.1 * i for i in range(11)], [-1.0, 0.5, 2.0]][seed % 5]
    for _ in range(300):
        values = [r.choice(pool) if r.random() < 0.9 else r.random() for _ in range(r.randint(1, 30))]
        f = repair.Limiter()
        for v in values:
            f.then(v)
        assert len(f.pieces) <= 16
        for p in [0.0, 1.0, 0.4, 0.6, r.random(), 1.5, -0.2, round(r.random(), 2)]:
            q = p
            for v in values:
                q = repair.limited(v, q)
            assert f(p) == q


def test_flickering_channel_is_limited_slice_by_slice(spark):
    r = random.Random(9)
    chan = {
        (1, 0): [float(i % 2) for i in range(3000)],  # never settles
        (1, 1): [[5.0, -5.0][i % 2] for i in range(700)],
        (2, 0): [r.choice([0.0, 0.25, 1.0, 1.5]) for _ in range(900)],
        (2, 4): [r.random() for _ in range(400)],
        (3, 0): [2.5],
    }
    rows = [(m, t, i / 4, i, v) for (m, t), vs in chan.items() for i, v in enumerate(vs)] + [(3, 0, 1.0, 99, None)]
    d = spark.createDataFrame(rows, "map_id long, event_type int, beat double, seq int, float_value double").withColumn("other", F.lit("x"))
    got = repair.smooth_lights(d)
    assert got.columns == d.columns
    by = {(x.map_id, x.event_type, x.seq): x.float_value for x in got.collect()}
    for (m, t), vs in chan.items():
        assert [by[m, t, i] for i in range(len(vs))] == walked(vs)
    assert by[3, 0, 99] is None and len(by) == len(rows)


def test_stream_folds_hold_no_rows(spark):
    class Count(ordered.Fold):
        n = 0

        def row(self, row):
            self.n += 1
            return ()

        def end(self):
            yield (*self.key, self.n)

    d = spark.range(50_000).select((F.col("id") % 3).alias("g"), "id")
    assert sorted(map(tuple, ordered.stream_folds(d, ["g"], ["id"], Count, "g long, n long").collect())) == [(0, 16667), (1, 16667), (2, 16666)]


def matched(preds, truths, tolerance):
    free, n = sorted(truths), 0
    for x in sorted(preds):
        best = min(free, key=lambda t: (abs(t - x), t), default=None)
        if best is not None and abs(best - x) <= tolerance:
            free.remove(best)
            n += 1
    return n


def test_onset_matching_of_saturated_groups(spark, monkeypatch):
    from levelloom.operators import reports

    r = random.Random(11)
    groups = {
        1: (range(400), range(400)),
        2: ([0, 0, *range(400)], range(400)),  # one pair too many pushes all others on
        3: (range(1, 400), [*range(400), 77]),
        4: ([i for i in range(400) if r.random() < 0.7], [i for i in range(400) if r.random() < 0.6]),
        5: ([r.randrange(200) for _ in range(500)], [r.randrange(200) for _ in range(300)]),
        6: ([7], []), 7: ([], [7]), 8: ([3, 500], [6, 497, 503]),
        9: ([i / 10 for i in range(900)], [i / 10 + r.choice([0.0, 0.05, 0.3]) for i in range(0, 900, 2)]),
        10: ([r.uniform(0, 60) for _ in range(300)], [r.uniform(0, 60) for _ in range(300)]),
    }
    p = spark.createDataFrame([(g, float(x)) for g, (ps, _) in groups.items() for x in ps], "g long, at double")
    t = spark.createDataFrame([(g, float(x)) for g, (_, ts) in groups.items() for x in ts], "g long, at double")
    for tolerance, width, states in ((3.0, 16.0, 512), (3.0, None, 512), (1.0, 5.0, 4), (0.5, 8.0, 512), (0.0, 3.0, 2)):
        monkeypatch.setattr(reports, "MAX_STATES", states)
        got = {x.g: x.tp for x in reports.onset_matches(p, t, ["g"], "at", tolerance, width).collect()}
        for g, (ps, ts) in groups.items():
            assert got.get(g, 0) == matched(list(ps), list(ts), tolerance), (g, tolerance, width)


def paired(heads, tails):
    """One hand, rows (beat, ord, x, y): every head in order takes the cheapest tail left."""
    free, out = sorted(tails), []
    for h in sorted(heads):
        if not free:
            break
        cost = [abs(t[0] - h[0]) + (1000.0 if t[0] < h[0] else 0.0) + (abs(t[2] - h[2]) + abs(t[3] - h[3])) * 0.01 for t in free]
        t = free.pop(min(range(len(cost)), key=cost.__getitem__))
        out.append((h[0], h[1], t[0], t[1]))
    return sorted(out)


def test_arc_pairing_of_long_and_crowded_hands(spark):
    from levelloom.operators import tokens

    r = random.Random(5)

    def ends(beats, base):
        return [(b, base + i, r.randrange(4), r.randrange(3)) for i, b in enumerate(beats)]

    grid = [i / 4 for i in range(600)]
    hands = [
        (ends([0.0, *grid], 0), ends([b + 0.25 for b in grid], 5000)),  # one head too many: the line never empties
        (ends(grid, 0), ends([0.0, *grid], 5000)),
        (ends([r.choice(grid) for _ in range(300)], 0), ends([r.choice(grid) for _ in range(300)], 5000)),
        (ends([r.choice(grid[:40]) for _ in range(200)], 0), ends([r.choice(grid[:40]) for _ in range(260)], 5000)),
        (ends([r.choice(grid[:40]) for _ in range(260)], 0), ends([r.choice(grid[:40]) for _ in range(200)], 5000)),
        (ends([150.0, 151.0, 160.0], 0), ends([1.0, 1.0, 1.03, 100.0], 5000)),  # all tails before all heads
        (ends([0.5, 1.02, 1.5, *[2 + b for b in grid]], 0), ends([1.0, 1.03, 1.9, *[3 + b for b in grid]], 5000)),  # a head between rivals
        (ends([r.uniform(0, 30) for _ in range(200)], 0), ends([r.uniform(0, 30) for _ in range(190)], 5000)),
        (ends([b / 50 for b in range(300)], 0), ends([b / 50 + 0.3 for b in range(300)], 5000)),
        (ends([3.0], 0), []), ([], ends([3.0], 0)),
    ]
    rows = []
    for i, (hs, ts) in enumerate(hands):
        rows += [(i, "Expert", i % 2, b, o, "arc_start", x, y, o, 0.5, None) for b, o, x, y in hs]
        rows += [(i, "Expert", i % 2, b, o, "arc_end", x, y, o, 0.25, 1) for b, o, x, y in ts]
    d = spark.createDataFrame(rows, "map_id long, difficulty string, color int, beat double, ord int, kind string, x int, y int, direction int, mu double, mid_anchor int")
    got = tokens.pair_arcs(d).collect()
    for i, (hs, ts) in enumerate(hands):
        assert sorted((g.beat, g.direction, g.tail_beat, g.tail_direction) for g in got if g.map_id == i) == paired(hs, ts), i
