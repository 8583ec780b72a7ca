"""The sliced scans against brute force: any slice width, one huge group included."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from levelloom.plans.ordered import Track, asof, fold_runs, islands, position, scan, with_halo


def rows(n=400, seed=1):
    rnd = random.Random(seed)
    # two thirds of all rows sit in one group, many on equal beats
    return [(0 if rnd.random() < 0.66 else rnd.randint(1, 4), rnd.randint(0, 160) / 8, i, rnd.randint(0, 8), rnd.choice([None, 1, 2])) for i in range(n)]


def frame(spark, data):
    return spark.createDataFrame(data, "g int, beat double, seq int, d int, maybe int")


@pytest.mark.parametrize("width", [0.5, 4, 1000])
def test_scan_matches_brute_force(spark, width):
    data = rows()
    t = Track(("g",), ("beat", "seq"), f"floor(beat / {width})")
    odd = F.col("d") % 2 == 1
    got = scan(frame(spark, data), t, prev={"p": "d", "pm": "maybe", "po": ("d", odd)}, upto={"uo": ("d", odd)}, nxt={"n": "d", "no": ("d", odd)}, sums={"s": F.col("d").cast("long")})
    got = {r.seq: r for r in got.collect()}
    for g in {r[0] for r in data}:
        run = sorted((r for r in data if r[0] == g), key=lambda r: (r[1], r[2]))
        for i, r in enumerate(run):
            x = got[r[2]]
            odd_before = [q[3] for q in run[:i] if q[3] % 2]
            odd_after = [q[3] for q in run[i + 1:] if q[3] % 2]
            assert x.p == (run[i - 1][3] if i else None)
            assert x.pm == (run[i - 1][4] if i else None)  # a null neighbour is not skipped
            assert x.po == (odd_before[-1] if odd_before else None)
            assert x.uo == (r[3] if r[3] % 2 else x.po)
            assert x.n == (run[i + 1][3] if i + 1 < len(run) else None)
            assert x.no == (odd_after[0] if odd_after else None)
            assert x.s == sum(q[3] for q in run[: i + 1])


def test_position_and_islands(spark):
    data = rows(200, 2)
    t = Track(("g",), ("beat", "seq"), "floor(beat / 2)")
    d = position(frame(spark, data), t)
    d = islands(scan(d, t, prev={"was": "d"}), t, F.col("was") != F.col("d"), "run").toPandas()
    for _, g in d.groupby("g"):
        g = g.sort_values(["beat", "seq"])
        assert g["pos"].tolist() == list(range(1, len(g) + 1))
        assert g["run"].tolist() == (g["d"] != g["d"].shift()).cumsum().tolist()


@pytest.mark.parametrize("direction,strict", [("backward", False), ("backward", True), ("forward", False), ("forward", True), ("nearest", False)])
def test_asof_matches_brute_force(spark, direction, strict):
    left, right = rows(120, 3), rows(90, 4)
    got = asof(frame(spark, left), frame(spark, right).select("g", "beat", "seq", F.col("d").alias("rd")), ["g"], "beat", ["rd"],
               slice="floor(beat / 3)", direction=direction, strict=strict, tie="seq")
    got = {r.seq: (r.match_beat, r.rd) for r in got.collect()}
    assert len(got) == len(left)
    for g, b, seq, *_ in left:
        cand = [r for r in right if r[0] == g]
        if direction == "backward":
            cand = [r for r in cand if r[1] < b or (r[1] == b and not strict)]
            best = min(cand, key=lambda r: (-r[1], r[2]), default=None)
        elif direction == "forward":
            cand = [r for r in cand if r[1] > b or (r[1] == b and not strict)]
            best = min(cand, key=lambda r: (r[1], r[2]), default=None)
        else:
            best = min(cand, key=lambda r: (abs(r[1] - b), r[1], r[2]), default=None)
        assert got[seq] == ((best[1], best[3]) if best else (None, None))


def test_asof_tolerance_is_exclusive(spark):
    l = spark.createDataFrame([(1, 1.0), (1, 5.0)], "g int, t double")
    r = spark.createDataFrame([(1, 2.0, 7)], "g int, t double, v int")
    got = {x.t: x.v for x in asof(l, r, ["g"], "t", ["v"], slice="floor(t)", direction="nearest", tolerance=1.0, tie="v").collect()}
    assert got == {1.0: None, 5.0: None}


def test_halo_gives_every_row_its_neighbours(spark):
    from pyspark.sql import Window as W

    d = with_halo(spark.range(1, 101).select(F.lit(1).alias("g"), F.col("id").alias("pos")), ["g"], "pos", before=3, after=2, block=8)
    w = W.partitionBy("g", "_block").orderBy("pos").rowsBetween(-3, 2)
    got = {r.pos: r.near for r in d.withColumn("near", F.collect_list("pos").over(w)).where("not _copy").collect()}
    assert got == {p: [q for q in range(p - 3, p + 3) if 1 <= q <= 100] for p in range(1, 101)}


def test_fold_runs_sees_each_run_whole(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        d = frame(spark, rows(300, 5))

        def step(pdf):
            return pdf.groupby("g", as_index=False).agg(n=("seq", "size")).astype({"n": "int64"})

        got = fold_runs(d.select("g", "beat", "seq"), ["g"], ["beat", "seq"], step, "g int, n bigint").toPandas()
        want = pd.Series([r[0] for r in rows(300, 5)]).value_counts().to_dict()
        assert dict(zip(got["g"], got["n"])) == want and len(got) == len(want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_first_rows_are_exact_for_any_bucket(spark):
    from levelloom.plans.selecting import first_rows, smallest

    rows = [(g, (i * 7919 + g) % 1009, i) for g in (0, 1, 2) for i in range(300 * (g + 1))] + [(None, 5, i) for i in range(40)]
    d = spark.createDataFrame(rows, "g int, h long, i int").withColumn("g", F.coalesce("g", F.lit(9)))
    for n in (0, 1, 37, 300, 5000):
        got = sorted(map(tuple, smallest(d, ["g"], "h", n, ["i"]).collect()))
        want = []
        for g in (0, 1, 2, 9):
            mine = sorted((h, i) for k, h, i in rows if (9 if k is None else k) == g)
            want += [(g, h, i) for h, i in mine[:n]]
        assert got == sorted(want)
    whole = first_rows(d, [], 11, F.floor(F.col("i") / 4).cast("int"), [F.col("i"), F.col("h"), F.col("g")]).collect()
    assert sorted(map(tuple, whole)) == sorted(sorted(((9 if k is None else k, h, i) for k, h, i in rows), key=lambda r: (r[2], r[1], r[0]))[:11])
