"""Inputs on which a query once differed from its SQL twin."""

import datetime
import glob
import math

import duckdb

from levelloom.checks import REGISTRY
from levelloom.checks.series import _contents
from levelloom.operators import lighting as L, series as R, timing
from levelloom.session import scratch
from tests.oracle import compare, connect


def test_mean_on_a_limit_keeps_its_palette_whatever_the_sum_order(spark):
    values = (0.02, 1.37, 0.11)  # mean 0.5 exactly; summed in this order it comes out above
    assert (values[0] + values[1] + values[2]) / 3 > 0.5
    frames = spark.createDataFrame([(1, i, r, 0.6) for i, r in enumerate(values)], "map_id long, frame int, rms double, bass double").coalesce(1)
    genres = spark.createDataFrame([(1, None)], "map_id long, genre string")
    assert L.palette_names(frames, genres).first().palette == "rock"


def test_seconds_are_added_change_by_change(spark):
    beats = [float(b) for b in range(3, 900, 37)]  # over many slices of 64 beats
    tempi = [60.0 + b * 7 % 113 for b in beats]
    changes = spark.createDataFrame([(1, "Expert", b, t, i) for i, (b, t) in enumerate(zip(beats, tempi))], "map_id long, difficulty string, at_beat double, new_bpm double, seq long")
    maps = spark.createDataFrame([(1, 97.0)], "map_id long, bpm double")
    want, at, tempo, total = {}, 0.0, 97.0, 0.0
    for b, t in zip(beats, tempi):
        total += (b - at) * 60.0 / tempo
        want[b], at, tempo = total, b, t
    assert {r.at_beat: r.seconds for r in timing.tempo_segments(changes, maps).collect()} == want


def test_level_without_a_kind_counts_it_as_sql_does(spark, tmp_path):
    day = datetime.datetime(1995, 1, 9)
    rows = [(8, 4, 1, 1, 3.0, day), (9, 5, 1, 1, 3.0, day), (8, 1, 2, 1, 3.0, day)]  # map 1 has notes alone, map 2 a wall alone
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    q = REGISTRY["level_documents"]
    problem, n = compare(q.run(spark, str(tmp_path)), con, q.sql)
    assert (problem, n) == (None, 2)


def test_lights_of_all_maps_are_not_broadcast(spark):
    sections = spark.range(3000).selectExpr("id AS map_id", "0.0D AS start_beat", "64.0D AS end_beat", "'drop' AS section_type").repartition(2)
    notes = spark.range(6000).selectExpr("id % 3000 AS map_id", "if(id < 3000, 'Hard', 'Expert') AS difficulty", "'note' AS kind", "1.0D AS beat", "id AS seq").repartition(2)
    events = L.with_lights(notes, L.section_lights(sections))
    assert events.where("kind = 'light'").count() == 2 * 3000 * (64 * 6 + 32)
    grown = events.groupBy("map_id", "kind").count()
    grown.collect()
    assert "Broadcast" not in grown._jdf.queryExecution().executedPlan().toString()


def test_label_mass_does_not_drift(spark):
    labels = spark.range(50_000_000, numPartitions=1).selectExpr("id AS frame", "0.6D AS label")
    assert _contents({"labels": labels}).first().asDict() == {"t": "labels", "n": 50_000_000, "frames": 25_000_000 * 49_999_999, "content": 30_000_000_000}
    assert _contents({"labels": labels.where("false")}).first().asDict() == {"t": "labels", "n": 0, "frames": None, "content": None}


def test_labels_are_made_once_and_not_shuffled(spark):
    places = [0, 1, 1, 5, 30, 1000, 1023, 1024, 1047, 1048, 1072, 2047 - 24, 2048, 2100, 2124, 2149, 4000, 4003, 4095, 4200]
    onsets = spark.createDataFrame([(m, "Hard", f + m) for m in (0, 1) for f in places], "map_id long, difficulty string, frame long")
    maps = spark.createDataFrame([(0, 4100), (1, 2105)], "map_id long, n_frames int")
    want = {}
    for m, n in ((0, 4100), (1, 2105)):
        for o in (f + m for f in places if f + m < n):
            for f in range(max(0, o - 12), min(n - 1, o + 12) + 1):
                want[m, f] = max(want.get((m, f), 0.0), math.exp(-0.5 * ((f - o) / 3.0) ** 2))
    labels = R.onset_labels(onsets, maps)
    rows = labels.collect()
    assert len(rows) == len(want) and {(r.map_id, r.frame): round(r.label, 12) for r in rows} == {k: round(v, 12) for k, v in want.items()}
    plan = labels._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode(sequence" in plan and "Aggregate" not in plan.split("Generate explode(sequence")[0]


def test_log_is_written_in_pieces_and_read_in_line_order(spark):
    sf = "/root/testdata/sf0.001"
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before, parts = spark.conf.get(key, "true"), spark.conf.get("spark.sql.shuffle.partitions")
    seen = set(glob.glob(f"{scratch_root(spark)}/log-*"))
    spark.conf.set(key, "false")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        q = REGISTRY["log_scan"]
        problem, n = compare(q.run(spark, sf), connect(sf), q.sql)
    finally:
        spark.conf.set(key, before)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    folder, = set(glob.glob(f"{scratch_root(spark)}/log-*")) - seen
    assert problem is None and n > 0
    assert len(glob.glob(f"{folder}/part-*")) > 1


def scratch_root(spark):
    return scratch(spark, "x").rsplit("/", 1)[0].removeprefix("file:")
