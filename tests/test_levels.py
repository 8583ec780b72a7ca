"""Literal cases: documents, tokens, peaks, repair invariants, streaming lateness."""

import json
import zipfile

from pyspark.sql import functions as F

from levelloom.operators import lighting, repair, samples, series, tokens
from levelloom.operators.quality import quality_metrics
from levelloom.operators.reports import note_intervals, onset_scores
from levelloom.operators.timing import beat_frames
from levelloom.sources import documents as D, writers as Wr
from levelloom.streaming import jobs

V3 = {
    "version": "3.3.0",
    "colorNotes": [{"b": 3.25, "x": 2, "y": 1, "c": 1, "d": 4, "a": -30}, {"b": 3.25, "x": 0, "y": 2, "c": 0, "d": 7, "a": 45}, {"b": "6.75", "x": 3.0, "y": 0, "c": 1, "d": 2}],
    "bombNotes": [{"b": 5.5, "x": 1, "y": 1}],
    "obstacles": [{"b": 7.0, "d": 0.75, "x": 3, "y": 0, "w": 1, "h": 5}],
    "sliders": [{"c": 1, "b": 9.0, "x": 0, "y": 2, "d": 3, "mu": 0.6, "tb": 10.25, "tx": 3, "ty": 0, "tc": 8, "tmu": 1.2, "m": 2}],
    "burstSliders": [{"c": 0, "b": 12.0, "x": 1, "y": 1, "d": 5, "tb": 12.5, "tx": 0, "ty": 0, "sc": 4, "s": 0.9}],
    "basicBeatmapEvents": [{"b": 0.5, "et": 4, "i": 6}],
    "colorBoostBeatmapEvents": [{"b": 0.25, "o": True}],
}
V2 = {
    "_version": "2.2.0",
    "_notes": [
        {"_time": 4.0, "_lineIndex": 1, "_lineLayer": 0, "_type": 0, "_cutDirection": 1}, {"_time": 4.5, "_lineIndex": 9, "_lineLayer": -2, "_type": 1, "_cutDirection": 0},
        {"_time": 5.0, "_lineIndex": 2, "_lineLayer": 1, "_type": 3}, {"_time": 6.0, "_lineIndex": 2, "_type": 0, "_customData": {"_fake": True}}, {"_time": 6.5, "_type": 2},
    ],
    "_obstacles": [{"_time": 8.0, "_lineIndex": 0, "_type": 0, "_duration": 1.0, "_width": 1}, {"_time": 9.0, "_lineIndex": 1, "_type": 1, "_duration": 2.0, "_width": 7}],
    "_events": [{"_time": 0.0, "_type": 1, "_value": 3}],
    "_customData": {"_BPMChanges": [{"_BPM": 140, "_time": 16.0}]},
}


def docs(spark, *items):
    return spark.createDataFrame([(i, "Expert", t if isinstance(t, str) else json.dumps(t)) for i, t in enumerate(items)], "map_id bigint, difficulty string, text string")


def test_v3_document(spark):
    e = {(r.kind, r.seq): r for r in D.level_events(D.parse_levels(docs(spark, V3))).collect()}
    assert len(e) == 9
    assert (e["note", 1].angle_offset, e["note", 2].beat, e["note", 2].angle_offset, e["note", 2].x) == (45, 6.75, 0, 3)
    assert (e["wall", 0].duration, e["wall", 0].height) == (0.75, 5)
    a, c = e["arc", 0], e["chain", 0]
    assert (a.mu, a.tail_mu, a.tail_beat, a.mid_anchor, a.tail_direction) == (0.6, 1.2, 10.25, 2, 8)
    assert (c.slice_count, c.squish, c.tail_y) == (4, 0.9, 0)
    assert e["light", 0].float_value == 1.0 and e["boost", 0].boost is True


def test_v2_document(spark):
    d = docs(spark, V2)
    e = D.level_events(D.parse_levels(d)).collect()
    notes = sorted((r.beat, r.x, r.y, r.color) for r in e if r.kind == "note")
    assert notes == [(4.0, 1, 0, 0), (4.5, 3, 0, 1)]
    assert [(r.beat, r.x) for r in e if r.kind == "bomb"] == [(5.0, 2)]
    assert sorted((r.y, r.height, r.width) for r in e if r.kind == "wall") == [(0, 5, 1), (2, 3, 4)]
    assert [r.float_value for r in e if r.kind == "light"] == [1.0]
    assert [(r.at_beat, r.new_bpm) for r in D.tempo_changes(D.parse_levels(d)).collect()] == [(16.0, 140.0)]


def test_rejects(spark):
    null_value = {**V3, "colorNotes": [{"b": None, "x": 1}]}
    harmless = {**V3, "colorNotes": [{"b": 1.0, "customData": {"b": None}}]}
    p = D.parse_levels(docs(spark, {"colorNotes": []}, "not json", null_value, {**V3, "bombNotes": [{"b": "x"}]}, harmless, {"version": "3.0.0"}, "{}"))
    got = {r.map_id: r.reject for r in D.rejects(p).collect()}
    assert got == {0: "no_version", 1: "unreadable", 2: "bad_value", 3: "bad_value", 6: "no_version"}
    assert {r.map_id for r in D.level_events(p).select("map_id").distinct().collect()} == {4}


def test_archives(spark, tmp_path):
    for i, name in ((1, "Info.dat"), (2, "deep/INFO.DAT")):
        with zipfile.ZipFile(tmp_path / f"{i}.zip", "w") as z:
            z.writestr("song.egg", b"\x00")
            z.writestr(name, json.dumps({"_beatsPerMinute": 128}))
    via_source = D.read_archives(spark, str(tmp_path))
    via_files = D.archive_members(D.archive_files(spark, str(tmp_path)))
    for m in (via_source, via_files):
        info = D.parse_info(D.find_member(m, "info.dat")).collect()
        assert sorted((r.map_id, r.bpm, r.environment_name) for r in info) == [("1", 128.0, "DefaultEnvironment"), ("2", 128.0, "DefaultEnvironment")]


def test_documents_round_trip_and_fragments(spark):
    e = D.level_events(D.parse_levels(docs(spark, V3)))
    doc = json.loads(Wr.level_documents(e).first().text)
    assert doc["sliders"] == V3["sliders"] and doc["burstSliders"] == V3["burstSliders"] and doc["obstacles"] == V3["obstacles"]


def test_a_level_of_one_beat_is_written_in_bounded_parts(spark):
    n = 5000
    e = spark.range(n).select(F.lit(1).cast("long").alias("map_id"), F.lit("Expert").alias("difficulty"), F.col("id").alias("seq"), F.lit("note").alias("kind"), F.lit(4.0).alias("beat"), (F.col("id") % 4).cast("int").alias("x"))
    parts = Wr.level_fragments(e, rows=512).collect()
    assert sum(p.n for p in parts) == n and max(p.n for p in parts) == 512
    doc = json.loads(Wr.level_documents(e, rows=512).first().text)
    assert [o["x"] for o in doc["colorNotes"]] == [i % 4 for i in range(n)]


def test_lights_open_no_onset_and_arc_tails_do(spark):
    rows = [("note", float(i), None) for i in range(10)] + [("light", i + 0.5, None) for i in range(10)] + [("arc", 0.0, 20.0)]
    e = spark.createDataFrame([(1, "Expert", i, k, b, t, 1, 1, 0, 1) for i, (k, b, t) in enumerate(rows)] + [(1, "Hard", 0, "light", 1.0, None, 0, 0, 0, 0)],
                              "map_id bigint, difficulty string, seq bigint, kind string, beat double, tail_beat double, x int, y int, color int, direction int")
    maps = spark.createDataFrame([(1, 12000)], "map_id bigint, n_frames int")
    m = {r.difficulty: r for r in quality_metrics(e, maps).collect()}
    assert (m["Expert"].n_onsets, m["Expert"].empty_ratio, m["Expert"].empty) == (11, round(1 / 11, 9), False)
    assert m["Hard"].empty and m["Hard"].n_onsets == 0


def test_tempo_changes_belong_to_their_level(spark):
    maps = spark.createDataFrame([(1, 60.0)], "map_id bigint, bpm double")
    e = spark.createDataFrame([(1, "Expert", 4.0), (1, "Hard", 4.0)], "map_id bigint, difficulty string, beat double")
    c = spark.createDataFrame([(1, "Expert", 2.0, 120.0, 0), (1, "Hard", 1.0, 240.0, 0)], "map_id bigint, difficulty string, at_beat double, new_bpm double, seq bigint")
    assert {r.difficulty: r.seconds for r in beat_frames(e, maps, c).collect()} == {"Expert": 3.0, "Hard": 1.75}


def test_gaps_follow_document_order(spark):
    n = spark.createDataFrame([(1, "Expert", i, b) for i, b in enumerate((4.0, 1.0, 2.0))], "map_id bigint, difficulty string, seq bigint, beat double")
    assert [r.gap for r in note_intervals(n).collect()] == [1.0]


def test_token_round_trip(spark):
    e = D.level_events(D.parse_levels(docs(spark, V3)))
    dec = tokens.decode_events(tokens.encode_levels(e)).collect()
    assert sorted(r.kind for r in dec) == ["arc_end", "arc_start", "bomb", "chain", "note", "note", "note", "wall"]
    chain = next(r for r in dec if r.kind == "chain")
    assert (chain.tail_beat, chain.slice_count, chain.squish) == (12.5, 4, 0.9)


def test_overlapping_arcs(spark):
    arcs = [{"c": 0, "b": b, "x": x, "y": 0, "d": 1, "tb": b + 2, "tx": x, "ty": 2, "tc": 0} for b, x in ((1.0, 0), (2.0, 3), (9.0, 1))]
    e = D.level_events(D.parse_levels(docs(spark, {"version": "3.3.0", "sliders": arcs})))
    got = tokens.pair_arcs(tokens.decode_events(tokens.encode_levels(e))).collect()
    assert sorted((r.beat, r.x, r.tail_beat, r.tail_x) for r in got) == [(1.0, 0, 3.0, 0), (2.0, 3, 4.0, 3), (9.0, 1, 11.0, 1)]


def note(color, x, y, direction, angle):
    return [4, 10 + color, 12 + x, 16 + y, 19 + direction, 28 + angle]


#: one note, two notes, nothing, a stray token first, four notes, a chain, a torn note
SEQS = [[*note(1, 3, 2, 6, 2), 1], [*note(0, 1, 0, 8, 3), 2, *note(1, 2, 1, 4, 0), 1], [1], [3, *note(1, 3, 2, 6, 2), 1, 0, 0],
        [*note(0, 0, 2, 1, 3), 2, *note(0, 2, 2, 1, 3), 2, *note(1, 1, 2, 1, 3), 2, *note(1, 3, 0, 1, 3), 1], [9, 11, 14, 17, 23, 12, 16, 52, 83, 171, 1], note(0, 1, 1, 1, 1)[:4]]


def seqs(spark):
    return spark.createDataFrame([(i, s) for i, s in enumerate(SEQS)], "i int, tokens array<int>")


def test_slots_and_mirror(spark):
    d = seqs(spark).select("i", "tokens", tokens.structured_slots("tokens").alias("s"), tokens.mirrored("tokens").alias("m"), tokens.mirrored(tokens.mirrored("tokens")).alias("mm"),
                           tokens.grammar_report("tokens").alias("g"))
    r = {x.i: x for x in d.collect()}
    assert [r[i].s.n_notes for i in range(7)] == [1, 2, 0, 1, 3, 1, 0]
    assert all(len(r[i].s.slots) == 3 for i in range(7))
    assert r[0].m == [*note(0, 0, 2, 7, 4), 1] and all(r[i].mm == r[i].tokens for i in r)
    assert [r[i].g.valid for i in range(7)] == [True, True, False, False, True, True, False]


def test_token_readers_take_one_pass(spark):
    d = seqs(spark).unionByName(spark.createDataFrame([(7, None), (8, []), (9, [*note(1, 3, 2, 6, 2)[:4], None, 30, 1])], "i int, tokens array<int>"))
    d = d.select("i", tokens.note_tuples("tokens").alias("n"), tokens.first_direction("tokens").alias("f"), tokens.last_direction("tokens", 1).alias("l"),
                 tokens.structured_slots("tokens").alias("s"), tokens.grammar_report("tokens").alias("g"))
    r = {x.i: x for x in d.collect()}
    assert [len(r[i].n) for i in range(10)] == [1, 2, 0, 1, 4, 0, 0, 0, 0, 0]
    assert [r[i].f for i in range(10)] == [6, 8, None, 6, 1, None, None, None, None, None]
    assert [r[i].l for i in range(10)] == [6, 4, None, 6, 1, None, None, None, None, None]
    assert r[7].g.valid is None and not r[8].g.valid and not r[9].g.valid
    assert [r[i].s.n_notes for i in (7, 8, 9)] == [0, 0, 0]
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "lambdafunction(named_struct(next" not in plan and "lambdafunction(struct(next" not in plan and "aggregate(" not in plan


def test_peaks_and_suppression(spark):
    probs = [0.05, 0.3, 0.62, 0.3, 0.88, 0.4, 0.4, 0.75, 0.2, 0.2, 0.2, 0.2, 0.51, 0.49]
    f = spark.createDataFrame([(1, i, p) for i, p in enumerate(probs)], "map_id bigint, frame int, prob double")
    peaks = series.local_maxima(f, threshold=0.5)
    assert sorted(r.frame for r in peaks.collect()) == [2, 4, 7, 12]
    assert sorted(r.frame for r in series.suppress_close(peaks, 4).collect()) == [4, 12]


def test_onset_score_edges(spark):
    p = spark.createDataFrame([(1, 10), (1, 20), (2, 5)], "map_id bigint, frame int")
    t = spark.createDataFrame([(1, 11), (1, 40), (3, 7)], "map_id bigint, frame int")
    s = {r.map_id: (r.precision, r.recall, r.f1) for r in onset_scores(p, t, ["map_id"]).collect()}
    assert s == {1: (0.5, 0.5, 0.5), 2: (0.0, 1.0, 0.0), 3: (1.0, 0.0, 0.0)}
    windows = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "map_id bigint")
    s = {r.map_id: r.f1 for r in onset_scores(p, t, ["map_id"], groups=windows).collect()}
    assert s == {1: 0.5, 2: 0.0, 3: 0.0, 4: 1.0}


def level(spark, rows):
    return spark.createDataFrame([(1, "Expert", i, *r, 0) for i, r in enumerate(rows)],
                                 "map_id bigint, difficulty string, seq bigint, beat double, x int, y int, color int, direction int, angle_offset int")


def test_repair_invariants(spark):
    rows = [(i / 4, i % 4, i % 3, int(i % 10 == 0), (i * 5) % 9) for i in range(200)]
    n = level(spark, rows)
    sec = spark.createDataFrame([(1, "Expert", 10.0)], "map_id bigint, difficulty string, seconds double")
    assert repair.cap_density(n, sec).count() == 60  # mid density of six per second
    flipped = repair.rebalance_colors(n)
    assert flipped.where("color = 0").count() == 100
    fixed = repair.fix_parity(n).orderBy("color", "beat").collect()
    for a, b in zip(fixed, fixed[1:]):
        if a.color == b.color and a.direction not in (2, 3, 8) and b.direction not in (2, 3, 8):
            assert (a.direction in (1, 6, 7)) != (b.direction in (1, 6, 7))
    spread = repair.spread_cells(n.withColumn("x", F.lit(0)).withColumn("y", F.lit(0)))
    assert spread.select("x", "y").distinct().count() == 8 and spread.count() == 200


def test_whole_repair_is_deterministic_and_keeps_caps(spark):
    rows = [(i // 3 / 2, i % 4, i % 3, int(i % 4 == 0), (i * 7) % 9) for i in range(150)]
    n = level(spark, rows).withColumn("kind", F.lit("note"))
    for c, t in D.EVENT_FIELDS:
        if c not in n.columns:
            n = n.withColumn(c, F.lit(None).cast(t))
    maps = spark.createDataFrame([(1, 120.0)], "map_id bigint, bpm double")
    sec = spark.createDataFrame([(1, "Expert", 25.0)], "map_id bigint, difficulty string, seconds double")
    a = sorted(map(tuple, repair.repair_level(n, maps, sec, seed=4).select("beat", "x", "y", "color", "direction").collect()))
    b = sorted(map(tuple, repair.repair_level(n, maps, sec, seed=4).select("beat", "x", "y", "color", "direction").collect()))
    assert a == b and 0 < len(a) <= 100
    per_beat = {}
    for beat, *_ in a:
        per_beat[beat] = per_beat.get(beat, 0) + 1
    assert max(per_beat.values()) <= 2


def test_sections_cover_the_map(spark):
    f = spark.range(0, 240).select(F.lit(1).cast("long").alias("map_id"), F.col("id").cast("int").alias("frame"), (F.abs(F.sin(F.col("id") / 20))).alias("rms"), (F.col("id") % 7 / 7.0).alias("bass"))
    maps = spark.createDataFrame([(1, 60.0)], "map_id bigint, bpm double")
    s = lighting.classify_sections(f, maps, 2.0).orderBy("start_beat").collect()
    assert s[0].start_beat == 0 and s[-1].end_beat == 121
    assert all(a.end_beat == b.start_beat for a, b in zip(s, s[1:])) and s[0].section_type == "intro"


def test_mirrored_samples_mirror_history_too(spark):
    o = spark.createDataFrame([(1, "Expert", i, float(i), [4, 10, 12, 16, 19, 28, 1]) for i in range(40)], "map_id bigint, difficulty string, frame bigint, beat double, tokens array<int>")
    n = spark.createDataFrame([(1, 500)], "map_id bigint, n_frames int")
    s = samples.sequence_samples(o, n, max_len=8, prev_k=2, mirror_epoch=1).collect()
    plain, mirror = [4, 10, 12, 16, 19, 28, 1, 0], [4, 11, 15, 16, 19, 34, 1, 0]
    assert {tuple(r.tokens) for r in s} == {tuple(plain), tuple(mirror)}
    for r in s:
        assert all(h in (r.tokens, [0] * 8) for h in r.prev_tokens)


def test_late_samples_are_dropped(spark, tmp_path):
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    for i, times in enumerate((["2024-01-01 00:00:10", "2024-01-01 01:00:00"], ["2024-01-01 00:00:20", "2024-01-01 02:00:00"])):
        d = spark.createDataFrame([(t, "gpu", 1.0) for t in times], "t string, device string, util double").withColumn("t", F.to_timestamp("t"))
        d.coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(d.schema).parquet(src)
        table = jobs.run_to_table(jobs.utilisation(stream), out, ck)
    first = table.where("start = timestamp'2024-01-01 00:00:00'").collect()
    assert [r.n for r in first] == [1]


def test_running_parity_over_several_triggers(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "map_id bigint, difficulty string, color int, beat double, seq bigint, direction int"
    stream_of = lambda: spark.readStream.schema(schema).parquet(src)
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    for batch in ([(1, "E", 0, 1.0, 1, 1), (1, "E", 0, 2.0, 2, 6)], [(1, "E", 0, 3.0, 3, 0), (1, "E", 0, 0.5, 4, 0), (1, "E", 0, 9.0, 5, 0)], [(2, "E", 1, 1.0, 1, 1)], [(2, "E", 1, 1.5, 1, 1)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        jobs.running_parity(stream_of(), out, ck, idle_triggers=2).awaitTermination()
    last = jobs.parity_totals(out, spark).where("map_id = 1").first()
    assert (last.violations, last.checks, last.late) == (1, 2, 1)
    alive = spark.read.schema(jobs.PARITY_STATE).parquet(f"{out}/state/batch=3").collect()
    assert [(r.map_id, r.last_beat, r.idle) for r in alive] == [(2, 1.5, 0)]  # the idle hand has left


def test_update_tables_are_compacted(spark, tmp_path):
    out = str(tmp_path / "board")
    for b, rows in enumerate(([(1, "a"), (2, "b")], [(2, "c")], [(3, "d")], [(1, "e")])):
        spark.createDataFrame(rows, "k int, v string").write.parquet(f"{out}/batch={b}")
    before = sorted(map(tuple, jobs.newest(spark.read.parquet(out), ["k"]).collect()))
    jobs.compact(spark, out, ["k"], 2)
    assert sorted(p.name for p in (tmp_path / "board").iterdir() if p.is_dir()) == ["batch=2", "batch=3"]
    assert sorted(map(tuple, jobs.newest(spark.read.parquet(out), ["k"]).collect())) == before


def test_parity_of_a_long_hand_in_one_trigger(spark):
    n = spark.range(200_000).select(F.lit(1).cast("long").alias("map_id"), F.lit("E").alias("difficulty"), F.lit(0).alias("color"), (F.col("id") / 4).alias("beat"), F.col("id").alias("seq"), F.when(F.col("id") % 4 < 2, 1).otherwise(0).alias("direction"))
    added, last = jobs.parity_step(n, spark.createDataFrame([], jobs.PARITY_STATE))
    got, end = added.first(), last.first()
    assert (got.violations, got.checks, got.late) == (100_000, 199_999, 0) and end.last_beat == 199_999 / 4


def test_millionths_of_a_batch(spark):
    from levelloom.checks.series import millionths

    rows = [[0.1, 0.2, 0.0000005, -0.0000015], [], None, [1.0, None], [0.49999999999999994e-6, 2.0]]
    d = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v array<double>")
    old = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + F.round(x * 1e6).cast("long"))
    got = {r.i: (r.new, r.old) for r in d.select("i", millionths("v").alias("new"), old.alias("old")).collect()}
    assert all(new == old for new, old in got.values()) and got[1][0] == 0 and got[3][0] is None
