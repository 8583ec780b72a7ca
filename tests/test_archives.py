"""The archive data source, and the job from archives to training tables."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from levelloom.operators import preprocessing as P
from levelloom.sources.archive_source import ArchiveReader, _Files, register

LEVEL = {"version": "3.3.0", "colorNotes": [{"b": 1.0, "x": 1, "y": 0, "c": 0, "d": 1}, {"b": 2.0, "x": 2, "y": 0, "c": 1, "d": 1}], "basicBeatmapEvents": [{"b": 1.0, "et": 1, "i": 2}]}


def info(*sets, bpm=120):
    return json.dumps({"_beatsPerMinute": bpm, "_difficultyBeatmapSets": [
        {"_beatmapCharacteristicName": c, "_difficultyBeatmaps": [{"_difficulty": d, "_beatmapFilename": f}]} for c, d, f in sets]})


def pack(folder, name, files):
    folder.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(folder / f"{name}.zip", "w") as z:
        for n, t in files.items():
            z.writestr(n, t if isinstance(t, str) else json.dumps(t))


@pytest.fixture
def folder(tmp_path, spark):
    register(spark)
    f = tmp_path / "maps"
    pack(f, "a1", {"Info.dat": info(("Standard", "Expert", "e.dat"), ("Lawless", "Hard", "h.dat")), "E.DAT": LEVEL, "h.dat": LEVEL, "song.ogg": "x"})
    pack(f / "deep", "b2", {"x/info.DAT": info(("Standard", "Hard", "h.dat")), "x/h.dat": {**LEVEL, "colorNotes": [{"b": "bad"}]}})
    pack(f, "c3", {"h.dat": LEVEL})
    (f / "d4.zip").write_bytes(b"broken")
    (f / "other.txt").write_text("no archive")
    return f


def test_source_equals_the_binary_reader(spark, folder):
    from levelloom.sources.documents import archive_files, archive_members

    got = spark.read.format("level_archives").load(str(folder))
    files = archive_files(spark, str(folder)).unionByName(archive_files(spark, str(folder / "deep")))
    assert sorted(map(str, got.collect())) == sorted(map(str, archive_members(files).collect()))
    parts = ArchiveReader(str(folder), 1).partitions()
    assert [len(p.paths) for p in parts] == [1, 1, 1, 1]
    assert [len(p.paths) for p in ArchiveReader(f"file://{folder}", 1 << 30).partitions()] == [4]


def test_filters_decide_what_is_opened(spark, folder, monkeypatch):
    from pyspark.sql.datasource import EqualTo, In

    r = ArchiveReader(str(folder), 1 << 20)
    assert len(list(r.pushFilters([EqualTo(("map_id",), "a1"), In(("member",), ("E.DAT", "h.dat"))]))) == 2
    opened = []
    real = _Files.members
    monkeypatch.setattr(_Files, "members", lambda self, path, wanted: opened.append(path) or real(self, path, wanted))
    rows = [row for p in r.partitions() for row in r.read(p)]
    assert [p.rsplit("/", 1)[-1] for p in opened] == ["a1.zip"] and [x[1] for x in rows] == ["E.DAT", "h.dat"]
    d = spark.read.format("level_archives").option("partitionBytes", 1).load(str(folder)).where("map_id = 'a1'")
    assert d.rdd.getNumPartitions() == 1 and d.count() == 3  # one archive left to read


def test_source_as_a_stream(spark, folder, tmp_path):
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")

    def run():
        s = spark.readStream.format("level_archives").load(str(folder))
        s.writeStream.option("checkpointLocation", ck).trigger(availableNow=True).format("parquet").option("path", out).start().awaitTermination()
        return spark.read.parquet(out).count()

    n = run()
    pack(folder, "z9", {"Info.dat": "{}"})
    assert n == spark.read.format("level_archives").load(str(folder)).count() - 1 and run() == n + 1


def test_job_skips_what_is_stored_and_goes_by_its_log(spark, folder, tmp_path):
    out = str(tmp_path / "tables")
    frames = spark.createDataFrame([(m, 1000) for m in ("a1", "b2", "c3", "d4", "e5")], "map_id string, n_frames int")
    read = lambda: spark.read.format("level_archives").load(str(folder))
    manifest = spark.createDataFrame([("a1", "chroma", "edm")], "map_id string, category string, genre string")
    first = P.preprocess_archives(read(), frames, out, manifest=manifest)
    status = {r.map_id: r.status for r in P.map_log(spark, out).collect()}
    assert status == {"a1": "done", "b2": "bad_value", "c3": "no_info", "d4": "no_info"}
    onsets = P.preprocessed(spark, out, "onsets")
    assert sorted((r.map_id, r.difficulty, r.frame) for r in onsets.collect()) == [("a1", "Expert", 43), ("a1", "Expert", 86)]  # no Lawless level
    assert [(r.map_id, r.category, r.genre, r.n_levels) for r in P.preprocessed(spark, out, "maps").collect()] == [("a1", "chroma", "edm", 1)]
    assert P.preprocess_archives(read(), frames, out) is None
    pack(folder, "e5", {"Info.dat": info(("Standard", "Expert", "e.dat"), bpm=240), "e.dat": LEVEL})
    pack(folder, "f6", {"Info.dat": info(("Standard", "Expert", "e.dat")), "e.dat": LEVEL})
    second = P.preprocess_archives(read(), frames, out)
    assert second > first and {r.map_id: r.status for r in P.map_log(spark, out).where(F.col("run") == second).collect()} == {"e5": "done", "f6": "no_audio"}
    # a run that never wrote its log is not seen, a forced one replaces the rows of its maps
    P.preprocessed(spark, out, "onsets").limit(1).write.parquet(f"{out}/onsets/run=000099-dead")
    assert P.preprocessed(spark, out, "onsets").count() == 4
    P.preprocess_archives(read().where("map_id = 'a1'"), frames, out, force=True)
    assert P.preprocessed(spark, out, "onsets").count() == 4 and P.preprocessed(spark, out, "lights").count() == 2


def test_level_files_hold_what_level_documents_say(spark, tmp_path):
    from levelloom.sources.documents import level_events, parse_levels
    from levelloom.sources.level_files import write_level_files
    from levelloom.sources.writers import level_documents

    long = {**LEVEL, "colorNotes": [{"b": i / 8, "x": i % 4, "y": 0, "c": i % 2, "d": 1} for i in range(999)], "obstacles": [{"b": 3.0, "d": 1.0}]}
    docs = spark.createDataFrame([(1, "Expert", json.dumps(long)), (1, "Hard", json.dumps(LEVEL)), (2, "Hard", json.dumps({**LEVEL, "colorNotes": []}))], "map_id long, difficulty string, text string")
    events = level_events(parse_levels(docs))
    for again in range(2):  # writing again replaces the files
        write_level_files(events, str(tmp_path / "out"), rows=10)
        got = {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file() and not p.name.startswith(".")}
        assert got == {f"{r.map_id}/{r.difficulty}Standard.dat": r.text for r in level_documents(events).collect()}


def test_level_writer_holds_one_part(tmp_path):
    import tracemalloc

    from levelloom.sources.level_files import LevelWriter

    text = ",".join(['{"b":1.0}'] * 10_000)
    rows = (("9", "Expert", a, p, text) for a in (0, 3) for p in range(300))  # a document of 54 MB
    tracemalloc.start()
    assert LevelWriter(str(tmp_path)).write(rows).files == 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    out = tmp_path / "9" / "ExpertStandard.dat"
    assert out.stat().st_size > 50e6 and peak < 2e6
    assert len(json.loads(out.read_text())["sliders"]) == 3_000_000
    with pytest.raises(ValueError):
        LevelWriter(str(tmp_path)).write([("9", "Hard", 1, 0, text), ("9", "Hard", 0, 0, text)])
    assert [p.name for p in (tmp_path / "9").iterdir()] == ["ExpertStandard.dat"]
