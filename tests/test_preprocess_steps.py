"""What a preprocessing run leaves on disk, and members found without moving their texts."""

import json
import os

from levelloom.operators import preprocessing as P
from levelloom.operators.timing import beat_frames
from levelloom.session import shared_folder
from levelloom.sources.documents import find_members

LEVEL = json.dumps({"version": "3.3.0", "colorNotes": [{"b": 1.0, "x": 1, "y": 0, "c": 0, "d": 1}, {"b": 2.0, "x": 2, "y": 0, "c": 1, "d": 1}]})
INFO = json.dumps({"_beatsPerMinute": 120, "_difficultyBeatmapSets": [{"_beatmapCharacteristicName": "Standard", "_difficultyBeatmaps": [{"_difficulty": "Expert", "_beatmapFilename": "e.dat"}]}]})


def test_a_run_deletes_its_member_texts(spark, tmp_path):
    members = spark.createDataFrame([("a", "Info.dat", 0, INFO), ("a", "e.dat", 1, LEVEL), ("b", "e.dat", 0, LEVEL)], "map_id string, member string, pos int, text string")
    frames = spark.createDataFrame([("a", 1000)], "map_id string, n_frames int")
    base = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}".removeprefix("file:")
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    out = str(tmp_path / "out")
    P.preprocess_archives(members, frames, out)
    left = [spark.read.parquet(f"{base}/{t}").columns for t in set(os.listdir(base)) - before]
    assert not any({"text"} & set(c) or {"reject"} & set(c) for c in left), left  # neither members nor parsed rows
    assert P.preprocessed(spark, out, "onsets").count() == 2
    assert {r.map_id: r.status for r in P.map_log(spark, out).collect()} == {"a": "done", "b": "no_info"}


def test_members_of_repeated_archives_are_found_once(spark):
    rows = [("a", "E.dat", 1, "x"), ("a", "z/e.dat", 3, "later"), ("b", "e.dat", 0, "p"), ("b", "e.dat", 0, "q"), ("c", None, None, None)]
    members = spark.createDataFrame(rows, "map_id string, member string, pos int, text string")
    wanted = spark.createDataFrame([("a", "Hard", "e.dat"), ("b", "Hard", "d/E.DAT"), ("c", "Hard", "e.dat")], "map_id string, difficulty string, filename string")
    assert sorted(map(tuple, find_members(members, wanted).collect())) == [("a", "Hard", "e.dat", "x"), ("b", "Hard", "d/E.DAT", "p")]


def test_levels_without_tempo_changes_are_not_searched(spark):
    e = spark.createDataFrame([(1, "Expert", 4.0), (1, "Hard", 4.0), (2, "Hard", 4.0)], "map_id long, difficulty string, beat double")
    maps = spark.createDataFrame([(1, 120.0), (2, 60.0)], "map_id long, bpm double")
    c = spark.createDataFrame([(1, "Expert", 0, 2.0, 60.0)], "map_id long, difficulty string, seq long, at_beat double, new_bpm double")
    assert {(r.map_id, r.difficulty): r.seconds for r in beat_frames(e, maps, c).collect()} == {(1, "Expert"): 3.0, (1, "Hard"): 2.0, (2, "Hard"): 4.0}
    plan = beat_frames(e, maps, c.where("false"))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
