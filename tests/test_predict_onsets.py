"""Every stage of the onset query bears on what follows it."""

from pyspark.sql import functions as F

from levelloom.checks.registry import REGISTRY, Views
from levelloom.checks.series import window_probs
from levelloom.functions.scalars import snap_frame
from levelloom.operators import series
from levelloom.session import tune

SF = "/root/testdata/sf0.001"


def test_onsets_lie_on_the_beat_grid(spark):
    v = Views(tune(spark), SF)
    last = v.frames.groupBy("map_id").agg(F.max("frame").alias("last"))
    got = REGISTRY["predict_onsets"].run(spark, SF).join(last, "map_id").join(v.maps.select("map_id", "bpm"), "map_id").cache()
    off = got.where((snap_frame("frame", "bpm") != F.col("frame")) & (F.col("frame") != F.col("last")))
    assert got.count() > 0 and off.count() == 0
    # and the grid moves what the stage before it gives
    peaks = series.suppress_close(series.local_maxima(series.overlap_average(window_probs(v)))).join(v.maps.select("map_id", "bpm"), "map_id")
    assert peaks.where(snap_frame("frame", "bpm") != F.col("frame")).count() > 0
