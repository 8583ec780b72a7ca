"""Experiment log: latest row wins, ranking, evaluation history, run scalars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from levelloom.functions.scalars import failure_class
from levelloom.operators.reports import composite_score, style_gaps
from levelloom.plans.ordered import Track, scan

LOG_SCHEMA = (
    "experiment_id string, name string, data_source string, stage string, seed bigint, wall_clock_sec double, composite_score double, timestamp string, "
    "playability struct<parity_rate:double,collision_rate:double,notes_per_sec:double,n_notes:bigint>, style map<string,double>"
)
SAMPLE_SCHEMA = (
    "t timestamp, host struct<cpu_pct:double,load_1m:double,ram_pct:double>, "
    "gpus array<struct<idx:int,util_pct:double,mem_used_mib:double,temp_c:double,power_w:double>>"
)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines experiment log; blank lines vanish, later lines get a higher ``line_pos``."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    raw = raw.select(F.from_json("value", LOG_SCHEMA).alias("r"), F.struct(F.col("_metadata.file_modification_time").alias("t"), F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("i")).alias("line_pos"))
    return raw.select("r.*", "line_pos").withColumn("experiment_id", F.coalesce("experiment_id", "name", F.lit("")))


def read_references(spark: SparkSession, pattern: str) -> DataFrame:
    """Cohort reference files; the cohort is the name of the folder a file lies in."""
    schema = "n_maps bigint, n_notes_total bigint, mean_nps double, direction_hist map<string,double>, parity_rate_baseline double, color_balance double"
    d = spark.read.schema(schema).option("multiLine", True).json(pattern)
    d = d.select("*", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("cohort"))
    shares = [F.coalesce(F.try_element_at("direction_hist", F.lit(str(i))), F.lit(0.0)).alias(f"dir_{i}") for i in range(9)]
    zero = {"n_maps": 0, "n_notes_total": 0, "mean_nps": 0.0, "parity_rate_baseline": 0.0, "color_balance": 0.5}
    return d.na.fill(zero).select("cohort", *zero, *shares)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Resource samples, one row per sample and device (null device when none)."""
    return spark.read.schema(SAMPLE_SCHEMA).json(path).select("t", "host.*", F.explode_outer("gpus").alias("gpu")).select("t", "cpu_pct", "load_1m", "ram_pct", "gpu.*")


def classify_logs(logs: DataFrame, timed_out: Column) -> DataFrame:
    """Failure class per run log (``path, value``): whole texts are searched."""
    return logs.select("path", failure_class("value", timed_out).alias("failure"))


def latest_rows(log: DataFrame, at: str = "line_pos") -> DataFrame:
    """Last logged row of every experiment; a partial aggregate, so repeats collapse early."""
    row = F.struct(*[F.col(c) for c in log.columns])
    return log.groupBy("experiment_id").agg(F.max_by(row, F.col(at)).alias("r")).select("r.*")


def from_source(log: DataFrame, cohort: str | None = None, bucket: str | None = None) -> DataFrame:
    if cohort is not None:
        log = log.where(F.col("data_source") == f"cohort:{cohort}")
    return log.where(F.col("data_source") == f"bucket:{bucket}") if bucket is not None else log


def ranked(rows: DataFrame, key: str = "composite_score", *, descending: bool = True, limit: int = 30) -> DataFrame:
    """Top rows by any key, nested ones included; rows without it come last when descending.

    The cut is a distributed top-k; only its ``limit`` rows are numbered.
    """
    # an absent score counts as minus infinity: last when descending, first otherwise
    order = F.col(key).desc_nulls_last() if descending else F.col(key).asc_nulls_first()
    from pyspark.sql import Window as W

    top = rows.orderBy(order, "experiment_id").limit(limit)
    return top.withColumn("rank", F.row_number().over(W.orderBy(order, "experiment_id")))


def run_scalars(scalars: DataFrame) -> DataFrame:
    """Last value of every tag in the newest version of each stage."""
    newest = scalars.groupBy("stage").agg(F.max("version").alias("version"))
    return scalars.join(newest, ["stage", "version"]).groupBy("stage", "version", "tag").agg(F.max_by("value", "step").alias("value"))


def evaluation_rows(report: DataFrame, reference: DataFrame, on: str) -> DataFrame:
    """Scored evaluation rows, ready to append to the experiment log."""
    return style_gaps(report, reference, on).withColumn("composite_score", composite_score())


def history_deltas(history: DataFrame, keys, values) -> DataFrame:
    """Evaluation history in time order with the change of every value since the run before."""
    d = history.withColumn("_day", F.unix_date(F.to_date("logged_at")))
    track = Track(tuple(keys), ("logged_at", "line_pos"), "floor(_day / 32)")
    d = scan(d, track, prev={f"_p_{v}": v for v in values})
    return d.select(*history.columns, *[(F.col(v) - F.col(f"_p_{v}")).alias(f"d_{v}") for v in values])
