"""Streaming, source and table-function queries."""

from pyspark.sql import functions as F

from levelloom.checks.curation import D_CTES, documents
from levelloom.checks.documents import V2, _v2_docs
from levelloom.checks.quality import _pairs
from levelloom.checks.registry import query
from levelloom.checks.series import A, _TW, counts
from levelloom.functions.table_functions import register
from levelloom.operators import curation as C, samples as S
from levelloom.session import scratch
from levelloom.sources import catalogue as Cat, writers as Wr
from levelloom.streaming import jobs as J


def stream(v, name):
    """The named table as a file stream (its file is one of several in the folder)."""
    t = v.spark.read.parquet(f"{v.sf_dir}/{name}.parquet")
    return v.spark.readStream.schema(t.schema).option("pathGlobFilter", f"{name}.parquet").parquet(v.sf_dir)


def _run(v, df, mode, name):
    base = scratch(v.spark, name)
    return J.run_to_table(df, f"{base}/out", f"{base}/ck", mode)


def _samples(v):
    return stream(v, "events").select(F.col("ts").cast("timestamp").alias("t"), F.col("event_type").alias("device"), F.col("value").alias("util"))


def _naive(df):
    return df.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query("stream_utilisation", """SELECT * FROM (SELECT time_bucket(INTERVAL 5 MINUTES, ts) "start", time_bucket(INTERVAL 5 MINUTES, ts) + INTERVAL 5 MINUTES "end", event_type device, COUNT(*) n, ROUND(AVG("value"), 9) mean_util, MAX("value") peak_util FROM events GROUP BY ALL) WHERE "end" <= (SELECT MAX(ts) FROM events) - INTERVAL 10 MINUTES""")
def _(v):
    return _naive(_run(v, J.utilisation(_samples(v)), "append", "util")).withColumn("mean_util", F.round("mean_util", 9))


@query("stream_utilisation_sliding", """SELECT * FROM (SELECT b - k * INTERVAL 5 MINUTES "start", b - k * INTERVAL 5 MINUTES + INTERVAL 30 MINUTES "end", event_type device, COUNT(*) n, ROUND(AVG("value"), 9) mean_util, MAX("value") peak_util FROM (SELECT *, time_bucket(INTERVAL 5 MINUTES, ts) b FROM events), range(0, 6) r(k) GROUP BY ALL) WHERE "end" <= (SELECT MAX(ts) FROM events) - INTERVAL 10 MINUTES""")
def _(v):
    return _naive(_run(v, J.utilisation(_samples(v), width="30 minutes", slide="5 minutes"), "append", "slide")).withColumn("mean_util", F.round("mean_util", 9))


@query("stream_leaderboard", "SELECT 'exp' || o_custkey experiment_id, ARG_MAX(o_orderkey, o_orderkey) line_pos, ARG_MAX(o_totalprice, o_orderkey) score FROM orders GROUP BY o_custkey")
def _(v):
    log = stream(v, "orders").select(F.concat(F.lit("exp"), F.col("o_custkey")).alias("experiment_id"), F.col("o_orderkey").alias("line_pos"), F.col("o_totalprice").alias("score"))
    return J.newest(_run(v, J.live_leaderboard(log), "update", "board"), ["experiment_id"])


@query("stream_sessions", """SELECT run, MIN(ts) "start", MAX(ts) + INTERVAL 6 HOURS "end", COUNT(*) n FROM (SELECT *, SUM(c) OVER (PARTITION BY run ORDER BY ts, event_id) g FROM (SELECT user_id run, ts, event_id, CASE WHEN ts - LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOURS THEN 0 ELSE 1 END c FROM events)) GROUP BY run, g HAVING MAX(ts) + INTERVAL 6 HOURS <= (SELECT MAX(ts) FROM events) - INTERVAL 1 HOUR""")
def _(v):
    beats = stream(v, "events").select(F.col("user_id").alias("run"), F.col("ts").cast("timestamp").alias("t"))
    return _naive(_run(v, J.heartbeat_sessions(beats, gap="6 hours"), "append", "sessions"))


@query("stream_parity", "SELECT map_id, difficulty, color, CAST(SUM(CASE WHEN p = c AND NOT (beat - pb > 3) THEN 1 ELSE 0 END) AS BIGINT) violations, CAST(SUM(CASE WHEN p IS NOT NULL AND NOT (beat - pb > 3) THEN 1 ELSE 0 END) AS BIGINT) checks FROM (SELECT *, LAG(c) OVER w p, LAG(beat) OVER w pb FROM (SELECT *, CASE WHEN direction IN (1,6,7) THEN 'f' ELSE 'b' END c FROM notes WHERE direction NOT IN (2,3,8)) WINDOW w AS (PARTITION BY map_id, difficulty, color ORDER BY beat, seq)) GROUP BY ALL")
def _(v):
    from levelloom.plans.views import shape_objects

    n = shape_objects(stream(v, "lineitem")).where("kind = 'note'").select("map_id", "difficulty", "color", "beat", "seq", "direction")
    base = scratch(v.spark, "parity")
    J.running_parity(n, f"{base}/out", f"{base}/ck").awaitTermination()
    return J.parity_totals(f"{base}/out", v.spark).drop("late")


@query("stream_ingest", """SELECT map_id, dd difficulty, CASE kind WHEN 'v2_light' THEN 'light' ELSE kind END kind, COUNT(*) n, CAST(ROUND(SUM(b) * 1000) AS BIGINT) beats, NULL reject FROM
  (SELECT map_id, dd, kind, beat b FROM v2_obj WHERE kind IN ('note','bomb','wall') AND (map_id, dd) IN (SELECT (map_id, difficulty) FROM v2_live) UNION ALL SELECT map_id, difficulty, 'v2_light', 15e-1 FROM v2_live) GROUP BY ALL
 UNION ALL SELECT map_id, difficulty, NULL, NULL, NULL, reject FROM v2_rej""", V2)
def _(v):
    base = scratch(v.spark, "ingest")
    # whole maps per file, several files and triggers
    _v2_docs(v).repartition(4, "map_id").write.parquet(f"{base}/in")
    docs = v.spark.readStream.schema("map_id bigint, difficulty string, text string").option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    J.ingest_levels(docs, f"{base}/out", f"{base}/ck").awaitTermination()
    events = v.spark.read.parquet(f"{base}/out/events").groupBy("map_id", "difficulty", "kind").agg(F.count("*").alias("n"), F.round(F.sum("beat") * 1000).cast("long").alias("beats"), F.lit(None).cast("string").alias("reject"))
    dead = v.spark.read.parquet(f"{base}/out/rejects").select("map_id", "difficulty", "reject")
    return events.unionByName(dead, allowMissingColumns=True)


# ---- sources and sinks over Spark-written files ----------------------------
@query("catalogue_scan", "SELECT CAST(map_id AS VARCHAR) id, score FROM d_docs WHERE quality_ok", D_CTES)
def _(v):
    base = scratch(v.spark, "pages")
    d = documents(v).withColumn("id", F.col("map_id").cast("string")).withColumn("page", F.floor(F.col("map_id") / 20))
    doc = F.struct("id", "automapper", "declaredAi", "uploaded", "tags", "stats", "versions")
    # pages of twenty documents, as a catalogue service returns them
    d.groupBy("page").agg(F.to_json(F.struct(F.collect_list(doc).alias("docs"))).alias("value")).select("value").write.text(f"{base}/pages")
    page = v.spark.read.text(f"{base}/pages").select(F.explode(F.from_json("value", "docs array<string>")["docs"]).alias("text"))
    docs = Cat.parse_catalogue(page)
    return docs.where(C.passes_quality(0.3, 24.0, 1996)).select("id", F.col("stats.score").alias("score"))


@query("manifest_scan", "SELECT CAST(map_id AS VARCHAR) map_id, category FROM d_docs WHERE map_id % 40 <> 7", D_CTES)
def _(v):
    d = documents(v).select("map_id", C.flag_category().alias("category"))
    piece = F.concat(F.lit('"'), F.col("map_id"), F.lit('": '), F.to_json(F.struct("category", F.array(F.lit("x")).alias("requirements"))))
    d = d.withColumn("part", F.floor(F.col("map_id") / 4000) * 40 + F.col("map_id") % 40).withColumn("piece", piece)
    m = d.groupBy("part").agg(F.concat(F.lit("{"), F.array_join(F.collect_list("piece"), ","), F.lit("}")).alias("text"))
    broken = F.when(F.col("part") % 40 == 7, "{ broken").otherwise(F.col("text"))
    return Cat.parse_manifest(m.select(broken.alias("text"))).select("map_id", "category")


@query("manifest_upsert", "SELECT o_custkey map_id, ARG_MAX(o_orderstatus, o_orderkey) category, MAX(o_orderkey) downloaded_at FROM orders GROUP BY o_custkey")
def _(v):
    o = v.orders.select(F.col("o_custkey").alias("map_id"), F.col("o_orderstatus").alias("category"), F.col("o_orderkey").alias("downloaded_at"))
    return Wr.upsert_manifest(o.where("downloaded_at % 2 = 0"), o.where("downloaded_at % 2 = 1"))


@query("partitioned_table", "SELECT map_id, mapper_id FROM maps WHERE category = 'chroma'")
def _(v):
    base = scratch(v.spark, "tables")
    Wr.write_table(v.maps.withColumnRenamed("category", "cohort"), f"{base}/maps", partition="cohort")
    from levelloom.operators.cohorts import one_source

    return one_source(v.spark.read.parquet(f"{base}/maps"), cohort="chroma").select("map_id", "mapper_id")


@query("append_log", "SELECT experiment_id, composite_score FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY experiment_id ORDER BY line_pos DESC) k FROM experiment_log) WHERE k = 1")
def _(v):
    from levelloom.operators.experiments import latest_rows

    base = scratch(v.spark, "log")
    log = v.experiment_log.select("line_pos", "experiment_id", "composite_score")
    for odd in (0, 1):  # two appends to one log
        Wr.append_log(log.where(F.col("line_pos") % 2 == odd), f"{base}/log")
    back = v.spark.read.schema("line_pos bigint, experiment_id string, composite_score double").json(f"{base}/log")
    return latest_rows(back).select("experiment_id", "composite_score")


@query("sliding_windows_sql", f"SELECT map_id, CAST(unnest(s) AS INTEGER) \"start\" FROM (SELECT map_id, CASE WHEN n > 32 AND nxt < n THEN list_append(body, n - 32) ELSE body END s FROM ({_TW}))", A)
def _(v):
    register(v.spark)
    counts(v).createOrReplaceTempView("levelloom_counts")
    return v.spark.sql("SELECT c.map_id, s.start FROM levelloom_counts c, LATERAL sliding_windows(c.n_frames, 32, 16) s")


_HEADS = {"color": (0, 3), "col": (3, 4), "row": (7, 3), "direction": (10, 9), "angle": (19, 7)}


#: the third slot has the twelve entries that two slots leave, its angle those of the column and row heads
_LAST = {"color": (52, 3), "col": (55, 4), "row": (59, 3), "direction": (62, 2), "angle": (55, 7)}


@query("structured_notes", """WITH h AS (SELECT vec_id, k, list_transform(range(0, 26), lambda i: embedding[k * 26 + i + 1]) e FROM embeddings, range(0, 2) r(k)),
 a AS (SELECT vec_id, k, list_position(e[1:3], list_max(e[1:3])) - 1 c, list_position(e[4:7], list_max(e[4:7])) - 1 x, list_position(e[8:10], list_max(e[8:10])) - 1 y, list_position(e[11:19], list_max(e[11:19])) - 1 d, list_position(e[20:26], list_max(e[20:26])) - 1 g FROM h
  UNION ALL SELECT vec_id, 2, list_position(e[53:55], list_max(e[53:55])) - 1, list_position(e[56:59], list_max(e[56:59])) - 1, list_position(e[60:62], list_max(e[60:62])) - 1, list_position(e[63:64], list_max(e[63:64])) - 1, list_position(e[56:62], list_max(e[56:62])) - 1 FROM (SELECT vec_id, embedding e FROM embeddings))
 SELECT vec_id, x, y, c color, d direction, (g - 3) * 15 angle_offset FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY vec_id, x, y ORDER BY k) r FROM a WHERE c < 2) WHERE r = 1""")
def _(v):
    heads = {n: F.array(*[F.slice("embedding", s * 26 + at + 1, size) for s in range(2)], F.slice("embedding", _LAST[n][0] + 1, _LAST[n][1])).alias(n) for n, (at, size) in _HEADS.items()}
    return S.structured_notes(v.embeddings.select("vec_id", *heads.values()), ["vec_id"]).drop("slot")
