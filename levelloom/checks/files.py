"""Scans of files that Spark writes from the given tables, and small joins of their content."""

from pyspark.sql import functions as F

from levelloom.checks.curation import D_CTES, documents
from levelloom.checks.lighting import SEC
from levelloom.checks.registry import query
from levelloom.operators import curation as C, experiments as E, lighting as L, samples as S
from levelloom.session import age_by_name, scratch
from levelloom.sources import catalogue as Cat


def _one_per_file(df, path):
    df.write.option("maxRecordsPerFile", 1).text(path)
    return path


@query("catalogue_files", "SELECT CAST(map_id AS VARCHAR) id, score FROM d_docs WHERE quality_ok", D_CTES)
def _(v):
    d = documents(v).withColumn("id", F.col("map_id").cast("string")).withColumn("page", F.floor(F.col("map_id") / 400))
    doc = F.struct("id", "automapper", "declaredAi", "uploaded", "tags", "stats", "versions")
    pages = d.groupBy("page").agg(F.to_json(F.struct(F.collect_list(doc).alias("docs"))).alias("value")).select("value")
    docs = Cat.read_catalogue(v.spark, _one_per_file(pages, scratch(v.spark, "pages")))
    return docs.where(C.passes_quality(0.3, 24.0, 1996)).select("id", F.col("stats.score").alias("score"))


@query("manifest_files", "SELECT CAST(map_id AS VARCHAR) map_id, category FROM d_docs WHERE map_id % 40 <> 7", D_CTES)
def _(v):
    piece = F.concat(F.lit('"'), F.col("map_id"), F.lit('": '), F.to_json(F.struct("category", F.array(F.lit("x")).alias("requirements"))))
    d = documents(v).select("map_id", C.flag_category().alias("category")).select((F.col("map_id") % 40).alias("part"), piece.alias("piece"))
    m = d.groupBy("part").agg(F.concat(F.lit("{"), F.array_join(F.collect_list("piece"), ","), F.lit("}")).alias("text"))
    broken = F.when(F.col("part") == 7, "{ broken").otherwise(F.col("text"))
    path = _one_per_file(m.select(broken.alias("value")), scratch(v.spark, "manifests"))
    return Cat.read_manifest(v.spark, path).select("map_id", "category")


@query("registry_scan", """SELECT 'b' || bucket_id bucket_id, 'mapper ' || mapper_id display_name, mapper_id, 'u' || mapper_id user_name FROM bucket_member""")
def _(v):
    b = v.bucket_member
    name = F.concat(F.lit("mapper "), F.col("mapper_id"))
    mappers = b.select("mapper_id").distinct().agg(F.collect_list(F.struct(name.alias("display_name"), "mapper_id", F.concat(F.lit("u"), F.col("mapper_id")).alias("user_name"))).alias("mappers"))
    buckets = b.groupBy(F.concat(F.lit("b"), F.col("bucket_id")).alias("bucket_id")).agg(F.collect_list(name).alias("mapper_ids"))
    whole = mappers.join(buckets.agg(F.collect_list(F.struct("bucket_id", "mapper_ids")).alias("style_buckets")))
    path = _one_per_file(whole.select(F.to_json(F.struct("*")).alias("value")), scratch(v.spark, "registry"))
    mapper, member = Cat.read_registry(v.spark, path)
    return member.join(mapper, "display_name").select("bucket_id", "display_name", "mapper_id", "user_name")


@query("optional_sidecar", "SELECT map_id, category, 0 missing FROM maps")
def _(v):
    base = scratch(v.spark, "sidecar")
    v.maps.select("map_id", "category").write.parquet(f"{base}/there")
    gone = Cat.optional_table(v.spark, f"{base}/gone")
    return Cat.optional_table(v.spark, f"{base}/there").withColumn("missing", F.lit(0 if gone is None else 1))


@query("log_scan", "SELECT experiment_id, composite_score FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY experiment_id ORDER BY line_pos DESC) k FROM experiment_log) WHERE k = 1")
def _(v):
    path = scratch(v.spark, "log")
    # a log rolled over into files in line order, each newer than the one before, as appends make it
    v.experiment_log.orderBy("line_pos").select("experiment_id", "data_source", "composite_score").write.json(path)
    age_by_name(v.spark, path)
    return E.latest_rows(E.read_log(v.spark, path)).select("experiment_id", "composite_score")


@query("reference_scan", """SELECT 'cohort=' || category cohort, COUNT(*) n_maps, 0 n_notes_total, AVG(bpm) / 60 mean_nps, 0e0 parity_rate_baseline, 5e-1 color_balance, 25e-2 dir_0, 0e0 dir_1, 0e0 dir_2, 0e0 dir_3, 0e0 dir_4, 0e0 dir_5, 0e0 dir_6, 0e0 dir_7, 75e-2 dir_8 FROM maps GROUP BY category""")
def _(v):
    base = scratch(v.spark, "references")
    r = v.maps.groupBy(F.col("category").alias("cohort")).agg(F.count("*").alias("n_maps"), (F.avg("bpm") / 60).alias("mean_nps"))
    r = r.withColumn("direction_hist", F.create_map(F.lit("0"), F.lit(0.25), F.lit("8"), F.lit(0.75)))
    r.write.partitionBy("cohort").option("maxRecordsPerFile", 1).json(base)
    return E.read_references(v.spark, f"{base}/*/*.json")


@query("resource_scan", """SELECT epoch_us(ts) us, event_id % 100 / 1e0 cpu_pct, "value" ram_pct, CAST(d AS INTEGER) idx, user_id % 50 + d / 1e0 util_pct FROM events, range(0, 2) r(d) WHERE event_id % 5 <> 0
 UNION ALL SELECT epoch_us(ts), event_id % 100 / 1e0, "value", NULL, NULL FROM events WHERE event_id % 5 = 0""")
def _(v):
    path = scratch(v.spark, "samples")
    gpu = lambda d: F.struct(F.lit(d).alias("idx"), (F.col("user_id") % 50 + float(d)).alias("util_pct"))
    e = v.events.select(
        F.col("ts").cast("timestamp").alias("t"), F.struct((F.col("event_id") % 100 / 1.0).alias("cpu_pct"), F.col("value").alias("ram_pct")).alias("host"),
        F.when(F.col("event_id") % 5 != 0, F.array(gpu(0), gpu(1))).alias("gpus"),
    )
    e.write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)
    return E.read_samples(v.spark, path).select(F.unix_micros("t").alias("us"), "cpu_pct", "ram_pct", "idx", "util_pct")


@query("pad_channels", "SELECT map_id, frame, CASE WHEN frame % 3 = 0 THEN 0e0 ELSE frame / 1e0 END section_id, 0e0 section_progress FROM frames")
def _(v):
    f = v.frames.select("map_id", "frame", F.when(F.col("frame") % 3 != 0, F.col("frame").cast("double")).alias("section_id"))
    return S.pad_channels(f).select("map_id", "frame", "section_id", "section_progress")


@query("events_with_lights", """WITH l AS (SELECT map_id, 'light' kind, ROUND(bt, 4) beat, et, CAST(val AS INTEGER) "value", CAST(NULL AS BOOLEAN) boost FROM x_l UNION ALL SELECT map_id, 'boost', a, NULL, NULL, t IN ('drop','buildup') FROM x_s),
 u AS (SELECT l.*, difficulty FROM l JOIN (SELECT DISTINCT map_id, difficulty FROM notes) USING (map_id))
 SELECT map_id, difficulty, kind, COUNT(*) n, MIN(seq) lowest, MAX(seq) - COUNT(*) + 1 gaps, SUM(beat) beats FROM (SELECT map_id, difficulty, kind, beat, ROW_NUMBER() OVER (PARTITION BY map_id, difficulty, kind ORDER BY beat) - 1 seq FROM u) GROUP BY map_id, difficulty, kind
 UNION ALL SELECT map_id, difficulty, 'note', COUNT(*), NULL, NULL, SUM(beat) FROM notes GROUP BY map_id, difficulty""", SEC)
def _(v):
    s = v.maps.select("map_id", F.posexplode(F.array(*[F.lit(n) for n in ("intro", "calm", "buildup", "drop", "breakdown", "outro")])).alias("k", "section_type"))
    start = (F.col("k") * 40).cast("double")
    s = s.select("map_id", start.alias("start_beat"), (start + 5 + (F.col("map_id") * 7 + F.col("k") * 11) % 35).alias("end_beat"), "section_type")
    e = L.with_lights(v.notes.withColumn("kind", F.lit("note")), L.section_lights(s))
    own = F.when(F.col("kind") != "note", F.col("seq"))
    return e.groupBy("map_id", "difficulty", "kind").agg(
        F.count("*").alias("n"), F.min(own).alias("lowest"), (F.max(own) - F.count(own) + 1).alias("gaps"), F.sum("beat").alias("beats")
    ).withColumn("gaps", F.when(F.col("kind") != "note", F.col("gaps")))
