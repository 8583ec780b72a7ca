"""Catalogue, split, bucket and cohort queries."""

from pyspark.sql import functions as F

from levelloom.checks.quality import CTES as Q
from levelloom.checks.registry import query
from levelloom.constants import GENRE_RULES
from levelloom.functions import scalars as X
from levelloom.operators import cohorts, curation as C, quality

TAGS = ["edm", "jpop", "k-pop", "metal", "dance", "rap", "trap", "anime", "game", "folk", "", "xyz"]


def documents(v):
    """Catalogue documents: at most six (characteristic, difficulty) entries per map."""
    d = v.catalogue_diff.groupBy("map_id", "characteristic", "difficulty").agg(
        F.max("nps").alias("nps"), *[F.bool_or(c).alias(c) for c in ("ne", "me", "chroma")]
    )
    d = d.groupBy("map_id").agg(F.collect_list(F.struct("characteristic", "difficulty", "nps", "ne", "me", "chroma")).alias("diffs"))
    tags = F.array(*[F.lit(t) for t in TAGS])
    return v.catalogue.join(d, "map_id", "left").select(
        "map_id", "mapper_id", "automapper", F.col("declared_ai").alias("declaredAi"), "uploaded",
        F.struct("score").alias("stats"), F.array(F.get(tags, (F.col("map_id") % 12).cast("int"))).alias("tags"),
        F.array(F.struct(F.sha2(F.col("map_id").cast("string"), 256).alias("hash"), F.coalesce("diffs", F.array()).alias("diffs"))).alias("versions"),
    )


_OK = "NOT automapper AND declared_ai IN ('', 'None') AND CAST(uploaded[1:4] AS INTEGER) >= 1996"
D_CTES = {
    "d_agg": """SELECT map_id, bool_or(characteristic = 'Standard') std, bool_or(characteristic = 'Standard' AND difficulty IN ('Expert','ExpertPlus')) exp,
 bool_or(characteristic = 'Standard' AND difficulty IN ('Expert','ExpertPlus') AND nps > 24) fast, bool_or(ne) ne, bool_or(me) me, bool_or(chroma) chroma FROM catalogue_diff GROUP BY map_id""",
    "d_docs": f"""SELECT c.map_id, mapper_id, score, COALESCE(score >= 3e-1 AND {_OK} AND std AND NOT fast, false) quality_ok, COALESCE({_OK} AND exp, false) cohort_ok,
 CASE WHEN ne THEN 'noodle' WHEN me THEN 'mapping_extensions' WHEN chroma THEN 'chroma' ELSE 'vanilla' END category FROM catalogue c LEFT JOIN d_agg USING (map_id)""",
}


@query("filter_quality", "SELECT map_id FROM d_docs WHERE quality_ok", D_CTES)
def _(v):
    return documents(v).where(C.passes_quality(0.3, 24.0, 1996)).select("map_id")


@query("filter_cohort", "SELECT map_id FROM d_docs WHERE cohort_ok", D_CTES)
def _(v):
    return documents(v).where(C.passes_cohort(1996)).select("map_id")


@query("category_flags", "SELECT map_id, category FROM d_docs", D_CTES)
def _(v):
    return documents(v).select("map_id", C.flag_category().alias("category"))


@query("category_counts", "SELECT category, COUNT(*) n FROM d_docs GROUP BY ALL", D_CTES)
def _(v):
    return C.category_counts(documents(v).select(C.flag_category().alias("category")))


#: every document has one to three tags and versions here, the latest version last
_DOC_TAGS = f"list_transform(range(0, map_id % 3 + 1), lambda i: {TAGS}[(map_id + 5 * i) % 12 + 1])"


@query("document_fields", f"""SELECT map_id, CAST(uploaded[1:4] AS INTEGER) "year", sha256(CAST(map_id AS VARCHAR) || repeat('+', CAST(map_id % 3 AS INTEGER))) hash, {_DOC_TAGS} tags, len({_DOC_TAGS}) n_tags FROM catalogue""")
def _(v):
    names = F.array(*[F.lit(t) for t in TAGS])
    steps = F.sequence(F.lit(0), (F.col("map_id") % 3).cast("int"))
    d = documents(v).withColumn("tags", F.transform(steps, lambda i: F.get(names, ((F.col("map_id") + 5 * i) % 12).cast("int"))))
    d = d.withColumn("versions", F.transform(steps, lambda i: F.struct(F.sha2(F.concat(F.col("map_id").cast("string"), F.repeat(F.lit("+"), i)), 256).alias("hash"))))
    return d.select("map_id", X.upload_year("uploaded").alias("year"), C.latest_hash().alias("hash"), C.raw_tags().alias("tags"), F.size(C.raw_tags()).cast("long").alias("n_tags"))


def _mods(v):
    def only(cond, name):
        return F.when(cond, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))

    p = F.col("part")
    return v.catalogue_diff.select(
        "map_id", F.concat(only(F.col("ne"), "Noodle Extensions"), only(F.col("me"), "Mapping Extensions")).alias("requirements"),
        F.concat(only(F.col("chroma"), "Chroma"), only(p % 97 == 0, "Vivify")).alias("suggestions"),
    )


@query("category_declared", """SELECT map_id, CASE WHEN bool_or(part % 97 = 0) THEN 'vivify' WHEN bool_or(ne) THEN 'noodle' WHEN bool_or(me) THEN 'mapping_extensions'
 WHEN bool_or(chroma) THEN 'chroma' ELSE 'vanilla' END category,
 concat_ws(',', CASE WHEN bool_or(me) THEN 'Mapping Extensions' END, CASE WHEN bool_or(ne) THEN 'Noodle Extensions' END) requirements,
 concat_ws(',', CASE WHEN bool_or(chroma) THEN 'Chroma' END, CASE WHEN bool_or(part % 97 = 0) THEN 'Vivify' END) suggestions FROM catalogue_diff GROUP BY map_id""")
def _(v):
    d = C.declared_mods(_mods(v))
    return d.select("map_id", "category", F.array_join("requirements", ",").alias("requirements"), F.array_join("suggestions", ",").alias("suggestions"))


_RULES = ", ".join(f"({i}, '{n}', '{g}')" for i, (n, g) in enumerate(GENRE_RULES))


@query("genre_of_tags", f"""WITH rules AS (SELECT * FROM (VALUES {_RULES}) r(prio, needle, genre)), t AS (SELECT map_id, {TAGS}[map_id % 12 + 1] tag FROM catalogue)
 SELECT map_id, COALESCE((SELECT arg_min(genre, prio) FROM rules WHERE contains(tag, needle) OR contains(needle, tag)), 'unknown') genre FROM t""")
def _(v):
    return documents(v).select("map_id", C.genre_of("tags").alias("genre"))


_QUOTA = {"vanilla": 900, "chroma": 400, "noodle": None, "mapping_extensions": None}


@query("quota_intake", """WITH p AS (SELECT map_id, score, category, ROW_NUMBER() OVER (ORDER BY score DESC, map_id) pos, ROW_NUMBER() OVER (PARTITION BY category ORDER BY score DESC, map_id) k FROM d_docs WHERE quality_ok),
 s AS (SELECT CASE WHEN COUNT(*) = 2 THEN MAX(pos) END stop FROM p WHERE (category = 'vanilla' AND k = 895) OR (category = 'chroma' AND k = 400))
 SELECT map_id, score, category, pos FROM p, s WHERE pos <= COALESCE(stop, 4611686018427387904) AND (category NOT IN ('vanilla','chroma') OR (category = 'vanilla' AND k <= 895) OR (category = 'chroma' AND k <= 400))""", D_CTES)
def _(v):
    d = documents(v).where(C.passes_quality(0.3, 24.0, 1996)).select("map_id", F.col("stats.score").alias("score"), C.flag_category().alias("category"))
    return C.accept_by_quota(d, _QUOTA, existing={"vanilla": 5})


@query("count_intake", "SELECT map_id, score, category, ROW_NUMBER() OVER (ORDER BY score DESC, map_id) pos FROM d_docs WHERE quality_ok ORDER BY score DESC, map_id LIMIT 500", D_CTES)
def _(v):
    d = documents(v).where(C.passes_quality(0.3, 24.0, 1996)).select("map_id", F.col("stats.score").alias("score"), C.flag_category().alias("category"))
    return C.accept_by_quota(d, {}, count=500)


@query("ingest_stats", """SELECT mapper_id, COUNT(*) maps_seen, COUNT(*) FILTER (cohort_ok) maps_passed, COUNT(*) FILTER (cohort_ok AND map_id % 3 = 0) maps_skipped_existing,
 COUNT(*) FILTER (cohort_ok AND map_id % 3 <> 0 AND map_id % 7 <> 0) maps_downloaded, COUNT(*) FILTER (cohort_ok AND map_id % 3 <> 0 AND map_id % 7 = 0) maps_failed FROM d_docs GROUP BY ROLLUP (mapper_id)""", D_CTES)
def _(v):
    c = v.catalogue
    return C.ingest_stats(documents(v), C.passes_cohort(1996), c.where("map_id % 3 = 0"), c.where("map_id % 7 = 0"))


def _registry(v):
    n = v.customer
    return n.select(F.col("c_custkey").alias("mapper_id"), F.when(F.col("c_custkey") % 3 == 0, F.upper("c_name")).when(F.col("c_custkey") % 3 == 1, "someone").otherwise(F.col("c_name")).alias("stated_name"))


def _users(v):
    k = F.col("c_custkey")
    return v.customer.where(k % 10 != 7).select(k.alias("user_id"), F.col("c_name").alias("name"), F.when(k % 50 == 8, "timeout").alias("error"))


_VALID = """WITH u AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 50 = 8 THEN 'timeout' END err FROM customer WHERE c_custkey % 10 <> 7),
 r AS (SELECT c_custkey mapper_id, CASE c_custkey % 3 WHEN 0 THEN upper(c_name) WHEN 1 THEN 'someone' ELSE c_name END stated_name FROM customer),
 j AS (SELECT mapper_id, stated_name, c_name user_name, CASE WHEN err IS NOT NULL THEN 'error' WHEN c_custkey IS NULL THEN 'not_found' WHEN lower(c_name) = lower(stated_name) THEN 'ok' ELSE 'mismatch' END status
 FROM r LEFT JOIN u ON c_custkey = mapper_id)"""


@query("registry_validation", _VALID + " SELECT * FROM j")
def _(v):
    return C.validate_registry(_registry(v), _users(v))


@query("registry_status_counts", _VALID + " SELECT status, COUNT(*) n FROM j GROUP BY status")
def _(v):
    return C.status_counts(C.validate_registry(_registry(v), _users(v)))


_HEX = "[CAST('0x' || md5(k)[8*i+1:8*i+8] AS BIGINT) for i in range(4)]"
_MOD = "((((a[1] % {m}) * ({w}) + a[2]) % {m} * ({w}) + a[3]) % {m} * ({w}) + a[4]) % {m}"


def _split_sql(m, src):
    w = 2**32 % m
    return f"SELECT map_id, {_MOD.format(m=m, w=w)} h FROM (SELECT map_id, {_HEX} a FROM (SELECT map_id, CAST(map_id AS VARCHAR) k FROM {src}))"


@query("split_percent", f"SELECT map_id, CASE WHEN h < 85 THEN 'train' WHEN h < 95 THEN 'val' ELSE 'test' END split FROM ({_split_sql(100, 'catalogue')})")
def _(v):
    return v.catalogue.select("map_id", X.split_percent(F.col("map_id").cast("string")).alias("split"))


S_CTES = {"s_fine": f"SELECT map_id, CASE WHEN h / 10000e0 < 85e-2 THEN 'train' WHEN h / 10000e0 < 85e-2 + 1e-1 THEN 'val' ELSE 'test' END split FROM ({_split_sql(10000, 'maps')})"}


@query("split_fine", "SELECT * FROM s_fine", S_CTES)
def _(v):
    return v.maps.select("map_id", X.split_fine(F.col("map_id").cast("string")).alias("split"))


@query("bucket_maps", "SELECT DISTINCT bucket_id, map_id, split FROM bucket_member JOIN maps USING (mapper_id) JOIN s_fine USING (map_id)", S_CTES)
def _(v):
    return cohorts.bucket_maps(v.bucket_member, v.maps)


@query("bucket_info", """WITH bm AS (SELECT DISTINCT bucket_id, map_id, split FROM bucket_member JOIN maps USING (mapper_id) JOIN s_fine USING (map_id)),
 few AS (SELECT * FROM maps WHERE mapper_id % 4 <> 0), n AS (SELECT bucket_id, COUNT(*) n_maps, COUNT(*) FILTER (split='train') n_train, COUNT(*) FILTER (split='val') n_val, COUNT(*) FILTER (split='test') n_test
 FROM (SELECT DISTINCT bucket_id, map_id, split FROM bucket_member JOIN few USING (mapper_id) JOIN s_fine USING (map_id)) GROUP BY bucket_id)
 SELECT bucket_id, array_to_string(list_sort(list(DISTINCT mapper_id)), ',') members, COALESCE(array_to_string(list_sort(list(DISTINCT mapper_id) FILTER (mapper_id NOT IN (SELECT mapper_id FROM few))), ','), '') missing,
 COALESCE(MAX(n_maps), 0) n_maps, COALESCE(MAX(n_train), 0) n_train, COALESCE(MAX(n_val), 0) n_val, COALESCE(MAX(n_test), 0) n_test FROM bucket_member LEFT JOIN n USING (bucket_id) GROUP BY bucket_id""", S_CTES)
def _(v):
    b = cohorts.bucket_info(v.bucket_member, v.maps.where("mapper_id % 4 <> 0"))
    return b.withColumn("members", F.array_join("members", ",")).withColumn("missing", F.array_join("missing", ","))


@query("bucket_members", "SELECT bucket_id, mapper_id, n_name FROM bucket_member JOIN nation ON n_nationkey = mapper_id WHERE n_regionkey <> 3")
def _(v):
    reg = v.nation.where("n_regionkey <> 3").select(F.col("n_nationkey").alias("mapper_id"), "n_name")
    return cohorts.bucket_members(v.bucket_member, reg).select("bucket_id", "mapper_id", "n_name")


R_CTES = {
    **Q,
    "r_pref": "SELECT map_id, CASE WHEN bool_or(difficulty = 'Expert') THEN 'Expert' ELSE 'Hard' END difficulty FROM objects GROUP BY map_id",
    "r_n": "SELECT * FROM (SELECT notes.*, ROW_NUMBER() OVER (PARTITION BY map_id, difficulty, beat ORDER BY x, y, seq) slot FROM notes SEMI JOIN r_pref USING (map_id, difficulty)) WHERE slot <= 3",
    "r_p": """SELECT map_id, SUM(CASE WHEN p = c THEN 1 ELSE 0 END) v, COUNT(p) c FROM (SELECT map_id, c, LAG(c) OVER (PARTITION BY map_id, color ORDER BY beat, x, y, seq) p FROM
 (SELECT *, CASE WHEN direction IN (1,6,7) THEN 'f' ELSE 'b' END c FROM r_n WHERE direction NOT IN (2,3,8))) GROUP BY map_id""",
    "r_m": "SELECT map_id, COUNT(*) n, COUNT(*) FILTER (color=0) red, COUNT(*) FILTER (color=1) blue, " + ", ".join(f"COUNT(*) FILTER (direction={d}) d{d}" for d in range(9)) + " FROM r_n GROUP BY map_id",
    "r_ref": """SELECT mapper_id, COUNT(*) n_maps, CAST(COALESCE(SUM(n),0) AS BIGINT) n_notes_total, ROUND(SUM(n_frames * 512e0 / 44100e0), 6) total_song_sec, CAST(COALESCE(SUM(red),0) AS BIGINT) red_count, CAST(COALESCE(SUM(blue),0) AS BIGINT) blue_count,
 ROUND(CAST(COALESCE(SUM(n),0) AS DOUBLE) / GREATEST(ROUND(SUM(n_frames * 512e0 / 44100e0), 6), 1e0), 9) mean_nps, CAST(COALESCE(SUM(v),0) AS DOUBLE) / GREATEST(COALESCE(SUM(c),0), 1) parity_rate_baseline,
 CAST(COALESCE(SUM(red),0) AS DOUBLE) / GREATEST(COALESCE(SUM(red+blue),0), 1) color_balance, """ + ", ".join(f"CAST(COALESCE(SUM(d{d}),0) AS DOUBLE) / GREATEST(COALESCE(SUM(n),0), 1) dir_{d}" for d in range(9))
    + " FROM maps JOIN r_pref USING (map_id) LEFT JOIN r_m USING (map_id) LEFT JOIN r_p USING (map_id) GROUP BY mapper_id",
}


def reference(v):
    idx = v.objects.groupBy("map_id", "difficulty").agg(F.count("*").alias("n_onsets"))
    return cohorts.cohort_reference(v.notes, idx, v.maps)


@query("preferred_difficulty", "SELECT * FROM r_pref", R_CTES)
def _(v):
    return cohorts.preferred_difficulty(v.objects.groupBy("map_id", "difficulty").agg(F.count("*").alias("n_onsets")))


@query("cohort_reference", "SELECT * FROM r_ref", R_CTES)
def _(v):
    return reference(v)


_NAMES = ["U", "D", "L", "R", "UL", "UR", "DL", "DR", ".."]
_SHARES = "[" + ",".join(f"{{'s': -dir_{d}, 'd': {d}}}" for d in range(9)) + "]"


@query("cohort_table", f"""SELECT r_ref.*, (SELECT string_agg({_NAMES}[e.d + 1] || '=' || CAST(CAST(round_even(-e.s * 100, 0) AS INTEGER) AS VARCHAR) || '%', ' ' ORDER BY e.s, e.d) FROM unnest(list_sort({_SHARES})[1:2]) u(e)) top_dirs FROM r_ref""", R_CTES)
def _(v):
    return cohorts.cohort_table(reference(v), "nps", desc=True)


@query("manifest_join", """SELECT c.map_id, COALESCE(d.category, 'unknown') category, CASE WHEN d.map_id IS NULL THEN 'unknown' ELSE 'pop' END genre FROM catalogue c LEFT JOIN (SELECT * FROM d_docs WHERE map_id % 5 <> 0) d USING (map_id)
 WHERE COALESCE(d.category, 'unknown') NOT IN ('noodle','mapping_extensions')""", D_CTES)
def _(v):
    man = documents(v).where("map_id % 5 <> 0").select("map_id", C.flag_category().alias("category"), F.lit("pop").alias("genre"))
    return C.exclude_categories(C.with_manifest(v.catalogue.select("map_id"), man), ["noodle", "mapping_extensions"])


@query("manifest_backfill", """SELECT map_id, category FROM d_docs WHERE map_id % 5 <> 0 UNION ALL SELECT map_id, category FROM d_docs WHERE map_id % 5 = 0""", D_CTES)
def _(v):
    d = documents(v).select("map_id", C.flag_category().alias("category"))
    return C.backfill_manifest(d.where("map_id % 5 <> 0"), d)


@query("unseen_maps", "SELECT map_id FROM catalogue WHERE map_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def _(v):
    done = v.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("map_id"))
    return C.unseen(v.catalogue.select("map_id"), done)


@query("training_maps", """SELECT i.map_id, difficulty, n_onsets, category, CASE difficulty WHEN 'Expert' THEN 3 ELSE 2 END difficulty_id, 0 genre_id FROM
 (SELECT map_id, difficulty, COUNT(DISTINCT beat) n_onsets FROM q_at GROUP BY ALL) i JOIN maps USING (map_id) JOIN s_fine USING (map_id)
 WHERE split = 'train' AND map_id NOT IN (SELECT map_id FROM q_black) AND category NOT IN ('noodle') AND difficulty IN ('Expert') AND n_frames > 9000""", {**Q, **S_CTES})
def _(v):
    from levelloom.checks.quality import _metrics, _short_index
    idx = quality.map_index(v.full_events, v.lights, v.maps).select("map_id", "difficulty", "n_onsets", "category")
    split = v.maps.select("map_id", X.split_fine(F.col("map_id").cast("string")).alias("split")).where("split = 'train'")
    black = quality.quality_blacklist(_short_index(v), _metrics(v))
    return C.training_maps(idx, split=split, blacklist=black, whitelist=v.maps.where("n_frames > 9000"), exclude=["noodle"], difficulties=["Expert"])


@query("slugs", "SELECT p_partkey, lower(regexp_replace(regexp_replace(p_name || ' #' || p_brand || '!', '[^A-Za-z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g')) slug FROM part")
def _(v):
    return v.part.select("p_partkey", X.slug(F.concat("p_name", F.lit(" #"), "p_brand", F.lit("!"))).alias("slug"))


@query("content_ids", """SELECT o_orderkey, sha256('{"cohort": "' || CAST(o_custkey % 25 AS VARCHAR) || '", "lr": 0.001, "seed": ' || CAST(o_orderkey AS VARCHAR) || ', "stage": "' || o_orderstatus || '"}')[1:12] experiment_id FROM orders""")
def _(v):
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    pairs = [("stage", q(F.col("o_orderstatus"))), ("seed", F.col("o_orderkey").cast("string")), ("lr", F.lit("0.001")), ("cohort", q((F.col("o_custkey") % 25).cast("string")))]
    return v.orders.select("o_orderkey", X.content_id(pairs).alias("experiment_id"))


@query("embedding_ids", """SELECT p_partkey, CASE p_type WHEN 'x' THEN 0 ELSE CASE p_partkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 ELSE 3 END END difficulty_id,
 CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 5 WHEN 2 THEN 9 ELSE 0 END genre_id FROM part""")
def _(v):
    d = F.array(*[F.lit(s) for s in ("Easy", "Normal", "Hard", "Expert", "ExpertPlus", "Impossible")])
    g = F.array(*[F.lit(s) for s in ("unknown", "hip-hop", "video-game", "noise")])
    k = F.col("p_partkey")
    return v.part.select("p_partkey", X.difficulty_id(F.get(d, (k % 6).cast("int"))).alias("difficulty_id"), X.genre_id(F.get(g, (k % 4).cast("int"))).alias("genre_id"))
