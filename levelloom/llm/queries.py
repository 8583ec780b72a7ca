"""The registered queries of this subpackage and, where SQL can say them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from levelloom.llm import credentials, langid, lexical, license, manifest, mixing, mtree, packing, pii, quality, simhash, toxicity, vectors
from levelloom.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_path() -> str:
    """The public tokenizer that packing uses by default."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn

    return register


def _count(kind: str):
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


@_query("op1_vectors")
def op1(spark, sf_dir):
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


@_query("op2_secrets")
def op2(spark, sf_dir):
    found = credentials.find_secrets(_table(spark, sf_dir, "documents"))
    base = credentials.span_list(F.col("spans"), credentials.BASE)
    counts = {f"n_{k}": _count(k) for k in credentials.BASE}
    return found.select("doc_id", *[c.alias(n) for n, c in counts.items()], F.sha2(base, 256).alias("base_sha256"), credentials.span_list(F.col("spans"), credentials.KINDS).alias("spans"))


@_query("op3_quality")
def op3(spark, sf_dir):
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query("op4_simhash")
def op4(spark, sf_dir):
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


@_query("op5_packing")
def op5(spark, sf_dir):
    pieces = packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", packing.checksums()("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@_query("op6_mixing")
def op6(spark, sf_dir):
    return mixing.taken(_table(spark, sf_dir, "documents"))


@_query("op7_topk")
def op7(spark, sf_dir):
    return mtree.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@_query("op8_langid")
def op8(spark, sf_dir):
    return langid.identify(_table(spark, sf_dir, "documents"))


@_query("op9_pii")
def op9(spark, sf_dir):
    found = pii.find_private(_table(spark, sf_dir, "documents"))
    base = pii.span_list(F.col("spans"), pii.KINDS)
    counts = {f"n_{k}": _count(k) for k in pii.KINDS}
    return found.select("doc_id", *[c.alias(n) for n, c in counts.items()], F.sha2(base, 256).alias("base_sha256"), pii.span_list(F.col("spans"), (*pii.KINDS, pii.TERM)).alias("spans"))


@_query("op10_license")
def op10(spark, sf_dir):
    return license.scan(_table(spark, sf_dir, "documents"))


@_query("op11_lexical")
def op11(spark, sf_dir):
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query("op12_toxicity")
def op12(spark, sf_dir):
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query("op13_manifest")
def op13(spark, sf_dir):
    return manifest.manifest(_table(spark, sf_dir, "documents"))


# ---- oracles: what SQL can say, over whole tables ---------------------------
ORACLES["op1_vectors"] = """WITH RECURSIVE n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) m FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) v FROM embeddings)),
 l AS (SELECT a.vec_id x, b.vec_id y FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.v, b.v) / (a.m * b.m) >= 95e-2),
 r AS (SELECT vec_id x, vec_id y FROM n UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
 c AS (SELECT x, MIN(y) component_id FROM r GROUP BY x), k AS (SELECT x, COUNT(*) n_links FROM l GROUP BY x)
 SELECT vec_id, COALESCE(n_links, 0) n_links, component_id, vec_id = component_id kept FROM n JOIN c ON c.x = vec_id LEFT JOIN k ON k.x = vec_id"""

ORACLES["op7_topk"] = """WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) v FROM embeddings),
 s AS (SELECT a.vec_id query_id, b.vec_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) score FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
 k AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) "rank" FROM s) SELECT query_id, "rank", vec_id, score FROM k WHERE "rank" <= 5"""


def _license_sql() -> str:
    word = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    low = f"translate({{}}, '{license.UPPER}', '{license.LOWER}')"
    found = []
    for phrase, label in license.PHRASES:
        parts = " AND ".join(f"w[i + {k}] = '{p}'" for k, p in enumerate(phrase.split()))
        found.append(f"list_filter(range(1, len(w) + 1), lambda i: COALESCE({parts}, false)) {label}_at")
    sets = ", ".join(f"('{label}', {sorted(ws)!r}, {need}, {size})" for label, ws, need, size in license.ordered_templates(license.TEMPLATES, {}, license.CONTAINMENT))
    names = [label for _, label in license.PHRASES]
    places = "list_concat(" * (len(names) - 1) + f"{names[0]}_at, " + "), ".join(f"{n}_at" for n in names[1:]) + ")"
    own = "list_filter([" + ", ".join(f"CASE WHEN len({n}_at) > 0 THEN '{n}' END" for n in names) + "], lambda x: x IS NOT NULL)"
    return f"""WITH d AS (SELECT doc_id, COALESCE(text, '') t FROM documents), w AS (SELECT doc_id, regexp_extract_all({low.format('t')}, '{word}') w FROM d),
 p AS (SELECT doc_id, len(w) n_words, {', '.join(found)} FROM w), a AS (SELECT doc_id, n_words, {places} pos, {own} own FROM p),
 ts AS (SELECT * FROM (VALUES {sets}) v(label, ws, need, size)),
 h AS (SELECT doc_id, label, MAX(n / len(ws)) held FROM (SELECT doc_id, label, ws, need, list_max(list_transform(range(1, len(w) + 1), lambda i: len(list_intersect(w[i:i + size - 1], ws)))) n
  FROM w, ts WHERE len(list_intersect(w, ws)) >= need) WHERE n >= need GROUP BY doc_id, label),
 m AS (SELECT doc_id, list(label) more, MAX(held) held FROM h GROUP BY doc_id)
 SELECT doc_id, CAST(n_words AS BIGINT) n_words, CAST(len(pos) AS BIGINT) n_base, CAST(list_min(pos) - 1 AS BIGINT) first_word, CAST(list_max(pos) - 1 AS BIGINT) last_word, COALESCE(array_to_string(list_sort(own), ','), '') base_labels,
 COALESCE(array_to_string(list_sort(list_distinct(list_concat(own, COALESCE(more, [])))), ','), '') labels, CAST(CASE WHEN len(pos) > 0 THEN 1e0 ELSE COALESCE(held, 0e0) END AS DOUBLE) score FROM a LEFT JOIN m USING (doc_id)"""


ORACLES["op10_license"] = _license_sql()

ORACLES["op11_lexical"] = r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'UPPER', 'LOWER'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') w FROM documents),
 x AS (SELECT doc_id, w ws, len(w) n, ROW_NUMBER() OVER () r FROM d WHERE len(w) > 0), s AS (SELECT COUNT(*) nn, SUM(n)::BIGINT l FROM x),
 tf AS (SELECT r, t, COUNT(*) tf FROM (SELECT r, unnest(ws) t FROM x) GROUP BY r, t), df AS (SELECT t, COUNT(*) df FROM tf GROUP BY t),
 q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'UPPER', 'LOWER'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) t FROM benchmark),
 w AS (SELECT item_id, t, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT w FROM q JOIN df USING (t), s),
 p AS (SELECT item_id, doc_id, r, SUM(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + ((50 * n * nn) // l)))))::BIGINT score FROM w JOIN tf USING (t) JOIN x USING (r), s GROUP BY item_id, doc_id, r),
 k AS (SELECT item_id, CAST(ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) "rank", doc_id, score FROM p WHERE score > 0) SELECT * FROM k WHERE "rank" <= 50""".replace("UPPER", license.UPPER).replace("LOWER", license.LOWER)


def _manifest_sql(levels: int = 6, top: int = 3) -> str:
    """Level by level; ``levels`` bounds what this SQL can check to 8 ** levels rows a language."""
    def field(c):
        return f"COALESCE(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"

    def leaf(text):
        return "sha256(" + " || ".join(map(field, ["doc_id", "source", "lang", "n_chars", text])) + ")"

    low = f"translate(text, '{manifest.UPPER}', '{manifest.LOWER}')"
    step = "xor(c >> 1, (c & 1) * 3988292384)"
    table = f"(SELECT list(v ORDER BY i) FROM (SELECT i, {'list_reduce(list_prepend(i, range(8)), lambda c, k: ' + step + ')'} v FROM range(256) r(i)))"
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda z: ascii(z)::BIGINT)), lambda c, z: xor(c >> 8, tab[(xor(c, z) & 255) + 1])), 4294967295)"

    def level(at: str, k: int) -> str:
        run = f"PARTITION BY g, slot // 8 ORDER BY slot ROWS BETWEEN"
        return f"""{at}w{k} AS (SELECT *, string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING) a, string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING) b FROM {at}{k}),
 {at}{k + 1} AS (SELECT g, slot // 8 slot, CASE WHEN MAX(n) > 1 THEN sha256(string_agg(h, '' ORDER BY slot)) ELSE MAX(h) END h, (MAX(n) + 7) // 8 n FROM {at}{k} GROUP BY g, slot // 8)"""

    def walk(frm: str, to: str, at: str, g: str, slot: str, k: int) -> str:
        f = "CASE WHEN w.n > 1 THEN sha256(COALESCE(w.a, '') || f || COALESCE(w.b, '')) ELSE f END"
        return f"{to} AS (SELECT p.* EXCLUDE (f, proof), {f} f, proof || COALESCE(w.a, '') || COALESCE(w.b, '') proof FROM {frm} p JOIN {at}w{k} w ON w.g = p.{g} AND w.slot = p.{slot} // {8 ** k})"

    parts = [
        f"tab AS (SELECT {table} tab)",
        f"d AS (SELECT doc_id, COALESCE('=' || lang, '') g, {leaf('text')} leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf(low)} END changed FROM documents, tab)",
        "r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 slot, COUNT(*) OVER (PARTITION BY g) n FROM d)",
        "l0 AS (SELECT g, slot, leaf h, n FROM r)", *[level("l", k) for k in range(levels)],
        f"s AS (SELECT g, h, ROW_NUMBER() OVER (ORDER BY g) - 1 lang_slot, COUNT(*) OVER () langs FROM l{levels})",
        "t0 AS (SELECT 0 g, lang_slot slot, h, langs n FROM s)", *[level("t", k) for k in range(top)],
        f"p0 AS (SELECT r.*, s.h subroot, s.lang_slot, 0 one, t.h root, COALESCE(changed, leaf) f, '' proof FROM r JOIN s USING (g), t{top} t)",
        *[walk(f"p{k}", f"p{k + 1}", "l", "g", "slot", k) for k in range(levels)],
        *[walk(f"p{levels + k}", f"p{levels + k + 1}", "t", "one", "lang_slot", k) for k in range(top)],
    ]
    return "WITH " + ",\n ".join(parts) + f"\n SELECT doc_id, leaf, subroot, root, sha256(proof) proof_sha256, f folded_root, f = root verified FROM p{levels + top}"


ORACLES["op13_manifest"] = _manifest_sql()
