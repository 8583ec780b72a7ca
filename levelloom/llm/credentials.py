"""Secret scan with multipart credential linking, in DataFrame operations only.

Some credentials are plain by themselves: assignments, access keys, long hex strings. Others
are weak on their own: a bare token of mixed characters, an account or client identifier, a
service address. Weak parts become a finding only when complementary parts (identifier,
secret, endpoint) lie in one scope. A scope is a stretch of text; parts are intervals, and an
interval join on scope cells brings together those that are close enough. A cell is no longer
than the scope, so the parts in it are bounded by its characters, whatever the text's length.
Parts have any length: each stands in every cell it reaches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from levelloom.llm.common import cut, text_hash, text_of

# fixed patterns of the base kinds
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
BASE = ("assign", "access", "hex")

# weak parts: what they look like, and which part of a credential they are
IDENTIFIER = r"""(?i:client_?id|account|user(?:name)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
ENDPOINT = r"""(?:https?|ftps?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3)://[^\s"'<>]{3,}"""
OPAQUE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_=-])"
WEAK = ("identifier", "endpoint", "opaque")
KINDS = BASE + WEAK

#: code points within which complementary parts make a credential
SCOPE = 200


def matches(text: Column, pattern: str, kind: str, only_if: Column | None = None, keep=None) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` as array<struct<start, end, kind>>.

    Positions are code points. The gaps between matches come from ``split``, the matches from
    ``regexp_extract_all``; running lengths of both give the places. ``keep`` tests a match.
    ``only_if`` is a cheap test without which there is no match.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long,match:string>>").alias("out"))

    def step(acc, pair):
        s = acc["at"] + pair["gap"]
        e = s + F.length(pair["match"])
        one = F.struct(s.alias("start"), e.alias("end"), pair["match"].alias("match"))
        return F.struct(e.cast("long").alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    pairs = F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("match"), g.cast("long").alias("gap")))
    pairs = F.filter(pairs, lambda p: p["match"].isNotNull())
    spans = F.aggregate(pairs, start, step)["out"]
    if keep is not None:
        spans = F.filter(spans, lambda s: keep(s["match"]))
    spans = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))
    none = F.array().cast("array<struct<start:long,end:long,kind:string>>")
    return F.when(text.rlike(pattern) if only_if is None else only_if & text.rlike(pattern), spans).otherwise(none)


def span_list(spans: Column, kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` of spans by start, then kind as listed, comma-joined."""
    rank = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])
    of = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    ordered = F.array_sort(F.transform(of, lambda s: F.struct(s["start"].alias("a"), rank[s["kind"]].alias("b"), s["end"].alias("c"), s["kind"].alias("d"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["d"], s["a"].cast("string"), s["c"].cast("string"))), ",")


def _parts(kind: Column) -> Column:
    """Which part of a credential a kind is."""
    return F.when(kind.isin("access", "identifier"), "id").when(kind == "endpoint", "endpoint").otherwise("secret")


def link(parts: DataFrame, keys: list[str], scope: int = SCOPE) -> DataFrame:
    """Weak parts that lie within ``scope`` of a complementary part: keys, start, end, kind.

    ``parts`` has keys, start, end, kind. Only a pair with a secret in it makes a credential: an
    identifier or an endpoint complements a secret, but not each other. A weak part stands in the scope cells from
    its start to its end, the other side in those within scope of it; a close pair is taken in
    the first cell that both stand in, so each meets exactly once.
    """
    p = parts.distinct().withColumn("part", _parts(F.col("kind")))
    first, last = F.floor(F.col("start") / scope), F.floor(F.col("end") / scope)
    weak = p.where(F.col("kind").isin(*WEAK)).withColumn("first", first).withColumn("cell", F.explode(F.sequence("first", last)))
    first2, last2 = F.floor(F.greatest(F.col("start") - scope, F.lit(0)) / scope), F.floor((F.col("end") + scope) / scope)
    other = p.select(*keys, F.col("start").alias("s2"), F.col("end").alias("e2"), F.col("part").alias("part2"), first2.alias("first2"), F.explode(F.sequence(first2, last2)).alias("cell"))
    close = (F.col("s2") <= F.col("end") + scope) & (F.col("e2") >= F.col("start") - scope) & ((F.col("part") == "secret") != (F.col("part2") == "secret"))
    once = F.col("cell") == F.greatest("first", "first2")
    return weak.join(other, [*keys, "cell"]).where(close & once).select(*keys, "start", "end", "kind").distinct()


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, spans of every row: base spans and linked weak parts, by start, then kind.

    spans: array<struct<start, end, kind>> in code points, end exclusive. Null and empty texts
    have none; repeated rows and null doc_ids are kept; other columns are not read. Weak parts
    that overlap a base span are left to it.
    """
    t = docs.select("doc_id", text_hash().alias("text_hash"), text_of().alias("t"))
    text = F.col("t")
    base = F.concat(
        matches(text, ASSIGN, "assign", keep=lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8),
        matches(text, ACCESS, "access", text.contains("AKIA")),
        matches(text, HEX, "hex"),
    )
    weak = F.concat(
        matches(text, IDENTIFIER, "identifier"),
        matches(text, ENDPOINT, "endpoint", text.contains("://")),
        matches(text, OPAQUE, "opaque"),
    )
    rows = cut(t.select("doc_id", "text_hash", base.alias("base"), weak.alias("weak")))
    free = F.filter("weak", lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    keys = {"k1": F.coalesce("doc_id", F.lit(0)), "k2": F.col("doc_id").isNull(), "k3": F.col("text_hash")}
    rows = rows.withColumns(keys).withColumn("weak", free)
    parts = rows.where(F.size("weak") > 0).select(*keys, F.explode(F.concat("base", "weak")).alias("s")).select(*keys, "s.*")
    found = link(parts, list(keys), scope).groupBy(*keys).agg(F.collect_set(F.struct("start", "end", "kind")).alias("more"))
    rows = rows.join(found, list(keys), "left")
    whole = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", "more"))
    return rows.select("doc_id", "text_hash", F.array_sort(whole).alias("spans"))
