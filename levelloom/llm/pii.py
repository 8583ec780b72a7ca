"""Personal data: fixed patterns, and terms that the corpus shows to reveal a protected entity.

A protected entity is a value found by the patterns (an address, a number). The words near
its occurrences are its contexts. A term reveals an entity when knowing the term makes the
entity likely: pointwise mutual information, as a share of the entity's own information,
reaches a disclosure threshold with enough independent contexts. Such terms are removed or
generalised wherever they occur.

Contexts count once however often a passage is copied, so copies are no evidence. A place of
a term counts once however many entities stand beside it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from levelloom.llm.common import cut, text_hash

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: words on either side that make a context
NEAR = 4
#: independent contexts a term needs, and the share of the entity's information it must give
SUPPORT, DISCLOSURE, SHARE = 5, 0.75, 0.5
#: bits of the pre-filter for terms; a set bit only means that the exact join decides
FILTER_BITS = 1 << 20

# the patterns' fixed values
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_local = re.compile(r"[A-Za-z0-9._%+-]")
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_word = re.compile(r"[^\W\d_]{2,}")
_letter = re.compile(r"[^\W\d_]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each ``@`` so that long runs cost linear time."""
    done = 0
    at = text.find("@")
    while at >= 0:
        if at >= done and (m := _domain.match(text, at + 1)):
            start = at
            while start > done and _local.match(text[start - 1]):
                start -= 1
            if start < at:
                yield start, m.end()
                done = m.end()
        at = text.find("@", at + 1)


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base matches by start, then kind as listed."""
    out = []
    if "@" in text:
        out += [(s, e, "email") for s, e in _emails(text)]
    for m in _ip.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in _card.finditer(text):
        if m.end() - m.start() >= 14:
            digits = re.sub(r"[\x20-]", "", m.group()) if m.end() - m.start() <= 40 else ""
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _phone.finditer(text):
            if 10 <= sum(c in "0123456789" for c in m.group()) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def _near(text: str, start: int, end: int) -> list[re.Match]:
    """Up to ``NEAR`` words on each side of a place."""
    before = list(_word.finditer(text, max(0, start - 40 * NEAR), start))[-NEAR:]
    return before + list(_word.finditer(text, end, end + 40 * NEAR))[:NEAR]


def _context(words: list[re.Match]) -> int:
    """Hash of words as written but lower-cased."""
    return xxhash.xxh64_intdigest(" ".join(m.group().lower() for m in words), 9) - (1 << 63)


def _whole(text: str, m: re.Match) -> bool:
    """Whether a word is not cut by the edge of the stretch it was found in."""
    return not (m.start() and _letter.match(text, m.start() - 1) or _letter.match(text, m.end()))


def _beside(text: str, found: list[tuple[int, int, str]]) -> tuple[list[tuple[int, int, list[re.Match]]], dict[int, list[tuple[int, int]]]]:
    """Each span's entity, context and whole words near it; and by the place of each such word, the entities and contexts there."""
    near, at = [], {}
    for s, e, k in found:
        words = _near(text, s, e)
        entity = xxhash.xxh64_intdigest(f"{k}:{text[s:e].lower()}", 9) - (1 << 63)
        context = _context(words)
        terms = [m for m in words if _whole(text, m)]
        near.append((entity, context, terms))
        for m in terms:
            at.setdefault(m.start(), []).append((entity, context))
    return near, at


def _place(text: str, m: re.Match, at: dict[int, list[tuple[int, int]]]) -> int:
    """What tells one place of a term from another: the words around it, and the entities near it with their contexts."""
    own = _context(_near(text, m.start(), m.end()))
    beside = at.get(m.start())
    return xxhash.xxh64_intdigest(f"{own}:{beside}", 9) - (1 << 63) if beside else own


SPANS = T.ArrayType(T.StructType().add("start", T.LongType()).add("end", T.LongType()).add("kind", T.StringType()))
TERMS = T.ArrayType(T.StructType().add("term", T.StringType()).add("place", T.LongType()))
SEEN = T.ArrayType(T.StructType().add("entity", T.LongType()).add("context", T.LongType()).add("terms", TERMS))


@F.pandas_udf(T.StructType().add("spans", SPANS).add("seen", SEEN))
def _find(texts: pd.Series) -> pd.DataFrame:
    spans, seen = [], []
    for text in texts:
        found = base_spans(text)
        spans.append([{"start": s, "end": e, "kind": k} for s, e, k in found])
        near, at = _beside(text, found)
        places: dict[int, int] = {}
        for _, _, terms in near:
            for m in terms:
                if m.start() not in places:
                    places[m.start()] = _place(text, m, at)
        seen.append([{"entity": e, "context": c, "terms": [{"term": m.group().lower(), "place": places[m.start()]} for m in terms]} for e, c, terms in near])
    return pd.DataFrame({"spans": spans, "seen": seen})


def _bit(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) % FILTER_BITS


def _occurrences(bits: bytes):
    """Places of terms whose filter bit is set, each with the hash that tells it from others."""

    @F.pandas_udf("array<struct<term: string, place: long, start: long, end: long>>")
    def find(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            rows = []
            # the distinct words first: few texts hold a candidate at all
            hit = {w for w in map(str.lower, set(_word.findall(text))) if bits[(i := _bit(w)) >> 3] >> (i & 7) & 1}
            at = _beside(text, base_spans(text))[1] if hit else {}
            for m in _word.finditer(text) if hit else ():
                w = m.group().lower()
                if w in hit:
                    rows.append({"term": w, "place": _place(text, m, at), "start": m.start(), "end": m.end()})
            out.append(rows)
        return pd.Series(out)

    return find


def revealing(seen: DataFrame, occurrences: DataFrame, contexts: DataFrame, *, support: int = SUPPORT, disclosure: float = DISCLOSURE, share: float = SHARE) -> DataFrame:
    """Terms that disclose an entity: one row ``(term)`` each.

    ``contexts`` has (entity, context) of every place of an entity, ``seen`` adds the candidate
    terms in it with their place, ``occurrences`` has (term, place) of every place of a
    candidate term. All counts are of distinct contexts or places; a place counts once for its
    term, whatever entities are near it.
    With p(e), p(e|t) and the information I(e) = -log2 p(e), a term discloses e when
    log2(p(e|t) / p(e)) >= disclosure * I(e), p(e|t) >= share, and support is reached.
    """
    pairs = beside(seen)
    entities = contexts.groupBy("entity").agg(F.count("*").alias("n_entity"))
    total = entities.agg(F.sum("n_entity").alias("n_all"))  # one row
    terms = occurrences.select("term", "place").distinct().groupBy("term").agg(F.count("*").alias("n_term"))
    p = pairs.where(F.col("n_both") >= support).join(terms, "term").join(entities, "entity").join(F.broadcast(total), F.lit(True))
    own = F.log2(F.col("n_all") / F.col("n_entity"))
    given = F.col("n_with") / F.col("n_term")
    told = F.log2(given * F.col("n_all") / F.col("n_entity"))
    return p.where((given >= share) & (told >= disclosure * own) & (told > 0)).select("term").distinct()


def beside(seen: DataFrame) -> DataFrame:
    """(entity, term, n_both, n_with): distinct contexts of an entity with the term, distinct places of the term near the entity."""
    contexts = seen.select("entity", "term", "context").distinct().groupBy("entity", "term").agg(F.count("*").alias("n_both"))
    places = seen.select("entity", "term", "place").distinct().groupBy("entity", "term").agg(F.count("*").alias("n_with"))
    return contexts.join(places, ["entity", "term"])


def find_private(docs: DataFrame, *, support: int = SUPPORT, disclosure: float = DISCLOSURE, share: float = SHARE) -> DataFrame:
    """doc_id, text_hash, spans of every row: base spans and disclosed terms, by start.

    spans: array<struct<start, end, kind>> in code points, end exclusive. A null or empty text
    has none. Repeated rows and null doc_ids are kept; other columns are not read; an empty
    table gives no rows. Terms that overlap a base span stay with the base span.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = cut(docs.select("doc_id", text_hash().alias("text_hash"), _find(text).alias("f")).select("doc_id", "text_hash", "f.*"))
    seen = rows.select(F.explode("seen").alias("s")).select("s.entity", "s.context", F.explode("s.terms").alias("t"))
    seen = seen.select("entity", "context", "t.term", "t.place").distinct()
    # a term's places near any entity are some of all its places, so they bound p(e|t) from above
    near = seen.select("term", "place").distinct().groupBy("term").agg(F.count("*").alias("n_near"))
    candidates = beside(seen).where(F.col("n_both") >= support).join(near, "term").where(F.col("n_with") >= share * F.col("n_near")).select("term").distinct()
    candidates = cut(candidates)
    bits = bytearray(FILTER_BITS // 8)
    at = F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(FILTER_BITS))
    for r in candidates.select(at.alias("i")).distinct().toLocalIterator():  # FILTER_BITS numbers at most
        bits[r.i >> 3] |= 1 << (r.i & 7)
    if not any(bits):
        return rows.select("doc_id", "text_hash", "spans")
    places = docs.select("doc_id", text_hash().alias("text_hash"), _occurrences(bytes(bits))(text).alias("o"))
    places = cut(places.select("doc_id", "text_hash", F.explode("o").alias("o")).select("doc_id", "text_hash", "o.*").distinct())
    known = places.join(candidates, "term", "left_semi")
    told = revealing(seen.join(candidates, "term", "left_semi"), known, seen.select("entity", "context").distinct(), support=support, disclosure=disclosure, share=share)
    spans = places.join(told, "term").groupBy(
        F.coalesce("doc_id", F.lit(0)).alias("k1"), F.col("doc_id").isNull().alias("k2"), F.col("text_hash").alias("k3")
    ).agg(F.collect_set(F.struct("start", "end", F.lit(TERM).alias("kind"))).alias("more"))
    rows = rows.withColumns({"k1": F.coalesce("doc_id", F.lit(0)), "k2": F.col("doc_id").isNull(), "k3": F.col("text_hash")})
    rows = rows.join(spans, ["k1", "k2", "k3"], "left")
    free = F.filter("more", lambda t: ~F.exists("spans", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    whole = F.when(F.col("more").isNull(), F.col("spans")).otherwise(F.array_sort(F.concat("spans", free)))
    return rows.select("doc_id", "text_hash", whole.alias("spans"))


def span_list(spans: Column, kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` of spans by start, then kind as listed, comma-joined."""
    rank = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])
    ordered = F.array_sort(F.transform(F.filter(spans, lambda s: s["kind"].isin(*kinds)), lambda s: F.struct(s["start"].alias("a"), rank[s["kind"]].alias("b"), s["end"].alias("c"), s["kind"].alias("d"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["d"], s["a"].cast("string"), s["c"].cast("string"))), ",")


@F.pandas_udf(T.StringType())
def _replace(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """Texts with each span generalised to the name of its kind; overlaps become one."""
    out = []
    for text, found in zip(texts, spans):
        if text is not None and found is not None and len(found):
            parts, at = [], 0
            for s in sorted(found, key=lambda s: (s["start"], -s["end"])):
                if s["start"] >= at:
                    parts += [text[at:s["start"]], f"[{s['kind']}]"]
                at = max(at, s["end"])
            text = "".join([*parts, text[at:]])
        out.append(text)
    return pd.Series(out, dtype=object)


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """All rows with their personal data generalised to ``[kind]``; columns as given.

    ``n_chars`` follows the new text where the table has it. Texts without findings and null
    texts are unchanged.
    """
    found = find_private(docs, **options).where(F.size("spans") > 0)
    found = found.groupBy(F.coalesce("doc_id", F.lit(0)).alias("__ll_id"), F.col("doc_id").isNull().alias("__ll_none"), F.col("text_hash").alias("__ll_hash")).agg(F.first("spans").alias("__ll_spans"))
    keys = ["__ll_id", "__ll_none", "__ll_hash"]
    d = docs.withColumns({"__ll_id": F.coalesce("doc_id", F.lit(0)), "__ll_none": F.col("doc_id").isNull(), "__ll_hash": text_hash()})
    d = d.join(found, keys, "left")
    clean = F.when(F.col("__ll_spans").isNull(), F.col("text")).otherwise(_replace("text", "__ll_spans"))
    d = d.withColumn("text", clean)
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.when(F.col("__ll_spans").isNull(), F.col("n_chars")).otherwise(F.length("text")))
    return d.select(*docs.columns)
