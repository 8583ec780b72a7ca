"""Token encode/decode queries."""

from pyspark.sql import functions as F

from levelloom.checks.registry import query
from levelloom.functions import scalars as X
from levelloom.operators import tokens as T

MU = [i * 0.25 for i in range(9)]


def q(expr, bins):
    """SQL twin of the nearest-bin quantiser."""
    d = "[" + ", ".join(f"ABS(({expr}) - CAST({b} AS DOUBLE))" for b in bins) + "]"
    return f"(list_position({d}, list_min({d})) - 1)"


E_CTES = {
    "t_ev": f"""SELECT map_id, difficulty, beat, prio, x, y, seq, toks FROM (
 SELECT map_id, difficulty, beat, 0 prio, x, y, seq, [4, 10 + color, 12 + x, 16 + y, 19 + direction, 28 + {q('angle_offset', [-45, -30, -15, 0, 15, 30, 45])}] toks FROM full_events WHERE kind = 'note'
 UNION ALL SELECT map_id, difficulty, beat, 1, x, y, seq, [5, 12 + x, 16 + y] FROM full_events WHERE kind = 'bomb'
 UNION ALL SELECT map_id, difficulty, beat, 2, x, y, seq, [6, 12 + x, 16 + y, 89 + width - 1, 93 + height - 1, 98 + CAST(LEAST(FLOOR(duration), 64) AS INTEGER), 163 + {q('duration - LEAST(FLOOR(duration), 64)', [0, .25, .5, .75])}] FROM full_events WHERE kind = 'wall'
 UNION ALL SELECT map_id, difficulty, beat, 3, x, y, seq, [7, 10 + color, 12 + x, 16 + y, 19 + direction, 35 + {q('mu', MU)}] FROM full_events WHERE kind = 'arc'
 UNION ALL SELECT map_id, difficulty, tail_beat, 4, tail_x, tail_y, seq, [8, 10 + color, 12 + tail_x, 16 + tail_y, 19 + tail_direction, 35 + {q('tail_mu', MU)}, 44 + mid_anchor] FROM full_events WHERE kind = 'arc'
 UNION ALL SELECT map_id, difficulty, beat, 5, x, y, seq, [9, 10 + color, 12 + x, 16 + y, 19 + direction, 12 + tail_x, 16 + tail_y, 47 + slice_count - 2, 78 + {q('squish', [i / 10 for i in range(11)])}, 167 + {q('tail_beat - beat', [i * .25 for i in range(16)])}] FROM full_events WHERE kind = 'chain')""",
    "t_enc": "SELECT map_id, difficulty, beat, string_agg(array_to_string(toks, ','), ',2,' ORDER BY prio, x, y, seq) || ',1' tokens FROM t_ev GROUP BY ALL",
    "t_on": "SELECT map_id, difficulty, beat, list({'c': color, 'x': x, 'y': y, 'd': direction} ORDER BY x, y, seq) ns FROM notes GROUP BY ALL",
}


def encoded(v):
    return T.encode_levels(v.full_events)


def text(col):
    return F.array_join(F.transform(col, lambda t: t.cast("string")), ",")


@query("encode_levels", "SELECT * FROM t_enc", E_CTES)
def _(v):
    return encoded(v).withColumn("tokens", text("tokens"))


_BIN = "LEAST(9, 1 + CAST(x AS INTEGER))"


@query("decode_events", """SELECT map_id, difficulty, beat, kind, color, x, y, direction, angle_offset, width, height, duration, mu, slice_count, squish, tail_beat FROM (
 SELECT map_id, difficulty, beat, 'note' kind, color, x, y, direction, angle_offset, NULL width, NULL height, NULL duration, NULL mu, NULL slice_count, NULL squish, NULL tail_beat FROM full_events WHERE kind = 'note'
 UNION ALL SELECT map_id, difficulty, beat, 'bomb', NULL, x, y, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM full_events WHERE kind = 'bomb'
 UNION ALL SELECT map_id, difficulty, beat, 'wall', NULL, x, y, NULL, NULL, width, height, FLOOR(duration) + CASE WHEN duration % 1 <= 125e-3 THEN 0e0 WHEN duration % 1 <= 375e-3 THEN 25e-2 WHEN duration % 1 <= 625e-3 THEN 5e-1 ELSE 75e-2 END, NULL, NULL, NULL, NULL FROM full_events WHERE kind = 'wall'
 UNION ALL SELECT map_id, difficulty, beat, 'arc_start', color, x, y, direction, NULL, NULL, NULL, NULL, mu, NULL, NULL, NULL FROM full_events WHERE kind = 'arc'
 UNION ALL SELECT map_id, difficulty, tail_beat, 'arc_end', color, tail_x, tail_y, tail_direction, NULL, NULL, NULL, NULL, tail_mu, NULL, NULL, NULL FROM full_events WHERE kind = 'arc'
 UNION ALL SELECT map_id, difficulty, beat, 'chain', color, x, y, direction, NULL, NULL, NULL, NULL, NULL, slice_count, squish,
  beat + LEAST(375e-2, CASE WHEN (duration * 8) % 2 = 1 THEN (FLOOR(duration * 8) - 1) / 8e0 ELSE FLOOR(duration * 8) / 8e0 END) FROM full_events WHERE kind = 'chain')""")
def _(v):
    return T.decode_events(encoded(v)).drop("ord", "mid_anchor", "tail_x", "tail_y")


_ARC_REC = """WITH a AS (SELECT map_id, difficulty, color, beat, x, y, ROW_NUMBER() OVER (PARTITION BY map_id, difficulty, color ORDER BY beat, x, y, seq) k FROM full_events WHERE kind = 'arc'),
 ends AS (SELECT map_id, difficulty, color, list({'b': tail_beat, 'x': tail_x, 'y': tail_y} ORDER BY tail_beat, tail_x, tail_y, seq) es FROM full_events WHERE kind = 'arc' GROUP BY ALL),
 step AS (SELECT map_id, difficulty, color, 0::BIGINT k, es, NULL::DOUBLE hb, NULL::INTEGER hx, NULL::INTEGER hy, NULL::STRUCT(b DOUBLE, x INTEGER, y INTEGER) pick FROM ends
  UNION ALL SELECT map_id, difficulty, color, nk, list_filter(es, lambda e, i: i <> best), beat, x, y, es[best] FROM (
   SELECT s.map_id, s.difficulty, s.color, a.k nk, s.es, a.beat, a.x, a.y,
    list_position(list_transform(s.es, lambda e: ABS(e.b - a.beat) + CASE WHEN e.b < a.beat THEN 1000e0 ELSE 0e0 END + (ABS(e.x - a.x) + ABS(e.y - a.y)) * 1e-2),
     list_min(list_transform(s.es, lambda e: ABS(e.b - a.beat) + CASE WHEN e.b < a.beat THEN 1000e0 ELSE 0e0 END + (ABS(e.x - a.x) + ABS(e.y - a.y)) * 1e-2))) best
   FROM step s JOIN a ON a.map_id = s.map_id AND a.difficulty = s.difficulty AND a.color = s.color AND a.k = s.k + 1))
 SELECT map_id, difficulty, color, hb beat, hx x, hy y, pick.b tail_beat, pick.x tail_x, pick.y tail_y FROM step WHERE k > 0"""


@query("pair_arcs", _ARC_REC)
def _(v):
    return T.pair_arcs(T.decode_events(encoded(v))).select("map_id", "difficulty", "color", "beat", "x", "y", "tail_beat", "tail_x", "tail_y")


@query("token_notes", """SELECT e.map_id, e.difficulty, e.beat, COALESCE(len(ns), 0) n, CAST(COALESCE(list_sum([s.c + 2*s.x + 8*s.y + 24*s.d for s in ns]), 0) AS BIGINT) checksum,
 ns[1].d first_dir, list_filter(ns, lambda s: s.c = 0)[-1].d last_red, list_filter(ns, lambda s: s.c = 1)[-1].d last_blue FROM t_enc e LEFT JOIN t_on USING (map_id, difficulty, beat)""", E_CTES)
def _(v):
    n = T.note_tuples("tokens")
    code = F.aggregate(n, F.lit(0).cast("long"), lambda a, s: a + s.color + 2 * s.x + 8 * s.y + 24 * s.direction)
    return encoded(v).select(
        "map_id", "difficulty", "beat", F.size(n).alias("n"), code.alias("checksum"), T.first_direction("tokens").alias("first_dir"),
        T.last_direction("tokens", 0).alias("last_red"), T.last_direction("tokens", 1).alias("last_blue"),
    )


@query("structured_slots", """WITH s AS (SELECT map_id, difficulty, beat, prio, x, y, seq, toks, ROW_NUMBER() OVER (PARTITION BY map_id, difficulty, beat ORDER BY prio, x, y, seq) k FROM t_ev WHERE prio <> 2),
 g AS (SELECT map_id, difficulty, beat, list(CASE prio WHEN 1 THEN '-1/-1/-1/-1/-1/-1' ELSE (toks[2]-10) || '/' || (toks[3]-12) || '/' || (toks[4]-16) || '/' || (toks[5]-19) || '/' || (CASE prio WHEN 0 THEN toks[6]-28 ELSE 3 END) || '/' || (CASE prio WHEN 0 THEN 0 ELSE prio - 1 END) END ORDER BY k) FILTER (k <= 3) slots,
  COUNT(*) FILTER (k <= 3 AND prio <> 1) n_notes FROM s GROUP BY ALL)
 SELECT e.map_id, e.difficulty, e.beat, CAST(COALESCE(n_notes, 0) AS INTEGER) n_notes, array_to_string(list_concat(COALESCE(slots, []), ['-1/-1/-1/-1/-1/-1','-1/-1/-1/-1/-1/-1','-1/-1/-1/-1/-1/-1'])[1:3], ' ') targets FROM t_enc e LEFT JOIN g USING (map_id, difficulty, beat)""", E_CTES)
def _(v):
    s = T.structured_slots("tokens")
    names = ("color", "col", "row", "direction", "angle", "event_type")
    d = encoded(v).select("map_id", "difficulty", "beat", s.alias("s"))
    txt = F.array_join(F.transform(T.masked_slots(F.col("s.slots")), lambda e: F.concat_ws("/", *[e[n].cast("string") for n in names])), " ")
    return d.select("map_id", "difficulty", "beat", F.col("s.n_notes").alias("n_notes"), txt.alias("targets"))


_MIR_D = "[0,1,3,2,5,4,7,6,8]"


@query("mirror_tokens", f"""WITH m AS (SELECT *, CASE prio WHEN 1 THEN [5, 27 - toks[2], toks[3]] WHEN 2 THEN list_concat([6, 27 - toks[2]], toks[3:]) ELSE
 list_concat([toks[1], 21 - toks[2], 27 - toks[3], toks[4], 19 + {_MIR_D}[toks[5] - 18]], CASE prio WHEN 0 THEN [62 - toks[6]] WHEN 5 THEN list_concat([27 - toks[6]], toks[7:]) ELSE toks[6:] END) END mt FROM t_ev)
 SELECT map_id, difficulty, beat, string_agg(array_to_string(mt, ','), ',2,' ORDER BY prio, x, y, seq) || ',1' tokens FROM m GROUP BY ALL""", E_CTES)
def _(v):
    return encoded(v).withColumn("tokens", text(T.mirrored("tokens")))


@query("grammar_report", """SELECT e.map_id, e.difficulty, e.beat, e.beat % 4 <> 0 valid, COALESCE(len(ns), 0) n_notes,
 COALESCE(len(ns) > 2 + x OR len(list_filter(ns, lambda s: s.c = 0)) > 1 + x OR len(list_filter(ns, lambda s: s.c = 1)) > 1 + x, false) over_cap, COALESCE(len(ns) - len(list_distinct([{'x': s.x, 'y': s.y} for s in ns])), 0) collisions, CAST(COALESCE(same, 0) AS INTEGER) parity
 FROM (SELECT *, CASE WHEN map_id % 2 = 0 AND difficulty = 'Expert' THEN 1 ELSE 0 END x FROM t_enc) e LEFT JOIN t_on USING (map_id, difficulty, beat)
 LEFT JOIN (SELECT map_id, difficulty, beat, COUNT(*) FILTER (s = LAG_s AND s < 2) same FROM (SELECT *, LAG(s) OVER (PARTITION BY map_id, difficulty, color ORDER BY beat, x, y, seq) LAG_s
  FROM (SELECT *, CASE WHEN direction IN (2, 3, 8) THEN 2 WHEN direction IN (1, 6, 7) THEN 0 ELSE 1 END s FROM notes)) GROUP BY ALL) USING (map_id, difficulty, beat)""", E_CTES)
def _(v):
    # half of the maps call their harder level by the hardest name; every fourth beat gets a stray token before its end mark and must be refused
    t = F.when(F.col("beat") % 4 == 0, F.concat(F.expr("slice(tokens, 1, size(tokens) - 1)"), F.array(F.lit(3), F.lit(1)))).otherwise(F.col("tokens"))
    r = T.grammar_parity(encoded(v).withColumn("tokens", t)).select("map_id", "difficulty", "beat", "parity", T.grammar_report("tokens", F.when(F.col("map_id") % 2 == 0, F.concat("difficulty", F.lit("Plus"))).otherwise(F.col("difficulty"))).alias("r"))
    return r.select("map_id", "difficulty", "beat", "parity", "r.*")


@query("token_weights", """SELECT token, n, CAST(n * CASE WHEN token = 1 THEN 1 WHEN token = 3 THEN 1 WHEN token BETWEEN 2 AND 9 THEN 3 ELSE 1 END AS DOUBLE) weighted FROM (SELECT tok token, COUNT(*) n FROM (SELECT CAST(unnest(string_split(tokens, ',')) AS INTEGER) tok FROM t_enc) GROUP BY ALL)""", E_CTES)
def _(v):
    t = encoded(v).select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return t.withColumn("weighted", F.col("n") * X.token_weight("token"))


@query("pad_tokens", """SELECT map_id, difficulty, beat, array_to_string(list_resize(string_split(tokens, ',')[1:24], 24, '0'), ',') padded FROM t_enc""", E_CTES)
def _(v):
    return encoded(v).select("map_id", "difficulty", "beat", text(X.pad_tokens("tokens", 24)).alias("padded"))


L_CTES = {
    "l_ev": f"SELECT map_id, beat, seq, 4 || ',' || (6 + event_type) || ',' || (21 + \"value\") || ',' || (29 + {q('float_value', [0, .33, .67, 1])}) toks, {q('float_value', [0, .33, .67, 1])} b, event_type, \"value\" FROM lights",
}


@query("encode_lights", "SELECT map_id, beat, string_agg(toks, ',2,' ORDER BY k, seq) || ',1' tokens FROM (SELECT map_id, beat, seq, 0 k, toks FROM l_ev UNION ALL SELECT map_id, beat, seq, 1, '5,' || (33 + seq % 2) FROM lights WHERE seq % 9 = 0) GROUP BY ALL", L_CTES)
def _(v):
    boosts = v.lights.where("seq % 9 = 0").withColumn("boost", F.col("seq") % 2 == 1)
    return T.encode_lights(v.lights, boosts).withColumn("tokens", text("tokens"))


@query("decode_lights", """SELECT map_id, beat, 'basic' kind, event_type, "value", [0e0, 33e-2, 67e-2, 1e0][b + 1] float_value, NULL::BOOLEAN boost FROM l_ev
 UNION ALL SELECT map_id, beat, 'boost', NULL, NULL, NULL, seq % 2 = 1 FROM lights WHERE seq % 9 = 0""", L_CTES)
def _(v):
    boosts = v.lights.where("seq % 9 = 0").withColumn("boost", F.col("seq") % 2 == 1)
    return T.decode_lights(T.encode_lights(v.lights, boosts)).select("map_id", "beat", "kind", "event_type", "value", "float_value", "boost")
