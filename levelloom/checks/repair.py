"""Repair queries. Oracles of the self-feeding rules walk row by row, unlike the operators."""

from pyspark.sql import functions as F

from levelloom.checks.registry import query
from levelloom.operators import repair as R, timing

K = "map_id, difficulty"
KC = "map_id, difficulty, color"


def seconds(v, shrink=1.0):
    return timing.map_seconds(v.objects, v.maps).withColumn("seconds", F.col("seconds") / shrink)


#: the order by chance that the rules draw in, for a table alias
H = "CAST('0x' || md5(map_id || '/' || difficulty || '/' || seq || '/0')[1:15] AS BIGINT)"
S = {"sec": f"SELECT {K}, MAX(beat) / (ANY_VALUE(bpm) / 60e0) secs FROM objects JOIN maps USING (map_id) GROUP BY ALL"}


@query("strip_objects", "SELECT map_id, difficulty, seq FROM objects WHERE kind = 'note'")
def _(v):
    return R.strip_objects(v.objects).select("map_id", "difficulty", "seq")


_CAP_OBJECTS = f"""WITH r AS (SELECT o.{K.replace(', ', ', o.')}, o.kind, o.seq, ROW_NUMBER() OVER (PARTITION BY {K.replace('map_id', 'o.map_id').replace(' difficulty', ' o.difficulty')}, kind ORDER BY beat, seq) - 1 r, COUNT(*) OVER (PARTITION BY o.map_id, o.difficulty, kind) n,
 CAST(FLOOR(CASE kind WHEN 'bomb' THEN GREATEST(10, secs / 4 * 15e-2) WHEN 'wall' THEN GREATEST(5, secs / 4 * 1e-1) ELSE GREATEST(5, secs / 4 * 5e-2) END) AS BIGINT) m FROM objects o JOIN sec USING ({K}))
 SELECT {K}, kind, seq FROM r WHERE kind = 'note' OR n <= m OR list_contains([CAST(FLOOR(i * (n / m)) AS BIGINT) for i in range(0, m)], r)"""


@query("cap_objects", _CAP_OBJECTS, S)
def _(v):
    return R.cap_objects(v.objects, seconds(v, 4.0)).select("map_id", "difficulty", "kind", "seq")


B = {
    **S,
    "b_two": f"SELECT * EXCLUDE (r, t) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {K}, beat ORDER BY color, r) t FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {K}, beat, color ORDER BY ABS(x - CASE color WHEN 0 THEN 5e-1 ELSE 25e-1 END), seq) r FROM notes) WHERE r <= 1) WHERE t <= 2",
    "b_imp": f"""SELECT {K}, seq, beat, pos, n, CASE WHEN f < 1e-2 OR f > 99e-2 THEN 3e0 WHEN ABS(f - 5e-1) < 1e-2 THEN 225e-2 WHEN ABS(f - 25e-2) < 1e-2 OR ABS(f - 75e-2) < 1e-2 THEN 15e-1 ELSE 75e-2 END
 + CASE WHEN nb - pb > 2 THEN 2e0 WHEN nb - pb > 1 THEN 1e0 ELSE 0e0 END + CASE WHEN len(list_filter(near, lambda m: ABS(m.b - beat) < 1e-2 AND m.c <> color)) > 0 THEN 15e-1 ELSE 0e0 END + CASE WHEN pos <= 2 OR pos > n - 2 THEN 2e0 ELSE 0e0 END importance
 FROM (SELECT *, beat % 1 f, COALESCE(LAG(beat) OVER w, beat - 2) pb, COALESCE(LEAD(beat) OVER w, beat + 2) nb, ROW_NUMBER() OVER w pos, COUNT(*) OVER (PARTITION BY {K}) n, list({{'b': beat, 'c': color}}) OVER (PARTITION BY {K} ORDER BY beat, seq ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) near FROM notes WINDOW w AS (PARTITION BY {K} ORDER BY beat, seq))""",
}


@query("cap_notes_per_beat", "SELECT map_id, difficulty, seq FROM b_two", B)
def _(v):
    return R.cap_notes_per_beat(v.notes).select("map_id", "difficulty", "seq")


@query("note_importance", "SELECT map_id, difficulty, seq, pos, importance FROM b_imp", B)
def _(v):
    return R.note_importance(v.notes).select("map_id", "difficulty", "seq", "pos", "importance")


_CAP_DENSITY = f"""SELECT {K}, seq FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {K} ORDER BY importance, pos) rk, CASE difficulty WHEN 'Expert' THEN 8e0 ELSE 6e0 END hi, CASE difficulty WHEN 'Expert' THEN 6e0 ELSE 45e-1 END mid, secs / 8 s FROM b_imp JOIN sec USING ({K}))
 WHERE NOT (n / s > hi AND GREATEST(1, FLOOR(mid * s)) < n AND rk <= n - GREATEST(1, FLOOR(mid * s)))"""


@query("cap_density", _CAP_DENSITY, B)
def _(v):
    return R.cap_density(v.notes, seconds(v, 8.0)).select("map_id", "difficulty", "seq")


def _reddish(v):
    return v.notes.withColumn("color", (F.col("seq") % 5 == 0).cast("int"))


_BALANCE = f"""WITH t AS (SELECT {K}, COUNT(*) n, COUNT(*) FILTER (color = 0) red FROM notes GROUP BY ALL),
 u AS (SELECT *, CASE WHEN red / n > 6e-1 THEN 0 ELSE 1 END color FROM t WHERE n >= 10 AND (red / n < 4e-1 OR red / n > 6e-1)),
 m AS (SELECT {K}, seq, CASE WHEN color = 0 THEN red ELSE n - red END - CAST(FLOOR(n * 5e-1) AS BIGINT) ex, COUNT(*) OVER (PARTITION BY {K}, beat) > 1 g FROM notes JOIN u USING ({KC})),
 r AS (SELECT {K}, seq, ROW_NUMBER() OVER (PARTITION BY {K} ORDER BY g, {H}, seq) <= ex flip FROM m)
 SELECT notes.* REPLACE (CASE WHEN flip THEN 1 - color ELSE color END AS color) FROM notes LEFT JOIN r USING ({K}, seq)"""


@query("rebalance_colors", f"SELECT {K}, seq, color FROM ({_BALANCE.replace('notes', 'skewed')})", {"skewed": "SELECT notes.* REPLACE (CASE WHEN seq % 5 = 0 THEN 1 ELSE 0 END AS color) FROM notes"})
def _(v):
    return R.rebalance_colors(_reddish(v)).select("map_id", "difficulty", "seq", "color")


_SEPARATE = f"""WITH o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {K}, beat ORDER BY seq) k FROM notes), g AS (SELECT {K}, beat, list({{'x': x, 'y': y, 'c': color}} ORDER BY seq) cs, COUNT(*) m, ANY_VALUE(nn) >= 10 big FROM (SELECT *, COUNT(*) OVER (PARTITION BY {K}) nn FROM notes) GROUP BY {K}, beat),
 step AS (SELECT {K}, beat, 0::BIGINT k, m, big, cs FROM g UNION ALL SELECT {K}, beat, k + 1, m, big, [CASE WHEN i = k + 1 THEN {{'x': CASE WHEN NOT big THEN cs[i].x
   WHEN cs[i].c = 0 AND cs[i].x >= 2 THEN CASE WHEN len([j for j in range(1, m + 1) if j <> i AND cs[j].x = 1 AND cs[j].y = cs[i].y]) = 0 THEN 1 WHEN len([j for j in range(1, m + 1) if j <> i AND cs[j].x = 0 AND cs[j].y = cs[i].y]) = 0 THEN 0 ELSE cs[i].x END
   WHEN cs[i].c = 1 AND cs[i].x <= 1 THEN CASE WHEN len([j for j in range(1, m + 1) if j <> i AND cs[j].x = 2 AND cs[j].y = cs[i].y]) = 0 THEN 2 WHEN len([j for j in range(1, m + 1) if j <> i AND cs[j].x = 3 AND cs[j].y = cs[i].y]) = 0 THEN 3 ELSE cs[i].x END ELSE cs[i].x END, 'y': cs[i].y, 'c': cs[i].c}} ELSE cs[i] END for i in range(1, m + 1)] FROM step WHERE k < m)
 SELECT o.map_id, o.difficulty, o.seq, s.cs[o.k].x x FROM step s JOIN o ON o.map_id = s.map_id AND o.difficulty = s.difficulty AND o.beat = s.beat WHERE s.k = s.m"""


@query("separate_colors", _SEPARATE)
def _(v):
    return R.separate_colors(v.notes).select("map_id", "difficulty", "seq", "x")


@query("drop_duplicates", f"SELECT {K}, MIN(seq) seq FROM notes GROUP BY {K}, beat, x, y")
def _(v):
    return R.drop_duplicates(v.notes).select("map_id", "difficulty", "seq")


@query("clear_vision", f"""WITH d AS (SELECT {K}, beat, x, y, ARG_MIN(direction, seq) direction, MIN(seq) seq FROM notes GROUP BY ALL)
 SELECT map_id, difficulty, seq, moved, CASE WHEN moved THEN (x + {H} % 3 + 1) % 4 ELSE x END x, y FROM (SELECT a.map_id, a.difficulty, a.seq, a.x, a.y, EXISTS (SELECT 1 FROM d b WHERE b.map_id = a.map_id AND b.difficulty = a.difficulty AND b.beat = a.beat AND b.x = a.x AND b.y = a.y - 1 AND b.direction = 0) moved FROM d a)""")
def _(v):
    d = R.drop_duplicates(v.notes).withColumn("was", F.col("x"))
    return R.clear_vision(d).select("map_id", "difficulty", "seq", (F.col("x") != F.col("was")).alias("moved"), F.col("x").cast("long").alias("x"), "y")


_ROWS = f"SELECT {KC}, seq, beat, x, y, direction, ROW_NUMBER() OVER w k, beat - LAG(beat) OVER w gap, LEAD(x) OVER w nx FROM notes WINDOW w AS (PARTITION BY {KC} ORDER BY beat, seq)"
_FLOW = """CASE WHEN nx IS NOT NULL AND (ABS(nx - x) >= 2 OR (ABS(nx - x) = 1 AND (x + y) % 2 = 0)) THEN CASE WHEN nx > x THEN CASE WHEN fore THEN 7 ELSE 5 END ELSE CASE WHEN fore THEN 6 ELSE 4 END END
 WHEN x = 0 THEN CASE WHEN y % 2 = 0 THEN CASE WHEN fore THEN 7 ELSE 5 END ELSE CASE WHEN fore THEN 1 ELSE 0 END END
 WHEN x = 3 THEN CASE WHEN y % 2 = 0 THEN CASE WHEN fore THEN 6 ELSE 4 END ELSE CASE WHEN fore THEN 1 ELSE 0 END END
 WHEN fore THEN CASE WHEN y <> 2 THEN 1 WHEN x = 1 THEN 7 ELSE 6 END ELSE CASE WHEN y <> 0 THEN 0 WHEN x = 1 THEN 5 ELSE 4 END END"""


def _walk(fore, result, extra_cols="", extra_from=""):
    """Row-by-row oracle: ``prev`` is the corrected direction of the note before."""
    return f"""WITH r AS ({_ROWS}),
 step AS (SELECT {KC}, 0::BIGINT k, NULL::BIGINT seq, NULL::INTEGER d FROM r GROUP BY ALL
  UNION ALL SELECT {KC}, k, seq, CAST({result} AS INTEGER) FROM (SELECT *, {fore} fore FROM (SELECT r.*, s.d prev FROM step s JOIN r ON r.map_id = s.map_id AND r.difficulty = s.difficulty AND r.color = s.color AND r.k = s.k + 1)))
 SELECT {K}, seq, d direction FROM step WHERE k > 0"""


_DOTS = _walk("COALESCE(prev NOT IN (1,6,7), true)", f"CASE WHEN direction <> 8 OR gap >= 2 THEN direction ELSE {_FLOW} END")


@query("convert_dots", _DOTS)
def _(v):
    return R.convert_dots(v.notes).select("map_id", "difficulty", "seq", "direction")


_PARITY = _walk("direction NOT IN (1,6,7)", f"CASE WHEN prev IS NULL OR prev IN (2,3,8) OR direction IN (2,3,8) OR (prev IN (1,6,7)) <> (direction IN (1,6,7)) THEN direction ELSE {_FLOW} END")


@query("fix_parity", _PARITY)
def _(v):
    return R.fix_parity(v.notes).select("map_id", "difficulty", "seq", "direction")


_FLIPS = _walk("true", "CASE WHEN gap > 0 AND gap * 60000e0 / 1000 < 100 AND direction <> 8 AND direction = [1,0,3,2,7,6,5,4,-1][prev + 1] THEN prev ELSE direction END")


@query("calm_flips", _FLIPS)
def _(v):
    return R.calm_flips(v.notes, v.maps.withColumn("bpm", F.lit(1000.0))).select("map_id", "difficulty", "seq", "direction")


@query("nearest_note", f"""WITH a AS (SELECT {KC}, seq, beat FROM objects WHERE kind IN ('arc','chain')), n AS (SELECT DISTINCT {KC}, beat FROM notes),
 p AS (SELECT a.*, n.beat pb FROM a ASOF LEFT JOIN n ON a.map_id = n.map_id AND a.difficulty = n.difficulty AND a.color = n.color AND a.beat >= n.beat),
 q AS (SELECT p.*, n.beat qb FROM p ASOF LEFT JOIN n ON p.map_id = n.map_id AND p.difficulty = n.difficulty AND p.color = n.color AND p.beat <= n.beat)
 SELECT {K}, seq, CASE WHEN ABS(b - beat) < 1 THEN b END note_beat FROM (SELECT *, CASE WHEN pb IS NULL OR qb - beat < beat - pb THEN COALESCE(qb, pb) ELSE pb END b FROM q)""")
def _(v):
    a = v.objects.where("kind in ('arc', 'chain')").select("map_id", "difficulty", "color", "seq", "beat")
    return R.nearest_note(a, v.notes).select("map_id", "difficulty", "seq", F.col("match_beat").alias("note_beat"))


_RECONNECT = f"""WITH a AS (SELECT {KC}, seq, beat, kind, tail_direction FROM full_events WHERE kind IN ('arc','chain')), n AS (SELECT {KC}, beat, ARG_MIN(x, seq) x, ARG_MIN(y, seq) y, ARG_MIN(direction, seq) d FROM notes GROUP BY ALL),
 p AS (SELECT a.*, n.beat pb FROM a ASOF LEFT JOIN n ON a.map_id = n.map_id AND a.difficulty = n.difficulty AND a.color = n.color AND a.beat >= n.beat),
 q AS (SELECT p.*, n.beat qb FROM p ASOF LEFT JOIN n ON p.map_id = n.map_id AND p.difficulty = n.difficulty AND p.color = n.color AND p.beat <= n.beat),
 h AS (SELECT {KC}, seq, kind, tail_direction td, hb, hb + 1e-2 a2 FROM (SELECT *, CASE WHEN pb IS NULL OR qb - beat < beat - pb THEN COALESCE(qb, pb) ELSE pb END hb FROM q) WHERE ABS(hb - beat) < 1),
 t AS (SELECT h.*, n.beat tb, n.x tx, n.y ty, n.d nd FROM h ASOF JOIN n ON h.map_id = n.map_id AND h.difficulty = n.difficulty AND h.color = n.color AND h.a2 < n.beat)
 SELECT t.map_id, t.difficulty, t.seq, n.beat, n.x, n.y, n.d direction, t.tb tail_beat, t.tx tail_x, t.ty tail_y, CASE t.kind WHEN 'arc' THEN t.nd ELSE t.td END tail_direction FROM t JOIN n ON n.map_id = t.map_id AND n.difficulty = t.difficulty AND n.color = t.color AND n.beat = t.hb"""


@query("reconnect_arcs", _RECONNECT)
def _(v):
    e = R.reconnect_arcs(v.full_events).where("kind in ('arc', 'chain')")
    return e.select("map_id", "difficulty", "seq", "beat", "x", "y", "direction", "tail_beat", "tail_x", "tail_y", "tail_direction")


L = {
    "k_last": "SELECT map_id, round_even(beat, 4) rb, event_type, MAX(seq) seq FROM lights GROUP BY ALL",
    "k_dd": "SELECT lights.* FROM lights SEMI JOIN k_last ON k_last.map_id = lights.map_id AND k_last.seq = lights.seq AND k_last.event_type = lights.event_type",
    "k_cap": "SELECT * EXCLUDE (r) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY map_id, round_even(beat * 4, 0) ORDER BY float_value DESC, beat, seq) r FROM k_dd) WHERE r <= 4",
    "k_rows": "SELECT map_id, event_type, seq, f, ROW_NUMBER() OVER (PARTITION BY map_id, event_type ORDER BY beat, seq) k FROM (SELECT *, CASE WHEN seq % 7 = 0 THEN float_value + 9e-1 WHEN seq % 5 = 0 THEN float_value + 15e-1 ELSE float_value END f FROM k_cap)",
    "k_walk": """SELECT map_id, event_type, k, seq, f v FROM k_rows WHERE k = 1 UNION ALL SELECT r.map_id, r.event_type, r.k, r.seq, CASE WHEN ROUND(r.f - s.v, 9) > 6e-1 THEN ROUND(LEAST(1e0, s.v + 6e-1), 9) WHEN ROUND(r.f - s.v, 9) < -6e-1 THEN ROUND(GREATEST(0e0, s.v - 6e-1), 9) ELSE r.f END FROM k_walk s JOIN k_rows r ON r.map_id = s.map_id AND r.event_type = s.event_type AND r.k = s.k + 1""",
}


@query("dedupe_lights", "SELECT map_id, seq FROM k_dd", L)
def _(v):
    return R.dedupe_lights(v.lights).select("map_id", "seq")


@query("cap_lights", "SELECT map_id, seq FROM k_cap", L)
def _(v):
    return R.cap_lights(R.dedupe_lights(v.lights)).select("map_id", "seq")


@query("smooth_lights", "SELECT map_id, event_type, seq, v float_value FROM k_walk", L)
def _(v):
    jumpy = F.when(F.col("seq") % 7 == 0, F.col("float_value") + 0.9).when(F.col("seq") % 5 == 0, F.col("float_value") + 1.5).otherwise(F.col("float_value"))
    l = R.cap_lights(R.dedupe_lights(v.lights)).withColumn("float_value", jumpy)
    return R.smooth_lights(l).select("map_id", "event_type", "seq", "float_value")


_T = "[" + ", ".join(f"{v:e}" for v in R.DIRECTION_TARGETS.values()) + "]"
#: direction counts of a level, one over-used direction after the other
_SPREAD = f"""WITH c AS (SELECT {K}, COUNT(*) total, [{", ".join(f"COUNT(*) FILTER (direction = {d})" for d in range(9))}] was FROM skewed GROUP BY ALL),
 step AS (SELECT {K}, 0 d, total, was, was cnt FROM c UNION ALL SELECT {K}, d + 1, total, was, CASE WHEN extra <= 0 OR len(room) = 0 THEN cnt ELSE
  list_transform(range(0, 9), lambda i: cnt[i + 1] - CASE WHEN i = d THEN extra ELSE 0 END + CASE WHEN list_contains(room, i) THEN extra // len(room) + CASE WHEN list_position(room, i) <= extra % len(room) THEN 1 ELSE 0 END ELSE 0 END) END
  FROM (SELECT *, CASE WHEN len(r1) > 0 THEN r1 ELSE r2 END room FROM (SELECT *, cnt[d + 1] - CAST(FLOOR(({_T}[d + 1] + 1e-1) * total) AS BIGINT) extra, list_filter(range(0, 9), lambda i: cnt[i + 1] < FLOOR({_T}[i + 1] * total)) r1,
   list_filter(range(0, 9), lambda i: i <> d AND cnt[i + 1] < FLOOR(({_T}[i + 1] + 1e-1) * total)) r2 FROM step WHERE d < 9)))
 SELECT {K}, total n, CASE WHEN total >= 20 THEN cnt ELSE was END counts FROM step WHERE d = 9"""


@query("diversify_directions", _SPREAD, {"skewed": "SELECT notes.* REPLACE (CASE WHEN seq % 4 <> 0 THEN 1 ELSE direction END AS direction) FROM notes"})
def _(v):
    d = R.diversify_directions(v.notes.withColumn("direction", F.when(F.col("seq") % 4 != 0, 1).otherwise(F.col("direction"))))
    return d.groupBy("map_id", "difficulty").agg(F.count("*").alias("n"), F.array(*[F.count_if(F.col("direction") == i) for i in range(9)]).alias("counts"))


@query("rebalance_rows", f"""WITH s AS (SELECT {K}, seq, CASE WHEN seq % 5 = 0 THEN y ELSE 2 END y FROM notes), c AS (SELECT {K}, COUNT(*) n, [COUNT(*) FILTER (y=0), COUNT(*) FILTER (y=1), COUNT(*) FILTER (y=2)] cnt FROM s GROUP BY ALL),
 e AS (SELECT *, list_max(cnt) most, list_position(cnt, list_max(cnt)) - 1 ov, [CAST(FLOOR(n * 47e-2) AS BIGINT), CAST(FLOOR(n * 28e-2) AS BIGINT), CAST(FLOOR(n * 25e-2) AS BIGINT)] want FROM c WHERE n >= 20),
 h AS (SELECT *, most - want[ov + 1] ex, list_filter([0, 1, 2], lambda i: cnt[i + 1] < want[i + 1]) thin FROM e WHERE most / n > 7e-1),
 r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {K}, y ORDER BY {H}, seq) pos FROM s)
 SELECT {K}, seq, CAST(CASE WHEN y = ov AND pos <= ex AND len(thin) > 0 THEN thin[(pos - 1) % len(thin) + 1] ELSE y END AS INTEGER) y FROM r LEFT JOIN h USING ({K})""")
def _(v):
    s = v.notes.withColumn("y", F.when(F.col("seq") % 5 == 0, F.col("y")).otherwise(2))
    return R.rebalance_rows(s).select("map_id", "difficulty", "seq", "y")


@query("spread_cells", f"""WITH s AS (SELECT {K}, seq, beat, x % 2 cell FROM notes), p AS (SELECT {K}, cell, COUNT(*) c FROM s GROUP BY ALL),
 u AS (SELECT {K}, list_filter(range(0, 12), lambda i: NOT list_contains(list(cell), i)) free, 8 - COUNT(*) lacking FROM p GROUP BY ALL HAVING SUM(c) >= 20),
 f AS (SELECT {K}, list(i ORDER BY CAST('0x' || md5(i || '/' || map_id || '/' || difficulty || '/0')[1:15] AS BIGINT)) free, ANY_VALUE(LEAST(len, lacking)) moves FROM (SELECT {K}, lacking, len(free) len, unnest(free) i FROM u) GROUP BY ALL),
 i AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {K}, cell ORDER BY beat, seq) <= c - 2 may FROM s JOIN p USING ({K}, cell)),
 o AS (SELECT *, CAST(SUM(CASE WHEN may THEN 1 ELSE 0 END) OVER (PARTITION BY {K} ORDER BY c DESC, beat, seq) AS BIGINT) pos FROM i)
 SELECT {K}, seq, CAST(CASE WHEN may AND moves > 0 AND pos <= moves THEN free[pos] ELSE cell END AS INTEGER) cell FROM o LEFT JOIN f USING ({K})""")
def _(v):
    s = v.notes.withColumn("x", F.col("x") % 2).withColumn("y", F.lit(0))
    return R.spread_cells(s).select("map_id", "difficulty", "seq", (F.col("x") + 4 * F.col("y")).cast("int").alias("cell"))


@query("vary_repeats", f"""WITH s AS (SELECT {K}, seq, beat, CAST(FLOOR(beat / 20) AS INTEGER) % 9 d FROM notes), c AS (SELECT *, CASE WHEN LAG(d) OVER (PARTITION BY {K} ORDER BY beat, seq) = d THEN 0 ELSE 1 END ch FROM s),
 i AS (SELECT *, SUM(ch) OVER (PARTITION BY {K} ORDER BY beat, seq) run FROM c), p AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {K}, run ORDER BY beat, seq) - 1 k FROM i)
 SELECT {K}, seq, CAST(CASE WHEN k >= 5 AND (k - 5) % 2 = 0 THEN (d + 1 + {H} % 8) % 9 ELSE d END AS INTEGER) direction FROM p""")
def _(v):
    s = v.notes.withColumn("color", F.lit(0)).withColumn("x", F.lit(0)).withColumn("y", F.lit(0)).withColumn("direction", F.floor(F.col("beat") / 20).cast("int") % 9)
    return R.vary_repeats(s).select("map_id", "difficulty", "seq", "direction")


def _redone(stage: str, sql: str, column: str) -> str:
    """``stage`` with one column replaced by what ``sql`` says about its rows."""
    sql = sql.replace("WITH ", "WITH RECURSIVE ", 1)
    return f"SELECT {stage}.* REPLACE (w.{column} AS {column}) FROM {stage} JOIN ({sql}) w ON w.map_id = {stage}.map_id AND w.difficulty = {stage}.difficulty AND w.seq = {stage}.seq"


def _on(sql: str, stage: str) -> str:
    return sql.replace("notes", stage)


_COLS = f"{K}, kind, seq, beat, x, y, color, direction, tail_beat, event_type, float_value"
#: the whole repair, stage by stage, with the walkers above; z names are kept tables
Z = {
    **B, **L,
    "z2": f"SELECT b_two.* FROM b_two SEMI JOIN ({_CAP_DENSITY.replace('b_imp', 'z_imp').replace('secs / 8', 'secs')}) w USING ({K}, seq)",
    "z_imp": _on(B["b_imp"], "b_two"),
    "z3": _on(_BALANCE, "z2"),
    "z4": _redone("z3", _on(_SEPARATE, "z3"), "x"),
    "z5": f"SELECT z4.* FROM z4 SEMI JOIN (SELECT {K}, MIN(seq) seq FROM z4 GROUP BY {K}, beat, x, y) USING ({K}, seq)",
    "z6": f"SELECT a.* REPLACE (CAST(CASE WHEN EXISTS (SELECT 1 FROM z5 b WHERE b.map_id = a.map_id AND b.difficulty = a.difficulty AND b.beat = a.beat AND b.x = a.x AND b.y = a.y - 1 AND b.direction = 0) THEN (a.x + {H} % 3 + 1) % 4 ELSE a.x END AS INTEGER) AS x) FROM z5 a",
    "z7": _redone("z6", _FLIPS.replace("nx FROM notes", "nx, bpm FROM (SELECT z6.*, bpm FROM z6 JOIN maps USING (map_id))").replace("gap * 60000e0 / 1000", "gap * (60000e0 / GREATEST(bpm, 1e0))"), "direction"),
    "z8": _redone("z7", _on(_DOTS, "z7"), "direction"),
    "z9": _redone("z8", _on(_PARITY, "z8"), "direction"),
    "z_rest": f"SELECT full_events.* FROM full_events SEMI JOIN ({_CAP_OBJECTS.replace('secs / 4', 'secs')}) w USING ({K}, kind, seq) WHERE kind <> 'note'",
    "z_arcs": _on(_RECONNECT, "z9").replace("full_events", "z_rest"),
    "z_light": "SELECT map_id, event_type, seq, beat, float_value f, ROW_NUMBER() OVER (PARTITION BY map_id, event_type ORDER BY beat, seq) k FROM k_cap",
    "k_done": L["k_walk"].replace("k_rows", "z_light").replace("k_walk", "k_done"),
}


@query("repair_level", f"""SELECT {K}, 'note' kind, seq, beat, x, y, color, direction, NULL::DOUBLE tail_beat, NULL::INTEGER event_type, NULL::DOUBLE float_value FROM z9
 UNION ALL SELECT {K}, kind, seq, beat, x, y, NULL, NULL, NULL, NULL, NULL FROM z_rest WHERE kind IN ('bomb', 'wall')
 UNION ALL SELECT {K}, r.kind, seq, a.beat, a.x, a.y, r.color, a.direction, a.tail_beat, NULL, NULL FROM z_arcs a JOIN (SELECT {K}, seq, kind, color FROM z_rest WHERE kind IN ('arc', 'chain')) r USING ({K}, seq)
 UNION ALL SELECT map_id, 'Expert', 'boost', seq, beat, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM lights WHERE seq % 9 = 0
 UNION ALL SELECT map_id, 'Expert', 'light', seq, z_light.beat, NULL, NULL, NULL, NULL, NULL, event_type, k_done.v FROM k_done JOIN z_light USING (map_id, event_type, k, seq)""", Z)
def _(v):
    from levelloom.checks.documents import lights_as_events

    shown = [c.strip() for c in _COLS.split(",")]
    out = R.repair_level(lights_as_events(v).select(*shown), v.maps, seconds(v))
    flat = F.col("kind").isin("bomb", "wall", "light", "boost")
    hidden = {c: F.when(~flat, F.col(c)) for c in ("color", "direction")} | {"tail_beat": F.when(F.col("kind").isin("arc", "chain"), F.col("tail_beat"))}
    return out.withColumns(hidden).select(*shown)
