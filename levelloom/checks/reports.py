"""Report, check, accuracy and experiment-log queries."""

from pyspark.sql import functions as F

from levelloom.checks.curation import R_CTES, reference
from levelloom.checks.quality import CTES as Q
from levelloom.checks.registry import query
from levelloom.operators import experiments as X, parity, reports as R, timing

_C = "CASE WHEN direction IN (1,6,7) THEN 'f' ELSE 'b' END"
DIRS = ", ".join(f"COUNT(*) FILTER (kind='note' AND direction={d}) dir_{d}" for d in range(9))
P = {
    "p_par": f"SELECT map_id, difficulty, SUM(CASE WHEN p = c THEN 1 ELSE 0 END) v, COUNT(p) k FROM (SELECT *, LAG(c) OVER (PARTITION BY map_id, difficulty, color ORDER BY beat, seq) p FROM (SELECT *, {_C} c FROM notes WHERE direction NOT IN (2,3,8))) GROUP BY ALL",
    "p_col": "SELECT map_id, difficulty, SUM(n - 1) v FROM (SELECT map_id, difficulty, round_even(beat, 3) b, color, COUNT(*) n FROM notes GROUP BY ALL) GROUP BY ALL",
    "p_pos": "SELECT map_id, difficulty, SUM(n - 1) v FROM (SELECT map_id, difficulty, round_even(beat, 3) b, x, y, COUNT(*) n FROM notes GROUP BY ALL) GROUP BY ALL",
    "p_sec": "SELECT map_id, difficulty, MAX(beat) / (ANY_VALUE(bpm) / 60e0) secs FROM objects JOIN maps USING (map_id) GROUP BY ALL",
    "p_cnt": f"SELECT map_id, difficulty, COUNT(*) FILTER (kind='note') n_notes, COUNT(*) FILTER (kind='bomb') n_bombs, COUNT(*) FILTER (kind='wall') n_walls, COUNT(*) FILTER (kind='arc') n_arcs, COUNT(*) FILTER (kind='chain') n_chains, COUNT(*) FILTER (kind='note' AND color=0) red, {DIRS} FROM objects GROUP BY ALL",
    "p_rep": """SELECT map_id, difficulty, n_notes, n_bombs, n_walls, n_arcs, n_chains, dir_0, dir_1, dir_2, dir_3, dir_4, dir_5, dir_6, dir_7, dir_8, CAST(COALESCE(p_col.v,0) AS BIGINT) n_same_color_same_beat, CAST(COALESCE(p_pos.v,0) AS BIGINT) n_collisions,
 CAST(COALESCE(p_par.v,0) AS BIGINT) n_parity_violations, red / GREATEST(n_notes,1) color_balance, n_notes / secs notes_per_sec, CAST(COALESCE(p_par.v,0) AS DOUBLE) / GREATEST(n_notes - 1, 1) parity_rate, CAST(COALESCE(p_pos.v,0) AS DOUBLE) / GREATEST(n_notes,1) collision_rate
 FROM p_cnt LEFT JOIN p_col USING (map_id, difficulty) LEFT JOIN p_pos USING (map_id, difficulty) LEFT JOIN p_par USING (map_id, difficulty) JOIN p_sec USING (map_id, difficulty)""",
    "p_gap": "SELECT p_rep.*, maps.mapper_id, r.n_maps, CASE WHEN r.n_maps IS NULL THEN NULL ELSE "
    + "+".join(f"GREATEST(p_rep.dir_{d} / t, 1e-6) * LN(GREATEST(p_rep.dir_{d} / t, 1e-6) / GREATEST(r.dir_{d}, 1e-6))" for d in range(9))
    + " END kl, ABS(notes_per_sec - mean_nps) g_nps, ABS(parity_rate - parity_rate_baseline) g_par, ABS(p_rep.color_balance - r.color_balance) g_col FROM (SELECT *, GREATEST(dir_0+dir_1+dir_2+dir_3+dir_4+dir_5+dir_6+dir_7+dir_8, 1) t FROM p_rep) p_rep JOIN maps USING (map_id) LEFT JOIN (SELECT * FROM r_ref WHERE mapper_id % 4 <> 0) r USING (mapper_id)",
    **{k: v for k, v in R_CTES.items() if k.startswith("r_")},
}


def report(v):
    return R.playability_report(v.objects, timing.map_seconds(v.objects, v.maps))


@query("playability_report", "SELECT * FROM p_rep", P)
def _(v):
    return report(v)


def _gaps(v):
    r = report(v).join(v.maps.select("map_id", "mapper_id"), "map_id")
    return R.style_gaps(r, reference(v).where("mapper_id % 4 <> 0"), "mapper_id")


@query("style_gaps", "SELECT map_id, difficulty, ROUND(kl, 8) direction_kl, ROUND(g_nps, 8) nps_gap, ROUND(g_par, 8) parity_rate_gap, ROUND(g_col, 8) color_balance_gap FROM p_gap", P)
def _(v):
    cols = ["direction_kl", "nps_gap", "parity_rate_gap", "color_balance_gap"]
    return _gaps(v).select("map_id", "difficulty", *[F.round(c, 8).alias(c) for c in cols])


@query("evaluation_rows", """SELECT map_id, difficulty, ROUND(25e-2 * GREATEST(0e0, 1 - LEAST(parity_rate, 1e0)) + 15e-2 * GREATEST(0e0, 1 - LEAST(collision_rate, 1e0))
 + 1e-1 * CASE WHEN n_notes < 40 THEN n_notes / 40e0 WHEN n_notes > 2000 THEN GREATEST(0e0, 1 - (n_notes - 2000) / 2000e0) ELSE 1e0 END + 1e-1 * GREATEST(0e0, 1 - LEAST(n_walls / GREATEST(n_notes, 1), 1e0))
 + 15e-2 * COALESCE(EXP(-kl), 5e-1) + 15e-2 * COALESCE(EXP(-g_nps / 3), 5e-1) + 5e-2 * COALESCE(1 - LEAST(g_par * 5, CASE WHEN g_par IS NULL THEN NULL ELSE 1e0 END), 5e-1) + 5e-2 * COALESCE(1 - LEAST(g_col * 2, CASE WHEN g_col IS NULL THEN NULL ELSE 1e0 END), 5e-1), 8) composite_score FROM p_gap""".replace(
    "COALESCE(1 - LEAST(g_par * 5, CASE WHEN g_par IS NULL THEN NULL ELSE 1e0 END), 5e-1)", "CASE WHEN g_par IS NULL THEN 5e-1 ELSE 1 - LEAST(g_par * 5, 1e0) END").replace(
    "COALESCE(1 - LEAST(g_col * 2, CASE WHEN g_col IS NULL THEN NULL ELSE 1e0 END), 5e-1)", "CASE WHEN g_col IS NULL THEN 5e-1 ELSE 1 - LEAST(g_col * 2, 1e0) END"), P)
def _(v):
    r = report(v).join(v.maps.select("map_id", "mapper_id"), "map_id")
    e = X.evaluation_rows(r, reference(v).where("mapper_id % 4 <> 0"), "mapper_id")
    return e.select("map_id", "difficulty", F.round("composite_score", 8).alias("composite_score"))


@query("pick_document", "SELECT map_id, CASE WHEN bool_or(difficulty = 'Expert') THEN 'ExpertStandard.dat' ELSE 'HardStandard.dat' END member FROM objects GROUP BY map_id")
def _(v):
    m = v.objects.select("map_id", "difficulty").distinct().select(
        "map_id", F.explode(F.array(F.concat("difficulty", F.lit("Standard.dat")), F.lit("ExpertInfo.dat"), F.lit("AExpert.dat"))).alias("member"))
    text = F.when(F.col("member") == "AExpert.dat", '{"_notes":[]}').otherwise('{"colorNotes":[]}')
    return R.pick_document(m.select("map_id", "member", F.length("member").alias("pos"), text.alias("text"))).select("map_id", "member")


@query("content_metrics", """WITH gaps AS (SELECT map_id, difficulty, LEAD(beat) OVER (PARTITION BY map_id, difficulty ORDER BY seq) - beat g FROM notes),
 lit AS (SELECT map_id, CASE WHEN seq % 3 = 0 THEN 'Hard' ELSE 'Expert' END difficulty, COUNT(*) n_lights FROM lights GROUP BY ROLLUP (1, 2) HAVING map_id IS NOT NULL),
 dr AS (SELECT map_id, difficulty, string_agg(direction || ':' || n, ',' ORDER BY direction) directions FROM (SELECT map_id, difficulty, direction, COUNT(*) n FROM notes GROUP BY ALL) GROUP BY ALL),
 ce AS (SELECT map_id, difficulty, string_agg(x || '/' || y, ',' ORDER BY x, y) grid_cells FROM (SELECT DISTINCT map_id, difficulty, x, y FROM notes) GROUP BY ALL),
 med AS (SELECT map_id, difficulty, round_even(list_sort(list(g))[CAST(FLOOR(COUNT(*) / 2) AS BIGINT) + 1], 4) median_note_interval FROM gaps WHERE g > 0 GROUP BY ALL),
 per AS (SELECT map_id, difficulty, COUNT(DISTINCT (x, y)) grid_coverage, COUNT(DISTINCT (color, x, y, direction)) unique_patterns, COUNT(*) FILTER (color=0) red_notes, COUNT(*) FILTER (color=1) blue_notes, round_even(MAX(beat)-MIN(beat), 2) duration_beats FROM notes GROUP BY ALL),
 tot AS (SELECT map_id, difficulty, COUNT(*) FILTER (kind='note') n_notes, COUNT(*) FILTER (kind='bomb') n_bombs, COUNT(*) FILTER (kind='wall') n_walls, COUNT(*) FILTER (kind='arc') n_arcs, COUNT(*) FILTER (kind='chain') n_chains FROM objects GROUP BY ROLLUP (map_id, difficulty) HAVING map_id IS NOT NULL)
 SELECT tot.*, grid_coverage, unique_patterns, red_notes, blue_notes, duration_beats, median_note_interval, directions, grid_cells, COALESCE(n_lights, 0) n_lights, red_notes / GREATEST(1, red_notes + blue_notes) color_balance FROM tot LEFT JOIN per USING (map_id, difficulty) LEFT JOIN med USING (map_id, difficulty)
 LEFT JOIN dr USING (map_id, difficulty) LEFT JOIN ce USING (map_id, difficulty) LEFT JOIN lit ON lit.map_id = tot.map_id AND lit.difficulty IS NOT DISTINCT FROM tot.difficulty""")
def _(v):
    lit = v.lights.withColumn("difficulty", F.when(F.col("seq") % 3 == 0, "Hard").otherwise("Expert"))
    m = R.content_metrics(v.objects, lit)
    pairs = F.transform(F.map_entries("directions"), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    cells = F.transform("grid_cells", lambda c: F.concat(c["x"], F.lit("/"), c["y"]))
    return m.withColumn("directions", F.array_join(pairs, ",")).withColumn("grid_cells", F.array_join(cells, ","))


@query("note_intervals", "SELECT map_id, difficulty, g gap FROM (SELECT map_id, difficulty, LEAD(beat) OVER (PARTITION BY map_id, difficulty ORDER BY seq) - beat g FROM notes) WHERE g > 0")
def _(v):
    return R.note_intervals(v.notes)


def _shifted(v):
    """Notes with a few cells and directions pushed out of range."""
    return v.notes.withColumn("x", F.when(F.col("seq") % 50 == 0, 5).otherwise(F.col("x"))).withColumn("direction", F.when(F.col("seq") % 77 == 0, 9).otherwise(F.col("direction")))


I = {
    "i_bounds": """SELECT map_id, difficulty, 'error' severity, 'grid_bounds' "check", 'note has invalid position (5, ' || y || ')' message, beat FROM notes WHERE seq % 50 = 0
 UNION ALL SELECT map_id, difficulty, 'error', 'direction_bounds', 'note has invalid direction 9', beat FROM notes WHERE seq % 77 = 0""",
    "i_over": """SELECT map_id, difficulty, 'error' severity, 'overlap' "check", 'overlapping notes at cell (' || x || ', ' || y || ')' message, b beat FROM (SELECT map_id, difficulty, round_even(beat, 2) b, x, y, ROW_NUMBER() OVER (PARTITION BY map_id, difficulty, round_even(beat, 2), x, y) k FROM notes) WHERE k > 1
 UNION ALL SELECT map_id, difficulty, 'error', 'same_color_excess', COUNT(*) || CASE color WHEN 0 THEN ' red' ELSE ' blue' END || ' notes on one beat', round_even(beat, 2) FROM notes GROUP BY map_id, difficulty, color, round_even(beat, 2) HAVING COUNT(*) > 2""",
    "i_dens": """SELECT map_id, difficulty, 'warning' severity, 'note_clumping' "check", c || ' beats have >3 notes' message, CAST(NULL AS DOUBLE) beat FROM i_d WHERE c > 0 UNION ALL SELECT map_id, difficulty, 'error', 'extreme_clumping', e || ' beats have >4 notes', NULL FROM i_d WHERE e > 0""",
    "i_d": "SELECT map_id, difficulty, COUNT(*) FILTER (n > 3) c, COUNT(*) FILTER (n > 4) e FROM (SELECT map_id, difficulty, round_even(beat, 2) b, COUNT(*) n FROM notes GROUP BY ALL) GROUP BY ALL",
    "i_p": f"SELECT map_id, difficulty, SUM(CASE WHEN p = c AND NOT (beat - pb > 3) THEN 1 ELSE 0 END) v, SUM(CASE WHEN p IS NOT NULL AND NOT (beat - pb > 3) THEN 1 ELSE 0 END) k FROM (SELECT *, LAG(c) OVER w p, LAG(beat) OVER w pb FROM (SELECT *, {_C} c FROM notes WHERE direction NOT IN (2,3,8)) WINDOW w AS (PARTITION BY map_id, difficulty, color ORDER BY beat, seq)) GROUP BY ALL",
    "i_par": """SELECT map_id, difficulty, CASE WHEN v / k > 1e-1 THEN 'error' WHEN v / k > 2e-2 THEN 'warning' ELSE 'info' END severity, 'parity' "check", v || '/' || k message, CAST(NULL AS DOUBLE) beat FROM i_p WHERE k > 0""",
    "i_t": "SELECT map_id, difficulty, COUNT(*) n, COUNT(*) FILTER (color=0) red, COUNT(*) FILTER (color=1) blue, COUNT(*) FILTER (direction=8) dots FROM notes GROUP BY ALL",
    "i_bal": """SELECT map_id, difficulty, CASE WHEN red / (red+blue) < 3e-1 OR red / (red+blue) > 7e-1 THEN 'warning' ELSE 'info' END severity, 'color_balance' "check", red || '/' || blue message, CAST(NULL AS DOUBLE) beat FROM i_t""",
    "i_dot": """SELECT map_id, difficulty, 'warning' severity, 'dot_overuse' "check", dots || '/' || n message, CAST(NULL AS DOUBLE) beat FROM i_t WHERE dots / n > 15e-2""",
    "i_empty": """SELECT DISTINCT map_id + 100000 map_id, difficulty, 'warning' severity, 'empty' "check", 'no notes found' message, CAST(NULL AS DOUBLE) beat FROM objects WHERE map_id % 7 = 0""",
    "i_all": "SELECT * FROM i_over UNION ALL SELECT * FROM i_dens UNION ALL SELECT * FROM i_par UNION ALL SELECT * FROM i_bal UNION ALL SELECT * FROM i_dot UNION ALL SELECT * FROM i_empty",
}


@query("check_bounds", "SELECT * FROM i_bounds", I)
def _(v):
    return R.check_bounds(_shifted(v))


@query("check_overlaps", "SELECT * FROM i_over", I)
def _(v):
    return R.check_overlaps(v.notes)


@query("check_density", "SELECT * FROM i_dens", I)
def _(v):
    return R.check_density(v.notes)


@query("check_parity", "SELECT * FROM i_par", I)
def _(v):
    return R.check_parity(v.notes)


@query("check_color_balance", "SELECT * FROM i_bal", I)
def _(v):
    return R.check_color_balance(v.notes)


@query("check_dots", "SELECT * FROM i_dot", I)
def _(v):
    return R.check_dots(v.notes)


def _issues(v):
    levels = v.objects.select("map_id", "difficulty")
    extra = levels.where("map_id % 7 = 0").withColumn("map_id", F.col("map_id") + 100000)
    return R.check_playability(v.notes, levels.unionByName(extra))


@query("check_playability", "SELECT * FROM i_all", I)
def _(v):
    return _issues(v)


@query("issue_summary", "SELECT map_id, difficulty, COUNT(*) FILTER (severity='error') error, COUNT(*) FILTER (severity='warning') warning, COUNT(*) FILTER (severity='info') info, COUNT(*) total FROM i_all GROUP BY ALL", I)
def _(v):
    return R.summarize_issues(_issues(v))


@query("token_accuracy", "SELECT map_id, COALESCE(AVG(CASE WHEN pred = target THEN 1e0 ELSE 0e0 END) FILTER (target <> 0), 0e0) token_acc, AVG(CASE WHEN pred = target THEN 1e0 ELSE 0e0 END) FILTER (target = 1) eos_acc, COUNT(*) FILTER (target <> 0) n_tokens FROM token_pred GROUP BY map_id")
def _(v):
    return R.token_accuracy(v.token_pred, ["map_id"])


@query("slot_accuracy", "SELECT ROUND(AVG(CASE WHEN (direction + 1) % 9 = direction % 4 THEN 1e0 ELSE 0e0 END) FILTER (color = 0), 12) direction_acc, ROUND(AVG(CASE WHEN x = y THEN 1e0 ELSE 0e0 END), 12) col_acc FROM notes")
def _(v):
    n = v.notes.select(((F.col("direction") + 1) % 9).alias("pred_direction"), F.when(F.col("color") == 0, F.col("direction") % 4).otherwise(-1).alias("target_direction"), F.col("x").alias("pred_col"), F.col("y").alias("target_col"))
    return R.slot_accuracy(n, ["direction", "col"]).select(F.round("direction_acc", 12).alias("direction_acc"), F.round("col_acc", 12).alias("col_acc"))


_PRED = "SELECT map_id, frame pos FROM frames WHERE prob > 7e-1 AND map_id % 5 <> 0"
_TRUE = "SELECT map_id, frame * 3 pos FROM frames WHERE onset_strength > 6e-1 AND map_id % 9 <> 0"
_M_REC = f"""WITH ps AS (SELECT map_id, pos, ROW_NUMBER() OVER (PARTITION BY map_id ORDER BY pos) k FROM ({_PRED})), ts AS (SELECT map_id, list(pos ORDER BY pos) ts FROM ({_TRUE}) GROUP BY map_id),
 step AS (SELECT map_id, 0::BIGINT k, ts, 0::BIGINT tp FROM ts UNION ALL SELECT map_id, nk, CASE WHEN ok THEN list_filter(ts, lambda e, i: i <> best) ELSE ts END, tp + CASE WHEN ok THEN 1 ELSE 0 END FROM
 (SELECT s.map_id, p.k nk, s.ts, s.tp, list_position(list_transform(s.ts, lambda e: ABS(e - p.pos)), list_min(list_transform(s.ts, lambda e: ABS(e - p.pos)))) best, COALESCE(list_min(list_transform(s.ts, lambda e: ABS(e - p.pos))) <= 3, false) ok FROM step s JOIN ps p ON p.map_id = s.map_id AND p.k = s.k + 1)),
 tps AS (SELECT map_id, MAX(tp) tp FROM step GROUP BY map_id), n AS (SELECT map_id, COALESCE(a, 0) n_pred, COALESCE(b, 0) n_true FROM maps LEFT JOIN (SELECT map_id, COUNT(*) a FROM ps GROUP BY 1) USING (map_id) LEFT JOIN (SELECT map_id, len(ts) b FROM ts) USING (map_id)),
 pr AS (SELECT map_id, n_pred, n_true, COALESCE(tp, 0) tp, CASE WHEN n_pred > 0 AND n_true > 0 THEN tp / n_pred WHEN n_pred > 0 THEN 0e0 ELSE 1e0 END "precision", CASE WHEN n_pred > 0 AND n_true > 0 THEN tp / n_true WHEN n_true > 0 THEN 0e0 ELSE 1e0 END recall FROM n LEFT JOIN tps USING (map_id)),
 sc AS (SELECT *, CASE WHEN n_pred = 0 AND n_true = 0 THEN 1e0 WHEN n_pred > 0 AND n_true > 0 AND "precision" + recall > 0 THEN 2 * "precision" * recall / ("precision" + recall) ELSE 0e0 END f1 FROM pr)"""


def _onset_scores(v):
    f = v.frames
    pred = f.where("prob > 0.7 and map_id % 5 <> 0").select("map_id", "frame")
    truth = f.where("onset_strength > 0.6 and map_id % 9 <> 0").select("map_id", (F.col("frame") * 3).alias("frame"))
    return R.onset_scores(pred, truth, ["map_id"], groups=v.maps)


@query("onset_scores", _M_REC + " SELECT * FROM sc")
def _(v):
    return _onset_scores(v)


@query("onset_mean_scores", _M_REC + ' SELECT ROUND(AVG("precision"), 9) mean_precision, ROUND(AVG(recall), 9) mean_recall, ROUND(AVG(f1), 9) mean_f1 FROM sc')
def _(v):
    m = R.mean_scores(_onset_scores(v))
    return m.select(*[F.round(c, 9).alias(c) for c in m.columns])


@query("gap_histogram", "SELECT *, n / SUM(n) OVER () share FROM (SELECT CASE WHEN g < 3e-1 THEN 'sixteenth' WHEN g < 6e-1 THEN 'eighth' WHEN g < 11e-1 THEN 'quarter' WHEN g < 21e-1 THEN 'half' ELSE 'longer' END gap_type, COUNT(*) n FROM (SELECT LEAD(beat) OVER (PARTITION BY map_id, difficulty ORDER BY seq) - beat g FROM notes) WHERE g > 0 GROUP BY 1)")
def _(v):
    return R.gap_histogram(v.notes)


@query("row_shares", "SELECT y, COUNT(*) n, COUNT(*) / SUM(COUNT(*)) OVER () share FROM notes GROUP BY y")
def _(v):
    return R.row_shares(v.notes)


@query("kind_coverage", "SELECT " + ", ".join(f"AVG(CASE WHEN n_{k}s > 0 THEN 1e0 ELSE 0e0 END) {k}_share" for k in R.KINDS) + " FROM p_cnt", P)
def _(v):
    return R.kind_coverage(v.objects)


# ---- experiment log --------------------------------------------------------
_LATEST = "SELECT * EXCLUDE (k) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY experiment_id ORDER BY line_pos DESC) k FROM experiment_log) WHERE k = 1"


@query("leaderboard_latest", _LATEST)
def _(v):
    return X.latest_rows(v.experiment_log)


@query("leaderboard_top", f"SELECT *, ROW_NUMBER() OVER (ORDER BY composite_score DESC NULLS LAST, experiment_id) \"rank\" FROM (SELECT * REPLACE (CASE WHEN line_pos % 5 = 0 THEN NULL ELSE composite_score END AS composite_score) FROM ({_LATEST})) WHERE data_source = 'cohort:3' ORDER BY composite_score DESC NULLS LAST, experiment_id LIMIT 30")
def _(v):
    l = X.latest_rows(v.experiment_log).withColumn("composite_score", F.when(F.col("line_pos") % 5 != 0, F.col("composite_score")))
    return X.ranked(X.from_source(l, cohort="3")).withColumn("rank", F.col("rank").cast("long"))


@query("leaderboard_nested_key", f"SELECT experiment_id, parity_rate, ROW_NUMBER() OVER (ORDER BY parity_rate, experiment_id) \"rank\" FROM ({_LATEST}) ORDER BY parity_rate, experiment_id LIMIT 10")
def _(v):
    l = X.latest_rows(v.experiment_log).withColumn("playability", F.struct("parity_rate"))
    r = X.ranked(l, "playability.parity_rate", descending=False, limit=10)
    return r.select("experiment_id", F.col("playability.parity_rate").alias("parity_rate"), F.col("rank").cast("long").alias("rank"))


@query("run_scalars", "SELECT stage, version, tag, ARG_MAX(val, step) \"value\" FROM (SELECT o_orderstatus stage, o_custkey % 7 version, o_orderpriority tag, o_orderkey step, o_totalprice val FROM orders) WHERE (stage, version) IN (SELECT (o_orderstatus, MAX(o_custkey % 7)) FROM orders GROUP BY o_orderstatus) GROUP BY ALL")
def _(v):
    o = v.orders.select(F.col("o_orderstatus").alias("stage"), (F.col("o_custkey") % 7).alias("version"), F.col("o_orderpriority").alias("tag"), F.col("o_orderkey").alias("step"), F.col("o_totalprice").alias("value"))
    return X.run_scalars(o)


@query("history_deltas", "SELECT line_pos, data_source, composite_score, composite_score - LAG(composite_score) OVER w d_composite_score, parity_rate - LAG(parity_rate) OVER w d_parity_rate FROM experiment_log WINDOW w AS (PARTITION BY data_source ORDER BY logged_at, line_pos)")
def _(v):
    h = X.history_deltas(v.experiment_log, ["data_source"], ["composite_score", "parity_rate"])
    return h.select("line_pos", "data_source", "composite_score", "d_composite_score", "d_parity_rate")


@query("failure_classes", "SELECT CAST(doc_id AS VARCHAR) path, CASE WHEN doc_id % 10 = 0 THEN 'timeout' WHEN contains(t, 'CUDA out of memory') OR contains(t, 'OutOfMemoryError') OR contains(t, 'CUBLAS_STATUS_ALLOC_FAILED') THEN 'oom' ELSE 'error' END failure FROM (SELECT doc_id, text || CASE WHEN doc_id % 3 = 1 THEN ' torch.cuda.OutOfMemoryError: x' ELSE '' END t FROM documents)")
def _(v):
    d = v.documents.select(F.col("doc_id").cast("string").alias("path"), F.concat("text", F.when(F.col("doc_id") % 3 == 1, " torch.cuda.OutOfMemoryError: x").otherwise("")).alias("value"))
    return X.classify_logs(d, F.col("path").cast("long") % 10 == 0)
