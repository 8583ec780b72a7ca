"""Quality, parity and blacklist queries."""

from pyspark.sql import functions as F

from levelloom.checks.registry import query
from levelloom.functions.scalars import beat_to_frame
from levelloom.operators import parity, quality
from levelloom.session import cut

_OPP = " OR ".join(
    f"(p = {d} AND direction IN ({','.join(map(str, s))}))"
    for d, s in {0: [1, 6, 7], 1: [0, 4, 5], 2: [3, 5, 7], 3: [2, 4, 6], 4: [1, 3, 6, 7], 5: [1, 2, 6, 7], 6: [0, 3, 4, 5], 7: [0, 2, 4, 5]}.items()
)
_CLS = "CASE WHEN direction IN (1,6,7) THEN 'f' WHEN direction IN (0,4,5) THEN 'b' ELSE 'n' END"

CTES = {
    "q_parity": f"""SELECT map_id, difficulty, CAST(SUM(CASE WHEN p IS NOT NULL AND NOT ({_OPP}) THEN 1 ELSE 0 END) AS BIGINT) violations, COUNT(p) checks
 FROM (SELECT *, LAG(direction) OVER (PARTITION BY map_id, difficulty, color ORDER BY beat, x, y, seq) p FROM notes WHERE direction <> 8) t GROUP BY ALL""",
    "q_on": """SELECT map_id, difficulty, COUNT(*) n_onsets, COUNT(*) FILTER (n = 0) n_empty, AVG(n) mean_n, STDDEV_POP(n) sd_n
 FROM (SELECT map_id, difficulty, beat, COUNT(*) FILTER (kind = 'note') n FROM q_at GROUP BY ALL) GROUP BY ALL""",
    "q_at": "SELECT map_id, difficulty, beat, kind FROM objects UNION ALL SELECT map_id, difficulty, tail_beat, 'tail' FROM full_events WHERE kind = 'arc'",
    "q_lit": "SELECT map_id, 'Expert' difficulty, beat FROM lights WHERE event_type < 12",
    "q_lev": "SELECT DISTINCT map_id, difficulty FROM (SELECT map_id, difficulty FROM objects UNION ALL SELECT map_id, difficulty FROM q_lit)",
    "q_cell": """SELECT map_id, difficulty, -SUM(n / t * LOG2(n / t)) h, COUNT(*) used FROM
 (SELECT map_id, difficulty, CAST(COUNT(*) AS DOUBLE) n, SUM(COUNT(*)) OVER (PARTITION BY map_id, difficulty) t FROM notes GROUP BY map_id, difficulty, x, y) GROUP BY ALL""",
    "q_dir": """SELECT map_id, difficulty, -SUM(n / t * LOG2(n / t)) h FROM
 (SELECT map_id, difficulty, CAST(COUNT(*) AS DOUBLE) n, SUM(COUNT(*)) OVER (PARTITION BY map_id, difficulty) t FROM notes WHERE direction <> 8 GROUP BY map_id, difficulty, direction) GROUP BY ALL""",
    "q_tot": """SELECT map_id, difficulty, COUNT(*) total_notes, COUNT(*) FILTER (color = 0) red, COUNT(*) FILTER (direction = 8) dots FROM notes GROUP BY ALL""",
    "q_metrics": """SELECT map_id, difficulty, ROUND(COALESCE(violations,0) / CAST(GREATEST(COALESCE(checks,0),1) AS DOUBLE), 9) parity_rate,
 ROUND(ABS(red / total_notes - 5e-1) * 2, 9) color_imbalance,
 ROUND(CASE WHEN used IS NULL THEN NULL WHEN used <= 1 THEN 0e0 ELSE q_cell.h / LOG2(used) END, 9) grid_entropy,
 ROUND(CASE WHEN n_onsets > 1 THEN sd_n / GREATEST(mean_n, 1e-2) ELSE 0e0 END, 9) nps_cv,
 ROUND(n_empty / n_onsets, 9) empty_ratio, ROUND(COALESCE(q_dir.h / 3, 0e0), 9) dir_entropy,
 ROUND(dots / total_notes, 9) dot_ratio, ROUND(COALESCE(total_notes, 0) / GREATEST(n_frames * 512e0 / 44100e0, 1e0), 9) nps,
 COALESCE(total_notes, 0) total_notes, COALESCE(n_onsets, 0) n_onsets, COALESCE(total_notes, 0) < 5 too_few_notes, n_onsets IS NULL empty
 FROM q_lev LEFT JOIN q_on USING (map_id, difficulty) LEFT JOIN q_tot USING (map_id, difficulty) LEFT JOIN q_parity USING (map_id, difficulty) LEFT JOIN q_cell USING (map_id, difficulty)
 LEFT JOIN q_dir USING (map_id, difficulty) JOIN maps USING (map_id)""",
    "q_score": """SELECT map_id, difficulty, parity_rate, grid_entropy, nps, ROUND(CASE WHEN too_few_notes THEN 0e0 ELSE GREATEST(0e0, LEAST(1e0, 1e0
 - 3e-1 * LEAST(parity_rate / 5e-1, 1e0) - 1e-1 * LEAST(color_imbalance / 8e-1, 1e0) - 15e-2 * (1e0 - grid_entropy) - 15e-2 * (1e0 - dir_entropy)
 - 1e-1 * LEAST(dot_ratio / 3e-1, 1e0) - 1e-1 * LEAST(empty_ratio / 2e-1, 1e0) - CASE WHEN nps > 20 OR nps < 5e-1 THEN 1e-1 ELSE 0e0 END)) END, 9) score FROM q_metrics""",
    "q_song": "SELECT map_id, MAX(score) score FROM q_score GROUP BY map_id",
    "q_idx": "SELECT map_id, n_frames, category, LIST(DISTINCT difficulty) ds FROM objects JOIN maps USING (map_id) GROUP BY ALL",
    "q_meta": f"""SELECT * FROM (SELECT map_id, CASE WHEN n_frames < 9000 THEN 'short_song (' || n_frames || ' frames)' WHEN category IN ('noodle','mapping_extensions') THEN 'modded (' || category || ')'
 WHEN NOT list_contains(ds,'Expert') AND NOT list_contains(ds,'ExpertPlus') THEN 'no_expert_difficulty' END reason FROM q_idx) WHERE reason IS NOT NULL""",
    "q_scored": "SELECT * FROM q_song WHERE map_id NOT IN (SELECT map_id FROM q_meta)",
    "q_cut": "SELECT score cutoff FROM (SELECT score, ROW_NUMBER() OVER (ORDER BY score) - 1 i, COUNT(*) OVER () n FROM q_scored) WHERE i = LEAST(CAST(FLOOR(n * 15e-2) AS BIGINT), n - 1)",
    "q_black": "SELECT map_id, reason FROM q_meta UNION ALL SELECT map_id, printf('low_quality (score=%.3f)', score) reason FROM q_scored, q_cut WHERE score <= cutoff",
}


def _events(v):
    """Objects, the places of arcs' tails, and lights, as a parsed document gives them."""
    lit = v.lights.where("event_type < 12").select("map_id", F.lit("Expert").alias("difficulty"), "seq", "beat", F.lit("light").alias("kind"))
    return v.full_events.unionByName(lit, allowMissingColumns=True)


def _metrics(v):
    return quality.quality_metrics(_events(v), v.maps)


def _index(v):
    return quality.nested_index(quality.map_index(_events(v), _events(v).where("kind = 'light'"), v.maps))


def _pairs(name, where, cond, check):
    return f"""SELECT map_id, difficulty, CAST(SUM(CASE WHEN ({check}) AND ({cond}) THEN 1 ELSE 0 END) AS BIGINT) violations, CAST(SUM(CASE WHEN {check} THEN 1 ELSE 0 END) AS BIGINT) checks FROM
 (SELECT *, LAG(c) OVER w p, LAG(beat) OVER w pb FROM (SELECT *, {_CLS} c FROM notes) WHERE {where} WINDOW w AS (PARTITION BY map_id, difficulty, color ORDER BY beat, seq)) GROUP BY ALL"""


@query("parity_listed", "SELECT * FROM q_parity", CTES)
def _(v):
    return parity.listed_alternation(v.notes)


@query("parity_remembered", _pairs("p2", "c <> 'n'", "p = c", "p IS NOT NULL"))
def _(v):
    return parity.remembered_pairs(v.notes)


@query("parity_gap_reset", _pairs("p4", "c <> 'n'", "p = c", "p IS NOT NULL AND NOT (beat - pb > 3)"))
def _(v):
    return parity.gap_reset(v.notes)


@query("parity_adjacent", _pairs("p5", "true", "p = c", "p IS NOT NULL AND p <> 'n' AND c <> 'n'"))
def _(v):
    return parity.adjacent_only(v.notes)


def _framed(v):
    n = v.notes.join(v.maps.select("map_id", "bpm"), "map_id")
    return n.withColumn("frame", beat_to_frame("beat", "bpm"))


@query("parity_cross_onset", f"""WITH n AS (SELECT notes.*, {_CLS} c, round_even(beat * 60e0 / bpm * 44100e0 / 512e0, 0) frame FROM notes JOIN maps USING (map_id)),
 o AS (SELECT map_id, difficulty, beat, MIN(frame) frame, ARG_MAX(c, (x, y, seq)) FILTER (color = 0) l0, ARG_MAX(c, (x, y, seq)) FILTER (color = 1) l1 FROM n GROUP BY ALL),
 p AS (SELECT map_id, difficulty, beat, frame, LAG(frame) OVER w pf, LAG(l0) OVER w p0, LAG(l1) OVER w p1 FROM o WINDOW w AS (PARTITION BY map_id, difficulty ORDER BY beat)),
 j AS (SELECT n.map_id, n.difficulty, c, CASE color WHEN 0 THEN p0 ELSE p1 END b FROM n JOIN p USING (map_id, difficulty, beat) WHERE (p.frame - pf) / 86e0 <= 3)
 SELECT map_id, difficulty, CAST(SUM(CASE WHEN b IS NOT NULL AND b <> 'n' AND c <> 'n' AND b = c THEN 1 ELSE 0 END) AS BIGINT) violations,
 CAST(SUM(CASE WHEN b IS NOT NULL AND b <> 'n' THEN 1 ELSE 0 END) AS BIGINT) checks FROM j GROUP BY ALL""")
def _(v):
    return parity.cross_onset(_framed(v))


@query("parity_within_onset", f"""SELECT map_id, difficulty, CAST(SUM(CASE WHEN p IS NOT NULL AND p = c THEN 1 ELSE 0 END) AS BIGINT) violations, COUNT(p) checks FROM
 (SELECT *, LAST_VALUE(c IGNORE NULLS) OVER (PARTITION BY map_id, difficulty, color, beat ORDER BY x, y, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) p FROM
 (SELECT *, CASE WHEN {_CLS} <> 'n' THEN {_CLS} END c FROM notes)) GROUP BY ALL""")
def _(v):
    return parity.within_onset(v.notes)


@query("follow_through", """WITH t AS (SELECT *, CAST(x - LAG(x) OVER w AS DOUBLE) dx, CAST(y - LAG(y) OVER w AS DOUBLE) dy FROM notes WINDOW w AS (PARTITION BY map_id, difficulty, color ORDER BY beat, seq)),
 s AS (SELECT *, SQRT(dx*dx+dy*dy) d, [0e0,0e0,-1e0,1e0,-707e-3,707e-3,-707e-3,707e-3,0e0][direction+1] vx, [1e0,-1e0,0e0,0e0,707e-3,707e-3,-707e-3,-707e-3,0e0][direction+1] vy FROM t)
 SELECT map_id, difficulty, ROUND(AVG(CASE WHEN direction = 8 THEN 5e-1 ELSE (1 - (vx*dx/d + vy*dy/d)) * 5e-1 END), 8) misalignment, COUNT(*) moves FROM s WHERE d >= 5e-1 GROUP BY ALL""")
def _(v):
    return parity.follow_through(v.notes)


@query("wrong_side", "SELECT map_id, difficulty, AVG(CASE WHEN (color = 0 AND x >= 2) OR (color = 1 AND x <= 1) THEN 1e0 ELSE 0e0 END) wrong_share, COUNT(*) n_notes FROM notes GROUP BY ALL")
def _(v):
    return parity.wrong_side(v.notes)


@query("quality_metrics", "SELECT * FROM q_metrics", CTES)
def _(v):
    return _metrics(v)


@query("quality_scores", "SELECT map_id, score FROM q_song", CTES)
def _(v):
    return quality.song_scores(_metrics(v))


@query("quality_ranking", """SELECT q_song.map_id, q_song.score, q_song.score <= cutoff blacklisted, ROUND(MAX(parity_rate), 9) worst_parity, MAX(nps) top_nps
 FROM q_song, (SELECT score cutoff FROM (SELECT score, ROW_NUMBER() OVER (ORDER BY score) - 1 i, COUNT(*) OVER () n FROM q_song) WHERE i = LEAST(CAST(FLOOR(n * 15e-2) AS BIGINT), n - 1)) c
 JOIN q_metrics ON q_metrics.map_id = q_song.map_id GROUP BY ALL ORDER BY score DESC, map_id LIMIT 20""", CTES)
def _(v):
    m = _metrics(v)
    s = m.groupBy("map_id").agg(
        F.max(quality.quality_score()).alias("score"), F.round(F.max("parity_rate"), 9).alias("worst_parity"), F.max("nps").alias("top_nps")
    )
    s = cut(s)
    cutoff = quality.pick_by_index(s, "score", {"cutoff": 0.15}).scalar()
    return s.withColumn("blacklisted", F.col("score") <= cutoff).orderBy(F.desc("score"), "map_id").limit(20)


@query("score_distribution", """SELECT MIN(score) FILTER (i = 0) "min", MIN(score) FILTER (i = FLOOR(n * 1e-1)) p10, MIN(score) FILTER (i = FLOOR(n * 25e-2)) p25,
 MIN(score) FILTER (i = FLOOR(n * 5e-1)) median, MIN(score) FILTER (i = FLOOR(n * 75e-2)) p75, MIN(score) FILTER (i = FLOOR(n * 9e-1)) p90, MAX(score) "max"
 FROM (SELECT score, ROW_NUMBER() OVER (ORDER BY score) - 1 i, COUNT(*) OVER () n FROM q_song)""", CTES)
def _(v):
    return quality.score_distribution(quality.song_scores(_metrics(v)))


_SHORT = 9000  # the views' maps are all longer than the real limit, so the check raises it


def _short_index(v):
    # scale frame counts so that the fixed limit separates the views' maps
    return _index(v).withColumn("n_frames", F.when(F.col("n_frames") < _SHORT, F.col("n_frames") % 600).otherwise(F.col("n_frames")))


CTES["q_meta"] = CTES["q_meta"].replace("n_frames || ' frames", "(n_frames % 600) || ' frames")


@query("blacklist_metadata", "SELECT * FROM q_meta", CTES)
def _(v):
    return quality.metadata_blacklist(_short_index(v))


@query("blacklist", "SELECT * FROM q_black", CTES)
def _(v):
    return quality.quality_blacklist(_short_index(v), _metrics(v))


@query("blacklist_reasons", "SELECT split_part(reason, ' (', 1) kind, COUNT(*) n FROM q_black GROUP BY 1", CTES)
def _(v):
    return quality.reason_summary(quality.quality_blacklist(_short_index(v), _metrics(v)))


@query("map_index", """SELECT o.map_id, o.difficulty, n_frames, category, CASE WHEN o.map_id % 3 = 0 THEN 'unknown' ELSE 'genre ' || o.map_id % 5 END genre, n_onsets, COALESCE(n_lights, 0) n_lights FROM
 (SELECT map_id, difficulty, COUNT(DISTINCT beat) n_onsets FROM q_at GROUP BY ALL) o JOIN maps USING (map_id)
 LEFT JOIN (SELECT map_id, difficulty, COUNT(DISTINCT beat) n_lights FROM q_lit GROUP BY ALL) l ON l.map_id = o.map_id AND l.difficulty = o.difficulty""", CTES)
def _(v):
    e = _events(v)
    genre = F.when(F.col("map_id") % 3 != 0, F.concat(F.lit("genre "), F.col("map_id") % 5))
    return quality.map_index(e, e.where("kind = 'light'"), v.maps.withColumn("genre", genre))
