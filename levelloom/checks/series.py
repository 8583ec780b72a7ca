"""Frame-series, onset, section and training-sample queries."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from levelloom.checks.registry import query
from levelloom.checks.documents import T_CTES
from levelloom.checks.tokens import E_CTES, L_CTES, text
from levelloom.operators import samples as S, series as R, timing, tokens as T
from levelloom.plans.ordered import asof

HOP = 22050  # the views' frames run at two per second


def counts(v):
    return v.frames.groupBy("map_id").agg(F.count("*").cast("int").alias("n_frames"))


A = {
    "a_n": "SELECT map_id, CAST(COUNT(*) AS INTEGER) n FROM frames GROUP BY map_id",
    "a_smooth": """SELECT f.map_id, f.frame, f.prob, ROUND(AVG(g.rms) + 1e-12, 9) s FROM frames f JOIN a_n USING (map_id) JOIN frames g ON g.map_id = f.map_id AND g.frame BETWEEN f.frame - LEAST(200, n) // 2 AND f.frame - LEAST(200, n) // 2 + LEAST(200, n) - 1 GROUP BY ALL""",
    "a_thr": "SELECT map_id, frame, prob, ROUND(25e-2 + (1 - CASE WHEN mx > mn THEN (s - mn) / (mx - mn) ELSE 5e-1 END) * 2e-1 + 1e-12, 9) threshold FROM (SELECT *, MIN(s) OVER (PARTITION BY map_id) mn, MAX(s) OVER (PARTITION BY map_id) mx FROM a_smooth)",
    "a_peak": "SELECT map_id, frame, prob FROM (SELECT *, LAG(prob, 1, -1e0) OVER w l, LEAD(prob, 1, -1e0) OVER w r FROM frames WINDOW w AS (PARTITION BY map_id ORDER BY frame)) WHERE prob >= 5e-1 AND prob >= l AND prob >= r",
    # suppression: a peak is kept when no kept peak of higher rank lies within reach; ranks are walked per map
    "a_rank": "SELECT *, ROW_NUMBER() OVER (PARTITION BY map_id ORDER BY prob DESC, frame) k FROM a_peak",
    "a_nms": """SELECT map_id, 0::BIGINT k, []::INTEGER[] kept FROM a_rank GROUP BY map_id UNION ALL
 SELECT s.map_id, r.k, CASE WHEN len(list_filter(s.kept, lambda f: ABS(f - r.frame) < 5)) > 0 THEN s.kept ELSE list_append(s.kept, r.frame) END FROM a_nms s JOIN a_rank r ON r.map_id = s.map_id AND r.k = s.k + 1""",
    "a_kept": "SELECT map_id, unnest(ARG_MAX(kept, k)) frame FROM a_nms GROUP BY map_id",
}


@query("moving_average", "SELECT map_id, frame, s smooth FROM a_smooth", A)
def _(v):
    return R.moving_average(v.frames).select("map_id", "frame", F.col("smooth"))


@query("adaptive_threshold", "SELECT map_id, frame, ROUND(threshold + 3e-10, 7) threshold FROM a_thr", A)
def _(v):
    return R.adaptive_threshold(v.frames).select("map_id", "frame", F.round(F.col("threshold") + 3e-10, 7).alias("threshold"))


@query("local_maxima", "SELECT map_id, frame, prob FROM a_peak", A)
def _(v):
    return R.local_maxima(v.frames).select("map_id", "frame", "prob")


@query("suppress_close", "SELECT map_id, frame FROM a_kept", A)
def _(v):
    return R.suppress_close(R.local_maxima(v.frames))


@query("same_convolution", """SELECT f.map_id, f.frame, ROUND(CASE WHEN ANY_VALUE(n) < ANY_VALUE(w) THEN f.rms ELSE SUM(g.rms) / ANY_VALUE(w) END, 7) smooth FROM (SELECT frames.*, bpm, CAST(FLOOR(60e0 / bpm * 2 * 4) AS INTEGER) w FROM frames JOIN maps USING (map_id)) f JOIN a_n USING (map_id)
 JOIN frames g ON g.map_id = f.map_id AND g.frame BETWEEN f.frame - (w - 1 - (w - 1) // 2) AND f.frame + (w - 1) // 2 GROUP BY f.map_id, f.frame, f.rms""", A)
def _(v):
    f = v.frames.join(v.maps.select("map_id", "bpm"), "map_id")
    s = R.same_convolution(f, "rms", F.floor(60.0 / F.col("bpm") * 2 * 4), "smooth")
    return s.select("map_id", "frame", F.round("smooth", 7).alias("smooth"))


@query("min_max", "SELECT map_id, frame, CASE WHEN mx > mn THEN (rms - mn) / (mx - mn) ELSE 5e-1 END energy FROM (SELECT *, MIN(rms) OVER (PARTITION BY map_id) mn, MAX(rms) OVER (PARTITION BY map_id) mx FROM frames)")
def _(v):
    return R.min_max(v.frames, "rms", "energy").select("map_id", "frame", "energy")


@query("peak_normalised", "SELECT map_id, frame, rms / (MAX(rms) OVER (PARTITION BY map_id) + 1e-8) rms, onset_strength / (MAX(onset_strength) OVER (PARTITION BY map_id) + 1e-8) onset_strength FROM frames")
def _(v):
    return R.peak_normalised(v.frames, "rms", "onset_strength").select("map_id", "frame", "rms", "onset_strength")


@query("frame_features", "SELECT vec_id, ROUND(list_avg([x::DOUBLE for x in embedding[1:16]]), 6) bass, ROUND(list_avg([x::DOUBLE for x in embedding[17:40]]), 6) mid, ROUND(list_avg([x::DOUBLE for x in embedding[41:64]]), 6) high, ROUND(GREATEST(0e0, LEAST(1e0, embedding[1]::DOUBLE * 100 / 80 + 1)), 6) share, vec_id / 22050e0 centroid, ROUND(LN(GREATEST(embedding[1]::DOUBLE, 1e-9)), 6) logv FROM embeddings WHERE len(embedding) >= 64")
def _(v):
    from levelloom.functions.scalars import log_floor

    e = v.embeddings.where("size(embedding) >= 64").withColumn("mel", F.transform("embedding", lambda x: x.cast("double")))
    e = e.withColumn("db", F.get("mel", F.lit(0)) * 100)
    b = e.select("vec_id", "db", "mel", *R.band_means("mel", 64))
    return b.select("vec_id", *[F.round(c, 6).alias(c) for c in ("bass", "mid", "high")], F.round(R.decibel_share("db"), 6).alias("share"), R.normalised_centroid("vec_id").alias("centroid"), F.round(log_floor(F.get("mel", F.lit(0))), 6).alias("logv"))


W = {
    "w_starts": """SELECT map_id, n, s FROM (SELECT map_id, n, unnest(list_distinct(list_append(range(0, GREATEST(n - 32, 0) + 1, 16), GREATEST(n - 32, 0)))) s FROM a_n)""",
    "w_avg": "SELECT f.map_id, f.frame, ROUND(AVG(prob + s % 7 / 100e0) + 1e-12, 9) prob FROM w_starts w JOIN frames f ON f.map_id = w.map_id AND f.frame >= s AND f.frame < s + 32 GROUP BY ALL",
    **A,
}


def window_probs(v):
    """Stand-in model output: every window sees the frame probability plus an offset of its own."""
    w = counts(v).select("map_id", F.explode(R.window_starts(F.col("n_frames"), 32, 16)).alias("start"))
    w = w.select("map_id", "start", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("offset")).withColumn("frame", F.col("start") + F.col("offset"))
    j = w.join(v.frames.select("map_id", "frame", "prob"), ["map_id", "frame"])
    return j.select("map_id", "start", "offset", (F.col("prob") + F.col("start") % 7 / 100.0).alias("prob"))


@query("overlap_average", "SELECT * FROM w_avg", W)
def _(v):
    return R.overlap_average(window_probs(v))


_SNAP = "CASE WHEN g < 1 THEN frame ELSE CAST(round_even(CASE WHEN frame - FLOOR(frame / g) * g <= (FLOOR(frame / g) + 1) * g - frame THEN FLOOR(frame / g) * g ELSE (FLOOR(frame / g) + 1) * g END, 0) AS INTEGER) END"


@query("snap_to_grid", f"SELECT DISTINCT map_id, CAST({_SNAP} AS INTEGER) frame FROM (SELECT map_id, frame * 40 frame, 60e0 / bpm * 44100e0 / 512e0 / 8 g FROM frames JOIN maps USING (map_id))")
def _(v):
    return R.snap_to_grid(v.frames.select("map_id", (F.col("frame") * 40).alias("frame")), v.maps)


O = {
    **W,
    "o_thr": "SELECT w.map_id, w.frame, CASE WHEN w.prob > t.threshold THEN w.prob ELSE 0e0 END prob, w.prob raw FROM w_avg w JOIN a_thr t USING (map_id, frame)",
    "a_peak": "SELECT map_id, frame, prob FROM (SELECT *, LAG(prob, 1, -1e0) OVER w l, LEAD(prob, 1, -1e0) OVER w r FROM o_thr WINDOW w AS (PARTITION BY map_id ORDER BY frame)) WHERE prob >= 1e-2 AND prob >= l AND prob >= r",
    "o_refl": """SELECT map_id, i, rms, n FROM (SELECT map_id, frame i, rms, n FROM frames JOIN a_n USING (map_id) UNION ALL SELECT map_id, -1 - frame, rms, n FROM frames JOIN a_n USING (map_id) WHERE frame < LEAST(200, n) // 2
 UNION ALL SELECT map_id, 2 * n - 1 - frame, rms, n FROM frames JOIN a_n USING (map_id) WHERE frame >= n - LEAST(200, n) // 2)""",
    "o_sm": "SELECT f.map_id, f.frame, ROUND(AVG(g.rms) + 1e-12, 9) s FROM frames f JOIN o_refl g ON g.map_id = f.map_id AND g.i BETWEEN f.frame - LEAST(200, g.n) // 2 AND f.frame - LEAST(200, g.n) // 2 + LEAST(200, g.n) - 1 GROUP BY ALL",
    "o_q": "SELECT map_id, CAST(FLOOR((4 + ROUND(CASE WHEN MAX(s) > MIN(s) THEN (AVG(s) - MIN(s)) / (MAX(s) - MIN(s)) ELSE 5e-1 END, 9) * 6) * (COUNT(*) / (44100e0 / 512e0))) AS BIGINT) quota FROM o_sm GROUP BY map_id",
    "o_snap": f"SELECT DISTINCT map_id, CAST({_SNAP} AS INTEGER) frame FROM (SELECT map_id, frame, 60e0 / bpm * 44100e0 / 512e0 / 8 g FROM a_kept JOIN maps USING (map_id))",
    "o_fin": "SELECT map_id, frame FROM (SELECT s.map_id, s.frame, ROW_NUMBER() OVER (PARTITION BY s.map_id ORDER BY -COALESCE(w.prob, 5e-1), s.frame) pos FROM o_snap s LEFT JOIN w_avg w USING (map_id, frame)) JOIN o_q USING (map_id) WHERE pos <= quota",
}


@query("predict_onsets", "SELECT DISTINCT map_id, CAST(GREATEST(0, LEAST(frame, n - 1)) AS INTEGER) frame FROM o_fin JOIN a_n USING (map_id)", O)
def _(v):
    # at the frame rate of the audio: at two frames a second the grid would be finer than a frame, and nothing would snap
    return R.predict_onsets(window_probs(v), v.frames, v.maps, "Expert")


@query("density_curve", "SELECT map_id, frame FROM (SELECT map_id, frame, ROW_NUMBER() OVER (PARTITION BY map_id ORDER BY -prob, frame) pos FROM frames WHERE prob > 2e-1) JOIN (SELECT map_id, CAST(FLOOR((1 + ROUND(e, 9) * 2) * (n / 4e0)) AS BIGINT) quota FROM (SELECT map_id, CASE WHEN MAX(s) > MIN(s) THEN (AVG(s) - MIN(s)) / (MAX(s) - MIN(s)) ELSE 5e-1 END e, COUNT(*) n FROM o_sm GROUP BY map_id)) USING (map_id) WHERE pos <= quota", O)
def _(v):
    return R.density_curve(v.frames.where("prob > 0.2").select("map_id", "frame"), v.frames, "Easy", hop=HOP // 2)


@query("top_p", """WITH p AS (SELECT vec_id, i token, ABS(embedding[i])::DOUBLE / 1e0 w FROM embeddings, range(1, 65) t(i)), q AS (SELECT vec_id, token, ROUND(w / SUM(w) OVER (PARTITION BY vec_id), 9) prob FROM p),
 c AS (SELECT *, SUM(prob) OVER (PARTITION BY vec_id ORDER BY -prob, token ROWS UNBOUNDED PRECEDING) cum FROM q)
 SELECT vec_id, CAST(token AS INTEGER) token, ROUND(prob / SUM(prob) OVER (PARTITION BY vec_id), 7) prob FROM c WHERE NOT (cum - prob > 7e-1)""")
def _(v):
    p = v.embeddings.select("vec_id", F.posexplode("embedding").alias("i", "w")).select("vec_id", (F.col("i") + 1).alias("token"), F.abs(F.col("w").cast("double")).alias("w"))
    t = p.groupBy("vec_id").agg(F.sum("w").alias("t"))
    q = p.join(t, "vec_id").select("vec_id", "token", F.round(F.col("w") / F.col("t"), 9).alias("prob"))
    return R.top_p(q, ["vec_id"], 0.7).select("vec_id", F.col("token").cast("int").alias("token"), F.round("prob", 7).alias("prob"))


@query("onset_labels", """SELECT map_id, difficulty, CAST(f AS INTEGER) frame, ROUND(MAX(EXP(-5e-1 * ((f - o) / 3e0) * ((f - o) / 3e0))), 9) label FROM (SELECT map_id, difficulty, o, unnest(range(GREATEST(0, o - 12), LEAST(n_frames - 1, o + 12) + 1)) f FROM
 (SELECT DISTINCT map_id, difficulty, CAST(round_even(beat * 60e0 / bpm * 44100e0 / 512e0, 0) AS BIGINT) o, n_frames FROM notes JOIN maps USING (map_id)) WHERE o >= 0 AND o < n_frames) GROUP BY ALL""")
def _(v):
    o = timing.beat_frames(v.notes.select("map_id", "difficulty", "beat"), v.maps)
    return R.onset_labels(o, v.maps).select("map_id", "difficulty", F.col("frame").cast("int").alias("frame"), F.round("label", 9).alias("label"))


# ---- song sections ---------------------------------------------------------
def clustered(v):
    """Cluster labels that change every few frames, by loudness stretch."""
    return v.frames.withColumn("cluster", (F.floor(F.col("frame") / 9) * 5 % 4).cast("int"))


C = {
    "c_l": "SELECT map_id, frame, rms, CAST(frame // 9 * 5 % 4 AS INTEGER) cluster FROM frames",
    "c_r": "SELECT map_id, section, MIN(cluster) cluster, MIN(frame) a, MAX(frame) + 1 b FROM (SELECT *, SUM(c) OVER (PARTITION BY map_id ORDER BY frame) section FROM (SELECT *, CASE WHEN LAG(cluster) OVER (PARTITION BY map_id ORDER BY frame) = cluster THEN 0 ELSE 1 END c FROM c_l)) GROUP BY ALL",
    "c_k": "SELECT *, ROW_NUMBER() OVER (PARTITION BY map_id ORDER BY energy DESC, cluster) - 1 r, COUNT(*) OVER (PARTITION BY map_id) k FROM (SELECT map_id, cluster, ROUND(AVG(rms), 9) energy FROM c_l GROUP BY ALL)",
    "c_t": """SELECT map_id, section, CASE WHEN section = 1 AND r >= k // 2 THEN 'intro' WHEN section = last AND r >= k // 2 THEN 'outro' WHEN r = 0 THEN CASE WHEN m > 3e-1 THEN 'drop' ELSE 'chorus' END WHEN r <= k // 3 THEN 'chorus'
 WHEN r >= k * 2 // 3 THEN CASE WHEN m > 4e-1 AND m < 8e-1 THEN 'bridge' ELSE 'verse' END ELSE 'verse' END section_type, s start_sec, e end_sec FROM
 (SELECT *, (s + e) / 2 / dur m FROM (SELECT map_id, section, r, k, last, dur, a * 5e-1 s, CASE WHEN section = last THEN dur ELSE b * 5e-1 END e FROM c_r JOIN c_k USING (map_id, cluster) JOIN (SELECT map_id, MAX(section) last, MAX(b) * 5e-1 + 2e-1 dur FROM c_r GROUP BY 1) USING (map_id)))""",
}


@query("label_ranges", 'SELECT map_id, CAST(section AS BIGINT) section, cluster, a "start", b "end" FROM c_r', C)
def _(v):
    return R.label_ranges(clustered(v), "cluster")


@query("cluster_energy_rank", 'SELECT map_id, cluster, energy, CAST(r AS INTEGER) "rank", k n_clusters FROM c_k', C)
def _(v):
    return R.cluster_energy_rank(clustered(v))


def _sections(v):
    dur = counts(v).select("map_id", (F.col("n_frames") * 0.5 + 0.2).alias("duration"))
    return R.typed_sections(clustered(v), dur, 0.5)


@query("typed_sections", "SELECT map_id, CAST(section AS BIGINT) section, section_type, start_sec, end_sec FROM c_t", C)
def _(v):
    return _sections(v)


@query("section_features", """WITH i AS (SELECT map_id, section, section_type, CAST(LEAST(n, FLOOR(start_sec * 2)) AS INTEGER) a, CAST(LEAST(n, FLOOR(end_sec * 2)) AS INTEGER) b FROM c_t JOIN (SELECT map_id, COUNT(*) n FROM frames GROUP BY 1) USING (map_id)),
 f AS (SELECT *, unnest(range(a, b)) frame FROM i WHERE b > a)
 SELECT map_id, CAST(frame AS INTEGER) frame, CASE section_type WHEN 'intro' THEN 0 WHEN 'verse' THEN 1 WHEN 'chorus' THEN 2 WHEN 'bridge' THEN 3 WHEN 'drop' THEN 4 ELSE 5 END section_id, CASE WHEN b - a > 1 THEN (frame - a) / CAST(b - a - 1 AS DOUBLE) ELSE 0e0 END section_progress FROM f""", C)
def _(v):
    return R.section_features(_sections(v), counts(v), hop=HOP)


# ---- samples ---------------------------------------------------------------
G = {
    **E_CTES, **L_CTES, **T_CTES,
    "g_fr": "SELECT map_id, difficulty, beat, frame, n_frames FROM (SELECT DISTINCT map_id, difficulty, beat FROM t_ev) JOIN (SELECT map_id, bpm, n_frames FROM maps) USING (map_id), LATERAL (SELECT CAST(round_even(beat * 60e0 / bpm * 44100e0 / 512e0, 0) AS BIGINT) frame) WHERE frame < n_frames",
    "g_on": "SELECT map_id, difficulty, beat, frame, n_frames, tokens FROM g_fr JOIN t_enc USING (map_id, difficulty, beat)",
}


def onsets(v):
    return S.level_onsets(v.full_events, v.maps)


@query("time_gaps", "SELECT map_id, difficulty, beat, frame, COALESCE((frame - LAG(frame) OVER (PARTITION BY map_id, difficulty ORDER BY frame, beat)) / 86e0, 999e0) time_gap FROM g_on", G)
def _(v):
    return S.time_gaps(onsets(v)).select("map_id", "difficulty", "beat", "frame", "time_gap")


# length and sum of the frame values inside a context, in whole millionths: sums of doubles depend on their order
_CTX = """(SELECT '128 ' || CAST(COALESCE(SUM(CAST(ROUND(rms * 1e6) AS BIGINT)), 0) AS VARCHAR) FROM frames c WHERE c.map_id = {f[0]}.map_id AND c.frame >= CASE WHEN GREATEST(0, {f} - 64) + 128 > n_frames THEN GREATEST(0, n_frames - 128) ELSE GREATEST(0, {f} - 64) END
 AND c.frame < CASE WHEN GREATEST(0, {f} - 64) + 128 > n_frames THEN n_frames ELSE GREATEST(0, {f} - 64) + 128 END)""".replace("{f[0]}", "g_on")


def millionths(values) -> Column:
    """Sum of an array of doubles in whole millionths, halves away from zero; null where one is null."""
    @F.arrow_udf("long")
    def run(values: pa.Array) -> pa.Array:
        flat = values.flatten()
        v = flat.fill_null(0.0).to_numpy(zero_copy_only=False) * 1e6
        whole = np.trunc(v)
        whole += np.sign(v) * (np.abs(v - whole) >= 0.5)
        border = np.concatenate([[0], np.cumsum(values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        total, nulls = (np.concatenate([[0], np.cumsum(n)]) for n in (whole.astype(np.int64), flat.is_null().to_numpy(zero_copy_only=False)))
        none = (np.diff(nulls[border]) > 0) | values.is_null().to_numpy(zero_copy_only=False)
        return pa.array(np.diff(total[border]), pa.int64(), mask=none)

    return run(values)


def _context_text():
    return F.concat(F.size("context_rms"), F.lit(" "), millionths("context_rms"))


@query("sequence_samples", """SELECT map_id, difficulty, beat, CASE WHEN GREATEST(0, frame - 64) + 128 > n_frames THEN GREATEST(0, n_frames - 128) ELSE GREATEST(0, frame - 64) END ctx_start,
 array_to_string(list_resize(string_split(tokens, ',')[1:24], 24, '0'), ',') tokens, CAST(LEAST(24, len(string_split(tokens, ','))) AS INTEGER) token_length,
 COALESCE(LAG(array_to_string(list_resize(string_split(tokens, ',')[1:24], 24, '0'), ',')) OVER w, array_to_string(list_resize([]::VARCHAR[], 24, '0'), ',')) newest,
 COALESCE(LAG(array_to_string(list_resize(string_split(tokens, ',')[1:24], 24, '0'), ','), 3) OVER w, array_to_string(list_resize([]::VARCHAR[], 24, '0'), ',')) oldest FROM g_on WINDOW w AS (PARTITION BY map_id, difficulty ORDER BY frame, beat)""".replace("FROM g_on WINDOW", f""", COALESCE(LAG(array_to_string(list_resize(string_split(tokens, ',')[1:24], 24, '0'), ','), 2) OVER w, array_to_string(list_resize([]::VARCHAR[], 24, '0'), ',')) middle,
 {_CTX.format(f="g_on.frame")} context FROM g_on WINDOW"""), G)
def _(v):
    s = S.sequence_samples(onsets(v), v.maps, max_len=24, prev_k=3)
    s = S.with_context(s, v.frames).withColumn("middle", text(F.get("prev_tokens", F.lit(1)))).withColumn("context", _context_text())
    return s.select("middle", "context", "map_id", "difficulty", "beat", "ctx_start", text("tokens").alias("tokens"), "token_length", text(F.get("prev_tokens", F.lit(2))).alias("newest"), text(F.get("prev_tokens", F.lit(0))).alias("oldest"))


def lit(v):
    return S.level_lights(v.lights.withColumn("difficulty", F.lit("Expert")), v.maps)


@query("lighting_samples", """WITH l AS (SELECT map_id, beat, CAST(round_even(beat * 60e0 / bpm * 44100e0 / 512e0, 0) AS BIGINT) frame, n_frames, tokens FROM (SELECT map_id, beat, string_agg(toks, ',2,' ORDER BY seq) || ',1' tokens FROM l_ev GROUP BY ALL) JOIN maps USING (map_id)),
 o AS (SELECT map_id, frame, ARG_MIN(tokens, beat) tokens FROM g_on WHERE difficulty = 'Expert' GROUP BY ALL),
 b AS (SELECT l.map_id, l.beat, l.frame, l.tokens lt, n_frames, p.frame pf, p.tokens pt FROM l ASOF LEFT JOIN o p ON l.map_id = p.map_id AND l.frame >= p.frame WHERE l.frame < n_frames),
 c AS (SELECT b.*, q.frame qf, q.tokens qt FROM b ASOF LEFT JOIN o q ON b.map_id = q.map_id AND b.frame <= q.frame)
 SELECT map_id, beat, frame, CASE WHEN pf IS NULL OR (qf - frame) < (frame - pf) THEN COALESCE(qf, pf) ELSE pf END onset_frame,
 array_to_string(list_resize(string_split(CASE WHEN pf IS NULL OR (qf - frame) < (frame - pf) THEN COALESCE(qt, pt) ELSE pt END, ',')[1:20], 20, '0'), ',') note_tokens,
 array_to_string(list_resize(string_split(lt, ',')[1:12], 12, '0'), ',') light_tokens, """ + _CTX.replace("g_on.", "c0.").format(f="c0.frame").replace("frames c WHERE c.", "frames k WHERE k.").replace(" c.frame", " k.frame") + " context FROM c c0", G)
def _(v):
    s = S.lighting_samples(lit(v), onsets(v), v.maps, max_light=12, max_note=20)
    s = S.with_context(s, v.frames).withColumn("context", _context_text())
    return s.select("context", "map_id", "beat", "frame", "onset_frame", text("note_tokens").alias("note_tokens"), text("light_tokens").alias("light_tokens"))


@query("nearest_onset", """WITH n AS (SELECT DISTINCT map_id, beat FROM notes WHERE difficulty = 'Expert'), b AS (SELECT l.map_id, l.seq, l.beat, p.beat pb FROM lights l ASOF LEFT JOIN n p ON l.map_id = p.map_id AND l.beat >= p.beat),
 c AS (SELECT b.*, q.beat qb FROM b ASOF LEFT JOIN n q ON b.map_id = q.map_id AND b.beat <= q.beat) SELECT map_id, seq, CASE WHEN pb IS NULL OR (qb - beat) < (beat - pb) THEN COALESCE(qb, pb) ELSE pb END note_beat FROM c""")
def _(v):
    n = v.notes.where("difficulty = 'Expert'").select("map_id", "beat", "seq")
    j = asof(v.lights.select("map_id", "seq", "beat"), n, ["map_id"], "beat", [], slice="floor(beat / 16)", direction="nearest", tie="seq")
    return j.select("map_id", "seq", F.col("match_beat").alias("note_beat"))


def _levels(v):
    return counts(v).select("map_id", F.lit("Expert").alias("difficulty"))


_TW = "SELECT map_id, n, range(0, n - 32 + 1, 16) body, (CAST(FLOOR((n - 32) / 16e0) AS INTEGER) + 1) * 16 nxt FROM a_n"


@query("training_windows", f"SELECT map_id, CAST(i - 1 AS INTEGER) window_no, CAST(s[i] AS INTEGER) \"start\" FROM (SELECT map_id, s, unnest(range(1, len(s) + 1)) i FROM (SELECT map_id, CASE WHEN n > 32 AND nxt < n THEN list_append(body, n - 32) ELSE body END s FROM ({_TW})))", A)
def _(v):
    return counts(v).select("map_id", F.posexplode(S.training_windows(F.col("n_frames"), 32, 16)).alias("window_no", "start"))


@query("onset_windows", f"""WITH w AS (SELECT map_id, unnest(s) s0 FROM (SELECT map_id, CASE WHEN n > 32 AND nxt < n THEN list_append(body, n - 32) ELSE body END s FROM ({_TW}))), o AS (SELECT map_id, frame FROM frames WHERE prob > 6e-1)
 SELECT w.map_id, CAST(s0 AS INTEGER) "start", 3 difficulty_id, len(x) n_onsets, COALESCE(array_to_string(x, ','), '') onsets, r n_values, ROUND(sm, 9) sum_rms FROM (SELECT map_id, s0, COUNT(*) c FROM w GROUP BY ALL) w1 JOIN w USING (map_id, s0),
 LATERAL (SELECT COALESCE(list(frame - s0 ORDER BY frame), []) x FROM o WHERE o.map_id = w.map_id AND frame >= s0 AND frame < s0 + 32), LATERAL (SELECT COUNT(*) r, SUM(rms) sm FROM frames f WHERE f.map_id = w.map_id AND frame >= s0 AND frame < s0 + 32)""".replace("len(x) n_onsets", "CAST(LEAST(len(x), 6) AS INTEGER) n_onsets").replace("array_to_string(x, ',')", "array_to_string(x[1:6], ',')").replace(" r n_values", " CAST(r AS INTEGER) n_values"), A)
def _(v):
    o = v.frames.where("prob > 0.6").select("map_id", F.lit("Expert").alias("difficulty"), "frame")
    s = _levels(v).select("map_id", "difficulty")
    n = counts(v)
    full = S.onset_windows(s, o, v.frames, n, 32, 16)
    # the cap is six here so that it bites
    capped = S.window_onsets(o, n, 32, 16, 6).withColumnRenamed("onsets", "few")
    j = full.join(capped, ["map_id", "difficulty", "start"], "left")
    few = F.coalesce("few", F.array().cast("array<int>"))
    total = F.round(F.aggregate("rms", F.lit(0.0), lambda a, x: a + x), 9)
    return j.select("map_id", "start", "difficulty_id", F.size(few).alias("n_onsets"), text(few).alias("onsets"), F.size("rms").alias("n_values"), total.alias("sum_rms"))


@query("song_samples", "SELECT map_id, difficulty, CAST((pos - 1) // 64 AS BIGINT) part, CAST(COUNT(*) AS INTEGER) n, CAST(SUM(frame) AS BIGINT) frames FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY map_id, difficulty ORDER BY frame, beat) pos FROM g_on) GROUP BY ALL", G)
def _(v):
    s = S.song_samples(onsets(v), 64)
    return s.select("map_id", "difficulty", "part", F.size("token_sequences").alias("n"), F.aggregate("frames", F.lit(0).cast("long"), lambda a, x: a + x).alias("frames"))


@query("epoch_sample", "SELECT map_id, seq FROM notes ORDER BY CAST('0x' || md5(map_id || '/' || seq || '/3')[1:15] AS BIGINT), map_id, seq LIMIT 20000")
def _(v):
    return S.epoch_sample(v.notes.select("map_id", "seq"), ["map_id", "seq"], 20000, 3)


_PREPROCESSED = """SELECT 'onsets' t, COUNT(*) n, CAST(SUM(frame) AS BIGINT) frames, CAST(SUM(len(string_split(tokens, ','))) AS BIGINT) content FROM g_on
 UNION ALL SELECT 'labels', COUNT(*), CAST(SUM(f) AS BIGINT), CAST(ROUND(SUM(l) * 1000) AS BIGINT) FROM (SELECT map_id, difficulty, f, MAX(EXP(-5e-1 * ((f - o) / 3e0) * ((f - o) / 3e0))) l FROM (SELECT map_id, difficulty, frame o, unnest(range(GREATEST(0, frame - 12), LEAST(n_frames - 1, frame + 12) + 1)) f FROM g_on) GROUP BY ALL)
 UNION ALL SELECT 'lights', COUNT(*), CAST(SUM(f) AS BIGINT), CAST(SUM(k) AS BIGINT) FROM (SELECT round_even(beat * 60e0 / bpm * 44100e0 / 512e0, 0) f, n_frames, k FROM (SELECT map_id, beat, COUNT(*) + COUNT(*) FILTER (seq % 9 = 0) k FROM lights GROUP BY ALL) JOIN maps USING (map_id)  WHERE map_id IN (SELECT map_id FROM g_on WHERE difficulty = 'Expert')) WHERE f < n_frames"""


@query("preprocess_tables", _PREPROCESSED, G)
def _(v):
    from levelloom.checks.documents import lights_as_events

    return _contents(S.preprocess(lights_as_events(v), v.maps))


def _contents(t):
    # what each table holds beside its rows: tokens, label mass, events (a light has one separator or end behind it)
    content = {"onsets": F.sum(F.size("tokens")), "labels": F.round(F.sum(F.col("label") * F.col("n")) * 1000), "lights": F.sum(F.size(F.filter("tokens", lambda t: t.isin(1, 2))))}
    out = None
    for name, df in t.items():
        n = F.count("*")
        if name == "labels":  # a label has one value per distance, so rows are counted by it: long sums of doubles drift
            df, n = df.groupBy("label").agg(n.alias("n"), F.sum("frame").alias("frame")), F.coalesce(F.sum("n"), F.lit(0))
        d = df.agg(F.lit(name).alias("t"), n.alias("n"), F.sum("frame").cast("long").alias("frames"), content[name].cast("long").alias("content"))
        out = d if out is None else out.unionByName(d)
    return out


def _archives(v, folder):
    """Zip files of all maps: info, Standard levels, one level listed as another characteristic; some broken, some without info."""
    import io
    import zipfile

    from pyarrow import fs

    from levelloom.checks.documents import lights_as_events
    from levelloom.sources import writers as Wr

    m = v.maps.select("map_id", "bpm", F.lit("s").alias("song_name"), F.lit("a").alias("song_author"))
    other = F.concat(F.lit('{"_beatmapCharacteristicName":"Lawless","_difficultyBeatmaps":[{"_difficulty":"Normal","_beatmapFilename":"ExpertStandard.dat"}]},'))
    info = Wr.info_documents(m, v.objects).select("map_id", F.lit("song/INFO.dat").alias("name"), F.regexp_replace("text", r'"_difficultyBeatmapSets":\[', F.concat(F.lit('"_difficultyBeatmapSets":['), other)).alias("text"))
    levels = Wr.level_documents(lights_as_events(v)).join(info.select("map_id"), "map_id", "left_semi")
    files = info.where("map_id % 17 <> 0").unionByName(levels.select("map_id", F.concat("difficulty", F.lit("standard.dat")).alias("name"), "text"))
    base = "/" + folder.removeprefix("file:").lstrip("/")

    def pack(pdf):
        buf, map_id = io.BytesIO(), int(pdf["map_id"].iloc[0])
        with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
            for name, text in zip(pdf["name"], pdf["text"]):
                z.writestr(name, text)
        with fs.LocalFileSystem().open_output_stream(f"{base}/{map_id % 2}/{map_id}.zip") as f:
            f.write(buf.getvalue() if map_id % 13 else b"broken")
        return pdf[["map_id"]].head(1)

    for half in ("0", "1"):
        fs.LocalFileSystem().create_dir(f"{base}/{half}")
    return files.groupBy("map_id").applyInPandas(pack, "map_id bigint").count()


_GOOD = "map_id % 13 <> 0 AND map_id % 17 <> 0"


@query("preprocess_archives", _PREPROCESSED.replace("g_on", f"(SELECT * FROM g_on WHERE {_GOOD})") + f""" UNION ALL SELECT 'log ' || CASE WHEN NOT ({_GOOD}) THEN 'no_info' WHEN map_id IN (SELECT map_id FROM g_on) THEN 'done' ELSE 'empty' END, COUNT(*), 0, 0
 FROM (SELECT DISTINCT map_id FROM objects) JOIN maps USING (map_id) GROUP BY 1""", G)
def _(v):
    from levelloom.operators import preprocessing as P
    from levelloom.session import scratch
    from levelloom.sources.archive_source import register

    base = scratch(v.spark, "archives")
    _archives(v, f"{base}/in")
    register(v.spark)
    for part in ("in/0", "in"):  # new archives come in between; those of the first run are skipped
        P.preprocess_archives(v.spark.read.format("level_archives").option("partitionBytes", 8 << 20).load(f"{base}/{part}"), v.maps, f"{base}/out")
    t = _contents({name: P.preprocessed(v.spark, f"{base}/out", name) for name in ("onsets", "lights", "labels")})
    log = P.map_log(v.spark, f"{base}/out").groupBy(F.concat(F.lit("log "), "status").alias("t")).agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("frames"), F.lit(0).cast("long").alias("content"))
    return t.unionByName(log)

