"""Section, light-show and colour queries."""

from pyspark.sql import functions as F

from levelloom.checks.registry import query
from levelloom.operators import lighting as L

# sections use a slow beat and short edges so that every label occurs in the views
FPS = 2.0


def _maps(v):
    return v.maps.withColumn("bpm", F.lit(60.0))


def _frames(v):
    """A loudness wave with rises and falls, per map shifted, 100-odd frames long."""
    wave = F.abs((F.col("frame") * 7 + F.col("map_id") * 3) % 60 - 30) / 30.0
    return v.frames.select("map_id", "frame", (wave * 0.9 + F.col("rms") * 0.1).alias("rms"), (F.col("frame") % 29 / 29.0).alias("bass"), "onset_strength")


C = {
    "n_f": "SELECT map_id, frame, ABS((frame * 7 + map_id * 3) % 60 - 30) / 30e0 * 9e-1 + rms * 1e-1 rms, frame % 29 / 29e0 bass, COUNT(*) OVER (PARTITION BY map_id) n FROM frames",
    "n_s": "SELECT f.map_id, f.frame, f.n, ROUND(SUM(g.rms) / 8 + 1e-12, 9) r, ROUND(SUM(g.bass) / 8 + 1e-12, 9) b FROM n_f f JOIN n_f g ON g.map_id = f.map_id AND g.frame BETWEEN f.frame - 4 AND f.frame + 3 GROUP BY ALL",
    "n_n": "SELECT map_id, frame, n, (r - MIN(r) OVER w) / (MAX(r) OVER w - MIN(r) OVER w) r, (b - MIN(b) OVER w) / (MAX(b) OVER w - MIN(b) OVER w) b FROM n_s WINDOW w AS (PARTITION BY map_id)",
    "n_b": "SELECT q.map_id, bt, n2 n, fr raw, r, b FROM (SELECT map_id, n n2, unnest(range(0, CAST(FLOOR(n / 2e0) AS INTEGER) + 1)) bt, bt * 2 fr FROM (SELECT map_id, COUNT(*) n FROM frames GROUP BY 1)) q JOIN n_n ON n_n.map_id = q.map_id AND n_n.frame = LEAST(fr, n2 - 1)",
    # the walking form of the labels: the type of the beat before decides the breakdown
    "n_w": """SELECT map_id, bt, 'intro' t FROM n_b WHERE bt = 0 UNION ALL SELECT e.map_id, e.bt, CASE WHEN e.raw < 30 THEN 'intro' WHEN e.raw > e.n - 30 THEN 'outro' WHEN e.r > 65e-2 AND e.b > 5e-1 THEN 'drop'
 WHEN e.r > 4e-1 AND e.r < 7e-1 AND e.bt >= 4 THEN CASE WHEN e.r > p.r + 1e-1 THEN 'buildup' ELSE 'calm' END WHEN e.r < 4e-1 AND w.t = 'drop' THEN 'breakdown' ELSE 'calm' END
 FROM n_w w JOIN n_b e ON e.map_id = w.map_id AND e.bt = w.bt + 1 LEFT JOIN n_b p ON p.map_id = e.map_id AND p.bt = e.bt - 4""",
    "n_i": "SELECT map_id, MIN(bt) a, MAX(bt) + 1 z, MIN(t) t FROM (SELECT *, SUM(c) OVER (PARTITION BY map_id ORDER BY bt) g FROM (SELECT *, CASE WHEN LAG(t) OVER (PARTITION BY map_id ORDER BY bt) = t THEN 0 ELSE 1 END c FROM n_w)) GROUP BY map_id, g",
    "n_m": "SELECT map_id, CAST(MIN(a) AS DOUBLE) start_beat, CAST(MAX(z) AS DOUBLE) end_beat, ARG_MIN(t, a) section_type FROM (SELECT *, SUM(CASE WHEN z - a >= 4 OR a = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY map_id ORDER BY a) g FROM n_i) GROUP BY map_id, g",
}


@query("beat_sections", "SELECT map_id, CAST(bt AS BIGINT) b, t section_type FROM n_w", C)
def _(v):
    return L.beat_sections(L.beat_energy(_frames(v), _maps(v), FPS), FPS).select("map_id", "b", "section_type")


@query("classify_sections", "SELECT * FROM n_m", C)
def _(v):
    return L.classify_sections(_frames(v), _maps(v), FPS)


# templates are checked on sections of all six kinds derived from the maps and their tempo
SEC = {
    "x_s": """SELECT map_id, CAST(k * 40 AS DOUBLE) a, CAST(k * 40 + 5 + (map_id * 7 + k * 11) % 35 AS DOUBLE) z, ['intro','calm','buildup','drop','breakdown','outro'][k + 1] t FROM maps, range(0, 6) r(k)""",
    # the step is walked beat by beat, as the build-up shortens it on the way
    "x_e": """SELECT map_id, a, z, t, a bt, 0 i FROM x_s UNION ALL SELECT map_id, a, z, t, bt + step, i + 1 FROM (SELECT *, CASE t WHEN 'intro' THEN 4e0 WHEN 'outro' THEN 4e0 WHEN 'drop' THEN 1e0 WHEN 'buildup' THEN GREATEST(25e-2, 1 / 75e-2 * (1 - (bt - a) / GREATEST(z - a, 1e0) * 5e-1)) ELSE 2e0 END step FROM x_e) WHERE bt + step < z""",
    "x_p": "SELECT *, (bt - a) / GREATEST(z - a, 1e0) p, CAST(i % 5 AS INTEGER) g, i % 2 = 0 ev FROM x_e",
    "x_l": """SELECT map_id, bt, g et, CASE t WHEN 'intro' THEN CASE WHEN ev THEN 3 ELSE 7 END WHEN 'calm' THEN CASE WHEN i % 4 < 2 THEN 5 ELSE 3 END WHEN 'buildup' THEN CASE WHEN ev THEN 2 ELSE 6 END WHEN 'breakdown' THEN CASE WHEN ev THEN 7 ELSE 3 END ELSE 7 END val,
  CASE t WHEN 'intro' THEN 5e-1 WHEN 'calm' THEN CASE WHEN i % 4 < 2 THEN 6e-1 ELSE 4e-1 END WHEN 'buildup' THEN LEAST(1e0, 5e-1 + p * 5e-1) WHEN 'breakdown' THEN GREATEST(2e-1, 1 - p * 8e-1) ELSE GREATEST(1e-1, 5e-1 * (1 - p)) END fv FROM x_p WHERE t <> 'drop'
 UNION ALL SELECT map_id, bt, 8, 1, 1e0 FROM x_p WHERE (t = 'buildup' AND i % 4 = 0) OR t = 'drop' UNION ALL SELECT map_id, bt, 9, 1, 1e0 FROM x_p WHERE t = 'drop' AND ev
 UNION ALL SELECT map_id, bt, CAST(j AS INTEGER), CASE WHEN ev THEN CASE WHEN j % 2 = 0 THEN 2 ELSE 6 END ELSE CASE WHEN j % 2 = 0 THEN 5 ELSE 1 END END, 1e0 FROM x_p, range(0, 5) q(j) WHERE t = 'drop'""",
}


@query("section_lights", """SELECT map_id, 'light' kind, ROUND(bt, 4) beat, et event_type, CAST(val AS INTEGER) "value", ROUND(fv, 7) float_value, CAST(NULL AS BOOLEAN) boost FROM x_l
 UNION ALL SELECT map_id, 'boost', a, NULL, NULL, NULL, t IN ('drop','buildup') FROM x_s""", SEC)
def _(v):
    s = v.maps.select("map_id", F.posexplode(F.array(*[F.lit(n) for n in ("intro", "calm", "buildup", "drop", "breakdown", "outro")])).alias("k", "section_type"))
    start = (F.col("k") * 40).cast("double")
    s = s.select("map_id", start.alias("start_beat"), (start + 5 + (F.col("map_id") * 7 + F.col("k") * 11) % 35).alias("end_beat"), "section_type")
    return L.section_lights(s).withColumn("float_value", F.round("float_value", 7))


@query("light_show", """SELECT map_id, 'light' kind, ROUND(bt, 4) beat, et event_type, CAST(val AS INTEGER) "value", ROUND(fv, 6) float_value, CAST(NULL AS BOOLEAN) boost FROM x_l
 UNION ALL SELECT map_id, 'boost', a, NULL, NULL, NULL, t IN ('drop','buildup') FROM x_s""", {**C, **SEC, "x_s": "SELECT map_id, start_beat a, end_beat z, section_type t FROM n_m"})
def _(v):
    return L.light_show(_frames(v), _maps(v), FPS).withColumn("float_value", F.round("float_value", 6))


GENRES = ["unknown", "EDM", "drumstep", "classical", "Metal", "lofi beats", "pop", "jazz"]
P = {
    "pal": f"""SELECT map_id, CASE WHEN regexp_matches(g, 'electronic|edm|dubstep|drum') THEN 'edm' WHEN regexp_matches(g, 'ambient|classical|soundtrack') THEN 'ambient' WHEN regexp_matches(g, 'rock|metal|punk') THEN 'rock' WHEN regexp_matches(g, 'chill|lofi|jazz') THEN 'chill'
 WHEN r IS NULL THEN 'synthwave' WHEN r > 5e-1 AND b > 5e-1 THEN 'edm' WHEN r < 2e-1 THEN 'ambient' WHEN b > 4e-1 THEN 'rock' WHEN r < 35e-2 THEN 'chill' ELSE 'synthwave' END palette
 FROM (SELECT map_id, lower({GENRES}[map_id % 8 + 1]) g FROM maps) LEFT JOIN (SELECT map_id, AVG(rms) * 5 r, AVG(bass) b FROM frames GROUP BY 1) USING (map_id)""",
    "stops": "SELECT * FROM (VALUES ('synthwave', [[15e-2,5e-2,35e-2],[4e-1,1e-1,6e-1],[2e-1,6e-1,8e-1],[9e-1,2e-1,6e-1],[1e0,4e-1,8e-1]]), ('edm', [[1e-1,5e-2,2e-1],[8e-1,2e-1,1e-1],[1e0,5e-1,1e-1],[1e0,9e-1,3e-1],[1e0,1e0,1e0]]), ('chill', [[5e-2,1e-1,25e-2],[1e-1,3e-1,5e-1],[15e-2,5e-1,45e-2],[3e-1,6e-1,8e-1],[6e-1,4e-1,7e-1]]), ('rock', [[2e-1,8e-2,2e-2],[6e-1,15e-2,5e-2],[8e-1,4e-1,1e-1],[1e0,7e-1,2e-1],[1e0,9e-1,5e-1]]), ('ambient', [[2e-2,5e-2,15e-2],[5e-2,15e-2,3e-1],[1e-1,25e-2,35e-2],[15e-2,4e-1,4e-1],[3e-1,5e-1,6e-1]])) t(palette, p)",
}


def _genres(v):
    return v.maps.select("map_id", F.get(F.array(*[F.lit(g) for g in GENRES]), (F.col("map_id") % 8).cast("int")).alias("genre"))


def _loud(v):
    return v.frames.withColumn("rms", F.col("rms") * 5)


@query("palette_names", "SELECT * FROM pal", P)
def _(v):
    return L.palette_names(_loud(v), _genres(v))


@query("color_lights", """WITH l AS (SELECT l.map_id, l.seq, l.event_type, p.palette, LEAST(n - 1, CAST(round_even(beat * 60e0 / bpm * 2, 0) AS INTEGER)) fr FROM lights l JOIN maps USING (map_id) JOIN pal p USING (map_id) JOIN (SELECT map_id, COUNT(*) n FROM frames GROUP BY 1) USING (map_id)),
 e AS (SELECT l.*, GREATEST(0e0, LEAST(1e0, rms * 5)) * 4 a, onset_strength o, s.p, (event_type % 5) * 4e-2 - 8e-2 h FROM l JOIN frames f ON f.map_id = l.map_id AND f.frame = l.fr JOIN stops s ON s.palette = l.palette),
 c AS (SELECT *, p[CAST(FLOOR(a) AS INTEGER) + 1] c1, p[LEAST(CAST(FLOOR(a) AS INTEGER) + 1, 4) + 1] c2, a - FLOOR(a) t FROM e)
 SELECT map_id, seq, palette, ROUND(GREATEST(0e0, LEAST(1e0, c1[1] + (c2[1] - c1[1]) * t + h * 5e-1)), 4) r, ROUND(GREATEST(0e0, LEAST(1e0, c1[2] + (c2[2] - c1[2]) * t - h * 3e-1)), 4) g, ROUND(GREATEST(0e0, LEAST(1e0, c1[3] + (c2[3] - c1[3]) * t + h * 2e-1)), 4) b, ROUND(GREATEST(3e-1, LEAST(1e0, 5e-1 + o * 5e-1)), 4) a FROM c""", P)
def _(v):
    c = L.color_lights(v.lights, _loud(v), v.maps, L.palette_names(_loud(v), _genres(v)), fps=FPS)
    return c.select("map_id", "seq", "palette", *[F.get("rgba", F.lit(i)).alias(n) for i, n in enumerate("rgba")])
