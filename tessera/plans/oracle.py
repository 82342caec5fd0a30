"""The registered queries as DuckDB SQL over the same tables."""

from __future__ import annotations

from tessera.sources.fixtures import cte

ORACLES: dict[str, str] = {}

CUR = "cur AS (SELECT * FROM fx_tracks WHERE analysis_status = 'COMPLETE' AND analysis_version = 4 AND native_bpm IS NOT NULL AND energy_scalar IS NOT NULL AND analysis_confidence IS NOT NULL AND duration_seconds IS NOT NULL)"
ENE = """bounds AS (SELECT quantile_cont(energy_scalar, 0.05) AS lo, quantile_cont(energy_scalar, 0.95) AS hi FROM cur),
ene AS (SELECT track_id, native_bpm, round(CASE WHEN hi - lo <= 1e-12 THEN energy_scalar ELSE least(1e0, greatest(0e0, (energy_scalar - lo) / (hi - lo))) END, 9) AS energy, analysis_confidence, duration_seconds FROM cur, bounds)"""
REG = """gat AS (SELECT *, 0.5e0 * greatest(0e0, 1 - ibi_cv / 0.06e0) + 0.3e0 * mean_onset + 0.2e0 * in_tolerance_fraction AS score FROM fx_region_windows
  WHERE ibi_cv <= 0.06e0 AND in_tolerance_fraction >= 0.9e0 AND mean_onset >= 0.35e0),
lst AS (SELECT track_id, list({'k': -round(score, 9), 's': start_beat, 'e': end_beat, 'score': score, 'en': mean_energy} ORDER BY -round(score, 9), start_beat) AS a FROM gat GROUP BY track_id),
nms AS (SELECT track_id, unnest(list_reduce(list_transform(a, lambda x: [x]), lambda acc, x: CASE WHEN len(acc) < 8 AND len(list_filter(acc, lambda k: x[1].s < k.e AND k.s < x[1].e)) = 0 THEN list_concat(acc, x) ELSE acc END)) AS r FROM lst),
reg AS (SELECT n.track_id, r.s AS start_beat, r.e AS end_beat, r.score AS score, r.en AS mean_energy, r.s * 60 / native_bpm AS start_time, (r.e - 1) * 60 / native_bpm AS end_time
  FROM nms n JOIN fx_tracks t ON t.track_id = n.track_id WHERE native_bpm IS NOT NULL)"""


def pairs(source: str, name: str = "prs") -> str:
    """Ordered pairs of ``source`` within the stretch bound."""
    return f"""{name} AS (SELECT s.track_id AS seed_id, s.native_bpm AS session_bpm, s.energy AS seed_energy, c.*, s.native_bpm / c.native_bpm AS stretch_ratio
  FROM {source} s JOIN {source} c ON s.track_id <> c.track_id AND s.native_bpm / c.native_bpm BETWEEN 0.95e0 - 1e-12 AND 1.05e0 + 1e-12)"""


def gate(source: str, name: str = "ret") -> str:
    return f"""{name}_g AS (SELECT *, abs(energy - seed_energy) <= 0.25e0 AS gated FROM {source}),
{name}_a AS (SELECT *, max(CAST(gated AS INT)) OVER (PARTITION BY seed_id) AS any_gate FROM {name}_g),
{name} AS (SELECT *, any_gate = 0 AS relaxed FROM {name}_a WHERE gated OR any_gate = 0)"""


def ranking(source: str, name: str = "rnk", weights: tuple[str, str, str] = ("0.6e0", "0.35e0", "0.05e0")) -> str:
    return f"""{name}_c AS (SELECT *, least(1e0, abs(stretch_ratio - 1e0) / (1.05e0 - 1e0)) AS tempo_cost, abs(energy - seed_energy) AS energy_cost, 1e0 - analysis_confidence AS quality_cost FROM {source}),
{name}_t AS (SELECT *, {weights[0]} * tempo_cost + {weights[1]} * energy_cost + {weights[2]} * quality_cost AS total_cost FROM {name}_c),
{name} AS (SELECT *, CAST(row_number() OVER (PARTITION BY seed_id ORDER BY round(total_cost, 9), track_id) AS INT) AS rank FROM {name}_t)"""


def windows(library: str, regions: str) -> str:
    w = lambda name, lo, hi: f"""{name} AS (SELECT g.*, abs((start_time + end_time) / 2e0 / duration_seconds - {lo + hi}e0 / 2e0) / (({hi}e0 - {lo}e0) / 2e0) AS deviation
  FROM {regions} g JOIN {library} t ON t.track_id = g.track_id WHERE duration_seconds > 0 AND (start_time + end_time) / 2e0 / duration_seconds BETWEEN {lo}e0 AND {hi}e0)"""  # noqa: E731
    return w("ow", 0.65, 0.95) + ",\n" + w("iw", 0.0, 0.35)


RPS = """rps_c AS (SELECT p.*, o.start_beat AS out_start_beat, i.start_beat AS in_start_beat, greatest(0e0, least(1e0, 1e0 - (o.score + i.score) / 2e0)) AS stability_cost, abs(o.mean_energy - i.mean_energy) AS gap_cost,
  least(1e0, abs(p.stretch_ratio - 1e0) / (1.05e0 - 1e0)) AS stretch_cost, (o.deviation + i.deviation) / 2e0 AS position_cost FROM {source} p JOIN ow o ON o.track_id = p.seed_id JOIN iw i ON i.track_id = p.track_id),
rps_t AS (SELECT *, 0.4e0 * stability_cost + 0.3e0 * gap_cost + 0.2e0 * stretch_cost + 0.1e0 * position_cost AS pair_cost FROM rps_c),
rps AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY round(pair_cost, 9), out_start_beat, in_start_beat) AS rn FROM rps_t) WHERE rn = 1)"""


def selecting(library: str, regions: str, ranked: str = "rnk") -> str:
    return windows(library, regions) + f""",
abl AS (SELECT * FROM {ranked} WHERE seed_id IN (SELECT track_id FROM ow) AND track_id IN (SELECT track_id FROM iw)),
fst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY rank) AS rf FROM abl) WHERE rf = 1),
""" + RPS.format(source="fst", keys="seed_id")


PLAYED = "prp AS (SELECT * FROM prs WHERE track_id NOT IN (SELECT track_id FROM ene WHERE track_id % 10 = 3) AND track_id IN (SELECT track_id FROM reg))"
INREG = "pin AS (SELECT * FROM prs WHERE track_id IN (SELECT track_id FROM {reg}))"


def sql(*parts: str, views: tuple[str, ...], then: str) -> str:
    return ",\n".join([cte(*views), *parts]) + "\n" + then


SEED = 20260915
T, TR = ("tracks",), ("tracks", "region_windows")
O = ORACLES
O["candidates_current_version"] = sql(CUR, views=T, then="SELECT track_id, native_bpm, energy_scalar, analysis_confidence, duration_seconds FROM cur")
O["labelled_library"] = sql(CUR, ENE, views=T, then="SELECT e.track_id, t.title, t.artist, e.native_bpm, round(e.energy, 6) AS energy, e.duration_seconds FROM ene e JOIN fx_tracks t ON t.track_id = e.track_id")
O["analysis_queue_default"] = sql(views=T, then="SELECT track_id, analysis_status, analysis_version FROM fx_tracks WHERE analysis_status IN ('PENDING', 'PROCESSING') OR (analysis_status = 'COMPLETE' AND analysis_version IS DISTINCT FROM 4)")
O["analysis_queue_reanalyze"] = sql(views=T, then="SELECT track_id, analysis_status FROM fx_tracks")
O["status_counts"] = sql(views=T, then="SELECT analysis_status, count(*) AS n FROM fx_tracks GROUP BY analysis_status")
O["analysis_failure_rate"] = sql(views=T, then="SELECT failed, completed, round(CASE WHEN failed + completed > 0 THEN failed / (failed + completed) END, 6) AS failure_rate FROM (SELECT count(*) FILTER (analysis_status = 'FAILED') AS failed, count(*) FILTER (analysis_status = 'COMPLETE') AS completed FROM fx_tracks)")
O["energy_rescale_p5_p95"] = sql(CUR, ENE, views=T, then="SELECT track_id, round(energy, 6) AS energy FROM ene")
O["retrieve_hard"] = sql(CUR, ENE, pairs("ene"), views=T, then="SELECT seed_id, count(*) AS n, min(track_id) AS first_id, max(track_id) AS last_id, CAST(sum(track_id) AS BIGINT) AS ids FROM prs GROUP BY seed_id")
O["retrieve_relaxed"] = sql(CUR, ENE, pairs("ene"), gate("prs"), views=T, then="SELECT seed_id, count(*) AS n, bool_or(relaxed) AS relaxed, CAST(sum(track_id) AS BIGINT) AS ids FROM ret GROUP BY seed_id")
O["rank_topk"] = sql(CUR, ENE, REG, pairs("ene"), PLAYED, gate("prp"), ranking("ret"), views=TR, then="SELECT seed_id, rank, track_id, round(tempo_cost, 6) AS tempo_cost, round(energy_cost, 6) AS energy_cost, round(quality_cost, 6) AS quality_cost, round(total_cost, 6) AS total_cost, relaxed FROM rnk WHERE rank <= 5")
O["baseline_nearest_bpm"] = sql(CUR, ENE, pairs("ene"), views=T, then="SELECT * FROM (SELECT seed_id, CAST(row_number() OVER (PARTITION BY seed_id ORDER BY round(abs(native_bpm - session_bpm), 9), track_id) AS INT) AS rank, track_id FROM prs) WHERE rank <= 5")
_C = ("(0.6e0 / (0.6e0 + 0.35e0))", "(0.35e0 / (0.6e0 + 0.35e0))", "0e0")
O["baseline_bpm_energy"] = sql(CUR, ENE, pairs("ene"), ranking("prs", weights=_C), views=T, then="SELECT seed_id, rank, track_id, round(total_cost, 6) AS total_cost FROM rnk WHERE rank <= 5")
O["baseline_seeded_random"] = sql(CUR, ENE, pairs("ene"), views=T, then=f"SELECT * FROM (SELECT seed_id, CAST(row_number() OVER (PARTITION BY seed_id ORDER BY md5('{SEED}-' || track_id), track_id) AS INT) AS rank, track_id FROM prs) WHERE rank <= 5")
_SEL = "SELECT seed_id, track_id, rank, relaxed, out_start_beat, in_start_beat, round(stability_cost, 6) AS stability_cost, round(gap_cost, 6) AS gap_cost, round(stretch_cost, 6) AS stretch_cost, round(position_cost, 6) AS position_cost, round(pair_cost, 6) AS pair_cost FROM rps"
O["select_next_all"] = sql(CUR, ENE, REG, pairs("ene"), INREG.format(reg="reg"), gate("pin"), ranking("ret"), selecting("ene", "reg"), views=TR, then=_SEL)
_LATE = "late AS (SELECT * FROM reg WHERE NOT (track_id % 4 = 0 AND start_beat < 140))"
O["select_next_late_regions"] = sql(CUR, ENE, REG, _LATE, pairs("ene"), INREG.format(reg="late"), gate("pin"), ranking("ret"), selecting("ene", "late"), views=TR, then="SELECT seed_id, track_id, rank, out_start_beat, in_start_beat, round(pair_cost, 6) AS pair_cost FROM rps")
O["plan_region_pairs"] = sql(CUR, ENE, REG, pairs("ene"), windows("ene", "reg"), RPS.format(source="prs", keys="seed_id, track_id"), views=TR, then="SELECT seed_id, track_id, out_start_beat, in_start_beat, round(pair_cost, 6) AS pair_cost FROM rps")
_CMP = "cmp AS (SELECT a.track_id AS track_a_id, b.track_id AS track_b_id, a.native_bpm / b.native_bpm AS stretch_ratio FROM cur a JOIN cur b ON a.track_id <> b.track_id AND a.native_bpm / b.native_bpm BETWEEN 0.95e0 AND 1.05e0)"
O["compatible_pairs"] = sql(CUR, _CMP, views=T, then=f"SELECT track_a_id, track_b_id, round(stretch_ratio, 6) AS stretch_ratio FROM cmp ORDER BY md5('{SEED}-' || track_a_id || '-' || track_b_id), track_a_id, track_b_id LIMIT 60")


def _edge(s: str, order: str) -> str:
    return f"""l{s} AS (SELECT p.seed_id, '{s}' AS strategy, p.track_id, p.stretch_ratio, greatest(0e0, t.duration_seconds - 32 * 60 / p.session_bpm - 8 * 60 / p.session_bpm) AS out_seconds, 8 * 60 / p.session_bpm AS in_seconds, 0e0 AS pair_cost
  FROM (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY {order}, track_id) AS rl FROM {"rkc_t" if s == "C" else "prs"}) p JOIN ene t ON t.track_id = p.seed_id WHERE rl = 1)"""


O["strategy_ladder"] = sql(
    CUR, ENE, REG, pairs("ene"), ranking("prs", "rkc", _C), _edge("A", f"md5('{SEED}-' || p.track_id)".replace("p.", "")), _edge("B", "round(abs(native_bpm - session_bpm), 9)"), _edge("C", "round(total_cost, 9)"),
    INREG.format(reg="reg"), gate("pin"), ranking("ret"), selecting("ene", "reg"),
    "alls AS (SELECT * FROM lA UNION ALL SELECT * FROM lB UNION ALL SELECT * FROM lC UNION ALL SELECT seed_id, 'D', track_id, stretch_ratio, NULL, NULL, pair_cost FROM rps)",
    views=TR,
    then="""SELECT t.track_id AS seed_id, s.strategy, coalesce(a.track_id, -1) AS track_id, round(a.stretch_ratio, 6) AS stretch_ratio, round(out_seconds, 6) AS out_seconds, round(in_seconds, 6) AS in_seconds, round(pair_cost, 6) AS pair_cost,
  CASE WHEN a.track_id IS NULL THEN 'NO_PLAN' END AS failure_reason FROM ene t CROSS JOIN (SELECT unnest(['A', 'B', 'C', 'D']) AS strategy) s LEFT JOIN alls a ON a.seed_id = t.track_id AND a.strategy = s.strategy""",
)

# --- beats ------------------------------------------------------------------
IBI = "ibi AS (SELECT * FROM (SELECT *, beat_time - lag(beat_time) OVER (PARTITION BY track_id ORDER BY beat_index) AS ibi FROM fx_beats) WHERE ibi > 0)"
TCV = "tcv AS (SELECT track_id, 60e0 / median(ibi) AS bpm, CASE WHEN count(ibi) >= 2 AND avg(ibi) > 0 THEN stddev_samp(ibi) / avg(ibi) END AS ibi_cv, count(ibi) AS n FROM ibi GROUP BY track_id)"
ONS = "ons AS (SELECT track_id, list(onset_unit ORDER BY beat_index) AS v FROM fx_beats GROUP BY track_id)"
BT = ("beats",)
O["beat_intervals"] = sql(IBI, views=BT, then="SELECT track_id, beat_index, round(ibi, 6) AS ibi FROM ibi")
O["beat_tempo_cv"] = sql(IBI, TCV, views=BT, then="SELECT track_id, round(bpm, 6) AS bpm, round(ibi_cv, 6) AS ibi_cv, n FROM tcv")
O["octave_selection"] = sql(
    ONS,
    "bse AS (SELECT *, count(*) OVER (PARTITION BY track_id) AS n, lead(beat_time) OVER (PARTITION BY track_id ORDER BY beat_index) AS nxt FROM fx_beats)",
    """grd AS (SELECT track_id, 0 AS grid, 1e0 AS factor, beat_time, CAST(beat_index AS DOUBLE) AS ord FROM bse
  UNION ALL SELECT track_id, 1, 0.5e0, beat_time, beat_index FROM bse WHERE beat_index % 2 = 0 AND n >= 3
  UNION ALL SELECT track_id, 2, 0.5e0, beat_time, beat_index FROM bse WHERE beat_index % 2 = 1 AND n >= 4
  UNION ALL SELECT track_id, 3, 2e0, beat_time, beat_index FROM bse WHERE n >= 2
  UNION ALL SELECT track_id, 3, 2e0, (beat_time + nxt) / 2, beat_index + 0.5e0 FROM bse WHERE nxt IS NOT NULL)""",
    "nx AS (SELECT *, lead(beat_time) OVER (PARTITION BY track_id, grid ORDER BY beat_time, ord) AS nxt FROM grd)",
    "vls AS (SELECT nx.*, nxt - beat_time AS d, v[greatest(0, least(len(v) - 1, CAST(round_even(beat_time * 1.7e0, 0) AS INT))) + 1] AS o, CASE WHEN nxt IS NOT NULL THEN v[greatest(0, least(len(v) - 1, CAST(round_even((beat_time + nxt) / 2 * 1.7e0, 0) AS INT))) + 1] END AS f FROM nx JOIN ons ON ons.track_id = nx.track_id)",
    "ev AS (SELECT track_id, grid, factor, 60e0 / median(d) FILTER (d > 0) AS bpm, avg(o) AS o, avg(f) AS f FROM vls GROUP BY track_id, grid, factor)",
    "sc AS (SELECT *, o * greatest(0e0, (o - f) / (o + f + 1e-12)) AS score, coalesce(bpm BETWEEN 80 AND 180, false) AS inside FROM ev)",
    views=BT,
    then="""SELECT track_id, grid, factor, round(bpm, 6) AS bpm, round(score, 6) AS score, CASE WHEN NOT inside THEN 'TEMPO_OUT_OF_RANGE' END AS failure_reason
  FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY inside DESC, round(score, 9) DESC, round(abs(bpm - 124e0), 9), grid) AS r FROM sc) WHERE r = 1""",
)
O["beat_refine_parabolic"] = sql(
    ONS,
    "c AS (SELECT b.*, v, len(v) AS n, CAST(round_even(beat_time * 1.7e0, 0) AS INT) AS m FROM fx_beats b JOIN ons ON ons.track_id = b.track_id)",
    "w AS (SELECT *, greatest(1, m - 2) AS lo, least(n - 1, m + 3) AS hi FROM c)",
    "p AS (SELECT *, CASE WHEN hi > lo THEN least(n - 2, greatest(1, lo + list_position(v[lo + 1 : hi], list_max(v[lo + 1 : hi])) - 1)) END AS pk FROM w)",
    "q AS (SELECT *, v[pk] AS l, v[pk + 1] AS t, v[pk + 2] AS r FROM p)",
    views=BT,
    then="SELECT track_id, beat_index, round(CASE WHEN n < 3 OR hi <= lo THEN beat_time ELSE (pk + CASE WHEN l - 2 * t + r < 0 THEN greatest(-0.5e0, least(0.5e0, 0.5e0 * (l - r) / (l - 2 * t + r))) ELSE 0e0 END) / 1.7e0 END, 6) AS refined FROM q",
)
O["beat_dedupe"] = sql(
    "l AS (SELECT track_id, list_sort(list(round(beat_time, 1))) AS t FROM fx_beats GROUP BY track_id)",
    "k AS (SELECT track_id, list_reduce(list_transform(t, lambda x: [x]), lambda acc, x: CASE WHEN x[1] - acc[len(acc)] >= 0.65e0 THEN list_concat(acc, x) ELSE acc END) AS k FROM l)",
    views=BT,
    then="SELECT track_id, CAST(len(k) AS INT) AS n, round(list_sum(k), 6) AS total FROM k",
)
O["beat_gate_codes"] = sql(
    IBI, TCV, "g AS (SELECT track_id, n + 1 AS n, round(bpm, 9) AS bpm, round(ibi_cv, 9) AS cv, (track_id % 10) / 10e0 AS ct FROM tcv)", views=BT,
    then="""SELECT track_id, CASE WHEN n < 16 THEN 'TOO_FEW_BEATS' WHEN bpm IS NULL OR NOT bpm BETWEEN 80 AND 180 THEN 'TEMPO_OUT_OF_RANGE' WHEN cv IS NULL OR cv > 0.12e0 THEN 'IRREGULAR_BEAT_GRID'
  WHEN ct < 0.15e0 THEN 'WEAK_ONSET_ALIGNMENT' WHEN greatest(0e0, 1 - cv / 0.12e0) * greatest(0e0, ct) < 0.225e0 THEN 'LOW_CONFIDENCE' ELSE 'PASS' END AS code FROM g""",
)
O["stable_windows"] = sql(
    "n AS (SELECT track_id, max(beat_index) + 1 AS n FROM fx_beats GROUP BY track_id)",
    "s AS (SELECT track_id, CAST(unnest(range(0, n - 31, 4)) AS INT) AS start_beat FROM n WHERE n >= 32)",
    "r AS (SELECT s.track_id, s.start_beat, b.beat_time, b.onset_unit, CASE WHEN b.beat_index > s.start_beat THEN b.beat_time - p.beat_time END AS d FROM s JOIN fx_beats b ON b.track_id = s.track_id AND b.beat_index BETWEEN s.start_beat AND s.start_beat + 31 LEFT JOIN fx_beats p ON p.track_id = b.track_id AND p.beat_index = b.beat_index - 1)",
    "a AS (SELECT track_id, start_beat, min(beat_time) AS t0, max(beat_time) AS t1, min(d) AS least, avg(d) AS m, stddev_samp(d) AS sd, median(d) AS md, avg(onset_unit) AS o FROM r GROUP BY track_id, start_beat)",
    "i AS (SELECT r.track_id, r.start_beat, count(*) FILTER (abs(d - md) <= 0.05e0 * md) / count(d) AS f FROM r JOIN a ON a.track_id = r.track_id AND a.start_beat = r.start_beat GROUP BY r.track_id, r.start_beat)",
    views=BT,
    then="SELECT a.track_id, a.start_beat, a.start_beat + 32 AS end_beat, round(t0, 6) AS start_time, round(t1, 6) AS end_time, round(sd / m, 6) AS ibi_cv, round(f, 6) AS in_tolerance_fraction, round(o, 10) AS mean_onset FROM a JOIN i ON i.track_id = a.track_id AND i.start_beat = a.start_beat WHERE least > 0",
)
O["stable_regions_nms"] = sql(REG, views=TR, then="SELECT track_id, r.s AS start_beat, r.e AS end_beat, round(r.score, 6) AS score FROM nms")
_DIAG = (
    REG, "k AS (SELECT track_id, r.s AS s, r.e AS e, round(r.score, 9) AS sc FROM nms)",
    "wy AS (SELECT w.track_id, w.start_beat, arg_min(k.s, {'a': -k.sc, 'b': k.s}) AS s FROM fx_region_windows w JOIN k ON k.track_id = w.track_id AND k.s < w.end_beat AND w.start_beat < k.e GROUP BY w.track_id, w.start_beat)",
    """dg AS (SELECT w.track_id, w.start_beat, 0.06e0 - ibi_cv AS tempo_margin, in_tolerance_fraction - 0.9e0 AS in_tolerance_margin, mean_onset - 0.35e0 AS onset_margin,
  list_filter([CASE WHEN ibi_cv > 0.06e0 THEN 'TEMPO' END, CASE WHEN in_tolerance_fraction < 0.9e0 THEN 'IN_TOLERANCE' END, CASE WHEN mean_onset < 0.35e0 THEN 'ONSET' END], lambda x: x IS NOT NULL) AS failed, wy.s AS way
  FROM fx_region_windows w LEFT JOIN wy ON wy.track_id = w.track_id AND wy.start_beat = w.start_beat)""",
)
O["region_diagnosis"] = sql(
    *_DIAG, views=TR,
    then="""SELECT track_id, start_beat, round(tempo_margin, 6) AS tempo_margin, round(in_tolerance_margin, 6) AS in_tolerance_margin, round(onset_margin, 6) AS onset_margin, coalesce(array_to_string(failed, ','), '') AS failed,
  CASE WHEN len(failed) > 0 THEN 'GATED' WHEN way = start_beat THEN 'KEPT' WHEN way IS NOT NULL THEN 'OVERLAPPED' ELSE 'OVER_LIMIT' END AS outcome, CASE WHEN len(failed) = 0 AND way <> start_beat THEN way END AS blocked_by FROM dg""",
)
O["region_gate_report"] = sql(
    *_DIAG, "ea AS (SELECT unnest(failed) AS gate, len(failed) = 1 AS alone, tempo_margin, in_tolerance_margin, onset_margin FROM dg)",
    "ch AS (SELECT gate, alone, round(-CASE gate WHEN 'TEMPO' THEN tempo_margin WHEN 'IN_TOLERANCE' THEN in_tolerance_margin ELSE onset_margin END, 6) AS change FROM ea)", views=TR,
    then="SELECT gate, count(*) AS n_failed, count(*) FILTER (alone) AS n_alone, round(median(change) FILTER (alone), 6) AS median_change, round(max(change) FILTER (alone), 6) AS largest_change FROM ch GROUP BY gate",
)


def _found(field: str, value: str, takes: tuple[str, ...]) -> str:
    """A field's problem as text, or null."""
    t = f"json_type({value})"
    known = f"CASE {t} WHEN 'UBIGINT' THEN 'INTEGER' WHEN 'BIGINT' THEN 'INTEGER' WHEN 'DOUBLE' THEN 'NUMBER' WHEN 'VARCHAR' THEN 'STRING' ELSE {t} END"
    return f"CASE WHEN {t} IS NULL THEN {field} || ':MISSING' WHEN {known} NOT IN ({', '.join(repr(x) for x in takes)}) THEN {field} || ':WRONG_TYPE:' || {known} END"


_INT, _NUMBER = ("INTEGER",), ("INTEGER", "NUMBER")
_field = lambda name, takes: "[" + _found(f"'{name}'", f"json_extract(j, '$.{name}')", takes) + "]"
_each = lambda name, inner: f"flatten(list_transform(range(0, CAST(coalesce(json_array_length(j, '$.{name}'), 0) AS BIGINT)), lambda i: [{inner}]))"
_REGIONS = ", ".join(_found(f"'stable_regions[' || i || '].{n}'", f"json_extract(j, '$.stable_regions[' || i || '].{n}')", _INT if n.endswith("beat") else _NUMBER) for n in ("start_beat", "end_beat", "start_time", "end_time", "score", "ibi_cv", "mean_energy"))
_PARTS = [
    _field("track_id", _INT), _field("audio_path", ("STRING",)), *[_field(n, _NUMBER) for n in ("native_bpm", "energy", "analysis_confidence")], _field("analysis_version", _INT), _field("duration_seconds", _NUMBER),
    _field("stable_regions", ("ARRAY",)), _each("stable_regions", _REGIONS), _field("beat_times", ("ARRAY",)), _each("beat_times", _found("'beat_times[' || i || ']'", "json_extract(j, '$.beat_times[' || i || ']')", _NUMBER)), _field("beat_count", _INT),
]
_INTAKE = (
    "js AS (SELECT record_id, CASE WHEN json_valid(record) THEN CAST(record AS JSON) END AS j FROM fx_records)",
    f"jp AS (SELECT record_id, j, CASE WHEN j IS NULL THEN [':NOT_JSON'] ELSE list_filter(flatten([{', '.join(_PARTS)}]), lambda x: x IS NOT NULL) END AS p FROM js)",
)
O["candidate_intake"] = sql(
    *_INTAKE, views=("records",),
    then="SELECT record_id, CASE WHEN len(p) = 0 THEN CAST(j ->> '$.track_id' AS BIGINT) END AS track_id, CASE WHEN len(p) = 0 THEN CAST(j ->> '$.native_bpm' AS DOUBLE) END AS native_bpm, CASE WHEN len(p) = 0 THEN CAST(json_array_length(j, '$.beat_times') AS INT) END AS n_beats, coalesce(array_to_string(p, ';'), '') AS problems FROM jp",
)
O["intake_report"] = sql(
    *_INTAKE, "ex AS (SELECT record_id, regexp_replace(unnest(p), '\\[[0-9]+\\]', '[]', 'g') AS t FROM jp WHERE len(p) > 0)", "gr AS (SELECT record_id, t, count(*) AS n FROM ex GROUP BY record_id, t)", views=("records",),
    then="SELECT split_part(t, ':', 1) AS field, split_part(t, ':', 2) AS code, nullif(split_part(t, ':', 3), '') AS found, CAST(sum(n) AS BIGINT) AS n_problems, count(*) AS n_rows FROM gr GROUP BY t",
)
O["energy_at_beats"] = sql(
    ONS, "x AS (SELECT b.track_id, beat_index, v, greatest(0e0, least(CAST(len(v) - 1 AS DOUBLE), beat_time * 1.5e0)) AS x FROM fx_beats b JOIN ons ON ons.track_id = b.track_id)",
    "y AS (SELECT *, CAST(floor(x) AS INT) AS i FROM x)", views=BT,
    then="SELECT track_id, beat_index, round(v[i + 1] + (v[least(len(v), i + 2)] - v[i + 1]) * (x - i), 6) AS energy FROM y",
)
FR = ("frames",)
XPL = "x AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v FROM fx_frames)"
O["energy_curve_scale"] = sql(
    XPL, "q AS (SELECT vec_id, quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi FROM x GROUP BY vec_id)",
    "u AS (SELECT x.vec_id, CASE WHEN hi - lo <= 1e-12 THEN 0e0 ELSE least(1e0, greatest(0e0, (v - lo) / (hi - lo))) END AS u FROM x JOIN q ON q.vec_id = x.vec_id)", views=FR,
    then="SELECT vec_id, round(CAST(sum(CAST(round(u, 9) AS DECIMAL(20, 9))) AS DOUBLE), 6) AS total, count(*) FILTER (u = 0) AS zeros, count(*) FILTER (u = 1) AS ones FROM u GROUP BY vec_id",
)
O["energy_aggregate"] = sql(XPL, views=FR, then="SELECT vec_id, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(quantile_cont(v, 0.9), 6) AS p90 FROM x GROUP BY vec_id")
RMS = "rm AS (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda c: CAST(c AS DOUBLE) * c)) / len(embedding)) AS rms, coalesce(list_max(list_transform(embedding, lambda c: abs(CAST(c AS DOUBLE)))), 0e0) AS pk FROM fx_frames)"
O["energy_dbfs_unit"] = sql(RMS, views=FR, then="SELECT vec_id, round(greatest(0e0, least(1e0, (20 * log10(greatest(rms, 1e-12)) + 60e0) / 60e0)), 6) AS unit FROM rm")

# --- evaluation -------------------------------------------------------------
AT, RT = ("attempts",), ("ratings",)
O["attempts_summary"] = sql(views=AT, then="SELECT strategy, count(*) AS attempts, count(*) FILTER (status = 'RENDERED') AS successes, round(count(*) FILTER (status = 'RENDERED') / count(*), 6) AS success_rate, round(1 - count(*) FILTER (status = 'RENDERED') / count(*), 6) AS failure_rate FROM fx_attempts GROUP BY strategy")
O["failure_reasons"] = sql(views=AT, then="SELECT strategy, failure_reason, count(*) AS n FROM fx_attempts WHERE status <> 'RENDERED' GROUP BY strategy, failure_reason")
O["metric_distributions"] = sql(
    views=AT,
    then="""SELECT strategy, 'alignment_error_ms' AS metric, count(alignment_error_ms) AS count, count(*) - count(alignment_error_ms) AS missing, round(min(alignment_error_ms), 6) AS min, round(quantile_cont(alignment_error_ms, 0.5), 6) AS p50,
  round(quantile_cont(alignment_error_ms, 0.95), 6) AS p95, round(quantile_cont(alignment_error_ms, 0.99), 6) AS p99, round(max(alignment_error_ms), 6) AS max FROM fx_attempts GROUP BY strategy""",
)
O["strategy_report"] = sql(
    "fr AS (SELECT strategy, string_agg(failure_reason || '=' || n, ',' ORDER BY failure_reason) AS failures FROM (SELECT strategy, failure_reason, count(*) AS n FROM fx_attempts WHERE status <> 'RENDERED' GROUP BY strategy, failure_reason) GROUP BY strategy)",
    "al AS (SELECT strategy, count(*) AS attempts, count(*) FILTER (status = 'RENDERED') AS successes, count(alignment_error_ms) AS c, quantile_cont(alignment_error_ms, 0.5) AS p50, quantile_cont(alignment_error_ms, 0.95) AS p95, max(alignment_error_ms) AS mx FROM fx_attempts GROUP BY strategy)",
    views=AT,
    then="""SELECT al.strategy, attempts, successes, round(successes / attempts, 6) AS success_rate, round(1 - successes / attempts, 6) AS failure_rate, coalesce(failures, '') AS failures, c AS alignment_count, attempts - c AS alignment_missing,
  round(p50, 6) AS alignment_p50, round(p95, 6) AS alignment_p95, round(mx, 6) AS alignment_max, attempts AS render_missing FROM al LEFT JOIN fr ON fr.strategy = al.strategy""",
)
VOT = """cb AS (SELECT DISTINCT pair_id, CASE WHEN CAST(regexp_extract(pair_id, '([0-9]+)', 1) AS INT) % 2 = 0 THEN 'D' ELSE 'B' END AS x FROM fx_ratings),
vt AS (SELECT r.pair_id, listener_id, CASE WHEN preference = 'tie' THEN 0 WHEN (preference = 'X') = (x = 'D') THEN 1 ELSE -1 END AS v FROM fx_ratings r JOIN cb ON cb.pair_id = r.pair_id),
pv AS (SELECT pair_id, CAST(sum(v) AS BIGINT) AS votes, count(DISTINCT listener_id) AS listeners FROM vt GROUP BY pair_id),
oc AS (SELECT *, CASE WHEN listeners >= 3 THEN CAST(sign(votes) AS INT) END AS outcome FROM pv)"""
O["ratings_preference"] = sql(VOT, views=RT, then="SELECT pair_id, votes, listeners, coalesce(CAST(outcome AS VARCHAR), 'none') AS outcome FROM oc")
SIGN = "CASE WHEN {w} + {l} = 0 THEN NULL ELSE least(1e0, 2 * list_sum(list_transform(range(0, least({w}, {l}) + 1), lambda i: exp(lgamma({w} + {l} + 1) - lgamma(i + 1) - lgamma({w} + {l} - i + 1) - ({w} + {l}) * ln(2e0))))) END"
O["ratings_report"] = sql(
    VOT, "rp AS (SELECT count(*) FILTER (listeners > 0) AS rated_pairs, count(outcome) AS eligible_pairs, count(*) FILTER (outcome IS NULL) AS insufficient_pairs, count(*) FILTER (outcome = 1) AS d_wins, count(*) FILTER (outcome = -1) AS b_wins, count(*) FILTER (outcome = 0) AS ties FROM oc)",
    views=RT, then=f"SELECT *, round({SIGN.format(w='d_wins', l='b_wins')}, 6) AS p FROM rp",
)
O["sign_test_table"] = f"WITH n AS (SELECT CAST(w.range AS INT) AS wins, CAST(l.range AS INT) AS losses FROM range(31) w, range(31) l WHERE w.range + l.range <= 30) SELECT wins, losses, coalesce(CAST(round({SIGN.format(w='wins', l='losses')} * power(2e0, wins + losses)) AS BIGINT), -1) AS p_times_outcomes FROM n"
REN = "rn AS (SELECT o_orderkey AS i, " + ", ".join(
    f"CASE WHEN o_orderkey % {11 + k} = 0 THEN 'FAILED' ELSE 'RENDERED' END AS s{k}, 40000 + o_custkey * {k + 1} AS n{k}, o_orderkey * {k + 3} % 20000 AS f{k}" for k in (0, 1)
) + " FROM orders)"
CBK = f"""ck AS (SELECT *, s0 <> 'RENDERED' OR s1 <> 'RENDERED' AS bad, substr(md5('{SEED}-' || i), 1, 1) IN ('0', '1', '2', '3', '4', '5', '6', '7') AS coin FROM rn),
bk AS (SELECT i AS index, printf('pair_%03d', i + 1) AS pair_id, CASE WHEN bad THEN 'PAIR_RENDER_FAILED' END AS failure_reason, CASE WHEN NOT bad THEN CASE WHEN coin THEN 'B' ELSE 'D' END END AS x, CASE WHEN NOT bad THEN CASE WHEN coin THEN 'D' ELSE 'B' END END AS y,
  CASE WHEN NOT bad THEN round(least(15000, f0, f1) / 1000, 6) END AS pre_seconds, CASE WHEN NOT bad THEN round(least(15000, n0 - f0 - 15000, n1 - f1 - 15000) / 1000, 6) END AS post_seconds FROM ck)"""
O["blind_codebook"] = f"WITH {REN}, {CBK} SELECT * FROM bk"
O["blind_export_report"] = f"WITH {REN}, {CBK} SELECT CAST(60 AS BIGINT) AS requested, count(*) AS attempted, count(*) FILTER (failure_reason IS NULL) AS exported, greatest(0, 60 - count(*) FILTER (failure_reason IS NULL)) AS shortfall FROM bk"

# --- naming and snapshots ---------------------------------------------------
_NOISE = r"(official\s+)?((music|lyrics?)\s+)?(video|audio|visuali[sz]er)|lyrics?|with\s+lyrics|lyrics?\s+video|official|audio|video|hd|hq|uhd|\d{3,4}p|4k|full\s+(song|album|version)|free\s+download|download|explicit|clean|cc"
_JUNK = r"^[\s\-_.,;:|]+|[\s\-_,;:|]+$"
NAM = rf"""n1 AS (SELECT track_id, stem, trim(regexp_replace(replace(stem, '_', ' '), '\s+', ' ', 'g')) AS s FROM fx_stems),
n2 AS (SELECT *, regexp_replace(s, '\s*[-–—]\s*topic\s*$', '', 'i') AS t FROM n1),
n3 AS (SELECT *, regexp_replace(t, '[(\[{{]\s*({_NOISE})\s*[)\]}}]', '', 'gi') AS u FROM n2),
n4 AS (SELECT *, regexp_replace(u, '^\s*\d{{1,3}}\s*[.)\-_]\s+', '') AS v FROM n3),
n5 AS (SELECT *, trim(regexp_replace(regexp_replace(v, '{_JUNK}', '', 'g'), '\s+', ' ', 'g')) AS c FROM n4),
n6 AS (SELECT *, regexp_extract(c, '^(.*?)\s+[-–—]\s+(.*)$', 1) AS l0, regexp_extract(c, '^(.*?)\s+[-–—]\s+(.*)$', 2) AS r0 FROM n5),
n7 AS (SELECT *, trim(regexp_replace(l0, '{_JUNK}', '', 'g')) AS l, trim(regexp_replace(r0, '{_JUNK}', '', 'g')) AS r FROM n6),
nm AS (SELECT track_id, CASE WHEN l <> '' AND r <> '' THEN r WHEN c = '' THEN CASE WHEN trim(stem) = '' THEN stem ELSE trim(stem) END ELSE c END AS title, CASE WHEN l <> '' AND r <> '' THEN l END AS artist FROM n7)"""
O["naming_from_stem"] = sql(NAM, views=("stems",), then="SELECT track_id, title, artist FROM nm")
O["naming_resolve"] = sql(
    NAM, "tg AS (SELECT track_id, CASE WHEN track_id % 4 < 2 THEN trim(regexp_replace(replace(' ' || title || '_x ', '_', ' '), '\\s+', ' ', 'g')) END AS t, CASE WHEN track_id % 2 = 0 THEN trim(artist) END AS a FROM fx_tracks)", views=("stems", "tracks"),
    then="SELECT nm.track_id, coalesce(tg.t, nm.title) AS title, CASE WHEN tg.t IS NOT NULL OR tg.a IS NOT NULL THEN tg.a ELSE nm.artist END AS artist, CASE WHEN tg.t IS NOT NULL THEN 'tags' WHEN tg.a IS NOT NULL THEN 'mixed' ELSE 'filename' END AS source FROM nm JOIN tg ON tg.track_id = nm.track_id",
)
SNP = """od AS (SELECT 'lib/' || p_partkey || '.wav' AS audio_path, sha256(p_name || '1') AS content_hash, CASE WHEN p_partkey % 11 = 0 THEN 'SILENT_AUDIO' END AS failure_reason, CASE WHEN p_partkey % 11 = 0 THEN 'FAILED' ELSE 'COMPLETE' END AS analysis_status,
  100e0 + p_partkey % 50 AS native_bpm, 180e0 + p_partkey % 9 AS duration_seconds FROM part WHERE p_partkey % 7 <> 0),
nw AS (SELECT 'lib/' || p_partkey || '.wav' AS audio_path, sha256(p_name || CASE WHEN p_partkey % 3 = 0 THEN '2' ELSE '1' END) AS content_hash, CASE WHEN p_partkey % 13 = 0 THEN 'TOO_SHORT' END AS failure_reason, 181e0 + p_partkey % 9 AS duration_seconds FROM part WHERE p_partkey % 5 <> 1),
ch AS (SELECT nw.*, CASE WHEN od.audio_path IS NOT NULL AND od.content_hash = nw.content_hash AND od.failure_reason IS NULL THEN 'UNCHANGED' WHEN nw.failure_reason IS NOT NULL THEN 'FAILED' WHEN od.audio_path IS NOT NULL THEN 'UPDATED' ELSE 'ADDED' END AS outcome FROM nw LEFT JOIN od ON od.audio_path = nw.audio_path)"""
O["ingest_change_detection"] = f"WITH {SNP} SELECT audio_path, outcome FROM ch"
O["ingest_run_report"] = f"WITH {SNP} SELECT count(*) AS scanned, count(*) FILTER (outcome = 'ADDED') AS added, count(*) FILTER (outcome = 'UPDATED') AS updated, count(*) FILTER (outcome = 'UNCHANGED') AS unchanged, count(*) FILTER (outcome = 'FAILED') AS failed FROM ch"
O["upsert_tracks"] = f"""WITH {SNP}, k AS (SELECT coalesce(od.audio_path, ch.audio_path) AS audio_path, od.content_hash AS oh, od.failure_reason AS ofr, od.analysis_status AS os, od.native_bpm AS ob, od.duration_seconds AS odur, ch.content_hash AS nh, ch.failure_reason AS nf, ch.duration_seconds AS nd, ch.outcome AS o FROM od FULL JOIN ch ON ch.audio_path = od.audio_path)
SELECT audio_path, CASE WHEN o IN ('ADDED', 'UPDATED') THEN nh ELSE oh END AS content_hash, CASE WHEN o IN ('ADDED', 'UPDATED') THEN NULL WHEN o = 'FAILED' THEN nf ELSE ofr END AS failure_reason,
  CASE WHEN o IN ('ADDED', 'UPDATED') THEN 'PENDING' WHEN o = 'FAILED' THEN 'FAILED' ELSE os END AS analysis_status, CASE WHEN o IN ('ADDED', 'UPDATED', 'FAILED') THEN NULL ELSE ob END AS native_bpm, CASE WHEN o IN ('ADDED', 'UPDATED') THEN nd ELSE odur END AS duration_seconds FROM k"""

# --- frames -----------------------------------------------------------------
DB = "CASE WHEN {p} <= 0 THEN -120e0 ELSE greatest(-120e0, 20 * log10({p})) END"
O["frame_peak_rms"] = sql(RMS, views=FR, then=f"SELECT vec_id, round(pk, 6) AS peak, round({DB.format(p='pk')}, 6) AS peak_dbfs, round(rms, 6) AS rms FROM rm")
BLK = """xi AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(len(embedding))) AS j, len(embedding) AS n FROM fx_frames),
bl AS (SELECT vec_id, CAST(j // 4 AS INT) AS i, sqrt(sum(v * v) / 4) AS r FROM xi WHERE j // 4 < n // 4 GROUP BY vec_id, j // 4)"""
O["onset_rise"] = sql(BLK, views=FR, then="SELECT vec_id, i, round(greatest(0e0, r - coalesce(lag(r) OVER (PARTITION BY vec_id ORDER BY i), r)), 6) AS rise FROM bl")
PF = "pf AS (SELECT a.vec_id, list_transform(a.embedding, lambda c: CAST(c AS DOUBLE)) AS x, list_transform(b.embedding, lambda c: CAST(c AS DOUBLE)) AS y FROM fx_frames a JOIN fx_frames b ON b.vec_id = a.vec_id + 1)"
O["alignment_lag"] = sql(
    PF, "ce AS (SELECT vec_id, list_transform(x, lambda c: c - list_avg(x)) AS x, list_transform(y, lambda c: c - list_avg(y)) AS y, len(x) AS n FROM pf)",
    "lg AS (SELECT *, unnest(range(-8, 9)) AS lag FROM ce)",
    "sl AS (SELECT vec_id, CAST(lag AS INT) AS lag, x[greatest(-lag, 0) + 1 : greatest(-lag, 0) + n - abs(lag)] AS p, y[greatest(lag, 0) + 1 : greatest(lag, 0) + n - abs(lag)] AS q FROM lg)",
    "sr AS (SELECT vec_id, lag, CASE WHEN list_inner_product(p, p) > 0 AND list_inner_product(q, q) > 0 THEN list_inner_product(p, q) / (sqrt(list_inner_product(p, p)) * sqrt(list_inner_product(q, q))) ELSE 0e0 END AS score FROM sl)",
    views=FR, then="SELECT vec_id, lag, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 9) DESC, abs(lag), lag) AS r FROM sr) WHERE r = 1",
)
O["energy_jump_db"] = sql(
    "e AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(c AS DOUBLE)) AS x, CAST(least(16, len(embedding) // 2) AS INT) AS k FROM fx_frames)",
    "l AS (SELECT vec_id, k, greatest(power(10e0, -4.5e0), sqrt(list_inner_product(x[1:k], x[1:k]) / k)) AS a, greatest(power(10e0, -4.5e0), sqrt(list_inner_product(x[len(x) - k + 1 : len(x)], x[len(x) - k + 1 : len(x)]) / k)) AS b FROM e)",
    views=FR, then="SELECT vec_id, round(CASE WHEN k >= 1 THEN abs(20 * log10(b / a)) END, 6) AS jump_db FROM l",
)
GAIN = "{f}(0.5e0 * pi() * {i} / greatest({n} - 1, 1))"
O["crossfade_mix"] = sql(
    PF, "u AS (SELECT vec_id, unnest(x) AS x, unnest(y) AS y, unnest(range(len(x))) AS i, len(x) AS n FROM pf)", views=FR,
    then=f"SELECT vec_id, CAST(i AS INT) AS i, round(x * {GAIN.format(f='cos', i='i', n='n')} + y * {GAIN.format(f='sin', i='i', n='n')}, 6) AS v FROM u",
)
O["append_transition"] = sql(
    PF, "e AS (SELECT *, CAST(vec_id % 60 AS INT) AS ex FROM pf)",
    f"""m AS (SELECT vec_id, CASE WHEN ex >= 5 AND ex + 12 <= len(x) AND 22 <= len(y) THEN list_concat(list_concat(x[1:ex],
  list_transform(range(12), lambda i: x[ex + i + 1] * {GAIN.format(f='cos', i='i', n='12')} + y[10 + i + 1] * {GAIN.format(f='sin', i='i', n='12')})), y[23 : len(y)]) END AS m FROM e)""",
    views=FR, then="SELECT vec_id, CAST(coalesce(len(m), 0) AS INT) AS frames, round(list_sum(m), 6) AS total, CASE WHEN m IS NULL THEN 'INSUFFICIENT_SESSION_WINDOW' END AS failure_reason FROM m",
)
O["clip_protect"] = sql(
    "e AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(c AS DOUBLE) * 4) AS x FROM fx_frames)", "p AS (SELECT vec_id, x, list_max(list_transform(x, lambda c: abs(c))) AS pk FROM e)",
    "y AS (SELECT vec_id, pk, CASE WHEN pk > 1 THEN list_transform(x, lambda c: c / pk) ELSE x END AS y FROM p)", views=FR,
    then=f"SELECT vec_id, pk > 1 AS clipped, {DB.format(p='pk')} > -1e0 AS exceeded, round(list_max(list_transform(y, lambda c: abs(c))), 6) AS peak, round(sqrt(list_inner_product(y, y) / len(y)), 6) AS rms FROM y",
)
O["pcm16"] = sql("u AS (SELECT vec_id, unnest(embedding) AS c, unnest(range(len(embedding))) AS i FROM fx_frames)", views=FR, then="SELECT vec_id, CAST(i AS INT) AS i, greatest(-32768, least(32767, CAST(round_even(CAST(c AS DOUBLE) * 4 * 32767e0, 0) AS INT))) AS v FROM u")
O["fade_geometry"] = sql(
    CUR, "cmp AS (SELECT a.track_id AS a, a.native_bpm AS ba, a.duration_seconds AS da, b.native_bpm AS bb, b.duration_seconds AS db, a.native_bpm / b.native_bpm AS rb FROM cur a JOIN cur b ON a.track_id <> b.track_id AND a.native_bpm / b.native_bpm BETWEEN 0.95e0 AND 1.05e0)",
    """g AS (SELECT a, CAST(round_even(da * 44100, 0) AS BIGINT) AS fa, CAST(round_even(db / rb * 44100, 0) AS BIGINT) AS fb, CAST(round_even(da * 0.65e0 * 44100, 0) AS BIGINT) AS aa, CAST(0 AS BIGINT) AS ab,
  greatest(1, CAST(round_even(32 * 60e0 / ba * 44100, 0) AS BIGINT)) AS wanted, greatest(1, CAST(round_even(8 * 60e0 / ba * 44100, 0) AS BIGINT)) AS margin FROM cmp)""",
    "h AS (SELECT *, least(wanted, fa - aa, fb - ab) AS fade, least(fa - aa, fb - ab) < 1 OR wanted < 1 AS bad FROM g)", views=T,
    then="SELECT a AS track_a_id, count(*) AS n, CAST(sum(fade) FILTER (NOT bad) AS BIGINT) AS fade_frames, CAST(sum(least(margin, greatest(0, aa))) FILTER (NOT bad) AS BIGINT) AS pre_samples, CAST(sum(least(margin, greatest(0, fb - ab - fade))) FILTER (NOT bad) AS BIGINT) AS post_samples, count(*) FILTER (bad) AS failed FROM h GROUP BY a",
)
ALN = "CASE WHEN least(end_beat, n) <= 0 THEN 0 WHEN greatest(s, 0) >= least(end_beat, n) THEN CASE WHEN n > 0 THEN least(greatest(s, 0), n - 1) ELSE 0 END ELSE {x} END"
O["align_beat"] = sql(
    "w AS (SELECT track_id, start_beat, end_beat, CAST(track_id % 300 AS INT) AS n, start_beat + CAST(track_id % 7 AS INT) - 2 AS s FROM fx_region_windows)", views=("region_windows",),
    then=f"SELECT track_id, start_beat, {ALN.format(x='CASE WHEN greatest(s, 0) + (4 - greatest(s, 0) % 4) % 4 < least(end_beat, n) THEN greatest(s, 0) + (4 - greatest(s, 0) % 4) % 4 ELSE greatest(s, 0) END')} AS snapped, {ALN.format(x='greatest(s, 0)')} AS plain FROM w",
)
O["remap_beats"] = sql(views=("beats", "tracks"), then="SELECT b.track_id, beat_index, round(beat_time / (124e0 / native_bpm), 6) AS t FROM fx_beats b JOIN fx_tracks t ON t.track_id = b.track_id WHERE native_bpm IS NOT NULL")
O["session_playback"] = sql(
    "sp AS (SELECT track_id, beat_index AS span, round(beat_time + 2.5e0, 3) AS e FROM fx_beats WHERE beat_index % 4 = 0)", "q AS (SELECT track_id, beat_index AS moment, round(beat_time, 3) AS t FROM fx_beats WHERE beat_index % 3 = 1)", views=BT,
    then="SELECT q.track_id, moment, coalesce(arg_min(span, (e, span)) FILTER (e > t), arg_max(span, (e, span))) AS span FROM q JOIN sp ON sp.track_id = q.track_id GROUP BY q.track_id, moment, t",
)
O["playback_clock"] = sql(views=BT, then="SELECT track_id, beat_index, CAST(CAST(floor(greatest(0e0, beat_time)) AS BIGINT) // 60 AS VARCHAR) || ':' || lpad(CAST(CAST(floor(greatest(0e0, beat_time)) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS clock FROM fx_beats")
O["transition_metrics"] = sql(
    views=("attempts",),
    then="""SELECT CAST(attempt_id AS VARCHAR) AS transition_id, status, failure_reason, CASE WHEN status = 'RENDERED' THEN strategy END AS strategy,
  CASE WHEN status = 'RENDERED' THEN round(alignment_error_ms, 6) END AS alignment_error_ms, CASE WHEN status = 'RENDERED' AND attempt_id % 7 = 0 THEN attempt_id / 8e0 END AS render_seconds FROM fx_attempts""",
)
O["session_moves"] = """SELECT CAST(o_orderkey AS VARCHAR) AS session_id, CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'READY' ELSE 'PARTIAL' END AS status,
  CASE WHEN o_orderkey % 2 = 0 THEN 'opened' END AS config_snapshot, CASE WHEN o_orderkey % 2 <> 0 THEN 'ILLEGAL_MOVE' END AS failure_reason FROM orders"""
ST = """st AS (SELECT vec_id, list_transform(flatten([embedding FOR i IN range(4)]), lambda c: CAST(c AS DOUBLE)) AS s FROM fx_frames)"""
O["session_mix"] = sql(
    ST, "li AS (SELECT a.vec_id AS session_id, k, a.vec_id + k AS track_id, 150 + a.vec_id % 50 AS shift, b.s FROM st a, range(3) r(k) JOIN st b ON b.vec_id = a.vec_id + k)",
    "ln AS (SELECT *, count(*) OVER (PARTITION BY session_id) > k + 1 AS more FROM li)",
    "lt AS (SELECT *, CASE WHEN k = 0 THEN 0 ELSE k * shift + 10 END AS start, CASE WHEN more THEN (k + 1) * shift + 34 ELSE k * shift + 256 END AS stop, k * shift AS off FROM ln)",
    "sa AS (SELECT session_id, k, start, stop, more, unnest(range(start, stop)) AS p, unnest(s[start - off + 1 : stop - off]) AS v FROM lt)",
    "ga AS (SELECT session_id, p, sum(v * CASE WHEN k > 0 AND p < start + 24 THEN sin(0.5e0 * pi() * (p - start) / 23) ELSE 1e0 END * CASE WHEN more AND p >= stop - 24 THEN cos(0.5e0 * pi() * (p - stop + 24) / 23) ELSE 1e0 END) AS v FROM sa GROUP BY session_id, p)",
    "pk AS (SELECT session_id, max(abs(v)) AS pk FROM ga GROUP BY session_id)", views=FR,
    then="SELECT session_id, count(*) AS frames, round(sum(v * v) / CASE WHEN pk > 1 THEN pk * pk ELSE 1e0 END, 6) AS energy, round(least(pk, 1e0), 6) AS peak, pk > 1 AS clipped FROM ga JOIN pk USING (session_id) GROUP BY session_id, pk",
)
O["evaluation_run"] = sql(
    ST, """pl AS (SELECT a.vec_id, a.s AS sa, b.s AS sb, a.vec_id * 7 % 270 AS at_a, a.vec_id % 90 AS at_b, least(40, 256 - a.vec_id * 7 % 270, 256 - a.vec_id % 90) AS room FROM st a LEFT JOIN st b ON b.vec_id = a.vec_id + 1)""",
    "re AS (SELECT *, CASE WHEN vec_id % 11 = 0 THEN 'NO_PLAN' WHEN sb IS NULL THEN 'MISSING_TRACK' WHEN room < 1 THEN 'INSUFFICIENT_AUDIO' END AS failure_reason FROM pl)",
    "ok AS (SELECT vec_id, room, sa[at_a + 1 : at_a + room] AS a, sb[at_b + 1 : at_b + room] AS b FROM re WHERE failure_reason IS NULL)",
    f"""mi AS (SELECT vec_id, room, a, b, list_transform(range(room), lambda i: a[i + 1] * {GAIN.format(f='cos', i='i', n='room')} + b[i + 1] * {GAIN.format(f='sin', i='i', n='room')}) AS m, least(16, room // 2) AS k FROM ok)""",
    "jd AS (SELECT vec_id, CASE WHEN k >= 1 THEN abs(20 * log10(greatest(pow(10, -4.5e0), sqrt(list_sum(list_transform(m[-k:], lambda c: c * c)) / k)) / greatest(pow(10, -4.5e0), sqrt(list_sum(list_transform(m[1:k], lambda c: c * c)) / k)))) END AS db FROM mi)",
    "bk AS (SELECT vec_id, list_transform(range(room // 4), lambda i: sqrt((pow(a[i * 4 + 1], 2) + pow(a[i * 4 + 2], 2) + pow(a[i * 4 + 3], 2) + pow(a[i * 4 + 4], 2)) / 4)) AS ra, list_transform(range(room // 4), lambda i: sqrt((pow(b[i * 4 + 1], 2) + pow(b[i * 4 + 2], 2) + pow(b[i * 4 + 3], 2) + pow(b[i * 4 + 4], 2)) / 4)) AS rb FROM ok)",
    "en AS (SELECT vec_id, CASE WHEN len(ra) < 2 THEN [] ELSE list_transform(range(len(ra)), lambda i: CASE WHEN i = 0 THEN 0e0 ELSE greatest(0e0, ra[i + 1] - ra[i]) END) END AS p, CASE WHEN len(rb) < 2 THEN [] ELSE list_transform(range(len(rb)), lambda i: CASE WHEN i = 0 THEN 0e0 ELSE greatest(0e0, rb[i + 1] - rb[i]) END) END AS q FROM bk)",
    "ce AS (SELECT vec_id, len(p) AS n, list_max(p) AS mp, list_max(q) AS mq, list_transform(p, lambda c: c - list_avg(p)) AS x, list_transform(q, lambda c: c - list_avg(q)) AS y FROM en)",
    "lg AS (SELECT *, unnest([-2, -1, 0, 1, 2]) AS lag FROM ce WHERE n >= 3 AND mp > pow(10, -4.5e0) AND mq > pow(10, -4.5e0))",
    "lp AS (SELECT vec_id, n, lag, x[greatest(-lag, 0) + 1 : greatest(-lag, 0) + n - abs(lag)] AS x, y[greatest(lag, 0) + 1 : greatest(lag, 0) + n - abs(lag)] AS y FROM lg WHERE abs(lag) <= (n - 1) // 2)",
    "sc AS (SELECT vec_id, lag, CASE WHEN list_inner_product(x, x) > 0 AND list_inner_product(y, y) > 0 THEN list_inner_product(x, y) / (sqrt(list_inner_product(x, x)) * sqrt(list_inner_product(y, y))) ELSE 0e0 END AS score FROM lp)",
    "be AS (SELECT vec_id, arg_min(lag, (-round(score, 9), abs(lag), lag)) AS lag, arg_min(score, (-round(score, 9), abs(lag), lag)) AS score FROM sc GROUP BY vec_id)", views=FR,
    then="""SELECT re.vec_id AS attempt_id, re.vec_id AS track_a_id, re.vec_id + 1 AS track_b_id, CASE WHEN failure_reason IS NULL THEN 'RENDERED' ELSE 'FAILED' END AS status, failure_reason, CASE WHEN failure_reason IS NULL THEN CAST(re.room AS BIGINT) END AS fade_frames,
  CASE WHEN score >= 0.1e0 THEN round(abs(lag) * 4 * 1000e0 / 44100, 6) END AS alignment_error_ms, round(CASE WHEN score >= 0.1e0 THEN greatest(-1e0, least(1e0, score)) ELSE score END, 6) AS alignment_correlation,
  CASE WHEN ce.n < 3 THEN 'INSUFFICIENT_ONSETS' WHEN mp <= pow(10, -4.5e0) OR mq <= pow(10, -4.5e0) THEN 'SILENT_OR_CONSTANT_OVERLAP' WHEN score < 0.1e0 THEN 'WEAK_CORRELATION' END AS alignment_reason, round(db, 6) AS energy_discontinuity_db
  FROM re LEFT JOIN ce USING (vec_id) LEFT JOIN be USING (vec_id) LEFT JOIN jd USING (vec_id)""",
)
O["stretched_blocks"] = sql(
    "le AS (SELECT vec_id AS track_id, CAST(round_even(40 * len(embedding) / (0.9e0 + vec_id % 21 / 100e0), 0) AS BIGINT) AS frames FROM fx_frames)", views=FR,
    then="SELECT track_id, frames, CAST(ceil(frames / 600) AS BIGINT) AS blocks, CAST(ceil(frames / 600) AS BIGINT) - 1 AS last_block, least(frames, 600) AS largest FROM le WHERE frames > 0",
)
