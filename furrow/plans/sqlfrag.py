"""The fixture views of ``furrow.sources.fixtures`` written as SQL (DuckDB dialect).

Used only to build oracle queries: ``with_views('obs', 'yield_raw')`` returns a
``WITH`` clause holding the requested views and everything they depend on.
"""

from __future__ import annotations

from furrow.functions.hashing import scaled_bounds
from furrow.sources.fixtures import CLS_MODELS, CROP_FEATURES, N_PROB_CLASSES, OBS_FIELDS, PART_TYPES
from furrow.sources.profiles import FMAP_KEYS, PROFILES, RANGE_FIELDS, SOILS


class Raw(str):
    """An SQL expression (not a literal) inside a hash key."""


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def h32(*parts) -> str:
    items = ", ".join(f"CAST({p} AS VARCHAR)" if isinstance(p, Raw) else q(str(p)) for p in parts)
    return f"CAST(('0x' || substr(md5(concat_ws(':', {items})), 1, 8)) AS BIGINT)"


def uniform(lo, hi, d, *parts) -> str:
    scale, lo_i, span = scaled_bounds(lo, hi, d)
    return f"(CAST({lo_i} + (({h32(*parts)} * {span + 1}) >> 32) AS DOUBLE) / {float(scale)})"


def uniform_cols(lo_i: str, span: str, scale: int, *parts) -> str:
    return f"(CAST({lo_i} + (({h32(*parts)} * ({span} + 1)) >> 32) AS DOUBLE) / {float(scale)})"


def sql_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


_DEC = {rng: d for _, rng, d in OBS_FIELDS}


def _profiles_sql() -> str:
    rows = []
    for i, (crop, *ranges, soils, ferts) in enumerate(PROFILES):
        vals = [str(i), q(crop)]
        for f, (lo, hi) in zip(RANGE_FIELDS, ranges):
            _, lo_i, span = scaled_bounds(lo, hi, _DEC[f])
            vals += [str(lo_i), str(span)]
        vals.append(sql_list(soils))
        vals += [q(x) for x in ferts]
        rows.append("(" + ", ".join(vals) + ")")
    cols = ["pidx", "crop"] + [f"{f}_{s}" for f in RANGE_FIELDS for s in ("lo_i", "span")] + \
           ["soils"] + ["f_" + k for k in FMAP_KEYS]
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS t({', '.join(cols)})"


def _rule(n, p, k) -> str:
    m = f"least({n}, {p}, {k})"
    return (f"CASE WHEN {m} < 10 THEN CASE WHEN {n} = {m} THEN f_N_low WHEN {p} = {m} THEN f_P_low "
            f"ELSE f_K_low END ELSE f_balanced END")


def _obs_full_sql() -> str:
    num = []
    for out, rng, d in OBS_FIELDS:
        num.append(f"{uniform_cols(f'pr.{rng}_lo_i', f'pr.{rng}_span', 10 ** d, rng, Raw('o.o_orderkey'))} AS {out}")
    base = (f"SELECT o.o_orderkey AS obs_id, pr.* EXCLUDE (crop), {', '.join(num)}, "
            f"pr.soils[({h32('soil', Raw('o.o_orderkey'))} % len(pr.soils)) + 1] AS Soil, pr.crop AS Crop "
            f"FROM orders o JOIN profiles pr ON pr.pidx = {h32('crop', Raw('o.o_orderkey'))} % {len(PROFILES)}")
    return f"SELECT *, {_rule('N', 'P', 'K')} AS Fertilizer FROM ({base}) b"


def _yield_raw_sql() -> str:
    pad = f"{h32('season', Raw('o.o_orderkey'))} % 3"
    rec = "(l.l_orderkey * 8 + l.l_linenumber)"
    k = "l.l_orderkey"
    return f"""SELECT {rec} AS rec_id, n.n_name AS State_Name,
  CASE WHEN {pad} = 0 THEN o.o_orderpriority || '  ' WHEN {pad} = 1 THEN o.o_orderpriority || ' ' || chr(9)
       ELSE o.o_orderpriority END AS Season,
  p.p_type AS Crop, year(l.l_shipdate) AS Crop_Year,
  CASE WHEN {k} % 101 = 0 THEN NULL ELSE {uniform(10, 45, 1, 'temp', Raw(rec))} END AS Temperature,
  {uniform(20, 95, 1, 'hum', Raw(rec))} AS Humidity,
  {uniform(5, 60, 1, 'moist', Raw(rec))} AS Soil_Moisture,
  CASE WHEN {k} % 97 = 0 THEN NULL WHEN {k} % 89 = 0 THEN 0.0 ELSE l.l_quantity END AS Area,
  CASE WHEN {k} % 83 = 0 THEN NULL WHEN {k} % 211 = 0 THEN l.l_extendedprice * 1000 ELSE l.l_extendedprice END AS Production
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN part p ON l.l_partkey = p.p_partkey"""


def _messages_sql() -> str:
    k = "o_orderkey"
    s = lambda e: f"CAST({e} AS VARCHAR)"
    a, b, c = f"{k} % 140", f"({k} // 7) % 145", f"({k} // 11) % 205"
    t, hu, rn = f"{k} % 36 + 8", f"{k} % 82 + 14", f"{k} % 280 + 20"
    ph = f"(CASE WHEN ({k} // 6) % 10 = 3 THEN '6.5.1' ELSE {s(f'{k} % 5 + 4')} END)"
    crop = f"{sql_list([p[0] for p in PROFILES])}[({k} // 6) % {len(PROFILES)} + 1]"
    soil = f"{sql_list(SOILS)}[({k} // 5) % {len(SOILS)} + 1]"
    typ = f"{sql_list(PART_TYPES)}[({k} // 3) % {len(PART_TYPES)} + 1]"
    state = f"('NATION_' || {s('o_custkey % 25')})"
    season = "lower(o_orderpriority)"
    text = f"""CASE {k} % 6
  WHEN 0 THEN concat('What crop should I grow? N=', {s(a)}, ', P=', {s(b)}, ', K=', {s(c)}, ', temperature=', {s(t)}, ', humidity=', {s(hu)}, ', ph=', {ph}, ', rainfall=', {s(rn)})
  WHEN 1 THEN concat('Which crop suits nitrogen: ', {s(a)}, ' and rain = ', {s(rn)}, ' mm?')
  WHEN 2 THEN concat('Please predict fertilizer for ', {crop}, ' in ', {soil}, ' soil, N=', {s(a)}, ' P=', {s(b)}, ' K=', {s(c)}, ' ph=', {ph})
  WHEN 3 THEN concat('Can you predict the yield of ', {typ}, ' in ', {state}, ' during ', {season}, ' season? temp: ', {s(t)})
  WHEN 4 THEN concat('Which fertilizer is best for ', {crop}, ' in ', {soil}, ' soil? It is ', {s(t)}, '°C here.')
  ELSE concat('Tell me about irrigation. Humidity=', {s(hu)}, '. Is ', {s(t)}, ' C too hot? Thanks!') END"""
    return (f"SELECT 'order' AS src, o_orderkey AS msg_id, CAST(0 AS BIGINT) AS turn, {text} AS text FROM orders "
            f"UNION ALL SELECT 'chat' AS src, conv_id AS msg_id, CAST(turn AS BIGINT) AS turn, text "
            f"FROM conversations WHERE role = 'user'")


def _preds_cls_sql() -> str:
    parts = []
    for name, spread in CLS_MODELS:
        j = {c: f"({c} + CAST({h32(name, c, Raw('obs_id'))} % {2 * spread + 1} - {spread} AS DOUBLE))"
             for c in ("N", "P", "K")}
        parts.append(f"SELECT obs_id, {q(name)} AS model, Crop, Fertilizer AS y, {_rule(j['N'], j['P'], j['K'])} AS yhat "
                     f"FROM obs_full")
    return " UNION ALL ".join(parts)


def _probs_sql() -> str:
    hs = [f"CAST({h32('prob', Raw('vec_id'), i)} % 1000 + 1 AS DOUBLE)" for i in range(N_PROB_CLASSES)]
    hs[1] = f"CASE WHEN vec_id % 5 = 0 THEN {hs[0]} ELSE {hs[1]} END"
    return (f"SELECT row_id, list_transform(arr, lambda x: x / list_sum(arr)) AS probability FROM "
            f"(SELECT vec_id AS row_id, [{', '.join(hs)}] AS arr FROM embeddings) z")


def _contribs_sql() -> str:
    feats = ", ".join(f"({q(f)})" for f in CROP_FEATURES)
    case = "CASE f.feature " + " ".join(f"WHEN {q(c)} THEN o.{c}" for c in CROP_FEATURES) + " END"
    zero = f"{h32('zero', Raw('o.obs_id'), Raw('f.feature'))} % 9 = 0"
    con = uniform(-1, 1, 2, 'shap', Raw('o.obs_id'), Raw('f.feature'))
    return (f"SELECT o.obs_id, f.feature, {case} AS value, CASE WHEN {zero} THEN 0.0 ELSE {con} END AS contribution "
            f"FROM obs o CROSS JOIN (VALUES {feats}) AS f(feature)")


VIEWS: dict[str, tuple[list[str], str]] = {
    "profiles": ([], _profiles_sql()),
    "obs_full": (["profiles"], _obs_full_sql()),
    "obs": (["obs_full"], "SELECT obs_id, Temperature, Humidity, Rainfall, pH, N, P, K, Soil, Crop, Fertilizer FROM obs_full"),
    "yield_raw": ([], _yield_raw_sql()),
    "yield_clean": (["yield_raw"], "SELECT *, Production / Area AS yield_per_hectare FROM yield_raw "
                    "WHERE Production IS NOT NULL AND Area IS NOT NULL AND NOT isnan(Production) AND NOT isnan(Area) "
                    "AND Area > 0 AND Production > 0"),
    "yield_trim": (["yield_clean"], "SELECT * FROM yield_clean WHERE yield_per_hectare <= "
                   "(SELECT quantile_cont(yield_per_hectare, 0.99) FROM yield_clean)"),
    "messages": ([], _messages_sql()),
    "kb": ([], "SELECT vec_id AS id, concat('Passage ', CAST(vec_id AS VARCHAR), ' on topic ', CAST(label AS VARCHAR), '.') AS text, "
               "'cat_' || CAST(label AS VARCHAR) AS category, CASE WHEN vec_id % 7 = 0 THEN NULL ELSE 'topic_' || CAST(label AS VARCHAR) END AS topic, "
               "embedding FROM embeddings"),
    "corpus": ([], "SELECT doc_id AS id, lang AS category, source AS topic, text FROM documents"),
    "chat": ([], "SELECT conv_id, turn, role, text AS content FROM conversations"),
    "preds_cls": (["obs_full"], _preds_cls_sql()),
    "yield_scored": (["yield_clean"], "SELECT y.* EXCLUDE (yield_per_hectare), y.yield_per_hectare AS y, m.yhat FROM yield_clean y JOIN "
                     "(SELECT Crop, avg(yield_per_hectare) AS yhat FROM yield_clean GROUP BY Crop) m ON y.Crop = m.Crop"),
    "preds_reg": (["yield_scored"], "SELECT rec_id, Crop, y, yhat FROM yield_scored"),
    "probs": ([], _probs_sql()),
    "contribs": (["obs"], _contribs_sql()),
    "train_log": ([], "SELECT event_type AS run, event_id, value AS error, ts FROM events"),
}


def with_views(*names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in VIEWS[n][0]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order) + "\n"
