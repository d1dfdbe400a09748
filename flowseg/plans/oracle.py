"""The same results in plain SQL, for an independent engine over the same tables."""

from __future__ import annotations

from flowseg.functions.columns import HEX_DIGITS, hash_cut
from flowseg.operators.enrich import PROFILE
from flowseg.operators.evaluate import FALSE_POSITIVE, TRUE_NEGATIVE
from flowseg.plans.catalog import (
    CSV_COLUMNS, CSV_LONG, CSV_ODD_VALUE, CSV_SHORT, ENCODED, LARGE_ENCODED, LARGE_SAMPLE_ROWS, PLANE, SAMPLE_ROWS, SCALED, SEGMENT_PLANE, VOTES,
)
from flowseg.plans.flows import FIVE_TUPLE, SPEC, VIEW_SQL
from flowseg.specs import OPTICS_MIN_SAMPLES, OPTICS_XI, PRUNE_THRESHOLD, REPORT_THRESHOLD, SEED, SPECS

_F = f"WITH f AS ({VIEW_SQL})"
_MORE = f"WITH RECURSIVE f AS ({VIEW_SQL})"


def _md5(col: str = "uid", seed: int = SEED) -> str:
    return f"md5(concat('{seed}:', {col}))"


def _below(fraction: float, col: str = "uid", seed: int = SEED) -> str:
    return f"substr({_md5(col, seed)}, 1, {HEX_DIGITS}) < '{hash_cut(fraction)}'"


def _z(expr: str, digits: int = 4, over: str = "") -> str:
    """Standardized and rounded; adding 0 turns -0.0 into 0.0."""
    return f"round(({expr} - avg({expr}) OVER ()) / stddev_samp({expr}) OVER (), {digits}) + 0.0"


# --- scans ----------------------------------------------------------------

_SOURCE = {
    "ts": "round(duration, 6)", "uid": "uid", "id_orig_h": "src_ip", "id_orig_p": "src_port", "id_resp_h": "dst_ip",
    "id_resp_p": "dst_port", "proto": "proto", "service": "translate(service, ' ', '_')", "duration": "round(duration, 6)",
    "orig_bytes": "orig_bytes", "resp_bytes": "resp_bytes", "conn_state": "conn_state", "orig_pkts": "orig_pkts",
    "orig_ip_bytes": "orig_ip_bytes", "label": "label", "detailed_label": "detailed_label",
}
_SQL_TYPE = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE"}
_ZEEK_COLUMNS = ", ".join(
    f"{_SOURCE.get(field.name) or f'CAST(NULL AS {_SQL_TYPE[field.dataType.simpleString()]})'} AS {field.name}"
    for field in SPECS["iot23"].schema
)
_COMMENT = "src_port = 40001 AND orig_pkts = 1"
_SHORT = "src_port = 40002 AND orig_pkts = 2"
_WHOLE = f"NOT ({_COMMENT}) AND NOT ({_SHORT})"

# --- features -------------------------------------------------------------


def _codes(cols: list[str]) -> str:
    """One dictionary CTE per column."""
    return ", ".join(
        f"d_{c} AS (SELECT {c} AS v, row_number() OVER (ORDER BY count(*) DESC, {c}) - 1 AS k FROM f"
        f" WHERE {c} IS NOT NULL GROUP BY {c})"
        for c in cols
    )


def _code(c: str) -> str:
    return f"CAST(coalesce((SELECT k FROM d_{c} WHERE v = f.{c}), (SELECT count(*) FROM d_{c})) AS DOUBLE)"


def _corr_rows() -> str:
    pairs = [(i, a, j, b) for i, a in enumerate(SCALED) for j, b in enumerate(SCALED)]
    return " UNION ALL ".join(
        f"SELECT {i} AS i, {j} AS j, '{a}' AS col_i, '{b}' AS col_j, corr({a}, {b}) AS r FROM f" for i, a, j, b in pairs
    )


# at every scale of the test tables the byte counts are redundant and the first of them goes
_PRUNED = [c for c in SCALED if c != "orig_bytes"]

_NAMES = ["duration", "orig_bytes", "resp_bytes", "orig_pkts", "orig_ip_bytes"]
_PREPARED = (
    f"{_F}, {_codes(ENCODED)}, p AS (SELECT uid, duration, orig_bytes,"
    " coalesce(resp_bytes, CAST(floor(avg(resp_bytes) OVER ()) AS BIGINT)) AS resp_bytes, orig_pkts, orig_ip_bytes, "
    + ", ".join(f"{_code(c)} AS {c}_idx" for c in ENCODED)
    + " FROM f)"
)
_PREPARED_NAMES = [*_NAMES, *[f"{c}_idx" for c in ENCODED]]

# eigenvalues of a 2 x 2 covariance matrix
_PLANE = (
    f"{_F}, m AS (SELECT var_samp({PLANE[0]}) AS a, var_samp({PLANE[1]}) AS b, covar_samp({PLANE[0]}, {PLANE[1]}) AS c FROM f),"
    " s AS (SELECT ((a + b) / 2 + sqrt((a - b) * (a - b) / 4 + c * c)) / (a + b) AS s1 FROM m)"
)

# --- clusters -------------------------------------------------------------

_DIST = "list_max([abs(z[1] - z[2]) for z in list_zip(a.x, b.x)])"


_EMBEDDINGS = "SELECT {group} AS g, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings"


def _plot(group: str, points: str = _EMBEDDINGS) -> str:
    """The walk over the complete distance graph, one vertex per step, in every group."""
    return f"""
WITH RECURSIVE p AS (
  SELECT row_number() OVER (PARTITION BY g ORDER BY x, vec_id) - 1 AS n, g, vec_id, x
  FROM ({points.format(group=group)})
),
d AS MATERIALIZED (SELECT a.g, a.n AS i, b.n AS j, {_DIST} AS w FROM p a JOIN p b ON a.g = b.g AND a.n <> b.n),
st(g, step, n, w, lo, hi, par) AS (
  SELECT g, CAST(0 AS BIGINT), j, w, i, j, i FROM d WHERE i = 0
  UNION ALL
  SELECT s.g, s.step + 1, s.n,
         CASE WHEN t.near THEN d.w ELSE s.w END,
         CASE WHEN t.near THEN least(s.pick, s.n) ELSE s.lo END,
         CASE WHEN t.near THEN greatest(s.pick, s.n) ELSE s.hi END,
         CASE WHEN t.near THEN s.pick ELSE s.par END
  FROM (SELECT *, first_value(n) OVER (PARTITION BY g ORDER BY w, lo, hi) AS pick FROM st) s
  JOIN d ON d.g = s.g AND d.i = s.pick AND d.j = s.n,
  LATERAL (SELECT d.w < s.w OR (d.w = s.w AND (least(s.pick, s.n) < s.lo
           OR (least(s.pick, s.n) = s.lo AND greatest(s.pick, s.n) < s.hi))) AS near) t
),
v AS (
  SELECT g, step + 1 AS ord, n, w, par FROM (
    SELECT *, row_number() OVER (PARTITION BY g, step ORDER BY w, lo, hi) AS rk FROM st) WHERE rk = 1
  UNION ALL SELECT DISTINCT g, 0, 0, CAST(NULL AS DOUBLE), CAST(NULL AS BIGINT) FROM p
)"""


_REACHABILITY = f"""{_plot('0')}
SELECT a.vec_id, v.ord, round(v.w, 6) AS reachability, b.vec_id AS predecessor
FROM v JOIN p a ON a.n = v.n LEFT JOIN p b ON b.n = v.par
"""


def _segments(group: str, columns: str, points: str = _EMBEDDINGS) -> str:
    """All pairs of steep areas, the latest valid one per up area, and the first fit from the left."""
    keep = f"(1 - CAST({OPTICS_XI} AS DOUBLE))"
    return f"""{_plot(group, points)},
plot AS MATERIALIZED (
  SELECT v.g, v.n, v.ord AS pos, coalesce(v.w, 'infinity') AS r, coalesce(q.ord, -1) AS pred,
         coalesce(lead(v.w) OVER o, 'infinity') AS after, coalesce(lag(coalesce(v.w, 'infinity')) OVER o, 'infinity') AS before
  FROM v LEFT JOIN v q ON q.g = v.g AND q.n = v.par WINDOW o AS (PARTITION BY v.g ORDER BY v.ord)
),
k AS (
  SELECT *, CASE WHEN r > after AND (after = 0 OR r / after >= 1 / {keep}) THEN 'down'
                 WHEN r < after AND r / after <= {keep} THEN 'up' END AS s,
         sum(CASE WHEN r < after THEN 1 ELSE 0 END) OVER o AS ups, sum(CASE WHEN r > after THEN 1 ELSE 0 END) OVER o AS downs
  FROM plot WINDOW o AS (PARTITION BY g ORDER BY pos)
),
l AS (
  SELECT *, CASE WHEN pos - lag(pos) OVER o - 1 <= {OPTICS_MIN_SAMPLES}
                  AND CASE s WHEN 'down' THEN ups - lag(ups) OVER o ELSE downs - lag(downs) OVER o END = 0 THEN 0 ELSE 1 END AS fresh
  FROM k WHERE s IS NOT NULL WINDOW o AS (PARTITION BY g, s ORDER BY pos)
),
area AS (
  SELECT g, s, min(pos) AS a, max(pos) AS z
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY g, s ORDER BY pos) AS nr FROM l) GROUP BY g, s, nr
),
pair AS (
  SELECT d.g, d.a AS ds, d.z AS de, u.a AS us, u.z AS ue, x.r AS top, y.after AS level,
         (SELECT max(r) FROM plot m WHERE m.g = d.g AND m.pos BETWEEN d.z + 1 AND u.a) AS high
  FROM area d JOIN area u ON d.g = u.g AND d.s = 'down' AND u.s = 'up' AND d.z < u.a
  JOIN plot x ON x.g = d.g AND x.pos = d.a JOIN plot y ON y.g = u.g AND y.pos = u.z
),
fit AS (
  SELECT *, CASE WHEN top * {keep} >= level THEN (SELECT min(pos) FROM plot m WHERE m.g = pair.g
                   AND m.pos BETWEEN ds AND de AND (m.pos = de OR m.after <= level)) ELSE ds END AS c0,
            CASE WHEN top * {keep} < level AND level * {keep} >= top THEN (SELECT max(pos) FROM plot m WHERE m.g = pair.g
                   AND m.pos BETWEEN us AND ue AND (m.pos = us OR m.before <= top)) ELSE ue END AS c9
  FROM pair WHERE high <= top * {keep} AND high <= level * {keep}
),
sure AS (
  SELECT fit.*, (SELECT max(m.pos) FROM plot m WHERE m.g = fit.g AND m.pos BETWEEN c0 + 1 AND c9
                 AND (h.r > m.r OR m.pred >= c0)) AS c1
  FROM fit JOIN plot h ON h.g = fit.g AND h.pos = c0
),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g, us ORDER BY ds DESC) AS rk FROM sure WHERE c1 >= us) WHERE rk = 1
),
t(g, last, c0, c1, nr) AS (
  SELECT DISTINCT g, CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), -1 FROM p
  UNION ALL
  SELECT g, ue, c0, c1, nr + 1 FROM (
    SELECT t.g, b.ue, b.c0, b.c1, t.nr, row_number() OVER (PARTITION BY t.g ORDER BY b.us) AS rk
    FROM t JOIN best b ON b.g = t.g AND b.ds > t.last) WHERE rk = 1
)
SELECT {columns} p.vec_id, CAST(coalesce(t.nr, -1) AS INTEGER) AS cluster_id
FROM plot JOIN p ON p.g = plot.g AND p.n = plot.n
LEFT JOIN t ON t.g = plot.g AND t.nr >= 0 AND plot.pos BETWEEN t.c0 AND t.c1
"""


# --- evaluation and rules -------------------------------------------------

_RULE = 'SELECT DISTINCT "clusterId" AS "Micro-segment", ' + ", ".join(f"{c} AS {n}" for n, c in FIVE_TUPLE.items())
_ALLOW = f"""{_RULE}, 'Allow' AS Action FROM f WHERE prediction = 0 AND "clusterId" <> -1"""
_BLOCK = f"""{_RULE}, 'Block' AS Action FROM f WHERE prediction = 1 OR "clusterId" = -1"""
_TEST = f"NOT ({_below(0.7)})"

_PROFILE = (
    "SELECT src_ip, count(DISTINCT dst_ip) AS distinct_dst_ips, count(DISTINCT dst_port) AS distinct_dst_ports,"
    " count(*) AS total_flows, CAST(sum(CASE WHEN resp_bytes = 0 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS zero_resp_ratio"
    " FROM f GROUP BY src_ip"
)
_CELLS = (
    "SELECT " + ", ".join(
        f"coalesce(sum(CASE WHEN label = {y} AND prediction = {p} THEN 1 ELSE 0 END), 0)::BIGINT AS {n}"
        for n, y, p in (("tp", 1, 1), ("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0))
    ) + " FROM f"
)


def _learned(where: str = _TEST) -> str:
    """The label of the view is a box in two features, which a tree recovers exactly."""
    return f"{_F} SELECT uid, label, CAST(label AS DOUBLE) AS prediction FROM f WHERE {where}"


# undersampling keeps what hashes below the ratio of the classes; weights make the classes weigh the same
_KEPT = f"(label = 0 OR q >= 1 OR substr({_md5(seed=SEED + 1)}, 1, {HEX_DIGITS}) < format('{{:0{HEX_DIGITS}x}}', CAST(floor(least(q, 1) * {16**HEX_DIGITS}.0::DOUBLE) AS BIGINT)))"


def _votes(strategy: str) -> str:
    """Majority of the training rows with the same vector, counted after undersampling or by weight; ties are benign."""
    kept = _KEPT if strategy == "undersample" else "true"
    one, zero = ("n1 * c0", "n0 * c1") if strategy == "weighted" else ("n1", "n0")
    return f"""{_F}, v AS (SELECT * REPLACE ({VOTES["label"]} AS label), {VOTES["third"]} AS third FROM f),
        tr AS (SELECT * FROM v WHERE {_below(0.7)}),
        c AS (SELECT sum(label) AS c1, sum(1 - label) AS c0, CAST(sum(1 - label) AS DOUBLE) / sum(label) AS q FROM tr),
        g AS (SELECT third, src_port, sum(label) AS n1, sum(1 - label) AS n0 FROM tr, c WHERE {kept} GROUP BY 1, 2),
        t AS (SELECT uid, label, CAST(CASE WHEN {one} > {zero} THEN 1 ELSE 0 END AS DOUBLE) AS prediction
              FROM (SELECT * FROM v WHERE {_TEST}) LEFT JOIN g USING (third, src_port), c)"""


def _metrics(before: str, cells: str) -> str:
    """All measures of the predictions in a table of the given CTEs."""
    return f"""{before}, c2 AS ({cells}), m AS (SELECT *, tp + tn + fp + fn AS total FROM c2),
        q AS (SELECT *, coalesce(tp / nullif(tp + fn, 0), 0) AS se, coalesce(tp / nullif(tp + fp, 0), 0) AS pr FROM m)
        SELECT tp, tn, fp, fn, total, round(coalesce((tp + tn) / nullif(total, 0), 0), 6) AS accuracy, round(se, 6) AS sensitivity,
        round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS specificity, round(pr, 6) AS precision,
        round(coalesce(2 * pr * se / nullif(pr + se, 0), 0), 6) AS f1 FROM q"""


_BY_SOURCE = f"SELECT {{group}} AS g, uid AS vec_id, [{', '.join(f'CAST({c} AS DOUBLE)' for c in SEGMENT_PLANE)}] AS x FROM ({VIEW_SQL})"
_SEGMENTED = f"""WITH seg AS ({_segments("src_ip", "p.g AS g,", _BY_SOURCE)}),
    nr AS (SELECT g, cluster_id, CAST(row_number() OVER (ORDER BY g, cluster_id) - 1 AS INTEGER) AS k FROM (SELECT DISTINCT g, cluster_id FROM seg WHERE cluster_id <> -1)),
    f AS (SELECT v.* REPLACE (CAST(v.label AS DOUBLE) AS prediction, coalesce(nr.k, -1) AS "clusterId")
          FROM ({VIEW_SQL}) v JOIN seg ON seg.vec_id = v.uid LEFT JOIN nr ON nr.g = seg.g AND nr.cluster_id = seg.cluster_id)"""


ORACLES: dict[str, str] = {
    "zeek_parse": f"{_F} SELECT {_ZEEK_COLUMNS} FROM f WHERE {_WHOLE}",
    "zeek_rejects": f"{_F} SELECT CAST(9 AS INTEGER) AS n_fields, count(*) AS n_lines FROM f WHERE ({_SHORT}) AND NOT ({_COMMENT}) HAVING count(*) > 0",
    "zeek_scan": f"{_F} SELECT proto, label, count(*) AS n_flows, CAST(sum(orig_bytes) AS BIGINT) AS orig_bytes, count(service) AS n_service FROM f WHERE {_WHOLE} GROUP BY proto, label",
    "csv_scan": f"{_F} SELECT {', '.join('round(duration, 6) AS duration' if c == 'duration' else c for c in CSV_COLUMNS)} FROM f",
    "csv_header_scan": f"{_F} SELECT service, count(*) AS n_flows, count(*) AS n_uids, CAST(sum(resp_bytes) AS BIGINT) AS resp_bytes FROM f GROUP BY service",
    "csv_parse": f"{_F} SELECT {', '.join(CSV_COLUMNS)} FROM (SELECT * REPLACE (round(duration, 6) AS duration,"
    f" CASE WHEN {CSV_ODD_VALUE} THEN NULL ELSE resp_bytes END AS resp_bytes) FROM f WHERE NOT ({CSV_SHORT}) AND NOT ({CSV_LONG}))",
    "csv_rejects": f"{_F} SELECT CAST(CASE WHEN {CSV_SHORT} THEN 5 ELSE {len(CSV_COLUMNS) + 1} END AS INTEGER) AS n_fields, src_ip, count(*) AS n_records"
    f" FROM f WHERE ({CSV_SHORT}) OR ({CSV_LONG}) GROUP BY 1, 2",
    "stage_reuse": f"{_F} SELECT uid, proto, orig_bytes FROM f",
    "stage_rebuilt": f"{_F} SELECT uid, proto, orig_bytes FROM f WHERE orig_bytes > 30000",
    "save_and_load": f"{_F} SELECT uid, detailed_label, orig_pkts FROM f",
    "rules_csv": f"{_F} {_ALLOW} UNION ALL {_BLOCK}",
    "feature_names": _F + " " + " UNION ALL ".join(
        f"SELECT '{c}' AS name, CAST({i} AS INTEGER) AS pos, count({c}) AS n_known FROM f"
        for i, c in enumerate([*_NAMES, *ENCODED])
    ),
    "binary_label": f"{_F} SELECT uid, detailed_label, CASE WHEN detailed_label = 'DDoS' THEN 1 ELSE 0 END AS is_ddos FROM f",
    "add_uid": """
        WITH h AS (SELECT l_orderkey, l_linenumber, md5(CAST(to_json({'l_orderkey': l_orderkey, 'l_linenumber': l_linenumber}) AS VARCHAR)) AS m FROM lineitem)
        SELECT l_orderkey, l_linenumber, concat(m, '-', row_number() OVER (PARTITION BY m) - 1) AS uid FROM h""",
    "add_uid_salted": _F + """,
        h AS (SELECT proto, conn_state, md5(CAST(to_json({'proto': proto, 'conn_state': conn_state}) AS VARCHAR)) AS m FROM f)
        SELECT proto, conn_state, concat(m, '-', row_number() OVER (PARTITION BY m) - 1) AS uid FROM h""",
    "label_encode": f"{_F}, {_codes(ENCODED)} SELECT uid, {', '.join(f'{_code(c)} AS {c}_idx' for c in ENCODED)} FROM f",
    "label_encode_large": f"{_F}, {_codes(LARGE_ENCODED)} SELECT f.uid, "
    + ", ".join(f"CAST(d_{c}.k AS DOUBLE) AS {c}_idx" for c in LARGE_ENCODED)
    + " FROM f " + " ".join(f"JOIN d_{c} ON d_{c}.v = f.{c}" for c in LARGE_ENCODED),
    "impute_mean": f"{_F} SELECT uid, coalesce(resp_bytes, CAST(floor(avg(resp_bytes) OVER ()) AS BIGINT)) AS resp_bytes,"
    " round(coalesce(resp_bytes / 8.0, avg(resp_bytes / 8.0) OVER ()), 3) AS resp_words FROM f",
    "standardize": f"{_F} SELECT uid, {', '.join(f'{_z(c)} AS {c}' for c in SCALED)} FROM f",
    "corr_matrix": f"{_F}, c AS ({_corr_rows()}) SELECT col_i, col_j, round(r, 6) + 0.0 AS r FROM c",
    "corr_pairs": f"{_F}, c AS ({_corr_rows()}) SELECT col_i, col_j, round(abs(r), 6) AS abs_r FROM c WHERE i < j AND abs(r) > {REPORT_THRESHOLD}",
    "prune_correlated": f"{_F}, c AS ({_corr_rows()}) SELECT uid, {', '.join(_PRUNED)} FROM f"
    f" WHERE (SELECT string_agg(DISTINCT col_i) FROM c WHERE i < j AND abs(r) >= {PRUNE_THRESHOLD}) = 'orig_bytes'",
    "preprocess": f"{_PREPARED} SELECT uid, {', '.join(f'{_z(c)} AS s_{c}' for c in _PREPARED_NAMES)} FROM p",
    "preprocess_pruned": f"{_PREPARED} SELECT uid, {', '.join(f'{_z(c)} AS s_{c}' for c in _PREPARED_NAMES if c != 'orig_bytes')} FROM p",
    "pca_norms": "SELECT vec_id, round(list_sum([x * x for x in CAST(embedding AS DOUBLE[])]), 6) AS squared_norm FROM embeddings",
    "pca_total_variance": "SELECT round(sum(v), 6) AS total_variance FROM (SELECT var_samp(x) AS v FROM ("
    "SELECT unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS k FROM embeddings) GROUP BY k)",
    "pca_explained_variance": f"{_PLANE} SELECT CAST(1 AS INTEGER) AS component, round(s1, 6) AS share, round(s1, 6) AS cumulative FROM s"
    " UNION ALL SELECT 2, round(1 - s1, 6), 1.0 FROM s",
    "pca_choose_k": f"{_PLANE} SELECT t AS target, CAST(CASE WHEN s1 >= t THEN 1 ELSE 2 END AS INTEGER) AS k"
    " FROM s, (SELECT unnest([0.5::DOUBLE, 0.99::DOUBLE, 2.0::DOUBLE]) AS t)",
    "pca_plane": f"{_PLANE}, e AS (SELECT (a + b) * s1 - b AS u, c AS w FROM m, s)"
    f" SELECT uid, round(({PLANE[0]} * u + {PLANE[1]} * w) / sqrt(u * u + w * w), 4) AS first FROM f, e",
    "hash_sample": f"{_F} SELECT uid, proto FROM f WHERE {_below(0.2)}",
    "capped_sample": f"{_F} SELECT uid, proto FROM f WHERE {_below(0.05)} ORDER BY {_md5()}, uid LIMIT {SAMPLE_ROWS}",
    "balanced_sample": f"{_F} SELECT uid, label FROM (SELECT uid, label, row_number() OVER (PARTITION BY label ORDER BY {_md5()}, uid) AS rk FROM f) WHERE rk <= {SAMPLE_ROWS // 2}",
    "balanced_sample_large": f"{_F} SELECT uid, label FROM (SELECT uid, label, row_number() OVER (PARTITION BY label ORDER BY {_md5()}, uid) AS rk FROM f) WHERE rk <= {LARGE_SAMPLE_ROWS // 2}",
    "hash_split": f"{_F} SELECT uid, CASE WHEN {_below(0.7)} THEN 'train' ELSE 'test' END AS part FROM f",
    "undersample": f"{_F}, c AS (SELECT CAST(sum(label) AS DOUBLE) / sum(1 - label) AS q FROM f)"
    f" SELECT uid, label FROM f, c WHERE label = 1 OR q >= 1 OR substr({_md5(seed=SEED + 1)}, 1, {HEX_DIGITS}) < format('{{:0{HEX_DIGITS}x}}', CAST(floor(q * {16**HEX_DIGITS}.0::DOUBLE) AS BIGINT))",
    "class_weights": f"{_F} SELECT label, count(*) AS n, round(CAST(sum(count(*)) OVER () AS DOUBLE) / (count(*) OVER () * count(*)), 6) AS weight FROM f GROUP BY label",
    "weighted_rows": f"{_F} SELECT uid, label, round(CAST(count(*) OVER () AS DOUBLE) / (2 * count(*) OVER (PARTITION BY label)), 6) AS class_weight FROM f",
    "attach_clusters": f"""{_F} SELECT uid, proto, CASE WHEN {_below(0.02)} THEN "clusterId" END AS "clusterId" FROM f WHERE {_below(0.05)}""",
    "flows_in_clusters": f"""{_F} SELECT uid, src_ip, label, "clusterId" FROM f WHERE {_below(0.05)}""",
    "largest_clusters": f"""{_F} SELECT "clusterId", count(*) AS count FROM f WHERE "clusterId" <> -1 AND orig_pkts > 10 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4""",
    "largest_clusters_all": f"{_F} SELECT dst_port % 23 AS segment, count(*) AS count FROM f WHERE dst_port % 23 <> 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "cluster_summary": f"""{_F} SELECT count(*) AS n_points, count(DISTINCT CASE WHEN "clusterId" <> -1 THEN "clusterId" END) AS n_clusters,
        CAST(sum(CASE WHEN "clusterId" = -1 THEN 1 ELSE 0 END) AS BIGINT) AS n_noise,
        round(sum(CASE WHEN "clusterId" = -1 THEN 1 ELSE 0 END) / count(*) * 100, 2) AS noise_pct FROM f""",
    "chebyshev_from_first": f"WITH p AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), b AS (SELECT label, arg_min(x, vec_id) AS x FROM p GROUP BY label)"
    f" SELECT a.vec_id, round({_DIST}, 6) AS distance FROM p a JOIN b USING (label)",
    "core_distance": f"WITH p AS (SELECT vec_id, vec_id AS n, CAST(embedding AS DOUBLE[]) AS x FROM embeddings) SELECT a.vec_id, round(min({_DIST}), 6) AS core_distance FROM p a JOIN p b ON a.n <> b.n GROUP BY a.vec_id",
    "reachability": _REACHABILITY,
    "optics_segments": _segments("0", ""),
    "optics_by_group": _segments("label", "p.g AS label,"),
    "tree_plain": _learned(),
    "tree_undersampled": _learned(),
    "tree_weighted": _learned(),
    "tree_enriched": _learned(),
    "tree_enriched_undersampled": _learned(),
    "tree_enriched_weighted": _learned(),
    **{
        f"votes_{'enriched' * e}{'_' * (e and bool(tail))}{tail}" if e else f"votes_{tail or 'plain'}": f"{_votes(strategy)} SELECT uid, label, prediction FROM t"
        for e in (False, True) for strategy, tail in (("plain", ""), ("undersample", "undersampled"), ("weighted", "weighted"))
    },
    "enriched_job": _metrics(_votes("weighted"), _CELLS.replace("FROM f", "FROM t")),
    "tree_reload": f"{_F} SELECT uid, CAST(label AS DOUBLE) AS prediction FROM f",
    "confusion": f"{_F} SELECT label, prediction, count(*) AS count FROM f GROUP BY 1, 2",
    "binary_metrics": f"""{_F}, c AS ({_CELLS}), m AS (SELECT *, tp + tn + fp + fn AS total FROM c),
        q AS (SELECT *, coalesce(tp / nullif(tp + fn, 0), 0) AS se, coalesce(tp / nullif(tp + fp, 0), 0) AS pr FROM m)
        SELECT tp, tn, fp, fn, total, round(coalesce((tp + tn) / nullif(total, 0), 0), 6) AS accuracy, round(se, 6) AS sensitivity,
        round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS specificity, round(pr, 6) AS precision,
        round(coalesce(2 * pr * se / nullif(pr + se, 0), 0), 6) AS f1 FROM q""",
    "benign_breakdown": f"{_F} SELECT prediction, count(*) AS count FROM f WHERE label = 0 GROUP BY 1",
    "attack_breakdown": f"""{_F}, c AS (SELECT detailed_label, prediction, count(*) AS count FROM f WHERE label = 1 GROUP BY 1, 2)
        SELECT *, CAST(sum(count) OVER (PARTITION BY detailed_label) AS BIGINT) AS total_for_attack,
        round(count / sum(count) OVER (PARTITION BY detailed_label) * 100, 2) AS percentage FROM c""",
    "outcome_means": f"""{_F} SELECT CASE WHEN label = 0 AND prediction = 1 THEN '{FALSE_POSITIVE}' WHEN label = 0 AND prediction = 0 THEN '{TRUE_NEGATIVE}'
        WHEN label = 1 AND prediction = 0 THEN 'FN-' || detailed_label ELSE 'TP-' || detailed_label END AS analysis_group, count(*) AS flow_count,
        round(avg(duration), 4) AS duration, round(avg(orig_bytes), 4) AS orig_bytes, round(avg(orig_pkts), 4) AS orig_pkts FROM f GROUP BY 1""",
    "outcome_means_coded": f"""{_F}, {_codes(["conn_state", "service"])} SELECT CASE WHEN label = 0 AND prediction = 1 THEN '{FALSE_POSITIVE}' WHEN label = 0 AND prediction = 0 THEN '{TRUE_NEGATIVE}'
        WHEN label = 1 AND prediction = 0 THEN 'FN-' || detailed_label ELSE 'TP-' || detailed_label END AS analysis_group, count(*) AS flow_count,
        round(avg(duration), 4) AS duration, round(avg({_code("conn_state")}), 4) AS conn_state, round(avg({_code("service")}), 4) AS service FROM f GROUP BY 1""",
    "reports_guarded": f"{_F} SELECT 'confusion' AS report, count(*) AS n_rows FROM (SELECT DISTINCT label, prediction FROM f) UNION ALL SELECT 'metrics', 1",
    "allow_rules": f"{_F} {_ALLOW}",
    "block_rules": f"{_F} {_BLOCK}",
    "rule_table": f"{_F} {_ALLOW} UNION ALL {_BLOCK}",
    "rule_preview": f'{_F}, r AS ({_ALLOW} UNION ALL {_BLOCK}) SELECT * FROM r ORDER BY "Micro-segment", Action, {", ".join(FIVE_TUPLE)} LIMIT 20',
    "learned_rules": f"""{_F.replace("AS (", "AS (SELECT * REPLACE (CAST(label AS DOUBLE) AS prediction) FROM (", 1)}) {_ALLOW} UNION ALL {_BLOCK}""",
    "segment_rules": f"{_SEGMENTED} {_ALLOW} UNION ALL {_BLOCK}",
    "source_profile": f"{_F}, s AS ({_PROFILE}) SELECT * REPLACE (round(zero_resp_ratio, 6) AS zero_resp_ratio) FROM s",
    "enrich_join": f"{_F}, s AS ({_PROFILE}) SELECT uid, s.* REPLACE (round(zero_resp_ratio, 6) AS zero_resp_ratio) FROM f JOIN s ON f.src_ip = s.src_ip",
    "enrich_join_salted": f"{_F}, s AS ({_PROFILE}) SELECT proto, s.* REPLACE (round(zero_resp_ratio, 6) AS zero_resp_ratio) FROM f JOIN s ON f.src_ip = s.src_ip",
    "rescale_behaviour": f"{_F}, s AS ({_PROFILE}), w AS (SELECT uid, orig_bytes, s.* FROM f JOIN s ON f.src_ip = s.src_ip)"
    f" SELECT uid, {', '.join(f'{_z(c)} AS {c}' for c in ['orig_bytes', *PROFILE])} FROM w",
}
ORACLES |= {f"{name}_blocks": ORACLES[name] for name in ("core_distance", "reachability", "optics_segments")}
