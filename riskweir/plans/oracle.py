"""DuckDB SQL for the registered queries: the same results, written independently as plain SQL."""

from __future__ import annotations

from riskweir.operators.audit import REVIEW_NOTE
from riskweir.schema import BOOLEAN, CATEGORICAL, FEATURES, MISSING, NUMERIC, VENDOR

ALL = FEATURES.all
CONT = [*NUMERIC, *BOOLEAN]

APPS_RAW = """
raw AS (
  SELECT l_orderkey AS application_id, p_type AS product, c_mktsegment AS industry, n_name AS city, r_name AS state,
         l_shipdate AS application_date,
         CASE WHEN l_linestatus = 'O' THEN 'APPROVED' ELSE 'DECLINED' END AS final_decision,
         CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_fraud,
         CASE WHEN l_linenumber = 7 THEN NULL ELSE c_acctbal END AS credit_score,
         l_discount * 10 AS fraud_score,
         CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o_orderdate END AS first_transaction_date,
         l_linenumber, l_partkey, l_suppkey, l_extendedprice
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey
)"""

APPS_LATEST = APPS_RAW + """,
latest AS (
  SELECT * FROM raw QUALIFY row_number() OVER (
    PARTITION BY application_id
    ORDER BY application_date DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1
)"""

APPS = APPS_LATEST + """,
apps AS (
  SELECT application_id, product, industry, city, state, application_date, final_decision, is_fraud, credit_score, fraud_score,
         first_transaction_date,
         (final_decision = 'APPROVED')::INT AS is_approved,
         (final_decision = 'APPROVED' AND is_fraud = 1)::INT AS approved_fraud,
         floor((epoch_us(first_transaction_date) - epoch_us(application_date)) / 86400000000.0::DOUBLE)::BIGINT AS date_gap_days,
         application_date::DATE AS app_day
  FROM latest WHERE first_transaction_date IS NULL OR first_transaction_date >= application_date
)"""

_COUNTS = """count(application_id)::BIGINT AS applications, sum(is_approved)::BIGINT AS approvals, sum(is_fraud)::BIGINT AS frauds,
  sum(approved_fraud)::BIGINT AS approved_frauds"""
_RATES = """approvals::DOUBLE / nullif(applications, 0) AS approval_rate, frauds::DOUBLE / nullif(applications, 0) AS application_fraud_rate,
  approved_frauds::DOUBLE / nullif(approvals, 0) AS approved_fraud_rate"""

DAILY = APPS + f""",
daily AS (
  SELECT *, {_RATES} FROM (
    SELECT app_day, {_COUNTS},
      avg(credit_score) AS avg_credit_score,
      avg(credit_score) FILTER (WHERE is_approved = 1) AS avg_credit_score_on_approvals,
      avg(credit_score) FILTER (WHERE is_fraud = 1) AS avg_credit_score_on_frauds,
      avg(fraud_score) AS avg_fraud_score,
      avg(fraud_score) FILTER (WHERE is_approved = 1) AS avg_fraud_score_on_approvals,
      avg(fraud_score) FILTER (WHERE is_fraud = 1) AS avg_fraud_score_on_frauds,
      avg(date_gap_days)::DOUBLE AS avg_date_gap_days
    FROM apps GROUP BY app_day)
)"""

# Means of two-decimal inputs are rounded at the seventh digit, where no exact ties occur for groups this small.
_DAILY_MEANS = [f"avg_{s}{t}" for s in ("credit_score", "fraud_score") for t in ("", "_on_approvals", "_on_frauds")] + ["avg_date_gap_days"]
MEAN_DIGITS = 7

BASE = """
base AS (
  SELECT l_orderkey AS k, count(*) AS n, sum(l_quantity) AS volume, count(DISTINCT l_suppkey) AS suppliers, max(l_shipdate) AS last_ship,
         (count(*) FILTER (WHERE l_returnflag = 'R') >= 2)::INT AS y
  FROM lineitem GROUP BY l_orderkey
),
wide AS (
  SELECT base.*, o_custkey, o_orderdate, o_totalprice, o_orderpriority, c_acctbal, c_mktsegment, r_name
  FROM base JOIN orders ON k = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""

MERCHANTS = BASE + """,
merchants AS (
  SELECT 'order-' || k AS id, y AS is_fraud,
    CASE WHEN k % 5 = 0 THEN NULL ELSE c_acctbal END AS ea_score,
    CASE WHEN k % 43 = 0 THEN NULL ELSE o_totalprice END AS identity_rank,
    n::DOUBLE AS reputation_level, volume AS volume_score, suppliers::DOUBLE AS result_number,
    date_diff('day', o_orderdate, last_ship)::DOUBLE AS email_days,
    1.0::DOUBLE AS is_valid, CASE WHEN k % 6 = 0 THEN NULL ELSE 1.0::DOUBLE END AS is_connected,
    (k % 2)::DOUBLE AS personal_device, CASE WHEN k % 4 = 0 THEN NULL ELSE (k % 3 > 0)::INT::DOUBLE END AS receiving_mail,
    (o_custkey % 256)::VARCHAR AS area_code, CASE WHEN k % 7 = 0 THEN NULL ELSE c_mktsegment END AS device_browser_type,
    r_name AS ip_address_loc_country, substr(o_orderpriority, 1, 1) AS type, o_orderdate AS open_date
  FROM wide
)"""


def _seats(total: str, n0: str, n1: str) -> str:
    """Seats of class 0 for two classes."""
    e0, e1 = f"({total})::DOUBLE * {n0} / ({n0} + {n1})", f"({total})::DOUBLE * {n1} / ({n0} + {n1})"
    spare = f"(({total}) - floor({e0}) - floor({e1}))"
    return (
        f"(floor({e0}) + CASE WHEN {spare} <= 0 THEN 0 WHEN {spare} >= 2 THEN 1 "
        f"WHEN {e0} - floor({e0}) >= {e1} - floor({e1}) THEN 1 ELSE 0 END)::BIGINT"
    )


def split_ctes(source: str = "merchants", seed: str = "42") -> str:
    return f"""
ranked AS (SELECT *, row_number() OVER (PARTITION BY is_fraud ORDER BY sha256('{seed}:' || id)) AS rk FROM {source}),
q1 AS (SELECT count(*) FILTER (WHERE is_fraud = 0) AS n0, count(*) FILTER (WHERE is_fraud = 1) AS n1 FROM {source}),
q2 AS (SELECT *, ceil((n0 + n1) * 0.3::DOUBLE)::BIGINT AS held FROM q1),
q3 AS (SELECT *, n0 + n1 - held AS kept, ceil(held * 0.5::DOUBLE)::BIGINT AS tested FROM q2),
q4 AS (SELECT *, {_seats("kept", "n0", "n1")} AS t0 FROM q3),
q5 AS (SELECT *, kept - t0 AS t1, n0 - t0 AS h0, n1 - kept + t0 AS h1 FROM q4),
q6 AS (SELECT *, {_seats("held - tested", "h0", "h1")} AS v0 FROM q5),
q7 AS (SELECT *, held - tested - v0 AS v1 FROM q6),
parts AS (
  SELECT ranked.* EXCLUDE (rk), CASE
    WHEN rk <= CASE is_fraud WHEN 0 THEN t0 ELSE t1 END THEN 'train'
    WHEN rk <= CASE is_fraud WHEN 0 THEN t0 + v0 ELSE t1 + v1 END THEN 'validation' ELSE 'test' END AS split
  FROM ranked, q7
)"""


PARTS = MERCHANTS + "," + split_ctes()

SCORED = BASE + """,
scores AS (
  SELECT 'order-' || k AS id, y AS is_fraud, 1 - 1.0::DOUBLE / n AS a_lines, volume / (volume + 100.0::DOUBLE) AS a_quantity,
    o_totalprice / (o_totalprice + 250000.0::DOUBLE) AS a_value, n / (n + 8.0::DOUBLE) AS b_lines,
    1 - 60.0::DOUBLE / (volume + 60.0::DOUBLE) AS b_quantity, 1 - o_totalprice / (o_totalprice + 250000.0::DOUBLE) AS b_value
  FROM wide
),""" + split_ctes("scores") + """,
scored AS (
  SELECT id, is_fraud, split, 'model_' || m AS model, c AS feature_configuration, f AS n_features, score FROM (
    SELECT id, is_fraud, split, 'a' AS m, 'lines' AS c, 1 AS f, a_lines AS score FROM parts
    UNION ALL SELECT id, is_fraud, split, 'a', 'quantity', 2, a_quantity FROM parts
    UNION ALL SELECT id, is_fraud, split, 'a', 'value', 3, a_value FROM parts
    UNION ALL SELECT id, is_fraud, split, 'b', 'lines', 1, b_lines FROM parts
    UNION ALL SELECT id, is_fraud, split, 'b', 'quantity', 2, b_quantity FROM parts
    UNION ALL SELECT id, is_fraud, split, 'b', 'value', 3, b_value FROM parts)
)"""


def metric_ctes(by: str, source: str = "scored", out: str = "met") -> str:
    """The seven metrics of ``source`` grouped by ``by``."""
    return f"""
{out}_h AS (SELECT {by}, score, sum(is_fraud)::BIGINT AS pos, sum(1 - is_fraud)::BIGINT AS neg FROM {source} GROUP BY {by}, score),
{out}_c AS (
  SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn FROM {out}_h
  WINDOW w AS (PARTITION BY {by} ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
{out}_s AS (
  SELECT {by}, sum(pos * (cp::DOUBLE / (cp + cn)::DOUBLE)) AS ap, sum(neg * (cp - pos / 2.0::DOUBLE)) AS pairs,
    sum(pos)::DOUBLE AS p, sum(neg)::DOUBLE AS n,
    coalesce(sum(pos) FILTER (WHERE score >= 0.5), 0)::DOUBLE AS tp, coalesce(sum(neg) FILTER (WHERE score >= 0.5), 0)::DOUBLE AS fp,
    coalesce(sum(pos) FILTER (WHERE score < 0.5), 0)::DOUBLE AS fn, coalesce(sum(neg) FILTER (WHERE score < 0.5), 0)::DOUBLE AS tn
  FROM {out}_c GROUP BY {by}),
{out} AS (
  SELECT {by}, round(ap / p, 10) AS pr_auc, round(pairs / (p * n), 10) AS roc_auc, round((tp + tn) / (p + n), 10) AS accuracy,
    round((tp / p + tn / n) / 2, 10) AS balanced_accuracy,
    round(coalesce(tp / nullif(tp + fp, 0), 0), 10) AS "precision", round(tp / p, 10) AS recall,
    round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 10) AS f1
  FROM {out}_s)"""


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def _cells(source: str, features: list[str], kind: str, keep: str = "is_fraud") -> str:
    return _union([f"SELECT {keep}, '{f}' AS feature, {f}::{kind} AS value FROM {source}" for f in features])


TRAIN = PARTS + ",\ntrain AS (SELECT * FROM parts WHERE split = 'train')"

_MODE = """SELECT feature, value::VARCHAR AS fill FROM (
  SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY count(*) DESC, value) AS r
  FROM {cells} WHERE value IS NOT NULL GROUP BY feature, value) WHERE r = 1"""

FILLS = TRAIN + f""",
num_cells AS ({_cells("train", CONT, "DOUBLE")}),
text_cells AS ({_cells("train", list(CATEGORICAL), "VARCHAR")}),
num_fill AS (SELECT feature, round(median(value), 6) AS fill FROM num_cells GROUP BY feature),
text_fill AS ({_MODE.format(cells="text_cells")})"""


def _fill(f: str) -> str:
    table = "num_fill" if f in CONT else "text_fill"
    return f"coalesce({f}, (SELECT fill FROM {table} WHERE feature = '{f}')) AS {f}"


BAD_MERCHANTS = MERCHANTS + """,
bad AS (
  SELECT is_fraud,
    CASE WHEN n % 5 = 4 THEN '4d' WHEN n % 5 = 3 THEN 'inf' ELSE identity_rank::VARCHAR END AS identity_rank,
    CASE WHEN m.id LIKE '%7' THEN 'maybe' WHEN m.id LIKE '%8' THEN '2' ELSE is_valid::INT::VARCHAR END AS is_valid,
    CASE WHEN m.id LIKE '%11' THEN NULL WHEN m.id LIKE '%12' THEN '  ' WHEN m.id LIKE '%13' THEN 'Null'
         WHEN m.id LIKE '%14' THEN 'order-twin' ELSE m.id END AS id
  FROM merchants m JOIN base ON m.id = 'order-' || k
)"""

_CLEAN_APP_COLS = """application_id, product, industry, city, state, application_date, final_decision, is_fraud, credit_score, fraud_score,
first_transaction_date, is_approved, approved_fraud, date_gap_days, app_day"""

WINDOW = ("1998-06-25", "1998-07-04")

_DIGEST = """sha256(count(*)::VARCHAR || ':' || """ + " || ':' || ".join(
    f"sum(('0x' || substr(h, {1 + 5 * i}, 5))::BIGINT)::VARCHAR" for i in range(8)) + ")"

_DECIDE = "CASE WHEN score >= 0.8 THEN 'decline' WHEN score >= 0.2 THEN 'manual_review' ELSE 'approve' END"

_PROFIT = """SELECT *, round(revenue - fraud_loss - manual_review_cost - vendor_cost, 4) AS profit FROM (
  SELECT {by},
    480.0::DOUBLE * count(*) FILTER (WHERE d = 'approve' AND is_fraud = 0) + 480.0::DOUBLE * 0.3::DOUBLE * count(*) FILTER (WHERE d = 'manual_review' AND is_fraud = 0) AS revenue,
    500.0::DOUBLE * count(*) FILTER (WHERE d = 'approve' AND is_fraud = 1) + 500.0::DOUBLE * 0.3::DOUBLE * count(*) FILTER (WHERE d = 'manual_review' AND is_fraud = 1) AS fraud_loss,
    50.0::DOUBLE * count(*) FILTER (WHERE d = 'manual_review') AS manual_review_cost,
    CASE WHEN model = 'model_b' THEN 0.5::DOUBLE * count(*) ELSE 0.0::DOUBLE END AS vendor_cost,
    count(*) FILTER (WHERE d = 'approve')::BIGINT AS n_approve, count(*) FILTER (WHERE d = 'manual_review')::BIGINT AS n_manual_review,
    count(*) FILTER (WHERE d = 'decline')::BIGINT AS n_decline
  FROM (SELECT *, {decide} AS d FROM scored WHERE split = 'test') GROUP BY {by})"""

MET = SCORED + "," + metric_ctes("model, feature_configuration, n_features, split")

VAL = MET + """,
val AS (SELECT model, feature_configuration, n_features, pr_auc AS validation_pr_auc FROM met WHERE split = 'validation')"""

IMPORTANCE = MET + """,
imp AS (SELECT model, feature_configuration AS feature, round(pr_auc - (SELECT min(pr_auc) FROM met), 9) AS importance FROM met WHERE split = 'validation')"""


def _drift(ctes: str, table: str, baseline: str, window: str, name: str, numeric: tuple, texts: tuple, bins: int, most: int) -> str:
    """Drift against the rows for which ``baseline`` is true: quantile bins, most frequent values, PSI with half an occurrence in every bin."""
    edges = [f"SELECT '{f}' AS feature, unnest(list_distinct(list_transform(quantile_cont({f}::DOUBLE, [{', '.join(str(k / bins) for k in range(1, bins))}]), lambda x: format('{{:.12g}}', x)::DOUBLE))) AS edge FROM {table} WHERE {baseline}" for f in numeric]
    known = [f"(SELECT '{f}' AS feature, {f}::VARCHAR AS value, row_number() OVER (ORDER BY count(*) DESC, {f}) - 1 AS bin FROM {table} WHERE {baseline} AND {f} IS NOT NULL GROUP BY {f} ORDER BY bin LIMIT {most})" for f in texts]
    cells = [
        f"SELECT {window} AS {name}, {baseline} AS base, '{f}' AS feature, CASE WHEN {f} IS NOT NULL THEN (SELECT count(*) FROM edges e WHERE e.feature = '{f}' AND {f} > e.edge) END AS bin FROM {table}" for f in numeric
    ] + [
        f"SELECT {window} AS {name}, {baseline} AS base, '{f}' AS feature, CASE WHEN {f} IS NOT NULL THEN coalesce((SELECT bin FROM known k WHERE k.feature = '{f}' AND k.value = {f}), (SELECT count(*) FROM known k WHERE k.feature = '{f}')) END AS bin FROM {table}" for f in texts
    ]
    return _with(ctes + f""",
edges AS ({_union(edges)}), known AS ({_union(known)}),
cells AS ({_union(cells)}),
sizes AS (SELECT feature, count(*) + 1 AS bins FROM (SELECT feature FROM edges UNION ALL SELECT feature FROM known) GROUP BY feature),
slots AS (SELECT feature, bins, unnest(range(bins)) AS bin FROM sizes),
base AS (SELECT feature, count(*) AS n, count(bin) AS seen FROM cells WHERE base GROUP BY feature),
base_bins AS (SELECT s.feature, s.bin, s.bins, (count(c.bin) + 0.5::DOUBLE) / (max(b.seen) + 0.5::DOUBLE * s.bins) AS q
  FROM slots s JOIN base b USING (feature) LEFT JOIN cells c ON c.feature = s.feature AND c.bin = s.bin AND c.base GROUP BY s.feature, s.bin, s.bins),
wins AS (SELECT {name}, feature, count(*) AS n, count(bin) AS seen FROM cells GROUP BY {name}, feature),
counts AS (SELECT {name}, feature, bin, count(*) AS n FROM cells WHERE bin IS NOT NULL GROUP BY {name}, feature, bin),
psi AS (SELECT w.{name}, w.feature, sum(((coalesce(c.n, 0) + 0.5::DOUBLE) / (w.seen + 0.5::DOUBLE * q.bins) - q.q) * ln((coalesce(c.n, 0) + 0.5::DOUBLE) / (w.seen + 0.5::DOUBLE * q.bins) / q.q)) AS psi
  FROM wins w JOIN base_bins q USING (feature) LEFT JOIN counts c ON c.{name} = w.{name} AND c.feature = w.feature AND c.bin = q.bin GROUP BY w.{name}, w.feature)""",
        f"""SELECT {name}, w.feature, w.n::BIGINT AS n, round(CASE WHEN w.seen > 0 AND b.seen > 0 THEN psi END, 6) AS psi, round((w.n - w.seen)::DOUBLE / w.n, 6) AS missing_rate,
  round((w.n - w.seen)::DOUBLE / w.n - (b.n - b.seen)::DOUBLE / b.n, 6) AS missing_shift,
  CASE WHEN w.seen > 0 AND b.seen > 0 AND psi >= 0.25 THEN 'large' WHEN w.seen > 0 AND b.seen > 0 AND psi >= 0.1 THEN 'moderate' ELSE 'none' END AS drift
FROM wins w JOIN base b USING (feature) JOIN psi USING ({name}, feature)""")


def build() -> dict[str, str]:
    sql: dict[str, str] = {}
    sql["clean_applications"] = _with(APPS, f"SELECT {_CLEAN_APP_COLS} FROM apps")
    sql["latest_record"] = _with(APPS_LATEST, """SELECT application_id, application_date, final_decision, l_linenumber, l_partkey, l_suppkey FROM latest""")
    daily_cols = [f"round({c}, {MEAN_DIGITS}) AS {c}" for c in _DAILY_MEANS]
    sql["daily_metrics"] = _with(DAILY, f"""SELECT app_day, applications, approvals, frauds, approved_frauds, {", ".join(daily_cols)},
  approval_rate, application_fraud_rate, approved_fraud_rate FROM daily""")
    sql["product_metrics"] = _with(APPS, f"SELECT *, {_RATES} FROM (SELECT app_day, product, {_COUNTS} FROM apps WHERE product IS NOT NULL GROUP BY app_day, product)")
    sql["daily_and_product_metrics"] = _with(APPS, f"""SELECT *, {_RATES} FROM (
  SELECT app_day, NULL AS product, 1 AS is_total, {_COUNTS} FROM apps GROUP BY app_day
  UNION ALL SELECT app_day, product, 0, {_COUNTS} FROM apps WHERE product IS NOT NULL GROUP BY app_day, product)""")
    metrics = ["applications", "approvals", "frauds", "approval_rate", "application_fraud_rate", "approved_fraud_rate", "avg_credit_score", "avg_fraud_score"]
    inside = f"app_day BETWEEN DATE '{WINDOW[0]}' AND DATE '{WINDOW[1]}'"
    rows = _union([f"""SELECT '{m}' AS metric, avg({m}) FILTER (WHERE NOT ({inside})) AS b, avg({m}) FILTER (WHERE {inside}) AS a FROM daily""" for m in metrics])
    sql["anomaly_summary"] = _with(DAILY, f"SELECT metric, round(b, 6) AS baseline_mean, round(a, 6) AS anomaly_mean, round((a - b) / nullif(b, 0), 6) AS pct_change FROM ({rows})")

    sql["clean_merchants"] = _with(MERCHANTS, "SELECT *, year(open_date)::INT AS open_year, month(open_date)::INT AS open_month, (isodow(open_date) - 1)::INT AS open_day_of_week FROM merchants")
    sql["csv_landing"] = _with(MERCHANTS, "SELECT * EXCLUDE (open_date) FROM merchants")
    sql["json_landing"] = _with(MERCHANTS, f"SELECT id, {', '.join(ALL)} FROM merchants")

    def examples(value: str, where: str, source: str = "bad") -> str:
        return f"""(SELECT to_json(list(v ORDER BY v))::VARCHAR FROM (SELECT DISTINCT coalesce({value}::VARCHAR, '<MISSING>') AS v FROM {source} WHERE {where} ORDER BY v LIMIT 5))"""

    def rule(name: str, value: str, where: str, source: str = "bad") -> str:
        return f"SELECT '{name}' AS rule, count(*)::BIGINT AS n_bad, {examples(value, where, source)} AS examples FROM {source} WHERE {where} HAVING count(*) > 0"

    sql["binary_violations"] = _with(
        MERCHANTS + """, bad AS (SELECT CASE WHEN id LIKE '%3' THEN 'maybe' WHEN id LIKE '%4' THEN '0.5' WHEN id LIKE '%5' THEN id ELSE 'Y' END AS is_connected,
  CASE WHEN id LIKE '%9' THEN -1 ELSE is_fraud END AS is_fraud FROM merchants)""",
        _union([rule("is_connected", "is_connected", "is_connected <> 'Y'"), rule("is_fraud", "is_fraud", "is_fraud NOT IN (0, 1)")]))
    sql["decision_violations"] = _with(
        APPS_RAW + """, bad AS (SELECT CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 THEN 'PENDING ' || l_suppkey ELSE final_decision END AS final_decision FROM raw)""",
        rule("final_decision", "final_decision", "coalesce(final_decision, '') NOT IN ('APPROVED', 'DECLINED')"))
    def counted(source: str, name: str, value: str, where: str, table: str) -> str:
        # One example for each slot, which the first digit of the value's digest gives.
        slots = f"SELECT min({value}) AS v FROM {table} WHERE {where} GROUP BY ('0x' || substr(md5({value}), 1, 1))::INT % 5"
        return f"SELECT '{source}' AS source, '{name}' AS rule, count(*)::BIGINT AS n_bad, (SELECT string_agg(v, '|' ORDER BY v) FROM ({slots})) AS examples FROM {table} WHERE {where} HAVING count(*) > 0"

    sql["counted_rejections"] = _with(
        APPS_RAW + ", " + BAD_MERCHANTS + ", late AS (SELECT 'PENDING 2' AS d FROM raw WHERE l_linenumber = 2)", _union([
            counted("applications", "final_decision", "d", "true", "late"), counted("features", "identity_rank:not_numeric", "identity_rank", "identity_rank = '4d'", "bad"),
            counted("features", "identity_rank:not_finite", "identity_rank", "identity_rank = 'inf'", "bad"), counted("features", "is_valid:not_numeric", "is_valid", "is_valid = 'maybe'", "bad"),
            counted("features", "is_valid:not_binary", "is_valid", "is_valid = '2'", "bad")]))
    sql["scoring_schema_violations"] = _with(BAD_MERCHANTS, _union([
        rule("identity_rank:not_numeric", "identity_rank", "identity_rank = '4d'"),
        rule("identity_rank:not_finite", "identity_rank", "identity_rank = 'inf'"),
        rule("is_valid:not_numeric", "is_valid", "is_valid = 'maybe'"), rule("is_valid:not_binary", "is_valid", "is_valid = '2'")]))
    sql["stream_score_quarantine"] = _with(BAD_MERCHANTS, """SELECT quarantined, count(*)::BIGINT AS n, count(*)::BIGINT AS sound
  FROM (SELECT coalesce(identity_rank IN ('4d', 'inf'), false) OR coalesce(is_valid IN ('maybe', '2'), false) AS quarantined FROM bad) GROUP BY quarantined""")
    sql["id_violations"] = _with(BAD_MERCHANTS, """SELECT count(*) FILTER (WHERE id IS NULL)::BIGINT AS n_missing,
  count(*) FILTER (WHERE trim(id) = '' OR lower(trim(id)) = 'null')::BIGINT AS n_blank,
  count(*) FILTER (WHERE id = 'order-twin')::BIGINT AS n_duplicate FROM bad""")
    sql["domain_violations"] = _with(
        SCORED + """, bad AS (SELECT CASE WHEN id LIKE '%1' THEN 1.5::DOUBLE WHEN id LIKE '%2' THEN NULL ELSE score END AS score,
  CASE WHEN id LIKE '%3' THEN 2 ELSE is_fraud END AS is_fraud, CASE WHEN id LIKE '%4' THEN 'bogus' ELSE 'approve' END AS decision FROM scored)""",
        _union([
            rule("score:probability", "score", "score IS NULL OR score > 1"), rule("is_fraud:label", "is_fraud", "is_fraud NOT IN (0, 1)"),
            rule("decision:choice", "decision", "decision = 'bogus'")]))

    sql["stratified_split"] = _with(PARTS, "SELECT id, is_fraud, split FROM parts")
    sql["split_audit"] = _with(PARTS, """SELECT split, count(*)::BIGINT AS n, sum(is_fraud)::BIGINT AS fraud, (count(*) - sum(is_fraud))::BIGINT AS non_fraud,
  sum(is_fraud)::DOUBLE / count(*) AS fraud_rate FROM parts GROUP BY split""")
    sql["holdout_split"] = _with(MERCHANTS + f""",
r AS (SELECT id, is_fraud, row_number() OVER (PARTITION BY is_fraud ORDER BY sha256('42:' || id)) AS rk FROM merchants),
a AS (SELECT count(*) FILTER (WHERE is_fraud = 0) AS n0, count(*) FILTER (WHERE is_fraud = 1) AS n1 FROM merchants),
b AS (SELECT *, n0 + n1 - ceil((n0 + n1) * 0.2::DOUBLE)::BIGINT AS kept FROM a),
c AS (SELECT *, {_seats("kept", "n0", "n1")} AS t0 FROM b)""",
        "SELECT id, is_fraud, CASE WHEN rk <= CASE is_fraud WHEN 0 THEN t0 ELSE kept - t0 END THEN 'train' ELSE 'test' END AS split FROM r, c")
    sql["kfold_assignment"] = _with(TRAIN + """,
r AS (SELECT id, is_fraud, row_number() OVER (PARTITION BY is_fraud ORDER BY sha256('fold42:' || id)) AS rk FROM train),
dealt AS (SELECT is_fraud, ((row_number() OVER (ORDER BY is_fraud) - 1) % 5)::INT AS fold FROM train),
sizes AS (SELECT is_fraud, fold, sum(count(*)) OVER (PARTITION BY is_fraud ORDER BY fold) AS upto, count(*) AS n FROM dealt GROUP BY is_fraud, fold)""",
        "SELECT r.id, r.is_fraud, sizes.fold FROM r JOIN sizes ON r.is_fraud = sizes.is_fraud AND rk <= upto AND rk > upto - sizes.n")
    sql["split_overlap_check"] = _with(PARTS + """, moved AS (
  SELECT id, split FROM parts UNION ALL SELECT id, 'test' FROM parts WHERE id LIKE '%77' UNION ALL SELECT id, NULL FROM (SELECT id || 'x' AS id FROM parts WHERE id LIKE '%78')),
flags AS (SELECT id, max((split = 'train')::INT) AS a, max((split = 'validation')::INT) AS b, max((split = 'test')::INT) AS c FROM moved GROUP BY id)""",
        """SELECT count(*)::BIGINT AS n_ids, count(*) FILTER (WHERE a = 1 AND b = 1)::BIGINT AS train_and_validation, count(*) FILTER (WHERE a = 1 AND c = 1)::BIGINT AS train_and_test,
  count(*) FILTER (WHERE b = 1 AND c = 1)::BIGINT AS validation_and_test, count(*) FILTER (WHERE coalesce(a + b + c, 0) = 0)::BIGINT AS n_unassigned FROM flags""")
    sql["label_alignment_check"] = _with(MERCHANTS + """,
f AS (SELECT id FROM merchants WHERE id NOT LIKE '%21'),
l AS (SELECT id FROM merchants WHERE id NOT LIKE '%22' UNION ALL SELECT id FROM merchants WHERE id LIKE '%23'),
c AS (SELECT id, sum(f) AS f, sum(l) AS l FROM (SELECT id, 1 AS f, 0 AS l FROM f UNION ALL SELECT id, 0, 1 FROM l) GROUP BY id)""",
        """SELECT count(*) FILTER (WHERE l = 0)::BIGINT AS only_features, count(*) FILTER (WHERE f = 0)::BIGINT AS only_labels, count(*) FILTER (WHERE f > 1)::BIGINT AS repeated_features,
  count(*) FILTER (WHERE l > 1)::BIGINT AS repeated_labels, count(*) FILTER (WHERE f = 1 AND l = 1)::BIGINT AS matched FROM c""")
    sql["attached_labels"] = _with(MERCHANTS, "SELECT id, ea_score, is_fraud FROM merchants")
    sql["membership_fingerprints"] = _with(PARTS + ", h AS (SELECT split AS part, sha256(id) AS h FROM parts UNION ALL SELECT 'dataset', sha256(id) FROM parts)",
        f"SELECT part, count(*)::BIGINT AS n, {_DIGEST} AS fingerprint FROM h GROUP BY part")
    sql["manifest_check"] = _with(PARTS + ", h AS (SELECT sha256(id) AS h FROM parts WHERE split <> 'test')",
        f"SELECT count(*)::BIGINT AS verified_row_count, {_DIGEST} AS verified_membership FROM h")
    sql["artifact_check"] = f"SELECT 'riskweir_gbt_encoded_v1' AS model_identifier, verified_row_count, verified_membership, {len(ALL)} AS n_features FROM ({sql['manifest_check']})"
    sql["manifest_difference"] = _with(PARTS + ", a AS (SELECT id FROM parts WHERE split <> 'test')", """SELECT (SELECT count(*) FROM a WHERE id NOT LIKE '%21') + (SELECT count(*) FROM parts WHERE id LIKE '%22') AS n_found,
  (SELECT count(*) FROM a)::BIGINT AS n_approved, (SELECT count(*) FROM parts WHERE id LIKE '%22')::BIGINT AS not_approved, (SELECT count(*) FROM a WHERE id LIKE '%21')::BIGINT AS absent""")
    sql["membership_difference"] = _with(PARTS, "SELECT id, 0::BIGINT AS n_found, 1::BIGINT AS n_approved FROM parts WHERE split <> 'test' AND id LIKE '%21' "
                                                "UNION ALL SELECT id || 'x', 1, 0 FROM parts WHERE id LIKE '%22'")
    sql["heldout_quarantine"] = _with(PARTS, f"SELECT id, is_fraud, split, {', '.join(ALL)} FROM parts WHERE split <> 'test'")
    sql["membership_selection"] = _with(PARTS, f"SELECT id, is_fraud, {', '.join(ALL)} FROM parts WHERE split = 'validation'")
    sql["development_rows"] = _with(PARTS, "SELECT id, is_fraud, split FROM parts WHERE split IN ('train', 'validation')")
    kinds = {**dict.fromkeys(CONT, "double"), **dict.fromkeys(CATEGORICAL, "string")}
    sql["representation_audit"] = _with(PARTS, _union([
        f"SELECT split, '{f}' AS feature, {i} AS position, '{kinds[f]}' AS data_type, count(*)::BIGINT AS n_rows, (count(*) - count({f}))::BIGINT AS n_missing FROM parts WHERE split <> 'test' GROUP BY split"
        for i, f in enumerate(ALL)]))
    sql["hash_sample"] = _with(PARTS, "SELECT id, is_fraud FROM parts WHERE split = 'validation' ORDER BY sha256('sample42:' || id) LIMIT 500")

    sql["train_fill_values"] = _with(FILLS, """SELECT feature, fill AS number, NULL::VARCHAR AS text FROM num_fill UNION ALL SELECT feature, NULL, fill FROM text_fill""")
    sql["onehot_fill_values"] = _with(FILLS + f", bool_cells AS ({_cells('train', list(BOOLEAN), 'DOUBLE')}), bool_fill AS ({_MODE.format(cells='bool_cells')})",
        f"""SELECT feature, fill AS number, NULL::VARCHAR AS text FROM num_fill WHERE feature IN ({', '.join(repr(f) for f in NUMERIC)})
UNION ALL SELECT feature, fill::DOUBLE, NULL FROM bool_fill UNION ALL SELECT feature, NULL, fill FROM text_fill""")
    sql["imputed_merchants"] = _with(FILLS, f"SELECT id, split, {', '.join(_fill(f) for f in ALL)} FROM parts")

    miss = _union([f"SELECT '{f}' AS feature, (count(*) - count({f}))::BIGINT AS missing_count, (count(*) - count({f}))::DOUBLE / count(*) AS missing_rate FROM train" for f in ALL])
    sql["missing_rates"] = _with(TRAIN, f"SELECT *, missing_rate BETWEEN 0.01 AND 0.95 AS indicator FROM ({miss})")
    sql["missing_indicators"] = _with(TRAIN, "SELECT id, " + ", ".join(
        f"({f} IS NULL)::INT::DOUBLE AS {f}_missing" for f in ("ea_score", "identity_rank", "is_connected", "receiving_mail", "device_browser_type")) +
        ", (" + " + ".join(f"({f} IS NULL)::INT" for f in VENDOR) + ")::DOUBLE AS vendor_missing_count FROM parts")
    sql["missingness_analysis"] = _with(TRAIN, "SELECT *, fraud_rate_when_missing - fraud_rate_when_present AS fraud_rate_difference FROM (" + _union([
        f"""SELECT '{f}' AS feature, (count(*) - count({f}))::BIGINT AS missing_count, (count(*) - count({f}))::DOUBLE / count(*) AS missing_rate,
  sum(is_fraud) FILTER (WHERE {f} IS NULL)::DOUBLE / (count(*) - count({f})) AS fraud_rate_when_missing, sum(is_fraud) FILTER (WHERE {f} IS NOT NULL)::DOUBLE / count({f}) AS fraud_rate_when_present
  FROM train HAVING count({f}) < count(*) AND count({f}) > 0""" for f in ALL]) + ")")
    kind_of = {**dict.fromkeys(NUMERIC, "numeric"), **dict.fromkeys(BOOLEAN, "boolean"), **dict.fromkeys(CATEGORICAL, "categorical")}
    audit = _union([f"""SELECT '{f}' AS feature, '{kind_of[f]}' AS feature_type, '{'vendor' if f in VENDOR else 'in_house'}' AS source, true AS allowed_primary_benchmark,
  (count(*) - count({f}))::BIGINT AS missing_count, (count(*) - count({f}))::DOUBLE / count(*) AS missing_rate, count(DISTINCT {f})::BIGINT AS unique_count,
  {f'count(DISTINCT {f})::BIGINT' if f not in NUMERIC else 'NULL::BIGINT'} AS cardinality,
  count(DISTINCT {f}) + (count({f}) < count(*))::INT <= 1 AS constant,
  (SELECT max(c) FROM (SELECT count(*) AS c FROM train GROUP BY {f}))::DOUBLE / count(*) >= 0.99 AS near_constant,
  coalesce(count(DISTINCT {f})::DOUBLE / nullif(count({f}), 0) >= 0.98, false) AS suspicious_id_like FROM train""" for f in ALL])
    sql["feature_audit_common"] = _with(TRAIN, f"SELECT *, CASE WHEN suspicious_id_like THEN '{REVIEW_NOTE}' ELSE '' END AS review_note FROM ({audit})")
    sql["feature_audit_numeric"] = _with(TRAIN + f", c AS ({_cells('train', list(NUMERIC), 'DOUBLE')})", """SELECT feature, round(avg(value), 6) AS mean, round(median(value), 6) AS median,
  round(stddev_samp(value), 6) AS std, round(quantile_cont(value, 0.05), 6) AS q05, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75, round(quantile_cont(value, 0.95), 6) AS q95,
  round(avg(value) FILTER (WHERE is_fraud = 1), 6) AS fraud_mean, round(median(value) FILTER (WHERE is_fraud = 1), 6) AS fraud_median,
  round(avg(value) FILTER (WHERE is_fraud = 0), 6) AS non_fraud_mean, round(median(value) FILTER (WHERE is_fraud = 0), 6) AS non_fraud_median FROM c GROUP BY feature""")
    value_cells = _cells("train", list(BOOLEAN), "INT::VARCHAR || '.0'") + "\nUNION ALL\n" + _cells("train", list(CATEGORICAL), "VARCHAR")
    sql["feature_audit_values"] = _with(TRAIN + f", c AS ({value_cells})", f"""SELECT feature, coalesce(value, '{MISSING}') AS value, count(*)::BIGINT AS n, sum(is_fraud)::DOUBLE / count(*) AS fraud_rate,
  count(*) < greatest(5, ceil((SELECT count(*) FROM train) * 0.01::DOUBLE)) AS rare FROM c GROUP BY feature, value""")
    sql["feature_audit_rare"] = _with(TRAIN + f", c AS ({value_cells}), v AS (SELECT feature, count(*) AS n FROM c GROUP BY feature, value)", """SELECT feature,
  coalesce(sum(n) FILTER (WHERE n < greatest(5, ceil((SELECT count(*) FROM train) * 0.01::DOUBLE))), 0)::BIGINT AS rare_category_rows, count(*)::BIGINT AS n_values FROM v GROUP BY feature""")

    sql["feature_audit"] = f"SELECT * FROM ({sql['feature_audit_common']}) LEFT JOIN ({sql['feature_audit_numeric']}) USING (feature) LEFT JOIN ({sql['feature_audit_rare']}) USING (feature)"

    groups = "model, feature_configuration, split"
    met = SCORED + "," + metric_ctes(groups)
    sql["probability_metrics"] = _with(met, "SELECT * FROM met")
    sql["average_precision"] = _with(met, f"SELECT {groups}, pr_auc FROM met")
    sql["roc_auc"] = _with(met, f"SELECT {groups}, roc_auc FROM met")
    sql["threshold_metrics"] = _with(met, f"""SELECT {groups}, accuracy, balanced_accuracy, "precision", recall, f1 FROM met""")
    sql["fold_summary"] = _with(SCORED + """,
fr AS (SELECT id, row_number() OVER (PARTITION BY is_fraud ORDER BY sha256('fold42:' || id)) AS rk, is_fraud FROM parts),
dealt AS (SELECT is_fraud, ((row_number() OVER (ORDER BY is_fraud) - 1) % 5)::INT AS fold FROM parts),
sizes AS (SELECT is_fraud, fold, sum(count(*)) OVER (PARTITION BY is_fraud ORDER BY fold) AS upto, count(*) AS n FROM dealt GROUP BY is_fraud, fold),
folds AS (SELECT fr.id, sizes.fold FROM fr JOIN sizes ON fr.is_fraud = sizes.is_fraud AND rk <= upto AND rk > upto - sizes.n),
fs AS (SELECT scored.*, fold FROM scored JOIN folds ON scored.id = folds.id),""" + metric_ctes("model, feature_configuration, fold", "fs"),
        "SELECT model, feature_configuration, round(avg(pr_auc), 8) AS mean_pr_auc, round(stddev_pop(pr_auc), 8) AS std_pr_auc FROM met GROUP BY model, feature_configuration")

    sql["three_way_decision"] = _with(SCORED, f"SELECT id, model, feature_configuration, {_DECIDE} AS decision FROM scored")
    sql["decision_policy"] = _with(SCORED, """SELECT id, model, feature_configuration, CASE WHEN score >= 0.7 THEN 'decline' WHEN score >= 0.3 THEN 'manual_review' ELSE 'approve' END AS decision,
  'explicit caller-supplied thresholds' AS decision_policy FROM scored""")
    sql["profit_summary"] = _with(SCORED, _PROFIT.format(by="model, feature_configuration", decide=_DECIDE))

    sql["best_model"] = _with(MET + """, r AS (SELECT model, max(pr_auc) FILTER (WHERE split = 'validation') AS validation_pr_auc, max(pr_auc) FILTER (WHERE split = 'test') AS test_pr_auc
  FROM met WHERE feature_configuration = 'value' GROUP BY model)""",
        "SELECT *, row_number() OVER (ORDER BY validation_pr_auc DESC, model) = 1 AS selected FROM r")
    sql["config_choice"] = _with(VAL + """, m AS (SELECT feature_configuration, round(avg(validation_pr_auc), 9) AS mean_validation_pr_auc, min(n_features) AS n_features FROM val GROUP BY feature_configuration)""",
        "SELECT * FROM m WHERE mean_validation_pr_auc >= (SELECT max(mean_validation_pr_auc) FROM m) - 0.05 ORDER BY n_features, mean_validation_pr_auc DESC, feature_configuration LIMIT 1")
    sql["ablation_delta"] = _with(VAL, """SELECT *, round(validation_pr_auc - max(validation_pr_auc) FILTER (WHERE feature_configuration = 'value') OVER (PARTITION BY model), 9) AS validation_pr_auc_delta FROM val""")
    label = "CASE WHEN {d} < 0 THEN 'negative' WHEN {d} < 0.001 THEN 'negligible' WHEN {d} < 0.005 THEN 'marginal' ELSE 'meaningful' END"
    sql["improvement_label"] = _with(VAL + """, d AS (SELECT model, feature_configuration, round(validation_pr_auc - lag(validation_pr_auc, 1, validation_pr_auc) OVER (PARTITION BY model ORDER BY n_features), 9) AS delta FROM val)""",
        f"SELECT *, {label.format(d='delta')} AS improvement_assessment FROM d")
    sql["freeze_choice"] = _with(VAL + """, p AS (SELECT model, max(validation_pr_auc) FILTER (WHERE feature_configuration = 'quantity') AS default_pr_auc,
  max(validation_pr_auc) FILTER (WHERE feature_configuration = 'lines') AS tuned_pr_auc FROM val GROUP BY model), d AS (SELECT *, round(tuned_pr_auc - default_pr_auc, 9) AS delta FROM p)""",
        f"""SELECT model, default_pr_auc, tuned_pr_auc, CASE WHEN delta > 0 THEN 'tuned' ELSE 'default' END AS selected_configuration, greatest(default_pr_auc, tuned_pr_auc) AS validation_pr_auc,
  delta AS validation_pr_auc_delta, {label.format(d='delta')} AS improvement_assessment FROM d""")
    sql["running_best"] = _with(MET, """SELECT model, trial_number, pr_auc AS cv_mean_pr_auc, max(pr_auc) OVER (PARTITION BY model ORDER BY trial_number ROWS UNBOUNDED PRECEDING) AS best_so_far
  FROM (SELECT model, (row_number() OVER (PARTITION BY model ORDER BY feature_configuration DESC, split) - 1)::BIGINT AS trial_number, pr_auc FROM met)""")
    sql["importance_rank"] = _with(IMPORTANCE, "SELECT *, row_number() OVER (PARTITION BY model ORDER BY importance DESC, feature)::BIGINT AS rank FROM imp")
    sql["topk_features"] = _with(IMPORTANCE, "SELECT feature, round(avg(importance), 9) AS importance FROM imp GROUP BY feature ORDER BY importance DESC, feature LIMIT 2")
    sql["attribution_by_source"] = _with(SCORED + """, v AS (SELECT model, CASE WHEN feature_configuration = 'value' THEN 'onehot__value_x' ELSE 'onehot__volume_' || feature_configuration END AS col,
  score - 0.5 AS value FROM scored)""", """SELECT model, feature, round(sum(m), 9) AS mean_abs FROM (SELECT model, CASE WHEN col LIKE '%value%' THEN 'value' ELSE 'volume' END AS feature, avg(abs(value)) AS m
  FROM v GROUP BY model, col, feature) GROUP BY model, feature""")
    tests = ["pr_auc", "roc_auc", "precision", "recall", "f1", "balanced_accuracy", "accuracy"]
    pick = ", ".join(f't."{c}" AS test_{c}' for c in tests)
    sql["family_comparison"] = _with(MET + """,
pairs AS (SELECT 'model_a' AS model, 'lines' AS feature_configuration, 'tuned' AS fam UNION ALL SELECT 'model_b', 'lines', 'tuned' UNION ALL SELECT 'model_a', 'quantity', 'default' UNION ALL SELECT 'model_b', 'quantity', 'default')""",
        f"""SELECT p.fam || '_' || p.model AS model, v.pr_auc AS validation_pr_auc, v.roc_auc AS validation_roc_auc, {pick}, fam AS model_family_type, round(v.pr_auc - t.pr_auc, 9) AS validation_minus_test_pr_auc
FROM pairs p JOIN met v ON v.model = p.model AND v.feature_configuration = p.feature_configuration AND v.split = 'validation'
JOIN met t ON t.model = p.model AND t.feature_configuration = p.feature_configuration AND t.split = 'test'""")

    parts_cols = f"id, is_fraud, {', '.join(ALL)}, split"
    sql["staged_development"] = _with(PARTS, f"SELECT {parts_cols} FROM parts WHERE split <> 'test'")
    sql["staged_test"] = _with(PARTS, f"SELECT {parts_cols} FROM parts")

    bool_fill = f"bool_cells AS ({_cells('train', list(BOOLEAN), 'DOUBLE')}), bool_fill AS ({_MODE.format(cells='bool_cells')})"
    numbers = " + ".join(_fill(f).rsplit(" AS ", 1)[0] for f in NUMERIC)
    modes = " + ".join(f"coalesce({f}, (SELECT fill::DOUBLE FROM bool_fill WHERE feature = '{f}'))" for f in BOOLEAN)
    booleans = " + ".join(_fill(f).rsplit(" AS ", 1)[0] for f in BOOLEAN)
    known = " + ".join(f"(coalesce({f}, '') IN (SELECT value FROM text_cells WHERE feature = '{f}') OR {f} IS NULL)::INT" for f in CATEGORICAL)
    width = f"({len(CONT)} + (SELECT count(DISTINCT (feature, value)) FROM text_cells WHERE value IS NOT NULL))::INT"
    sql["onehot_features"] = _with(FILLS + ", " + bool_fill, f"SELECT id, split, {width} AS width, round({numbers} + {modes} + {known}, 4) AS total FROM parts")
    filled = _union([f"SELECT '{f}' AS feature, {_fill(f).rsplit(' AS ', 1)[0]} AS value, is_fraud FROM train" for f in CATEGORICAL])
    rates = f"""filled AS ({filled}), rates AS (SELECT feature, value, count(*)::DOUBLE / (count(*) + 1.0::DOUBLE) * avg(is_fraud)
  + (1 - count(*)::DOUBLE / (count(*) + 1.0::DOUBLE)) * (SELECT avg(is_fraud) FROM train) AS rate FROM filled GROUP BY feature, value)"""
    rate = " + ".join(
        f"coalesce((SELECT rate FROM rates r WHERE r.feature = '{f}' AND r.value = {_fill(f).rsplit(' AS ', 1)[0].replace(f'coalesce({f}', f'coalesce(parts.{f}')}), (SELECT avg(is_fraud) FROM train))"
        for f in CATEGORICAL)
    sql["encoded_features"] = _with(FILLS + ", " + rates, f"SELECT id, split, {len(ALL)} AS width, round({numbers} + {booleans} + {rate}, 4) AS total FROM parts")

    sql["drift_metrics"] = _drift(
        APPS, "apps", "app_day < DATE '1996-07-01'", "date_trunc('month', app_day)::DATE", "month",
        ("credit_score", "fraud_score", "date_gap_days"), ("product", "industry", "state"), 10, 5)
    sql["stream_drift"] = _drift(
        "seen AS (SELECT * FROM events)", "seen", "ts < TIMESTAMP '2024-01-11'", "DATE '1970-01-01' + (epoch_us(ts) // 604800000000 * 7)::INT", "week", ("value",), ("event_type",), 5, 4)
    sql["stream_daily_metrics"] = """SELECT ts::DATE AS day, count(*)::BIGINT AS n, count(*) FILTER (WHERE event_type = 'error')::BIGINT AS errors,
  sum(round(value * 100)::BIGINT)::BIGINT AS cents, count(*) FILTER (WHERE event_type = 'error')::DOUBLE / count(*) AS error_rate FROM events GROUP BY ts::DATE"""
    sql["stream_latest"] = "SELECT user_id, ts, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"
    sql["stream_upsert"] = sql["stream_latest"]
    sql["stream_clean_quarantine"] = _with(APPS_RAW, """SELECT (l_linenumber = 2) AS quarantined, count(*)::BIGINT AS n, count(DISTINCT application_id)::BIGINT AS n_ids,
  count(*) FILTER (WHERE final_decision = 'APPROVED' AND l_linenumber <> 2)::BIGINT AS approved FROM raw GROUP BY 1""")
    sql["stream_application_metrics"] = _with(APPS, f"SELECT app_day, {_COUNTS} FROM apps GROUP BY app_day")
    return sql
