"""Equivalent DuckDB SQL for the registered queries, written independently of the operators.

Where the operator uses prefix differences, grouping sets or histograms, the SQL uses the plain definition.
"""

from __future__ import annotations

DT = "CAST(floor(epoch(ts - TIMESTAMP '2024-01-01 00:00:00')) AS BIGINT)"

TXN = f"""txn AS (
SELECT event_id AS TransactionID, {DT} AS TransactionDT, value AS TransactionAmt, event_type AS ProductCD,
  user_id AS card1,
  CASE WHEN event_id % 11 = 0 THEN NULL
       ELSE 100 + (user_id * 7 + CASE WHEN event_id % 5 = 0 THEN event_id % 3 ELSE 0 END) % 40 END AS addr1,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE user_id % 4 END AS addr2,
  CASE user_id % 6 WHEN 0 THEN 'gmail.com' WHEN 1 THEN 'yahoo.co.uk' WHEN 2 THEN 'Hotmail.com'
                   WHEN 3 THEN 'corp.example' WHEN 4 THEN 'mail.example' ELSE NULL END AS P_emaildomain,
  CASE event_id % 5 WHEN 0 THEN 'gmail.com' WHEN 1 THEN 'Yahoo.com' WHEN 2 THEN 'hotmail.com'
                    WHEN 3 THEN 'corp.example' ELSE NULL END AS R_emaildomain,
  CAST(CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN 1 ELSE 0 END AS INT) AS isFraud
FROM events)"""

IDENTITY = """identity AS (
SELECT event_id AS TransactionID, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS id_01,
  CASE WHEN event_id % 8 = 0 THEN value END AS id_02,
  CASE event_id % 3 WHEN 0 THEN 'mobile' WHEN 1 THEN 'desktop' END AS DeviceType,
  CASE WHEN event_id % 16 = 0 THEN event_type END AS DeviceInfo
FROM events WHERE event_id % 4 = 0)"""

MERGED = f"""{TXN}, {IDENTITY}, merged AS (
SELECT txn.*, id_01, id_02, DeviceType, DeviceInfo FROM txn LEFT JOIN identity USING (TransactionID))"""

ORDERS = """txn_orders AS (
SELECT o_orderkey AS TransactionID,
  CAST(floor(epoch(o_orderdate - TIMESTAMP '1995-01-01 00:00:00')) AS BIGINT) AS TransactionDT,
  o_totalprice AS TransactionAmt, o_custkey AS card1, c_nationkey AS addr1, n_regionkey AS addr2,
  CAST(CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS INT) AS isFraud
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

LINEITEM = """txn_lineitem AS (
SELECT l_orderkey * 10 + l_linenumber AS TransactionID,
  CAST(floor(epoch(l_shipdate - TIMESTAMP '1995-01-01 00:00:00')) AS BIGINT) AS TransactionDT,
  l_extendedprice AS TransactionAmt, l_suppkey AS card1, l_returnflag AS addr1, l_linestatus AS addr2
FROM lineitem)"""

SCORED = f"""{TXN}, scored AS (
SELECT TransactionID, TransactionDT, TransactionAmt, isFraud AS y,
  CAST((TransactionID * 7919) % 700 + 300 * isFraud AS DOUBLE) / 1000 AS score_a,
  CAST(100 + (TransactionID * 104729) % 500 AS DOUBLE) / 1000 AS score_b,
  CAST((TransactionID * 1299709) % 997 + 200 * isFraud AS DOUBLE) / 10000 AS hdi_width,
  CAST((TransactionID * 1299709) % 997 + 200 * isFraud AS DOUBLE) / 10000 / 4 AS std
FROM txn)"""


def r(expr: str, name: str, digits: int = 9) -> str:
    return f"round({expr}, {digits}) AS {name}"


def tagged(source: str, name: str = "tagged") -> str:
    return f"""{name} AS (
SELECT *, CASE WHEN rn <= CAST(floor(n * 0.6::DOUBLE) AS BIGINT) THEN 'train'
               WHEN rn <= CAST(floor(n * (0.6::DOUBLE + 0.2::DOUBLE)) AS BIGINT) THEN 'val' ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (ORDER BY TransactionDT, TransactionID) AS rn, count(*) OVER () AS n FROM {source}))"""


TRAIN = f"{TXN}, {tagged('txn')}, train AS (SELECT * EXCLUDE (split, rn, n) FROM tagged WHERE split = 'train')"
TRAIN_MERGED = (
    f"{MERGED}, {tagged('merged')}, train AS (SELECT * EXCLUDE (split, rn, n) FROM tagged WHERE split = 'train')"
)

WINDOWS = {"1h": 3600, "24h": 86400, "7d": 604800}
ENTITIES = ["card1", "addr1", "P_emaildomain"]


def velocity(entities: list[str], source: str, stats=("count", "sum", "mean_amt"), extra: str = "", within: str = "",
             where: str = "") -> str:
    """Plain sliding range frames. Sums of cents are rounded to cents, so means are equal without rounding."""
    cols, frames = [], []
    for e in entities:
        for label, width in WINDOWS.items():
            w = f"w_{e}_{label}"
            frames.append(
                f"{w} AS (PARTITION BY {within}{e} ORDER BY TransactionDT "
                f"RANGE BETWEEN {width} PRECEDING AND 1 PRECEDING)"
            )
            count = f"count(TransactionAmt) OVER {w}"
            total = f"round(coalesce(sum(TransactionAmt) OVER {w}, 0), 2)"
            made = {
                "count": count,
                "sum": total,
                "mean_amt": f"CASE WHEN {count} > 0 THEN {total} / {count} ELSE 0.0 END",
            }
            cols += [f"{made[s]} AS vel_{e}_{label}_{s}" for s in stats]
    return f"SELECT TransactionID, {extra}{', '.join(cols)} FROM {source} {where} WINDOW {', '.join(frames)}"


RANKED = f"""{SCORED}, long AS (
SELECT 'trees' AS model, score_a AS score, y FROM scored UNION ALL SELECT 'bayes', score_b, y FROM scored),
g AS (SELECT model, score, CAST(sum(y) AS BIGINT) AS p, count(*) AS n FROM long GROUP BY model, score),
ranked AS (SELECT *, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS k,
  CAST(sum(p) OVER (PARTITION BY model) AS BIGINT) AS pos, CAST(sum(n) OVER (PARTITION BY model) AS BIGINT) AS total
FROM g WINDOW w AS (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
f1s AS (SELECT *, tp / k AS prec, tp / pos AS rec,
  2 * (tp / k) * (tp / pos) / greatest(tp / k + tp / pos, 1e-9) AS f1 FROM ranked),
best AS (SELECT model, score AS thr, f1, prec, rec FROM (
  SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, score) AS rn FROM f1s) WHERE rn = 1)"""

FN = f"""{RANKED}, fn AS (
SELECT *, (y = 1 AND score_a < (SELECT thr FROM best WHERE model = 'trees')) AS missed FROM scored),
cuts AS (SELECT unnest([0.5, 0.6, 0.7, 0.75, 0.8, 0.9])::DOUBLE AS pct,
  unnest(quantile_cont(hdi_width, [0.5, 0.6, 0.7, 0.75, 0.8, 0.9])) AS thr FROM scored),
queues AS (SELECT pct AS uncertainty_percentile, thr AS hdi_width_threshold,
  CAST(count(*) FILTER (hdi_width >= thr) AS BIGINT) AS review_queue_size,
  100.0 * count(*) FILTER (hdi_width >= thr) / count(*) AS review_queue_pct_all,
  count(*) FILTER (hdi_width >= thr AND missed) AS fn_caught_in_queue,
  100.0 * count(*) FILTER (hdi_width >= thr AND missed) / greatest(count(*) FILTER (missed), 1) AS fn_recovery_pct,
  count(*) FILTER (hdi_width >= thr AND y = 1) AS fraud_in_queue,
  100.0 * count(*) FILTER (hdi_width >= thr AND y = 1) / greatest(count(*) FILTER (hdi_width >= thr), 1)
    AS queue_precision_pct
FROM fn CROSS JOIN cuts GROUP BY pct, thr)"""

BUCKETS = f"""{TXN}, span AS (SELECT min(TransactionDT) AS lo, max(TransactionDT) AS hi FROM txn),
binned AS (SELECT greatest(CAST(ceil(((TransactionDT - lo) * 500) / (hi - lo)) AS INT) - 1, 0) AS bin,
  TransactionDT AS t, isFraud AS y FROM txn, span),
buckets AS (SELECT bin, avg(y) AS fraud_rate, count(*) AS count, median(t) AS dt_mid FROM binned GROUP BY bin)"""

AMOUNT_FIT = "\n".join(
    [TRAIN]
    + [
        f""", enc_{e} AS (SELECT {e} AS ek_{e}, count(TransactionAmt) AS n_{e}, avg(TransactionAmt) AS mean_{e},
  coalesce(stddev_samp(TransactionAmt), 0) AS std_{e} FROM train WHERE {e} IS NOT NULL GROUP BY {e})"""
        for e in ENTITIES
    ]
    + [", overall AS (SELECT avg(TransactionAmt) AS gm, stddev_samp(TransactionAmt) AS gs FROM train)"]
)

ADDRESS_FIT = """, cnt1 AS (SELECT card1, addr1 AS v, count(*) AS n FROM train GROUP BY 1, 2),
cnt2 AS (SELECT card1, addr2 AS v, count(*) AS n FROM train GROUP BY 1, 2),
mode1 AS (SELECT card1, v FROM (SELECT *, row_number() OVER (PARTITION BY card1 ORDER BY n DESC, v) AS r
  FROM cnt1 WHERE v IS NOT NULL) WHERE r = 1),
mode2 AS (SELECT card1, v FROM (SELECT *, row_number() OVER (PARTITION BY card1 ORDER BY n DESC, v) AS r
  FROM cnt2 WHERE v IS NOT NULL) WHERE r = 1),
addr AS (SELECT t.card1 AS ac, count(*) AS an, mode1.v AS m1, count(DISTINCT addr1) AS u1, mode2.v AS m2,
  count(DISTINCT addr2) AS u2
FROM train t LEFT JOIN mode1 ON t.card1 = mode1.card1 LEFT JOIN mode2 ON t.card1 = mode2.card1
WHERE t.card1 IS NOT NULL GROUP BY t.card1, mode1.v, mode2.v)"""

ADDRESS_COLS = """CAST(coalesce(addr1 = m1, false) AS INT) AS card1_addr1_is_mode,
  CAST(coalesce(addr2 = m2, false) AS INT) AS card1_addr2_is_mode,
  CAST(coalesce(u1, 1) AS INT) AS card1_addr1_n_unique, CAST(coalesce(u2, 1) AS INT) AS card1_addr2_n_unique"""


def spike_columns(digits: int = 6) -> dict[str, str]:
    out = {}
    for e in ENTITIES:
        mean, std = f"coalesce(mean_{e}, gm)", f"coalesce(std_{e}, gs)"
        out[f"amt_to_{e}_mean_ratio"] = f"round(TransactionAmt / greatest({mean}, 1e-6), {digits})"
        out[f"amt_zscore_{e}"] = (
            f"round(greatest(-5.0, least(5.0, (TransactionAmt - {mean}) / greatest({std}, 1e-6))), {digits})"
        )
    return out


SPIKE_JOINS = " ".join(f"LEFT JOIN enc_{e} ON {e} = ek_{e}" for e in ENTITIES) + " CROSS JOIN overall"


def spike(names: list[str]) -> str:
    cols = ", ".join(f"{v} AS {k}" for k, v in spike_columns().items() if k in names)
    return f"WITH {AMOUNT_FIT} SELECT TransactionID, {cols} FROM txn {SPIKE_JOINS}"


TEMPORAL = {
    "hour_of_day": "(TransactionDT // 3600) % 24",
    "day_of_week": "(TransactionDT // 86400) % 7",
    "day_of_dataset": "TransactionDT // 86400",
    "is_night": "CASE WHEN (TransactionDT // 3600) % 24 <= 5 THEN 1 ELSE 0 END",
    "is_weekend": "CASE WHEN (TransactionDT // 86400) % 7 >= 5 THEN 1 ELSE 0 END",
}


def amounts(digits: int) -> dict[str, str]:
    return {
        "log1p_amt": f"round(ln(1 + TransactionAmt), {digits})",
        "amt_cents": "round_even(TransactionAmt % 1.0, 2)",
        "is_round_amount": "CAST(TransactionAmt % 10.0 = 0 AS INT)",
    }


# Free mail providers.
FREE = (
    "('gmail','yahoo','hotmail','outlook','aol','icloud','live','msn','protonmail','ymail','mail','gmx',"
    "'zoho','inbox','yandex','qq','163','126')"
)
P_TOKEN = "coalesce(string_split(lower(P_emaildomain), '.')[1], 'unknown')"
R_TOKEN = "coalesce(string_split(lower(R_emaildomain), '.')[1], 'unknown')"
EMAIL = {
    "email_match": "CAST(coalesce(lower(P_emaildomain) = lower(R_emaildomain), false) AS INT)",
    "p_email_tld": P_TOKEN,
    "r_email_tld": R_TOKEN,
    "email_tld_match": f"CAST({P_TOKEN} = {R_TOKEN} AS INT)",
    "p_email_is_free": f"CAST({P_TOKEN} IN {FREE} AS INT)",
    "r_email_is_free": f"CAST({R_TOKEN} IN {FREE} AS INT)",
    "both_free_email": f"CAST({P_TOKEN} IN {FREE} AND {R_TOKEN} IN {FREE} AS INT)",
}
FILLED = (
    "(CAST(id_01 IS NOT NULL AS INT) + CAST(id_02 IS NOT NULL AS INT) + CAST(DeviceType IS NOT NULL AS INT)"
    " + CAST(DeviceInfo IS NOT NULL AS INT))"
)


def presence(digits: int) -> dict[str, str]:
    return {"has_identity": f"CAST({FILLED} > 0 AS INT)", "identity_completeness": f"round({FILLED} / 4.0::DOUBLE, {digits})"}


def cols(items: dict[str, str], *names: str) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in items.items() if not names or k in names)


def scalar(items: dict[str, str], *names: str) -> str:
    return f"WITH {TXN} SELECT TransactionID, {cols(items, *names)} FROM txn"


def block(items: dict[str, str], *names: str) -> str:
    return f"WITH {MERGED} SELECT TransactionID, {cols(items, *names)} FROM merged"


MERGED_COLUMNS = [
    "TransactionID", "TransactionDT", "TransactionAmt", "ProductCD", "card1", "addr1", "addr2", "P_emaildomain",
    "R_emaildomain", "isFraud", "id_01", "id_02", "DeviceType", "DeviceInfo",
]
NULL_ROWS = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(100.0 * avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 9) AS null_pct FROM merged"
    for c in MERGED_COLUMNS
)
FAMILIES = {
    "Core": MERGED_COLUMNS[:9],
    "Identity": MERGED_COLUMNS[10:],
}
MISSING_ROWS = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", 100.0 * avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS null_pct,
  avg(isFraud) FILTER ({c} IS NULL) AS a, avg(isFraud) FILTER ({c} IS NOT NULL) AS b FROM merged"""
    for c in MERGED_COLUMNS
    if c != "isFraud"
)
NARROW_TYPES = {
    "TransactionID": "bigint", "TransactionDT": "bigint", "TransactionAmt": "double", "card1": "bigint",
    "addr1": "bigint", "addr2": "bigint", "isFraud": "int", "id_01": "int", "id_02": "double",
}


def _narrow(c: str) -> str:
    old = NARROW_TYPES.get(c, "string")
    if old == "string":
        return f"SELECT '{c}' AS \"column\", 'string' AS old_type, 'string' AS new_type, NULL::DOUBLE AS min, NULL::DOUBLE AS max"
    if old == "double":
        new = "'float'"
    else:
        wide = f"'{old}'" if old == "int" else f"CASE WHEN min({c}) >= -2147483648 AND max({c}) <= 2147483647 THEN 'int' ELSE 'bigint' END"
        new = (
            f"CASE WHEN min({c}) >= -128 AND max({c}) <= 127 THEN 'tinyint' "
            f"WHEN min({c}) >= -32768 AND max({c}) <= 32767 THEN 'smallint' ELSE {wide} END"
        )
    return (
        f"SELECT '{c}' AS \"column\", '{old}' AS old_type, {new} AS new_type, min({c})::DOUBLE AS min, "
        f"max({c})::DOUBLE AS max FROM merged"
    )


CODED = ["ProductCD", "P_emaildomain", "R_emaildomain"]
CODES = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", v AS "value", CAST(row_number() OVER (ORDER BY v) - 1 AS INT) AS code
FROM (SELECT DISTINCT coalesce({c}, 'nan') AS v FROM train)"""
    for c in CODED
)
MODES = ["card1_addr1_is_mode", "card1_addr2_is_mode"]
UNIQUES = ["card1_addr1_n_unique", "card1_addr2_n_unique"]
RATIOS = [f"amt_to_{e}_mean_ratio" for e in ENTITIES]
ZSCORES = [f"amt_zscore_{e}" for e in ENTITIES]


def address(names: list[str]) -> str:
    return f"""WITH {TRAIN}{ADDRESS_FIT}, feats AS (SELECT TransactionID, {ADDRESS_COLS} FROM txn LEFT JOIN addr ON card1 = ac)
SELECT TransactionID, {', '.join(names)} FROM feats"""


SCALED = ["TransactionAmt", "addr1", "addr2"]
SCALE_STATS = ", ".join(
    f"avg(coalesce({c}, 0)) AS m_{c}, CASE WHEN stddev_pop(coalesce({c}, 0)) > 0 "
    f"THEN stddev_pop(coalesce({c}, 0)) ELSE 1.0 END AS s_{c}"
    for c in SCALED
)

ECE_EDGES = "[0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9]"
ECE = f"""ebins AS (SELECT model, score, y, len(list_filter({ECE_EDGES}::DOUBLE[], lambda e: score >= e)) - 1 AS bin FROM long),
eb AS (SELECT model, bin, count(*) AS n, avg(y) AS acc, avg(score) AS conf FROM ebins WHERE score < 1 GROUP BY model, bin),
ece AS (SELECT model, sum(n * abs(acc - conf)) / (SELECT count(*) FROM scored) AS ece FROM eb GROUP BY model)"""
KS = """cdf AS (SELECT model, i, sum(CASE WHEN score <= pt THEN p ELSE 0 END) / sum(p) AS cp,
  sum(CASE WHEN score <= pt THEN n - p ELSE 0 END) / sum(n - p) AS cn
FROM g CROSS JOIN (SELECT i, CASE WHEN i = 999 THEN 1.0::DOUBLE ELSE i * (1.0::DOUBLE / 999) END AS pt FROM range(1000) t(i))
GROUP BY model, i), ks AS (SELECT model, max(abs(cp - cn)) AS ks_statistic FROM cdf GROUP BY model)"""
CURVES = """ap AS (SELECT model, sum((p / pos) * (tp / k)) AS pr_auc,
  sum((n - p) * (tp - p / 2)) / (max(pos)::DOUBLE * max(total - pos)) AS roc_auc FROM ranked GROUP BY model),
at50 AS (SELECT model, count(*) FILTER (score >= 0.5 AND y = 1) AS tp, count(*) FILTER (score >= 0.5) AS k,
  sum(y) AS pos FROM long GROUP BY model),
m50 AS (SELECT model, CASE WHEN k > 0 THEN tp / k ELSE 0 END AS precision_at_50,
  CASE WHEN pos > 0 THEN tp / pos ELSE 0 END AS recall_at_50,
  CASE WHEN k + pos > 0 THEN 2 * tp / (k + pos) ELSE 0 END AS f1_at_50 FROM at50),
brier AS (SELECT model, avg((score - y) * (score - y)) AS brier_score FROM long GROUP BY model)"""
M50 = "round(precision_at_50, 9) AS precision_at_50, round(recall_at_50, 9) AS recall_at_50, round(f1_at_50, 9) AS f1_at_50"
BEST = (
    "thr AS optimal_threshold, round(f1, 9) AS f1_at_optimal, round(prec, 9) AS precision_at_optimal, "
    "round(rec, 9) AS recall_at_optimal"
)

DRAWS = "draws(draw_id, alpha, beta) AS (VALUES (0, -3.0::DOUBLE, 0.5::DOUBLE), (1, -2.9, 0.4), (2, -3.1, 0.6))"
P_DRAW = "1.0 / (1.0 + exp(-(alpha + beta * ln(1 + TransactionAmt))))"
METRICS_MATRIX = f"""WITH {RANKED}, {CURVES}, {KS}, {ECE} SELECT model, {r('pr_auc', 'pr_auc')}, {r('roc_auc', 'roc_auc')},
  {r('2 * roc_auc - 1', 'gini')}, {r('ks_statistic', 'ks_statistic')}, {r('brier_score', 'brier_score')}, {r('ece', 'ece')}, {M50}, {BEST}
FROM ap JOIN m50 USING (model) JOIN brier USING (model) JOIN best USING (model) JOIN ks USING (model) JOIN ece USING (model)"""
WIDTHS = f"""WITH {SCORED}, s AS (SELECT avg(hdi_width) AS a, avg(hdi_width) FILTER (y = 1) AS f,
  avg(hdi_width) FILTER (y = 0) AS l, avg(std) FILTER (y = 1) AS sf, avg(std) FILTER (y = 0) AS sl,
  100.0 * count(*) FILTER (hdi_width >= (SELECT quantile_cont(hdi_width, 0.75) FROM scored)) / count(*) AS h FROM scored)
SELECT {r('a', 'mean_uncertainty_all')}, {r('f', 'mean_uncertainty_fraud')}, {r('l', 'mean_uncertainty_legit')},
  {r('f / greatest(l, 1e-9)', 'uncertainty_ratio')}, {r('h', 'pct_high_uncertainty_q75')}, {r('sf', 'bayes_std_mean_fraud')},
  {r('sl', 'bayes_std_mean_legit')} FROM s"""
QUEUES = f"""WITH {FN} SELECT uncertainty_percentile, {r('hdi_width_threshold', 'hdi_width_threshold')}, review_queue_size,
  {r('review_queue_pct_all', 'review_queue_pct_all')}, fn_caught_in_queue, {r('fn_recovery_pct', 'fn_recovery_pct')}, fraud_in_queue,
  {r('queue_precision_pct', 'queue_precision_pct')} FROM queues"""
MISSES = f"""WITH {FN} SELECT (SELECT thr FROM best WHERE model = 'trees') AS optimal_threshold,
  (SELECT count(*) FROM fn WHERE missed) AS total_false_negatives,
  round((SELECT 100.0 * count(*) FILTER (missed) / count(*) FILTER (y = 1) FROM fn), 9) AS fn_miss_rate_pct,
  {r('review_queue_pct_all', 'headline_queue_size_pct')}, {r('fn_recovery_pct', 'headline_fn_recovery_pct')},
  {r('queue_precision_pct', 'headline_queue_precision_pct')} FROM queues WHERE uncertainty_percentile = 0.75"""
SUMMARY = {
    "total_transactions": "count(*)::DOUBLE",
    "fraud_rate": "avg(isFraud)",
    "imbalance_ratio": "(1 - avg(isFraud)) / avg(isFraud)",
    "total_columns": "14.0",
    "columns_with_null": " + ".join(f"CAST(count({c}) < count(*) AS INT)" for c in MERGED_COLUMNS),
    "columns_over_half_null": " + ".join(f"CAST(count({c}) < 0.5 * count(*) AS INT)" for c in MERGED_COLUMNS),
    "vendor_columns": "0.0",
    "duration_days": "(max(TransactionDT) - min(TransactionDT)) / 86400",
    "identity_join_rate": "avg(CASE WHEN id_01 IS NOT NULL THEN 1.0 ELSE 0.0 END)",
}


def all_features() -> str:
    fit = AMOUNT_FIT.replace(TRAIN, TRAIN_MERGED)
    vel = velocity(ENTITIES, "tagged", extra="split, ", within="split, ")
    made = {**TEMPORAL, **amounts(6), **spike_columns(), **EMAIL, **presence(6)}
    return f"""WITH {fit}{ADDRESS_FIT}, vel AS ({vel}),
rest AS (SELECT TransactionID, {cols(made)}, {ADDRESS_COLS} FROM merged {SPIKE_JOINS} LEFT JOIN addr ON card1 = ac)
SELECT * FROM vel JOIN rest USING (TransactionID)"""


def oracle_sql() -> dict[str, str]:
    return {
        "s1_csv_scan": f"WITH {MERGED} SELECT * REPLACE (id_01::DOUBLE AS id_01) FROM merged",
        "s3_split_sink": f"WITH {TXN}, {tagged('txn')} SELECT split, TransactionID, TransactionDT, TransactionAmt FROM tagged",
        "s7_report_sink": f"""WITH {RANKED}, {CURVES}
SELECT model, {r('pr_auc', 'pr_auc')}, {r('roc_auc', 'roc_auc')}, {r('brier_score', 'brier_score')}
FROM ap JOIN brier USING (model)""",
        "s8_artefact_sink": _importance(),
        "s9_narrowing": f"WITH {MERGED} " + " UNION ALL ".join(_narrow(c) for c in MERGED_COLUMNS),
        "p1_exclude_columns": f"WITH {MERGED} SELECT * EXCLUDE (TransactionID, isFraud, TransactionDT) FROM merged",
        "p4_align_schema": f"WITH {MERGED} SELECT TransactionID, TransactionAmt, card1, addr1, 0 AS V1, id_02 FROM merged",
        "p7_mask_filters": f"""WITH {SCORED} SELECT y, count(*) AS n_class,
  count(*) FILTER (hdi_width >= (SELECT quantile_cont(hdi_width, 0.75) FROM scored)) AS n_queue,
  count(*) FILTER (abs(score_a - score_b) > 0.2) AS n_apart FROM scored GROUP BY y""",
        "j1_merge": f"WITH {MERGED} SELECT * FROM merged",
        "j2_enrichment_rate": f"""WITH {TXN}, {IDENTITY} SELECT
  (SELECT count(*) FROM identity WHERE TransactionID IN (SELECT TransactionID FROM txn)) AS n_with_identity,
  count(*) AS n_transactions,
  round((SELECT count(*) FROM identity WHERE TransactionID IN (SELECT TransactionID FROM txn)) / count(*), 9) AS join_rate
FROM txn""",
        "j3_lookup_join": f"""WITH {AMOUNT_FIT} SELECT TransactionID, {r('coalesce(mean_card1, gm)', 'card1_mean')},
  {r('coalesce(std_card1, gs)', 'card1_std')} FROM txn LEFT JOIN enc_card1 ON card1 = ek_card1 CROSS JOIN overall""",
        "a1_split_summary": f"""WITH {TXN}, {tagged('txn')} SELECT split, count(*) AS n_rows, min(TransactionDT) AS dt_min,
  max(TransactionDT) AS dt_max, {r('avg(isFraud)', 'label_rate')},
  {r('100.0 * count(*) / (SELECT count(*) FROM txn)', 'pct_rows')} FROM tagged GROUP BY split""",
        "a2_entity_mean_std": f"""WITH {TXN} SELECT addr1, count(*) AS n, {r('avg(TransactionAmt)', 'mean')},
  {r('coalesce(stddev_samp(TransactionAmt), 0)', 'std')} FROM txn WHERE addr1 IS NOT NULL GROUP BY addr1""",
        "a3_global_mean_std": f"""WITH {TRAIN} SELECT count(*) AS n, {r('avg(TransactionAmt)', 'mean')},
  {r('stddev_samp(TransactionAmt)', 'std')} FROM train""",
        "a4_entity_mode": f"WITH {TXN}, train AS (SELECT * FROM txn){ADDRESS_FIT} SELECT ac AS card1, m1 AS addr1_mode, m2 AS addr2_mode FROM addr",
        "a5_entity_distinct": f"""WITH {TXN} SELECT card1, count(DISTINCT addr1) AS addr1_n_unique,
  count(DISTINCT addr2) AS addr2_n_unique FROM txn GROUP BY card1""",
        "a6_class_balance": f"""WITH {TXN}, c AS (SELECT count(*) FILTER (isFraud = 0) AS n0, count(*) FILTER (isFraud = 1) AS n1 FROM txn)
SELECT n0 AS n_legit, n1 AS n_fraud, {r('n1 / (n0 + n1)', 'fraud_rate')}, {r('n0 / n1', 'imbalance_ratio')},
  {r('n0 / greatest(n1, 1)', 'scale_pos_weight')} FROM c""",
        "a7_null_profile": f"WITH {MERGED} {NULL_ROWS}",
        "a7_null_counts": f"""WITH {MERGED}, p AS ({NULL_ROWS}) SELECT count(*) FILTER (null_pct > 0) AS n_any_null,
  count(*) FILTER (null_pct > 50) AS n_over_50, count(*) FILTER (null_pct > 90) AS n_over_90 FROM p""",
        "a8_family_nulls": f"WITH {MERGED}, p AS ({NULL_ROWS}) "
        + " UNION ALL ".join(
            f"""SELECT '{f}' AS family, round(avg(null_pct), 9) AS mean_null_pct, count(*) AS n_columns FROM p
WHERE "column" IN ({', '.join(repr(c) for c in cs)})"""
            for f, cs in FAMILIES.items()
        ),
        "a9_missingness_label": f"""WITH {MERGED}, m AS ({MISSING_ROWS}) SELECT "column", {r('null_pct', 'null_pct')},
  {r('a', 'fraud_rate_if_null')}, {r('b', 'fraud_rate_if_present')}, {r('a - b', 'delta')}
FROM m WHERE null_pct > 5""",
        "a10_time_buckets": f"WITH {BUCKETS} SELECT bin, {r('fraud_rate', 'fraud_rate')}, count, dt_mid FROM buckets",
        "a11_hour_profile": f"""WITH {TXN} SELECT CAST((TransactionDT // 3600) % 24 AS INT) AS hour,
  {r('avg(isFraud)', 'fraud_rate')}, count(*) AS count FROM txn GROUP BY 1""",
        "a11_peak_hour": f"""WITH {TXN} SELECT CAST((TransactionDT // 3600) % 24 AS INT) AS hour,
  {r('avg(isFraud)', 'fraud_rate')}, count(*) AS count FROM txn GROUP BY 1 ORDER BY avg(isFraud) DESC, 1 LIMIT 1""",
        "a12_day_profile": f"""WITH {TXN}, d AS (SELECT CAST((TransactionDT // 86400) % 7 AS INT) AS dow, isFraud FROM txn)
SELECT dow, {r('avg(isFraud)', 'fraud_rate')}, count(*) AS count,
  ['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][dow + 1] AS dow_label FROM d GROUP BY dow""",
        "a13_class_amounts": f"""WITH {TXN} SELECT isFraud, {r('avg(TransactionAmt)', 'mean_amt', 6)},
  {r('median(TransactionAmt)', 'median_amt', 6)} FROM txn GROUP BY isFraud""",
        "a14_log_histogram": f"""WITH {TXN}, e AS (SELECT log10(0.5) AS lo, (log10(max(TransactionAmt) + 1) - log10(0.5)) / 79 AS step FROM txn),
h AS (SELECT isFraud, CAST(floor((log10(TransactionAmt) - lo) / step) AS INT) AS bin, count(*) AS n, max(lo) AS lo, max(step) AS step
  FROM txn, e WHERE TransactionAmt >= 0.5 GROUP BY 1, 2)
SELECT isFraud, bin, n, round(n / (sum(n) OVER (PARTITION BY isFraud)
  * (pow(10, lo + step * (bin + 1)) - pow(10, lo + step * bin))), 9) AS density FROM h""",
        "a15_box_stats": f"""WITH {ORDERS}, c AS (SELECT isFraud, least(TransactionAmt, 200000.0) AS v FROM txn_orders),
q AS (SELECT isFraud, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM c GROUP BY isFraud)
SELECT isFraud, {r('q1', 'q1', 6)}, {r('median', 'median', 6)}, {r('q3', 'q3', 6)},
  {r('min(v) FILTER (v >= q1 - 1.5 * (q3 - q1))', 'whisker_low', 6)},
  {r('max(v) FILTER (v <= q3 + 1.5 * (q3 - q1))', 'whisker_high', 6)}
FROM c JOIN q USING (isFraud) GROUP BY isFraud, q1, median, q3""",
        "a16_identity_coverage": f"""WITH {MERGED}, s AS (SELECT 100.0 * count(id_01) / count(*) AS c,
  avg(isFraud) FILTER (id_01 IS NOT NULL) AS a, avg(isFraud) FILTER (id_01 IS NULL) AS b FROM merged)
SELECT {r('c', 'coverage_pct')}, {r('a', 'fraud_rate_with')}, {r('b', 'fraud_rate_without')}, {r('100.0 * (a - b)', 'delta_pp')} FROM s""",
        "a17_describe_scores": f"""WITH {SCORED} SELECT y, count(*) AS n, {r('avg(score_b)', 'mean')}, {r('stddev_samp(score_b)', 'std')},
  min(score_b) AS min, max(score_b) AS max, {r('quantile_cont(score_b, 0.25)', 'p25')},
  {r('quantile_cont(score_b, 0.5)', 'p50')}, {r('quantile_cont(score_b, 0.75)', 'p75')} FROM scored GROUP BY y""",
        "a18_dataset_summary": f"WITH {MERGED} "
        + " UNION ALL ".join(
            f"SELECT '{k}' AS key, round(({v})::DOUBLE, 9) AS \"value\" FROM merged" for k, v in SUMMARY.items()
        ).replace("SELECT 'total_columns' AS key, round((14.0)::DOUBLE, 9) AS \"value\" FROM merged",
                  "SELECT 'total_columns' AS key, 14.0::DOUBLE AS \"value\"")
        .replace("SELECT 'vendor_columns' AS key, round((0.0)::DOUBLE, 9) AS \"value\" FROM merged",
                 "SELECT 'vendor_columns' AS key, 0.0::DOUBLE AS \"value\""),
        "w1_rolling_count": f"WITH {TXN} " + velocity(["card1"], "txn", ["count"]),
        "w2_rolling_sum": f"WITH {TXN} " + velocity(["card1"], "txn", ["sum"]),
        "w3_rolling_mean": f"WITH {TXN} " + velocity(["card1"], "txn", ["mean_amt"]),
        "w4_velocity_grid": f"WITH {TXN} " + velocity(ENTITIES, "txn"),
        "w4_velocity_default": (
            f"WITH {TXN}, t3 AS (SELECT * REPLACE ((TransactionID * 7919 % 1000003) / 1000.0 AS TransactionAmt) FROM txn) "
            + velocity(["card1", "addr1"], "t3").replace(", 0), 2)", ", 0), 3)")
        ),
        "m8_posterior_check": f"WITH {TXN} SELECT TransactionID, TRUE AS ordered FROM txn",
        "m12_pca_check": "SELECT vec_id AS TransactionID, TRUE AS projected, TRUE AS variances_fit FROM embeddings",
        "w4_velocity_ties": f"WITH {ORDERS} " + velocity(["card1", "addr1", "addr2"], "txn_orders"),
        "w4_velocity_bulk": f"WITH {LINEITEM} " + velocity(["card1", "addr1", "addr2"], "txn_lineitem"),
        "w6_null_entity": f"WITH {TXN}, u AS (SELECT * FROM txn WHERE addr1 IS NULL) " + velocity(["addr1"], "u"),
        "w7_score_prefix": f"WITH {RANKED} SELECT * FROM ranked",
        "w8_moving_average": f"""WITH {BUCKETS} SELECT bin, round(CASE WHEN count(*) OVER f = 20 THEN avg(fraud_rate) OVER f END, 9) AS fraud_rate_ma
FROM buckets WINDOW f AS (ORDER BY bin ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING)""",
        "w9_empirical_cdf": f"""WITH {SCORED} SELECT y, hdi_width AS "value", count(*) AS n,
  round(sum(count(*)) OVER (PARTITION BY y ORDER BY hdi_width) / sum(count(*)) OVER (PARTITION BY y), 9) AS cdf
FROM scored GROUP BY y, hdi_width""",
        "w10_bin_step": f"""WITH {BUCKETS}, d AS (SELECT dt_mid - lag(dt_mid) OVER (ORDER BY bin) AS step FROM buckets)
SELECT round(median(step), 9) AS median_step FROM d""",
        "w11_importance_rank": _importance(),
        "wx1_velocity_history": f"WITH {TXN}, {tagged('txn')}, vel AS ("
        + velocity(["card1"], "tagged", extra="split, ")
        + ") SELECT * EXCLUDE (split) FROM vel WHERE split <> 'train'",
        "wx2_velocity_chunked": f"WITH {TXN} " + velocity(ENTITIES, "txn"),
        "o1_chronological_split": f"WITH {ORDERS}, {tagged('txn_orders')} SELECT TransactionID, TransactionDT, split FROM tagged",
        "o2_overlap": f"""WITH {ORDERS}, s AS (SELECT TransactionID % 3 AS part, min(TransactionDT) AS lo, max(TransactionDT) AS hi
FROM txn_orders GROUP BY 1), v AS (
SELECT 'train' AS earlier, 'val' AS later, a.hi AS earlier_max, b.lo AS later_min FROM s a, s b WHERE a.part = 0 AND b.part = 1
UNION ALL SELECT 'val', 'test', a.hi, b.lo FROM s a, s b WHERE a.part = 1 AND b.part = 2)
SELECT * FROM v WHERE later_min < earlier_max""",
        "o3_top_n": f"WITH {MERGED}, p AS ({NULL_ROWS}) SELECT * FROM p ORDER BY null_pct DESC, \"column\" LIMIT 5",
        "o4_sort_absolute": f"""WITH {MERGED}, m AS ({MISSING_ROWS}), d AS (SELECT "column", round(a - b, 9) AS delta FROM m WHERE null_pct > 5)
SELECT * FROM d ORDER BY abs(delta) DESC, "column" LIMIT 3""",
        "o5_exact_sample": f"""WITH {TXN} SELECT TransactionID, isFraud FROM txn
ORDER BY md5(concat(CAST(TransactionID AS VARCHAR), '42')), TransactionID LIMIT 500""",
        "o6_stratified_sample": f"""WITH {TXN}, c AS (SELECT count(*) FILTER (isFraud = 1) AS n1, count(*) AS n FROM txn),
k AS (SELECT least(greatest(100, CAST(floor(1000 * (n1 / n)) AS BIGINT)), n1) AS k1, n FROM c),
s AS (SELECT TransactionID, isFraud, row_number() OVER (PARTITION BY isFraud
  ORDER BY md5(concat(CAST(TransactionID AS VARCHAR), '42')), TransactionID) AS rn FROM txn)
SELECT TransactionID, isFraud FROM s, k WHERE n <= 1000 OR rn <= CASE WHEN isFraud = 1 THEN k1 ELSE 1000 - k1 END""",
        "u1_union_all": f"""WITH {TXN} SELECT TransactionID, TransactionAmt, isFraud FROM txn WHERE isFraud = 1
UNION ALL SELECT TransactionID, TransactionAmt, isFraud FROM txn WHERE isFraud = 0""",
        "f1_hour_of_day": scalar(TEMPORAL, "hour_of_day"),
        "f2_day_of_week": scalar(TEMPORAL, "day_of_week"),
        "f3_day_of_dataset": scalar(TEMPORAL, "day_of_dataset"),
        "f4_is_night": scalar(TEMPORAL, "is_night"),
        "f5_is_weekend": scalar(TEMPORAL, "is_weekend"),
        "f6_week_index": scalar({"week": "TransactionDT // 604800"}),
        "f7_log1p_amt": scalar(amounts(9), "log1p_amt"),
        "f8_amt_cents": scalar(amounts(9), "amt_cents"),
        "f9_is_round_amount": scalar(amounts(9), "is_round_amount"),
        "f10_mean_ratio": spike(RATIOS),
        "f11_zscore": spike(ZSCORES),
        "f12_email_match": block(EMAIL, "email_match"),
        "f13_email_tld": block(EMAIL, "p_email_tld", "r_email_tld"),
        "f14_email_tld_match": block(EMAIL, "email_tld_match"),
        "f15_free_email": block(EMAIL, "p_email_is_free", "r_email_is_free", "both_free_email"),
        "f16_identity_presence": block(presence(9)),
        "f17_addr_is_mode": address(MODES),
        "f18_addr_n_unique": address(UNIQUES),
        "f19_sigmoid": scalar({"p": "round(1.0 / (1.0 + exp(-(-3.0 + 0.5 * ln(1 + TransactionAmt)))), 9)"}),
        "f21_clip": scalar({"clipped": "greatest(5.0, least(50.0, TransactionAmt))"}),
        "e1_fit_amount": f"WITH {AMOUNT_FIT} "
        + " UNION ALL ".join(
            f"SELECT '{e}' AS entity, CAST(ek_{e} AS VARCHAR) AS \"value\", n_{e} AS n, round(mean_{e}, 9) AS mean, "
            f"round(std_{e}, 9) AS std FROM enc_{e}"
            for e in ENTITIES
        ),
        "e2_spend_spike": spike(RATIOS + ZSCORES),
        "e3_fit_address": f"""WITH {TRAIN}{ADDRESS_FIT} SELECT ac AS card1, an AS n, m1 AS addr1_mode, u1 AS addr1_n_unique,
  m2 AS addr2_mode, u2 AS addr2_n_unique FROM addr""",
        "e4_address_features": address(MODES + UNIQUES),
        "e5_fit_labels": f"WITH {TRAIN} {CODES}",
        "e6_apply_labels": f"WITH {TRAIN}, codes AS ({CODES}) SELECT TransactionID, "
        + ", ".join(
            f"coalesce((SELECT code FROM codes WHERE \"column\" = '{c}' AND \"value\" = coalesce(t.{c}, 'nan')), 0) AS {c}"
            for c in CODED
        )
        + " FROM txn t",
        "e7_category_codes": f"WITH {TXN} SELECT TransactionID, "
        + ", ".join(f"CASE WHEN {c} IS NULL THEN -1 ELSE CAST(dense_rank() OVER (ORDER BY {c} NULLS LAST) - 1 AS INT) END AS {c}" for c in CODED)
        + " FROM txn",
        "e8_standard_scaler": f"WITH {TRAIN}, st AS (SELECT {SCALE_STATS} FROM train) SELECT TransactionID, "
        + ", ".join(f"round((coalesce({c}, 0) - m_{c}) / s_{c}, 6) AS {c}" for c in SCALED)
        + " FROM txn, st",
        "e8_scaler_statistics": f"WITH {TRAIN}, st AS (SELECT {SCALE_STATS} FROM train) "
        + " UNION ALL ".join(
            f"SELECT '{c}' AS feature, round(m_{c}, 6) AS mean, round(s_{c}, 6) AS scale FROM st" for c in SCALED
        ),
        "e9_behavioral_block": f"""WITH {AMOUNT_FIT} SELECT TransactionID, {cols({**TEMPORAL, **amounts(6), **spike_columns()})}
FROM txn {SPIKE_JOINS}""",
        "e10_identity_block": f"""WITH {MERGED}, {tagged('txn')}, train AS (SELECT * FROM tagged WHERE split = 'train'){ADDRESS_FIT}
SELECT TransactionID, {cols({**EMAIL, **presence(9)})}, {ADDRESS_COLS} FROM merged LEFT JOIN addr ON card1 = ac""",
        "e11_all_features": all_features(),
        "e13_median_impute": f"""WITH {MERGED}, md AS (SELECT median(id_01) AS a, median(id_02) AS b, median(addr1) AS c FROM merged)
SELECT TransactionID, round(coalesce(id_01, a)::DOUBLE, 9) AS id_01, round(coalesce(id_02, b), 9) AS id_02,
  round(coalesce(addr1, c)::DOUBLE, 9) AS addr1 FROM merged, md""",
        "v1_pr_auc": f"WITH {RANKED}, {CURVES} SELECT model, {r('pr_auc', 'pr_auc')} FROM ap",
        "v1_pr_auc_documents": """WITH d AS (SELECT toxic AS y, n_chars / 100000.0::DOUBLE AS s FROM labels JOIN documents USING (doc_id)),
g AS (SELECT s, sum(y) AS p, count(*) AS n FROM d GROUP BY s),
h AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS k, sum(p) OVER () AS pp FROM g WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING))
SELECT 'length' AS model, round(sum(p / pp * tp / k), 9) AS pr_auc FROM h""",
        "v2_roc_auc": f"""WITH {SCORED}, long AS (SELECT 'trees' AS model, score_a AS s, y FROM scored UNION ALL SELECT 'bayes', score_b, y FROM scored),
r AS (SELECT model, y, rank() OVER (PARTITION BY model ORDER BY s) + (count(*) OVER (PARTITION BY model, s) - 1) / 2 AS mid FROM long),
a AS (SELECT model, (sum(mid) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2)
  / (count(*) FILTER (y = 1)::DOUBLE * count(*) FILTER (y = 0)) AS auc FROM r GROUP BY model)
SELECT model, {r('auc', 'roc_auc')}, {r('2 * auc - 1', 'gini')} FROM a""",
        "v3_pr_curve": f"""WITH {RANKED} SELECT model, score AS threshold, {r('tp / k', 'precision')}, {r('tp / pos', 'recall')},
  {r('pos / total', 'baseline')} FROM ranked""",
        "v3_roc_curve": f"""WITH {RANKED} SELECT model, score AS threshold, {r('(k - tp) / (total - pos)', 'fpr')},
  {r('tp / pos', 'tpr')} FROM ranked""",
        "v4_optimal_threshold": f"WITH {RANKED} SELECT model, {BEST} FROM best",
        "v5_ks": f"WITH {RANKED}, {KS} SELECT model, {r('ks_statistic', 'ks_statistic')} FROM ks",
        "v6_threshold_metrics": f"WITH {RANKED}, {CURVES} SELECT model, {M50} FROM m50",
        "v7_brier": f"WITH {RANKED}, {CURVES} SELECT model, {r('brier_score', 'brier_score')} FROM brier",
        "v8_ece": f"WITH {RANKED}, {ECE} SELECT model, {r('ece', 'ece')} FROM ece",
        "v9_metrics_matrix": METRICS_MATRIX,
        "v10_calibration_curve": f"""WITH {RANKED}, b AS (SELECT model, score, y, len(list_filter(({ECE_EDGES}::DOUBLE[])[2:], lambda e: e < score)) AS bin FROM long)
SELECT model, CAST(bin AS INT) AS bin, {r('avg(score)', 'mean_pred')}, {r('avg(y)', 'frac_pos')}, count(*) AS n FROM b GROUP BY model, bin""",
        "v11_uncertainty_summary": WIDTHS,
        "v12_fn_recovery": QUEUES,
        "v13_fn_summary": MISSES,
        "v14_disagreement": _disagreement(0.2, 0.5),
        "v15_width_histogram": f"""WITH {SCORED}, s AS (SELECT max(hdi_width) / 59 AS step FROM scored),
h AS (SELECT y, CAST(least(floor(hdi_width / step), 58) AS INT) AS bin, count(*) AS n, max(step) AS step FROM scored, s GROUP BY 1, 2)
SELECT y, bin, n, round(n / (sum(n) OVER (PARTITION BY y) * step), 9) AS density FROM h""",
        "v16_agreement_grid": f"""WITH {SCORED} SELECT CAST(floor(score_a * 20) AS INT) AS cell_a, CAST(floor(score_b * 20) AS INT) AS cell_b,
  count(*) AS n, {r('avg(hdi_width)', 'mean_width')} FROM scored GROUP BY 1, 2""",
        "v17_recovery_gain": f"""WITH {FN} SELECT uncertainty_percentile, {r('review_queue_pct_all / 100', 'queue_share')},
  {r('fn_recovery_pct / 100', 'recovery')}, {r('(fn_recovery_pct - review_queue_pct_all) / 100', 'gain')} FROM queues""",
        "v18_routing": f"""WITH {SCORED} SELECT TransactionID, CASE
  WHEN hdi_width >= (SELECT quantile_cont(hdi_width, 0.75) FROM scored) THEN 'review'
  WHEN score_b >= 0.5 THEN 'decline' ELSE 'approve' END AS decision FROM scored""",
        "v19_evaluation_report": _report(),
        "v21_drift": f"""WITH {SCORED}, {tagged('scored')},
g AS (SELECT split, score_a AS s, sum(y) AS p, count(*) AS n FROM tagged GROUP BY 1, 2),
h AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS k, sum(p) OVER (PARTITION BY split) AS pp FROM g
  WINDOW w AS (PARTITION BY split ORDER BY s DESC ROWS UNBOUNDED PRECEDING))
SELECT split, round(sum(p / pp * tp / k), 9) AS pr_auc FROM h GROUP BY split""",
        "v22_cost_exposure": f"""WITH {FN} SELECT count(*) FILTER (missed) AS n_missed,
  round(coalesce(sum(1.5 * TransactionAmt) FILTER (missed), 0), 4) AS exposure FROM fn""",
        "m1_class_weight": f"""WITH {TRAIN} SELECT round(count(*) FILTER (isFraud = 0) / greatest(count(*) FILTER (isFraud = 1), 1), 9)
  AS scale_pos_weight FROM train""",
        "m6_short_metrics": f"""WITH {RANKED}, {CURVES} SELECT model, {r('pr_auc', 'pr_auc')}, {r('roc_auc', 'roc_auc')}, {M50}
FROM ap JOIN m50 USING (model)""",
        "m7_posterior_mode": _posterior_mode(),
        "m7_newton_step": f"""WITH {TXN}, x AS (SELECT isFraud AS y, 1.0::DOUBLE AS x0, ln(1 + TransactionAmt) AS x1,
  ({TEMPORAL['is_night']})::DOUBLE AS x2 FROM txn),
z AS (SELECT *, 1.0 / (1.0 + exp(-(-3.0 + 0.5 * x1 - 0.2 * x2))) AS p FROM x) SELECT """
        + ", ".join(r(f"sum((y - p) * x{i})", f"g{i}", 5) for i in range(3))
        + ", "
        + ", ".join(r(f"sum(p * (1 - p) * x{i} * x{j})", f"h{i}_{j}", 5) for i in range(3) for j in range(i, 3))
        + " FROM z",
        "j5_posterior_draws": f"""WITH {TXN}, {DRAWS} SELECT TransactionID, draw_id, {r(P_DRAW, 'p')} FROM txn CROSS JOIN draws""",
        "m8_posterior_predictive": f"""WITH {TXN}, {DRAWS}, ps AS (SELECT TransactionID, {P_DRAW} AS p FROM txn CROSS JOIN draws)
SELECT TransactionID, {r('avg(p)', 'mean_proba')}, {r('stddev_pop(p)', 'uncertainty')},
  {r('quantile_cont(p, 0.03)', 'hdi_lower')}, {r('quantile_cont(p, 0.97)', 'hdi_upper')} FROM ps GROUP BY TransactionID""",
        "m9_coefficient_summary": f"""WITH {TXN}, d AS (SELECT card1, avg(ln(1 + TransactionAmt)) - 3.0 AS a,
  avg(TransactionAmt / 100.0) - 0.5 AS b, avg(isFraud) AS c FROM txn GROUP BY card1),
u AS (SELECT 'intercept' AS feature, a AS v FROM d UNION ALL SELECT 'amount', b FROM d UNION ALL SELECT 'label', c FROM d),
s AS (SELECT feature, avg(v) AS m, stddev_samp(v) AS sd, quantile_cont(v, 0.03) AS lo, quantile_cont(v, 0.97) AS hi FROM u GROUP BY feature)
SELECT feature, {r('m', 'mean', 6)}, {r('sd', 'sd', 6)}, {r('lo', 'interval_low', 6)}, {r('hi', 'interval_high', 6)},
  (lo > 0 OR hi < 0) AS significant, CASE WHEN m > 0 THEN 'increases fraud risk' ELSE 'decreases fraud risk' END AS direction FROM s""",
        "m10_linear_attribution": f"""WITH {TRAIN}, st AS (SELECT {SCALE_STATS} FROM train), c AS ("""
        + " UNION ALL ".join(
            f"SELECT TransactionID, '{c}' AS feature, {w} * (coalesce({c}, 0) - m_{c}) / s_{c} AS v FROM txn, st"
            for c, w in (("TransactionAmt", 0.8), ("addr1", -0.3), ("addr2", 0.45))
        )
        + f"""), k AS (SELECT *, row_number() OVER (PARTITION BY TransactionID ORDER BY abs(v) DESC, feature) AS rank FROM c)
SELECT TransactionID, CAST(rank AS INT) AS rank, feature, {r('v', 'contribution', 6)} FROM k WHERE rank <= 2""",
        "t1_stream_features": f"""WITH {AMOUNT_FIT}{ADDRESS_FIT} SELECT TransactionID,
  {cols({**TEMPORAL, **amounts(6), **spike_columns(), **EMAIL})}, {ADDRESS_COLS}
FROM txn {SPIKE_JOINS} LEFT JOIN addr ON card1 = ac""",
        "t2_stream_velocity": f"WITH {TXN} " + velocity(["card1"], "txn"),
        "t3_label_monitor": """SELECT date_trunc('hour', ts) AS window_start, count(*) AS n,
  round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 9) AS label_rate FROM events GROUP BY 1""",
    }


def _importance() -> str:
    return f"""WITH {TXN}, t AS (SELECT ProductCD, round(sum(TransactionAmt), 2) AS total FROM txn GROUP BY ProductCD)
SELECT ProductCD, total, CAST(row_number() OVER (ORDER BY total DESC, ProductCD) AS INT) AS rank,
  round(100.0 * total / sum(total) OVER (), 2) AS importance_pct FROM t"""


def _disagreement(threshold: float, decision: float) -> str:
    apart, high, low = f"abs(score_a - score_b) > {threshold}", decision + threshold / 2, decision - threshold / 2
    return f"""WITH {SCORED}, d AS (SELECT count(*) FILTER ({apart}) AS nd, count(*) AS n,
  avg(CASE WHEN (score_a >= {decision}) = (y = 1) THEN 1.0 ELSE 0.0 END) FILTER ({apart}) AS aa,
  avg(CASE WHEN (score_b >= {decision}) = (y = 1) THEN 1.0 ELSE 0.0 END) FILTER ({apart}) AS ab,
  count(*) FILTER (score_a > {high} AND score_b < {low}) AS ah, count(*) FILTER (score_b > {high} AND score_a < {low}) AS bh,
  coalesce(avg(y) FILTER (score_a > {high} AND score_b < {low}), 0) AS ra, coalesce(avg(y) FILTER (score_b > {high} AND score_a < {low}), 0) AS rb
FROM scored) SELECT nd AS n_disagreements, {threshold}::DOUBLE AS disagreement_threshold, {r('100.0 * nd / n', 'disagreement_rate_pct')},
  {r('aa', 'accuracy_a')}, {r('ab', 'accuracy_b')}, CASE WHEN aa > ab THEN 'trees' WHEN ab > aa THEN 'bayes' ELSE 'tie' END AS winner,
  ah AS a_high_b_low_count, bh AS b_high_a_low_count, {r('ra', 'fraud_rate_a_high_b_low')}, {r('rb', 'fraud_rate_b_high_a_low')} FROM d"""


def _report() -> str:
    """The sections of the report, each figure with its decimals, one line per figure."""
    six = {"pr_auc": 6, "roc_auc": 6, "gini": 6, "ks_statistic": 6, "brier_score": 6, "ece": 6}
    four = {f"{m}_at_{t}": 4 for m in ("precision", "recall", "f1") for t in ("50", "optimal")}
    totals = f"""WITH {SCORED} SELECT count(*) AS test_rows, sum(y) AS test_fraud_n, 100.0 * avg(y) AS test_fraud_rate_pct FROM scored"""
    sections = [
        ("evaluation_metadata", None, totals, {"test_rows": 0, "test_fraud_n": 0, "test_fraud_rate_pct": 4}),
        ("models", "model", METRICS_MATRIX, {**six, **four, "optimal_threshold": 4}),
        ("uncertainty_analysis", None, WIDTHS, {
            "mean_uncertainty_all": 6, "mean_uncertainty_fraud": 6, "mean_uncertainty_legit": 6, "uncertainty_ratio": 4,
            "pct_high_uncertainty_q75": 2, "bayes_std_mean_fraud": 6, "bayes_std_mean_legit": 6,
        }),
        ("fn_recovery.summary", None, MISSES, {
            "optimal_threshold": 4, "total_false_negatives": 0, "fn_miss_rate_pct": 2, "headline_queue_size_pct": 2,
            "headline_fn_recovery_pct": 2, "headline_queue_precision_pct": 2,
        }),
        ("fn_recovery.table", "uncertainty_percentile", QUEUES, {
            "hdi_width_threshold": 6, "review_queue_size": 0, "review_queue_pct_all": 2, "fn_caught_in_queue": 0,
            "fn_recovery_pct": 2, "fraud_in_queue": 0, "queue_precision_pct": 2,
        }),
        ("disagreement_analysis", None, _disagreement(0.25, 0.4), {
            "n_disagreements": 0, "disagreement_threshold": 9, "disagreement_rate_pct": 2, "accuracy_a": 4, "accuracy_b": 4,
            "winner": None, "a_high_b_low_count": 0, "b_high_a_low_count": 0, "fraud_rate_a_high_b_low": 4, "fraud_rate_b_high_a_low": 4,
        }),
    ]
    tables, lines = [], []
    for i, (section, told_by, sql, names) in enumerate(sections):
        tables.append(f"s{i} AS ({sql})")
        item = f"CAST({told_by} AS VARCHAR)" if told_by else "CAST(NULL AS VARCHAR)"
        for name, digits in names.items():
            figure = "CAST(NULL AS DOUBLE)" if digits is None else f"CAST(round({name}, {digits}) AS DOUBLE)"
            said = name if digits is None else "CAST(NULL AS VARCHAR)"
            lines.append(f"SELECT '{section}' AS section, {item} AS item, '{name}' AS name, {figure} AS value, {said} AS said FROM s{i}")
    return f"WITH {', '.join(tables)} {' UNION ALL '.join(lines)}"


def _posterior_mode(steps: int = 14) -> str:
    """Newton's method written out: every step is one aggregation and a 3 x 3 system solved by determinants."""
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    h = lambda i, j: f"h{min(i, j)}{max(i, j)}"
    precision = ("0.25", "1", "1")

    def det(columns: list[list[str]]) -> str:
        a, b, c = columns
        return (
            f"({a[0]} * ({b[1]} * {c[2]} - {c[1]} * {b[2]}) - {b[0]} * ({a[1]} * {c[2]} - {c[1]} * {a[2]})"
            f" + {c[0]} * ({a[1]} * {b[2]} - {b[1]} * {a[2]}))"
        )

    matrix = [[h(i, j) for i in range(3)] for j in range(3)]
    right = ["g0", "g1", "g2"]
    solved = [f"{det([right if k == j else matrix[k] for k in range(3)])} / {det(matrix)} AS d{j}" for j in range(3)]
    sums = [f"sum((y - p) * x{i}) - {precision[i]} * b{i} AS g{i}" for i in range(3)]
    sums += [f"sum(p * (1 - p) * x{i} * x{j})" + (f" + {precision[i]}" if i == j else "") + f" AS h{i}{j}" for i, j in pairs]
    out = f"""WITH {TXN}, x AS (SELECT isFraud AS y, 1.0::DOUBLE AS x0, ln(1 + TransactionAmt) - 3.0 AS x1,
  ({TEMPORAL['is_night']})::DOUBLE AS x2 FROM txn), t0 AS (SELECT 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2)"""
    for k in range(steps + 1):
        out += f""",
s{k} AS MATERIALIZED (SELECT b0, b1, b2, {', '.join(sums)}
  FROM (SELECT *, 1.0 / (1.0 + exp(-(b0 * x0 + b1 * x1 + b2 * x2))) AS p FROM x, t{k}) GROUP BY b0, b1, b2),
e{k} AS (SELECT *, {', '.join(solved)} FROM s{k}),
t{k + 1} AS MATERIALIZED (SELECT {', '.join(f'b{j} + d{j} * least(1, 5 / greatest(abs(d0), abs(d1), abs(d2), 1e-12)) AS b{j}' for j in range(3))} FROM e{k})"""
    fits = "greatest(abs(g0), abs(g1), abs(g2)) < 1e-6 * least(h00, h11, h22) AS at_optimum"
    return out + " " + " UNION ALL ".join(
        f"SELECT '{name}' AS feature, {r(f'b{j}', 'mode', 6)}, {r(f'h{j}{j}', 'curvature', 6)}, {fits} FROM s{steps}"
        for j, name in enumerate(("intercept", "x1", "x2"))
    )
