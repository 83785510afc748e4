"""Features, scaling, rules, baselines, verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetlens.operators.baseline import adaptive_threshold, baseline_ewma, final_baseline
from packetlens.operators.features import (
    apply_scaler, feature_bucket, fit_transform, override_range, scaler_stats,
)
from packetlens.operators.rules import rules, spikes
from packetlens.operators.scoring import bucket_reuse, score_bucketed, score_heuristic
from packetlens.operators.verdict import DETECTION_COLUMNS, labelled_predictions, prediction_class
from packetlens.plans.detection import detect, detect_adaptive, fit_first, limit_normals, packet_features
from packetlens.schemas import DERIVED_FEATURES, MODEL_FEATURES, RuleThresholds

from . import sql
from .inputs import idle_packets, idle_packets_sql, packets, source_ticks, table
from .registry import ORACLE, check
from .sql import BASE, DETECTION, query

_FEATURES = [*MODEL_FEATURES, *DERIVED_FEATURES]
_KEY = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol", "packet_size", "tcp_flags", "ts_us"]
_LIST = ", ".join(_FEATURES)


def _features(spark, sf):
    return packet_features(packets(spark, sf))


@check(query(f"SELECT {BASE}, {_LIST} FROM feats", "feats"))
def feature_vectors(spark, sf):
    return _features(spark, sf).select(*_KEY, *_FEATURES)


def _bucket_sql() -> str:
    steps = {"packet_rate": 5, "unique_ports": 1, "syn_count": 2, "avg_packet_size": 50, "connection_count": 5}
    parts = [
        f"CAST(floor(greatest(0.0::DOUBLE, floor({c} / {s}.0::DOUBLE + 0.5::DOUBLE) * {s}.0::DOUBLE * 10.0::DOUBLE)) AS BIGINT) AS b_{c}"
        for c, s in steps.items()
    ]
    for c, x in {"syn_ratio": "* 20.0", "port_scan_rate": "* 5.0", "bytes_per_sec": "/ 1000.0"}.items():
        parts.append(f"CAST(floor(greatest(0.0::DOUBLE, floor({c} {x}::DOUBLE) * 10.0::DOUBLE)) AS BIGINT) AS b_{c}")
    return ", ".join(parts)


_BUCKETS = ", ".join(f"b_{c}" for c in _FEATURES)


@check(query(f"SELECT {BASE}, {_bucket_sql()} FROM feats", "feats"))
def feature_buckets(spark, sf):
    rows = feature_bucket(_features(spark, sf))
    return rows.select(*_KEY, *[F.col(f"bucket.{c}").alias(f"b_{c}") for c in _FEATURES])


@check(query(
    f"SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS buckets, (sum(n) - count(*))::DOUBLE / sum(n)::DOUBLE AS reuse_ratio "
    f"FROM (SELECT {_BUCKETS}, count(*) AS n FROM b GROUP BY ALL)", "feats", b=f"SELECT {_bucket_sql()} FROM feats"
))
def feature_bucket_reuse(spark, sf):
    return bucket_reuse(_features(spark, sf))


_TOTAL = "ts_us, src_ip, dst_ip, src_port, dst_port, protocol, packet_size, tcp_flags"
_ORDER = _TOTAL.split(", ")


@check(query(
    f"SELECT {BASE}, first_value(ml_score) OVER w AS ml_score, first_value(ml_label) OVER w AS ml_label FROM b "
    f"WINDOW w AS (PARTITION BY {_BUCKETS} ORDER BY {_TOTAL})", "scored", b=f"SELECT *, {_bucket_sql()} FROM scored"
))
def bucketed_scores(spark, sf):
    return score_bucketed(_features(spark, sf), score_heuristic, _ORDER).select(*_KEY, "ml_score", "ml_label")


@check(ORACLE["bucketed_scores"])
def bucketed_scores_dealt(spark, sf):
    """Buckets of over 100 rows meet in several tasks."""
    return score_bucketed(_features(spark, sf), score_heuristic, _ORDER, rows_each=100).select(*_KEY, "ml_score", "ml_label")


@check(query(f"SELECT {BASE}, ml_score, ml_label FROM scored", "scored"))
def heuristic_scores(spark, sf):
    return score_heuristic(_features(spark, sf)).select(*_KEY, "ml_score", "ml_label")


def _fit(n: int, where: str = "true") -> dict[str, str]:
    first = f"SELECT * FROM feats WHERE {where} ORDER BY {_TOTAL} LIMIT {n}"
    stats = ", ".join(
        f"min({c}) AS {c}_lo, max({c}) AS {c}_hi, avg({c}) AS {c}_mean, stddev_samp({c}) AS {c}_sd" for c in MODEL_FEATURES
    )
    return {
        "firstn": first,
        "fit": f"SELECT count(*) AS n, {stats}, max(({_TOTAL})) AS last FROM firstn",
    }


def _scaled_sql(mode: str, ready: str, **fit: str) -> str:
    """The scaled rows; the fit, one row, is a scalar subquery."""
    out = []
    for c in MODEL_FEATURES:
        if mode == "minmax":
            v = f"CASE WHEN p.{c}_hi - p.{c}_lo < 1e-9 THEN 0 ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, (f.{c} - p.{c}_lo) / (p.{c}_hi - p.{c}_lo))) END"
        else:
            v = f"CASE WHEN p.{c}_sd < 1e-9 THEN 0 ELSE (f.{c} - p.{c}_mean) / p.{c}_sd END"
        out.append(f"round(CASE WHEN {ready} THEN {v} ELSE f.{c} END, 6) AS {c}")
    rows = "(SELECT *, (SELECT fit FROM fit) AS p FROM feats) f"
    whole = query(f"SELECT {_FB}, {', '.join(out)}, {_DERIVED} FROM {rows}", "feats", **fit)
    return whole.replace("feats AS (", "feats AS MATERIALIZED (").replace("fit AS (", "fit AS MATERIALIZED (")


_ROW = "(" + ", ".join(f"f.{c}" for c in _ORDER) + ")"
_FB = ", ".join(f"f.{c}" for c in _KEY)
_DERIVED = ", ".join(f"f.{c}" for c in DERIVED_FEATURES)


def _rounded(df):
    return df.select(*_KEY, *[F.round(c, 6).alias(c) for c in MODEL_FEATURES], *DERIVED_FEATURES)


@check(_scaled_sql("minmax", "p.n >= 200", **_fit(200)))
def scaled_minmax(spark, sf):
    rows = _features(spark, sf)
    return _rounded(apply_scaler(rows, fit_first(packets(spark, sf), _ORDER), "minmax"))


@check(_scaled_sql("zscore", "p.n >= 200", **_fit(200)))
def scaled_zscore(spark, sf):
    rows = _features(spark, sf)
    return _rounded(apply_scaler(rows, fit_first(packets(spark, sf), _ORDER), "zscore"))


@check(_scaled_sql("minmax", f"p.n >= 200 AND {_ROW} >= p.last", **_fit(200)))
def scaled_after_warmup(spark, sf):
    return _rounded(fit_transform(_features(spark, sf), _ORDER, stats=fit_first(packets(spark, sf), _ORDER)))


_LATER_US = 1704067220000000
_LATER = f"ts_us >= {_LATER_US}"


@check(_scaled_sql("zscore", "p.n >= 300", **_fit(300, _LATER)))
def scaled_recalibrated(spark, sf):
    rows = _features(spark, sf)
    return _rounded(apply_scaler(rows, fit_first(packets(spark, sf), _ORDER, 300, _LATER_US), "zscore"))


def _stat_rows(lo: str = "{c}_lo", hi: str = "{c}_hi") -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {lo.format(c=c)} AS min, {hi.format(c=c)} AS max, round({c}_mean, 6) AS mean, "
        f"round({c}_sd, 6) AS stddev, n AS rows_fitted, n >= 200 AS is_fitted FROM fit"
        for c in MODEL_FEATURES
    )


def _round_stats(df):
    return df.withColumns({"mean": F.round("mean", 6), "stddev": F.round("stddev", 6)})


@check(query(_stat_rows(), "feats", **_fit(200)))
def scaler_statistics(spark, sf):
    return _round_stats(scaler_stats(fit_first(packets(spark, sf), _ORDER)))


@check(query(
    _stat_rows("CASE WHEN '{c}' = 'packet_rate' THEN 0.0::DOUBLE ELSE {c}_lo END", "CASE WHEN '{c}' = 'packet_rate' THEN 1000.0::DOUBLE ELSE {c}_hi END"),
    "feats", **_fit(200),
))
def scaler_range_override(spark, sf):
    fitted = fit_first(packets(spark, sf), _ORDER)
    return _round_stats(scaler_stats(override_range(fitted, "packet_rate", 0, 1000)))


_RULE = "rule_type, rule_reason, rule_severity"


@check(query(f"SELECT {BASE}, {_RULE} FROM ruled WHERE rule_type IS NOT NULL", "ruled"))
def rule_matches(spark, sf):
    return rules(_features(spark, sf)).filter("rule_type IS NOT NULL").select(*_KEY, *_RULE.split(", "))


@check(query(
    f"SELECT {BASE}, {_RULE} FROM custom", "feats", custom=sql.rules("feats", ports=4, ratio=0.5, syn_rate=20.0, dos=100.0)
))
def rule_matches_custom(spark, sf):
    t = RuleThresholds(port_scan_ports=4, syn_flood_ratio=0.5, syn_flood_rate=20.0, dos_rate=100.0)
    return rules(_features(spark, sf), t).select(*_KEY, *_RULE.split(", "))


@check(query(
    "SELECT coalesce(rule_type, 'none') AS rule, coalesce(rule_severity, 0) AS severity, count(*) AS packets FROM ruled GROUP BY 1, 2", "ruled"
))
def rule_summary(spark, sf):
    found = rules(_features(spark, sf))
    return found.groupBy(
        F.coalesce("rule_type", F.lit("none")).alias("rule"), F.coalesce("rule_severity", F.lit(0)).alias("severity")
    ).agg(F.count(F.lit(1)).alias("packets"))


def _next(b: str, x: str) -> str:
    def mix(w):
        return f"(1.0::DOUBLE - {w}::DOUBLE) * {b} + {w}::DOUBLE * {x}"

    return f"CASE WHEN {b} = 0 THEN {x} WHEN {x} / {b} > 5 THEN {mix(0.7)} WHEN {x} / {b} > 2 THEN {mix(0.5)} ELSE {mix(0.3)} END"


def _ewma(key: str, rows: str = "events") -> dict[str, str]:
    return {
        "s": f"SELECT {key}, event_id, value, row_number() OVER (PARTITION BY {key} ORDER BY event_id) AS rn FROM {rows}",
        "r": f"""SELECT {key}, event_id, value, rn, 0.0::DOUBLE AS baseline, value AS baseline_after FROM s WHERE rn = 1
          UNION ALL SELECT s.{key}, s.event_id, s.value, s.rn, r.baseline_after, {_next('r.baseline_after', 's.value')}
          FROM r JOIN s ON s.{key} = r.{key} AND s.rn = r.rn + 1""",
    }


_EWMA = _ewma("user_id")


def _series(spark, sf):
    return table(spark, sf, "events").select("user_id", "event_id", "value")


@check(query("SELECT user_id, event_id, value, baseline, baseline_after FROM r", recursive=True, **_EWMA))
def baseline_rows(spark, sf):
    return baseline_ewma(_series(spark, sf), ["user_id"], ["event_id"], "value")


@check(query("SELECT event_type, event_id, value, baseline, baseline_after FROM r", recursive=True, **_ewma("event_type")))
def baseline_rows_split(spark, sf):
    rows = table(spark, sf, "events").select("event_type", "event_id", "value")
    return baseline_ewma(rows, ["event_type"], ["event_id"], "value", block=F.expr("event_id div 1000"), chunk_rows=500)


@check(query(
    "SELECT event_id, value, baseline, baseline_after FROM r", recursive=True,
    every="SELECT 0 AS one, event_id, value FROM events", **_ewma("one", "every"),
))
def baseline_global(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "value")
    return baseline_ewma(rows, [], ["event_id"], "value", block=F.expr("event_id div 1000"), chunk_rows=500)


@check(query(
    "SELECT user_id, arg_max(baseline_after, rn) AS baseline FROM r GROUP BY 1", recursive=True, **_EWMA
))
def baseline_final(spark, sf):
    return final_baseline(_series(spark, sf), ["user_id"], ["event_id"], "value")


@check(query(
    "SELECT user_id, event_id, value, baseline FROM r WHERE baseline > 0 AND value >= baseline * 5.0::DOUBLE", recursive=True, **_EWMA
))
def spikes_over_baseline(spark, sf):
    rows = baseline_ewma(_series(spark, sf), ["user_id"], ["event_id"], "value").drop("baseline_after")
    return rows.filter(spikes("value", "baseline"))


def _threshold_sql(source: str, keys: str, order: str, value: str, window: int, warmup: int, k: float) -> str:
    life = f"PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    past = f"PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING"
    return f"""SELECT {keys}, {order}, {value}, seen, samples, mean, round(stddev, 6) AS stddev,
      lifetime_min, lifetime_max, round(CASE WHEN samples >= 2 THEN mean + {k}::DOUBLE * stddev ELSE 1e18::DOUBLE END, 6) AS threshold,
      seen >= {warmup} AS warmed_up,
      coalesce(seen >= {warmup} AND samples >= 2 AND {value} > mean + {k}::DOUBLE * stddev, false) AS is_suspicious,
      coalesce(seen >= {warmup} AND samples >= 2 AND {value} > mean + {2 * k}::DOUBLE * stddev, false) AS is_attack
      FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) - 1 AS seen, count({value}) OVER p AS samples,
        avg({value}) OVER p AS mean, stddev_samp({value}) OVER p AS stddev, min({value}) OVER l AS lifetime_min,
        max({value}) OVER l AS lifetime_max FROM {source} WINDOW p AS ({past}), l AS ({life}))"""


def _round_threshold(df):
    return df.withColumns({c: F.round(c, 6) for c in ("stddev", "threshold")})


# In whole cents, so that the sums behind the means are exact in any order.
_CENTS = "CAST(round(value * 100) AS BIGINT) AS cents"


@check(query(
    _threshold_sql("series", "event_type", "event_id", "cents", 300, 50, 3.0),
    series=f"SELECT event_type, event_id, {_CENTS} FROM events",
))
def adaptive_thresholds(spark, sf):
    rows = table(spark, sf, "events").selectExpr("event_type", "event_id", _CENTS)
    return _round_threshold(adaptive_threshold(
        rows, ["event_type"], ["event_id"], "cents", F.expr("event_id div 1000"), chunk_rows=500
    ))


@check(query(
    _threshold_sql("seg", "src_ip, segment", "sec", "packets", 10, 5, 1.0), "ticks",
    seg="SELECT src_ip, sec, packets, sec // 20 AS segment FROM ticks",
))
def adaptive_thresholds_reset(spark, sf):
    rows = source_ticks(spark, sf).select("src_ip", "sec", "packets", F.expr("sec div 20").alias("segment"))
    return _round_threshold(adaptive_threshold(
        rows, ["src_ip", "segment"], ["sec"], "packets", F.expr("sec div 60"), window=10, k=1.0, warmup=5
    ))


@check(query(f"SELECT {DETECTION} FROM det", "det"))
def detections(spark, sf):
    return detect(packets(spark, sf)).select(*DETECTION_COLUMNS)


@check(query(
    "SELECT src_ip, ts_us, severity, attack_type, CASE WHEN severity = 0 THEN 'NORMAL' WHEN attack_type LIKE '%SYN%' THEN 'SYN_FLOOD' "
    "WHEN attack_type LIKE '%Port%' THEN 'PORT_SCAN' ELSE 'ATTACK' END AS pred FROM det", "det"
))
def prediction_classes(spark, sf):
    return detect(packets(spark, sf)).select("src_ip", "ts_us", "severity", "attack_type", prediction_class().alias("pred"))


_TRUTH = "CASE src_ip % 10 WHEN 9 THEN 'SYN_FLOOD' WHEN 7 THEN 'PORT_SCAN' ELSE 'NORMAL' END"


@check(query(
    f"SELECT {_TRUTH} AS actual, CASE WHEN severity = 0 THEN 'NORMAL' WHEN attack_type LIKE '%SYN%' THEN 'SYN_FLOOD' "
    "WHEN attack_type LIKE '%Port%' THEN 'PORT_SCAN' ELSE 'ATTACK' END AS pred FROM det", "det"
))
def detection_truth_pairs(spark, sf):
    return labelled_predictions(detect(packets(spark, sf)), F.expr(_TRUTH))


_LIMIT = {
    "n": "SELECT src_ip, ts_us, row_number() OVER (PARTITION BY src_ip ORDER BY ts_us) AS rn FROM det WHERE severity = 0",
    "k": """SELECT src_ip, ts_us, rn, ts_us AS last, true AS kept FROM n WHERE rn = 1
      UNION ALL SELECT n.src_ip, n.ts_us, n.rn, CASE WHEN n.ts_us - k.last >= 500000 THEN n.ts_us ELSE k.last END, n.ts_us - k.last >= 500000
      FROM k JOIN n ON n.src_ip = k.src_ip AND n.rn = k.rn + 1""",
}


@check(query(
    "SELECT src_ip, ts_us, severity FROM det WHERE severity > 0 UNION ALL SELECT src_ip, ts_us, 0 FROM k WHERE kept",
    "det", recursive=True, **_LIMIT,
))
def normals_limited(spark, sf):
    return limit_normals(detect(packets(spark, sf)).select("src_ip", "ts_us", "severity"))


@check(ORACLE["normals_limited"])
def normals_limited_split(spark, sf):
    return limit_normals(detect(packets(spark, sf)).select("src_ip", "ts_us", "severity"), chunk_rows=500)


def _adaptive(key: str = "src_ip") -> dict[str, str]:
    """The sequential detector over `ruled`, one fold for each value of `key` (columns of p)."""
    same = " AND ".join(f"a0.{c} = a.{c}" for c in key.split(", "))
    mine = ", ".join(f"a0.{c}" for c in key.split(", "))
    return {
        "p0": f"SELECT *, (ml_score >= 0.5 OR ml_label NOT IN ('Normal', 'Other', '')) AS ml, "
              f"ts_us - lag(ts_us) OVER (PARTITION BY src_ip ORDER BY {_TOTAL}) AS quiet FROM ruled WHERE rule_type IS NULL",
        "p1": f"SELECT *, count(*) FILTER (quiet > {_IDLE_US}) OVER (PARTITION BY src_ip ORDER BY {_TOTAL} ROWS UNBOUNDED PRECEDING) AS life FROM p0",
        "p": f"SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {_TOTAL}) AS rn FROM p1",
        "a0": f"SELECT {key}, rn, ts_us, packet_rate, ml FROM p",
        "a": f"""SELECT {key}, rn, 0.0::DOUBLE AS baseline, CASE WHEN ml THEN 0.0::DOUBLE ELSE packet_rate END AS next,
        CASE WHEN ml THEN NULL ELSE ts_us END AS last, true AS kept FROM a0 WHERE rn = 1
      UNION ALL SELECT {key}, rn, b, CASE WHEN moves THEN {_next('b', 'packet_rate')} ELSE b END, CASE WHEN moves THEN ts_us ELSE l END,
        alert OR moves FROM (SELECT *, NOT alert AND (l IS NULL OR ts_us - l >= 500000) AS moves FROM (
          SELECT {mine}, a0.rn, a0.ts_us, a0.packet_rate, a.next AS b, a.last AS l,
            (a0.ml OR (a.next > 0 AND a0.packet_rate >= a.next * 5.0::DOUBLE)) AS alert
          FROM a JOIN a0 ON {same} AND a0.rn = a.rn + 1))""",
        "joined": f"SELECT p.* EXCLUDE (rule_type, rule_reason, rule_severity, ml, rn, quiet, life), a.baseline FROM p JOIN a USING ({key}, rn) WHERE a.kept",
        "again": sql.rules("joined", baseline=True),
        "merged": "SELECT * FROM again UNION ALL BY NAME SELECT *, NULL::DOUBLE AS baseline FROM ruled WHERE rule_type IS NOT NULL",
        "final": sql.decide("merged"),
    }


_IDLE_US = 30_000_000
_ADAPTIVE = _adaptive()


@check(query(f"SELECT {DETECTION}, baseline FROM final", "ruled", recursive=True, **_ADAPTIVE))
def detections_adaptive(spark, sf):
    return detect_adaptive(packets(spark, sf)).select(*DETECTION_COLUMNS, "baseline")


@check(ORACLE["detections_adaptive"])
def detections_adaptive_split(spark, sf):
    return detect_adaptive(packets(spark, sf), chunk_rows=500).select(*DETECTION_COLUMNS, "baseline")


@check(idle_packets_sql(query(f"SELECT {DETECTION}, baseline FROM final", "ruled", recursive=True, **_adaptive("src_ip, life"))))
def detections_adaptive_idle(spark, sf):
    """Sources that fall silent for a while, and many that are seen in one burst only."""
    return detect_adaptive(idle_packets(spark, sf), idle_secs=_IDLE_US // 1_000_000).select(*DETECTION_COLUMNS, "baseline")
