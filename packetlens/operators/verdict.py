"""Fusing rules and model scores into one explained verdict per packet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.net import ip_to_string
from ..functions.text import score_text, whole
from ..schemas import ATTACK, NORMAL, SUSPICIOUS

ANOMALY_SCORE = 0.5
# Labels that do not name an attack.
QUIET_LABELS = ("Normal", "Other", "")


def ml_labelled() -> Column:
    return ~F.col("ml_label").isin(*QUIET_LABELS)


def ml_flag() -> Column:
    return (F.col("ml_score") >= ANOMALY_SCORE) | ml_labelled()


def decide(df: DataFrame) -> DataFrame:
    """Verdict columns from rule_*, ml_score, ml_label and the features.

    A rule beats the models; a named class beats a bare anomaly score.
    """
    # The wording of verdict reasons and the type of an unnamed anomaly.
    ruled = F.col("rule_type").isNotNull()
    score, label = score_text("ml_score"), F.col("ml_label")
    context = F.concat(
        F.lit(" | pkt_rate="), whole("packet_rate"), F.lit(" | ports="), whole("unique_ports"),
        F.lit(" | syn="), whole("syn_count"),
    )
    rule_reason = F.when(
        ml_flag(), F.concat("rule_reason", F.lit(" | ML: "), label, F.lit(" (score="), score, F.lit(")"))
    ).otherwise(F.col("rule_reason"))
    class_reason = F.concat(F.lit("ML classifier: "), label, F.lit(" | anomaly score="), score, context)
    anomaly_reason = F.concat(F.lit("iForest score="), score, F.lit(" RF="), label, context)

    def choose(by_rule, by_class, by_anomaly, quiet) -> Column:
        return (
            F.when(ruled, by_rule).when(ml_labelled(), by_class)
            .when(F.col("ml_score") >= ANOMALY_SCORE, by_anomaly).otherwise(quiet)
        )

    return df.withColumns({
        "severity": choose(F.col("rule_severity"), F.lit(ATTACK), F.lit(SUSPICIOUS), F.lit(NORMAL)),
        "attack_type": choose(F.col("rule_type"), label, F.lit("Anomaly"), F.lit("")),
        "reason": choose(rule_reason, class_reason, anomaly_reason, F.lit("")),
        "src_ip_str": ip_to_string("src_ip"),
        "anomaly_score": F.col("ml_score"),
        "rule_triggered": ruled,
        "ml_triggered": ml_flag(),
    })


DETECTION_COLUMNS = [
    "ts_us", "src_ip", "src_ip_str", "severity", "attack_type", "reason", "anomaly_score", "rule_triggered",
    "ml_triggered",
]


def prediction_class(severity="severity", attack_type="attack_type") -> Column:
    """Verdict -> the class written to the prediction log."""
    # The classes, and the words (case matters) that decide them.
    kind = F.col(attack_type)
    return (
        F.when(F.col(severity) == NORMAL, "NORMAL")
        .when(kind.contains("SYN"), "SYN_FLOOD")
        .when(kind.contains("Port"), "PORT_SCAN")
        .otherwise("ATTACK")
    )


def labelled_predictions(df: DataFrame, actual) -> DataFrame:
    """(actual, pred) rows for evaluation; `actual` is the caller's truth column."""
    truth = F.col(actual) if isinstance(actual, str) else actual
    return df.select(truth.alias("actual"), prediction_class().alias("pred"))
