"""Training preparation, models, evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from packetlens.functions.labels import RATE_BOUNDS, bin_port, clip, normalise_label
from packetlens.operators import evaluate as ev
from packetlens.operators import training as tr
from packetlens.operators.classifier import ForestSettings, score_classifier, train_classifier
from packetlens.operators.forest import NODE_SCHEMA, IsolationModel, IsolationSettings, score_isolation, train_isolation_forest
from packetlens.operators.scoring import combine_scores
from packetlens.operators.spread import positions
from packetlens.plans.detection import packet_features
from packetlens.plans.training import model_scorer, train_models
from packetlens.schemas import TRAINING_FEATURES
from packetlens.session import shared_dir
from packetlens.sources.sinks import load_isolation, save_isolation

from .inputs import flows, labelled, packets, stored, table
from .registry import check
from .sql import query

_KEY = ["row_a", "row_b", "row_c", "row_d", "row_e"]
_KEYS = ", ".join(_KEY)
_VALUES = "packet_rate, unique_ports, syn_count, avg_packet_size, conn_count, label"
_HASH = f"md5(concat_ws('|', {', '.join(k + '::VARCHAR' for k in _KEY)}, '42'))"


def _train(spark, sf):
    return tr.prepare_training(flows(spark, sf), _KEY)


@check(query(f"SELECT {_KEYS}, packet_rate, syn_count, avg_packet_size, conn_count, dst_port, label FROM clean", "clean"))
def flow_rows_cleaned(spark, sf):
    return tr.clean_flow_rows(flows(spark, sf))


@check(query(f"SELECT {_KEYS}, {_VALUES} FROM train", "train"))
def training_rows(spark, sf):
    return _train(spark, sf)


@check(
    "SELECT o_orderkey, p, CASE WHEN p < 1024 THEN 1.0::DOUBLE WHEN p < 10000 THEN 3.0::DOUBLE ELSE floor(p / 10000.0::DOUBLE) + 4 END AS bin "
    "FROM (SELECT o_orderkey, CAST(o_orderkey * 977 % 65536 AS DOUBLE) AS p FROM orders)"
)
def port_bins(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey", "CAST(o_orderkey * 977 % 65536 AS DOUBLE) AS p")
    return rows.withColumn("bin", bin_port("p"))


@check("SELECT o_orderkey, v, greatest(0.0::DOUBLE, least(1000000.0::DOUBLE, v)) AS clipped FROM (SELECT o_orderkey, o_totalprice * 7 - 500000 AS v FROM orders)")
def clipped_values(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey", "o_totalprice * 7 - 500000 AS v")
    return rows.withColumn("clipped", clip("v", RATE_BOUNDS))


@check(query(
    "SELECT t.raw, t.label, count(*) AS n FROM (SELECT f.label AS raw, t.label FROM clean f JOIN train t USING (row_a, row_b, row_c, row_d, row_e) "
    "GROUP BY f.label, t.label) t JOIN flowrows g ON g.label = t.raw GROUP BY 1, 2", "train"
))
def label_classes(spark, sf):
    return flows(spark, sf).groupBy(F.col("label").alias("raw")).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "label", normalise_label("raw")
    )


@check(query("SELECT label, count(*) AS n FROM train GROUP BY 1", "train"))
def label_distribution(spark, sf):
    return tr.label_counts(_train(spark, sf))


@check(query(
    "SELECT label, count(*) AS n FROM (SELECT label FROM train UNION ALL SELECT label FROM train WHERE label <> 'Normal') GROUP BY 1", "train"
))
def union_of_inputs(spark, sf):
    rows = _train(spark, sf)
    return tr.label_counts(rows.unionByName(rows.filter("label <> 'Normal'")))


@check(query(f"SELECT {_KEYS}, {_VALUES} FROM train ORDER BY {_HASH}, {_KEYS} LIMIT 5000", "train"))
def rows_capped(spark, sf):
    return tr.cap_rows(_train(spark, sf), 5000, _KEY)


@check(query(
    f"""SELECT {_KEYS}, {_VALUES} FROM (SELECT *, row_number() OVER (ORDER BY {_HASH}, {_KEYS}) AS rn FROM train WHERE label = 'Normal')
      WHERE rn <= (SELECT count(*) FROM train WHERE label <> 'Normal') * 3
      UNION ALL SELECT {_KEYS}, {_VALUES} FROM train WHERE label <> 'Normal'""", "train"
))
def rows_rebalanced(spark, sf):
    return tr.rebalance(_train(spark, sf), 3, _KEY)


@check(query(
    f"""SELECT {_KEYS}, {_VALUES} FROM (SELECT *, row_number() OVER (ORDER BY {_HASH}, {_KEYS}) AS rn FROM train WHERE label = 'Normal')
      WHERE rn <= (SELECT count(*) FROM train WHERE label <> 'Normal')
      UNION ALL SELECT {_KEYS}, {_VALUES} FROM train WHERE label <> 'Normal'""", "train"
))
def rows_rebalanced_evenly(spark, sf):
    return tr.rebalance(_train(spark, sf), 1, _KEY)


@check(query(
    f"""SELECT {_KEYS}, {_VALUES}, row_number() OVER (PARTITION BY label ORDER BY {_HASH}, {_KEYS})
      <= ceil(0.2::DOUBLE * count(*) OVER (PARTITION BY label)) AS is_test FROM train""", "train"
))
def rows_split(spark, sf):
    return tr.stratified_split(_train(spark, sf), key=_KEY)


@check(query(
    "SELECT label, n, (sum(n) OVER ())::DOUBLE / (count(*) OVER () * n)::DOUBLE AS weight FROM (SELECT label, count(*) AS n FROM train GROUP BY 1)", "train"
))
def class_weight_table(spark, sf):
    return tr.class_weights(_train(spark, sf))


_ISOLATION = IsolationSettings()
# A small forest keeps the check quick; it still sees every row. The defaults take 163 s at scale 0.01.
_FOREST = ForestSettings(trees=8, depth=8)


@check()
def isolation_scores(spark, sf):
    rows = _train(spark, sf)
    model = train_isolation_forest(rows.filter("label = 'Normal'"), _ISOLATION, _KEY)
    return score_isolation(rows, model).select(*_KEY, "label", F.round("raw_score", 9).alias("raw_score"), "is_anomaly")


# Trees of three levels over cut-offs of the training rows: node i of tree t splits feature (t + i) % 5 at the
# rows' quantile (1 + (3 * t + 7 * i) % 9) / 10.
_TREES, _INNER = 20, 7


def _tenths(rows) -> list[list[float]]:
    """The nine tenths of each training feature, as `percentile_disc` gives them, ranked over many tasks."""
    ranges = rows.agg(*[f(c) for c in TRAINING_FEATURES for f in (F.min, F.max)]).first()
    values = []
    for i, c in enumerate(TRAINING_FEATURES):
        low, high = ranges[2 * i], ranges[2 * i + 1]
        block = F.floor((F.col(c) - low) / (high - low) * 4096) if high is not None and high > low else F.lit(0)
        values.append(F.struct(F.lit(i).alias("feature"), F.col(c).cast("double").alias("value"), block.cast("bigint").alias("block")))
    single = rows.select(F.explode(F.array(*values)).alias("v")).select("v.*").filter("value IS NOT NULL")
    counted = single.groupBy("feature", "block", "value").agg(F.count(F.lit(1)).alias("n"))
    ranked = positions(counted, ["feature"], F.col("block"), ["value"], "rank", total="size", copies="n")
    tenth = ranked.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(9)))).withColumn("due", F.expr("(size * k + 9) div 10"))
    hits = tenth.filter("due >= rank AND due < rank + n").select("feature", "k", "value").collect()
    found = {(r.feature, r.k): r.value for r in hits}
    return [[found[i, k] for k in range(1, 10)] for i in range(len(TRAINING_FEATURES))]


def _ruled_model(rows) -> IsolationModel:
    spark = rows.sparkSession
    found = _tenths(rows)
    nodes = []
    for t in range(_TREES):
        for i in range(2 * _INNER + 1):
            depth, inner = (i + 1).bit_length() - 1, i < _INNER
            split = found[(t + i) % 5][(3 * t + 7 * i) % 9] if inner else 0.0
            children = (2 * i + 1, 2 * i + 2) if inner else (-1, -1)
            nodes.append((t, i, (t + i) % 5 if inner else -1, float(split), *children, depth, 1 + (t + 3 * i) % 40))
    return IsolationModel(spark.createDataFrame(nodes, NODE_SCHEMA), 256, -0.5, tuple(TRAINING_FEATURES))


def _descent_sql() -> str:
    marks = ", ".join(f"quantile_disc({c}, {k / 10}) AS {c}_{k - 1}" for c in TRAINING_FEATURES for k in range(1, 10))
    cuts = "[" + ", ".join("[" + ", ".join(f"{c}_{k}" for k in range(9)) + "]" for c in TRAINING_FEATURES) + "]"
    path = """CASE WHEN size > 2 THEN 2.0::DOUBLE * (ln(size - 1.0::DOUBLE) + 0.5772156649015329::DOUBLE) - 2.0::DOUBLE * (size - 1.0::DOUBLE) / size
      WHEN size = 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"""
    return query(
        f"""SELECT {_KEYS}, label, round(-pow(2, -avg(3 + {path}) / (2.0::DOUBLE * (ln(255.0::DOUBLE) + 0.5772156649015329::DOUBLE) - 2.0::DOUBLE * 255 / 256)), 9) AS raw_score,
          -pow(2, -avg(3 + {path}) / (2.0::DOUBLE * (ln(255.0::DOUBLE) + 0.5772156649015329::DOUBLE) - 2.0::DOUBLE * 255 / 256)) < -0.5 AS is_anomaly
        FROM (SELECT *, 1 + (t + 3 * node) % 40 AS size FROM down WHERE node >= {_INNER}) GROUP BY place, {_KEYS}, label""",
        "train", recursive=True,
        marks=f"SELECT {cuts} AS cut FROM (SELECT {marks} FROM train)",
        numbered=f"SELECT row_number() OVER () AS place, *, [{', '.join(TRAINING_FEATURES)}] AS x FROM train",
        down=f"""SELECT place, {_KEYS}, label, x, t, 0 AS node FROM numbered, range({_TREES}) trees(t)
          UNION ALL SELECT place, {_KEYS}, label, x, t, CASE WHEN x[1 + (t + node) % 5] <= cut[1 + (t + node) % 5][1 + (3 * t + 7 * node) % 9] THEN 2 * node + 1 ELSE 2 * node + 2 END
          FROM down, marks WHERE node < {_INNER}""",
    )


@check(_descent_sql())
def isolation_descent(spark, sf):
    """Scores by a node table that both engines can lay out: saved, read again, walked."""
    rows = _train(spark, sf)
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    save_isolation(_ruled_model(rows), path)
    return score_isolation(rows, load_isolation(spark, path)).select(*_KEY, "label", F.round("raw_score", 9).alias("raw_score"), "is_anomaly")


def _stored(df):
    """The rows, written once to the shared folder: the next step reads them several times."""
    return df.sparkSession.read.schema(df.schema).parquet(stored(df))


@check()
def classifier_labels(spark, sf):
    balanced = _stored(tr.rebalance(_stored(_train(spark, sf)), key=_KEY))
    split = _stored(tr.stratified_split(balanced, key=_KEY).select(*TRAINING_FEATURES, "label", "is_test"))
    model = train_classifier(split.filter("not is_test"), _FOREST)
    return score_classifier(split.filter("is_test"), model).groupBy("label", "class_label").agg(F.count(F.lit(1)).alias("n"))


@check()
def trained_models_report(spark, sf):
    return train_models(flows(spark, sf), _KEY, _ISOLATION, _FOREST).report


@check()
def model_scored_packets(spark, sf):
    models = train_models(flows(spark, sf), _KEY, _ISOLATION, _FOREST)
    scored = model_scorer(models.isolation, models.classifier)(packet_features(packets(spark, sf)))
    return scored.groupBy("ml_label").agg(F.count(F.lit(1)).alias("packets"), F.max("ml_score").alias("top_score"))


_RAW = """SELECT event_id, -value / (value + 40) AS raw_score, value > 60 AS is_anomaly,
  CASE event_type WHEN 'click' THEN 'Normal' WHEN 'view' THEN NULL ELSE event_type END AS class_label FROM events"""


@check(
    f"""SELECT event_id, floor(CASE WHEN ml_label <> 'Normal' THEN greatest(base, 0.6::DOUBLE) ELSE base END * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS ml_score,
      ml_label FROM (SELECT *, coalesce(class_label, 'Normal') AS ml_label,
        CASE WHEN is_anomaly THEN least(1.0::DOUBLE, greatest(0.5::DOUBLE, raw_score * -2.0::DOUBLE)) ELSE 0.0::DOUBLE END AS base FROM ({_RAW}))"""
)
def combined_scores(spark, sf):
    rows = table(spark, sf, "events").selectExpr(
        "event_id", "-value / (value + 40) AS raw_score", "value > 60 AS is_anomaly",
        "CASE event_type WHEN 'click' THEN 'Normal' WHEN 'view' THEN NULL ELSE event_type END AS class_label",
    )
    return combine_scores(rows).select("event_id", "ml_score", "ml_label")


@check(query("SELECT count(*) AS samples, count(*) FILTER (actual = pred)::DOUBLE / count(*) AS accuracy FROM labelled", "labelled"))
def prediction_accuracy(spark, sf):
    return ev.accuracy(labelled(spark, sf))


@check("SELECT count(*) AS samples, count(*) FILTER (quality = toxic)::DOUBLE / count(*) AS accuracy FROM labels")
def label_agreement(spark, sf):
    return ev.accuracy(table(spark, sf, "labels").selectExpr("quality AS actual", "toxic AS pred"))


@check(query("SELECT count(*) AS samples FROM labelled", "labelled"))
def prediction_sample_count(spark, sf):
    return ev.prediction_count(labelled(spark, sf))


_REPORT = {
    "names": "SELECT actual AS label FROM labelled UNION SELECT pred FROM labelled",
    "sums": """SELECT label, (SELECT count(*) FROM labelled WHERE actual = label) AS support,
      (SELECT count(*) FROM labelled WHERE pred = label) AS predicted, (SELECT count(*) FROM labelled WHERE pred = label AND actual = label) AS hits FROM names""",
    "pr": """SELECT label, support, hits, CASE WHEN predicted > 0 THEN hits::DOUBLE / predicted ELSE 0 END AS p,
      CASE WHEN support > 0 THEN hits::DOUBLE / support ELSE 0 END AS r FROM sums""",
    "cls": "SELECT label, p AS precision, r AS recall, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1, support, hits FROM pr",
}
_ROUNDED = ", ".join(f"round({c}, 9) AS {c}" for c in ("precision", "recall", "f1"))


@check(query(
    f"""SELECT label, {_ROUNDED}, support FROM (SELECT label, precision, recall, f1, support FROM cls
      UNION ALL SELECT 'accuracy', sum(hits)::DOUBLE / sum(support), sum(hits)::DOUBLE / sum(support), sum(hits)::DOUBLE / sum(support), CAST(sum(support) AS BIGINT) FROM cls
      UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM cls
      UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support),
        CAST(sum(support) AS BIGINT) FROM cls)""", "labelled", **_REPORT
))
def class_report(spark, sf):
    return ev.classification_report(labelled(spark, sf)).withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@check(query(
    """SELECT a.label AS actual, b.label AS pred, (SELECT count(*) FROM labelled l WHERE l.actual = a.label AND l.pred = b.label) AS n
      FROM names a, names b""", "labelled", names=_REPORT["names"]
))
def confusion_counts(spark, sf):
    return ev.confusion_matrix(labelled(spark, sf))
