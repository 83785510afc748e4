import datetime

import pytest
from helpers import START, table
from pyspark.sql import functions as F

from packetlens.functions.labels import LABEL_CLASSES, bin_port, normalise_label
from packetlens.operators import evaluate as ev
from packetlens.operators import training as tr
from packetlens.operators.classifier import ForestSettings, score_classifier
from packetlens.operators.forest import IsolationSettings, _quantile, mean_path, score_isolation, train_isolation_forest, tree_samples
from packetlens.plans.training import model_scorer, train_models
from packetlens.sources.sinks import (
    load_classifier, load_isolation, save_classifier, save_isolation, write_predictions, write_training,
)
from packetlens.sources.tables import read_flow_csv, read_prediction_log, read_training

HEADER = " Destination Port, Flow Duration, Total Fwd Packets, Flow Packets/s, SYN Flag Count, Average Packet Size, Label"


def test_flow_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + "\n80,1,5,10.5,1,60.0,BENIGN\n9999,1,200000,Infinity,1,60,DDoS\n10000,1,200000,-3,900,2000, PortScan \n")
    (tmp_path / "b.csv").write_text(HEADER + "\n1024,1,5,1,0,,Bot\n65535,1,5,NaN,0,1,Bot\n65535,1,5,2000000,0,1,New kind\n")
    rows = read_flow_csv(spark, str(tmp_path))
    assert rows.count() == 6
    clean = tr.prepare_training(rows)
    assert table(clean, *clean.columns) == [
        (0.0, 5.0, 500.0, 1518.0, 100000.0, "PortScan"), (10.5, 1.0, 1.0, 60.0, 5.0, "Normal"),
        (1000000.0, 10.0, 0.0, 1.0, 5.0, "Other"),
    ]
    per_file = tr.label_counts(rows, by_file=True)
    assert per_file.filter("file LIKE '%a.csv'").count() == 3


def test_flow_files_of_other_column_orders(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + "\n80,1,5,10.5,1,60.0,BENIGN\n")
    names = HEADER.split(",")
    (tmp_path / "b.csv").write_text(",".join(reversed(names)) + "\nBot,70.0,2,20.5,6,1,443\n")
    (tmp_path / "c.csv").write_text("")
    rows = read_flow_csv(spark, str(tmp_path))
    assert table(rows, "label", "packet_rate") == [("BENIGN", 10.5), ("Bot", 20.5)]


def test_trees_take_their_rows_alike_at_every_size(spark):
    settings = IsolationSettings(trees=10, sample=10)
    for n in (99, 100, 101):
        rows = spark.range(n).selectExpr("id", "cast(id as double) AS v")
        drawn = tree_samples(rows, settings, ["id"], ["v"])
        assert [r[1] for r in table(drawn.groupBy("tree").count(), "tree", "count")] == [10] * 10
        assert drawn.select("id").distinct().count() < 90  # trees overlap, whatever the size


def test_every_label_and_port_edge(spark):
    labels = [*LABEL_CLASSES.items(), (" BENIGN ", "Normal"), ("Web Attack XSS", "Other"), (None, "Other")]
    df = spark.createDataFrame(labels, "raw string, want string")
    assert df.filter(normalise_label("raw") == F.col("want")).count() == len(labels)
    ports = [(1023.0, 1.0), (1024.0, 3.0), (9999.0, 3.0), (10000.0, 5.0), (65535.0, 10.0)]
    df = spark.createDataFrame(ports, "p double, want double")
    assert df.filter(bin_port("p") == F.col("want")).count() == len(ports)


def planted(spark, n=1500):
    """Quiet traffic, a scan and a flood."""
    kind = F.when(F.col("id") % 10 == 0, "PortScan").when(F.col("id") % 10 == 1, "DoS Hulk").otherwise("BENIGN")
    noise = [F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1000.0 for i in range(4)]
    flood = F.when(kind == "DoS Hulk", 50).otherwise(1)  # beyond the usual range in every feature
    return spark.range(n).repartition(4).select(
        "id", kind.alias("label"), (flood * (10 + noise[0] * 10)).alias("packet_rate"),
        F.when(kind == "PortScan", 60000.0).otherwise(80.0).alias("dst_port"),
        (flood * noise[1] * 3).alias("syn_count"), (flood * (100 + noise[2] * 50)).alias("avg_packet_size"),
        (flood * (5 + noise[3] * 10)).alias("conn_count"),
    )


def test_sampling_is_exact_and_ignores_partitions(spark):
    rows = tr.prepare_training(planted(spark), ["id"])
    capped = tr.cap_rows(rows, 300, ["id"])
    assert capped.count() == 300
    assert table(capped, "id") == table(tr.cap_rows(rows.repartition(7), 300, ["id"]), "id")
    assert tr.cap_rows(rows, 10_000, ["id"]).count() == 1500
    assert {r.label: r.n for r in tr.label_counts(tr.rebalance(rows, 3, ["id"])).collect()} == {"Normal": 900, "DoS": 150, "PortScan": 150}
    split = tr.stratified_split(rows, key=["id"])
    assert {r.label: r["count"] for r in split.filter("is_test").groupBy("label").count().collect()} == {"Normal": 240, "DoS": 30, "PortScan": 30}
    assert {r.label: r.weight for r in tr.class_weights(rows).collect()}["DoS"] == 1500 / (3 * 150)


def test_training_round_trip(spark, tmp_path):
    rows = tr.prepare_training(planted(spark, 100))
    for kind in ("parquet", "csv"):
        write_training(rows, str(tmp_path / kind), kind)
        assert table(read_training(spark, str(tmp_path / kind / "labelled"), kind), *rows.columns) == table(rows, *rows.columns)
        assert read_training(spark, str(tmp_path / kind / "normal"), kind).filter("label IS NULL").count() == 80


def test_isolation_forest(spark, tmp_path):
    assert float(mean_path(2)) == 1.0 and float(mean_path(1)) == 0.0 and 10.2 < float(mean_path(256)) < 10.3
    rows = tr.prepare_training(planted(spark), ["id"])
    normal = rows.filter("label = 'Normal'")
    settings = IsolationSettings(trees=40, sample=64)
    model = train_isolation_forest(normal, settings, ["id"])
    assert model.nodes.groupBy("tree").agg(F.max("size").alias("n")).select("n").distinct().collect() == [(64,)]
    again = train_isolation_forest(normal.repartition(9), settings, ["id"])
    assert again.offset == model.offset
    assert table(model.nodes, "tree", "node", "split") == table(again.nodes, "tree", "node", "split")
    scored = score_isolation(rows, model)
    caught = {r.label: r.share for r in scored.groupBy("label").agg(F.avg(F.col("is_anomaly").cast("int")).alias("share")).collect()}
    assert caught["Normal"] <= 0.02 and caught["DoS"] > 0.9
    save_isolation(model, str(tmp_path / "iso"))
    loaded = load_isolation(spark, str(tmp_path / "iso"))
    assert table(score_isolation(rows, loaded), "id", "raw_score") == table(scored, "id", "raw_score")


def test_enough_rows_are_dealt_out_to_trees(spark):
    rows = tr.prepare_training(planted(spark), ["id"])
    model = train_isolation_forest(rows, IsolationSettings(trees=10, sample=50), ["id"])
    roots = model.nodes.filter("node = 0").select("size").collect()
    assert [r.size for r in roots] == [50] * 10


def test_models_end_to_end(spark, tmp_path):
    models = train_models(planted(spark), ["id"], IsolationSettings(trees=20, sample=64), ForestSettings(trees=5, depth=4))
    report = {r.label: r for r in models.report.collect()}
    assert report["accuracy"].f1 > 0.95 and report["PortScan"].support == 30
    save_classifier(models.classifier, str(tmp_path / "rf"))
    again = load_classifier(str(tmp_path / "rf"))
    rows = tr.prepare_training(planted(spark), ["id"])
    assert table(score_classifier(rows, again), "id", "class_label") == table(score_classifier(rows, models.classifier), "id", "class_label")
    feats = rows.withColumnRenamed("conn_count", "connection_count")
    scored = model_scorer(models.isolation, again)(feats)
    assert scored.columns == [*feats.columns, "ml_score", "ml_label"]
    assert scored.filter("label = 'DoS' AND ml_label = 'DoS' AND ml_score >= 0.6").count() > 140


def predictions(spark, pairs):
    return spark.createDataFrame(pairs, "actual string, pred string")


def test_report_and_matrix(spark):
    df = predictions(spark, [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("c", "a")] + [("b", "d")])
    got = {r.label: r for r in ev.classification_report(df).collect()}
    assert (got["a"].precision, got["a"].recall, got["a"].support) == (0.75, 0.75, 4)
    assert (got["c"].precision, got["c"].recall, got["c"].f1, got["c"].support) == (0.0, 0.0, 0.0, 1)
    assert (got["d"].support, got["d"].precision) == (0, 0.0)
    assert got["accuracy"].f1 == pytest.approx(5 / 8) and got["macro avg"].recall == pytest.approx((0.75 + 2 / 3) / 4)
    assert got["weighted avg"].recall == pytest.approx(5 / 8)
    cells = {(r.actual, r.pred): r.n for r in ev.confusion_matrix(df).collect()}
    assert len(cells) == 16 and cells["a", "b"] == 1 and cells["d", "d"] == 0
    assert ev.accuracy(df).first().accuracy == 5 / 8 and ev.prediction_count(df).first().samples == 8


def test_prediction_log(spark, tmp_path):
    path = str(tmp_path / "log")
    write_predictions(predictions(spark, [("NORMAL", "SYN_FLOOD")]), path)
    write_predictions(predictions(spark, [("ATTACK", "ATTACK")]), path)
    (tmp_path / "log" / "more.txt").write_text("started\nACTUAL=NORMAL\nPRED=ATTACK ACTUAL=PORT_SCAN\n")
    assert table(read_prediction_log(spark, path), "actual", "pred") == [
        ("ATTACK", "ATTACK"), ("NORMAL", "SYN_FLOOD"), ("PORT_SCAN", "ATTACK"),
    ]


def test_masses_of_copies_are_split_exactly(spark):
    rows = [(1.0, "Normal")] * 700 + [(2.0, "Normal")] * 5 + [(float(i), "DoS") for i in range(100)]
    df = spark.createDataFrame(rows, "v double, label string").repartition(3)
    for n in (1, 650, 800, 5000):
        assert tr.cap_rows(df, n).count() == min(n, 805)
    split = tr.stratified_split(df)
    assert {r.label: r["count"] for r in split.filter("is_test").groupBy("label").count().collect()} == {"Normal": 141, "DoS": 20}
    assert table(split, "v", "label") == sorted(rows)
    assert tr.rebalance(df, 3).filter("label = 'Normal'").count() == 300
    assert tr.add_class_weights(df).filter("label = 'DoS'").first().weight == 805 / 200


def test_exact_quantile(spark):
    from packetlens.session import shared_dir

    shared_dir(spark)
    values = [-(i * 37 % 101) / 101 for i in range(101)] + [-0.5] * 60
    df = spark.createDataFrame([(v,) for v in values], "raw_score double").repartition(3)
    for q in (0.0, 0.01, 0.37, 0.5, 1.0):
        assert _quantile(df, q) == pytest.approx(df.agg(F.percentile("raw_score", q)).first()[0], abs=1e-12)


def test_a_split_moves_only_the_prefix_in_which_test_rows_end(spark):
    rows = spark.range(0, 2000, 1, 4).select("id", F.expr("IF(id % 3 = 0, NULL, id % 3)").alias("label"), F.spark_partition_id().alias("p"))
    got = tr.stratified_split(rows, key=["id"]).withColumn("q", F.spark_partition_id()).collect()
    assert sorted(r.id for r in got) == list(range(2000))
    for label, n in ((None, 667), (1, 667), (2, 666)):
        of = [r for r in got if r.label == label]
        assert (len(of), sum(r.is_test for r in of)) == (n, 134)
    assert sum(r.p == r.q for r in got) > 1900


def test_tenths_are_those_of_percentile_disc(spark):
    from checks.q_models import TRAINING_FEATURES, _tenths

    rows = spark.range(137).select(*[F.expr(f"CAST(IF(id % 11 = 0, NULL, id * id % {31 + i}) AS DOUBLE)").alias(c) for i, c in enumerate(TRAINING_FEATURES)])
    marks = [F.expr(f"percentile_disc({k / 10}) WITHIN GROUP (ORDER BY {c})") for c in TRAINING_FEATURES for k in range(1, 10)]
    flat = list(rows.agg(*[m.alias(f"m{i}") for i, m in enumerate(marks)]).first())
    assert _tenths(rows) == [flat[9 * i : 9 * i + 9] for i in range(5)]


def test_class_weights_of_a_split_are_stored(spark):
    from packetlens.session import shared_dir

    shared_dir(spark)
    train = tr.stratified_split(tr.prepare_training(planted(spark, 300), ["id"]), key=["id"]).filter("not is_test")
    weighted = tr.add_class_weights(train).checkpoint()  # Catalyst failed while the weights had a subquery of their own
    assert table(weighted.groupBy("label", "weight").count(), "label", "weight", "count") == [
        ("DoS", 240 / (3 * 24), 24), ("Normal", 240 / (3 * 192), 192), ("PortScan", 240 / (3 * 24), 24)
    ]


def test_classifier_labels_counts_every_held_out_row(spark, tmp_path):
    from checks.inputs import flows
    from checks.q_models import classifier_labels

    spark.range(900).selectExpr(
        "id AS l_orderkey", "CAST(id % 7 AS INT) AS l_linenumber", "id AS l_partkey", "id % 50 AS l_suppkey",
        "CAST(1 + id % 50 AS DOUBLE) AS l_quantity", "CAST(900 + id * 7 % 5000 AS DOUBLE) AS l_extendedprice",
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    train = tr.prepare_training(flows(spark, str(tmp_path)))
    held = {r.label: -(-r.n // 5) for r in tr.label_counts(train).collect()}
    got = classifier_labels(spark, str(tmp_path)).groupBy("label").agg(F.sum("n").alias("n")).collect()
    assert {r.label: r.n for r in got} == held and len(held) > 5
