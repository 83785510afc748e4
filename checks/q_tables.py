"""Round trips through files, and scorers supplied by the caller."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from packetlens.operators.training import FLOW_COLUMNS, prepare_training
from packetlens.operators.forest import IsolationSettings, score_isolation, train_isolation_forest
from packetlens.operators.verdict import DETECTION_COLUMNS
from packetlens.plans.detection import detect
from packetlens.session import shared_dir
from packetlens.sources.sinks import load_isolation, save_isolation, write_detections, write_prediction_stream, write_predictions, write_training
from packetlens.sources.tables import read_flow_csv, read_prediction_log, read_training
from packetlens.streaming.detect import stream_detect

from . import sql
from .inputs import flows, labelled, packets
from .q_streams import ROCKSDB, packet_stream
from .registry import check
from .sql import DETECTION, query

_VALUES = "packet_rate, unique_ports, syn_count, avg_packet_size, conn_count, label"


def _home(spark) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def _flow_files(spark, sf) -> str:
    """The labelled flows as CSV files with the headers such files have."""
    path = _home(spark)
    named = flows(spark, sf).select(*[F.col(c).alias(header) for c, header in FLOW_COLUMNS.items()])
    writer = named.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    writer.csv(path)
    return path


@check(query(f"SELECT {_VALUES} FROM train", "train"))
def flow_csv_files(spark, sf):
    return prepare_training(read_flow_csv(spark, _flow_files(spark, sf)))


@check(query("SELECT label, count(*) AS n FROM train GROUP BY 1", "train"))
def flow_csv_labels_by_file(spark, sf):
    rows = read_flow_csv(spark, _flow_files(spark, sf)).withColumn("file", F.input_file_name())
    clean = prepare_training(rows, ["file"])
    return clean.groupBy("file", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("label").agg(F.sum("n").alias("n"))


@check(query(f"SELECT {_VALUES} FROM train", "train"))
def training_table_files(spark, sf):
    path = _home(spark)
    write_training(prepare_training(flows(spark, sf)), path)
    return read_training(spark, f"{path}/labelled")


@check(query(f"SELECT {_VALUES.removesuffix(', label')} FROM train WHERE label = 'Normal'", "train"))
def normal_training_files(spark, sf):
    path = _home(spark)
    write_training(prepare_training(flows(spark, sf)), path, "csv")
    columns = _VALUES.removesuffix(", label").split(", ")
    return spark.read.schema(", ".join(f"{c} double" for c in columns)).option("header", True).csv(f"{path}/normal")


@check(query("SELECT actual, pred FROM labelled", "labelled"))
def prediction_log_files(spark, sf):
    path = _home(spark)
    rows = labelled(spark, sf)
    write_predictions(rows.filter("actual = 'A'"), path)
    write_predictions(rows.filter("actual <> 'A'"), path)
    return read_prediction_log(spark, path)


@check(query("SELECT actual, pred FROM labelled", "labelled"))
def prediction_log_stream(spark, sf):
    """Written by a stream that stops half way and goes on from its checkpoint when more rows have come."""
    home = _home(spark)
    rows = labelled(spark, sf)
    for half in (rows.filter("actual = 'A'"), rows.filter("actual <> 'A'")):
        half.repartition(3).write.mode("append").parquet(f"{home}/in")
        arrived = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{home}/in")
        write_prediction_stream(arrived, f"{home}/log", f"{home}/state", availableNow=True).awaitTermination()
    return read_prediction_log(spark, f"{home}/log")


@check(query(f"SELECT {DETECTION} FROM det", "det"))
def detection_sink(spark, sf):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    home = _home(spark)
    verdicts = stream_detect(packet_stream(spark, sf)).select(*DETECTION_COLUMNS)
    write_detections(verdicts, f"{home}/out", f"{home}/state", availableNow=True).awaitTermination()
    return spark.read.schema(verdicts.schema).parquet(f"{home}/out")


@check()
def isolation_model_files(spark, sf):
    path = _home(spark)
    rows = prepare_training(flows(spark, sf), ["row_a", "row_b", "row_c", "row_d", "row_e"])
    key = ["row_a", "row_b", "row_c", "row_d", "row_e"]
    save_isolation(train_isolation_forest(rows.filter("label = 'Normal'"), IsolationSettings(), key), path)
    scored = score_isolation(rows, load_isolation(spark, path))
    return scored.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_anomaly").alias("anomalies"))


def _plugin(df):
    """A caller's own scorer: vectorised Python over two features."""

    @F.pandas_udf("double")
    def score(ports: pd.Series, rate: pd.Series) -> pd.Series:
        return ((ports > 3) & (rate < 40)).astype(float) * 0.75

    named = df.withColumn("ml_score", score("unique_ports", "packet_rate"))
    return named.withColumn("ml_label", F.when(F.col("syn_count") > 8, "Probe").otherwise("Normal"))


@check(query(
    f"SELECT {DETECTION} FROM verdicts", "feats",
    own="""SELECT *, CASE WHEN unique_ports > 3 AND packet_rate < 40 THEN 0.75::DOUBLE ELSE 0.0::DOUBLE END AS ml_score,
      CASE WHEN syn_count > 8 THEN 'Probe' ELSE 'Normal' END AS ml_label FROM feats""",
    ruled2=sql.rules("own"), verdicts=sql.decide("ruled2"),
))
def detections_with_own_scorer(spark, sf):
    return detect(packets(spark, sf), scorer=_plugin).select(*DETECTION_COLUMNS)
