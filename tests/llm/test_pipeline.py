import re

import corpus_pipeline as pipeline
from packetlens.llm import packing, secrets, toxicity

from .conftest import SF
from .test_duplicates import exact_by_hand, linked_by_hand
from .test_packing import PATH, check_places, pieces_by_hand
from .test_secrets import by_hand


def redacted_by_hand(text, spans):
    out, at = "", 0
    for a, b, _ in spans:
        if a >= at:
            out += text[at:a] + "[secret]"
        at = max(at, b)
    return out + text[at:]


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_every_stage_against_brute_force(spark, docs):
    frame = docs[0]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rejected = {r.doc_id for r in toxicity.toxicity(frame, labels).collect() if r.rejected}
    kept = pipeline.reject_toxic(spark, frame, SF)
    assert kept.columns == frame.columns
    assert rows_of(kept) == sorted((tuple(r) for r in docs[1] if r.doc_id not in rejected), key=str)
    rows = frame.collect()
    stays = {r[0] for r in exact_by_hand(rows) if r[3]}
    assert rows_of(pipeline.drop_exact(spark, frame, SF)) == sorted((tuple(r) for r in rows if r.doc_id in stays), key=str)
    first = {c for _, _, c in linked_by_hand(rows)}
    assert rows_of(pipeline.drop_near(spark, frame, SF)) == sorted((tuple(r) for r in rows if r.doc_id in first), key=str)
    clean = {r.doc_id: r.text for r in pipeline.redact_secrets(spark, frame, SF).collect()}
    spans = {r.doc_id: [(s.start, s.stop, s.kind) for s in r.spans] for r in secrets.scan_secrets(frame).collect()}
    for r in rows:
        assert set(by_hand(r.text)) <= set(spans[r.doc_id])
        assert clean[r.doc_id] == redacted_by_hand(r.text, spans[r.doc_id])
    packed = pipeline.pack_sequences(spark, frame, SF).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed), key=str) == pieces_by_hand(rows, 2048)
    check_places(packed, packing.Bins())
    assert PATH


def test_run_chains_the_stages(spark):
    docs = pipeline.documents(spark, SF)
    for _, stage in pipeline.STAGES[:-1]:
        docs = pipeline.stored(stage(spark, docs, SF))
    want = sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in pipeline.STAGES[-1][1](spark, docs, SF).collect())
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in pipeline.run(spark, SF).collect()) == want
    assert [name.split()[0] for name, _ in pipeline.STAGES] == ["toxicity", "exact", "simhash", "secret", "best-fit"]


def test_odd_rows_and_empty_tables(spark, odd, empty):
    columns = pipeline.COLUMNS
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, odd, SF).columns == columns
        assert stage(spark, empty, SF).collect() == []
    texts = [r.text for r in pipeline.drop_exact(spark, odd, SF).collect()]
    same = [t for t in texts if t and re.sub(r"\s", "", t) == "sametexthere"]
    assert same == ["same  text\there"]  # the longest; equal rows and the null id went
    assert pipeline.redact_secrets(spark, odd, SF).count() == odd.count()
    assert pipeline.pack_sequences(spark, empty, SF).collect() == []
    one = spark.createDataFrame([(3, "a b", "en", "s", 3)] * 3, odd.select(columns).schema)
    assert pipeline.drop_exact(spark, one, SF).count() == 1


def test_each_row_takes_its_own_verdict(spark, monkeypatch):
    """Rows without an id, or with a shared one, do not go or stay together."""
    rows = [(None, "a fine day " * 9), (None, "you idiot"), (7, "a calm night " * 9), (7, "stupid idiot"), (None, "a fine  day " * 9), (None, "a calm night" * 2)]
    rows += [(None, " ".join(f"w{i}" for i in range(200))), (None, " ".join(f"w{i}" for i in range(200)) + " W199"), (7, "a  calm night " * 9)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")

    model = toxicity.Model(toxicity.Settings())
    model.words[:] = 0
    model.words[toxicity.word_ids([b"idiot"], model.settings.buckets)[0]] = 1
    for weights in (*model.filters, model.out):
        weights[...] = 1
    monkeypatch.setattr(toxicity, "train", lambda *a: (model, {None: 0.5}))
    kept = pipeline.stored(pipeline.reject_toxic(spark, docs, SF))
    assert rows_of(kept.select("doc_id", "text")) == sorted((r for r in rows if "idiot" not in r[1]), key=str)
    left = pipeline.stored(pipeline.drop_exact(spark, kept, SF))
    want = [rows[4], rows[8], rows[5], rows[6], rows[7]]
    assert rows_of(left.select("doc_id", "text")) == sorted(want, key=str)
    same = left.select("doc_id", "text").union(spark.createDataFrame([rows[4]] * 2, "doc_id long, text string"))
    assert pipeline._one_of_each(*_grouped_by_text(same)).count() == 5
    near = {r.text for r in pipeline.STAGES[2][1](spark, left, SF).collect()}
    assert len(near & {rows[6][1], rows[7][1]}) == 1 and {rows[4][1], rows[8][1], rows[5][1]} <= near


def _grouped_by_text(frame):
    from pyspark.sql import functions as F

    more = frame.select("*", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("bigint").alias("n_chars"))
    keyed = pipeline._keyed(more)
    return keyed, keyed.select(*pipeline.KEY, F.col("text").alias("group"), F.lit(0).alias("place"))
