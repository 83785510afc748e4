from collections import defaultdict

from pyspark.sql import functions as F

from packetlens.llm import lines

WHITE = " \t\n\x0b\x0c\r"


def by_hand(rows, sites):
    on = defaultdict(set)
    for r in rows:
        for x in (r.text or "").split("\n"):
            if x.strip(WHITE) and r.source is not None:
                on[x.strip(WHITE)].add(r.source)
    bad = {x for x, s in on.items() if len(s) >= sites}
    out = []
    for r in rows:
        if r.text is None:
            out.append((r.doc_id, 0, 0, None))
            continue
        every = r.text.split("\n")
        kept = [x for x in every if x.strip(WHITE) not in bad]
        out.append((r.doc_id, len(every), len(every) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_against_brute_force(docs, odd, empty):
    removed = 0
    for frame, sites in ((docs[0], 8), (docs[0], 2), (odd, 2), (odd, 1)):
        got = sorted(map(tuple, lines.drop_boilerplate(frame, sites).collect()), key=str)
        assert got == by_hand(frame.collect(), sites)
        removed += sum(r[2] for r in got)
    assert removed > 0
    assert lines.drop_boilerplate(empty).collect() == []


def test_near_the_threshold_counts_are_exact(spark):
    rows = [(100 * k + i, f"shared by {n}", f"site{i}") for k, n in enumerate((299, 300, 301, 340, 390, 200)) for i in range(n)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    table = frame.select(*lines._hashes(F.col("text")), F.col("source").alias("site"))
    found = lines.boilerplate(table, 300)
    bad = {r.text for r in frame.select("text", *lines._hashes(F.col("text"))).join(found, ["h1", "h2"]).select("text").distinct().collect()}
    assert bad == {f"shared by {n}" for n in (300, 301, 340, 390)}
