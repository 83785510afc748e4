import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from packetlens.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def pieces_by_hand(rows, most):
    tokenizer = Tokenizer.from_file(PATH)
    out = []
    for r in rows:
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), most)):
            part = np.array(ids[at : at + most], "<u4")
            out.append((r.doc_id, k, at, len(part), zlib.crc32(part.tobytes())))
    return sorted(out, key=str)


def check_places(found, bins):
    by = defaultdict(list)
    for r in found:
        by[r.sequence_id].append(r)
    for held in by.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= bins.tokens and len(held) <= bins.documents and sum(r.length**2 for r in held) <= bins.cost
    return len(by)


@pytest.mark.parametrize("bins", [packing.Bins(), packing.Bins(256, 4, 40_000), packing.Bins(512, 9, 512 * 512, (1, 1, 1), "dot")])
def test_packing_against_brute_force(docs, odd, empty, bins):
    most = min(bins.tokens, int(bins.cost**0.5))
    for frame in (docs[0], odd):
        found = packing.pack_documents(frame, PATH, bins, rows_per_group=100).collect()
        assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found), key=str) == pieces_by_hand(frame.collect(), most)
        check_places(found, bins)
    assert packing.pack_documents(empty, PATH, bins).collect() == []


def test_few_sequences(docs):
    found = packing.pack_documents(docs[0], PATH).collect()
    least = -(-sum(r.length for r in found) // 2048)
    assert check_places(found, packing.Bins()) <= least + 2


def test_best_fit_closes_and_reopens():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 2048, 3000)
    for rule in ("norm", "dot"):
        where, offset = packing.best_fit(lengths, packing.Bins(rule=rule))
        held = np.bincount(where, lengths)
        assert held.max() <= 2048 and len(held) <= 1.01 * lengths.sum() / 2048 + 1
        assert len(set(zip(where.tolist(), offset.tolist(), strict=True))) == 3000


def test_a_count_below_one_is_an_error():
    with pytest.raises(ValueError):
        packing.best_fit(np.array([5]), packing.Bins(documents=0))


def test_word_ids_equal_the_tokenizer(docs):
    import random

    rnd, tokenizer, own = random.Random(1), Tokenizer.from_file(PATH), packing.WordIds(PATH, keep=50)
    alphabet = "abZÉßµªº²½Ⅷ٣漢é\u0301ſK'´!_-#.0 9\t\x1c\x85\xa0\u2003\U0001f600srtdvelm"
    texts = ["".join(rnd.choices(alphabet, k=rnd.randint(0, 40))) for _ in range(3000)] + [r.text or "" for r in docs[1]]
    want = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert own([t.encode() for t in texts]) == want
