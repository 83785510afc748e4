import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from packetlens.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_texts_equal_the_library(library):
    rnd, own = random.Random(7), bpe.Codec(PATH, keep=100)
    alphabets = ["abstvmdrel' \n", "a1² _'!.\t\r\n  é", "漢ñ\xa0 　́x0Ⅷ٣'s \U0001f600\0\x85", "'ll're've's't "]
    texts = ["".join(rnd.choices(rnd.choice(alphabets), k=rnd.randint(0, 60))) for _ in range(4000)]
    texts += ["", " ", "\n", "  ", " \n a", "don't we'll they've 'tis ''s !'s \n's 's's'll", "x" * 200 + "yz" * 100, "the " * 5000]
    for part in range(0, len(texts), 500):
        some = texts[part : part + 500]
        assert own.encode(some) == [library.encode_ordinary(t) for t in some]


def test_every_code_point(library):
    own = bpe.Codec(PATH)
    for start in range(0, 0x30000, 0x1000):
        text = " ".join(f"{chr(p)}a{chr(p)}1{chr(p)}" for p in range(start, start + 0x1000) if not 0xD800 <= p < 0xE000)
        assert own.decode(own.encode([text])[0]) == text.encode()


def test_long_slices_merge_alike(library):
    rnd, own = random.Random(8), bpe.Codec(PATH)
    for n in (65, 100, 3000):
        text = "".join(rnd.choices("etaonith", k=n))
        assert own.encode([text]) == [library.encode_ordinary(text)]


def test_documents_and_odd_rows(library, docs, odd, empty):
    for frame in (docs[0], odd):
        want = []
        for r in frame.collect():
            ids = library.encode_ordinary(r.text or "")
            want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
        assert sorted(map(tuple, bpe.round_trips(frame, PATH).collect()), key=str) == sorted(want, key=str)
    assert bpe.round_trips(empty, PATH).collect() == []


def test_offsets_cut_the_text(odd):
    coded = bpe.encode_documents(odd, PATH)
    texts = sorted((r.text or "").encode() for r in odd.collect())
    assert sorted(bytes(r.text) for r in bpe.decode_documents(coded, PATH).collect()) == texts
    own = bpe.codec(PATH)
    for r in coded.collect():
        text = own.decode(r.ids)
        assert all(own.tokens[i] == text[a:b] for i, a, b in zip(r.ids, r.offsets, r.offsets[1:], strict=False))
        assert r.offsets[-1] == len(text)


def test_scan_does_not_depend_on_blocks(monkeypatch):
    points = np.array([ord(c) for c in "a'll b! 12  c" * 300 + "\0"], np.uint32)
    ends = np.array([len(points) - 1])
    want = bpe.slice_starts(points, ends).tolist()
    for size in (1, 7, 100_000):
        monkeypatch.setattr(bpe, "BLOCK", size)
        assert bpe.slice_starts(points, ends).tolist() == want
