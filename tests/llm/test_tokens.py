"""Token ids against the public libraries."""

import random

import pytest

from citeflow.llm.tokens import PATTERN, TOKENIZERS, PerfectHash, encode, encoder

PATH = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
TEXTS = ["", "Hello  world\n\n it's\t2024", "<|endoftext|>", "naïve — 100 % µg “x” 试验纳入 👩‍🔬", "a" * 3000, "\r\n  ​﻿ x", "ａｂｃ ﬁ ﾃｽﾄ", " leading", "trailing  ", "don'T I'LL we've"]


def test_perfect_hash():
    rng = random.Random(1)
    keys = sorted({bytes(rng.randrange(256) for _ in range(rng.randrange(1, 9))) for _ in range(3000)})
    h = PerfectHash(keys)
    assert [h.find(k) for k in keys] == list(range(len(keys)))
    assert sorted(h.index) == list(range(len(keys)))  # minimal
    assert all(h.find(bytes([i, 255, 255, i, 7, 7, 7, 7, 7, 7])) == -1 for i in range(200))
    assert PerfectHash([]).find(b"x") == -1 and PerfectHash([b"a"]).find(b"a") == 0
    with pytest.raises(ValueError):
        PerfectHash([b"a", b"a"])


def test_ids_match_the_libraries(spark):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    reference.encode_special_tokens = True
    rng = random.Random(7)
    texts = TEXTS + ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x370, 0x1000), rng.randrange(0x4E00, 0x9FA5), 10, 32, 32])) for _ in range(200)) for _ in range(60)]
    want = {i: e.ids for i, e in enumerate(reference.encode_batch(texts, add_special_tokens=False))}
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(1000, None, "x"), (0, "", "x")], "doc_id long, text string, ids string")
    got = [(r.doc_id, r.ids) for r in encode(docs, "doc_id", "text", PATH).collect()]
    assert len(got) == len(texts) + 2 and all(ids == ([] if i == 1000 else want[i]) for i, ids in got)
    assert encode(docs.limit(0), "doc_id", "text", PATH).count() == 0


def test_round_trip():
    import base64

    import regex

    tokens = {int(r): base64.b64decode(t) for t, r in map(bytes.split, open(PATH, "rb"))}
    enc = encoder(PATH)
    for t in TEXTS:
        ids = [i for p in regex.findall(PATTERN, t) for i in enc.piece(p)]
        assert b"".join(tokens[i] for i in ids).decode() == t
