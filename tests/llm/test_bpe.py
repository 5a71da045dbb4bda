import random

import pytest

from dhwani.llm import bpe

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")


def texts():
    r = random.Random(1)
    odd = ["", "a" * 500, "aaaa" * 7 + " " * 9 + "\n\n\t x", "<|endoftext|>", "x<|endoftext|> y <|endoftext|", "don't I'LL we'Ve", "\x1c x\x85y ​　", "😀😀 ñandú ÀÉ ¼²"]
    pick = lambda: r.choice([r.randrange(32, 127), r.randrange(128, 0x2FFF), r.randrange(0x10000, 0x1F9FF), 32, 10])
    return odd + ["".join(chr(pick()) for _ in range(50)) for _ in range(400)] + [" " + chr(c) + "a" for c in range(0, 0x3000)]


def test_same_as_the_library(rows):
    path = P.path("byte_bpe_50k.json")
    data = texts()
    want = [e.ids for e in tokenizers.Tokenizer.from_file(path).encode_batch(data, add_special_tokens=False)]
    got = {r.doc_id: r for r in bpe.encoded(rows(list(enumerate(data))), path).collect()}
    for i, ids in enumerate(want):
        assert got[i].ids == b"".join(x.to_bytes(4, "little") for x in ids)
        assert got[i].n_tokens == len(ids)
        assert got[i].decoded == data[i]


def test_edges(rows):
    path = P.path("byte_bpe_50k.json")
    assert bpe.digests(rows([]), path).count() == 0
    a, b = bpe.digests(rows([(1, None), (None, "")]), path).collect()
    assert (a.n_tokens, a.ids_sha256) == (0, b.ids_sha256)


def test_forgetting(monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN", 3)
    coder = bpe.Encoder(P.path("byte_bpe_50k.json"))
    first = coder.encode(["some words here", "others"])
    coder.encode(["entirely new things to learn"])
    assert coder.encode(["some words here", "others"]) == first


def test_clashes_repeats_and_long_texts(rows):
    path = P.path("byte_bpe_50k.json")
    long = "word " * 100_000 + "a" * 20_000
    wide = rows([(1, long, "x"), (1, long, "y"), (1, "z", None)], "doc_id long, text string, ids string")
    want = tokenizers.Tokenizer.from_file(path).encode(long, add_special_tokens=False).ids
    got = sorted(r.n_tokens for r in bpe.digests(wide, path).collect())
    assert got == [1, len(want), len(want)]
