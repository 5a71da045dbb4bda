"""The whole pipeline against a brute-force version, on documents with every edge case planted."""

import hashlib
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from dhwani.llm import decontam
from test_linededup import brute as brute_lines
from test_setjoin import brute as brute_sets

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
COLUMNS = "doc_id long, text string, n_chars int, n_kept int, component_id string"


def corpus():
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8)))
    line = lambda n: " ".join(word() for _ in range(n))
    items = [(k, line(r.randrange(12, 20))) for k in range(4)]
    shared = [line(8) for _ in range(3)]
    docs, toxic = [], set()
    for i in range(0, 270, 3):
        lines = [line(r.randrange(4, 12)) for _ in range(r.randrange(1, 6))]
        if r.random() < 0.3:
            lines.insert(r.randrange(len(lines) + 1), r.choice(shared))
        if r.random() < 0.3:
            toxic.add(i)
            lines[0] += " vilest zzrotten grubword"
        docs.append([i, "\n".join(lines)])
    clean = [d for d in docs if d[0] not in toxic]
    for k, (i, text) in enumerate(clean[:10]):  # near copies, and ids that come later
        w = text.split(" ")
        w[r.randrange(len(w))] = word()
        docs.append([1000 + i, " ".join(w) if k % 2 else text])
    for k, (_, item) in enumerate(items):  # with one character changed in some
        docs.append([2000 + k, line(9) + "\n" + line(3) + " " + (item if k % 2 else item[:7] + "!" + item[8:]) + " " + line(4)])
    docs += [[3000, None], [3001, ""], [3002, " \n\t"], [3003, shared[0]], [3004, "é" * 30 + "\n" + line(2000)]]
    docs.append(list(docs[4]))  # a repeated row
    return docs, toxic, items


def expected(docs, toxic, items, path):
    left = [d for d in docs if d[0] not in toxic]
    lines = brute_lines([tuple(d) for d in left], 20)
    left = [[d, lines[d]] for d, t in left if lines[d] is None or lines[d] or not t]
    first = dict((d, c) for d, _, c in brute_sets([tuple(x) for x in left]))
    left = [x for x in left if first[x[0]] == x[0]]
    out = []
    for d, t in left:
        folded = decontam.characters(decontam.folded(np.frombuffer((t or "").encode(), np.uint8)).tobytes())
        bench = [decontam.characters(decontam.clean(x.encode())) for _, x in items]
        if not any(decontam.align(b, folded, decontam.budget(len(b), decontam.SHARE)) for b in bench):
            out.append((d, t or ""))
    coder = tokenizers.Tokenizer.from_file(path)
    rows = []
    for d, t in out:
        ids = coder.encode(t, add_special_tokens=False).ids
        rows.append((d, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(rows)


def test_run_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    docs, toxic, items = corpus()
    rows = [(d, t, len(t or ""), 7, "x") for d, t in docs]
    labels = [(d, 1, int(d in toxic)) for d in sorted({d for d, _ in docs})]
    for name, data, schema in (("documents", rows, COLUMNS), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["toxicity"](spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert kept.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in docs if d not in toxic)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()) == expected(docs, toxic, items, P.path("byte_bpe_50k.json"))


def test_empty_tables_and_null_ids(spark, rows):
    import corpus_pipeline

    for data in ([], [(None, "a b c", 5, 1, "x"), (None, None, 0, None, None)]):
        docs = rows(data, COLUMNS)
        left = corpus_pipeline.line_stage(spark, docs, "")
        assert left.columns == docs.columns and left.count() == len(data)
        assert corpus_pipeline.jaccard_stage(spark, docs, "").count() == len(data)
        assert decontam.without_leaks(docs, rows([(1, "a b c d")], "item_id long, text string")).where(F.col("n_kept").isNull() | (F.col("n_kept") == 1)).count() == len(data)
