import numpy as np
from pyspark.sql import functions as F

from dhwani.llm import ann

SCHEMA = "vec_id long, embedding array<float>"


def brute(ids, x, k):
    out = {}
    for i in range(len(ids)):
        if ids[i] % 20 == 0:
            s = x @ x[i]
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
            out[ids[i]] = [ids[j] for j in order]
    return out


def found(df, k=20):
    out = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, k).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.vec_id)
        assert r.rank == len(out[r.query_id])
    return out


def test_recall(rows, monkeypatch):
    monkeypatch.setattr(ann, "PART_POINTS", 100)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16))
    x = (centres[rng.integers(0, 30, 1500)] + 0.4 * rng.normal(size=(1500, 16))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[700:760] = x[5]  # copies
    ids = np.arange(1500)
    want = brute(ids, x.astype(np.float64), 20)
    got = found(rows([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], SCHEMA))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert np.mean([len(set(want[q]) & set(got[q])) / 20 for q in want]) >= 0.9
    assert got[700] == [5, *range(701, 720)]


def test_two_levels(rows, monkeypatch):
    """More parts than the sample can teach at once: parts of parts."""
    monkeypatch.setattr(ann, "PART_POINTS", 10)
    monkeypatch.setattr(ann, "MAX_PARTS", 12)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(0, 40, 1200)] + 0.3 * rng.normal(size=(1200, 16))).astype(np.float32)
    router, probes = ann.learn(x.astype(np.float64), len(x), 20, 0.92)
    assert router.parts > 100 and probes < router.parts / 2
    every = router.best(x[:5].astype(np.float64), router.parts)
    assert all(sorted(r) == list(range(router.parts)) for r in every.tolist()) and (router.best(x[:5].astype(np.float64), 2) == every[:, :2]).all()
    want = brute(np.arange(1200), x.astype(np.float64), 20)
    got = found(rows([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA))
    assert np.mean([len(set(want[q]) & set(got[q])) / 20 for q in want]) >= 0.9


def test_balance():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 8))
    part = ann.balanced_parts(x, ann.neighbours(x, 5), 8)
    assert np.bincount(part, minlength=8).max() <= np.ceil(1.05 * 50)


def test_edges(rows):
    nan, inf = float("nan"), float("inf")
    bad = [(20, None), (40, [0.0, 0.0]), (60, [nan, 1.0]), (80, [inf, 1.0]), (100, [None, 1.0]), (120, [1.0]), (None, [1.0, 0.0])]
    good = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [2.0, 0.0])]
    assert found(rows(good + bad, SCHEMA)) == {0: [3, 1, 2]}
    assert found(rows([], SCHEMA)) == {}


def test_lengths_types_ties_and_clashes(rows):
    data = [(0, [1.0, 0.0], "x"), (1, [2.0, 0.0], "x"), (2, [2.0, 0.0], "x"), (5, [0.5, 0.5], None), (20, [1.0, 1.0, 1.0], "x"), (3, [0.0, 0.0, 2.0], "x")]
    assert found(rows(data, "vec_id long, embedding array<float>, score string")) == {0: [1, 2, 5], 20: [3]}
    big = [(0, [1e39, 1.0]), (1, [1.0 + 2**-40, 0.0]), (2, [1.0, 0.0]), (4, [-1e300, 0.0])]
    assert found(rows(big, "vec_id long, embedding array<double>")) == {0: [1, 2, 4]}
    twice = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.0])]  # an id with two vectors is a query by each
    got = ann.search(rows(twice, SCHEMA), F.col("vec_id") == 0).collect()
    assert sorted((r.query_id, r.vec_id, r.score) for r in got) == [(0, 1, 0.0), (0, 1, 1.0)]


def test_short_results_are_widened(rows, monkeypatch):
    """Far more is asked for than the most probable part holds."""
    monkeypatch.setattr(ann, "PART_POINTS", 20)
    monkeypatch.setattr(ann, "COPIES", 1)
    rng = np.random.default_rng(3)
    x = np.repeat(np.eye(8), 40, axis=0) + 0.01 * rng.normal(size=(320, 8))
    got = found(rows([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA), 100)
    assert all(len(v) == 100 for v in got.values()) and len(got) == 16
