import random
import re

import pytest

from dhwani.llm import setjoin

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(docs, percent=80):
    sets = {i: shingles(t) for i, t in docs}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                top[max(p, q)] = min(p, q)
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def edited(r, words, rate):
    return [r.choice("abcdefgh") * 2 if r.random() < rate else w for w in words]


def corpus(seed, n=160):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(1, 5)))
    passage = [word() for _ in range(30)]
    bases = [[word() for _ in range(r.choice([1, 3, 4, 5, 6, 8, 9, 12, 20, 40, 90, 200, 400]))] for _ in range(25)]
    docs = []
    for i in range(n):
        w = edited(r, r.choice(bases), r.choice([0, 0, 0.01, 0.03]))
        if r.random() < 0.4:
            w = w[: r.randrange(0, 12)] + passage
        docs.append((i * 3, " ".join(w)))
    return [*docs, (10_000, None), (10_001, ""), (10_002, " \n\t"), (10_003, "One TWO"), (10_004, "one two")]


def got(df):
    return sorted(map(tuple, setjoin.near_duplicates(df).collect()))


def test_against_brute_force(rows):
    docs = corpus(1)
    assert got(rows(docs)) == brute(docs)


def test_hot_keys_have_an_exact_way(rows, monkeypatch):
    monkeypatch.setattr(setjoin, "HOT", 2)
    docs = corpus(3, 120)
    assert got(rows(docs)) == brute(docs)


def test_edges(rows):
    assert got(rows([])) == []
    twice = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")]
    assert got(rows(twice)) == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]
    wide = rows([(1, "a b c d e", "x"), (2, "a b c d e", "y")], "doc_id long, text string, component_id string")
    assert [tuple(r) for r in setjoin.keep_one(wide).collect()] == [(1, "a b c d e", "x")]


def test_plans_cover_the_bound():
    p = setjoin.plan(80)
    for k in range(len(p["m"])):
        m, d, hi = int(p["m"][k]), int(p["d"][k]), int(p["hi"][k])
        other = hi if k % 2 == 0 else (8 << (k // 2)) - 1
        assert 0 <= d <= m and min(p["spare"][k], p["hot"][k]) >= 0
        assert m + d == setjoin.bound(hi, other, 80) + 1 + p["hot"][k] + p["spare"][k]


def test_low_thresholds_raise(rows):
    with pytest.raises(ValueError):
        setjoin.near_duplicates(rows([(1, "a b c d e")]), percent=75)


def test_long_texts_and_ids_with_two_texts(rows):
    r = random.Random(7)
    long = " ".join(f"w{r.randrange(10**6)}" for _ in range(150_000))  # 1 MB: hashed in pieces
    near = long.replace(" w1", " v1", 50)
    text = "one two three four five six seven eight nine ten"
    docs = [(5, long), (4, near), (9, "a b c d e f g"), (9, text), (7, text), (8, "A b c d e f g")]
    assert got(rows(docs)) == sorted([(4, len(shingles(near)), 4), (5, len(shingles(long)), 4), (9, 3, 7), (9, 6, 7), (7, 6, 7), (8, 3, 7)])
