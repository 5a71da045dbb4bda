import random

import numpy as np

from dhwani.llm import decontam


def edits(p, t):
    row = [0] * (len(t) + 1)
    for i in range(1, len(p) + 1):
        new = [i] + [0] * len(t)
        for j in range(1, len(t) + 1):
            new[j] = min(row[j - 1] + (p[i - 1] != t[j - 1]), row[j] + 1, new[j - 1] + 1)
        row = new
    return min(row)


def test_against_brute_force(rows):
    r = random.Random(3)
    items = [(k, "".join(r.choice("abcd e") for _ in range(r.choice([3, 9, 20, 60, 120, 200])))) for k in range(10)]
    docs = []
    for n in range(40):
        t = ""
        for _ in range(r.randrange(0, 4)):
            x = list(r.choice(items)[1])
            for _ in range(r.randrange(0, max(1, len(x) // 14))):
                at = r.randrange(len(x))
                x[at : at + r.randrange(2)] = r.choice("abcd")
            t += "".join(r.choice("abcd ") for _ in range(r.randrange(0, 60))) + "".join(x).upper()
        docs.append((n, t))
    want = []
    for n, t in docs:
        f = decontam.folded(np.frombuffer(t.encode(), np.uint8)).tobytes()
        for k, p in items:
            p = decontam.clean(p.encode())
            e = edits(p, f) if p else 1
            if p and e <= decontam.budget(len(p), decontam.SHARE):
                want.append((n, k, e))
    found = decontam.leaks(rows(docs), rows(items, "item_id long, text string")).collect()
    assert sorted((x.doc_id, x.item_id, x.edits) for x in found) == sorted(want)
    bench = rows(items, "item_id long, text string")
    left = {x.doc_id for x in decontam.without_leaks(rows(docs), bench).collect()}
    assert left == {n for n, _ in docs} - {n for n, _, _ in want}


def test_edges(rows, monkeypatch):
    bench = rows([(1, "the quick brown fox jumps"), (2, None), (3, " \n"), (4, "tiny")], "item_id long, text string")
    docs = rows([(1, None), (2, ""), (3, "so THE quick\nbrown  fox jumps"), (3, "so THE quick\nbrown  fox jumps"), (None, "tiny"), (5, "a tiny one")])
    want = [(3, 1), (3, 1), (5, 4), (None, 4)]
    key = lambda x: (x[0] is None, x)
    assert sorted(((x.doc_id, x.item_id) for x in decontam.leaks(docs, bench).collect()), key=key) == want
    monkeypatch.setattr(decontam, "MAX_BENCHMARK_BYTES", 4)
    assert sorted(((x.doc_id, x.item_id) for x in decontam.leaks(docs, bench).collect()), key=key) == want
    assert decontam.leaks(rows([]), bench).count() == 0
    assert decontam.leaks(docs, rows([], "item_id long, text string")).count() == 0
    wide = rows([(1, "the quick brown fox jumps", "x"), (2, "clean", "y")], "doc_id long, text string, item_id string")
    assert [tuple(x) for x in decontam.without_leaks(wide, bench).collect()] == [(2, "clean", "y")]


def test_no_true_hit_in_a_chunk():
    index = decontam.Index([(1, b"the quick brown fox jumps")], 0.05)
    for g in index.grams:
        g.table[:] = True  # every place passes the table, none is in the index
    assert index.find([b"0123456789 0123456789", b"", b"x"]) == []


def test_edits_of_short_items_and_letters_outside_ascii():
    short, other = "twenty-three characters", "\u09ac\u09be\u0982\u09b2\u09be \u09ad\u09be\u09b7\u09be\u09b0 \u0995\u09a5\u09be \u09ac\u09b2\u09bf\u0993"
    index = decontam.Index([(1, short.encode()), (2, other.encode())], 0.05)
    assert len(short) == 23 and len(other) == 20 and index.edits.tolist() == [1, 1]
    one = ["so " + short.replace("three", "throe") + " here", "x " + other.replace("\u0995", "\u09a8") + "!"]
    two = ["so " + short.replace("three", "threwn") + " here", "x " + other.replace("\u0995\u09a5", "\u09a8\u09a8") + "!"]
    assert [x[:3] for x in index.find([t.encode() for t in one + two])] == [(0, 0, 1), (1, 1, 1)]


def test_repetitive_and_long_texts(monkeypatch):
    r = random.Random(5)
    items = [(1, b"ab" * 60), (2, b"a" * 90), (3, "".join(r.choice("abcdefg") for _ in range(130)).encode()), (4, "é".encode() * 50)]
    texts = [b"a" * 3000 + b"b" + b"ab" * 400, "x".encode() * 700 + items[2][1] + b"y" * 900, ("é" * 30 + "e" + "é" * 500).encode(), b"a" * 89]
    whole = decontam.Index(items, 0.05).find(texts)
    assert {x[:3] for x in whole} >= {(0, 0, 0), (0, 1, 0), (1, 2, 0), (2, 3, 0), (3, 1, 1)}
    monkeypatch.setattr(decontam, "PIECE", 200)
    monkeypatch.setattr(decontam, "HITS", 64)
    assert decontam.Index(items, 0.05).find(texts) == whole


def test_ties_go_to_the_first_place():
    index = decontam.Index([(1, b"the quick brown fox jumps"), (2, b"the quick brown fox jumps")], 0.05)
    text = b"the quick brown fix jumps; the quick brown fox jumps, the quick brown fox jumps"
    assert index.find([text]) == [(0, 0, 0, 27, 52), (0, 1, 0, 27, 52)]
