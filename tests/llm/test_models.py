"""Language-model scores against a plain model; toxicity on held-out rows; licence scans."""

import math
import random
import re
from collections import Counter

import numpy as np

from dhwani.llm import licenses, lmscore, toxicity


def plain_losses(docs, good, size):
    """Losses under models that count all other rows."""
    low = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    count = Counter(w for _, t in docs for w in low(t))
    vocabulary = {w for w, _ in count.most_common(size)}
    name = lambda w: w if w in vocabulary else f"<{min(len(w.encode()), lmscore.UNKNOWN)}>"
    types = len(vocabulary) + lmscore.UNKNOWN
    out = []
    for keep in (lambda i: i in good, lambda i: True):
        uni, bi, hist = Counter(), Counter(), Counter()
        for i, t in docs:
            if keep(i):
                w = ["<edge>", *map(name, low(t))]
                uni.update(w[1:])
                bi.update(zip(w, w[1:], strict=False))
                hist.update(w[:-1])
        rows = {}
        for i, t in docs:
            w = ["<edge>", *map(name, low(t))]
            u, o, g = (Counter(x) if keep(i) else Counter() for x in (w[1:], zip(w, w[1:], strict=False), w[:-1]))
            total = sum(uni.values()) - sum(u.values()) + types
            p = lambda a, b: (bi[a, b] - o[a, b] + lmscore.PRIOR * (uni[b] - u[b] + 1) / total) / (hist[a] - g[a] + lmscore.PRIOR)  # noqa: B023, E731
            rows[i] = -sum(math.log(p(a, b)) for a, b in zip(w, w[1:], strict=False)) / (len(w) - 1) if len(w) > 1 else None
        out.append(rows)
    return out


def test_losses(rows):
    r = random.Random(4)
    docs = [(i, " ".join(r.choice("aa bb CC dd e ff ggg".split()) for _ in range(r.randrange(0, 30)))) for i in range(60)] + [(99, None)]
    good = set(range(20))
    target, background = plain_losses(docs, good, 7)
    for row in lmscore.score(rows(docs), rows([(i,) for i in good], "doc_id long"), size=7).collect():
        if target[row.doc_id] is None:
            assert row.target_loss is None and row.n_tokens == 0
        else:
            assert abs(row.target_loss - target[row.doc_id]) < 1e-5 and abs(row.background_loss - background[row.doc_id]) < 1e-5
    assert lmscore.score(rows([]), rows([], "doc_id long")).count() == 0
    assert lmscore.score(rows(docs), rows([], "doc_id long")).count() == len(docs)


def test_losses_of_all_words(rows):
    r = random.Random(8)
    docs = [(i, " ".join(f"w{int(6000 * r.random() ** 2)}" for _ in range(150))) for i in range(80)] + [(None, "w1 w2 other"), (3, "twice w5 w5")]
    good = set(range(25))
    assert len({w for _, t in docs for w in t.split()}) > 3000
    # rows of one id are told apart by place in the plain model
    target, background = plain_losses([((n, i), t) for n, (i, t) in enumerate(docs)], {(n, i) for n, (i, _) in enumerate(docs) if i in good}, 10**9)
    want = sorted((i or -1, target[n, i], background[n, i]) for n, (i, _) in enumerate(docs))
    got = sorted((x.doc_id or -1, x.target_loss, x.background_loss) for x in lmscore.score(rows(docs), rows([(i,) for i in good], "doc_id long")).collect())
    assert np.allclose(got, want, atol=1e-9)


def test_toxicity_held_out(rows):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7)))
    docs, labels = [], []
    for i in range(1500):
        w = [word() for _ in range(60)]
        bad, junk = r.random() < 0.15, r.random() < 0.2
        if bad:
            for _ in range(4):
                w[r.randrange(60)] = r.choice(["Vilest", "zzrotten", "zzrotted", "zzrotters"])
        docs.append((i, " ".join(w).upper() + "!!" if junk else " ".join(w)))
        labels.append((i, int(not junk), int(bad)))
    schema = "doc_id long, quality int, toxic int"
    got = {x.doc_id: x for x in toxicity.score(rows(docs), rows(labels[:1000], schema)).collect()}
    for column, at in (("is_toxic", 2), ("is_quality", 1)):
        right = np.mean([getattr(got[i], column) == bool(labels[i][at]) for i in range(1000, 1500)])
        assert right > 0.97, (column, right)


def test_toxicity_edges(rows):
    schema = "doc_id long, quality int, toxic int"
    docs = [(1, None), (2, ""), (2, ""), (None, "x")]
    none = toxicity.score(rows(docs), rows([], schema)).collect()
    assert len(none) == 4 and not any(x.is_toxic for x in none)
    one = toxicity.score(rows(docs), rows([(1, 1, None), (2, None, 0), (2, 1, 0)], schema))
    assert one.count() == 4 and toxicity.score(rows([]), rows([(1, 1, 1)], schema)).count() == 0
    wide = rows([(1, "x", "y")], "doc_id long, text string, is_toxic string")
    assert toxicity.score(wide, rows([], schema), with_row=True).select("row.*").collect() == wide.collect()


def test_licences(rows):
    docs = [
        (1, "text\nReleased under the MIT License.\nmore"), (2, "released UNDER the\nmit license"), (3, None), (4, ""), (5, "Released under the GNU License."),
        (6, "x\n\n" + licenses.TEMPLATES["isc"].replace(", ", ",\n") + "\n\ny"), (6, "Licensed under CC BY-NC 4.0."),
    ]
    got = sorted((r.doc_id, r.license, r.n_units, r.matched, r.total) for r in licenses.scan(rows(docs)).collect())
    k = sum(licenses.template_bigrams(licenses.TEMPLATES["isc"]).values())
    assert got == [(1, "mit", 1, 4, 8), (2, "mit", 1, 4, 8), (6, "cc-by-nc-4.0", 1, 6, 12), (6, "isc", 2, k, 2 * k)]  # the paragraph, and the whole text
    spans = {r.license: (r.first_word, r.n_words) for r in licenses.scan(rows(docs[:1])).collect()}
    assert spans == {"mit": (1, 5)}
    assert licenses.scan(rows([])).count() == 0


def test_licences_inside_longer_parts(rows):
    """Notices in the middle of a line, over several paragraphs, and with a few words changed."""
    full = licenses.TEMPLATES["mit-full"]
    cut = full.index("THE SOFTWARE IS")
    laid_out = "MIT License\n\nCopyright (c) 2020 A B\n\n" + full[:cut].replace("conditions: ", "conditions:\n\n") + "\n\n" + full[cut:] + "\n\ncode follows " * 50
    changed = licenses.TEMPLATES["mpl-2.0-notice"].replace("one at", "one copy at")
    docs = [(1, "Made here. Released under the MIT License. See the file for details."), (1, laid_out), (None, f"# {changed} #"), (3, "plain words " * 300)]
    wide = rows([(d, t, "x") for d, t in docs], "doc_id long, text string, license string")
    got = sorted((r.doc_id or 0, r.license, r.n_units) for r in licenses.scan(wide).collect())
    assert got == [(0, "mpl-2.0-notice", 1), (1, "mit", 0), (1, "mit-full", 0), (1, "mit-grant", 0)]


def test_licence_windows_against_brute_force():
    r = random.Random(9)
    for _ in range(200):
        words = [r.choice("abc") for _ in range(r.randrange(2, 40))]
        grams = np.array([hash((x, y)) & 0xFFFF for x, y in zip(words, words[1:], strict=False)], np.uint64)
        template = Counter(int(x) for x in grams[r.randrange(len(grams)) :][: r.randrange(1, 9)].tolist())
        size = sum(template.values())
        want = max((sum((Counter(grams[s : s + size].tolist()) & template).values()) for s in range(len(grams) - size + 1)), default=0)
        at = np.flatnonzero(np.isin(grams, np.fromiter(template, np.uint64)))
        got = max((m for m, _ in licenses._windows(at, grams, template, size, 0.6, 0, len(grams))), default=0)
        assert got == (want if want >= 0.6 * size - 1e-9 else 0)


def test_vocabulary_ties_ids_and_clashes(rows):
    """Of words as frequent as each other, those of smaller hash are in the vocabulary; null ids are background."""
    docs = [(1, "a b c d"), (2, "d c b a"), (None, "a b"), (2, "d c b a")]
    one, two = (lmscore.score(rows(d), rows([(1,)], "doc_id long"), size=3).collect() for d in (docs, docs[::-1]))
    key = lambda x: (x.doc_id or 0, x.n_tokens, round(x.target_loss, 9), round(x.background_loss, 9))
    assert sorted(map(key, one)) == sorted(map(key, two)) and len(one) == 4
    wide = rows([(1, "a b c", "x", "y")], "doc_id long, text string, chunk string, n_tokens string")
    assert lmscore.score(wide, rows([(1,)], "doc_id long")).first().n_tokens == 3


def test_chain_of_three(rows):
    """A later category that is the two earlier ones together is learnt from them; repeated ids stand in the sample once."""
    r = random.Random(2)
    docs, labels = [], []
    for i in range(1200):
        a, b = r.random() < 0.4, r.random() < 0.4
        w = [f"w{r.randrange(500)}" for _ in range(30)] + ["vile"] * a + ["spam"] * b
        r.shuffle(w)
        docs += [(i, " ".join(w))] * (1 + (i % 50 == 0))
        labels.append((i, int(a), int(b), int(a or b)))
    table = rows(labels[:800], "doc_id long, rude int, ads int, bad int")
    got = {x.doc_id: x for x in toxicity.score(rows(docs), table, ("rude", "ads", "bad")).collect()}
    for c, at in (("rude", 1), ("ads", 2), ("bad", 3)):
        assert np.mean([getattr(got[i], f"is_{c}") == bool(labels[i][at]) for i in range(800, 1200)]) > 0.97, c
    chain, _ = toxicity.fit(rows(docs), table, ("rude", "ads", "bad"))
    assert [len(v) for _, v in chain.weights] == [toxicity.SHAPES + 1, toxicity.SHAPES + 2, toxicity.SHAPES + 3]
