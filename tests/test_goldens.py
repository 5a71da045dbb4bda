"""Words with known tokens and texts with known normal forms."""

import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dhwani.functions import phonemes as P
from dhwani.functions import tables as T
from dhwani.functions import text as X
from dhwani.operators import relational

# Words with their tokens.
WORDS = """
নাম: n a m
কম: k o m
বাংলা: b a ng l a
করছি: k o r chh i
আমরা: a m r a
পাঁচ: p a~ ch
পড়া: p o r a
আষাঢ়: a sh a r
লবণ: l o b O n
সন্ধ্যা: sh o n dh a
বিশ্ব: b i sh sh O
বন্যা: b o n n a
গ্রীষ্ম: gr i sh sh O
জ্বর: j o r
বিদ্যুৎ: b i d d u t
উৎসব: u t sh o b
ব্যাগ: b A g
ব্যথা: b A th a
শ্যালক: sh A l o k
সংখ্যা: sh o ng kh a
জ্যোতি: j O t i
বানিজ্য: b a n i j j O
চ্যালেঞ্জ: ch A l e nj O
যোগ্যতা: j O g g t a
দৈর্ঘ্য: d oi r gh O
শ্বশুর: sh o sh u r
জিহ্বা: j i b b a
হ্রদ: r o d
হ্যাঁ: h A~
লক্ষ্মী: l O kkh i
তত্ত্ব: t o t t O
ক্যাপ: k A p
স্বাস্থ্য: sh a s th O
তীক্ষ্ণ: t i k h n O
ব্রাহ্মণ: br a m m o n
রক্তিম: r O kt i m
দেখা: d E kh a
তেরো: t E r O
কেরোসিন: k e r O sh i n
চেয়ার: ch e y a r
কেউ: k e u
কেমন: k E m o n
তেল: t e l
গরম: g o r O m
ছাগল: chh a g O l
হৃদয়: ri d o y
কর্তব্য: k o r t o b b O
তোমরা: t O m r a
নৃত্যনাট্য: n ri t t n a T T O
অ্যালবাম: A l b a m
সমগ্র: sh o m O gr O
শুভ সকাল: sh u bh | sh o k a l
"""

# Texts with their normal forms.
NORMAL = [
    ("আমার ৫ টাকা", "আমার পাঁচ টাকা"),
    ("3409", "তিন হাজার চারশো নয়"),
    ("100 1000 9999 10000 0", "একশো এক হাজার নয় হাজার নয়শো নিরানব্বই 10000 শূন্য"),
    ("১০কেজি / ১০ কেজি", "দশকেজি দশ কিলোগ্রাম"),
    ("12.5 1,500 -5", "বারো পাঁচ এক পাঁচশো পাঁচ"),
    ("আমার mobile number হলো ০১৭১২৩৪৫৬৭৮।", "আমার হলো 1712345678"),
    ("মি. করিম ঢাঃ থেকে এসেছেন।", "মিস্টার করিম ঢাকা থেকে এসেছেন"),
    ("তিনি MBBS পাস করেছেন", "তিনি এম বি বি এস পাস করেছেন"),
    ("বাংলাদেশ", "বাংলাদেশ"),
    ("٣ ３", "তিন তিন"),
    ("", ""),
    (None, None),
]


def run(spark, rows, f):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "id int, text string")
    return [r.out for r in df.select("id", f(F.col("text")).alias("out")).orderBy("id").collect()]


def test_words(spark):
    pairs = [line.split(": ") for line in WORDS.strip().splitlines()]
    found = run(spark, [w for w, _ in pairs], lambda c: F.array_join(P.phonemes(c), " "))
    assert [(w, f) for (w, e), f in zip(pairs, found, strict=True) if e != f] == []


def test_normal(spark):
    found = run(spark, [t for t, _ in NORMAL], X.normalize)
    assert found == [e for _, e in NORMAL]


def test_null_and_empty(spark):
    assert run(spark, [None, "", " "], P.phonemes) == [None, [], ["|"]]
    assert run(spark, [None, ""], P.risks) == [None, []]


def test_risks(spark):
    found = run(spark, ["পুরনো", "মাংস", "সাইকেল", "আমি"], P.risks)
    assert [[(r.code, r.detail) for r in rows] for rows in found] == [
        [("suppressed_schwa", "র")],
        [("word_final_schwa_drop", "স"), ("sa_sh_or_s_ambiguous", "স")],
        [("sa_sh_or_s_ambiguous", "স"), ("word_final_schwa_drop", "ল")],
        [],
    ]


LETTERS = st.sampled_from([*T.CONSONANTS, *T.VOWELS, *T.SIGNS, *T.MARKS, T.HASANTA, T.HASANTA, T.NASAL, T.NUKTA, " ", "x", "1", "৾", "‍", "।"])
TEXT = st.lists(LETTERS, max_size=14).map("".join)


@settings(max_examples=4, deadline=None, derandomize=True)
@given(st.lists(TEXT, min_size=60, max_size=60))
def test_properties(spark, rows):
    ready = run(spark, rows, X.preprocess)
    want = []
    for t in rows:
        t = unicodedata.normalize("NFC", t)
        for parts, whole in ((b, a) for a, b in X._SPLIT):
            t = t.replace(parts, whole)
        want.append(t)
    assert ready == want
    assert run(spark, ready, X.preprocess) == ready
    assert run(spark, ready, lambda c: F.array_join(F.transform(P.clusters(c), lambda x: x["raw"]), "")) == ready
    alone = run(spark, rows, P.phonemes)
    both = run(spark, [a + " " + b for a, b in zip(rows[::2], rows[1::2], strict=True)], P.phonemes)
    for a, b, c, d in zip(alone[::2], alone[1::2], both, rows[1::2], strict=True):
        if not d[:1] or d[0] not in "়্৾":
            assert c == [*a, "|", *b]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, text string")
    assert [r.phonemes for r in relational.phonemes(df, "id", "text").orderBy("id").collect()] == alone


def test_number_words_are_distinct(spark):
    rows = spark.range(10000).select(X.number_words(F.col("id")).alias("w"))
    assert rows.distinct().count() == 10000
