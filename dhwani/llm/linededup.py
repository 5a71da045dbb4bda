"""Line deduplication by a segment-partition edit join (DataFrame operations only).

A line goes when an equal line, or one within one edit, stands earlier (by document id, then place).
Lines shorter than ``min_chars`` code points go for equal lines only, lines shorter than ``shortest`` stay.

Method. Equal lines first become one, by a 128-bit hash, pre-aggregated. A distinct line is cut into
threshold-plus-one segments (two), which are indexed under its length; it probes with its own segments
and with the prefix and suffix that a line one shorter would have. Two lines within one edit share a key.
Keys are counted by a pre-aggregation, and the keys that meet joined back, so that a frequent one can be split.
Pairs that meet are verified by banded bit-parallel edit distance on what the shared segment leaves.

Keys of more than ``HOT`` lines are not paired: their members are grouped by all but one sixteenth of the
unshared part, and within such a group by what is left after deleting each character of that sixteenth.
Members that agree there are a substitution or an insertion apart: each is paired with the earliest of its
group only, and the pair is verified by the banded distance like any other. That is linear in the key's members, and
such groups are bounded by the alphabet and the line.

Defined results. Null text: stays null, no lines. Empty text: one empty line. Lines end at ``\\n`` only.
Repeated rows of a document count as one document; rows of one id with different texts are documents of
their own, in the order of the texts' hashes. Rows with a null id stay as they are. Ties cannot
happen between different places. Extra columns are kept. Empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dhwani.llm.common import Scratch, free_name

EDITS = 1
#: Shortest line that is compared with others by edits, and shortest line that goes for an equal one.
MIN_CHARS, SHORTEST = 20, 1
HOT = 16
FILTER_BITS = 1 << 23


def _let(value: Column, body) -> Column:
    """``body(value)``, with the value computed once inside a lambda."""
    return F.get(F.transform(F.array(value), body), 0)


def banded_distance(a: Column, b: Column, k: int) -> Column:
    """Edit distance of two strings whose lengths differ by at most ``k``, exact up to ``k``.

    One step per character of ``b`` updates the ``2k+1`` cells of its band at once, as vertical
    difference bits; the distance follows the band's lower diagonal, then the last row.
    """
    ones = (1 << (2 * k + 1)) - 1
    x, y = F.split(a, ""), F.split(b, "")
    n, m = F.char_length(a), F.char_length(b)

    def bit(cond: Column, at: int) -> Column:
        return F.when(cond, F.lit(1 << at).cast("long")).otherwise(F.lit(0).cast("long"))

    def inverse(v: Column) -> Column:
        return F.bitwise_not(v).bitwiseAND(F.lit(ones).cast("long"))

    def step(state: Column, j: Column) -> Column:
        equal = sum((bit(F.get(x, j - k + t - 1) == F.get(y, j - 1), t) for t in range(1, 2 * k + 1)), bit(F.get(x, j - k - 1) == F.get(y, j - 1), 0))
        vp, vn = state.vp, state.vn
        diagonal = _let(equal, lambda e: ((e.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(e).bitwiseOR(vn).bitwiseAND(F.lit(ones).cast("long")))
        return _let(diagonal, lambda d: _let(vn.bitwiseOR(inverse(d.bitwiseOR(vp))), lambda hp: _let(d.bitwiseAND(vp), lambda hn: F.struct(
            hn.bitwiseOR(inverse(F.shiftright(d, 1).bitwiseOR(hp))).alias("vp"),
            F.shiftright(d, 1).bitwiseAND(hp).alias("vn"),
            (state.dist + F.when(j <= n - k, 1 - F.shiftright(d, 2 * k).bitwiseAND(1)).otherwise(
                F.get(_bits(hp, k), n - j + k) - F.get(_bits(hn, k), n - j + k))).cast("long").alias("dist")))))

    start = F.struct(F.lit(((1 << (k + 1)) - 1) << k).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.lit(k).cast("long").alias("dist"))
    banded = F.aggregate(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), start, step, lambda s: s.dist)
    return F.when(F.least(n, m) <= k, F.levenshtein(a, b).cast("long")).otherwise(banded)


def _bits(v: Column, k: int) -> Column:
    return F.array(*[F.shiftright(v, t).bitwiseAND(1) for t in range(2 * k + 1)])


def _trimmed(pairs: DataFrame, k: int, disk: Scratch) -> DataFrame:
    """Pairs with the common beginnings and ends of ``x`` and ``y`` cut, to a sixteenth of their length.

    That leaves the distance as it is. With one edit allowed, pairs that keep more than the sixteenths an
    edit can lie in are dropped.
    """
    size = F.char_length("x")
    part = lambda n: F.floor(size * n / 16).cast("int")
    head = F.coalesce(*[F.when(F.col("y").startswith(F.substring("x", F.lit(1), part(n))), part(n)) for n in range(16, 0, -1)], F.lit(0))
    # each step is written, or its expressions would be copied into the next ones many times over
    pairs = disk.write(pairs.select("a", "b", "x", "y", F.floor(size / 16).alias("most"), head.alias("head")), "pairs")
    pairs = pairs.withColumn("x", F.substring("x", F.col("head") + 1, size)).withColumn("y", F.substring("y", F.col("head") + 1, F.char_length("y")))
    tail = F.coalesce(*[F.when(F.col("y").endswith(F.substring("x", size - part(n) + 1, part(n))), part(n)) for n in range(16, 0, -1)], F.lit(0))
    pairs = disk.write(pairs.select("a", "b", "x", "y", "most"), "pairs")
    pairs = disk.write(pairs.select("a", "b", "x", "y", (F.col("most") + F.floor(size / 16)).alias("most"), tail.alias("tail")), "pairs")
    pairs = pairs.withColumn("x", F.substring("x", F.lit(1), size - F.col("tail"))).withColumn("y", F.substring("y", F.lit(1), F.char_length("y") - F.col("tail")))
    return pairs.where(F.char_length("x") <= F.col("most") + 2) if k == 1 else pairs


def _lines(docs: DataFrame) -> DataFrame:
    """(id, line) of all lines; an id is the document's, its text's hash and the place."""
    rows = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("of"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.select(F.struct("doc_id", "of", "pos").alias("id"), "line")


def _met(rows: DataFrame) -> DataFrame:
    """The rows whose ``key`` meets others (some row of role 0, two at least), with their number ``c``."""
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("role") == 0).alias("c0")).where("c > 1 and c0 > 0")
    return rows.join(counts.drop("c0"), "key")


def _key(segment: int, length: Column, part: Column) -> Column:
    return F.xxhash64(F.lit(segment), length, part)


def _left_over(line: Column, seg: Column, role: Column) -> Column:
    """What a shared segment leaves of a line; ``role`` 1 probed as a line one longer than its key's."""
    size = F.char_length(line)
    half = F.floor((size - role) / 2).cast("int")
    return F.when(seg == 1, F.substring(line, half + 1, size)).otherwise(F.substring(line, F.lit(1), size - ((size - role) - half)))


def kept_lines(docs: DataFrame, min_chars: int = MIN_CHARS, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, of, kept, n_near): places of a document's lines that stay, of those at least ``shortest`` long.

    ``of`` is the hash of the document's text. ``n_near`` counts the document's first occurrences that go because of an earlier line one edit away.
    """
    disk = Scratch(docs.sparkSession)
    lines = _lines(docs.select("doc_id", "text")).where(F.char_length("line") >= shortest)
    line, size = F.col("line"), F.char_length("line")
    half, half1 = F.floor(size / 2).cast("int"), F.floor((size - 1) / 2).cast("int")
    own = [_key(1, size, F.substring(line, F.lit(1), half)), _key(2, size, F.substring(line, half + 1, size))]
    shorter = [_key(1, size - 1, F.substring(line, F.lit(1), half1)), _key(2, size - 1, F.substring(line, half1 + 2, size))]
    reps = lines.select(
        F.xxhash64(F.lit(1), line).alias("h1"), F.xxhash64(F.lit(2), line).alias("h2"), "id",
        *[F.when(size >= min_chars, k).alias(f"k{n}") for n, k in enumerate(own + shorter)])
    reps = disk.write(reps.groupBy("h1", "h2").agg(F.min("id").alias("id"), *[F.first(f"k{n}").alias(f"k{n}") for n in range(4)]).drop("h1", "h2"), "lines")

    probes = F.explode(F.array(*[F.struct(F.col(f"k{n}").alias("key"), F.lit(n // 2).alias("role"), F.lit(n % 2 + 1).alias("seg")) for n in range(4)]))
    met = disk.write(_met(reps.select("id", probes.alias("p")).select("id", "p.*").where("key is not null")), "met")

    # the texts of lines that met, thinned by a bitmap of fixed size before the exact join
    slot = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))
    wanted = met.select("id").distinct()
    bitmap = wanted.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    texts = lines.join(F.broadcast(bitmap), F.shiftright(slot, 6) == F.col("word")).where(F.col("bits").bitwiseAND(bit) != 0)
    texts = disk.write(texts.join(wanted, "id").select("id", "line").dropDuplicates(["id"]), "texts")
    met = disk.write(met.join(texts, "id").withColumn("rest", _left_over(F.col("line"), F.col("seg"), F.col("role"))).drop("line"), "rests")
    disk.drop("met")

    few = met.where(F.col("c") <= HOT)
    a = few.where("role = 0").select("key", F.col("id").alias("a"), F.col("rest").alias("x"))
    b = few.select("key", F.col("id").alias("b"), F.col("rest").alias("y"), "role")
    pairs = a.join(b, "key").where((F.col("a") != F.col("b")) & ((F.col("role") == 1) | (F.col("a") < F.col("b")))).select("a", "b", "x", "y")

    # members of a hot key that agree in all but one sixteenth of what is left
    base = F.char_length("rest") - F.col("role")
    edge = lambda n: F.floor(base * n / 16).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda n: F.struct(
        F.xxhash64("key", n, F.substring("rest", F.lit(1), edge(n)), F.substring("rest", edge(n + 1) + F.col("role") + 1, F.char_length("rest"))).alias("key"),
        F.substring("rest", edge(n) + 1, edge(n + 1) - edge(n) + F.col("role")).alias("rest")))
    many = _met(met.where(F.col("c") > HOT).select("id", "role", F.explode(cells).alias("cell")).select("id", "role", "cell.*"))
    places = F.sequence(F.lit(1), F.greatest(F.char_length("rest"), F.lit(1)))
    without = lambda p: F.xxhash64(F.concat(F.substring(F.col("rest"), F.lit(1), p - 1), F.substring(F.col("rest"), p + 1, F.char_length("rest"))))
    swaps = many.where("role = 0").select("key", "id", F.explode(F.transform(places, lambda p: F.struct(p.alias("p"), without(p).alias("left")))).alias("v")).select("key", "id", "v.*")
    swapped = swaps.withColumn("a", F.min("id").over(Window.partitionBy("key", "p", "left"))).select("a", F.col("id").alias("b"))
    whole = many.where("role = 0").select("key", "id", "role", F.xxhash64("rest").alias("left"))
    cut = many.where("role = 1").select("key", "id", "role", F.explode(F.array_distinct(F.transform(places, without))).alias("left"))
    meet = Window.partitionBy("key", "left")
    grown = whole.union(cut).withColumn("x", F.min(F.when(F.col("role") == 0, F.col("id"))).over(meet)).withColumn("y", F.min(F.when(F.col("role") == 1, F.col("id"))).over(meet))
    grown = grown.select(F.when(F.col("role") == 0, F.col("y")).otherwise(F.col("x")).alias("a"), F.col("id").alias("b"))
    hot = disk.write(swapped.union(grown).where("a < b").distinct(), "hot")
    for end, name in (("a", "x"), ("b", "y")):
        hot = hot.join(texts.select(F.col("id").alias(end), F.col("line").alias(name)), end)
    pairs = pairs.union(hot.select("a", "b", "x", "y"))
    near = _trimmed(pairs, EDITS, disk).where(banded_distance(F.col("x"), F.col("y"), EDITS) <= EDITS).select(F.greatest("a", "b").alias("id")).distinct()

    marked = reps.select("id").join(disk.write(near.withColumn("near", F.lit(True)), "near"), "id", "left")
    disk.drop_all_but("lines", "near")
    return marked.groupBy(F.col("id.doc_id").alias("doc_id"), F.col("id.of").alias("of")).agg(
        F.sort_array(F.collect_list(F.when(F.col("near").isNull(), F.col("id.pos")))).alias("kept"), F.count_if(F.col("near").isNotNull()).alias("n_near"))


def _flags(places: Column) -> Column:
    """An array that holds 1 at the given places (ascending) and 0 before and between them."""
    gap = lambda p, i: p - F.coalesce(F.get(places, i - 1), F.lit(-1)) - 1
    return F.split(F.array_join(F.transform(places, lambda p, i: F.concat(F.repeat(F.lit("0"), gap(p, i)), F.lit("1"))), ""), "")


def deduplicated(
    docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST,
    counts: tuple[str, str, str] = ("n_lines", "n_kept", "n_near"),
) -> DataFrame:
    """The documents with lines that stand earlier taken out of ``text_col``.

    Lines of ``shortest`` to ``min_chars`` code points go for equal lines only. All columns stay, and those
    of ``counts`` are added: lines, lines kept, and lines that went for one an edit away. A name that the documents have already
    raises ValueError.
    """
    own = docs.columns
    if clash := {c.lower() for c in own} & {c.lower() for c in counts}:
        raise ValueError(f"documents have columns {sorted(clash)}; choose other names for the counts")
    kept = kept_lines(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), min_chars, shortest)
    key, of, places, near = (free_name(docs, f"dedup_{x}") for x in ("id", "of", "kept", "near"))
    kept = kept.select(F.col("doc_id").alias(key), F.col("of").alias(of), F.col("kept").alias(places), F.col("n_near").alias(near))
    text = F.col(text_col).cast("string")
    rows = docs.join(kept, (F.col(id_col).cast("long") == F.col(key)) & (F.xxhash64(text) == F.col(of)), "left")
    parts = F.split(text, "\n")
    found = F.coalesce(places, F.array().cast("array<int>"))
    stays = lambda f: F.filter(parts, lambda x, i: (F.char_length(x) < shortest) | F.coalesce(F.get(f, i) == "1", F.lit(False)))
    fine = _let(_let(found, _flags), stays)
    rows = rows.withColumn(places, F.when(F.col(id_col).isNull(), parts).otherwise(fine))
    return rows.select(
        *[F.array_join(places, "\n").alias(c) if c == text_col else F.col(c) for c in own],
        F.coalesce(F.size(parts), F.lit(0)).alias(counts[0]), F.coalesce(F.size(places), F.lit(0)).alias(counts[1]), F.coalesce(near, F.lit(0)).cast("long").alias(counts[2]))


def digests(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, n_lines, n_kept, n_near, kept_sha256)."""
    rows = deduplicated(docs.select("doc_id", "text"), min_chars)
    return rows.select("doc_id", "n_lines", "n_kept", "n_near", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = f"""
WITH l AS (SELECT doc_id, i - 1 AS pos, string_split(text, chr(10))[i] AS line
           FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS r(i)),
f AS (SELECT line, min({{'d': doc_id, 'p': pos}}) AS id, length(line) AS n FROM l WHERE length(line) >= {SHORTEST} GROUP BY line),
long AS (SELECT * FROM f WHERE n >= {MIN_CHARS}),
halves AS (SELECT *, left(line, n // 2) AS l0, substr(line, n // 2 + 1) AS r0, left(line, (n - 1) // 2) AS l1, substr(line, (n - 1) // 2 + 2) AS r1 FROM long),
met AS (SELECT a.line AS x, b.line AS y, greatest(a.id, b.id) AS id FROM halves a JOIN halves b ON a.n = b.n AND a.l0 = b.l0 WHERE a.id < b.id
  UNION SELECT a.line, b.line, greatest(a.id, b.id) FROM halves a JOIN halves b ON a.n = b.n AND a.r0 = b.r0 WHERE a.id < b.id
  UNION SELECT a.line, b.line, greatest(a.id, b.id) FROM halves a JOIN halves b ON a.n + 1 = b.n AND a.l0 = b.l1
  UNION SELECT a.line, b.line, greatest(a.id, b.id) FROM halves a JOIN halves b ON a.n + 1 = b.n AND a.r0 = b.r1),
pairs AS (SELECT * FROM met WHERE levenshtein(x, y) <= 4),
near AS (SELECT DISTINCT id FROM pairs WHERE CASE WHEN length(x) = length(y)
  THEN len(list_filter(range(1, length(x) + 1), lambda p: x[p] <> y[p])) = 1
  ELSE list_contains(list_transform(range(1, length(y) + 1), lambda p: y[:p - 1] || y[p + 1:]), x) END),
s AS (SELECT l.*, f.id IS NULL OR f.id = {{'d': doc_id, 'p': pos}} AND near.id IS NULL AS stay,
        f.id = {{'d': doc_id, 'p': pos}} AND near.id IS NOT NULL AS gone
      FROM l LEFT JOIN f USING (line) LEFT JOIN near ON near.id = f.id)
SELECT doc_id, count(*)::INTEGER AS n_lines, count_if(stay)::INTEGER AS n_kept, count_if(gone)::BIGINT AS n_near,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stay), '')) AS kept_sha256
FROM s GROUP BY doc_id
"""
