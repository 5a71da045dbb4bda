"""Exact Jaccard self-join of word n-gram sets by universe partition and pigeonhole.

Method. Sets that link have a symmetric difference of at most ``H`` (from the threshold and the
sizes). For every size band the hash universe is cut into ``m`` segments; a set's part in a segment
is one *unit* of evidence, and in the first ``d`` segments, where one-deletion neighbourhoods are
indexed too, it is two. ``(m, d)`` is chosen per band by expected cost (rows written plus a charge for
parts of one element, which are weak keys) so that ``m + d`` exceeds ``H`` by some units to spare: two
linked sets then share not one key but at least ``1 + spare`` of them, beside empty parts. *Empty parts*
are keys only for sets that have more of them than the plan allows for.

Equal sets are one set, named by its digest. Keys of at most ``HOT`` sets are paired and the shared
keys of a pair counted; pairs below ``1 + spare`` go, less what the poorer side of the two has in hot keys.
Sets that hold more hot keys than they can spare (most keys of a large group of copies, or of a long
passage, are hot) are compared with each other in two steps. Each first meets the set in the middle of
its hot keys, the one that shares most of them with most: that joins a group of copies in rows linear in its size. Then
sets of different components meet by their rarest elements (a prefix filter by size class), which is
exact; the members outside a group have too many elements of their own to meet any of it. No cap drops a
link, and no group is listed as pairs. Candidates are verified on whole sets.

Defined results. Null or blank text: ``n_shingles`` 0, linked with nothing, own component. Repeated
rows and equal sets link (similarity 1). Fewer words than ``width``: one shingle of the whole
sequence. An id with several different texts has the links of all of them. Rows with a null id take no
part and are dropped. Extra columns are ignored. Empty table: empty result. Shingles and sets go by 64-bit hashes;
with ``N`` different sets, the chance that any two get one name is about ``N * N / 2**65``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dhwani.llm.common import Scratch, bound_batches, components, free_name, text_chunks
from dhwani.llm.wordhash import U, mix, shingle_sets

#: A key of more sets than this is hot.
HOT = 16
#: Largest band: sets of up to 2**28 elements.
BANDS = 26
#: Charge of a one-element part, in rows.
WEAK = 1.5
#: Sets a Python task remembers, to write the keys of equal sets once.
SEEN = 200_000
FILTER_BITS = 1 << 23


def bound(a: int, b: int, percent: int) -> int:
    """Largest symmetric difference of sets of sizes ``a`` and ``b`` that link."""
    return (100 - percent) * (a + b) // (100 + percent)


def _choose(need: int, small: int, large: int) -> tuple[int, int, int] | None:
    """(m, d, spare units for empty parts) of least expected cost for sets of small..large elements."""
    best = None
    typical = math.sqrt(small * large)
    for m in sorted({max(1, round(need * f)) for f in np.linspace(0.5, 1.6, 45)}):
        gone = m * math.exp(-small / m)
        spare = math.ceil(gone + 3 * math.sqrt(gone)) if m > 1 else 0
        d = max(0, need + spare - m)
        if d > m:
            continue
        x = typical / m
        rows = m * (1 - math.exp(-x)) + d * x
        weak = m * x * math.exp(-x) + d * x * x * math.exp(-x)
        cost = rows + WEAK * weak
        if best is None or cost < best[0]:
            best = (cost, m, d, m + d - need)
    return best and best[1:]


def plan(percent: int) -> dict[str, np.ndarray]:
    """Per space: segments m, two-unit segments d, spare units for empty parts and for hot keys, sizes.

    Space 2k holds the sets of size 4*2^k up to twice that, space 2k+1 the sets on either side of its
    upper edge that can link across.
    """
    rows = []
    for k in range(BANDS):
        low, edge = 4 << k, 8 << k
        reach = 100 * (edge - 1) // percent
        for lo, hi, h in (
            (low, edge - 1, bound(edge - 1, edge - 1, percent)),
            (-(-percent * edge // 100), reach, bound(edge - 1, reach, percent)),
        ):
            hot = min(2 + 2 * (h + 1) // 5, 16 + (h + 1) // 10)
            while (found := _choose(h + 1 + hot, lo, hi)) is None:
                hot -= 1  # the smallest sets cannot spare as many
            m, d, spare = found
            rows.append((m, d, spare, hot, lo, hi))
    return dict(zip(("m", "d", "spare", "hot", "lo", "hi"), np.array(rows, np.int64).T, strict=True))


def keys(d: np.ndarray, h: np.ndarray, n_docs: int, percent: int, p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Signature keys of sets given as (set index, ascending hash): (set index, key).

    The low six bits of a key are its space.
    """
    size = np.bincount(d, minlength=n_docs)
    first = np.cumsum(size) - size
    band = np.floor(np.log2(np.maximum(size, 1))).astype(np.int64) - 2
    big = size >= 4
    doc, space = [], []
    for s, ok in (
        (2 * band, big),
        (2 * band + 1, big & (size >= p["lo"][np.clip(2 * band + 1, 0, None)])),  # below the upper edge
        (2 * band - 1, big & (band > 0) & (size <= p["hi"][np.clip(2 * band - 1, 0, None)])),  # above the lower one
    ):
        at = np.flatnonzero(ok)
        doc.append(at)
        space.append(s[at])
    doc, space = np.concatenate(doc), np.concatenate(space)
    if not len(doc):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cnt = size[doc]
    e = np.repeat(np.arange(len(doc)), cnt)
    at = np.arange(len(e)) - np.repeat(np.cumsum(cnt) - cnt, cnt) + np.repeat(first[doc], cnt)
    x = h[at]
    m = p["m"][space]
    seg = (((x >> U(32)) * m[e].astype(np.uint64)) >> U(32)).astype(np.int64)
    y = mix(x + space[e].astype(np.uint64))
    new = np.ones(len(e), bool)
    new[1:] = (e[1:] != e[:-1]) | (seg[1:] != seg[:-1])
    g0 = np.flatnonzero(new)
    total = np.add.reduceat(y, g0)
    ge, gs, gn = e[g0], seg[g0], np.diff(np.append(g0, len(e)))
    two = p["d"][space]

    def key(owner: np.ndarray, segment: np.ndarray, content: np.ndarray) -> np.ndarray:
        sp = space[owner].astype(np.uint64)
        k = mix(content + segment.astype(np.uint64) * U(0x9E3779B97F4A7C15) + sp * U(0xC2B2AE3D27D4EB4F))
        return (k & ~U(63)) | sp

    out_e, out_k = [ge], [key(ge, gs, total)]
    # one-deletion neighbourhoods of the two-unit segments
    gi = np.cumsum(new) - 1
    dele = seg < two[e]
    alone = gn[gi] == 1
    pick = dele & ~alone
    out_e.append(e[pick])
    out_k.append(key(e[pick], seg[pick], total[gi[pick]] - y[pick]))
    # empty parts, as keys only where they are more than the spare units
    have2 = np.bincount(ge[gs < two[ge]], minlength=len(doc))
    have = np.bincount(ge, minlength=len(doc))
    single2 = np.bincount(e[dele & alone], minlength=len(doc))
    lost = (m - two - (have - have2)) + 2 * (two - have2) + single2
    for o in np.flatnonzero(lost > p["spare"][space]):
        mine = ge == o
        empty = np.setdiff1d(np.arange(m[o]), gs[mine], assume_unique=True)
        empty = np.append(empty, gs[mine & (gn == 1) & (gs < two[o])])
        again = empty[empty < two[o]]  # two units, and so two keys
        content = np.repeat(np.array([0, 1], np.uint64), (len(empty), len(again)))
        out_e.append(np.full(len(content), o))
        out_k.append(key(out_e[-1], np.append(empty, again), content))
    return doc[np.concatenate(out_e)], np.concatenate(out_k).view(np.int64)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.where("doc_id is not null")


def _names(d: np.ndarray, h: np.ndarray, n_docs: int) -> np.ndarray:
    """The 64-bit name of every set (0 of an empty one): a digest that the elements' order does not matter to."""
    out = np.zeros(n_docs, np.uint64)
    if len(d):
        first = np.flatnonzero(np.diff(d, prepend=-1))
        out[d[first]] = mix(np.add.reduceat(mix(h + U(1)), first))
    return out


def sketches(rows: DataFrame, width: int) -> DataFrame:
    """(doc_id, name, n): name and size of every document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_chunks(batches, "doc_id", "text"):
            d, h = shingle_sets(texts, width)
            n = np.bincount(d, minlength=len(ids)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "name": _names(d, h, len(ids)).view(np.int64), "n": n})

    return rows.mapInArrow(run, "doc_id long, name long, n long")


def _signatures(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """(key, name) of every set's keys."""
    p = plan(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for ids, texts in text_chunks(batches, "doc_id", "text"):
            d, h = shingle_sets(texts, width)
            if not len(d):
                continue
            name = _names(d, h, len(ids))
            fresh = np.zeros(len(ids), bool)
            for at in np.unique(d).tolist():
                s = int(name[at])
                if s not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(s)
                    fresh[at] = True
            keep = fresh[d]
            owner, k = keys(d[keep], h[keep], len(ids), percent, p)
            yield pa.RecordBatch.from_pydict({"key": k, "name": name[owner].view(np.int64)})

    return rows.mapInArrow(run, "key long, name long")


def _members(signatures: DataFrame) -> DataFrame:
    """(key, name, c): the different sets of every key of more than one, and their number."""
    by_name = Window.partitionBy("key").orderBy("name")
    of_key = Window.partitionBy("key")
    rows = signatures.withColumn("fresh", (F.col("name") != F.lag("name").over(by_name)) | F.lag("name").over(by_name).isNull())
    return rows.withColumn("c", F.count_if("fresh").over(of_key)).where("fresh and c > 1").select("key", "name", F.col("c").cast("int").alias("c"))


def _space() -> Column:
    return F.col("key").bitwiseAND(63).cast("int").alias("space")


def _spare(percent: int, space: Column) -> Column:
    return F.element_at(F.array(*[F.lit(int(x)) for x in plan(percent)["hot"]]), space + 1)


def _meeting(members: DataFrame, percent: int, hot_keys: DataFrame) -> DataFrame:
    """(a, b): sets that share as many keys of at most ``HOT`` sets as linked ones must.

    ``hot_keys`` holds (name, space, h), the number of a set's hot keys in a space.
    """
    few = members.where(F.col("c") <= HOT)
    pairs = few.select("key", F.col("name").alias("a")).join(few.select("key", F.col("name").alias("b")), "key").where("a < b")
    pairs = pairs.groupBy("a", "b", _space()).agg(F.count(F.lit(1)).alias("shared"))
    need = _spare(percent, F.col("space")) + 1 - F.col("shared")
    pairs = pairs.select("a", "b", "space", need.alias("lacks"))
    sure = pairs.where("lacks <= 0").select("a", "b")
    # what is lacking may be in hot keys of both
    rest = pairs.where("lacks > 0")
    for side in ("a", "b"):
        own = hot_keys.select(F.col("name").alias(side), "space", F.col("h").alias("h"))
        rest = rest.join(own, [side, "space"]).where("lacks <= h").drop("h")
    return sure.union(rest.select("a", "b")).distinct()


def _thinned(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of the wanted documents (``doc``) and, where they are many, of some others.

    The wanted ids are a bitmap of fixed size, at most ``FILTER_BITS / 64`` rows. What is made of the
    texts must still be joined with what is wanted.
    """
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("slot") % 64).cast("int"))
    bitmap = wanted.select(F.col("doc").alias("doc_id")).select(slot.alias("slot"))
    bitmap = bitmap.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    rows = rows.withColumn("slot", slot).join(F.broadcast(bitmap), F.shiftright("slot", 6) == F.col("word"))
    return rows.where(F.col("bits").bitwiseAND(bit) != 0).select("doc_id", "text")


def _sets(rows: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(name, n, items): the wanted sets (name, doc), once each, as little-endian 64-bit hashes in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_chunks(batches, "doc_id", "text"):
            d, h = shingle_sets(texts, width)
            cut = np.searchsorted(d, np.arange(len(ids) + 1))
            items = pa.array([h[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_pydict({"doc": pa.array(ids, pa.int64()), "name": _names(d, h, len(ids)).view(np.int64), "n": np.diff(cut), "items": items})

    sets = _thinned(rows, wanted).mapInArrow(run, "doc long, name long, n long, items binary")
    sets = sets.join(wanted.withColumnRenamed("doc", "of"), "name").where("doc = of")
    return sets.select("name", "n", "items").dropDuplicates(["name"])


def size_classes(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(smallest size, first partner class, last partner class) of classes about 2 % wide."""
    low = [1]
    while low[-1] < 1 << 29:
        low.append(max(low[-1] + 1, low[-1] * 51 // 50))
    low = np.array(low, np.int64)
    high = np.append(low[1:] - 1, low[-1])
    first = np.searchsorted(high, -(-percent * low // 100))
    last = np.searchsorted(low, 100 * high // percent, "right") - 1
    return low, first, last


def _rarest(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of ``sets`` (name, n, items, component) of different components that may link.

    With all elements in one order (number of sets that hold it, then hash), linked sets of sizes a and b
    share at least ``o = ceil(percent * (a + b) / (100 + percent))`` elements, so one of the first
    ``a - o + 1`` of the one is among the first ``b - o + 1`` of the other. They meet by an element and the
    size classes of both, of which only those that the element's holders span are written. Elements that one set alone holds, or one component, meet nothing.
    """
    low, first, last = size_classes(percent)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column("items")
            h = [np.frombuffer(x.as_buffer(), np.int64) for x in items]
            n = np.array([len(x) for x in h], np.int64)
            at = np.repeat(np.arange(len(n)), n)
            cols = {c: batch.column(c).to_numpy()[at] for c in ("name", "n", "component")}
            yield pa.RecordBatch.from_pydict({"key": np.concatenate([*h, np.empty(0, np.int64)]), **cols})

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, n, at, least, most = (batch.column(c).to_numpy() for c in ("key", "n", "at", "least", "most"))
            c, a, z = (np.searchsorted(low, x, "right") - 1 for x in (n, least, most))
            begin = np.maximum(first[c], a)  # a partner holds the element too
            many = np.maximum(np.minimum(last[c], z) - begin + 1, 0)
            row = np.repeat(np.arange(len(c)), many)
            other = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + begin[row]
            share = -(-percent * (n[row] + np.maximum(low[other], -(-percent * n[row] // 100))) // (100 + percent))
            ok = at[row] <= n[row] - share + 1
            row, other = row[ok], other[ok]
            pair = (np.minimum(c[row], other) << 12) | np.maximum(c[row], other)
            cols = {k: batch.column(k).to_numpy()[row] for k in ("name", "n", "component", "lone", "at")}
            yield pa.RecordBatch.from_pydict({"key": mix(key[row].view(np.uint64) + mix(pair.astype(np.uint64))).view(np.int64), **cols})

    items = sets.select("name", "n", "component", "items").mapInArrow(spread, "key long, name long, n long, component long")
    held = items.groupBy("key").agg(
        F.count(F.lit(1)).alias("often"), (F.min("component") < F.max("component")).alias("open"), F.min("n").alias("least"), F.max("n").alias("most"))
    shared = items.join(held.where("often > 1"), "key")
    own = Window.partitionBy("name")
    lone = F.col("n") - F.count(F.lit(1)).over(own)
    at = lone + F.row_number().over(own.orderBy("often", "key"))
    loosest = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    rare = shared.withColumn("lone", lone).withColumn("at", at).where((F.col("at") <= loosest) & F.col("open"))
    rare = rare.select("key", "name", "n", "component", "lone", "at", "least", "most").mapInArrow(expand, "key long, name long, n long, component long, lone long, at long")
    x, y = (rare.select("key", *[F.col(c).alias(f"{c}_{side}") for c in ("name", "n", "component", "lone", "at")]) for side in "ab")
    # the classes are a little loose: by the pair's own sizes, neither side may have fewer elements from here on than must be
    # shared, nor may the elements of one side alone be more than the sets may differ by
    total = F.col("n_a") + F.col("n_b")
    share = F.ceil(percent * total / (100 + percent))
    left = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) + 1
    apart = F.col("lone_a") + F.col("lone_b") + F.abs((F.col("n_a") - F.col("lone_a")) - (F.col("n_b") - F.col("lone_b")))
    fine = (left >= share) & (apart <= total - 2 * share)
    pairs = x.join(y, "key").where((F.col("name_a") < F.col("name_b")) & (F.col("component_a") != F.col("component_b")) & fine)
    return pairs.select(F.col("name_a").alias("a"), F.col("name_b").alias("b")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    y = sets.select(F.col("name").alias("b"), F.col("n").alias("nb"), F.col("items").alias("y"))
    x = sets.select(F.col("name").alias("a"), F.col("n").alias("na"), F.col("items").alias("x"))
    both = pairs.join(y, "b").join(x, "a").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            xs, ys = batch.column("x"), batch.column("y")
            for i in range(batch.num_rows):
                x, y = np.frombuffer(xs[i].as_buffer(), np.uint64), np.frombuffer(ys[i].as_buffer(), np.uint64)
                at = np.searchsorted(x, y)
                at[at == len(x)] = 0
                same = int(np.count_nonzero(x[at] == y))
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id) for every document; see the module's text.

    The signatures are complete from 80 percent on; less raises ValueError.
    """
    if percent < 80:
        raise ValueError(f"percent must be 80 or more: {percent}")
    bound_batches(docs.sparkSession)
    rows, disk = _rows(docs, id_col, text_col), Scratch(docs.sparkSession)
    stats = disk.write(sketches(rows, width), "sketch")
    named = disk.write(stats.where("n > 0").groupBy("name").agg(F.min("doc_id").alias("doc")), "named")
    members = disk.write(_members(_signatures(rows, width, percent)), "members")

    # sets with more hot keys than they can spare, and what meets in the middle of the hot keys
    hot = members.where(F.col("c") > HOT).select("key", "name", "c", _space())
    hot_keys = disk.write(hot.groupBy("name", "space").agg(F.count(F.lit(1)).alias("h"), F.sum("c").alias("w")), "hot")
    unsafe = disk.write(hot_keys.where(F.col("h") > _spare(percent, F.col("space"))), "unsafe")
    weight = unsafe.groupBy("name").agg(F.sum("w").alias("w"))
    crowd = hot.join(unsafe.select("name", "space"), ["name", "space"], "left_semi").join(weight, "name")
    middle = crowd.groupBy("key").agg(F.max(F.struct("w", "name")).alias("hub"))
    star = crowd.join(middle, "key").select(F.col("hub.name").alias("a"), F.col("name").alias("b"), "space").where("a <> b")
    star = star.groupBy("a", "b", "space").agg(F.count(F.lit(1)).alias("shared")).where(2 * F.col("shared") > _spare(percent, F.col("space")))
    pairs = disk.write(_meeting(members, percent, hot_keys).union(star.select(F.least("a", "b"), F.greatest("a", "b"))).distinct(), "pairs")
    disk.drop("members", "hot")

    loud = unsafe.select("name").distinct()
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("name")).union(loud).distinct().join(named, "name")
    sets = disk.write(_sets(rows, disk.write(wanted, "wanted"), width), "sets")
    links = disk.write(_verified(pairs, sets, percent), "links")
    comp = components(links, disk)
    loud = sets.join(loud, "name", "left_semi").join(comp.withColumnRenamed("node", "name"), "name", "left")
    rare = disk.write(_rarest(loud.withColumn("component", F.coalesce("component", "name")), percent), "rare")
    links = links.union(disk.write(_verified(rare, sets, percent), "links"))

    # an id with several texts ties their sets
    ties = stats.where("n > 0").groupBy("doc_id").agg(F.min("name").alias("a"), F.max("name").alias("z")).where("a <> z")
    ties = stats.where("n > 0").join(ties, "doc_id").select("a", F.col("name").alias("b")).where("a <> b")
    comp = components(links.union(ties), disk).withColumnRenamed("node", "name")
    placed = comp.join(named, "name")
    least = placed.groupBy("component").agg(F.min("doc").alias("least"))
    placed = disk.write(placed.join(least, "component").select("name", "least"), "placed")
    disk.drop_all_but("sketch", "named", "placed")
    out = stats.join(named, "name", "left").join(placed, "name", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("least", "doc")).alias("component_id"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents that are the smallest id of their component, with all their columns.

    Of repeated rows with that id all stay; rows with a null id stay.
    """
    gone = near_duplicates(docs, **options).where("component_id <> doc_id").select("doc_id").distinct()
    key = free_name(docs, "gone")
    return docs.join(gone.withColumnRenamed("doc_id", key), F.col(options.get("id_col", "doc_id")) == F.col(key), "left_anti")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(doc_id, k) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.y, r.k FROM r JOIN e ON e.x = r.doc_id)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, coalesce(min(r.k), d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id
"""
