"""Benchmark decontamination by q-gram lemma filtering.

Finds every benchmark item that occurs in a document with at most ``share`` of its characters edited.
Texts are compared by characters after A-Z are lower-cased and runs of blanks become one space.

Method. An occurrence of an item of ``m`` characters with at most ``e`` edits shares at least
``m - q + 1 - q * e`` q-grams with it, all within ``e`` diagonals (q-gram lemma). Hits of the items'
q-grams in a text are counted per item in diagonal bands that overlap by ``e``, so one band holds all of
them; bands that reach the bound are kept and verified by banded alignment. ``q`` is the largest of ``SIZES`` that
leaves a bound of at least 1 for the item's edits; items shorter than all of them allow no edits and must occur exactly.

A gram that repeats within an item counts once for each ``e + 1`` of its places, in both bands it may lie
in: repetitive texts make at most ``1 / share + 2`` hits a place and item, and lose none. Long texts are gone through in
pieces that overlap by the longest item.

The items are sent to every executor, ``MAX_BENCHMARK_BYTES`` at a time; the driver holds one such block, and each
further block is another pass over the documents. There is no shuffle.

Defined results. Null or blank items never occur; null or empty texts contain nothing. Of several
occurrences of an item in a text, that of fewest edits is reported, ties by place. Equal items are
each reported. Repeated rows give repeated results, rows with a null id are searched. Extra columns are ignored. Empty tables:
empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dhwani.llm.common import bound_batches, free_name, text_chunks
from dhwani.llm.wordhash import U, mix

#: Lengths of the grams.
SIZES = (12, 8)
SHARE = 0.05
MAX_BENCHMARK_BYTES = 8 << 20
#: Bytes of a text looked at at once, and hits expanded at once.
PIECE = 1 << 20
HITS = 1 << 20
TABLE_BITS = 20
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9:14] = 32
RESULT = "doc_id long, item_id long, edits long, first_char long, last_char long"


def folded(data: np.ndarray) -> np.ndarray:
    data = _FOLD[data]
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
    return data[keep]


def clean(text: bytes) -> bytes:
    return folded(np.frombuffer(text, np.uint8)).tobytes().strip(b" ")


def characters(text: bytes) -> np.ndarray:
    return np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)


def grams(data: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit code of the ``q`` characters from every place."""
    if len(data) < q:
        return np.empty(0, np.uint64)
    out, done, power = None, 0, mix(data.astype(np.uint64) + U(1))
    width = 1
    while True:  # codes of 1, 2, 4... characters, joined by the bits of q
        if q & width:
            out = power if out is None else out[: len(power) - done] * U(0x9E3779B97F4A7C15) + power[done:]
            done += width
        if 2 * width > q:
            return out[: len(data) - q + 1]
        power = mix(power[:-width] * U(0xC2B2AE3D27D4EB4F) + power[width:])
        width *= 2


def budget(m: int, share: float) -> int:
    """Edits allowed for an item of ``m`` characters."""
    return int(m * share)


def _place(text: np.ndarray, item: np.ndarray) -> int:
    """The first place of ``item`` in ``text``, or -1."""
    data, wanted, at = text.tobytes(), item.tobytes(), -1
    while True:
        at = data.find(wanted, at + 1)
        if at < 0 or at % 4 == 0:
            return at // 4 if at >= 0 else -1


def align(item: np.ndarray, text: np.ndarray, edits: int) -> tuple[int, int, int] | None:
    """Best occurrence of ``item`` in ``text`` with at most ``edits`` edits: (edits, start, end).

    Banded: the occurrence must start within ``len(text) - len(item)`` places, and cells further from
    the diagonals of such an occurrence than ``edits`` are not computed.
    """
    m, n = len(item), len(text)
    width = n - m + 2 * edits + 1  # diagonals -edits .. n - m + edits
    if width <= 0:
        return None
    big = m + n + 1
    off = np.arange(width) - edits  # text place minus item place
    cost = np.where((off >= 0) & (off <= n), 0, big)
    begin = np.where(cost == 0, off, 0)
    reach = np.arange(width)
    for i in range(1, m + 1):
        j = i + off
        ok = (j >= 0) & (j <= n)
        same = np.zeros(width, bool)
        inside = ok & (j >= 1)
        same[inside] = text[j[inside] - 1] == item[i - 1]
        new = np.where(inside, cost + ~same, big)
        new_begin = begin.copy()
        up = np.append(cost[1:], big) + 1  # item byte without a text byte
        better = up < new
        new = np.where(better, up, new)
        new_begin = np.where(better, np.append(begin[1:], 0), new_begin)
        new = np.where(ok, new, big)
        # text bytes without an item byte: running minimum along the row
        slid = new - reach
        low = np.minimum.accumulate(slid)
        take = np.maximum.accumulate(np.where(slid == low, reach, 0))
        cost = np.where(ok, low + reach, big)
        begin = new_begin[take]
    at = int(np.argmin(cost))
    if cost[at] > edits:
        return None
    return int(cost[at]), int(begin[at]), int(m + off[at])


def _grouped(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by all columns, and where a new group begins."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    return order, np.flatnonzero(new)


class Grams:
    """The places of the grams of some items, all of one length."""

    def __init__(self, items: list[np.ndarray], which: np.ndarray, edits: np.ndarray, q: int):
        self.q = q
        code = [grams(items[k], q) for k in which]
        item = np.repeat(which, [len(c) for c in code])
        place = np.concatenate([np.arange(len(c)) for c in code] + [np.empty(0, np.int64)])
        code = np.concatenate([*code, np.empty(0, np.uint64)])
        order, first = _grouped(code, item, place // (edits[item] + 1))
        self.item, self.place = item[order][first], place[order][first]
        self.wide = np.diff(np.append(first, len(order))) > 1
        self.place[self.wide] -= self.place[self.wide] % (edits[self.item[self.wide]] + 1)
        self.code, at = np.unique(code[order][first], return_index=True)
        self.first = np.append(at, len(first))
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self._slot(self.code)] = True

    @staticmethod
    def _slot(code: np.ndarray) -> np.ndarray:
        return (mix(code) >> U(64 - TABLE_BITS)).astype(np.int64)

    def hits(self, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place in data, entry) of all hits, in parts of about ``HITS``."""
        code = grams(data, self.q)
        at = np.flatnonzero(self.table[self._slot(code)]) if len(self.code) else np.empty(0, np.int64)
        if not len(at):
            return
        k = np.searchsorted(self.code, code[at])
        k[k == len(self.code)] = 0
        good = self.code[k] == code[at]
        at, k = at[good], k[good]
        if not len(at):
            return
        n = self.first[k + 1] - self.first[k]
        cut = np.flatnonzero(np.diff(np.cumsum(n) // HITS, prepend=-1))
        for a, z in zip(cut, np.append(cut[1:], len(n)), strict=True):
            m = n[a:z]
            yield np.repeat(at[a:z], m), np.repeat(self.first[k[a:z]] - np.cumsum(m) + m, m) + np.arange(m.sum())


class Index:
    """The q-grams of a block of items."""

    def __init__(self, items: list[tuple[int, bytes]], share: float):
        self.ids = [i for i, _ in items]
        self.items = [characters(t) for _, t in items]
        self.size = np.array([len(t) for t in self.items], np.int64)
        self.edits = np.array([budget(m, share) for m in self.size.tolist()], np.int64)
        q = np.zeros(len(items), np.int64)
        for size in sorted(SIZES):
            q[self.size - size + 1 - size * self.edits >= 1] = size
        self.need = self.size - q + 1 - q * self.edits
        self.grams = [Grams(self.items, np.flatnonzero(q == size), self.edits, size) for size in SIZES if (q == size).any()]
        self.short = np.flatnonzero(q == 0).tolist()
        self.overlap = int((self.size + self.edits).max(initial=0)) + max(SIZES)

    def _pieces(self, texts: list[bytes]) -> Iterator[list[tuple[int, int, np.ndarray]]]:
        """(text, place, characters) of folded texts, in runs of about ``PIECE`` bytes; long texts in pieces that overlap."""
        run, held = [], 0
        for d, text in enumerate(texts):
            data = folded(np.frombuffer(text, np.uint8))
            starts = np.flatnonzero((data & 0xC0) != 0x80) if len(data) > PIECE else None
            step = PIECE
            for a in range(0, max(1, len(data) if starts is None else len(starts)), step):
                if starts is None:
                    part = characters(data.tobytes())
                else:
                    end = a + step + self.overlap
                    part = characters(data[starts[a] : starts[end] if end < len(starts) else len(data)].tobytes())
                run.append((d, a, part))
                held += 4 * len(part)
                if held >= 4 * PIECE:
                    yield run
                    run, held = [], 0
                if starts is None:
                    break
        if run:
            yield run

    def find(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, edits, first character, end) of all items in all texts."""
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        for run in self._pieces(texts):
            for piece, item, hit in self._find([p for _, _, p in run]):
                d, offset, _ = run[piece]
                hit = (hit[0], hit[1] + offset, hit[2] + offset)
                found[d, item] = min(found.get((d, item), hit), hit)
        return [(d, i, *hit) for (d, i), hit in sorted(found.items())]

    def _find(self, parts: list[np.ndarray]) -> Iterator[tuple[int, int, tuple[int, int, int]]]:
        gap = np.full(max(SIZES), 0xFFFFFFFF, np.uint32)  # in no text, so that no gram crosses it unnoticed
        start = np.cumsum([0, *(len(p) + len(gap) for p in parts)])
        data = np.concatenate([x for p in parts for x in (p, gap)])
        for index in self.grams:
            cells = []
            for pos, entry in index.hits(data):
                item, doc = index.item[entry], np.searchsorted(start, pos, "right") - 1
                cell = (pos - start[doc] - index.place[entry] + (1 << 32) * (self.edits[item] + 1)) // (self.edits[item] + 1)
                wide = index.wide[entry]
                doc, item, cell = (np.append(x, x[wide] - k) for x, k in ((doc, 0), (item, 0), (cell, 1)))
                cells.append(self._counted(doc, item, cell, np.ones(len(doc), np.int64)))
            if not cells:
                continue
            # bands of 2e+1 diagonals, each overlapping the next by e: every run of e+1 lies in one; the count of band b is that of
            # the cells b and b+1
            doc, item, cell, n = (np.concatenate(x) for x in zip(*cells, strict=True))
            doc, item, band, n = self._counted(np.append(doc, doc), np.append(item, item), np.append(cell, cell - 1), np.append(n, n))
            ok = n >= self.need[item]
            for d, i, b in zip(doc[ok].tolist(), item[ok].tolist(), band[ok].tolist(), strict=True):
                e, m = int(self.edits[i]), int(self.size[i])
                base = (b - (1 << 32)) * (e + 1)  # the band's lowest diagonal
                a = max(0, base - e)
                window = parts[d][a : base + 2 * e + 1 + m + e]
                same = _place(window, self.items[i])
                hit = (0, same, same + m) if same >= 0 else align(self.items[i], window, e)
                if hit:
                    yield d, i, (hit[0], a + hit[1], a + hit[2])
        for s in self.short:
            for d, p in enumerate(parts):
                at = _place(p, self.items[s])
                if at >= 0:
                    yield d, s, (0, at, at + len(self.items[s]))

    @staticmethod
    def _counted(doc: np.ndarray, item: np.ndarray, cell: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        order, first = _grouped(doc, item, cell)
        return doc[order][first], item[order][first], cell[order][first], np.add.reduceat(n[order], first) if len(first) else n


#: The index that this Python worker built last, by its block's name.
_BUILT: dict[str, Index] = {}


def _blocks(benchmark: DataFrame, item_col: str, item_text: str) -> Iterator[list[tuple[int, bytes]]]:
    """The items, cleaned, in blocks of about ``MAX_BENCHMARK_BYTES``; one block at a time is held."""
    block, size = [], 0
    for row in benchmark.select(F.col(item_col).cast("long"), F.col(item_text).cast("string")).toLocalIterator():
        text = clean((row[1] or "").encode())
        if text:
            if size + len(text) > MAX_BENCHMARK_BYTES and block:
                yield block
                block, size = [], 0
            block.append((row[0], text))
            size += len(text)
    yield block


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, edits, first_char, last_char) of every item in every document.

    The span is in characters of the folded text, its end exclusive.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for block in _blocks(benchmark, item_col, item_text):
        held, name = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], held=held, name=name) -> Iterator[pa.RecordBatch]:
            if name not in _BUILT:
                _BUILT.clear()
                _BUILT[name] = Index(held.value, share)
            index = _BUILT[name]
            for ids, texts in text_chunks(batches, "doc_id", "text"):
                hits = [(ids[d], index.ids[i], e, a, z) for d, i, e, a, z in index.find(texts)]
                if hits:
                    cols = zip(("doc_id", "item_id", "edits", "first_char", "last_char"), zip(*hits, strict=True), strict=True)
                    yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in cols})

        found = rows.mapInArrow(run, RESULT)
        out = found if out is None else out.union(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents in which no item occurs, with all their columns; rows with a null id stay."""
    key = free_name(docs, "leaking")
    gone = leaks(docs, benchmark, share, id_col, text_col).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(gone, F.col(id_col) == F.col(key), "left_anti")
