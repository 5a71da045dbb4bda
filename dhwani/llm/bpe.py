"""Byte-level BPE encoding and decoding with a pair occurrence index.

Method. The distinct pieces of a batch that are not yet known are laid out in one symbol array. An
index maps every mergeable pair, by its rank, to all its positions in that array. Active ranks are
applied in ascending order from a heap; a rank's merge rewrites all its positions at once, and the
pairs it creates (whose ranks are always higher) are added to their own lists. Positions that an
earlier merge has changed are recognised and skipped. Texts are then the concatenation of their
pieces' ids. Decoding maps ids to byte strings and joins them.

The vocabulary file is a parameter and is read on every executor by its path.

Defined results. Null text: as empty, no ids. Special tokens inside a text are matched as the file's
added tokens. Texts are never cut. Rows repeat as given; null ids stay null. Extra columns are
ignored. Empty table: empty result.
"""

from __future__ import annotations

import heapq
import itertools
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dhwani.llm.common import bound_batches

#: How the byte-level pre-tokenizer cuts text: a fixed value of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of Latin characters only, where its classes are plain ranges; finds any other character.
ODD = re.compile("[^\t-\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]").search
_LATIN = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
PLAIN = rf"'(?:[stmd]|re|ve|ll)| ?[{_LATIN}]+| ?[0-9]+| ?[^\s{_LATIN}0-9]+|\s+(?!\S)|\s+"
#: Pieces a Python task remembers.
KNOWN = 1_500_000
NONE = np.int64(1 << 40)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for every byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Ids, byte strings and ranked pairs of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        ids: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = [b""] * (1 + max([*ids.values(), *self.special.values()]))
        for token, i in ids.items():
            if token not in self.special:
                self.bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        one = {b[0]: i for i, b in enumerate(self.bytes) if len(b) == 1}
        self.of_byte = np.array([one[b] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        code = np.array([(ids[a] << 20) | ids[b] for a, b in pairs], np.int64)
        self.result = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.rank_of = np.argsort(code, kind="stable")
        self.codes = code[self.rank_of]
        self.split = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.pieces = regex.compile(PATTERN).findall
        self.plain_pieces = re.compile(PLAIN).findall

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of every pair, NONE where there is no merge."""
        code = (left << 20) | right
        at = np.searchsorted(self.codes, code)
        at[at == len(self.codes)] = 0
        return np.where(self.codes[at] == code, self.rank_of[at], NONE)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge_pieces(v: Vocabulary, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all the non-empty pieces in order, number of ids of every piece)."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    n = len(data)
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    stop = np.cumsum(size)
    # symbols of a piece are linked; a sentinel at n closes both ends
    sym = np.append(v.of_byte[data], -1)
    nxt = np.arange(1, n + 2)
    nxt[stop - 1] = n
    prv = np.arange(-1, n)
    prv[stop - size] = n
    prv = np.append(prv, n)
    nxt[n] = n
    live = np.ones(n + 1, bool)
    live[n] = False
    rank = np.full(n + 1, NONE)
    inner = np.flatnonzero(nxt[:n] != n)
    rank[inner] = v.ranks(sym[inner], sym[nxt[inner]])
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def add(positions: np.ndarray, ranks: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        positions, ranks = positions[order], ranks[order]
        cut = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        starts = [0, *cut.tolist()]
        ends = [*cut.tolist(), len(ranks)]
        for r, a, b in zip(ranks[starts].tolist(), starts, ends, strict=True):
            if r in index:
                index[r].append(positions[a:b])
            else:
                index[r] = [positions[a:b]]
                heapq.heappush(heap, r)

    found = np.flatnonzero(rank[:n] != NONE)
    if len(found):
        add(found, rank[found])
    while heap:
        r = heapq.heappop(heap)
        lists = index.pop(r)
        at = lists[0] if len(lists) == 1 else np.concatenate(lists)
        at = at[rank[at] == r]
        if not len(at):
            continue
        if len(lists) > 1:
            at = np.unique(at)
        right = nxt[at]
        if len(at) > 1:
            # overlapping occurrences (the same symbol repeated): every second of a run, from its left
            chained = np.zeros(len(at), bool)
            chained[1:] = right[:-1] == at[1:]
            if chained.any():
                run0 = np.flatnonzero(~chained)
                nth = np.arange(len(at)) - np.repeat(run0, np.diff(np.append(run0, len(at))))
                at = at[nth % 2 == 0]
                right = nxt[at]
        after = nxt[right]
        sym[at] = v.result[r]
        live[right] = False
        rank[right] = NONE
        nxt[at] = after
        prv[after] = at
        prv[n] = n
        before = prv[at]
        # pairs that now start at the merged symbol, and those that end at it
        s = np.concatenate((at, before))
        t = np.concatenate((after, at))
        inside = (s != n) & (t != n)
        rank[at] = NONE
        s, t = s[inside], t[inside]
        new = v.ranks(sym[s], sym[t])
        rank[s] = new
        some = new != NONE
        if some.any():
            add(s[some], new[some])
    kept = np.concatenate(([0], np.cumsum(live[:n])))
    return sym[live].astype(np.uint32), kept[stop] - kept[stop - size]


class Encoder:
    """Encodes texts with one vocabulary; remembers pieces between calls, up to a bound."""

    def __init__(self, path: str):
        self.v = vocabulary(path)
        self._forget()

    def _forget(self) -> None:
        self.known: defaultdict[str, int] = defaultdict()
        self.known.default_factory = self.known.__len__
        ids = list(self.v.special.values())
        for token in self.v.special:
            _ = self.known[token]
        self.flat = np.array(ids, np.uint32)
        self.stop = np.arange(1, len(ids) + 1)

    def _pieces(self, text: str) -> list[str]:
        cut = self.v.plain_pieces if ODD(text) is None else self.v.pieces
        if self.v.split is None or not any(s in text for s in self.v.special):
            return cut(text)
        out: list[str] = []
        at = 0
        for m in self.v.split.finditer(text):
            out += cut(text[at : m.start()])
            out.append(m.group())
            at = m.end()
        return out + cut(text[at:])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text, as little-endian unsigned 32-bit integers."""
        if len(self.known) > KNOWN:
            self._forget()
        number = self.known.__getitem__
        places = []
        for text in texts:
            pieces = self._pieces(text)
            places.append(np.fromiter(map(number, pieces), np.int32, len(pieces)))
        old = len(self.stop)
        if len(self.known) > old:
            new = [p.encode() for p in itertools.islice(self.known, old, None)]
            flat, size = merge_pieces(self.v, new)
            self.stop = np.concatenate((self.stop, np.cumsum(size) + len(self.flat)))
            self.flat = np.concatenate((self.flat, flat))
        begin = np.concatenate(([0], self.stop[:-1]))
        out = []
        for at in places:
            first = begin[at]
            size = self.stop[at] - first
            end = np.cumsum(size)
            pos = np.repeat(first - (end - size), size) + np.arange(end[-1] if len(end) else 0)
            out.append(self.flat[pos].astype("<u4").tobytes())
        return out

    def decode(self, ids: bytes) -> str:
        get = self.v.bytes.__getitem__
        return b"".join(map(get, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


#: Texts whose new pieces are merged together, in characters.
BATCH_CHARS = 24_000_000


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ids as little-endian unsigned 32-bit integers in binary."""

    def flush(coder: Encoder, ids: list, texts: list[str]) -> Iterator[pa.RecordBatch]:
        done = coder.encode(texts)
        for a in range(0, len(ids), 500):
            codes = done[a : a + 500]
            cols = {"doc_id": pa.array(ids[a : a + 500], pa.int64()), "n_tokens": pa.array([len(c) // 4 for c in codes], pa.int64()), "ids": pa.array(codes, pa.binary())}
            if decode:
                cols["decoded"] = pa.array([coder.decode(c) for c in codes], pa.string())
            yield pa.RecordBatch.from_pydict(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(path)
        ids: list = []
        texts: list[str] = []
        size = 0
        for batch in batches:
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids.append(key)
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size >= BATCH_CHARS:
                    yield from flush(coder, ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield from flush(coder, ids, texts)

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary" + ", decoded string" * decode)


def digests(docs: DataFrame, path: str, **columns) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    return encoded(docs, path, **columns).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256")
    )
