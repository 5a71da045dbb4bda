"""Cross-entropy difference scoring with matched word bigram models.

Method. A target model and a background model share one vocabulary: all words of all documents, or the
``size`` most frequent ones if a size is given (other words then fall into ``UNKNOWN`` classes by their
length in bytes). Both are interpolated bigram models with the same constants, counted over all documents
(background) and over all documents of the target (target). A document is scored by models that have not
seen it: its own counts are taken out of both (out of the target's only if it is in the target), while its copies'
stay in. Its score is the mean over its tokens of the loss under the target model minus the loss under the
background model: low scores are most like the target.

No table of the model is broadcast or collected. Documents are dealt into chunks of about ``CHUNK`` bytes
by their id. A chunk sends the counts of its distinct words and pairs, by 64-bit hash, to buckets of the
hash; a bucket adds them up and sends each chunk the sums of the words and pairs it asked for, in the
chunk's order. A word or pair makes one entry a chunk, however frequent it is, so no key is hot.

Defined results. Null text, or one without words: ``n_tokens`` 0 and null scores. Ties for the last
vocabulary places go to the smaller hash. Repeated rows count and score each. Rows with a null id are
scored, and count as background. An empty target gives uniform target losses. Extra columns are ignored.
Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dhwani.llm.common import CHUNK_BYTES, Scratch, bound_batches, text_chunks
from dhwani.llm.wordhash import U, mix, words

UNKNOWN = 32
#: Weight of the unigram model: pseudo-counts given to every history.
PRIOR = 20.0
#: Words that a counting task holds before it folds them.
FOLD = 4_000_000
#: Text of a chunk in bytes, and the least number of chunks and buckets.
CHUNK = 3 << 20
LEAST = 24
_CLASS = mix(np.arange(1, UNKNOWN + 1, dtype=np.uint64) * U(0xD6E8FEB86659FD93))
_EDGE = U(0x5851F42D4C957F2D)
_ZSTD = pa.Codec("zstd", 1)
_PAIR = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F))


def _fold(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    k = np.concatenate([a for a, _ in parts])
    c = np.concatenate([b for _, b in parts])
    if not len(k):
        return [(k, c)]
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    return [(k[first], np.add.reduceat(c, first))]


def _counted(docs: DataFrame, of_chunk) -> DataFrame:
    """(key, n): counts of the 64-bit keys that ``of_chunk(texts)`` gives, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for _, texts in text_chunks(batches, "doc_id", "text"):
            k, c = np.unique(of_chunk(texts), return_counts=True)
            parts.append((k.view(np.int64), c))
            held += len(k)
            if held >= FOLD:
                parts = _fold(parts)
                held = len(parts[0][0])
                if held >= FOLD // 2:
                    yield pa.RecordBatch.from_pydict({"key": parts[0][0], "n": parts[0][1]})
                    parts, held = [], 0
        if parts:
            k, c = _fold(parts)[0]
            for a in range(0, len(k), 100_000):
                yield pa.RecordBatch.from_pydict({"key": k[a : a + 100_000], "n": c[a : a + 100_000]})

    return docs.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def tokens(texts: list[bytes], vocabulary: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words of every text); words outside a vocabulary by length."""
    hashes, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    held = np.cumsum([len(t) for t in texts]) // CHUNK_BYTES  # in runs: hashing takes many times a run's bytes
    cuts = [*np.flatnonzero(np.diff(held, prepend=-1)).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        h, size, n = words(texts[a:b])
        if vocabulary is not None:
            h = np.where(np.isin(h, vocabulary), h, _CLASS[np.minimum(size, UNKNOWN) - 1])
        hashes.append(h)
        counts.append(n)
    return np.concatenate(hashes), np.concatenate(counts)


def pairs(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word before every word, hash of the pair); a text starts after an edge."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[(np.cumsum(n) - n)[n > 0]] = _EDGE
    return before, mix(before * _PAIR[0] + h * _PAIR[1])


def _packed(x: np.ndarray) -> bytes:
    """64-bit numbers by byte planes, compressed: small ones leave planes of zeros."""
    data = np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(data).to_bytes(8, "little") + _ZSTD.compress(data, asbytes=True)


def _unpacked(data: bytes, kind=np.int64) -> np.ndarray:
    data = _ZSTD.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(kind).ravel()


def _texts(table: pa.Table) -> list[bytes]:
    return [x or b"" for x in table.column("text").cast(pa.large_binary()).to_pylist()]


def _distinct(texts: list[bytes], vocabulary: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """(words per text, distinct words, each word's place, place of the word before or -1, distinct pairs, each pair's place)."""
    h, n = tokens(texts, vocabulary)
    hashed = pairs(h, n)[1]
    w, at = np.unique(h, return_inverse=True)
    del h
    at = at.astype(np.int32)
    before = np.empty_like(at)
    before[1:] = at[:-1]
    before[(np.cumsum(n) - n)[n > 0]] = -1
    p, pair_at = np.unique(hashed, return_inverse=True)
    return n, w, at, before, p, pair_at.astype(np.int32)


def _buckets(keys: np.ndarray, n: int) -> np.ndarray:
    """First place of every bucket in ascending keys, and their number: buckets follow the keys' order."""
    return np.searchsorted(((keys >> U(32)) * U(n)) >> U(32), np.arange(n + 1))


_SENT = "chunk int, bucket int, words binary, word_counts binary, pairs binary, pair_counts binary"
_SUMS = "chunk int, bucket int, word_counts binary, pair_counts binary, totals array<long>"


def _sent(n_buckets: int, vocabulary: np.ndarray | None):
    def run(docs: pa.Table, good: pa.Table) -> pa.Table:
        """A chunk's distinct words and pairs with their counts in all its documents and in the target's."""
        out: dict[str, list] = {c.split()[0]: [] for c in _SENT.split(", ")}
        if docs.num_rows:
            n, w, at, before, p, pair_at = _distinct(_texts(docs), vocabulary)
            mine = np.repeat(_inside(docs.column("doc_id"), good.column("doc_id")), n)
            count = lambda x, size: np.bincount(x[x >= 0], minlength=size)
            of_words = [count(at, len(w)), count(at[mine], len(w)), count(before, len(w)), count(before[mine], len(w))]
            of_pairs = [count(pair_at, len(p)), count(pair_at[mine], len(p))]
            cut_w, cut_p = _buckets(w, n_buckets), _buckets(p, n_buckets)
            for b in range(n_buckets):
                i, j, k, m = cut_w[b], cut_w[b + 1], cut_p[b], cut_p[b + 1]
                if j > i or m > k:
                    out["bucket"].append(b)
                    out["words"].append(_packed(np.diff(w[i:j], prepend=U(0))))
                    out["word_counts"].append(_packed(np.concatenate([c[i:j] for c in of_words])))
                    out["pairs"].append(_packed(np.diff(p[k:m], prepend=U(0))))
                    out["pair_counts"].append(_packed(np.concatenate([c[k:m] for c in of_pairs])))
            out["chunk"] = [docs.column("chunk")[0].as_py()] * len(out["bucket"])
        kinds = {"chunk": pa.int32(), "bucket": pa.int32()}
        return pa.table({c: pa.array(v, kinds.get(c, pa.binary())) for c, v in out.items()})

    return run


def _summed(table: pa.Table) -> pa.Table:
    """A bucket's sums for every chunk, in the order in which the chunk sent its keys.

    The first row holds the number of distinct words and the sums of all counts.
    """
    out = {"chunk": table.column("chunk"), "bucket": table.column("bucket")}
    for name, kinds in (("word", 4), ("pair", 2)):
        keys = [np.cumsum(_unpacked(x.as_py(), np.uint64), dtype=np.uint64) for x in table.column(f"{name}s")]
        counts = [_unpacked(x.as_py()).reshape(kinds, -1) for x in table.column(f"{name}_counts")]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.zeros((kinds, len(distinct)), np.int64)
        start = 0
        for c in counts:  # a chunk's keys are distinct
            sums[:, at[start : start + c.shape[1]]] += c
            start += c.shape[1]
        if name == "word":
            out["totals"] = pa.array([[len(distinct), *sums.sum(1).tolist()]] + [None] * (len(counts) - 1), pa.list_(pa.int64()))
        start, back = 0, []
        del keys, distinct
        for c in counts:
            back.append(_packed(sums[:, at[start : start + c.shape[1]]].ravel()))
            start += c.shape[1]
        out[f"{name}_counts"] = pa.array(back, pa.binary())
    pa.default_memory_pool().release_unused()
    return pa.table({c.split()[0]: out[c.split()[0]] for c in _SUMS.split(", ")})


def _own(owner: np.ndarray, place: np.ndarray) -> np.ndarray:
    """How often every token's ``place`` occurs in the token's own text."""
    _, at, n = np.unique(owner * (int(place.max(initial=0)) + 2) + place + 1, return_inverse=True, return_counts=True)
    return n[at].astype(np.int32)


def _inside(ids: pa.ChunkedArray, good: pa.ChunkedArray) -> np.ndarray:
    """Which documents are in the target."""
    ids = ids.combine_chunks()
    if not len(good):
        return np.zeros(len(ids), bool)
    return np.isin(ids.fill_null(0).to_numpy(zero_copy_only=False), good.to_numpy()) & ids.is_valid().to_numpy(zero_copy_only=False)


def _scored(vocabulary: np.ndarray | None, types: int, n_tokens: tuple[int, int], n_texts: tuple[int, int]):
    def run(docs: pa.Table, sums: pa.Table) -> pa.Table:
        n, w, at, before, p, pair_at = _distinct(_texts(docs), vocabulary)
        inside = _inside(docs.column("doc_id"), sums.column("doc_id").drop_null())
        sums = sums.filter(pc.is_valid(sums.column("word_counts")))
        rows = sorted(zip(*(sums.column(c).to_pylist() for c in ("bucket", "word_counts", "pair_counts")), strict=True))
        joined = lambda i, kinds: np.concatenate([np.zeros((kinds, 0), np.int64), *(_unpacked(r[i]).reshape(kinds, -1) for r in rows)], 1)
        of_words, of_pairs = joined(1, 4), joined(2, 2)
        owner = np.repeat(np.arange(len(n)), n)
        own_word, own_history, own_pair = _own(owner, at), _own(owner, before), _own(owner, pair_at)
        means = []
        for i in (1, 0):  # the target, the background
            mine = inside if i else np.ones(len(n), bool)
            out, had = mine[owner], n_tokens[i] - n * mine
            one = (of_words[i][at] - own_word * out + 1.0) / (had[owner] + types)
            history = np.append(of_words[2 + i], n_texts[i])[before] - own_history * out  # the last one is the edge's
            loss = -np.log((of_pairs[i][pair_at] - own_pair * out + PRIOR * one) / (history + PRIOR))
            with np.errstate(invalid="ignore"):
                means.append(np.bincount(owner, loss, len(n)) / n)
        cols = {"doc_id": docs.column("doc_id").combine_chunks(), "n_tokens": pa.array(n.astype(np.int64))}
        for name, x in (("target_loss", means[0]), ("background_loss", means[1]), ("loss_difference", means[0] - means[1])):
            cols[name] = pa.array(x, pa.float64(), mask=n == 0)
        return pa.table(cols)

    return run


def score(docs: DataFrame, target_ids: DataFrame, size: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, loss_difference), losses in nats per token.

    ``target_ids`` holds the ids (doc_id) of the target's documents.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_chunks, n_buckets = max(LEAST, -(-held // CHUNK)), max(LEAST, -(-held // (2 * CHUNK)))
    vocabulary = None
    if size is not None:
        top = _counted(rows, lambda texts: words(texts)[0]).orderBy(F.desc("n"), "key").limit(size).toArrow()
        vocabulary = np.sort(top.column("key").to_numpy().view(np.uint64))

    chunk = lambda x: F.pmod(F.xxhash64(x), F.lit(n_chunks)).cast("int").alias("chunk")
    rows = rows.select(chunk(F.coalesce("doc_id", F.xxhash64("text"))), "doc_id", "text").groupBy("chunk")
    good = target_ids.select(F.col("doc_id").cast("long")).where("doc_id is not null").distinct().select(chunk(F.col("doc_id")), "doc_id")
    sent = rows.cogroup(good.groupBy("chunk")).applyInArrow(_sent(n_buckets, vocabulary), _SENT)
    disk = Scratch(docs.sparkSession)
    sums = disk.write(sent.groupBy("bucket").applyInArrow(_summed, _SUMS), "sums")
    totals = sums.where("totals is not null").agg(*[F.sum(F.col("totals")[i]) for i in range(5)]).first()
    types, *n = [x or 0 for x in totals]
    types = (types if vocabulary is None else len(vocabulary)) + UNKNOWN
    texts = (n[0] - n[2], n[1] - n[3])  # every word but a text's last is the history of one
    del sent
    disk.tidy()
    back = sums.select("chunk", "bucket", "word_counts", "pair_counts").unionByName(good, allowMissingColumns=True)
    scored = rows.cogroup(back.groupBy("chunk"))
    return scored.applyInArrow(_scored(vocabulary, types, (n[0], n[1]), texts), "doc_id long, n_tokens long, target_loss double, background_loss double, loss_difference double")
