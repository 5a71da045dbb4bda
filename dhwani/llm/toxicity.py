"""Toxicity by classifier chains.

Method. Categories are predicted in sequence by logistic models over the hashed presence of
words and word beginnings and a few shape features; each later model also sees the earlier categories'
probabilities. While training, those are out-of-fold predictions, so that later models learn from
probabilities as good as they will get. A word gets a weight in a category if it stands in ``LEAST_DOCS``
sampled documents and its documents' rate of positives is ``SIGNIFICANT`` deviations from the sample's;
with few labels, the models rest on the shape features.

The models are fitted on at most ``train_rows`` labelled documents of at most ``train_bytes`` bytes each, those of
smallest id hash (a bound, see ``fit``); every document is scored, in one pass without a shuffle. What is
broadcast is one weight table of ``2^BITS`` numbers per category.

Defined results. Null or empty text: scored on no words. Labels that are null are left out; ids labelled
more than once take their highest label. Repeated rows repeat; of an id with several texts, one (of smallest
hash) can be in the sample. Null ids are scored. With no labels, or
one class only, a category's probability is its rate in the sample (0 without rows). Extra columns are
ignored. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dhwani.llm.common import bound_batches, release_memory, text_chunks
from dhwani.llm.wordhash import U, mix, words

BITS = 18
SHAPES = 5
#: Lengths of the word beginnings that are features beside the whole words, in bytes.
PREFIXES = (4, 5)
FOLDS = 3
SIGNIFICANT = 5.0
#: Words in fewer sampled documents than this get no weight.
LEAST_DOCS = 6
_UPPER = np.zeros(256)
_UPPER[65:91] = 1
_LETTER = np.zeros(256)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_DIGIT = np.zeros(256)
_DIGIT[48:58] = 1
_MARK = np.zeros(256)
_MARK[[33, 63, 64, 35, 36, 37, 38, 42, 124, 60, 62, 61, 95, 123, 125]] = 1


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, slot) pairs of words and their first bytes, without repeats, and the shapes of every text."""
    h, starts, n = words([_bare(t) for t in texts], PREFIXES)
    owner = np.repeat(np.arange(len(texts)), n) << BITS
    code = np.unique(np.concatenate([owner | (x >> U(64 - BITS)).astype(np.int64) for x in (h, *starts)]))
    data = np.frombuffer(b"".join(texts), np.uint8)
    stop = np.cumsum([len(t) for t in texts])
    shapes = np.zeros((len(texts), SHAPES))
    for k, kind in enumerate((_UPPER, _LETTER, _DIGIT, _MARK)):
        total = np.append(0, np.cumsum(kind[data]))
        shapes[:, k] = total[stop] - total[np.append(0, stop[:-1])]
    length = np.maximum(1, np.diff(stop, prepend=0))
    upper = shapes[:, 0] / np.maximum(1, shapes[:, 1])
    distinct = np.bincount(code >> BITS, minlength=len(texts))
    shapes = np.stack((upper, shapes[:, 2] / length, 10 * shapes[:, 3] / length, 1 - distinct / np.maximum(1, n) / len(PREFIXES), np.log1p(n) / 10), 1)
    return code >> BITS, code & ((1 << BITS) - 1), shapes


_PUNCT = bytes.maketrans(bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127)), b" " * 32)


def _bare(text: bytes) -> bytes:
    return text.translate(_PUNCT)


class Sparse:
    """Rows of present word slots and dense columns, the last of ones."""

    def __init__(self, row: np.ndarray, col: np.ndarray, dense: np.ndarray):
        self.n = len(dense)
        self.row, self.col, self.dense = row, col, dense

    def times(self, w: np.ndarray, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n) + self.dense @ v

    def back(self, g: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        return np.bincount(self.col, g[self.row], width), self.dense.T @ g


def logistic(x: Sparse, y: np.ndarray, width: int, rows: np.ndarray, rounds: int = 200, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights of an L2-regularised logistic model on the given rows, by full-batch Adam.

    Slots whose documents have a rate of positives within ``SIGNIFICANT`` deviations of the whole's
    get no weight.
    """
    w, v = np.zeros(width), np.zeros(x.dense.shape[1])
    if not rows.any():
        v[-1] = -20.0
        return w, v
    mean = np.clip(y[rows].mean(), 1e-6, 1 - 1e-6)
    v[-1] = np.log(mean / (1 - mean))
    if y[rows].min() == y[rows].max():
        return w, v
    of = rows[x.row]
    have = np.bincount(x.col[of], minlength=width)
    hit = np.bincount(x.col[of], y[x.row[of]], width)
    far = np.abs(hit - have * mean) > SIGNIFICANT * np.sqrt(np.maximum(have, 1) * mean * (1 - mean))
    kept = np.flatnonzero(far)
    keep = far[x.col]
    x = Sparse(x.row[keep], np.searchsorted(kept, x.col[keep]), x.dense)
    whole, w = w, np.zeros(len(kept))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(v), np.zeros_like(v)]
    for t in range(1, rounds + 1):
        p = _sigmoid(x.times(w, v))
        gw, gv = x.back(np.where(rows, p - y, 0.0) / rows.sum(), len(kept))
        gw = gw + decay * w
        for k, (theta, g) in enumerate(((w, gw), (v, gv))):
            m, s = state[2 * k], state[2 * k + 1]
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-9)
    whole[kept] = w
    return whole, v


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Chain:
    """A fitted chain: per category, weights of word slots and of shapes, earlier probabilities and 1."""

    def __init__(self, weights: list[tuple[np.ndarray, np.ndarray]]):
        self.weights = weights

    def predict(self, row: np.ndarray, slot: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        done: list[np.ndarray] = []
        for w, v in self.weights:
            dense = np.column_stack((shapes, *done, np.ones(len(shapes))))
            done.append(_sigmoid(np.bincount(row, w[slot], len(shapes)) + dense @ v))
        return np.column_stack(done)


def fit_chain(row: np.ndarray, slot: np.ndarray, shapes: np.ndarray, labels: np.ndarray, ids: np.ndarray) -> tuple[Chain, np.ndarray]:
    """A chain over the columns of ``labels`` (NaN where unknown), and its out-of-fold probabilities.

    Folds go by the hash of the id.
    """
    n = len(shapes)
    often = np.bincount(slot, minlength=1 << BITS) >= LEAST_DOCS
    keep = often[slot]
    used, col = np.unique(slot[keep], return_inverse=True)
    fold = (mix(ids.astype(np.int64).view(np.uint64)) % U(FOLDS)).astype(np.int64)
    weights, out = [], []
    for k in range(labels.shape[1]):
        y = np.nan_to_num(labels[:, k])
        known = ~np.isnan(labels[:, k])
        x = Sparse(row[keep], col, np.column_stack((shapes, *out, np.ones(n))))
        held = np.zeros(n)
        for f in range(FOLDS):
            w, v = logistic(x, y, len(used), known & (fold != f))
            p = _sigmoid(x.times(w, v))
            held[fold == f] = p[fold == f]
        w, v = logistic(x, y, len(used), known)
        whole = np.zeros(1 << BITS, np.float32)
        whole[used] = w
        weights.append((whole, v))
        out.append(held)
    return Chain(weights), np.column_stack(out)


def best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The probability at which the out-of-fold F1 is best (0.5 without positives)."""
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    if not len(hit) or not hit[-1]:
        return 0.5
    f1 = 2 * hit / (np.arange(1, len(hit) + 1) + hit[-1])
    return float(p[order][int(np.argmax(f1))])


def fit(docs: DataFrame, labels: DataFrame, categories: Sequence[str], train_rows: int = 5000, id_col: str = "doc_id", text_col: str = "text", train_bytes: int = 1 << 20) -> tuple[Chain, list[float]]:
    """A chain and a cut per category, from at most ``train_rows`` labelled documents.

    The sample is the labelled ids of smallest hash, one text each; only their features reach the driver.
    """
    bound_batches(docs.sparkSession)
    width = len(categories)
    picked = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.max(F.col(c)).cast("double").alias(f"y{k}") for k, c in enumerate(categories)])
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= train_bytes).join(F.broadcast(picked), "doc_id")  # at most train_rows ids
    rows = rows.groupBy("doc_id", *[f"y{k}" for k in range(width)]).agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ys = np.column_stack([batch.column(f"y{k}").to_numpy(zero_copy_only=False) for k in range(width)])
            at = 0
            for ids, texts in text_chunks([batch], "doc_id", "text"):
                row, slot, shapes = features(texts)
                cut = np.searchsorted(row, np.arange(1, len(ids)))
                slots = [s.astype(np.int32).tobytes() for s in np.split(slot, cut)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "slots": pa.array(slots, pa.binary()), "shapes": pa.array(shapes.tolist()), "y": pa.array(ys[at : at + len(ids)].tolist())})
                at += len(ids)

    got = rows.mapInArrow(run, "doc_id long, slots binary, shapes array<double>, y array<double>").toArrow().sort_by("doc_id").to_pydict()
    slots = [np.frombuffer(s, np.int32).astype(np.int64) for s in got["slots"]]
    if not slots:
        return Chain([(np.zeros(1 << BITS, np.float32), np.append(np.zeros(SHAPES + k), -20.0)) for k in range(width)]), [0.5] * width
    row = np.repeat(np.arange(len(slots)), [len(s) for s in slots])
    y = np.array(got["y"], float).reshape(len(slots), width)
    shapes, ids, slot = np.array(got["shapes"]), np.array(got["doc_id"]), np.concatenate(slots)
    del got, slots
    chain, out = fit_chain(row, slot, shapes, y, ids)
    del row, slot, shapes
    release_memory()
    return chain, [best_cut(out[:, k][~np.isnan(y[:, k])], y[:, k][~np.isnan(y[:, k])]) for k in range(width)]


def score(docs: DataFrame, labels: DataFrame, categories: Sequence[str] = ("quality", "toxic"), train_rows: int = 5000, id_col: str = "doc_id", text_col: str = "text", with_row: bool = False) -> DataFrame:
    """(doc_id, p_<category>..., is_<category>...) of every document.

    ``with_row`` adds the document's own columns as a struct ``row``.
    """
    chain, cuts = fit(docs, labels, categories, train_rows, id_col, text_col)
    held = docs.sparkSession.sparkContext.broadcast(chain.weights)
    ids, text = F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    docs_columns = docs.columns
    inside = with_row and docs.schema[text_col].dataType.typeName() == "string"  # the row holds the text: sent once
    rows = docs.select(ids, *([] if inside else [text]), *([F.struct("*").alias("row")] if with_row else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Chain(held.value)
        for batch in batches:
            at = 0
            of = batch.column("row").field(docs_columns.index(text_col)) if inside else batch.column("text")
            for ids, texts in text_chunks([pa.record_batch([batch.column("doc_id"), of], ["doc_id", "text"])], "doc_id", "text"):
                p = fitted.predict(*features(texts))
                cols = {"doc_id": pa.array(ids, pa.int64())}
                for k, c in enumerate(categories):
                    cols[f"p_{c}"] = p[:, k]
                for k, c in enumerate(categories):
                    cols[f"is_{c}"] = p[:, k] >= cuts[k]
                if with_row:
                    cols["row"] = batch.column("row").slice(at, len(ids))
                at += len(ids)
                yield pa.RecordBatch.from_pydict(cols)

    kinds = ["doc_id long", *(f"p_{c} double" for c in categories), *(f"is_{c} boolean" for c in categories)]
    if with_row:
        kinds.append(f"row {rows.schema['row'].dataType.simpleString()}")
    return rows.mapInArrow(run, ", ".join(kinds))
