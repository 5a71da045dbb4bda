"""Approximate nearest neighbours by learned partitions (largest inner product).

Method. A bounded sample of the vectors gives a neighbour graph, which is cut into balanced parts of few
crossing edges. A small classifier learns the parts of a vector and of its neighbours. Every vector is
stored in its ``COPIES`` most probable parts; a query goes to its most probable parts, as many as reach
the wanted recall on held-out vectors of the sample, and their vectors are reranked exactly in double
precision. Parts grow in number with the table. Where that is more than the sample can teach at once, each part is
cut again by a second partition, learnt in the same way on what the vectors of the sample differ by from the
middle of their part; a classifier for it routes within every part, and the probabilities multiply.

Equal vectors are one point with its ``k + 1`` smallest ids (no more can be in a result). Large parts are
stored in blocks, and so are the queries of a part, so that no task holds a part that is out of balance.
A block answers a block of queries with one row a query, whatever ``k``. Queries that find fewer than
``k`` others go to four times as many parts, until they have them or all parts are searched.

Defined results. Vectors that are null, zero or hold null or non-finite components take no part; nor do
null ids. Vectors of different lengths never meet: each length is a table of its own. Repeated rows of
one id and vector count once; an id with several vectors is a candidate by each, and a query by each
under the same id. Ties go to the smaller id. A query never finds its own id. Components keep their type (float or
double). Extra columns are ignored. Empty table: empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dhwani.llm.common import Scratch, bound_batches, release_memory

#: Vectors sampled to learn the parts: a bound, whatever the table's size.
SAMPLE = 4096
HELD_OUT = 400
#: Most parts that the sample can teach: 16 of its vectors each.
MAX_PARTS = SAMPLE // 16
PART_POINTS = 256
COPIES = 2
BLOCK = 2048
NEIGHBOURS = 10
HIDDEN = 128
RESULT = "query_id long, rank int, vec_id long, score double"


def neighbours(x: np.ndarray, k: int, rows: np.ndarray | None = None) -> np.ndarray:
    """Indices of the ``k`` others of largest inner product, for the given rows of ``x``."""
    rows = np.arange(len(x)) if rows is None else rows
    out = np.empty((len(rows), k), np.int64)
    for a in range(0, len(rows), 512):
        s = x[rows[a : a + 512]] @ x.T
        s[np.arange(len(s)), rows[a : a + 512]] = -np.inf
        out[a : a + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """Parts of the neighbour graph, each of at most 5 % over its share, with few crossing edges.

    Starts from halving along main directions; then nodes move to the part of most of their
    neighbours, best gains first, as room allows.
    """
    n = len(x)
    part = np.zeros(n, np.int64)
    todo = [(np.arange(n), parts, 0)]
    while todo:
        rows, p, first = todo.pop()
        if p == 1 or len(rows) < 2:
            part[rows] = first
            continue
        y = x[rows] - x[rows].mean(0)
        d = np.ones(y.shape[1])
        for _ in range(15):
            d = y.T @ (y @ d)
            norm = np.linalg.norm(d)
            if norm == 0:
                break
            d /= norm
        order = rows[np.argsort(y @ d, kind="stable")]
        left = p // 2
        cut = len(rows) * left // p
        todo += [(order[:cut], left, first), (order[cut:], p - left, first + left)]
    room = math.ceil(1.05 * n / parts)
    a, b = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    a, b = np.append(a, b), np.append(b, a)
    for _ in range(rounds):
        votes = np.zeros((n, parts), np.int32)
        np.add.at(votes, (a, part[b]), 1)
        want = votes.argmax(1)
        gain = votes[np.arange(n), want] - votes[np.arange(n), part]
        size = np.bincount(part, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[want[i]] < room:
                size[part[i]] -= 1
                size[want[i]] += 1
                part[i] = want[i]
                moved += 1
        if not moved:
            break
    return part


def train(x: np.ndarray, soft: np.ndarray, epochs: int = 15, rate: float = 3e-3) -> tuple[np.ndarray, ...]:
    """The weights of a classifier with one hidden layer, fitted to soft part labels (rows sum to 1) by Adam on cross-entropy."""
    rng = np.random.default_rng(7)
    dim, parts = x.shape[1], soft.shape[1]
    scale = 1 / max(1e-12, float(np.sqrt((x * x).mean()) * math.sqrt(dim)))
    w = [rng.normal(0, 2 * scale, (dim, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / math.sqrt(HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
    w, x, soft = [t.astype(np.float32) for t in w], x.astype(np.float32), soft.astype(np.float32)
    m, s = [np.zeros_like(t) for t in w], [np.zeros_like(t) for t in w]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), 256):
            at = order[a : a + 256]
            z = np.maximum(x[at] @ w[0] + w[1], 0)
            o = z @ w[2] + w[3]
            o = np.exp(o - o.max(1, keepdims=True))
            g = (o / o.sum(1, keepdims=True) - soft[at]) / len(at)
            gz = (g @ w[2].T) * (z > 0)
            step += 1
            for k, d in enumerate((x[at].T @ gz, gz.sum(0), z.T @ g, g.sum(0))):
                m[k] += 0.1 * (d - m[k])
                s[k] += 0.001 * (d * d - s[k])
                w[k] -= np.float32(rate * (scale if k < 1 else 1)) * (m[k] / np.float32(1 - 0.9**step)) / (np.sqrt(s[k] / np.float32(1 - 0.999**step)) + np.float32(1e-12))
    return tuple(t.astype(np.float64) for t in w)


class Router:
    """Routes vectors to parts by one classifier, or by a second one within the first one's parts."""

    def __init__(self, first: tuple[np.ndarray, ...], second: tuple[np.ndarray, ...] | None = None, middle: np.ndarray | None = None):
        self.first, self.second, self.middle = first, second, middle
        self.inner = second[-1].shape[0] if second else 1
        self.parts = first[-1].shape[0] * self.inner

    def best(self, x: np.ndarray, take: int) -> np.ndarray:
        """The ``take`` most probable parts of every vector, in order."""
        take = min(take, self.parts)
        outer = _log_probabilities(self.first, x)
        if not self.second:
            return np.argsort(-outer, axis=1, kind="stable")[:, :take]
        width = min(outer.shape[1], max(4, -(-2 * take // self.inner)))  # outer parts looked into
        top = np.argsort(-outer, axis=1, kind="stable")[:, :width]
        out = np.empty((len(x), take), np.int64)
        step = max(1, (1 << 21) // (width * max(self.inner, x.shape[1])))
        for a in range(0, len(x), step):
            t = top[a : a + step]
            rest = (x[a : a + step, None, :] - self.middle[t]).reshape(-1, x.shape[1])
            p = _log_probabilities(self.second, rest).reshape(len(t), width, self.inner) + np.take_along_axis(outer[a : a + step], t, 1)[:, :, None]
            order = np.argsort(-p.reshape(len(t), -1), axis=1, kind="stable")[:, :take]
            out[a : a + step] = np.take_along_axis(t, order // self.inner, 1) * self.inner + order % self.inner
        return out


def _log_probabilities(weights: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    w1, b1, w2, b2 = weights
    s = np.maximum(x @ w1 + b1, 0) @ w2 + b2
    s = s - s.max(1, keepdims=True)
    return s - np.log(np.exp(s).sum(1, keepdims=True))


def _partition(x: np.ndarray, parts: int) -> tuple[np.ndarray, ...]:
    """The weights of a classifier for balanced parts of the neighbour graph of ``x``."""
    near = neighbours(x, min(NEIGHBOURS, len(x) - 1))
    part = balanced_parts(x, near, parts)
    soft = np.zeros((len(x), parts))
    for c in range(near.shape[1]):
        np.add.at(soft, (np.arange(len(x)), part[near[:, c]]), 0.5 / near.shape[1])
    soft[np.arange(len(x)), part] += 0.5
    return train(x, soft)


def learn(x: np.ndarray, total: int, k: int, recall: float) -> tuple[Router, int]:
    """(router, probes) from the sample ``x`` of ``total`` points."""
    most, wanted = min(MAX_PARTS, len(x) // 16), math.ceil(total / PART_POINTS)
    if min(most, wanted) <= 1:
        return Router((np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))), 1
    held = np.arange(len(x)) % max(2, len(x) // HELD_OUT) == 0
    fit = x[~held]
    router = Router(_partition(fit, min(most, wanted)))
    if wanted > most:
        of = router.best(fit, 1)[:, 0]
        size = np.bincount(of, minlength=router.parts)
        middle = np.zeros((router.parts, x.shape[1]))
        np.add.at(middle, of, fit)
        middle /= np.maximum(size, 1)[:, None]
        router = Router(router.first, _partition(fit - middle[of], min(most, math.ceil(wanted / most))), middle)
    place = router.best(x, COPIES)
    rows = np.flatnonzero(held)
    true = neighbours(x, min(k, len(x) - 1), rows)
    needed = np.empty(true.shape, np.int64)
    for j, i in enumerate(rows):  # one row at a time: its ranks of all parts
        rank = np.empty(router.parts, np.int64)
        rank[router.best(x[i : i + 1], router.parts)[0]] = np.arange(router.parts)
        needed[j] = rank[place[true[j]]].min(1)
    return router, int(np.quantile(needed, recall, method="higher")) + 1


def _valid(x: Column) -> Column:
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return x.isNotNull() & fine & F.exists(x, lambda v: v != 0) & F.col("id").isNotNull()


def _packed(rows: DataFrame, part: str, size: int, disk: Scratch, names: tuple[str, str]) -> DataFrame:
    """Rows (part, point, vec, ids) in blocks of about ``size``: per block the vectors end to end, and their ids."""
    rows = disk.write(rows, "routed")
    sizes = rows.groupBy(part).agg(F.ceil(F.count(F.lit(1)) / size).alias("cut"))
    rows = rows.join(sizes, part).withColumn("block", F.pmod(F.xxhash64("point"), F.col("cut")))
    got = rows.groupBy(part, "block").agg(F.collect_list(F.struct("vec", "ids")).alias("all"))
    return got.select(part, F.col("all.vec").alias(names[0]), F.col("all.ids").alias(names[1]))


def _rerank(k: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                read = lambda c: np.frombuffer(b"".join(batch.column(c)[i].values.to_pylist()), kind).astype(np.float64)  # noqa: B023, E731
                lists, asked = batch.column("ids")[i].values, batch.column("qids")[i].values.flatten().to_numpy()
                counts, ids = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
                v, q = read("vecs").reshape(len(counts), -1), read("qvecs").reshape(len(asked), -1)
                start = np.cumsum(counts) - counts
                slack = 1e-13 * np.sqrt((v * v).sum(1).max()) * np.sqrt((q * q).sum(1))  # more than sums in another order differ by
                who, score = [], []
                for a in range(0, len(q), 256):
                    s = q[a : a + 256] @ v.T
                    edge = np.full(len(s), -np.inf)
                    if s.shape[1] > k + 1:
                        edge = np.partition(s, s.shape[1] - k - 1, axis=1)[:, -k - 1] - slack[a : a + 256]
                    for j in range(len(s)):
                        c = np.flatnonzero(s[j] >= edge[j])
                        exact = np.repeat((v[c] * q[a + j]).sum(1), counts[c])
                        n = counts[c]
                        own = ids[np.repeat(start[c] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                        best = np.lexsort((own, -exact))[: k + 1]
                        who.append(own[best])
                        score.append(exact[best])
                yield pa.RecordBatch.from_pydict({"point": asked, "found": pa.array(who, pa.list_(pa.int64())), "scores": pa.array(score, pa.list_(pa.float64()))})

    return run


def _search(rows: DataFrame, k: int, recall: float, kind: str) -> DataFrame:
    """The result for rows (id, vec, query) of one length."""
    spark = rows.sparkSession
    disk = Scratch(spark)
    first = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    points = rows.select("id", "vec").distinct().withColumn("at", first).where(F.col("at") <= k + 1).groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    points = disk.write(points.select("vec", "ids", F.col("ids")[0].alias("id0")).withColumn("point", F.xxhash64("vec", "id0")).drop("id0"), "points")
    asked = disk.write(rows.where("query").select("id", "vec").distinct().join(points.select("vec", "point"), "vec").select("id", "point"), "asked")

    total, n_ids = points.agg(F.count(F.lit(1)), F.sum(F.size("ids"))).first()
    sample = points.orderBy(F.xxhash64("point"), "point").limit(SAMPLE).select("vec").toArrow().column("vec").combine_chunks()
    x = np.asarray(sample.flatten(), np.float64).reshape(len(sample), -1)
    router, probes = learn(x, total, k, recall)
    del x, sample
    release_memory()
    parts, held = router.parts, spark.sparkContext.broadcast((router.first, router.second, router.middle))

    def routed(frame: DataFrame, take: int) -> DataFrame:
        """Rows (part, point, vec, ids), one for each of the ``take`` most probable parts; vectors as bytes."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            router = Router(*held.value)
            for batch in batches:
                for a in range(0, batch.num_rows, 1024):
                    some = batch.slice(a, 1024)
                    v = np.asarray(some.column("vec").flatten(), kind).reshape(some.num_rows, -1)
                    best = router.best(v.astype(np.float64), take)
                    at = np.repeat(np.arange(len(v)), best.shape[1])
                    vec = pa.array([r.tobytes() for r in v], pa.binary())
                    yield pa.RecordBatch.from_pydict({"part": best.ravel().astype(np.int32), "point": some.column("point").take(at), "vec": vec.take(at), "ids": some.column("ids").take(at)})

        return frame.select("point", "vec", "ids").mapInArrow(run, "part int, point long, vec binary, ids array<long>")

    index = disk.write(_packed(routed(points, min(COPIES, parts)), "part", BLOCK, disk, ("vecs", "ids")), "index")
    queries = points.join(asked.select("point").distinct(), "point", "left_semi").select("point", "vec", F.array("point").alias("ids"))

    def probed(queries: DataFrame, probes: int) -> DataFrame:
        """(point, near): per query the ``k + 1`` best of the parts it goes to, as (minus score, id)."""
        wanted = _packed(routed(queries, probes), "part", BLOCK, disk, ("qvecs", "qids"))
        best = wanted.join(index, "part").select("qvecs", "qids", "vecs", "ids").mapInArrow(_rerank(k, kind), "point long, found array<long>, scores array<double>")
        near = best.select("point", F.zip_with("found", "scores", lambda i, s: F.struct((-s).alias("s"), i.alias("id"))).alias("near"))
        near = near.groupBy("point").agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("near"))
        # a vector is found in each of its parts that were searched, with one score: next to itself
        near = near.select("point", F.slice("near", 1, (k + 1) * COPIES).alias("near"))
        fresh = F.filter("near", lambda r, i: (i == 0) | (r.id != F.coalesce(F.get("near", i - 1)["id"], r.id)))
        return disk.write(near.select("point", F.slice(fresh, 1, k + 1).alias("near")), "near")

    near, out = probed(queries, probes), []
    while True:
        short = F.size("near") < min(k + 1, n_ids)
        out.append(near.where(~short) if probes < parts else near)
        if probes >= parts or near.where(short).isEmpty():
            break
        probes = min(parts, 4 * probes)
        near = probed(queries.join(near.where(short).select("point"), "point", "left_semi"), probes)
    near = reduce(DataFrame.union, out)
    found = near.join(asked.withColumnRenamed("id", "query_id"), "point").select("query_id", F.slice(F.filter("near", lambda r: r.id != F.col("query_id")), 1, k).alias("near"))
    found = found.select("query_id", F.posexplode("near").alias("rank", "r"))
    disk.drop("routed", "index", "points")
    return found.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("r.id").alias("vec_id"), (-F.col("r.s")).alias("score"))


def search(table: DataFrame, is_query: Column, k: int = 20, recall: float = 0.92, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row where ``is_query`` holds.

    ``recall`` is the share of true neighbours that the probed parts must hold on the sample's
    held-out vectors.
    """
    bound_batches(table.sparkSession)
    single = table.schema[vec_col].dataType.elementType.typeName() == "float"
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>" if single else "array<double>").alias("vec"), F.coalesce(is_query, F.lit(False)).alias("query"))
    rows = rows.where(_valid(F.col("vec")))
    lengths = sorted(r[0] for r in rows.select(F.size("vec")).distinct().collect())  # one row a length
    found = [_search(rows.where(F.size("vec") == n), k, recall, "<f4" if single else "<f8") for n in lengths]
    return reduce(DataFrame.union, found) if found else table.sparkSession.createDataFrame([], RESULT)
