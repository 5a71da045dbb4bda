"""Helpers that several operators share: scratch tables, row batches, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at a time inside a Python task, in bytes; bounds the size of temporary arrays.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder (tests); any other master raises, as its
    executors would not share one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="dhwani-"))
    return _OWN[0]


class Scratch:
    """The intermediate tables of one run, in the shared folder; they cut lineage and outlive executors."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[tuple[str, str]] = []

    def tidy(self) -> None:
        """Collects garbage, so that Spark's cleaner drops the shuffle files of steps that are done."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def write(self, df: DataFrame, tag: str) -> DataFrame:
        """The table, written and read back, after what earlier steps shuffled is dropped."""
        self.tidy()
        path = f"{scratch_dir(self.spark)}/{tag}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths.append((tag, path))
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tags: str) -> None:
        """Deletes the tables of these tags, which nothing reads any more."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for tag, path in self.paths:
            if tag in tags:
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(conf).delete(at, True)
        self.paths = [x for x in self.paths if x[0] not in tags]

    def drop_all_but(self, *tags: str) -> None:
        self.drop(*{t for t, _ in self.paths} - set(tags))


def written(df: DataFrame, tag: str) -> DataFrame:
    """The table, written to the shared folder and read back; it stays there."""
    return Scratch(df.sparkSession).write(df, tag)


def bound_batches(spark: SparkSession, limit: int = 4 << 20) -> None:
    """Bounds the Arrow batches sent to Python by bytes, for good, as rows hold whole texts or sets."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(name, "2147483647")).rstrip("bB")) > limit:
        spark.conf.set(name, str(limit))


def release_memory() -> None:
    """Gives freed memory back to the system, which the allocators of Arrow and C would keep."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, prolonged until no column of ``df`` has it in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_chunks(
    batches: Iterable[pa.RecordBatch], id_col: str, text_col: str, limit: int = CHUNK_BYTES
) -> Iterator[tuple[list[int], list[bytes]]]:
    """Ids and UTF-8 texts (null as empty) in runs of about ``limit`` bytes; no text is cut."""
    for batch in batches:
        ids = batch.column(id_col).to_pylist()
        texts = batch.column(text_col).cast(pa.large_binary())
        run_ids: list[int] = []
        run: list[bytes] = []
        size = 0
        for i, key in enumerate(ids):
            text = texts[i].as_py() or b""
            run_ids.append(key)
            run.append(text)
            size += len(text)
            if size >= limit:
                yield run_ids, run
                run_ids, run, size = [], [], 0
        if run_ids:
            yield run_ids, run


def components(edges: DataFrame, disk: Scratch | None = None) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows (node, component) with the smallest node.

    Alternating large-star and small-star steps, each cut by a table in the shared folder; nothing
    is collected, and an edge list that is already a forest of stars is settled. Nodes
    that touch no edge do not appear. Loops are ignored.
    """
    disk = disk or Scratch(edges.sparkSession)

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.select("a", "b")
        if large:
            both = both.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        joined = both.join(least, "a")
        if large:
            out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
                least.select("a", F.col("m").alias("b"))
            )
        return out.where("a <> b").distinct()

    # every stored edge points from the larger node to the smaller
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = disk.write(now, "edges")
    while True:
        ends = now.select(F.col("a").alias("node"), F.lit(1).alias("low"), F.lit(0).alias("high")).union(
            now.select("b", F.lit(0), F.lit(1)))
        ends = ends.groupBy("node").agg(F.sum("low").alias("low"), F.max("high").alias("high"))
        if ends.where("low > 1 or (low = 1 and high = 1)").isEmpty():  # a forest of stars
            break
        now = disk.write(star(star(now, True), False), "edges")
    top = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return top.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
