"""The same column functions over streams. Stateless: no watermark is needed."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dhwani.functions.text import strip_ws
from dhwani.operators.evaluate import joined, with_tokens

#: The words that end a session.
QUIT = ("quit", "exit", "q")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty lines of text files as they arrive; the words that end a session are left out."""
    rows = spark.readStream.text(path).select(strip_ws(F.col("value")).alias("text"))
    return rows.where((F.col("text") != "") & ~F.lower("text").isin(*QUIT))


def until_quit(rows: DataFrame) -> DataFrame:
    """The rows (line_no, text) before the first of the words that end a session."""
    first = rows.where(F.lower(strip_ws(F.col("text"))).isin(*QUIT)).agg(F.min("line_no").alias("__end"))  # one row
    return rows.join(F.broadcast(first), F.col("__end").isNull() | (F.col("line_no") < F.col("__end"))).drop("__end")


def session(spark: SparkSession, path: str, checkpoint: str, write: Callable[[DataFrame], None], timeout: float | None = None) -> bool:
    """Runs ``write`` on the tokens of every batch of lines until a quit word ends the session.

    Lines of a batch come in file and line order. What follows the quit word, in its batch or later, is not
    written. Returns whether a quit word came before ``timeout`` seconds were over.
    """
    ended = threading.Event()

    def batch(rows: DataFrame, _: int) -> None:
        if ended.is_set():
            return
        rows = rows.withColumn("line_no", F.struct("file", F.monotonically_increasing_id().alias("at"))).persist()
        kept = until_quit(rows).select("line_no", strip_ws(F.col("text")).alias("text")).where("text <> ''")
        write(with_tokens(kept))
        if not rows.where(F.lower(strip_ws(F.col("text"))).isin(*QUIT)).isEmpty():
            ended.set()
        rows.unpersist()

    typed = spark.readStream.text(path).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    query = typed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
    stop = None if timeout is None else time.monotonic() + timeout
    while query.isActive and not ended.wait(0.2) and (stop is None or time.monotonic() < stop):
        pass
    query.stop()
    if query.exception():
        raise query.exception()
    return ended.is_set()


def tokens(stream: DataFrame) -> DataFrame:
    return with_tokens(stream)


def answered(stream: DataFrame, lexicon: DataFrame) -> DataFrame:
    """A stream of words enriched from a lexicon, which must be a stored table (not a text scan)."""
    return joined(stream, lexicon)


def start(stream: DataFrame, checkpoint: str, sink: str = "console", **options: str) -> StreamingQuery:
    return stream.writeStream.format(sink).outputMode("append").option("checkpointLocation", checkpoint).options(**options).start()
