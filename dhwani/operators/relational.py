"""The phoneme rules as relations: one row per cluster, neighbours by window functions.

An independent arrangement of the same rules for tables that are already exploded. Partitioned by text;
the array form in ``dhwani.functions.phonemes`` needs no shuffle and is the one to use on texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dhwani.functions.phonemes import cluster_tokens, clusters
from dhwani.functions.text import preprocess

#: Clusters before and after that any rule looks at.
REACH = 3


def cluster_rows(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, cluster, around): each cluster with those up to ``REACH`` away; null outside the text."""
    rows = texts.select(F.col(id_col).alias("id"), F.posexplode(clusters(preprocess(F.col(text_col)))).alias("pos", "cluster"))
    by = Window.partitionBy("id").orderBy("pos")
    near = [F.lag("cluster", k).over(by) for k in range(REACH, 0, -1)] + [F.col("cluster")] + [F.lead("cluster", k).over(by) for k in range(1, REACH + 1)]
    return rows.withColumn("around", F.array(*near))


def phonemes(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, phonemes) of every text; ids must be unique. Texts without clusters have no tokens."""
    rows = cluster_rows(texts, id_col, text_col)
    rows = rows.withColumn("tokens", cluster_tokens(F.col("around"), F.lit(REACH), F.col("cluster")))
    whole = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "tokens"))).alias("all"))
    whole = whole.select("id", F.flatten(F.transform("all", lambda r: r["tokens"])).alias("__found"))
    ids = texts.select(F.col(id_col).alias("id"), F.col(text_col).isNull().alias("__null"))
    found = F.when(~F.col("__null"), F.coalesce("__found", F.array().cast("array<string>")))
    return ids.join(whole, "id", "left").select("id", found.alias("phonemes"))
