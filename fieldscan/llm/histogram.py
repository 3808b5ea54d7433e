"""Token counts by an exact histogram of encoded lengths.

Documents are aggregated by encoded length. Sums over the lengths above and below answer, for every context limit at
once, how many documents it truncates, how many tokens remain and which share of documents fits. The sums are made in
two steps, over ranges of lengths and inside each, so no task holds all lengths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

RANGE = 1024


def length_histogram(lengths: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """A row for each length that occurs: ``length, n_docs, docs_ge, tokens_ge`` (documents of this length or longer, and
    their tokens), ``docs_le, tokens_le``, ``truncated_total`` (tokens left if every document is cut to this length) and
    ``share_le`` (of documents that are no longer). A null length counts as 0; an empty table gives no rows.
    """
    length = F.coalesce(F.col(length_col).cast("long"), F.lit(0).cast("long"))
    hist = lengths.groupBy(length.alias("length")).agg(F.count("*").alias("n_docs"))
    # stored, as the ranges and the sums inside them both read it, and the lengths may be dear to make
    hist = cut(hist, "histogram")
    hist = hist.withColumn("n_tokens", F.col("length") * F.col("n_docs")).withColumn("range", F.floor(F.col("length") / RANGE))
    sums = [F.sum("n_docs").alias("docs_in"), F.sum("n_tokens").alias("tokens_in")]
    upto = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(F.lit(1))
    ranges = hist.groupBy("range").agg(*sums).select(
        "range",
        F.coalesce(F.sum("docs_in").over(upto), F.lit(0)).alias("docs_before"),
        F.coalesce(F.sum("tokens_in").over(upto), F.lit(0)).alias("tokens_before"),
        F.sum("docs_in").over(every).alias("docs"),
        F.sum("tokens_in").over(every).alias("tokens"),
    )
    inside = W.partitionBy("range").orderBy("length").rowsBetween(W.unboundedPreceding, 0)
    out = hist.join(ranges, "range")
    out = out.withColumn("docs_le", F.col("docs_before") + F.sum("n_docs").over(inside))
    out = out.withColumn("tokens_le", F.col("tokens_before") + F.sum("n_tokens").over(inside))
    return out.select(
        "length",
        "n_docs",
        (F.col("docs") - F.col("docs_le") + F.col("n_docs")).alias("docs_ge"),
        (F.col("tokens") - F.col("tokens_le") + F.col("n_tokens")).alias("tokens_ge"),
        "docs_le",
        "tokens_le",
        (F.col("tokens_le") + F.col("length") * (F.col("docs") - F.col("docs_le"))).alias("truncated_total"),
        (F.col("docs_le").cast("double") / F.col("docs")).alias("share_le"),
    )


def length_at(histogram: DataFrame, share: float) -> DataFrame:
    """The quantile: the least length that the given share of documents does not exceed, as one row ``length``."""
    return histogram.where(F.col("share_le") >= share).agg(F.min("length").alias("length"))


def truncated_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """``limit, docs_over, total``: for any limits, not only lengths that occur. Documents and tokens up to the limit
    come from the longest length within it, the others count the limit each."""
    spark = histogram.sparkSession
    asked = F.broadcast(spark.createDataFrame([(x,) for x in limits], "limit long"))
    per = histogram.join(asked, F.col("length") <= F.col("limit"), "right").groupBy("limit")
    found = per.agg(F.coalesce(F.max("docs_le"), F.lit(0)).alias("d"), F.coalesce(F.max("tokens_le"), F.lit(0)).alias("t"))
    whole = histogram.agg(F.coalesce(F.max("docs_le"), F.lit(0)).alias("docs"))
    return found.crossJoin(F.broadcast(whole)).select(
        "limit", (F.col("docs") - F.col("d")).alias("docs_over"), (F.col("t") + F.col("limit") * (F.col("docs") - F.col("d"))).alias("total")
    )
