"""Token counts: the exact histogram of encoded lengths answers every question about context limits.

Texts are encoded whole in Arrow batches and leave a task as lengths; they are counted with map-side
combine.  Suffix sums over the histogram (its rows are bounded by the greatest length, not by the
documents) give totals, quantiles and truncated totals exactly.  The sums are taken in blocks of
lengths, so not even the histogram is ordered in one task.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from demandloom.plans.storage import cut_lineage

BLOCK = 512


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Merge ranks from the text form: a base64 token and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}


def token_lengths(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) for every row; a null text has no tokens.

    ``ranks`` is the content of the rank file and ``pattern`` the split that goes before its merges;
    special tokens' strings are ordinary text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(ranks), special_tokens={})
        for batch in batches:
            counts = [len(coder.encode_ordinary(t.as_py() or "")) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row per length that occurs, with what a context limit of that length means.

    n_docs have the length; docs_at_least and tokens_at_least count documents at least as long and
    their tokens; docs_at_most counts documents that fit; truncated_tokens is the total after cutting
    every document to the limit; share_at_most is docs_at_most over all documents.  Null lengths are
    left out; an empty table gives no rows.
    """
    counted = lengths.where("n_tokens IS NOT NULL").groupBy("n_tokens").agg(F.count("*").alias("n_docs"))
    tokens = F.col("n_tokens") * F.col("n_docs")
    # one row per length, read twice below; texts are encoded once
    counted = cut_lineage(counted.withColumn("tokens", tokens).withColumn("block", F.expr(f"n_tokens div {BLOCK}")))
    # one row per block of lengths
    blocks = counted.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    later = Window.orderBy(F.desc("block"))
    blocks = blocks.select(
        "block",
        (F.sum("d").over(later) - F.col("d")).alias("later_docs"),
        (F.sum("t").over(later) - F.col("t")).alias("later_tokens"),
        F.sum("d").over(Window.partitionBy()).alias("all_docs"),
        F.sum("t").over(Window.partitionBy()).alias("all_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    suffix = counted.join(blocks, "block").select(
        "n_tokens",
        "n_docs",
        (F.sum("n_docs").over(inside) + F.col("later_docs")).alias("docs_at_least"),
        (F.sum("tokens").over(inside) + F.col("later_tokens")).alias("tokens_at_least"),
        "all_docs",
        "all_tokens",
    )
    at_most = F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")
    cut = F.col("all_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")
    return suffix.select(
        "n_tokens",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        at_most.alias("docs_at_most"),
        cut.alias("truncated_tokens"),
        (at_most / F.col("all_docs")).alias("share_at_most"),
    )


def at_limits(histogram: DataFrame, limits: Sequence[int]) -> DataFrame:
    """(context_limit, docs_over, truncated_tokens, tokens_lost) for any limits, one row each."""
    spark = histogram.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in sorted(set(limits))], "context_limit long")
    crossed = histogram.select("n_tokens", "n_docs", F.explode(F.array(*(F.lit(int(x)) for x in sorted(set(limits))))).alias("x"))
    length = F.col("n_tokens") * F.col("n_docs")
    kept = F.least("n_tokens", "x") * F.col("n_docs")
    sums = crossed.groupBy(F.col("x").cast("long").alias("context_limit")).agg(
        F.sum(F.when(F.col("n_tokens") > F.col("x"), F.col("n_docs")).otherwise(0)).alias("docs_over"),
        F.sum(kept).alias("truncated_tokens"),
        F.sum(length - kept).alias("tokens_lost"),
    )
    return asked.join(sums, "context_limit", "left").na.fill(0)


def quantile_lengths(histogram: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(share, n_tokens): the smallest length that at least this share of documents does not exceed."""
    rows = histogram.select("n_tokens", "share_at_most", F.explode(F.array(*(F.lit(float(s)) for s in shares))).alias("share"))
    return rows.where("share_at_most >= share").groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
