"""Whole rows by id and text digest, so that a decision about a row reaches that row only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rows_at(docs: DataFrame, kept: DataFrame, digest: Column, content: Column | None = None, id_col: str = "doc_id") -> DataFrame:
    """One row of ``docs`` for each row of ``kept(first_id, digest, n_rows[, content])``, all columns unchanged.

    Rows match by id (null matches null) and digest; where ``content`` is given and a kept row has one,
    it must be equal too.  ``n_rows`` says how many rows match; of several the least by all columns
    stays, found with map-side folding.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    shared = ["content"] if content is not None else []
    extra = [content.alias("own_content")] if shared else []
    rows = docs.select(row, F.col(id_col).cast("long").alias("own_id"), digest.alias("own_digest"), *extra)
    on = (F.col("own_digest") == F.col("digest")) & F.col("own_id").eqNullSafe(F.col("first_id"))
    if shared:
        on = on & (F.col("content").isNull() | (F.col("content") == F.col("own_content")))
    found = rows.join(kept.select("first_id", "digest", "n_rows", *shared), on)
    alone = found.where("n_rows = 1").select("row")
    if kept.where("n_rows > 1").isEmpty():
        return alone.select("row.*")
    tied = found.where("n_rows > 1").groupBy("first_id", "digest", *shared).agg(F.min("row").alias("row"))
    return alone.unionByName(tied.select("row")).select("row.*")
