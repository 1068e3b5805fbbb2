"""SimHash near-duplicates: fingerprints of word shingles, linked at a small Hamming distance.

Fingerprints are made in Arrow batches (one long integer per document leaves the task).  Linking works
on distinct fingerprints.  With a maximum distance d the 64 bits are cut into b blocks; two
fingerprints within d bits of each other agree on at least b - d whole blocks, so each fingerprint is
keyed by every choice of b - d blocks and joined on equal keys, and the Hamming distance is verified in
the join.

A key that many fingerprints share (the near copies of one text) would give quadratic work.  Members of
such keys are keyed again with 16 blocks of 4 bits: a pair still shares a key, and only 4d bits are
free, so a bucket holds at most 16^d distinct fingerprints whatever the data.  No link is lost: a pair
whose shared coarse key is cold meets there, and otherwise both of its members are keyed again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandloom.llm.components import connected_components
from demandloom.llm.kept_rows import rows_at
from demandloom.plans.storage import cut_lineage

BITS = 64
SEED = 42
# blocks of the coarse keys; more blocks make longer keys for larger corpora
BLOCKS = 4
FINE_BLOCKS = 16
# a coarse key shared by more distinct fingerprints is keyed again
HOT_KEY = 64
# hashes expanded into bits at once
SLICE = 1 << 15


def text_fingerprint(text: bytes, shingle: int) -> int:
    """The unsigned fingerprint of one text; zero without words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    k = min(shingle, len(words))
    n = len(words) - k + 1
    shingles = words if k == 1 else map(b" ".join, zip(*(words[i:] for i in range(k))))
    hashes = np.fromiter((xxh64_intdigest(s, SEED) for s in shingles), dtype="<u8", count=n)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, SLICE):
        part = hashes[at : at + SLICE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(
    docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", carried: Sequence[str] = ()
) -> DataFrame:
    """(doc_id, fingerprint, *carried): one row per row of ``docs``, the 64 bits as a long.

    Words are runs outside ASCII white space, A-Z lower-cased; texts of fewer words than a shingle are
    hashed whole; null and wordless texts have fingerprint zero.  Repeated rows and null ids stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [text_fingerprint(t.as_py() or b"", shingle) for t in batch.column(1)]
            signed = pa.array(np.array(marks, dtype=np.uint64).view(np.int64))
            columns = [batch.column(0), signed, *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fingerprint", *carried])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), *carried)
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "fingerprint")])
    return slim.mapInArrow(run, T.StructType([*schema, *(slim.schema[c] for c in carried)]))


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def block_masks(blocks: int, distance: int) -> list[int]:
    """Bit masks of every choice of ``blocks - distance`` blocks out of ``blocks``."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    block = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    return [_signed(sum(block[i] for i in kept)) for kept in combinations(range(blocks), blocks - distance)]


def _keyed(prints: DataFrame, blocks: int, distance: int) -> DataFrame:
    keys = [
        F.struct(F.lit(i).alias("choice"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("key"))
        for i, m in enumerate(block_masks(blocks, distance))
    ]
    return prints.select("fingerprint", F.explode(F.array(*keys)).alias("k")).select("fingerprint", "k.*")


def _verified(keyed: DataFrame, distance: int) -> DataFrame:
    left = keyed.select("choice", "key", F.col("fingerprint").alias("a"))
    right = keyed.select("choice", "key", F.col("fingerprint").alias("b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    return left.join(right, ["choice", "key"]).where((F.col("a") < F.col("b")) & close).select("a", "b")


def fingerprint_links(prints: DataFrame, distance: int = 2, blocks: int = BLOCKS, hot_key: int = HOT_KEY) -> DataFrame:
    """(a, b), a < b: every pair of distinct fingerprints at most ``distance`` bits apart, once."""
    if not 0 < distance < blocks <= FINE_BLOCKS:
        raise ValueError("the distance must be positive and below the number of blocks")
    keyed = _keyed(prints, blocks, distance)
    hot = cut_lineage(keyed.groupBy("choice", "key").count().where(F.col("count") > hot_key).select("choice", "key"))
    cold = keyed.join(hot, ["choice", "key"], "left_anti")
    again = keyed.join(hot, ["choice", "key"], "left_semi").select("fingerprint").distinct()
    fine = _keyed(again, FINE_BLOCKS, distance)
    return _verified(cold, distance).unionByName(_verified(fine, distance)).distinct()


def near_duplicates(
    docs: DataFrame, shingle: int = 3, distance: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per row of ``docs``.

    ``component_id`` is the smallest id reachable over links, the row's own included; null ids are
    never smallest, and a component of null ids only has a null one.  An empty table gives no rows.
    """
    rows = cut_lineage(fingerprints(docs, shingle, id_col, text_col))
    prints = cut_lineage(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("smallest")))
    rooted = _rooted(prints, distance)
    smallest = rooted.groupBy("root").agg(F.min("smallest").alias("component_id"))
    labels = rooted.join(smallest, "root").select("fingerprint", "component_id")
    return rows.join(labels, "fingerprint").select("doc_id", "fingerprint", "component_id")


def _rooted(prints: DataFrame, distance: int) -> DataFrame:
    """(fingerprint, root, smallest) of ``prints(fingerprint, smallest)``: root names the component."""
    roots = connected_components(fingerprint_links(prints.select("fingerprint"), distance))
    return prints.join(roots, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", F.coalesce("root", "fingerprint").alias("root"), "smallest"
    )


def distinct_rows(
    docs: DataFrame, shingle: int = 3, distance: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One whole row of ``docs`` for each component of :func:`near_duplicates`.

    It has the smallest id (null only where all are), of several texts under it the one with the least digest.
    """
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    rows = fingerprints(docs.withColumn("_digest", digest), shingle, id_col, text_col, ["_digest"])
    # equal ids and texts are folded map-side; no row is gathered
    counted = cut_lineage(rows.groupBy("fingerprint", "doc_id", "_digest").agg(F.count("*").alias("n_rows")))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_digest", "n_rows")
    prints = cut_lineage(counted.groupBy("fingerprint").agg(F.min(place).alias("smallest")))
    firsts = _rooted(prints, distance).groupBy("root").agg(F.min("smallest").alias("first"))
    kept = firsts.select(F.col("first.doc_id").alias("first_id"), F.col("first._digest").alias("digest"), "first.n_rows")
    return rows_at(docs, kept, digest, id_col=id_col)
