"""Exact deduplication by Grace hashing.

Equal texts are found by comparing complete contents, never by trusting a hash:

1. Each map task folds its own rows into an open-addressing table, so a text that fills a third of the
   corpus leaves one record per task (pre-aggregation before the shuffle).
2. The records are dealt into buckets by content hash through the shuffle.
3. A reduce task folds its bucket into the same table.  When the distinct contents outgrow the memory
   given to it, table and further records are partitioned into spill files by the next four bits of the
   hash, and every file is treated the same way, until each fits.

The table's result holds hashes and ids only (no contents) and is cut with a checkpoint; it is joined
back to the rows on the hash.  Should two contents ever share a hash, their records also carry the
content and the join compares it.

Spill files are a task's own scratch, like Spark's sort spills: opened in an unnamed temporary file,
read by no other task, gone when closed, and made anew if the task runs again elsewhere.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.llm.kept_rows import rows_at
from demandloom.plans.storage import cut_lineage

WHITE_RUN = r"[\x20\x09-\x0D]+"
# bytes of distinct contents a task's table may hold before it is spilled
TABLE_BYTES = 32 << 20
FANOUT_BITS = 4
# hash digits are used four bits at a time; the first ones choose the shuffle bucket's order of magnitude
FIRST_DIGIT = 16
ROWS_OUT = 256

Record = tuple[str, bytes, int | None, int, int]  # hash, content, smallest id, rows, rows with that id


class ContentTable:
    """Open addressing with linear probing; a slot holds the number of an entry."""

    def __init__(self) -> None:
        self.slots = np.full(1024, -1, dtype=np.int64)
        self.entries: list[list] = []
        self.content_bytes = 0

    def add(self, record: Record) -> None:
        digest, content, first, rows, ties = record
        at = int(digest[:15], 16) & (len(self.slots) - 1)
        while (found := self.slots[at]) >= 0:
            entry = self.entries[found]
            if entry[0] == digest and entry[1] == content:
                entry[3] += rows
                if first is not None and (entry[2] is None or first < entry[2]):
                    entry[2], entry[4] = first, ties
                elif first == entry[2]:
                    entry[4] += ties
                return
            at = (at + 1) & (len(self.slots) - 1)
        self.slots[at] = len(self.entries)
        self.entries.append([digest, content, first, rows, ties])
        self.content_bytes += len(content)
        if 2 * len(self.entries) > len(self.slots):
            self._grow()

    def _grow(self) -> None:
        self.slots = np.full(2 * len(self.slots), -1, dtype=np.int64)
        for number, entry in enumerate(self.entries):
            at = int(entry[0][:15], 16) & (len(self.slots) - 1)
            while self.slots[at] >= 0:
                at = (at + 1) & (len(self.slots) - 1)
            self.slots[at] = number


def grace_tables(records: Iterable[Record], table_bytes: int, digit: int = FIRST_DIGIT) -> Iterator[ContentTable]:
    """Tables that together hold every distinct content of ``records`` once."""
    table, spills = ContentTable(), None
    for record in records:
        if spills is None:
            table.add(record)
            # one content alone can't be split; 64 digits are all there are
            if table.content_bytes > table_bytes and len(table.entries) > 1 and digit < 64:
                spills = [tempfile.TemporaryFile() for _ in range(1 << FANOUT_BITS)]
                for entry in table.entries:
                    pickle.dump(tuple(entry), spills[int(entry[0][digit], 16)], protocol=5)
                table = None
        else:
            pickle.dump(record, spills[int(record[0][digit], 16)], protocol=5)
    if spills is None:
        yield table
        return
    while spills:
        with spills.pop() as spill:
            spill.seek(0)
            yield from grace_tables(_read(spill), table_bytes, digit + 1)


def _read(spill) -> Iterator[Record]:
    while True:
        try:
            yield pickle.load(spill)
        except EOFError:
            return


def _rows(entries: list[list], with_content: bool) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(entries), ROWS_OUT):
        part = entries[at : at + ROWS_OUT]
        columns = [
            pa.array([e[0] for e in part], pa.string()),
            pa.array([e[1] if with_content else None for e in part], pa.binary()),
            *(pa.array([e[i] for e in part], pa.int64()) for i in (2, 3, 4)),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["digest", "content", "first_id", "n_rows", "n_first"])


RECORDS = "digest string, content binary, first_id long, n_rows long, n_first long"


def _map_side(table_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ContentTable()
        for batch in batches:
            for doc_id, digest, content in zip(*(c.to_pylist() for c in batch.columns)):
                table.add((digest, content, doc_id, 1, 1))
                if table.content_bytes > table_bytes:
                    yield from _rows(table.entries, True)
                    table = ContentTable()
        yield from _rows(table.entries, True)

    return run


def _reduce_side(table_bytes: int):
    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[Record]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grace_tables(records(batches), table_bytes):
            by_digest: dict[str, int] = {}
            for entry in table.entries:
                by_digest[entry[0]] = by_digest.get(entry[0], 0) + 1
            alone = [e for e in table.entries if by_digest[e[0]] == 1]
            yield from _rows(alone, False)
            yield from _rows([e for e in table.entries if by_digest[e[0]] > 1], True)

    return run


def normalised(text_col: str = "text"):
    """The text as compared: null is empty, a run of ASCII white space is one space."""
    return F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), WHITE_RUN, " ")


def content_groups(hashed: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per distinct content of ``hashed(doc_id, digest, content)``.

    Columns: digest, content (null unless another content has the same digest), first_id (smallest
    non-null id, null if all are null), n_rows, n_first (rows that have the smallest id).
    """
    folded = hashed.select("doc_id", "digest", "content").mapInArrow(_map_side(table_bytes), RECORDS)
    return folded.repartition("digest").mapInArrow(_reduce_side(table_bytes), RECORDS)


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(text_col).alias("norm"))
    return slim.select("doc_id", F.sha2("norm", 256).alias("digest"), F.col("norm").cast("binary").alias("content"))


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row per row of ``docs``.

    Texts are equal if identical after :func:`normalised`; null counts as empty.  ``keep_id`` is the
    smallest id of the group (null ids are never smallest unless all are null); exactly one row of a
    group is kept, also where the smallest id is repeated or null.  Other columns of ``docs`` are not
    read.  An empty table gives no rows.
    """
    hashed = _hashed(docs, id_col, text_col)
    groups = cut_lineage(content_groups(hashed, table_bytes))
    n_shared, n_tied = groups.agg(
        F.count("content"), F.count_if((F.col("n_first") > 1) | F.col("first_id").isNull())
    ).first()

    rows = hashed if n_shared else hashed.drop("content")
    found = groups.withColumnRenamed("content", "same") if n_shared else groups.drop("content")
    joined = rows.join(found, "digest")
    if n_shared:
        joined = joined.where(F.col("same").isNull() | (F.col("same") == F.col("content")))
    columns = [
        "doc_id",
        F.col("first_id").alias("keep_id"),
        F.col("n_rows").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("first_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    ]
    plain = joined.select(*columns, "n_first", *(["same"] if n_shared else []))
    if not n_tied:
        return plain.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    return _one_of_tied(plain, n_shared > 0)


def _one_of_tied(rows: DataFrame, with_content: bool) -> DataFrame:
    """Keep one of the rows that repeat a group's smallest id; which one makes no difference.

    Every row gets a number and the smallest of a group's candidates stays: no group is gathered.
    """
    rows = cut_lineage(rows.withColumn("slot", F.monotonically_increasing_id()))
    first = rows.where("kept").groupBy(F.col("text_sha256").alias("of"), *(["same"] if with_content else []))
    first = first.agg(F.min("slot").alias("first_slot")).withColumnsRenamed({"same": "content"})
    on = F.col("text_sha256") == F.col("of")
    if with_content:
        on = on & F.col("same").eqNullSafe(F.col("content"))
    kept = F.col("kept") & (F.col("slot") == F.col("first_slot"))
    return rows.join(first, on, "left").select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def distinct_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES
) -> DataFrame:
    """One whole row of ``docs`` for each group of :func:`exact_duplicates`: one that has the smallest id."""
    groups = cut_lineage(content_groups(_hashed(docs, id_col, text_col), table_bytes))
    norm = normalised(text_col)
    content = None if groups.where("content IS NOT NULL").isEmpty() else norm.cast("binary")
    kept = groups.select("first_id", "digest", F.col("n_first").alias("n_rows"), "content")
    return rows_at(docs, kept, F.sha2(norm, 256), content, id_col)
