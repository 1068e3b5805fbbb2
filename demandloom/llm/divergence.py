"""Source divergence audit: how far the sources of a language are from each other and from their language.

Every (language, source) group is a smoothed distribution over the language's terms, in exact integers of a
billionth.  All pairs of groups are compared by three-dimensional cube partitioning: groups and terms
are dealt into blocks, a task owns one (group block, group block, term block) cell, receives the two slices
of the count matrix that it needs, and sums the divergence of its pairs over its terms; the partial sums are
then added along the term axis.  A slice is replicated once per group block, never once per group, and a
cell's memory is bounded by the block sizes whatever the data.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandloom.llm.batches import text_slices
from demandloom.plans.storage import cut_lineage

SCALE = 1_000_000_000
GROUPS_PER_BLOCK = 16
TERMS_PER_BLOCK = 2048
# entries of a task's count table before it is sent on
TABLE_ENTRIES = 400_000

# A-Z to a-z; every other ASCII character outside a-z separates terms
_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and non-ASCII characters, only A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, n_docs) of ``docs(lang, source, text)``: occurrences and rows with the term."""
    names = ["lang", "source", "term", "n", "n_docs"]

    def emit(groups: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, in_docs) in groups.items():
            terms, k = list(counts), len(counts)
            columns = [pa.array([lang] * k), pa.array([source] * k), pa.array(terms, pa.binary())]
            columns += [pa.array([c[t] for t in terms], pa.int64()) for c in (counts, in_docs)]
            yield pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict = {}
        for batch in batches:
            for part, texts in text_slices(batch, 2):
                for lang, source, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts):
                    if terms := terms_of(text):
                        counts, in_docs = groups.setdefault((lang, source), (Counter(), Counter()))
                        counts.update(terms)
                        in_docs.update(set(terms))
                if sum(len(c) for c, _ in groups.values()) > TABLE_ENTRIES:
                    yield from emit(groups)
                    groups = {}
        yield from emit(groups)

    found = docs.mapInArrow(run, "lang string, source string, term binary, n long, n_docs long")
    # UTF-8 as it came; summed map-side again, as a task may send a term several times
    return found.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(
        F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs")
    )


def _smoothed(n: Column | str, total: str, n_terms: str) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * n_terms)), exactly: products are decimals of 38 digits."""
    n = F.col(n) if isinstance(n, str) else n
    over = (F.col(total) + 2 * F.col(n_terms)).cast("decimal(20,0)")
    share = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)"), over)
    return (share + 1).cast("long")


def _distance(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)); the square stays below 2^63 as p and q are at most SCALE + 1."""
    gap = F.col(p) - F.col(q)
    return F.call_function("div", gap * gap, F.col(p) + F.col(q))


def cell_partials(left: list, right: list, n_terms: int, same: bool) -> Iterator[tuple[str, str, int]]:
    """(a, b, sum over the cell's terms) for all pairs of two lists of slices; once each if they are one block.

    A slice is (source, p of absent terms, positions, p of the terms there).
    """
    rows = left if same else left + right
    present = np.unique(np.concatenate([r[2] for r in rows])) if rows else np.empty(0, dtype=np.int64)
    dense = np.empty((len(rows), len(present)), dtype=np.int64)
    for i, (_, absent, positions, values) in enumerate(rows):
        dense[i] = absent
        dense[i, np.searchsorted(present, positions)] = values
    absent = np.array([r[1] for r in rows], dtype=np.int64)
    for i in range(len(left)):
        others = slice(i + 1, None) if same else slice(len(left), None)
        gap = dense[others] - dense[i]
        sums = (gap * gap // (dense[others] + dense[i])).sum(axis=1)
        gap = absent[others] - absent[i]
        sums = sums + (n_terms - len(present)) * (gap * gap // (absent[others] + absent[i]))
        for (name, *_), value in zip(rows[others], sums.tolist()):
            yield left[i][0], name, value


def _cell(table: pa.Table) -> pa.Table:
    sides: tuple[list, list] = ([], [])
    head = {c: table.column(c)[0].as_py() for c in ("lang", "block_a", "block_b", "block_terms")}
    for r in range(table.num_rows):
        positions, values = (table.column(c)[r].values for c in ("positions", "values"))
        slice_ = (
            table.column("source")[r].as_py(),
            table.column("absent_p")[r].as_py(),
            positions.to_numpy(zero_copy_only=False).astype(np.int64),
            values.to_numpy(zero_copy_only=False),
        )
        sides[table.column("own_block")[r].as_py() != head["block_a"]].append(slice_)
    # a pair is named the same way round in every term block
    for side in sides:
        side.sort(key=lambda s: s[0])
    same = head["block_a"] == head["block_b"]
    found = list(cell_partials(*sides, head["block_terms"], same))
    a, b, value = zip(*found) if found else ((), (), ())
    columns = {"lang": pa.array([head["lang"]] * len(found), pa.string()), "a": pa.array(a, pa.string())}
    return pa.table(columns | {"b": pa.array(b, pa.string()), "value": pa.array(value, pa.int64())})


def divergence_audit(
    docs: DataFrame,
    min_docs: int = 10,
    top_terms: int = 10,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    groups_per_block: int = GROUPS_PER_BLOCK,
    terms_per_block: int = TERMS_PER_BLOCK,
) -> DataFrame:
    """(lang, source, part, item, value, rank) of every (language, source) group that occurs.

    A language keeps the terms of at least ``min_docs`` of its rows.  Part ``pair`` has the divergence to each other
    source of the language (all of them, zero where the language keeps no term); part ``term`` the ``top_terms`` kept
    terms that the group uses more than its language does, by their share of the divergence from it.
    Ranks start at 1 by value, then by the item's UTF-8 bytes.

    Null texts, languages and sources count as empty strings, and empty strings are groups like others.  Repeated rows and ids
    count as often as they stand.  An empty table gives no rows; other columns are ignored.  Exact
    for up to 4 * 10^18 occurrences.
    """
    names = {"lang": lang_col, "source": source_col, "text": text_col}
    rows = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for n, c in names.items()])
    counts = cut_lineage(term_counts(rows))
    in_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("n_docs").alias("n_docs"))
    kept = in_lang.where(F.col("n_docs") >= min_docs).select("lang", "term", "lang_n")
    # the number of a term is unique and stays, as the table is materialised
    kept = cut_lineage(kept.withColumn("position", F.monotonically_increasing_id()))
    groups = cut_lineage(rows.select("lang", "source").distinct())
    langs = _languages(groups, kept, groups_per_block, terms_per_block)
    used = cut_lineage(counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]))
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    own_block = F.pmod(F.xxhash64("source"), F.col("n_group_blocks")).cast("int")
    # undefined without kept terms, and then no term asks for it
    absent = F.when(F.col("n_terms") > 0, _smoothed(F.lit(0), "total", "n_terms")).otherwise(1)
    sized = groups.join(totals, ["lang", "source"], "left").na.fill(0, ["total"]).join(langs, "lang")
    sized = cut_lineage(sized.withColumns({"own_block": own_block, "absent_p": absent}))
    shares = used.join(sized, ["lang", "source"]).withColumns(
        {
            "p": _smoothed("n", "total", "n_terms"),
            "q": _smoothed("lang_n", "lang_total", "n_terms"),
            "block": _term_block(),
        }
    )
    sizes = kept.join(langs, "lang").groupBy("lang", _term_block().alias("block"))
    cells = _cells(sized, shares, sizes.agg(F.count("*").cast("int").alias("block_terms")))
    pairs = _pair_part(cells)
    terms = _ranked(
        shares.where("p > q").select("lang", "source", F.col("term").alias("item"), _distance("p", "q").alias("value"))
    ).where(F.col("rank") <= top_terms)
    return pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term"))).select(
        "lang", "source", "part", "item", "value", "rank"
    )


def _languages(groups: DataFrame, kept: DataFrame, groups_per_block: int, terms_per_block: int) -> DataFrame:
    """One row per language: its kept terms, their occurrences, and the numbers of blocks (one at least)."""
    terms = kept.groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum("lang_n").alias("lang_total"))
    langs = groups.groupBy("lang").agg(F.count("*").alias("n_groups")).join(terms, "lang", "left")
    langs = langs.na.fill(0, ["n_terms", "lang_total"])
    n_blocks = F.greatest(F.lit(1), F.ceil(F.col("n_terms") / terms_per_block)).cast("int")
    n_group_blocks = F.ceil(F.col("n_groups") / groups_per_block).cast("int")
    return cut_lineage(langs.withColumns({"n_blocks": n_blocks, "n_group_blocks": n_group_blocks}))


def _term_block() -> Column:
    return F.pmod(F.xxhash64("term"), F.col("n_blocks")).cast("int")


def _ranked(found: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return found.withColumn("rank", F.row_number().over(order))


def _cells(sized: DataFrame, shares: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, a, b, value): partial divergences of every cell, each pair once per term block."""
    entry = F.struct("position", "p")
    packed = shares.groupBy("lang", "source", "block").agg(F.collect_list(entry).alias("entries"))
    each = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block")
    slices = (
        sized.select("lang", "source", "own_block", "absent_p", "n_group_blocks", each)
        .join(packed, ["lang", "source", "block"], "left")
        .join(sizes, ["lang", "block"], "left")
        .na.fill(0, ["block_terms"])
    )
    none = F.array().cast("array<bigint>")
    other = F.explode(F.sequence(F.lit(0), F.col("n_group_blocks") - 1)).alias("other")
    dealt = slices.select("*", other).select(
        "lang",
        "block",
        "source",
        "own_block",
        "absent_p",
        "block_terms",
        F.least("own_block", "other").alias("block_a"),
        F.greatest("own_block", "other").alias("block_b"),
        F.coalesce("entries.position", none).alias("positions"),
        F.coalesce("entries.p", none).alias("values"),
    )
    cells = dealt.groupBy("lang", "block", "block_a", "block_b")
    return cells.applyInArrow(_cell, "lang string, a string, b string, value long")


def _pair_part(partials: DataFrame) -> DataFrame:
    """Sums along the term axis, both ways round, ranked within each group."""
    sums = partials.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
        F.struct(F.col("b").alias("source"), F.col("a").alias("item")),
    )
    return _ranked(sums.select("lang", F.explode(ways).alias("way"), "value").select("lang", "way.*", "value"))
