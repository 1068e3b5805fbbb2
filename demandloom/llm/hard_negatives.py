"""Hard negatives by angular triangle filtering: exact windows of integer scores without scoring every pair.

A few reference directions are fixed from a bounded sample.  Every row stores its angle to each of
them.  For a row at angle t and an anchor at angle u to the same direction, the angle between the two lies between
|t - u| and t + u, so their cosine lies between cos(t + u) and cos(t - u); times both norms, widened by more than floating
arithmetic can be off, this bounds their score.  Only pairs whose bounds reach into a wanted score window are scored, in
exact integers.

Rows are packed into blocks of rows near one direction, anchors likewise.  Pairs of blocks whose angle ranges
already rule every window out are never brought together; in the others the two directions of the blocks bound each pair.
Work is dealt by pairs of blocks, so neither anchors nor rows are ever gathered in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandloom.plans.storage import cut_lineage

DIRECTIONS = 16
# rows from which the directions are chosen
SAMPLE_ROWS = 1024
ROWS_PER_BLOCK = 2048
ANCHORS_PER_BLOCK = 256
# angles near zero are off by the root of a rounding error; bounds are widened by this share of the norms
SLACK = 1e-6
LONG = (-(1 << 63), (1 << 63) - 1)

_BLOCK = "block int, direction int, low array<double>, high array<double>, top_norm double, least double, rows binary"


def integer_vector(values: list[float]) -> np.ndarray:
    """floor(256 * x) of every component, as the doubles that these integers are."""
    return np.floor(256.0 * np.asarray(values, dtype=np.float64))


def integer_scores(rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Exact inner products, held at the ends of a long where they are beyond it.

    Products and partial sums below 2^53 are exact in doubles; larger vectors are multiplied as unbounded integers.
    """
    if (np.abs(rows).sum(axis=1, initial=0).max(initial=0) * np.abs(anchor).max(initial=0)) < 2**53:
        return (rows @ anchor).astype(np.int64)
    whole = [int(a) for a in anchor]
    exact = (sum(int(x) * a for x, a in zip(row, whole)) for row in rows)
    return np.array([min(max(s, LONG[0]), LONG[1]) for s in exact], dtype=np.int64)


def spread_directions(sample: np.ndarray, count: int) -> np.ndarray:
    """Unit vectors chosen one after the other, each the farthest by angle from those before."""
    norms = np.linalg.norm(sample, axis=1)
    units = sample[norms > 0] / norms[norms > 0, None]
    chosen = units[:1]
    nearest = units @ chosen[0] if len(units) else units
    while len(chosen) and len(chosen) < count:
        far = int(np.argmin(nearest))
        if nearest[far] > 1 - 1e-9:
            break
        chosen = np.vstack([chosen, units[far]])
        nearest = np.maximum(nearest, units @ units[far])
    return chosen


def angles(rows: np.ndarray, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(norm, angle to every direction); a zero vector is at right angles to all."""
    # scaled first, as squares of large components would leave the doubles
    scale = np.maximum(np.abs(rows).max(axis=1, initial=0), 1.0)
    norms = np.linalg.norm(rows / scale[:, None], axis=1) * scale
    units = rows / np.maximum(norms, 1.0)[:, None]
    cosines = np.where(norms[:, None] > 0, units @ directions.T, 0.0)
    return norms, np.arccos(np.clip(cosines, -1, 1))


def score_bounds(a_norm, a_angle, r_norm, r_angle) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) for the score of every anchor with every row, over the directions of their columns."""
    lower = upper = None
    for j in range(a_angle.shape[1]):
        even = np.outer(np.cos(a_angle[:, j]), np.cos(r_angle[:, j]))
        odd = np.outer(np.sin(a_angle[:, j]), np.sin(r_angle[:, j]))
        lower = even - odd if lower is None else np.maximum(lower, even - odd)
        upper = even + odd if upper is None else np.minimum(upper, even + odd)
    sizes = np.outer(a_norm, r_norm)
    return (lower - SLACK) * sizes, (upper + SLACK) * sizes


def _usable(df: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(row, vec_id, label, values): rows that take part, numbered."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    finite = F.forall("values", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"),
        F.col(f"`{label_col}`").cast("long").alias("label"),
        vector.alias("values"),
    ).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("values").isNotNull() & finite)
    return rows.withColumn("row", F.monotonically_increasing_id())


def _directions(rows: DataFrame, width: int) -> np.ndarray:
    """From the ``SAMPLE_ROWS`` rows that come first by a hash of the id and the vector."""
    found = rows.select("values").orderBy(F.xxhash64("vec_id", "values"), "vec_id", "label").limit(SAMPLE_ROWS).collect()
    sample = np.zeros((len(found), width))
    for i, r in enumerate(found):
        sample[i, : len(r["values"])] = integer_vector(r["values"])
    chosen = spread_directions(sample / max(1.0, np.abs(sample).max(initial=0)), DIRECTIONS)
    return chosen if len(chosen) else np.eye(1, width)


def _indexed(rows: DataFrame, directions: np.ndarray) -> DataFrame:
    """Rows with integer components, norm, stored angles and their nearest direction."""
    width = directions.shape[1]
    names = ["row", "vec_id", "label", "whole", "norm", "angles", "direction"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            dense = np.zeros((batch.num_rows, width))
            for i in range(batch.num_rows):
                own = integer_vector(lists[i].values.to_numpy())
                dense[i, : len(own)] = own
            norms, found = angles(dense, directions)
            made = [
                pa.array([d.tobytes() for d in dense], pa.binary()),
                pa.array(norms),
                pa.array([f.tobytes() for f in found], pa.binary()),
                pa.array(found.argmin(axis=1).astype(np.int32)),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], names)

    schema = "row long, vec_id long, label long, whole binary, norm double, angles binary, direction int"
    return rows.select("row", "vec_id", "label", "values").mapInArrow(run, schema)


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of about ``size`` rows near one direction with their angle ranges, largest norm and least wanted score.

    The number of blocks of a direction comes from its count, so a crowded direction has more blocks, not larger ones.
    """
    # at most one count per direction
    counts = {r["direction"]: r["n"] for r in rows.groupBy("direction").agg(F.count("*").alias("n")).collect()}
    block, first = F.lit(None).cast("int"), 0
    for direction, n in sorted(counts.items()):
        dealt = F.pmod(F.xxhash64("row"), F.lit(-(-n // size))) + first
        block = F.when(F.col("direction") == direction, dealt.cast("int")).otherwise(block)
        first += -(-n // size)

    def pack(table: pa.Table) -> pa.Table:
        found = _matrix(table, "angles")
        wanted = table.column("lowest").to_pylist() if "lowest" in table.column_names else [None]
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table.combine_chunks())
        return pa.table(
            {
                "block": table.column("block")[:1],
                "direction": table.column("direction")[:1],
                "low": pa.array([found.min(axis=0)]),
                "high": pa.array([found.max(axis=0)]),
                "top_norm": pa.array([max(table.column("norm").to_pylist())]),
                "least": pa.array([None if None in wanted else float(min(wanted))], pa.float64()),
                "rows": pa.array([sink.getvalue().to_pybytes()], pa.binary()),
            }
        )

    return cut_lineage(rows.withColumn("block", block).groupBy("block").applyInArrow(pack, _BLOCK))


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    return np.vstack([np.frombuffer(b.as_py()) for b in table.column(column)])


def _cells(rows: DataFrame, anchors: DataFrame, wanted: Column) -> DataFrame:
    """Pairs of blocks whose scores can reach the least one that any of the anchors wants."""
    side = ("block", "direction", "low", "high", "top_norm")
    left = anchors.select(*[F.col(c).alias(f"a_{c}") for c in side], "least")
    right = rows.select(*[F.col(c).alias(f"r_{c}") for c in side])
    # the gap between two ranges of angles is the least angle between their vectors, by every direction
    below = F.zip_with("a_low", "r_high", lambda a, r: a - r)
    above = F.zip_with("r_low", "a_high", lambda r, a: r - a)
    apart = F.greatest(F.array_max(below), F.array_max(above), F.lit(0.0))
    best = F.greatest(F.cos(apart) + SLACK, F.lit(0.0)) * F.col("a_top_norm") * F.col("r_top_norm")
    # the stated anchors against all rows, one row per block on either side and no vectors yet
    return left.join(right, wanted & (F.col("least").isNull() | (best >= F.col("least")))).select("a_block", "r_block")


def _scored(rows: DataFrame, anchors: DataFrame, wanted: Column, same_label: bool, pick: Callable, schema: str) -> DataFrame:
    """What ``pick`` makes of every anchor and its candidates in every cell.

    Candidates have an equal (or another) label, are not the anchor's row, and may lie between its ``lowest`` and ``highest``.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [field.split()[0] for field in schema.split(", ")]
        for batch in batches:
            for i in range(batch.num_rows):
                a, r = (pa.ipc.open_stream(batch.column(c)[i].as_py()).read_all() for c in (0, 1))
                made = [found for found in _cell(a, r, same_label, pick)]
                columns = zip(*(row for rows_of in made for row in rows_of)) if any(made) else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    cells = _cells(rows, anchors, wanted)
    pairs = (
        cells.join(anchors.select(F.col("block").alias("a_block"), F.col("rows").alias("a_rows")), "a_block")
        .join(rows.select(F.col("block").alias("r_block"), F.col("rows").alias("r_rows")), "r_block")
        .select("a_rows", "r_rows")
    )
    return pairs.mapInArrow(score, schema)


def _cell(a: pa.Table, r: pa.Table, same_label: bool, pick: Callable) -> Iterator[list[tuple]]:
    a_angles, r_angles = _matrix(a, "angles"), _matrix(r, "angles")
    near = sorted({a.column("direction")[0].as_py(), r.column("direction")[0].as_py()})
    a_whole, r_whole = _matrix(a, "whole"), _matrix(r, "whole")
    norms = [t.column("norm").to_numpy() for t in (a, r)]
    lower, upper = score_bounds(norms[0], a_angles[:, near], norms[1], r_angles[:, near])
    ids, numbers, labels = (r.column(c).to_numpy() for c in ("vec_id", "row", "label"))
    for i, anchor in enumerate(a.to_pylist()):
        able = ((labels == anchor["label"]) == same_label) & (numbers != anchor["row"])
        if (lowest := anchor.get("lowest")) is not None:
            able &= upper[i] >= lowest
        # scores held at the end of a long may lie anywhere above it
        if (highest := anchor.get("highest")) is not None and highest < float(LONG[1]):
            able &= lower[i] <= highest
        at = np.flatnonzero(able)
        if len(at):
            scores = integer_scores(r_whole[at], a_whole[i])
            yield pick(anchor, ids[at], scores)


def leading(scores: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
    """Positions of the first ``count`` by score descending, then id."""
    at = np.arange(len(scores))
    if len(scores) > count:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - count)[len(scores) - count])
    return at[np.lexsort((ids[at], -scores[at]))][:count]


def _first(found: DataFrame, count: int, *keys: str) -> DataFrame:
    """The first ``count`` of each key; only leading rows of a task are shuffled."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 5,
    percent: tuple[int, int] = (80, 100),
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on ``vec_id``.  Scores are inner products of floor(256 * component).  An anchor's positives are
    the first ``positives`` other rows of its label, by score descending, then id; for each of them the first ``negatives`` rows of
    another label with low * positive <= 100 * negative <= high * positive follow, ranked from 1; ``percent`` is (low, high).

    Rows with a null id, label or vector or with a null or non-finite component take no part.  Every row stands for itself:
    an id that repeats is another row, also of an anchor, and equal rows count as often as they stand.  Missing components of
    shorter vectors are zeros, so empty and zero vectors score zero.  Scores beyond a long are held at its ends.  A positive
    below zero has no negatives.  An empty table or one without anchors gives no rows; other columns are ignored.
    """
    low, high = percent
    usable = cut_lineage(_usable(vectors, id_col, label_col, vector_col))
    width = usable.agg(F.max(F.size("values"))).first()[0] or 1
    rows = cut_lineage(_indexed(usable, _directions(usable, width)))
    anchors = rows.where(is_anchor)
    blocks = _packed(rows, ROWS_PER_BLOCK)

    def nearest(anchor: dict, ids: np.ndarray, scores: np.ndarray) -> list[tuple]:
        return [(anchor["row"], anchor["vec_id"], int(ids[k]), int(scores[k])) for k in leading(scores, ids, positives)]

    # rows near an anchor's own direction give a floor for its positives elsewhere
    schema = "row long, anchor_id long, vec_id long, score long"
    home = F.col("a_direction") == F.col("r_direction")
    known = cut_lineage(_first(_scored(blocks, _packed(anchors, ANCHORS_PER_BLOCK), home, True, nearest, schema), positives, "row"))
    floors = known.where(F.col("rank") == positives).select("row", F.col("score").cast("double").alias("lowest"))
    asking = _packed(anchors.join(floors, "row", "left"), ANCHORS_PER_BLOCK)
    elsewhere = _scored(blocks, asking, ~home, True, nearest, schema)
    best = cut_lineage(_first(known.drop("rank").unionByName(elsewhere), positives, "row"))

    # at most ``positives`` of each anchor; a window below zero is empty
    windows = best.where("score >= 0").groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("positives"),
        (F.min("score") * (low / 100.0)).alias("lowest"),
        (F.max("score") * (high / 100.0)).alias("highest"),
    )

    def in_windows(anchor: dict, ids: np.ndarray, scores: np.ndarray) -> list[tuple]:
        found = []
        for p in anchor["positives"]:
            least, most = -(-low * p["score"] // 100), high * p["score"] // 100
            own = np.flatnonzero((scores >= least) & (scores <= most))
            head = (anchor["row"], anchor["vec_id"], p["rank"], p["vec_id"], p["score"])
            found += [(*head, int(ids[own][k]), int(scores[own][k])) for k in leading(scores[own], ids[own], negatives)]
        return found

    schema = "row long, anchor_id long, place long, positive_id long, positive_score long, vec_id long, score long"
    asking = _packed(anchors.join(windows, "row"), ANCHORS_PER_BLOCK)
    found = _first(_scored(blocks, asking, F.lit(True), False, in_windows, schema), negatives, "row", "place")
    return found.select(
        "anchor_id",
        "positive_id",
        "rank",
        F.col("vec_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )

