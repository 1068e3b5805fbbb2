import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandloom.llm import hard_negatives as hn
from demandloom.llm.hard_negatives import hard_negatives

VECTORS = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.DoubleType())),
        T.StructField("label", T.IntegerType()),
        # names that clash with the operator's own
        *[T.StructField(n, T.StringType()) for n in ("row", "values", "norm", "angles", "block", "direction", "score", "rank")],
    ]
)


@pytest.fixture(scope="module")
def table(spark):
    return lambda rows: spark.createDataFrame([(*r, *["x"] * 8) for r in rows], VECTORS)


def expected(rows, every=100, positives=5, negatives=5):
    usable = [
        (i, label, [math.floor(256 * x) for x in v])
        for i, v, label in rows
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    score = lambda a, b: max(min(sum(x * y for x, y in zip(a[2], b[2])), 2**63 - 1), -(2**63))
    out = []
    for at, anchor in enumerate(usable):
        if anchor[0] % every:
            continue
        others = sorted((-score(anchor, r), r[0], r[1]) for k, r in enumerate(usable) if k != at)
        for p, pid, _ in [o for o in others if o[2] == anchor[1]][:positives]:
            found = [(n, nid) for n, nid, label in others if label != anchor[1] and 80 * -p <= 100 * -n <= 100 * -p]
            out += [(anchor[0], pid, k, nid, -p, -n) for k, (n, nid) in enumerate(found[:negatives], 1)]
    return sorted(out)


def result(df):
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r) for r in df.select(*names).collect())


def clustered(n, width=8, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width)) * 2
    return [(i, (centres[rng.integers(6)] + rng.normal(size=width) * 0.4).tolist(), int(rng.integers(4))) for i in range(n)]


@pytest.mark.parametrize("sizes", [(2048, 256), (40, 3)])
def test_equals_all_pairs(table, monkeypatch, sizes):
    monkeypatch.setattr(hn, "ROWS_PER_BLOCK", sizes[0])
    monkeypatch.setattr(hn, "ANCHORS_PER_BLOCK", sizes[1])
    rows = clustered(400)
    found = result(hard_negatives(table(rows), F.col("vec_id") % 20 == 0))
    assert found == expected(rows, 20)
    assert len(found) > 100


def test_odd_rows(table):
    nan, inf = float("nan"), float("inf")
    rows = clustered(60, 4)
    rows += [(100, [1.0, 2.0, 3.0, 4.0], 1), (100, [1.0, 2.0, 3.0, 4.0], 1), (200, [], 1), (300, [0.0] * 4, 2)]
    rows += [(400, None, 1), (500, [1.0, None, 2.0, 0.5], 1), (600, [nan, 1.0, 1.0, 1.0], 1), (700, [inf, 1.0, 1.0, 1.0], 1)]
    rows += [(800, [1.0, 1.0], 3), (900, [1.0] * 4, None), (None, [1.0] * 4, 1), (1000, [-0.001] * 4, 2)]
    rows += [(1100, [1e30, 1.0, 0.0, 0.0], 1), (1101, [1e30, 2.0, 0.0, 0.0], 1), (1102, [1e12, 2.0, 3.0, 4.0], 2)]
    rows += [(2000 + i, [2.0, 2.0, 2.0, 2.0], i % 2) for i in range(20)]
    assert result(hard_negatives(table(rows), F.col("vec_id") % 100 == 0)) == expected(rows)


def test_empty_tables(table):
    assert hard_negatives(table([]), F.col("vec_id") % 100 == 0).count() == 0
    assert hard_negatives(table([(1, [1.0], 1), (2, [1.0], 2)]), F.col("vec_id") % 100 == 0).count() == 0
    assert hard_negatives(table([(0, [1.0], 1)]), F.col("vec_id") % 100 == 0).count() == 0


def test_scores_lie_within_their_bounds():
    rng = np.random.default_rng(5)
    a, r = (np.floor(rng.normal(size=(n, 6)) * 300) for n in (20, 200))
    r[:20] = a * 3
    r[20:25] = 0
    directions = hn.spread_directions(r, 4)
    (a_norm, a_angle), (r_norm, r_angle) = (hn.angles(x, directions) for x in (a, r))
    scores = a @ r.T
    for near in ([0], [1, 2], [0, 1, 2, 3]):
        lower, upper = hn.score_bounds(a_norm, a_angle[:, near], r_norm, r_angle[:, near])
        assert (lower <= scores).all() and (scores <= upper).all()
    assert (upper - lower < a_norm[:, None] * r_norm * 2).any()


def test_windows_leave_pairs_unscored(table, monkeypatch):
    """In clustered data most pairs are ruled out by their angles."""
    scored = []
    exact = hn.integer_scores
    monkeypatch.setattr(hn, "integer_scores", lambda rows, anchor: scored.append(len(rows)) or exact(rows, anchor))
    rows = np.array([v for _, v, _ in clustered(300)])
    whole = np.floor(256 * rows)
    directions = hn.spread_directions(whole, 6)
    norms, angles = hn.angles(whole, directions)
    near = angles.argmin(axis=1)
    _, upper = hn.score_bounds(norms[:1], angles[:1], norms, angles)
    own = np.sort((whole @ whole[0])[near == near[0]])[-6]
    assert (upper[0] >= own).mean() < 0.6


def test_integer_scores_are_exact():
    rows = np.array([[2.0**40, 3.0], [1e30, -1e30], [5.0, 7.0], [0.0, 0.0]])
    anchor = np.array([2.0**20, 1.0])
    want = [2**60 + 3, 2**63 - 1, 5 * 2**20 + 7, 0]
    assert hn.integer_scores(rows, anchor).tolist() == want
    assert hn.integer_scores(rows[:0], anchor).tolist() == []


def test_leading_breaks_ties_by_id():
    scores, ids = np.array([5, 7, 7, 7, 1]), np.array([9, 8, 3, 5, 1])
    assert ids[hn.leading(scores, ids, 2)].tolist() == [3, 5]
    assert ids[hn.leading(scores, ids, 9)].tolist() == [3, 5, 8, 9, 1]
