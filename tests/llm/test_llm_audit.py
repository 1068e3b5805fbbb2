import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from samples import make_docs, odd_rows, prose  # noqa: F401

from demandloom.llm import divergence
from demandloom.llm.divergence import cell_partials, divergence_audit, terms_of

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def expected(rows, min_docs, top=10):
    """The contract, term by term."""
    rows = [((r[2] if len(r) > 2 else None) or "", (r[3] if len(r) > 3 else None) or "", words(r[1])) for r in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        in_docs = Counter(t for r in own for t in set(r[2]))
        kept = sorted(t for t, n in in_docs.items() if n >= min_docs)
        groups = {s: Counter() for s in {r[1] for r in own}}
        for _, source, terms in own:
            groups[source].update(t for t in terms if t in set(kept))
        whole = sum(groups.values(), Counter())

        def p(counts):
            total = sum(counts.values())
            return {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        f = lambda a, b: (a - b) * (a - b) // (a + b)
        shares, q = {s: p(c) for s, c in groups.items()}, p(whole)
        for source, mine in shares.items():
            pairs = [(sum(f(mine[t], other[t]) for t in kept), s) for s, other in shares.items() if s != source]
            terms = [(f(mine[t], q[t]), t) for t in kept if groups[source][t] and mine[t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, source, part, item, v, k) for k, (v, item) in enumerate(found[:most], 1)]
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("min_docs", [1, 2, 10])
def test_odd_rows(make_docs, odd_rows, min_docs):
    assert result(divergence_audit(make_docs(odd_rows), min_docs)) == expected(odd_rows, min_docs)


@pytest.mark.parametrize("blocks", [(1, 3), (2, 7), (16, 2048)])
def test_any_partitioning_of_the_cube(make_docs, blocks):
    rows = [(i, prose(5 + i % 40, i) + " Ünï É", "en" if i % 3 else "de", f"s{i % 7 if i % 2 else 0}") for i in range(300)]
    rows += [(900, "only one", "xx", "a"), (901, None, "yy", "a"), (902, "", "yy", "b"), (903, "1 2 3", "yy", "c")]
    found = divergence_audit(make_docs(rows), 10, groups_per_block=blocks[0], terms_per_block=blocks[1])
    assert result(found) == expected(rows, 10)


def test_ties_are_ordered_by_bytes(make_docs):
    rows = [(i, t, "en", s) for i, (t, s) in enumerate([("b é a z", "x"), ("c", "y"), ("c", "Z"), ("c", "é")] * 2)]
    found = result(divergence_audit(make_docs(rows), 1))
    assert found == expected(rows, 1)
    assert [r[3] for r in found if r[1] == "x" and r[2] == "term"] != []


def test_a_small_count_table_is_sent_on(make_docs, monkeypatch):
    rows = [(i, prose(30, i), "en", f"s{i % 3}") for i in range(60)]
    monkeypatch.setattr(divergence, "TABLE_ENTRIES", 20)
    assert result(divergence_audit(make_docs(rows), 5)) == expected(rows, 5)


def test_empty_table(make_docs):
    assert divergence_audit(make_docs([])).count() == 0


def test_terms():
    text = "Ab-cD_e9É漢 ÀA\x00z~"
    assert [t.decode() for t in terms_of(text)] == words(text) == ["ab", "cd", "e", "É漢", "Àa", "z"]
    assert terms_of(None) == []


def test_large_counts_stay_exact(spark):
    rows = [(0, 7, 1), (10**9, 10**9, 5), (123456789012, 3 * 10**17, 10**9), (10**18, 10**18, 3)]
    df = spark.createDataFrame(rows, "n long, total long, n_terms long")
    found = [r[0] for r in df.select(divergence._smoothed("n", "total", "n_terms")).collect()]
    assert found == [1 + 10**9 * (n + 2) // (t + 2 * v) for n, t, v in rows]


def test_cell_equals_a_loop():
    rng = np.random.default_rng(1)

    def side(names):
        out = []
        for name in names:
            at = np.sort(rng.choice(50, rng.integers(0, 20), replace=False)).astype(np.int64)
            out.append((name, int(rng.integers(1, 10**6)), at, rng.integers(1, 10**9 + 2, len(at))))
        return out

    def plain(a, b, n_terms):
        values = [dict(zip(r[2].tolist(), r[3].tolist())) for r in (a, b)]
        pairs = [(values[0].get(t, a[1]), values[1].get(t, b[1])) for t in range(n_terms)]
        return sum((p - q) * (p - q) // (p + q) for p, q in pairs)

    left, right = side("abc"), side("xy")
    assert list(cell_partials(left, right, 60, False)) == [(a[0], b[0], plain(a, b, 60)) for a in left for b in right]
    own = [(a[0], b[0], plain(a, b, 60)) for i, a in enumerate(left) for b in left[i + 1 :]]
    assert list(cell_partials(left, [], 60, True)) == own


def test_no_group_is_gathered(make_docs):
    """The counts are folded before every shuffle, and ranks keep only leading rows of a task."""
    rows = [(i, prose(20, i), "en", "hot" if i % 3 else "b") for i in range(60)]
    plan = divergence_audit(make_docs(rows).repartition(4), 2)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
    counts = divergence.term_counts(make_docs(rows).select("lang", "source", "text"))
    assert "partial_sum" in counts._jdf.queryExecution().toString()
    assert counts.agg(F.sum("n")).first()[0] == 60 * 20
