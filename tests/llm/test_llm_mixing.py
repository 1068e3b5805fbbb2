import pytest
from conftest import as_rows
from samples import make_docs, odd_rows  # noqa: F401
from demandloom.llm import mixing
from pyspark.sql import functions as F


def test_targets_share_the_excess_by_weight():
    assert mixing.capped_targets([10, 100, 100], [1, 2, 3], 210, 3) == pytest.approx([30, 72, 108])
    assert mixing.capped_targets([0, 5], [1, 1], 5, 3) == pytest.approx([0, 5])
    assert mixing.capped_targets([], [], 0, 3) == []


def test_flow_meets_quotas_with_the_least_repetition():
    quota = {"a": mixing.Quota(150, 150.0), "b": mixing.Quota(150, 150.0)}
    patterns = {("a",): 50, ("a", "b"): 100, ("b",): 50}
    taken = mixing.route(patterns, quota, 3)
    assert sum(taken.values()) == 300
    # the second pass over everything is needed once: 200 words cost nothing, 100 cost one each
    assert all(taken[k] <= 2 * patterns[k] for k in patterns)
    only = mixing.route({("a",): 100, ("a", "b"): 100}, {"a": mixing.Quota(200, 80.0), "b": mixing.Quota(100, 100.0)}, 3)
    # b can only be met from the shared documents, so a leaves them alone
    assert only == {("a",): 80, ("a", "b"): 100}


def corpus(n):
    return [(i, " ".join(["w"] * (1 + i * 37 % 90)), None, ["a", "b", "c", None][i % 4]) for i in range(n)]


def test_sources_come_near_their_targets(make_docs):
    docs = make_docs(corpus(6000))
    rows, plan = mixing.mix(docs, F.array("source"))
    taken = mixing.mixed_sizes(rows, plan)
    found = {tuple(r.pattern)[0]: r for r in taken.groupBy("pattern").agg(F.sum("taken").alias("t"), F.max("repeats").alias("most")).collect()}
    total = sum(q.size for q in plan.quotas.values())
    assert sum(q.target for q in plan.quotas.values()) == pytest.approx(total)
    assert list(plan.quotas) == ["a", "b", "c", None]
    for name, q in plan.quotas.items():
        assert abs(found[name].t - q.target) <= 2
        assert found[name].most <= 3
    again = mixing.mixed_sizes(*mixing.mix(docs.repartition(7), F.array("source")))
    assert as_rows(again, "doc_id", "taken") == as_rows(taken, "doc_id", "taken")


def test_mixed_documents_repeat_as_planned(make_docs):
    docs = make_docs(corpus(400))
    rows, plan = mixing.mix(docs, F.array("source"))
    want = {(r.doc_id, r.repeats) for r in mixing.mixed_sizes(rows, plan).collect() if r.repeats}
    mixed = mixing.mixed_documents(docs, F.array("source"), plan)
    assert mixed.columns == docs.columns
    assert {(r.doc_id, r["count"]) for r in mixed.groupBy("doc_id").count().collect()} == want


def test_overlapping_sources_and_odd_rows(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    both = F.when(F.col("doc_id") == 6, F.array(F.lit("a"), F.lit("b"), F.lit("a"))).otherwise(F.array("source"))
    rows, plan = mixing.mix(docs, both)
    taken = mixing.mixed_sizes(rows, plan).collect()
    assert len(taken) == len(odd_rows)
    assert {tuple(r.pattern) for r in taken} == {("a",), ("b",), (None,), ("a", "b")}
    assert all(0 <= r.taken <= 3 * r["size"] for r in taken)
    assert {r["size"] for r in taken if r.doc_id in (3, 4, 5)} == {0}
    assert {r["size"] for r in taken if r.doc_id == 6} == {20_000}


def test_no_documents(make_docs):
    rows, plan = mixing.mix(make_docs([]), F.array("source"))
    assert plan.quotas == {} and mixing.mixed_sizes(rows, plan).count() == 0


def test_too_many_patterns_are_an_error(make_docs):
    rows = mixing.sized(make_docs(corpus(8)), F.array("source"), 1)
    with pytest.raises(ValueError, match="patterns"):
        mixing.plan_mix(rows, max_patterns=3)


def test_no_untaken_document_fits_what_is_missing(make_docs):
    """Sources with one document of half their words, and repeated rows; also as documents."""
    rows = []
    for n in range(8):
        sizes = [1500] + [20 + (i * 37 + n) % 40 for i in range(40)]
        rows += [(100 * n + i, " ".join(["w"] * size) + f"\n{i}", None, f"s{n}") for i, size in enumerate(sizes)]
        rows += [rows[-1], rows[-1], rows[-2]]
    docs = make_docs(rows)
    sized, plan = mixing.mix(docs, F.array("source"))
    taken = mixing.mixed_sizes(sized, plan).collect()
    copies = {}
    for r in taken:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + r["size"]
    for (name,), q in ((("s%d" % n,), plan.quotas["s%d" % n]) for n in range(8)):
        own = [r for r in taken if tuple(r.pattern) == (name,)]
        passes = min(r.repeats for r in own)
        missing = round(q.target) - sum(r.taken for r in own)
        assert missing >= 0
        assert all(copies[r.doc_id] > missing for r in own if r.repeats == passes and r.repeats < 3)
    want = {r.doc_id: sum(x.repeats for x in taken if x.doc_id == r.doc_id) for r in taken if r.repeats}
    found = mixing.mixed_documents(docs, F.array("source"), plan).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in found} == want


def test_sources_of_their_own_need_no_flow():
    patterns = {(f"s{i:04d}",): 1 + i % 50 for i in range(300)}
    names = [k[0] for k in patterns]
    targets = mixing.capped_targets(list(patterns.values()), [1 + i % 3 for i in range(300)], sum(patterns.values()), 3)
    quotas = {n: mixing.Quota(s, t) for n, s, t in zip(names, patterns.values(), targets)}
    assert mixing.route(patterns, quotas, 3) == mixing._flow(patterns, quotas, 3)
    mixed = patterns | {("s0001", "s0002"): 40}
    assert mixing.route(mixed, quotas, 3) == mixing._flow(mixed, quotas, 3)


def test_thousands_of_sources(make_docs, monkeypatch):
    docs = make_docs([(i, " ".join(["w"] * (1 + i % 7)), None, f"s{i % 5000:04d}") for i in range(10_000)])
    rows, plan = mixing.mix(docs, F.array("source"))
    assert len(plan.quotas) == 5000
    taken = mixing.mixed_sizes(rows, plan).agg(F.sum("taken"), F.max("repeats")).first()
    assert taken[0] > 0 and taken[1] <= 3
    monkeypatch.setattr(mixing, "MAX_OVERLAPS", 1)
    both = make_docs([(1, "a", None, "x"), (2, "b", None, "y"), (3, "c", None, "z")])
    overlapping = F.when(F.col("source") == "x", F.array(F.lit("x"))).otherwise(F.array(F.lit("x"), F.col("source")))
    with pytest.raises(ValueError, match="overlapping"):
        mixing.mix(both, overlapping)
