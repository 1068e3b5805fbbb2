import hashlib
import random
import re

from conftest import as_rows
from samples import make_docs, odd_rows  # noqa: F401
from demandloom.llm import exact_dedup, simhash
from demandloom.llm.components import connected_components
from demandloom.llm.exact_dedup import ContentTable, exact_duplicates, grace_tables
from pyspark.sql import functions as F


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def expected_groups(rows):
    groups = {}
    for r in rows:
        groups.setdefault(norm(r[1]), []).append(r[0])
    return groups


def test_every_row_gets_its_group(make_docs, odd_rows):
    found = exact_duplicates(make_docs(odd_rows)).collect()
    groups = expected_groups(odd_rows)
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    assert len(found) == len(odd_rows)
    for r in found:
        ids = by_digest[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids)
        assert r.keep_id == (min(known) if known else None)
    kept = [r.text_sha256 for r in found if r.kept]
    assert sorted(kept) == sorted(by_digest)


def test_empty_table(make_docs):
    assert exact_duplicates(make_docs([])).count() == 0


def test_tables_spill_until_each_fits():
    texts = [f"text {i % 300} ".encode() * 20 for i in range(1000)]
    records = [(hashlib.sha256(t).hexdigest(), t, i, 1, 1) for i, t in enumerate(texts)]
    tables = list(grace_tables(iter(records), table_bytes=4000))
    assert len(tables) > 16
    assert all(t.content_bytes <= 4000 or len(t.entries) == 1 for t in tables)
    entries = {e[1]: (e[2], e[3]) for t in tables for e in t.entries}
    assert entries == {t: (texts.index(t), texts.count(t)) for t in set(texts)}


def test_table_compares_contents_under_one_hash():
    table = ContentTable()
    for content, doc_id in ((b"a", 4), (b"b", 2), (b"a", 3), (b"a", 3)):
        table.add(("0" * 64, content, doc_id, 1, 1))
    assert sorted((e[1], e[2], e[3], e[4]) for e in table.entries) == [(b"a", 3, 3, 2), (b"b", 2, 1, 1)]


def test_shared_hashes_are_joined_by_content(spark, monkeypatch):
    rows = [(1, "x"), (2, "y"), (3, "x"), (4, "y"), (5, "z")]
    hashed = spark.createDataFrame(rows, "doc_id long, text string").select(
        "doc_id", F.lit("a" * 64).alias("digest"), F.col("text").cast("binary").alias("content")
    )
    groups = exact_dedup.content_groups(hashed)
    assert as_rows(groups, "first_id", "n_rows") == [(1, 2), (2, 2), (5, 1)]
    assert {bytes(r.content) for r in groups.collect()} == {b"x", b"y", b"z"}


def fingerprint(text, k=3):
    from xxhash import xxh64_intdigest

    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components_of_odd_rows_equal_brute_force(make_docs, odd_rows):
    found = simhash.near_duplicates(make_docs(odd_rows)).collect()
    assert len(found) == len(odd_rows)
    prints = {}
    for r in odd_rows:
        prints.setdefault(fingerprint(r[1]), []).append(r[0])
    root = {f: f for f in prints}
    for a in prints:
        for b in prints:
            if bin(a ^ b).count("1") <= 2:
                old, new = root[a], root[b]
                root = {f: new if x == old else x for f, x in root.items()}
    smallest = {}
    for f, ids in prints.items():
        known = [i for i in ids if i is not None]
        smallest.setdefault(root[f], []).extend(known)
    for r in found:
        f = r.fingerprint % (1 << 64)
        assert r.doc_id in prints[f]
        assert r.component_id == min(smallest[root[f]], default=None)


def test_spark_hash_is_the_contracts_hash(spark):
    from xxhash import xxh64_intdigest

    for text in ("", "a", "une été", "x" * 100):
        got = spark.range(1).select(F.xxhash64(F.lit(text))).first()[0]
        assert got % (1 << 64) == xxh64_intdigest(text.encode(), 42)


def test_links_are_complete_around_a_hot_block(spark):
    """Variants of one fingerprint share every coarse block; all close pairs are found, once."""
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    values = {centre}
    while len(values) < 400:
        values.add(centre ^ sum(1 << rng.randrange(64) for _ in range(rng.choice((1, 2, 3, 4)))))
    values |= {rng.getrandbits(64) for _ in range(100)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    prints = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    found = as_rows(simhash.fingerprint_links(prints, hot_key=8), "a", "b")
    close = lambda a, b: bin((a ^ b) % (1 << 64)).count("1") <= 2
    assert found == sorted((a, b) for a in signed for b in signed if a < b and close(a, b))


def test_components_of_chains_rings_and_loops(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(50, 51), (51, 52), (52, 50), (60, 60), (70, 71), (71, 70)]
    random.Random(1).shuffle(links)
    found = as_rows(connected_components(spark.createDataFrame(links, "a long, b long")), "node", "root")
    assert found == [(i, 1) for i in range(2, 41)] + [(51, 50), (52, 50), (71, 70)]
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
