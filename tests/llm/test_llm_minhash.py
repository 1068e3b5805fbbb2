import re

import numpy as np
import pytest
from samples import make_docs, odd_rows, prose  # noqa: F401

from demandloom.llm import minhash
from demandloom.llm.minhash import band_keys, near_duplicates, shingle_hashes, shingle_set, sketch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < size:
        return frozenset([" ".join(words)] if words else [])
    return frozenset(" ".join(words[i : i + size]) for i in range(len(words) - size + 1))


def expected(rows, size=5, percent=80):
    sets = [shingles(r[1], size) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    ids = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[find(i)] = min(r[0], ids.get(find(i), r[0]))
    found = [(r[0], len(sets[i]), ids.get(find(i)), r[0] == ids.get(find(i))) for i, r in enumerate(rows)]
    return sorted(found, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def edited(words, at):
    return " ".join("x" + w if i in at else w for i, w in enumerate(words))


def near_copies(n, length=60, edits=2, seed=3):
    rng = np.random.default_rng(seed)
    base = prose(length, 77).split()
    return [edited(base, set(rng.choice(length, rng.integers(0, edits + 1), replace=False).tolist())) for _ in range(n)]


@pytest.mark.parametrize("size", [1, 2, 5])
def test_odd_rows(make_docs, odd_rows, size):
    assert result(near_duplicates(make_docs(odd_rows), size)) == expected(odd_rows, size)


def test_mixed_corpus_equals_all_pairs(make_docs):
    rows = [(i, prose(10 + i % 50, i // 2) + (" tail" if i % 2 else ""), "en", "a") for i in range(300)]
    rows += [(1000 + i, t, "en", "a") for i, t in enumerate(near_copies(60, edits=9))]
    rows += [(2000 + i, "  " + t.upper(), "en", "a") for i, t in enumerate(near_copies(60, edits=9))]
    for size in (2, 5):
        assert result(near_duplicates(make_docs(rows), size)) == expected(rows, size)


def test_a_hot_bucket_is_not_expanded_into_pairs(make_docs, monkeypatch):
    texts = near_copies(500, length=120, edits=3)
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)] + [(5000 + i, prose(150, i), "en", "a") for i in range(30)]
    tested = []
    verified = minhash._verified
    monkeypatch.setattr(minhash, "_verified", lambda pairs, *a: tested.append(pairs.count()) or verified(pairs, *a))
    found = result(near_duplicates(make_docs(rows), 2))
    distinct = len(set(texts))
    assert distinct > 300
    assert sum(tested) < 40 * distinct < distinct * (distinct - 1) / 4
    assert all(r[2] == 0 for r in found if r[0] < 5000)
    assert all(r[3] for r in found if r[0] >= 5000)


def test_hot_buckets_without_a_common_hub(make_docs, monkeypatch):
    """Copies too different from any hub: further hubs and the pairs left across components find the links."""
    rows = [(i, t, "en", "a") for i, t in enumerate(near_copies(150, length=40, edits=8))]
    for hot, crowded in ((4, 10**6), (4, 0.1), (1000, 1000)):
        monkeypatch.setattr(minhash, "HOT_BUCKET", hot)
        monkeypatch.setattr(minhash, "CROWDED", crowded)
        assert result(near_duplicates(make_docs(rows), 2)) == expected(rows, 2)


def test_similar_sets_share_a_rare_shingle_within_their_bounds():
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 50, 64)
    for _ in range(300):
        both = rng.integers(0, 2**63, rng.integers(20, 60)).astype(np.uint64)
        a, b = (np.concatenate([both, rng.integers(0, 2**63, rng.integers(0, 8)).astype(np.uint64)]) for _ in range(2))
        whole = len(np.intersect1d(a, b))
        if 100 * whole < 80 * len(np.union1d(a, b)):
            continue
        first, second = (minhash.rare_prefix(x, counts, 80).tolist() for x in (a, b))
        common = [k for k in first if k in set(second)]
        assert common
        i, j = first.index(common[0]) + 1, second.index(common[0]) + 1
        assert 180 * (1 + min(len(a) - i, len(b) - j)) >= 80 * (len(a) + len(b))


def test_parities_differ_in_no_more_bins_than_sets_in_shingles():
    rng = np.random.default_rng(6)
    bits = lambda x: np.unpackbits(minhash.parities(x).view(np.uint8))
    for _ in range(200):
        both = rng.integers(0, 2**64, rng.integers(1, 900), dtype=np.uint64)
        a, b = (np.concatenate([both, rng.integers(0, 2**64, rng.integers(0, 90), dtype=np.uint64)]) for _ in range(2))
        apart = int((bits(a) != bits(b)).sum())
        assert apart <= len(np.setxor1d(a, b))
        assert apart >= len(np.setxor1d(a, b)) / 2


def test_near_copies_just_too_far_apart_are_told_by_their_parities(make_docs, monkeypatch):
    rng = np.random.default_rng(8)
    base = prose(120, 55).split()

    def own(i):
        at = set(rng.choice(120, 6, replace=False).tolist())
        return " ".join(f"{i}x{w}" if p in at else w for p, w in enumerate(base))

    rows = [(i, own(i), "en", "a") for i in range(200)]
    tested = []
    verified = minhash._verified
    # every bucket of pairs is keyed again
    monkeypatch.setattr(minhash, "HOT_BUCKET", 1)
    monkeypatch.setattr(minhash, "_verified", lambda pairs, *a: tested.append(pairs.count()) or verified(pairs, *a))
    assert result(near_duplicates(make_docs(rows), 2)) == expected(rows, 2)
    # 19,900 pairs; the first ones are those with hubs, the rest were met in large buckets
    assert len(tested) >= 2 and sum(tested[1:]) < len(rows)


def test_texts_that_share_a_passage_test_no_pairs(make_docs, monkeypatch):
    """A passage in many texts fills large buckets; the texts' own shingles tell that none can be similar."""
    passage = prose(60, 99)
    rows = [(i, f"{prose(40, 1000 + i)} {passage}", "en", "a") for i in range(200)]
    tested = []
    verified = minhash._verified
    monkeypatch.setattr(minhash, "_verified", lambda pairs, *a: tested.append(pairs.count()) or verified(pairs, *a))
    assert all(r[3] for r in result(near_duplicates(make_docs(rows), 2)))
    assert sum(tested) < 20 * len(rows)


def test_links_reach_along_a_chain(make_docs):
    words = prose(100, 9).split()
    rows = [(50 - k, edited(words, set(range(0, 3 * k, 3))), "en", "a") for k in range(12)]
    found = result(near_duplicates(make_docs(rows), 1))
    assert found == expected(rows, 1)
    assert {r[2] for r in found} == {39}


def test_stars_and_hubs_are_one_component(spark):
    rng = np.random.default_rng(7)
    pairs = {(int(max(p)), int(min(p))) for p in rng.integers(0, 60, (45, 2)) if p[0] != p[1]}
    pairs |= {(200 + i, 100 + i % 3) for i in range(40)} | {(150, 100), (150, 101), (102, 150)}
    pairs = {(max(p), min(p)) for p in pairs}
    root = {n: n for p in pairs for n in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    links = spark.createDataFrame(sorted(pairs), "a long, b long")
    found = {r.node: r.root for r in minhash._star_roots(links).collect()}
    assert {n: found.get(n, n) for n in root} == root


def test_empty_table(make_docs):
    assert near_duplicates(make_docs([])).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 100, 3000])
def test_every_bin_is_filled(n):
    hashes = shingle_hashes({f"shingle {i}".encode() for i in range(n)})
    bins = sketch(hashes)
    assert (bins >> np.uint64(57) == np.arange(128)).all()
    rounds = bins >> np.uint64(49) & np.uint64(255)
    assert rounds.max() < 256
    # the last resort is only asked where the first rounds left a bin empty
    assert (rounds[rounds >= 128] == np.flatnonzero(rounds >= 128) + 128).all()
    assert (bins == sketch(hashes[::-1].copy())).all()
    assert len(set(band_keys(bins).tolist())) == 32


def test_equal_bins_concentrate_around_the_similarity():
    off = []
    for seed in range(40):
        a = {f"{seed} {i}".encode() for i in range(300)}
        b = {f"{seed} {i}".encode() for i in range(60, 360)}
        same = sketch(shingle_hashes(a)) == sketch(shingle_hashes(b))
        off.append(same.mean() - len(a & b) / len(a | b))
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.06


def test_shingles():
    assert shingle_set([], 2) == set()
    assert shingle_set([b"a"], 2) == {b"a"}
    assert shingle_set([b"a", b"b", b"a", b"b"], 2) == {b"a b", b"b a"}
    with pytest.raises(ValueError):
        sketch(np.empty(0, dtype=np.uint64))
