"""MinHash near-duplicates: fast similarity sketches, banding, exact verification, components.

A set of word shingles is sketched by fast similarity sketching.  In round i every element is thrown into
one of the t bins by a hash of (i, element) and offers the value (i, rest of the hash); a bin keeps its
least value, so a bin filled in an early round is never taken over by a later one.  After t rounds, round
t + b sends every element to bin b: all bins are filled whatever the set's size.  Most sets need one pass
over about t ln t hashes instead of t hashes per element, and the number of equal bins of two sketches
concentrates around t times the Jaccard similarity as it does for t independent minima.

``rows`` consecutive bins make a band; sets that share a band are candidates.  Candidates are verified on
their whole sets.  Texts of equal word sequences are one node from the start.

No bucket is expanded into its pairs.  First each member is tested against one hub of its bucket, and the
links found are gathered into components; a bucket of near copies is one component then and done.  Only
pairs of one bucket in different components can still matter.  Small buckets test them directly.  The members of large ones
(near copies just too far apart, texts that share a passage) are keyed again, exactly: with the shingles
of a set ordered from rare to frequent, two similar sets share one of their first few, and the places of the first
shared one bound how similar they can be at all.  So a text with more shingles of its own than the similarity allows meets nobody,
however large its bucket.  Every set also carries the parities of its shingle counts in a fixed number of bins: two sets
differ in as many shingles as parities at least, so near copies just too far apart are told from these alone, and no
sets are dealt out for them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.llm.batches import text_slices
from demandloom.llm.components import connected_components
from demandloom.plans.storage import cut_lineage

COORDS = 128
BAND_ROWS = 4
SEED = 42
# the members of a bucket of more nodes are keyed again by their rarest shingles
HOT_BUCKET = 16
# slots of the table of approximate shingle counts, which only orders shingles: its size is fixed
COUNT_SLOTS = 1 << 18
# pairs left across components per member of a bucket from which another hub is tried first
CROWDED = 50

# bins of a set's parities, 64 to a word
PARITY_BITS = 512

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(words: list[bytes], size: int) -> set[bytes]:
    """Distinct shingles of ``size`` words; fewer words are one shingle, no words none."""
    if len(words) < size:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[i:] for i in range(size)))))


def shingle_hashes(shingles: set[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(s, SEED) for s in shingles), dtype=np.uint64, count=len(shingles))


def sketch(hashes: np.ndarray, coords: int = COORDS) -> np.ndarray:
    """The ``coords`` bins (a power of two) of a non-empty set: bin, round and value in one integer each."""
    bin_bits = coords.bit_length() - 1
    if coords != 1 << bin_bits or not len(hashes):
        raise ValueError("a sketch needs a power of two of bins and at least one element")
    value_bits = 64 - bin_bits - (bin_bits + 1)
    low = np.uint64((1 << value_bits) - 1)
    to_bin = np.uint64(64 - bin_bits)
    starts = np.arange(coords, dtype=np.uint64) << to_bin
    unset = np.uint64((1 << (64 - bin_bits)) - 1)
    best = starts | unset
    at_once = max(1, ceil(2 * coords * log(coords) / len(hashes)))
    first = 0
    while first < coords and (best & unset == unset).any():
        rounds = np.arange(first, min(coords, first + at_once), dtype=np.uint64)[:, None]
        drawn = _mixed(hashes[None, :] + (rounds + np.uint64(1)) * _GOLDEN)
        offers = np.sort((drawn >> to_bin << to_bin | rounds << np.uint64(value_bits) | drawn & low).ravel())
        place = np.minimum(np.searchsorted(offers, starts), len(offers) - 1)
        least = offers[place]
        best = np.where(least >> to_bin == starts >> to_bin, np.minimum(best, least), best)
        first += at_once
    for b in np.flatnonzero(best & unset == unset):
        own = np.array([coords + b], dtype=np.uint64)
        value = (_mixed(hashes + (own + np.uint64(1)) * _GOLDEN) & low).min()
        best[b] = (starts[b : b + 1] | own << np.uint64(value_bits) | value)[0]
    return best


def band_keys(bins: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    """One hash per band of ``rows`` bins; bins carry their number, so bands never meet one another."""
    bands = bins[: len(bins) // rows * rows].reshape(-1, rows)
    key = np.zeros(len(bands), dtype=np.uint64)
    for j in range(rows):
        key = _mixed((key ^ bands[:, j]) + _GOLDEN)
    return key


def _words(text: str | None) -> list[bytes]:
    # bytes split at ASCII white space and lower only A-Z
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _sketched(docs: DataFrame, shingle: int, coords: int, band_rows: int) -> DataFrame:
    """(doc_id, place, digest, n_shingles, bands) of every row; no bands without words."""
    names = ["doc_id", "place", "digest", "n_shingles", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, 2):
                digests, sizes, keys = [], [], []
                for text in texts:
                    words = _words(text)
                    shingles = shingle_set(words, shingle)
                    digests.append(sha256(b" ".join(words)).digest())
                    sizes.append(len(shingles))
                    found = band_keys(sketch(shingle_hashes(shingles), coords), band_rows) if shingles else []
                    keys.append(np.asarray(found, dtype=np.uint64).view(np.int64))
                made = [pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], names)

    return docs.mapInArrow(run, "doc_id long, place long, digest binary, n_shingles long, bands array<long>")


def _shingle_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """(node, members) of ``rows(node, digest, text)``: hashes of the whole set, rows of another digest left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, 2):
                nodes, sets = [], []
                for node, digest, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts):
                    words = _words(text)
                    if sha256(b" ".join(words)).digest() == digest:
                        nodes.append(node)
                        sets.append(shingle_hashes(shingle_set(words, shingle)).view(np.int64))
                made = [pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(made, ["node", "members"])

    return rows.mapInArrow(run, "node long, members array<long>")


def _similar_sizes(a: Column, b: Column, percent: int) -> Column:
    """Sets of these sizes can reach the similarity at all."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets have a Jaccard similarity of ``percent`` or more."""
    left = sets.select(F.col("node").alias("a"), F.col("members").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    union = F.size("set_a") + F.size("set_b") - both
    return pairs.join(left, "a").join(right, "b").where(100 * both >= percent * union).select("a", "b")


def _star_roots(links: DataFrame) -> DataFrame:
    """(node, root) of ``links(a, b)``, a the larger: links to hubs are mostly stars, so only the hubs are joined in rounds.

    Every node hangs on its least hub; its other hubs are linked to that one, and so is a node that is a hub itself.
    """
    least = cut_lineage(links.groupBy("a").agg(F.min("b").alias("m")))
    others = links.join(least, "a").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
    hubs = links.select(F.col("b").alias("a")).distinct()
    inner = least.join(hubs, "a", "left_semi").select("a", F.col("m").alias("b"))
    core = cut_lineage(connected_components(others.unionByName(inner).distinct()))
    of_hub = core.select(F.col("node").alias("m"), "root")
    hanging = least.join(of_hub, "m", "left").select(F.col("a").alias("node"), F.coalesce("root", "m").alias("root"))
    alone = core.join(least.select(F.col("a").alias("node")), "node", "left_anti")
    return hanging.unionByName(alone)


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after further links; nodes that are missing are roots, before as after.

    Only components that a link joins are looked at: few, however many nodes they have.
    """
    own = roots.select(F.col("node").alias("own"), "root")
    ends = links
    for end in ("a", "b"):
        ends = ends.join(own, F.col(end) == F.col("own"), "left").withColumn(end, F.coalesce("root", end)).drop("own", "root")
    merged = cut_lineage(connected_components(ends.where("a <> b").distinct()))
    renamed = merged.select(F.col("node").alias("old"), F.col("root").alias("new"))
    moved = roots.join(renamed, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root"))
    return cut_lineage(moved.unionByName(merged))


def _with_roots(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components, with their component and the bucket's size."""
    known = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ends = known.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("members"))
    return cut_lineage(known.join(ends.where("lo <> hi").select("key", "members"), "key"))


def _hub_pairs(members: DataFrame, order: Column, percent: int) -> DataFrame:
    """Every member against the least of its bucket by ``order``, once; a is the larger node."""
    hub = members.groupBy("key").agg(F.min(F.struct(order.alias("o"), "node", "n", "root")).alias("hub"))
    both = members.join(hub, "key").where(
        (F.col("root") != F.col("hub.root")) & _similar_sizes(F.col("n"), F.col("hub.n"), percent)
    )
    return both.select(F.greatest("node", "hub.node").alias("a"), F.least("node", "hub.node").alias("b")).distinct()


def _count_table(sets: DataFrame) -> np.ndarray:
    """How many sets have a shingle of each slot: approximate counts in a table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNT_SLOTS, dtype=np.int64)
        for batch in batches:
            slots = batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64) % np.uint64(COUNT_SLOTS)
            counts += np.bincount(slots.astype(np.int64), minlength=COUNT_SLOTS)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], ["slot", "n"])

    found = sets.select("members").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    table = np.zeros(COUNT_SLOTS, dtype=np.int64)
    # one row per slot at most
    for r in found.collect():
        table[r["slot"]] = r["n"]
    return table


def rare_prefix(members: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a set from rare to frequent, of which similar sets share one."""
    slots = (members % np.uint64(len(counts))).astype(np.int64)
    ordered = members[np.lexsort((members, counts[slots]))]
    return ordered[: len(members) + (-percent * len(members)) // 100 + 1]


def parities(members: np.ndarray) -> np.ndarray:
    """Whether a set's shingles are odd in number, bin by bin, as words; a shingle more or less changes one bin."""
    bins = (members >> np.uint64(64 - PARITY_BITS.bit_length() + 1)).astype(np.int64)
    return np.packbits(np.bincount(bins, minlength=PARITY_BITS).astype(np.uint8) & 1).view(np.int64)


def _prefixes(sets: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """(key, node, n, place, parity): the first shingles of every set, places counted from 1, and the whole set's parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, nodes, sizes, places, words = [], [], [], [], []
            for i, node in enumerate(batch.column(0).to_pylist()):
                members = batch.column(1)[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                first = rare_prefix(members, counts, percent)
                keys.append(first.view(np.int64))
                nodes.append(np.full(len(first), node))
                sizes.append(np.full(len(first), len(members)))
                places.append(np.arange(1, len(first) + 1))
                words.append(np.tile(parities(members), len(first)))
            columns = [pa.array(np.concatenate(c or [[]]).astype(np.int64)) for c in (keys, nodes, sizes, places, words)]
            of_rows = pa.FixedSizeListArray.from_arrays(columns.pop(), PARITY_BITS // 64).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*columns, of_rows], ["key", "node", "n", "place", "parity"])

    return sets.select("node", "members").mapInArrow(run, "key long, node long, n long, place long, parity array<long>")


def _across(left: DataFrame, right: DataFrame, percent: int, placed: bool) -> DataFrame:
    """(a, b): pairs of one bucket in different components that can be similar by their sizes, places and parities."""
    columns = ["node", "n", "root", *(["place", "parity"] if placed else [])]
    other = right.select("key", *[F.col(c).alias(f"{c}_b") for c in columns])
    able = (F.col("root") != F.col("root_b")) & _similar_sizes(F.col("n"), F.col("n_b"), percent)
    if placed:
        # nothing before the first shared shingle is shared
        most = F.least(F.col("n") - F.col("place"), F.col("n_b") - F.col("place_b")) + 1
        able = able & ((100 + percent) * most >= percent * (F.col("n") + F.col("n_b")))
        # each parity that differs is a shingle of one set only
        words = [F.lit(i) for i in range(PARITY_BITS // 64)]
        apart = sum(F.bit_count(F.get("parity", i).bitwiseXOR(F.get("parity_b", i))) for i in words)
        able = able & ((100 + percent) * apart <= (100 - percent) * (F.col("n") + F.col("n_b")))
    pairs = left.join(other, "key").where(able)
    return pairs.select(F.greatest("node", "node_b").alias("a"), F.least("node", "node_b").alias("b"))


def _minority(members: DataFrame) -> DataFrame:
    """Members outside the largest component of their bucket: one of every two components is among them."""
    sizes = members.groupBy("key", "root").agg(F.count("*").alias("own"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("own", "root")).alias("top"))
    return members.join(largest.select("key", F.col("top.root").alias("top_root")), "key").where("root <> top_root").drop("top_root")


def set_roots(
    nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int = 80, hot_bucket: int | None = None
) -> DataFrame:
    """(node, root) of ``nodes(node, n, bands)`` whose component has a smaller node; the others are roots.

    ``sets_of(wanted)`` gives (node, members) of the nodes asked for.
    """
    hot_bucket = HOT_BUCKET if hot_bucket is None else hot_bucket
    keyed = nodes.select("node", "n", F.explode("bands").alias("key"))
    several = keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key")
    shared = cut_lineage(keyed.join(several, "key").select("key", "node", "n"))
    sets = cut_lineage(sets_of(shared.select("node").distinct()))
    tested = cut_lineage(_hub_pairs(shared.withColumn("root", F.col("node")), F.col("node"), percent))
    roots = cut_lineage(_star_roots(cut_lineage(_verified(tested, sets, percent))))
    mixed = _with_roots(shared, roots)
    small = mixed.where(F.col("members") <= hot_bucket)
    pairs = _across(small, small, percent, False)
    again = mixed.where(F.col("members") > hot_bucket).select("node").distinct()
    hot = cut_lineage(sets.join(again, "node", "left_semi"))
    if not hot.isEmpty():
        prefixes = cut_lineage(_prefixes(hot, _count_table(hot), percent))
        roots, members = _crowds(prefixes, roots, sets, percent)
        pairs = pairs.unionByName(_across(_minority(members), members, percent, True).distinct())
    rest = pairs.distinct().join(tested, ["a", "b"], "left_anti")
    return _joined(roots, _verified(rest, sets, percent))


def _crowds(prefixes: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(roots, members with their components): further hubs where very many pairs are left across components, as long
    as they join a tenth of those outside the largest one."""
    turn = 0
    while True:
        members = _with_roots(prefixes, roots)
        outside = cut_lineage(_minority(members))
        most = int(CROWDED * members.count())
        # no more pairs are made than it takes to see that they are too many
        if _across(outside, members, percent, True).limit(most + 1).count() <= most:
            return roots, members
        turn += 1
        found = cut_lineage(_verified(_hub_pairs(members, F.xxhash64(F.lit(turn), "root", "node"), percent), sets, percent))
        roots = _joined(roots, found)
        if 10 * found.count() < outside.select("node").distinct().count():
            return roots, _with_roots(prefixes, roots)


def near_duplicates(
    docs: DataFrame,
    shingle: int = 5,
    percent: int = 80,
    coords: int = COORDS,
    band_rows: int = BAND_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per row of ``docs``.

    Sets with a Jaccard similarity of ``percent`` / 100 or more are linked; ``component_id`` is the smallest
    id reachable, the row's own included.  With the default bins, a pair at exactly 0.8 shares no band with a probability
    of 5e-8, more similar ones less; shared bands are only candidates, links are decided on whole sets (of 64-bit
    shingle hashes: two shingles of one pair clash with a probability below n^2 / 2^64).

    Words are runs outside ASCII white space, A-Z lower-cased.  Null, empty and blank texts have no shingles and are
    linked with nothing, not even with each other.  Null ids are never smallest; a component of null ids only has a
    null one.  ``kept`` marks the rows whose id is the component's (null matches null), so rows that repeat that id all stay.
    Repeated rows give repeated rows, an empty table none; other columns are ignored.
    """
    text = F.col(f"`{text_col}`")
    source = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("place"), text.alias("text")
    )
    rows = cut_lineage(_sketched(source, shingle, coords, band_rows))
    # where to find one text of each word sequence, and what its copies share
    at = F.min(F.struct("doc_id", "place")).alias("at")
    same = rows.where("n_shingles > 0").groupBy("digest").agg(
        at, F.min("doc_id").alias("smallest"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")
    )
    nodes = cut_lineage(same.withColumn("node", F.monotonically_increasing_id()))

    def sets_of(wanted: DataFrame) -> DataFrame:
        places = nodes.join(wanted, "node", "left_semi").select(
            "node", "digest", F.col("at.doc_id").alias("at_id"), F.col("at.place").alias("at_place")
        )
        on = (F.col("place") == F.col("at_place")) & F.col("doc_id").eqNullSafe(F.col("at_id"))
        found = source.join(places, on).select("node", "digest", "text")
        return _shingle_sets(found, shingle).dropDuplicates(["node"])

    roots = set_roots(nodes.select("node", "n", "bands"), sets_of, percent)
    rooted = nodes.join(roots, "node", "left").select("digest", "smallest", F.coalesce("root", "node").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("smallest").alias("component_id"))
    labels = rooted.join(smallest, "root").select("digest", "component_id")
    linked = rows.where("n_shingles > 0").select("doc_id", "n_shingles", "digest").join(labels, "digest")
    alone = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    found = linked.select("doc_id", "n_shingles", "component_id").unionByName(alone)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
