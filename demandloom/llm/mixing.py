"""Mixing sources to target weights by min-cost flow, then a seeded choice of documents.

A document may belong to several sources.  Documents are aggregated by membership pattern; the driver
sees one row per pattern (``max_patterns`` at most, and ``MAX_OVERLAPS`` of overlapping sources) and routes
word capacity from patterns to source quotas.  Taking a pattern again costs more each time (0, 1, 2, ...), so quotas are met with as little
repetition as possible.  Every pattern then takes whole passes over its documents and a rest.

The rest is chosen by a hash of seed, id and text: the documents up to a threshold hash.  Those larger
than what is then missing are left out and the next ones up to a higher threshold are taken, again
until no untaken document fits.  A threshold is found from sums by hash bucket and a running sum
inside one bucket, so no pattern's documents are ordered in one place; and since the choice is a
condition on hash and size, it is applied to the documents without a join on ids.
"""

from __future__ import annotations

import math
from collections import Counter, deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from demandloom.plans.storage import cut_lineage

SEED = 20
MAX_REPEATS = 3
# membership patterns that the driver sees, a name and two numbers each
MAX_PATTERNS = 1_000_000
# patterns of overlapping sources, which make the flow problem; sources of their own are not counted
MAX_OVERLAPS = 4096
# documents a hash bucket holds on average
BUCKET_ROWS = 2048
WORDS = r"[^\x20\x09-\x0D]+"

Source = str | None


@dataclass(frozen=True)
class Quota:
    size: int
    target: float


def by_name(sources: Sequence[Source]) -> list[Source]:
    """Sources by code point, null last."""
    return sorted(sources, key=lambda s: (s is None, s or ""))


def capped_targets(sizes: Sequence[int], weights: Sequence[float], total: float, times: int) -> list[float]:
    """Share ``total`` by weight; none above ``times`` its size, the excess shared again by weight."""
    targets, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while open_:
        weight = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / weight > times * sizes[i]}
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / weight
            break
        for i in over:
            targets[i] = float(times * sizes[i])
            left -= targets[i]
        open_ -= over
    return targets


class FlowNetwork:
    """Min-cost max-flow by successive cheapest paths; integer capacities and costs."""

    def __init__(self, nodes: int) -> None:
        self.edges: list[list[int]] = []  # to, capacity left, cost; the reverse is edge ^ 1
        self.out: list[list[int]] = [[] for _ in range(nodes)]

    def add(self, a: int, b: int, capacity: int, cost: int) -> int:
        for start, end, room, price in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.out[start].append(len(self.edges))
            self.edges.append([end, room, price])
        return len(self.edges) - 2

    def flow(self, edge: int) -> int:
        return self.edges[edge ^ 1][1]

    def run(self, source: int, sink: int) -> None:
        while True:
            cost = [math.inf] * len(self.out)
            via = [-1] * len(self.out)
            cost[source], queue, queued = 0, deque([source]), {source}
            while queue:
                a = queue.popleft()
                queued.discard(a)
                for e in self.out[a]:
                    b, room, price = self.edges[e]
                    if room and cost[a] + price < cost[b]:
                        cost[b], via[b] = cost[a] + price, e
                        if b not in queued:
                            queued.add(b)
                            queue.append(b)
            if via[sink] < 0:
                return
            path, at = [], sink
            while at != source:
                path.append(via[at])
                at = self.edges[via[at] ^ 1][0]
            pushed = min(self.edges[e][1] for e in path)
            for e in path:
                self.edges[e][1] -= pushed
                self.edges[e ^ 1][1] += pushed


def route(patterns: dict[tuple[Source, ...], int], quotas: dict[Source, Quota], times: int) -> dict:
    """Words to take of each pattern: quotas met as far as possible at the least cost of repetition.

    A source that only one pattern has, of no other source, takes what it can of it; the others are a flow problem.
    """
    users = Counter(name for key in patterns for name in key)
    alone = {k: min(times * s, round(quotas[k[0]].target)) for k, s in patterns.items() if len(k) == 1 and users[k[0]] == 1}
    shared = {k: s for k, s in patterns.items() if k not in alone}
    if len(shared) > MAX_OVERLAPS:
        raise ValueError(f"more than {MAX_OVERLAPS} patterns of overlapping sources: merge sources")
    return alone | _flow(shared, {n: q for n, q in quotas.items() if (n,) not in alone}, times)


def _flow(patterns: dict[tuple[Source, ...], int], quotas: dict[Source, Quota], times: int) -> dict:
    keys, names = list(patterns), list(quotas)
    first_source = 1 + len(keys)
    net = FlowNetwork(first_source + len(names) + 1)
    sink = first_source + len(names)
    place = {name: first_source + i for i, name in enumerate(names)}
    supply = {}
    for i, key in enumerate(keys, 1):
        supply[key] = [net.add(0, i, patterns[key], repeat) for repeat in range(times)]
        for name in key:
            net.add(i, place[name], times * patterns[key], 0)
    for name in names:
        net.add(place[name], sink, round(quotas[name].target), 0)
    net.run(0, sink)
    return {key: sum(net.flow(e) for e in supply[key]) for key in keys}


def pattern_of(memberships: Column) -> Column:
    """Distinct sources in order, null last; no membership counts as the null source."""
    distinct = F.array_sort(F.array_distinct(memberships))
    return F.when(F.size(F.coalesce(distinct, F.array())) == 0, F.array(F.lit(None).cast("string"))).otherwise(distinct)


def order_hash(id_col: str, text_col: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))


def sized(docs: DataFrame, memberships: Column, seed: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pattern, h, size): size counts runs outside ASCII white space, 0 for null texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [len(t.as_py().split()) if t.is_valid else 0 for t in batch.column(3)]
            columns = [*batch.columns[:3], pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "pattern", "h", "size"])

    slim = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        pattern_of(memberships).alias("pattern"),
        order_hash(id_col, text_col, seed).alias("h"),
        F.col(text_col).cast("binary").alias("text"),
    )
    return slim.mapInArrow(run, "doc_id long, pattern array<string>, h long, size long")


PLAN = T.StructType(
    [
        T.StructField("pattern", T.ArrayType(T.StringType())),
        T.StructField("passes", T.LongType()),
        T.StructField("last_h", T.LongType()),
        T.StructField(
            "fills", T.ArrayType(T.StructType([T.StructField("last_h", T.LongType()), T.StructField("limit", T.LongType())]))
        ),
    ]
)


@dataclass(frozen=True)
class MixPlan:
    """What a mix takes: quotas by source, and by pattern whole passes, a threshold hash and fills.

    A fill is a further threshold with the most words a document under it may have.  ``units`` has (pattern, h,
    unit), the words of all rows under one hash, for hashes of several rows; None if there are none.
    """

    quotas: dict[Source, Quota]
    choice: DataFrame
    units: DataFrame | None = None


def _bounded(rows: DataFrame, most: int, what: str) -> list:
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} {what}: raise the limit or merge sources")
    return found


def plan_mix(
    rows: DataFrame, weights: Sequence[float] = (1, 2, 3), times: int = MAX_REPEATS, max_patterns: int = MAX_PATTERNS
) -> MixPlan:
    """Plan a mix of ``rows`` (from :func:`sized`, read several times).

    Source i by :func:`by_name` weighs ``weights[i % len(weights)]``; the targets share all sizes.
    """
    spark = rows.sparkSession
    totals = _bounded(rows.groupBy("pattern").agg(F.sum("size").alias("s"), F.count("*").alias("n")), max_patterns, "patterns")
    patterns = {tuple(r["pattern"]): r["s"] for r in totals}
    names = by_name({name for key in patterns for name in key})
    by_source: Counter = Counter()
    for key, s in patterns.items():
        by_source.update(dict.fromkeys(key, s))
    sizes = [by_source[name] for name in names]
    share = [weights[i % len(weights)] for i in range(len(names))]
    targets = capped_targets(sizes, share, sum(patterns.values()), times)
    quotas = {n: Quota(s, t) for n, s, t in zip(names, sizes, targets)}
    words = route(patterns, quotas, times)

    passes = {k: words[k] // s if s else 0 for k, s in patterns.items()}
    rest = {k: words[k] - passes[k] * s for k, s in patterns.items()}
    bits = min(24, max(0, math.ceil(math.log2(max(1, sum(r["n"] for r in totals)) / BUCKET_ROWS))))
    first = _prefixes(rows.withColumn("unit", F.col("size")), rest, bits)
    last = {k: first[k][0] if k in first else None for k in patterns}
    left = {k: rest[k] - (first[k][1] if k in first else 0) for k in patterns}
    missing = {k: v for k, v in left.items() if v > 0}
    units = _shared_hashes(rows) if missing else None
    spare = _with_units(rows, units).where("size > 0")
    fills: dict[tuple, list[tuple[int, int]]] = {k: [] for k in patterns}
    reached = dict(last)
    while missing:
        taken = _prefixes(spare, missing, bits, reached)
        for key, (h, words) in taken.items():
            fills[key].append((h, missing[key]))
            reached[key] = h
        missing = {k: missing[k] - words for k, (_, words) in taken.items() if missing[k] > words}
    choice = [(list(k), passes[k], last[k], fills[k]) for k in patterns]
    return MixPlan(quotas, spark.createDataFrame(choice, PLAN), units)


def _shared_hashes(rows: DataFrame) -> DataFrame | None:
    """(pattern, h, unit): the words of all rows under one hash, where several rows have it."""
    groups = rows.groupBy("pattern", "h").agg(F.sum("size").alias("unit"), F.count("*").alias("n"))
    units = cut_lineage(groups.where("n > 1").select("pattern", "h", "unit"))
    return None if units.isEmpty() else units


def _with_units(rows: DataFrame, units: DataFrame | None) -> DataFrame:
    """``rows`` with ``unit``: the words taken when a row is, those of its copies included."""
    if units is None:
        return rows.withColumn("unit", F.col("size"))
    return rows.join(units, ["pattern", "h"], "left").withColumn("unit", F.coalesce("unit", "size"))


def _small(spark, values: dict, name: str) -> DataFrame:
    schema = T.StructType([PLAN["pattern"], T.StructField(name, T.LongType())])
    return F.broadcast(spark.createDataFrame([(list(k), v) for k, v in values.items()], schema))


def _prefixes(rows: DataFrame, rest: dict, bits: int, after: dict | None = None) -> dict:
    """By pattern the last hash and the words of the longest run of rows, in hash order, within ``rest``.

    Rows with equal hashes (same id and text) are taken together or not at all.  With ``after`` only rows
    beyond that hash whose unit fits into ``rest`` count.  Patterns without such rows are left out.
    """
    spark = rows.sparkSession
    asked = rows.join(_small(spark, rest, "rest"), "pattern").where("rest > 0")
    if after is not None:
        asked = asked.join(_small(spark, {k: after[k] for k in rest}, "after"), "pattern")
        asked = asked.where("unit <= rest AND (after IS NULL OR h > after)")
    bucket = F.shiftright("h", 64 - bits) if bits else F.lit(0).cast("long")
    asked = asked.withColumn("bucket", bucket)
    sums = asked.groupBy("pattern", "rest", "bucket").agg(F.sum("size").alias("s"), F.max("h").alias("top"))
    before = F.sum("s").over(Window.partitionBy("pattern").orderBy("bucket")) - F.col("s")
    whole = F.col("before") + F.col("s") <= F.col("rest")
    ends = sums.withColumn("before", before).where("before <= rest").groupBy("pattern").agg(
        F.max(F.when(whole, F.col("top"))).alias("top"),
        F.coalesce(F.sum(F.when(whole, F.col("s"))), F.lit(0)).alias("sum"),
        F.max(F.when(~whole, F.col("bucket"))).alias("edge"),
    )
    ends = {tuple(r["pattern"]): r for r in ends.collect()}
    found = {k: (r["top"], r["sum"]) for k, r in ends.items() if r["top"] is not None}
    edges = {k: r for k, r in ends.items() if r["edge"] is not None}
    if not edges:
        return found

    at = _small(spark, {k: r["edge"] for k, r in edges.items()}, "edge")
    start = _small(spark, {k: r["sum"] for k, r in edges.items()}, "before")
    inside = asked.join(at, "pattern").where("bucket = edge").join(start, "pattern")
    running = F.col("before") + F.sum("size").over(Window.partitionBy("pattern").orderBy("h"))
    taken = inside.withColumn("running", running).where("running <= rest")
    for r in taken.groupBy("pattern").agg(F.max("h").alias("h"), F.max("running").alias("sum")).collect():
        found[tuple(r["pattern"])] = (r["h"], r["sum"])
    return found


def repeats(unit: Column) -> Column:
    """How often a row is taken, from the columns of the plan's choice, the row's ``h`` and its unit of words."""
    fits = F.exists("fills", lambda f: (F.col("h") <= f["last_h"]) & (unit <= f["limit"]))
    chosen = (F.col("h") <= F.col("last_h")) | ((unit > 0) & fits)
    return F.col("passes") + F.coalesce(chosen, F.lit(False)).cast("long")


def mixed_sizes(rows: DataFrame, plan: MixPlan) -> DataFrame:
    """(doc_id, pattern, size, repeats, taken) for every row of ``rows``; taken counts repeats."""
    joined = _with_units(rows, plan.units).join(F.broadcast(plan.choice), "pattern")
    joined = joined.withColumn("repeats", repeats(F.col("unit")))
    return joined.select("doc_id", "pattern", "size", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))


def mixed_documents(
    docs: DataFrame, memberships: Column, plan: MixPlan, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, columns unchanged; no text is shuffled."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    keyed = docs.select(row, pattern_of(memberships).alias("pattern"), order_hash(id_col, text_col, seed).alias("h"))
    joined = keyed.join(F.broadcast(plan.choice), "pattern")
    # words are counted only between the threshold and the last fill
    near = F.col("h") <= F.get("fills", F.size("fills") - 1)["last_h"]
    own = F.coalesce(F.size(F.regexp_extract_all(F.col(f"row.`{text_col}`"), F.lit(WORDS), F.lit(0))), F.lit(0)).cast("long")
    counted = F.when(near & (F.col("last_h").isNull() | (F.col("h") > F.col("last_h"))), own).alias("size")
    joined = joined.select("*", counted)
    joined = _with_units(joined, plan.units).withColumn("repeats", repeats(F.col("unit")))
    taken = joined.where("repeats > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))))
    return taken.select("row.*")


def quota_table(spark, plan: MixPlan) -> DataFrame:
    """(source, source_size, target): one row per source, the null source last."""
    rows = [(n, q.size, q.target) for n, q in plan.quotas.items()]
    return spark.createDataFrame(rows, "source string, source_size long, target double")


def mix(docs: DataFrame, memberships: Column, seed: int = SEED, **settings) -> tuple[DataFrame, MixPlan]:
    """Sized rows (cut in the shared folder) and the plan of their mix.

    Null texts have size 0, null memberships are a source of their own, null ids are hashed like any
    value, repeated rows are taken together.  An empty table gives a plan without quotas.
    """
    rows = cut_lineage(sized(docs, memberships, seed))
    return rows, plan_mix(rows, **settings)
