"""Line dedup by a segment-partition edit join, in DataFrame expressions only.

Lines at most ``threshold`` edits apart are linked.  A line is cut into threshold + 1 segments whose sizes
depend on its length class only; a line within the threshold contains one of them unchanged, near the same
place.  So every line offers the hashes of its segments, and looks up the substrings that can line up with a
segment (multi-match-aware positions: 5 rows a line at threshold 2, and 5 more for the few lines near the lower
end of their class, which look into the class below).

Only hashes are dealt out by segment.  Line texts are shuffled once, pre-aggregated by a 64-bit hash of
the line, and meet again the few segments that different lines share.  Each edit changes two letter counts
by one at most: that sum is tested before the distance.  In a segment that many lines share (variants of one
template) the counts are keys: the letters are dealt into 2 x threshold + 1 groups, one of which no edit changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from demandloom.llm.components import connected_components
from demandloom.plans.storage import cut_lineage

WHITE_CHARS = " \t\n\x0b\x0c\r"
THRESHOLD = 2
# shorter lines are only compared for equality, unless a caller asks for less
MIN_CHARS = 24
# the shortest lines the band can compare
SHORTEST = 2 * THRESHOLD + 2
# index lines of one segment before its lines are keyed again by letter counts
HOT_SEGMENT = 64
# letters from frequent to rare and digits, so that dealing them in turn makes groups alike
COUNTED_LETTERS = "etaonishrdlucmfwypvbgkjqxz0123456789"
# characters up to which Spark's own distance, whose steps grow with the square, is faster than the band
LONG_LINE = 4096
# words of the bit vectors
WORD = 62


def line_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    r"""(doc_id, line_no, line, k): the \n-separated lines that have a word, without outer ASCII white space."""
    numbered = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("line_no", "raw"))
    trimmed = numbered.select("doc_id", "line_no", F.btrim("raw", F.lit(WHITE_CHARS)).alias("line")).where("line <> ''")
    return trimmed.withColumn("k", F.xxhash64("line"))


def _class_start(length: Column) -> Column:
    """The least length of a line's length class; lines of one class are cut alike."""
    return (
        F.when(length < 32, length).when(length < 256, length - length % 8).otherwise(length - length % 32).cast("int")
    )


def segment_rows(lines: DataFrame, threshold: int, min_chars: int) -> DataFrame:
    """(key, k, indexed) of ``lines(k, line, length)``: own segments, which are index and probe, and further probes.

    Segments have the sizes of their class.  All but the last are counted from the start, the last from the
    end; what longer lines of the class have more lies before it and is in no segment.  Of an edit script of at most
    ``threshold`` edits, some segment i is untouched and has i edits before it, threshold - i at most after it; so
    it is at most i places off in the longer line, the first and the last one not at all.
    """
    parts = threshold + 1
    # columns, so each is evaluated once a line
    sized = lines.withColumns({f"base_{d}": _class_start(F.col("length") - d) for d in range(parts)})
    sized = sized.withColumns({f"size_{d}": F.floor(F.col(f"base_{d}") / parts).cast("int") for d in range(parts)})
    rows = []
    for shorter in range(parts):
        base, size = F.col(f"base_{shorter}"), F.col(f"size_{shorter}")
        # a longer line also looks into the class below, where the threshold reaches it
        wanted = F.col("length") - shorter >= min_chars
        if shorter:
            wanted = wanted & (base != F.col(f"base_{shorter - 1}"))
        for i in range(parts):
            own = base - size * threshold if i == threshold else size
            for shift in range(max(-i, i - threshold), i + 1) if i < threshold else [0]:
                at = F.col("length") - own + 1 if i == threshold else size * i + (1 + shift)
                possible = wanted & (at >= 1) & (at + own - 1 <= F.col("length"))
                key = F.when(possible, F.xxhash64(base, F.lit(i), F.substr("line", at, own)))
                rows.append(F.struct(key.alias("key"), F.lit(shorter == 0 and shift == 0).alias("indexed")))
    return sized.select("k", F.inline(F.array(*rows))).where("key IS NOT NULL")


def shared_segments(lines: DataFrame, threshold: int, min_chars: int) -> DataFrame:
    """(key, k, indexed, indexing): the rows of segments that different lines share; indexing counts the index rows."""
    same = Window.partitionBy("key")
    counted = segment_rows(lines, threshold, min_chars).select(
        "*",
        F.count_if("indexed").over(same).alias("indexing"),
        F.min("k").over(same).alias("lo"),
        F.max("k").over(same).alias("hi"),
    )
    return counted.where("lo <> hi AND indexing > 0").drop("lo", "hi")


def _letter_counts(line: Column) -> Column:
    """How often every counted letter or digit stands in a line, and last how often anything else."""
    rest = F.char_length(F.translate(line, COUNTED_LETTERS, ""))
    return F.array(*(F.char_length(line) - F.char_length(F.replace(line, F.lit(c))) for c in COUNTED_LETTERS), rest)


def members(lines: DataFrame, threshold: int, min_chars: int, hot_segment: int) -> DataFrame:
    """(key, k, indexed, line, length, letters): lines by the segments they share, those of hot segments by groups of letter counts too."""
    shared = shared_segments(lines, threshold, min_chars)
    counted = shared.join(lines, "k").withColumn("letters", _letter_counts(F.col("line")))
    groups = 2 * threshold + 1
    slots = range(len(COUNTED_LETTERS) + 1)
    again = [
        F.xxhash64("key", F.lit(g), *(F.get("letters", F.lit(i)) for i in slots if i % groups == g)) for g in range(groups)
    ]
    keys = F.when(F.col("indexing") > hot_segment, F.array(*again)).otherwise(F.array("key"))
    return counted.select(F.explode(keys).alias("key"), "k", "indexed", "line", "length", "letters")


def candidates(keyed: DataFrame, threshold: int) -> DataFrame:
    """(k_a, k_b, line_a, line_b): members of one key whose lengths and letter counts allow the threshold; b is the longer
    or, at equal length, the larger.  A pair may come once for each key it shares."""
    columns = ("k", "line", "length", "letters")
    left = keyed.where("indexed").select("key", *(F.col(c).alias(f"{c}_a") for c in columns))
    right = keyed.select("key", *(F.col(c).alias(f"{c}_b") for c in columns))
    longer = F.col("length_b") - F.col("length_a")
    once = longer.between(1, threshold) | ((longer == 0) & (F.col("k_a") < F.col("k_b")))
    slots = [F.lit(i) for i in range(len(COUNTED_LETTERS) + 1)]
    changes = sum(F.abs(F.get("letters_a", i) - F.get("letters_b", i)) for i in slots)
    pairs = left.join(right, "key").where(once & (changes <= 2 * threshold))
    return pairs.select("k_a", "k_b", "line_a", "line_b")


def within_distance(s: Column, r: Column, threshold: int) -> Column:
    """Whether two texts, ``s`` at most ``threshold`` characters the shorter, are that many edits apart."""
    short = F.char_length(r) <= LONG_LINE
    return F.when(short, F.levenshtein(s, r, threshold) >= 0).otherwise(within_band(s, r, threshold))


def within_band(s: Column, r: Column, threshold: int) -> Column:
    """As ``within_distance``, in steps that grow with the length only.

    The band of 2 x threshold + 1 cells around the diagonal is one bit vector per character of ``r``
    (vertical differences of the distance matrix); the score follows the diagonal and then the last row.
    Arrays and vectors that a lambda reads are bound first, so each is made once.
    """
    top, full = 1 << (WORD - 1), (1 << WORD) - 1
    inverted = lambda x: x.bitwiseXOR(F.lit(full))
    start = F.struct(
        F.lit(full & ~((1 << (WORD - threshold - 1)) - 1)).cast("long").alias("vp"),
        F.lit(0).cast("long").alias("vn"),
        F.lit(threshold).alias("score"),
        F.lit(top >> 1).cast("long").alias("edge"),
    )

    def matches(t: Column, i: Column) -> Column:
        """Bit WORD - 1 stands for character i + threshold of s (from 0), lower bits for those before it."""
        char, out = F.get(t["b"], i), F.lit(0).cast("long")
        for back in range(2 * threshold + 1):
            bit = F.when(F.get(t["a"], i + (threshold - back)) == char, F.lit(top >> back)).otherwise(F.lit(0))
            out = out.bitwiseOR(bit.cast("long"))
        return out

    def passed(state: Column, *names: str) -> list[Column]:
        return [state[n].alias(n) for n in names]

    def diagonal(u: Column) -> Column:
        x, vp, vn = u["x"], u["vp"], u["vn"]
        total = (x.bitwiseAND(vp) + vp).bitwiseAND(F.lit(full))
        d0 = total.bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn)
        return F.struct(d0.alias("d0"), *passed(u, "vp", "vn", "score", "edge", "on"))

    def horizontal(u: Column) -> Column:
        hp = u["vn"].bitwiseOR(inverted(u["d0"].bitwiseOR(u["vp"])))
        hn = u["d0"].bitwiseAND(u["vp"])
        return F.struct(hp.alias("hp"), hn.alias("hn"), *passed(u, "d0", "score", "edge", "on"))

    def vertical(u: Column) -> Column:
        down = F.shiftright(u["d0"], 1)
        missed = (u["d0"].bitwiseAND(F.lit(top)) == 0).cast("int")
        row = (u["hp"].bitwiseAND(u["edge"]) != 0).cast("int") - (u["hn"].bitwiseAND(u["edge"]) != 0).cast("int")
        return F.struct(
            u["hn"].bitwiseOR(inverted(down.bitwiseOR(u["hp"]))).alias("vp"),
            down.bitwiseAND(u["hp"]).alias("vn"),
            (u["score"] + F.when(u["on"], missed).otherwise(row)).alias("score"),
            F.when(u["on"], u["edge"]).otherwise(F.shiftright(u["edge"], 1)).alias("edge"),
        )

    def distance(t: Column) -> Column:
        def advance(state: Column, i: Column) -> Column:
            on = i < t["m"] - threshold
            first = F.struct(matches(t, i).alias("x"), on.alias("on"), *passed(state, "vp", "vn", "score", "edge"))
            steps = F.transform(F.transform(F.transform(F.array(first), diagonal), horizontal), vertical)
            return F.get(steps, F.lit(0))

        return F.aggregate(F.sequence(F.lit(0), F.size(t["b"]) - 1), start, advance)["score"]

    texts = F.struct(F.split(s, "").alias("a"), F.split(r, "").alias("b"), F.char_length(s).alias("m"))
    return F.get(F.transform(F.array(texts), distance), F.lit(0)) <= threshold


def line_links(
    rows: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, hot_segment: int = HOT_SEGMENT
) -> DataFrame:
    """(a, b): line hashes of every pair of different lines of ``rows`` within the threshold, once.

    Lines shorter than ``min_chars`` have no links.
    """
    if min_chars <= 2 * threshold + 1:
        raise ValueError("lines must be longer than the band")
    lines = rows.groupBy("k").agg(F.min("line").alias("line")).withColumn("length", F.char_length("line"))
    # few rows: the segments that nobody shares are gone
    keyed = cut_lineage(members(lines.where(F.col("length") >= min_chars), threshold, min_chars, hot_segment))
    near = candidates(keyed, threshold).where(within_distance(F.col("line_a"), F.col("line_b"), threshold))
    return near.select(F.col("k_a").alias("a"), F.col("k_b").alias("b")).distinct()


def near_duplicate_lines(
    docs: DataFrame,
    threshold: int = THRESHOLD,
    min_chars: int = MIN_CHARS,
    hot_segment: int = HOT_SEGMENT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per id: doc_id, n_lines, n_removed, n_near, n_links, removed.

    Lines with a word count.  A line's class holds the lines reachable over links, copies included; all
    but the class's first place (smallest id, then line number; null ids last) are removed.  ``removed``
    lists their line numbers, n_near counts those whose text differs from that first line's, and n_links
    adds up the links of the document's lines to different texts.  Rows that repeat an id are taken as
    one document; a null or blank text has no lines.
    """
    rows = line_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    links = cut_lineage(line_links(rows, threshold, min_chars, hot_segment))
    roots = connected_components(links)
    ends = links.select(F.col("a").alias("k")).unionByName(links.select(F.col("b").alias("k")))
    degree = ends.groupBy("k").agg(F.count("*").alias("links"))

    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "line_no", "k")
    placed = rows.select("doc_id", "line_no", "k")
    firsts = placed.groupBy("k").agg(F.min(place).alias("first"))
    # only linked lines have a class; every other one stands for itself
    linked = degree.join(roots.withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k"))
    classes = firsts.join(linked, "k").groupBy("root").agg(F.min("first").alias("class_first"))
    classed = linked.join(classes, "root").select("k", "links", "class_first")
    known = firsts.join(classed, "k", "left").select("k", F.coalesce("class_first", "first").alias("first"), "links")
    judged = placed.join(known, "k").select(
        "doc_id",
        "line_no",
        (~F.col("doc_id").eqNullSafe(F.col("first.doc_id")) | (F.col("line_no") != F.col("first.line_no"))).alias("gone"),
        (F.col("k") != F.col("first.k")).alias("other"),
        F.coalesce("links", F.lit(0)).alias("links"),
    )
    per_doc = judged.groupBy("doc_id").agg(
        F.count("*").alias("n_lines"),
        F.count_if("gone").alias("n_removed"),
        F.count_if(F.col("gone") & F.col("other")).alias("n_near"),
        F.sum("links").alias("n_links"),
        F.array_sort(F.collect_set(F.when(F.col("gone"), F.col("line_no")))).alias("removed"),
    )
    ids = docs.select(F.col(id_col).alias("id")).distinct()
    joined = ids.join(per_doc, ids["id"].eqNullSafe(per_doc["doc_id"]), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_lines", "n_removed", "n_near", "n_links")]
    none = F.expr("CAST(array() AS array<int>)")
    return joined.select(F.col("id").alias("doc_id"), *zero, F.coalesce("removed", none).alias("removed"))
