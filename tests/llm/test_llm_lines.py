import random
from collections import Counter, defaultdict

from conftest import as_rows
from samples import make_docs, odd_rows  # noqa: F401
from demandloom.llm import line_dedup, queries
from pyspark.sql import functions as F


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def mutated(rng, text, n):
    for _ in range(n):
        at = rng.randrange(len(text))
        kind = rng.randrange(3)
        text = text[:at] + ("" if kind == 0 else rng.choice("abcé")) + text[at + (kind != 2) :]
    return text


def test_band_equals_full_distance(spark):
    rng = random.Random(7)
    pairs = []
    for _ in range(300):
        s = "".join(rng.choice("abcdé") for _ in range(rng.randrange(8, 90)))
        r = mutated(rng, s, rng.randrange(5))
        s, r = sorted((s, r), key=len)
        if len(r) - len(s) <= 2:
            pairs.append((s, r, edits(s, r)))
    frame = spark.createDataFrame(pairs, "s string, r string, d int")
    for threshold in (2, 3):
        wrong = frame.where(line_dedup.within_distance(F.col("s"), F.col("r"), threshold) != (F.col("d") <= threshold))
        assert wrong.count() == 0


def variants(rng, n):
    base = ["".join(rng.choice("abcdefghij ") for _ in range(rng.randrange(30, 60))).strip() for _ in range(12)]
    lines = [mutated(rng, rng.choice(base), rng.randrange(4)) for _ in range(n)]
    return [x.strip() for x in lines]


def test_links_equal_brute_force_cold_and_hot(spark):
    rng = random.Random(11)
    lines = sorted({x for x in variants(rng, 160) if len(x) >= 24})
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc_id long, line_no int, line string")
    rows = rows.withColumn("k", F.xxhash64("line"))
    key = {r.k: r.line for r in rows.collect()}
    want = {frozenset((a, b)) for a in lines for b in lines if a < b and abs(len(a) - len(b)) <= 2 and edits(a, b) <= 2}
    assert want
    for hot in (64, 2):
        found = [frozenset((key[a], key[b])) for a, b in as_rows(line_dedup.line_links(rows, hot_segment=hot), "a", "b")]
        assert len(found) == len(set(found))
        assert set(found) == want


def test_documents_keep_first_places(make_docs, odd_rows):
    rng = random.Random(5)
    rows = [(100 + i, "\n".join(variants(rng, 6) + ["short", "", "  "])) for i in range(20)]
    rows += [r[:2] for r in odd_rows]
    found = {r.doc_id: r for r in line_dedup.near_duplicate_lines(make_docs(rows)).collect()}
    assert set(found) == {r[0] for r in rows}
    blank = " \t\n\x0b\x0c\r"
    occurrences = [(i, n, x.strip(blank)) for i, t in rows for n, x in enumerate((t or "").split("\n")) if x.strip(blank)]
    texts = sorted({x for *_, x in occurrences})
    root = {x: x for x in texts}
    long_ones = [x for x in texts if len(x) >= 24]
    degree = defaultdict(int)
    for a in long_ones:
        for b in long_ones:
            if a < b and abs(len(a) - len(b)) <= 2 and len(a) < 200 and edits(a, b) <= 2:
                degree[a] += 1
                degree[b] += 1
                old, new = root[a], root[b]
                root = {x: new if y == old else y for x, y in root.items()}
    order = lambda o: (o[0] is None, o[0] or 0, o[1])
    first = {}
    for o in sorted(occurrences, key=order):
        first.setdefault(root[o[2]], o)
    for doc_id, r in found.items():
        own = [o for o in occurrences if o[0] == doc_id]
        gone = [o for o in own if first[root[o[2]]][:2] != o[:2]]
        assert r.n_lines == len(own)
        assert r.removed == sorted({o[1] for o in gone})
        assert r.n_near == sum(first[root[o[2]]][2] != o[2] for o in gone)
        assert r.n_links == sum(degree[o[2]] for o in own)


def test_no_documents(make_docs):
    assert line_dedup.near_duplicate_lines(make_docs([])).count() == 0


def short_lines(rng, n):
    base = ["".join(rng.choice("abcdefghé") for _ in range(size)) for size in (4, 6, 7, 8, 9, 11, 14, 18, 22, 25)]
    return sorted({mutated(rng, rng.choice(base), rng.randrange(4)) for _ in range(n)} - {""})


def test_links_of_short_lines_equal_brute_force(spark):
    lines = short_lines(random.Random(13), 200)
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc_id long, line_no int, line string")
    rows = rows.withColumn("k", F.xxhash64("line"))
    key = {r.k: r.line for r in rows.collect()}
    long_enough = [x for x in lines if len(x) >= line_dedup.SHORTEST]
    want = {frozenset((a, b)) for a in long_enough for b in long_enough if a < b and edits(a, b) <= 2}
    assert {len(x) for pair in want for x in pair} >= set(range(6, 24, 2))
    for hot in (64, 2):
        links = line_dedup.line_links(rows, min_chars=line_dedup.SHORTEST, hot_segment=hot)
        found = [frozenset((key[a], key[b])) for a, b in as_rows(links, "a", "b")]
        assert len(found) == len(set(found))
        assert set(found) == want


def test_the_query_links_short_lines(spark, tmp_path):
    rows = [(1, "Read more\nHome"), (2, "Read more!\nContact us today"), (3, "Reed mores")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: (r.n_near, r.n_links, r.removed) for r in queries.op6_line_dedup(spark, str(tmp_path)).collect()}
    assert found == {1: (0, 2, []), 2: (1, 2, [0]), 3: (1, 2, [0])}


def test_long_lines_are_compared_by_the_band(spark, monkeypatch):
    rng = random.Random(17)
    pairs = []
    for _ in range(200):
        s = "".join(rng.choice("abcdé") for _ in range(rng.randrange(8, 60)))
        s, r = sorted((s, mutated(rng, s, rng.randrange(5))), key=len)
        if len(r) - len(s) <= 2:
            pairs.append((s, r, edits(s, r)))
    frame = spark.createDataFrame(pairs, "s string, r string, d int")
    for long_line in (0, 30):
        monkeypatch.setattr(line_dedup, "LONG_LINE", long_line)
        assert frame.where(line_dedup.within_distance(F.col("s"), F.col("r"), 2) != (F.col("d") <= 2)).count() == 0


def test_a_line_is_dealt_out_in_few_rows(spark):
    rng = random.Random(19)
    lines = ["".join(rng.choice("abcdefghij ") for _ in range(size)) for size in range(64, 400)]
    frame = spark.createDataFrame([(x,) for x in lines], "line string")
    frame = frame.select(F.xxhash64("line").alias("k"), "line", F.char_length("line").alias("length"))
    found = line_dedup.segment_rows(frame, 2, 6)
    assert found.count() <= 6.5 * len(lines)
    assert found.where("indexed").count() == 3 * len(lines)


def test_variants_of_one_template_meet_only_where_letter_counts_agree(spark):
    rng = random.Random(23)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(5, 9)))
    template = [word() for _ in range(24)]
    lines = set()
    while len(lines) < 600:
        own = list(template)
        own[rng.randrange(len(own))] = word()
        lines.add(mutated(rng, " ".join(own), rng.choice([0, 0, 1])).strip())
        if len(lines) % 20 == 0:
            lines.add(mutated(rng, " ".join(own), 2).strip())
    lines = sorted(lines)
    rows = spark.createDataFrame([(x,) for x in lines], "line string").withColumn("k", F.xxhash64("line"))
    key = {r.k: r.line for r in rows.collect()}
    counts = {x: Counter(x) for x in lines}
    # two edits change four counts at most
    close = lambda a, b: sum(((counts[a] - counts[b]) + (counts[b] - counts[a])).values()) <= 4
    want = {frozenset((a, b)) for a in lines for b in lines if a < b and close(a, b) and edits(a, b) <= 2}
    assert len(want) >= 10
    found = [frozenset((key[a], key[b])) for a, b in as_rows(line_dedup.line_links(rows), "a", "b")]
    assert len(found) == len(set(found))
    assert set(found) == want
    sized = rows.withColumn("length", F.char_length("line"))
    keyed = line_dedup.members(sized, 2, 24, line_dedup.HOT_SEGMENT)
    # about 180,000 pairs share a segment
    met = keyed.where("indexed").alias("x").join(keyed.alias("y"), F.expr("x.key = y.key AND x.k < y.k")).count()
    assert met <= 0.5 * len(lines) ** 2 / 2
    assert line_dedup.candidates(keyed, 2).distinct().count() <= 0.02 * len(lines) ** 2 / 2


def test_lines_that_differ_in_digits_meet_only_where_digit_counts_agree(spark):
    rng = random.Random(29)
    digits = lambda: "".join(rng.choice("0123456789") for _ in range(24))
    lines = [f"the request {digits()} was answered by the server in the usual time and then logged" for _ in range(300)]
    lines += [mutated(rng, x, rng.randrange(1, 3)).strip() for x in lines[:20]]
    lines = sorted(set(lines))
    rows = spark.createDataFrame([(x,) for x in lines], "line string")
    rows = rows.select(F.xxhash64("line").alias("k"), "line", F.char_length("line").alias("length"))
    key = {r.k: r.line for r in rows.collect()}
    counts = {x: Counter(x) for x in lines}
    close = lambda a, b: sum(((counts[a] - counts[b]) + (counts[b] - counts[a])).values()) <= 4
    want = {frozenset((a, b)) for a in lines for b in lines if a < b and close(a, b) and edits(a, b) <= 2}
    assert {frozenset((key[a], key[b])) for a, b in as_rows(line_dedup.line_links(rows), "a", "b")} == want
    assert len(want) >= 15
    keyed = line_dedup.members(rows, 2, 24, line_dedup.HOT_SEGMENT)
    # about 45,000 pairs share a segment
    assert line_dedup.candidates(keyed, 2).distinct().count() <= 0.02 * len(lines) ** 2 / 2
