import random

import public_tokenizers
import pytest
from conftest import as_rows
from samples import make_docs, odd_rows  # noqa: F401
from demandloom.llm import quality_rules, sentencepiece_codec, token_counts
from demandloom.llm.queries import PIECE_MODEL, RANK_FILE
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def library():
    sentencepiece = pytest.importorskip("sentencepiece")
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECE_MODEL))


def random_texts(n):
    rng = random.Random(6)
    alphabet = ["the", "Tion", " ", "  ", "\n", "\t", "é", "漢", "🙂", "▁", ".", "x" * 70, "\r\n", "\x00", "ﬁ", "<s>", "<0x0A>"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 40))) for _ in range(n)]


def test_codec_equals_the_library(library):
    codec = sentencepiece_codec.Codec(open(public_tokenizers.path(PIECE_MODEL), "rb").read())
    texts = [*random_texts(400), "a" * 500, "ab" * 3000, "", " ", "\n"]
    offsets, ids, starts, ends = codec.encode(texts)
    for i, text in enumerate(texts):
        own = ids[offsets[i] : offsets[i + 1]].tolist()
        assert own == library.encode(text), repr(text)
        assert codec.decode(own).decode() == library.decode(own), repr(text)
        data = text.encode()
        spans = list(zip(starts[offsets[i] : offsets[i + 1]], ends[offsets[i] : offsets[i + 1]]))
        # pieces follow one another and cover every byte
        assert [a for a, _ in spans] == [0, *(b for _, b in spans)][: len(spans)]
        assert (spans[-1][1] if spans else 0) == len(data)
        for (a, b), piece in zip(spans, own):
            surface = codec.surface[piece].decode(errors="replace")
            if piece not in codec.bytes_of and text.count("▁") == 0:
                assert data[a:b].decode().replace(" ", "▁") == surface.removeprefix("▁" if a == 0 and data[:1] != b" " else "") or a == 0


def test_decode_of_any_ids_equals_the_library(library):
    codec = sentencepiece_codec.Codec(open(public_tokenizers.path(PIECE_MODEL), "rb").read())
    rng = random.Random(2)
    for _ in range(300):
        ids = [rng.choice((rng.randrange(3, 259), rng.randrange(259, 32000), 1, 2)) for _ in range(rng.randrange(12))]
        assert codec.decode(ids).decode() == library.decode(ids), ids


def test_small_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "CACHED_CHUNKS", 3)
    codec = sentencepiece_codec.Codec(open(public_tokenizers.path(PIECE_MODEL), "rb").read())
    for text in random_texts(60):
        assert codec.encode([text])[1].tolist() == library.encode(text)


def test_compiled_map_equals_the_library():
    """Longest-prefix normalisation with a public compiled map, and where each character came from."""
    sentencepiece = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2 as schema

    normalizer = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    proto = schema.ModelProto()
    proto.ParseFromString(normalizer.serialized_model_proto())
    codec = sentencepiece_codec.Codec(open(public_tokenizers.path(PIECE_MODEL), "rb").read())
    codec.charmap = sentencepiece_codec.CharMap(proto.normalizer_spec.precompiled_charsmap)
    codec.spec.CopyFrom(proto.normalizer_spec)
    codec.spec.escape_whitespaces = True
    codec.spec.add_dummy_prefix = False
    for trim in (False, True):
        codec.spec.remove_extra_whitespaces = trim
        reference = sentencepiece.SentencePieceNormalizer(
            rule_name="nmt_nfkc", add_dummy_prefix=False, escape_whitespaces=True, remove_extra_whitespaces=trim
        )
        for text in ["ﬁne ①② ㍻", "Ａ　ｂ  c ", "  é é ", "plain", "", "​ x", "が ｶﾞ", *random_texts(40)]:
            norm, ends = codec.normalise(text)
            assert norm == reference.normalize(text), repr(text)
            assert len(ends) == len(norm) + 1
            assert all(a <= b for a, b in zip(ends, ends[1:])) and ends[-1] <= len(text.encode())


def test_encoded_rows(make_docs, odd_rows, library):
    model = public_tokenizers.path(PIECE_MODEL)
    encoded = sentencepiece_codec.encode(make_docs(odd_rows), model)
    found = sentencepiece_codec.decode(encoded.withColumn("decoded", F.lit(1)), model).collect()
    both = sentencepiece_codec.encode(make_docs(odd_rows), model, with_decoded=True).collect()
    assert len(found) == len(both) == len(odd_rows)
    texts = {r[0]: r[1] or "" for r in odd_rows}
    for r in [*found, *both]:
        assert r.ids == library.encode(texts[r.doc_id])
        assert r.decoded == library.decode(r.ids)
    assert sentencepiece_codec.encode(make_docs([]), model).count() == 0


# ---- token counts


def rank_content():
    with open(public_tokenizers.path(RANK_FILE), "rb") as f:
        return f.read()


def test_lengths_and_histogram(make_docs, odd_rows):
    import tiktoken

    ranks = token_counts.read_ranks(rank_content())
    coder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    lengths = token_counts.token_lengths(make_docs(odd_rows), rank_content(), public_tokenizers.PATTERN)
    want = [len(coder.encode_ordinary(r[1] or "")) for r in odd_rows]
    assert sorted(r.n_tokens for r in lengths.collect()) == sorted(want)
    histogram = token_counts.length_histogram(lengths)
    rows = histogram.collect()
    assert sorted(r.n_tokens for r in rows) == sorted(set(want))
    for r in rows:
        assert r.n_docs == want.count(r.n_tokens)
        assert r.docs_at_least == sum(x >= r.n_tokens for x in want)
        assert r.tokens_at_least == sum(x for x in want if x >= r.n_tokens)
        assert r.docs_at_most == sum(x <= r.n_tokens for x in want)
        assert r.truncated_tokens == sum(min(x, r.n_tokens) for x in want)
    limits = [0, 1, 5, 1000, 10**6]
    for r in token_counts.at_limits(histogram, limits).collect():
        assert r.docs_over == sum(x > r.context_limit for x in want)
        assert r.truncated_tokens == sum(min(x, r.context_limit) for x in want)
        assert r.tokens_lost == sum(want) - r.truncated_tokens
    for r in token_counts.quantile_lengths(histogram, [0.1, 0.5, 1.0]).collect():
        assert r.n_tokens == min(x for x in want if sum(y <= x for y in want) / len(want) >= r.share)


def test_texts_are_encoded_once(make_docs, odd_rows):
    lengths = token_counts.token_lengths(make_docs(odd_rows), rank_content(), public_tokenizers.PATTERN)
    done = lengths.sparkSession.sparkContext.accumulator(0)
    counting = F.udf(lambda n: (done.add(1), n)[1], "long")
    token_counts.length_histogram(lengths.withColumn("n_tokens", counting("n_tokens"))).collect()
    # the filter and the count may both ask for the length
    assert done.value <= 2 * len(odd_rows)


def test_no_lengths(spark):
    empty = spark.createDataFrame([], "doc_id long, n_tokens long")
    histogram = token_counts.length_histogram(empty)
    assert histogram.count() == 0
    assert as_rows(token_counts.at_limits(histogram, [5]), "context_limit", "docs_over") == [(5, 0)]


# ---- quality rules


def brute_stats(text):
    import re
    from collections import Counter

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeated = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)),
        len(repeated),
        len(lines),
        len(re.findall("[A-Z]", text or "")),
        (text or "").count("!"),
    )


def test_stats_equal_brute_force(make_docs, odd_rows):
    rng = random.Random(1)
    rows = [r[:2] for r in odd_rows]
    for i in range(60):
        words = [rng.choice("ab#c!D|") for _ in range(rng.randrange(4))]
        unit = [rng.choice("abcdefgh") + str(rng.randrange(3)) for _ in range(rng.randrange(1, 14))]
        rows.append((300 + i, " ".join(words + unit * rng.randrange(1, 4)) + "\n" + "line\n" * rng.randrange(3)))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs")
    found = quality_rules.text_stats(make_docs(rows)).collect()
    assert len(found) == len(rows)
    texts = dict(rows)
    for r in found:
        assert tuple(r[n] for n in names) == brute_stats(texts[r.doc_id]), texts[r.doc_id][:200]


def stats_frame(spark, n):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        symbols, upper = rng.randrange(100), rng.randrange(100)
        rows.append((i, 100, 1000, symbols * 10, 10, 0, upper * 10, 0, 0))
        labels.append((i, int(symbols > 70 or (upper > 60 and symbols > 40))))
    columns = "doc_id long, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_upper long, n_bangs long, n_repeat_words long"
    return spark.createDataFrame(rows, columns), spark.createDataFrame(labels, "doc_id long, label int")


def test_rules_are_found_and_precise(spark):
    stats, labels = stats_frame(spark, 1500)
    rules = quality_rules.learn_rules(stats, labels)
    assert 1 <= len(rules) <= 8 and all(r.precision >= 0.9 for r in rules)
    assert any(c.feature == "symbol_share" and c.above for c in rules[0].conditions)
    judged = stats.withColumn("rule", quality_rules.verdict(rules)).join(labels, "doc_id")
    right = judged.where((F.col("rule") > 0) == (F.col("label") == 1)).count()
    assert right > 0.93 * 1500
    # the first rule that holds decides
    first = judged.where(F.col("rule") == 1).count()
    met = F.lit(True)
    for c in rules[0].conditions:
        met = met & c.column()
    assert first == stats.where(met).count()


def test_nothing_to_learn(spark):
    stats, labels = stats_frame(spark, 30)
    assert quality_rules.learn_rules(stats, labels.where("label IS NULL")) == []
    assert quality_rules.learn_rules(stats, labels.withColumn("label", F.lit(0))) == []
    assert stats.select(quality_rules.verdict([]).alias("v")).where("v <> 0").count() == 0
