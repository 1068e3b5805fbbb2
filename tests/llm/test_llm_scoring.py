import random
import re
from zlib import crc32

import numpy as np
import pytest
from samples import make_docs, odd_rows, prose  # noqa: F401
from demandloom.llm import language_id, license_scan, toxicity
from demandloom.llm.license_rules import EXACT, FAMILY, HINT, Rule, all_rules
from pyspark.sql import functions as F

# ---- languages

SAMPLES = {
    "en": "the cat and the dog with a house that is of this world for you and then there",
    "fr": "le chat et la maison avec une école qui est dans ce monde pour vous et puis voilà",
    "ru": "кошка и собака с домом который есть в этом мире для вас",
}


def lang_rows():
    rng = random.Random(4)
    rows = []
    for i in range(90):
        lang = list(SAMPLES)[i % 3]
        words = SAMPLES[lang].split()
        rows.append((i, " ".join(rng.choice(words) for _ in range(40)), lang))
    return rows


@pytest.fixture(scope="module")
def language_model(make_docs):
    return language_id.train(make_docs(lang_rows()))


def test_path_equals_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(30):
        s = rng.normal(size=(7, 3)).round(2) * 3
        best = max(
            (
                sum(s[t, k] for t, k in enumerate(path)) - 2.5 * sum(a != b for a, b in zip(path, path[1:])),
                path,
            )
            for path in np.ndindex(*[3] * 7)
        )
        spans = language_id.best_path(s, 2.5)
        path = [k for first, after, k in spans for _ in range(first, after)]
        assert len(path) == 7
        worth = sum(s[t, k] for t, k in enumerate(path)) - 2.5 * (len(spans) - 1)
        assert worth == pytest.approx(best[0])


def test_shortcut_agrees_with_the_path(language_model):
    scorer = language_id.Scorer(language_model)
    rng = random.Random(9)
    words = [w for t in SAMPLES.values() for w in t.split()]
    for _ in range(60):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 40)))
        (lang, _, spans), = scorer.label([text])
        s = scorer._scores(language_id.WORD.findall(text.lower()))
        worth = lambda sp: sum(s[a:b, language_model.languages.index(k) if isinstance(k, str) else k].sum() for a, b, k in sp) - 16 * (len(sp) - 1)
        assert worth(spans) == pytest.approx(worth(language_id.best_path(s, 16.0)), abs=1e-3)


def test_mixed_text_is_cut_into_spans(make_docs, language_model):
    text = f"{SAMPLES['en']}. {SAMPLES['fr']} {SAMPLES['fr']}"
    found = language_id.identify(make_docs([(1, text)]), language_model).first()
    assert found.lang_pred == "fr" and 0 < found.score < 1
    assert [s.lang for s in found.spans] == ["en", "fr"]
    assert found.spans[0].after == len(SAMPLES["en"].split())


def test_odd_texts(make_docs, odd_rows, language_model):
    rows = [*odd_rows, (90, "123 ²³ !!"), (91, SAMPLES["ru"])]
    found = language_id.identify(make_docs(rows), language_model).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id in (3, 4, 5, 90):
            assert (r.lang_pred, r.score, r.spans) == ("und", 0.0, [])
        else:
            assert r.lang_pred in SAMPLES and 0 < r.score <= 1
    assert next(r for r in found if r.doc_id == 91).lang_pred == "ru"


def test_nothing_to_learn_from(make_docs):
    model = language_id.train(make_docs([(1, "text", None)]))
    assert language_id.identify(make_docs([(1, "text")]), model).first().lang_pred == "und"
    assert language_id.identify(make_docs([]), model).count() == 0


def test_a_rare_language_is_learned_beside_a_hot_one(make_docs):
    rng = random.Random(6)
    speak = lambda lang: " ".join(rng.choice(SAMPLES[lang].split()) for _ in range(40))
    rows = [(i, speak("en"), "en") for i in range(3000)] + [(9000 + i, speak("fr"), "fr") for i in range(3)]
    asked = make_docs([(1, SAMPLES["fr"]), (2, SAMPLES["en"])])
    for cfg in (language_id.LanguageConfig(), language_id.LanguageConfig(max_rows=40, max_features=400)):
        model = language_id.train(make_docs(rows), cfg)
        assert len(model.logs) <= cfg.max_features
        assert {r.doc_id: r.lang_pred for r in language_id.identify(asked, model).collect()} == {1: "fr", 2: "en"}


# ---- licenses

PHRASES = [p for p, _ in license_scan.BASE_PHRASES]


def words_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def detections(text, rules):
    """Matches at word borders by rule, then those not inside one of equal or higher priority."""
    norm = " " + " ".join(words_of(text)) + " "
    found = []
    for number, r in enumerate(rules):
        if r.keyword in norm:
            for m in re.finditer(f"(?<= )(?:{r.signature})(?= )", norm):
                first = norm[: m.start()].count(" ") - 1
                found.append((first, first + m[0].count(" "), r.priority, number, r.label))
    kept = []
    for d in found:
        inside = [e for e in found if e is not d and e[0] <= d[0] and e[1] >= d[1] and e[2] >= d[2]]
        if not any(e[:3] != d[:3] or e[3] < d[3] for e in inside):
            kept.append((d[0], d[1], d[4]))
    return sorted(kept)


LICENSED = [
    "Licensed under the Apache License, Version 2.0. All rights reserved.",
    "Released under the MIT license. released under the mit license",
    "This is licensed under CC BY-NC 4.0, and CC-BY 3.0 too; cc by",
    "GNU General Public License, version 3 or later. GNU General Public License v2. GPL-2.0 gpl",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "Copyright (c) 2020 Some One. ALL RIGHTS RESERVED. all rights reserved all rights reserved",
    "cc by cc by-sa 4.0 creative commons attribution sharealike 4.0 éall rights reserved",
    "SPDX-License-Identifier: Apache-2.0",
    "no keyword in this one",
]


def test_scan_equals_brute_force(make_docs, odd_rows):
    rows = [(200 + i, t) for i, t in enumerate(LICENSED)] + [r[:2] for r in odd_rows]
    found = license_scan.scan(make_docs(rows)).collect()
    assert len(found) == len(rows)
    texts = dict(rows)
    rules = all_rules()
    for r in found:
        words = words_of(texts[r.doc_id])
        places = sorted(i for p in PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        assert r.n_words == len(words) and r.n_base == len(places)
        assert (r.first_word, r.last_word) == ((places[0], places[-1]) if places else (None, None))
        got = sorted((d.first, d["last"], d.label) for d in r.detections)
        assert got == detections(texts[r.doc_id], rules), texts[r.doc_id]


def test_base_labels_are_always_detected(make_docs):
    found = license_scan.scan(make_docs([(i, t) for i, t in enumerate(PHRASES)])).collect()
    for r in found:
        assert set(r.base_labels) <= {d.label for d in r.detections}


def test_priority_decides_between_nested_matches(make_docs):
    rules = [
        Rule("x", "a x b", "wide-hint", HINT, 0.1),
        Rule("x", "x", "narrow-exact", EXACT, 1.0),
        Rule("x", "x b", "family", FAMILY, 0.5),
        Rule("x", "x b", "same-again", FAMILY, 0.5),
    ]
    found = license_scan.scan(make_docs([(1, "a x b")]), rules=rules, stems=("x",)).first()
    assert [(d.label, d.first, d["last"]) for d in found.detections] == [
        ("wide-hint", 0, 2),
        ("family", 1, 2),
        ("narrow-exact", 1, 1),
    ]


def test_rules_are_gated_and_numerous():
    rules = all_rules()
    assert len(rules) > 300
    license_scan.check_rules(rules, license_scan.STEMS)
    with pytest.raises(ValueError, match="stem"):
        license_scan.check_rules([Rule("zzz", "zzz", "z", 1, 0.1)], license_scan.STEMS)
    for r in rules:
        re.compile(r.signature)


# ---- toxicity


def toxic_rows(n):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        bad = i % 6 == 0
        words = prose(60, i).split()
        if bad:
            words[rng.randrange(60)] = rng.choice(("scum", "moron"))
            words[rng.randrange(60)] = "idiot"
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_learned_words_separate_held_out_rows(spark, make_docs):
    rows, labels = toxic_rows(900)
    docs, labels = make_docs(rows), spark.createDataFrame(labels, "doc_id long, label int")
    cfg = toxicity.FTRLConfig(shard_rows=300)
    train = toxicity.labelled_sample(docs, labels.where(toxicity.fold("doc_id", 3) != 1), cfg.max_rows)
    model = toxicity.train(train, cfg)
    assert 0 < len(model.features) < 2000
    scored = toxicity.score(docs, model).join(labels, "doc_id").where(toxicity.fold("doc_id", 3) == 1).collect()
    good = [r.score for r in scored if not r.label]
    bad = [r.score for r in scored if r.label]
    assert sum(s >= 0.7 for s in bad) > 0.9 * len(bad)
    assert sum(s >= 0.7 for s in good) < 0.02 * len(good)


def test_scores_equal_sums_of_weights(make_docs, odd_rows):
    texts = ["Idiot, x y z", "y x idiot idiot", ""]
    doc, feature = toxicity.hashed_features([t.encode() for t in texts], 12)
    chosen = np.unique(feature)[::2]
    model = toxicity.ToxicityModel(12, -0.5, chosen, np.linspace(-1, 1, len(chosen)))
    weight = dict(zip(chosen, model.weights))
    got = {r.doc_id: r.score for r in toxicity.score(make_docs(list(enumerate(texts))), model).collect()}
    for i in range(3):
        total = -0.5 + sum(weight.get(f, 0.0) for f in set(feature[doc == i]))
        assert got[i] == pytest.approx(1 / (1 + np.exp(-total)))
    odd = toxicity.score(make_docs(odd_rows), model).collect()
    assert len(odd) == len(odd_rows) and all(0 <= r.score <= 1 for r in odd)


def test_features_are_words_pairs_and_skip_pairs():
    doc, feature = toxicity.hashed_features([b"A b C d", b"a", b""], 20)
    assert np.bincount(doc, minlength=3).tolist() == [4 + 3 + 2, 1, 0]
    same = toxicity.hashed_features([b"a-B c! d"], 20)[1]
    assert sorted(same) == sorted(feature[doc == 0])


def test_sample_is_bounded_and_takes_one_label(spark, make_docs):
    docs = make_docs([(i, f"t{i}") for i in range(50)])
    labels = spark.createDataFrame(
        [(i, 0) for i in range(50)] + [(3, 1), (None, 1), (7, None)], "doc_id long, label int"
    )
    sample = toxicity.labelled_sample(docs, labels, 100).collect()
    assert len(sample) == 50 and {r.label for r in sample if r.doc_id == 3} == {1}
    assert toxicity.labelled_sample(docs, labels, 10).count() == 10


def test_sample_is_bounded_where_ids_repeat(spark, make_docs):
    """Many rows of one id: equal ones count once, and of the others the first by a hash are taken."""
    docs = make_docs([(1, f"t{i % 300}") for i in range(900)] + [(2, "two"), (3, "three")])
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, label int")
    cut = toxicity.labelled_sample(docs, labels, 100).collect()
    assert 90 <= len(cut) <= 100 and len({(r.doc_id, r.text) for r in cut}) == len(cut)
    again = toxicity.labelled_sample(docs.repartition(7), labels, 100).collect()
    assert sorted(map(tuple, cut)) == sorted(map(tuple, again))
    whole = toxicity.labelled_sample(docs, labels, 500).collect()
    assert len(whole) == 302 and {r.label for r in whole if r.doc_id == 1} == {1}
    assert toxicity.train(toxicity.labelled_sample(docs, labels, 100)).bias == toxicity.train(toxicity.labelled_sample(docs, labels, 100)).bias


def test_no_labels_give_one_half(spark, make_docs):
    labels = spark.createDataFrame([], "doc_id long, label int")
    model = toxicity.train(toxicity.labelled_sample(make_docs([(1, "x")]), labels, 10))
    assert toxicity.score(make_docs([(1, "x")]), model).first().score == 0.5


def test_fold_is_crc32_of_the_id(spark):
    got = {r.id: r.f for r in spark.range(50).select("id", toxicity.fold("id", 3).alias("f")).collect()}
    assert got == {i: crc32(str(i).encode()) % 3 for i in range(50)}


def test_hidden_columns_do_not_matter(make_docs, language_model):
    one = language_id.identify(make_docs([(1, SAMPLES["en"], "fr", "z")]), language_model)
    two = language_id.identify(make_docs([(1, SAMPLES["en"], None, None)]).withColumn("spans", F.lit(1)), language_model)
    assert one.collect() == two.collect()


def sample_of(parsed, most):
    """A text that a signature describes, with as few or as many repetitions as it allows."""
    out = ""
    for op, value in parsed:
        name = str(op)
        if name == "LITERAL":
            out += chr(value)
        elif name == "IN":
            kind, first = value[-1 if most else 0]
            out += chr(first if str(kind) == "LITERAL" else first[0]) if str(kind) != "CATEGORY" else "1"
        elif name == "MAX_REPEAT":
            low, high, part = value
            out += sample_of(part, most) * (min(high, low + 1) if most else low)
        elif name == "SUBPATTERN":
            out += sample_of(value[3], most)
        elif name == "BRANCH":
            out += sample_of(value[1][0], most)
        elif name == "ANY":
            out += "x"
        else:
            assert name in ("ASSERT", "ASSERT_NOT"), name
    return out


def test_every_rule_matches_a_sample():
    import re._parser as parser

    for rule in all_rules():
        samples = [" ".join(words_of(sample_of(parser.parse(rule.signature), most))) for most in (False, True)]
        matched = [t for t in samples if re.search(f"(?<= )(?:{rule.signature})(?= )", f" {t} ")]
        assert any(rule.keyword in f" {t} " for t in matched), (rule.signature, samples)
