"""License scans: ordered signature rules over whole texts, in DataFrame expressions only.

A text is normalised to lower-case words between single spaces.  Stems that the rules' keywords contain
are looked for first (plain substring search); a text without any has no detection and costs nothing
more.  Otherwise the rules whose keyword occurs are matched, giving word intervals, and a detection
whose interval lies within one of equal or higher priority is suppressed (among equal intervals of
equal priority the earlier rule stays).  Everything happens within a row: no shuffle, no exchange.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.llm.license_rules import EXACT, FAMILY, Rule, all_rules

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# fixed values: phrases counted on their own, and their labels
BASE_PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)
# every keyword contains one of these; short lists make a cheap first gate
STEMS = (
    "licen", "permi", "public", "reserved", "copy", "warranty", "provided as is", "apache", "bsd", "mit ", "gpl",
    "gnu", "cc by", "cc0", "creative", "use only", "terms", "software", "open ", "without restriction", "w3c",
    "zlib", "mulan", "elastic", "etalab", "beerware", "gemeinfrei", "fair use", "artistic", "wtfpl",
    "cecill", "blue oak", "business source", "server side", "polyform", "common development", "do what the",
    "released under", "free and unencumbered", "good not evil", "freetype", "independent jpeg", "confidential", "proprietary",
    "any later version", "neither the name", "all advertising", "redistribution and use", "dominio p",
    "all rites", "european union", "latex project", "vorbehalten", "tous droits", "reservados", "reproduced",
    "no part of this", "commercial use", "gfdl", "academic free", "noncommercial", "ncsa",
)

RULE_TYPE = "array<struct<number:int,keyword:string,pattern:string,label:string,priority:int,confidence:double>>"


def normalised(text: Column) -> Column:
    """Lower-case (A-Z) words with one space before, between and after them; a null text has none."""
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    words = F.trim(F.regexp_replace(lower, SEPARATORS, " "))
    return F.when(words == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def _spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" ")))).cast("int")


def word_count(norm: Column) -> Column:
    return (_spaces(norm) - 1).cast("long")


def base_matches(norm: Column, phrases: Sequence[tuple[str, str]] = BASE_PHRASES) -> dict[str, Column]:
    """n_base, first_word, last_word and base_labels of phrases given as words."""
    found = [F.contains(norm, F.lit(f" {phrase} ")) for phrase, _ in phrases]
    any_found = found[0]
    for f in found[1:]:
        any_found = any_found | f
    starts = "|".join(phrase for phrase, _ in phrases)
    # cut in front of every place: the first part is what goes before, the others start with a phrase
    parts = F.split(norm, f"(?<= )(?=(?:{starts}) )")
    labels = F.array_compact(F.array(*(F.when(f, F.lit(label)) for f, (_, label) in zip(found, phrases))))
    return {
        "n_base": F.when(any_found, (F.size(parts) - 1).cast("long")).otherwise(F.lit(0).cast("long")),
        "first_word": F.when(any_found, (_spaces(F.element_at(parts, 1)) - 1).cast("long")),
        "last_word": F.when(any_found, word_count(norm) - _spaces(F.element_at(parts, -1)).cast("long")),
        "base_labels": F.array_sort(F.array_distinct(labels)),
    }


def _rule_array(rules: Sequence[Rule]) -> Column:
    rows = [
        {
            "number": i,
            "keyword": r.keyword,
            "pattern": f"(?<= )(?:{r.signature})(?= )",
            "label": r.label,
            "priority": r.priority,
            "confidence": r.confidence,
        }
        for i, r in enumerate(rules)
    ]
    # folded into one constant when the plan is optimized
    return F.from_json(F.lit(json.dumps(rows)), RULE_TYPE)


def check_rules(rules: Sequence[Rule], stems: Sequence[str]) -> None:
    """Raise unless every keyword contains a stem and priorities are known."""
    for r in rules:
        if not any(s in r.keyword for s in stems):
            raise ValueError(f"no stem gates the keyword {r.keyword!r}")
        if r.priority not in (1, FAMILY, EXACT):
            raise ValueError(f"unknown priority of {r.label!r}")


def _places(norm: Column, rule: Column) -> Column:
    """Detections of one rule: word intervals [first, last]."""
    matches = F.regexp_extract_all(norm, rule["pattern"], F.lit(0))
    gaps = F.split(norm, rule["pattern"])
    # a gap begins and ends with a space; a match has one space less than words
    steps = F.zip_with(
        F.slice(gaps, F.lit(1), F.size(matches)),
        matches,
        lambda gap, match: F.struct((_spaces(gap) - 1).alias("skip"), (_spaces(match) + 1).alias("words")),
    )
    start = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<first:int,last:int>>)").alias("out"))

    def step(state: Column, x: Column) -> Column:
        first = state["at"] + x["skip"]
        span = F.struct(first.alias("first"), (first + x["words"] - 1).alias("last"))
        return F.struct((first + x["words"]).alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    spans = F.aggregate(steps, start, step)["out"]
    return F.transform(
        spans,
        lambda s: F.struct(
            s["first"].alias("first"),
            (-s["last"]).alias("neg_last"),
            (-rule["priority"]).alias("neg_priority"),
            rule["number"].alias("number"),
            rule["label"].alias("label"),
            rule["confidence"].alias("confidence"),
        ),
    )


_KEPT = "array<struct<label:string,first:int,last:int,priority:int,confidence:double>>"


def _unsuppressed(detections: Column) -> Column:
    """Detections not contained in one of equal or higher priority, by start."""
    ordered = F.array_sort(detections)
    start = F.struct(
        F.lit(-1).alias("hint"),
        F.lit(-1).alias("family"),
        F.lit(-1).alias("exact"),
        F.expr(f"CAST(array() AS {_KEPT})").alias("kept"),
    )

    def step(state: Column, d: Column) -> Column:
        last, priority = -d["neg_last"], -d["neg_priority"]
        # furthest end of what starts no later and may suppress this one
        reach = F.greatest(
            state["exact"],
            F.when(priority <= FAMILY, state["family"]).otherwise(-1),
            F.when(priority < FAMILY, state["hint"]).otherwise(-1),
        )
        shown = F.struct(
            d["label"].alias("label"),
            d["first"].alias("first"),
            last.alias("last"),
            priority.alias("priority"),
            d["confidence"].alias("confidence"),
        )
        furthest = lambda name, level: F.greatest(state[name], F.when(priority == level, last).otherwise(-1)).alias(name)
        kept = F.when(reach >= last, state["kept"]).otherwise(F.concat(state["kept"], F.array(shown)))
        return F.struct(furthest("hint", 1), furthest("family", FAMILY), furthest("exact", EXACT), kept.alias("kept"))

    return F.aggregate(ordered, start, step)["kept"]


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] | None = None, stems: Sequence[str] = STEMS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, detections.

    ``detections`` are the rules' matches after suppression, with word intervals, priority and
    confidence.  A null or wordless text has no words, places or detections (null first and last word).
    Other columns are not read; repeated rows stay repeated.
    """
    rules = all_rules() if rules is None else rules
    check_rules(rules, stems)
    norm = F.col("norm")
    gate = F.lit(False)
    for stem in stems:
        gate = gate | F.contains(norm, F.lit(stem))
    active = F.filter(_rule_array(rules), lambda r: F.contains(norm, r["keyword"]))
    detections = _unsuppressed(F.flatten(F.transform(active, lambda r: _places(norm, r))))
    slim = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    base = base_matches(norm)
    return slim.select(
        "doc_id",
        word_count(norm).alias("n_words"),
        *(c.alias(name) for name, c in base.items()),
        F.when(gate, detections).otherwise(F.expr(f"CAST(array() AS {_KEPT})")).alias("detections"),
    )
