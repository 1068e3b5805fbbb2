"""Quality rules: statistics of whole texts and learned decision lists, in DataFrame expressions only.

:func:`text_stats` measures texts within their rows.  :func:`learn_rules` learns an ordered list of
threshold conjunctions by sequential covering: each rule is grown one condition at a time by information
gain on one part of the labelled rows, pruned on the other part, and takes the rows it covers out of
the next rule's sight.  The rows are binned by quantiles and counted by bin pattern once; every growing
step is one small aggregation of those counts, of which the driver sees features x bins rows whatever
the number of labelled rows.  The list becomes one ``CASE WHEN`` expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.plans.storage import cut_lineage

WHITE = r"[\x20\x09-\x0D]+"
WHITE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 8

# names of the shares that rules are learned on
FEATURES = (
    "n_words",
    "mean_word",
    "symbol_share",
    "upper_share",
    "bang_share",
    "dup_line_share",
    "repeat_share",
    "words_per_line",
)


def _empty(kind: str) -> Column:
    return F.expr(f"CAST(array() AS array<{kind}>)")


def words_of(text: Column) -> Column:
    """Runs outside ASCII white space; none for a null text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE_CHARS))
    return F.when(trimmed == "", _empty("string")).otherwise(F.split(trimmed, WHITE))


def window_hashes(words: Column, window: int = WINDOW) -> Column:
    """A hash of each run of ``window`` words, by its start."""
    starts = F.when(F.size(words) >= window, F.sequence(F.lit(1), F.size(words) - (window - 1))).otherwise(_empty("int"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, window)))


def repeated_words(words: Column, hashes: Column, window: int = WINDOW) -> Column:
    """Words in windows that occur twice or more, all occurrences counted, each word once.

    Windows are brought together by hash and compared word by word with their neighbours.  Arrays that
    a lambda reads are bound first; as expressions they would be made again for every element.
    """
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), (i + 1).alias("at"))))
    bound = F.array(F.struct(words.alias("words"), placed.alias("placed")))

    def count(t: Column) -> Column:
        def same(a: Column, b: Column) -> Column:
            equal = F.slice(t["words"], a["at"], window) == F.slice(t["words"], b["at"], window)
            return F.coalesce((a["h"] == b["h"]) & equal, F.lit(False))

        repeated = F.filter(
            t["placed"],
            lambda x, i: same(x, F.get(t["placed"], i - 1)) | same(x, F.get(t["placed"], i + 1)),
        )
        covered = F.aggregate(
            F.sort_array(F.transform(repeated, lambda x: x["at"])),
            F.struct(F.lit(0).alias("reached"), F.lit(0).alias("n")),
            lambda s, at: F.struct(
                (at + window).alias("reached"),
                (s["n"] + F.least(F.lit(window), at + window - s["reached"])).alias("n"),
            ),
        )
        return covered["n"].cast("long")

    return F.get(F.transform(bound, count), F.lit(0))


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of every text: one row per row of ``docs``, all counts long.

    Columns: doc_id, n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines,
    n_repeat_words, n_upper (A-Z), n_bangs.  A null or empty text counts 0 everywhere.  Other columns
    are not read; repeated rows stay repeated.
    """
    text = F.col("text")
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WHITE_CHARS)) != "")

    def without(chars: str) -> Column:
        return F.length(text) - F.length(F.translate(text, chars, ""))

    split = slim.select(
        "doc_id",
        words_of(text).alias("words"),
        lines.alias("lines"),
        F.length(F.translate(text, WHITE_CHARS, "")).alias("word_chars"),
        without(SYMBOLS).alias("n_symbols"),
        without(UPPER).alias("n_upper"),
        without("!").alias("n_bangs"),
    )
    hashed = split.select(
        "doc_id",
        "words",
        window_hashes(F.col("words")).alias("hashes"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        "word_chars",
        "n_symbols",
        "n_upper",
        "n_bangs",
    )
    words, hashes = F.col("words"), F.col("hashes")
    # most texts repeat no window, which the number of distinct hashes proves
    repeats = F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), repeated_words(words, hashes)).otherwise(0)
    longs = ("word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_upper", "n_bangs")
    return hashed.select(
        "doc_id",
        F.size(words).cast("long").alias("n_words"),
        *(F.col(c).cast("long").alias(c) for c in longs),
        repeats.cast("long").alias("n_repeat_words"),
    )


def features() -> dict[str, Column]:
    """The learned rules' features from the columns of :func:`text_stats`; 0 where a share is undefined."""

    def share(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))

    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "word_chars"),
        "upper_share": share("n_upper", "word_chars"),
        "bang_share": share("n_bangs", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "words_per_line": share("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = features()[self.feature]
        return value > self.threshold if self.above else value <= self.threshold


@dataclass(frozen=True)
class LearnedRule:
    """Rejects where all conditions hold; precision and covered rows on the pruning part."""

    conditions: tuple[Condition, ...]
    precision: float
    covered: int


@dataclass(frozen=True)
class RuleConfig:
    """Limits of the learner: rules, conditions of a rule, quantile bins, and what a rule must reach."""

    max_rules: int = 8
    max_conditions: int = 3
    bins: int = 48
    min_precision: float = 0.9
    min_covered: int = 3


Bins = dict[str, list[float]]
# a condition in bins: feature number, above, bin
Step = tuple[int, bool, int]


def _binned(stats: DataFrame, cfg: RuleConfig) -> tuple[Bins, DataFrame]:
    """Thresholds by feature, and counts (bins array, grow, bad, good) of the labelled rows."""
    named = stats.select(*(c.alias(f) for f, c in features().items()), "label", "grow")
    shares = [i / cfg.bins for i in range(1, cfg.bins)]
    row = named.agg(*(F.percentile_approx(f, shares, 10_000).alias(f) for f in FEATURES)).first()
    bins = {f: sorted(set(row[f] or [])) for f in FEATURES}
    # the bin is the number of thresholds below the value
    below = [[(F.col(f) > t).cast("int") for t in bins[f]] for f in FEATURES]
    counts = named.select(F.array(*(sum(b, F.lit(0)) for b in below)).alias("bins"), "label", "grow").groupBy("bins", "grow")
    return bins, counts.agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good"))


def _holds(steps: list[Step]) -> Column:
    met = F.lit(True)
    for number, above, place in steps:
        value = F.col("bins")[number]
        met = met & ((value > place) if above else (value <= place))
    return met


def _entropy_gain(bad: int, good: int, bad_before: int, good_before: int) -> float:
    if not bad or not bad_before:
        return 0.0
    return bad * (math.log2(bad / (bad + good)) - math.log2(bad_before / (bad_before + good_before)))


def _best_step(rows: DataFrame) -> tuple[Step | None, float]:
    """The condition with most gain on ``rows(bins, bad, good)``, ties to the first in order."""
    each = rows.select(F.posexplode("bins").alias("feature", "bin"), "bad", "good")
    found = each.groupBy("feature", "bin").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).collect()
    table: dict[int, list] = {}
    for r in sorted(found, key=lambda r: (r["feature"], r["bin"])):
        table.setdefault(r["feature"], []).append((r["bin"], r["bad"], r["good"]))
    best, most = None, 1e-9
    for number, by_bin in table.items():
        bad_all, good_all = sum(b for _, b, _ in by_bin), sum(g for _, _, g in by_bin)
        bad = good = 0
        for place, b, g in by_bin[:-1]:
            bad, good = bad + b, good + g
            for above, x, y in ((False, bad, good), (True, bad_all - bad, good_all - good)):
                gain = _entropy_gain(x, y, bad_all, good_all)
                if gain > most:
                    best, most = (number, above, place), gain
    return best, most


def _counts(rows: DataFrame) -> tuple[int, int]:
    r = rows.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).first()
    return r["bad"] or 0, r["good"] or 0


def _grown(rows: DataFrame, cfg: RuleConfig) -> list[Step]:
    steps: list[Step] = []
    while len(steps) < cfg.max_conditions:
        step, _ = _best_step(rows)
        if step is None:
            break
        steps.append(step)
        rows = rows.where(_holds([step]))
        if not _counts(rows)[1]:
            break
    return steps


def _pruned(steps: list[Step], rows: DataFrame) -> tuple[list[Step], float, int]:
    """The leading conditions that are most precise on the pruning part (smoothed), the fewest among equals."""
    flags = [_holds(steps[:i]) for i in range(1, len(steps) + 1)]
    sums = [F.sum(F.when(flag, F.col(c)).otherwise(0)) for flag in flags for c in ("bad", "good")]
    values = [v or 0 for v in rows.agg(*(s.alias(f"s{i}") for i, s in enumerate(sums))).first()]
    best = (0.0, 0, 0)
    for i in range(len(steps)):
        bad, good = values[2 * i : 2 * i + 2]
        worth = (bad + 1) / (bad + good + 2)
        if worth > best[0]:
            best = (worth, i + 1, bad + good)
    bad = values[2 * best[1] - 2]
    return steps[: best[1]], bad / best[2] if best[2] else 0.0, best[2]


def learn_rules(stats: DataFrame, labels: DataFrame, cfg: RuleConfig = RuleConfig()) -> list[LearnedRule]:
    """An ordered list of rules that reject; empty where nothing reliable can be learned.

    ``labels(doc_id, label)``: 1 is bad.  Null ids and labels are left out; an id labelled twice takes
    the larger label.  All labelled rows are used; a third of them, by a hash of the id, prunes.
    """
    one = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    grow = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(3)) != 0
    known = cut_lineage(stats.join(one, "doc_id").withColumn("grow", grow))
    bins, counts = _binned(known, cfg)
    left = cut_lineage(counts)
    rules: list[LearnedRule] = []
    while len(rules) < cfg.max_rules:
        steps = _grown(left.where("grow"), cfg)
        if not steps:
            break
        steps, precision, covered = _pruned(steps, left.where("NOT grow"))
        if precision < cfg.min_precision or covered < cfg.min_covered:
            break
        shown = tuple(Condition(FEATURES[n], above, bins[FEATURES[n]][place]) for n, above, place in steps)
        rules.append(LearnedRule(shown, precision, covered))
        left = left.where(~_holds(steps))
    return rules


def verdict(rules: list[LearnedRule]) -> Column:
    """Number of the first rule that rejects a row (from 1), 0 if none does."""
    decision = None
    for number, rule in enumerate(rules, 1):
        met = F.lit(True)
        for condition in rule.conditions:
            met = met & condition.column()
        decision = F.when(met, number) if decision is None else decision.when(met, number)
    return F.lit(0) if decision is None else decision.otherwise(0)
