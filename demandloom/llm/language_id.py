"""Language identification: spans of mixed-language text by Viterbi over per-word scores.

The script of a word (fixed character ranges) narrows the languages it may belong to, as learned; its
score in each of them comes from the counts of the word and of its character n-grams.  The best path
over a text's words, with a penalty for each switch, labels its spans; the language with most letters
labels the text.

Most texts have one language, and that can be proved without the path: if no stretch of words favours
another language over the best single one by more than half the penalty, no switch can pay.  Only the
other texts run Viterbi.  Learning takes a bounded sample of labelled rows; the model has a bounded
number of words and n-grams, so what is sent to tasks does not grow with the data.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from demandloom.llm.batches import text_slices
from demandloom.plans.storage import cut_lineage

UNDETERMINED = "und"
# fixed values: first and last code point of the letters of each script
SCRIPTS = (
    ("latin", 0x0041, 0x024F),
    ("greek", 0x0370, 0x03FF),
    ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x077F),
    ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF),
    ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF),
    ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x1F00, 0x1FFF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
)
WORD = re.compile(r"[^\W\d_]+")
GRAM_SIZES = (1, 2, 3)
# words a task remembers
CACHED_WORDS = 250_000


@dataclass(frozen=True)
class LanguageConfig:
    """``max_rows`` bounds the rows learned from, ``max_features`` the words and n-grams kept.

    Both are shared evenly by the languages, however rare one is in the corpus.  ``switch_penalty`` is the
    log-score a change of language costs, ``floor`` the most one word can speak against a language,
    ``script_share`` the share of a language's words that makes it a candidate for their script.
    """

    max_rows: int = 10_000
    max_features: int = 60_000
    switch_penalty: float = 16.0
    floor: float = -6.0
    script_share: float = 0.002


@dataclass(frozen=True)
class LanguageModel:
    """Languages in order; by feature the log-probability in each; by script the candidates."""

    languages: tuple[str, ...]
    cfg: LanguageConfig
    logs: dict[str, tuple[float, ...]]
    unseen: tuple[float, ...]
    candidates: dict[str, tuple[bool, ...]]


def script_of(word: str) -> str:
    """Script of the first letter that has a known one."""
    for letter in word:
        code = ord(letter)
        for name, first, last in SCRIPTS:
            if first <= code <= last:
                return name
    return "other"


def word_features(word: str) -> list[str]:
    """The word itself (marked), then its n-grams with both ends marked."""
    bounded = f"^{word}$"
    grams = [bounded[i : i + n] for n in GRAM_SIZES for i in range(len(bounded) - n + 1)]
    return [f"={word}", *grams]


def _counted(sample: DataFrame) -> DataFrame:
    """(lang, feature, n) of a labelled sample; features of kinds = (words), @ (scripts) and n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: dict[str, Counter] = {}
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                words.setdefault(lang, Counter()).update(WORD.findall((text or "").lower()))
            for lang, counts in words.items():
                total: Counter = Counter()
                for word, n in counts.items():
                    total[f"@{script_of(word)}"] += n
                    for feature in word_features(word):
                        total[feature] += n
                columns = [pa.array([lang] * len(total)), pa.array(list(total)), pa.array(list(total.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "feature", "n"])

    counted = sample.select("lang", "text").mapInArrow(run, "lang string, feature string, n long")
    return counted.groupBy("lang", "feature").agg(F.sum("n").alias("n"))


def _chosen(ids: DataFrame, most: int) -> DataFrame:
    """At most ``most`` of ``ids(doc_id, lang)``, shared by the languages as evenly as their sizes allow."""
    sizes = {r["lang"]: r["count"] for r in ids.groupBy("lang").count().collect()}
    quotas, left = {}, most
    for i, (lang, size) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        quotas[lang] = min(size, left // (len(sizes) - i))
        left -= quotas[lang]
    # below the bound a language has its quota of ids and a margin, so what is ranked stays small
    state = [(k, q, min(1.0, (q + 6 * q**0.5 + 20) / sizes[k])) for k, q in quotas.items()]
    quota = ids.sparkSession.createDataFrame(state, "of string, quota long, bound double")
    place = F.xxhash64(F.lit(2), "doc_id").bitwiseAND(F.lit((1 << 63) - 1))
    near = ids.withColumn("place", place).join(F.broadcast(quota), F.col("lang") == F.col("of"))
    near = near.where(F.col("place") <= F.col("bound") * float(1 << 63))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id"))
    return near.withColumn("rank", rank).where("rank <= quota").select("doc_id", "lang")


def train(
    docs: DataFrame, cfg: LanguageConfig = LanguageConfig(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> LanguageModel:
    """Learn from at most ``max_rows`` ids of ``docs`` that have a language, chosen by a hash within each language."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    slim = slim.where("lang IS NOT NULL")
    chosen = _chosen(slim.select("doc_id", "lang").distinct(), cfg.max_rows).withColumnRenamed("lang", "of")
    # bounded by max_rows
    same = slim["doc_id"].eqNullSafe(chosen["doc_id"]) & (F.col("lang") == F.col("of"))
    sample = slim.join(F.broadcast(chosen), same, "left_semi")
    # the table of a bounded sample
    counted = cut_lineage(_counted(sample))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "feature"))
    table = counted.where("feature NOT LIKE '@%'").withColumn("rank", rank).groupBy("feature").agg(
        F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by_lang"), F.min("rank").alias("rank")
    )
    rows = table.orderBy("rank", "feature").limit(cfg.max_features).collect()
    scripts: dict[str, dict[str, int]] = {}
    for r in counted.where("feature LIKE '@%'").collect():
        scripts.setdefault(r["feature"][1:], {})[r["lang"]] = r["n"]
    languages = tuple(sorted({lang for r in rows for lang in r["by_lang"]}))
    counts = {r["feature"]: np.array([r["by_lang"].get(x, 0) for x in languages], float) for r in rows}
    words = np.sum([c for f, c in counts.items() if f[0] == "="], axis=0) if counts else np.zeros(0)
    size = max(1, len(counts))
    # half a count for what a language has not shown
    scale = np.log(words + 0.5 * size) if counts else np.zeros(0)
    logs = {f: tuple(np.log(c + 0.5) - scale) for f, c in counts.items()}
    by_script = {s: np.array([by_lang.get(x, 0) for x in languages], float) for s, by_lang in scripts.items()}
    own = np.sum(list(by_script.values()), axis=0) if by_script else np.zeros(len(languages))
    candidates = {s: tuple((c > 0) & (c >= cfg.script_share * own)) for s, c in by_script.items()}
    return LanguageModel(languages, cfg, logs, tuple(np.log(0.5) - scale), candidates)


class Scorer:
    """Scores and paths of one task; remembers a bounded number of words."""

    def __init__(self, model: LanguageModel) -> None:
        self.model = model
        self.n = len(model.languages)
        self.place = {f: i for i, f in enumerate(model.logs)}
        # one row per feature, then the row of unseen ones
        rows = [*model.logs.values(), model.unseen]
        self.logs = np.array(rows, dtype=np.float64).reshape(len(rows), self.n)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.scores, self.letters = array("f"), array("i")

    def _learn(self, words: list[str]) -> None:
        """Number new words; -1 for those without a letter."""
        lettered = [w for w in words if any(c.isalpha() for c in w)]
        self.known.update(dict.fromkeys(words, -1))
        first = len(self.letters)
        self.known.update({w: first + i for i, w in enumerate(lettered)})
        self.letters.extend(map(len, lettered))
        if lettered:
            self.scores.frombytes(self._scores(lettered).astype(np.float32).tobytes())

    def _scores(self, words: list[str]) -> np.ndarray:
        """Log-scores by language, 0 for a word's best, not below the floor."""
        get, unseen, floor = self.place.get, len(self.logs) - 1, self.model.cfg.floor
        flat, counts, whole, possible = [], [], [], []
        for word in words:
            itself, *grams = word_features(word)
            flat += [get(g, unseen) for g in grams]
            counts.append(len(grams))
            whole.append(get(itself, -1))
            possible.append(self.model.candidates.get(script_of(word)) or (False,) * self.n)
        starts = np.cumsum(counts) - counts
        total = np.add.reduceat(self.logs[flat], starts, axis=0) / len(GRAM_SIZES)
        known = np.array(whole)
        total[known >= 0] += self.logs[known[known >= 0]]
        allowed = np.array(possible, dtype=bool)
        total[~allowed] = -np.inf
        best = total.max(axis=1, initial=-np.inf, keepdims=True)
        total = np.clip(np.where(allowed, total - np.where(np.isfinite(best), best, 0.0), floor), floor, 0.0)
        # a script no language was learned in speaks for none
        total[~allowed.any(axis=1)] = 0.0
        return total

    def label(self, texts: list[str]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """(language, share of letters, spans of (first word, word after the last, language)) per text."""
        if len(self.known) > CACHED_WORDS:
            self.clear()
        found = [WORD.findall(text.lower()) for text in texts]
        self._learn(sorted(set().union(*found) - self.known.keys()))
        number = self.known.__getitem__
        numbers = [np.fromiter(map(number, words), dtype=np.int64, count=len(words)) for words in found]
        scores = np.frombuffer(self.scores, np.float32).reshape(-1, max(1, self.n))
        letters = np.frombuffer(self.letters, np.int32)
        return [self._label(n[n >= 0], scores, letters) for n in numbers]

    def _label(self, words: np.ndarray, scores: np.ndarray, letters: np.ndarray):
        if not len(words) or not self.n:
            return UNDETERMINED, 0.0, []
        s = scores[words].astype(np.float64)
        best = int(s.sum(axis=0).argmax())
        gain = np.cumsum(s - s[:, best : best + 1], axis=0)
        low = np.minimum.accumulate(np.vstack([np.zeros(self.n), gain[:-1]]), axis=0)
        if (gain - low).max() <= self.model.cfg.switch_penalty / 2:
            spans = [(0, len(words), best)]
        else:
            spans = best_path(s, self.model.cfg.switch_penalty)
        weight = letters[words]
        by_language = np.zeros(self.n)
        for first, after, k in spans:
            by_language[k] += weight[first:after].sum()
        top = int(by_language.argmax())
        names = self.model.languages
        return names[top], float(by_language[top] / by_language.sum()), [(a, b, names[k]) for a, b, k in spans]


def best_path(s: np.ndarray, penalty: float) -> list[tuple[int, int, int]]:
    """Spans (first, after, state) of the best path through scores ``s[word, state]``."""
    n, states = s.shape
    value = s[0].tolist()
    switched = np.zeros((n, states), dtype=bool)
    leaders = np.zeros(n, dtype=np.int64)
    for t, row in enumerate(s[1:].tolist(), 1):
        top = max(value)
        leaders[t] = value.index(top)
        entry = top - penalty
        for k in range(states):
            if entry > value[k]:
                switched[t, k] = True
                value[k] = entry + row[k]
            else:
                value[k] += row[k]
    state, after, spans = value.index(max(value)), n, []
    for t in range(n - 1, 0, -1):
        if switched[t, state]:
            spans.append((t, after, state))
            after, state = t, int(leaders[t])
    spans.append((0, after, state))
    return spans[::-1]


LABELS = "doc_id long, lang_pred string, score double, spans array<struct<first:int,after:int,lang:string>>"
_SPAN = pa.struct([("first", pa.int32()), ("after", pa.int32()), ("lang", pa.string())])


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, spans): one row per row of ``docs``.

    Words are runs of letters of the whole text; spans are word numbers (first, after the last).  A
    null text or one without a letter is ``und`` with score 0 and no spans.  Ties go to the language
    first by name.  Other columns are not read; repeated rows stay repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for part, texts in text_slices(batch, 1):
                lang, score, spans = zip(*scorer.label([t or "" for t in texts]))
                shown = [[{"first": a, "after": b, "lang": k} for a, b, k in s] for s in spans]
                columns = [
                    part.column(0),
                    pa.array(lang, pa.string()),
                    pa.array(score, pa.float64()),
                    pa.array(shown, pa.list_(_SPAN)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "spans"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, LABELS)
