"""Language identification: known words first, then shorter and shorter n-grams.

Spark counts words per language over a sample of training rows (bounded per
language, drawn by hash of the id), and character n-grams of those words. A
known word scores by its log frequency in each language. An unseen word is read
left to right; at each position the longest known n-gram ending there scores,
falling back from four characters to one.

Any number of languages is learned. The model is sparse: an entry stores a value
for the languages that have it, all others share one value per language. Its size
has a documented bound: of each language the most frequent words and n-grams, up
to WORDS and GRAMS, and ENTRIES over all languages. Words seen fewer than
MIN_TIMES times in the sample are left to their n-grams.

Defined results: a text that is null or has no letter is ``und`` with score 0,
and so is every text where nothing could be learned; ties go to the language
that sorts first; repeated rows count as often as they occur. Words are runs of
letters, lower-cased. The score is the posterior of the language over all words,
all languages being equally likely before. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes, fold, slices, stored, table
from .kernels import RangeHasher, lay_out

#: Bounds of the model: training rows, words and n-grams of each language, and
#: entries of all languages together.
SAMPLE_ROWS = 4000
WORDS = 20000
GRAMS = 20000
ENTRIES = 2_000_000
MIN_TIMES = 2
LONGEST_GRAM = 4
#: Languages whose counts are broadcast at most.
MOST_BROADCAST = 100_000
#: Bytes of a task's memory of word scores before it starts afresh.
REMEMBERED = 32 << 20

_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class LogFrequencies:
    """Add-one-half smoothed log frequencies of entries. Entry k has what its
    languages have more than ``floor`` at ``at[k]`` to ``at[k + 1]``."""

    index: dict[str, int]
    at: np.ndarray
    language: np.ndarray
    more: np.ndarray
    floor: np.ndarray

    def summed(self, owner: list[int], entries: list[int], weight: list[float], n: int) -> np.ndarray:
        """What the entries of each of ``n`` owners have more than the floor."""
        entry, width = np.array(entries, dtype=np.int64), len(self.floor)
        size = self.at[entry + 1] - self.at[entry]
        take = np.arange(size.sum()) + np.repeat(self.at[entry] - (np.cumsum(size) - size), size)
        cell = np.repeat(np.array(owner, dtype=np.int64), size) * width + self.language[take]
        return np.bincount(cell, self.more[take] * np.repeat(weight, size), n * width).reshape(n, width)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    words: LogFrequencies
    grams: LogFrequencies


def training_sample(docs: DataFrame) -> DataFrame:
    """About SAMPLE_ROWS rows of each language, chosen by hash of the id.

    The share to keep comes from a count per language, so no language is ever
    gathered in one task. The counts are broadcast if they are few; then texts
    are not shuffled by language.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    counts = stored(known.groupBy("lang").agg(F.count("*").alias("rows")))
    share = F.least(F.lit(1.0), F.lit(float(SAMPLE_ROWS)) / F.col("rows"))
    shares = counts.select("lang", share.alias("share"))
    kept = known.join(F.broadcast(shares) if counts.count() <= MOST_BROADCAST else shares, "lang")
    return kept.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < F.col("share") * 1_000_000)


def _top(counts: DataFrame, column: str, most: int) -> DataFrame:
    """The most frequent entries of each language, at most ``most``."""
    order = Window.partitionBy("lang").orderBy(F.desc("n"), column)
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("rank")


def word_counts(sample: DataFrame) -> DataFrame:
    words = F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")
    return sample.select("lang", words).where("word != ''").groupBy("lang", "word").agg(F.count("*").alias("n"))


def gram_counts(words: DataFrame) -> DataFrame:
    """n-grams of 1 to LONGEST_GRAM characters of `` word ``, weighted by count."""
    padded = F.concat(F.lit(" "), "word", F.lit(" "))
    grams = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.lit(LONGEST_GRAM)),
            lambda n: F.transform(
                F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1))),
                lambda i: F.substring(padded, i, n),
            ),
        )
    )
    return words.select("lang", "n", F.explode(grams).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _frequencies(rows: pa.Table, languages: list[str]) -> LogFrequencies:
    """From (lang, entry, n) rows."""
    rows = rows.rename_columns(["lang", "entry", "n"]).sort_by([("entry", "ascending"), ("lang", "ascending")])
    entries = rows.column("entry").combine_chunks().dictionary_encode()
    place = {x: k for k, x in enumerate(languages)}
    language = np.array([place[x] for x in rows.column("lang").to_pylist()], dtype=np.int32)
    n = rows.column("n").to_numpy().astype(float)
    total = np.bincount(language, n, len(languages)) + 0.5 * len(entries.dictionary)
    at = np.searchsorted(entries.indices.to_numpy(), np.arange(len(entries.dictionary) + 1))
    index = {x: k for k, x in enumerate(entries.dictionary.to_pylist())}
    return LogFrequencies(index, at, language, np.log(2 * n + 1), np.log(0.5 / np.maximum(total, 0.5)))


def train_language_model(docs: DataFrame) -> LanguageModel:
    """Learn from every (text, lang) row given, within the documented bounds."""
    counts = stored(word_counts(training_sample(docs)))
    languages = sorted(r[0] for r in counts.select("lang").distinct().collect())
    share = ENTRIES // (2 * max(1, len(languages)))
    words = _top(counts.where(F.col("n") >= MIN_TIMES), "word", min(WORDS, share)).select("lang", "word", "n")
    grams = _top(gram_counts(counts), "gram", min(GRAMS, share)).select("lang", "gram", "n")
    return LanguageModel(tuple(languages), *(_frequencies(x.toArrow(), languages) for x in (words, grams)))


#: Bytes that words are made of; other scripts are looked at character by character.
_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


class _Scorer:
    """Applies a model to texts, remembering the scores of runs of letters."""

    def __init__(self, model: LanguageModel) -> None:
        self.model, self.n = model, len(model.languages)
        self.most = max(1000, REMEMBERED // (8 * max(1, self.n)))
        self._forget()

    def _forget(self) -> None:
        self.held: dict[bytes, int] = {}
        self.scores, self.n_words = np.zeros((0, self.n)), np.zeros(0, dtype=np.int64)

    def _fallback(self, word: str) -> list[int]:
        """The longest known n-gram that ends at each character."""
        padded, known, out = f" {word} ", self.model.grams.index, []
        for end in range(2, len(padded) + 1):
            for start in range(max(0, end - LONGEST_GRAM), end):
                entry = known.get(padded[start:end])
                if entry is not None:
                    out.append(entry)
                    break
        return out

    def _learn(self, runs: list[bytes]) -> None:
        """Summed scores and number of the words in new runs of letters."""
        known = self.model.words
        words: tuple[list, list] = ([], [])
        grams: tuple[list, list, list] = ([], [], [])
        count = np.zeros((3, len(runs)), dtype=np.int64)  # words, known ones, those with an n-gram
        for k, run in enumerate(runs):
            for word in _WORD.findall(run.decode("utf-8", "replace").lower()):
                if not any(map(str.isalpha, word)):
                    continue
                count[0, k] += 1
                entry = known.index.get(word)
                if entry is not None:
                    words[0].append(k)
                    words[1].append(entry)
                    count[1, k] += 1
                elif found := self._fallback(word):
                    grams[0].extend([k] * len(found))
                    grams[1].extend(found)
                    grams[2].extend([1 / len(found)] * len(found))
                    count[2, k] += 1
            self.held[run] = len(self.held)
        new = known.summed(*words, [1.0] * len(words[0]), len(runs)) + count[1][:, None] * known.floor
        new += self.model.grams.summed(*grams, len(runs)) + count[2][:, None] * self.model.grams.floor
        self.scores = np.concatenate((self.scores, new))
        self.n_words = np.concatenate((self.n_words, count[0]))

    def __call__(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        if not self.n:
            return ["und"] * len(texts), np.zeros(len(texts))
        data, bounds = lay_out(texts)
        inside = _INSIDE[data]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
        start, end = edge[0::2], edge[1::2]
        text = np.searchsorted(bounds, start, side="right") - 1
        _, one, of = np.unique(RangeHasher(data)(start, end), return_index=True, return_inverse=True)
        if len(self.held) > self.most:
            self._forget()
        whole = data.tobytes()
        runs = [whole[a:b] for a, b in zip(start[one].tolist(), end[one].tolist())]
        self._learn([r for r in runs if r not in self.held])
        row = np.array([self.held[r] for r in runs], dtype=np.int64)[of]
        n_words = np.bincount(text, self.n_words[row], len(texts))
        total = np.zeros((len(texts), self.n))
        for k in range(self.n):
            total[:, k] = np.bincount(text, self.scores[row, k], len(texts))
        best = total.argmax(axis=1)
        posterior = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        known = n_words > 0
        names = [self.model.languages[k] if yes else "und" for k, yes in zip(best.tolist(), known.tolist())]
        return names, np.where(known, posterior, 0.0)


def predict_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score) for each whole text; the text alone is read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for batch in slices(batches, "text"):
            langs, scores = scorer(as_bytes(batch.column("text")))
            columns = [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"])

    schema = docs.select("doc_id", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return docs.select("doc_id", "text").mapInArrow(predict, schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id")) == 2
    model = train_language_model(docs.where(~held_out))
    return predict_language(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
