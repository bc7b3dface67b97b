"""Quality rules: a linear-chain CRF marks each line as content or boilerplate.

The chain is trained here by maximum likelihood (forward-backward, numpy) on a
bounded sample of labelled documents: at most TRAINING_TEXTS of each class, and
TRAINING_LINES evenly spread lines of a longer one. Labels mark documents, not
lines, so the states of lines are latent. Lines of good documents are content; of
bad ones all lines count as boilerplate at first, and then in each round the lines
that the chain so far decodes as content change sides, as long as a share of
BAD_SHARE of the words stays boilerplate (the least content-like lines). So the
chain learns what tells lines apart, and how often the state changes within a
text. Viterbi decoding of a whole text then gives the state of each line, and the
share of words in content lines decides: the least share that keeps a text is
where good and bad documents of the sample are best told apart, MIN_CONTENT at
least.

Base quantities, of every whole text (words are ``[^\\x20\\x09-\\x0D]+``):
word_chars, n_symbols, n_dup_lines, n_repeat_words; a text fails the base when
it has under 50 words or over half of its words repeat in 3-word windows.

Defined results: a null text has no words, fails the base and is not kept; a
line without a word is not part of the chain; repeated rows are judged alike;
without labelled rows of both classes every line is content; a line whose two
states score the same is content. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, clean_labels, fold, slices, table
from .quality_classifier import labelled_sample

MIN_WORDS = 50
#: Share of the words that content lines must hold at least for a text to stay.
MIN_CONTENT = 0.5
#: Share of a bad training text's words that stay boilerplate.
BAD_SHARE = 0.3
#: Labelled texts of each class that the chain is fitted on, and rounds of it.
TRAINING_TEXTS = 1500
ROUNDS = 4
#: Lines of one document that training looks at (evenly spread over it).
TRAINING_LINES = 200

#: The symbols that n_symbols counts.
SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_ENDS = (b".", b"!", b"?", b":", b";", b'"', b")")
N_FEATURES = 13


def repeated_words(words: list[bytes]) -> int:
    """Words covered by a 3-word window that occurs at least twice."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    windows = pairs[:-1] * len(number) + ids[2:]
    _, at, count = np.unique(windows, return_inverse=True, return_counts=True)
    twice = count[at] > 1
    covered = np.zeros(n, dtype=bool)
    for j in range(3):
        covered[j : j + n - 2] |= twice
    return int(covered.sum())


def line_features(lines: list[tuple[bytes, list[bytes], bool]]) -> np.ndarray:
    """One row of features for each line of a text: (bytes, words, repeated)."""
    out = np.zeros((len(lines), N_FEATURES))
    repeats = {line for line, _, again in lines if again}
    for row, (line, words, again) in zip(out, lines):
        size, n = len(line), len(words)
        symbols = size - len(line.translate(None, SYMBOLS))
        upper = size - len(line.translate(None, _UPPER))
        digits = size - len(line.translate(None, _DIGITS))
        distinct = len(set(words))
        row[:] = (
            1.0,
            min(1.0, 4 * symbols / size),
            symbols > 0,
            upper / size,
            upper > size / 2,
            min(1.0, 4 * digits / size),
            min(1.0, line.count(b"!!") / n),
            line.endswith(_ENDS),
            n < 4,
            distinct / n,
            n >= 10 and 2 * distinct < n,
            again,
            line in repeats,
        )
    return out


@dataclass(frozen=True)
class LineModel:
    """Weights of state 1 (content) against state 0, transition scores, and the
    share of words in content lines from which a text stays."""

    unary: np.ndarray
    transition: np.ndarray
    min_content: float = MIN_CONTENT


@dataclass
class Chain:
    """The lines of a training text: features, words, states; its label."""

    features: np.ndarray
    words: np.ndarray
    label: int
    states: np.ndarray


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


class _Padded:
    """Chains of similar length side by side, each with its class's weight."""

    def __init__(self, chains: list[Chain], weight: list[float]) -> None:
        longest = max(len(c.features) for c in chains)
        self.features = np.zeros((len(chains), longest, N_FEATURES))
        self.there = np.zeros((len(chains), longest), dtype=bool)
        self.states = np.zeros((len(chains), longest))
        self.weight = np.array([weight[c.label] for c in chains])
        self.pairs = np.zeros((2, 2))  # weighted state changes that are wanted
        for k, c in enumerate(chains):
            n = len(c.features)
            self.features[k, :n], self.there[k, :n], self.states[k, :n] = c.features, True, c.states
            np.add.at(self.pairs, (c.states[:-1], c.states[1:]), self.weight[k])

    def gradient(self, unary: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        content, pairs = _marginals(self.features @ unary, self.there, transition)
        off = np.where(self.there, self.states - content, 0.0) * self.weight[:, None]
        return np.einsum("kl,klf->f", off, self.features), self.pairs - np.einsum("k,kij->ij", self.weight, pairs)


def _marginals(content: np.ndarray, there: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over all chains at once: the chance of the content
    state on each line, and summed pair marginals of each chain (2, 2)."""
    scores = np.stack([np.zeros_like(content), content], axis=2)
    left, right = scores.copy(), np.zeros_like(scores)
    for i in range(1, scores.shape[1]):
        step = scores[:, i] + _log_sum(left[:, i - 1, :, None] + transition, 1)
        left[:, i] = np.where(there[:, i, None], step, left[:, i - 1])
    for i in range(scores.shape[1] - 2, -1, -1):
        step = _log_sum(transition + (scores[:, i + 1] + right[:, i + 1])[:, None, :], 2)
        right[:, i] = np.where(there[:, i + 1, None], step, 0.0)
    total = _log_sum(left[:, -1], 1)
    later = (scores + right)[:, 1:, None, :]
    pairs = left[:, :-1, :, None] + transition + later - total[:, None, None, None]
    pairs = np.where(there[:, 1:, None, None], np.exp(np.minimum(pairs, 0.0)), 0.0)
    return np.exp(np.minimum(left + right - total[:, None, None], 0.0))[:, :, 1], pairs.sum(axis=1)


def _climb(chains: list[Chain], start: LineModel, steps: int, linked: bool, rate: float = 0.5) -> LineModel:
    """Maximise the likelihood of the states of the chains, from ``start``.

    Each class weighs the same, whatever its number of lines; gradients are
    scaled by their running size. Unless ``linked``, lines stand alone.
    """
    lines = [sum(len(c.features) for c in chains if c.label == k) for k in (0, 1)]
    weight = [0.5 / n for n in lines]
    by_length: dict[int, list[Chain]] = {}
    for c in chains:
        by_length.setdefault(len(c.features).bit_length() // 2, []).append(c)
    groups = [_Padded(g, weight) for g in by_length.values()]
    unary, transition = start.unary.copy(), start.transition.copy()
    seen_u, seen_t = np.full(N_FEATURES, 1e-8), np.full((2, 2), 1e-8)
    for _ in range(steps):
        grad_u, grad_t = (sum(g) for g in zip(*(g.gradient(unary, transition) for g in groups)))
        grad_u, grad_t = grad_u - 1e-3 * unary, grad_t - 1e-3 * transition
        seen_u += grad_u**2
        seen_t += grad_t**2
        unary += rate * grad_u / np.sqrt(seen_u)
        if linked:
            transition += 0.3 * rate * grad_t / np.sqrt(seen_t)
    return LineModel(unary, transition)


def _relabel(chain: Chain, model: LineModel) -> None:
    """States of a bad text: what the model decodes, but at least BAD_SHARE of
    its words in boilerplate."""
    states = viterbi(model, chain.features)
    short = BAD_SHARE * chain.words.sum() - chain.words[states == 0].sum()
    for line in np.argsort(chain.features @ model.unary, kind="stable").tolist():
        if short <= 0:
            break
        if states[line]:
            states[line] = 0
            short -= chain.words[line]
    chain.states = states


def _share(chain: Chain, model: LineModel) -> float:
    return float(chain.words[viterbi(model, chain.features) == 1].sum() / chain.words.sum())


def fit_line_model(chains: list[Chain], steps: int = 60) -> LineModel:
    """Weights from chains with the labels of their documents."""
    model = LineModel(np.eye(1, N_FEATURES).ravel(), np.zeros((2, 2)))
    if {c.label for c in chains} != {0, 1}:
        return model
    model = LineModel(np.zeros(N_FEATURES), np.zeros((2, 2)))
    for k in range(ROUNDS):
        for c in chains:
            if c.label or not k:
                c.states = np.full(len(c.features), c.label)
            else:
                _relabel(c, model)
        model = _climb(chains, model, steps, linked=k > 0)
    shares = [np.sort([_share(c, model) for c in chains if c.label == k]) for k in (0, 1)]
    tried = np.linspace(MIN_CONTENT, 0.95, 10)
    right = [np.searchsorted(shares[0], t) / len(shares[0]) - np.searchsorted(shares[1], t) / len(shares[1]) for t in tried]
    return LineModel(model.unary, model.transition, float(tried[int(np.argmax(right))]))


def viterbi(model: LineModel, features: np.ndarray) -> np.ndarray:
    """The likeliest states of the lines of one text (1: content)."""
    content = (features @ model.unary).tolist()
    (t00, t01), (t10, t11) = model.transition.tolist()
    bad, good, back = 0.0, content[0], []
    for score in content[1:]:
        from_bad = (bad + t00 >= good + t10, bad + t01 > good + t11)
        back.append(from_bad)
        bad, good = max(bad + t00, good + t10), score + max(bad + t01, good + t11)
    state = 1 if good >= bad else 0
    path = [state]
    for from_bad in reversed(back):
        state = 0 if from_bad[state] else 1
        path.append(state)
    return np.array(path[::-1])


def split_lines(text: bytes) -> list[tuple[bytes, list[bytes], bool]]:
    """The lines with a word, their words, and whether an earlier line is equal."""
    seen: set[bytes] = set()
    out = []
    for line in text.split(b"\n"):
        words = line.split()
        if words:
            out.append((line, words, line in seen))
            seen.add(line)
    return out


def judge(text: bytes, model: LineModel) -> tuple:
    """n_words, the four base quantities, base_failed, content share, kept."""
    lines = split_lines(text)
    words = [w for _, ws, _ in lines for w in ws]
    n = len(words)
    spaces = sum(text.count(c) for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    repeats = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeats > 50 * n
    share = 0.0
    if lines:
        content = viterbi(model, line_features(lines))
        share = sum(len(ws) for (_, ws, _), state in zip(lines, content) if state) / n
    duplicates = sum(again for _, _, again in lines)
    kept = not failed and share >= model.min_content
    return n, _code_points(text) - spaces, symbols, duplicates, repeats, failed, share, kept


#: The bytes that continue a UTF-8 character.
_CONTINUATION = bytes(range(0x80, 0xC0))


def _code_points(text: bytes) -> int:
    return len(text.translate(None, _CONTINUATION))


_SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " base_failed boolean, content_share double, kept boolean"
)


def chain_of(text: bytes, label: int) -> Chain | None:
    """A training text's chain; None without words."""
    lines = split_lines(text)
    features = line_features(lines)
    step = max(1, -(-len(lines) // TRAINING_LINES))
    features, words = features[::step], np.array([len(ws) for _, ws, _ in lines[::step]])
    return Chain(features, words, label, np.full(len(words), label)) if len(words) else None


def train_line_model(docs: DataFrame, labels: DataFrame) -> LineModel:
    """Fit on a bounded labelled sample (see above)."""
    sample = labelled_sample(docs, labels, TRAINING_TEXTS)
    found = [chain_of(text, label) for label, texts in sample.items() for text in texts]
    return fit_line_model([c for c in found if c is not None])


def judge_lines(docs: DataFrame, model: LineModel) -> DataFrame:
    """doc_id, the base quantities, content_share and ``kept`` of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a dozen numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches, "text"):
            found = zip(*[judge(t, own) for t in as_bytes(batch.column("text"))])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, t.type) for x, t in zip(found, list(arrow)[1:]))], arrow.names
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    arrow = pa.schema(
        [("doc_id", pa.int64())]
        + [(x, pa.int64()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        + [("base_failed", pa.bool_()), ("content_share", pa.float64()), ("kept", pa.bool_())]
    )
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {_SCHEMA}")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_labels(table(spark, sf_dir, "labels"), "quality").where(fold(F.col("doc_id")) != 2)


def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge_lines(docs, train_line_model(docs, _labels(spark, sf_dir)))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep; a row is matched to its own verdict by id."""
    model = train_line_model(table(spark, sf_dir, "documents"), _labels(spark, sf_dir))
    shared = spark.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield batch.filter(pa.array([judge(t, shared.value)[-1] for t in as_bytes(batch.column("text"))]))

    return docs.mapInArrow(keep, docs.schema)
