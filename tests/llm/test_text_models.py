"""Classifier, language and line models: held-out accuracy and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import language_id as L
from sparkloom.llm import line_quality as C
from sparkloom.llm import quality_classifier as Q

SF = "/root/testdata/sf0.01"


def auc(y, s):
    good, bad = s[y == 1], s[y == 0]
    return ((good[:, None] > bad[None, :]) + 0.5 * (good[:, None] == bad[None, :])).mean()


def test_quality_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    found = Q.op1_quality_classifier(spark, SF)
    assert found.count() == 1000
    rows = found.where("held_out").join(labels, "doc_id").toPandas()
    assert auc(rows.quality.to_numpy(), rows.score.to_numpy()) > 0.95
    assert rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.7)).all()


def test_quality_edges(spark, frame):
    docs = frame([(1, None), (2, ""), (3, "a b"), (3, "a b"), (4, "x" * 200_000)])
    labels = spark.createDataFrame([], "doc_id long, label int")
    model = Q.train_quality_model(docs, labels)
    scores = [r["score"] for r in Q.score_quality(docs, model).collect()]
    assert len(scores) == 5 and all(0 <= s <= 1 for s in scores)
    assert Q.score_quality(docs.limit(0), model).count() == 0


def test_contradictory_labels_are_left_out(spark):
    from sparkloom.llm.common import clean_labels

    rows = [(1, 1), (1, 1), (2, 0), (2, 1), (3, None), (None, 1)]
    out = clean_labels(spark.createDataFrame(rows, "doc_id long, quality int"), "quality").collect()
    assert [tuple(r) for r in out] == [(1, 1)]


def test_language_on_held_out_rows(spark):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = L.op2_language_id(spark, SF).where("held_out").join(truth, "doc_id")
    assert rows.where("lang = lang_pred").count() >= 0.99 * rows.count()


def test_language_edges(spark, frame):
    docs = frame([(1, "the cat sat on the mat the cat"), (2, "le chat est sur le tapis le chat")])
    docs = docs.withColumn("lang", F.when(F.col("doc_id") == 1, "en").otherwise("fr"))
    model = L.train_language_model(docs)
    ask = frame([(1, None), (2, ""), (3, "12 ½ !"), (4, "the the"), (5, "tapiserie"), (5, "tapiserie")])
    got = [(r["lang_pred"], r["score"]) for r in L.predict_language(ask, model).orderBy("doc_id").collect()]
    assert [x for x, _ in got] == ["und", "und", "und", "en", "fr", "fr"]
    assert all(0 <= s <= 1 for _, s in got)
    nothing = L.train_language_model(docs.limit(0))
    assert {r["lang_pred"] for r in L.predict_language(ask, nothing).collect()} == {"und"}


def base(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(inside)


def test_base_quantities(spark, frame):
    texts = [None, "", " \n\t", "é à b #x", "a b c a b c a b", "l\nl\n\nl\n m", "x" * 90_000, "w " * 60, " ".join(f"w{i}" for i in range(60))]
    docs = frame(list(enumerate(texts)))
    model = C.fit_line_model([])
    rows = C.judge_lines(docs, model).orderBy("doc_id").collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert [tuple(r[n] for n in names) for r in rows] == [base(t) for t in texts]
    assert [r["kept"] for r in rows] == [False] * 8 + [True]


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 8):
        model = C.LineModel(rng.normal(size=C.N_FEATURES), rng.normal(size=(2, 2)))
        features = rng.normal(size=(n, C.N_FEATURES))
        content = features @ model.unary

        def total(path):
            return sum(content[i] for i in range(n) if path[i]) + sum(model.transition[a, b] for a, b in zip(path, path[1:]))

        paths = [[k >> i & 1 for i in range(n)] for k in range(1 << n)]
        assert total(C.viterbi(model, features).tolist()) == pytest.approx(max(map(total, paths)))


def test_lines_separate_labelled_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    rows = C.op3_line_quality(spark, SF).where("not base_failed").join(labels, "doc_id")
    assert rows.where("(quality = 1) = kept").count() >= 0.97 * rows.count()


def test_lines_within_a_text_are_told_apart(spark):
    """Boilerplate planted in good prose, at the start, in the middle, at the end."""
    import random

    from sparkloom.llm.common import clean_labels, table

    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = C.train_line_model(docs, clean_labels(labels, "quality"))
    rows = docs.join(labels, "doc_id").where("text is not null").orderBy("doc_id").collect()
    long = lambda r: [x for x in r["text"].split("\n") if len(x.split()) > 3]
    noise = [x for r in rows if not r["quality"] for x in long(r) if any(s in x for s in ("!!", "***", " | "))]
    rng, hit, wrong, inside, n = random.Random(5), 0, 0, 0, 0
    for good in (long(r) for r in rows if r["quality"]):
        if len(good) < 6:
            continue
        block = [rng.choice(noise) for _ in range(rng.randrange(2, 4))]
        at = rng.choice([0, len(good) // 2, len(good)])
        lines = C.split_lines("\n".join(good[:at] + block + good[at:]).encode())
        truth = np.array([1] * at + [0] * len(block) + [1] * (len(good) - at))
        states = C.viterbi(model, C.line_features(lines))
        hit += int(((states == 0) & (truth == 0)).sum())
        wrong += int((states != truth).sum())
        inside += 0 < states.mean() < 1
        n += 1
    assert n > 20 and 2 * hit / (2 * hit + wrong) >= 0.9 and inside >= 0.9 * n


def test_sparse_language_model_equals_the_dense_one(spark, frame):
    """Scores against a plain dictionary of smoothed log frequencies."""
    import math
    import re

    texts = {"en": "the cat the dog the cat dog", "fr": "le chat le chien le chat chien", "de": "der hund der hund katze katze"}
    docs = frame(list(enumerate(texts.values()))).withColumn("lang", F.element_at(F.array(*map(F.lit, texts)), (F.col("doc_id") + 1).cast("int")))
    model = L.train_language_model(docs)
    counts = {l: {w: t.split().count(w) for w in set(t.split()) if t.split().count(w) >= L.MIN_TIMES} for l, t in texts.items()}
    entries = {w for c in counts.values() for w in c}
    for text in ("the the le", "chat hund"):
        total = {
            l: sum(math.log((c.get(w, 0) + 0.5) / (sum(c.values()) + 0.5 * len(entries))) for w in re.findall(r"\w+", text))
            for l, c in counts.items()
        }
        best = max(sorted(total), key=total.get)
        want = 1 / sum(math.exp(x - total[best]) for x in total.values())
        row = L.predict_language(frame([(1, text)]), model).first()
        assert row["lang_pred"] == best and row["score"] == pytest.approx(want)


def test_labels_of_one_class(spark, frame):
    docs = frame([(i, f"text number {i} of some words") for i in range(8)])
    labels = spark.createDataFrame([(i, 1) for i in range(8)], "doc_id long, label int")
    scores = {r["score"] for r in Q.score_quality(docs, Q.train_quality_model(docs, labels)).collect()}
    assert all(s > 0.5 for s in scores)
    assert Q.score_quality(docs, Q.train_quality_model(docs, labels)).count() == 8
