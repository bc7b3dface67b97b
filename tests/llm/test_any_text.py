"""Every corpus query and stage on texts, ids and columns of any kind."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from sparkloom.llm import queries as Q
from sparkloom.llm.common import stored

PROSE = " ".join(f"word{i % 97} is near word{i % 89}." for i in range(60))
TEXTS = [
    None, "", " ", "\n\n", "a", PROSE, PROSE, PROSE + " End.",
    " " * 1_000_000, "x" * 1_000_000, "x@" + "a." * 100_000 + "com", "password=" + "aZ9😀" * 20_000,
    "<|endoftext|> " + PROSE, " é 日本語 \x1c\x00 ½", "1 " * 100_000, "DE89 " * 1000, "!!\n" * 2000,
]
CLASHING = ["hash", "id", "text_key", "pii_found", "pii_new", "row", "rank", "before", "label", "stays", "own_id", "n_replaced"]
BIG = 1 << 60


def tables(spark, folder, kind, texts):
    ids = [None, None, None, *(BIG + i for i in range(len(texts)))][: len(texts)]
    ids[6] = ids[5]  # the same row twice
    made = [(None if i is None else i if kind == "long" else f"id{i}", t) for i, t in zip(ids, texts)]
    columns = ", ".join(f"`{c}` string" for c in CLASHING)
    schema = f"doc_id {kind}, text string, lang string, source string, n_chars long, {columns}"
    docs = spark.createDataFrame([(i, t, "en", "s", 1, *["x"] * len(CLASHING)) for i, t in made], schema)
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, k % 2, 0) for k, (i, _) in enumerate(made)]
    spark.createDataFrame(labels, f"doc_id {kind}, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(1, "word1 is near word2"), (None, "1 1 1 1 1 1 1 1 1 1 1 1"), (2, None), (3, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    pages = [(i, "http://a b", t) for i, t in made]
    spark.createDataFrame(pages, f"page_id {kind}, url string, html string").repartition(3).write.parquet(f"{folder}/pages.parquet")
    vectors = [(i, [float(k + c) for c in range(64)]) for k, (i, _) in enumerate(made)]
    spark.createDataFrame(vectors, f"vec_id {kind}, embedding array<float>").repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    return {
        "long": tables(spark, tmp_path_factory.mktemp("long"), "long", TEXTS),
        "string": tables(spark, tmp_path_factory.mktemp("string"), "string", TEXTS[:8] + TEXTS[12:14]),
        "empty": tables(spark, tmp_path_factory.mktemp("empty"), "long", TEXTS[:8]),
    }


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query(spark, folders, name):
    for kind in ("long", "string"):
        docs = spark.read.parquet(f"{folders[kind]}/documents.parquet")
        rows = Q.QUERIES[name](spark, folders[kind])
        if name == "op4_sequence_packing":
            rows = rows.where("start = 0")
        elif name == "op10_token_output":
            rows = rows.select(F.inline(F.arrays_zip("doc_ids", "starts"))).where("starts = 0")
        own = next(c for c in ("doc_id", "doc_ids", "page_id", "vec_id") if c in rows.columns)
        assert Counter(r[0] for r in rows.select(own).collect()) == Counter(r[0] for r in docs.select("doc_id").collect())


@pytest.mark.parametrize("name, stage", C.STAGES)
def test_stage(spark, folders, name, stage):
    for kind in ("long", "string"):
        docs = spark.read.parquet(f"{folders[kind]}/documents.parquet")
        out = stored(stage(spark, docs, folders[kind]))
        if name != C.STAGES[-1][0]:
            assert out.columns == docs.columns
            left = Counter(r[0] for r in out.select("doc_id").collect())
            assert not left - Counter(r[0] for r in docs.select("doc_id").collect())


def test_no_rows(spark, folders):
    empty = spark.read.parquet(f"{folders['empty']}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, empty, folders["empty"]).count() == 0


def test_equal_text_under_ids_beyond_double_precision(spark, frame):
    from sparkloom.llm import repeat_removal as R

    text = " ".join(f"t{i}" for i in range(90))
    rows = [(BIG, text), (BIG + 1, text), (None, "something else " * 20)]
    removed = {r["doc_id"]: r["n_removed"] for r in R.remove_repeats(frame(rows).repartition(1)).collect()}
    assert removed[BIG] == 0 and removed[BIG + 1] == len(text)
