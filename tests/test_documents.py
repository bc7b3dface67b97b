"""Names, lines, manifests and files."""

from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import documents as D
from sparkloom.sources import sinks as K
from sparkloom.sources.listing import read_named_texts
from sparkloom.sources.tables import list_files, random_ints, read_line_counts


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


def test_escapes(spark):
    assert one(spark, "a_b&c", T.latex_escape) == r"a\_ b&c"
    assert one(spark, "50%", T.latex_escape) == r"50\% "
    assert one(spark, "a\\b", T.latex_escape) == "a\\textasciibackslash b"
    assert one(spark, "a_b&c~", lambda c: T.latex_escape(c, "all")) == r"a\_b\&c\textasciitilde{}"
    assert one(spark, "5°", lambda c: T.latex_escape(c, "v3")) == r"5\°"


def test_first_occurrence_only(spark):
    assert one(spark, "a_S001_S001.png", lambda c: T.replace_first(c, "S001", "S002")) == "a_S002_S001.png"
    assert one(spark, "abc.png", lambda c: T.replace_first(c, "S001", "S002")) == "abc.png"


def test_first_marked_line(spark):
    text = "x\nStudy No : 17\nStudy No : 18"
    assert one(spark, text, lambda c: T.first_marked(c, "Study No", 11)) == "17"
    assert one(spark, "none", lambda c: T.first_marked(c, "Study No", 11)) is None


def test_modes(spark):
    assert [one(spark, m, T.mode_index) for m, _ in T.MODES] == [[], [1], [2], [1, 2]]
    assert one(spark, "other", T.mode_index) is None


def test_odd_line_has_no_description(spark):
    lines = spark.createDataFrame([(1, i, c) for i, c in enumerate("abc")], "doc_id int, pos int, line string")
    assert sorted(tuple(r) for r in D.pair_lines(lines).collect()) == [(1, 0, "a", "b"), (1, 1, "c", None)]


def test_items_of_a_block(spark):
    rows = [(1, i, s) for i, s in enumerate(["x=0", "K:", "a=1", "skip", "b=2", "L:", "M:"])]
    out = D.itemize(spark.createDataFrame(rows, "doc_id int, pos int, line string")).orderBy("block").collect()
    assert [(r["heading"], r["items"].count("\\item")) for r in out] == [(None, 1), ("K:", 2), ("L:", 0), ("M:", 0)]


def test_line_files(spark, tmp_path):
    (tmp_path / "north.txt").write_text(" 1\n2 \n\n5\n")
    (tmp_path / "south.txt").write_text("3\nx\n")
    rows = sorted(tuple(r) for r in read_line_counts(spark, str(tmp_path)).collect())
    assert rows == [("north", 0, 1), ("north", 1, 2), ("north", 3, 5), ("south", 0, 3), ("south", 1, None)]


def test_directory_walk(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a").write_text("12")
    (tmp_path / "sub" / "b").write_text("123")
    assert [r["length"] for r in list_files(spark, str(tmp_path)).collect()] == [2]
    assert sorted(r["length"] for r in list_files(spark, str(tmp_path), recursive=True).collect()) == [2, 3]


def test_sinks(spark, tmp_path):
    gaps = spark.createDataFrame([(5, "a", "outlier"), (6, "b", "normal")], "gap_us long, path string, gap_class string")
    K.write_outlier_log(gaps, str(tmp_path / "log"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "log")).collect()] == ["5, a"]
    K.write_specs(spark.createDataFrame([("d", ["*.png"])], "InputDirectory string, InputFileNames array<string>"), str(tmp_path / "spec"), F.lit("sub/job"))
    assert '"InputDirectory" : "d"' in (tmp_path / "spec/sub/job.json").read_text()
    K.write_tex(spark.createDataFrame([(3, "a\nb"), (4, "")], "doc_id long, tex string"), str(tmp_path / "tex"))
    assert (tmp_path / "tex/3.tex").read_text() == "a\nb" and (tmp_path / "tex/4.tex").read_text() == ""
    lines = spark.createDataFrame([("k", t, 10 * t, f"p{t}", "outlier") for t in range(50)] + [("q", 1, 2, "x", "normal")], "key string, t int, gap_us long, path string, gap_class string")
    K.write_outlier_logs(lines.repartition(4), str(tmp_path / "logs"), "key", ["t"])
    assert (tmp_path / "logs/k.log").read_text() == "".join(f"{10 * t}, p{t}\n" for t in range(50)) and not (tmp_path / "logs/q.log").exists()
    named = {r["name"]: r["content"] for r in read_named_texts(spark, str(tmp_path / "tex")).collect()}
    assert named == {"3.tex": "a\nb", "4.tex": ""}
    files = spark.createDataFrame([("x/a_1", None), ("x/b_1", "K")], "path string, key string")
    assert [tuple(r) for r in K.keyed_copy_manifest(files, "key", "out").collect()] == [("x/b_1", "out/K__b_1")]
    assert K.unmatched(files, "key").count() == 1
    assert {r["collides"] for r in K.rename_manifest(files, F.lit("same")).collect()} == {True}


def test_random_bounds(spark):
    values = {r["value"] for r in random_ints(spark, 400, 3, 5, seed=1).collect()}
    assert values == {3, 4, 5}
