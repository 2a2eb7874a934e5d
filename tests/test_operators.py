import collections
import datetime
import math
import random
import re
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.operators import context as X
from folioflow.operators import evaluate as E
from folioflow.operators import forward
from folioflow.operators import glossary as G
from folioflow.operators import index as I
from folioflow.operators import inverted as KW
from folioflow.operators.encode import HashEncoder, SeededEncoder, encode_column
from folioflow.operators.fusion import fuse
from folioflow.operators.keyword import search_keyword
from folioflow.operators.numbering import numbered, running_totals
from folioflow.operators.patterns import occurrences
from folioflow.operators.sieve import sifted
from folioflow.operators.vector import topk, visits
from folioflow.plans import search as P
from folioflow.sources import corpus
from folioflow.streaming import changes as ST

V = "query_id long, rank int, doc_id long, path string, full_path string, title string, score double, hit_text string"
K = "query_id long, rank int, file_id long, full_path string, target_path string, file_name string, snippet string, utility_score double, click_count double"


def hits(spark, rows):
    return spark.createDataFrame([(1, r, i, p, f"/v/{p}", p, s, "t") for r, i, p, s in rows], V)


def words(spark, rows):
    return spark.createDataFrame([(1, r, i, f"/v/{p}" if p else None, "/v" if p else None, p, "snip", u, None) for r, i, p, u in rows], K)


def test_rrf_and_weights(spark):
    v, k = hits(spark, [(1, 1, "a.md", 0.9), (2, 2, "B.md", 0.8)]), words(spark, [(1, 7, "b.md", 5.0), (2, 8, "c.md", None)])
    got = {r["path"]: r for r in fuse(v, k).collect()}
    assert [got[p]["hybrid_score"] for p in ("B.md", "a.md", "c.md")] == pytest.approx([0.016261, 0.008197, 0.008065])
    assert [got[p]["match_type"] for p in ("B.md", "a.md", "c.md")] == ["both", "vector_only", "keyword_only"] and got["B.md"]["rank"] == 1
    got = {r["path"]: r for r in fuse(v, k, method="weighted", vector_weight=0.6, keyword_weight=0.4).collect()}
    assert got["B.md"]["hybrid_score"] == pytest.approx(0.88)


@pytest.mark.parametrize("dedup,rank", [("last", 3), ("best", 1)])
def test_duplicate_keys(spark, dedup, rank):
    v = hits(spark, [(1, 1, "a.md", 0.9), (2, 2, "b.md", 0.8), (3, 3, "a.md", 0.7)])
    got = {r["path"]: r["vector_rank"] for r in fuse(v, words(spark, [(1, 1, None, 1.0)]), dedup=dedup).collect()}
    assert got == {"a.md": rank, "b.md": 2}


def test_hybrid_without_keyword_hits(spark):
    v = hits(spark, [(1, 1, "a.md", 0.9), (2, 2, "b.md", 0.8)])
    out = P.search_hybrid(v.select("query_id").distinct(), v, words(spark, [(1, 1, "x", 1.0)]).filter("false")).orderBy("rank").collect()
    assert [(r["path"], r["hybrid_score"], r["match_type"]) for r in out] == [("a.md", 0.9, "vector_only"), ("b.md", 0.8, "vector_only")]


def test_topk(spark):
    rows = [(i, [1.0 if j == i % 4 else 0.1 for j in range(4)]) for i in range(9)] + [(20, None), (21, [1.0])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = e.filter("vec_id < 2").select(F.col("vec_id").alias("query_id"), "embedding")
    out = [(r["query_id"], r["vec_id"], r["rank"]) for r in topk(q, e, 3).orderBy("query_id", "rank").collect()]
    assert out == [(0, 0, 1), (0, 4, 2), (0, 8, 3), (1, 1, 1), (1, 5, 2), (1, 0, 3)]
    assert topk(q, e.filter("false"), 3).count() == 0 and topk(q.filter("false"), e, 3).count() == 0


@pytest.mark.parametrize("kind, share", [("spread", 1.0), ("clusters", 0.5), ("same", 1.0)])
def test_topk_by_bounds(spark, kind, share):
    """The same rows as brute force: of vectors in all directions, in clusters (most leaves are passed over), and of which a third are equal."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(3000, 8))
    v = rng.normal(size=(30, 8))[rng.integers(0, 30, 3000)] * 9 + 0.1 * v if kind == "clusters" else v
    v[::3] = v[0] if kind == "same" else v[::3]
    rows = [(i - 1500, x) for i, x in enumerate(v.tolist())]
    odd = [(5000, None), (5001, [1.0]), (5002, [None] * 8), (5003, [float("nan")] * 8), (5004, [float("inf")] * 8)]
    e = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(3)
    q = e.filter("vec_id % 20 = 0 OR vec_id > 4999").select(F.col("vec_id").alias("query_id"), "embedding")
    got = {}
    for r in topk(q, e, 7, dim=8).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    ids = np.arange(3000) - 1500
    for i, x in rows:
        if i % 20 == 0:
            scores = np.round(v @ np.array(x), 6)
            best = np.lexsort((ids, -scores))[:7]
            assert [got[i][n] for n in range(1, 8)] == [(ids[b], pytest.approx(scores[b], abs=2e-6)) for b in best]
    assert len(got) == 150
    seen = visits(q, e, 7, dim=8).first()
    assert seen["pairs"] > 150 * 30 and seen["seen"] <= share * seen["pairs"]


def test_encoders(spark):
    df = spark.createDataFrame([("same text",), ("same text",), ("",), (None,)], "t string")
    for encoder in (HashEncoder(16), SeededEncoder(16)):
        rows = [r["embedding"] for r in encode_column(df, "t", encoder).collect()]
        assert rows[0] == rows[1] and rows[2] == rows[3] and sum(x * x for x in rows[0]) == pytest.approx(1, abs=1e-5)


def glossary(spark):
    return spark.createDataFrame([(1, "Fluid Bed", ["FB", "fluid-bed"], "a bed"), (2, "Bed", [], ""), (3, "ＡＢＣ炉", ["abc"], "kiln")], "entry_id int, term string, synonyms array<string>, description string")


def test_detect_and_enrich(spark):
    texts = spark.createDataFrame([(1, "the FLUID BED here"), (2, "a fluidbed"), (3, "none"), (4, None)], "id long, text string")
    got = [(r["id"], r["entry_id"], r["place"]) for r in G.detect_terms(texts, glossary(spark), "id", "text").orderBy("id", "place").collect()]
    assert got == [(1, 1, 1), (1, 2, 2), (2, 2, 1), (2, 1, 2)]
    queries = spark.createDataFrame([(1, "FB use"), (2, "nothing")], "query_id long, query string")
    out = {r["query_id"]: r["enriched"] for r in G.enriched_queries(queries, glossary(spark)).collect()}
    assert out == {1: "[関連用語: Fluid Bed => Fluid Bed, fluid-bed, a bed] FB use", 2: "nothing"}


def test_detection_in_parts_is_the_same(spark):
    """Many parts, of which a task holds one at a time; nested and repeated spellings; odd texts; an empty glossary."""
    texts = spark.createDataFrame([(1, "the FLUID BED here"), (2, "a fluidbed, abc"), (3, "none"), (4, None), (5, ""), (6, "bed " * 50_000)], "id long, text string")
    more = glossary(spark).unionByName(spark.createDataFrame([(i, f"e{i}", [f"ee{i}", "bed"], None) for i in range(10, 60)], "entry_id int, term string, synonyms array<string>, description string"))
    rows = lambda **k: sorted(map(tuple, G.detect_terms(texts, more, "id", "text", **k).collect()))
    assert rows(part_size=7) == rows() and len(rows()) == 52 + 53 + 51
    assert G.detect_terms(texts, more.limit(0), "id", "text").count() == 0
    plan = G.detect_terms(texts, more, "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_sieve_finds_what_stands_in_the_texts(spark):
    """Against a search for each spelling: spellings of 2 to 80 characters, of several bytes each, nested, at ends of texts and across them; few
    other stretches pass, and a text is searched once, not once for every thousand spellings."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choices("abé炉😀 ", k=n))
    spelled = sorted({word(n).strip() for n in [*range(2, 81)] * 40 if n > 5 or rng.random() < 0.2} - {""})
    spelled = [w for w in spelled if len(w) >= 2]
    texts = [(i, (word(200) + rng.choice(spelled) + word(i % 3) + rng.choice(spelled)) if i % 7 else rng.choice(["", None, spelled[i], spelled[i][1:]])) for i in range(60)]
    patterns = [(j, 0, w, len(w), side) for j, w in enumerate(spelled) for side in (0, 1)]
    table = spark.createDataFrame(patterns, "entry_id int, place int, pattern string, n int, side int").repartition(3)
    rows = spark.createDataFrame([(i, t, (t or "")[::-1]) for i, t in texts], "key int, low string, norm string").repartition(2)
    want = {(i, j, side) for i, t in texts for side, x in enumerate((t or "", (t or "")[::-1])) for j, w in enumerate(spelled) if w in x}
    got = occurrences(rows, table, 1000).groupBy("key", "entry_id", "by").agg(F.min("n").alias("n")).collect()
    assert len(patterns) > 5000 and {(r["key"], r["entry_id"], r["by"]) for r in got} == want
    assert all(r["n"] == (0 if r["by"] else -len(spelled[r["entry_id"]])) for r in got)
    assert sifted(rows, table).distinct().count() <= 1.05 * len(want)


def test_lookup_ignores_width_and_hyphens(spark):
    asked = spark.createDataFrame([("fluid_bed",), ("abc炉",), ("zzz",)], "word string")
    got = {r["word"]: r["entry_id"] for r in G.find_by_term(asked, glossary(spark), "word").collect()}
    assert got == {"fluid_bed": 1, "abc炉": 3, "zzz": None}


def test_glossary_round_trip(spark, tmp_path):
    G.save_glossary(glossary(spark), str(tmp_path / "g"))
    got = {r["term"]: (r["synonyms"], r["description"]) for r in G.load_glossary(spark, str(tmp_path / "g")).collect()}
    assert got["Fluid Bed"] == (["FB", "fluid-bed"], "a bed") and len(got) == 3
    (tmp_path / "h.csv").write_text('Term,Synonyms,Description\n"A, a1","a2、A",text\n,x,y\n')
    assert [(r["term"], r["synonyms"], r["description"]) for r in G.load_glossary(spark, str(tmp_path / "h.csv")).collect()] == [("A", ["a1", "a2"], "text")]


def test_glossary_numbers_over_files(spark, tmp_path):
    """Ids follow rows over partitions without gaps, and a glossary that was saved in many files keeps them."""
    rows = [(f"t{i}", f"s{i}", f'a "quoted", {i}\nline') for i in range(1000)]
    made = G.parse_glossary(spark.createDataFrame(rows, "term string, synonym string, description string").repartition(7))
    ids = {r["term"]: r["entry_id"] for r in made.collect()}
    assert sorted(ids.values()) == list(range(1, 1001))
    G.save_glossary(made, str(tmp_path / "g"))
    assert list((tmp_path / "g").glob("*.csv"))
    assert {r["term"]: r["entry_id"] for r in G.load_glossary(spark, str(tmp_path / "g")).collect()} == ids
    assert numbered(made.limit(0).drop("entry_id"), "n").count() == 0


def test_scan(spark, tmp_path):
    for name, data in {"a.md": b"# Head\nx", "sub/b.TXT": b"\xff\xfe bad", ".obsidian/c.md": b"x", "d.excalidraw.md": b"x", "node_modules/e.md": b"x", "f.png": b"x"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r["relative_path"]: r["title"] for r in corpus.scan_corpus(spark, str(tmp_path)).collect()}
    assert got == {"a.md": "a - Head", "sub/b.TXT": "b"}
    assert {r["relative_path"] for r in corpus.scan_corpus(spark, str(tmp_path), " MD ; ").collect()} == {"a.md"}
    asked = spark.createDataFrame([("a.md",), ("gone.md",)], "relative_path string")
    assert {r["relative_path"]: r["size"] for r in corpus.scan_files(spark, str(tmp_path), asked).collect()} == {"a.md": 8, "gone.md": None}
    with pytest.raises(Exception):
        corpus.scan_corpus(spark, str(tmp_path / "missing")).count()


def scanned(spark, rows):
    df = spark.createDataFrame([(p, t, datetime.datetime(2024, 1, 1)) for p, t in rows], "path string, content string, mtime timestamp")
    return I.prepared(df)


def test_index_runs(spark, tmp_path):
    where, enc = str(tmp_path / "ix"), HashEncoder(8)
    run = lambda rows, model="m", **kw: I.update_index(scanned(spark, rows), where, model, enc, **kw).first().asDict()
    assert run([("a", "one"), ("b", "two")])["created"] == 2
    assert run([("a", "one!"), ("c", "three")]) == {"total": 2, "created": 1, "updated": 1, "skipped": 0, "deleted": 1}
    assert run([("a", "one!"), ("c", "three")])["skipped"] == 2
    assert {r["path"] for r in I.documents(spark, where, "m").collect()} == {"a", "c"} == {r["path"] for r in I.chunks(spark, where, "m").collect()}
    assert run([("z", "other")], "n")["created"] == 1 and I.documents(spark, where, "m").count() == 2
    assert run([("a", "one!"), ("c", "three")], force=True)["updated"] == 2
    assert I.index_totals(I.documents(spark, where, "m"), I.chunks(spark, where, "m")).first().asDict() == {"document_count": 2, "chunk_count": 2}


def test_changes_replayed_and_stale(spark, tmp_path):
    where, enc = str(tmp_path / "ix"), HashEncoder(8)
    day = lambda d: datetime.datetime(2024, 1, d)
    feed = lambda *rows: spark.createDataFrame(rows, "path string, op string, content string, mtime timestamp")
    first = feed(("a", "updated", "1", day(1)), ("a", "updated", "2", day(2)), ("b", "updated", "x", day(2)), ("e", "updated", None, day(1)), ("q", "deleted", None, day(1)))
    status = lambda f, n: {r["path"]: r["status"] for r in ST.apply_changes(spark, where, "m", f, enc, n).collect()}
    assert status(first, 1) == {"a": "created", "b": "created", "e": "error", "q": "missing"} == status(first, 1)
    second = feed(("a", "updated", "0", day(1)), ("b", "deleted", None, day(3)), ("c", "updated", "", day(3)))
    assert status(second, 2) == {"a": "skipped", "b": "deleted", "c": "created"}
    assert {r["path"]: r["text"] for r in I.documents(spark, where, "m").collect()} == {"a": "2", "c": ""}


def test_metrics(spark):
    judged = spark.createDataFrame([(i, "q", "want", "c" if i < 2 else "d") for i in range(3)], "query_id long, query string, expected string, category string")
    ranked = spark.createDataFrame([(0, 1, "x/Want.md", 1.0), (1, 1, "a", 0.5), (1, 2, "want", 0.4), (2, 1, "a", 0.2)], "query_id long, rank int, path string, score double")
    m = E.evaluate(ranked, judged).first()
    assert (m["hit_1"], m["hit_3"], m["mrr"], m["saturation"], m["total"]) == pytest.approx((0.333333, 0.666667, 0.5, 0.333333, 3))
    assert {r["category"]: r["total"] for r in E.evaluate(lambda q: ranked, judged, by="category").collect()} == {"c": 2, "d": 1, None: 3}


def test_contexts(spark):
    q = spark.createDataFrame([(1, 'a "q" <x>'), (2, "none")], "query_id long, query string")
    h = spark.createDataFrame([(1, 1, "T&", "p", 0.5, "l1\n\nl2")], "query_id long, rank int, title string, path string, score double, hit_text string")
    xml = {r["query_id"]: r["context"] for r in X.render_context(q, h).collect()}
    assert xml[1] == '<context query="a &quot;q&quot; &lt;x&gt;">\n  <document index="1" title="T&amp;" path="p" score="0.5000">\n    l1\n    \n    l2\n  </document>\n</context>'
    assert X.EMPTY_XML in xml[2]
    md = {r["query_id"]: r["context"] for r in X.render_context(q, h, "md").collect()}
    assert md[1].endswith("### [1] T& (Score: 0.5000, Path: `p`)\n> l1\n>\n> l2")


def test_bundle(spark):
    docs = spark.createDataFrame([("d/a.md", "A", "---\nx: 1\n---\nbody ![[pic.png]]"), ("b.md", "B", "two")], "path string, title string, text string")
    chosen = spark.createDataFrame([(2, "/v/d/a.md"), (1, "B.MD"), (3, "missing")], "position long, path string")
    assets = spark.createDataFrame([("d/pic.png", bytearray(b"\x01\x02"))], "asset_path string, content binary")
    whole = lambda parts: "".join(r["content"] for r in parts.orderBy("section", "number").collect())
    parts = X.bundle(chosen, docs, assets, "Prompt", "Title")
    text = whole(parts)
    assert text == "# Title\n\nPrompt\n\n1. B\n2. A\n\n## 1. B\n\ntwo\n\n## 2. A\n\nbody ![](data:image/png;base64,AQI=)"
    assert tuple(X.bundle_totals(parts).first()) == (2, 1, len(text.encode()))
    assert whole(X.bundle(chosen.limit(0), docs, assets, "", "Title")) == "# Title\n\n"


def test_bundle_parts_are_files_in_order(spark, tmp_path):
    docs = spark.createDataFrame([(f"n{i}.md", f"T{i}", "é" * (i % 7) + f"\nline {i}\n") for i in range(700)], "path string, title string, text string").repartition(3)
    chosen = spark.createDataFrame([((i * 37) % 700, f"n{i}.md") for i in range(0, 700, 2)], "position long, path string").repartition(5)
    parts = X.bundle(chosen, docs).cache()
    data = b""
    for r in parts.orderBy("section", "number").collect():
        assert r["offset"] == len(data) and r["n_bytes"] == len(r["content"].encode())
        data += r["content"].encode()
    X.save_bundle(parts, str(tmp_path / "out"))
    files = b"".join(f.read_bytes() for f in sorted((tmp_path / "out").glob("part-*")))
    assert files == data + b"\n" * (not data.endswith(b"\n"))
    assert data.decode().split("\n")[2:4] == ["1. T0", "2. T246"]
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan


def test_running_totals(spark):
    rows = spark.range(1, 501).select("id", (F.col("id") % 5).alias("a"), F.lit(2).alias("b")).repartition(7)
    got = {r["id"]: (r["before_a"], r["before_b"]) for r in running_totals(rows, "id", "a", "b", size=16).collect()}
    assert got == {i: (sum(k % 5 for k in range(1, i)), 2 * (i - 1)) for i in range(1, 501)}


def test_assets_prefer_the_own_folder(spark):
    refs = spark.createDataFrame([("d/a.md", "pic.png"), ("d/a.md", "deep"), ("a.md", "no")], "path string, reference string")
    assets = spark.createDataFrame([("pic.png",), ("d/pic.png",), ("x/y/deep.svg",)], "asset_path string")
    got = {r["reference"]: r["asset_path"] for r in X.resolve_assets(refs, assets).collect()}
    assert got == {"pic.png": "d/pic.png", "deep": "x/y/deep.svg", "no": None}

def test_holders_start_anywhere(spark):
    from folioflow.operators.passages import holders

    long = "Zwölf Boxkämpfer jagen Viktor quer\nüber den großen Sylter Deich, sagt er."
    docs = [("a", "x" + long + " end"), ("b", "first line\n" + long), ("c", long[:50]), ("d", None), ("e", ""), ("f", "before. " + long[12:70] + "!")]
    asked = [(1, long), (2, long[3:]), (3, long[12:60]), (4, "line\nZw"), (5, "ö"), (6, ""), (7, None), (8, "not there, whatever the text may say about it"), (9, long[:40] + "?")]
    out = holders(spark.createDataFrame(asked, "query_id long, query string"), spark.createDataFrame(docs, "path string, text string"))
    want = sorted((i, p) for i, q in asked for p, t in docs if q is not None and t is not None and q in t)
    assert sorted((r["query_id"], r["path"]) for r in out.collect()) == want and len(want) > 12


def test_judgments_hold_the_passage_word_for_word(spark):
    from folioflow.plans import registry

    sf = "/root/testdata/sf0.01"
    docs = registry.documents(spark, sf).select("path", "text").collect()
    want = {r["query_id"]: min((d["path"] for d in docs if r["query"] in d["text"]), default="none") for r in registry.asked(spark, sf).collect()}
    got = {r["query_id"]: r["expected"] for r in registry._judgments(spark, sf).collect()}
    assert got == want and sum(x != "none" for x in got.values()) == 20


def test_model_compare_pairs_every_turn(spark):
    from folioflow.plans import registry

    sf = "/root/testdata/sf0.001"
    turns = {(r["conv_id"], r["turn"]) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    want = sum((c, t + 1) in turns for c, t in turns)
    assert {r["model"]: r["n"] for r in registry.model_compare(spark, sf).collect()} == {"hash_64": want, "hash_16": want}


def test_salient_sentence_in_every_language(spark):
    from folioflow.plans import registry

    sf = "/root/testdata/sf0.001"
    langs = registry.documents(spark, sf).select("doc_id", "lang")
    got = registry.salient_sentence(spark, sf).join(langs, "doc_id").groupBy("lang").count().collect()
    assert {r["lang"] for r in got} == {r["lang"] for r in langs.select("lang").distinct().collect()} and len(got) == 4


def test_scan_sees_all_names(spark, tmp_path, monkeypatch):
    """Names that begin with an underscore come back, also when they are asked for; a file system that is not known goes to Spark's source."""
    for name in ("_x.md", "sub/_y.md", "sub/a b.md", ".hidden/z.md", "_dir/in.md", ".dot.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"# {name}")
    seen = lambda **k: {r["relative_path"] for r in corpus.scan_corpus(spark, str(tmp_path), **k).collect()}
    assert seen() == {"_x.md", "sub/_y.md", "sub/a b.md", "_dir/in.md", ".dot.md"} and seen(names=["_y.md"]) == {"sub/_y.md"}
    asked = spark.createDataFrame([("sub/_y.md",)], "relative_path string")
    assert corpus.scan_files(spark, str(tmp_path), asked).first()["text"] == "# sub/_y.md"
    with pytest.raises(Exception, match="(?i)not.*exist|no such file|cannot"):
        corpus.scan_corpus(spark, str(tmp_path / "none")).count()
    monkeypatch.setattr(corpus, "opened", lambda root: None)
    assert seen() == {"sub/a b.md"}
    assert {r["relative_path"] for r in corpus.scan_corpus(spark, f"file://{tmp_path}", names=["a b.md"]).collect()} == {"sub/a b.md"}


def test_targeted_scan_reads_the_named_files_alone(spark, tmp_path):
    for name in ("a.md", "sub/a.md", "x{1},[2].md", "b.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    assert {r["relative_path"] for r in corpus.scan_corpus(spark, str(tmp_path), names=["a.md"]).collect()} == {"a.md", "sub/a.md"}
    asked = spark.createDataFrame([("sub/a.md",), ("x{1},[2].md",), ("no.md",)], "relative_path string")
    assert {r["relative_path"]: r["text"] for r in corpus.scan_files(spark, str(tmp_path), asked).collect()} == {"sub/a.md": "sub/a.md", "x{1},[2].md": "x{1},[2].md", "no.md": None}


def test_one_model_is_reset_and_rows_join(spark, tmp_path):
    where = str(tmp_path / "ix")
    for model, width in (("m", 8), ("n", 4)):
        I.update_index(scanned(spark, [("a", "one"), ("b", "# Head\n\ntwo")]), where, model, HashEncoder(width))
    rows = {r["path"]: (r["doc_text"], r["chunk_text"]) for r in I.chunk_rows(spark, where, "m").collect()}
    assert set(rows) == {"a", "b"} and rows["a"][0] == "one" and "one" in rows["a"][1]
    assert I.embedded_documents(spark, where, "n").count() == 2
    log = lambda name: I.read_table(spark, where, name)
    stats = {r["model_id"]: (r["document_count"], r["dim"]) for r in I.statistics(I.current_version(log("documents"), partition=("model_id",)), log("chunks")).collect()}
    assert stats == {"m": (2, 8), "n": (2, 4)}
    assert I.reset(spark, where, "m") == 2 and I.reset(spark, where, "m") == 0 and I.reset(spark, where, "other") == 0
    assert I.documents(spark, where, "m").count() == I.chunks(spark, where, "m").count() == 0 and I.documents(spark, where, "n").count() == 2
    assert I.update_index(scanned(spark, [("a", "one")]), where, "m", HashEncoder(8)).first()["created"] == 1


def test_compaction_removes_what_is_dead(spark, tmp_path, monkeypatch):
    """After a reset and a compaction the old files are gone and other models are what they were; batches go on; a run that fails
    before the new generation is named changes nothing."""
    where = str(tmp_path / "ix")
    for model in ("m", "n/2"):
        for text in ("one", "two"):
            I.update_index(scanned(spark, [("a", text), ("b", "same"), *([("c", "gone")] if text == "one" else [])]), where, model, HashEncoder(4))
    assert I.reset(spark, where, "m") == 2
    rows = lambda model: sorted((r["path"], r["text"], r["sha256"]) for r in I.documents(spark, where, model).collect())
    pieces = lambda model: sorted((r["path"], r["chunk_text"], r["embedding"]) for r in I.chunks(spark, where, model).collect())
    before, following = (rows("n/2"), pieces("n/2")), I.next_batch(spark, where)
    dead = sorted((tmp_path / "ix").rglob("*.parquet"))
    monkeypatch.setattr(I, "current_version", lambda *a, **k: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        I.compact(spark, where)
    monkeypatch.undo()
    assert sorted((tmp_path / "ix").rglob("*.parquet")) == dead and (rows("n/2"), pieces("n/2")) == before
    for _ in range(2):
        I.compact(spark, where)
        assert not any(f.exists() for f in dead)
        dead = sorted((tmp_path / "ix").rglob("*.parquet"))
        assert (rows("n/2"), pieces("n/2")) == before and len(before[0]) == 2 and rows("m") == pieces("m") == []
        assert I.read_table(spark, where, "documents").count() == 2
    I.update_index(scanned(spark, [("a", "three"), ("b", "same")]), where, "n/2", HashEncoder(4))
    got = {r["path"]: (r["text"], r["batch_id"]) for r in I.documents(spark, where, "n/2").collect()}
    assert got["a"][0] == "three" and got["b"][0] == "same" and got["b"][1] < got["a"][1] <= following


def test_lookup_and_keyword_hits(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, path string")
    assert I.point_lookup(docs, path="b").first()["doc_id"] == 2 and I.point_lookup(docs, doc_id=1).first()["path"] == "a"
    (tmp_path / "k.json").write_text('{"query_id": 1, "rank": 1, "file_id": 7, "full_path": "/v/a.md", "utility_score": 2.5}\n')
    row = corpus.keyword_hits(spark, str(tmp_path / "k.json")).first()
    assert (row["file_id"], row["utility_score"], row["snippet"]) == (7, 2.5, None)


def test_judged_sets_times_and_best(spark):
    one = spark.createDataFrame([(1, "q", "a", "c")], "query_id long, query string, expected string, category string")
    both = E.judged_sets({"x": one, "y": one.withColumn("query_id", F.lit(2).cast("long"))})
    assert {(r["query_id"], r["judged_set"]) for r in both.collect()} == {(1, "x"), (2, "y")}
    hits = spark.createDataFrame([(1, 1, "a", 0.9, 0.25), (2, 1, "b", 0.5, 0.75)], "query_id long, rank int, path string, score double, seconds double")
    got = E.evaluate(hits, both).first()
    assert (got["hit_1"], got["mean_seconds"], got["total"]) == (0.5, 0.5, 2)
    grid = E.parameter_grid(spark).withColumn("mrr", F.col("exponent")).withColumn("hit_1", F.lit(0.5))
    assert [r["exponent"] for r in E.best_parameters(grid).collect()] == [1.8] * 5


def test_progress_of_a_stream(spark, tmp_path):
    feed = spark.createDataFrame([(f"p{i}", "deleted" if i == 3 else "updated", "x", datetime.datetime(2024, 1, 1)) for i in range(4)], ST.CHANGES)
    feed.write.parquet(str(tmp_path / "feed"))
    seen = ST.RunProgress(4)
    spark.streams.addListener(seen)
    ST.stream_index(spark, ST.read_changes(spark, str(tmp_path / "feed")), str(tmp_path / "ix"), "m", HashEncoder(4), str(tmp_path / "state")).awaitTermination()
    for _ in range(100):
        if seen.done:
            break
        time.sleep(0.1)
    spark.streams.removeListener(seen)
    assert seen.state()["percent"] == 100.0 and seen.deletions == 1


def test_snippet_around_a_late_hit(spark):
    row = spark.createDataFrame([("a " * 500 + "Needle here", ["needle"]), ("plain", ["no"])], "t string, w array<string>").select(P.around(F.col("t"), F.col("w")).alias("s")).collect()
    assert "Needle here" in row[0]["s"] and row[1]["s"] == "plain"


EVENTS = "path string, op string, content string, mtime timestamp"


def feed(spark, where, *events):
    """Events as files of a feed, one file each."""
    for path, op, content, day in events:
        row = spark.createDataFrame([(path, op, content, f"2024-01-0{day}")], "path string, op string, content string, mtime string")
        row.withColumn("mtime", F.to_timestamp("mtime")).coalesce(1).write.mode("append").parquet(where)


def test_stream_keeps_states_by_path(spark, tmp_path, monkeypatch):
    """Begins from an index that is there, several files in one batch; stale, equal and empty events; a restart; a batch that fails
    after it was written and is repeated. The index is read once, before the first batch."""
    ix, where, state = (str(tmp_path / x) for x in ("ix", "feed", "state"))
    begin = spark.createDataFrame([(p, f"# {p}\ntext of {p}") for p in "abce"], "path string, text string").withColumn("mtime", F.to_timestamp(F.lit("2024-01-03")))
    scanned = begin.withColumns({"title": F.col("path"), "size": F.length("text").cast("long"), "sha256": F.sha2("text", 256)})
    I.update_index(scanned, ix, "m", HashEncoder(4))
    run = lambda: ST.stream_index(spark, ST.read_changes(spark, where), ix, "m", HashEncoder(4), state).awaitTermination()
    held = lambda: {r["path"]: (r["text"], r["batch_id"]) for r in I.documents(spark, ix, "m").collect()}

    feed(spark, where, ("a", "updated", "# a\ntext of a", 4), ("b", "deleted", None, 4), ("c", "updated", "stale", 1), ("d", "updated", "one", 4), ("d", "updated", "two", 5), ("x", "deleted", None, 4), ("e", "updated", None, 4))
    real, calls = I.write_batch, []

    def fails(*a, **k):
        real(*a, **k)
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("lost after the write")

    monkeypatch.setattr(I, "write_batch", fails)
    with pytest.raises(Exception, match="lost after the write"):
        run()
    run()
    assert len(calls) == 2
    want = {"a": ("# a\ntext of a", 1), "c": ("# c\ntext of c", 1), "d": ("two", 2), "e": ("# e\ntext of e", 1)}
    assert held() == want
    monkeypatch.setattr(I, "write_batch", real)
    read = I.read_table
    monkeypatch.setattr(I, "read_table", lambda *a: read(*a).limit(0))  # a restart asks the state, not the index
    feed(spark, where, ("d", "updated", "old", 4), ("c", "updated", "new", 6), ("b", "updated", "again", 6), ("d", "deleted", None, 7))
    run()
    monkeypatch.undo()
    got = held()
    assert got.pop("b")[0] == "again" and got.pop("c")[0] == "new" and got == {k: want[k] for k in ("a", "e")}


def test_stream_states_are_kept_by_groups_of_paths(spark, tmp_path, monkeypatch):
    """Random events in three runs, begun from an index: the same index as batch by batch, from as many states as there are groups."""
    monkeypatch.setattr(ST, "BUCKETS", 5)
    rng = random.Random(7)
    ix, other, where, state = (str(tmp_path / x) for x in ("ix", "other", "feed", "state"))
    event = lambda: (f"p{rng.randrange(60)}", *rng.choice([("updated", rng.choice("xyz")), ("deleted", None), ("updated", None)]), rng.choice([None, f"2024-01-0{rng.randint(1, 9)}"]))
    for n, run in enumerate(range(3), 1):
        rows = spark.createDataFrame([event() for _ in range(90)], "path string, op string, content string, day string")
        rows = rows.select("path", "op", "content", F.to_timestamp("day").alias("mtime")).localCheckpoint()
        rows.repartition(2).write.mode("append").parquet(where)
        if run == 0:
            first = spark.createDataFrame([(f"p{i}", "x", datetime.datetime(2024, 1, 4)) for i in range(0, 60, 2)], "path string, text string, mtime timestamp")
            for w in (ix, other):
                I.update_index(first.withColumns({"title": F.col("path"), "size": F.lit(1).cast("long"), "sha256": F.sha2("text", 256)}), w, "m", HashEncoder(4))
        query = ST.stream_index(spark, ST.read_changes(spark, where), ix, "m", HashEncoder(4), state)
        query.awaitTermination()
        assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 5
        ST.apply_changes(spark, other, "m", rows, HashEncoder(4), n + 1)
        got, want = (sorted((r["path"], r["text"], str(r["mtime"])) for r in I.documents(spark, w, "m").collect()) for w in (ix, other))
        assert got == want and len(got) > 10


def test_verdicts_are_those_of_a_batch(spark):
    stored = spark.createDataFrame([("a", "s1", "2024-01-02"), ("b", None, "2024-01-02")], "path string, sha256 string, mtime string").withColumn("mtime", F.to_timestamp("mtime"))
    for path, op, content, day in [("a", "updated", "x", 3), ("a", "updated", "x", 1), ("a", "deleted", None, 3), ("q", "deleted", None, 3), ("q", "updated", None, 3), ("q", "updated", "y", 3)]:
        rows = spark.createDataFrame([(path, op, content, f"2024-01-0{day}")], "path string, op string, content string, mtime string").withColumn("mtime", F.to_timestamp("mtime"))
        want = ST.classified(rows, stored).first()
        old = {r["path"]: (r["sha256"], r["mtime"], 1) for r in stored.collect()}.get(path)
        assert ST.verdict(old, op, content, want["mtime"], want["sha256"]) == want["status"]


def bm25(docs, queries, limit):
    """By definition, over all documents."""
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    each = [(i, words(t)) for i, t in docs]
    mean = sum(len(w) for _, w in each) / len(each)
    df = collections.Counter(w for _, ws in each for w in set(ws))
    out = []
    for q, text in queries:
        scores = []
        for i, ws in each:
            c = collections.Counter(ws)
            s = [math.log(1 + (len(each) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for t in set(words(text)) if c[t]]
            if s:
                scores.append((-round(sum(s), 6), i))
        out += [(q, i, -s, n) for n, (s, i) in enumerate(sorted(scores)[:limit], 1)]
    return out


def test_inverted_index_passes_over_blocks(spark, tmp_path):
    """The same rows as scoring everything, with and without a bound; blocks are passed over; a hot term is one row a block."""
    rng = random.Random(4)
    topics = [[f"w{k}x{j}" for j in range(30)] for k in range(8)]
    docs = [(i, " ".join(["hot"] + rng.choices(topics[i % 8], k=rng.randint(3, 60)))) for i in range(900)] + [(900, ""), (901, "hot"), (902, "w0x1 w0x1 w0x1")]
    queries = [(1, "hot w0x1 w0x2"), (2, "w3x4"), (3, "none here"), (4, ""), (5, "hot"), (6, "w1x1 w2x2 hot w5x3")]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    KW.store(KW.build(table, size=16), str(tmp_path / "ix"))
    index = KW.load(spark, str(tmp_path / "ix"))
    asked = spark.createDataFrame(queries, "query_id long, query string")
    for limit in (3, 5000):
        search = KW.Search(asked, index, limit)
        got = [(r["query_id"], r["doc_id"], r["score"], r["rank"]) for r in search.hits().orderBy("query_id", "rank").collect()]
        want = bm25(docs, queries, limit)
        assert [(q, i, n) for q, i, _, n in got] == [(q, i, n) for q, i, _, n in want] and all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, want))
        blocks = search.passed_over().agg(F.sum("blocks"), F.sum("visited")).first()
        assert blocks[1] < 0.6 * blocks[0] if limit == 3 else blocks[0] == blocks[1]
    hot = index.filter("term = 'hot'").agg(F.count("*"), F.max("n")).first()
    assert hot[0] >= 900 // 16 and hot[1] <= 16
    assert KW.Search(asked, KW.build(table.limit(0)), 3).hits().count() == 0
    odd = spark.createDataFrame([(1, None), (1, "a b"), (None, "a")], "doc_id long, text string")
    assert {(r["doc_id"], r["rank"]) for r in search_keyword(spark.createDataFrame([(1, "a")], "query_id long, query string"), odd).collect()} == {(1, 2), (None, 1)}


def stored_bytes(spark):
    return sum(f.stat().st_size for f in Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).rglob("*") if f.is_file())


@pytest.mark.parametrize("at_once", [40, 1 << 20])
def test_keyword_search_of_a_table_of_queries(spark, monkeypatch, at_once):
    """The same rows as scoring everything, in small steps too: ties, scores that round to nothing, empty texts and queries, keys that are strings.
    Rows of one id, or without one, add up as in SQL. The words of no query are not stored."""
    rng = random.Random(6)
    words = [f"w{j}" for j in range(40)]
    docs = [(f"d{i:03}", " ".join(["all"] + rng.choices(words, k=rng.randint(0, 40)) + [f"rare{i}x{j}" for j in range(30)])) for i in range(400)] + [("e", ""), ("f", None), ("g", "all w1"), ("h", "all w1")]
    queries = [("a", "all w1 w2"), ("b", "w3 W3 w4"), ("c", "none here"), ("d", ""), ("e", None), ("f", "all"), ("g", "w5 w6 w7 w8 w9 all")]
    table = spark.createDataFrame(docs, "doc_id string, text string").repartition(5).cache()
    asked = spark.createDataFrame(queries, "query_id string, query string")
    monkeypatch.setattr(forward, "AT_ONCE", at_once)
    for limit in (3, 7, 5000):
        before = stored_bytes(spark)
        got = search_keyword(asked, table, limit).orderBy("query_id", "rank").collect()
        assert stored_bytes(spark) - before < 80_000
        want = bm25(docs, queries, limit)
        assert [(r["query_id"], r["doc_id"], r["rank"]) for r in got] == [(q, i, n) for q, i, _, n in want]
        assert all(abs(r["score"] - s) < 2e-6 for r, (_, _, s, _) in zip(got, want))
    assert search_keyword(asked, table.limit(0), 3).count() == search_keyword(asked.limit(0), table, 3).count() == 0
    repeated = [(i % 7 if i % 5 else None, text) for i, (_, text) in enumerate(docs)]
    table = spark.createDataFrame(repeated, "doc_id int, text string").repartition(5).cache()
    index = KW.Search(asked, KW.build(table), 5000)
    rows = lambda df: sorted([(r["query_id"], -1 if r["doc_id"] is None else r["doc_id"], r["rank"], round(r["score"], 4)) for r in df.collect()])
    assert rows(search_keyword(asked, table, 5000)) == rows(index.hits())
    monkeypatch.setattr(forward, "QUERIES", 2)  # more queries than a task holds
    assert rows(search_keyword(asked, table, 5000)) == rows(index.hits())


def test_hits_are_looked_up_without_a_shuffle_of_texts(spark):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("p").alias("path"), F.lit("t").alias("title"), F.repeat(F.lit("w "), 100).alias("text"))
    q = spark.createDataFrame([(1, "w")], "query_id long, query string")
    hits = spark.createDataFrame([(1, 5, 0.5, 1)], "query_id long, doc_id long, score double, rank int").repartition(2, "doc_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = P.as_keyword_hits(hits, q, docs)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and [r["file_id"] for r in out.collect()] == [5]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_row_tables_of_awkward_blocks(spark):
    good = '[{"path":"p","name":"n","excerpt":"see, note: x"},{"path":"q","name":"m","tags":"#a #b","excerpt":"a ]; b \\" {c: 1}"}]'
    blocks = {
        f"const rows = {good};": [("n", "see, note: x", None), ("m", 'a ]; b " {c: 1}', ["#a", "#b"])],
        "let data = [{name: 'it\\'s, word: y', excerpt: \"x\", tags: ['#t', ' ',],},]\n;": [("it's, word: y", "x", ["#t"])],
        'notes = [{"name": 5, "excerpt": null}];': [("5", None, None)],
        'rows = [{"name": "open"}': [], "rows = [nonsense here];": [], "rows = {};": [], 'rows = [1, "x", {"name": "y"}];': [("y", None, None)],
        'dv.table(["a, b", "]"], [["x, (y)", "z"], ["q"]])': [("x, (y)", "z", None), ("q", None, None)],
        "rows = " + "[" + ",".join('{"name": "k"}' for _ in range(5000)) + "];": [("k", None, None)] * 5000,
    }
    notes = [(f"n{i}", f"# T\n```dataviewjs\n{b}\n```\nend") for i, b in enumerate(blocks)] + [("none", "no block"), ("null", None)]
    got = collections.defaultdict(list)
    for r in X.embedded_tables(spark.createDataFrame(notes, "path string, text string")).orderBy("path", "row").collect():
        got[r["path"]].append((r["name"], r["excerpt"], r["tags"]))
    assert {f"n{i}": v for i, v in enumerate(blocks.values()) if v} == dict(got)
