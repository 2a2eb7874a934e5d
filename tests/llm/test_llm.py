"""Operators for training text against brute force on small tables with awkward rows."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioflow.llm import exact, html, jaccard, language, lempelziv, merges, packing, pii, quality, rice, suffixes

PASSAGE = " ".join(f"word{i}" for i in range(70))
BASE = " ".join(f"tok{i % 61}x{i}" for i in range(120))


def edited(n):
    words = BASE.split()
    words[n % 100] = f"edit{n}"
    return " ".join(words)


TEXTS = [
    "one two three", None, "", "one  two\tthree", "ONE TWO THREE", PASSAGE, "start " + PASSAGE + " end", PASSAGE + " " + PASSAGE, BASE, edited(1), edited(40),
    edited(90) + " é漢字", "x" * 300, "y" + "x" * 300, "a b", " \n\t ", "line\nline\nline\nother", "é" * 60, "é" * 60 + "z", "mail a@b.co call +1 (415) 555-1234 or 10.0.0.1, card 4111111111111111", BASE,
]
DOCS = [(i + 10, t, "en", f"s{i % 3}", 0 if t is None else len(t)) for i, t in enumerate(TEXTS)] + [(None, "no id here", None, None, None), (10, "one two three", "en", "s0", 13)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc long, th long"


@pytest.fixture(scope="module")
def docs(spark):
    """With repeated ids, nulls, and columns named like the operators' own."""
    return spark.createDataFrame([(*r, 1, 2) for r in DOCS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(i):
    return 1 << 63 if i is None else i


def test_quality(docs, empty):
    out = quality.apply_policy(quality.ledger(docs)).collect()
    assert len(out) == len(DOCS)
    for r in out:
        text = r["text"] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        at = collections.defaultdict(list)
        for i in range(len(words) - 2):
            at[tuple(words[i : i + 3])].append(i)
        covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(covered))
        assert (r["n_lines"], r["n_dup_lines"]) == (len(lines), len(lines) - len(set(lines)))
        assert bool(r["fail_bits"] & 1) == (len(words) < 50) and (r["fail_bits"] & quality.POLICIES["v1"] == 0) == r["kept"]
    assert quality.ledger(empty).count() == 0


def test_ablation_counts_by_bits(docs):
    book = quality.ledger(docs).cache()
    bits = [r["fail_bits"] for r in book.collect()]
    for r in quality.ablation(book).collect():
        assert r["n_failed"] == sum(b >> r["bit"] & 1 for b in bits)
        assert r["n_kept_without"] == sum(b & quality.POLICIES["v1"] & ~(1 << r["bit"]) == 0 for b in bits)


@given(st.sets(st.integers(0, 2**64 - 1), max_size=200))
@settings(deadline=None)
def test_rice_round_trip(values):
    x = np.array(sorted(values), np.uint64)
    assert (rice.decode(rice.encode(x)) == x).all()


def test_exact(docs, empty):
    out = exact.duplicates(docs).collect()
    groups = collections.defaultdict(list)
    for i, t, *_ in DOCS:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), key(i), i))
    assert len(out) == len(DOCS) and sum(r["kept"] for r in out) == len(groups)
    by = {(r["doc_id"], r["text_sha256"]): r for r in out}
    for k, rows in groups.items():
        for _, _, i in rows:
            r = by[(i, hashlib.sha256(k.encode()).hexdigest())]
            assert (r["keep_id"], r["group_size"]) == (min(rows)[2], len(rows))
    assert exact.duplicates(empty).count() == 0


def test_near_duplicates(docs, empty):
    sets = []
    for i, t, *_ in DOCS:
        w = (t or "").encode().lower().split()
        sets.append((i, frozenset([tuple(w[k : k + 5]) for k in range(len(w) - 4)] or ([tuple(w)] if w else []))))
    root = list(range(len(sets)))
    find = lambda a: a if root[a] == a else find(root[a])
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a][1] & sets[b][1])
            if both and 100 * both >= 80 * len(sets[a][1] | sets[b][1]):
                root[find(a)] = find(b)
    least = collections.defaultdict(lambda: 1 << 63)
    for a, (i, _) in enumerate(sets):
        least[find(a)] = min(least[find(a)], key(i))
    want = sorted((key(i), len(s), least[find(a)]) for a, (i, s) in enumerate(sets))
    for rounds in (1, 2):
        got = sorted((key(r["doc_id"]), r["n_shingles"], key(r["component_id"])) for r in jaccard.near_duplicates(docs, rounds=rounds).collect())
        assert got == want
    assert jaccard.near_duplicates(empty).count() == 0


def covered_by(tokens, windows, n):
    gone = np.zeros(len(tokens), bool)
    for s in windows:
        gone[s : s + n] = True
    return gone


@pytest.mark.parametrize("hot", [2, 4096])
def test_suffixes(docs, empty, hot):
    n, seen = 50, collections.defaultdict(lambda: 1 << 63)
    for i, t, *_ in DOCS:
        b = (t or "").encode()
        for k in range(len(b) - n + 1):
            seen[b[k : k + n]] = min(seen[b[k : k + n]], key(i))
    want = []
    for i, t, *_ in DOCS:
        b = (t or "").encode()
        gone = covered_by(b, [k for k in range(len(b) - n + 1) if seen[b[k : k + n]] < key(i)], n)
        want.append((key(i), len(b), int(gone.sum()), np.frombuffer(b, np.uint8)[~gone].tobytes()))
    got = [(key(r["doc_id"]), r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in suffixes.deduplicated(docs, hot=hot).collect()]
    assert sorted(got) == sorted(want)
    if hot > 2:
        assert suffixes.deduplicated(empty).count() == 0


def test_lempel_ziv(docs, empty):
    n, seen, want = 20, {}, []
    rows = sorted(DOCS, key=lambda r: key(r[0]))
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - n + 1):
            seen[tuple(w[k : k + n])] = min(seen.get(tuple(w[k : k + n]), (1 << 64, 0)), (key(i), k))
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        gone = covered_by(w, [k for k in range(len(w) - n + 1) if seen[tuple(w[k : k + n])] < (key(i), k)], n)
        want.append((key(i), len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone) if not g)))
    out = lempelziv.deduplicated(docs).collect()
    assert sorted((key(r["doc_id"]), r["n_words"], r["n_removed"], bytes(r["kept"])) for r in out) == sorted(want)
    texts = {i: (t or "").split() for i, t, *_ in DOCS}
    for r in out:
        for f in r["factors"]:  # every factor is in its reference
            ref = texts[f["ref_doc"]]
            assert texts[r["doc_id"]][f["start"] : f["start"] + f["length"]] == ref[f["ref_start"] : f["ref_start"] + f["length"]]
    assert lempelziv.deduplicated(empty).count() == 0


def test_packing(spark, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(99, "a <|endoftext|> b " + PASSAGE * 9)], "doc_id long, text string"))
    out = packing.pack(more, window=64).collect()
    ids = collections.defaultdict(list)
    for r in out:
        ids[(key(r["doc_id"]), r["doc_tokens"])].append((r["start"], np.frombuffer(bytes(r["ids"]), "<u4")))
    want = collections.Counter((key(r["doc_id"]), *slow.encode(r["text"] or "", add_special_tokens=False).ids, 0) for r in more.collect())
    got = collections.Counter()
    for k, parts in ids.items():
        flat = [x for _, p in sorted(parts, key=lambda p: p[0]) for x in p.tolist()]
        got.update([(k[0], *flat)] if len(flat) == k[1] else [(k[0], *flat[i :: len(flat) // k[1]]) for i in range(len(flat) // k[1])])
    assert sum(len(k) * v for k, v in want.items()) == sum(len(k) * v for k, v in got.items())
    seqs = collections.defaultdict(list)
    for r in out:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 64 or at & (at - 1) == 0
    assert packing.pack(empty).count() == 0


def test_strategies_fill_the_window():
    h = np.zeros(65, np.int64)
    h[[10, 20, 34, 44, 54]] = [30, 40, 25, 10, 9]
    for combo, times in packing.strategies(h, 64):
        assert sum(combo) == 64 and times > 0.5


def test_merges_match_the_model_and_round_trip(spark, docs):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = docs.filter("text IS NOT NULL AND text <> ''").select("doc_id", "text")
    for r in merges.encode(rows, dropout=0.0).collect():
        assert np.frombuffer(bytes(r["ids"]), "<i4").tolist() == model.encode(r["text"])
    odd = spark.createDataFrame([(1, "a▁b  c ▁"), (2, None), (3, "  "), (4, "漢字\x00\n" + "é" * 90)], "doc_id long, text string")
    for dropout in (0.0, 0.3, 1.0):
        for r in merges.encode(rows.union(odd), seed=7, dropout=dropout).withColumn("back", merges.decoded("ids")).collect():
            assert r["back"] == (r["text"] or "")
    first, second = (sorted(map(bytes, (r["ids"] for r in merges.encode(rows, seed=s).collect()))) for s in (1, 2))
    assert first != second and first == sorted(bytes(r["ids"]) for r in merges.encode(rows, seed=1).collect())


def test_long_and_short_words_merge_alike():
    table = merges.pieces()
    words = ["▁the", "▁internationalization", "漢字", "▁▁▁x", "▁" + "é" * 5 + "thnd"]
    keys = np.arange(len(words)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for limit in (0, 1 << 62):
        ids, n = merges.segment(words, keys, limit, table)
        assert np.split(ids, np.cumsum(n)[:-1])[1].tolist() == merges._one(words[1], int(keys[1]), limit, table)
        assert ids.tolist() == [i for w, k in zip(words, keys) for i in merges._one(w, int(k), limit, table)]


def test_every_occurrence_is_segmented_by_itself():
    table, n = merges.pieces(), 4000
    word = "▁internationalization"
    whole = merges.encode_texts([" ".join([word[1:]] * n)], np.array([5]), 3, 0.1, table)[0]
    assert (whole == merges.encode_texts([" ".join([word[1:]] * n)], np.array([5]), 3, 0.1, table, together=7)[0]).all()
    at, seen = 0, collections.Counter()
    while at < len(whole):
        text, start = "", at
        while len(text) < len(word):
            text, at = text + table.pieces[whole[at]], at + 1
        assert text == word
        seen[tuple(whole[start:at].tolist())] += 1
    assert len(seen) > 50 and sum(seen.values()) == n


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def strict_spans(text):
    out = []
    for rank, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            d = [int(c) for c in m[0] if c.isdigit()]
            luhn = sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d[::-1])) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_pii(spark, docs, empty):
    odd = ["a@b.c_d@e.f", "1.2.3.4.5 256.1.1.1 001.2.3.4", "é x@y.zz é +44 20 7946 0958 é 4111-1111-1111-1111", "9" * 40, "+1", "call (415) 555-1234 now", "4 4111 1111 1111 1111"]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame([(500 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    for r in pii.detect(rows).withColumn("base_list", pii.listed("pii.base")).withColumn("all_list", pii.listed("pii.spans")).collect():
        assert r["base_list"] == strict_spans(r["text"] or "")
        assert set(filter(None, r["base_list"].split(","))) <= set(r["all_list"].split(","))
    hidden = {r["doc_id"]: r["text"] for r in pii.redact(rows).collect()}
    assert hidden[500 + 2] == "é [EMAIL] é [PHONE] é [CARD]" and hidden[11] is None and hidden[15] == PASSAGE
    assert pii.detect(empty).count() == 0


JWT = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIiwibmFtZSI6IkpvaG4ifQ.SflKxwRJSMeKKF2QT4fwpMeJf36POk6yJV_adQssw5c"
#: Texts and what is left of them, written by hand.
JUDGED = {
    'api_key = "' + "a1b2" * 80 + '" and more': 'api_key = "[SECRET]" and more',
    'token = "' + "0f9c" * 4000 + '"': 'token = "[SECRET]"',
    f"token: {JWT} ok": "token: [SECRET] ok",
    "john (dot) doe (at) example (dot) com": "[EMAIL]",
    "write to bob at example dot com": "write to [EMAIL]",
    "host 2001:0db8:85a3:0000:0000:8a2e:0370:7334 up": "host [IP] up",
    "ping fe80::1 at 12:30:45": "ping [IP] at 12:30:45",
    "the number 1234567812345678 stands": "the number 1234567812345678 stands",
    "th at thhablewh. Es that": "th at thhablewh. Es that",
    "4465758382889437 4465758382889437 twice": "[CARD] [CARD] twice",
    "in 2024, 1,234,567 of 12.30.2024 and std::vector": "in 2024, 1,234,567 of 12.30.2024 and std::vector",
}


def test_added_spans_by_hand(spark):
    """Of the given table: tokens and one card number that stands twice in a row, nothing else; and texts written for this test."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    score = pii.fitted(docs)
    more = pii.detect(docs, score=score).selectExpr("doc_id", "text", "explode(filter(pii.spans, x -> NOT exists(pii.base, b -> b.start = x.start AND b.kind = x.kind))) AS x").collect()
    secrets = [r for r in more if r["x"]["kind"] == "secret"]
    assert len(secrets) == 13 and all(re.fullmatch("[0-9a-f]{40}", r["x"]["body"]) and r["text"][: r["x"]["start"]].endswith('token = "') for r in secrets)
    assert sorted((r["doc_id"], r["x"]["kind"], r["x"]["body"]) for r in more if r not in secrets) == [(i, "card", "4465758382889437") for i in (254, 254, 402, 402)]
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(JUDGED)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.redact(texts, score=score).collect()}
    assert [got[i] for i in range(len(JUDGED))] == list(JUDGED.values())


def test_language(spark, empty):
    train = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("der hund und die katze", "de"), (None, "en"), ("no label", None)] * 3)], "doc_id long, text string, lang string")
    profiles = language.prototypes(train)
    assert list(profiles) == ["de", "en", "fr"]
    ask = spark.createDataFrame([(1, "the dog"), (2, "le chien"), (3, "und der hund"), (4, None), (5, "12 !?"), (6, "")], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(ask, profiles).collect()}
    assert [got[i][0] for i in range(1, 7)] == ["en", "fr", "de", "und", "und", "und"] and all(0 <= s <= 1 for _, s in got.values())
    assert language.identify(ask, {}).filter("lang_pred <> 'und'").count() == 0 and language.prototypes(empty) == {}


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.identify(docs.filter(language.held_out()), language.prototypes(docs.filter(~language.held_out())))
    assert out.filter("lang = lang_pred").count() >= 0.98 * out.count()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/a>Menu one</a></li><li><a href=/b>Menu two</a></li></ul></nav><div class="ad banner">Buy now, cheap.</div>
<div class="cookie-notice">We use cookies, accept.</div><aside>Side text, long enough to look like content, really.</aside>
<article><h1>Title &amp; more</h1><p><b>First para, with   text.<br>next line<p>Second&nbsp;para: yes.</p><ul><li>item one<li>item two</ul>
<form><label>Name</label><input></form><div class="comments"><p>Nice post, thanks a lot for it.</p></div></article><footer>&copy; me, all rights reserved.</footer></body></html>"""


def test_html(spark):
    assert html.main_text(PAGE) == "Title & more\n\nFirst para, with text. next line\n\nSecond para: yes.\n\nitem one\n\nitem two"
    for odd in (None, "", "   ", "<p", "plain words", "<div><div><div>", "<script>x", "<!-- open", "<p>" * 500):
        assert isinstance(html.main_text(odd), str)
    assert html.main_text("<body><div class=nav><a>x</a></div><div class=post><p>One, two.</p><p>Three, four.</p></div><div id=footer>bye</div></body>") == "One, two.\n\nThree, four."
    pages = spark.createDataFrame([(1, PAGE, "x"), (2, None, "y")], "page_id long, html string, text string")
    assert {r["page_id"]: len(r["text"]) for r in html.extract(pages).collect()}[2] == 0


@pytest.mark.parametrize("wrapper", ["div class='layout has-sidebar'", "div class='with-sidebar'", "div id='no-comments'", "div class='sidebar'", "form id=f", "section class=comments"])
def test_html_wrappers_of_an_article(wrapper):
    inner = "<div class=sidebar><p>Side, side.</p></div><div class='share nav'><article><p>One, two.</p></article></div><p class=ad>Buy, now.</p>"
    assert html.main_text(f"<body><{wrapper}>{inner}</{wrapper.split()[0]}><div class='sidebar-left'>x, y</div></body>") == "One, two."


def test_html_keeps_what_is_not_marked():
    page = "<article><h2 class='section-header'>Head</h2><p class='share-price'>Price, 5.</p><figure><img><figcaption>Caption.</figcaption></figure><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math>, here.</p><div class=comments><article>no, no</article></div></article>"
    assert html.main_text(page) == "Head\n\nPrice, 5.\n\nCaption.\n\nSo x=1, here."
    pages = "<article>" + "<p>Long, long, long text, on and on.</p>" * 20 + "</article><article><p>Short, but full, of, points, too.</p></article>"
    assert html.main_text(pages).endswith("Short, but full, of, points, too.")
    assert html.main_text("<main><p>Seen, yes.</p></main><div hidden=''><article><p>Not, seen.</p></article></div>") == "Seen, yes."


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    start = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf).cache()
        assert docs.columns == before.columns
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    normal = [re.sub(r"[\x20\x09-\x0D]", "", start[i]) for i in left]
    assert len(set(normal)) == len(normal) and len(left) >= 150
    for i, t in left.items():
        assert strict_spans(t) == ""
    pieces = corpus_pipeline.run(spark, sf)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == set(left)


def test_pipeline_with_null_and_repeated_ids(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    some = [r["text"] for r in docs.filter("lang = 'en' AND n_chars > 900").orderBy("doc_id").limit(5).collect()]
    near = lambda t, i: t + f" ending{i}"
    rows = [
        (None, "Alone " + some[0]), (None, "Other " + some[1]), (None, near("Other " + some[1], 1)),  # one null id stays of two near copies
        (9001, "Third " + some[2]), (9001, near("Third " + some[2], 1)), (9002, near("Third " + some[2], 2)),  # near copies that repeat an id
        (9003, "Fourth " + some[3]), (9004, "Fifth " + some[4]), (9004, near("Fourth " + some[3], 1)),  # one of two rows with an id goes
    ]
    rows = [(i, " ".join(w[::-1] + "q" for w in t.split())) for i, t in rows]  # far from the other documents
    extra = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], docs.schema)
    docs.unionByName(extra).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    got = collections.Counter(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).filter("start = 0 AND (doc_id IS NULL OR doc_id > 9000)").collect())
    assert got == {None: 2, 9001: 1, 9003: 1, 9004: 1}
    staged = corpus_pipeline.near_dedup(spark, extra.union(extra), str(tmp_path))  # each row twice
    texts = [r["text"] for r in staged.collect()]
    assert len(texts) == 5 and len(set(texts)) == 5 and {rows[0][1], rows[7][1]} <= set(texts)
    docs.filter("false").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
