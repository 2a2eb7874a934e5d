"""Archives, phrases and the Merkle manifest against brute force and round trips."""

import base64
import collections
import gzip
import hashlib
import io
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import merkle, phrases, warc

SF = "/root/testdata/sf0.001"


def lowered(text):
    return None if text is None else re.sub("[A-Z]", lambda m: m[0].lower(), text)


# --- operator 11


def pages(spark, rows):
    """With columns named like the operator's own."""
    return spark.createDataFrame([(*r, "own", 1) for r in rows], "page_id long, url string, html string, record string, chunk int")


TRICKY = "WARC/1.1\r\nContent-Length: 3\r\n\r\nfoo\r\n\r\n" * 60 + "é漢字"
PAGES = [
    (1, "http://a b\r\nX: y", None), (1, None, ""), (None, "u", "x" * 2000), (7, "u", "x" * 2000), (7, "v", "x" * 2000), (5, "w", "x" * 2000), (None, "v", "y" * 1500), (None, "v", "y" * 1500),
    (9, "w", TRICKY), (10, "w", TRICKY), (11, "s", "z" * 999), (12, "s", "z" * 999), (13, "t", "é" * 500), (14, "t", "é" * 500), (15, "long", "long text " * 50_000),
]


def archived(rows):
    """page_id, length, digest, type and what is referred to, by definition; of rows that repeat one page and payload one stays."""
    groups = collections.defaultdict(list)
    for i, (page, _, html) in enumerate(rows):
        payload = (html or "").encode()
        groups[payload if len(payload) >= 1000 else (i, payload)].append(page)
    out = []
    for key, ids in groups.items():
        payload = key if isinstance(key, bytes) else key[1]
        best = max((-1 if i is None else i, n) for n, i in enumerate(ids))[1]
        out += [(i, len(payload), hashlib.sha1(payload).hexdigest(), "response" if n == best else "revisit", None if n == best else ids[best]) for n, i in enumerate(ids)]
    return sorted(map(str, out))


@pytest.mark.parametrize(("size", "few"), [(1 << 20, 1 << 19), (700, 1 << 19), (700, 0)])
def test_archives_come_back(spark, size, few):
    got = warc.archived(pages(spark, PAGES).repartition(3), size=size, few=few).collect()
    assert sorted(str((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in got) == archived(PAGES)
    assert all(r["intact"] for r in got)


def test_no_pages(spark):
    assert warc.archived(pages(spark, PAGES[:1]).limit(0)).count() == 0


def test_chunks_carry_digests_and_bytes(spark, tmp_path):
    table = warc.chunk_table(pages(spark, PAGES), size=512).cache()
    warc.write_archives(table, warc.revisits(table).limit(0), f"{tmp_path}/all")
    for rows, name in ((table.collect(), "upto"), (warc.read_chunks(spark, f"{tmp_path}/all", size=512).collect(), "n")):
        held = collections.defaultdict(list)
        for r in rows:
            held[r["record"]].append(r)
        payloads = []
        for chunks in held.values():
            chunks.sort(key=lambda r: (r["chunk"], 0) if name == "upto" else (r["segment"], r["part"]))
            so_far = b""
            for r in chunks:
                so_far += r["payload"]
                assert len(r["payload"]) <= 512 and r["digest"] == hashlib.sha1(so_far).hexdigest()
                assert r[name] == len(so_far if name == "upto" else r["payload"]) and r["last"] == (r is chunks[-1])
            payloads.append(so_far.decode())
        assert sorted(payloads) == sorted(html or "" for _, _, html in PAGES)


def record(kind, name, body, *fields):
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", *fields, f"Content-Length: {len(body)}"]
    return "\r\n".join(["WARC/1.1", *head, "", ""]).encode() + body + b"\r\n\r\n"


def test_archives_of_others(spark, tmp_path):
    """Gzip members by record, other records between, a digest in base 32, and segments in another file than the first."""
    body = bytes(range(256)) * 40
    sha = base64.b32encode(hashlib.sha1(body).digest()).decode()
    first = record("warcinfo", "urn:i", b"software: x\r\n\r\n") + record("resource", "urn:a", body, f"WARC-Payload-Digest: sha1:{sha}", "WARC-Target-URI: http://x/\r\n more")
    cut = [body[:3000], body[3000:7000], body[7000:]]
    seg = [
        record("response" if k == 0 else "continuation", f"urn:s{k}", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" * (k == 0) + x, f"WARC-Segment-Number: {k + 1}", *[f"WARC-Segment-Origin-ID: <urn:s0>"] * (k > 0),
               *[f"WARC-Segment-Total-Length: {len(body)}", f"WARC-Payload-Digest: sha1:{sha}"] * (k == 2), "Content-Type: application/http; msgtype=response")
        for k, x in enumerate(cut)
    ]
    for name, parts in (("a", [first, seg[0]]), ("b", [seg[2]]), ("c", [seg[1], record("resource", "urn:e", b"")])):
        (tmp_path / f"{name}.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in parts))
    (tmp_path / "plain.warc").write_bytes(record("resource", "urn:p", b"plain", f"WARC-Payload-Digest: sha1:{sha}"))
    got = {r["record"]: (r["payload_bytes"], r["payload_digest"], r["intact"]) for r in warc.read_records(spark, str(tmp_path), size=1000).collect()}
    whole = (len(body), hashlib.sha1(body).hexdigest(), True)
    assert got == {"urn:a": whole, "urn:s0": whole, "urn:e": (0, hashlib.sha1().hexdigest(), True), "urn:p": (5, hashlib.sha1(b"plain").hexdigest(), False)}


def test_parser_holds_little():
    class Counted(io.RawIOBase):
        left = 64 << 20

        def read(self, n=-1):
            got = min(n, self.left)
            self.left -= got
            return b"x" * got

    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <r>\r\nContent-Length: {64 << 20}\r\n\r\n".encode()
    file = io.BufferedReader(io.BytesIO(head))
    body = Counted()

    class Both:
        def read(self, n):
            return file.read(n) or body.read(n)

    sizes = [r[8] for r in warc.parsed("x", Both(), size=1 << 20)]
    assert sum(sizes) == 64 << 20 and max(sizes) == 1 << 20
    with pytest.raises(ValueError, match="ends early"):
        list(warc.parsed("x", io.BytesIO(head + b"short")))
    with pytest.raises(ValueError, match="no WARC record"):
        list(warc.parsed("x", io.BytesIO(b"something else\r\n\r\n")))


# --- operator 12


def collocated(rows, least, top):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for d in (1, 2, 3, 4):
                for i in range(len(w) - d + 1):
                    f[lang or "und"][tuple(w[i : i + d])] += 1
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        gone = {q[i : i + d] for q, b in found.items() for d in range(2, len(q)) for i in range(len(q) - d + 1) if 100 * b >= 80 * c[q[i : i + d]]}
        ranked = []
        for p, a in found.items():
            if p not in gone:
                score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(ranked)[:top], 1)]
    return sorted(map(str, out))


def prose(seed, n):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdeAé\x01") + rng.choice(["", "b", ".", ",", "", " \t", "\n"])
    line = lambda: " ".join(word() for _ in range(60))
    return [(rng.choice(["en", None, "de"]), rng.choice([None, "", ". ,", "A b\tA b. a", *(line() for _ in range(6))])) for _ in range(n)]


@pytest.mark.parametrize(("least", "top", "size", "ranked"), [(5, 40, 500, 1 << 19), (1, 1 << 20, 3000, 1 << 19), (5, 40, 1 << 20, 50)])
def test_phrases(spark, least, top, size, ranked):
    rows = prose(3, 200)
    docs = spark.createDataFrame([(*r, "own", 1) for r in rows], "lang string, text string, shard string, n int").repartition(3)
    got = phrases.collocations(docs, least=least, top=top, size=size, ranked=ranked).collect()
    assert sorted(str(tuple(r)) for r in got) == collocated(rows, least, top)


def test_phrases_of_odd_tables(spark):
    docs = spark.createDataFrame([(None, None), ("en", ""), ("en", "?!"), ("en", "a b " * 20_000)], "lang string, text string")
    assert phrases.collocations(docs.limit(0)).count() == 0
    assert phrases.collocations(docs.limit(3)).count() == 0
    rows = [("en", None), ("en", "a b " * 20_000)]
    assert sorted(str(tuple(r)) for r in phrases.collocations(docs, size=4096).collect()) == collocated(rows, phrases.LEAST, phrases.TOP)


def test_intervals_of_phrases():
    """Every phrase of up to four symbols has the right count, and both intervals point at it."""
    rng = np.random.default_rng(5)
    s = np.append(rng.integers(0, 5, 300), 0)
    order = lambda x: sorted(range(len(x)), key=lambda i: ([int(v) for v in x[i : i + phrases.DEPTH]] + [0] * 4)[: phrases.DEPTH])
    back = np.concatenate([s[:-1][::-1], [0]])
    index = phrases.Index(s, 4)
    want = collections.Counter(tuple(s[i : i + d].tolist()) for d in (2, 3, 4) for i in range(len(s) - d + 1) if all(s[i : i + d]))
    first, second, lo, ol, n = phrases.pairs_of(index)
    found = {(a, b): (x, y, k) for a, b, x, y, k in zip(first.tolist(), second.tolist(), lo, ol, n)}
    three, four = phrases.longer(index, np.arange(len(n)))
    counts = {k: v[2] for k, v in found.items()} | {tuple(x[:-1]): x[-1] for t in (three, four) for x in zip(*(c.tolist() for c in t))}
    assert counts == dict(want)
    text, mirror = order(s), order(back)
    for (a, b), (x, y, k) in found.items():
        assert all(tuple(s[i : i + 2]) == (a, b) for i in text[x : x + k]) and all(tuple(back[i : i + 2]) == (b, a) for i in mirror[y : y + k])


def test_shards_cut_between_pieces():
    text = "one two, three. four five six; seven\neight nine ten".encode()
    for size in (1, 5, 12, 1000):
        parts = list(phrases.cut(text, size))
        assert b"".join(parts) == text and all(p[-1:] in (b",", b".", b";", b"\n") for p in parts[:-1])


# --- operator 13


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def coded(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def proved(rows):
    """By definition, with every level of every tree at hand."""
    groups, leaf = collections.defaultdict(list), lambda r, text: digest("".join(coded(x) for x in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))
    for r in rows:
        groups[r["source"]].append(r)
    for own in groups.values():
        own.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
    trees = {s: levels_of([leaf(r, r["text"]) for r in own]) for s, own in groups.items()}
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    top, out = levels_of([trees[s][-1][0] for s in names]), []
    for place, name in enumerate(names):
        for i, r in enumerate(groups[name]):
            changed = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            node, proof = leaf(r, lowered(r["text"]) if changed else r["text"]), ""
            for tree, j in ((trees[name], i), (top, place)):
                for level in tree[:-1]:
                    run = level[j - j % 16 : j - j % 16 + 16]
                    before, behind = "".join(run[: j % 16]), "".join(run[j % 16 + 1 :])
                    proof, node, j = proof + before + behind, digest(before + node + behind), j // 16
            out.append((r["doc_id"], trees[name][0][i], trees[name][-1][0], top[-1][0], digest(proof), node, node == top[-1][0]))
    return sorted(map(str, out))


def documents(spark, n):
    c, source = F.col("id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 97 == 1, None).otherwise(F.concat(F.lit("é"), (F.col("id") % 29).cast("string")))
    text = F.when(c % 11 == 0, None).otherwise(F.concat(F.lit("Text É "), c.cast("string")))
    return spark.range(n).select(c.alias("doc_id"), source.alias("source"), F.when(c % 7 > 0, "en").alias("lang"), c.alias("n_chars"), text.alias("text"), F.lit("own").alias("grp"), F.lit(1).alias("pos"))


def check(docs):
    names = "doc_id leaf subroot root proof_sha256 folded_root verified".split()
    got = merkle.manifest(docs).select(*names).collect()
    assert sorted(str(tuple(r)) for r in got) == proved([r.asDict() for r in docs.collect()])
    return got


def test_manifest(spark):
    """A source over several blocks and ranges; nulls; many small sources."""
    got = check(documents(spark, 30_000).repartition(5))
    assert {r["verified"] for r in got} == {True, False}


def test_manifest_of_edges(spark):
    """Sources of exactly one block and one row more; repeated rows and ids; null ids; one row; none."""
    docs = documents(spark, 5000)
    full = docs.filter("doc_id < 4096").withColumn("source", F.lit("a")).unionByName(docs.filter("doc_id < 4097").withColumn("source", F.lit("b")))
    odd = docs.limit(40).withColumn("doc_id", F.lit(None).cast("long")).unionByName(docs.limit(3)).unionByName(docs.limit(3)).unionByName(docs.limit(3).withColumn("text", F.lit("LONG " * 50_000)))
    check(full.unionByName(odd))
    check(docs.limit(1))
    assert merkle.manifest(docs.limit(0)).count() == 0


def test_paths_fold_to_the_node():
    for n, block in ((1, 0), (2, 0), (16, 0), (17, 0), (300, 0), (4096, 0), (1, 3), (17, 3)):
        nodes = [merkle.digest(str(i).encode()) for i in range(n)]
        levels = merkle.interior(nodes, block)
        assert len(levels[-1]) == 1 and len(levels) == (merkle.STEP + 1 if block else len(levels_of([x.decode() for x in nodes])))
        for i in (0, n // 2, n - 1):
            path = merkle.siblings(levels, i)
            assert merkle.folded(nodes[i], merkle.unpacked(merkle.packed(path))) == levels[-1][0]
            assert n == 1 or merkle.folded(merkle.digest(b"other"), path) != levels[-1][0]
