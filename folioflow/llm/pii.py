"""Personal data by candidate gradient boosting, with DataFrame functions only.

High-recall generators propose spans, which may overlap: what the strict patterns find, and looser shapes
(addresses spelled out or broken, numbers with any separators or across a line's end, read as card, phone and address
at once, long tokens). Each is described by its format and by what stands around it; boosted trees, turned into a
SQL expression, score it, and a kind's calibrated threshold decides. Where accepted spans overlap, the best score stays.
Spans of the strict patterns always stay, and loose ones that touch them go. Texts never leave their row.

No table says where personal data is, so the trees learn from spans planted by rule into passages of the corpus:
personal data in many formats, and what looks like it (dates, versions, prices, time stamps, codes). Whether a span was
planted as the one or the other is its label; thresholds come from planted spans that the trees have not seen.
"""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "secret")
STRICT = KINDS[:4]
#: Passages of the corpus that spans are planted into, spans planted, and the precision that a kind's threshold must reach.
PASSAGES, PLANTED, PRECISION = 256, 6000, 0.98
DEPTH, TREES, BINS, RATE = 4, 24, 16, 0.4

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of loose spans: groups of digits with separators, also across blanks, or without them; addresses; tokens.
LOOSE = {
    "wide": r"(?<![A-Za-z0-9])[+(]{0,2}[0-9]++(?:[\x20\n\t().,/_-]{1,3}[0-9]++)*+",
    "tight": r"(?<![A-Za-z0-9])[+(]?[0-9]++(?:[().,/_-]{1,2}[0-9]++)*+",
    "spelled": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:(?:\x20?[\[({]\x20?(?:dot|\.)\x20?[\])}]\x20?|\x20dot\x20)[A-Za-z0-9_%+-]++)*+"
    r"\x20?(?:@|[\[({]\x20?at\x20?[\])}]|\x20at\x20)\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[({]\x20?(?:dot|\.)\x20?[\])}]\x20?|\x20dot\x20)[A-Za-z0-9-]{2,}+)++",
    "dotted": r"(?<![A-Za-z0-9.])[0-9]{1,3}(?:\x20?(?:\.|[\[({]\x20?(?:\.|dot)\x20?[\])}]|\x20dot\x20)\x20?[0-9]{1,3}){3}(?!\.?[A-Za-z0-9])",
    "colons": r"(?<![A-Za-z0-9:.])[0-9A-Fa-f]{0,4}(?::{1,2}[0-9A-Fa-f]{1,4}){1,7}+(?:::)?(?![A-Za-z0-9:])",
    "token": r"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_-]{16,}+(?:\.[A-Za-z0-9+/_-]++)*+={0,2}(?![A-Za-z0-9+/_=-])",
}
#: A text without it has no match, so that most texts are not searched. _d: a digit, _a: a sign or word for @.
NEEDS = {"email": "instr(_t, '@') > 0", "ip": "_d", "card": "_d", "phone": "instr(_t, '+') > 0", "wide": "_d", "tight": "_d", "spelled": "_a", "dotted": "_d", "colons": "instr(_t, ':') > 0", "token": "_d"}
SPAN = "array<struct<start: int, end: int, body: string>>"
#: Matches whose positions are added up together.
STEP = 64
#: Of spans up to this length, at most so many places lie between two that overlap when they are sorted. Longer ones (long tokens) are compared with all.
WIDEST, NEIGHBOURS = 512, 256
NEAR = f"slice({{0}}, greatest(1, i + 1 - {NEIGHBOURS}), {2 * NEIGHBOURS + 1})"
OVERLAP = "{0}.start < x.end AND x.start < {0}.end"
AS_SPAN = "x -> named_struct('start', x.start, 'end', x.end, 'body', x.body, 'kind', x.kind)"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spans_of(text: str, pattern: str) -> str:
    """SQL for the spans of a pattern in a column: array of (start, end, body), from the leftmost on without
    overlaps. Positions are sums of the lengths of gaps and matches, first of whole steps of matches."""
    p = _quoted(pattern)
    return f"""
        transform(transform(transform(array(struct(split({text}, {p}) AS g, regexp_extract_all({text}, {p}, 0) AS m)),
          z -> named_struct('g', z.g, 'm', z.m, 'n', transform(z.m, (x, i) -> length(x) + length(z.g[i])))),
          z -> named_struct('g', z.g, 'm', z.m, 'n', z.n, 'b', aggregate(sequence(0, size(z.m) div {STEP}), array(0), (a, k) ->
            concat(a, array(element_at(a, -1) + aggregate(slice(z.n, k * {STEP} + 1, {STEP}), 0, (s, x) -> s + x)))))),
          z -> transform(transform(z.m, (x, i) -> named_struct('body', x, 'start',
            z.b[i div {STEP}] + aggregate(slice(z.n, (i div {STEP}) * {STEP} + 1, i % {STEP}), 0, (s, v) -> s + v) + length(z.g[i]))),
            x -> named_struct('start', x.start, 'end', x.start + length(x.body), 'body', x.body)))[0]"""


def luhn(digits: str) -> str:
    """SQL: whether a string of digits passes the Luhn test."""
    double = f"try_cast(substring({digits}, length({digits}) - i, 1) AS int)"
    return f"""(aggregate(sequence(0, length({digits}) - 1), 0, (a, i) -> a + CASE WHEN i % 2 = 0 THEN {double}
        ELSE 2 * {double} - CASE WHEN {double} > 4 THEN 9 ELSE 0 END END) % 10 = 0)"""


DIGITS = "regexp_replace(x.body, '[^0-9]', '')"
VALID = {
    "email": "true",
    "ip": "forall(split(x.body, '[.]'), p -> length(trim(LEADING '0' FROM p)) <= 3 AND coalesce(CAST(nullif(trim(LEADING '0' FROM p), '') AS int), 0) <= 255)",
    "card": f"(length({DIGITS}) BETWEEN 14 AND 19 AND {luhn(DIGITS)})",
    "phone": f"length({DIGITS}) BETWEEN 10 AND 15",
}
#: Kinds that a generator's span x (with d, its digits) may be.
READ_AS = {
    "wide": {"card": "length(x.d) BETWEEN 12 AND 19", "phone": "length(x.d) BETWEEN 7 AND 15"},
    "tight": {"card": "length(x.d) BETWEEN 12 AND 19", "phone": "length(x.d) BETWEEN 7 AND 15"},
    "spelled": {"email": "true"},
    "dotted": {"ip": "true"},
    "colons": {"ip": "CASE WHEN x.body LIKE '%::%' THEN instr(substring(x.body, instr(x.body, '::') + 1), '::') = 0 ELSE size(split(x.body, ':')) = 8 END"},
    "token": {"secret": "x.d <> '' AND x.body rlike '[A-Za-z]'"},
}
CUES = {
    "email": r"e-?mail|mailto|contact|write|courriel|correo|address|reach",
    "ip": r"\\bip\\b|host|server|addr|ping|login|adresse",
    "card": r"card|visa|master|amex|credit|debit|carte|karte|tarjeta|pay",
    "phone": r"tel|phone|call|fax|mobil|cell|ring|sms|appel|llam|anruf",
    "secret": r"token|secret|passw|pwd|key|auth|bearer",
}
#: Features of a candidate x: its format (d: its digits, g: its groups) and what stands before and after it.
FEATURES = {
    "n_digits": "length(x.d)",
    "n_letters": "length(regexp_replace(x.body, '[^A-Za-z]', ''))",
    "length": "length(x.body)",
    "n_groups": "size(x.g)",
    "longest": "array_max(transform(x.g, p -> length(p)))",
    "shortest": "array_min(transform(x.g, p -> length(p)))",
    "last": "length(element_at(x.g, -1))",
    "first_digit": "coalesce(try_cast(left(x.d, 1) AS int), -1)",
    "plus": "CAST(x.body LIKE '%+%' OR x.body LIKE '00%' AS int)",
    "brackets": "CAST(x.body LIKE '%(%' AS int)",
    "commas": "CAST(x.body rlike '[,/_]' AS int)",
    "dots": "CAST(x.body LIKE '%.%' AS int)",
    "breaks": "CAST(x.body rlike '[\\n\\t]' AS int)",
    "blanks": "CAST(x.body LIKE '% %' AS int)",
    "dot_word": "CAST(x.body rlike '(?i)(^|[^a-z])dot([^a-z]|$)' AS int)",
    "enclosed": r"CAST(x.body rlike '([({]|\\x5B) ?(at|dot|[.])' AS int)",
    "domain": "CAST(lower(element_at(x.g, -1)) IN ('com', 'org', 'net', 'edu', 'gov', 'info', 'io', 'de', 'fr', 'es', 'it', 'uk', 'eu') AS int)",
    "at": "CAST(x.body LIKE '%@%' AS int)",
    "hex": "CAST(x.body rlike '^[0-9a-fA-F]+$' AS int)",
    "upper": "CAST(x.body rlike '[A-Z]' AND x.body rlike '[a-z]' AS int)",
    "largest": "coalesce(array_max(transform(x.g, p -> try_cast(left(p, 6) AS int))), -1)",
    "luhn": f"CAST(length(x.d) BETWEEN 12 AND 19 AND {luhn('x.d')} AS int)",
    "cue": "CAST(CASE x.kind " + " ".join(f"WHEN '{k}' THEN x.before rlike '{v}'" for k, v in CUES.items()) + " END AS int)",
    "counter": r"CAST(x.before rlike '(version|v\\.|page|isbn|order|chapter|section|no\\.|nr\\.|[$€£]|id|sum|commit|sha|md5|build)[^a-z0-9]{0,4}$' AS int)",
    "unit": r"CAST(x.after rlike '^ ?(%|[$€£]|km|kg|eur|usd|am|pm|h |ms|units|items)' AS int)",
    "assigned": r"CAST(x.before rlike '[=:][ \"\\x27]*$' AS int)",
    "digit_near": "CAST(x.before rlike '[0-9][^a-z]{0,2}$' OR x.after rlike '^[^a-z]{0,2}[0-9]' AS int)",
    "letter_near": "CAST(x.before rlike '[a-z]$' OR x.after rlike '^[a-z]' AS int)",
}


def _candidates(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with _base, the strict spans that hold, and _loose, the generators' spans of every kind with features;
    those may overlap each other, and no base span."""
    none = f"CAST(array() AS {SPAN})"
    out = docs.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    out = out.withColumns({"_d": F.expr("_t rlike '[0-9]'"), "_a": F.expr("instr(_t, '@') > 0 OR _t rlike '[\\\\[({ ]at[\\\\])} ]'")})
    as_kind = lambda k: f"x -> named_struct('start', x.start, 'end', x.end, 'body', x.body, 'kind', '{k}')"
    found = lambda name, p, k: f"transform(filter({spans_of('_t', p)}, x -> {VALID[k]}), {as_kind(k)})"
    empty = "CAST(array() AS array<struct<start: int, end: int, body: string, kind: string>>)"
    strict = [f"CASE WHEN {NEEDS[k]} THEN {found(k, PATTERNS[k], k)} ELSE {empty} END" for k in STRICT]
    loose = []
    for name, kinds in READ_AS.items():
        with_digits = f"transform({spans_of('_t', LOOSE[name])}, x -> named_struct('start', x.start, 'end', x.end, 'body', x.body, 'd', {DIGITS}))"
        each = [f"transform(filter(z, x -> {where}), {as_kind(k)})" for k, where in kinds.items()]
        loose.append(f"CASE WHEN {NEEDS[name]} THEN transform(array({with_digits}), z -> concat({', '.join(each)}))[0] ELSE {empty} END")
    out = out.withColumns({"_base": F.expr(f"concat({', '.join(strict)})"), "_every": F.expr(f"array_distinct(concat({', '.join(loose)}))")})
    both = "array_sort(concat(transform(_base, b -> struct(b.start, b.end, true AS strict, b.body, b.kind)), transform(_every, b -> struct(b.start, b.end, false AS strict, b.body, b.kind))))"
    near = f"CASE WHEN x.end - x.start > {WIDEST} THEN z ELSE {NEAR.format('z')} END"
    apart = f"NOT x.strict AND NOT exists({near}, b -> b.strict AND {OVERLAP.format('b')}) AND NOT exists(_base, b -> b.end - b.start > {WIDEST} AND {OVERLAP.format('b')})"
    kept = f"transform(array({both}), z -> filter(z, (x, i) -> {apart}))[0]"
    out = out.withColumn("_every", F.expr(f"CASE WHEN size(_every) = 0 THEN _every ELSE transform({kept}, {AS_SPAN}) END"))
    around = f"""x -> named_struct('start', x.start, 'end', x.end, 'body', x.body, 'kind', x.kind, 'd', {DIGITS},
        'g', filter(split(x.body, '[^A-Za-z0-9]+'), p -> p <> ''),
        'before', lower(substring(_t, greatest(1, x.start - 23), least(24, x.start))), 'after', lower(substring(_t, x.end + 1, 8)))"""
    features = ", ".join(f"'{f}', CAST({e} AS int)" for f, e in FEATURES.items())
    described = f"x -> named_struct('start', x.start, 'end', x.end, 'body', x.body, 'kind', x.kind, {features})"
    wide = "named_struct('start', 0, 'end', 0, 'body', '', 'kind', '', " + ", ".join(f"'{f}', 0" for f in FEATURES) + ")"
    return out.withColumn("_loose", F.expr(f"CASE WHEN size(_every) = 0 THEN filter(array({wide}), x -> false) ELSE transform(transform(_every, {around}), {described}) END")).drop("_t", "_d", "_a", "_every")


def _digits(rng: random.Random, shape: str) -> str:
    return "".join(rng.choice("123456789") if c == "D" else rng.choice("0123456789") if c == "#" else c for c in shape)


def _card(rng: random.Random, mistyped: bool) -> str:
    digits = [int(c) for c in rng.choice("3456") + _digits(rng, "#" * rng.choice([13, 14, 14, 14, 15]))]
    total = sum(x if i % 2 else 2 * x - 9 * (x > 4) for i, x in enumerate(digits[::-1]))
    body = "".join(map(str, digits)) + str(-total % 10)
    if mistyped:
        at = rng.randrange(1, len(body))
        body = body[:at] + rng.choice([c for c in "0123456789" if c != body[at]]) + body[at + 1 :]
    sep = rng.choice(["", "", " ", "-", ".", "_", "/", " - ", "\n"])
    return sep.join(body[i : i + 4] for i in range(0, len(body), 4))


def _planted(rng: random.Random, kind: str, good: bool) -> tuple[str, str]:
    """(what stands before, span): personal data of a kind, or what looks like it."""
    pick = rng.choice
    word = lambda: "".join(pick("abcdefghilmnoprstuvw") for _ in range(rng.randint(3, 9)))
    cue = pick({"email": ["e-mail: ", "contact ", "write to "], "ip": ["host ", "ip ", "server "], "card": ["card ", "visa ", "paid with "], "phone": ["tel. ", "call ", "phone: "], "secret": ["token = ", "key: ", 'secret="']}[kind]) if rng.random() < 0.5 else ""
    octets = [str(rng.randint(0, 255)) for _ in range(4)]
    tokens = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
    code = lambda n, letters: "".join(pick(letters) for _ in range(n))
    if good:
        if kind == "email":
            at, dot = pick([(" at ", " dot "), (" (at) ", "."), ("[at]", "[dot]"), ("@ ", "."), (" @", "."), ("(at)", "(dot)"), (" {at} ", " {dot} ")])
            return cue, word() + pick(["", "." + word(), str(rng.randint(1, 99))]) + at + word() + dot + pick(["com", "org", "net", "de", "fr", "io"])
        if kind == "ip" and rng.random() < 0.4:
            groups = [code(rng.randint(1, 4), "0123456789abcdef") for _ in range(8)]
            return cue, ":".join(groups) if rng.random() < 0.5 else "::".join((":".join(groups[: rng.randint(1, 4)]), ":".join(groups[rng.randint(5, 7) :])))
        if kind == "ip":
            return cue, pick(["[.]", " . ", "(.)", " dot ", "[dot]", " ."]).join(octets)
        if kind == "card":  # a number that fails the test is a mistyped card where a cue says that it is one
            return cue, _card(rng, cue != "" and rng.random() < 0.4)
        if kind == "phone":
            return cue, _digits(rng, pick(["D##-###-####", "(D##) ###-####", "D##.###.####", "00D# ## ### ####", "0## ### ## ##", "0D ## ## ## ##", "(0##) ### ####", "0D##/#######", "D## ### ####", "1-8##-###-####", "0D##-#######"]))
        return pick(["token = \"", "api_key: ", "secret=", "password: ", "bearer ", ""]), pick([code(rng.choice([40, 40, 64, 320]), "0123456789abcdef"), ".".join(["eyJ" + code(rng.randint(14, 40), tokens), code(rng.randint(30, 300), tokens), code(43, tokens)]), code(32, "ABCDEFGHIJKLMNOPabcdefghijklmnop0123456789"), "sk_" + code(24, "abcdefghij0123456789"), "AK" + code(18, "ABCDEFGHIJ0123456789")])
    if kind == "email":
        return "", pick([f"{word()} at {word()} . {word()}", f"look at {word()}.{word()}", f"{word()} at page.{word()}", f"{word()} at noon. {word()}"])
    if kind == "ip" and rng.random() < 0.2:
        return "", "::".join((code(rng.randint(2, 4), "abcdef"), code(rng.randint(2, 4), "abcdef")))
    if kind == "ip":
        return pick(["version ", "section ", "chapter ", "", "scores "]), pick([". ", ".", " . "]).join(str(rng.choice([rng.randint(0, 30), rng.randint(256, 999)])) for _ in range(4))
    if kind == "card" and rng.random() < 0.5:  # as long and grouped as a card, without a cue, and no valid number
        return pick(["", "", word() + " "]), _card(rng, True)
    if kind == "card":
        return pick(["order ", "isbn ", "id ", "sum ", "", ""]), _digits(rng, pick(["16###########", "978-D-##-######-#", "978##########", "D##,###,###,###", "20## 20## 20##", "0.D###########", "D.#############", "1################.##", "20##-##-## ##:##:##", "000000######", "D## ### ### ###"]))
    if kind == "phone":
        return pick(["", "page ", "order ", "id ", "$", "in ", "no. "]), _digits(rng, pick(["20##-0#-1#", "1#/0#/20##", "D,###,###", "1### - 20##", "20##/20##", "D###,###.##", "0.#######", "########", "D## 20##", "1# 1# 20##", "D.###.###", "#########", "16########", "D.##.####", "19## 20##"]))
    return pick(["sha ", "commit ", "", "see ", "id "]), pick([word() + "-" + word() + "-" + word() + "-2024", "a/" + word() + "/" + word() + "/" + word() + "7", word() + "_" + word() + "_" + word() + str(rng.randint(1, 9)), word() * 3 + str(rng.randint(1, 99)), "-" * 20 + "1a"])


def planted(passages: list[str], n: int = PLANTED, seed: int = 1) -> list[dict]:
    """``n`` texts with one planted span each: text, kind, start, end, good, fold (0 to 3)."""
    rng, out = random.Random(seed), []
    passages = passages or ["some words that stand around"]
    for i in range(n):
        kind, good = KINDS[i % len(KINDS)], rng.random() < 0.5
        before, body = _planted(rng, kind, good)
        left, right = (rng.choice(passages) for _ in range(2))
        left = left[: rng.randint(0, len(left))] + rng.choice([" ", " ", ". ", "\n", " ("]) + before
        text = left + body + rng.choice([" ", ". ", ", ", "\n", ") ", '" ']) + right
        out.append({"text": text, "kind": kind, "start": len(left), "end": len(left) + len(body), "good": good, "fold": i // len(KINDS) % 4})
    return out


def passages(docs: DataFrame, text: str, n: int = PASSAGES) -> list[str]:
    """About ``n`` passages of 60 characters, of documents and from places chosen by hash; never more than ``2 * n``. Digits and
    signs of addresses go, so that a passage holds no data of its own."""
    every = max(1, docs.count() // n)
    h, body = F.xxhash64(F.col(text)), F.coalesce(F.col(text), F.lit(""))
    place = F.pmod(F.shiftright(h, 20), F.greatest(F.length(body) - 59, F.lit(1)).cast("long")).cast("int") + 1
    some = docs.filter(F.pmod(h, F.lit(every)) == 0).select(F.regexp_replace(F.substring(body, place, F.lit(60)), "[0-9@+=]", "").alias("p")).filter("p <> ''")
    return sorted(r["p"] for r in some.limit(2 * n).collect())


def described(spark, texts: list[dict]) -> list:
    """Features and label of every candidate in the planted ``texts``, in their order: good if it is the planted span, of its kind. The texts are
    rows, not literals, and the explode is the outer form, as Spark filters by the size of what a plain one gets: with either, the plan, which
    the driver holds and rewrites, would be several times as large."""
    kind = "_n int, text string, kind string, start int, end int, good boolean, fold int"
    rows = spark.createDataFrame(pa.Table.from_pylist([{"_n": i} | t for i, t in enumerate(texts)]), kind).repartition(8)
    found = _candidates(rows.withColumnRenamed("kind", "planted"), "text").select("_n", "start", "end", "good", "fold", "planted", F.posexplode_outer("_loose").alias("_i", "x"))
    label = "good AND x.kind = planted AND least(x.end, end) - greatest(x.start, start) >= 0.8 * (greatest(x.end, end) - least(x.start, start))"
    out = found.filter("x IS NOT NULL").select("_n", "_i", "x.*", F.expr(label).alias("label"), "fold", F.expr("good AND x.start < end AND start < x.end").alias("touches"))
    return sorted(out.collect(), key=lambda r: (r["_n"], r["_i"]))


def _fit(rows: list) -> tuple[list, dict[str, float]]:
    """Boosted trees on logistic loss over binned features, fitted on three folds, and a threshold by kind from the
    fourth: the lowest score from which on precision holds. On the driver, over a bounded number of planted spans."""
    import numpy as np

    x = np.array([[r[f] for f in FEATURES] + [r["kind"] == k for k in KINDS] for r in rows], float)
    y = np.array([r["label"] for r in rows], float)
    train = np.array([r["fold"] < 3 for r in rows])
    kinds = np.array([r["kind"] for r in rows])
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    score, trees = np.zeros(len(y)), []

    def grow(at, g, h, depth):
        total_g, total_h = g[at].sum(), h[at].sum()
        best = (1e-3, None, None)
        for j, edges in enumerate(cuts if depth else ()):
            place = np.searchsorted(edges, x[at, j])  # at most edges[i]: to the left of cut i
            left_g, left_h = (np.cumsum(np.bincount(place, v[at], len(edges) + 1))[:-1] for v in (g, h))
            gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
            gain[(left_h < 1) | (total_h - left_h < 1)] = 0
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), j, float(edges[gain.argmax()]))
        if best[1] is None:
            return round(float(RATE * total_g / (total_h + 1)), 6)
        left = x[at, best[1]] <= best[2]
        return best[1], best[2], grow(at[left], g, h, depth - 1), grow(at[~left], g, h, depth - 1)

    def values(tree, at):
        if not isinstance(tree, tuple):
            return np.full(len(at), tree)
        left = x[at, tree[0]] <= tree[1]
        out = np.empty(len(at))
        out[left], out[~left] = values(tree[2], at[left]), values(tree[3], at[~left])
        return out

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        trees.append(grow(np.flatnonzero(train), y - p, p * (1 - p), DEPTH))
        score += values(trees[-1], np.arange(len(y)))
    limits = {}
    for k in KINDS:
        held = (kinds == k) & ~train
        order = np.argsort(-score[held], kind="stable")
        s, good = score[held][order], y[held][order]
        precise = (np.cumsum(good) / np.arange(1, len(good) + 1) >= PRECISION) & (np.append(s[1:], -np.inf) < s)
        limits[k] = round(float(s[np.flatnonzero(precise)[-1]]) - 1e-6, 6) if precise.any() else 1e9
    return trees, limits


def _sql(tree, names: list[str]) -> str:
    if isinstance(tree, tuple):
        return f"CASE WHEN {names[tree[0]]} <= {tree[1]!r}D THEN {_sql(tree[2], names)} ELSE {_sql(tree[3], names)} END"
    return f"{tree!r}D"


def fitted(docs: DataFrame, text: str = "text") -> str:
    """SQL for how far the score of a candidate x lies above its kind's threshold, fitted on passages of ``docs``."""
    trees, limits = _fit(described(docs.sparkSession, planted(passages(docs, text))))
    names = [f"x.{f}" for f in FEATURES] + [f"CAST(x.kind = '{k}' AS int)" for k in KINDS]
    limit = "CASE x.kind " + " ".join(f"WHEN '{k}' THEN {v!r}D" for k, v in limits.items()) + " END"
    return f"({' + '.join(_sql(t, names) for t in trees)} - {limit})"


def detect(docs: DataFrame, text: str = "text", score: str | None = None, into: str = "pii") -> DataFrame:
    """``docs`` with a column ``into``: struct of base and spans, arrays of (start, end, body, kind) by start, then kind:
    the strict spans, and all spans. Positions count code points, ends are exclusive. Null text has none. Only columns
    that start with _ are made on the way, so a column of ``docs`` by any other name stays; one named ``into`` is replaced."""
    score = score or fitted(docs, text)
    rank = "CASE y.kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS)) + " END"
    ordered = lambda c: f"CASE WHEN size({c}) < 2 THEN {c} ELSE transform(array_sort(transform({c}, y -> struct(y.start, {rank} AS k, y.end, y AS v))), z -> z.v) END"
    scored = f"filter(transform(_loose, x -> named_struct('start', x.start, 'end', x.end, 'body', x.body, 'kind', x.kind, 'score', {score})), x -> x.score >= 0)"
    better = "(y.score > x.score OR y.score = x.score AND (y.end - y.start > x.end - x.start OR y.end - y.start = x.end - x.start AND (y.start < x.start OR y.start = x.start AND y.kind < x.kind)))"
    near = f"CASE WHEN x.end - x.start > {WIDEST} THEN c.z ELSE {NEAR.format('c.z')} END"
    lost = f"exists({near}, y -> {OVERLAP.format('y')} AND {better}) OR exists(c.long, y -> {OVERLAP.format('y')} AND {better})"
    both = f"transform(array({scored}), z -> struct(z AS z, filter(z, y -> y.end - y.start > {WIDEST}) AS long))"
    more = f"transform({both}, c -> transform(filter(c.z, (x, i) -> NOT ({lost})), {AS_SPAN}))[0]"
    return (
        _candidates(docs, text)
        .withColumn("_more", F.expr(f"CASE WHEN size(_loose) = 0 THEN filter(_base, x -> false) ELSE {more} END"))
        .withColumn("_both", F.concat("_base", "_more"))
        .withColumn(into, F.struct(F.expr(ordered("_base")).alias("base"), F.expr(ordered("_both")).alias("spans")))
        .drop("_more", "_both", "_loose", "_base")
    )


def listed(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.expr(f"array_join(transform({spans}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")


def redact(docs: DataFrame, text: str = "text", score: str | None = None) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one, named by
    the first. A text without spans, or null, stays as it is; so do all other columns."""
    out = detect(docs, text, score, "_pii")
    body = f"`{text}`"
    merged = """aggregate(_pii.spans, CAST(array() AS array<struct<start: int, end: int, kind: string>>), (a, x) ->
        CASE WHEN size(a) > 0 AND element_at(a, -1).end > x.start
             THEN concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, x.end), 'kind', element_at(a, -1).kind)))
             ELSE concat(a, array(named_struct('start', x.start, 'end', x.end, 'kind', x.kind))) END)"""
    parts = f"""transform(array({merged}), m -> concat(array_join(transform(m, (x, i) ->
        concat(substring({body}, CASE WHEN i = 0 THEN 1 ELSE m[i - 1].end + 1 END, x.start - CASE WHEN i = 0 THEN 0 ELSE m[i - 1].end END), '[', upper(x.kind), ']')),
        ''), substring({body}, element_at(m, -1).end + 1)))[0]"""
    return out.withColumn(text, F.expr(f"CASE WHEN size(_pii.spans) = 0 THEN {body} ELSE {parts} END")).drop("_pii")


def op8_pii(spark, sf_dir: str) -> DataFrame:
    """Every document's personal data: counts and digest of the strict spans, and all spans."""
    out = detect(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select(
        "doc_id", *(F.expr(f"CAST(size(filter(pii.base, x -> x.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in STRICT),
        F.sha2(listed("pii.base"), 256).alias("base_sha256"), listed("pii.spans").alias("spans"),
    )
