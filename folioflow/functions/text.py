"""Text functions: Column in, Column out. Patterns are Java's, with Unicode classes where white space or
word characters are meant, and with line feeds as the only line ends of ``^`` and ``$``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# They decide what is text and what is metadata.
METADATA_KEYS = ("created:", "updated:", "date:", "id:", "pw:", "sha256:", "aliases:", "excalidraw-plugin:", "kanban-plugin:", "tags:", "検索用:", "category:")
KEYWORD_KEYS = ("検索用", "keywords", "category")
FILE_NAME_MARKS = ("jp", "com", "net", "html", "php", "aspx", "ipynb", "excalidraw")
MODEL_PREFIXES = {"ruri": ("検索クエリ: ", "検索文書: "), "e5": ("query: ", "passage: ")}
NFKC_MARKS = r"[\s\-_ー−―]+"

#: Unicode's white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def let(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(c), use)[0]


def strip(c: Column) -> Column:
    """Without white space at both ends, Unicode blanks included."""
    return F.btrim(c, F.lit(WHITE))


def lines(c: Column) -> Column:
    return F.split(c, LINE_END)


def unquoted(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"""^['"]+|['"]+\z""", "")


def listed(c: Column, separators: str = ",") -> Column:
    """The items of a delimited string, trimmed and without quotes or empties."""
    return F.filter(F.transform(F.split(c, separators), unquoted), lambda x: x != "")


def title(text: Column, stem: Column) -> Column:
    """The stem, or with the first level-one heading: ``stem - heading`` where they differ, else the heading."""
    heads = F.filter(F.transform(F.filter(F.transform(lines(F.coalesce(text, F.lit(""))), strip), lambda x: x.startswith("# ")), lambda x: strip(F.substr(x, F.lit(3)))), lambda x: x != "")
    return let(F.try_element_at(heads, F.lit(1)), lambda head: F.when(head.isNull(), stem).when(F.lower(head) == F.lower(stem), head).otherwise(F.concat(stem, F.lit(" - "), head)))


def stem_of(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*\z", "")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*\z", 1)


def parent_folder(path: Column) -> Column:
    """What stands before the last separator of either kind; empty without one."""
    return F.regexp_extract(path, r"(?s)^(.*)[/\\][^/\\]*\z", 1)


def relative_to(path: Column, root: Column) -> Column:
    """The path below a root, the path itself when it lies elsewhere."""
    inside = F.coalesce(root, F.lit("")) != ""
    return F.when(inside & F.startswith(path, root), F.regexp_replace(F.substr(path, F.length(root) + 1), r"^[/\\]+", "")).otherwise(path)


def path_key(path: Column) -> Column:
    """Lower-case POSIX form: repeated, inner ``.`` and trailing separators go."""
    p = F.regexp_replace(F.regexp_replace(F.coalesce(path, F.lit("")), r"/(?:\.?/)+", "/"), r"(?<=.)/(?:\.)?\z|^\./(?=.)", "")
    return F.lower(p)


def slug(c: Column) -> Column:
    """A title as a file name."""
    return F.regexp_replace(F.regexp_replace(strip(c), r'[\\/:*?"<>|]', "_"), r"(?U)\s+", "_")


def model_id(name: Column) -> Column:
    """A model path as an identifier."""
    base = F.regexp_extract(F.regexp_replace(F.coalesce(name, F.lit("")), r"[/\\]+\z", ""), r"([^/]*)\z", 1)
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace(base, r"[^a-zA-Z0-9_\-.]", "_"), "_+", "_"), r"^[._]+|[._]+\z", "")
    return let(safe, lambda x: F.when(x == "", "default").otherwise(x))


# Markdown notes


def frontmatter(text: Column) -> Column:
    """Struct of frontmatter (null without) and body."""

    def split(t: Column) -> Column:
        def chosen(parts: Column) -> Column:
            has = t.startswith("---") & (F.size(parts) >= 3)
            body = F.when(has, strip(F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))), "---"))).otherwise(t)
            return F.struct(F.when(has, F.get(parts, F.lit(1))).alias("front"), body.alias("body"))

        return let(F.split(t, r"(?dm)^---\s*$"), chosen)

    return let(strip(F.coalesce(text, F.lit(""))), split)


def frontmatter_list(front: Column, key: str) -> Column:
    """Items of an inline ``key: [a, b]`` or else a block list."""
    inline, block = rf"(?dm)^{key}:\s*\[(.*?)\]", rf"(?dm)^{key}:\s*\n((?:\s*-\s*.+\n?)+)"
    items = F.filter(F.transform(F.split(F.regexp_extract(front, block, 1), LINE_END), lambda x: unquoted(F.regexp_replace(x, r"^\s*-\s*", ""))), lambda x: x != "")
    empty = F.array().cast("array<string>")
    return F.when(front.isNull(), empty).when(front.rlike(inline), listed(F.regexp_extract(front, inline, 1))).otherwise(items)


def frontmatter_keywords(front: Column) -> Column:
    """Words of the first keyword field, whichever it is."""
    value = F.regexp_extract(front, rf"(?dm)^(?:{'|'.join(KEYWORD_KEYS)}):\s*(.+)$", 1)
    return F.when(front.isNull(), F.array().cast("array<string>")).otherwise(listed(value, r"(?U)[\s,]+"))


def without_drawing(body: Column) -> Column:
    """Up to a heading ``Excalidraw Data``."""
    mark = r"(?dmi)^#+\s*Excalidraw\s+Data\b"
    return let(body, lambda b: F.when(b.rlike(mark), strip(F.split(b, mark, 2)[0])).otherwise(b))


def without_links(body: Column) -> Column:
    """Comments, embeds and bare addresses go; links become their labels."""
    for pattern, into in (
        (r"(?s)%%.*?%%", ""), (r"!\[\[.*?\]\]", ""), (r"!\[.*?\]\(.*?\)", ""),
        (r"\[\[(?:[^\]|]+\|)?([^\]]+)\]\]", "$1"), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"(?U)https?://\S+", ""),
    ):
        body = F.regexp_replace(body, pattern, into)
    return body


def hashtags(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit(r"(?U)(?:^|\s)#([^\s#.,;!?:/\\\[\]()]+)"), 1)


def is_noise(line: Column) -> Column:
    """Whether a trimmed line holds metadata, encoded data, or nothing but marks."""
    keys = "|".join(METADATA_KEYS)
    return (
        line.rlike(f"(?iu)^(?:{keys})")
        | line.rlike(r"^[A-Za-z0-9+/=]{30,}\z")
        | (line.rlike(r"%[0-9A-Fa-f]{2}%[0-9A-Fa-f]{2}") & (F.length(line) > 30))
        | line.rlike(r"(?U)^[:|\-\s*>`%]+\z")
    )


def clean_lines(body: Column) -> Column:
    """Lines trimmed, noise dropped, at most one empty line between others."""
    kept = F.filter(F.transform(lines(body), lambda x: strip(F.regexp_replace(x, r"[ \t]{2,}", " "))), lambda x: (x == "") | ~is_noise(x))
    return strip(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))


def plain(c: Column) -> Column:
    """Markdown as plain sentences."""
    for pattern, into in (
        (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"!\[\[[^\]]+\]\]", ""), (r"\[\[(?:[^\]|]+\|)?([^\]]+)\]\]", "$1"),
        (r"(?U)https?://[^\s)>]+", ""), (r"\|", " "), (r"(?dm)^#+\s*", ""), (r"(?dm)^\s*[-*+]\s+|^\s*[0-9]+\.\s+", ""), (r"[*_`~]", ""), (r"[ \t]+", " "),
    ):
        c = F.regexp_replace(c, pattern, into)
    return strip(c)


def sentences(c: Column) -> Column:
    return F.split(c, r"\n+|(?<=[。！？.?!])")


def edge_marks_gone(c: Column) -> Column:
    return strip(F.regexp_replace(strip(c), r"(?U)^[\s#\-*|>`()\[\]]+|[\s#\-*|>`()\[\]]+\z", ""))


def is_natural(s: Column) -> Column:
    """At least 8 characters; with Japanese ones, some that are no katakana, and a quarter of all."""
    japanese = F.regexp_count(s, F.lit(r"[぀-ヿ一-鿿]"))
    core = F.regexp_count(s, F.lit(r"[぀-ゟ一-鿿]"))
    return (F.length(s) >= 8) & ((japanese == 0) | ((core > 0) & (japanese / F.length(s) >= 0.25)))


def is_candidate_sentence(s: Column) -> Column:
    """A trimmed sentence that may stand for its chunk."""
    return (
        (F.length(s) >= 8)
        & (F.regexp_count(s, F.lit(r"(?U)[぀-ヿ㐀-䶿一-鿿\w]")) >= 6)
        & ~s.rlike(rf"(?i)\.(?:{'|'.join(FILE_NAME_MARKS)})")
        & is_natural(s)
    )


def preview(c: Column, n: int = 200) -> Column:
    return let(F.coalesce(c, F.lit("")), lambda x: F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit("..."))).otherwise(x))


def snippet(*sources: Column, n: int = 200) -> Column:
    """The first source with text, cut at n characters when it is longer without its tags."""
    first = F.coalesce(*(F.nullif(s, F.lit("")) for s in sources), F.lit(""))
    cut = lambda f: let(F.regexp_replace(f, r"<[^>]+>", ""), lambda bare: F.when(F.length(bare) > n, F.concat(F.substring(bare, 1, n), F.lit("..."))).otherwise(f))
    return let(first, cut)


def highlighted(c: Column, keywords: Column) -> Column:
    """Keywords of two characters or more marked, the longest first; marked text is left alone."""
    words = F.array_sort(F.array_distinct(F.filter(keywords, lambda k: F.length(k) >= 2)), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    safe = F.array_join(F.transform(words, lambda k: F.regexp_replace(k, r"([\\.\[\]{}()*+?^$|#&~\-])", r"\\$1")), "|")
    return F.when((F.size(words) == 0) | F.contains(c, F.lit("<mark>")), c).otherwise(F.regexp_replace(c, F.concat(F.lit("(?iu)("), safe, F.lit(")")), F.lit("<mark>$1</mark>")))


def relevance_tier(score: Column) -> Column:
    return F.when(score >= 0.70, "High").when(score >= 0.40, "Medium").otherwise("Low")


def with_model_prefix(c: Column, family: str | None, is_query: bool) -> Column:
    """The prefix that a model family expects, once."""
    if family not in MODEL_PREFIXES:
        return c
    query, passage = MODEL_PREFIXES[family]
    return F.when(c.startswith(query) | c.startswith(passage), c).otherwise(F.concat(F.lit(query if is_query else passage), c))


def html_escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def url_decoded(c: Column) -> Column:
    """Percent-decoded reference without query or fragment; a plus stays a plus."""
    return let(F.regexp_extract(c, r"^([^?#]*)", 1), lambda x: F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x))


def data_url(content: Column, mime: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64(content), r"[\r\n]", ""))


def term_key(normalised: Column) -> Column:
    """Key of an NFKC-normalised term: lower case without blanks, hyphens, underscores and long marks."""
    return F.regexp_replace(F.lower(normalised), "(?U)" + NFKC_MARKS, "")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0)
