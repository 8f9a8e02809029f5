"""Column builders for text; everything stays in JVM expressions."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as in Unicode text processing, tags, article markers and field names.
SPACE = r"[\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
TAG = r"<[^>]+>"
LINE_BREAK = r"\r\n|[\n\r\x{b}\x{c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
BLOCK_BREAK = r"(?i)\n\s*(?:---+|ARTICLE\s+\d+|RESULT\s+\d+)\s*\n|\n{2,}"
FIELD_LINE = r"(?i)^(title|headline|date|published|source|url|link|content|summary)\s*:\s*(.*)$"
BLOCK_FIELDS = {
    "title": ("title", "headline"), "date": ("date", "published"), "source": ("source",), "url": ("url", "link"),
    "content": ("content", "summary"),
}
JSON_FIELDS = {
    "title": ("title", "headline", "name"),
    "date": ("published_date", "publishedAt", "date", "published"),
    "source": ("source", "domain", "publisher"),
    "url": ("url", "link"),
    "content": ("raw_content", "content", "description", "snippet", "text"),
}
JSON_LISTS = ("results", "articles", "items")
# Refusal phrases, section marks and the texts shown around them.
REFUSALS = (
    "I'm not able to provide", "I cannot provide", "I apologize, but I cannot", "I don't feel comfortable",
    "violated our content policy",
)
SECTIONS = (("ITEM DETAILS:", "## Item Details"), ("SIMILAR ITEMS:", "## Similar Items"))
EMPTY_REPLY = "# Fashion Analysis\n\nNo detailed analysis was generated. Please refer to the item details below."
REPLY_TITLE = "# Fashion Analysis\n\n"
REPLY_INTRO = "Here are the items detected in your image:\n\n"
# Markdown rewrites (pattern, replacement), applied in this order.
MARKDOWN_HTML = (
    (r"\*\*(.*?)\*\*", "<p><strong>$1</strong></p>"),
    (r"(?m)^\s*\*\s(.*)", "<li>$1</li>"),
    (r"(?s)(<li>.*?</li>)+", "<ul>$0</ul>"),
    (r"</p>(?=<p>)", "</p><br>"),
    (r"(\n|\\n)+", "<br>"),
)


def clean(c: Column | str) -> Column:
    """Without tags, single-spaced, trimmed; null becomes empty."""
    c = F.col(c) if isinstance(c, str) else c
    plain = F.regexp_replace(F.coalesce(c, F.lit("")), TAG, " ")
    return F.trim(F.regexp_replace(plain, f"{SPACE}+", " "))


def first_filled(*cols: Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def article_items(text: Column) -> Column:
    """JSON payload to an array of string maps: a list, an object holding one, or the object itself."""
    text = F.trim(text)
    obj = F.from_json(text, "map<string,string>")
    held = F.coalesce(*[F.when(F.try_element_at(obj, F.lit(k)) != "[]", F.try_element_at(obj, F.lit(k))) for k in JSON_LISTS])
    items = F.when(text.startswith("["), F.from_json(text, "array<string>")).when(
        text.startswith("{"), F.coalesce(F.from_json(held, "array<string>"), F.array(text)))
    objects = F.filter(items, lambda i: F.trim(i).startswith("{"))
    return F.transform(objects, lambda i: F.from_json(i, "map<string,string>"))


def article_struct(item: Column) -> Column:
    """title, date, source, url and content from the alternative keys of one item."""
    return F.struct(*[
        clean(first_filled(*[F.try_element_at(item, F.lit(k)) for k in keys])).alias(name) for name, keys in JSON_FIELDS.items()])


def block_lines(block: Column) -> Column:
    """Lines of a block as (key, value): the field name in lower case, or an empty key for other lines."""

    def parse(line: Column) -> Column:
        key = F.lower(F.regexp_extract(line, FIELD_LINE, 1))
        return F.struct(key.alias("key"), F.when(key == "", line).otherwise(F.regexp_extract(line, FIELD_LINE, 2)).alias("value"))

    return F.transform(F.transform(F.split(block, LINE_BREAK), lambda s: F.trim(s)), parse)


def block_struct(lines: Column) -> Column:
    """The article fields from parsed lines; the last line of a kind wins, the rest is content."""

    def last(names: Sequence[str]) -> Column:
        hits = F.filter(lines, lambda s: s["key"].isin(list(names)))
        return clean(F.try_element_at(hits, F.lit(-1))["value"])

    rest = clean(F.array_join(F.transform(F.filter(lines, lambda s: s["key"] == ""), lambda s: s["value"]), " "))
    parts = {n: last(k) for n, k in BLOCK_FIELDS.items()}
    parts["content"] = F.concat_ws(" ", F.nullif(parts["content"], F.lit("")), F.nullif(rest, F.lit("")))
    return F.struct(*[c.alias(n) for n, c in parts.items()])


def identity(url: Column, title: Column) -> Column:
    """Lower-case url without trailing slashes, else the letters and digits of the title."""
    by_url = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), "/+$", "")
    by_title = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+", "")
    return first_filled(by_url, by_title)


def main_points(text: Column, limit: int = 3, shortest: int = 40) -> Column:
    sentences = F.transform(F.split(clean(text), r"(?<=[.!?])\s+"), lambda s: F.trim(s))
    return F.slice(F.filter(sentences, lambda s: F.length(s) >= shortest), 1, limit)


def digest(number: Column, title: Column, date: Column, source: Column, url: Column, points: Column) -> Column:
    """Markdown summary of one article."""
    filled = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"**{label}:** "), c))
    head = F.concat(F.lit("### "), number.cast("string"), F.lit(". "), F.coalesce(F.nullif(title, F.lit("")), F.concat(F.lit("Article "), number.cast("string"))))
    bullets = F.when(F.size(points) > 0, F.array_join(F.transform(points, lambda p: F.concat(F.lit("- "), p)), "\n")).otherwise(
        "- No usable article description was supplied.")
    return F.concat_ws("\n", head, filled("Date", date), filled("Source", source), bullets, filled("URL", url))


def markdown_html(c: Column) -> Column:
    for pattern, repl in MARKDOWN_HTML:
        c = F.regexp_replace(c, pattern, repl)
    return c


def _bullets(c: Column) -> Column:
    return F.regexp_replace(c, r"(?m)^\* ", "- ")


def response_cleanup(c: Column) -> Column:
    """Tidy a generated reply: keep the item section of refusals, escape $, mark sections and bullets."""
    refused = F.lit(False)
    for phrase in REFUSALS:
        refused = refused | c.contains(phrase)
    escaped = F.replace(c, F.lit("$"), F.lit("\\$"))
    section, normal = escaped, escaped
    for mark, title in reversed(SECTIONS):
        tail = F.trim(F.split_part(c, F.lit(mark), F.lit(2)), F.lit(" \n\t\r"))
        kept = F.concat(F.lit(REPLY_TITLE + REPLY_INTRO), _bullets(F.concat(F.lit(f"{title}\n\n"), tail)))
        section = F.when(c.contains(mark), kept).otherwise(section)
    for mark, title in SECTIONS:
        normal = F.replace(normal, F.lit(mark), F.lit(title))
    normal = _bullets(F.when(normal.startswith("#"), normal).otherwise(F.concat(F.lit(REPLY_TITLE), normal)))
    return F.when(F.coalesce(c, F.lit("")) == "", EMPTY_REPLY).when(refused, section).otherwise(normal)


def verification(c: Column) -> Column:
    """Struct from 'key: value' lines; bracket lists become arrays, missing keys get defaults."""
    lines = F.split(c, "\n")

    def value(key: str) -> Column:
        hit = F.filter(lines, lambda s: F.lower(F.trim(F.split_part(s, F.lit(":"), F.lit(1)))) == key)
        hit = F.filter(hit, lambda s: s.contains(":"))
        line = F.try_element_at(hit, F.lit(-1))
        return F.trim(F.substring(line, F.locate(":", line) + 1, F.length(line)))

    def items(key: str) -> Column:
        v = value(key)
        inner = F.substring(v, F.lit(2), F.length(v) - 2)
        each = F.filter(F.split(inner, ","), lambda s: F.trim(s) != "")
        unquoted = F.transform(each, lambda s: F.trim(F.trim(F.trim(s), F.lit('"')), F.lit("'")))
        return F.when(v.startswith("[") & v.endswith("]"), unquoted).otherwise(F.array().cast("array<string>"))

    return F.struct(
        F.coalesce(F.upper(value("supported")), F.lit("NO")).alias("supported"), items("unsupported claims").alias("unsupported_claims"),
        items("contradictions").alias("contradictions"), F.coalesce(F.upper(value("relevant")), F.lit("NO")).alias("relevant"),
        F.coalesce(value("additional details"), F.lit("")).alias("additional_details"))


def verification_report(v: Column) -> Column:
    """The parsed verification as a short text."""
    listed = lambda c: F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise("None")
    return F.concat(
        F.lit("**Supported:** "), v["supported"], F.lit("\n**Unsupported Claims:** "), listed(v["unsupported_claims"]),
        F.lit("\n**Contradictions:** "), listed(v["contradictions"]), F.lit("\n**Relevant:** "), v["relevant"],
        F.lit("\n**Additional Details:** "), F.coalesce(F.nullif(v["additional_details"], F.lit("")), F.lit("None")), F.lit("\n"))
