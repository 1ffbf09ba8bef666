"""Review fields from fetched HTML pages (B9) as column expressions over a table of pages.

A page yields one row per review block; every field is taken from the first of its fallback
locations that exists in the block (also when it is empty there), else it is the field's default.
A block starts at an element that carries ``id_attr`` and runs to the next one; a field's element
ends at its own closing tag: tags of its name inside it are counted, so nested elements of one name keep their text (an element that is never
closed runs to the end of its block). Pages without blocks fall back to the non-empty
paragraphs of their ``<article>`` elements (of the page if there is none), with a positional id; a
paragraph ends at its closing tag or where a block element starts or ends.

Text is in document order: comments, scripts and styles go, tags become spaces, character
references (all names of HTML, and all numbers) are decoded in one pass, white space is collapsed. A name without semicolon counts
where HTML allows it and no letter or digit follows. NULL or
empty pages give no row. All of it runs in the JVM; a page is one row, so pages spread over tasks.
"""
from __future__ import annotations

import html.entities
import json
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import WS

COLUMNS = ("page_id", "block", "review_id", "rating", "date_text", "review_text", "size_opt1", "size_opt2")

UNSEEN = r"(?is)<!--.*?-->|<(?:script|style)\b[^>]*>.*?</(?:script|style)\s*>"
TAG = r"(?is)<[a-z/!?][^>]*>"
PARAGRAPH = r"(?i)<p(?:\s[^>]*)?>"
PARAGRAPH_END = (r"(?i)</p\s*>|</?(?:article|aside|blockquote|div|dl|figure|footer|form|h[1-6]|header|hr|main|nav|ol|pre|"
                 r"section|table|ul)\b")
#: looked up first, as a map is searched from its start
FREQUENT = ("amp;", "lt;", "gt;", "quot;", "nbsp;", "apos;", "copy;", "middot;", "hellip;", "ndash;", "mdash;")
VOID = "area|base|br|col|embed|hr|img|input|link|meta|param|source|track|wbr"


@dataclass
class FieldRules:
    """Ordered fallback locations per field, each a class name inside the block."""
    id_attr: str = "data-content-id"
    rating: tuple = ("review-rating", "rating")
    date: tuple = ("review-date", "date")
    text: tuple = ("review-content", "review-text")
    size: tuple = ("review-option", "option")
    fallback_scope: str = "article"


def block_pattern(attr: str) -> str:
    return rf"""(?is)<[a-z][^>]*\s{re.escape(attr)}\s*=\s*["']([^"']*)["'][^>]*>"""


def scope_pattern(tag: str) -> str:
    return rf"(?is)<{tag}\b[^>]*>(.*?)(?:</{tag}\s*>|\z)"


def _parts(source: Column, tag: str) -> Column:
    """The parts of ``source`` inside elements ``tag``, cut at the tags of these; null without such an element."""
    mark = rf"(?i)</?{tag}(?=[\s/>])[^>]*>"
    marks = F.regexp_extract_all(source, F.lit(mark), 0)
    depths = F.aggregate(marks, F.array(F.lit(0)), lambda a, m: F.concat(a, F.array(F.greatest(
        F.element_at(a, -1) + F.when(m.startswith("</"), -1).otherwise(1), F.lit(0)))))
    parts = F.filter(F.arrays_zip(depths.alias("depth"), F.split(source, mark).alias("part")), lambda x: x["depth"] > 0)
    return F.when(F.size(parts) > 0, F.transform(parts, lambda x: x["part"]))


def _opening(cls: str) -> str:
    """Pattern of a start tag of this class; group 1 is its name."""
    quoted = rf"""["'](?:[^"']*\s)?{re.escape(cls)}(?:\s[^"']*)?["']"""
    return rf"(?is)<([a-z][a-z0-9]*)\b[^>]*\sclass\s*=\s*{quoted}[^>]*>"


def _after(text: Column, cls: str) -> tuple[Column, Column]:
    """Name of the first element of a class, and what follows its start tag (null without one)."""
    return F.nullif(F.regexp_extract(text, _opening(cls), 1), F.lit("")), F.get(F.split(text, _opening(cls), 2), F.lit(1))


def _inner(name: Column, pieces: Column) -> Column:
    """The element's inner HTML: ``pieces`` are what follows its start tag, cut at closing tags of its name. A fold counts how
    many of them pass until as many were closed as opened."""
    opened = F.concat(F.lit("(?i)<"), name, F.lit(r"(?=[\s/>])"))
    step = lambda a, p: F.when(a["depth"] == 0, a).otherwise(
        F.struct((a["depth"] + F.regexp_count(p, opened) - 1).alias("depth"), (a["n"] + 1).alias("n")))
    n = F.aggregate(pieces, F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n")), step)["n"]
    return F.when(F.lower(name).rlike(f"^(?:{VOID})$"), F.lit("")).otherwise(F.array_join(F.slice(pieces, F.lit(1), n), " "))


def _numeric_reference(p: Column) -> Column:
    """What follows ``&#``: the character and the rest, or unchanged where it names none."""
    decimal, hexa = F.regexp_extract(p, r"^([0-9]{1,7});?", 1), F.regexp_extract(p, r"^[xX]([0-9a-fA-F]{1,6});?", 1)
    code = F.when(decimal != "", decimal.try_cast("int")).when(hexa != "", F.conv(hexa, 16, 10).try_cast("int"))
    valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    rest = F.regexp_replace(p, r"^(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});?", "")
    return F.when(valid, F.concat(char, rest)).otherwise(F.concat(F.lit("&#"), p))


def _names() -> Column:
    """Map of all names of HTML's character references, as one constant."""
    every = {n: html.entities.html5[n] for n in FREQUENT} | html.entities.html5
    return F.from_json(F.lit(json.dumps(every)), "map<string,string>")


def _reference(p: Column) -> Column:
    """What follows ``&``: the character and the rest, or unchanged where it names none."""
    name = F.regexp_extract(p, r"^[A-Za-z][A-Za-z0-9]*;?", 0)
    char = _names()[name]
    return (F.when(p.startswith("#"), _numeric_reference(F.substr(p, F.lit(2))))
            .when(char.isNotNull(), F.concat(char, F.substr(p, F.length(name) + 1))).otherwise(F.concat(F.lit("&"), p)))


def _decoded(t: Column) -> Column:
    """Text with character references -> decoded, each once."""
    pieces = F.split(t, "&")
    return F.concat(F.element_at(pieces, 1), F.array_join(F.transform(F.slice(pieces, 2, 1 << 30), _reference), ""))


def html_text(source: Column) -> Column:
    t = F.regexp_replace(source, TAG, " ")
    t = F.when(t.contains("&"), _decoded(t)).otherwise(t)
    return F.trim(F.regexp_replace(t, f"[{WS}]+", " "))


def _found(rows: DataFrame, classes: list[str], second: Sequence[str]) -> DataFrame:
    """Adds column ``in_<i>``: the inner HTML of the first element of each class in ``body`` (and ``in_2_<i>`` of the second, for classes of
    ``second``). One projection per step, as each step reads the one before more than once."""
    body = F.when(F.col("id").isNotNull(), F.col("body"))
    part = lambda i, of, c: [x.alias(f"{k}_{i}") for k, x in zip(("name", "rest"), _after(of, c))]
    numbered = [(str(i), c) for i, c in enumerate(classes)]
    rows = rows.select("*", *[x for i, c in numbered for x in part(i, body, c)])
    rows = rows.select("*", *[x for i, c in numbered if c in second for x in part(f"2_{i}", F.col(f"rest_{i}"), c)])
    closing = lambda i: F.split(F.col(f"rest_{i}"), F.concat(F.lit("(?i)</"), F.col(f"name_{i}"), F.lit(r"\s*>")))
    every = [i for i, _ in numbered] + [f"2_{i}" for i, c in numbered if c in second]
    rows = rows.select("page_id", "block", "id", "body", *[F.col(f"name_{i}") for i in every], *[closing(i).alias(f"pieces_{i}") for i in every])
    return rows.select("page_id", "block", "id", "body", *[_inner(F.col(f"name_{i}"), F.col(f"pieces_{i}")).alias(f"in_{i}") for i in every])


def _fields(rules: FieldRules, classes: list[str]) -> dict[str, Column]:
    """Columns of a row (page_id, block, id, body, in_*); ``id`` is null for a paragraph."""
    found = F.col("id").isNotNull()
    inner = lambda c: F.col(f"in_{classes.index(c)}")
    first = lambda some: html_text(F.coalesce(*[inner(c) for c in some]))
    sizes = F.filter(F.array(*[F.col(f"in_{k}{classes.index(c)}") for c in rules.size for k in ("", "2_")]), lambda x: x.isNotNull())
    default = lambda c, d: F.when(found, F.coalesce(c, F.lit(d))).otherwise(F.lit(d))
    place = F.concat_ws("-", F.col("page_id").cast("string"), F.col("block").cast("string"))
    return {"review_id": F.when(F.col("id") == "", F.lit(K.DEFAULT_REVIEW_ID)).otherwise(F.coalesce("id", place)),
            "rating": default(first(rules.rating), K.DEFAULT_RATING),
            "date_text": F.when(found, first(rules.date)),
            "review_text": F.coalesce(html_text(F.when(found, F.coalesce(*[inner(c) for c in rules.text])).otherwise(F.col("body"))),
                                      F.lit(K.DEFAULT_REVIEW_TEXT)),
            "size_opt1": F.when(found, html_text(F.get(sizes, F.lit(0)))),
            "size_opt2": F.when(found, html_text(F.get(sizes, F.lit(1))))}


def page_reviews(pages: DataFrame, rules: FieldRules | None = None) -> DataFrame:
    """pages(page_id, html) -> one row per review block (landing-row fields).

    ``block`` is the position of the block or paragraph in its page (empty paragraphs count)."""
    rules = rules or FieldRules()
    start = block_pattern(rules.id_attr)
    h = pages.select("page_id", F.regexp_replace("html", UNSEEN, " ").alias("h"))
    h = h.select("page_id", "h", F.regexp_extract_all("h", F.lit(start), 1).alias("ids"),
                 _parts(F.col("h"), rules.fallback_scope).alias("scopes"))
    bodies = F.slice(F.split("h", start), 2, 1 << 30)
    blocks = F.arrays_zip(F.col("ids").alias("id"), bodies.alias("body"))
    scopes = F.coalesce("scopes", F.array("h"))          # an article's tags end paragraphs, so none spans two parts
    cut = F.flatten(F.transform(scopes, lambda s: F.slice(F.split(s, PARAGRAPH), 2, 1 << 30)))
    paragraphs = F.transform(cut, lambda p: F.struct(F.lit(None).cast("string").alias("id"),
                                                     F.element_at(F.split(p, PARAGRAPH_END, 2), 1).alias("body")))
    rows = h.select("page_id", F.posexplode(F.when(F.size("ids") > 0, blocks).otherwise(paragraphs)).alias("block", "r"))
    rows = rows.select("page_id", "block", "r.id", "r.body")
    classes = list(dict.fromkeys([*rules.rating, *rules.date, *rules.text, *rules.size]))
    rows = _found(rows, classes, rules.size)
    out = rows.select("page_id", "block", "id", *[c.alias(n) for n, c in _fields(rules, classes).items()])
    return out.where(F.col("id").isNotNull() | (F.col("review_text") != "")).select(*COLUMNS)
