"""HTML main text by composite text density.

A page is cut into tags and texts in one pass and kept as parent links. For every node the composite
density is its characters per tag, adjusted for links; a node's density sum adds the densities of its
children. The node with the greatest sum is the core; the least density on the path from body to it
is the threshold above which subtrees beside that path also belong to the text, as do text, headings and
paragraphs that stand directly in an element of the path (unless mostly links), and an h1 before the core
where the text has none. Where the path has a main element it starts there instead of at body. An article on the path
lets the other articles beside it in, below the threshold too, unless they are mostly links.

Menus, footers, adverts and the like
(by tag, role, or whole class or id) and hidden elements are cut out before; inside an article a name
counts on container elements only: names of comments, adverts, sign-up and cookie boxes (``SURE_NAMES``) always, other names
only where links or density agree. Blocks are joined by two line feeds.

Cases: a null or empty html, and a page without text, give an empty text; broken markup is read as far as
it goes: an unclosed tag, comment or script at the end is markup; repeated rows and null ids are
ordinary rows; extra columns are ignored.
"""
from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package
from .common import table

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|iframe|select)(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
    r".*?(?:</(?P=raw)(?=[\s/>])[^>]*+>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)"
    r"|</[^>]*+(?:>|\Z)", re.S | re.I)
ATTR = re.compile(r"""([^\s/>=]+)(?:\s*=\s*("[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s"'>][^\s>]*))?""")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption
legend optgroup option""".split())
CUT_TAGS = frozenset("nav aside footer form button dialog menu head fieldset audio video canvas svg annotation annotation-xml".split())
#: start tags that end an open svg or math element, as HTML parsers do
BREAKOUT = frozenset("""b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta
nobr ol p pre ruby s small span strong strike sub sup table tt u ul var article aside footer header main nav section""".split())
#: elements of svg and math that hold HTML
HTML_INSIDE = frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
CUT_NAMES = frozenset("""ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner
sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices comment comments
commentlist replies respond discussion disqus share sharing social related recommended newsletter subscribe subscription signup
login popup modal overlay widget widgets toolbar pagination pager masthead topbar skip""".split())
#: of these, names that hold no part of an article even where they are as dense as one
SURE_NAMES = frozenset("""ad ads advert adverts advertisement advertisements advertising sponsored promo cookie cookies consent gdpr
comment comments commentlist replies respond disqus newsletter subscribe subscription signup login related recommended""".split())
#: words that say where a part stands; a name made of these and of words of CUT_NAMES is boilerplate too
PLACE_WORDS = frozenset("""site page main top bottom left right primary secondary wrapper wrap container box block list inner outer
bar area slot unit list section thread form""".split())
CONTAINERS = frozenset("div section ul ol dl table article center details".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
SHORT_TEXT = frozenset("p blockquote pre li dt dd figcaption caption".split())
#: start tags that close an open element of the same kind (up to the nearest container)
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
          "th": ("td", "th"), "option": ("option",)}
HOLDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}


def _boilerplate_name(name: str, words: frozenset) -> bool:
    """A whole class or id: one of ``words``, or made of them and of words of place only."""
    if name in words:
        return True
    parts = [x for x in re.split(r"[-_]+", name) if x]
    return not words.isdisjoint(parts) and all(x in words or x in PLACE_WORDS for x in parts)


def _sure_name(name: str) -> bool:
    """A whole class or id with a word of ``SURE_NAMES``, made of words of boilerplate and place only."""
    parts = [x for x in re.split(r"[-_]+", name) if x]
    return not SURE_NAMES.isdisjoint(parts) and all(x in CUT_NAMES or x in PLACE_WORDS for x in parts)


def _cut(tag: str, attrs: str, inside: bool) -> int:
    """2: boilerplate whatever it holds; 1: unless it holds the article; 3: by name ``inside`` an
    article, where density or links must agree; 0: no."""
    if tag in CUT_TAGS or tag == "header" and not inside:
        return 2 if tag != "form" else 1
    if tag in ("html", "body", "main") or not attrs:
        return 0
    named = False
    for name, value in ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return 1
        if name == "style" and re.search(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", value):
            return 1
        if name == "role" and not CUT_ROLES.isdisjoint(value.split()):
            return 1
        # the id of a heading or paragraph is a link target, not a part of the page
        if tag in CONTAINERS and name in ("class", "id") or name == "class" and not inside and tag not in HEADINGS:
            words = CUT_NAMES if inside or tag == "article" else CUT_NAMES | {"header"}
            named = named or any(_boilerplate_name(x, words) for x in value.split())
            if inside and any(_sure_name(x) for x in value.split()):
                return 1
    return 0 if not named else 3 if inside else 1


class Page:
    """Elements in document order: tag, parent, cut mark; and texts with their element."""

    def __init__(self, source: str):
        self.tag, self.parent, self.cut = ["#root"], [-1], [0]
        self.inside = [False]                                # an article or main element is around
        self.opened: dict[str, int] = {}                     # open elements by tag
        self.items: list[tuple[int, str | None]] = []       # (element, text), or None where a block starts or ends
        stack = [0]
        foreign = False                                      # whether an svg or math element may be open
        at = 0
        for m in TOKEN.finditer(source):
            if m.start() > at:
                self.items.append((stack[-1], source[at:m.start()]))
            at = m.end()
            tag = m["tag"] or m["tag2"]
            if not tag:
                continue
            tag = tag.lower()
            if m["end"] or m["end2"]:
                self._close(stack, tag)
                continue
            attrs = m["attrs"] or m["attrs2"] or ""
            if foreign and tag in BREAKOUT:
                foreign = self._break_out(stack)
            if tag in BLOCK and tag != "hr":
                self._implied(stack, tag)
            if tag == "br":
                self.items.append((stack[-1], " "))
                continue
            me, up = len(self.tag), stack[-1]
            inside = self.inside[up] or self.tag[up] in ("article", "main")
            self.inside.append(inside)
            self.tag.append(tag)
            self.parent.append(stack[-1])
            self.cut.append(_cut(tag, attrs, inside))
            if tag in BLOCK:
                self.items.append((me, None))
            if tag not in VOID and not attrs.endswith("/"):
                stack.append(me)
                self.opened[tag] = self.opened.get(tag, 0) + 1
                foreign = foreign or tag in ("svg", "math")
        if at < len(source):
            self.items.append((stack[-1], source[at:]))

    def _pop(self, stack: list[int], k: int) -> None:
        """Close the open elements from place ``k`` on."""
        for x in stack[k:]:
            self.opened[self.tag[x]] -= 1
        del stack[k:]

    def _close(self, stack: list[int], tag: str) -> None:
        if not self.opened.get(tag):
            return
        for k in range(len(stack) - 1, 0, -1):
            if self.tag[stack[k]] == tag:
                if any(self.tag[x] in BLOCK for x in stack[k:]):
                    self.items.append((self.parent[stack[k]], None))
                self._pop(stack, k)
                return
            if tag not in BLOCK and self.tag[stack[k]] in BLOCK:
                return                                       # an inline end tag closes nothing beyond its block

    def _break_out(self, stack: list[int]) -> bool:
        """Close an svg or math element that was left open; whether one is open still."""
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[k]]
            if tag in HTML_INSIDE:
                return True
            if tag in ("svg", "math"):
                self._pop(stack, k)
                return any(self.tag[x] in ("svg", "math") for x in stack)
        return False

    def _implied(self, stack: list[int], tag: str) -> None:
        ends = CLOSES.get(tag, ("p",))
        stop = HOLDS.get(tag, ())
        if not any(self.opened.get(x) for x in ends):
            return
        for k in range(len(stack) - 1, 0, -1):
            name = self.tag[stack[k]]
            if name in ends:
                self.items.append((self.parent[stack[k]], None))
                self._pop(stack, k)
                return
            if name in stop or name in BLOCK and name not in CLOSES and tag not in HOLDS:
                return

    def drop_boilerplate(self) -> list[bool]:
        """Whether each element is cut out, itself or by an ancestor."""
        n = len(self.tag)
        holds = [False] * n                                  # an article, main or top heading below
        for k in range(n - 1, 0, -1):
            if self.tag[k] in ("article", "main", "h1") and not self.cut[k] or holds[k]:
                holds[self.parent[k]] = True
        gone = [False] * n
        for k in range(1, n):
            gone[k] = gone[self.parent[k]] or self.cut[k] == 2 or self.cut[k] == 1 and not holds[k]
        if 3 in self.cut:
            self._drop_named(gone, holds)
        return gone

    def _drop_named(self, gone: list[bool], holds: list[bool]) -> None:
        """Cut parts with a boilerplate name inside an article that are mostly links, or less than half
        as dense as the rest of the article."""
        chars, tags, link_chars, _ = counts(self, gone)
        host = [-1] * len(self.tag)                          # the nearest article or main around
        for k in range(1, len(self.tag)):
            up = self.parent[k]
            host[k] = up if self.tag[up] in ("article", "main") else host[up]
            if gone[up]:
                gone[k] = True
            elif self.cut[k] == 3 and not holds[k] and chars[k] and host[k] > 0:
                rest = (chars[host[k]] - chars[k]) / max(tags[host[k]] - tags[k] - 1, 1)
                gone[k] = 2 * link_chars[k] >= chars[k] or 2 * chars[k] / max(tags[k], 1) < rest


def counts(page: Page, gone: list[bool]) -> tuple[list[int], list[int], list[int], list[int]]:
    """Characters, tags, and both in links, below each element."""
    n = len(page.tag)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for k in range(1, n):
        in_link[k] = page.tag[k] == "a" or in_link[page.parent[k]]
    for k, text in page.items:
        if text is not None and not gone[k]:
            c = len(text) - text.count(" ") if text.isspace() else len(text.strip())
            chars[k] += c
            if in_link[k]:
                link_chars[k] += c
    for k in range(n - 1, 0, -1):
        if gone[k]:
            continue
        p = page.parent[k]
        chars[p] += chars[k]
        link_chars[p] += link_chars[k]
        tags[p] += tags[k] + 1
        link_tags[p] += link_tags[k] + (page.tag[k] == "a")
    return chars, tags, link_chars, link_tags


def densities(page: Page, gone: list[bool]) -> tuple[list[float], list[float]]:
    """Composite text density of each element, and the sum over its children."""
    n = len(page.tag)
    chars, tags, link_chars, link_tags = counts(page, gone)
    ratio = link_chars[0] / max(chars[0], 1)
    density, total = [0.0] * n, [0.0] * n
    for k in range(n - 1, -1, -1):
        c, t = chars[k], max(tags[k], 1)
        if c and not gone[k]:
            lc, lt = link_chars[k], link_tags[k]
            base = math.log(c * lc / max(c - lc, 1) + ratio * c + math.e)
            density[k] = c / t * max(math.log(c / max(lc, 1) * t / max(lt, 1) + 1e-9), 0.0) / base
            if k:
                total[page.parent[k]] += density[k]
    return density, total


def _beside(page: Page, gone: list[bool], chosen: list[bool], path: set[int], core: int, headline: bool) -> list[list[str]]:
    """The texts of the chosen elements by block, with those beside them: blocks that stand directly in an
    element of ``path`` or are headings or paragraphs there, unless mostly links, and, with ``headline``,
    h1 elements before the core. A heading after the core needs a chosen block right after it."""
    n = len(page.tag)
    host, in_link, h1 = [0] * n, [False] * n, [False] * n    # host: the nearest block element
    for k in range(1, n):
        up, tag = page.parent[k], page.tag[k]
        host[k] = k if tag in BLOCK else host[up]
        in_link[k] = tag == "a" or in_link[up]
        h1[k] = tag == "h1" or h1[up]
    found, now = [], []
    for k, text in [*page.items, (0, None)]:
        if text is None:
            if now:
                found.append(now)
            now = []
        elif not gone[k]:
            now.append((k, text))
    out, follows = [], False
    for block in reversed(found):
        shown = [(k, len(t.strip())) for k, t in block if t.strip()]
        if not shown:
            continue
        first = host[shown[0][0]]
        heading = page.tag[first] in HEADINGS
        near = first in path or page.parent[first] in path and (heading or page.tag[first] in SHORT_TEXT)
        links = sum(c for k, c in shown if in_link[k])
        take = (near and (not heading or first < core or follows) and 2 * links < sum(c for _, c in shown)
                or headline and first < core and h1[first])
        texts = [t for k, t in block if take or chosen[k]]
        follows = bool(texts)
        if texts:
            out.append(texts)
    return out[::-1]


def main_text(source: str | None) -> str:
    """The page's article: blocks joined by two line feeds, white space inside a block as one blank."""
    if not source:
        return ""
    page = Page(source)
    gone = page.drop_boilerplate()
    density, total = densities(page, gone)
    n = len(page.tag)
    core = max(range(n), key=lambda k: (total[k] if total[k] > 0 else density[k] if not gone[k] else -1.0, -k))
    path = [core]
    while path[-1] > 0:
        path.append(page.parent[path[-1]])
    chosen = [False] * n                                     # roots of the text's subtrees, then all below them
    chars, _, link_chars, _ = counts(page, gone)
    outer = next((i for i, k in enumerate(path) if page.tag[k] in ("main", "body")), len(path) - 1)
    beside, on_path = set(path[1:outer + 1]), set(path)
    if any(page.tag[k] == "article" for k in path):
        for k in range(path[outer] + 1, n):                  # an article is chosen with the articles beside it
            chosen[k] = page.tag[k] == "article" and k not in on_path and not gone[k] and 2 * link_chars[k] < chars[k]
    threshold = min(density[k] for k in path[:outer + 1])
    for k in range(1, n):
        if page.parent[k] in beside and k not in on_path and not gone[k] and density[k] >= threshold and density[k] > 0:
            chosen[k] = True
    chosen[core] = True
    for k in range(1, n):
        chosen[k] = chosen[k] or chosen[page.parent[k]]
    headline = not any(chosen[k] and not gone[k] and page.tag[k] == "h1" for k in range(1, n))
    blocks = _beside(page, gone, chosen, beside, core, headline)
    lines = (" ".join(entities.unescape("".join(b)).split()) for b in blocks if b)
    return "\n\n".join(x for x in lines if x)


def extract(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars."""
    def run(batches):
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column("html")]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"])
    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return extract(table(spark, sf_dir, "pages"))
