"""Main text of web pages, by deducing each host's template from equivalence classes.

A page's tokens are its elements, told apart by their path of tags, classes and
ids, and its text runs, told apart by their element and their words. Over the
pages of a host a token has an occurrence vector: how often it is on each page.
Tokens with one vector form an equivalence class. Classes that are on two pages
at least and on more than half of the host's are frequent; a frequent class is
valid if its members come in one order on every page (again and again, if they
come several times), and it nests if all of it lies between the same two
members of the class of all pages. Valid, nested classes are the template. Its
text runs are the template's words; what lies between is in its slots, which
hold data.

Vectors are never built: a product of the page's hash and the count is summed
modulo 2**64, so that equal vectors are equal sums, and every task adds up its
own pages before the shuffle; a host with a third of all pages is as cheap as
any. A second pass over the pages, with their host's classes, checks order and
nesting.

Extraction reads the page again with its host's template.

1. The article's region: an ``article``, else a ``main`` element where the page
   marks one; else from the body down, at every element the child that holds
   more than half of the slots' text, until an element has slot text right in
   it or in paragraphs of its own, or a heading would be left outside.
2. From it goes the template's text (within a marked article only that of
   unmarked boxes: repeated paragraphs and headings there are the author's),
   and what nested classes show to be records with words of their own, such as
   reader comments with their "reply".
3. Where text varies, classes can't tell an advert from an article. There the
   markup decides: elements whose tag or role, or all of whose class's or id's
   words, say that they are menus, headers, footers, sidebars, notices, adverts,
   forms, scripts, styles or comments go.
4. What remains are blocks: character references decoded, white space made one
   space, a line each.

Defined cases: null and empty pages have the empty text and no part in vectors;
a page without a host shares the template of those; a host's only page has no
template, because nothing is repeated; broken markup is read as far as it goes:
only scripts and styles that are never closed take the rest of the page; the
words of formulas stay; a repeated page counts once; nesting may be of any
depth; an empty table works; extra columns are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import append_columns, durable, sliced, small

# Fixed values of HTML: elements without content, elements whose content is not markup, and block elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|textarea|title|iframe|xmp|noembed|noframes"
#: Elements whose content is a picture or stands in for what is shown: set aside where they are closed.
INSTEAD = frozenset("svg canvas object audio video template noscript".split())
FOREIGN = frozenset(("svg", "math"))
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset(("h1", "h2"))
#: Blocks that hold running text: never taken for the article's region.
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table tbody thead tfoot tr td th address figcaption".split())
#: An open element that an opening one of these closes, up to the nearest of the second.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

#: What is not the article: by tag, by role, and by name, if a class's or id's words are all in these two sets and one is in the first.
ASIDE_TAGS = frozenset("head nav header footer aside form menu dialog button select search".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
ASIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense adsbygoogle banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar header masthead footer cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus discussion reply replies respond response responses share sharing related recommended toolbar".split()
)
NEUTRAL = frozenset("site page top bottom left right main primary secondary box bar area list item section container wrapper wrap inner outer block links link widget unit slot side reader readers user users social post form policy skip to content".split())
ARTICLE = frozenset(("article", "main"))

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|(<({RAW})(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>)(?:.*?(</\2\s*>)|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?(?=[\s/]|$)", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: Bytes of templates, as text, that are sent to every executor instead of joined by a shuffle.
MOST_BROADCAST = 16 << 20
_MASK = (1 << 64) - 1


def markup(html: str) -> tuple[list[tuple[int, int, str, str, str]], set[int]]:
    """(start, end, slash, tag or nothing, attributes) of each token, and where closed elements of INSTEAD and FOREIGN start."""
    found, closed, at = [], set(), 0
    opened: dict[str, list[int]] = {tag: [] for tag in INSTEAD | FOREIGN}
    while token := TOKEN.search(html, at):
        at = token.end()
        if token[1] and ((token[1].endswith("/>") and (opened["svg"] or opened["math"])) or (not token[3] and token[2].lower() not in ("script", "style"))):
            at = token.end(1)  # empty within a picture, or never closed
        tag = (token[5] or "").lower()
        found.append((token.start(), at, token[4] or "", tag, token[6] or ""))
        if tag in opened:
            if token[4]:
                if opened[tag]:
                    closed.add(opened[tag].pop())
            elif not (tag in FOREIGN and token[6].endswith("/")):
                opened[tag].append(token.start())
    return found, closed


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def _signed(x: int) -> int:
    x &= _MASK
    return x - (1 << 64) if x >> 63 else x


def says_aside(names: str) -> bool:
    """Whether one of some class names or ids consists of words for what is not the article."""
    for name in names.split():
        words = {w.lower() for w in WORD.findall(name)}
        if words & ASIDE_NAMES and words <= ASIDE_NAMES | NEUTRAL:
            return True
    return False


class Page:
    """A page's elements (token, tag, parent, whether set aside) in order, its blocks of text with their element, and both in their order.

    Every step is of constant cost, whatever the depth.
    """

    def __init__(self, html: str):
        self.token: list[int] = [_hash("")]
        self.tag: list[str] = [""]
        self.parent: list[int] = [-1]
        self.aside: list[bool] = [False]
        self.block_at: list[int] = [0]
        self.blocks: list[tuple[int, str]] = []
        #: Elements (their number) and blocks (-1 - number) as they come.
        self.order: list[int] = [0]
        self._stack, self._text, self._at = [0], [], 0
        self._open_at: dict[str, list[int]] = {}
        self._soft: list[int] = []  # depths that are set aside by a name or role
        end = 0
        found, closed = markup(html)
        for start, after, slash, tag, attributes in found:
            if start > end:
                self._add(html[end:start])
            end = after
            if tag and slash:
                self._close(tag)
            elif tag and (tag not in INSTEAD | FOREIGN or start in closed):  # else it has no content
                self._open(tag, attributes)
        if end < len(html):
            self._add(html[end:])
        self._flush()

    def _add(self, raw: str) -> None:
        if not self.aside[self._stack[-1]]:
            if not self._text:
                self._at = self._stack[-1]
            self._text.append(raw)

    def _flush(self) -> None:
        if self._text:
            joined = "".join(self._text)
            words = (unescape(joined) if "&" in joined else joined).split()
            if words:
                self.order.append(-1 - len(self.blocks))
                self.blocks.append((self.block_at[self._at], " ".join(words)))
            self._text = []

    def _close_to(self, depth: int) -> None:
        for at in range(len(self._stack) - 1, depth - 1, -1):
            self._open_at[self.tag[self._stack.pop()]].pop()
            if self._soft and self._soft[-1] == at:
                self._soft.pop()

    def _last(self, tags: set[str]) -> int:
        """The depth of the innermost open element of these, or -1."""
        return max((held[-1] for t in tags if (held := self._open_at.get(t))), default=-1)

    def _open(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self._add(" ")
            return
        if tag in BLOCKS:
            self._flush()
            if held := self._open_at.get("p"):  # a paragraph holds no block
                self._close_to(held[0])
            if tag in ARTICLE and self._soft:  # nothing that was left open holds the article
                self._close_to(self._soft[0])
            if tag in CLOSES:
                what, within = CLOSES[tag]
                if (depth := self._last(what)) > self._last(within):
                    self._close_to(depth)
        if tag in VOID:
            return
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if attributes else {}
        top = self._stack[-1]
        whole = tag in ARTICLE or tag in ("html", "body")
        soft = not whole and bool(found) and (says_aside(f"{found.get('class', '')} {found.get('id', '')}") or found.get("role", "").lower() in ASIDE_ROLES)
        aside = tag in ASIDE_TAGS or tag in INSTEAD or soft or "hidden" in found or bool(HIDDEN.search(found.get("style", "")))
        label = tag + "".join("." + c for c in found.get("class", "").split()) + ("#" + found["id"] if found.get("id") else "")
        self.token.append(_hash(f"{self.token[top]}>{label}"))
        self.tag.append(tag)
        self.parent.append(top)
        self.aside.append(self.aside[top] or aside)
        self.block_at.append(len(self.tag) - 1 if tag in BLOCKS else self.block_at[top])
        depth = len(self._stack)
        self._stack.append(len(self.tag) - 1)
        self._open_at.setdefault(tag, []).append(depth)
        if aside and tag not in ASIDE_TAGS:
            self._soft.append(depth)
        self.order.append(len(self.tag) - 1)

    def _close(self, tag: str) -> None:
        if tag in BLOCKS:
            self._flush()
        if held := self._open_at.get(tag):
            self._close_to(held[-1])

    def text_token(self, block: int) -> int:
        at, text = self.blocks[block]
        return _hash(f"{self.token[at]}|{text}")

    def tokens(self) -> list[int]:
        """All tokens in their order."""
        return [self.token[i] if i >= 0 else self.text_token(-1 - i) for i in self.order]

    def sums(self, own: dict[int, int]) -> list[int]:
        """Of each element what it and all below it hold of ``own``."""
        out = [own.get(i, 0) for i in range(len(self.tag))]
        for i in range(len(out) - 1, 0, -1):  # a child comes after its parent
            out[self.parent[i]] += out[i]
        return out

    def below(self, roots: set[int]) -> list[bool]:
        """Of each element whether it is a root or below one."""
        out = [False] * len(self.tag)
        for i in range(len(out)):
            out[i] = i in roots or (i > 0 and out[self.parent[i]])
        return out


def order_of(sequence: list[int]) -> int | None:
    """A hash of the order in which members come, if they come in it again and again; else None."""
    k = len(set(sequence))
    return _hash(",".join(map(str, sequence[:k]))) if sequence == sequence[:k] * (len(sequence) // k) else None


class Template:
    """A host's valid classes: of each member its class, whether it is a text run, and how often it comes on a page."""

    def __init__(self, members: list[dict] | None):
        self.members = {m["token"]: m for m in members or ()}
        kinds: dict[int, set[bool]] = {}
        for m in self.members.values():
            if m["most"] > 1:
                kinds.setdefault(m["class"], set()).add(m["text"])
        #: Classes of records: they come several times on a page, as elements with words of their own.
        self.records = {c for c, seen in kinds.items() if seen == {False, True}}

    def is_words(self, token: int) -> bool:
        m = self.members.get(token)
        return bool(m and m["text"])

    def is_record(self, token: int) -> bool:
        m = self.members.get(token)
        return bool(m) and not m["text"] and m["class"] in self.records


def _emit(found: dict, kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    keys = list(zip(*found)) or [(), ()]  # noqa: B905
    values = list(zip(*found.values())) or [()] * (len(kinds) - 2)  # noqa: B905
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip([*keys, *values], kinds, strict=True)], names=[n for n, _ in kinds])


COUNTED = [("host", pa.int64()), ("token", pa.int64()), ("pages", pa.float64()), ("vector", pa.int64()), ("most", pa.int64()), ("text", pa.bool_())]
CHECKED = [("host", pa.int64()), ("class", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("whole", pa.bool_()), ("slot_lo", pa.int64()), ("slot_hi", pa.int64())]


def classes(pages: DataFrame) -> DataFrame:
    """(host, class, token, most, text, always) of every member of a frequent class, from pages with host (a hash), page (a hash), weight and html."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found: dict[tuple[int, int], list] = {}
            for host, page_id, weight, html in zip(*(batch.column(c).to_pylist() for c in ("host", "page", "weight", "html")), strict=True):
                page = Page(html)
                if len(page.order) < 2:
                    continue
                times: dict[int, int] = {}
                words = set()
                for i, token in zip(page.order, page.tokens(), strict=True):
                    times[token] = times.get(token, 0) + 1
                    if i < 0:
                        words.add(token)
                for token, n in times.items():
                    held = found.setdefault((host, _signed(token)), [0.0, 0, 0, token in words])
                    held[0] += weight
                    held[1] = _signed(held[1] + (page_id | 1) * n * 0x9E3779B97F4A7C15)
                    held[2] = max(held[2], n)
            yield _emit(found, COUNTED)

    rows = pages.select("host", "page", "weight", "html").mapInArrow(count, "host long, token long, pages double, vector long, most long, text boolean")
    # sums modulo 2**64: in halves, so that no sum overflows
    low, high = F.col("vector").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("vector", 32)
    rows = rows.groupBy("host", "token").agg(F.sum("pages").alias("pages"), F.sum(low).alias("lo"), F.sum(high).alias("hi"), F.max("most").alias("most"), F.max("text").alias("text"))
    vector = F.struct(F.col("lo").bitwiseAND(F.lit(0xFFFFFFFF)), (F.shiftright("lo", 32) + F.col("hi")).bitwiseAND(F.lit(0xFFFFFFFF)))
    rows = durable(rows.where("pages > 1.5").select("host", "token", "pages", "most", "text", F.xxhash64(vector).alias("class")))
    root = _signed(_hash(""))
    whole = rows.where(F.col("token") == root).select(F.col("host").alias("_host"), F.col("pages").alias("_pages"), F.col("class").alias("_class"))
    met = rows.join(whole, F.col("host") == F.col("_host")).where("2 * pages > _pages + 0.000001")
    return met.select("host", "class", "token", "most", "text", (F.col("class") == F.col("_class")).alias("always"))


def _with_members(pages: DataFrame, known: DataFrame) -> DataFrame:
    """The pages with their host's rows of ``known`` as a list, sent to them where small: then pages stay where they are; else a hot host's partition is split by the adaptive join."""
    lists = durable(known.groupBy("host").agg(F.collect_list(F.struct(*[c for c in known.columns if c != "host"])).alias("members")))
    size = lists.agg(F.sum(F.size("members")).cast("long")).first()[0] or 0
    return pages.join(F.broadcast(lists) if 40 * size <= MOST_BROADCAST else lists, "host", "left")


def templates(pages: DataFrame) -> DataFrame:
    """(host, class, token, most, text, always) of the members of valid, nested classes."""
    known = durable(classes(pages))
    met = _with_members(pages, known)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            orders: dict[tuple[int, int], list] = {}
            for host, members, html in zip(*(batch.column(c).to_pylist() for c in ("host", "members", "html")), strict=True):
                if not members:
                    continue
                held = {m["token"]: m for m in members}
                sequences: dict[int, list[int]] = {}
                slots: dict[int, set[int]] = {}
                last = 0
                for token in map(_signed, Page(html).tokens()):
                    if m := held.get(token):
                        sequences.setdefault(m["class"], []).append(token)
                        if m["always"] and m["most"] == 1:
                            last = token
                        else:
                            slots.setdefault(m["class"], set()).add(last)
                for c, sequence in sequences.items():
                    order, within = order_of(sequence), slots.get(c, {0})
                    fits = order is not None and len(within) == 1
                    row = [_signed(order or 0)] * 2 + [fits] + [min(within), max(within)]
                    had = orders.get((host, c))
                    orders[host, c] = row if had is None else [min(had[0], row[0]), max(had[1], row[1]), had[2] and fits, min(had[3], row[3]), max(had[4], row[4])]
            yield _emit(orders, CHECKED)

    checked = met.select("host", "members", "html").where("members IS NOT NULL").mapInArrow(check, "host long, class long, lo long, hi long, whole boolean, slot_lo long, slot_hi long")
    checked = checked.groupBy("host", "class").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.every("whole").alias("whole"), F.min("slot_lo").alias("slot_lo"), F.max("slot_hi").alias("slot_hi"))
    valid = checked.where("whole AND lo = hi AND slot_lo = slot_hi").select("host", "class")
    return known.join(valid, ["host", "class"], "left_semi")


def region(page: Page, own: dict[int, int]) -> set[int]:
    """The elements that hold the article. own: of each element the characters of slot text right in it."""
    live = [i for i in range(1, len(page.tag)) if not page.aside[i]]
    for tag in ("article", "main"):
        if marked := {i for i in live if page.tag[i] == tag}:
            return marked
    slot_chars = page.sums(own)
    headings = page.sums({i: 1 for i in live if page.tag[i] in HEADINGS and slot_chars[i]})
    children: dict[int, list[int]] = {}
    for i in live:
        children.setdefault(page.parent[i], []).append(i)
    at = 0
    while below := children.get(at):
        best = max(below, key=lambda i: slot_chars[i])
        holds_text = own.get(at) or any(slot_chars[i] and (page.tag[i] in TEXT_BLOCKS or page.tag[i] not in BLOCKS) for i in below)
        if holds_text or 2 * slot_chars[best] <= slot_chars[at] or (headings[at] and not headings[best]):
            break
        at = best
    return {at}


def main_text(html: str | None, members: list[dict] | None) -> str:
    page = Page(html or "")
    template = Template(members)
    records = page.below({i for i, t in enumerate(page.token) if template.is_record(_signed(t))}) if template.records else [False] * len(page.tag)
    words = [template.is_words(_signed(page.text_token(b))) for b in range(len(page.blocks))] if template.members else [False] * len(page.blocks)
    own: dict[int, int] = {}
    for (at, text), template_words in zip(page.blocks, words, strict=True):
        if not template_words and not records[at]:
            own[at] = own.get(at, 0) + len(text)
    roots = region(page, own)
    marked = any(page.tag[i] in ARTICLE for i in roots)
    inside = page.below(roots)
    out = []
    for (at, text), template_words in zip(page.blocks, words, strict=True):
        kept_words = not template_words or (marked and (at in roots or page.tag[at] in TEXT_BLOCKS))
        if inside[at] and kept_words and not records[at]:
            out.append(text)
    return "\n".join(out)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^.*?://([^/?#]*)", 1)), F.lit(""))


def weighed(rows: DataFrame) -> DataFrame:
    """Adds page (a hash of the page's content) and weight: a page that is there several times counts once."""
    rows = rows.withColumn("page", F.xxhash64("html"))
    again = small(rows.groupBy("host", "page").count().where("count > 1").select(F.col("host").alias("_h"), F.col("page").alias("_p"), "count"))
    met = rows.join(again, (F.col("host") == F.col("_h")) & (F.col("page") == F.col("_p")), "left")
    return met.withColumn("weight", 1 / F.coalesce("count", F.lit(1))).drop("_h", "_p", "count")


def extract(pages: DataFrame, html: str = "html", url: str = "url", key: str = "page_id") -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    rows = rows.withColumn("host", F.xxhash64(host_of(F.col("url"))))
    met = _with_members(rows, templates(weighed(rows.where("html IS NOT NULL AND html <> ''").select("host", "html"))))

    def compute(texts: list[str | None], found: list[list[dict] | None]) -> list[pa.Array]:
        out = [main_text(t, f) for t, f in zip(texts, found, strict=True)]
        return [pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())]

    return append_columns(met, ["html", "members"], [("text", "string"), ("n_chars", "long")], compute, keep=["page_id", "url"])
