"""HTML main-text extraction by equivalence-class template deduction.

A host's pages are its distinct html texts; copies count once. A page's tokens are its block tags, each with its role: the
path of block tags around it, with their classes (ids, and words with digits, which change from page to page, are left out). A
token's occurrence vector in a host is the number of its occurrences on each of the host's pages; vectors are compared by a
fingerprint that is aggregated over pages, so no task gathers a host. Tokens of a host with equal vectors
are an equivalence class; classes that occur on at least MIN_SUPPORT of the host's pages (two at least) are split by the
token that they stand in, and nested, part by part, into the template, which starts at the page. What stands
between template tokens are slots. Slots that hold the same text on every page, and slots whose text is
mostly links, belong to the template's furniture; of the others, those with the most text give the host's main containers:
the least token around all the slots that hold at least SLOT_SHARE of the heaviest one's text. A host may have several
layouts, so the containers are an order of preference.

Every page of a host with a template goes through it: its text are the blocks in the first main container that it has, without
the template's furniture. A page's own mark of its main text (article, main, role=main, itemprop=articleBody) is a check:
where it shares blocks with the container, these are taken; where it shares none, and on pages with none of the
containers or of hosts without a template, the mark decides; a page without a mark falls back to its own block with
the most text outside links. Everywhere, elements that are furniture by their name or class (FURNITURE) are left
out, but not one that holds most of the text of a page without a mark.

Text is decoded, white space inside a block becomes one space, blocks are trimmed and joined by a newline. Html is read as
browsers do: a tag that doesn't end is no text, quotes count after '=' only.

Defined results: null html is an empty page; a page without main text gives an empty text; null or odd urls
share the host ''; repeated rows are extracted each; very long html, tags and quotes that never end and
unmatched end tags are read whole, in linear time; an empty table gives
an empty result; other input columns are ignored.
"""

from __future__ import annotations

import functools
import html as entities
import itertools
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, broadcast_if_small, read_table, written

#: Least share of a host's pages that a class of the template occurs on.
MIN_SUPPORT = 0.1
#: Text of a slot, as a share of the heaviest slot's, from which on the main container must hold it.
SLOT_SHARE = 0.1
#: Share of the text of a page without a mark from which on an element with a word of FURNITURE in its class isn't furniture.
SPARED_SHARE = 0.8

# Element names and class or id words.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav noscript ol p pre section select summary table tbody td template textarea tfoot th thead title tr ul button iframe object svg option".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg".split())
FURNITURE_TAGS = frozenset("head header footer nav aside form script style noscript iframe template svg button select textarea menu dialog object title".split())
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget footer header masthead cookie cookies consent gdpr notice alert newsletter subscribe signup popup modal overlay comment comments reply replies disqus respond related recommended share sharing social form login search pagination pager toolbar copyright".split()
)
#: Words that say what the rest of a class is about: `with-sidebar` is no sidebar, `category-social` no share bar.
ABOUT = frozenset("with without no has have is not category tag format type topic post hentry layout status style theme align color text".split())
#: Of FURNITURE, what makes a paragraph or another leaf furniture too.
STRONG = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr newsletter subscribe comment comments".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAVES = HEADINGS | {"p", "blockquote", "pre", "li", "dd", "dt", "td", "th", "figcaption", "figure"}
MAIN_TAGS = frozenset(["article", "main"])

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_TO_VALUE = re.compile(r"[^>=]*+")
_SPACE = re.compile(r"\s*+")
_MARK = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_SPLIT = re.compile(r"[^a-z0-9]+")
_RAW_END = {t: re.compile(rf"</{t}(?![a-zA-Z0-9])", re.IGNORECASE) for t in RAW}
#: What an opening tag closes, if it is open and nothing of the second set is open above it.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_P_SCOPE = frozenset("article aside body div dd dl dt fieldset figure footer form header html li main nav ol section table tbody td th thead tr ul blockquote details".split())


class _Scanner:
    """Tokens of a page, in linear time: (kind, value, attributes, place after it, self-closing); kind is text, open or close."""

    def __init__(self, page: str):
        self.page = page
        self.next: dict[str, int] = {}

    def find(self, what: str, at: int) -> int:
        """The next place of a string; -1 if there is none. Places are asked for in order, so the page is passed once for each string."""
        known = self.next.get(what, -2)
        if known != -1 and known < at:
            known = self.next[what] = self.page.find(what, at)
        return known

    def tag_end(self, at: int) -> int:
        """The place of the '>' that ends the tag whose attributes begin at `at`; -1 if it doesn't end."""
        page, n = self.page, len(self.page)
        while True:
            at = _TO_VALUE.match(page, at).end()
            if at == n or page[at] == ">":
                return at if at < n else -1
            at = _SPACE.match(page, at + 1).end()
            if at < n and page[at] in "\"'":
                close = self.find(page[at], at + 1)
                if close < 0:
                    return self.find(">", at)  # a quote that is never closed
                at = close + 1

    def tokens(self) -> Iterator[tuple[str, str, str, bool]]:
        page, n, at = self.page, len(self.page), 0
        while at < n:
            lt = page.find("<", at)
            if lt < 0:
                yield "text", page[at:], "", False
                return
            if lt > at:
                yield "text", page[at:lt], "", False
            after = page[lt + 1 : lt + 2]
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = end + 3 if end >= 0 else n
            elif after in ("!", "?") and after:
                end = self.find(">", lt)
                at = end + 1 if end >= 0 else n
            elif m := _NAME.match(page, lt + 1 + (after == "/")):
                end = self.tag_end(m.end())
                if end < 0:
                    return
                at = end + 1
                name = m[0].lower()
                if after == "/":
                    yield "close", name, "", False
                    continue
                closed = page[end - 1] == "/"
                yield "open", name, page[m.end() : end], closed
                if name in RAW and not closed:
                    raw = _RAW_END[name].search(page, at)
                    end = self.find(">", raw.end()) if raw else -1
                    at = end + 1 if end >= 0 else n
                    yield "close", name, "", False
            else:
                yield "text", "<", "", False
                at = lt + 1


class Node(NamedTuple):
    name: str
    path: int  # hash of the path of block tags
    parent: int
    holder: str  # name of the block element around, or its own
    main: bool  # in a marked main element
    furniture: int  # 0: none, HEADER: in a header only, OTHER: in other furniture
    link: bool
    by_class: int  # the place of the outermost element that is furniture by its class alone, or -1
    place: int  # which block element of the page it is
    above: int  # which one that stands in


class Block(NamedTuple):
    node: Node
    text: str
    link_chars: int


def _hash(parent: int, key: str) -> int:
    return xxhash.xxh64_intdigest(key, parent & 0xFFFFFFFFFFFFFFFF) & 0x7FFFFFFFFFFFFFFF


HEADER, OTHER = 1, 2
ROOT = Node("", _hash(0, ""), 0, "", False, 0, False, -1, -1, -2)


def _furniture_words(words: list[str]) -> set[str]:
    """Those of a class's words, its first and its last one, that make its element furniture."""
    if not words or words[0] in ABOUT:
        return set()
    return FURNITURE.intersection((words[0], words[-1]))


def _looks(name: str, attributes: str) -> tuple[str, bool, int, bool]:
    """(key, marks the main text, kind of furniture, whether that is by its class alone) of an opening tag."""
    roles: list[str] = []
    found: set[str] = set()
    main = name in MAIN_TAGS
    for m in _MARK.finditer(attributes):
        value = (m[2] or m[3] or m[4] or "").lower()
        what = m[1].lower()
        main = main or (what == "role" and value == "main") or (what == "itemprop" and value == "articlebody")
        if what in ("class", "id"):
            for one in value.split():
                words = [w for w in _SPLIT.split(one) if w]
                found |= _furniture_words(words)
                if what == "class":
                    roles += [w for w in words if w.isalpha()]
        elif what == "role" and value in ("navigation", "banner", "contentinfo", "complementary", "search", "form"):
            found.add("nav")
    if name in LEAVES or main:
        found &= STRONG
    kinds = found | ({name} & FURNITURE_TAGS)
    furniture = 0 if not kinds or name in ("html", "body") else HEADER if kinds == {"header"} else OTHER
    return name + "." + ".".join(sorted(set(roles))), main and not furniture, furniture, name not in FURNITURE_TAGS


_known_looks = functools.lru_cache(maxsize=4096)(_looks)


def blocks_of(page: str, spared: int = -1) -> tuple[list[Block], list[Node]]:
    """The text blocks of a page in order, and every block element that it opens; the element at place `spared` isn't furniture."""
    stack: list[Node] = [ROOT]
    open_names: dict[str, int] = {}
    blocks: list[Block] = []
    opened: list[Node] = []
    parts: list[str] = []
    links = 0
    any_main = False

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                blocks.append(Block(stack[-1], text, links))
            parts.clear()
            links = 0

    def close_to(i: int) -> None:
        if any(n.name in BLOCKS for n in stack[i:]):
            flush()
        for n in stack[i:]:
            open_names[n.name] -= 1
        del stack[i:]

    def is_open(names) -> bool:
        return any(open_names.get(x, 0) for x in names)

    for kind, name, attributes, closed in _Scanner(page).tokens():
        if kind == "text":
            parts.append(name)
            links += len(name) * stack[-1].link
            continue
        if kind == "close":
            if open_names.get(name, 0):
                close_to(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name))
            continue
        if name == "br":
            parts.append(" ")
            continue
        block = name in BLOCKS
        if block:
            flush()
            closes, scope = _CLOSES.get(name, ({"p"} | HEADINGS if name in HEADINGS else {"p"}, _P_SCOPE))
            if is_open(closes):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name in closes:
                        close_to(i)
                        break
                    if stack[i].name in scope:
                        break
            if (name == "body" or name in MAIN_TAGS and not any_main) and stack[-1].furniture:
                # An unclosed menu or head ends where the page's body or its first main element begins.
                close_to(next(i for i, x in enumerate(stack) if x.furniture))
        top = stack[-1]
        key, main, furniture, by_class = (_known_looks if len(attributes) < 500 else _looks)(name, attributes)
        if name in HEADINGS and furniture == HEADER or len(opened) == spared and by_class:
            furniture = 0  # the class "header" on a heading names its looks
        path = _hash(top.path, key) if block else top.path
        if not block:
            furniture = 0  # an inline element's text is its block's
        around = 0 if name in HEADINGS and top.main and top.furniture == HEADER else top.furniture  # the article's own title
        cause = top.by_class if top.furniture else len(opened) if block and furniture and by_class else -1
        main = top.main or (main and not top.furniture)
        node = Node(name, path, top.path if block else top.parent, name if block else top.holder, main, max(around, furniture), top.link or name == "a", cause, len(opened) if block else top.place, top.place if block else top.above)
        if block:
            opened.append(node)
            any_main = any_main or main
        if name not in VOID and not (closed and not block):
            stack.append(node)
            open_names[name] = open_names.get(name, 0) + 1
    flush()
    return blocks, opened


def read(page: str) -> tuple[list[Block], list[Node]]:
    """blocks_of, where a page without a mark doesn't lose most of its text to one element with a word of FURNITURE in its class."""
    blocks, opened = blocks_of(page)
    if not any(n.main for n in opened):
        held: dict[int, int] = {}
        total = 0
        for b in blocks:
            own = max(0, len(b.text) - b.link_chars)
            total += own
            if b.node.by_class >= 0:
                held[b.node.by_class] = held.get(b.node.by_class, 0) + own
        most = max(held, key=lambda i: (held[i], -i), default=None)
        if most is not None and held[most] >= SPARED_SHARE * total:
            return blocks_of(page, spared=most)
    return blocks, opened


def _page_stats(page: str) -> dict[int, list[int]]:
    """{path: [parent, count, text characters, link characters, hash of the text]}."""
    blocks, opened = read(page)
    stats: dict[int, list[int]] = {ROOT.path: [0, 1, 0, 0, 0]}
    for node in opened:
        stats.setdefault(node.path, [node.parent, 0, 0, 0, 0])[1] += 1
    for b in blocks:
        s = stats.setdefault(b.node.path, [b.node.parent, 0, 0, 0, 0])
        if not b.node.furniture:
            s[2] += len(b.text)
            s[3] += b.link_chars
        s[4] ^= xxhash.xxh64_intdigest(b.text) >> 1
    return stats


class Template(NamedTuple):
    tokens: frozenset[int]
    fixed: frozenset[int]  # slots with the same text on all pages
    links: frozenset[int]  # slots whose text is mostly links
    mains: tuple[int, ...]  # main containers, the best one first


def deduce(rows: list[dict], pages: int) -> Template:
    """The template of a host from its tokens: path, parent, pages, vector, text, links, same."""
    supported = {r["path"]: r for r in rows if r["pages"] >= max(2, MIN_SUPPORT * pages)}
    classes: dict[tuple[int, int], list[int]] = {}
    for r in supported.values():
        classes.setdefault((r["parent"], r["vector"]), []).append(r["path"])
    parts: dict[int, list[list[int]]] = {}
    for (parent, _), paths in classes.items():
        parts.setdefault(parent, []).append(paths)
    inside, todo = {ROOT.path}, [ROOT.path]
    while todo:  # nest: a class, or the part of it that stands in one token, joins the template after that token
        for paths in parts.get(todo.pop(), []):
            new = [p for p in paths if p not in inside]
            inside.update(new)
            todo += new
    fixed = frozenset(p for p in inside if p in supported and supported[p]["same"] and supported[p]["pages"] >= 3)
    links = frozenset(p for p in inside if p in supported and 0 < supported[p]["text"] <= 2 * supported[p]["links"])
    # A slot's text counts for the token around it: repeated paragraphs make their container the main slot.
    weight: dict[int, int] = {}
    for p in inside:
        r = supported.get(p)
        if r and p not in fixed and p not in links and r["text"] > r["links"]:
            at = r["parent"] if p != ROOT.path else p
            weight[at] = weight.get(at, 0) + r["text"] - r["links"]
    if not weight:
        fixed = frozenset()  # nothing but fixed text: the pages are copies of one text, not furniture around others
    order = sorted(weight, key=lambda p: (-weight[p], p))
    up = {p: supported[p]["parent"] for p in inside if p in supported and p != ROOT.path}

    def trail(p: int) -> list[int]:
        out = [p]
        while out[-1] in up:
            out.append(up[out[-1]])
        return out[::-1]

    mains: list[int] = []
    if order:
        # Slots that stand together on pages with the heaviest one: the least token around all of them.
        heavy = supported.get(order[0])
        near = [p for p in order if weight[p] >= SLOT_SHARE * weight[order[0]] and (heavy is None or p not in supported or supported[p]["pages"] + heavy["pages"] > pages)]
        trails = [trail(p) for p in near]
        common = [x[0] for x in itertools.takewhile(lambda x: len(set(x)) == 1, zip(*trails))]
        mains = [common[-1]] if common else []
        mains += [p for p in order if p not in mains and weight[p] >= SLOT_SHARE * weight[order[0]]]
    return Template(frozenset(inside), fixed, links, tuple(mains))


def main_text(page: str, template: Template | None) -> str:
    """The main text of a page."""
    blocks, opened = read(page)
    blocks = [b for b in blocks if not b.node.furniture]
    marked = [b for b in blocks if b.node.main]
    if template:
        paths = {n.path: n.parent for n in opened} | {ROOT.path: 0}
        root = next((p for p in template.mains if p in paths), None)
        if root is not None:
            slots = [b for b in _under(blocks, [b.node.path for b in blocks], root, paths) if b.node.path not in template.fixed and b.node.path not in template.links]
            checked = [b for b in slots if b.node.main] if marked else slots
            if checked:
                return "\n".join(b.text for b in checked)
    if marked:
        return "\n".join(b.text for b in marked)
    weight: dict[int, int] = {}
    for b in blocks:
        if len(b.text) > 2 * b.link_chars:
            at = b.node.above if b.node.holder not in ("", "body", "html") else b.node.place
            weight[at] = weight.get(at, 0) + len(b.text) - b.link_chars
    root = max(weight, key=lambda p: (weight[p], -p), default=None)
    if root is None:
        return ""
    places = {n.place: n.above for n in opened} | {ROOT.place: ROOT.above}
    return "\n".join(b.text for b in _under(blocks, [b.node.place for b in blocks], root, places))


def _under(blocks: list[Block], at: list[int], root: int, up: dict[int, int]) -> list[Block]:
    """The blocks whose place (at) is root or below it; up gives what a place stands in."""
    known: dict[int | None, bool] = {root: True, None: False}
    for place in at:
        trail: list[int | None] = []
        x: int | None = place
        while x not in known:
            trail.append(x)
            x = up.get(x)
        for y in trail:
            known[y] = known[x]
    return [b for b, place in zip(blocks, at) if known[place]]


_STATS = "host string, page long, path long, parent long, n long, text long, links long, hash long"


def host_of():
    return F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def templates(pages: DataFrame) -> DataFrame:
    """host, pages, tokens of every host; tokens are those that enough of its pages have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, key, page in zip(*(batch.column(c).to_pylist() for c in ("host", "page", "html"))):
                rows += [(host, key, p, *s) for p, s in _page_stats(page or "").items()]
            cols = list(zip(*rows)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=[x.split()[0] for x in _STATS.split(", ")])

    # A page is told from others by the hash of its html, from which the vectors' fingerprints are made; copies are one page.
    keyed = pages.select(host_of().alias("host"), F.xxhash64("html").alias("page"), "html")
    stats = arrow_map(keyed, run, _STATS).dropDuplicates(["host", "path", "page"])
    by_token = stats.groupBy("host", "path").agg(
        F.min("parent").alias("parent"), F.count(F.lit(1)).alias("pages"), F.bit_xor(F.xxhash64("page", "n")).alias("vector"),
        F.sum("text").alias("text"), F.sum("links").alias("links"), (F.min("hash") == F.max("hash")).alias("same"),
    )
    by_token = written(by_token, "tokens")  # read three times below; the pages are walked once for it
    total = by_token.filter(F.col("path") == ROOT.path).select("host", F.col("pages").alias("host_pages"))
    kept = by_token.join(total, "host").filter(F.col("pages") >= F.greatest(F.lit(2), MIN_SUPPORT * F.col("host_pages")))
    # At most (tokens of a page) / MIN_SUPPORT rows for each host.
    row = F.struct("path", "parent", "pages", "vector", "text", "links", "same")
    return kept.groupBy("host").agg(F.max("host_pages").alias("host_pages"), F.collect_list(row).alias("tokens"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    by_host = broadcast_if_small(written(templates(pages), "templates"))
    rows = pages.select("page_id", "url", "html", host_of().alias("host")).join(by_host, "host", "left")
    key = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Template | None] = {}
        for batch in batches:
            texts = []
            hosts, counts = batch.column("host").to_pylist(), batch.column("host_pages").to_pylist()
            tokens = batch.column("tokens")
            for i, page in enumerate(batch.column("html").to_pylist()):
                if hosts[i] not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[hosts[i]] = deduce(tokens[i].as_py(), counts[i]) if counts[i] else None
                texts.append(main_text(page or "", known[hosts[i]]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return arrow_map(rows, run, f"page_id {key}, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
