"""Main text of pages (operator 9) by inferring union-free wrappers of hosts.

A page is read as nested elements with text slots. Runs of elements of one
kind, or of two or three kinds in turn, fold into one repeated group, whose
members are aligned with each other. The distinct structures of one host are
then aligned one after the other: what only some of them have becomes optional.
So a wrapper is a regular expression without unions over elements and slots.
From a host's wrapper follows which slots are menus, and from counts of equal texts
at equal paths, which texts are constant; pages are read again with both, and what
is no part of the article is left out. Slots are found by their tag path: pages are
not matched against the wrapper's groups and optional elements, and texts are
compared by counting and not as tokens of the alignment.

An element is no part of an article if it is hidden, a menu, footer, form, script
or the like, or named as an advert, a notice, a sidebar, comments and so on. A name
counts as a whole: all its words are MARKS or BESIDE them. Names never leave out
article, main or a heading, and, but for comments, neither names nor forms leave
out what holds most of a page's text. If
a page has such text in an article or main element, only that counts; elsewhere
repeated groups of nothing but links are menus if at least half of a list's texts
recur on other pages of the host, or, on a host of one page, if no text is before. Comments, styles and markup never
count. Text of a block is the text of its inline elements; references are
decoded, white space becomes one space, blocks are joined by an empty line.

Null and empty pages have the empty text. A null url is a host of its own kind.
Repeated rows and further columns are harmless. Structures of a large host are
merged in rounds of groups of about GROUP, so no task gets all of a host's.
"""

from __future__ import annotations

import html
import json
from collections import Counter
from collections.abc import Callable, Container, Iterable, Iterator

import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F

from webtables.llm.common import extended, extended_schema, materialise, slices
from webtables.operators.skew import join_summary

GROUP = 256
#: Distinct pages of a host that a constant text is on, at least.
SEVERAL = 3
#: A wrapper has the text of elements nested deeper than this at this depth; what they leave out still holds.
DEPTH = 60
TOKEN = regex.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    regex.S,
)
ATTRIBUTE = regex.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
UNSEEN = regex.compile(r"(?:^|;)\s*display\s*:\s*none", regex.I)
#: Words of a name in class, id or role that mark an element as no part of an article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adslot sponsor sponsored sponsors promo promos"
    " promotion banner banners menu menus nav navbar navigation breadcrumb breadcrumbs sidebar sidebars aside"
    " complementary footer contentinfo masthead header topbar comment comments commentlist replies reply respond disqus"
    " cookie cookies consent gdpr notice notices alert alerts popup modal dialog overlay share sharing social related"
    " recommended newsletter subscribe signup login search widget widgets toolbar pagination pager skip".split()
)
#: Words that may stand beside them; a name with any other word (entry-header, with-sidebar) marks nothing.
BESIDE = frozenset(
    "site main primary secondary global top bottom left right sticky fixed mobile desktop block box bar area container"
    " wrapper wrap inner outer section list link links button buttons icon icons item items post posts article articles"
    " story stories form slot unit thread policy banner text title body google dfp to".split()
)
#: Marks that may as well name what a part of an article is about, if they are all of its id.
TOPICS = MARKS - frozenset(
    "adslot nav navbar navigation breadcrumb breadcrumbs sidebar sidebars aside footer masthead header topbar comments"
    " commentlist replies respond disqus toolbar pagination pager".split()
)
#: Marks of other authors' texts, which may be longer than the article.
REPLIES = frozenset("comment comments commentlist replies reply respond disqus".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Marks that within an article may hold its title.
TOPS = frozenset("header masthead banner".split())
LEFT_OUT = frozenset("head nav footer aside dialog menu button select noscript template svg iframe object".split())
RAW = frozenset("script style textarea title xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var".split()
)
MAIN = frozenset(("article", "main"))
#: What a new element of a kind closes, if it is open within the same container.
CLOSES = {
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
    "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"},
}
HOLDERS = frozenset("ul ol dl table article main section div body html td nav aside footer header form".split())

# A wrapper's node: [kind, optional, repeated, children]; slots are "#", of links only "#a".
Node = list


def read(page: str, emit: Callable[[str, bool, bool, str], None] | None = None) -> Node:
    """The page's structure; ``emit`` gets every slot's path, whether an element around it
    is left out, whether one is article or main, and its text."""
    slots: list[tuple[str, bool, bool, str]] = []
    root, whole = read_once(page, slots, frozenset())
    if whole:
        slots.clear()
        root, _ = read_once(page, slots, whole)
    if emit:
        for slot in slots:
            emit(*slot)
    return root


def read_once(
    page: str, slots: list[tuple[str, bool, bool, str]], whole: frozenset[int]
) -> tuple[Node, frozenset[int]]:
    """As ``read``, without leaving out elements (by their number) in ``whole``; also the numbers
    of those left out by name or as forms that hold most of the page's text."""
    root: Node = ["", False, False, []]
    # Name, kind and node of the open elements; below DEPTH, the node is the one at DEPTH.
    stack: list[tuple[str, str, Node]] = [("", "", root)]
    path = [""]
    opened: Counter[str] = Counter()  # open elements by name, and as "!" those left out
    # Where elements that may hold most of the text start: number, size of stack and of text so far.
    held: list[tuple[int, int, int]] = []
    sizes: dict[int, int] = {}
    said_so_far = number = 0
    text: list[str] = []
    links = [0, False, False]  # depth of open links, whether text is inside one, outside one

    def said(raw: str) -> None:
        if raw:
            text.append(html.unescape(raw))
            if not raw.isspace():
                links[1 if links[0] else 2] = True

    def end_block() -> None:
        nonlocal said_so_far
        words = " ".join("".join(text).split())
        text.clear()
        if words:
            slot, out = "#" if links[2] else "#a", opened["!"] > 0
            if len(stack) <= DEPTH or not out:
                stack[-1][2][3].append([slot, False, False, []])
            slots.append(("/".join([*path, slot]), out, any(opened[kind] for kind in MAIN), words))
            said_so_far += len(words)
        links[1] = links[2] = False

    def open_(name: str, out: bool) -> None:
        kind, node = name + "!" if out else name, stack[-1][2]
        if len(stack) < DEPTH:
            node[3].append([kind, False, False, []])
            node = node[3][-1]
            path.append(kind)
        stack.append((name, kind, node))
        opened[name] += 1
        opened["!"] += out

    def close() -> None:
        end_block()
        name, kind, node = stack.pop()
        if held and held[-1][1] == len(stack):
            which, _, before = held.pop()
            sizes[which] = said_so_far - before
        opened[name] -= 1
        opened["!"] -= kind[-1] == "!"
        if len(stack) < DEPTH:
            path.pop()
            node[3] = folded(node[3])

    at, n = 0, len(page)
    while at < n:
        match = TOKEN.search(page, at)
        if not match:
            said(page[at:])
            break
        said(page[at : match.start()])
        at = match.end()
        name = (match[2] or match[5] or "").lower()
        if not name:
            continue
        closing, attributes = match[1] or match[4], match[3] or match[6] or ""
        if name in RAW:
            if not closing:
                end = regex.compile(rf"</{name}", regex.I).search(page, at)
                at = end.start() if end else n
            continue
        if name in INLINE:
            if name == "a":
                links[0] = max(0, links[0] + (-1 if closing else 1))
            out = not closing and any(marked(name, attributes, any(opened[kind] for kind in MAIN)))
            if not out and not opened[name]:
                continue
        if name in VOID:
            if name == "br":
                said(" ")
            elif name == "hr":
                end_block()
            continue
        if closing:
            if opened[name]:
                while stack[-1][0] != name:
                    close()
                close()
            continue
        end_block()
        gone = CLOSES.get(name, {"p"})
        while len(stack) > 1 and stack[-1][0] in gone and stack[-1][0] not in HOLDERS - {"td"}:
            close()
        inside = any(opened[kind] for kind in MAIN)
        hidden, names = marked(name, attributes, inside)
        out = name in LEFT_OUT or hidden or (name == "header" and not inside)
        if not out and (names or name == "form"):
            number += 1
            out = number not in whole
            if out and not names & REPLIES:
                held.append((number, len(stack), said_so_far))
        open_(name, bool(out) and name not in ("html", "body"))
    while len(stack) > 1:
        close()
    end_block()
    root[3] = folded(root[3])
    return root, frozenset(which for which, size in sizes.items() if 2 * size > said_so_far)


def marked(name: str, attributes: str, inside: bool) -> tuple[bool, set[str]]:
    """Whether the element is hidden, and the MARKS in its names; ``inside`` of article or main."""
    if not attributes or attributes.isspace():
        return False, set()
    hidden, found = False, set()
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key == "hidden" or (key == "aria-hidden" and value.strip().lower() == "true"):
            hidden = True
        elif key == "style":
            hidden = hidden or bool(UNSEEN.search(value))
        elif key in ("class", "id", "role") and name not in HEADINGS and name not in MAIN:
            for token in value.lower().split():
                words = [w for w in regex.split(r"[_-]+", token) if w and not regex.fullmatch(r"\d+(?:x\d+)?", w)]
                own = MARKS.intersection(words)
                if own and own.union(BESIDE).issuperset(words) and not (key == "id" and token in TOPICS):
                    found |= own
    if inside:
        found -= TOPS
    return hidden, found - REPLIES if name in INLINE else found


def aligned(a: list[Node], b: list[Node]) -> list[Node]:
    """Two sequences of nodes as one: the longest common run of kinds, the rest optional."""
    n, m = len(a), len(b)
    if [x[0] for x in a] == [y[0] for y in b]:
        return [merged(x, y) for x, y in zip(a, b, strict=True)]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            same = best[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else 0
            best[i][j] = max(same, best[i + 1][j], best[i][j + 1])
    out: list[Node] = []
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and a[i][0] == b[j][0] and best[i][j] == best[i + 1][j + 1] + 1:
            out.append(merged(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            out.append([a[i][0], True, *a[i][2:]])
            i += 1
        else:
            out.append([b[j][0], True, *b[j][2:]])
            j += 1
    return folded(out)


def merged(a: Node, b: Node) -> Node:
    return [a[0], a[1] or b[1], a[2] or b[2], aligned(a[3], b[3])]


def folded(nodes: list[Node]) -> list[Node]:
    """Fold neighbours of one kind, then of two or three kinds in turn, into groups."""
    out: list[Node] = []
    for node in nodes:
        if out and out[-1][0] == node[0]:
            both = merged(out[-1], node)
            out[-1] = [both[0], out[-1][1] and node[1], True, both[3]]
        else:
            out.append(node)
    for size in (2, 3):
        i = 0
        while i + 2 * size <= len(out):
            unit = out[i : i + size]
            kinds = [x[0] for x in unit]
            k = i + size
            while "&" not in kinds and [x[0] for x in out[k : k + size]] == kinds:
                unit = [merged(x, y) for x, y in zip(unit, out[k : k + size], strict=True)]
                k += size
            if k > i + size:
                out[i:k] = [["&", False, True, unit]]
            i += 1
    return out


def menus(wrapper: Node) -> set[str]:
    """Paths of the wrapper's slots that are only in repeated groups of nothing but links."""
    found: dict[str, bool] = {}

    def walk(node: Node, path: list[str], menu: bool) -> None:
        kind = node[0]
        if kind in ("#", "#a"):
            key = "/".join([*path, kind])
            found[key] = found.get(key, True) and menu
            return
        path = path if kind == "&" else [*path, kind]
        menu = menu or (node[2] and linked(node))
        for child in node[3]:
            walk(child, path, menu)

    def linked(node: Node) -> bool:
        slots = [s for c in node[3] for s in ([c[0] == "#a"] if c[0][:1] == "#" else [linked(c)] if c[3] else [])]
        return bool(slots) and all(slots)

    walk(wrapper, [], False)
    return {path for path, menu in found.items() if menu}


def main_text(
    page: str | None, menu: set[str], constant: Container[bytes] = (), again: Container[bytes] = (), alone: bool = True
) -> str:
    """The page's article, by the wrapper's menus and the keys of the host's constant and
    recurring texts; ``alone`` if no other page of the host has other texts."""
    # Whether in article or main, and texts; of a link list also its path and the keys.
    blocks: list[tuple[bool, list[str], str, list[bytes]]] = []

    def emit(path: str, out: bool, main: bool, words: str) -> None:
        if out:
            blocks.append((False, [], "", []))
            return
        key = b"" if main else key_of(path, words)
        if main or path not in menu:
            blocks.append((main, [words] if main or key not in constant else [], "", []))
        elif blocks and blocks[-1][2] == path:
            blocks[-1][1].append(words)
            blocks[-1][3].append(key)
        else:
            blocks.append((False, [words], path, [key]))

    read(page or "", emit)
    only = any(main for main, *_ in blocks)
    kept: list[str] = []
    for main, words, path, keys in blocks:
        if path and (not kept if alone else 2 * sum(key in again for key in keys) >= len(keys)):
            continue
        if main or not only:
            kept += words
    return "\n\n".join(kept)


def key_of(path: str, words: str = "") -> bytes:
    """A text at a path; without the text, the path. Paths come first, so that a path's keys share their start."""
    both = xxhash.xxh3_64_digest(path.encode("utf-8", "surrogatepass"))
    return both + xxhash.xxh3_64_digest(words.encode("utf-8", "surrogatepass")) if words else both


def shapes(pages: DataFrame) -> DataFrame:
    """Of the pages of a host with distinct blocks: host, wrapper (JSON), keys of the texts that
    may be constant, and page, which is the same for captures of one url."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            rows = []
            for url, host, page in zip(*(part[c].to_pylist() for c in ("url", "host", "html")), strict=True):
                blocks: list[tuple[str, bool, bool, str]] = []
                wrapper = json.dumps(read(page or "", lambda *block: blocks.append(block)), separators=(",", ":"))
                keys = sorted({key_of(path, words) for path, out, main, words in blocks if not out and not main})
                digest = xxhash.xxh3_128_digest(repr((wrapper, blocks)).encode("utf-8", "surrogatepass"))
                own = digest if url is None else xxhash.xxh3_128_digest(url.encode("utf-8", "surrogatepass"))
                rows.append((host, digest, own, wrapper, keys))
            kinds = pa.string(), pa.binary(), pa.binary(), pa.string(), pa.list_(pa.binary())
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "digest", "page", "wrapper", "keys"])

    schema = "host string, digest binary, page binary, wrapper string, keys array<binary>"
    found = pages.select("url", "host", "html").mapInArrow(run, schema)
    first = F.min(F.struct("page", "wrapper", "keys")).alias("first")
    return found.groupBy("host", "digest").agg(first).select("host", "first.*")


def recurring(shaped: DataFrame) -> DataFrame:
    """Per host: constant and again, keys of texts that recur at their path, and pages with other texts.

    A text is constant if at least SEVERAL pages and over half of the pages with text
    at its path have it there, and is there again if two and a tenth of them have it.
    So a host has at most ten times as many as a page has texts.
    """
    texts = shaped.select("host", "page", F.explode("keys").alias("key")).distinct()
    counts = texts.groupBy("host", "key").agg(F.count("*").alias("n"))
    place = F.struct("host", F.substring("key", 1, 8).alias("path")).alias("place")
    often = counts.filter("n >= 2").select(place, "key", "n")
    paths = texts.select(place, "page").distinct().groupBy("place").agg(F.count("*").alias("pages"))
    kept = join_summary(often, paths, "place", "key").filter(10 * F.col("n") >= F.col("pages"))
    constant = F.when((F.col("n") >= SEVERAL) & (2 * F.col("n") > F.col("pages")), F.col("key"))
    lists = F.collect_list(constant).alias("constant"), F.collect_list("key").alias("again")
    pages = shaped.groupBy("host").agg((F.min("page") == F.max("page")).alias("alone"))
    return pages.join(kept.groupBy("place.host").agg(*lists), "host", "left")


def _merge_group(group: pd.DataFrame) -> pd.DataFrame:
    whole, *rest = (json.loads(x) for x in sorted(group["wrapper"], key=lambda x: (len(x), x)))
    for one in rest:
        whole = merged(whole, one)
    return pd.DataFrame({"host": group["host"].iloc[:1], "wrapper": [json.dumps(whole, separators=(",", ":"))]})


def infer(pages: DataFrame) -> DataFrame:
    """One wrapper per host: host, wrapper (JSON), and the columns of ``recurring``."""
    shaped = materialise(shapes(pages))
    return materialise(merged_shapes(shaped).join(recurring(shaped), "host"))


def merged_shapes(shaped: DataFrame) -> DataFrame:
    wrappers = materialise(shaped.select("host", "wrapper").distinct())
    while True:
        counts = wrappers.groupBy("host").agg(F.count("*").alias("_n"))
        if counts.filter("_n > 1").isEmpty():
            return wrappers
        groups = F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("_n") / GROUP))
        placed = join_summary(wrappers, counts, "host", "wrapper").withColumn("_group", groups)
        merged_ = placed.groupBy("host", "_group").applyInPandas(_merge_group, "host string, wrapper string")
        wrappers = materialise(merged_)


def with_host(pages: DataFrame) -> DataFrame:
    host = F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return pages.withColumn("host", F.coalesce(host, F.lit("")))


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    placed = with_host(pages.select("page_id", "url", "html"))
    joined = placed.join(infer(placed), "host")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[set[str], frozenset[bytes], frozenset[bytes], bool]] = {}
        for part in slices(batches, "html"):
            texts = []
            columns = (part[c].to_pylist() for c in ("host", "html", "wrapper"))
            for i, (host, page, wrapper) in enumerate(zip(*columns, strict=True)):
                if host not in known:
                    if len(known) >= 1000:
                        known.clear()
                    constant, again = (frozenset(part[c][i].as_py() or ()) for c in ("constant", "again"))
                    known[host] = menus(json.loads(wrapper)), constant, again, part["alone"][i].as_py()
                texts.append(main_text(page, *known[host]))
            counts = pa.array([len(t) for t in texts], pa.int64())
            yield extended(part.select(["page_id", "url"]), text=pa.array(texts, pa.string()), n_chars=counts)

    schema = extended_schema(pages.select("page_id", "url").schema, "text string, n_chars bigint")
    return joined.select("page_id", "url", "host", "html", "wrapper", "constant", "again", "alone").mapInArrow(run, schema)
