"""Main text of web pages by wrappers: union-free regular expressions inferred from all pages of a host.

A page becomes a tree of blocks. Its tandem repeats fold into repeated groups; the pages of a host are then aligned one after
the other with the wrapper so far: what only one side has becomes optional, texts that differ become slots, texts that every
page has stay fixed. The wrapper decides: the article is where the slots' text lies, and fixed texts are the host's template. Every
page is aligned with its host's wrapper in the same way, and its blocks take the marks of the parts they meet. A host of many pages
is dealt over shares, whose wrappers are merged into one.
"""

from __future__ import annotations

import html
import math
import pickle
import re
import sys
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import batch, bound_batches, materialize, tidy

#: Pages, or wrappers of such shares, that one group merges.
SHARE = 500
#: Wrappers of all hosts go to every worker if they have so many bytes together at most; else pages and wrappers meet in a shuffle.
SENT_BYTES = 32 << 20
#: Rows that a task gives back at a time.
OUT_ROWS = 64
#: A text is the template's if it is on this part of a host's pages, and on so many at least.
TEMPLATE_SHARE, TEMPLATE_PAGES = 0.9, 3
#: The article element is taken if it has this part of the slots' text; without one, an only child with DESCEND of it is entered.
ARTICLE_SHARE, DESCEND = 0.4, 0.7
#: A repeated group with this part of its text in links is a menu.
LINKS = 0.9

#: Elements of HTML by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math object".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr img br".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table body html div article section main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that may hold an article, elements that hold no article text, and those that no name makes such.
HOLDERS = frozenset("# html body main article section div center td th table tbody tr".split())
BOILER_TAGS = frozenset("nav header footer aside form button select dialog menu head".split())
UNNAMED = frozenset("# html body main".split())
#: Words of names (class, id, role) for what isn't article text; of comments; words before which a name tells of something else.
BOILER_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar footer masthead topbar banner cookie cookies consent gdpr notice alert popup modal newsletter subscribe signup login search social share sharing related recommended comment comments commentlist disqus reply replies respond widget pagination pager toolbar skip".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond".split())
TOLD = frozenset("has with without no category cat tag topic".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?+)*+)(?:>|\Z)",
    re.S,
)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>\"']+))", re.I)
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Node:
    """An element: tag, whether its name tells of something else than article text, whether it has blocks inside, children (nodes and strings)."""

    __slots__ = ("blocks", "children", "named", "sign", "tag")

    def __init__(self, tag: str, names: tuple[str, ...] = ()):
        self.tag, self.children, self.blocks = tag, [], tag not in INLINE
        parts = [[w.lower() for w in _PARTS.findall(name)] for name in names]
        telling = COMMENT_WORDS if tag == "article" else BOILER_WORDS
        self.named = tag not in UNNAMED and any(x and x[0] not in TOLD and not telling.isdisjoint(x) for x in parts)
        words = () if tag in UNNAMED or tag == "article" else dict.fromkeys(w for x in parts for w in x)
        self.sign = ".".join([tag + "!" * self.named, *words])


def parse(page: str) -> Node:
    """The tree of a page; broken markup never fails. Comments and raw elements (scripts, styles, titles) are left out."""
    root, at = Node("#"), 0
    stack = [root]
    while at < len(page):
        m = _TOKEN.search(page, at)
        end = m.start() if m else len(page)
        if end > at:
            stack[-1].children.append(html.unescape(page[at:end]))
        if not m:
            break
        at = m.end()
        if not (name := m["name"]):
            continue
        name = name.lower()
        if m["close"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == name:
                    del stack[k:]
                    break
                if name in INLINE and stack[k].tag not in INLINE:
                    break  # a stray inline end tag closes no block
            continue
        if name in RAW:
            found = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(page, at)
            if not m["attrs"].rstrip().endswith("/") or name not in ("svg", "math"):
                at = found.end() if found else len(page)
            continue
        closes = SIBLINGS.get(name, ())
        if name in CLOSES_P:
            closes = (*closes, "p")
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in closes:
                del stack[k:]
                break
            if stack[k].tag in SCOPES:
                break
        names = tuple(w for x in _NAMED.finditer(m["attrs"]) for w in (x[2] or x[3] or x[4] or "").split()) if m["attrs"] else ()
        node = Node(name, names)
        stack[-1].children.append(node)
        for above in reversed(stack if node.blocks else ()):
            if above.blocks:  # so have all above it
                break
            above.blocks = True
        if name not in VOID:
            stack.append(node)
    return root


# --- wrappers ---


class Item:
    """A part of a wrapper: a block element (sign, children), or a run of text and inline elements (no sign).

    ``pages`` of the host have it. Of a run, ``fixed`` has the texts (hash: length, pages) that all those pages had; if other
    text was there too, the run is a slot. ``size`` and ``link`` count code points of text below, and those inside links, on
    all pages. ``held`` are the page's own nodes: (node, child from, child to) of a run, (node,) of an element.
    """

    __slots__ = ("children", "fixed", "held", "link", "mark", "optional", "pages", "repeated", "sign", "size")

    def __init__(self, sign: str | None, children: list[Item], fixed: dict[int, tuple[int, int]], size: int, link: int, pages: int = 1, optional: bool = False, repeated: int = 0, mark: str = "", held: list | None = None):
        self.sign, self.children, self.fixed, self.size, self.link, self.pages = sign, children, fixed, size, link, pages
        self.optional, self.repeated, self.mark, self.held = optional, repeated, mark, held if held is not None else []

    @property
    def tag(self) -> str:
        return self.sign.partition(".")[0].rstrip("!")

    @property
    def named(self) -> bool:
        return self.sign.partition(".")[0].endswith("!")

    def slot(self) -> int:
        """Code points of a run that differ between pages."""
        return self.size - sum(n * pages for n, pages in self.fixed.values())


def _inline_text(x: Node | str, out: list[str], linked: list[str]) -> None:
    todo = [(x, False)]
    while todo:
        x, in_link = todo.pop()
        if isinstance(x, str):
            out.append(x)
            if in_link:
                linked.append(x)
        elif x.tag == "br":
            out.append(" ")
        elif not x.named:
            todo += [(c, in_link or x.tag == "a") for c in reversed(x.children)]


def _item(node: Node) -> Item:
    """An element of a page as a part of a wrapper."""
    inner, k = [], 0
    while k < len(node.children):
        c = node.children[k]
        if not isinstance(c, str) and c.blocks:
            inner.append(_item(c))
            k += 1
            continue
        start, out, linked = k, [], []
        while k < len(node.children) and (isinstance(c := node.children[k], str) or not c.blocks):
            _inline_text(c, out, linked)
            k += 1
        if text := " ".join("".join(out).split()):
            link = min(len(text), len(" ".join("".join(linked).split())))
            inner.append(Item(None, [], {xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")): (len(text), 1)}, len(text), link, held=[(node, start, k)]))
    return Item(node.sign, fold(inner), {}, sum([x.size for x in inner]), sum([x.link for x in inner]), held=[(node,)])


def page_item(page: Node) -> Item:
    """A page as a wrapper of its own. Pages nest as deep as they like: Python's own calls need no C stack."""
    sys.setrecursionlimit(1 << 20)
    return _item(page)


def fold(items: list[Item]) -> list[Item]:
    """Tandem repeats of one to three items become repeated groups."""
    out: list[Item] = []
    for x in items:
        out.append(x)
        for n in (1, 2, 3):
            while len(out) >= 2 * n and [a.sign for a in out[-2 * n : -n]] == [b.sign for b in out[-n:]] and out[-1].sign is not None:
                merged = []
                for a, b in zip(out[-2 * n : -n], out[-n:], strict=True):
                    y = merge(a, b, True)
                    y.repeated = max(y.repeated, n)
                    merged.append(y)
                out[-2 * n :] = merged
    return out


def merge(a: Item, b: Item, same_page: bool = False) -> Item:
    """What holds of both. Parts of the same page (or wrapper) add their texts up, parts of others keep the texts they share."""
    if same_page:
        fixed = dict(a.fixed)
        for h, (n, pages) in b.fixed.items():
            fixed[h] = (n, max(pages, fixed[h][1]) if h in fixed else pages)
    else:
        fixed = {h: (n, pages + b.fixed[h][1]) for h, (n, pages) in a.fixed.items() if h in b.fixed}
    pages = max(a.pages, b.pages) if same_page else a.pages + b.pages
    children = fold(align(a.children, b.children, same_page)) if a.children or b.children else []
    return Item(a.sign, children, fixed, a.size + b.size, a.link + b.link, pages, a.optional or b.optional, max(a.repeated, b.repeated), "", a.held + b.held)


def align(a: list[Item], b: list[Item], same_page: bool = False) -> list[Item]:
    """One list for both: matches by sign are merged, the rest becomes optional."""
    out, i, j = [], 0, 0
    for p, q in [*matches([x.sign for x in a], [x.sign for x in b]), (len(a), len(b))]:
        for x in a[i:p] + b[j:q]:
            x.optional = True
            out.append(x)
        if p < len(a):
            out.append(merge(a[p], b[q], same_page))
        i, j = p + 1, q + 1
    return out


def matches(a: list, b: list) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence, in order; exact for lists of any length, in memory linear in them."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    out = [(k, k) for k in range(low)]
    todo = [(low, len(a) - high, low, len(b) - high)]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 == a1 or b0 == b1:
            continue
        if a1 - a0 == 1:
            if a[a0] in b[b0:b1]:
                out.append((a0, b.index(a[a0], b0, b1)))
            continue
        middle = (a0 + a1) // 2  # where b splits best for both halves of a
        before = _common(a[a0:middle], b[b0:b1])
        after = _common(a[middle:a1][::-1], b[b0:b1][::-1])[::-1]
        cut = b0 + int((before + after).argmax())
        todo += [(middle, a1, cut, b1), (a0, middle, b0, cut)]
    return sorted(out) + [(len(a) - k, len(b) - k) for k in range(high, 0, -1)]


def _common(a: list, b: list) -> np.ndarray:
    """The length of the longest common subsequence of a and each prefix of b, the columns of one row kept as bits of a number."""
    at: dict = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        met = row & at.get(x, 0)
        row = (row + met | row - met) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def packed(wrapper: Item) -> bytes:
    """A wrapper as bytes, without the nodes it was made of."""
    flat, todo = [], [wrapper]
    while todo:
        x = todo.pop()
        flat.append((len(x.children), x.sign, x.fixed, x.size, x.link, x.pages, x.optional, x.repeated, x.mark))
        todo += reversed(x.children)
    return zlib.compress(pickle.dumps(flat), 1)


def unpacked(data: bytes) -> Item:
    root, open_ = None, []
    for n, sign, fixed, size, link, pages, optional, repeated, mark in pickle.loads(zlib.decompress(data)):
        x = Item(sign, [], fixed, size, link, pages, optional, repeated, mark)
        if root is None:
            root = x
        else:
            open_[-1][0].children.append(x)
        open_.append([x, n])
        while open_ and len(open_[-1][0].children) == open_[-1][1]:
            open_.pop()
    return root


def infer(pages: Iterable[Node]) -> Item:
    """The marked wrapper of pages of one host; pages are taken one by one."""
    wrapper = None
    for page in pages:
        x = page_item(page)
        wrapper = x if wrapper is None else merge(wrapper, x)
    return marked(wrapper or page_item(Node("#")))


def marked(wrapper: Item) -> Item:
    """Mark parts of a wrapper as boiler, template (texts) or article.

    Boiler are elements of other use by their tag, or by their name unless they have an article, main or first heading inside and
    half of the slots' text. The article is every outermost article or main element, if they have ARTICLE_SHARE of the slots'
    text (not in links) and each of them, by page, a fifth of the fullest one's; else the walk from the top enters an only child
    with DESCEND of it. Template are runs' texts that (nearly) all pages have, and repeated groups of links where no
    element holds the article. Where no text differs between pages (or there is one page) all text counts as slots.
    """
    sys.setrecursionlimit(1 << 20)
    differs = wrapper.pages > 1 and any(x.slot() > 0 for x in _runs(wrapper))

    def worth(x: Item) -> float:
        return (x.slot() if differs else x.size) * (1 - x.link / x.size) if x.size else 0.0

    whole = sum([worth(x) for x in _runs(wrapper)])
    mass: dict[int, float] = {}

    def weigh(x: Item) -> tuple[float, bool]:
        """Slots' text of a part, what isn't boiler only; and whether it has an article, main or first heading."""
        if x.sign is None:
            mass[id(x)] = worth(x)
            return mass[id(x)], False
        found, core = 0.0, x.tag in ("article", "main", "h1")
        for y in x.children:
            f, c = weigh(y)
            found, core = found + f, core or c
        if x.tag in BOILER_TAGS or x.named and not (core and found >= whole / 2):
            x.mark, found, core = "boiler", 0.0, False
        mass[id(x)] = found
        return found, core

    weigh(wrapper)
    for tag in ("article", "main"):
        found = _outermost(wrapper, tag)
        if found and sum([mass[id(x)] for x in found]) >= ARTICLE_SHARE * mass[id(wrapper)]:
            by_page = [mass[id(x)] / x.pages for x in found]
            for x, n in zip(found, by_page, strict=True):
                if n >= max(by_page) / 5:
                    x.mark = "article"
            roots = [x for x in found if x.mark == "article"]
            break
    else:
        x, entered = wrapper, True
        while entered:
            entered = False
            for y in x.children:
                if y.sign is not None and y.tag in HOLDERS and mass[id(y)] >= DESCEND * mass[id(x)] > 0:
                    x, entered = y, True
                    break
        x.mark, roots = "article", [x]
    least = max(TEMPLATE_PAGES, math.ceil(TEMPLATE_SHARE * wrapper.pages))
    for root in roots:
        for x in _runs(root):
            x.fixed = {h: (n, pages) for h, (n, pages) in x.fixed.items() if differs and pages >= least}
            x.mark = "template" if x.fixed else ""
        if root.tag in ("#", "html", "body"):
            todo = [*root.children]
            while todo:
                x = todo.pop()
                if x.sign is not None and x.repeated and x.link >= LINKS * x.size > 0:
                    x.mark = "boiler"
                todo += x.children
    return wrapper


def _runs(x: Item) -> Iterator[Item]:
    todo = [x]
    while todo:
        x = todo.pop()
        if x.sign is None:
            yield x
        todo += x.children


def _outermost(wrapper: Item, tag: str) -> list[Item]:
    found, todo = [], [wrapper]
    while todo:
        x = todo.pop()
        if x.sign is None or x.mark == "boiler":
            continue
        if x.tag == tag:
            found.append(x)
        else:
            todo += x.children
    return found


def extract(page: Node, wrapper: Item) -> str:
    """The article's text: its blocks, joined by two line ends. A page that has no part marked as article is judged alone."""
    own = page_item(page)
    marks, roots = _matched(own, wrapper)
    if not roots:
        marks, roots = _matched(own, marked(unpacked(packed(own))))
    blocks: list[str] = []
    part: list[str] = []

    def flush() -> None:
        text = " ".join("".join(part).split())
        part.clear()
        if text:
            blocks.append(text)

    for root in sorted(roots, key=lambda x: x[0]):
        # Iterative, as pages nest as deep as they like; None closes a block. Of a header only headings are read.
        todo: list = [(root[1], False)]
        while todo:
            x = todo.pop()
            if x is None:
                flush()
                continue
            node, in_header = x
            if isinstance(node, str):
                part.append(node)
                continue
            top = node is root[1]
            if not top and (marks.get(id(node), "boiler" if node.named or node.tag in BOILER_TAGS else "") == "boiler"):
                if node.tag != "header":
                    if node.tag not in INLINE:
                        flush()
                    continue
                in_header = True
            if node.tag == "br":
                part.append(" ")
                continue
            if node.tag not in INLINE:
                flush()
                todo.append(None)
            if node.tag in HEADINGS:
                in_header = False
            todo += [(c, in_header) for k, c in reversed([*enumerate(node.children)]) if (id(node), k) not in marks and not (in_header and (isinstance(c, str) or not c.blocks))]
        flush()
    return "\n\n".join(blocks)


def _matched(own: Item, wrapper: Item) -> tuple[dict, list[tuple[int, Node]]]:
    """Marks of a page's elements (by id) and of template children (by id and place), and its articles in page order."""
    marks: dict = {}
    roots: dict[int, Node] = {}
    todo = [(own, wrapper)]
    while todo:
        x, part = todo.pop()
        if x.sign is None:
            if part.mark == "template":
                for (node, start, end), h in _texts(x):
                    if h in part.fixed:
                        marks.update({(id(node), k): "template" for k in range(start, end)})
            continue
        if part.mark == "article":
            roots.update({id(n): n for (n,) in x.held})
        else:
            marks.update({id(n): part.mark for (n,) in x.held})
        todo += [(x.children[p], part.children[q]) for p, q in matches([y.sign for y in x.children], [y.sign for y in part.children])]
    place: list[tuple[int, Node]] = []
    stack, at = [own.held[0][0]], 0
    while stack and len(place) < len(roots):
        node = stack.pop()
        at += 1
        if id(node) in roots:
            place.append((at, node))
        stack += [c for c in reversed(node.children) if not isinstance(c, str)]
    return marks, place


def _texts(run: Item) -> Iterator[tuple[tuple, int]]:
    """Each of a page's runs that a part holds, and the hash of its text."""
    for node, start, end in run.held:
        out: list[str] = []
        for c in node.children[start:end]:
            _inline_text(c, out, [])
        yield (node, start, end), xxhash.xxh3_64_intdigest(" ".join("".join(out).split()).encode("utf-8", "surrogatepass"))


# --- tables ---

_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
_PARTS_OUT = pa.schema([("host", pa.string()), ("turn", pa.int64()), ("wrapper", pa.binary())])
_PARTS_DDL = "host string, turn long, wrapper binary"


def host_of(url):
    """The host of a url column in lower case, without user and port; empty if it has none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def wrappers_of(pages: DataFrame, share: int = SHARE) -> DataFrame:
    """host, wrapper (marked, packed) of each host of pages (host, html), from all its pages in the order of their hash.

    Each page is sent as a packed tree without its text; pages, then wrappers, are merged in groups of about ``share`` until each host has one.
    """

    def trees(batches):
        for b in batches:
            hosts, htmls = b.column(0).to_pylist(), b.column(1).to_pylist()
            for k in range(0, len(hosts), OUT_ROWS):
                part = htmls[k : k + OUT_ROWS]
                turns = [xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) >> 1 for x in part]
                yield batch(_PARTS_OUT, [hosts[k : k + OUT_ROWS], turns, [packed(page_item(parse(x))) for x in part]])

    def merger(last: bool):
        def merged(batches):
            group, wrapper = None, None

            def done():
                return batch(_PARTS_OUT, [[group[0]], [group[1]], [packed(marked(wrapper) if last else wrapper)]])

            for b in batches:
                for host, turn, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if (host, turn) != group:
                        if group:
                            yield done()
                        group, wrapper = (host, turn), unpacked(data)
                    else:
                        sys.setrecursionlimit(1 << 20)
                        wrapper = merge(wrapper, unpacked(data))
            if group:
                yield done()

        return merged

    parts = materialize(pages.select("host", "html").mapInArrow(tidy(trees), _PARTS_DDL), "trees")
    while True:
        sizes = materialize(parts.groupBy("host").agg(F.count("*").alias("n")), "host_sizes")
        most = sizes.agg(F.max("n")).first()[0] or 0
        large = sizes.filter(F.col("n") > share).select("host", F.ceil(F.col("n") / share).alias("shares"))
        dealt = parts.join(large, "host", "left").withColumn("share", F.pmod("turn", F.coalesce("shares", F.lit(1))))
        dealt = dealt.repartition("host", "share").sortWithinPartitions("host", "share", "turn", F.xxhash64("wrapper")).select("host", F.col("share").alias("turn"), "wrapper")
        parts = materialize(dealt.mapInArrow(tidy(merger(most <= share)), _PARTS_DDL), "wrappers")
        if most <= share:
            return parts.select("host", "wrapper")


def extract_pages(pages: DataFrame, share: int = SHARE, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, url, text, n_chars. A null or empty html gives the empty text; an empty table no rows.

    Each host has one wrapper, from all its pages, however many; pages without a host (or url) share one. If all wrappers have
    ``sent_bytes`` together at most they go to every worker; else pages meet the wrapper of their host in a shuffle, where
    a host of many pages is dealt over shares. Repeated rows stay; other columns are ignored.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    wrappers = wrappers_of(rows, share)
    ddl = "page_id long, url string, text string, n_chars long"
    if (wrappers.agg(F.sum(F.length("wrapper"))).first()[0] or 0) <= sent_bytes:
        table = spark.sparkContext.broadcast({r.host: bytes(r.wrapper) for r in wrappers.collect()})

        def texts(batches):
            open_: dict[str, Item] = {}
            for b in batches:
                made = []
                for name, url, page, host in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if host not in open_:
                        open_[host] = unpacked(table.value[host])
                    made.append((name, url, t := extract(parse(page), open_[host]), len(t)))
                    if len(made) == OUT_ROWS:
                        yield batch(_OUT, [*zip(*made, strict=True)])
                        made = []
                if made:
                    yield batch(_OUT, [*zip(*made, strict=True)])

        return rows.mapInArrow(tidy(texts), ddl)
    sizes = rows.groupBy("host").agg(F.ceil(F.count("*") / share).alias("shares"))
    none = F.lit(None)
    copies = wrappers.join(sizes, "host").select(none.cast("long").alias("page_id"), none.cast("string").alias("url"), none.cast("string").alias("html"), "host", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "wrapper")
    large = materialize(sizes.filter("shares > 1"), "large_hosts")
    few = large.count() <= 100_000
    dealt = rows.join(F.broadcast(large) if few else large, "host", "left").withColumn("share", F.pmod(F.xxhash64("page_id", "html"), F.coalesce("shares", F.lit(1))))
    both = dealt.select("page_id", "url", "html", "host", "share", none.cast("binary").alias("wrapper")).unionByName(copies)
    met = both.repartition("host", "share").sortWithinPartitions("host", "share", F.col("wrapper").isNull()).select("page_id", "url", "html", "wrapper")

    def met_texts(batches):
        wrapper = None
        for b in batches:
            made = []
            for name, url, page, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if data is not None:
                    wrapper = unpacked(data)
                    continue
                made.append((name, url, t := extract(parse(page), wrapper), len(t)))
                if len(made) == OUT_ROWS:
                    yield batch(_OUT, [*zip(*made, strict=True)])
                    made = []
            if made:
                yield batch(_OUT, [*zip(*made, strict=True)])

    return met.mapInArrow(tidy(met_texts), ddl)
