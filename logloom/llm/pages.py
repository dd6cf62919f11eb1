"""Main text of web pages by template deduction over the pages of a host.

A page's tokens are its structural elements by path (names with id or class) and the
texts that stand in them. Over a host's pages every token has an occurrence vector:
how often it occurs on each page. Tokens with equal vectors form an equivalence class;
one of two or more tokens that is on at least half of the pages, and two, is valid.
Valid classes nest as their paths do and make up the host's template (``classes``).

Text that fills an element alike wherever it occurs shares the element's vector: it is
template text, if the class is on ``ALIKE`` pages with different longest blocks (so
that copies of one article prove nothing), and is dropped. Headings within an article
or main element stay. What the template's elements hold besides are its slots
(``slots``). The main slot is the largest article or main element that occurs once a
page and holds most of the words outside menus, adverts and the like; without one it
is the deepest element that holds nearly all of these words and of the headings. A
page's text is what it has in that slot. Pages without it, or on hosts without a
template, are judged on their own.

Menus, adverts and the like are known by element name or by a whole id, class or
role (not on html and body, no ids that are anchors, of at most 64 characters). One
that holds most of its host's unlinked words is none. Reader comments in an element
without a telling name that differ from page to page are not told from the article.

Vectors are compared by an order-free hash of (page, count), so classes come
from one aggregate that combines map-side; a host may hold any number of pages. Paths
are chained hashes. Reading a page takes time and memory linear in its length, however
deep it nests; after a tag whose quotes never close, tags end at the next ``>``.

Rows: null html or no main text gives an empty text; null urls are one host;
repeated pages cancel out in pairs of equal hashes, which only merges classes.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, stored

#: Share of the words that an article or main element holds to be the main slot, and any other element.
MAIN_SHARE, NEARLY = 0.6, 0.98
#: Share of a host's words that an element set aside may not hold.
MOST = 0.5
#: Pages with different longest blocks that template text is on, at least.
ALIKE = 3
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTRIBUTES = re.compile(r"""((?:"[^"]*"|'[^']*'|[^'">]+)*+)>""")
_MARK = re.compile(r"""(?<![\w:-])(id|class|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_RAW = frozenset("script style noscript template textarea title select option button svg math iframe object canvas audio video datalist".split())
_STRUCTURE = frozenset(
    "html head body main article section div nav header footer aside form fieldset dialog menu ul ol li dl dt dd table"
    " caption thead tbody tfoot tr td th p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address details summary hr".split()
)
_ASIDE = frozenset("head nav header footer aside form fieldset dialog menu".split())
_ASIDE_WORD = (
    r"(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|sidebar|nav|navbar|navigation|menu|breadcrumbs?|header|footer|masthead"
    r"|cookies?|consent|notice|popup|modal|comments?|disqus|repl(?:y|ies)|related|recommend\w*|share|sharing|social"
    r"|subscribe|newsletter|signup|login|search|pagination|pager|toolbar|contentinfo|complementary)"
)
#: A whole id, class or role: words of the list, with words of place before and of kind behind.
_ASIDE_MARK = re.compile(
    r"(?:(?:site|page|main|global|top|bottom|left|right|primary|secondary|mobile)[-_])*" + _ASIDE_WORD
    + r"(?:[-_]?0|[-_](?:" + _ASIDE_WORD + r"|left|right|top|bottom|area|bar|box|block|slot|unit|widget|wrap|wrapper|container|inner|list"
    r"|links?|items?|icons?|buttons?|form|posts?|articles?|stories))*"
)
#: Elements whose ids are anchors named after headings.
_ANCHORS = frozenset("h1 h2 h3 h4 h5 h6 section article main p li dt dd tr td th".split())
_HEADINGS = frozenset(("h1", "h2"))
_ALL_HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
_CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
_INSIDE_P = frozenset(_STRUCTURE)


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


class Page:
    """Paths of a page, parents first, and its runs of text in order.

    Of each path: hash, place of the parent (-1: none), element name, depth, occurrences,
    set aside itself or within such an element, within an article or main element.
    """

    def __init__(self, html: str, spared: frozenset[int] = frozenset()):
        self.place: dict[int, int] = {}
        self.hashes: list[int] = []
        self.parents: list[int] = []
        self.names: list[str] = []
        self.depths: list[int] = []
        self.counts: list[int] = []
        self.marked: list[bool] = []
        self.aside: list[bool] = []
        self.in_article: list[bool] = []
        self.blocks: list[tuple[int, str, int]] = []  # path, text, code points not in links
        self._read(html, spared)

    def _path(self, parent: int, name: str, attributes: str, spared: frozenset[int]) -> int:
        label, aside = _label(name, attributes)
        key = _hash(f"{self.hashes[parent] if parent >= 0 else 0}/{label}")
        at = self.place.setdefault(key, len(self.hashes))
        if at < len(self.hashes):
            self.counts[at] += 1
            return at
        inside = parent >= 0 and (self.in_article[parent] or self.names[parent] in ("article", "main"))
        aside = (aside or (name in _ASIDE and not (name == "header" and inside))) and key not in spared
        self.hashes.append(key)
        self.parents.append(parent)
        self.names.append(name)
        self.depths.append(self.depths[parent] + 1 if parent >= 0 else 1)
        self.counts.append(1)
        self.marked.append(aside)
        self.aside.append(aside or (parent >= 0 and self.aside[parent]))
        self.in_article.append(inside)
        return at

    def _read(self, page: str, spared: frozenset[int]) -> None:
        stack: list[tuple[str, int]] = []
        places: dict[str, list[int]] = {}  # where an element name is in the stack
        held: list[str] = []
        at, size, link, linked, quotes = 0, len(page), False, 0, True

        def last(names) -> int:
            return max((places[n][-1] for n in names if places.get(n)), default=-1)

        def flush() -> None:
            nonlocal linked
            text = " ".join(entities.unescape("".join(held)).split()) if held else ""
            if text:
                self.blocks.append((stack[-1][1] if stack else -1, text, max(len(text) - linked, 0)))
            held.clear()
            linked = 0

        def close(to: int) -> None:
            flush()
            while len(stack) > to:
                places[stack.pop()[0]].pop()

        def hold(to: int) -> None:
            nonlocal linked
            if to > at:
                held.append(page[at:to])
                linked += to - at if link else 0

        while at < size:
            start = page.find("<", at)
            if start < 0:
                hold(size)
                break
            m, attributes = _TAG.match(page, start), ""
            if m:
                rest = _ATTRIBUTES.match(page, m.end()) if quotes else None
                quotes = rest is not None
                end = rest.end() if rest else page.find(">", m.end()) + 1
                attributes = page[m.end() : end - 1]
            elif page.startswith("<!--", start):
                end = page.find("-->", start + 4) + 3
                end = size if end < 3 else end
            elif page[start + 1 : start + 2] in ("!", "?"):
                end = page.find(">", start) + 1
            else:
                hold(start + 1)
                at = start + 1
                continue
            if not end:  # no tag ends after this
                hold(size)
                break
            hold(start)
            at = end
            if not m:
                continue
            name, closing, empty = m[2].lower(), bool(m[1]), attributes.endswith("/")
            if name == "br":
                held.append(" ")
            elif name == "a":
                link = not closing
            elif name in _RAW:
                if not closing and not empty:
                    found = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                    at = found.end() if found else size
            elif name in _STRUCTURE and closing:
                if places.get(name):
                    close(places[name][-1])
                else:
                    flush()
            elif name in _STRUCTURE:
                if stack and stack[-1][0] == "p" and name in _INSIDE_P:
                    close(len(stack) - 1)
                own, scope = _CLOSED_BY.get(name, ((), ()))
                if last(own) > last(set(scope) - set(own)):
                    close(last(own))
                flush()
                if name == "hr":
                    continue
                path = self._path(stack[-1][1] if stack else -1, name, attributes, spared)
                if not empty:
                    places.setdefault(name, []).append(len(stack))
                    stack.append((name, path))
        flush()

    def under(self, weights: list[tuple[int, int]]) -> list[int]:
        """Sums of (path, weight) over each path and what it holds."""
        sums = [0] * len(self.hashes)
        for path, n in weights:
            if path >= 0:
                sums[path] += n
        for path in range(len(sums) - 1, -1, -1):
            if self.parents[path] >= 0:
                sums[self.parents[path]] += sums[path]
        return sums

    def kept(self) -> list[tuple[int, int]]:
        """(path, unlinked code points) of the blocks that are not set aside."""
        return [(path, n) for path, _, n in self.blocks if path < 0 or not self.aside[path]]

    def alike(self) -> dict[int, int]:
        """Hash of all text that stands in a path itself, but for headings of articles."""
        texts: dict[int, list[str]] = {}
        for path, text, _ in self.blocks:
            if path >= 0 and not (self.in_article[path] and self.names[path] in _ALL_HEADINGS):
                texts.setdefault(path, []).append(text)
        return {path: _hash("\n".join(t)) for path, t in texts.items()}


def _label(name: str, attrs: str) -> tuple[str, bool]:
    """Token of an element, and whether it is set aside by a mark."""
    label, aside = [name], False
    for kind, x, y, z in _MARK.findall(attrs) if "=" in attrs else ():
        marks = re.sub(r"\d+", "0", (x or y or z).lower()).replace("/", "|").split()
        label += marks
        if name not in ("html", "body") and not (kind.lower() == "id" and name in _ANCHORS):
            aside = aside or any(len(m) <= 64 and _ASIDE_MARK.fullmatch(m) for m in marks)
    return ".".join(label), aside


def _named(page: Page, path: int) -> bool:
    return page.names[path] in ("article", "main")


def _main(page: Page, main: int | None) -> int:
    """Place of the host's main element, or else of the page's own; -1 without one."""
    kept = page.kept()
    under, total = page.under(kept), sum(n for _, n in kept)
    at = page.place.get(main, -1)
    if at >= 0 and (_named(page, at) or under[at] >= MAIN_SHARE * total):  # else it is laid out differently
        return at
    once = [p for p, c in enumerate(page.counts) if c == 1 and not page.aside[p]]
    named = [p for p in once if _named(page, p)]
    fit = [p for p in once if under[p] >= NEARLY * total]
    return max(named or fit, key=lambda p: (under[p], page.depths[p], page.hashes[p]), default=-1)


def _slots(page: Page, main: int | None, fixed: frozenset[int]) -> list[tuple[int, bool, str]]:
    """(path, in the main slot, text) of the blocks that are no template text."""
    chosen = _main(page, main)
    inside = [False] * len(page.hashes)
    for path, parent in enumerate(page.parents):
        inside[path] = path == chosen or (parent >= 0 and inside[parent])
    return [
        (page.hashes[path] if path >= 0 else 0, (chosen < 0 or (path >= 0 and inside[path])) and not (path >= 0 and page.aside[path]), text)
        for path, text, _ in page.blocks
        if path < 0 or page.hashes[path] not in fixed
    ]


def main_text(html: str, main: int | None, spared: frozenset[int] = frozenset(), fixed: frozenset[int] = frozenset()) -> str:
    """Text of the blocks in the main element, one per line."""
    return "\n".join(text for _, kept, text in _slots(Page(html, spared), main, fixed) if kept)


def host() -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


_COLUMNS = {
    "host": "string", "path": "long", "parent": "long", "depth": "int", "named": "boolean", "vector": "long",
    "c": "long", "n": "long", "t": "long", "h": "long", "th": "long", "m": "long", "text": "long", "longest": "long",
}


def _paths(pages: DataFrame) -> DataFrame:
    """Per host and path of (page_id, host, html, spared): pages, occurrences, their
    vector, code points (n of t on these pages, h of th in headings) that are not set
    aside, and, if the element is, those in it (m); whether its own text is the same
    everywhere (fixed), and of how many different longest blocks the pages are at
    least (kinds). Path 0 has m of all blocks."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        cols = (b.column(c).to_pylist() for c in ("page_id", "host", "spared"))
        for page_id, h, spared, html in zip(*cols, b.column("html")):
            page = Page(html.as_py() or "", frozenset(spared or ()))
            kept = page.kept()
            heads = [(path, n) for path, n in kept if path >= 0 and page.names[path] in _HEADINGS]
            total, head_total = sum(n for _, n in kept), sum(n for _, n in heads)
            under, head = page.under(kept), page.under(heads)
            held = page.under([(path, n) for path, _, n in page.blocks if path >= 0 and page.aside[path]])
            texts = [text for path, text, _ in page.blocks if path < 0 or not page.aside[path]]
            longest, alike = _hash(max(texts, key=lambda t: (len(t), t), default="")), page.alike()
            every = sum(n for _, _, n in page.blocks)
            out.append((h, 0, 0, 0, False, 0, 1, total, total, head_total, head_total, every, None, longest))
            for i, path in enumerate(page.hashes):
                parent = page.hashes[page.parents[i]] if page.parents[i] >= 0 else 0
                c = page.counts[i]
                sizes = (c, under[i], total, head[i], head_total, held[i] if page.marked[i] else 0)
                out.append((h, path, parent, page.depths[i], _named(page, i), _hash(f"{page_id} {c}"), *sizes, alike.get(i), longest))
        kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
        yield pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for v, k in zip(zip(*out), _COLUMNS.values())], list(_COLUMNS))

    rows = map_arrow(pages, run, ", ".join(f"{c} {k}" for c, k in _COLUMNS.items()))
    sums = (F.sum(c).alias(c) for c in ("c", "n", "t", "h", "th", "m"))
    # six bits of the hash pick a bit of a word: as many bits, so many blocks at least
    bits = (F.expr(f"bit_count(bit_or(shiftleft(1L, cast(shiftright(longest, {6 * i}) & 63 as int))))") for i in range(4))
    first = (F.first(c).alias(c) for c in ("parent", "depth", "named"))  # the path determines them
    return stored(
        rows.groupBy("host", "path").agg(
            F.count("*").alias("pages"), F.expr("bit_xor(vector)").alias("vector"), *sums, *first,
            F.expr("count(text) = count(*) and min(text) = max(text)").alias("fixed"), F.greatest(*bits).alias("kinds"),
        ),
        "paths",
    )


def _valid(paths: DataFrame) -> DataFrame:
    """Paths of valid classes, with the number of tokens of their class: paths, and
    texts that share the vector of the path they fill."""
    hosts = paths.where("path = 0").select("host", F.col("pages").alias("all"))
    token = paths.where("path <> 0").join(hosts, "host").where("pages >= 2 and 2 * pages >= all")
    members = token.groupBy("host", "pages", "vector").agg(F.sum(F.when(F.col("fixed"), 2).otherwise(1)).alias("tokens"))
    return token.join(members.where("tokens >= 2"), ["host", "pages", "vector"])


def _all_paths(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths of every host, and (host, spared): the paths not set aside as they hold most of its words."""
    rows = pages.select("page_id", host().alias("host"), "html")
    paths = _paths(rows.withColumn("spared", F.array().cast("array<long>")))
    every = paths.where("path = 0").select("host", F.col("m").alias("every"))
    spared = stored(
        paths.where("path <> 0 and m > 0").join(every, "host").where(F.col("m") >= MOST * F.col("every"))
        .groupBy("host").agg(F.sort_array(F.collect_list("path")).alias("spared")),
        "spared",
    )
    if not spared.isEmpty():  # read the pages of these hosts again
        paths = paths.join(spared, "host", "left_anti").unionByName(_paths(rows.join(spared, "host")))
    return paths, spared


def classes(pages: DataFrame) -> DataFrame:
    """The valid classes of each host of (page_id, url, html): (host, class, pages, tokens,
    depth of the outermost path, within: the class around that path, null at the top)."""
    token = stored(_valid(_all_paths(pages)[0]).withColumn("class", F.xxhash64("pages", "vector")), "tokens")
    outer = token.groupBy("host", "class", "pages", "tokens").agg(F.min(F.struct("depth", "path", "parent")).alias("x"))
    around = token.select("host", F.col("path").alias("parent"), F.col("class").alias("within"))
    outer = outer.select("host", "class", "pages", "tokens", "x.depth", "x.parent")
    return outer.join(around, ["host", "parent"], "left").drop("parent")


def templates(pages: DataFrame) -> DataFrame:
    """(host, main, spared, fixed): the path of each host's main element, the paths not
    set aside, and those whose own text is template text, from (page_id, url, html)."""
    paths, spared = _all_paths(pages)
    valid = _valid(paths)
    # once a page: the largest article or main, else the deepest element; of equal ones that of the larger class
    named = F.col("named") & (F.col("n") >= MAIN_SHARE * F.col("t"))
    nearly = (F.col("n") >= NEARLY * F.col("t")) & (F.col("h") >= NEARLY * F.col("th"))
    fit = (F.col("c") == F.col("pages")) & (F.col("n") > 0) & (named | nearly)
    order = F.struct(named.alias("named"), F.when(named, F.col("n")).otherwise(0).alias("size"), "depth", "tokens", "n", "path")
    text = F.when(F.col("fixed") & (F.col("kinds") >= ALIKE), F.col("path"))
    # a host's fixed paths are on half of its pages each, so no more than two pages hold
    found = valid.groupBy("host").agg(F.max(F.when(fit, order)).alias("x"), F.sort_array(F.collect_list(text)).alias("fixed"))
    return found.select("host", F.col("x.path").alias("main"), "fixed").join(spared, "host", "full")


def _with_templates(pages: DataFrame) -> DataFrame:
    found = stored(templates(pages), "templates")
    rows = pages.select("page_id", "url", "html", host().alias("host")).join(found, "host", "left")
    return rows.select("page_id", "url", "html", "main", "spared", "fixed")


def slots(pages: DataFrame) -> DataFrame:
    """(page_id, url, place, slot, kept, text): every block of (page_id, url, html) that is
    no template text, in page order, with the path that holds it and whether it is main text."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        cols = (b.column(c).to_pylist() for c in ("page_id", "url", "main", "spared", "fixed"))
        for page_id, url, main, spared, fixed, html in zip(*cols, b.column("html")):
            found = _slots(Page(html.as_py() or "", frozenset(spared or ())), main, frozenset(fixed or ()))
            out += [(page_id, url, i, *x) for i, x in enumerate(found)]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
        columns = zip(*out) if out else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    names = ["page_id", "url", "place", "slot", "kept", "text"]
    return map_arrow(_with_templates(pages), run, "page_id long, url string, place long, slot long, kept boolean, text string")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of (page_id, url, html)."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        cols = (b.column(c).to_pylist() for c in ("main", "spared", "fixed"))
        texts = [main_text(p.as_py() or "", m, frozenset(s or ()), frozenset(f or ())) for p, m, s, f in zip(b.column("html"), *cols)]
        yield pa.RecordBatch.from_arrays(
            [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )

    return map_arrow(_with_templates(pages), run, "page_id long, url string, text string, n_chars long")
