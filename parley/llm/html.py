"""Main text of web pages through wrappers: union-free regular expressions inferred per host."""

from __future__ import annotations

import functools
import html
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import per_process, picked
from parley.session import written_once

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?",
    re.S,
)
ATTR = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "template"}
VOID = {"br", "hr", "img", "input", "link", "meta", "wbr", "source", "embed", "area", "base", "col", "track", "param"}
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var".split()
)
# A block of the first kind ends where one of the second begins.
ENDS = {t: {t} for t in ("li", "option", "tr")} | {t: {"dt", "dd"} for t in ("dt", "dd")}
ENDS |= {t: {"td", "th"} for t in ("td", "th")}
NOISE_TAGS = set("head nav header footer aside form script style noscript iframe template menu dialog button select svg".split())
NOISE_TAGS |= RAW
NOISE_NAMES = set(
    "ad ads advert adverts advertisement sponsor sponsored promo banner cookie cookies consent notice notices alert "
    "comment comments reply replies discussion disqus sidebar aside widget related share social breadcrumb "
    "breadcrumbs pagination pager menu nav navbar navigation newsletter subscribe popup modal footer form "
    "contentinfo complementary search dialog".split()
)
MAIN = {"article", "main"}
DEEPEST = 150


class Node:
    """An element of a page: its signature (tag and classes) and its children, texts among them."""

    __slots__ = ("sig", "tag", "noise", "named", "kids", "weight", "clean")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.kids = tag, []
        found = {k.lower(): a or b or c or "" for k, a, b, c in ATTR.findall(attrs)} if attrs.strip() else {}
        names = f"{found.get('class', '')} {found.get('id', '')} {found.get('role', '')}".lower()
        words = set(re.split(r"[\s_-]+", names)) if names.strip() else set()
        hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
        if found.get("role", "").lower() == "main":
            self.tag = "main"
        self.noise = tag in NOISE_TAGS or hidden
        # Noise by a word of class or id alone: a guess, which the text that it holds can refute.
        self.named = not self.noise and bool(words & NOISE_NAMES) and tag not in ("html", "body")
        # Characters of text, without noise by tag; and without noise by words as well.
        self.weight = self.clean = 0
        self.sig = ".".join([self.tag, *sorted(found.get("class", "").lower().split())])

    def unwanted(self) -> bool:
        return self.noise or self.named


def page_tree(source: str) -> Node:
    """The block elements of a page; inline tags are transparent, comments and declarations are gone.

    A start tag without its end ends with its parent, an end tag without its start is passed over.
    Elements nest as deep as the page has them.
    """
    root = Node("#page")
    open_nodes, open_tags, nodes = [root], ["#page"], []
    # Where the open elements of each tag are: an end tag finds its start without a walk.
    places: dict[str, list[int]] = {}

    def close(tags: set[str], stop: set[str]) -> None:
        at = max((places[t][-1] for t in tags if places.get(t)), default=0)
        if at and at > max((places[t][-1] for t in stop if places.get(t)), default=0):
            for t in open_tags[at:]:
                places[t].pop()
            del open_nodes[at:], open_tags[at:]

    def text(raw: str) -> None:
        if raw:
            piece = html.unescape(raw)
            open_nodes[-1].kids.append(piece)
            open_nodes[-1].weight += len(piece.strip())
            open_nodes[-1].clean += len(piece.strip())

    at = 0
    while at < len(source):
        start = source.find("<", at)
        if start < 0:
            text(source[at:])
            break
        text(source[at:start])
        found = TOKEN.match(source, start)
        if not found:
            text("<")
            at = start + 1
            continue
        at = found.end()
        if not found["tag"]:
            continue
        tag = found["tag"].lower()
        if tag in INLINE:
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                open_nodes[-1].kids.append(" ")
        elif found["end"]:
            close({tag}, set())
        else:
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                at = end.end() if end else len(source)
                continue
            # A paragraph ends where any block begins.
            if open_tags[-1] == "p":
                close({"p"}, set())
            if tag in ENDS:
                close(ENDS[tag], {"ul", "ol", "dl", "table", "select"})
            node = Node(tag, found["attrs"])
            open_nodes[-1].kids.append(node)
            nodes.append((node, open_nodes[-1]))
            places.setdefault(tag, []).append(len(open_nodes))
            open_nodes.append(node)
            open_tags.append(tag)
    for node, parent in reversed(nodes):
        if not node.noise:
            parent.weight += node.weight
            parent.clean += 0 if node.named else node.clean
    return root


# Elements that come several times in one container.
SEVERAL = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "tr", "pre", "blockquote", "figure"}

# A wrapper is a nested list of parts: [signature, optional, repeated, parts, text, weight, pages]. A text part
# has the signature "#text"; its text is given while all pages agree on it and null once it is a slot. At least
# so many pages have a part.
SIG, OPTIONAL, REPEATED, PARTS, TEXT, WEIGHT, PAGES = range(7)
# So many wrappers are aligned in one group; shapes of about so many characters are held by a task at once.
TOGETHER, HELD = 32, 20_000_000
# In wrappers of more parts, those that fewer than one page in RARE has are put together, by their weight alone.
PARTS_MOST, RARE, REST = 20_000, 1000, "#rest"


def flat(node: Node) -> Iterator[Node | str]:
    """All that is below a node, in page order."""
    stack = [iter(node.kids)]
    while stack:
        kid = next(stack[-1], None)
        if kid is None:
            stack.pop()
            continue
        yield kid
        if isinstance(kid, Node):
            stack.append(iter(kid.kids))


def wrapper_of(node: Node, depth: int = 1) -> list:
    """The wrapper of one page alone; neighbours of one signature become a repeated group.

    In the wrapper, but not in the page's tree, elements below ``DEEPEST`` levels are siblings.
    """
    parts = []
    for kid in node.kids if depth < DEEPEST else flat(node):
        if isinstance(kid, Node):
            below = [kid.sig, False, False, [], None, 0, 1]
            parts.append(wrapper_of(kid, depth + 1) if depth < DEEPEST else below)
        elif kid.strip():
            parts.append(["#text", False, False, [], " ".join(kid.split()), len(kid), 1])
    return [node.sig, False, False, collapsed(parts), None, sum(p[WEIGHT] for p in parts), 1]


def group_of(run: list[list]) -> list:
    name = "#group " + " ".join(p[SIG] for p in run)
    return [name, False, False, run, None, sum(p[WEIGHT] for p in run), max(p[PAGES] for p in run)]


def collapsed(parts: list[list]) -> list[list]:
    """Squares resolved: parts that follow their own signatures join them in a repeated group.

    A run of one part is repeated itself; runs of two to four parts become a part of signature
    ``#group`` that holds them.
    """
    for size in (1, 2, 3, 4):
        out: list[list] = []
        at = 0
        while at < len(parts):
            run = parts[at : at + size]
            name = [p[SIG] for p in run]
            group = run[0] if size == 1 else group_of(run)
            nxt, times = at + size, 1
            while len(run) == size and [p[SIG] for p in parts[nxt : nxt + size]] == name and (size == 1 or name[0] != name[-1]):
                more = parts[nxt] if size == 1 else group_of(parts[nxt : nxt + size])
                weight = group[WEIGHT] + more[WEIGHT]
                group = merged(group, more, max)
                group[REPEATED], group[WEIGHT] = True, weight
                nxt, times = nxt + size, times + 1
            if times > 1:
                out.append(group)
                at = nxt
            else:
                out.append(parts[at])
                at += 1
        parts = out
    return parts


def added(a: int, b: int) -> int:
    return a + b


def merged(a: list, b: list, pages: Callable[[int, int], int] = added) -> list:
    """Two wrappers of one signature as one: differing texts become slots, parts of one side optional.

    ``pages`` adds the pages of both sides, or takes the ``max`` where both may come from the same pages.
    """
    text = a[TEXT] if a[TEXT] == b[TEXT] else None
    parts, held = aligned(a[PARTS], b[PARTS], pages), pages(a[PAGES], b[PAGES])
    # Rests are of different parts.
    weight = a[WEIGHT] + b[WEIGHT] if a[SIG] == REST else max(a[WEIGHT], b[WEIGHT])
    return [a[SIG], a[OPTIONAL] or b[OPTIONAL], a[REPEATED] or b[REPEATED], parts, text, weight, held]


def aligned(a: list[list], b: list[list], pages: Callable[[int, int], int] = added) -> list[list]:
    """The longest common run of signatures is merged part by part; what lies between is optional."""
    n, m = len(a), len(b)
    if n * m > 1_000_000:
        return aligned_near(a, b, pages)
    names, others = [p[SIG] for p in a], [p[SIG] for p in b]
    if names == others:
        return [merged(x, y, pages) for x, y in zip(a, b)]
    first = next((k for k, (x, y) in enumerate(zip(names, others)) if x != y), min(n, m))
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, first - 1, -1):
        below, row, name = best[i + 1], best[i], names[i]
        for j in range(m - 1, first - 1, -1):
            x, y = below[j], row[j + 1]
            row[j] = below[j + 1] + 1 if name == others[j] else x if x >= y else y
    out, i, j = [merged(x, y, pages) for x, y in zip(a[:first], b[:first])], first, first
    while i < n or j < m:
        if i < n and j < m and a[i][SIG] == b[j][SIG]:
            out.append(merged(a[i], b[j], pages))
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            out.append([a[i][SIG], True, *a[i][2:]])
            i += 1
        else:
            out.append([b[j][SIG], True, *b[j][2:]])
            j += 1
    return collapsed(out)


def aligned_near(a: list[list], b: list[list], pages: Callable[[int, int], int] = added, reach: int = 50) -> list[list]:
    """Alignment of very long parts: each part of ``a`` takes the next of its signature within reach."""
    out, j = [], 0
    for part in a:
        k = next((k for k in range(j, min(j + reach, len(b))) if b[k][SIG] == part[SIG]), None)
        if k is None:
            out.append([part[SIG], True, *part[2:]])
            continue
        out += [[p[SIG], True, *p[2:]] for p in b[j:k]]
        out.append(merged(part, b[k], pages))
        j = k + 1
    return out + [[p[SIG], True, *p[2:]] for p in b[j:]]


def shape(part: list) -> str:
    """The signatures of a wrapper. Wrappers of one shape are merged part by part, in any order alike."""
    return f"{part[SIG]}({''.join(map(shape, part[PARTS]))})" if part[PARTS] else f"{part[SIG]};"


def n_parts(part: list) -> int:
    return 1 + sum(map(n_parts, part[PARTS]))


def without_rare(part: list, least: int) -> list:
    """A wrapper whose optional parts that fewer than ``least`` pages have are one ``#rest`` of their weight."""
    kept, weight = [], 0
    for below in part[PARTS]:
        if below[SIG] == REST or below[OPTIONAL] and below[PAGES] < least:
            weight += slot_weight(below) or below[WEIGHT]
        else:
            kept.append(without_rare(below, least))
    if weight:
        kept.append([REST, True, False, [], None, weight, 0])
    return [*part[:PARTS], kept, *part[TEXT:]]


def inferred(pages: list[str]) -> list:
    """Align the token streams of pages one after the other into a single wrapper."""
    wrapper = None
    for page in pages:
        found = wrapper_of(page_tree(page))
        wrapper = found if wrapper is None else merged(wrapper, found)
    return wrapper


def expression(part: list) -> str:
    """The wrapper as a union-free regular expression: literal texts, ``#`` for slots, ``?`` and ``+``."""
    if part[SIG] == "#text":
        body = "#" if part[TEXT] is None else repr(part[TEXT])
    else:
        body = " ".join(map(expression, part[PARTS]))
        body = body if part[SIG].startswith("#group") else f"<{part[SIG]}>{body}</>"
    mark = ("*" if part[OPTIONAL] else "+") if part[REPEATED] else ("?" if part[OPTIONAL] else "")
    return f"({body}){mark}" if mark else body


def slot_weight(part: list) -> int:
    if part[SIG] == "#text":
        return part[WEIGHT] if part[TEXT] is None else 0
    if part[SIG] == REST:
        return part[WEIGHT]
    return sum(map(slot_weight, part[PARTS])) * (3 if part[REPEATED] else 1)


def main_path(wrapper: list) -> list[str]:
    """Where a wrapper without a marked article has its text: down while one part holds most of the slots.

    The way ends at the container of what may come several times: paragraphs, headings, items and cells are
    never gone into, even where every page has one of them.
    """
    path, part = [], wrapper
    while True:
        inner = [q for p in part[PARTS] for q in (p[PARTS] if p[SIG].startswith("#group") else [p])]
        inner = [p for p in inner if p[SIG] != "#text" and not Node(p[SIG].split(".")[0], f'class="{p[SIG]}"').unwanted()]
        weights = [slot_weight(p) or p[WEIGHT] for p in inner]
        if not inner or max(weights) < 0.6 * max(1, sum(weights)) or inner[weights.index(max(weights))][REPEATED]:
            return path
        part = inner[weights.index(max(weights))]
        if part[SIG] == REST or part[SIG].split(".")[0] in SEVERAL:
            return path
        path.append(part[SIG])


def fixed_texts(wrapper: list, least: int) -> set[tuple[str, str, str]]:
    """Texts of places that ``least`` pages have, with one text in all of them: ``(parent, element, text)``, by signatures."""
    found: set[tuple[str, str, str]] = set()
    stack = [(wrapper, "", "")]
    while stack:
        part, parent, element = stack.pop()
        if part[SIG] == "#text":
            if part[TEXT] is not None and part[PAGES] >= least:
                found.add((parent, element, part[TEXT]))
        else:
            inside = (parent, element) if part[SIG].startswith("#group") else (element, part[SIG])
            stack += [(below, *inside) for below in part[PARTS]]
    return found


def outweighing(named: list[Node], left: int) -> set[Node]:
    """Of elements with a word of noise, the heaviest first, those with more text than is left without them."""
    kept = set()
    for node in sorted(named, key=lambda n: -n.weight):
        if node.weight > left:
            kept.add(node)
            left += node.clean
    return kept


def outermost(node: Node) -> list[Node]:
    """The elements of a region with a word of noise that are in no other such."""
    found, stack = [], [node]
    while stack:
        for kid in stack.pop().kids:
            if isinstance(kid, Node) and not kid.noise:
                (found if kid.named else stack).append(kid)
    return found


def blocks(node: Node, out: list[str | None], fixed: set[tuple[str, str, str]] | frozenset = frozenset()) -> None:
    """Texts of a region in page order, with None at the borders of blocks, without the fixed texts of a host.

    An element goes by a word of its class or id only if it holds no more text than it would leave.
    """
    stack, kept = [iter(node.kids)], outweighing(outermost(node), node.clean)
    place = ["", node.sig]
    while stack:
        kid = next(stack[-1], None)
        if kid is None:
            stack.pop()
            place.pop()
            if stack:
                out.append(None)
        elif isinstance(kid, str):
            if not fixed or (place[-2], place[-1], " ".join(kid.split())) not in fixed:
                out.append(kid)
        elif not kid.noise and (not kid.named or kid in kept):
            if kid.named:
                kept |= outweighing(outermost(kid), kid.clean)
            out.append(None)
            stack.append(iter(kid.kids))
            place.append(kid.sig)


def joined(pieces: list[str | None]) -> str:
    found, now = [], []
    for piece in [*pieces, None]:
        if piece is None:
            block = " ".join("".join(now).split())
            if block:
                found.append(block)
            now = []
        else:
            now.append(piece)
    return "\n".join(found)


def regions(node: Node, marked: bool, path: list[str]) -> list[Node]:
    """The outermost articles of a page, or the node at the end of the wrapper's path.

    An article in an element with a word of noise in its class or id, or with one itself, is left out
    only if it holds no more text than all that has no such word.
    """
    if not marked:
        whole = node
        for sig in path:
            node = next((k for k in node.kids if isinstance(k, Node) and k.sig == sig), None)
            if node is None:
                # The page is built otherwise than most of its host.
                return [whole]
        return [node]
    found, guessed, left, stack = [], [], node.clean, [(node, False)]
    while stack:
        node, named = stack.pop()
        named = named or node.named
        if node.tag in MAIN:
            found.append(node)
            guessed += [node] if named else []
        else:
            stack += [(k, named) for k in reversed(node.kids) if isinstance(k, Node) and not k.noise]
    dropped = set(guessed) - outweighing(guessed, left)
    return [n for n in found if n not in dropped]


class Wrapper:
    """What a host's wrapper says about a page of it: the path to its text and what all pages have at one place."""

    def __init__(self, wrapper: list, pages: int):
        self.path = main_path(wrapper)
        # One or two pages prove nothing about what all pages have; a page of another layout refutes nothing.
        self.fixed = fixed_texts(wrapper, max(3, (pages + 1) // 2))

    @classmethod
    def read(cls, rule: str) -> Wrapper:
        found = cls.__new__(cls)
        found.path, fixed = json.loads(rule)
        found.fixed = set(map(tuple, fixed))
        return found

    def written(self) -> str:
        return json.dumps([self.path, sorted(self.fixed)])

    def main_text(self, source: str) -> str:
        """The regions without the texts that the wrapper has at their place, unless those are too much of it.

        Inside a marked article they are a small part: where a third or more would go, the pages are
        copies of one article and everything stays. Elsewhere everything stays if nothing else would be left.
        """
        tree = page_tree(source)
        marked = regions(tree, True, [])
        found = marked or regions(tree, False, self.path)
        whole = self.text_of(found, frozenset())
        if not self.fixed:
            return whole
        own = self.text_of(found, self.fixed)
        return own if own and (not marked or 3 * (len(whole) - len(own)) < len(whole)) else whole

    @staticmethod
    def text_of(found: list[Node], fixed: set[tuple[str, str, str]] | frozenset) -> str:
        pieces: list[str | None] = []
        for region in found:
            blocks(region, pieces, fixed)
            pieces.append(None)
        return joined(pieces)


def different(pages: DataFrame) -> DataFrame:
    """``host, html`` of every different page of each host, once; only pages that have copies are shuffled."""
    copied = pages.groupBy("host", "h").count().where("count > 1").select("host", "h")
    copied = written_once(copied, "copied-pages")
    if copied.isEmpty():
        return pages.select("host", "html")
    once = pages.join(copied, ["host", "h"], "left_semi").select("host", "h", "html").dropDuplicates(["host", "h"])
    return pages.join(copied, ["host", "h"], "left_anti").select("host", "html").union(once.select("host", "html"))


def shape_wrappers(pages: DataFrame) -> DataFrame:
    """``(host, key, pages, wrapper)``: what each task's pages of one shape say, by the hash of the shape."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, int], list] = {}
        size = 0
        for batch in batches:
            for host, source in zip(batch["host"], batch["html"]):
                found = wrapper_of(page_tree(source))
                key = (host, xxhash.xxh3_64_intdigest(shape(found)) - (1 << 63))
                if key in held:
                    held[key] = merged(held[key], found)
                else:
                    held[key] = found
                    size += len(source)
                if size > HELD:
                    yield rows(held)
                    held, size = {}, 0
        yield rows(held)

    def rows(held: dict[tuple[str, int], list]) -> pd.DataFrame:
        found = [(host, key, wrapper[PAGES], json.dumps(wrapper)) for (host, key), wrapper in held.items()]
        return pd.DataFrame(found, columns=["host", "key", "pages", "wrapper"])

    return pages.select("host", "html").mapInPandas(run, "host string, key bigint, pages bigint, wrapper string")


def host_wrappers(pages: DataFrame) -> DataFrame:
    """``(host, pages, wrapper, expression, rule)``: wrappers as JSON, inferred from all different pages of a host.

    Pages of one shape become one wrapper, in any order. Those of a host are aligned in the order of their hashes,
    about :data:`TOGETHER` at a time, then their results, until one is left: however many pages a host has, no
    task aligns all of them.
    """
    parts = written_once(shape_wrappers(different(pages)), "shape-wrappers")
    # So often the wrappers of a host are dealt into groups before the last group of all.
    levels = parts.groupBy("host").agg(F.count_distinct("key").alias("n"))
    levels = levels.select("host", F.greatest(F.ceil(F.log(float(TOGETHER), "n") - 1e-9) - 1, F.lit(0)).cast("int").alias("level"))
    levels = written_once(levels, "levels")
    found = parts.join(levels, "host")

    def align(group: pd.DataFrame) -> pd.DataFrame:
        host, level, to = group[["host", "level", "to"]].iloc[0]
        wrapper, size = None, 0
        for _, alike in group.sort_values("key").groupby("key"):
            same = functools.reduce(merged, map(json.loads, alike["wrapper"]))
            wrapper = same if wrapper is None else merged(wrapper, same)
            size += n_parts(same)
            if size > PARTS_MOST and (size := n_parts(wrapper)) > PARTS_MOST:
                wrapper = without_rare(wrapper, -(-wrapper[PAGES] // RARE))
                size = n_parts(wrapper)
        return pd.DataFrame({"host": [host], "level": [level], "key": [to], "pages": [wrapper[PAGES]], "wrapper": [json.dumps(wrapper)]})

    def rule(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            wrappers = list(map(json.loads, batch["wrapper"]))
            batch["expression"] = list(map(expression, wrappers))
            batch["rule"] = [Wrapper(w, n).written() for w, n in zip(wrappers, batch["pages"])]
            yield batch

    for turn in range(levels.agg(F.coalesce(F.max("level"), F.lit(0)).alias("k")).first()["k"], -1, -1):
        groups = F.pow(F.lit(TOGETHER), F.least("level", F.lit(turn))).cast("bigint")
        found = found.withColumn("to", F.pmod("key", groups)).groupBy("host", "to")
        found = found.applyInPandas(align, "host string, level int, key bigint, pages bigint, wrapper string")
    kind = "host string, pages bigint, wrapper string, expression string, rule string"
    return found.select("host", "pages", "wrapper").mapInPandas(rule, kind)


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every page.

    Each host's wrapper is inferred from all its different pages and applied to them. The text is that of
    the outermost articles, or of the part of the wrapper that holds most slot text (of the whole page where
    it has no such part), without the texts of places that at least half of a host's pages have (three at
    least) and that are one text in all of them, inside articles too; below it, zones of menus, headers,
    footers, sidebars, notices, adverts,
    forms, scripts, styles and comments are left out - by a word of their class or id only where they hold
    no more text than is left. A null or empty page has an empty text, pages
    without a readable host share a wrapper, repeated rows give repeated rows, an empty table gives none.
    """
    rows = picked(pages, page_id=id_col, url=url_col, html=html_col).withColumn("html", F.coalesce("html", F.lit("")))
    host = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    rows = rows.withColumns({"host": F.lower(host), "h": F.xxhash64("html")})
    wrappers = written_once(host_wrappers(rows).select(F.col("host").alias("site"), "rule"), "wrappers")

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = per_process(("wrappers",), dict)
        for batch in batches:
            texts = []
            for source, rule in zip(batch["html"], batch["rule"]):
                if rule not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[rule] = Wrapper.read(rule)
                texts.append(known[rule].main_text(source))
            sizes = list(map(len, texts))
            yield pd.DataFrame({"page_id": batch["page_id"].array, "url": batch["url"].array, "text": texts, "n_chars": sizes})

    both = rows.join(wrappers, rows["host"] == wrappers["site"])
    both = both.select(F.col("page_id").cast("string"), "url", "html", "rule")
    found = both.mapInPandas(extract, "page_id string, url string, text string, n_chars bigint")
    return found.withColumn("page_id", F.col("page_id").cast(rows.schema["page_id"].dataType))
