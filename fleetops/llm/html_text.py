"""Main text of web pages by consensus of a host's pages.

Each page's containers are scored by the paragraph text that they hold. From the best one it goes up as long as prose
of the same article stands beside it, so that articles split over several containers are whole. The path of the
container reached, made of tags and classes with numbers generalised, is the page's vote; votes are counted per host in Spark, with partial sums, so a host
with a third of all pages is no special case. Pages are then extracted again by the paths that their host agreed on,
the most voted one that the page has, or a wider one of them that is the page's own. A page without any of them, and a page without a host, uses its own best one.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetops.llm.runtime import stored

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes template svg math".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table"
    " tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article main section div td body blockquote html center details".split())
PARTS = frozenset("section blockquote td center details".split())  # containers that are seldom all of an article
PARAGRAPHS = frozenset("p pre blockquote li dd td h1 h2 h3 h4 h5 h6".split())
# Never part of an article, whatever they hold.
ASIDE = frozenset(
    "head script style noscript template nav menu footer aside button select textarea input iframe object embed"
    " dialog svg math canvas audio video map datalist option".split()
)
# Words in class and id that name what is no article. They count as a whole name, or as the first or last part of one.
PLAIN_WORDS = (
    r"nav\w*|menus?|submenu|sidebars?|footers?|masthead|topbar|toolbar|ads?|advert\w*|adsense|sponsor\w*|promo\w*|cookies?"
    r"|consent|gdpr|popups?|comments?|commentlist|disqus|replies|reply|respond|related|recommend\w*|share\w*|sharing|social"
    r"|breadcrumbs?|pagination|pager|newsletter|subscribe|subscription|widgets?|skip-?link|(?:site|page|main|top)-?header"
)
# Words that often are a part of an article's name as well.
LOOSE_WORDS = (
    r"side|foot|header|banners?|notices?|alerts?|disclaimer|modal|overlay|signup|login|search\w*|toc|tags|hidden"
)
NAMED = re.compile(rf"(?:^|[\s])(?:{PLAIN_WORDS}|{LOOSE_WORDS})(?:$|[\s\d])", re.I)
IN_NAME = re.compile(rf"(?:^|[-_\s])(?:{PLAIN_WORDS}|(?!header)(?:{LOOSE_WORDS}))(?:$|[-_\s\d])", re.I)
PLAIN_IN_NAME = re.compile(rf"(?:^|[-_\s])(?:{PLAIN_WORDS})(?:$|[-_\s\d])", re.I)
# Names of a state, such as has-sidebar or comments-open, tell nothing of what an element is.
STATE = re.compile(
    r"(?<![^-_\s])(?:has|have|with|without|no|not|is|hide|show|enable|js)[-_][\w-]+|(?<!\S)[\w-]+[-_](?:open|closed|enabled|disabled|on|off)(?!\S)",
    re.I,
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
UNQUOTED = re.compile(r"[^>\"']*")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
# A start tag that ends an open element of these, unless one of the second list stands in between.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
}
# What may stand in a head; any other start tag, or text, ends one whose end tag is left out.
HEAD = frozenset("title meta link base script style noscript template".split())
SCOPE = frozenset("td th table button body html article section div main aside nav footer header form".split())


@dataclass
class Node:
    tag: str
    parent: Node | None
    attributes: dict = field(default_factory=dict)
    children: list = field(default_factory=list)  # nodes and texts, in order
    left_out: bool = False

    def skipped(self) -> bool:
        """Whether the element is no part of any article; decided by ``judged``."""
        return self.left_out

    def ancestors(self):
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def path(self) -> str:
        steps = [self, *self.ancestors()]
        return ">".join(step.step() for step in reversed(steps[:-1]))

    def step(self) -> str:
        """Tag and classes, each run of digits as one #, classes sorted."""
        classes = sorted({re.sub(r"\d+", "#", c).replace(">", "") for c in self.attributes.get("class", "").split()})
        return ".".join([self.tag, *classes])


class Scanner:
    """Tags of a page, from left to right, in time that grows with the page whatever its quotes are like."""

    def __init__(self, page: str):
        self.page = page
        self.open_ended: set[int] = set()  # quotes after which no tag ends

    def end(self, at: int) -> int:
        """The place of the > that ends a tag: the first outside of quotes, or else the first; -1 if there is none."""
        page, first, seen = self.page, at, []
        while True:
            at = UNQUOTED.match(page, at).end()
            if at < len(page) and page[at] == ">":
                return at
            closing = page.find(page[at], at + 1) if at < len(page) and at not in self.open_ended else -1
            if closing < 0:
                self.open_ended.update(seen)
                if at < len(page):
                    self.open_ended.add(at)
                return page.find(">", first)
            seen.append(at)
            at = closing + 1

    def tags(self) -> Iterator[tuple[int, int, bool, str, str]]:
        """(start, end, is an end tag, name, rest); comments, declarations and instructions have no name.

        The receiver may send the place to go on from.
        """
        page, at = self.page, 0
        while (start := page.find("<", at)) >= 0:
            at = start + 1
            if page.startswith("<!--", start):
                closing = page.find("-->", start + 4)
                end = closing + 3 if closing >= 0 else len(page)
                on = yield start, end, False, "", ""
            elif page.startswith(("<!", "<?"), start):
                closing = page.find(">", start)
                if closing < 0:
                    return
                end = closing + 1
                on = yield start, end, False, "", ""
            elif m := NAME.match(page, start + 1):
                closing = self.end(m.end())
                if closing < 0:
                    return  # no tag ends any more
                end = closing + 1
                on = yield start, end, bool(m[1]), m[2].lower(), page[m.end() : closing]
            else:
                continue
            at = end if on is None else on
            if on is not None:
                yield at, at, False, "", ""


class Open:
    """The elements that are open, outermost first, and at which depths those of a tag are."""

    def __init__(self, root: Node):
        self.nodes = [root]
        self.depths: dict[str, list[int]] = {}
        self.scopes, self.blocks = [0], [0]

    def push(self, node: Node) -> None:
        depth = len(self.nodes)
        self.nodes.append(node)
        self.depths.setdefault(node.tag, []).append(depth)
        if node.tag in SCOPE:
            self.scopes.append(depth)
        if node.tag in BLOCKS:
            self.blocks.append(depth)

    def close(self, depth: int) -> None:
        """The elements from a depth on are closed."""
        while len(self.nodes) > depth:
            node = self.nodes.pop()
            self.depths[node.tag].pop()
            for depths in (self.scopes, self.blocks):
                if depths[-1] == len(self.nodes):
                    depths.pop()

    def last(self, tags) -> int:
        return max((self.depths[t][-1] for t in tags if self.depths.get(t)), default=0)

    def close_within(self, tags, depth: int) -> None:
        """The outermost open element of the tags that is deeper than ``depth`` is closed."""
        found = []
        for tag in tags:
            depths = self.depths.get(tag, ())
            i = bisect_right(depths, depth)
            if i < len(depths):
                found.append(depths[i])
        if found:
            self.close(min(found))


def parsed(page: str) -> Node:
    """A tree of the page: no page is refused, unclosed and stray tags are closed where they must end.

    All that is outside of the head stands in one html and one body element, also where their tags are left out.
    """
    root = Node("", None)
    opened = Open(root)
    at = 0

    def text(until: int) -> None:
        if until > at:
            found = page[at:until]
            if opened.nodes[-1].tag == "head" and found.strip():
                opened.close(len(opened.nodes) - 1)
            opened.nodes[-1].children.append(found)

    scan = Scanner(page).tags()
    for start, end, ends, tag, rest in scan:
        text(start)
        at = end
        if not tag:
            continue
        if ends:
            depth = opened.last([tag])
            # A stray inline end tag ends no block.
            if depth and (tag in BLOCKS or depth > opened.blocks[-1]):
                opened.close(depth)
            continue
        if opened.nodes[-1].tag == "head" and tag not in HEAD:
            opened.close(len(opened.nodes) - 1)
        if tag in BLOCKS:
            opened.close_within(["p"], opened.scopes[-1])
        if tag in ENDS:
            same, fence = ENDS[tag]
            opened.close_within(same, opened.last(fence))
        attributes: dict[str, str] = {}
        for a in ATTRIBUTE.finditer(rest):
            attributes.setdefault(a[1].lower(), entities.unescape(a[2] or a[3] or a[4] or ""))
        child = Node(tag, opened.nodes[-1], attributes)
        opened.nodes[-1].children.append(child)
        if tag in RAW and not rest.endswith("/"):
            found = raw_end(tag).search(page, at)
            at = found.end() if found else len(page)
            scan.send(at)
        elif tag not in VOID:
            opened.push(child)
    text(len(page))
    return judged(rooted(root))


@cache
def raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\s*>", re.I)


def judged(root: Node) -> Node:
    """The tree with all elements marked that are part of no article.

    Some tags, roles and names never are. A form, and an element whose name only has one of the words as a part of it, is
    left out unless it holds most of the page's prose, or for a name an article, a main element or a first heading.
    """
    order = [(root, False)]
    for node, within in order:  # grows while it is walked
        inside = within or node.tag == "article"
        order.extend((c, inside) for c in node.children if isinstance(c, Node))
    prose: dict[int, int] = {}
    main: set[int] = set()
    for node, _ in reversed(order):
        if node.tag in RAW or node.tag in ASIDE or node.tag == "a":
            prose[id(node)] = 0
            continue
        own = sum(len(c.strip()) for c in node.children if isinstance(c, str)) if node.tag in PARAGRAPHS or node.tag not in BLOCKS else 0
        below = [c for c in node.children if isinstance(c, Node)]
        prose[id(node)] = own + sum(prose[id(c)] for c in below)
        if node.tag in ("article", "main", "h1") or any(id(c) in main for c in below):
            main.add(id(node))
    most = prose[id(root)] / 2
    for node, in_article in order:
        names = [STATE.sub(" ", node.attributes.get(n, "")) for n in ("class", "id")]
        much = prose[id(node)] > most
        if node.tag in ASIDE or "hidden" in node.attributes:
            node.left_out = True
        elif node.tag in ("", "html", "body", "article", "main"):
            node.left_out = node.attributes.get("role", "").lower() in ROLES
        elif node.tag == "form":
            node.left_out = not much
        elif node.tag == "header":
            node.left_out = not in_article
        elif node.attributes.get("role", "").lower() in ROLES or any(map(NAMED.search, names)):
            node.left_out = True
        else:
            node.left_out = not (much and id(node) in main) and not much_loose(names, much) and any(map(IN_NAME.search, names))
    return root


def much_loose(names: list[str], much: bool) -> bool:
    """Whether an element with most of the page's prose has only loose words in its names."""
    return much and not any(map(PLAIN_IN_NAME.search, names))


def rooted(root: Node) -> Node:
    """The tree with one html and one body element: those of the page, or new ones, take in what stands beside them."""

    def only(tag: str, parent: Node, children: list) -> tuple[Node, list]:
        """The first element of the tag, or a new one, and the children with all elements of the tag opened."""
        same = [c for c in children if isinstance(c, Node) and c.tag == tag]
        opened = [x for c in children for x in (c.children if isinstance(c, Node) and c.tag == tag else [c])]
        return (same[0] if same else Node(tag, parent)), opened

    html, inside = only("html", root, root.children)
    heads = [c for c in inside if isinstance(c, Node) and c.tag == "head"]
    body, rest = only("body", html, [c for c in inside if not (isinstance(c, Node) and c.tag == "head")])
    root.children, html.children, body.children = [html], [*heads, body], rest
    for parent in (root, html, body):
        for child in parent.children:
            if isinstance(child, Node):
                child.parent = parent
    return root


def blocks(node: Node) -> list[str]:
    """The texts of the blocks in a node, in page order, white space made single; empty ones left out."""
    out: list[str] = []
    run: list[str] = []

    def flush():
        text = " ".join("".join(run).split())
        if text:
            out.append(text)
        run.clear()

    stack: list = [iter(node.children)]
    inside: list[Node] = [node]
    while stack:
        for child in stack[-1]:
            if isinstance(child, str):
                run.append(entities.unescape(child))
            elif child.tag in ("br", "wbr"):
                run.append(" " if child.tag == "br" else "")
            elif not child.skipped():
                if child.tag in BLOCKS:
                    flush()
                stack.append(iter(child.children))
                inside.append(child)
                break
            elif child.tag in BLOCKS:
                flush()
        else:
            stack.pop()
            if inside.pop().tag in BLOCKS:
                flush()
    flush()
    return out


def scored(root: Node) -> list[tuple[Node, float]]:
    """Containers with their scores: paragraph text counts fully for the nearest one, half for the next, and so on.

    Text of links counts against a paragraph.
    """
    scores: dict[int, float] = {}
    nodes: dict[int, Node] = {}

    def credit(node: Node, value: float) -> None:
        share = 1.0
        while node is not None and node.parent is not None:
            if node.tag in CONTAINERS:
                nodes[id(node)] = node
                scores[id(node)] = scores.get(id(node), 0.0) + value * share
                share /= 2
                if share < LEAST_SHARE:
                    return
            node = node.parent

    stack: list[tuple[Node, Node, bool]] = [(root, root, False)]
    while stack:
        node, holder, linked = stack.pop()
        linked = linked or node.tag == "a"
        if node.tag in CONTAINERS:
            holder = node
        for child in node.children:
            if isinstance(child, str):
                size = len(child.strip())
                if size:
                    weight = -1.0 if linked else 1.0 if node.tag in PARAGRAPHS or node.tag not in CONTAINERS else 0.5
                    credit(holder, weight * size)
            elif not child.skipped():
                stack.append((child, holder, linked))
    bonus = {"article": 1.5, "main": 1.25}
    return [(nodes[k], s * bonus.get(nodes[k].tag, 1.0)) for k, s in scores.items()]


def beside(container: Node, branch: Node | None) -> tuple[int, int, int]:
    """Characters of prose in a container itself, of prose in containers in it, and of the rest, outside of a branch.

    The text of a container, apart from that of containers in it, is prose if under a third of it is in links.
    """
    sizes: dict[int, list[int]] = {id(container): [0, 0]}
    stack: list[tuple[Node, Node, bool]] = [(container, container, False)]
    while stack:
        node, holder, linked = stack.pop()
        for child in node.children:
            if isinstance(child, str):
                if any(c.isalnum() for c in child):
                    sizes.setdefault(id(holder), [0, 0])[linked] += len(child.strip())
            elif child is not branch and not child.skipped():
                stack.append((child, child if child.tag in CONTAINERS else holder, linked or child.tag == "a"))
    prose = {k: plain for k, (plain, links) in sizes.items() if 2 * links < plain}
    own = prose.get(id(container), 0)
    return own, sum(prose.values()) - own, sum(map(sum, sizes.values())) - sum(prose.values())


def whole(node: Node) -> Node:
    """The container that holds all of the article of which a container holds the most.

    It is the widest one that adds enough prose to those in it; in an article element any prose is enough, and beside a
    part of a text, or within an own container, a heading or paragraph is. Article and main elements are whole.
    """
    at = branch = node
    size = None
    for up in node.ancestors():
        if at.tag in ("article", "main"):
            break
        if up.tag not in CONTAINERS:
            continue
        own, others, rest = beside(up, branch)
        branch = up
        gained = own + others
        if not gained:
            continue
        if size is None:
            size = sum(beside(node, None)[:2])
        near = gained if up.tag == "article" else own if at.tag in PARTS or up.tag not in ("html", "body") else 0
        if gained >= max(LEAST_PROSE, min(ENOUGH_PROSE, size // 10)) or (near and rest <= near):
            at, size = up, size + gained
    return at


def best(root: Node) -> Node | None:
    """The whole of the container with the highest score; the first in the page of equal ones. None without text."""
    found = [(s, n) for n, s in scored(root) if s > 0]
    if not found:
        return None
    top = max(s for s, _ in found)
    order = {id(n): i for i, (n, _) in enumerate(walk(root))}
    return whole(min((n for s, n in found if s == top), key=lambda n: order[id(n)]))


def walk(root: Node) -> Iterator[tuple[Node, int]]:
    """Nodes in page order with their depth, without those that are part of no article and what is in them."""
    stack = [(root, 0)]
    while stack:
        node, depth = stack.pop()
        yield node, depth
        stack.extend((c, depth + 1) for c in reversed(node.children) if isinstance(c, Node) and not c.skipped())


def extracted(page: str, agreed: list[str]) -> tuple[str, str]:
    """(text, path used) by the first agreed path that gives text, else by the page's own best container."""
    root = parsed(page)
    if agreed:
        depths = {path.count(">") + 1 for path in agreed}
        by_path: dict[str, list[Node]] = {}
        for node, depth in walk(root):
            if depth in depths and node.tag in CONTAINERS:
                by_path.setdefault(node.path(), []).append(node)
        for path in agreed:
            found = [b for n in by_path.get(path, ()) for b in blocks(n)]
            if found:
                # Where some pages of a host have an article in one part and others in several.
                wider = [p for p in agreed if path.startswith(p + ">")]
                if wider and (own := best(root)) is not None and (up := own.path()) in wider:
                    found, path = [b for n in by_path[up] for b in blocks(n)], up
                return "\n".join(found), path
    own = best(root)
    if own is None:
        return "\n".join(blocks(root)), ""
    path, alike = own.path(), [own]
    if own.tag == "article":
        at = path.count(">") + 1
        alike = [n for n, depth in walk(root) if depth == at and n.tag == own.tag and n.path() == path]
    return "\n".join(b for n in alike for b in blocks(n)), path


def host(url: Column) -> Column:
    """The host of a URL in lower case, without user, port and a leading www; null if there is none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def votes(pages: DataFrame) -> DataFrame:
    """Rows (host, path, votes): how many pages of a host have their best container there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = []
            for page in batch.column(1).to_pylist():
                node = best(parsed(page))
                paths.append(node.path() if node else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string())], names=["host", "path"])

    cast = pages.select(host(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    voted = cast.filter("host IS NOT NULL").mapInArrow(run, "host string, path string")
    return voted.filter("path IS NOT NULL").groupBy("host", "path").agg(F.count("*").alias("votes"))


# A container this far above a text, by halves, no longer gains from it.
LEAST_SHARE = 1e-6

# So many characters beside a container are the same article's, or a tenth of its own if that is fewer, but not below the least.
ENOUGH_PROSE, LEAST_PROSE = 100, 25

# A path counts as agreed from this share of its host's votes on; so at most 1 / SHARE paths are kept per host.
SHARE = 0.05


def agreed_paths(counted: DataFrame, share: float = SHARE) -> DataFrame:
    """Rows (host, paths): the paths with a share of the host's votes, the most voted first, then by name."""
    totals = counted.groupBy("host").agg(F.sum("votes").alias("total"))
    kept = counted.join(totals, "host").filter(F.col("votes") >= F.col("total") * share)
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("v"), F.col("path").alias("path"))))
    return kept.groupBy("host").agg(F.transform(ranked, lambda x: x.getField("path")).alias("paths"))


def extract(pages: DataFrame) -> DataFrame:
    """The rows (page_id, url, html) as page_id, url, text, n_chars, path.

    A null page is empty; a page without text gives an empty text and an empty path. Null and broken URLs have no host
    and their pages are extracted alone. Repeated rows are separate pages. Other columns are not read.
    """
    # Read back as a table, the paths have a known size: few are broadcast, and pages stay where they are; beyond that
    # pages are joined by host, and a host with very many pages is a partition that AQE splits.
    paths = stored(agreed_paths(votes(pages)).withColumnRenamed("host", "agreed_host"))
    cast = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host(F.col("url")).alias("host"))
    joined = cast.join(paths, F.col("host") == F.col("agreed_host"), "left").select("page_id", "url", "html", "paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [extracted(h, p or []) for h, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            texts, used = [t for t, _ in done], [p for _, p in done]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(texts, pa.string()),
                    pa.array(map(len, texts), pa.int64()),
                    pa.array(used, pa.string()),
                ],
                names=["page_id", "url", "text", "n_chars", "path"],
            )

    kind = dict(pages.dtypes)["page_id"]
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, path string")


def op3_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


# Checks pages whose article is marked by its tag, as the given ones are: the blocks between the article's tags, in order.
OP3_SQL = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS body FROM pages
), b AS (
  SELECT page_id, url, regexp_replace(regexp_replace(body, '<br>', ' ', 'g'), '</?(p|h[1-6]|li|ul|ol|div|blockquote)>', chr(1), 'g') AS cut FROM a
), c AS (
  SELECT page_id, url, list_filter(list_transform(string_split(regexp_replace(cut, '<[^>]*>', '', 'g'), chr(1)),
    lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))),
    lambda x: x <> '') AS parts FROM b
)
SELECT page_id, url, array_to_string(parts, chr(10)) AS text, CAST(length(array_to_string(parts, chr(10))) AS BIGINT) AS n_chars,
  'html>body>article' AS path FROM c
"""
