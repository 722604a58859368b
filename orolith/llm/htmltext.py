"""Main text of web pages by consensus host paths.

Each page scores its containers; every page of a host votes for the generalised tag-class paths of its best ones, the
votes are summed per host in Spark, and each page is extracted again with its host's winning paths.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tags by their role in HTML: fixed values of the standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("script style noscript template iframe object embed svg canvas audio video picture map nav footer aside form button select option textarea input dialog menu title head noembed noframes xmp".split())
#: A start tag that closes an open element of these names, up to the nearest scope.
CLOSES = {x: frozenset({"p"}) for x in "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()}
CLOSES |= {"li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}), "tr": frozenset({"tr", "td", "th", "p"}), "td": frozenset({"td", "th", "p"}), "th": frozenset({"td", "th", "p"}), "option": frozenset({"option"}), "tbody": frozenset({"thead", "tbody", "tr", "td", "th"}), "body": frozenset({"head"})}
SCOPES = {"li": frozenset({"ul", "ol", "menu"}), "tr": frozenset({"table"}), "td": frozenset({"table", "tr"}), "th": frozenset({"table", "tr"}), "dt": frozenset({"dl"}), "dd": frozenset({"dl"}), "tbody": frozenset({"table"})}
P_SCOPE = frozenset({"td", "th", "table", "li", "div", "article", "section", "main", "body", "blockquote", "button", "caption", "object"})
CONTAINERS = frozenset({"article", "main", "section", "div", "body", "td", "center", "blockquote"})

#: Elements of an article's own matter: their classes and ids say nothing of clutter (a paragraph's only as whole names).
PROSE = frozenset("h1 h2 h3 h4 h5 h6 table tbody thead tr td th caption pre blockquote figure li dt dd".split())

#: Words of classes, ids and roles that name what is not the article.
CLUTTER = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner promo promotion promoted sponsor sponsored sponsors outbrain taboola "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc skip topbar toolbar masthead header footer foot sidebar sidebars aside rail widget widgets "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login paywall "
    "comment comments reply replies respond disqus discussion reactions share sharing social related recommended recommendations trending popular tags".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
HEAD_IN = frozenset({"article", "main", "section"})

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|<(?=/?[a-zA-Z])[^>]*>|[^<]+|<", re.S)
#: A tag whose quotes do not match ends at its first `>`.
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
#: The end tags of the elements whose insides are no markup.
RAW_END = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*>", re.I) for x in RAW}
ATTRIBUTE = re.compile(r"([^\s=/\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
SPLIT_NAME = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "name", "parent", "children", "clutter")

    def __init__(self, tag: str, name: str, parent: Node | None, clutter: bool):
        self.tag, self.name, self.parent, self.clutter = tag, name, parent, clutter
        self.children: list[Node | str] = []


def _described(tag: str, attributes: str) -> tuple[str, bool]:
    """The generalised name (tag and classes without digits, sorted) and whether the element is clutter."""
    if not attributes or "=" not in attributes:
        return tag, tag in DROPPED
    found = {k.lower(): html.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(attributes)}
    classes = re.sub(r"\d+", "", found.get("class", "").lower()).split()
    names = (*classes, found.get("id", "").lower())
    words = set() if tag in PROSE else {w for x in names for w in SPLIT_NAME.findall(x)} if tag != "p" else set(names)
    hidden = "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower() or found.get("aria-hidden") == "true"
    clutter = tag in DROPPED or tag not in ("html", "body", "article", "main") and bool(words & CLUTTER or found.get("role", "").lower() in ROLES) or hidden and tag not in ("html", "body")
    return ".".join([tag, *sorted(set(classes))]), clutter


def parse(page: str) -> Node:
    """A tree of elements and decoded texts; unclosed and misnested tags are closed as browsers do, roughly."""
    root = Node("#", "#", None, False)
    at = root
    tokens = TOKEN.finditer(page)
    while (m := next(tokens, None)) is not None:
        after = m.end()
        if m.group(2) is None:
            piece = m.group()
            if piece[0] != "<" or piece == "<":
                at.children.append(html.unescape(piece) if "&" in piece else piece)
            if (m := LOOSE.fullmatch(piece)) is None:
                continue
        tag = m.group(2).lower()
        if m.group(1):
            node = at
            while node.parent is not None and node.tag != tag:
                node = node.parent
            if node.parent is not None:
                at = node.parent
            continue
        if tag in CLOSES:
            names, scope, node, close = CLOSES[tag], SCOPES.get(tag, P_SCOPE), at, None
            while node.parent is not None and node.tag not in scope | HEAD_IN:
                if node.tag in names:
                    close = node
                node = node.parent
            if close is not None:
                at = close.parent or root
        name, clutter = _described(tag, m.group(3))
        if tag == "header":  # a heading of the article stays, a page header goes
            up = at
            while up is not None and up.tag not in HEAD_IN:
                up = up.parent
            clutter = clutter or up is None
        node = Node(tag, name, at, clutter)
        at.children.append(node)
        if tag in VOID or m.group(3).endswith("/") and tag not in INLINE and tag not in CONTAINERS and tag != "p":
            continue
        if tag in RAW:  # inside a script, style or the like only its own end tag counts
            end = RAW_END[tag].search(page, after)
            if end is None:
                break
            tokens = TOKEN.finditer(page, end.end())
            continue
        at = node
    return root


def blocks(node: Node) -> list[str]:
    """Texts of a node's blocks in page order without clutter, white space collapsed; a block's text runs over its
    inline elements, a line break is white space."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        text = " ".join("".join(held).split())
        if text:
            out.append(text)
        del held[:]

    stack: list[tuple[Node, int]] = [(node, 0)]
    while stack:
        here, i = stack.pop()
        children = here.children
        block = here.tag not in INLINE
        if i == 0 and block:
            flush()
        while i < len(children):
            child = children[i]
            i += 1
            if isinstance(child, str):
                held.append(child)
            elif child.tag == "br":
                held.append(" ")
            elif not child.clutter:
                stack.append((here, i))
                stack.append((child, 0))
                break
        else:
            if block:
                flush()
    return out


def path(node: Node) -> str:
    names = []
    while node.parent is not None:
        if node.tag not in INLINE and node.tag != "p":
            names.append(node.name)
        node = node.parent
    return ">".join(reversed(names))


def _elements(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        node = stack.pop()
        if node.parent is not None:
            yield node
        stack.extend(x for x in reversed(node.children) if isinstance(x, Node) and not x.clutter)


def scores(root: Node) -> list[tuple[Node, float]]:
    """The page's containers with scores: prose characters inside, those in links taken off, with more for an element
    meant for an article and less for what lies around the prose; the narrowest container of almost all prose wins."""
    prose: dict[int, float] = {}
    order = list(_elements(root))
    for node in reversed(order):
        own = 0.0
        for child in node.children:
            if isinstance(child, str):
                own += len(child.strip())
            elif not child.clutter:
                own += prose.get(id(child), 0.0)
        prose[id(node)] = -0.5 * own if node.tag == "a" else own
    out = []
    for node in order:
        if node.tag not in CONTAINERS or prose[id(node)] <= 0:
            continue
        depth, up = 0, node
        while up.parent is not None:
            depth, up = depth + 1, up.parent
        bonus = {"article": 1.5, "main": 1.2}.get(node.tag, 1.0)
        if set(SPLIT_NAME.findall(node.name)) & {"article", "content", "post", "entry", "story", "body", "text", "main"} - {node.tag}:
            bonus = max(bonus, 1.3)
        out.append((node, prose[id(node)] * bonus * (1 + 0.02 * min(depth, 10))))
    return out


def votes(page: str) -> list[tuple[str, float]]:
    """(path, share): the paths of a page's containers with their shares of the best score; the best votes 1."""
    found = scores(parse(page))
    if not found:
        return []
    best = max(s for _, s in found)
    shares: dict[str, float] = {}
    for node, s in found:
        if s >= 0.5 * best:
            p = path(node)
            shares[p] = max(shares.get(p, 0.0), s / best)
    return sorted(shares.items())


def extract(page: str, winners: list[str]) -> str:
    """The text, in page order, of the elements on the first of the winning paths that the page has, and of those on the
    other winning paths that lie neither around nor inside these; of the page's own best container if it has none."""
    root = parse(page)
    wanted = {p: i for i, p in enumerate(winners)}
    found: dict[int, list[Node]] = {}
    if wanted:
        for node in _elements(root):
            if node.tag in CONTAINERS and (rank := wanted.get(path(node))) is not None:
                found.setdefault(rank, []).append(node)
    chosen: list[Node] = []
    taken: set[int] = set()  # what is chosen
    around: set[int] = set()  # what lies around it
    for rank in sorted(found):
        for node in found[rank]:  # outer ones come first
            if id(node) in around or not blocks(node):
                continue
            above, up = [], node.parent
            while up is not None and id(up) not in taken:
                above.append(id(up))
                up = up.parent
            if up is None:
                chosen.append(node)
                taken.add(id(node))
                around.update(above)
    places = {id(x): i for i, x in enumerate(_elements(root))}
    chosen.sort(key=lambda x: places[id(x)])
    if not chosen:
        own = scores(root)
        chosen = [max(own, key=lambda x: x[1])[0]] if own else [root]
    return " ".join(x for node in chosen for x in blocks(node))


#: A host's winning paths have at least this share of the votes of its best one.
CONSENSUS = 0.25
#: Host paths are broadcast up to so many hosts of about a kilobyte; beyond, pages are joined by host.
MOST_HOSTS = 20_000


def host(url: Column) -> Column:
    """The host of a URL in lower case; null and hostless URLs share the empty host."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, paths): each host's winning paths by the sum of its pages' votes, ties by the longer and then by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(h, p, s) for h, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for p, s in votes(page or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.float64()))], names=["host", "path", "share"])

    voted = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, path string, share double")
    summed = voted.groupBy("host", "path").agg(F.sum(F.round(F.col("share") * 1000).cast("long")).alias("votes"))
    most = summed.groupBy("host").agg(F.max("votes").alias("most"))
    winners = summed.join(most, "host").where(F.col("votes") >= CONSENSUS * F.col("most"))
    best = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("v"), (-F.length("path")).alias("l"), "path")))
    return winners.groupBy("host").agg(F.transform(best, lambda x: x["path"]).alias("paths"))


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each page of (page_id, url, html). Null html gives the empty text; repeated rows
    give the same text each and vote each; extra columns, whatever their names, are not read; an empty table gives no rows;
    a page costs time and memory in proportion to its length."""
    from .common import stable

    winners = stable(host_paths(pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page or "", paths or []) for page, paths in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    small = winners.limit(MOST_HOSTS + 1).count() <= MOST_HOSTS
    kept = pages.select("page_id", "url", "html")
    joined = kept.withColumn("of_host", host(F.col("url"))).join(F.broadcast(winners) if small else winners, F.col("of_host") == F.col("host"), "left")
    return joined.select("page_id", "url", "html", "paths").mapInArrow(run, "page_id long, url string, text string, n_chars long")
