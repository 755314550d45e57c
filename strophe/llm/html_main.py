"""HTML extraction with consensus host paths.

Each page is read once into a tree of containers with blocks of text. A container's score is the text of its own blocks
less twice their link text, half of which its parent gets too; class words of menus, adverts or comments lower the
scores below them and skip nothing. Pages vote, with each container's share of the page, for the generalised path of
tags and classes (digits become #) from the root; votes, pages and different texts are summed by host and path in Spark,
and the path with most votes wins the host. Paths are chained 64-bit hashes, so depth costs nothing.

Pages are then read again. The winner's containers (where a page has none with text, its own best container and all of that path) are
widened: to the article or main element around them, else upward while the text beside them stands directly in the
parent or under paths that most of the host's pages fill with texts of their own. Inside, what tags mark as no article
goes, and what class words mark if a second sign agrees (see no_passages), unless an article or main element is inside;
so do paths of 3 percent of the text or more that repeat the same texts over a host whose articles differ. A page's only
h1 before the text is its title. Buttons, drawings and players inside a line are left out without ending its block.

Defined results: null html has no text; a null url belongs to the host ''; null ids and repeated rows stay, one row
each; an empty table gives an empty result; extra columns are ignored. Texts are read whole, at any length and depth.
"""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.llm.common import checkpoint

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>", re.S)
ATTRIBUTE = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
RAW = {"script", "style", "textarea", "title", "noscript", "template", "xmp", "iframe"}
RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}
VOID = {"br", "hr", "img", "input", "meta", "link", "source", "track", "wbr", "area", "base", "col", "embed", "param"}
LEAVES = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "pre", "blockquote", "figcaption", "td", "th", "caption", "summary", "address"}
#: Leaves that quote or tabulate: class words say nothing about them.
QUOTES = {"dt", "dd", "pre", "blockquote", "figcaption", "td", "th", "caption", "address"}
CONTAINERS = {"html", "body", "div", "section", "article", "main", "table", "tbody", "thead", "tfoot", "tr", "ul", "ol", "dl", "figure", "center", "details", "fieldset", "header", "form"}
#: Elements that are never part of an article, and those that are none unless one is inside them.
SKIPPED = {"head", "nav", "footer", "aside", "button", "select", "dialog", "svg", "object", "menu", "canvas", "audio", "video"}
#: Those of them that stand in a line of text and do not end its block.
INLINE = {"button", "select", "svg", "object", "canvas", "audio", "video"}
BLOCKS = LEAVES | CONTAINERS | (SKIPPED - INLINE) | {"hr"}
#: Words of a class, id or role that mark what is not the article, and words beside them that take the mark back
#: ("has-sidebar", "search-page", "entry-header").
NOT_ARTICLE = set(
    "ad ads advert adverts advertisement sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead comment comments disqus replies respond "
    "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup share sharing social related recommended widget pagination pager search login skip "
    "complementary contentinfo hidden".split()
)
TAKEN_BACK = set("has no not with without is page layout template theme body content article entry post story main text wrapper container enabled open closed".split())
IS_ARTICLE = set("article content entry post story main body text".split())
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: An opening tag ends these open elements, up to the nearest of the second set.
LIST_ITEM, TERM, CELL = ({"li"}, {"ul", "ol", "menu"}), ({"dt", "dd"}, {"dl"}), ({"td", "th"}, {"table", "tr"})
ENDS = {"li": LIST_ITEM, "dt": TERM, "dd": TERM, "td": CELL, "th": CELL, "tr": ({"tr", "td", "th"}, {"table"})}
MARKED = 0.2
#: A marked container with fewer words outside links is no passage of the article.
PASSAGE = 30
SUBSTANTIAL = 0.03


class Node(NamedTuple):
    """A container, in page order; `path` is the hash of all labels from the root."""

    parent: int
    tag: str
    path: int
    named: bool
    marked: bool


class Block(NamedTuple):
    node: int
    text: str
    linked: int
    tag: str


def attributes(attrs: str) -> tuple[str, bool, bool]:
    """Sorted classes with digits generalised; whether a class, id or role names an article; whether one marks something else."""
    names, article, marked = set(), False, False
    for kind, *values in ATTRIBUTE.findall(attrs):
        for token in next((v for v in values if v), "").split():
            words = {w.lower() for w in WORD.findall(token)}
            article |= not IS_ARTICLE.isdisjoint(words)
            marked |= not NOT_ARTICLE.isdisjoint(words) and TAKEN_BACK.isdisjoint(words)
            if kind.lower() == "class":
                names.add(re.sub(r"\d+", "#", token))
    return ".".join(sorted(names)), article, marked


def read_page(html: str) -> tuple[list[Node], list[Block]]:
    """Containers and blocks of a page; container 0 is the page itself."""
    nodes = [Node(-1, "", 0, False, False)]
    blocks: list[Block] = []
    stack: list[tuple[str, int, bool]] = []  # tag, container that it makes or -1, skipped from here
    opened: dict[str, int] = {}
    buffer: list[str] = []
    own, linked, in_link, skipping, at = 0, 0, 0, 0, 0

    def flush():
        nonlocal linked
        if skipping:  # a block inside a button or the like: the line goes on after it
            return
        if buffer:
            text = re.sub(r"\s+", " ", "".join(buffer)).strip()
            if text:
                blocks.append(Block(own, text, min(linked, len(text)), stack[-1][0] if stack else ""))
            buffer.clear()
        linked = 0

    def pop_to(depth: int):
        nonlocal own, skipping
        while len(stack) > depth:
            tag, made, skips = stack.pop()
            opened[tag] -= 1
            skipping -= skips
            if made >= 0:
                own = nodes[made].parent

    def text_of(raw: str):
        nonlocal linked
        if stack and stack[-1][0] == "head" and raw.strip():
            pop_to(len(stack) - 1)
        if raw and not skipping:
            text = unescape(raw) if "&" in raw else raw
            buffer.append(text)
            if in_link:
                linked += len(text)

    while (m := TOKEN.search(html, at)) is not None:
        text_of(html[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["close"]:
            if tag == "a":
                in_link = 0
            if tag not in BLOCKS and tag not in INLINE:
                continue
            at_tag = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None) if opened.get(tag) else None
            if tag in INLINE:
                if at_tag is not None:
                    pop_to(at_tag)
                continue
            if at_tag is not None:  # what was left open in the line ends with its block
                pop_to(next((i for i in range(at_tag + 1, len(stack)) if stack[i][0] in INLINE), len(stack)))
            flush()
            if at_tag is not None:
                pop_to(at_tag)
            continue
        if tag in RAW:
            end = RAW_END[tag].search(html, at)
            at = end.end() if end else len(html)
            if tag not in ("script", "style"):
                text_of(" ")
            continue
        if tag == "br":
            text_of(" ")
        elif tag == "a":
            in_link = 1
        if tag in INLINE:
            if not m["attrs"].rstrip().endswith("/"):
                stack.append((tag, -1, True))
                opened[tag] = opened.get(tag, 0) + 1
                skipping += 1
            continue
        if tag not in BLOCKS:
            continue
        flush()
        in_link = 0
        if tag in VOID:
            continue
        if stack and stack[-1][0] in ("p", "head"):
            pop_to(len(stack) - 1)
        if tag in ENDS:
            ended, within = ENDS[tag]
            last = None
            if any(opened.get(t) for t in ended):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in ended:
                        last = i
                    if stack[i][0] in within and not (tag == "tr" and stack[i][0] == "tr"):
                        break
            if last is not None:
                pop_to(last)
        names, article, marked = attributes(m["attrs"]) if "=" in m["attrs"] else ("", False, False)
        if tag in ("html", "body"):
            marked = False
        elif tag == "form" or (tag == "header" and not article and not opened.get("article") and not opened.get("main")):
            marked = True
        elif tag in QUOTES:
            marked = False
        skips, made = tag in SKIPPED, -1
        if not skips and not skipping and (tag in CONTAINERS or marked):
            made = len(nodes)
            path = xxhash.xxh3_64_intdigest(f"{nodes[own].path}/{tag}.{names}".encode()) >> 1
            nodes.append(Node(own, tag, path, tag in ("article", "main") or article, marked))
            own = made
        skipping += skips
        stack.append((tag, made, skips))
        opened[tag] = opened.get(tag, 0) + 1
    text_of(html[at:])
    pop_to(next((i for i, x in enumerate(stack) if x[0] in INLINE), len(stack)))
    flush()
    return nodes, blocks


def subtree_ends(nodes: list[Node]) -> list[int]:
    """For each container the number after its last descendant's."""
    ends = list(range(1, len(nodes) + 1))
    for i in range(len(nodes) - 1, 0, -1):
        ends[nodes[i].parent] = max(ends[nodes[i].parent], ends[i])
    return ends


def is_article(node: Node) -> bool:
    return node.tag in ("article", "main") and not node.marked


def marks(nodes: list[Node]) -> list[bool]:
    """Which containers are marked as no article. An article or main element inside takes the mark back, but one that lies under marks itself only where the page has no other."""
    under = [False] * len(nodes)
    for i, n in enumerate(nodes[1:], 1):
        under[i] = n.marked or under[n.parent]
    articles = [i for i, n in enumerate(nodes) if is_article(n)]
    holds = [False] * len(nodes)
    for i in [i for i in articles if not under[i]] or articles:
        holds[i] = True
    for i in range(len(nodes) - 1, 0, -1):
        holds[nodes[i].parent] |= holds[i]
    return [n.marked and not h for n, h in zip(nodes, holds, strict=True)]


def no_passages(nodes: list[Node], blocks: list[Block], marked: list[bool], ends: list[int]) -> list[bool]:
    """The marked containers that a second sign shows to be no part of an article's text.

    The signs: few words outside links, a third of the text or more in links, or a place at the begin or the end of the
    unmarked text around it. A marked passage between unmarked ones stays.
    """
    under = [False] * len(nodes)
    for i, n in enumerate(nodes[1:], 1):
        under[i] = marked[i] or under[n.parent]
    first, size, linked, words = [len(blocks)] * len(nodes), [0] * len(nodes), [0] * len(nodes), [0] * len(nodes)
    last, plain = [-1] * len(nodes), [0]
    for k, b in enumerate(blocks):
        i = b.node
        first[i], last[i] = min(first[i], k), k
        size[i] += len(b.text)
        linked[i] += b.linked
        words[i] += len(b.text.split()) if 2 * b.linked < len(b.text) else 0
        plain.append(plain[-1] + (not under[i]))
    for i in range(len(nodes) - 1, 0, -1):
        up = nodes[i].parent
        first[up], last[up] = min(first[up], first[i]), max(last[up], last[i])
        for total in (size, linked, words):
            total[up] += total[i]
    out = [False] * len(nodes)
    for i, n in enumerate(nodes):
        if not marked[i] or last[i] < 0:
            continue
        up, before, after = n.parent, 0, 0
        while up >= 0 and not before + after:
            before, after = plain[first[i]] - plain[first[up]], plain[last[up] + 1] - plain[last[i] + 1]
            up = nodes[up].parent
        out[i] = words[i] < PASSAGE or 3 * linked[i] >= size[i] or not before or not after
    return out


def scores(nodes: list[Node], blocks: list[Block], marked: list[bool]) -> list[float]:
    factor = [1.0] * len(nodes)
    for i, n in enumerate(nodes[1:], 1):
        factor[i] = min(factor[n.parent], MARKED if marked[i] else 1.0)
    out = [0.0] * len(nodes)
    for b in blocks:
        worth = max(0, len(b.text) - 2 * b.linked)
        i = b.node
        for share in (1.0, 0.5):
            if i >= 0:
                out[i] += worth * share * factor[i] * (1.5 if nodes[i].named else 1.0)
                i = nodes[i].parent
    return out


def votes(html: str) -> list[tuple[int, int, int | None]]:
    """(path, share of the page's scores in millionths, hash of its text where that is a substantial part of the page) of each path."""
    nodes, blocks = read_page(html)
    own = scores(nodes, blocks, marks(nodes))
    total = sum(own)
    if not total:
        return []
    sizes, texts = [0] * len(nodes), [0] * len(nodes)
    for b in blocks:
        sizes[b.node] += len(b.text)
        texts[b.node] = xxhash.xxh3_64_intdigest(b.text.encode(), seed=texts[b.node])
    for i in range(len(nodes) - 1, 0, -1):
        up = nodes[i].parent
        sizes[up] += sizes[i]
        texts[up] = xxhash.xxh3_64_intdigest(texts[i].to_bytes(8, "little"), seed=texts[up])
    found: dict[int, list] = {}
    for n, score, size, text in zip(nodes, own, sizes, texts, strict=True):
        one = found.setdefault(n.path, [0.0, 0, 0])
        one[0] += score
        one[1] += size
        one[2] = xxhash.xxh3_64_intdigest(text.to_bytes(8, "little"), seed=one[2])
    return [(p, round(1e6 * s / total), t >> 1 if size >= SUBSTANTIAL * sizes[0] else None) for p, (s, size, t) in found.items() if s > 0 or size >= SUBSTANTIAL * sizes[0]]


def widened(start: int, nodes: list[Node], blocks: list[list[Block]], ends: list[int], out: list[bool], good: set[int]) -> int:
    """The article or main element around a container, else the widest parent whose other text belongs to it. blocks: those of each container."""
    around = [start]
    while nodes[around[-1]].parent > 0:
        around.append(nodes[around[-1]].parent)
    for wanted in ("article", "main"):
        for i in around:
            if nodes[i].tag == wanted and is_article(nodes[i]):
                return i
    inside = start
    for i in around[1:]:
        if nodes[i].tag in ("html", "body"):
            break
        beside = [b for j in (*range(i, inside), *range(ends[inside], ends[i])) if not out[j] for b in blocks[j]]
        if not all(2 * b.linked < len(b.text) and (b.node == i or nodes[b.node].path in good) for b in beside):
            break
        inside = i
    return inside


def main_text(html: str, path: int | None, good: set[int], repeated: set[int]) -> str:
    """The text of the page's article, given the winning path of its host and the host's paths with own and with repeated texts."""
    nodes, blocks = read_page(html)
    if not blocks:
        return ""
    marked, ends = marks(nodes), subtree_ends(nodes)
    same = [n.path in repeated and n.path != path for n in nodes]
    suspect = [m or r for m, r in zip(marked, same, strict=True)]
    gone = [m or r for m, r in zip(no_passages(nodes, blocks, marked, ends), same, strict=True)]

    def left(tops: set[int], gone: list[bool]) -> list[bool]:
        """Which containers are cut off from the nearest of the tops around them, or from the page."""
        out = [False] * len(nodes)
        for i, n in enumerate(nodes[1:], 1):
            out[i] = i not in tops and (gone[i] or out[n.parent])
        return out

    by_node: list[list[Block]] = [[] for _ in nodes]
    for b in blocks:
        by_node[b.node].append(b)
    filled = [len(x) for x in by_node]
    for i in range(len(nodes) - 1, 0, -1):
        filled[nodes[i].parent] += filled[i]
    start = {i for i, n in enumerate(nodes) if n.path == path and filled[i]}
    if not start:
        own = scores(nodes, blocks, marked)
        best = max(range(len(own)), key=lambda i: (own[i], -i))
        if own[best] <= 0:
            return ""
        out = left({best}, suspect)
        start = {i for i, n in enumerate(nodes) if n.path == nodes[best].path and filled[i] and not out[i]}
    out, tops, done = left(start, suspect), set(), 0
    for i in sorted(start):
        if i >= done:
            top = widened(i, nodes, by_node, ends, out, good)
            tops.add(top)
            done = ends[top]
    out, inside = left(tops, gone), [False] * len(nodes)
    for i, n in enumerate(nodes):
        inside[i] = i in tops or (i > 0 and inside[n.parent])
    picked = [inside[b.node] and not out[b.node] for b in blocks]
    whole = left(set(), suspect)
    titles = [i for i, b in enumerate(blocks) if b.tag == "h1" and (picked[i] or not whole[b.node])]
    first = next((i for i, p in enumerate(picked) if p), 0)
    if len(titles) == 1 and titles[0] < first:
        picked[titles[0]] = True
    return "\n".join(b.text for b, p in zip(blocks, picked, strict=True) if p)


def host_paths(pages: DataFrame) -> DataFrame:
    """host, path (the winner), good and repeated (path sets, at most some hundred) of each host. pages: host, html.

    A path is good when it is substantial on half as many pages as the winner, and its texts differ as a rule; it is
    repeated when five pages or more share each of its texts while the winner's texts differ. Both need four pages, and
    a twentieth of the host's, which bounds the sets: a page has at most some 33 substantial containers side by side.
    """

    def run(batches):
        for batch in batches:
            found: dict[tuple, list[int]] = {}
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                for path, share, text in votes(html):
                    one = found.setdefault((host, path, text), [0, 0])
                    one[0] += share
                    one[1] += 1
            keys = list(found)
            columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([k[2] for k in keys], pa.int64())]
            columns += [pa.array([found[k][i] for k in keys], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "path", "text", "votes", "pages"])

    cast = pages.select("host", "html").mapInArrow(run, "host string, path long, text long, votes long, pages long")
    by_text = cast.groupBy("host", "path", "text").agg(F.sum("votes").alias("votes"), F.sum("pages").alias("pages"))
    filled = F.col("text").isNotNull()
    paths = checkpoint(by_text.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.coalesce(F.sum(F.when(filled, F.col("pages"))), F.lit(0)).alias("pages"), F.count_if(filled).alias("texts")))
    winner = F.min_by(F.struct("path", "pages", "texts"), F.struct(-F.col("votes"), F.col("path")))
    hosts = paths.groupBy("host").agg(winner.alias("w"), F.max("pages").alias("all_pages"))
    often = F.expr("pages >= 4 and 20 * pages >= all_pages")
    sets = paths.join(hosts, "host").filter(often & (F.col("path") != F.col("w.path"))).select(
        "host", "path", F.expr("2 * pages >= w.pages and 2 * texts >= pages").alias("is_good"), F.expr("5 * texts <= pages and 2 * w.texts >= w.pages and w.pages >= 4").alias("is_repeated")
    )
    sets = sets.filter("is_good or is_repeated").groupBy("host").agg(F.collect_set(F.when(F.col("is_good"), F.col("path"))).alias("good"), F.collect_set(F.when(F.col("is_repeated"), F.col("path"))).alias("repeated"))
    return hosts.join(sets, "host", "left").select("host", "w.path", "good", "repeated")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_hosts: int = 10_000) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), host.alias("host"))
    winners = checkpoint(host_paths(rows))
    # beyond the checked size, a plain join: AQE splits a host with many pages
    side = F.broadcast(winners) if winners.count() <= broadcast_hosts else winners

    def run(batches):
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("html", "path", "good", "repeated"))
            texts = [main_text(h, p, set(g or ()), set(r or ())) for h, p, g, r in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return rows.join(side, "host", "left").select("page_id", "url", "html", "path", "good", "repeated").mapInArrow(run, "page_id long, url string, text string, n_chars long")
