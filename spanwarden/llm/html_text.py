"""Main text of web pages by consensus paths of their hosts.

Every page's containers are scored by the running text below them: blocks that are mostly links, and
elements whose tag, role or class marks them as no article text, don't count. From the body down the
smallest container that still holds every paragraph and heading, and all other running text of some length,
votes for its path, the tags and classes from the body down with numbers made alike, among the pages of its host. Votes are counted in Spark; each page
is then read again by the path that won on its host, if that holds as much as the page's own container,
and by its own container else. All text of the container that isn't marked is the result: headings,
sections, columns, lists, tables and quotes alike.

The reader goes through a page once; its time and memory grow with the page's length, however deep or
unclosed its tags are.

Defined results: null and empty pages give an empty text, tag-less ones their plain text, pages that are
marked all over the text that is not in scripts, menus and the like; null urls make one host. Pages of any
length are read whole. Unclosed tags end with their parent; an unclosed script or comment, or a last tag
without its end, ends with the page. A null id stays null, repeated rows and ids each give a row, ties of
votes go to the heavier and then the lesser path, and an empty table gives an empty result. Columns other
than page_id, url and html are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, per_batch, small, texts, tune

#: Paths that a host keeps, best first.
WINNERS = 3
#: Share of the own container's running text that a host's path needs, besides all its paragraphs and headings.
ENOUGH = 0.9
#: Characters from which running text outside of paragraphs and headings counts as part of the article.
SOME = 40
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
#: The rest of a tag: > inside a quoted value does not end it.
_REST = re.compile(r"((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_ATTRIBUTE = re.compile(r"([a-zA-Z][a-zA-Z-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
#: Elements whose content is skipped up to their end tag.
SKIPPED = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in "script style noscript template textarea iframe svg math title".split()}
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that the next of their kind ends.
ENDED_BY_NEXT = frozenset("li dt dd tr td th option p".split())
#: Elements that never hold the article's text.
DROPPED = frozenset("head nav footer aside form button select option dialog menu object audio video canvas map".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Words that mark such elements as a class or id of their own or with words of HELPERS only ...
MARKS = frozenset("ad ads adv banner disclaimer footer header login menu modal nav navigation notice notices popup promo promoted promotion related replies reply respond responses share sharing signup skip social subscribe toolbar widget widgets recommended trending".split())
HELPERS = frozenset("site page global main top bottom left right primary secondary bar box wrap wrapper container list links link section area block inner outer unit slot buttons icons icon items item posts articles content user users reader readers thread threads feed body text inline fixed sticky mobile desktop".split())
#: ... and those that mark them beside any other word, but for the words of DENIALS.
STRONG = frozenset("advert adverts advertisement advertising breadcrumb breadcrumbs comment comments cookie cookies consent disqus masthead navbar newsletter pagination sidebar sponsor sponsored".split())
DENIALS = frozenset("no not has have with without is hide".split())
#: Containers that a page's text may be cut down to.
CONTAINERS = frozenset("body main article div section td center".split())


class Node:
    __slots__ = ("tag", "step", "parent", "drop", "good", "must")

    def __init__(self, tag: str, step: str, parent: Node | None, drop: bool):
        self.tag, self.step, self.parent, self.drop = tag, step, parent, drop
        self.good = self.must = 0  # characters of running text, and its blocks that an article can't lose, in and below

    def path(self) -> str:
        steps, n = [], self
        while n is not None:
            steps.append(n.step)
            n = n.parent
        return ">".join(reversed(steps))


def known_words(word: str) -> tuple[str, ...]:
    """A word as the two that it is written of together, if it is: commentlist, sitefooter."""
    if word in STRONG or word in MARKS or word in HELPERS:
        return (word,)
    for i in range(4, len(word) - 3):
        a, b = word[:i], word[i:]
        if a in STRONG and b in HELPERS or a in HELPERS and b in STRONG or a in MARKS and b in HELPERS or a in HELPERS and b in MARKS:
            return (a, b)
    return (word,)


def marked(token: str) -> bool:
    """Does a class or id say that its element is no article text?"""
    words = [part for w in _WORD.findall(token) for part in known_words(w.lower())]
    if not words or not DENIALS.isdisjoint(words):
        return False
    if not STRONG.isdisjoint(words):
        return True
    return not MARKS.isdisjoint(words) and all(w in MARKS or w in HELPERS or w.isdigit() for w in words)


def attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), "".join(values))
    return found


def _dropped(tag: str, found: dict[str, str], article: bool, marks: bool) -> bool:
    """Is an element's text no article text? article: it lies in an article or main element."""
    if tag in DROPPED:
        return True
    if tag == "header":  # an article's own head holds its title
        return not article
    if tag in ("body", "html", "article", "main") or not found:
        return False
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
        return True
    if not marks:
        return False
    if not ROLES.isdisjoint(found.get("role", "").lower().split()):
        return True
    tokens = (found.get("class", "") + " " + found.get("id", "")).split()
    return any(marked(t) for t in tokens if not (article and t.lower() == "header"))


def _step(tag: str, names: str | None) -> str:
    return ".".join([tag, *sorted({re.sub(r"\d+", "0", n) for n in names.replace(">", "").split()})]) if names else tag


Block = tuple[str, Node, int]  # text, innermost container, weight


def walk(page: str, marks: bool = True) -> tuple[list[Node], list[Block]]:
    """All containers of a page, parents first, and its blocks of kept text."""
    root = Node("body", "body", None, False)
    stack, nodes = [root], [root]
    blocks: list[Block] = []
    run: list[str] = []
    opened: Counter = Counter()
    dropped = in_link = in_article = linked = plain = 0
    heading = ""
    at, size = 0, len(page)

    def close_block() -> None:
        nonlocal linked, plain
        if run:
            words = "".join(run).split()
            if words:
                good = plain if plain >= linked else 0
                text = " ".join(words)
                blocks.append((text, stack[-1], good))
                stack[-1].good += good
                stack[-1].must += bool(good) and (heading != "" or len(text) >= SOME)
            run.clear()
        linked = plain = 0

    def pop() -> None:
        nonlocal dropped, in_article
        gone = stack.pop()
        opened[gone.tag] -= 1
        dropped -= gone.drop
        in_article -= gone.tag in ("article", "main")

    while at < size:
        begin = page.find("<", at)
        end = begin if begin >= 0 else size
        if end > at and not dropped:
            piece = page[at:end]
            run.append(html.unescape(piece) if "&" in piece else piece)
            if in_link:
                linked += end - at
            else:
                plain += end - at
        if begin < 0:
            break
        at = begin + 1
        if page.startswith("!--", at):
            stop = page.find("-->", at + 1)
            at = stop + 3 if stop >= 0 else size
            continue
        closing = page.startswith("/", at)
        name = _NAME.match(page, at + closing)
        if name is None:
            if closing or page.startswith(("!", "?"), at):
                stop = page.find(">", at)
                at = stop + 1 if stop >= 0 else size
            elif not dropped:
                run.append("<")
                plain += 1
            continue
        rest = _REST.match(page, name.end())
        if rest is None:
            break
        at, tag, source = rest.end(), name[0].lower(), rest[1]
        if closing:
            if tag == "a":
                in_link = max(0, in_link - 1)
            if tag in INLINE and not opened[tag]:
                continue
            if not dropped:
                close_block()
            heading = "" if tag in HEADINGS or tag == "p" else heading
            if opened[tag]:
                while stack[-1].tag != tag:
                    pop()
                pop()
            continue
        if tag in SKIPPED:
            if not (tag in ("svg", "math") and source.endswith("/")):
                stop = SKIPPED[tag].search(page, at)
                if stop is None:
                    break
                at = page.find(">", stop.end()) + 1 or size
            continue
        found = attributes(source) if source and not source.isspace() else {}
        drop = not dropped and _dropped(tag, found, in_article > 0, marks)
        if tag in INLINE and not drop:
            in_link += tag == "a"
            continue
        if not dropped:
            close_block()
        if tag in VOID or tag in ("html", "body"):
            continue
        if tag in ENDED_BY_NEXT and stack[-1].tag == tag:
            pop()
        if tag in HEADINGS or tag == "p":
            heading = tag
            if not drop:
                continue
        if source.endswith("/") and tag not in CONTAINERS:
            continue
        heading = ""
        node = Node(tag, _step(tag, found.get("class")), stack[-1], drop)
        dropped += drop
        in_article += tag in ("article", "main")
        opened[tag] += 1
        stack.append(node)
        nodes.append(node)
    close_block()
    for n in reversed(nodes[1:]):
        n.parent.good += n.good
        n.parent.must += n.must
    return nodes, blocks


def own_container(nodes: list[Node]) -> Node:
    """The smallest container that holds all paragraphs, headings and longer texts of the one around it, from the body down.

    What stays outside are links and short texts between containers. It goes no further down than an article element.
    """
    inside: dict[int, Node] = {}  # a container's child, or nearest container below, with most running text
    for n in nodes[1:]:
        up = n.parent
        if n.tag in CONTAINERS:
            while up.parent is not None and up.tag not in CONTAINERS and up.tag in ("table", "tbody", "tr"):
                up = up.parent
            if id(up) not in inside or n.good > inside[id(up)].good:
                inside[id(up)] = n
    now = nodes[0]
    while now.tag != "article" and (n := inside.get(id(now))) is not None and n.good and n.must == now.must and (now.must or n.good >= ENOUGH * now.good):
        now = n
    return now


def read(page: str) -> tuple[list[Node], list[Block]]:
    """walk(), without marks where they leave no text."""
    nodes, blocks = walk(page)
    return (nodes, blocks) if blocks else walk(page, marks=False)


def below(nodes: list[Node], top: set[int]) -> set[int]:
    """Of all nodes those in or under the given ones, by identity."""
    found = set(top)
    for n in nodes:
        if n.parent is not None and id(n.parent) in found:
            found.add(id(n))
    return found


def extract(page: str | None, paths: list[str] | None) -> str:
    """The text of the first path that holds as much as the page's own container does, else of that container."""
    if not page:
        return ""
    nodes, blocks = read(page)
    own = own_container(nodes)
    chosen = {id(own)}
    for path in paths or ():
        steps, level = path.split(">"), {}
        hits = []
        for n in nodes:  # level: how far the path has led to a node
            k = 0 if n.parent is None else level.get(id(n.parent), len(steps))
            if k < len(steps) and n.step == steps[k]:
                level[id(n)] = k + 1
                if k + 1 == len(steps):
                    hits.append(n)
        if hits and sum(n.good for n in hits) >= max(1, ENOUGH * own.good) and sum(n.must for n in hits) >= own.must:
            chosen = {id(n) for n in hits}
            break
    inside = below(nodes, chosen)
    if chosen == {id(nodes[0])}:  # a page without a container of its own: what holds nothing but links beside the text is a menu
        inside -= below(nodes, {id(n) for n in nodes[1:] if n.parent is nodes[0] and n.tag != "article" and not n.good and nodes[0].good})
    return " ".join(body for body, node, _ in blocks if id(node) in inside)


def host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def host_paths(pages: DataFrame) -> DataFrame:
    """host, paths: each host's winning paths, most votes first. A page that is best read from its body has no vote."""

    def vote(batch: pa.RecordBatch):
        hosts, found = [], []
        for name, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if page and (own := own_container(read(page)[0])).parent is not None:
                hosts.append(name)
                found.append(own)
        return {"host": hosts, "path": [n.path() for n in found], "weight": [float(n.good) for n in found]}

    votes = per_batch(pages.select(host(F.col("url")).alias("host"), "html"), "host string, path string, weight double", vote)
    votes = votes.groupBy("host", "path").agg(F.count("*").alias("votes"), F.bround(F.sum("weight"), 3).alias("weight"))
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), F.desc("weight"), "path"))
    votes = votes.withColumn("rank", rank).where(F.col("rank") <= WINNERS)
    return votes.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("paths"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html)."""
    tune(pages.sparkSession)
    pages = texts(pages, "page_id", "url", "html").withColumn("page_id", F.col("page_id").cast("long"))
    winners = host_paths(pages)

    def again(batch: pa.RecordBatch):
        found = [extract(p, w) for p, w in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        return {"page_id": batch.column(0), "url": batch.column(1), "text": found, "n_chars": [len(t) for t in found]}

    winners = Scratch(pages.sparkSession, "host-paths").keep(winners.withColumnRenamed("host", "__host"), "winners")
    width = F.octet_length("__host") + F.octet_length(F.array_join("paths", ">"))
    placed = pages.join(small(winners, 100_000, width), host(F.col("url")) == F.col("__host"), "left").select("page_id", "url", "html", "paths")
    return per_batch(placed, "page_id long, url string, text string, n_chars long", again)
