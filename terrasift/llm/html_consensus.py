"""Operator 5: main-text extraction along container paths that the pages of a host agree on."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, plus, table

#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
#: Elements that are no part of an article wherever they stand.
DROPPED = frozenset("script style noscript template iframe object embed svg head title nav footer aside button select option textarea input fieldset dialog menu audio video noembed noframes xmp".split())
#: Dropped outside the chosen container only.
OUTER = frozenset({"header"})
#: Words of a class, id or role that mark what is no part of an article: what readers write, which nothing else tells from an article, and ...
READERS = frozenset("comment comments commentlist respond reply replies disqus".split())
#: ... the rest, which does not count for an element that holds most of a page's text.
MARKS = READERS | frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription signup"
    " nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside rail widget widgets related recommended share sharing social footer foot masthead topbar toolbar"
    " login search pagination pager skip".split()
)
MOST = 0.5
#: Elements that hosts vote on whether they say the same on many pages, and those that are dropped if they are little but links.
PARTS = frozenset("div section header ul ol dl table p td center main".split())
LISTS = frozenset("div section header ul ol dl table td center".split())
LEAST_LINKS, LINK_SHARE = 3, 0.8
#: What stands on so many of a host's pages, with at most this share of different texts, is none of its articles, unless it is this share of them.
LEAST_PAGES, DIFFERENT = 4, 0.5
#: Steps of a path that count; what is nested deeper has the path of what holds it.
DEEP = 64
#: Elements that begin and end a block of text.
BLOCKS = frozenset("address article aside blockquote body br center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that can hold an article.
CONTAINERS = frozenset("article main section div td body center".split())
#: An open element of these ends where one of the values begins.
CLOSES = {"p": BLOCKS - {"br"}, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "option": frozenset({"option"})}
# a quote that nothing closes before white space or the end of the tag opens no value: the tag then ends at its first >
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"(?=[\s/>]|\Z)|'[^']*'(?=[\s/>]|\Z))*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[a-z]+|[0-9]+")
#: Weight of an element name in a container's score.
BONUS = {"article": 1.5, "main": 1.2, "body": 0.5, "section": 1.0, "div": 1.0, "td": 0.8, "center": 0.7}


class Node:
    __slots__ = ("tag", "path", "depth", "spot", "mark", "dropped", "parent", "parts", "text", "links", "anchors", "paragraphs", "said")

    def __init__(self, tag: str, path: str, depth: int, spot: str, mark: int, dropped: bool, parent: Node | None):
        self.tag, self.path, self.depth, self.spot, self.mark, self.dropped, self.parent = tag, path, depth, spot, mark, dropped, parent
        self.parts: list = []  # texts, None for a block's edge, nodes
        self.text = self.links = self.anchors = self.paragraphs = self.said = 0


def _step(tag: str, attributes: str) -> tuple[str, int]:
    """Generalised path step of an element, tag and class words without numbers, and what its marks say: 2 readers, 1 no article, 0 nothing."""
    words: list[str] = []
    mark = 0
    for name, *values in _ATTRIBUTE.findall(attributes):
        found = [w for w in _WORDS.findall("".join(values).lower()) if not w.isdigit()]
        mark = max(mark, 0 if MARKS.isdisjoint(found) else 1 if READERS.isdisjoint(found) else 2)
        if name.lower() == "class":
            words += found
    return ".".join([tag, *sorted(set(words))]), mark


def parse(page: str, repeated: frozenset[str] = frozenset()) -> Node:
    """The page as a tree; elements left open end with their parent, end tags without a start are ignored. Elements on the `repeated` spots are
    dropped, and so are marked ones and lists of links."""
    root = at = Node("", "", 0, "", 0, False, None)
    end, open_ = 0, {}

    def close(node: Node) -> Node:
        open_[node.tag] -= 1
        return node.parent

    while m := _TOKEN.search(page, end):
        if m.start() > end:
            at.parts.append(page[end : m.start()])
        end = m.end()
        if not (tag := (m[2] or m[5] or "").lower()):
            continue
        if m[1] or m[4]:
            if open_.get(tag):
                while at.tag != tag:
                    at = close(at)
                at = close(at)
                if tag in BLOCKS:
                    at.parts.append(None)
            continue
        while at.parent and tag in CLOSES.get(at.tag, ()):
            at = close(at)
            at.parts.append(None)
        if tag == "br" or tag == "hr":
            at.parts.append(None)
        if tag in VOID:
            continue
        attributes = m[3] or m[6]
        step, mark = _step(tag, attributes) if attributes else (tag, 0)
        # inline marks such as <b> are no step, so that they don't split votes
        steps = (tag in CONTAINERS or tag in ("html", "table", "tr")) and at.depth < DEEP
        path = f"{at.path}/{step}" if steps else at.path
        spot = path if steps else f"{path}|{step}" if tag in PARTS else ""
        node = Node(tag, path, at.depth + steps, spot, 0 if tag in ("html", "body", "article", "main") else mark, tag in DROPPED or spot in repeated, at)
        if tag in RAW:
            closing = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, end)
            end = closing.end() if closing else len(page)
            continue
        if tag in BLOCKS:
            at.parts.append(None)
        at.parts.append(node)
        if not m[0].rstrip(">").endswith("/") or tag in BLOCKS:
            at = node
            open_[tag] = open_.get(tag, 0) + 1
    if end < len(page):
        at.parts.append(page[end:])
    _measure(root, True)
    _judge(root)
    _measure(root, False)
    return root


def _measure(node: Node, every: bool) -> None:
    """Characters of text, of them in links, links and paragraphs below each node, and, but with `every`, a hash of what it says, from its own words and
    the hashes of its elements; not what is dropped, nor headers outside an article unless `every`."""
    import xxhash

    stack: list[tuple[Node, bool]] = [(node, False)]
    while stack:
        n, done = stack.pop()
        if done:
            n.text = n.links = n.anchors = n.paragraphs = 0
            said = xxhash.xxh64()
            for x in n.parts:
                if not every and (isinstance(x, str) or isinstance(x, Node) and not x.dropped and x.text):
                    said.update(" ".join(x.split()).encode("utf-8", "surrogatepass") if isinstance(x, str) else x.said.to_bytes(8, "little"))
                if isinstance(x, str):
                    n.text += len(x.strip())
                elif x is not None and not x.dropped and (every or x.tag not in OUTER):
                    n.text += x.text
                    n.links += x.text if x.tag == "a" else x.links
                    n.anchors += x.anchors + (x.tag == "a")
                    n.paragraphs += x.paragraphs + (x.tag == "p" and x.text > 0)
            n.said = said.intdigest()
        else:
            stack.append((n, True))
            stack += [(x, False) for x in n.parts if isinstance(x, Node) and not x.dropped]


def _judge(root: Node) -> None:
    """Drop what readers write, other marked elements that don't hold most of the text, forms but for one with paragraphs around most of it, lists of links, and headers of the site: those in no article
    that have a menu or a mark, or stand at the top of the body."""
    stack = [(root, False)]
    while stack:
        n, inside = stack.pop()
        for x in n.parts:
            if isinstance(x, Node) and not x.dropped:
                links = x.tag in LISTS and x.anchors >= LEAST_LINKS and x.links >= LINK_SHARE * x.text
                site = x.tag in OUTER and not inside and (n.tag in ("", "html", "body") or x.mark or x.anchors >= LEAST_LINKS)
                most = x.text > MOST * root.text
                form = x.tag == "form" and not (most and x.paragraphs)
                x.dropped = x.mark == 2 or (x.mark == 1 and not most) or form or links or site
                if not x.dropped:
                    stack.append((x, inside or x.tag in ("article", "main")))


def _containers(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        n = stack.pop()
        if n.tag in CONTAINERS:
            yield n
        stack += [x for x in reversed(n.parts) if isinstance(x, Node) and not x.dropped]


def _score(n: Node, whole: int) -> float:
    """Text outside links, as a share of the page's, with a malus for the text that a smaller container would do without."""
    own = sum(len(x.strip()) for x in n.parts if isinstance(x, str)) + sum(x.text for x in n.parts if isinstance(x, Node) and not x.dropped and x.tag not in CONTAINERS and x.tag not in OUTER)
    return BONUS[n.tag] * (0.6 * own + 0.4 * (n.text - n.links)) / max(1, whole)


def votes(page: str, root: Node | None = None) -> dict[str, float]:
    """Score of each container path of a page: its best container there."""
    root = root or parse(page)
    best: dict[str, float] = {}
    for n in _containers(root):
        if n.text:
            best[n.path] = max(best.get(n.path, 0.0), _score(n, root.text))
    return best


def parts(root: Node) -> Iterator[tuple[str, int, float]]:
    """(spot, hash of what it says, share of the page's text) of the elements that hosts vote on; plain paragraphs and containers say too little."""
    stack = [root]
    while stack:
        n = stack.pop()
        if n.spot and n.text and ("." in n.spot.rpartition("/")[2] or n.tag in LISTS - {"div", "section", "td", "center"}):
            yield n.spot, n.said >> 1, n.text / max(1, root.text)
        stack += [x for x in n.parts if isinstance(x, Node) and not x.dropped]


def _read(node: Node) -> list[str]:
    """The blocks below a node in page order."""
    blocks: list[str] = []
    held: list[str] = []

    def close() -> None:
        if text := " ".join(html.unescape("".join(held)).split()):
            blocks.append(text)
        held.clear()

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            held.append(x)
        elif not x.dropped:
            stack += reversed(x.parts)
    close()
    return blocks


def extract(page: str | None, path: str | None, repeated: frozenset[str] = frozenset()) -> str:
    """Main text: of all outermost containers on the given path, else of the page's own best container; "" if none. What stands on the `repeated`
    spots is left out."""
    if not page:
        return ""
    root = parse(page, repeated)
    on_path = []
    if path:
        stack = [root]
        while stack:
            n = stack.pop()
            if n.path == path and n.tag in CONTAINERS:
                on_path.append(n)
            else:
                stack += [x for x in reversed(n.parts) if isinstance(x, Node) and not x.dropped]
    if not on_path:
        found = [n for n in _containers(root) if n.text]
        on_path = [max(found, key=lambda n: _score(n, root.text))] if found else []
        if not on_path and root.text:
            on_path = [root]
    return " ".join(b for n in on_path for b in _read(n))


def _ballots(pages: DataFrame) -> DataFrame:
    """(host, page) -> host, path, said, score, pages: of container paths the score with said null, of parts the hash of what they say, the share of the
    text and the pages. Sums are taken per batch first, so a host with very many pages is no single task's."""

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums: dict[tuple, list] = {}
            for host, page in zip(batch.host, batch.page, strict=True):
                if page:
                    root = parse(page)
                    cast = [((host, path, None), score) for path, score in votes(page, root).items()] + [((host, spot, said), share) for spot, said, share in parts(root)]
                    for key, score in cast:
                        held = sums.setdefault(key, [0, 0])
                        held[0] += round(score * 1e6)
                        held[1] += 1
            frame = pd.DataFrame([(*key, *held) for key, held in sums.items()], columns=["host", "path", "said", "score", "pages"])
            yield frame.astype({"said": "Int64"})

    return pages.mapInPandas(vote, "host string, path string, said long, score long, pages long").groupBy("host", "path", "said").agg(F.sum("score").alias("score"), F.sum("pages").alias("pages"))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, page) -> host, path, repeated: the container path with the most votes, the sum of its scores over the host's pages (ties go to the first
    path), and the spots of parts that say the same on many pages."""
    ballots = materialize(_ballots(pages), "ballots")
    best = ballots.where("said is null").groupBy("host").agg(F.min_by("path", F.struct(-F.col("score"), F.col("path"))).alias("path"))
    spots = ballots.where("said is not null").groupBy("host", "path").agg(F.sum("pages").alias("n"), F.count(F.lit(1)).alias("texts"), F.sum("score").alias("share"))
    same = (F.col("n") >= LEAST_PAGES) & (F.col("texts") <= F.col("n") * DIFFERENT) & (F.col("share") <= F.col("n") * int(DIFFERENT * 1e6))
    repeated = spots.where(same).groupBy(F.col("host").alias("_host")).agg(F.sort_array(F.collect_list("path")).alias("repeated"))
    return best.join(repeated, F.col("host") == F.col("_host"), "left").select("host", "path", F.coalesce("repeated", F.array().cast("array<string>")).alias("repeated"))


def extract_main_text(pages: DataFrame, page: str = "html", url: str = "url") -> DataFrame:
    """All columns of pages plus text and n_chars.

    Pages vote for the generalised path (tags with class words, numbers left out) of their best containers, and on what parts say the same on many of
    a host's pages; each host's winner is read on all its pages without those parts, and a page without it falls back on its own best container. Null or empty html gives "" and 0;
    a null or odd url votes in the group of no host. Broken markup is read to its end. Winners are one row per host, written to
    the shared folder, so that Spark broadcasts them below its own size limit and joins by shuffle beyond."""
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    winners = materialize(host_paths(pages.select(host.alias("host"), F.col(page).alias("page"))), "host_paths")
    winners = winners.select(F.col("host").alias("__winner"), F.col("path").alias("__path"), F.col("repeated").alias("__repeated"))

    @F.pandas_udf("string")
    def text(html_: pd.Series, path: pd.Series, repeated: pd.Series) -> pd.Series:
        sets: dict[tuple, frozenset[str]] = {}
        texts = [extract(h, p, sets.setdefault(key := tuple(r if r is not None else ()), frozenset(key))) for h, p, r in zip(html_, path, repeated, strict=True)]
        return pd.Series(texts, dtype=object)

    out = plus(plus(pages, __host=host).join(winners, F.col("__host") == F.col("__winner"), "left"), text=text(F.col(page), F.col("__path"), F.col("__repeated")))
    return plus(out.drop("__host", "__winner", "__path", "__repeated"), n_chars=F.length("text").cast("long"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
