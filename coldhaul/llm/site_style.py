"""Main text of web pages with a site style tree.

The pages of a host are merged into one tree of element paths (tags with classes and
ids). For every path the pages that have it are counted, and for every text below it
the pages in which it stands there. A text that comes back on all pages has the full
entropy and carries no information; a text of a single page has none. The importance
of a branch is one less the mean relative entropy of its texts and of the order of its
children, and branches of low importance are removed from each page, inside an article
as well. Copies of a page count once. What an element calls itself (a footer, a side bar)
decides unless the tree knows better: an element that bears most of the information of
its host stays whatever its name, as does one that holds the only article of its page.

Each page is parsed once, into its blocks and the elements around them, which are stored;
counting and cutting read those. Elements nested deeper than ``DEPTH`` share the tree
node of the one above them at that depth, so that the work on a page is bounded by its
length times DEPTH.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldhaul.llm.common import numbered, stored

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|</?[A-Za-z](?:[^<>\"']|\"[^\"]*\"|'[^']*')*>|[^<]+|<", re.S
)
TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)(.*?)(/?)>\Z", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/<>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.S)

# What HTML says about its elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option optgroup p pre section"
    " select summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCKS - {"br", "html", "head", "body", "title", "option", "optgroup"}
CLOSED_BY_SAME = {"li": "ul ol menu", "option": "select", "tr": "table", "td": "tr", "th": "tr", "dt": "dl", "dd": "dl"}

UNSEEN_TAGS = frozenset(
    "script style noscript template iframe svg button select textarea input object head title noembed noframes canvas"
    " audio video map datalist".split()
)
NOISE_TAGS = frozenset("nav footer aside form menu dialog".split()) | UNSEEN_TAGS
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidebars menu nav"
    " navbar navigation breadcrumb breadcrumbs footer cookie cookies notice notices consent gdpr comment comments disqus"
    " reply replies share sharing social related recommended widget popup modal newsletter subscribe signup login pagination"
    " pager toolbar skip hidden masthead topbar".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAME = re.compile(r"[a-z]+")
ROOTS = ("html", "body")


#: Levels of the style tree.
DEPTH = 64


@dataclass
class Node:
    """An element; ``path`` is the hash of its place in the style tree, ``up`` the number of the element around it.

    ``unseen`` is never text, ``noise`` is what the element says of itself by tag or
    role, ``named`` by its class or id. ``inside``: it stands in a content element;
    ``top``: in nothing but the page.
    """

    tag: str
    style: str
    path: int
    up: int
    level: int
    top: bool = False
    inside: bool = False
    unseen: bool = False
    noise: bool = False
    named: bool = False
    content: bool = False
    children: list[str] = field(default_factory=list)


@dataclass
class Block:
    """A run of text that no block element divides, and the number of the element it stands in, or -1."""

    text: str
    at: int


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), references.unescape(value.strip("\"'")))
    return found


def _names(value: str) -> set[str]:
    return set(NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))


def _element(tag: str, source: str, around: Node | None, up: int) -> Node:
    given = _attributes(source) if source.strip() else {}
    names = _names(given.get("class", "")) | _names(given.get("id", ""))
    style = re.sub(r"\d+", "", ".".join([tag, *sorted(given.get("class", "").split()), given.get("id", "")]))
    level = around.level + 1 if around else 0
    path = around.path if level >= DEPTH else xxhash.xxh3_64_intdigest(f"{around.path if around else 0}/{style}") - (1 << 63)
    inside = around is not None and (around.inside or around.content)
    node = Node(tag, style, path, up, level, around is None or (around.top and around.tag in ROOTS), inside)
    role = given.get("role", "").lower()
    node.unseen = (
        tag in UNSEEN_TAGS
        or "hidden" in given
        or given.get("aria-hidden", "").lower() == "true"
        or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", given.get("style", "").lower()) is not None
    )
    node.noise = tag in NOISE_TAGS or role in NOISE_ROLES or (tag == "header" and not inside)
    node.named = (
        (tag not in ("html", "body", "main", "article") and bool(names & NOISE_NAMES))
        or (tag == "article" and bool(names & {"comment", "comments", "reply", "related", "ad", "promo"}))
        or ("header" in names and not inside and tag not in ("main", "article", "html", "body"))
    )
    hinted = node.unseen or node.noise or node.named
    node.content = not hinted and (tag in ("article", "main") or role in ("main", "article"))
    return node


def parse(source: str) -> tuple[list[Block], list[Node]]:
    """All blocks of text in page order with the elements around them, and all elements."""
    blocks: list[Block] = []
    nodes: list[Node] = []
    stack: list[Node] = []
    numbers: list[int] = []
    open_tags: Counter[str] = Counter()
    pending: list[str] = []
    pending_in = -1

    def flush() -> None:
        text = " ".join(references.unescape("".join(pending)).split())
        if text:
            blocks.append(Block(text, pending_in))
        pending.clear()

    def cut(i: int) -> None:
        open_tags.subtract(n.tag for n in stack[i:])
        del stack[i:], numbers[i:]

    def put(node: Node) -> None:
        stack.append(node)
        numbers.append(len(nodes) - 1)
        open_tags[node.tag] += 1

    def close(tag: str) -> None:
        if open_tags[tag] > 0:
            cut(next(i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag))

    def add(text: str) -> None:
        nonlocal pending_in
        if not pending:
            pending_in = numbers[-1] if numbers else -1
        pending.append(text)

    at = 0
    while at < len(source):
        found = TOKEN.match(source, at)
        token, at = found[0], found.end()
        if token[0] != "<" or token == "<":
            add(token)
            continue
        if token.startswith("<!") or token.startswith("<?"):
            continue
        end, tag, rest, _ = TAG.match(token).groups()
        tag = tag.lower()
        if tag in BLOCKS or tag in NOISE_TAGS:
            flush()
        if end:
            close(tag)
            continue
        if tag in CLOSES_P and open_tags["p"] > 0:
            # An open paragraph ends here; inline elements in it that were left open end too.
            inner = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag in BLOCKS), None)
            if inner is not None and stack[inner].tag == "p":
                cut(inner)
        if tag in CLOSED_BY_SAME:
            bounds = CLOSED_BY_SAME[tag].split()
            same = ("td", "th") if tag in ("td", "th") else ("dt", "dd") if tag in ("dt", "dd") else (tag,)
            if any(open_tags[t] > 0 for t in same):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag in same:
                        cut(i)
                        break
                    if stack[i].tag in bounds:
                        break
        around = stack[-1] if stack else None
        node = _element(tag, rest, around, numbers[-1] if numbers else -1)
        if around is not None:
            around.children.append(node.style)
        nodes.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            over = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            if tag in ("textarea", "title"):
                put(node)
                add(source[at : over.start() if over else len(source)])
                flush()
                cut(len(stack) - 1)
            at = over.end() if over else len(source)
            continue
        put(node)
    flush()
    _free_wrappers(blocks, nodes)
    return blocks, nodes


def _inherited(own: Sequence[bool], ups: Sequence[int]) -> list[bool]:
    """Whether an element or one around it has a mark; elements come after those around them. The last entry is for none."""
    out: list[bool] = []
    for mark, up in zip(own, ups):
        out.append(mark or (up >= 0 and out[up]))
    return [*out, False]


def _outermost(own: Sequence[bool], ups: Sequence[int]) -> list[int]:
    """The number of the outermost element with a mark among an element and those around it, or -1."""
    out: list[int] = []
    for i, (mark, up) in enumerate(zip(own, ups)):
        above = out[up] if up >= 0 else -1
        out.append(above if above >= 0 else i if mark else -1)
    return [*out, -1]


def _free_wrappers(blocks: list[Block], nodes: list[Node]) -> None:
    """A wrapper that holds the article is no noise by name.

    Where every article, or without one every other content element, stands in an element
    with such a name, the wrappers of the one with the most text lose their mark.
    """
    ups = [n.up for n in nodes]
    hidden = _inherited([n.unseen or n.noise for n in nodes], ups)
    named = _inherited([n.named for n in nodes], ups)
    for kind in ("article", None):
        outer = _outermost([n.content and (kind is None or n.tag == kind) for n in nodes], ups)
        sizes: dict[int, int] = {}
        for block in blocks:
            i = outer[block.at]
            if i >= 0 and not hidden[block.at]:
                if not named[nodes[i].up]:
                    return
                sizes[i] = sizes.get(i, 0) + len(block.text)
        if sizes:
            at = nodes[max(sizes, key=sizes.__getitem__)].up
            while at >= 0:
                nodes[at].named = False
                at = nodes[at].up
            return


# What is stored of an element, as bits.
UNSEEN, NOISE, CONTENT, ARTICLE, ROOT, TOP = 1, 2, 4, 8, 16, 32


def _flags(node: Node) -> int:
    return (
        UNSEEN * node.unseen
        | NOISE * (node.noise or node.named)
        | CONTENT * node.content
        | ARTICLE * (node.tag == "article")
        | ROOT * (node.tag in ROOTS)
        | TOP * node.top
    )


def kept_text(
    paths: Sequence[int],
    ups: Sequence[int],
    flags: Sequence[int],
    texts: Sequence[str],
    places: Sequence[int],
    removed: frozenset[int],
    raised: frozenset[int],
) -> str:
    """The text of the article, or without one all text, outside noise and ``removed`` branches.

    Noise that is in ``raised`` stays. An article is not removed as a whole: where no
    text of it would be left, it loses no branch.
    """
    article = any(f & CONTENT and f & ARTICLE for f in flags)
    own = [bool(f & CONTENT and (f & ARTICLE or not article)) for f in flags]
    content = any(own)
    outer = _outermost(own, ups)
    hidden = _inherited([bool(f & UNSEEN or (f & NOISE and p not in raised)) for f, p in zip(flags, paths)], ups)
    inside = [i for i, at in enumerate(places) if not hidden[at] and (not content or outer[at] >= 0)]
    if removed:
        # Only what stands in the content can be a branch of it.
        low = _inherited([p in removed and (not content or outer[up] >= 0) for p, up in zip(paths, ups)], ups)
        left = [i for i in inside if not low[places[i]]]
        if left or not content:
            inside = left
    return " ".join(texts[i] for i in inside)


def main_text(source: str, removed: frozenset[int], raised: frozenset[int] = frozenset()) -> str:
    """:func:`kept_text` of a page."""
    blocks, nodes = parse(source)
    of_nodes = ([n.path for n in nodes], [n.up for n in nodes], [_flags(n) for n in nodes])
    return kept_text(*of_nodes, [b.text for b in blocks], [b.at for b in blocks], removed, raised)


HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PAGE, STYLE, TEXT = 0, 1, 2
_ELEMENTS = "paths array<long>, ups array<int>, flags array<int>, orders array<long>, texts array<string>, places array<int>"


def _parsed(pages: DataFrame) -> DataFrame:
    """The pages as blocks and elements; ``row`` tells pages apart, ``page`` is the hash of one, ``site`` that of its host.

    ``orders`` has the hash of the styles of an element's children, null without any.
    """
    types = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                columns: list[list] = [[] for _ in range(8)]
                for host, source in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
                    blocks, nodes = parse(source or "")
                    page = xxhash.xxh3_64_intdigest(source or "") - (1 << 63)
                    orders = [xxhash.xxh3_64_intdigest(" ".join(n.children)) - (1 << 63) if n.children else None for n in nodes]
                    values = (
                        xxhash.xxh3_64_intdigest(host) >> 1, page, [n.path for n in nodes], [n.up for n in nodes],
                        [_flags(n) for n in nodes], orders, [b.text for b in blocks], [b.at for b in blocks],
                    )
                    for column, value in zip(columns, values):
                        column.append(value)
                longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
                kinds = (pa.int64(), pa.int64(), longs, ints, ints, longs, pa.list_(pa.string()), ints)
                names = ["site", "page", "paths", "ups", "flags", "orders", "texts", "places"]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), *(pa.array(c, t) for c, t in zip(columns, kinds))],
                    ["page_id", "url", *names],
                )

    schema = f"page_id {types['page_id']}, url {types['url']}, site long, page long, {_ELEMENTS}"
    return numbered(pages.mapInArrow(read, schema), "parsed-pages")


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(site, path, kind, feature): the pages of a path, the texts below it, the order of its children.

    ``kind`` of a text is TEXT and its length; the feature of a page is the marks of the
    element. Paths are told apart by host.
    """
    for batch in batches:
        rows: list[tuple[int, int, int, int]] = []
        for page in batch.to_pylist():
            site, paths, ups, flags = (page[c] for c in ("site", "paths", "ups", "flags"))
            seen = set()
            for path, mark, order in zip(paths, flags, page["orders"]):
                if mark & (ROOT | UNSEEN):
                    continue
                seen.add((path, PAGE, mark & (NOISE | TOP)))
                if order is not None:
                    seen.add((path, STYLE, order))
            hidden = _inherited([bool(f & UNSEEN) for f in flags], ups)
            # The nearest element around each that has another path.
            around: list[int] = []
            for path, up in zip(paths, ups):
                around.append(around[up] if up >= 0 and paths[up] == path else up)
            for text, at in zip(page["texts"], page["places"]):
                if hidden[at]:
                    continue
                feature = xxhash.xxh3_64_intdigest(text) - (1 << 63)
                while at >= 0:
                    if not flags[at] & ROOT:
                        seen.add((paths[at], TEXT + len(text), feature))
                    at = around[at]
            rows += [(site, path ^ site, kind, feature) for path, kind, feature in seen]
            if len(rows) > 100_000:
                yield _statistic_rows(rows)
                rows = []
        yield _statistic_rows(rows)


def _statistic_rows(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int64())
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["site", "path", "kind", "feature"])


def _first_copies(parsed: DataFrame) -> DataFrame:
    """Parsed pages without the later copies of a page of the same host."""
    several = parsed.groupBy("site", "page").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1")
    # Stored, so that the joins have shuffles of their own and a page with very many copies is split.
    several = stored(several.drop("n"), "repeated-pages")
    later = stored(parsed.select("site", "page", "row").join(several, ["site", "page"]).where("row <> first").select("row"), "later-copies")
    return parsed.join(later, "row", "left_anti")


def judged_branches(parsed: DataFrame, threshold: float, min_pages: int) -> DataFrame:
    """(of_site, removed, raised): per host the paths whose importance is below ``threshold``, and
    those that call themselves noise but bear more than half of the information of the host.

    Only paths on at least ``min_pages`` different pages are judged. Paths are as :func:`_statistics`
    gives them.
    """
    first = _first_copies(parsed).select("site", "paths", "ups", "flags", "orders", "texts", "places")
    rows = first.mapInArrow(_statistics, "site long, path long, kind int, feature long")
    counted = rows.groupBy("site", "path", "kind", "feature").agg(F.count("*").alias("c"))
    kind, c = F.col("kind"), F.col("c")
    size = (kind - TEXT).cast("double")
    paths = counted.groupBy("site", "path").agg(
        F.sum(F.when(kind == PAGE, c)).alias("m"),
        F.max(F.when(kind == PAGE, F.col("feature").bitwiseAND(NOISE))).alias("hinted"),
        F.max(F.when(kind == PAGE, F.col("feature").bitwiseAND(TOP))).alias("top"),
        F.sum(F.when(kind >= TEXT, c * F.log(c))).alias("text_entropy"),
        F.sum(F.when(kind >= TEXT, c)).alias("texts"),
        F.sum(F.when(kind >= TEXT, size * c)).alias("chars"),
        F.sum(F.when(kind >= TEXT, size * c * F.log(c))).alias("char_entropy"),
        F.sum(F.when(kind == STYLE, c * F.log(c))).alias("style_sum"),
        F.sum(F.when(kind == STYLE, c)).alias("styles"),
    )
    # Content: one less the mean entropy of the texts over the pages. Presentation: the
    # entropy of the child orders themselves. Text speaks louder where there is any.
    # A path of a single page has no entropy.
    full = F.log(F.greatest("m", F.lit(2)))
    content = 1 - F.col("text_entropy") / (F.col("texts") * full)
    shown = (F.log("styles") - F.col("style_sum") / F.col("styles")) / full
    importance = F.when(F.col("texts") > 0, 0.9 * content + 0.1 * F.coalesce(shown, F.lit(0.0)))
    informed = F.col("chars") - F.col("char_entropy") / full
    # Stored: both uses below read it.
    paths = stored(
        paths.select("site", "path", "hinted", "top", "m", importance.alias("importance"), informed.alias("informed")), "style-paths"
    )
    whole = paths.where(F.col("top") > 0).groupBy(F.col("site").alias("of_site")).agg(F.sum("informed").alias("whole"))
    judged = paths.where(F.col("m") >= min_pages).join(whole, F.col("site") == F.col("of_site"))
    low = F.col("importance") < threshold
    high = (F.col("hinted") > 0) & (F.col("importance") >= threshold) & (2 * F.col("informed") > F.col("whole"))
    return (
        judged.where(low | high)
        .groupBy("of_site")
        .agg(F.collect_set(F.when(low, F.col("path"))).alias("removed"), F.collect_set(F.when(high, F.col("path"))).alias("raised"))
    )


def extract_main_text(pages: DataFrame, threshold: float = 0.35, min_pages: int = 4) -> DataFrame:
    """One row per page: page_id, url, text and n_chars.

    Pages without a host (null or malformed url) share a tree of their own. A null or
    empty page has the empty text; equal pages get equal texts; a page with an article
    gives its content less noise and branches that the host repeats. Pages may be of any
    length and depth. An empty table gives no rows, other columns are ignored.
    """
    hosted = pages.select(
        "page_id", "url", F.col("html").cast("string").alias("html"),
        F.lower(F.coalesce(F.regexp_extract(F.col("url").cast("string"), HOST, 1), F.lit(""))).alias("host"),
    )
    parsed = _parsed(hosted)
    # Stored, so that the join has a shuffle of its own and a host with very many pages is split.
    branches = stored(judged_branches(parsed, threshold, min_pages), "judged-branches")
    joined = parsed.join(branches, parsed["site"] == branches["of_site"], "left").select(
        "page_id", "url", "site", "paths", "ups", "flags", "texts", "places", "removed", "raised"
    )
    types = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for site, *page, removed, raised in zip(*(batch.column(i).to_pylist() for i in range(2, 10))):
                texts.append(kept_text(*page, *(frozenset(p ^ site for p in found or ()) for found in (removed, raised))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return joined.mapInArrow(extract, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")
