"""Main text of pages by wrapper induction.

Pages of a host that share a layout, the shape of a page near its top, are aligned with reference pages of that layout by
simple tree matching. A node whose text equals that of the reference node it is matched with, on most of the
layout's articles, is template; the varying slots are content. Pages of layouts too rare for that are held against
references of the whole host.
Markup tells the rest: navigation, forms, notices and the like are left out by element, role or class, and where a page
has an article or main element, the text is what stands inside.

References are chosen by hash, a fixed number per layout; every page is aligned and counted, in partial aggregates.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from math import isqrt
from operator import add

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampwise.llm.common import map_texts, slices
from ampwise.llm.url_rules import host_of
from ampwise.session import stage

REFERENCES = 2
MIN_PAGES = 4  # distinct pages of a layout or host, below which nothing counts as template
CONSTANT_SHARE = 0.6
MARK_BLOCKS = 3  # the longest blocks of a page tell copies of an article from other articles
BROADCAST_BYTES = 32 << 20
KEPT_PARSES = 64

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^\s/>]*(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"\shidden(?=[\s=/>])|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
WORDS = re.compile(r"[a-z0-9]+")
BLANK = re.compile(r"\s+")

# Elements of HTML by what they are for.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul br".split()
)
CLOSES_P = BLOCKS - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body"}
SAME_CLOSES = {"li": {"ul", "ol", "menu"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
NOISE_TAGS = set(
    "head script style noscript template nav footer aside form button select textarea input iframe object svg canvas audio video"
    " dialog menu search title label fieldset".split()
)
NOISE_ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
NOISE_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb"
    " breadcrumbs sidebar footer cookie cookies consent gdpr notice popup modal newsletter subscribe subscription signup login share"
    " sharing social comment comments reply replies disqus related recommended widget toolbar pagination pager masthead".split()
)
#: Further words of class names made of several words, such as site-footer; others (has-sidebar, no-comments) say something else.
PLACE_WORDS = set(
    "site page main global top bottom left right primary secondary first second third box bar links list block area section inner outer"
    " wrap wrapper container group holder panel button buttons icon icons items item text message title form header head"
    " post article entry wp js c m b l u".split()
)
CONTENT_IDS = set("content main article post entry story primary page".split())
CONTAINERS = set("article aside div dl fieldset figure footer form header main nav ol section table ul".split())
PAGE_HEADS = {"header", "hgroup"}


class Node:
    __slots__ = ("tag", "kids", "noise", "main", "named", "label", "shape", "place", "text", "size")

    def __init__(self, tag: str, noise: bool = False, main: bool = False, named: bool = False, label: str = ""):
        self.tag, self.kids, self.noise, self.main, self.named, self.label = tag, [], noise, main, named, label
        self.shape, self.place, self.text, self.size = 0, 0, "", 1


def _names_noise(value: str) -> bool:
    """Whether a class or id names boilerplate: a token that is such a word, or such words and words of place."""
    for token in value.split():
        words = [w.rstrip("0123456789") for w in WORDS.findall(token)]
        if not NOISE_WORDS.isdisjoint(words) and all(w in NOISE_WORDS or w in PLACE_WORDS or not w for w in words):
            return True
    return False


def _marks(token: str, tag: str) -> tuple[bool, bool, bool]:
    """Whether an element is noise, holds the main text, or is named like noise, by its tag and attributes."""
    if tag in NOISE_TAGS:
        return True, False, False
    main = tag in ("article", "main")
    if "=" not in token:
        return False, main, False
    noise, named, content = HIDDEN.search(token) is not None, False, False
    for name, *values in ATTRIBUTE.findall(token):
        value = "".join(values).lower()
        if name.lower() == "role":
            noise |= value.strip() in NOISE_ROLES
            main |= value.strip() in ("main", "article")
        elif name.lower() == "itemprop":
            main |= value.strip() == "articlebody"
        elif tag not in ("html", "body"):
            words = set(WORDS.findall(value))
            named |= _names_noise(value) or (bool(words & {"header", "head"}) and tag in ("div", "section") and len(words) == 1)
            content |= name.lower() == "id" and value.strip() in CONTENT_IDS
    return noise, main and not noise, named and not content


@lru_cache(maxsize=1 << 14)
def _read(token: str) -> tuple[str, tuple[bool, bool, bool]]:
    """Name and marks of a tag; pages of a host repeat most of theirs."""
    tag = NAME.match(token)[1].lower()
    return tag, (False, False, False) if token[1] == "/" else _marks(token, tag)


def settle_names(root: Node) -> None:
    """Elements named like noise become noise, but for those of the main text and the elements round them.

    A main element frees itself and all round it, an article that stands in no other article frees itself; articles in
    elements named like noise (related posts, comments) free these only on a page without another article.
    """
    stack: list[tuple[Node, tuple | None, bool]] = [(root, None, False)]  # element, chain of named ones round it, in an article
    hidden, marked = [], []
    while stack:
        node, chain, nested = stack.pop()
        if node.noise:
            continue
        if node.named:
            marked.append(node)
            chain = (node, chain)
        if node.main:
            if node.tag != "article" or not nested:
                node.named = False
            if node.tag != "article":
                _free(chain)
            elif not nested:
                hidden.append(chain)
        nested = nested or (node.main and node.tag == "article")
        stack.extend((k, chain, nested) for k in node.kids if not isinstance(k, str))
    if hidden and all(_any_named(chain) for chain in hidden):
        for chain in hidden:
            _free(chain)
    for node in marked:
        node.noise |= node.named


def _free(chain: tuple | None) -> None:
    while chain:
        chain[0].named, chain = False, chain[1]


def _any_named(chain: tuple | None) -> bool:
    while chain and not chain[0].named:
        chain = chain[1]
    return chain is not None


def parse(page: str) -> Node:
    """The tree of a page; kids are nodes and decoded text. Unclosed and stray tags are mended."""
    root = Node("#root")
    stack, at, length = [root], 0, len(page)
    opened: dict[str, int] = {}  # open elements by tag, so that stray tags need no search

    def close(k: int) -> None:
        for node in stack[k:]:
            opened[node.tag] -= 1
        del stack[k:]

    while at < length:
        found = TOKEN.search(page, at)
        start = found.start() if found else length
        if start > at:
            stack[-1].kids.append(html.unescape(page[at:start]))
        if not found:
            break
        token, at = found[0], found.end()
        if token[1] in "!?":
            continue
        tag, (noise, main, named) = _read(token)
        if token[1] == "/":
            for k in range(len(stack) - 1, 0, -1) if opened.get(tag) else ():
                if stack[k].tag == tag:
                    close(k)
                    break
                if tag not in BLOCKS and stack[k].tag in BLOCKS:
                    break
            continue
        if tag in CLOSES_P and opened.get("p"):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in BLOCKS:
                    break
        if tag in SAME_CLOSES and (opened.get(tag) or tag in ("td", "th")):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag or stack[k].tag in ("td", "th") and tag in ("td", "th"):
                    close(k)
                    break
                if stack[k].tag in SAME_CLOSES[tag]:
                    break
        if tag in PAGE_HEADS and not any(n.main for n in stack):
            noise = True
        node = Node(tag, noise, main, named, token)
        stack[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.I).search(page, at)
            at = end.end()
        elif tag not in VOID and not token.endswith("/>"):
            stack.append(node)
            opened[tag] = opened.get(tag, 0) + 1
    settle_names(root)
    return root


def number(root: Node) -> list[Node]:
    """The elements in page order, each with its place and a hash of its shape; blocks also with their text.

    A block's text includes that of its inline elements but not that of blocks inside it.
    """
    nodes, stack = [], [root]
    while stack:
        node = stack.pop()
        node.place = len(nodes)
        nodes.append(node)
        stack.extend(k for k in reversed(node.kids) if not isinstance(k, str))
    passed = [""] * len(nodes)  # what an element gives to the text around it
    for node in reversed(nodes):
        own, shape = [], [node.tag]
        for kid in node.kids:
            if isinstance(kid, str):
                own.append(kid)
            else:
                own.append(passed[kid.place])
                passed[kid.place] = ""
                shape.append(kid.shape)
                node.size += kid.size
        node.shape = hash(tuple(shape))
        text = "" if node.noise else "".join(own)
        if node.tag in BLOCKS:
            node.text, text = BLANK.sub(" ", text).strip(), " "
        passed[node.place] = text
    return nodes


def _middle(one: Node, two: Node) -> tuple[list[Node], list[Node], list[tuple[Node, Node]]]:
    """Kids of both without those of one shape at both ends of the lists, which belong together, and these pairs."""
    left = [k for k in one.kids if not isinstance(k, str)]
    right = [k for k in two.kids if not isinstance(k, str)]
    m, n, low = len(left), len(right), 0
    while low < min(m, n) and left[low].shape == right[low].shape:
        low += 1
    ends = list(zip(left[:low], right))
    while m > low and n > low and left[m - 1].shape == right[n - 1].shape:
        m, n = m - 1, n - 1
        ends.append((left[m], right[n]))
    return left[low:m], right[low:n], ends


class Sizes:
    """Sizes of the largest matches of two trees; they depend on the shapes only, so each pair of shapes is settled once."""

    def __init__(self):
        self.known: dict[tuple[int, int], int] = {}

    def gain(self, a: Node, b: Node) -> int:
        return 0 if a.tag != b.tag else a.size if a.shape == b.shape else self.known[a.shape, b.shape]

    def row(self, above: list[int], a: Node, right: list[Node]) -> list[int]:
        """The next row of the table: the best of the first kids on the left against each number of kids on the right."""
        gains = [self.gain(a, b) for b in right]
        return list(accumulate(map(max, above[1:], map(add, above, gains)), max, initial=0))

    def settle(self, left: list[Node], right: list[Node]) -> None:
        """Makes the gains of all pairs known; trees of any depth, inner pairs first."""
        todo = self.missing(left, right)
        while todo:
            a, b = todo[-1]
            one, two, ends = _middle(a, b)
            missing = [] if (a.shape, b.shape) in self.known else self.missing(one, two)
            if missing:
                todo.extend(missing)
                continue
            todo.pop()
            if (a.shape, b.shape) not in self.known:
                row = [0] * (len(two) + 1)
                for kid in one:
                    row = self.row(row, kid, two)
                self.known[a.shape, b.shape] = 1 + sum(k.size for k, _ in ends) + row[-1]

    def missing(self, left: list[Node], right: list[Node]) -> list[tuple[Node, Node]]:
        ones, twos = ({k.shape: k for k in kids}.values() for kids in (left, right))
        return [(a, b) for a in ones for b in twos if a.tag == b.tag and a.shape != b.shape and (a.shape, b.shape) not in self.known]

    def aligned(self, left: list[Node], right: list[Node]) -> list[tuple[Node, Node]]:
        """The kids of a largest match. Of the table every so many rows are held, those between are made again on the way back."""
        self.settle(left, right)
        step = isqrt(len(left)) + 1
        row, held = [0] * (len(right) + 1), []
        for i, a in enumerate(left):
            if i % step == 0:
                held.append(row)
            row = self.row(row, a, right)
        pairs, j = [], len(right)
        for at in reversed(range(0, len(left), step)):
            rows = [held.pop()]
            for a in left[at : at + step]:
                rows.append(self.row(rows[-1], a, right))
            i = len(rows) - 1
            while i and j:
                if rows[i][j] == rows[i - 1][j]:
                    i -= 1
                elif rows[i][j] == rows[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    pairs.append((left[at + i], right[j]))
        return pairs


def matched(one: Node, two: Node, pairs: list[tuple[Node, Node]]) -> int:
    """Simple tree matching: the size of the largest match that keeps parents and order, and its pairs."""
    sizes, before = Sizes(), len(pairs)
    todo = [(one, two)] if one.tag == two.tag else []
    while todo:
        a, b = todo.pop()
        pairs.append((a, b))
        if a.noise and b.noise:
            continue  # left out as a whole
        left, right, ends = _middle(a, b)
        todo += ends
        if left and right:
            todo += sizes.aligned(left, right)
    return len(pairs) - before


def equal_places(nodes: list[Node], reference: list[Node]) -> list[tuple[int, int]]:
    """Places in a page and in the reference of matched elements with the same text of their own."""
    pairs: list[tuple[Node, Node]] = []
    matched(nodes[0], reference[0], pairs)
    return [(a.place, b.place) for a, b in pairs if a.text and a.text == b.text]


def main_blocks(root: Node, template: set[int], seen: set[int] | None = None) -> list[str]:
    """The texts of blocks outside noise and template, inside article or main elements where the page has them.

    ``seen`` gathers the places of the elements whose text may be among them.
    """

    blocks, current = [], []

    def flush() -> None:
        text = BLANK.sub(" ", "".join(current)).strip()
        current.clear()
        if text:
            blocks.append(text)

    whole, stack = True, [root]
    while stack and whole:
        for kid in stack.pop().kids:
            if not isinstance(kid, str) and not kid.noise:
                whole = whole and not kid.main
                stack.append(kid)
    walk: list[tuple[Node | str | None, bool, bool]] = [(root, whole, False)]  # None is the end of a block
    while walk:
        node, inside, dropped = walk.pop()
        if node is None:
            flush()
        elif isinstance(node, str):
            if inside and not dropped:
                current.append(node)
        elif not node.noise:
            inside = inside or node.main
            if node.tag in BLOCKS:
                dropped = node.place in template and node.tag != "h1"
                if inside and seen is not None:
                    seen.add(node.place)
                flush()
                walk.append((None, inside, dropped))
            walk.extend((kid, inside, dropped) for kid in reversed(node.kids))
    flush()
    return blocks


def main_text(root: Node, template: set[int]) -> str:
    return " ".join(main_blocks(root, template))


def content_mark(root: Node) -> int:
    """A hash of the longest blocks of the main text.

    Copies of an article, with other scripts, addresses or counts of comments, have the same mark, so that together they have
    one voice in what is constant on their host: an article is no template because it is copied.
    """
    longest = sorted(main_blocks(root, set()), key=lambda block: (-len(block), block))[:MARK_BLOCKS]
    return xxhash.xxh64_intdigest("\n".join(longest).encode()) - (1 << 63)




class Parses:
    """Numbered trees, content marks and the places that matter of the references met last."""

    def __init__(self):
        self.held: dict[str, tuple[list[Node], int, set[int]]] = {}

    def of(self, page: str) -> tuple[list[Node], int, set[int]]:
        found = self.held.pop(page, None)
        if found is None:
            nodes, seen = number(parse(page)), set()
            main_blocks(nodes[0], set(), seen)
            found = nodes, content_mark(nodes[0]), seen
        self.held[page] = found
        if len(self.held) > KEPT_PARSES:
            del self.held[next(iter(self.held))]
        return found


def layout(root: Node) -> int:
    """A hash of the shape of a page near its top, never 0: elements that are not noise, tags and class names without digits.

    Elements round the whole page are passed by. Runs of equal elements count once, so longer pages have the same layout.
    """

    def kids(node: Node) -> list[Node]:
        return [k for k in node.kids if not isinstance(k, str) and not k.noise and k.tag not in VOID]

    def name(node: Node) -> str:
        classes = ["".join(values) for key, *values in ATTRIBUTE.findall(node.label) if key.lower() == "class"]
        return " ".join([node.tag, *sorted({w for c in classes for w in re.sub(r"\d+", "", c.lower()).split()})])

    node, below = root, kids(root)
    while len(below) == 1 and not below[0].main and below[0].tag in BLOCKS and kids(below[0]):
        node, below = below[0], kids(below[0])
    names: list[str] = []
    for kid in below:
        inner = () if kid.main else {name(k) for k in kids(kid) if k.tag in CONTAINERS}
        own = ">".join([name(kid), *sorted(inner)])
        if names[-1:] != [own]:
            names.append(own)
    return xxhash.xxh64_intdigest("|".join(names).encode()) >> 1 | 1


PAGES = "page_id long, url string, html string, host string, layout long, mark long"


def _layout_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "html"):
            found = []
            for page in batch.column("html").to_pylist():
                root = parse(page)
                found.append((layout(root), content_mark(root)))
            columns = [pa.array(column, pa.int64()) for column in zip(*found)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [c.split()[0] for c in PAGES.split(", ")])


EQUAL = "host string, layout long, which int, mark long, places array<int>"


def _equal_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every page the places in each reference where it says the same; layout 0 stands for the whole host."""
    parses = Parses()
    for batch in (part for whole in batches for part in slices(whole, "html")):
        out = []
        columns = ("host", "layout", "mark", "html", "references", "own_references")
        for host, own, mark, page, *kinds in zip(*(batch.column(c).to_pylist() for c in columns)):
            nodes, places = None, {}
            for key, references in zip((0, own), kinds):
                for which, reference in enumerate(references or []):
                    other, other_mark, seen = parses.of(reference)
                    if other_mark == mark:
                        continue
                    if reference not in places:
                        nodes = nodes or number(parse(page))
                        places[reference] = sorted({place for _, place in equal_places(nodes, other) if place in seen})
                    out.append((host, key, which, mark, places[reference]))
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["host", "layout", "which", "mark", "places"]
        )


TEXTS = "page_id long, url string, text string, n_chars long"


def _text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parses = Parses()
    for batch in (part for whole in batches for part in slices(whole, "html")):
        texts = []
        for page, references, constants in zip(*(batch.column(c).to_pylist() for c in ("html", "references", "constants"))):
            root, nodes, template = parse(page), None, set()
            for which, reference in enumerate(references or []):
                known = {c["place"] for c in constants or [] if c["which"] == which}
                if known:
                    nodes = nodes or number(root)
                    template.update(place for place, other in equal_places(nodes, parses.of(reference)[0]) if other in known)
            texts.append(main_text(root, template))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def _bounded(table: DataFrame, column: str) -> DataFrame:
    """The staged table, marked for broadcast if its pages have at most ``BROADCAST_BYTES`` bytes."""
    size = table.agg(F.sum(F.octet_length(F.array_join(column, "")))).first()[0]
    return F.broadcast(table) if (size or 0) <= BROADCAST_BYTES else table


def extract(pages: DataFrame, references: int = REFERENCES) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages``: the main text, and its code points.

    A null or empty html, and a page of noise only, has an empty text. A null url has the empty host; so have urls
    without one, and they share templates. Repeated rows are extracted alike; pages with the same article, in its longest
    blocks, count once as evidence for a template, and a layout or host needs ``MIN_PAGES`` articles to have one. Only page_id, url and html are read; an empty
    table gives no rows.
    """
    source = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).alias("html"), host_of(F.col("url")).alias("host")
    )
    source = stage(map_texts(source, _layout_batches, PAGES))
    rank = F.struct(F.xxhash64("mark").alias("rank"), "html")
    ranked = source.groupBy("host", "layout").agg(F.min(rank).alias("first"), F.max(rank).alias("last"))
    ranked = stage(ranked)
    articles = stage(source.select("host", "layout", "mark").distinct())
    own_totals = articles.groupBy("host", "layout").agg(F.count("*").alias("total"))
    totals = articles.select("host", "mark").distinct().groupBy("host").agg(F.count("*").alias("total"))
    totals = stage(own_totals.unionByName(totals.withColumn("layout", F.lit(0).cast("long"))).where(F.col("total") >= MIN_PAGES))
    chosen = F.slice(F.array_distinct(F.array("first.html", "last.html")), 1, references)
    of_hosts = ranked.groupBy("host").agg(F.min("first").alias("first"), F.max("last").alias("last")).select("host", chosen.alias("references"))
    of_layouts = ranked.join(totals.where("layout != 0"), ["host", "layout"]).select("host", "layout", chosen.alias("own_references"))
    of_hosts = of_hosts.join(totals.where("layout = 0").select("host"), "host")
    of_hosts, of_layouts = stage(of_hosts), stage(of_layouts)
    joined = source.select("host", "layout", "mark", "html").join(_bounded(of_hosts, "references"), "host")
    joined = joined.join(_bounded(of_layouts, "own_references"), ["host", "layout"], "left")
    equal = map_texts(joined, _equal_batches, EQUAL)
    # copies of an article have one voice: the one of theirs that comes first
    voices = equal.groupBy("host", "layout", "which", "mark").agg(F.min("places").alias("places"))
    counts = voices.select("host", "layout", "which", F.explode("places").alias("place")).groupBy("host", "layout", "which", "place")
    counts = stage(counts.agg(F.count("*").alias("n")))
    constant = counts.join(totals, ["host", "layout"]).where(F.col("n") + 1 >= CONSTANT_SHARE * F.col("total"))
    constant = constant.groupBy("host", "layout").agg(F.collect_list(F.struct("which", "place")).alias("constants"))
    own = of_layouts.join(constant.withColumnRenamed("constants", "own_constants"), ["host", "layout"])
    whole = of_hosts.join(constant.where("layout = 0").drop("layout"), "host")
    wrapped = source.join(_bounded(stage(own), "own_references"), ["host", "layout"], "left")
    wrapped = wrapped.join(_bounded(stage(whole), "references"), "host", "left")
    has_own = F.col("own_references").isNotNull()
    wrapped = wrapped.select(
        "page_id",
        "url",
        "html",
        F.when(has_own, F.col("own_references")).otherwise(F.col("references")).alias("references"),
        F.when(has_own, F.col("own_constants")).otherwise(F.col("constants")).alias("constants"),
    )
    return map_texts(wrapped, _text_batches, TEXTS)
