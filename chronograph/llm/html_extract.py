"""Main-text extraction by wrapper induction over the pages of a host.

Pages of a host with the same set of block element names share a layout; inline elements do not matter. The page with
the fewest blocks is the wrapper of its layout, for the MAX_WRAPPERS most common layouts of the host that have
OWN_WRAPPER different pages, and for the most common one in any case. Pages of other layouts belong to the wrapper of
their host that is most like their layout's smallest page. Every page's block tree is aligned with its wrapper by simple
tree matching (the largest order-keeping match of equal labels). A wrapper node, and the unmatched blocks below one taken
together, are slots. Over the pages of a wrapper, counted once if all their texts are equal:

- a text is constant if MIN_PAGES pages show it in its slot and at most one in MAX_SHARE of the pages that fill the slot
  shows another;
- a slot recurs if MIN_RECURRING pages fill it and it holds at most one different text for every RECURS of them (menus,
  adverts and closing lines drawn from a stock); other slots that one page in ten fills vary;
- the content runs from the first varying slot to the last, in page order.

Constant texts are template, and so are the texts of recurring slots outside the content: a byline between a headline and
the paragraphs stays. Tags and names are the prior where they say something: an article or main element is the content,
and in it only what stands in an element that says by its role, its id or one of its classes (each taken whole) that it is
not main text can be template; containers in it that are named as reader comments or adverts go whole; elements that say
by tag that they are menus, headers, footers, sidebars or forms go. Pages
without an article or main element lose elements marked so by name if the rest holds more text. ``tags=False`` leaves all
of this out, so that alignment alone decides.

So all pages of a host are aligned, however few have a layout. Four passes read the pages; wrappers join them by host
and layout, those of layouts with over a thousandth of all pages by broadcast, and only hashes of texts are shuffled, keyed
by the text, so a host with a third of all pages is spread over all tasks. No part of a page is too deep or too long to be read; nothing here calls itself.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronograph.llm.storage import materialize

MIN_PAGES = 5  # different pages that show a text before it counts as template
OWN_WRAPPER = 20  # different pages of a layout before it has a wrapper beside that of the host's most common layout
MAX_WRAPPERS = 8  # of a host; bounds the comparisons, not the pages that are aligned
MAX_SHARE = 20  # constant: of the pages with text in a slot, at most one in so many shows another text
MIN_RECURRING, RECURS = 15, 3  # pages that fill a slot before it may recur, and how often each of its texts is shown on average

# HTML's element kinds, and words that mark what is not main text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("aside audio button canvas datalist dialog embed footer form head iframe input link map menu meta nav noscript object option script select style svg template textarea title video".split())
RAW = frozenset("script style textarea title noscript iframe template svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILER = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs masthead footer sidebar aside widget cookie cookies consent gdpr notice notices popup modal newsletter subscribe share sharing social related recommended recommendations comment comments disqus reply replies respond search login toolbar pagination pager complementary contentinfo".split())
READERS = frozenset("ad ads advert adverts advertisement sponsored comment comments disqus replies".split())
CONTAINERS = frozenset("div section ul ol dl aside table".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table body html article section div main td th".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|style|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


class Node:
    __slots__ = ("alien", "depth", "dropped", "kids", "label", "marked", "parts", "tag")

    def __init__(self, tag: str, label: str, dropped: bool, marked: bool = False, alien: bool = False):
        self.tag, self.label, self.dropped, self.marked, self.alien, self.parts, self.kids, self.depth = tag, label, dropped, marked, alien, [], [], 0


def _described(attrs: str) -> tuple[str, bool, bool, bool]:
    """The first class, whether the attributes hide the element, whether they mark what is not main text, and whether that
    is reader comments or adverts."""
    first, hidden, marked, alien = "", False, False, False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
        if name == "hidden" or name == "style" and "display:none" in value.replace(" ", "").lower():
            hidden = True
        elif name != "style":
            if name == "class" and value:
                first = value.split()[0] if value.split() else ""
            names = value.lower().split()
            marked = marked or not BOILER.isdisjoint(names)
            alien = alien or not READERS.isdisjoint(names)
    return first, hidden, marked, alien


def parse(html: str) -> Node:
    """The block tree of a page. Inline markup is transparent, unclosed and misnested elements end as in browsers."""
    root = Node("#", "#", False)
    stack, pos, in_main = [root], 0, 0
    while True:
        m = _TOKEN.search(html, pos)
        if m is None:
            break
        if m.start() > pos:
            stack[-1].parts.append(html[pos : m.start()])
        pos = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    if stack[k].depth:
                        stack[k].depth -= 1
                    else:
                        in_main -= sum(x.tag in ("article", "main") for x in stack[k:])
                        del stack[k:]
                    break
                if stack[k].tag in ("td", "th") and tag not in BLOCKS:
                    break
            continue
        if tag == "br":
            stack[-1].parts.append(" ")
        attrs = m[3] or m[6] or ""
        block = tag in BLOCKS
        first, hidden, marked, alien = _described(attrs) if attrs and tag not in ("html", "body", "article", "main") else ("", False, False, False)
        dropped = hidden or tag in DROPPED or tag == "header" and not in_main
        if tag in RAW and not attrs.endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}[^>]*(?:>|\Z)", re.I).search(html, pos)
            pos = end.end() if end else len(html)
            continue
        if not (block or dropped) or tag in VOID:
            if not block and len(stack) > 1 and stack[-1].tag == tag and tag not in VOID:
                stack[-1].depth += 1
            if tag != "hr":
                continue
        if block:
            ends = CLOSES.get(tag, ())
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p" or stack[k].tag in ends:
                    del stack[k:]
                elif stack[k].tag in SCOPE:
                    break
        node = Node(tag, f"{tag}.{first}" if first else tag, dropped, marked, alien and tag in CONTAINERS)
        stack[-1].parts.append(node)
        stack[-1].kids.append(node)
        if tag not in VOID:
            stack.append(node)
            in_main += tag in ("article", "main")
    if pos < len(html):
        stack[-1].parts.append(html[pos:])
    return root


def in_order(root: Node | Wrapper) -> list:
    """The nodes of a tree, each before its children."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += reversed(node.kids)
    return out


def skeleton(root: Node) -> list:
    """The labels of a tree's nodes in order, and the number of each one's parent."""
    nodes = in_order(root)
    number = {id(n): i for i, n in enumerate(nodes)}
    parents = [-1] * len(nodes)
    for i, n in enumerate(nodes):
        for k in n.kids:
            parents[number[id(k)]] = i
    return [[n.label for n in nodes], parents]


class Wrapper:
    """A numbered node of a skeleton, ready for matching."""

    __slots__ = ("by_label", "kids", "label", "number")

    def __init__(self, label: str, number: int):
        self.label, self.number, self.kids, self.by_label = label, number, [], {}

    @staticmethod
    def of(tree: list) -> Wrapper:
        nodes = [Wrapper(label, i) for i, label in enumerate(tree[0])]
        for node, parent in zip(nodes[1:], tree[1][1:], strict=True):
            nodes[parent].kids.append(node)
            nodes[parent].by_label.setdefault(node.label, []).append(node)
        return nodes[0]


def _score(a: Node | Wrapper, b: Wrapper, memo: dict) -> int:
    """Simple tree matching: the nodes in the largest match of two trees that keeps order and parents. ``memo`` holds the
    scores of pairs with children."""
    if a.label != b.label:
        return 0
    stack = [(a, b)]
    while stack:
        x, y = stack[-1]
        if not x.kids or not y.kids or (id(x), y.number) in memo:
            stack.pop()
            continue
        open_ = [(k, m) for k in x.kids if k.kids for m in y.by_label.get(k.label, ()) if m.kids and (id(k), m.number) not in memo]
        if open_:
            stack += open_
        else:
            memo[id(x), y.number] = 1 + _table(x.kids, y.kids, memo)[-1][-1]
            stack.pop()
    return memo.get((id(a), b.number), 1)


def _table(xs: list, ys: list[Wrapper], memo: dict) -> list[list[int]]:
    rows = [[0] * (len(ys) + 1)]
    for x in xs:
        above, row = rows[-1], [0]
        for j, y in enumerate(ys):
            best = max(row[j], above[j + 1])
            if x.label == y.label:
                best = max(best, above[j] + memo.get((id(x), y.number), 1))
            row.append(best)
        rows.append(row)
    return rows


def align(a: Node, b: Wrapper) -> dict[int, int]:
    """The wrapper node of each matched page node, by id."""
    out, memo = {}, {}
    if not _score(a, b, memo):
        return out
    stack = [(a, b)]
    while stack:
        x, y = stack.pop()
        out[id(x)] = y.number
        if not x.kids or not y.kids:
            continue
        rows, i, j = _table(x.kids, y.kids, memo), len(x.kids), len(y.kids)
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                stack.append((x.kids[i - 1], y.kids[j - 1]))
                i, j = i - 1, j - 1
    return out


def _likeness(a: Wrapper, b: Wrapper) -> float:
    """The share of two trees' nodes that their largest match holds."""
    return 2 * _score(a, b, {}) / (len(in_order(a)) + len(in_order(b)))


def slots(root: Node, matched: dict[int, int]) -> dict[int, int]:
    """The slot of each node, by id: the number of its wrapper node, or -1 - the number of the wrapper node of its nearest
    matched ancestor."""
    out, stack = {}, [(root, 0)]
    while stack:
        node, above = stack.pop()
        number = matched.get(id(node))
        out[id(node)] = -1 - above if number is None else number
        above = above if number is None else number
        stack += [(k, above) for k in node.kids]
    return out


def _own_text(node: Node) -> str:
    return " ".join(entities.unescape("".join(p if isinstance(p, str) else " " for p in node.parts)).split())


def _key(label: str) -> int:
    return int.from_bytes(hashlib.blake2b(label.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _mains(root: Node, marked: bool = False) -> list[Node]:
    """The outermost article elements outside dropped elements, and outside marked ones unless ``marked``; a main element
    counts where it holds no article."""
    found, stack = [], [(root, ())]
    while stack:
        node, mains = stack.pop()
        if node.dropped or node.marked and not marked:
            continue
        if node.tag == "article":
            found.append((node, mains))
            continue
        mains = (*mains, node) if node.tag == "main" else mains
        if node.tag == "main":
            found.append((node, mains[:-1]))
        stack += [(k, mains) for k in reversed(node.kids)]
    outer = {id(m) for _, mains in found for m in mains}
    return [n for n, _ in found if id(n) not in outer]


def _blocks(tops: list[Node], tags: bool, gone, aliens: bool = True) -> list[str]:
    """The texts of the blocks below ``tops`` in page order, without what ``gone(node, whether in a marked element)`` says,
    and unless ``aliens`` without reader comments and adverts."""
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if text := " ".join(entities.unescape("".join(run)).split()):
            blocks.append(text)
        run.clear()

    for top in tops:
        stack: list = [(top, False)]
        while stack:
            part, inside = stack.pop()
            if isinstance(part, str):
                run.append(part)
                continue
            if part is None:
                flush()
                continue
            if part.dropped and (tags or part.tag not in BLOCKS) or part.alien and not aliens:
                if part.tag in BLOCKS:
                    flush()
                continue
            if part.tag not in BLOCKS and part.tag != "#":
                continue
            inside = inside or part.marked
            hidden = gone(part, inside)
            flush()
            stack.append((None, False))
            stack += [(p, inside) for p in reversed(part.parts) if not (hidden and isinstance(p, str))]
        flush()
    return blocks


def main_text(root: Node, slot: dict[int, int], constant: dict[int, int], outside: set[int], tags: bool = True) -> str:
    """The text of a page without what is template: the constant texts (hashes, by slot), and the slots that recur outside
    the content."""
    same = lambda n: constant.get(slot[id(n)]) == _key(_own_text(n)) if slot[id(n)] in constant else False
    if tags and (tops := _mains(root) or _mains(root, True)):
        return "\n\n".join(_blocks(tops, tags, lambda n, inside: inside and same(n), aliens=False))
    template = lambda n: slot[id(n)] in outside or same(n)
    whole = _blocks([root], tags, lambda n, inside: template(n))
    if tags:
        plain = _blocks([root], tags, lambda n, inside: inside or template(n))
        if 2 * sum(map(len, plain)) > sum(map(len, whole)):
            return "\n\n".join(plain)
    return "\n\n".join(whole)


def extract(pages: DataFrame, tags: bool = True) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html).

    A null html is empty and gives an empty text; a null url, or one without ``://``, belongs to the host named "";
    repeated pages count once in the statistics and each give their row; other columns are passed over; an empty table
    gives no rows.
    """
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    base = base.withColumn("host", F.xxhash64(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "://([^/?#]*)", 1))))
    names = F.transform(F.regexp_extract_all("html", F.lit(r"<([a-zA-Z][a-zA-Z0-9-]*)"), F.lit(1)), lambda x: F.lower(x))
    blocks = F.array_intersect(names, F.array(*(F.lit(b) for b in sorted(BLOCKS))))
    base = base.withColumn("layout", F.xxhash64(F.concat_ws(" ", F.array_sort(blocks))))

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], tuple[int, str]] = {}
        for batch in batches:
            for html, *key in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                root, key = parse(html), tuple(key)
                n = len(in_order(root))
                if key not in best or n <= best[key][0]:
                    candidate = (n, json.dumps(skeleton(root), separators=(",", ":")))
                    best[key] = min(best.get(key, candidate), candidate)
            if len(best) > 20_000:
                yield _packed(best)
                best = {}
        yield _packed(best)

    layouts = base.select("html", "host", "layout").mapInArrow(survey, "host long, layout long, blocks long, tree string")
    layouts = layouts.groupBy("host", "layout").agg(F.min(F.struct("blocks", "tree"))["tree"].alias("tree"))
    different = base.groupBy("host", "layout", F.xxhash64("html").alias("page")).agg(F.count("*").alias("rows"))
    counts = different.groupBy("host", "layout").agg(F.count("*").alias("pages"), F.sum("rows").alias("rows"))
    layouts = materialize(layouts.join(counts, ["host", "layout"]), "layouts")
    total = layouts.agg(F.sum("rows")).first()[0] or 0
    crowded = layouts.select("host", "layout", (F.col("rows") * 1000 > total).alias("hot"))
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("pages"), "layout"))
    own = layouts.select("host", "layout", "pages", rank.alias("rank")).where(f"rank = 1 or rank <= {MAX_WRAPPERS} and pages >= {OWN_WRAPPER}")
    own = materialize(layouts.join(own.select("host", "layout"), ["host", "layout"]).select("host", F.col("layout").alias("wrapper"), "tree"), "own")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            likeness = [_likeness(_wrapper(a), _wrapper(b)) for a, b in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(likeness, pa.float64())], ["host", "layout", "wrapper", "likeness"])

    rest = layouts.join(own.select("host", F.col("wrapper").alias("layout")), ["host", "layout"], "left_anti").withColumnRenamed("tree", "small")
    rest = rest.join(own, "host").select("host", "layout", "wrapper", "small", "tree").mapInArrow(compare, "host long, layout long, wrapper long, likeness double")
    nearest = rest.groupBy("host", "layout").agg(F.max(F.struct("likeness", "wrapper"))["wrapper"].alias("wrapper"))
    nearest = nearest.unionByName(own.select("host", F.col("wrapper").alias("layout"), "wrapper"))
    wrappers = materialize(nearest.join(own, ["host", "wrapper"]).join(crowded, ["host", "layout"]), "wrappers")

    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int, int, int, int]] = set()
        for batch in batches:
            for html, host, wrapper, tree in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                root, slot = _aligned(html, tree)
                at = [(slot[id(node)], _key(text)) for node in in_order(root) if (text := _own_text(node))]
                page = _key(str(sorted(h for _, h in at)))
                seen.update((host, wrapper, number, h, page) for number, h in at)
            if len(seen) > 200_000:
                yield _counted(seen)
                seen = set()
        yield _counted(seen)

    joined = _with_wrappers(base, wrappers, ["wrapper", "tree"]).select("html", "host", "wrapper", "tree")
    texts = joined.mapInArrow(observe, "host long, wrapper long, slot long, text long, page long").distinct()
    texts = materialize(texts, "texts")
    counts = texts.groupBy("host", "wrapper", "slot", "text").agg(F.count("*").alias("n"))
    pages_of = texts.groupBy("host", "wrapper", "slot", "page").agg(F.lit(1).alias("one")).groupBy("host", "wrapper", "slot").agg(F.count("*").alias("filled"))
    total = texts.select("host", "wrapper", "page").distinct().groupBy("host", "wrapper").agg(F.count("*").alias("total"))
    held = counts.groupBy("host", "wrapper", "slot").agg(F.count("*").alias("texts"), F.sum("n").alias("shown"))
    held = materialize(held.join(pages_of, ["host", "wrapper", "slot"]).join(total, ["host", "wrapper"]), "slots")
    constant = counts.where(F.col("n") >= MIN_PAGES).join(held, ["host", "wrapper", "slot"]).where((F.col("filled") - F.col("n")) * MAX_SHARE <= F.col("filled"))
    constant = constant.groupBy("host", "wrapper").agg(F.sort_array(F.collect_list(F.struct("slot", "text"))).alias("known"))
    recurs = (F.col("filled") >= MIN_RECURRING) & (F.col("texts") * RECURS <= F.col("shown"))
    place = F.when(F.col("slot") < 0, -1 - F.col("slot")).otherwise(F.col("slot"))
    held = held.select("host", "wrapper", "slot", place.alias("place"), recurs.alias("recurs"), (~recurs & (F.col("filled") * 10 >= F.col("total"))).alias("varies"))
    content = held.where("varies").groupBy("host", "wrapper").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    outside = held.where("recurs").join(content, ["host", "wrapper"]).where("place < first or place > last")
    outside = outside.groupBy("host", "wrapper").agg(F.sort_array(F.collect_list("slot")).alias("outside"))
    constant = constant.select("host", "wrapper", F.col("known.slot").alias("slots"), F.col("known.text").alias("texts"))
    final = wrappers.join(constant, ["host", "wrapper"], "left").join(outside, ["host", "wrapper"], "left")
    final = materialize(final.select("host", "layout", "tree", "slots", "texts", "outside", "hot"), "wrappers")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for html, tree, numbers, texts, outside in zip(*(batch.column(i).to_pylist() for i in range(2, 7)), strict=True):
                root, slot = _aligned(html, tree)
                out.append(main_text(root, slot, dict(zip(numbers or (), texts or (), strict=True)), set(outside or ()), tags))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    out = _with_wrappers(base, final, ["tree", "slots", "texts", "outside"]).select("page_id", "url", "html", "tree", "slots", "texts", "outside").mapInArrow(take, "page_id long, url string, text string")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def _with_wrappers(base: DataFrame, wrappers: DataFrame, columns: list[str]) -> DataFrame:
    """``base`` with the columns of its wrapper, which every host and layout has; a thousand hot layouts at most are broadcast,
    and their pages are dealt by page in the join of the others."""
    named = lambda prefix, x: x.select(F.col("host").alias(f"{prefix}_host"), F.col("layout").alias(f"{prefix}_layout"), *(F.col(c).alias(f"{prefix}_{c}") for c in columns))
    hot, rest = F.broadcast(named("hot", wrappers.where("hot"))), named("own", wrappers.where("not hot"))
    x = base.join(hot, (F.col("host") == F.col("hot_host")) & (F.col("layout") == F.col("hot_layout")), "left")
    by = F.when(F.col("hot_host").isNotNull(), F.xxhash64("page_id", "url")).otherwise(F.col("host"))
    x = x.withColumn("by", by).join(rest, (F.col("by") == F.col("own_host")) & (F.col("layout") == F.col("own_layout")), "left")
    return x.select(*base.columns, *(F.coalesce(f"hot_{c}", f"own_{c}").alias(c) for c in columns))


_wrappers: dict[str, Wrapper] = {}


def _wrapper(tree: str) -> Wrapper:
    if tree not in _wrappers:
        if len(_wrappers) > 1000:
            _wrappers.clear()
        _wrappers[tree] = Wrapper.of(json.loads(tree))
    return _wrappers[tree]


def _aligned(html: str, tree: str) -> tuple[Node, dict[int, int]]:
    """A page's block tree, and the slot of each of its nodes."""
    root = parse(html)
    return root, slots(root, align(root, _wrapper(tree)))


def _packed(best: dict[tuple[int, int], tuple[int, str]]) -> pa.RecordBatch:
    rows = [(*k, *v) for k, v in best.items()]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()], strict=True)], ["host", "layout", "blocks", "tree"])


def _counted(seen: set[tuple[int, int, int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*seen, strict=True)) if seen else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["host", "wrapper", "slot", "text", "page"])
