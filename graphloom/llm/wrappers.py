"""Operator 9: main text of web pages by wrapper induction.

Pages of one host share a template. One page of each host, that with the smallest hash, gives a reference tree. Every page's
DOM tree is aligned with its host's reference by simple tree matching (the largest ordered matching of children of equal tag and
class, level by level; runs of equal siblings count as one repeated slot). Over all pages of a host Spark adds up what each
reference node held: a node whose text is the same on at least `least_pages` pages, though the article differs, is template;
the node down to which the varying text goes is the content: the way down ends at article or main, and where text besides the
child that holds most isn't template. A page's main text is what its content node holds, without template nodes and without what
its tag or class says is none: menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments. A class
such as no-sidebar or has-sidebar says nothing of the kind, nor does one on a node with most of the page's text, if no article or
main lies elsewhere and it isn't that of comments or a consent notice. A page that doesn't align (or the only one of its host) finds the content node by itself.

The references and the wrappers hold one row a host. While they take at most `max_shipped` characters they go to every task;
beyond that the pages are joined with them on the host, a key that adaptive execution splits where it is hot.

Nulls and odd input: a null page is empty: text '' and n_chars 0. A null or odd url belongs to the host ''. Broken markup is
read as browsers do where it matters (unclosed and implied end tags, raw text elements); elements more than 200 levels deep lie
beside each other in the last level, as in browsers beyond theirs. Repeated rows are extracted each.
Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import itertools
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, sliced

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template xmp iframe noembed".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("html body main article section div table tbody tr td center".split())
CLOSES = {  # a start tag ends these, up to the bound
    **dict.fromkeys(BLOCK - {"tr", "td", "th", "tbody", "thead", "tfoot", "li", "dd", "dt"}, ({"p"}, {"td", "th", "table", "button", "li", "dd", "div", "article", "section", "main"})),
    "li": ({"li", "p"}, {"ul", "ol"}), "dd": ({"dd", "dt", "p"}, {"dl"}), "dt": ({"dd", "dt", "p"}, {"dl"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}), "td": ({"td", "th", "p"}, {"tr", "table"}), "th": ({"td", "th", "p"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
NOT_TEXT = frozenset("head script style noscript template title nav footer aside form svg math button select option textarea input iframe object canvas dialog menu".split())
#: Words of class, id or role that mark what isn't the article.
NOT_CONTENT = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe subscription signup sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead share sharing social related recommended comment comments disqus reply replies widget search login toolbar skip complementary contentinfo".split())
#: Those whose text may well be more than the article's.
NEVER_CONTENT = frozenset("cookie cookies consent gdpr comment comments disqus reply replies".split())
#: Words that say a name isn't of what follows but of what has it, or hasn't.
OF_OTHERS = frozenset("no not non without has have with".split())
MARKED = frozenset(("article", "main"))
SPACE = re.compile(r"\s+")
DEPTH = 200  # levels of a tree at most


class Node:
    __slots__ = ("tag", "sign", "kids", "skip")

    def __init__(self, tag: str, sign: str, skip: bool):
        self.tag, self.sign, self.skip = tag, sign, skip
        self.kids: list[Node | str] = []


def parse(page: str) -> Node:
    """The page's tree; text is decoded later."""
    root = Node("html", "html", False)
    stack, at = [root], 0
    doubtful: list[Node] = []  # skipped for their class only
    marked: list[Node] = []
    deep: list[Node] = []  # open elements beyond the last level
    hidden: int | None = None  # the first of them that is skipped
    n_open: Counter[str] = Counter()
    top = root  # takes what comes next

    def close(count: int) -> Node:
        """All but the first `count` elements beyond the last level end."""
        nonlocal hidden
        if hidden is not None and hidden >= count:
            hidden = None
        after = stack[-1] if hidden is None else deep[hidden]
        if any(n.tag in BLOCK for n in deep[count:]):
            after.kids.append(Node("div", "div", False))  # a break
        n_open.subtract(n.tag for n in deep[count:])
        del deep[count:]
        return after

    scan = TOKEN.search
    while m := scan(page, at):
        if m.start() > at:
            top.kids.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if not tag:
            if m[0].startswith("<![CDATA["):
                top.kids.append(m[0][9:-3])
            continue
        tag = tag.lower()
        if m[1] and n_open[tag] <= 0:
            continue
        if m[1]:  # an end tag: closes the nearest open one, with what is open in it
            for i in range(len(deep) - 1, -1, -1):
                if deep[i].tag == tag:
                    top = close(i)
                    break
            else:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        n_open.subtract(n.tag for n in itertools.chain(stack[i:], deep))
                        del stack[i:], deep[:]
                        top, hidden = stack[-1], None
                        break
            continue
        if tag in ("html", "body") and any(n.tag == tag for n in stack):
            continue
        ended, bound = CLOSES.get(tag, ((), ()))
        if any(n_open[t] > 0 for t in ended):
            cut, n = None, len(stack)
            for i in range(n + len(deep) - 1, 0, -1):
                other = (deep[i - n] if i >= n else stack[i]).tag
                if other in ended:
                    cut = i
                elif other in bound:
                    break
            if cut is not None and cut >= n:
                top = close(cut - n)
            elif cut is not None:
                n_open.subtract(n.tag for n in itertools.chain(stack[cut:], deep))
                del stack[cut:], deep[:]
                top, hidden = stack[-1], None
        marks = m[3].lower() if m[3] else ""
        words: set[str] = set()
        says: set[str] = set()
        if "=" in marks:
            for a in ATTRIBUTE.finditer(marks):
                for name in (a[2] or a[3] or a[4] or "").split():
                    parts = [w for w in re.split(r"[_-]+", name) if w]
                    words.update(parts)
                    if OF_OTHERS.isdisjoint(parts):
                        says.update(parts)
                    else:
                        says.update(parts[: min(parts.index(w) for w in parts if w in OF_OTHERS)])
        skip = tag in NOT_TEXT or not says.isdisjoint(NOT_CONTENT) and tag not in ("body", "html", "article", "main")
        if tag == "header" and not any(n.tag in ("article", "main") for n in stack):
            skip = True
        node = Node(tag, f"{tag}.{'.'.join(sorted(w for w in words if not any(map(str.isdigit, w))))}" if words else tag, skip)
        top.kids.append(node)
        if tag in MARKED and hidden is None and not any(n.skip for n in stack):
            marked.append(node)
        elif skip and tag not in NOT_TEXT and tag != "header" and says.isdisjoint(NEVER_CONTENT):
            doubtful.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if tag == "textarea" or tag == "title":
                node.kids.append(page[at : end.start() if end else len(page)])
            at = end.end() if end else len(page)
        elif tag not in VOID and not m[0].endswith("/>"):
            n_open[tag] += 1
            if len(stack) < DEPTH:
                stack.append(node)
                top = node
            else:
                deep.append(node)
                if skip and hidden is None:
                    top, hidden = node, len(deep) - 1
    if at < len(page):
        top.kids.append(page[at:])
    if doubtful and not any(map(amount, marked)):
        for node in doubtful:
            node.skip = False
        total = amount(root)
        most = [n for n in doubtful if 2 * amount(n) > total]
        for node in doubtful:
            node.skip = node not in most
    return root


def blocks(node: Node, drop: set[int] = frozenset(), out: list[list[str]] | None = None) -> list[list[str]]:
    """Pieces of text of each block below a node, in page order."""
    out = [[]] if out is None else out
    for kid in node.kids:
        if isinstance(kid, str):
            out[-1].append(kid)
        elif kid.tag == "br":
            out[-1].append(" ")
        elif not kid.skip and id(kid) not in drop:
            if kid.tag in BLOCK:
                out.append([])
                blocks(kid, drop, out)
                out.append([])
            else:
                blocks(kid, drop, out)
    return out


def clean(pieces: list[str]) -> str:
    return SPACE.sub(" ", entities.unescape("".join(pieces))).strip()


def text_of(nodes: list[Node], drop: set[int] = frozenset()) -> str:
    return "\n\n".join(t for n in nodes if id(n) not in drop for p in blocks(n, drop) if (t := clean(p)))


def amount(node: Node, links: bool = False) -> int:
    """Characters of text below a node that may be content, outside links (but with those of the title)."""
    if node.skip or node.tag == "a" and not links:
        return 0
    links = links or node.tag == "h1"
    return sum(len(k.strip()) if isinstance(k, str) else amount(k, links) for k in node.kids)


def amounts(node: Node, links: bool = False, out: dict[int, int] | None = None) -> dict[int, int]:
    """amount() of a node and of those below it, by id."""
    out = {} if out is None else out
    if node.skip or node.tag == "a" and not links:
        out[id(node)] = 0
        return out
    links, total = links or node.tag == "h1", 0
    for k in node.kids:
        if isinstance(k, str):
            total += len(k.strip())
        else:
            amounts(k, links, out)
            total += out[id(k)]
    out[id(node)] = total
    return out


def holds_marked(node: Node) -> bool:
    return not node.skip and (node.tag in MARKED or any(holds_marked(k) for k in node.kids if isinstance(k, Node)))


def own_content(root: Node) -> Node:
    """Down from the root while one container child holds all text, or most of it and the only article or main; no further than that."""
    held = amounts(root)
    while root.tag not in MARKED:
        total = held[id(root)]
        kids = [k for k in root.kids if isinstance(k, Node)]
        best = max((k for k in kids if k.tag in CONTAINER), key=lambda k: held[id(k)], default=None)
        if best is None or held[id(best)] < 0.7 * total or not total:
            break
        if held[id(best)] < total and [k for k in kids if holds_marked(k)] != [best]:
            break
        root = best
    return root


class Slot:
    """A place in a collapsed tree: equal neighbours are one slot, which holds all of them."""

    __slots__ = ("sign", "nodes", "kids", "skip")

    def __init__(self, sign: str, nodes: list[Node]):
        self.sign, self.nodes = sign, nodes
        self.skip = bool(nodes) and nodes[0].skip
        self.kids: list[Slot] = []
        for n in nodes:
            for k in n.kids if not n.skip else ():
                if isinstance(k, Node) and k.tag in BLOCK:
                    if self.kids and self.kids[-1].sign == k.sign:
                        self.kids[-1].nodes.append(k)
                    else:
                        self.kids.append(Slot.__new__(Slot))
                        self.kids[-1].sign, self.kids[-1].nodes = k.sign, [k]
        for k in self.kids:
            k.__init__(k.sign, k.nodes)


def skeleton(slot: Slot) -> list:
    return [slot.sign, [skeleton(k) for k in slot.kids]]


def size(reference: list) -> int:
    return 1 + sum(map(size, reference[1]))


def tag_of(reference: list) -> str:
    return reference[0].split(".")[0]


def leads_to_marked(reference: list) -> bool:
    return tag_of(reference) in MARKED or any(map(leads_to_marked, reference[1]))


def match(slot: Slot, reference: list, index: int, most: int = 250_000) -> tuple[int, list[tuple[Slot, int]]]:
    """Simple tree matching: size of the largest matching and its pairs (slot, preorder index in the reference).

    Two lists of children with over `most` pairs are matched in order instead, each child with the next of its sign."""
    if slot.sign != reference[0]:
        return 0, []
    kids, others = slot.kids, reference[1]
    at = [index + 1]
    for o in others[:-1]:
        at.append(at[-1] + size(o))
    if len(kids) * len(others) > most:
        places: dict[str, list[int]] = {}
        for j, o in enumerate(others):
            places.setdefault(o[0], []).append(j)
        pairs, total, after = [(slot, index)], 1, 0
        for k in kids:
            own = places.get(k.sign, [])
            if (p := bisect_left(own, after)) < len(own):
                n, got = match(k, others[own[p]], at[own[p]])
                pairs += got
                total, after = total + n, own[p] + 1
        return total, pairs
    best = [[(0, None)] * (len(others) + 1) for _ in range(len(kids) + 1)]
    for i, k in enumerate(kids, 1):
        for j, o in enumerate(others, 1):
            here = max(best[i - 1][j], best[i][j - 1], key=lambda x: x[0])
            if k.sign == o[0]:
                n, pairs = match(k, o, at[j - 1])
                if best[i - 1][j - 1][0] + n > here[0]:
                    here = (best[i - 1][j - 1][0] + n, (best[i - 1][j - 1], pairs))
            best[i][j] = here
    pairs, cell = [(slot, index)], best[-1][-1]
    while cell[1] is not None:
        pairs += cell[1][1]
        cell = cell[1][0]
    return 1 + best[-1][-1][0], pairs


def joined(pages: DataFrame, by_host: DataFrame, column: str, max_shipped: int) -> tuple[DataFrame, dict[str, str] | None]:
    """The pages with their host's row; or, while all rows are small, the pages alone and the rows to ship."""
    total = by_host.agg(F.sum(F.length(column) + F.length("host"))).first()[0] or 0
    if total <= max_shipped:
        return pages.withColumn(column, F.lit(None).cast("string")), {r[0]: r[1] for r in by_host.select("host", column).collect()}
    return pages.join(by_host, "host", "left"), None


def host_column() -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def learn_wrappers(pages: DataFrame, max_shipped: int, least_pages: int) -> DataFrame:
    """host, wrapper: a JSON list of the reference tree, the index of the content node and those of template nodes."""
    order = F.struct(F.xxhash64("url", "page_id", "html"), F.col("page_id"))
    chosen = pages.where("html IS NOT NULL").groupBy("host").agg(F.min_by("html", order).alias("html"))

    def refer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            trees = [json.dumps(skeleton(Slot("html", [parse(h)])), separators=(",", ":")) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"host": batch.column(0), "reference": pa.array(trees, pa.string())})

    references = materialize(chosen.select("host", "html").mapInArrow(refer, "host string, reference string"), "references")
    rows, shipped = joined(pages, references, "reference", max_shipped)

    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[str, list] = {}
        seen: dict[tuple[str, int], list[int]] = {}

        def out() -> pa.RecordBatch:
            keys = list(seen)
            cells = [[k[0] for k in keys], [k[1] for k in keys], *([seen[k][c] for k in keys] for c in range(4))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.string(), *[pa.int64()] * 5))], ["host", "slot", "pages", "low", "high", "chars"])

        for batch in sliced(batches):
            for host, page, reference in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), batch.column("reference").to_pylist()):
                reference = shipped.get(host) if shipped is not None else reference
                if not page or reference is None:
                    continue
                if reference not in trees:
                    if len(trees) > 1000:
                        trees.clear()
                    trees[reference] = json.loads(reference)
                for slot, index in match(Slot("html", [parse(page)]), trees[reference], 0)[1]:
                    text = text_of(slot.nodes) if not slot.skip else ""
                    h = xxhash.xxh3_64_intdigest(text) >> 1
                    x = seen.setdefault((host, index), [0, h, h, 0])
                    seen[host, index] = [x[0] + 1, min(x[1], h), max(x[2], h), x[3] + sum(map(amount, slot.nodes))]
            if len(seen) > 200_000:
                yield out()
                seen.clear()
        yield out()

    slots = rows.select("host", "html", "reference").mapInArrow(observe, "host string, slot long, pages long, low long, high long, chars long")
    slots = slots.groupBy("host", "slot").agg(F.sum("pages").alias("pages"), (F.min("low") == F.max("high")).alias("constant"), F.sum("chars").alias("chars"))
    slots = slots.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("slot", "pages", "constant", "chars"))).alias("slots"))  # at most a reference's nodes

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            wrappers = []
            for reference, slots in zip(batch.column("reference").to_pylist(), batch.column("slots").to_pylist()):
                tree, held = json.loads(reference), {s["slot"]: s for s in slots}
                chars = lambda i: held[i]["chars"] if i in held else 0
                same = lambda i: held[i]["constant"] and held[i]["pages"] >= least_pages if i in held else False
                node, at = tree, 0
                while tag_of(node) not in MARKED:
                    index, best, marked, template = at + 1, None, [], []
                    for kid in node[1]:
                        if tag_of(kid) in CONTAINER and (best is None or chars(index) > chars(best[1])):
                            best = (kid, index)
                        if leads_to_marked(kid):
                            marked.append(index)
                        if same(index):
                            template.append(index)
                        index += size(kid)
                    if best is None or not chars(at) or chars(best[1]) < 0.7 * chars(at):
                        break
                    others = chars(at) - chars(best[1]) - sum(chars(i) for i in template if i != best[1])
                    if others > 0 and marked != [best[1]]:
                        break
                    node, at = best
                varies = at in held and not held[at]["constant"]
                template = [s["slot"] for s in slots if varies and same(s["slot"]) and at < s["slot"] < at + size(node)]
                wrappers.append(json.dumps([tree, at, template], separators=(",", ":")))
            yield pa.RecordBatch.from_pydict({"host": batch.column("host"), "wrapper": pa.array(wrappers, pa.string())})

    return materialize(slots.join(references, "host").mapInArrow(decide, "host string, wrapper string"), "wrappers")


def extract(page: str | None, wrapper: list | None) -> str:
    """Main text of one page."""
    if not page:
        return ""
    root = parse(page)
    if wrapper is not None:
        tree, at, template = wrapper
        found, drop, template = [], set(), set(template)
        for slot, index in match(Slot("html", [root]), tree, 0)[1]:
            if index == at:
                found += slot.nodes
            elif index in template:
                drop.update(map(id, slot.nodes))
        if text := text_of(found, drop):
            return text
    return text_of([own_content(root)])


def main_text(pages: DataFrame, max_shipped: int = 16_000_000, least_pages: int = 5) -> DataFrame:
    """page_id, url, text and n_chars of each row of (page_id, url, html)."""
    pages = pages.select("page_id", "url", "html").withColumn("host", host_column())
    rows, shipped = joined(pages, learn_wrappers(pages, max_shipped, least_pages), "wrapper", max_shipped)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        for batch in sliced(batches):
            texts = []
            for host, page, wrapper in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), batch.column("wrapper").to_pylist()):
                wrapper = shipped.get(host) if shipped is not None else wrapper
                if wrapper is not None and wrapper not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[wrapper] = json.loads(wrapper)
                texts.append(extract(page, known.get(wrapper)))
            yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.select("page_id", "url", "host", "html", "wrapper").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op9_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
