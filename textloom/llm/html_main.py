"""Main text of web pages by wrapper induction.

Pages of a host come from templates. Every page is parsed to a DOM tree and aligned with its host's page of median length by simple
tree matching; what that finds is counted over all different pages of the host. Aligned nodes with the same text everywhere are
template; those whose text varies are slots. The wrapper keeps the path of the element that holds most of what varies on all pages, and
the template's texts. Then elements that by their tag, role or class can't be main text are cut off each page, and the blocks
under the wrapper's path are returned but for template nodes. What the alignment can't reach is counted too: blocks that stand on every
page of a host's layout are template. Within an article that a page declares only these go. A page whose host has
too few pages to compare falls back on its own structure.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, small_batches

#: Bytes that are broadcast to a join at most, or to Python.
BROADCAST_BYTES, HELD_BYTES = 16 << 20, 4 << 20
#: What a Python worker keeps at most: characters of parsed references, nodes of pages' shapes, counts of pairs of shapes, sets of marks.
KEPT_CHARS, KEPT_NODES, KEPT_COUNTS, KEPT_SETS = 2 << 20, 500_000, 200_000, 1000
#: Children up to which pairs are counted one by one, which is faster for few.
FEW = 24
#: Different pages of a layout that a block must be the same on, on all of them, to be template.
DIFFERENT = 4
LAYOUT = frozenset("html body div main section article table center".split())
#: Elements by tag, role and words of class or id.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
JUNK = frozenset("head script style noscript template nav footer aside form iframe svg math object button select textarea dialog canvas audio video".split())
JUNK_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alertdialog form alert".split())
JUNK_WORDS = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer header masthead menu nav navbar navigation newsletter notice notices overlay pagination popup promo promoted related replies share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
BLOCKS = frozenset("address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
#: What an opening tag closes, up to the elements named after it.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ENDS_P = BLOCKS - {"body", "html", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"} | {"form", "nav", "aside", "footer", "main"}


class Node:
    __slots__ = ("tag", "key", "items", "junk")

    def __init__(self, tag: str, key: str, junk: bool):
        self.tag, self.key, self.items, self.junk = tag, key, [], junk  # items: nodes and strings in page order


def _key(tag: str, attrs: dict[str, str | None]) -> tuple[str, bool]:
    """A node's label for alignment, and whether it is cut off."""
    names = f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower().split()
    role = (attrs.get("role") or "").lower()
    style = re.sub(r"\s+", "", attrs.get("style") or "").lower()
    junk = tag in JUNK or role in JUNK_ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in style
    junk = junk or tag not in ("html", "body", "article", "main") and any(w in JUNK_WORDS for n in names for w in (n, *re.split(r"[-_]+", n)))
    junk = junk or tag == "article" and any(w in ("comment", "comments", "reply") for n in names for w in re.split(r"[-_]+", n))
    return ".".join([tag, *sorted(re.sub(r"\d+", "0", n) for n in names)]), junk


class _Builder(HTMLParser):
    """A forgiving tree builder: void elements, implied ends of p, li, td and the like, stray end tags."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", "#root", False)
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body") and any(n.tag == tag for n in self.stack):
            return
        if tag == "body" and any(n.tag == "head" for n in self.stack):
            self._pop("head")
        if tag in ENDS_P and any(n.tag == "p" for n in self.stack):
            for n in reversed(self.stack):
                if n.tag == "p":
                    self._pop("p")
                    break
                if n.tag in BLOCKS or n.tag in JUNK:
                    break
        if tag in CLOSES:
            ends, stops = CLOSES[tag]
            for n in reversed(self.stack):
                if n.tag in stops:
                    break
                if n.tag in ends:
                    self._pop(n.tag)
                    break
        key, junk = _key(tag, dict(attrs))
        # A header is part of an article if it stands in one.
        junk = junk or tag == "header" and not any(n.tag in ("article", "main") for n in self.stack)
        node = Node(tag, key, junk)
        self.stack[-1].items.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack[-1].tag == tag and tag in ("svg", "path", "iframe"):
            self.stack.pop()

    def handle_endtag(self, tag):
        if tag == "p" and not any(n.tag == "p" for n in self.stack):
            return
        if tag in VOID or not any(n.tag == tag for n in self.stack):
            return
        if tag not in BLOCKS and tag not in JUNK:
            # An inline end doesn't reach beyond the block it stands in.
            for n in reversed(self.stack):
                if n.tag == tag:
                    break
                if n.tag in BLOCKS:
                    return
        self._pop(tag)

    def _pop(self, tag: str) -> None:
        while len(self.stack) > 1:
            if self.stack.pop().tag == tag:
                return

    def handle_data(self, data):
        self.stack[-1].items.append(data)


def parse(html: str | None) -> Node:
    b = _Builder()
    if html:
        b.feed(html)
        b.close()
    return b.root


def walk(root: Node) -> Iterator[tuple[Node, str]]:
    """Nodes that aren't cut off, in page order, with their paths; without recursion, so that deep pages do no harm."""
    stack = [(root, "")]
    while stack:
        node, path = stack.pop()
        yield node, path
        stack.extend((n, below(path, n.key)) for n in reversed(node.items) if isinstance(n, Node) and not n.junk)


def own_text(node: Node) -> str:
    return " ".join(" ".join(x for x in node.items if isinstance(x, str)).split())


def below(path: str, key: str) -> str:
    """The path of a child. A long one goes on from its hash, so that deep nodes have paths of their own."""
    path = f"{path}/{key}"
    return path if len(path) < 500 else f"/{hashlib.blake2b(path.encode('utf-8', 'surrogatepass'), digest_size=16).hexdigest()}"


class Shapes:
    """Trees without their texts as numbers: subtrees of equal labels have one number, and pairs of them are matched once."""

    def __init__(self) -> None:
        self.known: dict[tuple, int] = {}
        self.keys: list[str] = []
        self.kids: list[tuple[int, ...]] = []
        self.sizes: list[int] = []
        self.counts: dict[tuple[int, int], int] = {}
        self.nodes = 0

    def of(self, root: Node) -> dict[int, tuple[int, list[Node]]]:
        """Shape and children of each node that isn't cut off, by id of the node."""
        out: dict[int, tuple[int, list[Node]]] = {}
        for node, _ in reversed(list(walk(root))):
            kids = [n for n in node.items if isinstance(n, Node) and not n.junk]
            shape = node.key, tuple(out[id(n)][0] for n in kids)
            if (i := self.known.get(shape)) is None:
                i = self.known[shape] = len(self.keys)
                self.keys.append(shape[0])
                self.kids.append(shape[1])
                self.sizes.append(1 + sum(self.sizes[k] for k in shape[1]))
            out[id(node)] = i, kids
        self.nodes += len(out)
        return out

    def _weights(self, x: tuple[int, ...], y: tuple[int, ...]) -> Iterator:
        """Yields the pairs of shapes that have to be counted and is sent their counts; returns the most nodes that children x can pair with children y."""
        cols = {k: i for i, k in enumerate(dict.fromkeys(y))}
        labels: dict[str, list[int]] = {}
        for k in cols:
            labels.setdefault(self.keys[k], []).append(k)
        found = {}
        for k in dict.fromkeys(x):
            near, counts = labels.get(self.keys[k], ()), []
            for m in near:
                if k == m:
                    counts.append(self.sizes[k])
                elif not self.kids[k] or not self.kids[m]:
                    counts.append(1)
                else:
                    counts.append((yield k, m))
            found[k] = [cols[m] for m in near], counts
        return Weights([found[k] for k in x], [cols[k] for k in y], len(cols))

    def _count(self, a: int, b: int) -> Iterator:
        x, y = self.kids[a], self.kids[b]
        same = _same_end(x, y)
        n, x, y = 1 + sum(self.sizes[k] for k in x[len(x) - same :]), x[: len(x) - same], y[: len(y) - same]
        if x and y:
            n += (yield from self._weights(x, y)).most()
        return n

    def run(self, steps: Iterator):
        """What steps returns; the counts that it asks for are made by steps of their own, without recursion."""
        stack, answer = [(None, steps)], None
        while True:
            try:
                pair = stack[-1][1].send(answer)
            except StopIteration as end:
                pair, answer = stack.pop()[0], end.value
                if pair is None:
                    return answer
                if len(self.counts) >= KEPT_COUNTS:
                    self.counts.clear()
                self.counts[pair] = answer
                continue
            if (answer := self.counts.get(pair)) is None:
                stack.append((pair, self._count(*pair)))


def _same_end(x: tuple[int, ...], y: tuple[int, ...]) -> int:
    """How many shapes at the ends of x and y are equal: to pair these is never worse than another choice."""
    n = 0
    while n < min(len(x), len(y)) and x[-1 - n] == y[-1 - n]:
        n += 1
    return n


class Weights:
    """How many nodes each child of one node can pair with each of another's: for each of the first ones shapes of the others with equal labels, and counts."""

    def __init__(self, found: list[tuple[list[int], list[int]]], cols: list[int], shapes: int):
        self.found, self.cols, self.shapes = found, cols, shapes
        self.at: np.ndarray | None = None
        self.arrays: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def most(self) -> int:
        """The most nodes that can be paired in all."""
        if all(n == 1 for _, counts in self.found for n in counts):
            return self._common()
        if len(self.cols) > FEW:
            for row in self.rows():
                last = row
            return int(last[-1])
        last = [0] * (len(self.cols) + 1)
        for near, counts in self.found:
            w, row, before = dict(zip(near, counts, strict=True)), [0], 0
            for j, k in enumerate(self.cols):
                before = max(before, last[j + 1], last[j] + w.get(k, 0))
                row.append(before)
            last = row
        return last[-1]

    def _common(self) -> int:
        """The longest common subsequence, with a bit for each of the other's children."""
        bits: dict[int, int] = {}
        for j, k in enumerate(self.cols):
            bits[k] = bits.get(k, 0) | 1 << j
        every = (1 << len(self.cols)) - 1
        free, masks = every, {}
        for near, _ in self.found:
            if (mask := masks.get(id(near))) is None:
                mask = masks[id(near)] = sum(bits[k] for k in near)
            met = free & mask
            free = (free + met | free - met) & every
        return len(self.cols) - free.bit_count()

    def row(self, i: int) -> np.ndarray:
        if self.at is None:
            self.at = np.array(self.cols)
        near, counts = self.found[i]
        if (held := self.arrays.get(id(near))) is None:
            held = self.arrays[id(near)] = np.array(near, np.int64), np.array(counts, np.int64)
        w = np.zeros(self.shapes, np.int64)  # a pair of different labels counts 0, which is no better than none
        w[held[0]] = held[1]
        return w[self.at]

    def rows(self, start: int = 0, end: int | None = None, first: np.ndarray | None = None) -> Iterator[np.ndarray]:
        """The most nodes that the first start, start + 1, … children can pair with each number of the other's; first: those of start."""
        row = np.zeros(len(self.cols) + 1, np.int64) if first is None else first
        yield row
        for i in range(start, len(self.found) if end is None else end):
            now = row.copy()
            np.maximum(now[1:], row[:-1] + self.row(i), out=now[1:])
            row = np.maximum.accumulate(now)
            yield row

    def chosen(self) -> Iterator[tuple[int, int]]:
        """Places of the children that are paired, last ones first. Every step-th row is kept and those between are made again, so that many children take little memory."""
        i, j = len(self.found), len(self.cols)
        step, at = int(i**0.5) + 1, i
        kept = [row for k, row in enumerate(self.rows()) if k % step == 0]
        M: list[np.ndarray] = []
        while i and j:
            if i <= at:
                at = (i - 1) // step * step
                M = list(self.rows(at, i, kept[at // step]))
            now, up, w = M[i - at], M[i - 1 - at], self.row(i - 1)
            while j and not (w[j - 1] and now[j] == up[j - 1] + w[j - 1]) and now[j] != up[j]:
                j -= 1
            if j and w[j - 1] and now[j] == up[j - 1] + w[j - 1]:
                j -= 1
                yield i - 1, j
            i -= 1


def match(a: Node, b: Node, shapes: Shapes | None = None) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: the largest number of nodes that can be paired in order with equal labels, and the pairs. All children count, at any depth."""
    if a.key != b.key:
        return 0, []
    shapes = shapes or Shapes()
    own, other = shapes.of(a), shapes.of(b)
    pairs, stack = [], [(a, b)]
    while stack:
        pair = stack.pop()
        pairs.append(pair)
        (s, p), (t, q) = own[id(pair[0])], other[id(pair[1])]
        same = _same_end(shapes.kids[s], shapes.kids[t])
        stack.extend(zip(p[len(p) - same :], q[len(q) - same :], strict=True))
        x, y = shapes.kids[s][: len(p) - same], shapes.kids[t][: len(q) - same]
        if x and y:
            stack.extend((p[i], q[j]) for i, j in shapes.run(shapes._weights(x, y)).chosen())
    return len(pairs), pairs


def mark(path: str, text: str) -> str:
    return hashlib.blake2b(f"{path}\n{text}".encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def block_marks(tree: Node) -> dict[int, int]:
    """Marks, by id of the node, of blocks with text of their own: hashes of path and of all that stands in the block."""
    order = list(walk(tree))
    inside: dict[int, int] = {}
    marks: dict[int, int] = {}
    for node, path in reversed(order):  # what stands in a node comes before it
        own = own_text(node)
        parts = (f"t{' '.join(x.split())}" if isinstance(x, str) else f"n{inside[id(x)]}" for x in node.items if (x.strip() if isinstance(x, str) else not x.junk))
        inside[id(node)] = _hash("\n".join([node.key, *parts]))
        if own and node.tag in BLOCKS and node.tag not in ("html", "body", "article", "main"):
            marks[id(node)] = _hash(f"{path}\n{inside[id(node)]}")
    return marks


def layout(tree: Node) -> int:
    """A hash of the kinds of containers that stand high in the page, which pages of one template share."""
    kinds, level = set(), [(tree, "")]
    for _ in range(4):
        level = [(n, f"{p}/{n.key}") for node, p in level for n in node.items if isinstance(n, Node) and not n.junk]
        kinds.update(p for n, p in level if n.tag in LAYOUT)
    return _hash("\n".join(sorted(kinds)))


class Reference:
    """The page of a host that its others are aligned with: paths and texts of its nodes in page order."""

    def __init__(self, html: str, shapes: Shapes | None = None):
        self.root, self.shapes = parse(html), shapes or Shapes()
        order = list(walk(self.root))
        self.tags, self.paths, self.texts = [n.tag for n, _ in order], [p for _, p in order], [own_text(n) for n, _ in order]
        self.at = {id(n): i for i, (n, _) in enumerate(order)}
        self.up = [-1] * len(order)
        for i, (node, _) in enumerate(order):
            for n in node.items:
                if isinstance(n, Node) and not n.junk:
                    self.up[self.at[id(n)]] = i
        self.known: dict[tuple, list[int]] = {}  # pages' shapes, and where each of their nodes is aligned


def align(ref: Reference, tree: Node) -> list[int]:
    """For each node of ref that a page's tree has: its number << 33, whether the text is the same << 32, characters there or in nodes below that ref lacks."""
    nodes, shape, stack = [], [], [(tree, -1)]
    while stack:
        node, up = stack.pop()
        stack.extend((n, len(nodes)) for n in reversed(node.items) if isinstance(n, Node) and not n.junk)
        nodes.append(node)
        shape.append((up, node.key))
    key = tuple(shape)
    if (to := ref.known.get(key)) is None:
        pairs = {id(b): ref.at[id(a)] for a, b in match(ref.root, tree, ref.shapes)[1]}
        to = ref.known[key] = [pairs.get(id(n), -1) for n in nodes]
    at, same, chars = [], {}, {}
    for (up, _), node, mine in zip(shape, nodes, to, strict=True):
        text = own_text(node)
        if mine >= 0:
            same[mine] = text == ref.texts[mine]
        else:
            mine = at[up]  # roots are always aligned
        at.append(mine)
        chars[mine] = chars.get(mine, 0) + len(text)
    return [i << 33 | same[i] << 32 | n for i, n in chars.items()]


def learn(reference: str, counts: list[list[int]]) -> dict:
    """The wrapper of a host: root, the path of the element with most of what varies, and template, marks of constant nodes.

    counts has number, different pages that are aligned, those with the same text, and characters, of each node of the reference.
    """
    ref = Reference(reference)
    others = max((n for i, n, _, _ in counts if i == 0), default=1) - 1  # every page's root is aligned
    if others < 1:
        return {"root": None, "template": []}
    template, held = [], [0] * len(ref.paths)
    for i, n, same, chars in sorted(counts):
        path, text = ref.paths[i], ref.texts[i]
        # A node of all but a few pages with the same text in all of them is template; two pages alone may be copies.
        if text and others >= 2 and n - 1 >= max(2, 0.6 * others) and same == n:
            template.append(mark(path, text))
            chars -= n * len(text)
        held[i] += chars
    for i in range(len(held) - 1, 0, -1):  # what stands in a node comes after it
        held[ref.up[i]] += held[i]
    # What paths hold, by the path above, and their tags.
    mass: dict[str, dict[str, int]] = {}
    tags = dict(zip(ref.paths, ref.tags, strict=True))
    for i in range(1, len(held)):
        if held[i]:
            parts = mass.setdefault(ref.paths[ref.up[i]], {})
            parts[ref.paths[i]] = parts.get(ref.paths[i], 0) + held[i]
    root, whole = "", sum(mass.get("", {}).values())
    while True:
        parts = mass.get(root, {})
        top = max(parts, key=parts.get, default=None)
        tag = tags.get(top, "")
        if top is None or parts[top] < 0.6 * whole or tag in ("p", "li", "td", "h1", "h2", "h3", "span", "b", "a"):
            break
        root = top
        if tag in ("article", "main"):
            break
    return {"root": root or None, "template": template}


def main_text(html: str | None, wrapper: dict | None = None, constant: frozenset[int] = frozenset()) -> str:
    """Blocks of the main text, white space collapsed, joined by newlines in page order. constant: marks of blocks that all pages of the layout have."""
    return tree_text(parse(html), wrapper, constant)


def tree_text(tree: Node, wrapper: dict | None, constant: frozenset[int]) -> str:
    order = list(walk(tree))
    named = [(n, p) for n, p in order if n.tag in ("article", "main")]
    roots = [(n, p) for n, p in order if wrapper and wrapper["root"] and p == wrapper["root"]]
    if named and not any(n.tag in ("article", "main") for n, _ in roots):
        roots = []
    if named:
        # All articles count, whatever ids and classes they have; of nested ones the outer.
        chosen = {id(n) for n, _ in roots} | {id(n) for n, _ in [x for x in named if x[0].tag == "article"] or ([] if roots else named)}
        if len(chosen) > 1:
            chosen -= {id(n) for x, _ in named if id(x) in chosen for n, _ in walk(x) if n is not x}
        roots = [(n, p) for n, p in order if id(n) in chosen]
    if not roots:
        roots = [(tree, "")]
    template = set() if any(n.tag in ("article", "main") for n, _ in roots) else set((wrapper or {}).get("template", ()))
    marks = block_marks(tree) if constant else {}
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        text = " ".join("".join(held).split())
        if text:
            out.append(text)
        held.clear()

    # Each step is a node to enter, a string, or a block that ends.
    stack: list = [(n, p) for n, p in reversed(roots)]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            held.append(x)
        else:
            node, path = x
            if node.junk and (node, path) not in roots:
                continue
            if node.tag == "br":
                held.append("\n")
                continue
            if template and own_text(node) and mark(path, own_text(node)) in template:
                continue
            if marks.get(id(node)) in constant:
                continue
            block = node.tag in BLOCKS
            if block:
                flush()
                stack.append(None)
            stack.extend(i if isinstance(i, str) else (i, below(path, i.key)) for i in reversed(node.items))
    flush()
    return "\n".join(out)


HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def _sent(df: DataFrame, size: str, most: int = BROADCAST_BYTES) -> DataFrame:
    """A saved table with the hint to broadcast it if its rows, of size bytes each, are few enough."""
    return F.broadcast(df) if df.agg(F.coalesce(F.sum(F.expr(size)), F.lit(0))).first()[0] <= most else df


def references(pages: DataFrame) -> DataFrame:
    """(host, reference): of each host's pages of median length, over all its pages, the one with the smallest hash."""
    rows = pages.select("host", F.length("html").alias("n"), F.xxhash64("html").alias("page"))
    middle = save(rows.groupBy("host").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY n)").cast("int").alias("n")), "page-lengths")
    middle = _sent(middle, "length(host) + 64")
    least = save(rows.join(middle, ["host", "n"]).groupBy("host").agg(F.min("page").alias("page")), "page-references")
    least = _sent(least, "length(host) + 64")
    same = pages.withColumn("page", F.xxhash64("html")).join(least, ["host", "page"])
    return save(same.groupBy("host").agg(F.min("html").alias("reference")), "references")


#: What is counted of a page.
SEEN = "struct<layout: long, marks: array<long>, aligned: array<long>>"


def _seen(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    held: dict[str, Reference] = {}
    shapes = Shapes()
    for html, reference in parts:
        rows = []
        for h, r in zip(html, reference, strict=True):
            if shapes.nodes > KEPT_NODES:
                held.clear()
                shapes = Shapes()
            if r not in held:
                if sum(map(len, held)) > KEPT_CHARS:
                    held.clear()
                held[r] = Reference(r, shapes)
            tree = parse(h)
            rows.append((layout(tree), sorted(set(block_marks(tree).values())), align(held[r], tree)))
        yield pd.DataFrame(rows, columns=["layout", "marks", "aligned"])


def _wrapper(reference: pd.Series, counts: pd.Series) -> pd.Series:
    return pd.Series([json.dumps(learn(r, [x.tolist() for x in c])) for r, c in zip(reference, counts, strict=True)], dtype=object)


def wrappers(seen: DataFrame, refs: DataFrame) -> DataFrame:
    """(host, wrapper) of each host from its reference and what is counted over all its different pages."""
    # Equal pages have equal counts.
    rows = seen.groupBy("host", "page").agg(F.first("aligned").alias("aligned")).select("host", F.explode("aligned").alias("a"))
    rows = rows.select("host", F.shiftright("a", 33).alias("i"), F.expr("shiftright(a, 32) & 1").alias("same"), F.expr(f"a & {(1 << 32) - 1}").alias("chars"))
    counts = rows.groupBy("host", "i").agg(F.count("*").alias("n"), F.sum("same").alias("same"), F.sum("chars").alias("chars"))
    counts = counts.groupBy("host").agg(F.collect_list(F.array("i", "n", "same", "chars")).alias("counts"))
    return save(refs.join(counts, "host").select("host", F.pandas_udf(_wrapper, "string")("reference", "counts").alias("wrapper")), "wrappers")


def _layout(html: pd.Series) -> pd.Series:
    return pd.Series([layout(parse(h)) for h in html], dtype="int64")


def constants(seen: DataFrame) -> DataFrame:
    """(host, layout, constant): the marks that all pages of a host's layout have, of layouts with DIFFERENT pages or more. Counted over every page."""
    every = seen.groupBy("host", "layout").agg(F.count("*").alias("n"), F.countDistinct("page").alias("different")).where(F.col("different") >= DIFFERENT)
    counts = seen.select("host", "layout", F.explode("marks").alias("mark")).groupBy("host", "layout", "mark").agg(F.count("*").alias("c"))
    # What is on all pages is no more than what is on one of them.
    found = counts.join(every.drop("different"), ["host", "layout"]).where("c = n")
    return save(found.groupBy("host", "layout").agg(F.array_sort(F.collect_list("mark")).alias("constant")), "page-constants")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html).

    Null html counts as empty and has an empty text; a null url or one without a host belongs to the host "". Repeated rows each
    give their row; an empty table gives none.
    """
    small_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1)).alias("host"))
    refs = references(rows)
    seen = rows.join(_sent(refs, "length(reference) + length(host) + 64"), "host").select("host", F.xxhash64("html").alias("page"), F.pandas_udf(_seen, SEEN)("html", "reference").alias("s"))
    seen = save(seen.select("host", "page", "s.*"), "page-marks")
    made, same = wrappers(seen, refs), constants(seen)
    rows = rows.join(_sent(made, "length(wrapper) + length(host) + 64"), "host", "left")
    few = same.agg(F.coalesce(F.sum(8 * F.size("constant") + F.length("host") + 64), F.lit(0))).first()[0] <= HELD_BYTES
    if few:
        held = pages.sparkSession.sparkContext.broadcast({(r.host, r.layout): np.array(r.constant, np.int64) for r in same.collect()})
        rows = rows.withColumn("constant", F.lit(None).cast("array<long>"))
    else:
        held = None
        rows = rows.withColumn("layout", F.pandas_udf(_layout, "long")("html")).join(_sent(same, "8 * size(constant) + length(host) + 64"), ["host", "layout"], "left")

    @F.pandas_udf("string")
    def text(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[str, dict] = {}
        sets: dict[tuple, frozenset[int]] = {}
        for part in parts:
            out = []
            for html, host, w, c in zip(*part, strict=True):
                if isinstance(w, str) and w not in known:
                    if len(known) >= KEPT_SETS:
                        known.clear()
                    known[w] = json.loads(w)
                tree = parse(html)
                if held is None:
                    constant = frozenset() if c is None else frozenset(c.tolist())
                elif (constant := sets.get(key := (host, layout(tree)))) is None:
                    if len(sets) >= KEPT_SETS:
                        sets.clear()
                    constant = sets[key] = frozenset(held.value.get(key, np.zeros(0, np.int64)).tolist())
                out.append(tree_text(tree, known.get(w), constant))
            yield pd.Series(out, dtype=object)

    return rows.select("page_id", "url", text("html", "host", "wrapper", "constant").alias("text")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
