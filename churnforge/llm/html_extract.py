"""Op 6: main-text extraction by wrapper induction.

Pages of one host and layout (the set of element paths near the root) share a
wrapper, and every page takes part in it. Each page's tree is aligned by simple
tree matching with a reference page of its kind (the text of lowest hash), which
only names the places: how often a node's text occurs at a place is counted over
all distinct texts of the kind. A node whose text nearly all of at least
``min_texts`` texts hold is constant, its blocks are template; a node's text
varies as far as it differs from most others. From the root the content slot
descends to the element that holds nearly all varying text (that of elements
named like furniture counts for a quarter, reader comments not at all).

A page's text is that of its content slot without template blocks. Blocks that
make up over four fifths of what a page has in its slot are its own text (of near copies)
and stay. Element names decide what is no text at all (menus, forms, scripts,
asides, footers) and, only where no wrapper is known or the page lacks its
slot, where the content lies: all article elements, unless the main element
holds over twice their text, else the main element, else the whole page. Class
and id names prove nothing: an element named like furniture goes only if all
elements of its path hold less than a quarter of the text.

Pages are parsed once for their layout and written with it. Counts are
aggregated before the shuffle; references and wrappers are written tables with a
row for a host and layout, joined by the planner's choice. Edge cases: a null or
empty page, or one of furniture only, gives the empty text; a page without a
host has no wrapper, nor has a layout with fewer than three distinct texts, so
copies of one page do not turn its article into template; equal pages give
equal texts; an empty table gives an empty one. Only id, URL and HTML are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnforge.llm.common import materialise, text_slices
from churnforge.llm.html_tree import Node, Page, match_trees
from churnforge.llm.url_filter import url_host
from churnforge.session import map_in_arrow, ship_package


def block_key(path: str, text: str) -> int:
    """Signed 64-bit key of a text at a place."""
    return xxhash.xxh64_intdigest(f"{path}\n{text}") - (1 << 63)


def in_page_order(root: Node) -> list[Node]:
    nodes, todo = [], [root]
    while todo:
        nodes.append(n := todo.pop())
        todo += reversed(n.kids)
    return nodes


class Reference:
    """A page that names the places of other pages' nodes. What is matched
    follows from the elements alone, so pages of equal trees are matched once."""

    def __init__(self, source: str):
        self.root = Page(source).root
        self.number = {id(n): k for k, n in enumerate(in_page_order(self.root))}
        self.known: dict[bytes, list[int]] = {}
        self.held = 0

    def places(self, page: Page) -> dict[int, int]:
        """Number of the reference's node matched with a node, by the node's id; -1 without one."""
        nodes = in_page_order(page.root)
        tree = xxhash.xxh3_128_digest("\n".join([f"{n.depth}{n.path[len(n.parent.path):] if n.parent else ''}" for n in nodes]))
        if tree not in self.known:
            if self.held + len(nodes) > 100_000:
                self.known, self.held = {}, 0
            matched = {id(x): self.number[id(y)] for x, y in match_trees(page.root, self.root)}
            self.known[tree] = [matched.get(id(n), -1) for n in nodes]
            self.held += len(nodes)
        return {id(n): at for n, at in zip(nodes, self.known[tree])}


def placed_blocks(page: Page, places: dict[int, int]) -> list[tuple[int, int, str, bool, int, int]]:
    """(node, block, path, away, hint, size) of a page's blocks: node is a key of a
    node's place and whole text, hint how far its text may count as content (a
    name like furniture is a hint), size the characters of equal ones."""
    sizes: Counter[tuple] = Counter()
    for x in {id(n): n for n, _ in page.blocks}.values():
        hint = 0 if x.away or x.comments else 1 if x.named is not None else 4
        node = block_key(f"{x.path}\n{places[id(x)]}\n{x.away}{hint}", "\n".join(x.blocks))
        for t in x.blocks:
            sizes[node, block_key(x.path, t), x.path, x.away, hint] += len(t)
    return [(*row, size) for row, size in sorted(sizes.items())]


def content_slot(varying: dict[str, tuple[int, int]], share: float, root: str = "#") -> str | None:
    """Path of the content slot from (varying text below a path, in its own blocks)."""
    if root not in varying:
        return None
    slot = root
    while True:
        below = [p for p in varying if p.rpartition(">")[0] == slot]
        # ties by name, so that every run induces the same wrapper
        best = min(below, key=lambda p: (-varying[p][0], p), default=None)
        # an element that is mostly text itself is a paragraph of the slot
        if best is None or varying[best][0] < share * varying[slot][0] or 2 * varying[best][1] > varying[best][0]:
            return slot
        slot = best


def induce_wrapper(sources: list[str], min_pages: int = 3, agree: float = 0.8, share: float = 0.8) -> tuple[list[int], str | None]:
    """(keys of constant blocks, path of the content slot) of pages of one kind:
    :func:`induce_wrappers` of a list."""
    sources = list(dict.fromkeys(s for s in sources if s))
    if len(sources) < min_pages:
        return [], None
    reference, seen, size = Reference(sources[0]), Counter(), Counter()
    for page in map(Page, sources):
        for *row, n in placed_blocks(page, reference.places(page)):
            seen[tuple(row)] += 1
            size[tuple(row)] += n
    others, keys, varying = len(sources) - 1, set(), {}
    for row, n in seen.items():
        _, block, path, _, hint = row
        if n - 1 >= agree * others:
            keys.add(block)
        if weight := hint * size[row] * max(0, others - 2 * (n - 1)):     # what half of the pages share does not vary
            steps = path.split(">")
            for k in range(1, len(steps) + 1):
                below, own = varying.get(p := ">".join(steps[:k]), (0, 0))
                varying[p] = below + weight, own + (weight if k == len(steps) else 0)
    return sorted(keys), content_slot(varying, share)


def layout_of(page: Page, depth: int = 3) -> int:
    """Signed 64-bit key of the element paths near the root."""
    paths, todo = set(), [page.root]
    while todo:
        node = todo.pop()
        paths.add(node.path)
        if node.depth < depth:
            todo += node.kids
    return xxhash.xxh64_intdigest("\n".join(sorted(paths))) - (1 << 63)


def _size(blocks: list[tuple[Node, str]]) -> int:
    return sum(len(t) for _, t in blocks)


def _by_names(own: list[tuple[Node, str]]) -> list[tuple[Node, str]]:
    """Where element names say that the content lies."""
    articles = [(n, t) for n, t in own if n.article is not None]
    main = [(n, t) for n, t in own if n.main is not None]
    if articles and 2 * _size(articles) >= _size(main):
        return articles
    return main or own


def _without_named(blocks: list[tuple[Node, str]], share: float = 0.25) -> list[tuple[Node, str]]:
    """Elements named like furniture go where they are a small part; reader
    comments unless there is hardly anything else."""
    total, named = _size(blocks), Counter()
    for n, t in blocks:
        if n.named is not None:
            named[n.named.path] += len(t)
    return [(n, t) for n, t in blocks
            if (n.named is None or named[n.named.path] >= share * total) and not (n.comments and named[n.named.path] < 0.9 * total)]


def main_text(source: str, template: frozenset[int] | set[int] = frozenset(), slot: str | None = None) -> str:
    """Main text of one page, blocks joined by one space."""
    own = [(n, t) for n, t in Page(source).blocks if not n.away]
    content = [] if slot is None else [(n, t) for n, t in own if n.path == slot or n.path.startswith(slot + ">")]
    content = content or _by_names(own)
    rest = [(n, t) for n, t in content if not (template and block_key(n.path, t) in template)]
    # what template blocks mostly consist of is a near copy's own text
    content = rest if 5 * _size(rest) >= _size(content) else content
    return " ".join(t for _, t in _without_named(content))


def with_layout(pages: DataFrame) -> DataFrame:
    """Rows of (id, url, host, html) with the keys of the page's layout and of
    its whole text; null without a host."""
    schema = T.StructType([*pages.schema.fields, T.StructField("layout", T.LongType()), T.StructField("text", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sources in text_slices(batches, 3):
            layouts, texts = [], []
            for source, host in zip(sources, batch.column(2).to_pylist()):
                page = Page(source) if host else None
                layouts.append(layout_of(page) if host else None)
                keys = list(dict.fromkeys(block_key(n.path, t) for n, t in page.blocks)) if host else None
                texts.append(xxhash.xxh64_intdigest(repr(keys)) - (1 << 63) if host else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(layouts, pa.int64()), pa.array(texts, pa.int64())],
                                             names=schema.names)

    return map_in_arrow(pages, run, schema)


KIND = ["host", "layout"]


def _same_kind(left: str, right: str):
    return [F.col(f"{left}{k}") == F.col(f"{right}{k}") for k in KIND]


def _other_names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({k: f"_{k}" for k in KIND})


def reference_pages(laid: DataFrame, min_pages: int) -> DataFrame:
    """(host, layout, n, reference): the distinct texts of a kind, if ``min_pages``
    or more, and the page that names its places."""
    own = laid.where("layout is not null").select(*KIND, "text", "html")
    texts = own.groupBy(*KIND, "text").agg(F.min(F.xxhash64("html")).alias("page"))
    kinds = texts.groupBy(*KIND).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("text", "page")).alias("low"))
    kinds = materialise(kinds.where(F.col("n") >= min_pages).select(*KIND, "n", "low.*").withColumnsRenamed(
        {"text": "_text"}), "html-kinds")
    met = own.join(_other_names(kinds), [*_same_kind("", "_"), F.col("text") == F.col("_text"), F.xxhash64("html") == F.col("page")])
    return met.groupBy(*KIND).agg(F.first("n").alias("n"), F.min("html").alias("reference"))


_BLOCKS = "array<struct<node:bigint,block:bigint,path:string,away:boolean,hint:int,size:bigint>>"


def aligned_texts(laid: DataFrame, references: DataFrame) -> DataFrame:
    """(host, layout, text, blocks) of each distinct text of the kinds that have a
    reference: its blocks at their places."""
    kinds = _other_names(references.select(*KIND, "reference"))
    given = laid.join(kinds, _same_kind("", "_")).select(*KIND, "text", "html", "reference")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Reference] = {}
        types = {"node": pa.int64(), "block": pa.int64(), "path": pa.string(), "away": pa.bool_(), "hint": pa.int32(), "size": pa.int64()}
        for batch, sources in text_slices(batches, 3):
            rows, ends = [], [0]
            for source, other in zip(sources, batch.column(4).to_pylist()):
                if other not in known:
                    if len(known) > 100:
                        known.clear()
                    known[other] = Reference(other or "")
                page = Page(source)
                rows += placed_blocks(page, known[other].places(page))
                ends.append(len(rows))
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types.values())]
            blocks = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, list(types)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], blocks], names=[*KIND, "text", "blocks"])

    aligned = map_in_arrow(given, run, f"host string, layout bigint, text bigint, blocks {_BLOCKS}")
    return aligned.groupBy(*KIND, "text").agg(F.min("blocks").alias("blocks"))


def content_slots(counts: DataFrame, share: float, levels: int = 32) -> DataFrame:
    """(host, layout, slot) from (host, layout, n, c, path, hint, size) of blocks.

    Sums below a path are made for ``levels`` levels at a time, so that deep
    pages do not multiply; where the slot is still at the last one, it goes on
    from there."""
    weight = F.col("hint") * F.col("size").cast("decimal(20,0)") * (F.col("n") - 1 - 2 * (F.col("c") - 1))
    own = materialise(counts.where("hint > 0 and n - 1 > 2 * (c - 1)").groupBy(*KIND, "path").agg(
        F.sum(weight).cast("decimal(38,0)").alias("own")), "html-own")
    rest, first, done = own.withColumn("root", F.lit("#")), 1, None
    while True:
        last, size = first + levels, F.size(F.split("path", ">"))
        above = F.transform(F.sequence(F.lit(first), F.least(size, F.lit(last))), lambda k: F.struct(
            F.call_function("substring_index", F.col("path"), F.lit(">"), k).alias("path"), F.when(k == size, F.col("own")).otherwise(0).alias("own"),
            F.col("own").alias("below")))
        sums = materialise(rest.select(*KIND, "root", F.inline(above)).groupBy(*KIND, "root", "path").agg(
            F.sum("below").cast("double").alias("below"), F.sum("own").cast("double").alias("own")), "html-varying")
        # a step leaves ``share`` of the text at least, so a kind's group is bounded by its depth and not by its pages
        total = _other_names(sums.where("path = root").select(*KIND, F.col("below").alias("total")))
        least = F.col("total") * F.pow(F.lit(share), F.size(F.split("path", ">")) - first) * 0.999
        heavy = sums.join(total, _same_kind("", "_")).where(F.col("below") >= least).select(*KIND, "root", "path", "below", "own")

        def descend(group: pd.DataFrame) -> pd.DataFrame:
            varying = {p: (below, own) for p, below, own in zip(group["path"], group["below"], group["own"])}
            return pd.DataFrame({"host": [group["host"].iloc[0]], "layout": [group["layout"].iloc[0]],
                                 "slot": [content_slot(varying, share, group["root"].iloc[0])]})

        slots = materialise(heavy.groupBy(*KIND).applyInPandas(descend, "host string, layout bigint, slot string"), "html-slots")
        deep = F.size(F.split("slot", ">")) == last
        done = slots.where(~deep) if done is None else done.unionByName(slots.where(~deep))
        below = own.join(_other_names(slots.where(deep)), _same_kind("", "_")).where(
            (F.col("path") == F.col("slot")) | F.col("path").startswith(F.concat("slot", F.lit(">"))))
        if slots.where(deep).isEmpty():
            return done
        rest, first = below.select(*KIND, "path", "own", F.col("slot").alias("root")), last


def induce_wrappers(laid: DataFrame, min_pages: int = 3, min_texts: int = 5, agree: float = 0.8,
                    share: float = 0.8) -> DataFrame:
    """(host, layout, template array<bigint>, slot) per kind of page, from counts
    over all its distinct texts."""
    ship_package(laid.sparkSession)
    references = materialise(reference_pages(laid, min_pages), "html-references")
    rows = aligned_texts(laid, references).select(*KIND, F.inline("blocks"))
    seen = rows.groupBy(*KIND, "node", "block", "path", "away", "hint").agg(
        F.count(F.lit(1)).alias("c"), F.sum("size").alias("size"))
    counts = materialise(seen.join(_other_names(references.select(*KIND, "n")), _same_kind("", "_")).select(
        *KIND, "n", "c", "block", "path", "away", "hint", "size"), "html-counts")
    constant = counts.where((F.col("n") >= min_texts) & ~F.col("away") & (F.col("c") - 1 >= agree * (F.col("n") - 1)))
    template = constant.groupBy(*KIND).agg(F.sort_array(F.collect_set("block")).alias("template"))
    slots = _other_names(content_slots(counts, share))
    return materialise(template.join(slots, _same_kind("", "_"), "full").select(
        *[F.coalesce(k, f"_{k}").alias(k) for k in KIND], "template", "slot"), "html-wrappers")


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
                      ) -> DataFrame:
    """(id, url, text) per row of pages."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    given = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), url_host(url).alias("host"), F.col(html_col).alias("html"))
    laid = materialise(with_layout(given), "html-pages", "zstd")
    wrappers = _other_names(induce_wrappers(laid))
    joined = laid.join(wrappers, _same_kind("", "_"), "left").select("id", "url", "html", "template", "slot")
    schema = T.StructType([T.StructField(id_col, given.schema["id"].dataType), T.StructField(url_col, given.schema["url"].dataType),
                           T.StructField("text", T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, ...], frozenset[int]] = {}
        for batch, sources in text_slices(batches, 2):
            texts = []
            for source, template, slot in zip(sources, batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                keys = tuple(template or ())
                if keys not in known:
                    if len(known) > 100:
                        known.clear()
                    known[keys] = frozenset(keys)
                texts.append(main_text(source, known[keys], slot))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())],
                                             names=schema.names)

    return map_in_arrow(joined, run, schema)
