"""Blocks inside blocks, to any depth: a page's nodes in reading order, with what stands below each of them.

A page is one group of one shuffle. Paths from the top are found by pointer doubling over the blocks that have children
(few beside their leaves), and ordering by path puts each block before all that it holds. A block that is not in the
table, or a circle of parents, cannot hold anything: what names it as parent stands at the top.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as t
from ..functions.geometry import block_ref

PAGE = ["doc_id", "page_id"]
IMAGES = ["Picture", "Figure"]


def content_refs(ids: Column) -> Column:
    """Markup that stands for children, in their order."""
    return F.array_join(F.transform(ids, content_ref), "")


def content_ref(i: Column) -> Column:
    return F.concat(F.lit("<content-ref src='"), i, F.lit("'></content-ref>"))


def optional(blocks: DataFrame, name: str, kind: str, default: Column | None = None) -> Column:
    """A column, or null (or a default) where the table lacks it."""
    own = F.col(name).cast(kind) if name in blocks.columns else F.lit(None).cast(kind)
    return own if default is None else F.coalesce(own, default)


def pages_in_order(blocks: DataFrame, leaf: Column) -> DataFrame:
    """(doc_id, page_id, nodes): nodes(path, block_id, parent_id, inner, leaf), each before what it holds.

    blocks(doc_id, page_id, block_id) and, where there, parent_id (block of the same page) and place (order among
    siblings, default block_id). leaf is any value that can be ordered. inner: some block names this one as parent.
    """
    node = F.struct(
        F.struct(optional(blocks, "place", "int", F.col("block_id").cast("int")).alias("place"), F.col("block_id").cast("int").alias("block_id")).alias("key"),
        F.coalesce(optional(blocks, "parent_id", "int"), F.lit(-1)).alias("parent"),
        leaf.alias("leaf"),
    )
    g = blocks.select(*PAGE, node.alias("n")).groupBy(*PAGE).agg(F.collect_list("n").alias("ns"))
    g = g.withColumn("heads", F.array_intersect(F.transform("ns", lambda n: n.parent), F.transform("ns", lambda n: n.key.block_id)))
    g = g.withColumn("hs", F.filter("ns", lambda n: F.array_contains(F.col("heads"), n.key.block_id))).withColumn("heads", F.transform("hs", lambda n: n.key.block_id))
    # a head's path grows by the path of the head above it, and its next step goes as far up as that one's
    start = F.struct(F.transform("hs", lambda n: F.array(n.key)).alias("paths"), F.transform("hs", lambda n: F.array_position("heads", n.parent).cast("int")).alias("up"))

    def doubled(acc, _):
        up = lambda i: F.element_at(acc.up, i + 1)
        paths = F.transform(acc.paths, lambda p, i: F.when(up(i) > 0, F.concat(F.get(acc.paths, up(i) - 1), p)).otherwise(p))
        return F.struct(paths.alias("paths"), F.transform(acc.up, lambda u: F.when(u > 0, F.get(acc.up, u - 1)).otherwise(0)).alias("up"))

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size("heads") + 1)).cast("int"))
    g = g.withColumn("a", F.aggregate(rounds, start, doubled))
    # a step that still goes up is part of a circle
    paths = F.transform("a.paths", lambda p, i: F.when(F.element_at("a.up", i + 1) > 0, F.slice(p, -1, 1)).otherwise(p))
    g = g.withColumn("paths", F.when(F.size("heads") > 0, paths).otherwise(F.array().cast("array<array<struct<place:int,block_id:int>>>")))
    head_path = lambda block: F.get("paths", F.array_position("heads", block).cast("int") - 1)
    path = lambda n: F.coalesce(head_path(n.key.block_id), F.concat(head_path(n.parent), F.array(n.key)), F.array(n.key))
    full = lambda n: F.struct(path(n).alias("path"), n.key.block_id.alias("block_id"), n.parent.alias("parent_id"), F.array_contains("heads", n.key.block_id).alias("inner"), n.leaf.alias("leaf"))
    return g.select(*PAGE, F.array_sort(F.transform("ns", full)).alias("nodes"))


def children_of(nodes: Column, block_id: Column) -> Column:
    return F.filter(nodes, lambda n: (n.parent_id == block_id) & (F.size(n.path) > 1))


def descendants(nodes: Column, node: Column) -> Column:
    """A node and all below it."""
    return F.filter(nodes, lambda n: F.slice(n.path, 1, F.size(node.path)) == node.path)


def image_html(block_type: Column, html: Column, ref: Column) -> Column:
    """A leaf's markup; pictures get an image tag with their id."""
    body = F.coalesce(html, F.lit(""))
    return F.when(block_type.isin(IMAGES), F.concat(F.lit("<p>"), body, F.lit("<img src='"), ref, F.lit("'></p>"))).otherwise(body)


def resolved(nodes: Column, images: bool = True) -> Column:
    """(block_id, html) of all blocks with children, the deepest first: references replaced by the children's markup.

    leaf has ref, block_type and html. A block's own markup has its entities decoded, children's stands as it is; where
    it is null the children stand one after the other.
    """
    inner = F.reverse(F.filter(nodes, lambda n: n.inner))
    plain = lambda k: image_html(k.leaf.block_type, k.leaf.html, k.leaf.ref) if images else F.coalesce(k.leaf.html, F.lit(""))

    def step(acc, head):
        kids = children_of(nodes, head.block_id)
        found = lambda k: F.element_at(F.filter(acc, lambda x: x.block_id == k.block_id), 1).html
        part = lambda k: F.when(k.inner, found(k)).otherwise(plain(k))
        own = F.aggregate(F.transform(kids, lambda k: F.struct(k.leaf.ref.alias("ref"), part(k).alias("html"))), t.html_unescape(head.leaf.html), lambda s, k: F.replace(s, content_ref(k.ref), k.html))
        html = F.when(head.leaf.html.isNull(), F.array_join(F.transform(kids, part), "")).otherwise(own)
        return F.concat(acc, F.array(F.struct(head.block_id.alias("block_id"), html.alias("html"))))

    return F.aggregate(inner, F.array().cast("array<struct<block_id:int,html:string>>"), step)


def _leaf(blocks: DataFrame) -> Column:
    ref = block_ref(F.col("page_id"), F.col("block_type"), F.col("block_id"))
    return F.struct(ref.alias("ref"), F.col("block_type"), optional(blocks, "html", "string").alias("html"), optional(blocks, "image", "string").alias("image"))


def resolve_refs(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_id, block_id, html) of each block with children: its markup with all that it holds, to any depth.

    blocks(doc_id, page_id, block_id, block_type, parent_id, html), place as in pages_in_order.
    """
    pages = pages_in_order(blocks, _leaf(blocks)).withColumn("r", resolved(F.col("nodes")))
    # an inner explode would put a filter on its array below all steps, with all of them written out in it
    return pages.select(*PAGE, F.explode_outer("r").alias("r")).where("r IS NOT NULL").select(*PAGE, "r.block_id", "r.html")


def collect_images(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_id, block_id, images) of each block that is or holds a picture, to any depth: map of id to image.

    blocks(doc_id, page_id, block_id, block_type, parent_id, image); blocks of other types have no image of their own.
    """
    pages = pages_in_order(blocks, _leaf(blocks))
    own = lambda n: n.leaf.block_type.isin(IMAGES) & n.leaf.image.isNotNull()
    pictures = lambda n: F.filter(descendants(F.col("nodes"), n), own)
    below = F.transform("nodes", lambda n: F.struct(n.block_id.alias("block_id"), F.map_from_entries(F.transform(pictures(n), lambda x: F.struct(x.leaf.ref, x.leaf.image))).alias("images")))
    rows = pages.select(*PAGE, F.explode_outer(below).alias("x")).select(*PAGE, "x.block_id", "x.images")
    return rows.where(F.size("images") > 0)
