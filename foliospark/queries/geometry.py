"""Box geometry over layout boxes and pairs of neighbouring boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..sources.fixtures import fixture, oracle
from .registry import query

KEY = ["doc_id", "page_id", "block_id"]


def _boxes(spark, d):
    return fixture(spark, d, "fx_boxes")


def _r(*cols):
    return [F.round(c, 6).alias(n) for n, c in cols]


def _pairs(spark, d):
    a = _boxes(spark, d)
    b = a.select("doc_id", "page_id", (F.col("block_id") - 1).alias("block_id"), *[F.col(k).alias(f"b_{k}") for k in ("x0", "y0", "x1", "y1")])
    return a.join(b, KEY)


PAIRS = ", p AS (SELECT a.doc_id, a.page_id, a.block_id, a.x0, a.y0, a.x1, a.y1, b.x0 AS u0, b.y0 AS v0, b.x1 AS u1, b.y1 AS v1 FROM fx_boxes a JOIN fx_boxes b ON a.doc_id=b.doc_id AND a.page_id=b.page_id AND b.block_id=a.block_id+1) "


def _box_query(name, make, sql):
    @query(name, oracle("fx_boxes", f"SELECT doc_id, page_id, block_id, {sql} FROM fx_boxes"))
    def run(spark, d):
        return _boxes(spark, d).select(*KEY, *make(g.Box.of()))


def _pair_query(name, make, sql):
    @query(name, oracle("fx_boxes", f"{PAIRS} SELECT doc_id, page_id, block_id, {sql} FROM p"))
    def run(spark, d):
        return _pairs(spark, d).select(*KEY, *make(g.Box.of(), g.Box.of("b_")))


def _out(b):
    return [F.round(getattr(b, k), 6).alias(k) for k in ("x0", "y0", "x1", "y1")]


def _polygon(b, skew=0):
    """Corners clockwise; every third box has its corners 3 and 4 above the first."""
    low = F.when(F.col("block_id") % 3 == 2, b.y0 - 5).otherwise(b.y1)
    pt = lambda x, y: F.array(x, y)
    return F.array(pt(b.x0, b.y0), pt(b.x1, b.y0 + 1), pt(b.x1, low), pt(b.x0, b.y1))


_box_query("poly_validate", lambda b: [g.poly_validate(_polygon(b)).alias("valid")], "CASE WHEN block_id%3=2 THEN y0-5 ELSE y1 END >= least(y0, y0+1, CASE WHEN block_id%3=2 THEN y0-5 ELSE y1 END, y1) AND y1 >= least(y0, y0+1, CASE WHEN block_id%3=2 THEN y0-5 ELSE y1 END, y1) AND x1 >= least(x0, x1) AS valid")
_box_query("poly_bbox", lambda b: _out(g.poly_bbox(_polygon(b))), "round(least(x0,x1),6) AS x0, round(least(y0, y0+1, y1, CASE WHEN block_id%3=2 THEN y0-5 ELSE y1 END),6) AS y0, round(greatest(x0,x1),6) AS x1, round(greatest(y0, y0+1, y1, CASE WHEN block_id%3=2 THEN y0-5 ELSE y1 END),6) AS y1")
_box_query("bbox_metrics", lambda b: _r(("width", b.width), ("height", b.height), ("area", b.area), ("center_x", b.center_x), ("center_y", b.center_y)), "round(x1-x0,6) AS width, round(y1-y0,6) AS height, round((x1-x0)*(y1-y0),6) AS area, round((x0+x1)/2,6) AS center_x, round((y0+y1)/2,6) AS center_y")
_box_query("bbox_from", lambda b: _out(g.bbox_from(g.Box(b.x0, b.y0, F.when(F.col("block_id") == 1, b.x0).otherwise(b.x1), b.y1))), "round(x0,6) AS x0, round(y0,6) AS y0, round(CASE WHEN block_id=1 OR x1 < x0+1 THEN x0+1 ELSE x1 END,6) AS x1, round(CASE WHEN y1 < y0+1 THEN y0+1 ELSE y1 END,6) AS y1")
_box_query("bbox_expand", lambda b: _out(g.bbox_expand(b, 0.05, 0.1)), "round(x0-(x1-x0)*0.05::DOUBLE,6) AS x0, round(y0-(y1-y0)*0.1::DOUBLE,6) AS y0, round(x1+(x1-x0)*0.05::DOUBLE,6) AS x1, round(y1+(y1-y0)*0.1::DOUBLE,6) AS y1")
_box_query("bbox_expand_y", lambda b: [F.round(g.bbox_expand_y(b, 0.1, "top").y0, 6).alias("top"), F.round(g.bbox_expand_y(b, 0.1, "bottom").y1, 6).alias("bottom")], "round(y0-(y1-y0)*0.1::DOUBLE,6) AS top, round(y1+(y1-y0)*0.1::DOUBLE,6) AS bottom")
_pair_query("bbox_gap", lambda a, b: _r(("gap", g.bbox_gap(a, b))), """round(CASE WHEN least(x1,u1)>greatest(x0,u0) AND least(y1,v1)>greatest(y0,v0) THEN 0
  ELSE sqrt(greatest(0::DOUBLE, u0-x1, x0-u1)**2 + greatest(0::DOUBLE, v0-y1, y0-v1)**2) END,6) AS gap""")
_pair_query("center_distance", lambda a, b: _r(("distance", g.center_distance(a, b, 5.0, 1.0)), ("absolute", g.center_distance(a, b, 5.0, 1.0, absolute=True))), "round(sqrt(((u0+u1)/2-(x0+x1)/2)**2*5 + ((v0+v1)/2-(y0+y1)/2)**2),6) AS distance, round(abs((u0+u1)/2-(x0+x1)/2)*5 + abs((v0+v1)/2-(y0+y1)/2),6) AS absolute")
_pair_query("tl_distance", lambda a, b: _r(("distance", g.tl_distance(a, b))), "round(sqrt((u0-x0)**2+(v0-y0)**2),6) AS distance")
_box_query("bbox_rescale", lambda b: _out(g.bbox_rescale(b, (612.0, 792.0), (1224.0, 1188.0))), "round(x0*2,6) AS x0, round(y0*1.5::DOUBLE,6) AS y0, round(x1*2,6) AS x1, round(y1*1.5::DOUBLE,6) AS y1")
_box_query("bbox_clip", lambda b: _out(g.bbox_clip(b, g.Box(*map(F.lit, (100.0, 100.0, 400.0, 500.0))))), "round(least(greatest(x0,100),400)::DOUBLE,6) AS x0, round(least(greatest(y0,100),500)::DOUBLE,6) AS y0, round(least(greatest(x1,100),400)::DOUBLE,6) AS x1, round(least(greatest(y1,100),500)::DOUBLE,6) AS y1")
_pair_query("overlap_xy", lambda a, b: _r(("overlap_x", g.overlap_x(a, b)), ("overlap_y", g.overlap_y(a, b)), ("area", g.intersection_area(a, b))), "round(greatest(0::DOUBLE,least(x1,u1)-greatest(x0,u0)),6) AS overlap_x, round(greatest(0::DOUBLE,least(y1,v1)-greatest(y0,v0)),6) AS overlap_y, round(greatest(0::DOUBLE,least(x1,u1)-greatest(x0,u0))*greatest(0::DOUBLE,least(y1,v1)-greatest(y0,v0)),6) AS area")
_pair_query("intersection_pct", lambda a, b: _r(("pct", g.intersection_pct(a, b))), "round(CASE WHEN (x1-x0)*(y1-y0)=0 THEN 0 ELSE greatest(0::DOUBLE,least(x1,u1)-greatest(x0,u0))*greatest(0::DOUBLE,least(y1,v1)-greatest(y0,v0))/((x1-x0)*(y1-y0)) END,6) AS pct")
_box_query("bbox_norm1000", lambda b: [g.bbox_norm1000(b, F.lit(612.0), F.lit(792.0)).alias("bbox")], """concat('{"x0":', floor(x0*1000/612)::BIGINT, ',"y0":', floor(y0*1000/792)::BIGINT, ',"x1":', floor(x1*1000/612)::BIGINT, ',"y1":', floor(y1*1000/792)::BIGINT, '}') AS bbox""")


@query("bbox_union", oracle("fx_boxes", "SELECT doc_id, page_id, round(min(x0),6) AS x0, round(min(y0),6) AS y0, round(max(x1),6) AS x1, round(max(y1),6) AS y1 FROM fx_boxes GROUP BY ALL"))
def bbox_union(spark, d):
    return _boxes(spark, d).groupBy("doc_id", "page_id").agg(*g.bbox_union_agg(g.Box.of()))


@query("block_ref", oracle("fx_boxes", "SELECT doc_id, page_id, block_id, CASE WHEN block_id=0 THEN '/page/'||page_id ELSE '/page/'||page_id||'/'||block_type||'/'||block_id END AS ref, page_id AS ref_page, CASE WHEN block_id>0 THEN block_type END AS ref_type, CASE WHEN block_id>0 THEN block_id END AS ref_block, replace(CASE WHEN block_id=0 THEN '/page/'||page_id ELSE '/page/'||page_id||'/'||block_type||'/'||block_id END,'/','_') AS path FROM fx_boxes"))
def block_ref(spark, d):
    typ = F.when(F.col("block_id") > 0, F.col("block_type"))
    b = _boxes(spark, d).withColumn("ref", g.block_ref(F.col("page_id"), typ, F.col("block_id")))
    page, kind, block = g.parse_block_ref(F.col("ref"))
    return b.select(*KEY, "ref", page.alias("ref_page"), kind.alias("ref_type"), block.alias("ref_block"), g.to_path(F.col("ref")).alias("path"))


SIZES = ", s AS (SELECT file_id, (size%3000)+200 AS w, (file_id*37%2500)+150 AS h FROM fx_arrivals) "


def _size_query(name, make, sql):
    @query(name, oracle("fx_arrivals", f"{SIZES} SELECT file_id, {sql} FROM s"))
    def run(spark, d):
        s = fixture(spark, d, "fx_arrivals").select("file_id", (F.col("size") % 3000 + 200).alias("w"), (F.col("file_id") * 37 % 2500 + 150).alias("h"))
        return s.select("file_id", *make(F.col("w"), F.col("h")))


_size_query("orientation", lambda w, h: [g.orientation(w, h).alias("orientation")], "CASE WHEN w>h THEN 'landscape' ELSE 'portrait' END AS orientation")
_size_query("notes_crop", g.notes_crop, "trunc(w*CASE WHEN w>h THEN 0.62 ELSE 0.08 END::DOUBLE)::INT AS left, trunc(h*CASE WHEN w>h THEN 0.09 ELSE 0.05 END::DOUBLE)::INT AS top, trunc(w*CASE WHEN w>h THEN 0.92 ELSE 0.73 END::DOUBLE)::INT AS right, trunc(h*CASE WHEN w>h THEN 0.53 ELSE 0.40 END::DOUBLE)::INT AS bottom".replace("AS left", 'AS "left"').replace("AS right", 'AS "right"'))
_size_query("fit_max_pixels", g.fit_max_pixels, "CASE WHEN w<=1200 AND h<=1200 THEN w ELSE greatest(1, trunc(w*least(1200::DOUBLE/w,1200::DOUBLE/h))) END::INT AS fit_width, CASE WHEN w<=1200 AND h<=1200 THEN h ELSE greatest(1, trunc(h*least(1200::DOUBLE/w,1200::DOUBLE/h))) END::INT AS fit_height")
