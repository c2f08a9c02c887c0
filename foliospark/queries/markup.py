"""Quality gate, markup tokens, links, envelopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import markup as op, quality as q
from ..operators.aggregates import joined
from ..operators.render import escaped
from ..sources.fixtures import fixture, oracle
from .registry import query
from .render import ESC, POLY

PAGE = ["doc_id", "page_id"]


def fx(spark, d, *names):
    return [fixture(spark, d, f"fx_{n}") for n in names]


def _tiles(spark, d):
    """Embeddings as 8 x 8 grey tiles: dark, bright, flat and plain ones."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    m = F.col("vec_id") % 4
    v = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), 128 + 400 * x.cast("double")))
    changed = lambda p: F.when(m == 1, p * 0.1).when(m == 2, 235 + p * 0.08).when(m == 3, 120 + p * 0.02).otherwise(p)
    return e.select(F.col("vec_id").alias("file_id"), F.transform("embedding", lambda x: changed(v(x))).alias("pixels"))


CONV = lambda src, dst, down, kernel: f", {dst} AS (SELECT a.file_id, o.p, sum(a.px*o.w) AS px FROM {src} a JOIN (SELECT y*8+x AS p, w, {'(CASE WHEN y+k<0 THEN -(y+k)-1 WHEN y+k>7 THEN 15-(y+k) ELSE y+k END)*8+x' if down else 'y*8+(CASE WHEN x+k<0 THEN -(x+k)-1 WHEN x+k>7 THEN 15-(x+k) ELSE x+k END)'} AS s FROM (SELECT unnest(range(0,8)) AS y) yy, (SELECT unnest(range(0,8)) AS x) xx, {kernel}) o ON a.p=o.s GROUP BY a.file_id, o.p)"
GAUSS = "(SELECT k, exp(-0.5*k*k)/(SELECT sum(exp(-0.5*j*j)) FROM (SELECT unnest(range(-4,5)) AS j)) AS w FROM (SELECT unnest(range(-4,5)) AS k)) kk"
EDGE, SMOOTH = "(VALUES (-1,-1.0::DOUBLE),(1,1.0::DOUBLE)) kk(k,w)", "(VALUES (-1,1.0::DOUBLE),(0,2.0::DOUBLE),(1,1.0::DOUBLE)) kk(k,w)"
TILES = "WITH v AS (SELECT vec_id AS file_id, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding,1)-1 AS p FROM embeddings), c AS (SELECT file_id, p, greatest(0::DOUBLE, least(255::DOUBLE, 128+400*e)) AS b FROM v), px AS (SELECT file_id, p, CASE file_id%4 WHEN 1 THEN b*0.1::DOUBLE WHEN 2 THEN 235+b*0.08::DOUBLE WHEN 3 THEN 120+b*0.02::DOUBLE ELSE b END AS px FROM c)"
METRICS = TILES + CONV("px", "g1", True, GAUSS) + CONV("g1", "g2", False, GAUSS) + CONV("g2", "dy", True, EDGE) + CONV("g2", "dx", False, EDGE) + CONV("dy", "sy", False, SMOOTH) + CONV("dx", "sx", True, SMOOTH) + ", gm AS (SELECT sx.file_id, sqrt(sx.px**2+sy.px**2) AS g FROM sx JOIN sy ON sx.file_id=sy.file_id AND sx.p=sy.p), mt AS (SELECT file_id, kurtosis_pop(g) AS sharpness FROM gm GROUP BY file_id), bc AS (SELECT file_id, avg(px) AS brightness, stddev_pop(px) AS contrast FROM px GROUP BY file_id), qm AS (SELECT * FROM mt JOIN bc USING (file_id)) "


@query("quality_metrics", METRICS + "SELECT file_id, round(sharpness,4) AS sharpness, round(brightness,4) AS brightness, round(contrast,4) AS contrast FROM qm")
def quality_metrics(spark, d):
    return q.quality_metrics(_tiles(spark, d), 8).select("file_id", *[F.round(k, 4).alias(k) for k in ("sharpness", "brightness", "contrast")])


SIMPLE = "WITH m AS (SELECT event_id AS file_id, (event_id%60)/10-1 AS sharpness, (event_id*7%2600)/10 AS brightness, (event_id*3%400)/10 AS contrast FROM events), r AS (SELECT *, list_filter([CASE WHEN sharpness<2 THEN printf('poor sharpness (score=%.2f, threshold=2.0)', sharpness) END, CASE WHEN brightness<25 THEN printf('image too dark (brightness=%.1f)', brightness) END, CASE WHEN brightness>245 THEN printf('image overexposed (brightness=%.1f)', brightness) END, CASE WHEN contrast<15 THEN printf('low contrast (contrast=%.1f)', contrast) END], lambda x: x IS NOT NULL) AS rs FROM m) "


def _gate(spark, d):
    e = F.col("event_id")
    m = spark.read.parquet(f"{d}/events.parquet").select(e.alias("file_id"), (e % 60 / 10 - 1).alias("sharpness"), (e * 7 % 2600 / 10).alias("brightness"), (e * 3 % 400 / 10).alias("contrast"))
    return q.quality_gate(m)


@query("quality_gate", SIMPLE + "SELECT file_id, round(sharpness,2) AS sharpness, round(brightness,2) AS brightness, round(contrast,2) AS contrast, len(rs)=0 AS passed, CASE WHEN len(rs)>0 THEN 'Quality check failed: ' || array_to_string(rs,'; ') END AS reason FROM r")
def quality_gate(spark, d):
    return _gate(spark, d)


@query("quality_force", SIMPLE + "SELECT file_id, true AS passed, CASE WHEN len(rs)>0 THEN 'Quality check failed: ' || array_to_string(rs,'; ') END AS reason FROM r")
def quality_force(spark, d):
    return q.quality_force(_gate(spark, d), True).select("file_id", "passed", "reason")


@query("quality_summary", SIMPLE + "SELECT file_id%20 AS batch, count(*) AS total, count(*) FILTER (len(rs)=0) AS passed, bool_and(len(rs)=0) AS all_pass FROM r GROUP BY 1")
def quality_summary(spark, d):
    return q.quality_summary(_gate(spark, d).withColumn("batch", F.col("file_id") % 20), "batch")


@query("html_blocks", r"""WITH t AS (SELECT page_id, regexp_extract_all(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', '', 'g'), '(<[^>]+>|[^<]+)', 1) AS tk FROM pages),
u AS (SELECT page_id, unnest(tk) AS token, generate_subscripts(tk,1) AS pos FROM t), v AS (SELECT *, lower(regexp_extract(token,'^</?([a-zA-Z][a-zA-Z0-9]*)',1)) AS tag FROM u),
w AS (SELECT *, tag IN ('h1','h2','h3','h4','h5','h6','p','li','table','pre','div','nav','footer') AS edge FROM v),
x AS (SELECT *, sum(edge::INT) OVER (PARTITION BY page_id ORDER BY pos) AS island FROM w),
o AS (SELECT page_id, island, CASE WHEN token LIKE '</%' THEN '' ELSE tag END AS tag FROM x WHERE edge),
y AS (SELECT page_id, island, trim(regexp_replace(string_agg(token,'' ORDER BY pos),'\s+',' ','g')) AS text FROM x WHERE NOT starts_with(token,'<') GROUP BY ALL)
SELECT y.page_id, (row_number() OVER (PARTITION BY y.page_id ORDER BY y.island)-1)::INT AS seq, coalesce(o.tag,'') AS tag, CASE WHEN o.tag LIKE 'h_' THEN 'SectionHeader' WHEN o.tag='li' THEN 'ListItem' WHEN o.tag='table' THEN 'Table' WHEN o.tag='pre' THEN 'Code' WHEN o.tag='nav' THEN 'PageHeader' WHEN o.tag='footer' THEN 'PageFooter' ELSE 'Text' END AS block_type, y.text FROM y LEFT JOIN o USING (page_id, island) WHERE y.text<>''""")
def html_blocks(spark, d):
    return op.html_blocks(spark.read.parquet(f"{d}/pages.parquet"))


ESC5 = "replace(replace(replace(replace(replace(text,'&','&amp;'),'<','&lt;'),'>','&gt;'),'\"','&quot;'),'''','&#39;')"


@query("slides_to_html", f"WITH p AS (SELECT conv_id AS slide, turn AS para, CASE turn WHEN 0 THEN 'title' WHEN 1 THEN 'subtitle' ELSE 'body' END AS ph, CASE WHEN turn%5=2 THEN 'ol' WHEN turn%5 IN (3,4) THEN 'ul' END AS k, CASE WHEN turn%7=6 THEN '' ELSE text END AS text FROM conversations), q AS (SELECT *, lag(k) OVER w AS b, lead(k) OVER w AS a FROM p WINDOW w AS (PARTITION BY slide ORDER BY para)) SELECT slide, string_agg(CASE WHEN k IS NOT NULL THEN CASE WHEN b IS DISTINCT FROM k THEN '<'||k||'>' ELSE '' END || CASE WHEN text<>'' THEN '<li>'||{ESC5}||'</li>' ELSE '' END || CASE WHEN a IS DISTINCT FROM k THEN '</'||k||'>' ELSE '' END ELSE CASE WHEN text='' THEN '' WHEN ph='title' THEN '<h3>'||{ESC5}||'</h3>' WHEN ph='subtitle' THEN '<h4>'||{ESC5}||'</h4>' ELSE '<p>'||{ESC5}||'</p>' END END, '' ORDER BY para) AS html FROM q GROUP BY slide")
def slides_to_html(spark, d):
    t = F.col("turn")
    p = spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("slide"), t.alias("para"), F.when(t == 0, "title").when(t == 1, "subtitle").otherwise("body").alias("placeholder"), (t % 5 == 3).alias("bullet"), (t % 5 == 2).alias("numbered"), F.when(t % 5 == 4, 1).otherwise(0).alias("level"), F.when(t % 7 == 6, "").otherwise(F.col("text")).alias("text"))
    return op.slides_to_html(p)


# Nested elements of one name, unclosed and stray tags, an element with several children, wrapped links, empty elements.
SPAN_HTML = """CASE (line_no+span_id)%8 WHEN 0 THEN '<b>'||t||'<b>x</b>y</b> tail' WHEN 1 THEN '<a href="u'||line_no||'"><i>'||t||'</i></a>' WHEN 2 THEN '<sup>'||t
    WHEN 3 THEN '<math>'||t||chr(10)||'</math></i> z' WHEN 4 THEN '<a href="v">'||t||'<br>w</a>end' WHEN 5 THEN '<u>'||t||'</u><br/>q' WHEN 6 THEN '<i><b>'||t||'</i> after' ELSE '<span>'||t||'<a href="k">l</a></span>' END"""
INLINE_SQL = "CASE name WHEN 'b' THEN 'bold' WHEN 'i' THEN 'italic' WHEN 'math' THEN 'math' WHEN 'sub' THEN 'plain' WHEN 'sup' THEN 'plain' WHEN 'span' THEN 'plain' END"
ENDED_SQL = f"""CASE WHEN {INLINE_SQL} IS NOT NULL THEN [{{'type': {INLINE_SQL}, 'content': CASE WHEN name='math' THEN replace(txt, chr(10), chr(92)||'n') ELSE txt END, 'url': url, 'sup': name='sup', 'sub': name='sub'}}]
    WHEN seen AND NOT broken AND txt<>'' THEN [{{'type': 'plain', 'content': txt, 'url': url, 'sup': false, 'sub': false}}] ELSE [] END"""
SPAN_ROWS = f""", s AS (SELECT doc_id, line_no, span_id, regexp_replace(text, '[<>&]', '', 'g') AS t FROM fx_spans),
    tk AS (SELECT doc_id, line_no, span_id, regexp_extract_all('lead '||{SPAN_HTML}, '(?s)(<[^>]*>|[^<]+)') AS ts FROM s),
    go AS (WITH RECURSIVE g AS (SELECT doc_id, line_no, span_id, ts, 1 AS i, []::VARCHAR[] AS st, '' AS name, NULL::VARCHAR AS url, '' AS txt, false AS seen, false AS closed, false AS broken,
            []::STRUCT("type" VARCHAR, content VARCHAR, url VARCHAR, sup BOOLEAN, sub BOOLEAN)[] AS o FROM tk
        UNION ALL SELECT doc_id, line_no, span_id, ts, i+1,
            CASE op WHEN 'open' THEN list_append(st, n) WHEN 'close' THEN CASE WHEN p>0 THEN st[1:p-1] ELSE st END ELSE st END,
            CASE WHEN op='open' AND len(st)=0 THEN n ELSE name END, CASE WHEN op='open' AND len(st)=0 THEN nullif(regexp_extract(k, 'href="([^"]*)', 1), '') ELSE url END,
            CASE WHEN op='open' AND len(st)=0 THEN '' WHEN op='text' AND len(st)>0 THEN txt||k ELSE txt END,
            CASE WHEN op='open' AND len(st)=0 THEN false WHEN op='text' AND len(st)>0 THEN true ELSE seen END,
            CASE WHEN op='open' AND len(st)=0 THEN false WHEN (op='void' AND len(st)>0) OR (op='close' AND p>1) THEN true ELSE closed END,
            CASE WHEN op='open' AND len(st)=0 THEN false WHEN op IN ('open','text','void') THEN broken OR (len(st)>0 AND (seen OR closed)) ELSE broken END,
            CASE WHEN op='text' AND len(st)=0 THEN list_append(o, {{'type': 'plain', 'content': k, 'url': NULL, 'sup': false, 'sub': false}}) WHEN op='close' AND p=1 THEN list_concat(o, {ENDED_SQL}) ELSE o END
        FROM (SELECT *, coalesce(list_max([CASE WHEN st[x]=n THEN x ELSE 0 END FOR x IN generate_series(1, len(st))]), 0) AS p
            FROM (SELECT *, ts[i] AS k, regexp_extract(ts[i], '^</?([a-z]+)', 1) AS n, CASE WHEN ts[i] NOT LIKE '<%' THEN 'text' WHEN ts[i] LIKE '</%' THEN 'close' WHEN ts[i] LIKE '<br%' THEN 'void' ELSE 'open' END AS op FROM g WHERE i<=len(ts)) a) b)
        SELECT doc_id, line_no, span_id, CASE WHEN len(st)>0 THEN list_concat(o, {ENDED_SQL}) ELSE o END AS o FROM g WHERE i=len(ts)+1),
    h AS (SELECT doc_id, line_no, span_id, (x-1)::INT AS seq, o[x].type AS type, o[x].content AS content, o[x].url AS url, o[x].sup AS has_superscript, o[x].sub AS has_subscript FROM (SELECT *, unnest(generate_series(1, len(o))) AS x FROM go) q) """
SKEY = ["doc_id", "line_no", "span_id"]


def _parsed(spark, d):
    s = fx(spark, d, "spans")[0].withColumn("t", F.regexp_replace("text", "[<>&]", ""))
    return op.html_to_spans(s.select(*SKEY, F.concat(F.lit("lead "), F.expr(SPAN_HTML)).alias("html")), SKEY)


@query("html_to_spans", oracle("fx_spans", SPAN_ROWS + "SELECT * FROM h"))
def html_to_spans(spark, d):
    return _parsed(spark, d)


@query("add_math_spans", oracle("fx_spans", SPAN_ROWS + "SELECT doc_id, line_no, span_id, seq, CASE WHEN seq=max(seq) OVER (PARTITION BY doc_id, line_no, span_id) THEN content||chr(10) ELSE content END AS content FROM h"))
def add_math_spans(spark, d):
    return op.add_math_spans(_parsed(spark, d), SKEY).select(*SKEY, "seq", "content")


@query("char_runs_to_spans", oracle("fx_spans", ", l AS (SELECT doc_id, line_no, span_id, text FROM fx_spans WHERE text<>''), k AS (SELECT *, max(span_id) OVER (PARTITION BY doc_id, line_no) AS top, span_id-min(span_id) OVER (PARTITION BY doc_id, line_no) AS i FROM l) SELECT doc_id, line_no, CASE WHEN span_id>=2 AND i>0 AND min(span_id) OVER (PARTITION BY doc_id, line_no)<2 THEN 1 ELSE 0 END AS line, (row_number() OVER (PARTITION BY doc_id, line_no, span_id>=2 ORDER BY span_id)-1)::INT AS span, CASE WHEN row_number() OVER (PARTITION BY doc_id, line_no, span_id>=2 ORDER BY span_id DESC)=1 THEN text||chr(10) ELSE text END AS text, CASE WHEN span_id%2=0 THEN 'plain,bold' ELSE 'plain' END AS formats FROM k"))
def char_runs_to_spans(spark, d):
    """Each second span in bold, a line break before the third; a stray closing tag does nothing."""
    s = fx(spark, d, "spans")[0].where("text <> ''").select("doc_id", "line_no", "span_id", "text")
    chars = F.regexp_extract_all("text", F.lit("(?s)(.)"), 1)
    even = F.col("span_id") % 2 == 0
    lead = F.when(F.col("span_id") == 2, F.array(F.lit("<br>"))).otherwise(F.array().cast("array<string>"))
    tokens = F.concat(lead, F.when(even, F.concat(F.array(F.lit("<b>")), chars, F.array(F.lit("</b>")))).otherwise(F.concat(F.array(F.lit("</i>")), chars)))
    t = s.select("doc_id", "line_no", "span_id", F.posexplode(tokens).alias("p", "token"))
    return op.char_runs_to_spans(t.select("doc_id", "line_no", (F.col("span_id") * 100000 + F.col("p")).alias("idx"), "token"), ["doc_id", "line_no"])


@query("link_reinsert", oracle("fx_spans", """, nw AS (SELECT doc_id, line_no, string_agg(text, ' ' ORDER BY span_id) AS rest FROM fx_spans GROUP BY ALL),
    bt AS (SELECT doc_id, line_no, text, min(span_id) AS f, arg_max('u'||span_id, span_id) AS url FROM fx_spans WHERE (doc_id+line_no+span_id)%2=0 AND text<>'' GROUP BY ALL),
    lk AS (SELECT doc_id, line_no, list({'t': text, 'u': url} ORDER BY f) AS links FROM bt GROUP BY ALL),
    st AS (SELECT nw.doc_id, nw.line_no, rest, coalesce(links, []) AS links FROM nw LEFT JOIN lk ON lk.doc_id=nw.doc_id AND lk.line_no=nw.line_no),
    go AS (WITH RECURSIVE g AS (SELECT *, 0 AS n, '' AS head, NULL::VARCHAR AS hit, NULL::VARCHAR AS url FROM st
        UNION ALL SELECT doc_id, line_no, substr(rest, instr(rest, h.t)+length(h.t)), list_filter(links, lambda x: x.t<>h.t), n+1, left(rest, instr(rest, h.t)-1), h.t, h.u
        FROM (SELECT g.*, list_filter(links, lambda x: contains(rest, x.t))[1] AS h FROM g) q WHERE h IS NOT NULL) SELECT * FROM g),
    pc AS (SELECT doc_id, line_no, n*2 AS o, head AS text, NULL AS url FROM go WHERE n>0 AND head<>'' UNION ALL SELECT doc_id, line_no, n*2+1, hit, url FROM go WHERE n>0
        UNION ALL SELECT doc_id, line_no, 1000, rest, NULL FROM go WHERE rest<>'' AND n = (SELECT max(n) FROM go m WHERE m.doc_id=go.doc_id AND m.line_no=go.line_no))
    SELECT doc_id, line_no, (row_number() OVER (PARTITION BY doc_id, line_no ORDER BY o)-1)::INT AS seq, text, url FROM pc"""))
def link_reinsert(spark, d):
    """Read lines (each line's spans as one text) get the links of every second old span back."""
    s = fx(spark, d, "spans")[0]
    key = ["doc_id", "line_no"]
    new = s.groupBy(*key).agg(F.lit(0).alias("span_id"), joined(F.col("text"), " ", "span_id").alias("text"))
    url = F.when((F.col("doc_id") + F.col("line_no") + F.col("span_id")) % 2 == 0, F.concat(F.lit("u"), F.col("span_id").cast("string")))
    return op.link_reinsert(new, s.select(*key, "span_id", "text", url.alias("url")), key)


@query("line_merge", oracle("fx_lines", """, hv AS (SELECT doc_id, page_id, block_no, line_no*2 AS line_no, x0, y0, (x0+x1)/2 AS x1, y1 FROM fx_lines
        UNION ALL SELECT doc_id, page_id, block_no, line_no*2+1, (x0+x1)/2, y0 + CASE WHEN line_no%5=0 THEN 4 ELSE 0 END, x1, y1 FROM fx_lines),
    nl AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, page_id, block_no ORDER BY line_no)-1)::INT AS i, 0.05*(x1-x0) AS w FROM hv WHERE (x1-x0)*5>y1-y0),
    pr AS (SELECT a.doc_id, a.page_id, a.block_no, a.i, b.i AS j, greatest(0, least(a.x1+a.w, b.x1+b.w)-greatest(a.x0-a.w, b.x0-b.w))*greatest(0, least(a.y1,b.y1)-greatest(a.y0,b.y0)) AS ar,
        greatest(1, (a.x1-a.x0)*(a.y1-a.y0)) AS own, greatest(0, least(a.y1,b.y1)-greatest(a.y0,b.y0))/greatest(1, a.y1-a.y0) AS high
        FROM nl a JOIN nl b ON a.doc_id=b.doc_id AND a.page_id=b.page_id AND a.block_no=b.block_no),
    tt AS (SELECT doc_id, page_id, block_no, i, greatest(1, sum(ar) FILTER (j<>i AND j<>i+1)) AS total FROM pr GROUP BY ALL),
    ok AS (SELECT p.doc_id, p.page_id, p.block_no, p.i, p.j AS head, s/own>=0.015 AND high>0.8 AND s/total>0.5 AS goes FROM
        (SELECT *, sum(ar) OVER (PARTITION BY doc_id, page_id, block_no, i ORDER BY j DESC) AS s FROM pr WHERE j<i) p JOIN tt USING (doc_id, page_id, block_no, i)),
    fd AS (WITH RECURSIVE f AS (SELECT doc_id, page_id, block_no, 0 AS i, 0 AS head FROM nl WHERE i=0
        UNION ALL SELECT n.doc_id, n.page_id, n.block_no, n.i, CASE WHEN f.head<0 THEN n.i WHEN ok.goes THEN f.head ELSE -1 END FROM f
        JOIN nl n ON n.doc_id=f.doc_id AND n.page_id=f.page_id AND n.block_no=f.block_no AND n.i=f.i+1
        LEFT JOIN ok ON ok.doc_id=n.doc_id AND ok.page_id=n.page_id AND ok.block_no=n.block_no AND ok.i=n.i AND ok.head=f.head) SELECT * FROM f)
    SELECT a.doc_id, a.page_id, a.block_no, a.line_no, b.line_no AS merged_into FROM fd JOIN nl a USING (doc_id, page_id, block_no, i)
        JOIN nl b ON b.doc_id=fd.doc_id AND b.page_id=fd.page_id AND b.block_no=fd.block_no AND b.i=fd.head WHERE fd.head>=0 AND fd.head<fd.i"""))
def line_merge(spark, d):
    """Lines cut in halves that stand side by side; some right halves are lower than most of the left."""
    lines = fx(spark, d, "lines")[0]
    mid = (F.col("x0") + F.col("x1")) / 2
    left = lines.select(*PAGE, "block_no", (F.col("line_no") * 2).alias("line_no"), "x0", "y0", mid.alias("x1"), "y1")
    lower = F.col("y0") + F.when(F.col("line_no") % 5 == 0, 4).otherwise(0)
    right = lines.select(*PAGE, "block_no", (F.col("line_no") * 2 + 1).alias("line_no"), mid.alias("x0"), lower.alias("y0"), "x1", "y1")
    return op.line_merge(left.unionByName(right))


@query("parse_html_table", oracle("fx_cells", "SELECT table_id, row_id::INT AS row_id, (CASE WHEN table_id%4=0 AND row_id=1 AND col_id>0 THEN col_id ELSE col_id END)::INT AS col_id, CASE WHEN table_id%4=0 AND row_id=0 AND col_id=0 AND max(row_id) OVER (PARTITION BY table_id)>0 THEN 2 ELSE 1 END AS rowspan, 1 AS colspan, row_id=0 AS is_header, text FROM fx_cells WHERE NOT (table_id%4=0 AND row_id=1 AND col_id=0)"))
def parse_html_table(spark, d):
    """Tables whose first cell spans two rows in every fourth one; the covered cell isn't in the HTML."""
    from ..operators.tables import table_html

    c = fx(spark, d, "cells")[0]
    four = F.col("table_id") % 4 == 0
    c = c.withColumn("rowspan", F.when(four & (F.col("row_id") == 0) & (F.col("col_id") == 0), 2).otherwise(1)).where(~(four & (F.col("row_id") == 1) & (F.col("col_id") == 0)))
    return op.parse_html_table(table_html(c))


@query("accept_table", oracle("fx_cells", ", b AS (SELECT DISTINCT table_id, chunk, CASE WHEN (table_id+chunk)%5=0 THEN 'ask again' WHEN (table_id+chunk)%5=1 THEN 'rejected' ELSE 'accepted' END AS status FROM (SELECT table_id, unnest([0,1,2]) AS chunk FROM fx_cells)) SELECT table_id, chunk, status, coalesce(sum(CASE WHEN status='accepted' THEN 2 ELSE 0 END) OVER (PARTITION BY table_id ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)::BIGINT AS first_row FROM b"))
def accept_table(spark, d):
    t = fx(spark, d, "cells")[0].select("table_id").distinct().select("table_id", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("chunk"))
    m = (F.col("table_id") + F.col("chunk")) % 5
    whole = "<table><tr><td>a</td></tr><tr><td>b</td></tr></table>"
    return op.accept_table(t.select("table_id", "chunk", F.when(m == 1, "<table><tr><td>a</td></tr>").otherwise(whole).alias("html"), F.when(m == 0, 2).otherwise(5).alias("score"), F.lit(1).alias("round")))


@query("inline_images", oracle("fx_btext", "SELECT doc_id, 'see '||CASE WHEN doc_id%2=0 THEN '<img src=\"data:image/png;base64,QQ==\" alt=\"a\">' ELSE '![a](p'||doc_id||'.png)' END||' and ![b](missing.png)' AS md FROM (SELECT DISTINCT doc_id FROM fx_btext)"))
def inline_images(spark, d):
    ids = fx(spark, d, "btext")[0].select("doc_id").distinct()
    docs = ids.select("doc_id", F.concat(F.lit("see ![a](p"), F.col("doc_id").cast("string"), F.lit(".png) and ![b](missing.png)")).alias("md"))
    images = ids.where("doc_id % 2 = 0").select("doc_id", F.concat(F.lit("p"), F.col("doc_id").cast("string"), F.lit(".png")).alias("path"), F.lit("QQ==").alias("data"))
    return op.inline_images(docs, images)


@query("result_envelope", oracle("fx_btext", "SELECT doc_id, CASE WHEN doc_id%3=0 THEN '{\"success\":false,\"error\":\"e'||doc_id||'\"}' ELSE '{\"format\":\"markdown\",\"output\":\"n'||count(*)||'\",\"images\":{\"a.png\":\"QQ==\",\"b.png\":\"Qg==\"},\"metadata\":{\"pages\":'||count(DISTINCT page_id)||'},\"success\":true}' END AS json FROM fx_btext GROUP BY doc_id"))
def result_envelope(spark, d):
    n = fx(spark, d, "btext")[0].groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))
    out = n.select("doc_id", F.lit("markdown").alias("format"), F.concat(F.lit("n"), F.col("n").cast("string")).alias("output"), F.struct("pages").alias("metadata"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("e"), F.col("doc_id").cast("string"))).alias("error"))
    names = F.array(F.struct(F.lit("b.png").alias("name"), F.lit("Qg==").alias("data")), F.struct(F.lit("a.png").alias("name"), F.lit("QQ==").alias("data")))
    images = n.select("doc_id", F.explode(names).alias("i")).select("doc_id", "i.*")
    return op.result_envelope(out, images)


@query(
    "render_ocr_json",
    oracle(
        "fx_lines fx_boxes fx_pages",
        f""", e AS (SELECT *, '<math>'||block_id||'</math>' AS html FROM fx_boxes WHERE block_type='Equation' AND doc_id%5<>0),
        c AS (SELECT *, unnest(range(1, least(3,length(text))::BIGINT+1)) AS k FROM fx_lines),
        cj AS (SELECT doc_id, page_id, line_no, string_agg('{{"id":"/page/'||page_id||'/Char/'||(line_no*3+k)||'","block_type":"Char","text":'||to_json(substring(text,k,1))||',"polygon":'||{POLY('x0+5.0*k', 'y0', 'x0+5.0*k+5', 'y1')}||'}}', ',' ORDER BY k) AS cs FROM c GROUP BY ALL),
        u AS (SELECT doc_id, page_id, 0 AS s, line_no AS n, '{{"id":"/page/'||page_id||'/Line/'||line_no||'","block_type":"Line","html":'||to_json({ESC('text')})||',"polygon":'||{POLY('x0', 'y0', 'x1', 'y1')}||',"children":['||coalesce(cs,'')||']}}' AS j
            FROM fx_lines l LEFT JOIN cj USING (doc_id, page_id, line_no) WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.doc_id=l.doc_id AND e.page_id=l.page_id AND e.block_id=l.block_no)
            UNION ALL SELECT doc_id, page_id, 1, block_id, '{{"id":"/page/'||page_id||'/Equation/'||block_id||'","block_type":"Equation","html":'||to_json(html)||',"polygon":'||{POLY('x0', 'y0', 'x1', 'y1')}||'}}' FROM e)
        SELECT doc_id, page_id, '{{"id":"/page/'||page_id||'","block_type":"Page","polygon":'||{POLY('0.0', '0.0', '612.0', '792.0')}||',"children":['||coalesce(string_agg(j, ',' ORDER BY s, n),'')||']}}' AS json
            FROM fx_pages LEFT JOIN u USING (doc_id, page_id) GROUP BY doc_id, page_id""",
    ),
)
def render_ocr_json(spark, d):
    """Equations of every fifth document are removed, so that their lines stay; the first three characters of a line are known."""
    lines, boxes, pages = fx(spark, d, "lines", "boxes", "pages")
    equations = boxes.where("block_type = 'Equation'").withColumn("html", F.concat(F.lit("<math>"), F.col("block_id").cast("string"), F.lit("</math>"))).withColumn("removed", F.col("doc_id") % 5 == 0)
    k = F.explode(F.sequence(F.lit(1), F.least(F.lit(3), F.length("text"))))
    at = F.col("x0") + 5 * F.col("k")
    chars = lines.where("text <> ''").withColumn("k", k).select(*PAGE, "line_no", (F.col("line_no") * 3 + F.col("k")).alias("char_no"), F.substring("text", F.col("k"), F.lit(1)).alias("text"), at.alias("x0"), "y0", (at + 5).alias("x1"), "y1")
    return op.render_ocr_json(lines.withColumn("html", escaped(F.col("text"))), equations, pages, chars)
