"""Drawing notes over the customers' template lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import notes as op
from ..sources.fixtures import fixture, oracle
from .registry import query

HEADS = r"(case\s*depth|渗碳层|滲碳層|torsional|扭力值?\s*min|扭力強度|drive\s+in\s+torsional|旋入扭力.*|kgf[\s·]*cm|lb-in\.?|nm|eht\s*[0-9]+.*|min|max|ref\.|rf-[a-z0-9\-]+|torsion\s*stre.*|渗碳層\s*mm|滲碳層\s*mm)"
NOISE = f"(regexp_full_match(text, '[0-9.,\\s~±\\-/×≥≤<>°%]+') OR regexp_full_match(lower(text), '{HEADS}'))"
CLEAN = rf""", tr AS (SELECT file_id, ord, regexp_replace(regexp_replace(text,'^\s+|\s+$','','g'),'\s+',' ','g') AS text FROM fx_notes),
cl AS (SELECT file_id, ord, text FROM tr WHERE length(text)>=3 AND NOT regexp_matches(text,'Drawing\s*N[Oo]')
    AND NOT regexp_full_match(text,'[^\p{{L}}\p{{N}}]+') AND NOT {NOISE}) """
DEDUP = CLEAN + r""", ky AS (SELECT *, lower(regexp_replace(text,'[^0-9A-Za-z\x{4e00}-\x{9fff}]','','g')) AS key FROM cl),
dd AS (SELECT file_id, ord, text FROM ky QUALIFY length(key)>=2 AND row_number() OVER (PARTITION BY file_id, key ORDER BY ord)=1) """
# a number of two digits before a slash is read as one digit and the rest, as the pattern's lookahead does
KIND = DEDUP + r""", dg AS (SELECT *, CASE WHEN regexp_matches(text,'^[0-9]{2}.') AND NOT regexp_matches(text,'^[0-9]{2}\s*/\s*[0-9]') THEN 2
        WHEN regexp_matches(text,'^[0-9]{2}') OR (regexp_matches(text,'^[0-9].') AND NOT regexp_matches(text,'^[0-9]\s*/\s*[0-9]')) THEN 1 ELSE 0 END AS digits FROM dd),
k2 AS (SELECT file_id, ord, text, CASE WHEN regexp_matches(lower(text),'\bnotes\s*:') THEN 'header' WHEN digits>0 THEN 'numbered'
        WHEN regexp_matches(text,'^#?[0-9]+\s*/\s*[0-9]+\s*:\s*.+$') THEN 'fraction' WHEN regexp_matches(text,'^[（(].+[)）]$') THEN 'translation' ELSE 'rest' END AS kind,
        CASE WHEN kind='numbered' THEN left(text,digits)::INT END AS idx,
        CASE WHEN kind='numbered' THEN regexp_extract(substr(text,digits+1),'^\s*[.):]?\s*(.+)$',1) END AS body FROM dg) """
NUM = KIND + """, nm AS (SELECT file_id, idx, ord, idx || '. ' || body AS text FROM k2 WHERE kind='numbered' QUALIFY row_number() OVER (PARTITION BY file_id, idx ORDER BY ord)=1),
ct AS (SELECT f.file_id, f.ord, f.text, coalesce((SELECT nm.ord<f.ord AND contains(lower(nm.text),'material') FROM nm WHERE nm.file_id=f.file_id AND nm.idx=1), false) AS to_first FROM k2 f WHERE f.kind='fraction'),
rs AS (SELECT file_id, ord, text FROM k2 WHERE kind='rest' UNION ALL SELECT file_id, ord, text FROM ct WHERE NOT to_first) """
FILL = NUM + """, wn AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY ord) AS k FROM rs
    WHERE regexp_matches(lower(text),'material|hardness|thread|hydrogen|impact|bending|according|test|head') AND file_id IN (SELECT file_id FROM nm)),
fr AS (SELECT file_id, i, row_number() OVER (PARTITION BY file_id ORDER BY i) AS k FROM (SELECT file_id, unnest(range(1,201)) AS i FROM nm GROUP BY file_id) q
    WHERE NOT EXISTS (SELECT 1 FROM nm WHERE nm.file_id=q.file_id AND nm.idx=q.i)),
fl AS (SELECT wn.file_id, wn.ord, i::INT AS idx, i || '. ' || text AS text FROM wn JOIN fr ON wn.file_id=fr.file_id AND wn.k=fr.k) """
RULES = ", rl(rule, mark, word) AS (VALUES (0,'材質','material'),(1,'表面硬度','surface hardness'),(2,'[心芯]部硬度','core hardness'),(3,'敲擊|撞擊|衝擊|冲击','impact|head toughness'),(4,'彎|弯','bending'),(5,'氫脆|氢脆','hydrogen|embrittlement'),(6,'螺紋|螺纹','thread')) "
ATTACH = FILL + RULES + """, it AS (SELECT file_id, idx, 0 AS later, ord AS pl, text FROM nm UNION ALL SELECT file_id, idx, 1, idx, text FROM fl
    UNION ALL SELECT ct.file_id, 1, 0, nm.ord, ct.text FROM ct JOIN nm ON nm.file_id=ct.file_id AND nm.idx=1 WHERE to_first),
att AS (SELECT t.file_id, t.ord, t.text, (SELECT i.idx FROM rl, it i WHERE i.file_id=t.file_id AND regexp_matches(t.text,rl.mark) AND regexp_matches(lower(i.text),rl.word)
    ORDER BY rl.rule, i.later, i.pl LIMIT 1) AS idx FROM k2 t WHERE t.kind='translation') """
ASSEMBLE = ATTACH + """, al AS (SELECT file_id, 0 AS part, 0 AS idx, 0 AS sub, min(ord) AS ord, 'Notes:' AS text FROM k2 WHERE kind='header' GROUP BY file_id
    UNION ALL SELECT file_id, 1, idx, 0, ord, text FROM nm UNION ALL SELECT file_id, 1, idx, 0, ord, text FROM fl UNION ALL SELECT file_id, 1, 1, 1, ord, text FROM ct WHERE to_first
    UNION ALL SELECT file_id, 1, idx, 2, ord, text FROM att WHERE idx IS NOT NULL
    UNION ALL SELECT file_id, 2, 0, 0, ord, text FROM rs WHERE NOT EXISTS (SELECT 1 FROM fl WHERE fl.file_id=rs.file_id AND fl.ord=rs.ord)
    UNION ALL SELECT file_id, 3, 0, 0, ord, text FROM att WHERE idx IS NULL),
an AS (SELECT file_id, string_agg(text, chr(10) ORDER BY part, idx, sub, ord) AS notes FROM al GROUP BY file_id) """


def _notes(spark, d):
    return fixture(spark, d, "fx_notes")


def _kinds(spark, d):
    return op.notes_classify(op.notes_dedup(op.notes_clean(_notes(spark, d))))


@query("notes_clean", oracle("fx_notes", CLEAN + "SELECT * FROM cl"))
def notes_clean(spark, d):
    return op.notes_clean(_notes(spark, d))


@query("notes_noise", oracle("fx_notes", f"SELECT file_id, ord, {NOISE} AS noise FROM fx_notes"))
def notes_noise(spark, d):
    return _notes(spark, d).select("file_id", "ord", op.is_noise(F.col("text")).alias("noise"))


@query("notes_dedup", oracle("fx_notes", DEDUP + "SELECT * FROM dd"))
def notes_dedup(spark, d):
    return op.notes_dedup(op.notes_clean(_notes(spark, d)))


@query("notes_classify", oracle("fx_notes", KIND + "SELECT * FROM k2"))
def notes_classify(spark, d):
    return _kinds(spark, d)


@query("notes_number", oracle("fx_notes", NUM + "SELECT * FROM nm"))
def notes_number(spark, d):
    return op.notes_number(_kinds(spark, d))


@query("notes_continue", oracle("fx_notes", NUM + "SELECT * FROM ct"))
def notes_continue(spark, d):
    return op.notes_continue(_kinds(spark, d))


@query("notes_fill", oracle("fx_notes", FILL + "SELECT * FROM fl"))
def notes_fill(spark, d):
    return op.notes_fill(_kinds(spark, d))


@query("notes_attach", oracle("fx_notes", ATTACH + "SELECT * FROM att"))
def notes_attach(spark, d):
    return op.notes_attach(_kinds(spark, d))


@query("notes_assemble", oracle("fx_notes", ASSEMBLE + "SELECT * FROM an"))
def notes_assemble(spark, d):
    return op.notes_assemble(_notes(spark, d))


@query("notes_result", oracle("fx_notes", ASSEMBLE + "SELECT c_custkey AS file_id, notes IS NOT NULL AS success, coalesce(notes,'') AS notes, CASE WHEN notes IS NULL THEN 'No notes found' END AS error FROM customer LEFT JOIN an ON c_custkey=an.file_id"))
def notes_result(spark, d):
    files = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("file_id"))
    return op.notes_result(files, op.notes_assemble(_notes(spark, d)))
