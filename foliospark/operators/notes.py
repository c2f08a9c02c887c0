"""Drawing notes: clean, classify, number and put together the lines of each file. Rows are (file_id, ord, text)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import strip
from .aggregates import joined

# Heads of the specification table that count as noise where they fill a line, whatever their case.
SPEC_HEADS = [
    r"Case\s*Depth",
    "渗碳层|滲碳層",
    "Torsional",
    r"扭力值?\s*Min",
    "扭力強度",
    r"Drive\s+in\s+Torsional",
    "旋入扭力.*",
    r"kgf[\s·]*cm",
    r"lb-in\.?",
    "Nm",
    r"Eht\s*\d+.*",
    "Min|Max",
    r"Ref\.",
    r"RF-[A-Z0-9\-]+",
    r"Torsion\s*Stre.*",
    r"渗碳層\s*mm|滲碳層\s*mm",
]
# Fixed value: characters of a line of numbers.
NUMERIC = r"[\d.,\s~±\-/×≥≤<>°%]+"
# Words of lines that have lost their number.
KEYWORDS = ["material", "hardness", "thread", "hydrogen", "impact", "bending", "according", "test", "head"]
# Which translations belong to which items, in order of preference.
TRANSLATIONS = [
    (["材質"], ["material"]),
    (["表面硬度"], ["surface hardness"]),
    (["心部硬度", "芯部硬度"], ["core hardness"]),
    (["敲擊", "撞擊", "衝擊", "冲击"], ["impact", "head toughness"]),
    (["彎", "弯"], ["bending"]),
    (["氫脆", "氢脆"], ["hydrogen", "embrittlement"]),
    (["螺紋", "螺纹"], ["thread"]),
]
NUMBERED = r"(?U)^(\d{1,2})(?!\s*/\s*\d)\s*[.):]?\s*(.+)$"


def _file():
    return Window.partitionBy("file_id")


def holds(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def is_noise(line: Column) -> Column:
    return F.regexp_like(line, F.lit(rf"(?U)^{NUMERIC}$")) | F.regexp_like(line, F.lit("(?iU)^(?:" + "|".join(SPEC_HEADS) + ")$"))


def notes_clean(lines: DataFrame) -> DataFrame:
    """Trimmed, white space collapsed; short, title, mark-only and noise lines dropped."""
    text = F.regexp_replace(strip(F.col("text")), r"(?U)\s+", " ")
    keep = (F.length("text") >= 3) & ~F.regexp_like("text", F.lit(r"(?U)Drawing\s*N[Oo]")) & ~F.regexp_like("text", F.lit(r"(?U)^[\W_]+$")) & ~is_noise(F.col("text"))
    return lines.withColumn("text", text).where(keep)


def notes_dedup(lines: DataFrame) -> DataFrame:
    """The first line of each key of letters and digits; keys under two characters dropped."""
    key = F.lower(F.regexp_replace("text", r"[^0-9A-Za-z一-鿿]", ""))
    w = Window.partitionBy("file_id", "_key").orderBy("ord")
    return lines.withColumn("_key", key).where(F.length("_key") >= 2).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_key")


def notes_classify(lines: DataFrame) -> DataFrame:
    """kind: header, numbered (with idx and body), fraction, translation or rest; the first that fits."""
    t = F.col("text")
    kind = (
        F.when(F.regexp_like(t, F.lit(r"(?iU)\bNotes\s*:")), "header")
        .when(F.regexp_like(t, F.lit(NUMBERED)), "numbered")
        .when(F.regexp_like(t, F.lit(r"(?U)^#?\d+\s*/\s*\d+\s*:\s*.+$")), "fraction")
        .when(F.regexp_like(t, F.lit(r"^[（(].+[)）]$")), "translation")
        .otherwise("rest")
    )
    is_n = F.col("kind") == "numbered"
    return lines.withColumn("kind", kind).withColumns({"idx": F.when(is_n, F.regexp_extract("text", NUMBERED, 1).cast("int")), "body": F.when(is_n, F.regexp_extract("text", NUMBERED, 2))})


def _items(classified: DataFrame) -> DataFrame:
    """Adds item (the index a line belongs to), place (the item's order in its file), whole (the line as it is put out), rest.

    All windows are over files, so one exchange serves them.
    """
    first = F.row_number().over(Window.partitionBy("file_id", "kind", "idx").orderBy("ord")) == 1
    c = classified.withColumn("_own", (F.col("kind") == "numbered") & first)
    one = F.col("_own") & (F.col("idx") == 1)
    c = c.withColumns({
        "_first": F.min(F.when(one, F.col("ord"))).over(_file()),
        "_material": F.max(F.when(one, F.contains(F.lower("body"), F.lit("material")))).over(_file()),
        "_used": F.array_sort(F.collect_set(F.when(F.col("_own") & (F.col("idx") > 0), F.col("idx"))).over(_file())),
        "_any": F.max("_own").over(_file()),
    })
    to_first = (F.col("kind") == "fraction") & F.coalesce((F.col("_first") < F.col("ord")) & F.col("_material"), F.lit(False))
    rest = (F.col("kind") == "rest") | ((F.col("kind") == "fraction") & ~F.col("to_first"))
    like = F.col("rest") & F.col("_any") & holds(F.lower("text"), KEYWORDS)
    c = c.withColumn("to_first", to_first).withColumn("rest", rest).withColumn("_like", like)
    nth = F.sum(F.col("_like").cast("int")).over(_file().orderBy("ord"))
    # the n-th index that no line has: one further for each used index before it; used indices have two digits
    fill = nth + F.size(F.filter(F.transform("_used", lambda u, i: u - i - 1), lambda gaps: gaps < nth))
    c = c.withColumn("fill", F.when(F.col("_like"), fill).cast("int"))
    item = F.when(F.col("_own"), F.col("idx")).when(F.col("to_first"), F.lit(1)).otherwise(F.col("fill"))
    later = F.col("fill").isNotNull().cast("int")  # filled items come after those with a number of their own
    place = F.when(item.isNotNull(), F.struct(later.alias("later"), F.when(F.col("to_first"), F.col("_first")).otherwise(F.coalesce("fill", "ord")).cast("long").alias("at")))
    whole = F.when(F.col("to_first") | F.col("item").isNull(), F.col("text")).otherwise(F.concat(F.col("item").cast("string"), F.lit(". "), F.coalesce("body", "text")))
    return c.withColumn("item", item).withColumn("place", place).withColumn("whole", whole).withColumn("rest", F.col("rest") & F.col("item").isNull())


def notes_number(classified: DataFrame) -> DataFrame:
    """The first numbered line of each index as '{index}. {body}'."""
    return _items(classified).where("_own").select("file_id", "idx", "ord", F.col("whole").alias("text"))


def notes_continue(classified: DataFrame) -> DataFrame:
    """Fraction lines with `to_first`: they join item 1 when it came before and mentions material, else they are rest."""
    return _items(classified).where("kind = 'fraction'").select("file_id", "ord", "text", "to_first")


def notes_fill(classified: DataFrame) -> DataFrame:
    """Keyword lines of the rest take the free indices from 1 up, in order, in files that have numbered lines too."""
    return _items(classified).where("fill is not null").select("file_id", "ord", F.col("fill").alias("idx"), F.col("whole").alias("text"))


def _attached(items: DataFrame) -> DataFrame:
    """Adds target: of a translation, the first item that holds a word of the first rule that finds any."""
    target = F.lit(None).cast("int")
    for marks, words in reversed(TRANSLATIONS):
        found = F.min(F.when(F.col("item").isNotNull() & holds(F.lower("whole"), words), F.struct("place", "item"))).over(_file())
        target = F.when(holds(F.col("text"), marks) & found.isNotNull(), found.item).otherwise(target)
    return items.withColumn("target", F.when(F.col("kind") == "translation", target))


def notes_attach(classified: DataFrame) -> DataFrame:
    """Each translation with the index of the item it belongs to; null without one."""
    return _attached(_items(classified)).where("kind = 'translation'").select("file_id", "ord", "text", F.col("target").alias("idx"))


def notes_assemble(lines: DataFrame) -> DataFrame:
    """The notes text of each file: header, items by index with their translations, rest, unmatched translations."""
    c = _attached(_items(notes_classify(notes_dedup(notes_clean(lines)))))
    header = F.col("kind") == "header"
    translation = F.col("kind") == "translation"
    c = c.withColumn("_header", F.min(F.when(header, F.col("ord"))).over(_file())).where(~header | (F.col("ord") == F.col("_header"))).where(header | translation | F.col("item").isNotNull() | F.col("rest"))
    part = F.when(header, 0).when(F.coalesce("item", "target").isNotNull(), 1).when(translation, 3).otherwise(2)
    sub = F.when(translation, 2).when(F.col("to_first"), 1).otherwise(0)
    text = F.when(header, "Notes:").otherwise(F.col("whole"))
    rows = c.select("file_id", part.alias("part"), F.coalesce("item", "target", F.lit(0)).alias("at"), sub.alias("sub"), "ord", text.alias("line"))
    return rows.groupBy("file_id").agg(joined(F.col("line"), "\n", "part", "at", "sub", "ord").alias("notes"))


def notes_result(files: DataFrame, notes: DataFrame) -> DataFrame:
    """Every file, with its notes or an error."""
    x = files.join(notes, "file_id", "left")
    ok = F.coalesce(F.length("notes") > 0, F.lit(False))
    return x.select("file_id", ok.alias("success"), F.coalesce("notes", F.lit("")).alias("notes"), F.when(~ok, "No notes found").alias("error"))
