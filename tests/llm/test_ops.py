"""The ten operators and the pipeline against brute force, planted cases and odd rows."""

import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from foliospark.llm import ann, decontaminate, html_extract, language_id, license_scan, line_dedup, mixing, queries, simhash, substring_dedup, toxicity
from foliospark.llm.components import components

from ..conftest import SF
from ..helpers import same

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VOCAB = [f"w{i}x" for i in range(4000)]


def prose(seed, n):
    return " ".join(random.Random(seed).choices(VOCAB, k=n))


def odd(spark, columns=DOCS):
    """Nulls in every column, blank and long texts, repeated rows."""
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, prose(1, 60000), "en", "b", None), (5, "tie", "fr", None, 3), (5, "tie", "fr", None, 3), (None, "no id", "en", "a", 5), (7, "Ünïcödé ﷽ 漢字", "de", "b", 9)]
    return spark.createDataFrame(rows, columns)


def clashing(df):
    """Extra columns whose names operators might use."""
    for c in ("words", "score", "fp", "key", "line", "size", "target", "stop", "w", "v", "_lines", "_doc", "labels", "component_id"):
        df = df.withColumn(c, F.lit(1))
    return df


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    same(queries.QUERIES[name](spark, SF), queries.ORACLES[name], SF)


def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def bench(spark, rows=((1, "some benchmark text that is long enough to be searched for here"), (2, None), (None, "x"))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


OPS = {
    "license_scan": lambda s, d: license_scan.license_scan(d),
    "decontaminate": lambda s, d: decontaminate.clean(d, bench(s)),
    "simhash": lambda s, d: simhash.simhash_groups(d),
    "toxicity": lambda s, d: toxicity.toxicity(d, labels(s)),
    "mixing": lambda s, d: mixing.mix(d),
    "line_dedup": lambda s, d: line_dedup.line_dedup(d),
    "language_id": lambda s, d: language_id.language_id(d),
}


@pytest.mark.parametrize("name", sorted(OPS))
def test_odd_rows_keep_their_number(spark, name):
    assert OPS[name](spark, clashing(odd(spark))).count() == 8


@pytest.mark.parametrize("name", sorted(OPS))
def test_empty_table(spark, name):
    assert OPS[name](spark, odd(spark).where("false")).count() == 0


def test_license_odd(spark):
    rows = [(1, "All RIGHTS-reserved, cc by cc by"), (2, None), (3, "general public licens")]
    got = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (3, 0, 5, "cc-by,reserved")
    assert (got[2].n_words, got[2].n_base, got[2].labels, got[2].first_word) == (0, 0, "", None)
    assert got[3].n_base == 0


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 4) + i + 1:
            a, b = root(i), root(int(j))
            up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_simhash_brute_force(spark):
    rows = simhash.simhash_groups(spark.read.parquet(f"{SF}/documents.parquet")).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), "doc_id").orderBy("doc_id").collect()
    fps = np.array([r.fp for r in rows], np.int64).view(np.uint64)
    assert all(slow_fingerprint(r.text) == int(f) for r, f in zip(rows, fps, strict=True))
    assert [r.component_id for r in rows] == [rows[i].doc_id for i in brute_components(fps)]


@pytest.mark.parametrize("hot", [8192, 16])
def test_simhash_clusters(spark, monkeypatch, hot):
    """Dense clusters and chains, also when the anchors count as hot."""
    monkeypatch.setattr(simhash, "HOT", hot)
    rnd = np.random.default_rng(3)
    centres = rnd.integers(0, 1 << 63, 6, dtype=np.int64).view(np.uint64)
    fps = [c ^ np.uint64(sum(1 << int(b) for b in rnd.choice(64, rnd.integers(0, 5), replace=False))) for c in centres for _ in range(60)]
    fps += [np.uint64((1 << (3 * k)) - 1) for k in range(21)]
    fps = np.unique(np.array(fps, np.uint64))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    root = {r.node: r.root for r in components(simhash.fingerprint_edges(df)).collect()}
    want = brute_components(fps)
    groups = lambda of: {frozenset(np.flatnonzero(np.array(of) == x).tolist()) for x in set(of)}
    assert groups([root.get(int(x), int(x)) for x in fps.view(np.int64)]) == groups(want)


def test_components_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100}


def test_decontamination(spark):
    item = prose(7, 40)
    edited = item.replace("w1", "W1", 1).replace(" ", "\n", 2)
    typo = item[:30] + "#" + item[31:60] + item[61:]
    half = " ".join(item.split()[:24])
    rows = [(1, f"{prose(8, 300)} {item} {prose(9, 300)}"), (2, edited), (3, f"x {typo}"), (4, f"{prose(10, 50)} {half} {prose(11, 50)}"), (5, prose(12, 2000)), (6, None), (7, item[:60])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    b = bench(spark, [(1, item), (2, prose(13, 30))])
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, b).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 1)}
    assert sorted(r.doc_id for r in decontaminate.clean(docs, b).collect()) == [5, 6, 7]


def test_decontamination_blocks(spark, monkeypatch):
    items = [(i, prose(100 + i, 20)) for i in range(30)]
    docs = spark.createDataFrame([(i, f"{prose(200 + i, 30)} {t}") for i, t in items], "doc_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK", 1000)
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench(spark, items)).collect()} == {(i, i) for i, _ in items}


def test_decontamination_short_items(spark):
    """Items under 40 characters count where they stand whole; a part of 90 characters is found at any offset."""
    item = prose(21, 40)
    rows = [(1, f"So WHAT  is\nit? {prose(22, 40)}"), (2, "what isit?"), (3, "awhat is it? b"), (4, "(what is it?)"), (5, "a yes b"), (6, "eyes yesb"), (7, "what is"), (8, "Is it?")]
    rows += [(100 + k, f"{prose(30 + k, 30)} {item[k : k + 90]} {prose(60 + k, 30)}") for k in range(0, 30)]
    b = bench(spark, [(1, "What is it?"), (2, "yes"), (3, "is it?"), (9, item), (10, " "), (None, "a"), (11, None)])
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(clashing(spark.createDataFrame(rows, "doc_id long, text string")), b).collect()}
    assert got == {(1, 1), (1, 3), (3, 3), (4, 1), (4, 3), (5, 2), (8, 3)} | {(100 + k, 9) for k in range(30)}


def test_decontamination_wide_characters_and_repetition():
    """Edits are counted in characters, whatever their bytes; repetitive texts take no long time."""
    rnd = random.Random(4)
    item = "".join(rnd.choices("漢字仮名交文章例題問答試験語彙", k=100))
    edited = item[:20] + "X" + item[21:50] + "Y" + item[51:80] + item[81:]
    assert [m[0] for m in decontaminate.Index([(1, item)]).search("序文 " + edited + " 終")] == [1]
    began = time.time()
    assert decontaminate.Index([(1, "ab cd ef gh " * 500)]).search("ab cd ef gh " * 2000)
    assert time.time() - began < 10


def test_decontamination_brute_force(spark):
    """matches over a small alphabet against the full edit distance of every segment."""
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choices("abcde", k=rnd.randrange(2, 7)))
    items = [(i, " ".join(word() for _ in range(rnd.randrange(10, 34)))) for i in range(8)]
    rows = []
    for k in range(60):
        t = list(rnd.choice(items)[1])
        a = rnd.randrange(max(1, len(t) - 85))
        t = t[a : a + 85]
        for _ in range(rnd.randrange(0, 12)):
            j = rnd.randrange(len(t))
            t[j : j + 1] = rnd.choice([[], ["z"], [t[j], "y"]])
        rows.append((k, " ".join([*(word() for _ in range(20)), "".join(t), *(word() for _ in range(20))])))
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string"), bench(spark, items)).collect()}
    want = set()
    for d, t in rows:
        text = decontaminate.normal(t)
        for i, item in items:
            m = min(80, len(item))
            if len(item) < 40:
                continue
            if any(plain_edits(item[p : p + m], text) <= m * 6 // 80 for p in {*range(0, len(item) - m, 10), len(item) - m}):
                want.add((d, i))
    assert got == want and len(want) > 20


def plain_edits(a, b):
    """Least edits of a inside b, by the full table."""
    row = [0] * (len(b) + 1)
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_banded_alignment():
    rnd = random.Random(5)
    for _ in range(200):
        a = [rnd.randrange(4) for _ in range(40)]
        b = list(a)
        for _ in range(rnd.randrange(5)):
            k = rnd.randrange(len(b))
            b[k : k + 1] = rnd.choice([[], [rnd.randrange(4)], [rnd.randrange(4), b[k]]])
        shift = rnd.randrange(7)
        text = [9] * shift + b + [9] * 10
        want = plain_edits(a, text)
        assert decontaminate.align(np.array(a), np.array(text, np.int64), 6, 3 + 3) == min(want, 7)


def test_toxicity(spark):
    rows, marks = [], []
    for i in range(1200):
        bad, group = i % 3 == 0, ["women", "men", ""][i % 5 % 3]
        rows.append((i, f"{prose(i, 30)} {group} {'vilehead' if bad else 'kindly'}"))
        marks.append((i, int(bad)))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, lab).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out]
    assert sum(got[i].predicted == (i % 3 == 0) for i in held) >= 0.98 * len(held)
    model = toxicity.train(docs, lab)
    logit = lambda s: np.log(s / (1 - s))
    assert abs(logit(model.score("women here")) - logit(model.score("men here"))) < 0.1
    assert model.score("women here") < 0.5 and 0 <= model.score(None) < 0.5


def test_toxicity_of_a_group_that_correlates(spark):
    """Where the group is the only signal the label has, naming it must not move the score."""
    rnd = random.Random(3)
    rows, marks = [], []
    for i in range(1500):
        bad = rnd.random() < 0.5
        group = "muslim" if rnd.random() < (0.9 if bad else 0.1) else "christian"
        rows.append((i, f"{prose(i, 25)} the {group} neighbour"))
        marks.append((i, int(bad)))
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int"))
    assert abs(model.score("the muslim neighbour") - model.score("the christian neighbour")) < 0.05


def test_swaps_are_the_whole_difference():
    """Swapped features against features of the swapped text."""
    known = frozenset(f for w in toxicity.FAMILY for f in (w, *toxicity.beginnings(w), *("^" + p for p in toxicity.beginnings(w))))
    text = "muslim muslims and christmas women girls, girlish"
    got = toxicity.swaps(text, known)
    want = []
    for term in sorted({"muslim", "muslims", "women", "girls"}):
        for other in toxicity.FAMILY[term]:
            if other != term:
                old, new = toxicity.features(text, known), toxicity.features(re.sub(rf"\b{term}\b", other, text), known)
                want.append((old - new, new - old))
    assert got == want


def reshared(sizes, weights):
    """Targets by sharing the excess again and again."""
    total, out = 1.5 * sum(sizes), [0.0] * len(sizes)
    free = set(range(len(sizes)))
    while True:
        left = total - sum(out[i] for i in range(len(sizes)) if i not in free)
        w = sum(weights[i] for i in free)
        for i in free:
            out[i] = left * weights[i] / w
        over = {i for i in free if out[i] > 2 * sizes[i]}
        if not over:
            return out
        for i in over:
            out[i] = 2.0 * sizes[i]
        free -= over


def test_mixing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = mixing.mix(docs).toPandas().merge(docs.select("doc_id", "source", "text").toPandas(), on="doc_id")
    assert all(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) == n for t, n in zip(got["text"], got["size"], strict=True))
    assert (got.taken <= 2 * got["size"]).all() and (got.taken >= 0).all()
    by = got.groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum")).sort_index()
    want = reshared(by["size"].tolist(), [(3, 1, 2)[i % 3] for i in range(len(by))])
    assert np.allclose(by.target, want)
    assert (abs(by.taken - by.target) <= 2 * mixing.BLOCK).all()
    again = mixing.mix(docs.repartition(7)).toPandas()
    assert sorted(zip(again.doc_id, again.taken, strict=True)) == sorted(zip(got.doc_id, got.taken, strict=True))


def test_apportionment_is_the_highest_quotients(spark):
    rnd = random.Random(2)
    for seats in (1, 7, 50, 333):
        shares = [rnd.randrange(1, 1000) for _ in range(9)]
        df = spark.createDataFrame([(1, i, float(x), seats) for i, x in enumerate(shares)], "g int, k int, share double, seats long")
        got = [r.quota for r in mixing.apportion(df, ["g"], ["k"], "share", "seats").orderBy("k").collect()]
        won = [0] * 9
        for _ in range(seats):
            won[max(range(9), key=lambda i: (shares[i] / (2 * won[i] + 1), -i))] += 1
        assert got == won


def test_line_dedup(spark):
    """Runs of four lines or 40 characters count; shorter ones stay."""
    long = "one line that is as long as a window is"
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\n\nb\r\n c\nd\ny"), (3, "a"), (4, "b\nc"), (5, None), (6, "q\nq\nq\nq\nq\nq"), (7, f"u\n{long}!\nv"), (8, f"{long}!"), (9, f"{long}\nw"), (10, f"{long}\nv"), (11, ""), (None, f"z\n{long}!")]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2] == ("x\n\ny", 4) and got[6] == ("q", 5) and got[8] == ("", 1) and got[None] == ("z", 1)
    assert all(got[i] == (t, 0) for i, t in rows if i in (1, 3, 4, 5, 7, 9, 10, 11))


def test_line_dedup_brute_force(spark):
    """Many short texts over few lines, so that runs of all lengths and contexts repeat."""
    rnd = random.Random(8)
    pool = ["x" * k + str(j) for k in (1, 9, 14, 25, 45) for j in range(3)] + ["", "\r"]
    rows = [(i, "\n".join(rnd.choices(pool, k=rnd.randrange(1, 30)))) for i in range(150)]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted(slow_line_dedup(rows))


def test_line_dedup_long_text(spark):
    text = "\n".join(f"line {i % 5000} of a text" for i in range(200000))
    out = line_dedup.line_dedup(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert [tuple(r) for r in out.select("n_lines", "n_removed").collect()] == [(200000, 195000)]


def test_language_id(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.language_id(pages).join(pages.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.97
    rows = language_id.language_id(pages.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.lit(None)).otherwise(F.lit("12 %%")).alias("text"), "lang")).select("lang_pred", "score").distinct().collect()
    assert [(r.lang_pred, r.score) for r in rows] == [("und", 0.0)]


def test_codewords_differ():
    for n in (2, 3, 4, 7, 8, 40):
        code = language_id.codewords(n)
        assert len({tuple(r) for r in code.tolist()}) == n
        assert all(len(set(c)) == 2 for c in code.T.tolist())


PAGE = '<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/">Menu</a></li></ul></nav><div class="cookie-notice">We use, cookies, of course, and more of them</div><article><h1>Big &amp; small&nbsp;head</h1><p>One, two,\n three   words and so on for a while.<p>Second <b>bold</b> paragraph, which is long enough.<br>After</p><ul><li>Item</li></ul></article><div id="comments"><p>Nice article, really, I mean it, thanks a lot, bye, and so on, and on</p></div><footer>&copy; me</footer>'


def test_html():
    assert html_extract.main_text(PAGE) == "Big & small head\nOne, two, three words and so on for a while.\nSecond bold paragraph, which is long enough. After\nItem"
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<script>x</script>") == ""
    assert html_extract.main_text("plain &lt;text") == "plain <text"
    assert html_extract.main_text("<div>" * 3000 + "deep") == "deep"


LONG = "One, two, three words, and so on, for quite a while, until the paragraph is long enough to count as running text."
INNER = f"<h1>Head</h1><div class='content'>{f'<p>{LONG}</p>' * 6}</div><h2>More</h2><p>Short.</p><section><ul><li>Item</li></ul></section>"
WHOLE = "\n".join(["Head", *[LONG] * 6, "More", "Short.", "Item"])


@pytest.mark.parametrize("around", ["<article>{}</article>", "<main><div>{}</div></main>", "<div class='post'>{}</div>", "<div class='container has-sidebar'><article>{}</article><div class='sidebar'><p>Aside</p></div></div>", "<div class='social-science'><div class='with-menu'>{}</div></div>", "<div class='comments-open'>{}</div>"])
def test_html_keeps_the_article(around):
    page = "<body><nav>Menu</nav>" + around.format(INNER) + "<div class='comments'><p>Nice, really, thanks</p></div><footer>me</footer></body>"
    assert html_extract.main_text(page) == WHOLE


PARAGRAPHS = "<p>The quick brown fox, jumped over the lazy dog, and then went on for a while.</p><p>Another paragraph, that is long enough, to count as text.</p>"


@pytest.mark.parametrize("around", ["<div class='content no-sidebar'>{}</div>", "<div class='with-sidebar'>{}</div>", "<div class='layout has-banner'>{}</div>", "<div class='post share'>{}</div>", "<form><input>{}<button>Go</button></form>", "<article><header><h1>Head</h1><p>By me</p></header>{}</article>"])
def test_html_wrappers(around):
    want = [x for x in ["Head"] if x in around] + re.findall("<p>(.*?)</p>", PARAGRAPHS)
    assert html_extract.main_text(f"<body><header><h1>Site</h1></header>{around.format(PARAGRAPHS)}<form><p>Search, here, now</p></form></body>") == "\n".join(want)


@pytest.mark.parametrize("page", ["<blockquote>" * 20000 + PARAGRAPHS + "</blockquote>" * 20000, "<div>" * 20000 + PARAGRAPHS + "</span>" * 20000, "<b><article>" + "<i>" * 20000 + PARAGRAPHS + "</b>" * 20000])
def test_html_deep_pages_take_linear_time(page):
    began = time.time()
    assert html_extract.main_text(page) == "\n".join(re.findall("<p>(.*?)</p>", PARAGRAPHS))
    assert time.time() - began < 5


def test_html_long_comments_stay_cut():
    page = f"<div><p>{LONG}</p></div><div class='comments'>{f'<p>{LONG} Reply</p>' * 9}</div>"
    assert html_extract.main_text(page) == LONG


def test_html_pages(spark):
    got = html_extract.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    assert all(r.n_chars == len(r.text) and "track(" not in r.text and "©" not in r.text for r in got)
    odd_pages = spark.createDataFrame([(1, None), (1, None), (None, "<p>x")], "page_id long, html string")
    assert sorted((r.page_id or 0, r.text) for r in html_extract.extract(odd_pages).collect()) == [(0, "x"), (1, ""), (1, "")]


def test_passages(spark):
    passage = prose(50, 70)
    words = passage.split()
    fuzzy = " ".join("zz" if i % 23 == 5 else w for i, w in enumerate(words) if i % 31 != 9)
    rows = [(1, f"{prose(51, 200)} {passage} {prose(52, 90)}"), (2, f"{prose(53, 30)} {passage}"), (3, f"{fuzzy} {prose(54, 300)}"), (4, prose(55, 500)), (5, prose(56, 80)), (6, prose(56, 80)), (7, None), (8, " ".join(words[:20])), (9, "of " * 60 + prose(57, 40)), (10, prose(58, 40) + " of" * 60)]
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    seen = {r.doc_id for r in got} | {r.partner_id for r in got}
    assert seen == {1, 2, 3, 5, 6}  # a word again and again (9, 10) is no passage
    whole = next(r for r in got if r.doc_id == 2 and r.partner_id == 1)
    assert (whole.start, whole.n_words, whole.partner_start, whole.identity) == (30, 70, 200, 1.0)
    assert next(r for r in got if r.doc_id == 6).class_id == 5


def test_passages_lose_no_link(spark):
    """Pairs that share a passage whose thirds each also stand in a lower and in a higher document."""
    rows, pairs = [], []
    for k in range(20):
        thirds = [prose(2000 + 3 * k + i, 26) for i in range(3)]
        pairs.append((1000 + 2 * k, 1001 + 2 * k))
        rows += [(i, f"{prose(3000 + i, 40)} {' '.join(thirds)} {prose(4000 + i, 40)}") for i in pairs[-1]]
        rows += [(base + 3 * k + i, f"{prose(5000 + base + 3 * k + i, 30)} {t} {prose(7000 + base + 3 * k + i, 30)}") for i, t in enumerate(thirds) for base in (0, 5000)]
    got = {frozenset((r.doc_id, r.partner_id)) for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {frozenset(p) for p in pairs}


def test_passages_odd_ids(spark):
    """Repeats inside a text, texts without ids, different texts under one id, equal rows, other columns."""
    a, b, c = prose(61, 70), prose(62, 70), prose(63, 70)
    rows = [(1, f"{prose(64, 30)} {a} {prose(65, 50)} {a} {prose(66, 20)}"), (None, f"{b} {prose(67, 30)}"), (None, f"{prose(68, 30)} {b}"), (4, f"{prose(69, 10)} {c}"), (4, f"{c} {prose(70, 10)}"), (5, prose(71, 90)), (5, prose(71, 90)), (6, prose(72, 300)), (None, None), (7, ""), (8, prose(73, 60)), (None, prose(73, 60))]
    got = substring_dedup.repeated_passages(clashing(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    found = {(r.doc_id or 0, r.partner_id or 0) for r in got}
    assert found == {(1, 1), (0, 0), (4, 4), (0, 8)}
    inside = next(r for r in got if r.doc_id == 1)
    assert (inside.start, inside.n_words, inside.partner_start) in ((150, 70, 30), (30, 70, 150))
    assert {(r.start, r.n_words) for r in got if r.doc_id is None and r.partner_id is None} == {(0, 70), (30, 70)}
    assert substring_dedup.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_passages_brute_force(spark):
    """Every exact passage between texts over the smallest table: found in both, by plain search of 45-word runs."""
    docs = [(i, f"{prose(8000 + i, 60)} {prose(9000 + i % 17, 45 + i % 7)} {prose(8500 + i, 60)}") for i in range(60)]
    runs = {}
    for i, t in docs:
        w = t.split()
        for k in range(len(w) - 44):
            runs.setdefault(tuple(w[k : k + 45]), set()).add(i)
    want = {i for held in runs.values() if len(held) > 1 for i in held}
    got = substring_dedup.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} | {r.partner_id for r in got} == want
    text = {i: t.split() for i, t in docs}
    for r in got:
        a, b = text[r.doc_id][r.start : r.start + r.n_words], text[r.partner_id][r.partner_start : r.partner_start + r.n_words]
        assert r.identity == 1.0 and a == b


def parts(nodes, edges):
    """Sets of nodes that edges connect."""
    root = {x: x for x in nodes}
    for a, b in edges:
        low, high = sorted((root[a], root[b]))
        root = {x: low if r == high else r for x, r in root.items()}
    return {frozenset(x for x in nodes if root[x] == r) for r in root.values()}


@pytest.mark.parametrize("size", [20, 80])
def test_passages_of_edited_copies(spark, size):
    """Copies of a passage, each edited apart in 5 % of its words: all members are found, a group is one part."""
    rnd, rows, group = random.Random(size), [], {}
    for i in range(160):
        words = [f"e{rnd.randrange(10**6)}" if rnd.random() < 0.05 else w for w in prose(9900 + i // size, 60).split()]
        group.setdefault(i // size, set()).add(i)
        rows.append((i, f"{prose(20000 + i, 30)} {' '.join(words)} {prose(30000 + i, 30)}"))
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    edges = {(r.doc_id, r.partner_id) for r in got}
    assert len({r.doc_id for r in got}) >= 0.98 * len(rows)
    assert edges == {(b, a) for a, b in edges}
    assert {p for p in parts(range(160), edges) if len(p) > 1} <= {p for p in parts(range(160), edges) if len(p) >= 0.98 * size}
    assert all(a // size == b // size for a, b in edges)


@pytest.mark.parametrize("bent", [False, True])
def test_connected_loses_no_link(bent):
    """Parts are those of a brute force over all pairs; blocks compared apart give the same; also with words left out."""
    rnd = random.Random(5)
    K, reach, width = substring_dedup.K, substring_dedup.REACH, substring_dedup.WIDTH
    rows = []
    for i in range(90):
        line = random.Random(i % 5).sample(range(1, 10**6), width)
        left, seed, right = line[:reach], list(range(1, K + 1)), line[reach + K :]
        edit = lambda x, near: [w if k < near else rnd.randrange(1, 10**6) if rnd.random() < 0.18 else w for k, w in enumerate(x)]
        short = rnd.choice([8, 16, 60])  # some share a line alone
        left, right = edit(left[::-1], 4)[::-1], edit(right, 4)[:short] + [rnd.randrange(1, 10**6) for _ in right[short:]]
        if bent and i % 2:
            del right[6]
            right.append(rnd.randrange(1, 10**6))
        rows.append(left + seed + right)
    win, doc, pos = np.array(rows, np.int32), np.arange(90), np.full(90, 100, np.int32)
    grams = [[tuple(r[p : p + K]) for p in range(width - K + 1)] for r in rows]

    def linked(i, j):
        if substring_dedup.passages(win[i], win[j], [reach], [reach], None):
            return True
        runs = [(p, o) for p, k in enumerate(grams[i]) for o, m in enumerate(grams[j]) if k == m]
        return any(e - s >= 40 and m >= 0.8 * (e - s) for c in substring_dedup.chains(*zip(*runs, strict=True)) for s, e, _, m in [substring_dedup.align(win[i], win[j], [runs[k][0] for k in c], [runs[k][1] for k in c])]) if runs else False

    want = parts(range(90), [(i, j) for i in range(90) for j in range(i) if linked(i, j)])
    assert 5 <= len(want) < 90 and sum(len(p) > 2 for p in want) > 2
    whole = substring_dedup.connected(doc, pos, win)
    side = doc % 2 == 1
    dealt = [x for keep in (side, ~side) for x in substring_dedup.connected(doc[keep], pos[keep], win[keep])] + substring_dedup.connected(doc, pos, win, side)
    for got in (whole, dealt):
        assert parts(range(90), [(a, b) for a, _, b, _ in got]) == want


def test_connected_ends_with_the_text():
    """Places beyond two short texts are no common words: 37 words with one more in between are no passage of 40."""
    K, reach, width = substring_dedup.K, substring_dedup.REACH, substring_dedup.WIDTH
    words = list(range(1, 38))
    rows = [[0] * reach + w + [0] * (width - reach - len(w)) for w in (words, words[: K + 8] + [99] + words[K + 8 :])]
    for other_side in (None, np.array([False, True])):
        assert substring_dedup.connected(np.arange(2), np.zeros(2, np.int32), np.array(rows, np.int32), other_side) == []


def test_connected_aligns_few(monkeypatch):
    """A line that stands twice, at distances that differ, is no reason to align all pairs of its places."""
    rnd = random.Random(6)
    reach, width = substring_dedup.REACH, substring_dedup.WIDTH
    line, calls, bent = rnd.sample(range(1, 10**6), 12), [], substring_dedup._bent
    monkeypatch.setattr(substring_dedup, "_bent", lambda *x: calls.append(1) or bent(*x))
    rows = []
    for i in range(60):
        row = [rnd.randrange(1, 10**6) for _ in range(width)]
        row[reach : reach + 12] = line
        row[50 + i % 10 : 62 + i % 10] = line
        rows.append(row)
    assert substring_dedup.connected(np.arange(60), np.zeros(60, np.int32), np.array(rows, np.int32)) == []
    assert not calls


def test_windows_where_passages_can_be():
    """A period of words around a place leaves no passage; 40 words that count do, also beside a period."""
    width = substring_dedup.WIDTH
    rows = [[1, 2] * (width // 2) + [1], [0] * 36 + list(range(1, width - 35)), [5] * 35 + list(range(10, 50)), [5] * 45 + list(range(10, 40))]
    assert substring_dedup._lively(np.array(rows, np.int32)).tolist() == [False, True, True, False]


def test_connections_over_blocks(spark, monkeypatch):
    """Blocks of few places connect what one block does."""
    rnd = random.Random(8)
    width = substring_dedup.WIDTH
    lines = [rnd.sample(range(1, 10**6), width) for _ in range(4)]
    rows = [(s, 50, 50 * s + i, 7, [w if k < 15 or rnd.random() > 0.1 else rnd.randrange(1, 10**6) for k, w in enumerate(lines[(i + s) % 4])]) for s in range(3) for i in range(50)]
    df = spark.createDataFrame(rows, "seed long, n long, doc long, pos int, win array<int>")
    want = parts(range(150), [(r.doc, r.partner) for r in substring_dedup.connections(df).collect()])
    monkeypatch.setattr(substring_dedup, "BLOCK", 9)
    assert parts(range(150), [(r.doc, r.partner) for r in substring_dedup.connections(df).collect()]) == want
    assert len(want) == 12


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_links_over_partitions(spark, adaptive):
    """Each place is linked to the one before it and to a closer one after it, also over the edges of partitions."""
    rnd = random.Random(9)
    rows = sorted({(rnd.randrange(6), rnd.randrange(3), rnd.randrange(3), rnd.randrange(9), rnd.randrange(9)) for _ in range(120)})
    share = lambda x, y: next((i for i in range(3) if x[i] != y[i]), 3)
    must = {(y[3:], x[3:], share(x, y) > 2) for x, y in zip(rows, rows[1:], strict=False) if share(x, y)}
    df = spark.createDataFrame(rows, "seed long, near int, far int, doc long, pos int")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)  # without it the rows stay in several partitions
    try:
        got = {((r.doc, r.pos), (r.partner, r.other), r.strong) for r in substring_dedup.links(df).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    both = must | {(b, a, s) for a, b, s in must}
    assert must <= got <= both
    for x, y, z in zip(rows, rows[1:], rows[2:], strict=False):
        if share(y, z) > share(x, y):
            assert (y[3:], z[3:], share(y, z) > 2) in got


def test_chains_rise_in_both():
    rnd = random.Random(4)
    for _ in range(50):
        pos, other = [rnd.randrange(60) for _ in range(12)], [rnd.randrange(60) for _ in range(12)]
        used = [i for c in substring_dedup.chains(pos, other) for i in c]
        assert len(used) == len(set(used))
        for c in substring_dedup.chains(pos, other):
            assert all(pos[a] < pos[b] and other[a] < other[b] for a, b in zip(c, c[1:], strict=False))


def test_neighbours(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    x = df.toPandas()
    vec, ids = np.array(x.embedding.tolist(), float), x.vec_id.to_numpy()
    got = ann.search(df).toPandas()
    hit = 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((vec - vec[ids == q][0]) ** 2).sum(axis=1))
        g = g.sort_values("rank")
        assert np.allclose(g.score, [d[ids == i][0] for i in g.vec_id]) and q not in set(g.vec_id)
        d[ids == q] = np.inf
        hit += len(set(ids[np.lexsort((ids, d))[:10]]) & set(g.vec_id))
    assert hit >= 0.9 * 10 * got.query_id.nunique()


@pytest.mark.parametrize("recall", [0.97, 0.3, 0.0])
def test_neighbours_whole(spark, monkeypatch, recall):
    """Each query row has k rows, or all candidates, however few leaves it visits; repeated rows are rows like others."""
    monkeypatch.setattr(ann, "RECALL", recall)
    x = np.random.default_rng(1).normal(size=(3000, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows + 20 * rows[:50] + [(0, rows[7][1])], "vec_id long, embedding array<double>")
    out = ann.search(df, every=50)
    got = out.groupBy("query_id").agg(F.count("*").alias("n"), F.max("rank").alias("last")).collect()
    assert {(r.query_id, r.n, r["last"]) for r in got} == {(i, 10 if i else 220, 10) for i in range(0, 3000, 50)}
    copies = out.where("query_id = 0 and vec_id = 0 and score = 0").groupBy("rank").count().collect()
    assert {r["rank"]: r["count"] for r in copies} == {i: 21 for i in range(1, 11)}  # 20 copies each, the tenth rank is one too
    few = ann.search(spark.createDataFrame(rows[:8], "vec_id long, embedding array<double>"), every=1)
    assert [r["count"] for r in few.groupBy("query_id").count().collect()] == [7] * 8


def test_neighbours_repeats_brute_force(spark):
    """Repeated ids and vectors, two lengths, clashing columns: all rows against plain distances."""
    rnd = np.random.default_rng(5)
    x = rnd.integers(-3, 4, (120, 3)).astype(float)
    rows = [(int(i), x[k].tolist()) for k, i in enumerate(rnd.integers(0, 60, 120))] + [(1, [5.0, 5.0, 5.0])] * 3 + [(7, [1.0]), (10, [2.0]), (11, [4.0]), (None, [1.0, 1.0, 1.0])]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted((r.query_id, r["rank"], round(r.score, 9)) for r in ann.search(df, every=10).collect())
    want = []
    for k, (i, v) in enumerate(rows):
        if i is not None and i % 10 == 0 and any(v):
            d = sorted(float(np.linalg.norm(np.array(v) - w)) for j, (o, w) in enumerate(rows) if j != k and o is not None and len(w) == len(v) and any(w))[:10]
            want += [(i, n + 1, round(e, 9)) for n, e in enumerate(d)]
    assert got == sorted(want)


def test_neighbours_odd(spark):
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (200, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, [None, 1.0]), (5, [2.0, 0.0]), (6, [2.0, 0.0]), (7, [1.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 100, 0.0), (0, 2, 5, 1.0), (0, 3, 6, 1.0), (100, 1, 0, 0.0), (100, 2, 5, 1.0), (100, 3, 6, 1.0)]
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_pipeline_stages(spark):
    """Each stage gets all that the one before kept, with columns of any name; only what a stage decides on is missing after it."""
    docs = clashing(spark.read.parquet(f"{SF}/documents.parquet")).withColumns({"n_removed": F.lit("x"), "n_lines": F.lit("y"), "gone": F.lit(0), "doc": F.lit(0), "own": F.lit(0)})
    docs = docs.union(odd(spark).select(*[F.col(c) if c in ("doc_id", "text", "lang", "source", "n_chars") else F.lit("x" if c in ("n_removed", "n_lines") else 1).alias(c) for c in docs.columns]))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        if name == "mixing":
            assert out.columns == [c for c in docs.columns if c not in ("size", "target")] + ["size", "source_size", "target", "taken"]
            all_rows = mixing.mix(docs).collect()
            assert sorted((r.doc_id or 0, r.taken) for r in rows) == sorted((r.doc_id or 0, r.taken) for r in all_rows if r.taken > 0)
            assert all(r.text is not None and len(r.text.split()) == r["size"] for r in rows)
            break
        assert out.columns == docs.columns and all(r.n_removed == "x" for r in rows)
        if name == "line_dedup":
            assert len(rows) == docs.count()
        assert len(rows) >= 0.7 * docs.count()
        docs = spark.createDataFrame(rows, docs.schema)


def test_mixing_odd_rows(spark):
    """Null ids, null sources beside a source named like one, equal rows."""
    rows = [(None, prose(i, 50), None if i % 3 else "\x00") for i in range(60)] + [(5, prose(99, 400), "b")] * 7 + [(6, "", "b"), (7, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).groupBy("source_size").agg(F.first("target").alias("target"), F.sum("taken").alias("taken"), F.count("*").alias("n")).collect()
    assert {(r.source_size, r.n) for r in got} == {(1000, 20), (2000, 41), (2800, 8)}
    assert all(abs(r.taken - r.target) <= 2 * mixing.BLOCK for r in got)
    kept = mixing.mixed(docs)
    assert kept.columns == ["doc_id", "text", "source", "size", "source_size", "target", "taken"]
    assert kept.count() == mixing.mix(docs).where("taken > 0").count() > 60


def test_pipeline_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100


def test_near_copies_of_odd_ids(spark):
    """Null and repeated ids: one row of each group, whatever the ids and the order of the rows."""
    rows = [(None, prose(300, 40)), (None, prose(301, 40)), (5, prose(302, 40)), (5, prose(303, 40)), (None, prose(302, 40)), (5, prose(303, 40)), (9, prose(301, 40)), (8, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", None, 1) for i, t in rows] + [(5, prose(303, 40), None, "en", 1)], DOCS)
    want = sorted([(0, prose(300, 40)), (9, prose(301, 40)), (5, prose(302, 40)), (5, prose(303, 40)), (8, "")])
    outs = [sorted(corpus_pipeline.drop_near_copies(spark, d, SF).collect(), key=str) for d in (docs, docs.orderBy(F.desc("text")).repartition(3))]
    assert sorted((r.doc_id or 0, r.text or "") for r in outs[0]) == want
    assert outs[0] == outs[1]


def slow_line_dedup(rows):
    """(id, text) without later repeated windows: least runs of 40 characters or 4 lines, from either end."""
    lines = {r: (r[1] or "").split("\n") for r in set(rows)}
    places = {}
    for r, x in lines.items():
        kept = [i for i, line in enumerate(x) if line.strip(" \t\n\v\f\r")]
        text = [x[i].strip(" \t\n\v\f\r") for i in kept]
        enough = lambda a, b: b - a == 4 or sum(map(len, text[a:b])) >= 40
        ahead = {(a, next((b for b in range(a + 1, len(text) + 1) if enough(a, b)), None)) for a in range(len(text))}
        back = {(next((a for a in range(b - 1, -1, -1) if enough(a, b)), None), b) for b in range(1, len(text) + 1)}
        for a, b in ahead | back:
            if a is not None and b is not None:
                places.setdefault(tuple(text[a:b]), []).append((r[0] is None, r[0] or 0, kept[a], r, kept[a:b]))
    gone = {r: set() for r in lines}
    for p in places.values():
        for *_, r, at in sorted(p, key=lambda x: x[:3])[1:]:
            gone[r].update(at)
    return [(r[0], None if r[1] is None else "\n".join(x for i, x in enumerate(lines[r]) if i not in gone[r])) for r in rows]


def test_pipeline_run_brute_force(spark, tmp_path):
    """All five stages on a small corpus with null and repeated ids, held against plain code."""
    item = prose(400, 30)
    rows = [(i, prose(5000 + i, 14) + (" vilehead" if i % 3 == 0 else " kindly")) for i in range(600)]
    run = f"{prose(401, 12)}\n{prose(402, 12)}"
    rows += [(i, f"{prose(700 + i, 50)} kindly\n{run}\n{prose(800 + i, 50)}") for i in range(700, 706)]
    rows += [(None, prose(900, 50) + " kindly"), (None, prose(901, 50) + " kindly"), (7, prose(902, 50) + " kindly"), (800, prose(902, 50) + " kindly"), (801, f"{prose(903, 50)} {item} kindly"), (None, item), (802, None), (803, "")]
    docs = spark.createDataFrame([(i, t, "en", "ab"[k % 2], len(t or "")) for k, (i, t) in enumerate(rows)], DOCS)
    lab = spark.createDataFrame([(i, 0, int(i % 3 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    items = bench(spark, [(1, item), (2, prose(404, 30))])
    for name, df in (("documents", docs), ("labels", lab), ("benchmark", items)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    model = toxicity.train(docs, lab)
    left = slow_line_dedup([r for r in rows if model.score(r[1]) < 0.5])
    root = brute_components(np.array([slow_fingerprint(t) for _, t in left], np.uint64))
    first = {}
    for r, g in zip(left, root, strict=True):
        first[g] = min(first.get(g, r), r, key=lambda r: (r[0] is None, r[0] or 0))
    segments = [t[p : p + 80] for t in (item, prose(404, 30)) for p in {*range(0, len(t) - 80, 10), len(t) - 80}]
    clean = [r for r in first.values() if all(plain_edits(s, " ".join((r[1] or "").lower().split())) > 6 for s in segments)]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.text) for r in got} <= set(clean) and all(r.taken > 0 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source, [r.source_size, r.target, 0])[2] += r.taken
    assert sum(size for size, _, _ in by.values()) == sum(len((t or "").split()) for _, t in clean)
    assert all(abs(taken - target) <= 2 * mixing.BLOCK for _, target, taken in by.values())
    assert 300 < len(clean) < 450 and len(got) > 0.6 * len(clean)


def test_passages_with_a_single_common_seed(spark):
    """Passages edited so that two texts share one seed alone, with other words within the next 32, are found, also over a gap."""
    rnd = random.Random(17)
    word = lambda: f"w{rnd.randrange(10**9)}"

    def seeds(text):
        h = next(substring_dedup.word_hashes(pa.array([text])))[2]
        return set(substring_dedup._seeds_of(h, np.array([0, len(h)]))[0].tolist())

    texts, found = [], 0
    while found < 12:
        bent = found % 2 == 1
        passage = [word() for _ in range(46)]
        edited = [w if 18 <= i < 28 or i % 5 else word() for i, w in enumerate(passage)]
        if bent:
            edited = [*edited[:30], word(), *passage[30:37], *edited[37:]]
        pair = [" ".join([word() for _ in range(30)] + p + [word() for _ in range(30)]) for p in (passage, edited)]
        if len(seeds(pair[0]) & seeds(pair[1])) == 1:
            texts += pair
            found += 1
    got = substring_dedup.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(r.doc_id, r.partner_id) for r in got} == {(i, i ^ 1) for i in range(len(texts))}
    assert all(r.n_words >= 40 and r.identity >= 0.8 for r in got)
