"""Token alignment, source audit and chat formatting against plain code, odd rows and round trips."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliospark.llm import chat_format, queries, source_audit, token_align

from ..conftest import SF
from .test_ops import DOCS, clashing, odd

PATH = token_align.VOCABULARIES


@given(st.sets(st.integers(0, 3000), min_size=1), st.sets(st.integers(0, 3000)), st.integers(2, 9))
@settings(max_examples=60, deadline=None)
def test_gallop(some, more, steps):
    short = np.array(sorted(some), np.int64)
    long = np.array(sorted(more | {max(some)} if not more or max(more) < max(some) else more), np.int64)
    assert token_align.gallop(short, long, steps).tolist() == np.searchsorted(long, short).tolist()


def slow_tokens(texts):
    """(A ids, A bytes, B ids, B bytes) of each text, by the libraries' own files; None where the contract has no tokens."""
    hf = Tokenizer.from_file(f"{PATH}/{token_align.BYTE_BPE}")
    hf.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=f"{PATH}/{token_align.PIECE_BPE}")
    byte_of = token_align._byte_of()
    for text in texts:
        a, b = hf.encode(" " + (text or ""), add_special_tokens=False), sp.encode(text or "")
        in_a = [bytes(byte_of[c] for c in t) for t in a.tokens]
        in_b = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, sp.id_to_piece(i)) for i in b)]
        whole = b" " + (text or "").encode()
        yield (a.ids, in_a, b, in_b) if text and b"".join(in_a) == whole == b"".join(in_b) else None


def slow_alignment(tokens):
    """Groups as text, links."""
    a, in_a, b, in_b = tokens
    ends = {sum(map(len, in_a[: i + 1])): i for i in range(len(a))} if len(a) < 300 else {int(e): i for i, e in enumerate(np.cumsum([len(t) for t in in_a]))}
    groups, links, from_a, from_b = [], [], 0, 0
    for j, e in enumerate(np.cumsum([len(t) for t in in_b])):
        if (i := ends.get(int(e))) is not None:
            groups.append(f"{','.join(map(str, a[from_a : i + 1]))}|{','.join(map(str, b[from_b : j + 1]))}")
            links.append((a[i], b[j]))
            from_a, from_b = i + 1, j + 1
    return ";".join(groups), links


ODD = ["", None, " ", "a", "▁ lower block", "<|endoftext|> </s> <s>", "漢字 ﷽ 🙂🙂", "\x00 null", "  two  spaces \n\n", "é" * 50, "x" * 40000, "it's we'll", "1234567890 3.14"]


def test_links_brute_force(spark):
    texts = ODD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + ODD[4:8]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want, counts = {}, Counter()
    for k, tokens in enumerate(slow_tokens(texts)):
        want[k] = None if tokens is None else (len(tokens[0]), len(tokens[2]), *slow_alignment(tokens))
        counts.update(want[k][3] if want[k] else ())
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    got = token_align.link_figures(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        if want[r.doc_id] is None:
            assert tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "")
        else:
            n_a, n_b, groups, links = want[r.doc_id]
            assert tuple(r)[1:] == (n_a, n_b, len(links), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(groups.encode()).hexdigest())


def test_tiles_do_not_change_figures(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = token_align.link_figures(docs).collect()
    monkeypatch.setattr(token_align, "TILE", 100)
    monkeypatch.setattr(token_align, "SLICE", 5000)
    assert sorted(token_align.link_figures(docs).collect()) == sorted(one)


def test_align_overlaps(spark):
    texts = [t for t in ODD if t and len(t) < 1000]
    rows = token_align.align(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r, tokens in zip(sorted(rows), slow_tokens(texts), strict=True):
        if tokens is None:
            assert r.a_ids == r.b_ids == r.first == []
            continue
        a, in_a, b, in_b = tokens
        assert (r.a_ids, r.b_ids) == (a, b)
        short, long = (in_b, in_a) if r.shorter == "b" else (in_a, in_b)
        assert len(short) <= len(long)
        at, ends = np.cumsum([0, *map(len, short)]), np.cumsum([0, *map(len, long)])
        for k in range(len(short)):
            held = [j for j in range(len(long)) if ends[j] < at[k + 1] and ends[j + 1] > at[k]]
            assert (r.first[k], r.last[k]) == (held[0], held[-1])


def test_align_odd_rows(spark):
    assert token_align.link_figures(clashing(odd(spark))).count() == 8
    assert token_align.link_figures(odd(spark).where("false")).count() == 0
    assert token_align.align(clashing(odd(spark))).count() == 8


def slow_audit(rows, least, listed):
    import re

    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        held = Counter(t for g, _, ts in docs if g == lang for t in set(ts))
        kept = {t for t, n in held.items() if n >= least}
        counts = defaultdict(Counter)
        for g, s, ts in docs:
            if g == lang:
                counts[s].update(t for t in ts if t in kept)
        every = sum(counts.values(), Counter())
        share = lambda c, t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))
        for s in counts:
            pairs = [(-sum(abs(share(counts[s], t) - share(counts[o], t)) for t in kept), o.encode(), o) for o in counts if o != s]
            terms = [(share(every, t) - share(counts[s], t), t.encode(), t) for t in counts[s] if share(counts[s], t) > share(every, t)]
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(sorted(pairs))]
            out += [(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(sorted(terms)[:listed])]
    return sorted(out)


@pytest.mark.parametrize("bits", [64, 5])
def test_audit_brute_force(spark, monkeypatch, bits):
    """Also with digests of 5 bits, where all terms collide, and in blocks of few cells."""
    monkeypatch.setattr(source_audit, "CELLS", 40)
    rows = [("Ab ab c É_x 1 d", "en", "s"), ("ab C é", "en", None), (None, "en", "empty"), ("", None, None), ("x y z x", "de", "s"), ("x Y", "de", "t"), ("q", "fr", "alone")] * 3
    rows += [(" ".join(f"t{chr(97 + (i * k) % 17)}" for k in range(i % 9)), "en" if i % 3 else "de", f"s{i % 5}") for i in range(60)]
    docs = spark.createDataFrame([(i, *r, 1) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(map(tuple, source_audit.audit(clashing(docs), least=3, listed=4, bits=bits).collect())) == slow_audit(rows, 3, 4)


def test_audit_odd(spark):
    got = source_audit.audit(clashing(odd(spark)))
    assert {(r.lang, r.source, r.item, r.value) for r in got.collect()} == {("en", "a", "b", 0), ("en", "b", "a", 0)}
    assert source_audit.audit(spark.createDataFrame([], DOCS)).count() == 0


TURNS = "conv_id long, turn int, role string, text string"
CONTROL = ["<|start|>", "<|text|>", "<|end|>", "</s>", "[INST]", "[/INST]", "<", "|", "", "[", "\n", "a", "é", "🙂", "$1", "\\"]


@given(st.lists(st.lists(st.sampled_from(CONTROL), max_size=12).map("".join), min_size=1, max_size=20))
@settings(max_examples=8, deadline=None)
def test_escapes_are_reversible(spark, texts):
    t = chat_format.Template()
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    for r in df.select("text", t.escaped(F.col("text")).alias("e"), t.unescaped(t.escaped(F.col("text"))).alias("back")).collect():
        assert r.back == r.text
        assert not any(c in r.e for c in (t.start, t.text, t.end, *t.others))


def conversations(spark):
    words = "one two three four five six seven eight nine ten".split()
    rows = [(1, k, "system" if k == 0 else ("user", "assistant")[k % 2 - 1], " ".join(words * (k % 7))) for k in range(60)]
    rows += [(2, 0, "assistant", "<|end|><|start|>user<|text|>"), (2, 1, "system", "late"), (2, 1, None, None), (2, None, "user\n", "first")]
    rows += [(3, 0, "system", "alone"), (None, 0, "user", "x"), (None, 1, "assistant", "y"), (4, 0, "user", "long " * 3000), (4, 1, "assistant", "ok"), (4, 1, "assistant", "ok")]
    return rows, spark.createDataFrame(rows, TURNS)


@pytest.mark.parametrize(("budget", "history"), [(1024, 256), (60, 25), (8, 100), (100, 0)])
def test_windows(spark, budget, history):
    rows, df = conversations(spark)
    windows = chat_format.windows(clashing(df), budget, history)
    got = {r.conv_id: r for r in chat_format.digests(windows).collect()}
    of = defaultdict(list)
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        of[c].append((role or "", text or ""))
    assert set(got) == set(of)
    for c, turns in of.items():
        loss = "".join(x for role, x in turns if role == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert tuple(got[c])[:5] == (c, len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss)), c
    size = chat_format.byte_tokenizer(token_align.content(PATH, token_align.BYTE_BPE))[0]
    for w in windows.collect():
        pieces = ["<|start|>" + p for p in w.formatted.split("<|start|>")[1:]]
        assert (len(pieces), sum(len(size.encode_ordinary(p)) for p in pieces)) == (w.n_turns, w.n_tokens)
        system = w.conv_id in (1, 3) and w.window > 0
        assert w.n_tokens <= budget or w.n_turns - w.n_repeated == 1 and w.n_repeated <= system or w.window == 0 and w.n_turns == 2
        assert sum(len(size.encode_ordinary(p)) for p in pieces[system : w.n_repeated]) <= history
        if w.conv_id == 1:
            assert pieces[0].startswith("<|start|>system")


def test_chat_query_and_empty(spark):
    got = queries.QUERIES["op13_chat_format"](spark, SF)
    assert got.where("conv_id = -1").first().loss_chars == 21
    assert got.count() == 1 + spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count()
    assert chat_format.digests(chat_format.windows(spark.createDataFrame([], TURNS))).count() == 0


def test_template_refuses_ambiguous_controls():
    with pytest.raises(ValueError):
        chat_format.Template(others=("<<SYS>>", "<SYS>>"))
