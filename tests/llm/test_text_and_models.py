"""Text kernels, byte models, LM scoring and quality rules against plain Python."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataql.llm import ngram_model as M
from strataql.llm import textbatch as T
from strataql.llm.lm_score import crc_mod, lm_score
from strataql.llm.quality_rules import form_counts, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="abA \n\té#|\x0b\x85", max_size=80)), max_size=12)


@pytest.fixture(params=[1 << 20, 37])
def block(request, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", request.param)


def agree(found, expected):
    """Equal keys just where values are equal."""
    assert len(found) == len(expected)
    assert len(set(zip(found.tolist(), expected, strict=True))) == len(set(expected)) == len(set(found.tolist()))


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_lines_and_windows(texts):
    for size in (1 << 20, 29):
        T.BLOCK = size
        data, offs = T.byte_view(pa.array(texts, pa.string()))
        hashes, row = T.words(data, offs)
        want = [(i, w) for i, t in enumerate(texts) for w in WORD.findall(t or "")]
        assert row.tolist() == [i for i, _ in want]
        agree(hashes, [w for _, w in want])
        hashes, row = T.lines_with_words(data, offs)
        want = [(i, x) for i, t in enumerate(texts) for x in (t or "").split("\n") if WORD.search(x)]
        assert row.tolist() == [i for i, _ in want]
        agree(hashes, [x for _, x in want])
    T.BLOCK = 1 << 20


def brute_form(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    cover = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab \n|é", max_size=120), max_size=8))
def test_form_counts(texts):
    got = form_counts(*T.byte_view(pa.array(texts, pa.string())))
    assert list(zip(*(v.tolist() for v in got.values()), strict=True)) == [brute_form(t) for t in texts]


def test_grams_come_alike_in_any_block(block):
    texts = ["", "ab", None, "é" * 60, "xyz" * 50]
    found = Counter()
    for keys, _, _ in T.grams(*T.byte_view(pa.array(texts)), 3):
        found.update(keys.tolist())
    want = Counter()
    for t in texts:
        b = b"\xff" * 3 + (t or "").encode() + b"\xff"
        want.update(int.from_bytes(b[i : i + 4], "big") for i in range(len(b) - 3))
    assert found == want


def shard_of(texts, order):
    counter = T.KeyCounter()
    for keys, _, _ in T.grams(*T.byte_view(pa.array(texts)), order):
        counter.add(keys)
    return M.Shard(M.Range(0, 0xFFFF), *counter.take())


def ppm(texts, order):
    s = shard_of(texts, order)
    return M.PPMTable(s, order, M._pair_table(*M._suffix_levels(s, order, False)[2]))


def kn(texts, order):
    s = shard_of(texts, order)
    levels = M._suffix_levels(s, order, True)
    pairs = M._pair_table(*levels[2])
    of = {k: np.bincount(np.minimum(levels[k][1], 5), minlength=6) for k in range(3, order + 2)}
    of[2], of[1] = np.bincount(np.minimum(pairs, 5), minlength=6), np.bincount(np.minimum((pairs.reshape(256, 256) > 0).sum(0), 5), minlength=6)
    return M.KNTable(s, order, pairs, of)


def brute_ppm(counts, context, symbol):
    """Method D with exclusion, from counts by context."""
    excluded, p = set(), 1.0
    for k in range(len(context), -1, -1):
        after = {s: n for s, n in counts.get(context[len(context) - k :], {}).items() if s not in excluded}
        if not after:
            continue
        total = 2 * sum(after.values())
        if symbol in after:
            return p * (2 * after[symbol] - 1) / total
        p *= len(after) / total
        excluded |= set(after)
    return p / (256 - len(excluded))


def test_ppm_equals_the_definition():
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abcd "), size=rng.integers(0, 40))) for _ in range(60)]
    order, counts = 3, {}
    for t in texts:
        b = b"\xff" * order + t.encode() + b"\xff"
        for i in range(order, len(b)):
            for k in range(order + 1):
                counts.setdefault(b[i - k : i], Counter())[b[i]] += 1
    table = ppm(texts, order)
    for context in (b"abc", b"zzz", b"zab", b"\xff\xff\xff", b"zz ", b"dda"):
        keys = np.array([int.from_bytes(context + bytes([x]), "big") for x in range(256)], np.uint64)
        got = 10 ** table.log10(keys)
        assert np.allclose(got, [brute_ppm(counts, context, x) for x in range(256)], rtol=1e-5)
        assert abs(got.sum() - 1) < 1e-5


def test_kneser_ney_sums_to_one_and_prefers_seen_text():
    texts = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog"] * 5
    table = kn(texts, 3)
    for context in (b"the", b"zzz", b"at "):
        keys = np.array([int.from_bytes(context + bytes([x]), "big") for x in range(256)], np.uint64)
        assert abs(np.exp(table.log(keys)).sum() - 1) < 1e-4
    score = lambda t: M.sums_by_row(table.log, table, *T.byte_view(pa.array([t])))[0][0] / len(t)
    assert score("the cat sat") > score("qzx jkv wpq")


ROWS = [(1, "the cat sat on the mat"), (2, "The DOG sat"), (3, None), (4, ""), (5, "zebra quagga " * 30), (6, "the cat sat on the mat"), (6, "the cat sat on the mat"), (7, "é ü cat"), (None, "the log")]


def docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("clash"), "key": F.lit(1), "uid": F.lit(2)})


def brute_kn(texts, order, context, symbol):
    """Interpolated modified Kneser-Ney from its definition: raw counts on top, distinct bytes before below."""
    grams = Counter()
    for t in texts:
        b = b"\xff" * order + t.encode() + b"\xff"
        grams.update(b[i - order : i + 1] for i in range(order, len(b)))
    levels = {order + 1: grams}
    for k in range(order, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])

    def probability(k, gram):
        if not k:
            return 1 / 256
        n = Counter(levels[k].values())
        if min(n[1], n[2], n[3], n[4]) > 0:
            y = n[1] / (n[1] + 2 * n[2])
            d = [0.0, *(min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05), i - 0.05) for i in (1, 2, 3))]
        else:
            d = [0.0, 0.5, 1.0, 1.5]
        below = probability(k - 1, gram[1:])
        after = {g[-1]: c for g, c in levels[k].items() if g[:-1] == gram[:-1]}
        if not after:
            return below
        total = sum(after.values())
        mine = after.get(gram[-1], 0)
        return max(mine - d[min(mine, 3)], 0) / total + sum(d[min(c, 3)] for c in after.values()) / total * below

    return probability(order + 1, context + bytes([symbol]))


@pytest.mark.parametrize("order", [2, 3])
def test_kneser_ney_equals_the_definition(order):
    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(list("abcde "), size=rng.integers(0, 30), p=[0.3, 0.25, 0.2, 0.1, 0.05, 0.1])) for _ in range(40)]
    table = kn(texts, order)
    for context in (b"abc", b"zzz", b"zab", b"\xff\xff\xff", b"de ", b"zza"):
        context = context[-order:]
        symbols = [*b"abcde z", 0xFF]
        keys = np.array([int.from_bytes(context + bytes([x]), "big") for x in symbols], np.uint64)
        assert np.allclose(np.exp(table.log(keys)), [brute_kn(texts, order, context, x) for x in symbols], rtol=1e-4)


@pytest.mark.parametrize("distinct", [False, True])
def test_a_hot_pair_of_bytes_is_divided(spark, distinct):
    """Shards of any size give each gram the same probability, each by one shard alone."""
    letters = "cdefghijklmnopqrstuv"
    texts = [f"{c}cab{d}" for c in letters for d in letters] + ["dab", "zz"]
    order = 4
    whole = (kn if distinct else ppm)(texts, order)
    counter = T.KeyCounter()
    for keys, _, _ in T.grams(*T.byte_view(pa.array(texts)), order):
        counter.add(keys)
    keys, n = counter.take()
    counts = spark.createDataFrame([(int(k), int(c)) for k, c in zip(keys, n, strict=True)], "key long, n long")
    assert any(r.depth == 3 for r in M.shard_ranges(counts, 150, order))
    strange = np.array([int.from_bytes(b, "big") for b in (b"zzabq", b"qzzzz", b"dcbaz", b"\xff\xff\xff\xffa")], np.uint64)
    asked = np.concatenate([keys, strange])
    met, got = np.zeros(len(asked), int), np.zeros(len(asked))
    for table in (M.kn_shards if distinct else M.ppm_shards)(counts, order, 150):
        own = table.range.own(asked)
        met += own
        got[own] = (table.log if distinct else table.log10)(asked[own])
        assert sum(own[: len(keys)]) <= 150
    assert (met == 1).all()
    assert np.allclose(got, (whole.log if distinct else whole.log10)(asked), atol=1e-5)


def test_quartiles_come_from_the_rows_alone(spark):
    from strataql.llm.quality_rules import quartiles

    cells = [("en", c, 1 + c % 3) for c in range(100)] + [(None, 7, 2)]
    got = {r["of"]: r.q for r in quartiles(spark.createDataFrame(cells, "of string, cell long, n long")).collect()}
    flat = sorted(c for _, c, n in cells[:100] for _ in range(n))
    want = [flat[-(-len(flat) * k // 4) - 1] for k in (1, 2, 3)]
    assert [round(x / 0.001 - 0.5) for x in got["en"]] == want and [round(x, 4) for x in got[None]] == [0.0075] * 3


def test_lm_score_base_is_exact_and_shards_agree(spark):
    held = crc_mod("doc_id", 5) == 1
    got = lm_score(docs(spark), held, order=3).collect()
    assert len(got) == len(ROWS)
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    tokens = lambda t: [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(t or "")] + [None]
    count = Counter(w for i, t in ROWS if not out(i) for w in tokens(t))
    total, denominator = sum(count.values()), sum(count.values()) + 0.5 * (len(count) + 1)
    want = sorted((repr(i), out(i), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), total, round(sum(math.log10((count[w] + 0.5) / denominator) for w in tokens(t)), 6)) for i, t in ROWS)
    assert sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    trained = [t for i, t in ROWS if not out(i)]
    table = ppm(trained, 3)
    alone = {(i, t): M.sums_by_row(table.log10, table, *T.byte_view(pa.array([t], pa.string())))[0][0] for i, t in ROWS}
    assert sorted(round(r.score, 4) for r in got) == sorted(round(v, 4) for (i, t), v in [((i, t), alone[i, t]) for i, t in ROWS])
    # little memory: several shards, and most words joined instead of broadcast
    small = lm_score(docs(spark), held, order=3, max_entries=40, hot_words=3).collect()
    key = lambda r: (repr(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 5), round(r.score, 4))
    assert sorted(map(key, small)) == sorted(map(key, got))


def test_lm_score_without_rows_or_training(spark):
    empty = docs(spark).filter("false")
    assert lm_score(empty, F.lit(False)).count() == 0
    got = lm_score(docs(spark), F.lit(True), order=2).collect()
    assert len(got) == len(ROWS) and all(r.n_known == 0 and r.train_tokens == 0 for r in got)


def test_quality_rules(spark):
    good = ["".join(np.random.default_rng(i).choice(["the ", "cat ", "sat ", "on ", "a ", "mat. "], 40)) for i in range(40)]
    rows = [(i, t, "en") for i, t in enumerate(good)] + [(100, None, "en"), (101, "", None), (102, "#!@$ %^&* " * 12, "en"), (103, "spam spam " * 50, "en"), (104, " ".join(f"zq{i}xv{i * 7}" for i in range(60)), "en"), (0, good[0], "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"kept": F.lit(5), "mark": F.lit("x")})
    got = quality_rules(df)
    by = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(rows)
    for i, t, _ in rows:
        r = by[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_form(t or "")
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
    assert all(by[i].kept for i in range(40) if not by[i].base_failed)
    assert not any(by[i].kept for i in (100, 101, 103, 104))
    key = lambda r: (r.doc_id, r.kept, round(r.log_ppl, 4))
    assert sorted(map(key, quality_rules(df, max_entries=50).collect())) == sorted(map(key, got.collect()))
    assert quality_rules(df.filter("false")).count() == 0
