"""Near-duplicate classes and binary code search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataql.llm import jaccard_join, multi_index
from strataql.llm.components import components
from strataql.llm.workspace import Workspace


def shingles(text):
    w = [x.lower() for x in (text or "").replace("\n", " ").split()]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(s), least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def found(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def corpus(seed=0, n=120):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = list(rng.choice(vocabulary, 60))
    base = [list(rng.choice(vocabulary, rng.integers(1, 130))) for _ in range(n // 4)]
    rows = []
    for i in range(n):
        words = list(base[int(rng.integers(0, len(base)))])
        for _ in range(int(rng.integers(0, 5))):
            words[int(rng.integers(0, len(words)))] = f"edit{rng.integers(0, 10**6)}"
        if i % 3 == 0:
            at = int(rng.integers(0, len(words) + 1))
            words[at:at] = passage
        rows.append((int(i * 7 % n), " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", [0, 1])
def test_classes_equal_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(jaccard_join.classes(df)) == brute(rows)


def test_all_shingles_hot_and_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HEAVY", 2)
    rows = corpus(2, 60)
    assert found(jaccard_join.classes(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_odd_rows(spark):
    long = " ".join(f"x{i % 977}y{i % 89}" for i in range(30_000))
    rows = [(5, None), (6, ""), (7, " \n "), (8, "one two"), (9, "One  TWO"), (10, "a b c d e"), (11, "a b c d e"), (11, "a b c d e"), (12, long), (13, long + " end"), (14, "one two three")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit(1), "id": F.lit(2), "component_id": F.lit(3)})
    assert found(jaccard_join.classes(df)) == brute(rows)
    assert jaccard_join.classes(df.filter("false")).count() == 0
    same_id = [(1, "p q r s t u"), (1, "v w x y z"), (2, "v w x y z"), (None, "p q r s t u"), (3, "alone here it is now")]
    assert found(jaccard_join.classes(spark.createDataFrame(same_id, "doc_id long, text string"))) == brute(same_id)


def brute_links(rows):
    """Each row's links to other documents; rows of one id and set are one document, those without id one each."""
    documents = {(d if d is not None else ("row", i), frozenset(shingles(t))) for i, (d, t) in enumerate(rows)}
    out = []
    for i, (d, t) in enumerate(rows):
        own = (d if d is not None else ("row", i), frozenset(shingles(t)))
        links = sum(1 for x in documents if x != own and own[1] and 100 * len(own[1] & x[1]) >= 75 * len(own[1] | x[1]))
        out.append((d, len(own[1]), links))
    return sorted(out, key=repr)


def links_found(df):
    return sorted(((r.doc_id, r.n_shingles, r.n_links) for r in df.collect()), key=repr)


def near_group(n=90, copies=7):
    """A large group of near copies with distinct texts, of several sizes, some of them copied exactly."""
    rng = np.random.default_rng(4)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(n):
        words = list(base[: 120 - int(rng.integers(0, 45))])
        for _ in range(int(rng.integers(0, 4))):
            words[int(rng.integers(0, len(words)))] = f"e{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(words)))
    return rows + [(1000 + i, rows[i % 3][1]) for i in range(copies)]


@pytest.mark.parametrize("blocks", [None, (300, 4)])
def test_links_equal_brute_force(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", blocks[0])
        monkeypatch.setattr(jaccard_join, "BLOCK_SETS", blocks[1])
        monkeypatch.setattr(jaccard_join, "CELLS", 64)
    rows = corpus(3, 80) + [(5000 + i, t) for i, t in near_group()] + [(9000, None), (9001, "one two"), (9002, "One  TWO"), (9002, "One  TWO")]
    got = jaccard_join.linked(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert links_found(got) == brute_links(rows)
    assert found(got) == brute(rows)


def test_links_of_ambiguous_ids(spark):
    rows = [(1, "p q r s t u"), (1, "v w x y z"), (1, "v w x y z"), (2, "v w x y z"), (None, "p q r s t u"), (None, "p q r s t u"), (3, "alone here it is now"), (4, "")]
    got = jaccard_join.linked(spark.createDataFrame(rows, "doc_id long, text string"))
    assert links_found(got) == brute_links(rows)
    assert jaccard_join.linked(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_lists_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LIST_ROWS", 4)
    rows = corpus(6, 90)
    assert found(jaccard_join.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == brute(rows)


def test_without_bitmaps(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "MOST_BITS", 1)
    rows = corpus(7, 60)
    got = jaccard_join.linked(spark.createDataFrame(rows, "doc_id long, text string"))
    assert links_found(got) == brute_links(rows) and found(got) == brute(rows)
    assert jaccard_join._bits_for(1) == 0


def test_components_that_do_not_end_are_an_error(spark, monkeypatch):
    from strataql.llm import components as C

    monkeypatch.setattr(C, "ROUNDS", 1)
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    with pytest.raises(RuntimeError):
        components(chain, Workspace(spark, "t"), "c")


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95)], "u long, v long").repartition(4)
    got = {r.id: r.component for r in components(chain, Workspace(spark, "t"), "c").collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[95] == got[90] == 90


def code(v):
    return [bool(x is not None and not np.isnan(x) and x > 0) for x in (list(v) + [None] * 64)[:64]]


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(6, 64))
    rows = [(i, [float(x) for x in centre[i % 6] + rng.normal(size=64) * (0.2 + i % 5)]) for i in range(220)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)] + [(2000, [1.0, float("nan"), None]), (2001, []), (None, rows[0][1]), (2002, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"code": F.lit(0), "rank": F.lit("r")})
    got = multi_index.search(df, F.col("vec_id") % 20 == 0, k=7).collect()
    real = [(i, code(v)) for i, v in rows if i is not None and v is not None]
    want = []
    for i, c in real:
        if i % 20 == 0:
            near = sorted((sum(a != b for a, b in zip(c, d, strict=True)), j) for j, d in real)[:7]
            want += [(i, j, d, k) for k, (d, j) in enumerate(near, 1)]
    assert sorted((r.vec_id, r.neighbor_id, r.distance, r["rank"]) for r in got) == sorted(want)
    assert multi_index.search(df.filter("false"), F.lit(True)).count() == 0
    assert multi_index.search(df.filter("vec_id < 3"), F.lit(True), k=5).count() == 9


def test_heavy_values_are_cut_and_the_index_is_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "LIST", 3)
    rng = np.random.default_rng(1)
    rows = [(i, [1.0] * 16 + [float(x) for x in rng.normal(size=48)]) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = multi_index.search(df, F.col("vec_id") % 30 == 0, k=4).collect()
    want = [(i, j, d, k) for i, v in rows if i % 30 == 0 for k, (d, j) in enumerate(sorted((sum(a != b for a, b in zip(code(v), code(w), strict=True)), j) for j, w in rows)[:4], 1)]
    assert sorted((r.vec_id, r.neighbor_id, r.distance, r["rank"]) for r in got) == sorted(want)


def test_prefixes_of_linked_sets_share_enough():
    """The bound behind the join: sets that link share l shingles among their shortened prefixes, for any l up to both."""
    rng = np.random.default_rng(9)
    hot = np.sort(rng.choice(2**40, 50, replace=False)).astype(np.uint64)
    from strataql.llm.textbatch import HashedArray

    table = HashedArray(hot)
    often = rng.integers(2, 100, 50)[table.order]
    for _ in range(300):
        n = int(rng.integers(1, 120))
        common = rng.choice(2**40, n, replace=False).astype(np.uint64)
        common[: min(n, 20)] = hot[: min(n, 20)]
        sets = [np.unique(np.concatenate([common[rng.random(n) < 0.93], rng.choice(2**40, int(rng.integers(0, n // 8 + 1))).astype(np.uint64)])) for _ in range(2)]
        both = len(np.intersect1d(*sets))
        if not both or 100 * both < 75 * (len(sets[0]) + len(sets[1]) - both):
            continue
        bounds = np.cumsum([0, len(sets[0]), len(sets[1])])
        token, row, _, place, need = jaccard_join.prefixes(np.concatenate(sets), bounds, table, often)
        overlap = -(-75 * int(bounds[2]) // 175)
        for l in {1, int(need.min())}:
            early = [set(token[(row == k) & (place < len(sets[k]) - overlap + l)].tolist()) for k in (0, 1)]
            assert len(early[0] & early[1]) >= l
