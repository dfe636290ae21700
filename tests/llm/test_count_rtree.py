"""The Jaccard join against all pairs, in shapes that its shortcuts could get wrong."""

from __future__ import annotations

import random
import re
from dataclasses import replace

import numpy as np
import pytest

from pyspark.sql import functions as F

from plumbline.llm import count_rtree as cr
from plumbline.llm.components import components, star_steps
from plumbline.llm.shingles import shingle_sets
from plumbline.llm.tree import leaf_pairs

SMALL = replace(
    cr.JaccardSettings(),
    table_bits=10,
    seen_bits=13,
    hot_level=2,
    leaf=2,
    range_shingles=300,
    star=2,
)


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def classes(rows):
    """Components of all pairs of similar rows: (n_shingles, smallest id) by row."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(
        ((rows[i][0], len(sets[i]), least.get(find(i))) for i in range(len(rows))), key=str
    )


def near(documents, rows, settings):
    df = cr.near_documents(documents([(i, t, "en", "s") for i, t in rows]), settings)
    return sorted(
        ((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str
    )


def corpus(seed, n=60):
    """Chains of edits, shared passages, short texts and copies."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    texts, rows = [], []
    for i in range(n):
        kind = rng.random()
        if kind < 0.55 and texts:
            w = list(rng.choice(texts[-8:]))
            for _ in range(rng.randint(0, 3)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
        elif kind < 0.75:
            own = [rng.choice(vocabulary) for _ in range(rng.randint(0, 12))]
            w = passage + own
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 4, 5, 6, 20, 80]))]
        texts.append(w)
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_all_links_of_random_corpora_are_found(documents, seed):
    rows = corpus(seed)
    assert near(documents, rows, SMALL) == classes(rows)


@pytest.mark.parametrize("stars", [(), (1,), (1, 3)])
def test_links_of_either_path_connect_the_classes(spark, documents, stars):
    """Without comparisons within nodes the join of the nodes finds all; with them, both find some."""
    rows = corpus(6, 90)
    settings = replace(SMALL, leaf=3, stars=stars)
    links = cr.jaccard_links(documents([(i, t, "en", "s") for i, t in rows]), settings)
    sets = {r["set_id"]: r["doc_id"] for r in links.sets.collect()}
    texts = dict(rows)
    found = [] if links.within is None else [(r.a, r.b) for r in links.within.collect()]
    joined = [(r.a, r.b) for r in links.join.collect()]
    assert found if stars else joined
    for a, b in found + joined:
        x, y = shingles(texts[sets[a]]), shingles(texts[sets[b]])
        assert 100 * len(x & y) >= 75 * len(x | y)
    assert near(documents, rows, settings) == classes(rows)


@pytest.mark.parametrize("turn", [0, 1])
def test_nodes_are_cut_the_same_whatever_the_frames(spark, turn):
    """The points of a node that are compared meet all others, also where a node goes on in the next frame."""
    rng = random.Random(2)
    rows = [(t, s, s % 5) for t in (11, -7, 2**40) for s in rng.sample(range(1000), 90)]
    members = spark.createDataFrame(rows, "shingle BIGINT, set_id BIGINT, root BIGINT").coalesce(1)
    known = spark.range(1000).selectExpr("id AS point", "id % 9 + 1 AS n", "array_repeat(id, 8) AS coarse")
    settings = replace(SMALL, leaf=4, stars=(1, 3))
    found = []
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    for batch in ("1", "7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        found.append(sorted(map(tuple, cr.node_stars(members, known, turn, settings).collect())))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    size, stars = ((4, 1), (64, 3))[turn]
    want = set()
    for tree in {t for t, _, _ in rows}:
        place = lambda s: ((s % 9 + 1) << 24) + sum((s * 8 // (s % 9 + 2)) << 3 * k for k in range(8))
        own = sorted(((place(s), s, r) for t, s, r in rows if t == tree))
        shift = ((tree % 2**64) >> 17) % size
        for low in range(-shift, len(own), size):
            node = own[max(low, 0) : low + size]
            for star in {k * len(node) // stars for k in range(stars)} if node else ():
                want |= {(node[star][1], s) for _, s, r in node if r != node[star][2]}
    assert found[0] == found[1] == found[2] == sorted(want)


def test_production_settings_and_odd_rows(documents):
    rows = corpus(3)
    rows += [(None, rows[-1][1]), (900, None), (901, ""), (902, " \t\n"), (3, rows[3][1])]
    rows += [(903, "A b C d E f"), (904, "a B c D e F"), (905, "long " * 30_000)]
    assert near(documents, rows, cr.JaccardSettings()) == classes(rows)


def test_a_large_group_of_variants_is_one_class(documents):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        w[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(w)))
    found = near(documents, rows, SMALL)
    assert found == classes(rows) and {c for _, _, c in found} == {0}


def test_the_plan_of_leaf_pairs_does_not_grow_with_the_levels(spark, monkeypatch):
    monkeypatch.setattr("plumbline.llm.tree.FANOUT", 2)
    rng = random.Random(8)
    joins = []
    for n in (5, 70):
        rows = [(t, i, x := rng.randrange(100), x + rng.randrange(9)) for t in (1, 2) for i in range(n // t)]
        leaves = spark.createDataFrame(rows, "tree LONG, leaf LONG, lo LONG, hi LONG")

        def meet(a, b):
            return (a("lo") <= b("hi")) & (b("lo") <= a("hi"))

        pairs = leaf_pairs(leaves, ["tree"], {"lo": F.min, "hi": F.max}, meet)
        assert sorted(map(tuple, pairs.collect())) == sorted(
            (t, i, j)
            for t, i, lo, hi in rows
            for u, j, low, high in rows
            if t == u and i <= j and lo <= high and low <= hi
        )
        joins.append(pairs._jdf.queryExecution().optimizedPlan().toString().count("Join "))
    assert joins == [2, 2]


def test_empty_table(documents):
    assert near(documents, [], SMALL) == []


def test_one_row_of_each_class_stays_with_its_columns(documents):
    text = " ".join(f"t{i}" for i in range(60))
    docs = documents(
        [(5, text, "en", "b"), (4, text, "de", "a"), (4, text, "de", "a"), (6, None, None, None)]
        + [(7, "", "en", "c"), (8, text + " end", "fr", "a"), (None, "q " * 9, "en", "z")]
    )
    kept = cr.first_of_each_class(docs, SMALL)
    assert kept.columns == docs.columns
    named = kept.where("doc_id IS NOT NULL").collect()
    assert sorted((r["doc_id"], r["source"]) for r in named) == [(4, "a"), (6, None), (7, "c")]
    assert kept.where("doc_id IS NULL").count() == 1


def test_clashing_columns_stay_as_they_are(spark):
    schema = "doc_id BIGINT, text STRING, _text STRING, class_id STRING, document INT, key INT, n INT"
    text = " ".join(f"t{i}" for i in range(60))
    rows = [(2, text, "own", "c", 1, 2, 3), (1, text + " x", "other", "d", 4, 5, 6), (3, "a b", None, None, 7, 8, 9)]
    rows += [(3, "a b", None, None, 7, 8, 9), (9, None, "n", "n", 0, 0, 0), (9, None, "n", "n", 0, 0, 0)]
    kept = cr.first_of_each_class(spark.createDataFrame(rows, schema), SMALL)
    assert kept.columns == [c.split(" ")[0] for c in schema.split(", ")]
    assert sorted(map(tuple, kept.collect())) == sorted([rows[1], rows[2], rows[4], rows[5]])


def test_prefixes_of_similar_sets_meet_under_any_order():
    rng = np.random.default_rng(1)
    universe = np.unique(rng.integers(0, 2**64, 4000, dtype=np.uint64))
    levels = rng.integers(0, 4, 1 << 12).astype(np.uint8)
    table = cr.Frequencies(levels, rng.integers(0, 256, 1 << 9).astype(np.uint8))
    for _ in range(200):
        n = int(rng.integers(4, 200))
        a = np.sort(rng.choice(universe, n, replace=False))
        change = int(n * rng.uniform(0, 0.2))
        b = np.unique(np.concatenate([a[change:], rng.choice(universe, change // 2 + 1)]))
        common_n = len(np.intersect1d(a, b))
        if 100 * common_n < 75 * (len(a) + len(b) - common_n):
            continue
        pa, pb = (cr.prefix(s, table, 75)[0] for s in (a, b))
        assert len(np.intersect1d(pa, pb))


def test_counts_bound_the_overlap():
    rng = np.random.default_rng(2)
    for _ in range(100):
        a, b = (np.unique(rng.integers(0, 900, n).astype(np.uint64)) for n in (200, 700))
        x, y = (cr.count_vector(s, 64) for s in (a, b))
        assert len(x) < len(y) and x.sum() == len(a) and y.sum() == len(b)
        assert cr.overlap_bounds([x, y], [y, x]).min() >= len(np.intersect1d(a, b))
    many = np.arange(1000, dtype=np.uint64) << np.uint64(12)  # all in one group of few
    assert cr.count_vector(many, 64).max() < 256


def test_packed_keys_come_back():
    rng = np.random.default_rng(3)
    for n in (1, 2, 1000):
        keys = np.sort(rng.integers(0, 2**64, n, dtype=np.uint64))
        for width in (32, 45, 60):
            high = keys >> np.uint64(64 - width)
            assert (cr.unpack_high(cr.pack_high(keys, width)) == high).all()
    same = np.full(5, 7 << 40, dtype=np.uint64)
    assert (cr.unpack_high(cr.pack_high(same, 32)) == same >> np.uint64(32)).all()


def test_shingle_sets_do_not_depend_on_neighbours_or_slices():
    texts = ["a b c d e f", "", None, "x", "A B  c\td\ne f", "é ü a b c d", "z " * 700_000]
    alone = [next(iter(shingle_sets([t]))) for t in texts]
    together = list(shingle_sets(texts))
    assert all((x == y).all() and len(x) == len(y) for x, y in zip(alone, together, strict=True))
    assert [len(s) for s in together] == [len(shingles(t)) for t in texts]
    assert (together[0] == together[4]).all()


def test_the_frequency_table_holds_levels_of_document_counts(documents):
    texts = ["a b c d e"] * 9 + ["f g h i j"] * 2 + ["k l m n o"]
    docs = documents([(i, t, "en", "s") for i, t in enumerate(texts)])
    settings = replace(cr.JaccardSettings(), range_shingles=4)
    keys = np.array([next(iter(shingle_sets([t])))[0] for t in (texts[0], texts[9], texts[11])])
    assert cr.frequency_table(docs, len(texts), settings).of(keys).tolist() == [3, 1, 0]
    # Crowded tables overstate levels and never call a shared shingle one document's.
    crowded = cr.frequency_table(docs, len(texts), replace(settings, table_bits=1, seen_bits=4))
    assert len(crowded.levels) == len(crowded.seen) == 2
    assert (crowded.of(keys) >= [3, 1, 0]).all()
    alone = cr.frequency_table(docs.where("doc_id > 10"), 1, settings)
    assert not alone.levels.any() and not alone.seen.any()


def test_hot_shingles_of_all_flushes_do_not_meet_in_one_group(documents, monkeypatch):
    common = " ".join(f"w{i}" for i in range(60))
    docs = documents([(i, f"{common} x{i} y{i}", "en", "s") for i in range(200)])
    table = cr.frequency_table(docs, 12_000, SMALL)
    seen, group = [], type(docs).groupBy

    def spy(df, *cols):
        seen.append((df, cols))
        return group(df, *cols)

    monkeypatch.setattr(type(docs), "groupBy", spy)
    met = cr.shared_prefixes(docs, table, 12_000, SMALL)
    monkeypatch.undo()
    dealt = next(df for df, cols in seen if cols == ("part", "salt"))
    hot = dealt.where("part = -1").groupBy("salt").count().collect()
    assert len(hot) > 3 and all(r["count"] == 1 for r in hot)
    assert met.select("set_id").distinct().count() == 200


def test_a_few_star_steps_keep_what_is_connected(spark):
    path = [(i, i + 1) for i in range(1, 30)]
    edges = spark.createDataFrame([*path, (2, 1), (7, 7), (50, 40)], "a BIGINT, b BIGINT")
    stars = star_steps(edges, 2)
    assert all(r["a"] > r["b"] for r in stars.collect())
    found = {r["node"]: r["root"] for r in components(stars).collect()}
    assert found == {**dict.fromkeys(range(1, 31), 1), 40: 40, 50: 40}
    none = star_steps(edges.limit(0), 2)
    assert none.collect() == [] and components(none).collect() == []
