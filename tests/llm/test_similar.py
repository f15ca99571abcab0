"""Near-duplicates against all pairs by brute force; components; the bitmap."""

import itertools
import random
import re

import numpy as np
import pytest

from assetflow.llm import bitmaps, neardup
from assetflow.llm.components import components
from assetflow.llm.wordhash import Hasher


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def by_hand(rows):
    """(doc_id, n_shingles, component_id, kept) of each row."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
            group[root(i)] = root(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if sets[i] and root(j) == root(i) and rows[j][0] is not None]
        least = min(ids) if ids else doc_id
        out.append((doc_id, len(sets[i]), least, doc_id == least))
    return out


def found(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return neardup.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")


def chain(rng, n, step):
    """Texts each near the one before, the ends far apart."""
    words = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    texts = []
    for _ in range(n):
        texts.append(" ".join(words))
        for _ in range(step):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return texts


def test_edge_documents(spark, edge_dir, documents):
    result = neardup.op2_odd_sketches(spark, edge_dir)
    assert sorted(map(tuple, result.collect()), key=str) == sorted(by_hand(documents), key=str)


def test_no_documents(spark, empty_dir):
    assert neardup.op2_odd_sketches(spark, empty_dir).count() == 0


def test_chains_and_pairs_about_the_threshold(spark):
    rng = random.Random(4)
    texts = [t for _ in range(6) for t in chain(rng, 12, 1)]
    texts += [t for _ in range(30) for t in chain(rng, 2, 2)]
    texts += [t for _ in range(30) for t in chain(rng, 2, 3)]
    texts += ["a b c", "A  b\tc", "a b", "x y z w v u"] * 3
    ids = rng.sample(range(10_000), len(texts))
    rows = list(zip(ids, texts, strict=True))
    assert sorted(map(tuple, found(spark, rows).collect())) == sorted(by_hand(rows))


def test_large_group_of_near_copies_is_one_component(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(400):
        own = list(words)
        own[rng.randrange(120)] = f"x{i % 300}"
        rows.append((i, " ".join(own)))
    result = found(spark, rows).collect()
    assert {r.component_id for r in result} == {0}
    assert sum(r.kept for r in result) == 1


def test_one_document_of_each_group_stays(spark, edge_dir, documents):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    judged = [r for r in by_hand(documents)]
    firsts = sorted((r[0] for r in judged if r[3]), key=str)
    # Of equal rows of one doc_id one stays; here no two of them are kept.
    assert ids == firsts


def test_repeated_rows_leave_one(spark):
    text = "one two three four five six seven eight"
    docs = spark.createDataFrame([(1, text, "a"), (1, text, "b"), (2, text, "c"), (3, "", "d"), (3, None, "e")], "doc_id long, text string, fp string")
    kept = neardup.keep_one(docs).collect()
    assert sorted(r.doc_id for r in kept) == [1, 3, 3]


@pytest.mark.parametrize("size", [40, 400, 40_000])
def test_parity_never_counts_more_than_differs(size):
    rng = np.random.default_rng(size)
    pool = np.unique(rng.integers(0, 2**63, 2 * size, dtype=np.uint64))
    base = pool[:size]
    for own in (0, 1, size // 20, size // 6):
        a = np.sort(np.concatenate([base[own:], pool[size : size + own]]))
        b = np.sort(np.concatenate([base[: size - own], pool[size + own : size + 2 * own]]))
        differ = len(np.setxor1d(a, b))
        bits = int(np.bitwise_count(np.bitwise_xor(*neardup.parities([a, b])).view(np.uint64)).sum())
        assert bits <= differ
        assert size > 400 or bits >= 0.9 * differ


def test_copies_below_the_threshold_are_told_apart_by_parity(spark):
    rng = random.Random(11)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(300):
        own = list(words)
        for at in rng.sample(range(200), rng.randrange(1, 7)):
            own[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    assert sorted(map(tuple, found(spark, rows).collect())) == sorted(by_hand(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    signed = neardup.sign(docs)
    sides = neardup._side(signed, "a").crossJoin(neardup._side(signed, "b")).where("a < b")
    let_by = sides.where(neardup._may_link(85)).count()
    sets = [shingles(t) for _, t in rows]
    linked = sum(100 * len(a & b) >= 85 * len(a | b) for a, b in itertools.combinations(sets, 2))
    assert linked <= let_by <= 1.05 * linked


def test_sketch_bounds_the_number_of_different_samples():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 500).astype(np.uint64)
    other = base.copy()
    other[:40] = rng.integers(0, 2**63, 40)  # similar by 460 of 540, just above the threshold
    far = rng.integers(0, 2**63, 500).astype(np.uint64)
    _, sketches = neardup.signatures([np.unique(base), np.unique(other), np.unique(far)])

    def bits(i, j):
        return sum(int(x).bit_count() for x in (sketches[i] ^ sketches[j]).view(np.uint64))

    assert bits(0, 0) == 0
    assert bits(0, 1) <= 2 * neardup.ALL_MAX_DIFFERENT < bits(0, 2)


def test_shingle_sets_of_short_texts():
    sets = neardup.shingle_sets(Hasher(), [b"a b", b"A  B", b"a b c d e f", None, b" "])
    assert [len(s) for s in sets] == [1, 1, 2, 0, 0]
    assert sets[0][0] == sets[1][0]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_a_plain_search(spark, seed):
    rng = random.Random(seed)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(80), rng.randrange(80)) for _ in range(50)]
    links += [(500, 500 + i) for i in range(60)]
    labels = {n: n for link in links for n in link}
    changed = True
    while changed:
        changed = False
        for u, v in links:
            low = min(labels[u], labels[v])
            changed |= labels[u] != low or labels[v] != low
            labels[u] = labels[v] = low
    result = components(spark.createDataFrame(links, "u long, v long")).collect()
    linked = {n for u, v in links if u != v for n in (u, v)}
    assert {(r.node, r.label) for r in result} == {(n, labels[n]) for n in linked}


def test_bitmap_splits_rows_without_loss(spark):
    rows = spark.range(1000).selectExpr("id", "id * 2 as clash")
    bitmap = bitmaps.build(rows.where("id % 10 = 0"), "id")
    inside = {r.id for r in bitmaps.select(rows, "id", bitmap, True).collect()}
    outside = {r.id for r in bitmaps.select(rows, "id", bitmap, False).collect()}
    assert inside | outside == set(range(1000)) and not inside & outside
    assert inside >= set(range(0, 1000, 10)) and len(inside) < 110
