"""Destination names against copying the files one after the other."""

import os
import random

import pytest

from assetflow.operators import naming, organize
from assetflow.operators.inventory import classify

FILES = "path string, asset_id long"


def copied_in_turn(files, existing=()):
    """(path, id) -> destination name, by trying k = 1, 2, ... for each file."""
    used, result = set(existing), {}
    for path, asset_id in sorted(files):
        name = os.path.basename(path)
        stem, suffix = os.path.splitext(name)
        candidate, k = name, 0
        while ("text", candidate) in used:
            k += 1
            candidate = f"{stem}_{k}{suffix}"
        used.add(("text", candidate))
        result[path, asset_id] = candidate
    return result


def planned(spark, files, existing=()):
    df = classify(spark.createDataFrame(files, FILES))
    taken = spark.createDataFrame(list(existing), "folder string, name string") if existing else None
    return {(r.path, r.asset_id): r.dest_name for r in naming.unique_names(df, taken).collect()}


def test_chain(spark):
    files = [(p, 0) for p in ("p1/a.txt", "p2/a.txt", "p3/a_1.txt", "p4/a.txt")]
    got = planned(spark, files)
    assert [got[f] for f in files] == ["a.txt", "a_1.txt", "a_1_1.txt", "a_2.txt"]


def test_number_taken_before_it_is_wanted(spark):
    files = [(p, 0) for p in ("p1/a_1.txt", "p2/a.txt", "p3/a.txt", "p4/a_01.txt")]
    got = planned(spark, files)
    assert [got[f] for f in files] == ["a_1.txt", "a.txt", "a_2.txt", "a_01.txt"]


def test_destination_not_empty(spark):
    assert planned(spark, [("q/a.txt", 0)], [("text", "a.txt")]) == {("q/a.txt", 0): "a_1.txt"}


def random_files(rng, n):
    stems = ["a", "a_1", "a_2", "a_1_1", "a_1_2", "a_2_1", "a_3", "a_10", "a_0", "b", "b_1", "_1", "b_1_1_1"]
    hot = rng.choice(stems)
    names = [hot if rng.random() < 0.4 else rng.choice(stems) for _ in range(n)]
    return [
        (f"p{rng.randrange(10**6):06}/{name}.{rng.choice(['txt', 'txt', 'txt', 'TXT'])}", i)
        for i, name in enumerate(names)
    ]


@pytest.mark.parametrize("seed", range(6))
def test_against_copying_in_turn(spark, seed):
    rng = random.Random(seed)
    files = random_files(rng, 10 + 12 * seed)
    existing = [("text", n) for n in ("a.txt", "a_2.txt", "b_1.txt")] if seed % 3 == 0 else []
    assert planned(spark, files, existing) == copied_in_turn(files, existing)


def test_many_small_collections(spark):
    """Folders do not interact, so one run covers many random collections."""
    rng = random.Random(7)
    files, expected = [], {}
    for c in range(300):
        own = [(f"c{c:03}/{path}", i + 1000 * c) for path, i in random_files(rng, rng.randrange(1, 14))]
        files += own
        expected |= copied_in_turn(own)
    df = classify(spark.createDataFrame(files, FILES))
    by_collection = df.selectExpr("path", "asset_id", "substring(path, 1, 4) as folder", "name")
    got = naming.unique_names(by_collection).collect()
    assert {(r.path, r.asset_id): r.dest_name for r in got} == expected
    assert len({(r.folder, r.dest_name) for r in got}) == len(files)


def test_plan_is_idempotent(spark):
    files = classify(spark.createDataFrame([("p1/a.txt", 1), ("p2/a.txt", 2), ("p3/b.bin", 3)], FILES))
    plan = organize.organize_plan(files, root="/out")
    assert {r.dest for r in plan.collect()} == {"/out/text/a.txt", "/out/text/a_1.txt"}
    assert organize.organize_plan(files, done=plan, root="/out").collect() == []
    more = classify(spark.createDataFrame([("p1/a.txt", 1), ("p0/a.txt", 9)], FILES))
    assert [r.dest for r in organize.organize_plan(more, done=plan, root="/out").collect()] == ["/out/text/a_2.txt"]
