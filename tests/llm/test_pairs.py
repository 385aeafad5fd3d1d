"""Near duplicates, similar sets and nearest vectors against brute force, and the defined results of odd inputs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import near_duplicates as N, set_pairs as P, vector_neighbours as K

TEXT = "field int, key long, text string, extra string"


def bigrams(t):
    w = [x for x in re.split("[^a-z0-9]+", (t or "").lower()) if x]
    return set(zip(w, w[1:])), len(w)


def brute_texts(rows, t, least):
    out, seen = set(), {(f, k): bigrams(x) for f, k, x, _ in rows}
    keys = sorted(seen)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            (x, n), (y, m) = seen[a], seen[b]
            if a[0] == b[0] and min(n, m) >= least and len(x & y) / len(x | y) >= t - 1e-12:
                out.add((a[0], a[1], b[1]))
    return out


@pytest.mark.parametrize("seed,t", [(0, 0.6), (1, 0.8), (2, 0.6)])
def test_near_duplicates_are_exact(spark, seed, t):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)]
    base = [[rnd.choice(vocab) for _ in range(rnd.choice([12, 13, 30, 90]))] for _ in range(25)]
    rows = []
    for i in range(160):
        w = list(rnd.choice(base))
        for _ in range(rnd.randrange(0, 1 + len(w) // 5)):
            k = rnd.randrange(len(w))
            if rnd.random() < 0.5:
                w[k] = rnd.choice(vocab)
            elif rnd.random() < 0.5:
                w.insert(k, rnd.choice(vocab))
            else:
                del w[k]
        rows.append((i % 2, i, " ".join(w).title() + "!", None))
    rows += [(0, 1000, None, None), (0, 1001, "", None), (0, 1002, "too short", None), (1, 1003, "a " * 5000, None), (1, 1004, "A-" * 4000, None)]
    df = spark.createDataFrame(rows + rows[:20], TEXT)
    got = [tuple(r) for r in N.near_duplicate_pairs(df, t, 12).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_texts(rows, t, 12)
    assert (1, 1003, 1004) in set(got)


def test_near_duplicates_of_nothing(spark):
    assert N.near_duplicate_pairs(spark.createDataFrame([], TEXT)).count() == 0
    assert N.near_duplicate_pairs(spark.createDataFrame([(0, 1, None, "x")], TEXT)).count() == 0


def test_a_group_of_copies_is_searched_once(spark):
    text = " ".join(f"x{i}" for i in range(40))
    rows = [(0, i, text, None) for i in range(30)] + [(0, 100 + i, " ".join(f"y{i}{j}" for j in range(20)), None) for i in range(60)] + [(0, 999, text + " tail", None)]
    members, links = N.near_duplicate_classes(spark.createDataFrame(rows, TEXT), 0.8)
    assert links.count() == 1 and members.where("key < 100").select("id").distinct().count() == 1
    assert N.near_duplicate_pairs(spark.createDataFrame(rows, TEXT), 0.8).count() == 30 * 29 // 2 + 30


def test_tolerances_always_exceed_the_bound():
    plan = N.Plan(0.6, 500)
    for i, j in plan.pairs:
        top = plan.edges[j + 1] - 1
        need = plan.most_apart(np.array([min(top, int((plan.edges[i + 1] - 1) / 0.6))]), plan.edges[i + 1] - 1)[0] + 1
        assert 2 * plan.segments[i] >= need


ITEMS = "field int, key long, items array<string>"


def brute_sets(rows, t, least):
    out = set()
    for i, (f, a, x) in enumerate(rows):
        for g, b, y in rows[i + 1 :]:
            if f == g and a != b and min(len(x), len(y)) >= least and len(set(x) & set(y)) / len(set(x) | set(y)) >= t - 1e-12:
                out.add((f, min(a, b), max(a, b)))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_similar_sets_find_all(spark, seed):
    rnd = random.Random(seed)
    vocab = ["hot"] * 200 + [f"v{i}" for i in range(60)]
    rows = []
    for i in range(250):
        x = {rnd.choice(vocab) for _ in range(rnd.randrange(3, 11))}
        if rows and rnd.random() < 0.4:
            x = set(rnd.choice(rows)[2])
            if rnd.random() < 0.7:
                x ^= {rnd.choice(vocab)}
        rows.append((i % 2, i, sorted(x)))
    df = spark.createDataFrame(rows + rows[:10], ITEMS)
    got = [tuple(r) for r in P.similar_pairs(df, 0.7, 5).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_sets(rows, 0.7, 5)


def test_near_duplicates_in_slices_hold_one_on_disk(spark, monkeypatch):
    import os

    from spanloom.runtime import stage, work_dir

    rng = np.random.default_rng(4)
    base = [rng.integers(1, 1 << 60, n) for n in rng.integers(3, 60, 30)]
    sets = [tuple(x[rng.random(len(x)) < 0.9]) for x in base for _ in range(6)]
    rows = [(0, i, [int(v) for v in x]) for i, x in enumerate(sorted({x for x in sets if len(x)}))]
    df = stage(spark.createDataFrame(rows, "field int, id long, toks array<long>"), "sets")
    want = {(a, b) for a, _, x in ((i, 0, set(v)) for _, i, v in rows) for b, y in ((i, set(v)) for _, i, v in rows) if a < b and len(x & y) >= 0.6 * len(x | y) - 1e-9}
    there = lambda: sorted(n.split("-")[0] for n in os.listdir(work_dir(spark).removeprefix("file://")) if n.startswith(("candidates", "links")))
    for most in (1, 8):
        before, asked, made = there(), [], N.map_arrow
        monkeypatch.setattr(N, "map_arrow", lambda d, f, schema: (asked.append(f), made(d, f, schema))[1])
        got = N.similar_sets(df, 0.6, most_slices=most, least_values=1).select("a", "b").collect()
        monkeypatch.undo()
        slices = sum(f.func is N._index for f in asked)
        assert (slices == 1 if most == 1 else 4 <= slices <= 12) and there() == sorted([*before, *["links"] * slices])
        assert sorted((min(g), max(g)) for g in got) == sorted(want) and len(want) > 100


def test_slices_cover_each_entry_once():
    plan = N.Plan(0.6, 500)
    for values in ({3: 5}, {n: 10 * n for n in range(1, 500)}, {n: 1 + 10**6 * (n == 40) for n in range(1, 500)}):
        out = plan.slices(values, 8)
        held = sorted((i, k, n) for bands, k, n in out for i in bands)
        assert {i for i, _, _ in held} >= set(plan.band(np.array(list(values)))) and len(set(held)) == len(held) and len(out) <= 16
        assert all(sorted(k for b, k, _ in held if b == i) == list(range(n)) for i, _, n in held)
        assert all(max(plan.edges[i] for i in b) <= plan.reach(b)[1] for b, _, _ in out)


def test_similar_sets_of_nothing(spark):
    assert P.similar_pairs(spark.createDataFrame([], ITEMS), 0.7).count() == 0
    assert P.similar_pairs(spark.createDataFrame([(0, 1, None), (0, 2, [])], ITEMS), 0.7).count() == 0


def test_forest_has_enough_trees():
    f = P.Forest(0.7, 0.9999)
    assert f.trees * f.gain[f.depth] >= f.need


def brute_nearest(x, ids, k, least):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = u @ u.T
    np.fill_diagonal(c, -2)
    return {(ids[i], ids[j]) for i in range(len(ids)) for j in np.lexsort((ids, -np.round(c[i], 9)))[:k] if c[i, j] >= least}


def test_nearest_vectors_recall(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(120, 20))
    x = np.concatenate([centres[rng.integers(0, 120, 500)] + 0.25 * rng.normal(size=(500, 20)), rng.normal(size=(300, 20))])
    ids = np.arange(len(x)) * 3
    rows = [(int(i), list(map(float, v * rng.uniform(0.1, 9)))) for i, v in zip(ids, x)]
    odd = [(5000, None), (5001, [1.0]), (5002, [0.0] * 20), (5003, [float("nan")] + [1.0] * 19), (5004, [float("inf")] + [1.0] * 19), (None, [1.0] * 20)]
    df = spark.createDataFrame(rows + rows[:30] + odd, "id long, vec array<double>")
    got = [(r["id"], r["other"]) for r in K.nearest(K.valid_vectors(df, "id", "vec", 20), 20, 5, 0.8).collect()]
    assert len(got) == len(set(got))
    want = brute_nearest(x, ids, 5, 0.8)
    assert len(set(got) & want) / len(want) >= 0.98 and len(set(got) - want) <= 0.02 * len(want)


def test_nearest_vectors_with_long_files_and_copies(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([np.ones((300, 10)) + 0.02 * rng.normal(size=(300, 10)), rng.normal(size=(100, 10))])
    rows = [(i, list(map(float, v))) for i, v in enumerate(x)] + [(1000 + i, [2.0] + [1.0] * 9) for i in range(40)]
    df = K.valid_vectors(spark.createDataFrame(rows, "id long, vec array<double>"), "id", "vec", 10)
    got = K.nearest(df, 10, 5, None, cap=50).collect()
    by = {}
    for r in got:
        by.setdefault(r["id"], []).append(r["other"])
    assert set(by) == {r[0] for r in rows}
    copies = set(range(1000, 1040))
    for i in copies:
        assert by[i] == sorted(copies - {i})[:5]
    allx = np.array([r[1] for r in rows])
    ids = np.array([r[0] for r in rows])
    want = brute_nearest(allx, ids, 5, -2)
    found = {(r["id"], r["other"]) for r in got}
    near = {(a, b) for a, b in want if a < 300}
    assert len(found & near) / len(near) >= 0.9


def test_nearest_of_nothing(spark):
    df = spark.createDataFrame([], "id long, vec array<double>")
    assert K.nearest(K.valid_vectors(df, "id", "vec", 4), 4).count() == 0
    one = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0])], "id long, vec array<double>")
    assert K.nearest(K.valid_vectors(one, "id", "vec", 4), 4).count() == 0


def test_words_agree_with_the_definition(spark):
    t = "Ünder_SCORE a1-b2\tİx ſ K9"
    got = spark.createDataFrame([(t,)], "text string").select(N.words(F.col("text")).alias("w")).first()["w"]
    assert got == [x for x in re.split("[^a-z0-9]+", t.lower()) if x]


def test_groups_and_link_counts(spark):
    rnd = random.Random(9)
    w = [f"w{i}" for i in range(30)]
    rows = [(0, i, " ".join(w[:20] + w[20 : 20 + i]), None) for i in range(6)] + [(0, 10 + i, " ".join(rnd.sample(w, 20)), None) for i in range(5)]
    got = {r["key"]: r["group"] for r in N.near_duplicate_groups(spark.createDataFrame(rows, TEXT), 0.8).collect()}
    assert set(got) == {r[1] for r in rows} and all(got[i] == 0 for i in range(6)) and all(got[10 + i] == 10 + i for i in range(5))
    sets = [(0, i, list("abcde")) for i in range(4)] + [(0, 9, list("abcdef")), (0, 10, list("uvwxyz"))]
    out = {r["key"]: (r["group"], r["links"]) for r in P.link_counts(spark.createDataFrame(sets, ITEMS), 0.7).collect()}
    assert out == {0: (0, 4), 1: (0, 4), 2: (0, 4), 3: (0, 4), 9: (9, 4), 10: (10, 0)}


def test_classes_leave_no_staged_records(spark):
    import os

    from spanloom.llm.common import classes
    from spanloom.runtime import work_dir

    left = lambda: {n for n in os.listdir(work_dir(spark).removeprefix("file://")) if n.startswith("records-")}
    os.makedirs(work_dir(spark).removeprefix("file://"), exist_ok=True)
    before = left()
    members, sets = classes(spark.sql("select 1 as field, 10 as key, array(1L, 2L) as toks union all select 1, 11, array(1L, 2L) union all select 1, 12, null"))
    assert left() == before
    assert members.count() == 2 and sets.count() == 1
