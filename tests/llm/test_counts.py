"""Co-occurrence and term counts against brute force."""

import collections
import itertools
import math
import random

import pyarrow as pa
from pyspark.sql import functions as F

from spanloom.llm import cooccurrence as C, term_frequency as T

REC = "field int, items array<string>"


def test_pairs(spark):
    rnd = random.Random(3)
    rows = [(i % 2, ["hot"] * (rnd.random() < 0.5) + [rnd.choice("abcdefé") for _ in range(rnd.randrange(1, 6))]) for i in range(300)]
    odd = [(0, None), (1, []), (1, [None])]
    got = {(r["field"], r["item_a"], r["item_b"]): r for r in C.items_together(spark.createDataFrame(rows + odd, REC), 4).collect()}
    n, one, two = collections.Counter(), collections.Counter(), collections.Counter()
    for f, x in rows:
        n[f] += 1
        one.update((f, v) for v in set(x))
        two.update((f, a, b) for a, b in itertools.combinations(sorted(set(x), key=str.encode), 2))
    assert {k: r["n_ab"] for k, r in got.items()} == dict(two)
    assert all((r["n"], r["n_a"], r["n_b"]) == (n[f], one[f, a], one[f, b]) for (f, a, b), r in got.items())


def test_least_keeps_all_frequent_pairs(spark):
    rnd = random.Random(4)
    rows = [(0, sorted({rnd.choice("abcdefgh") for _ in range(4)})) for _ in range(200)]
    df = spark.createDataFrame(rows, REC)
    least = spark.createDataFrame([(0, 200, 30)], "field int, n long, least long")
    full = {tuple(r) for r in C.pair_counts(df).where("n_ab >= 30").collect()}
    for kept in (200_000, 0):
        assert {tuple(r) for r in C.pair_counts(df, least, most_kept=kept).select("field", "item_a", "item_b", "n_ab", "n_a", "n_b", "n").collect()} == {
            tuple(r) for r in C.pair_counts(df).where("n_ab >= 30").select("field", "item_a", "item_b", "n_ab", "n_a", "n_b", "n").collect()
        }
    assert full


def test_significance(spark):
    df = spark.createDataFrame([(10, 20, 15, 100)], "n_ab long, n_a long, n_b long, n long")
    r = C.significance(df).first()
    h = lambda *k: sum(x * math.log(x / sum(k)) for x in k if x)
    k = (10, 10, 5, 75)
    want = 2 * (h(*k) - h(20, 80) - h(15, 85))
    assert abs(r["llr"] - want) < 1e-9 and abs(r["lift"] - 10 * 100 / 300) < 1e-12


def test_a_long_record_and_none(spark):
    big = [f"i{k:04d}" for k in range(1500)]
    got = C.pair_counts(spark.createDataFrame([(0, big)], REC))
    assert got.count() == 1500 * 1499 // 2
    assert C.pair_counts(spark.createDataFrame([], REC)).count() == 0


TERMS = "field int, terms array<string>"


def test_term_frequencies_with_any_number_of_heavy_terms(spark):
    rnd = random.Random(5)
    rows = [(i % 2, [rnd.choice(["the", "the", "of", f"w{rnd.randrange(200)}", None, ""]) for _ in range(rnd.randrange(0, 30))]) for i in range(200)] + [(0, None)]
    tf, df = collections.Counter(), collections.Counter()
    for f, x in rows:
        y = [v for v in x or [] if v]
        tf.update((f, v) for v in y)
        df.update((f, v) for v in set(y))
    for heavy in (1, 5, 4096):
        out = T.term_frequencies(spark.createDataFrame(rows, TERMS), heavy).collect()
        assert len(out) == len(tf)
        assert {(r["field"], r["term"]): (r["occurrences"], r["records"]) for r in out} == {k: (tf[k], df[k]) for k in tf}
        assert sum(r["heavy"] for r in out) <= heavy
    names = T.heavy_terms(spark.createDataFrame([r for r in rows if r[1]], TERMS).select("field", F.filter("terms", lambda x: x.isNotNull()).alias("terms")), 3)
    assert isinstance(names, pa.StringArray) and any(x.endswith("the") for x in names.to_pylist())


def test_terms_of_nothing(spark):
    assert T.term_frequencies(spark.createDataFrame([], TERMS)).count() == 0


def test_marks(spark):
    f = spark.createDataFrame([(0, "a", 1, 1), (0, "b", 9, 5), (0, "c", 90, 60)], "field int, term string, occurrences long, records long")
    b = spark.createDataFrame([(0, 2, 50.0)], "field int, rare_below int, common_above double")
    assert {r["term"]: r["mark"] for r in T.mark(f, b).collect()} == {"a": "rare", "b": None, "c": "common"}
