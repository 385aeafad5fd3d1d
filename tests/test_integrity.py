"""Orphan references against a brute-force reading of the rules, and the defined results of odd inputs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import integrity as I

REC = "id long, name string, at timestamp, deps map<string,string>"
DAY = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def brute(records, removals):
    name = lambda x: (x or "").strip().lower() or None
    out = set()
    for i, _, at, deps in records:
        for d in {name(k) for k in (deps or {})} - {None}:
            c = max((a for _, n, a, _ in records if name(n) == d and a <= at), default=None)
            r = max((a for n, a in removals if name(n) == d and a is not None and a <= at), default=None)
            if c is not None and (r is None or c > r):
                continue
            later = any(name(n) == d and a > at for _, n, a, _ in records)
            out.add((i, d, "deleted" if r else "late" if later else "missing"))
    return out


def run(spark, records, removals):
    r = spark.createDataFrame(records, REC)
    g = spark.createDataFrame(removals, "name string, at timestamp").select(I.norm_name(F.col("name")).alias("name"), "at")
    rec = r.select("id", I.norm_name(F.col("name")).alias("name"), "at")
    refs = I.references(r, "id", "at", "deps")
    return rec, refs, I.orphan_references(refs, rec.select("name", "at"), g)


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    names = ["a", "B ", " b", "c", "d", None, " "]
    records = [(i, rnd.choice(names), DAY(rnd.randrange(8)), rnd.choice([None, {}, {x: "1" for x in rnd.sample(["A", "b", "c ", "d", "e", " "], 3)}])) for i in range(40)]
    removals = [(rnd.choice(names), rnd.choice([None, DAY(rnd.randrange(8))])) for _ in range(12)]
    _, _, out = run(spark, records + records[:5], removals)
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == brute(records, removals)


def test_empty_tables(spark):
    assert run(spark, [], [])[2].count() == 0
    assert {tuple(r) for r in run(spark, [(1, "a", DAY(1), {"x": "1"})], [])[2].collect()} == {(1, "x", "missing")}


def test_same_instant_counts_as_removed(spark):
    out = run(spark, [(1, "a", DAY(1), None), (2, "z", DAY(2), {"a": "1"})], [("a", DAY(1))])[2]
    assert [tuple(r) for r in out.collect()] == [(2, "a", "deleted")]


def test_cascade_goes_through_a_cycle_and_reports_levels(spark):
    records = [(1, "a", DAY(1), {"gone": "1"}), (2, "b", DAY(2), {"a": "1"}), (3, "c", DAY(3), {"b": "1", "d": "1"}), (4, "d", DAY(3), {"c": "1"}), (5, "e", DAY(4), None)]
    rec, refs, direct = run(spark, records, [])
    levels = I.orphan_cascade(refs, rec, direct.where("dependency = 'gone'"))
    assert {tuple(r) for r in levels.collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}
    report = I.orphan_report(refs, rec, direct, levels).collect()
    assert sum(r["inherited_records"] for r in report) == 3


def test_hot_name(spark):
    records = [(i, "hot" if i % 3 == 0 else f"n{i}", DAY(i % 5), {"hot": "1"}) for i in range(300)]
    removals = [("hot", DAY(2))]
    out = run(spark, records, removals)[2]
    assert {tuple(r) for r in out.collect()} == brute(records, removals)
