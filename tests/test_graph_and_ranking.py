from types import SimpleNamespace

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.functions import triple_scores as S, vector as V
from spanloom.learning import sgd
from spanloom.operators import graph as G, linkpred as L, metapath as M, order, retrieval as O, sampling, vectors as VO


def test_positions_and_running_sum(spark):
    df = spark.createDataFrame([(i * 7 % 101, i % 3) for i in range(101)], "k long, v long")
    p = order.positions(df, ["k"]).orderBy("k").collect()
    assert [r["pos"] for r in p] == list(range(101))
    s = order.running_sum(df, ["k"], "v", "run").orderBy("k").collect()
    assert [r["run"] for r in s] == list(np.cumsum([r["v"] for r in s]))
    assert order.positions(df.where("false"), ["k"]).count() == 0


def test_relation_class(spark):
    t = spark.createDataFrame([(1, 10, 0), (1, 11, 0), (2, 10, 0)], "h long, t long, r int")
    r = G.relation_class(t).first()
    assert (r["tails"], r["heads"], r["cls"]) == (1.5, 1.5, "n-n")


def test_edges_keep_the_first_kind(spark):
    rec = spark.createDataFrame([(1, "o#a", "o", ["x", "x"], ["x"], ["T", None], ["k"])], "id long, key string, user string, deps array<string>, dev_deps array<string>, topics array<string>, keywords array<string>")
    own = spark.createDataFrame([("x", "p#x")], "name string, key string")
    got = {tuple(r) for r in G.package_edges(rec, own).collect()}
    assert got == {("$LIBo#a", "$USERo", "BelongToUser"), ("$LIBo#a", "$LIBp#x", "HasDependence"), ("$LIBo#a", "$TOPICt", "HasTopic"), ("$LIBo#a", "$KEYWORDk", "HasKeyword")}


def test_entity_edges(spark):
    f = spark.createDataFrame([("o#a", "reacts", "react", 1, 1), ("o#a", "react", "react", 1, 1)], "key string, ne string, canon string, cat int, canon_cat int")
    kinds = [r["kind"] for r in G.entity_edges(f).collect()]
    assert sorted(kinds) == ["RelateToNE1", "RelateToNE1", "SameToNE"]


def test_walk_counts(spark):
    links = [("w:1", "r:1")] * 2 + [("w:2", "r:1")]
    both = spark.createDataFrame(links + [(b, a) for a, b in links], "src string, dst string")
    got = {r["node"]: r["cnt"] for r in M.walk_counts(both, "wrw", True).where("step = 0").collect()}
    assert got == {"w:1": 6, "w:2": 3}
    w = M.walks(both, "wrw").collect()
    assert {r["n0"] for r in w} == {"w:1", "w:2"} and all(r["n1"] == "r:1" for r in w)


def _summed(near):
    return near.groupBy("a").agg(F.count("*").alias("others"), F.sum("walks").alias("walks"), F.max("walks").alias("most"))


@pytest.mark.parametrize("scale", [1, 2**40])
@pytest.mark.parametrize("most, links_a_row", [(4_000_000, 50_000), (40, 5)])
def test_reached_nodes_are_counted_without_their_pairs(spark, monkeypatch, scale, most, links_a_row):
    rng = np.random.default_rng(2)
    one = {(f"{a}:{i}", f"{b}:{j}") for a, b in ("wr", "wt", "rt") for i, j in rng.zipf(1.4, (120, 2)) % 23}
    links = [(x, y, int(rng.integers(1, 9)) * scale) for x, y in sorted(one)]
    links = spark.createDataFrame(links + [(y, x, c) for x, y, c in links], "src string, dst string, times long")
    starts = spark.createDataFrame([(f"w:{i}",) for i in [*range(12), 99]], "a string")
    paths = ["wrw", "wtw", "wrt"]
    want = {(p, *r) for p in paths for r in _summed(M.neighbours(links, p, starts)).collect()} if scale == 1 else None
    if want is None:  # sums beyond what a double holds exactly
        want, links = set(), links.withColumn("times", F.when(F.col("src").startswith("w:"), F.col("times") + 1).otherwise(F.col("times") / 2**30).cast("long"))
        want = {(p, *r) for p in paths for r in _summed(M.neighbours(links, p, starts)).collect()}
    monkeypatch.setattr(M, "neighbours", None)
    got = M.reached(links, paths, starts, most, links_a_row)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 20
    assert M.reached(links, paths, starts.where("false")).count() == 0


@pytest.mark.parametrize("length", [2, 4])
def test_reached_along_longer_and_shorter_paths(spark, length):
    rng = np.random.default_rng(length)
    one = sorted({(f"{a}:{i}", f"{b}:{j}") for a, b in ("wr", "rw", "rr") for i, j in rng.integers(0, 9, (30, 2))})
    links = spark.createDataFrame([(x, y, 1 + k % 3) for k, (x, y) in enumerate(one)], "src string, dst string, times long")
    starts = spark.createDataFrame([(f"w:{i}",) for i in range(6)], "a string")
    path = {2: "wr", 4: "wrrw"}[length]
    assert {tuple(r) for r in M.reached(links, [path], starts).collect()} == {(path, *r) for r in _summed(M.neighbours(links, path, starts)).collect()}


@pytest.mark.parametrize("side", ["t", "h", "r"])
def test_corruption_finds_the_last_unknown_candidate(spark, side):
    # Every candidate but one or two is known; one draw is not enough to find them.
    at = {"t": lambda x: (3, x, 0), "h": lambda x: (x, 3, 0), "r": lambda x: (3, 4, x)}[side]
    rows = [at(x) for x in range(30) if x not in (11, 23)] + ([(x, x, 5) for x in range(30)] if side != "r" else [(7, 8, x) for x in range(30)])
    t = spark.createDataFrame(rows, "h long, t long, r int")
    pool = sampling.entity_pool(t) if side != "r" else spark.createDataFrame([(i, i) for i in range(30)], "idx long, value long")
    got = sampling.corrupt(t.withColumn("size", F.lit(30)), t, side, pool, "size", "idx", 1, 1).collect()
    hub = [r for r in got if (r["r"] == 0 if side != "r" else r["h"] == 3)]
    assert len(got) == len(rows) and {r["value"] for r in hub} == {11, 23}
    for r in hub:
        draw = (r["h"] * 31 + r["t"] * 17 + r["r"] * 7) % 30
        assert r["value"] == (draw if draw in (11, 23) else (11, 23)[(r["h"] * 31 + r["t"] * 17 + r["r"] * 7) % 2])


@pytest.mark.parametrize("mid", ["u", "t"])
def test_walk_counts_through_users_and_topics(spark, mid):
    links = [("w:1", f"{mid}:1")] * 2 + [("w:2", f"{mid}:1"), ("w:2", f"{mid}:2"), ("w:2", "r:9")]
    both = spark.createDataFrame(links + [(b, a) for a, b in links], "src string, dst string")
    got = {(r["step"], r["node"]): r["cnt"] for r in M.walk_counts(both, f"w{mid}w", True).where("step < 2").collect()}
    assert got == {(1, f"{mid}:1"): 3, (1, f"{mid}:2"): 1, (0, "w:1"): 6, (0, "w:2"): 4}
    near = {(r["a"], r["b"]): r["walks"] for r in M.neighbours(both, f"w{mid}w", spark.createDataFrame([("w:1",)], "a string")).collect()}
    assert near == {("w:1", "w:1"): 4, ("w:1", "w:2"): 2}


def test_walks_are_shared_by_the_walks_to_the_end(spark):
    links = [("w:1", "r:1")] * 2 + [("w:2", "r:1"), ("w:2", "r:2")]
    both = spark.createDataFrame(links + [(b, a) for a, b in links], "src string, dst string")
    w = M.walks(both, "wrw", 9000).collect()  # to the end: 6 from w:1, 3 + 1 from w:2
    n = lambda *k: sum(tuple(r[c] for c in ("n0", "n1", "n2")[: len(k)]) == k for r in w)
    assert len(w) == 9000 and n("w:1") == 5400 and n("w:2") == 3600
    assert abs(n("w:2", "r:2") - 900) < 150 and abs(n("w:1", "r:1", "w:1") - 3600) < 150


def test_negatives_of_pairs_are_drawn_from_their_own_table(spark):
    pairs = spark.createDataFrame([(0, 1, 0), (2, 3, 1)] * 50, "u long, v long, g int")
    tables = [(np.array([4]), np.array([1.0])), (np.array([5]), np.array([1.0]))]
    e, _ = sgd.train_pairs(pairs.coalesce(1), 8, dim=4, rounds=1, rate=0.5, weights=tables)
    moved = np.abs(e - sgd.initial(8, 4)).sum(1) > 0
    assert moved.tolist() == [True] * 6 + [False] * 2


def test_word_network_links_every_word_with_all_items_of_its_record(spark):
    rec = spark.createDataFrame([("u#a", ["x", "x", "x", "rare"], ["u"], ["x"], ["T b", "T b"])], "key string, words array<string>, user array<string>, name array<string>, topics array<string>")
    net = M.word_network(rec, "key", F.col("words"), [("u", F.col("user")), ("n", F.col("name")), ("t", F.col("topics"))])
    got = {(r["src"], r["dst"]): r["times"] for r in net.collect()}
    want = {("w:x", "r:u#a"): 3, ("w:x", "u:u"): 3, ("w:x", "n:x"): 3 + 1, ("w:x", "t:T%b"): 6}
    assert got == want | {(b, a): n for (a, b), n in want.items()}


def test_structured_search_goes_on_to_the_same_entities(spark):
    terms = spark.createDataFrame([(1, 10, 2)], "item_id long, ent long, cnt long")
    edges = spark.createDataFrame([(5, 11, 6), (6, 10, 6), (7, 12, 6)], "repo long, ent long, r int")  # 10 -> 11 -> 12
    vec = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 1.0]), (12, [1.0, 0.0]), (5, [0.0, 1.0]), (6, [1.0, 0.0]), (7, [1.0, 0.0])], "id long, vec array<double>")
    rel = spark.createDataFrame([(6, [0.0, 0.0])], "r int, vec array<double>")
    same = spark.createDataFrame([(10, 11), (10, 11), (11, 12)], "ent long, other long")
    score = lambda *a: {r["repo"]: round(r["score"], 9) for r in O.structured_scores(terms, edges, vec, rel, *a).collect()}
    assert score() == {6: 2.0} and score(same) == {5: 2.0, 6: 2.0}


def test_splits(spark):
    df = spark.createDataFrame([(i,) for i in range(25)], "k long")
    n = lambda x: dict(x.groupBy("part").count().collect())
    assert n(sampling.split_three(df, ["k"])) == {"train": 16, "test": 4, "valid": 5}
    assert n(sampling.split_train(df, "k")) == {"train": 18, "valid": 7}


def test_corruption_leaves_known_triples_out_and_gives_up_openly(spark):
    t = spark.createDataFrame([(0, 1, 0), (0, 2, 0), (1, 0, 0), (0, 0, 0)], "h long, t long, r int")
    pool = sampling.entity_pool(t)
    got = sampling.corrupt(t.withColumn("size", F.lit(3)), t, "t", pool, "size", "idx").collect()
    assert len(got) == 4
    known = {(r["h"], r["t"]) for r in t.collect()}
    for r in got:
        assert r["value"] is None if r["h"] == 0 else (r["h"], r["value"]) not in known


def test_weighted_pick_without_weights(spark):
    df = spark.createDataFrame([(1, 1, 0.0), (1, 2, 0.0)], "g long, x long, w double")
    assert sampling.weighted_pick(df, "g", "x", "w", F.lit(0.5)).count() == 1


def test_cosine01(spark):
    a = lambda *x: F.array(*map(F.lit, x))
    r = spark.range(1).select(*(V.cosine01(a(1.0, 0.0), y).alias(k) for k, y in (("e", a(2.0, 0.0)), ("o", a(0.0, 1.0)), ("n", a(-1.0, 0.0)), ("z", a(0.0, 0.0))))).first()
    assert tuple(r) == (1.0, 0.5, 0.0, 0.0)


def test_greedy_clique(spark):
    # Unit vectors with cosines A-B .8, A-C .76, B-C about 0.23.
    v = {1: [1.0, 0.0, 0.0], 2: [0.8, 0.6, 0.0], 3: [0.76, -0.6332, 0.1463]}
    vecs = spark.createDataFrame([(k, x) for k, x in v.items()], "id long, vec array<double>")
    pairs = VO.block_search(vecs, vecs, 3, least=2 * 0.84 - 1).select("a", "b", (0.5 + 0.5 * F.col("sim")).alias("sim"))
    got = {}
    for r in VO.greedy_cliques(pairs, vecs, 0.84).orderBy("a", "rank").collect():
        got.setdefault(r["a"], []).append(r["b"])
    assert got == {1: [2], 2: [1], 3: [1]}


def test_cliques_are_formed_with_short_vectors_and_again_where_these_cannot_tell(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 5))
    x[0], x[1], x[2] = [5, 0, 0, 0, 0], [4, 3, 0, 0, 0], [4, -3, 0, 0, 0]  # 1 and 2: cosine 7 / 25
    df = lambda v: spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(v)], "id long, vec array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for r in VO.short_vectors(df(x)).collect():
        assert len(r["short"]) == 10 and np.abs(np.frombuffer(r["short"], np.int16) * r["step"] - u[r["b"]]).max() <= r["step"] * 0.5000001
    for t in (0.64 - 1e-7, 0.64 + 1e-7, 0.8):
        pairs = VO.block_search(df(x), df(x), 5, least=2 * t - 1).select("a", "b", (0.5 + 0.5 * F.col("sim")).alias("sim"))
        got = {}
        for r in VO.greedy_cliques(pairs, df(x), t).orderBy("a", "rank").collect():
            got.setdefault(r["a"], []).append(r["b"])
        sim = 0.5 + 0.5 * u @ u.T
        for a in range(80):
            kept = []
            for b in sorted((b for b in range(80) if b != a and sim[a, b] >= t), key=lambda b: (-sim[a, b], b)):  # noqa: B023
                kept += [b] if all(sim[b, k] >= t for k in kept) else []
            assert got.get(a, []) == kept


def test_the_two_best_above_a_bound_leave_a_task_once():
    rng = np.random.default_rng(6)
    u = (x := rng.normal(size=(3000, 8))) / np.linalg.norm(x, axis=1, keepdims=True)
    batch = lambda s: pa.record_batch({"id": pa.array(np.arange(s, s + 1000)), "vec": pa.array(list(x[s : s + 1000]), pa.list_(pa.float64()))})
    got = [r for b in VO._scan(SimpleNamespace(value=(np.arange(100), u[:100])), 8, 0.9, 2)(batch(s) for s in (0, 1000, 2000)) for r in zip(*(b.column(c).to_pylist() for c in "ab"))]
    sim = u[:100] @ u.T
    np.fill_diagonal(sim[:, :100], -1)
    assert sorted(got) == sorted((i, int(j)) for i in range(100) for j in np.argsort(-sim[i])[:2] if sim[i, j] >= 0.9)


def test_block_search_in_several_blocks(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 4))
    vecs = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "id long, vec array<double>")
    few = VO.block_search(vecs, vecs, 4, top=3)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    assert {(r["a"], r["rank"]): r["b"] for r in few.collect()} == {(i, k + 1): int(np.argsort(-s[i], kind="stable")[k]) for i in range(50) for k in range(3)}


def test_a_task_of_the_block_search_leaves_its_best_rows_only():
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, size=(6000, 4)).astype(float)  # many equal cosines
    q = x[:600]
    u = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    batch = lambda s: pa.record_batch({"id": pa.array(np.arange(s, s + 1500)), "vec": pa.array(list(x[s : s + 1500]), pa.list_(pa.float64()))})
    shared = SimpleNamespace(value=(np.arange(600), u(q)))
    got = [r for b in VO._scan(shared, 4, 1e-9, 5)(batch(s) for s in range(0, 6000, 1500)) for r in zip(*(b.column(c).to_pylist() for c in "ab"))]
    sim = np.rint(u(q) @ u(x).T * 1e9)
    np.fill_diagonal(sim[:, :600], -9e9)
    want = {(i, int(j)) for i in range(600) for j in np.lexsort((np.arange(6000), -sim[i]))[:5] if sim[i, j] >= 1}
    assert len(got) == len(want) and set(got) == want


def test_score_models_against_plain_formulas():
    rng = np.random.default_rng(1)
    h, r, t = rng.normal(size=(3, 2, 6))
    u = lambda x: x / np.linalg.norm(x)
    assert np.isclose(S.transe(np.array([[1.0, 0]]), np.array([[0, 1.0]]), np.array([[1.0, 1.0]]))[0], 0.585786, atol=1e-6)
    assert np.isclose(S.transe(h, r, t)[0], np.abs(u(h[0]) + u(r[0]) - u(t[0])).sum())
    assert np.isclose(S.distmult(h, r, t)[0], -sum(a * b * c for a, b, c in zip(h[0], r[0], t[0])))
    c = lambda x: x[0][:3] + 1j * x[0][3:]
    assert np.isclose(S.complex_(h, r, t)[0], -(c(h) * c(r) * np.conj(c(t))).sum().real)
    m = rng.normal(size=(2, 6, 6))
    assert np.isclose(S.rescal(h, m, t)[0], h[0] @ m[0] @ t[0])
    corr = [sum(h[0][i] * t[0][(i + k) % 6] for i in range(6)) for k in range(6)]
    assert np.isclose(S.hole(h, r, t)[0], -np.dot(r[0], corr))
    ph = r[:, :3]
    assert np.isclose(S.rotate(h, ph, t, 6.0)[0], np.abs(c(h) * np.exp(1j * ph[0]) - c(t)).sum() - 6)
    w = u(r[0])
    hh, tt = h[0] - (h[0] @ w) * w, t[0] - (t[0] @ w) * w
    assert np.isclose(S.transh(h, t, t, r)[0], np.abs(u(hh) + u(t[0]) - u(tt)).sum())
    assert np.isclose(S.transr(h, r, t, m)[0], np.abs(u(h[0] @ m[0]) + u(r[0]) - u(t[0] @ m[0])).sum())
    hd, td = u(h[0] + (h[0] @ t[0]) * r[0]), u(t[0] + (t[0] @ h[0]) * r[0])
    assert np.isclose(S.transd(h, r, t, t, h, r)[0], np.abs(u(hd) + u(r[0]) - u(td)).sum())
    assert np.isclose(S.analogy(h, r, t, h, r, t)[0], S.complex_(h, r, t)[0] + S.distmult(h, r, t)[0])


def test_ranks(spark):
    # One-dimensional scores .9 .3 .1 .2 .3 for tails 0 .. 4; the true tail is 1; tail 2 is also known.
    score = lambda h, r, t: t[:, 0] + 0 * h[:, 0]
    ents = spark.createDataFrame([(i, [x]) for i, x in enumerate((0.9, 0.3, 0.1, 0.2, 0.3))], "id long, vec array<double>")
    rel = spark.createDataFrame([(0, [0.0])], "r int, vec array<double>")
    test = spark.createDataFrame([(3, 1, 0)], "h long, t long, r int")
    known = spark.createDataFrame([(3, 1, 0), (3, 2, 0)], "h long, t long, r int")
    r = L.ranks(test, known, ents, rel, score).where("side = 'tail'").first()
    assert (r["raw"], r["filtered"], r["typed"]) == (3, 2, 2)


def test_ranks_by_transe_score_equal_questions_once_and_cut_long_lists_of_links(spark):
    rng = np.random.default_rng(5)
    x, rel = rng.normal(size=(60, 6)), rng.normal(size=(2, 6))
    x[50:] = x[:10]  # equal vectors: ties
    known = sorted({(int(h), int(t), int(r)) for h, t, r in zip(rng.integers(0, 60, 300) // 4, rng.integers(0, 60, 300), rng.integers(0, 2, 300))} | {(k, 7, 1) for k in range(60)})
    test = [k for k in known if (k[0] + k[1]) % 3 == 0]
    df = lambda rows: spark.createDataFrame(rows, "h long, t long, r int")
    ents = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "id long, vec array<double>")
    rels = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(rel)], "r int, vec array<double>")
    got = {(g["h"], g["t"], g["r"], g["side"]): (g["raw"], g["filtered"], g["typed"]) for g in L.ranks(df(test), df(known), ents, rels, links_a_row=5).collect()}
    want, there = {}, set(known)
    for h, t, r in test:
        for side in ("head", "tail"):
            pair = lambda e: (e, t) if side == "head" else (h, e)  # noqa: B023, E731
            s = {e: round(float(S.transe(x[[pair(e)[0]]], rel[[r]], x[[pair(e)[1]]])[0]), 6) for e in range(60)}
            own = h if side == "head" else t
            better = [e for e in range(60) if e != own and s[e] < s[own]]
            fits = {k[0] if side == "head" else k[1] for k in known if k[2] == r}
            want[h, t, r, side] = (1 + len(better), 1 + sum((*pair(e), r) not in there for e in better), 1 + len(fits & set(better)))
    assert got == want
    ids = {c: np.array([k[i] for k in test]) for i, c in enumerate("htr")}
    side = L._Side(1, {"h2": x[ids["h"]], "r2": rel[ids["r"]], "t2": x[ids["t"]]}, ids, np.zeros(len(test)))
    assert len(side.aim) == len({(h, r) for h, _, r in test}) < len(test)


def test_metrics_read_the_ranks_once(spark):
    r = spark.range(40).selectExpr("if(id % 2 = 0, 'head', 'tail') as side", "id + 1 as raw", "id + 1 as filtered", "id div 2 + 1 as typed")
    m = L.metrics(r)
    assert m._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
    got = {(x["side"], x["kind"]): (x["hits10"], x["mr"]) for x in m.collect()}
    assert len(got) == 9 and got["both", "raw"] == (0.25, 20.5) and got["tail", "typed"] == (0.5, 10.5)


@pytest.mark.parametrize("dim", [1, 7, 100])
def test_distances_in_steps_keep_to_their_error(dim):
    rng = np.random.default_rng(dim)
    e = np.vstack([S.unit(rng.normal(size=(60, dim))), np.zeros((4, dim))])
    aim = np.vstack([S.unit(rng.normal(size=(20, dim))) - S.unit(rng.normal(size=(20, dim))), 2 * np.eye(dim)[:1]])
    for x in (e, e[60:]):
        small = L._Small(x, 16)
        got, error = small.distances(aim)
        off = np.abs(got * small.step - np.abs(aim[:, None] - x[None]).sum(2))
        assert (off <= error[:, None] + 1e-9).all() and error.max() < 0.02 * dim


def test_losses_in_slices_leave_nothing_behind(spark, monkeypatch):
    from spanloom.plans import ranking
    from spanloom.runtime import stage

    rng = np.random.default_rng(6)
    t = stage(spark.createDataFrame(sorted({(int(h), int(x), int(h + x) % 2) for h, x in rng.integers(0, 30, (200, 2))}), "h long, t long, r int"))
    v = stage(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(28, 6)))], "id long, vec array<double>"))  # two without a vector
    rel = stage(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(2, 6)))], "r int, vec array<double>"))
    pool = stage(sampling.entity_pool(t))
    want = L.losses(ranking.score_pairs(t, t, pool, pool.count(), v, rel, 4), 5.0).first()
    seen, sums = [], L.loss_sums
    monkeypatch.setattr(L, "loss_sums", lambda pairs, margin: (seen.append(1), sums(pairs, margin))[1])
    at = os.path.dirname(t._staged.removeprefix("file://"))
    before = set(os.listdir(at))
    got = ranking._losses(t, pool, v, rel, 4, least=100).first()
    assert len(seen) == -(-4 * t.count() // 100) > 3 and set(os.listdir(at)) == before
    assert tuple(got) == pytest.approx(tuple(want), abs=1e-12)


def test_losses_are_made_where_the_triples_are(spark, monkeypatch):
    from spanloom.plans import ranking
    from spanloom.runtime import stage

    rng = np.random.default_rng(7)
    rows = {(int(h), int(x), int(h + x) % 2) for h, x in rng.integers(0, 30, (200, 2))} | {(3, x, 1) for x in range(30)} | {(4, x, 0) for x in range(28)} | {(5, 6, 2)}
    t = stage(spark.createDataFrame(sorted(rows), "h long, t long, r int"))  # a head with all tails known, one with two free, a relation without a vector
    vec = rng.normal(size=(29, 6))
    vec[8] = 0
    v = stage(spark.createDataFrame([(i + 40 * (i == 28), x.tolist()) for i, x in enumerate(vec)], "id long, vec array<double>").repartition(3))  # one of no entity
    rel = stage(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(2, 6)))], "r int, vec array<double>"))
    pool = stage(sampling.entity_pool(t))
    want = L.losses(ranking.score_pairs(t, t, pool, pool.count(), v, rel, 4), 5.0).first()
    monkeypatch.setattr(ranking, "score_pairs", None)  # no pair is joined with vectors
    for chunk in (250_000, 7):
        assert tuple(ranking._all_losses(t, pool, v, rel, 4, chunk=chunk).first()) == pytest.approx(tuple(want), abs=1e-12)
    monkeypatch.setattr(L, "readable", lambda path: False)
    monkeypatch.setattr(ranking, "_losses", lambda *a: "slices")
    assert ranking._all_losses(t, pool, v, rel, 4) == "slices"


def test_threshold_and_losses(spark):
    s = spark.createDataFrame([(0.1, 1), (0.2, 1), (0.3, 0), (0.4, 1), (0.5, 0)], "score double, y int")
    r = L.best_threshold(s).first()
    assert (r["threshold"], r["accuracy"]) == (0.2, 0.8)
    p = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0)], "pos_id string, p double, n double")
    x = L.losses(p, 5.0).first()
    assert abs(x["margin"] - 3.5) < 1e-9
    w = np.exp([-2.0, -3.0])
    sp = lambda z: np.log1p(np.exp(z))
    assert abs(x["adversarial"] - (sp(1.0) + (w * sp(np.array([-2.0, -3.0]))).sum() / w.sum()) / 2) < 1e-9


def test_enrichment_and_mix(spark):
    t = spark.createDataFrame([(1, "a", 2)], "item_id long, term string, cnt long")
    sim = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.85)], "term string, other string, prob double")
    got = {r["term"]: r["weight"] for r in O.enrich_normalised(t, sim).collect()}
    assert got == pytest.approx({"a": 0.5, "b": 0.225, "c": 0.2125})
    s = spark.createDataFrame([(1, 9, 0.8)], "item_id long, repo long, score double")
    u = spark.createDataFrame([(1, 9, 1.2)], "item_id long, repo long, score double")
    assert O.combined(s, u, 0.35).first()["score"] == pytest.approx(1.06)


def test_negatives_are_drawn_where_the_triples_are(spark):
    # A hub whose heads are nearly all known, and relations with few triples: first draws are known and unknown.
    rows = [(k, 7, 0) for k in range(60) if k % 9] + [(k, (k * 5 + 1) % 60, 1) for k in range(60)]
    t = spark.createDataFrame(rows, "h long, t long, r int")
    tail = lambda j: (F.col("h") + j) % 2 == 0
    pool = sampling.entity_pool(t).localCheckpoint()
    sure, left = sampling.first_draws(t, pool, 6, tail)
    assert "Exchange" not in sure._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    values = [r["value"] for r in pool.orderBy("idx").collect()]
    want = {}
    for h, x, r in rows:
        for j in range(1, 7):
            v = values[(h * 31 + x * 17 + r * 7 + j * 104729) % len(values)]
            want[h, x, r, j] = (h, v) if (h + j) % 2 == 0 else (v, x)
    there = set(rows)
    free = {k: v for k, v in want.items() if (*v, k[2]) not in there}
    got = {(r["h"], r["t"], r["r"], r["j"]): (r["nh"], r["nt"]) for r in sure.collect()}
    rest = {(r["h"], r["t"], r["r"], r["j"]) for r in left.collect()}
    assert got.items() <= free.items() and len(got) > 0.9 * len(free)
    assert rest == set(want) - set(got) and all(r["tail"] == ((r["h"] + r["j"]) % 2 == 0) for r in left.collect())


def test_negatives_are_the_same_with_and_without_a_sent_pool(spark, monkeypatch):
    from spanloom.plans.sampling import negatives

    rows = [(k, 7, 0) for k in range(40) if k % 9] + [(k, (k * 5 + 1) % 40, 1) for k in range(40)]
    t = spark.createDataFrame(rows, "h long, t long, r int")
    turn = lambda j: (F.col("h") * 31 + F.col("t") * 17 + F.col("r") * 7) % 2 == 1
    got = []
    for most in (sampling.MOST_SENT, 0):
        monkeypatch.setattr(sampling, "MOST_SENT", most)
        got.append(sorted(map(tuple, negatives(t, 5, turn).select("h", "t", "r", "j", "nh", "nt").collect())))
    assert got[0] == got[1] and len(got[0]) == 5 * len(rows)


def test_reciprocal_ranks(spark):
    ranked = spark.createDataFrame([(1, 1, "x"), (2, 1, "y"), (2, 3, "z"), (3, 1, "q")], "item_id long, rank int, answer string")
    want = spark.createDataFrame([(1, "x"), (2, "z"), (3, "none")], "item_id long, answer string")
    r = O.success_and_reciprocal_rank(ranked, want).first()
    assert r["success"] == 2 and r["rr_sum"] == pytest.approx(4 / 3) and r["mrr"] == pytest.approx(4 / 9)


def test_training_losses_fall(spark):
    t = spark.createDataFrame([(i % 20, (i + 1) % 20, 0) for i in range(400)], "h long, t long, r long")
    _, _, h = sgd.train_transe(t, 20, 1, dim=8, rounds=4, rate=20.0)
    assert h[-1] < h[0]
    p = spark.createDataFrame([(i % 10, i % 10 // 5 * 5) for i in range(2000)], "u long, v long")
    _, h = sgd.train_pairs(p, 10, dim=8, rounds=6, rate=0.01, negatives=2)
    assert h[-1] < h[0]
    with pytest.raises(ValueError):
        sgd.train_transe(t, 20, 1, most=5)


def test_training_takes_all_negatives_of_all_rounds(spark, monkeypatch):
    import inspect

    from spanloom.plans import learning

    want = inspect.signature(sgd.train_transe).parameters
    assert {k: want[k].default for k in ("dim", "rounds", "rate", "margin", "negatives", "batches")} == {"dim": 200, "rounds": 1000, "rate": 1.0, "margin": 5.0, "negatives": 25, "batches": 100}
    given = []
    monkeypatch.setattr(learning.sgd, "train_transe", lambda *a, **k: (given.append((len(a), k)), (0, 0, [1.0]))[1])
    learning.train_transe(spark, "/root/testdata/sf0.001")
    assert given == [(3, {})]  # the registered query changes none of them
    monkeypatch.undo()
    rows = [(i, 40, 0) for i in range(39)] + [(i, 10 * (i // 10), 1) for i in range(40)]
    t = spark.createDataFrame(rows, "h long, t long, r long").repartition(2)
    for least in (2000, 20):  # one task, and two that are averaged
        _, _, h = sgd.train_transe(t, 41, 2, dim=16, rounds=25, apart=10, least=least)
        assert len(h) == 25 and h[-1] < h[9] < h[0]


def test_negatives_of_the_training_are_unknown(spark):
    t = spark.createDataFrame([(h, 7, 0) for h in range(20) if h != 5] + [(3, x, 1) for x in range(20)], "h long, t long, r int")
    known, draw = sampling.known_filter(t), np.random.default_rng(1)
    col = lambda v, n: np.full(n, v)
    head = sgd._corrupted(known, col(2, 50), col(7, 50), col(0, 50), np.zeros(50, bool), 20, draw, most=2)
    assert (head == 5).all()
    assert (sgd._corrupted(known, col(3, 50), col(7, 50), col(1, 50), np.ones(50, bool), 20, draw) == -1).all()
    tail = sgd._corrupted(known, col(2, 500), col(7, 500), col(0, 500), np.ones(500, bool), 20, draw)
    assert set(tail) == set(range(20)) - {7}


def test_a_step_of_the_training_goes_down_the_gradient():
    rng = np.random.default_rng(0)
    e, r = rng.normal(size=(7, 5)), rng.normal(size=(2, 5))
    (x, y), z, w, tail = rng.integers(0, 7, (2, 6)), rng.integers(0, 2, 6), rng.integers(0, 7, (6, 4)), rng.random((6, 4)) < 0.5
    w[2, 1] = -1

    def loss(e, r):
        other = lambda side, end: np.where(side[:, :, None], e[end][:, None], e[w])
        d = S.unit(e)[x] + S.unit(r)[z] - S.unit(e)[y]
        n = S.unit(other(tail, x)) + S.unit(r)[z][:, None] - S.unit(other(~tail, y))
        return np.maximum(np.abs(d).sum(1)[:, None] - np.abs(n).sum(2) + 5, 0) * (w >= 0)

    was = (e.copy(), r.copy())
    got = sgd._step(e, r, x, y, z, w, tail, 1e-3, 5.0)
    assert got == pytest.approx((loss(*was).sum(1) / (w >= 0).sum(1)).sum())
    for k, now in enumerate((e, r)):
        for i in np.ndindex(now.shape):
            up, down = ([v.copy() for v in was] for _ in range(2))
            up[k][i] += 1e-6
            down[k][i] -= 1e-6
            assert (was[k][i] - now[i]) / 1e-3 == pytest.approx((loss(*up).sum() - loss(*down).sum()) / 2e-6, abs=1e-4)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(100 + i, 101 + i) for i in range(40)] + [(200, 200 + i) for i in range(20)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {(x, find(x)) for x in root if any(x in e and e[0] != e[1] for e in edges)}
    got = [tuple(r) for r in G.components(spark.createDataFrame(edges, "a long, b long")).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert G.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tfidf_ways_agree(spark):
    rng = np.random.default_rng(8)
    text = lambda n: " ".join(f"t{x}" for x in rng.zipf(1.6, n) % 50)
    docs = spark.createDataFrame([(i, text(30)) for i in range(120)] + [(900, ""), (901, None)], "doc_id long, text string")
    q = spark.createDataFrame([(i, text(6)) for i in range(9)] + [(99, "unseen"), (98, None)], "item_id long, query string")
    t = lambda c: F.filter(F.split(c, " "), lambda x: x != "")
    get = lambda **kw: sorted(tuple(r) for r in O.top_documents(docs, t("text"), q, t("query"), 7, **kw).collect())
    want = get()
    assert want and get(most_terms=1) == want


def _shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {str(blocks.apply(i)) for i in range(blocks.size()) if str(blocks.apply(i)).startswith("shuffle_")}


def test_staged_tables_leave_no_shuffle_files(spark):
    from spanloom.runtime import discard, stage

    before, kept = _shuffle_files(spark), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    x = stage(spark.range(1000).selectExpr("id % 77 as k").groupBy("k").count())
    assert x.count() == 77 and x.agg(F.sum("count")).first()[0] == 1000
    assert len({n for n in _shuffle_files(spark) - before if n.endswith(".data")}) <= 8  # of the two counts here, of one row a task
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == kept
    alone = _shuffle_files(spark)
    y = stage(spark.range(1000).selectExpr("id % 77 as k").groupBy("k").count())
    assert _shuffle_files(spark) <= alone
    discard(x)
    assert not os.path.exists(x._staged.removeprefix("file://")) and os.path.exists(y._staged.removeprefix("file://"))


def test_the_filter_of_known_triples_travels_small(spark):
    import pickle

    t = spark.range(20_000).selectExpr("id as h", "id * 7 % 1000 as t", "cast(id % 5 as int) as r")
    known = sampling.known_filter(t)
    data = pickle.dumps(known)
    assert len(data) < 0.6 * known.array.nbytes
    h = np.arange(20_000)
    for k in (known, pickle.loads(data)):
        assert k.may(h, h * 7 % 1000, h % 5).all()
        assert k.may(h, h * 7 % 1000 + 1000, h % 5).mean() < 0.01


def test_a_tile_of_the_search_hands_on_few_of_its_rows(monkeypatch):
    rng = np.random.default_rng(4)
    x = VO._unit(np.abs(rng.normal(size=(2500, 8))))  # every cosine is above the bound
    x[7] = x[900]  # a tie with a query's own vector
    handed, add = [], VO._Best.add
    monkeypatch.setattr(VO._Best, "add", lambda self, q, ids, sim: (handed.append(len(q)), add(self, q, ids, sim))[1])
    rows = pa.record_batch({"id": np.arange(2500), "vec": pa.array(list(x), pa.list_(pa.float64()))})
    shared = SimpleNamespace(value=(np.arange(600), x[:600]))
    out = pa.Table.from_batches(list(VO._scan(shared, 8, 0.1, 2)([rows]))).to_pandas()
    assert max(handed) <= 512 * 10
    sim = np.rint((x[:600] @ x.T) * 1e9)
    sim[np.arange(600), np.arange(600)] = -1e18
    want = {(a, b) for a in range(600) for b in np.lexsort((np.arange(2500), -sim[a]))[:2]}
    assert {(a, b) for a, b in zip(out["a"], out["b"])} == want


def test_parameters_are_averaged_in_blocks(spark):
    rows = spark.range(2, numPartitions=2)
    n = 3 * sgd._BLOCK + 5

    def run(batches):
        for b in batches:
            for i in b.column("id").to_pylist():
                x = np.full((n, 2), 1.0 + i)
                seen = np.ones(n, bool) if i else np.arange(n) % 2 == 0
                yield from sgd._out({"e": (seen, x)}, 2.0, 4)

    into, before = {"e": np.zeros((n, 2), np.float32)}, _shuffle_files(spark)
    assert sgd._average(rows.mapInArrow(run, sgd._SCHEMA), into) == 0.5
    assert (into["e"] == np.where(np.arange(n) % 2 == 0, 1.5, 2.0)[:, None]).all()
    assert _shuffle_files(spark) <= before
