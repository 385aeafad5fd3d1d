"""Queries of triple scores and link prediction over the entity vectors and mean relation vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from spanloom.functions import triple_scores as S, vector as V
from spanloom.operators import linkpred as L, sampling
from spanloom.plans.registry import Registry
from spanloom.plans.vectors import REL_SQL, TRI_SQL, VEC_SQL, relation_vectors, triples, vectors
from spanloom.runtime import passing, stage

R = Registry()

_N = "list_transform({0}, lambda x: x / sqrt(list_dot_product({0}, {0})))"
_BASE = f"{TRI_SQL}, {VEC_SQL}, {REL_SQL}, nv as (select id, case when list_dot_product(vec, vec) > 0 then {_N.format('vec')} else vec end as vec from v), nr as (select r, {_N.format('vec')} as vec from rel)"
_L1 = "list_sum(list_transform(list_zip({a}, {b}, {c}), lambda p: abs(p[1] + p[2] - p[3])))"


def _scored(spark, d, score):
    return L.score_rows(L.with_vectors(triples(spark, d), vectors(spark, d), relation_vectors(spark, d)), score)


@R.add("score_transe", f"with {_BASE} select h, t, tri.r, round({_L1.format(a='a.vec', b='nr.vec', c='b.vec')}, 6) as score from tri join nv a on a.id = h join nv b on b.id = t join nr on nr.r = tri.r")
def score_transe(spark, d):
    return _scored(spark, d, S.transe).select("h", "t", "r", F.round("score", 6).alias("score"))


_TRI3 = "from tri join v a on a.id = h join v b on b.id = t join rel on rel.r = tri.r"


@R.add("score_distmult", f"with {_BASE} select h, t, tri.r, round(-list_sum(list_transform(list_zip(a.vec, rel.vec, b.vec), lambda p: p[1] * p[2] * p[3])), 7) + 0.0 as score {_TRI3}")
def score_distmult(spark, d):
    j = L.with_vectors(triples(spark, d), vectors(spark, d), relation_vectors(spark, d))
    return j.select("h", "t", "r", (F.round(-V.dot(F.zip_with("hv", "rv", lambda x, y: x * y), F.col("tv")), 7) + 0.0).alias("score"))


@R.add("score_complex", f"""with {_BASE} select h, t, tri.r, round(-list_sum(list_transform(range(1, 51), lambda i: a.vec[i] * rel.vec[i] * b.vec[i] + a.vec[i] * rel.vec[i + 50] * b.vec[i + 50]
+ a.vec[i + 50] * rel.vec[i] * b.vec[i + 50] - a.vec[i + 50] * rel.vec[i + 50] * b.vec[i])), 7) + 0.0 as score {_TRI3}""")
def score_complex(spark, d):
    return _scored(spark, d, S.complex_).select("h", "t", "r", (F.round("score", 7) + 0.0).alias("score"))


def _all_models(h, r, t):
    """Every model; parameters that the data lack are derived from the relation vector."""
    n, d = h.shape
    w = r[:, ::-1]
    m = np.eye(d)[None] + 0.1 * r[:, :, None] * w[:, None, :]
    return {
        "transe": S.transe(h, r, t), "transh": S.transh(h, r, t, w), "transr": S.transr(h, r, t, m), "transd": S.transd(h, r, t, h[:, ::-1], t[:, ::-1], w),
        "rotate": S.rotate(h, np.pi * r[:, : d // 2], t), "distmult": S.distmult(h, r, t), "complex": S.complex_(h, r, t), "simple": S.simple(h, r, t),
        "rescal": S.rescal(h, m, t), "analogy": S.analogy(h, r, t, h, r, t), "hole": S.hole(h, r, t),
    }


_UNIT = "case when list_dot_product({0}, {0}) > 0 then list_transform({0}, lambda x: x / sqrt(list_dot_product({0}, {0}))) else {0} end"
_PLUS = "list_transform(list_zip({a}, {b}), lambda p: p[1] + {f} * p[2])"  # a + f * b
# Eleven scores from list formulas: w is r reversed, M = I + 0.1 r w', the normal of transh is w, transfer vectors are reversed ones.
_MODELS_SQL = f"""with {_BASE}, x as (select h, t, tri.r, a.vec as a, rel.vec as q, b.vec as b, list_reverse(rel.vec) as w {_TRI3}),
y as (select *, {_UNIT.format('w')} as wn, list_dot_product(a, q) as aq, list_dot_product(b, q) as bq, list_dot_product(a, list_reverse(a)) as aa, list_dot_product(b, list_reverse(b)) as bb from x),
z as (select *, {_PLUS.format(a='a', b='wn', f='(-list_dot_product(a, wn))')} as ha, {_PLUS.format(a='b', b='wn', f='(-list_dot_product(b, wn))')} as hb, {_PLUS.format(a='a', b='w', f='0.1::double * aq')} as ra, {_PLUS.format(a='b', b='w', f='0.1::double * bq')} as rb,
    {_PLUS.format(a='a', b='w', f='aa')} as da, {_PLUS.format(a='b', b='w', f='bb')} as db from y),
n as (select *, {_UNIT.format('q')} as uq, {_UNIT.format('a')} as ua, {_UNIT.format('b')} as ub, {_UNIT.format('ha')} as uha, {_UNIT.format('hb')} as uhb, {_UNIT.format('ra')} as ura, {_UNIT.format('rb')} as urb, {_UNIT.format('da')} as uda, {_UNIT.format('db')} as udb,
    -list_sum(list_transform(list_zip(a, q, b), lambda p: p[1] * p[2] * p[3])) as dm,
    -list_sum(list_transform(range(1, 51), lambda i: a[i] * q[i] * b[i] + a[i] * q[i + 50] * b[i + 50] + a[i + 50] * q[i] * b[i + 50] - a[i + 50] * q[i + 50] * b[i])) as cx from z)
select h, t, r, round({_L1.format(a='ua', b='uq', c='ub')}, 6) as transe, round({_L1.format(a='uha', b='uq', c='uhb')}, 6) as transh, round({_L1.format(a='ura', b='uq', c='urb')}, 6) as transr, round({_L1.format(a='uda', b='uq', c='udb')}, 6) as transd,
    round(list_sum(list_transform(range(1, 51), lambda i: sqrt((a[i] * cos(pi() * q[i]) - a[i + 50] * sin(pi() * q[i]) - b[i]) ** 2 + (a[i] * sin(pi() * q[i]) + a[i + 50] * cos(pi() * q[i]) - b[i + 50]) ** 2))) - 6, 6) + 0.0 as rotate,
    round(dm, 6) + 0.0 as distmult, round(cx, 6) + 0.0 as complex, round(dm, 6) + 0.0 as simple, round(list_dot_product(a, b) + 0.1::double * aq * list_dot_product(w, b), 6) + 0.0 as rescal, round(cx + dm, 6) + 0.0 as analogy,
    round(-list_sum(list_transform(range(0, 100), lambda k: q[k + 1] * list_dot_product(a, list_concat(b[k + 1:], b[1:k])))), 6) + 0.0 as hole from n"""


@R.add("score_models", _MODELS_SQL)
def score_models(spark, d):
    """All eleven scores of every triple (GL27)."""
    import pyarrow as pa

    j = L.with_vectors(triples(spark, d), vectors(spark, d), relation_vectors(spark, d)).select("h", "t", "r", "hv", "rv", "tv")
    names = ["transe", "transh", "transr", "transd", "rotate", "distmult", "complex", "simple", "rescal", "analogy", "hole"]

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, 512):
                c = b.slice(s, 512)
                if c.num_rows:
                    x = _all_models(L._m(c, "hv"), L._m(c, "rv"), L._m(c, "tv"))
                    yield pa.RecordBatch.from_arrays([c.column(k) for k in ("h", "t", "r")] + [pa.array(np.asarray(x[k], np.float64)) for k in names], ["h", "t", "r", *names])

    return j.mapInArrow(run, "h long, t long, r int, " + ", ".join(f"{k} double" for k in names)).select("h", "t", "r", *((F.round(k, 6) + 0.0).alias(k) for k in names))


# A stated query set: the triples whose h + t is divisible by 20, ranked against all entities.
_CAND = f"""{_BASE}, te as (select h, t, tri.r, a.vec as hv, nr.vec as rv, b.vec as tv, round({_L1.format(a='a.vec', b='nr.vec', c='b.vec')}, 6) as s from tri join nv a on a.id = h join nv b on b.id = t join nr on nr.r = tri.r where (h + t) % 20 = 0),
ca as (select te.h, te.t, te.r, 'tail' as side, nv.id as e, round({_L1.format(a='hv', b='rv', c='nv.vec')}, 6) < s as better from te, nv where nv.id <> te.t
union all select te.h, te.t, te.r, 'head', nv.id, round({_L1.format(a='nv.vec', b='rv', c='tv')}, 6) < s from te, nv where nv.id <> te.h),
kt as (select distinct r, 'tail' as side, t as e from tri union select distinct r, 'head', h from tri),
kk as (select ca.*, exists (select 1 from tri x where x.r = ca.r and x.h = case when side = 'tail' then ca.h else ca.e end and x.t = case when side = 'tail' then ca.e else ca.t end) as known, exists (select 1 from kt where kt.r = ca.r and kt.side = ca.side and kt.e = ca.e) as fits from ca where better),
rk as (select te.h, te.t, te.r, sd.side, 1 + count(kk.e) as raw, 1 + count(case when not known then 1 end) as filtered, 1 + count(case when fits then 1 end) as typed from te cross join (values ('head'), ('tail')) as sd(side) left join kk on kk.h = te.h and kk.t = te.t and kk.r = te.r and kk.side = sd.side group by all)"""


def _ranks(spark, d):
    t = stage(triples(spark, d), "triples")
    return L.ranks(t.where("(h + t) % 20 = 0"), t, stage(vectors(spark, d), "vectors"), stage(relation_vectors(spark, d), "relations"))


@R.add("link_ranks", f"with {_CAND} select h, t, r, side, raw, filtered, typed from rk")
def link_ranks(spark, d):
    """Raw, filtered and type-constrained ranks by TransE (JN14 - JN16, AG17)."""
    return _ranks(spark, d)


_MET = "round(avg((rank <= 1)::int), 6) as hits1, round(avg((rank <= 3)::int), 6) as hits3, round(avg((rank <= 10)::int), 6) as hits10, round(avg(rank), 6) as mr, round(avg(1.0::double / rank), 6) as mrr"


@R.add("linkpred_metrics", f"with {_CAND}, l as (select side, 'raw' as kind, raw as rank from rk union all select side, 'filtered', filtered from rk union all select side, 'typed', typed from rk) select side, kind, {_MET} from (select * from l union all select 'both', kind, rank from l) group by side, kind")
def linkpred_metrics(spark, d):
    """Hits, mean rank and reciprocal rank (AG18, GL21)."""
    m = L.metrics(_ranks(spark, d))
    return m.select("side", "kind", *(F.round(c, 6).alias(c) for c in ("hits1", "hits3", "hits10", "mr", "mrr")))


@R.add("relation_rank", f"with {_BASE}, s as (select h, t, tri.r, nr.r as r2, round({_L1.format(a='a.vec', b='nr.vec', c='b.vec')}, 6) as s from tri join nv a on a.id = h join nv b on b.id = t, nr) select x.h, x.t, x.r, (1 + count(y.r2))::bigint as rank from (select * from s where r = r2) x left join s y on y.h = x.h and y.t = x.t and y.r = x.r and y.s < x.s group by all")
def relation_rank(spark, d):
    """The rank of the true relation among all relations (AG17): eleven candidates a triple, the relation table is broadcast."""
    rel = relation_vectors(spark, d)
    n = rel.select(F.col("r").alias("r2"), "vec").agg(F.collect_list(F.struct("r2", "vec")).alias("all"))  # one row of at most a few relations
    rows = [(x["r2"], x["vec"]) for x in n.first()["all"]]
    j = L.with_vectors(triples(spark, d), vectors(spark, d), rel)
    import pyarrow as pa

    def run(batches):
        ids = np.array([r for r, _ in rows])
        for b in batches:
            if b.num_rows:
                h, t, r = L._m(b, "hv"), L._m(b, "tv"), b.column("r").to_numpy()
                s = np.stack([np.round(S.transe(h, np.tile(np.array(v), (len(h), 1)), t), 6) for _, v in rows], 1)
                own = s[np.arange(len(r)), np.searchsorted(ids, r)] if (np.sort(ids) == ids).all() else s[np.arange(len(r)), [list(ids).index(x) for x in r]]
                yield pa.record_batch({"h": b.column("h"), "t": b.column("t"), "r": b.column("r"), "rank": 1 + (s < own[:, None]).sum(1)})

    return j.select("h", "t", "r", "hv", "tv").mapInArrow(run, "h long, t long, r int, rank long")


_NEG = """ents as (select h as e from tri union select t from tri), pool as (select e as value, row_number() over (order by e) - 1 as idx from ents), sz as (select count(*) as size from ents),
nc as (select tri.*, k, value from tri, sz, unnest(range(64)) as u(k) join pool on idx = (h * 31 + t * 17 + r * 7 + k * 7919) % size),
ng as (select h, t, r, value from nc where not exists (select 1 from tri x where x.h = nc.h and x.t = nc.value and x.r = nc.r) qualify row_number() over (partition by h, t, r order by k) = 1)"""
_PAIR = f"""{_BASE}, {_NEG}, ps as (select h, t, tri.r, {_L1.format(a='a.vec', b='nr.vec', c='b.vec')} as p from tri join nv a on a.id = h join nv b on b.id = t join nr on nr.r = tri.r),
ns as (select h, t, ng.r, {_L1.format(a='a.vec', b='nr.vec', c='b.vec')} as n from ng join nv a on a.id = h join nv b on b.id = value join nr on nr.r = ng.r), pn as (select p, n from ps join ns using (h, t, r))"""


def _parts(spark, d):
    """What pairs are made of: triples, candidates, entity and relation vectors."""
    t = stage(triples(spark, d), "triples")
    pool = stage(sampling.entity_pool(t), "pool")
    v = stage(vectors(spark, d), "vectors")
    return t, pool, v, relation_vectors(spark, d, t, v)


def score_pairs(t, known, pool, size, v, rel, many=None):
    """(pos_id, p, n): the TransE score of every triple of t and of one or `many` corrupted tails."""
    todo = t.withColumn("size", F.lit(size))
    todo = todo.withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(many)))) if many else todo
    neg = sampling.corrupt(todo, known, "t", pool, "size", "idx", number="j" if many else None).where("value is not null")
    p = L.score_rows(L.with_vectors(t, v, rel).select("h", "t", "r", "hv", "rv", "tv"), S.transe, "p")
    n = L.score_rows(L.with_vectors(neg, v, rel, ("h", "value")).select("h", "t", "r", "hv", "rv", "tv"), S.transe, "n")
    return p.join(n, ["h", "t", "r"]).select(F.concat_ws("-", "h", "t", "r").alias("pos_id"), "p", "n")


@R.add("triple_threshold", f"with {_PAIR}, sc as (select round(p, 6) as s, 1 as y from pn union all select round(n, 6), 0 from pn), g as (select s, sum(y) as p, sum(1 - y) as q from sc group by s), a as (select s, (sum(p - q) over (order by s) + (select sum(q) from g))::double / (select sum(p + q) from g) as acc from g) select arg_max(s, (acc, -s)) as threshold, round(max(acc), 8) as accuracy from a")
def triple_threshold(spark, d):
    """The score that best separates triples from corrupted ones (AG19, WN11, GL22)."""
    t, pool, v, rel = _parts(spark, d)
    x = score_pairs(t, t, pool, pool.count(), v, rel)
    both = x.select(F.col("p").alias("score"), F.lit(1).alias("y")).union(x.select("n", F.lit(0)))
    return L.best_threshold(both).select("threshold", F.round("accuracy", 8).alias("accuracy"))


_MANY_NEG = """ents as (select h as e from tri union select t from tri), pool as (select e as value, row_number() over (order by e) - 1 as idx from ents), sz as (select count(*) as size from ents),
tj as (select tri.*, j from tri, unnest(range(1, 26)) as w(j)),
n1 as (select tj.*, k, value from tj, sz, unnest(range(4)) as u(k) join pool on idx = (h * 31 + t * 17 + r * 7 + j * 104729 + k * 7919) % size),
g1 as (select h, t, r, j, value from n1 where not exists (select 1 from tri x where x.h = n1.h and x.t = n1.value and x.r = n1.r) qualify row_number() over (partition by h, t, r, j order by k) = 1),
t2 as (select tj.* from tj anti join g1 using (h, t, r, j)),
n2 as (select t2.*, k, value from t2, sz, unnest(range(4, 64)) as u(k) join pool on idx = (h * 31 + t * 17 + r * 7 + j * 104729 + k * 7919) % size),
g2 as (select h, t, r, j, value from n2 where not exists (select 1 from tri x where x.h = n2.h and x.t = n2.value and x.r = n2.r) qualify row_number() over (partition by h, t, r, j order by k) = 1),
ng as (select * from g1 union all select * from g2)"""
_MANY_PAIR = _PAIR.replace(_NEG, _MANY_NEG).replace("pn as (select p, n from", "pn as (select h, t, r, p, n from")
_SP = "greatest({0}, 0) + ln(1 + exp(-abs({0})))"


@R.add("losses", f"""with {_MANY_PAIR}, per as (select h, t, r, avg(greatest(p - n, -5)) as m, avg({_SP.format('p')}) as a, avg({_SP.format('(-n)')}) as b, sum(exp(-n) * ({_SP.format('(-n)')})) / sum(exp(-n)) as c from pn group by h, t, r)
select round(avg(m) + 5, 6) as margin, round((avg(a) + avg(b)) / 2, 6) as softplus, round((avg(a) + avg(c)) / 2, 6) as adversarial from per""")
def losses(spark, d):
    """Margin, softplus and self-adversarial losses over 25 negatives a triple (GL19, GL20)."""
    return _all_losses(*_parts(spark, d)).select(*(F.round(c, 6).alias(c) for c in ("margin", "softplus", "adversarial")))


def _all_losses(t, pool, v, rel, many=25, margin=5.0, chunk=250_000):
    """Scores are made where the triples are, from the written vectors; a task gives five sums, whatever the number of negatives.

    In slices where the tasks' Python can't read the shared folder, or the candidates are too many to be sent.
    """
    spark, size = t.sparkSession, pool.count()
    if size > sampling.MOST_SENT or not L.readable(v._staged):
        return _losses(t, pool, v, rel, many, margin)
    shared = sampling.sent(t, pool)
    _, left = sampling.first_draws(t, pool, many, lambda j: F.lit(True), shared)
    again = sampling.corrupt(left.drop("tail").withColumn("size", F.lit(size)), t, "t", pool, "size", "idx", number="j")
    again = again.groupBy("h", "t", "r").agg(F.collect_list("j").alias("js"), F.collect_list(F.coalesce("value", F.lit(-1))).alias("values"))
    rows = t.join(again, ["h", "t", "r"], "left").select("h", "t", "r", *(F.coalesce(c, F.array().cast(k)).alias(c) for c, k in (("js", "array<int>"), ("values", "array<long>"))))
    parts = max(2 * spark.sparkContext.defaultParallelism, -(-t.count() // chunk))
    sums = L.loss_sums_in_place(rows.repartition(parts, "h"), shared, v._staged, {x["r"]: x["vec"] for x in rel.toLocalIterator()}, many, margin, chunk)
    return L.mean_losses(stage(sums, "sums"), margin)


def _losses(t, pool, v, rel, many=25, margin=5.0, least=2_000_000):
    """Every triple is in one of some slices, which follow each other: a negative meets two vectors, so the pairs of all
    triples would be some 1.7 KB each on disk at once. A slice has `least` negatives, or three for each vector."""
    spark, size = t.sparkSession, pool.count()
    slices = max(1, -(-many * t.count() // max(least, 3 * v.count())))
    sums = []
    for k in range(slices):
        with passing(spark):
            part = t.where(F.pmod(F.xxhash64("h", "t", "r"), F.lit(slices)) == k)
            sums.append(stage(L.loss_sums(score_pairs(part, t, pool, size, v, rel, many), margin), "sums").first())
    return L.mean_losses(spark.createDataFrame(sums, "n long, m double, a double, b double, c double"), margin)


@R.add("regularisation", f"with {_BASE}, q as (select list_dot_product(a.vec, a.vec) / 100 as x, list_dot_product(rel.vec, rel.vec) / 100 as y, list_dot_product(b.vec, b.vec) / 100 as z {_TRI3}) select round((avg(x) + avg(y) + avg(z)) / 3, 8) as squares, (select round(sum(list_sum(list_transform(vec, lambda x: abs(x) ** 3))), 4) from v) + (select round(sum(list_sum(list_transform(vec, lambda x: abs(x) ** 3))), 4) from rel) as cubes from q")
def regularisation(spark, d):
    """The mean of mean squares of heads, relations and tails; the cubed 3-norms of all entity and relation vectors (AG27)."""
    cube = lambda v: v.agg(F.round(F.sum(F.aggregate("vec", F.lit(0.0), lambda a, x: a + F.pow(F.abs(x), F.lit(3.0)))), 4).alias("c"))
    cubes = cube(vectors(spark, d)).unionByName(cube(relation_vectors(spark, d))).agg(F.sum("c").alias("cubes"))
    j = L.with_vectors(triples(spark, d), vectors(spark, d), relation_vectors(spark, d))
    sq = lambda c: F.avg(V.dot(F.col(c), F.col(c)) / F.size(c))
    return j.agg(F.round((sq("hv") + sq("rv") + sq("tv")) / 3, 8).alias("squares")).join(F.broadcast(cubes))
