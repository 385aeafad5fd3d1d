"""Queries of splits, negative sampling and weighted draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import graph as G, metapath as M, sampling as S
from spanloom.plans.graphs import network
from spanloom.plans.registry import Registry
from spanloom.runtime import stage, table

R = Registry()
_TRI = "tri as (select distinct h, t, r from triples where r is not null)"


def tri(spark, d):
    return stage(table(spark, d, "triples").where("r is not null").select("h", "t", "r").distinct(), "triples")


@R.add("split_9_1", "with a as (select distinct readme_id from readmes), n as (select count(*) as n from a), o as (select readme_id, row_number() over (order by (readme_id * 7919 + 13) % 100003, readme_id) - 1 as p from a) select readme_id, case when p < n // 10 * 9 then 'train' else 'valid' end as part from o, n union all select readme_id, 'test' from a")
def split_9_1(spark, d):
    """Train and valid, and a test part that is a full copy, as the pipeline's is (GL1)."""
    ids = table(spark, d, "readmes").select("readme_id").distinct()
    return S.split_train(ids, "readme_id").unionByName(ids.withColumn("part", F.lit("test")))


_HASH3 = "(h * 31 + t * 17 + r * 7) % 100003"


@R.add("kg_split", f"with {_TRI}, n as (select count(*) as n from tri), o as (select h, t, r, row_number() over (order by {_HASH3}, h, t, r) - 1 as p from tri) select h, t, r, case when p < n // 10 * 8 then 'train' when p < n // 10 * 8 + (n - n // 10 * 8) // 2 then 'test' else 'valid' end as part from o, n")
def kg_split(spark, d):
    """Train, test and valid triples (GL2, ST6)."""
    return S.split_three(tri(spark, d), [F.pmod(F.col("h") * 31 + F.col("t") * 17 + F.col("r") * 7, F.lit(100003)), "h", "t", "r"])


@R.add("bern_prob", f"with {_TRI}, m as (select r, count(*)::double / count(distinct h) as tph, count(*)::double / count(distinct t) as hpt from tri group by r) select r, round(hpt / (hpt + tph), 10) as tail_prob from m")
def bern_prob(spark, d):
    return S.bernoulli(G.mapping_stats(table(spark, d, "triples"))).select("r", F.round("tail_prob", 10).alias("tail_prob"))


_POOL = "ents as (select h as e from tri union select t from tri), pool as (select e as value, row_number() over (order by e) - 1 as idx from ents), sz as (select count(*) as size from ents)"
_N0 = "(h * 31 + t * 17 + r * 7)"
_PICK = "qualify row_number() over (partition by h, t, r order by k) = 1"


@R.add("corrupt_tail", f"with {_TRI}, {_POOL}, c as (select tri.*, k, value from tri, sz, unnest(range(64)) as u(k) join pool on idx = (h * 31 + t * 17 + r * 7 + k * 7919) % size) select h, t, r, value from c where not exists (select 1 from tri x where x.h = c.h and x.t = c.value and x.r = c.r) {_PICK}")
def corrupt_tail(spark, d):
    """A new tail for every triple that makes no known one (GL8, GL9, JN14)."""
    t = tri(spark, d)
    pool = stage(S.entity_pool(t), "pool")
    return S.corrupt(t.withColumn("size", F.lit(pool.count())), t, "t", pool, "size", "idx")


@R.add("corrupt_head", f"with {_TRI}, {_POOL}, c as (select tri.*, k, value from tri, sz, unnest(range(64)) as u(k) join pool on idx = (h * 31 + t * 17 + r * 7 + k * 7919) % size) select h, t, r, value from c where not exists (select 1 from tri x where x.h = c.value and x.t = c.t and x.r = c.r) {_PICK}")
def corrupt_head(spark, d):
    t = tri(spark, d)
    pool = stage(S.entity_pool(t), "pool")
    return S.corrupt(t.withColumn("size", F.lit(pool.count())), t, "h", pool, "size", "idx")


@R.add("corrupt_typed", f"""with {_TRI}, rp as (select r, t as value, row_number() over (partition by r order by t) - 1 as idx from (select distinct r, t from tri)), sz as (select r, count(*) as size from rp group by r),
c as (select tri.*, k, value from tri join sz using (r), unnest(range(64)) as u(k) join rp on rp.r = tri.r and idx = (h * 31 + tri.t * 17 + tri.r * 7 + k * 7919) % size),
g as (select h, t, r, value from c where not exists (select 1 from tri x where x.h = c.h and x.t = c.value and x.r = c.r) {_PICK}),
l as (select tri.* from tri anti join g on g.h = tri.h and g.t = tri.t and g.r = tri.r),
fr as (select l.*, rp.value, row_number() over (partition by l.h, l.t, l.r order by idx) - 1 as p, count(*) over (partition by l.h, l.t, l.r) as n from l join rp using (r) where not exists (select 1 from tri x where x.h = l.h and x.t = rp.value and x.r = l.r)),
g2 as (select h, t, r, value from g union all select h, t, r, value from fr where p = {_N0} % n),
l2 as (select tri.* from tri anti join g2 on g2.h = tri.h and g2.t = tri.t and g2.r = tri.r), {_POOL.replace("sz as", "sa as")},
c2 as (select l2.*, k, value from l2, sa, unnest(range(64)) as u(k) join pool on idx = ({_N0} + k * 7919) % sa.size),
g3 as (select h, t, r, value from c2 where not exists (select 1 from tri x where x.h = c2.h and x.t = c2.value and x.r = c2.r) {_PICK})
select * from g2 union all select * from g3""")
def corrupt_typed(spark, d):
    """New tails among those seen with the relation; where all of these are known, among all entities (GL10)."""
    t = tri(spark, d)
    pool, size = S.typed_pool(t)
    got = stage(S.corrupt(t.join(F.broadcast(size), "r").select("h", "t", "r", "size"), t, "t", stage(pool, "pool"), "size", "idx"), "typed")
    every = stage(S.entity_pool(t), "pool")
    rest = got.where("value is null").select("h", "t", "r").withColumn("size", F.lit(every.count()))
    return got.where("value is not null").unionByName(S.corrupt(rest, t, "t", every, "size", "idx"))


@R.add("corrupt_relation", f"""with {_TRI}, rp as (select distinct r from tri), pool as (select r::bigint as value, row_number() over (order by r) - 1 as idx from rp), sz as (select count(*) as size from rp),
c as (select tri.*, k, value from tri, sz, unnest(range(64)) as u(k) join pool on idx = (h * 31 + t * 17 + r * 7 + k * 7919) % size),
g as (select h, t, r, value from c where not exists (select 1 from tri x where x.h = c.h and x.t = c.t and x.r = c.value) {_PICK}),
l as (select tri.* from tri anti join g on g.h = tri.h and g.t = tri.t and g.r = tri.r),
fr as (select l.*, value, row_number() over (partition by h, t, r order by idx) - 1 as p, count(*) over (partition by h, t, r) as n from l, pool where not exists (select 1 from tri x where x.h = l.h and x.t = l.t and x.r = value)),
f as (select * from g union all select h, t, r, value from fr where p = {_N0} % n) select tri.h, tri.t, tri.r, f.value from tri left join f on f.h = tri.h and f.t = tri.t and f.r = tri.r""")
def corrupt_relation(spark, d):
    """New relations (GL8, GL9)."""
    from spanloom.operators.order import positions

    t = tri(spark, d)
    pool = positions(t.select(F.col("r").cast("long").alias("value")).distinct(), ["value"], "idx")
    return S.corrupt(t.withColumn("size", F.lit(pool.count())), t, "r", pool, "size", "idx")


_SOFT = """with tri as (select distinct h, t, r from triples where r is not null), hr as (select distinct h, r from tri), n as (select r, count(*) as n from hr group by r),
c as (select a.r as r, b.r as r2, count(*) as both_n from hr a join hr b on a.h = b.h and a.r <> b.r group by all), s as (select c.r, r2, 1 - both_n::double / n as dist from c join n on n.r = c.r)"""


@R.add("relation_softmax", f"{_SOFT} select r, r2, round(exp(-dist / 0.5) / sum(exp(-dist / 0.5)) over (partition by r), 10) as prob from s")
def relation_softmax(spark, d):
    """How likely a relation is replaced by another, by the heads they share (SC18, GL11)."""
    return S.softmax_rows(relation_distances(spark, d), "r", "dist", 0.5).select("r", "r2", F.round("prob", 10).alias("prob"))


def relation_distances(spark, d):
    """(r, r2, dist): one less the share of the heads of r that r2 has too; eleven relations at most a head."""
    hr = table(spark, d, "triples").where("r is not null").select("h", "r").distinct()
    n = hr.groupBy("r").agg(F.count("*").alias("n"))
    c = hr.join(hr.withColumnRenamed("r", "r2"), "h").where("r <> r2").groupBy("r", "r2").agg(F.count("*").alias("c"))
    return c.join(n, "r").select("r", "r2", (1 - F.col("c") / F.col("n")).alias("dist"))


def relation_weights(spark, d):
    return relation_distances(spark, d).select("r", "r2", F.exp(-F.col("dist") / 0.5).alias("w"))


@R.add("weighted_pick", f"with {_TRI}, w as (select r, t, count(*)::double as w from tri group by r, t) select r, arg_min(t, (-ln(((t * 7919 + r * 104729) % 100003 + 0.5) / 100003) / w, t)) as t from w group by r")
def weighted_pick(spark, d):
    """One tail a relation, drawn by its frequency (GL14)."""
    w = table(spark, d, "triples").where("r is not null").distinct().groupBy("r", "t").agg(F.count("*").cast("double").alias("w"))
    u = (F.pmod(F.col("t") * 7919 + F.col("r") * 104729, F.lit(100003)) + 0.5) / 100003
    return S.weighted_pick(w, "r", "t", "w", u)


@R.add("test_negatives", f"""with {_TRI}, {_POOL}, c as (select tri.*, k, value, (h + t) % 2 = 0 as tail from tri, sz, unnest(range(64)) as u(k) join pool on idx = (h * 31 + t * 17 + r * 7 + k * 7919) % size),
g as (select h, t, r, value, tail from c where not exists (select 1 from tri x where x.h = case when tail then c.h else c.value end and x.t = case when tail then c.value else c.t end and x.r = c.r) {_PICK}) select h, t, r, case when tail then h else value end as nh, case when tail then value else t end as nt from g""")
def test_negatives(spark, d):
    """One negative a triple, on either side (GL13)."""
    t = tri(spark, d)
    pool = stage(S.entity_pool(t), "pool")
    n = pool.count()
    half = lambda side, rest: S.corrupt(t.where(f"(h + t) % 2 = {rest}").withColumn("size", F.lit(n)), t, side, pool, "size", "idx")
    tails = half("t", 0).select("h", "t", "r", F.col("h").alias("nh"), F.col("value").alias("nt"))
    return tails.unionByName(half("h", 1).select("h", "t", "r", F.col("value").alias("nh"), F.col("t").alias("nt")))


MANY = 25  # negatives of a triple
_TRAIN = f"""with {_TRI}, {_POOL}, pr as (select r, (count(*)::double / count(distinct t)) / (count(*)::double / count(distinct t) + count(*)::double / count(distinct h)) as p from tri group by r),
tj as (select tri.*, j, {_HASH3} % 100 as batch from tri, unnest(range(1, {MANY + 1})) as u(j)), sd as (select tj.*, {{side}} as tail from tj join pr using (r)),
c1 as (select sd.*, k, value from sd, sz, unnest(range(4)) as u(k) join pool on idx = ({_N0} + j * 104729 + k * 7919) % size), {{free1}},
s2 as (select sd.* from sd anti join n1 using (h, t, r, j)),
c2 as (select s2.*, k, value from s2, sz, unnest(range(4, 64)) as u(k) join pool on idx = ({_N0} + j * 104729 + k * 7919) % size), {{free2}},
ng as (select * from n1 union all select * from n2)
select batch::int as batch, h, t, r, 0 as neg_no, h as bh, t as bt, 1 as y from sd where j = 1 union all select batch::int, h, t, r, j::int, bh, bt, -1 from ng"""

_FREE = """n{i} as (select h, t, r, j, batch, case when tail then h else value end as bh, case when tail then value else t end as bt from c{i} c where not exists (select 1 from tri x where x.h = case when tail then c.h else c.value end and x.t = case when tail then c.value else c.t end and x.r = c.r)
    qualify row_number() over (partition by h, t, r, j order by k) = 1)"""


def _train_sql(side: str) -> str:
    return _TRAIN.format(side=side, free1=_FREE.format(i=1), free2=_FREE.format(i=2))


def negatives(t, many, tail):
    """(h, t, r, j, nh, nt): `many` filtered negatives of each triple; tail(j), a column over h, t, r and j, is true for tails."""
    pool = stage(S.entity_pool(t), "pool")
    n = pool.count()
    if n <= S.MOST_SENT:
        out, each = S.first_draws(t, pool, many, tail)
    else:
        out, each = None, stage(t.withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(many)))).withColumn("tail", tail(F.col("j"))), "sides")
    for s, flag in (("t", "tail"), ("h", "not tail")):
        x = S.corrupt(each.where(flag).drop("tail").withColumn("size", F.lit(n)), t.select("h", "t", "r"), s, pool, "size", "idx", number="j").where("value is not null")
        x = x.select("h", "t", "r", "j", (F.col("h") if s == "t" else F.col("value")).alias("nh"), (F.col("value") if s == "t" else F.col("t")).alias("nt"))
        out = x if out is None else out.unionByName(x)
    return out


def _batches(t, neg):
    batch = (F.pmod(F.col("h") * 31 + F.col("t") * 17 + F.col("r") * 7, F.lit(100003)) % 100).cast("int").alias("batch")
    pos = t.select(batch, "h", "t", "r", F.lit(0).alias("neg_no"), F.col("h").alias("bh"), F.col("t").alias("bt"), F.lit(1).alias("y"))
    return pos.unionByName(neg.select(batch, "h", "t", "r", F.col("j").alias("neg_no"), F.col("nh").alias("bh"), F.col("nt").alias("bt"), F.lit(-1).alias("y")))


_U = f"({_HASH3} * 7919 + j * 104729) % 100003"


@R.add("training_batches", _train_sql(f"(({_U}) + 0.5::double) / 100003 < p"))
def training_batches(spark, d):
    """A long training table (GL7, GL12, D25): batch, positive, number of the negative, triple, label; heads and tails by the Bernoulli rule."""
    t = tri(spark, d)
    p = F.broadcast(S.bernoulli(G.mapping_stats(t)))
    u = lambda j: (F.pmod(F.pmod(F.col("h") * 31 + F.col("t") * 17 + F.col("r") * 7, F.lit(100003)) * 7919 + j * 104729, F.lit(100003)) + 0.5) / 100003
    return _batches(t, negatives(t.join(p, "r").select("h", "t", "r", "tail_prob"), MANY, lambda j: u(j) < F.col("tail_prob")))


@R.add("training_batches_cross", _train_sql("batch % 2 = 1"))
def training_batches_cross(spark, d):
    """The same in cross sampling: batches of corrupted heads and of corrupted tails by turns (GL12)."""
    t = tri(spark, d)
    turn = F.pmod(F.col("h") * 31 + F.col("t") * 17 + F.col("r") * 7, F.lit(100003)) % 100 % 2 == 1
    return _batches(t, negatives(t, MANY, lambda j: turn))


@R.add("corrupt_relation_weighted", f"""{_SOFT}, w as (select r, r2, exp(-dist / 0.5) as w from s), fr as (select tri.*, r2, w from tri join w using (r) where not exists (select 1 from tri x where x.h = tri.h and x.t = tri.t and x.r = w.r2))
select h, t, r, arg_min(r2, (-ln(((h * 7919 + t * 104729 + r2 * 1299709) % 100003 + 0.5::double) / 100003) / w, r2)) as value from fr group by h, t, r""")
def corrupt_relation_weighted(spark, d):
    """A new relation drawn by the softmax of relation similarity among those that make no known triple (GL11, SC18)."""
    t = tri(spark, d)
    w = F.broadcast(relation_weights(spark, d))
    free = t.join(w, "r").join(t.withColumnRenamed("r", "r2"), ["h", "t", "r2"], "left_anti")
    u = (F.pmod(F.col("h") * 7919 + F.col("t") * 104729 + F.col("r2") * 1299709, F.lit(100003)) + 0.5) / 100003
    return free.groupBy("h", "t", "r").agg(F.min_by("r2", F.struct((-F.log(u) / F.col("w")).alias("key"), "r2")).alias("value"))


@R.add("walk_sample")
def walk_sample(spark, d):
    """A million walks along the six paths of the whole network, as an iteration of the reference takes (GL15)."""
    return M.default_walks(stage(network(spark, d), "network"))


@R.add("path_score", f"with {_TRI}, v as (select ent_id, any_value(vec) as vec from ent_embeddings where len(vec) = 100 and len(list_filter(vec, lambda x: isnan(x))) = 0 group by ent_id), p as (select r, list_dot_product(a.vec, b.vec) as dot from tri join v a on a.ent_id = h join v b on b.ent_id = t) select r as path_id, round(exp(avg(-ln(1 + exp(-dot)))), 8) as score from p group by r")
def path_score(spark, d):
    """The perplexity-like score of the pairs of each relation (AG25)."""
    from spanloom.functions.vector import dot

    v = table(spark, d, "ent_embeddings").where("size(vec) = 100 and not exists(vec, x -> isnan(x))").select("ent_id", "vec").dropDuplicates(["ent_id"])
    t = table(spark, d, "triples").where("r is not null").select("h", "t", "r").distinct()
    j = t.join(v.select(F.col("ent_id").alias("h"), F.col("vec").alias("a")), "h").join(v.select(F.col("ent_id").alias("t"), F.col("vec").alias("b")), "t")
    s = M.pair_logit_score(j.select(F.col("r").alias("path_id"), dot(F.col("a"), F.col("b")).alias("dot")))
    return s.select("path_id", F.round("score", 8).alias("score"))
