"""Queries over entity vectors. Searches take the vectors whose id is divisible by 20 against all vectors."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from spanloom.functions import vector as V
from spanloom.operators import vectors as O
from spanloom.plans.registry import Registry
from spanloom.runtime import stage, table

R = Registry()
VEC_SQL = "v as (select ent_id as id, any_value(vec) as vec from ent_embeddings where len(vec) = 100 and len(list_filter(vec, lambda x: x is null or isnan(x) or isinf(x))) = 0 group by ent_id)"
REL_SQL = """rel as (select r, list(x order by i) as vec from (select r, i, avg(x) as x from (select r, unnest(range(100)) as i, unnest(list_transform(list_zip(b.vec, a.vec), lambda p: p[1] - p[2])) as x
from tri join v a on a.id = h join v b on b.id = t) group by r, i) group by r)"""
TRI_SQL = "tri as (select distinct h, t, r from triples where r is not null)"
COS01 = "case when list_dot_product({a}, {a}) > 0 and list_dot_product({b}, {b}) > 0 then 0.5 + 0.5 * list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))) else 0.0 end"


def vectors(spark, d):
    return O.usable(table(spark, d, "ent_embeddings"), "ent_id", "vec", 100)


def triples(spark, d):
    return table(spark, d, "triples").where("r is not null").select("h", "t", "r").distinct()


def relation_vectors(spark, d, t=None, v=None):
    """(r, vec): the mean of tail - head over the distinct triples of each relation; a few rows, computed once."""
    return stage(O.mean_differences(t if t is not None else triples(spark, d), v if v is not None else vectors(spark, d), 100), "relations")


def _with_ends(spark, d):
    v = vectors(spark, d)
    return triples(spark, d).join(v.select(F.col("id").alias("h"), F.col("vec").alias("a")), "h").join(v.select(F.col("id").alias("t"), F.col("vec").alias("b")), "t")


@R.add("cosine01", f"with {TRI_SQL}, {VEC_SQL} select h, t, r, round({COS01.format(a='a.vec', b='b.vec')}, 8) as sim from tri join v a on a.id = h join v b on b.id = t")
def cosine01(spark, d):
    return _with_ends(spark, d).select("h", "t", "r", F.round(V.cosine01(F.col("a"), F.col("b")), 8).alias("sim"))


@R.add("euclid", f"with {TRI_SQL}, {VEC_SQL} select h, t, r, round(list_distance(a.vec, b.vec), 8) as dist from tri join v a on a.id = h join v b on b.id = t")
def euclid(spark, d):
    return _with_ends(spark, d).select("h", "t", "r", F.round(V.euclid(F.col("a"), F.col("b")), 8).alias("dist"))


@R.add("relation_vectors", f"with {TRI_SQL}, {VEC_SQL}, {REL_SQL} select r, unnest(range(100))::int as i, round(unnest(vec), 7) as x from rel")
def relation_vectors_query(spark, d):
    return relation_vectors(spark, d).select("r", F.posexplode("vec").alias("i", "x")).select("r", "i", F.round("x", 7).alias("x"))


@R.add("translate_cosine", f"with {TRI_SQL}, {VEC_SQL}, {REL_SQL}, x as (select h, t, tri.r, list_transform(list_zip(b.vec, rel.vec), lambda p: p[1] - p[2]) as m, a.vec as vec from tri join v a on a.id = h join v b on b.id = t join rel on rel.r = tri.r) select h, t, r, round({COS01.format(a='m', b='vec')}, 7) as sim from x")
def translate_cosine(spark, d):
    """Cosine of tail - relation with the head (FN20)."""
    j = _with_ends(spark, d).join(F.broadcast(relation_vectors(spark, d)), "r")
    return j.select("h", "t", "r", F.round(V.cosine01(V.subtract(F.col("b"), F.col("vec")), F.col("a")), 7).alias("sim"))


_SIM = f"with {VEC_SQL}, p as (select a.id as a, b.id as b, list_cosine_similarity(a.vec, b.vec) as c from v a join v b on a.id % 20 = 0 and a.id <> b.id where list_dot_product(a.vec, a.vec) > 0 and list_dot_product(b.vec, b.vec) > 0)"


@R.add("sim_join", f"{_SIM} select a, b, round(0.5 + 0.5 * c, 8) as sim from p where 0.5 + 0.5 * c >= 0.84")
def sim_join(spark, d):
    """Similar entities at the threshold of the enrichment (JN11)."""
    v = stage(vectors(spark, d), "vectors")
    x = O.block_search(v.where("id % 20 = 0"), v, 100, least=2 * 0.84 - 1)
    return x.select("a", "b", F.round(0.5 + 0.5 * F.col("sim"), 8).alias("sim"))


@R.add("sim_top2", f"{_SIM}, k as (select a, b, round(c, 9) as c, row_number() over (partition by a order by round(c, 9) desc, b) as rank from p where 0.5 + 0.5 * c >= 0.6) select a, rank::int as rank, b from k where rank <= 2")
def sim_top2(spark, d):
    """The two most similar terms (WN12, JN19)."""
    v = stage(vectors(spark, d), "vectors")
    return O.block_search(v.where("id % 20 = 0"), v, 100, least=2 * 0.6 - 1, top=2).select("a", "rank", "b")


@R.add("nearest40", f"{_SIM}, k as (select a, b, c, row_number() over (partition by a order by round(c, 9) desc, b) as rank from p where c > 1e-9) select a, rank::int as rank, b, round(c, 8) as sim from k where rank <= 40")
def nearest40(spark, d):
    """The 40 nearest vectors with a positive cosine (SL6, SL4)."""
    v = stage(vectors(spark, d), "vectors")
    return O.block_search(v.where("id % 20 = 0"), v, 100, least=1e-9, top=40).select("a", "rank", "b", F.round("sim", 8).alias("sim"))


@R.add("greedy_clique", f"""with recursive {_SIM[5:]}, g as (select a, b, round(c, 9) as c, row_number() over (partition by a order by round(c, 9) desc, b) as i from p where 0.5 + 0.5 * c >= 0.7),
bad as (select x.a, x.i, y.i as j from g x join g y on x.a = y.a and y.i < x.i join v s on s.id = x.b join v t on t.id = y.b where 0.5 + 0.5 * list_cosine_similarity(s.vec, t.vec) < 0.7),
bl as (select a, i, list(j) as no from bad group by a, i),
w as (select distinct a, 0::bigint as i, []::bigint[] as kept from g union all select w.a, w.i + 1, case when bl.no is not null and list_has_any(w.kept, bl.no) then w.kept else list_append(w.kept, w.i + 1) end from w join g on g.a = w.a and g.i = w.i + 1 left join bl on bl.a = w.a and bl.i = w.i + 1),
k as (select a, arg_max(kept, i) as kept from w group by a)
select k.a, list_position(kept, g.i)::int as rank, b, round(0.5 + 0.5 * c, 6) as sim from k join g on g.a = k.a and list_contains(kept, g.i)""")
def greedy_clique(spark, d):
    """Similar terms that are similar to each other (WN10)."""
    v = stage(vectors(spark, d), "vectors")
    pairs = O.block_search(v.where("id % 20 = 0"), v, 100, least=2 * 0.7 - 1).select("a", "b", (0.5 + 0.5 * F.col("sim")).alias("sim"))
    return O.greedy_cliques(pairs, v, 0.7).withColumn("sim", F.round("sim", 6))


@R.add("phrase_nearest", f"""with {VEC_SQL}, nm as (select ent_id, any_value(lower(regexp_replace(name, '^\\$(LIB|TOPIC|USER|NE\\d)', ''))) as nm from ent_embeddings where name like '$TOPIC%' group by ent_id),
n as (select nm, id, vec from nm join v on id = ent_id where list_dot_product(vec, vec) > 0), q as (select item_id, unnest(list_filter(string_split_regex(lower(query), '[^a-z0-9]+'), lambda x: x <> '')) as w from verification_samples),
h as (select distinct item_id, id, vec from q join n on nm = w), u as (select item_id, i, sum(x) as x from (select item_id, unnest(range(100)) as i, unnest(list_transform(vec, lambda y: y / sqrt(list_dot_product(vec, vec)))) as x from h) group by item_id, i),
s as (select item_id, list(x order by i) as vec from u group by item_id), p as (select item_id, v.id as b, list_cosine_similarity(s.vec, v.vec) as c from s, v where list_dot_product(v.vec, v.vec) > 0 and not exists (select 1 from h where h.item_id = s.item_id and h.id = v.id)),
k as (select *, row_number() over (partition by item_id order by round(c, 9) desc, b) as rank from p where c > 1e-9) select item_id, rank::int as rank, b, round(c, 7) as sim from k where rank <= 40""")
def phrase_nearest(spark, d):
    """The same for a query of several words: the sum of their unit vectors; the words themselves are left out (SL6)."""
    v = stage(vectors(spark, d), "vectors")
    names = table(spark, d, "ent_embeddings").where("name like '$TOPIC%'").select(F.col("ent_id").alias("id"), F.lower(F.regexp_replace("name", r"^\$(LIB|TOPIC|USER|NE\d)", "")).alias("w")).dropDuplicates(["id"])
    known = names.join(v, "id").where(V.norm(F.col("vec")) > 0)
    q = table(spark, d, "verification_samples").select("item_id", F.explode(F.filter(F.split(F.lower("query"), "[^a-z0-9]+"), lambda x: x != "")).alias("w"))
    hit = stage(q.join(known, "w").select("item_id", "id", "vec").distinct(), "hits")
    total = hit.select("item_id", F.posexplode(V.unit(F.col("vec"))).alias("i", "x")).groupBy("item_id", "i").agg(F.sum("x").alias("x"))
    phrase = total.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("p")).select((-F.col("item_id") - 1).alias("id"), F.transform("p", lambda p: p["x"]).alias("vec"))
    # Own words are at most a few dozen: that many more candidates are asked for, then they are left out.
    most = hit.groupBy("item_id").count().agg(F.max("count")).first()[0] or 0
    found = O.block_search(phrase, v, 100, least=1e-9, top=40 + most).select((-F.col("a") - 1).alias("item_id"), F.col("b").alias("id"), "sim")
    found = found.join(hit.select("item_id", "id"), ["item_id", "id"], "left_anti")
    w = W.partitionBy("item_id").orderBy(F.desc(F.round("sim", 9)), "id")
    return found.withColumn("rank", F.row_number().over(w)).where("rank <= 40").select("item_id", "rank", F.col("id").alias("b"), F.round("sim", 7).alias("sim"))
