"""Queries of the knowledge graph, the word network and meta-paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import graph as G, metapath as M
from spanloom.plans.cleaning import KEY_SQL, _FIRST_README
from spanloom.plans.registry import Registry
from spanloom.runtime import stage, table

R = Registry()

_REC = f"""rec as (select repo_id as id, any_value({KEY_SQL.format(u='git_url')}) as key, any_value(name) as name, any_value(map_keys(npm_dependencies)) as deps, any_value(map_keys(npm_dev_dependencies)) as dev,
any_value(git_topics) as topics, any_value(npm_keywords) as keywords from repositories group by repo_id),
own as (select name, arg_min(key, id) as owner from rec where name is not null and key is not null group by name),
kw as (select lower(x) as x from (select unnest(keywords) as x from rec) where x is not null group by lower(x) having count(*) > 3),
tp as (select lower(x) as x from (select unnest(topics) as x from rec) where x is not null group by lower(x) having count(*) > 1),
ex as (select id, key, 1 as k, unnest(deps) as x, unnest(range(len(deps))) as pl from rec where key is not null
union all select id, key, 2, unnest(dev), unnest(range(len(dev))) from rec where key is not null
union all select id, key, 3, lower(unnest(topics)), unnest(range(len(topics))) from rec where key is not null
union all select id, key, 4, lower(unnest(keywords)), unnest(range(len(keywords))) from rec where key is not null),
alle as (select id, '$LIB' || key as src, '$USER' || string_split(key, '#')[1] as dst, 0 as k, 0 as pl from rec where key is not null
union all select id, '$LIB' || key, '$LIB' || coalesce(owner, x), k, pl from ex left join own on own.name = x where k in (1, 2) and x is not null
union all select id, '$LIB' || key, '$TOPIC' || x, k, pl from ex where k = 3 and x in (select x from tp)
union all select id, '$LIB' || key, '$KEYWORD' || x, k, pl from ex where k = 4 and x in (select x from kw)),
edges as (select src, dst, k from alle qualify row_number() over (partition by src, dst order by id, k, pl) = 1)"""
_KIND = "case k " + " ".join(f"when {i} then '{x}'" for i, x in enumerate(G.KINDS)) + " end"
_TRI = "tri as (select distinct h, t, r from triples where r is not null)"


def records(spark, d):
    r = table(spark, d, "repositories")
    one = r.groupBy(F.col("repo_id").alias("id")).agg(
        F.first(T.repo_key(F.col("git_url"))).alias("key"), F.first("name").alias("name"), F.first(F.map_keys("npm_dependencies")).alias("deps"),
        F.first(F.map_keys("npm_dev_dependencies")).alias("dev_deps"), F.first("git_topics").alias("topics"), F.first("npm_keywords").alias("keywords"),
    )
    return one.withColumn("user", F.split("key", "#")[0])


def package_graph(spark, d):
    """Package edges over topics and keywords that are frequent enough (GL3, JN3, JN6, PF7, PF8)."""
    rec = stage(records(spark, d), "records")
    owners = rec.where("name is not null and key is not null").groupBy("name").agg(F.min_by("key", "id").alias("key"))

    def frequent(c, k):
        x = rec.select(F.explode(F.transform(c, lambda v: F.lower(v))).alias("x")).where("x is not null")
        return x.groupBy("x").agg(F.count("*").alias("n")).where(f"n > {k}")

    edges = G.package_edges(rec, owners)
    for c, k, prefix in (("topics", 1, "$TOPIC"), ("keywords", 3, "$KEYWORD")):
        allowed = frequent(c, k).select(F.concat(F.lit(prefix), "x").alias("dst"))
        edges = edges.where(~F.col("dst").startswith(prefix)).unionByName(edges.where(F.col("dst").startswith(prefix)).join(allowed, "dst", "left_semi").select("src", "dst", "kind"))
    return edges


@R.add("kg_edges", f"with {_REC} select src, dst, {_KIND} as kind from edges")
def kg_edges(spark, d):
    return package_graph(spark, d)


@R.add("kg_nodes", f"with {_REC} select src as name from edges union select dst from edges")
def kg_nodes(spark, d):
    return G.nodes(package_graph(spark, d))


@R.add("kg_ids", f"with {_REC}, n as (select src as name from edges union select dst from edges), i as (select name, row_number() over (order by name) - 1 as id from n) select a.id as h, b.id as t, k::int as r from edges join i a on a.name = src join i b on b.name = dst")
def kg_ids(spark, d):
    """Triples by id (WN1, JN12)."""
    return G.triples(stage(package_graph(spark, d), "edges"))


@R.add("kg_ego", f"with {_REC}, s as (select min(src) as name from edges), b as (select src as x, dst as y from edges union all select dst, src from edges), near as (select name from s union select y from b where x in (select name from s)) select src, dst, {_KIND} as kind from edges where src in (select name from near) or dst in (select name from near)")
def kg_ego(spark, d):
    """The 2-hop neighbourhood of the first library (GL4)."""
    e = stage(package_graph(spark, d), "edges")
    return G.ego(e, e.agg(F.min("src").alias("name")))


@R.add("rel_stats", f"with {_TRI} select r, count(*) as freq, count(*)::double / count(distinct h) as tph, count(*)::double / count(distinct t) as hpt from tri group by r")
def rel_stats(spark, d):
    return G.mapping_stats(table(spark, d, "triples"))


@R.add("entity_freq", f"with {_TRI} select ent, count(*) as cnt from (select h as ent from tri union all select t from tri) group by ent")
def entity_freq(spark, d):
    """How often each entity occurs in distinct triples (AG12)."""
    t = table(spark, d, "triples").where("r is not null").distinct()
    return t.select(F.col("h").alias("ent")).union(t.select("t")).groupBy("ent").agg(F.count("*").alias("cnt"))


@R.add("rel_class", "with m as (select r, count(*)::double / count(distinct h) as tails, count(*)::double / count(distinct t) as heads from triples where r is not null group by r) select *, case when heads < 1.5 then '1' else 'n' end || '-' || case when tails < 1.5 then '1' else 'n' end as cls from m")
def rel_class(spark, d):
    return G.relation_class(table(spark, d, "triples"))


@R.add("type_constraint", "select r, 'head' as side, h as ent from triples where r is not null union select r, 'tail', t from triples where r is not null")
def type_constraint(spark, d):
    return G.type_constraint(table(spark, d, "triples"))


@R.add("adjacency", f"with {_TRI} select 't_of_hr' as kind, h as a, r as b, t as member from tri union all select 'h_of_tr', t, r, h from tri union all select 'r_of_ht', h, t, r from tri")
def adjacency(spark, d):
    """The three set-valued indexes in long form (AG16): a hub's set is many rows, not one array."""
    t = table(spark, d, "triples").where("r is not null").distinct()
    x = lambda k, a, b, m: t.select(F.lit(k).alias("kind"), F.col(a).alias("a"), F.col(b).cast("long").alias("b"), F.col(m).cast("long").alias("member"))
    return x("t_of_hr", "h", "r", "t").union(x("h_of_tr", "t", "r", "h")).union(x("r_of_ht", "h", "t", "r"))


R.sql["adjacency"] = R.sql["adjacency"].replace("r as b, t as member", "r::bigint as b, t as member").replace("t, r, h from tri", "t, r::bigint, h from tri").replace("'r_of_ht', h, t, r from", "'r_of_ht', h, t, r::bigint from")


@R.add("triple_dedup", "select h, t, r from (select h, t, r, lag(struct_pack(h := h, r := r, t := t)) over (order by h, r, t) as before from triples where r is not null) where before is null or before <> struct_pack(h := h, r := r, t := t)")
def triple_dedup(spark, d):
    return table(spark, d, "triples").where("r is not null").dropDuplicates(["h", "r", "t"]).select("h", "t", "r")


@R.add("csr_bounds", f"with {_TRI}, p as (select h, row_number() over (order by h, r, t) - 1 as pos from tri) select h, min(pos) as lef, max(pos) as rig from p group by h")
def csr_bounds(spark, d):
    return G.csr(table(spark, d, "triples"))


# The word network of GL5: the words of readmes and of both descriptions are the hub, linked with library (r), user (u), name
# parts (n), topics (t), keywords (k) and domains (d) of their record.
_HIN = f"""nrec as (select repo_id as id, any_value({KEY_SQL.format(u='git_url')}) as key, any_value(name) as name, any_value(git_topics) as topics, any_value(npm_keywords) as keywords, any_value(npm_domain) as domains,
any_value(git_description) as descr, any_value(npm_description) as npm from repositories where git_url is not null group by repo_id),
tok as (select id, x, count(*) as n from (select id, unnest(list_filter(string_split_regex(lower(concat_ws(' ', readme, descr, npm)), '[^a-z0-9]+'), lambda x: x <> '')) as x from nrec left join ({_FIRST_README}) f on f.repo_key = key) group by all),
item as (select id, ty, replace(x, ' ', '%') as x, count(*) as m from (select id, 'u' as ty, string_split(key, '#')[1] as x from nrec union all select id, 'n', lower(unnest(string_split_regex(name, '-|_'))) from nrec
union all select id, 't', lower(unnest(topics)) from nrec union all select id, 'k', lower(unnest(keywords)) from nrec union all select id, 'd', lower(unnest(domains)) from nrec) where x is not null and x <> '' group by all),
known as (select x from (select x, n from tok union all select x, m from item where ty <> 'u') group by x having sum(n) >= 4),
ends as (select id, ty || ':' || x as node, m from item union all select id, 'r:' || key, 1 from nrec),
half as (select 'w:' || x as src, node as dst, n * m as c from tok join ends using (id) where x in (select x from known)
union all select distinct 'w:' || x, ty || ':' || x, 1 from item where ty <> 'u' and x in (select x from known)),
hin as (select src, dst, sum(c)::bigint as times from (select * from half union all select dst, src, c from half) group by src, dst)"""


def network(spark, d):
    """(src, dst, times) over readmes and both descriptions: words linked with libraries, users, names, topics, keywords, domains (GL5, JN2)."""
    r = table(spark, d, "repositories").where("git_url is not null").groupBy("repo_id").agg(
        F.first(T.repo_key(F.col("git_url"))).alias("key"), *(F.first(c).alias(c) for c in ("name", "git_topics", "npm_keywords", "npm_domain", "git_description", "npm_description"))
    )
    first = table(spark, d, "readmes").where("readme is not null and repo_key is not null").groupBy(F.col("repo_key").alias("key")).agg(F.min_by("readme", "readme_id").alias("readme"))
    r = r.join(first, "key", "left")
    words = F.filter(F.split(F.lower(F.concat_ws(" ", "readme", "git_description", "npm_description")), "[^a-z0-9]+"), lambda x: x != "")
    typed = [("u", F.array(F.split("key", "#")[0])), ("n", F.transform(T.split_name(F.col("name")), lambda x: F.lower(x)))]
    typed += [(t, F.transform(c, lambda x: F.lower(x))) for t, c in (("t", "git_topics"), ("k", "npm_keywords"), ("d", "npm_domain"))]
    return M.word_network(r, "key", words, typed, least=4)


@R.add("hin_links", f"with {_HIN} select src, dst, times from hin")
def hin_links(spark, d):
    """Links in both directions with how often each occurs (GL5, ST2, SC12, PF9, PF20, FN14)."""
    return network(spark, d)


@R.add("hin_nodes", f"with {_HIN} select distinct src as name, src[1] as type from hin")
def hin_nodes(spark, d):
    """The nodes of the network, which are the ends of its links, with their type (SC12, PF20)."""
    return network(spark, d).select(F.col("src").alias("name"), F.substring("src", 1, 1).alias("type")).distinct()


@R.add("hin_recover", f"with {_HIN} select distinct replace(least(src, dst), '%', ' ') as a, replace(greatest(src, dst), '%', ' ') as b from hin where src <> dst")
def hin_recover(spark, d):
    """Back to a simple graph with plain names (GL6)."""
    return G.undirected(network(spark, d)).select(T.unescape_blanks(F.col("a")).alias("a"), T.unescape_blanks(F.col("b")).alias("b"))


_PATHS = "(values ('wrw', 0.16), ('wuw', 0.16), ('wdw', 0.16), ('wnw', 0.16), ('wkw', 0.16), ('wtw', 0.2)) as p(path, weight)"


@R.add("subpaths", f"""with p as (select path from {_PATHS}), s as (select distinct path[i:i + l - 1] as x from p, unnest(range(1, 4)) as a(i), unnest(range(1, 4)) as b(l) where i + l <= 4)
select distinct case when x[1] > x[-1] then reverse(x) else x end as subpath from s""")
def subpaths(spark, d):
    """Contiguous parts of the meta-paths in their canonical direction (GL29)."""
    return M.subpaths(M.default_paths(spark))


# Counts along w-x-w for the middle types x; the six paths differ in x only. Both directions of a link have its count.
_MIDS = "m as (select unnest(['r', 'u', 'd', 'n', 'k', 't']) as x)"
_WALK = f"""{_HIN}, {_MIDS}, lw as (select 'w' || x || 'w' as path, x, src, dst, times as c from hin join m on src[1] = 'w' and dst[1] = x),
w0 as (select distinct path, src as node, 1::bigint as cnt from (select 'w' || x || 'w' as path, h.src from m, (select distinct src from hin where src[1] = 'w') h)),
w1 as (select path, dst as node, sum(c)::bigint as cnt from lw group by path, dst), w2 as (select lw.path, src as node, sum(c * cnt)::bigint as cnt from lw join w1 on w1.path = lw.path and w1.node = dst group by lw.path, src)"""


def _six(spark, d, backward):
    """(path, step, node, cnt) for the six paths over one staged network."""
    return M.walk_counts(stage(network(spark, d), "network"), [p for p, _ in M.PATHS], backward)


@R.add("walk_count_backward", f"with {_WALK} select path, 2 as step, node, cnt from w0 union all select path, 1, node, cnt from w1 union all select path, 0, node, cnt from w2")
def walk_count_backward(spark, d):
    """Walks along each of the six paths counted from their end, step by step (AG23)."""
    return _six(spark, d, True)


@R.add("walk_count_forward", f"with {_WALK} select path, 0 as step, node, cnt from w0 union all select path, 1, node, cnt from w1 union all select path, 2, node, cnt from w2")
def walk_count_forward(spark, d):
    return _six(spark, d, False)


@R.add("metapath_neighbors", f"""with {_WALK}, q as (select distinct 'w:' || unnest(list_filter(string_split_regex(lower(query), '[^a-z0-9]+'), lambda x: x <> '')) as w from verification_samples),
p as (select a.path, a.src as word, b.src as other, sum(a.c * b.c)::bigint as walks from lw a join lw b on a.path = b.path and a.dst = b.dst where a.src in (select w from q) group by all)
select path, word, count(*) as others, sum(walks)::bigint as walks, max(walks) as most from p group by path, word""")
def metapath_neighbors(spark, d):
    """Along each path, from each word of the held-out queries: how many words are reached, by how many walks, the most to one (JN17)."""
    words = F.filter(F.split(F.lower("query"), "[^a-z0-9]+"), lambda x: x != "")
    starts = table(spark, d, "verification_samples").select(F.explode(words).alias("w")).select(F.concat(F.lit("w:"), "w").alias("a")).distinct()
    r = M.reached(stage(network(spark, d), "network"), [p for p, _ in M.PATHS], starts)
    return r.select("path", F.col("a").alias("word"), "others", "walks", "most")


@R.add("neg_distribution", f"with {_WALK}, s as (select path, 1 as step, node, cnt from w1 union all select path, 2, node, cnt from w2), p as (select *, pow(cnt, 0.75) as p from s) select path, step, node, cnt, round(p / sum(p) over (partition by path, step), 10) as prob from p")
def neg_distribution(spark, d):
    """Negative sampling in proportion to count ** 0.75, for each path and position (AG24)."""
    c = _six(spark, d, False).where("step > 0").withColumn("w", F.pow(F.col("cnt").cast("double"), F.lit(0.75)))
    total = c.groupBy("path", "step").agg(F.sum("w").alias("total"))
    return c.join(F.broadcast(total), ["path", "step"]).select("path", "step", "node", "cnt", F.round(F.col("w") / F.col("total"), 10).alias("prob"))
