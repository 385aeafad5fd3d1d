"""Queries that write a format to the shared folder, read it back and return what was read."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from spanloom import service
from spanloom.operators import graph as G
from spanloom.plans.registry import Registry
from spanloom.runtime import table, work_dir
from spanloom.sources import readers as S

R = Registry()


def _path(spark) -> str:
    return f"{work_dir(spark)}/files-{uuid.uuid4().hex}"


@R.add("source_json_lines", "select name, git_stars, array_to_string(git_topics, '~') as topics, count(*) as n from (select distinct repo_id, name, git_stars, git_topics from repositories) where git_stars >= 10 group by all")
def source_json_lines(spark, d):
    """Records as JSON lines, the lines with enough stars passed on unchanged, then read (SC1, SC2)."""
    p = _path(spark)
    cols = [c.split()[0] for c in S.REPOSITORY.split(", ")]
    one = table(spark, d, "repositories").dropDuplicates(["repo_id"]).select(*cols)
    one.write.json(f"{p}/a")
    S.pass_lines(spark, f"{p}/a", f"{p}/b", F.col("r.git_stars") >= 10)
    return S.read_repositories(spark, f"{p}/b").groupBy("name", "git_stars", F.array_join("git_topics", "~").alias("topics")).agg(F.count("*").alias("n"))


@R.add("source_cells", r"select doc_id, regexp_replace(coalesce(head, ''), '[\t\r\n]+', ' ', 'g') as head, array_to_string(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''), ' ') as tokens from documents")
def source_cells(spark, d):
    """Tab-separated lines with JSON cells (SC4, SC5, SC6)."""
    p = _path(spark)
    t = table(spark, d, "documents").select("doc_id", "head", F.filter(F.split("text", r"\s+"), lambda x: x != "").alias("tokens"))
    S.write_cells(t, ["doc_id", "head", "tokens"], p)
    return S.read_cells(spark, p, "doc_id long, head string, tokens array<string>").select("doc_id", "head", F.array_join("tokens", " ").alias("tokens"))


@R.add("source_counted", "select distinct h, t, r from triples where r is not null")
def source_counted(spark, d):
    """Id files with a count in their first line (SC9)."""
    p = _path(spark)
    S.write_counted(table(spark, d, "triples").where("r is not null").distinct(), ["h", "t", "r"], p, ["h", "t", "r"])
    return S.read_counted(spark, p, "h long, t long, r int")


@R.add("source_node_vectors", "select distinct name, case when starts_with(name, '$LIB') then 'repo' when starts_with(name, '$TOPIC') then 'topic' else 'user' end as type, len(vec) as dim, round(list_sum(vec), 6) as total from ent_embeddings where len(vec) = 100 and len(list_filter(vec, lambda x: isnan(x))) = 0 and name is not null")
def source_node_vectors(spark, d):
    """Network vectors as text (SC13), put in their bundle (SC14)."""
    p = _path(spark)
    v = table(spark, d, "ent_embeddings").where("size(vec) = 100 and not exists(vec, x -> isnan(x)) and name is not null").dropDuplicates(["ent_id"])
    kind = F.when(F.col("name").startswith("$LIB"), "repo").when(F.col("name").startswith("$TOPIC"), "topic").otherwise("user")
    S.write_node_vectors(v.select("name", kind.alias("type"), "vec"), p)
    b = S.bundle(S.read_node_vectors(spark, p))
    return b.select("name", "type", F.size("vec").cast("long").alias("dim"), F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 6).alias("total")).distinct()


@R.add("source_by_class", "with m as (select r, case when count(*)::double / count(distinct t) < 1.5 then '1' else 'n' end || '-' || case when count(*)::double / count(distinct h) < 1.5 then '1' else 'n' end as cls from triples where r is not null group by r) select cls as rel_class, count(*) as n from triples join m using (r) group by cls")
def source_by_class(spark, d):
    """Triples in a folder for each relation class (SC11)."""
    p = _path(spark)
    t = table(spark, d, "triples").where("r is not null")
    S.write_by_class(t, G.relation_class(t), p)
    return spark.read.parquet(p).groupBy(F.col("rel_class").cast("string").alias("rel_class")).agg(F.count("*").alias("n"))


@R.add("source_type_constraint", "select r, side, count(*) as n from (select distinct r, 'head' as side, h as e from triples where r is not null union select distinct r, 'tail', t from triples where r is not null) group by all")
def source_type_constraint(spark, d):
    """Heads and tails of each relation in chunks (SC10)."""
    lines = S.type_constraint_lines(G.type_constraint(table(spark, d, "triples")))
    return lines.groupBy("r", "side").agg(F.sum(F.size("entities")).alias("n"))


@R.add("source_embeddings", "select distinct name, len(vec) as dim, round(list_sum(vec), 6) as total from ent_embeddings where len(vec) = 100 and len(list_filter(vec, lambda x: isnan(x))) = 0 and name is not null")
def source_embeddings(spark, d):
    """Vectors as lines of a name and a JSON array (SC16)."""
    p = _path(spark)
    v = table(spark, d, "ent_embeddings").where("size(vec) = 100 and not exists(vec, x -> isnan(x)) and name is not null").dropDuplicates(["ent_id"])
    S.write_cells(v, ["name", "vec"], p)
    back = S.read_embeddings(spark, p)
    return back.select("name", F.size("vec").cast("long").alias("dim"), F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 6).alias("total")).distinct()


@R.add("source_stop_words", "select distinct word from (select unnest(list_filter(string_split_regex(lower(query), '[^a-z0-9]+'), lambda x: x <> '')) as word from verification_samples)")
def source_stop_words(spark, d):
    """A word list, one a line, some with a prefix (SC20)."""
    p = _path(spark)
    w = table(spark, d, "verification_samples").select(F.explode(F.filter(F.split(F.lower("query"), "[^a-z0-9]+"), lambda x: x != "")).alias("w")).distinct()
    w.select(F.when(F.length("w") % 2 == 0, F.concat(F.lit("$WORD"), "w")).otherwise(F.col("w")).alias("value")).write.text(p)
    return S.read_stop_words(spark, p)


@R.add("source_samples", r"""select row_number() over (order by query, answer) - 1 as item_id, query, answer from (select regexp_replace(query, '[\t\r\n]+', ' ', 'g') as query, answer from verification_samples where answer is not null)""")
def source_samples(spark, d):
    """Verification samples as tab-separated lines (SC21)."""
    p = _path(spark)
    S.write_cells(table(spark, d, "verification_samples").where("answer is not null"), ["query", "answer"], p)
    return S.read_samples(spark, p)


@R.add("source_graph_xml", "select 'node' as what, cast(ent_id as varchar) as a, any_value(name) as b from ent_embeddings where name is not null group by ent_id union all select distinct 'edge', cast(h as varchar), cast(t as varchar) from triples")
def source_graph_xml(spark, d):
    """A graph in the elements of GEXF, written and read by Spark's XML source (SC8)."""
    p = _path(spark)
    n = table(spark, d, "ent_embeddings").where("name is not null").groupBy(F.col("ent_id").cast("string").alias("id")).agg(F.first("name").alias("label"))
    e = table(spark, d, "triples").select(F.col("h").cast("string").alias("source"), F.col("t").cast("string").alias("target")).distinct()
    S.write_graph_xml(n, e, p)
    nodes, edges = S.read_graph_xml(spark, f"{p}/*")
    return nodes.select(F.lit("node").alias("what"), F.col("id").alias("a"), F.col("label").alias("b")).unionByName(edges.select(F.lit("edge").alias("what"), F.col("source").alias("a"), F.col("target").alias("b")))


@R.add("source_graph_tables", "select 'node' as what, count(*) as n from (select h from triples union select t from triples) union all select 'edge', count(*) from (select distinct h, t from triples)")
def source_graph_tables(spark, d):
    """A graph as two Parquet tables (SC7, SC19)."""
    p, t = _path(spark), table(spark, d, "triples").select("h", "t")
    S.write_graph(t.select(F.col("h").alias("id")).union(t.select("t")).distinct(), t.distinct(), p)
    n, e = S.read_graph(spark, p)
    return n.agg(F.count("*").alias("n")).select(F.lit("node").alias("what"), "n").unionByName(e.agg(F.count("*").alias("n")).select(F.lit("edge").alias("what"), "n"))


@R.add("valid_queries", "select item_id, query from verification_samples where trim(query) <> '' union select doc_id, head from documents where trim(head) <> ''")
def valid_queries(spark, d):
    """Queries that are answered: blank and null ones are rejected (PF17, SC22)."""
    q = table(spark, d, "verification_samples").select("item_id", "query")
    heads = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.col("head").alias("query"))
    return service.valid_queries(q).unionByName(service.valid_queries(heads)).distinct()
