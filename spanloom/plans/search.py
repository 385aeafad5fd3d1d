"""Queries of retrieval and its evaluation, over the held-out queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from spanloom.functions.text import repo_key_any
from spanloom.operators import retrieval as O, vectors as VO
from spanloom.plans.registry import Registry
from spanloom.plans.vectors import COS01, REL_SQL, TRI_SQL, VEC_SQL, relation_vectors, triples, vectors
from spanloom.runtime import stage, table

R = Registry()

_TOK = "list_filter(string_split_regex(lower({t}), '[^a-z]+'), lambda x: x <> '')"
_TF = f"""dt as (select doc_id, term, count(*) as tf from (select doc_id, unnest({_TOK.format(t='text')}) as term from documents) group by all),
idf as (select term, log2((select count(*) from documents)::double / count(*)) as idf from dt group by term),
dw as (select doc_id, term, tf * idf as w from dt join idf using (term)), dn as (select doc_id, sqrt(sum(w * w)) as norm from dw group by doc_id),
qt as (select item_id, term, count(*) as tf from (select item_id, unnest({_TOK.format(t='query')}) as term from verification_samples) group by all),
qw as (select item_id, term, tf * idf as w from qt join idf using (term)), qn as (select item_id, sqrt(sum(w * w)) as norm from qw group by item_id),
sc as (select item_id, doc_id, round(sum(dw.w / dn.norm * qw.w / qn.norm), 6) as score from dw join dn using (doc_id) join qw using (term) join qn using (item_id) where dw.w <> 0 and qw.w <> 0 and dn.norm > 0 and qn.norm > 0 group by all),
top as (select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score from sc where score > 0 qualify rank <= 20)"""
_EVAL = """f as (select item_id, min(rank) as rank from {ranked} group by item_id), q as (select distinct item_id from verification_samples)
select count(*) as queries, count(rank) as success, round(coalesce(sum(1.0::double / rank), 0), 6) as rr_sum, round(coalesce(sum(1.0::double / rank), 0) / greatest(count(*), 1), 6) as mrr from q left join f using (item_id)"""


def _terms(c):
    return F.filter(F.split(F.lower(c), "[^a-z]+"), lambda x: x != "")


def ranked_documents(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return O.top_documents(docs, _terms("text"), table(spark, d, "verification_samples"), _terms("query"), 20)


@R.add("tfidf_topk", f"with {_TF} select * from top")
def tfidf_topk(spark, d):
    """The 20 documents most like each query by TF-IDF (GL24, AG22, JN20, SL2)."""
    return ranked_documents(spark, d)


@R.add("tfidf_weights", f"with {_TF} select doc_id, term, round(w / norm, 7) as w from dw join dn using (doc_id) where norm > 0")
def tfidf_weights(spark, d):
    """The unit-length TF-IDF vectors of the documents, a row a term (AG22)."""
    w, _ = O.tfidf_weights(table(spark, d, "documents").select("doc_id", "text"), _terms("text"))
    return w.select("doc_id", "term", F.round("w", 7).alias("w"))


@R.add("tfidf_eval", f"with {_TF}, hits as (select t.item_id, t.rank from top t join documents d using (doc_id) join verification_samples v on v.item_id = t.item_id and v.answer = d.repo_key), {_EVAL.format(ranked='hits')}")
def tfidf_eval(spark, d):
    """success@20 and reciprocal ranks of the repository of the documents found (AG21)."""
    ranked = ranked_documents(spark, d).join(table(spark, d, "documents").select("doc_id", F.col("repo_key").alias("answer")), "doc_id")
    e = O.success_and_reciprocal_rank(ranked, table(spark, d, "verification_samples").select("item_id", "answer"))
    return e.select("queries", "success", F.round("rr_sum", 6).alias("rr_sum"), F.round("mrr", 6).alias("mrr"))


# Query terms: the words of a query that are a part of an entity's or topic's bare name.
_ENTS = """ents as (select distinct ent_id as ent, unnest(list_distinct(list_filter(string_split_regex(lower(regexp_replace(name, '^\\$(LIB|TOPIC|USER|KEYWORD|NE\\d)', '')), '[^a-z0-9]+'), lambda x: length(x) >= 3))) as w from ent_embeddings where name like '$TOPIC%' or name like '$NE%'),
qwords as (select item_id, word, count(*) as cnt from (select item_id, unnest(list_filter(string_split_regex(lower(query), '[^a-z0-9]+'), lambda x: x <> '')) as word from verification_samples) group by all),
qents as (select item_id, ent, sum(cnt)::bigint as cnt from qwords join ents on w = word group by all)"""
_STRUCT = f"""{TRI_SQL}, {VEC_SQL}, {REL_SQL}, {_ENTS}, ed as (select h as repo, t as ent, r from tri where r = 3 or r >= 5),
st as (select q.item_id, ed.repo, q.cnt, rel.r, list_transform(list_zip(e.vec, rel.vec), lambda p: p[1] - p[2]) as m, b.vec as vec, e.vec is not null and b.vec is not null as there
from qents q join ed using (ent) left join v e on e.id = q.ent left join v b on b.id = ed.repo left join rel on rel.r = ed.r),
sscore as (select item_id, repo, sum(cnt * case when there then {COS01.format(a='m', b='vec')} else 0 end) as score from st group by all)"""
_UNSTRUCT = f"""tw as (select ent_id, min(lower(regexp_replace(name, '^\\$TOPIC', ''))) as word from ent_embeddings where name like '$TOPIC%' group by ent_id),
ul as (select distinct tri.h as repo, tw.word, tw.ent_id from tri join tw on tw.ent_id = tri.t where r = 3),
uscore as (select q.item_id, ul.repo, sum(q.cnt * case when a.vec is not null and b.vec is not null then {COS01.format(a='a.vec', b='b.vec')} else 0 end) as score from qwords q join ul using (word) left join v a on a.id = ul.ent_id left join v b on b.id = ul.repo group by all)"""


def query_words(spark, d):
    q = table(spark, d, "verification_samples").select("item_id", F.explode(F.filter(F.split(F.lower("query"), "[^a-z0-9]+"), lambda x: x != "")).alias("word"))
    return q.groupBy("item_id", "word").agg(F.count("*").alias("cnt"))


def query_entities(spark, d):
    parts = F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace("name", r"^\$(LIB|TOPIC|USER|KEYWORD|NE\d)", "")), "[^a-z0-9]+"), lambda x: F.length(x) >= 3))
    ents = table(spark, d, "ent_embeddings").where("name like '$TOPIC%' or name like '$NE%'").select(F.col("ent_id").alias("ent"), F.explode(parts).alias("word")).distinct()
    return query_words(spark, d).join(ents, "word").groupBy("item_id", "ent").agg(F.sum("cnt").alias("cnt"))


SAME = 4  # SameToNE: the id these triples leave free below RelateToNE (5 .. 10); only edges from asked entities are followed


class Parts:
    """What both channels of a search read, written once: distinct triples of the kinds used, vectors, relation vectors."""

    def __init__(self, spark, d):
        self.triples, self.vectors = stage(triples(spark, d), "triples"), stage(vectors(spark, d), "vectors")
        self.relations = relation_vectors(spark, d, self.triples, self.vectors)


def structured(spark, d, parts=None):
    parts = parts or Parts(spark, d)
    edges = parts.triples.where("r = 3 or r >= 5").select(F.col("h").alias("repo"), F.col("t").alias("ent"), "r")
    same = parts.triples.where(F.col("r") == SAME).select(F.col("h").alias("ent"), F.col("t").alias("other"))
    return O.structured_scores(query_entities(spark, d), edges, parts.vectors, parts.relations, same)


def unstructured(spark, d, parts=None):
    t, v = (parts.triples, parts.vectors) if parts else (triples(spark, d), stage(vectors(spark, d), "vectors"))
    topics = table(spark, d, "ent_embeddings").where("name like '$TOPIC%'").groupBy("ent_id").agg(F.min(F.lower(F.regexp_replace("name", r"^\$TOPIC", ""))).alias("w"))
    topics = stage(topics, "topics")
    links = t.where("r = 3").join(topics.withColumnRenamed("ent_id", "t"), "t").select(F.col("h").cast("string").alias("repo"), F.concat_ws("|", F.col("t").cast("string"), "w").alias("word")).distinct()
    named = v.select(F.col("id").cast("string").alias("name"), "vec").unionByName(v.join(topics.withColumnRenamed("ent_id", "id"), "id").select(F.concat_ws("|", F.col("id").cast("string"), "w").alias("name"), "vec"))
    node = topics.select("w", F.concat_ws("|", F.col("ent_id").cast("string"), "w").alias("node"))
    words = query_words(spark, d).join(node, F.col("word") == F.col("w")).select("item_id", F.col("node").alias("word"), "cnt")
    return O.unstructured_scores(words, links, named).withColumn("repo", F.col("repo").cast("long"))


def channels(spark, d):
    """Both channels over the same parts."""
    parts = Parts(spark, d)
    return structured(spark, d, parts), unstructured(spark, d, parts)


@R.add("search_structured", f"with {_STRUCT} select item_id, repo, round(score, 6) as score from sscore")
def search_structured(spark, d):
    """Libraries by their related entities and topics (JN10)."""
    return structured(spark, d).select("item_id", "repo", F.round("score", 6).alias("score"))


@R.add("search_unstructured", f"with {_STRUCT}, {_UNSTRUCT} select item_id, repo, round(score, 6) as score from uscore")
def search_unstructured(spark, d):
    """Libraries by the words they are linked with in the network (JN9)."""
    return unstructured(spark, d).select("item_id", "repo", F.round("score", 6).alias("score"))


def _comb(alpha: str) -> str:
    return f"(select item_id, repo, round(sum(s), 6) as score from (select item_id, repo, {alpha} * score as s from sscore union all select item_id, repo, (1 - {alpha}) * score from uscore) group by all)"


@R.add("search_combined", f"with {_STRUCT}, {_UNSTRUCT} select item_id, (row_number() over (partition by item_id order by score desc, repo))::int as rank, repo, score from {_comb('0.35::double')} qualify rank <= 20")
def search_combined(spark, d):
    """Both channels mixed at 0.35, best 20 (GL26, AG9, SL1)."""
    return O.combined(*channels(spark, d), 0.35)


_ANSWER = "lib2 as (select ent_id as repo, min(lower(regexp_replace(name, '^\\$LIB', ''))) as key from ent_embeddings where name like '$LIB%' group by ent_id)"


@R.add("alpha_sweep", f"""with {_STRUCT}, {_UNSTRUCT}, {_ANSWER}, al as (select unnest(range(7, 20)) * 0.05::double as alpha),
c as (select round(alpha, 2) as alpha, item_id, repo, round(sum(s), 6) as score from (select alpha, item_id, repo, alpha * score as s from al, sscore union all select alpha, item_id, repo, (1 - alpha) * score from al, uscore) group by all),
k as (select *, row_number() over (partition by alpha, item_id order by score desc, repo) as rank from c qualify rank <= 20),
h as (select alpha, k.item_id, min(rank) as rank from k join lib2 using (repo) join verification_samples s on s.item_id = k.item_id and lower(s.answer) = lib2.key group by all)
select round(al.alpha, 2) as alpha, count(h.rank) as success, round(coalesce(sum(1.0::double / h.rank), 0), 6) as rr_sum from al left join h on h.alpha = round(al.alpha, 2) group by al.alpha""")
def alpha_sweep(spark, d):
    """success@20 and reciprocal ranks for mixing weights 0.35, 0.40, .. 0.95 in one plan (AG21)."""
    alphas = spark.range(7, 20).select(F.round(F.col("id") * 0.05, 2).alias("alpha"), (F.col("id") * 0.05).alias("x"))
    each = F.explode(F.transform(F.sequence(F.lit(7), F.lit(19)), lambda i: i * 0.05)).alias("x")
    s, u = channels(spark, d)
    s = s.select("item_id", "repo", "score", each).select("x", "item_id", "repo", (F.col("x") * F.col("score")).alias("s"))
    u = u.select("item_id", "repo", "score", each).select("x", "item_id", "repo", ((1 - F.col("x")) * F.col("score")).alias("s"))
    c = s.unionByName(u).groupBy(F.round("x", 2).alias("alpha"), "item_id", "repo").agg(F.round(F.sum("s"), 6).alias("score"))
    k = c.withColumn("rank", F.row_number().over(W.partitionBy("alpha", "item_id").orderBy(F.desc("score"), "repo"))).where("rank <= 20")
    lib = table(spark, d, "ent_embeddings").where("name like '$LIB%'").groupBy(F.col("ent_id").alias("repo")).agg(F.min(F.lower(F.regexp_replace("name", r"^\$LIB", ""))).alias("key"))
    want = table(spark, d, "verification_samples").select("item_id", F.lower("answer").alias("key"))
    h = k.join(lib, "repo").join(want, ["item_id", "key"]).groupBy("alpha", "item_id").agg(F.min("rank").alias("rank"))
    out = alphas.join(h, "alpha", "left").groupBy("alpha").agg(F.count("rank").alias("success"), F.round(F.coalesce(F.sum(1 / F.col("rank")), F.lit(0.0)), 6).alias("rr_sum"))
    return out


_ENRICH_BASE = f"""{VEC_SQL}, {_ENTS}, tw as (select ent_id, min(lower(regexp_replace(name, '^\\$TOPIC', ''))) as word from ent_embeddings where name like '$TOPIC%' group by ent_id),
tv as (select v.id, word, vec from tw join v on v.id = ent_id where list_dot_product(vec, vec) > 0), asked as (select distinct word from qwords),
p as (select a.id as ai, a.word as term, b.id as bi, b.word as other, list_cosine_similarity(a.vec, b.vec) as c from tv a join tv b on a.id <> b.id where a.word in (select word from asked)),
sim as (select term, other, 0.5 + 0.5 * c as prob from p qualify row_number() over (partition by ai order by round(c, 9) desc, bi) <= 2)"""


def similar_topics(spark, d):
    """The two topics most similar to each topic that a query names: a stated query set against all topics."""
    names = table(spark, d, "ent_embeddings").where("name like '$TOPIC%'").groupBy(F.col("ent_id").alias("id")).agg(F.min(F.lower(F.regexp_replace("name", r"^\$TOPIC", ""))).alias("word"))
    v = stage(vectors(spark, d).join(names, "id").where("exists(vec, x -> x <> 0)"), "topics")
    asked = v.join(query_words(spark, d).select("word"), "word", "left_semi")
    top = VO.block_search(asked.select("id", "vec"), v.select("id", "vec"), 100, top=2)
    label = v.select("id", "word")
    return top.join(label.select(F.col("id").alias("a"), F.col("word").alias("term")), "a").join(label.select(F.col("id").alias("b"), F.col("word").alias("other")), "b").select("term", "other", (0.5 + 0.5 * F.col("sim")).alias("prob"))


@R.add("enrich_norm", f"""with {_ENRICH_BASE}, ad as (select q.item_id, other, prob as x from qwords q join sim on sim.term = q.word where not exists (select 1 from qwords z where z.item_id = q.item_id and z.word = sim.other)),
tot as (select item_id, c + coalesce(a, 0) as total from (select item_id, sum(cnt) as c from qwords group by item_id) left join (select item_id, count(*) as a from ad group by item_id) using (item_id)),
parts as (select item_id, word as term, cnt::double as x from qwords union all select item_id, other, x from ad) select item_id, term, round(sum(x) / any_value(total), 8) as weight from parts join tot using (item_id) group by item_id, term""")
def enrich_norm(spark, d):
    """Query words and their similar topics, weights over the total (AG10, JN19)."""
    e = O.enrich_normalised(query_words(spark, d).withColumnRenamed("word", "term"), similar_topics(spark, d))
    return e.select("item_id", "term", F.round("weight", 8).alias("weight"))


@R.add("enrich_additive", f"""with {_ENRICH_BASE}, s as (select *, count(*) over (partition by term) as n from sim),
parts as (select item_id, word as term, cnt::double as x from qwords union all select q.item_id, other, 0.01::double * prob * cnt / n from qwords q join s on s.term = q.word) select item_id, term, round(sum(x), 8) as weight from parts group by all""")
def enrich_additive(spark, d):
    """The same, added with a small factor (AG11)."""
    e = O.enrich_additive(query_words(spark, d).withColumnRenamed("word", "term"), similar_topics(spark, d))
    return e.select("item_id", "term", F.round("weight", 8).alias("weight"))


@R.add("payload_complete", f"""with {_STRUCT}, {_UNSTRUCT}, {_ANSWER}, k as (select item_id, (row_number() over (partition by item_id order by score desc, repo))::int as rank, repo, score from {_comb('0.35::double')} qualify rank <= 20),
keys as (select distinct lower(regexp_extract(u, '([^/:]+)/[^/]+$', 1) || '#' || regexp_extract(u, '([^/]+)$', 1)) as key from (select regexp_replace(trim(git_url), '(\\.git)?/*$', '') as u from repositories where git_url is not null)),
shown as (select repo, key from lib2 where key in (select key from keys)), j as (select k.*, key, min(case when key is null then 0 else 1 end) over (partition by item_id) as ok from k left join shown using (repo)) select item_id, rank, repo, key from j where ok = 1""")
def payload_complete(spark, d):
    """The whole answers with what is shown of them, all or nothing per query: a library without a record cannot be shown (JN18)."""
    k = O.combined(*channels(spark, d), 0.35)
    lib = table(spark, d, "ent_embeddings").where("name like '$LIB%'").groupBy(F.col("ent_id").alias("repo")).agg(F.min(F.lower(F.regexp_replace("name", r"^\$LIB", ""))).alias("key"))
    keys = table(spark, d, "repositories").select(repo_key_any(F.col("git_url")).alias("key")).distinct()
    return O.complete_payloads(k, lib.join(keys, "key", "left_semi")).select("item_id", "rank", "repo", "key")
