"""Ranked retrieval: TF-IDF, term enrichment, structured and unstructured scores, evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from spanloom.operators.vectors import cosine01_rows
from spanloom.runtime import spread, stage


def tfidf_weights(docs: DataFrame, terms: Column) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, ..) -> weights(doc_id, term, w) of unit length, and idf(term, idf); w = tf * log2(N / df).

    Terms are counted per document before anything is shuffled by term. Documents whose terms are in all documents
    have no weights. N counts all documents, those without terms included.
    """
    n = docs.count()
    tf = docs.select("doc_id", F.explode(terms).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    idf = tf.groupBy("term").agg(F.log2(F.lit(float(n)) / F.count("*")).alias("idf"))
    w = tf.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("doc_id")))
    return w.withColumn("norm", norm).where("norm > 0").select("doc_id", "term", (F.col("w") / F.col("norm")).alias("w")), idf


def query_weights(queries: DataFrame, terms: Column, idf: DataFrame) -> DataFrame:
    """queries(item_id, ..) -> (item_id, term, qw) of unit length with the idf of the corpus."""
    tf = queries.select("item_id", F.explode(terms).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("tf"))
    w = tf.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("item_id")))
    return w.withColumn("norm", norm).where("norm > 0").select("item_id", "term", (F.col("w") / F.col("norm")).alias("qw"))


def top_by_join(weights: DataFrame, queries: DataFrame) -> DataFrame:
    """(item_id, doc_id, score): every query weight joined with the postings of its term."""
    return weights.join(queries, "term").where("w <> 0 and qw <> 0").groupBy("item_id", "doc_id").agg(F.round(F.sum(F.col("w") * F.col("qw")), 6).alias("score"))


def top_documents(docs: DataFrame, terms: Column, queries: DataFrame, query_terms: Column, k: int = 20, most_terms: int = 1_000_000, most_weights: int = 4_000_000) -> DataFrame:
    """(item_id, rank, doc_id, score): best k by cosine of TF-IDF, rounded to 6 digits, then by doc_id; zero scores are no hits.

    docs(doc_id, ..), one row a document; queries(item_id, ..), a stated set. While the corpus has at most `most_terms`
    terms and the queries `most_weights` weights (both counted), idf and query weights go to the tasks: one pass counts documents by term,
    one pass scores whole documents, and only the best k a query and batch are shuffled, never postings.
    Beyond that, postings are weighted and joined by term.
    """
    order = W.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    n = docs.count()
    df = docs.select("doc_id", F.explode(F.array_distinct(terms)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = stage(df.select("term", F.log2(F.lit(float(n)) / F.col("df")).alias("idf")), "idf")
    qw = stage(query_weights(queries, query_terms, idf).where("qw <> 0"), "queries")
    if idf.count() <= most_terms and qw.count() <= most_weights:
        s = _score_texts(docs.select("doc_id", terms.alias("terms")), idf.toArrow(), qw.toArrow(), k)
    else:
        s = top_by_join(tfidf_weights(docs, terms)[0], qw)
    return s.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _score_texts(docs: DataFrame, idf: pa.Table, q: pa.Table, k: int) -> DataFrame:
    vocabulary = idf["term"].combine_chunks()
    items = np.unique(q["item_id"].to_numpy())
    at = pc.index_in(q["term"].combine_chunks(), vocabulary).to_numpy(zero_copy_only=False)
    used = np.unique(at)  # terms of the vocabulary that some query has
    column = np.full(len(vocabulary), -1)
    column[used] = np.arange(len(used))
    weights = (np.searchsorted(items, q["item_id"].to_numpy()), column[at], q["qw"].to_numpy())
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, idf["idf"].to_numpy(), items, column, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, idf, items, column, (qi, qt, qw) = shared.value
        v = max(1, len(vocabulary))
        sort = np.argsort(qt, kind="stable")
        qi, qt, qw = qi[sort], qt[sort], qw[sort]
        width = int(column.max()) + 1 if len(column) else 0
        start = np.searchsorted(qt, np.arange(width + 1))
        matrix = None
        if len(items) * width <= 8_000_000:
            matrix = np.zeros((len(items), width))
            matrix[qi, qt] = qw
        for b in batches:
            for s0 in range(0, b.num_rows, 512):
                c = b.slice(s0, 512)
                if not c.num_rows or not len(items):
                    continue
                ids, t = c.column("doc_id").to_numpy(), c.column("terms")
                sizes = np.diff(t.offsets.to_numpy())
                code = pc.index_in(t.flatten(), vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)
                pair, tf = np.unique(np.repeat(np.arange(len(ids)), sizes) * v + code, return_counts=True)
                row, code = pair // v, pair % v
                w = tf * idf[code]
                norm = np.sqrt(np.bincount(row, w * w, minlength=len(ids)))
                w = np.divide(w, norm[row], out=np.zeros_like(w), where=norm[row] > 0)
                col = column[code]
                row, col, w = row[col >= 0], col[col >= 0], w[col >= 0]
                if matrix is not None:
                    dense = np.zeros((width, len(ids)))
                    dense[col, row] = w
                    score = matrix @ dense
                else:
                    score = np.zeros((len(items), len(ids)))
                    by = np.argsort(col, kind="stable")
                    edge = np.flatnonzero(np.concatenate(([True], col[by][1:] != col[by][:-1]))) if len(col) else np.zeros(0, np.int64)
                    for a, z in zip(edge, np.append(edge[1:], len(col))):
                        x = slice(start[col[by[a]]], start[col[by[a]] + 1])
                        score[np.ix_(qi[x], row[by[a:z]])] += np.multiply.outer(qw[x], w[by[a:z]])
                score = np.round(score, 6)
                keep = score > 0
                if len(ids) > k:
                    last = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k]
                    keep &= score >= last[:, None]  # ties with the last place stay; the final ranking decides
                i, j = np.nonzero(keep)
                yield pa.record_batch({"item_id": items[i], "doc_id": ids[j], "score": score[i, j]})

    return spread(docs.where("terms is not null and doc_id is not null")).mapInArrow(run, "item_id long, doc_id long, score double")


def success_and_reciprocal_rank(ranked: DataFrame, answers: DataFrame, item: str = "item_id", found: str = "answer", k: int = 20) -> DataFrame:
    """One row: queries, success@k, sum and mean of reciprocal ranks; ranked(item, rank, found), answers(item, answer)."""
    hit = ranked.join(answers.withColumnRenamed("answer", "_want"), item).where((F.col(found) == F.col("_want")) & (F.col("rank") <= k))
    first = hit.groupBy(item).agg(F.min("rank").alias("rank"))
    j = answers.select(item).distinct().join(first, item, "left")
    return j.agg(F.count("*").alias("queries"), F.count("rank").alias("success"), F.coalesce(F.sum(1 / F.col("rank")), F.lit(0.0)).alias("rr_sum")).withColumn("mrr", F.col("rr_sum") / F.greatest(F.col("queries"), F.lit(1)))


def structured_scores(terms: DataFrame, edges: DataFrame, vectors: DataFrame, relations: DataFrame, same: DataFrame | None = None) -> DataFrame:
    """terms(item_id, ent, cnt), edges(repo, ent, r), vectors(id, vec), relations(r, vec) -> (item_id, repo, score).

    same(ent, other), the SameToNE edges, adds to each asked entity its out-neighbours with the count of the asked one.
    Score: sum of cnt * cosine01(entity - relation, repository); a missing vector counts as similarity 0. The similarity
    belongs to the edge, so it is computed once for each edge of an entity that is asked for, not once a query.
    """
    if same is not None:
        also = terms.join(same.select("ent", "other").distinct(), "ent").select("item_id", F.col("other").alias("ent"), "cnt")
        terms = terms.select("item_id", "ent", "cnt").unionByName(also).groupBy("item_id", "ent").agg(F.sum("cnt").alias("cnt"))
    asked = edges.join(terms.select("ent"), "ent", "left_semi").join(vectors.select(F.col("id").alias("ent"), F.col("vec").alias("ev")), "ent", "left")
    asked = asked.join(vectors.select(F.col("id").alias("repo"), F.col("vec").alias("rv")), "repo", "left").join(F.broadcast(relations.withColumnRenamed("vec", "lv")), "r", "left")
    sim = cosine01_rows(asked.select("ent", "repo", "ev", "lv", "rv"), "ev", "rv", "lv").groupBy("ent", "repo").agg(F.sum("sim").alias("sim"))
    return terms.join(sim, "ent").groupBy("item_id", "repo").agg(F.sum(F.col("cnt") * F.col("sim")).alias("score"))


def unstructured_scores(words: DataFrame, links: DataFrame, vectors: DataFrame) -> DataFrame:
    """words(item_id, word, cnt), links(repo, word), vectors(name, vec) -> (item_id, repo, score): sum of cnt * cosine01."""
    asked = links.distinct().join(words.select("word"), "word", "left_semi").join(vectors.select(F.col("name").alias("word"), F.col("vec").alias("wv")), "word", "left")
    sim = cosine01_rows(asked.join(vectors.select(F.col("name").alias("repo"), F.col("vec").alias("rv")), "repo", "left").select("word", "repo", "wv", "rv"), "wv", "rv")
    return words.join(sim, "word").groupBy("item_id", "repo").agg(F.sum(F.col("cnt") * F.col("sim")).alias("score"))


def combined(structured: DataFrame, unstructured: DataFrame, alpha: float, k: int = 20) -> DataFrame:
    """alpha * structured + (1 - alpha) * unstructured: best k per query, ties by repository."""
    s = structured.select("item_id", "repo", (alpha * F.col("score")).alias("score")).unionByName(unstructured.select("item_id", "repo", ((1 - alpha) * F.col("score")).alias("score")))
    s = s.groupBy("item_id", "repo").agg(F.round(F.sum("score"), 6).alias("score"))
    return s.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), "repo"))).where(F.col("rank") <= k).select("item_id", "rank", "repo", "score")


def enrich_normalised(terms: DataFrame, similar: DataFrame) -> DataFrame:
    """terms(item_id, term, cnt), similar(term, other, prob) -> (item_id, term, weight).

    A term has weight cnt / total, a similar term prob / total; total is the sum of cnt and of 1 for every added term. A
    similar term that is itself a term of the query is not added; one that several bring counts once each.
    """
    add = terms.join(similar, "term").join(terms.select("item_id", F.col("term").alias("other")), ["item_id", "other"], "left_anti")
    total = terms.groupBy("item_id").agg(F.sum("cnt").alias("c")).join(add.groupBy("item_id").agg(F.count("*").alias("a")), "item_id", "left")
    total = total.select("item_id", (F.col("c") + F.coalesce("a", F.lit(0))).alias("total"))
    parts = terms.select("item_id", "term", F.col("cnt").cast("double").alias("x")).unionByName(add.select("item_id", F.col("other").alias("term"), F.col("prob").alias("x")))
    return parts.groupBy("item_id", "term").agg(F.sum("x").alias("x")).join(total, "item_id").select("item_id", "term", (F.col("x") / F.col("total")).alias("weight"))


def enrich_additive(terms: DataFrame, similar: DataFrame, factor: float = 0.01) -> DataFrame:
    """(item_id, term, weight): cnt of a term plus factor * prob * cnt / (number of its similar terms) from each that brings it."""
    add = terms.join(similar.withColumn("n", F.count("*").over(W.partitionBy("term"))), "term")
    parts = terms.select("item_id", "term", F.col("cnt").cast("double").alias("x")).unionByName(add.select("item_id", F.col("other").alias("term"), (factor * F.col("prob") * F.col("cnt") / F.col("n")).alias("x")))
    return parts.groupBy("item_id", "term").agg(F.sum("x").alias("weight"))


def complete_payloads(ranked: DataFrame, shown: DataFrame) -> DataFrame:
    """ranked(item_id, rank, repo) with shown(repo, ..): only queries all of whose results can be shown (all or nothing)."""
    j = ranked.join(shown.withColumn("_there", F.lit(True)), "repo", "left")
    ok = j.groupBy("item_id").agg(F.bool_and(F.col("_there").isNotNull()).alias("ok")).where("ok").select("item_id")
    return j.join(ok, "item_id", "left_semi").drop("_there")
