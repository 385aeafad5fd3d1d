"""Queries of the trainers; their results are checked by falling losses, not by SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.learning import sgd
from spanloom.operators import metapath as M, sampling
from spanloom.operators.order import positions
from spanloom.plans.graphs import network
from spanloom.plans.registry import Registry
from spanloom.plans.vectors import triples
from spanloom.runtime import spread, stage, table

R = Registry()


@R.add("train_transe")
def train_transe(spark, d):
    """Losses of the rounds of a TransE training (GL17)."""
    t = triples(spark, d)
    ids = stage(sampling.entity_pool(t), "ids")
    n = t.join(ids.select(F.col("value").alias("h"), F.col("idx").alias("hi")), "h").join(ids.select(F.col("value").alias("t"), F.col("idx").alias("ti")), "t")
    n = stage(spread(n.select(F.col("hi").alias("h"), F.col("ti").alias("t"), F.col("r").cast("long").alias("r"))), "triples")
    _, _, history = sgd.train_transe(n, ids.count(), (n.agg(F.max("r")).first()[0] or 0) + 1)
    return spark.createDataFrame(list(enumerate(history)), "round int, loss double")


@R.add("train_metapath")
def train_metapath(spark, d):
    """Losses of a training on all pairs of a million walks along the six paths (GL15, GL16); negatives by AG24."""
    net = stage(network(spark, d), "network")
    walks = stage(M.default_walks(net), "walks")
    ids = stage(positions(net.select(F.col("src").alias("name")).distinct(), ["name"], "id"), "ids")
    named = walks
    for k in range(3):
        named = named.join(ids.select(F.col("name").alias(f"n{k}"), F.col("id").alias(f"i{k}")), f"n{k}").drop(f"n{k}")
    tables, ends = [], F.lit(None)
    counts = stage(M.walk_counts(net, [p for p, _ in M.PATHS], backward=False), "counts")
    for p, _ in M.PATHS:
        for k in (1, 2):
            prob = M.negative_distribution(counts.where((F.col("path") == p) & (F.col("step") == k))).join(ids, F.col("node") == F.col("name")).select("id", "prob").toArrow().sort_by("id")
            ends = F.when((F.col("path") == p) & (F.col("k") == k), len(tables)).otherwise(ends)
            tables.append((prob["id"].to_numpy(), prob["prob"].to_numpy()))
    pair = lambda a, b: F.struct(F.col(f"i{a}").alias("u"), F.col(f"i{b}").alias("v"), F.lit(b).alias("k"))
    p = named.select("path", F.explode(F.array(pair(0, 1), pair(1, 2), pair(0, 2))).alias("e")).select("path", "e.*")
    pairs = stage(p.select("u", "v", ends.cast("int").alias("g")).repartition(2 * spark.sparkContext.defaultParallelism), "pairs")
    _, history = sgd.train_pairs(pairs, ids.count(), weights=tables)
    return spark.createDataFrame(list(enumerate(history)), "round int, loss double")


@R.add("doc2vec_topk")
def doc2vec_topk(spark, d):
    """The 20 descriptions most like each held-out query by averaged word vectors (GL25, SL4); a stand-in by Word2Vec."""
    from pyspark.ml.feature import Word2Vec

    from spanloom.operators import vectors as O

    words = lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda x: x != "")
    docs = table(spark, d, "repositories").select("repo_id", F.concat(F.coalesce("git_description", F.lit("")), F.coalesce("npm_description", F.lit(""))).alias("text")).distinct()
    docs = stage(docs.select("repo_id", words("text").alias("w")).where("size(w) > 0"), "words")
    model = Word2Vec(vectorSize=100, windowSize=8, minCount=4, maxIter=1, seed=5, inputCol="w", outputCol="v").fit(docs)
    from pyspark.ml.functions import vector_to_array

    v = model.transform(docs).select(F.col("repo_id").alias("id"), vector_to_array("v").alias("vec"))
    q = table(spark, d, "verification_samples").select("item_id", words("query").alias("w"))
    q = model.transform(q).select((-F.col("item_id") - 1).alias("id"), vector_to_array("v").alias("vec"))
    r = O.block_search(q, stage(v, "vectors"), 100, top=20)
    return r.select((-F.col("a") - 1).alias("item_id"), "rank", F.col("b").alias("repo_id"), F.round("sim", 4).alias("sim"))
