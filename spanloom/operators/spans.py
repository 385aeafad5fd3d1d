"""BIO-S spans over tokens in long form: encode, decode, word pieces, scores.

A label is 3 * category + {0: B, 1: I, 2: S}; 18 is outside. All windows are over one sentence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from spanloom.functions.text import splice_entity

OUTSIDE = 18


def marked_tokens(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with #k# markers -> (doc_id, pos, token), markers as tokens of their own."""
    t = F.filter(F.split(F.regexp_replace("text", "(#[0-5]#)", " $1 "), r"\s+"), lambda x: x != "")
    return docs.select("doc_id", F.posexplode(t).alias("pos", "token"))


def encode(marked: DataFrame) -> DataFrame:
    """(doc_id, pos, token, label) without markers, pos counted again. An open span runs to the end; an empty one leaves nothing."""
    order = W.partitionBy("doc_id").orderBy("pos")
    m = marked.withColumn("marker", F.col("token").rlike("^#[0-5]#$"))
    m = m.withColumn("n", F.sum(F.col("marker").cast("int")).over(order))
    m = m.withColumn("cat", F.last(F.when(F.col("marker"), F.substring("token", 2, 1).cast("int")), ignorenulls=True).over(order))
    m = m.where("not marker")
    span = W.partitionBy("doc_id", "n")
    at = F.row_number().over(span.orderBy("pos"))
    label = (
        F.when(F.col("n") % 2 == 0, OUTSIDE)
        .when(F.count("*").over(span) == 1, F.col("cat") * 3 + 2)
        .when(at == 1, F.col("cat") * 3)
        .otherwise(F.col("cat") * 3 + 1)
    )
    return m.select("doc_id", (F.row_number().over(order) - 1).alias("pos"), "token", label.cast("int").alias("label"))


def decode(labels: DataFrame) -> DataFrame:
    """(doc_id, pos, label) -> (doc_id, cat, start, stop): B I* and S are spans; an I that continues none is ignored."""
    order = W.partitionBy("doc_id").orderBy("pos")
    l = labels.withColumn("go_on", (F.col("label") < OUTSIDE) & (F.col("label") % 3 == 1))  # noqa: E741
    l = l.withColumn("island", F.sum((~F.col("go_on")).cast("int")).over(order))  # noqa: E741
    first = F.first("label").over(W.partitionBy("doc_id", "island").orderBy("pos"))
    l = l.withColumn("head", first)  # noqa: E741
    island = l.groupBy("doc_id", "island").agg(
        F.min("pos").alias("start"), F.max("pos").alias("last"), F.max("head").alias("head"),
        F.min(F.when(F.col("go_on") & (F.floor(F.col("label") / 3) != F.floor(F.col("head") / 3)), F.col("pos"))).alias("off"),
    )
    island = island.where((F.col("head") < OUTSIDE) & (F.col("head") % 3 != 1))
    stop = F.when(F.col("head") % 3 == 2, F.col("start")).otherwise(F.coalesce(F.col("off") - 1, F.col("last")))
    return island.select("doc_id", F.floor(F.col("head") / 3).cast("int").alias("cat"), "start", stop.alias("stop"))


def span_texts(spans: DataFrame, tokens: DataFrame) -> DataFrame:
    """spans(doc_id, cat, start, stop), tokens(doc_id, pos, token) -> (doc_id, cat, start, ne): the spliced lower-case text; links are dropped."""
    j = spans.join(tokens.select("doc_id", "pos", "token"), "doc_id").where("pos between start and stop")
    t = j.groupBy("doc_id", "cat", "start").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("t"))
    ne = F.lower(splice_entity(F.transform("t", lambda x: x["token"])))
    return t.select("doc_id", "cat", "start", ne.alias("ne")).where(~F.col("ne").contains("//") & (F.col("ne") != ""))


def pieces_of(token: Column, size: int = 4) -> Column:
    """How many word pieces a token has: a stand-in of `size` characters a piece; pluggable."""
    return F.greatest(F.lit(1), F.ceil(F.length(token) / size)).cast("int")


def expand_pieces(tokens: DataFrame, size: int = 4) -> DataFrame:
    """(doc_id, pos, token, label) -> (doc_id, piece, word, label): B gives B, I ..; S gives S, or B, I .. of several pieces."""
    t = tokens.withColumn("k", pieces_of(F.col("token"), size))
    before = F.coalesce(F.sum("k").over(W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    t = t.withColumn("before", before).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    kind, cat = F.col("label") % 3, F.floor(F.col("label") / 3) * 3
    label = (
        F.when(F.col("label") == OUTSIDE, OUTSIDE).when(kind == 1, F.col("label"))
        .when(F.col("k") == 1, F.col("label")).when(F.col("i") == 0, cat).otherwise(cat + 1)
    )
    return t.select("doc_id", (F.col("before") + F.col("i")).cast("int").alias("piece"), F.col("pos").alias("word"), label.cast("int").alias("label"))


def project_pieces(pieces: DataFrame) -> DataFrame:
    """(doc_id, piece, word, label) -> spans of words: decode the pieces, then the first and last word of each span."""
    spans = decode(pieces.select("doc_id", F.col("piece").alias("pos"), "label"))
    j = spans.join(pieces.select("doc_id", "piece", "word"), "doc_id").where("piece between start and stop")
    return j.groupBy("doc_id", "cat", "start").agg(F.min("word").alias("first"), F.max("word").alias("last")).select("doc_id", "cat", F.col("first").alias("start"), F.col("last").alias("stop")).distinct()


def dictionary_tags(train: DataFrame, tokens: DataFrame, least: int = 1) -> DataFrame:
    """The default tagger: a token gets S of the category it is most often labelled with, if that is more often than outside.

    train(doc_id, pos, token, label), tokens(doc_id, pos, token) -> (doc_id, pos, label).
    """
    c = train.groupBy("token", F.floor(F.col("label") / 3).cast("int").alias("cat")).agg(F.count("*").alias("n"))
    best = c.groupBy("token").agg(F.max(F.struct("n", (-F.col("cat")).alias("m"))).alias("b")).where(f"b.n >= {least}")
    best = best.select("token", (-F.col("b.m")).alias("cat"))
    j = tokens.join(best, "token", "left")
    return j.select("doc_id", "pos", F.when(F.col("cat").isNull() | (F.col("cat") == 6), OUTSIDE).otherwise(F.col("cat") * 3 + 2).cast("int").alias("label"))


def scores(gold: DataFrame, predicted: DataFrame, eps: float = 1e-7) -> DataFrame:
    """One row: exact spans in both, precision, recall and F1."""
    g, p = gold.select("doc_id", "cat", "start", "stop").distinct(), predicted.select("doc_id", "cat", "start", "stop").distinct()
    tagged = g.withColumn("g", F.lit(1)).join(p.withColumn("p", F.lit(1)), ["doc_id", "cat", "start", "stop"], "full")
    n = tagged.agg(F.count("g").alias("gold"), F.count("p").alias("predicted"), F.count(F.col("g") + F.col("p")).alias("both"))
    pr, rc = F.col("both") / (F.col("predicted") + eps), F.col("both") / (F.col("gold") + eps)
    n = n.withColumn("precision", pr).withColumn("recall", rc)
    return n.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + eps))
