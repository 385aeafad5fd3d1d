"""Entity resolution: votes, representatives, canonical forms, fuzzy matches, abbreviations."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as TP

from spanloom.functions import text as T

# Public short forms of common terms in package metadata, short form -> expansion.
ABBREVIATIONS = {
    "js": "javascript", "ts": "typescript", "py": "python", "cli": "command line interface", "api": "application programming interface",
    "ui": "user interface", "gui": "graphical user interface", "db": "database", "css": "cascading style sheets", "html": "hypertext markup language",
    "http": "hypertext transfer protocol", "url": "uniform resource locator", "orm": "object relational mapping", "sdk": "software development kit",
    "ide": "integrated development environment", "i18n": "internationalization", "l10n": "localization", "a11y": "accessibility", "k8s": "kubernetes",
    "ml": "machine learning", "ai": "artificial intelligence", "nlp": "natural language processing", "dom": "document object model", "os": "operating system",
}


def frequency(rows: DataFrame) -> DataFrame:
    return rows.groupBy("ne").agg(F.count("*").alias("cnt"))


def category_vote(rows: DataFrame) -> DataFrame:
    """(ne, cat, votes): the most frequent category, ties to the lower one."""
    c = rows.groupBy("ne", "cat").agg(F.count("*").alias("votes"))
    return c.groupBy("ne").agg(F.max(F.struct("votes", (-F.col("cat")).alias("m"))).alias("b")).select("ne", (-F.col("b.m")).cast("int").alias("cat"), F.col("b.votes").alias("votes"))


def representatives(freq: DataFrame) -> DataFrame:
    """(ne, representative): the most frequent form with the same lemma, ties to the smaller form."""
    l = freq.withColumn("lemma", T.lemma_key(F.col("ne")))  # noqa: E741
    best = l.groupBy("lemma").agg(F.min_by("ne", F.struct((-F.col("cnt")).alias("n"), "ne")).alias("representative"))
    return l.join(best, "lemma").select("ne", "representative")


def canonicalize(rows: DataFrame, canon: DataFrame, category: DataFrame) -> DataFrame:
    """rows(repo_id, ne, cat) -> (repo_id, canon, cat, cnt), falling back to the entity and its own category."""
    j = rows.join(canon, "ne", "left").withColumn("canon", F.coalesce("representative", "ne"))
    j = j.join(category.select(F.col("ne").alias("canon"), F.col("cat").alias("voted")), "canon", "left")
    return j.groupBy("repo_id", "canon", F.coalesce("voted", "cat").alias("cat")).agg(F.count("*").alias("cnt"))


def ratio(a: str, b: str) -> int:
    """100 for equal texts, 0 if one is empty, else the rounded percentage of matching characters (not symmetric)."""
    if a == b:
        return 100
    return int(round(100 * SequenceMatcher(None, a, b).ratio())) if a and b else 0


@F.pandas_udf(TP.DoubleType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([float(ratio(x, y)) for x, y in zip(a, b)])


def fuzzy_match(left: DataFrame, right: DataFrame, threshold: float, measure: str = "ratio") -> DataFrame:
    """left(ne), right(ne) -> (ne, match, score): the best match at or above threshold, ties to the smaller match.

    Candidates share a part: a text within k edits of another keeps one of its k + 1 pieces unchanged, at a place
    shifted by k at most, so texts are joined on (piece, length, place) and only candidates are scored.
    """
    t = threshold / 100 - 0.005  # the percentage is rounded
    # Edits allowed: for the ratio 2m / (a + b), insertions and deletions a + b - 2m; for edit distance, (1 - t) * the longer.
    worst = (lambda n: 2 * (1 - t) / t * n) if measure == "ratio" else (lambda n: (1 - threshold / 100) / (threshold / 100) * n)
    n = F.length("ne")
    l = left.select("ne", n.alias("n")).where("n > 0").withColumn("k", F.floor(worst(F.col("n")) + 1e-9).cast("int"))  # noqa: E741
    # Pieces of the left text: k + 1 of nearly equal length.
    parts = F.least(F.col("k") + 1, F.col("n"))
    cut = F.transform(
        F.sequence(F.lit(0), parts - 1),
        lambda i: F.struct(F.floor(i * F.col("n") / parts).cast("int").alias("at"), (F.floor((i + 1) * F.col("n") / parts) - F.floor(i * F.col("n") / parts)).cast("int").alias("len")),
    )
    l = l.withColumn("p", F.explode(cut)).select("ne", "n", "k", F.col("p.at").alias("at"), F.substring(F.col("ne"), F.col("p.at") + 1, F.col("p.len")).alias("piece"))  # noqa: E741
    # The key of the join is (piece, length of the other text, its place there): both sides list what the k edits allow.
    sizes = [r["x"] for r in l.select(F.length("piece").alias("x")).distinct().collect()]  # piece lengths: a handful
    l = l.withColumn("m", F.explode(F.sequence(F.greatest(F.lit(1), F.col("n") - F.col("k")), F.col("n") + F.col("k"))))  # noqa: E741
    l = l.withColumn("rat", F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - F.col("k")), F.col("at") + F.col("k"))))  # noqa: E741
    l = l.where(F.col("rat") + F.length("piece") <= F.col("m"))  # noqa: E741
    r = right.select(F.col("ne").alias("match"), F.length("ne").alias("m")).where("m > 0")
    gram = lambda s: F.transform(F.sequence(F.lit(0), F.greatest(F.col("m") - s, F.lit(0))), lambda i: F.struct(i.alias("rat"), F.substring(F.col("match"), i + 1, F.lit(s)).alias("piece")))
    grams = F.flatten(F.array(*map(gram, sizes or [1])))
    r = r.withColumn("g", F.explode(grams)).select("match", "m", "g.rat", "g.piece")
    cand = l.join(r, ["piece", "m", "rat"]).select("ne", "match").distinct()
    if measure == "ratio":
        scored = cand.withColumn("score", ratio_udf("ne", "match"))
    else:
        scored = cand.withColumn("score", 100 * (1 - F.levenshtein("ne", "match").cast("double") / F.greatest(F.length("ne"), F.length("match"))))
    best = scored.where(F.col("score") >= threshold).groupBy("ne").agg(F.min(F.struct((-F.col("score")).alias("s"), "match")).alias("b"))
    return best.select("ne", F.col("b.match").alias("match"), (-F.col("b.s")).alias("score"))


def abbreviations(entities: DataFrame, pairs: DataFrame | None = None, threshold: int = 85) -> DataFrame:
    """(ne, short, expansion): the expansion of a known short form, or the first short form whose expansion is like ne.

    pairs(no, short, expansion), a small table: ABBREVIATIONS by default. Entities that are no short form meet only the
    expansions whose length allows the ratio: 2 min / (a + b) is its bound.
    """
    spark = entities.sparkSession
    if pairs is None:
        pairs = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(ABBREVIATIONS.items())], "no int, short string, expansion string")
    ne = entities.select("ne").where("ne is not null").distinct()
    exact = ne.join(F.broadcast(pairs), F.col("ne") == F.col("short")).select("ne", "short", "expansion")
    a, b = F.length("ne"), F.length("expansion")
    near = ne.join(F.broadcast(pairs.select("short")), F.col("ne") == F.col("short"), "left_anti")
    near = near.join(F.broadcast(pairs), 200 * F.least(a, b) >= (threshold - 0.5) * (a + b)).where(ratio_udf("expansion", "ne") >= threshold)
    near = near.groupBy("ne").agg(F.min(F.struct("no", "short", "expansion")).alias("p")).select("ne", "p.short", "p.expansion")
    return exact.unionByName(near)
