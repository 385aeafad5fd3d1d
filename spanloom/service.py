"""The answer of the search as it is served: queries in, ranked packages or a JSON envelope out. No server is included."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

ALPHA = 0.35  # of the served system; 0.7 is the default of the bare searcher


def valid_queries(queries: DataFrame) -> DataFrame:
    """queries(item_id, query): blank and null queries are rejected, repeated rows count once."""
    return queries.where(F.col("query").isNotNull() & (F.trim("query") != "")).dropDuplicates(["item_id"])


def search(queries: DataFrame, score: Callable[[DataFrame], DataFrame], k: int = 20) -> DataFrame:
    """score(valid queries) -> (item_id, repo, score); the best k of each query, ties by repo."""
    s = score(valid_queries(queries))
    w = W.partitionBy("item_id").orderBy(F.desc("score"), "repo")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("item_id", "rank", "repo", "score")


def envelope(spark: SparkSession, text: str | None, score: Callable[[DataFrame], DataFrame], shown: DataFrame, k: int = 20) -> str:
    """The JSON {success, payload, message} of one query; shown(repo, ..) is what a result displays. Results are k rows at most."""
    if not (text or "").strip():
        return json.dumps({"success": False, "payload": [], "message": "empty query"})
    found = search(spark.createDataFrame([(0, text)], "item_id long, query string"), score, k)
    rows = [r.asDict() for r in found.join(shown, "repo", "left").withColumn("known", F.col(shown.columns[-1]).isNotNull()).orderBy("rank").collect()]
    if not all(r.pop("known") for r in rows):
        return json.dumps({"success": False, "payload": [], "message": "a result has no record"})
    return json.dumps({"success": True, "payload": rows, "message": ""}, ensure_ascii=False)
