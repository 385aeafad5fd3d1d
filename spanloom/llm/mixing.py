"""Mixing sources to target shares by Efraimidis-Spirakis sampling.

The budget of a source is its share of the total size; a source may be used at most `max_repeats` times. Complete
epochs come first; the rest is drawn without replacement with probability by weight: every document gets the key
-ln(u) / w, with u from a hash of its id and the seed and w its quality weight, and documents are taken in the order of
their keys while the running sum of sizes stays within the rest. The running sum is taken over range partitions of
(source, key, id), so neither a source of a third of all documents nor a crowd of like keys is sorted in one task. A
source is short if every copy it may give has been taken and its share is not reached.

Defined results: null or blank documents have size 0 and count as documents of no size, they come with complete
epochs only; null sources and sources without a target are left out of the mix, but count in the total size; a target
without documents is reported with size 0; weights that are null, not finite or not positive count as 1e-6;
repeated doc_id rows count once; ties in the key go to the smaller id; an empty corpus gives a report of zeros; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from spanloom.operators.order import running_sum
from spanloom.runtime import spread, stage


def norm_source(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"^\s+|\s+$", "")


# The white space of Unicode.
WHITE_SPACE = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def white_space_size(text: Column) -> Column:
    """The number of parts between white space, in the sense of Unicode: a no-break space separates too."""
    return F.size(F.filter(F.split(text, WHITE_SPACE), lambda x: x != "")).cast("long")


def token_sizes(documents: DataFrame, tokenizer_path: str) -> DataFrame:
    """Adds size: tokens of the tokenizers-library file at tokenizer_path, read by the driver and sent to the tasks; special
    strings in a text are ordinary text."""
    names = documents.columns
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(shared.value)
        t.encode_special_tokens = True
        for b in batches:
            n = [len(e.ids) for s in range(0, b.num_rows, 256) for e in t.encode_batch([x or "" for x in b.column("text").slice(s, 256).to_pylist()], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], [*names, "size"])

    schema = ", ".join(f"`{c}` {k}" for c, k in documents.dtypes)
    return spread(documents).mapInArrow(run, f"{schema}, size long")


def quality(text: Column) -> Column:
    """A weight in (0, 1]: the share of letters among the characters, times the share of different words."""
    n = F.length(text)
    letters = F.length(F.regexp_replace(text, r"\P{L}", ""))
    parts = F.split(F.lower(text), WHITE_SPACE)
    return F.when(n > 0, letters / n * F.size(F.array_distinct(parts)) / F.size(parts)).otherwise(0.0)


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from the first 52 bits of the MD5 of "key-seed": the same in any engine."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("-", key.cast("string"), F.lit(str(seed)))), 1, 13), 16, 10).cast("long")
    return (bits + 0.5) / float(1 << 52)


class Mix:
    """plan: one row a target source; selection: the drawn documents. Both are lazy beyond the staged sizes."""

    def __init__(self, documents: DataFrame, targets: DataFrame, seed: int = 17) -> None:
        """documents(doc_id, source, size, weight), targets(source, target_share, max_repeats)."""
        w = F.col("weight").cast("double")
        w = F.when(w.isNotNull() & ~F.isnan(w) & (w > 0) & (w < float("inf")), w).otherwise(1e-6)
        docs = documents.where("doc_id is not null").select("doc_id", norm_source(F.col("source")).alias("src"), F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("size"), (-F.log(uniform(F.col("doc_id"), seed)) / w).alias("key"))
        self.docs = stage(docs.dropDuplicates(["doc_id"]), "sizes")
        have = stage(self.docs.groupBy("src").agg(F.sum("size").alias("available"), F.count("*").alias("documents"), F.count(F.when(F.col("size") > 0, 1)).alias("filled")), "sources")
        total = have.agg(F.coalesce(F.sum("available"), F.lit(0))).first()[0]
        t = targets.where("source is not null").select("source", norm_source(F.col("source")).alias("src"), F.col("target_share").cast("double"), F.col("max_repeats").cast("long"))
        plan = t.join(have, "src", "left").withColumn("total", F.lit(total))
        for c in ("available", "documents", "filled"):
            plan = plan.withColumn(c, F.coalesce(c, F.lit(0)))
        plan = plan.withColumn("budget", F.floor(F.col("target_share") * F.col("total")))
        plan = plan.withColumn("use", F.least("budget", F.col("available") * F.col("max_repeats")))
        plan = plan.withColumn("epochs", F.when(F.col("available") > 0, F.floor(F.col("use") / F.col("available"))).otherwise(0))
        self.plan = stage(plan.withColumn("rest", F.col("use") - F.col("epochs") * F.col("available")), "plan")
        drawn = self.docs.where("size > 0").join(F.broadcast(self.plan.where("rest > 0").select("src", "rest")), "src")
        run = running_sum(drawn, ["src", "key", "doc_id"], "size", "upto")
        before = run.groupBy("src").agg(F.min(F.col("upto") - F.col("size")).alias("before"))  # the sum of the sources before
        self.part = run.join(F.broadcast(before), "src").where("upto - before <= rest").select("doc_id", "src", "size")

    def selection(self) -> DataFrame:
        """(doc_id, source, repeats): how often each document is used."""
        whole = self.docs.join(F.broadcast(self.plan.where("epochs > 0").select("src", "source", "epochs")), "src").select("doc_id", "source", F.col("epochs").cast("long").alias("repeats"))
        part = self.part.join(F.broadcast(self.plan.select("src", "source")), "src").select("doc_id", "source", F.lit(1).cast("long").alias("repeats"))
        return whole.unionByName(part).groupBy("doc_id", "source").agg(F.sum("repeats").alias("repeats"))

    def report(self) -> DataFrame:
        """Per target: what there is, what was wanted, what was used, the share reached and whether the source is short."""
        drawn = self.part.groupBy("src").agg(F.sum("size").alias("drawn"), F.count("*").alias("copies"))
        r = self.plan.join(drawn, "src", "left").withColumn("used", F.col("epochs") * F.col("available") + F.coalesce("drawn", F.lit(0)))
        taken = F.col("epochs") * F.col("filled") + F.coalesce("copies", F.lit(0))
        r = r.withColumn("short", (taken == F.col("filled") * F.col("max_repeats")) & (F.col("used") < F.col("target_share") * F.col("total")))
        everything = F.sum("used").over(W.partitionBy())  # over the few target rows
        r = r.withColumn("actual_share", F.when(everything > 0, F.col("used") / everything).otherwise(0.0))
        return r.select("source", "target_share", "max_repeats", "documents", "available", "budget", "epochs", "used", "actual_share", "short")


def mix(documents: DataFrame, targets: DataFrame, seed: int = 17) -> Mix:
    return Mix(documents, targets, seed)
