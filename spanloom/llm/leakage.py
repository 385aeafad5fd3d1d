"""Passages of held-out test items inside a corpus: one Aho-Corasick automaton over normalised passages.

The words of every item text are cut into windows of `width` words; the automaton holds each window once, as its
words joined and enclosed by single spaces, with the items it belongs to. A document is lower-cased and reduced to
its words in the same way and scanned once; a hit is traced back to character offsets of the original text.

The automaton is made of held-out items only. It is built on the driver and broadcast while there are at most
`most_windows` windows (about 3 KB each as a trie, so 150 MB); more windows take further scans. A scan gives runs of
adjacent windows; runs of all scans are joined before they are counted, so the result does not depend on the number.

Defined results: null or blank texts and items with fewer than `width` words match nothing; a window that several
items share counts for each; repeated rows of a document count once; of several texts under one id the one with the
longest run counts; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from spanloom.llm.common import words
from spanloom.runtime import spread

_RUN = re.compile("[a-z0-9]+")


def _lowered(text: str) -> tuple[str, list[int] | None]:
    """The lower-cased text and, where lengths differ, the original offset of each of its characters."""
    low = text.lower()
    if len(low) == len(text):
        return low, None
    at = [i for i, c in enumerate(text) for _ in c.lower()]
    return (low, at) if len(at) == len(low) else ("".join(c.lower() for c in text), at)


def _spans(text: str, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Start and end in the original text of hits given as (number of the first word, words)."""
    low, at = _lowered(text)
    runs = [m.span() for m in _RUN.finditer(low)]
    place = (lambda i: i) if at is None else (lambda i: at[i])
    return [(place(runs[a][0]), place(runs[a + n - 1][1] - 1) + 1) for a, n in hits]


def windows(items: DataFrame, width: int) -> DataFrame:
    """items(item_id, text) -> (window, item_ids): every run of `width` words of the items."""
    w = items.where("text is not null").select("item_id", words(F.col("text")).alias("w")).where(F.size("w") >= width)
    run = F.transform(F.sequence(F.lit(1), F.size("w") - width + 1), lambda i: F.array_join(F.slice("w", i, width), " "))
    return w.select("item_id", F.explode(run).alias("window")).groupBy("window").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))


def leaks(documents: DataFrame, items: DataFrame, width: int = 10, most_windows: int = 50_000) -> DataFrame:
    """documents(doc_id, text), items(item_id, text) -> (item_id, doc_id, passages, words, start, stop).

    passages: maximal runs of shared words; words: of the longest run; start, stop: the offsets of that run in text.
    """
    spark = documents.sparkSession
    all_windows = windows(items, width).orderBy("window")
    docs = spread(documents.where("doc_id is not null and text is not null").select("doc_id", "text", F.xxhash64("text").alias("h")))
    rows = all_windows.toLocalIterator()
    runs = None
    while True:
        automaton, n = ahocorasick.Automaton(), 0
        for r in rows:
            automaton.add_word(f" {r['window']} ", tuple(r["item_ids"]))
            n += 1
            if n == most_windows:
                break
        if not n and runs is not None:
            break
        if n:
            automaton.make_automaton()
        found = _scan(docs, spark.sparkContext.broadcast(automaton if n else None), width)
        runs = found if runs is None else runs.unionByName(found)
        if n < most_windows:
            break
    # Runs of several scans: those that overlap or follow each other at once are one.
    text = W.partitionBy("item_id", "doc_id", "h").orderBy("first", "last")
    reach = F.max("last").over(text.rowsBetween(W.unboundedPreceding, -1))
    islands = runs.withColumn("new", F.when(F.col("first") <= reach + 1, 0).otherwise(1)).withColumn("island", F.sum("new").over(text))
    islands = islands.groupBy("item_id", "doc_id", "h", "island").agg((F.max("last") - F.min("first") + width).alias("words"), F.min("start").alias("start"), F.max("stop").alias("stop"))
    best = F.max(F.struct("words", (-F.col("start")).alias("_"), "stop")).alias("b")
    texts = islands.groupBy("item_id", "doc_id", "h").agg(F.count("*").alias("passages"), best)
    one = texts.groupBy("item_id", "doc_id").agg(F.max(F.struct("b", "passages", "h")).alias("t"))
    return one.select("item_id", "doc_id", "t.passages", "t.b.words", (-F.col("t.b._")).alias("start"), "t.b.stop")


_RUNS = "item_id long, doc_id long, h long, first long, last long, start long, stop long"


def _scan(docs: DataFrame, shared, width: int) -> DataFrame:
    """Runs of adjacent windows of an item in a text: the numbers of the first words of the first and the last window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for b in batches:
            cols = defaultdict(list)
            if automaton is None:
                return
            for doc, text, h in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("h").to_pylist()):
                flat = " " + " ".join(_RUN.findall(_lowered(text)[0])) + " "
                hits = defaultdict(list)
                for end, owners in automaton.iter(flat):
                    for item in owners:
                        hits[item].append(end)
                if not hits:
                    continue
                # The number of the last word of a hit is the number of blanks before its end, less one.
                number, seen, last = {}, 0, 0
                for end in sorted({e for ends in hits.values() for e in ends}):
                    seen += flat.count(" ", last, end)
                    last = end
                    number[end] = seen - width
                for item, ends in hits.items():
                    runs: list[list[int]] = []
                    for e in ends:
                        if runs and number[e] <= runs[-1][1] + 1:
                            runs[-1][1] = number[e]
                        else:
                            runs.append([number[e], number[e]])
                    spans = _spans(text, [(f, t - f + width) for f, t in runs])
                    for (f, t), (start, stop) in zip(runs, spans):
                        for k, v in (("item_id", item), ("doc_id", doc), ("h", h), ("first", f), ("last", t), ("start", start), ("stop", stop)):
                            cols[k].append(v)
            if cols:
                yield pa.record_batch({k: pa.array(v, pa.int64()) for k, v in cols.items()})

    return docs.mapInArrow(run, _RUNS)
