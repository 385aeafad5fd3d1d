"""Texts that stop before their author's ending.

Two kinds of evidence over whole texts:

* a longer copy elsewhere: the hash of a value, without blanks and marks that were put after a cut, is looked for among
  the hashes of all prefixes of all values, of whatever length. Prefix hashes come from running sums, a table of the
  hashes asked for tells which of them are worth a row, and only those meet in a join: no text is shuffled.
* the ending itself: an open code fence, link, tag, entity, code span or table; a broken character; a mark of a cut;
  a heading without a text; prose without an end of sentence. Last items of short-item lists are judged by their last
  word: what it is among the items that are followed by more text, an end or a word within.

A longer copy counts where the shorter text does not end like a closed one. In these data nearly no cut text has a
longer copy, so the second kind decides most cases.

Defined results: null and blank texts and texts of fewer than `least_words` words are no cases; a text that ends with a
full sentence, a closed fence, a table row, a closed link or tag, a symbol such as an emoji, a signature or a licence
line is none; equal texts get equal verdicts; repeated rows count once; the verdict does not depend on the source or on
other columns. An item is short with at most `SHORT_ITEM` words, an aside between dots with at most `ASIDE` characters.
Values are named by 128 bits of hash.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import Cells, cells_for, hashed_counts, mix
from spanloom.runtime import spread, stage

SHORT_ITEM = 8
ASIDE = 48
_NOTED = re.compile(r"\[[^\[\]\n]*\b(?:chars?|characters|words|clipped|truncated|cut|continued|more)\b[^\[\]\n]*\]|\((?:[^()\n]*\b)?(?:continued|truncated|clipped|cut off|more)\b[^()\n]*\)", re.I)
_MORE = re.compile(r"(?:(?:read|show|see|view) (?:more|full)|continue reading)$", re.I)
_ASIDE = re.compile(r"(?:\.\.\.|…)\s\S(?:(?![.!?]\s)[^\n]){0,%d}…$" % ASIDE)  # a short aside between the author's own dots
_CLOSERS = "\"'”’»)]*_"
_STOPS = ".!?。！？"
_ITEM = re.compile(r"^\s*(?:[-*+•]|\d+[.)])(?:\s+|$)")
_OPEN = (
    re.compile(r"!?\[[^\[\]\n]*\]\([^()\s]*$"),  # a link without its end
    re.compile(r"\[[^\[\]\n]*$"),
    re.compile(r"</?[A-Za-z][^<>]*$"),
    re.compile(r"&#?\w{0,8}$"),
)
_RULE = re.compile(r"^\s*\|[\s:|-]*-[\s:|-]*$")
_VERSION = re.compile(r"\bv\d+\.(?:\d+\.)?$")
_SHORT_FORM = re.compile(r"\b(?:e\.g|i\.e|vs|cf|z\.B|p\. ex)\.$", re.I)
_URL = re.compile(r"(?:https?://|www\.)\S+$")
_WORD = re.compile(r"\w+")
_PART = re.compile(r"[\w'’-]+")
_LETTERS = re.compile(r"[^\W\d_]{2,}")
_SIGNED = re.compile(r"^\s*(?:--|—|–)\s*\S")
_LICENCES = re.compile(r"^(?:MIT|ISC|BSD(?:-\d-Clause)?|Apache(?:-2\.0)?|GPL(?:-?v?\d)?|MPL-2\.0|Unlicense|WTFPL|CC0)(?: License)?$", re.I)


def _stem(word: str) -> str:
    """One name for the singular and the plural in -s."""
    w = word.lower()
    return w[:-1] if w.endswith("s") else w


def _enough(text: str, least: int) -> bool:
    """At least so many words; stops counting there."""
    return sum(1 for _ in zip(range(least), _WORD.finditer(text))) == least


def _without_note(e: str) -> str | None:
    """The text before a mark that was put after a cut; None if there is none. A mark is one bracket or phrase at the very end."""
    if e[-1] in "])":
        at = e.rfind("[" if e[-1] == "]" else "(")
        if at >= 0 and _NOTED.fullmatch(e, at):
            e = e[:at].rstrip()
            return e.rstrip(">").rstrip() if e.endswith(">") and e[-1:] != "]" else e
    elif e[-1] in "eElLgG":
        m = _MORE.search(e, e.rfind("\n") + 1)
        if m:
            return e[: m.start()].rstrip()
    return None


def _without_dots(e: str) -> str:
    return e[:-1].rstrip() if e.endswith("…") else e[:-3].rstrip() if e.endswith("...") else e


def bare(text: str) -> tuple[str, bool]:
    """The text without blanks and marks after a cut; whether there was a mark other than dots."""
    e = text.rstrip()
    cut = _without_note(e) if e else None
    return (e, False) if cut is None else (_without_dots(cut), True)


def value(text: str) -> str:
    """What is compared: the bare text, without the dots of a cut."""
    e = bare(text)[0]
    return e if _ASIDE.search(e, max(0, len(e) - ASIDE - 6)) else _without_dots(e)


def _full(e: str) -> bool:
    """Whether an end of sentence comes last but for closing marks."""
    while e:
        e = e.rstrip(_CLOSERS)
        if not e.endswith("\\`"):
            break
        e = e[:-2]
    return e[-1:] in _STOPS and bool(e)


def _closed_parenthesis(e: str) -> bool:
    """Whether the text ends with a closed pair of parentheses, nested twice at most, and a bracket or none."""
    i = len(e) - 1 - e.endswith("]")
    if i < 0 or e[i] != ")":
        return False
    depth, most = 0, 0
    while i >= 0:
        depth += (e[i] == ")") - (e[i] == "(")
        most = max(most, depth)
        if depth == 0:
            return most <= 2
        i = max(e.rfind("(", 0, i), e.rfind(")", 0, i))
    return False


def judge(text: str | None, least_words: int = 4) -> tuple[str, str | None, bool]:
    """(verdict, word, closed): whole, cut, or item / link / signed with the last word to look up; whether a longer copy is no evidence."""
    if text is None or not _enough(text, least_words):
        return "whole", None, True
    e, noted = bare(text)
    if noted or not e or e[-1] == "\ufffd":
        return "cut", None, False
    if e.endswith(("…", "...")):
        if _ASIDE.search(e, max(0, len(e) - ASIDE - 6)):
            return "whole", None, False
        e = _without_dots(e)
        return ("whole" if not e or _full(e) else "cut"), None, not e
    if "```" in e or "~~~" in e:
        if sum(x.lstrip().startswith(("```", "~~~")) for x in e.split("\n")) % 2:
            return "cut", None, False
    lines = e.split("\n")
    last = lines[-1].strip()
    if last.startswith(("```", "~~~")):
        return "whole", None, True
    if last.startswith("|"):
        k = len(lines) - 1
        while k >= 0 and lines[k].lstrip().startswith("|") and not _RULE.match(lines[k]):
            k -= 1
        if k >= 0 and _RULE.match(lines[k]):
            done = last.endswith("|") and not _RULE.match(last)
            return ("whole" if done else "cut"), None, done
    full = _full(e)
    if re.match(r"^#{1,6}(\s|$)", last) and not full or (len(lines) > 1 and re.match(r"^(=+|-{3,})$", last)):
        return "cut", None, False
    start = len(lines) - 1
    while start > 0 and lines[start - 1].strip():
        start -= 1
    if sum(x.count("`") for x in lines[start:]) % 2 or any(p.search(last) for p in _OPEN):
        return "cut", None, False
    tail = lines[-1][-60:] if len(lines[-1]) > 60 else lines[-1]  # the short forms below are no longer than that
    if _VERSION.search(last.rsplit(None, 1)[-1] if last else "") or _SHORT_FORM.search(tail):
        return "cut", None, False
    if full:
        return "whole", None, True
    if _SIGNED.match(last):
        return "signed", e.split()[-1].lower(), False
    kind = unicodedata.category(e[-1])
    if e[-1] == ">" and re.fullmatch(r"</?[A-Za-z][^<>]*>", e[max(0, e.rfind("<")) :]):
        return "whole", None, True
    if kind in ("So", "Sk", "Mn", "Cf", "Co", "Cn") and e[-1] not in "\u200b\u00ad":
        return "whole", None, False
    if e[-1] in ")]" and _closed_parenthesis(e):
        return "whole", None, True
    if e[-1] in ",;:-=({[<@/_&*#+|\\" or e[-1] in "'\"":
        return "cut", None, False
    link = _URL.search(last)
    if link:
        return "link", link.group().lower(), False
    if _LICENCES.match(last):
        return "whole", None, False
    word = _PART.findall(last)[-1:] or [""]
    if _ITEM.match(last):
        before = [x for x in lines[start:-1] if _ITEM.match(x)]
        if before and _full(before[-1].rstrip()) or len(last.split()) > SHORT_ITEM:
            return "cut", None, False
        return "item", _stem(word[0]), False
    return "cut", None, False


def ending(text: str | None, least_words: int = 4) -> tuple[str, str | None]:
    """(verdict, word) of judge()."""
    return judge(text, least_words)[:2]


def inner_ends(heads: list[str]) -> Counter:
    """Counts of (kind, word) in texts without their last lines: item, what ends list items; within, the other words of
    these; link, each word once."""
    out: Counter = Counter()
    out.update(dict.fromkeys((("link", w) for w in set(_LETTERS.findall("\n".join(heads).lower()))), 1))
    for head in heads:
        for x in head.split("\n"):
            if _ITEM.match(x) and len(x.split()) <= SHORT_ITEM and not _full(x.rstrip()):
                w = _PART.findall(x)
                if w:
                    out["item", _stem(w[-1])] += 1
                    out.update(("within", _stem(y)) for y in w[:-1])
    return out


_BASES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def _prefix_hashes(values: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(h, g, n): for each character of the values two hashes of all up to it, from running sums, and their number."""
    size = np.array([len(v) for v in values], np.int64)
    total = int(size.sum())
    if not total:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    code = np.frombuffer("".join(values).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    first = np.repeat(np.cumsum(size) - size, size)
    n = np.arange(total) - first + 1
    out = []
    for base in _BASES:
        # Each character by its place, mixed; the sum of a value's characters so far.
        s = np.cumsum(mix(code * base + n.astype(np.uint64), 11))
        before = np.concatenate((np.zeros(1, np.uint64), s))[first]
        out.append(mix(s - before + n.astype(np.uint64), 12))
    return out[0], out[1], n


def _scan(docs: DataFrame, least_words: int) -> DataFrame:
    """A row for each document with its verdict and, where a longer copy would count, the hashes of its value; rows
    without a doc_id for what list items and words are elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 2048):
                c = b.slice(s, 2048)
                texts = c.column("text").to_pylist()
                judged = [judge(t, least_words) for t in texts]
                asked = [i for i, (_, _, closed) in enumerate(judged) if not closed]
                h, g = [None] * len(texts), [None] * len(texts)
                values = [value(texts[i]) for i in asked]
                hs, gs, _ = _prefix_hashes(values)
                end = np.cumsum([len(v) for v in values]) - 1 if values else []
                for i, e, v in zip(asked, end, values):
                    if v:
                        h[i], g[i] = int(hs[e].view(np.int64)), int(gs[e].view(np.int64))
                inner = inner_ends([t.rstrip().rpartition("\n")[0] for t in texts if t])
                more = len(inner)
                yield pa.record_batch({
                    "doc_id": pa.array(c.column("doc_id").to_pylist() + [None] * more, pa.int64()),
                    "verdict": pa.array([v if w is None else "look up" for v, w, _ in judged] + [None] * more, pa.string()),
                    "kind": pa.array([None if w is None else v for v, w, _ in judged] + [k for k, _ in inner], pa.string()),
                    "word": pa.array([w for _, w, _ in judged] + [w for _, w in inner], pa.string()),
                    "n": pa.array([1] * len(texts) + list(inner.values()), pa.int64()),
                    "h": pa.array(h + [None] * more, pa.int64()), "g": pa.array(g + [None] * more, pa.int64()),
                })

    return docs.mapInArrow(run, "doc_id long, verdict string, kind string, word string, n long, h long, g long")


def _hits(docs: DataFrame, asked, of=value) -> DataFrame:
    """docs(text) -> (h, g): the hashes of strict prefixes of their values, those whose cell of the table is taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: Cells = asked.value
        for b in batches:
            for s in range(0, b.num_rows, 512):
                values = [of(t) for t in b.column("text").slice(s, 512).to_pylist()]
                size = np.array([len(v) for v in values])
                h, g, n = _prefix_hashes(values)
                on = np.flatnonzero((cells.of(h) > 0) & (n < np.repeat(size, size)))
                if len(on):
                    both = np.unique(np.stack((h[on], g[on]), 1), axis=0).view(np.int64)
                    yield pa.record_batch({"h": pa.array(both[:, 0]), "g": pa.array(both[:, 1])})

    return docs.mapInArrow(run, "h long, g long").distinct()


def _strict_prefixes(documents: DataFrame, hashed: DataFrame, of=value) -> DataFrame:
    """The rows of hashed(.., h, g) that are strict prefixes of the value of one of documents(text). hashed is read twice: pass a written table."""
    keys = lambda b: b.column("h").to_numpy().view(np.uint64)
    cells = hashed.sparkSession.sparkContext.broadcast(hashed_counts(hashed.select("h"), keys, cells_for(8 * hashed.count())))
    return hashed.join(_hits(documents.select("text"), cells, of), ["h", "g"], "left_semi")


def prefixes(values: DataFrame) -> DataFrame:
    """values(value) -> (value): the distinct ones that are strict prefixes of another one, taken as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = [x for x in b.column("value").to_pylist() if x]
            h, g, _ = _prefix_hashes(v)
            end = np.cumsum([len(x) for x in v]).astype(np.int64) - 1
            yield pa.record_batch({"value": pa.array(v, pa.string()), "h": pa.array(h[end].view(np.int64)), "g": pa.array(g[end].view(np.int64))})

    hashed = stage(values.where("value is not null").distinct().mapInArrow(run, "value string, h long, g long"), "values")
    return _strict_prefixes(hashed.select(F.col("value").alias("text")), hashed, lambda x: x).select("value")


def truncated(documents: DataFrame, least_words: int = 4, rare_share: float = 0.02, end_share: float = 0.1) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, reason): ending | longer copy, one row a truncated document."""
    docs = spread(documents.where("doc_id is not null and text is not null").select("doc_id", "text"))
    scan = stage(_scan(docs, least_words), "endings")
    inner = scan.where("doc_id is null").withColumn("end", F.when(F.col("kind") == "within", 0).otherwise(F.col("n")))
    known = inner.groupBy(F.when(F.col("kind") == "within", "item").otherwise(F.col("kind")).alias("kind"), "word").agg(F.sum("end").alias("ends"), F.sum("n").alias("seen"))
    # Signatures and closing links are judged by how many last lines end alike, links also by their depth: a cut leaves a rare ending.
    verdicts = scan.where("doc_id is not null").drop("n").distinct()
    looked = verdicts.where("verdict = 'look up'").withColumn("depth", F.when(F.col("kind") == "link", F.size(F.split("word", "/"))).otherwise(0))
    shape = looked.groupBy("kind", "depth").agg(F.count("*").alias("deep"))
    looked = looked.withColumn("word", F.when(F.col("kind") == "link", F.regexp_extract("word", r"([^/]*)/?$", 1)).otherwise(F.col("word")))
    alike = looked.groupBy("kind", "word").agg(F.count("*").alias("alike"))
    whole_kind = looked.groupBy("kind").agg(F.count("*").alias("all"))
    judged = looked.join(known, ["kind", "word"], "left").join(alike, ["kind", "word"]).join(F.broadcast(whole_kind), "kind").join(shape, ["kind", "depth"])
    ended = (
        F.when(F.col("kind") == "item", F.coalesce((F.col("ends") > 0) & (F.col("ends") >= end_share * F.col("seen")), F.lit(False)))
        .when(F.col("kind") == "signed", F.col("alike") >= rare_share * F.col("all"))
        .otherwise(F.col("seen").isNotNull() & (F.col("deep") >= rare_share * F.col("all")))
    )
    by_end = verdicts.where("verdict = 'cut'").select("doc_id").unionByName(judged.where(~ended).select("doc_id")).withColumn("reason", F.lit("ending"))
    by_copy = _strict_prefixes(docs, scan.where("h is not null").select("doc_id", "h", "g")).select("doc_id", F.lit("longer copy").alias("reason"))
    return by_end.unionByName(by_copy).groupBy("doc_id").agg(F.max("reason").alias("reason"))


def report(documents: DataFrame, found: DataFrame) -> DataFrame:
    """Per source (trimmed, lower-cased, null kept): documents, truncated ones and their share."""
    src = F.regexp_replace(F.lower("source"), r"^\s+|\s+$", "")
    d = documents.select("doc_id", src.alias("source")).join(found.select("doc_id", F.lit(1).alias("hit")), "doc_id", "left")
    out = d.groupBy("source").agg(F.count("*").alias("documents"), F.count("hit").alias("truncated"))
    return out.withColumn("share", F.col("truncated") / F.col("documents"))
