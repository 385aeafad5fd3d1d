"""Markdown to HTML and HTML to sections: the parts that have no built-in form, in Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

_HEADS = ("h1", "h2", "h3", "h4", "h5")
_VOID = {"br", "hr", "img", "input", "meta", "link", "source", "wbr"}


_INLINE = re.compile(r"`+([^`]+)`+|!\[[^\]\n]*\]\([^)\n]*\)|\[([^\]\n]*)\]\([^)\n]*\)|(\*\*|__)(?=\S)(.+?)(?<=\S)\3|(?<![\w*])\*(?=\S)([^*\n]+?)(?<=\S)\*|(?<![\w_])_(?=\S)([^_\n]+?)(?<=\S)_(?!\w)")


def _inline(x: str) -> str:
    """The text of code spans, links and emphasis; images have none."""
    return _INLINE.sub(lambda m: m[1] or m[2] or m[4] or m[5] or m[6] or "", x)


def markdown_to_html(text: str) -> str:
    """Headings, lists, paragraphs and raw HTML blocks; of inline mark-up the text stays: code, emphasis, images by nothing."""
    out, para, items = [], [], []
    plain = lambda x: escape(_inline(x), quote=False)

    def flush() -> None:
        if para:
            out.append("<p>" + plain(" ".join(para)) + "</p>")
        if items:
            out.append("<ul>" + "".join(f"<li>{plain(x)}</li>" for x in items) + "</ul>")
        para.clear()
        items.clear()

    for line in re.split(r"\r\n?|\n", text):
        head = re.match(r"^(#{1,5})\s+(.*?)\s*#*$", line)
        under = re.match(r"^(=+|-{3,})\s*$", line)
        item = re.match(r"^\s*[-*+]\s+(.*)$", line)
        if head:
            flush()
            out.append(f"<h{len(head[1])}>{plain(head[2])}</h{len(head[1])}>")
        elif under and para:
            title, level = para.pop(), 1 if line[0] == "=" else 2
            flush()
            out.append(f"<h{level}>{plain(title)}</h{level}>")
        elif item:
            if para:
                flush()
            items.append(item[1])
        elif re.match(r"^\s*</?(h[1-6]|p|ul|ol|li|div|table|a|img|center)\b", line, re.I):
            flush()
            out.append(line)
        elif line.strip():
            if items:
                flush()
            para.append(line.strip())
        else:
            flush()
    flush()
    return "\n".join(out)


class _Tree(HTMLParser):
    """Top-level elements: (tag, text, items of a list). Unclosed elements end with the text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.top: list[dict] = []
        self.open: list[str] = []

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in _VOID:
            return
        if not self.open or (self.open[-1] == "p" and tag in (*_HEADS, "p", "ul")):
            self.open = []
            self.top.append({"tag": tag, "text": "", "items": []})
        elif tag == "li":
            self.top[-1]["items"].append("")
        self.open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            del self.open[len(self.open) - 1 - self.open[::-1].index(tag) :]

    def handle_data(self, data: str) -> None:
        if not self.open:
            return
        node = self.top[-1]
        node["text"] += data
        if "li" in self.open and node["items"]:
            node["items"][-1] += data


def sections(html: str | None) -> list[tuple[str, str, str]]:
    """(tag, head, JSON list of texts and lists) of the top-level elements that follow each heading up to the next.

    A preamble with tag h comes first if an element stands before the first heading; it begins at the first paragraph,
    wherever that is. Elements that are neither text nor list are empty texts. What has no heading gives no rows.
    """
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    top = tree.top

    def content(i: int) -> list:
        out: list = []
        for n in top[i:]:
            if n["tag"] in _HEADS:
                break
            out.append(n["text"].strip() if n["tag"] in ("p", "a") else [x.strip() for x in n["items"]] if n["tag"] == "ul" else "")
        return out

    heads = [i for i, n in enumerate(top) if n["tag"] in _HEADS]
    if not heads:
        return []
    rows = [(top[i]["tag"], top[i]["text"].strip(), content(i + 1)) for i in heads]
    if heads[0] > 0:
        first = next((i for i, n in enumerate(top) if n["tag"] == "p"), None)
        rows.insert(0, ("h", "", content(first) if first is not None else []))
    return [(a, b, json.dumps(c, ensure_ascii=False)) for a, b, c in rows]


def section_rows(pages: DataFrame, markdown: bool = True) -> DataFrame:
    """pages(key STRING, text) -> (key, pos, tag, head, contents JSON). Null texts give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: dict[str, list] = {k: [] for k in ("key", "pos", "tag", "head", "contents")}
            for key, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist()):
                if text is None:
                    continue
                for i, (tag, head, contents) in enumerate(sections(markdown_to_html(text) if markdown else text)):
                    for k, v in zip(cols, (key, i, tag, head, contents)):
                        cols[k].append(v)
            yield pa.record_batch({k: pa.array(v, pa.int32() if k == "pos" else pa.string()) for k, v in cols.items()})

    return pages.select("key", "text").mapInArrow(run, "key string, pos int, tag string, head string, contents string")
