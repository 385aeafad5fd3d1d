import json

import pytest
from pyspark.sql import functions as F

from spanloom.functions import html, text as T
from spanloom.operators import entities as E, spans as S


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("url,key", [("https://github.com/a/b", "a#b"), ("https://github.com/a/b/", "b#"), (None, None)])
def test_repo_key(spark, url, key):
    assert one(spark, url, T.repo_key) == key


def test_repo_key_any(spark):
    for u in ("https://x.y/A/b", "git+https://x.y/a/B.git", "git@x.y:a/b.git/", " https://x.y/a/b "):
        assert one(spark, u, T.repo_key_any) == "a#b"


def test_markdown_cleaning(spark):
    assert one(spark, "[![b](x)](y) see [docs](http://d) ![i](z)", T.clean_markdown) == " see docs "
    assert one(spark, "a\n```js\nx\n```\nb", T.clean_markdown) == "a\n\nb"
    assert one(spark, " \n\n", T.clean_markdown) == ""


def test_splits_and_splices(spark):
    assert one(spark, "a@b", T.split_special) == ["a", "@", "b"]
    assert one(spark, "@a", T.split_special) == ["@", "a"]
    assert one(spark, "socket . io", lambda c: T.splice_entity(F.split(c, " "))) == "socket.io"
    assert one(spark, "@ angular / core", lambda c: T.splice_entity(F.split(c, " "))) == "@angular/core"
    assert one(spark, "x#[1]# y#1# z[1]", T.clean_marker) == "x y z"
    assert one(spark, "Libraries classes boxes", T.lemma_key) == "library class box"


def encode(spark, text):
    rows = S.encode(S.marked_tokens(spark.createDataFrame([(1, text)], "doc_id long, text string"))).orderBy("pos").collect()
    return [r["token"] for r in rows], [r["label"] for r in rows]


def test_encode(spark):
    assert encode(spark, "A #1# b c #1# d") == (["A", "b", "c", "d"], [18, 3, 4, 18])
    assert encode(spark, "#0# x #0#")[1] == [2]
    assert encode(spark, "#2# x y")[1] == [6, 7]
    assert encode(spark, "#2# x")[1] == [8]
    assert encode(spark, "#2# #2#") == ([], [])


def decode(spark, labels):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(labels)], "doc_id long, pos int, label int")
    return {(r["cat"], r["start"], r["stop"]) for r in S.decode(df).collect()}


def test_decode(spark):
    assert decode(spark, [18, 3, 4, 18, 2, 4, 0, 0, 5]) == {(1, 1, 2), (0, 4, 4), (0, 6, 6), (0, 7, 7), (1, 8, 8)}
    assert decode(spark, [1, 4, 18]) == set()
    assert decode(spark, [0, 1, 4]) == {(0, 0, 1)}


def test_pieces_round_trip(spark):
    e = S.encode(S.marked_tokens(spark.createDataFrame([(1, "use #3# serializeSocket now #3# or #1# x #1#")], "doc_id long, text string")))
    p = S.expand_pieces(e)
    assert {tuple(r) for r in S.project_pieces(p).collect()} == {tuple(r) for r in S.decode(e).collect()}


def test_scores(spark):
    g = spark.createDataFrame([(1, 0, 0, 1), (1, 1, 3, 3)], "doc_id long, cat int, start int, stop int")
    p = spark.createDataFrame([(1, 0, 0, 1), (1, 2, 3, 3), (2, 0, 0, 0)], "doc_id long, cat int, start int, stop int")
    r = S.scores(g, p).first()
    assert (r["gold"], r["predicted"], r["both"]) == (2, 3, 1)
    assert abs(r["f1"] - 0.4) < 1e-6


def test_html_sections():
    got = html.sections("<p>a</p><h1>T</h1><p>b</p><ul><li>x</li><li>y</li></ul><h2>U</h2>")
    assert [(a, b, json.loads(c)) for a, b, c in got] == [("h", "", ["a"]), ("h1", "T", ["b", ["x", "y"]]), ("h2", "U", [])]
    assert html.sections(None) == [] and html.sections("<h1>open") == [("h1", "open", "[]")]
    md = html.markdown_to_html("T\n===\ntext\nmore\n\n- a\n- b\n## U")
    assert [x[:2] for x in html.sections(md)] == [("h1", "T"), ("h2", "U")]


@pytest.mark.parametrize("a,b,r", [("react", "reacts", 91), ("node.js", "nodejs", 92), ("vue", "vuex", 86), ("tide", "diet", 25), ("x", "x", 100), ("", "x", 0)])
def test_ratio(a, b, r):
    assert E.ratio(a, b) == r


def test_fuzzy_match_equals_all_pairs(spark):
    import random

    rnd = random.Random(4)
    base = ["".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 12))) for _ in range(60)]
    left, right = base[:30], base[30:] + [b[:-1] + "x" for b in base[:10] if b]
    df = lambda x: spark.createDataFrame([(v,) for v in set(x)], "ne string")
    got = {r["ne"]: (r["match"], r["score"]) for r in E.fuzzy_match(df(left), df(right), 80, "ratio").collect()}
    want = {}
    for x in set(left):
        s = sorted((-E.ratio(x, y), y) for y in set(right) if E.ratio(x, y) >= 80)
        if s:
            want[x] = (s[0][1], -s[0][0])
    assert got == want


def test_category_vote_tie(spark):
    rows = spark.createDataFrame([("a", 2), ("a", 0), ("a", 2), ("a", 0)], "ne string, cat int")
    assert E.category_vote(rows).first()["cat"] == 0
