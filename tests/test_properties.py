"""Round trips over generated texts."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.functions import html, text as T
from spanloom.operators import entities as E, spans as S

FEW = settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
TEXTS = st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\x00\x01"), max_size=40), min_size=1, max_size=40)


@FEW
@given(TEXTS)
def test_split_special_loses_nothing(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    for r in df.select("t", T.split_special(F.col("t")).alias("p")).collect():
        assert "".join(r["p"]) == r["t"]
        assert all(x for x in r["p"])


@FEW
@given(TEXTS)
def test_blanks_round_trip(spark, texts):
    texts = [t.replace("%", "") for t in texts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    for r in df.select("t", T.unescape_blanks(T.escape_blanks(F.col("t"))).alias("u")).collect():
        assert r["u"] == r["t"]


@FEW
@given(st.lists(st.lists(st.tuples(st.integers(0, 5), st.integers(1, 3), st.booleans()), min_size=1, max_size=6), min_size=1, max_size=10))
def test_spans_round_trip(spark, docs):
    rows, want = [], set()
    for d, parts in enumerate(docs):
        text, pos = [], 0
        for cat, n, inside in parts:
            words = [f"w{pos + k}" for k in range(n)]
            if inside:
                text += [f"#{cat}#", *words, f"#{cat}#", "gap"]
                want.add((d, cat, pos, pos + n - 1))
                pos += n + 1
            else:
                text += words
                pos += n
        rows.append((d, " ".join(text)))
    got = S.decode(S.encode(S.marked_tokens(spark.createDataFrame(rows, "doc_id long, text string"))))
    assert {(r["doc_id"], r["cat"], r["start"], r["stop"]) for r in got.collect()} == want


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_html_never_fails(text):
    for tag, _, contents in html.sections(html.markdown_to_html(text)) + html.sections(text):
        assert tag in ("h", "h1", "h2", "h3", "h4", "h5") and contents.startswith("[")


@settings(max_examples=200, deadline=None)
@given(st.text("abc.-", max_size=12), st.text("abc.-", max_size=12))
def test_ratio_is_a_percentage(a, b):
    r = E.ratio(a, b)
    assert 0 <= r <= 100 and (r == 100) <= (len(a) == len(b))
