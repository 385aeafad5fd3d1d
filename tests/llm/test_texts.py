"""Leaks, mixes and truncation."""

import random
import re

import pytest
from pyspark.sql import functions as F

from spanloom.llm import leakage as L, mixing as M, truncation as T


def word_list(t):
    return [x for x in re.split("[^a-z0-9]+", (t or "").lower()) if x]


def test_leaks_against_brute_force(spark):
    rnd = random.Random(1)
    vocab = [f"t{i}" for i in range(300)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([5, 10, 25])))) for i in range(20)] + [(90, None), (91, "")]
    items.append((92, items[2][1]))
    docs = []
    for i in range(120):
        w = [rnd.choice(vocab) for _ in range(rnd.randrange(0, 60))]
        if i % 3 == 0:
            x = word_list(items[rnd.randrange(20)][1])
            a = rnd.randrange(0, 8)
            w[5:5] = x[a : a + rnd.choice([9, 10, 14])]
        docs.append((i, rnd.choice([" ", ", ", "\n— "]).join(w).upper(), "x"))
    docs += [(500, None, None), (501, "", None), (502, "İİ " + " ".join(word_list(items[1][1])) if len(word_list(items[1][1])) >= 10 else "İ", None)]
    want = set()
    for i, q in items:
        x = word_list(q)
        grams = {tuple(x[k : k + 10]) for k in range(len(x) - 9)}
        for d, t, _ in docs:
            y = word_list(t)
            if any(tuple(y[k : k + 10]) in grams for k in range(len(y) - 9)):
                want.add((i, d))
    ddf = spark.createDataFrame(docs + docs[:5], "doc_id long, text string, item_id string")
    idf = spark.createDataFrame(items, "item_id long, text string")
    rows = [sorted(tuple(r) for r in L.leaks(ddf, idf, 10, most).collect()) for most in (500_000, 7, 1)]
    assert {r[:2] for r in rows[0]} == want and len(rows[0]) == len(want)
    assert rows[0] == rows[1] == rows[2]
    text, item = {d: t for d, t, _ in docs}, dict(items)
    for i, d, passages, words, start, stop in rows[0]:
        x, y = word_list(item[i]), word_list(text[d])
        grams = {tuple(x[k : k + 10]) for k in range(len(x) - 9)}
        at = [k for k in range(len(y) - 9) if tuple(y[k : k + 10]) in grams]
        runs = [[at[0], at[0]]]
        for k in at[1:]:
            if k == runs[-1][1] + 1:
                runs[-1][1] = k
            else:
                runs.append([k, k])
        assert passages == len(runs) and words == max(b - a for a, b in runs) + 10
        part = word_list(text[d][start:stop])
        assert len(part) == words and " ".join(part) in " ".join(y)


def test_leaks_of_a_long_item_and_repeated_rows(spark):
    w = [f"x{i}" for i in range(40)]
    items = spark.createDataFrame([(1, " ".join(w))], "item_id long, text string")
    docs = [(1, "begin " + " ".join(w) + " end", 1), (1, "begin " + " ".join(w) + " end", 2), (2, " ".join(w[:12] + ["and"] + w[20:35]), 1), (3, "İ " + " ".join(w[:10]), 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, h int")
    for most in (50_000, 7, 1):
        got = {r["doc_id"]: tuple(r)[2:] for r in L.leaks(df, items, 10, most).collect()}
        assert got == {1: (1, 40, 6, 6 + len(" ".join(w))), 2: (2, 15, len(" ".join(w[:12])) + 5, len(docs[2][1])), 3: (1, 10, 2, len(docs[3][1]))}


def test_leaks_of_nothing(spark):
    e = spark.createDataFrame([], "item_id long, text string")
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert L.leaks(d, e).count() == 0
    assert L.leaks(d.where("false"), e).count() == 0


DOCS = "doc_id long, source string, size long, weight double"
TGT = "source string, target_share double, max_repeats int"


def test_mix(spark):
    docs = [(i, " A ", 10, 1.0) for i in range(400)] + [(1000 + i, "b", 7, None) for i in range(30)] + [(2000 + i, "c", 5, float("nan")) for i in range(200)] + [(3000, None, 50, 1.0), (3001, "other", 900, 1.0)]
    m = M.mix(spark.createDataFrame(docs + docs[:3], DOCS), spark.createDataFrame([("a", 0.3, 1), ("B", 0.3, 4), ("c", 0.3, 4), ("none", 0.1, 9)], TGT))
    total = 4000 + 210 + 1000 + 50 + 900
    r = {x["source"]: x for x in m.report().collect()}
    assert {k: x["short"] for k, x in r.items()} == {"a": False, "B": True, "c": False, "none": True}
    assert r["B"]["used"] == 840 and r["none"]["used"] == 0
    for k in ("a", "c"):
        assert 0 <= int(0.3 * total) - r[k]["used"] < 10
    assert abs(sum(x["actual_share"] for x in r.values()) - 1) < 1e-9
    s = m.selection().collect()
    size = {d: z for d, _, z, _ in docs}
    used = {}
    for x in s:
        used[x["source"]] = used.get(x["source"], 0) + size[x["doc_id"]] * x["repeats"]
    assert used == {k: x["used"] for k, x in r.items() if x["used"]}
    assert max(x["repeats"] for x in s if x["source"] == "c") <= 4 and len(s) == len({x["doc_id"] for x in s})


def test_mix_prefers_heavy_documents_and_is_repeatable(spark):
    docs = [(i, "a", 1, 9.0 if i % 2 else 1.0) for i in range(2000)] + [(9999, "rest", 2000, 1.0)]
    df, t = spark.createDataFrame(docs, DOCS), spark.createDataFrame([("a", 0.1, 1)], TGT)
    one = {r["doc_id"] for r in M.mix(df, t).selection().collect()}
    assert len(one) == 400 and sum(i % 2 for i in one) > 300
    assert one == {r["doc_id"] for r in M.mix(df, t).selection().collect()}


def test_mix_of_nothing(spark):
    m = M.mix(spark.createDataFrame([], DOCS), spark.createDataFrame([("a", 1.0, 2)], TGT))
    assert m.report().first()["used"] == 0 and m.selection().count() == 0


def test_sizes(spark):
    rows = [(" a  b\tc\n", 3), ("a\u00a0b\u2003c\u200bd", 3), ("", 0), (None, None), ("x", 1)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x, _ in rows], "t string").select(M.white_space_size(F.col("t"))).collect()]
    assert [g if g != -1 else None for g in got] == [n for _, n in rows]
    d = spark.createDataFrame([(1, "hello world"), (2, None), (3, "<|endoftext|>")], "doc_id long, text string")
    n = {r["doc_id"]: r["size"] for r in M.token_sizes(d, "/opt/tokenizers/byte_bpe_50k.json").collect()}
    assert n[1] == 2 and n[2] == 0 and n[3] > 1


P = "The first sentence ends here. "
WHOLE = [
    P + "So does this one.", P + 'He said "yes."', P + "Done! 🎉", P + "\n\n- red apples\n- green pears", P + "\n\n```js\nx = 1\n```", P + "\n\n| a | b |\n|---|---|\n| 1 | 2 |",
    P + "See [docs](https://x.y/z).", P + "(see [notes](https://x.y/z))", P + "\n\n## License\n\nMIT", "<p>" + P + "</p>", P + "... and that is all for 1.2.3…", "n/a", "", None, "   ",
    "One of the latest is v1.2.3.", P + "Is it so?  \n\n",
]
CUT = [
    P + "The second one sto", P + "The second one stops in the", P + "The second one is,", P + "The sec�", P + "The seco [+123 chars]", P + "The seco... [message clipped]", P + "The sec...\n\nRead more",
    P + "The se >>> (continued)", P + "The second o…", P + "\n\n```js\nconst x = ", P + "\n\n| a | b |\n|---|-", P + "\n\n## Head", P + "See [docs](https://x.y/z", P + "See <a href=\"https://x", P + "Call `fooBa", P + "a &am",
    P + "Since v1.2.", P + "\n\n- Every item that is a long sentence and stops in its mid",
]


@pytest.mark.parametrize("t", WHOLE)
def test_whole_endings(t):
    assert T.ending(t)[0] in ("whole", "item")


@pytest.mark.parametrize("t", CUT)
def test_cut_endings(t):
    assert T.ending(t)[0] == "cut"


def test_truncated_documents(spark):
    texts = WHOLE + CUT + [P + "\n\n- red app\n", P + "\n\n* red apples\n* green pears\n\nMore text.", P * 2000 + "The en"]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)] + [(0, texts[0], None)], "doc_id long, text string, source string")
    got = {r["doc_id"] for r in T.truncated(df).collect()}
    n = len(WHOLE) + len(CUT)
    assert got == set(range(len(WHOLE), n)) | {n, n + 2}
    r = T.report(df.where("doc_id is not null"), T.truncated(df)).first()
    assert r["truncated"] == len(got)
    assert T.truncated(df.where("false")).count() == 0


def test_prefixes_across_partitions(spark):
    rnd = random.Random(2)
    base = ["".join(rnd.choice("ab") for _ in range(60)) for _ in range(200)]
    values = base + [b[: rnd.randrange(24, 60)] for b in base[:80]] + base[:10] + ["short"]
    got = {r["value"] for r in T.prefixes(spark.createDataFrame([(v,) for v in values], "value string")).collect()}
    assert got == {v for v in values if len(v) >= 24 and any(w != v and w.startswith(v) for w in values)}
