import json
import struct

import pytest
from pyspark.sql import functions as F

from spanloom import runtime, service
from spanloom.sources import readers as S
from spanloom.streaming import scoring


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_repositories_and_pass_through(spark, tmp_path):
    lines = ['{"name":"a","git_stars":12,"npm_dependencies":{"x":"1"},"extra":1}', '{"name":"b","git_stars":3}', "broken"]
    (tmp_path / "r.json").write_text("\n".join(lines))
    df = S.read_repositories(spark, str(tmp_path / "r.json"))
    assert [(r["name"], r["git_topics"], r["npm_dependencies"]) for r in df.orderBy("name").collect()] == [("a", None, {"x": "1"}), ("b", None, None)]
    S.pass_lines(spark, str(tmp_path / "r.json"), str(tmp_path / "out"), F.col("r.git_stars") >= 10)
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == lines[:1]


def test_readmes(spark, tmp_path):
    (tmp_path / "a#b.md").write_text("# T\n\nx\ty")
    assert rows(S.read_readmes(spark, str(tmp_path))) == [("a#b", "# T\n\nx\ty")]


def test_cells(spark, tmp_path):
    df = spark.createDataFrame([("f\t1", ["a\tb", "é"], 3), (None, [], None)], "f string, t array<string>, n long")
    S.write_cells(df, ["f", "t", "n"], str(tmp_path / "c"))
    got = S.read_cells(spark, str(tmp_path / "c"), "f string, t array<string>, n long").collect()
    assert sorted((r["f"], tuple(r["t"]), r["n"]) for r in got) == [("", (), None), ("f 1", ("a\tb", "é"), 3)]
    (tmp_path / "d").write_text("x\t[broken\t1\nshort\n")
    assert [tuple(r) for r in S.read_cells(spark, str(tmp_path / "d"), "f string, t array<string>, n long").collect()] == [("x", None, 1)]


def test_counted(spark, tmp_path):
    df = spark.createDataFrame([(3, 1), (1, 2)], "h long, t long")
    S.write_counted(df, ["h", "t"], str(tmp_path / "n"), ["h", "t"])
    assert [r["value"] for r in spark.read.text(str(tmp_path / "n")).collect()] == ["2", "1 2", "3 1"]
    assert rows(S.read_counted(spark, str(tmp_path / "n"), "h long, t long")) == [(1, 2), (3, 1)]


def test_vectors(spark, tmp_path):
    df = spark.createDataFrame([("a b", "repo", [1.5, -2.0])], "name string, type string, vec array<double>")
    S.write_node_vectors(df, str(tmp_path / "v"))
    back = S.read_node_vectors(spark, str(tmp_path / "v"))
    assert rows(back.select("name", "type")) == [("a b", "repo")] and back.first()["vec"] == [1.5, -2.0]
    assert S.bundle(back).first()["line"] == 2
    (tmp_path / "e.tsv").write_text("x\t[1.0,2.0]\ny\tbroken\n")
    assert [(r["name"], r["vec"]) for r in S.read_embeddings(spark, str(tmp_path / "e.tsv")).collect()] == [("x", [1.0, 2.0])]
    (tmp_path / "w.bin").write_bytes(b"2 2\n" + b"".join(n + b" " + struct.pack("<2f", *v) + b"\n" for n, v in ((b"p", (1, 2)), (b"q", (3, 4)))))
    assert [(r["name"], r["vec"]) for r in S.read_word_vectors(spark, str(tmp_path / "w.bin")).collect()] == [("p", [1.0, 2.0]), ("q", [3.0, 4.0])]
    dump = spark.createDataFrame([(json.dumps({"ent_embeddings.weight": [[1.0], [2.0]], "rel_embeddings.weight": [[9.0]]}),)], "json string")
    names = spark.createDataFrame([(0, "a"), (1, "b")], "id int, name string")
    assert sorted((r["name"], r["vec"]) for r in S.parameters(dump, "ent_embeddings.weight", names).collect()) == [("a", [1.0]), ("b", [2.0])]


def test_lists(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("find a\ta#b\nfind c\tc#d\nno answer\n")
    assert {(r["query"], r["answer"]) for r in S.read_samples(spark, str(tmp_path / "s.tsv")).collect()} == {("find a", "a#b"), ("find c", "c#d")}
    (tmp_path / "stop.txt").write_text("$WORDthe\n\n$WORDof\n")
    assert rows(S.read_stop_words(spark, str(tmp_path / "stop.txt"))) == [("of",), ("the",)]


def test_graph(spark, tmp_path):
    n, e = spark.createDataFrame([("a", "lib")], "name string, kind string"), spark.createDataFrame([("a", "b")], "src string, dst string")
    S.write_graph(n, e, str(tmp_path / "g"))
    assert [rows(x) for x in S.read_graph(spark, str(tmp_path / "g"))] == [[("a", "lib")], [("a", "b")]]
    (tmp_path / "g.xml").write_text('<gexf><graph><nodes><node id="0" label="x"></node><node id="1" label="y"></node></nodes><edges><edge id="0" source="0" target="1"></edge></edges></graph></gexf>')
    nodes, edges = S.read_graph_xml(spark, str(tmp_path / "g.xml"))
    assert rows(nodes) == [("0", "x"), ("1", "y")] and rows(edges) == [("0", "1")]


def test_service(spark):
    score = lambda q: q.select("item_id", F.explode(F.array(*(F.struct(F.lit(r).alias("repo"), F.lit(s).alias("score")) for r, s in (("a", 0.5), ("b", 0.9), ("c", 0.5))))).alias("x")).select("item_id", "x.*")
    q = spark.createDataFrame([(1, "x"), (2, " "), (3, None), (1, "x")], "item_id long, query string")
    assert [(r["item_id"], r["repo"]) for r in service.search(q, score, 2).orderBy("rank").collect()] == [(1, "b"), (1, "a")]
    shown = spark.createDataFrame([("a", "A"), ("b", "B")], "repo string, title string")
    assert json.loads(service.envelope(spark, "x", score, shown, 2))["success"] is True
    assert json.loads(service.envelope(spark, "x", score, shown, 3))["success"] is False
    assert json.loads(service.envelope(spark, " ", score, shown))["message"] == "empty query"


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a b"), (2, "c")], "item_id long, query string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("item_id long, query string").parquet(str(tmp_path / "in"))
    q = scoring.score_stream(stream, lambda b: b.select("item_id", F.length("query").alias("n")), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("item_id", "n")) == [(1, 3), (2, 1)]


def test_windows_of_a_stream(spark):
    e = spark.createDataFrame([("2024-01-01 00:10:00", "x"), ("2024-01-01 00:50:00", "x"), ("2024-01-01 01:00:00", "x")], "t string, k string")
    got = scoring.windowed_counts(e.select(F.to_timestamp("t").alias("t"), "k"), "t", "k")
    assert sorted(r["cnt"] for r in got.collect()) == [1, 2]


def test_stage_and_purge(spark):
    df = runtime.stage(spark.range(5).toDF("x"))
    assert df.count() == 5
    runtime.purge(spark)
    with pytest.raises(Exception):
        df.count()
