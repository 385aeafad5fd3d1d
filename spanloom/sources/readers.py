"""Readers and writers of the pipeline's file formats. Schemas are given, never inferred; broken cells become nulls."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as TP

from spanloom.operators.order import positions

REPOSITORY = (
    "name string, git_url string, git_stars long, git_description string, git_topics array<string>, npm_description string, "
    "npm_keywords array<string>, npm_domain array<string>, npm_dependencies map<string,string>, npm_dev_dependencies map<string,string>"
)
VECTOR_ORDER = ["user", "repo", "name", "topic", "keyword", "domain", "word"]


def read_repositories(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; missing keys are null, malformed lines are dropped."""
    return spark.read.schema(REPOSITORY).option("mode", "DROPMALFORMED").json(path)


def pass_lines(spark: SparkSession, path: str, out: str, keep: Column) -> None:
    """Write the original lines whose record (column `r`) satisfies `keep`, unchanged."""
    lines = spark.read.text(path).withColumn("r", F.from_json("value", REPOSITORY))
    lines.where(keep).select("value").write.mode("errorifexists").text(out)


def read_readmes(spark: SparkSession, folder: str) -> DataFrame:
    """(key, text): whole files, the key is the file name without .md."""
    t = spark.read.text(f"{folder}/*.md", wholetext=True)
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    return t.select(F.regexp_replace(name, r"\.md$", "").alias("key"), F.col("value").alias("text"))


def _flat(c: Column) -> Column:
    """Tabs and line ends inside a cell would break the line."""
    return F.regexp_replace(c, r"[\t\r\n]+", " ")


def write_cells(df: DataFrame, columns: list[str], path: str) -> None:
    """One line a row: plain cells for strings and numbers, JSON for arrays and maps."""
    kinds = dict(df.dtypes)
    cells = [F.to_json(c) if kinds[c].startswith(("array", "map", "struct")) else F.coalesce(_flat(F.col(c).cast("string")), F.lit("")) for c in columns]
    df.select(F.concat_ws("\t", *(F.coalesce(x, F.lit("")) for x in cells)).alias("value")).write.mode("errorifexists").text(path)


def read_cells(spark: SparkSession, path: str, schema: str, least: int | None = None) -> DataFrame:
    """The inverse: rows with fewer than `least` cells (all, by default) are dropped, broken JSON cells are null."""
    fields = TP._parse_datatype_string(schema).fields
    parts = F.split("value", "\t")
    t = spark.read.text(path).where(F.size(parts) >= (least or len(fields)))

    def cell(i: int, f: TP.StructField) -> Column:
        x = F.get(parts, F.lit(i))
        return (F.from_json(x, f.dataType) if isinstance(f.dataType, (TP.ArrayType, TP.MapType, TP.StructType)) else F.expr(f"try_cast(get(split(value, '\t'), {i}) as {f.dataType.simpleString()})")).alias(f.name)

    return t.select(*(cell(i, f) for i, f in enumerate(fields)))


def write_counted(df: DataFrame, columns: list[str], path: str, by: list[str]) -> None:
    """A file with the number of rows in its first line, then one line a row in the order of `by` (one file: a format for small tables)."""
    n = df.count()
    p = positions(df, by, "_pos").select((F.col("_pos") + 1).alias("_pos"), F.concat_ws(" ", *(F.col(c).cast("string") for c in columns)).alias("value"))
    head = df.sparkSession.createDataFrame([(0, str(n))], "_pos long, value string")
    head.unionByName(p).coalesce(1).sortWithinPartitions("_pos").select("value").write.mode("errorifexists").text(path)


def read_counted(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The inverse: lines with a single cell (the count) are dropped."""
    fields = TP._parse_datatype_string(schema).fields
    parts = F.split("value", r"\s+")
    t = spark.read.text(path).where(F.size(parts) == len(fields))
    return t.select(*(parts[i].cast(f.dataType).alias(f.name) for i, f in enumerate(fields)))


def write_node_vectors(df: DataFrame, path: str) -> None:
    """df(name, type, vec): a line `n dim`, then name, type and numbers; blanks in names become %."""
    n, dim = df.count(), df.select(F.max(F.size("vec"))).first()[0] or 0
    rows = df.select(F.concat_ws(" ", F.replace("name", F.lit(" "), F.lit("%")), "type", F.array_join(F.col("vec").cast("array<string>"), " ")).alias("value"))
    head = df.sparkSession.createDataFrame([(f"{n} {dim}",)], "value string")
    head.unionByName(rows).write.mode("errorifexists").text(path)


def read_node_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(name, type, vec); the header and short lines are dropped."""
    p = F.split("value", " ")
    t = spark.read.text(path).where(F.size(p) > 2)
    return t.select(F.replace(p[0], F.lit("%"), F.lit(" ")).alias("name"), p[1].alias("type"), F.slice(p, 3, 1_000_000).cast("array<double>").alias("vec"))


def bundle(vectors: DataFrame) -> DataFrame:
    """(line, type, name, vec): the seven kinds of vectors under the line number their readers rely on."""
    order = F.array(*map(F.lit, VECTOR_ORDER))
    return vectors.withColumn("line", F.array_position(order, F.col("type"))).where("line > 0").select("line", "type", "name", "vec")


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(name, vec) of lines `name <tab> JSON array`."""
    return read_cells(spark, path, "name string, vec array<double>").where("vec is not null")


def parameters(dump: DataFrame, key: str, names: DataFrame) -> DataFrame:
    """dump(json) of a model's parameters -> (name, vec): rows of the matrix `key` by id; names(id, name)."""
    m = dump.select(F.from_json("json", "map<string,array<array<double>>>").alias("m")).select(F.posexplode(F.element_at("m", F.lit(key))).alias("id", "vec"))
    return m.join(names, "id").select("name", "vec")


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(name, vec) of word2vec binary files: a line `n dim`, then name, blank, dim 32-bit floats, line end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column("content").to_pylist():
                end = raw.index(b"\n")
                n, dim = map(int, raw[:end].split())
                at, names, vecs = end + 1, [], []
                for _ in range(n):
                    blank = raw.index(b" ", at)
                    names.append(raw[at:blank].decode().lstrip("\n"))
                    at = blank + 1 + 4 * dim
                    vecs.append(list(struct.unpack(f"<{dim}f", raw[blank + 1 : at])))
                yield pa.record_batch({"name": pa.array(names, pa.string()), "vec": pa.array(vecs, pa.list_(pa.float64()))})

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "name string, vec array<double>")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """(item_id, query, answer): tab-separated verification samples, numbered by position."""
    t = spark.read.csv(path, sep="\t", schema="query string, answer string").where("answer is not null")
    return positions(t, ["query", "answer"], "item_id")


def read_stop_words(spark: SparkSession, path: str) -> DataFrame:
    """(word): one a line, an optional $WORD prefix off."""
    return spark.read.text(path).select(F.regexp_replace(F.trim("value"), r"^\$WORD", "").alias("word")).where("word <> ''").distinct()


def write_by_class(triples: DataFrame, classes: DataFrame, path: str) -> None:
    """Triples in one folder for each relation class; classes(r, cls)."""
    triples.join(F.broadcast(classes.select("r", F.col("cls").alias("rel_class"))), "r").write.partitionBy("rel_class").mode("errorifexists").parquet(path)


def type_constraint_lines(pairs: DataFrame) -> DataFrame:
    """pairs(r, side, ent) -> (r, side, chunk, n, entities): lists in chunks of 1000, so that a hub relation is many rows."""
    p = positions(pairs.distinct(), ["r", "side", "ent"], "pos")
    first = p.groupBy("r", "side").agg(F.min("pos").alias("first"), F.count("*").alias("n"))
    p = p.join(F.broadcast(first), ["r", "side"]).withColumn("chunk", F.floor((F.col("pos") - F.col("first")) / 1000).cast("int"))
    return p.groupBy("r", "side", "chunk").agg(F.first("n").alias("n"), F.sort_array(F.collect_list("ent")).alias("entities"))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph as two Parquet tables."""
    nodes.write.mode("errorifexists").parquet(f"{path}/nodes")
    edges.write.mode("errorifexists").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def write_graph_xml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """nodes(id, label), edges(source, target) as GEXF elements, in many files: <nodes> in path/nodes, <edges> in path/edges."""
    for df, tag in ((nodes.select(F.col("id").alias("_id"), F.col("label").alias("_label")), "node"), (edges.select(F.col("source").alias("_source"), F.col("target").alias("_target")), "edge")):
        df.write.format("xml").option("rootTag", f"{tag}s").option("rowTag", tag).mode("errorifexists").save(f"{path}/{tag}s")


def read_graph_xml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label) and edges (source, target) of a GEXF file, by Spark's XML source."""
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    n = read("node", "_id string, _label string").select(F.col("_id").alias("id"), F.col("_label").alias("label"))
    e = read("edge", "_source string, _target string").select(F.col("_source").alias("source"), F.col("_target").alias("target"))
    return n.where("id is not null"), e.where("source is not null")
