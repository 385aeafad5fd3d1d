"""Typed graphs as edge tables: build, ids, statistics, neighbourhoods, recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.order import keep_first, positions
from spanloom.runtime import stage

# The ids of the twelve edge kinds.
KINDS = ["BelongToUser", "HasDependence", "HasDevDependence", "HasTopic", "HasKeyword", "SameToNE", "RelateToNE0", "RelateToNE1", "RelateToNE2", "RelateToNE3", "RelateToNE4", "RelateToNE5"]
RELATION_ID = {k: i for i, k in enumerate(KINDS)}


def kind_id(kind: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in RELATION_ID.items() for x in kv)), kind)


def package_edges(records: DataFrame, owners: DataFrame) -> DataFrame:
    """Edges of package records, one per (src, dst), the first kind by (record, kind, position) kept.

    records(id, key, user, deps, dev_deps, topics, keywords), owners(name, key): package name -> repository key.
    """
    src = F.concat(F.lit("$LIB"), "key")
    base = records.where("key is not null")

    def listed(column: str, kind: str, prefix: str) -> DataFrame:
        x = base.select("id", src.alias("src"), F.posexplode(column).alias("at", "item")).where("item is not null")
        return x.select("id", "src", F.concat(F.lit(prefix), F.lower("item")).alias("dst"), F.lit(kind).alias("kind"), "at")

    def depends(column: str, kind: str) -> DataFrame:
        x = base.select("id", src.alias("src"), F.posexplode(column).alias("at", "name")).where("name is not null")
        x = x.join(owners.select("name", F.col("key").alias("owner")), "name", "left")
        return x.select("id", "src", F.concat(F.lit("$LIB"), F.coalesce("owner", "name")).alias("dst"), F.lit(kind).alias("kind"), "at")

    edges = base.where("user is not null").select("id", src.alias("src"), F.concat(F.lit("$USER"), "user").alias("dst"), F.lit(KINDS[0]).alias("kind"), F.lit(0).alias("at"))
    for part in (depends("deps", KINDS[1]), depends("dev_deps", KINDS[2]), listed("topics", KINDS[3], "$TOPIC"), listed("keywords", KINDS[4], "$KEYWORD")):
        edges = edges.unionByName(part)
    edges = edges.withColumn("kind_id", kind_id(F.col("kind")))
    return keep_first(edges, ["src", "dst"], ["id", "kind_id", "at"]).select("src", "dst", "kind")


def entity_edges(found: DataFrame) -> DataFrame:
    """found(key, ne, canon, cat, canon_cat) -> SameToNE from an entity to its canonical form, RelateToNE from libraries to entities."""
    ne = lambda c, k: F.concat(F.lit("$NE"), F.col(k).cast("string"), F.col(c))
    same = found.where("ne <> canon").select(ne("ne", "cat").alias("src"), ne("canon", "canon_cat").alias("dst"), F.lit("SameToNE").alias("kind"))
    rel = found.where("key is not null").select(F.concat(F.lit("$LIB"), "key").alias("src"), ne("ne", "cat").alias("dst"), F.concat(F.lit("RelateToNE"), F.col("cat").cast("string")).alias("kind"))
    return same.unionByName(rel).distinct()


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("name")).union(edges.select("dst")).distinct()


def triples(edges: DataFrame) -> DataFrame:
    """(h, t, r): ids of nodes in order of name, ids of kinds fixed."""
    ids = positions(nodes(edges), ["name"], "id")
    e = edges.join(ids.select(F.col("name").alias("src"), F.col("id").alias("h")), "src").join(ids.select(F.col("name").alias("dst"), F.col("id").alias("t")), "dst")
    return e.select("h", "t", kind_id(F.col("kind")).alias("r"))


def ego(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """Edges within `hops` of the seeds(name), in either direction."""
    near = seeds.select("name").distinct()
    both = edges.select(F.col("src").alias("name"), F.col("dst").alias("other")).union(edges.select("dst", "src"))
    for _ in range(hops - 1):
        near = near.union(both.join(near, "name", "left_semi").select(F.col("other").alias("name"))).distinct()
    out = edges.join(near.withColumnRenamed("name", "src"), "src", "left_semi")
    return out.unionByName(edges.join(near.withColumnRenamed("name", "dst"), "dst", "left_semi")).distinct()


def mapping_stats(t: DataFrame) -> DataFrame:
    """Per relation over distinct triples: frequency, tails per head, heads per tail."""
    return t.where("r is not null").select("h", "t", "r").distinct().groupBy("r").agg(
        F.count("*").alias("freq"), (F.count("*") / F.count_distinct("h")).alias("tph"), (F.count("*") / F.count_distinct("t")).alias("hpt")
    )


def relation_class(t: DataFrame, cut: float = 1.5) -> DataFrame:
    """Per relation over all rows, repeated ones kept: means and the class 1-1, 1-n, n-1 or n-n."""
    m = t.where("r is not null").groupBy("r").agg((F.count("*") / F.count_distinct("h")).alias("tails"), (F.count("*") / F.count_distinct("t")).alias("heads"))
    side = lambda c: F.when(F.col(c) < cut, "1").otherwise("n")
    return m.withColumn("cls", F.concat(side("heads"), F.lit("-"), side("tails")))


def type_constraint(t: DataFrame) -> DataFrame:
    """(r, side, ent): what occurs as head or tail of a relation."""
    r = t.where("r is not null")
    return r.select("r", F.lit("head").alias("side"), F.col("h").alias("ent")).union(r.select("r", F.lit("tail"), "t")).distinct()


def csr(t: DataFrame) -> DataFrame:
    """(h, lef, rig): first and last place of each head in the sorted distinct triples."""
    p = positions(t.where("r is not null").select("h", "r", "t").distinct(), ["h", "r", "t"])
    return p.groupBy("h").agg(F.min("pos").alias("lef"), F.max("pos").alias("rig"))


def undirected(links: DataFrame) -> DataFrame:
    """The simple graph of a bag of links in both directions."""
    return links.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct()




def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links(a, b) of comparable ids -> (node, root): the smallest id of each node's connected component.

    Alternates large-star and small-star steps: every node hands its larger (then its smaller) neighbours to its
    smallest one. A step is an aggregate and a join on the node; each round is written, so plans stay short and no
    component is gathered anywhere. Nodes without a link to another node do not come out.
    """
    e = stage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    for _ in range(max_rounds):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = stage(large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "large")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = stage(small.where("u <> v").distinct(), "small")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.union(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        before = now
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
