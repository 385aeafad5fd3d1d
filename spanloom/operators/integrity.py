"""References to records that do not exist, as of the time of the referring record.

Direct orphans come from an interval join: for every referenced name, presence over time is reduced to
intervals (removals are counted within days, then over days), and a reference falls into at most one interval. Inherited orphans come from a fixpoint of semi-joins down the reference graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from spanloom.runtime import stage


def norm_name(c: Column) -> Column:
    """Trimmed (any white space) and lower-cased; empty becomes null."""
    t = F.regexp_replace(F.lower(c), r"^\s+|\s+$", "")
    return F.when(t != "", t)


def references(records: DataFrame, id_col: str, time_col: str, map_col: str) -> DataFrame:
    """(id, at, dependency): the distinct normalised keys of a map column. Null maps and blank keys give no row."""
    keys = records.select(F.col(id_col).alias("id"), F.col(time_col).alias("at"), F.explode(F.map_keys(map_col)).alias("k"))
    return keys.select("id", "at", norm_name(F.col("k")).alias("dependency")).where("dependency is not null").distinct()


def presence(parents: DataFrame, removals: DataFrame) -> DataFrame:
    """Intervals of each name: (name, start, stop, state), state in deleted | present, plus first_seen / last_seen.

    parents(name, at), removals(name, at); names normalised. A creation at the instant of a removal loses.
    Rows with a null name or time do not count. A name has at most 2 x its distinct removals + 1 intervals.
    """
    p = parents.where("name is not null and at is not null").select("name", "at", F.lit(0).alias("gone")).distinct()
    r = removals.where("name is not null and at is not null").select("name", "at", F.lit(1).alias("gone")).distinct()
    # era: the removals of the name before a creation (one at the same instant comes after it), or up to and with a
    # removal. Counted within days, then over the days of a name, so that no name's rows are sorted or held in one task.
    ev = p.unionByName(r).withColumn("day", F.to_date("at"))
    inside = F.sum("gone").over(W.partitionBy("name", "day").orderBy("at", "gone").rowsBetween(W.unboundedPreceding, 0))
    days = ev.groupBy("name", "day").agg(F.sum("gone").alias("n"))
    days = days.select("name", "day", F.coalesce(F.sum("n").over(W.partitionBy("name").orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ev = stage(ev.withColumn("inside", inside).join(days, ["name", "day"]).select("name", "at", "gone", (F.col("before") + F.col("inside")).cast("int").alias("era")), "events")
    step = ev.where("gone = 0").groupBy("name", "era").agg(F.min("at").alias("born"))
    cut = ev.where("gone = 1").select("name", "era", F.col("at").alias("since"))
    start = cut.unionByName(p.select("name", F.lit(0).alias("era"), F.lit(None).cast(cut.schema["since"].dataType).alias("since")).distinct())
    j = start.join(cut.select("name", (F.col("era") - 1).alias("era"), F.col("since").alias("until")), ["name", "era"], "left").join(step, ["name", "era"], "left")
    gone = j.where("era > 0").select("name", F.col("since").alias("start"), F.least("born", "until").alias("stop"), F.lit("deleted").alias("state"))
    # A creation at the very instant of the next removal never stands.
    here = j.where("born is not null and (until is null or born < until)").select("name", F.col("born").alias("start"), F.col("until").alias("stop"), F.lit("present").alias("state"))
    return gone.where("stop is null or start < stop").unionByName(here)


def orphan_references(refs: DataFrame, parents: DataFrame, removals: DataFrame) -> DataFrame:
    """refs(id, at, dependency) that no parent answers at that time, with kind deleted | late | missing.

    deleted: the name had been removed by then; late: it is created after that; missing: neither.
    Null times in refs cannot be placed and give no row; repeated refs give one row; empty tables give none.
    The interval side of the join has a few rows a name, so a name that a third of all rows refer to is skewed
    on the side that adaptive execution splits.
    """
    r = refs.where("at is not null and dependency is not null").select("id", "at", "dependency").distinct()
    span = presence(parents, removals)
    seen = parents.where("name is not null and at is not null").groupBy(F.col("name").alias("dependency")).agg(F.max("at").alias("last_seen"))
    gone = span.where("state = 'deleted'").select(F.col("name").alias("dependency"), "start", "stop")
    bad = r.join(gone, "dependency").where("at >= start and (stop is null or at < stop)").select("id", "dependency", F.lit("deleted").alias("kind"))
    # Before the first event of the name, or a name without any.
    first = span.groupBy(F.col("name").alias("dependency")).agg(F.min("start").alias("first_event")).join(seen, "dependency", "left")
    early = (
        r.join(first, "dependency", "left").where("first_event is null or at < first_event")
        .select("id", "dependency", F.when(F.col("last_seen").isNotNull(), "late").otherwise("missing").alias("kind"))
    )
    return bad.unionByName(early).distinct()


def orphan_cascade(refs: DataFrame, records: DataFrame, direct: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(id, level): records with an orphan reference (level 0) and those that inherit one (level = hops).

    records(id, name, at). A name is orphaned when its latest record (by at, then id) is; a record that refers to
    an orphaned name inherits. Each round semi-joins the references with the names found in the round before
    only, and writes its frontier, so a cycle ends and the plan stays short. Null names have no children.
    """
    latest = records.where("name is not null").groupBy("name").agg(F.max_by("id", F.struct("at", "id")).alias("id"))
    latest, edges = stage(latest, "latest"), stage(refs.select("id", "dependency").distinct(), "refs")
    done = stage(direct.select("id").distinct().withColumn("level", F.lit(0)), "orphans")
    frontier = done
    for level in range(1, max_rounds + 1):
        names = latest.join(frontier.select("id"), "id", "left_semi").select(F.col("name").alias("dependency"))
        fresh = edges.join(names, "dependency", "left_semi").select("id").distinct().join(done.select("id"), "id", "left_anti")
        frontier = stage(fresh.withColumn("level", F.lit(level)), "orphans")
        if frontier.isEmpty():
            return done
        done = done.unionByName(frontier)
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")


def orphans(refs: DataFrame, records: DataFrame, removals: DataFrame) -> DataFrame:
    """refs(id, at, dependency), records(id, name, at), removals(name, at) -> (id, dependency, kind, level): every orphan reference.

    Level 0 are the direct ones with their kind; the cascade adds, with kind inherited, references to names that are
    themselves orphaned, directly or not, at the level of the name's latest record plus one. Empty tables give no rows.
    """
    refs, records = stage(refs, "refs"), stage(records, "records")
    direct = stage(orphan_references(refs, records.select("name", "at"), removals), "direct")
    levels = orphan_cascade(refs, records, direct)
    latest = records.where("name is not null").groupBy("name").agg(F.max_by("id", F.struct("at", "id")).alias("id"))
    names = latest.join(levels, "id").select(F.col("name").alias("dependency"), (F.col("level") + 1).alias("level"))
    more = refs.select("id", "dependency").distinct().join(names, "dependency").join(direct.select("id", "dependency"), ["id", "dependency"], "left_anti")
    return direct.withColumn("level", F.lit(0)).unionByName(more.select("id", "dependency", F.lit("inherited").alias("kind"), "level"))


def orphan_report(refs: DataFrame, records: DataFrame, direct: DataFrame, levels: DataFrame) -> DataFrame:
    """Counts per month of the referring record: references and orphan references by kind, records direct and inherited."""
    month = F.date_format("at", "yyyy-MM")
    base = refs.groupBy(month.alias("month")).agg(F.count("*").alias("refs"))
    kinds = (
        direct.join(records.select("id", "at"), "id").groupBy(month.alias("month"))
        .agg(*(F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in ("deleted", "late", "missing")))
    )
    recs = (
        levels.join(records.select("id", "at"), "id").groupBy(month.alias("month"))
        .agg(F.count(F.when(F.col("level") == 0, 1)).alias("direct_records"), F.count(F.when(F.col("level") > 0, 1)).alias("inherited_records"))
    )
    out = base.join(kinds, "month", "full").join(recs, "month", "full")
    return out.select(F.lit("repositories").alias("table_name"), "month", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("refs", "deleted", "late", "missing", "direct_records", "inherited_records")))
