"""Query of the integrity problem (p2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import integrity as I
from spanloom.plans.registry import Registry
from spanloom.runtime import table

R = Registry()

_BASE = """
rec as (select distinct repo_id, crawled_at, nullif(trim(lower(name)), '') as name, npm_dependencies from repositories),
refs as (select distinct repo_id, crawled_at, dependency from (
    select repo_id, crawled_at, nullif(trim(lower(unnest(map_keys(npm_dependencies)))), '') as dependency from rec) where dependency is not null),
born as (select distinct name, crawled_at as c from rec where name is not null),
gone as (select distinct nullif(trim(lower(name)), '') as name, removed_at as r from removed_packages where removed_at is not null),
c as (select repo_id, dependency, max(c) as c from refs join born on name = dependency and c <= crawled_at group by all),
r as (select repo_id, dependency, max(r) as r from refs join gone on name = dependency and r <= crawled_at group by all),
later as (select distinct repo_id, dependency from refs join born on name = dependency and c > crawled_at),
direct as (select f.repo_id, f.dependency, case when r.r is not null then 'deleted' when l.repo_id is not null then 'late' else 'missing' end as kind
    from refs f left join c on c.repo_id = f.repo_id and c.dependency = f.dependency
    left join r on r.repo_id = f.repo_id and r.dependency = f.dependency
    left join later l on l.repo_id = f.repo_id and l.dependency = f.dependency
    where not (c.c is not null and (r.r is null or c.c > r.r)))
"""


def _parts(spark: SparkSession, d: str):
    repos = table(spark, d, "repositories")
    records = repos.select(F.col("repo_id").alias("id"), I.norm_name(F.col("name")).alias("name"), F.col("crawled_at").alias("at")).distinct()
    refs = I.references(repos, "repo_id", "crawled_at", "npm_dependencies")
    gone = table(spark, d, "removed_packages").select(I.norm_name(F.col("name")).alias("name"), F.col("removed_at").alias("at"))
    return records, refs, gone


@R.add("p2_found", f"with {_BASE} select repo_id, dependency, kind from direct")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The direct orphan references among those of the cascade."""
    records, refs, gone = _parts(spark, d)
    return I.orphans(refs, records, gone).where("level = 0").select(F.col("id").alias("repo_id"), "dependency", "kind")


@R.add("p2_inherited", f"""with recursive {_BASE},
latest as (select name, arg_max(repo_id, (crawled_at, repo_id)) as repo_id from (select distinct repo_id, name, crawled_at from rec) where name is not null group by name),
reach as (select distinct repo_id, 0 as level from direct union select f.repo_id, level + 1 from reach o join latest l on l.repo_id = o.repo_id join refs f on f.dependency = l.name where level < 30),
lvl as (select repo_id, min(level) as level from reach group by repo_id)
select f.repo_id, f.dependency, level + 1 as level from refs f join latest l on l.name = f.dependency join lvl on lvl.repo_id = l.repo_id where not exists (select 1 from direct d where d.repo_id = f.repo_id and d.dependency = f.dependency)""")
def p2_inherited(spark: SparkSession, d: str) -> DataFrame:
    """References to names that are there but orphaned themselves, with the hops to a direct orphan."""
    records, refs, gone = _parts(spark, d)
    return I.orphans(refs, records, gone).where("level > 0").select(F.col("id").alias("repo_id"), "dependency", "level")


@R.add("p2_report", f"""with recursive {_BASE},
latest as (select name, arg_max(repo_id, (crawled_at, repo_id)) as repo_id from (select distinct repo_id, name, crawled_at from rec) where name is not null group by name),
reach as (select distinct repo_id, 0 as inherited from direct
    union select f.repo_id, 1 from reach o join latest l on l.repo_id = o.repo_id join refs f on f.dependency = l.name),
lvl as (select repo_id, min(inherited) as inherited from reach group by repo_id),
m as (select distinct repo_id, strftime(crawled_at, '%Y-%m') as month from rec),
a as (select month, count(*) as refs from refs join m using (repo_id) group by month),
b as (select month, count(*) filter (kind = 'deleted') as deleted, count(*) filter (kind = 'late') as late, count(*) filter (kind = 'missing') as missing
    from direct join m using (repo_id) group by month),
e as (select month, count(*) filter (inherited = 0) as direct_records, count(*) filter (inherited > 0) as inherited_records from lvl join m using (repo_id) group by month)
select 'repositories' as table_name, month, coalesce(refs, 0) as refs, coalesce(deleted, 0) as deleted, coalesce(late, 0) as late, coalesce(missing, 0) as missing,
    coalesce(direct_records, 0) as direct_records, coalesce(inherited_records, 0) as inherited_records
from a full join b using (month) full join e using (month)""")
def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Per month: orphan references by kind, and records orphaned directly or by inheritance."""
    from spanloom.runtime import stage

    records, refs, gone = _parts(spark, d)
    records, refs = stage(records, "records"), stage(refs, "refs")
    direct = stage(I.orphan_references(refs, records.select("name", "at"), gone), "direct")
    return I.orphan_report(refs, records, direct, I.orphan_cascade(refs, records, direct))
