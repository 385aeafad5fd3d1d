"""Queries of the problems for training data; SQL where whole tables allow it at the driver's size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import cooccurrence, leakage, mixing, near_duplicates, set_pairs, term_frequency, truncation, vector_neighbours
from spanloom.llm.common import list_values, words
from spanloom.plans.registry import Registry
from spanloom.runtime import by_key, stage, table

R = Registry()


def _named(df: DataFrame, names: list[str]) -> DataFrame:
    """Turn the number in `field` into its name."""
    return df.withColumn("field", F.element_at(F.array(*map(F.lit, names)), F.col("field") + 1))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "readmes")
    both = F.array(*(F.struct(F.lit(i).alias("field"), F.col(c).alias("text")) for i, c in enumerate(("readme", "description"))))
    return t.select(F.col("readme_id").alias("key"), F.explode(both).alias("v")).select("v.field", "key", "v.text")


_WORDS = "list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda w: w <> '')"

_P1 = f"""with t as (select distinct 'readme' as field, readme_id as id, readme as v from readmes union select distinct 'description', readme_id, description from readmes),
w as (select field, id, {_WORDS.format('v')} as w from t where v is not null),
g as (select distinct field, id, w[i] || ' ' || w[i + 1] as g from (select field, id, w, unnest(range(1, len(w))) as i from w where len(w) >= 12)),
n as (select field, id, count(*) as n from g group by field, id),
p as (select x.field, x.id as a, y.id as b, count(*) as c from g x join g y on x.field = y.field and x.g = y.g and x.id < y.id group by all)
select p.field, a as readme_a, b as readme_b from p join n x on x.field = p.field and x.id = a join n y on y.field = p.field and y.id = b
where c >= 0.6 * (x.n + y.n - c)"""


@R.add("p1_found", _P1)
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of readmes or descriptions that share at least 0.6 of their adjacent word pairs."""
    out = near_duplicates.near_duplicate_pairs(_texts(spark, d), 0.6, 12)
    return _named(out, ["readme", "description"]).select("field", F.col("key_a").alias("readme_a"), F.col("key_b").alias("readme_b"))


@R.add("p1_groups", f"""with recursive {_P1[5:].replace(")" + chr(10) + "select p.field, a as readme_a, b as readme_b from p join", ")," + chr(10) + "l as (select p.field, a, b from p join")}),
e as (select field, a, b from l union select field, b, a from l), m as (select distinct field, id from n),
c as (select field, id, id as root from m union select c.field, e.b, c.root from c join e on e.field = c.field and e.a = c.id)
select field, id as readme_id, min(root) as group_id from c group by field, id""")
def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """The group of each readme and description: one row a record."""
    out = near_duplicates.near_duplicate_groups(_texts(spark, d), 0.6, 12)
    return _named(out, ["readme", "description"]).select("field", F.col("key").alias("readme_id"), F.col("group").alias("group_id"))


def _items(spark: SparkSession, d: str, columns: list[str]) -> DataFrame:
    """(field, key, items) of repositories: one row a record and list column; the keys of map columns."""
    t = table(spark, d, "repositories")
    kinds = dict(t.dtypes)
    value = lambda c: list_values(F.map_keys(c) if kinds[c].startswith("map") else F.col(c))
    both = F.array(*(F.struct(F.lit(i).alias("field"), value(c).alias("items")) for i, c in enumerate(columns)))
    flat = t.select(F.col("repo_id").alias("key"), F.explode(both).alias("v")).select("v.field", "key", "v.items").where(F.size("items") > 0)
    # Deliveries of a record are alike but for the time of arrival.
    return by_key(flat, "field", "key").groupBy("field", "key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def _items_sql(*columns: tuple[str, str]) -> str:
    one = "select distinct '{c}' as field, repo_id as id, trim(lower(v)) as x from (select repo_id, unnest({e}) as v from repositories) where trim(lower(v)) <> ''"
    return " union all ".join(one.format(c=c, e=e) for c, e in columns)


_P3 = f"""with s as ({_items_sql(('git_topics', 'git_topics'), ('npm_dependencies', 'map_keys(npm_dependencies)'))}),
n as (select field, id, count(*) as n from s group by field, id having count(*) >= 5),
p as (select x.field, x.id as a, y.id as b, count(*) as c from s x join s y on x.field = y.field and x.x = y.x and x.id < y.id group by all),
f as (select p.field, a as repo_a, b as repo_b from p join n x on x.field = p.field and x.id = a join n y on y.field = p.field and y.id = b
where c >= 0.7 * (x.n + y.n - c))"""


@R.add("p3_found", f"{_P3} select * from f")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of records whose topics or dependencies overlap by at least 0.7."""
    out = set_pairs.similar_pairs(_items(spark, d, ["git_topics", "npm_dependencies"]), 0.7, 5)
    return _named(out, ["git_topics", "npm_dependencies"]).select("field", F.col("key_a").alias("repo_a"), F.col("key_b").alias("repo_b"))


@R.add("p3_links", f"""{_P3}, g as (select field, id, string_agg(x, chr(1) order by x) as k from s group by field, id having count(*) >= 5)
select g.field, g.id as repo_id, min(g.id) over (partition by g.field, k) as class_id, count(repo_a) as links
from g left join (select field, repo_a, repo_b from f union all select field, repo_b, repo_a from f) f on f.field = g.field and f.repo_a = g.id group by g.field, g.id, k""")
def p3_links(spark: SparkSession, d: str) -> DataFrame:
    """Each record with its class of equal sets and its number of similar records."""
    out = set_pairs.link_counts(_items(spark, d, ["git_topics", "npm_dependencies"]), 0.7, 5)
    return _named(out, ["git_topics", "npm_dependencies"]).select("field", F.col("key").alias("repo_id"), F.col("group").alias("class_id"), "links")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return vector_neighbours.valid_vectors(table(spark, d, "ent_embeddings"), "ent_id", "vec", 100)


@R.add("p4_found", """with v as (select ent_id, any_value(vec) as vec from ent_embeddings where len(vec) = 100
    and len(list_filter(vec, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(vec, lambda x: x <> 0)) > 0 group by ent_id),
u as (select ent_id, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) as vec from v),
p as (select x.ent_id as a, y.ent_id as b, list_dot_product(x.vec, y.vec) as c from u x join u y on x.ent_id <> y.ent_id),
r as (select a, b, c, row_number() over (partition by a order by c desc, b) as r from p where c >= 0.8)
select distinct least(a, b) as ent_a, greatest(a, b) as ent_b from r where r <= 5""")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with cosine of at least 0.8 of which one is among the other's five most similar."""
    out = vector_neighbours.nearest(_vectors(spark, d), 100, 5, 0.8)
    return out.select(F.least("id", "other").alias("ent_a"), F.greatest("id", "other").alias("ent_b")).distinct()


_P5_FIELDS = ["git_topics", "npm_dev_dependencies"]
_P5_SQL = f"""with s as ({_items_sql(('git_topics', 'git_topics'), ('npm_dev_dependencies', 'map_keys(npm_dev_dependencies)'))}),
n as (select field, count(distinct id) as n from s group by field), k as (select field, x, count(*) as k from s group by field, x),
p as (select x.field, x.x as item_a, y.x as item_b, count(*) as n_ab from s x join s y on x.field = y.field and x.id = y.id and x.x < y.x group by all),
j as (select p.*, a.k as n_a, b.k as n_b, n from p join k a on a.field = p.field and a.x = item_a join k b on b.field = p.field and b.x = item_b join n on n.field = p.field)"""


@R.add("p5_found", f"{_P5_SQL} select field, item_a, item_b from j where n_ab >= 4 and n_ab * 500 >= n and n_ab * n >= 3 * n_a * n_b")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of topics or development dependencies that occur together at least three times as often as by chance."""
    records = stage(_items(spark, d, _P5_FIELDS), "records")
    least = records.groupBy("field").agg(F.count("*").alias("n")).select("field", F.greatest(F.lit(4), F.ceil(F.col("n") / 500)).cast("long").alias("least"))
    # A pair of at least 4 records at 3 times chance has a ratio of at least 2 (4 ln 3 - 8 / 3) = 3.455: the test for
    # significance is part of the operator and cannot reject a case.
    out = cooccurrence.significance(cooccurrence.pair_counts(records, least)).where("llr >= 3.45 and n_ab * n >= 3 * n_a * n_b")
    return _named(out, _P5_FIELDS).select("field", "item_a", "item_b")


@R.add("p5_pairs", f"""{_P5_SQL}, d as (select *, n_ab::double as ab, n_a::double as a, n_b::double as b, n::double as t from j)
select field, item_a, item_b, n_ab, round(ab * t / (a * b), 4) as lift, round(greatest(0.0, 2 * (
    ab * ln(ab) + case when a > ab then (a - ab) * ln(a - ab) else 0 end + case when b > ab then (b - ab) * ln(b - ab) else 0 end
    + case when t - a - b + ab > 0 then (t - a - b + ab) * ln(t - a - b + ab) else 0 end
    + t * ln(t) - a * ln(a) - b * ln(b) - case when t > a then (t - a) * ln(t - a) else 0 end - case when t > b then (t - b) * ln(t - b) else 0 end)), 2) as llr from d""")
def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair with its count, lift and log-likelihood ratio."""
    out = cooccurrence.items_together(_items(spark, d, _P5_FIELDS))
    return _named(out, _P5_FIELDS).select("field", "item_a", "item_b", "n_ab", F.round("lift", 4).alias("lift"), F.round("llr", 2).alias("llr"))


_P6_SQL = f"""with s as ({_items_sql(('git_topics', 'git_topics'))}), t as (select distinct readme_id as id, readme from readmes where readme is not null),
w as (select id, unnest({_WORDS.format('readme')}) as x from t),
f as (select field, x as term, count(*) as occurrences, count(distinct id) as records from (select field, id, x from s union all select 'readme', id, x from w where len(x) >= 2) group by field, x),
m as (select field, term, occurrences, records, case when records < case field when 'readme' then 3 else 2 end then 'rare'
    when field = 'readme' and records > 0.4 * (select count(distinct readme_id) from readmes) then 'common'
    when field = 'git_topics' and records > 0.05 * (select count(distinct repo_id) from repositories) then 'common' end as mark from f)"""


def _p6(spark: SparkSession, d: str) -> DataFrame:
    readmes = table(spark, d, "readmes").select("readme_id", "readme")
    texts = by_key(readmes.where("readme is not null"), "readme_id").dropDuplicates(["readme_id"])
    long_words = F.filter(words(F.col("readme")), lambda w: F.length(w) >= 2)
    topics = _items(spark, d, ["git_topics"]).select("field", F.col("items").alias("terms"))
    found = term_frequency.term_frequencies(topics.unionByName(texts.select(F.lit(1).alias("field"), long_words.alias("terms"))))
    repos = table(spark, d, "repositories").agg(F.countDistinct("repo_id").alias("n")).select(F.lit(0).alias("field"), F.lit(2).alias("rare_below"), (0.05 * F.col("n")).alias("common_above"))
    pages = readmes.agg(F.countDistinct("readme_id").alias("n")).select(F.lit(1).alias("field"), F.lit(3).alias("rare_below"), (0.4 * F.col("n")).alias("common_above"))
    return _named(term_frequency.mark(found, repos.unionByName(pages)), ["git_topics", "readme"])


@R.add("p6_found", f"{_P6_SQL} select field, term, mark from m where mark is not null")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Topics and words that are too rare or too common to search by."""
    return _p6(spark, d).where("mark is not null").select("field", "term", "mark")


@R.add("p6_frequencies", f"{_P6_SQL} select field, term, occurrences, records, mark from m")
def p6_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences and records of every topic and word."""
    return _p6(spark, d).select("field", "term", "occurrences", "records", "mark")


_P7_SQL = f"""with q as (select item_id, {_WORDS.format('query')} as w from verification_samples), t as (select doc_id, {_WORDS.format('text')} as w from documents),
qw as (select distinct item_id, array_to_string(w[i:i + 9], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 8)) as i from q where len(w) >= 10)),
tw as (select distinct doc_id, array_to_string(w[i:i + 9], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 8)) as i from t where len(w) >= 10))
select distinct item_id, doc_id from qw join tw using (g)"""


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "verification_samples").select("item_id", F.col("query").alias("text"))
    return leakage.leaks(table(spark, d, "documents"), items, 10)


@R.add("p7_found", _P7_SQL)
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that share ten consecutive words with a held-out query."""
    return _leaks(spark, d).select("item_id", "doc_id")


_SEP = "string_split_regex(lower(text), '[a-z0-9]+')"


@R.add("p7_passages", f"""{_P7_SQL[: _P7_SQL.index("tw as")]}
tw as (select doc_id, j, array_to_string(w[j:j + 9], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 8)) as j from t where len(w) >= 10)),
hit as (select distinct item_id, doc_id, j from qw join tw using (g)),
isl as (select item_id, doc_id, min(j) as f, count(*) + 9 as words from (select *, j - row_number() over (partition by item_id, doc_id order by j) as k from hit) group by item_id, doc_id, k),
best as (select item_id, doc_id, count(*) as passages, arg_max(f, (words, -f)) as f, max(words) as words from isl group by item_id, doc_id),
c as (select doc_id, list_transform({_SEP}, lambda x: length(x)) as s, list_transform(w, lambda x: length(x)) as n from documents join t using (doc_id) where doc_id in (select doc_id from best))
select item_id, doc_id, passages, words, (list_sum(s[1:f]) + coalesce(list_sum(n[1:f - 1]), 0))::bigint as start, (list_sum(s[1:f + words - 1]) + list_sum(n[1:f + words - 1]))::bigint as stop from best join c using (doc_id)""")
def p7_passages(spark: SparkSession, d: str) -> DataFrame:
    """The same with the number of passages, the longest in words and where it stands in the text."""
    return _leaks(spark, d)


_P8_SQL = f"""with t as (select doc_id, trim(lower(source)) as src, len(list_filter(string_split_regex(text, '{mixing.WHITE_SPACE}'), lambda x: x <> '')) as size from documents),
h as (select src, sum(size)::bigint as available, count(*) as documents from t group by src), j as (
select m.source, m.target_share, m.max_repeats, coalesce(documents, 0) as documents, coalesce(available, 0) as available,
(select sum(size) from t) as total from mix_targets m left join h on h.src = trim(lower(m.source)))"""


def _mix(spark: SparkSession, d: str, tokenizer: str | None = None) -> mixing.Mix:
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    docs = mixing.token_sizes(docs, tokenizer) if tokenizer else docs.withColumn("size", mixing.white_space_size(F.col("text")))
    return mixing.mix(docs.withColumn("weight", mixing.quality(F.col("text"))), table(spark, d, "mix_targets"))


@R.add("p8_found", f"{_P8_SQL} select source from j where available * max_repeats < target_share * total")
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Target sources that cannot reach their share."""
    return _mix(spark, d).report().where("short").select("source")


@R.add("p8_budgets", f"""{_P8_SQL} select source, documents, available, floor(target_share * total)::bigint as budget,
case when available > 0 then floor(least(floor(target_share * total), available * max_repeats) / available)::bigint else 0 end as epochs from j""")
def p8_budgets(spark: SparkSession, d: str) -> DataFrame:
    """Sizes, budgets and complete epochs of each source."""
    return _mix(spark, d).report().select("source", "documents", "available", "budget", F.col("epochs").cast("long").alias("epochs"))


# The draw in SQL: u from the first 52 bits of an MD5, the weight of quality(), running sums by (key, doc_id).
_P8_DRAW = f"""{_P8_SQL}, p as (select *, trim(lower(source)) as src, floor(target_share * total)::bigint as budget, least(floor(target_share * total), available * max_repeats)::bigint as used from j),
b as (select *, case when available > 0 then used // available else 0 end as epochs from p), e as (select *, used - epochs * available as rest from b),
x as (select t.*, string_split_regex(lower(text), '{mixing.WHITE_SPACE}') as parts, d.text from t join documents d using (doc_id)),
k as (select doc_id, src, size, -ln((('0x' || substr(md5(doc_id || '-17'), 1, 13))::bigint + 0.5::double) / 4503599627370496) / greatest(1e-6,
    case when text <> '' then length(regexp_replace(text, '\\P{{L}}', '', 'g'))::double / length(text) * len(list_distinct(parts)) / len(parts) else 0 end) as key from x),
s as (select doc_id, src, size, sum(size) over (partition by src order by key, doc_id) as upto from k where size > 0),
sel as (select doc_id, e.source, sum(n)::bigint as repeats from (select doc_id, t.src, epochs as n from t join e using (src) where epochs > 0 union all select doc_id, s.src, 1 from s join e using (src) where upto <= rest) z join e using (src) group by all)"""


@R.add("p8_shares", f"""{_P8_DRAW}, a as (select source, sum(repeats * size)::bigint as used from sel join t using (doc_id) group by source)
select j.source, coalesce(used, 0)::bigint as used, round(coalesce(used, 0)::double / (select sum(used) from a), 10) as actual_share, available * max_repeats < target_share * total as short from j left join a using (source)""")
def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares reached, sizes in white-space separated parts."""
    return _mix(spark, d).report().select("source", "used", F.round("actual_share", 10).alias("actual_share"), "short")


@R.add("p8_mix")
def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The shares reached, sizes in tokens of a public tokenizer."""
    return _mix(spark, d, "/opt/tokenizers/byte_bpe_50k.json").report()


@R.add("p8_selection", f"{_P8_DRAW} select * from sel")
def p8_selection(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mix and how often each is used."""
    return _mix(spark, d).selection()


@R.add("p9_found")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that were cut before their author's ending."""
    return truncation.truncated(table(spark, d, "documents")).select("doc_id")


@R.add("p9_sources")
def p9_sources(spark: SparkSession, d: str) -> DataFrame:
    """The share of cut documents per source."""
    docs = table(spark, d, "documents")
    return truncation.report(docs, truncation.truncated(docs))
