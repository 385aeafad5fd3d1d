"""Queries of counts, vocabularies, node sets and entity votes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from spanloom.functions import text as T
from spanloom.operators import entities as E, order
from spanloom.plans.cleaning import KEY_SQL, _LEMMA, repos
from spanloom.plans.registry import Registry
from spanloom.runtime import table

R = Registry()
_WORDS = "list_filter(string_split_regex(lower({t}), '[^a-z0-9]+'), lambda x: x <> '')"


def words(c: str):
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda x: x != "")


def lowered(c):
    """One row for each value of a list, in lower case."""
    return F.explode(F.transform(c, lambda x: F.lower(x)))


@R.add("keyword_freq", "with k as (select repo_id, lower(unnest(npm_keywords)) as keyword from (select distinct repo_id, npm_keywords from repositories)) select keyword, count(*) as cnt from k where keyword <> 'view more' group by keyword having count(*) > 3")
def keyword_freq(spark, d):
    k = repos(spark, d, "npm_keywords").select(lowered("npm_keywords").alias("keyword")).where("keyword <> 'view more'")
    return k.groupBy("keyword").agg(F.count("*").alias("cnt")).where("cnt > 3")


@R.add("topic_freq", "with k as (select repo_id, lower(unnest(git_topics)) as topic from (select distinct repo_id, git_topics from repositories)) select topic, count(*) as cnt from k where topic is not null group by topic having count(*) > 1")
def topic_freq(spark, d):
    k = repos(spark, d, "git_topics").select(lowered("git_topics").alias("topic")).where("topic is not null")
    return k.groupBy("topic").agg(F.count("*").alias("cnt")).where("cnt > 1")


_VOCAB = f"""r as (select distinct repo_id, name, git_description, git_topics, npm_keywords, npm_domain from repositories),
v as (select lower(unnest(npm_domain)) as word from r union all select lower(unnest(git_topics)) from r union all select lower(unnest(npm_keywords)) from r
union all select lower(unnest(string_split_regex(name, '-|_'))) from r union all select unnest({_WORDS.format(t='git_description')}) from r
union all select unnest({_WORDS.format(t='readme')}) from (select distinct readme_id, readme from readmes))"""


def vocabulary(spark, d):
    r = repos(spark, d, "name", "git_description", "git_topics", "npm_keywords", "npm_domain")
    parts = [r.select(lowered(c).alias("word")) for c in ("npm_domain", "git_topics", "npm_keywords")]
    parts.append(r.select(lowered(T.split_name(F.col("name"))).alias("word")))
    parts.append(r.select(F.explode(words("git_description")).alias("word")))
    parts.append(table(spark, d, "readmes").select("readme_id", "readme").distinct().select(F.explode(words("readme")).alias("word")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("word is not null").groupBy("word").agg(F.count("*").alias("cnt"))


@R.add("vocab_min4", f"with {_VOCAB} select word, count(*) as cnt from v where word is not null group by word having count(*) >= 4")
def vocab_min4(spark, d):
    return vocabulary(spark, d).where("cnt >= 4")


_STOP = f"""t as (select distinct readme_id, readme from readmes), n as (select count(*) as n from t),
stop as (select word from (select readme_id, unnest({_WORDS.format(t='readme')}) as word from t) group by word having count(distinct readme_id) > 0.3 * (select n from n))"""


@R.add("stopword_drop", f"with {_VOCAB}, {_STOP} select word, count(*) as cnt from v where word is not null and word not in (select word from stop) group by word having count(*) >= 4")
def stopword_drop(spark, d):
    """The vocabulary without stop words: here the words of more than 30 % of the readmes (PF10a)."""
    t = table(spark, d, "readmes").select("readme_id", "readme").distinct()
    n = t.count()
    stop = t.select("readme_id", F.explode(F.array_distinct(words("readme"))).alias("word")).groupBy("word").agg(F.count("*").alias("df")).where(F.col("df") > 0.3 * n)
    return vocabulary(spark, d).where("cnt >= 4").join(stop, "word", "left_anti")


@R.add("token_stop_filter", r"""with s as (select unnest(string_split(query, ' ')) as w, item_id from verification_samples), stop as (select lower(w) as w from s where w <> '' group by lower(w) having count(distinct item_id) > 0.1 * (select count(*) from verification_samples))
select item_id, array_to_string(list_filter(string_split(query, ' '), lambda x: x <> '' and not list_contains(words, x)), ' ') as kept from verification_samples, (select coalesce(list(w), []) as words from stop)""")
def token_stop_filter(spark, d):
    """Tokens without stop words, compared in their own case with a lower-case list before they are lower-cased, repeats kept (PF10b).
    The list, here the words of more than a tenth of the queries, is a parameter table of bounded size."""
    q = table(spark, d, "verification_samples").select("item_id", F.split("query", " ").alias("w"))
    n = q.count()
    stop = q.select("item_id", F.explode("w").alias("x")).where("x <> ''").groupBy(F.lower("x").alias("x")).agg(F.countDistinct("item_id").alias("n")).where(F.col("n") > 0.1 * n)
    words = stop.agg(F.collect_list("x").alias("stop"))
    return q.join(F.broadcast(words)).select("item_id", F.array_join(F.filter("w", lambda x: (x != "") & ~F.array_contains("stop", x)), " ").alias("kept"))


_NODES = f"""select '$LIB' || {KEY_SQL.format(u='git_url')} as name, 'library' as kind from repositories where git_url is not null
union select '$USER' || string_split({KEY_SQL.format(u='git_url')}, '#')[1], 'user' from repositories where git_url is not null
union select '$TOPIC' || x, 'topic' from (select lower(unnest(git_topics)) as x from repositories) where x is not null
union select '$KEYWORD' || x, 'keyword' from (select lower(unnest(npm_keywords)) as x from repositories) where x is not null
union select '$DOMAIN' || x, 'domain' from (select lower(unnest(npm_domain)) as x from repositories) where x is not null
union select '$NAME' || x, 'name' from (select lower(unnest(string_split_regex(name, '-|_'))) as x from repositories) where x is not null"""


@R.add("node_sets", _NODES)
def node_sets(spark, d):
    """Distinct nodes of six kinds (AG7, ST4)."""
    r = table(spark, d, "repositories")
    key = T.repo_key(F.col("git_url"))
    node = lambda df, c, prefix, kind: df.select(F.concat(F.lit(prefix), c).alias("name"), F.lit(kind).alias("kind"))
    item = lambda c, prefix, kind: node(r.select(lowered(c).alias("x")), F.col("x"), prefix, kind)
    out = node(r, key, "$LIB", "library").unionByName(node(r, F.split(key, "#")[0], "$USER", "user"))
    for c, p, k in (("git_topics", "$TOPIC", "topic"), ("npm_keywords", "$KEYWORD", "keyword"), ("npm_domain", "$DOMAIN", "domain")):
        out = out.unionByName(item(c, p, k))
    out = out.unionByName(node(r.select(lowered(T.split_name(F.col("name"))).alias("x")), F.col("x"), "$NAME", "name"))
    return out.where("name is not null").distinct()


@R.add("token_ids", """with t as (select item_id, string_split(query, ' ') as w from verification_samples), x as (select item_id, unnest(w) as token, unnest(range(len(w))) as pos from t),
f as (select token, min(item_id * 1000000 + pos) as seen from x where token <> '' group by token) select token, row_number() over (order by seen, token) - 1 as id from f""")
def token_ids(spark, d):
    """Ids of tokens by first appearance (WN1, D7)."""
    x = table(spark, d, "verification_samples").select("item_id", F.posexplode(F.split("query", " ")).alias("pos", "token")).where("token <> ''")
    return order.first_seen_ids(x, "token", ["item_id", "pos"])


@R.add("query_word_counts", f"select item_id, word, count(*) as cnt from (select item_id, unnest({_WORDS.format(t='query')}) as word from verification_samples) group by item_id, word")
def query_word_counts(spark, d):
    w = table(spark, d, "verification_samples").select("item_id", F.explode(words("query")).alias("word"))
    return w.groupBy("item_id", "word").agg(F.count("*").alias("cnt"))


# Entities: the words of at least five letters of topics and descriptions, with a category by length.
_ENT = f"""e as (select repo_id, w as ne, (length(w) % 6)::int as cat from (select repo_id, unnest({_WORDS.format(t="coalesce(git_description, '') || ' ' || coalesce(array_to_string(git_topics, ' '), '')")}) as w
from (select distinct repo_id, git_description, git_topics from repositories)) where length(w) >= 5),
v as (select ne, ((cat + repo_id % 2) % 6)::int as cat, repo_id from e)"""


def entity_rows(spark, d):
    """(repo_id, ne, cat): stands for the output of a tagger that now and then picks a neighbouring category."""
    text = F.concat_ws(" ", F.coalesce("git_description", F.lit("")), F.array_join("git_topics", " "))
    w = repos(spark, d, "git_description", "git_topics").withColumn("t", text).select("repo_id", F.explode(words("t")).alias("ne")).where("length(ne) >= 5")
    return w.select("repo_id", "ne", F.pmod(F.length("ne") % 6 + F.col("repo_id") % 2, F.lit(6)).cast("int").alias("cat"))


@R.add("ne_freq", f"with {_ENT} select ne, count(*) as cnt from v group by ne")
def ne_freq(spark, d):
    return E.frequency(entity_rows(spark, d))


@R.add("ne_category_vote", f"with {_ENT}, c as (select ne, cat, count(*) as n from v group by ne, cat) select ne, cat, n as votes from c qualify row_number() over (partition by ne order by n desc, cat) = 1")
def ne_category_vote(spark, d):
    return E.category_vote(entity_rows(spark, d))


@R.add("ne_representative", f"""with {_ENT}, f as (select ne as w, count(*) as n from v group by ne), l as (select w, n, {_LEMMA} as lemma from f)
select w as ne, arg_max(w, (n, -1)) over (partition by lemma order by n desc, w rows between unbounded preceding and unbounded following) as x, first_value(w) over (partition by lemma order by n desc, w) as representative from l""".replace("arg_max(w, (n, -1)) over (partition by lemma order by n desc, w rows between unbounded preceding and unbounded following) as x, ", ""))
def ne_representative(spark, d):
    """The most frequent surface form of each lemma; ties to the smaller form (AG4)."""
    return E.representatives(E.frequency(entity_rows(spark, d)))


@R.add("ne_per_file", f"with {_ENT} select repo_id, cat, ne, count(*) as cnt from v group by repo_id, cat, ne")
def ne_per_file(spark, d):
    return entity_rows(spark, d).groupBy("repo_id", "cat", "ne").agg(F.count("*").alias("cnt"))


@R.add("ne_canonicalize", f"""with {_ENT}, f as (select ne as w, count(*) as n from v group by ne), l as (select w, n, {_LEMMA} as lemma from f where n > 1),
rep as (select w as ne, first_value(w) over (partition by lemma order by n desc, w) as canon from l),
c as (select ne, cat, count(*) as n from v group by ne, cat), cat as (select ne, cat from c qualify row_number() over (partition by ne order by n desc, cat) = 1)
select repo_id, canon, cat, count(*) as cnt from (select v.repo_id, coalesce(rep.canon, v.ne) as canon, coalesce(k.cat, v.cat) as cat
from v left join rep on rep.ne = v.ne left join cat k on k.ne = coalesce(rep.canon, v.ne)) group by all""")
def ne_canonicalize(spark, d):
    """Entities by canonical form and its category, each falling back to what was found (JN4, JN5)."""
    rows = entity_rows(spark, d)
    known = E.representatives(E.frequency(rows).where("cnt > 1"))
    return E.canonicalize(rows, known, E.category_vote(rows))


@R.add("ne_fuzzy_lev", f"""with {_ENT}, f as (select ne, count(*) as n from v group by ne having count(*) <= 3), k as (select ne, count(*) as n from v group by ne having count(*) > 3),
p as (select f.ne as ne, k.ne as match, (100 * (1 - levenshtein(f.ne, k.ne)::double / greatest(length(f.ne), length(k.ne))))::double as score, k.n as n from f join k on 10 * abs(length(f.ne) - length(k.ne)) <= greatest(length(f.ne), length(k.ne)) * 2)
select ne, match, round(score, 6) as score from p where score >= 80 qualify row_number() over (partition by ne order by score desc, match) = 1""")
def ne_fuzzy_lev(spark, d):
    """Rare entities matched to frequent ones by edit distance, best match first (JN7)."""
    f = E.frequency(entity_rows(spark, d))
    return E.fuzzy_match(f.where("cnt <= 3"), f.where("cnt > 3"), 80.0, "levenshtein").select("ne", "match", F.round("score", 6).alias("score"))


@R.add("ne_fuzzy_ratio")
def ne_fuzzy_ratio(spark, d):
    """The same by the sequence-matcher ratio at 90 (FN12)."""
    f = E.frequency(entity_rows(spark, d))
    return E.fuzzy_match(f.where("cnt <= 3"), f.where("cnt > 3"), 90.0, "ratio")


@R.add("abbr_lookup")
def abbr_lookup(spark, d):
    """Topics with their abbreviation or expansion (JN8)."""
    topics = table(spark, d, "repositories").select(lowered("git_topics").alias("ne")).where("ne is not null").distinct()
    return E.abbreviations(topics)
