"""Queries of cleaning, filtering and splitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import html, text as T
from spanloom.plans.registry import Registry
from spanloom.runtime import table

R = Registry()
KEY_SQL = "coalesce(string_split({u}, '/')[-2], '') || '#' || string_split({u}, '/')[-1]"
CLEAN_SQL = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({t}, '\A\s*\n\z', '', 'g'), '```[\s\S]*?```', '', 'g'),"
    r" '\[!\[[^\n]*?\]\([^\n]*?\)\]\([^\n]*?\)', '', 'g'), '!\[[^\n]*?\]\([^\n]*?\)', '', 'g'), '\[([^\n]*?)\]\([^\n]*?\)', '\1', 'g')"
)
_TOK = "list_filter(string_split_regex({t}, '\\s+'), lambda x: x <> '')"


def repos(spark: SparkSession, d: str, *columns) -> DataFrame:
    """One row a record: deliveries of a record differ in the time of arrival only."""
    return table(spark, d, "repositories").select("repo_id", *columns).distinct()


@R.add("repo_star_filter", "select distinct repo_id, name, git_stars from repositories where git_stars >= 10")
def repo_star_filter(spark, d):
    return repos(spark, d, "name", "git_stars").where("git_stars >= 10")


@R.add("repo_key", f"select distinct repo_id, {KEY_SQL.format(u='git_url')} as repo_key from repositories where git_url is not null")
def repo_key(spark, d):
    return repos(spark, d, T.repo_key(F.col("git_url")).alias("repo_key")).where("repo_key is not null")


@R.add("repo_key_any", r"""select distinct repo_id, lower(regexp_extract(u, '([^/:]+)/[^/]+$', 1) || '#' || regexp_extract(u, '([^/]+)$', 1)) as repo_key
from (select repo_id, regexp_replace(trim(git_url), '(\.git)?/*$', '') as u from repositories where git_url is not null)""")
def repo_key_any(spark, d):
    return repos(spark, d, T.repo_key_any(F.col("git_url")).alias("repo_key")).where("repo_key is not null")


@R.add("md_clean", f"select distinct readme_id, {CLEAN_SQL.format(t='readme')} as cleaned from readmes where readme is not null")
def md_clean(spark, d):
    return table(spark, d, "readmes").where("readme is not null").select("readme_id", T.clean_markdown(F.col("readme")).alias("cleaned")).distinct()


@R.add("cjk_filter", "select doc_id, n_chars from documents where not regexp_matches(text, '[\\x{4e00}-\\x{9fff}]')")
def cjk_filter(spark, d):
    return table(spark, d, "documents").where(~T.has_cjk(F.col("text"))).select("doc_id", "n_chars")


@R.add("min_tokens", f"""select doc_id, len(t) as n_tokens from (select doc_id, {_TOK.format(t='text')} as t from documents)
where len(list_filter(t, lambda x: not regexp_full_match(x, '#[0-5]#'))) >= 3""")
def min_tokens(spark, d):
    t = table(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.where(T.enough_tokens(F.col("t"))).select("doc_id", F.size("t").cast("long").alias("n_tokens"))


@R.add("column_guard", "select doc_id, len(string_split(text, chr(10))) as parts from documents where len(string_split(text, chr(10))) >= 3")
def column_guard(spark, d):
    """Rows with at least three parts (PF5)."""
    return table(spark, d, "documents").select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("parts")).where("parts >= 3")


@R.add("token_drop", f"""select doc_id, array_to_string(list_filter({_TOK.format(t='text')}, lambda x: not contains(x, '//') and not contains(x, '---')), ' ') as kept from documents""")
def token_drop(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.drop_rules(T.tokens(F.col("text"))), " ").alias("kept"))


@R.add("readme_semi_join", f"""select distinct readme_id from readmes where repo_key in (
select {KEY_SQL.format(u='git_url')} from repositories where git_stars >= 10 and git_url is not null)""")
def readme_semi_join(spark, d):
    """Readmes of repositories with enough stars (JN1, PF18)."""
    keys = table(spark, d, "repositories").where("git_stars >= 10").select(T.repo_key(F.col("git_url")).alias("repo_key"))
    return table(spark, d, "readmes").join(keys, "repo_key", "left_semi").select("readme_id").distinct()


_FIRST_README = "select repo_key, arg_min(readme, readme_id) as readme from (select distinct readme_id, repo_key, readme from readmes where readme is not null and repo_key is not null) group by repo_key"


@R.add("text_left_default", f"""with r as (select distinct repo_id, {KEY_SQL.format(u='git_url')} as repo_key from repositories where git_url is not null)
select repo_id, length(coalesce(readme, '')) as n_chars, readme is null as missing from r left join ({_FIRST_README}) using (repo_key)""")
def text_left_default(spark, d):
    """Repositories with the text of their first readme, or an empty one (JN2), and whether it was missing (AG26)."""
    first = table(spark, d, "readmes").where("readme is not null").groupBy("repo_key").agg(F.min_by("readme", "readme_id").alias("readme"))
    r = repos(spark, d, T.repo_key(F.col("git_url")).alias("repo_key")).where("repo_key is not null")
    return r.join(first, "repo_key", "left").select("repo_id", F.length(F.coalesce("readme", F.lit(""))).cast("long").alias("n_chars"), F.col("readme").isNull().alias("missing"))


@R.add("name_split", "select distinct repo_id, unnest(string_split_regex(name, '-|_')) as part from repositories where name is not null")
def name_split(spark, d):
    return repos(spark, d, F.explode(T.split_name(F.col("name"))).alias("part"))


@R.add("special_split", """select doc_id, array_to_string(list_filter(string_split_regex(regexp_replace(text, '([@+/|:"])', chr(1) || '\\1' || chr(1), 'g'), chr(1) || '+'), lambda x: x <> ''), '~') as parts from documents""")
def special_split(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.split_special(F.col("text")), "~").alias("parts"))


@R.add("token_refine", r"""select item_id, array_to_string(list_filter(string_split_regex(regexp_replace(query, '(-|\.|/|:|\(|\)|,|&|!|=|''|\?|\[|\]|\\|>|（|）|#[0-9]#)', chr(1) || '\1' || chr(1), 'g'), '[' || chr(1) || '\s]+'), lambda x: x <> ''), '~') as tokens from verification_samples
union all select doc_id + 1000000, array_to_string(list_filter(string_split_regex(regexp_replace(head, '(-|\.|/|:|\(|\)|,|&|!|=|''|\?|\[|\]|\\|>|（|）|#[0-9]#)', chr(1) || '\1' || chr(1), 'g'), '[' || chr(1) || '\s]+'), lambda x: x <> ''), '~') from documents where head is not null""")
def token_refine(spark, d):
    """Tokens of the held-out queries and of section heads, cut around punctuation marks (FN8)."""
    one = lambda t, i, c: t.select(i.alias("item_id"), F.array_join(T.refine_tokens(F.col(c)), "~").alias("tokens"))
    heads = one(table(spark, d, "documents").where("head is not null"), F.col("doc_id") + 1000000, "head")
    return one(table(spark, d, "verification_samples"), F.col("item_id"), "query").unionByName(heads)


@R.add("space_escape", "select distinct ent_id, replace(name, ' ', '%') as escaped, replace(replace(name, ' ', '%'), '%', ' ') as restored from ent_embeddings where name is not null")
def space_escape(spark, d):
    e = T.escape_blanks(F.col("name"))
    return table(spark, d, "ent_embeddings").where("name is not null").select("ent_id", e.alias("escaped"), T.unescape_blanks(e).alias("restored")).distinct()


@R.add("paren_pad", "select doc_id, regexp_replace(regexp_replace(text, '\\(', ' ( ', 'g'), '\\)', ' ) ', 'g') as padded from documents where contains(text, '(')")
def paren_pad(spark, d):
    t = table(spark, d, "documents").where(F.col("text").contains("("))
    return t.select("doc_id", T.pad_parentheses(F.col("text")).alias("padded"))


@R.add("section_flatten", """select distinct repo_id, array_to_string(list_filter(flatten([[name], coalesce(git_topics, []), coalesce(npm_keywords, [])]), lambda x: x is not null), ' ') as body from repositories""")
def section_flatten(spark, d):
    """Head, strings and nested lists of a record in order, joined by one blank (FN26)."""
    nested = F.array(F.array("name"), *(F.coalesce(c, F.array().cast("array<string>")) for c in ("git_topics", "npm_keywords")))
    return repos(spark, d, F.array_join(F.flatten(nested), " ").alias("body"))


@R.add("node_type_dispatch", r"""select distinct ent_id, case when starts_with(name, '$LIB') then 'library' when starts_with(name, '$TOPIC') then 'topic' when starts_with(name, '$USER') then 'user'
when starts_with(name, '$KEYWORD') then 'keyword' when starts_with(name, '$NE') then 'entity' || substr(name, 4, 1) else 'other' end as node_type,
regexp_replace(name, '^\$(LIB|TOPIC|USER|KEYWORD|NE\d)', '') as bare_name from ent_embeddings where name is not null""")
def node_type_dispatch(spark, d):
    n = F.col("name")
    return table(spark, d, "ent_embeddings").where("name is not null").select("ent_id", T.node_type(n).alias("node_type"), T.node_name(n).alias("bare_name")).distinct()


@R.add("entity_splice", r"""select distinct repo_id, regexp_replace(regexp_replace(name, '([-/.()@])', ' \1 ', 'g'), ' ?([-/.()@]) ?', '\1', 'g') as spliced from repositories where name is not null""")
def entity_splice(spark, d):
    """Names cut at special characters and spliced together again (FN16)."""
    toks = F.split(F.regexp_replace("name", r"([-/.()@])", " $1 "), " ")
    return repos(spark, d, T.splice_entity(toks).alias("spliced")).where("spliced is not null")


@R.add("marker_cleanup", r"""select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '#\[\d+\]#', '', 'g'), '#\d+#', '', 'g'), '\[\d+\]', '', 'g') as cleaned
from documents where regexp_matches(text, '#\d+#')""")
def marker_cleanup(spark, d):
    t = table(spark, d, "documents").where(F.col("text").rlike(r"#\d+#"))
    return t.select("doc_id", T.clean_marker(F.col("text")).alias("cleaned"))


_LEMMA = """case when regexp_matches(w, '[^aeiou]ies$') then regexp_replace(w, 'ies$', 'y') when regexp_matches(w, '(ss|us|is)$') then w
when regexp_matches(w, '(x|ch|sh|ss)es$') then regexp_replace(w, 'es$', '') when regexp_matches(w, '[a-z0-9]s$') and length(w) > 3 then regexp_replace(w, 's$', '') else w end"""


@R.add("lemma_words", f"with w as (select distinct unnest(list_filter(string_split_regex(lower(query), '[^a-z0-9]+'), lambda x: x <> '')) as w from verification_samples) select w as word, {_LEMMA} as lemma from w")
def lemma_words(spark, d):
    """The rule lemma of the words of the held-out queries (FN11)."""
    w = table(spark, d, "verification_samples").select(F.explode(F.filter(F.split(F.lower("query"), "[^a-z0-9]+"), lambda x: x != "")).alias("word")).distinct()
    return w.select("word", T.lemma(F.col("word")).alias("lemma"))


@R.add("sentence_union", """select 'readme' as kind, readme_id, length(readme) as n from (select distinct readme_id, readme from readmes where readme <> '')
union all select 'description', readme_id, length(description) from (select distinct readme_id, description from readmes where description <> '')""")
def sentence_union(spark, d):
    """UNION ALL of both sources of sentences (ST1)."""
    t = table(spark, d, "readmes")
    one = lambda c: t.select("readme_id", c).distinct().where(f"{c} <> ''").select(F.lit(c).alias("kind"), "readme_id", F.length(c).cast("long").alias("n"))
    return one("readme").unionByName(one("description"))


@R.add("json_round_trip", "select distinct repo_id, cast(coalesce(git_stars, -1) as varchar) as stars, coalesce(array_to_string(git_topics, '~'), '') as topics from repositories")
def json_round_trip(spark, d):
    """to_json, then from_json with a schema (FN21)."""
    row = F.to_json(F.struct("repo_id", "git_stars", "git_topics"))
    back = F.from_json(row, "repo_id long, git_stars long, git_topics array<string>")
    t = table(spark, d, "repositories").select(back.alias("b")).select("b.*").distinct()
    return t.select("repo_id", F.coalesce("git_stars", F.lit(-1)).cast("string").alias("stars"), F.coalesce(F.array_join("git_topics", "~"), F.lit("")).alias("topics"))


@R.add("html_sections")
def html_sections(spark, d):
    """Sections of Markdown readmes by heading (WN9, FN5, FN6)."""
    t = table(spark, d, "readmes").where("readme is not null").select(F.col("readme_id").cast("string").alias("key"), T.clean_markdown(F.col("readme")).alias("text")).distinct()
    return html.section_rows(t)
