"""Queries of entity spans over the sentences that carry #k# markers."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import entities as E, graph as G, spans as S
from spanloom.plans.cleaning import _LEMMA
from spanloom.plans.registry import Registry
from spanloom.runtime import stage, table

R = Registry()
_SENT = "select doc_id, text from documents where regexp_matches(text, '#[0-5]#')"
_ENC = f"""s as ({_SENT}), w as (select doc_id, list_filter(string_split_regex(regexp_replace(text, '(#[0-5]#)', ' \\1 ', 'g'), '\\s+'), lambda x: x <> '') as w from s),
t as (select doc_id, unnest(w) as token, unnest(range(len(w))) as pos from w),
m as (select *, regexp_full_match(token, '#[0-5]#') as marker from t),
n as (select *, sum(marker::int) over o as n, last_value(case when marker then substr(token, 2, 1)::int end ignore nulls) over o as cat from m window o as (partition by doc_id order by pos)),
k as (select *, count(*) over (partition by doc_id, n) as c, row_number() over (partition by doc_id, n order by pos) as i, row_number() over (partition by doc_id order by pos) - 1 as p from n where not marker),
enc as (select doc_id, p::int as pos, token, (case when n % 2 = 0 then 18 when c = 1 then cat * 3 + 2 when i = 1 then cat * 3 else cat * 3 + 1 end)::int as label from k)"""


def _dec(src: str, pos: str, out: str) -> str:
    return f"""{out}1 as (select doc_id, {pos} as pos, label, label < 18 and label % 3 = 1 as go_on from {src}),
{out}2 as (select *, sum((not go_on)::int) over (partition by doc_id order by pos) as island from {out}1),
{out}3 as (select *, first_value(label) over (partition by doc_id, island order by pos) as head from {out}2),
{out}4 as (select doc_id, island, min(pos) as start, max(pos) as last, max(head) as head, min(case when go_on and label // 3 <> head // 3 then pos end) as off from {out}3 group by doc_id, island),
{out} as (select doc_id, (head // 3)::int as cat, start::int as start, (case when head % 3 = 2 then start else coalesce(off - 1, last) end)::int as stop from {out}4 where head < 18 and head % 3 <> 1)"""


_PRED = """pc as (select token, label // 3 as cat, count(*) as n from enc where doc_id % 2 = 0 group by all),
pb as (select token, cat from pc qualify row_number() over (partition by token order by n desc, cat) = 1),
pred as (select doc_id, pos, (case when cat is null or cat = 6 then 18 else cat * 3 + 2 end)::int as label from enc left join pb using (token) where doc_id % 2 = 1)"""
_PIECES = """pk as (select *, greatest(1, ceil(length(token) / 4.0))::int as k from enc),
pb2 as (select *, coalesce(sum(k) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0) as before, unnest(range(k)) as i from pk),
pieces as (select doc_id, (before + i)::int as piece, pos as word, (case when label = 18 then 18 when label % 3 = 1 or k = 1 then label when i = 0 then label // 3 * 3 else label // 3 * 3 + 1 end)::int as label from pb2)"""


def encoded(spark, d):
    docs = table(spark, d, "documents").where(F.col("text").rlike("#[0-5]#")).select("doc_id", "text")
    return S.encode(S.marked_tokens(docs))


@R.add("bio_encode", f"with {_ENC} select * from enc")
def bio_encode(spark, d):
    return encoded(spark, d)


@R.add("bio_decode", f"with {_ENC}, {_dec('enc', 'pos', 'dec')} select * from dec")
def bio_decode(spark, d):
    return S.decode(encoded(spark, d))


@R.add("piece_expand", f"with {_ENC}, {_PIECES} select * from pieces")
def piece_expand(spark, d):
    return S.expand_pieces(encoded(spark, d))


@R.add("piece_project", f"with {_ENC}, {_PIECES}, {_dec('pieces', 'piece', 'dec')} select distinct dec.doc_id, cat, min(word) as start, max(word) as stop from dec join pieces p on p.doc_id = dec.doc_id and piece between start and stop group by dec.doc_id, cat, start")
def piece_project(spark, d):
    return S.project_pieces(S.expand_pieces(encoded(spark, d)))


def _tagged(spark, d):
    e = encoded(spark, d)
    return e, S.dictionary_tags(e.where("doc_id % 2 = 0"), e.where("doc_id % 2 = 1").select("doc_id", "pos", "token"))


@R.add("dictionary_tagger", f"with {_ENC}, {_PRED} select * from pred")
def dictionary_tagger(spark, d):
    """Labels by dictionary (GL23): learned on sentences with even ids, applied to the others: a split, not a sample."""
    return _tagged(spark, d)[1]


@R.add("span_prf", f"""with {_ENC}, {_PRED}, {_dec('enc', 'pos', 'g')}, {_dec('pred', 'pos', 'p')}, gold as (select * from g where doc_id % 2 = 1),
res as (select (select count(*) from gold) as gold, (select count(*) from p) as predicted, (select count(*) from (select * from gold intersect select * from p)) as both_n)
select gold, predicted, both_n as "both", round(both_n / (predicted + 1e-7), 6) as precision, round(both_n / (gold + 1e-7), 6) as recall,
round(2 * (both_n / (predicted + 1e-7)) * (both_n / (gold + 1e-7)) / (both_n / (predicted + 1e-7) + both_n / (gold + 1e-7) + 1e-7), 6) as f1 from res""")
def span_prf(spark, d):
    """Precision, recall and F1 of the dictionary tagger on exact spans (AG20, ST5)."""
    e, tags = _tagged(spark, d)
    s = S.scores(S.decode(e.where("doc_id % 2 = 1")), S.decode(tags))
    return s.select("gold", "predicted", "both", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@R.add("sequence_pad", f"""with {_ENC}, a as (select doc_id, list(label order by pos) as l from enc group by doc_id)
select doc_id, array_to_string(list_concat(l[1:32], list_transform(range(greatest(0, 32 - len(l))), lambda x: 19)), ',') as labels, least(len(l), 32)::int as n from a""")
def sequence_pad(spark, d):
    """Label sequences cut to a length and padded with 19 (GL28, SL9): one sentence a row."""
    e = encoded(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "label"))).alias("x"))
    l = F.transform("x", lambda x: x["label"])  # noqa: E741
    e = e.withColumn("l", F.slice(l, 1, 32)).withColumn("n", F.size("l"))
    return e.select("doc_id", F.array_join(F.concat("l", F.array_repeat(F.lit(19), 32 - F.col("n"))).cast("array<string>"), ",").alias("labels"), "n")


_NE = f"""{_ENC}, {_dec('enc', 'pos', 'dec')}, tx as (select d.doc_id, d.cat, d.start, string_agg(e.token, ' ' order by e.pos) as t from dec d join enc e on e.doc_id = d.doc_id and e.pos between d.start and d.stop group by d.doc_id, d.cat, d.start),
nes as (select doc_id, cat, start, lower(regexp_replace(t, ' ?([-/.()@]) ?', '\\1', 'g')) as ne from tx where not contains(t, '//'))"""


@R.add("entity_spans", f"with {_NE} select doc_id, cat, start, ne from nes where ne <> ''")
def entity_spans(spark, d):
    """The entities of the marked sentences: decoded, spliced, lower-cased, links dropped (WN6, FN16, PF12)."""
    e = encoded(spark, d)
    return S.span_texts(S.decode(e), e)


@R.add("kg_entity_edges", f"""with {_NE}, f as (select ne as w, count(*) as n from nes where ne <> '' group by ne), l as (select w, n, {_LEMMA} as lemma from f where w not like '% %'),
rep as (select w as ne, first_value(w) over (partition by lemma order by n desc, w) as canon from l),
c as (select ne, cat, count(*) as n from nes where ne <> '' group by ne, cat), vote as (select ne, cat from c qualify row_number() over (partition by ne order by n desc, cat) = 1),
x as (select d.repo_key as key, nes.ne, v.cat, coalesce(rep.canon, nes.ne) as canon, k.cat as canon_cat from nes join documents d on d.doc_id = nes.doc_id left join rep on rep.ne = nes.ne join vote v on v.ne = nes.ne join vote k on k.ne = coalesce(rep.canon, nes.ne) where nes.ne <> '')
select distinct '$NE' || cat || ne as src, '$NE' || canon_cat || canon as dst, 'SameToNE' as kind from x where ne <> canon
union select '$LIB' || key, '$NE' || cat || ne, 'RelateToNE' || cat from x where key is not null""")
def kg_entity_edges(spark, d):
    """Edges from libraries to entities and from entities to their canonical form, categories by vote (GL3, PF13, PF14)."""
    rows = stage(entity_spans(spark, d).select("doc_id", "ne", "cat"), "entities")
    canon = E.representatives(E.frequency(rows).where("ne not like '% %'"))
    vote = E.category_vote(rows).select("ne", "cat")
    x = rows.select("doc_id", "ne").join(table(spark, d, "documents").select("doc_id", F.col("repo_key").alias("key")), "doc_id").join(vote, "ne")
    x = x.join(canon, "ne", "left").withColumn("canon", F.coalesce("representative", "ne"))
    x = x.join(vote.select(F.col("ne").alias("canon"), F.col("cat").alias("canon_cat")), "canon")
    return G.entity_edges(x)
