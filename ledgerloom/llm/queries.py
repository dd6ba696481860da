"""The registered queries of the operators here, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, edits, jaccard_join, langid, mixing, negatives, sharding, token_index, topk, toxicity, unigram, urls, winnowing
from .common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_index.round_trip(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


#: The contract's rules.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op2_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    out = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return out.select("page_id", F.col("_url_host").alias("host"), F.col("_url_path").alias("path"), F.col("_url_rule").alias("rule"), F.col("_url_verdict").alias("verdict"), F.col("_url_template").alias("template"))


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text, and how alike they and the next document's are."""
    return winnowing.edited_fingerprints(table(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of the repaired and rendered conversations."""
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all other vectors for each vector whose id is divisible by 50."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every text: their number, how many are bytes, a digest, and whether they decode to the text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = unigram.encode(docs, tokenizer("piece_bpe_32k.model"), decoded=True)
    return out.select(
        "doc_id",
        F.size("_sp_ids").cast("long").alias("n_pieces"),
        F.xxhash64("_sp_ids").alias("ids_xxhash64"),
        (F.col("_sp_text") == F.coalesce("text", F.lit(""))).alias("decodes"),
    )


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's language, learnt from the documents that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(~langid.is_held_out()))
    out = langid.predict(docs.select("doc_id", "text", langid.is_held_out().alias("held_out")), model)
    return out.select("doc_id", "held_out", F.col("_lang_pred").alias("lang_pred"), F.col("_lang_score").alias("score"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at 85 of 100 over 4-word shingles; the least document id that links reach."""
    found = jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)
    return found.select(jaccard_join.plain_id("key").alias("doc_id"), "n_shingles", jaccard_join.plain_id("component").alias("component_id"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell, tokens, raked weight, probability and draw of every document."""
    rows = mixing.mix(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        F.col("_mix_source").alias("source"),
        F.col("_mix_lang").alias("lang"),
        F.col("_mix_topic").alias("topic"),
        F.col("_mix_tokens").cast("long").alias("n_tokens"),
        F.col("_mix_weight").alias("weight"),
        F.col("_mix_probability").alias("probability"),
        F.col("_mix_kept").alias("kept"),
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 shards of near equal bytes; documents of equal text stay together."""
    out = sharding.shard_documents(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's toxicity, learnt from the labels that aren't held out, and its sentences to blame."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~toxicity.is_held_out()))
    out = toxicity.predict(docs.withColumn("held_out", toxicity.is_held_out()), model)
    return out.select("doc_id", "held_out", F.col("_tox_score").alias("score"), (F.col("_tox_score") >= 0.5).cast("int").alias("predicted"), F.col("_tox_spans").alias("spans"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation, and its cheapest repair."""
    out = edits.repair(edits.damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))
    return out.select(edits.plain_conversation(), *edits.RESULT, "audit", "repaired_sha256")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the positives of each vector whose id is divisible by 100; a seventh of the labels are moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), "embedding")
    return negatives.hard_negatives(rows, lambda i: i % 100 == 0)


QUERIES = {f.__name__: f for f in (op1_token_index, op2_url_templates, op3_winnowing, op4_chat, op5_topk, op6_sentencepiece, op7_langid, op8_jaccard_join, op9_mixing, op10_sharding, op11_toxicity, op12_conversation_repair, op13_hard_negatives)}
#: CRC-32 of short texts, bit by bit: a step for each bit, which takes in a byte before the first of eight.
_CRC = "xor(list_reduce(list_transform(range(0, 8 * strlen({0})), lambda i: case when i % 8 = 0 then cast(('0x' || substr(hex({0}::blob), cast(i // 4 + 1 as integer), 2)) as bigint) else 0 end), lambda c, x: xor(xor(c, x) >> 1, case when xor(c, x) & 1 = 1 then 3988292384 else 0 end), 4294967295), 4294967295)"
_INSERT = lambda x, role: f"case when {x} is not null then {{'c': {x}.c + 2, 'a': {x}.a || 'I', 'r': {x}.r || chr(10) || '{role}:'}} end"
_KEEP = lambda x: f"case when {x} is not null then {{'c': {x}.c + t, 'a': {x}.a || 'K', 'r': {x}.r || chr(10) || role || ':' || text}} end"
_REROLE = lambda x, role: f"case when {x} is not null then {{'c': {x}.c + t + 2, 'a': {x}.a || 'R', 'r': {x}.r || chr(10) || '{role}:' || text}} end"
_DELETE = lambda x: f"case when {x} is not null then {{'c': {x}.c + 3, 'a': {x}.a || 'D', 'r': {x}.r}} end"
#: With turns put in: z, s, u, a are the cheapest (cost, audit, text) of each state.
_PUT_IN = lambda source: f"select * replace (least(a, {_INSERT('u', 'assistant')}) as a) from (select * replace (least(u, {_INSERT('z', 'user')}, {_INSERT('s', 'user')}, {_INSERT('a', 'user')}) as u) from ({source}))"
_OF_KIND = lambda x, *more: f"case when kind in ('b', 'd') then {_DELETE(x)} else least({', '.join([_DELETE(x), *more])}) end"
_IF = lambda i, x: f"case when left(role, 1) = '{i}' then {_KEEP(x)} end"
_REPAIR = f"""
with recursive d as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, concat(coalesce(cast(conv_id as varchar), ' '), ':', coalesce(cast(turn as varchar), ' ')) as k from conversations),
x as (select conv_id, turn, case when luck = 4 then 'user' else role end as role, case luck when 1 then '' when 2 then translate(text, '.!?', '') else text end as text
 from (select *, {_CRC.format("k")} % 20 as luck from d), range(2) copy(i) where luck <> 0 and (i = 0 or luck = 3)),
f as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as n, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as kept from x),
g as (select *, case when kept = '' then 'b' when row_number() over (partition by conv_id, role, text order by n) > 1 then 'd' when right(kept, 1) not in ('.', '!', '?') then 't' else '' end as kind from f),
rows_ as (select *, case when kind = 't' then 1 else 0 end as t, lag(role) over (partition by conv_id order by n) as before from g),
dp as (select distinct conv_id, cast(0 as bigint) as n, {{'c': cast(0 as bigint), 'a': '', 'r': ''}} as z, cast(null as struct(c bigint, a varchar, r varchar)) as s, cast(null as struct(c bigint, a varchar, r varchar)) as u, cast(null as struct(c bigint, a varchar, r varchar)) as a from conversations
 union all select conv_id, n, {_OF_KIND("z")}, {_OF_KIND("s", _IF("s", "z"))}, {_OF_KIND("u", _REROLE("z", "user"), _REROLE("s", "user"), _REROLE("a", "user"), _IF("u", "z"), _IF("u", "s"), _IF("u", "a"))}, {_OF_KIND("a", _REROLE("u", "assistant"), _IF("a", "u"))}
 from ({_PUT_IN("select r.conv_id, r.n, r.kind, r.role, r.text, cast(r.t as bigint) as t, dp.z, dp.s, dp.u, dp.a from dp join rows_ r on r.conv_id is not distinct from dp.conv_id and r.n = dp.n + 1")})),
ended as (select conv_id, least(z, a) as best from ({_PUT_IN("select * from dp qualify row_number() over (partition by conv_id order by n desc) = 1")})),
told as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(case when kind = 'b' then 1 end) as blank, count(case when kind = 'd' then 1 end) as duplicate, count(case when kind = 't' then 1 end) as truncated,
 count(case when n > 1 and left(before, 1) || left(role, 1) not in ('su', 'ua', 'au') then 1 end) as illegal from rows_ group by conv_id)
select e.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, best.c as cost, best.a as audit, sha256(substr(best.r, 2)) as repaired_sha256
from ended e left join told t on t.conv_id is not distinct from e.conv_id"""
ORACLES = {
    "op5_topk": """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e from embeddings
  where embedding is not null and len(embedding) > 0 and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
p as (
  select q.vec_id as query_id, c.vec_id as vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from p)
select query_id, rank, vec_id, score from r where rank <= 5""",
    "op12_conversation_repair": _REPAIR,
    "op13_hard_negatives": """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e from embeddings
  where label is not null and embedding is not null and len(embedding) > 0 and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
s as (
  select a.vec_id as anchor_id, c.vec_id as other, a.label = c.label as same, cast(list_sum(list_transform(list_zip(a.e, c.e), lambda z: z[1] * z[2])) as bigint) as score
  from v a join v c on a.vec_id <> c.vec_id where a.vec_id % 100 = 0),
p as (select anchor_id, other as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, other) <= 5),
n as (
  select p.*, other as negative_id, score as negative_score, cast(row_number() over (partition by p.anchor_id, positive_id order by score desc, other) as integer) as rank
  from p join s on s.anchor_id = p.anchor_id and not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 10""",
}
