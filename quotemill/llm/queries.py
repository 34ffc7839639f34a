"""The registered queries of this subpackage, op<N>_<name>(spark, sf_dir), and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.llm import bpe_replay, chat_format, decontaminate, hard_negatives, huffman_tokens, jaccard_join, language_id, lm_scoring, packing, periodic_runs, quality_classifier, quality_rules, suffix_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(spark, _table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ppl")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify_quality(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_huffman_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman_tokens.token_digests(spark, _table(spark, sf_dir, "documents"), with_ids=False)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_language(spark, _table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark, _table(spark, sf_dir, "documents"))[0]


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(spark, _table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(spark, _table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(spark, _table(spark, sf_dir, "documents")).drop("kept")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    back = chat_format.parse_formatted(chat_format.format_conversations(turns.unionByName(extra)))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned_text").cast("long").alias("loss_chars"),
        F.sha2("learned_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(spark, _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(*periodic_runs.periodic_runs(spark, _table(spark, sf_dir, "documents"), periodic_runs.planted))


def op13_bpe_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_replay.encoded_digests(spark, _table(spark, sf_dir, "documents"))


OP10_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as k, length(text) + length(text) - length(replace(text, '\', '')) + length(text) - length(replace(text, '<', '')) + length(text) - length(replace(text, '[', '')) as chars,
    length(replace(replace(replace(replace(role, '\', '\\'), '<', '\f'), '[', '\g'), chr(10), '\n')) as role_chars,
    lag(role) over (partition by conv_id order by turn nulls first, role, text) as before
  from t)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  coalesce(sum(case when role = 'assistant' then length(text) end), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by k), '')) as loss_sha256,
  sum(13 + role_chars + chars + 11)::bigint as formatted_chars,
  bool_and(coalesce(case when before is null and k = 1 then role in ('system', 'user') when before = 'system' then role = 'user' and k = 2
    when before = 'user' then role = 'assistant' when before = 'assistant' then role = 'user' else false end, false))
    and arg_max(role, k) = 'assistant' as valid
from e group by conv_id
"""

OP11_SQL = r"""
with e as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, r.vec_id as row_id, a.label = r.label as same, list_dot_product(a.v, r.v)::bigint as score
  from e a join e r on a.vec_id % 100 = 0 and a.vec_id <> r.vec_id),
p as (select anchor_id, row_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, row_id) <= 5)
select anchor_id, positive_id, (row_number() over (partition by anchor_id, positive_id order by score desc, row_id))::integer as rank, row_id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify rank <= 10
"""

QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_quality_rules, op3_quality_classifier, op4_huffman_tokens, op5_language_id, op6_packing, op7_lm_scoring, op8_jaccard_join, op9_suffix_dedup, op10_chat_format, op11_hard_negatives, op12_periodic_runs, op13_bpe_replay)}
ORACLE_SQL = {"op10_chat_format": OP10_SQL, "op11_hard_negatives": OP11_SQL}
