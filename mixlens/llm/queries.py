"""One query per operator, over its whole table, with production parameters.

SQL that DuckDB runs on the same tables is given where SQL can express the
result; the other queries are tested against brute force in tests/llm.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixlens.llm import (
    counts, embed, lexical, lines, mih, mixture, packing, quality, quotes, repair, simhash, turns, wordtable)
from mixlens.llm import sql
from mixlens.llm.common import table

SCORE_CUT = 0.7


def vocabulary_path(name: str) -> str:
    """A public vocabulary file: under ``TOKENIZERS_DIR`` if set, else where the
    installed package of vocabulary files keeps it."""
    home = os.environ.get("TOKENIZERS_DIR")
    if home:
        return os.path.join(home, name)
    import public_tokenizers
    return str(public_tokenizers.path(name))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality.score(docs.select("doc_id", "text"), quality.fit(docs, labels))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= SCORE_CUT).cast("int").alias("predicted"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs).select("doc_id", "n_lines", "n_kept", "text")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_duplicates(table(spark, sf_dir, "embeddings"), 0.9)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"),
                                    capacity=1024, end_id=2)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = counts.prefix_counts(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op6_quotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(table(spark, sf_dir, "conversations"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", mih.sign_code(F.col("embedding")).alias("code"))
    return mih.top_k(rows, F.col("vec_id") % 20 == 0, k=10)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, max_bits=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = repair.written(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"), end_id=2)
    return repair.read_documents(files)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordtable.encode_decode(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"),
                                   with_values=False)


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair_report(turns.damaged(table(spark, sf_dir, "conversations")))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixture.mixed(docs, weights=(5, 2, 1), max_copies=3).select("doc_id", "size", "source_size", "target", "taken")


def op13_lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


QUERIES = {f.__name__: f for f in (op1_quality, op2_line_dedup, op3_embedding_dedup, op4_packing, op5_token_counts,
                                   op6_quotation, op7_topk, op8_simhash, op9_repair, op10_bpe,
                                   op11_structure_repair, op12_source_mix, op13_lexical_topk)}

ORACLE_SQL = {
    # cosine links over all pairs, and the smallest vector reachable by them
    "op3_embedding_dedup": """
with recursive v as (
  select vec_id, embedding::double[] e, sqrt(list_dot_product(embedding::double[], embedding::double[])) n
  from embeddings where embedding is not null),
links as (
  select a.vec_id a, b.vec_id b from v a join v b on a.vec_id <> b.vec_id
   and a.n > 0 and b.n > 0 and list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
reach as (select vec_id node, vec_id seen from embeddings
          union select r.node, l.b from reach r join links l on l.a = r.seen),
comp as (select node, min(seen) c from reach group by 1),
deg as (select a, count(*) n from links group by 1)
select e.vec_id, coalesce(d.n, 0)::bigint n_links, c.c component_id, c.c = e.vec_id kept
from embeddings e join comp c on c.node = e.vec_id left join deg d on d.a = e.vec_id""",
    # Hamming distances of the sign bits, all rows against every twentieth
    "op7_topk": """
with c as (select vec_id, [case when x >= 0 then 1 else 0 end for x in embedding] b from embeddings),
d as (select q.vec_id query_id, r.vec_id neighbour_id,
             cast(list_sum([abs(p[1] - p[2]) for p in list_zip(q.b, r.b)]) as int) distance
      from c q join c r on q.vec_id <> r.vec_id where q.vec_id % 20 = 0),
k as (select *, cast(row_number() over (partition by query_id order by distance, neighbour_id) as int) rank from d)
select query_id, neighbour_id, distance, rank from k where rank <= 10""",
    "op11_structure_repair": sql.STRUCTURE_REPAIR,
    "op12_source_mix": sql.SOURCE_MIX,
    "op13_lexical_topk": sql.LEXICAL_TOPK,
}
