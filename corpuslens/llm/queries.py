"""The queries opN_<name>, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm import alignment, bpe, chat_format, conversation_repair, decontamination, embedding_dedup, line_dedup, lm_scoring, packing, quality, simhash_dedup, substring_dedup, toxicity
from corpuslens.llm.common import stage


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(_read(spark, sf_dir, "documents"), length=50)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_groups(_read(spark, sf_dir, "embeddings"), threshold=0.98)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_boilerplate(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "n_lines", "n_dropped", F.md5("text").alias("kept_md5"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), size=1024, end=2)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"))
    messages = stage(chat_format.messages_of_turns(turns), "messages")
    formatted = chat_format.format_paths(chat_format.best_paths(messages), messages)
    return formatted.select(F.col("root.conv_id").alias("conv_id"), chat_format.digest("formatted").alias("d")).select("conv_id", "d.*")


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_groups(_read(spark, sf_dir, "documents"), words=4, bits=4)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), fold=5, remainder=0)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_lm(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels").where("quality = 1"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), fold=4, remainder=2, threshold=0.7)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = bpe.decode(bpe.encode(_read(spark, sf_dir, "documents"), path), path)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations")
    return conversation_repair.repair_all(turns, conversation_repair.damage(turns))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_substring_dedup, op2_decontamination, op3_embedding_dedup, op4_line_dedup, op5_best_fit_packing, op6_chat_format, op7_simhash_dedup, op8_toxicity, op9_lm_scoring, op10_quality, op11_alignment, op12_bpe, op13_conversation_repair, pipeline)
}

#: 50-word windows, the smallest doc_id in which each starts, and the words that no repeated window covers.
OP1 = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, unnest(range(1, len(ws) - 48)) AS i, ws FROM w WHERE len(ws) >= 50
), h AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS win FROM s
), m AS (
  SELECT win, min(doc_id) AS low FROM h GROUP BY win HAVING min(doc_id) < max(doc_id)
), c AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM h JOIN m USING (win) WHERE doc_id > low
), g AS (
  SELECT doc_id, list(p) AS ps FROM c GROUP BY doc_id
), k AS (
  SELECT w.doc_id, len(ws) AS n_words, coalesce(len(ps), 0) AS n_removed,
    CASE WHEN ps IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(ps, i)) END AS kept
  FROM w LEFT JOIN g USING (doc_id)
)
SELECT doc_id, n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""

#: The same rows from the same definition: a line that several pages have, over 0.05 of their source's, goes.
OP4 = """
WITH d AS (
  SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents
), t AS (
  SELECT source, count(*) AS pages FROM documents GROUP BY source
), l AS (
  SELECT source, unnest(list_distinct(ls)) AS line FROM d
), b AS (
  SELECT l.source, list(line) AS bad FROM (
    SELECT source, line, count(*) AS n FROM l WHERE trim(line) <> '' GROUP BY source, line HAVING count(*) > 1
  ) l JOIN t ON l.source = t.source WHERE n > 0.05 * pages GROUP BY l.source
), k AS (
  SELECT doc_id, d.source, ls, CASE WHEN bad IS NULL THEN ls ELSE list_filter(ls, lambda x: NOT list_contains(bad, x)) END AS kept
  FROM d LEFT JOIN b ON d.source = b.source
)
SELECT doc_id, source, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(kept) AS BIGINT) AS n_dropped,
  md5(array_to_string(kept, chr(10))) AS kept_md5 FROM k
"""

#: Numbers of links and components by following smaller ids until nothing changes.
OP3 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), r(vec_id, seen) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.y FROM r JOIN l ON r.seen = l.x
), c AS (
  SELECT vec_id, min(seen) AS component_id FROM r GROUP BY vec_id
)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.x = v.vec_id) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN c ON v.vec_id = c.vec_id
"""

ORACLE_SQL = {"op1_substring_dedup": OP1, "op3_embedding_dedup": OP3, "op4_line_dedup": OP4}
