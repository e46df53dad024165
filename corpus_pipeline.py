"""Five operators in a row: toxicity, line dedup, SimHash near-dedup, decontamination, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm import decontamination, line_dedup, packing, simhash_dedup, toxicity
from corpuslens.llm.common import free_name, perhaps_known, stage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5 stay; one of just 0.5 goes. Null and empty texts, repeated rows and null ids are scored like others; without labels every score is just under 0.5.

    Very long texts are scored whole. Other columns stay, whatever their names. No documents: none.
    """
    return toxicity.without_toxic(docs, toxicity.train(docs, _table(spark, sf_dir, "labels"), 5, 0))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go, every document stays, repeated ones and null texts too; n_chars follows the text (null for a null one). Null sources keep all lines.

    A line of just the ratio stays. Very long texts are read whole. Other columns stay, whatever their names. No documents: none.
    """
    out = line_dedup.drop_boilerplate(docs, counts=False).withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 or more of five-word shingles, the document with the smallest id stays.

    Of that id all rows in the group stay (repeated ones); a row of the same id whose text is in another group is judged there. Null and empty
    texts are a group of their own; null ids stay. A pair of just 0.8 is linked. Very long texts are compared whole. Other columns stay, whatever their names. No documents: none.
    """
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    groups = simhash_dedup.similar_groups(docs.where(F.col("doc_id").isNotNull()), words=5, similarity=0.8)
    copies = stage(groups.where("doc_id <> component_id").select("doc_id", "text_key").distinct(), "copies")
    # Rows that surely are none of the copies aren't shuffled.
    flag = free_name(docs.columns, "perhaps")
    rows = perhaps_known(docs, F.xxhash64(F.col("doc_id").cast("long"), key), copies, F.xxhash64("doc_id", "text_key"), flag)
    kept = rows.where(flag).join(copies, (rows["doc_id"] == copies["doc_id"]) & (key == copies["text_key"]), "left_anti")
    return rows.where(~F.col(flag)).unionByName(kept).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go, each row by its own text; null and empty texts stay, and so does all without items.

    A passage of just the distance counts. Very long texts are searched whole; repeated rows and null ids go or stay like others. Other columns stay, whatever their names. No documents: none.
    """
    return decontamination.drop_leaks(docs, _table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, placed in sequences of 1024 tokens; every row is packed, repeated ones too, null and empty texts as the end token alone.

    Very long texts are cut into pieces. Pieces of one length are placed by doc_id and piece. Columns are those of the pieces: documents' own end here. No documents: no sequences.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("simhash_near_dedup", drop_near_copies), ("benchmark_decontamination", drop_leaks), ("best_fit_packing", pack)]

#: SQL can express neither the classifier nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again before the next one."""
    docs = _table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
