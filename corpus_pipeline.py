"""From documents to token ids: the training-text operators as stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the shared
folder and gives the next stage what it reads back.  All but the last return the columns of ``documents``:

1. documents scored as toxic go;
2. of near-duplicates (five-word shingles, similarity 0.8) the one with the smallest id stays;
3. documents in which a window of the benchmark occurs go;
4. sources are mixed to their target weights; a document that is taken again is a row again;
5. token ids are written in binary blocks and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.llm import decontaminate, mixing, neardup, tokens, toxicity
from earshot.llm.common import crc_fold
from earshot.llm.queries import table, tokenizer_path
from earshot.sources.shared import bound_batches, new_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    model = toxicity.fit_toxicity(marked.join(labels, "doc_id"), mark_col="mark", learn=crc_fold("doc_id", 3) != 1)
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return neardup.keep_one(docs, words=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    # The operator's short blocks: with long ones the quota of a small source rounds to nothing.
    return mixing.mix(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    path = tokens.write_tokens(docs, tokens.token_folder(spark), tokenizer_path())
    return tokens.read_tokens(spark, path)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token ids", write_token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: SQL cannot express the classifier, the seeded mix and the tokenizer; tests hold each stage against brute force.
ORACLE_SQL = None
