"""The corpus pipeline: five stages over documents, each written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import decontaminate, langid, packing, simhash, substring
from tidewright.llm.common import stored, table

#: The packing stage's vocabulary.
VOCABULARY = "word_bpe_49k.json"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language the network names with some certainty; `und` and doubtful ones
    go. lang becomes the prediction where it was null. All columns of docs stay."""
    net = langid.train(docs)
    found = langid.identify(docs, net)
    sure = found.where((F.col("lang_pred") != "und") & langid.certain(F.col("score"), net))
    return sure.select(*[F.coalesce("row.lang", "lang_pred").alias(c) if c == "lang" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep each SimHash component's document with the smallest doc_id. Rows without an id, and all
    rows of the id that stays, are kept."""
    classes = simhash.simhash_components(docs)
    gone = classes.where(F.col("doc_id") > F.col("component_id")).select("doc_id").distinct()
    return docs.join(gone.hint("shuffle_merge"), "doc_id", "left_anti").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out spans of 50 words and more that an earlier document has; documents with nothing left
    go, those that lost nothing keep their text as it was. Columns but text and n_chars stay as they are."""
    cut = substring.substring_dedup(docs, only_cut=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row.text"))
    left = cut.where(F.col("n_removed") < F.greatest("n_words", F.lit(1)))
    n = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))
    new = {"text": text, "n_chars": n}
    return left.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold an item of the benchmark table."""
    hit = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"), least=1).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct()
    same = docs["doc_id"].eqNullSafe(hit["_id"]) & (F.xxhash64(docs["text"]) == hit["_th"])
    return docs.join(hit, same, "left_anti")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all that is left into sequences of 2048 ids."""
    return packing.pack(packing.pieces(docs, VOCABULARY))


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", packing_stage),
]

#: Fingerprints, the network and the tokenizer are beyond SQL: the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
