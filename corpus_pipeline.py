"""Documents made ready for training: five stages, each over all rows the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nbgauge.llm import decontaminate, language, packing, simhash, substrings
from nbgauge.llm.common import fresh, table
from nbgauge.session import shared_dir

#: Share of a document's words that must be in its main language.
MAIN_LANGUAGE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose main language has at least half of their words."""
    (found,) = fresh(docs, "_language")
    model = language.fit_languages(docs)
    kept = language.with_language(docs, model, found).where((F.col(f"{found}.lang") != "und") & (F.col(f"{found}.score") >= MAIN_LANGUAGE))
    return kept.drop(found)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id: fingerprints of three-word shingles that differ in three bits at most."""
    return simhash.one_per_group(docs, size=3, budget=3)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that stand earlier; documents of which nothing is left go."""
    columns = docs.columns
    found = substrings.remove_repeats(docs)
    n_words, n_removed, _, _, text = found.columns[len(columns) :]
    found = found.where(~((F.col(n_removed) > 0) & (F.col(n_removed) == F.col(n_words))))
    changed = F.col(n_removed) > 0
    out = {c: F.col(f"`{c}`") for c in columns}
    out["text"] = F.when(changed, F.col(text)).otherwise(F.col("text"))
    if "n_chars" in out:
        out["n_chars"] = F.when(changed, F.length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.select(*[value.alias(c) for c, value in out.items()])


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark, also with other numbers or names."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack_into_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in bins."""
    return packing.best_fit(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", remove_repeated_passages),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("best_fit_packing", pack_into_bins),
]

#: Fingerprints, automata and best-fit search are beyond SQL; tests/llm compares with a brute-force run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written and read again."""
    import uuid

    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
