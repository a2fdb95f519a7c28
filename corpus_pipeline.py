"""Documents to training sequences: toxicity, near duplicates, benchmark leaks, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on every row that the stage before it kept; all but the last return the columns
of documents. :func:`run` stores each stage's rows in the shared folder and reads them back.

Rows of any stage: null and repeated keys, null and empty texts and further columns (of any name) are allowed; an empty table gives
an empty one. A null text is not toxic, is near to nothing, has no leak and no secret, and packs as its end token.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vozlake.durable import cut
from vozlake.llm import decontaminate, jaccard, packing, secrets, severity

#: words of a shingle and least similarity, in percent, of near duplicates
NEAR_WORDS, NEAR_PERCENT = 5, 80


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows under column names that clash with none of an operator's, and those names by column."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a toxic grade is more likely than not. Fitted on the labelled ones among ``docs``."""
    plain, c = _plain(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(
        F.col("doc_id").alias(c["doc_id"]), "quality", "toxic")
    model = severity.fit(plain, labels, severity.label_grade(), key=c["doc_id"], text=c["text"])
    scored = severity.score(plain, model, text=c["text"], keep=list(c.values()))
    return scored.filter(F.col("p_toxic") <= 0.5).select(*c.values()).toDF(*c)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates stays: that with the smallest doc_id (a null one counts as larger than all
    others), and of several with that doc_id the one whose text has the smallest digest.

    Rows of equal doc_id and text are one document."""
    plain, c = _plain(docs)
    key, text = F.col(c["doc_id"]), F.col(c["text"])
    # nulls of a struct come first, so a flag before each part puts them last
    name = F.struct(key.isNull().alias("no_id"), key.alias("id"), text.isNull().alias("no_text"), F.unhex(F.md5(text)).alias("digest"))
    named = plain.withColumn("_name", name)
    found = jaccard.join(named, key="_name", text=c["text"], words=NEAR_WORDS, percent=NEAR_PERCENT)
    stays = cut(found.filter(F.col("_name") == F.col("component_id")).groupBy("_name").agg(F.count(F.lit(1)).alias("_n")), "near")
    kept = named.join(stays, "_name")
    # only rows that share a doc_id and a text can be repeats
    single = kept.filter(F.col("_n") == 1).select(*c.values())
    shared = kept.filter(F.col("_n") > 1).dropDuplicates(["_name"]).select(*c.values())
    return single.unionByName(shared).toDF(*c)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of a benchmark item occurs."""
    plain, c = _plain(docs)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contamination(plain.withColumn("_row", F.lit(0)), benchmark, key="_row", text=c["text"], keep=list(c.values()))
    return found.filter(F.col("n_hit") == 0).select(*c.values()).toDF(*c)


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in place of every secret; n_chars follows the text. No document goes."""
    plain, c = _plain(docs)
    text = c["text"]
    out = secrets.redact(plain.withColumn("_before", F.length(text)), text=text)
    if "n_chars" in c:
        kind = plain.schema[c["n_chars"]].dataType
        changed = F.length(text) != F.col("_before")
        out = out.withColumn(c["n_chars"], F.when(changed, F.length(text).cast(kind)).otherwise(F.col(c["n_chars"])))
    return out.select(*c.values()).toDF(*c)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("benchmark_leaks", leaks), ("secrets", redaction),
    ("packing", packed),
]

#: SQL can't express the tokenizer or the fitted model; tests/llm compares the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
