"""Registered queries: each applies one operator with production parameters to its whole table.

Most have no SQL check because SQL can't express the work (tokenizers, hashed sets and fixpoints over large tables); ``tests/llm``
compares them with brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from vozlake.durable import scratch
from vozlake.llm import (
    decontaminate, fixity, jaccard, lexical, packing, periodic, quality, secrets, severity, simhash, substring, tokenfile, urls,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def query(name: str):
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        return fn

    return wrap


@query("op1_merkle_fixity")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """All pages as WARC archives, and a replica in which some records have other bytes or one more; both are written, read and audited.

    The damage is planted by a rule on the page's number so that there is something to find; every record is hashed."""
    pages = table(spark, folder, "pages")
    damaged = pages.withColumn("html", F.when(F.col("page_id") % 97 == 5, F.translate("html", "e", "3")).when(
        F.col("page_id") % 1999 == 7, F.concat("html", F.lit("!"))).otherwise(F.col("html")))
    first = fixity.write_warc(pages, scratch(spark, "warc"))
    second = fixity.write_warc(damaged, scratch(spark, "warc"))
    return fixity.audit(fixity.read_records(spark, first), fixity.read_records(spark, second))


@query("op2_block_anchors")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return substring.deduplicate(table(spark, folder, "documents"))


@query("op3_best_fit_packing")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


@query("op4_grouped_prefix_join")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.join(table(spark, folder, "documents"), words=3, percent=90)


@query("op5_distribution_divergence")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return quality.rules(table(spark, folder, "documents"))


@query("op6_aho_corasick")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.digests(decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark")))


@query("op7_redirect_equivalence")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(table(spark, folder, "pages"))


@query("op8_credential_linking")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.report(secrets.scan(table(spark, folder, "documents")))


@query("op9_ordinal_toxicity")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Severity of every document, and whether it is rejected (a grade above the lowest is more likely than not)."""
    documents = table(spark, folder, "documents")
    model = severity.fit(documents, table(spark, folder, "labels"), severity.label_grade())
    return severity.score(documents, model).withColumn("toxic", F.col("p_toxic") > 0.5)


@query("op10_token_files")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return tokenfile.round_trip(table(spark, folder, "documents"))


@query("op11_periodic_runs")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return periodic.find(table(spark, folder, "documents"), arrange=periodic.looped)


@query("op12_gray_simhash")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.classes(table(spark, folder, "documents"))


@query("op13_pair_maxscore")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(lexical.build(table(spark, folder, "documents")), table(spark, folder, "benchmark"))


_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

ORACLES["op13_pair_maxscore"] = f"""
WITH held AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
     lengths AS (SELECT doc_id, count(*)::BIGINT AS n FROM held GROUP BY doc_id),
     totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM lengths),
     counts AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM held GROUP BY doc_id, term),
     asked AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark)),
     weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
                 FROM counts, totals GROUP BY term),
     scored AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))))::BIGINT AS score
                FROM asked JOIN counts USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), totals
                GROUP BY item_id, doc_id),
     ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
                FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10
"""
