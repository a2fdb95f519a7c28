"""Queries over corpus audits, contracts and leakage."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vozlake import constants as C
from vozlake.functions import text as tx
from vozlake.operators import audit, joins
from vozlake.plans import oracle as o
from vozlake.plans.registry import Tables, query


def labelled(t: Tables) -> DataFrame:
    return t.documents.join(t.derived("truth"), "doc_id")


o.define("lab", "SELECT d.*, t.expected FROM documents d JOIN truth t USING (doc_id)")


@query("corpus_audit", o.with_ctes("""SELECT 'expected+source' AS distribution, expected, source, count(*) AS n FROM lab GROUP BY 2, 3 UNION ALL SELECT 'expected', expected, NULL, count(*) FROM lab GROUP BY 2
    UNION ALL SELECT 'source', NULL, source, count(*) FROM lab GROUP BY 3 UNION ALL SELECT 'rows', NULL, NULL, count(*) FROM lab"""))
def corpus_audit(t: Tables) -> DataFrame:
    return audit.distributions(labelled(t).select("expected", "source"), "expected", "source")


@query("duplicate_audit", o.with_ctes(f"""SELECT 'exact' AS check, count(*) AS rows, count(DISTINCT text) AS distinct_values, count(*) - count(DISTINCT text) AS duplicates FROM documents
    UNION ALL SELECT 'historical_clean', count(*), count(DISTINCT {o.historical('text')}), count(*) - count(DISTINCT {o.historical('text')}) FROM documents"""))
def duplicate_audit(t: Tables) -> DataFrame:
    return audit.duplicates(t.documents, {"exact": F.col("text"), "historical_clean": tx.historical_clean(F.col("text"))})


@query("label_conflicts", o.with_ctes(f"""SELECT md5({o.historical('text')}) AS digest, count(DISTINCT expected) AS labels, count(*) AS rows FROM lab GROUP BY 1 HAVING count(DISTINCT expected) > 1"""))
def label_conflicts(t: Tables) -> DataFrame:
    return audit.label_conflicts(labelled(t), tx.historical_clean(F.col("text")), "expected")


@query("language_label_conflicts", o.with_ctes(f"""SELECT md5({o.historical('text')}) AS digest, count(DISTINCT source) AS labels, count(*) AS rows FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1"""))
def language_label_conflicts(t: Tables) -> DataFrame:
    """The same audit with the source as the label: copies that cross batches."""
    return audit.label_conflicts(t.documents, tx.historical_clean(F.col("text")), "source")


o.define("split_rows", """SELECT *, CASE WHEN r <= ceil(n * 20 / 100.0) THEN 'test' ELSE 'train' END AS split FROM
    (SELECT doc_id, source, lang, text, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)""")


@query("stratified_split", o.with_ctes("SELECT doc_id, lang, split FROM split_rows"))
def stratified_split(t: Tables) -> DataFrame:
    return audit.stratified_split(t.documents.select("doc_id", "lang"), "doc_id", "lang")


o.define("split_parts", f"""SELECT DISTINCT doc_id, split, part FROM (SELECT doc_id, split, {o.historical('raw')} AS part FROM
    (SELECT doc_id, split, unnest(regexp_split_to_array(text, '[.!?]+')) AS raw FROM split_rows)) WHERE len(string_split(part, ' ')) >= 4""")
o.define("split_shared", "SELECT count(DISTINCT doc_id) AS n FROM split_parts WHERE split = 'test' AND part IN (SELECT part FROM split_parts WHERE split = 'train')")


@query("train_test_leakage", o.with_ctes("""SELECT count(*) AS test_rows, (SELECT n FROM split_shared) AS sharing_rows,
    round((SELECT n FROM split_shared) * 100.0::DOUBLE / count(*), 6) AS share_percentage FROM split_rows WHERE split = 'test'"""))
def train_test_leakage(t: Tables) -> DataFrame:
    split = audit.stratified_split(t.documents.select("doc_id", "lang", "text"), "doc_id", "lang")
    return audit.leakage(split, "doc_id")


o.define("bench_parts", f"""SELECT DISTINCT {o.historical('raw')} AS part FROM (SELECT unnest(regexp_split_to_array(text, '[.!?]+')) AS raw FROM benchmark)""")


@query("benchmark_overlap", o.with_ctes("SELECT DISTINCT doc_id FROM parts WHERE part IN (SELECT part FROM bench_parts)"))
def benchmark_overlap(t: Tables) -> DataFrame:
    """Comments sharing a cleaned sentence with the benchmark."""
    parts = tx.sentence_parts(F.col("text"))
    return joins.sharing_rows(t.documents, t.benchmark, "doc_id", parts)


@query("union_of_runs", o.with_ctes("""SELECT origin, count(*) AS parts, count(DISTINCT part) AS distinct_parts FROM (
    SELECT 'documents' AS origin, part FROM parts UNION ALL SELECT 'benchmark', part FROM bench_parts WHERE len(string_split(part, ' ')) >= 4) GROUP BY 1"""))
def union_of_runs(t: Tables) -> DataFrame:
    """Parts of two sources stacked by name, counted with and without repeats."""
    parts = tx.sentence_parts(F.col("text"))
    documents = t.documents.select(F.lit("documents").alias("origin"), F.explode_outer(parts).alias("part"))
    benchmark = t.benchmark.select(F.lit("benchmark").alias("origin"), F.explode_outer(parts).alias("part")).distinct()
    stacked = documents.unionByName(benchmark).filter(F.col("part").isNotNull())
    digests = stacked.groupBy("origin", F.unhex(F.md5("part")).alias("digest")).agg(F.count(F.lit(1)).alias("n"))
    return digests.groupBy("origin").agg(F.sum("n").alias("parts"), F.count(F.lit(1)).alias("distinct_parts"))


@query("id_difference", o.with_ctes("""SELECT 'missing' AS side, case_id FROM (SELECT case_id FROM packet_a_clean EXCEPT SELECT case_id FROM packet_b)
    UNION ALL SELECT 'additional', case_id FROM (SELECT case_id FROM packet_b EXCEPT SELECT case_id FROM packet_a_clean)"""))
def id_difference(t: Tables) -> DataFrame:
    a, b = t.derived("packet_a_clean").select("case_id"), t.derived("packet_b").select("case_id")
    return a.subtract(b).select(F.lit("missing").alias("side"), "case_id").unionByName(b.subtract(a).select(F.lit("additional").alias("side"), "case_id"))


@query("id_intersection", o.with_ctes("SELECT case_id FROM packet_a_clean INTERSECT SELECT case_id FROM packet_b"))
def id_intersection(t: Tables) -> DataFrame:
    return t.derived("packet_a_clean").select("case_id").intersect(t.derived("packet_b").select("case_id"))
