"""Queries over files: ingest, contracts, exports, journals, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vozlake import constants as C
from vozlake.durable import scratch
from vozlake.functions import text as tx
from vozlake.operators import audit, costs
from vozlake.plans import oracle as o
from vozlake.plans.metric_queries import cases
from vozlake.plans.model_queries import scored
from vozlake.plans.registry import Tables, query
from vozlake.operators import evaluation as ev
from vozlake.sources import contracts, delimited, journal


def _export(t: Tables, df: DataFrame, name: str, **options) -> str:
    path = scratch(t.spark, name)
    delimited.write_delimited(df, path, **options)
    return path


@query("csv_ingest", "SELECT doc_id::VARCHAR AS doc_id, lang, md5(text) AS digest FROM documents")
def csv_ingest(t: Tables) -> DataFrame:
    """Comments with quotes and line breaks written as CSV, sniffed and read back."""
    path = _export(t, t.documents.select("doc_id", "lang", "text"), "csv")
    rows, _ = delimited.read_delimited(t.spark, path, multi_line=True)
    return rows.select("doc_id", "lang", F.md5("text").alias("digest"))


@query("csv_quarantine", """SELECT false AS broken, concat_ws(',', conv_id, turn, role) AS line FROM conversations WHERE conv_id % 2 = 0
    UNION ALL SELECT true, concat_ws(',', conv_id, turn, role, 'surplus') FROM conversations WHERE conv_id % 2 = 1""")
def csv_quarantine(t: Tables) -> DataFrame:
    """Lines with too many fields are set aside instead of failing the job."""
    path = scratch(t.spark, "quarantine")
    lines = t.conversations.select(F.concat_ws(",", "conv_id", "turn", "role", F.when(F.col("conv_id") % 2 == 1, "surplus")).alias("conv_id,turn,role"))
    lines.write.option("header", True).option("sep", "\x1f").option("quote", "").csv(path)
    rows, quarantined = delimited.read_delimited(t.spark, path)
    good = rows.select(F.lit(False).alias("broken"), F.concat_ws(",", "conv_id", "turn", "role").alias("line"))
    return good.unionByName(quarantined.select(F.lit(True).alias("broken"), "line"))


o.define("one_column", f"SELECT {o.historical('text')} AS line FROM documents")


@query("csv_single_column", o.with_ctes("SELECT line AS comentario, count(*) AS n FROM one_column WHERE length(line) > 0 GROUP BY 1"))
def csv_single_column(t: Tables) -> DataFrame:
    """No delimiter in the header: each whole line is one value, commas included."""
    path = scratch(t.spark, "lines")
    cleaned = t.documents.select(tx.historical_clean(F.col("text")).alias("comentario")).filter("comentario <> ''")
    cleaned.write.option("header", True).option("sep", "\x1f").option("quote", "").csv(path)
    rows, _ = delimited.read_delimited(t.spark, path)
    return rows.groupBy("comentario").agg(F.count(F.lit(1)).alias("n"))


@query("delimited_raw_scan", "SELECT doc_id::VARCHAR AS doc_id, lang, source, n_chars::VARCHAR AS n_chars FROM documents")
def delimited_raw_scan(t: Tables) -> DataFrame:
    path = _export(t, t.documents.select("doc_id", "lang", "source", "n_chars"), "semicolon", delimiter=";")
    return delimited.read_delimited(t.spark, path)[0]


@query("benchmark_scan", "SELECT true AS columns_ok, count(*) AS rows, (count(*) FILTER (item_id IS NULL) + count(*) FILTER (text IS NULL)) AS null_cells, count(*) > 0 AND count(item_id) = count(*) AND count(text) = count(*) AS ok FROM benchmark")
def benchmark_scan(t: Tables) -> DataFrame:
    return contracts.benchmark_report(t.benchmark, ("item_id", "text"))


o.define("contract_in", "SELECT d.doc_id, d.text, d.lang, t.expected FROM documents d JOIN truth t USING (doc_id)")


@query("dataset_contract", o.with_ctes("""SELECT c.check, c.observed, c.expected, c.observed = c.expected AS ok FROM (
    SELECT 'rows' AS check, count(*) AS observed, (SELECT count(*) FROM labels) AS expected FROM contract_in UNION ALL
    SELECT 'bad_keys', count(*) - count(DISTINCT doc_id), 0 FROM contract_in UNION ALL SELECT 'short_texts', count(*) FILTER (length(""" + o.strip("coalesce(text, '')") + """) < 2), 0 FROM contract_in UNION ALL
    SELECT 'class_Negativo', count(*) FILTER (expected = 'Negativo'), 74 FROM contract_in UNION ALL SELECT 'class_Neutro', count(*) FILTER (expected = 'Neutro'), 15 FROM contract_in UNION ALL
    SELECT 'class_Positivo', count(*) FILTER (expected = 'Positivo'), 15 FROM contract_in UNION ALL SELECT 'foreign_rows', count(*) FILTER (lang <> 'en'), 0 FROM contract_in) c"""))
def dataset_contract(t: Tables) -> DataFrame:
    """Contract of a labelled set: the class counts and the constant origin are broken here."""
    rows = t.documents.join(t.derived("truth"), "doc_id").select("doc_id", "text", "lang", "expected")
    size = t.labels.agg(F.count(F.lit(1))).scalar()
    return contracts.dataset_contract(rows, "doc_id", "text", "expected", "lang", size, {C.NEGATIVE: 74, C.NEUTRAL: 15, C.POSITIVE: 15}, "en")


_ROW = " || ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "lang", "source", "text"))
_DIGEST = " || ':' || ".join(f"sum(('0x' || sha256({_ROW})[{k}:{k + 15}])::UBIGINT)::VARCHAR" for k in (1, 17))


@query("frozen_manifest", f"SELECT source, count(*) AS rows, {_DIGEST} AS digest FROM documents GROUP BY 1")
def frozen_manifest(t: Tables) -> DataFrame:
    return audit.table_digest(t.documents, ["doc_id", "lang", "source", "text"], ["source"])


_CHANGED = "CASE WHEN source = 'src3' AND doc_id % 2 = 0 THEN concat(text, '!') ELSE text END"


@query("frozen_manifest_check", f"""WITH was AS (SELECT source, count(*) AS rows, {_DIGEST} AS digest FROM documents WHERE source IS DISTINCT FROM 'src5' GROUP BY 1),
    now AS (SELECT source, count(*) AS rows, {_DIGEST} AS digest FROM (SELECT * REPLACE ({_CHANGED} AS text) FROM documents WHERE source IS DISTINCT FROM 'src4') GROUP BY 1)
    SELECT coalesce(w.source, n.source) AS source, w.rows AS recorded_rows, n.rows AS rows, CASE WHEN w.rows IS NULL THEN 'added' WHEN n.rows IS NULL THEN 'missing'
      WHEN w.rows = n.rows AND w.digest = n.digest THEN 'unchanged' ELSE 'changed' END AS status FROM was w FULL JOIN now n ON w.source IS NOT DISTINCT FROM n.source""")
def frozen_manifest_check(t: Tables) -> DataFrame:
    """A recorded manifest against a table in which one batch changed, one is new and one is gone."""
    columns = ["doc_id", "lang", "source", "text"]
    path = scratch(t.spark, "manifest")
    audit.table_digest(t.documents.filter("NOT source <=> 'src5'"), columns, ["source"]).write.parquet(path)
    now = t.documents.filter("NOT source <=> 'src4'").withColumn("text", F.expr(_CHANGED))
    return audit.compare_digests(t.spark.read.parquet(path), audit.table_digest(now, columns, ["source"]), ["source"])


@query("manifest_distribution", o.with_ctes("SELECT lang, n <= 4 AS is_short, count(*) AS n, max(CASE WHEN n <= 4 THEN n END)::INTEGER AS longest_short FROM blank_split GROUP BY 1, 2".replace("count(*) AS n,", "count(*) AS cases,")))
def manifest_distribution(t: Tables) -> DataFrame:
    from vozlake.plans.text_queries import comments

    rows = comments(t).select("lang", tx.token_count(F.col("text")).alias("tokens"))
    short = F.col("tokens") <= C.SHORT_TEXT_TOKENS
    return rows.groupBy("lang", short.alias("is_short")).agg(F.count(F.lit(1)).alias("cases"), F.max(F.when(short, F.col("tokens"))).alias("longest_short"))


@query("source_fingerprint")
def source_fingerprint(t: Tables) -> DataFrame:
    """File identity needs file bytes, which the SQL views do not expose."""
    return contracts.file_digests(t.spark, t.path("documents"), "text")


_FILE_RANGE = 1 << 16
_LINE = "concat(doc_id::VARCHAR, chr(9), lang, chr(9), coalesce(text, ''))"
_FILE = "concat('source=', source, '/bucket=', (doc_id // 10000)::VARCHAR)"


@query("file_ranges_check", f"""WITH lines AS (SELECT source, doc_id, {_FILE} AS file, strlen({_LINE}) + 1 AS bytes, {_LINE} AS line FROM documents),
    placed AS (SELECT *, sum(bytes) OVER (PARTITION BY file ORDER BY doc_id, line ROWS UNBOUNDED PRECEDING) - bytes + length(doc_id::VARCHAR) AS tab FROM lines),
    changes AS (SELECT DISTINCT file, (tab // {_FILE_RANGE} * {_FILE_RANGE})::BIGINT AS start FROM placed WHERE source NOT IN ('src4', 'src5') AND doc_id % 997 = 3),
    files AS (SELECT DISTINCT file, CASE source WHEN 'src4' THEN 'added' WHEN 'src5' THEN 'missing' ELSE 'unchanged' END AS status FROM lines)
    SELECT file, 'changed' AS status, start FROM changes
    UNION ALL SELECT file, status, NULL FROM files WHERE file NOT IN (SELECT file FROM changes)""")
def file_ranges_check(t: Tables) -> DataFrame:
    """Recorded digests of byte ranges against files of which some are new or gone and some have another byte here and there."""
    folder = F.regexp_extract(F.col("path"), "(source=[^/]*/bucket=[^/]*)/[^/]*$", 1)

    def line(tab: Column) -> Column:
        return F.concat("doc_id", tab, "lang", F.lit("\t"), F.coalesce("text", F.lit("")))

    def copy(name: str, without: str, value: Column) -> Column:
        return F.when(F.col("source") != without, F.struct(F.lit(name).alias("copy"), value.alias("value")))

    copies = F.array_compact(F.array(
        copy("before", "src4", line(F.lit("\t"))), copy("after", "src5", line(F.when(F.col("doc_id") % 997 == 3, " ").otherwise("\t")))))
    # one file per copy, source and 10 000 keys, its lines in order; the rows move once for both copies
    rows = t.documents.select("source", F.floor(F.col("doc_id") / 10000).alias("bucket"), "doc_id", "lang", "text").repartition("source", "bucket")
    lines = rows.select("source", "bucket", "doc_id", F.inline(copies)).sortWithinPartitions("copy", "source", "bucket", "doc_id", "value")
    path, record = scratch(t.spark, "frozen"), scratch(t.spark, "ranges")
    lines.select("copy", "source", "bucket", "value").write.partitionBy("copy", "source", "bucket").text(path)
    before, after = (contracts.range_digests(t.spark, f"{path}/copy={c}", folder, _FILE_RANGE) for c in ("before", "after"))
    before.write.parquet(record)
    return contracts.compare_ranges(t.spark.read.parquet(record), after)


_LOG = "event_id bigint, case_id string, architecture string, state string, latency_ms double"


@query("jsonl_scan", o.with_ctes("SELECT event_id, case_id, architecture, state, latency_ms FROM request_log"))
def jsonl_scan(t: Tables) -> DataFrame:
    path = scratch(t.spark, "jsonl")
    t.derived("request_log").select("event_id", "case_id", "architecture", "state", "latency_ms").write.json(path)
    return journal.read_records(t.spark, path, _LOG)


@query("results_export", o.with_ctes("SELECT doc_id, source, sentiment, confidence, probability_negativo FROM scored"), scores="confidence probability_negativo")
def results_export(t: Tables) -> DataFrame:
    """Scored rows exported per batch and read back with their types."""
    path = _export(t, scored(t).select("doc_id", "sentiment", "confidence", "probability_negativo", "source"), "results", partition_by=["source"])
    return t.spark.read.option("header", True).schema(
        "doc_id bigint, sentiment string, confidence double, probability_negativo double, source string").csv(path)


@query("metrics_export", o.with_ctes("SELECT name AS class, round(precision_, 6) AS precision, round(recall_, 6) AS recall, round(f1_, 6) AS f1, support::BIGINT AS support FROM prf"))
def metrics_export(t: Tables) -> DataFrame:
    path = scratch(t.spark, "metrics")
    journal.write_metrics(ev.class_metrics(ev.confusion_counts(cases(t))).drop("accuracy"), path)
    return t.spark.read.schema("class string, precision double, recall double, f1 double, support bigint").json(path)


@query("journal_append", o.with_ctes("SELECT event_id, case_id, architecture, state, latency_ms FROM request_log WHERE event_id % 9 <> 0"))
def journal_append(t: Tables) -> DataFrame:
    """Two runs, the first one repeated, which adds nothing; records without a required field are rejected."""
    path = scratch(t.spark, "journal")
    fields = ["event_id", "case_id", "architecture", "state", "latency_ms"]
    gap = F.when(F.col("event_id") % 9 != 0, F.col("latency_ms")).alias("latency_ms")
    lines = t.derived("request_log").select("event_id", F.to_json(F.struct(*fields[:-1], gap)).alias("raw"))
    for part in (0, 1, 0):
        journal.append_records(lines.filter(F.col("event_id") % 2 == part), path, fields, run=f"part{part}")
    return journal.read_runs(t.spark, path, _LOG)


@query("cost_log_append", o.with_ctes("SELECT case_id, architecture, call_type, round(cost_usd, 9) AS cost_usd, latency_ms, state, error_code FROM rl"))
def cost_log_append(t: Tables) -> DataFrame:
    path = scratch(t.spark, "costs")
    rows = costs.priced(t.derived("request_log")).withColumns({
        "total_tokens": F.col("input_tokens") + F.col("output_tokens"), "started_at": F.col("ts"), "completed_at": F.col("ts")})
    for side in ("A", "B", "A"):
        journal.append_costs(rows.filter(F.col("architecture") == side), path, run=side)
    return journal.read_costs(t.spark, path).select(
        "case_id", "architecture", "call_type", F.round("cost_usd", 9).alias("cost_usd"), "latency_ms", "state", "error_code")
