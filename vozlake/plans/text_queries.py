"""Queries over comment text: preparation, masking, tokens, topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vozlake import constants as C
from vozlake.functions import text as tx
from vozlake.operators import joins, ranking, scoring, topics
from vozlake.plans import oracle as o
from vozlake.plans.registry import Tables, query

o.define("stripped", "SELECT doc_id, source, " + o.strip("coalesce(text, '')") + " AS t FROM documents")


def comments(t: Tables) -> DataFrame:
    return scoring.prepare(t.documents.select("doc_id", "source", "lang", "text"))


def with_tokens(df: DataFrame) -> DataFrame:
    """Token count as a generated column: counted once, above any shuffle below."""
    return df.select("*", F.inline_outer(F.array(F.struct(tx.token_count(F.col("text")).alias("n_tokens")))))


@query("prepare_text", o.with_ctes("SELECT doc_id, text FROM prep"))
def prepare_text(t: Tables) -> DataFrame:
    return comments(t).select("doc_id", "text")


@query("dropped_count", o.with_ctes("""SELECT source, count(*) AS total, count(*) FILTER (length(t) >= 2) AS kept,
    count(*) FILTER (length(t) < 2) AS dropped FROM stripped GROUP BY source"""))
def dropped_count(t: Tables) -> DataFrame:
    valid = tx.is_valid(tx.prepared(F.col("text")))
    return t.documents.groupBy("source").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(valid).alias("kept"), F.count_if(~valid).alias("dropped"))


@query("length_guard", o.with_ctes("""SELECT doc_id, length(t) AS n_chars,
    CASE WHEN length(t) < 2 THEN 'too_short' WHEN length(t) > 5000 THEN 'too_long' END AS reject_reason FROM stripped"""))
def length_guard(t: Tables) -> DataFrame:
    text = tx.prepared(F.col("text"))
    return t.documents.select("doc_id", F.length(text).cast("long").alias("n_chars"), tx.reject_reason(text).alias("reject_reason"))


@query("keep_source_columns", o.with_ctes("SELECT doc_id, source, lang, text, sentiment, confidence FROM scored"), scores="confidence")
def keep_source_columns(t: Tables) -> DataFrame:
    return scoring.score(comments(t)).select("doc_id", "source", "lang", "text", "sentiment", "confidence")


@query("leak_guard", o.with_ctes("""SELECT t.expected, count(*) AS n, sum(length(p.text))::BIGINT AS chars
    FROM prep p JOIN truth t USING (doc_id) GROUP BY 1"""))
def leak_guard(t: Tables) -> DataFrame:
    """Scorer input carries key and text only; references are joined later."""
    labelled = t.documents.join(t.derived("truth"), "doc_id")
    inputs = joins.leak_guard(scoring.prepare(labelled), "doc_id", "text")
    lengths = inputs.select("doc_id", F.length("text").alias("chars"))
    return lengths.join(t.derived("truth"), "doc_id").groupBy("expected").agg(
        F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))


_EMAIL_SQL = rf"regexp_replace(text, '(?i)(^|{o.NW}|[-.%+])([A-Z0-9_][A-Z0-9._%+-]*@[A-Z0-9.-]+\.[A-Z]{{2,}})($|{o.NW})', '\1[EMAIL]\3', 'g')"
_PHONE = rf"'(^|{o.NW})(\+?\p{{Nd}}[\p{{Nd}}\s\x0B\x{{85}}\p{{Z}}().-]{{7,}}\p{{Nd}})($|{o.NW})', '\1[PHONE]\3', 'g'"
_PHONE_SQL = f"regexp_replace(regexp_replace({_EMAIL_SQL}, {_PHONE}), {_PHONE})"
_URL_SQL = rf"regexp_replace({_PHONE_SQL}, '(?i)https?://[^\s\x0B\x{{85}}\p{{Z}}]+|www\.[^\s\x0B\x{{85}}\p{{Z}}]+', '[URL]', 'g')"
_ID = rf"'(^|{o.NW})(\p{{Nd}}{{6,}})($|{o.NW})', '\1[ID]\3', 'g'"
_ID_SQL = f"regexp_replace(regexp_replace({_URL_SQL}, {_ID}), {_ID})"


@query("anonymize", o.with_ctes(f"SELECT doc_id, {o.collapse(_ID_SQL)}[1:240] AS masked FROM documents"))
def anonymize(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.anonymize(F.col("text")).alias("masked"))


_PII_TESTS = {
    "email": rf"regexp_matches(text, '(?i)[A-Z0-9_][A-Z0-9._%+-]*@[A-Z0-9.-]+\.[A-Z]{{2,}}($|{o.NW})')",
    "url": r"regexp_matches(text, '(?i)https?://\S|www\.\S')",
    "phone": rf"regexp_matches(text, '(^|{o.NW})\+?\p{{Nd}}[\p{{Nd}}\s().-]{{7,}}\p{{Nd}}($|{o.NW})')",
    "long_numeric_id": rf"regexp_matches(text, '(^|{o.NW})\p{{Nd}}{{6,}}($|{o.NW})')",
}


@query("pii_audit", o.with_ctes(" UNION ALL ".join(
    f"SELECT doc_id, '{k}' AS kind FROM documents WHERE {c}" for k, c in _PII_TESTS.items())))
def pii_audit(t: Tables) -> DataFrame:
    found = t.documents.select("doc_id", F.explode_outer(tx.pii_kinds(F.col("text"))).alias("kind"))
    return found.filter(F.col("kind").isNotNull())


@query("historical_clean", o.with_ctes(f"SELECT doc_id, {o.historical('text')} AS cleaned FROM documents"))
def historical_clean(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.historical_clean(F.col("text")).alias("cleaned"))


# the tables hold no compatibility characters, so "fi" and digits are written as ligature
# and full-width forms first, which NFKC must undo
@query("nfkc_normalise", o.with_ctes(f"SELECT doc_id, {o.collapse('nfc_normalize(text)')} AS normalised FROM documents"))
def nfkc_normalise(t: Tables) -> DataFrame:
    wide = F.translate(F.replace(F.col("text"), F.lit("fi"), F.lit("\ufb01")), "0123456789", "\uff10\uff11\uff12\uff13\uff14\uff15\uff16\uff17\uff18\uff19")
    return t.documents.select("doc_id", tx.nfkc_clean(wide).alias("normalised"))


def variants(df: DataFrame) -> DataFrame:
    """The three named normalisations of each comment, one row each."""
    made = df.withColumn("_nfkc", tx.nfkc_clean(F.col("text")))
    return made.select(
        *[c for c in df.columns if c != "text"],
        F.inline(F.array(
            F.struct(F.lit("current_str_strip").alias("variant"), tx.prepared(F.col("text")).alias("text")),
            F.struct(F.lit("historical_clean").alias("variant"), tx.historical_clean(F.col("text")).alias("text")),
            F.struct(F.lit("nfkc_whitespace").alias("variant"), F.col("_nfkc").alias("text")),
        )),
    )


o.define("variant_rows", f"""SELECT doc_id, 'current_str_strip' AS variant, {o.strip('text')} AS text FROM documents
    UNION ALL SELECT doc_id, 'historical_clean', {o.historical('text')} FROM documents
    UNION ALL SELECT doc_id, 'nfkc_whitespace', {o.collapse('nfc_normalize(text)')} FROM documents""")


@query("transform_variants", o.with_ctes("SELECT doc_id, variant, md5(text) AS digest, length(text) AS n_chars FROM variant_rows"))
def transform_variants(t: Tables) -> DataFrame:
    rows = variants(t.documents.select("doc_id", "text"))
    return rows.select("doc_id", "variant", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n_chars"))


@query("negation_flag", o.with_ctes(f"SELECT doc_id, {o.negation('text')} AS is_negation FROM documents"))
def negation_flag(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.negation_flag(F.col("text")).alias("is_negation"))


@query("factual_neutral_flag", o.with_ctes("""SELECT doc_id, expected, expected = 'Neutro' AS is_factual_neutral,
    CASE WHEN expected = 'Neutro' THEN 'factual_neutral' ELSE 'synthetic_opinion' END AS subgroup FROM truth"""))
def factual_neutral_flag(t: Tables) -> DataFrame:
    neutral = F.col("expected") == C.NEUTRAL
    return t.derived("truth").select(
        "doc_id", "expected", neutral.alias("is_factual_neutral"),
        F.when(neutral, "factual_neutral").otherwise("synthetic_opinion").alias("subgroup"))


o.define("blank_split", f"""SELECT doc_id, lang, text, len(list_filter(regexp_split_to_array(text, '{o.BLANK}+'), lambda w: w <> '')) AS n FROM prep""")


@query("token_count_short", o.with_ctes("SELECT doc_id, n::INTEGER AS n_tokens, n <= 4 AS is_short FROM blank_split"))
def token_count_short(t: Tables) -> DataFrame:
    count = tx.token_count(F.col("text"))
    return comments(t).select("doc_id", count.alias("n_tokens")).withColumn("is_short", F.col("n_tokens") <= C.SHORT_TEXT_TOKENS)


@query("word_char_stats", o.with_ctes(
    f"SELECT conv_id, turn, len(regexp_extract_all(text, '{o.W}+'))::INTEGER AS n_words, length(text)::INTEGER AS n_chars FROM conversations"))
def word_char_stats(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", tx.word_count(F.col("text")).alias("n_words"), F.length("text").alias("n_chars"))


o.define("parts", f"""SELECT DISTINCT doc_id, part FROM (
    SELECT doc_id, {o.historical('raw')} AS part FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?]+')) AS raw FROM documents))
    WHERE len(string_split(part, ' ')) >= 4""")


@query("sentence_parts", o.with_ctes("SELECT doc_id, part FROM parts"))
def sentence_parts(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.explode_outer(tx.sentence_parts(F.col("text"))).alias("part"))
    return rows.filter(F.col("part").isNotNull())


@query("case_filters", o.with_ctes(f"""
    SELECT 'spanish' AS subset, count(*) AS n FROM prep WHERE lang = 'es' UNION ALL
    SELECT 'spanish_negation', count(*) FROM prep WHERE lang = 'es' AND {o.negation('text')} UNION ALL
    SELECT 'short', count(*) FROM blank_split WHERE n <= 4"""))
def case_filters(t: Tables) -> DataFrame:
    """Overlapping subsets counted in one pass, each comment once per subset."""
    text = F.col("text")
    spanish = F.col("lang") == "es"
    tests = {"spanish": spanish, "spanish_negation": spanish & tx.negation_flag(text),
             "short": tx.token_count(text) <= C.SHORT_TEXT_TOKENS}
    counts = comments(t).agg(*[F.count_if(c).alias(k) for k, c in tests.items()])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("subset"), F.col(k).alias("n")) for k in tests])))


# --- topics --------------------------------------------------------------------

_TOK = f"""list_filter(regexp_extract_all({o.folded('text')}, '{o.W}{{2,}}'), lambda w: NOT regexp_matches(w, '^[\\p{{Nd}}_]'))"""


@query("tokenize_topics", f"SELECT doc_id, array_to_string({_TOK}, ' ') AS tokens FROM documents")
def tokenize_topics(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(tx.topic_tokens(F.col("text"), None), " ").alias("tokens"))


@query("stopword_filter", o.with_ctes("SELECT doc_id, array_to_string(t, ' ') AS tokens FROM dt_tok"))
def stopword_filter(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(tx.topic_tokens(F.col("text")), " ").alias("tokens"))


@query("ngrams_1_2", o.with_ctes("""SELECT doc_id, len(t)::INTEGER AS n_unigrams, greatest(len(t) - 1, 0)::INTEGER AS n_bigrams,
    md5(array_to_string(t || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]), '|')) AS digest FROM dt_tok"""))
def ngrams_1_2(t: Tables) -> DataFrame:
    """Ordered unigrams then bigrams; bigrams bridge removed stop words."""
    grams = t.documents.select("doc_id", F.inline_outer(F.array(F.struct(
        tx.with_bigrams(tx.topic_tokens(F.col("text"))).alias("grams")))))
    pairs = F.size(F.filter("grams", lambda g: g.contains(" ")))
    return grams.select("doc_id", (F.size("grams") - pairs).alias("n_unigrams"), pairs.alias("n_bigrams"),
                        F.md5(F.array_join("grams", "|")).alias("digest"))


@query("topic_document_frequency", o.with_ctes("SELECT topic, frequency, n_words::INTEGER AS n_words FROM dt_df WHERE frequency >= 3"))
def topic_document_frequency(t: Tables) -> DataFrame:
    return topics.document_frequency(t.documents, min_df=3)


@query("topic_select", o.with_ctes("SELECT source, topic, frequency, n_words::INTEGER AS n_words, rank::INTEGER AS rank FROM st_sel"))
def topic_select(t: Tables) -> DataFrame:
    negative = scoring.score(comments(t)).filter(F.col("sentiment") == C.NEGATIVE)
    return topics.select_topics(topics.document_frequency(negative, ["source"]), ["source"])


@query("pareto", """WITH f AS (SELECT concat('part ', l_partkey) AS topic, count(*) AS frequency FROM lineitem GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY frequency DESC, topic) AS rank, sum(frequency) OVER (ORDER BY frequency DESC, topic ROWS UNBOUNDED PRECEDING) AS upto,
      sum(frequency) OVER () AS total FROM f)
    SELECT rank::INTEGER AS rank, topic, frequency, round(frequency * 100.0::DOUBLE / total, 6) AS percentage,
      round(upto * 100.0::DOUBLE / total, 6) AS cumulative_percentage, (upto - frequency) * 100 < 80 * total AS within_80_percent FROM r""")
def pareto(t: Tables) -> DataFrame:
    """An unbounded topic table: parts by number of order lines."""
    frequencies = t.lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("frequency"))
    return topics.pareto(frequencies.select(F.concat(F.lit("part "), F.col("l_partkey")).alias("topic"), "frequency"))


@query("negative_topics_pareto", o.with_ctes("SELECT * FROM nt_pareto"))
def negative_topics_pareto(t: Tables) -> DataFrame:
    """Flagship: comments to the Pareto table of negative topics."""
    return topics.negative_topics(scoring.score(comments(t)))


@query("negative_topics_by_source", o.with_ctes("SELECT * FROM st_pareto"))
def negative_topics_by_source(t: Tables) -> DataFrame:
    return topics.negative_topics(scoring.score(comments(t)), ["source"])


@query("pareto_block", o.with_ctes("""SELECT source, rank, topic, frequency, percentage, cumulative_percentage FROM st_pareto WHERE within_80_percent"""))
def pareto_block(t: Tables) -> DataFrame:
    return negative_topics_by_source(t).filter("within_80_percent").drop("within_80_percent")


@query("pareto_tail", o.with_ctes("""SELECT source, count(*) FILTER (within_80_percent) AS priority_topic_count,
    count(*) FILTER (NOT within_80_percent) AS tail_topic_count, count(*) AS total_topic_count FROM st_pareto GROUP BY source"""))
def pareto_tail(t: Tables) -> DataFrame:
    inside = F.col("within_80_percent")
    return negative_topics_by_source(t).groupBy("source").agg(
        F.count_if(inside).alias("priority_topic_count"), F.count_if(~inside).alias("tail_topic_count"),
        F.count(F.lit(1)).alias("total_topic_count"))


@query("top_topics", o.with_ctes("SELECT source, rank, topic, frequency FROM st_pareto WHERE rank <= 3"))
def top_topics(t: Tables) -> DataFrame:
    return negative_topics_by_source(t).filter("rank <= 3").select("source", "rank", "topic", "frequency")


@query("preview", o.with_ctes("SELECT doc_id, text FROM prep ORDER BY doc_id LIMIT 20"))
def preview(t: Tables) -> DataFrame:
    """First rows in key order (a top-k report)."""
    return comments(t).select("doc_id", "text").orderBy("doc_id").limit(20)


@query("multi_key_sort", o.with_ctes("SELECT topic, frequency, n_words::INTEGER AS n_words FROM dt_df WHERE frequency >= 20"))
def multi_key_sort(t: Tables) -> DataFrame:
    """Topics in report order: frequency down, longer first, then by name."""
    counts = topics.document_frequency(t.documents, min_df=20)
    return counts.orderBy(F.col("frequency").desc(), F.col("n_words").desc(), "topic")


@query("running_sum_previous", """WITH f AS (SELECT event_type AS batch, user_id, count(*) AS frequency FROM events GROUP BY 1, 2)
    SELECT batch, user_id, frequency, sum(frequency) OVER w::BIGINT AS upto, (sum(frequency) OVER w - frequency)::BIGINT AS previous
    FROM f WINDOW w AS (PARTITION BY batch ORDER BY frequency DESC, user_id ROWS UNBOUNDED PRECEDING)""")
def running_sum_previous(t: Tables) -> DataFrame:
    counts = t.events.groupBy(F.col("event_type").alias("batch"), "user_id").agg(F.count(F.lit(1)).alias("frequency"))
    order = [F.col("frequency").desc(), F.col("user_id").asc()]
    placed = ranking.place(counts, ["batch"], order)
    run = ranking.scan(placed, ["batch"], order, sums={"upto": F.col("frequency")})
    return run.select("batch", "user_id", "frequency", "upto", (F.col("upto") - F.col("frequency")).alias("previous"))


@query("rank_per_group", """SELECT event_type, user_id, frequency, rank::INTEGER AS rank FROM (
    SELECT event_type, user_id, count(*) AS frequency, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id) AS rank
    FROM events GROUP BY 1, 2) WHERE rank <= 3""")
def rank_per_group(t: Tables) -> DataFrame:
    counts = t.events.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("frequency"))
    return ranking.first_per_group(counts, ["event_type"], [F.col("frequency").desc(), F.col("user_id").asc()], 3)
