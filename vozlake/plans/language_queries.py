"""Queries over language profiles of character trigrams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vozlake import constants as C
from vozlake.durable import cut
from vozlake.functions import text as tx
from vozlake.operators import language
from vozlake.plans import oracle as o
from vozlake.plans.registry import Tables, query
from vozlake.plans.text_queries import comments

o.define("lp_chars", r"SELECT doc_id, lang, text, string_split(' ' || array_to_string(regexp_extract_all(lower(text), '\p{L}+'), ' ') || ' ', '') AS c FROM prep")
o.define("lp_gram", "SELECT doc_id, lang, unnest(range(0, len(c) - 2)) AS place, unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) AS gram FROM lp_chars")
o.define("lp_tf", "SELECT doc_id, gram, count(*) AS tf FROM lp_gram GROUP BY 1, 2")
o.define("lp_per", "SELECT lang, gram, count(*) AS n FROM lp_gram WHERE lang IS NOT NULL GROUP BY 1, 2")
o.define("lp_known", f"SELECT DISTINCT gram FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS r FROM lp_per) WHERE r <= {language.TOP_GRAMS}")
o.define("lp_total", "SELECT lang, sum(n)::BIGINT AS mass FROM lp_per JOIN lp_known USING (gram) GROUP BY 1")
o.define("lp_weight", """SELECT lang, gram, coalesce(n, 0)::BIGINT AS count,
    round(ln((coalesce(n, 0) + 0.5::DOUBLE) / (mass + 0.5::DOUBLE * (SELECT count(*) FROM lp_known))), 6) AS weight
    FROM (SELECT lang, mass, gram FROM lp_total, lp_known) LEFT JOIN lp_per USING (lang, gram)""")


def posterior_ctes(prefix: str, grams: str, key: str) -> dict[str, str]:
    """Posteriors of ``grams(key, gram, tf)``: {prefix}_best has the best two languages of each key."""
    p = prefix
    return {
        f"{p}_score": f"SELECT {key}, w.lang AS found, sum(tf * weight) AS score, sum(tf)::BIGINT AS hits FROM {grams} JOIN lp_weight w USING (gram) GROUP BY {key}, w.lang",
        f"{p}_exp": f"SELECT {key}, found, exp(score - max(score) OVER (PARTITION BY {key})) AS e FROM {p}_score",
        f"{p}_post": f"SELECT {key}, found, e / sum(e) OVER (PARTITION BY {key}) AS p FROM {p}_exp",
        f"{p}_rank": f"SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY p DESC, found) AS r FROM {p}_post",
        f"{p}_best": f"SELECT {key}, max(found) FILTER (r = 1) AS found, max(p) FILTER (r = 1) AS top, max(p) FILTER (r = 2) AS second FROM {p}_rank GROUP BY {key}",
    }


for _key, _cte in posterior_ctes("lp", "lp_tf", "doc_id").items():
    o.define(_key, _cte)
o.define("lp_detected", f"""SELECT d.doc_id, d.lang, d.text, b.found AS detected_language, b.top AS posterior, b.second AS runner_up_posterior,
    CASE WHEN b.found IS NULL THEN 'unknown' WHEN b.found IN ({o.words(C.SUPPORTED_LANGUAGES)}) THEN 'detected' ELSE 'unsupported' END AS language_status,
    CASE WHEN b.found IS NULL THEN 'undetectable_text' END AS language_error FROM prep d LEFT JOIN lp_best b USING (doc_id)""")


def profiles(t: Tables) -> DataFrame:
    """Profiles fitted on the tagged comments, written as a table and read back."""
    return cut(language.fit_profiles(comments(t)), "profiles")


@query("language_profiles", o.with_ctes("SELECT * FROM lp_weight"))
def language_profiles(t: Tables) -> DataFrame:
    return language.fit_profiles(comments(t))


@query("language_posterior", o.with_ctes("SELECT doc_id, detected_language, posterior, runner_up_posterior, language_status, language_error FROM lp_detected"), scores="posterior runner_up_posterior")
def language_posterior(t: Tables) -> DataFrame:
    return language.detect(comments(t), profiles(t)).select("doc_id", *language.COLUMNS)


@query("language_posterior_eval", o.with_ctes(f"""SELECT lang, len(regexp_extract_all(text, '{o.W}+')) <= 4 AS short, count(*) AS cases,
    count(*) FILTER (detected_language = lang) AS correct, round(avg(coalesce(detected_language = lang, false)::INT), 6) AS accuracy,
    count(*) FILTER (language_status = 'unknown') AS unknown, count(*) FILTER (language_status = 'unsupported') AS unsupported,
    count(*) FILTER (language_status = 'error') AS errors FROM lp_detected GROUP BY 1, 2"""))
def language_posterior_eval(t: Tables) -> DataFrame:
    """Accuracy against the language tag, short comments apart."""
    short = F.regexp_count("text", F.lit(tx.WORD_CLASS + "+")) <= C.SHORT_TEXT_TOKENS
    found = language.detect(comments(t).select("doc_id", "lang", "text"), profiles(t))
    ok = F.coalesce(F.col("detected_language") == F.col("lang"), F.lit(False))
    state = lambda name: F.count_if(F.col("language_status") == name)
    return found.groupBy("lang", short.alias("short")).agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(ok).alias("correct"), F.round(F.avg(ok.cast("int")), 6).alias("accuracy"),
        state("unknown").alias("unknown"), state("unsupported").alias("unsupported"), state("error").alias("errors"))


_P = language.PRIME
o.define("ld_gram", f"""SELECT run, doc_id, gram, ((doc_id % {_P}) * 7919 + run * 104729 + place * 15485863) % {_P} AS y,
    count(*) OVER (PARTITION BY run, doc_id) AS size FROM lp_gram, (SELECT unnest(range(1, 4)) AS run)""")
o.define("ld_tf", f"SELECT run, doc_id, gram, count(*) AS tf FROM ld_gram WHERE (y * y + 12345 * y) % {_P} * size < {language.DRAWS * _P} GROUP BY 1, 2, 3")
for _key, _cte in posterior_ctes("ld", "ld_tf", "run, doc_id").items():
    o.define(_key, _cte)
o.define("ld_run", """SELECT d.doc_id, d.lang, coalesce(b.found, '') AS found, coalesce(b.top, 0) AS top, coalesce(b.top - b.second, 0) AS gap
    FROM (SELECT doc_id, lang, run FROM prep, (SELECT unnest(range(1, 4)) AS run)) d LEFT JOIN ld_best b USING (run, doc_id)""")
o.define("ld_case", "SELECT doc_id, lang, count(DISTINCT found) = 1 AS stable, max(top) AS top, min(gap) AS gap FROM ld_run GROUP BY 1, 2")


@query("repeat_stability_draws", o.with_ctes("""SELECT lang, count(*) AS cases, count(*) FILTER (stable) AS stable_cases, round(avg(stable::INT), 6) AS stable_share,
    round(max(top), 6) AS top_score, round(min(gap), 5) AS least_gap, round(avg(gap), 5) AS mean_gap FROM ld_case GROUP BY 1"""))
def repeat_stability_draws(t: Tables) -> DataFrame:
    """Detection by random draws of a comment's trigrams, three runs; a case is stable when all runs agree."""
    found = language.stability(comments(t).select("doc_id", "lang", "text"), profiles(t), "doc_id")
    return found.groupBy("lang").agg(
        F.count(F.lit(1)).alias("cases"), F.count_if("stable").alias("stable_cases"), F.round(F.avg(F.col("stable").cast("int")), 6).alias("stable_share"),
        F.round(F.max("top_posterior"), 6).alias("top_score"), F.round(F.min("least_gap"), 5).alias("least_gap"), F.round(F.avg("least_gap"), 5).alias("mean_gap"))
