"""Shared building blocks of the SQL checks (common table expressions)."""

from __future__ import annotations

import re

from vozlake import constants as C
from vozlake.operators import lexicon
from vozlake.plans import inputs

W = r"[\p{L}\p{N}_]"
NW = r"[^\p{L}\p{N}_]"
BLANK = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
BLANK_CHARS = "||".join(f"chr({c})" for c in C.WHITESPACE_CODEPOINTS)


def strip(expr: str) -> str:
    return f"trim({expr}, {BLANK_CHARS})"


def collapse(expr: str) -> str:
    return strip(f"regexp_replace({expr}, '{BLANK}+', ' ', 'g')")


def words(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def historical(expr: str) -> str:
    kept = f"regexp_replace(coalesce({expr}, ''), '[^a-zA-Z0-9áéíóúÁÉÍÓÚñÑ\\s\\x0B\\x1C-\\x1F\\x{{85}}\\p{{Z}}.,!?]', '', 'g')"
    return strip(f"lower(regexp_replace({kept}, '{BLANK}+', ' ', 'g'))")


def folded(expr: str) -> str:
    return f"replace(strip_accents(lower({expr})), 'ß', 'ss')"


def negation(expr: str) -> str:
    return f"regexp_matches(lower({expr}), '(^|{NW})({'|'.join(C.NEGATION_WORDS)})($|{NW})')"


def contrast(expr: str) -> str:
    return f"regexp_matches(lower({expr}), '{W}{NW}+({'|'.join(C.CONTRAST_WORDS)}){NW}+{W}')"


_COEF = ",\n  ".join(f"({n}, '{f}', {i}::DOUBLE, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for n, (f, i, a, b, c) in enumerate(lexicon.STARTER_MODEL))
_PROFILE = ", ".join(
    f"('{lang}', '{w}')" for lang, text in sorted(lexicon.STARTER_PROFILES.items()) for w in text.split()
)
_CLASSES = ", ".join(f"({k}, '{c}')" for k, c in enumerate(C.CLASSES))


def score_ctes(source: str, key: str, text: str, prefix: str, coef: str = "coef", base: tuple[float, ...] = lexicon.STARTER_INTERCEPTS) -> dict[str, str]:
    """Scores ``source(key, text)`` into ``{prefix}(key, sentiment, ...)``."""
    p = prefix
    return {
        f"{p}_tok": f"SELECT {key}, regexp_extract_all(lower({text}), '{W}{{2,}}') AS t FROM {source}",
        f"{p}_feat": f"""SELECT {key}, unnest(t) AS feature FROM {p}_tok
            UNION ALL SELECT {key}, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM {p}_tok""",
        f"{p}_tf": f"""SELECT {key}, i, w0, w1, w2, idf * count(*) AS x FROM {p}_feat JOIN {coef} USING (feature)
            GROUP BY {key}, i, idf, w0, w1, w2""",
        f"{p}_sum": f"""SELECT {key}, count(*) AS n, sqrt(sum(x * x ORDER BY i)) AS norm, sum(w0 * x ORDER BY i) AS a, sum(w1 * x ORDER BY i) AS b, sum(w2 * x ORDER BY i) AS c
            FROM {p}_tf GROUP BY {key}""",
        f"{p}_z": f"""SELECT s.{key}, coalesce(n, 0) AS n_features, {base[0]}::DOUBLE + coalesce(a / norm, 0) AS z0,
            {base[1]}::DOUBLE + coalesce(b / norm, 0) AS z1, {base[2]}::DOUBLE + coalesce(c / norm, 0) AS z2
            FROM {source} s LEFT JOIN {p}_sum USING ({key})""",
        f"{p}_e": f"""SELECT {key}, n_features, exp(z0 - greatest(z0, z1, z2)) AS e0, exp(z1 - greatest(z0, z1, z2)) AS e1,
            exp(z2 - greatest(z0, z1, z2)) AS e2 FROM {p}_z""",
        f"{p}_p": f"""SELECT {key}, n_features, e0 / (e0 + e1 + e2) AS p0, e1 / (e0 + e1 + e2) AS p1,
            e2 / (e0 + e1 + e2) AS p2 FROM {p}_e""",
        f"{p}_long": f"""SELECT {key}, v.k, v.name, CASE v.k WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS pr
            FROM {p}_p, (VALUES {_CLASSES}) v(k, name)""",
        f"{p}_rank": f"SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY pr DESC, k) AS r FROM {p}_long",
        p: f"""SELECT q.{key}, max(CASE WHEN r = 1 THEN name END) AS sentiment, max(CASE WHEN r = 1 THEN pr END) AS confidence,
            any_value(p0) AS probability_negativo, any_value(p1) AS probability_neutro, any_value(p2) AS probability_positivo,
            max(CASE WHEN r = 2 THEN name END) AS second_best_class, max(CASE WHEN r = 2 THEN pr END) AS second_best_probability,
            max(CASE WHEN r = 1 THEN pr END) - max(CASE WHEN r = 2 THEN pr END) AS prediction_margin,
            any_value(n_features)::INTEGER AS n_features
            FROM {p}_p q JOIN {p}_rank USING ({key}) GROUP BY q.{key}""",
    }


_CTES: dict[str, str] = {
    "classes": f"SELECT k, name FROM (VALUES {_CLASSES}) v(k, name)",
    "prep": f"""SELECT doc_id, source, lang, t AS text FROM
        (SELECT doc_id, source, lang, {strip("coalesce(text, '')")} AS t FROM documents) WHERE length(t) >= 2""",
    "coef": f"SELECT * FROM (VALUES\n  {_COEF}) v(i, feature, idf, w0, w1, w2)",
    **score_ctes("prep", "doc_id", "text", "s0"),
    "scored": "SELECT p.doc_id, p.source, p.lang, p.text, s.* EXCLUDE (doc_id) FROM prep p JOIN s0 s USING (doc_id)",
    "profile": f"SELECT lang AS plang, word FROM (VALUES {_PROFILE}) v(lang, word)",
    "lang_hits": f"""SELECT doc_id, plang, count(*)::DOUBLE AS score FROM
        (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{W}+')) AS word FROM prep) JOIN profile USING (word) GROUP BY 1, 2""",
    "lang_best": "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, plang) AS r FROM lang_hits",
    "lang_detected": f"""SELECT p.doc_id, p.lang, b.plang AS detected_language, coalesce(b.score, 0) AS language_score,
        coalesce(c.score, 0) AS runner_up_score,
        CASE WHEN b.plang IS NULL THEN 'unknown' WHEN b.plang IN ({words(C.SUPPORTED_LANGUAGES)}) THEN 'detected' ELSE 'unsupported' END AS language_status
        FROM prep p LEFT JOIN lang_best b ON b.doc_id = p.doc_id AND b.r = 1 LEFT JOIN lang_best c ON c.doc_id = p.doc_id AND c.r = 2""",
    "truth": inputs.duckdb_text("truth"),
    "evaluated": """SELECT s.*, t.expected, s.sentiment = t.expected AS is_correct, s.confidence < 0.8 AS below_80_percent,
        s.sentiment <> t.expected AND s.confidence >= 0.8 AS high_confidence_error FROM scored s JOIN truth t USING (doc_id)""",
    "confusion": """SELECT e.k AS ek, e.name AS expected, p.k AS pk, p.name AS predicted, count(v.doc_id) AS n
        FROM classes e CROSS JOIN classes p LEFT JOIN evaluated v ON v.expected = e.name AND v.sentiment = p.name GROUP BY 1, 2, 3, 4""",
    "prf0": """SELECT c.name, sum(n) FILTER (expected = c.name AND predicted = c.name) AS tp, sum(n) FILTER (expected = c.name) AS support,
        sum(n) FILTER (predicted = c.name) AS chosen FROM confusion, classes c GROUP BY 1""",
    "prf": """SELECT name, support, tp, coalesce(tp / nullif(chosen, 0), 0) AS precision_, coalesce(tp / nullif(support, 0), 0) AS recall_,
        coalesce(2.0 * tp / nullif(support + chosen, 0), 0) AS f1_ FROM prf0""",
    # topics of negative comments
    "neg": "SELECT doc_id, source, text FROM scored WHERE sentiment = 'Negativo'",
    **{k: inputs.duckdb_text(k) for k in ("responses", "request_log", "packet_a", "packet_a_clean", "packet_b", "master")},
}


def topic_ctes(source: str, group: str | None, prefix: str) -> dict[str, str]:
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {group} " if group else ""
    p = prefix
    on = f"u.{group} = b.{group} AND " if group else ""
    return {
        f"{p}_tok": f"""SELECT doc_id, {g}list_filter(regexp_extract_all({folded('text')}, '{W}{{2,}}'),
            lambda w: NOT regexp_matches(w, '^[\\p{{Nd}}_]') AND w NOT IN ({words(C.TOPIC_STOP_WORDS)})) AS t FROM {source}""",
        f"{p}_term": f"""SELECT {g}unnest(list_distinct(t || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS topic
            FROM {p}_tok""",
        f"{p}_df": f"SELECT {g}topic, count(*) AS frequency, CASE WHEN contains(topic, ' ') THEN 2 ELSE 1 END AS n_words FROM {p}_term GROUP BY ALL",
        f"{p}_cover": f"""SELECT {g}word, max(frequency) AS best FROM
            (SELECT {g}unnest(string_split(topic, ' ')) AS word, frequency FROM {p}_df WHERE n_words = 2) GROUP BY ALL""",
        f"{p}_open": f"""SELECT u.* FROM {p}_df u LEFT JOIN {p}_cover b ON {on}u.n_words = 1 AND b.word = u.topic
            WHERE b.best IS NULL OR b.best <> u.frequency""",
        f"{p}_sel": f"""SELECT * FROM (SELECT *, row_number() OVER ({part}ORDER BY frequency DESC, n_words DESC, topic) AS rank FROM {p}_open)
            WHERE rank <= {C.MAX_TOPICS}""",
        f"{p}_run": f"""SELECT {g}topic, frequency, row_number() OVER ({part}ORDER BY frequency DESC, topic) AS rank,
            sum(frequency) OVER ({part}ORDER BY frequency DESC, topic ROWS UNBOUNDED PRECEDING) AS upto,
            sum(frequency) OVER ({part.strip()}) AS total FROM {p}_sel""",
        f"{p}_pareto": f"""SELECT {g}rank::INTEGER AS rank, topic, frequency, round(frequency * 100.0::DOUBLE / total, 6) AS percentage,
            round(upto * 100.0::DOUBLE / total, 6) AS cumulative_percentage, (upto - frequency) * 100 < 80 * total AS within_80_percent FROM {p}_run""",
    }


_CTES.update(topic_ctes("neg", None, "nt"))
_CTES.update(topic_ctes("neg", "source", "st"))
_CTES.update(topic_ctes("documents", None, "dt"))


def define(name: str, sql: str) -> None:
    if name in _CTES and _CTES[name] != sql:
        raise ValueError(f"check fragment {name} defined twice")
    _CTES[name] = sql


def with_ctes(body: str) -> str:
    """Prefix ``body`` with every fragment it names, directly or not."""
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name in re.findall(r"\b[a-z]\w*\b", sql):
            if name in _CTES and name not in needed:
                needed.append(name)
                visit(_CTES[name])

    visit(body)
    order = [n for n in _topological(needed)]
    return "WITH " + ",\n".join(f"{n} AS ({_CTES[n]})" for n in order) + "\n" + body if order else body


def _topological(names: list[str]) -> list[str]:
    done: list[str] = []

    def place(name: str, trail: tuple[str, ...] = ()) -> None:
        if name in done or name in trail:
            return
        for other in re.findall(r"\b[a-z]\w*\b", _CTES[name]):
            if other in _CTES and other != name:
                place(other, (*trail, name))
        done.append(name)

    for name in names:
        place(name)
    return done
