"""Row-local text expressions. Everything here stays in the JVM except NFKC."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable
from functools import lru_cache, wraps

import pandas as pd
from pyspark.sql import Column, SparkSession, functions as F
from pyspark.sql.types import StringType

from vozlake import constants as C

# Python's \w is "alphanumeric or underscore"; spelling it as properties makes
# the Java engine agree without switching on its slower Unicode class mode.
WORD_CLASS = r"[\p{L}\p{N}_]"
BLANK_CLASS = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
MODEL_TOKEN = WORD_CLASS + "{2,}"
TOPIC_TOKEN = rf"(?<!{WORD_CLASS})[\p{{L}}\p{{Nl}}\p{{No}}]{WORD_CLASS}+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body``.

    A plain column reference inside a lambda can be inlined by the optimizer
    and then recomputed per array element; a lambda variable cannot.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def per_session(build: Callable[..., Column]) -> Callable[..., Column]:
    """Keep a large expression for the life of the Spark application.

    Building one takes hundreds of calls into the JVM. Arguments are plain values
    (column names, models), never columns.
    """
    kept: dict[tuple, Column] = {}

    @wraps(build)
    def again(*args: object) -> Column:
        key = (SparkSession.active().sparkContext.applicationId, *args)
        if key not in kept:
            kept[key] = build(*args)
        return kept[key]

    return again


def strip(col: Column) -> Column:
    return F.trim(col, F.lit(C.WHITESPACE))


def collapse_blanks(col: Column) -> Column:
    return strip(F.regexp_replace(col, BLANK_CLASS + "+", " "))


def prepared(col: Column) -> Column:
    """Null-safe, stripped text, as every later step expects it."""
    return strip(F.coalesce(col.cast("string"), F.lit("")))


def is_valid(text: Column) -> Column:
    return F.length(text) >= C.MIN_TEXT_CHARS


def reject_reason(text: Column) -> Column:
    return (
        F.when(F.length(text) < C.MIN_TEXT_CHARS, "too_short")
        .when(F.length(text) > C.MAX_TEXT_CHARS, "too_long")
    )


def blank_tokens(text: Column) -> Column:
    return F.filter(F.split(text, BLANK_CLASS + "+"), lambda t: t != "")


def token_count(text: Column) -> Column:
    return F.size(blank_tokens(text))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_CLASS + "+"))


# --- personal data -----------------------------------------------------------

_MASKS = (
    ("[EMAIL]", "(?iU)" + C.EMAIL_PATTERN),
    ("[PHONE]", "(?U)" + C.PHONE_PATTERN),
    ("[URL]", "(?iU)" + C.URL_PATTERN),
    ("[ID]", "(?U)" + C.LONG_ID_PATTERN),
)
PII_KINDS = {
    "email": "(?iU)" + C.EMAIL_PATTERN,
    "url": "(?iU)" + C.URL_PATTERN,
    "phone": "(?U)" + C.PHONE_PATTERN,
    "long_numeric_id": "(?U)" + C.LONG_ID_PATTERN,
}


def mask_personal_data(col: Column) -> Column:
    for token, pattern in _MASKS:
        col = F.regexp_replace(col, pattern, token)
    return col


def anonymize(col: Column, max_chars: int = C.ANONYMIZED_CHARS) -> Column:
    return F.substring(collapse_blanks(mask_personal_data(col)), 1, max_chars)


def pii_kinds(col: Column) -> Column:
    """Array of the kinds of personal data found, in contract order."""
    return F.array_compact(
        F.array(*[F.when(col.rlike(p), F.lit(kind)) for kind, p in PII_KINDS.items()])
    )


# --- normalisation -----------------------------------------------------------

def historical_clean(col: Column) -> Column:
    """Keep Spanish letters, digits, blanks and . , ! ? ; collapse; lower-case."""
    kept = F.regexp_replace(
        F.coalesce(col, F.lit("")),
        r"[^a-zA-Z0-9áéíóúÁÉÍÓÚñÑ\s\x0B\x1C-\x1F\x85\p{Z}.,!?]", "",
    )
    return strip(F.lower(F.regexp_replace(kept, BLANK_CLASS + "+", " ")))


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def nfkc_clean(col: Column) -> Column:
    """NFKC plus blank collapsing. The only step without a JVM built-in; ASCII text is its own NFKC and stays in the JVM."""
    other = F.when(col.rlike(r"[^\x00-\x7F]"), col)
    return collapse_blanks(F.coalesce(_nfkc(other), col))


def sentence_parts(col: Column, min_words: int = 4) -> Column:
    """Distinct cleaned sentences of at least ``min_words`` words."""
    cleaned = F.transform(F.split(col, "[.!?]+"), historical_clean)
    return F.array_distinct(
        F.filter(cleaned, lambda p: F.size(F.split(p, " ")) >= min_words)
    )


def contrast_flag(col: Column, words: Iterable[str] = C.CONTRAST_WORDS) -> Column:
    """A word of contrast inside the comment: with a word before it and one after it."""
    body = "|".join(words)
    return col.rlike(rf"(?iu){WORD_CLASS}[^\p{{L}}\p{{N}}_]+(?:{body})[^\p{{L}}\p{{N}}_]+{WORD_CLASS}")


def negation_flag(col: Column, words: Iterable[str] = C.NEGATION_WORDS) -> Column:
    body = "|".join(words)
    return col.rlike(rf"(?iu)(?<!{WORD_CLASS})(?:{body})(?!{WORD_CLASS})")


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Lower-case letters whose compatibility form only drops marks."""
    blocks = [(0xC0, 0x24F), (0x370, 0x45F), (0x1E00, 0x1FFF), (0xFB00, 0xFB06), (0xFF01, 0xFF5E)]
    source, target, longer = [], [], [("ß", "ss")]
    for first, last in blocks:
        for code in range(first, last + 1):
            char = chr(code)
            if char.lower() != char:
                continue
            plain = "".join(
                c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)
            )
            if plain == char or not plain or not plain.strip():
                continue
            if len(plain) == 1:
                source.append(char)
                target.append(plain)
            else:
                longer.append((char, plain))
    return "".join(source), "".join(target), tuple(longer)


def fold(col: Column) -> Column:
    """Lower-case and strip accents (casefold + NFKD without marks)."""
    source, target, longer = _folding()

    def expand(text: Column) -> Column:
        for char, plain in longer:
            text = F.replace(text, F.lit(char), F.lit(plain))
        return F.regexp_replace(text, r"\p{M}+", "")

    # most comments hold none of these, so they pay for one test only; a class of hundreds of letters is tried one by one, so it
    # is asked for characters beyond ASCII only
    unusual = r"[[^\x00-\x7F]&&[" + "".join(char for char, _ in longer) + r"\p{M}]]"
    return let(
        F.translate(F.lower(col), source, target),
        lambda t: F.when(t.rlike(unusual), expand(t)).otherwise(t),
    )


# --- tokens and n-grams -------------------------------------------------------

def run_lengths(ordered: Column, value: str = "i", length: str = "tf") -> Column:
    """Distinct values of a sorted array with how often each occurs."""

    def runs(items: Column) -> Column:
        starts = F.array_compact(
            F.transform(items, lambda x, k: F.when((k == 0) | (F.get(items, k - 1) != x), k))
        )
        return let(
            starts,
            lambda p: F.transform(
                p,
                lambda at, k: F.struct(
                    F.get(items, at).alias(value),
                    (F.coalesce(F.get(p, k + 1), F.size(items)) - at).alias(length),
                ),
            ),
        )

    return let(ordered, runs)



def model_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(MODEL_TOKEN), F.lit(0))


def topic_tokens(text: Column, stop_words: Iterable[str] | None = C.TOPIC_STOP_WORDS) -> Column:
    tokens = F.regexp_extract_all(fold(text), F.lit(TOPIC_TOKEN), F.lit(0))
    words = sorted(stop_words or ())
    # a long IN list becomes a hash-set probe, one per token
    return F.filter(tokens, lambda t: ~t.isin(words)) if words else tokens


def with_bigrams(tokens: Column) -> Column:
    """Tokens followed by adjacent pairs."""
    return let(
        tokens,
        lambda t: F.concat(
            t,
            F.array_compact(
                F.zip_with(t, F.slice(t, 2, F.size(t)), lambda a, b: F.concat(a, F.lit(" "), b))
            ),
        ),
    )


def topic_terms(text: Column, stop_words: Iterable[str] | None = C.TOPIC_STOP_WORDS) -> Column:
    """Distinct topic unigrams and bigrams of one comment."""
    return F.array_distinct(with_bigrams(topic_tokens(text, stop_words)))


@per_session
def topic_terms_of(name: str, stop_words: tuple[str, ...] | None = C.TOPIC_STOP_WORDS) -> Column:
    """:func:`topic_terms` of a named column."""
    return topic_terms(F.col(name), stop_words)
