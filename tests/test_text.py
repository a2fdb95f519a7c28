"""Text preparation, masking and tokens on small inputs with known answers."""

from pyspark.sql import functions as F

from vozlake.functions import text as tx
from vozlake.operators import joins, scoring


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "text string").select(column.alias("x")).first().x


def test_prepare_keeps_two_characters(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["Excelente", None, " ", "x", "Terrible"])], "id int, text string")
    assert [r.text for r in scoring.prepare(df).orderBy("id").collect()] == ["Excelente", "Terrible"]


def test_strip_takes_unicode_blanks(spark):
    assert one(spark, "   hola\t　", tx.prepared(F.col("text"))) == "hola"


def test_masks_in_order(spark):
    masked = one(spark, "Escriba a ana.b@correo.com o llame +54 11 4444-5555, vea https://x.y/z y ticket 123456", tx.anonymize(F.col("text")))
    assert masked == "Escriba a [EMAIL] o llame [PHONE], vea [URL] y ticket [ID]"


def test_nine_digit_codes_count_as_phone(spark):
    assert one(spark, "ABC-123456789 y 987654321", tx.anonymize(F.col("text"))) == "ABC-[PHONE] y [PHONE]"


def test_mask_respects_accented_neighbours(spark):
    assert one(spark, "ñ123456789", tx.anonymize(F.col("text"))) == "ñ123456789"


def test_masked_text_is_cut_to_240(spark):
    assert len(one(spark, "palabra " * 100, tx.anonymize(F.col("text")))) == 240


def test_pii_kinds(spark):
    assert one(spark, "a@b.co www.x.y 1234567", tx.pii_kinds(F.col("text"))) == ["email", "url", "long_numeric_id"]


def test_historical_clean(spark):
    assert one(spark, "¡Qué  BUENO, señor_! 100%", tx.historical_clean(F.col("text"))) == "qué bueno, señor! 100"


def test_nfkc(spark):
    assert one(spark, "ﬁn １２ ½", tx.nfkc_clean(F.col("text"))) == "fin 12 1⁄2"


def test_contrast(spark):
    assert one(spark, "Buena atención, PERO llegó tarde", tx.contrast_flag(F.col("text")))
    assert one(spark, "good; however late", tx.contrast_flag(F.col("text")))
    assert not one(spark, "pero bueno", tx.contrast_flag(F.col("text")))
    assert not one(spark, "el perrero tarda", tx.contrast_flag(F.col("text")))


def test_negation(spark):
    assert one(spark, "Nunca llegó", tx.negation_flag(F.col("text")))
    assert one(spark, "JAMÁS", tx.negation_flag(F.col("text")))
    assert not one(spark, "noche sinfonía", tx.negation_flag(F.col("text")))


def test_topic_tokens_fold_and_start_with_a_letter(spark):
    assert one(spark, "Llegó 3abc _cc Été Straße x ab", tx.topic_tokens(F.col("text"), None)) == ["llego", "ete", "strasse", "ab"]


def test_bigrams_bridge_removed_words(spark):
    assert one(spark, "demora en la entrega", tx.topic_terms(F.col("text"))) == ["demora", "entrega", "demora entrega"]


def test_sentence_parts_need_four_words(spark):
    assert one(spark, "Uno dos. Uno dos tres cuatro! uno dos tres CUATRO?", tx.sentence_parts(F.col("text"))) == ["uno dos tres cuatro"]


def test_run_lengths(spark):
    found = spark.sql("select array('b','a','b') as v").select(tx.run_lengths(F.sort_array("v")).alias("x")).first().x
    assert [(r.i, r.tf) for r in found] == [("a", 1), ("b", 2)]


def test_reserved_columns_are_hidden():
    assert joins.selectable_columns(["id", " Expected_Sentiment ", "texto"]) == ["id", "texto"]


def test_folding_tests_letters_beyond_ascii_only(spark):
    longer = tx._folding()[2]
    every = spark.range(1, 0x11000).filter("id < 55296 or id > 57343").select("id", F.decode(F.encode(F.concat(F.lit("a"), F.expr(
        "decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')")), "UTF-8"), "UTF-8").alias("text"))
    plain = F.col("text").rlike("[" + "".join(c for c, _ in longer) + r"\p{M}]")
    source, target, _ = tx._folding()
    old = F.regexp_replace(F.translate(F.lower("text"), source, target), r"\p{M}+", "")
    for char, instead in longer:
        old = F.replace(old, F.lit(char), F.lit(instead))
    assert every.filter(plain).count() > 100
    assert every.filter(~tx.fold(F.col("text")).eqNullSafe(old)).count() == 0
    assert "&&" in tx.fold(F.col("text"))._jc.toString()
