"""The word test on short texts: word soup fails, clean text of the same length stays."""

import random

from vozlake.llm import quality


def test_soup_and_clean_text_of_60_to_110_words(spark):
    rnd = random.Random(5)
    common = quality.COMMON_WORDS["en"].split()
    rates = [1 / (i + 3) for i in range(len(common))]

    def text(n, share):
        words = [rnd.choices(common, rates)[0] if rnd.random() < share else "".join(rnd.choice("aeionrstlmd") for _ in range(rnd.choice((2, 4, 5, 7)))) for _ in range(n)]
        return " ".join(words)

    rows = [("reference", text(400, 0.28), "en") for _ in range(100)]
    rows += [("clean", text(rnd.randint(60, 110), 0.28), None) for _ in range(300)]
    rows += [("soup", text(n, 0), None) for n in range(60, 111)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string")
    got = quality.rules(docs).groupBy("doc_id", "base_failed").agg({"kept": "count_if", "*": "count"}).collect()
    kept = {r.doc_id: r["count_if(kept)"] for r in got}
    assert not any(r.base_failed for r in got)
    # the draws of clean text have all the chance there is
    assert kept["soup"] == 0 and kept["clean"] >= 294 and kept["reference"] >= 98
