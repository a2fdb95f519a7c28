"""Words of the word vocabulary are encoded once, whatever stands around them."""

import random

import numpy as np
import pyarrow as pa
import pytest

from vozlake.llm import tokens


@pytest.fixture()
def tokenizer():
    return tokens.PieceTokenizer(tokens.vocabulary("word_bpe_49k.json"))


def check(tokenizer, texts):
    for first, ids, counts in tokenizer.texts(pa.array(texts, pa.string()), 2):
        for i, (end, n) in enumerate(zip(np.cumsum(counts), counts)):
            assert ids[end - n:end].tolist() == [*tokenizer.encode(texts[first + i] or ""), 2]


def test_a_word_is_encoded_once(tokenizer):
    words = [f"{a}{b}" for a in ("stra", "ét", "grö", "niñ") for b in ("ba", "lo", "mi", "na", "ru")]
    forms = ["{}", "{},", '"{}"', "({}).", "{}!!", "<{}>", "\t{}", "\n\n{}", "{}-", "{}..."]
    texts = [" ".join(form.format(case(w)) for form in forms) for w in words for case in (str.lower, str.upper, str.title)]
    check(tokenizer, texts)
    # the words, and signs that do not depend on them
    assert len(tokenizer.keys) <= len(words) + 2 * len(forms)


def test_pieces_that_are_cut_equal_the_library(tokenizer):
    rnd = random.Random(7)
    plain = [*"abstmvlrdeSTMVLRDE''' \t\n\x0b09,.-_<>|", '"', *"éÉÀßÿÞ", "'ll", "'re", "'VE", "don't", "l'Homme"]
    other = ["e\u0301", *"\u0301\xd7\xf7\xb5\xaa\xa0\u0085\u2003\x1c\x00\u0130\u017f\u212a\u03a3\u0153\u2019\u4e2d\ufb01\U0001f600",
             "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>"]
    texts = ["".join(rnd.choice(other if rnd.random() < 0.1 else plain) for _ in range(rnd.randrange(40))) for _ in range(4000)]
    texts += [None, "", "  ", "'", "a'", "'a", "''s", ",'s", "9's", "'S", "d'", "m", "Aé" * 3000, "'" * 3000 + "S"]
    for _ in range(2):
        check(tokenizer, texts)


def test_other_steps_before_the_model_are_not_cut():
    assert not tokens.PieceTokenizer(tokens.vocabulary("byte_bpe_50k.json")).by_word
