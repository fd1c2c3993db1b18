"""Words of packing are made of letters and marks that are tokenized once, with the same ids."""

import pytest

from lodestone.llm import packing


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_letters_are_tokenized_once_whatever_their_marks_and_case(path):
    enc = packing.WordEncoder(path)
    enc.forget()
    texts = ["Vexorly vexorly, VEXORLY... vexorly's \u00c9\u00df\u017f, \u0130x \u212a 12 \u65e5\u672c -- ,", "", "vexorly! \u00e9\u00df\u017f"]
    assert enc.encode_all(texts) == [enc.whole(t) for t in texts]
    assert sum(x == "vexorly" for x in enc.stems) == 1 and not {"Vexorly", "vexorly,"} & set(enc.stems)


def test_few_words_remembered(path, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 3)
    enc = packing.WordEncoder(path)
    texts = [f"alpha{c} Beta{c}. gamma, {c}!! {c}?! delta" for c in "abcdefgh"]
    assert [enc.encode_all([t])[0] for t in texts] == [enc.whole(t) for t in texts]
