"""The word encoder outside Spark: spellings of a word share one entry, and ids stay those of the whole tokenizer."""

from __future__ import annotations

import random
from array import array

import pytest

from tramline.llm import encode
from tramline.llm.queries import tokenizer_path


class Counted:
    def __init__(self, model):
        self.model, self.asked = model, []

    def tokenize(self, piece):
        self.asked.append(piece)
        return self.model.tokenize(piece)


@pytest.fixture
def words():
    return encode.WordEncoder(tokenizer_path())


def test_spellings_of_a_word_are_encoded_once(words):
    words.model = Counted(words.model)
    words.encode("Station station, STATION. station; straße, straße. Station".encode())
    assert sorted(words.model.asked) == sorted(["station", ",", ".", ";", "straÃŁe"])


def test_ids_are_those_of_the_whole_tokenizer(words):
    parts = [
        "Word", "word,", "WORD.", "don't,", "a..", "...", ",", "é.", "É,", "straße!", "ß?", "İ.", "İi,", "J̌", "ǰ", "É.", "é,", "<|endoftext|>", "<|ENDOFTEXT|>",
        "<|x,", "日本,", "ΟΔΟΣ.", "3.", "12,5.", "x3.", "ª.", "­.", "ŉ.", "ǰ.", "ﬁ,", "Ķ,", "KelvinK.", "q:", ";x;", "\x00a.", "👍.", "L'E,", "we'LL.", "'S,",
    ]
    rng = random.Random(7)
    texts = parts + [" ".join(rng.choices(parts, k=rng.randrange(1, 30))) for _ in range(300)]
    for text in texts:
        told = array("I", words.encode(text.encode())).tolist()
        assert told == words.whole.encode(text, add_special_tokens=False).ids, text


def test_few_entries_change_nothing(words, monkeypatch):
    monkeypatch.setattr(encode, "CACHED_WORDS", 2)
    text = "One two, three. four two one; FIVE three, two"
    for _ in range(3):
        assert array("I", words.encode(text.encode())).tolist() == words.whole.encode(text, add_special_tokens=False).ids
