"""Words merged together, and units that are remembered."""

import random

import public_tokenizers
import pytest

from loanspan.llm import bpe


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.load(public_tokenizers.path("word_bpe_49k.json"))


def test_merge_all(vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "TOGETHER", 7)
    draw = random.Random(3)
    words = ["a", "é", "日本語", "x" * 300, "ab" * 64, "aaaaaaaa", "!!!", "\ud800b"]
    words += ["".join(draw.choices("aeinorst01-é", k=draw.randint(1, 40))) for _ in range(200)]
    assert vocabulary.merge_all(words) == [vocabulary.merge(w) for w in words]
    assert vocabulary.merge_all([]) == []
    bare = bpe.Vocabulary(vocabulary.tokens, {}, {})
    assert bare.merge_all(["abc", "d"]) == [bare.merge("abc"), bare.merge("d")]


def test_units_met_again_are_kept(vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 8)
    encoder, asked = bpe.Encoder(vocabulary, bpe.Transducer.compile({}), True), []
    words = vocabulary.words
    monkeypatch.setattr(vocabulary, "words", lambda unit: asked.append(unit) or words(unit))
    for i in range(20):
        encoder.learn({"often", f"rare{i}"})
        assert set(encoder.ids) >= {"often", f"rare{i}"} and set(encoder.ids) == set(encoder.plain)
        assert len(encoder.ids) + len(encoder.older[0]) <= 8
    assert asked.count("often") == 1
