import numpy as np
import public_tokenizers as tokenizers

from gridspark.llm import attention_lm
from gridspark.llm.token_files import WordTokenizer


def test_full_memory_keeps_the_first_words(monkeypatch):
    words = WordTokenizer(tokenizers.path("word_bpe_49k.json"), 50)
    many = [f"north{i}" for i in range(200)]
    first = words.words(many)
    assert 40 <= len(words.known) <= 50 and "north0" in words.known
    learned = []
    monkeypatch.setattr(words, "_learn", lambda fresh, learn=words._learn: (learned.extend(fresh), learn(fresh)))
    assert words.words(many) == first == [words._whole(w) for w in many]
    assert "north0" not in learned and "north199" in learned and len(words.known) <= 50


def test_sums_over_equal_symbols():
    rng = np.random.default_rng(5)
    u, g = rng.zipf(1.4, 3000) % 400, rng.normal(size=(3000, 7))
    own, groups = attention_lm._alike(u)
    want = np.zeros((400, 7))
    np.add.at(want, u, g)
    assert sorted(own) == sorted(set(u.tolist()))
    assert np.allclose(attention_lm._group_sums(g, groups, len(own)), want[own])
