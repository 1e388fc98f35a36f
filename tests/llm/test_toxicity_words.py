import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from banderole.llm.toxicity import Model, Scorer, word_values

MODEL = Model(np.random.default_rng(0).standard_normal(1 << 12).astype(np.float32), 0.1)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab<é日😀.\ud800"), max_size=12) | st.text(max_size=80), min_size=1, max_size=20))
def test_values_of_many_words_equal_those_of_single_words(words):
    assert np.allclose(word_values(MODEL, words), [MODEL.word(w) for w in words], atol=1e-5)


def test_scores_do_not_depend_on_chunks(monkeypatch):
    texts = ["one two three", "", "thrée aaaa aaaa", "x " * 50, "two"]
    whole = Scorer(MODEL).scores(texts)
    monkeypatch.setattr(Scorer, "CHUNK", 2)
    monkeypatch.setattr(Scorer, "LIMIT", 1)
    assert np.allclose(Scorer(MODEL).scores(texts), whole) and whole.size == 5
    assert Scorer(MODEL).scores([]).size == 0
