"""Words beyond 64 characters count whole."""

import numpy as np

from banderole.llm import toxicity


def test_windows_hold_every_ngram_and_no_other():
    rng = np.random.default_rng(2)
    for size in (63, 64, 65, 66, 67, 123, 124, 125, 126, 127, 1000):
        word = "".join(rng.choice(list("abcdé日"), size))
        marked = f"<{word}>"
        parts = [toxicity.bare(w) for w in toxicity.text_words(f"--{word}...")]
        grams = lambda s: {s[i : i + n] for n in (3, 4, 5, 6) for i in range(len(s) - n + 1)}
        assert set().union(*map(grams, parts)) == grams(marked)
        assert max(map(len, parts)) <= toxicity.WINDOW + 2
    assert toxicity.text_words("- " + "-" * 200) == ["-", "-" * 200]


def test_a_toxic_passage_late_in_a_run_without_spaces_is_seen():
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(2, 8)))
    text = lambda bad, by: by.join("zgrux" + word() if bad and k % 9 == 8 else word() for k in range(90))
    labels = np.arange(240) % 2
    model = toxicity.train([text(y, " ") for y in labels], labels, 0.5)
    glued = toxicity.Scorer(model).scores(["ab" * 40 + text(y, by) for by in ("", "-", ".") for y in (0, 1)])
    assert (glued[1::2] > glued[::2] + 0.3).all()
