"""Embedded elements end where they end: what follows them stays."""

import numpy as np
import pytest

from banderole.llm import html_crf

TEXT = "Rest of the article, which goes on for a whole sentence."


def texts(page):
    return [b.text for b in html_crf.leaf_blocks(page)]


@pytest.mark.parametrize("tag", ["svg", "iframe", "object", "select", "template", "noscript"])
def test_what_follows_an_embedded_element_stays(tag):
    for opened in (f'<{tag} class="i"/>', f'<{tag} class="i">', f'<{tag}-part name="x"></{tag}-part>', f"<{tag}></{tag}>"):
        assert texts(f"<p>a</p>{opened}<p>{TEXT}</p>") == ["a", TEXT], opened
    assert texts(f"<p>a <{tag}></{tag}>b</p>") == ["a b"]
    assert texts(f"<p>a <{tag}>x</{tag}>b</p><p>c</p>") == ["x", "a b", "c"]
    assert texts(f"<ul><li>a<{tag}><li>b</ul><p>c</p>") == ["a", "b", "c"]


def test_blocks_end_an_unclosed_icon_or_menu():
    assert texts(f"<div><svg><p>{TEXT}</p></div><svg></svg>") == [TEXT]
    assert html_crf.leaf_blocks(f"<div><svg><p>{TEXT}</p></div><svg></svg>")[0].path[:2] == ("a:div", "a:p")
    assert texts("<script>x</script-y>y</script>z<style-guide>k</style-guide>") == ["z", "k"]


def test_field_keeps_the_article_around_embedded_elements():
    page = "<html><body><nav><a href=/>Home</a></nav><article><h1>Title of it</h1><p>{0}</p>{1}<p>{0}</p><p>{0}</p></article></body></html>"
    field = html_crf.trained()
    for tag in ("svg", "iframe", "object", "select", "template", "noscript"):
        for element in (f'<{tag} class="i"/>', f"<{tag}>", f"<{tag}>Not shown here</{tag}>"):
            assert html_crf.main_text(page.format(TEXT, element), field).split("\n\n") == ["Title of it", TEXT, TEXT, TEXT], element
    right = total = 0
    for _ in range(60):
        made, labels = html_crf.labelled_page(np.random.default_rng([9, total]))
        got = field.viterbi(html_crf.leaf_blocks(made))
        right, total = right + sum(a == b for a, b in zip(got, labels, strict=True)), total + len(labels)
    assert right / total > 0.97
