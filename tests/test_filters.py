"""Filters compose, refuse, travel as links; narrowing equals slicing."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from banderole.operators import filters
from banderole.operators.filters import State
from banderole.operators.series import Filter


def test_restrict_narrows_and_refuses():
    f = Filter(tier="AB", constant_scope=True)
    assert filters.restrict(f, "grade", ["g1|A", "g2|A"]) == Filter(tier="A", grades=("g1", "g2"))
    assert filters.restrict(f, "grade", ["g1|A", "g2|B"]) is None
    assert filters.restrict(f, "family", ["x|y|B"], constant_scope=True) == Filter(tier="B", families=("x|y",), constant_scope=True)
    assert filters.restrict(f, "org", ["o|A"]) == Filter(tier="AB", orgs=("o|A",))
    assert filters.restrict(Filter(), "profession", []) is None
    assert filters.restrict(Filter(), "role", ["Digital"]) is None and filters.restrict(Filter(), "none", ["All"]) is None
    assert filters.restrict(Filter(profs=("p",)), "profession", ["q"]) is None
    assert filters.restrict(Filter(profs=("p", "q")), "profession", ["q", "q"]) == Filter(profs=("q",))


def test_both_is_an_intersection():
    a, b = Filter(grades=("x", "y"), first="2001", ddat=True), Filter(grades=("y", "z"), first="2003", last="2005", orgs=("o",))
    assert filters.both(a, b) == Filter(grades=("y",), first="2003", last="2005", ddat=True, orgs=("o",))
    assert filters.both(a, Filter(grades=("z",))) is None and filters.both(a, Filter(ddat=False)) is None
    assert filters.both(Filter(first="2005"), Filter(last="2001")) is None and filters.both(Filter(grain="half"), Filter()) is None
    assert filters.both(Filter(tier="AB"), Filter(tier="B")) == Filter(tier="B") and filters.both(Filter(tier="A"), Filter(tier="B")) is None


names = st.text(min_size=1, max_size=5)
some = st.none() | st.lists(names, min_size=1, max_size=4, unique=True).map(tuple)
any_filter = st.builds(Filter, orgs=some, grades=some, profs=some, families=some, ddat=st.none() | st.booleans(), tier=st.sampled_from(["A", "B", "AB"]), first=st.none() | st.sampled_from(["2001", "2004"]))


@settings(max_examples=200, deadline=None)
@given(any_filter, any_filter)
def test_both_is_commutative_and_idempotent(a, b):
    assert filters.both(a, a) == a
    x, y = filters.both(a, b), filters.both(b, a)
    assert (x is None) == (y is None)
    if x is not None:
        same = lambda f: {k: frozenset(v) if isinstance(v, tuple) else v for k, v in vars(f).items()}
        assert same(x) == same(y) and filters.both(x, a) == x


states = st.builds(State, tab=names, measure=names, dimension=names, orgs=st.lists(names, max_size=3).map(tuple), ddat=st.integers(0, 2), policy=st.integers(0, 2), tier_b=st.booleans(), real_terms=st.booleans(), basis=st.sampled_from(filters.CHOICES["basis"]), grain=st.sampled_from(filters.CHOICES["grain"]))


@settings(max_examples=200, deadline=None)
@given(states)
def test_links_round_trip(state):
    text = filters.link(state)
    assert filters.opened(text) == state == filters.opened("#" + text)
    assert all(c.isalnum() or c in "-_" for c in text)


@pytest.mark.parametrize("text", ["", "#", "nonsense", "eJwDAAAAAAE", "e30", "%%%", "eJwzAAAAMgAy"])
def test_broken_links_open_nothing(text):
    assert filters.opened(text) is None


def test_unknown_choices_are_defaults():
    import base64
    import json
    import zlib

    text = base64.urlsafe_b64encode(zlib.compress(json.dumps({"basis": "odd", "grain": "year", "ddat": 7, "new": 1, "orgs": [3]}).encode())).decode()
    assert filters.opened(text) == State(grain="year", orgs=("3",))


def test_state_to_filter():
    f = filters.filter_of(State(orgs=("o",), ddat=2, policy=1, tier_b=True, basis="constant-scope", disclosure="withheld", grain="half"), base_year=2001)
    assert f == Filter(orgs=("o",), ddat=False, policy=True, tier="AB", constant_scope=True, disclosure="withheld", grain="half", base_year=2001)
    assert filters.filter_of(State()) == Filter(grain="quarter")
