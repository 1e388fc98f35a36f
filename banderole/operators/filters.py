"""Filters that compose, narrow to groups and travel as links.

``restrict`` turns keys of a result back into a filter, so that the rest of a ranking can be asked for as its own aggregate: two medians can't be
added.  What can't be expressed is refused (None), never approximated.  ``both`` is the intersection of two filters; one that nothing passes is refused too.
"""

from __future__ import annotations

import base64
import json
import zlib
from dataclasses import asdict, dataclass, fields, replace

from .series import Filter

#: The tuple of a filter that a dimension's keys narrow.
NARROWS = {"org": "orgs", "department": "orgs", "family": "families", "grade": "grades", "profession": "profs"}
TUPLES = ("orgs", "families", "grades", "profs", "scs_grades")
SINGLE = ("ddat", "policy", "disclosure", "constant_scope", "base_year")


def split_key(key: str) -> tuple[str, str | None]:
    """The group and the tier of a key; a bar that no tier follows belongs to the group."""
    base, bar, tier = key.rpartition("|")
    return (base, tier) if bar and tier in ("A", "B") else (key, None)


def _meet(a: tuple | None, b: tuple | None) -> tuple | None:
    if a is None or b is None:
        return a if b is None else tuple(b)
    return tuple(x for x in a if x in b)


def restrict(base: Filter, dimension: str, keys: list[str], *, constant_scope: bool | None = None) -> Filter | None:
    """``base`` narrowed to the groups with these keys; None where that is no filter: several tiers, no keys, none of them within
    ``base``, or a dimension without a selection."""
    name = NARROWS.get(dimension)
    parts = [split_key(k) for k in keys] if base.tier == "AB" and dimension not in ("org", "department") else [(k, None) for k in keys]
    tiers = {t for _, t in parts if t}
    if name is None or not parts or len(tiers) > 1:
        return None
    chosen = _meet(getattr(base, name), tuple(dict.fromkeys(k for k, _ in parts)))
    if not chosen:
        return None
    return replace(base, **{name: chosen}, tier=tiers.pop() if tiers else base.tier, constant_scope=constant_scope)


def both(a: Filter, b: Filter) -> Filter | None:
    """What passes both; None if nothing can, or if they ask for different grains, lineage or bases."""
    out = {name: _meet(getattr(a, name), getattr(b, name)) for name in TUPLES}
    if any(v == () for v in out.values()) or a.grain != b.grain or a.lineage != b.lineage:
        return None
    for name in SINGLE:
        x, y = getattr(a, name), getattr(b, name)
        if x is not None and y is not None and x != y:
            return None
        out[name] = y if x is None else x
    tier = a.tier if b.tier == "AB" else b.tier if a.tier == "AB" else a.tier
    if tier not in (b.tier, a.tier) or (a.tier != b.tier and "AB" not in (a.tier, b.tier)):
        return None
    first, last = max((x for x in (a.first, b.first) if x), default=None), min((x for x in (a.last, b.last) if x), default=None)
    if first and last and first > last:
        return None
    return Filter(**out, tier=tier, first=first, last=last, grain=a.grain, lineage=a.lineage)


@dataclass(frozen=True)
class State:
    """What a view shows; empty selections are all."""

    tab: str = "explore"
    measure: str = "median"
    dimension: str = "department"
    orgs: tuple = ()
    profs: tuple = ()
    grades: tuple = ()
    ddat: int = 0  # 0 both, 1 only, 2 without
    policy: int = 0
    real_terms: bool = False
    table: bool = False
    tier_b: bool = False
    basis: str = "raw"
    scale: str = "shared"
    disclosure: str = "all"
    grain: str = "quarter"


# What a link may say; anything else is the default.
CHOICES = {"basis": ("raw", "reweighted", "constant-scope"), "scale": ("shared", "own"), "disclosure": ("all", "disclosed", "withheld"), "grain": ("date", "quarter", "half", "year"), "ddat": (0, 1, 2), "policy": (0, 1, 2)}


def filter_of(state: State, **more) -> Filter:
    """The filter of a view; ``more`` overrides it."""
    of = {0: None, 1: True, 2: False}
    made = {
        "orgs": state.orgs or None, "profs": state.profs or None, "grades": state.grades or None, "ddat": of[state.ddat], "policy": of[state.policy], "tier": "AB" if state.tier_b else "A",
        "disclosure": None if state.disclosure == "all" else state.disclosure, "grain": state.grain, "constant_scope": True if state.basis == "constant-scope" else None,
    }
    return Filter(**(made | more))


def link(state: State) -> str:
    """A view as text for an address; only what isn't default, compressed."""
    packed = {k: v for k, v in asdict(state).items() if v != getattr(State, k)}
    return base64.urlsafe_b64encode(zlib.compress(json.dumps(packed, separators=(",", ":"), sort_keys=True).encode(), 9)).decode().rstrip("=")


def opened(text: str) -> State | None:
    """The view of a link; None if it is none.  Unknown choices are the defaults, so older links open."""
    try:
        packed = json.loads(zlib.decompress(base64.urlsafe_b64decode(text.lstrip("#") + "=" * (-len(text.lstrip("#")) % 4))))
        if not isinstance(packed, dict):
            return None
        known = {f.name: getattr(State, f.name) for f in fields(State)}
        kept = {}
        for k, v in packed.items():
            if k not in known or (k in CHOICES and v not in CHOICES[k]):
                continue
            kept[k] = tuple(map(str, v)) if isinstance(known[k], tuple) else type(known[k])(v)
        return State(**kept)
    except (ValueError, TypeError, zlib.error):
        return None
