"""Conversation repair against an exhaustive search over edit strings."""

import functools
import hashlib
import random
import re
import zlib

import pytest

from banderole.llm import repair

WORD = re.compile(r"[^\x20\x09-\x0D]")
SCHEMA = "conv_id long, turn long, role string, text string, cost int"


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        last = WORD.findall(text)
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, edits, turns) by search over all edits, ASCII-least first among equals; few inserts ever pay."""
    kinds = faults(rows)

    @functools.cache
    def best(i, roles, inserts):
        # roles: initials so far, reduced to what the grammar can still see
        out = []
        if i == len(rows) and (roles == "" or roles == "a"):
            out.append((0, "", ()))
        steps = []
        if i < len(rows):
            _, role, text = rows[i]
            steps.append(("D", 2, i + 1, roles, None))
            if kinds[i] not in ("blank", "duplicate"):
                add = 5 if kinds[i] == "truncated" else 0
                steps.append(("K", add, i + 1, role[:1], f"{role}:{text}"))
                steps += [("R", add + 1, i + 1, r[0], f"{r}:{text}") for r in ("user", "assistant")]
        if inserts < 4:
            steps += [("I", 5, i, r[0], f"{r}:") for r in ("user", "assistant")]
        for edit, cost, j, now, said in steps:
            if said is not None and not (roles + now in ("s", "u", "su", "ua", "au") and len(roles + now) == bool(roles) + 1):
                continue
            rest = best(j, now if said is not None else roles, inserts + (edit == "I"))
            if rest is not None:
                out.append((cost + rest[0], edit + rest[1], (() if said is None else (said,)) + rest[2]))
        return min(out, default=None)

    return best(0, "", 0)


def expected(rows):
    rows = sorted(((t, r or " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    kinds, (cost, audit, said) = faults(rows), cheapest(rows)
    turns = {t for t, *_ in rows if t is not None}
    first = [r[:1] for _, r, _ in rows]
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])), cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest(), list(said),
    )


def made(seed=1, conversations=150):
    rng = random.Random(seed)
    out = {}
    for c in range(conversations):
        rows = []
        for t in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "Sam", "ubot"])
            rows.append((rng.choice([t, t, t, t, None, t + 3]), role, rng.choice(["ok.", "cut", "", " \n", None, "why?", "cut off \t", "yes!"])))
            if rng.random() < 0.15:
                rows.append(rows[-1])
        out[c if c else None] = rows
    return out


@pytest.mark.parametrize("chunk", [1, 3, 1024])
def test_equals_exhaustive_search(spark, monkeypatch, chunk):
    monkeypatch.setattr(repair, "CHUNK_ROWS", chunk)
    data = made()
    df = spark.createDataFrame([(c, t, r, x, 7) for c, rows in data.items() for t, r, x in rows], SCHEMA).repartition(4)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.report(df).collect()}
    want = {c: expected(rows) for c, rows in data.items()}
    assert {c: w[:-1] for c, w in want.items()} == got
    said: dict = {}
    for r in sorted(repair.repaired(df).collect(), key=lambda r: r["position"]):
        said.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert said == {c: w[-1] for c, w in want.items() if w[-1]}


def test_chunk_tables_compose():
    rng = random.Random(5)
    rows = [(rng.choice("usa t") + "x", rng.choice(["blank", "duplicate", "truncated", "", "", ""]), rng.choice([1, 1, 1, 4])) for _ in range(60)]
    whole = repair.cost_to_go(rows, repair.END)
    for cut in (1, 7, 30, 59):
        after = repair.through(repair.table(rows[cut:]), repair.END)
        assert after == whole[cut] and repair.through(repair.table(rows[:cut]), after) == whole[0]


def test_one_conversation_with_most_rows_and_many_repeats(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"turn {i}.", 0) for i in range(6_000)] + [(1, 6_000, "user", "again.", 0)] * 5_000
    got = repair.report(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()[0]
    # the row that is left over is deleted, not followed by an insert
    assert (got["cost"], got["duplicate"], got["illegal"], got["gaps"]) == (2 * 5_000, 4_999, 4_999, 0)
    assert got["audit"] == "K" * 6_000 + "D" * 5_000
    assert got["repaired_sha256"] == hashlib.sha256("\n".join(f"{r}:{x}" for _, _, r, x, _ in rows[:6_000]).encode()).hexdigest()


def test_damage_is_by_crc(spark):
    rows = [(c, t, "assistant", f"text {t}. yes! no?", 0) for c in (None, 3, 4) for t in (None, *range(40))]
    got = {(r["conv_id"], r["turn"]): (r["role"], r["text"], r["times"]) for r in repair.damage(spark.createDataFrame(rows, SCHEMA)).collect()}
    for c, t, role, text, _ in rows:
        hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        want = {1: (role, "", 1), 2: (role, text.translate(str.maketrans("", "", ".!?")), 1), 3: (role, text, 2), 4: ("user", text, 1)}.get(hit, (role, text, 1))
        assert got.get((c, t)) == (None if hit == 0 else want)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert repair.report(repair.damage(df)).count() == 0
