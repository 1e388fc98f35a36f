"""The schedule against a walk over its slots, with windows from exact fractions."""

import heapq
import random
from fractions import Fraction

import pytest

from banderole.llm import pfair


def walk(sources):
    """{(source, block): (release, deadline, slot)}: at each slot the released block that is due first."""
    left = sorted(((Fraction(n, w), n, w) for n, w in sources.values()), reverse=True)
    ended, weight = 0, sum(w for _, w in sources.values())
    release, due = {(s, 0): 0 for s in sources}, {}
    for v, s, k in sorted((Fraction(k, w), s, k) for s, (n, w) in sources.items() for k in range(1, n + 1)):
        while left and left[-1][0] <= v:
            _, n, w = left.pop()
            ended, weight = ended + n, weight - w
        time = ended + v * weight
        due[s, k - 1], release[s, k] = -(-time.numerator // time.denominator), time.numerator // time.denominator
    blocks = sorted((release[x], due[x], *x) for x in due)
    ready, at, out = [], 0, {}
    for slot in range(len(blocks)):
        while at < len(blocks) and blocks[at][0] <= slot:
            r, d, s, j = blocks[at]
            heapq.heappush(ready, (d, s, j, r))
            at += 1
        d, s, j, r = heapq.heappop(ready)
        assert r <= slot < d
        out[s, j] = (r, d, slot)
    return out


def check(spark, sources, chunk_bits):
    table = spark.createDataFrame([(s, n, w) for s, (n, w) in sources.items()], "s string, n long, w long")
    got = pfair.schedule(table, chunk_bits).collect()
    want = walk(sources)
    assert len(got) == len(want) and {(r["s"], r["j"]): (r["r"], r["d"], r["slot"]) for r in got} == want
    return want


def drawn(count, seed):
    rng = random.Random(seed)
    out = {f"s{i}": (rng.choice((1, 1, 2, 3, 9)), rng.choice((1, 5, 1 << 30, rng.randint(1, 1 << 30)))) for i in range(count)}
    return out | {"hot": (count // 2 * 3 + 5, 1 << 30)}


@pytest.mark.parametrize("count, chunk_bits", [(1, 12), (5, 1), (40, 3), (510, 12), (512, 6), (20_000, 12)])
def test_schedule_equals_the_walk(spark, count, chunk_bits):
    check(spark, drawn(count, count), chunk_bits)


def test_every_source_stays_within_a_block_of_its_share(spark):
    rng = random.Random(1)
    sources = {f"s{i}": (rng.randint(1, 8), rng.randint(1, 50)) for i in range(60)}
    want = check(spark, sources, 4)
    order = [s for _, (s, _) in sorted((slot, x) for x, (_, _, slot) in want.items())]
    due, have = dict.fromkeys(sources, Fraction(0)), dict.fromkeys(sources, 0)
    for s in order:
        have[s] += 1
        time = Fraction(1)  # one slot of the ideal sharing, source by source that ends in it
        while time:
            live = {x: w for x, (n, w) in sources.items() if due[x] < n}
            step = min(time / sum(live.values()), min((sources[x][0] - due[x]) / w for x, w in live.items()))
            due = {x: d + step * live.get(x, 0) for x, d in due.items()}
            time -= step * sum(live.values())
        assert all(abs(have[x] - due[x]) < 1 for x in sources)


def test_no_sources_and_equal_ones(spark):
    assert pfair.schedule(spark.createDataFrame([], "s string, n long, w long")).count() == 0
    check(spark, {f"s{i}": (3, 7) for i in range(33)}, 2)
    check(spark, {"": (1, 1)}, 12)
