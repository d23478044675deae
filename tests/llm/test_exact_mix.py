import random
from fractions import Fraction

import pytest
from lodestar.llm import op1_mix
from tests.llm.helpers import frame


def strays(weights, slots):
    """The furthest that any source gets from its unrounded share, in blocks, over so many slots of one phase."""
    exact = [Fraction(w) for w in weights]
    whole, done, worst = sum(exact), [0] * len(weights), 0
    for i, block, phase, release, deadline, slot in op1_mix.schedule([10**9] * len(weights), weights):
        assert phase == 0 and release <= slot < deadline and block == done[i]
        done[i] += 1
        # a source is furthest behind before a block of its own and furthest ahead after it
        share = exact[i] / whole
        worst = max(worst, abs(done[i] - share * (slot + 1)), abs(done[i] - 1 - share * slot))
        if slot + 1 == slots:
            break
    return max(worst, *(abs(n - w / whole * slots) for n, w in zip(done, exact, strict=True)))


@pytest.mark.parametrize("weights", [[1, 2], [1, 1, 1], [5e-05, 1.0], [1 / 3, 2**0.5, 0.1]])
def test_deviation_from_unrounded_weights_over_many_periods(weights):
    assert strays(weights, 100_000) < 1


@pytest.mark.parametrize("n", [900, 1000])
def test_hundreds_of_sources_keep_their_weights(n):
    rng = random.Random(n)
    assert strays([rng.random() ** 4 + 1e-6 for _ in range(n)], 30_000) < 1


def test_more_than_a_thousand_sources(spark):
    rows = [(i, f"text {i}", "en", f"s{i % 1001}", 0) for i in range(2002)]
    got = op1_mix.mix(frame(spark, rows), block_rows=1).collect()
    assert sorted(r.mix_pos for r in got) == list(range(2002)) and len({r.source for r in got}) == 1001


def test_equal_deadlines_go_by_name():
    assert [i for i, *_ in op1_mix.schedule([3, 3, 3], [1, 1, 1])] == [0, 1, 2] * 3


def test_query_against_the_definition(spark, tmp_path):
    """Positions by a plain simulation over the rows that the query's own ranks name."""
    rows = [(i, f"text {i}" * (1 + i % 5), "en", "abc"[i % 7 % 3], 0) for i in range(3000)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(op1_mix.op1_mix(spark, str(tmp_path)).collect(), key=lambda r: r.mix_pos)
    assert sorted(r.doc_id for r in got) == list(range(3000)) and [r.mix_pos for r in got] == list(range(3000))
    sources = sorted({r[3] for r in rows})
    count = {s: sum(r[3] == s for r in rows) for s in sources}
    left, weight, done, t, begun, want = dict(count), {s: Fraction(count[s] ** 0.5) for s in sources}, dict.fromkeys(sources, 0), 0, 0, []
    while any(left.values()):
        alive = [s for s in sources if left[s]]
        share = {s: weight[s] / sum(weight[x] for x in alive) for s in alive}
        free = [(-(-(done[s] + 1) // share[s]), s) for s in alive if int(done[s] / share[s]) <= t - begun]
        s = min(free)[1]
        n = min(64, left[s])
        want += [s] * n
        left[s] -= n
        done[s] += 1
        t += 1
        if not left[s]:
            done, begun = dict.fromkeys(sources, 0), t
    assert [r.source for r in got] == want


def test_schedule_fills_every_slot_once():
    rng = random.Random(3)
    for _ in range(50):
        blocks = [rng.randrange(0, 40) for _ in range(rng.randrange(1, 9))]
        weights = [rng.choice([0, rng.random(), 3]) for _ in blocks]
        got = list(op1_mix.schedule(blocks, weights))
        assert [g[5] for g in got] == list(range(sum(blocks)))
        assert sorted(g[:2] for g in got) == [(i, j) for i, n in enumerate(blocks) for j in range(n)]
        assert all(g[3] <= g[5] < g[4] for g in got)


def test_table_follows_the_unrounded_weights(spark):
    rows = [(i, f"text {i}", "en", "b" if i % 3 else "a", 0) for i in range(12_000)]
    got = op1_mix.mix(frame(spark, rows), {"a": 1, "b": 2}, block_rows=1).collect()
    assert sorted(r.mix_pos for r in got) == list(range(12_000))
    for r in got:
        ratio = 3 if r.source == "a" else Fraction(3, 2)
        if r.phase == 0:
            assert r.release == int(r.block * ratio) and r.deadline == -int(-(r.block + 1) * ratio // 1)
