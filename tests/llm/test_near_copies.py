import random
from itertools import combinations

import corpus_pipeline
from lodestar.llm import near_copies
from tests.llm.helpers import frame


def jaccard(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def copies():
    """Texts of 200 words and copies of them with 1 to 6 words changed: similarities from 0.73 to 0.95."""
    rng = random.Random(5)
    rows = []
    for family in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        rows.append((100 * family, " ".join(base), "en", "s0", 0))
        for i in range(1, 7):
            copy = list(base)
            for k in range(i):
                copy[20 + 30 * k] = f"x{family}x{i}x{k}"
            rows.append((100 * family + i, " ".join(copy), "en", "s0", 0))
    return rows


def kept_of(rows):
    up = {r[0]: r[0] for r in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(rows, 2):
        if jaccard(a[1], b[1]) >= 0.8 and find(a[0]) != find(b[0]):
            up[max(find(a[0]), find(b[0]))] = min(find(a[0]), find(b[0]))
    return sorted({find(x) for x in up})


def test_stage_removes_near_copies_from_similarity_08_on(spark):
    rows = copies()
    want = kept_of(rows)
    assert 12 < len(want) < len(rows) / 2
    got = corpus_pipeline.near_duplicates(spark, frame(spark, rows), "")
    assert sorted(r.doc_id for r in got.collect()) == want


def test_groups_equal_the_exact_join_where_all_share_a_passage(spark):
    rng = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [(r[0], r[1], *r[2:]) for r in copies()]
    rows += [(5000 + i, passage + " " + " ".join(f"w{rng.randrange(300)}" for _ in range(60)), "en", "s0", 0) for i in range(80)]
    groups = near_copies.similar_groups(frame(spark, rows)).collect()
    assert len(groups) == len(rows) and sorted({r.component_id for r in groups}) == kept_of(rows)


def test_links_past_the_least_and_the_greatest_set(spark, monkeypatch):
    """Chains of texts, each like its neighbours only, so that most links lie between neither end of a cell."""
    rng = random.Random(9)
    rows = []
    for chain in range(4):
        words = [f"w{rng.randrange(5000)}" for _ in range(120)]
        for i in range(25):
            rows.append((1000 * chain + i, " ".join(words[3 * i % 40 :] + words[: 3 * i % 40]), "en", "s0", 0))
            at = 4 * i % 116
            words[at : at + 3] = [f"c{chain}x{i}x{k}" for k in range(3)]
    groups = near_copies.similar_groups(frame(spark, rows)).collect()
    assert len(groups) == len(rows) and sorted({r.component_id for r in groups}) == kept_of(rows)


def test_empty_and_short_texts(spark):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, " \n", "en", "s", 0), (4, "One two", "en", "s", 0), (5, "one  TWO", "en", "s", 0), (6, "one three", "en", "s", 0), (None, "one two", "en", "s", 0), (7, "a b c d e", None, None, 0)]
    got = {(r.id, r.component_id) for r in near_copies.similar_groups(frame(spark, rows)).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (None, 4), (7, 7)}
    assert near_copies.similar_groups(frame(spark, rows).limit(0)).count() == 0


def test_walks_link_what_their_radius_allows():
    rng = random.Random(3)
    members = {rng.getrandbits(64) for _ in range(40)}
    for x in [*members][:20]:
        for _ in range(15):
            y = x
            for k in rng.sample(range(64), rng.randrange(1, 16)):
                y ^= 1 << k
            members.add(y)
    near = {frozenset(p) for p in combinations(members, 2) if (p[0] ^ p[1]).bit_count() <= 18}
    pairs = [*near_copies.walked([*members], 18)]
    assert {frozenset(p) for p in pairs} <= near and len({y for y, _ in pairs}) == len(pairs)
    assert len(members) - len(pairs) == len(parts_of(members, near))


def parts_of(members, pairs):
    left, out = set(members), []
    while left:
        part, grown = set(), [left.pop()]
        while grown:
            x = grown.pop()
            part.add(x)
            more = {y for p in pairs if x in p for y in p} & left
            left -= more
            grown += more
        out.append(part)
    return out


def test_stage_links_by_trees_of_simhashes_and_joins_only_what_they_leave(spark, monkeypatch):
    rows = copies()
    df, want = frame(spark, rows), kept_of(rows)
    of = {near_copies._digest(near_copies.shingle_set(r[1])): r for r in rows}
    trees, told = near_copies.tree_pairs, []
    monkeypatch.setattr(near_copies, "tree_pairs", lambda shards: told.append(trees(shards)) or told[-1])
    monkeypatch.setattr(near_copies, "discard", lambda *_: None)  # the shards are read again below
    got = corpus_pipeline.near_duplicates(spark, df, "").collect()
    assert sorted(r.doc_id for r in got) == want and len(told) == 1
    mask = (1 << 64) - 1
    pairs = {frozenset((of[r.u & mask][0], of[r.v & mask][0])) for r in told[0].collect()}
    text = {r[0]: r[1] for r in rows}
    holds = {p for p in pairs if jaccard(*(text[x] for x in p)) >= 0.8}
    assert len(rows) - len(parts_of(text, holds)) >= 0.9 * (len(rows) - len(want))
    # what trees don't give is found all the same
    monkeypatch.setattr(near_copies, "tree_pairs", lambda shards: trees(shards).limit(0))
    got = corpus_pipeline.near_duplicates(spark, df, "").collect()
    assert sorted(r.doc_id for r in got) == want
