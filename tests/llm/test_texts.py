"""Licences (3), scores (5), decontamination (6), language (8), secrets (9)."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lodestar.llm import op3_license, op5_lm_score, op6_decontaminate, op8_language, op9_secrets, words
from tests.llm.helpers import awkward, clashing, frame, rows_of

SF = "/root/testdata/sf0.01"


def tokens(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").lower().encode())


def test_words_of_many_texts():
    texts = [r[1] for r in awkward()]
    hashes, per = {}, Counter()
    for h, of, _, _, _ in words.blocks(texts):
        for x, t in zip(h.tolist(), of.tolist(), strict=True):
            word = tokens(texts[t])[per[t]]
            per[t] += 1
            assert hashes.setdefault(word, x) == x
    assert all(per[i] == len(tokens(t)) for i, t in enumerate(texts))
    assert len(set(hashes.values())) == len(hashes)


def test_license_statements(spark):
    rows = frame(spark).collect()
    said = {
        1: ("Licensed under the Apache License, Version 2.0.", "apache"), 2: ("RELEASED UNDER THE MIT LICENSE!", "mit"), 3: ("some words\nThis work is licensed under the GNU General Public License, version 3.\nmore", "gpl"),
        4: ("Licensed under CC BY-NC 4.0.", "cc-by-nc"), 5: ("This data is licensed under the terms of the farm public license", "unknown"), 6: ("she renewed her driving license in june", None), 7: ("x " * 4000, None),
    }
    more = [(1000 + k, t, "en", "s", len(t)) for k, (t, _) in said.items()]
    got = {r.doc_id: r for r in op3_license.license_scan(frame(spark, [tuple(r) for r in rows] + more)).collect() if r.doc_id is not None}
    assert {k: got[1000 + k].family for k in said} == {k: f for k, (_, f) in said.items()}
    assert all(got[r[0]].family is None for r in awkward() if r[0] is not None)
    assert all(0 <= r.confidence <= 1 for r in got.values() if r.family)


def test_license_edges(spark):
    assert op3_license.license_scan(frame(spark).limit(0)).count() == 0
    assert op3_license.license_scan(clashing(frame(spark))).count() == len(awkward())


def test_license_recall_by_family_with_wrapped_statements():
    """Statements that training doesn't make, wrapped anywhere, amid words of their own."""
    rng = random.Random(7)
    model = op3_license.Scanner(op3_license.fit([" ".join(f"w{rng.randrange(900)}" for _ in range(70)) for _ in range(300)]))
    frames = ["You may use these pages under the {} if you like", "Everything here is offered under the {} since last year", "All sources are made available under the {}"]
    for family, names in op3_license.NAMES.items():
        texts = []
        for k in range(20):
            said = frames[k % 3].format(names[k % len(names)].title()).split()
            said.insert(rng.randrange(1, len(said)), "\n")
            noise = lambda: " ".join(f"w{rng.randrange(900)}" for _ in range(rng.randrange(25)))
            texts.append(f"{noise()}\n\n{noise()} {' '.join(said)} {noise()}\n\n{noise()}")
        found = {t for t, _, f, _, _ in model(texts) if f == family}
        assert len(found) >= 18, (family, [t for i, t in enumerate(texts) if i not in found])


@pytest.mark.parametrize(
    ("text", "family"),
    [
        ("Licensed under the Apache License,\nVersion 2.0 (the License);", "apache"), ("Licensed under the\nApache License", "apache"), ("SPDX-License-Identifier: Apache-2.0", "apache"),
        ("Permission is hereby granted, free of charge, to any\nperson obtaining a copy of this software", "mit"), ("under the terms of the GNU General\nPublic License as published", "gpl"),
        ("SPDX-License-Identifier: LGPL-2.1-or-later", "lgpl"), ("subject to the terms of the CDDL 1.0", "cddl"), ("This is released under the WTFPL", "wtfpl"),
        ("This text is not released under the MIT license", None), ("It isn't licensed under the\nGNU General Public License", None),
    ],
)
def test_license_wrapped_tagged_and_denied(scanner, text, family):
    found = {f for _, _, f, _, _ in scanner([text])}
    assert found == ({family} if family else set())


@pytest.fixture(scope="module")
def scanner():
    return op3_license.Scanner(op3_license.fit(["the boat was old and the sea was calm " * 5, "a man walked home through the rain and sang " * 5]))


def test_license_ties_go_by_name():
    assert op3_license.summary([("mit", 0.5), ("apache", 0.5), ("unknown", 0.9)]) == ("apache", 0.5, "apache,mit", 3, 1)
    assert op3_license.summary([("unknown", 0.9)]) == ("unknown", 0.9, "", 1, 1) and op3_license.summary([]) == (None, None, "", 0, 0)


def test_license_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r.families.split(",") for r in op3_license.license_scan(docs).collect()}
    lines = {"apache": "Licensed under the Apache License, Version 2.0.", "mit": "Released under the MIT License.", "gpl": "licensed under the GNU General Public License, version 3.", "cc-by-nc": "Licensed under CC BY-NC 4.0."}
    for r in docs.collect():
        for family, line in lines.items():
            assert (family in got[r.doc_id]) == (line.lower() in r.text.lower()), (r.doc_id, family)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_against_counting(spark, order):
    rows = awkward()
    docs = [tokens(r[1]) for r in rows]
    own = [Counter(tuple(w[j : j + k]) for k in range(1, order + 1) for j in range(len(w) - k + 1)) for w in docs]
    total = sum(own, Counter())
    n = sum(map(len, docs))
    want = []
    for w, mine, r in zip(docs, own, rows, strict=True):
        score = 0.0
        for p in range(len(w)):
            reach = min(p + 1, order)
            for k in range(reach, -1, -1):
                g = tuple(w[p - k + 1 : p + 1])
                if k == 0:
                    score += reach * math.log(0.4) - math.log(max(1, n - len(w)))
                elif total[g] > mine[g]:
                    below = total[g[:-1]] - mine[g[:-1]] if k > 1 else n - len(w)
                    score += (reach - k) * math.log(0.4) + math.log((total[g] - mine[g]) / below)
                    break
        want.append((r[0], len(w), round(score, 6), round(score / len(w), 6) if w else None))
    got = op5_lm_score.lm_scores(clashing(frame(spark)), order).collect()
    assert Counter((r[0], r[1], round(r[2], 6) + 0.0, None if r[3] is None else round(r[3], 6)) for r in got) == Counter(want)


def test_scores_edges(spark):
    assert op5_lm_score.lm_scores(frame(spark).limit(0)).count() == 0
    with pytest.raises(ValueError):
        op5_lm_score.lm_scores(frame(spark), 0)
    x = np.array([0, 1, 2**64 - 1, 2**40], np.uint64)
    assert (op5_lm_score.unpack(op5_lm_score.pack(x)) == x).all()


def greedy(doc, item, least):
    """Greedy string tiling by its definition."""
    a, b, found = [False] * len(doc), [False] * len(item), []
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and not a[i + n] and not b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return found
        found.append((i, j, n))
        for k in range(n):
            a[i + k] = b[j + k] = True


def test_tiles_against_definition():
    rng = random.Random(4)
    for _ in range(200):
        doc, item = (np.array([rng.randint(0, 2) for _ in range(rng.randint(0, m))], np.uint64) for m in (30, 15))
        seeds = [(i, j) for i in range(len(doc) - 2) for j in range(len(item) - 2) if (doc[i : i + 3] == item[j : j + 3]).all()]
        assert sorted(op6_decontaminate.tiles(doc, item, seeds, 3)) == sorted(greedy(doc.tolist(), item.tolist(), 3))


def test_tiler_against_definition():
    """Phrases that nearly all items share, and items that repeat themselves."""
    rng = random.Random(5)
    for _ in range(25):
        say = lambda n: " ".join(rng.choice("abc") if rng.random() < 0.9 else rng.choice("defgh") for _ in range(n))
        items = [(k, say(rng.randint(0, 14))) for k in range(12)]
        texts = [say(rng.randint(0, 60)) for _ in range(6)] + [items[3][1] * 2, None]
        got = {(t, i): (round(share, 9), n, longest) for t, i, share, n, longest in op6_decontaminate.Tiler(items, 3, 0.5)(texts)}
        want = {}
        for t, text in enumerate(texts):
            for k, item in items:
                found = greedy((text or "").split(), item.split(), 3)
                if found and sum(n for _, _, n in found) >= 0.5 * len(item.split()):
                    want[t, k] = (round(sum(n for _, _, n in found) / len(item.split()), 9), len(found), max(n for _, _, n in found))
        assert got == want


def test_leaks(spark):
    rng = random.Random(6)
    say = lambda n: " ".join("".join(rng.choice("abcdefghijkl") for _ in range(5)) for _ in range(n))
    items = [(i, say(30)) for i in range(5)] + [(5, "too short"), (6, None), (7, "")]
    w = items[1][1].split()
    docs = [
        (0, say(50) + " " + items[0][1] + " " + say(50)), (1, " ".join(w[15:]) + " " + say(9) + " " + " ".join(w[:15])),  # reordered
        (2, say(100)), (3, items[2][1].upper().replace(" ", ", ")), (4, " ".join(items[3][1].split()[:10]) + say(50)), (5, None), (6, ""), (7, "too short"), (8, items[4][1]), (8, items[4][1]),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = clashing(frame(spark, [(i, t, None, None, None) for i, t in docs]))
    want = sorted([(0, 0), (1, 1), (3, 2), (8, 4), (8, 4)])
    for size in (1 << 20, 100):  # one block, and several
        got = op6_decontaminate.leaks(df, bench, block_bytes=size)
        assert sorted((r.doc_id, r.item_id) for r in got.collect()) == want
        stays = op6_decontaminate.decontaminate(df, bench, block_bytes=size)
        assert sorted(r.doc_id for r in stays.collect()) == [2, 4, 5, 6, 7] and stays.columns == df.columns
    assert op6_decontaminate.leaks(df, bench.limit(0)).count() == op6_decontaminate.leaks(df.limit(0), bench).count() == 0
    assert op6_decontaminate.decontaminate(df, bench.limit(0)).count() == len(docs)


def test_leaks_of_whole_items_in_the_tables(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    flat = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    items = [(r.item_id, flat(r.text)) for r in bench.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items if t in flat(r.text)}
    got = op6_decontaminate.leaks(docs, bench).collect()
    assert want and {(r.doc_id, r.item_id) for r in got if r.coverage == 1} == want


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = op8_language.op8_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_tables_give_what_the_network_gives():
    rng = np.random.default_rng(1)
    x = rng.integers(0, op8_language.CLASSES, (40, op8_language.WINDOW))
    net = op8_language.train(x, rng.integers(0, 3, 40), ["a", "b", "c"], epochs=1)
    e = net.embed[x]
    hidden = []
    for w, f, b in zip(op8_language.WIDTHS, net.filters, net.bias, strict=True):
        col = np.concatenate([e[:, j : op8_language.WINDOW - w + 1 + j] for j in range(w)], axis=2)
        hidden.append(np.maximum(0, (col @ f + b).max(axis=1)))
    z = np.concatenate(hidden, axis=1) @ net.out + net.out_bias
    want = np.exp(z - z.max(axis=1, keepdims=True))
    assert np.allclose(op8_language.Predictor(net).windows(x), want / want.sum(axis=1, keepdims=True), atol=1e-4)


def test_language_edges(spark):
    df = clashing(frame(spark))
    net = op8_language.fit(df)
    got = op8_language.predict(df, net, ["doc_id", "text"]).collect()
    assert len(got) == len(awkward())
    for r in got:
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, r.text or "")))
    assert op8_language.fit(df.limit(0)) is None
    assert {r.lang_pred for r in op8_language.predict(df, None, ["doc_id"]).collect()} == {"und"}
    stays = op8_language.identify(frame(spark), min_score=0)
    assert stays.count() == sum(any(map(str.isalpha, r[1] or "")) for r in awkward())
    assert op8_language.identify(frame(spark).limit(0)).count() == 0


BASE = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]


def base_spans(text):
    found = [(m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(BASE) for m in p.finditer(text or "") if len(m[g]) >= n]
    return [(BASE[k][0], s, e) for s, k, e in sorted(found)]


def secrets():
    rng = random.Random(8)
    parts = ["password=", "Secret : ", "API_KEY='", "apikey=", "token=abc", "secret=token:abcdefgh", "AKIA" + "A1" * 8, "AKIAAKIA", "AKIA" + "Z" * 15, "0a" * 12, "f" * 23, "é漢\U0001f600", "x9Y+/_=.-", "'", '"', "\n", " ", "ghp_" + "a1B2" * 9, "xoxb-" + "1" * 12, "paſſword=abcdefgh"]
    return [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40))), None, f"s{i % 5}", 0) for i in range(300)]


def test_secrets_against_definition(spark, tmp_path):
    rows = secrets() + [(i and i + 1000, t, lang, s, n) for i, t, lang, s, n in awkward()]
    clashing(frame(spark, rows)).write.parquet(str(tmp_path / "documents.parquet"))
    got = op9_secrets.op9_secrets(spark, str(tmp_path)).collect()
    want = Counter()
    for i, text, *_ in rows:
        spans = base_spans(text)
        n = Counter(k for k, _, _ in spans)
        said = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        want[i, n["assign"], n["access"], n["hex"], hashlib.sha256(said.encode()).hexdigest()] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    for r in got:
        base = ",".join(x for x in r.spans.split(",") if x and not x.startswith("vendor"))
        assert hashlib.sha256(base.encode()).hexdigest() == r.base_sha256


def test_owners_tell_examples_from_live_ones(spark):
    example, live = "password=hunter2example", "password=s3cr3tlive99"
    rows = [(i, example, None, f"s{i}", 0) for i in range(5)] + [(10 + i, live, None, "s0", 0) for i in range(5)] + [(20, None, None, None, None)]
    _, each = op9_secrets.secret_scan(frame(spark, rows))
    got = {(r.verdict, r.n_repos, r.n_owners) for r in each.collect()}
    assert got == {("example", 5, 5), ("live", 5, 1)}
    rows, each = op9_secrets.secret_scan(frame(spark).limit(0))
    assert rows.count() == each.count() == 0


def test_secret_query_stays_in_the_jvm(spark, capsys):
    op9_secrets.op9_secrets(spark, "/root/testdata/sf0.001").explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def test_rows_differ_only_by_order(spark):
    assert rows_of(frame(spark)) == rows_of(frame(spark).repartition(7))
