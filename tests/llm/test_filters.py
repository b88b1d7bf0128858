"""Quality rules, SimHash, decontamination, license scans and language identification against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

pytest.importorskip("pointloom.llm")
from pointloom.llm import components, decontaminate, language_id, license_scan, quality_rules, simhash

BLANK, FOLDED = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def print_of(text):
    w = BLANK.findall(low(text))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_components(prints):
    """prints: list of (doc_id, fingerprint); brute force over all pairs."""
    parent = list(range(len(prints)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 3:
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(prints):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return [(i, f"{p:016x}", least.get(root(k))) for k, (i, p) in enumerate(prints)]


def test_simhash_brute_force(spark, tiny, docs, rows, none):
    table = spark.read.parquet(f"{tiny}/documents.parquet")
    for frame, pairs in ((table, [(r.doc_id, r.text) for r in table.collect()]), (docs, [r[:2] for r in rows])):
        want = Counter(near_components([(i, print_of(t)) for i, t in pairs]))
        for bucket in (20_000, 2):
            assert Counter(tuple(r) for r in simhash.near_duplicates(frame, max_bucket=bucket).collect()) == want
    assert simhash.near_duplicates(none).collect() == []


def test_trie_join_finds_every_component():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    more = [b ^ np.uint64(1 << int(rng.integers(64))) ^ np.uint64(1 << int(rng.integers(64))) for b in base for _ in range(8)]
    prints = np.unique(np.concatenate([base, np.array(more, np.uint64), rng.integers(0, 2**63, 300, dtype=np.uint64)]))
    label = simhash.trie_self_join(prints, np.array([0, len(prints)]), 3)
    want = near_components([(k, int(p)) for k, p in enumerate(prints)])
    assert label.tolist() == [c for _, _, c in want]


def test_simhash_dense_ball(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    ball = {centre ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)} | {rng.getrandbits(64) for _ in range(500)}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in ball]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), max_bucket=300)
    assert edges.count() < 20 * len(ball)  # and not all pairs within the ball, which are over 300,000
    roots = {r.node: r.root for r in components.connected_components(edges).collect()}
    inside = {p - (1 << 64) if p >> 63 else p for p in ball if (p ^ centre).bit_count() == 2}
    assert len({roots[x] for x in inside}) == 1


def test_simhash_clusters_that_share_many_bits(spark):
    """Clusters whose members agree on 32 bits and more need deals of several rounds, each bucket its own."""
    rng = random.Random(9)
    prints = set()
    for free, size in ((24, 300), (32, 300), (8, 120)):
        top = rng.getrandbits(64 - free) << free
        prints |= {top | rng.getrandbits(free) for _ in range(size)}
    prints |= {p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for p in list(prints)[:200]} | {rng.getrandbits(64) for _ in range(300)}
    order = sorted(prints)
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    table = spark.createDataFrame([(signed(p),) for p in order], "fp long")
    want = near_components([(k, p) for k, p in enumerate(order)])
    for bucket in (40, 100_000):
        roots = {r.node: r.root for r in components.connected_components(simhash.links(table, max_bucket=bucket)).collect()}
        groups = defaultdict(set)
        for p in order:
            groups[roots.get(signed(p), signed(p))].add(p)
        by_hand = defaultdict(set)
        for k, _, c in want:
            by_hand[c].add(order[k])
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, by_hand.values()))


def test_representatives_with_many_and_repeated_rows(spark, monkeypatch, docs):
    whole = Counter(map(tuple, simhash.representatives(docs).collect()))
    monkeypatch.setattr(simhash, "SENT", 0)
    assert Counter(map(tuple, simhash.representatives(docs).collect())) == whole
    odd = docs.withColumnRenamed("text", "Text").withColumnRenamed("doc_id", "Doc_ID")
    assert simhash.representatives(odd).columns == odd.columns and simhash.representatives(odd).count() == sum(whole.values())


def test_components_of_chains(spark):
    edges = [(k + 1, k) for k in range(0, 60)] + [(101, 100), (100, 102)] + [(500, k) for k in range(400, 500)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{k: 100 for k in (100, 101, 102)}, **{k: 400 for k in range(400, 501)}}


def test_representatives_keep_all_columns(docs):
    kept = simhash.representatives(docs)
    assert kept.schema == docs.schema
    want = near_components([(r.doc_id, print_of(r.text)) for r in docs.collect()])
    groups = defaultdict(set)
    for i, p, c in want:
        groups[c if c is not None else p].add(i)
    got = Counter(r.doc_id for r in kept.collect())
    assert got == Counter([g if isinstance(g, int) else None for g in groups])


def quality_of(text):
    text = text or ""
    w = BLANK.findall(text)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k + j for k, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if BLANK.search(x)]
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality_counts_and_verdicts(spark, small, documents, docs, rows, none):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    got = quality_rules.quality(documents, labels).collect()
    text = {r.doc_id: r.text for r in documents.collect()}
    assert all(tuple(r)[1:7] == quality_of(text[r.doc_id]) for r in got)
    assert all(not r.kept for r in got if r.base_failed)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    judged = [(r.kept, truth[r.doc_id] == 1) for r in got if r.doc_id in truth and not r.base_failed]
    assert sum(a == b for a, b in judged) / len(judged) > 0.97
    assert sum(k for k, good in judged if good) / sum(good for _, good in judged) > 0.98
    odd = Counter(tuple(r)[:7] for r in quality_rules.quality(docs, labels.limit(0)).collect())
    assert odd == Counter((i, *quality_of(t)) for i, t, *_ in rows)
    assert quality_rules.quality(none, labels).collect() == []
    assert quality_rules.kept(docs, quality_rules.DecisionList()).schema == docs.schema


def shares_of(text):
    """The statistics that rules may use, by hand."""
    import regex

    text = text or ""
    n, chars, symbols, dup, repeated, _ = quality_of(text)
    w = BLANK.findall(text)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    lines = [x for x in text.split("\n") if BLANK.search(x)]
    share = lambda a, b: a / b if b else 0.0
    return {
        "words": float(n), "word_length": share(chars, n), "symbol_share": share(symbols, chars), "mark_share": share(sum(c in "!?|" for c in text), n), "dup_line_share": share(dup, len(lines)),
        "repeat_share": share(repeated, n), "distinct_share": share(len(set(w)), n), "upper_share": share(len(regex.findall(r"\p{Lu}", text)), chars), "digit_share": share(sum(c in "0123456789" for c in text), chars),
        "window_share": share(sum(x for x in grams.values() if x > 1), n),
    }


def test_learned_rules_by_hand_and_on_labels_held_out(spark, small, documents):
    """The verdict of each document from the rules' own thresholds, and rules learned from half of the labels judged on the other half."""
    large = small.replace("sf0.01", "sf0.1")
    labels = spark.read.parquet(f"{large}/labels.parquet")
    table = spark.read.parquet(f"{large}/documents.parquet").select("doc_id", "text")
    rules = quality_rules.learn(table, labels.where("doc_id % 2 = 0"))
    assert rules.rules
    text = {r.doc_id: r.text for r in documents.collect()}
    judged = documents.select("doc_id", quality_rules.statistics(F.col("text")).alias("s")).select("doc_id", quality_rules.verdict(F.col("s"), rules).alias("v")).collect()
    for r in judged:
        s = shares_of(text[r.doc_id])
        met = lambda rule: all((s[c.statistic] > c.threshold) == c.above for c in rule)  # noqa: B023, E731
        first = next((f"rule{k + 1}" for k, rule in enumerate(rules.rules) if met(rule)), "keep")
        assert r.v == ("base" if quality_of(text[r.doc_id])[-1] else first)
    truth = labels.where("doc_id % 2 = 1").select("doc_id", (F.col("quality") == 1).alias("good"))
    verdicts = table.select("doc_id", quality_rules.statistics(F.col("text")).alias("s")).select("doc_id", quality_rules.verdict(F.col("s"), rules).alias("v")).where("v <> 'base'").join(truth, "doc_id").collect()
    assert len(verdicts) > 500
    assert sum((r.v == "keep") == r.good for r in verdicts) / len(verdicts) > 0.98
    assert sum(r.v == "keep" for r in verdicts if r.good) / sum(r.good for r in verdicts) > 0.99


def hits_of(text, items, window=10):
    w = FOLDED.findall(low(text))
    hit, found = set(), set()
    for item, t in items:
        v = FOLDED.findall(low(t))
        size = min(window, len(v))
        for k in range(len(v) - size + 1 if size else 0):
            for a in range(len(w) - size + 1):
                if w[a : a + size] == v[k : k + size]:
                    hit |= set(range(a, a + size))
                    found.add(item)
    names = sorted("" if x is None else str(x) for x in found)
    return len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)


def test_decontamination_brute_force(spark, tiny, docs, rows, none):
    table, bench = spark.read.parquet(f"{tiny}/documents.parquet"), spark.read.parquet(f"{tiny}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    want = Counter((r.doc_id, *hits_of(r.text, items)) for r in table.collect())
    assert any(x[-1] for x in want)
    for size in (16 << 20, 1_500):
        assert Counter(tuple(r) for r in decontaminate.contamination(table, bench, block_bytes=size).collect()) == want
    short = [(1, "two words"), (2, None), (3, ""), (None, "With a few"), (5, "two words"), (6, rows[15][1]), (7, "one")]
    odd = spark.createDataFrame(short, "item_id long, text string")
    want = Counter((i, *hits_of(t, short)) for i, t, *_ in rows if i not in (6, 10))
    for size in (16 << 20, 40):
        assert Counter(tuple(r) for r in decontaminate.contamination(docs.where("doc_id is null or doc_id not in (6, 10)"), odd, block_bytes=size).collect()) == want
    assert decontaminate.contamination(none, odd).collect() == []
    assert not any(r.contaminated for r in decontaminate.contamination(docs, odd.limit(0)).collect())
    by_hand = [(i, *hits_of(t, short)) for i, t, *_ in rows]
    clean = Counter(x[0] for x in by_hand if not x[-1])
    cased = docs.withColumnRenamed("text", "Text").withColumnRenamed("doc_id", "DOC_ID")
    for size in (16 << 20, 1_000):
        left = decontaminate.decontaminate(cased, odd, block_bytes=size)
        assert left.schema == cased.schema and Counter(r.DOC_ID for r in left.collect()) == clean
        cut = decontaminate.decontaminate(docs, odd, mode="spans", block_bytes=size)
        assert cut.schema == docs.schema
        assert Counter((r.doc_id, len(FOLDED.findall(low(r.text)))) for r in cut.collect()) == Counter((x[0], x[1] - x[2]) for x in by_hand)
    assert decontaminate.without_spans("Keep one, two. And three!", [(1, 3)]) == "Keep . And three!"


def base_of(text):
    w, hits, labels = FOLDED.findall(low(text)), [], set()
    for label, phrases in license_scan.BASE.items():
        for p in phrases:
            v = p.split()
            at = [k for k in range(len(w) - len(v) + 1) if w[k : k + len(v)] == v]
            hits += at
            labels |= {label} if at else set()
    return len(w), len(hits), min(hits, default=None), max(hits, default=None), ",".join(sorted(labels))


def test_spans_do_not_depend_on_blocks(spark):
    words = [f"w{k}" for k in range(40)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, None), (3, "clean text")], "doc_id long, text string")
    items = spark.createDataFrame([(str(k), " ".join(words[a : a + 10])) for k, a in enumerate((0, 5, 20, 30))], "item_id string, text string")
    for block_bytes in (1 << 20, 60, 20):
        out = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, items, "spans", block_bytes=block_bytes).collect()}
        assert out == {1: " " + " ".join(words[15:20]) + " ", 2: None, 3: "clean text"}


def test_license_base_and_spans(spark, documents, docs, rows, none):
    got = Counter(tuple(r)[:6] for r in license_scan.license_scan(documents).collect())
    assert got == Counter((r.doc_id, *base_of(r.text)) for r in documents.collect())
    assert Counter(tuple(r)[:6] for r in license_scan.license_scan(docs).collect()) == Counter((i, *base_of(t)) for i, t, *_ in rows)
    notice = "x y Permission is hereby granted, free of any charge, to a person obtaining a copy of this software and associated documentation files z"
    texts = [(1, "a CC BY-NC cc by nc cc by nc under the MIT license."), (2, notice), (3, "cc by nd nc"), (4, "free of charge to any person")]
    out = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert (out[1].n_base, out[1].first_word, out[1].last_word, out[1].base_labels) == (4, 1, 10, "cc-by-nc,mit")
    assert out[2].labels == "mit" and out[2].n_base == 0 and 0.6 <= out[2].score < 1
    assert out[3].labels == out[4].labels == ""
    assert license_scan.license_scan(none).collect() == []


def test_licenses_of_like_wording_are_told_apart(spark):
    gnu = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    cc = "This work is licensed under a Creative Commons {} International License."
    cases = [
        (gnu.format("", "2"), "gpl-2"), (gnu.format("", "3"), "gpl-3"), (gnu.format("Lesser ", "2.1"), "lgpl"), (gnu.format("Affero ", "3"), "agpl-3"), (gnu.format("", "2") + " " + gnu.format("", "3"), "gpl-2,gpl-3"),
        ("under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", "gpl-2"), (gnu.format("", "2").replace("either version 2 of the License", "version 2 only"), "gpl-2"),
        (cc.format("Attribution 4.0"), "cc-by"), (cc.format("Attribution-ShareAlike 4.0"), "cc-by-sa"), (cc.format("Attribution-NonCommercial 4.0"), "cc-by-nc"), (cc.format("Attribution-NonCommercial-ShareAlike 4.0"), "cc-by-nc-sa"),
        (cc.format("Attribution-NoDerivatives 4.0"), "cc-by-nd"), (cc.format("Attribution-NonCommercial-NoDerivatives 4.0"), "cc-by-nc-nd"), (cc.format("Attribution-ShareAlike 4.0") + " For non commercial use see below.", "cc-by-sa"),
        ("Licensed under the GNU General Public License, version 3", "gpl-3"), ("Licensed under the GNU General Public License, version 2", ""),
    ]
    texts = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)] + [(None, cases[0][0])] * 2, "doc_id long, text string")
    out = license_scan.license_scan(texts).collect()
    assert {r.doc_id: r.labels for r in out} == {**{k: x for k, (_, x) in enumerate(cases)}, None: "gpl-2"} and len(out) == len(cases) + 2


def test_short_names_and_identifiers_count_where_they_stand_whole(spark):
    cases = [
        ("CC BY-SA 4.0", "cc-by-sa"), ("text: CC BY 4.0.", "cc-by"), ("CC BY-NC-SA 4.0", "cc-by-nc,cc-by-nc-sa"), ("(cc-by-nc-nd)", "cc-by-nc,cc-by-nc-nd"), ("CC BY", ""), ("CC BY-ND-NC 1.0", ""), ("CC0 1.0 Universal", "cc0"),
        ("GNU GPL v2", "gpl-2"), ("the GNU GPL, version 3", "gpl-3"), ("GNU GPL v1", ""), ("GNU AGPL v3", "agpl-3"), ("GNU LGPL v2.1", "lgpl"), ("SPDX-License-Identifier: LGPL-2.1-only", "lgpl"),
        ("// SPDX-License-Identifier: Apache-2.0\n", "apache-2"), ("SPDX-License-Identifier: Apache-1.1", ""), ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2"), ("SPDX-License-Identifier: MIT", "mit"),
        ("SPDX-License-Identifier: BSD-3-Clause", "bsd"), ("SPDX-License-Identifier: MPL-2.0", "mpl-2"), ("spdx license or identifier mit", ""), ("Apache License 2.0", "apache-2"),
    ]
    texts = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in license_scan.license_scan(texts).collect()} == {k: x for k, (_, x) in enumerate(cases)}


def test_licenses_in_a_very_long_text(spark):
    filler = "word non commercial no derivatives attribution version 2 gnu general " * 40_000
    text = filler + "under the MIT license " + filler + license_scan.NOTICES["gpl-3"][1] + " " + filler + "cc by nc"
    out = license_scan.license_scan(spark.createDataFrame([(1, text), (2, filler), (1, text)], "doc_id long, text string")).collect()
    by_hand = base_of(text)
    assert sorted(tuple(r)[:6] for r in out) == sorted([(1, *by_hand), (1, *by_hand), (2, *base_of(filler))])
    assert {(r.doc_id, r.labels) for r in out} == {(1, "cc-by-nc,gpl-3,mit"), (2, "")}


def test_language_accuracy_and_edges(documents, docs, none):
    truth = {r.doc_id: r.lang for r in documents.collect()}
    got = language_id.identify(documents).collect()
    held = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out]
    assert len(got) == len(truth) and sum(held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    odd = {(r.doc_id, r.lang_pred == "und") for r in language_id.identify(docs).collect()}
    assert {(1, True), (2, True), (3, True), (16, True), (4, False), (10, False)} <= odd
    assert language_id.identify(none).collect() == []


def test_forward_sums_all_segmentations():
    model, table, byte, *_ = language_id._pieces(language_id.default_path("piece_bpe_32k.model"))
    p = np.random.default_rng(2).random((model.get_piece_size(), 2)) * 0.01
    m = language_id.Model(["a", "b"], p, None)

    def total(word):
        if not word:
            return np.ones(2)
        out = np.zeros(2)
        for k in range(1, len(word) + 1):
            if word[:k] in table:
                out += p[table[word[:k]]] * total(word[k:])
            elif k == 1:
                out += np.prod([p[byte[b]] for b in word[0].encode()], axis=0) * total(word[1:])
        return out

    words = ["the", "nation", "éa", "ꙮx", "q"]
    for w, got in zip(words, m.score_words(words), strict=True):
        assert np.allclose(np.exp(got), total("▁" + w))
    assert np.isfinite(m.score_words(["ab" * 200])).all()

    def exact(word):
        """Logarithms of the sum, place by place, with all places held."""
        line, longest = "▁" + word, max(map(len, table))
        ahead = [np.zeros(2)]
        for end in range(1, len(line) + 1):
            ways = [ahead[k] + np.log(p[table[line[k:end]]]) for k in range(max(0, end - longest), end) if line[k:end] in table]
            if line[end - 1] not in table:
                ways.append(ahead[end - 1] + sum(np.log(p[byte[b]]) for b in line[end - 1].encode()))
            ahead.append(np.logaddexp.reduce(ways, axis=0))
        return ahead[-1]

    rng = np.random.default_rng(3)
    long = ["".join(chr(c) for c in rng.integers(97, 123, n)) for n in (511, 512, 600, 5_000)] + ["ꙮé" * 700]
    for w, got in zip(long, m.score_words(long), strict=True):
        assert np.allclose(got, exact(w), rtol=1e-12)


def test_language_end_to_end_by_hand(spark, tiny):
    """Counts, smoothing, scores and posteriors of all rows against a plain computation, also with languages in blocks."""
    import re
    import zlib

    table = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text", "lang").limit(80)
    more = spark.createDataFrame([(9_001, "qualité " + "längewort" * 90, "xx"), (None, "ein Wort", "yy"), (9_002, "12", "en"), (9_003, None, "en")], "doc_id long, text string, lang string")
    rows = [tuple(r) for r in table.unionByName(more).collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model, vocabulary, byte, *_ = language_id._pieces(language_id.default_path("piece_bpe_32k.model"))
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 4 == 2
    cut = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    counts = defaultdict(lambda: np.full(model.get_piece_size(), language_id.SMOOTHING))
    for i, t, lang in rows:
        if not held(i) and lang is not None and t is not None:
            for w in cut(t):
                for k in model.encode(w):
                    counts[lang][k] += 1
    languages = sorted(x for x in counts if counts[x].sum() > model.get_piece_size() * language_id.SMOOTHING + 0.5)
    whole = language_id.Model(languages, np.stack([counts[x] / counts[x].sum() for x in languages], axis=1), None)
    want = {}
    for i, t, _ in rows:
        total = whole.score_words(cut(t)).sum(axis=0) if cut(t) else None
        want[i] = ("und", 0.0) if total is None else (languages[int(total.argmax())], float(1 / np.exp(total - total.max()).sum()))
    for block in (256, 2):
        got = {r.doc_id: r for r in language_id.identify(docs, block=block).collect()}
        assert {i: (r.lang_pred, round(r.score, 9)) for i, r in got.items()} == {i: (a, round(b, 9)) for i, (a, b) in want.items()}
        assert all(r.held_out == held(i) for i, r in got.items())
