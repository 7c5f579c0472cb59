"""Line de-duplication, mixing, sharding, SimHash, licenses: brute force and odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from flowwatch.llm import licenses, linededup, mixing, sharding, simhash
from flowwatch.llm.common import connected_components

WS = " \t\n\x0b\x0c\r"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# ---- line de-duplication

def line_brute(rows):
    found = defaultdict(set)
    for d, t in rows:
        if d is not None:
            for x in (t or "").split("\n"):
                k = x.strip(WS).translate(FOLD)
                if len(k) >= 40:
                    found[k].add(d)
    stays = {k: max(s) for k, s in found.items() if len(s) >= 5}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or stays.get(x.strip(WS).translate(FOLD), d) == d]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def test_lines_odd_rows(odd_docs, odd_rows):
    got = Counter(rows_of(linededup.line_report(odd_docs)))
    assert got == Counter(line_brute([r[:2] for r in odd_rows]))
    kept = linededup.dedup_lines(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == len(odd_rows)
    texts = {r.doc_id: r for r in kept.collect()}
    assert texts[20].text == "own words 0 of this text" and texts[20].n_chars == len(texts[20].text)
    assert texts[25].text.count("\n") == 2 and texts[1].text is None


def test_lines_many_words_of_a_bitmap(spark):
    line = "a boilerplate line of more than forty code points, it is"
    rows = [(i, "\n".join(line if j % (i + 2) == 0 else f"{i} {j}" for j in range(300))) for i in range(7)]
    got = rows_of(linededup.line_report(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sorted(got) == sorted(line_brute(rows))


def test_lines_empty(empty_docs):
    assert linededup.line_report(empty_docs).count() == 0 and linededup.dedup_lines(empty_docs).count() == 0


# ---- mixing

def mix_brute(rows):
    """Targets by plain water-filling."""
    size = Counter()
    for s, n in rows:
        size[s] += n
    names = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in size)
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, full = sum(size.values()), set()
    while True:
        left = total - sum(3 * size[s] for s in full)
        w = sum(weight[s] for s in names if s not in full)
        target = {s: 3.0 * size[s] if s in full else left * weight[s] / w for s in names}
        over = {s for s in names if s not in full and target[s] > 3 * size[s]}
        if not over:
            return size, target
        full |= over


@pytest.mark.parametrize("seed", range(4))
def test_mix_targets_and_words(spark, seed):
    r = random.Random(seed)
    rows = []
    for i in range(900):
        s = None if r.random() < 0.05 else f"s{min(int(r.expovariate(0.5)), 9)}"
        rows.append((i, " ".join(["w"] * (r.randint(0, 30) if r.random() < 0.5 else r.randint(40, 400))), s))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed(docs).collect()
    size, target = mix_brute([(s, len(t.split())) for _, t, s in rows])
    taken = Counter()
    for g in got:
        assert g.source_size == size[g.source] and g.target == pytest.approx(target[g.source])
        assert 0 <= g.copies <= 3 and g.taken == g.copies * g.size
        taken[g.source] += g.taken
    for s in size:
        # off by at most half of the largest document
        assert abs(taken[s] - target[s]) <= 200, s
    assert sum(abs(taken[s] - target[s]) for s in size) <= 0.01 * sum(size.values())
    assert sorted(map(tuple, mixing.mixed(docs.repartition(5)).collect())) == sorted(map(tuple, got))
    copies = Counter(x.doc_id for x in mixing.mix_documents(docs).select("doc_id").collect())
    assert copies == Counter({g.doc_id: g.copies for g in got if g.copies})


def test_mix_is_a_pareto_sample(spark):
    """Among equally wanted documents of a source, those with the smallest random odds are taken."""
    docs = spark.createDataFrame([(i, "w " * 60, "a" if i < 300 else "b") for i in range(600)], "doc_id long, text string, source string")
    got = {r.doc_id: r.copies for r in mixing.mixed(docs).collect()}
    u = {r.doc_id: r.u for r in docs.select("doc_id", mixing._random(F.col("doc_id")).alias("u")).collect()}
    for ids in (range(300), range(300, 600)):
        more = max(got[i] for i in ids)
        upper, lower = [u[i] for i in ids if got[i] == more], [u[i] for i in ids if got[i] < more]
        # all but the last place are in order of the random odds
        assert lower and sorted(upper)[-2] < min(lower)


def test_mix_odd_rows(odd_docs, odd_rows, empty_docs):
    got = mixing.mixed(odd_docs)
    assert got.count() == len(odd_rows)
    assert {r.size for r in got.filter("doc_id in (1, 2, 3)").collect()} == {0}
    assert mixing.mix_documents(odd_docs).columns == odd_docs.columns
    assert mixing.mixed(empty_docs).count() == 0 and mixing.mix_documents(empty_docs).count() == 0


# ---- sharding

def test_differencing_beats_greedy_and_places_all():
    r = random.Random(4)
    w = [r.randint(1, 10_000) for _ in range(500)]
    at = sharding.differencing([[0] * 15 + [x] for x in w])
    sums = Counter()
    for x, a in zip(w, at):
        assert sorted(a) == list(range(16))
        sums[a[-1]] += x
    assert max(sums.values()) - min(sums.values()) <= 16


@pytest.mark.parametrize("block", [8, 64, 8192])
def test_shards(spark, odd_docs, odd_rows, block):
    got = sharding.shard_documents(odd_docs, block=block).collect()
    assert len(got) == len(odd_rows)
    by_text, slots = defaultdict(set), defaultdict(list)
    size = {(r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in odd_rows}
    for g in got:
        assert (g.doc_id, g.size, g.text_crc32) in size and g.law == "bytes" and g.grown_shard is None
        by_text[g.text_crc32].add(g.shard)
        slots[g.shard].append(g.slot)
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_are_even(spark):
    r = random.Random(5)
    docs = spark.createDataFrame([(i, "z" * int(r.paretovariate(1.2) * 20)) for i in range(3000)], "doc_id long, text string")
    for block in (100, 8192):
        sums = [x[0] for x in sharding.shard_documents(docs, block=block).groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
        assert len(sums) == 16
        heaviest = max(x[0] for x in docs.groupBy("text").agg(F.sum(F.length("text") + 1)).select("sum((length(text) + 1))").collect())
        assert max(sums) - min(sums) <= max(64, heaviest if heaviest > sum(sums) / 16 else 64)


def test_shards_empty(empty_docs):
    assert sharding.shard_documents(empty_docs).count() == 0


# ---- SimHash

def simhash_brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    count = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            count[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * count[b] > len(grams))


def components_brute(rows):
    rows = [(d, f) for d, f in rows if d is not None]
    root = {f: f for _, f in rows}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f
    fps = sorted(root)
    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for d, f in rows:
        least[find(f)] = min(least.get(find(f), d), d)
    return {(d, f): least[find(f)] for d, f in rows}


def test_simhash_odd_rows(odd_docs, odd_rows, empty_docs):
    got = simhash.near_duplicate_report(odd_docs).collect()
    want = [(r[0], simhash_brute(r[1])) for r in odd_rows]
    assert Counter((g.doc_id, int(g.fingerprint, 16)) for g in got) == Counter(want)
    comp = components_brute(want)
    for g in got:
        assert g.component_id == comp.get((g.doc_id, int(g.fingerprint, 16)))
    kept = simhash.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert Counter(i for i in ids if i is not None) == Counter(set(comp.values())) and ids.count(None) == 2
    assert simhash.near_duplicate_report(empty_docs).count() == 0


def test_simhash_stage_loses_no_text_of_a_repeated_id(spark):
    a, b, c = (" ".join(random.Random(k).choices("abcdefghijklmnop", k=80)) for k in (1, 2, 3))
    schema = "doc_id long, text string, component string"

    def kept(*rows):
        return sorted(tuple(r)[:2] for r in simhash.drop_near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], schema)).collect())

    assert kept((5, a), (5, b), (3, b)) == sorted([(5, a), (3, b)])
    assert kept((5, a), (5, b), (5, c)) == sorted([(5, a), (5, b), (5, c)])
    assert kept((5, a), (5, a), (5, b), (7, a), (7, b)) == sorted([(5, a), (5, b)])
    assert kept((5, a), (5, a + " "), (5, a.upper()), (6, c)) in ([(5, x), (6, c)] for x in (a, a + " ", a.upper()))
    assert kept((2, None), (2, ""), (2, a), (1, "  ")) == sorted([(1, "  "), (2, a)])


def test_simhash_anchor_with_many_rows_away(spark):
    """One half of very many fingerprints is at one anchor's distance two: they reach the anchor, but are not at home."""
    r = random.Random(6)
    half = 0b11                      # two bits from the code word 0, at home at another anchor
    away = {half | r.getrandbits(31) << 31 for _ in range(50_000)}
    home = {r.getrandbits(31) << 31 for _ in range(20)}
    pairs = {(f & ~half | 0b1) for f in list(away)[:15]}          # at home at 0, one bit from one away
    fps = sorted(away | home | pairs)
    d = spark.createDataFrame([(f, k) for k, f in enumerate(fps)], "fp long, node long")
    got = simhash.fingerprint_links(d, block=2000)
    links = {tuple(sorted(x)) for x in rows_of(got)}
    a = np.array(fps, dtype=np.uint64)
    comp = {k: k for k in range(len(fps))}

    def root(k):
        while comp[k] != k:
            comp[k] = comp[comp[k]]
            k = comp[k]
        return k

    for u, v in links:
        comp[root(u)] = root(v)
    for k in range(0, len(fps), 97):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[k]) <= 3).tolist():
            assert root(j) == root(k)
    for f in pairs:
        k = fps.index(f)
        assert all(root(j) == root(k) for j in np.flatnonzero(np.bitwise_count(a ^ a[k]) <= 3).tolist())
    rep = simhash.anchors(d)
    assert rep.filter("anchor = 0 and not home").count() >= 50_000 > rep.filter("anchor = 0 and home").count()


def clusters(seed, n=1500):
    r = random.Random(seed)
    fps = set()
    while len(fps) < n:
        f = r.getrandbits(64)
        for _ in range(r.choice([1, 2, 40])):
            fps.add(f)
            for _ in range(r.randint(1, 5)):
                f ^= 1 << r.randrange(64)
    return sorted(fps)


@pytest.mark.parametrize("block", [4096, 3])
def test_anchor_links_find_all(spark, block):
    fps = clusters(block)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, node long")
    got = {r.node: r.component for r in connected_components(simhash.fingerprint_links(df, 3, block)).collect()}
    want = components_brute(list(enumerate(fps)))
    assert all(got.get(i, i) == want[(i, f)] for i, f in enumerate(fps))


def test_anchors_cover(spark):
    """Pairs within one bit of a half meet at the one's nearest anchor."""
    r = random.Random(1)
    x = [r.getrandbits(62) for _ in range(50)]
    pairs = [(a, a ^ (1 << r.randrange(62))) for a in x]
    df = spark.createDataFrame([(f,) for p in pairs for f in p], "fp long")
    home, every = defaultdict(set), defaultdict(set)
    for row in simhash.anchors(df).collect():
        every[row.fp].add(row.anchor)
        if row.home:
            home[row.fp].add(row.anchor)
    for a, b in pairs:
        assert len(home[a]) == 2 and all(h in every[b] for h in home[a])


def test_components(spark):
    r = random.Random(2)
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    noise = [(r.randrange(5000, 6000), r.randrange(5000, 6000)) for _ in range(600)]
    edges = chain + star + noise + [(7, 7), (None, 3)]
    r.shuffle(edges)
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a
    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {n: find(n) for n in list(root)}


# ---- licenses

def test_template_language():
    """The automaton accepts what the template's regular expression accepts."""
    r = random.Random(3)
    ts = [licenses.Template(k, v) for k, v in licenses.TEMPLATES.items()]
    words = sorted({w.decode() for t in ts for m in t.moves for s, _ in m if s for w in s}) + ["foo", "bar"]

    def walk(t):
        out, s, last = [], 0, len(t.moves) - 1
        while s != last:
            options = [m for f in t.free[s] for m in t.moves[f]]
            if last in t.free[s] and (not options or r.random() < 0.5):
                break
            w, s = r.choice(options)
            out.append(r.choice(words) if w is None else r.choice(sorted(w)).decode())
        return out
    seen = Counter()
    for _ in range(4000):
        w = walk(r.choice(ts))
        if r.random() < 0.5:
            w[r.randrange(len(w))] = r.choice(words)
        text = " ".join(r.choices(words, k=2) + w + r.choices(words, k=2))
        there = licenses.words_of(text.encode())
        for t in ts:
            a = t.found(there, set(there)) is not None
            assert a == bool(re.search(t.pattern() + "(?: |$)", " " + text)), (t.label, text)
            seen[a] += 1
    assert min(seen[True], seen[False]) > 500


def fill(markup):
    """A text of the template: optional regions stay, replaceable ones get a word."""
    return re.sub("<<(?:begin|end)Optional>>", "", re.sub(r"<<var;name=\w+;match=(?:\.\{\d+,\d+\}|(\w+)[^>]*)>>", lambda m: m[1] or "Someone", markup))


def test_license_texts_are_whole():
    ts = [licenses.Template(k, v) for k, v in licenses.TEMPLATES.items()]

    def texts(text):
        return [x for x in licenses.scan(text.encode(), ts, {})[5].split(",") if x.endswith("-text")]

    whole = {k: fill(v) for k, v in licenses.TEMPLATES.items() if k.endswith("-text")}
    assert {"mit-text", "mit-0-text", "json-text", "bsd-2-clause-text", "bsd-3-clause-text", "bsd-4-clause-text", "isc-text", "0bsd-text",
            "unlicense-text", "apache-2.0-text", "mpl-2.0-text", "gpl-2.0-text", "gpl-3.0-text", "lgpl-2.1-text", "lgpl-3.0-text"} <= set(whole)
    for label, text in whole.items():
        words = text.split()
        assert texts(f"Copyright (c) 2020 Someone. All rights reserved.\n\n{text}\n\nother text") == [label]
        assert texts(" ".join(words[:-1])) == []                                # a prefix is not the license
        for n in range(1, 8):                                                   # nor are altered terms, wherever they are
            at = len(words) * n // 8
            assert texts(" ".join([*words[:at], *["only as agreed"] * 10, *words[at:]])) == []


def test_license_versions_and_notices():
    ts = [licenses.Template(k, v) for k, v in licenses.TEMPLATES.items()]
    for text, labels in {
            "Licensed under the Apache License, Version 1.1": "apache", "licensed under the Apache License": "apache",
            "Licensed under the Apache License 2.0": "apache,apache-2.0-notice",
            "distributed under the GNU Lesser General Public License": "gpl,lgpl-notice",
            "licensed under the GNU Affero General Public License": "agpl-notice,gpl", "available under the ISC license": "isc-notice",
            "released under the Mozilla Public License, v. 2.0": "mpl-2.0-notice",
            "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
            "published by the Free Software Foundation": "gpl,gpl-header-notice"}.items():
        assert licenses.scan(text.encode(), ts, licenses.PHRASES)[5] == labels


def test_license_rows(spark, odd_docs, odd_rows, empty_docs):
    docs = spark.createDataFrame([
        (1, "Released under the MIT License."), (2, "the MIT\n\tLicense, MIT-license"), (3, None), (4, ""),
        (5, "Licensed under the Apache License, Version 2.0."), (6, "permitted, the mit licenses"),
        (7, "This work is licensed under the GNU General Public License, version 3."), (8, "Licensed under CC BY-NC 4.0."),
        (None, "under the é MIT License")], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_documents(docs).collect()}
    assert got[1].labels == "mit,mit-notice" and got[1].base_labels == "mit" and got[1].score == 1.0 and got[1].first_word == 3
    assert (got[2].n_base, got[2].first_word, got[2].last_word, got[2].labels, got[2].score) == (2, 1, 3, "mit", 0.5)
    assert (got[3].n_words, got[3].labels, got[3].first_word, got[3].score) == (0, "", None, 0.0) and got[4].n_words == 0
    assert got[5].labels == "apache,apache-2.0-notice" and got[6].labels == "" and got[7].labels == "gpl,gpl-notice"
    assert got[8].labels == "cc-notice" and got[8].base_labels == "" and got[None].n_words == 5
    assert licenses.license_report(odd_docs).count() == len(odd_rows) and licenses.license_report(empty_docs).count() == 0


def test_fingerprint_matches_brute():
    r = random.Random(6)
    for n in (0, 1, 2, 3, 4, 500):
        t = " ".join("".join(r.choices("abABé.", k=4)) for _ in range(n))
        assert simhash.fingerprint(t.encode()) % (1 << 64) == simhash_brute(t)
    assert simhash.fingerprint(None) == 0
    assert np.int64(simhash.fingerprint(b"x")) is not None
