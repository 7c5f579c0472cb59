"""Quality rules, Merkle manifest, conversation trie: brute force, odd rows, hot groups."""

import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from flowwatch.llm import merkle, prefix_trie, quality

WS = " \t\n\x0b\x0c\r"


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# ---- quality rules

def words_of(t):
    for c in WS[1:]:
        t = t.replace(c, " ")
    return [w for w in t.split(" ") if w]


def counts_brute(t):
    t = t or ""
    w = words_of(t)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    inside = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if words_of(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside), len(lines))


def bucket_brute(v):
    step = 1 << max(0, v.bit_length() - quality.DIGITS)
    return v // step * step


def quality_brute(rows):
    """rows: (doc_id, text, lang, source); the thresholds from sorted values."""
    full = [(d, s, l, counts_brute(t)) for d, t, l, s in rows]
    failed = [c[0] < 50 or 100 * c[4] > 50 * c[0] for *_, c in full]

    def values(c):
        n, chars, sym, dup, rep, lines = c
        return {"word_length": 1000 * chars // max(n, 1), "symbols": 1000 * sym // max(n, 1), "dup_lines": 1000 * dup // max(lines, 1),
                "repeats": 1000 * rep // max(n, 1)}

    groups = defaultdict(list)
    for (d, s, l, c), bad in zip(full, failed):
        if not bad:
            for m, v in values(c).items():
                for g in ((m, l, s), (m, l), (m,)):
                    groups[g].append(bucket_brute(v))

    def fence(g):
        x = sorted(groups[g])
        q25, q50 = x[-(-len(x) // 4) - 1], x[-(-len(x) // 2) - 1]
        away = max(quality.REACH * (q50 - q25), quality.MEASURES[g[0]][0])
        return len(x), float(q50 - away), float(q50 + away)

    def limits(m, l, s):
        (n0, *a), (n1, *b), (_, *c) = fence((m, l, s)), fence((m, l)), fence((m,))
        p = quality.PRIOR
        return [(n0 * x + p * ((n1 * y + p * z) / (n1 + p))) / (n0 + p) for x, y, z in zip(a, b, c)]

    out = []
    for (d, s, l, c), bad in zip(full, failed):
        beyond = []
        for m, v in values(c).items():
            if (m, l, s) in groups:
                low, high = limits(m, l, s)
                if v > high or (quality.MEASURES[m][1] and v < low):
                    beyond.append(m)
        out.append((d, *c[:5], bad, not bad and not beyond, ",".join(beyond)))
    return out


def made_texts(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(r.choices("abcdefgh", k=r.randint(2, 8))) for _ in range(r.randint(20, 300))]
        kind = i % 11
        if kind == 3:
            words = [w + "$$$" for w in words]
        elif kind == 5:
            words = [w * 3 for w in words]
        elif kind == 7:
            words = words[:5] * 30
        text = " ".join(w + ("\n" if k % 9 == 8 else "") for k, w in enumerate(words))
        if kind == 9:
            text = text + "\n" + "\n".join(["the same line again"] * 12)
        rows.append((i, text, r.choice(["en", "fr", None]), r.choice(["a", "a", "a", "b", None])))
    return rows


def test_quality_against_brute_force(spark):
    rows = made_texts(400, 1)
    got = rows_of(quality.quality_report(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")))
    assert sorted(got) == sorted(quality_brute(rows))
    kept = {d: k for d, *_, k, _ in got}
    junk = [d for d, t, *_ in rows if d % 11 in (3, 5, 7) and len(words_of(t)) >= 50]
    clean = [d for d, t, *_ in rows if d % 11 in (0, 1, 2, 4, 6, 8, 10) and len(words_of(t)) >= 50]
    assert not any(kept[d] for d in junk) and all(kept[d] for d in clean)


def test_quality_sketches_merge_and_bound_their_error(spark):
    r = random.Random(5)
    values = [int(r.lognormvariate(6, 2)) for _ in range(4000)]
    d = spark.createDataFrame([("m", v, i % 3) for i, v in enumerate(values)], "measure string, value long, part long")
    whole = sorted(rows_of(quality.sketches(d, [])))
    assert whole == sorted(rows_of(quality.merged(quality.sketches(d, ["part"]), [])))
    assert all(v - b <= v / 64 for v in values for b in [bucket_brute(v)]) and {x[1] for x in whole} == {bucket_brute(v) for v in values}


def test_quality_odd_rows(spark, odd_docs, odd_rows, empty_docs):
    plain = [(r[0], r[1], r[2], r[3]) for r in odd_rows]
    # the fixture's columns are doc_id, text, lang, source
    got = Counter(rows_of(quality.quality_report(odd_docs)))
    assert got == Counter(quality_brute(plain))
    kept = quality.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == sum(n for x, n in got.items() if x[7])
    assert quality.quality_report(empty_docs).count() == 0 and quality.keep_good(empty_docs).count() == 0


def test_quality_thresholds_adapt(spark):
    """A source whose words are all long keeps them; the same words are junk elsewhere."""
    r = random.Random(3)

    def text(k):
        return " ".join("".join(r.choices("abcdefgh", k=k + r.randint(-1, 1))) for _ in range(200))

    rows = [(i, text(12), "en", "long") for i in range(400)] + [(1000 + i, text(5), "en", "short") for i in range(400)] + [(2000, text(12), "en", "short")]
    got = {d: k for d, *_, k, _ in rows_of(quality.quality_report(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")))}
    assert not got.pop(2000) and all(got.values())


# ---- Merkle manifest

def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def merkle_brute(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""
    def leaf(d, t, l, s, n):
        return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, s, l, n, t)])

    def lower(t):
        return None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)

    groups = defaultdict(list)
    for d, t, l, s, n in rows:
        hit = d is not None and zlib.crc32(str(d).encode()) % 3 == 0
        groups[l].append(((d is not None, d or 0), leaf(d, t, l, s, n), leaf(d, lower(t), l, s, n) if hit else leaf(d, t, l, s, n), d))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([H(*levels[-1][i:i + 8]) for i in range(0, len(levels[-1]), 8)])
        return levels

    def path(levels, i):
        out = []
        for level in levels[:-1]:
            a = i - i % 8
            out.append(("".join(level[a:i]), "".join(level[i + 1:a + 8])))
            i //= 8
        return out

    langs = sorted(groups, key=lambda l: (l is not None, (l or "").encode()))
    trees = {l: tree([x[1] for x in sorted(groups[l], key=lambda x: x[:2])]) for l in langs}
    if not langs:
        return []
    top = tree([trees[l][-1][0] for l in langs])
    root, out = top[-1][0], []
    for k, l in enumerate(langs):
        for i, (_, own, changed, d) in enumerate(sorted(groups[l], key=lambda x: x[:2])):
            p = path(trees[l], i) + path(top, k)
            node = changed
            for a, b in p:
                node = H(a, node, b)
            out.append((d, own, trees[l][-1][0], root, H(*[x for y in p for x in y]), node, node == root))
    return out


@pytest.mark.parametrize("sizes", [[1], [1, 1], [8, 9], [64, 65, 3], [512, 513, 1], [1100]])
def test_merkle_shapes(spark, sizes):
    rows = [(k * 7919 + 31 * i - 500, f"Text {i}", f"l{k}" if k else None, "s", i) for k, n in enumerate(sizes) for i in range(n)]
    got = rows_of(merkle.manifest_report(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")))
    assert sorted(got) == sorted(merkle_brute(rows))
    assert {v for *_, v in got} <= {True, False} and all(v == (zlib.crc32(str(d).encode()) % 3 != 0) for d, *_, v in got)


def test_merkle_many_languages(spark):
    rows = [(i, "A", f"l{i % 600}é", "s", 1) for i in range(700)]
    got = rows_of(merkle.manifest_report(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")))
    assert sorted(got) == sorted(merkle_brute(rows))


def test_merkle_odd_rows(odd_docs, odd_rows, empty_docs):
    got = rows_of(merkle.manifest_report(odd_docs))
    assert Counter(got) == Counter(merkle_brute([r[:5] for r in odd_rows]))
    assert merkle.manifest_report(empty_docs).count() == 0


def test_merkle_sparse_and_repeated_ids(spark):
    r = random.Random(2)
    ids = [r.randint(-(1 << 63), (1 << 63) - 1) for _ in range(150)] + [-(1 << 63), (1 << 63) - 1, 0, -1, 63, 64, 65]
    rows = [(i, f"T{i}", "en", "s", 1) for i in ids]
    rows += [(5, f"t{k % 40}", "en", "s", 1) for k in range(700)] + [(None, f"N{k}", "en", None, None) for k in range(30)] + [(64, "x", "en", "s", 1)] * 20
    got = rows_of(merkle.manifest_report(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")))
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(got, key=key) == sorted(merkle_brute(rows), key=key)


def test_merkle_ranks_need_no_sort(spark):
    rows = [(i * 3, "x", "en", "s", 1) for i in range(5000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    leaves = d.select(F.lit("=en").alias("grp"), "doc_id", F.sha2("text", 256).alias("leaf"), F.lit("").alias("changed"), F.lit(1).cast("long").alias("n"))
    slots = merkle.placed(leaves)
    assert slots.filter("slot * 3 <> doc_id or total <> 5000").count() == 0 and slots.count() == 5000


# ---- conversation trie

def trie_brute(rows):
    """rows: (conv_id, turn, role, text)."""
    convs = defaultdict(list)
    for c, n, role, text in rows:
        if c is not None:
            a, b = role or "", text or ""
            convs[c].append(((n is not None, n or 0), H(f"{len(a.encode())}:{a}{b}")[:32], a, b))
    own = {c: [(a, b) for _, _, a, b in sorted(t)] for c, t in convs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        seq = tuple(own.get(base, [])[:h] + own[c][h:])
        ends[seq].append(c)
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        w = len(words_of(k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * w
    return [(m[0], len(k), members[k[:-1]][0] if k else None, len(m), kids[k], leaves[k], saved[k],
             sha256(",".join(map(str, ends[k])).encode()).hexdigest()) for k, m in members.items()]


SCHEMA = "conv_id long, turn long, role string, text string"


def made_turns(n, seed, most=6, words="ab"):
    r = random.Random(seed)
    return [(c, t, r.choice(["u", "a"]), " ".join(r.choices(words, k=r.randint(0, 2)))) for c in range(n) for t in range(r.randint(1, most))]


def check_trie(spark, rows, **size):
    d = spark.createDataFrame(rows, SCHEMA)
    convs = prefix_trie.rebuilt(prefix_trie.conversations_of(d))
    key = lambda x: tuple((v is None, v) if v is not None else (True, 0) for v in x)
    got = sorted(rows_of(prefix_trie.trie(convs, **size)), key=key)
    assert got == sorted(trie_brute(rows), key=key)
    return got


@pytest.mark.parametrize("size", [20_000, 7, 1])
def test_trie_against_brute_force(spark, size):
    check_trie(spark, made_turns(500, size), run_rows_most=size)


def test_trie_hot_conversation_and_hot_first_turn(spark):
    same = [(c, t, "u", f"turn {t}") for c in range(0, 4000, 3) for t in range(3)]
    alike = [(c, t, "u", "turn 0" if not t else f"own {c} {t}") for c in range(1, 4000, 3) for t in range(3)]
    check_trie(spark, same + alike + made_turns(300, 4), run_rows_most=50)


def test_trie_odd_rows(spark):
    rows = [(None, 1, "u", "x"), (7, None, None, None), (7, 2, "u", "a  b"), (7, 2, "u", "a  b"), (7, 1, "", ""), (-7, 0, "u", "neg"), (-40, 0, "u", "neg"),
            (20, 3, "u", "é漢 \U0001f600"), (21, 0, "u", "short"), (40, 0, "u", "word " * 20_000), (41, 5, "u", "q")]
    rows += [(60, t, "u", f"long {t}") for t in range(700)] + [(61, t, "u", f"long {t}") for t in range(650)]
    check_trie(spark, rows)
    check_trie(spark, rows, run_rows_most=1)
    d = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit("k")).withColumn("words", F.lit(1)).withColumn("depth", F.lit("d"))
    assert prefix_trie.trie_report(d).count() == len(trie_brute(rows))
    assert prefix_trie.trie_report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_trie_without_any_turn_left(spark):
    """A conversation shorter than its head whose base is absent has no turns: a member of the root only."""
    c = next(c for c in range(1001, 1020) if zlib.crc32(str(c).encode()) % 4 == 3)
    got = check_trie(spark, [(c, 0, "u", "one"), (c, 1, "u", "two")])
    assert got == [(c, 0, None, 1, 0, 1, 0, sha256(str(c).encode()).hexdigest())]


def test_radix_tree_layouts():
    r = random.Random(9)
    for n in (3, 10, 40, 200):
        tree, keys = prefix_trie.RadixTree(), sorted({bytes([r.randrange(n)]) + bytes(r.choices(range(256), k=31)) for _ in range(n * 4)})
        for i, k in enumerate(keys):
            tree.insert(k, i, [1, 1])
        firsts = len({k[0] for k in keys})
        kinds = [prefix_trie.Node4, prefix_trie.Node16, prefix_trie.Node48, prefix_trie.Node256]
        assert type(tree.root.kids) is next(k for k, size in zip(kinds, (4, 16, 48, 256)) if firsts <= size)
        assert [b for b, _ in tree.root.kids.items()] == sorted({k[0] for k in keys})
        assert sum(1 for x in tree.turns() if x[1] == 2) == len(keys)
