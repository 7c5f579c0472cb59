"""Vector searches, token files, SentencePiece ids: brute force, round trips, odd rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowwatch.llm import ann_forest, cover_tree, sentencepieces, token_store
from flowwatch.llm.common import vocabulary

NAN, INF = float("nan"), float("inf")


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int, rank string, b int, q int, v string, dim int")


def odd_vectors(seed, n=300, d=8):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, d)), 1).astype(np.float32)
    x[50:90] = x[3]                                      # ties
    x[90:95] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1001, [NAN] * d), (1002, [1.0] * (d - 1) + [INF]), (1003, [1.0] * (d - 1) + [None]), (1004, []),
             (None, [1.0] * d), (1006, [1.0, 2.0]), (1100, [2.0, 1.0]), (200, x[200].tolist())]
    return [(*t, None, None, None, None, None, None) for t in rows]


def usable(rows, zero):
    out = {}
    for i, v, *_ in rows:
        if i is None or not v or any(c is None or not np.isfinite(c) for c in v) or (not zero and not any(v)):
            continue
        out[i] = min(out.get(i, v), v)
    return {i: np.array(v, np.float32).astype(np.float64) for i, v in out.items()}


def brute(rows, every, k, score, zero):
    x = usable(rows, zero)
    out = []
    for q in sorted(x):
        if q % every == 0:
            near = sorted(((-score(x[q], x[i]), i) for i in x if i != q and len(x[i]) == len(x[q])))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(near)]
    return out


def product(a, b):
    return int(np.floor(1024 * a) @ np.floor(1024 * b))


def cosine(a, b):
    return float((b * a).sum() / (np.sqrt((b * b).sum()) * np.sqrt((a * a).sum())))


@pytest.mark.parametrize("block,query_block", [(4096, 512), (40, 7)])
def test_products_are_exact(spark, block, query_block):
    rows = odd_vectors(1)
    got = cover_tree.top_products(vectors(spark, rows), F.col("vec_id") % 20 == 0, 10, block=block, query_block=query_block)
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows, 20, 10, product, True))


def wide_product(a, b):
    """Exact, and the nearest long."""
    def whole(c):
        x = 1024.0 * c
        return int(np.floor(x)) if abs(x) < 1 << 53 else int(x)

    return max(-(1 << 63), min((1 << 63) - 1, sum(whole(x) * whole(y) for x, y in zip(a.tolist(), b.tolist()))))


@pytest.mark.parametrize("block,query_block", [(4096, 512), (40, 7)])
@pytest.mark.parametrize("size", [2e4, 1e9, 1e20, 3e38])
def test_products_of_large_components(spark, size, block, query_block):
    """Any finite component takes part, and does not disturb the others."""
    rows = odd_vectors(5, 220)
    extra = [(2000, [size] + [0.5] * 7), (2020, [0.5] * 7 + [-size]), (2021, [size / 7] * 8), (2040, [-size] * 8)]
    rows += [(*t, None, None, None, None, None, None) for t in extra]
    got = cover_tree.top_products(vectors(spark, rows), F.col("vec_id") % 20 == 0, 10, block=block, query_block=query_block)
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows, 20, 10, wide_product, True))


@pytest.mark.parametrize("kind", ["even", "clusters", "line"])
def test_dual_tree(kind):
    r = np.random.default_rng(2)
    n, d = 700, 6
    x = r.normal(size=(n, d)) * 500
    if kind == "clusters":
        x = r.normal(size=(12, d))[r.integers(12, size=n)] * 4000 + r.normal(size=(n, d)) * 20
    if kind == "line":
        x = np.outer(r.normal(size=n), np.ones(d)) * 1000
    x = np.floor(x)
    ids = r.permutation(n)
    pick = ids % 9 == 0
    got = cover_tree.dual_tree(ids, x, ids[pick], x[pick], np.full(pick.sum(), -np.inf), 10)
    got = set(zip(*(a.tolist() for a in got)))
    for i in np.flatnonzero(pick):
        s = (x @ x[i]).astype(np.int64)
        near = [j for j in np.lexsort((ids, -s)) if j != i][:10]
        assert {(ids[i], ids[j], s[j]) for j in near} <= got
    assert len(got) == 10 * pick.sum()


def test_cover_tree_covers():
    r = np.random.default_rng(3)
    x = np.floor(r.normal(size=(400, 5)) * 300)
    x[100:140] = x[7]
    t = cover_tree.CoverTree(x)
    at = np.arange(len(x))
    for centre, radius, parent in reversed(t.levels):
        assert (np.sqrt(((x - x[centre[at]]) ** 2).sum(axis=1)) <= radius[at] + 1e-3).all()
        at = parent[at]


def test_forest_odd_rows(spark):
    rows = odd_vectors(4)
    got = sorted(map(tuple, ann_forest.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0, 5).collect()))
    want = brute(rows, 20, 5, cosine, False)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    x = usable(rows, False)
    assert all(abs(s - cosine(x[q], x[i])) < 1e-14 and q != i for q, _, i, s in got)
    worse = [g for g, w in zip(got, want) if g[3] < w[3] - 1e-14]
    assert len(worse) <= 0.1 * len(want)
    # of equal scores the smaller ids, nearest first
    for (q, n, i, s), (q2, n2, i2, s2) in zip(got, got[1:]):
        assert q != q2 or s > s2 or (s == s2 and i < i2)


def test_forest_recall(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(6000, 64)).astype(np.float32)
    got = ann_forest.nearest(vectors(spark, [(i, v.tolist(), *[None] * 6) for i, v in enumerate(x)]), F.col("vec_id") % 100 == 0, 5).collect()
    x = x / np.linalg.norm(x, axis=1)[:, None]
    found = {(g.query_id, g.vec_id) for g in got}
    hits = sum((i, j) in found for i in range(0, 6000, 100) for j in np.argsort(-(x @ x[i]))[1:6].tolist())
    assert hits / 300 >= 0.9
    # and it does not look at everything
    near = list(ann_forest.Forest(x.astype(np.float64)).candidates(x[:20].astype(np.float64), 600))
    assert all(600 <= len(n) < 3000 for n in near)


@pytest.mark.parametrize("n", [60, 400, 3000])
def test_forest_is_used_at_every_size(spark, n, monkeypatch):
    """Clustered vectors: few candidates are compared, in small tables too, and nearly all nearest are found."""
    r = np.random.default_rng(8)
    x = (r.normal(size=(max(3, n // 12), 32))[r.integers(max(3, n // 12), size=n)] + 0.15 * r.normal(size=(n, 32))).astype(np.float32)
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    got = ann_forest.nearest(vectors(spark, [(i, v.tolist(), *[None] * 6) for i, v in enumerate(x)]), F.col("vec_id") % 5 == 0, 5).collect()
    found = {(g.query_id, g.vec_id) for g in got}
    hits = [(i, j) in found for i in range(0, n, 5) for j in np.argsort(-(unit @ unit[i]), kind="stable")[1:6].tolist()]
    assert np.mean(hits) >= 0.9
    near = list(ann_forest.Forest(unit).candidates(unit[::5], ann_forest.START * 5))
    share = sum(map(len, near)) / (len(near) * n)
    print(f"{n} rows: {share:.3f} compared")
    assert share < (0.1 if n >= 3000 else 1.0)


@pytest.mark.parametrize("kind", ["offset", "twice the offset", "clusters", "a third copies"])
def test_forest_recall_of_vectors_alike(spark, kind):
    r = np.random.default_rng(6)
    n, d = 6000, 64
    x, common = r.normal(size=(n, d)), r.normal(size=d)
    if kind == "clusters":
        x = r.normal(size=(3, d))[r.integers(3, size=n)] + 0.3 * x
    else:
        x += common * (2 if kind == "twice the offset" else 1)
    if kind == "a third copies":
        x[r.permutation(n)[:n // 3]] = x[3]
    x = x.astype(np.float32)
    got = ann_forest.nearest(vectors(spark, [(i, v.tolist(), *[None] * 6) for i, v in enumerate(x)]), F.col("vec_id") % 50 == 0, 5).collect()
    x = x.astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    scores = {}
    for g in got:
        scores.setdefault(g.query_id, []).append(g.score)
    hits = 0
    for i in range(0, n, 50):
        fifth = np.sort(np.delete(x @ x[i], i))[-5]
        hits += sum(s >= fifth - 1e-9 for s in scores[i])
    assert hits / (5 * n / 50) >= 0.9


def test_least_copies():
    x = np.array([[1.0, 2], [0, 0], [1, 2], [1, 2], [-0.0, 0], [3, 4], [1, 2]])
    assert ann_forest.least_copies(x, 2).tolist() == [0, 1, 2, 4, 5]


def test_vectors_empty(spark):
    v = vectors(spark, [])
    assert ann_forest.nearest(v, F.col("vec_id") % 50 == 0, 5).count() == 0
    assert cover_tree.top_products(v, F.col("vec_id") % 100 == 0, 10).count() == 0


# ---- token files

@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 3000])
@pytest.mark.parametrize("top", [1, 2, 1000, 50257, 2 ** 32])
def test_blocks_round_trip(n, top):
    r = np.random.default_rng(n + top)
    ids = r.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
    ids[::17] = min(3 * top, 2 ** 32 - 1)
    words, starts = token_store.pack(ids)
    assert (token_store.unpack(words, starts, n) == ids).all()


def test_outliers_are_exceptions():
    ids = np.arange(256, dtype=np.uint32) % 16
    plain = len(token_store.pack(ids)[0])
    ids[5] = 4_000_000_000
    assert len(token_store.pack(ids)[0]) <= plain + 2


def test_file_reads_any_document(tmp_path):
    r = np.random.default_rng(1)
    docs = [r.integers(0, 60000, n).astype("<u4") for n in (0, 5, 700, 1, 300)]
    token_store.write_file(str(tmp_path / "a.pfor"), [None, 3, 4, 9, 12], [len(d) for d in docs], np.concatenate(docs))
    f = token_store.TokenFile(f"file:{tmp_path}/a.pfor")
    assert f.doc_ids == [None, 3, 4, 9, 12]
    for d, a, b in zip(docs, f.first, f.first[1:]):
        assert (f.ids(int(a), int(b)) == d).all()


def test_file_written_twice(tmp_path):
    for n in (500, 300):
        token_store.write_file(str(tmp_path / "a.pfor"), [1], [n], np.arange(n, dtype="<u4"))
    f = token_store.TokenFile(str(tmp_path / "a.pfor"))
    assert f.ids(0, 300).tolist() == list(range(300)) and f.n_ids == 300 and len(list(tmp_path.iterdir())) == 1


def test_memo_keeps_what_comes_back():
    from flowwatch.llm.common import Memo
    m, asked = Memo(20), 0
    for n in range(200):
        new = m.missing([f"once {n}", "always"])
        asked += "always" in new
        m.young.update((q, n) for q in new)
        assert len(m.young) + len(m.old) <= 24
    assert asked == 1 and m.young["always"] == 0


def test_token_files(spark, odd_docs, odd_rows, empty_docs, monkeypatch):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    monkeypatch.setattr(token_store, "FILE_IDS", 500)    # several files a task
    got = sorted(map(tuple, token_store.token_report(odd_docs, vocabulary("byte_bpe_50k.json")).collect()), key=lambda r: r[1])
    assert [g[0] for g in got] == sorted((r[0] for r in odd_rows), key=lambda d: (d is not None, d or 0))
    want, start = {}, 0
    for r in odd_rows:
        ids = np.array(t.encode(r[1] or "", add_special_tokens=False).ids + [2], "<u4")
        want.setdefault(r[0], set()).add((len(ids), zlib.crc32(ids.tobytes())))
    for d, at, n, crc in got:
        assert at == start and (n, crc) in want[d]
        start += n
    assert token_store.token_report(empty_docs, vocabulary("byte_bpe_50k.json")).count() == 0


def odd_texts(seed, n, alphabet):
    r = random.Random(seed)
    return ["".join(r.choices(alphabet, k=r.randint(0, 30))) for _ in range(n)]


def test_encoder_equals_library():
    e = token_store.Encoder(vocabulary("byte_bpe_50k.json"))
    texts = odd_texts(1, 4000, [" ", "  ", "\n", " \n", " ", "a", "B9", "'s", " 's", "é", ".", "\t", "\x1c", " <|endoftext|>", " ", "漢", "word"])
    texts += ["a" * 5000, "", " ", "x " * 3000]
    want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == want


def test_added_tokens_as_in_the_library(spark):
    from tokenizers import Tokenizer
    path = vocabulary("byte_bpe_50k.json")
    t, e, end = Tokenizer.from_file(path), token_store.Encoder(path), "<|endoftext|>"
    texts = ["a <|endoftext|> b", end, end * 3, f" {end} ", f"a  {end}b  {end}", f"a\n {end}\n\nb", "<|endoftext", f"<{end}|>", f"'{end}s", ""]
    texts += odd_texts(7, 2000, [" ", "  ", "\n", "a", "'s", ".", "\t", "é", "word", end, f" {end}", f"  {end} ", "<|", "|>"])
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert want[0] == [64, 220, 50256, 275]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == want
    got = token_store.token_report(spark.createDataFrame(list(enumerate(texts[:10])), "doc_id long, text string"), path).collect()
    assert {g.doc_id: (g.n_tokens, g.ids_crc32) for g in got} == {
        d: (len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes())) for d, ids in enumerate(want[:10])}


def test_added_tokens_with_flags(tmp_path):
    from tokenizers import AddedToken, Tokenizer
    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    t.add_tokens([AddedToken("<cut>", lstrip=True), AddedToken("two words")])
    t.save(str(tmp_path / "t.json"))
    texts = odd_texts(8, 500, [" ", "a", "two", "words", "two words", " <cut>", "<cut>", "<|endoftext|>", "\n"])
    got = token_store.Encoder(str(tmp_path / "t.json")).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]


# ---- SentencePiece

@pytest.fixture(scope="module")
def pieces():
    return sentencepieces.Pieces(vocabulary("piece_bpe_32k.model"))


ALPHABET = ["a", "b", "the", " ", "  ", "\n", "é", "漢", "字", "▁", "\t", "ing", ".", "...", "==", "--------", "00", "1234",
            "́", "\U0001f600", "ss", "st", "er", "<0x0A>", "<s>", " \n", "x" * 30, "aaaaaaaa", "//", "http://", "\0", " "]


def test_pieces_equal_library(pieces):
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    r = random.Random(2)
    texts = odd_texts(3, 2500, ALPHABET) + ["", "a" * 3000, "=-" * 1500, "漢字" * 1000, "".join(r.choices("abcdestinr", k=4000))]
    for t, ids in zip(texts, pieces.encode_all(texts)):
        assert ids.tolist() == lib.encode(t), repr(t)
        assert pieces.decode(ids.tolist()) == t.replace("▁", " ")


def test_search_commits_early(pieces):
    """Pieces are given out long before the end of a run, from a window of bounded length."""
    text = "".join(random.Random(4).choices("abcdestinr", k=2000))
    read = []

    class Watched(str):
        def __getitem__(self, k):
            read.append(k if isinstance(k, int) else k.stop)
            return str.__getitem__(self, k)

    out = pieces.search(Watched(text))
    next(out)
    assert max(read) < 200 and "".join([text[:0], *out]) != ""


def test_encoded_rows(spark, odd_docs, odd_rows, empty_docs):
    model = vocabulary("piece_bpe_32k.model")
    got = sentencepieces.encode_documents(odd_docs, model).collect()
    assert len(got) == len(odd_rows) and all(g.round_trip and g.n_tokens == len(g.ids) for g in got)
    assert {g.n_tokens for g in got if g.doc_id in (1, 2)} == {0}
    both = odd_docs.select("text", sentencepieces.encoded(spark, F.col("text"), model).alias("i"))
    back = both.select("text", sentencepieces.decoded(spark, F.col("i"), model).alias("t")).collect()
    assert all(r.t == (r.text or "").replace("▁", " ") for r in back)
    assert sentencepieces.encode_documents(empty_docs, model).count() == 0
