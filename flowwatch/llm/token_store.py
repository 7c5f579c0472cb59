"""Token ids in files of patched frame-of-reference blocks (operator 4).

Documents are put in ascending id order by a range partitioning; each task
encodes its documents and writes files of bounded size to the shared folder.
A file is, little-endian, with sections of whole 4-byte words:

    magic "FWPFOR01"; u64 n_docs, n_null (documents without an id, which come first), n_ids, n_words
    i64 doc_id[n_docs]; u64 first[n_docs + 1]   (place of each document's first id in the file)
    u64 block[n_blocks + 1]                     (index: word at which each block of 256 ids starts)
    u32 words[n_words]                          (the blocks)

A block is its minimum; a word with the bit width (low 8 bits) and the number
of exceptions; 8 * width words of packed differences; the exceptions' positions
as bytes, filled up to a whole word; and their differences, a word each.  The
width is the one of a percentile of the differences, whichever of a few gives
the smallest block; larger differences are the exceptions.  Value j * 8 + lane
lies at bit j * width of the lane's words, so all lanes are packed at once.  The
last block is filled up with its own minimum.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from flowwatch.llm.common import Memo, lasting, python_tasks, scratch_path, stored

MAGIC = b"FWPFOR01"
BLOCK, LANES = 256, 8
PERCENTILES = (50, 75, 90, 95, 98, 100)
#: id appended to each document; ids after which a file is closed (at a document's end)
END_ID, FILE_IDS = 2, 1 << 22
#: pieces of text whose ids a worker remembers; chars beyond which a piece is not remembered
MEMO, MEMO_CHARS = 1_000_000, 64


# ---- blocks ---------------------------------------------------------------

def _bits(x: np.ndarray) -> np.ndarray:
    """Bit length of unsigned 32-bit values."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words u32, block starts u64 with the end) of the blocks of ``ids`` (u32)."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return np.zeros(0, "<u4"), np.zeros(1, "<u8")
    full = np.empty(n * BLOCK, np.uint32)
    full[:len(ids)] = ids
    if len(ids) < len(full):
        full[len(ids):] = ids[(n - 1) * BLOCK:].min()
    rows = full.reshape(n, BLOCK)
    low = rows.min(axis=1)
    diff = rows - low[:, None]
    ranked = np.sort(diff, axis=1)
    at = [max(0, -(-BLOCK * p // 100) - 1) for p in PERCENTILES]
    widths = _bits(ranked[:, at])
    largest = ((np.uint64(1) << widths.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
    over = np.stack([np.count_nonzero(ranked > largest[:, k, None], axis=1) for k in range(len(at))], axis=1)
    best = (widths * LANES + -(-over // 4) + over).argmin(axis=1)
    each = np.arange(n)
    width, n_over, largest = widths[each, best], over[each, best], largest[each, best]
    sizes = 2 + width * LANES + -(-n_over // 4) + n_over
    starts = np.concatenate(([0], np.cumsum(sizes)))
    words = np.zeros(starts[-1], np.uint32)
    words[starts[:-1]] = low
    words[starts[:-1] + 1] = width | n_over << 8
    for w in np.unique(width).tolist():
        mine = np.flatnonzero(width == w)
        if w:
            v = diff[mine].reshape(-1, BLOCK // LANES, LANES)
            v = v & np.uint32((1 << w) - 1)
            out = np.zeros((len(mine), w, LANES), np.uint32)
            for j in range(BLOCK // LANES):
                k, s = divmod(j * w, 32)
                out[:, k] |= v[:, j] << np.uint32(s)
                if s + w > 32:
                    out[:, k + 1] |= v[:, j] >> np.uint32(32 - s)
            words[(starts[mine] + 2)[:, None] + np.arange(w * LANES)] = out.reshape(len(mine), -1)
    for b in np.flatnonzero(n_over).tolist():
        pos = np.flatnonzero(diff[b] > largest[b]).astype(np.uint8)
        a = int(starts[b] + 2 + width[b] * LANES)
        m = -(-len(pos) // 4)
        words[a:a + m] = np.frombuffer(pos.tobytes().ljust(4 * m, b"\0"), "<u4")
        words[a + m:a + m + len(pos)] = diff[b, pos]
    return words.astype("<u4"), starts.astype("<u8")


def unpack(words: np.ndarray, starts: np.ndarray, n_ids: int, first: int = 0) -> np.ndarray:
    """The ids (u32) of the blocks that start at ``starts[:-1]``; the first ``n_ids`` of them."""
    starts = starts.astype(np.int64) - first
    n = len(starts) - 1
    out = np.empty((n, BLOCK), np.uint32)
    low, head = words[starts[:-1]], words[starts[:-1] + 1].astype(np.int64) if n else np.zeros(0, np.int64)
    width, n_over = head & 255, head >> 8
    for w in np.unique(width).tolist():
        mine = np.flatnonzero(width == w)
        v = np.zeros((len(mine), BLOCK // LANES, LANES), np.uint32)
        if w:
            p = words[(starts[mine] + 2)[:, None] + np.arange(w * LANES)].reshape(len(mine), w, LANES)
            mask = np.uint32((1 << w) - 1)
            for j in range(BLOCK // LANES):
                k, s = divmod(j * w, 32)
                x = p[:, k] >> np.uint32(s)
                if s + w > 32:
                    x = x | p[:, k + 1] << np.uint32(32 - s)
                v[:, j] = x & mask
        out[mine] = v.reshape(len(mine), BLOCK)
    for b in np.flatnonzero(n_over).tolist():
        m = int(n_over[b])
        a = int(starts[b] + 2 + width[b] * LANES)
        c = -(-m // 4)
        pos = words[a:a + c].astype("<u4").view(np.uint8)[:m]
        out[b, pos] = words[a + c:a + c + m]
    out += low[:, None].astype(np.uint32)
    return out.reshape(-1)[:n_ids]


# ---- files ----------------------------------------------------------------

def _store(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        uri = re.sub("^file:/*", "/", uri)
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def write_file(uri: str, doc_ids: list, lengths: list[int], ids: np.ndarray) -> None:
    """Writes one file under a name of its own and then moves it: a task that runs twice leaves the
    same file, also where a move does not overwrite."""
    words, starts = pack(ids)
    null = sum(d is None for d in doc_ids)
    first = np.concatenate(([0], np.cumsum(np.asarray(lengths, np.int64)))).astype("<u8")
    head = np.array([len(doc_ids), null, len(ids), len(words)], "<u8")
    known = np.array([0 if d is None else d for d in doc_ids], "<i8")
    store, path = _store(uri)
    ctx = TaskContext.get()
    part = f"{path}.{ctx.taskAttemptId() if ctx else 0}"
    with store.open_output_stream(part) as f:
        for section in (MAGIC, head, known, first, starts, words):
            f.write(section if isinstance(section, bytes) else section.tobytes())
    if store.get_file_info(path).type != fs.FileType.NotFound:
        store.delete_file(path)
    store.move(part, path)


class TokenFile:
    """Reads a file written by ``write_file``: ``doc_ids``, ``first``, and ids of any document."""

    def __init__(self, uri: str):
        store, path = _store(uri)
        self.file = store.open_input_file(path)
        if self.file.read(8) != MAGIC:
            raise ValueError(f"not a token file: {uri}")
        n_docs, null, self.n_ids, n_words = (int(x) for x in np.frombuffer(self.file.read(32), "<u8"))
        known = np.frombuffer(self.file.read(8 * n_docs), "<i8").tolist()
        self.doc_ids = [None] * null + known[null:]
        self.first = np.frombuffer(self.file.read(8 * (n_docs + 1)), "<u8").astype(np.int64)
        self.blocks = np.frombuffer(self.file.read(8 * (-(-self.n_ids // BLOCK) + 1)), "<u8")
        self.base = self.file.tell()

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end`` of the file; reads only the blocks that hold them."""
        a, b = start // BLOCK, -(-end // BLOCK)
        if start >= end:
            return np.zeros(0, np.uint32)
        lo, hi = int(self.blocks[a]), int(self.blocks[b])
        self.file.seek(self.base + 4 * lo)
        words = np.frombuffer(self.file.read(4 * (hi - lo)), "<u4")
        return unpack(words, self.blocks[a:b + 1], (b - a) * BLOCK, lo)[start - a * BLOCK:end - a * BLOCK]


# ---- encoding -------------------------------------------------------------

_ODD_SPACE = re.compile(r" (?:\s|\Z)")
_SPACE = re.compile(r" (?=\S)")


class Encoder:
    """Byte-level BPE of the tokenizers library.

    The vocabulary's pattern never joins a space that is followed by a
    non-space to what is before it, so a text is cut before every such space.
    Pieces are remembered in a bounded memo, which a worker keeps from task to
    task; new ones are encoded many at a time and told apart by their leading spaces.

    Strings of added tokens in a text ("<|endoftext|>") are those tokens, as the
    library has it; what lies between them is encoded by itself."""

    def __init__(self, path: str):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = {t.content: np.array([i], "<u4").tobytes() for i, t in added.items() if t.content}
        longest = sorted(self.added, key=len, reverse=True)
        self.parting = re.compile(f"({'|'.join(map(re.escape, longest))})") if longest else None
        # tokens that also take or ask for something around them are left to the library
        self.plain = all(not (t.lstrip or t.rstrip or t.single_word or " " in t.content or (t.normalized and self.tokenizer.normalizer))
                         for t in added.values())
        vocab = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocab.values()) + 1, bool)
        space = self.tokenizer.pre_tokenizer.pre_tokenize_str(" ")[0][0]
        self.spaced[[i for t, i in vocab.items() if t.startswith(space)]] = True
        self.memo = Memo(MEMO)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4") for e in found]

    def _new(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces, each with a space before it."""
        out: dict[str, bytes] = {}
        odd = [p for p in pieces if " " in p or len(p) > MEMO_CHARS]
        if odd:
            out.update(zip(odd, (e.tobytes() for e in self._encode([" " + p for p in odd]))))
            pieces = [p for p in pieces if p not in out]
        runs = [pieces[i:i + 500] for i in range(0, len(pieces), 500)]
        for run, ids in zip(runs, self._encode(["".join([" " + p for p in run]) for run in runs])):
            cuts = np.append(np.flatnonzero(self.spaced[ids]), len(ids)) * 4
            raw, cuts = ids.tobytes(), cuts.tolist()
            if len(cuts) != len(run) + 1:
                raise ValueError("the vocabulary joins spaces to what is before them")
            out.update(zip(run, [raw[a:b] for a, b in zip(cuts, cuts[1:])]))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids (u32) of whole texts."""
        if not self.plain:
            return [e.tobytes() for e in self._encode(texts)]
        if self.parting is None:
            return self._between(texts)
        parts = [self.parting.split(t) for t in texts]          # every second one is an added token
        between = iter(self._between([x for p in parts for x in p[::2]]))
        return [b"".join([self.added[x] if n % 2 else next(between) for n, x in enumerate(p)]) for p in parts]

    def _between(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without added tokens."""
        pieces = [(_SPACE.split(t) if _ODD_SPACE.search(t) else t.split(" ")) for t in texts]
        new: set[str] = set()
        for p in pieces:
            new.update(p[1:])
        known = self._new(self.memo.missing(new))
        memo = self.memo.young
        memo.update(known)
        firsts = [e.tobytes() for e in self._encode([p[0] for p in pieces])]
        out = [a + b"".join(map(memo.__getitem__, p[1:])) for a, p in zip(firsts, pieces)]
        for p in known:
            if len(p) > MEMO_CHARS:
                del memo[p]
        return out


def write_tokens(docs: DataFrame, out: str, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """Writes the files of ``docs`` under ``out``; returns their list (file, n_docs, n_ids, base).

    Documents are in ascending order of doc_id (null first, repeated ids by the
    text's hash); null texts are empty: the end id alone.  Files' names are in that
    order too; ``base`` is the number of ids in the files before.  An empty
    table gives no files.  Other columns are not read."""
    python_tasks(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        end, enc = np.array([end_id], "<u4").tobytes(), lasting(f"encoder {vocabulary}", lambda: Encoder(vocabulary))
        store, folder = _store(out)
        store.create_dir(folder, recursive=True)
        doc_ids: list = []
        kept: list[bytes] = []
        n, files = 0, 0

        def close() -> pd.DataFrame:
            name = f"part-{TaskContext.get().partitionId():07d}-{files:05d}.pfor"
            ids = np.frombuffer(b"".join(kept), "<u4")
            write_file(f"{out}/{name}", doc_ids, [len(k) // 4 for k in kept], ids)
            return pd.DataFrame({"file": [name], "n_docs": [len(doc_ids)], "n_ids": [len(ids)]})

        for pdf in batches:
            texts = ["" if t is None else t for t in pdf["text"]]
            for d, e in zip(pdf["doc_id"], enc.encode(texts)):
                doc_ids.append(None if pd.isna(d) else int(d))
                kept.append(e + end)
                n += len(kept[-1]) // 4
                if n >= FILE_IDS:
                    yield close()
                    doc_ids, kept, n, files = [], [], 0, files + 1
        if doc_ids:
            yield close()
        enc.memo.rest()

    rows = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions(
        "doc_id", F.xxhash64("text"))
    files = stored(rows.mapInPandas(run, "file string, n_docs long, n_ids long"), "token-files")
    before = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    return files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_tokens(files: DataFrame, out: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    spark = files.sparkSession

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, base in zip(pdf["file"], pdf["base"]):
                f = TokenFile(f"{out}/{name}")
                ids = np.ascontiguousarray(f.ids(0, f.n_ids), "<u4")
                bounds = f.first.tolist()
                yield pd.DataFrame({
                    "doc_id": pd.array(f.doc_ids, "Int64"), "start": f.first[:-1] + base, "n_tokens": np.diff(f.first),
                    "ids_crc32": [zlib.crc32(ids[a:b]) for a, b in zip(bounds, bounds[1:])]})

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.select("file", "base").repartition(tasks, "file").mapInPandas(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_report(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """Writes ``docs`` to files in the shared folder and reads them back."""
    out = scratch_path(docs.sparkSession, "pfor")
    return read_tokens(write_tokens(docs, out, vocabulary, end_id), out)
