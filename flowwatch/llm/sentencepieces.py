"""SentencePiece encoding and decoding by streaming Viterbi (operator 8).

The vocabulary is a byte-pair model, whose segmentation of a text is the one in
which every piece, and every pair of neighbouring pieces, is left as it is by
the merges.  So the path search has, at each place of the text, one surviving
piece that ends there (the last piece of the prefix's segmentation): among the
pieces that end there, the one that can stand next to the survivor at its
start.  This gives the library's ids, without a merge queue over the text.

The search is streamed: a later piece can only start in the last L places, L
being the longest piece's length.  As soon as the backward paths of all these
places run through one boundary, the pieces before it are final and are given
out, and the window moves on.  That is so before every row of word marks and
around every character outside the vocabulary, which no piece crosses; the runs
between them are remembered in a bounded memo.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from flowwatch.llm.common import Memo, lasting, python_tasks

MARK = "▁"
#: runs that are remembered, the longest of them, and neighbouring pairs that are remembered
MEMO, MEMO_CHARS, PAIRS = 500_000, 40, 250_000


#: rank shared by the pieces that are merged last
_TIED = 1e9
_RUN = re.compile("[^ ]+| +[^ ]*")


class Pieces:
    """A byte-pair SentencePiece vocabulary with byte fallback, identity
    normalisation and a word mark put before the text."""

    def __init__(self, path: str):
        import sentencepiece
        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        names = [lib.id_to_piece(i) for i in range(n)]
        special = [lib.is_control(i) or lib.is_unknown(i) for i in range(n)]
        self.byte_ids = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        byte = set(self.byte_ids)
        self.ids = {p: i for i, p in enumerate(names) if not special[i] and i not in byte}
        self.rank = {p: -lib.get_score(i) for p, i in self.ids.items()}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds a word mark after other characters: runs can't be cut there")
        self.raw = [p.replace(MARK, " ").encode() for p in names]
        for b, i in enumerate(self.byte_ids):
            self.raw[i] = bytes([b])
        for i in range(n):
            if special[i]:
                self.raw[i] = b""
        self.longest = max(map(len, self.ids))
        self.chars = {c for p in self.ids for c in p}
        self.newline = "\n" not in self.chars
        # every ending of a piece, and whether it is a piece itself
        self.tails = {p[k:]: False for p in self.ids for k in range(len(p))}
        self.tails.update((p, True) for p in self.ids)
        self.edges: dict[str, tuple | None] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        # ids of runs after one word mark, and of any others
        self.marked, self.plain = Memo(MEMO), Memo(MEMO // 4)

    # ---- which pieces may stand alone, and next to each other

    def merged(self, text: str) -> list[tuple]:
        """Segmentation of a short text by its merges, the pair of best rank first, of equals the
        left one, as trees (text, left part, right part)."""
        rank, none = self.rank, float("inf")
        s: list[tuple] = [(c, None, None) for c in text]
        cost = [rank.get(a[0] + b[0], none) for a, b in zip(s, s[1:])]
        while cost:
            low = min(cost)
            if low == none:
                break
            i = cost.index(low)
            s[i:i + 2] = [(s[i][0] + s[i + 1][0], s[i], s[i + 1])]
            del cost[i]
            if i < len(cost):
                cost[i] = rank.get(s[i][0] + s[i + 1][0], none)
            if i:
                cost[i - 1] = rank.get(s[i - 1][0] + s[i][0], none)
        return s

    def _edge(self, p: str) -> tuple | None:
        """Symbols at the left and at the right edge of a piece while it is merged: (symbol,
        from, to) by rank.  None: its own merges do not give the piece.  Empty: ranks tie or do
        not rise towards the whole, so times can't be told from them."""
        if p in self.edges:
            return self.edges[p]
        trees = self.merged(p)
        if len(trees) > 1:
            self.edges[p] = None
            return None
        sides = []
        for side in (1, 2):
            spine, node, end = [], trees[0], float("inf")
            while node is not None:
                born = self.rank.get(node[0], -1.0) if node[1] else -1.0
                if born >= end or born == _TIED:
                    self.edges[p] = ()
                    return ()
                spine.append((node[0], born, end))
                node, end = node[side], born
            sides.append(spine)
        self.edges[p] = tuple(sides)
        return self.edges[p]

    def _beside(self, a: str, b: str) -> bool:
        """Whether the merges of a + b give a and b, or of b alone b if a is empty: no symbol at the right edge of the one is,
        while both last, merged with one at the left edge of the other."""
        key = (a, b)
        found = self.pairs.get(key)
        if found is not None:
            return found
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        one, two = self._edge(a) if a else (), self._edge(b)
        if two is None or not a:
            found = two is not None
        elif one and two:
            rank, found = self.rank, True
            for x, x_from, x_to in one[1]:
                for y, y_from, y_to in two[0]:
                    r = rank.get(x + y)
                    if r is None:
                        continue
                    at = max(x_from, y_from, r)
                    # of equal ranks the left one is merged first
                    if at < x_to and at <= y_to:
                        found = False
        else:
            found = [t[0] for t in self.merged(a + b)] == [a, b]
        self.pairs[key] = found
        return found

    # ---- the search

    def _extend(self, last: list[str], text: str, done: int, upto: int) -> None:
        """Adds to ``last``, the surviving pieces that end at each place from ``done`` on, those up to ``upto``."""
        tails, pairs, longest = self.tails.get, self.pairs.get, self.longest
        for i in range(done + len(last), upto + 1):
            ends = [text[i - 1]]           # pieces that end here; a single character always may
            low = i - longest if i - longest > done else done
            for k in range(i - 2, low - 1, -1):
                p = text[k:i]
                whole = tails(p)
                if whole:
                    ends.append(p)
                elif whole is None:
                    break
            at = i - done
            for p in reversed(ends):
                left = last[at - len(p)]
                beside = pairs((left, p))
                if beside or (beside is None and self._beside(left, p)):
                    break
            last.append(p)

    def search(self, text: str, last: list[str] | None = None) -> Iterator[str]:
        """Pieces of a run, each given out once it is final.

        ``last`` holds the surviving pieces of the first places, as far as they are known from a run that
        begins alike, and is left with those of the first window.  A window that reaches the end of the
        run has one live place, the end, so all paths have met there."""
        n, done, last = len(text), 0, [""] if last is None else last
        while done < n:
            i = min(n, done + len(last) + self.longest)
            self._extend(last, text, done, i)
            # the boundary through which the paths of all places in the window run
            live = {n} if i == n else set(range(max(done, i - self.longest + 1), i + 1))
            while len(live) > 1 and min(live) > done:
                top = max(live)
                live.remove(top)
                live.add(top - len(last[top - done]))
            edge = min(live)
            if edge > done:
                path, at = [], edge
                while at > done:
                    path.append(last[at - done])
                    at -= len(path[-1])
                yield from reversed(path)
                last = [path[0], *last[edge - done + 1:]]
                done = edge

    def _bytes(self, pieces: Iterator[str]) -> bytes:
        out: list[int] = []
        for p in pieces:
            i = self.ids.get(p)
            if i is None:
                out.extend([self.byte_ids[b] for b in p.encode()])
            else:
                out.append(i)
        return array("I", out).tobytes()

    def _learn(self, memo: Memo, runs: list[str], mark: str) -> None:
        """Puts the ids of new runs into a memo.  Runs are searched in order: each goes on from
        the places that it shares with the first window of the one before."""
        last, before, known = [""], "", memo.young
        for run in sorted(runs):
            text = mark + run
            same, n = 0, min(len(before), len(text), len(last) - 1)
            while same < n and before[same] == text[same]:
                same += 1
            del last[same + 1:]
            known[run] = self._bytes(self.search(text, last))
            before = text

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids (u32) of whole texts; none for null and empty ones."""
        line_end = array("I", [self.byte_ids[10]]).tobytes()
        cut, marked, plain = [], set(), set()
        for t in texts:
            lines = []
            if t:
                t = " " + t.replace(MARK, " ")
                for line in t.split("\n") if self.newline else [t]:
                    if "  " in line:
                        runs = [r.replace(" ", MARK) for r in _RUN.findall(line)]
                        plain.update(runs)
                        lines.append((runs, None))
                    else:
                        first, *rest = line.split(" ")
                        plain.add(first)
                        marked.update(rest)
                        lines.append(([first], rest))
            cut.append(lines)
        self._learn(self.marked, self.marked.missing(marked), MARK)
        self._learn(self.plain, self.plain.missing(plain), "")
        one, two = self.plain.young.__getitem__, self.marked.young.__getitem__
        out = [np.frombuffer(line_end.join([b"".join([*map(one, a), *map(two, b or ())]) for a, b in lines]), "<u4")
               for lines in cut]
        for memo, runs in ((self.marked, marked), (self.plain, plain)):
            for r in runs:
                if len(r) >= MEMO_CHARS:
                    memo.young.pop(r, None)
        return out

    def rest(self) -> None:
        """Gives back memory between tasks."""
        self.marked.rest()
        self.plain.rest()

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids) -> str:
        """Text of ids; bytes that are not UTF-8 become U+FFFD."""
        text = b"".join([self.raw[i] for i in ids])
        return text[1:].decode("utf-8", "replace") if text[:1] == b" " else text.decode("utf-8", "replace")


def encoded(spark, text: Column, vocabulary: str) -> Column:
    """Ids of a text column, array<int>."""
    python_tasks(spark)

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = lasting(f"pieces {vocabulary}", lambda: Pieces(vocabulary))
        for texts in batches:
            yield pd.Series([i.astype(np.int32) for i in model.encode_all(list(texts))], dtype=object)
        model.rest()

    return run(text)


def decoded(spark, ids: Column, vocabulary: str) -> Column:
    """Text of an array<int> column; null ids give null."""
    python_tasks(spark)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = lasting(f"pieces {vocabulary}", lambda: Pieces(vocabulary))
        for rows in batches:
            yield pd.Series([None if r is None else model.decode(r.tolist()) for r in rows], dtype=object)

    return run(ids)


def encode_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, ids (array<int>), ids_crc32 (of the ids as
    little-endian u32) and round_trip: the ids decode to the text.

    Null and empty texts have no ids and decode to the empty text.  The word
    mark itself (U+2581) reads as a space, in encoding and so in decoding.
    Rows without an id, and rows repeating one, are encoded like any other.
    Other columns are not read.  An empty table gives no rows.
    """
    python_tasks(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = lasting(f"pieces {vocabulary}", lambda: Pieces(vocabulary))
        for pdf in batches:
            ids = model.encode_all(list(pdf["text"]))
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"].astype("Int64"), "n_tokens": [len(i) for i in ids],
                "ids": [i.astype(np.int32) for i in ids],
                "ids_crc32": [zlib.crc32(i.astype("<u4").tobytes()) for i in ids],
                "round_trip": [model.decode(i.tolist()) == (t or "").replace(MARK, " ") for i, t in zip(ids, pdf["text"])]})
        model.rest()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
        run, "doc_id long, n_tokens long, ids array<int>, ids_crc32 long, round_trip boolean")
