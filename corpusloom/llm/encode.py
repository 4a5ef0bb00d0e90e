"""Encoding of a whole corpus with a public byte-level BPE, by dynamic programming over prefixes.

Every byte string has exactly one valid encoding, and so has each of its prefixes. ``PrefixBpe`` keeps for each prefix
the last token of its encoding: token t ends the prefix at i if t's bytes end there and the pair (last token of the
prefix before t, t) is one that the merges leave standing. That token is unique, so a text can be appended to without
looking back further than the longest token, and after an edit only the positions until the stored tokens agree again
are computed anew. Results equal those of the merge loop; tests compare them with two public libraries.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from corpusloom.llm._arrow import map_rows, once
from corpusloom.session import texts as table

#: Fixed values of the public vocabulary byte_bpe_50k: the pattern that splits a text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where the vocabularies lie; every function takes another folder.
TOKENIZERS = "/opt/tokenizers"
#: Remembered pieces of a worker; beyond it the memory starts anew.
CACHE_PIECES = 400_000

NONE = 1 << 30


class PrefixBpe:
    """Byte-pair encoding of single pieces through the last tokens of their prefixes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ids = ranks
        self.halves: list[tuple[int, int]] = [(0, 0)] * (max(ranks.values()) + 1)
        self.pairs: dict[tuple[int, int], int] = {}
        self.size: list[int] = [0] * len(self.halves)
        for token, rank in ranks.items():
            self.size[rank] = len(token)
            if len(token) == 1:
                self.halves[rank] = (rank, rank)
                continue
            left, right = self._last_merge(token, rank)
            self.halves[rank] = (left, right)
            self.pairs[left, right] = rank
        lengths: dict[bytes, set[int]] = {}
        for token in ranks:
            lengths.setdefault(token[-2:], set()).add(len(token))
            if len(token) > 1:
                lengths.setdefault(token[-1:], set())
        #: Lengths of the tokens that end in these two bytes, longest first; a single byte is always one.
        self.lengths = {end: tuple(sorted(ls | {1}, reverse=True)) for end, ls in lengths.items()}
        self.longest = max(map(len, ranks))

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int]:
        """The two tokens whose merge makes ``token``."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: self.ids.get(parts[i] + parts[i + 1], NONE))
            if self.ids.get(parts[best] + parts[best + 1], NONE) >= rank:
                raise ValueError(f"token {rank} can't be reached by merges")
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return self.ids[parts[0]], self.ids[parts[1]]

    def stands(self, left: int, right: int) -> bool:
        """Whether the merges leave these two neighbours apart: undo them step by step, newest first, and look for a
        merge across the gap that would have come earlier."""
        pairs, halves, limit = self.pairs, self.halves, NONE
        while True:
            if pairs.get((left, right), NONE) < limit:
                return False
            if left > right:
                limit, left = left, halves[left][1]
                if left == limit:
                    limit, right = right + 1, halves[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit, right = right + 1, halves[right][0]
                if right + 1 == limit:
                    limit, left = left, halves[left][1]
                    if left == limit:
                        return True

    def _fill(self, piece: bytes, last: list[int], begin: int, stop_at: list[int] | None = None, shift: int = 0) -> int:
        """Last tokens of the prefixes that end after ``begin``; returns where it stopped.

        With ``stop_at`` (the old last tokens, old position = new position - ``shift``) it stops once as many positions
        as the longest token has bytes agree with the old ones: all later ones then agree as well.
        """
        ids, lengths, stands, agreed = self.ids, self.lengths, self.stands, 0
        for end in range(begin + 1, len(piece) + 1):
            token = -1
            for n in lengths.get(piece[max(0, end - 2) : end], (1,)):
                if n > end:
                    continue
                token = ids.get(piece[end - n : end], -1)
                if token >= 0 and (n == end or stands(last[end - n], token)):
                    break
            last[end] = token
            if stop_at is not None:
                old = end - shift
                agreed = agreed + 1 if 0 < old < len(stop_at) and stop_at[old] == token else 0
                if agreed >= self.longest:
                    return end
        return len(piece)

    def prefixes(self, piece: bytes) -> list[int]:
        """last[i]: the last token of the encoding of piece[:i]."""
        last = [-1] * (len(piece) + 1)
        self._fill(piece, last, 0)
        return last

    def append(self, piece: bytes, last: list[int], more: bytes) -> list[int]:
        """The prefix tokens of piece + more, from those of piece."""
        grown = last + [-1] * len(more)
        self._fill(piece + more, grown, len(piece))
        return grown

    def edit(self, piece: bytes, last: list[int], begin: int, end: int, by: bytes) -> tuple[list[int], int]:
        """The prefix tokens after piece[begin:end] became ``by``, and how many positions were computed for it."""
        new = piece[:begin] + by + piece[end:]
        shift = len(by) - (end - begin)
        out = last[: begin + 1] + [-1] * (len(new) - begin)
        old = [-2] * (end + 1) + last[end + 1 :] if end + 1 <= len(last) else []
        stopped = self._fill(new, out, begin, old, shift)
        out[stopped + 1 :] = last[stopped + 1 - shift :] if stopped < len(new) else []
        return out, stopped - begin

    def read(self, last: list[int]) -> list[int]:
        """The encoding that the prefix tokens stand for."""
        out, at = [], len(last) - 1
        while at > 0:
            out.append(last[at])
            at -= self.size[last[at]]
        out.reverse()
        return out

    def piece(self, piece: bytes) -> list[int]:
        whole = self.ids.get(piece)
        return [whole] if whole is not None else self.read(self.prefixes(piece))


class TextEncoder:
    """Texts to ids; special tokens' strings are plain text, an empty and a null text give no ids."""

    def __init__(self, ranks: dict[bytes, int], split: str = SPLIT):
        self.bpe = PrefixBpe(ranks)
        self.split = regex.compile(split)
        self.memory: dict[str, list[int]] = {}

    @classmethod
    def load(cls, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> TextEncoder:
        lines = Path(folder, f"{name}.tiktoken").read_bytes().split(b"\n")
        return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)})

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        memory, add = self.memory, out.extend
        for piece in self.split.findall(text):
            ids = memory.get(piece)
            if ids is None:
                ids = self.bpe.piece(piece.encode("utf-8", "replace"))
                if len(piece) <= 64:
                    if len(memory) >= CACHE_PIECES:
                        memory.clear()
                    memory[piece] = ids
            add(ids)
        return out


IDS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])


def encode_corpus(docs: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, ids of every row of ``docs`` (doc_id, text; other columns are ignored).

    A narrow map without shuffle. Null, empty and missing texts give an empty list, repeated rows are repeated, a null
    doc_id stays null, an empty table gives no rows; texts of any length are encoded whole.
    """

    def make():
        encoder = once(("bpe", name, folder), lambda: TextEncoder.load(name, folder))

        def work(ids: list, texts: list) -> Iterator[tuple]:
            for i, text in zip(ids, texts, strict=True):
                yield i, encoder.encode(text)

        return work

    return map_rows(docs.select("doc_id", "text"), make, IDS, max_rows=2_000)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


QUERIES = {"p7_ids": p7_ids}
