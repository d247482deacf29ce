"""Encoding of a corpus with a public byte-level BPE vocabulary.

Texts are cut into pieces by the vocabulary's pattern. Within a piece the merges follow a segment tree over the ranks
of adjacent pairs: the root yields the leftmost pair of the lowest rank, the merge changes three leaves, and each
change climbs to the root in logarithmic time. Pieces of one size class run through their trees together, as rows of
one array, so that a step costs a few array operations for all of them.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern that cuts text into pieces before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose ids are remembered by one worker; beyond, the memory starts afresh.
REMEMBERED = 200_000
#: Longer pieces are not remembered, so that the memory stays small.
REMEMBERED_CHARS = 64
#: Leaves of the trees that run together.
TOGETHER = 1 << 19
#: From so many pieces of a size class on, they run together; fewer run one by one.
FEW = 12
NEVER = np.int64(1) << 62

_MADE: dict[int, Merger] = {}


def vocabulary(path: str | None = None, name: str = "byte_bpe_50k.tiktoken") -> bytes:
    """The rank file ``name`` under ``path`` (the folder of public vocabularies; by default where it is installed)."""
    if path is None:
        try:
            import public_tokenizers

            path = os.path.dirname(public_tokenizers.__file__)
        except ImportError:
            path = "/opt/tokenizers"
    with open(os.path.join(path, name), "rb") as file:
        return file.read()


class Merger:
    """The merges of one vocabulary, applied to pieces."""

    def __init__(self, ranks: bytes):
        self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line.strip())}
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in self.rank.items():
            for cut in range(1, len(token)):
                left, right = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = rank
        self.pair = pairs
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.values = np.array([pairs[int(k)] for k in self.keys], dtype=np.int64)
        self.known: dict[str, tuple[int, ...]] = {}

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NEVER where it does not merge (as when one side is -1)."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.values[at], NEVER)

    def one(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece by its own tree."""
        n = len(piece)
        token = self.byte[np.frombuffer(piece, dtype=np.uint8)].tolist()
        size = 1
        while size < max(1, n - 1):
            size *= 2
        never, pair = 1 << 62, self.pair
        tree = [never] * (2 * size)
        for i in range(n - 1):
            rank = pair.get(token[i] << 20 | token[i + 1])
            if rank is not None:
                tree[size + i] = rank << 32 | i
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            i += size
            tree[i] = value
            i >>= 1
            while i:
                value = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == value:
                    break
                tree[i] = value
                i >>= 1

        while tree[1] < never:
            i, rank = tree[1] & 0xFFFFFFFF, tree[1] >> 32
            gone = after[i]
            token[i], token[gone] = rank, -1
            after[i] = right = after[gone]
            if gone < n - 1:
                put(gone, never)
            if right < n:
                before[right] = i
                found = pair.get(rank << 20 | token[right])
                put(i, never if found is None else found << 32 | i)
            else:
                put(i, never)
            if (left := before[i]) >= 0:
                found = pair.get(token[left] << 20 | rank)
                put(left, never if found is None else found << 32 | left)
        return tuple(t for t in token if t >= 0)

    def together(self, pieces: list[bytes], size: int) -> list[tuple[int, ...]]:
        """Ids of pieces of at most ``size`` bytes, by trees of ``size`` leaves that are rows of one array."""
        m = len(pieces)
        token = np.full((m, size + 2), -1, dtype=np.int64)  # column 0 and the last stay -1: no neighbour
        for row, piece in enumerate(pieces):
            token[row, 1 : len(piece) + 1] = self.byte[np.frombuffer(piece, dtype=np.uint8)]
        after = np.tile(np.arange(1, size + 3), (m, 1))
        before = np.tile(np.arange(-1, size + 1), (m, 1))
        tree = np.full((m, 2 * size), NEVER, dtype=np.int64)
        ranks = self.lookup(token[:, 1:-1], token[:, 2:])
        tree[:, size:] = np.where(ranks < NEVER, ranks << 32 | np.arange(size), NEVER)
        level = size
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        rows = np.flatnonzero(tree[:, 1] < NEVER)
        while len(rows):
            root = tree[rows, 1]
            leaf, rank = root & 0xFFFFFFFF, root >> 32
            i = leaf + 1
            gone = after[rows, i]
            right = after[rows, gone]
            left = before[rows, i]
            token[rows, i] = rank
            token[rows, gone] = -1
            after[rows, i] = right
            before[rows, np.minimum(right, size + 1)] = i
            end = token[rows, np.minimum(right, size + 1)]
            for at, found in ((gone - 1, None), (leaf, self.lookup(rank, end)), (left - 1, self.lookup(token[rows, left], rank))):
                inside = (at >= 0) & (at < size)
                r, node = rows[inside], at[inside] + size
                value = np.full(len(r), NEVER) if found is None else np.where(found[inside] < NEVER, found[inside] << 32 | at[inside], NEVER)
                tree[r, node] = value
                while len(node) and node[0] > 1:
                    node = node >> 1
                    tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])
            rows = rows[tree[rows, 1] < NEVER]
        return [tuple(t[t >= 0].tolist()) for t in token]

    def learn(self, pieces: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """Ids of every piece."""
        known, out, classes = self.known, {}, {}
        for piece in pieces:
            if (ids := known.get(piece)) is not None:
                out[piece] = ids
                continue
            raw = piece.encode("utf-8", "surrogatepass")
            if (whole := self.rank.get(raw)) is not None:
                out[piece] = (whole,)
            else:
                classes.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), []).append((piece, raw))
        for size, members in classes.items():
            if len(members) < FEW:
                out.update((piece, self.one(raw)) for piece, raw in members)
                continue
            step = max(1, TOGETHER // size)
            for k in range(0, len(members), step):
                part = members[k : k + step]
                out.update(zip((p for p, _ in part), self.together([raw for _, raw in part], size), strict=True))
        if len(known) + len(out) > REMEMBERED:
            known.clear()
        known.update((p, ids) for p, ids in out.items() if len(p) <= REMEMBERED_CHARS)
        return out


_PIECES = regex.compile(PATTERN)


def encode(merger: Merger, texts: list[str | None]) -> Iterator[list[int]]:
    """Ids of each text; none for a null or empty one."""
    pieces = [_PIECES.findall(text) if text else [] for text in texts]
    ids = merger.learn({p for found in pieces for p in found})
    for found in pieces:
        out: list[int] = []
        for p in found:
            out += ids[p]
        yield out


def merger_of(ranks: bytes) -> Merger:
    """The merger of a rank file, made once per worker."""
    if (key := hash(ranks)) not in _MADE:
        _MADE[key] = Merger(ranks)
    return _MADE[key]


#: Characters that are encoded at once, so that a batch of long texts needs no more memory than one of short ones.
AT_ONCE = 2_000_000


def _chunks(column: pa.Array) -> Iterator[list[str | None]]:
    part, size = [], 0
    for value in column:
        text = value.as_py()
        part.append(text)
        size += len(text or "")
        if size > AT_ONCE:
            yield part
            part, size = [], 0
    if part:
        yield part


def _over(ranks, texts: pa.Array, counts: bool) -> pa.Array:
    merger = merger_of(ranks.value)
    offsets, values, lengths = [0], [], []
    for part in _chunks(texts):
        flat: list[int] = []
        base = offsets[-1]
        for ids in encode(merger, part):
            if counts:
                lengths.append(len(ids))
            else:
                flat += ids
                offsets.append(base + len(flat))
        values.append(np.array(flat, dtype=np.int32))
    if counts:
        return pa.array(lengths, pa.int64())
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(values) if values else [], pa.int32()))


def with_ids(df: DataFrame, text: str = "text", out: str = "ids", path: str | None = None, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """``df`` with ``out``, the ids of ``text``; an empty list for an empty and for a null text.

    Strings of special tokens are ordinary text. No row is dropped, no text cut; a text of any length is encoded in
    time n log n. All columns are kept; ``out`` replaces a column of that name.
    """
    ranks = df.sparkSession.sparkContext.broadcast(vocabulary(path, name))

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        return _over(ranks, texts, False)

    return df.withColumn(out, ids(F.col(text)))


def with_token_count(df: DataFrame, text: str = "text", out: str = "tokens", path: str | None = None, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """``df`` with ``out``, the number of ids of ``text``; 0 for an empty and for a null text."""
    ranks = df.sparkSession.sparkContext.broadcast(vocabulary(path, name))

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        return _over(ranks, texts, True)

    return df.withColumn(out, count(F.col(text)))


def decoded(ids: Column, ranks: dict[bytes, int]) -> Column:
    """Text of ids again, for round trips over small data: the vocabulary is a literal of the plan."""
    back = {rank: token for token, rank in ranks.items()}

    @F.udf("string")
    def text(values: list[int] | None) -> str | None:
        return None if values is None else b"".join(back[v] for v in values).decode("utf-8", "replace")

    return text(ids)
