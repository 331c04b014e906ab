"""Byte-level BPE encoding with numpy: every distinct piece of text is a row of a padded matrix.

Pieces are bucketed by length. In each round every row of a bucket merges its leftmost pair of minimum rank:
ranks of adjacent pairs come from an open-addressing hash table held in numpy arrays, the row is compacted by one
column, and rows without a mergeable pair leave the matrix. A piece of more than FOLD bytes is folded into several rows of a
matrix of its own, whose rounds are the same.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed value: the piece pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

NONE = np.int32(2**31 - 1)
FOLD, BLOCK = 1024, 256  # bytes from which a piece is folded into the rows of a matrix of its own, and tokens of such a row
CACHE = 400_000  # distinct pieces kept by a worker
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Byte strings and ids of a rank file (base64 and rank on each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairTable:
    """Rank of the token made of two adjacent tokens, by hashed lookup of whole arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.bits = max(10, (2 * len(pairs)).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.values = np.full(size, NONE, np.int32)
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        values = np.fromiter(pairs.values(), np.int32, len(pairs))
        slots = self._slots(keys)
        self.probes = 0
        left = np.arange(len(keys))
        while len(left):  # each round places one key in every free slot that is asked for
            self.probes += 1
            at = slots[left]
            free = self.keys[at] == -1
            _, first = np.unique(np.where(free, at, -1 - left), return_index=True)
            placed = left[first][free[first]]
            self.keys[slots[placed]], self.values[slots[placed]] = keys[placed], values[placed]
            left = np.setdiff1d(left, placed, assume_unique=True)
            slots[left] = (slots[left] + 1) & (size - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs (a, b), NONE where there is none; negative ids are padding."""
        keys = (a.astype(np.int64) << 32) | b.astype(np.int64)
        keys[(a < 0) | (b < 0)] = -2
        slots = self._slots(keys)
        out = np.full(keys.shape, NONE, np.int32)
        open_ = np.flatnonzero(keys.ravel() != -2)
        flat, slot, result = keys.ravel(), slots.ravel(), out.ravel()
        for _ in range(self.probes):
            if not len(open_):
                break
            found = self.keys[slot[open_]]
            hit = found == flat[open_]
            result[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
        return result.reshape(keys.shape)


class Encoder:
    """Encodes texts; ``ranks`` maps each token's bytes to its id and holds all 256 single bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import regex

        self.split = regex.compile(pattern).findall
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.pairs = PairTable(ranks)
        self.whole = {k: np.array([v], np.int32) for k, v in ranks.items()}
        self.known: dict[str, np.ndarray] = {}
        self.ranks: dict[int, int] = {}

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece."""
        out: list = [self.whole.get(p) for p in pieces]
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if out[i] is None:
                if len(p) > FOLD:
                    out[i] = self._folded(p)
                else:
                    buckets.setdefault(-(-len(p) // 4) * 4, []).append(i)
        for wide, members in buckets.items():
            for start in range(0, len(members), 8192):
                part = members[start : start + 8192]
                for i, ids in zip(part, self._rows([pieces[i] for i in part], wide)):
                    out[i] = ids
        return out

    def _rows(self, pieces: list[bytes], wide: int) -> list[np.ndarray]:
        raw = np.frombuffer(b"".join(p.ljust(wide, b"\0") for p in pieces), np.uint8).reshape(-1, wide)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = np.where(np.arange(wide) < size[:, None], self.single[raw], np.int32(-1))
        rank = np.full(ids.shape, NONE, np.int32)
        rank[:, :-1] = self.pairs(ids[:, :-1], ids[:, 1:])
        row, out = np.arange(len(pieces)), [None] * len(pieces)
        while len(row):
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(row)), at]
            done = best == NONE
            for k in np.flatnonzero(done):
                out[row[k]] = ids[k, : size[k]].copy()
            keep = ~done
            ids, rank, row, size, at, best = ids[keep], rank[keep], row[keep], size[keep] - 1, at[keep], best[keep]
            if not len(row):
                break
            n = np.arange(len(row))
            ids[n, at] = best
            take = np.arange(ids.shape[1] - 1)[None, :]
            take = take + (take > at[:, None])  # the column after the merged one goes
            ids, rank = np.take_along_axis(ids, take, 1), np.take_along_axis(rank, take, 1)
            wide = ids.shape[1]
            after = np.where(at + 1 < wide, ids[n, np.minimum(at + 1, wide - 1)], -1)
            rank[n, at] = self.pairs(best, after)
            left = at > 0
            rank[n[left], at[left] - 1] = self.pairs(ids[n[left], at[left] - 1], best[left])
        return out

    def _rank(self, a: int, b: int) -> int:
        """Rank of one pair, remembered."""
        key = a << 32 | b
        if key not in self.ranks:
            if len(self.ranks) > CACHE:
                self.ranks.clear()
            self.ranks[key] = int(self.pairs(np.array([a], np.int32), np.array([b], np.int32))[0])
        return self.ranks[key]

    def _folded(self, piece: bytes) -> np.ndarray:
        """A very long piece, folded into padded rows of BLOCK tokens: a round merges its leftmost pair of minimum rank as well.

        Each row's least rank is kept, so a round looks at one figure a row and at one or two rows, which are compacted;
        when half of the room is padding the rows are filled up again. The last pair of a row is with the first token of the next.
        """
        tokens = self.single[np.frombuffer(piece, np.uint8)]
        while True:
            rows = -(-len(tokens) // BLOCK)
            ids = np.full((rows, BLOCK), -1, np.int32)
            ids.ravel()[: len(tokens)] = tokens
            size = [BLOCK] * (rows - 1) + [len(tokens) - BLOCK * (rows - 1)]
            flat = np.full(rows * BLOCK, NONE, np.int32)
            flat[: max(len(tokens) - 1, 0)] = self.pairs(tokens[:-1], tokens[1:]) if len(tokens) > 1 else NONE
            rank = flat.reshape(rows, BLOCK)
            least = rank.min(axis=1)
            before, after = list(range(-1, rows - 1)), [*range(1, rows), -1]  # rows that still have tokens
            left, room = len(tokens), max(len(tokens) // 2, 1)
            done = False
            while left > room or rows == 1:
                r = int(least.argmin())
                if least[r] == NONE:
                    done = True
                    break
                at = int(rank[r].argmin())
                ids[r, at] = merged = rank[r, at]
                s, gone = (r, at + 1) if at + 1 < size[r] else (after[r], 0)
                ids[s, gone:-1], rank[s, gone:-1] = ids[s, gone + 1 :], rank[s, gone + 1 :]
                ids[s, -1], rank[s, -1] = -1, NONE
                size[s] -= 1
                left -= 1
                if not size[s]:
                    least[s] = NONE
                    if before[s] >= 0:
                        after[before[s]] = after[s]
                    if after[s] >= 0:
                        before[after[s]] = before[s]
                follow = ids[r, at + 1] if at + 1 < size[r] else ids[after[r], 0] if after[r] >= 0 else -1
                rank[r, at] = self._rank(int(merged), int(follow)) if follow >= 0 else NONE
                p, k = (r, at - 1) if at else (before[r], size[before[r]] - 1 if before[r] >= 0 else 0)
                if p >= 0:
                    rank[p, k] = self._rank(int(ids[p, k]), int(merged))
                for row in {r, s, p} - {-1}:
                    least[row] = rank[row].min()
            tokens = ids.ravel()[ids.ravel() >= 0]
            if done:
                return tokens

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """Ids of each text; none for null and for empty text. Lone surrogates count as U+FFFD."""
        split = [self.split(t) if t else [] for t in texts]
        known = self.known
        new = list({p for pieces in split for p in pieces if p not in known})
        if len(known) + len(new) > CACHE:
            known.clear()
            new = list({p for pieces in split for p in pieces})
        for p, ids in zip(new, self.encode_pieces([p.encode("utf-8", "replace") for p in new])):
            known[p] = ids
        empty = np.empty(0, np.int32)
        return [np.concatenate([known[p] for p in pieces]) if pieces else empty for pieces in split]


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``key`` and ``ids`` (array of int) of every row; an empty array for null and for empty text.

    The vocabulary (some 50,000 tokens, a fixed size) is read by the driver and sent to the workers. Rows are
    encoded where they are read: no shuffle. Repeated rows come out as often as they went in; other columns of
    any name are not read. An empty table gives an empty result.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(load_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                ids = encoder.encode(part.column(1).to_pylist())
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))], names=[key, "ids"])

    source = df.select(key, text)
    kind = source.schema[key].dataType.simpleString()
    return source.mapInArrow(run, f"`{key}` {kind}, ids array<int>")
