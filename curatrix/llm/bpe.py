"""Byte-level BPE: encoding and decoding over length-bucketed padded numpy matrices.

Texts are cut by the tokenizer's pattern; the distinct pieces of a batch that were not met before go
into matrices, one per bucket of lengths, a row each, whatever their length. In every round each row
merges the pairs of its least rank, the leftmost first: all that leftmost-first merging would reach
before any other pair, or the leftmost alone where a merge would make a pair of still lower rank. Pairs
are looked up in an open-addressing hash table held in two arrays, and a compaction closes the gaps. Rows
that have no pair left are done and leave the matrix. A row's rounds are thus bounded by its distinct
ranks, not its length. Ids decode by concatenating the bytes of each id.

Defined cases: null and empty texts have no ids; bytes that are not UTF-8 can't occur in a string
column; equal rows get equal ids.
"""

import base64
import hashlib

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append, fresh

#: About how many bytes of pieces a worker remembers; beyond that it starts anew. Freed when a partition ends.
REMEMBERED = 96 << 20
#: Cells that a matrix has at most, unless one row alone is longer.
CELLS = 1 << 18
NONE = np.int32((1 << 31) - 1)


def load(path: str) -> dict[bytes, int]:
    """Bytes to rank, from a file of lines `base64 rank`."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Pairs:
    """(left id, right id) to the id of their concatenation: a hash table for whole arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        known, left, right, out = ranks, [], [], []
        for token, r in ranks.items():
            for i in range(1, len(token)):
                a, b = known.get(token[:i]), known.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), out.append(r)
        key = (np.array(left, np.int64) << 32) | np.array(right, np.int64)
        self.bits = max(4, int(np.ceil(np.log2(max(len(key), 1) * 4))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ids = np.full(1 << self.bits, NONE, np.int32)
        value, at = np.array(out, np.int32), self._home(key)
        while len(key):  # the first to claim a free slot has it, the others go one further
            free = self.keys[at] == -1
            slot, first = np.unique(np.where(free, at, -1), return_index=True)
            first = first[slot >= 0]
            self.keys[at[first]], self.ids[at[first]] = key[first], value[first]
            rest = np.ones(len(key), bool)
            rest[first] = False
            key, value, at = key[rest], value[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that each pair merges to, or NONE."""
        key = (left.astype(np.int64) << 32) | right
        out, at, todo = np.full(key.shape, NONE, np.int32), self._home(key), np.arange(key.size)
        while todo.size:
            found = self.keys[at]
            hit = found == key[todo]
            out[todo[hit]] = self.ids[at[hit]]
            on = ~hit & (found != -1)
            todo, at = todo[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.text_of = {r: str(r) for r in ranks.values()}
        self.single = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        if (self.single < 0).any():
            raise ValueError("a byte-level vocabulary has each single byte")
        self.ranks, self.pairs, self.split = ranks, Pairs(ranks), regex.compile(pattern)
        self.memory: dict[str, tuple[str, bytes, int]] = {}
        self.held = 0

    def _merge(self, ids: np.ndarray, ranks: np.ndarray, lens: np.ndarray, best: np.ndarray, hits: np.ndarray):
        """Rows after merging the pairs that start at ``hits``, and whether a pair of lower rank was made on the way."""
        rows, width = ids.shape
        made = np.where(hits, best[:, None], ids)
        keep = np.arange(width) < lens[:, None]
        keep[:, 1:] &= ~hits[:, :-1]
        left = lens - hits.sum(axis=1, dtype=np.int32)
        inside = np.arange(int(left.max())) < left[:, None]
        out_ids, out_ranks, fresh = np.full(inside.shape, -1, np.int32), np.full(inside.shape, NONE, np.int32), np.zeros(inside.shape, bool)
        out_ids[inside], out_ranks[inside], fresh[inside] = made[keep], ranks[keep], hits[keep]
        touched = fresh.copy()  # pairs that a merged id is part of
        touched[:, :-1] |= fresh[:, 1:]
        last = np.arange(rows), left - 1
        touched[last], out_ranks[last] = False, NONE
        r, c = np.nonzero(touched)
        out_ranks[r, c] = got = self.pairs(out_ids[r, c], out_ids[r, c + 1])
        lower = np.zeros(rows, bool)
        lower[r[got < best[r]]] = True
        # on the way, a merged id stands before the first half of the pair that is merged next
        r, c = np.nonzero(hits[:, :-2] & hits[:, 2:])
        lower[r[self.pairs(best[r], ids[r, c + 2]) < best[r]]] = True
        return out_ids, out_ranks, left, lower

    def _matrix(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of pieces of about one length."""
        lens = np.array([len(p) for p in pieces], np.int32)
        ids = np.full((len(pieces), int(lens.max())), -1, np.int32)
        inside = np.arange(ids.shape[1]) < lens[:, None]
        ids[inside] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = np.full(ids.shape, NONE, np.int32)  # of the pair that starts here
        whole = inside[:, 1:]
        ranks[:, :-1][whole] = self.pairs(ids[:, :-1][whole], ids[:, 1:][whole])
        out: list[list[int]] = [[]] * len(pieces)
        rows = np.arange(len(pieces))
        while True:
            best = ranks.min(axis=1)
            done = best == NONE
            if done.any():
                for row, n, got in zip(rows[done].tolist(), lens[done].tolist(), ids[done].tolist(), strict=True):
                    out[row] = got[:n]
                on = ~done
                rows, lens, best = rows[on], lens[on], best[on]
                if not rows.size:
                    return out
                width = int(lens.max())
                ids, ranks = ids[on, :width], ranks[on, :width]
            hits = ranks == best[:, None]
            if (hits[:, 1:] & hits[:, :-1]).any():  # of pairs that overlap, every second one from the left
                place = np.arange(hits.shape[1])
                before = np.maximum.accumulate(np.where(hits, -1, place), axis=1)
                hits &= (place - before) % 2 == 1
            new_ids, new_ranks, new_lens, lower = self._merge(ids, ranks, lens, best, hits)
            if lower.any():  # there only the leftmost pair is merged
                at = np.flatnonzero(lower)
                first = np.zeros((len(at), hits.shape[1]), bool)
                first[np.arange(len(at)), hits[at].argmax(axis=1)] = True
                one_ids, one_ranks, one_lens, _ = self._merge(ids[at], ranks[at], lens[at], best[at], first)
                more = one_ids.shape[1] - new_ids.shape[1]
                if more > 0:
                    new_ids, new_ranks = np.pad(new_ids, ((0, 0), (0, more)), constant_values=-1), np.pad(new_ranks, ((0, 0), (0, more)), constant_values=NONE)
                new_ids[at], new_ranks[at], new_lens[at] = -1, NONE, one_lens
                new_ids[at, : one_ids.shape[1]], new_ranks[at, : one_ranks.shape[1]] = one_ids, one_ranks
            ids, ranks, lens = new_ids, new_ranks, new_lens

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece: its own id where it has one, else by buckets of lengths up to a power of two."""
        out: list[list[int]] = [[]] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (whole := self.ranks.get(p)) is not None:
                out[i] = [whole]
            elif p:
                buckets.setdefault((len(p) + 3) >> 2 if len(p) <= 32 else 16 + len(p).bit_length(), []).append(i)
        for at in buckets.values():
            step = max(1, CELLS // max(len(pieces[i]) for i in at))
            for k in range(0, len(at), step):
                for i, ids in zip(at[k : k + step], self._matrix([pieces[j] for j in at[k : k + step]]), strict=True):
                    out[i] = ids
        return out

    def pieces(self, text: str) -> list[str]:
        return self.split.findall(text)

    def forget(self) -> None:
        self.memory, self.held = {}, 0

    def learn(self, pieces: set[str]) -> None:
        """Encode the pieces that are new and remember their ids, as text, and what these decode to."""
        if self.held > REMEMBERED:
            self.forget()
        new = [p for p in pieces if p not in self.memory]
        text_of, bytes_of = self.text_of, self.bytes_of
        for p, ids in zip(new, self.encode_pieces([p.encode() for p in new]), strict=True):
            self.memory[p] = said = (" ".join([text_of[i] for i in ids]), b"".join([bytes_of[i] for i in ids]), len(ids))
            self.held += 300 + 2 * len(p) + len(said[0]) + len(said[1])

    def encode(self, text: str) -> list[int]:
        cut = self.pieces(text)
        return [i for ids in self.encode_pieces([p.encode() for p in cut]) for i in ids]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def digests(self, texts: list[bytes | None]) -> tuple[list[int], list[str], list[str]]:
        n, ids, back = [], [], []
        cuts = [self.pieces(t.decode()) if t else [] for t in texts]
        self.learn(set().union(*cuts))
        for cut in cuts:
            got = [self.memory[p] for p in cut]
            said, made, counts = zip(*got, strict=True) if got else ((), (), ())
            n.append(sum(counts))
            ids.append(hashlib.sha256(" ".join(said).encode()).hexdigest())
            back.append(hashlib.sha256(b"".join(made)).hexdigest())
        return n, ids, back

    def encoded(self, texts: list[bytes | None]) -> list[list[int] | None]:
        return [None if t is None else self.encode(t.decode()) for t in texts]


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One for each worker process and vocabulary file, which every executor reads where it is installed."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(load(path), pattern)
    return _ENCODERS[path, pattern]


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def with_ids(docs: DataFrame, vocabulary: tuple[str, str] | None = None, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with the ids of each text (null: null), and that column's name."""
    path, pattern = vocabulary or default_vocabulary()
    (name,) = fresh(docs, "ids")
    return append(docs, [(name, "array<long>")], lambda ts: [encoder(path, pattern).encoded(ts)], text), name


def decoded(df: DataFrame, ids: str = "ids", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """``df`` with the texts that its ids stand for, in column `decoded`."""
    path, pattern = vocabulary or default_vocabulary()

    @F.pandas_udf("binary")
    def back(col: pd.Series) -> pd.Series:
        return col.map(lambda x: None if x is None else encoder(path, pattern).decode(x))

    (name,) = fresh(df, "decoded")
    return df.withColumn(name, back(F.col(ids)))


def tokenized(docs: DataFrame, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each whole text (null: empty)."""
    path, pattern = vocabulary or default_vocabulary()
    fields = [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    df = append(docs.select("doc_id", "text"), fields, lambda ts: encoder(path, pattern).digests(ts), after=lambda: encoder(path, pattern).forget())
    return df.drop("text")
