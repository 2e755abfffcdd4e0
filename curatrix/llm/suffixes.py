"""Suffix-array dedup: the difference-cover algorithm over buckets of candidate strings.

Bytes that can lie in a repeat are found first (see :mod:`.repeats`): whole stretches that occur twice
need no sorting, and the strings at the edges of repeats are dealt out by name, so that any two equal
windows of ``width`` bytes meet in one bucket. Each task packs buckets into texts of at most PACK bytes
and builds their suffix array: it sorts the triples of sampled positions (not divisible by 3), names
them, recurses on the names where these are not yet unique, sorts the other suffixes by first symbol
and sampled rank, merges both, and compares neighbours' first ``width`` bytes. A name whose strings
alone exceed PACK is dealt out anew by names of runs twice as long, its equal strings again counted as one,
until the strings of each name fit a task: at runs of ``width`` bytes a name has one string left.

Defined cases: null and empty texts have no bytes; texts shorter than a window lose none; matches never
cross documents, as strings never do; repeated rows equal each other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, record, texts, written
from .repeats import candidates, covered, mix, with_lists

WIDTH, BASE = 200, 48
#: Bytes whose suffixes one task sorts at once; positions and ranks must fit 21 bits.
PACK = 1 << 20

_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def symbols(text: bytes | None) -> np.ndarray:
    return _BYTE[np.frombuffer(text or b"", np.uint8)]


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of all suffixes of s, whose symbols are from 1 to 2^21 - 1."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: tuple(s[i:])), np.int64)
    pad = np.concatenate([s.astype(np.int64), np.zeros(3, np.int64)])
    # sort sampled triples: a dummy sample at n closes the positions that are 1 modulo 3
    one = np.arange(1, n + (n % 3 == 1), 3)
    two = np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    triple = (pad[sample] << 42) | (pad[sample + 1] << 21) | pad[sample + 2]
    order = np.argsort(triple, kind="stable")
    sorted_triples = triple[order]
    name = np.empty(len(sample), np.int64)
    name[order] = np.cumsum(np.concatenate([[1], sorted_triples[1:] != sorted_triples[:-1]]))
    if name.max() < len(sample):  # recurse on the names
        order = suffix_array(name)
    rank = np.zeros(n + 3, np.int64)
    by_rank = sample[order]
    rank[by_rank] = np.arange(1, len(sample) + 1)
    by_rank = by_rank[by_rank < n]
    # the other suffixes, by their first symbol and the rank of what follows
    zero = np.arange(0, n, 3)
    zero_key = (pad[zero] << 21) | rank[zero + 1]
    at = np.argsort(zero_key, kind="stable")
    zero, zero_key = zero[at], zero_key[at]
    # merge: how many sampled suffixes of either kind come before each of the others
    ones, twos = by_rank[by_rank % 3 == 1], by_rank[by_rank % 3 == 2]
    before = np.searchsorted((pad[ones] << 21) | rank[ones + 1], zero_key)
    before = before + np.searchsorted((pad[twos] << 42) | (pad[twos + 1] << 21) | rank[twos + 2], (pad[zero] << 42) | (pad[zero + 1] << 21) | rank[zero + 2])
    out = np.empty(n, np.int64)
    place = before + np.arange(len(zero))
    out[place] = zero
    rest = np.ones(n, bool)
    rest[place] = False
    out[rest] = by_rank
    return out


def repeated_starts(strings: list[bytes], width: int) -> list[np.ndarray]:
    """For each string, the starts of its windows of ``width`` bytes that occur again in any of them."""
    lens = np.array([len(x) for x in strings], np.int64)
    first = np.cumsum(lens + 1) - lens - 1
    text = np.zeros(int((lens + 1).sum()), np.int64)
    raw = np.zeros(len(text) + 8, np.uint8)
    inside = np.ones(len(text), bool)
    inside[first + lens] = False
    raw[: len(text)][inside] = np.frombuffer(b"".join(strings), np.uint8)
    text[inside] = raw[: len(text)][inside].astype(np.int64) + 1
    text[~inside] = 257 + np.arange(len(strings))  # each string ends in a symbol of its own
    left = np.repeat(lens, lens + 1) - (np.arange(len(text)) - np.repeat(first, lens + 1))
    sa = suffix_array(text)
    sa = sa[left[sa] >= width]
    # compare adjacent prefixes, eight bytes at a time, while they agree
    eight = np.zeros(len(text), np.uint64)
    for i in range(8):
        eight = (eight << np.uint64(8)) | raw[i : i + len(text)].astype(np.uint64)
    alive = np.arange(max(len(sa) - 1, 0))
    for i in [*range(0, width - 8, 8), width - 8] if width >= 8 else []:
        alive = alive[eight[sa[alive] + i] == eight[sa[alive + 1] + i]]
    if width < 8:
        for i in range(width):
            alive = alive[raw[sa[alive] + i] == raw[sa[alive + 1] + i]]
    hit = np.zeros(len(text), bool)
    hit[sa[alive]] = True
    hit[sa[alive + 1]] = True
    return [np.flatnonzero(hit[a : a + n]) for a, n in zip(first.tolist(), lens.tolist(), strict=True)]


_WINDOW = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("p", pa.int32()), ("n", pa.int32())])


def from_buckets(strings: DataFrame, width: int) -> DataFrame:
    """Repeated windows of (h, doc_id, th, p, known, s), bucket by bucket."""

    def run(batches):
        pack: list[tuple] = []
        size, last = 0, None

        def done() -> pa.RecordBatch:
            cols = [[], [], [], []]
            for (_, doc_id, th, p, known, _), at in zip(pack, repeated_starts([x[5] for x in pack], width), strict=True):
                if known or not len(at):
                    continue
                cut = np.flatnonzero(np.diff(at) != 1) + 1
                starts, ends = at[np.concatenate([[0], cut])], at[np.concatenate([cut - 1, [len(at) - 1]])]
                cols[0] += [doc_id] * len(starts)
                cols[1] += [th] * len(starts)
                cols[2] += (starts + p).tolist()
                cols[3] += (ends - starts + 1).tolist()
            return record(_WINDOW, cols)

        for b in cut(batches):
            for row in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if row[0] != last and size > PACK // 4:
                    yield done()
                    pack, size = [], 0
                last = row[0]
                pack.append(row)
                size += len(row[5]) + 1
        if pack:
            yield done()

    dealt = strings.repartition("h").sortWithinPartitions("h")
    return dealt.mapInArrow(run, "doc_id long, th long, p int, n int")


def spans(docs: DataFrame, width: int = WIDTH, base: int = BASE) -> DataFrame:
    """(doc_id, th, p, n): first window and number of windows that repeat."""
    schema = pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("p", pa.int32()), ("n", pa.int32()), ("known", pa.bool_()), ("s", pa.binary())])

    def strings_of(batches):
        for b in cut(batches):
            out = [(e["h"], doc_id, th, e["p"], e["n"], e["known"], text[e["p"] : e["p"] + e["n"] + width - 1]) for doc_id, th, text, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b), b.column(3).to_pylist(), strict=True) for e in own]
            yield record(schema, list(zip(*out, strict=True)) or [[]] * 7)

    out, within = None, None
    while True:
        whole, edges = candidates(docs, symbols, width, [base], within)
        strings = written(with_lists(docs, edges, "inner", "h", "p", "n", "known").mapInArrow(strings_of, "h long, doc_id long, th long, p int, n int, known boolean, s binary"), "edge-strings")
        large = strings.groupBy("h").agg(F.sum(F.octet_length("s") + 1).alias("size")).filter(F.col("size") > PACK).select("h")
        large = written(large if base < width else large.limit(0), "large-names")
        found = whole.unionAll(written(from_buckets(strings.join(large, "h", "left_anti").drop("n"), width), "repeated"))
        out = found if out is None else out.unionAll(found)
        if large.isEmpty():
            return out
        base, within = min(2 * base, width), strings.join(large, "h", "left_semi").select("doc_id", "th", "p", "n")


def removed(docs: DataFrame, width: int = WIDTH, base: int = BASE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left)."""
    rows = with_lists(docs, spans(docs, width, base), "left", "p", "n")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def run(batches):
        for b in cut(batches):
            out = []
            for doc_id, text, own in zip(b.column(0).to_pylist(), texts(b), b.column(3).to_pylist(), strict=True):
                text = text or b""
                gone = covered(len(text), [(s["p"], s["n"]) for s in own or ()], width)
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if own else text
                starts = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                out.append((doc_id, len(text), int(gone.sum()), starts, hashlib.sha256(kept).hexdigest(), kept))
            yield record(schema, list(zip(*out, strict=True)) or [[]] * 6)

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
