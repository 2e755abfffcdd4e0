"""Substring dedup by level-wise doubling.

The first level takes runs of a quarter of ``width`` words (9 of 35); only the run with the least hash
of each window is counted, which names the window (see :mod:`.repeats`). Windows whose run repeats are
read again and extended: their runs of twice that length (18) are named and counted, and of what survives
that the full ``width`` is compared, until no candidates survive. Each level hashes only what survived
the one before. At the full length, equal stretches of windows count as one string, and the rest are compared window by
window by hashes of 128 bits.

Words are [^\\x20\\x09-\\x0D]+, unchanged. Defined cases: null, empty and blank texts have no words;
texts shorter than a window lose none; repeated rows equal each other, so all their windows repeat;
matches inside one text count.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, record, texts, written
from .repeats import candidates, covered, in_batch, mix, rolling, with_lists

WIDTH = 35


def symbols(text: bytes | None) -> np.ndarray:
    words = text.split() if text else []
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def levels(width: int) -> list[int]:
    """Lengths from about a quarter of ``width`` on, each twice the one before, the last clipped."""
    out = [max(1, -(-width // 4))]
    while out[-1] < width:
        out.append(min(width, 2 * out[-1]))
    return out


def repeated_windows(docs: DataFrame, edges: DataFrame, width: int) -> DataFrame:
    """(doc_id, th, p, n = 1): windows of ``edges`` whose words occur again."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("p", pa.int32()), ("known", pa.bool_()), ("a", pa.int64()), ("b", pa.int64()), ("m", pa.int32()), ("multi", pa.bool_())])

    def run(batches):
        for b in cut(batches):
            cols = [[] for _ in range(6)]
            spans = b.column(3).to_pylist()
            for doc_id, th, text, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b), spans, strict=True):
                v = symbols(text)
                at = np.concatenate([np.arange(s["p"], s["p"] + s["n"]) for s in own])
                cols[0] += [doc_id] * len(at)
                cols[1] += [th] * len(at)
                cols[2].append(at.astype(np.int32))
                cols[3].append(np.concatenate([np.full(s["n"], s["known"]) for s in own]))
                cols[4].append(rolling(v, width)[at].view(np.int64))
                cols[5].append(rolling(mix(v + np.uint64(0x5851F42D4C957F2D)), width)[at].view(np.int64))
            if cols[0]:
                p, known, a, h = (np.concatenate(c) for c in cols[2:])
                yield record(schema, [cols[0], cols[1], *map(pa.array, (p, known, a, h, *in_batch(a, h)))])

    rows = with_lists(docs, edges, "inner", "p", "n", "known").mapInArrow(run, "doc_id long, th long, p int, known boolean, a long, b long, m int, multi boolean")
    rows = written(rows, "windows")
    again = rows.filter("m > 0").groupBy("a", "b").agg(F.sum("m").alias("times")).filter("times > 1").select("a", "b")
    open_ = rows.filter("not known")
    open_ = open_.filter("multi").select("doc_id", "th", "p").unionAll(open_.filter("not multi").join(again, ["a", "b"]).select("doc_id", "th", "p"))
    out = written(open_.withColumn("n", F.lit(1)), "repeated")
    discard(rows)
    return out


def spans(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, th, p, n): first window and number of windows that repeat."""
    whole, edges = candidates(docs, symbols, width, levels(width)[:-1] or [width])
    return whole.unionAll(repeated_windows(docs, edges, width))


def removed(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the words left, joined by one space)."""
    rows = with_lists(docs, spans(docs, width), "left", "p", "n")
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])

    def run(batches):
        for b in cut(batches):
            out = []
            for doc_id, text, own in zip(b.column(0).to_pylist(), texts(b), b.column(3).to_pylist(), strict=True):
                words = text.split() if text else []
                gone = covered(len(words), [(s["p"], s["n"]) for s in own or ()], width)
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if own else words)
                out.append((doc_id, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
            yield record(schema, list(zip(*out, strict=True)) or [[]] * 5)

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
