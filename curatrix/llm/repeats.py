"""Candidates for strings that repeat: the part that substring and suffix-array dedup share.

A text is a row of symbols (words or bytes). Every window of ``width`` symbols is named by the least
hash among its runs of ``base`` symbols, so equal windows have equal names wherever they stand.
Consecutive windows with one name are one *stretch*; a text has about 2 / (width - base + 2) stretches a
symbol, and these, not windows, are shuffled. A name that occurs once can't hold a repeated window
(unless the text repeats inside the stretch, which is checked). Windows that survive one ``base`` are
named anew by the next, longer one, until no base is left. Then stretches that are equal as a whole are
counted as one string: all their windows repeat. Only stretches whose name is shared but whose symbols are
not remain: *edges*, where a repeat starts or ends, which the operators compare window by window.

Nothing is capped: names, stretches and edges cover all texts. A name that a batch of texts has twice is
known to repeat, so its rows are not joined by it at all: a hot name brings one row of each batch to the
task that counts it, not one of each text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, record, texts, with_key, written

_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_RI = np.uint64(pow(int(_R), -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]))
        for i, r in enumerate((_R, _RI)):
            a = np.full(size, r, np.uint64)
            a[0] = 1
            _POWERS[i] = np.multiply.accumulate(a)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def rolling(v: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of k symbols."""
    up, down = powers(len(v))
    p = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v * up)])
    n = len(v) - k + 1
    return mix((p[k:] - p[:-k]) * down[:n])


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, by prefixes and suffixes of blocks."""
    n = len(a)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = a
    blocks = padded.reshape(-1, w)
    pre = np.minimum.accumulate(blocks, axis=1).ravel()
    suf = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suf[: n - w + 1], pre[w - 1 : n])


def stretches(v: np.ndarray, width: int, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, first window, number of windows, whether the name's run of symbols occurs twice inside)."""
    if len(v) < width:
        return (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 2, np.empty(0, bool))
    h = rolling(v, base)
    w = width - base + 1
    m = sliding_min(h, w)
    first = np.concatenate([[0], np.flatnonzero(m[1:] != m[:-1]) + 1])
    count = np.diff(np.append(first, len(m)))
    name = m[first]
    span = count + (w - 1)  # runs of base symbols that lie in a stretch
    start = np.cumsum(span) - span
    at = np.arange(int(span.sum())) + np.repeat(first - start, span)
    own = np.add.reduceat(h[at] == np.repeat(name, span), start, dtype=np.int64)
    return name, first, count, own > 1


def in_batch(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of a batch how many rows have its key if it is the first of them, else 0; and whether there are others."""
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys]) if len(order) > 1 else False
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(order)))
    lead, others = np.zeros(len(order), np.int32), np.empty(len(order), bool)
    lead[order[start]] = count
    others[order] = np.repeat(count > 1, count)
    return lead, others


STRETCH = "h long, sh long, doc_id long, th long, p int, n int, own boolean, m int, multi boolean, twin boolean"
_STRETCH = pa.schema([("h", pa.int64()), ("sh", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("p", pa.int32()), ("n", pa.int32()), ("own", pa.bool_()), ("m", pa.int32()), ("multi", pa.bool_()), ("twin", pa.bool_())])


def joined(spans: list[dict]) -> list[tuple[int, int]]:
    """(first window, number of windows) of spans, those that touch in one."""
    out: list[list[int]] = []
    for p, n in sorted((s["p"], s["n"]) for s in spans):
        if out and p <= out[-1][0] + out[-1][1]:
            out[-1][1] = max(out[-1][1], p + n - out[-1][0])
        else:
            out.append([p, n])
    return [(p, n) for p, n in out]


def found(rows: DataFrame, symbols, width: int, base: int, whole: bool) -> DataFrame:
    """Stretches of (doc_id, th, text), or of the windows in ``spans`` where there is such a column.

    symbols: the UTF-8 text to an array of one uint64 per symbol. whole: with a hash of each stretch's symbols.
    m: the batch's rows of a name, at the first of them; multi: the name repeats there; twin: so does the whole stretch.
    """
    some = "spans" in rows.columns

    def run(batches):
        for b in cut(batches):
            cols = [[], [], [], [], [], [], []]
            spans = b.column(3).to_pylist() if some else [None] * b.num_rows
            for doc_id, th, text, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b), spans, strict=True):
                v = symbols(text)
                for at, n in joined(own) if some else [(0, len(v) - width + 1)]:
                    part = v[at : at + n + width - 1]
                    name, first, count, twice = stretches(part, width, base)
                    if not len(name):
                        continue
                    sh = np.zeros(len(name), np.uint64)
                    if whole:
                        raw = memoryview(np.ascontiguousarray(part)).cast("B")
                        sh = np.fromiter((xxhash.xxh3_64_intdigest(raw[8 * a : 8 * (a + c + width - 1)]) for a, c in zip(first.tolist(), count.tolist(), strict=True)), np.uint64, len(name))
                    for col, got in zip(cols, (name.view(np.int64), sh.view(np.int64), None, None, first + at, count, twice), strict=True):
                        if got is not None:
                            col.append(got)
                    cols[2].append((doc_id, len(name)))
                    cols[3].append((th, len(name)))
            if cols[0]:
                key = [pa.array(np.repeat(np.array([0 if x is None else x for x, _ in c], np.int64), [n for _, n in c]), mask=np.repeat([x is None for x, _ in c], [n for _, n in c])) for c in cols[2:4]]
                h, sh, p, n, own = (np.concatenate(cols[i]) for i in (0, 1, 4, 5, 6))
                m, multi = in_batch(h)
                twin = in_batch(h, sh)[1] if whole else np.zeros(len(h), bool)
                yield record(_STRETCH, [pa.array(h), pa.array(sh), *key, pa.array(p.astype(np.int32)), pa.array(n.astype(np.int32)), *map(pa.array, (own, m, multi | own, twin))])

    return rows.mapInArrow(run, STRETCH)


def survivors(rows: DataFrame, symbols, width: int, base: int, whole: bool) -> DataFrame:
    """The stretches whose name occurs again, stored."""
    every = written(found(rows, symbols, width, base, whole), "named")
    keep = ["doc_id", "th", "p", "n", *(["h", "sh", "own", "twin"] if whole else [])]
    shared = every.filter("m > 0").groupBy("h").agg(F.sum("m").alias("times"), F.max("own").alias("inside")).filter("times > 1 or inside").select("h")
    out = written(every.filter("multi").select(*keep).unionAll(every.filter("not multi").join(shared, "h").select(*keep)), "stretches")
    discard(every)
    return out


def candidates(docs: DataFrame, symbols, width: int, bases: list[int], within: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(whole, edges), both in the shared folder; within: spans (doc_id, th, p, n) beyond which nothing is looked at.

    whole: (doc_id, th, p, n), stretches whose windows all repeat. edges: (h, doc_id, th, p, n, known),
    stretches to compare by window; known: its windows repeat in any case, but others may equal them.
    """
    rows, before = with_key(docs) if within is None else with_lists(docs, within, "inner", "p", "n"), None
    for base in bases[:-1]:
        left = survivors(rows, symbols, width, base, False)
        rows = with_lists(docs, left, "inner", "p", "n")
        if before is not None:
            discard(before)
        before = left
    some = survivors(rows, symbols, width, bases[-1], True)
    if before is not None:
        discard(before)
    kinds = some.groupBy("h", "sh").agg(F.count("*").alias("same"), F.min(F.struct("doc_id", "th", "p", "n", "own")).alias("one"))
    kinds = written(kinds, "kinds")
    span = ["doc_id", "th", "p", "n"]
    whole = some.filter("twin").select(*span).unionAll(some.filter("not twin").join(kinds.filter("same > 1").select("h", "sh"), ["h", "sh"]).select(*span))
    several = kinds.groupBy("h").agg(F.count("*").alias("kinds"), F.max("one.own").alias("inside")).filter("kinds > 1 or inside").select("h", "kinds")
    edges = kinds.join(several, "h").filter("kinds > 1 or (same = 1 and one.own)")
    return whole, edges.select("h", "one.doc_id", "one.th", "one.p", "one.n", (F.col("same") > 1).alias("known"))


def with_lists(docs: DataFrame, spans: DataFrame, how: str, *columns: str) -> DataFrame:
    """(doc_id, th, text, spans): a document's distinct rows of ``spans`` in one list, as it is in one row itself.

    Rows that repeat a document have equal spans, so the list grows with the text, not with the rows.
    """
    lists = spans.groupBy("doc_id", "th").agg(F.collect_set(F.struct(*columns)).alias("spans"))
    lists = lists.select(F.col("doc_id").alias("span_id"), F.col("th").alias("span_th"), "spans")
    keyed = with_key(docs)
    return keyed.join(lists, keyed.doc_id.eqNullSafe(lists.span_id) & (keyed.th == lists.span_th), how).select("doc_id", "th", "text", "spans")


def covered(n: int, spans: list[tuple[int, int]], width: int) -> np.ndarray:
    """Which of n symbols lie in a window of (first window, number of windows)."""
    edge = np.zeros(n + 1, np.int64)
    if spans:
        p, c = np.array(spans, np.int64).T
        np.add.at(edge, p, 1)
        np.add.at(edge, p + c - 1 + width, -1)
    return np.cumsum(edge)[:n] > 0
