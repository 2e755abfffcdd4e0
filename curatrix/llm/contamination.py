"""Benchmark decontamination over a distributed positional inverted index.

:func:`build_index` stores postings of training tokens in shards of whole documents: a row per shard,
with a sorted list of positions for each term. Documents lie one after the other, with a gap that no
phrase can bridge. All terms are indexed, so one index serves any test items. :func:`search` takes these to
the shards: windows of which the shard lacks a term are passed over at once, of the others the terms are
ordered by the length of their lists in the shard, and the lists, moved back by the term's offset, are
intersected from the rarest on, for many windows in one array. What is left are the exact places of the
windows. Proximity matches take the rarest term's places and look for all other terms around them.

A shard holds whole documents and each search looks at all shards, so a passage that a third of all
documents share costs no task more than its own documents do; nothing is shuffled but results.
Test items are sent to the executors as arrays of numbers, in blocks of at most BLOCK_BYTES of text.

Defined cases: null or wordless texts have no words, are not contaminated and match nothing; null
items and items without words are passed over; items with one id count once; repeated documents
each have a row; a null item_id is written as an empty string.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, texts, with_key, written

#: Words of one window; shorter items are one window.
WIDTH = 10
#: Words that close a shard, and the gap between its documents.
SHARD_WORDS, GAP = 1 << 20, 64
#: Test items are sent in blocks of so many bytes at most.
BLOCK_BYTES = 16 << 20

#: Lower-cases A-Z and turns every ASCII character that isn't a letter or digit into a blank, so that
#: split() gives the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of a lower-cased text.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class Windows:
    """Test items as arrays: each run of ``width`` words is a window; an item of fewer, but not none, is one."""

    def __init__(self, items: list[tuple[str, list[bytes]]], width: int):
        self.items = [item for item, _ in items]
        ids: dict[bytes, int] = {}
        lens = [len(own) for _, own in items]
        self.words = np.fromiter((ids.setdefault(w, len(ids)) for _, own in items for w in own), np.int32, sum(lens))
        self.terms = list(ids)
        first = np.cumsum([0, *lens])
        count = [max(1, n - width + 1) if n else 0 for n in lens]
        self.owner = np.repeat(np.arange(len(lens), dtype=np.int32), count)
        self.start = np.concatenate([np.arange(a, a + n) for a, n in zip(first, count, strict=False)] or [np.empty(0, np.int64)]).astype(np.int64)
        self.size = np.minimum(np.array(lens, np.int32)[self.owner], width) if lens else np.empty(0, np.int32)


_INDEX = pa.schema([("shard", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("hashes", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("firsts", pa.list_(pa.int64())), ("terms", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int64())), ("postings", pa.binary())])


def build_index(docs: DataFrame, gap: int = GAP) -> DataFrame:
    """Shards of ``docs`` (doc_id, text), stored in the shared folder, with postings of all their words.

    Postings are differences of sorted positions, 32 bits each.
    """

    def run(batches):
        ids: dict[bytes, int] = {}
        doc_ids, hashes, n_words, firsts, parts, at = [], [], [], [], [], 0

        def shard() -> pa.RecordBatch:
            term, place = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(term, kind="stable")
            term, place = term[order], place[order]
            kinds, starts = np.unique(term, return_index=True)
            delta = np.diff(place, prepend=0)
            delta[starts] = place[starts]
            sizes = np.diff(np.append(starts, len(term)))
            said = list(ids)  # numbered as they came, and each occurs
            row = (uuid.uuid4().hex, doc_ids, hashes, n_words, firsts, said, sizes.tolist(), delta.astype(np.uint32).tobytes())
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _INDEX, strict=True)], schema=_INDEX)

        for b in cut(batches):
            for doc_id, th, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b), strict=True):
                own = words(text)
                if doc_ids and at + len(own) > SHARD_WORDS:
                    yield shard()
                    doc_ids, hashes, n_words, firsts, parts, at = [], [], [], [], [], 0
                    ids = {}
                parts.append((np.fromiter((ids.setdefault(w, len(ids)) for w in own), np.int32, len(own)), np.arange(at, at + len(own), dtype=np.int64)))
                doc_ids.append(doc_id)
                hashes.append(th)
                n_words.append(len(own))
                firsts.append(at)
                at += len(own) + gap
        if doc_ids:
            yield shard()

    kind = "shard string, doc_ids array<long>, hashes array<long>, n_words array<long>, firsts array<long>, terms array<binary>, sizes array<long>, postings binary"
    return written(with_key(docs).mapInArrow(run, kind), "index")


#: A posting is one number, its term's place in the shard times TERM plus its position; they are sorted.
TERM = 1 << 33
#: Positions that are tried at once.
TRIED = 1 << 19


class Shard:
    """One row of the index: its postings in one sorted array."""

    def __init__(self, row: dict):
        self.doc_ids, self.n_words, self.firsts = row["doc_ids"], np.array(row["n_words"], np.int64), np.array(row["firsts"], np.int64)
        self.place_of = {t: i for i, t in enumerate(row["terms"])}
        self.sizes = np.array([*row["sizes"], 0], np.int64)  # the last: of a term that isn't here
        self.ends = np.cumsum(self.sizes)
        raw = np.frombuffer(row["postings"], np.uint32).astype(np.int64)
        total = np.cumsum(raw)
        first = (self.ends - self.sizes)[:-1]
        before = np.repeat(total[first] - raw[first], self.sizes[:-1]) if len(raw) else raw
        self.postings = np.repeat(np.arange(len(first)) * TERM, self.sizes[:-1]) + total - before

    def numbers(self, terms: list[bytes]) -> np.ndarray:
        none = len(self.sizes) - 1
        return np.fromiter((self.place_of.get(t, none) for t in terms), np.int64, len(terms))

    def at_or_after(self, key: np.ndarray) -> np.ndarray:
        """The first posting that is not less than each key; beyond the last one a number that none equals."""
        i = np.searchsorted(self.postings, key)
        return np.where(i < len(self.postings), self.postings[np.minimum(i, len(self.postings) - 1)], np.iinfo(np.int64).max) if len(self.postings) else np.full(len(key), np.iinfo(np.int64).max)

    def tries(self, terms: np.ndarray):
        """Rows of windows whose terms are all here, with the places of each row's rarest term, a part at a time."""
        rows = np.flatnonzero((self.sizes[terms] > 0).all(axis=1))
        order = np.argsort(self.sizes[terms[rows]], axis=1, kind="stable")
        count = self.sizes[terms[rows, order[:, 0]]]
        cuts = np.searchsorted(np.cumsum(count), np.arange(TRIED, int(count.sum()) + TRIED, TRIED)) + 1 if len(rows) else []
        a = 0
        for z in cuts:
            z = min(int(z), len(rows))
            if z <= a:
                continue
            n = count[a:z]
            at = np.repeat(np.arange(a, z), n)
            rare = terms[rows[a:z], order[a:z, 0]]
            i = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.ends[rare] - self.sizes[rare], n)
            yield rows[at], order[at], self.postings[i] % TERM
            a = z

    def exact(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, first position) of every occurrence of the phrases, one to a row of ``terms``."""
        out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for row, order, place in self.tries(terms):
            start = place - order[:, 0]
            for k in range(1, terms.shape[1]):
                key = terms[row, order[:, k]] * TERM + start + order[:, k]
                ok = (start + order[:, k] >= 0) & (self.at_or_after(key) == key)
                row, order, start = row[ok], order[ok], start[ok]
            out.append((row, start))
        return np.concatenate([r for r, _ in out]), np.concatenate([p for _, p in out])

    def doc(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.firsts, place, "right") - 1

    def near(self, terms: np.ndarray, span: int) -> set[tuple[int, int]]:
        """(row, document's place in the shard) where some ``span`` words of a document hold all of a row's terms."""
        out: set[tuple[int, int]] = set()
        for row, order, q in self.tries(terms):
            d = self.doc(q)
            low, high = np.maximum(self.firsts[d], q - span + 1), np.minimum(self.firsts[d] + self.n_words[d], q + span)
            for k in range(1, terms.shape[1]):
                t = terms[row, order[:, k]] * TERM
                ok = self.at_or_after(t + low) < t + high
                row, order, q, d, low, high = row[ok], order[ok], q[ok], d[ok], low[ok], high[ok]
            for r, at, doc, a, z in zip(row.tolist(), q.tolist(), d.tolist(), low.tolist(), high.tolist(), strict=True):
                if (r, doc) in out:
                    continue
                around = [self.postings[slice(*np.searchsorted(self.postings, (t * TERM + a, t * TERM + z)))] - t * TERM for t in set(terms[r].tolist())]
                # spans that hold the rarest term's place start at one of the terms' places
                starts = np.unique(np.concatenate(around))
                starts = starts[(starts <= at) & (starts > at - span)]
                if all_in(starts, around, span).any():
                    out.add((r, doc))
        return out


def all_in(starts: np.ndarray, around: list[np.ndarray], span: int) -> np.ndarray:
    """Which of the spans hold a place of each list."""
    ok = np.ones(len(starts), bool)
    for own in around:
        i = np.searchsorted(own, starts)
        ok &= (i < len(own)) & (own[np.minimum(i, len(own) - 1)] < starts + span)
    return ok


MATCHES = "shard string, doc int, doc_id long, th long, n_words long, starts array<long>, widths array<long>, items array<string>, near_items array<string>"
_MATCHES = pa.schema([("shard", pa.string()), ("doc", pa.int32()), ("doc_id", pa.int64()), ("th", pa.int64()), ("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("widths", pa.list_(pa.int64())), ("items", pa.list_(pa.string())), ("near_items", pa.list_(pa.string()))])


def _search(index: DataFrame, items: list[tuple[str, list[bytes]]], width: int, span: int | None) -> DataFrame:
    sent = index.sparkSession.sparkContext.broadcast(Windows(items, width))

    def run(batches):
        for b in cut(batches):
            for row in b.to_pylist():
                s, w = Shard(row), sent.value
                number = s.numbers(w.terms)[w.words]
                starts, widths, said, close = defaultdict(list), defaultdict(list), defaultdict(set), defaultdict(set)
                for size in np.unique(w.size).tolist():
                    own = np.flatnonzero(w.size == size)
                    for k in range(0, len(own), TRIED // width):
                        part = own[k : k + TRIED // width]
                        terms = number[w.start[part][:, None] + np.arange(size)]
                        rows, found = s.exact(terms)
                        docs = s.doc(found)
                        for d, r, p in zip(docs.tolist(), rows.tolist(), (found - s.firsts[docs]).tolist(), strict=True):
                            starts[d].append(p)
                            widths[d].append(size)
                            said[d].add(w.items[w.owner[part[r]]])
                        for r, d in s.near(terms, span) if span else ():
                            close[d].add(w.items[w.owner[part[r]]])
                n = len(s.doc_ids)
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(([row["shard"]] * n, list(range(n)), s.doc_ids, row["hashes"], row["n_words"], [starts[d] for d in range(n)], [widths[d] for d in range(n)], [sorted(said[d]) for d in range(n)], [sorted(close[d]) for d in range(n)]), _MATCHES, strict=True)], schema=_MATCHES)

    # a task holds one shard at a time
    return index.mapInArrow(run, MATCHES)


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES):
    """Test items in blocks that fit a broadcast: usually one, more where the table is large."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text")).filter("text is not null")
    size = rows.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0
    n = max(1, -(-int(size) // block_bytes))
    for i in range(n):
        got = rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i).collect()
        yield [(r["item"], own) for r in got if (own := words(r["text"].encode()))]


def search(index: DataFrame, items: DataFrame, width: int = WIDTH, span: int | None = None) -> DataFrame:
    """MATCHES of each indexed document: places of exact windows, their items, and items near.

    span: with it, near_items has the items of which some window has all its terms within that many words.
    """
    out = None
    for block in item_blocks(items):
        got = _search(index, block, width, span)
        out = got if out is None else out.unionByName(got)
    return out


def hits(n_words: int, starts: list[int], widths: list[int]) -> np.ndarray:
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, np.array(starts, np.int64), 1)
    np.add.at(edge, np.array(starts, np.int64) + np.array(widths, np.int64), -1)
    return np.cumsum(edge)[:n_words] > 0


def decontaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH, slop: int = 5) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; n_near_items counts the items of which
    a window's terms lie within ``width + slop`` words."""
    found = search(build_index(docs), items, width, width + slop)

    def run(batches):
        for b in cut(batches):
            rows = b.to_pylist()
            hit = [int(hits(r["n_words"], r["starts"], r["widths"]).sum()) if r["starts"] else 0 for r in rows]
            sha = [hashlib.sha256(",".join(sorted(set(r["items"]))).encode()).hexdigest() for r in rows]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), b.column(b.schema.get_field_index("n_words")), pa.array(hit, pa.int64()), pa.array([len(set(r["items"])) for r in rows], pa.int64()), pa.array(sha), pa.array([h > 0 for h in hit]), pa.array([len(set(r["near_items"])) for r in rows], pa.int64())], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near_items"])

    return merged(found).mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, n_near_items long")


def keep_clean(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` without the documents that hold a window of an item; every column as it was.

    Documents are told by id and text, null-safely, so of repeated rows all go or all stay.
    """
    keyed = docs.withColumns(dict(zip(names := fresh(docs, "key_id", "key_text"), (F.col("doc_id").cast("long"), F.xxhash64("text")), strict=True)))
    index = build_index(docs)
    bad = merged(search(index, items, width)).filter(F.size("starts") > 0).select(F.col("doc_id").alias("bad_id"), F.col("th").alias("bad_th")).distinct()
    return keyed.join(bad, keyed[names[0]].eqNullSafe(bad.bad_id) & (keyed[names[1]] == bad.bad_th), "left_anti").select(*docs.columns)


def merged(found: DataFrame) -> DataFrame:
    """One row per document, where a search took several blocks of items; else as it is."""
    if "Union" not in found._jdf.queryExecution().logical().toString():
        return found
    both = [F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "widths", "items", "near_items")]
    return found.groupBy("shard", "doc").agg(F.first("doc_id").alias("doc_id"), F.first("th").alias("th"), F.first("n_words").alias("n_words"), *both)
