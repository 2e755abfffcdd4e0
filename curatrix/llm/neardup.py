"""b-bit MinHash near-duplicate groups, confirmed on full shingle sets.

1. Each text becomes its set of distinct word shingles, HASHES minima over the set, BANDS band keys made
   of ROWS minima each, and a signature that keeps BITS low bits of each minimum, packed into longs.
2. Texts with equal sets are one class; only classes are compared.
3. Classes that share a band key are candidates. A bucket never emits all its pairs: its members are held
   against one pivot. Packed signatures are compared by counting bits; the estimate, corrected for bits
   that agree by chance, drops pairs that are far (over five standard errors) below the threshold.
4. Pairs left are confirmed on full sets, streamed past their pivot's set. A pivot with many members is
   split into salted groups.
5. Confirmed links give components. For texts in buckets that still hold several components, shingles that
   no other such text has are counted. They bound what two texts can share: many texts are thereby known
   to have no link, and the member with the least share of them, the middle of its bucket, is the pivot
   of further rounds. What then remains is compared between components only, each pair in the first band
   that both have, by estimates from longer signatures and then on full sets. So a link is missed only if
   no band holds both texts: at a similarity of 0.75, 51 bands of 5 miss 1 in 10^6.

Defined cases: null, empty and blank texts have an empty set, n_shingles 0, and are linked with nothing;
texts of fewer than 5 words have their whole sequence as the one shingle; repeated rows are linked like
any equal texts, also where ids repeat or are null. component_id is the least non-null id; a row is kept
if its id equals that, null-safely.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, record, texts, with_key, written
from .graph import components

SIZE, PERCENT = 5, 75
HASHES, BANDS, ROWS, BITS = 256, 51, 5, 2
#: Five standard errors of the estimate at the threshold (0.0325 each): one link in 3 million is lost to it.
MARGIN = 0.165
#: Rounds with one pivot for each bucket, before pairs between components are compared in full.
PIVOT_ROUNDS = 3
#: Members that one salted group of a pivot has, about.
GROUP = 64

#: Minima of the longer signatures that texts get which are compared in full, and five standard errors of theirs.
WIDE_HASHES, WIDE_MARGIN = 2048, 0.0585

_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(0, 1 << 32, WIDE_HASHES, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, WIDE_HASHES, dtype=np.uint32)
_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def shingles(text: bytes | None, size: int = SIZE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a lower-cased text's word shingles."""
    words = text.lower().split() if text else []  # bytes.lower() changes A-Z only
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(w) - size + 1
    h = np.zeros(n, np.uint64)
    for i in range(size):
        h = mix(h ^ w[i : i + n]) * _STEP[i % len(_STEP)]
    return np.unique(mix(h))


def minima(h: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    low = mix(h * _STEP[0]).astype(np.uint32)
    out = np.full(hashes, 0xFFFFFFFF, np.uint32)
    step = (512 * HASHES) // hashes
    for i in range(0, len(low), step):
        x = np.multiply.outer(low[i : i + step], _A[:hashes])
        x += _B[:hashes]
        np.minimum(out, x.min(axis=0), out=out)
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    """64-bit keys, each of a band's minima and its number."""
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP[1]
    for i in range(ROWS):
        h = mix(h ^ m[i : BANDS * ROWS : ROWS].astype(np.uint64)) * _STEP[(i + 2) % 5]
    return mix(h).view(np.int64)


def packed(m: np.ndarray) -> np.ndarray:
    """BITS low bits of each (mixed) minimum, 64 / BITS to a long."""
    low = mix(m.astype(np.uint64) + np.uint64(1)) & np.uint64((1 << BITS) - 1)
    per = 64 // BITS
    return np.bitwise_or.reduce(low.reshape(-1, per) << (np.arange(per, dtype=np.uint64) * np.uint64(BITS)), axis=1).view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, th, n, set (128-bit hash of the sorted shingle hashes), sig, bands; one row per document."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("set", pa.binary()), ("sig", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for b in cut(batches):
            n, sets, sigs, bands = [], [], [], []
            for t in texts(b):
                h = shingles(t)
                n.append(len(h))
                sets.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                m = minima(h) if len(h) else None
                sigs.append(None if m is None else packed(m))
                bands.append(None if m is None else band_keys(m))
            yield record(schema, [b.column(0), b.column(1), n, sets, sigs, bands])

    return with_key(docs).mapInArrow(run, "doc_id long, th long, n long, set binary, sig array<long>, bands array<long>")


def differing(a: Column, b: Column) -> Column:
    """How many of the b-bit values that two longs hold are not equal."""
    x = a.bitwiseXOR(b)
    for k in range(1, BITS):
        x = x.bitwiseOR(F.shiftrightunsigned(x, k))
    return F.bit_count(x.bitwiseAND(F.lit(int("01" * 32, 2) if BITS == 2 else -1)))


def corrected(differ: Column, hashes: int) -> Column:
    """The share of equal b-bit values, corrected for those equal by chance."""
    chance = 2.0**-BITS
    return (1 - differ / hashes - chance) / (1 - chance)


def similarity(a: Column, b: Column) -> Column:
    """Estimate from packed signatures of HASHES minima, one term for each long."""
    differ = F.lit(0)
    for i in range(HASHES * BITS // 64):
        differ = differ + differing(F.get(a, F.lit(i)), F.get(b, F.lit(i)))
    return corrected(differ, HASHES)


def wide_similarity(a: Column, b: Column) -> Column:
    """The same for WIDE_HASHES minima, as a fold: one term for each long would make a plan of thousands of nodes."""
    return corrected(F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda total, x: total + x), WIDE_HASHES)


def confirmed(pairs: DataFrame, stored: DataFrame) -> DataFrame:
    """The pairs (pivot, nid) whose full sets reach the threshold.

    stored: (nid, text). A pivot's text comes first in each of its salted groups; members stream past it.
    ``pairs`` is written first, as it is read thrice.
    """
    pairs = written(pairs, "pairs")
    parts = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
    salted = pairs.join(parts, "pivot").select("pivot", F.pmod(F.xxhash64("nid"), F.col("parts")).cast("int").alias("salt"), "nid", F.lit(1).alias("turn"))
    firsts = parts.select("pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.col("pivot").alias("nid"), F.lit(0).alias("turn"))
    rows = salted.unionAll(firsts).join(stored, "nid").select("pivot", "salt", "turn", "nid", "text")
    schema = pa.schema([("pivot", pa.int64()), ("nid", pa.int64()), ("linked", pa.bool_())])

    def run(batches):
        at, base = None, None
        for b in cut(batches):
            out = []
            for pivot, salt, turn, nid, text in zip(*(b.column(i).to_pylist() for i in range(4)), texts(b), strict=True):
                if turn == 0:
                    at, base = (pivot, salt), shingles(text)
                elif at == (pivot, salt):
                    own = shingles(text)
                    both = len(np.intersect1d(base, own, assume_unique=True))
                    out.append((pivot, nid, 100 * both >= PERCENT * (len(base) + len(own) - both)))
                else:
                    raise AssertionError("a pivot comes before its members")
            yield record(schema, list(zip(*out, strict=True)) or [[], [], []])

    dealt = rows.repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "turn", "nid")
    return dealt.mapInArrow(run, "pivot long, nid long, linked boolean")


def private_counts(stored: DataFrame) -> DataFrame:
    """(nid, n, own): the size of each set, and how many of its shingles no other set of ``stored`` has."""
    schema = pa.schema([("nid", pa.int64()), ("h", pa.int64())])

    def run(batches):
        for b in cut(batches):
            for nid, text in zip(b.column(0).to_pylist(), texts(b), strict=True):
                h = shingles(text).view(np.int64)
                yield record(schema, [pa.array(np.full(len(h), nid, np.int64)), pa.array(h)])

    rows = stored.select("nid", "text").mapInArrow(run, "nid long, h long")
    each = rows.groupBy("h").agg(F.min("nid").alias("lo"), F.max("nid").alias("hi"))
    alone = each.filter("lo = hi").groupBy(F.col("lo").alias("nid")).agg(F.count("*").alias("own"))
    return stored.select("nid", "n").join(alone, "nid", "left").select("nid", "n", F.coalesce("own", F.lit(0)).alias("own"))


def wide_signatures(stored: DataFrame) -> DataFrame:
    """(nid, wide): signatures of WIDE_HASHES minima, for estimates with a third of the error."""
    schema = pa.schema([("nid", pa.int64()), ("wide", pa.list_(pa.int64()))])

    def run(batches):
        for b in cut(batches):
            yield record(schema, [b.column(0), [packed(minima(shingles(t), WIDE_HASHES)) for t in texts(b)]])

    return stored.select("nid", "text").mapInArrow(run, "nid long, wide array<long>")


def may_link(n: Column, own: Column, n2: Column, own2: Column) -> Column:
    """False only where two sets can't reach the threshold: what they share is in neither's own shingles."""
    return (100 + PERCENT) * F.least(n - own, n2 - own2) >= PERCENT * (n + n2)


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, th, n_shingles, component_id, class (nid; null: empty set), for every row of ``docs``."""
    seen = written(sketches(docs), "sketches")
    classes = seen.filter("n > 0").groupBy("set").agg(F.min_by(F.struct("doc_id", "th"), F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("rep"), F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("nid"), "set", "rep.doc_id", "rep.th", "least", "n", "sig", "bands"), "classes")
    banded = classes.select("nid", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("n"), F.min("nid").alias("pivot")).filter("n > 1").select("key", "pivot")
    banded = written(banded.join(shared, "key").select("key", "nid", "pivot"), "buckets")

    sigs = classes.select("nid", "sig")

    def pruned(pairs: DataFrame) -> DataFrame:
        """Of distinct (pivot, nid) those that the estimate leaves."""
        with_sig = pairs.join(sigs.select("nid", F.col("sig").alias("sig_m")), "nid").join(sigs.select(F.col("nid").alias("pivot"), F.col("sig").alias("sig_p")), "pivot")
        return with_sig.filter(similarity(F.col("sig_p"), F.col("sig_m")) >= PERCENT / 100 - MARGIN).select("pivot", "nid")

    members = banded.select("nid").distinct()
    which = classes.join(members, "nid").select("nid", "n", "doc_id", "th")
    keyed = with_key(docs)
    kept_texts = keyed.join(which.withColumnsRenamed({"doc_id": "rep_id", "th": "rep_th"}), keyed.doc_id.eqNullSafe(F.col("rep_id")) & (keyed.th == F.col("rep_th")))
    stored = written(kept_texts.select("nid", "n", "text").dropDuplicates(["nid"]), "candidate-texts")

    pairs = pruned(banded.filter("nid <> pivot").select("pivot", "nid").distinct())
    tried = written(confirmed(pairs, stored), "confirmed")
    comp = components(tried.filter("linked").select(F.col("pivot").alias("a"), F.col("nid").alias("b")))
    known = None
    for turn in range(1, PIVOT_ROUNDS + 1):
        named = banded.select("key", "nid").join(comp.select(F.col("node").alias("nid"), "root"), "nid", "left").select("key", "nid", F.coalesce("root", "nid").alias("root"))
        split = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
        named = written(named.join(split, "key"), "split")
        if named.isEmpty():
            break
        if known is None:
            known = written(private_counts(stored.join(named.select("nid").distinct(), "nid")), "private")
        # a text whose own shingles leave too few to share has no link, and needs no comparison
        named = named.join(known, "nid").filter(4 * F.col("own") <= F.col("n"))
        if turn < PIVOT_ROUNDS:
            # the member with the least share of own shingles is the middle of its bucket
            middle = F.struct(F.col("own") / F.col("n"), F.xxhash64("nid", F.lit(turn)) if turn > 1 else F.col("nid"))
            mid = named.groupBy("key").agg(F.min_by(F.struct("nid", "root", "n", "own"), middle).alias("p"))
            rows = named.join(mid, "key").filter((F.col("root") != F.col("p.root")) & may_link(F.col("n"), F.col("own"), F.col("p.n"), F.col("p.own")))
            pairs = pruned(rows.select(F.least("p.nid", "nid").alias("pivot"), F.greatest("p.nid", "nid").alias("nid")).distinct())
        else:
            # a pair is compared in the first band that both share, not in each, and only where roots still differ
            open_ = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
            named = written(named.join(open_, "key"), "open")
            whole = named.groupBy("nid").agg(F.sort_array(F.collect_set("key")).alias("keys"))
            wide = written(wide_signatures(stored.join(whole.select("nid"), "nid")).join(whole, "nid"), "wide")
            rows = named.join(wide, "nid")
            close = wide_similarity(F.col("p.wide"), F.col("m.wide")) >= PERCENT / 100 - WIDE_MARGIN
            may = may_link(F.col("p.n"), F.col("p.own"), F.col("m.n"), F.col("m.own"))
            first = F.col("p.key") == F.array_min(F.array_intersect("p.keys", "m.keys"))
            both = rows.alias("p").join(rows.alias("m"), (F.col("p.key") == F.col("m.key")) & (F.col("p.root") < F.col("m.root")) & may & first & close)
            pairs = both.select(F.least("p.nid", "m.nid").alias("pivot"), F.greatest("p.nid", "m.nid").alias("nid"))
        done = tried.select(F.least("pivot", "nid").alias("pivot"), F.greatest("pivot", "nid").alias("nid"))
        new = written(confirmed(pairs.join(done, ["pivot", "nid"], "left_anti"), stored), "confirmed")
        tried = tried.unionAll(new)
        if not new.filter("linked").isEmpty():
            links = new.filter("linked").select(F.col("pivot").alias("a"), F.col("nid").alias("b"))
            comp = components(comp.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(links))
    roots = classes.select("nid", "set", "least").join(comp.withColumnRenamed("node", "nid"), "nid", "left").withColumn("root", F.coalesce("root", "nid"))
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.join(least, "root").select("set", "nid", "root", "component_id")
    out = seen.select("doc_id", "th", "n", "set").join(named, "set", "left")
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.col("nid").alias("class"), "root")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    got = grouped(docs)
    return got.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_representatives(docs: DataFrame) -> DataFrame:
    """Of each group the document with the least id, every column as it was; of repeated rows one stays.

    Texts without words are groups of their own and all stay. Where one id has several linked texts, the
    text with the least hash stays.
    """
    got = written(grouped(docs), "groups")
    best = got.filter("n_shingles > 0").groupBy("root").agg(F.min_by(F.struct("doc_id", "th"), F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("k"))
    stays = best.select("k.doc_id", "k.th").unionAll(got.filter("n_shingles = 0").select("doc_id", "th")).distinct()
    names = fresh(docs, "key_id", "key_hash")
    keyed = docs.withColumns({names[0]: F.col("doc_id").cast("long"), names[1]: F.xxhash64("text")})
    stays = stays.select(F.col("doc_id").alias("stay_id"), F.col("th").alias("stay_th"))
    out = keyed.join(stays, keyed[names[0]].eqNullSafe(stays.stay_id) & (keyed[names[1]] == stays.stay_th), "left_semi")
    if not got.filter("n_shingles > 0").groupBy("doc_id", "th").count().filter("count > 1").isEmpty():
        some = out.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).dropDuplicates(names)
        out = some.unionAll(out.filter(~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))))
    return out.select(*docs.columns)
