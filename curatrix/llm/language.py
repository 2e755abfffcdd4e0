"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, runs of characters that aren't letters become one blank, and each n-gram of
1 to 3 characters is hashed into one of BUCKETS. Training counts n-grams of all training rows per
language, partition by partition, and adds the counts up in a table. The smoothed log-probability matrix
goes to the executors in blocks of LANGUAGES languages, whose size BUCKETS bounds: usually one block.
Scoring gathers a block's rows for a batch of texts at once and adds them up per text; with several blocks
each gives its best language and the logarithm of its sum, and Spark expressions join these.

Defined cases: a text that is null or has no letter is `und` with score 0, and so is every text where
no language was learned. Rows without a language or letters teach nothing. Ties go to the language that
sorts first. Repeated rows each count in training and get equal answers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import append, cut, fresh, texts, written

BUCKETS, SIZES, ALPHA = 1 << 16, (1, 2, 3), 0.5
#: Languages of one broadcast block of the matrix: 32 MB.
LANGUAGES = 128
#: Counts leave a training task in rows of so many buckets.
BLOCK = 4096
#: Characters that are hashed at once.
CHUNK = 1 << 20

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Of each code point, whether it is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def ngrams(batch: list[bytes | None], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every n-gram of a batch, the row that each is from, and which rows have letters.

    Each text is held between two blanks, so no n-gram spans texts.
    """
    low = [(t or b"").decode().lower() for t in batch]
    code = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    lens = np.array([len(x) + 1 for x in low], np.int64)
    row = np.repeat(np.arange(len(low), dtype=np.int32), lens)  # of a text's characters and the blank after it
    row = np.concatenate([[0], row]).astype(np.int32)[: len(code)]
    is_letter = letters()[code]
    has = np.bincount(row[is_letter], minlength=len(low)) > 0
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # of a run of other characters the first stays, as a blank
    keep[0] = True
    code, row = np.where(is_letter, code, 32)[keep].astype(np.uint64), row[keep]
    out, rows = [], []
    for n in SIZES:
        if len(code) < n:
            continue
        h = np.full(len(code) - n + 1, n, np.uint64)
        for i in range(n):
            h = (h ^ code[i : len(code) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        # a text is followed by a blank, so an n-gram that ends in a text's second character or later is its own,
        # and one that starts at the blank before a text counts with that text
        at = row[n - 1 :]
        whole = ((row[: len(h)] == at) | (code[: len(h)] == 32)) & (code[n - 1 :] != 32 if n == 1 else True)
        if n > 2:
            whole = whole & (code[1 : 1 + len(h)] != 32)
        out.append((h[whole] % np.uint64(buckets)).astype(np.int32))
        rows.append(at[whole])
    return np.concatenate(out) if out else np.empty(0, np.int32), np.concatenate(rows) if rows else np.empty(0, np.int32), has


def blocks(batch: list[bytes | None]):
    """Cuts a batch where CHUNK bytes are reached, so that arrays stay small; yields (first, texts)."""
    start, size = 0, 0
    for i, t in enumerate(batch):
        size += len(t or b"") + 1
        if size >= CHUNK:
            yield start, batch[start : i + 1]
            start, size = i + 1, 0
    if start < len(batch):
        yield start, batch[start:]


Model = list[tuple[list[str], np.ndarray]]


def train(docs: DataFrame, lang: str = "lang", text: str = "text", languages: int = LANGUAGES) -> Model:
    """Blocks of languages, in order, and their log-probabilities: buckets by languages, prior in the last row.

    Counts cover all rows of ``docs``; only sums per language and bucket reach the driver, a block at a time.
    """
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).filter("lang is not null and text is not null")

    def run(batches):
        sums: dict[str, np.ndarray] = {}

        def done():
            for x in sums:
                parts = [(i, sums[x][i : i + BLOCK].tolist()) for i in range(0, BUCKETS + 1, BLOCK)]
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(parts)), pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.list_(pa.int64()))], names=["lang", "first", "n"])

        for b in cut(batches):
            langs = b.column(0).to_pylist()
            for first, part in blocks(texts(b)):
                ids, at, has = ngrams(part)
                own = langs[first : first + len(part)]
                for x in sorted(set(own)):
                    if x not in sums and len(sums) >= languages:  # a task holds so many languages' sums at most
                        yield from done()
                        sums = {}
                    mine = np.array([y == x for y in own])
                    sums.setdefault(x, np.zeros(BUCKETS + 1, np.int64))
                    sums[x][:BUCKETS] += np.bincount(ids[mine[at]], minlength=BUCKETS)
                    sums[x][BUCKETS] += int((has & mine).sum())
        yield from done()

    parts = rows.mapInArrow(run, "lang string, first int, n array<long>")
    # added up element by element: a language and block has one row for each task
    summed = parts.select("lang", "first", F.posexplode("n").alias("i", "n")).filter("n > 0").groupBy("lang", (F.col("first") + F.col("i")).alias("bucket")).agg(F.sum("n").alias("n"))
    summed = written(summed, "ngram-counts")
    known = summed.groupBy("lang").agg(F.sum(F.when(F.col("bucket") < BUCKETS, F.col("n"))).alias("grams"), F.sum(F.when(F.col("bucket") == BUCKETS, F.col("n"))).alias("texts"))
    known = {r["lang"]: r["texts"] for r in known.filter("grams > 0 and texts > 0").collect()}
    names, every, model = sorted(known), sum(known.values()), []
    for k in range(0, len(names), languages):
        own = names[k : k + languages]
        place = {x: i for i, x in enumerate(own)}
        m = np.zeros((BUCKETS, len(own)))
        got = summed.filter((F.col("bucket") < BUCKETS) & F.col("lang").isin(*own)).toPandas()
        m[got["bucket"].to_numpy(), got["lang"].map(place).to_numpy()] = got["n"].to_numpy()
        grams = m + ALPHA
        prior = np.log(np.array([[known[x] for x in own]]) / every)
        model.append((own, np.concatenate([np.log(grams / grams.sum(0)), prior]).astype(np.float32)))
    return model


def score(batch: list[bytes | None], names: list[str], logp: np.ndarray) -> tuple[list, list, list]:
    """Each text's best language of a block, its log-probability, and the logarithm of the block's sum (null: no letters)."""
    preds, tops, sums = [], [], []
    for _, part in blocks(batch):
        ids, at, has = ngrams(part)
        total = np.stack([np.bincount(at, weights=logp[:BUCKETS, k][ids], minlength=len(part)) for k in range(len(names))], 1) + logp[BUCKETS]
        best, top = total.argmax(1), total.max(1)
        whole = top + np.log(np.exp(total - top[:, None]).sum(1))
        preds += [names[b] if h else None for b, h in zip(best, has, strict=True)]
        tops += [t if h else None for t, h in zip(top.tolist(), has, strict=True)]
        sums += [w if h else None for w, h in zip(whole.tolist(), has, strict=True)]
    return preds, tops, sums


def predict(docs: DataFrame, model: Model, text: str = "text") -> tuple[DataFrame, str, str]:
    """``docs`` with its texts' languages and the posterior probability of each, and the two names."""
    pred, prob = fresh(docs, "lang_pred", "score")
    df, steps = docs, []
    for names, logp in model:
        sent = docs.sparkSession.sparkContext.broadcast((names, logp))
        step = fresh(df, "block_lang", "block_top", "block_sum")
        df = append(df, list(zip(step, ("string", "double", "double"), strict=True)), lambda ts, sent=sent: score(ts, *sent.value), text)
        steps.append([F.col(c) for c in step])
    if not steps:
        return docs.select("*", F.lit("und").alias(pred), F.lit(0.0).alias(prob)), pred, prob
    top = F.greatest(*(t for _, t, _ in steps)) if len(steps) > 1 else steps[0][1]
    said = F.coalesce(*(F.when(t == top, x) for x, t, _ in steps), F.lit("und"))  # of equals the block that comes first
    share = 1 / sum((F.exp(s - top) for _, _, s in steps[1:]), F.exp(steps[0][2] - top))
    return df.select(*(F.col(c) for c in docs.columns), said.alias(pred), F.coalesce(share, F.lit(0.0)).alias(prob)), pred, prob


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from rows that aren't held out, predicted for all."""
    df, _, _ = predict(docs.select("doc_id", "text"), train(docs.filter(~held_out())))
    return df.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
