"""Quality rules: statistics of whole texts and learned decision lists.

:func:`statistics` adds the statistics of each text. :func:`learn` grows and prunes ordered rules,
each a conjunction of thresholds, by sequential covering (IREP: greedy growth by information gain on
two thirds of the labelled rows, pruning on the rest). :func:`verdict` writes the list as one ordered
Spark conditional expression, so that applying it stays inside Spark's generated code.

Defined cases: a null or blank text has no words, so its statistics are 0 and it fails the base rule.
Repeated rows get equal answers. Labels that are null, or that belong to no document, teach nothing;
a document that is labelled twice counts with both labels; of documents with one id the one with the least
counts teaches. Without labels the list is empty and the
base rule alone decides. Columns of the input never clash: only doc_id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import append, fresh, sampled

#: Labelled rows that a list is learned from: about those with the least hash of their doc_id and label.
SAMPLE_ROWS = 20_000
#: A learned rule must be right for this share of the rows held out for pruning, else it is not kept.
MIN_PRECISION, MIN_COVERED, MAX_RULES, MAX_CONDITIONS = 0.9, 5, 12, 4

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_lines"]
SYMBOLS, UPPER, MARKS = b"#*$%&|<>", bytes(range(65, 91)), b"!?"


def repeat_words(words: list[bytes], width: int = 3) -> int:
    """Words inside a window of ``width`` words that the text has twice or more."""
    n = len(words)
    if n <= width:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    key, span = ids[: n - width + 1], len(seen)
    for i in range(1, width):
        if span * len(seen) >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
            span = int(key.max()) + 1
        key, span = key * len(seen) + ids[i : n - width + 1 + i], span * len(seen)
    _, back, times = np.unique(key, return_inverse=True, return_counts=True)
    at = np.flatnonzero(times[back] > 1)
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge) > 0).sum())


def count(text: bytes | None) -> tuple[int, ...]:
    """The COUNTS of one text."""
    if not text:
        return (0,) * len(COUNTS)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    less = lambda drop: len(text) - len(text.translate(None, drop))
    return (len(words), len(b"".join(words).decode("utf-8", "replace")), less(SYMBOLS), len(lines) - len(set(lines)), repeat_words(words), less(UPPER), less(MARKS), len(lines))


def statistics(df: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``df`` with a long column for each of COUNTS, and the names that these columns got."""
    names = dict(zip(COUNTS, fresh(df, *COUNTS), strict=True))
    return append(df, [(n, "long") for n in names.values()], lambda ts: list(zip(*map(count, ts), strict=True)) or [[]] * len(COUNTS), text), names


def features(names: dict[str, str]) -> dict[str, Column]:
    """What rules put thresholds on: counts and shares that don't grow with a text's length."""
    c = {k: F.col(v).cast("double") for k, v in names.items()}
    per = lambda a, b: c[a] / F.greatest(c[b], F.lit(1.0))
    return {
        "n_words": c["n_words"], "mean_word": per("word_chars", "n_words"), "symbols_per_word": per("n_symbols", "n_words"), "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_share": per("n_repeat_words", "n_words"), "upper_share": per("n_upper", "word_chars"), "marks_per_word": per("n_marks", "n_words"), "words_per_line": per("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self, cols: dict[str, Column]) -> Column:
        return cols[self.feature] > self.threshold if self.above else cols[self.feature] <= self.threshold


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Adds the threshold with the most FOIL gain until the rule covers no good row."""
    rule: list[Condition] = []
    on = np.ones(len(bad), bool)
    while len(rule) < MAX_CONDITIONS:
        p, n = int((on & bad).sum()), int((on & ~bad).sum())
        if not p or not n:
            break
        best, base = (0.0, None), np.log2(p / (p + n))
        for f, v in x.items():
            cuts = np.unique(np.quantile(v[on], np.linspace(0, 1, 65)))
            cuts = (cuts[1:] + cuts[:-1]) / 2
            if not len(cuts):
                continue
            where = np.searchsorted(cuts, v[on], "left")  # rows with v <= cuts[i] have where <= i
            pos = np.cumsum(np.bincount(where[bad[on]], minlength=len(cuts) + 1))[:-1]
            neg = np.cumsum(np.bincount(where[~bad[on]], minlength=len(cuts) + 1))[:-1]
            for above, pp, nn in ((False, pos, neg), (True, p - pos, n - neg)):
                gain = np.where(pp > 0, pp * (np.log2(np.maximum(pp, 1) / np.maximum(pp + nn, 1)) - base), 0)
                i = int(gain.argmax())
                if gain[i] > best[0] + 1e-9:
                    best = (float(gain[i]), Condition(f, above, float(cuts[i])))
        if best[1] is None:
            break
        rule.append(best[1])
        on &= best[1].holds(x)
    return tuple(rule)


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The rule's start that is worth most, (p - n) / (p + n), on rows that it wasn't grown on."""

    def worth(r: Rule) -> float:
        on = _covers(r, x, len(bad))
        return (2 * (on & bad).sum() - on.sum()) / max(on.sum(), 1)

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=())


def cover(x: dict[str, np.ndarray], bad: np.ndarray, prune: np.ndarray) -> list[Rule]:
    """Sequential covering: rules for the bad rows, in the order in which they apply."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < MAX_RULES and (left & bad & ~prune).any():
        grow_on, prune_on = left & ~prune, left & prune
        rule = _grow({k: v[grow_on] for k, v in x.items()}, bad[grow_on])
        rule = _prune(rule, {k: v[prune_on] for k, v in x.items()}, bad[prune_on])
        on = _covers(rule, x, len(bad)) & left
        held = on & prune
        if not rule or held.sum() < MIN_COVERED or (held & bad).sum() < MIN_PRECISION * held.sum() or (on & bad).sum() < MIN_PRECISION * on.sum():
            break
        rules.append(rule)
        left &= ~on
    return rules


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules that tell documents labelled quality 0, from at most ``sample_rows`` labelled rows.

    The bound is also what makes the broadcast and the collected statistics small.
    """
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality is not null")
    chosen = sampled(chosen, [F.col("doc_id"), F.col("quality")], sample_rows)
    seen, names = statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id"))
    # of documents that share an id the one with the least counts teaches, so the bound on rows holds for any ids
    seen = seen.groupBy("doc_id", "quality").agg(F.min(F.struct(*names.values())).alias("s")).select("doc_id", "quality", "s.*")
    cols = features(names)
    rows = seen.select("doc_id", "quality", (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)) == 0).alias("prune"), *(c.alias(k) for k, c in cols.items())).toPandas()
    rows = rows.sort_values(list(rows.columns), kind="stable")
    return cover({k: rows[k].to_numpy(float) for k in cols}, rows["quality"].to_numpy() == 0, rows["prune"].to_numpy(bool))


def verdict(rules: list[Rule], names: dict[str, str]) -> tuple[Column, Column]:
    """(kept, rule): one conditional expression in the list's order; rule is its 1-based place, else null."""
    cols = features(names)
    out = F.lit(None).cast("int")
    for i in reversed(range(len(rules))):
        hit = F.lit(True)
        for c in rules[i]:
            hit = hit & c.column(cols)
        out = F.when(hit, F.lit(i + 1)).otherwise(out)
    return out.isNull(), out


def base_failed(names: dict[str, str]) -> Column:
    return (F.col(names["n_words"]) < 50) | (100 * F.col(names["n_repeat_words"]) > 50 * F.col(names["n_words"]))


def judged(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[str, str], Column, Column, Column]:
    """Documents with statistics, their names, and the columns base_failed, kept and rule."""
    rules = learn(docs, labels)
    df, names = statistics(docs)
    kept, rule = verdict(rules, names)
    return df, names, base_failed(names), ~base_failed(names) & kept, rule
