"""Personal data: fixed patterns, and a skip-chain conditional random field that adds to them.

Patterns give the base spans. The field's nodes are a document's base spans, whose labels are given,
and its other tokens that hold a digit or an @. Potentials join a node with its features, with the
next node (chain), and with distant nodes of the same or a similar value (skip): an address that is
known in one place pulls its repetitions along. Equal values are linked one occurrence to the next, and
every other mention to the first base span of its value and kind, so that evidence does not fade along
the links and edges stay linear in nodes. Repeated and similar tokens share one potential. Labels come from
loopy max-marginals of sum-product message passing over each document, until no message moves by more than
TOLERANCE. Weights are fitted by pseudo-likelihood on the nodes of a bounded sample of texts, with base
spans as labels; tokens that resemble a base span have no known label and are left out of the fit. The fit
is a maximum a posteriori one: the skip weight has a Gaussian prior of mean SKIP_PRIOR, as texts in which a
labelled value repeats are rare, and all other weights one of mean 0.
The field adds spans, never removes a base span, and never touches one.

Defined cases: null and empty texts have no spans; texts without digits and @ have no nodes; without
any training rows the field adds nothing; repeated rows get equal spans.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append, cut, fresh, sampled, texts

KINDS = ["email", "ip", "card", "phone"]
#: Texts, those with the least hash, whose nodes the weights are fitted on, and nodes taken of these.
SAMPLE_TEXTS, SAMPLE_NODES = 5_000, 20_000
#: Mean of the skip weight's prior, and the pull of the priors.
SKIP_PRIOR, PULL = 3.0, 1e-4
#: Message passing is damped; on the rare graphs where it swings for ever it ends after MOST_ROUNDS.
TOLERANCE, MOST_ROUNDS, ADD_ABOVE = 1e-4, 200, 0.6

_LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
_AT, _DOMAIN = re.compile("@"), re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
#: A match starts where a run of digits starts, as a match always ends where one ends.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD, _PHONE = re.compile(r"[0-9](?:[\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY, _TOKEN, _DIGITS = re.compile("[0-9@]"), re.compile(r"[^\x20\x09-\x0D]+"), re.compile("[0-9]")
_EDGE = ".,;:!?()[]{}<>\"'"

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(_DIGITS.findall(s))


def base_spans(text: str | None) -> list[Span]:
    """Spans of the fixed patterns, by kind as listed, then by start."""
    if not text:
        return []
    out: list[Span] = []
    end = 0
    for m in _AT.finditer(text):  # the local part is the run before an @, so long runs cost their length
        i = m.start()
        head = text[end:i]
        start = i - (len(head) - len(head.rstrip(_LOCAL)))
        if start < i and (d := _DOMAIN.match(text, i)):
            out.append(("email", start, d.end()))
            end = d.end()
        else:
            end = i + 1
    if not _DIGITS.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        d = only_digits(m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(only_digits(m[0])) <= 15]
    return out


def render(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


# --- the field ---------------------------------------------------------------------------------

LABELS = ["", *KINDS]
L = len(LABELS)
FEATURES = ["one", "at", "dot_after_at", "letters", "plus", "quad", "luhn", "group", "d0", "d1", "d4", "d7", "d9", "d16", "d20", "long"]


def node_features(s: str) -> list[float]:
    d = only_digits(s)
    n = len(d)
    at = s.find("@")
    bins = [n == 0, 1 <= n <= 3, 4 <= n <= 6, 7 <= n <= 8, 9 <= n <= 15, 16 <= n <= 19, n >= 20]
    return [1.0, at >= 0, at >= 0 and "." in s[at:], any(c.isalpha() for c in s), s.startswith("+"), s.count(".") == 3 and s.replace(".", "").isdigit(), 16 <= n <= 19 and luhn(d), "-" in s or "(" in s, *bins, len(s) > 40]


def keys(s: str) -> tuple[str, str]:
    """What equal tokens share, and what similar ones share (empty: nothing)."""
    low, d = s.lower(), only_digits(s)
    if "@" in low:
        return low, low.split("@")[0] + "@"
    if len(d) >= 7 and not any(c.isalpha() for c in low):
        return d, d[-7:]
    return low, ""


class Field:
    """Nodes and edges of one document."""

    def __init__(self, text: str, base: list[Span]):
        self.spans: list[tuple[int, int]] = []
        self.label: list[int] = []
        taken = sorted((a, b) for _, a, b in base)
        starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
        nodes = [(a, b, 1 + KINDS.index(k)) for k, a, b in base]
        for m in _TOKEN.finditer(text):
            if not _ANY.search(m[0]):
                continue
            a, b = m.span()
            before = bisect_left(starts, b)  # base spans that start before the token's end
            if before and reach[before - 1] > a:
                continue
            s = m[0]
            a += len(s) - len(s.lstrip(_EDGE))
            b -= len(s) - len(s.rstrip(_EDGE))
            if a < b:
                nodes.append((a, b, -1))
        nodes.sort()
        self.spans = [(a, b) for a, b, _ in nodes]
        self.label = np.array([k for _, _, k in nodes], np.int64)  # -1: not known
        said = [text[a:b] for a, b, _ in nodes]
        self.x = np.array([node_features(s) for s in said], float).reshape(len(nodes), len(FEATURES))
        same: dict[str, int] = {}
        like: dict[str, int] = {}
        edges: list[tuple[int, int, int]] = [(i, i + 1, 0) for i in range(len(nodes) - 1)]
        for i, s in enumerate(said):
            k, near = keys(s)
            if k in same:
                edges.append((same[k], i, 1))
            if near and near in like and like[near] != same.get(k):
                edges.append((like[near], i, 2))
            same[k] = i
            if near:
                like[near] = i
        # each mention of a labelled value hangs on the first base span of each kind of it, however many lie between
        equal: dict[str, dict[int, int]] = {}
        similar: dict[str, dict[int, int]] = {}
        for i in np.flatnonzero(self.label > 0).tolist():
            k, near = keys(said[i])
            equal.setdefault(k, {}).setdefault(int(self.label[i]), i)
            if near:
                similar.setdefault(near, {}).setdefault(int(self.label[i]), i)
        if equal:
            linked = {(i, j) for i, j, kind in edges if kind > 0}
            for i in np.flatnonzero(self.label < 0).tolist():
                k, near = keys(said[i])
                for kind, hubs in ((1, equal.get(k, {})), (2, similar.get(near, {}))):
                    for hub in hubs.values():
                        e = (min(i, hub), max(i, hub))
                        if e not in linked:
                            linked.add(e)
                            edges.append((*e, kind))
        self.edges = np.array(edges, np.int64).reshape(len(edges), 3)


def training_rows(text: str) -> list[tuple[int, list[float]]]:
    """(label, features then labels around) of nodes whose label is known."""
    f = Field(text, base_spans(text))
    n = len(f.label)
    if not n:
        return []
    skip = f.edges[f.edges[:, 2] > 0]
    touches = np.zeros(n, bool)
    for i, j in skip[:, :2].tolist():
        touches[i] |= f.label[j] > 0
        touches[j] |= f.label[i] > 0
    known = (f.label > 0) | ~touches
    y = np.maximum(f.label, 0)
    around = np.zeros((n, 4, L))
    for i, j, kind in f.edges.tolist():
        if kind > 0 and not (known[i] and known[j]):
            continue  # a mention without a known label says nothing for or against agreement
        around[j, 0 if kind == 0 else 1 + kind, y[i]] += 1
        around[i, 1 if kind == 0 else 1 + kind, y[j]] += 1
    return [(int(y[i]), [*f.x[i], *around[i].ravel()]) for i in np.flatnonzero(known)]


def fit(docs: DataFrame, sample_texts: int = SAMPLE_TEXTS, sample_nodes: int = SAMPLE_NODES) -> dict[str, np.ndarray] | None:
    """Weights: unary (L x features), chain (L x L), skip (one number)."""
    rows = docs.select(F.col("text").cast("string").alias("text")).filter(F.col("text").rlike("[0-9@]"))
    rows = sampled(rows, [F.col("text")], sample_texts).select(F.xxhash64("text").alias("h"), "text")

    def run(batches):
        for b in cut(batches):
            got = [(h, i, y, x) for h, t in zip(b.column(0).to_pylist(), texts(b), strict=True) for i, (y, x) in enumerate(training_rows(t.decode()))]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.int32()), pa.array([g[3] for g in got], pa.list_(pa.float64()))], names=["h", "i", "y", "x"])

    nodes = rows.mapInArrow(run, "h long, i int, y int, x array<double>")
    got = nodes.orderBy(F.xxhash64("h", "i"), "h", "i", "y").limit(sample_nodes).select("y", "x").toPandas()
    if not len(got):
        return None
    y, x = got["y"].to_numpy(), np.stack(got["x"].to_list())
    nf, n = len(FEATURES), len(y)
    feats, around = x[:, :nf], x[:, nf:].reshape(n, 4, L)
    skip = around[:, 2] + around[:, 3]
    w = {"unary": np.zeros((L, nf)), "chain": np.zeros((L, L)), "skip": np.full(1, SKIP_PRIOR)}
    mean = {k: v.copy() for k, v in w.items()}
    speed = {k: np.zeros_like(v) for k, v in w.items()}
    one = np.eye(L)[y]
    for _ in range(300):
        z = feats @ w["unary"].T + around[:, 0] @ w["chain"] + around[:, 1] @ w["chain"].T + skip * w["skip"]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        e = (one - p) / n
        grad = {"unary": e.T @ feats, "chain": around[:, 0].T @ e + e.T @ around[:, 1], "skip": np.array([(skip * e).sum()])}
        for k in w:
            speed[k] = 0.9 * speed[k] + grad[k] - PULL * (w[k] - mean[k])
            w[k] = w[k] + 0.5 * speed[k]
    return w


def marginals(f: Field, w: dict[str, np.ndarray]) -> np.ndarray:
    """Loopy sum-product over one document: probability of each label at each node."""
    unary = f.x @ w["unary"].T
    given = f.label > 0
    unary[given] = -1e9
    unary[given, f.label[given]] = 0.0
    belief = unary
    if len(f.edges):
        i, j, kind = f.edges.T
        pots = np.stack([w["chain"], np.eye(L) * w["skip"]])[np.minimum(kind, 1)]  # from i to j
        src, dst = np.concatenate([i, j]), np.concatenate([j, i])
        pot = np.concatenate([pots, pots.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(i)) + len(i), np.arange(len(i))])
        order = np.argsort(dst, kind="stable")
        first = np.searchsorted(dst[order], np.arange(len(unary)))
        some = np.bincount(dst, minlength=len(unary)) > 0
        msg = np.zeros((len(src), L))
        for _ in range(MOST_ROUNDS):
            belief = unary.copy()
            belief[some] += np.add.reduceat(msg[order], first[some], axis=0)
            out = (belief[src] - msg[back])[:, :, None] + pot
            top = out.max(1, keepdims=True)
            new = np.log(np.exp(out - top).sum(1)) + top[:, 0]
            new -= new.max(1, keepdims=True)
            # what lies this far below the best label can't matter, and would hide that the rest has settled
            new = np.maximum(new, -50.0)
            moved = np.abs(new - msg).max()
            msg = 0.5 * msg + 0.5 * new
            if moved < TOLERANCE:
                break
        belief = unary.copy()
        belief[some] += np.add.reduceat(msg[order], first[some], axis=0)
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def spans(text: str | None, w: dict[str, np.ndarray] | None) -> tuple[list[Span], list[Span]]:
    """(base spans, spans that the field adds)."""
    base = base_spans(text)
    if not text or w is None or not _ANY.search(text):
        return base, []
    f = Field(text, base)
    if not len(f.label) or (f.label > 0).all():
        return base, []
    p = marginals(f, w)
    best = p.argmax(1)
    return base, [(LABELS[best[i]], *f.spans[i]) for i in range(len(f.label)) if f.label[i] < 0 and best[i] > 0 and p[i, best[i]] > ADD_ABOVE]


def redact(text: str, found: list[Span]) -> str:
    """Each span becomes its kind in brackets; of overlapping spans the union becomes the first's."""
    out, end = [], 0
    for k, a, b in sorted(found, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"[{k.upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def with_spans(docs: DataFrame, w, text: str = "text") -> tuple[DataFrame, list[str]]:
    """``docs`` with base spans, all spans (both as rendered) and the redacted text; and these names."""
    sent = docs.sparkSession.sparkContext.broadcast(w)
    names = fresh(docs, "base", "spans", "redacted")

    def run(ts):
        base, every, red = [], [], []
        for t in ts:
            if t is None or not _ANY.search(s := t.decode()):
                base.append(""), every.append(""), red.append(t)
                continue
            b, more = spans(s, sent.value)
            base.append(render(b)), every.append(render(b + more))
            red.append(redact(s, b + more) if b or more else t)
        return [base, every, [None if r is None else r if isinstance(r, str) else r.decode() for r in red]]

    return append(docs, list(zip(names, ["string"] * 3, strict=True)), run, text), names


def personal(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def run(ts):
        got = [spans(t.decode() if t else None, sent.value) for t in ts]
        counts = [[sum(s[0] == k for s in b) for b, _ in got] for k in KINDS]
        return [*counts, [hashlib.sha256(render(b).encode()).hexdigest() for b, _ in got], [render(b + more) for b, more in got], [len(more) for _, more in got]]

    fields = [*((f"n_{k}", "long") for k in KINDS), ("base_sha256", "string"), ("spans", "string"), ("n_added", "long")]
    return append(docs.select("doc_id", "text"), fields, run).drop("text")
