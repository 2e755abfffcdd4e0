"""Language, quality, personal data, contamination and token ids against brute force, and odd inputs."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import pytest

from curatrix.llm import bpe, contamination, language, pii, quality, queries

ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "one two three"), (4, "a " * 3000), (4, "a " * 3000), (5, "x" * 20000), (6, "日本語 текст ça va 🙂"), (7, "1.2.3.4 " * 300)]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", 0, 1) for i, t in ODD], "doc_id long, text string, lang string, n_words int, Score int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_quality_counts(spark, sf_dir, docs):
    rows = queries.op7_quality_rules(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        t = docs[r["doc_id"]]
        w = words(t)
        lines = [x for x in t.split("\n") if words(x)]
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        rep = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep))
        failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_quality_learns_and_keeps_clean(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op7_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in got}
    assert n.get((1, False), 0) <= 0.02 * n[1, True]
    assert n.get((0, False), 0) >= 0.5 * (n.get((0, False), 0) + n.get((0, True), 0))


def test_quality_odd(spark, odd, empty):
    labels = spark.createDataFrame([(4, None), (None, 0), (99, 0)], "doc_id long, quality int")
    df, names, failed, kept, _ = quality.judged(odd, labels)
    rows = df.select("doc_id", failed.alias("f"), kept.alias("k"), df[names["n_words"]].alias("n")).collect()
    assert len(rows) == len(ODD) and {r["n"] for r in rows if r["doc_id"] in (1, 2, 3)} == {0} and all(r["f"] != r["k"] for r in rows)
    assert quality.judged(empty, labels.limit(0))[0].count() == 0
    assert odd.columns == df.columns[: len(odd.columns)]


def test_language(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op2_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_ngrams_by_hand():
    ids, at, has = language.ngrams([b"Ab,, c1", None, b"..ab", b"42"])
    one, _, _ = language.ngrams([b"..ab"])
    assert has.tolist() == [True, False, True, False]
    # " ab c ": 3 letters; pairs " a" "ab" "b " " c" "c "; triples " ab" "ab " " c "
    assert Counter(at.tolist()) == {0: 3 + 5 + 3, 2: 2 + 3 + 2}
    assert sorted(ids[at == 2].tolist()) == sorted(one.tolist())


def brute_language(rows):
    """Multinomial naive Bayes in plain Python over the same hashed n-grams, one text at a time."""
    grams = lambda t: Counter(language.ngrams([t.encode()])[0].tolist())
    has = lambda t: any(c.isalpha() for c in t or "")
    sums, texts = {}, Counter()
    for lang, t in rows:
        if lang is not None and has(t):
            sums.setdefault(lang, Counter()).update(grams(t))
            texts[lang] += 1

    def predict(t):
        if not has(t) or not texts:
            return "und", 0.0
        total = {}
        for lang in sorted(sums):
            every = sum(sums[lang].values()) + language.ALPHA * language.BUCKETS
            total[lang] = math.log(texts[lang] / sum(texts.values())) + sum(n * math.log((sums[lang][g] + language.ALPHA) / every) for g, n in grams(t).items())
        best = max(sorted(total), key=lambda x: total[x])
        return best, 1 / sum(math.exp(v - total[best]) for v in total.values())

    return predict


def test_language_against_plain(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").collect()[:250]
    df = spark.createDataFrame(rows)
    predict = brute_language([(r["lang"], r["text"]) for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2])
    text = {r["doc_id"]: r["text"] for r in rows}
    for r in language.identified(df).collect():
        want, score = predict(text[r["doc_id"]])
        assert r["lang_pred"] == want and abs(r["score"] - score) < 1e-2


def test_many_languages(spark):
    """More languages than a block holds: blocks give the result of one matrix."""
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("abcdefgh"[k % 4 : k % 4 + 4] + "  ") for _ in range(60)), f"l{k:03d}") for i, k in enumerate(k for k in range(600) for _ in range(2))]
    df = spark.createDataFrame([*rows, (-1, "42", None)], "doc_id long, text string, lang string")
    few = df.filter("lang < 'l040' or lang is null")
    for frame, size in ((few, 7), (few, 200)):
        got, pred, prob = language.predict(frame, language.train(frame, languages=size))
        one = {r["doc_id"]: (r[pred], round(r[prob], 4)) for r in got.collect()}
        if size == 7:
            seven = one
    assert one == seven and one[-1] == ("und", 0.0)
    model = language.train(df)
    assert [len(names) for names, _ in model] == [128, 128, 128, 128, 88]


def test_language_odd(spark, odd, empty):
    rows = language.identified(odd).collect()
    assert len(rows) == len(ODD) and all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in rows if r["doc_id"] in (1, 2, 3, 7))
    assert {r["lang_pred"] for r in rows} == {"und", "en"}
    assert language.identified(empty).count() == 0


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(t):
    d = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 16 <= len(d(m[0])) <= 19 and pii.luhn(d(m[0]))]
    out += [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(d(m[0])) <= 15]
    return out


TRICKY = ["a@b a@b.c.d@e.f @x.y q@", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 1.2.3", "4111 1111-1111 1111 4111111111111111 4111111111111112", "+1 (202) 555-0100, +12 +123456789012345678 ++44 20 7946 0958", "me.x%y+z@mail-1.example.co.uk.", "a..@b.c-.d @@ a@@b.c x@y.z@w.v", "١٢٣.1.1.1 ok@ex.com"]


def test_base_spans(docs):
    for t in [*TRICKY, *docs.values()]:
        assert pii.base_spans(t) == brute_spans(t)


def test_pii_query(spark, sf_dir, docs):
    for r in queries.op6_pii(spark, sf_dir).collect():
        base = brute_spans(docs[r["doc_id"]])
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(sum(s[0] == k for s in base) for k in pii.KINDS)
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert set(filter(None, said.split(","))) <= set(filter(None, r["spans"].split(",")))


def test_field_follows_repetitions(spark):
    sf = "/root/testdata/sf0.01"
    w = pii.fit(spark.read.parquet(f"{sf}/documents.parquet"))
    text = "Call +1 (202) 555-0147 now. There is a lot between the two of them, and then 202-555-0147 again, in 1987 or 42."
    base, more = pii.spans(text, w)
    assert base == [("phone", 5, 22)] and [text[a:b] for _, a, b in more] == ["202-555-0147"]
    assert pii.spans("In 1987, 42 of 300 came at 12:30 for 1,200 each.", w) == ([], [])
    assert pii.redact(text, base + more) == "Call [PHONE] now. There is a lot between the two of them, and then [PHONE] again, in 1987 or 42."


def test_field_reaches_every_mention():
    for lean in (0.0, 1.0):  # a unary towards 'no entity', and the least weights of skip edges
        unary = pii.np.zeros((pii.L, len(pii.FEATURES)))
        unary[0, 0] = lean
        w = {"unary": unary, "chain": pii.np.zeros((pii.L, pii.L)), "skip": pii.np.array([pii.SKIP_PRIOR])}
        for base, said, kind in (("+1 555 010 4477", "555-010-4477", "phone"), ("jo@mail.example", "jo@mail", "email")):
            for text in (f"By {base} now" + f" then {said} and on" * 30, f"then {said} and on " * 30 + f"by {base} now"):
                got, more = pii.spans(text, w)
                assert [s[0] for s in got] == [kind] and [(k, text[a:b]) for k, a, b in more] == [(kind, said)] * 30
                f = pii.Field(text, got)
                assert len(f.edges) <= 3 * len(f.label) and len(set(map(tuple, f.edges[f.edges[:, 2] > 0, :2].tolist()))) == (f.edges[:, 2] > 0).sum()
        assert pii.spans("By +1 555 010 4477 now, then 555-010-9999 and 42.", w)[1] == []


def exact_marginals(f, w):
    """All labellings of the nodes whose label isn't given."""
    unary = f.x @ w["unary"].T
    free = [i for i in range(len(f.label)) if f.label[i] < 0]
    out = pii.np.zeros((len(f.label), pii.L))
    for said in itertools.product(range(pii.L), repeat=len(free)):
        y = f.label.copy()
        y[free] = said
        score = unary[pii.np.arange(len(y)), y].sum()
        score += sum(w["chain"][y[i], y[j]] if kind == 0 else w["skip"][0] * (y[i] == y[j]) for i, j, kind in f.edges.tolist())
        out[pii.np.arange(len(y)), y] += math.exp(score)
    return out / out.sum(1, keepdims=True)


def test_marginals_against_enumeration():
    rng = pii.np.random.default_rng(5)
    texts_ = ["at 12 of 300 on 1987", "+1 555 010 4477 or 42", "x@y.zz and x@y then 7", "+1 555 010 4477 then 555-010-4477 and 555-010-4477 or 9", "1 2 3 4 5"]
    worst = 0.0
    for t in texts_:
        f = pii.Field(t, pii.base_spans(t))
        for _ in range(5):
            w = {"unary": rng.normal(0, 0.5, (pii.L, len(pii.FEATURES))), "chain": rng.normal(0, 0.5, (pii.L, pii.L)), "skip": pii.np.array([3.0])}
            off = pii.np.abs(pii.marginals(f, w) - exact_marginals(f, w)).max()
            if not (f.edges[:, 2] > 0).any():
                assert off < 1e-3  # without loops the messages are exact
            worst = max(worst, off)
    assert worst < 0.25


def test_spans_against_enumeration(spark, docs):
    """What the field adds, by enumeration instead of messages, in the given texts with few free nodes."""
    w, seen = pii.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")), 0
    for t in [*docs.values(), "Call +1 (202) 555-0147 or 202-555-0147, in 42.", "a@b.cc then a@b or 12"]:
        f = pii.Field(t, pii.base_spans(t))
        if not 0 < (f.label < 0).sum() <= 6:
            continue
        p, (base, more), seen = exact_marginals(f, w), pii.spans(t, w), seen + 1
        best = p.argmax(1)
        sure = [i for i in range(len(f.label)) if f.label[i] < 0 and abs(p[i].max() - pii.ADD_ABOVE) > 0.1]
        want = {(pii.LABELS[best[i]], *f.spans[i]) for i in sure if best[i] > 0 and p[i, best[i]] > pii.ADD_ABOVE}
        assert base == pii.base_spans(t) and want <= set(more) and not {f.spans[i] for i in sure if best[i] == 0} & {s[1:] for s in more}
    assert seen >= 5


def test_many_spans_before_a_token():
    """A token that a base span covers is no node, however many spans start between."""
    t = "+1 (2 3.4.5.6 3.4.5.6 3.4.5.6 3.4.5.6 3.4.5.6 3.4.5.6 3.4.5.6 3.4.5.6 3.4.5.6 3.4.5.6) 7"
    base = pii.base_spans(t)
    f = pii.Field(t, base)
    assert all(f.label[i] > 0 or not any(x < b and y > a for _, x, y in base) for i, (a, b) in enumerate(f.spans))


def test_sampled(spark):
    from curatrix.llm.common import sampled

    df = spark.range(20000).selectExpr("if(id < 7000, 0, id) AS k", "id")
    for n in (100, 50000):
        got = [r["k"] for r in sampled(df, [df.k], n).collect()]
        assert len(got) == len(set(got)) and (50 <= len(got) <= 100 if n == 100 else len(got) == 13001)


def test_no_session_setting_changes(spark, sf_dir):
    before = {r["key"]: r["value"] for r in spark.sql("SET").collect()}
    for name, f in queries.QUERIES.items():
        f(spark, sf_dir).limit(1).collect()
    assert {r["key"]: r["value"] for r in spark.sql("SET").collect()} == before


def test_pii_odd(spark, odd, empty):
    rows = pii.personal(odd).collect()
    assert len(rows) == len(ODD) and [r["n_ip"] for r in rows if r["doc_id"] == 7] == [300]
    assert pii.personal(empty).count() == 0
    df, names = pii.with_spans(odd, None)
    assert [r[names[2]] for r in df.collect() if r["doc_id"] == 1] == [None]


def brute_hits(t, items, width=10):
    word = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
    w, hit, found = word(t), set(), set()
    at = {}
    for i, x in enumerate(w):
        at.setdefault(x, []).append(i)
    for item, own in items:
        own = word(own)
        for win in [own[i : i + width] for i in range(max(1, len(own) - width + 1))] if own else []:
            for i in at.get(win[0], []):
                if w[i : i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_contamination(spark, sf_dir, docs):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = queries.op8_decontamination(spark, sf_dir).collect()
    assert len(rows) == len(docs) and any(r["contaminated"] for r in rows)
    for r in rows:
        assert tuple(r[c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) == brute_hits(docs[r["doc_id"]], items)
        assert r["n_near_items"] >= r["n_items"]


def test_contamination_odd(spark, odd, empty, monkeypatch):
    items = spark.createDataFrame([(1, "A a"), (2, None), (2, ""), (None, "three"), (3, "a " * 12), (3, "日本語 ТЕКСТ"), (4, "two three one")], "item_id long, text string")
    whole = sorted(map(str, contamination.decontaminated(odd, items).drop("n_near_items").collect()))
    plain = [(("" if r["item_id"] is None else r["item_id"]), r["text"]) for r in items.collect()]
    rows = contamination.decontaminated(odd, items).collect()
    assert sorted(map(str, [tuple(r)[1:6] for r in rows])) == sorted(str(brute_hits(t, plain)) for _, t in ODD)
    monkeypatch.setattr(contamination, "item_blocks", lambda it, f=contamination.item_blocks: f(it, 100))
    monkeypatch.setattr(contamination, "SHARD_WORDS", 50)
    assert sorted(map(str, contamination.decontaminated(odd, items).drop("n_near_items").collect())) == whole
    assert contamination.decontaminated(empty, items).count() == 0
    assert {r["n_hit"] for r in contamination.decontaminated(odd, items.limit(0)).collect()} == {0}


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x c y a z b w"), (2, "a q q q q q q q b c"), (3, "c b a")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "a b c")], "item_id long, text string")
    for span, want in ((3, {3}), (5, {1, 3}), (10, {1, 2, 3})):
        got = contamination.search(contamination.build_index(docs), items, 10, span).collect()
        assert {r["doc_id"] for r in got if r["near_items"]} == want and not any(r["items"] for r in got)


def test_proximity_against_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.choice([0, 1, 4, 30, 60])))) for i in range(40)]
    items = [(k, " ".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 2, 3, 5])))) for k in range(12)]
    index = contamination.build_index(spark.createDataFrame(docs, "doc_id long, text string"), gap=1)
    monkeypatch.setattr(contamination, "TRIED", 64)
    for width, span in ((3, 4), (3, 3), (2, 40)):
        want_near, want_exact = set(), set()
        for i, t in docs:
            own = t.split()
            for k, item in items:
                w = item.split()
                for win in [w[j : j + width] for j in range(max(1, len(w) - width + 1))]:
                    if any(set(win) <= set(own[j : j + span]) for j in range(max(1, len(own)))):
                        want_near.add((i, str(k)))
                    if any(own[j : j + len(win)] == win for j in range(len(own))):
                        want_exact.add((i, str(k)))
        got = contamination.search(index, spark.createDataFrame(items, "item_id long, text string"), width, span).collect()
        assert {(r["doc_id"], k) for r in got for k in r["near_items"]} == want_near
        assert {(r["doc_id"], k) for r in got for k in r["items"]} == want_exact


def test_bpe(spark, sf_dir, docs):
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = bpe.default_vocabulary()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load(path), special_tokens={})
    for r in queries.op9_byte_bpe(spark, sf_dir).collect():
        ids = own.encode_ordinary(docs[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest())
    e = bpe.encoder(path, pattern)
    for t in ["", "a" * 1000, "a" * 3000, " " * 1500, "ab" * 600, "x\x1c\x85　  y", *(t for _, t in ODD if t)]:
        assert e.encode(t) == own.encode_ordinary(t) and e.decode(e.encode(t)) == t.encode()
    rng = random.Random(4)
    for alphabet in ("ab", "aeioust", "AaBb", "the ing tion", "😀é漢a", "0 1\n"):  # long pieces, overlapping pairs, lengths around bucket ends
        for n in (1, 2, 3, 31, 32, 33, 64, 65, 1023, 1025, 20_000):
            t = "".join(rng.choice(alphabet) for _ in range(n))
            assert e.encode(t) == own.encode_ordinary(t)
    mixed = [b"a" * n for n in (5000, 2, 1)] + [b"thethe" * 900, b"zq" * 700]
    assert e.encode_pieces(mixed) == [own.encode_ordinary(x.decode()) for x in mixed]


def test_bpe_forgets(spark, odd):
    path, pattern = bpe.default_vocabulary()
    e = bpe.Encoder(bpe.load(path), pattern)
    e.digests([b"qwzx plonk"])
    assert e.held > 0 and e.memory
    e.forget()
    assert not e.held and not e.memory


def test_merges_that_make_lower_ranks():
    """Vocabularies in which a merge makes a pair of lower rank: leftmost-first order has to be kept."""
    rng = random.Random(9)
    for _ in range(300):
        ranks = {bytes([b]): b for b in range(256)}
        while len(ranks) < 256 + 12:
            a, b = (rng.choice([k for k in ranks if set(k) <= set(b"abc")]) for _ in range(2))
            ranks.setdefault(a + b, 0)
        new = [k for k in ranks if len(k) > 1]
        rng.shuffle(new)
        ranks |= {k: 256 + i for i, k in enumerate(new)}
        e = bpe.Encoder(ranks, ".+")
        for piece in (bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 30))) for _ in range(5)):
            own = [bytes([b]) for b in piece]
            while True:
                best = min(((ranks.get(own[i] + own[i + 1], 1 << 30), i) for i in range(len(own) - 1)), default=(1 << 30, 0))
                if best[0] == 1 << 30:
                    break
                own[best[1] : best[1] + 2] = [own[best[1]] + own[best[1] + 1]]
            assert e._matrix([piece])[0] == [ranks[t] for t in own]


def test_bpe_odd(spark, odd, empty):
    rows = bpe.tokenized(odd).collect()
    assert len(rows) == len(ODD) and {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2)} == {0}
    df, name = bpe.with_ids(odd)
    assert all(r["decoded"] is None if r["text"] is None else bytes(r["decoded"]).decode() == r["text"] for r in bpe.decoded(df, name).collect())
    assert bpe.tokenized(empty).count() == 0
