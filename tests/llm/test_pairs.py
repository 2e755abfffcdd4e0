"""Repeats, near copies, archives, tool calls and the pipeline against brute force, and odd inputs."""

import base64
import hashlib
import json
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from curatrix.llm import chat, graph, neardup, queries, quality, repeats, substrings, suffixes, warc

ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "one two three"), (None, "One two three"), (4, "ab " * 300), (4, "ab " * 300), (5, "x" * 3000), (6, "日本語 текст ça va 🙂 " * 30), (7, "日本語 текст ça va 🙂 " * 29), (8, " ".join(map(str, range(200)))), (9, " ".join(map(str, range(60, 300))))]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in ODD], "doc_id long, text string, p int, TH string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def words(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())


def brute(seqs, width):
    """Of each sequence, which symbols lie in a window that starts anywhere else."""
    times = Counter(s[i : i + width] for s in seqs for i in range(len(s) - width + 1))
    out = []
    for s in seqs:
        gone = [False] * len(s)
        for i in range(len(s) - width + 1):
            if times[s[i : i + width]] > 1:
                gone[i : i + width] = [True] * width
        out.append(gone)
    return out


def brute_words(texts, width):
    seqs = [tuple(words(t)) for t in texts]
    return sorted((len(s), sum(g), hashlib.sha256(b" ".join(w for w, x in zip(s, g, strict=True) if not x)).hexdigest()) for s, g in zip(seqs, brute(seqs, width), strict=True))


def brute_bytes(texts, width):
    seqs = [(t or "").encode() for t in texts]
    runs = lambda g: sum(x and not (i and g[i - 1]) for i, x in enumerate(g))
    return sorted((len(s), sum(g), runs(g), hashlib.sha256(bytes(b for b, x in zip(s, g, strict=True) if not x)).hexdigest()) for s, g in zip(seqs, brute(seqs, width), strict=True))


def test_substrings(spark, sf_dir, docs):
    rows = queries.op1_substring_dedup(spark, sf_dir).collect()
    assert sorted((r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows) == brute_words(docs.values(), 35) and sum(r["n_removed"] for r in rows) > 0


@pytest.mark.parametrize("width", [3, 35])
def test_substrings_odd(odd, empty, width):
    rows = substrings.removed(odd, width).collect()
    assert sorted((r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows) == brute_words([t for _, t in ODD], width)
    assert substrings.removed(empty).count() == 0


def test_repeated_rows_stay_small(spark):
    """Rows that repeat a document share one list of spans, in proportion to the text, not to the rows."""
    text = " ".join(map(str, range(400)))
    sizes = []
    for n in (20, 80):
        df = spark.createDataFrame([(1, text)] * n, "doc_id long, text string")
        whole = repeats.with_lists(df, substrings.spans(df), "left", "p", "n")
        got = [len(r["spans"]) for r in whole.select("spans").collect()]
        assert len(got) == n and len(set(got)) == 1
        sizes.append(got[0])
    assert sizes[0] == sizes[1]


def test_long_texts(spark):
    rng = np.random.default_rng(11)
    long = [f"w{i}" for i in rng.integers(0, 3000, 20_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[5000:5100] + ["x"] + long[700:760])), (3, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.removed(df).collect()) == brute_words([t for _, t in rows], 35)
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.removed(df).collect()) == brute_bytes([t for _, t in rows], 200)


def test_suffixes(spark, sf_dir, docs):
    rows = queries.op5_suffix_array_dedup(spark, sf_dir).collect()
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows) == brute_bytes(docs.values(), 200)


def test_suffixes_odd(odd, empty, monkeypatch):
    want = brute_bytes([t for _, t in ODD], 200)
    got = lambda: sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.removed(odd).collect())
    assert got() == want
    monkeypatch.setattr(suffixes, "PACK", 300)  # names with many strings are dealt out by longer runs
    assert got() == want
    rng = np.random.default_rng(7)  # one common passage among many others, and one text of a few symbols
    hot = "".join(rng.choice(list("abcdef ")) for _ in range(260))
    rows = [(i, "".join(rng.choice(list("xyz "), int(rng.integers(0, 90)))) + hot[int(rng.integers(0, 30)) :] + "".join(rng.choice(list("uvw"), 40))) for i in range(40)]
    rows += [(90, "ab" * 700), (91, "".join(rng.choice(list("ab"), 3000)))]
    df = odd.sparkSession.createDataFrame(rows, "doc_id long, text string")
    for pack in (300, 3000, 1 << 20):
        monkeypatch.setattr(suffixes, "PACK", pack)
        assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.removed(df).collect()) == brute_bytes([t for _, t in rows], 200)
    assert suffixes.removed(empty).count() == 0


def test_suffix_array():
    rng = np.random.default_rng(1)
    for n in [*range(1, 40), 200, 1000]:
        for kinds in (1, 2, 5, 300):
            s = rng.integers(1, kinds + 1, n)
            assert suffixes.suffix_array(s).tolist() == sorted(range(n), key=lambda i: tuple(s[i:]))


def test_sliding_min_and_rolling():
    rng = np.random.default_rng(2)
    v = rng.integers(0, 3, 100).astype(np.uint64)
    assert repeats.sliding_min(v, 7).tolist() == [min(v[i : i + 7]) for i in range(94)]
    h = repeats.rolling(v, 4)
    same = {(tuple(v[i : i + 4]), int(h[i])) for i in range(97)}
    assert len({a for a, _ in same}) == len({b for _, b in same}) == len(same)


def sets_of(texts, size=5):
    out = []
    for t in texts:
        w = [x.lower() for x in words(t)]
        out.append(frozenset([tuple(w)] if 0 < len(w) < size else [tuple(w[i : i + size]) for i in range(len(w) - size + 1)]))
    return out


def brute_groups(ids, texts):
    sets, up = sets_of(texts), list(range(len(ids)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                up[root(i)] = root(j)
    members = {}
    for i in range(len(ids)):
        members.setdefault(root(i), []).append(ids[i])
    least = {r: min((x for x in m if x is not None), default=None) for r, m in members.items()}
    return [(i, len(s), least[root(k)], i == least[root(k)]) for k, (i, s) in enumerate(zip(ids, sets, strict=True))]


def test_near_duplicates(spark, sf_dir, docs):
    got = sorted(tuple(r) for r in queries.op10_near_dedup(spark, sf_dir).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == sorted(brute_groups(list(docs), list(docs.values())))


def test_near_duplicates_odd(odd, empty):
    got = sorted((str(tuple(r)) for r in neardup.near_duplicates(odd).collect()))
    assert got == sorted(str(x) for x in brute_groups([i for i, _ in ODD], [t for _, t in ODD]))
    assert neardup.near_duplicates(empty).count() == 0
    kept = neardup.keep_representatives(odd)
    assert kept.columns == odd.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 2, 3, None, 4, 5, 6, 8, 9])


@pytest.mark.parametrize("rounds", [neardup.PIVOT_ROUNDS, 1])
def test_many_near_copies(spark, monkeypatch, rounds):
    """A group in which most pairs are no links: further rounds have to find the others, or the last alone."""
    monkeypatch.setattr(neardup, "PIVOT_ROUNDS", rounds)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(120):
        w = list(base)
        for p in rng.choice(120, int(rng.integers(0, 7)), replace=False):
            w[p] = f"x{i}_{p}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(tuple(r) for r in neardup.near_duplicates(df).collect()) == sorted(brute_groups(list(range(120)), texts))


def test_estimate(spark):
    a, b = set(range(1000)), set(range(200, 1000))
    sig = lambda s: neardup.packed(neardup.minima(neardup.mix(np.array(sorted(s), np.uint64) + np.uint64(1)))).tolist()
    df = spark.createDataFrame([(sig(a), sig(b))], "a array<long>, b array<long>")
    assert abs(df.select(neardup.similarity(df.a, df.b)).first()[0] - 0.8) < 0.12 and df.select(neardup.similarity(df.a, df.a)).first()[0] == 1.0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (50, 60), (50, 60)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in (100, 101, 102)}, 50: 50, 60: 50}


def test_warc(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    first = {}
    for p in sorted(pages, key=lambda r: r["page_id"]):
        first.setdefault(p["html"], p["page_id"])
    want = sorted((p["page_id"], len(p["html"].encode()), base64.b32encode(hashlib.sha1(p["html"].encode()).digest()).decode(), "response" if first[p["html"]] == p["page_id"] else "revisit", -1 if first[p["html"]] == p["page_id"] else first[p["html"]]) for p in pages)
    got = sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], -1 if r["refers_to"] is None else r["refers_to"]) for r in queries.op3_warc(spark, sf_dir).collect())
    assert got == want


def test_warc_odd(spark, tmp_path, monkeypatch):
    rows = [(1, "u\r\nX: y", "a\r\n\r\nb"), (2, None, None), (3, "é", ""), (5, "u", "same"), (4, "u", "same"), (4, "u", "same"), (None, "n", "same"), (None, "n", "alone"), (9, "l", "long " * 200000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, First string")
    monkeypatch.setattr(warc, "FRAME_BYTES", 700)
    archives = warc.archived(pages)
    got = {(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read(archives).collect()}
    assert got == {(1, 6, "response", None), (2, 0, "response", None), (3, 0, "revisit", 2), (4, 4, "response", None), (4, 4, "revisit", 4), (5, 4, "revisit", 4), (None, 4, "revisit", 4), (None, 5, "response", None), (9, 1000000, "response", None)}
    assert [r["payload"] for r in warc.fetch(archives, [1]).collect()] == [bytearray(b"a\r\n\r\nb")]
    named = [r["record_id"] for r in warc.read(archives).collect()]
    assert len(named) == len(set(named)) == len(rows) and sorted(e["record_id"] for r in archives.collect() for e in r["index"]) == sorted(named)
    assert sorted(r["record_type"] for r in warc.fetch(archives, [4]).collect()) == ["response", "revisit"]
    import zstandard

    for path in warc.export(archives, str(tmp_path)):
        raw = open(path, "rb").read()
        whole = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
        assert whole.startswith(b"WARC/1.1\r\n") and warc.frames(raw)
    assert warc.round_trip(pages.limit(0)).count() == 0
    with pytest.raises(ValueError):
        warc.parse(warc.render(1, "u", b"abc", None, False).replace(b"abc", b"abd"))


def test_tool_calls(spark):
    call = lambda i, args, after=None: {"id": i, "name": "add", "arguments": args, **({"after": after} if after else {})}
    messages = [
        (1, 0, "user", "hello"), (1, 1, "assistant", json.dumps({"tool_calls": [call("a", {"y": 1, "x": 2}), call("b", {"x": 1}, ["a"]), call("c", {"x": 1, "y": "no"}, ["b", "zz"])]})),
        (1, 2, "tool", '{"tool_call_id": "a", "content": {"z": 1, "b": [2]}}'), (1, 3, "tool", '{"tool_call_id": "a", "content": 5}'), (1, 4, "tool", '{"tool_call_id": "q", "content": null}'),
        (2, 0, "assistant", json.dumps({"tool_calls": [call("p", {}, ["r"]), call("r", {}, ["p"])]})), (2, 1, "user", None), (2, 2, "assistant", "{not json"), (None, 0, "user", "x"), (None, 1, "assistant", "y"),
        (3, None, "user", "x"), (3, 5, "system", "s"), (3, 6, None, None), (4, 0, "user", "same"), (4, 0, "user", "same"),
    ]
    schemas = spark.createDataFrame([("add", ["x", "y"], {"x": "integer", "y": "integer"}), *chat.SCHEMAS], chat.SCHEMA_COLUMNS)
    df = spark.createDataFrame([(*m, 1) for m in messages], "conv_id long, turn long, role string, text string, Depth int")
    got = {(r["conv_id"], r["turn"], r["position"]): r for r in chat.linked(df, schemas).collect()}
    pick = lambda k: (got[k]["kind"], got[k]["call_id"], got[k]["depth"], got[k]["status"], got[k]["valid"])
    assert pick((1, 0, 0)) == ("call", "turn:0", 0, "unlinked", True)
    assert pick((1, 1, 0)) == ("call", "a", 0, "linked", True) and got[1, 1, 0]["json"] == '{"arguments":{"x":2,"y":1},"id":"a","name":"add","result":"{\\"b\\":[2],\\"z\\":1}"}'
    assert pick((1, 1, 1)) == ("call", "b", 1, "unlinked", False) and pick((1, 1, 2)) == ("call", "c", 2, "unlinked", False)
    assert [got[1, t, 0]["status"] for t in (2, 3, 4)] == ["linked", "duplicate", "unlinked"]
    assert {pick((2, 0, i))[2] for i in (0, 1)} == {None} and pick((2, 1, 0))[3:] == ("linked", False)
    assert got[None, 1, 0]["status"] == "linked" and got[3, 5, 0]["status"] == "context" and pick((4, 0, 0))[3] == "unlinked"
    assert len(got) == 17 and chat.linked(df.limit(0)).count() == 0


def brute_calls(messages, schemas):
    """kind, call_id, depth, status and valid of each event, one conversation at a time, by recursion."""
    found = {}
    for conv, turn, role, text in messages:
        try:
            said = json.loads(text or "")
        except ValueError:
            said = None
        if role == "assistant" and isinstance(said, dict) and said.get("tool_calls"):
            for i, c in enumerate(said["tool_calls"]):
                found[conv, turn, i] = ("call", c["id"], c["name"], c["arguments"], c.get("after") or [])
        elif role == "tool" and isinstance(said, dict) and "tool_call_id" in said:
            found[conv, turn, 0] = ("result", said["tool_call_id"], None, None, None)
        else:
            found[conv, turn, 0] = ("context", None, role, None, None)
    first = {}
    for (conv, turn, i), e in sorted(found.items()):
        if e[0] != "context":
            first.setdefault((e[0], conv, e[1]), (turn, i))
    needs = {(c, k): [n for n in found[(c, *at)][4] if ("call", c, n) in first] for (kind, c, k), at in first.items() if kind == "call"}

    def depth(node, on=()):
        if node in on:
            return None
        below = [depth((node[0], n), (*on, node)) for n in needs.get(node, [])]
        return None if None in below else 1 + max(below, default=-1)

    out = {}
    for (conv, turn, i), (kind, k, name, args, _) in found.items():
        other = ("result" if kind == "call" else "call", conv, k)
        status = "context" if kind == "context" else "duplicate" if first[kind, conv, k] != (turn, i) else "linked" if other in first else "unlinked"
        valid = kind != "call" or (name in schemas and set(schemas[name][0]) <= set(args) and all(t in schemas[name][1] and {"integer": int, "string": str}[schemas[name][1][t]] is type(v) for t, v in args.items()))
        out[conv, turn, i] = (kind, k, depth((conv, k)) if kind != "context" else 0, status, valid)
    return out


def test_tool_calls_against_brute_force(spark):
    rng = np.random.default_rng(6)
    schemas = {"add": (["x"], {"x": "integer", "y": "string"}), "get": ([], {"k": "string"})}
    messages = []
    for conv in range(14):
        ids = [f"c{i}" for i in range(int(rng.integers(1, 9)))]
        for turn in range(int(rng.integers(1, 14))):
            kind = rng.choice(["call", "result", "system"], p=[0.6, 0.3, 0.1])
            if kind == "call":
                own = [{"id": str(rng.choice(ids)), "name": str(rng.choice(["add", "get", "no"])), "arguments": [{"x": 1}, {"x": "1"}, {"x": 2, "y": "s"}, {"k": "v"}, {}][int(rng.integers(5))], "after": [str(x) for x in rng.choice([*ids, "zz"], int(rng.integers(0, 3)))]} for _ in range(int(rng.integers(1, 4)))]
                messages.append((conv, turn, "assistant", json.dumps({"tool_calls": own})))
            elif kind == "result":
                messages.append((conv, turn, "tool", json.dumps({"tool_call_id": str(rng.choice([*ids, "q"])), "content": "r"})))
            else:
                messages.append((conv, turn, "system", "s"))
    chained = [{"id": f"n{i}", "name": "get", "arguments": {}, "after": [f"n{i - 1}"] if i else []} for i in range(300)]
    messages.append((99, 0, "assistant", json.dumps({"tool_calls": [*chained, {"id": "m", "name": "get", "arguments": {}, "after": ["n299", "n7"]}]})))
    messages.append((98, 0, "tool", json.dumps({"tool_call_id": "big", "content": "x" * 200_000})))
    df = spark.createDataFrame(messages, "conv_id long, turn long, role string, text string")
    table = spark.createDataFrame([(n, *s) for n, s in schemas.items()], chat.SCHEMA_COLUMNS)
    got = {(r["conv_id"], r["turn"], r["position"]): (r["kind"], r["call_id"], r["depth"], r["status"], r["valid"]) for r in chat.linked(df, table).collect()}
    want = brute_calls([m for m in messages if m[0] != 99], schemas)
    assert {k: v for k, v in got.items() if k[0] != 99} == want and {v[3] for v in want.values()} >= {"linked", "unlinked", "duplicate"} and None in {v[2] for v in want.values()}
    assert got[99, 0, 299][2] == 299 and got[99, 0, 300][2] == 300
    assert {r["valid"] for r in chat.linked(df.filter("conv_id = 99"), table.limit(0)).collect()} == {False}


def test_pipeline(spark, sf_dir, docs):
    """Each stage against brute force on what its predecessor kept."""
    from tests.llm.test_texts import brute_hits

    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    judged, _, _, kept, _ = quality.judged(table, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    want = {r["doc_id"] for r in judged.filter(kept).select("doc_id").collect()}
    one = stage["quality_rules"](spark, table, sf_dir).cache()
    assert one.columns == table.columns and {r["doc_id"] for r in one.collect()} == want and 0 < len(want) < len(docs)
    own = {r["doc_id"]: r["text"] for r in one.collect()}
    two = stage["near_dedup"](spark, one, sf_dir).cache()
    want = {i for i, _, _, k in brute_groups(list(own), list(own.values())) if k}
    assert two.columns == table.columns and sorted(r["doc_id"] for r in two.collect()) == sorted(want)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    three = stage["decontamination"](spark, two, sf_dir).cache()
    assert three.columns == table.columns and {r["doc_id"] for r in three.collect()} == {i for i in want if not brute_hits(docs[i], items)[4]}
    four = stage["pii"](spark, three, sf_dir).cache()
    assert four.columns == table.columns and not [r for r in four.collect() if "@" in r["text"] and re.search(r"[a-z0-9]@[a-z0-9-]+\.[a-z]", r["text"])]
    five = {r["doc_id"]: r for r in stage["byte_bpe"](spark, four, sf_dir).collect()}
    assert {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in four.collect()} == {i: r["decoded_sha256"] for i, r in five.items()}
    whole = {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert whole == {i: r["ids_sha256"] for i, r in five.items()}


def test_stages_odd(spark, sf_dir):
    rows = [(1, None, None, None, None, 0), (None, "a b c d e f", "en", "s", 3, 1), (None, "a b c d e f", "en", "s", 3, 1), (2, "", "en", None, 0, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, Key_Id int")
    assert sorted(r["n_tokens"] for r in dict(corpus_pipeline.STAGES)["byte_bpe"](spark, df, sf_dir).collect())[:2] == [0, 0]
    assert dict(corpus_pipeline.STAGES)["byte_bpe"](spark, df.limit(0), sf_dir).count() == 0
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, sf_dir).columns == df.columns
        assert stage(spark, df, sf_dir).count() == {"quality_rules": 0, "near_dedup": 3}.get(name, 4)
        assert stage(spark, df.limit(0), sf_dir).count() == 0
