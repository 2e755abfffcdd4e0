"""Operators of the library: every query against its SQL, and hand-made cases."""

import json
import random

import duckdb
import pytest

from curatrix.functions import text as tx
from curatrix.operators import builds, match, sessions, templates
from curatrix.plans import catalog
from curatrix.sources import readers, sinks

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: v if v is None or isinstance(v, (bool, str)) else round(float(v), 6)
    return sorted(columns), sorted(repr([plain(r[i]) for i in order]) for r in values)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, duck, sf_dir, name):
    got = catalog.queries()[name](spark, sf_dir)
    want = duck.execute(catalog.oracle_sql()[name])
    assert rows(got.columns, got.collect()) == rows([d[0] for d in want.description], want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).columns


def test_entry(spark):
    assert catalog.flagship(spark, "/root/testdata/sf0.001").count() == 4


def test_word_diff_rebuilds():
    for a, b in (("a b c", "a x c"), ("", "a"), ("a", ""), ("one two", "two one"), ("same", "same")):
        ops = tx.diff_runs(a, b)
        assert " ".join(t for o, t in ops if o != "+") == a and " ".join(t for o, t in ops if o != "-") == b


def test_merged_reading():
    assert tx.vote("Deals 5 damage", "deals 5% damage.", []) == "deals 5% damage."
    assert tx.vote("the quick fox", "the quiet fox", ["a quiet fox", "quiet"]) == "the quiet fox"
    assert tx.vote("the quick fox", "the quiet fox", ["quick"]) == "the quick fox"


def test_ratio():
    assert tx.indel_ratio("b a", "a b") == 100.0 and tx.indel_ratio("abc", "xyz") == 0.0 and tx.indel_ratio("", "") == 100.0


def one_by_one(pairs):
    out, gone = [], (set(), set())
    for a, b, r in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if a not in gone[0] and b not in gone[1]:
            out.append((a, b, r)), gone[0].add(a), gone[1].add(b)
    return sorted(out)


def test_tree_match_is_one_to_one(spark, sf_dir):
    over = [(r["source"], str(r["item_id"]), r["ratio"]) for r in catalog.queries()["tree_match_overlap"](spark, sf_dir).collect()]
    got = catalog.queries()["tree_match"](spark, sf_dir).collect()
    assert sorted((r["source"], r["item"], r["ratio"]) for r in got if r["by"] == "overlap") == one_by_one(over) and len(got) < len(over)


def test_greedy_and_passes(spark):
    rng = random.Random(3)
    pairs = [(a, b, rng.randint(1, 4) / 4) for a in range(12) for b in range(9) if rng.random() < 0.6]
    df = spark.createDataFrame(pairs, "a int, b int, r double")
    assert sorted(map(tuple, match.greedy(df, "a", "b", "r").collect())) == one_by_one(pairs)
    assert match.greedy(df.limit(0), "a", "b", "r").count() == 0
    left = spark.createDataFrame([("x", "n"), ("p", "same"), ("q", "same"), ("u", None), ("v", None)], "l string, name string")
    right = spark.createDataFrame([("x", "m"), ("k", "same"), ("y", "z"), ("w", None)], "r string, name string")
    words = lambda c, sets: spark.createDataFrame([(i, w) for i, ws in sets.items() for w in ws], f"{c} string, word string")
    got = match.identified(left, right, words("l", {"x": "abc", "u": "abcd", "v": "abc", "q": "e"}), words("r", {"x": "abc", "y": "abc", "w": "abcd", "k": "abc"}), "l", "r", "name", "word")
    assert sorted(tuple(r)[:3] for r in got.collect()) == [("p", "k", "name"), ("u", "w", "overlap"), ("v", "y", "overlap"), ("x", "x", "id")]


def test_snapped(spark):
    vocab = spark.createDataFrame([("Immolate",), ("Fireball",), ("Fireballs",), ("Shadow",)], "b string")
    said = spark.createDataFrame([("Immolates",), ("Fireball",), ("Fireballx",), ("Fireballss",), ("Shado",), ("Xhadow",), ("Shadowxxx",)], "a string")
    assert sorted(map(tuple, match.snapped(said, vocab, "a", "b").collect())) == [("Fireballss", "Fireballs", 1), ("Immolates", "Immolate", 1)]


def all_pairs(names, least=75):
    names = sorted(set(names))
    scored = ((a, b, round(tx.indel_ratio(a, b), 6)) for i, a in enumerate(names) for b in names[i + 1 :])
    return {p for p in scored if p[2] >= least}


def test_fuzzy_ratio_against_all_pairs(spark, sf_dir):
    names = [r["p_name"] for r in spark.read.parquet(f"{sf_dir}/part.parquet").select("p_name").distinct().collect()]
    got = list(map(tuple, catalog.queries()["fuzzy_ratio"](spark, sf_dir).collect()))
    assert len(got) == len(set(got)) and set(got) == all_pairs(names) and any(a[0] != b[0] for a, b, _ in got)


def test_alike_against_all_pairs(spark):
    rng = random.Random(5)
    names = ["", " ", "\u00a0", "a", "b a", "a  b", "old bolt", "cold bolt", "bolt old", "ça🙂va", "va ça🙂", "🙂", "aaaa", "aaa", "aa"]
    names += ["".join(rng.choice("ab c") for _ in range(rng.randint(1, 9))) for _ in range(120)]
    names += [" ".join(rng.sample(["red", "read", "bread", "iron", "irons", "ring", "string"], rng.randint(1, 3))) for _ in range(80)]
    df = spark.createDataFrame([(n,) for n in [*names, *names[:20], None]], "x string")
    for least in (75, 90, 100):
        got = list(map(tuple, match.alike(df, "x", least).collect()))
        assert len(got) == len(set(got)) and set(got) == all_pairs(names, least)


def test_json_object(spark):
    df = spark.createDataFrame([('x {"a": "}"} y {"b": 1}',), ("none",), (None,), ("{ open",)], "t string")
    assert [r[0] for r in df.select(tx.json_object("t")).collect()] == ['{"a": "}"}', None, None, None]


def test_intervals(spark):
    whole = spark.createDataFrame([(1, 0, 10), (1, 5, 12), (1, 20, 30), (2, 0, 1)], "k int, t0 long, t1 long")
    blocks = spark.createDataFrame([(1, 2, 4), (1, 3, 6), (1, 25, 40)], "k int, t0 long, t1 long")
    assert sorted(map(tuple, sessions.merged_intervals(whole, ["k"]).collect())) == [(1, 0, 12), (1, 20, 30), (2, 0, 1)]
    assert sorted(map(tuple, sessions.merged_intervals(whole, ["k"], bucket=5).collect())) == [(1, 0, 12), (1, 20, 30), (2, 0, 1)]
    assert sorted(map(tuple, sessions.subtracted(whole, blocks, ["k"]).collect())) == [(1, 0, 2), (1, 6, 12), (1, 20, 25), (2, 0, 1)]


def test_codec(spark):
    df = spark.createDataFrame([("b", 0, 0, 3), ("b", 0, 1, 2), ("b", 1, 0, 0), ("b", 2, 0, 1), ("b", 2, 1, 0)], "build string, segment int, position int, digit int")
    code = builds.encoded(df, "build", "segment", "position", "digit")
    assert code.collect()[0]["code"] == "32--1"
    assert sorted(map(tuple, builds.decoded(code, "build", "code").collect())) == [("b", 0, 0, 3), ("b", 0, 1, 2), ("b", 2, 0, 1)]


def test_hamming_suppression(spark):
    codes = [(1, 0), (2, 0), (3, 0b111), (4, -1), (5, (1 << 63) - 1), (6, 0b1111111)]
    df = spark.createDataFrame(codes, "id long, code long")
    assert sorted(r["id"] for r in match.hamming_suppressed(df, "id", "code", 6).collect()) == [1, 4, 6]  # 3 is gone, so it suppresses nothing


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿ID,Name,R_0,R_1\n1,x,5,0\n2,,0,0\n")
    df = readers.repeating(readers.csv_table(spark, str(tmp_path / "a.csv"), ["ID", "Name"], {"Flags": "0"}), "R", 2, "ranks")
    assert [(r["ID"], r["ranks"], r["Flags"]) for r in df.collect()] == [("1", [5], "0"), ("2", [], "0")]
    with pytest.raises(readers.MissingColumns):
        readers.csv_table(spark, str(tmp_path / "a.csv"), ["Other"])
    from pyspark.sql.types import LongType, StructField, StructType

    shape = StructType([StructField("id", LongType())])
    for i, text in enumerate(('[{"id": 1}]', '{"records": [{"id": 2}, {"id": 3}]}', '{"talents": []}')):
        (tmp_path / f"c{i}.json").write_text(text)
    assert sorted(r["id"] for r in readers.candidates(spark, str(tmp_path / "c*.json"), shape).collect()) == [1, 2, 3]
    (tmp_path / "l.txt").write_text("# x\n\na\t1\nb\t2\n")
    assert [tuple(r) for r in readers.tab_list(spark, str(tmp_path / "l.txt")).collect()] == [("a", "1"), ("b", "2")]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(5)
    assert sinks.write_if_changed(df, path) and not sinks.write_if_changed(df, path)
    with pytest.raises(sinks.RefusedWrite):
        sinks.write_not_fewer(spark.range(4), path, ["id"])
    sinks.write_not_fewer(spark.range(6), path, ["id"])
    assert sinks.current(spark, path).count() == 6 and len(sinks.tidy(spark, path)) == 1
    bad = lambda d: d.filter("id > 6").selectExpr("'ERROR' AS level", "'X' AS code", "string(id) AS path", "'' AS message")
    assert sinks.write_audit_publish(spark.range(9), path, bad).count() == 2 and sinks.current(spark, path).count() == 6
    assert sinks.write_audit_publish(spark.range(7), path, bad).count() == 0 and sinks.current(spark, path).count() == 7
    assert not sinks.audited(spark.range(9), bad)[1] and sinks.current(spark, path).count() == 7
    assert sinks.publish_all({"a": spark.range(3), "b": spark.range(2)}, str(tmp_path / "all")) == {"a": "written", "b": "written"}
    assert sinks.publish_all({"a": spark.range(3), "c": spark.range(2)}, str(tmp_path / "all")) == {"a": "unchanged", "c": "written", "b": "deleted"}
    assert sinks.stale({"a": spark.range(4), "c": spark.range(2), "d": spark.range(1)}, str(tmp_path / "all")) == ["a", "d"]
    (tmp_path / "x.png").write_text("")
    assert sinks.prune(spark, [str(tmp_path / "x.png")]) and (tmp_path / "x.png").exists()
    assert sinks.prune(spark, [str(tmp_path / "x.png")], dry_run=False) and not (tmp_path / "x.png").exists()


def test_canonical_bytes():
    doc = {"trees": [{"talents": [{"col": 1, "row": 0, "id": "b", "name": "B"}, {"row": 0, "id": "a", "col": 0, "ranks": [[1, "s"], [2.5, "s"]], "source": {"note": "é", "kind": "manual"}}], "id": "t"}], "class": "mage", "odd": None, "notes": [], "pages": [{"id": "p"}], "rules": {}}
    assert sinks.document_text(doc, "class") == """{
  "class": "mage",
  "rules": {},
  "pages": [
    {
      "id": "p"
    }
  ],
  "trees": [
    {
      "id": "t",
      "talents": [
        {
          "id": "a",
          "row": 0,
          "col": 0,
          "ranks": [[1, "s"], [2.5, "s"]],
          "source": {
            "kind": "manual",
            "note": "é"
          }
        },
        {
          "id": "b",
          "name": "B",
          "row": 0,
          "col": 1
        }
      ]
    }
  ],
  "notes": [],
  "odd": null
}
"""
    long = {"ranks": [["x" * 60, 1], ["y" * 60, 2]], "tags": ["z" * 101]}
    assert sinks.document_text(long) == '{\n  "ranks": [\n    ["' + "x" * 60 + '", 1],\n    ["' + "y" * 60 + '", 2]\n  ],\n  "tags": [\n    "' + "z" * 101 + '"\n  ]\n}\n'
    assert sinks.override_text([{"at": "now", "talent": "a"}, {"talent": "b"}]) == '{\n  "talent": "a",\n  "at": "now"\n},\n{\n  "talent": "b"\n}'
    assert sinks.document_text({"spells": [{"id": "b", "tab": None}, {"id": "a", "tab": "fire"}]}, "spell").index('"a"') < sinks.document_text({"spells": [{"id": "b", "tab": None}, {"id": "a", "tab": "fire"}]}, "spell").index('"b"')


def test_more_readers(spark, tmp_path):
    (tmp_path / "Talent.csv").write_text("ID,Name\n1,x\n2,y\n")
    got, missing = readers.tables(spark, str(tmp_path), {"Talent": ["ID"]}, {"SpellRadius": ["ID", "Radius"]})
    assert got["Talent"].count() == 2 and got["SpellRadius"].columns == ["ID", "Radius"] and got["SpellRadius"].count() == 0 and missing == ["SpellRadius"]
    made = []
    fetch = lambda name, path: (made.append(name), open(path, "w").write("ID\n7\n"))
    rows = {r["file"]: r["rows"] for r in readers.landed(spark, str(tmp_path), ["Talent", "Spell"], fetch).collect()}
    assert rows == {"Talent.csv": 2, "Spell.csv": 1} and made == ["Spell"]
    now = readers.manifest(spark, str(tmp_path / "*.csv"))
    before = spark.createDataFrame(now.collect(), now.schema)
    assert before.count() == 2 and readers.stale(before, readers.manifest(spark, str(tmp_path / "*.csv"))).count() == 0
    (tmp_path / "Spell.csv").write_text("ID\n8\n")
    assert readers.stale(before, readers.manifest(spark, str(tmp_path / "*.csv"))).count() == 1
    for n in (1, 3):
        (tmp_path / f"v{n}.json").write_text(f'{{"version": {n}}}')
    (tmp_path / "vx.json").write_text("{}")
    assert sorted(r["version"] for r in readers.versions(spark, str(tmp_path / "v*.json")).collect()) == [1, 3]
    assert readers.optional_json(spark, str(tmp_path / "none.json"), "a int").count() == 0
    assert readers.windows(spark, None, [(1, 2, "mage", "")])[1] == "built in"
    from pyspark.sql.types import StringType, StructField, StructType

    (tmp_path / "c.json").write_text('[{"name": "Two Words"}, {"id": "k", "name": "x"}]')
    shape = StructType([StructField("id", StringType()), StructField("name", StringType())])
    assert sorted(r["id"] for r in readers.named_candidates(spark, str(tmp_path / "c.json"), shape).collect()) == ["k", "two-words"]
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string"), spark.createDataFrame([(2, "z"), (3, "w"), (3, "w")], "id int, v string")
    assert sorted(map(tuple, readers.first_origin([a, b], "id").collect())) == [(1, "x"), (2, "y"), (3, "w"), (3, "w")]


def test_shown_faults(spark):
    from pyspark.sql import functions as F

    from curatrix.functions import numeric as num
    from curatrix.operators import resolve, rules

    df = spark.createDataFrame([("Škoda Œuvre ő ﬁn ½", 1.999)], "s string, x double")
    assert df.select(tx.slug(F.col("s"))).first()[0] == "skoda-uvre-o-fin-1-2"
    assert [df.select(tx.number_text(F.lit(x))).first()[0] for x in (1.999, 0.001, 2.5, 3.0, -0.25)] == ["2", "0", "2.5", "3", "-0.25"]
    assert df.select(tx.render(F.lit("{0} {1} {2} {x"), [F.lit("{1}"), F.lit("B"), F.lit(None).cast("string")])).first()[0] == "{1} B {2} {x"
    many = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(1500)), lambda i: i * 2.0).alias("v"))
    assert many.select(num.progression(F.col("v")), num.shape(F.col("v"))).first() == ("proportional", "arithmetic")
    votes = spark.createDataFrame([(None, "a"), (None, "a"), (None, "b"), ("k", "x"), ("k", "y"), ("k", None)], "key string, v string")
    assert sorted(map(str, map(tuple, resolve.majority(votes, ["key"], "v").collect()))) == ["('k', 'x', 1, True)", "(None, 'a', 2, False)"]
    refs = spark.createDataFrame([(1, None), (2, 5), (3, 9)], "id int, ref int")
    assert [r["path"] for r in rules.foreign_key(refs, "ref", spark.createDataFrame([(5,)], "k int"), "k", "X", F.col("id")).collect()] == ["3"]


def lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_diff_is_a_longest_subsequence():
    rng = random.Random(12)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 14))] for _ in range(2))
        ops = tx.diff_runs(" ".join(a), " ".join(b))
        assert [w for o, t in ops if o != "+" for w in t.split()] == a and [w for o, t in ops if o != "-" for w in t.split()] == b
        assert sum(len(t.split()) for o, t in ops if o == "=") == lcs_length(a, b)
    assert tx.diff_runs("a b", "a c") == [("=", "a"), ("-", "b"), ("+", "c")]


def test_cycles(spark):
    from curatrix.operators import graph

    chain = [(i, i + 1) for i in range(40)] + [(40, 0)]  # one cycle of 41 steps
    between = [(100, 101), (101, 100), (101, 102), (102, 103), (103, 104), (104, 103), (200, 200), (300, 301), (None, 5), (5, None)]
    df = spark.createDataFrame([*chain, *between, *between], "a long, b long")
    assert sorted(r["node"] for r in graph.on_cycles(df).collect()) == [*range(41), 100, 101, 103, 104, 200]
    assert graph.on_cycles(df.limit(0)).count() == 0


def test_first_come(spark):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    pairs = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(90)})
    kept = []
    for x in range(40):
        if not any((min(x, k), max(x, k)) in pairs for k in kept):
            kept.append(x)
    nodes = spark.range(40)
    got = match.first_come(nodes, spark.createDataFrame(pairs, "a long, b long"), "id", [F.col("id")])
    assert sorted(r["id"] for r in got.collect()) == kept


def test_legal_builds(spark, sf_dir):
    """Repaired builds break no rule and are as one step after the other leaves them; imports spend only what is allowed."""
    from curatrix.operators import allocations as al
    from curatrix.plans import points
    from curatrix.plans.registry import Tables

    t = Tables(spark, sf_dir)
    rules, builds = points._rules(t), points._builds(t)
    legal = al.sanitised(builds, rules).cache()
    assert legal.count() > 0 and al.violations(legal, rules).isEmpty() and al.sanitised(legal, rules).exceptAll(legal).isEmpty()
    whole = al.violations(builds, rules).select("build").distinct()
    untouched = al.spent(builds).join(whole, "build", "left_anti")
    assert untouched.select("build", "tree", "talent", "rank").exceptAll(legal.select("build", "tree", "talent", "rank")).isEmpty()
    got, lost = al.imported(spark.createDataFrame([(1, "c", "name 0", 3), (1, "c", "Name 1", 9), (1, "c", "zz", 2), (1, "c", "Name 4", 2)], "build long, cls string, name string, rank int"), rules)
    assert al.violations(got, rules).isEmpty() and {(r["talent"], r["rank"]) for r in got.collect()} == {("i0", 1), ("i1", 2), ("i4", 2)}
    assert sorted((r["name"], r["kept"], r["reason"]) for r in lost.collect()) == [("Name 1", 2, "fewer-ranks"), ("name 0", 1, "fewer-ranks"), ("zz", 0, "not-there")]
    one = spark.createDataFrame([(1, "c", "t0", "i0", 1), (1, "c", "t0", "i1", 1)], "build long, cls string, tree string, talent string, rank int")
    moves = spark.createDataFrame([(1, "t0", "i1", 1), (1, "t0", "i0", 1), (1, "t0", "i19", 1)], "build long, tree string, talent string, step int")
    assert {(r["talent"], r["rank"]) for r in al.changed(one, moves, rules).collect()} == {("i0", 1), ("i1", 2)}


def test_alignment_and_stitching(spark):
    from curatrix.operators import readings as rd

    a = spark.createDataFrame([(1, 0, "x", 1), (1, 1, "y", 2), (1, 2, "x", 2)], "col int, pos int, id string, rank int")
    b = spark.createDataFrame([(1, 0, "x", 2), (1, 1, "x", 1), (1, 2, "z", None)], "col int, pos int, id string, rank int")
    got = {(r["a_pos"], r["b_pos"], r["id"], r["confidence"]) for r in rd.aligned(a, b, "col").collect()}
    assert got == {(0, 1, "x", 1.0), (1, None, "y", 0.0), (2, 0, "x", 1.0), (None, 2, "z", 0.0)}
    s = spark.createDataFrame([("g", 1, i, x) for i, x in enumerate("abc")] + [("g", 2, i, x) for i, x in enumerate("xbd")] + [("h", 1, 0, "p"), ("h", 1, 1, "q"), ("h", 2, 0, "q"), ("h", 2, 1, "p")], "grp string, seq int, pos int, id string")
    order = {}
    for r in rd.stitched(s, "grp").orderBy("grp", "pos").collect():
        order.setdefault(r["grp"], []).append(r["id"])
    assert order == {"g": list("axbcd"), "h": ["p", "q"]}


def test_templates(spark):
    cases = {
        1: ["Costs 1 rage point.", "Costs 2 rage points."],
        2: ["Stuns.", "Stuns for 5 sec."],
        3: ["Tougher."],
        4: ["Gains .5 to 010", "Gains 1.50 to 20"],
        5: [],
        6: None,
        7: ["a", None],
        8: ["Point 1", "point 1"],
        9: ["", ""],
        10: ["bus", "bu"],
    }
    df = spark.createDataFrame(list(cases.items()), "id int, texts array<string>")
    got = {r["id"]: (r["template"], r["slots"], r["reason"]) for r in templates.inferred(df, "texts").collect()}
    assert got[1] == ("Costs {0} rage point{1}.", [["1", ""], ["2", "s"]], None)
    assert got[3] == ("Tougher.", [[]], None) and got[9] == ("", [[], []], None)
    assert got[4] == ("Gains {0} to {1}", [["0.5", "10"], ["1.5", "20"]], None)
    assert {got[i] for i in (5, 6, 7)} == {(None, None, None)} and {got[i] for i in (2, 8, 10)} == {(None, None, templates.CHANGED)}
    assert [r["template"] for r in templates.inferred(df.filter("id = 10"), "texts", 1).collect()] == ["bu{0}"]
    assert templates.inferred(df.limit(0), "texts").count() == 0


def test_markdown(spark):
    df = spark.createDataFrame([("b|c", 2), (None, 1), ("a", 3)], "name string, n int")
    text = sinks.markdown("Import", {"rows": 3}, {"All": df, "Gone": df.limit(0)}, 2)
    assert text == "# Import\n\n- rows: 3\n\n## All (3)\n\n| name | n |\n| --- | ---: |\n|  | 1 |\n| a | 3 |\n\n... 1 more\n\n## Gone (0)\n\nNone.\n"


def test_streams_agree_with_batch(spark, sf_dir):
    from pyspark.sql import functions as F

    from curatrix.streaming import sessions as st

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    batch = st.session_stream(events).collect()
    closed = st.closed_sessions(spark, f"{sf_dir}/events.parquet", events.schema).collect()
    key = lambda r: (r["user_id"], r["event_type"], r["t0"], r["n"], r["best"])
    last = max(r["ts"] for r in events.collect())
    done = [r for r in batch if (last - r["t1"]).total_seconds() > 3600]
    assert set(map(key, closed)) == set(map(key, done)) and 0 < len(closed) < len(batch)
    every = st.all_sessions(spark, f"{sf_dir}/events.parquet", events.schema).collect()
    assert sorted(map(key, every)) == sorted(map(key, batch))
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    runs = sessions.runs(events.withColumn("us", us), ["user_id"], ["us", "event_id"], "us", "event_type", 6 * 3600 * 1000000).collect()
    live = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parque[t]")
    q = st.run_stream(live).writeStream.format("memory").queryName("open_runs").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["user_id"], r["event_type"], r["t0"], r["t1"], r["n"]) for r in spark.table("open_runs").collect()}
    assert got and got <= {(r["user_id"], r["event_type"], r["t0"], r["t1"], r["n"]) for r in runs}


def against_sql(spark, folder, name, **tables):
    """A query against its SQL over tables given as DuckDB SELECTs."""
    c = duckdb.connect()
    for t, sql in tables.items():
        c.execute(f"COPY ({sql}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got, want = catalog.queries()[name](spark, str(folder)), c.execute(catalog.oracle_sql()[name])
    assert rows(got.columns, got.collect()) == rows([d[0] for d in want.description], want.fetchall())
    return got


def test_addable_with_one_shuffle_of_builds(spark, tmp_path):
    some = "SELECT CASE WHEN i % 11 > 0 THEN i // 9 END AS l_orderkey, CASE WHEN i % 13 > 0 THEN i * 7 % 200 END AS l_partkey, i * 5 % 23 + 0.0 AS l_quantity FROM range(400) r(i)"
    got = against_sql(spark, tmp_path, "build_can_add", lineitem=some)
    assert got.filter("build is null").count() == 60
    assert got.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(build") == 1  # not yet run, so one plan


def test_distinct_states_one_by_one(spark):
    from pyspark.sql import functions as F

    from curatrix.operators import views

    rng = random.Random(11)
    data = [("a", i, rng.choice([rng.uniform(0, 40), rng.randint(0, 80) / 2])) for i in range(900)] + [("b", 2000 - i, i / 4) for i in range(300)] + [("c", 3000 + i, 1e300 * i) for i in range(4)]
    data += [(None, 4000, 1.0), (None, 4001, 1.0), ("a", 4002, None), ("a", 4003, float("nan")), ("a", 4004, float("inf")), ("a", 4005, float("inf"))]
    want, held = {i for k, i, x in data if i >= 4000}, {}
    for k, i, x in sorted(data, key=lambda r: r[1]):
        if i < 4000 and all(abs(x - y) > 0.5 for y in held.get(k, [])):
            held.setdefault(k, []).append(x), want.add(i)
    df = spark.createDataFrame(data, "k string, id long, x double").repartition(3)
    for few in (0, 100_000):
        got = views.distinct_states(df, ["k"], "id", "x", 0.5, [F.col("id")], few)
        assert got.columns == df.columns and sorted(r["id"] for r in got.collect()) == sorted(want)
    crowd = spark.range(60_000).select(F.lit("k").alias("k"), "id", (F.col("id") * 7919 % 60_000 / 60_000).alias("x"))  # 1.6 billion pairs are close
    assert sorted(r["id"] for r in views.distinct_states(crowd, ["k"], "id", "x", 0.5, [F.col("id")]).collect()) == [0, min(i for i in range(60_000) if i * 7919 % 60_000 > 30_000)]


def test_migrations_broadcast_no_ids(spark, tmp_path):
    against_sql(spark, tmp_path, "migration_rules", part="SELECT i * 3 AS p_partkey FROM range(500) r(i)")
    plan = catalog.queries()["migration_rules"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 5 and plan.count("BroadcastHashJoin") == 2  # broadcast is the latest version of a class, in both branches


def test_migration_chain_beyond_renamed_ids(spark, tmp_path):
    got = against_sql(spark, tmp_path, "migration_chain", part="SELECT CASE WHEN i <> 7 THEN i * 1001 END AS p_partkey FROM range(400) r(i) UNION ALL SELECT 5 + 100000 * i FROM range(3) r(i) UNION ALL SELECT 100002")
    assert got.filter("first_id = 100002").first()["id"] == 200002


def test_intervals_with_equal_starts_and_without_keys(spark, tmp_path):
    """Equal orders of a customer, whose place the SQL leaves open, against sets of days; null customers against the SQL."""
    rng = random.Random(4)
    dates = [(c, rng.randint(9000, 9600)) for c in range(5) for _ in range(12)]
    duckdb.execute("CREATE OR REPLACE TEMP TABLE d (c BIGINT, t BIGINT)").executemany("INSERT INTO d VALUES (?, ?)", [x for x in dates for _ in range(rng.randint(1, 6))])
    duckdb.execute(f"COPY (SELECT c AS o_custkey, TIMESTAMP '1970-01-01' + t * INTERVAL 1 DAY AS o_orderdate FROM d) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    days = lambda name: [(r["o_custkey"], d) for r in catalog.queries()[name](spark, str(tmp_path)).collect() for d in range(r["t0"], r["t1"])]
    whole = {(c, t + i) for c, t in dates for i in range(30)}
    assert sorted(days("interval_merge")) == sorted(whole)
    assert sorted(days("interval_subtract")) == sorted(whole - {(c, t + i) for c, t in dates for i in (10, 11)})
    against_sql(spark, tmp_path, "interval_subtract", orders="SELECT CASE WHEN i % 3 > 0 THEN i % 3 END AS o_custkey, TIMESTAMP '1995-01-01' + i * 7 * INTERVAL 1 DAY AS o_orderdate FROM range(40) r(i)")
