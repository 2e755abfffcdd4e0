"""Text expressions: pure column functions, and the few that need Python as Arrow UDFs."""

from __future__ import annotations

import difflib
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Quotes and blanks folded to ASCII.
CURLY = "‘’“”\u00a0"
STRAIGHT = "''\"\" "

NUMBER = r"[0-9]+(\.[0-9]+)?"


def _decomposed() -> tuple[str, str, str, dict[str, str]]:
    """By compatibility decomposition: letters that become one ASCII letter or digit, these, marks, and letters that become several."""
    one, to, marks, several = [], [], [], {}
    for code in range(0x80, 0x110000):
        c = chr(code)
        if unicodedata.combining(c):
            marks.append(c)
            continue
        d = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
        said = re.sub("[^a-z0-9]", "-", d)
        if d == c or not said.strip("-"):
            continue
        if len(said) == 1:
            one.append(c), to.append(said)
        else:
            several[c] = said
    return "".join(one), "".join(to), "".join(marks), several


ONE, ONE_TO, MARKS, SEVERAL = _decomposed()


def plain_letters(name: Column) -> Column:
    """Lower case, marks dropped, letters with a compatibility form written in ASCII (STR1's first half)."""
    known = F.create_map(*[F.lit(x) for pair in SEVERAL.items() for x in pair])
    spelt = F.array_join(F.transform(F.split(name, ""), lambda c: F.coalesce(F.try_element_at(known, c), c)), "")
    name = F.when(name.rlike("[" + "".join(f"\\x{{{ord(c):X}}}" for c in SEVERAL) + "]"), spelt).otherwise(name)
    return F.lower(F.translate(name, ONE + MARKS, ONE_TO))


def slug(name: Column) -> Column:
    """Lower case, marks and apostrophes dropped, all else that isn't a letter or digit one hyphen."""
    return F.trim(F.regexp_replace(F.regexp_replace(plain_letters(name), "['’]", ""), "[^a-z0-9]+", "-"), F.lit("-"))


def clean_text(text: Column) -> Column:
    """Quotes and no-break spaces to ASCII, blanks collapsed, ends trimmed."""
    return F.trim(F.regexp_replace(F.translate(text, CURLY, STRAIGHT), "[ \t\r\n]+", " "))


def spaced_name(name: Column) -> Column:
    """Apostrophes dropped, every other run of signs one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), "['’]", ""), "[^a-z0-9]+", " "))


def squashed_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]+", "")


def normal_text(text: Column) -> Column:
    """Cleaned, lower case, without a trailing full stop."""
    return F.regexp_replace(F.lower(clean_text(text)), "[. ]+$", "")


def masked(text: Column) -> Column:
    return F.regexp_replace(text, NUMBER, "#")


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))


def stem(word: Column, min_len: int = 1) -> Column:
    """Without a plural s, where more than ``min_len`` letters stay."""
    return F.regexp_replace(word, f"^(.{{{min_len},}})s$", "$1")


def skeleton(text: Column) -> Column:
    """Numbers as N, words stemmed, all else dropped."""
    words = F.regexp_extract_all(F.lower(text), F.lit(f"{NUMBER}|[a-z]+"), F.lit(0))
    return F.array_join(F.transform(words, lambda w: F.when(w.rlike("^[0-9]"), F.lit("N")).otherwise(stem(w))), " ")


def number_text(x: Column) -> Column:
    """Whole numbers bare, others with at most two places and no zeros at the end."""
    return F.when(x == F.round(x), F.format_string("%d", x.cast("long"))).otherwise(F.regexp_replace(F.format_string("%.2f", F.round(x, 2)), r"\.?0+$", ""))


def render(template: Column, slots: list[Column]) -> Column:
    """``{0}``, ``{1}``, ... replaced in one pass, so what a slot says is never replaced again; a null slot stays as it is."""

    def said(piece: Column) -> Column:
        out = piece
        for i, s in enumerate(slots):
            out = F.when((piece == f"{{{i}}}") & s.isNotNull(), s).otherwise(out)
        return out

    return F.array_join(F.transform(F.regexp_extract_all(template, F.lit(r"\{[0-9]+\}|[^{]+|\{"), F.lit(0)), said), "")


def pair_kind(a: Column, b: Column) -> Column:
    """How two readings of a word differ: same, case, percent, punct or word."""
    bare = lambda c: F.regexp_replace(c, r"[^A-Za-z0-9]", "")
    return F.when(a == b, "same").when(F.lower(a) == F.lower(b), "case").when(F.replace(a, F.lit("%"), F.lit("")) == F.replace(b, F.lit("%"), F.lit("")), "percent").when(bare(a) == bare(b), "punct").otherwise("word")


def initials(name: Column) -> Column:
    return F.array_join(F.transform(F.filter(F.split(name, " "), lambda w: w != ""), lambda w: F.upper(F.left(w, F.lit(1)))), "")


def hms(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def parse_hms(text: Column) -> Column:
    return F.aggregate(F.split(text, ":"), F.lit(0).cast("long"), lambda acc, x: acc * 60 + x.cast("long"))


def lenient_int(c: Column, default: int = 0) -> Column:
    return F.coalesce(F.trim(c).try_cast("int"), F.trim(c).try_cast("double").try_cast("int"), F.lit(default))


def lenient_float(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.trim(c).try_cast("double"), F.lit(default))


@F.pandas_udf(T.StringType())
def json_object(text: pd.Series) -> pd.Series:
    """The first balanced JSON object in free text."""

    def first(s):
        for start in (i for i, c in enumerate(s or "") if c == "{"):
            depth, quoted, skip = 0, False, False
            for i in range(start, len(s)):
                c = s[i]
                if skip:
                    skip = False
                elif quoted:
                    skip, quoted = c == "\\", c != '"'
                elif c == '"':
                    quoted = True
                elif c in "{}":
                    depth += 1 if c == "{" else -1
                    if not depth:
                        return s[start : i + 1]
        return None

    return text.map(first)


def diff_runs(a: str, b: str) -> list[tuple[str, str]]:
    """Word runs as (op, text) along a longest common subsequence, deletions before insertions; op is = - or +.

    Joined by op the runs rebuild both texts. Of the table of suffix lengths one bit a cell is kept.
    """
    x, y = (a or "").split(), (b or "").split()
    names = {w: i for i, w in enumerate(dict.fromkeys(x + y))}
    u, v = np.array([names[w] for w in x], np.int64), np.array([names[w] for w in y], np.int64)
    row = np.zeros(len(y) + 1, np.int32)
    drop = []  # of each word of x from the end: where deleting it loses nothing against inserting
    for i in range(len(x) - 1, -1, -1):
        new = np.zeros(len(y) + 1, np.int32)
        new[:-1] = np.maximum.accumulate(np.maximum(row[:-1], row[1:] + (v == u[i]))[::-1])[::-1]
        drop.append(np.packbits(row[:-1] >= new[1:]))
        row = new
    drop.reverse()
    said: list[tuple[str, str]] = []
    i = j = 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and u[i] == v[j]:
            said.append(("=", x[i]))
            i, j = i + 1, j + 1
        elif j == len(y) or i < len(x) and drop[i][j >> 3] >> (7 - (j & 7)) & 1:
            said.append(("-", x[i]))
            i += 1
        else:
            said.append(("+", y[j]))
            j += 1
    out: list[tuple[str, str]] = []
    for op, w in said:
        out = [*out[:-1], (op, f"{out[-1][1]} {w}")] if out and out[-1][0] == op else [*out, (op, w)]
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("text", T.StringType())])))
def word_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([[{"op": o, "text": t} for o, t in diff_runs(x, y)] for x, y in zip(a, b, strict=True)])


def vote(primary: str, authority: str, others: list[str]) -> str:
    """Merged reading: the authority decides on case and signs, words go by majority, ties to the primary."""
    x, y = (primary or "").split(), (authority or "").split()
    flat = lambda s: "".join(c for c in s.lower() if c.isalnum())
    out: list[str] = []
    for op, i, j, k, m in difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
        a, b = " ".join(x[i:j]), " ".join(y[k:m])
        if op == "equal" or flat(a) == flat(b):
            out += y[k:m] if op != "equal" else x[i:j]
        else:
            votes = [sum(s in (o or "") for o in others) if s else 0 for s in (a, b)]
            out += y[k:m] if votes[1] > votes[0] else x[i:j]
    return " ".join(out)


@F.pandas_udf(T.StringType())
def merge_readings(primary: pd.Series, authority: pd.Series, others: pd.Series) -> pd.Series:
    return pd.Series([vote(p, a, list(o) if o is not None else []) for p, a, o in zip(primary, authority, others, strict=True)])


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 * LCS / (len a + len b), over the words in order."""
    a, b = " ".join(sorted((a or "").split())), " ".join(sorted((b or "").split()))
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for c in a:
        last = 0
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if c == d else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel_ratio(x, y) for x, y in zip(a, b, strict=True)])


# --- folding and comparing descriptions ---

# Spellings of units, words without a claim, and seconds of a unit.
UNITS = [(r"\b(seconds?|secs?)\b", "sec"), (r"\b(minutes?|mins?)\b", "min"), (r"\b(yards?|yds?)\b", "yd"), (r"\bpercent\b", "%")]
FILLER = ["a", "an", "the", "your", "all", "of"]
UNIT_SECONDS = {"sec": 1, "secs": 1, "second": 1, "seconds": 1, "min": 60, "mins": 60, "minute": 60, "minutes": 60, "hr": 3600, "hrs": 3600, "hour": 3600, "hours": 3600}
TOKEN = r"[0-9]+(\.[0-9]+)?|(?<![0-9])\.[0-9]+|[A-Za-z]+"


def clean_line(text: Column) -> Column:
    """STR3: as :func:`clean_text`, but only blanks and tabs are collapsed, and left single quotes stay."""
    return F.regexp_replace(F.regexp_replace(F.translate(text, CURLY[1:], STRAIGHT[1:]), "[ \t]+", " "), r"^\s+|\s+$", "")


def claims(text: Column) -> Column:
    """STR6: what a description claims: lower case, one spelling a unit, no punctuation outside numbers."""
    t = F.regexp_replace(F.translate(F.lower(text), "‘’“”", "''\"\""), "[\u2012-\u2015]", "-")
    for pattern, to in UNITS:
        t = F.regexp_replace(t, pattern, to)
    t = F.regexp_replace(F.regexp_replace(t, r"\s+%", "%"), r"(?<![0-9])[.,](?![0-9])", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9%+\-./]+", " "), " +", " "))


def classified(text: Column) -> Column:
    """STR7: claims without inner hyphens, words of no claim and plurals."""
    words = F.filter(F.split(F.regexp_replace(claims(text), "(?<=[a-z])-(?=[a-z])", ""), " "), lambda w: (w != "") & ~w.isin(*FILLER))
    return F.array_join(F.transform(words, lambda w: F.when(w.rlike("^[a-z]{4,}s$") & ~w.endswith("ss"), F.regexp_replace(w, "s$", "")).otherwise(w)), " ")


VALUE = r"[0-9]+(\.[0-9]+)?%?"


def described_change(old: Column, new: Column) -> Column:
    """BIZ22: how two descriptions differ: none, values (only numbers do) or text."""
    a, b = classified(old), classified(new)
    return F.when(a == b, "none").when(F.regexp_replace(a, VALUE, "#") == F.regexp_replace(b, VALUE, "#"), "values").otherwise("text")


def tokens(text: Column) -> Column:
    """STR19: numbers and words in order."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("text", T.StringType())])))
def token_spans(text: pd.Series) -> pd.Series:
    """STR19 with places: an Arrow UDF, as no built-in gives the places of matches."""
    find = re.compile(TOKEN).finditer
    return text.map(lambda t: None if t is None else [{"pos": i, "start": m.start(), "stop": m.end(), "text": m[0]} for i, m in enumerate(find(t))])


# --- names, ranks, kinds ---

RANK = r"(?i)^rank\s+([0-9]{1,2})$"
KIND_TAIL = r"(?i)\s*\(?(racial passive|passive|racial)\)?\s*$"


def parse_rank(subtitle: Column) -> Column:
    """STR33: the number of "Rank N", else null."""
    return F.regexp_extract(clean_text(subtitle), RANK, 1).try_cast("int")


def entry_kind(subtitle: Column) -> Column:
    """STR34: active, passive, racial or racial-passive."""
    s = F.trim(F.lower(clean_text(F.coalesce(subtitle, F.lit("")))), F.lit(" ."))
    return F.when(s.isin("passive", "(passive)"), "passive").when(s == "racial", "racial").when(s.isin("racial passive", "racial (passive)"), "racial-passive").otherwise("active")


def without_rank(name: Column) -> Column:
    return clean_text(F.regexp_replace(clean_text(name), r"(?i)\s*\(?rank\s+[0-9]{1,2}\)?\s*$", ""))


def without_kind(name: Column) -> tuple[Column, Column]:
    """STR35: a name without the kind that is glued to its end, and that kind in capitals (null: none)."""
    text = clean_text(name)
    kind = F.regexp_extract(text, KIND_TAIL, 1)
    return clean_text(F.regexp_replace(text, KIND_TAIL, "")), F.when(kind != "", F.initcap(kind))


def looks_like_prose(name: Column) -> Column:
    """FLT13: a sentence that was read as a name: long, punctuated, or mostly lower case."""
    t = clean_text(F.coalesce(name, F.lit("")))
    words = F.filter(F.split(t, " "), lambda w: w != "")
    capitals = F.size(F.filter(words, lambda w: w.rlike("^[A-Z]")))
    return (F.length(t) > 44) | t.rlike(r"[.;]\s") | t.endswith(".") | ((F.size(words) >= 4) & (capitals * 2 < F.size(words)))


def requirement(text: Column) -> Column:
    """STR32: struct(name, points, tier) of "Requires X (Rank n)" or "Requires n points in X"; null fields where it is neither."""
    t = clean_text(text)
    ranked, pointed = r"(?i)^requires\s+(.+?)\s*\(rank\s+([0-9]+)\)$", r"(?i)^requires\s+([0-9]+)\s+points?\s+in\s+(.+?)\.?$"
    target = F.regexp_extract(t, pointed, 2)
    tier = target.rlike(r"(?i)\bTalents$")
    return F.when(t.rlike(ranked), F.struct(F.regexp_extract(t, ranked, 1).alias("name"), F.regexp_extract(t, ranked, 2).try_cast("int").alias("points"), F.lit(False).alias("tier"))).when(
        t.rlike(pointed), F.struct(F.regexp_replace(target, r"(?i)\s+Talents$", "").alias("name"), F.regexp_extract(t, pointed, 1).try_cast("int").alias("points"), tier.alias("tier"))
    )


def trait_line(line: Column) -> Column:
    """STR37: struct(name, kind, description) of "Name (Passive): text"; null where the line has another shape."""
    t = clean_text(line)
    shape = r"^([^:]{2,60}?)\s*:\s*(.+)$"
    raw = F.regexp_extract(t, shape, 1)
    passive = raw.rlike(r"(?i)\s*\(passive\)\s*$")
    name = F.trim(F.regexp_replace(raw, r"(?i)\s*\(passive\)\s*$", ""))
    return F.when(t.rlike(shape) & (slug(name) != ""), F.struct(name.alias("name"), F.when(passive, "passive").otherwise("active").alias("kind"), F.regexp_extract(t, shape, 2).alias("description")))


def camel_words(name: Column, prefixes: list[str]) -> tuple[Column, Column]:
    """STR39: "HunterBeastMastery" as its known prefix, lower case, and "Beast Mastery"; null without such a prefix."""
    prefix = F.regexp_extract(F.lower(name), "^(" + "|".join(prefixes) + ")", 1)
    rest = F.substr(name, F.length(prefix) + 1)
    return F.when(prefix != "", prefix), F.when(prefix != "", F.array_join(F.regexp_extract_all(rest, F.lit("[A-Z][a-z]*"), F.lit(0)), " "))


def rewritten_note(note: Column, own: list[str], clauses: list[Column]) -> Column:
    """STR40: a note's clauses that hold none of the markers ``own``, then ``clauses`` (null: none); null where nothing is left."""
    keep = F.filter(F.transform(F.split(F.coalesce(note, F.lit("")), ";"), lambda c: F.trim(c)), lambda c: (c != "") & ~F.lower(c).rlike("|".join(re.escape(m) for m in own)))
    every = F.concat(keep, F.filter(F.array(*clauses), lambda c: c.isNotNull() & (c != "")))
    return F.when(F.size(every) > 0, F.array_join(every, "; "))


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("fixed", T.ArrayType(T.StringType()))]))
def lowered_capital_i(text: pd.Series) -> pd.DataFrame:
    """STR23: words with a wrong capital I inside a sentence; an Arrow UDF, as each match looks at what precedes it."""
    allowed = {"I", "Ice", "Immolate", "Intellect", "Improved", "Immune", "Intercept", "Intimidation"}

    def fix(t):
        fixed = []

        def one(m):
            before = t[: m.start()].rstrip()
            if m[0] in allowed or not before or before[-1] in ".:;!?" or t[: m.start()].endswith("\n"):
                return m[0]
            fixed.append(m[0])
            return m[0][0].lower() + m[0][1:]

        return {"text": None if t is None else re.sub(r"\bI[a-z]{2,}\b", one, t), "fixed": fixed}

    return pd.DataFrame([fix(t) for t in text], columns=["text", "fixed"])


def capital_phrases(text: Column) -> Column:
    """STR24: capitalised runs of words that don't open a sentence."""
    return F.array_distinct(F.regexp_extract_all(clean_text(text), F.lit(r"(?<=[a-z,] )[A-Z][A-Za-z']+( [A-Z][A-Za-z']+)*"), F.lit(0)))


def text_defects(text: Column) -> Column:
    """STR38: what is wrong with a published string, by name."""
    blank = (text != F.trim(text)) | text.contains("  ")
    return F.filter(F.array(F.when(blank, "blank"), F.when(text.rlike(r"[|\\~]"), "artefact"), F.when(text.rlike(r"[a-z]\. [a-z]"), "full stop")), lambda x: x.isNotNull())


def paste_kind(text: Column) -> Column:
    """STR44: what was pasted: link (own hash), foreign (another calculator), code, or error."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(t == "", "error").when(t.rlike("#/[a-z]"), "link").when(t.contains("#/"), "error").when(t.rlike(r"(?i)talent-calc/(embed/)?[a-z-]+/[0-9-]+"), "foreign").when(t.rlike("(?i)talent-calc"), "error").when(t.rlike("^[0-9-]+$") & t.rlike("[0-9]"), "code").otherwise("error")


def code_segments(code: Column, tabs: int) -> Column:
    """STR45: a code's segments; null where there are more than ``tabs``."""
    own = F.split(code, "-")
    return F.when(F.size(own) <= tabs, own)


def kept_diff(ops: Column, drop: str) -> Column:
    """STR28: one line of a diff: what is left without the runs of ``drop`` (+ or -)."""
    return F.array_join(F.transform(F.filter(ops, lambda o: o["op"] != drop), lambda o: o["text"]), " ")


# --- time ---


def hms_millis(t: Column) -> Column:
    """DT3: HH:MM:SS.mmm."""
    ms = F.round(t * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000), F.floor(ms % 3600000 / 60000), F.floor(ms % 60000 / 1000), ms % 1000)


def stream_stamp(t: Column) -> Column:
    """DT4: H:MM:SS."""
    s = F.floor(t).cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def second_and_frame(t: Column, fps: int = 60) -> tuple[Column, Column]:
    """DT5: the second of a time and the frame in it; a frame that rounds up to the next second is that one's first."""
    s = F.floor(t + 1e-6).cast("long")
    f = F.floor((t - s) * fps + 0.5).cast("long")
    return F.when(f >= fps, s + 1).otherwise(s), F.when(f >= fps, F.lit(0).cast("long")).otherwise(f)


def window_seconds(spec: Column) -> tuple[Column, Column]:
    """DT6: "03:59:00-04:02:00" or "14340-14520" as two numbers of seconds."""
    part = lambda i: parse_hms(F.trim(F.get(F.split(spec, "-"), F.lit(i))))
    return part(0), part(1)


def rfc3339(ts: Column) -> Column:
    """DT7."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


RFC3339 = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$"


def duration_text(millis: Column) -> Column:
    """DT8: whole minutes from a minute on, else seconds."""
    s = millis / 1000
    return F.when((s >= 60) & (s % 60 == 0), F.concat(number_text(s / 60), F.lit(" min"))).otherwise(F.concat(number_text(s), F.lit(" sec")))


def converted_durations(values: Column, unit: Column, to: Column) -> Column:
    """DT9: durations in another unit; null where one of them isn't whole there."""
    known = F.create_map(*[F.lit(x) for pair in UNIT_SECONDS.items() for x in pair])
    out = F.transform(values, lambda v: v * known[unit] / known[to])
    return F.when(unit == to, values.cast("array<double>")).when(F.forall(out, lambda x: F.abs(x - F.round(x)) <= 1e-9), F.transform(out, lambda x: F.round(x)))


def cache_key(*parts: Column) -> Column:
    """HSH2: the SHA-1 of a payload and everything that asked about it."""
    return F.sha1(F.concat_ws("\x1f", *parts))
