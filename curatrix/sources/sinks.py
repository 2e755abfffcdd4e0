"""Writing: never fewer rows than before, only what passes the rules, only what changed; canonical documents.

A table is a folder of versions and a file `CURRENT` that names one. A version is written whole, then the
file is replaced by one rename, which is atomic: readers (:func:`current`) see the old rows or the new
ones, and a crash between leaves the old. :func:`tidy` deletes versions that are not current.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class RefusedWrite(ValueError):
    pass


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """SNK1, SNK2: a file whose old or new text is seen whole: written beside it, then renamed over it."""
    jvm, new = spark._jvm, f"{path}.{uuid.uuid4().hex}.tmp"
    out = _fs(spark, path).create(_path(spark, new), True)
    out.write(bytearray(text.encode()))
    out.close()
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    over = spark.sparkContext._gateway.new_array(kind, 1)
    over[0] = kind.OVERWRITE
    where = _fs(spark, path).makeQualified(_path(spark, path))
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration()).rename(_fs(spark, path).makeQualified(_path(spark, new)), where, over)


def _version(spark: SparkSession, path: str) -> str | None:
    if not _fs(spark, path).exists(_path(spark, f"{path}/CURRENT")):
        return None
    return spark.read.text(f"{path}/CURRENT").first()[0]


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The table's rows; None where nothing was published yet (SRC14, SRC23)."""
    name = _version(spark, path)
    return None if name is None else spark.read.parquet(f"{path}/{name}")


def _staged(df: DataFrame, path: str) -> str:
    name = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    return name


def _publish(spark: SparkSession, path: str, name: str) -> None:
    write_text(spark, f"{path}/CURRENT", name + "\n")


def replace(df: DataFrame, path: str) -> None:
    """Publishes ``df`` as the table's next version."""
    _publish(df.sparkSession, path, _staged(df, path))


def tidy(spark: SparkSession, path: str) -> list[str]:
    """Deletes versions that are not current; run it when no reader holds an older one."""
    keep, out = _version(spark, path), []
    for f in _fs(spark, path).listStatus(_path(spark, path)):
        if f.isDirectory() and f.getPath().getName() != keep:
            _fs(spark, path).delete(f.getPath(), True)
            out.append(f.getPath().getName())
    return out


def write_not_fewer(df: DataFrame, path: str, keys: list[str]) -> None:
    """SNK3: refuses a write that loses keys that are there."""
    old = current(df.sparkSession, path)
    if old is not None and (n := old.select(*keys).distinct().join(df.select(*keys).distinct(), keys, "left_anti").count()):
        raise RefusedWrite(f"{path} would lose {n} records")
    replace(df, path)


def audited(df: DataFrame, findings: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, bool]:
    """SNK11: what the rules find, and whether ``df`` could be published; nothing is written."""
    found = findings(df)
    return found, found.filter("level = 'ERROR'").isEmpty()


def write_audit_publish(df: DataFrame, path: str, findings: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """SNK10: stages a version, runs the rules over what was written, and names it the current one if there is no ERROR; else deletes it.

    The findings are collected before the version may go: they are as many as the faults, which the caller looks at anyway.
    """
    spark, name = df.sparkSession, _staged(df, path)
    found, good = audited(spark.read.parquet(f"{path}/{name}"), findings)
    kept = spark.createDataFrame(found.collect(), found.schema)
    if good:
        _publish(spark, path, name)
    else:
        _fs(spark, path).delete(_path(spark, f"{path}/{name}"), True)
    return kept


def digest(df: DataFrame) -> str:
    """A hash of the rows that doesn't depend on their order."""
    row = F.xxhash64(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).cast("decimal(38,0)")
    n, total = df.agg(F.count("*"), F.sum(row)).first()
    return f"{n}:{total}"


def write_if_changed(df: DataFrame, path: str) -> bool:
    """SNK12."""
    old = current(df.sparkSession, path)
    if old is not None and set(old.columns) == set(df.columns) and digest(old.select(*df.columns)) == digest(df):
        return False
    replace(df, path)
    return True


def publish_all(outputs: dict[str, DataFrame], root: str) -> dict[str, str]:
    """SNK13: every output under its name, written if changed; tables of other names are deleted. Says what was done to each."""
    done, spark = {}, None
    for name, df in outputs.items():
        spark = df.sparkSession
        done[name] = "written" if write_if_changed(df, f"{root}/{name}") else "unchanged"
    for f in _fs(spark, root).listStatus(_path(spark, root)) if spark else []:
        if (name := f.getPath().getName()) not in outputs:
            _fs(spark, root).delete(f.getPath(), True)
            done[name] = "deleted"
    return done


def stale(outputs: dict[str, DataFrame], root: str) -> list[str]:
    """SNK14: outputs whose table is missing or holds other rows than it should."""
    out = []
    for name, df in outputs.items():
        old = current(df.sparkSession, f"{root}/{name}")
        if old is None or set(old.columns) != set(df.columns) or digest(old.select(*df.columns)) != digest(df):
            out.append(name)
    return out


def prune(spark: SparkSession, paths: list[str], dry_run: bool = True) -> list[str]:
    """SNK19: deletes files, found by views.orphans, unless it only says which."""
    for p in [] if dry_run else paths:
        _fs(spark, p).delete(_path(spark, p), False)
    return sorted(paths)


# --- canonical documents -----------------------------------------------------------------------

# The order of keys in documents of each kind; what isn't named comes after, as it stands.
SOURCE_KEYS = ["kind", "video", "t", "frame", "crop", "panel", "confidence", "reader", "readings", "build", "talentId", "reviewed", "reviewedBy", "reviewedAt", "note"]
TALENT_KEYS = ["id", "name", "row", "col", "maxRank", "icon", "iconSource", "iconCrop", "description", "ranks", "ranksObserved", "ranksSource", "ranksPrior", "ranksNote", "requires", "capstone", "spellIds", "tags", "source"]
KEYS = {
    "class": {
        "": ["$schema", "schemaVersion", "class", "className", "dataVersion", "dataSource", "generatedAt", "rules", "pages", "trees", "notes"], "rules": ["pointsPerRow", "maxPoints", "firstPointLevel", "maxLevel", "pointsPerPage", "rulesSource"],
        "pages": ["id", "name", "note"], "trees": ["id", "name", "page", "order", "icon", "background", "rows", "cols", "role", "datamined", "source", "talents"], "datamined": ["talentTabId", "build"], "talents": TALENT_KEYS,
        "requires": ["talent", "rank"], "ranksPrior": ["classicTalentId", "classicSpellIds", "match", "similarity"], "source": SOURCE_KEYS, "readings": ["reader", "name", "description", "maxRank", "confidence"],
    },
    "overrides": {"": ["$schema", "schemaVersion", "class", "overrides"], "overrides": ["talent", "tree", "set", "unset", "rename", "delete", "add", "reason", "by", "at"], "set": TALENT_KEYS, "add": TALENT_KEYS, "requires": ["talent", "rank"], "source": SOURCE_KEYS},
    "race": {
        "": ["$schema", "schemaVersion", "race", "raceName", "faction", "dataSource", "generatedAt", "variants", "classes", "classesSource", "lore", "loreComplete", "loreSource", "traits", "complete", "notes"],
        "variants": ["id", "name", "faction", "classes", "lore", "loreComplete"], "traits": ["id", "name", "kind", "order", "variants", "description", "icon", "iconSource", "iconCrop", "classic", "tags", "source"],
        "classic": ["status", "classicName", "classicText", "note"], "source": SOURCE_KEYS, "classesSource": SOURCE_KEYS, "loreSource": SOURCE_KEYS, "readings": ["reader", "name", "description", "confidence"],
    },
    "spell": {"": ["$schema", "schemaVersion", "class", "tabs", "spells"], "classic": ["status", "classicName", "classicText", "note"], "source": SOURCE_KEYS},
}
#: By which fields a list's objects are sorted.
SORTED = {"class": {"talents": lambda t: (t.get("row", 0), t.get("col", 0))}, "race": {"traits": lambda t: (t.get("order", 0),)}, "spell": {"tabs": lambda t: (t.get("order", 10**6), t.get("id", "")), "spells": lambda s: (s.get("tab") or "~", s.get("id", ""), min(s.get("ranksSeen") or [0])), "tooltips": lambda t: (t.get("rank") or 0, t.get("description", ""))}}
INLINE = 100


def arranged(value, kind: str, field: str = ""):
    """SNK6-SNK9: a document with its keys and lists in canonical order."""
    if isinstance(value, list):
        items = [arranged(v, kind, field) for v in value]
        by = SORTED.get(kind, {}).get(field)
        return sorted(items, key=by) if by and all(isinstance(v, dict) for v in items) else items
    if not isinstance(value, dict):
        return value
    place = {k: i for i, k in enumerate(KEYS[kind].get(field, ()))}
    return {k: arranged(value[k], kind, k) for k in sorted(value, key=lambda k: place.get(k, len(place)))}


def document_text(value, kind: str | None = None) -> str:
    """SNK4, SNK5: two blanks of indent, lists without objects on one line where that has at most INLINE characters, a final newline.

    Such lists are taken out first, each leaving a mark, the rest is written with an indent, and the lists are put back.
    """
    lines: list[str] = []

    def objects(v) -> bool:
        return isinstance(v, dict) or isinstance(v, list) and any(map(objects, v))

    def marked(v):
        if isinstance(v, list) and v and not objects(v) and len(flat := json.dumps(v, ensure_ascii=False)) <= INLINE:
            lines.append(flat)
            return f"\x00{len(lines) - 1}\x00"
        return [marked(x) for x in v] if isinstance(v, list) else {k: marked(x) for k, x in v.items()} if isinstance(v, dict) else v

    text = json.dumps(marked(value if kind is None else arranged(value, kind)), indent=2, ensure_ascii=False)
    for i, flat in enumerate(lines):
        text = text.replace(f'"\\u0000{i}\\u0000"', flat, 1)
    return text + "\n"


def override_text(entries: list[dict]) -> str:
    """SNK21: override entries to paste, one after the other."""
    return ",\n".join(document_text(arranged(e, "overrides", "overrides")).rstrip("\n") for e in entries)


def markdown(title: str, facts: dict[str, object], tables: dict[str, DataFrame], most: int = 60) -> str:
    """A report: a title, facts as a list, and each table under a heading with its count.

    A table shows its first ``most`` rows in the order of its columns and says how many more there are;
    numbers stand right. Nulls are empty, upright bars and line ends are escaped.
    """
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    out = [f"# {title}", "", *(f"- {k}: {v}" for k, v in facts.items())]
    for heading, df in tables.items():
        n = df.count()
        out += ["", f"## {heading} ({n})", ""]
        if not n:
            out.append("None.")
            continue
        right = [t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal") for _, t in df.dtypes]
        rows = [[cell(v) for v in r] for r in df.orderBy(*df.columns).limit(most).collect()]
        out += ["| " + " | ".join(r) + " |" for r in [df.columns, ["---:" if x else "---" for x in right], *rows]]
        if n > most:
            out += ["", f"... {n - most} more"]
    return "\n".join(out) + "\n"
