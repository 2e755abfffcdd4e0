"""What the operators share: tables, the shared scratch folder, Arrow helpers.

Documents are rows of (doc_id, text, ...). A document is named by its ``doc_id`` together with a
hash of its text (:func:`with_key`), compared null-safely, so that null ids, repeated ids and
repeated rows all keep a defined result: each row gets its own answer, and equal rows get equal
answers.
"""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python words are separated by these six bytes, which is the class [\x20\x09-\x0D].
#: ``bytes.split()`` splits at exactly these, so it yields the words ``[^\x20\x09-\x0D]+``.
BLANKS = b" \t\n\r\x0b\x0c"

#: Rows and bytes that a function handles at once; larger Arrow batches are cut in the worker.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(batches):
    """Arrow batches in parts of at most BATCH_ROWS and about BATCH_BYTES (or one row), without copying.

    Python's memory is bounded by this, and no session setting is touched.
    """
    for batch in batches:
        todo = [batch]
        while todo:
            b = todo.pop()
            if b.num_rows > 1 and (b.num_rows > BATCH_ROWS or b.nbytes > BATCH_BYTES):
                half = b.num_rows // 2
                todo += [b.slice(half), b.slice(0, half)]
            else:
                yield b


def scratch_root(spark: SparkSession) -> str:
    """The cluster's shared folder. In local mode, where all tasks share the machine, one of our own if none is named."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named or "file:///tmp/checkpoints/curatrix"


_STORED: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    _STORED.append(f"{scratch_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}")
    return _STORED[-1]


@contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of a few megabytes while a table is written; the session's settings are then as they were.

    Arrow's buffers lie outside the JVM's heap, several to a task, and default batches may have 64 MB each.
    """
    own = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str(2 * BATCH_BYTES)}
    before = {k: v for k, v in spark.conf.getAll.items() if k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k in own:
            spark.conf.set(k, before[k]) if k in before else spark.conf.unset(k)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder: it outlives any executor."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    with small_batches(spark):
        df.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`written` gave, when what was made from them is written too."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored() -> int:
    """How many tables this driver has stored so far: a mark for :func:`release`."""
    return len(_STORED)


def release(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Delete the tables stored after a mark, but those that ``keep`` reads.

    Frames that are still to be computed from a deleted table fail, so call it when results are stored.
    """
    used = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in (keep.inputFiles() if keep is not None else [])}
    for folder in _STORED[since:]:
        if folder.rsplit("/", 1)[-1] not in used:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def with_key(docs: DataFrame) -> DataFrame:
    """(doc_id, th, text): only what an operator needs, so clashing extra columns do no harm."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))


def same_key(a: DataFrame, b: DataFrame):
    return a.doc_id.eqNullSafe(b.doc_id) & (a.th == b.th)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """A string column as UTF-8 bytes, without a round trip through str."""
    col = batch.column(batch.schema.get_field_index(name))
    kind = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    return col.cast(kind).to_pylist()


def record(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def plain(name: str) -> str:
    """A name that is safe in a path."""
    return re.sub(r"[^A-Za-z0-9_]", "_", name)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names close to ``names`` that no column of ``df`` has, letter case aside."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def sampled(df: DataFrame, key: list[Column], n: int) -> DataFrame:
    """At most ``n`` rows of distinct ``key``: about those with the least hashes, at any size of ``df``.

    The bound on the hash comes from the count, so that no task and no driver ever holds more than about
    ``n`` rows; rows of an equal key count once, so a hot key can't fill the sample.
    """
    (h,) = fresh(df, "hash")
    out, total = df.withColumn(h, F.xxhash64(*key)), df.count()
    if total > n:
        out = out.filter(F.col(h) < int(-(2**63) + 2**64 * (n / total)))
    return out.dropDuplicates([h]).orderBy(h).limit(n).drop(h)


def append(df: DataFrame, fields: list[tuple[str, str]], fn, text: str = "text", after=None) -> DataFrame:
    """``df`` with columns that ``fn`` makes from each Arrow batch of texts.

    fn: gets the texts as UTF-8 bytes (None: null) and returns a list for each of ``fields``
    (name, SQL type). after: called when a partition ends, to free what ``fn`` keeps. Every column
    of ``df`` passes through as it is. Clashing names raise; take them from :func:`fresh`.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T._parse_datatype_string(t)) for n, t in fields)])
    new = [pa.field(n, to_arrow_type(T._parse_datatype_string(t))) for n, t in fields]

    def run(batches):
        try:
            for b in cut(batches):
                made = fn(texts(b, text))
                yield pa.RecordBatch.from_arrays([*b.columns, *(c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(made, new, strict=True))], schema=pa.schema([*b.schema, *new]))
        finally:
            if after is not None:
                after()

    return df.mapInArrow(run, schema)
