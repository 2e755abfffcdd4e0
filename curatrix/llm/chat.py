"""Tool-call linking for chat formatting, in DataFrame expressions only.

Messages (conv_id, turn, role, text) become events. An assistant's text that is a JSON object with
`tool_calls` [{id, name, arguments, after}] makes a call of each; a tool's text that is a JSON object with
`tool_call_id` and `content` is a result. Other messages take the same form: a user's message is a call of
the tool `ask` with its text as argument, by the identifier `turn:<turn>`, and an assistant's message is the
result of the turn before. All else is context.

Calls and results are joined by hash on (conv_id, identifier). ``after`` names the calls that a call needs; its
depth is one more than the deepest of these (a result has its call's), so (depth, turn, position) is a topological order. Arguments
are held against the tool's schema. Events are written as canonical JSON: sorted keys, no blanks.

:func:`with_calls` writes the turns of plain conversations as such calls and results.

Defined cases: of calls, or results, with one identifier the first by (turn, position, content) is linked
and the others are `duplicate`, so no pairs of repeated identifiers are made; repeated rows get equal
answers; a null conv_id is a conversation of its own; null turns and texts make events without an
identifier or content; text that is no JSON is an ordinary message; ``after`` naming unknown calls is
passed over, as is that of duplicates; calls on a cycle, or behind one, have a null depth; calls of tools without a schema are invalid;
what isn't a call is valid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, written

#: name, required fields, types of all fields; the tool that ordinary messages call.
SCHEMAS = [("ask", ["text"], {"text": "string"})]
SCHEMA_COLUMNS = "name string, required array<string>, types map<string,string>"
#: What :func:`with_calls` calls; `lookup` has no schema.
TURN_SCHEMAS = [("ask", ["text", "turn"], {"text": "string", "turn": "integer"}), ("search", ["text"], {"text": "string", "turn": "string"})]
#: Schemas are broadcast up to this number; more are joined like any table.
BROADCAST_SCHEMAS = 10_000

_CALL = "array<struct<id string, name string, arguments variant, after array<string>>>"
_NULLS = {"ignoreNullFields": "false"}


def events(messages: DataFrame) -> DataFrame:
    """conv_id, turn, position, kind, id, name, arguments (canonical JSON), after, content."""
    m = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    m = m.withColumn("v", F.when(F.ltrim("text").startswith("{"), F.try_parse_json("text")))
    m = m.withColumn("calls", F.when(F.col("role") == "assistant", F.try_variant_get("v", "$.tool_calls", _CALL))).withColumn("of", F.when(F.col("role") == "tool", F.try_variant_get("v", "$.tool_call_id", "string")))

    def event(kind: str, id: Column, name: Column, arguments: Column, after: Column, content: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), id.cast("string").alias("id"), name.cast("string").alias("name"), arguments.cast("string").alias("arguments"), after.cast("array<string>").alias("after"), content.cast("string").alias("content"))

    null = F.lit(None)
    said = F.transform("calls", lambda c: event("call", c["id"], c["name"], F.to_json(c["arguments"]), c["after"], null))
    result = F.to_json(F.try_variant_get("v", "$.content", "variant"))
    rows = (
        F.when(F.size("calls") > 0, said)
        .when(F.col("of").isNotNull(), F.array(event("result", F.col("of"), null, null, null, result)))
        .when(F.col("role") == "user", F.array(event("call", F.concat(F.lit("turn:"), F.col("turn")), F.lit("ask"), F.to_json(F.struct("text"), _NULLS), null, null)))
        .when(F.col("role") == "assistant", F.array(event("result", F.concat(F.lit("turn:"), F.col("turn") - 1), null, null, null, F.col("text"))))
        .otherwise(F.array(event("context", null, F.col("role"), null, null, F.col("text"))))
    )
    return m.select("conv_id", "turn", F.posexplode(rows).alias("position", "e")).select("conv_id", "turn", "position", "e.*")


def depths(calls: DataFrame) -> DataFrame:
    """key, depth of calls (key, parents' keys in ``after``) that name others which exist.

    Calls with one need hang in chains: pointers jump along these, twice as far each round. Between calls
    with several needs depths spread level by level, each level a join with those that became known last.
    """
    spark = calls.sparkSession
    edges = calls.select("key", F.explode("after").alias("parent")).distinct()
    edges = written(edges.join(calls.select(F.col("key").alias("parent")).distinct().hint("shuffle_hash"), "parent", "left_semi").select("key", "parent"), "needs")
    count = edges.groupBy("key").agg(F.count("*").alias("needs"))
    chain = written(edges.join(count.filter("needs = 1").select("key"), "key", "left_semi").select("key", F.col("parent").alias("to"), F.lit(1).alias("far")), "chain")
    rounds = chain.count().bit_length() + 1
    for _ in range(rounds):  # what still points into a chain after these hangs on a cycle
        on = chain.select(F.col("key").alias("to"), F.col("to").alias("to2"), F.col("far").alias("far2"))
        if chain.join(on, "to", "left_semi").isEmpty():
            break
        chain = written(chain.join(on, "to", "left").select("key", F.coalesce("to2", "to").alias("to"), (F.col("far") + F.coalesce("far2", F.lit(0))).alias("far")), "chain")
    several = edges.join(count.filter("needs > 1").select("key"), "key", "left_semi")
    ends = chain.select(F.col("key").alias("parent"), "to", "far")
    several = written(several.join(ends, "parent", "left").select("key", F.coalesce("to", "parent").alias("parent"), (1 + F.coalesce("far", F.lit(0))).alias("far")), "several")
    roots = edges.select(F.col("parent").alias("key")).distinct().join(count.select("key"), "key", "left_anti").select("key", F.lit(0).cast("long").alias("depth"))
    path = scratch(spark, "depths")
    state, new = several.groupBy("key").agg(F.count("*").alias("open"), F.lit(0).cast("long").alias("depth")), written(roots, "level")
    while not new.isEmpty():
        new.write.mode("append").parquet(path)
        got = several.join(new.select(F.col("key").alias("parent"), "depth"), "parent").groupBy("key").agg(F.count("*").alias("n"), F.max(F.col("depth") + F.col("far")).alias("best"))
        state = written(state.join(got, "key", "left").select("key", (F.col("open") - F.coalesce("n", F.lit(0))).alias("open"), F.greatest("depth", "best").alias("depth")), "state")
        new, state = state.filter("open = 0").select("key", "depth"), state.filter("open > 0")
    known = spark.read.schema("key string, depth long").parquet(path) if not edges.isEmpty() and not roots.isEmpty() else spark.createDataFrame([], "key string, depth long")
    hung = chain.join(known.withColumnRenamed("key", "to"), "to", "left").select("key", (F.col("depth") + F.col("far")).alias("depth"))
    rest = count.filter("needs > 1").select("key").join(known, "key", "left")
    return hung.unionAll(rest.select("key", "depth"))


def fits(arguments: Column, required: Column, types: Column) -> Column:
    """Whether a JSON object has all required fields, none that is not named, and each of its type."""
    fields = F.try_parse_json(arguments).try_cast("map<string,variant>")

    def right(e: Column) -> Column:
        kind, want = F.schema_of_variant(e["value"]), F.element_at(types, e["key"])
        number = (kind == "BIGINT") | (kind == "DOUBLE") | (kind == "FLOAT") | kind.startswith("DECIMAL")
        return F.coalesce(
            F.when(want == "string", kind == "STRING").when(want == "integer", kind == "BIGINT").when(want == "number", number).when(want == "boolean", kind == "BOOLEAN")
            .when(want == "object", kind.startswith("OBJECT")).when(want == "array", kind.startswith("ARRAY")).otherwise(want == "any"),
            F.lit(False),
        )

    ok = F.forall(F.map_entries(fields), right) & (F.size(F.array_except(required, F.map_keys(fields))) == 0)
    return F.coalesce(ok, F.lit(False))


def linked(messages: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """Every event: conv_id, turn, position, kind, call_id, name, depth, status, valid, json."""
    spark: SparkSession = messages.sparkSession
    if schemas is None:
        schemas = spark.createDataFrame(SCHEMAS, SCHEMA_COLUMNS)
    rows = events(messages)
    at = F.struct("turn", "position", "content", "name", "arguments", "after")
    rows = rows.withColumn("key", F.when(F.col("id").isNotNull(), F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), F.col("id"))))
    calls = rows.filter("kind = 'call' and key is not null")
    first = calls.groupBy("key").agg(F.min(at).alias("first_call"))
    result = rows.filter("kind = 'result' and key is not null").groupBy("key").agg(F.min(at).alias("first_result"))
    needs = F.transform("first_call.after", lambda i: F.concat(F.substring_index("key", ":", 1), F.lit(":"), i))
    deep = depths(first.select("key", needs.alias("after"))).withColumn("placed", F.lit(True))
    out = rows.join(first.hint("shuffle_hash"), "key", "left").join(result.hint("shuffle_hash"), "key", "left").join(deep.hint("shuffle_hash"), "key", "left")
    few = schemas.limit(BROADCAST_SCHEMAS + 1).count() <= BROADCAST_SCHEMAS
    named = schemas.groupBy(F.col("name").alias("tool")).agg(F.first("required").alias("required"), F.first("types").alias("types"))
    out = out.join(F.broadcast(named) if few else named, F.when(F.col("kind") == "call", F.col("name")) == F.col("tool"), "left")
    own = F.when(F.col("kind") == "call", F.col("first_call")).when(F.col("kind") == "result", F.col("first_result"))
    other = F.when(F.col("kind") == "call", F.col("first_result")).when(F.col("kind") == "result", F.col("first_call"))
    status = F.when(F.col("kind") == "context", "context").when(F.col("id").isNotNull() & ~own.eqNullSafe(at), "duplicate").when(other.isNotNull(), "linked").otherwise("unlinked")
    of_call = F.to_json(F.struct(F.try_parse_json("arguments").alias("arguments"), "id", "name", F.when(status == "linked", F.col("first_result.content")).alias("result")), _NULLS)
    of_other = F.when(F.col("kind") == "result", F.to_json(F.struct("content", "id"), _NULLS)).otherwise(F.to_json(F.struct("content", F.col("name").alias("role")), _NULLS))
    return out.select(
        "conv_id", "turn", "position", "kind", F.col("id").alias("call_id"), "name",
        F.when(F.col("placed"), F.col("depth")).otherwise(F.lit(0)).cast("int").alias("depth"),
        status.alias("status"), ((F.col("kind") != "call") | fits(F.col("arguments"), F.col("required"), F.col("types"))).alias("valid"),
        F.when(F.col("kind") == "call", of_call).otherwise(of_other).alias("json"),
    )


def with_calls(conversations: DataFrame) -> DataFrame:
    """Plain conversations as messages with tool calls, every row kept.

    A user's turn becomes an assistant's call `call:<turn>` of ask, search or lookup (turn modulo 3) with its
    text and turn as arguments, after the calls of two and four turns before; where turn modulo 6 is 4 or 5
    it repeats the identifier of two turns before, and where turn modulo 7 is 6 it also needs itself. An
    assistant's turn becomes the result of the call one turn before. Others stay as they are.
    """
    turn = F.col("turn").cast("long")
    call = lambda back: F.concat(F.lit("call:"), turn - back)
    same = F.when(turn % 6 >= 4, call(2)).otherwise(call(0))
    after = F.when(turn % 7 == 6, F.array(call(2), call(4), same)).otherwise(F.array(call(2), call(4)))
    name = F.when(turn % 3 == 0, "ask").when(turn % 3 == 1, "search").otherwise("lookup")
    made = F.to_json(F.struct(F.array(F.struct(same.alias("id"), name.alias("name"), F.struct("text", turn.alias("turn")).alias("arguments"), after.alias("after"))).alias("tool_calls")), _NULLS)
    back = F.to_json(F.struct(call(1).alias("tool_call_id"), F.col("text").alias("content")), _NULLS)
    role = F.col("role")
    return conversations.select(
        "conv_id", "turn", F.when(role == "user", "assistant").when(role == "assistant", "tool").otherwise(role).alias("role"),
        F.when(role == "user", made).when(role == "assistant", back).otherwise(F.col("text")).alias("text"),
    )


ORACLE = """
WITH RECURSIVE e AS (
  SELECT conv_id, turn, text, 0 AS position,
         CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'context' END AS kind,
         CASE role WHEN 'user' THEN 'call:' || (turn - CASE WHEN turn % 6 >= 4 THEN 2 ELSE 0 END) WHEN 'assistant' THEN 'call:' || (turn - 1) END AS id,
         CASE role WHEN 'user' THEN CASE turn % 3 WHEN 0 THEN 'ask' WHEN 1 THEN 'search' ELSE 'lookup' END WHEN 'assistant' THEN NULL ELSE role END AS name
  FROM conversations),
o AS (SELECT *, min(turn) OVER (PARTITION BY conv_id, kind, id) AS first FROM e),
c AS (SELECT * FROM o WHERE kind = 'call' AND turn = first),
n AS (SELECT c.conv_id, c.id, p.id AS parent FROM c JOIN c AS p ON p.conv_id = c.conv_id
      AND (p.id = 'call:' || (c.turn - 2) OR p.id = 'call:' || (c.turn - 4) OR c.turn % 7 = 6 AND p.id = c.id)),
walk(conv_id, id, up) AS (SELECT conv_id, id, parent FROM n UNION SELECT w.conv_id, w.id, n.parent FROM walk w JOIN n ON n.conv_id = w.conv_id AND n.id = w.up),
stuck AS (SELECT DISTINCT w.conv_id, w.id FROM walk w WHERE EXISTS (SELECT 1 FROM walk x WHERE x.conv_id = w.conv_id AND x.id = w.up AND x.up = w.up)),
far(conv_id, id, depth) AS (
  SELECT conv_id, id, 0 FROM c WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.conv_id = c.conv_id AND n.id = c.id)
  UNION SELECT n.conv_id, n.id, f.depth + 1 FROM far f JOIN n ON n.conv_id = f.conv_id AND n.parent = f.id AND n.id <> f.id),
d AS (SELECT conv_id, id, max(depth) AS depth FROM far WHERE (conv_id, id) NOT IN (SELECT conv_id, id FROM stuck) GROUP BY ALL),
r AS (SELECT conv_id, id, min_by(text, turn) AS content FROM e WHERE kind = 'result' GROUP BY ALL)
SELECT o.conv_id, o.turn, o.position, o.kind, o.id AS call_id, o.name,
       CASE WHEN o.kind = 'context' OR c.id IS NULL THEN 0 ELSE d.depth END AS depth,
       CASE WHEN o.kind = 'context' THEN 'context' WHEN o.turn <> o.first THEN 'duplicate'
            WHEN o.kind = 'call' AND r.id IS NOT NULL OR o.kind = 'result' AND c.id IS NOT NULL THEN 'linked' ELSE 'unlinked' END AS status,
       o.kind <> 'call' OR o.name = 'ask' AND o.text IS NOT NULL AS valid,
       CAST(CASE o.kind WHEN 'call' THEN to_json({'arguments': {'text': o.text, 'turn': o.turn}, 'id': o.id, 'name': o.name, 'result': CASE WHEN o.turn = o.first THEN CAST(to_json(r.content) AS VARCHAR) END})
                   WHEN 'result' THEN to_json({'content': CAST(to_json(o.text) AS VARCHAR), 'id': o.id})
                   ELSE to_json({'content': o.text, 'role': o.name}) END AS VARCHAR) AS json
FROM o LEFT JOIN r ON r.conv_id = o.conv_id AND r.id = o.id
       LEFT JOIN c ON c.conv_id = o.conv_id AND c.id = o.id
       LEFT JOIN d ON d.conv_id = o.conv_id AND d.id = o.id
"""
