"""Tool-call linking for chats: calls meet their results by identifier, in an order that respects their dependencies.

Calls and results are hash-joined on (conversation, identifier); one conversation is never gathered into a task. A call may name
calls whose results it uses. Where all of them come earlier in the transcript, which is the usual case, the transcript order is
already topological. Only calls that break that order are moved behind what they wait for, by joins that repeat as often as the
longest chain of such calls is long; calls that wait for each other in a circle get no order.
Arguments are checked against a JSON schema per tool, and each link is written as canonical JSON: keys sorted, no spaces.

Defined results: status is ``linked``, ``unanswered`` (no result), ``orphan`` (a result without a call), ``repeated`` (the identifier was
used before in the conversation; the earliest turn counts) or ``circular``; null or unreadable arguments are an error of the
call; a null identifier links with nothing; extra columns are ignored; rows that repeat count as repeated identifiers.
"""
from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracework.llm.repeats import stored

KINDS = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}


def canonical(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def _is(kind: str, value) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, KINDS[kind])


def problems(value, schema: dict, at: str = "") -> list[str]:
    """What keeps a value from fitting a schema, as ``path: reason``; a small, common part of JSON Schema."""
    here = at or "arguments"
    if "type" in schema and not _is(schema["type"], value):
        return [f"{here}: not {schema['type']}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{here}: not in enum")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            out.append(f"{here}: too short")
        if len(value) > schema.get("maxLength", len(value)):
            out.append(f"{here}: too long")
    if _is("number", value):
        if value < schema.get("minimum", value):
            out.append(f"{here}: too small")
        if value > schema.get("maximum", value):
            out.append(f"{here}: too large")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{here}.{k}: missing" for k in sorted(schema.get("required", ())) if k not in value]
        for k in sorted(value):
            if k in known:
                out += problems(value[k], known[k], f"{here}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{here}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += problems(v, schema["items"], f"{here}[{i}]")
    return out


def ordered(calls: DataFrame) -> DataFrame:
    """Sort keys (``at``, ``bump``) of calls (``conv_id``, ``call_id``, ``turn``, ``after``), null for circular ones."""
    keys = calls.select("conv_id", "call_id", F.col("turn").alias("at"), F.lit(0).cast("long").alias("bump"))
    waits = calls.select("conv_id", "call_id", F.explode("after").alias("needs"))
    late = F.struct("at", "bump")

    def moved(keys: DataFrame) -> DataFrame:
        needed = keys.select("conv_id", F.col("call_id").alias("needs"), late.alias("before"))
        last = waits.join(needed, ["conv_id", "needs"]).groupBy("conv_id", "call_id").agg(F.max("before").alias("before"))
        return keys.join(last, ["conv_id", "call_id"]).where(F.col("before") >= late)

    behind = stored(moved(keys), "waiting")
    if behind.isEmpty():
        return keys
    sizes = calls.groupBy("conv_id").agg(F.count("*").alias("calls"))
    while not behind.isEmpty():
        new = behind.select("conv_id", "call_id", F.col("before.at").alias("at2"), (F.col("before.bump") + 1).alias("bump2"))
        keys = keys.join(new, ["conv_id", "call_id"], "left").select("conv_id", "call_id", F.coalesce("at2", "at").alias("at"), F.coalesce("bump2", "bump").alias("bump"))
        # a chain of moves longer than the conversation has calls runs in a circle
        keys = keys.join(sizes, "conv_id").where(F.col("bump") <= F.col("calls")).drop("calls")
        keys = stored(keys, "order")
        behind = stored(moved(keys), "waiting")
    # what waits for a circular call has no order either
    every = calls.select("conv_id", F.col("call_id").alias("needs"))
    while True:
        lost = every.join(keys.select("conv_id", F.col("call_id").alias("needs")), ["conv_id", "needs"], "left_anti")
        stuck = stored(waits.join(lost, ["conv_id", "needs"]).select("conv_id", "call_id").distinct().join(keys, ["conv_id", "call_id"], "left_semi"), "stuck")
        if stuck.isEmpty():
            return keys
        keys = stored(keys.join(stuck, ["conv_id", "call_id"], "left_anti"), "order")


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call or orphan result.

    ``calls``: ``conv_id``, ``call_id``, ``turn``, ``name``, ``arguments`` (JSON), ``after`` (identifiers it waits for).
    ``results``: ``conv_id``, ``call_id``, ``turn``, ``content``.
    Result: ``conv_id``, ``call_id``, ``turn``, ``status``, ``position`` (topological, from 0), ``valid``, ``errors``, ``json``.
    """
    calls = calls.select("conv_id", "call_id", "turn", "name", "arguments", F.coalesce("after", F.array().cast("array<string>")).alias("after"))
    results = results.select("conv_id", "call_id", "turn", "content")

    def first_of(rows: DataFrame, *cols: str) -> DataFrame:
        pick = rows.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", *cols)).alias("r"))
        return pick.select("conv_id", "call_id", "r.*")

    one = first_of(calls, "name", "arguments", "after")
    answer = first_of(results, "content")
    keys = ordered(one)
    both = one.join(answer.withColumnRenamed("turn", "answered"), ["conv_id", "call_id"], "left").join(keys, ["conv_id", "call_id"], "left")
    status = F.when(F.col("at").isNull(), "circular").when(F.col("answered").isNull(), "unanswered").otherwise("linked")
    linked = both.withColumn("status", status)
    place = F.when(F.col("at").isNotNull(), F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("at").isNull(), "at", "bump", "call_id")) - 1)
    linked = linked.select("conv_id", "call_id", "turn", "name", "arguments", "content", "status", place.cast("long").alias("position"))
    # what the first use of an identifier leaves over
    def rest(rows: DataFrame, taken: DataFrame, cols: list[Column]) -> DataFrame:
        n = rows.groupBy("conv_id", "call_id", "turn", *[c for c in rows.columns if c not in ("conv_id", "call_id", "turn")]).agg(F.count("*").alias("n"))
        used = taken.select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"), F.struct(*rows.columns[2:]).alias("r"))
        same = n["conv_id"].eqNullSafe(used["c"]) & n["call_id"].eqNullSafe(used["i"]) & F.struct(*[n[c] for c in rows.columns[2:]]).eqNullSafe(used["r"])
        left = n.join(used, same, "left").withColumn("n", F.col("n") - F.col("c").isNotNull().cast("long"))
        return left.where("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select(*cols)

    nothing = F.lit(None).cast("string")
    repeated = rest(calls, one, [F.col("conv_id"), F.col("call_id"), F.col("turn"), F.col("name"), F.col("arguments"), nothing.alias("content"), F.lit("repeated").alias("status"), F.lit(None).cast("long").alias("position")])
    extra = rest(results, answer.join(one.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_semi"),
                 [F.col("conv_id"), F.col("call_id"), F.col("turn"), nothing.alias("name"), nothing.alias("arguments"), F.col("content"), F.lit("orphan").alias("status"), F.lit(None).cast("long").alias("position")])
    rows = linked.unionByName(repeated).unionByName(extra)

    def write(batches):
        for batch in batches:
            valid, errors, texts = [], [], []
            for r in batch.to_pylist():
                found: list[str] = []
                arguments = None
                if r["status"] != "orphan":
                    try:
                        arguments = json.loads(r["arguments"])
                    except (TypeError, ValueError):
                        found = ["arguments: unreadable"]
                    else:
                        found = problems(arguments, schemas[r["name"]]) if r["name"] in schemas else ["name: unknown tool"]
                valid.append(None if r["status"] == "orphan" else not found)
                errors.append(found)
                call = None if r["status"] == "orphan" else {"arguments": arguments, "name": r["name"]}
                texts.append(canonical({"call": call, "id": r["call_id"], "result": r["content"], "status": r["status"]}))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("conv_id", "call_id", "turn", "status", "position")], pa.array(valid, pa.bool_()), pa.array(errors, pa.list_(pa.string())), pa.array(texts, pa.string())],
                names=["conv_id", "call_id", "turn", "status", "position", "valid", "errors", "json"])

    kinds = rows.schema
    return rows.mapInArrow(write, f"conv_id {kinds['conv_id'].dataType.simpleString()}, call_id string, turn {kinds['turn'].dataType.simpleString()}, status string, position long, "
                                  "valid boolean, errors array<string>, json string")


#: The tools a chat is read with: a user turn asks, the next assistant turn is the answer.
SCHEMAS = {"ask": {"type": "object", "required": ["prompt", "turn"], "additionalProperties": False,
                   "properties": {"prompt": {"type": "string", "minLength": 40}, "turn": {"type": "integer", "minimum": 0, "maximum": 5}}}}


def digest(chats: DataFrame) -> DataFrame:
    """Chat turns as tool calls: each user turn calls ``ask`` and waits for the call before it; an assistant turn answers the turn before."""
    name = F.concat(F.lit("turn-"), F.col("turn").cast("string"))
    calls = chats.where("role = 'user'").select(
        "conv_id", name.alias("call_id"), "turn", F.lit("ask").alias("name"), F.to_json(F.struct(F.col("text").alias("prompt"), "turn")).alias("arguments"),
        F.array(F.concat(F.lit("turn-"), (F.col("turn") - 2).cast("string"))).alias("after"))
    results = chats.where("role = 'assistant'").select("conv_id", F.concat(F.lit("turn-"), (F.col("turn") - 1).cast("string")).alias("call_id"), "turn", F.col("text").alias("content"))
    out = link(calls, results, SCHEMAS)
    return out.select("conv_id", "call_id", "turn", "status", "position", "valid", F.array_join("errors", "; ").alias("errors"), F.sha2("json", 256).alias("json_sha256"))


SQL = r"""
WITH c AS (SELECT conv_id, turn, text, 'turn-' || turn AS call_id FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn, text, 'turn-' || (turn - 1) AS call_id FROM conversations WHERE role = 'assistant'),
cn AS (SELECT *, row_number() OVER (PARTITION BY conv_id, call_id ORDER BY text) AS k FROM c),
an AS (SELECT *, row_number() OVER (PARTITION BY conv_id, call_id ORDER BY text) AS k FROM a),
linked AS (SELECT c.conv_id, c.call_id, c.turn, c.text, a.text AS content, CASE WHEN a.turn IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
                  row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) - 1 AS position
           FROM cn c LEFT JOIN an a ON c.conv_id = a.conv_id AND c.call_id = a.call_id AND a.k = 1 WHERE c.k = 1),
every AS (SELECT * FROM linked
  UNION ALL SELECT conv_id, call_id, turn, text, NULL, 'repeated', NULL FROM cn WHERE k > 1
  UNION ALL SELECT an.conv_id, an.call_id, an.turn, NULL, an.text, 'orphan', NULL FROM an
            LEFT JOIN cn ON cn.conv_id = an.conv_id AND cn.call_id = an.call_id AND cn.k = 1 WHERE an.k > 1 OR cn.conv_id IS NULL),
e AS (SELECT *, CASE WHEN status = 'orphan' THEN '' ELSE concat_ws('; ', CASE WHEN length(text) < 40 THEN 'arguments.prompt: too short' END,
                                                                CASE WHEN turn > 5 THEN 'arguments.turn: too large' END) END AS errors FROM every)
SELECT conv_id, call_id, turn, status, position::BIGINT AS position, CASE WHEN status <> 'orphan' THEN errors = '' END AS valid, errors,
       sha256('{"call":' || CASE WHEN status = 'orphan' THEN 'null' ELSE '{"arguments":{"prompt":' || to_json(text) || ',"turn":' || turn || '},"name":"ask"}' END
              || ',"id":"' || call_id || '","result":' || coalesce(to_json(content)::VARCHAR, 'null') || ',"status":"' || status || '"}') AS json_sha256
FROM e
"""
