"""Tool-call linking for chat formatting, in DataFrame functions only.

Calls and results meet by a hash join on conversation and identifier. Calls are
put in topological order of the calls they depend on, their arguments are held
against the tool's schema, and each becomes one canonical JSON object (names
sorted, no blanks).

The turn of a call is a topological order already where every call depends on
earlier turns. Only conversations with another dependency are ordered by rounds:
a call comes one level above its highest dependency, and levels are written to
the shared folder until none changes. The order is (level, turn, call_id).

Cases: a null conversation or identifier links with nothing and is left out; of
calls that repeat an identifier the first (by turn, tool, arguments) counts, of
results the first (by turn, content); a call without a result is ``no_result``,
a result without a call is left out; arguments that are no JSON object, lack a
required name, have a name the schema does not know, or a value of another type
are ``bad_arguments``; a tool without schema is ``unknown_tool``; a dependency on
an absent call is ``missing_dependency``; a call in or behind a circle is
``circular`` and has no level; the first of these faults counts, in the order
unknown_tool, bad_arguments, missing_dependency, circular, no_result. An empty
table gives an empty table; extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampersift.llm.common import ready, store

ID = ["conv_id", "call_id"]


def first_of(df: DataFrame, *order: str) -> DataFrame:
    """One row per conversation and identifier: the least by ``order``."""
    rest = [c for c in df.columns if c not in (*ID, *order)]
    least = F.min(F.struct(*order, *rest)).alias("least")
    known = df.where("conv_id IS NOT NULL AND call_id IS NOT NULL")
    return known.groupBy(*ID).agg(least).select(*ID, "least.*")


def quoted(value: Column) -> Column:
    """A string as JSON."""
    listed = F.to_json(F.array(value))
    return F.substring(listed, F.lit(2), F.char_length(listed) - 2)


def checked(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """``calls`` with canonical arguments (null if no JSON object) and fault
    (null, unknown_tool or bad_arguments). ``schemas``: tool, name, kind (string,
    integer, number, boolean, object or array) and required."""
    spark = calls.sparkSession
    read = calls.withColumn("value", F.try_parse_json("arguments"))
    read = read.withColumn("value", F.when(F.schema_of_variant("value").startswith("OBJECT"), F.col("value")))
    fields = spark.sql("SELECT c.conv_id, c.call_id, c.tool, e.key AS name, schema_of_variant(e.value) AS kind FROM {c} c, LATERAL variant_explode(c.value) e", c=read)
    rules = schemas.where("tool IS NOT NULL AND name IS NOT NULL").select("tool", "name", "kind", "required").dropDuplicates(["tool", "name"])
    kind = (
        F.when(F.col("kind") == "BIGINT", "integer")
        .when(F.col("kind").rlike("^(DECIMAL|DOUBLE|FLOAT)"), "number")
        .when(F.col("kind").rlike("^(STRING|BOOLEAN|OBJECT|ARRAY)"), F.lower(F.regexp_extract("kind", "^[A-Z]+", 0)))
    )
    wanted = rules.withColumnRenamed("kind", "rule")
    fits = F.coalesce((F.col("kind") == F.col("rule")) | ((F.col("rule") == "number") & (F.col("kind") == "integer")), F.lit(False))
    seen = (
        fields.withColumn("kind", kind)
        .join(wanted, ["tool", "name"], "left")
        .groupBy(*ID)
        .agg(
            F.sum(F.when(fits, 0).otherwise(1)).alias("unfit"),
            F.sum(F.when(F.col("required"), 1).otherwise(0)).alias("given"),
        )
    )
    tools = rules.groupBy("tool").agg(F.sum(F.when(F.col("required"), 1).otherwise(0)).alias("needed"))
    fault = F.when(F.col("needed").isNull(), "unknown_tool").when(
        F.col("value").isNull() | (F.coalesce("unfit", F.lit(0)) > 0) | (F.coalesce("given", F.lit(0)) < F.col("needed")), "bad_arguments"
    )
    return (
        read.join(seen, ID, "left")
        .join(tools, "tool", "left")
        .select(*ID, "turn", "tool", F.to_json("value").alias("arguments"), "depends", fault.alias("fault"))
    )


def levelled(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level (null in or behind a circle), missing (a
    dependency is absent) of every call."""
    nodes = calls.select(*ID, "turn")
    edges = calls.select(*ID, "turn", F.explode("depends").alias("on")).where("on IS NOT NULL").distinct()
    ends = nodes.select("conv_id", F.col("call_id").alias("on"), F.col("turn").alias("on_turn"))
    edges = store(edges.join(ends, ["conv_id", "on"], "left"), "dependencies")
    missing = edges.groupBy(*ID).agg(F.max(F.col("on_turn").isNull()).alias("missing"))
    edges = edges.where("on_turn IS NOT NULL")
    mixed = edges.where("on_turn >= turn").select("conv_id").distinct()
    inner = edges.join(mixed, "conv_id", "left_semi").select(*ID, "on")
    left = store(nodes.select(*ID).join(mixed, "conv_id", "left_semi"), "unplaced")
    done = None
    number = 0
    while not left.isEmpty():
        # ready: no dependency is still unplaced
        waiting = inner.join(left.withColumnRenamed("call_id", "on"), ["conv_id", "on"], "left_semi").select(*ID).distinct()
        placed = store(left.join(waiting, ID, "left_anti").withColumn("level", F.lit(number)), "level")
        if placed.isEmpty():
            break
        done = placed if done is None else done.union(placed)
        left = store(left.join(placed, ID, "left_anti"), "unplaced")
        number += 1
    circular = left.withColumn("level", F.lit(None).cast("int"))
    ordered = circular if done is None else done.union(circular)
    plain_nodes = nodes.select(*ID).join(mixed, "conv_id", "left_anti").withColumn("level", F.lit(0))
    return plain_nodes.union(ordered).join(missing, ID, "left").withColumn("missing", F.coalesce("missing", F.lit(False)))


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call: conv_id, call_id, turn, tool, level, status and json.

    ``calls``: conv_id, turn, call_id, tool, arguments (JSON text), depends
    (array of identifiers); ``results``: conv_id, turn, call_id, content.
    """
    ready(calls.sparkSession)
    known = store(
        first_of(calls.select(*ID, "turn", "tool", "arguments", "depends"), "turn", "tool", "arguments"), "calls"
    )
    answers = first_of(results.select(*ID, "turn", "content"), "turn", "content").withColumnRenamed("turn", "answered")
    joined = checked(known, schemas).join(levelled(known), ID).join(answers, ID, "left")
    status = (
        F.when(F.col("fault").isNotNull(), F.col("fault"))
        .when(F.col("missing"), "missing_dependency")
        .when(F.col("level").isNull(), "circular")
        .when(F.col("answered").isNull(), "no_result")
        .otherwise("ok")
    )
    after = F.array_join(F.transform(F.array_sort(F.array_distinct(F.array_compact("depends"))), quoted), ",")
    members = {
        "after": F.concat(F.lit("["), F.coalesce(after, F.lit("")), F.lit("]")),
        "arguments": F.coalesce("arguments", F.lit("null")),
        "id": quoted(F.col("call_id")),
        "level": F.coalesce(F.col("level").cast("string"), F.lit("null")),
        "name": F.coalesce(quoted(F.col("tool")), F.lit("null")),
        "result": F.coalesce(F.when(F.col("content").isNotNull(), quoted(F.col("content"))), F.lit("null")),
        "status": quoted(F.col("status")),
    }
    parts = [F.concat(F.lit(f'"{name}":'), text) for name, text in members.items()]
    json = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    return joined.withColumn("status", status).select(*ID, "turn", "tool", "level", "status", json.alias("json"))
