"""Tool calls of conversations: linked to their results, ordered, checked and serialised.

* Calls and results are joined by (conv_id, call_id); calls without a result and results without
  a call stay, marked.
* The order is topological: a call comes after those it needs. Depths are raised in rounds of
  joins over all conversations at once, so no conversation is gathered in one task; the number
  of rounds is the depth of the deepest chain. Calls on or behind a cycle have no depth.
* Arguments are parsed as variants and checked against the tool's schema: required and known
  fields and their types.
* The canonical form has sorted keys and no white space.

Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.session import written

# fixed values: tools offered to conversations, by field and type
TOOLS = [
    ("lookup", {"query": "STRING", "words": "BIGINT"}, ["query"]),
    ("measure", {"length": "BIGINT", "short": "BOOLEAN"}, ["length", "short"]),
    ("note", {"text": "STRING"}, ["text", "turn"]),
]


def from_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(calls, results, tools) from turns (conv_id, turn, role, text).

    Every user turn t is a call named ``t``, to a tool chosen by t, with arguments made from its
    text; it needs call t // 2 where that is another turn. The assistant's turn t + 1 is its result.
    """
    spark = turns.sparkSession
    text = F.coalesce("text", F.lit(""))
    first = F.split(text, "[ \n]").getItem(0)
    said = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", text.alias("text"), first.alias("head"))
    arguments = (F.when(F.col("turn") % 6 < 2, F.to_json(F.struct(
                     F.size(F.split("text", " ")).alias("words"), F.col("head").alias("query"))))
                 .when(F.col("turn") % 6 < 4, F.to_json(F.struct(
                     (F.length("text") < 100).alias("short"), F.length("text").alias("length"))))
                 .otherwise(F.to_json(F.struct(F.col("head").alias("text")))))
    name = F.when(F.col("turn") % 6 < 2, "lookup").when(F.col("turn") % 6 < 4, "measure").otherwise("note")
    calls = said.where("role = 'user'").select(
        "conv_id", F.col("turn").cast("string").alias("call_id"), name.alias("name"), arguments.alias("arguments"),
        F.when(F.floor(F.col("turn") / 2) < F.col("turn"), F.array(F.floor(F.col("turn") / 2).cast("string")))
        .otherwise(F.array().cast("array<string>")).alias("needs"))
    results = said.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).cast("string").alias("call_id"), F.col("text").alias("content"))
    tools = spark.createDataFrame(TOOLS, "name string, fields map<string,string>, required array<string>")
    return calls, results, tools


def depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth): 0 without needs, else one more than the deepest call needed.

    Needs that name no call of the conversation are ignored, as are null ids. Calls on a cycle,
    and those that need one, have a null depth.
    """
    nodes = written(calls.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id")
                    .agg(F.count(F.lit(1)).alias("n")).drop("n"), "calls")
    edges = (calls.select("conv_id", "call_id", F.explode("needs").alias("need")).distinct()
             .join(nodes.withColumnRenamed("call_id", "need"), ["conv_id", "need"]))
    edges = written(edges.where("conv_id is not null and call_id is not null"), "needs")
    done = written(nodes.join(edges, ["conv_id", "call_id"], "left_anti").withColumn("depth", F.lit(0)), "depths")
    found, last = done, 0
    while True:
        # a call is ready when none of its needs is open
        still = edges.join(found.select("conv_id", F.col("call_id").alias("need")), ["conv_id", "need"], "left_anti")
        ready = (edges.select("conv_id", "call_id").distinct().join(still, ["conv_id", "call_id"], "left_anti")
                 .join(found, ["conv_id", "call_id"], "left_anti"))
        last += 1
        fresh = written(ready.withColumn("depth", F.lit(last)), "depths")
        if fresh.isEmpty():
            return nodes.join(found, ["conv_id", "call_id"], "left")
        found = written(found.union(fresh), "found")


def checked(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """``calls`` with valid, errors (sorted, comma-joined) and canonical arguments (null if no JSON object)."""
    fields = F.expr("cast(parsed as map<string, variant>)")
    kinds = F.transform_values("args", lambda _, v: F.schema_of_variant(v))
    object_ = F.schema_of_variant("parsed").startswith("OBJECT")
    rows = (calls.withColumn("parsed", F.try_parse_json("arguments"))
            .withColumn("parsed", F.when(object_, F.col("parsed")))
            .withColumn("args", F.when(F.col("parsed").isNotNull(), fields)))
    tools = tools.select(F.col("name").alias("tool"), "fields", "required")
    rows = rows.join(tools, F.col("name") == F.col("tool"), "left").withColumn("kinds", kinds)
    missing = F.transform(F.array_except("required", F.map_keys("kinds")), lambda k: F.concat(F.lit("missing:"), k))
    unknown = F.transform(F.array_except(F.map_keys("kinds"), F.map_keys("fields")), lambda k: F.concat(F.lit("unknown:"), k))
    typed = F.transform(F.map_keys(F.map_filter("kinds", lambda k, v: F.col("fields")[k] != v)),
                        lambda k: F.concat(F.lit("type:"), k))
    errors = (F.when(F.col("tool").isNull(), F.array(F.lit("tool")))
              .when(F.col("args").isNull(), F.array(F.lit("json")))
              .otherwise(F.concat(missing, unknown, typed)))
    return (rows.withColumn("errors", F.array_join(F.array_sort(errors), ","))
            .withColumn("valid", F.col("errors") == "")
            .withColumn("canonical", F.when(F.col("parsed").isNotNull(), F.to_json("parsed")))
            .drop("parsed", "args", "kinds", "tool", "fields", "required"))


def linked(calls: DataFrame, results: DataFrame, tools: DataFrame) -> DataFrame:
    """conv_id, call_id, name, depth, status, valid, errors, arguments, content of every call and result.

    ``status``: linked, no_result, or no_call. A call with several results gives a row for each;
    calls that repeat an id give rows of their own. Null ids join with nothing. ``arguments`` is
    the canonical form. Sorting by (conv_id, depth, call_id) is a topological order. Other columns
    are ignored.
    """
    rows = checked(calls.select("conv_id", "call_id", "name", "arguments"), tools).withColumn("called", F.lit(True))
    order = depths(calls.select("conv_id", "call_id", "needs"))
    said = results.select("conv_id", "call_id", "content").withColumn("answered", F.lit(True))
    return (rows.join(order, ["conv_id", "call_id"], "left").join(said, ["conv_id", "call_id"], "full")
            .select("conv_id", "call_id", "name", "depth",
                    F.when(F.col("called").isNull(), "no_call").when(F.col("answered").isNull(), "no_result")
                    .otherwise("linked").alias("status"),
                    "valid", "errors", F.col("canonical").alias("arguments"), "content"))
