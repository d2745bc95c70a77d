"""Chat formatting: tool calls linked to their results, in an order that can be replayed, validated and in canonical JSON.

Calls and results meet in a hash join on conversation and identifier. An argument ``{"$ref": "<id>"}`` refers to the result
of another call of the conversation; the levels of the reference graph (0: refers to nothing; else one more than the highest
level referred to) give a topological order, so (level, turn, call_id) is an order in which every call follows what it
needs. Arguments are held against the schemas of the tools; each call becomes one JSON text with sorted keys.

Only DataFrame functions are used. No conversation is ever collected: results are one row per call, so a conversation
with a third of all rows is spread like any other. Levels take as many rounds as the longest chain of references has links.

Rows: of calls with equal conversation and identifier the earliest (then smallest) counts, of results likewise; a null
conversation is a conversation; a null identifier links with nothing and keeps its row; arguments that are null or not a
JSON object are a problem, not an error; references to nothing and circles are problems (calls in or behind a circle have
no level); results without a call are given out as ``orphan``; further columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import store

#: tool, parameter, type (string, number, boolean, object, array), whether it must be there
SCHEMAS = [
    ("search", "query", "string", True), ("search", "limit", "number", False), ("search", "after", "object", False),
    ("summarise", "query", "string", True), ("summarise", "limit", "number", True), ("summarise", "exact", "boolean", False), ("summarise", "after", "object", False),
    ("translate", "query", "string", True), ("translate", "exact", "boolean", True), ("translate", "after", "object", False),
]


def _kind(value: Column) -> Column:
    """JSON kind of a variant value."""
    told = F.schema_of_variant(value)
    return (
        F.when(told.startswith("OBJECT"), "object").when(told.startswith("ARRAY"), "array").when(told == "STRING", "string")
        .when(told == "BOOLEAN", "boolean").when(told == "VOID", "null").otherwise("number")
    )


def levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv, id, level) of calls (conv, id) under edges (conv, id, needs); no row for calls in or behind a circle."""
    open_ = store(edges, "edges")
    waiting = open_.select("conv", "id").distinct()
    done = calls.alias("a").join(waiting.alias("b"), F.col("a.conv").eqNullSafe(F.col("b.conv")) & (F.col("a.id") == F.col("b.id")), "left_anti")
    fresh = store(done.select("conv", "id", F.lit(0).alias("level")), "levels")
    known = fresh
    while not open_.isEmpty():
        new = known.select(F.col("conv").alias("k_conv"), F.col("id").alias("k_id"), "level")
        met = open_.join(new, F.col("conv").eqNullSafe(F.col("k_conv")) & (F.col("needs") == F.col("k_id")), "left")
        ready = met.groupBy("conv", "id").agg(F.count("*").alias("n"), F.count("level").alias("have"), F.max("level").alias("level"))
        fresh = store(ready.where("n = have").select("conv", "id", (F.col("level") + 1).alias("level")), "levels")
        if fresh.isEmpty():
            break
        known = known.union(fresh)
        got = fresh.select(F.col("conv").alias("g_conv"), F.col("id").alias("g_id"))
        open_ = store(open_.join(got, F.col("conv").eqNullSafe(F.col("g_conv")) & (F.col("id") == F.col("g_id")), "left_anti"), "edges")
    return known


def link(spark: SparkSession, calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call (and per result without one): conv_id, call_id, turn, name, level, status, problems, json.

    calls: conv_id, turn, call_id, name, arguments (JSON text); results: conv_id, turn, call_id, content;
    schemas: tool, parameter, kind, required.
    """
    calls = calls.select(F.col("conv_id").alias("conv"), F.col("call_id").alias("id"), "turn", "name", "arguments")
    nameless = calls.where("id is null")
    named = calls.where("id is not null").groupBy("conv", "id").agg(F.min(F.struct("turn", "name", "arguments")).alias("first")).select("conv", "id", "first.*")
    named = store(named, "calls")
    answers = results.where("call_id is not null").groupBy(F.col("conv_id").alias("r_conv"), F.col("call_id").alias("r_id")).agg(F.min(F.struct("turn", "content")).alias("answer"))

    # References: edges to calls that exist; the others are problems.
    wanted = named.select("conv", "id", F.explode(F.array_distinct(F.regexp_extract_all("arguments", F.lit(r'\{\s*"\$ref"\s*:\s*"([^"]*)"\s*\}'), 1))).alias("needs"))
    target = named.select(F.col("conv").alias("t_conv"), F.col("id").alias("t_id"))
    wanted = wanted.join(target, F.col("conv").eqNullSafe(F.col("t_conv")) & (F.col("needs") == F.col("t_id")), "left")
    wanted = store(wanted.select("conv", "id", "needs", F.col("t_id").isNotNull().alias("exists")), "wanted")
    level = levels(named.select("conv", "id"), wanted.where("exists").select("conv", "id", "needs"))
    loose = wanted.where("not exists").groupBy(F.col("conv").alias("u_conv"), F.col("id").alias("u_id")).agg(F.sort_array(F.collect_set("needs")).alias("unknown"))  # bounded by one call's text

    # Arguments against the schema of the tool; a tool has few parameters.
    tools = schemas.groupBy(F.col("tool").alias("s_tool")).agg(F.sort_array(F.collect_list(F.struct("parameter", "kind", "required"))).alias("expected"))
    level = level.select(F.col("conv").alias("l_conv"), F.col("id").alias("l_id"), "level")
    both = named.join(level, F.col("conv").eqNullSafe(F.col("l_conv")) & (F.col("id") == F.col("l_id")), "left")
    both = both.join(loose, F.col("conv").eqNullSafe(F.col("u_conv")) & (F.col("id") == F.col("u_id")), "left")
    both = both.select("conv", "id", "turn", "name", "arguments", "level", "unknown")
    both = both.union(nameless.select("conv", "id", "turn", "name", "arguments", F.lit(0).alias("level"), F.lit(None).cast("array<string>").alias("unknown")))
    both = both.join(tools, F.col("name") == F.col("s_tool"), "left")
    parsed = F.try_parse_json("arguments")
    both = both.withColumn("parsed", F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed))
    both = both.withColumn("given", F.col("parsed").cast("map<string,variant>"))
    known = F.transform("expected", lambda p: p["parameter"])
    missing = F.filter("expected", lambda p: p["required"] & ~F.array_contains(F.map_keys("given"), p["parameter"]))
    wrong = F.filter("expected", lambda p: F.array_contains(F.map_keys("given"), p["parameter"]) & (_kind(F.element_at("given", p["parameter"])) != p["kind"]))
    extra = F.array_sort(F.filter(F.map_keys("given"), lambda k: ~F.array_contains(known, k)))
    none = F.array().cast("array<string>")
    say = lambda prefix, items: F.coalesce(F.transform(items, lambda x: F.concat(F.lit(prefix), x)), none)
    problems = F.concat(
        F.when(F.col("parsed").isNull(), F.array(F.lit("malformed arguments"))).otherwise(none),
        F.when(F.col("expected").isNull(), F.array(F.lit("unknown tool"))).otherwise(none),
        say("missing ", F.transform(missing, lambda p: p["parameter"])), say("wrong type ", F.transform(wrong, lambda p: p["parameter"])),
        say("unexpected ", extra), say("unknown reference ", F.col("unknown")),
        F.when(F.col("level").isNull(), F.array(F.lit("circle"))).otherwise(none),
    )
    both = both.withColumn("problems", problems)

    met = both.join(answers.hint("shuffle_hash"), F.col("conv").eqNullSafe(F.col("r_conv")) & (F.col("id") == F.col("r_id")), "left")
    status = F.when(F.col("answer").isNull(), "no result").when(F.col("answer.turn") < F.col("turn"), "early result").otherwise("linked")
    shown = F.to_json(F.struct(F.col("parsed").alias("arguments"), F.col("id"), F.col("name"), F.col("answer.content").alias("result")), {"ignoreNullFields": "false"})
    out = met.select(F.col("conv").alias("conv_id"), F.col("id").alias("call_id"), "turn", "name", "level", status.alias("status"), F.array_join("problems", "; ").alias("problems"), shown.alias("json"))
    lone = answers.join(target, F.col("r_conv").eqNullSafe(F.col("t_conv")) & (F.col("r_id") == F.col("t_id")), "left_anti")
    text = lambda: F.lit(None).cast("string")
    return out.union(lone.select("r_conv", "r_id", "answer.turn", text(), F.lit(None).cast("int"), F.lit("orphan"), F.lit(""), F.to_json(F.struct(F.col("r_id").alias("id"), F.col("answer.content").alias("result")), {"ignoreNullFields": "false"})))


def schema_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SCHEMAS, "tool string, parameter string, kind string, required boolean")


def calls_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results in the form that ``link`` takes, read off plain conversations.

    Every assistant turn calls a tool that its length picks, with its whole text as the query (line breaks and quotes are
    escaped); from the fourth turn on it needs the call at about half its turn. The next turn of anybody else is the result.
    """
    n, turn = F.length("text"), F.col("turn")
    name = F.element_at(F.array(F.lit("search"), F.lit("summarise"), F.lit("translate")), (n % 3 + 1).cast("int"))
    half = F.floor((turn - 1) / 2)
    needs = half + F.when(half % 2 == 0, 1).otherwise(0)
    query = F.to_json(F.struct(F.col("text").alias("query")))  # {"query":"..."}
    inner = F.expr("substring(query_json, 2, length(query_json) - 2)")
    base = conversations.select("conv_id", "turn", "role", "text").where("text is not null").withColumn("query_json", query)
    limit = F.when(n % 7 == 0, F.concat(F.lit('"limit":"'), n.cast("string"), F.lit('"'))).when(n % 3 != 2, F.concat(F.lit('"limit":'), n.cast("string")))
    exact = F.when((n % 3 != 0) & (n % 11 != 0), F.concat(F.lit('"exact":'), F.when(n % 2 == 0, "true").otherwise("false")))
    other = F.when(n % 13 == 0, F.lit('"mode": null'))
    after = F.when(turn >= 3, F.concat(F.lit('"after": {"$ref": "c'), needs.cast("string"), F.lit('"}')))
    arguments = F.concat(F.lit("{"), F.concat_ws(", ", inner, other, limit, exact, after), F.lit("}"))
    calls = base.where("role = 'assistant'").select("conv_id", "turn", F.concat(F.lit("c"), turn.cast("string")).alias("call_id"), name.alias("name"), arguments.alias("arguments"))
    results = base.where("role <> 'assistant' and turn > 0").select("conv_id", "turn", F.concat(F.lit("c"), (turn - 1).cast("string")).alias("call_id"), F.col("text").alias("content"))
    return calls, results
