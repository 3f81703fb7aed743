"""References between schemas: edges, their state, bounded closures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators import jsonwalk
from quillspark.sources.stages import written

MAX_DEPTH = 8
MAX_NODES = 2000

_TARGET = jsonwalk.LOCAL_REF


def schema_names(nodes: DataFrame, column: str = "schema_json", max_depth: int = 6) -> DataFrame:
    """Adds ``names``: local references reachable inline in each schema."""
    return nodes.withColumn("names", jsonwalk.ref_names(F.col(column), max_depth))


def edges(components: DataFrame) -> DataFrame:
    """(source, section, name, ref, to_section, to_name, state) of every reference of every
    component; state is ok, missing or external."""
    held = components.select("source", "section", "name", jsonwalk.schema_parts(F.col("node"))["refs"].alias("refs"))
    rows = held.select("source", "section", "name", F.explode("refs.ref").alias("ref"))
    rows = rows.withColumn("to_section", F.nullif(F.regexp_extract("ref", _TARGET, 1), F.lit(""))).withColumn("to_name", F.nullif(F.regexp_extract("ref", _TARGET, 2), F.lit("")))
    have = components.select("source", F.col("section").alias("to_section"), F.col("name").alias("to_name")).withColumn("_has", F.lit(True))
    state = F.when(F.col("to_section").isNull(), "external").when(F.col("_has"), "ok").otherwise("missing")
    return rows.join(have, ["source", "to_section", "to_name"], "left").select("source", "section", "name", "ref", "to_section", "to_name", state.alias("state"))


def closure(edge_rows: DataFrame, roots: DataFrame, max_depth: int = 2) -> DataFrame:
    """(source, root, section, name, depth): what each root (source, section, name) reaches and
    how deep at least, by a frontier join of at most ``max_depth`` rounds. What was reached
    before isn't followed again, so cycles end."""
    ok = edge_rows.where("state = 'ok'").select("source", "section", "name", "to_section", "to_name").distinct()
    root = F.concat_ws("/", "section", "name")
    new = roots.select("source", root.alias("root"), "section", "name", F.lit(0).alias("depth"))
    have = new
    for d in range(1, max_depth + 1):
        found = new.join(ok, ["source", "section", "name"]).select("source", "root", F.col("to_section").alias("section"), F.col("to_name").alias("name")).distinct()
        new = found.join(have, ["source", "root", "section", "name"], "left_anti").withColumn("depth", F.lit(d))
        have = have.union(new)
    return have


def _counted(found: DataFrame, max_nodes: int) -> DataFrame:
    """Adds ``before``, how many nodes could be opened ahead of each reference of its root, and
    ``cut``, the place of the first that the node budget leaves out (null without one)."""
    root = Window.partitionBy("source", "name")
    ahead = root.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = found.withColumn("before", F.coalesce(F.sum(F.col("opens").cast("int")).over(ahead), F.lit(0)))
    return rows.withColumn("cut", F.min(F.when(F.col("opens") & (F.col("before") >= max_nodes), F.col("place"))).over(root))


def expand(roots: DataFrame, components: DataFrame, max_depth: int = 2, max_nodes: int = 200) -> DataFrame:
    """Bounded expansion of each root (source, name) with the exact node budget, depth first.

    A root counts one level, as if it stood behind a reference. What comes first decides: a
    reference that led here is a cycle, one too deep or beyond the budget is truncated, one
    that names nothing known is unresolved. Gives found, schema_json, truncated, unresolved,
    cycles, node_count.

    References are followed level by level, each a join with the references of the schemas
    reached. A reference's ``place`` (the rows it stands at, from the root on) sorts depth first,
    so what is opened ahead of it is a running count. One with ``max_nodes`` ahead of it isn't
    followed: later levels only add to the count, so it stays beyond the budget. A root
    therefore follows ``max_nodes`` references a level at most, whatever it could reach; and
    each component is walked once, whatever the roots."""
    if not (0 <= max_depth <= MAX_DEPTH and 1 <= max_nodes <= MAX_NODES):
        raise ValueError("max_depth must be 0..8 and max_nodes 1..2000")
    depth = min(max_depth + 1, MAX_DEPTH)
    ref_of = lambda section, name: F.concat(F.lit("#/components/"), section, F.lit("/"), name)
    local = components.where(F.col("section").isin(*jsonwalk.SECTIONS) & F.col("node").isNotNull())
    docs = written(local.select("source", ref_of(F.col("section"), F.col("name")).alias("ref"), jsonwalk.schema_parts(F.col("node")).alias("x")).select("source", "ref", "x.*"))
    known = docs.select("source", "ref", F.col("is_object").alias("known"))
    inner = docs.select("source", F.col("ref").alias("holder"), F.explode("refs").alias("r")).select("source", "holder", F.col("r.at").alias("at"), F.col("r.path").alias("inner"), F.col("r.ref").alias("ref"))
    links = written(inner.join(known, ["source", "ref"], "left").withColumn("known", F.coalesce("known", F.lit(False))))

    def told(rows: DataFrame, level: int) -> DataFrame:
        cycle = F.array_contains("trail", F.col("ref"))
        return rows.withColumn("cycle", cycle).withColumn("deep", F.lit(level >= depth)).withColumn("opens", F.col("known") & ~cycle & F.lit(level < depth)).withColumn("level", F.lit(level))

    start = roots.select("source", "name").distinct().withColumn("ref", ref_of(F.lit("schemas"), F.col("name"))).join(known, ["source", "ref"], "left")
    found = start.withColumn("found", F.col("known").isNotNull()).withColumn("known", F.coalesce("known", F.lit(False)))
    asked = written(found.select("source", "name", "found"))
    at_root = [F.lit("").alias("path"), F.array().cast("array<int>").alias("place"), F.array().cast("array<string>").alias("trail")]
    every = last = written(told(found.select("source", "name", "ref", "known", *at_root), 0))
    for level in range(1, depth + 1):
        followed = _counted(every, max_nodes).where((F.col("level") == level - 1) & F.col("opens") & (F.col("before") < max_nodes))
        come = followed.select("source", "name", F.col("ref").alias("holder"), "path", "place", "trail").join(links, ["source", "holder"])
        step = come.select(
            "source", "name", "ref", "known", F.concat("path", "inner").alias("path"),
            F.concat("place", F.array("at")).alias("place"), F.concat("trail", F.array("holder")).alias("trail"),
        )
        last = written(told(step, level))
        if last.isEmpty():
            break
        every = every.union(last)
    holder = F.slice("place", 1, F.size("place") - 1)
    seen = _counted(every, max_nodes).where((F.col("level") == 0) | F.col("cut").isNull() | (holder < F.col("cut")))
    state = (
        F.when(F.col("cycle"), "cycle").when(F.col("deep"), "depth").when(F.col("before") >= max_nodes, "nodes")
        .when(F.col("known"), "open").when(F.col("ref").rlike(jsonwalk.LOCAL_REF), "missing").otherwise("external")
    )
    seen = written(seen.select("source", "name", "ref", "path", "place", state.alias("state")))

    row = lambda at, path, kind, value: F.struct(F.lit(at).alias("at"), F.lit(path).alias("path"), F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    note = F.when(F.col("state") == "cycle", row(2, "/_cycle", "scalar", F.lit("true"))).when(F.col("state").isin("depth", "nodes"), row(2, "/_truncated", "string", F.col("state"))).otherwise(row(2, "/_unresolved", "string", F.col("state")))
    notes = F.array(row(0, "", "object", F.lit(None)), row(1, "/$ref", "string", F.col("ref")), note)
    opened = seen.where("state = 'open'").join(docs.select("source", "ref", "rows"), ["source", "ref"])
    cols = ["source", "name", "path", "place"]
    pieces = opened.select(*cols, F.explode("rows").alias("r")).union(seen.where("state <> 'open'").select(*cols, F.explode(notes).alias("r")))
    lines = F.struct(F.concat("place", F.array("r.at")).alias("place"), F.concat("path", "r.path").alias("path"), F.col("r.kind").alias("kind"), F.col("r.value").alias("value"))
    text = F.transform(F.array_sort(F.collect_list(lines)), lambda x: F.struct(x["path"].alias("path"), x["kind"].alias("kind"), x["value"].alias("value")))
    schemas = pieces.groupBy("source", "name").agg(text.alias("_rows")).select("source", "name", jsonwalk.json_text(F.col("_rows")).alias("schema_json"))
    named = lambda *states: F.array_sort(F.collect_list(F.when(F.col("state").isin(*states), F.struct("place", "ref"))))["ref"]
    told_of = seen.groupBy("source", "name").agg(
        F.max(F.col("state").isin("depth", "nodes")).alias("truncated"), named("missing", "external").alias("unresolved"), named("cycle").alias("cycles"),
        F.sum((F.col("state") == "open").cast("int")).cast("int").alias("node_count"),
    )
    return asked.join(told_of, ["source", "name"]).join(schemas, ["source", "name"]).select("source", "name", "found", "schema_json", "truncated", "unresolved", "cycles", "node_count")
