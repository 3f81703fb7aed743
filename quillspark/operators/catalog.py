"""From specifications to catalog tables: operations, parameters, media, security, tags.

``specs``: source, spec_json. Names that are keys in the document (paths, statuses, media
types) become rows; nothing is inferred. A fragment stays JSON text, and its JSON type is
checked before a value is read from it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators import jsonwalk
from quillspark.operators.harvest import HTTP_METHODS
from quillspark.sources.stages import written

SECTIONS = ("schemas", "parameters", "requestBodies", "responses", "securitySchemes")
LOCATIONS = ("path", "query", "header", "cookie")
DESCRIPTION_CHARS = 500
#: Keys that a part of a list's requests, or a task of lists, gives out: about 500 MB of text.
PART_KEYS = 10_000_000
#: Beyond so many tasks they give out more, so copies of lists and the driver's tasks don't grow with the square of the input.
PART_TASKS = 4000

_MAP = "map<string,variant>"


def _variant(text: Column) -> Column:
    return F.try_parse_json(text)


def _kind(v: Column) -> Column:
    """object, array, string, boolean, number, null or missing."""
    s = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), "missing").when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "STRING", "string")
        .when(s == "BOOLEAN", "boolean").when(s == "VOID", "null").otherwise("number")
    )


def _get(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$['{key}']", "variant")


def _text(v: Column, key: str) -> Column:
    """The string at ``key``; null if it isn't one."""
    x = _get(v, key)
    return F.when(_kind(x) == "string", F.try_variant_get(x, "$", "string"))


def _true(v: Column, key: str) -> Column:
    """Whether the value at ``key`` is literally true."""
    x = _get(v, key)
    return F.coalesce((_kind(x) == "boolean") & F.try_variant_get(x, "$", "boolean"), F.lit(False))


def _entries(text: Column) -> Column:
    """Key and value text of a JSON object, in the order of the document."""
    return F.map_entries(F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>")))


def _items(text: Column) -> Column:
    """Texts of a JSON array's elements."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def _field(text: Column, key: str) -> Column:
    """Text of one field, nested values as they stand in the document."""
    return F.from_json(text, f"struct<`{key}`: string>")[key]


def paths(specs: DataFrame) -> DataFrame:
    """source, path, item (text) of every path item."""
    rows = specs.select("source", F.explode(_entries(_field(F.col("spec_json"), "paths"))).alias("p"))
    return rows.select("source", F.col("p.key").alias("path"), F.col("p.value").alias("item"))


def components(specs: DataFrame) -> DataFrame:
    """source, section, name, node (text) of every named component."""
    each = F.array(*[F.struct(F.lit(s).alias("section"), _field(_field(F.col("spec_json"), "components"), s).alias("body")) for s in SECTIONS])
    rows = specs.select("source", F.explode(each).alias("c"))
    return rows.select("source", "c.section", F.explode(_entries(F.col("c.body"))).alias("e")).select("source", "section", F.col("e.key").alias("name"), F.col("e.value").alias("node"))


def _raw_operations(specs: DataFrame) -> DataFrame:
    """source, path, method, key, op (text), item: one row for each method of a path item.

    One source is one input row, so rows are dealt anew once paths are apart."""
    items = paths(specs).repartition("source", "path")
    v = _variant(F.col("item"))
    usable = items.where((_kind(v) == "object") & (_kind(_get(v, "$ref")) == "missing"))
    each = usable.select("source", "path", "item", F.explode(F.array(*[F.struct(F.lit(m).alias("m"), _field(F.col("item"), m).alias("op")) for m in HTTP_METHODS])).alias("x"))
    rows = each.select("source", "path", F.upper("x.m").alias("method"), F.col("x.op").alias("op"), "item").where(_kind(_variant(F.col("op"))) == "object")
    return rows.withColumn("key", F.concat_ws(":", "source", "method", "path"))


def _deref(rows: DataFrame, comps: DataFrame, section: str, column: str) -> DataFrame:
    """Replaces a local reference into ``section`` by its target; other references stay."""
    prefix = f"#/components/{section}/"
    ref = _text(_variant(F.col(column)), "$ref")
    name = F.when(ref.startswith(prefix), F.substring(ref, len(prefix) + 1, 10000))
    target = comps.where(F.col("section") == section).select(F.col("source").alias("_s"), F.col("name").alias("_n"), F.col("node").alias("_node")).where(_kind(_variant(F.col("_node"))) == "object")
    j = rows.withColumn("_ref", name).join(target, (F.col("source") == F.col("_s")) & (F.col("_ref") == F.col("_n")), "left")
    return j.withColumn(column, F.coalesce("_node", column)).drop("_ref", "_s", "_n", "_node")


def _parameter_rows(raw: DataFrame, comps: DataFrame) -> DataFrame:
    """All parameters before merging: level 0 from the path item, 1 from the operation."""
    level = lambda n, col: F.transform(_items(_field(F.col(col), "parameters")), lambda x, i: F.struct(F.lit(n).alias("level"), i.alias("pos"), x.alias("node")))
    path_list = F.when(_kind(_get(_variant(F.col("item")), "parameters")) == "array", level(0, "item")).otherwise(level(0, "item").cast("array<struct<level:int,pos:int,node:string>>"))
    rows = raw.select("source", "key", F.explode(F.concat(path_list, level(1, "op"))).alias("p")).select("source", "key", "p.level", "p.pos", "p.node")
    d = _deref(rows, comps, "parameters", "node")
    v = _variant(F.col("node"))
    where = _text(v, "in")
    required = _get(v, "required")
    # as a truth value: anything but false, null, 0 and empty values
    truthy = F.when(_kind(required) == "boolean", F.try_variant_get(required, "$", "boolean")).otherwise(~_kind(required).isin("missing", "null") & ~F.to_json(required).isin("0", '""', "[]", "{}"))
    return d.select(
        "source", "key", "level", "pos", _text(v, "name").alias("name"), where.alias("location"), (F.col("node").isNotNull() & (where == "path") | F.coalesce(truthy, F.lit(False))).alias("required"),
        _text(v, "description").alias("description"), F.when(_kind(_get(v, "schema")) == "object", _field(F.col("node"), "schema")).alias("schema_json"), _true(v, "deprecated").alias("deprecated"),
        (_text(v, "name").isNull() | ~F.coalesce(where.isin(*LOCATIONS), F.lit(False))).alias("invalid"),
    )


def _skipped(raw: DataFrame, params: DataFrame) -> DataFrame:
    """Keys of operations that can't be read: parameters no list, or one invalid."""
    kind = _kind(_get(_variant(F.col("op")), "parameters"))
    return raw.where(~kind.isin("missing", "array")).select("key").union(params.where("invalid").select("key")).distinct()


def normalize(specs: DataFrame) -> dict[str, DataFrame]:
    """All catalog tables of the given specifications. Documents are taken apart once, whatever
    tables are read of them and how often."""
    comps = written(components(specs))
    raw = written(_raw_operations(specs))
    params = written(_parameter_rows(raw, comps))
    skipped = written(_skipped(raw, params))
    good = raw.join(skipped, "key", "left_anti")
    top = specs.select("source", _field(F.col("spec_json"), "security").alias("_security"))
    v = _variant(F.col("op"))
    scopes_raw = _get(v, "x-oauth2-scopes")
    operations = good.select(
        "source", "key", "method", "path", _text(v, "operationId").alias("operation_id"), _text(v, "summary").alias("summary"), _text(v, "description").alias("description"),
        F.when(_kind(_get(v, "tags")) == "array", _items(_field(F.col("op"), "tags"))).otherwise(F.array().cast("array<string>")).alias("tags"),
        _true(v, "deprecated").alias("deprecated"), _true(v, "x-experimental").alias("experimental"),
        F.when(_kind(scopes_raw) == "array", scope_list(_field(F.col("op"), "x-oauth2-scopes"))).otherwise(F.array().cast("array<string>")).alias("oauth2_scopes"),
    )
    return {
        "operations": operations,
        "parameters": merge_parameters(params.join(skipped, "key", "left_anti")),
        "body_media": body_media(good, comps),
        "responses": responses(good, comps),
        "response_media": response_media(good, comps),
        "security": security(good, top),
        "components": comps.withColumn("node", jsonwalk.strip_examples(F.col("node"), False)),
        "tags": tags(specs, operations),
        "warnings": warnings(specs, raw, skipped),
    }


def scope_list(text: Column) -> Column:
    """Scopes from strings and objects with ``scopes``, distinct in order of appearance."""
    one = lambda x: F.when(x.startswith("{"), F.when(F.ltrim(_field(x, "scopes")).startswith("["), _items(_field(x, "scopes"))).otherwise(F.array(_field(x, "scopes")))).otherwise(F.array(x))
    return F.filter(F.array_distinct(F.flatten(F.transform(_items(text), one))), lambda s: s.isNotNull())


def merge_parameters(params: DataFrame) -> DataFrame:
    """An operation's parameter replaces the path's of the same name and location, but keeps
    the place of the first."""
    key = ["source", "key", "name", "location"]
    last = F.max_by(F.struct("required", "description", "schema_json", "deprecated"), F.struct("level", "pos"))
    merged = params.groupBy(*key).agg(last.alias("p"), F.min(F.struct("level", "pos")).alias("first"))
    pos = F.row_number().over(Window.partitionBy("key").orderBy("first")) - 1
    return merged.select("source", "key", pos.alias("pos"), "name", "location", "p.required", "p.description", jsonwalk.strip_examples(F.col("p.schema_json")).alias("schema_json"), "p.deprecated")


def _media(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Content types of ``node`` in order, each with its schema."""
    e = rows.select(*keep, F.posexplode(_entries(F.when(_kind(_get(_variant(F.col("node")), "content")) == "object", _field(F.col("node"), "content")))).alias("pos", "e"))
    schema = F.when(_kind(_get(_variant(F.col("e.value")), "schema")) == "object", _field(F.col("e.value"), "schema"))
    return e.select(*keep, "pos", F.col("e.key").alias("content_type"), jsonwalk.strip_examples(schema).alias("schema_json"))


def body_media(good: DataFrame, comps: DataFrame) -> DataFrame:
    rows = _deref(good.select("source", "key", _field(F.col("op"), "requestBody").alias("node")).where("node is not null"), comps, "requestBodies", "node")
    return _media(rows.withColumn("body_required", _true(_variant(F.col("node")), "required")), ["source", "key", "body_required"])


def _response_nodes(good: DataFrame, comps: DataFrame) -> DataFrame:
    e = good.select("source", "key", F.posexplode(_entries(F.when(_kind(_get(_variant(F.col("op")), "responses")) == "object", _field(F.col("op"), "responses")))).alias("response_pos", "e"))
    rows = e.select("source", "key", "response_pos", F.col("e.key").alias("status"), F.col("e.value").alias("node"))
    return _deref(rows, comps, "responses", "node").where(_kind(_variant(F.col("node"))) == "object")


def responses(good: DataFrame, comps: DataFrame) -> DataFrame:
    return _response_nodes(good, comps).select("source", "key", F.col("response_pos").alias("pos"), "status", _text(_variant(F.col("node")), "description").alias("description"))


def response_media(good: DataFrame, comps: DataFrame) -> DataFrame:
    return _media(_response_nodes(good, comps), ["source", "key", "status"])


def security(good: DataFrame, top: DataFrame) -> DataFrame:
    """One row for each scheme of each alternative; an alternative without schemes (anyone
    may call) is a row with a null scheme. The operation's own value counts if the key is
    there at all, else the document's."""
    own = _kind(_get(_variant(F.col("op")), "security")) != "missing"
    rows = good.join(top, "source", "left").select("source", "key", F.when(own, _field(F.col("op"), "security")).otherwise(F.col("_security")).alias("s"))
    alts = rows.where(_kind(_variant(F.col("s"))) == "array").select("source", "key", F.posexplode(_items(F.col("s"))).alias("alternative", "a")).where(_kind(_variant(F.col("a"))) == "object")
    return alts.select("source", "key", "alternative", F.explode_outer(_entries(F.col("a"))).alias("e")).select("source", "key", "alternative", F.col("e.key").alias("scheme"), F.when(F.col("e.key").isNotNull(), _items(F.col("e.value"))).alias("scopes"))


def tags(specs: DataFrame, operations: DataFrame) -> DataFrame:
    """(source, tag): declared tags and those in use."""
    declared = specs.select("source", F.explode(_items(_field(F.col("spec_json"), "tags"))).alias("t")).select("source", _field(F.col("t"), "name").alias("tag")).where("tag is not null and tag <> ''")
    return declared.union(operations.select("source", F.explode("tags").alias("tag"))).distinct()


def warnings(specs: DataFrame, raw: DataFrame, skipped: DataFrame) -> DataFrame:
    """(source, kind, path, method) of what was left out or ignored."""
    none = F.lit(None).cast("string").alias("method")
    items = paths(specs)
    v = _variant(F.col("item"))
    bad = items.where(_kind(v) != "object").select("source", F.lit("path_item_invalid").alias("kind"), "path", none)
    ref = items.where((_kind(v) == "object") & (_kind(_get(v, "$ref")) != "missing")).select("source", F.lit("path_item_ref_unsupported").alias("kind"), "path", none)
    lost = raw.join(skipped, "key", "left_semi").select("source", F.lit("operation_skipped").alias("kind"), "path", "method")
    flag = _kind(_get(_variant(F.col("op")), "x-experimental"))
    odd = raw.where(~flag.isin("missing", "null", "boolean")).select("source", F.lit("experimental_value_ignored").alias("kind"), "path", "method")
    scopes = _kind(_get(_variant(F.col("op")), "x-oauth2-scopes"))
    shape = raw.where(~scopes.isin("missing", "null", "array")).select("source", F.lit("oauth2_scopes_shape_ignored").alias("kind"), "path", "method")
    return bad.union(ref).union(lost).union(odd).union(shape)


def is_partial(warnings: DataFrame) -> DataFrame:
    return warnings.groupBy("source").agg(F.bool_or(F.col("kind") == "operation_skipped").alias("partial"))


def resolve(requests: DataFrame, operations: DataFrame, shown: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """(request_id, key, error, candidates) of references by key, or by operation id and
    maybe source: operation_not_found without a match, ambiguous with several. ``shown`` is what
    candidates are given as, made once for each list.

    Writers guess from the rows so far how many more they can hold, so rows with lists are in tasks
    of their own, the longest lists first. Requests of one list are dealt in parts, each with a copy of it."""
    known = operations.select(F.col("key").alias("_k")).distinct()
    # a list is made once for each id, and for each id of a source, however many ask for it
    named = operations.where("operation_id is not null").select("operation_id", "source", "key")
    c = F.array_sort(F.collect_set("key")).alias("_c")
    lists = named.groupBy("operation_id").agg(c).select("operation_id", F.lit(None).cast("string").alias("source"), "_c").union(named.where("source is not null").groupBy("operation_id", "source").agg(c))
    n = F.size("_c")
    lists = written(lists.select(F.monotonically_increasing_id().alias("_list"), F.col("operation_id").alias("_o"), F.col("source").alias("_s"), n.alias("_n"), F.when(n == 1, F.get("_c", F.lit(0))).alias("_one"), F.when(n > 1, shown(F.col("_c"))).alias("candidates")))
    none, no_list = F.lit(None).cast("string"), F.lit(None).cast(lists.schema["candidates"].dataType).alias("candidates")
    by_id = requests.where("key is null and operation_id is not null").join(lists.drop("candidates"), (F.col("operation_id") == F.col("_o")) & F.col("source").eqNullSafe(F.col("_s")), "left")
    by_id = written(by_id.select("request_id", "_list", F.coalesce("_n", F.lit(0)).alias("_n"), "_one"))
    many = by_id.where("_n > 1").withColumn("_first", -F.col("_n"))
    total = many.agg(F.sum(F.col("_n").cast("long"))).first()[0] or 0  # one row
    each = max(PART_KEYS, -(-total // PART_TASKS))
    tasks = max(1, -(-total // each))
    parts = many.groupBy("_list").agg(F.least(F.count("*"), F.ceil(F.count("*") * F.max("_n") / F.lit(each))).alias("_parts"))
    texts = lists.where("_n > 1").join(parts, "_list").select("_list", (-F.col("_n")).alias("_first"), "candidates", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_part"))
    dealt = many.join(parts, "_list").withColumn("_part", F.pmod(F.xxhash64("request_id"), F.col("_parts")))
    by_key = requests.where("key is not null").join(known, F.col("key") == F.col("_k"), "left").select("request_id", F.col("_k").alias("key"), F.when(F.col("_k").isNull(), "operation_not_found").alias("error"), no_list)
    no_argument = requests.where("key is null and operation_id is null").select("request_id", none.alias("key"), F.lit("invalid_argument").alias("error"), no_list)
    one = by_id.where("_n <= 1").select("request_id", F.col("_one").alias("key"), F.when(F.col("_n") == 0, "operation_not_found").alias("error"), no_list)
    at = ["_first", "_list", "_part"]  # tasks are by what comes out, and sorted by these in their order
    ambiguous = dealt.repartition(tasks, *at).join(texts.repartition(tasks, *at).hint("merge"), at).select("request_id", none.alias("key"), F.lit("ambiguous").alias("error"), "candidates")
    return ambiguous.union(by_key).union(no_argument).union(one)


def compact(operations: DataFrame, response_media_rows: DataFrame, chars: int = DESCRIPTION_CHARS) -> DataFrame:
    """Operations with a cut description, whether it was cut, and response content types."""
    types = response_media_rows.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("status", "content_type"))).alias("response_types"))
    return operations.withColumn("truncated", F.coalesce(F.length("description") > chars, F.lit(False))).withColumn("description", F.substring("description", 1, chars)).join(types, "key", "left")


def profile(specs: DataFrame) -> DataFrame:
    """Per source: paths, operations, missing and duplicate operation ids, paths with
    parameters of their own, deprecated operations, schemas."""
    raw = _raw_operations(specs)
    v = _variant(F.col("op"))
    ops = raw.select("source", "path", _text(v, "operationId").alias("id"), _true(v, "deprecated").alias("d"))
    n = ops.groupBy("source").agg(F.count("*").alias("operations"), F.count_if(F.col("id").isNull()).alias("missing_ids"), (F.count("id") - F.countDistinct("id")).alias("duplicate_ids"), F.count_if("d").alias("deprecated"))
    p = paths(specs).groupBy("source").agg(F.count("*").alias("paths"), F.count_if(_kind(_get(_variant(F.col("item")), "parameters")) == "array").alias("paths_with_parameters"))
    s = components(specs).where("section = 'schemas'").groupBy("source").agg(F.count("*").alias("schemas"))
    return p.join(n, "source", "left").join(s, "source", "left").na.fill(0)


def trim(specs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, section, name) of the components that wanted paths (source, path) need, by
    following references round by round until no new one is found."""
    refs = F.regexp_extract_all(F.col("node"), F.lit(r'"\$ref"\s*:\s*"#/components/([^"/]+/[^"]+)"'), 1)
    nodes = components(specs).select("source", F.concat_ws("/", "section", "name").alias("target"), "node")
    edges = nodes.select("source", F.col("target").alias("from"), F.explode(refs).alias("target"))
    start = paths(specs).join(wanted, ["source", "path"], "left_semi").select("source", F.explode(F.regexp_extract_all(F.col("item"), F.lit(r'"\$ref"\s*:\s*"#/components/([^"/]+/[^"]+)"'), 1)).alias("target")).distinct()
    have, new = start, start
    while not new.isEmpty():
        found = new.select("source", F.col("target").alias("from")).join(edges, ["source", "from"]).select("source", "target").distinct()
        new = written(found.join(have, ["source", "target"], "left_anti"))
        have = have.union(new)
    return have.join(nodes, ["source", "target"], "left_semi").select("source", F.split("target", "/")[0].alias("section"), F.regexp_replace("target", "^[^/]*/", "").alias("name"))


def trimmed_specs(specs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, spec_json): specifications with the wanted paths (source, path) only, and the
    components that these need; other members stay. Members are in the order of their names."""
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    member = lambda k, v: F.concat(quoted(k), F.lit(":"), v)
    of = lambda ms: F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(ms)), ","), F.lit("}"))
    items = paths(specs).join(wanted.select("source", "path").distinct(), ["source", "path"], "left_semi").groupBy("source").agg(of(member(F.col("path"), F.col("item"))).alias("_paths"))
    held = components(specs).join(trim(specs, wanted), ["source", "section", "name"], "left_semi")
    parts = held.groupBy("source", "section").agg(of(member(F.col("name"), F.col("node"))).alias("node")).groupBy("source").agg(of(member(F.col("section"), F.col("node"))).alias("_components"))
    rest = specs.select("source", F.explode(F.map_entries(F.map_filter(F.from_json("spec_json", "map<string,variant>"), lambda k, v: ~k.isin("paths", "components")))).alias("e"))
    top = rest.select("source", F.col("e.key").alias("k"), F.to_json("e.value").alias("v")).union(items.select("source", F.lit("paths"), "_paths")).union(parts.select("source", F.lit("components"), "_components"))
    return top.join(items.select("source"), "source", "left_semi").groupBy("source").agg(of(member(F.col("k"), F.col("v"))).alias("spec_json"))
