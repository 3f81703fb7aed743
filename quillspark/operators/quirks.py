"""Headers that operations need beyond their specification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.
CREDENTIAL_HEADERS = ("authorization", "proxy-authorization", "cookie", "set-cookie", "x-api-key", "x-auth-token")


def mine(operations: DataFrame, allowed: list[str]) -> DataFrame:
    """(key, name, value) of allowed headers that descriptions mention as ``Name: value``; the
    first value counts, names are compared without case."""
    each = [operations.select("key", F.lit(h).alias("name"), F.regexp_extract("description", rf"(?i)`?{h}\s*:\s*([A-Za-z0-9_-]+)`?", 1).alias("value")) for h in allowed]
    out = each[0]
    for e in each[1:]:
        out = out.union(e)
    return out.where("value <> ''")


def merge(mined: DataFrame, overrides: DataFrame) -> DataFrame:
    """Mined headers and overrides by lower-cased name: an override replaces, ``suppress``
    takes a mined one away and is reported as suppressed.

    ``overrides``: key, name, action (set or suppress), value, enforcement, value_policy, note."""
    m = mined.select("key", F.lower("name").alias("low"), F.col("name").alias("m_name"), F.col("value").alias("m_value"))
    o = overrides.select("key", F.lower("name").alias("low"), F.col("name").alias("o_name"), "action", F.col("value").alias("o_value"), "enforcement", "value_policy", "note")
    j = m.join(o, ["key", "low"], "full")
    over = F.col("action").isNotNull()
    return j.where((F.coalesce("action", F.lit("set")) != "suppress") | F.col("m_name").isNotNull()).select(
        "key", "low", F.when(over & (F.col("action") != "suppress"), F.col("o_name")).otherwise(F.col("m_name")).alias("name"), F.when(over & (F.col("action") != "suppress"), F.col("o_value")).otherwise(F.col("m_value")).alias("value"),
        F.when(over, F.col("enforcement")).otherwise("advisory").alias("enforcement"), F.when(over, F.col("value_policy")).otherwise("observed").alias("value_policy"),
        F.when(over, "quirk:override").otherwise("quirk:description").alias("origin"), (F.coalesce("action", F.lit("")) == "suppress").alias("suppressed"), "note",
    )


def orphans(overrides: DataFrame, operations: DataFrame) -> DataFrame:
    """Override keys that no operation has."""
    return overrides.select("key").distinct().join(operations.select("key"), "key", "left_anti")


def mentions(operations: DataFrame, allowed: list[str]) -> DataFrame:
    """(key, header): ``X-`` headers that descriptions mention and that aren't mined."""
    found = F.array_distinct(F.regexp_extract_all("description", F.lit(r"\b(X-[A-Za-z0-9-]{2,})\b"), 1))
    return operations.where("description is not null").select("key", F.explode(found).alias("header")).where(~F.lower("header").isin(*[a.lower() for a in allowed]))


def credential_headers(sources: DataFrame, components: DataFrame) -> DataFrame:
    """(source, header): the fixed names, and headers of apiKey schemes, in lower case."""
    fixed = sources.select("source", F.explode(F.array(*map(F.lit, CREDENTIAL_HEADERS))).alias("header"))
    s = components.where("section = 'securitySchemes'").select("source", F.from_json("node", "struct<type: string, `in`: string, name: string>").alias("s"))
    keys = s.where("s.type = 'apiKey' and s.`in` = 'header' and s.name is not null").select("source", F.lower("s.name").alias("header"))
    return fixed.union(keys).distinct()
