"""Open-ended JSON records to rows, with VARIANT; numbers keep the text they were written with (``json_values``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import json_values as J
from strandline.functions.terms import NODE_NS, curie_to_iri, enum_value_iri, float_text, is_curie, json_text, once, plain_literal, typed_literal
from strandline.sources.shared import stored


def _exploded(df: DataFrame, value: str) -> DataFrame:
    """``df`` beside (pos, key, value) of every member of its variant column."""
    return df.lateralJoin(df.sparkSession.tvf.variant_explode(F.col(value).outer()).alias("x"))


def attributes(df: DataFrame, key: str, text: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """(key, attr, value VARIANT) for every attribute that is not null or skipped; numbers are marked strings (see
    ``scalar_text``). Null and blank texts have no attributes; a text that is no JSON is an error. Of repeated keys the
    last stands (the session's setting for that is made here, and stays)."""
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    record = F.when(F.trim(text) != "", J.parsed(text))
    name = J.plain_string(F.col("x.key"))
    out = _exploded(df.select(F.col(key), record.alias("__v")), "__v").select(key, name.alias("attr"), F.col("x.value").alias("value"))
    out = out.where(~F.expr("is_variant_null(value)"))
    return out.where(~F.col("attr").isin(*skip)) if skip else out


def _string(value: str) -> Column:
    return F.expr(f"try_variant_get({value}, '$', 'string')")


def scalar_kind(value: str = "value") -> Column:
    """boolean, integer, double, string, list, object or null. A JSON number with a point or an exponent is a double,
    any other an integer of any length; numbers of a VARIANT that was not made from text go by their type."""
    number = lambda t: F.when(J.is_whole(J.number_text(t)), "integer").otherwise("double")
    return once(F.expr(f"schema_of_variant({value})"), lambda kind: (
        F.when(kind == "STRING", once(_string(value), lambda t: F.when(J.is_number(t), number(t)).otherwise("string")))
        .when(kind == "VOID", "null").when(kind == "BOOLEAN", "boolean").when(kind == "BIGINT", "integer").when(kind.isin("DOUBLE", "FLOAT"), "double")
        .when(kind.startswith("DECIMAL(") & kind.endswith(",0)"), "integer").when(kind.startswith("DECIMAL"), "double")
        .when(kind.startswith("ARRAY"), "list").otherwise("object")
    ))


def scalar_text(value: str = "value") -> Column:
    """A scalar's text: strings as they are, numbers as they were written, true or false; null for lists, objects and nulls."""
    return once(_string(value), lambda t: F.when(J.is_number(t), J.number_text(t)).otherwise(J.plain_string(t)))


def render_scalar(value: str = "value", enum: Column | None = None, permitted: Column | None = None) -> Column:
    """Enumeration value, then CURIE or IRI, then literal. A null inside a list is the text None."""
    return once(F.struct(scalar_kind(value).alias("kind"), scalar_text(value).alias("text")), lambda v: _rendered(v["kind"], v["text"], enum, permitted))


def _rendered(kind: Column, text: Column, enum: Column | None, permitted: Column | None) -> Column:
    out = F.when(kind == "null", F.lit('"None"')).when(kind == "boolean", typed_literal(text, "boolean")).when(kind == "integer", typed_literal(J.whole_text(text), "integer"))
    out = out.when(kind == "double", typed_literal(float_text(text.try_cast("double")), "double"))
    if enum is not None and permitted is not None:
        out = out.when((kind == "string") & enum.endswith("Enum") & permitted, enum_value_iri(enum, text))
    return out.when((kind == "string") & is_curie(text), curie_to_iri(text)).when(kind == "string", plain_literal(text))


def fan_out(df: DataFrame, key: str, attr: str = "attr", value: str = "value") -> DataFrame:
    """Lists of any depth to rows with index, level by level; the innermost list's index stands. Scalars get
    index 0. Each level is looked at once for lists that are left in it."""
    level = df.select(key, attr, F.lit(0).alias("idx"), F.col(value).alias("value"))
    is_list = scalar_kind("value") == "list"
    done = level.where(~is_list)
    while not (lists := level.where(is_list)).isEmpty():
        level = _exploded(lists.select(key, attr, F.col("value").alias("__list")), "__list").select(key, attr, F.col("x.pos").alias("idx"), F.col("x.value").alias("value"))
        done = done.unionByName(level.where(~is_list))
    return done


def generated_iri(parent: Column | str, key: Column | str, value: Column, index: Column | str) -> Column:
    """Name of a nested object without an id of its own: a hash of its canonical JSON and its place."""
    text = F.concat(F.lit('{"index":'), F.col(index).cast("string") if isinstance(index, str) else index.cast("string"), F.lit(',"key":'), json_text(key), F.lit(',"parent_id":'), json_text(parent), F.lit(',"value":'), value, F.lit("}"))
    return F.concat(F.lit(NODE_NS), F.sha2(text.cast("binary"), 256))


def nested_nodes(records: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """(parent_iri, key, idx, child_iri, child) of the objects, at any depth, in the attributes of
    (parent_iri, value) records; a child with a CURIE or web address as ``id`` is named by it, else by a hash of its
    canonical JSON, which ``child`` holds. Duplicate keys keep the last value. Attributes in ``skip`` are not entered. Null and
    blank records have none; a text that is no JSON is an error, as in ``attributes``.

    Level by level: lists give their members (the innermost list's index stands), objects a row and their members. What is left of
    a level is stored, so that depth adds jobs, not plans."""
    kind = F.expr("schema_of_variant(value)")
    inner = (kind.startswith("ARRAY") | kind.startswith("OBJECT"))
    level = attributes(records.select("parent_iri", "value"), "parent_iri", "value", skip)
    level = level.select("parent_iri", F.col("attr").alias("key"), F.lit(0).alias("idx"), "value").where(inner)
    out = None
    while True:
        level = stored(level, "nested")
        if out is not None and level.isEmpty():
            return out
        lists, objects = level.where(kind.startswith("ARRAY")), level.where(kind.startswith("OBJECT"))
        own = F.when(F.expr("schema_of_variant(variant_get(value, '$.id'))") == "STRING", F.expr("try_variant_get(value, '$.id', 'string')"))
        own = F.when(is_curie(own) | own.startswith("http://") | own.startswith("https://"), curie_to_iri(own))
        objects = objects.withColumn("child", J.canonical_json("value"))
        objects = objects.withColumn("child_iri", F.coalesce(own, generated_iri("parent_iri", "key", F.col("child"), "idx")))
        rows = objects.select("parent_iri", "key", "idx", "child_iri", "child")
        out = rows if out is None else out.unionByName(rows)
        members = _exploded(objects.select("child_iri", F.col("value").alias("__v")), "__v").select(F.col("child_iri").alias("parent_iri"), J.plain_string(F.col("x.key")).alias("key"), F.lit(0).alias("idx"), F.col("x.value").alias("value"))
        items = _exploded(lists.select("parent_iri", F.col("key").alias("__key"), F.col("value").alias("__v")), "__v").select("parent_iri", F.col("__key").alias("key"), F.col("x.pos").alias("idx"), F.col("x.value").alias("value"))
        level = items.unionByName(members.where(~F.col("key").isin("id", "category"))).where(inner)
