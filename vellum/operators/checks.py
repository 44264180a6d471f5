"""Checks of properties against an ontology. Each gives findings: level, code, node, message, suggestion.

props is a row for each note and property that the note has: node, type, key, is_list, is_map,
items (array of tag, str), where tag is the value's kind (str, int, float, bool, date, datetime,
naive, null, map, list).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

FINDING = "level string, code string, node string, message string, suggestion string"


def finding(level: Column | str, code: str, node: Column, message: Column, suggestion: Column | str = "") -> list[Column]:
    col = lambda x: F.lit(x) if isinstance(x, str) else x
    return [col(level).alias("level"), F.lit(code).alias("code"), node.alias("node"), message.alias("message"), col(suggestion).alias("suggestion")]


def is_empty(props: str = "") -> Column:
    """Null, the empty text and the empty list are no values; 0 and false are."""
    items, is_list = F.col(f"{props}items"), F.col(f"{props}is_list")
    one = F.element_at(items, 1)
    return F.when(is_list, F.size(items) == 0).otherwise((one["tag"] == "null") | ((one["tag"] == "str") & (one["str"] == "")))


def specced(props: DataFrame, specs: DataFrame) -> DataFrame:
    """Properties with their specs; types without specs have those of `*`.

    Specs are as large as the ontology and are broadcast: types and keys are few, and each would hold its share of all
    properties in one task."""
    declared = F.broadcast(specs.select(F.col("class").alias("type")).distinct().withColumn("declared", F.lit(True)))
    typed = props.join(declared, "type", "left").withColumn("class", F.when(F.col("declared"), F.col("type")).otherwise("*"))
    return typed.join(F.broadcast(specs.withColumnRenamed("name", "key")), ["class", "key"]).drop("declared")


def missing_required(notes: DataFrame, props: DataFrame, specs: DataFrame) -> DataFrame:
    """Notes (node, type) without a value for a property that their class requires."""
    want = notes.select("node", "type").join(F.broadcast(specs.filter("required").select(F.col("class").alias("type"), F.col("name").alias("key"))), "type")
    asked = F.broadcast(specs.filter("required").select(F.col("name").alias("key")).distinct())  # the other properties need not be dealt out
    lacking = want.join(props.filter(~is_empty()).select("node", "key").join(asked, "key", "left_semi"), ["node", "key"], "left_anti")
    return lacking.select(*finding("error", "missing_required", F.col("node"), F.concat(F.lit("`"), "key", F.lit("` is required for type `"), "type", F.lit("`"))))


def _shown(items: Column, is_list: Column) -> Column:
    one = F.array_join(F.transform(items, lambda x: x["str"]), ", ")
    return F.when(is_list, F.concat(F.lit("["), one, F.lit("]"))).otherwise(one)


def enum_violations(typed: DataFrame) -> DataFrame:
    """Values outside an enumeration. typed: as specced() makes it."""
    one = _shown(F.col("items"), F.col("is_list"))
    bad = typed.filter((F.col("kind") == "enum") & ~is_empty() & ~F.array_contains("allowed", one))
    return bad.select(*finding("error", "enum_violation", F.col("node"), F.concat(F.lit("`"), "key", F.lit(": "), one, F.lit("` is not one of ["), F.array_join("allowed", ", "), F.lit("]"))))


def type_violations(typed: DataFrame) -> DataFrame:
    """Dates, instants and lists that are none; the calendar is not asked."""
    one = F.element_at("items", 1)
    text = F.when(one["tag"] == "str", one["str"])
    day = ~F.col("is_list") & (one["tag"].isin("date", "datetime", "naive") | T.is_day(text))
    instant = ~F.col("is_list") & ((one["tag"] == "datetime") | T.is_instant(text))
    kind = F.col("kind")
    bad = ((kind == "date") & ~day) | ((kind == "datetime") & ~instant) | ((kind == "list") & ~F.col("is_list"))
    what = F.when(kind == "date", "must be a date (YYYY-MM-DD)").when(kind == "datetime", "must be an ISO-8601 instant with offset").otherwise("should be a list")
    level = F.when(kind == "list", "warning").otherwise("error")
    got = _shown(F.col("items"), F.col("is_list"))
    return typed.filter(~is_empty() & bad).select(*finding(level, "type_violation", F.col("node"), F.concat(F.lit("`"), "key", F.lit("` "), what, F.lit("; got "), got)))


def cardinality(typed: DataFrame) -> DataFrame:
    """Lists of references where the ontology allows one."""
    bad = typed.filter((F.col("kind") == "ref") & F.col("is_list") & ~F.col("many") & (F.size("items") > 0))
    return bad.select(*finding("warning", "cardinality", F.col("node"), F.concat(F.lit("`"), "key", F.lit("` holds "), F.size("items").cast("string"), F.lit(" values but the ontology allows one"))))


def references(typed: DataFrame) -> DataFrame:
    """node, key, value, from_path, ranges, soft: a row for each value of a reference property."""
    refs = typed.filter((F.col("kind") == "ref") & ~is_empty())
    return refs.select("node", "key", F.explode("items").alias("x"), F.col("node").alias("from_path"), "ranges", "soft").withColumn("value", F.col("x.str")).drop("x")


def reference_findings(resolved: DataFrame, lineage: dict[str, list[str]], close: DataFrame | None = None, shared: DataFrame | None = None) -> DataFrame:
    """Range violations, ambiguous and unresolved references. resolved: references() resolved.
    close: suggestions() for unresolved values and ranges; shared: sharers() of ambiguous keys."""
    table = F.create_map(*[x for c, up in lineage.items() for x in (F.lit(c), F.array(*[F.lit(u) for u in up]))]) if lineage else F.create_map()
    ranged = F.size("ranges") > 0
    fits = F.coalesce(F.arrays_overlap(F.try_element_at(table, F.col("target_type")), F.col("ranges")), F.lit(False))
    named = F.concat(F.lit("`"), "key", F.lit(": "), F.coalesce("value", F.lit("null")), F.lit("`"))
    off = resolved.filter(F.col("method").isin("link", "wikilink", "name") & ranged & ~fits)
    off = off.select(*finding("error", "range_violation", F.col("node"), F.concat(F.lit("`"), "key", F.lit("` points at "), "target", F.lit(" of type `"), "target_type", F.lit("`; expected ["), F.array_join("ranges", ", "), F.lit("]"))))
    many = resolved.filter(F.col("method") == "ambiguous")
    many = many.join(shared, "shared", "left") if shared is not None else many.withColumn("ids", F.lit(None).cast("array<string>"))
    listed = F.coalesce(F.concat(F.lit(": "), F.array_join("ids", ", "), F.when(F.size("ids") < F.col("n"), ", …").otherwise("")), F.lit(""))
    many = many.select(*finding("warning", "ambiguous_ref", F.col("node"), F.concat(named, F.lit(" matches "), F.col("n").cast("string"), F.lit(" notes"), listed), "use a markdown link to the intended note"))
    gone = resolved.filter(F.col("method").isin("unresolved", "empty"))
    gone = gone.join(close, ["value", "ranges"], "left") if close is not None else gone.withColumn("suggested", F.lit(None).cast("array<string>"))
    meant = F.concat(F.lit("did you mean "), F.array_join("suggested", ", "), F.lit("?"))
    hint = F.coalesce(meant, F.concat(F.lit("create a `"), F.try_element_at("ranges", F.lit(1)), F.lit("` note for it")), F.lit(""))
    gone = gone.select(*finding(F.when(F.col("soft"), "info").otherwise("warning"), "unresolved_ref", F.col("node"), F.concat(named, F.lit(" does not resolve to a note")), hint))
    return off.unionByName(many).unionByName(gone)


def unused_sources(declared: DataFrame, cited: DataFrame) -> DataFrame:
    """Sources (node, fid) that a note declares and never cites (node, fid)."""
    left = declared.select("node", "fid").distinct().join(cited.select("node", "fid"), ["node", "fid"], "left_anti")
    return left.select(*finding("info", "unused_source", F.col("node"), F.concat(F.lit("source `"), "fid", F.lit("` is declared but never cited")), "cite it in the body or remove it"))


def unknown_types(notes: DataFrame, classes: list[str]) -> DataFrame:
    """Notes (node, type) of a class that is not declared; none if no class is."""
    bad = notes.filter(F.lit(bool(classes)) & (F.col("type") != "unknown") & ~F.col("type").isin(*classes))
    return bad.select(*finding("info", "unknown_type", F.col("node"), F.concat(F.lit("type `"), "type", F.lit("` is not declared in the ontology (tolerated)")), "add a class or use an existing one"))


def report(findings: DataFrame) -> DataFrame:
    """section (error, warning), rendered: findings as a validation prints them; info is left out."""
    line = F.concat(F.rpad("level", 7, " "), F.lit(" "), F.rpad("code", 26, " "), F.lit(" "), "node", F.lit(": "), "message", F.when(F.col("suggestion") != "", F.concat(F.lit("  → "), "suggestion")).otherwise(""))
    return findings.filter(F.col("level").isin("error", "warning")).select(F.col("level").alias("section"), line.alias("rendered"))
