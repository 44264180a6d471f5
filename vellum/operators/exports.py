"""Exports of a graph: JSON, N-Triples, JSON-LD, Parquet, SQLite. Rows of text are made by the
executors, a node's or an edge's at a time; files of one piece are written from a sorted stream."""

from __future__ import annotations

import json
import os
import sqlite3
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .graph import DERIVED, Graph

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
#: Properties that exports write in their own way, or not as literals.
SPECIAL = ("type", "title", "description", "generated", "verified", "sources")


def json_nodes(g: Graph) -> DataFrame:
    """id, json: a node as an object with its properties and derived facts."""
    derived = F.struct(*[F.col(c) for c in DERIVED])
    obj = F.struct("id", "kind", "type", "title", "description", "path", F.parse_json("props").alias("props"), derived.alias("derived"))
    return g.nodes.select("id", F.to_json(obj).alias("json"))


def json_edges(edges: DataFrame) -> DataFrame:
    return edges.select("src", "pred", "dst", F.to_json(F.struct("src", "pred", "dst", "origin")).alias("json"))


def iri(base: str, node: Column) -> Column:
    return F.concat(F.lit(base), T.quoted(node, ":/@"))


def expanded(term: Column, context: dict, base: str) -> Column:
    """A term's IRI by the context (terms, compact IRIs with declared prefixes); else in its vocabulary."""
    known = {}
    for key, entry in context.items():
        full = entry.get("@id") if isinstance(entry, dict) else entry
        if not isinstance(full, str) or key.startswith("@"):
            continue
        prefix, colon, rest = full.partition(":")
        if colon and isinstance(context.get(prefix), str) and not rest.startswith("//"):
            full = context[prefix] + rest
        known[key] = full
    out = F.concat(F.lit(context.get("@vocab", base)), T.quoted(term, ":/@#"))
    if not known:
        return out
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(F.try_element_at(table, term), out)


def literal(tag: Column, text: Column) -> Column:
    """A value as an N-Triples literal with its datatype."""
    kinds = {"bool": "boolean", "datetime": "dateTime", "naive": "dateTime", "date": "date", "int": "integer", "float": "double"}
    escaped = text
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        escaped = F.replace(escaped, F.lit(a), F.lit(b))
    quoted = F.concat(F.lit('"'), escaped, F.lit('"'))
    out = quoted
    for kind, name in kinds.items():
        out = F.when(tag == kind, F.concat(quoted, F.lit(f"^^<{XSD}{name}>"))).otherwise(out)
    return out


def triple(s: Column, p: Column, o: Column) -> Column:
    return F.concat(F.lit("<"), s, F.lit("> <"), p, F.lit("> "), o, F.lit(" ."))


def ntriples(g: Graph, context: dict) -> DataFrame:
    """subject, line. A property that some edge of the node already tells, derived ones
    included, is not written as a literal; derived edges are not written at all."""
    base = g.ontology.base_iri
    lit = lambda c: literal(F.lit("str"), c)
    n = g.nodes
    subject = iri(base, F.col("id"))
    term = lambda name: expanded(F.lit(name), context, base)
    angle = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    parts = [
        n.select("id", triple(subject, F.lit(RDF_TYPE), angle(expanded(capital(F.col("type")), context, base))).alias("line")),
        n.select("id", triple(subject, term("title"), lit(F.col("title"))).alias("line")),
        n.filter("description <> ''").select("id", triple(subject, term("description"), lit(F.col("description"))).alias("line")),
        own_values(g).select(F.col("node").alias("id"), triple(iri(base, F.col("node")), expanded(F.col("key"), context, base), literal(F.col("x.tag"), F.col("x.str"))).alias("line")),
        g.events.filter("ok and at is not null").select(F.col("node").alias("id"), triple(iri(base, F.col("node")), F.when(F.col("field") == "generated", term("generated_at")).otherwise(term("verified_at")), literal(F.col("at_tag"), F.col("at"))).alias("line")),
        g.derived_table().select(F.col("node").alias("id"), triple(iri(base, F.col("node")), F.concat(F.lit(base + "derived/"), T.quoted(F.col("key"), ":/@#")), literal(F.when(F.col("key").isin("stale", "at_risk"), "bool").otherwise("str"), F.col("value"))).alias("line")),
        g.edges.filter("origin <> 'derived'").select(F.col("src").alias("id"), triple(iri(base, F.col("src")), expanded(F.col("pred"), context, base), angle(iri(base, F.col("dst")))).alias("line")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.col("id").alias("subject"), "line")


def capital(text: Column) -> Column:
    """The first letter large, the others small."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(text.substr(F.lit(2), F.length(text))))


def own_values(g: Graph) -> DataFrame:
    """node, key, is_list, x (tag, str): the values that are told by no edge of the node."""
    preds = g.edges.select(F.col("src").alias("node"), F.col("pred").alias("key")).distinct()
    values = g.props.filter(~F.col("key").isin(*SPECIAL) & ~F.col("is_map")).join(preds, ["node", "key"], "left_anti")
    values = values.select("node", "key", "is_list", F.explode("items").alias("x"))
    return values.filter(~F.col("x.tag").isin("null", "map", "list") & ((F.col("x.str") != "") | F.col("is_list")))


def jsonld(g: Graph) -> DataFrame:
    """id, json: a JSON-LD object for each node. Link-shaped texts that resolved to nothing are
    wrapped, so that they read as text."""
    base = g.ontology.base_iri
    x = F.col("x.str")
    value = F.when(x.rlike(T.LINK_VALUE) | x.rlike(T.WIKI_VALUE), F.to_json(F.struct(x.alias("@value")))).when(F.col("x.tag").isin("int", "float", "bool"), x).otherwise(_string(x))
    values = own_values(g).groupBy(F.col("node").alias("id"), "key").agg(F.max("is_list").alias("many"), F.array_join(F.sort_array(F.collect_list(value)), ",").alias("v"))
    values = values.select("id", "key", F.when(F.col("many"), F.concat(F.lit("["), "v", F.lit("]"))).otherwise(F.col("v")).alias("v"))
    times = g.events.filter("ok and at is not null").groupBy(F.col("node").alias("id"), F.when(F.col("field") == "generated", "generated_at").otherwise("verified_at").alias("key")).agg(F.sort_array(F.collect_list(_string(F.col("at")))).alias("a"))
    times = times.select("id", "key", F.when(F.size("a") == 1, F.element_at("a", 1)).otherwise(F.concat(F.lit("["), F.array_join("a", ","), F.lit("]"))).alias("v"))
    truth = F.col("key").isin("stale", "at_risk")
    facts = g.derived_table().select(F.col("node").alias("id"), F.concat(F.lit("derived_"), "key").alias("key"), F.when(truth, F.col("value")).otherwise(_string(F.col("value"))).alias("v"))
    ends = F.sort_array(F.collect_list(F.to_json(F.struct(iri(base, F.col("dst")).alias("@id")))))
    links = g.edges.filter("origin <> 'derived'").groupBy(F.col("src").alias("id"), F.col("pred").alias("key")).agg(F.concat(F.lit("["), F.array_join(ends, ","), F.lit("]")).alias("v"))
    told = values.unionByName(times).unionByName(facts).unionByName(links)
    pairs = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("key", "v"))), lambda p: F.concat(F.lit(","), _string(p["key"]), F.lit(":"), p["v"])), "")
    told = told.groupBy("id").agg(pairs.alias("more"))
    head = F.concat(F.lit('{"@id":'), _string(iri(base, F.col("id"))), F.lit(',"@type":'), _string(capital(F.col("type"))), F.lit(',"title":'), _string(F.col("title")), F.when(F.col("description") != "", F.concat(F.lit(',"description":'), _string(F.col("description")))).otherwise(""))
    return g.nodes.join(told, "id", "left").select("id", F.concat(head, F.coalesce("more", F.lit("")), F.lit("}")).alias("json"))


def _string(text: Column) -> Column:
    """A JSON string."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("s"))), r'(?s)^\{"s":(.*)\}$', 1)


# ---- files -------------------------------------------------------------------------------


def _lines(path: Path, parts: Iterable[str]) -> Path:
    tmp = path.with_name(f"{path.name}.{os.getpid()}.tmp")
    with tmp.open("w", encoding="utf-8", newline="\n") as f:
        f.writelines(parts)
    os.replace(tmp, path)
    return path


def _joined(rows: DataFrame, column: str) -> Iterable[str]:
    for i, r in enumerate(rows.toLocalIterator()):
        yield (",\n" if i else "\n") + r[column]


def write_json(g: Graph, path: Path) -> Path:
    def parts():
        yield '{"built_at": ' + json.dumps(g.built_at) + ', "nodes": ['
        yield from _joined(json_nodes(g).orderBy("id"), "json")
        yield '\n], "edges": ['
        yield from _joined(json_edges(g.edges).orderBy("src", "pred", "dst"), "json")
        yield '\n], "findings": ['
        yield from _joined(g.findings.select("code", "node", "message", F.to_json(F.struct("*")).alias("json")).orderBy("code", "node", "message", "json"), "json")
        yield "\n]}\n"

    return _lines(path, parts())


def write_ntriples(g: Graph, context: dict, path: Path) -> Path:
    return _lines(path, (r["line"] + "\n" for r in ntriples(g, context).orderBy("subject", "line").toLocalIterator()))


def write_jsonld(g: Graph, context: dict, path: Path) -> Path:
    def parts():
        yield '{"@context": ' + json.dumps(context or {"@vocab": g.ontology.base_iri}, ensure_ascii=False) + ', "@graph": ['
        yield from _joined(jsonld(g).orderBy("id"), "json")
        yield "\n]}\n"

    return _lines(path, parts())


# ---- files in parts ----------------------------------------------------------------------


def _parts(rows: DataFrame, order: list[str], column: str, folder: str, end: str) -> list[str]:
    """The rows' texts as files in global order, each text followed by `end`: their paths. Every task writes its own range; what a
    task that failed had written does not count."""
    rows.orderBy(*order).select(column).write.option("lineSep", end).text(folder)
    spark = rows.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(f"{folder}/{s.getPath().getName()}" for s in found if s.getPath().getName().startswith("part-"))


def _put(spark, path: str, text: str) -> str:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return path


def _array(rows: DataFrame, order: list[str], folder: str, name: str) -> list[str]:
    """Files whose texts in a row are the elements of a JSON array (rows: json, and the columns of the order), with a comma
    between them: the last element (and its equals) has a file of its own."""
    spark = rows.sparkSession
    last = rows.orderBy(*[F.col(c).desc() for c in order], F.col("json").desc()).select("json").first()
    if last is None:
        return []
    equal = rows.filter(F.col("json") == last["json"]).count()
    rest = rows.filter(F.col("json") != last["json"])
    head = _put(spark, f"{folder}/{name}.head", "\n")
    return [head, *_parts(rest, [*order, "json"], "json", f"{folder}/{name}", ",\n"), _put(spark, f"{folder}/{name}.tail", ",\n".join([last["json"]] * equal))]


def _manifest(spark, folder: str, files: list[str]) -> str:
    """The export counts once this is there: the files in the order in which they make up the document, relative to the folder."""
    return _put(spark, f"{folder}/manifest.json", json.dumps([f.removeprefix(folder + "/") for f in files]))


def json_parts(g: Graph, folder: str) -> str:
    """write_json() in parts under a folder that is not there yet: the path of their manifest."""
    spark = g.nodes.sparkSession
    put = lambda name, text: _put(spark, f"{folder}/{name}", text)
    findings = g.findings.select("code", "node", "message", F.to_json(F.struct("*")).alias("json"))
    files = [put("begin", '{"built_at": ' + json.dumps(g.built_at) + ', "nodes": ['), *_array(json_nodes(g), ["id"], folder, "nodes")]
    files += [put("edges.begin", '\n], "edges": ['), *_array(json_edges(g.edges), ["src", "pred", "dst"], folder, "edges")]
    files += [put("findings.begin", '\n], "findings": ['), *_array(findings, ["code", "node", "message"], folder, "findings"), put("end", "\n]}\n")]
    return _manifest(spark, folder, files)


def ntriples_parts(g: Graph, context: dict, folder: str) -> str:
    """write_ntriples() in parts: the path of their manifest."""
    return _manifest(g.nodes.sparkSession, folder, _parts(ntriples(g, context), ["subject", "line"], "line", f"{folder}/lines", "\n"))


def jsonld_parts(g: Graph, context: dict, folder: str) -> str:
    """write_jsonld() in parts: the path of their manifest."""
    spark = g.nodes.sparkSession
    head = '{"@context": ' + json.dumps(context or {"@vocab": g.ontology.base_iri}, ensure_ascii=False) + ', "@graph": ['
    files = [_put(spark, f"{folder}/begin", head), *_array(jsonld(g), ["id"], folder, "graph"), _put(spark, f"{folder}/end", "\n]}\n")]
    return _manifest(spark, folder, files)


def write_sqlite(g: Graph, path: Path) -> Path:
    """The tables and views as one SQLite file, built beside its place and moved there."""
    tmp = path.with_name(f"{path.name}.{os.getpid()}.tmp")
    keys = {"meta": ("key",), "nodes": ("id",), "edges": ("src", "pred", "dst")}
    views = {"v_trust": "SELECT node AS id, value AS trust_tier FROM derived WHERE key='trust_tier'", "v_stale": "SELECT node AS id FROM derived WHERE key='stale' AND value='true'", "v_at_risk": "SELECT node AS id FROM derived WHERE key='at_risk' AND value='true'"}
    try:
        con = sqlite3.connect(tmp)
        for name, df in g.tables().items():
            if name in views:
                con.execute(f"CREATE VIEW {name} AS {views[name]}")
                continue
            cols = [f"{c} {'REAL' if t == 'double' else 'TEXT'}" for c, t in df.dtypes] + ([f"PRIMARY KEY ({', '.join(keys[name])})"] if name in keys else [])
            con.execute(f"CREATE TABLE {name} ({', '.join(cols)})")
            con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(df.columns))})", (tuple(r) for r in df.toLocalIterator()))
        con.execute("CREATE INDEX edges_dst ON edges(dst)")
        con.execute("CREATE INDEX props_key ON props(key)")
        con.commit()
        con.close()
        os.replace(tmp, path)
    finally:
        tmp.unlink(missing_ok=True)
    return path


def write_parquet(g: Graph, folder: str) -> None:
    """The tables as Parquet, the form in which other queries read them back."""
    for name, df in g.tables().items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def read_parquet(spark, folder: str) -> dict[str, DataFrame]:
    """The tables that write_parquet() wrote, for queries that need no fresh graph."""
    names = ("meta", "nodes", "edges", "props", "derived", "findings", "v_trust", "v_stale", "v_at_risk")
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def write_artifacts(g: Graph, context: dict, folder: str) -> dict[str, Path]:
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    return {"json": write_json(g, out / "graph.json"), "nt": write_ntriples(g, context, out / "graph.nt"), "jsonld": write_jsonld(g, context, out / "graph.jsonld"), "sqlite": write_sqlite(g, out / "graph.sqlite")}
