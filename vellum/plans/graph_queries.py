"""Graph queries: build, inverses, closure, traversal, resolution, checks, derived facts, exports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks, derive, exports, policy, sqlgate
from ..operators import edges as E
from ..operators.graph import DERIVED, Graph, actor_nodes, build, label, source_nodes
from ..operators.ontology import Ontology
from ..operators.providers import recall
from ..operators.resolve import keys, lookup, resolve, sharers
from ..operators.staging import staged
from ..sources.vault import FrameVault
from .frames import EDGES_SQL, INVERSES, NODES_SQL, NOTES_SQL, PLACES_SQL, nodes, notes, places, raw_edges, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return add


def edges(spark: SparkSession, d: str) -> DataFrame:
    return E.distinct_edges(raw_edges(spark, d))


def starts(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id string")


def graph(spark: SparkSession, d: str, props: DataFrame | None = None) -> Graph:
    """The tables as a graph of notes."""
    n = nodes(spark, d).withColumns({"kind": F.lit("note"), "description": F.lit(""), "path": F.col("id"), "mtime": F.lit(0.0), "props": F.lit("{}"), "sensitivity": F.lit(None).cast("string"), **{c: F.lit(None).cast("boolean" if c in ("stale", "at_risk") else "string") for c in DERIVED}})
    none = spark.createDataFrame([], checks.FINDING)
    props = spark.createDataFrame([], "node string, key string, is_list boolean, is_map boolean, items array<struct<tag:string,str:string>>") if props is None else props
    return Graph(n, edges(spark, d), none, props, none, none, "", "human:ann", Ontology())


@query("graph_nodes", f"select id, 'note' as kind, type, title, '{{}}' as props from {NODES_SQL}")
def _(spark, d):
    return graph(spark, d).tables()["nodes"].select("id", "kind", "type", "title", "props")


@query("graph_edges", f"select src, pred, dst, origin from {EDGES_SQL}")
def _(spark, d):
    return edges(spark, d)


_INV = "case pred " + " ".join(f"when '{a}' then '{b}'" for a, b in INVERSES.items()) + " end"


@query("edges_inverse", f"select dst as src, {_INV} as pred, src as dst, 'derived' as origin from {EDGES_SQL}")
def _(spark, d):
    return E.inverse_edges(edges(spark, d), INVERSES)


@query("edges_closure", f"""
with recursive e as (select src, dst from {PLACES_SQL}), r as (select src, dst from e union select r.src, e.dst from r join e on r.dst = e.src)
select src, 'located_in' as pred, dst, 'derived' as origin from (select src, dst from r except select src, dst from e) where src <> dst""")  # fmt: skip
def _(spark, d):
    return E.closure(places(edges(spark, d)), "located_in")


@query("region_members", f"""
with recursive e as (select src, dst from {PLACES_SQL}), r as (select src, dst from e union select r.src, e.dst from r join e on r.dst = e.src)
select r.dst as region, n.title, m.type, count(*) as members from r join {NODES_SQL} n on n.id = r.dst and n.type = 'region' join {NODES_SQL} m on m.id = r.src group by all""")  # fmt: skip
def _(spark, d):
    held = places(edges(spark, d))
    every = held.unionByName(E.closure(held, "located_in"))
    n = nodes(spark, d)
    out = every.join(n.filter("type = 'region'").select(F.col("id").alias("dst"), "title"), "dst").join(n.select(F.col("id").alias("src"), "type"), "src")
    return out.groupBy(F.col("dst").alias("region"), "title", "type").agg(F.count(F.lit(1)).alias("members"))


@query("edges_out", f"select src, pred, dst, origin from {EDGES_SQL} where src = 'o:100'")
def _(spark, d):
    return edges(spark, d).filter("src = 'o:100'")


def _both(spark, d):
    held = places(edges(spark, d))
    return held.unionByName(E.inverse_edges(held, INVERSES))


_BOTH_SQL = f"(select src, pred, dst from {PLACES_SQL} union all select dst, 'holds', src from {PLACES_SQL})"


@query("neighbors_depth2", f"""
with e as {_BOTH_SQL}, d1 as (select * from e where src = 'r:1'), f1 as (select distinct dst as n from d1 where dst <> 'r:1')
select src, pred, dst, 1 as depth from d1 union all select e.src, e.pred, e.dst, 2 from e join f1 on e.src = f1.n""")  # fmt: skip
def _(spark, d):
    return E.neighbors(_both(spark, d), starts(spark, "r:1"), 2)


@query("neighbors_by_predicate", f"select src, pred, dst, 1 as depth from {_BOTH_SQL} where src = 'n:3' and pred = 'holds'")
def _(spark, d):
    return E.neighbors(_both(spark, d), starts(spark, "n:3"), 1, ["holds"])


@query("distances", f"""
with recursive e as {_BOTH_SQL}, r as (select 'n:3' as node, 0 as depth union select e.dst, r.depth + 1 from r join e on e.src = r.node where r.depth < 6)
select node, min(depth)::int as depth from r group by node""")  # fmt: skip
def _(spark, d):
    return E.distances(_both(spark, d), starts(spark, "n:3"), 6)


@query("reach_after_change", f"""
with recursive e as (select src, dst from {PLACES_SQL} where not (src like 'c:%' and substr(src, 3)::bigint % 5 = 0)),
t as (select src, dst from e union select t.src, e.dst from t join e on t.dst = e.src)
select src, dst from t where src <> dst""")
def _(spark, d):
    """The places' pairs without every third customer, brought up to date: those come, every fifth goes."""
    e = staged(places(edges(spark, d)).select("src", "dst"), "places")
    no = F.when(F.col("src").startswith("c:"), F.substring("src", 3, 20).cast("long"))
    third, fifth = F.coalesce(no % 3 == 0, F.lit(False)), F.coalesce(no % 5 == 0, F.lit(False))
    old = e.filter(~third).select("src", F.lit("located_in").alias("pred"), "dst", F.lit("x").alias("origin"))
    was = old.select("src", "dst").unionByName(E.closure(old, "located_in").select("src", "dst"))
    return E.reach_after(was, e.filter(~fifth), e.filter(third & ~fifth), e.filter(fifth & ~third))


@query("graph_build", """
with o as (select '03-projects/o' || o_orderkey || '.md' as o, '05-people/c' || c_custkey || '.md' as c, '04-areas/n' || c_nationkey || '.md' as n from orders join customer on o_custkey = c_custkey),
every as (select '03-projects/o' || o_orderkey || '.md' as id from orders union all select '05-people/c' || c_custkey || '.md' from customer union all select '04-areas/n' || n_nationkey || '.md' from nation)
select o as src, 'owner' as pred, c as dst, 'frontmatter' as origin from o union all select c, 'owns', o, 'derived' from o
union all select o, 'area', n, 'frontmatter' from o where n in (select id from every) union all select n, 'has_item', o, 'derived' from o where n in (select id from every)
union all select o, 'links_to', n, 'body' from o where n in (select id from every) union all select n, 'linked_from', o, 'derived' from o where n in (select id from every)
union all select id, 'generated_by', 'actor:human:ann', 'frontmatter' from every union all select 'actor:human:ann', 'generated', id, 'derived' from every""")
def _(spark, d):
    """Notes made of all orders, customers and nations, parsed and built into a graph: orders name their owner by title
    and their area by link."""
    t = lambda n: table(spark, d, n)
    def note(rel, kind, title, more=F.lit(""), body=F.lit("")):
        head = F.concat(F.lit(f"---\ntype: {kind}\ntitle: "), title, F.lit("\ndescription: made of a row\ngenerated: { by: human:ann, at: 2026-01-01T00:00:00Z }\n"), more, F.lit("---\n"), body)
        return [rel.alias("rel"), F.lit(1.0).alias("mtime"), head.cast("binary").alias("content")]

    at = lambda folder, key: F.concat(F.lit(folder), F.col(key).cast("string"), F.lit(".md"))
    owned = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    area = F.concat(F.lit("../"), at("04-areas/n", "c_nationkey"))
    more = F.when(F.col("c_custkey").isNotNull(), F.concat(F.lit("owner: "), "c_name", F.lit("\narea: '[n]("), area, F.lit(")'\n"))).otherwise("")
    body = F.coalesce(F.concat(F.lit("See [the nation]("), area, F.lit(") <!-- [[none]] -->\n")), F.lit(""))
    files = owned.select(*note(at("03-projects/o", "o_orderkey"), "project", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")), more, body))
    files = files.unionByName(t("customer").select(*note(at("05-people/c", "c_custkey"), "person", F.col("c_name"))))
    files = files.unionByName(t("nation").select(*note(at("04-areas/n", "n_nationkey"), "area", F.col("n_name"))))
    # notes cost the same to parse however small the tables that they are made of
    parts = (t("orders").count() + t("customer").count()) // 20000 + 2 * spark.sparkContext.defaultParallelism
    return build(FrameVault(files.repartition(parts, "rel")), dt.datetime(2026, 9, 15, tzinfo=dt.UTC)).edges.select("src", "pred", "dst", "origin")


@query("reaches_lookup", f"""
with e as (select * from {PLACES_SQL}), pairs as (select 'c:' || c_custkey as a, 'r:' || c_nationkey % 5 as b from customer union select 'c:' || c_custkey, 'r:' || c_custkey % 5 from customer union all select 'r:' || r_regionkey, 'r:' || r_regionkey from region)
select a, b from pairs where exists (select 1 from e x join e y on x.dst = y.src where x.src = a and y.dst = b)""")
def _(spark, d):
    """Whether customers lie in either of two regions, looked up without the closure; no region lies in itself."""
    name = lambda kind, key: F.concat(F.lit(kind), key.cast("string"))
    either = F.explode(F.array(F.col("c_nationkey") % 5, F.col("c_custkey") % 5))
    pairs = table(spark, d, "customer").select(name("c:", F.col("c_custkey")).alias("a"), either.alias("k")).select("a", name("r:", F.col("k")).alias("b"))
    region = name("r:", F.col("r_regionkey"))
    pairs = pairs.unionByName(table(spark, d, "region").select(region.alias("a"), region.alias("b")))
    return E.reaches(edges(spark, d), pairs, ["located_in"])


@query("shortest_path_len", f"""
with recursive e as {_BOTH_SQL}, r as (select 'c:1' as node, 0 as depth union select e.dst, r.depth + 1 from r join e on e.src = r.node where r.depth < 8)
select 'c:1' as a, node as b, min(depth)::int as steps from r where node in ('s:1', 'c:2', 'r:0', 'r:1', 'r:2', 'r:3', 'r:4') group by node""")  # fmt: skip
def _(spark, d):
    e = _both(spark, d)
    e = staged(e, "both-ways")
    rows = [("c:1", b, len(E.shortest_path(e, "c:1", b))) for b in ("s:1", "c:2", "r:0", "r:1", "r:2", "r:3", "r:4")]
    return spark.createDataFrame([r for r in rows if r[2]], "a string, b string, steps int")


# ---- resolution --------------------------------------------------------------------------


def _parts(spark, d):
    """Parts as notes; the odd ones as people, the brand as an alias of each hundredth."""
    p = F.col("p_partkey")
    return table(spark, d, "part").select(
        F.concat(F.lit("p:"), p.cast("string")).alias("id"), F.concat(F.lit("parts/p"), p.cast("string"), F.lit(".md")).alias("path"), F.when(p % 2 == 1, "person").otherwise("part").alias("type"),
        F.concat("p_name", F.lit(" "), (p % 500).cast("string")).alias("title"), F.when(p % 100 == 0, F.array(F.concat("p_name", F.lit(" no "), p.cast("string")))).alias("aliases"),
    )


def _refs(spark, d, ranges=()):
    r = F.array(*[F.lit(x) for x in ranges]) if ranges else F.array().cast("array<string>")
    own = table(spark, d, "part").select("p_name", F.col("p_partkey").alias("k"))
    name = own.select("k", F.concat(F.upper("p_name"), F.lit("  "), (F.col("k") % 700).cast("string")).alias("value"))
    link = own.filter("k % 10 = 3").select("k", F.concat(F.lit("[x](../parts/./p"), F.col("k").cast("string"), F.lit(".md#top)")).alias("value"))
    wiki = own.filter("k % 10 = 4").select("k", F.concat(F.lit("[[parts/P"), (F.col("k") * 3).cast("string"), F.lit("|see]]")).alias("value"))
    alias = own.filter("k % 100 = 0").select("k", F.concat("p_name", F.lit(" (example) no. "), F.col("k").cast("string")).alias("value"))
    out = name.unionByName(link).unionByName(wiki).unionByName(alias).unionByName(own.filter("k = 7").select("k", F.lit("me").alias("value"))).unionByName(own.filter("k = 8").select("k", F.lit("[y](https://a.example)").alias("value")))
    return out.withColumns({"from_path": F.lit("notes/a.md"), "ranges": r})


_PARTS_SQL = "(select p_partkey as k, case when p_partkey % 2 = 1 then 'person' else 'part' end as type, p_name || ' ' || (p_partkey % 500) as title from part)"


def _resolve_sql(prefer: bool) -> str:
    pick = "case when n > 1 and nr > 0 then nr else n end" if prefer else "n"
    one = "case when n > 1 and nr > 0 then ir else i end" if prefer else "i"
    return f"""
with names as (select lower(title) as name, 'p:' || k as id, type from {_PARTS_SQL} union all select p_name || ' no ' || p_partkey, 'p:' || p_partkey, case when p_partkey % 2 = 1 then 'person' else 'part' end from part where p_partkey % 100 = 0),
firsts as (select split_part(p_name, ' ', 1) as name, min('p:' || p_partkey) as id, 'person' as type from part where p_partkey % 2 = 1 and length(split_part(p_name, ' ', 1)) >= 3 group by 1 having count(*) = 1),
known as (select * from names union all select * from firsts where name not in (select name from names)),
by_name as (select name, count(*) as n, min(id) as i, count(*) filter (type = 'person') as nr, min(id) filter (type = 'person') as ir from known group by name),
refs as (
  select p_partkey as k, upper(p_name) || '  ' || (p_partkey % 700) as value, p_name || ' ' || (p_partkey % 700) as name from part
  union all select p_partkey, p_name || ' (example) no. ' || p_partkey, p_name || ' no ' || p_partkey from part where p_partkey % 100 = 0)
select k, value, case when {pick} = 1 then {one} end as target, case when {pick} = 1 then 'name' when coalesce({pick}, 0) > 1 then 'ambiguous' else 'unresolved' end as method, coalesce({pick}, 0)::bigint as n
from refs left join by_name using (name)
union all select p_partkey, '[x](../parts/./p' || p_partkey || '.md#top)', 'p:' || p_partkey, 'link', 1 from part where p_partkey % 10 = 3
union all select p_partkey, '[[parts/P' || (p_partkey * 3) || '|see]]', q.id, case when q.id is null then 'unresolved' else 'wikilink' end, case when q.id is null then 0 else 1 end
  from part left join (select 'p:' || p_partkey as id, p_partkey as kk from part) q on q.kk = part.p_partkey * 3 where p_partkey % 10 = 4
union all select 7, 'me', 'self', 'self', 1 from part where p_partkey = 7
union all select 8, '[y](https://a.example)', null, 'external', 0 from part where p_partkey = 8"""


@query("resolve_by_name", _resolve_sql(False))
def _(spark, d):
    return resolve(_refs(spark, d), lookup(keys(_parts(spark, d))), {}).select("k", "value", "target", "method", "n")


@query("prefer_range", _resolve_sql(True))
def _(spark, d):
    return resolve(_refs(spark, d, ("person",)), lookup(keys(_parts(spark, d))), {"person": ["person", "node"], "part": ["part", "node"]}).select("k", "value", "target", "method", "n")


# ---- checks ------------------------------------------------------------------------------


def _eav(df: DataFrame, node, kind, *columns) -> DataFrame:
    """props of (node, type, key, value) columns; a null value is no property."""
    rows = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("v")) for k, v in columns])
    out = df.select(node.alias("node"), kind.alias("type"), F.explode(rows).alias("p")).filter("p.v is not null")
    return out.select("node", "type", "p.key", F.lit(False).alias("is_list"), F.lit(False).alias("is_map"), F.array(F.struct(F.lit("str").alias("tag"), F.col("p.v").alias("str"))).alias("items"))


def _specs(spark, *rows):
    return spark.createDataFrame(list(rows), "class string, name string, kind string, allowed array<string>, ranges array<string>, many boolean, soft boolean, required boolean")


@query("missing_required", """
select 'error' as level, 'missing_required' as code, 'd:' || doc_id as node, '`quality` is required for type `document`' as message, '' as suggestion
from documents where doc_id not in (select doc_id from labels where quality is not null)""")  # fmt: skip
def _(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("d:"), F.col("doc_id").cast("string")).alias("node"), F.lit("document").alias("type"))
    props = _eav(table(spark, d, "labels"), F.concat(F.lit("d:"), F.col("doc_id").cast("string")), F.lit("document"), ("quality", F.col("quality")))
    return checks.missing_required(docs, props, _specs(spark, ("document", "quality", "text", [], [], False, False, True)))


@query("enum_violation", """
select 'error' as level, 'enum_violation' as code, 'e:' || event_id as node, '`event_type: ' || event_type || '` is not one of [view, click, purchase]' as message, '' as suggestion
from events where event_type not in ('view', 'click', 'purchase')""")  # fmt: skip
def _(spark, d):
    props = _eav(table(spark, d, "events"), F.concat(F.lit("e:"), F.col("event_id").cast("string")), F.lit("event"), ("event_type", F.col("event_type")))
    return checks.enum_violations(checks.specced(props, _specs(spark, ("event", "event_type", "enum", ["view", "click", "purchase"], [], False, False, False))))


@query("type_violation", """
select 'error' as level, 'type_violation' as code, 'o:' || o_orderkey as node, '`due` must be a date (YYYY-MM-DD); got ' || strftime(o_orderdate, '%d.%m.%Y') as message, '' as suggestion from orders where o_orderkey % 7 = 0
union all select 'error', 'type_violation', 'o:' || o_orderkey, '`at` must be an ISO-8601 instant with offset; got ' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'), '' from orders where o_orderkey % 5 = 0
union all select 'warning', 'type_violation', 'o:' || o_orderkey, '`tags` should be a list; got ' || o_orderstatus, '' from orders""")  # fmt: skip
def _(spark, d):
    k, at = F.col("o_orderkey"), F.col("o_orderdate")
    due = F.when(k % 7 == 0, F.date_format(at, "dd.MM.yyyy")).otherwise(F.date_format(at, "yyyy-MM-dd"))
    when = F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(k % 5 == 0, "").otherwise("Z"))
    props = _eav(table(spark, d, "orders"), F.concat(F.lit("o:"), k.cast("string")), F.lit("order"), ("due", due), ("at", when), ("tags", F.col("o_orderstatus")))
    specs = _specs(spark, *[("order", n, t, [], [], False, False, False) for n, t in (("due", "date"), ("at", "datetime"), ("tags", "list"))])
    return checks.type_violations(checks.specced(props, specs))


@query("cardinality", """
select 'warning' as level, 'cardinality' as code, 'u:' || user_id as node, '`event` holds ' || count(*) || ' values but the ontology allows one' as message, '' as suggestion from events group by user_id""")
def _(spark, d):
    one = F.struct(F.lit("str").alias("tag"), F.col("event_type").alias("str"))
    props = table(spark, d, "events").groupBy(F.concat(F.lit("u:"), F.col("user_id").cast("string")).alias("node")).agg(F.collect_list(one).alias("items"))
    props = props.select("node", F.lit("user").alias("type"), F.lit("event").alias("key"), F.lit(True).alias("is_list"), F.lit(False).alias("is_map"), "items")
    return checks.cardinality(checks.specced(props, _specs(spark, ("user", "event", "ref", [], [], False, False, False))))


@query("reference_findings", f"""
with t as (select * from {_PARTS_SQL}), r as (select 'o:' || l_orderkey as node, l_partkey as k, l_linenumber % 3 as way from lineitem)
select 'error' as level, 'range_violation' as code, r.node, '`item` points at p:' || r.k || ' of type `part`; expected [person]' as message, '' as suggestion from r join t on t.k = r.k where t.type = 'part' and way = 1
union all select 'warning', 'unresolved_ref', r.node, '`item: nobody ' || r.k || '` does not resolve to a note', 'create a `person` note for it' from r where way = 2
union all select 'warning', 'ambiguous_ref', r.node, '`item: ' || t.title || '` matches ' || w.n || ' notes: ' || array_to_string(w.ids, ', ') || case when len(w.ids) < w.n then ', …' else '' end, 'use a markdown link to the intended note'
  from r join t on t.k = r.k join (
    select name, count(*) as n, list_slice(list_sort(list(id)), 1, 5) as ids from (select lower(title) as name, 'p:' || k as id from t) group by name having count(*) > 1) w on w.name = lower(t.title) where way = 0""")  # fmt: skip
def _(spark, d):
    k = F.col("l_partkey").cast("string")
    way = F.col("l_linenumber") % 3
    parts = _parts(spark, d)
    line = table(spark, d, "lineitem").withColumn("id", F.concat(F.lit("p:"), k)).join(parts.select("id", "title"), "id", "left")
    refs = line.select(
        F.concat(F.lit("o:"), F.col("l_orderkey").cast("string")).alias("node"), F.lit("item").alias("key"),
        F.when(way == 1, F.concat(F.lit("[x](/parts/p"), k, F.lit(".md)"))).when(way == 2, F.concat(F.lit("nobody "), k)).otherwise(F.col("title")).alias("value"),
        F.lit("").alias("from_path"), F.when(way == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("person"))).alias("ranges"), F.lit(False).alias("soft"), way.alias("way"),
    )
    up = {"person": ["person", "node"], "part": ["part", "node"]}
    known = staged(keys(parts), "keys")
    found = staged(resolve(refs, staged(lookup(known), "lookup"), up), "references")
    return checks.reference_findings(found, up, None, sharers(found, known))


@query("unknown_type", f"""
select 'info' as level, 'unknown_type' as code, id as node, 'type `' || type || '` is not declared in the ontology (tolerated)' as message, 'add a class or use an existing one' as suggestion from {NODES_SQL} where type not in ('region', 'nation', 'order', 'part')""")
def _(spark, d):
    return checks.unknown_types(nodes(spark, d).withColumnRenamed("id", "node"), ["region", "nation", "order", "part"])


@query("unused_source", """
select 'info' as level, 'unused_source' as code, 'o:' || l_orderkey as node, 'source `' || l_suppkey || '` is declared but never cited' as message, 'cite it in the body or remove it' as suggestion
from (select distinct l_orderkey, l_suppkey from lineitem except select l_orderkey, l_suppkey from lineitem where l_returnflag = 'R')""")  # fmt: skip
def _(spark, d):
    own = table(spark, d, "lineitem").select(F.concat(F.lit("o:"), F.col("l_orderkey").cast("string")).alias("node"), F.col("l_suppkey").cast("string").alias("fid"), "l_returnflag")
    return checks.unused_sources(own, own.filter("l_returnflag = 'R'"))


@query("findings_report", "select level as section, rpad(level, 7, ' ') || ' ' || rpad('late', 26, ' ') || ' o:' || o_orderkey || ': ' || o_orderstatus || case when o_orderkey % 2 = 0 then '  → hurry' else '' end as rendered from (select *, ['error', 'warning', 'info'][(o_orderkey % 3) + 1] as level from orders) where level <> 'info'")
def _(spark, d):
    k = F.col("o_orderkey")
    level = F.element_at(F.array(F.lit("error"), F.lit("warning"), F.lit("info")), (k % 3 + 1).cast("int"))
    return checks.report(table(spark, d, "orders").select(*checks.finding(level, "late", F.concat(F.lit("o:"), k.cast("string")), F.col("o_orderstatus"), F.when(k % 2 == 0, "hurry").otherwise(""))))


# ---- derived facts -----------------------------------------------------------------------


@query("trust_tier", """
select d.doc_id, case when count(*) filter (l.quality = 1) > 0 then 'human-reviewed' when count(l.doc_id) > 0 then 'machine-confirmed' else 'unverified' end as trust_tier
from documents d left join labels l using (doc_id) group by d.doc_id""")  # fmt: skip
def _(spark, d):
    by = F.when(F.col("quality") == 1, "human:rater").otherwise("process:rules")
    events = table(spark, d, "labels").groupBy("doc_id").agg(F.collect_list(by).alias("actors"))
    return table(spark, d, "documents").select("doc_id").distinct().join(events, "doc_id", "left").select("doc_id", derive.trust_tier(F.col("actors")).alias("trust_tier"))


_NOW = "timestamp '1999-01-01 00:00:00'"


@query("stale", f"select key, coalesce(strptime(stale_after, '%Y-%m-%dT%H:%M:%SZ') < {_NOW}, false) as stale, status as status_effective from {NOTES_SQL}")
def _(spark, d):
    n = notes(spark, d)
    return n.select("key", derive.is_stale(F.col("stale_after"), F.lit("1999-01-01T00:00:00Z").cast("timestamp")).alias("stale"), derive.status_effective(F.col("status")).alias("status_effective"))


def _reliance(spark, d):
    """Orders rely on parts, customers' projects on orders; large parts are bad."""
    e = edges(spark, d)
    up = e.filter("pred = 'contains'").select("src", F.lit("links_to").alias("pred"), "dst", "origin")
    proj = e.filter("pred = 'placed_by'").select("src", F.lit("project").alias("pred"), "dst", "origin")
    bad = table(spark, d, "part").filter("p_size = 50").select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("id"))
    return up.unionByName(proj), bad


_HOP1 = "(select 'o:' || l_orderkey as id, 'p:' || l_partkey as hit from lineitem join part on p_partkey = l_partkey where p_size = 50 group by all)"


@query("at_risk_hop1", f"select id, list_sort(list(hit)) as \"on\" from {_HOP1} group by id")
def _(spark, d):
    e, bad = _reliance(spark, d)
    return derive.relying_on(e, bad)


@query("at_risk_hop2", f"select 'c:' || o_custkey as id, list_sort(list(h.id)) as \"by\" from (select distinct id from {_HOP1}) h join orders on h.id = 'o:' || o_orderkey group by o_custkey")
def _(spark, d):
    e, bad = _reliance(spark, d)
    return derive.depended_on_by(e, derive.relying_on(e, bad).select("id"))


_SUP = "(select 'o:' || o_orderkey as src, 'o:' || prev as dst, prev_state from (select o_orderkey, lag(o_orderkey) over w as prev, lag(o_orderstatus) over w as prev_state from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)) where prev is not null)"


def _superseding(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, d, "orders").withColumn("prev", F.lag("o_orderkey").over(w)).filter("prev is not null")
    return o.select(F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("src"), F.lit("supersedes").alias("pred"), F.concat(F.lit("o:"), F.col("prev").cast("string")).alias("dst"), F.lit("frontmatter").alias("origin"))


@query("superseded_direct", f"select dst as id, src as superseded_by from {_SUP}")
def _(spark, d):
    return derive.superseded_by(_superseding(spark, d))


@query("state_conflict", f"select dst as id, src as \"by\", prev_state as state from (select src, dst, case when prev_state = 'F' then 'superseded' else prev_state end as prev_state from {_SUP}) where prev_state <> 'superseded'")
def _(spark, d):
    states = table(spark, d, "orders").select(F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("id"), F.when(F.col("o_orderstatus") == "F", "superseded").otherwise(F.col("o_orderstatus")).alias("state"))
    return derive.state_conflicts(_superseding(spark, d), states)


@query("decision_without_context", "select 'c:' || c_custkey as id from customer where c_custkey not in (select o_custkey from orders where left(o_orderpriority, 1) = '1')")
def _(spark, d):
    urgent = table(spark, d, "orders").filter("left(o_orderpriority, 1) = '1'")  # what ties a customer to a project
    tied = urgent.select(F.concat(F.lit("c:"), F.col("o_custkey").cast("string")).alias("src"), F.lit("project").alias("pred"))
    return derive.without_context(table(spark, d, "customer").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("id")), tied)


# ---- policy over the graph ---------------------------------------------------------------


@query("redacted_graph", f"""
with hidden as (select 'c:' || c_custkey as id from customer where c_acctbal < 0)
select src, pred, dst, origin from {EDGES_SQL} where src not in (select id from hidden) and dst not in (select id from hidden)""")  # fmt: skip
def _(spark, d):
    hidden = table(spark, d, "customer").filter("c_acctbal < 0").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("rel"))
    return policy.visible(policy.visible(edges(spark, d), hidden, "src"), hidden, "dst")


# ---- exports -----------------------------------------------------------------------------


@query("ntriples", """
select '<urn:x:o:' || o_orderkey || '> <urn:x:state> "' || o_orderstatus || '" .' as line from orders
union all select '<urn:x:o:' || o_orderkey || '> <urn:x:total> "' || trunc(o_totalprice)::bigint || '"^^<http://www.w3.org/2001/XMLSchema#integer> .' from orders
union all select '<urn:x:o:' || o_orderkey || '> <urn:x:date> "' || strftime(o_orderdate, '%Y-%m-%d') || '"^^<http://www.w3.org/2001/XMLSchema#date> .' from orders
union all select '<urn:x:o:' || o_orderkey || '> <urn:x:placed_by> <urn:x:c:' || o_custkey || '> .' from orders""")  # fmt: skip
def _(spark, d):
    o = table(spark, d, "orders")
    node = F.concat(F.lit("o:"), F.col("o_orderkey").cast("string"))
    s = exports.iri("urn:x:", node)
    term = lambda t: exports.expanded(F.lit(t), {}, "urn:x:")
    lit = lambda kind, v: exports.literal(F.lit(kind), v.cast("string"))
    lines = F.array(
        exports.triple(s, term("state"), lit("str", F.col("o_orderstatus"))), exports.triple(s, term("total"), lit("int", F.col("o_totalprice").cast("long"))),
        exports.triple(s, term("date"), lit("date", F.date_format("o_orderdate", "yyyy-MM-dd"))), exports.triple(s, term("placed_by"), F.concat(F.lit("<"), exports.iri("urn:x:", F.concat(F.lit("c:"), F.col("o_custkey").cast("string"))), F.lit(">"))),
    )
    return o.select(F.explode(lines).alias("line"))


@query("json_edges", f"select src, pred, dst, '{{\"src\":\"' || src || '\",\"pred\":\"' || pred || '\",\"dst\":\"' || dst || '\",\"origin\":\"' || origin || '\"}}' as json from {EDGES_SQL}")
def _(spark, d):
    return exports.json_edges(edges(spark, d))


@query("props_eav", """
select 'o:' || o_orderkey as node, 'state' as key, o_orderstatus as value from orders
union all select 'o:' || o_orderkey, 'priority', o_orderpriority from orders where o_orderkey % 2 = 0
union all select 'o:' || o_orderkey, 'date', strftime(o_orderdate, '%Y-%m-%d') from orders""")
def _(spark, d):
    k = F.col("o_orderkey")
    props = _eav(table(spark, d, "orders"), F.concat(F.lit("o:"), k.cast("string")), F.lit("order"), ("state", F.col("o_orderstatus")), ("priority", F.when(k % 2 == 0, F.col("o_orderpriority"))), ("date", F.date_format("o_orderdate", "yyyy-MM-dd")))
    return graph(spark, d, props).props_table()


# ---- guarded SQL -------------------------------------------------------------------------


def _gate(name: str, statement: str, sql: str | None = None) -> None:
    def run(spark, d):
        tables = {"nodes": nodes(spark, d), "edges": edges(spark, d)}
        return sqlgate.query(spark, statement, tables, 1 << 30)

    duck = (sql or statement).replace("from nodes", f"from {NODES_SQL} nodes").replace("from edges", f"from {EDGES_SQL} edges").replace("join nodes", f"join {NODES_SQL}")
    query(name, duck)(run)


_gate("sql_passthrough_window", "select src, dst, row_number() over (partition by src order by dst) as rn, count(*) over (partition by src) as n from edges where pred = 'contains'", "select src, dst, (row_number() over (partition by src order by dst))::int as rn, count(*) over (partition by src) as n from edges where pred = 'contains'")
_gate("sql_passthrough_setops", "select src as id from edges where pred = 'placed_by' intersect select src as id from edges where pred = 'contains' except select id from nodes where title = 'Order 7'")
_gate("sql_passthrough_group", "select pred, count(*) as n, count(distinct dst) as targets from edges group by pred having count(*) > 20")
_gate("sql_passthrough_recursive", "with recursive r(node, depth) as (select 'r:1' as node, 0 as depth union all select e.src, r.depth + 1 from edges e join r on e.dst = r.node where e.pred = 'located_in' and r.depth < 3) select node, depth from r")
SQL["sql_passthrough_recursive"] = f"with recursive r(node, depth) as (select 'r:1' as node, 0 as depth union all select e.src, r.depth + 1 from {EDGES_SQL} e join r on e.dst = r.node where e.pred = 'located_in' and r.depth < 3) select node, depth from r"


_gate("sql_passthrough_cycle", "with recursive ways(a, b) as (select src as a, dst as b from edges where pred = 'located_in' union select dst, src from edges where pred = 'located_in'), r(node) as (select 'n:3' as node union select b from r join ways on a = node) select node from r")
SQL["sql_passthrough_cycle"] = f"with recursive ways(a, b) as (select src as a, dst as b from {PLACES_SQL} union select dst, src from {PLACES_SQL}), r(node) as (select 'n:3' as node union select b from r join ways on a = node) select node from r"


# ---- further tables of the graph ---------------------------------------------------------


@query("graph_counts", f"select 'nodes' as key, count(*)::varchar as value from {NODES_SQL} union all select 'edges', count(*)::varchar from {EDGES_SQL}")
def _(spark, d):
    return graph(spark, d).meta_table().filter("key in ('nodes', 'edges')").select("key", "value")


@query("relation_labels", f"""
select e.src, e.pred, list_sort(list(distinct n.title || ' (' || n.id || ') [' || n.type || ']')) as labels
from {EDGES_SQL} e join {NODES_SQL} n on n.id = e.dst group by e.src, e.pred""")  # fmt: skip
def _(spark, d):
    return graph(spark, d).relations()


@query("node_labels", f"""
select rel, title || ' (' || rel || ') [' || type || ', state=' || state || ', health=' || health || ', status=' || status || case when key % 2 = 0 then ', stale' else '' end || ']' as label from {NOTES_SQL}""")
def _(spark, d):
    n = notes(spark, d).withColumns({"id": F.col("rel"), "stale": F.col("key") % 2 == 0, "props": F.to_json(F.struct("state", "health", "status"))})
    return n.select("rel", label().alias("label"))


@query("actor_nodes", """
select distinct 'actor:' || a as id, a as title, case when a like 'human:%' then 'human actor' when a like 'process:%' then 'process actor' else 'agent actor' end as description
from (select ['human:', 'process:', 'agent/'][(user_id % 3) + 1] || user_id as a from events) where a <> 'human:3'""")  # fmt: skip
def _(spark, d):
    by = F.concat(F.element_at(F.array(F.lit("human:"), F.lit("process:"), F.lit("agent/")), (F.col("user_id") % 3 + 1).cast("int")), F.col("user_id").cast("string"))
    return actor_nodes(table(spark, d, "events").select(by.alias("by")), "human:3").select("id", "title", "description")


@query("source_nodes", """
select 'source:' || p_brand as id, arg_min(p_name, p_partkey) as title from part group by p_brand""")
def _(spark, d):
    own = table(spark, d, "part").select(F.concat(F.lit("source:"), "p_brand").alias("sid"), F.col("p_brand").alias("resource"), F.col("p_name").alias("title"), F.lit(None).cast("string").alias("modified"), F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("node"), F.lit(0).alias("no"))
    return source_nodes(own).select("id", "title")


@query("retrieval_recall", """
select o_orderkey as query, max(case when rank <= 3 and file = want then 1 else 0 end) = 1 as hit
from (select o_orderkey, 'p' || l_partkey as file, l_linenumber as rank, 'p' || (o_orderkey % 2000) as want from lineitem join orders on l_orderkey = o_orderkey) group by 1""")  # fmt: skip
def _(spark, d):
    line = table(spark, d, "lineitem")
    found = line.select(F.col("l_orderkey").alias("query"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("file"), F.col("l_linenumber").alias("rank"))
    expected = line.select(F.col("l_orderkey").alias("query")).distinct().withColumn("file", F.concat(F.lit("p"), (F.col("query") % 2000).cast("string")))
    return recall(found, expected, 3)
