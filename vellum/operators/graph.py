"""The note graph: nodes, edges, findings and derived facts as DataFrames.

Building it is a handful of joins over the parsed notes. What several steps read is written
out once; nothing of the graph is held on the driver.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.vault import RESERVED, Vault, in_folder
from . import checks, derive
from . import edges as E
from .ontology import Ontology
from .resolve import SELF, keys, lookup, resolve, sharers, suggestions
from .staging import staged

KNOWLEDGE = "knowledge"
#: Properties that a context pack shows, in this order.
PACKED = ("state", "health", "status", "due", "milestone", "date", "stale_after")
DERIVED = ("trust_tier", "stale", "status_effective", "at_risk", "superseded_by")


@dataclass(frozen=True)
class Graph:
    """nodes: id, kind, type, title, description, path, mtime, props (JSON), sensitivity and the
    derived columns; edges: src, pred, dst, origin; findings; props: node, key, is_list, is_map,
    items; events: node, field, by, at, at_tag."""

    nodes: DataFrame
    edges: DataFrame
    findings: DataFrame
    props: DataFrame
    events: DataFrame
    lookup: DataFrame
    built_at: str
    owner: str
    ontology: Ontology

    # -- the relational form
    def props_table(self) -> DataFrame:
        """node, key, value: scalars and list items; mappings, null and empty text are left out."""
        x = self.props.filter(~F.col("is_map")).select("node", "key", F.explode("items").alias("x"))
        x = x.filter(~F.col("x.tag").isin("null", "map", "list") & (F.coalesce("x.str", F.lit("")) != ""))
        return x.select("node", "key", F.col("x.str").alias("value"))

    def derived_table(self) -> DataFrame:
        """node, key, value: a row for each derived fact, truth values as true and false."""
        cols = ", ".join(f"'{c}', cast({c} as string)" for c in DERIVED)
        notes = self.nodes.filter("kind = 'note'")
        return notes.select(F.col("id").alias("node"), F.expr(f"stack({len(DERIVED)}, {cols}) as (key, value)")).filter("value is not null")

    def meta_table(self) -> DataFrame:
        """When the graph was built, and its size; counted when it is read."""
        built = self.nodes.sparkSession.range(1).select(F.lit("built_at").alias("key"), F.lit(self.built_at).alias("value"))
        size = lambda name, df: df.agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit(name).alias("key"), "value")
        return built.unionByName(size("nodes", self.nodes)).unionByName(size("edges", self.edges))

    def tables(self) -> dict[str, DataFrame]:
        """The tables and views that queries see."""
        derived = self.derived_table()
        facts = lambda key: derived.filter(F.col("key") == key)
        return {
            "meta": self.meta_table(),
            "nodes": self.nodes.select("id", "kind", "type", "title", "description", "path", "mtime", "props"),
            "edges": self.edges, "props": self.props_table(), "derived": derived, "findings": self.findings,
            "v_trust": facts("trust_tier").select(F.col("node").alias("id"), F.col("value").alias("trust_tier")),
            "v_stale": facts("stale").filter("value = 'true'").select(F.col("node").alias("id")),
            "v_at_risk": facts("at_risk").filter("value = 'true'").select(F.col("node").alias("id")),
        }

    # -- references and traversal
    def resolve_id(self, ref: str) -> str | None:
        """The node that an id, a path without suffix, or a unique stem or title names."""
        exact = self.nodes.filter(F.col("id").isin(ref, ref if ref.endswith(".md") else ref + ".md")).select("id").limit(2).collect()
        ids = [r["id"] for r in exact]
        if ids:
            return ref if ref in ids else ids[0]
        low = F.lower(F.trim(F.lit(ref)))
        hit = self.nodes.filter((F.col("kind") == "note") & ((F.lower(T.path_stem(F.col("path"))) == low) | (T.name_key(F.col("title")) == T.name_key(F.lit(ref)))))
        some = hit.select("id").limit(2).collect()
        return some[0]["id"] if len(some) == 1 else None

    def neighbors(self, node: str, depth: int = 1, preds: list[str] | None = None) -> DataFrame:
        at = self.resolve_id(node)
        start = self.nodes.sparkSession.createDataFrame([(at,)] if at else [], "id string")
        return E.neighbors(self.edges, start, depth, preds)

    def shortest_path(self, a: str, b: str, skip: tuple[str, ...] = E.PROVENANCE) -> list[tuple[str, str, str]]:
        a_id, b_id = self.resolve_id(a), self.resolve_id(b)
        return E.shortest_path(self.edges, a_id, b_id, skip) if a_id and b_id else []

    def relations(self, of: Column | None = None) -> DataFrame:
        """src, pred, labels: what each node is tied to (of: only for edges that this holds for)."""
        names = self.nodes.select(F.col("id").alias("dst"), label().alias("label"))
        edges = self.edges if of is None else self.edges.filter(of)
        return edges.join(names, "dst", "left").groupBy("src", "pred").agg(F.sort_array(F.collect_set(F.coalesce("label", "dst"))).alias("labels"))

    def pack_lines(self, node: str) -> DataFrame:
        """block, no, line: the pack of a node (an id) as rows: its head, what it says of itself,
        what is derived of it, and its own relations."""
        own = self.nodes.filter(F.col("id") == node)
        entry = lambda no, name, value: F.struct(F.lit(no).alias("no"), F.concat(F.lit(f"- {name}: "), value).alias("line"))
        head = F.array(F.struct(F.lit(0).alias("no"), F.concat(F.lit("# "), "title").alias("line")), entry(1, "id", F.col("id")), entry(2, "type", F.col("type")), entry(3, "description", F.nullif("description", F.lit(""))))
        made = F.array(*[entry(no, f"{c} (derived)", F.col(c).cast("string")) for no, c in enumerate(sorted(DERIVED))])
        rows = lambda block, items: own.select(F.lit(block).alias("block"), F.inline(items))
        order = F.create_map(*[x for no, k in enumerate(PACKED) for x in (F.lit(k), F.lit(no))])
        said = self.props.filter((F.col("node") == node) & F.col("key").isin(*PACKED))
        said = said.select(F.lit(1).alias("block"), order[F.col("key")].alias("no"), F.concat(F.lit("- "), "key", F.lit(": "), F.nullif(F.element_at("items", 1)["str"], F.lit(""))).alias("line"))
        ends = self.relations(F.col("src") == node)
        ends = ends.select(F.lit(3).alias("block"), F.rank().over(Window.orderBy("pred")).alias("no"), F.concat(F.lit("- "), "pred", F.lit(": "), F.array_join("labels", "; ")).alias("line"))
        return rows(0, head).unionByName(said).unionByName(rows(2, made)).unionByName(ends).filter("line is not null")

    def context_pack(self, node: str, depth: int = 1) -> str:
        """What a reader should know of a node, as Markdown. Relations are the node's own, at any
        depth of 1 or more; at depth 0 there are none."""
        at = self.resolve_id(node)
        if at is None:
            return f"No node matches {node!r}."
        lines = self.pack_lines(at).filter((F.col("block") < 3) | F.lit(depth > 0)).orderBy("block", "no").collect()
        title = next((i for i, r in enumerate(lines) if r["block"] == 3), None)
        text = [r["line"] for r in lines]
        if title is not None:
            text[title:title] = ["", "## Relations"]
        return "\n".join([*text, ""])

    def without(self, hidden: DataFrame) -> Graph:
        """The graph without some nodes (a column id): no edge at either end, no finding of them."""
        drop = lambda df, col: df.join(hidden.select(F.col("id").alias(col)), col, "left_anti").select(*df.columns)
        return replace(self, nodes=drop(self.nodes, "id"), edges=drop(drop(self.edges, "src"), "dst"), findings=drop(self.findings, "node"), props=drop(self.props, "node"), events=drop(self.events, "node"))


def label() -> Column:
    """title (id) [type, k=v, stale] of a nodes row."""
    get = lambda k: F.get_json_object("props", f"$.{k}")
    extra = [F.concat(F.lit(f"{k}="), F.nullif(get(k), F.lit(""))) for k in ("state", "health", "status")]
    return F.concat("title", F.lit(" ("), "id", F.lit(") ["), F.concat_ws(", ", "type", *extra, F.when(F.col("stale"), "stale")), F.lit("]"))


def actor_nodes(events: DataFrame, owner: str | None) -> DataFrame:
    """id, kind, type, title, description, props of the actors (by) but for the owner's."""
    by = F.col("by")
    kind = F.when(by.startswith("human:"), "human").when(by.startswith("process:"), "process").otherwise("agent")
    return events.filter(~by.eqNullSafe(owner)).select("by").distinct().select(
        F.concat(F.lit("actor:"), by).alias("id"), F.lit("actor").alias("kind"), F.lit("actor").alias("type"), by.alias("title"),
        F.concat(kind, F.lit(" actor")).alias("description"), F.to_json(F.struct(kind.alias("actor_kind"))).alias("props"),
    )


def source_nodes(given: DataFrame) -> DataFrame:
    """id, kind, type, title, props of sources (sid, resource, title, modified, node, no): one for
    each resource, with what the first note in order says of it."""
    first = given.groupBy("sid").agg(F.min_by(F.struct("resource", "title", F.col("modified").alias("last_modified")), F.struct("node", "no")).alias("s"))
    return first.select(F.col("sid").alias("id"), F.lit("source").alias("kind"), F.lit("source").alias("type"), F.coalesce("s.title", F.trim("s.resource")).alias("title"), F.to_json("s").alias("props"))


def build(vault: Vault, now: dt.datetime | None = None) -> Graph:
    """Nodes, edges, findings and derived facts of a vault."""
    spark, onto = vault.spark, vault.ontology
    now = now or dt.datetime.now(dt.UTC)
    owner, folder = vault.owner_actor(), vault.template_folder()[0]
    rel = F.col("rel")
    notes = vault.notes("rel", "mtime", "valid", "fm", "props", "mapped", "events", "sources", "body").filter(F.col("valid") & ~T.path_name(rel).isin(*RESERVED) & ~in_folder(rel, folder))
    at = lambda k: F.try_element_at(F.filter("props", lambda x: x["key"] == k), F.lit(1))
    text = lambda k: F.try_element_at(at(k)["items"], F.lit(1))
    title = F.when((text("title")["tag"] == "str") & (F.trim(text("title")["str"]) != ""), text("title")["str"]).otherwise(T.path_stem(rel))
    aliases = F.transform(F.filter(F.when(at("aliases")["is_list"], at("aliases")["items"]), lambda x: x["tag"] == "str"), lambda x: x["str"])
    notes = notes.withColumns({
        "type": F.coalesce(F.nullif(text("type")["str"], F.lit("")), F.lit("unknown")), "title": title,
        "description": F.trim(F.coalesce(text("description")["str"], F.lit(""))), "aliases": aliases,
        "status": text("status")["str"], "state": text("state")["str"], "sensitivity": F.lower(text("sensitivity")["str"]),
        "stale_after": F.when(text("stale_after")["tag"].isin("datetime", "str"), text("stale_after")["str"]).when(text("stale_after")["tag"] == "naive", F.concat(text("stale_after")["str"], F.lit("+00:00"))),
    })
    notes = staged(notes.withColumn("node", rel), "notes")
    props = notes.select("node", "type", F.explode("props").alias("p")).select("node", "type", "p.*")

    # references
    known = staged(keys(notes.select(F.col("node").alias("id"), "type", F.col("node").alias("path"), "title", "aliases")), "keys")
    table = staged(lookup(known), "lookup")
    lineage = onto.lineage()
    specs = F.broadcast(onto.spec_table(spark))  # as large as the ontology
    typed = checks.specced(props, specs)
    body = T.strip_unrendered(F.col("body"))
    md = notes.select("node", F.explode(T.found(body, T.MD_LINK)).alias("t")).filter(~T.is_external(F.col("t"))).select("node", F.concat(F.lit("[x]("), "t", F.lit(")")).alias("value"))
    wiki = notes.select("node", F.explode(T.found(body, T.WIKILINK)).alias("t")).select("node", F.concat(F.lit("[["), F.trim("t"), F.lit("]]")).alias("value"))
    linked = md.unionByName(wiki).select("node", F.lit("links_to").alias("key"), "value", F.col("node").alias("from_path"), F.array().cast("array<string>").alias("ranges"), F.lit(None).cast("boolean").alias("soft"))
    refs = resolve(checks.references(typed).unionByName(linked), table, lineage, owner)
    refs = staged(refs.withColumn("is_link", F.col("soft").isNull()), "references")
    lost = refs.filter("not is_link and method = 'unresolved'").select("value", "ranges").distinct()
    pool = notes.select(F.col("node").alias("id"), "type", F.explode(F.array(T.name_key(F.col("title")), F.lower(T.path_stem(rel)))).alias("key"))
    close, shared = suggestions(lost, pool, lineage=lineage), sharers(refs.filter("not is_link"), known)

    # provenance and sources
    events = notes.select("node", F.explode("events").alias("e")).select("node", "e.*")
    acted = events.filter(F.col("ok") & F.col("by").isNotNull())
    actor = F.when(F.col("by") == owner, SELF).otherwise(F.concat(F.lit("actor:"), "by"))
    given = notes.select("node", F.explode("sources").alias("s")).select("node", "s.*").filter(F.col("resource").isNotNull())
    given = given.withColumn("sid", F.concat(F.lit("source:"), F.trim("resource")))
    cited = notes.select("node", F.explode(F.array_distinct(T.found(body, T.FOOTNOTE))).alias("fid"))
    declared = given.filter("id is not null").groupBy("node", F.col("id").alias("fid")).agg(F.max_by("sid", "no").alias("sid"))
    edge = lambda src, pred, dst, origin: [src.alias("src"), pred.alias("pred"), dst.alias("dst"), F.lit(origin).alias("origin")]
    node = F.col("node")
    direct = refs.filter("target is not null").select(node.alias("src"), F.col("key").alias("pred"), F.col("target").alias("dst"), F.when(F.col("is_link"), "body").otherwise("frontmatter").alias("origin"))
    direct = direct.unionByName(acted.select(*edge(node, F.when(F.col("field") == "generated", "generated_by").otherwise("verified_by"), actor, "frontmatter")))
    direct = direct.unionByName(given.select(*edge(node, F.lit("has_source"), F.col("sid"), "frontmatter")))
    direct = direct.unionByName(cited.join(declared, ["node", "fid"]).select(*edge(node, F.lit("cites"), F.col("sid"), "body")))
    direct = staged(E.distinct_edges(direct, listed=True), "direct-edges")

    # derived edges: inverses of what is there, then closures with their inverses
    inverses = onto.inverses()
    edges = direct.unionByName(E.inverse_edges(direct, inverses))
    for pred in onto.transitive():
        far = E.closure(edges, pred)
        edges = edges.unionByName(far).unionByName(E.inverse_edges(far, {pred: inverses[pred]} if pred in inverses else {}))
    edges = staged(E.distinct_edges(edges, listed=True), "edges")

    # derived facts
    is_knowledge = F.col("type").isin(*[c for c in lineage if KNOWLEDGE in lineage[c]], KNOWLEDGE)
    checked = F.transform(F.filter("events", lambda e: (e["field"] == "verified") & e["ok"]), lambda e: e["by"])
    rule = lambda name, value: value if onto.rule(name) else F.lit(None)
    facts = notes.select(
        F.col("node").alias("id"), "type", "state",
        rule("trust_tier", derive.trust_tier(checked)).alias("trust_tier"),
        rule("stale", derive.is_stale(F.col("stale_after"), F.lit(now))).alias("stale"),
        F.when(is_knowledge, derive.status_effective(F.col("status"))).alias("status_effective"),
        is_knowledge.alias("knowledge"),
    )
    facts = staged(facts, "facts")
    bad = facts.filter(F.coalesce("stale", F.lit(False)) | F.col("status_effective").eqNullSafe("deprecated")).select("id")
    found = []
    if onto.rule("at_risk"):
        risky = derive.relying_on(edges, bad).join(facts.filter("knowledge").select("id"), "id", "left_semi")
        late = derive.depended_on_by(edges, bad.unionByName(risky.select("id")).distinct()).join(facts.filter("type = 'project'").select("id"), "id", "left_semi")
        facts = facts.join(risky, "id", "left").join(late, "id", "left")
        facts = facts.withColumn("at_risk", F.when(F.col("type") == "project", F.col("by").isNotNull()).when(F.col("knowledge"), F.col("on").isNotNull()))
        listed = lambda c: F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]"))
        found.append(risky.select(*checks.finding("warning", "at_risk", F.col("id"), F.concat(F.lit("relies on stale or deprecated knowledge: "), listed("on")), "re-verify the cited notes or update this one")))
        found.append(late.select(*checks.finding("warning", "project_at_risk", F.col("id"), F.concat(F.lit("depends on at-risk or stale notes: "), listed("by")))))
    else:
        facts = facts.withColumn("at_risk", F.lit(None).cast("boolean"))
    if onto.rule("superseded"):
        facts = facts.join(derive.superseded_by(edges), "id", "left")
        clash = derive.state_conflicts(edges, facts.select("id", "state"))
        found.append(clash.select(*checks.finding("warning", "state_conflict", F.col("id"), F.concat(F.lit("is superseded by "), "by", F.lit(" but has state `"), F.coalesce("state", F.lit("None")), F.lit("`")), "set state: superseded (reconcile does this)")))
    else:
        facts = facts.withColumn("superseded_by", F.lit(None).cast("string"))
    if onto.rule("decision_needs_context"):
        lone = derive.without_context(facts.filter("type = 'decision'").select("id"), edges)
        found.append(lone.select(*checks.finding("warning", "decision_without_context", F.col("id"), F.lit("decision has neither a project nor an area"), "set `project:` or `area:`")))
    if onto.rule("unused_source"):
        found.append(checks.unused_sources(declared, cited))
    owned = notes.select("node", "type")
    found += [
        notes.select("node", F.explode("mapped").alias("m")).select(*checks.finding("warning", "property_alias", node, F.col("m"), "rename the property in the note so every tool sees the canonical name")),
        checks.unknown_types(owned, list(onto.classes)), checks.missing_required(owned, props, specs.filter("class <> '*'")), checks.enum_violations(typed),
        checks.type_violations(typed), checks.cardinality(typed), checks.reference_findings(refs.filter("not is_link"), lineage, close, shared),
    ]
    findings = found[0]
    for f in found[1:]:
        findings = findings.unionByName(f)

    # nodes
    empty = {"description": F.lit(""), "path": F.lit(""), "mtime": F.lit(0.0), "sensitivity": F.lit(None).cast("string"), **{c: F.lit(None).cast("boolean" if c in ("stale", "at_risk") else "string") for c in DERIVED}}
    columns = ["id", "kind", "type", "title", "description", "path", "mtime", "props", "sensitivity", *DERIVED]
    own = notes.select(F.col("node").alias("id"), F.lit("note").alias("kind"), "title", "description", F.col("node").alias("path"), "mtime", F.coalesce("fm", F.lit("{}")).alias("props"), "sensitivity").join(facts.drop("state", "knowledge", "on", "by"), "id").select(*columns)
    me = spark.createDataFrame([(SELF, "virtual", "person", "me", owner)], "id string, kind string, type string, title string, actor string")
    me = me.withColumns({**empty, "description": F.lit("The vault owner"), "props": F.to_json(F.struct("actor"))}).select(*columns)
    actors = actor_nodes(acted, owner).withColumns({c: v for c, v in empty.items() if c != "description"}).select(*columns)
    sources = source_nodes(given).withColumns(empty).select(*columns)
    nodes = staged(own.unionByName(me).unionByName(actors).unionByName(sources), "nodes")
    return Graph(nodes, edges, staged(findings, "findings"), props.drop("type"), events, table, now.isoformat(), owner, onto)
