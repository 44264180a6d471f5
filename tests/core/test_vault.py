"""A small vault with faults: graph, findings, derived facts, exports, edits, policy."""

import datetime as dt
import json
import re
import sqlite3

import pytest

from vellum.engine import Engine
from vellum.operators import edits, exports, sqlgate
from vellum.operators.graph import build
from vellum.operators.policy import Policy, PolicyError, name_fault, token_ok
from vellum.sources.vault import Vault

from .conftest import NOW


@pytest.fixture
def graph(spark, vault):
    return build(Vault(spark, str(vault)), NOW)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_nodes_edges_and_findings(graph):
    nodes = {r.id: r for r in graph.nodes.collect()}
    assert "07-knowledge/utf16.md" not in nodes and "_private/x.md" not in nodes and "90-templates/daily.md" not in nodes
    assert nodes["07-knowledge/bom.md"].title == "Bom" and nodes["self"].kind == "virtual"
    assert nodes["actor:agent/1"].description == "agent actor" and "actor:human:ann" not in nodes
    assert nodes["source:https://a.example"].title == "A"
    edges = {(r.src, r.pred, r.dst): r.origin for r in graph.edges.collect()}
    for edge, origin in {
        ("03-projects/apollo.md", "owner", "05-people/ann-bee.md"): "frontmatter",
        ("05-people/ann-bee.md", "owns", "03-projects/apollo.md"): "derived",
        ("03-projects/hermes.md", "owner", "05-people/will-fox.md"): "frontmatter",
        ("05-people/will-fox.md", "links_to", "05-people/ann-bee.md"): "body",
        ("06-decisions/d2.md", "supersedes", "06-decisions/d1.md"): "frontmatter",
        ("06-decisions/d3.md", "supersedes", "06-decisions/d1.md"): "derived",
        ("06-decisions/d1.md", "superseded_by", "06-decisions/d3.md"): "derived",
        ("07-knowledge/spec.md", "cites", "source:https://a.example"): "body",
        ("07-knowledge/spec.md", "generated_by", "actor:agent/1"): "frontmatter",
        ("03-projects/apollo.md", "verified_by", "self"): "frontmatter",
    }.items():
        assert edges.get(edge) == origin, edge
    assert not any(d == "06-decisions/lone.md" and p == "links_to" for _, p, d in edges)
    found = {(r.code, r.node, r.level) for r in graph.findings.collect()}
    for want in [
        ("property_alias", "03-projects/apollo.md", "warning"), ("property_alias", "07-knowledge/spec.md", "warning"), ("enum_violation", "03-projects/hermes.md", "error"),
        ("missing_required", "06-decisions/lone.md", "error"), ("decision_without_context", "06-decisions/lone.md", "warning"), ("unknown_type", "02-meetings/m.md", "info"),
        ("unresolved_ref", "05-people/will-fox.md", "info"), ("unused_source", "07-knowledge/spec.md", "info"), ("at_risk", "07-knowledge/spec.md", "warning"),
        ("project_at_risk", "03-projects/apollo.md", "warning"), ("state_conflict", "06-decisions/d1.md", "warning"), ("state_conflict", "06-decisions/d2.md", "warning"),
    ]:
        assert want in found, want
    assert nodes["06-decisions/d1.md"].superseded_by == "06-decisions/d2.md"
    assert (nodes["03-projects/apollo.md"].trust_tier, nodes["07-knowledge/old.md"].stale, nodes["07-knowledge/old.md"].status_effective) == ("human-reviewed", True, "stable")
    assert json.loads(nodes["03-projects/apollo.md"].props)["health"] == "yellow"


def test_traversal_and_sql(engine):
    assert [s[1] for s in engine.path("Hermes", "Ann Bee")] == ["owner", "links_to"]
    assert engine.path("apollo", "03-projects/apollo.md") == []
    near = rows(engine.neighbors("D three", 2, ["supersedes"]))
    assert ("06-decisions/d3.md", "supersedes", "06-decisions/d2.md", 1) in near and ("06-decisions/d2.md", "supersedes", "06-decisions/d1.md", 2) in near
    pack = engine.context("Spec")
    assert "at_risk (derived): True" in pack or "at_risk (derived): true" in pack.lower()
    assert "- links_to: Old (07-knowledge/old.md) [concept, stale]" in pack
    assert engine.sql("select count(*) as n from nodes where kind = 'note'").first().n > 15
    assert rows(engine.sql("select id from v_stale")) == [("07-knowledge/old.md",)]
    assert engine.sql("with a as (select src from edges) select distinct src from a", 3).count() == 3


@pytest.mark.parametrize(
    "bad",
    [
        "delete from nodes", "with x as (select 1) insert into nodes select * from x", "select * from text.`/etc/passwd`", "select * from parquet.`/tmp/x`", "select java_method('java.lang.System', 'exit', 0)",
        "select reflect('java.lang.System', 'getenv')", "select * from other", "select (select max(id) from other)", "select transform(id) using 'cat' from nodes", "select id from nodes where id in (select java_method('a', 'b'))",
        "select * from nodes; drop table nodes", "explain select 1", "values (1)", "select * from read_files('/etc')", "with nodes2 as (select * from secret) select * from nodes2",
    ],
)
def test_gate_refuses(spark, bad):
    tables = {"nodes": spark.createDataFrame([("a",)], "id string"), "edges": spark.createDataFrame([("a",)], "src string")}
    with pytest.raises(sqlgate.Refused):
        sqlgate.query(spark, bad, tables)


def test_gate_accepts(spark):
    tables = {"nodes": spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")}
    for sql in (
        "select * from nodes n join nodes m on n.id = m.id", "with x as (select id from nodes) select count(*) as c from x", "select id, row_number() over (order by n desc) as r from nodes",
        "select id from nodes union select 'c' except select 'a'", "select id from nodes where exists (select 1 from nodes m where m.n > nodes.n) order by id limit 1", "select explode(array(1, 2)) as x from nodes",
        "with recursive r(i) as (select 1 as i union all select i + 1 from r where i < 3) select i from r", "select n, count(*) from nodes group by n having count(*) > 0",
    ):
        sqlgate.query(spark, sql, tables).collect()


def test_validate(engine):
    good, found, onto = engine.validate()
    by = {(r.rule, r.rel) for r in found.collect()}
    for want in [
        ("DOC-01", "07-knowledge/utf16.md"), ("DOC-05", "07-knowledge/bad-yaml.md"), ("DOC-05", "07-knowledge/bad-date.md"), ("LNK-01", "02-meetings/m.md"),
        ("LNK-02", "02-meetings/m.md"), ("LNK-04", "02-meetings/m.md"), ("DOC-08", "07-knowledge/spec.md"),
    ]:
        assert want in by, want
    assert not any(rel in ("Inbox.md", "index.md", "log.md", "07-knowledge/bom.md") for _, rel in by)
    assert not good and onto.count() > 5


def test_tasks_and_sync(engine, vault):
    todo = engine.todos()
    assert todo["counts"] == {"open": 3, "overdue": 1, "due_soon": 1, "no_owner": 1}
    assert {(r.file, r.line) for r in todo["conflicts"].collect()} == {("03-projects/apollo.md", 19), ("03-projects/hermes.md", 10)}
    assert [r.text for r in engine.todos("ann bee", True)["tasks"].collect()] == ["ship the beta build"]
    assert [t["file"] for t in engine.sync_done()] == ["03-projects/hermes.md"]
    assert "- [x] order the big screen" in (vault / "03-projects/hermes.md").read_text()
    text = (vault / engine.write_digest()).read_text()
    assert "1 overdue, 1 due soon" in text and "### Ann Bee" in text


def test_reconcile(engine, vault):
    codes = {(c["code"], c["file"], c["node"]) for c in engine.reconcile()}
    assert {
        ("state_conflict", "06-decisions/d1.md", "06-decisions/d1.md"), ("hub_drift", "03-projects/projects.md", "03-projects/apollo.md"), ("hub_broken_row", "03-projects/projects.md", None),
        ("hub_missing_row", "03-projects/projects.md", "03-projects/hermes.md"), ("hub_drift", "06-decisions/decision-log.md", "06-decisions/d2.md"), ("hub_missing_row", "06-decisions/decision-log.md", "06-decisions/d3.md"),
        ("priorities_missing_open_decision", "00-home/priorities.md", "06-decisions/lone.md"),
    } <= codes
    engine.reconcile(apply=True)
    hub = (vault / "03-projects/projects.md").read_text()
    assert "| [Apollo](apollo.md) | yellow | active | Beta 2026-10-01 | my words |" in hub and "[Hermes](hermes.md)" in hub
    log = (vault / "06-decisions/decision-log.md").read_text().splitlines()
    assert [x[2:12] for x in log if x.startswith("| 2026")] == ["2026-03-01", "2026-02-01", "2026-01-01"]
    assert "state: superseded" in (vault / "06-decisions/d1.md").read_text()
    left = {c["code"] for c in engine.reconcile()}
    assert "hub_drift" not in left and "state_conflict" not in left and "hub_missing_row" not in left


def test_minutes(engine, vault):
    recap = "Outcome: we go on with Apollo and that is long enough.\nDecided - use Spark\nTODO: call Bob — Ann Bee, due 2026-09-20\n- [ ] write it up\n- [x] done before\nWill joined; will we meet again?"
    m = engine.minutes(recap, "Weekly  sync\n", dt.date(2026, 9, 14), dry_run=True)
    assert (m.path, m.project, len(m.said["action"]), m.said["decision"], len(m.said["outcome"])) == ("02-meetings/2026-09-14-weekly-sync.md", "03-projects/apollo.md", 2, ["use Spark"], 1)
    assert m.people == ["05-people/ann-bee.md", "05-people/will-fox.md"]
    engine.minutes(recap, "Weekly sync", dt.date(2026, 9, 14), daily=True)
    text = (vault / m.path).read_text()
    assert "- [ ] call Bob — Ann Bee, due 2026-09-20" in text and "project: '[Apollo](../03-projects/apollo.md)'" in text.replace('"', "'") and "[the decision](../06-decisions/d1.md)" in text
    assert "Meeting filed" in (vault / "01-journal/daily/2026/09/2026-09-14.md").read_text()
    with pytest.raises(edits.EditError):
        engine.minutes(recap, "Weekly sync", dt.date(2026, 9, 14))
    assert any("call Bob" in r.text for r in engine.tasks().collect())


def test_exports(graph, tmp_path):
    out = exports.write_artifacts(graph, {"title": "dc:title", "dc": "http://purl.org/dc/terms/"}, str(tmp_path / "out"))
    data = json.loads(out["json"].read_text())
    assert len(data["nodes"]) == graph.nodes.count() and len(data["edges"]) == graph.edges.count()
    nt = out["nt"].read_text().splitlines()
    assert all(re.fullmatch(r'<[^<>" ]+> <[^<>" ]+> (<[^<>" ]+>|"(?:[^"\\\n]|\\.)*"(?:\^\^<[^<>" ]+>)?) \.', x) for x in nt)
    assert any("<http://purl.org/dc/terms/title>" in x for x in nt) and any("my%20key" in x for x in nt) and any("Meeting%20note" in x or "Meeting%20Note" in x for x in nt)
    assert sum("due> " in x and "XMLSchema#date" in x for x in nt) == 1
    ld = json.loads(out["jsonld"].read_text())
    owner = next(n for n in ld["@graph"] if n["@id"].endswith("02-meetings/m.md"))["owner"]
    assert owner == {"@value": "[Gone](../05-people/gone.md)"}
    con = sqlite3.connect(out["sqlite"])
    assert con.execute("select count(*) from nodes").fetchone()[0] == graph.nodes.count()
    assert con.execute("select id from v_stale").fetchall() == [("07-knowledge/old.md",)]


def test_policy(spark, vault):
    e = Engine(spark, str(vault), Policy(max_writes_per_minute=3, audit_path=str(vault / ".vellum/audit.jsonl")), NOW)
    with pytest.raises(PolicyError):
        e.read_note("07-knowledge/secret")
    assert "07-knowledge/secret.md" not in [r.rel for r in e.list_files().collect()]
    assert e.search("launch words").count() >= 1 and all("secret" not in r.file for r in e.search("launch words").collect())
    assert e.sql("select * from nodes where title = 'Secret'").isEmpty()
    for bad in ("90-templates/x", "03-projects/../90-templates/y", "../out", "index"):
        with pytest.raises(PolicyError):
            e.create_note(bad, "text")
    with pytest.raises(PolicyError):
        e.append_note("07-knowledge/secret.md", "x")
    with pytest.raises(PolicyError):
        e.set_property("apollo", "sensitivity", "personal")
    assert e.create_note("03-projects/new", "hello") == "03-projects/new.md"
    e.append_note("new", "more")
    e.set_property("apollo", "people", "[Ann Bee, Will]")
    with pytest.raises(PolicyError):
        e.append_note("new", "too often")
    assert (vault / "03-projects/new.md").read_text() == "hello\nmore\n"
    lines = [json.loads(x) for x in (vault / ".vellum/audit.jsonl").read_text().splitlines()]
    assert {"attempt", "result"} == {x["phase"] for x in lines if x["tool"] == "create_note"}
    p = Engine(spark, str(vault), Policy(propose=True), NOW)
    pid = p.append_note("new", "later").split(":")[1]
    assert "later" not in (vault / "03-projects/new.md").read_text() and [x["id"] for x in p.proposals.pending()] == [pid]
    p.apply_proposal(pid)
    assert "later" in (vault / "03-projects/new.md").read_text() and p.proposals.pending() == []
    assert token_ok("Bearer abc", "abc") and not token_ok("Bearer abd", "abc") and not token_ok(None, "abc")
    assert name_fault("a/b: c") and name_fault("nul") and name_fault("x.") and not name_fault("03-projects/ok")


def test_edits_and_index(engine, vault):
    engine.set_property("Ann-bee", "role", "lead") if (vault / "05-people/Ann-bee.md").exists() else engine.set_property("ann-bee", "role", "lead")
    text = (vault / "05-people/ann-bee.md").read_text()
    assert "role: lead" in text and "aliases: [Annie]" in text
    rel = engine.daily_append("- hi", dt.date(2026, 9, 15))
    assert rel == "01-journal/daily/2026/09/2026-09-15.md" and "# Tuesday the 15" in (vault / rel).read_text()
    engine.append_log("did it")
    engine.append_log("late", "Note")
    log = (vault / "log.md").read_text()
    assert log.index("2026-09-15") < log.index("2026-09-01") and log.count("## 2026-09-15") == 1
    engine.write_index()
    index = (vault / "index.md").read_text()
    assert "* [Apollo](03-projects/apollo.md) - fine" in index and index.index("# 00-home") < index.index("# 03-projects")
    assert [r.rel for r in engine.backlinks("07-knowledge/old.md").collect()] == ["07-knowledge/spec.md", "index.md"] or "07-knowledge/spec.md" in [r.rel for r in engine.backlinks("07-knowledge/old.md").collect()]
    prompt = engine.prompt("What is Apollo about launch?")[1]["content"]
    assert "# Apollo" in prompt and "hidden" in prompt


def test_examples(engine, vault):
    (vault / "05-people/will-fox.md").write_text("---\ntype: person\ntitle: Will Fox (example)\nexample: true\n---\n")
    (vault / "03-projects/x.md").write_text("---\ntype: project\ntitle: X\npeople: [Will Fox, Ann Bee]\n---\nkeep\n- see [w](../05-people/will-fox.md)\n```\n[w](../05-people/will-fox.md)\n```\n")
    plan = engine.remove_examples()
    assert plan["notes"] == ["05-people/will-fox.md"] and ("03-projects/x.md", 6) in plan["lines"]
    text = (vault / "03-projects/x.md").read_text()
    assert "- see" not in text and text.count("will-fox") == 1 and "Will Fox" not in text and "Ann Bee" in text


def test_providers_and_cache(engine, vault):
    from vellum.functions import markdown as M
    from vellum.operators import providers

    assert "03-projects/apollo.md" in [r.file for r in engine.hits("launch notes").collect()]
    assert "03-projects/apollo.md" in [r.file for r in engine.hits("launch notes", provider="naive").collect()]
    with pytest.raises(ValueError):
        engine.hits("x", provider="none")
    assert providers.status(engine.providers(), "naive") == [("ranked", "ready"), ("naive", "chosen")]
    assert providers.choice("search", None, {"providers": {"search": "ranked"}}, {}) == "ranked" and providers.choice("search", None, {"providers": None}, {"VELLUM_SEARCH_PROVIDER": "naive"}) == "naive"
    assert providers.collection_name("/home/ann/Notes/vault", "/home/ann") == "notes-vault" and providers.collection_name("/home/ann/vault", "/home/ann") == "vault"
    assert providers.structured("x", lambda m: 'sure: {"actions": ["a"], "decisions": "no"}') == {"actions": ["a"], "decisions": [], "outcomes": []}
    assert providers.structured("x", lambda m: "none")["actions"] == []
    kept = str(vault / ".vellum/tables")
    n = engine.cached_sql("select count(*) as n from nodes", kept).first().n
    (vault / "05-people/more.md").write_text("---\ntype: person\ntitle: More\n---\n")
    assert engine.cached_sql("select count(*) as n from nodes", kept).first().n == n
    assert engine.cached_sql("select count(*) as n from nodes", kept, rebuild=True).first().n == n + 1
    assert "not valid UTF-8" in engine.completeness()
    assert M.recap_text("é".encode("utf-16")) == "é" and M.recap_text(b"\xef\xbb\xbfx") == "x" and M.alike("It is Ann Bee!", "ann-bee") and not M.alike("", "x")
    assert engine.ask("What is Apollo?", lambda m: m[1]["content"][:8]) == "# Apollo"


def test_store_parses_only_what_changed(spark, vault, tmp_path_factory):
    """After edits, renames and deletions the kept notes are those of a full read, and so is the graph."""
    import os

    from vellum.operators.graph import build
    from vellum.sources.store import NoteStore
    from vellum.sources.vault import Vault

    at = str(tmp_path_factory.mktemp("store"))
    whole, kept = Vault(spark, str(vault)), Vault(spark, str(vault), store=at)
    rows = lambda df: sorted(map(str, df.collect()))
    store = NoteStore(whole, at)
    assert {r.change for r in store.refresh().collect()} == {"added"} and store.parsed == whole.notes().count()
    assert rows(store.notes()) == rows(whole.notes()) and store.refresh() is None
    path = vault / "07-knowledge/old.md"
    stat = path.stat()
    path.write_text(path.read_text().replace("Old", "Odd"))
    os.utime(path, ns=(stat.st_atime_ns, stat.st_mtime_ns))  # an edit that keeps time and length
    (vault / "06-decisions/d3.md").rename(vault / "06-decisions/d4.md")
    (vault / "05-people/will-fox.md").unlink()
    (vault / "07-knowledge/copy.md").write_text((vault / "06-decisions/d1.md").read_text())
    diff = {r.rel: r.change for r in store.refresh().collect()}
    assert diff == {"07-knowledge/old.md": "changed", "06-decisions/d3.md": "removed", "06-decisions/d4.md": "added", "05-people/will-fox.md": "removed", "07-knowledge/copy.md": "added"}
    assert store.parsed == 1 and rows(kept.notes()) == rows(whole.notes())
    a, b = build(kept, NOW), build(whole, NOW)
    assert rows(a.edges) == rows(b.edges) and rows(a.nodes) == rows(b.nodes) and rows(a.findings) == rows(b.findings)


def test_on_change_sees_edits(spark, tmp_path):
    from vellum.sources.store import on_change

    root, seen = tmp_path / "v", []
    root.mkdir()
    look = lambda: on_change(spark, str(root), lambda df: seen.append(sorted(tuple(r) for r in df.collect())), str(tmp_path / "c"))
    (root / "a.md").write_text("one")
    assert look() and not look()
    (root / "a.md").write_text("two")
    assert look()
    (root / "b.md").write_text("three")
    (root / "a.md").unlink()

    def broken(df):
        raise OSError("no")

    with pytest.raises(OSError):
        on_change(spark, str(root), broken, str(tmp_path / "c"))
    assert look()  # what was not taken over comes again
    assert seen == [[("a.md", "added")], [("a.md", "changed")], [("a.md", "removed"), ("b.md", "added")]]


def test_data_sources(spark, vault, tmp_path_factory):
    from vellum.sources import formats

    formats.register(spark)
    rows = lambda df: sorted(map(str, df.collect()))
    whole, read = Vault(spark, str(vault)).notes(), spark.read.format("vault").load(str(vault))
    assert rows(read) == rows(whole)
    assert rows(read.filter("rel like '06-decisions/%'")) == rows(whole.filter("rel like '06-decisions/%'"))
    assert [r.rel for r in read.filter("rel = 'Inbox.md'").collect()] == ["Inbox.md"] and read.filter("not valid").count() == 1
    g, path = build(Vault(spark, str(vault)), NOW), tmp_path_factory.mktemp("g") / "graph.sqlite"
    exports.write_sqlite(g, path)
    kept, fresh = formats.graph_file(spark, str(path)), g.tables()
    assert set(kept) == set(fresh)
    for name in ("nodes", "edges", "v_stale", "findings"):
        assert rows(kept[name]) == rows(fresh[name].select(kept[name].columns)), name
    assert sqlgate.query(spark, "select count(*) as n from edges", kept).first()["n"] == g.edges.count()
    formats.PARTITION_ROWS, was = 7, formats.PARTITION_ROWS
    assert kept["edges"].count() == g.edges.count()
    formats.PARTITION_ROWS = was


def test_exports_in_parts_are_the_files(spark, vault, tmp_path):
    g = build(Vault(spark, str(vault)), NOW)
    joined = lambda manifest: b"".join((tmp_path / manifest.split("/")[-2] / f).read_bytes() for f in json.loads(open(manifest).read()))
    for name, single, parts in (("json", exports.write_json, exports.json_parts), ("nt", lambda g, p: exports.write_ntriples(g, {}, p), lambda g, p: exports.ntriples_parts(g, {}, p)), ("ld", lambda g, p: exports.write_jsonld(g, {}, p), lambda g, p: exports.jsonld_parts(g, {}, p))):
        want = single(g, tmp_path / f"one.{name}").read_bytes()
        got = joined(parts(g, str(tmp_path / f"parts-{name}")))
        assert got == want and len(want) > 100
    json.loads((tmp_path / "one.json").read_text())


def test_command_line_ends(spark, vault, capsys, monkeypatch):
    import http.server
    import io
    import threading

    from vellum.__main__ import main
    from vellum.operators import providers

    asked = []

    class Model(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            text = '{"actions": ["call the printer"], "decisions": [], "outcomes": []}'
            out = json.dumps({"choices": [{"message": {"content": text}, "finish_reason": "stop"}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(out)

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Model)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/v1"
    run = lambda *a: main(["--vault", str(vault), *a])
    try:
        assert run("neighbors", "no such note") == 1 and "no such note" in capsys.readouterr().err
        assert run("ask", "zzzz qqqq") == 1
        assert run("ask", "launch notes", "--base-url", "http://127.0.0.1:9/v1") == 2
        assert run("ask", "launch notes", "--base-url", url) == 0 and "call the printer" in capsys.readouterr().out
        assert asked[-1]["max_tokens"] == providers.ANSWER + providers.HEADROOM
        monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO(b"Decision: go on")))
        assert run("minutes", "-", "--dry-run", "--llm", "--base-url", url) == 0 and "call the printer" in capsys.readouterr().out
    finally:
        server.shutdown()
    assert providers.whole_number("X", 5, {"X": "-1"}) == 5 and providers.whole_number("X", 5, {"X": "0"}) == 0
    assert ("graph", "builtin", "active") in providers.slots([], "none", "http://127.0.0.1:9/v1")


def test_lines_that_were_met_are_not_read_as_yaml_again(monkeypatch):
    """Notes that differ in plain text alone need no YAML reader, where each note needed one of its own."""
    from vellum.operators.ontology import default
    from vellum.sources import vault as V

    asked, load, onto = [], V.loaded, default()
    monkeypatch.setattr(V, "loaded", lambda raw: asked.append(raw) or load(raw))
    V._seen.clear()
    for i in range(50):
        got = V.parsed(f"---\ntype: project\ntitle: Order {i}\ngenerated: {{ by: human:ann, at: 2026-01-01T00:00:00Z }}\narea: '[n](../n{i % 2}.md)'\n---\nbody".encode(), onto)
        assert got["fm"] == f'{{"type": "project", "title": "Order {i}", "generated": {{"by": "human:ann", "at": "2026-01-01T00:00:00+00:00"}}, "area": "[n](../n{i % 2}.md)"}}'
        assert got["events"] == [{"field": "generated", "ok": True, "by": "human:ann", "at": "2026-01-01T00:00:00+00:00", "at_tag": "datetime"}] and got["body"] == "body"
    assert len(asked) == 3


def test_notes_by_lines_equal_whole_notes(monkeypatch):
    """Lines that mean something else in their note than alone, or that no line may be read for, leave the note to the YAML reader."""
    import random

    from vellum.operators.ontology import default
    from vellum.sources import vault as V

    keys = ["type", "title", "generated", "verified", "sources", "summary", "yes", "1", "my key", "_x", "tags", "null", "x.y", "<<", "?", "type"]
    values = ["", "a", "yes", "Null", "~", "12", "0x1f", "2026-01-01", "2026-13-45", "[a, b]", "[a", "a]", "{ by: human:x }", "'q'", "'q", "q'", "d'", '"d', 'd"', "x # c", "x#y", "a: b", "a:", "- x", "[{resource: r, id: i}]", "meeting note", "é", "a  b ", "=", ".inf", "1:20", "a\\b", "&a x", "*a", "| x", ">"]
    extra = ["# c", " x", "- a", "...", "---", "\tq", "  ", "", "\r"]
    rng, onto, notes = random.Random(3), default(), []
    for _ in range(1500):
        lines = [rng.choice(keys) + rng.choice([":", ": ", ":  "]) + rng.choice(values) for _ in range(rng.randint(0, 5))]
        lines[rng.randint(0, len(lines)) : 0] = [rng.choice(extra)] * (rng.random() < 0.15)
        notes.append(("---\n" + "\n".join(lines) + "\n---" + rng.choice(["", "\n", "\r\n", "\n\nx", "x"])).encode())
    V._seen.clear()
    got = [V.parsed(n, onto) for n in notes * 2]  # the second time from what was met
    monkeypatch.setattr(V, "_by_lines", lambda raw: None)
    want = [V.parsed(n, onto) for n in notes]
    assert sum(w["has_fm"] for w in want) > 200
    for g, w in zip(got, want * 2, strict=True):
        assert g == w
