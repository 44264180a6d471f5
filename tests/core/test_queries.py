"""Every registered query beside its SQL in DuckDB, and the functions that have none."""

import datetime as dt
import difflib
import random
import re

import duckdb
import pytest

from vellum.functions import markdown as M
from vellum.operators import edges, policy, resolve
from vellum.operators.ontology import default
from vellum.plans.registry import ORACLE_SQL, QUERIES, flagship

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(rows):
    def one(x):
        if isinstance(x, float):
            return "NULL" if x != x else f"{x:.6g}"
        if isinstance(x, (list, tuple)):
            return str([one(v) for v in x])
        return "NULL" if x is None else str(x)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = duck.execute(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({ORACLE_SQL[name]})").fetchall()
    assert normal(tuple(r) for r in got.select(*[f"`{c}`" for c in cols]).collect()) == normal(want)


def test_flagship(spark):
    assert flagship(spark, SF).count() > 0


def test_suggestions(spark):
    rng = random.Random(1)
    pool = ["".join(rng.choice("abcde ") for _ in range(rng.randint(2, 16))).strip() or "a" for _ in range(80)]
    pool = sorted({" ".join(p.split()) for p in pool if p.strip()})
    values = [p[1:] + "x" for p in pool[:25]] + ["zzz", "quite another name"]
    frame = spark.createDataFrame([(p, p) for p in pool], "key string, id string")
    got = {r.value: list(r.suggested) for r in resolve.suggestions(spark.createDataFrame([(v,) for v in values], "value string"), frame).collect()}
    for v in values:
        key = " ".join(v.lower().split())
        want = difflib.get_close_matches(key, pool, 3, 0.6)
        ratio = lambda a: round(difflib.SequenceMatcher(None, a, key).ratio(), 9)  # noqa: B023, E731
        assert [ratio(x) for x in got.get(v, [])] == [ratio(x) for x in want]


def test_suggestions_in_tiles(spark):
    """Small tiles, long and short names, ranges, names of several notes: the same answers, and few ratios."""
    rng = random.Random(12)
    pool = [("".join(rng.choice("abcdefgh ") for _ in range(rng.choice([3, 9, 14, 40]))).strip() or "a", f"i{j % 150}", "person" if j % 3 else "team") for j in range(260)]
    pool = sorted({(" ".join(k.split()), i, t) for k, i, t in pool if k.strip()})
    values = [(k[:4] + "x" + k[5:], r) for k, _, _ in pool[::9] for r in ([], ["person"], None)] + [("zzzzzz", []), ("q" * 70_000, ["team"])]
    left, right = spark.createDataFrame(values, "value string, ranges array<string>"), spark.createDataFrame(pool, "key string, id string, type string")
    out = resolve.suggestions(left, right, lineage={"person": ["person", "agent"], "team": ["team"]}, tile=32, report=True).collect()
    assert len(out) == len({(v, str(r)) for v, r in values if len(v) < 1000})  # nothing is as long as the last
    for r in out:
        v = " ".join(r.value.lower().split())
        best = {}
        for k, i, t in pool:
            x = difflib.SequenceMatcher(None, k, v).ratio()
            if x >= 0.6 and (not r.ranges or t in r.ranges):
                best[i] = max(best.get(i, (0, "")), (x, k))
        want = [i for *_, i in sorted(((x, k, i) for i, (x, k) in best.items()), reverse=True)[:3]]
        assert list(r.suggested or []) == want, r.value
    assert sum(r.tried for r in out) < len(out) * len(pool) / 3


def test_rate_limit():
    assert policy.allowed_by_rate([0, 1, 2, 61, 62, 63], 2) == [True, True, False, True, True, False]


def test_closure_and_paths(spark):
    rng = random.Random(4)
    pairs = {(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(45)} | {(f"m{i}", f"m{i + 1}") for i in range(20)}
    df = spark.createDataFrame([(a, "p", b, "body") for a, b in sorted(pairs)], "src string, pred string, dst string, origin string")
    reach = dict.fromkeys((), ())
    for a in {x for p in pairs for x in p}:
        seen, todo = set(), [b for x, b in pairs if x == a]
        while todo:
            b = todo.pop()
            if b not in seen:
                seen.add(b)
                todo += [y for x, y in pairs if x == b]
        reach[a] = seen
    got = {(r.src, r.dst) for r in edges.closure(df, "p").collect()}
    assert got == {(a, b) for a, s in reach.items() for b in s if a != b and (a, b) not in pairs}
    assert len(edges.shortest_path(df, "m0", "m20")) == 20 and edges.shortest_path(df, "m5", "m0") == []


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("- [ ] do it — me, due 2026-01-02", (False, "do it", "me", "2026-01-02")), ("* [X] done -- Ann Bee", (True, "done", "Ann Bee", "")), ("- [ ] a 📅 2026-01-02", (False, "a", "", "2026-01-02")),
        ("  - [x] b ✅ 2026-03-01 — me ⏫", (True, "b", "me", "")), ("- [ ] c 🔁 every week 📅 2026-01-02", (False, "c", "", "2026-01-02")), ("- [ ] long — this is not an owner at all", (False, "long — this is not an owner at all", "", "")),
        ("- [ ] v — version 2", (False, "v — version 2", "", "")), ("- [ ] x – Bob, due 2026-05-05 📅 2026-01-01", (False, "x", "Bob", "2026-05-05")), ("- [ ] id 🆔 abc ⛔ d1,d2 🏁 delete", (False, "id", "", "")),
        ("text", None), ("- [] no", None), ("- [ ] e due: 2026-02-02", (False, "e", "", "2026-02-02")),
    ],
)
def test_task_lines(line, want):
    assert M.task(line) == want


def test_small_functions():
    assert M.coerced("[a, 'b']") == ["a", "b"] and M.coerced("-7") == -7 and M.coerced("True") is True and M.coerced("x") == "x"
    assert M.moment("[Week] WW, YYYY", {"WW": "05", "YYYY": "2026"}) == "Week 05, 2026"
    assert M.daily_folder({"folder": "01-journal", "format": "[daily]/YYYY/MM/YYYY-MM-DD"}) == "01-journal/daily"
    assert M.month_path({"folder": "j"}, dt.date(2026, 3, 1)) == "j/monthly/2026-03.md"
    assert M.with_properties("---\na: 1 # keep\nb: |\n  x\n---\nbody", {"a": 2}) == "---\na: 2\nb: |\n  x\n---\nbody"
    assert M.with_properties("body", {"a": 1}) == "---\na: 1\n---\nbody" and M.with_properties("---\n---\nx", {"a": 1}) == "---\na: 1\n---\nx"
    assert M.with_properties("---\na:\n  - 1\n---\nx", {"a": [2]}).startswith("---\na:\n- 2")
    assert M.scrubbed("see https://me:pw@host.example:8443/v1?k=1 and /home/ann/x/model.bin, http://localhost:1/v1", ("ann",)) == "see https://<host>:8443/<path> and model.bin, http://localhost:1/v1"
    assert M.scrubbed("Ann-Lee MacBook", ("ann lee",)) == "<user> MacBook"
    log = M.with_log_entry("# L\n\n## 2026-02-01\n* x\n", "m", "Note", dt.date(2026, 1, 1))
    assert log == "# L\n\n## 2026-02-01\n* x\n\n## 2026-01-01\n* **Note**: m\n"
    o = default()
    assert o.lineage()["spec"] == ["spec", "knowledge", "node"] and o.specs("weekly")["date"].required and o.canonical({"due_date": "x", "due": "y"})[0] == {"due": "y"}


def test_stream(spark, tmp_path):
    from vellum.streaming.limits import audit_counts, audit_stream, rate_limited_stream

    rows = [(k, dt.datetime(2026, 1, 1, 0, 0, s), s) for k in ("a", "b") for s in (0, 1, 2, 40)]
    spark.createDataFrame(rows, "k string, ts timestamp, n int").coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("k string, ts timestamp, n int").parquet(str(tmp_path / "in"))
    q = rate_limited_stream(src, "k", "ts", "n", 2, 30).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.k, r.n, r.ok) for r in spark.table("limited").collect()) == [(k, n, n != 2) for k in ("a", "b") for n in (0, 1, 2, 40)]
    (tmp_path / "log").mkdir()
    (tmp_path / "log/a.json").write_text("\n".join('{"ts": "2026-01-01T00:00:0%dZ", "tool": "t", "phase": "result", "ok": %s, "detail": ""}' % (i, str(i > 0).lower()) for i in range(3)))
    q = audit_counts(audit_stream(spark, str(tmp_path / "log"))).writeStream.format("memory").queryName("audits").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.tool, r.calls, r.refused) for r in spark.table("audits").collect()] == [("t", 3, 1)]


def test_percent_round_trip_takes_whole_texts(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from vellum.functions import text as T

    texts = [None, "", "a+b %41 é" * 30, "x" * 100 + "Z%+é€", "x" * 100 + "y"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    back = lambda: {r.doc_id: r.back for r in QUERIES["percent_round_trip"](spark, str(tmp_path)).collect()}
    assert back() == dict(enumerate(texts))
    right = T.unquoted
    monkeypatch.setattr(T, "unquoted", lambda c: F.replace(right(c), F.lit("Z"), F.lit("?")))
    assert [i for i, t in back().items() if t != texts[i]] == [3]


def test_long_paths_and_closures(spark):
    """No number of steps is out of reach; closures of chains, branches and cycles are whole."""
    chain = spark.createDataFrame([(f"n{i:03}", "next", f"n{i + 1:03}", "x") for i in range(18)], "src string, pred string, dst string, origin string")
    got = edges.shortest_path(chain, "n000", "n018", ())
    assert got == [(f"n{i:03}", "next", f"n{i + 1:03}") for i in range(18)]
    rng = random.Random(3)
    pairs = {(rng.randrange(14), rng.randrange(14)) for _ in range(18)}
    far = {(a, b) for a, b in pairs}
    while True:
        more = far | {(a, d) for a, b in far for c, d in pairs if b == c}
        if more == far:
            break
        far = more
    rows = [(f"{a}", "p", f"{b}", "x") for a, b in pairs]
    out = edges.closure(spark.createDataFrame(rows, "src string, pred string, dst string, origin string"), "p")
    assert {(int(r.src), int(r.dst)) for r in out.collect()} == {(a, b) for a, b in far - pairs if a != b}


def test_default_policy_keeps_people_and_context(spark):
    asked = [("05-people/ann.md", "denied: 05-people"), ("context.jsonld", "denied: context.jsonld"), ("03-projects/context.jsonld", "denied: context.jsonld"), (".git/config", "denied: .git"), ("03-projects/a.md", None)]
    df = spark.createDataFrame([(t, "x", "p", "", False) for t, _ in asked], "target string, payload string, prop string, template string, overwrite boolean")
    got = policy.write_verdicts(df, policy.Policy(), spark.createDataFrame([], "rel string"))
    assert {r.target: r.verdict for r in got.collect()} == dict(asked)


def test_paths_and_reach_from_both_ends(spark):
    """Against one-sided search: lengths, the rule for equally short paths, and which pairs are reached."""
    rng = random.Random(9)
    rows = sorted({(f"n{rng.randrange(25)}", rng.choice("pq"), f"n{rng.randrange(25)}") for _ in range(55)} | {("hub", "p", f"n{i}") for i in range(25)})
    df = spark.createDataFrame([(*r, "x") for r in rows], "src string, pred string, dst string, origin string").cache()
    nodes = sorted({x for a, _, b in rows for x in (a, b)})

    def plain(a, b):
        depth, front = {a: 0}, [a]
        while front:
            front = sorted({y for x, _, y in rows if x in front and y not in depth})
            depth |= dict.fromkeys(front, max(depth.values()) + 1)
        out = []
        while b in depth and b != a:
            x, p = min((x, p) for x, p, y in rows if y == b and depth.get(x) == depth[b] - 1)
            out.append((x, p, b))
            b = x
        return out[::-1]

    for a, b in [("n1", "n7"), ("hub", "n3"), ("n4", "hub"), ("n0", "n24"), ("n13", "n2")]:
        want = plain(a, b)
        assert edges.shortest_path(df, a, b, ()) == want
        assert edges.shortest_path(df, a, b, (), most=len(want)) == want and (not want or edges.shortest_path(df, a, b, (), most=len(want) - 1) == [])
    far = {(a, b) for a, _, b in rows}
    while more := {(a, d) for a, b in far for c, d in far if b == c} - far:
        far |= more
    pairs = [(a, b) for a in nodes for b in nodes[::3]] + [("nowhere", "n1"), ("n1", None)]
    got = {tuple(r) for r in edges.reaches(df, spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == {p for p in pairs if p in far}
    assert edges.reaches(df, spark.createDataFrame(pairs, "a string, b string"), ["none such"]).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_reach_after_random_changes(spark, seed):
    rng = random.Random(seed)
    some = lambda n: {(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(n)}

    def reach(pairs):
        far = set(pairs)
        while more := {(a, d) for a, b in far for c, d in far if b == c} - far:
            far |= more
        return {(a, b) for a, b in far if a != b}

    old = some(22) | {("n1", "n2"), ("n2", "n1")}
    removed, added = set(rng.sample(sorted(old), 6)) | {("n2", "n1")}, some(5) | {("n90", "n91"), ("n91", "n1")}
    new = (old - removed) | added
    frame = lambda x: spark.createDataFrame(sorted(x), "src string, dst string")
    got = edges.reach_after(frame(reach(old)), frame(new), frame(added), frame(removed - added))
    assert sorted(tuple(r) for r in got.collect()) == sorted(reach(new))


def test_recursion_over_cycles_ends(spark):
    from vellum.operators import sqlgate

    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (7, 8), (None, 2)], "src int, dst int")
    ask = lambda q: sorted(tuple(r) for r in sqlgate.query(spark, q, {"edges": e}, 1 << 20).collect())
    assert ask("with recursive r(n) as (select 1 union select dst from r join edges on n = src), z as (select 5 as q) select n, q from r, z") == [(1, 5), (2, 5), (3, 5)]
    assert ask("with recursive r as (select src as a, dst as b from edges where src = 7 union select 3, 4 union select r.a, edges.dst from r join edges on r.b = edges.src or r.b = 4 and edges.dst = 8) select * from r") == [(3, 4), (3, 8), (7, 8)]
    assert ask("with recursive r(n, d) as (select 1, 0 union all select dst, d + 1 from r join edges on n = src where d < 4) select max(d) as d from r") == [(4,)]
    with pytest.raises(sqlgate.Refused):
        ask("with recursive r(n) as (select java_method('java.lang.System', 'exit') union select n from r) select * from r")


def test_policy_from_arguments():
    p = policy.Policy.from_args(["--read-only", "--deny-write", "a,b", "--max-write-bytes", "7", "--no-hide-confidential"])
    assert (p.read_only, p.deny_write, p.max_write_bytes, p.hide_confidential, p.propose) == (True, ("a", "b"), 7, False, False)
    assert '"max_write_bytes": 7' in p.describe()


def test_whole_tables(spark, duck):
    """mentions and index_build over every order, beside plain versions."""
    parts = dict(duck.execute("select p_partkey, p_name from part").fetchall())
    least = {}
    for k in sorted(parts):
        least.setdefault(parts[k].lower(), f"p:{k}")
    orders, n = duck.execute("select o_orderkey, o_custkey from orders").fetchall(), max(parts)
    want = set()
    for o, c in orders:
        a, b = parts.get(1 + o % n), parts.get(1 + c % n)
        if a and b:
            text = f"we need a {a.upper()}, and {b}s".lower()
            want |= {(o, node, len(name)) for name, node in least.items() if len(name) >= 4 and re.search(rf"(?<![\w-]){re.escape(name)}(?![\w-])", text)}
    assert len({o for o, _, _ in want}) > 0.9 * len(orders)
    assert {tuple(r) for r in QUERIES["mentions"](spark, SF).select("id", "node", "size").collect()} == want
    assert QUERIES["index_build"](spark, SF).count() == len(orders)


def test_names_by_automata(spark):
    """Against one regex for each name, whatever a shard holds."""
    from vellum.operators.names import named

    rng = random.Random(8)
    names = sorted({"".join(rng.choice("ab -") for _ in range(rng.randint(1, 4))) for _ in range(60)} | {"é", "a²", "straße"})
    nodes = [(f"n{i % 20}", x) for i, x in enumerate(names)] + [("n0", names[3]), (None, "ab"), ("n1", ""), ("n2", None)]
    texts = [(i, "".join(rng.choice("aab -,.é²") for _ in range(rng.randint(0, 12)))) for i in range(150)] + [(1000, None), (1001, "straße² straße"), (1002, "ab " * 3000)]
    want = {}
    for i, t in texts:
        for node, x in nodes:
            # no superscript digit is a word character here, unlike in Python's patterns
            if node and x and re.search(rf"(?<![\w-]){re.escape(x)}(?![\w-])".replace(r"\w", r"a-zß-öø-ÿ0-9_"), t or ""):
                want[i, node] = max(want.get((i, node), 0), len(x))
    left, right = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(nodes, "node string, called string")
    for size in (1 << 20, 400):
        assert {(r.id, r.node): r.size for r in named(left, right, size).collect()} == want
    assert named(left, right.limit(0)).count() == 0 and named(left.limit(0), right).count() == 0


def test_whole_graph(spark, duck):
    """relation_labels over every source of an edge, reference_findings over every line."""
    sources = {r.src for r in QUERIES["relation_labels"](spark, SF).select("src").collect()}
    assert {s[0] for s in sources} == set("ncso")
    assert len([s for s in sources if s[0] == "o"]) == duck.execute("select count(*) from orders").fetchone()[0]
    unresolved = QUERIES["reference_findings"](spark, SF).filter("code = 'unresolved_ref'").count()
    assert unresolved == duck.execute("select count(*) from lineitem where l_linenumber % 3 = 2").fetchone()[0]


def test_suggestions_without_common_trigram(spark):
    key, value = "abycdyefyghyijy"[:15], "abxcdxefxghxijx"[:15]
    assert difflib.get_close_matches(value, [key]) == [key]
    pool = spark.createDataFrame([(key, "y"), ("zzzzzzzzzzzzzzz", "z")], "key string, id string")
    assert [list(r.suggested) for r in resolve.suggestions(spark.createDataFrame([(value,)], "value string"), pool).collect()] == [["y"]]
