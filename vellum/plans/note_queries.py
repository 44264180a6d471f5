"""Queries over notes: views, tasks, minutes, reconciliation, policy, format checks, index."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import markdown as M
from ..functions import text as T
from ..operators import edits, policy, reconcile, tasks, validate, views
from .frames import NOTES_SQL, TODAY, notes, table
from .view_specs import VIEWS

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return add



# ---- views -------------------------------------------------------------------------------


def _view(name: str, spec: dict, view: str, where: str, order: str, limit: int) -> None:
    sql = f"select rel as file_path, type, date from (select *, regexp_extract(rel, '([^/]+)\\.md$', 1) as name from {NOTES_SQL}) where {where} order by {order}, rel limit {limit}"
    query(name, sql)(lambda spark, d: views.compiled(notes(spark, d), spec, view, TODAY))


for _name, _args in VIEWS.items():
    _view(_name, *_args)


# ---- tasks -------------------------------------------------------------------------------

_LINE = """('- [' || case when key % 3 = 0 then 'x' else ' ' end || '] call customer ' || (custkey % 40) || ' about order ' || (key % 5)
  || case when key % 4 = 0 then '' else ' — ' || ['me', 'Ann Bee', 'you'][(key % 3) + 1] || case when key % 4 = 1 then ', due ' || due else '' end end)"""
_TASKS_SQL = f"""(
  select rel as file, 3::int as line, key % 3 = 0 as done, 'call customer ' || (custkey % 40) || ' about order ' || (key % 5) as text,
    case when key % 4 = 0 then '' else ['me', 'Ann Bee', 'you'][(key % 3) + 1] end as owner, case when key % 4 = 1 then due else '' end as due, type as note_type,
    'call customer ' || (custkey % 40) || ' about order ' || (key % 5) as key
  from {NOTES_SQL} where rel not like '90-templates/%' and rel not like '09-archive/%')"""


def _with_tasks(spark, d):
    """Orders as notes whose body has a task, and one inside a fence."""
    n = notes(spark, d)
    k = F.col("key")
    owner = F.element_at(F.array(F.lit("me"), F.lit("Ann Bee"), F.lit("you")), (k % 3 + 1).cast("int"))
    what = F.concat(F.lit("call customer "), (F.col("custkey") % 40).cast("string"), F.lit(" about order "), (k % 5).cast("string"))
    tail = F.when(k % 4 == 0, "").otherwise(F.concat(F.lit(" — "), owner, F.when(k % 4 == 1, F.concat(F.lit(", due "), "due")).otherwise("")))
    line = F.concat(F.when(k % 3 == 0, "- [x] ").otherwise("- [ ] "), what, tail)
    return n.select("rel", "type", F.lit(0).alias("offset"), F.concat(F.lit("# head\n\n"), line, F.lit("\n```\n- [ ] not this one\n```\n- [ ] verb — owner, due\ntext")).alias("body"))


def _tasks(spark, d):
    return tasks.scan(_with_tasks(spark, d))


query("task_scan", f"select * from {_TASKS_SQL}")(_tasks)

_DAY = f"date '{TODAY.isoformat()}'"
_FLAGS = f"(select *, coalesce(not done and try_cast(nullif(due, '') as date) < {_DAY}, false) as overdue, coalesce(not done and try_cast(nullif(due, '') as date) between {_DAY} and {_DAY} + 7, false) as due_soon, not done and owner = '' and note_type is distinct from 'daily' as no_owner from {_TASKS_SQL})"


@query("todo_overdue", f"select file, line, text, owner, due from {_FLAGS} where overdue")
def _(spark, d):
    return tasks.flags(_tasks(spark, d), TODAY).filter("overdue").select("file", "line", "text", "owner", "due")


@query("todo_due_soon", f"select file, line, text, owner, due from {_FLAGS} where due_soon")
def _(spark, d):
    return tasks.flags(_tasks(spark, d), TODAY).filter("due_soon").select("file", "line", "text", "owner", "due")


@query("todo_counts", f"select count(*) filter (not done) as open, count(*) filter (overdue) as overdue, count(*) filter (due_soon) as due_soon, count(*) filter (no_owner) as no_owner from {_FLAGS}")
def _(spark, d):
    return tasks.counts(tasks.flags(_tasks(spark, d), TODAY))


@query("todo_by_owner", f"select case owner when '' then '(no owner)' else owner end as owner, count(*) as open, count(*) filter (overdue) as overdue from {_FLAGS} where not done group by 1")
def _(spark, d):
    return tasks.by_owner(tasks.flags(_tasks(spark, d), TODAY))


@query("dup_groups", f"select key, count(distinct file) as files, count(*) as n, bool_or(done) and bool_or(not done) as conflict from {_TASKS_SQL} where length(key) >= 12 group by key having count(distinct file) > 1")
def _(spark, d):
    return tasks.copies(_tasks(spark, d))


@query("done_conflicts", f"""
with t as {_TASKS_SQL}, c as (select key from t where length(key) >= 12 group by key having count(distinct file) > 1 and bool_or(done) and bool_or(not done))
select distinct o.file, o.line, o.done, o.text, o.owner, o.due, o.note_type, o.key from t o join c using (key)
join (select distinct key, owner, due, note_type = 'daily' as daily from t where done) x on x.key = o.key and lower(x.owner) = lower(o.owner) and x.due = o.due and not (x.daily and o.note_type = 'daily')
where not o.done""")  # fmt: skip
def _(spark, d):
    return tasks.closable(_tasks(spark, d))


@query("digest_lines", f"""
select file, '- [' || case when done then 'x' else ' ' end || '] ' || text || case when owner || due = '' then '' else ' — ' || concat_ws(' — ', nullif(owner, ''), 'due ' || nullif(due, '')) end
  || ' · [' || regexp_extract(file, '([^/]+)\\.md$', 1) || '](' || case when file like '00-home/%' then substr(file, 9) else '../' || file end || ')' as line from {_TASKS_SQL}""")  # fmt: skip
def _(spark, d):
    return _tasks(spark, d).select("file", tasks.task_line("00-home/todo-digest.md").alias("line"))


@query("fence_state", """
with l as (select conv_id, turn, role, text, sum(case when role = 'system' or turn % 3 = 2 then 1 else 0 end) over (partition by conv_id order by turn) as n from conversations)
select conv_id, turn from l where n % 2 = 0 and not (role = 'system' or turn % 3 = 2)""")  # fmt: skip
def _(spark, d):
    fence = (F.col("role") == "system") | (F.col("turn") % 3 == 2)
    lines = table(spark, d, "conversations").withColumn("line", F.when(fence, "```").otherwise(F.col("text")))
    return tasks.outside_fences(lines, "conv_id", "turn").select("conv_id", "turn")


_SAYS = "['Decision: ', 'TODO: ', '- [ ] ', 'result - ', '* agreed: ', ''][(turn % 6) + 1] || 'item ' || conv_id || case when turn % 2 = 1 then ' — Ann' else '' end"


@query("minutes_extract", f"""
select conv_id, turn, case turn % 6 when 0 then 'decision' when 1 then 'action' when 2 then 'action' when 3 then 'outcome' when 4 then 'decision' end as kind,
  case turn % 6 when 1 then '- [ ] item ' || conv_id || ' — Ann' when 2 then '- [ ] item ' || conv_id when 3 then 'item ' || conv_id || ' — Ann' else 'item ' || conv_id end as item
from conversations where turn % 6 <> 5""")  # fmt: skip
def _(spark, d):
    heads = F.array(*[F.lit(x) for x in ("Decision: ", "TODO: ", "- [ ] ", "result - ", "* agreed: ", "")])
    line = F.concat(F.element_at(heads, (F.col("turn") % 6 + 1).cast("int")), F.lit("item "), F.col("conv_id").cast("string"), F.when(F.col("turn") % 2 == 1, " — Ann").otherwise(""))
    return tasks.minutes(table(spark, d, "conversations").select("conv_id", "turn", line.alias("line"))).select("conv_id", "turn", "kind", "item")


def _task_query(name: str, kept: list[str], dropped: list[str]) -> None:
    text = 'task-todo:""' + (" (" + " OR ".join(f'path:"{p}"' for p in kept) + ")" if kept else "") + "".join(f' -path:"{p}"' for p in dropped)
    where = ("(" + " or ".join(f"contains(file, '{p}')" for p in kept) + ")" if kept else "true") + "".join(f" and not contains(file, '{p}')" for p in dropped)
    query(name, f"select file, line, text from {_TASKS_SQL} where not done and {where}")(lambda spark, d: views.open_tasks(_tasks(spark, d), text).select("file", "line", "text"))


_task_query("task_query_projects", ["03-projects", "06-decisions"], [])
_task_query("task_query_meetings", ["02-meetings"], [])
_task_query("task_query_people", ["05-people"], [])
_task_query("task_query_journal", ["01-journal"], [])
_task_query("task_query_rest", [], ["01-journal", "02-meetings", "03-projects", "05-people", "06-decisions", "90-templates", "99-system", "09-archive"])


# ---- reconciliation ----------------------------------------------------------------------

_OWED = "(select o_orderkey, sum(l_quantity) as q from orders join lineitem on l_orderkey = o_orderkey group by o_orderkey)"


@query("hub_drift", f"""
select 'o:' || o_orderkey as node, concat_ws('; ', case when k % 5 = 0 then 'state: hub ''' || 'X' || ''' vs note ''' || s || '''' end, case when h <> n then 'quantity: hub ''' || h || ''' vs note ''' || n || '''' end) as drift
from (select o.o_orderkey, o.o_orderkey as k, o_orderstatus as s, (trunc(q)::bigint + case when o.o_orderkey % 7 = 0 then 1 else 0 end)::varchar as h, (trunc(q)::bigint)::varchar as n from orders o join {_OWED} w using (o_orderkey))
where k % 5 = 0 or h <> n""")  # fmt: skip
def _(spark, d):
    k = F.col("o_orderkey")
    q = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").cast("long").alias("q"))
    o = table(spark, d, "orders").join(q, "o_orderkey").withColumn("node", F.concat(F.lit("o:"), k.cast("string")))
    hub = o.select("node", F.array(F.when(k % 5 == 0, "X").otherwise(F.col("o_orderstatus")), (F.col("q") + F.when(k % 7 == 0, 1).otherwise(0)).cast("string")).alias("c"))
    own = o.select(F.col("node").alias("id"), F.array("o_orderstatus", F.col("q").cast("string")).alias("v"))
    told = F.array_join(F.transform("differing", lambda x: F.concat(x["column"], F.lit(": hub '"), x["hub"], F.lit("' vs note '"), x["note"], F.lit("'"))), "; ")
    return reconcile.drift(hub, own, ("state", "quantity")).select("node", told.alias("drift"))


@query("hub_missing", f"select rel as id from {NOTES_SQL} where type = 'project' and case status when 'deprecated' then 'done' else state end not in ('done', 'decided', 'superseded', 'archived', 'cancelled') and key % 3 = 1")
def _(spark, d):
    n = notes(spark, d).filter("type = 'project'")
    own = n.select(F.col("rel").alias("id"), F.when(F.col("status") == "deprecated", "done").otherwise(F.col("state")).alias("state"))
    return reconcile.missing(own, n.filter("key % 3 <> 1").select(F.col("rel").alias("node")), False)


@query("priorities_missing", f"select rel as id from {NOTES_SQL} where type = 'decision' and state = 'open' and not contains('- o1.md o15.md Order 18 Order 32', regexp_extract(rel, '[^/]+$')) and not contains('- o1.md o15.md Order 18 Order 32', title)")
def _(spark, d):
    n = notes(spark, d).filter("type = 'decision'").select(F.col("rel").alias("id"), "title", "state")
    return reconcile.unlisted(n, "- o1.md o15.md Order 18 Order 32")


@query("dead_names_pruned", """
with s as (select lower(p_name) as name from part where p_partkey < 6), g as (select l_orderkey, l_linenumber, p_name from lineitem join part on p_partkey = l_partkey)
select 'o:' || l_orderkey as node, 'items' as key, coalesce(list(p_name || ' (example)' order by l_linenumber, p_name) filter (lower(p_name) not in (select name from s)), []) as kept
from g group by l_orderkey having count(*) filter (lower(p_name) in (select name from s)) > 0""")  # fmt: skip
def _(spark, d):
    p = table(spark, d, "part")
    samples = p.filter("p_partkey < 6").select(F.concat(F.lit("x/"), F.col("p_partkey").cast("string"), F.lit(".md")).alias("rel"), F.initcap("p_name").alias("title"), F.lit(None).cast("array<string>").alias("aliases"))
    line = table(spark, d, "lineitem").join(p.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    items = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "p_name"))), lambda x: F.concat(x["p_name"], F.lit(" (example)")))
    lists = line.groupBy(F.concat(F.lit("o:"), F.col("l_orderkey").cast("string")).alias("node")).agg(items.alias("items")).withColumn("key", F.lit("items"))
    return edits.pruned_lists(lists, edits.dead_names(samples))


# ---- policy ------------------------------------------------------------------------------


@query("deny_prefix", f"select rel, case when rel like '90-templates/%' then '90-templates' when rel like '99-system/%' then '99-system' when regexp_extract(rel, '[^/]+$') = 'o77.md' then 'O77' end as hit from {NOTES_SQL}")
def _(spark, d):
    return notes(spark, d).select("rel", policy.prefix_hit(policy.normal_path(F.col("rel")), ("90-templates", "99-system", "O77")).alias("hit"))


_ESC = "case when key % 50 = 0 then '../' || rel when key % 50 = 1 then '03-projects/../90-templates/./x' when key % 50 = 2 then null when key % 50 = 3 then '03-projects/context.jsonld' else rel end"


@query("write_gate", f"""
select key, case
  when target is null then 'unresolved' when target like '../%' then 'outside the vault'
  when target like '%90-templates/%' then 'denied: 90-templates' when target like '99-system/%' then 'denied: 99-system' when target like '09-archive/%' then 'denied: 09-archive'
  when target like '05-people/%' then 'denied: 05-people' when target like '%context.jsonld' then 'denied: context.jsonld'
  when key % 11 = 0 then 'overwrite denied' when state = 'waiting' and key % 2 = 0 then 'confidential' when key % 13 = 3 then 'sensitivity'
  when key % 17 = 4 then 'template outside its folder' when key % 19 = 5 then 'too large' end as verdict
from (select *, {_ESC} as target from {NOTES_SQL})""")  # fmt: skip
def _(spark, d):
    n, k = notes(spark, d), F.col("key")
    hidden = n.filter("state = 'waiting' and key % 2 = 0").select("rel")
    target = F.when(k % 50 == 0, F.concat(F.lit("../"), "rel")).when(k % 50 == 1, "03-projects/../90-templates/./x").when(k % 50 == 2, F.lit(None)).when(k % 50 == 3, "03-projects/context.jsonld").otherwise(F.col("rel"))
    asked = n.select(
        "key", target.alias("target"), F.when(k % 19 == 5, F.repeat(F.lit("é"), 11)).otherwise("short").alias("payload"), F.when(k % 13 == 3, " Sensitivity").otherwise("x").alias("prop"),
        F.when(k % 17 == 4, "a/../../b").otherwise("meeting").alias("template"), (k % 11 == 0).alias("overwrite"),
    )
    return policy.write_verdicts(asked, policy.Policy(max_write_bytes=20), hidden).select("key", "verdict")


@query("confidential_notes", f"select rel from {NOTES_SQL} where key % 10 = 1 or key % 10 = 2 or state = 'waiting' or key % 10 = 0 and description like '%5'")
def _(spark, d):
    k = F.col("key")
    flags = [k % 10 != 1, k % 10 > 2, F.when(k % 10 == 2, "YAML error"), F.when((k % 10 == 0) & F.col("description").endswith("5"), "﻿--- x").otherwise("text"), F.when(F.col("state") == "waiting", "Confidential")]
    return notes(spark, d).filter(policy.confidential(*[f if i < 2 else f.cast("string") for i, f in enumerate(flags)])).select("rel")


@query("side_write", f"select rel, rel like '01-journal/%' as ok from {NOTES_SQL}")
def _(spark, d):
    return notes(spark, d).select("rel", policy.side_write_ok(F.col("rel"), policy.Policy(allow_write=("01-journal", "90-templates"))).alias("ok"))


@query("search_hidden", f"select rel, title from {NOTES_SQL} where title like '%77%' and state <> 'waiting'")
def _(spark, d):
    n = notes(spark, d)
    return policy.visible(n.filter(F.contains("title", F.lit("77"))).select("rel", "title"), n.filter("state = 'waiting'").select("rel"), "rel")


@query("rate_limit", """
with recursive a as (select user_id, event_id, epoch_us(ts) as t, row_number() over (partition by user_id order by ts, event_id) as i from events),
r as (select user_id, event_id, i, [t] as held, true as ok from a where i = 1
  union all select a.user_id, a.event_id, a.i,
    case when len(list_filter(r.held, lambda h: a.t - h < 43200000000)) < 2 then list_append(list_filter(r.held, lambda h: a.t - h < 43200000000), a.t) else list_filter(r.held, lambda h: a.t - h < 43200000000) end,
    len(list_filter(r.held, lambda h: a.t - h < 43200000000)) < 2
  from r join a on a.user_id = r.user_id and a.i = r.i + 1)
select user_id, event_id, ok from r""")  # fmt: skip
def _(spark, d):
    return policy.rate_limited(table(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", "ts", "event_id", 2, 43200.0).select("user_id", "event_id", "ok")


# ---- format, index, dates ----------------------------------------------------------------


def _parsed(spark, d):
    """Notes as a parser gives them, with faults put in."""
    k = F.col("key")
    item = lambda key, tag, s, many=False: F.struct(F.lit(key).alias("key"), F.lit(many).alias("is_list"), F.lit(False).alias("is_map"), F.array(F.struct(F.lit(tag).alias("tag"), s.cast("string").alias("str"))).alias("items"))
    raw = F.array(item("type", "str", F.col("type")), item("description", "str", F.when(k % 6 == 0, " ").otherwise(F.col("description"))), item("status", "str", F.when(k % 8 == 0, "wip").otherwise(F.col("status"))), item("stale_after", "str", F.when(k % 9 == 0, "2020-01-01").otherwise(F.col("stale_after"))))
    raw = F.when(k % 10 == 0, F.array_append(raw, item("timestamp", "str", F.lit("x")))).otherwise(raw)
    event = F.array(F.struct(F.lit("generated").alias("field"), (k % 12 != 0).alias("ok"), F.when(k % 14 == 0, "somebody").otherwise("human:ann").alias("by"), F.when(k % 15 == 0, "2020-01-01").otherwise("2020-01-01T00:00:00Z").alias("at"), F.lit("str").alias("at_tag")))
    source = F.array(F.struct(F.lit(0).alias("no"), (k % 18 != 0).alias("ok"), F.lit("s").alias("id"), F.lit("u").alias("resource"), F.lit("t").alias("title"), F.when(k % 20 == 0, "then").otherwise("2020-01-01T00:00:00+01:00").alias("modified"), F.lit("str").alias("modified_tag"), F.lit(True).alias("has_modified")))
    return notes(spark, d).select("key", "rel", (k % 21 != 0).alias("valid"), (k % 22 != 0).alias("has_fm"), F.when(k % 44 == 0, "YAML error: x").alias("fm_error"), raw.alias("raw"), event.alias("events"), source.alias("sources"), F.lit("text").alias("body"))


def _reserved(parsed):
    """An index and a log file beside each note; one index is the root's and may carry its version."""
    k = F.col("key")
    at = F.concat(F.lit("o/"), k.cast("string"))
    raw = F.transform(F.slice("raw", 1, 1), lambda x: x.withField("key", F.lit("okf_version")))
    index = parsed.withColumns({"rel": F.when(k == 1, "index.md").otherwise(F.concat(at, F.lit("/index.md"))), "has_fm": k % 2 == 1, "raw": raw})
    log = parsed.withColumns({"rel": F.concat(at, F.lit("/log.md")), "has_fm": k % 4 == 0, "body": F.concat(F.lit("# Log\n\n## 2026-01-01\n* x\n\n## "), F.when(k % 3 == 0, "May 2026").otherwise("2026-02-02"))})
    return index.unionByName(log)


@query("format_findings", f"""
with n as (select *, rel like '90-templates/%' as tpl, key % 21 <> 0 as valid, key % 21 <> 0 and key % 22 <> 0 as ok from {NOTES_SQL})
select 'error' as level, 'DOC-01' as rule, rel from n where not valid
union all select 'error', 'DOC-05', rel from n where valid and key % 44 = 0
union all select 'error', 'DOC-06', rel from n where valid and key % 22 = 0 and key % 44 <> 0
union all select 'error', 'DOC-07', rel from n where ok and type = ''
union all select 'warning', 'DOC-08', rel from n where ok and not tpl and key % 6 = 0
union all select 'error', 'DOC-09', rel from n where ok and key % 8 = 0
union all select 'error', 'DOC-10', rel from n where ok and key % 12 = 0
union all select 'error', 'DOC-10', rel from n where ok and key % 12 <> 0 and key % 14 = 0
union all select 'error', 'DOC-11', rel from n where ok and not tpl and key % 12 <> 0 and key % 15 = 0
union all select 'error', 'DOC-12', rel from n where ok and not tpl and key % 9 = 0
union all select 'error', 'DOC-13', rel from n where ok and key % 18 = 0
union all select 'error', 'DOC-13', rel from n where ok and key % 18 <> 0 and key % 20 = 0
union all select 'warning', 'DOC-14', rel from n where ok and key % 10 = 0
union all select 'error', 'DOC-01', case when key = 1 then 'index.md' else 'o/' || key || '/index.md' end from n where not valid
union all select 'error', 'DOC-01', 'o/' || key || '/log.md' from n where not valid
union all select 'error', 'DOC-02', 'o/' || key || '/index.md' from n where valid and key % 2 = 1 and key <> 1
union all select 'error', 'DOC-03', 'o/' || key || '/log.md' from n where valid and key % 3 = 0
union all select 'error', 'DOC-04', 'o/' || key || '/log.md' from n where valid and key % 4 = 0""")  # fmt: skip
def _(spark, d):
    own = _parsed(spark, d)
    return validate.format_findings(own.unionByName(_reserved(own)), "90-templates").select("level", "rule", "rel")


@query("day_notes_misplaced", """
select '01-journal/daily/' || case when o_orderkey % 2 = 0 then strftime(o_orderdate, '%Y/%m/') else '' end || strftime(o_orderdate, '%Y-%m-%d') || '.md' as rel from orders where o_orderkey % 2 = 1 group by 1""")
def _(spark, d):
    at = F.col("o_orderdate")
    rel = F.concat(F.lit("01-journal/daily/"), F.when(F.col("o_orderkey") % 2 == 0, F.date_format(at, "yyyy/MM/")).otherwise(""), F.date_format(at, "yyyy-MM-dd"), F.lit(".md"))
    own = table(spark, d, "orders").select(rel.alias("rel"), F.lit(True).alias("valid")).distinct()
    return validate.misplaced_days(own, {"folder": "01-journal", "format": "[daily]/YYYY/MM/YYYY-MM-DD"}).select("rel")


@query("index_build", f"""
select split_part(rel, '/', 1) as section, rel, '* [' || title || '](' || rel || ')' || case when description = '' then '' else ' - ' || description end as entry from {NOTES_SQL}""")
def _(spark, d):
    return validate.index(notes(spark, d).select(validate.section().alias("section"), "rel", validate.index_entry(F.col("title"), F.col("rel"), F.col("description")).alias("entry")))


@query("daily_paths", "select o_orderkey, strftime(o_orderdate, '01-journal/daily/%Y/%m/%Y-%m-%d.md') as daily, strftime(o_orderdate, '01-journal/monthly/%Y-%m.md') as monthly from orders")
def _(spark, d):
    cfg = {"folder": "01-journal", "format": "[daily]/YYYY/MM/YYYY-MM-DD"}

    @F.pandas_udf("struct<daily:string,monthly:string>")
    def paths(days):
        import pandas as pd

        each = {x: (M.daily_path(cfg, x), M.month_path(cfg, x)) for x in set(days)}
        return pd.DataFrame([each[x] for x in days], columns=["daily", "monthly"])

    return table(spark, d, "orders").select("o_orderkey", paths(F.col("o_orderdate").cast("date")).alias("p")).select("o_orderkey", "p.daily", "p.monthly")


@query("date_tests", """
select o_orderkey, o_orderkey % 2 = 0 as instant, o_orderkey % 3 <> 0 as day, case when o_orderkey % 3 <> 0 and o_orderkey % 5 <> 0 then strftime(o_orderdate, '%Y-%m-%d') end as due from orders""")
def _(spark, d):
    k, at = F.col("o_orderkey"), F.col("o_orderdate")
    instant = F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(k % 2 == 0, "+02:00").otherwise(""))
    due = F.when(k % 3 == 0, F.date_format(at, "yyyy-M-d'.'")).when(k % 5 == 0, "2020-02-31").otherwise(F.date_format(at, "yyyy-MM-dd"))
    return table(spark, d, "orders").select("o_orderkey", T.is_instant(instant).alias("instant"), T.is_day(due).alias("day"), T.due_date(due).cast("string").alias("due"))


