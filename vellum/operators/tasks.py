"""Task lists: scan, buckets, copies of one task, digest."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markdown as M
from ..functions import text as T

TASKS = "file string, line int, done boolean, text string, owner string, due string, note_type string, key string"
LEAST_KEY = 12


def outside_fences(lines: DataFrame, by: str, no: str, text: str = "line") -> DataFrame:
    """The lines outside code fences, and not the fences: a running count of fence lines per
    note, of which an even one means outside. A note's lines are one text and so bounded."""
    fence = F.trim(F.col(text)).startswith("```")
    parity = F.sum(fence.cast("int")).over(Window.partitionBy(by).orderBy(no))
    return lines.withColumn("_n", parity).filter((F.col("_n") % 2 == 0) & ~fence).drop("_n")


def parsed(lines: DataFrame) -> DataFrame:
    """done, text, owner, due, key beside the lines (a column line) that are task lines."""
    kept = lines.schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, cols = [], [[], [], [], [], []]
            for i, line in enumerate(batch.column("line").to_pylist()):
                got = M.task(line or "")
                if got and not M.is_template_task(got[1]):
                    at.append(i)
                    for c, v in zip(cols, (*got, M.task_key(got[1])), strict=True):
                        c.append(v)
            rows = batch.take(pa.array(at, pa.int64()))
            types = (pa.bool_(), *[pa.string()] * 4)
            yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[*kept, "done", "text", "owner", "due", "key"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema)
    return lines.mapInArrow(run, f"{fields}, done boolean, text string, owner string, due string, key string")


def scan(notes: DataFrame, skip: tuple[str, ...] = ("90-templates/", "09-archive/"), digest: str = "00-home/todo-digest.md") -> DataFrame:
    """All tasks of the notes (rel, type, body, and offset: lines before the body)."""
    rel = F.col("rel")
    keep = ~T.path_name(rel).isin("index.md", "log.md") & (rel != digest)
    for prefix in skip:
        keep = keep & ~rel.startswith(prefix)
    lines = notes.filter(keep).select("rel", "offset", F.coalesce("type", F.lit("")).alias("note_type"), F.posexplode(F.split("body", r"\R")).alias("no", "line"))
    # a line that can be no task needs no parser; fences are counted before
    out = outside_fences(lines, "rel", "no").filter(F.col("line").rlike(r"^\s*[-*]\s+\[[ xX]\]"))
    out = parsed(out)
    return out.select(F.col("rel").alias("file"), (F.col("offset") + F.col("no") + 1).cast("int").alias("line"), "done", "text", "owner", "due", "note_type", "key")


def flags(tasks: DataFrame, today: dt.date | Column, days: int = 7) -> DataFrame:
    """Tasks with overdue, due_soon and no_owner. A task is overdue before today, due soon from
    today to `days` later, and without owner unless it stands in a daily note."""
    now = today if isinstance(today, Column) else F.lit(today)
    due, open_ = T.due_date(F.col("due")), ~F.col("done")
    return tasks.withColumns(
        {
            "overdue": F.coalesce(open_ & (due < now), F.lit(False)),
            "due_soon": F.coalesce(open_ & (due >= now) & (due <= F.date_add(now, days)), F.lit(False)),
            "no_owner": open_ & (F.coalesce("owner", F.lit("")) == "") & ~F.col("note_type").eqNullSafe("daily"),
        }
    )


def counts(flagged: DataFrame) -> DataFrame:
    """One row: open, overdue, due_soon, no_owner."""
    return flagged.agg(F.count_if(~F.col("done")).alias("open"), *[F.count_if(F.col(c)).alias(c) for c in ("overdue", "due_soon", "no_owner")])


def copies(tasks: DataFrame, least: int = LEAST_KEY) -> DataFrame:
    """key, files, n, conflict: texts of enough letters that stand in several files, and whether
    one is done and another open."""
    by = tasks.filter(F.length("key") >= least).groupBy("key")
    out = by.agg(F.countDistinct("file").alias("files"), F.count(F.lit(1)).alias("n"), (F.bool_or("done") & F.bool_or(~F.col("done"))).alias("conflict"))
    return out.filter("files > 1")


def closable(tasks: DataFrame, least: int = LEAST_KEY) -> DataFrame:
    """The open tasks that a done copy closes: same key in several files, same owner and due,
    and not both in daily notes. No pairs are made: a done copy is a row for each
    (key, owner, due) and whether one stands outside daily notes."""
    conflict = copies(tasks, least).filter("conflict").select("key")
    who = F.lower(F.trim(F.coalesce("owner", F.lit(""))))
    own = tasks.join(conflict, "key", "left_semi").withColumns({"who": who, "when": F.coalesce("due", F.lit("")), "daily": F.col("note_type").eqNullSafe("daily")})
    closed = own.filter("done").groupBy("key", "who", "when").agg(F.bool_or(~F.col("daily")).alias("beside"))
    hit = own.filter(~F.col("done")).join(closed, ["key", "who", "when"]).filter(F.col("beside") | ~F.col("daily"))
    return hit.select(*tasks.columns)


def for_owner(tasks: DataFrame, owner: str) -> DataFrame:
    return tasks.filter(F.lower("owner") == owner.lower()) if owner else tasks


def task_line(source: str) -> Column:
    """How a digest at `source` shows a task: box, text, owner and due, link to its note."""
    meta = F.concat_ws(" — ", F.nullif("owner", F.lit("")), F.concat(F.lit("due "), F.nullif("due", F.lit(""))))
    where = F.concat(F.lit("["), T.path_stem(F.col("file")), F.lit("]("), T.quoted(T.relative(F.lit(source), F.col("file"))), F.lit(")"))
    return F.concat(F.when(F.col("done"), "- [x] ").otherwise("- [ ] "), "text", F.when(meta == "", "").otherwise(F.concat(F.lit(" — "), meta)), F.lit(" · "), where)


def digest(tasks: DataFrame, today: dt.date, now: dt.datetime, path: str = "00-home/todo-digest.md", actor: str = "process:todos") -> str:
    """The digest note. What it lists is what a person reads; it is put together on the driver."""
    flagged = flags(tasks, today).withColumn("shown", task_line(path)).cache()
    try:
        rows = flagged.filter(~F.col("done") | F.col("overdue")).orderBy("due", "file", "line").collect()
        same = copies(tasks)
        groups: dict[str, list] = {}
        for r in flagged.join(same.select("key", "conflict"), "key").orderBy("key", "file", "line").collect():
            groups.setdefault(r["key"], []).append(r)
        n_files = tasks.select("file").distinct().count()
    finally:
        flagged.unpersist()
    late, soon, lone = ([r for r in rows if r[c]] for c in ("overdue", "due_soon", "no_owner"))
    clash = sum(g[0]["conflict"] for g in groups.values())
    out = [
        "---", "type: system", "title: Todo Digest",
        f"description: Task digest as of {today.isoformat()} — {len(late)} overdue, {len(soon)} due soon, {clash} conflict(s).",
        "tags: [system, generated]", "sensitivity: internal", f'generated: {{ by: {actor}, at: "{now.isoformat(timespec="seconds")}" }}', "---", "",
        "# Todo Digest", "", f"{len(rows)} open tasks across {n_files} notes. Tick a task where it lives, not here.", "",
    ]
    for title, items, none in (("Overdue", late, "nothing overdue"), ("Due in the next 7 days", soon, "nothing due"), ("Open without owner", lone, "every open task has an owner")):
        out += [f"## {title}", "", *([r["shown"] for r in items] or [f"_{none}_"]), ""]
    out += ["## Same task in several notes", "", *(["_no duplicates_"] if not groups else [])]
    for g in groups.values():
        out.append(f"- {'⚠ done in one note, open in another: ' if g[0]['conflict'] else ''}{g[0]['text']}")
        out += [f"  - [{'x' if r['done'] else ' '}] [{r['file'].rpartition('/')[2].removesuffix('.md')}]({M.link(path, r['file'])}) line {r['line']}" for r in g]
    out += ["", "## By owner", ""]
    owners: dict[str, list] = {}
    for r in rows:
        owners.setdefault(r["owner"] or "(no owner)", []).append(r)
    for owner in sorted(owners):
        out += [f"### {owner}", "", *(r["shown"] for r in sorted(owners[owner], key=lambda r: (r["due"] or "9999", r["file"]))), ""]
    return "\n".join(out).rstrip() + "\n"


def by_owner(flagged: DataFrame) -> DataFrame:
    """owner, open, overdue: how many open tasks (as flags() gives them) each owner has."""
    owner = F.when(F.col("owner") == "", "(no owner)").otherwise(F.col("owner")).alias("owner")
    return flagged.filter("not done").groupBy(owner).agg(F.count(F.lit(1)).alias("open"), F.count_if("overdue").alias("overdue"))


def minutes(lines: DataFrame) -> DataFrame:
    """kind (action, decision, outcome) and item beside the lines (a column line) that say one."""
    kept = lines.schema.fieldNames()
    added = ("kind", "said", "owner_", "due_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(i, *hit) for i, x in enumerate(batch.column("line").to_pylist()) if (hit := M.minute_line(x or ""))]
            rows = batch.take(pa.array([g[0] for g in got], pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array([g[k] for g in got], pa.string()) for k in range(1, 5))], names=[*kept, *added])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema)
    said = lines.mapInArrow(run, f"{fields}, " + ", ".join(f"{c} string" for c in added))
    item = F.when(F.col("kind") == "action", T.action_line(F.col("said"), F.col("owner_"), F.col("due_"))).otherwise(F.col("said"))
    return said.select(*kept, "kind", item.alias("item"))
