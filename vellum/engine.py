"""The engine over one vault: everything a command or a tool asks for, as methods."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import cached_property
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import markdown as M
from .functions import text as T
from .operators import checks, edits, exports, minutes, policy, providers, reconcile, search, sqlgate, tasks, validate, views
from .operators.graph import Graph, build
from .operators.policy import Policy, PolicyError
from .sources.vault import RESERVED, Vault, walk_key


class Engine:
    """Reads and writes of a vault under a policy. Without one nothing is hidden or refused.

    The graph is built once and again when the notes' count or newest time has changed.
    """

    def __init__(self, spark: SparkSession, root: str, rules: Policy | None = None, now: dt.datetime | None = None):
        self.spark, self.vault = spark, Vault(spark, root)
        self.rules = rules or Policy(deny_write=(), hide_confidential=False, max_writes_per_minute=1 << 30, max_write_bytes=1 << 40, allow_overwrite=True)
        self.guarded = rules is not None
        self.audit = policy.Audit(self.rules.audit_path)
        self.proposals = policy.Proposals(f"{root}/.vellum/proposals")
        self._now, self._graph, self._writes = now, None, []

    def now(self) -> dt.datetime:
        return self._now or dt.datetime.now(dt.UTC)

    def today(self) -> dt.date:
        return self.now().date()

    # -- what is there
    def notes(self) -> DataFrame:
        return self.vault.notes()

    @cached_property
    def _nothing(self) -> DataFrame:
        return self.spark.createDataFrame([], "rel string")

    def hidden(self) -> DataFrame:
        return policy.hidden_notes(self.notes()) if self.rules.hide_confidential else self._nothing

    def _signature(self) -> tuple:
        """Number of files, newest time, and a sum over names, times and lengths: renames and older times count, too."""
        each = F.xxhash64("rel", "mtime", "length").cast("decimal(38,0)")
        return tuple(self.vault.files("*.[mM][dD]", content=False).agg(F.count(F.lit(1)), F.max("mtime"), F.sum(each)).first())

    def graph(self) -> Graph:
        """The graph as the policy shows it."""
        at = self._signature()
        if self._graph is None or self._graph[0] != at:
            g = build(self.vault, self.now())
            self._graph = (at, policy.redacted(g, self.hidden()) if self.rules.hide_confidential else g)
        return self._graph[1]

    def skipped_files(self) -> list[str]:
        return [r["rel"] for r in self.vault.undecodable().orderBy("rel").collect()]

    # -- reads
    def _read(self, tool: str, args: dict, run: Callable[[], Any]) -> Any:
        return self.audit.guarded(tool, args, False, run)

    def read_note(self, ref: str) -> str:
        def run():
            rel = edits.locate(self.vault, ref)
            if not self.hidden().filter(F.col("rel") == rel).isEmpty():
                raise PolicyError(f"`{rel}` is marked confidential and is not available")
            return edits.read(self.vault, rel)

        return self._read("read_note", {"file": ref}, run)

    def list_files(self, folder: str = "") -> DataFrame:
        if ".." in folder.split("/"):
            raise edits.EditError("folder escapes the vault")
        rows = self.vault.files("*.[mM][dD]", content=False).select("rel").filter(F.col("rel").startswith(folder))
        return policy.visible(rows, self.hidden(), "rel").orderBy(walk_key(F.col("rel")))

    def _searchable(self) -> DataFrame:
        title = F.coalesce(F.try_element_at(F.filter("raw", lambda x: x["key"] == "title"), F.lit(1))["items"][0]["str"], T.path_stem(F.col("rel")))
        own = self.notes().filter(F.col("valid") & ~T.path_name(F.col("rel")).isin(*RESERVED) & ~F.col("rel").startswith("90-templates"))
        return own.select(F.col("rel").alias("file"), title.alias("title"), "body", F.col("fm").alias("props"), walk_key(F.col("rel")).alias("walk"))

    def search(self, query: str, limit: int = 10) -> DataFrame:
        found = search.haystack_search(self._searchable(), query, limit, ["walk"])
        return self._read("search", {"query": query, "limit": limit}, lambda: policy.visible(found, self.hidden(), "file").orderBy(F.col("score").desc(), "file"))

    def keyword_search(self, question: str, n: int = 5) -> DataFrame:
        return search.keyword_search(self._searchable(), question, n, ["walk"])

    def backlinks(self, ref: str) -> DataFrame:
        """Notes whose text holds the wikilink, the path or the file name of a note."""
        rel = edits.locate(self.vault, ref)
        rows = search.backlinks(self.notes().filter(F.col("valid") & (F.col("rel") != rel)), rel).select("rel")
        return policy.visible(rows, self.hidden(), "rel").orderBy(walk_key(F.col("rel")))

    def neighbors(self, node: str, depth: int = 1, preds: list[str] | None = None) -> DataFrame:
        g = self.graph()
        if g.resolve_id(node) is None:
            raise PolicyError(f"no visible note matches {node!r}")
        return g.neighbors(node, depth, preds)

    def path(self, a: str, b: str) -> list[tuple[str, str, str]]:
        return self.graph().shortest_path(a, b)

    def context(self, node: str, depth: int = 1) -> str:
        return self.graph().context_pack(node, depth)

    def sql(self, statement: str, limit: int = 200) -> DataFrame:
        return self._read("graph_query", {"sql": statement}, lambda: sqlgate.query(self.spark, statement, self.graph().tables(), limit))

    def cached_sql(self, statement: str, folder: str, limit: int = 200, rebuild: bool = False) -> DataFrame:
        """As sql(), over the tables kept in a folder; they are written first if they are not
        there or a rebuild is asked for. Only the tables of the policy's view are ever kept."""
        if rebuild or not (Path(folder) / "meta").exists():
            exports.write_parquet(self.graph(), folder)
        return sqlgate.query(self.spark, statement, exports.read_parquet(self.spark, folder), limit)

    def providers(self) -> list[providers.SearchProvider]:
        notes = self._searchable()
        return [providers.RankedProvider(notes), providers.KeywordProvider(notes, ["walk"])]

    def hits(self, question: str, n: int = 5, provider: str | None = None) -> DataFrame:
        """Hits of the provider that the caller, the environment or the vault's settings choose."""
        want = providers.choice("search", provider, providers.own_settings(self.vault))
        return policy.visible(providers.hits(self.providers(), question, n, want), self.hidden(), "file")

    def completeness(self) -> str:
        """What whole-vault answers add: how many files no reader sees."""
        n = len(self.skipped_files())
        return f"{n} file(s) are not valid UTF-8 and were not read" if n else ""

    def view(self, base: str, name: str) -> DataFrame:
        """A view of a view file of the vault."""
        import yaml

        spec = yaml.safe_load(self.vault.text_of(base) or "") or {}
        return views.compiled(self.frame(), spec, name, self.today())

    def frame(self) -> DataFrame:
        """Notes with a column for each property that the ontology or a view knows."""
        keys = sorted({p for c in self.vault.ontology.classes for p in self.vault.ontology.specs(c)} | {"type", "state", "status", "health", "due", "date"})
        get = lambda k: F.try_element_at(F.filter("props", lambda x: x["key"] == k), F.lit(1))["items"][0]["str"].alias(k)
        return self.notes().filter("valid").select("rel", "mtime", *[get(k) for k in keys])

    # -- tasks
    def tasks(self) -> DataFrame:
        kind = F.try_element_at(F.filter("raw", lambda x: x["key"] == "type"), F.lit(1))["items"][0]["str"]
        return tasks.scan(self.notes().filter("valid").withColumn("type", kind))

    def todos(self, owner: str = "", overdue_only: bool = False, every: bool = False) -> dict[str, Any]:
        """Counts over all tasks, and the visible ones that are asked for: open ones, overdue ones, or every one."""
        flagged = tasks.flags(self.tasks(), self.today())
        shown = tasks.for_owner(flagged.filter("overdue" if overdue_only else "true" if every else "not done"), owner)
        clash = tasks.copies(flagged).filter("conflict").select("key")
        return {"counts": tasks.counts(flagged).first().asDict(), "tasks": policy.visible(shown, self.hidden(), "file"), "conflicts": policy.visible(flagged.join(clash, "key", "left_semi"), self.hidden(), "file")}

    def sync_done(self) -> list[dict]:
        return edits.sync_done(self.vault, self.tasks(), self.today())

    def write_digest(self, path: str = "00-home/todo-digest.md") -> str:
        return edits.write(self.vault, path, tasks.digest(self.tasks(), self.today(), self.now(), path))

    # -- checks and exports
    def validate(self, strict: bool = False, ontology: bool = True) -> tuple[bool, DataFrame, DataFrame]:
        """(success, format and link findings, ontology findings)."""
        found = validate.validate(self.vault)
        onto = build(self.vault, self.now()).findings if ontology else self.spark.createDataFrame([], checks.FINDING)
        return validate.passes(found, onto, strict), found, onto

    def write_index(self) -> str:
        return edits.write_index(self.vault)

    def write_artifacts(self, folder: str | None = None) -> dict[str, Path]:
        return exports.write_artifacts(self.graph(), self.vault.context(), folder or f"{self.vault.root}/.vellum")

    # -- reconciliation, minutes, examples
    def reconcile(self, apply: bool = False) -> list[dict]:
        g = build(self.vault, self.now())
        if apply:
            return reconcile.apply(self.vault, g, self.today())
        return [r.asDict() for r in reconcile.changes(self.vault, g).orderBy("code", "file", "node").collect()]

    def minutes(self, text: str, title: str, date: dt.date | None = None, dry_run: bool = False, **more: Any) -> minutes.Filing:
        g = build(self.vault, self.now())
        filing = {k: more.pop(k) for k in ("kind", "force", "daily", "actor") if k in more}
        m = minutes.draft(g, text, _one_line(title), date or self.today(), **more)
        return m if dry_run else self._write("file_minutes", {"title": title, "text": text}, m.path, text, lambda: minutes.file(self.vault, g, m, now=self.now(), **filing))

    def remove_examples(self, dry_run: bool = False) -> dict[str, list]:
        return edits.remove_examples(self.vault, dry_run, self.today())

    # -- writes under the policy
    def _write(self, tool: str, args: dict, target: str | None, payload: str, run: Callable[[], Any], prop: str = "", template: str | None = None, overwrite: bool = False) -> Any:
        def checked():
            if not self.guarded:
                return run()
            row = [(target, payload, prop, template, overwrite)]
            df = self.spark.createDataFrame(row, "target string, payload string, prop string, template string, overwrite boolean")
            why = policy.write_verdicts(df, self.rules, self.hidden()).first()["verdict"]
            if why:
                raise PolicyError(f"{tool}: {why}")
            if not policy.allowed_by_rate([self.now().timestamp()], self.rules.max_writes_per_minute, held=self._writes)[0]:
                raise PolicyError(f"{tool}: write rate limit reached")
            if self.rules.propose:
                return f"proposed:{self.proposals.add(tool, args)}"
            return run()

        self._graph = None
        return self.audit.guarded(tool, args, True, checked)

    def _target(self, ref: str, must_exist: bool = True) -> str | None:
        try:
            return edits.locate(self.vault, ref, must_exist)
        except edits.EditError:
            return None

    def create_note(self, name: str, content: str = "", template: str | None = None, overwrite: bool = False) -> str:
        args = {"name": name, "content": content, "template": template, "overwrite": overwrite}
        return self._write("create_note", args, self._target(name, False), content, lambda: edits.create(self.vault, name, content, template, overwrite, self.now()), template=template, overwrite=overwrite)

    def append_note(self, file: str, content: str) -> str:
        return self._write("append_note", {"file": file, "content": content}, self._target(file), content, lambda: edits.append(self.vault, file, content))

    def daily_append(self, content: str, day: dt.date | None = None) -> str:
        day = day or self.today()
        target = M.daily_path(self.vault.config("daily-notes.json"), day)
        return self._write("daily_append", {"content": content}, target, content, lambda: edits.daily_append(self.vault, content, day, self.now()))

    def set_property(self, file: str, name: str, value: Any) -> str:
        return self._write("set_property", {"file": file, "name": name, "value": value}, self._target(file), str(value), lambda: edits.set_property(self.vault, file, name, value), prop=name)

    def append_log(self, message: str, kind: str = "Update") -> bool:
        return edits.log(self.vault, message, kind, self.today())

    def apply_proposal(self, pid: str) -> Any:
        """Runs a proposal, checked once more under the policy without proposing."""
        direct = Engine(self.spark, self.vault.root, policy.without_proposing(self.rules), self._now)
        run = {"create_note": direct.create_note, "append_note": direct.append_note, "daily_append": direct.daily_append, "set_property": direct.set_property, "file_minutes": direct.minutes}

        def call(tool: str, args: dict) -> Any:
            if tool not in run:
                raise PolicyError(f"unknown tool in proposal: {tool}")
            return run[tool](**args)

        return self.proposals.apply(pid, call)

    # -- prompts
    def prompt(self, question: str, n: int = 5, with_graph: bool = True, most_packs: int = 4) -> list[dict[str, str]]:
        """Messages for a language model: hits, with confidential ones withheld, and packs of the
        notes that the question names and the hits are."""
        hits = [r.asDict() for r in self.keyword_search(question, n).collect()]
        hidden = {r["rel"] for r in self.hidden().join(self.spark.createDataFrame([(h["file"],) for h in hits], "rel string"), "rel", "left_semi").collect()} if hits else set()
        for h in hits:
            if h["file"] in hidden:
                h["snippet"] = "(confidential: withheld)"
        parts = [f"[{i}] {h['file']} — {h['title']}\n{h['snippet']}" for i, h in enumerate(hits, 1)]
        if with_graph:
            g = self.graph()
            names = minutes.graph_names(g).filter("type <> 'system'").select(F.col("id").alias("node"), F.explode(F.concat(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
            asked = self.spark.createDataFrame([(0, question)], "id int, text string")
            named = [r["node"] for r in search.mentions(asked, names).orderBy(F.desc("size"), F.desc("node")).limit(most_packs).collect()]
            ids = list(dict.fromkeys([*named, *(h["file"] for h in hits[:3] if h["file"] not in hidden)]))[:most_packs]
            parts = [g.context_pack(i) for i in ids] + parts
        return [{"role": "system", "content": "Answer from the notes below and cite their paths."}, {"role": "user", "content": "\n\n".join([*parts, f"Question: {question}"])}]

    def ask(self, question: str, complete: Callable[[list[dict[str, str]]], str], **more: Any) -> str:
        """The answer of an injected language model to a prompt."""
        return complete(self.prompt(question, **more))


def _one_line(text: str) -> str:
    return " ".join(str(text).split())
