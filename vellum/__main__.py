"""python -m vellum VERB ...: the engine's verbs on the command line."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import os
import sys

from .engine import Engine
from .functions import markdown as M
from .operators import exports, providers
from .operators.edits import EditError
from .operators.policy import PolicyError
from .operators.sqlgate import Refused
from .session import session


#: Where a language model is looked for unless another place is named.
BASE_URL = "http://localhost:1234/v1"


def main(argv: list[str] | None = None) -> int:
    """Runs a verb. What the vault or the policy refuses ends with its reason and 1; a model that does not answer, with 2."""
    try:
        return _run(argv)
    except (PolicyError, EditError) as exc:
        print(exc, file=sys.stderr)
        return 1
    except providers.NoEndpoint as exc:
        print(exc, file=sys.stderr)
        return 2


def _run(argv: list[str] | None) -> int:
    top = argparse.ArgumentParser(prog="vellum")
    top.add_argument("--vault", default=os.environ.get("VELLUM_VAULT", "."))
    verbs = top.add_subparsers(dest="verb", required=True)

    def verb(name: str, *args: str, **flags) -> None:
        p = verbs.add_parser(name)
        for a in args:
            p.add_argument(a)
        for k, v in flags.items():
            p.add_argument(f"--{k.replace('_', '-')}", **({"action": "store_true"} if v is bool else {"default": v, "type": type(v) if v is not None else str}))

    verb("index")
    verb("validate", strict=bool, no_ontology=bool)
    verb("log", "message", kind="Update")
    verb("build", out=None)
    verb("export", format="json", out="graph.out")
    verb("query", "sql", limit=200, json=bool, rebuild=bool, cache=None)
    verb("neighbors", "node", depth=1, pred=None)
    verb("path", "a", "b")
    verb("pack", "node", depth=1, out=None)
    verb("search", "query", limit=10)
    verb("view", "base", "name")
    verb("reconcile", apply=bool, json=bool)
    verb("todos", owner="", overdue=bool, all=bool, json=bool, digest=bool, sync_done=bool)
    verb("minutes", "file", title="Meeting", date=None, project=None, people=None, kind="project", daily=bool, dry_run=bool, force=bool, llm=bool, base_url=BASE_URL, model=None)
    verb("proposals", "action", id="", reason="")
    verb("examples", dry_run=bool)
    verb("prompt", "question", n=5)
    verb("ask", "question", n=5, graph=bool, dry_run=bool, base_url=BASE_URL, model=None)
    verb("slots", base_url=BASE_URL)
    a = top.parse_args(argv)
    if not os.path.isdir(a.vault):
        print(f"no vault at {a.vault}", file=sys.stderr)
        return 2
    e = Engine(session(), a.vault)
    if note := e.completeness():
        print(note, file=sys.stderr)
    show = lambda df: print(*df.toJSON().toLocalIterator(), sep="\n")
    say = lambda x: print(json.dumps(x, ensure_ascii=False, default=str, indent=1))
    if a.verb == "index":
        print(e.write_index())
    elif a.verb == "validate":
        good, found, onto = e.validate(a.strict, not a.no_ontology)
        show(found)
        show(onto)
        return int(not good)
    elif a.verb == "log":
        return int(not e.append_log(a.message, a.kind))
    elif a.verb == "build":
        say({k: str(v) for k, v in e.write_artifacts(a.out).items()})
    elif a.verb == "export":
        from pathlib import Path

        g, ctx, out = e.graph(), e.vault.context(), Path(a.out)
        write = {"json": lambda p: exports.write_json(g, p), "nt": lambda p: exports.write_ntriples(g, ctx, p), "jsonld": lambda p: exports.write_jsonld(g, ctx, p), "sqlite": lambda p: exports.write_sqlite(g, p)}
        formats = a.format.split(",")
        for name in formats:  # several formats share the stem
            print(write[name](out if len(formats) == 1 else out.with_suffix("." + name)))
    elif a.verb == "query":
        try:
            rows = e.cached_sql(a.sql, a.cache, a.limit, a.rebuild) if a.cache else e.sql(a.sql, a.limit)
            say([r.asDict(True) for r in rows.collect()]) if a.json else show(rows)
        except Refused as exc:
            print(exc, file=sys.stderr)
            return 1
    elif a.verb == "neighbors":
        found = [r.asDict() for r in e.neighbors(a.node, a.depth, a.pred.split(",") if a.pred else None).collect()]
        say(found)
        return int(not found)
    elif a.verb == "path":
        steps = e.path(a.a, a.b)
        say(steps)
        return int(not steps)
    elif a.verb == "pack":
        text = e.context(a.node, a.depth)
        if a.out:
            with open(a.out, "w", encoding="utf-8") as f:
                f.write(text)
        else:
            print(text)
    elif a.verb == "search":
        show(e.search(a.query, a.limit))
    elif a.verb == "view":
        show(e.view(a.base, a.name))
    elif a.verb == "reconcile":
        got = e.reconcile(a.apply)
        say(got) if a.json else print(*(f"{x.get('code')}: {x.get('file')}: {x.get('message')}" for x in got), sep="\n")
        return 2 if got and not a.apply else 0
    elif a.verb == "todos":
        if a.sync_done:
            say(e.sync_done())
        if a.digest:
            print(e.write_digest())
        got = e.todos(a.owner, a.overdue, a.all)
        if a.json:
            say({"counts": got["counts"], "tasks": [r.asDict() for r in got["tasks"].collect()]})
        else:
            say(got["counts"])
            show(got["tasks"])
    elif a.verb == "minutes":
        if a.file == "-":
            text = M.recap_text(sys.stdin.buffer.read())
        else:
            with open(a.file, "rb") as f:
                text = M.recap_text(f.read())
        extra = providers.structured(text, providers.endpoint(a.base_url, a.model)) if a.llm else {}
        extra = {k.removesuffix("s"): v for k, v in extra.items()}
        people = [p.strip() for p in a.people.split(",")] if a.people else None
        m = e.minutes(text, a.title, dt.date.fromisoformat(a.date) if a.date else None, a.dry_run, project=a.project, people=people, kind=a.kind, daily=a.daily, force=a.force, **({"extra": extra} if extra else {}))
        say(vars(m))
    elif a.verb == "proposals":
        if a.action not in ("list", "show", "apply", "reject"):
            top.error(f"unknown action {a.action}")
        if a.action != "list" and a.id not in {p["id"] for p in e.proposals.pending()}:
            print(f"no pending proposal {a.id}", file=sys.stderr)
            return 1
        if a.action == "list":
            say(e.proposals.pending())
        elif a.action == "show":
            say(e.proposals.get(a.id))
        elif a.action == "apply":
            say(e.apply_proposal(a.id))
        else:
            e.proposals.reject(a.id, a.reason)
    elif a.verb == "examples":
        say(e.remove_examples(a.dry_run))
    elif a.verb == "prompt":
        say(e.prompt(a.question, a.n))
    elif a.verb == "ask":
        if e.keyword_search(a.question, a.n).isEmpty():
            print("nothing in the vault matches the question", file=sys.stderr)
            return 1
        if a.dry_run:
            say(e.prompt(a.question, a.n, a.graph))
        else:
            print(e.ask(a.question, providers.endpoint(a.base_url, a.model), n=a.n, with_graph=a.graph))
    elif a.verb == "slots":
        want = providers.choice("search", None, providers.own_settings(e.vault))
        print(*("\t".join(row) for row in providers.slots(e.providers(), want, a.base_url)), sep="\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
