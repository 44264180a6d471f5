"""Declarative views: filters, order (projection), sort and limit, compiled to DataFrames.

A view is a mapping as the view files hold it. Filters are texts of a small expression
language, or and/or/not over such. Properties are read from a frame with a column for each,
and file.name, file.path, file.ext, file.mtime from columns rel and mtime.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Mapping, Sequence
from typing import Any

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

_TOKEN = re.compile(r"""\s*(?:("(?:[^"\\]|\\.)*"|'[^']*')|(\d+(?:\.\d+)?)|([A-Za-z_][\w.\-]*)|(==|!=|<=|>=|<|>|&&|\|\||!|\(|\)|,|\.))""")


class ViewError(ValueError):
    pass


class _Reader:
    """One expression; precedence: or, and, not, comparison."""

    def __init__(self, text: str, frame: Sequence[str], today: dt.date):
        self.columns, self.today, self.text = set(frame), today, text
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if not m:
                raise ViewError(f"cannot read {text[at:]!r} in {text!r}")
            kind = ("text", "number", "name", "sign")[[g is not None for g in m.groups()].index(True)]
            self.tokens.append((kind, m[m.lastindex]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] == "sign" else None

    def take(self, sign: str) -> bool:
        if self.peek() == sign:
            self.at += 1
            return True
        return False

    def whole(self) -> Column:
        out = self.either()
        if self.at < len(self.tokens):
            raise ViewError(f"more than one expression in {self.text!r}")
        return F.coalesce(out, F.lit(False))

    def either(self) -> Column:
        out = self.both()
        while self.take("||"):
            out = out | self.both()
        return out

    def both(self) -> Column:
        out = self.negated()
        while self.take("&&"):
            out = out & self.negated()
        return out

    def negated(self) -> Column:
        return ~F.coalesce(self.negated(), F.lit(False)) if self.take("!") else self.compared()

    def compared(self) -> Column:
        left = self.value()
        for sign, op in (("==", "eqNullSafe"), ("!=", "ne"), ("<=", "__le__"), (">=", "__ge__"), ("<", "__lt__"), (">", "__gt__")):
            if self.take(sign):
                right = self.value()
                return ~left.eqNullSafe(right) if op == "ne" else getattr(left, op)(right)
        return left

    def arguments(self) -> list[Column]:
        out: list[Column] = []
        if not self.take("("):
            raise ViewError(f"a call without arguments in {self.text!r}")
        while not self.take(")"):
            out.append(self.either())
            self.take(",")
        return out

    def value(self) -> Column:
        if self.take("("):
            out = self.either()
            if not self.take(")"):
                raise ViewError(f"an open parenthesis in {self.text!r}")
            return out
        if self.at >= len(self.tokens):
            raise ViewError(f"nothing to compare in {self.text!r}")
        kind, word = self.tokens[self.at]
        self.at += 1
        if kind == "text":
            return F.lit(word[1:-1])
        if kind == "number":
            return F.lit(float(word)) if "." in word else F.lit(int(word))
        if kind != "name":
            raise ViewError(f"{word!r} is no value in {self.text!r}")
        if word == "today":
            self.arguments()
            return F.lit(self.today)
        if word == "date":
            return F.try_to_timestamp(self.arguments()[0].cast("string")).cast("date")
        if word in ("true", "false"):
            return F.lit(word == "true")
        head, _, method = word.rpartition(".")
        if self.peek() == "(":
            args = self.arguments()
            if word == "file.inFolder":
                return F.col("rel").startswith(F.concat(F.regexp_replace(args[0], "/+$", ""), F.lit("/")))
            if method == "isTruthy":
                return truthy(self.property(head))
            if method == "contains":
                return F.contains(self.property(head), args[0])
            if method == "isEmpty":
                return ~truthy(self.property(head))
            raise ViewError(f"no function {word}")
        return self.property(word)

    def property(self, name: str) -> Column:
        if name == "file.name":
            return T.path_stem(F.col("rel"))
        if name == "file.path":
            return F.col("rel")
        if name == "file.ext":
            return F.regexp_extract("rel", r"\.([^./]+)$", 1)
        if name == "file.folder":
            return T.path_dir(F.col("rel"))
        if name == "file.mtime":
            return F.col("mtime")
        name = name.removeprefix("note.")
        return F.col(f"`{name}`") if name in self.columns else F.lit(None).cast("string")


def truthy(x: Column) -> Column:
    return ~F.coalesce(x.cast("string"), F.lit("")).isin("", "false", "0")


def predicate(filters: Any, frame: Sequence[str], today: dt.date) -> Column:
    """A filter tree: a text, or {and: [...]}, {or: [...]}, {not: [...]}."""
    if filters is None:
        return F.lit(True)
    if isinstance(filters, str):
        return _Reader(filters, frame, today).whole()
    if isinstance(filters, Mapping):
        out = F.lit(True)
        for key, items in filters.items():
            each = [predicate(x, frame, today) for x in (items if isinstance(items, list) else [items])]
            joined = F.lit(key != "or")
            for p in each:
                joined = joined | p if key == "or" else joined & (~p if key == "not" else p)
            out = out & joined
        return out
    raise ViewError(f"no filter: {filters!r}")


def compiled(notes: DataFrame, spec: Mapping, name: str, today: dt.date, unique: str = "rel") -> DataFrame:
    """The rows of one view of a view file (filters, views). Sorting puts empty values last in
    ascending order and ends with the unique column, so that limits are determined."""
    view = next((v for v in spec.get("views", ()) if v.get("name") == name), None)
    if view is None:
        raise ViewError(f"no view {name!r}; there are {[v.get('name') for v in spec.get('views', ())]}")
    get = lambda p: _Reader(p, notes.columns, today).property(p)
    out = notes.filter(predicate(spec.get("filters"), notes.columns, today) & predicate(view.get("filters"), notes.columns, today))
    sort = [get(s["property"]).desc_nulls_last() if str(s.get("direction", "ASC")).upper() == "DESC" else get(s["property"]).asc_nulls_last() for s in view.get("sort", ())]
    out = out.orderBy(*sort, unique)
    if view.get("limit"):
        out = out.limit(int(view["limit"]))
    return out.select(*[get(p).alias(p.replace("file.", "file_")) for p in view.get("order") or ["file.path"]])


def view_names(text: str) -> list[str]:
    return [v.get("name", "") for v in ((yaml.safe_load(text) or {}).get("views") or [])]


def open_tasks(tasks: DataFrame, query: str) -> DataFrame:
    """A task search: `task-todo:""` with `path:"p"` alternatives joined by OR, and `-path:"p"` exclusions."""
    if not re.match(r'\s*\(?\s*task-todo:""', query):
        raise ViewError("only searches for open tasks are known")
    out = ~F.col("done")
    included = F.lit(False)
    any_in = False
    for sign, a, b in re.findall(r'(-?)path:(?:"([^"]*)"|(\S+?)(?=[\s)]|$))', query):
        hit = F.contains("file", F.lit(a or b))
        if sign:
            out = out & ~hit
        else:
            any_in, included = True, included | hit
    return tasks.filter(out & included if any_in else out)
