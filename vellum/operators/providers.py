"""What an engine may be given from outside: search providers and language models.

A provider says why it cannot be used, or answers. The choice falls by an explicit name, the
environment, the vault's settings, and otherwise to the first that is available; the plain
search over the files always is.
"""

from __future__ import annotations

import json
import os
import re
import urllib.request
from collections.abc import Callable, Mapping, Sequence
from pathlib import Path
from typing import Protocol

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.vault import Vault
from . import search

Complete = Callable[[list[dict[str, str]]], str]


class SearchProvider(Protocol):
    name: str

    def available(self) -> str | None:
        """Why it cannot be used; None if it can."""

    def query(self, question: str, n: int) -> DataFrame:
        """file, title, snippet, score of up to n hits."""


class KeywordProvider:
    """Term counts over the notes: needs nothing."""

    name = "naive"

    def __init__(self, notes: DataFrame, order: Sequence[str]):
        self.notes, self.order = notes, order

    def available(self) -> str | None:
        return None

    def query(self, question: str, n: int) -> DataFrame:
        return search.keyword_search(self.notes, question, n, self.order)


class RankedProvider:
    """BM25 over the notes; with vectors and an embedding function, fused with their cosine ranks."""

    name = "ranked"

    def __init__(self, notes: DataFrame, vectors: DataFrame | None = None, embed: Callable[[str], Sequence[float]] | None = None):
        self.notes, self.vectors, self.embed = notes, vectors, embed

    def available(self) -> str | None:
        return None if (self.vectors is None) == (self.embed is None) else "vectors and an embedding function come together"

    def query(self, question: str, n: int) -> DataFrame:
        terms = search.query_terms(question)
        if not terms:
            return self.notes.select("file", "title", F.lit("").alias("snippet"), F.lit(0.0).alias("score")).limit(0)
        lists = [search.top(search.bm25(self.notes.select(F.col("file").alias("id"), F.col("body").alias("text")), terms), 10 * n)]
        if self.vectors is not None:
            lists.append(search.top(search.cosine(self.vectors, self.embed(question)), 10 * n))
        best = search.fused(lists, n)
        return self.notes.join(best, self.notes["file"] == best["id"]).select("file", "title", F.substring("body", 1, 400).alias("snippet"), "score").orderBy(F.col("score").desc(), "file")


def own_settings(vault: Vault) -> dict:
    """The vault's own settings; {} where they are missing or broken."""
    try:
        data = yaml.safe_load(vault.text_of(".vellum/config.yml") or "")
    except yaml.YAMLError:
        return {}
    return data if isinstance(data, dict) else {}


def choice(slot: str, explicit: str | None, config: Mapping, env: Mapping[str, str] | None = None) -> str:
    """The wanted provider of a slot: explicit, then VELLUM_<SLOT>_PROVIDER, then the settings, else auto."""
    providers = config.get("providers")
    named = providers.get(slot) if isinstance(providers, Mapping) else None
    return explicit or (os.environ if env is None else env).get(f"VELLUM_{slot.upper()}_PROVIDER") or (str(named) if named else "auto")


def chosen(providers: Sequence[SearchProvider], want: str = "auto") -> SearchProvider:
    """The named provider, or the first that is available."""
    if want != "auto":
        found = next((p for p in providers if p.name == want), None)
        if found is None:
            raise ValueError(f"no provider {want!r}; there are {[p.name for p in providers]}")
        if why := found.available():
            raise ValueError(f"{want} cannot be used: {why}")
        return found
    return next(p for p in providers if p.available() is None)


def hits(providers: Sequence[SearchProvider], question: str, n: int, want: str = "auto") -> DataFrame:
    """The chosen provider's hits; if it finds none, those of the last, which needs nothing."""
    out = search.without_addresses(chosen(providers, want).query(question, n))
    return search.without_addresses(providers[-1].query(question, n)) if out.isEmpty() else out


def status(providers: Sequence[SearchProvider], want: str) -> list[tuple[str, str]]:
    """(provider, state) for each: why it cannot be used, ready, or chosen."""
    own = chosen(providers, want).name
    return [(p.name, p.available() or ("chosen" if p.name == own else "ready")) for p in providers]


def collection_name(root: str, home: str | None = None) -> str:
    """A name that tells vaults apart: the folder's, with its parent's unless that is the home."""
    path = Path(root)
    parent = "" if home and path.parent == Path(home) else path.parent.name
    return re.sub("[^a-z0-9]+", "-", "-".join(filter(None, (parent, path.name))).lower()).strip("-") or "vault"


def structured(text: str, complete: Complete) -> dict[str, list[str]]:
    """Actions, decisions and outcomes that a language model reads out of a recap. What is not
    the JSON asked for counts as nothing found."""
    ask = 'Give JSON with the lists "actions", "decisions" and "outcomes" of this recap, and nothing else.'
    m = re.search(r"\{.*\}", complete([{"role": "system", "content": ask}, {"role": "user", "content": text}]) or "", re.S)
    try:
        data = json.loads(m[0]) if m else {}
    except json.JSONDecodeError:
        data = {}
    pick = lambda k: [str(x) for x in data.get(k, ()) if str(x).strip()] if isinstance(data.get(k), list) else []
    return {k: pick(k) for k in ("actions", "decisions", "outcomes")} if isinstance(data, dict) else {}


def recall(found: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """query, hit: whether an expected file (query, file) is among the first k found (query, file, rank)."""
    first = found.filter(F.col("rank") <= k).select("query", "file", F.lit(1).alias("one"))
    return expected.join(first, ["query", "file"], "left").groupBy("query").agg((F.count("one") > 0).alias("hit"))


# ---- language models ---------------------------------------------------------------------

#: Tokens of an answer, tokens that a model may think before it, seconds of waiting.
ANSWER, HEADROOM, WAIT = 800, 512, 180


def whole_number(name: str, default: int, env: Mapping[str, str] | None = None) -> int:
    """An environment variable that holds a number of 0 or more; anything else counts as the default."""
    text = (os.environ if env is None else env).get(name, "").strip()
    return int(text) if text.isdecimal() else default


class NoEndpoint(RuntimeError):
    """No language model answers."""


def endpoint(base_url: str, model: str | None = None, env: Mapping[str, str] | None = None) -> Complete:
    """A completion over HTTP, for servers that take chat completions as JSON. VELLUM_LLM_REASONING_TOKENS and VELLUM_LLM_TIMEOUT set
    the tokens on top of the answer's and the seconds to wait."""
    most = ANSWER + whole_number("VELLUM_LLM_REASONING_TOKENS", HEADROOM, env)
    wait = whole_number("VELLUM_LLM_TIMEOUT", WAIT, env) or WAIT

    def complete(messages: list[dict[str, str]]) -> str:
        body = {"messages": messages, "max_tokens": most} | ({"model": model} if model else {})
        ask = urllib.request.Request(base_url.rstrip("/") + "/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(ask, timeout=wait) as got:
                choice = json.load(got)["choices"][0]
        except (OSError, ValueError, LookupError, TypeError) as exc:
            raise NoEndpoint(f"{base_url}: {exc}") from exc
        text = (choice.get("message") or {}).get("content") or ""
        if not text and choice.get("finish_reason") == "length":
            raise NoEndpoint(f"{base_url}: the answer was cut before it began; raise VELLUM_LLM_REASONING_TOKENS")
        return text

    return complete


def model_state(base_url: str, wait: float = 3.0) -> str:
    """active, or why no model can be asked there."""
    try:
        with urllib.request.urlopen(base_url.rstrip("/") + "/models", timeout=wait) as got:
            got.read(1)
    except (OSError, ValueError) as exc:
        return f"not reachable: {exc}"
    return f"active: {base_url}"


def slots(providers: Sequence[SearchProvider], want: str, base_url: str) -> list[tuple[str, str, str]]:
    """(slot, provider, state) of every slot. A choice that cannot be met is a row, too."""
    try:
        rows = [("search", name, state) for name, state in status(providers, want)]
    except ValueError as exc:
        rows = [("search", want, str(exc))] + [("search", p.name, p.available() or "ready") for p in providers]
    return [*rows, ("llm", "http", model_state(base_url)), ("graph", "builtin", "active")]
