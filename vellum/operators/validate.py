"""Conformance of notes to the document format, and links that lead nowhere.

Every check gives rows (level, rule, rel, message). The rules of one note are one array
expression over its parsed columns; links are joined with the files that are there.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markdown as M
from ..functions import text as T
from ..sources.vault import RAW_ROOT, RESERVED, Vault, in_folder
from .staging import staged
from .views import view_names

LIFECYCLE = ("draft", "stable", "deprecated")
PLACEHOLDER = r"\{\{[^}]*\}\}"


def _get(key: str) -> Column:
    return F.try_element_at(F.filter("raw", lambda x: x["key"] == key), F.lit(1))


def _one(key: str) -> Column:
    return F.try_element_at(_get(key)["items"], F.lit(1))


def _has(key: str) -> Column:
    return F.exists("raw", lambda x: x["key"] == key)


def _when(cond: Column, level: str, rule: str, message: Column | str) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(level).alias("level"), F.lit(rule).alias("rule"), text.alias("message")))


def _instant(tag: Column, text: Column) -> Column:
    return (tag == "datetime") | ((tag == "str") & T.is_instant(text))


def format_findings(notes: DataFrame, templates: str | None = None) -> DataFrame:
    """level, rule, rel, message of the format's rules. notes: as a vault parses them."""
    rel, name = F.col("rel"), T.path_name(F.col("rel"))
    in_templates = in_folder(rel, templates)
    lines = F.filter(F.split("body", r"\R"), lambda x: x.startswith("## "))
    bad_days = F.filter(lines, lambda x: ~x.rlike(r"^## \d{4}-\d{2}-\d{2}\s*$"))
    keys = F.transform("raw", lambda x: x["key"])
    index, log, readable = name == "index.md", name == "log.md", F.col("valid")
    note = readable & ~name.isin(*RESERVED) & ~rel.isin(*RAW_ROOT)
    ok = note & F.col("has_fm")
    status, after, typ, desc, src = _one("status"), _one("stale_after"), _one("type"), _one("description"), _get("sources")
    event = lambda e: F.concat(F.when(e["field"] == "generated", "generated").otherwise("verified[]"))
    by_bad = F.filter("events", lambda e: e["ok"] & ~F.coalesce(e["by"].rlike(T.ACTOR), F.lit(False)))
    at_bad = F.filter("events", lambda e: e["ok"] & (e["at_tag"] != "null") & ~_instant(e["at_tag"], e["at"]))
    no_map = F.filter("events", lambda e: ~e["ok"])
    first = lambda arr, what: F.concat(event(arr[0]), F.lit(what))
    no_res = F.filter("sources", lambda s: ~s["ok"])
    bad_mod = F.filter("sources", lambda s: s["ok"] & s["has_modified"] & ~_instant(s["modified_tag"], s["modified"]))
    numbered = lambda arr, what: F.concat(F.lit("sources["), F.array_join(F.transform(arr, lambda s: s["no"].cast("string")), ","), F.lit("]" + what))
    rules = F.array(
        _when(~readable, "error", "DOC-01", "not valid UTF-8: every tool skips it; re-save it as UTF-8"),
        _when(readable & index & F.col("has_fm") & ((F.size(F.array_except(keys, F.array(F.lit("okf_version")))) > 0) | (rel != "index.md")), "error", "DOC-02", "index.md may only carry `okf_version`, and only at the root"),
        _when(readable & log & (F.size(bad_days) > 0), "error", "DOC-03", F.concat(F.lit("log.md date headings must be `## YYYY-MM-DD`; found "), F.array_join(F.slice(bad_days, 1, 2), ", "))),
        _when(readable & log & F.col("has_fm"), "error", "DOC-04", "log.md must not carry frontmatter"),
        _when(note & F.col("fm_error").isNotNull(), "error", "DOC-05", F.col("fm_error")),
        _when(note & F.col("fm_error").isNull() & ~F.col("has_fm"), "error", "DOC-06", "missing YAML frontmatter"),
        _when(ok & ~F.coalesce((typ["tag"] == "str") & (F.trim(typ["str"]) != ""), F.lit(False)), "error", "DOC-07", "`type` is required and must be a non-empty string"),
        _when(ok & ~in_templates & ~F.coalesce((desc["tag"] == "str") & (F.trim(desc["str"]) != ""), F.lit(False)), "warning", "DOC-08", "no `description`: views and snippets will be empty for this note"),
        _when(ok & _has("status") & (status["tag"] != "null") & ~status["str"].isin(*LIFECYCLE), "error", "DOC-09", F.concat(F.lit("`status` must be one of "), F.lit(", ".join(LIFECYCLE)), F.lit("; got "), status["str"])),
        _when(ok & (F.size(no_map) > 0), "error", "DOC-10", first(no_map, " must be a mapping with `by` (and optional `at`)")),
        _when(ok & (F.size(by_bad) > 0), "error", "DOC-10", first(by_bad, ".by must follow the actor convention")),
        _when(ok & ~in_templates & (F.size(at_bad) > 0), "error", "DOC-11", first(at_bad, ".at must be ISO-8601 with an explicit offset")),
        _when(ok & ~in_templates & _has("stale_after") & (after["tag"] != "null") & (after["str"] != "") & ~_instant(after["tag"], after["str"]), "error", "DOC-12", F.concat(F.lit("`stale_after` must be an ISO-8601 instant with offset; got "), after["str"])),
        _when(ok & _has("sources") & ~src["is_list"] & (_one("sources")["tag"] != "null"), "error", "DOC-13", "`sources` must be a list"),
        _when(ok & (F.size(no_res) > 0), "error", "DOC-13", numbered(no_res, " needs a `resource`")),
        _when(ok & (F.size(bad_mod) > 0), "error", "DOC-13", numbered(bad_mod, ".last_modified must be ISO-8601 with offset")),
        _when(ok & _has("timestamp"), "warning", "DOC-14", "`timestamp` is an old field: use `generated.at`"),
    )
    return notes.select("rel", F.explode(F.array_compact(rules)).alias("f")).select("f.level", "f.rule", "rel", "f.message")


def misplaced_days(notes: DataFrame, config: dict) -> DataFrame:
    """Day notes below the daily folder that the settings file elsewhere."""
    folder = M.daily_folder(config)
    rel = F.col("rel")
    day = F.try_to_date(F.regexp_extract(T.path_name(rel), r"^(\d{4}-\d{2}-\d{2})\.md$", 1), "yyyy-MM-dd")

    @F.pandas_udf("string")
    def expected(days):
        return days.map(lambda d: M.daily_path(config, d) if isinstance(d, dt.date) else None)

    out = notes.filter(F.col("valid") & F.lit(bool(folder)) & rel.startswith(folder + "/")).select("rel", day.alias("day")).filter("day is not null").distinct()
    out = out.withColumn("want", expected("day")).filter("rel <> want")
    return out.select(F.lit("warning").alias("level"), F.lit("DOC-15").alias("rule"), "rel", F.concat(F.lit("day note outside its folder: the settings file it at "), "want").alias("message"))


def _said(rule: str, message: Column) -> list[Column]:
    return [F.lit("error").alias("level"), F.lit(rule).alias("rule"), F.col("rel"), message.alias("message")]


def broken_links(notes: DataFrame, files: DataFrame, templates: str | None = None) -> DataFrame:
    """Markdown links, images and wikilinks (notes: rel, text) to nothing among the files (rel). Files are joined by sorting: as hash
    tables they would lie whole in every task."""
    body = T.strip_unrendered(F.col("text"))
    is_template = in_folder(F.col("rel"), templates)
    base = notes.select("rel", is_template.alias("is_template"), T.found(body, T.MD_LINK).alias("a"), T.found(body, T.MD_IMAGE).alias("b"), T.found(body, T.WIKILINK).alias("w"))
    free = ~F.col("is_template") | ~F.col("t").rlike(PLACEHOLDER)
    md = base.select("rel", "is_template", F.explode(F.concat("a", "b")).alias("t")).filter(free & ~T.is_external(F.col("t")))
    md = md.select("rel", T.unquoted(F.substring_index("t", "#", 1)).alias("t")).filter("t <> ''")
    at = F.when(F.col("t").startswith("/"), F.col("t")).otherwise(F.concat_ws("/", F.nullif(T.path_dir(F.col("rel")), F.lit("")), "t"))
    md = md.withColumn("path", T.collapsed(at))
    # a link may name a file or a folder on the way to one
    parts = F.split("rel", "/")
    places = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("path")).distinct()
    gone = md.filter("path <> ''").join(places.hint("merge"), "path", "left_anti").select(*_said("LNK-01", F.concat(F.lit("broken link -> "), "t")))
    wiki = base.select("rel", "is_template", F.explode("w").alias("t")).select("rel", "is_template", F.trim("t").alias("t")).filter(free)
    wiki = wiki.withColumn("key", F.regexp_replace(F.lower(T.path_name(F.col("t"))), r"\.md$", ""))
    own = files.select(F.explode(F.array(F.lower(T.path_stem(F.col("rel"))), F.lower(T.path_name(F.col("rel"))))).alias("key")).distinct()
    lost = wiki.join(own.hint("merge"), "key", "left_anti").select(*_said("LNK-02", F.concat(F.lit("broken wikilink [["), "t", F.lit("]]"))))
    return gone.unionByName(lost)


def broken_embeds(notes: DataFrame, bases: DataFrame) -> DataFrame:
    """Embedded view files and views (notes: rel, text) that are not there (bases: base, views)."""
    body = T.strip_unrendered(F.col("text"))
    embeds = notes.select("rel", F.explode(F.arrays_zip(T.found(body, T.BASE_EMBED).alias("base"), T.found(body, T.BASE_EMBED, 2).alias("view"))).alias("e"))
    embeds = embeds.select("rel", T.path_name(F.trim("e.base")).alias("base"), F.nullif(F.trim(F.coalesce("e.view", F.lit(""))), F.lit("")).alias("view"))
    none = embeds.join(bases, "base", "left_anti").select(*_said("LNK-03", F.concat(F.lit("embedded base not found: "), "base")))
    bad = embeds.filter("view is not null").join(bases, "base").filter(~F.array_contains("views", F.col("view")))
    return none.unionByName(bad.select(*_said("LNK-04", F.concat(F.lit("view '"), "view", F.lit("' not in "), "base"))))


def validate(vault: Vault) -> DataFrame:
    """All findings of format, day placement and links."""
    spark = vault.spark
    notes = staged(vault.notes(), "validated")
    folder, config_error = vault.template_folder()
    out = format_findings(notes, folder).unionByName(misplaced_days(notes, vault.config("daily-notes.json")))
    readable = notes.filter("valid")
    files = vault.files(content=False).select("rel")
    out = out.unionByName(broken_links(readable, files, folder))
    # view files are settings, read one by one
    rows, bad = [], [("error", "LNK-06", ".obsidian/templates.json", config_error)] if config_error else []
    for r in vault.files("*.base").select("rel", "content").toLocalIterator():
        try:
            rows.append((r["rel"].rpartition("/")[2], view_names(bytes(r["content"]).decode("utf-8-sig"))))
        except Exception as exc:  # broken YAML or bytes: the finding says which file
            bad.append(("error", "LNK-05", r["rel"], f"invalid view file: {exc}"))
    bases = spark.createDataFrame(rows, "base string, views array<string>")
    out = out.unionByName(broken_embeds(readable, bases))
    return out.unionByName(spark.createDataFrame(bad, "level string, rule string, rel string, message string"))


def passes(findings: DataFrame, ontology_findings: DataFrame | None = None, strict: bool = False) -> bool:
    """Whether a validation succeeds: conformance errors fail it; strictly, links, warnings and
    the ontology's errors and warnings do, too."""
    hard = F.lit(True) if strict else (F.col("level") == "error") & F.col("rule").startswith("DOC")
    if not findings.filter(hard).isEmpty():
        return False
    return not strict or ontology_findings is None or ontology_findings.filter(F.col("level").isin("error", "warning")).isEmpty()


def index_text(notes: DataFrame, title: str = "Vault index", version: str = "0.2") -> str:
    """The index note: an entry for each note, by top folder."""
    name = T.path_name(F.col("rel"))
    keep = notes.filter(F.col("valid") & ~name.isin(*RESERVED) & ~F.col("rel").isin(*RAW_ROOT))
    shown = keep.select(section().alias("section"), "rel", index_entry(title_or_stem(), F.col("rel"), F.when(_one("description")["tag"] == "str", F.trim(_one("description")["str"]))).alias("entry"))
    out = ["---", f'okf_version: "{version}"', "---", "", f"# {title}", "", "One entry per concept, grouped by directory, with each note's `description`.", ""]
    at = None
    for r in shown.orderBy("section", "rel").toLocalIterator():
        if r["section"] != at:
            out += [*([""] if at is not None else []), f"# {r['section']}", ""]
            at = r["section"]
        out.append(r["entry"])
    return "\n".join(out).rstrip() + "\n"


def title_or_stem() -> Column:
    return F.when(_one("title")["tag"] == "str", _one("title")["str"]).otherwise(T.path_stem(F.col("rel")))


def section() -> Column:
    return F.when(F.contains("rel", F.lit("/")), F.substring_index("rel", "/", 1)).otherwise("(root)")


def index_entry(title: Column, rel: Column, description: Column) -> Column:
    return F.concat(F.lit("* ["), title, F.lit("]("), rel, F.lit(")"), F.when(F.coalesce(description, F.lit("")) != "", F.concat(F.lit(" - "), description)).otherwise(""))


def index(entries: DataFrame) -> DataFrame:
    """section, rel, entry: the entries in the order of an index, sections and paths rising."""
    return entries.select("section", "rel", "entry").orderBy("section", "rel")
