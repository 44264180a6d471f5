"""Text functions as column expressions; everything here runs inside the JVM.

Patterns are Java's: (?U) makes the classes Unicode-aware. Unless a function says
otherwise, null gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The link and markup syntax that notes are written in.
MD_LINK = r'(?<!!)\[[^\]]*\]\(([^)\s]+)(?:\s+"[^"]*")?\)'
MD_IMAGE = r"!\[[^\]]*\]\(([^)\s]+)\)"
WIKILINK = r"(?<!!)\[\[([^\]|#]+)(?:#[^\]|]*)?(?:\|[^\]]*)?\]\]"
BASE_EMBED = r"!\[\[([^\]#|]+\.base)(?:#([^\]|]+))?(?:\|[^\]]*)?\]\]"
FOOTNOTE = r"\[\^([^\]]+)\](?!:)"
LINK_VALUE = r"^\s*\[([^\]]*)\]\(([^)\s]+)\)\s*$"
WIKI_VALUE = r"^\s*\[\[([^\]|#]+)(?:#[^\]|]*)?(?:\|[^\]]*)?\]\]\s*$"
FRONTMATTER = r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n?"
ISO_INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
ACTOR = r"^(human:\S+|process:\S+|[^/\s]+/[^\s]+)$"
EXTERNAL = ("http://", "https://", "mailto:", "#", "obsidian://")


def has_frontmatter(text: Column) -> Column:
    return F.regexp_like(text, F.lit(FRONTMATTER))


def frontmatter(text: Column) -> Column:
    """The raw block between the fences; null without one."""
    return F.when(has_frontmatter(text), F.regexp_extract(text, FRONTMATTER, 1))


def body(text: Column) -> Column:
    """What follows the block."""
    return F.regexp_replace(text, FRONTMATTER, "")


def strip_unrendered(text: Column) -> Column:
    """Without what a reader never sees: code fences, code spans, HTML comments, %% comments, in this order."""
    for pattern in (r"(?s)```.*?```", r"`[^`\n]*`", r"(?s)<!--.*?-->", r"(?s)%%.*?%%"):
        text = F.regexp_replace(text, pattern, "")
    return text


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """All matches of a pattern's group, in order."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def is_external(target: Column) -> Column:
    out = F.lit(False)
    for prefix in EXTERNAL:
        out = out | target.startswith(prefix)
    return out


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def name_key(text: Column) -> Column:
    """The form in which names are compared: without `(example)`, lower case, hyphens kept,
    other punctuation as spaces, spaces squeezed."""
    return squeezed(F.regexp_replace(F.lower(F.regexp_replace(text, r"(?i)\(example\)", "")), r"(?U)[^\w\s-]", " "))


def task_key(text: Column) -> Column:
    """The form in which task texts are compared."""
    return squeezed(F.regexp_replace(F.replace(F.lower(text), F.lit("(?)"), F.lit("")), r"(?U)[^\w\s]", " "))


def slug(text: Column, most: int = 60) -> Column:
    """ASCII letters and digits joined by single hyphens, at most `most` characters; `note` if nothing is left."""
    s = F.lower(F.trim(F.regexp_replace(text, r"(?i)\(example\)", "")))
    s = F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    s = F.regexp_replace(F.substring(s, 1, most), "-+$", "")
    return F.when(s == "", "note").otherwise(s)


def one_line(text: Column) -> Column:
    return squeezed(text)


def unquoted(text: Column) -> Column:
    """Percent-decoded; a plus sign stays one. Undecodable text stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def quoted(text: Column, safe: str = "/") -> Column:
    """Percent-encoded as URIs want it; letters, digits, `_.-~` and the safe characters stay."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), *((f"%{ord(c):02X}", c) for c in safe)):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def path_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def path_stem(path: Column) -> Column:
    """The last part without its suffix; a leading dot starts no suffix."""
    return F.regexp_replace(path_name(path), r"(?<=.)\.[^.]*$", "")


def path_dir(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def collapsed(path: Column) -> Column:
    """Without empty and `.` parts; `..` takes the part before it, and is dropped at the top."""
    parts = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, p: F.when((p == "") | (p == "."), acc).when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p)),
    )
    return F.array_join(parts, "/")


def relative(source: Column, target: Column) -> Column:
    """The path that leads from one file of a tree to another."""
    src = F.filter(F.split(path_dir(source), "/"), lambda p: p != "")
    dst = F.split(target, "/")
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("on"))
    same = F.aggregate(
        F.arrays_zip(src.alias("a"), dst.alias("b")),
        start,
        lambda acc, p: F.when(acc["on"] & p["a"].eqNullSafe(p["b"]), F.struct((acc["n"] + 1).alias("n"), F.lit(True).alias("on"))).otherwise(F.struct(acc["n"].alias("n"), F.lit(False).alias("on"))),
        lambda acc: acc["n"],
    )
    ups = F.array_repeat(F.lit(".."), F.size(src) - same)
    return F.array_join(F.concat(ups, F.slice(dst, same + 1, F.size(dst))), "/")


def link_target(cell: Column) -> Column:
    """Target of a cell's first markdown link: angle brackets or plain, decoded, no fragment; null without one."""
    pattern = r'\[[^\]]*\]\(\s*(?:<([^>]*)>|([^)]*?))(?:\s+"[^"]*")?\s*\)'
    raw = F.concat(F.regexp_extract(cell, pattern, 1), F.regexp_extract(cell, pattern, 2))
    return F.nullif(F.trim(unquoted(F.substring_index(raw, "#", 1))), F.lit(""))


def row_cells(line: Column) -> Column:
    """Cells of a table row, split at unescaped bars; empty array if the line is none."""
    inner = F.regexp_extract(line, r"^\|(.+)\|\s*$", 1)
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: F.trim(c)))


def hit_path(file: Column) -> Column:
    """The path in a search hit's address (scheme://collection/path?index=name)."""
    return F.when(file.startswith("qmd://"), F.regexp_extract(file, r"^qmd://[^/]*/([^?]*)", 1)).otherwise(file)


def is_instant(text: Column) -> Column:
    """ISO instant with an explicit offset."""
    return F.coalesce(text.rlike(ISO_INSTANT), F.lit(False))


def is_day(text: Column) -> Column:
    """Shaped like a date; the calendar is not asked."""
    return F.coalesce(text.rlike(ISO_DATE), F.lit(False))


def due_date(text: Column) -> Column:
    """The date of a due string; null for what is no date."""
    return F.when(is_day(text), F.try_to_date(text, "yyyy-MM-dd"))


def occurrences(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences of a term that is not empty."""
    return ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("long")


def milestone(text: Column, due: Column) -> Column:
    """Milestone and due date, whichever there are, with a space between."""
    return F.concat_ws(" ", F.nullif(F.trim(F.coalesce(text, F.lit(""))), F.lit("")), F.nullif(F.coalesce(due, F.lit("")), F.lit("")))


def action_line(text: Column, owner: Column, due: Column) -> Column:
    """An open task line: `- [ ] text — owner, due d`."""
    head = F.concat(F.lit("- [ ] "), F.regexp_replace(F.trim(text), r"\.+$", ""))
    meta = F.concat_ws(", ", F.nullif(owner, F.lit("")), F.concat(F.lit("due "), F.nullif(due, F.lit(""))))
    return F.when(meta == "", head).otherwise(F.concat(head, F.lit(" — "), meta))


def first_sentence(text: Column, most: int = 160) -> Column:
    """The first sentence of more than 20 characters, cut to `most`, its final dots off; else null."""
    sentences = F.filter(F.transform(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda c: F.trim(c)), lambda s: F.length(s) > 20)
    return F.regexp_replace(F.substring(F.try_element_at(sentences, F.lit(1)), 1, most), r"\.+$", "")


def looks_unparsed(text: Column) -> Column:
    """A text that opens a block which was not read as frontmatter."""
    return text.rlike("^[﻿ \\t\\r\\n]*---")


def scrubbed_urls(text: Column) -> Column:
    """URLs without what identifies a site: only scheme and port of any but loopback addresses stay."""
    safe = r"(?i:localhost|127\.0\.0\.1|\[::1\])"
    url = r"(?<![\w.])([A-Za-z][A-Za-z0-9+.-]*://)(?:[^\s/@]*@)?(?!" + safe + r"(?::\d+)?(?:[/\s]|$))[^\s/:]+(:\d+)?"
    text = F.regexp_replace(text, url + r"/[^\s]*", "$1<host>$2/<path>")
    return F.regexp_replace(text, url + r"(?=[\s,;)\]\"']|$)", "$1<host>$2")
