"""Fill-in-the-middle transformation by big-integer bit-parallelism.

A text's bytes become masks, one bit a byte, the first byte lowest: bytes.translate names the
classes and int(..., 2) packs them. Shifted boolean operations on whole masks mark where units
begin and where a sentinel stands, bit_count gives the number of units, and the byte at which unit
number k begins is found by recursive halving: the lower half's bit count tells which half holds
the k-th bit, so that all halves together are as long as the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table, text_steps, tidy

#: Sentinels before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Of a hundred documents so many stay plain; of a hundred others so many have the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
#: Bits at which halving ends and bits are looked at in order.
WORD = 64


def class_table(members: bytes) -> bytes:
    """For bytes.translate: `1` for the members, `0` for all other bytes."""
    return bytes(49 if b in members else 48 for b in range(256))


#: Bytes 80 to BF continue a character of UTF-8; all others begin one.
BEGINS = class_table(bytes([*range(0x80), *range(0xC0, 256)]))
SPACE = class_table(b" \t\n\v\f\r")
NEWLINE = class_table(b"\n")


def mask(text: bytes, members: bytes) -> int:
    """Bit i says whether byte i is in the class."""
    return int(text[::-1].translate(members), 2) if text else 0


def characters(text: bytes) -> int:
    """Where characters begin. Bytes that continue none, at the front, belong to the first."""
    return mask(text, BEGINS) | bool(text)


def words(text: bytes) -> int:
    """Where words begin, each with the white space after it; white space in front goes to the first."""
    space = mask(text, SPACE)
    begin = ~space & (space << 1 | 1) & ((1 << len(text)) - 1)
    if space & 1:
        begin &= begin - 1  # the first word begins with the text
    return begin | bool(text)


def lines(text: bytes) -> int:
    """Where lines begin, each with its line end."""
    return (mask(text, NEWLINE) << 1 | 1) & ((1 << len(text)) - 1)


UNITS = {"character": characters, "word": words, "line": lines}


def holds(text: bytes, sentinel: bytes) -> bool:
    """Whether the sentinel stands anywhere: a shifted conjunction of its bytes' masks."""
    if not all(s in text for s in set(sentinel[i : i + 1] for i in range(len(sentinel)))):
        return False
    here = -1
    for i, byte in enumerate(sentinel):
        here &= mask(text, class_table(bytes([byte]))) >> i
        if not here:
            return False
    return True


def select(marks: int, k: int, width: int) -> int:
    """The position of the k-th set bit, from 0; width, the number of bits, if there are only k."""
    if k >= marks.bit_count():
        return width
    base, size = 0, width
    while size > WORD:
        half = size >> 1
        low = marks & ((1 << half) - 1)
        n = low.bit_count()
        if k < n:
            marks, size = low, half
        else:
            marks, base, size, k = marks >> half, base + half, size - half, k - n
    for _ in range(k):
        marks &= marks - 1
    return base + (marks & -marks).bit_length() - 1


def cut(text: bytes, h1: int, h2: int, unit: str = "character") -> tuple[int, int, int, int, int]:
    """n units, those of prefix and middle, and the bytes at which prefix and middle end."""
    marks = UNITS[unit](text)
    n = marks.bit_count()
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    first = select(marks, a, len(text))
    return n, a, b - a, first, select(marks, b, len(text)) if b > a else first


def transform(
    df: DataFrame, unit: str = "character", seed: int = 1, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST, sentinels: tuple[str, str, str] = SENTINELS, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (units), output: one row per row, no shuffle.

    The first four 32-bit numbers of sha256("<seed>:<doc_id>") decide: the prefix ends after the
    smaller of h1 % (n + 1) and h2 % (n + 1) units, the middle after the larger. The form is plain
    if the text is empty (null counts as empty), holds a sentinel, or h3 % 100 is among the last
    `plain`; else spm if h4 % 100 < suffix_first; else psm. A null doc_id counts as empty text, so repeated
    rows and rows without an id are cut alike. Bytes that are no UTF-8 stay as they are: a unit begins at every byte that
    does not continue a character. Whole texts are taken, in memory of a few times one text. Other columns
    are ignored and cannot clash; an empty table gives an empty result.
    """
    src = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("key"), F.col(text).cast("binary").alias("text"))
    prefix, suffix, middle = marks = tuple(s.encode() for s in sentinels)
    if not all(marks) or len({m[:1] for m in marks}) > 1 or any(marks[0][:1] in m[1:] for m in marks):
        raise ValueError("sentinels begin with one byte that occurs nowhere else in them")

    def one(key: str, body: bytes) -> tuple:
        h = hashlib.sha256(f"{seed}:{key}".encode()).digest()
        h1, h2, h3, h4 = (int.from_bytes(h[i : i + 4], "big") for i in (0, 4, 8, 12))
        n, a, m, p, q = cut(body, h1, h2, unit)
        if not body or h3 % 100 >= 100 - plain or any(holds(body, s) for s in marks):
            return n, "plain", None, None, body
        if h4 % 100 < suffix_first:
            return n, "spm", a, m, b"".join((suffix, body[q:], prefix, body[:p], middle, body[p:q]))
        return n, "psm", a, m, b"".join((prefix, body[:p], suffix, body[q:], middle, body[p:q]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        for batch in text_steps(batches):
            rows = [one(k, t or b"") for k, t in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            cols = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    out = src.mapInArrow(tidy(run), f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text behind an output: its parts, between the sentinels, put in order again. A text
    that holds a sentinel is plain, and none can arise where a part meets a sentinel, so every
    sentinel stands once."""
    prefix, suffix, middle = sentinels
    upto, after = (lambda c, s: F.substring_index(c, s, 1)), (lambda c, s: F.substring_index(c, s, -1))
    head, mid = upto(output, middle), after(output, middle)
    psm = F.concat(upto(after(head, prefix), suffix), mid, after(head, suffix))
    spm = F.concat(after(head, prefix), mid, upto(after(head, suffix), prefix))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-the-middle over `documents`: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    out = transform(table(spark, sf_dir, "documents", "doc_id", "text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP13_SQL = """
with h as (select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(doc_id::varchar, '')) as x from documents),
g as (select doc_id, text, length(text)::bigint as n, [('0x' || substr(x, 8 * i + 1, 8))::bigint for i in range(4)] as h from h),
c as (select doc_id, text, n, least(h[1] % (n + 1), h[2] % (n + 1)) as a, greatest(h[1] % (n + 1), h[2] % (n + 1)) as b,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h[3] % 100 >= 90 then 'plain' when h[4] % 100 < 20 then 'spm' else 'psm' end as form from g),
p as (select *, substr(text, 1, a) as prefix, substr(text, a + 1, b - a) as middle, substr(text, b + 1) as suffix from c)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(prefix || middle || suffix) as restored_sha256
from p"""
