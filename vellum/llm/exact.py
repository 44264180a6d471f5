"""Exact deduplication by Patricia-trie owners.

Each scan task inserts its texts, white space deleted, into a compressed radix trie and so hands on
one row for each text that it met, however many copies there were. Length and content hash deal these rows
to owners, which insert the full byte strings into tries of their own: texts are equal when they end in
one terminal node, and never because hashes agree. Terminals keep the best row so far and the numbers of
the rows that ended there. A trie that outgrows its memory gives up its heaviest subtree: a scan task hands
the subtree's rows on, an owner leaves them to another round with twice the owners.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import join_many, parts, release, staged, table, text_steps, tidy

#: Characters that count for nothing.
BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bytes that continue a character of UTF-8.
CONTINUES = bytes(range(0x80, 0xC0))
#: Bytes of texts and nodes that a trie holds, and that an owner is dealt on average.
TRIE_BYTES, OWNER_BYTES, NODE_BYTES = 64 << 20, 16 << 20, 400
#: Rows of one text that an owner takes; more are first merged in so many groups of that many.
COPIES = 4096


class Leaf:
    """A terminal: the text, its hash, the best row so far, the rows that ended here."""

    __slots__ = ("best", "hash", "last", "members", "n", "text")

    def __init__(self, text: bytes):
        self.text, self.best, self.members, self.n, self.hash, self.last = text, None, [], 0, None, True

    def add(self, best: tuple, n: int) -> None:
        """best: least tuple wins."""
        self.n += n
        if self.best is None or best < self.best:
            self.best = best


class Branch:
    """An inner node: the offset at which the texts below part, and a child for each byte there (-1: the text's end)."""

    __slots__ = ("at", "held", "kids")

    def __init__(self, at: int):
        self.at, self.kids, self.held = at, {}, 0


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by comparisons of slices that double and then halve."""
    most = min(len(a), len(b))
    lo, step = 0, 32
    while lo < most and a[lo : lo + step] == b[lo : lo + step]:
        lo, step = lo + step, step * 2
    if lo >= most:
        return most
    hi = min(lo + step, most)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class Trie:
    """A Patricia trie over byte strings: inner nodes hold offsets, terminals whole strings, and so
    a search looks at one byte an inner node and compares one string at the end."""

    def __init__(self):
        self.root: Branch | Leaf | None = None
        self.held = 0

    def leaf(self, text: bytes) -> Leaf:
        """The terminal of a text, made if there is none."""
        node = self.root
        while isinstance(node, Branch):
            kids = node.kids
            node = kids.get(text[node.at] if node.at < len(text) else -1) or next(iter(kids.values()))
        if node is None:
            self.root = out = Leaf(text)
            self.held = len(text) + NODE_BYTES
            return out
        if node.text == text:
            return node
        at = _common(node.text, text)
        byte = lambda t: t[at] if at < len(t) else -1
        out, size, old = Leaf(text), len(text) + NODE_BYTES, byte(node.text)
        above, node = None, self.root
        while isinstance(node, Branch) and node.at < at:
            node.held += size
            above, node = node, node.kids[text[node.at]]
        if not (isinstance(node, Branch) and node.at == at):
            fork = Branch(at)
            fork.kids[old] = node
            fork.held = node.held if isinstance(node, Branch) else len(node.text) + NODE_BYTES
            if above is None:
                self.root = fork
            else:
                above.kids[text[above.at]] = fork
            node = fork
        node.kids[byte(text)] = out
        node.held += size
        self.held += size
        return out

    def heaviest(self) -> list[Leaf]:
        """Takes out the heaviest subtree under the root, or below while one child holds over half
        of what its node holds."""
        if not isinstance(self.root, Branch):
            return self.take()
        weigh = lambda x: x.held if isinstance(x, Branch) else len(x.text) + NODE_BYTES
        path, node = [], self.root
        while True:
            key = max(node.kids, key=lambda k: weigh(node.kids[k]))  # noqa: B023
            path.append((node, key))
            child = node.kids[key]
            if not isinstance(child, Branch) or 2 * child.held <= self.held:
                break
            node = child
        size = weigh(child)
        for node, _ in path:
            node.held -= size
        self.held -= size
        while path:
            node, key = path.pop()
            del node.kids[key]
            if node.kids:
                break
        else:
            self.root = None
        return list(leaves(child))

    def take(self) -> list[Leaf]:
        """Takes out everything."""
        out, self.root, self.held = list(leaves(self.root)), None, 0
        return out


def leaves(node: Branch | Leaf | None) -> Iterator[Leaf]:
    todo = [] if node is None else [node]
    while todo:
        node = todo.pop()
        if isinstance(node, Leaf):
            yield node
        else:
            todo.extend(node.kids.values())


def _batches(rows: Iterator[tuple], schema: pa.Schema, text: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded bytes. text: the position of the text column."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 100 + len(row[text] or b"")
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _scan(src: DataFrame, keep: Sequence[str], budget: int) -> DataFrame:
    """Two kinds of rows: for each row of the source row, node, doc_id and the kept columns; for each terminal node,
    size, h, text, sha, cp, row0, id0 (the best row's), n."""
    like = src.schema
    kind = like["doc_id"].dataType.simpleString()
    extra = [f"k{i}" for i in range(len(keep))]
    cols = ["row", "node", "doc_id", *extra, "size", "h", "text", "sha", "cp", "row0", "id0", "n"]
    ddl = f"row long, node long, doc_id {kind}, " + "".join(f"{c} {like[c].dataType.simpleString()}, " for c in extra) + f"size long, h long, text binary, sha binary, cp long, row0 long, id0 {kind}, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        tail = types = None

        def told(found: list[Leaf]) -> Iterator[pa.RecordBatch]:
            def rows():
                for leaf in found:
                    sha = hashlib.sha256(leaf.text).digest()
                    cp, _, i, row = leaf.best
                    yield (leaf.members[0], len(leaf.text), int.from_bytes(sha[:8], "big", signed=True), leaf.text, sha, -cp, row, i, leaf.n)

            for part in _batches(rows(), tail, 3):
                at = dict(zip(tail.names, part.columns, strict=True))
                yield pa.RecordBatch.from_arrays([at[c] if c in at else pa.nulls(part.num_rows, types[c]) for c in cols], names=cols)

        for batch in text_steps(batches):
            if tail is None:
                own = {c: batch.schema.field(c).type for c in ("doc_id", *extra)}
                i64 = pa.int64()
                types = {"row": i64, "node": i64, **own, "size": i64, "h": i64, "text": pa.binary(), "sha": pa.binary(), "cp": i64, "row0": i64, "id0": own["doc_id"], "n": i64}
                tail = pa.schema([(c, types[c]) for c in ("node", "size", "h", "text", "sha", "cp", "row0", "id0", "n")])
            nodes = []
            for row, i, body in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                body = body or b""
                leaf = trie.leaf(body.translate(None, BLANK))
                if not leaf.members:
                    leaf.members.append(row)
                leaf.add((-len(body.translate(None, CONTINUES)), i is None, i, row), 1)
                nodes.append(leaf.members[0])
                if trie.held > budget:
                    while 4 * trie.held > 3 * budget:
                        yield from told(trie.heaviest())
            at = {"row": batch.column("row"), "node": pa.array(nodes, pa.int64()), "doc_id": batch.column("doc_id"), **{c: batch.column(c) for c in extra}}
            yield pa.RecordBatch.from_arrays([at[c] if c in at else pa.nulls(batch.num_rows, types[c]) for c in cols], names=cols)
        yield from told(trie.take())

    return src.mapInArrow(tidy(run), ddl)


def _owners(texts: DataFrame, budget: int) -> DataFrame:
    """Of texts dealt to owners (node, size, h, text, sha, cp, row0, id0, n, last): for each node, the group's sha, cp,
    row0, id0 and n where its group is whole; where it is not (last is false, or the subtree was given up), `up`, the
    node that stands for it, and for that node itself once more a row for the next round, with text and partial figures."""
    kind = texts.schema["id0"].dataType.simpleString()
    names = ["node", "up", "size", "h", "text", "sha", "cp", "row0", "id0", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, given = Trie(), set()
        schema = None

        def told(found: list[Leaf], whole: bool) -> Iterator[pa.RecordBatch]:
            def rows():
                for leaf in found:
                    size, h, sha = leaf.hash
                    cp, _, i, row = leaf.best
                    if whole and leaf.last and (size, h) not in given:
                        for node in leaf.members:
                            yield (node, None, None, None, None, sha, -cp, row, i, leaf.n)
                    else:
                        given.add((size, h))
                        up = leaf.members[0]
                        yield (up, None, size, h, leaf.text, sha, -cp, row, i, leaf.n)
                        for node in leaf.members:
                            yield (node, up, None, None, None, None, None, None, None, None)

            yield from _batches(rows(), schema, 4)

        for batch in text_steps(batches):
            if schema is None:
                i64 = pa.int64()
                schema = pa.schema([("node", i64), ("up", i64), ("size", i64), ("h", i64), ("text", pa.binary()), ("sha", pa.binary()), ("cp", i64), ("row0", i64), ("id0", batch.schema.field("id0").type), ("n", i64)])
            for node, size, h, text, sha, cp, row, i, n, last in zip(*[batch.column(c).to_pylist() for c in ("node", "size", "h", "text", "sha", "cp", "row0", "id0", "n", "last")], strict=True):
                leaf = trie.leaf(text)
                leaf.hash = (size, h, sha)
                leaf.last = last
                leaf.members.append(node)
                leaf.add((-cp, i is None, i, row), n)
                if trie.held > budget and isinstance(trie.root, Branch):
                    while 4 * trie.held > 3 * budget and isinstance(trie.root, Branch):
                        yield from told(trie.heaviest(), False)
        yield from told(trie.take(), True)

    ddl = f"node long, up long, size long, h long, text binary, sha binary, cp long, row0 long, id0 {kind}, n long"
    return texts.mapInArrow(tidy(run), ddl).select(*names)


def _resolved(texts: DataFrame, owners: int, owner_bytes: int, budget: int, copies: int) -> DataFrame:
    """node, sha, row0, id0, n of every node's whole group."""
    n, held = texts.agg(F.count(F.lit(1)), F.sum(F.col("size") + NODE_BYTES)).first()
    owners = max(owners, -(-(held or 0) // owner_bytes))
    each = texts.groupBy("size", "h").agg(F.count(F.lit(1)).alias("c"))
    crowded = n > copies and (each.agg(F.max("c")).first()[0] or 0) > copies
    if crowded:
        each = staged(each.withColumn("salts", F.ceil(F.col("c") / copies)), "exact-copies")
        texts = join_many(texts, each, ["size", "h"], "c")
    salts = F.col("salts") if crowded else F.lit(1).cast("long")
    texts = texts.withColumn("last", salts == 1).withColumn("salt", F.pmod(F.xxhash64("node"), salts))
    dealt = texts.repartition(owners, "size", "h", "salt").select("node", "size", "h", "text", "sha", "cp", "row0", "id0", "n", "last")
    out = staged(_owners(dealt, budget), "exact-owners")
    if crowded:
        release(each)
    info = ["node", "sha", "row0", "id0", "n"]
    whole = out.filter("up is null and text is null").select(*info)
    more = out.filter("text is not null").select("node", "size", "h", "text", "sha", "cp", "row0", "id0", "n")
    if more.isEmpty():
        return whole
    above = _resolved(more, 2 * owners, owner_bytes, budget, copies).withColumnRenamed("node", "up")
    return whole.unionByName(out.filter("up is not null").select("node", "up").join(above, "up").select(*info))


def exact_duplicates(
    df: DataFrame, keep: Sequence[str] = (), doc_id: str = "doc_id", text: str = "text", trie_bytes: int = TRIE_BYTES, owner_bytes: int = OWNER_BYTES, copies: int = COPIES
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, and the columns named by keep: one row per row.

    Texts are equal when identical after deleting every ASCII white space character; null counts as empty, and
    so do texts of white space alone: they form one group. Of a group the row with the most characters
    stays, then the smallest doc_id, null last; keep_id is that row's. Of repeated rows (equal in both) one is
    kept, whichever. Texts are compared whole, as bytes, valid UTF-8 or not. doc_id is of a type that Python orders
    (numbers, strings, dates). Other columns are ignored and cannot clash; an empty table gives an empty result.

    A task holds trie_bytes of texts, and one text more; any group may hold any share of the rows.
    """
    spark = df.sparkSession
    src = df.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).cast("binary").alias("text")
    )
    scanned = staged(_scan(src, keep, trie_bytes), "exact-scan")
    texts = scanned.filter("row is null").select("node", "size", "h", "text", "sha", "cp", "row0", "id0", "n")
    groups = _resolved(texts, parts(spark), owner_bytes, trie_bytes, copies)
    rows = scanned.filter("row is not null").select("row", "node", "doc_id", *[f"k{i}" for i in range(len(keep))])
    return rows.join(groups, "node").select(
        "doc_id", F.col("id0").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("row0")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
    )


def deduplicated(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with their columns."""
    own = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("own"))
    return exact_duplicates(own, keep=["own"]).filter("kept").select("own.*")


def op12_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates of `documents`: doc_id, keep_id, group_size, kept, text_sha256."""
    return exact_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


OP12_SQL = r"""
with t as (select doc_id, coalesce(text, '') as o, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as x from documents),
r as (select doc_id, x, row_number() over w as no, first_value(doc_id) over w as keep_id, count(*) over (partition by x) as group_size from t window w as (partition by x order by length(o) desc, doc_id nulls last))
select doc_id, keep_id, group_size, no = 1 as kept, sha256(x) as text_sha256 from r"""
