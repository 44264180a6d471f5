"""Grouping of spelling variants by Aho-Corasick halves.

A word has two segments, its first and its second half. One inserted, deleted or replaced code
point leaves one of them whole, so the shorter of two near words (the lesser of two equally long
ones) has a segment that the other holds, at its very beginning or at its very end. Automaton shards hold the
segments of all words, tied to their offset by a mark for the word's edge; every word is scanned by the
shards that may hold a segment of its, matches are checked for compatible lengths, and the distance of what
lies outside the segment is verified. A segment that many words share is cut into tiles of patterns and of
words, and every two tiles meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import join_many, parts, release, staged, table

#: Letters of words; of the crc32 that picks runs, the divisor.
LETTERS, EVERY = r"A-Za-zÀ-ÿ", 31
#: Least code points and occurrences of a word; how many times as frequent a form is.
LEAST, OCCURRENCES, RATIO = 7, 2, 10
#: Rows of one segment that meet in a task, rows of a shard, candidate pairs held at a time.
TILE, SHARD, PAIRS = 8192, 100_000, 1 << 20
#: Of longer segments the automaton holds so many code points at the word's edge; the rest is verified.
EDGE = 32

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(df: DataFrame, least: int = LEAST, occurrences: int = OCCURRENCES, every: int = EVERY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: the words of at least so many code points that occur at least so often.

    Words are maximal runs of letters with A-Z in lower case. Of a run for which `every` divides h, the
    unsigned crc32 of UTF-8 `<doc_id>:<run>`, the code point h % length is left out first (a null
    doc_id counts as empty text). Null and empty texts have no words; whole texts are read. Counts are summed up
    before they are shuffled. Other columns are ignored and cannot clash.
    """
    # shorter runs give no word, and are not even matched
    run = F.regexp_extract_all(F.col(text).cast("string"), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    runs = df.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("i"), F.explode(run).alias("w"))
    low = F.when(F.regexp_like("w", F.lit("[A-Z]")), F.translate("w", UPPER, LOWER)).otherwise(F.col("w"))
    runs = runs.select("i", low.alias("w"))
    h = F.crc32(F.concat("i", F.lit(":"), "w"))
    at = (h % F.length("w")).cast("int")
    word = F.when(h % every == 0, F.concat(F.substring("w", F.lit(1), at), F.substring("w", at + 2, F.length("w")))).otherwise(F.col("w"))
    words = runs.select(word.alias("word")).filter(F.length("word") >= least)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= occurrences)


def near(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point parts the two."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    lo, hi = 0, len(a)
    while lo < hi:  # the common prefix
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return a[lo + (len(a) == len(b)) :] == b[lo + 1 :]


def _segment(word: Column, length: Column, side: int) -> Column:
    """The segment of a pattern of that length that a word would hold at its beginning (0) or end (1)."""
    half = F.floor(length / 2).cast("int")
    if side == 0:
        return F.substring(word, F.lit(1), F.least(half, F.lit(EDGE)))
    size = F.least(length - half, F.lit(EDGE))
    return F.substring(word, F.length(word) - size + 1, size)


def _routed(words: DataFrame, tile: int, shard: int) -> DataFrame:
    """word, n, len (of the pattern), side, and g, key, i, j, which name the group that a row belongs to. pattern says
    which part it plays."""
    one = lambda df, length, side, pattern: df.select("word", "n", length.cast("int").alias("len"), F.lit(side).alias("side"), _segment(F.col("word"), length.cast("int"), side).alias("seg"), F.lit(pattern).alias("pattern"))
    own = F.length("word")
    rows = one(words, own, 0, True)
    for length, side, pattern in ((own, 1, True), (own, 0, False), (own, 1, False), (own - 1, 0, False), (own - 1, 1, False)):
        rows = rows.unionByName(one(words.filter(length > 0), length, side, pattern))
    on = ["len", "side", "seg"]
    held = rows.groupBy(*on).agg(F.count_if("pattern").alias("p"), F.count_if(~F.col("pattern")).alias("t"))
    held = held.filter("p > 0 and p + t > 2")  # a pattern meets itself as a word; more must come to it
    held = staged(held.select("*", (F.col("p") + F.col("t")).alias("c"), F.ceil(F.col("p") / tile).cast("int").alias("ni"), F.ceil(F.col("t") / tile).cast("int").alias("nj")), "spelling-segments")
    total = held.agg(F.sum("c")).first()[0] or 0
    shards = max(parts(words.sparkSession), -(-total // shard))
    rows = join_many(rows, held.drop("p", "t"), on, "c")
    hot = (F.col("ni") > 1) | (F.col("nj") > 1)
    mine = lambda n: F.pmod(F.xxhash64("word"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    rows = rows.select("word", "n", "len", "side", "pattern", "seg", "ni", "nj", F.explode(F.when(F.col("pattern"), F.array(mine("ni"))).otherwise(every("ni"))).alias("i"))
    rows = rows.select("*", F.explode(F.when(~F.col("pattern"), F.array(mine("nj"))).otherwise(every("nj"))).alias("j"))
    g = F.when(hot, 0).otherwise(F.pmod(F.xxhash64(*on), F.lit(shards)))
    key = F.when(hot, F.concat_ws(",", "len", "side", "seg")).otherwise("")
    rows = rows.select(g.cast("long").alias("g"), key.alias("key"), "i", "j", "word", "n", "len", "side", "pattern")
    # a word comes once to a group, whichever segments lead it there
    texts = rows.filter(~F.col("pattern")).withColumns({"len": F.lit(0), "side": F.lit(0)}).dropDuplicates(["g", "key", "i", "j", "word"])
    return rows.filter("pattern").unionByName(texts)


def _eight(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first eight bytes of data[start : start + size] as numbers, the first byte lowest, zero beyond the end."""
    at = np.arange(8)
    out = data[np.minimum(start[:, None] + at, len(data) - 1)]
    out[at >= size[:, None]] = 0
    return np.ascontiguousarray(out).view("<u8").ravel()


def _may_be_near(a: np.ndarray, b: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """For first eight bytes of parts that follow a segment: whether one code point at most parts them. longer: b has one more."""
    x = a ^ b
    for s in (4, 2, 1):
        x |= x >> np.uint64(s)
    x &= np.uint64(0x0101010101010101)  # bytes that differ
    first = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1))  # bits below the first of them; 64 if none does
    up = np.minimum(first, 56).astype(np.uint64)
    rest = (a >> up) ^ (b >> np.minimum(up + np.uint64(8), np.uint64(63)))
    rest &= np.where(up >= np.uint64(56), np.uint64(0), np.uint64(0xFFFFFFFFFFFFFFFF) >> np.minimum(up + np.uint64(8), np.uint64(63)))
    return np.where(longer, (x == 0) | (rest == 0), np.bitwise_count(x) <= 1)


def _matches(patterns: dict[tuple[str, int], dict[int, tuple[int, int]]], words: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
    """word number, side, pattern length, first and last pattern number, for each segment that the automaton
    finds in the words and whose pattern is as long or one shorter."""
    auto = ahocorasick.Automaton()
    for (seg, side), spans in patterns.items():
        auto.add_word("\n" + seg if side == 0 else seg + "\n", (side, spans))
    auto.make_automaton()
    hay = "\n" + "\n".join(words) + "\n"
    ends = np.cumsum([len(w) + 1 for w in words])  # the mark after each word
    found = [(end, hit) for end, hit in auto.iter(hay)]
    # a match at a word's beginning ends inside it (an empty segment's on the mark before it), one at its end on the mark after it
    at = np.searchsorted(ends, [end + 1 - side for end, (side, _) in found]).tolist()
    for i, (_, (side, spans)) in zip(at, found, strict=True):
        if i == len(words):
            continue
        n = len(words[i])
        for length in (n, n - 1):
            if length in spans:
                yield i, side, length, *spans[length]


def _scan(group: pa.Table) -> pa.Table:
    """Of one group: for each word that is near another one, the number of those, the most frequent one and its count."""
    names = group.column("word").to_pylist()
    every = sorted(set(names))  # code-point order
    rank = {w: i for i, w in enumerate(every)}
    count = np.zeros(len(every), np.int64)
    rows = list(zip(names, group.column("n").to_pylist(), group.column("len").to_pylist(), group.column("side").to_pylist(), group.column("pattern").to_pylist(), strict=True))
    pats, texts = [], []
    for w, n, length, side, pattern in rows:
        count[rank[w]] = n
        if pattern:
            half = length // 2
            pats.append((w[: min(half, EDGE)] if side == 0 else w[-min(length - half, EDGE) :], side, length, rank[w]))
        else:
            texts.append(w)
    pats.sort()
    spans: dict[tuple[str, int], dict[int, tuple[int, int]]] = {}
    for k, (seg, side, length, _) in enumerate(pats):
        own = spans.setdefault((seg, side), {})
        own[length] = (own.get(length, (k,))[0], k + 1)
    data = np.frombuffer("".join(every).encode("latin-1") or b"\0", np.uint8)
    size = np.array([len(w) for w in every], np.int64)
    start = np.cumsum(size) - size
    p_rank = np.array([p[3] for p in pats], np.int64)
    p_len, p_side = np.array([p[2] for p in pats], np.int64), np.array([p[1] for p in pats], np.int64)
    half = p_len // 2
    # what lies outside the segment: behind the first half, or the first half itself
    p_eight = _eight(data, start[p_rank] + np.where(p_side == 0, half, 0), np.where(p_side == 0, p_len - half, half)) if pats else np.zeros(0, np.uint64)
    hits = np.array(list(_matches(spans, texts)), np.int64).reshape(-1, 5) if pats and texts else np.zeros((0, 5), np.int64)
    t_rank = np.array([rank[w] for w in texts], np.int64)
    near_to: list[np.ndarray] = []
    lo = 0
    steps = np.cumsum(hits[:, 4] - hits[:, 3])
    while lo < len(hits):
        hi = max(lo + 1, int(np.searchsorted(steps, (steps[lo - 1] if lo else 0) + PAIRS, "right")))
        part, lo = hits[lo:hi], hi
        n = part[:, 4] - part[:, 3]
        t, side, length = t_rank[part[:, 0]], part[:, 1], part[:, 2]
        cut = length // 2
        longer = size[t] > length
        t_eight = _eight(data, start[t] + np.where(side == 0, cut, 0), np.where(side == 0, size[t] - cut, cut + longer))
        of = np.repeat(np.arange(len(part)), n)
        k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + part[of, 3]
        p = p_rank[k]
        ok = longer[of] | (p < t[of])  # of equally long words the lesser is the pattern
        of, k, p = of[ok], k[ok], p[ok]
        ok = _may_be_near(p_eight[k], t_eight[of], longer[of]) | (length[of] > 2 * EDGE)
        of, p = of[ok], p[ok]
        for a, b, s in zip(p.tolist(), t[of].tolist(), side[of].tolist(), strict=True):
            x, y = every[a], every[b]
            half_ = len(x) // 2
            starts = y.startswith(x[:half_])
            # a pair found at both ends counts at the beginning
            if near(x, y) and (starts if s == 0 else not starts and y.endswith(x[half_:])):
                near_to.append((a, b))
    pairs = np.array(near_to, np.int64).reshape(-1, 2)
    one = np.concatenate((pairs[:, 0], pairs[:, 1]))
    other = np.concatenate((pairs[:, 1], pairs[:, 0]))
    order = np.lexsort((other, -count[other], one))
    one, other = one[order], other[order]
    at = np.flatnonzero(np.append(True, one[1:] != one[:-1])) if len(one) else np.zeros(0, np.int64)
    best = other[at]
    return pa.table(
        {"word": pa.array([every[i] for i in one[at]], pa.string()), "n_near": pa.array(np.diff(np.append(at, len(one))), pa.int64()), "best_n": pa.array(count[best], pa.int64()), "best": pa.array([every[i] for i in best], pa.string())}
    )


def neighbours(words: DataFrame, tile: int = TILE, shard: int = SHARD) -> DataFrame:
    """word, n_near, best_n, best: for each of the words (word, n; distinct, Latin-1) that has near words, how many,
    the count of the most frequent one, and that one (ties: the smallest in code-point order).

    A task sends on one row for each of its words, not its pairs. Words of one code point and more are
    taken, however long; null words are left out."""
    routed = _routed(words.select("word", F.col("n").cast("long").alias("n")).filter("word <> ''"), tile, shard)
    found = routed.groupBy("g", "key", "i", "j").applyInArrow(_scan, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("least"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.least")).alias("best_n"), F.col("b.best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: where the forms (word, form) end. Each step doubles what has been followed; a
    form's count is a multiple of its word's, so there are no circles."""
    now = staged(forms.select("word", F.col("form").alias("at")), "spelling-forms")
    while True:
        asked = now.groupBy("at").agg(F.count(F.lit(1)).alias("c"))
        one = staged(asked.join(now.select(F.col("word").alias("at"), F.col("at").alias("next")), "at", "left"), "spelling-next")
        if one.filter("next is not null").isEmpty():
            release(one)
            return now.select("word", F.col("at").alias("root"))
        after = staged(join_many(now, one, ["at"], "c").select("word", F.coalesce("next", "at").alias("at")), "spelling-forms")
        release(one, now)
        now = after


def variants(words: DataFrame, ratio: int = RATIO, tile: int = TILE, shard: int = SHARD) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row for each of the words (word, n).

    The form is the near word of largest n (ties: the smallest in code-point order) if that n is at least
    `ratio` times the word's, else null; root is the last word that forms lead to, or the word itself. An empty table gives
    an empty result."""
    if ratio < 2:
        raise ValueError("a form is more frequent than its word")
    words = words.select("word", "n")
    found = staged(words.join(neighbours(words, tile, shard), "word", "left"), "spelling-near")
    form = F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best"))
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), form.alias("form"), F.when(form.isNotNull(), F.col("best_n")).alias("form_n"))
    roots = _roots(found.filter("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of `documents`: word, form, root, n, n_near, form_n."""
    words = staged(word_counts(table(spark, sf_dir, "documents", "doc_id", "text")), "spelling-words")
    return variants(words)


OP11_SQL = r"""
with recursive tab as (select list(c order by i) as t from (select i, list_reduce(list_prepend(i, range(8)), lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as c from (select unnest(range(256)) as i))),
runs as (select coalesce(doc_id::varchar, '') as i, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w, count(*) as n
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]{7,}')) as w from documents) group by 1, 2),
b as (select w, n, length(w) as l, hex(encode(i || ':' || w)) as x from runs),
h as (select w, n, l, xor(list_reduce(list_prepend(4294967295, [('0x' || x[2 * k + 1 : 2 * k + 2])::bigint for k in range(length(x) // 2)]), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) as h from b, tab),
v as (select case when h % 31 = 0 then w[1 : h % l] || w[h % l + 2 :] else w end as word, n from h),
words as (select word, sum(n)::bigint as n from v where length(word) >= 7 group by 1 having sum(n) >= 2),
gaps as (select word, n, k, word[1 : k - 1] || word[k + 1 :] as rest from (select word, n, unnest(range(1, length(word) + 1)) as k from words)),
pairs as (select a.word, b.word as other, b.n as m from gaps a join gaps b on a.k = b.k and a.rest = b.rest and a.word <> b.word
  union select a.word, b.word, b.n from gaps a join words b on a.rest = b.word
  union select b.word, a.word, a.n from gaps a join words b on a.rest = b.word),
best as (select word, count(*) as n_near, max(m) as m, arg_min(other, (-m, other)) as other from pairs group by 1),
f as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when m >= 10 * n then other end as form, case when m >= 10 * n then m end as form_n from words w left join best using (word)),
r as (select word, word as root, 0 as d from f union all select r.word, f.form, d + 1 from r join f on r.root = f.word where f.form is not null)
select word, form, arg_max(r.root, r.d) as root, any_value(n) as n, any_value(n_near) as n_near, any_value(form_n) as form_n from f join r using (word) group by word, form"""
