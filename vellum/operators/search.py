"""Search: term counts, BM25, cosine similarity, rank fusion.

A query's terms are few and become literals; what is scored is the whole table. Top rows
are taken by order and limit, which each task does for itself before the last merge.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hit_path, occurrences, squeezed
from .names import named

#: The words that no search looks for.
STOPWORDS = frozenset(
    "the and for with what why how who which when where did does was were are our this that from into about "
    "der die das und ist wie wer mit von für auf ein eine nicht wird".split()
)


def query_terms(question: str, least: int = 3) -> list[str]:
    """The words of a question that are long enough and no stopwords, lower case, in order."""
    return [w for w in (x.lower() for x in re.findall(r"\w+", question) if len(x) >= least) if w not in STOPWORDS]


def term_score(body: Column, title: Column, terms: Sequence[str]) -> Column:
    """Occurrences of the terms, five for each of the phrase, and ten if the title has it.
    body and title in lower case. A single term counts as the phrase, too."""
    phrase = " ".join(terms)
    score = 5 * occurrences(body, F.lit(phrase)) + F.when(F.contains(title, F.lit(phrase)), 10).otherwise(0)
    for t in terms:
        score = score + occurrences(body, F.lit(t))
    return score


def first_hit(body: Column, terms: Sequence[str]) -> Column:
    """Offset of the first occurrence of any term, from 0; 0 without one."""
    at = [F.nullif(F.instr(body, t), F.lit(0)) for t in terms]
    return F.coalesce((F.least(*at) if len(at) > 1 else at[0]) - 1, F.lit(0))


def best_files(notes: DataFrame, score: Column, n: int, order: Sequence[str]) -> DataFrame:
    """The n best notes, best first, with their score: files and scores alone are ordered, and the
    texts of the winners are joined (n rows, which the caller names)."""
    won = notes.select("file", *[c for c in order if c != "file"], score.alias("score")).filter("score > 0").orderBy(F.col("score").desc(), *order).limit(n)
    return notes.join(F.broadcast(won.select("file", "score")), "file").orderBy(F.col("score").desc(), *order)


def keyword_search(notes: DataFrame, question: str, n: int, order: Sequence[str]) -> DataFrame:
    """file, title, snippet, score: the n best notes (file, title, body, and the columns that
    break ties). The snippet runs from 200 characters before the first hit to 400 after it."""
    terms = query_terms(question)
    if not terms:
        return notes.select("file", "title", F.lit("").alias("snippet"), F.lit(0).cast("long").alias("score")).limit(0)
    at = first_hit(F.lower("body"), terms)
    begin = F.greatest(at - 200, F.lit(0))
    found = best_files(notes, term_score(F.lower("body"), F.lower("title"), terms), n, order)
    return found.select("file", "title", F.trim(F.col("body").substr(begin + 1, at + 400 - begin)).alias("snippet"), "score")


def haystack_search(notes: DataFrame, query: str, n: int, order: Sequence[str]) -> DataFrame:
    """As keyword_search, over body and frontmatter (a column props, JSON) together, with terms
    of two letters on, and a snippet of the lower-case text from 80 before to 160 after."""
    terms = query_terms(query, 2)
    if not terms:
        return notes.select("file", "title", F.lit(0).cast("long").alias("score"), F.lit("").alias("snippet")).limit(0)
    hay = F.lower(F.concat("body", F.lit("\n"), F.coalesce("props", F.lit("{}"))))
    at = first_hit(hay, terms)
    begin = F.greatest(at - 80, F.lit(0))
    found = best_files(notes, term_score(hay, F.lower("title"), terms), n, order)
    return found.select("file", "title", "score", squeezed(hay.substr(begin + 1, at + 160 - begin)).alias("snippet"))


def bm25(docs: DataFrame, terms: Sequence[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """id, score: BM25 of the documents (id, text) that hold any of the terms. One pass counts
    the terms, one row of statistics joins it."""
    low = F.lower("text")
    # words are runs of word characters: counted by pattern, no array of them is made
    counted = lambda term: F.regexp_count(low, F.lit(rf"(?U)(?<!\w)\Q{term}\E(?!\w)"))
    tf = docs.select("id", F.regexp_count(low, F.lit(r"(?U)\w+")).alias("len"), *[counted(t).alias(f"tf{i}") for i, t in enumerate(terms)])
    # one row of statistics, as literals of the scoring pass
    stats = tf.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]).first()
    n, avg = stats["n"], stats["avg"] or 1.0
    score = F.lit(0.0)
    for i in range(len(terms)):
        t, d = F.col(f"tf{i}"), stats[f"df{i}"]
        idf = math.log(1 + (n - d + 0.5) / (d + 0.5))
        score = score + idf * t * (k1 + 1) / (t + k1 * (1 - b + b * F.col("len") / avg))
    return tf.withColumn("score", score).filter("score > 0").select("id", "score")


def cosine(vectors: DataFrame, query: Sequence[float]) -> DataFrame:
    """id, score: cosine similarity of the vectors (id, v) with a query."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = lambda a, c: F.aggregate(F.zip_with(a, c, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda acc, x: acc + x)
    norm = sum(float(x) ** 2 for x in query) ** 0.5
    size = F.sqrt(dot(F.col("v"), F.transform("v", lambda x: x.cast("double"))))
    return vectors.withColumn("s", dot(F.col("v"), q) / (size * norm)).select("id", F.col("s").alias("score")).filter("score is not null and not isnan(score)")


def top(scored: DataFrame, n: int) -> DataFrame:
    """id, rank, score of the n best, ties to smaller ids."""
    best = scored.orderBy(F.col("score").desc(), "id").limit(n)
    # the window sees n rows
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "id"))).select("id", "rank", "score")


def fused(lists: Sequence[DataFrame], n: int, k: int = 60) -> DataFrame:
    """id, score: reciprocal rank fusion of ranked lists (id, rank)."""
    every = lists[0].select("id", "rank")
    for other in lists[1:]:
        every = every.unionByName(other.select("id", "rank"))
    return every.groupBy("id").agg(F.sum(1 / (k + F.col("rank"))).alias("score")).orderBy(F.col("score").desc(), "id").limit(n)


def without_addresses(hits: DataFrame) -> DataFrame:
    return hits.withColumn("file", hit_path(F.col("file")))


def mentions(texts: DataFrame, names: DataFrame, least: int = 4) -> DataFrame:
    """id, node, size: the nodes whose name (names: node, name) stands in a text (texts: id,
    text) as words, case aside, with the length of the longest such name. Names shorter than `least`
    are left out, and so are names without a letter or digit."""
    clean = F.trim(F.regexp_replace("name", r"(?i)\s*\(example\)", ""))
    called = names.select("node", F.lower(clean).alias("called")).filter((F.length("called") >= least) & F.regexp_like("called", F.lit(r"(?U)[\w-]")))
    return named(texts.select("id", F.lower("text").alias("text")), called)


def backlinks(texts: DataFrame, rel: str) -> DataFrame:
    """Rows (a column text) that hold the wikilink, the path or the file name of a note."""
    stem = rel.rpartition("/")[2].removesuffix(".md")
    return texts.filter(F.contains("text", F.lit(f"[[{stem}")) | F.contains("text", F.lit(rel)) | F.contains("text", F.lit(f"{stem}.md")))
