"""Text functions, links and search over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import minutes, postings, rerank, resolve, search, validate, vectors
from ..operators.names import named
from ..operators.staging import staged
from .frames import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return add


# ---- scalar functions --------------------------------------------------------------------

_NAME = "p_name || ' (Example) — ' || p_brand || '/' || p_type"


def _named(spark, d):
    return table(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit(" (Example) — "), "p_brand", F.lit("/"), "p_type").alias("s"))


@query("slugify", f"select p_partkey, substr(regexp_replace(regexp_replace(lower(regexp_replace({_NAME}, '\\(example\\)', '', 'gi')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) as slug from part")
def _(spark, d):
    return _named(spark, d).select("p_partkey", T.slug(F.col("s")).alias("slug"))


@query("norm_name", f"select p_partkey, trim(regexp_replace(regexp_replace(lower(regexp_replace({_NAME}, '\\(example\\)', '', 'gi')), '[^a-z0-9_\\s-]', ' ', 'g'), '\\s+', ' ', 'g')) as name from part")
def _(spark, d):
    return _named(spark, d).select("p_partkey", T.name_key(F.col("s")).alias("name"))


@query("task_key", f"select p_partkey, trim(regexp_replace(regexp_replace(lower({_NAME}), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) as key from part")
def _(spark, d):
    return _named(spark, d).select("p_partkey", T.task_key(F.col("s")).alias("key"))


@query("one_line", "select conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) as line from conversations")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.one_line(F.col("text")).alias("line"))


@query("frontmatter_split", """
select conv_id, turn, 'type: ' || role as fm, text as body from conversations where turn % 2 = 0
union all select conv_id, turn, null, text from conversations where turn % 2 = 1""")  # fmt: skip
def _(spark, d):
    c = table(spark, d, "conversations")
    text = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("---\ntype: "), "role", F.lit("\n---\n"), "text")).otherwise(F.col("text"))
    return c.select("conv_id", "turn", T.frontmatter(text).alias("fm"), T.body(text).alias("body"))


@query("paths", """
select l_orderkey, l_linenumber, 'a/' || l_partkey || '/c.md' as collapsed, case when l_partkey % 3 = l_suppkey % 3 then 'x ' || l_suppkey || '.md' else '../d' || (l_suppkey % 3) || '/x ' || l_suppkey || '.md' end as rel,
  case when l_partkey % 3 = l_suppkey % 3 then 'x%20' || l_suppkey || '.md' else '../d' || (l_suppkey % 3) || '/x%20' || l_suppkey || '.md' end as quoted, 'c' || l_partkey as stem from lineitem""")  # fmt: skip
def _(spark, d):
    p, s = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    rel = T.relative(F.concat(F.lit("r/d"), (F.col("l_partkey") % 3).cast("string"), F.lit("/y.md")), F.concat(F.lit("r/d"), (F.col("l_suppkey") % 3).cast("string"), F.lit("/x "), s, F.lit(".md")))
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", T.collapsed(F.concat(F.lit("./a//b/../"), p, F.lit("/./c.md"))).alias("collapsed"), rel.alias("rel"), T.quoted(rel).alias("quoted"),
        T.path_stem(F.concat(F.lit("x.y/c"), p, F.lit(".md"))).alias("stem"),
    )


@query("percent_round_trip", "select doc_id, text as back from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", T.unquoted(T.quoted(F.col("text"))).alias("back"))


@query("table_rows", "select o_orderkey, [o_orderstatus, 'a\\|b', o_orderpriority, ''] as cells, 'o/' || o_orderkey || ' x.md' as target from orders")
def _(spark, d):
    k = F.col("o_orderkey").cast("string")
    line = F.concat(F.lit("| "), "o_orderstatus", F.lit(" | a\\|b |"), "o_orderpriority", F.lit(" |  |"))
    return table(spark, d, "orders").select("o_orderkey", T.row_cells(line).alias("cells"), T.link_target(F.concat(F.lit("see [t](<o/"), k, F.lit("%20x.md#a>) end"))).alias("target"))


@query("small_texts", """
select o_orderkey, 'M1 ' || strftime(o_orderdate, '%Y-%m-%d') as milestone, '- [ ] ship it — ' || o_orderpriority || ', due ' || strftime(o_orderdate, '%Y-%m-%d') as action,
  'docs/o' || o_orderkey || '.md' as hit, 'The order number ' || o_orderkey || ' was sent' as sentence from orders""")  # fmt: skip
def _(spark, d):
    day, k = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey").cast("string")
    return table(spark, d, "orders").select(
        "o_orderkey", T.milestone(F.lit(" M1 "), day).alias("milestone"), T.action_line(F.lit(" ship it.. "), F.col("o_orderpriority"), day).alias("action"),
        T.hit_path(F.concat(F.lit("qmd://vault/docs/o"), k, F.lit(".md?index=a"))).alias("hit"), T.first_sentence(F.concat(F.lit("Short. The order number "), k, F.lit(" was sent. More text follows here."))).alias("sentence"),
    )


@query("scrub_urls", """
select page_id, 'get ' || regexp_extract(url, '^[a-z]+://') || '<host>/<path> and http://localhost:8080/v1/x' as shown from pages""")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", T.scrubbed_urls(F.concat(F.lit("get "), "url", F.lit(" and http://localhost:8080/v1/x"))).alias("shown"))


# ---- links -------------------------------------------------------------------------------


@query("strip_unrendered", r"""
select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace('```x```' || html || ' `code` %% hidden %%', '```.*?```', '', 'gs'), '`[^`\n]*`', '', 'g'), '<!--.*?-->', '', 'gs'), '%%.*?%%', '', 'gs') as text from pages""")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", T.strip_unrendered(F.concat(F.lit("```x```"), "html", F.lit(" `code` %% hidden %%"))).alias("text"))


@query("links_extract", """
select page_id, h as href, count(*) as n from (select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as h from pages) group by all""")
def _(spark, d):
    md = F.regexp_replace("html", r'<a href="([^"]*)">([^<]*)</a>', "[$2]($1)")
    return table(spark, d, "pages").select("page_id", F.explode(T.found(md, T.MD_LINK)).alias("href")).groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


@query("markup_extract", """
select o_orderkey, ['P' || o_custkey, 'b c'] as wiki, ['img/' || o_orderkey || '.png'] as images, ['v.base'] as bases, ['s' || (o_orderkey % 3)] as notes from orders""")
def _(spark, d):
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    text = F.concat(F.lit("[[P"), c, F.lit("#h|x]] [[b c]] ![a](img/"), k, F.lit(".png) ![[v.base#All]] see[^s"), (F.col("o_orderkey") % 3).cast("string"), F.lit("]\n[^s9]: def"))
    return table(spark, d, "orders").select("o_orderkey", T.found(text, T.WIKILINK).alias("wiki"), T.found(text, T.MD_IMAGE).alias("images"), T.found(text, T.BASE_EMBED).alias("bases"), T.found(text, T.FOOTNOTE).alias("notes"))


@query("links_broken", """
select 'LNK-01' as rule, 'n/' || o_orderkey || '.md' as rel, 'broken link -> ../p/' || (o_orderkey * 7 % 40000) || ' x.md' as message from orders where o_orderkey * 7 % 40000 not in (select p_partkey from part)
union all select 'LNK-02', 'n/' || o_orderkey || '.md', 'broken wikilink [[P' || o_custkey || ' X]]' from orders where o_custkey not in (select p_partkey from part)""")  # fmt: skip
def _(spark, d):
    k = F.col("o_orderkey")
    text = F.concat(F.lit("[a](../p/"), (k * 7 % 40000).cast("string"), F.lit("%20x.md#s) [[P"), F.col("o_custkey").cast("string"), F.lit(" X]] <!-- [b](no.md) --> [c](https://x.example) `[d](no.md)`"))
    own = table(spark, d, "orders").select(F.concat(F.lit("n/"), k.cast("string"), F.lit(".md")).alias("rel"), text.alias("text"))
    p = F.col("p_partkey").cast("string")
    files = table(spark, d, "part").select(F.explode(F.array(F.concat(F.lit("p/"), p, F.lit(" x.md")), F.concat(F.lit("w/p"), p, F.lit(" x.md")))).alias("rel"))
    return validate.broken_links(own, files).select("rule", "rel", "message")


@query("embeds_broken", """
select 'LNK-03' as rule, 'n' || o_orderkey as rel, 'embedded base not found: b' || (o_orderkey % 5) || '.base' as message from orders where o_orderkey % 5 > 2
union all select 'LNK-04', 'n' || o_orderkey, 'view ''' || o_orderstatus || ''' not in b' || (o_orderkey % 5) || '.base' from orders where o_orderkey % 5 <= 2 and o_orderstatus = 'P'""")  # fmt: skip
def _(spark, d):
    k = F.col("o_orderkey")
    text = F.concat(F.lit("![[b"), (k % 5).cast("string"), F.lit(".base#"), "o_orderstatus", F.lit("]]"))
    own = table(spark, d, "orders").select(F.concat(F.lit("n"), k.cast("string")).alias("rel"), text.alias("text"))
    return validate.broken_embeds(own, spark.createDataFrame([(f"b{i}.base", ["O", "F"]) for i in range(3)], "base string, views array<string>")).select("rule", "rel", "message")


@query("backlinks", """
with t as (select doc_id, text || case when doc_id % 2 = 0 then ' [[' || lang || '-' || (doc_id % 25) || ']]' else ' [x](../notes/' || lang || '-' || (doc_id % 25) || '.md)' end as text from documents)
select doc_id from t where contains(text, '[[en-1') or contains(text, 'en-1.md') or contains(text, 'notes/en-1.md')""")  # fmt: skip
def _(spark, d):
    k = F.col("doc_id")
    name = F.concat("lang", F.lit("-"), (k % 25).cast("string"))
    link = F.when(k % 2 == 0, F.concat(F.lit(" [["), name, F.lit("]]"))).otherwise(F.concat(F.lit(" [x](../notes/"), name, F.lit(".md)")))
    return search.backlinks(table(spark, d, "documents").withColumn("text", F.concat("text", link)), "notes/en-1.md").select("doc_id")


# ---- search ------------------------------------------------------------------------------

_Q = "the threrea tion"
_TERMS = ("threrea", "tion")  # `the` is a stopword


def _docs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("file"), F.substring("text", 1, 30).alias("title"), F.col("text").alias("body"), F.concat(F.lit('{"lang": "'), "lang", F.lit('"}')).alias("props"))


def _count(hay: str, term: str) -> str:
    return f"((length({hay}) - length(replace({hay}, '{term}', ''))) // {len(term)})"


def _score(hay: str, title: str) -> str:
    phrase = " ".join(_TERMS)
    return " + ".join([_count(hay, t) for t in _TERMS] + [f"5 * {_count(hay, phrase)}", f"case when contains({title}, '{phrase}') then 10 else 0 end"])


def _snippet(hay: str, low: str, before: int, after: int) -> str:
    """From before the first hit to after it."""
    at = "coalesce(least(" + ", ".join(f"nullif(instr({low}, '{t}'), 0)" for t in _TERMS) + ") - 1, 0)"
    begin = f"greatest({at} - {before}, 0)"
    return f"substr({hay}, {begin} + 1, {at} + {after} - {begin})"


@query("search_naive", f"""
select doc_id as file, ({_score("lower(text)", "lower(left(text, 30))")})::bigint as score, trim({_snippet("text", "lower(text)", 200, 400)}) as snippet from documents where {_score("lower(text)", "lower(left(text, 30))")} > 0 order by score desc, doc_id limit 25""")
def _(spark, d):
    return search.keyword_search(_docs(spark, d), _Q, 25, ["file"]).select("file", "score", "snippet")


_HAY = "lower(text || chr(10) || '{\"lang\": \"' || lang || '\"}')"


@query("search_bridge", f"""
select doc_id as file, ({_score(_HAY, "lower(left(text, 30))")})::bigint as score, trim(regexp_replace({_snippet(_HAY, _HAY, 80, 160)}, '\\s+', ' ', 'g')) as snippet from documents where {_score(_HAY, "lower(left(text, 30))")} > 0 order by score desc, doc_id limit 25""")
def _(spark, d):
    return search.haystack_search(_docs(spark, d), _Q, 25, ["file"]).select("file", "score", "snippet")


_BM = """
with w as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '') as ws from documents),
t as (select doc_id, len(ws) as len, len(list_filter(ws, lambda x: x = 'that')) as a, len(list_filter(ws, lambda x: x = 'que')) as b from w),
s as (select count(*) as n, avg(len) as avg, count(*) filter (a > 0) as da, count(*) filter (b > 0) as db from t),
k as (select doc_id as id, ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * len / avg)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * len / avg)) as score from t, s where a + b > 0)
"""
_COS = """
c as (select vec_id as id, list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 7)) as score from embeddings)
"""


def _bm(spark, d, n):
    """The n best of all documents, through the index of these documents; it is built when first asked for."""
    index = postings.opened(f"documents of {d}", table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))
    return index.search(["that", "que"], n)


def _cos(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return search.cosine(v, v.filter("id = 7").first()["v"])


@query("bm25_topk", f"{_BM} select id, rank, round(score, 6) as score from (select *, row_number() over (order by score desc, id)::int as rank from k) where rank <= 20")
def _(spark, d):
    return search.top(_bm(spark, d, 20), 20).withColumn("score", F.round("score", 6))


@query("cosine_topk", f"with {_COS} select id, rank, round(score, 6) as score from (select *, row_number() over (order by score desc, id)::int as rank from c) where rank <= 20")
def _(spark, d):
    return search.top(_cos(spark, d), 20).withColumn("score", F.round("score", 6))


@query("rrf", f"""{_BM}, {_COS}, r as (select id, row_number() over (order by score desc, id) as rank from k qualify rank <= 50 union all select id, row_number() over (order by score desc, id) from c qualify row_number() over (order by score desc, id) <= 50)
select id, round(sum(1.0 / (60 + rank)), 9) as score from r group by id order by sum(1.0 / (60 + rank)) desc, id limit 30""")  # fmt: skip
def _(spark, d):
    return search.fused([search.top(_bm(spark, d, 50), 50), search.top(_cos(spark, d), 50)], 30).withColumn("score", F.round("score", 9))


@query("mentions")
def _(spark, d):
    """The texts of all orders, named from all parts: DuckDB tries every text with every name, so there is no SQL."""
    p = table(spark, d, "part").select("p_partkey", "p_name")
    names = p.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("k")).select("name", F.concat(F.lit("p:"), F.col("k").cast("string")).alias("node"))
    part = lambda k: (1 + F.col(k) % F.col("n")).cast(p.schema["p_partkey"].dataType)
    o = table(spark, d, "orders").crossJoin(F.broadcast(p.agg(F.max("p_partkey").alias("n")))).select("o_orderkey", part("o_orderkey").alias("a"), part("o_custkey").alias("b"))
    o = o.join(p.select(F.col("p_partkey").alias("a"), F.col("p_name").alias("x")).hint("merge"), "a").join(p.select(F.col("p_partkey").alias("b"), F.col("p_name").alias("y")).hint("merge"), "b")
    texts = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("we need a "), F.upper("x"), F.lit(", and "), "y", F.lit("s")).alias("text"))
    return search.mentions(texts, names)


@query("entities_named", """
with n as (select count(*) as n from supplier)
select o_orderkey as id, 'c:' || o_custkey as node, 'person' as type from orders where o_custkey in (select c_custkey from customer)
union all select o_orderkey, 's:' || s_suppkey, 'project' from orders, n join supplier on s_suppkey = 1 + o_orderkey % n where o_orderkey % 2 = 0""")
def _(spark, d):
    """People by any case of their names, projects by an alias; no name counts inside a longer word."""
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey").crossJoin(F.broadcast(s.agg(F.count(F.lit(1)).alias("n"))))
    o = o.join(c.select(F.col("c_custkey").alias("o_custkey"), "c_name").hint("merge"), "o_custkey", "left").join(s.select("s_suppkey", "s_name").hint("merge"), F.col("s_suppkey") == 1 + F.col("o_orderkey") % F.col("n"), "left")
    tail = F.when(F.col("o_orderkey") % 2 == 0, ".").otherwise("-west")
    texts = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("we met "), F.coalesce(F.upper("c_name"), F.lit("nobody")), F.lit(", and ("), F.coalesce("s_name", F.lit("none")), tail).alias("text"))
    person = c.select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("id"), F.lit("person").alias("type"), F.col("c_name").alias("title"), F.lit(None).cast("array<string>").alias("aliases"))
    project = s.select(F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("project").alias("type"), F.lit("no such title").alias("title"), F.array("s_name", F.lit("")).alias("aliases"))
    return minutes.named_in(texts, person.unionByName(project))


@query("vector_topk", """
with s as (select q.vec_id as query, v.vec_id as id, list_cosine_similarity(q.embedding::double[], v.embedding::double[]) as score from embeddings q, embeddings v where q.vec_id % 20 = 0)
select query, id, rank, round(score, 6) as score from (select *, row_number() over (partition by query order by score desc, id)::int as rank from s where score is not null and not isnan(score)) where rank <= 10""")
def _(spark, d):
    """The ten nearest of all vectors to each of the queries, exact, through the inverted file."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    q = v.filter("id % 20 = 0").select(F.col("id").alias("query"), F.col("v").alias("q"))
    found = vectors.opened(f"embeddings of {d}", v).search(q, 10)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "id"))
    return found.select("query", "id", rank.alias("rank"), F.round("score", 6).alias("score"))


def passages(spark, d):
    """Of every passage of `benchmark`, as a query: its five words from the fourth on, and the documents that hold it whole (query, id)."""
    items, docs = table(spark, d, "benchmark"), table(spark, d, "documents")
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+"), F.lit(0))
    asked = {str(r["item_id"]): r["terms"] for r in items.select("item_id", F.slice(words, 4, 5).alias("terms")).collect()}  # the questions, which a caller names
    held = named(docs.select(F.col("doc_id").alias("id"), "text"), items.select(F.col("item_id").cast("string").alias("node"), F.col("text").alias("called")))
    return asked, held.select(F.col("node").alias("query"), "id")


@query("rerank_passages")
def _(spark, d):
    """The ten best of all documents for each passage's words, by a model learnt from all passages."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    asked, relevant = passages(spark, d)
    rows = staged(rerank.candidates(postings.opened(f"documents of {d}", docs), docs, asked), "candidates")  # learnt from, then ranked
    model = rerank.fit(rows, relevant)
    return (model or rerank.Reranker(*[(1.0,) + (0.0,) * 7, (0.0,) * 8, (1.0,) * 8])).ranked(rows, 10)


@query("suggestions")
def _(spark, d):
    p = table(spark, d, "part")
    pool = p.groupBy(F.col("p_name").alias("key")).agg(F.concat(F.lit("p:"), F.min("p_partkey").cast("string")).alias("id"))
    values = p.select(F.regexp_replace("p_name", "[aeiou](?=[^aeiou]*$)", "").alias("value")).distinct()
    return resolve.suggestions(values, pool)
