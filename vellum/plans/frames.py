"""The driver's tables seen as notes and as a graph, and the SQL that says the same."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TODAY = dt.date(1998, 6, 17)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """id, type, title of regions, nations, customers, suppliers, orders and parts."""
    t = lambda n: table(spark, d, n)
    one = lambda df, p, k, kind, title: df.select(_id(p, k).alias("id"), F.lit(kind).alias("type"), title.alias("title"))
    out = one(t("region"), "r:", "r_regionkey", "region", F.col("r_name"))
    for more in (
        one(t("nation"), "n:", "n_nationkey", "nation", F.col("n_name")),
        one(t("customer"), "c:", "c_custkey", "customer", F.col("c_name")),
        one(t("supplier"), "s:", "s_suppkey", "supplier", F.col("s_name")),
        one(t("orders"), "o:", "o_orderkey", "order", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"))),
        one(t("part"), "p:", "p_partkey", "part", F.col("p_name")),
    ):
        out = out.unionByName(more)
    return out


NODES_SQL = """(
  select 'r:' || r_regionkey as id, 'region' as type, r_name as title from region
  union all select 'n:' || n_nationkey, 'nation', n_name from nation
  union all select 'c:' || c_custkey, 'customer', c_name from customer
  union all select 's:' || s_suppkey, 'supplier', s_name from supplier
  union all select 'o:' || o_orderkey, 'order', 'Order ' || o_orderkey from orders
  union all select 'p:' || p_partkey, 'part', p_name from part)"""


def raw_edges(spark: SparkSession, d: str) -> DataFrame:
    """src, pred, dst, origin with repeats: places, orders and their parts."""
    t = lambda n: table(spark, d, n)
    e = lambda df, sp, s, pred, dp, t_, origin="frontmatter": df.select(_id(sp, s).alias("src"), F.lit(pred).alias("pred"), _id(dp, t_).alias("dst"), F.lit(origin).alias("origin"))
    lines = t("lineitem").select(_id("o:", "l_orderkey").alias("src"), F.lit("contains").alias("pred"), _id("p:", "l_partkey").alias("dst"), F.when(F.col("l_linestatus") == "F", "body").otherwise("frontmatter").alias("origin"))
    out = e(t("nation"), "n:", "n_nationkey", "located_in", "r:", "n_regionkey")
    for more in (e(t("customer"), "c:", "c_custkey", "located_in", "n:", "c_nationkey"), e(t("supplier"), "s:", "s_suppkey", "located_in", "n:", "s_nationkey"), e(t("orders"), "o:", "o_orderkey", "placed_by", "c:", "o_custkey"), lines):
        out = out.unionByName(more)
    return out


RAW_EDGES_SQL = """(
  select 'n:' || n_nationkey as src, 'located_in' as pred, 'r:' || n_regionkey as dst, 'frontmatter' as origin from nation
  union all select 'c:' || c_custkey, 'located_in', 'n:' || c_nationkey, 'frontmatter' from customer
  union all select 's:' || s_suppkey, 'located_in', 'n:' || s_nationkey, 'frontmatter' from supplier
  union all select 'o:' || o_orderkey, 'placed_by', 'c:' || o_custkey, 'frontmatter' from orders
  union all select 'o:' || l_orderkey, 'contains', 'p:' || l_partkey, case when l_linestatus = 'F' then 'body' else 'frontmatter' end from lineitem)"""

EDGES_SQL = f"""(
  select src, pred, dst, case min(case origin when 'frontmatter' then 1 when 'body' then 2 else 3 end) when 1 then 'frontmatter' when 2 then 'body' else 'derived' end as origin
  from {RAW_EDGES_SQL} where src <> dst group by src, pred, dst)"""

INVERSES = {"located_in": "holds", "placed_by": "placed", "contains": "part_of"}


def places(edges: DataFrame) -> DataFrame:
    return edges.filter("pred = 'located_in'")


PLACES_SQL = f"(select src, pred, dst, origin from {EDGES_SQL} where pred = 'located_in')"

# ---- orders as notes ---------------------------------------------------------------------

FOLDERS = ("01-journal/daily", "01-journal/weekly", "01-journal/monthly", "01-journal/quarterly", "03-projects", "06-decisions", "02-meetings", "05-people", "07-knowledge", "00-home", "09-archive", "90-templates", "99-system")
TYPES = ("project", "decision", "meeting", "person", "team", "concept", "runbook", "spec", "weekly", "monthly", "quarterly", "retro", "daily", "", "project", "decision", "concept")


def notes(spark: SparkSession, d: str) -> DataFrame:
    """Orders as notes: rel, title, the properties that views ask for, mtime."""
    k = F.col("o_orderkey")
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (k % n + 1).cast("int"))
    day = F.col("o_orderdate").cast("date")
    text = lambda x: F.date_format(x, "yyyy-MM-dd")
    return table(spark, d, "orders").select(
        k.alias("key"),
        F.concat(pick(FOLDERS, len(FOLDERS)), F.lit("/o"), k.cast("string"), F.lit(".md")).alias("rel"),
        F.concat(F.lit("Order "), k.cast("string")).alias("title"),
        pick(TYPES, len(TYPES)).alias("type"),
        F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "waiting").otherwise("on-hold").alias("state"),
        F.when(F.col("o_orderpriority").startswith("1"), "red").when(F.col("o_orderpriority").startswith("2"), "yellow").otherwise("green").alias("health"),
        text(day).alias("date"), text(F.date_add(day, 30)).alias("due"), text(F.date_add(day, 7)).alias("next_1_1"),
        F.element_at(F.array(F.lit("draft"), F.lit("stable"), F.lit("deprecated")), (k % 3 + 1).cast("int")).alias("status"),
        F.when(k % 4 != 0, F.concat(text(F.date_add(day, 400)), F.lit("T00:00:00Z"))).alias("stale_after"),
        (k * 10).cast("double").alias("mtime"),
        F.concat(F.lit("Total "), F.col("o_totalprice").cast("long").cast("string")).alias("description"),
        F.col("o_custkey").alias("custkey"),
    )


def _list(names: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


NOTES_SQL = f"""(
  select o_orderkey as key, {_list(FOLDERS)}[(o_orderkey % {len(FOLDERS)}) + 1] || '/o' || o_orderkey || '.md' as rel, 'Order ' || o_orderkey as title,
    {_list(TYPES)}[(o_orderkey % {len(TYPES)}) + 1] as type,
    case o_orderstatus when 'O' then 'open' when 'F' then 'waiting' else 'on-hold' end as state,
    case left(o_orderpriority, 1) when '1' then 'red' when '2' then 'yellow' else 'green' end as health,
    strftime(o_orderdate, '%Y-%m-%d') as date, strftime(o_orderdate + interval 30 day, '%Y-%m-%d') as due, strftime(o_orderdate + interval 7 day, '%Y-%m-%d') as next_1_1,
    ['draft', 'stable', 'deprecated'][(o_orderkey % 3) + 1] as status,
    case when o_orderkey % 4 <> 0 then strftime(o_orderdate + interval 400 day, '%Y-%m-%d') || 'T00:00:00Z' end as stale_after,
    (o_orderkey * 10)::double as mtime, 'Total ' || trunc(o_totalprice)::bigint as description, o_custkey as custkey
  from orders)"""
