"""Queries of text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithos.functions import maths as M
from lithos.functions import text as X
from lithos.plans.registry import query
from lithos.plans.views import rounded, table


@query(r"SELECT doc_id, len(list_filter(string_split_regex(text, '[ \t\n\r\f\v]+'), lambda x: x <> '')) AS words FROM documents")
def tokenise(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.tokens(F.col("text"), r" \t\n\r\f\x0B")).cast("long").alias("words"))


@query("SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS n FROM orders")
def thousands_int(spark, sf_dir):
    shown = F.format_number(F.floor("o_totalprice"), 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", X.whole_number(shown).alias("n"))


@query("""SELECT page_id, nullif(regexp_extract(html, 'href="([^"]*)"', 1), '') AS link FROM pages""")
def link_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.first_link(F.col("html")).alias("link"))


@query("SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 5, '0') AS padded, replace(lower(c_mktsegment), ' ', '_') AS name FROM customer")
def names(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", X.padded(F.col("c_custkey")).alias("padded"), X.plain_name(F.col("c_mktsegment")).alias("name"))


@query("SELECT p_partkey, round(atan(p_size) / (pi() / 2), 9) AS squashed, round(ln(p_retailprice) / ln(7), 9) AS log7, round(1 / (1 + exp(-p_size / 10.0::DOUBLE)), 9) AS share FROM part")
def scalar_functions(spark, sf_dir):
    size = F.col("p_size").cast("double")
    return rounded(table(spark, sf_dir, "part").select("p_partkey", M.squash(size).alias("squashed"), M.log_base(F.col("p_retailprice"), 7).alias("log7"), M.logistic(size / 10).alias("share")), 9)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(-0.5 * ((l_quantity - 25) / 14) * ((l_quantity - 25) / 14) - ln(14.0::DOUBLE) - 0.5 * ln(2 * pi()), 9) AS logp,
    CASE WHEN l_quantity <= 30 THEN round(1.5 * (l_quantity / 30) - 0.5 * pow(l_quantity / 30, 3), 9) ELSE 1.0::DOUBLE END AS gamma FROM lineitem""")
def densities(spark, sf_dir):
    q = F.col("l_quantity")
    return rounded(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", M.gaussian_log_pdf(q, 25.0, 14.0).alias("logp"), M.spherical_variogram(q, 30.0, 1.0).alias("gamma")), 9)


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' AS iso FROM events")
def iso_times(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.iso_time(F.col("ts")).alias("iso"))
