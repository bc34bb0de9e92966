"""The registered queries of the relational engine, each with the SQL that gives the same rows.

All tables are read whole. Where a query needs nulls or misses that the tables don't have, both forms make them the same
way, by a CASE on the key: every tenth customer key of the orders is nulled, and every seventh of the customers.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import Agg, aggregate, batches_of, hash_join, project, recursive_series, repeat_rows, sort_rows
from .plans import Channel, Observer, Pipeline, join_pipe, map_pipe
from .sources import black_hole, every_lane, load, parallel_source, shared_folder, single_row
from .streaming import available_aggregate, available_to_table, file_stream
from .streaming.produced import Produced

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, tuple[Query, str | None]] = {}


def registered(sql: str | None, name: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        FOUND[name or f.__name__] = (f, sql and " ".join(sql.split()))
        return f

    return keep


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in FOUND.items() if sql}


@registered("""SELECT c_mktsegment, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS revenue
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""")
def join_agg(spark, sf):
    joined = hash_join(load(spark, sf, "orders"), load(spark, sf, "customer"), ["o_custkey"], ["c_custkey"], left_output=["o_totalprice"], right_output=["c_mktsegment"])
    price = joined.withColumn("price", F.col("o_totalprice").cast("decimal(18,2)"))
    return aggregate(price, ["c_mktsegment"], [Agg("hash_count_all", name="n_orders"), Agg("hash_sum", "price", "revenue")])


# ------------------------------------------------------------------ joins

#: All orders and all customers. A CASE nulls some keys on either side, so that keys miss a partner both ways.
L = "(SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_custkey END AS ck, o_totalprice, o_orderpriority FROM orders) AS l"
R = "(SELECT CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey END AS k, c_name, c_nationkey, c_acctbal FROM customer) AS r"


def left_orders(spark, sf, null: str = "o_orderkey % 10 = 0"):
    return load(spark, sf, "orders").select("o_orderkey", F.expr(f"CASE WHEN {null} THEN NULL ELSE o_custkey END").alias("ck"), "o_totalprice", "o_orderpriority")


def right_customers(spark, sf, null: str = "c_custkey % 7 = 0"):
    return load(spark, sf, "customer").select(F.expr(f"CASE WHEN {null} THEN NULL ELSE c_custkey END").alias("k"), "c_name", "c_nationkey", "c_acctbal")


def join_query(how: str, **options) -> Query:
    return lambda spark, sf: hash_join(left_orders(spark, sf), right_customers(spark, sf), ["ck"], ["k"], how, **options)


BOTH = "o_orderkey, ck, o_totalprice, o_orderpriority, k, c_name, c_nationkey, c_acctbal"
LEFT_ONLY, RIGHT_ONLY = "o_orderkey, ck, o_totalprice, o_orderpriority", "k, c_name, c_nationkey, c_acctbal"
PAIRED = {"inner": "JOIN", "left_outer": "LEFT JOIN", "right_outer": "RIGHT JOIN", "full_outer": "FULL JOIN"}
for _how, _sql in PAIRED.items():
    registered(f"SELECT {BOTH} FROM {L} {_sql} {R} ON l.ck = r.k", f"join_{_how}")(join_query(_how))
for _not, _kind in (("", "semi"), ("NOT ", "anti")):
    registered(f"SELECT {LEFT_ONLY} FROM {L} WHERE {_not}EXISTS (SELECT 1 FROM {R} WHERE l.ck = r.k)", f"join_left_{_kind}")(join_query(f"left_{_kind}"))
    registered(f"SELECT {RIGHT_ONLY} FROM {R} WHERE {_not}EXISTS (SELECT 1 FROM {L} WHERE l.ck = r.k)", f"join_right_{_kind}")(join_query(f"right_{_kind}"))


#: A bounded number of null keys on either side, since under IS all of them meet.
FEW_L, FEW_R = L.replace("o_orderkey % 10 = 0", "o_orderkey <= 40"), R.replace("c_custkey % 7 = 0", "c_custkey <= 7")


@registered(f"SELECT {BOTH} FROM {FEW_L} JOIN {FEW_R} ON l.ck IS NOT DISTINCT FROM r.k")
def join_null_safe(spark, sf):
    return hash_join(left_orders(spark, sf, "o_orderkey <= 40"), right_customers(spark, sf, "c_custkey <= 7"), ["ck"], ["k"], key_cmp=["IS"])


SUPPLY = "(SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 45) AS r"


@registered(f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem AS l WHERE EXISTS (SELECT 1 FROM {SUPPLY} WHERE l.l_partkey = r.l_partkey AND l.l_suppkey = r.l_suppkey)")
def join_multi_key(spark, sf):
    lines = load(spark, sf, "lineitem")
    supply = lines.where("l_quantity > 45").select("l_partkey", "l_suppkey").distinct()
    keys = ["l_partkey", "l_suppkey"]
    return hash_join(lines, supply, keys, keys, "left_semi", left_output=["l_orderkey", "l_linenumber", "l_quantity"])


NATIONS = "(SELECT n_name, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_regionkey END AS rk, n_nationkey % 4 AS m FROM nation)"


@registered(f"SELECT a.n_name AS name_a, b.n_name AS name_b, a.rk AS rk_a, b.m AS m_b FROM {NATIONS} AS a JOIN {NATIONS} AS b ON a.rk IS NOT DISTINCT FROM b.rk AND a.m = b.m")
def join_mixed_key_cmp(spark, sf):
    side = load(spark, sf, "nation").select("n_name", F.expr("CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_regionkey END").alias("rk"), F.expr("n_nationkey % 4").alias("m"))
    joined = hash_join(side, side, ["rk", "m"], ["rk", "m"], key_cmp=["IS", "EQ"], suffixes=("_a", "_b"))
    return joined.select(F.col("n_name_a").alias("name_a"), F.col("n_name_b").alias("name_b"), "rk_a", "m_b")


def richer(l, r):  # noqa: E741
    return l("o_totalprice") > r("c_acctbal") * 20


FULL_MATCH = "l.ck = r.k AND l.o_totalprice > r.c_acctbal * 20"
for _how, _sql in PAIRED.items():
    registered(f"SELECT {BOTH} FROM {L} {_sql} {R} ON {FULL_MATCH}", f"join_residual_{_how}")(join_query(_how, residual=richer))
for _not, _kind in (("", "semi"), ("NOT ", "anti")):
    registered(f"SELECT {LEFT_ONLY} FROM {L} WHERE {_not}EXISTS (SELECT 1 FROM {R} WHERE {FULL_MATCH})", f"join_residual_{_kind}")(join_query(f"left_{_kind}", residual=richer))
    registered(f"SELECT {RIGHT_ONLY} FROM {R} WHERE {_not}EXISTS (SELECT 1 FROM {L} WHERE {FULL_MATCH})", f"join_residual_right_{_kind}")(join_query(f"right_{_kind}", residual=richer))


@registered("SELECT o_totalprice, o_orderkey, c_mktsegment, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey")
def join_output_select(spark, sf):
    return hash_join(load(spark, sf, "orders"), load(spark, sf, "customer"), ["o_custkey"], ["c_custkey"], left_output=["o_totalprice", "o_orderkey"], right_output=["c_mktsegment", "c_custkey"])


@registered("SELECT o_orderkey, c_custkey, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_left_deep(spark, sf):
    out = hash_join(load(spark, sf, "orders"), load(spark, sf, "customer"), ["o_custkey"], ["c_custkey"], left_output=["o_orderkey"], right_output=["c_custkey", "c_nationkey"])
    out = hash_join(out, load(spark, sf, "nation"), ["c_nationkey"], ["n_nationkey"], left_output=["o_orderkey", "c_custkey"], right_output=["n_name", "n_regionkey"])
    return hash_join(out, load(spark, sf, "region"), ["n_regionkey"], ["r_regionkey"], left_output=["o_orderkey", "c_custkey", "n_name"], right_output=["r_name"])


@registered("""SELECT o_orderkey, o_totalprice, c_custkey, n_name, r_name FROM orders
    RIGHT JOIN (SELECT c_custkey, n_name, r_name FROM customer JOIN (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey) ON c_nationkey = n_nationkey) ON o_custkey = c_custkey""")
def join_right_deep(spark, sf):
    inner = hash_join(load(spark, sf, "nation"), load(spark, sf, "region"), ["n_regionkey"], ["r_regionkey"], left_output=["n_nationkey", "n_name"], right_output=["r_name"])
    inner = hash_join(load(spark, sf, "customer"), inner, ["c_nationkey"], ["n_nationkey"], left_output=["c_custkey"], right_output=["n_name", "r_name"])
    return hash_join(load(spark, sf, "orders"), inner, ["o_custkey"], ["c_custkey"], "right_outer", left_output=["o_orderkey", "o_totalprice"])


@registered("SELECT a.s_name AS s_name_a, b.s_name AS s_name_b, a.s_nationkey AS s_nationkey FROM supplier AS a JOIN supplier AS b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def join_self(spark, sf):
    s = load(spark, sf, "supplier")
    joined = hash_join(s, s, ["s_nationkey"], ["s_nationkey"], left_output=["s_name", "s_nationkey"], right_output=["s_name"], suffixes=("_a", "_b"), residual=lambda l, r: l("s_suppkey") < r("s_suppkey"))
    return joined


@registered(f"SELECT {BOTH} FROM {L} JOIN (SELECT * FROM {R} WHERE FALSE) AS r ON l.ck = r.k")
def join_empty_build(spark, sf):
    return hash_join(left_orders(spark, sf), right_customers(spark, sf).where("false"), ["ck"], ["k"])


@registered(f"SELECT {LEFT_ONLY} FROM {L}")
def join_anti_empty_build(spark, sf):
    return hash_join(left_orders(spark, sf), right_customers(spark, sf).where("false"), ["ck"], ["k"], "left_anti")


# ------------------------------------------------------------------ aggregates

#: A place for each line item, the same for equal items only.
PLACE = "(l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey * 10 + l_suppkey % 10)"
#: Line items with some nulls; q is whole, d has two decimals, price is exact, flag is boolean.
ITEMS = """(SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_shipdate,
    CASE WHEN l_linenumber = 3 THEN NULL ELSE CAST(l_quantity AS BIGINT) END AS q,
    CASE WHEN l_linenumber = 5 THEN NULL ELSE CAST(l_extendedprice AS DECIMAL(12,2)) END AS price,
    CASE WHEN l_linenumber = 2 THEN NULL ELSE l_discount > 0.05 END AS flag,
    CASE WHEN l_linenumber = 4 THEN NULL ELSE l_discount END AS d, l_partkey, l_suppkey FROM lineitem)"""


def items(spark, sf):
    rows = load(spark, sf, "lineitem")
    return rows.select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate",
        F.expr("CASE WHEN l_linenumber = 3 THEN NULL ELSE CAST(l_quantity AS BIGINT) END").alias("q"),
        F.expr("CASE WHEN l_linenumber = 5 THEN NULL ELSE CAST(l_extendedprice AS DECIMAL(12,2)) END").alias("price"),
        F.expr("CASE WHEN l_linenumber = 2 THEN NULL ELSE l_discount > 0.05 END").alias("flag"),
        F.expr("CASE WHEN l_linenumber = 4 THEN NULL ELSE l_discount END").alias("d"),
        F.expr(PLACE).alias("place"),
    )


#: function -> [(targets, options, output, SQL)]; one query each, scalar and grouped by return flag.
SHOWN = {
    "count": [("q", {}, "v", "count(q)"), ("q", {"mode": "only_null"}, "nulls", "count(*) - count(q)"), ("q", {"mode": "all"}, "n", "count(*)")],
    "count_all": [((), {}, "n", "count(*)")],
    "count_distinct": [("q", {}, "v", "count(DISTINCT q)"), ("q", {"mode": "all"}, "n", "count(DISTINCT q) + max(CASE WHEN q IS NULL THEN 1 ELSE 0 END)")],
    "sum": [("q", {}, "v", "CAST(sum(q) AS BIGINT)"), ("price", {}, "p", "CAST(sum(price) AS DECIMAL(38,2))"), ("q", {"skip_nulls": False}, "strict", "CASE WHEN count(*) = count(q) THEN CAST(sum(q) AS BIGINT) END")],
    "mean": [("q", {}, "v", "avg(q)")],
    "min": [("q", {}, "v", "min(q)"), ("l_shipdate", {}, "t", "min(l_shipdate)")],
    "max": [("q", {}, "v", "max(q)"), ("price", {}, "p", "max(price)")],
    "any": [("flag", {}, "v", "bool_or(flag)")],
    "all": [("flag", {}, "v", "bool_and(flag)")],
    "variance": [("q", {}, "v", "var_pop(q)"), ("q", {"ddof": 1}, "s", "var_samp(q)")],
    "stddev": [("q", {}, "v", "stddev_pop(q)"), ("q", {"ddof": 1}, "s", "stddev_samp(q)")],
    "approximate_median": [("q", {"exact": True}, "v", "CAST(median(q) AS DOUBLE)")],
    "first": [("q", {"order_by": "place"}, "v", f"arg_min(q, {PLACE}) FILTER (WHERE q IS NOT NULL)")],
    "last": [("q", {"order_by": "place"}, "v", f"arg_max(q, {PLACE}) FILTER (WHERE q IS NOT NULL)")],
}
ROUNDED = {"mean", "variance", "stddev"}


def shown(function: str, grouped: bool) -> None:
    entries = SHOWN[function]
    keys = ["l_returnflag"] if grouped else []
    aggregates = [Agg(f"hash_{function}" if grouped else function, c, name, o) for c, o, name, _ in entries]

    def run(spark, sf):
        out = aggregate(items(spark, sf), keys, aggregates)
        return out.withColumns({n: F.round(n, 6) for _, _, n, _ in entries}) if function in ROUNDED else out

    sql = ", ".join(f"{f'round({s}, 6)' if function in ROUNDED else s} AS {n}" for _, _, n, s in entries)
    registered(f"SELECT {'l_returnflag, ' if grouped else ''}{sql} FROM {ITEMS}{' GROUP BY l_returnflag' if grouped else ''}", f"agg_{'hash' if grouped else 'scalar'}_{function}")(run)


for _function in SHOWN:
    for _grouped in (False, True):
        shown(_function, _grouped)


def shaped(name: str, select: Callable[[], list], sql: str, both: bool = True, only_grouped: bool = False) -> None:
    """Queries whose result is a struct, an array or another shape: select() gives [aggregates, output columns]."""

    def run(grouped: bool) -> Query:
        def query(spark, sf):
            aggregates, columns = select()
            aggregates = [Agg(("hash_" if grouped else "") + a.function, a.columns, a.name, a.options) for a in aggregates]
            return aggregate(items(spark, sf), ["l_returnflag"] if grouped else [], aggregates).select(*(["l_returnflag"] if grouped else []), *columns)

        return query

    if not only_grouped:
        registered(f"SELECT {sql} FROM {ITEMS}", f"agg_scalar_{name}")(run(False))
    if both:
        registered(f"SELECT l_returnflag, {sql} FROM {ITEMS} GROUP BY l_returnflag", f"agg_hash_{name}")(run(True))


shaped("min_max", lambda: ([Agg("min_max", "q", "m")], [F.col("m.min").alias("low"), F.col("m.max").alias("high")]), "min(q) AS low, max(q) AS high")
shaped("first_last", lambda: ([Agg("first_last", "q", "m", {"order_by": "place"})], [F.col("m.first").alias("f"), F.col("m.last").alias("l")]), f"arg_min(q, {PLACE}) FILTER (WHERE q IS NOT NULL) AS f, arg_max(q, {PLACE}) FILTER (WHERE q IS NOT NULL) AS l")
shaped("tdigest", lambda: ([Agg("tdigest", "q", "m", {"q": (0.25, 0.9), "exact": True})], [F.round(F.col("m")[0], 6).alias("q25"), F.round(F.col("m")[1], 6).alias("q90")]), "round(quantile_cont(q, 0.25), 6) AS q25, round(quantile_cont(q, 0.9), 6) AS q90")
shaped("skew", lambda: ([Agg("skew", "q", "v")], [F.round("v", 6).alias("v")]), "round((avg(q*q*q) - 3*avg(q)*avg(q*q) + 2*avg(q)*avg(q)*avg(q)) / pow(avg(q*q) - avg(q)*avg(q), 1.5), 6) AS v")
shaped("kurtosis", lambda: ([Agg("kurtosis", "q", "v")], [F.round("v", 6).alias("v")]), "round(kurtosis_pop(q), 6) AS v")
shaped("index", lambda: ([Agg("index", "q", "v", {"value": 17, "position": "place"}), Agg("index", "q", "missing", {"value": -5, "position": "place"})], ["v", "missing"]), f"CAST(coalesce(min(CASE WHEN q = 17 THEN {PLACE} END), -1) AS BIGINT) AS v, CAST(-1 AS BIGINT) AS missing", both=False)
shaped("distinct", lambda: ([Agg("distinct", "q", "v"), Agg("distinct", "q", "n", {"mode": "all"})], [F.concat_ws(",", "v").alias("v"), F.size("n").alias("n")]), "array_to_string(list_sort(list(DISTINCT q) FILTER (WHERE q IS NOT NULL)), ',') AS v, CAST(count(DISTINCT q) + max(CASE WHEN q IS NULL THEN 1 ELSE 0 END) AS INTEGER) AS n", only_grouped=True)


@registered(f"SELECT l_orderkey, CAST(count(*) AS INTEGER) AS n, array_to_string(list_sort(list(coalesce(q, -1))), ',') AS v FROM {ITEMS} GROUP BY l_orderkey")
def agg_hash_list(spark, sf):
    out = aggregate(items(spark, sf), ["l_orderkey"], [Agg("hash_list", "q", "all")])
    return out.select("l_orderkey", F.size("all").alias("n"), F.concat_ws(",", F.array_sort(F.transform("all", lambda x: F.coalesce(x, F.lit(-1))))).alias("v"))


LINES = tuple(range(1, 8))


@registered(f"SELECT l_orderkey, {', '.join(f'max(CASE WHEN l_linenumber = {k} THEN q END) AS q{k}' for k in LINES)} FROM {ITEMS} GROUP BY l_orderkey")
def agg_hash_pivot_wider(spark, sf):
    """Numbers repeat within an order, and a second value for a key would be an error: each number's greatest comes first."""
    lines = aggregate(items(spark, sf), ["l_orderkey", "l_linenumber"], [Agg("hash_max", "q", "q")])
    out = aggregate(lines, ["l_orderkey"], [Agg("hash_pivot_wider", ("l_linenumber", "q"), "p", {"key_names": LINES})])
    return out.select("l_orderkey", *[F.col("p")[str(k)].alias(f"q{k}") for k in LINES])


@registered("SELECT max(CASE WHEN n_name = 'FRANCE' THEN n_regionkey END) AS france, max(CASE WHEN n_name = 'CHINA' THEN n_regionkey END) AS china, CAST(NULL AS BIGINT) AS nowhere FROM nation")
def agg_scalar_pivot_wider(spark, sf):
    out = aggregate(load(spark, sf, "nation"), [], [Agg("pivot_wider", ("n_name", "n_regionkey"), "p", {"key_names": ("FRANCE", "CHINA", "NOWHERE")})])
    return out.select(F.col("p.FRANCE").alias("france"), F.col("p.CHINA").alias("china"), F.col("p.NOWHERE").cast("long").alias("nowhere"))


def rank_shares(spark, sf, keys: list[str]) -> DataFrame:
    """The share of prices up to each default (approximate) quantile: it differs from the quantile by 0.001 at most."""
    rows = load(spark, sf, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("price"))
    pre = "hash_" if keys else ""
    found = aggregate(rows, keys, [Agg(f"{pre}approximate_median", "price", "median"), Agg(f"{pre}tdigest", "price", "q", {"q": (0.1, 0.99)})])
    if keys:
        both = rows.join(F.broadcast(found), keys)  # a row for each flag
    else:
        one = found.first()
        both = rows.withColumns({"median": F.lit(one.median), "q": F.array(*map(F.lit, one.q))})
    share = lambda q: F.avg((F.col("price") <= q).cast("double"))
    near = lambda q, p: (F.abs(share(q) - p) <= 0.001 + 2 / F.count(F.lit(1)))
    return both.groupBy(*keys).agg(near(F.col("median"), 0.5).alias("median"), near(F.col("q")[0], 0.1).alias("q10"), near(F.col("q")[1], 0.99).alias("q99"))


@registered("SELECT l_returnflag, TRUE AS median, TRUE AS q10, TRUE AS q99 FROM lineitem GROUP BY l_returnflag")
def agg_hash_default_quantiles(spark, sf):
    return rank_shares(spark, sf, ["l_returnflag"])


@registered("SELECT TRUE AS median, TRUE AS q10, TRUE AS q99")
def agg_scalar_default_quantiles(spark, sf):
    return rank_shares(spark, sf, [])


@registered("SELECT l_orderkey, any_value(o_custkey) AS one FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey")
def agg_hash_one(spark, sf):
    joined = hash_join(load(spark, sf, "lineitem"), load(spark, sf, "orders"), ["l_orderkey"], ["o_orderkey"], left_output=["l_orderkey"], right_output=["o_custkey"])
    return aggregate(joined, ["l_orderkey"], [Agg("hash_one", "o_custkey", "one")])


SIGN = "CASE WHEN l_linenumber = 3 THEN NULL WHEN l_quantity > 25 THEN -1 ELSE 1 END"


@registered(f"SELECT CAST(product({SIGN}) AS BIGINT) AS v, CAST(product(CASE WHEN l_orderkey = 1 THEN l_linenumber ELSE {SIGN} END) AS BIGINT) AS w FROM lineitem")
def agg_scalar_product(spark, sf):
    rows = load(spark, sf, "lineitem").select(F.expr(SIGN).alias("sign"), F.expr(f"CASE WHEN l_orderkey = 1 THEN l_linenumber ELSE {SIGN} END").alias("few"))
    return aggregate(rows, [], [Agg("product", "sign", "v"), Agg("product", "few", "w")])


@registered("SELECT l_orderkey, CAST(product(l_linenumber) AS BIGINT) AS v FROM lineitem GROUP BY l_orderkey")
def agg_hash_product(spark, sf):
    return aggregate(load(spark, sf, "lineitem"), ["l_orderkey"], [Agg("hash_product", "l_linenumber", "v")])


@registered(f"SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(q) AS BIGINT) AS v FROM {ITEMS} GROUP BY ALL")
def agg_multi_key(spark, sf):
    return aggregate(items(spark, sf), ["l_returnflag", "l_linestatus"], [Agg("hash_count_all", name="n"), Agg("hash_sum", "q", "v")])


@registered("SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL")
def agg_more_keys_than_aggs(spark, sf):
    return aggregate(load(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"], [Agg("hash_count_all", name="n")])


@registered(f"SELECT q, count(*) AS n, CAST(sum(price) AS DECIMAL(38,2)) AS v FROM {ITEMS} GROUP BY q")
def agg_null_key(spark, sf):
    return aggregate(items(spark, sf), ["q"], [Agg("hash_count_all", name="n"), Agg("hash_sum", "price", "v")])


@registered(f"SELECT count(q) AS n, CAST(sum(q) AS BIGINT) AS v, max(price) AS m FROM {ITEMS} WHERE FALSE")
def agg_empty_scalar(spark, sf):
    return aggregate(items(spark, sf).where("false"), [], [Agg("count", "q", "n"), Agg("sum", "q", "v"), Agg("max", "price", "m")])


@registered(f"SELECT l_returnflag, count(q) AS n FROM {ITEMS} WHERE FALSE GROUP BY l_returnflag")
def agg_empty_grouped(spark, sf):
    return aggregate(items(spark, sf).where("false"), ["l_returnflag"], [Agg("hash_count", "q", "n")])


@registered("SELECT o_orderpriority, count(*) AS n, CAST(sum(lines) AS BIGINT) AS lines FROM orders JOIN (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey GROUP BY o_orderpriority")
def agg_then_join(spark, sf):
    lines = aggregate(load(spark, sf, "lineitem"), ["l_orderkey"], [Agg("hash_count_all", name="lines")])
    joined = hash_join(load(spark, sf, "orders"), lines, ["o_orderkey"], ["l_orderkey"], left_output=["o_orderpriority"], right_output=["lines"])
    return aggregate(joined, ["o_orderpriority"], [Agg("hash_count_all", name="n"), Agg("hash_sum", "lines", "lines")])


@registered("SELECT lines, count(*) AS n FROM (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY l_orderkey) GROUP BY lines")
def agg_then_agg(spark, sf):
    lines = aggregate(load(spark, sf, "lineitem"), ["l_orderkey"], [Agg("hash_count_all", name="lines")])
    return aggregate(lines, ["lines"], [Agg("hash_count_all", name="n")])


# ------------------------------------------------------------------ pipelines

KEYS = {"customer": "c_nationkey", "supplier": "s_nationkey"}


def keyed(spark, sf, table: str) -> DataFrame:
    return load(spark, sf, table).select(F.col(KEYS[table]).alias("nation"), F.col(f"{table[0]}_acctbal").alias("balance"), F.lit(table).alias("origin"))


@registered("SELECT c_nationkey AS nation, c_acctbal AS balance, 'customer' AS origin FROM customer UNION ALL SELECT s_nationkey, s_acctbal, 'supplier' FROM supplier")
def union_all_channels(spark, sf):
    return Pipeline("accounts", [Channel(t, keyed(spark, sf, t)) for t in KEYS]).compile()


SHARED = "(SELECT c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier)"


@registered(f"SELECT nation, balance, n_name FROM {SHARED} RIGHT JOIN nation ON nation = n_nationkey")
def union_shared_right_join(spark, sf):
    pipe = join_pipe("nations", load(spark, sf, "nation"), ["nation"], ["n_nationkey"], "right_outer", right_output=["n_name"])
    return Pipeline("shared", [Channel(t, keyed(spark, sf, t).drop("origin"), [pipe]) for t in KEYS]).compile()


@registered("SELECT 'source customer' AS point, count(*) AS n FROM customer UNION ALL SELECT 'source supplier', count(*) FROM supplier UNION ALL SELECT 'sink', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)")
def pipeline_observed(spark, sf):
    """What an observer saw while the rows of a pipeline were computed once and kept nowhere."""
    observer = Observer()
    black_hole(Pipeline("accounts", [Channel(t, keyed(spark, sf, t)) for t in KEYS]).compile(observer))
    return spark.createDataFrame([(point, found["rows"]) for point, found in observer.seen().items()], "point string, n long")


EIGHT = [("orders", "o_custkey"), ("orders", "o_custkey"), ("lineitem", "l_suppkey"), ("lineitem", "l_suppkey"), ("lineitem", "l_partkey"), ("lineitem", "l_partkey"), ("events", "user_id"), ("events", "user_id")]
SIDES = {"o_custkey": ("customer", "c_custkey"), "l_suppkey": ("supplier", "s_suppkey"), "l_partkey": ("part", "p_partkey"), "user_id": ("customer", "c_custkey")}


def eight_sql() -> str:
    source = lambda i: f"SELECT {EIGHT[i][1]} AS k FROM {EIGHT[i][0]}"
    joined = lambda body, t, key: f"SELECT k, {key} AS j FROM ({body}) RIGHT JOIN {t} ON k = {key}"
    # Sources 0..3 have joins of their own; 4 and 5, and 6 and 7, share one; all meet in one sink.
    groups = ((0,), (1,), (2,), (3,), (4, 5), (6, 7))
    return " UNION ALL ".join(joined(" UNION ALL ".join(map(source, g)), *SIDES[EIGHT[g[0]][1]]) for g in groups)


@registered(f"SELECT j, count(*) AS n, count(k) AS matched FROM ({eight_sql()}) GROUP BY j")
def union_of_right_joins(spark, sf):
    """Eight sources and six right joins, two of them shared, before one aggregate."""

    def pipe(i):
        table, key = SIDES[EIGHT[i][1]]
        return join_pipe(f"join{i}", load(spark, sf, table).select(F.col(key).alias("j")), ["k"], ["j"], "right_outer")

    pipes = {i: pipe(i) for i in (0, 1, 2, 3, 4, 6)}
    pipes |= {5: pipes[4], 7: pipes[6]}
    sink = lambda df: aggregate(df, ["j"], [Agg("hash_count_all", name="n"), Agg("hash_count", "k", "matched")])
    sources = [load(spark, sf, table).select(F.col(key).alias("k")) for table, key in EIGHT]
    return Pipeline("eight", [Channel(f"s{i}", sources[i], [pipes[i]]) for i in range(8)], sink).compile()


@registered("SELECT o_orderkey AS k, o_totalprice AS v FROM orders UNION ALL SELECT o_orderkey, -o_totalprice FROM orders")
def union_map_pipes(spark, sf):
    orders = load(spark, sf, "orders")
    signed = lambda name, sign: map_pipe(name, lambda df: df.select(F.col("o_orderkey").alias("k"), (sign * F.col("o_totalprice")).alias("v")))
    return Pipeline("maps", [Channel("plus", orders, [signed("plus", 1)]), Channel("minus", orders, [signed("minus", -1)])]).compile()


# ------------------------------------------------------------------ transforms


@registered("SELECT o_orderkey, o_totalprice * 2 AS doubled, upper(o_orderpriority) AS priority FROM orders")
def project_rows(spark, sf):
    return project(load(spark, sf, "orders"), "o_orderkey", "o_totalprice * 2 AS doubled", "upper(o_orderpriority) AS priority")


FOUND["project"] = FOUND.pop("project_rows")


@registered("SELECT n_nationkey, n_name FROM nation, range(3)")
def repeat_nation_rows(spark, sf):
    return repeat_rows(load(spark, sf, "nation").select("n_nationkey", "n_name"), 3)


FOUND["repeat_rows"] = FOUND.pop("repeat_nation_rows")


@registered("SELECT r_name FROM region, range(4)")
def source_every_lane(spark, sf):
    return every_lane(load(spark, sf, "region").select("r_name"), 4)


@registered("SELECT o_orderkey, CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / ceil((SELECT count(*) FROM orders) / 3.0)) AS INTEGER) AS lane, CAST(floor(((row_number() OVER (ORDER BY o_orderkey) - 1) % CAST(ceil((SELECT count(*) FROM orders) / 3.0) AS BIGINT)) / 100) AS INTEGER) AS slice FROM orders")
def source_parallel(spark, sf):
    return parallel_source(load(spark, sf, "orders").select("o_orderkey"), 3, ["o_orderkey"], 100)


@registered("SELECT batch_id, count(*) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high FROM (SELECT o_orderkey, CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 64) AS BIGINT) AS batch_id FROM orders) GROUP BY batch_id")
def rebatch(spark, sf):
    rows = batches_of(load(spark, sf, "orders").select("o_orderkey"), 64, ["o_orderkey"])
    return rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))


@registered("SELECT o_orderpriority, batch_id, count(*) AS n FROM (SELECT o_orderpriority, CAST(floor((row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) / 50) AS BIGINT) AS batch_id FROM orders) GROUP BY ALL")
def rebatch_lanes(spark, sf):
    rows = batches_of(load(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), 50, ["o_orderkey"], lane="o_orderpriority")
    return rows.groupBy("o_orderpriority", "batch_id").agg(F.count(F.lit(1)).alias("n"))


@registered("SELECT c_acctbal, c_custkey FROM customer ORDER BY c_acctbal ASC NULLS FIRST, c_custkey")
def sort_global(spark, sf):
    return sort_rows(load(spark, sf, "customer").select("c_acctbal", "c_custkey"), "c_acctbal", "c_custkey")


@registered("WITH RECURSIVE s(i, v, w) AS (SELECT 1, CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT i + 1, w, v + w FROM s WHERE i < 42) SELECT i, v FROM s", "recursive_series")
def fibonacci(spark, sf):
    return recursive_series(spark, 42)


@registered("SELECT CAST(1 AS BIGINT) AS v")
def source_single_row(spark, sf):
    return single_row(spark)


# ------------------------------------------------------------------ streams


def own_folder(spark) -> str:
    return f"{shared_folder(spark)}/lumenfold-stream-{uuid.uuid4().hex}"


@registered("SELECT event_id, user_id, event_type, value FROM events WHERE value > 50")
def stream_available_now(spark, sf):
    """The events as a stream of files: bounded triggers, exactly once, ending with the input."""
    folder, table = own_folder(spark), load(spark, sf, "events")
    stream = file_stream(spark, f"{sf}/events.parquet*", table.schema)
    return available_to_table(stream.where("value > 50").select("event_id", "user_id", "event_type", "value"), f"{folder}/out", f"{folder}/state")


@registered("SELECT event_type, count(*) AS n, count(DISTINCT user_id % 8) AS lanes FROM events GROUP BY event_type")
def stream_aggregate(spark, sf):
    folder, table = own_folder(spark), load(spark, sf, "events")
    stream = file_stream(spark, f"{sf}/events.parquet*", table.schema)
    aggregates = [F.count(F.lit(1)).alias("n"), F.size(F.collect_set(F.col("user_id") % 8)).cast("long").alias("lanes")]
    return available_aggregate(stream, ["event_type"], aggregates, f"{folder}/out", f"{folder}/state")


@registered("SELECT reader, n_nationkey, n_name FROM nation, (VALUES ('one'), ('two')) AS t(reader)")
def stream_produced(spark, sf):
    """All nations, put batch by batch by a producer that waits for two readers, each of which gets every row once."""
    nations = load(spark, sf, "nation").select("n_nationkey", "n_name")
    folder = own_folder(spark)
    source = Produced(spark, "n_nationkey long, n_name string", folder, ["one", "two"], capacity=2)
    errors = []

    def read(name):
        try:
            source.consume(name, lambda batch, number: batch.withColumn("reader", F.lit(name)).write.mode("overwrite").parquet(f"{folder}/out/{name}-{number:05d}"))
        except Exception as e:  # noqa: BLE001  raised below, where the caller sees it
            errors.append(e)

    readers = [threading.Thread(target=read, args=(name,)) for name in ("one", "two")]
    for r in readers:
        r.start()
    try:
        for k in range(4):
            source.put(nations.where(F.pmod("n_nationkey", F.lit(4)) == k))
        source.close()
    except BaseException as e:
        source.fail(e)
        raise
    finally:
        for r in readers:
            r.join()
    if errors:
        raise errors[0]
    return spark.read.schema("n_nationkey long, n_name string, reader string").parquet(f"{folder}/out/*")
