"""Readers of the tables, and the property graph that the star schema stands for.

Nodes: id, name, labels. Edges: src, dst, type, when (an edge's date), status. Work
orders are orders, equipment is part, people are customers, vendors and managers are
suppliers, places are nations and regions; dates, costs, states, quantities and
inspections are nodes of their own. All rules are projections of the base tables, so a
filter on an edge type reaches the one branch that makes it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt by a key to as many tasks as shuffles have: a file of one row group is read by one task, which must not do the work on it too."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


#: Node kinds: prefix of the id, and labels (fixed values).
LABELS = {
    "wo": ["Entity", "WorkOrder", "Invoice"],
    "pt": ["Entity", "Equipment", "Part"],
    "cu": ["Entity", "Person", "Technician"],
    "su": ["Entity", "Vendor", "Company", "Manager"],
    "na": ["Entity", "Location", "Site"],
    "re": ["Entity", "Location", "Site"],
    "dt": ["Entity", "Date"],
    "co": ["Entity", "Cost"],
    "st": ["Entity", "Status"],
    "qt": ["Entity", "Value"],
    "in": ["Entity", "Inspection"],
}


def _id(kind: str, c) -> F.Column:
    return F.concat(F.lit(kind + ":"), (F.col(c) if isinstance(c, str) else c).cast("string"))


def _date(c: str):
    return F.date_format(F.col(c), "yyyy-MM-dd")


def _cost(c: str):
    return F.format_string("%.2f", F.col(c))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)

    def kind(k, df, key, name):
        return df.select(_id(k, key).alias("id"), name.alias("name"), F.array(*map(F.lit, LABELS[k])).alias("labels"))

    orders, lines = t("orders"), t("lineitem")
    parts = [
        kind("wo", orders, "o_orderkey", F.concat(F.lit("WO-"), F.col("o_orderkey").cast("string"))),
        kind("pt", t("part"), "p_partkey", F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string"))),
        kind("cu", t("customer"), "c_custkey", F.col("c_name")),
        kind("su", t("supplier"), "s_suppkey", F.col("s_name")),
        kind("na", t("nation"), "n_nationkey", F.col("n_name")),
        kind("re", t("region"), "r_regionkey", F.col("r_name")),
        kind("dt", orders.select(_date("o_orderdate").alias("d")).distinct(), "d", F.col("d")),
        kind("co", orders.select(_cost("o_totalprice").alias("c")).distinct(), "c", F.col("c")),
        kind("st", orders.select("o_orderstatus").distinct(), "o_orderstatus", F.col("o_orderstatus")),
        kind("qt", t("part").select("p_size").distinct(), "p_size", F.col("p_size").cast("string")),
        kind("in", lines.filter("l_returnflag = 'R'").select(_inspection().alias("i")).distinct(), "i", F.concat(F.lit("INS-"), F.col("i"))),
    ]
    return reduce(DataFrame.unionByName, parts)


def _inspection():
    return F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string"))


#: Edge types of the rules.
TYPES = (
    "ASSIGNED_TO", "PERFORMED_ON", "USED_PART", "APPROVED_BY", "COMPLETED_ON", "SCHEDULED_FOR", "HAS_TOTAL_COST", "HAS_STATUS", "LOCATED_IN", "CONTAINS",
    "PROVIDES", "PERFORMED_AT", "SCHEDULED_AT", "USED_IN", "MANAGED_BY", "HAS_QUANTITY", "LOCATED_AT", "INSPECTED_IN",
)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)

    def kind(df, src, type_, dst, when=None, status=None):
        null = F.lit(None).cast("string")
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(type_).alias("type"), (null if when is None else when).alias("when"), (null if status is None else status).alias("status"))

    orders, lines, cust, supp, part, nation = map(t, ("orders", "lineitem", "customer", "supplier", "part", "nation"))
    wo, cu = _id("wo", "o_orderkey"), _id("cu", "o_custkey")
    first = lines.groupBy("l_orderkey").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    used = lines.select("l_orderkey", "l_partkey").distinct()
    done, other = orders.filter("o_orderstatus = 'F'"), orders.filter("o_orderstatus <> 'F'")
    placed = orders.join(cust, orders["o_custkey"] == cust["c_custkey"])
    stock = lines.groupBy("l_partkey").agg(F.min("l_suppkey").alias("s")).join(supp, F.col("s") == supp["s_suppkey"])
    l_wo, l_pt = _id("wo", "l_orderkey"), _id("pt", "l_partkey")
    returned = lines.filter("l_returnflag = 'R'")
    parts = [
        kind(orders, wo, "ASSIGNED_TO", cu),
        kind(first, l_wo, "PERFORMED_ON", _id("pt", "p")),
        kind(used, l_wo, "USED_PART", l_pt),
        kind(first, l_wo, "APPROVED_BY", _id("su", "s")),
        kind(done, wo, "COMPLETED_ON", _id("dt", _date("o_orderdate"))),
        kind(other, wo, "SCHEDULED_FOR", _id("dt", _date("o_orderdate"))),
        kind(orders, wo, "HAS_TOTAL_COST", _id("co", _cost("o_totalprice"))),
        kind(orders, wo, "HAS_STATUS", _id("st", "o_orderstatus")),
        kind(cust, _id("cu", "c_custkey"), "LOCATED_IN", _id("na", "c_nationkey")),
        kind(supp, _id("su", "s_suppkey"), "LOCATED_IN", _id("na", "s_nationkey")),
        kind(nation, _id("na", "n_nationkey"), "LOCATED_IN", _id("re", "n_regionkey")),
        kind(nation, _id("re", "n_regionkey"), "CONTAINS", _id("na", "n_nationkey")),
        kind(cust, _id("na", "c_nationkey"), "CONTAINS", _id("cu", "c_custkey")),
        kind(supp, _id("na", "s_nationkey"), "CONTAINS", _id("su", "s_suppkey")),
        kind(first, _id("su", "s"), "PROVIDES", l_wo),
        kind(placed, wo, "PERFORMED_AT", _id("na", "c_nationkey")),
        kind(placed, _id("na", "c_nationkey"), "SCHEDULED_AT", wo),
        kind(used, l_pt, "USED_IN", l_wo),
        kind(orders, cu, "MANAGED_BY", wo),
        kind(cust, _id("na", "c_nationkey"), "MANAGED_BY", _id("cu", "c_custkey")),
        kind(part, _id("pt", "p_partkey"), "HAS_QUANTITY", _id("qt", "p_size")),
        kind(stock, l_pt, "LOCATED_AT", _id("na", "s_nationkey")),
        kind(stock, _id("na", "s_nationkey"), "CONTAINS", l_pt),
        kind(returned, l_pt, "INSPECTED_IN", _id("in", _inspection()), _date("l_shipdate"), F.col("l_linestatus")),
    ]
    return reduce(DataFrame.unionByName, parts)


#: The same rules as SQL, for oracles: WITH nodes AS (...), edges AS (...).
_L = {k: "[" + ", ".join(f"'{x}'" for x in v) + "]" for k, v in LABELS.items()}
_INS = "l_orderkey::VARCHAR || '-' || l_partkey::VARCHAR || '-' || l_linenumber::VARCHAR"
_FIRST = "(SELECT l_orderkey, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY 1)"
_STOCK = "(SELECT l_partkey, s_nationkey FROM (SELECT l_partkey, min(l_suppkey) AS s FROM lineitem GROUP BY 1) JOIN supplier ON s = s_suppkey)"
_DAY, _PRICE = "strftime(o_orderdate, '%Y-%m-%d')", "printf('%.2f', o_totalprice)"
NODES_SQL = " UNION ALL ".join([
    f"SELECT 'wo:' || o_orderkey AS id, 'WO-' || o_orderkey AS name, {_L['wo']} AS labels FROM orders",
    f"SELECT 'pt:' || p_partkey, p_name || ' ' || p_partkey, {_L['pt']} FROM part",
    f"SELECT 'cu:' || c_custkey, c_name, {_L['cu']} FROM customer",
    f"SELECT 'su:' || s_suppkey, s_name, {_L['su']} FROM supplier",
    f"SELECT 'na:' || n_nationkey, n_name, {_L['na']} FROM nation",
    f"SELECT 're:' || r_regionkey, r_name, {_L['re']} FROM region",
    f"SELECT DISTINCT 'dt:' || {_DAY}, {_DAY}, {_L['dt']} FROM orders",
    f"SELECT DISTINCT 'co:' || {_PRICE}, {_PRICE}, {_L['co']} FROM orders",
    f"SELECT DISTINCT 'st:' || o_orderstatus, o_orderstatus, {_L['st']} FROM orders",
    f"SELECT DISTINCT 'qt:' || p_size, p_size::VARCHAR, {_L['qt']} FROM part",
    f"SELECT DISTINCT 'in:' || {_INS}, 'INS-' || {_INS}, {_L['in']} FROM lineitem WHERE l_returnflag = 'R'",
])


def _e(src, type_, dst, rows, when="NULL::VARCHAR", status="NULL::VARCHAR"):
    return f'SELECT {src} AS src, {dst} AS dst, \'{type_}\' AS type, {when} AS "when", {status} AS status FROM {rows}'


EDGES_SQL = " UNION ALL ".join([
    _e("'wo:' || o_orderkey", "ASSIGNED_TO", "'cu:' || o_custkey", "orders"),
    _e("'wo:' || l_orderkey", "PERFORMED_ON", "'pt:' || p", _FIRST),
    _e("'wo:' || l_orderkey", "USED_PART", "'pt:' || l_partkey", "(SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)"),
    _e("'wo:' || l_orderkey", "APPROVED_BY", "'su:' || s", _FIRST),
    _e("'wo:' || o_orderkey", "COMPLETED_ON", f"'dt:' || {_DAY}", "orders WHERE o_orderstatus = 'F'"),
    _e("'wo:' || o_orderkey", "SCHEDULED_FOR", f"'dt:' || {_DAY}", "orders WHERE o_orderstatus <> 'F'"),
    _e("'wo:' || o_orderkey", "HAS_TOTAL_COST", f"'co:' || {_PRICE}", "orders"),
    _e("'wo:' || o_orderkey", "HAS_STATUS", "'st:' || o_orderstatus", "orders"),
    _e("'cu:' || c_custkey", "LOCATED_IN", "'na:' || c_nationkey", "customer"),
    _e("'su:' || s_suppkey", "LOCATED_IN", "'na:' || s_nationkey", "supplier"),
    _e("'na:' || n_nationkey", "LOCATED_IN", "'re:' || n_regionkey", "nation"),
    _e("'re:' || n_regionkey", "CONTAINS", "'na:' || n_nationkey", "nation"),
    _e("'na:' || c_nationkey", "CONTAINS", "'cu:' || c_custkey", "customer"),
    _e("'na:' || s_nationkey", "CONTAINS", "'su:' || s_suppkey", "supplier"),
    _e("'su:' || s", "PROVIDES", "'wo:' || l_orderkey", _FIRST),
    _e("'wo:' || o_orderkey", "PERFORMED_AT", "'na:' || c_nationkey", "orders JOIN customer ON o_custkey = c_custkey"),
    _e("'na:' || c_nationkey", "SCHEDULED_AT", "'wo:' || o_orderkey", "orders JOIN customer ON o_custkey = c_custkey"),
    _e("'pt:' || l_partkey", "USED_IN", "'wo:' || l_orderkey", "(SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)"),
    _e("'cu:' || o_custkey", "MANAGED_BY", "'wo:' || o_orderkey", "orders"),
    _e("'na:' || c_nationkey", "MANAGED_BY", "'cu:' || c_custkey", "customer"),
    _e("'pt:' || p_partkey", "HAS_QUANTITY", "'qt:' || p_size", "part"),
    _e("'pt:' || l_partkey", "LOCATED_AT", "'na:' || s_nationkey", _STOCK),
    _e("'na:' || s_nationkey", "CONTAINS", "'pt:' || l_partkey", _STOCK),
    _e("'pt:' || l_partkey", "INSPECTED_IN", f"'in:' || {_INS}", "lineitem WHERE l_returnflag = 'R'", "strftime(l_shipdate, '%Y-%m-%d')", "l_linestatus"),
])
GRAPH_SQL = f"WITH RECURSIVE nodes AS ({NODES_SQL}), edges AS ({EDGES_SQL})"
