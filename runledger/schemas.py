"""Declared schemas: nothing in this package infers a schema from data."""

from pyspark.sql import types as T

_INT = T.IntegerType()
_STR = T.StringType()
_DATE = T.DateType()
_MONEY = T.DecimalType(15, 2)


def _table(*fields):
    return T.StructType([T.StructField(name, kind, null) for name, kind, null in fields])


# The eight benchmark tables, their column order, types and
# nullability. Column order matters, joins name their keys by position.
TPCH = {
    "region": _table(
        ("r_regionkey", _INT, False), ("r_name", _STR, False), ("r_comment", _STR, True)),
    "nation": _table(
        ("n_nationkey", _INT, False), ("n_name", _STR, False),
        ("n_regionkey", _INT, False), ("n_comment", _STR, True)),
    "customer": _table(
        ("c_custkey", _INT, False), ("c_name", _STR, False), ("c_address", _STR, True),
        ("c_nationkey", _INT, False), ("c_phone", _STR, True), ("c_acctbal", _MONEY, True),
        ("c_mktsegment", _STR, True), ("c_comment", _STR, True)),
    "orders": _table(
        ("o_orderkey", _INT, False), ("o_custkey", _INT, False), ("o_orderstatus", _STR, True),
        ("o_totalprice", _MONEY, True), ("o_orderdate", _DATE, False),
        ("o_orderpriority", _STR, True), ("o_clerk", _STR, True),
        ("o_shippriority", _INT, True), ("o_comment", _STR, True)),
    "part": _table(
        ("p_partkey", _INT, False), ("p_name", _STR, False), ("p_mfgr", _STR, True),
        ("p_brand", _STR, True), ("p_type", _STR, True), ("p_size", _INT, True),
        ("p_container", _STR, True), ("p_retailprice", _MONEY, True), ("p_comment", _STR, True)),
    "supplier": _table(
        ("s_suppkey", _INT, False), ("s_name", _STR, False), ("s_address", _STR, True),
        ("s_nationkey", _INT, False), ("s_phone", _STR, True), ("s_acctbal", _MONEY, True),
        ("s_comment", _STR, True)),
    "partsupp": _table(
        ("ps_partkey", _INT, False), ("ps_suppkey", _INT, False), ("ps_availqty", _INT, False),
        ("ps_supplycost", _MONEY, True), ("ps_comment", _STR, True)),
    "lineitem": _table(
        ("l_orderkey", _INT, False), ("l_partkey", _INT, False), ("l_suppkey", _INT, False),
        ("l_linenumber", _INT, False), ("l_quantity", _MONEY, True),
        ("l_extendedprice", _MONEY, True), ("l_discount", _MONEY, True), ("l_tax", _MONEY, True),
        ("l_returnflag", _STR, True), ("l_linestatus", _STR, True), ("l_shipdate", _DATE, False),
        ("l_commitdate", _DATE, False), ("l_receiptdate", _DATE, False),
        ("l_shipinstruct", _STR, True), ("l_shipmode", _STR, True), ("l_comment", _STR, True)),
}

# Keys outgrow 32 bits from about scale factor 350 on; these columns are read
# and generated as long when the caller asks for wide keys.
WIDE_KEYS = ("o_orderkey", "o_custkey", "c_custkey", "p_partkey", "s_suppkey", "ps_partkey",
             "ps_suppkey", "l_orderkey", "l_partkey", "l_suppkey")


def tpch(table, wide_keys=False):
    schema = TPCH[table]
    if not wide_keys:
        return schema
    return T.StructType([
        T.StructField(f.name, T.LongType() if f.name in WIDE_KEYS else f.dataType, f.nullable)
        for f in schema.fields])


# One parameter specification document.
SPEC_PROPERTY = T.StructType([
    T.StructField(name, _STR)
    for name in ("name", "type", "numvalues", "value_delimitter", "values",
                 "delete_on_exit", "description")])
SPEC_DOCUMENT = T.StructType([T.StructField("property", T.ArrayType(SPEC_PROPERTY))])

# A job configuration file.
CONF_PROPERTY = T.StructType([T.StructField("name", _STR), T.StructField("value", _STR)])
CONF_DOCUMENT = T.StructType([T.StructField("property", T.ArrayType(CONF_PROPERTY))])

MANIFEST = T.StructType([T.StructField("expt_id", _STR), T.StructField("job_id", _STR)])

WIKI_PAGE = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("title", _STR),
    T.StructField("revision", T.StructType([T.StructField("text", _STR)])),
])
