"""What every column of the generated benchmark tables may hold.

One condition per column, and the number of different values where the column
is a short list. Checked over all rows, so every column is really made.
"""

from pyspark.sql import functions as F

from runledger.sources import generate

# Two or three syllables of two or three letters.
WORD = "[a-z]{4,9}"
LAST_DAY = generate.DAYS


def _in(column, values):
    return F.col(column).isin(values), len(values)


def _between(column, low, high):
    return F.col(column).between(low, high), None


def _cents(column, low, high):
    cents = F.col(column).cast("double") * 100
    return F.col(column).between(low, high) & (F.abs(cents - F.round(cents)) < 1e-3), None


def _sentence(column, low, high):
    return F.col(column).rlike(f"^{WORD}( {WORD}){{{low - 1},{high - 1}}}$"), None


def _numbered(column, label, key):
    return F.col(column) == F.format_string(f"{label}#%09d", F.col(key).cast("long")), None


def _day(column, first, last):
    return F.datediff(column, F.lit(generate.FIRST_DAY).cast("date")).between(first, last), None


def _after(column, other, low, high):
    return F.datediff(column, other).between(low, high), None


def _phone(column):
    return F.col(column).rlike("^(1[0-9]|2[0-9]|3[0-4])(-[1-9][0-9]{2}){2}-[1-9][0-9]{3}$"), None


def domains(rows):
    """{table: {column: (condition, number of values or null)}} for tables of `rows` rows."""
    nations = len(generate.NATIONS)
    return {
        "region": {
            "r_regionkey": _between("r_regionkey", 0, len(generate.REGIONS) - 1), "r_name": _in("r_name", generate.REGIONS),
            "r_comment": _sentence("r_comment", 4, 9)},
        "nation": {
            "n_nationkey": _between("n_nationkey", 0, nations - 1), "n_name": _in("n_name", [n for n, _ in generate.NATIONS]),
            "n_regionkey": _between("n_regionkey", 0, len(generate.REGIONS) - 1), "n_comment": _sentence("n_comment", 4, 9)},
        "supplier": {
            "s_suppkey": _between("s_suppkey", 1, rows["supplier"]), "s_name": _numbered("s_name", "Supplier", "s_suppkey"),
            "s_address": _sentence("s_address", 2, 4), "s_nationkey": _between("s_nationkey", 0, nations - 1),
            "s_phone": _phone("s_phone"), "s_acctbal": _cents("s_acctbal", -999, 9999), "s_comment": _sentence("s_comment", 4, 9)},
        "customer": {
            "c_custkey": _between("c_custkey", 1, rows["customer"]), "c_name": _numbered("c_name", "Customer", "c_custkey"),
            "c_address": _sentence("c_address", 2, 4), "c_nationkey": _between("c_nationkey", 0, nations - 1),
            "c_phone": _phone("c_phone"), "c_acctbal": _cents("c_acctbal", -999, 9999),
            "c_mktsegment": _in("c_mktsegment", generate.SEGMENTS), "c_comment": _sentence("c_comment", 4, 9)},
        "part": {
            "p_partkey": _between("p_partkey", 1, rows["part"]),
            "p_name": (F.col("p_name").rlike("^({0}) ({0})$".format("|".join(generate.COLOURS))), None),
            "p_mfgr": _in("p_mfgr", [f"Manufacturer#{i}" for i in range(1, 6)]),
            "p_brand": (F.col("p_brand").rlike("^Brand#(1[1-9]|[234][0-9]|5[0-5])$"), None), "p_type": _in("p_type", generate.TYPES),
            "p_size": _between("p_size", 1, 50), "p_container": _in("p_container", generate.CONTAINERS),
            "p_retailprice": _cents("p_retailprice", 900, 2000), "p_comment": _sentence("p_comment", 1, 3)},
        "partsupp": {
            "ps_partkey": _between("ps_partkey", 1, rows["part"]), "ps_suppkey": _between("ps_suppkey", 1, rows["supplier"]),
            "ps_availqty": _between("ps_availqty", 1, 9999), "ps_supplycost": _cents("ps_supplycost", 1, 1000),
            "ps_comment": _sentence("ps_comment", 6, 15)},
        "orders": {
            "o_orderkey": _between("o_orderkey", 1, rows["orders"]), "o_custkey": _between("o_custkey", 1, rows["customer"]),
            "o_orderstatus": _in("o_orderstatus", ["F", "O", "P"]), "o_totalprice": _cents("o_totalprice", 900, 500000),
            "o_orderdate": _day("o_orderdate", 0, LAST_DAY), "o_orderpriority": _in("o_orderpriority", generate.PRIORITIES),
            "o_clerk": (F.col("o_clerk").rlike("^Clerk#0{5}(0[0-9]{3}|1000)$"), None), "o_shippriority": _in("o_shippriority", [0]),
            "o_comment": _sentence("o_comment", 3, 8)},
        "lineitem": {
            "l_orderkey": _between("l_orderkey", 1, rows["orders"]), "l_partkey": _between("l_partkey", 1, rows["part"]),
            "l_suppkey": _between("l_suppkey", 1, rows["supplier"]), "l_linenumber": (
                F.col("l_linenumber").between(1, 1 + F.col("l_orderkey") % generate.MAX_LINES), None),
            "l_quantity": _between("l_quantity", 1, 50), "l_extendedprice": _cents("l_extendedprice", 900, 95000),
            "l_discount": _cents("l_discount", 0, 0.1), "l_tax": _cents("l_tax", 0, 0.08),
            "l_returnflag": _in("l_returnflag", ["A", "N", "R"]), "l_linestatus": _in("l_linestatus", ["F", "O"]),
            "l_shipdate": _day("l_shipdate", 1, LAST_DAY + 121), "l_commitdate": _day("l_commitdate", 30, LAST_DAY + 90),
            "l_receiptdate": _after("l_receiptdate", "l_shipdate", 1, 30),
            "l_shipinstruct": _in("l_shipinstruct", generate.INSTRUCTIONS), "l_shipmode": _in("l_shipmode", generate.MODES),
            "l_comment": _sentence("l_comment", 2, 6)},
    }


def check_columns(df, name, rules):
    """One row per column of a table: (tbl, col, n, odd, listed).

    `odd` counts the rows whose value is null or breaks its rule, `listed` the
    different values of a column that is a short list (else null). One
    aggregation over the table; a column without a rule is an error.
    """
    missing = set(df.columns) ^ set(rules)
    if missing:
        raise ValueError(f"{name}: columns and rules differ in {sorted(missing)}")
    counts = [F.count(F.lit(1)).alias("n")]
    for column, (condition, values) in rules.items():
        counts.append(F.count_if(~F.coalesce(condition, F.lit(False))).alias(f"odd_{column}"))
        # The set holds no more values than the list, and odd ones are counted above.
        counts.append((F.size(F.collect_set(F.when(condition, F.col(column).cast("string")))).cast("long")
                       if values else F.lit(None).cast("long")).alias(f"listed_{column}"))
    one = df.agg(*counts)
    return one.select("n", F.explode(F.array(*[F.struct(
        F.lit(name).alias("tbl"), F.lit(c).alias("col"), F.col(f"odd_{c}").alias("odd"), F.col(f"listed_{c}").alias("listed"))
        for c in rules])).alias("_c")).select("_c.tbl", "_c.col", "n", "_c.odd", "_c.listed")
