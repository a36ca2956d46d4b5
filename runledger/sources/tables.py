"""Benchmark tables as delimited text or parquet."""

from runledger import schemas
from runledger.functions.delimited import READ_OPTIONS, unescaped


def read_tpch(spark, path, table, fmt="csv", sep="|", wide_keys=False):
    """A table directory, file or glob with the declared schema.

    Rows of generator output end in a delimiter; the extra empty field is
    dropped because the schema decides how many fields are read.
    """
    schema = schemas.tpch(table, wide_keys)
    if fmt == "parquet":
        return spark.read.schema(schema).parquet(path)
    rows = spark.read.schema(schema).options(**READ_OPTIONS).option("sep", sep).option("mode", "FAILFAST")
    return unescaped(rows.csv(path))


def read_table(spark, directory, table):
    return spark.read.parquet(f"{directory.rstrip('/')}/{table}.parquet")


def spread(df):
    """Give a scan with fewer tasks than cores one task per core.

    For tables that are small in bytes and costly per row, like documents to
    parse. A table with a task for every core stays as it is, so a large one is
    never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
