"""Delimited text that gives back what it was given: blanks, empty text, nulls and line ends."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

# How a null is written, and the two-character forms of a backslash
# and of the line ends. Every backslash in a file starts one of these.
NULL = "\\N"
FORMS = [("\\", "\\b"), ("\n", "\\n"), ("\r", "\\r")]

WRITE_OPTIONS = {"nullValue": NULL, "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
READ_OPTIONS = {**WRITE_OPTIONS, "emptyValue": ""}


def _strings(df, change):
    return df.select(*[change(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType)
                       else F.col(f"`{f.name}`") for f in df.schema.fields])


def escaped(df):
    """Text columns with one line per value."""
    def change(column):
        for plain, form in FORMS:
            column = F.replace(column, F.lit(plain), F.lit(form))
        return column
    return _strings(df, change)


def unescaped(df):
    def change(column):
        for plain, form in reversed(FORMS):
            column = F.replace(column, F.lit(form), F.lit(plain))
        return column
    return _strings(df, change)


def read_delimited(spark, path, schema, sep):
    """Rows written by the delimited sinks, with a declared schema."""
    return unescaped(spark.read.schema(schema).options(**READ_OPTIONS).option("sep", sep).csv(path))
