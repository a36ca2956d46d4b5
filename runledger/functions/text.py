"""Column helpers for log and configuration text. All stay inside the JVM."""

from pyspark.sql import functions as F

BLANKS = " \t\n\r\f"
BLANK_RUN = "[ \t\n\r\f]+"


def strip(column):
    return F.regexp_replace(column, r"^\s+|\s+$", "")


def tokens(column):
    """Whitespace tokens; leading and trailing blanks give no empty token."""
    return F.split(F.btrim(column, F.lit(BLANKS)), BLANK_RUN)


def token(column, position):
    """The 1-based whitespace token, NULL when the line is too short."""
    return F.get(tokens(column), F.lit(position - 1))


def is_blank(column):
    return F.btrim(column, F.lit(BLANKS)) == ""


def split_list(values, delimiter):
    """Split a value list by a per-row regular expression.

    Values keep their blanks. Empty values at the end are dropped, empty ones
    at the start or in the middle stay.
    """
    parts = F.split(values, delimiter, -1)
    kept = F.array_max(F.transform(parts, lambda part, i: F.when(part == "", 0).otherwise(i + 1)))
    return F.when(F.coalesce(values, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.slice(parts, F.lit(1), kept))


def log_timestamp(line):
    """`yyyy-MM-dd HH:mm:ss` at the start of a line, NULL when it is not there."""
    pattern = r"^(\d+-\d+-\d+)\s+(\d+:\d+:\d+)"
    return F.concat_ws(
        " ", F.regexp_extract(line, pattern, 1), F.regexp_extract(line, pattern, 2)
    ).try_cast("timestamp")


def client_timestamp(line):
    """`yy/MM/dd HH:mm:ss` at the start of a line.

    Two-digit years follow the POSIX pivot: 69 to 99 are 19yy, the rest 20yy.
    """
    pattern = r"^\s*(\d\d)/(\d{1,2})/(\d{1,2})\s+(\d{1,2}:\d{1,2}:\d{1,2})"
    year = F.regexp_extract(line, pattern, 1)
    century = F.when(year >= "69", "19").otherwise("20")
    return F.concat(
        century, year, F.lit("-"), F.regexp_extract(line, pattern, 2), F.lit("-"),
        F.regexp_extract(line, pattern, 3), F.lit(" "), F.regexp_extract(line, pattern, 4),
    ).try_cast("timestamp")


def run_id(number):
    return F.format_string("EXPT-%04d", number)
