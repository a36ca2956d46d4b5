"""The benchmark programs by the name a specification gives them."""

from pyspark.sql import functions as F

from runledger.functions.text import BLANK_RUN
from runledger.operators.joins import join_by_position
from runledger.operators.ordering import total_sort


def word_count(lines, column="line"):
    """Occurrences of every run of non-blank characters, case kept.

    Counts are combined before the shuffle, so a frequent word is one row per
    task there.
    """
    words = lines.select(F.explode(F.split(F.col(column), BLANK_RUN)).alias("word"))
    return words.filter(F.col("word") != "").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


JOBS = {
    "terasort": total_sort,
    "wordcount": word_count,
    "DefaultJoin": join_by_position,
    "MapJoin": lambda *sides, **options: join_by_position(
        *sides, strategy="broadcast", **options),
}
