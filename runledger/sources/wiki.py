"""Page dumps."""

from pyspark.sql import functions as F

from runledger import schemas


def read_wiki_xml(spark, path, partitions=None):
    """Pages of an XML dump as (page_id, title, text).

    `partitions` spreads the pages again after a read that could not be split.
    """
    pages = (spark.read.format("xml").schema(schemas.WIKI_PAGE).option("rowTag", "page")
             .option("ignoreSurroundingSpaces", "false").load(path))
    pages = pages.select(
        F.col("id").alias("page_id"), "title", F.col("revision.text").alias("text"))
    return pages.repartition(partitions, "page_id") if partitions else pages
