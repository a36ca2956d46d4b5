"""How five quality filters interact: who removes what, in every order of the filters."""

from itertools import permutations
from math import factorial

from pyspark.sql import functions as F

from runledger.session import BROADCAST_LIMIT, fits_broadcast, materialise

FILTERS = "ABCDE"
REPEATED = 1 << FILTERS.index("E")
MIN_WORDS = 200
SALTS = 256
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORD = r"[^\x20\x09-\x0D]+"
_ODD = r"[#$%&*|]"


def _text_bits(text):
    """Bits of the conditions that a text fails by itself: A few words, B repeated words, C capitals, D odd signs."""
    words = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
    n = F.size(words).cast("long")
    capitals = F.char_length(text) - F.char_length(F.translate(text, UPPER, ""))
    failed = [n < MIN_WORDS,
              100 * F.size(F.array_distinct(words)).cast("long") < 50 * n,
              100 * capitals.cast("long") > 3 * F.char_length(text).cast("long"),
              text.rlike(_ODD)]
    bits = F.lit(0)
    for place, condition in enumerate(failed):
        bits = bits + F.when(condition, 1 << place).otherwise(0)
    return bits


def _identified(docs):
    """doc_id, part and text of every row, and two hashes of the text: h joins, h2 tells rows apart beside it."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        text.alias("text"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit("second"), text).alias("h2"))


def repeats(docs, facts, limit=BROADCAST_LIMIT, salts=SALTS):
    """(doc_id, part, h, h2) of the documents whose text a smaller doc_id has too, each once.

    A left-semi join on hash, exact text and smaller doc_id. `facts` has the hashes of
    all rows; only texts whose hash more than one row has are read and shuffled, as long
    as the list of those hashes is measured to be within `limit`. The other side of the join holds
    one row per text, its smallest doc_id, combined before the shuffle. Hashes with
    more than one row in `salts` are fewer than `salts`; their documents are dealt to
    parts by doc_id and the one row they look for is repeated for each part.
    """
    counted = facts.groupBy("h").agg(F.sum("n").alias("n"), F.countDistinct("doc_id").alias("ids"))
    shared = materialise(counted.filter("ids > 1").select("h", "n"), "shared-hashes")
    total = facts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    hot = shared.filter(F.col("n") * salts > total).select(
        "h", F.ceil(F.col("n") * salts / F.lit(max(total, 1))).cast("int").alias("parts"))
    rows = _identified(docs)
    if fits_broadcast(shared, limit):
        rows = rows.join(F.broadcast(shared.select("h")), "h", "left_semi")
    parts = F.coalesce("parts", F.lit(1))
    first = rows.groupBy("h", "text").agg(F.min("doc_id").alias("first")).join(F.broadcast(hot), "h", "left").select(
        F.col("h").alias("h_"), F.col("text").alias("text_"), "first",
        F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt_"))
    asked = rows.join(F.broadcast(hot), "h", "left").withColumn("salt", F.pmod(F.xxhash64("doc_id"), parts).cast("int"))
    same = ((F.col("h") == F.col("h_")) & (F.col("salt") == F.col("salt_")) & (F.col("text") == F.col("text_"))
            & (F.col("first") < F.col("doc_id")))
    return asked.join(first.hint("merge"), same, "left_semi").select("doc_id", "part", "h", "h2").distinct()


def combinations(docs, labels, limit=BROADCAST_LIMIT, salts=SALTS):
    """(part, bits, good, toxic, n): documents by the set of filters they fail and by label.

    Bit i of `bits` is filter i of FILTERS. Failures of a text by itself and those by
    another document are rows of one union, whose bits meet by document; labels join
    combinations per doc_id, of which there are few however many rows share the id.
    """
    rows = _identified(docs)
    bits = rows.select("doc_id", "part", "h", "h2", _text_bits(F.col("text")).alias("bits"))
    facts = materialise(bits.groupBy("doc_id", "part", "h", "h2").agg(
        F.max("bits").alias("bits"), F.count(F.lit(1)).alias("n")), "facts")
    again = repeats(docs, facts, limit, salts).select("*", F.lit(REPEATED).alias("bits"), F.lit(0).cast("long").alias("n"))
    failed = facts.unionByName(again).groupBy("doc_id", "part", "h", "h2").agg(
        F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    per_id = failed.groupBy("doc_id", "part", "bits").agg(F.sum("n").alias("n"))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").filter("doc_id is not null").groupBy(
        "doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    return per_id.join(marks, "doc_id", "left").groupBy(
        "part", "bits", (F.coalesce("good", F.lit(0)) == 1).alias("good"), (F.coalesce("toxic", F.lit(0)) == 1).alias("toxic")
    ).agg(F.sum("n").alias("n"))


def orders(found):
    """Counts per part, order of the filters and step, from `combinations`."""
    every = F.split(F.lit(" ".join(map("".join, permutations(FILTERS)))), " ")
    steps = found.select("*", F.explode(every).alias("filter_order")).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit_of = lambda letter: F.call_function("shiftleft", F.lit(1), F.ascii(letter) - ord(FILTERS[0]))
    letters = F.split("filter_order", "")
    earlier = F.aggregate(F.slice(letters, F.lit(1), F.col("step") - 1), F.lit(0), lambda bits, letter: bits + bit_of(letter))
    marked = steps.withColumns({"_own": bit_of(F.get(letters, F.col("step") - 1)), "_before": earlier})
    fails = F.col("bits").bitwiseAND(F.col("_own")) != 0
    gone = F.col("bits").bitwiseAND(F.col("_before")) != 0
    removed = fails & ~gone
    # Of all orders, those with this filter before the others that the document fails.
    share = F.call_function("div", F.lit(factorial(len(FILTERS))), F.bit_count("bits"))
    total = lambda condition, n="n": F.sum(F.when(condition, F.col(n)).otherwise(0)).alias
    return marked.withColumn("_shared", F.when(fails, F.col("n") * share)).groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone)("kept"), total(removed)("removed"), total(fails & gone)("redundant"),
        total(F.col("bits") == F.col("_own"))("unique_fails"), total(removed & F.col("good"))("good_lost"),
        total(removed & F.col("toxic"))("toxic_lost"), total(fails, "_shared")("shapley"))


def audit(docs, labels, limit=BROADCAST_LIMIT, salts=SALTS):
    """One row per part (lang; null is an empty string), order of the five filters and step.

    A fails under 200 words, B below 50 % distinct words, C above 3 % capitals, D with one of
    `#$%&*|`, E with a text that a smaller doc_id has in the whole table. Null text is empty text.
    Rows without doc_id never fail E, and no row is repeated by theirs; rows that repeat an id
    are documents each, and do not repeat each other. A doc_id is good or toxic if any of its labels
    says so. No documents give no rows; a part has all its 600 rows. Other columns are not read.
    """
    return orders(combinations(docs, labels, limit, salts))
