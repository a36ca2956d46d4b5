"""One query per operator, over its whole table and with production parameters."""

from pyspark.sql import functions as F

from runledger.llm import decontam, interaction, licenses, lm, packing, pii, quality, repair, simhash, suffixes, urls, warc, winnow
from runledger.llm.oracles import ORACLES  # noqa: F401
from runledger.session import scratch_path
from runledger.sources.tables import read_table

TOKENIZER = "byte_bpe_50k.json"

# The rules of the URL query, as action, host and path.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def tokenizer_path():
    """The public vocabulary file that the queries use; operators take any path."""
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER)


def _documents(spark, sf):
    return read_table(spark, sf, "documents")


def op1_pii(spark, sf):
    found = pii.find(_documents(spark, sf))
    count = [F.size(F.filter("base", lambda s: s["kind"] == n)).cast("long").alias(f"n_{k}")
             for n, k in enumerate(pii.KINDS)]
    return found.select("doc_id", *count, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"),
                        pii.listed(F.col("spans")).alias("spans"))


def op2_packing(spark, sf):
    return packing.pack(_documents(spark, sf), tokenizer_path())


def op3_decontamination(spark, sf):
    found = decontam.find_contamination(_documents(spark, sf), read_table(spark, sf, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        decontam.is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"))


def op4_suffixes(spark, sf):
    return suffixes.remove_repeats(_documents(spark, sf)).drop("starts", "ends")


def op5_warc(spark, sf):
    folder = scratch_path(spark, "warc")
    warc.write_archives(read_table(spark, sf, "pages"), folder)
    return warc.read_archives(spark, folder, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_fingerprints(spark, sf):
    return winnow.with_neighbours(_documents(spark, sf)).drop("positions")


def op7_licenses(spark, sf):
    found = licenses.scan(_documents(spark, sf))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word",
                        F.array_join("base_labels", ",").alias("base_labels"),
                        F.array_join("labels", ",").alias("labels"), "score")


def op8_simhash(spark, sf):
    found = simhash.near_duplicates(_documents(spark, sf))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op9_lm(spark, sf):
    return lm.score(_documents(spark, sf))


def op10_quality(spark, sf):
    return quality.score_documents(_documents(spark, sf), read_table(spark, sf, "labels"))


def op11_urls(spark, sf):
    rules = spark.createDataFrame(URL_RULES, "action string, host string, path string")
    return urls.judge(read_table(spark, sf, "pages").select("page_id", "url"), rules).drop("url")


def op12_conversations(spark, sf):
    return repair.report(repair.repair(repair.damage(read_table(spark, sf, "conversations"))))


def op13_interaction(spark, sf):
    return interaction.audit(_documents(spark, sf), read_table(spark, sf, "labels"))


QUERIES = [op1_pii, op2_packing, op3_decontamination, op4_suffixes, op5_warc, op6_fingerprints, op7_licenses,
           op8_simhash, op9_lm, op10_quality, op11_urls, op12_conversations, op13_interaction]
