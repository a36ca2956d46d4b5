"""From raw documents to packed training sequences: each stage works on what the one before kept."""

from runledger.llm import decontam, packing, pii, quality, simhash
from runledger.llm.queries import tokenizer_path
from runledger.session import materialise
from runledger.sources.tables import read_table

# A fitted classifier, 64-bit shingle hashes, pattern graphs and a tokenizer have no SQL form.
ORACLE_SQL = None


def quality_classifier(spark, docs, sf_dir):
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark, docs, sf_dir):
    """One document of each near-duplicate group stays."""
    return simhash.keep_one(docs)


def benchmark_decontamination(spark, docs, sf_dir):
    """Documents of which a twentieth or more stands in the benchmark go."""
    return decontam.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def personal_data(spark, docs, sf_dir):
    """Personal data is replaced by its kind."""
    return pii.redact(docs)


def sequence_packing(spark, docs, sf_dir):
    """Pieces of token sequences for training."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("PII", personal_data),
    ("packing", sequence_packing),
]


def run(spark, sf_dir):
    """All stages over documents; every stage's rows are written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = materialise(docs, f"stage-{number}")
    return docs
