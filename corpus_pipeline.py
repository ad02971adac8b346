"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next."""

from textmap.llm import decontaminate, mixing, near_dedup, quality, suffix_dedup
from textmap.llm.shared import Tables, table


def quality_rules(spark, docs, sf_dir):
    """Documents that the base rule or a risk-controlled rule rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def minhash_near_dedup(spark, docs, sf_dir):
    """Of each component of documents at a similarity of 0.8 or more the one with the smallest id stays."""
    return near_dedup.keep_one_of_each(docs, percent=80)


def suffix_array_dedup(spark, docs, sf_dir):
    """Passages of 50 words or more stay in their first copy only; texts lose the others."""
    return suffix_dedup.cut_repeats(docs)


def benchmark_decontamination(spark, docs, sf_dir):
    """Documents that overlap with a benchmark item go."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_to_weights(spark, docs, sf_dir):
    """A sample whose sources, languages and topics are raked to flattened shares; adds mix_prob."""
    return mixing.sampled(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("minhash near-dedup", minhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mixing_to_weights),
]
#: Sketches, minimisers and spaced seeds aren't expressible; tests hold the whole pipeline against one in plain Python.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages on documents; what a stage returns is written to the shared folder and read again."""
    tables = Tables(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = tables.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
