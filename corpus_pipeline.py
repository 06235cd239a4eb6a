"""A corpus made ready for training, in five stages over the documents table.

Each stage is an operator of ``changeflow.llm`` applied to all that the stage before it kept. What a
stage keeps is written as Parquet and read again, so a stage starts from a table, a lost executor
costs only its own tasks, and an interrupted run can go on from the last table written.

Nulls, empty texts and repeated rows pass through as the operators define it: a document without
text is judged by its site, counts as a copy of any other, and takes no place in a bin.
"""

from changeflow.llm import decontamination, exact_dedup, jaccard_join, packing, quality
from changeflow.llm.queries import TOKENIZER
from changeflow.llm.tables import keep_rows, table
from changeflow.session import written


def quality_classifier(spark, docs, sf_dir):
    """Documents that their text and their site's record make good ones."""
    judged = quality.quality(docs, table(spark, sf_dir, "labels"))
    return keep_rows(docs, judged.where("not kept"), "left_anti")


def exact_copies(spark, docs, sf_dir):
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark, docs, sf_dir):
    """One document of each group of similar texts."""
    return jaccard_join.drop_similar(docs)


def benchmark_decontamination(spark, docs, sf_dir):
    """Documents that are not contaminated, without the benchmark spans they may hold."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark, docs, sf_dir):
    """The pieces of every document with their bins, in tokens."""
    return packing.best_fit(docs, tokenizer=TOKENIZER)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: A fitted classifier and a packing order have no SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The packed corpus of the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
