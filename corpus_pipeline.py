"""A training-corpus pipeline: each stage works on what the one before it kept.

A stage takes (spark, docs, sf_dir); all but the last return the columns of
``documents``. Between stages the rows are written to the shared folder. Rows are documents: rows
that repeat are judged alike, and of those with one id all go or all stay. A null id, source or
label is a value like any other; columns beside those of ``documents`` are carried along. An empty
table stays empty.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.llm import decontaminate, language_id, line_dedup, mixing, ngram_join
from marginalia.llm.common import made, materialize, release, table

#: Posterior probability under which a language is no decision.
LEAST_SCORE = 0.5


def language(spark, docs, sf_dir):
    """Documents without a letter (null and empty texts among them), or of no clear language, go. The
    model is learned from these documents' own languages; where none has one, all go."""
    model = language_id.fit(docs)
    cols = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)]
    out = language_id.predict(docs, model, cols).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return out.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)))


def lines(spark, docs, sf_dir):
    """Lines found in ten documents or more stay in the first of them only, by id and then by hash of
    the text. Documents of which nothing but white space is left go."""
    out = line_dedup.dedup_lines(docs, min_docs=10, keep="first").where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of n-gram Jaccard links stays, that of the smallest id: five words at
    80 %, not op4's four at 85 %. Texts of no word are in no group."""
    return ngram_join.keep_one(docs, width=5, percent=80)


def benchmark(spark, docs, sf_dir):
    """Documents that hold an item of the benchmark go; a null text holds none."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark, docs, sf_dir):
    """How many words of each document go into the mix: whole passes over it, at most three. Ties of finish
    times share their fate."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", benchmark),
    ("mixing", mixture),
]
#: Naive Bayes and the shuffle's hash have no counterpart in SQL; a brute-force test stands in.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        since = made()
        docs = materialize(stage(spark, docs, sf_dir))
        release(spark, since, keep=docs)  # what the stage wrote on its way
    return STAGES[-1][1](spark, docs, sf_dir)
