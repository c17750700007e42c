"""Stemming of a corpus: each distinct word once, then a join back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folioscope.functions.porter import stem


@F.pandas_udf(StringType())
def stem_words(words: pd.Series) -> pd.Series:
    return words.map(stem)


def vocab_stem_job(vocab: DataFrame, term: str = "term") -> DataFrame:
    """Stem of every distinct word: (term, stem). The words are few bytes but slow to stem, so they are
    spread over all cores; by size alone they would share a few tasks."""
    words = vocab.select(term).distinct()
    cores = words.sparkSession.sparkContext.defaultParallelism
    return words.repartition(cores, term).select(term, stem_words(F.col(term)).alias("stem"))


def stem_terms(counts: DataFrame, term: str = "term", tf: str = "tf") -> DataFrame:
    """Replace the terms of a count table by their stems. The vocabulary is a small part of the corpus;
    whether it is broadcast is left to its measured size. The test on the counts lets the vocabulary
    and the join read one shuffle."""
    stems = vocab_stem_job(counts.filter(F.col(tf) > 0), term)
    return counts.join(stems, term).drop(term).withColumnRenamed("stem", term)
