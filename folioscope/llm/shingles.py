"""Column expressions for words and their n-grams, and the checked broadcast of a small side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What lies between two words: anything but letters and digits.
GAPS = r"[^\p{L}\p{N}]+"
#: Rows up to which a side of a join is broadcast; rows of a few numbers each, so some 30 MB at most.
BROADCAST_ROWS = 500_000


def plain_words(text: Column) -> Column:
    """Runs of letters and digits in lower case; null for null."""
    return F.filter(F.split(F.lower(text), GAPS), lambda w: w != "")


def runs(words: Column, size: int, combine) -> Column:
    """``combine`` of every ``size`` consecutive elements; empty if there are fewer.

    ``words`` is to be a plain column, not an expression: it is read once for each run.
    """
    starts = F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size)).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(starts, lambda i: combine(*(F.get(words, i + k) for k in range(size))))


def joined(*words: Column) -> Column:
    return F.concat_ws(" ", *words)


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with ``value`` as a column that later filters cannot compute anew.

    The optimizer puts a projected expression into every place that reads it below a filter, even into a
    function applied to each element; what a generator gives stays as it is.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def small_side(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if its counted rows are few; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df
