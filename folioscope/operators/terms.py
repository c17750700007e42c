"""Term matrices in long form (doc_id, term, weight), their pruning, weighting and similarity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.functions.words import FUNCTION_WORDS
from folioscope.operators.joins import small_side
from folioscope.operators.similarity import similar_pairs
from folioscope.session import cut_lineage


def token_rows(
    docs: DataFrame, key: str = "doc_id", text: str = "text", stop_words: Sequence[str] = FUNCTION_WORDS
) -> DataFrame:
    """One row per content word occurrence."""
    return docs.select(key, F.explode(T.tokens_filtered(F.col(text), stop_words)).alias("term"))


def attribute_rows(docs: DataFrame, column: str, key: str = "doc_id") -> DataFrame:
    """One row per entry of a multi-valued attribute."""
    return docs.select(key, F.explode(column).alias("term"))


def raw_counts(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    return rows.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(counts: DataFrame) -> DataFrame:
    """Number of documents per term. Looking at ``tf`` keeps the counts equal to those they are joined with,
    so that both read one shuffle."""
    return counts.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))


def vocabulary(
    counts: DataFrame, n_docs: DataFrame, min_df: int = 1, max_df: float = 1.0
) -> DataFrame:
    """Terms found in at least ``min_df`` documents and at most the share ``max_df`` of all."""
    df = document_frequency(counts)
    return df.filter((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * n_docs.scalar()))


def count_rows(df: DataFrame) -> DataFrame:
    """One row holding the row count, to be used as a scalar subquery."""
    return df.agg(F.count(F.lit(1)).alias("n"))


def vocab_lookup(rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """Rows whose term is in the vocabulary. No hint: Spark broadcasts a vocabulary only if it is small,
    and otherwise the skew handling of the sort-merge join splits the frequent terms."""
    return rows.join(vocab.select("term"), "term", "left_semi")


def term_counts(
    rows: DataFrame, docs: DataFrame, key: str = "doc_id", min_df: int = 2, max_df: float = 0.5
) -> DataFrame:
    """Term frequency per document over the pruned vocabulary."""
    counts = raw_counts(rows, key)
    vocab = vocabulary(counts, count_rows(docs), min_df, max_df)
    # an inner join: a semi join would be pushed below the counting and tokenize the texts a second time
    return counts.join(vocab.select("term"), "term").select(key, "term", "tf")


def l2_by_document(weights: DataFrame, key: str = "doc_id", weight: str = "weight") -> DataFrame:
    """Scale each document's weights to unit length. The window group is one document."""
    norm = F.sqrt(F.sum(F.col(weight) * F.col(weight)).over(Window.partitionBy(key)))
    return weights.withColumn(weight, F.col(weight) / norm)


def tfidf(
    rows: DataFrame, docs: DataFrame, key: str = "doc_id", min_df: int = 2, max_df: float = 0.4
) -> DataFrame:
    """Smoothed TF-IDF, ``tf * (ln((1 + n) / (1 + df)) + 1)``, unit length per document."""
    counts = raw_counts(rows, key)
    n_docs = count_rows(docs)
    vocab = vocabulary(counts, n_docs, min_df, max_df)
    idf = F.log((F.lit(1.0) + n_docs.scalar()) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    weighted = counts.join(vocab.withColumn("idf", idf).select("term", "idf"), "term")
    return l2_by_document(weighted.select(key, "term", (F.col("tf") * F.col("idf")).alias("weight")), key)


def hstack_features(blocks: Mapping[str, DataFrame], key: str = "doc_id") -> DataFrame:
    """Concatenate term matrices side by side: the block name becomes part of the column key."""
    parts = [df.select(key, F.lit(name).alias("block"), "term", "weight") for name, df in blocks.items()]
    return reduce(DataFrame.unionByName, parts)


def minmax_per_term(weights: DataFrame, n_docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Scale each term column to [0, 1]; a document without the term counts as zero."""
    spread = weights.groupBy("term").agg(
        F.min("weight").alias("lo"), F.max("weight").alias("hi"), F.count(F.lit(1)).alias("filled")
    )
    low = F.when(F.col("filled") < n_docs.scalar(), F.least("lo", F.lit(0.0))).otherwise(F.col("lo"))
    bounds = spread.select("term", low.alias("lo"), "hi")
    scaled = (F.col("weight") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    return weights.join(bounds, "term").select(key, "term", scaled.alias("weight"))


def numbered_terms(weights: DataFrame) -> DataFrame:
    """Each term with its document frequency and a number that keeps the order of the terms.

    Materialised, so that a task that runs again sees the same numbers. 64 ranges keep them below 2**39.
    """
    df = weights.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    ranged = df.repartitionByRange(64, "term").sortWithinPartitions("term")
    return cut_lineage(ranged.withColumn("tid", F.monotonically_increasing_id()))


def _signed(weights: DataFrame, key: str, *entry: str) -> DataFrame:
    """``key, vector, sign``: the entries of every document in order, and a digest that equal vectors share.

    Weights are rounded to 9 digits to compare them.
    """
    cells = F.struct(*[F.round(c, 9).alias(c) if c == "weight" else F.col(c) for c in entry])
    vectors = weights.groupBy(key).agg(F.array_sort(F.collect_list(cells)).alias("vector"))
    return vectors.withColumn("sign", F.sha2(F.to_json("vector"), 256))


def _members(signed: DataFrame, key: str) -> DataFrame:
    """The membership (doc_id, rep): the first document of those with the same sign."""
    reps = signed.groupBy("sign").agg(F.min(key).alias("rep"))
    return signed.select(key, "sign").join(reps, "sign").select(key, "rep")


def vector_copies(weights: DataFrame, key: str = "doc_id") -> DataFrame:
    """The membership (doc_id, rep) of documents with the same vector. Only digests are moved, once a document is together."""
    return _members(cut_lineage(_signed(weights, key, "term", "weight").select(key, "sign")), key)


def distinct_vectors(weights: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Collapse documents with the same vector over numbered terms.

    Returns the vectors of the representatives, as arrays of (tid, weight, df) sorted by tid, and the
    membership (doc_id, rep). A group of copies, however large, then enters a similarity join as one row.
    """
    signed = cut_lineage(_signed(weights, key, "tid", "weight", "df"))
    members = cut_lineage(_members(signed, key))
    # the ids of the copies are few, or a list of numbers, so the vectors stay where they were written
    copies = small_side(members.filter(F.col(key) != F.col("rep")).select(key))
    return signed.join(copies, key, "left_anti").select(F.col(key).alias("rep"), "vector"), members


def cosine_pairs(weights: DataFrame, min_sim: float, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """All pairs of distinct unit vectors with cosine at least ``min_sim``, and the copies of each vector.

    Returns (i, j, sim) with i < j over representatives, and the membership (doc_id, rep).
    """
    if not 0 < min_sim <= 1:
        raise ValueError("min_sim must be in (0, 1]")
    return dot_pairs(weights, min_sim, 1.0, key)


def dot_pairs(
    weights: DataFrame, min_sim: float, max_norm: float, key: str = "doc_id"
) -> tuple[DataFrame, DataFrame]:
    """All pairs of distinct vectors, no longer than ``max_norm``, with dot product at least ``min_sim``.

    Exact; ``similarity`` tells how. Returns the pairs (i, j, sim) of representatives and the membership (doc_id, rep).
    """
    # read for the terms and for the vectors
    weights = cut_lineage(weights)
    numbered = weights.join(numbered_terms(weights), "term").select(key, "tid", "weight", "df")
    reps, members = distinct_vectors(numbered, key)
    return similar_pairs(reps, min_sim, max_norm), members


# The weights of the parts in the combined similarity.
PART_WEIGHTS: dict[str, float] = {"title": 0.6, "abstract": 1.0, "terms": 0.5, "authors": 0.5, "pubtypes": 0.4}


def combined_similarity(
    parts: Mapping[str, DataFrame],
    min_sim: float,
    weights: Mapping[str, float] = PART_WEIGHTS,
    key: str = "doc_id",
) -> tuple[DataFrame, DataFrame]:
    """Pairs whose weighted sum of cosines over the parts reaches ``min_sim``.

    A weighted sum of cosines is the dot product of the parts set side by side, each scaled by the root of
    its weight, so one similarity join does for all parts. ``parts`` are unit vectors in long form.
    """
    blocks = {
        name: df.select(key, "term", (F.col("weight") * F.lit(weights[name] ** 0.5)).alias("weight"))
        for name, df in parts.items()
    }
    stacked = hstack_features(blocks, key).select(key, F.concat_ws("|", "block", "term").alias("term"), "weight")
    return dot_pairs(stacked, min_sim, sum(weights[name] for name in parts) ** 0.5, key)


def corpus_flags(docs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How many documents have any entry in each multi-valued column."""
    return docs.agg(*[F.count_if(F.size(c) > 0).alias(f"n_{c}") for c in columns])


def conditional_display(docs: DataFrame, terms: str = "terms", keywords: str = "keywords") -> DataFrame:
    """Entries to show: subject headings if any document has one, else keywords if any has one."""
    flags = docs.agg(F.max(F.size(terms) > 0).alias("t"), F.max(F.size(keywords) > 0).alias("k"))
    shown = (
        F.when(flags.select("t").scalar(), F.array_join(terms, ", "))
        .when(flags.select("k").scalar(), F.array_join(keywords, ", "))
    )
    return docs.withColumn("keyword_display", F.translate(shown, "_", " "))
