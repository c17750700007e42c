"""Licence scans: lines, whole texts and word windows compared to licence templates by the Dice coefficient of word bigrams.

Words are runs of letters and digits in lower case; a unit is a line of a text, or the whole text if it has
more than one line (line 0). Two sets of bigrams can reach the coefficient only if their sizes are alike: a
unit outside the size bounds of every template is dropped before its bigrams are spread out, and a bigram
meets only those templates whose bounds hold the unit's size. What is left is one equi-join on the bigram and
a count for each unit and template.

A notice that is wrapped over lines, or stands within a longer line, is found by windows over the words of the whole
text, across lines. For each template they start and end with one of its bigrams and span as many bigrams as its
size bounds allow, and count as no shorter than the template; bigrams outside it count as often as they stand. Of overlapping windows, of whichever
template, the best stays. It is given with the line it starts in, unless it lies in a line that is a result
itself, or its licence is one of the whole text.

A null text, and a unit of fewer than two words, has no bigrams and no result; so has a template of this kind.
A text that matches several templates gives a row for each; repeated documents give rows of their own.
Other columns are not returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shingles import held, joined, plain_words, runs, small_side
from folioscope.session import cut_lineage

THRESHOLD = 0.8


def template_bigrams(templates: DataFrame, threshold: float) -> DataFrame:
    """``license_id, template`` (a hash of its text), ``size``, the bounds ``least`` and ``most``, ``bigrams``."""
    words = templates.select("license_id", plain_words(F.col("text")).alias("words")).distinct()
    cut = words.select(
        "license_id", F.xxhash64("words").alias("template"), F.array_distinct(runs(F.col("words"), 2, joined)).alias("bigrams")
    ).withColumn("size", F.size("bigrams"))
    return cut.filter("size > 0").withColumns(
        {
            "least": F.ceil(F.round(F.col("size") * threshold / (2 - threshold), 6)),
            "most": F.floor(F.round(F.col("size") * (2 - threshold) / threshold, 6)),
        }
    )


def _units(words_of_lines: Column) -> Column:
    """Line number and words of every unit."""
    lines = F.transform(words_of_lines, lambda w, i: F.struct((i + 1).alias("line"), w.alias("words")))
    whole = F.array(F.struct(F.lit(0).alias("line"), F.flatten(words_of_lines).alias("words")))
    return F.when(F.size(words_of_lines) > 1, F.concat(whole, lines)).otherwise(lines)


def _windows(rows: DataFrame, sought: DataFrame, threshold: float) -> DataFrame:
    """The best windows of every text that overlap no better one, with the lines they start and end in."""
    numbers = F.flatten(F.transform("lines", lambda w, i: F.array_repeat((i + 1).cast("int"), F.size(w))))
    flat = held(held(rows.filter("lines is not null"), "words", F.flatten("lines")), "numbers", numbers)
    starts = F.when(F.size("words") > 1, F.sequence(F.lit(0), F.size("words") - 2)).otherwise(F.array().cast("array<int>"))
    bigram = F.transform(
        starts,
        lambda i: F.struct(
            joined(F.get("words", i), F.get("words", i + 1)).alias("bigram"),
            i.alias("at"),
            F.get("numbers", i).alias("line"),
            F.get("numbers", i + 1).alias("line_to"),
        ),
    )
    spread = flat.select("doc_id", "row", "key", F.explode(bigram).alias("b")).select("doc_id", "row", "key", "b.*")
    of_template = ["doc_id", "row", "key", "license_id", "template", "size", "least", "most"]
    hits = (
        spread.join(sought, "bigram")
        .groupBy(*of_template)
        .agg(F.collect_list(F.struct("at", F.xxhash64("bigram").alias("bigram"), "line", "line_to")).alias("hits"))
        .filter(F.size("hits") >= F.col("least"))
    )
    ordered = held(hits, "sorted", F.array_sort("hits")).drop("hits")
    # a window holds at least ``least`` of the template's bigrams, within ``most`` places
    least, most = F.col("least").cast("int"), F.col("most").cast("int")
    enough = F.filter(
        F.sequence(F.lit(0), F.size("sorted") - least),
        lambda i: F.get("sorted", i + least - 1)["at"] - F.get("sorted", i)["at"] < most,
    )
    after = F.transform(enough, lambda i: F.slice("sorted", i + 1, most))
    opened = ordered.select(*of_template, F.explode(after).alias("hits"))
    ends = F.filter(
        F.sequence(least, F.size("hits")), lambda n: F.get("hits", n - 1)["at"] - F.get("hits", F.lit(0))["at"] < most
    )
    closed = opened.select("*", F.explode(ends).alias("n"))
    shared = F.size(F.array_distinct(F.transform(F.slice("hits", 1, F.col("n")), lambda h: h["bigram"])))
    first, last = F.get("hits", F.lit(0)), F.get("hits", F.col("n") - 1)
    told = held(closed, "n_shared", shared.cast("long")).select(
        *of_template, "n_shared", "n", first["at"].alias("start"), last["at"].alias("end"), first["line"].alias("line"),
        last["line_to"].alias("line_to"),
    )
    # words that stand in place of missing ones count: a window is no shorter than the template
    unit_size = F.col("n_shared") + F.greatest(F.col("end") - F.col("start") + 1, "size") - F.col("n")
    near = told.withColumn("dice", 2 * F.col("n_shared") / (unit_size + F.col("size"))).filter(F.col("dice") >= threshold)
    window = F.struct((-F.col("dice")).alias("order"), "start", "end", "license_id", "template", "n_shared", "dice", "line", "line_to")
    listed = held(near.groupBy("doc_id", "row", "key").agg(F.collect_set(window).alias("all")), "windows", F.array_sort("all"))

    def taken(kept: Column, w: Column) -> Column:
        clash = F.exists(kept, lambda k: (k["start"] <= w["end"]) & (w["start"] <= k["end"]))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(w)))

    best = F.aggregate("windows", F.filter("windows", lambda w: F.lit(False)), taken)
    return listed.select("doc_id", "key", F.explode(best).alias("w")).select("doc_id", "key", "w.*")


def find_licenses(
    docs: DataFrame, templates: DataFrame, id_column: str = "doc_id", text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """Units, or windows, and templates whose coefficient reaches ``threshold``.

    ``templates`` has the columns ``license_id`` and ``text``. The result: ``doc_id``, ``line``,
    ``license_id``, ``template``, ``n_shared`` and ``dice``.
    """
    listed = template_bigrams(templates, threshold)
    bounds = listed.agg(F.min("least").alias("least"), F.max("most").alias("most")).first()
    least, most = (bounds.least, bounds.most) if bounds.least is not None else (1, 0)
    rows = docs.select(
        F.col(id_column).alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.xxhash64(id_column, text).alias("key"),
        F.transform(F.split(text, "\n"), plain_words).alias("lines"),
    )
    units = rows.select("doc_id", "row", "key", F.explode(_units(F.col("lines"))).alias("unit"))
    # a unit has fewer distinct bigrams than words, so short ones can go by their words already
    long_enough = units.select("doc_id", "row", "key", "unit.line", "unit.words").filter(F.size("words") > least)
    cut = held(long_enough, "bigrams", F.array_distinct(runs(F.col("words"), 2, joined)))
    sized = cut.select("doc_id", "row", "key", "line", F.size("bigrams").alias("unit_size"), "bigrams")
    spread = sized.filter(F.col("unit_size").between(least, most)).select(
        "doc_id", "row", "key", "line", "unit_size", F.explode("bigrams").alias("bigram")
    )
    sought = listed.select("license_id", "template", "size", "least", "most", F.explode("bigrams").alias("bigram"))
    met = spread.join(small_side(sought), "bigram").filter(F.col("unit_size").between(F.col("least"), F.col("most")))
    counts = met.groupBy("doc_id", "row", "key", "line", "unit_size", "license_id", "template", "size").agg(
        F.count(F.lit(1)).alias("n_shared")
    )
    dice = 2 * F.col("n_shared") / (F.col("unit_size") + F.col("size"))
    given = ["doc_id", "line", "license_id", "template", "n_shared", "dice"]
    found = cut_lineage(counts.withColumn("dice", dice).filter(F.col("dice") >= threshold).select("key", *given))
    windows = _windows(rows, small_side(sought), threshold)
    lines = found.select("key", F.col("line").alias("line_to")).distinct().withColumn("whole_line", F.lit(True))
    within = windows.join(lines, ["key", "line_to"], "left").filter(F.col("whole_line").isNull() | (F.col("line") != F.col("line_to")))
    named = found.filter("line = 0").select("key", "license_id").distinct()
    return found.select(*given).union(within.join(named, ["key", "license_id"], "left_anti").select(*given))
