"""Document fingerprints: a Merkle tree over sections and paragraphs.

Sections stand between empty lines, paragraphs are their lines. A paragraph's node is the SHA-256 of its text,
a section's that of its paragraphs' nodes, the root that of the sections'; the cuts lose no character, so
equal roots mean equal texts, and nodes that differ lead to the section and paragraph of an edit. Below the
paragraphs, twigs of up to four words give a measure of likeness: the Dice coefficient of the sets of their
hashes.

A null text counts as empty: one section of one empty paragraph. Texts without twigs (empty, or blanks only)
are alike, 1, if their roots are equal, and else 0.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.session import cut_lineage

SECTION_BREAK, PARAGRAPH_BREAK = "\n\n", "\n"
TWIG = r"(?:[^ \n]+ *){1,4}"
#: Copies of a repeated row made from one array.
COPIES = 10_000


def paragraph_nodes(text: Column) -> Column:
    """The nodes of all paragraphs, in an array for each section."""
    sections = F.split(F.coalesce(text, F.lit("")), SECTION_BREAK)
    return F.transform(
        sections,
        lambda s: F.transform(F.split(s, PARAGRAPH_BREAK), lambda p: F.sha2(F.concat(F.lit("paragraph "), p), 256)),
    )


def section_nodes(text: Column) -> Column:
    return F.transform(
        paragraph_nodes(text), lambda nodes: F.sha2(F.concat(F.lit("section "), F.array_join(nodes, "")), 256)
    )


def root(text: Column) -> Column:
    """The fingerprint: 64 hexadecimal digits."""
    return F.sha2(F.concat(F.lit("document "), F.array_join(section_nodes(text), "")), 256)


def twigs(text: Column) -> Column:
    """Distinct hashes of the runs of up to four words inside paragraphs."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TWIG), F.lit(0))
    return F.array_distinct(F.transform(runs, lambda run: F.xxhash64(run)))


def likeness(twigs_a: Column, twigs_b: Column, root_a: Column, root_b: Column) -> Column:
    """0 to 1; plain columns are expected, which are read several times."""
    total = F.size(twigs_a) + F.size(twigs_b)
    shared = F.size(F.array_intersect(twigs_a, twigs_b))
    return F.when(root_a == root_b, F.lit(1.0)).when(total == 0, F.lit(0.0)).otherwise(2.0 * shared / total)


def edits(a: Column, b: Column) -> Column:
    """Where two texts differ: section and paragraph (from 0) of every paragraph node that is not the other's."""
    none = F.array().cast("array<string>")
    differing = F.zip_with(
        paragraph_nodes(a),
        paragraph_nodes(b),
        lambda x, y: F.zip_with(F.coalesce(x, none), F.coalesce(y, none), lambda p, q: ~p.eqNullSafe(q)),
    )

    def in_section(flags: Column, section: Column) -> Column:
        marked = F.transform(
            flags, lambda flag, p: F.struct(flag.alias("flag"), section.alias("section"), p.alias("paragraph"))
        )
        kept = F.filter(marked, lambda m: m["flag"])
        return F.transform(kept, lambda m: F.struct(m["section"].alias("section"), m["paragraph"].alias("paragraph")))

    return F.flatten(F.transform(differing, in_section))


def _in_sequence(keys: DataFrame, order: list[Column], fields: list[str]) -> DataFrame:
    """``keys`` with the struct ``before`` of the row before it in ``order``; before the first is the last.

    Rows are range-partitioned and materialised; the row before a partition's first is the last of the
    partition before, looked up among one row for each partition.
    """
    ranged = cut_lineage(keys.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy(*order)
    row = F.struct(*fields)
    placed = ranged.withColumns(
        {"inner": F.lag(row).over(inside), "last": F.lead(F.lit(1)).over(inside).isNull()}
    )
    ends = placed.filter("last").select("part", row.alias("end"))
    across = Window.orderBy("part")
    final = ends.orderBy(F.desc("part")).limit(1).select(F.col("end").alias("final"))
    outer = ends.select("part", F.lag("end").over(across).alias("outer"))
    joined = placed.join(outer, "part").join(F.broadcast(final), F.lit(True), "left")
    before = F.coalesce(F.col("inner"), F.col("outer"), F.col("final"))
    return joined.withColumn("before", before).drop("part", "inner", "last", "outer", "final")


def compare_with_next(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint every text and an edited one, whose last third comes from the next document.

    The next document is the one with the next smaller id; nulls come last, equal ids go by a hash of the
    text, and after the last comes the first. Of rows equal in id and text each has the next as its next.
    Ids alone are put in order; then one shuffle brings texts to their ids, and a second one brings the
    beginning and the twigs of each text to the document before it.
    """
    id_type = dict(docs.dtypes)[id_column]
    names = {name: f"_{name}_{uuid.uuid4().hex[:8]}" for name in ("id", "none", "tie")}
    keys = list(names.values())
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.coalesce(F.col(id_column), F.lit("0").cast(id_type)).alias(names["id"]),
        F.col(id_column).isNull().alias(names["none"]),
        F.xxhash64(body).alias(names["tie"]),
        body.alias("text"),
    )
    counted = rows.groupBy(*keys).agg(F.max(F.length("text")).alias("n_chars"), F.count(F.lit(1)).alias("copies"))
    order = [F.col(names["none"]), F.col(names["id"]).desc(), F.col(names["tie"])]
    placed = cut_lineage(_in_sequence(counted, order, [*keys, "n_chars"]))
    single = (
        rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(keys[0]))).filter("_n = 1").drop("_n")
    )
    known = single.join(placed, keys)
    shipped = known.select(
        *(F.col(f"before.{k}").alias(k) for k in keys),
        F.substring("text", F.lit(1), F.floor(F.col("before.n_chars") / 3).cast("int")).alias("next_start"),
        root(F.col("text")).alias("next_root"),
        twigs(F.col("text")).alias("next_twigs"),
    )
    both = known.drop("before").join(shipped, keys)
    third = F.floor(F.col("n_chars") / 3).cast("int")
    replaced = F.concat(F.substring("text", F.lit(1), F.col("n_chars") - third), F.col("next_start"))
    edited = both.withColumn("edited", replaced)
    hashed = edited.select(
        *keys, "text", "edited", "n_chars", "copies", "next_root", "next_twigs",
        root(F.col("text")).alias("fingerprint"),
        root(F.col("edited")).alias("edited_fingerprint"),
        twigs(F.col("text")).alias("own_twigs"),
        twigs(F.col("edited")).alias("edited_twigs"),
        F.sha2("edited", 256).alias("edited_sha256"),
    )
    own, new = (F.col("own_twigs"), F.col("fingerprint")), (F.col("edited_twigs"), F.col("edited_fingerprint"))
    compared = hashed.withColumns(
        {
            "near_edited": likeness(own[0], new[0], own[1], new[1]),
            "near_next": likeness(own[0], F.col("next_twigs"), own[1], F.col("next_root")),
        }
    )
    results = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    shown = F.when(~F.col(names["none"]), F.col(names["id"])).alias("doc_id")
    once = compared.select(shown, F.col("n_chars").cast("long").alias("n_chars"), *results[1:], "copies")
    bundles = once.withColumn("_bundle", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / COPIES))))
    size = F.least(F.lit(COPIES).cast("long"), F.col("copies") - F.col("_bundle") * COPIES)
    return bundles.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), size))).select("doc_id", *results)
