"""Bibliographic records: fields, sources and sinks. Records are built from the documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import vectors as V
from folioscope.operators import retrieval, terms
from folioscope.plans import sqltext as S
from folioscope.plans.graph_queries import SYMMETRIC, quantity_edges
from folioscope.plans.registry import query, table, texts
from folioscope.plans.term_queries import TFIDF, document_rows
from folioscope.plans.vector_queries import vectors
from folioscope.operators import graph as G
from folioscope.operators.ordering import global_rank
from folioscope.session import scratch_path
from folioscope.sources import readers, records as R, writers

# Every document becomes an article: first line = title, other lines = sections, source = journal.
LINES = "src AS (SELECT *, string_split(text, chr(10)) AS lines FROM documents)"
TITLE = "CASE source WHEN 'src5' THEN '' WHEN 'src6' THEN NULL ELSE lines[1] END"
VALID = f"coalesce(length({TITLE}), 0) > 0"


def article_records(spark, sf_dir):
    docs = texts(spark, sf_dir).withColumn("lines", F.split("text", "\n"))
    title = F.when(F.col("source") == "src5", F.lit("")).when(F.col("source") != "src6", F.col("lines")[0])
    sections = F.transform(
        F.slice(F.col("lines"), F.lit(2), F.size("lines")), lambda s: F.when(s != "", s)
    )
    text = lambda c: F.col(c).cast("string")
    year = F.when(F.col("lang") != "fr", F.regexp_replace("source", "[^0-9]", ""))
    free_date = F.concat(F.lit("Spring 1998-"), text("doc_id"))
    authors = F.array(
        F.struct(F.col("source").alias("LastName"), F.col("lang").alias("ForeName"), F.lit("A").alias("Initials")),
        F.struct(
            F.col("lang").alias("LastName"),
            F.when(F.col("lang") != "de", F.col("source")).alias("ForeName"),
            F.lit("B").alias("Initials"),
        ),
    )
    related = F.array(
        F.struct(F.lit("Cites").alias("_RefType"), (F.col("doc_id") + 1).cast("string").alias("PMID")),
        F.struct(F.lit("ErratumIn").alias("_RefType"), (F.col("doc_id") + 2).cast("string").alias("PMID")),
        F.struct(F.lit("Cites").alias("_RefType"), F.lit(None).cast("string").alias("PMID")),
        F.struct(F.lit("Cites").alias("_RefType"), (F.col("doc_id") + 3).cast("string").alias("PMID")),
    )
    journal = F.struct(
        F.when(F.col("lang") != "de", F.col("source")).alias("Title"),
        F.struct(F.struct(year.alias("Year"), free_date.alias("MedlineDate")).alias("PubDate")).alias("JournalIssue"),
    )
    kinds = F.array(F.concat(F.col("lang"), F.lit(" Article; review")))
    return docs.select(
        text("doc_id").alias("PMID"),
        F.struct(
            journal.alias("Journal"),
            title.alias("ArticleTitle"),
            F.struct(sections.alias("AbstractText")).alias("Abstract"),
            F.struct(authors.alias("Author")).alias("AuthorList"),
            F.struct(kinds.alias("PublicationType")).alias("PublicationTypeList"),
            F.lit(None).cast("array<string>").alias("PublicationType"),
        ).alias("Article"),
        F.struct(F.array(F.concat(F.lit(" Key Word\\"), F.col("source"))).alias("Keyword")).alias("KeywordList"),
        F.struct(
            F.array(F.struct(F.concat_ws(", ", F.lit("Subject"), F.col("lang")).alias("DescriptorName"))).alias("MeshHeading")
        ).alias("MeshHeadingList"),
        F.struct(related.alias("CommentsCorrections")).alias("CommentsCorrectionsList"),
    )


def article_rows(spark, sf_dir):
    return R.document_fields(article_records(spark, sf_dir), "article")


@query("valid_record_filter", f"WITH {LINES} SELECT doc_id::VARCHAR AS id FROM src WHERE {VALID}")
def valid_record_filter(spark, sf_dir):
    return article_rows(spark, sf_dir).select("id")


@query(
    "article_or_book",
    f"WITH {LINES} SELECT doc_id, coalesce({TITLE}, source) AS title FROM src",
)
def article_or_book(spark, sf_dir):
    rows = article_records(spark, sf_dir).select(
        F.col("PMID").cast("bigint").alias("doc_id"), F.col("Article.ArticleTitle").alias("article")
    )
    books = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("book"))
    joined = rows.join(books, "doc_id")
    return joined.select("doc_id", R.article_or_book(F.col("article"), F.col("book")).alias("title"))


@query(
    "publication_year",
    f"""WITH {LINES} SELECT doc_id::VARCHAR AS id, CASE WHEN lang <> 'fr' THEN regexp_replace(source, '[^0-9]', '', 'g')
      ELSE '1998' || doc_id END AS year FROM src WHERE {VALID}""",
)
def publication_year(spark, sf_dir):
    return article_rows(spark, sf_dir).select("id", "year")


@query(
    "default_type",
    f"WITH {LINES} SELECT doc_id::VARCHAR AS id, CASE WHEN lang <> 'de' THEN source ELSE 'book' END AS type FROM src WHERE {VALID}",
)
def default_type(spark, sf_dir):
    return article_rows(spark, sf_dir).select("id", "type")


ABSTRACT = "array_to_string(list_filter(list_transform(lines[2:], lambda s: regexp_replace(s, '<[^>]*>', '', 'g')), lambda s: s <> ''), ' ')"


@query(
    "concat_sections",
    f"""WITH {LINES}, a AS (SELECT doc_id, array_to_string(list_filter(lines[2:], lambda s: s <> ''), ' ') AS abstract FROM src)
    SELECT doc_id::VARCHAR AS id, abstract FROM a""",
)
def concat_sections(spark, sf_dir):
    rows = article_records(spark, sf_dir)
    return rows.select(F.col("PMID").alias("id"), R.concat_sections(F.col("Article.Abstract.AbstractText")).alias("abstract"))


@query(
    "author_list",
    f"""WITH {LINES} SELECT doc_id::VARCHAR AS id, source || '_A' || CASE WHEN lang <> 'de' THEN ';' || lang || '_B' ELSE '' END
      AS authors FROM src WHERE {VALID}""",
)
def author_list(spark, sf_dir):
    return article_rows(spark, sf_dir).select("id", F.array_join("authors", ";").alias("authors"))


@query(
    "normalize_tokens_list",
    f"""WITH {LINES} SELECT doc_id::VARCHAR AS id, 'key_word-' || source AS keywords, 'subject_' || lang AS terms,
      lang || '_article_review' AS pubtypes FROM src WHERE {VALID}""",
)
def normalize_tokens_list(spark, sf_dir):
    return article_rows(spark, sf_dir).select(
        "id",
        F.array_join("keyword_tokens", ";").alias("keywords"),
        F.array_join("term_tokens", ";").alias("terms"),
        F.array_join("pubtype_tokens", ";").alias("pubtypes"),
    )


@query(
    "cited_refs",
    f"WITH {LINES} SELECT doc_id::VARCHAR AS id, (doc_id + 1) || ';' || (doc_id + 3) AS refs FROM src WHERE {VALID}",
)
def cited_refs(spark, sf_dir):
    return article_rows(spark, sf_dir).select("id", F.array_join("refs", ";").alias("refs"))


@query(
    "category_marker",
    """SELECT p_partkey, CASE WHEN contains(kind, 'Visual') THEN 'v' WHEN contains(kind, 'Big Data') THEN 'o' ELSE '*' END
      AS marker FROM (SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 'Visual ' || p_name WHEN 'ECONOMY' THEN 'Big Data'
      ELSE p_name END AS kind FROM part)""",
)
def category_marker(spark, sf_dir):
    kind = (
        F.when(F.col("p_type") == "SMALL", F.concat(F.lit("Visual "), F.col("p_name")))
        .when(F.col("p_type") == "ECONOMY", F.lit("Big Data"))
        .otherwise(F.col("p_name"))
    )
    return table(spark, sf_dir, "part").select("p_partkey", R.category_marker(kind).alias("marker"))


@query(
    "conditional_display",
    f"""WITH {LINES}, k AS (SELECT doc_id, lang, source, lang = 'xx' AS has_term FROM src WHERE {VALID})
    SELECT doc_id::VARCHAR AS id, CASE WHEN (SELECT bool_or(has_term) FROM k) THEN 'subject ' || lang
      ELSE 'key word-' || source END AS keyword_display FROM k""",
)
def conditional_display(spark, sf_dir):
    rows = article_rows(spark, sf_dir).withColumn("listed", F.filter("term_tokens", lambda t: t == "subject_xx"))
    shown = terms.conditional_display(rows, "listed", "keyword_tokens")
    return shown.select("id", "keyword_display")


def _article_twin(title_and_abstract: str) -> str:
    return f"""WITH {LINES}, a AS (SELECT doc_id::VARCHAR AS id, {title_and_abstract} FROM src WHERE {VALID})
    SELECT id, {S.clean_of('title')} AS title_raw, {S.clean_of('abstract')} AS abstract_raw FROM a"""


@query(
    "read_xml_corpus",
    _article_twin(f"regexp_replace({TITLE}, '<[^>]*>', '', 'g') AS title, {ABSTRACT} AS abstract"),
)
def read_xml_corpus(spark, sf_dir):
    """Documents written as record XML and read back."""
    path = scratch_path(spark, "corpus-xml")
    article_records(spark, sf_dir).write.format("xml").option("rootTag", "records").option("rowTag", R.ARTICLE_ROW).save(path)
    return readers.read_xml_corpus(spark, path).select("id", "title_raw", "abstract_raw")


@query(
    "read_csv_corpus",
    f"""SELECT doc_id::VARCHAR AS id, source AS type, lang AS year, {S.clean_of('text')} AS abstract_raw,
      'alpha_b;gamma_d' AS authors, 'key one;' || lang AS keywords FROM documents""",
)
def read_csv_corpus(spark, sf_dir):
    """Documents written as the positional table and read back."""
    path = scratch_path(spark, "corpus-csv")
    cells = {
        0: F.col("source"), 1: F.col("lang"), 2: F.concat(F.lit("Title "), F.col("source")), 3: F.col("doc_id").cast("string"),
        9: F.col("text"), 10: F.lit("Alpha, B.; Gamma, D."), 12: F.lit("x1;x2"),
        13: F.concat(F.lit("Key One, "), F.col("lang")),
    }
    rows = table(spark, sf_dir, "documents").select(
        *[cells.get(i, F.lit("")).alias(f"_c{i}") for i in range(readers.CSV_COLUMNS)]
    )
    rows.write.option("quote", '"').option("escape", '"').option("quoteAll", True).csv(path)
    return readers.read_csv_corpus(spark, path).select(
        "id", "type", "year", "abstract_raw", F.array_join("authors", ";").alias("authors"),
        F.array_join("keywords", ";").alias("keywords"),
    )


@query("read_id_list", "SELECT DISTINCT doc_id::VARCHAR AS doc_id FROM labels WHERE quality = 1")
def read_id_list(spark, sf_dir):
    path = scratch_path(spark, "ids")
    ids = table(spark, sf_dir, "labels").filter("quality = 1")
    ids.select(F.concat(F.lit(" "), F.col("doc_id").cast("string"), F.lit(" ")).alias("value")).write.text(path)
    return readers.read_id_list(spark, path)


@query("read_phrase_list", "SELECT regexp_replace(p_name, '^ +| +$', '', 'g') AS phrase FROM part")
def read_phrase_list(spark, sf_dir):
    path = scratch_path(spark, "phrases")
    table(spark, sf_dir, "part").select(F.concat(F.col("p_name"), F.lit("  ")).alias("value")).write.text(path)
    return readers.read_phrase_list(spark, path)


@query(
    "read_xy_layout",
    """SELECT row_number() OVER (ORDER BY vec_id) - 1 AS idx, round(embedding[1]::DOUBLE, 4) AS x,
      round(embedding[2]::DOUBLE, 4) AS y FROM embeddings""",
)
def read_xy_layout(spark, sf_dir):
    path = scratch_path(spark, "layout")
    rows = global_rank(vectors(spark, sf_dir).select("doc_id", "vector"), [F.col("doc_id")], "idx", start=0)
    v = F.col("vector")
    rows.select(F.format_string("%d %.8f %.8f", "idx", v[0], v[1]).alias("value")).write.text(path)
    found = readers.read_xy_layout(spark, path, numbered=True)
    return found.select("idx", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


def layout_nodes(spark, sf_dir):
    ids = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return retrieval.highlight_flag(vectors(spark, sf_dir), ids)


@query(
    "write_graph_xml",
    f"WITH {SYMMETRIC} SELECT (source + 1)::VARCHAR AS source, (target + 1)::VARCHAR AS target, weight FROM sym WHERE weight > 0",
)
def write_graph_xml(spark, sf_dir):
    """The undirected graph written as elements, its edges read back."""
    path = scratch_path(spark, "graph")
    nodes = layout_nodes(spark, sf_dir).select(F.col("doc_id").alias("node"), "if_highlight")
    writers.write_graph_xml(nodes, G.symmetric_edges(quantity_edges(spark, sf_dir)), path)
    return readers.read_graph_edges(spark, f"{path}/edges")


@query(
    "read_graph_xml",
    """SELECT (vec_id + 1)::VARCHAR AS node, round(embedding[1]::DOUBLE, 6) + 0.0 AS x,
      round(embedding[2]::DOUBLE, 6) + 0.0 AS y, label::VARCHAR AS "class" FROM embeddings""",
)
def read_graph_xml(spark, sf_dir):
    """Nodes with a place and a community, written as a layout tool does and read back."""
    path = scratch_path(spark, "nodes")
    v = F.col("vector")
    values = F.array(F.struct(F.lit("modularity_class").alias("_for"), F.col("label").cast("string").alias("_value")))
    rows = vectors(spark, sf_dir).select(
        (F.col("doc_id") + 1).cast("string").alias("_id"),
        F.struct(values.alias("attvalue")).alias("attvalues"),
        F.struct(v[0].alias("_x"), v[1].alias("_y")).alias("position"),
    )
    rows.write.format("xml").option("rootTag", "nodes").option("rowTag", "node").save(path)
    found = readers.read_graph_xml(spark, path)
    return found.select(
        "node", (F.round("x", 6) + F.lit(0.0)).alias("x"), (F.round("y", 6) + F.lit(0.0)).alias("y"), "class"
    )


@query(
    "write_matrix_text",
    f"""WITH {TFIDF} SELECT doc_id, term, round(weight, 2) AS value FROM tfidf""",
)
def write_matrix_text(spark, sf_dir):
    docs, rows = document_rows(spark, sf_dir)
    path = scratch_path(spark, "matrix")
    writers.write_matrix_text(terms.tfidf(rows, docs), path)
    return spark.read.csv(path, sep=" ", schema="doc_id bigint, term string, value double")


@query(
    "write_links_json",
    f"""WITH {SYMMETRIC} SELECT source, target, weight AS value, round(embedding[1]::DOUBLE, 6) + 0.0 AS combine_x,
      round(embedding[2]::DOUBLE, 6) + 0.0 AS combine_y FROM sym LEFT JOIN embeddings ON source = vec_id""",
)
def write_links_json(spark, sf_dir):
    path = scratch_path(spark, "links")
    v = F.col("vector")
    layout = vectors(spark, sf_dir).select("doc_id", v[0].alias("x"), v[1].alias("y"))
    writers.write_links_json(G.symmetric_edges(quantity_edges(spark, sf_dir)), layout, path)
    found = spark.read.json(path, schema="source bigint, target bigint, value double, combine_x double, combine_y double")
    return found.select(
        "source", "target", "value", (F.round("combine_x", 6) + F.lit(0.0)).alias("combine_x"),
        (F.round("combine_y", 6) + F.lit(0.0)).alias("combine_y"),
    )


@query(
    "edge_fields",
    f"""WITH {SYMMETRIC} SELECT source AS doc_id, 0 AS chunk, string_agg(target::VARCHAR, ',' ORDER BY target) AS edges,
      round(sum(weight), 4) AS total FROM sym GROUP BY source""",
)
def edge_fields(spark, sf_dir):
    rows = writers.edge_fields(G.symmetric_edges(quantity_edges(spark, sf_dir)))
    return rows.select(
        "doc_id", "chunk", F.array_join(F.transform("edges", lambda e: e.cast("string")), ",").alias("edges"),
        F.round(V.total(F.col("weights")), 4).alias("total"),
    )
