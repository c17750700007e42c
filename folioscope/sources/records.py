"""Schemas of bibliographic records and their projection to document rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as T

# Element names of the input records. Text elements are strings, which keeps leading zeros.
ARTICLE_ROW = "MedlineCitation"
BOOK_ROW = "BookDocument"
ARTICLE_FIELDS = {
    "Journal": "struct<Title:string,JournalIssue:struct<PubDate:struct<Year:string,MedlineDate:string>>>",
    "ArticleTitle": "string",
    "Abstract": "struct<AbstractText:array<string>>",
    "AuthorList": "struct<Author:array<struct<LastName:string,ForeName:string,Initials:string>>>",
    "PublicationTypeList": "struct<PublicationType:array<string>>",
    "PublicationType": "array<string>",
}
LIST_FIELDS = {
    "KeywordList": "struct<Keyword:array<string>>",
    "MeshHeadingList": "struct<MeshHeading:array<struct<DescriptorName:string>>>",
    "CommentsCorrectionsList": "struct<CommentsCorrections:array<struct<_RefType:string,PMID:string>>>",
}
ARTICLE_TYPE = "struct<" + ",".join(f"{name}:{kind}" for name, kind in ARTICLE_FIELDS.items()) + ">"


def _schema(fields: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in fields.items())


ARTICLE_SCHEMA = _schema({"PMID": "string", "Article": ARTICLE_TYPE, **LIST_FIELDS})
BOOK_SCHEMA = _schema(
    {"PMID": "string", "Book": "struct<PubDate:struct<Year:string>>", **ARTICLE_FIELDS, **LIST_FIELDS}
)

ENTRIES = "array<string>"


def _entries(items: Column) -> Column:
    """Array without nulls; an absent list is empty."""
    return F.coalesce(F.filter(items, lambda x: x.isNotNull()), F.array().cast(ENTRIES))


def publication_year(year: Column, free_date: Column) -> Column:
    """The year, else all digits of the free-form date: a range of years gives eight digits."""
    return F.coalesce(year, T.digits_of(free_date))


def default_type(journal: Column) -> Column:
    return F.coalesce(journal, F.lit("book"))


def concat_sections(sections: Column) -> Column:
    """Text of all sections joined by blanks, null ones skipped; no abstract gives an empty text."""
    return F.coalesce(F.array_join(F.filter(sections, lambda s: s.isNotNull()), " "), F.lit(""))


def author_list(authors: Column) -> Column:
    """``Last_Initials`` of every author who has a last name, a fore name and initials."""
    complete = F.filter(
        authors, lambda a: a["LastName"].isNotNull() & a["ForeName"].isNotNull() & a["Initials"].isNotNull()
    )
    clean = lambda part: T.strip_blanks(T.strip_non_ascii(part))
    names = F.transform(complete, lambda a: F.concat_ws("_", clean(a["LastName"]), clean(a["Initials"])))
    return F.coalesce(names, F.array().cast(ENTRIES))


def cited_refs(items: Column) -> Column:
    """Ids of the related items of type "Cites"."""
    cites = F.filter(items, lambda x: (x["_RefType"] == "Cites") & x["PMID"].isNotNull())
    return F.coalesce(F.transform(cites, lambda x: T.strip_blanks(x["PMID"])), F.array().cast(ENTRIES))


def normalize_tokens_list(items: Column, drop_punctuation: bool) -> Column:
    return F.transform(items, lambda e: T.normalize_entry(e, drop_punctuation))


def article_or_book(article: Column, book: Column) -> Column:
    """The article branch if there is one, else the book branch."""
    return F.coalesce(article, book)


def valid_record_filter(title: str = "title", key: str = "id") -> Column:
    """A record counts if it has an id and a title that is not empty."""
    return F.col(key).isNotNull() & F.col(title).isNotNull() & (F.length(title) > 0)


def _common() -> list[Column]:
    keywords = _entries(F.col("KeywordList.Keyword"))
    headings = _entries(F.col("MeshHeadingList.MeshHeading.DescriptorName"))
    return [
        F.transform(keywords, T.strip_non_ascii).alias("keywords"),
        normalize_tokens_list(keywords, False).alias("keyword_tokens"),
        F.transform(headings, T.strip_non_ascii).alias("terms"),
        normalize_tokens_list(headings, True).alias("term_tokens"),
        cited_refs(F.col("CommentsCorrectionsList.CommentsCorrections")).alias("refs"),
    ]


def document_fields(records: DataFrame, branch: str, strict: bool = False) -> DataFrame:
    """Document rows of article records (``branch="article"``) or book records (``branch="book"``).

    Inner markup of titles and abstracts is dropped; ``strict`` cuts a text at its first tag instead.
    """
    at = "Article." if branch == "article" else ""
    title = T.strip_markup(F.col(f"{at}ArticleTitle"), strict)
    sections = F.transform(f"{at}Abstract.AbstractText", lambda s: T.strip_markup(s, strict))
    abstract = concat_sections(sections)
    issue = f"{at}Journal.JournalIssue.PubDate"
    if branch == "article":
        year = publication_year(F.col(f"{issue}.Year"), F.col(f"{issue}.MedlineDate"))
    else:
        year = F.col("Book.PubDate.Year")
    kinds = F.coalesce(F.col(f"{at}PublicationType"), F.col(f"{at}PublicationTypeList.PublicationType"))
    pubtypes = _entries(kinds)
    rows = records.select(
        T.strip_blanks(F.col("PMID")).alias("id"),
        year.alias("year"),
        default_type(F.col(f"{at}Journal.Title")).alias("type"),
        title.alias("title"),
        T.clean_raw_text(title).alias("title_raw"),
        T.clean_raw_text(abstract).alias("abstract_raw"),
        author_list(F.col(f"{at}AuthorList.Author")).alias("authors"),
        F.transform(pubtypes, T.strip_non_ascii).alias("pubtypes"),
        normalize_tokens_list(pubtypes, True).alias("pubtype_tokens"),
        *_common(),
    )
    return rows.filter(valid_record_filter()).drop("title")


def last_per_id(docs: DataFrame, position: str = "position", key: str = "id") -> DataFrame:
    """Of several records with one id the last by position, as a partial maximum."""
    rest = [c for c in docs.columns if c not in (key, position)]
    last = docs.groupBy(key).agg(F.max_by(F.struct(*rest), position).alias("_r"), F.max(position).alias(position))
    return last.select(key, position, *[F.col(f"_r.{c}").alias(c) for c in rest])


def csv_fields(rows: DataFrame) -> DataFrame:
    """Document rows of the positional table: 0 type, 1 year, 2 title, 3 id, 9 abstract, 10 authors,
    12 references, 13 keywords."""
    cell = lambda i: F.coalesce(T.strip_blanks(F.col(f"_c{i}")), F.lit(""))

    def listed(i: int, mark: str) -> Column:
        parts = F.transform(F.split(T.strip_non_ascii(cell(i)), mark), T.strip_blanks)
        return F.filter(parts, lambda p: F.length(p) > 0)

    def name(author: Column) -> Column:
        """``last_first``: comma and blanks become one underscore, dots go."""
        return F.lower(F.translate(F.regexp_replace(author, ", | ", "_"), ".", ""))

    return rows.select(
        cell(3).alias("id"),
        cell(1).alias("year"),
        cell(0).alias("type"),
        T.clean_raw_text(cell(2)).alias("title_raw"),
        T.clean_raw_text(cell(9)).alias("abstract_raw"),
        F.transform(listed(10, ";"), name).alias("authors"),
        F.array(cell(0)).alias("pubtypes"),
        F.transform(listed(13, ","), F.lower).alias("keywords"),
        F.transform(listed(13, ","), lambda k: T.normalize_entry(k, False)).alias("keyword_tokens"),
        listed(12, ";").alias("refs"),
        category_marker(cell(3)).alias("marker"),
    )


def category_marker(kind: Column) -> Column:
    """Marker by the first category found in a string."""
    # The categories and their markers.
    return F.when(kind.contains("Visual"), "v").when(kind.contains("Big Data"), "o").otherwise("*")
