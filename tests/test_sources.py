"""Readers and writers on hand-written fixtures."""

import json

from pyspark.sql import functions as F

from folioscope.sources import readers, records, writers

ARTICLES = """<Set>
<PubmedArticle><MedlineCitation><PMID Version="1">007</PMID><Article><Journal><JournalIssue><PubDate><Year>2001</Year></PubDate>
</JournalIssue><Title>Journal A</Title></Journal><ArticleTitle>Deep <i>in vivo</i> "study"</ArticleTitle>
<Abstract><AbstractText Label="AIM">First part.</AbstractText><AbstractText>Second part.</AbstractText></Abstract>
<AuthorList><Author><LastName>Doe</LastName><ForeName>Jane</ForeName><Initials>J</Initials></Author>
<Author><LastName>Roe</LastName><ForeName>Rob</ForeName></Author></AuthorList>
<PublicationTypeList><PublicationType>Journal Article</PublicationType></PublicationTypeList></Article>
<KeywordList><Keyword>Big Thing</Keyword></KeywordList>
<MeshHeadingList><MeshHeading><DescriptorName>Heart, Left</DescriptorName></MeshHeading></MeshHeadingList>
<CommentsCorrectionsList><CommentsCorrections RefType="Cites"><PMID>9</PMID></CommentsCorrections>
<CommentsCorrections RefType="ErratumIn"><PMID>8</PMID></CommentsCorrections></CommentsCorrectionsList>
</MedlineCitation></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>8</PMID><Article><Journal><JournalIssue><PubDate><MedlineDate>1998-1999</MedlineDate></PubDate>
</JournalIssue><Title>Journal B</Title></Journal><ArticleTitle>Plain title</ArticleTitle></Article></MedlineCitation></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>9</PMID><Article><Journal><JournalIssue><PubDate><Year>2002</Year></PubDate></JournalIssue>
<Title>Journal C</Title></Journal><ArticleTitle></ArticleTitle></Article></MedlineCitation></PubmedArticle>
<PubmedBookArticle><BookDocument><PMID>10</PMID><Book><PubDate><Year>1990</Year></PubDate></Book>
<ArticleTitle>A chapter</ArticleTitle><Abstract><AbstractText>Text.</AbstractText></Abstract></BookDocument></PubmedBookArticle>
</Set>"""


def xml_rows(spark, tmp_path, strict=False):
    path = tmp_path / "records.xml"
    path.write_text(ARTICLES)
    return {r["id"]: r for r in readers.read_xml_corpus(spark, str(path), strict).collect()}


def test_read_xml_corpus(spark, tmp_path):
    rows = xml_rows(spark, tmp_path)
    assert sorted(rows) == ["007", "10", "8"]
    first = rows["007"]
    assert first["title_raw"] == "Deep in vivo study"
    assert first["abstract_raw"] == "First part. Second part."
    assert (first["year"], first["type"]) == ("2001", "Journal A")
    assert first["authors"] == ["Doe_J"]
    assert first["refs"] == ["9"]
    assert first["keyword_tokens"] == ["big_thing"] and first["term_tokens"] == ["heart_left"]
    assert first["pubtype_tokens"] == ["journal_article"]
    assert rows["8"]["year"] == "19981999" and rows["8"]["abstract_raw"] == ""
    assert (rows["10"]["type"], rows["10"]["year"]) == ("book", "1990")


def test_strict_cuts_at_first_tag(spark, tmp_path):
    assert xml_rows(spark, tmp_path, strict=True)["007"]["title_raw"] == "Deep"


def test_last_per_id(spark):
    rows = spark.createDataFrame([("a", 0, "x"), ("a", 2, "y"), ("b", 1, "z")], "id string, position int, t string")
    assert {r["id"]: r["t"] for r in records.last_per_id(rows).collect()} == {"a": "y", "b": "z"}


def test_read_csv_corpus(spark, tmp_path):
    path = tmp_path / "corpus.csv"
    cells = ["Visual", "2015", 'A ""quoted"" title', "Big Data/1", "", "", "", "", "", "Line one\nline two", "Li, X. Y.; Roe, Z.", "", "r1; r2", "K One,k two"]
    path.write_text(",".join(f'"{c}"' for c in cells) + "\n")
    row = readers.read_csv_corpus(spark, str(path)).collect()[0]
    assert row["title_raw"] == "A quoted title" and row["abstract_raw"] == "Line one line two"
    assert row["authors"] == ["li_x_y", "roe_z"] and row["refs"] == ["r1", "r2"]
    assert row["keyword_tokens"] == ["k_one", "k_two"] and row["marker"] == "o"


def test_lists(spark, tmp_path):
    path = tmp_path / "ids.txt"
    path.write_text("12 \n 13\n\n12\n")
    assert sorted(r[0] for r in readers.read_id_list(spark, str(path)).collect()) == ["12", "13"]
    assert readers.read_phrase_list(spark, str(tmp_path / "absent.txt")).count() == 0


def test_layout_keeps_line_order(spark, tmp_path):
    path = tmp_path / "xy.txt"
    path.write_text("".join(f"{i} {-i}.5\n" for i in range(50)))
    rows = readers.read_xy_layout(spark, str(path)).orderBy("idx").collect()
    assert [r["x"] for r in rows] == [float(i) for i in range(50)]


def test_graph_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([(0, "1"), (1, "0")], "node long, if_highlight string")
    edges = spark.createDataFrame([(0, 1, 0.5), (1, 0, 0.0)], "source long, target long, weight double")
    writers.write_graph_xml(nodes, edges, str(tmp_path / "g"))
    found = readers.read_graph_edges(spark, str(tmp_path / "g" / "edges")).collect()
    assert [tuple(r) for r in found] == [("1", "2", 0.5)]


def test_vector_files(spark, tmp_path):
    docs = spark.createDataFrame([(1, [1.0, 3.0]), (2, [2.0, 5.0])], "doc_id long, vector array<double>")
    for name, df in writers.vector_forms(docs).items():
        writers.write_vectors_by_dim(df, str(tmp_path / f"{name}_dim"), 2)
        writers.write_vectors_by_doc(df, str(tmp_path / f"{name}_doc"))
    scaled = spark.read.csv(str(tmp_path / "norm_dim_dim"), header=True, inferSchema=True).orderBy("doc_id").collect()
    assert [tuple(r) for r in scaled] == [(1, 0.0, 0.0), (2, 1.0, 1.0)]
    assert spark.read.csv(str(tmp_path / "raw_doc"), header=True).count() == 4


def test_feature_json_replaces_nulls_at_the_sink(spark, tmp_path):
    rows = spark.createDataFrame([("a", None, 3)], "id string, year string, number_of_citations int")
    writers.write_feature_json(rows, str(tmp_path / "f"))
    written = [json.loads(line) for p in (tmp_path / "f").glob("part-*") for line in p.read_text().splitlines()]
    assert written == [{"id": "a", "year": "", "number_of_citations": 3}]


def test_matrix_text(spark):
    cells = spark.createDataFrame([(1, "a", 0.126)], "doc_id long, term string, weight double")
    assert writers.matrix_text(cells).select(F.col("value")).first()[0] == "0.13"


def test_graph_files_do_not_grow_with_the_graph(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "XML_FILE_ROWS", 10)
    nodes = spark.range(45).select(F.col("id").alias("node"), F.lit(0).alias("if_highlight")).coalesce(1)
    edges = spark.range(35).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"), F.lit(1.5).alias("weight")).coalesce(1)
    writers.write_graph_xml(nodes, edges, str(tmp_path / "graph"))
    assert len(list((tmp_path / "graph" / "nodes").glob("part-*"))) == 5
    assert len(list((tmp_path / "graph" / "edges").glob("part-*"))) == 4
    assert readers.read_graph_edges(spark, str(tmp_path / "graph" / "edges")).count() == 35
