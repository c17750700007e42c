import random

import corpus_pipeline

from folioscope.llm import language_id

POLISH = "W Szczebrzeszynie chrząszcz brzmi w trzcinie i Szczebrzeszyn z tego słynie, a wszyscy ludzie wiedzą o tym dobrze"


def test_gibberish_and_unlearned_languages_go(shipped):
    docs = shipped.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rng = random.Random(1)
    junk = [
        " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n))
        for n in (200, 200, 500, 1000, 2000, 2000)
    ]
    clean = ["the cat and the dog", "that is the end of the thing", "el perro de la casa es de ella"]
    texts = [*junk, POLISH, *clean]
    added = shipped.createDataFrame([(10**9 + i, t, None, "s", len(t)) for i, t in enumerate(texts)], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.known_languages(shipped, docs.union(added), "").select("doc_id").collect()}
    assert sorted(i - 10**9 for i in kept if i >= 10**9) == [len(junk) + 1 + i for i in range(len(clean))]
    given = {r.doc_id for r in docs.select("doc_id").collect()}
    assert given <= kept


def test_without_labels_only_texts_without_letters_go(docs_of):
    docs = docs_of(["plain words", None, "", "1 2 3", "xqz"], lang=None)
    assert sorted(r.doc_id for r in language_id.in_known_language(docs, 0.2).collect()) == [0, 4]
