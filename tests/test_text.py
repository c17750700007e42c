"""Text functions, phrases and stemming on small inputs."""

import pytest
from pyspark.sql import functions as F

from folioscope.functions import porter
from folioscope.functions import text as T
from folioscope.functions.words import FUNCTION_WORDS, phrase_breakers
from folioscope.operators import embedding as E
from folioscope.operators import phrases as P
from folioscope.plans.registry import registered


def value(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column).first()[0]


def test_clean_raw_text(spark):
    assert value(spark, " \"café\" it's a\\b\nnext ", T.clean_raw_text(F.col("t"))) == "caf its a-b next"


def test_tokens_filtered(spark):
    assert value(spark, "The follow-up of 12 AEDs, a Trial x!", T.tokens_filtered(F.col("t"))) == ["followup", "trial"]


def test_content_words_are_those_of_the_tokens(spark):
    texts = ["12-34 12-ab a-b 1-2--a x-", "naïve-te -lead trail- a--b 007 7up up7", "\x01ab é é1 U.S.A. it's q", "", None]
    docs = spark.createDataFrame([(t,) for t in texts], "t string")
    words = F.transform(T.tokens(F.col("t")), T.strip_punctuation)
    plain = F.filter(words, lambda w: F.length(w).between(2, 40) & ~w.isin([*FUNCTION_WORDS, "aeds", "aed"]) & ~T.is_digits(w))
    got = docs.select(T.tokens_filtered(F.col("t")).alias("a"), plain.alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got) and got[0]["a"] == ["12ab", "ab"]
    found = docs.select(T.tokens_filtered(F.col("t")).alias("a"))
    assert T.TOKEN not in found._jdf.queryExecution().analyzed().toString()


def test_tokens_simple_keeps_sentence_ends(spark):
    assert value(spark, "The cat sat. It ran!", T.tokens_simple(F.col("t"))) == "the cat sat. it ran."


def test_sentences_and_predicates(spark):
    assert value(spark, "One. Two?  ! Three", T.sentences(F.col("t"))) == ["One", "Two", "Three"]
    for word, numeric in (("12", True), ("-1.5", True), ("1.5e3", True), ("1e3", False), ("x1", False)):
        assert value(spark, word, T.is_numeric(F.col("t"))) is numeric
    assert value(spark, "anananan", T.substring_count(F.col("t"), F.lit("anan"))) == 2
    assert value(spark, "abc", T.substring_count(F.col("t"), F.lit(""))) == 0
    assert value(spark, "<a&'\"/>", T.html_escape(F.col("t"))) == "&lt;a&amp;&#x27;&quot;&#x2F;&gt;"


def test_phrases_break_and_length(spark):
    text = "Deep brain stimulation of rats in 3 trials, of the alpha beta gamma delta epsilon zeta"
    assert value(spark, text, P.phrase_array(F.col("t"), 5)) == ["deep brain stimulation", "rats", "trials"]
    assert value(spark, text, P.phrase_array(F.col("t"), 6))[-1] == "alpha beta gamma delta epsilon zeta"


def brute_scores(phrases):
    scores = {}
    for phrase in phrases:
        for word in phrase.split():
            scores[word] = scores.get(word, 0) + len(phrase.split())
    return {p: sum(scores[w] for w in p.split()) for p in phrases}


def test_phrase_scores_match_brute_force_and_both_forms_agree(spark):
    texts = {1: "red blue of red blue, green red of blue", 2: "blue of blue blue"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    local = {(r["doc_id"], r["phrase"]): r["score"] for r in P.document_phrase_score(docs).collect()}
    joined = {(r["doc_id"], r["phrase"]): r["score"] for r in P.phrase_score(P.candidate_phrases(docs)).collect()}
    expected = {
        (1, p): s for p, s in brute_scores(["red blue", "red blue", "green red", "blue"]).items()
    } | {(2, p): s for p, s in brute_scores(["blue", "blue blue"]).items()}
    assert local == joined == expected


def test_phrases_of_documents_are_scored_without_a_shuffle(spark):
    texts = {i: "red blue of red blue, green red of blue" if i % 2 else "blue of blue blue" for i in range(40)}
    docs = spark.createDataFrame([*texts.items(), (40, None), (41, "")], "doc_id long, text string")
    for n in (2, 30):
        top = P.document_top_phrases(docs, n)
        assert "Exchange" not in top._jdf.queryExecution().executedPlan().toString()
        want = P.top_phrases(P.phrase_score(P.candidate_phrases(docs)), n=n)
        assert sorted(map(tuple, top.collect())) == sorted(map(tuple, want.select(*top.columns).collect()))
    scored = P.document_phrase_score(docs)
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()


def test_breakers():
    assert set(phrase_breakers()) == {*FUNCTION_WORDS, *"abcdefghijklmnopqrstuvwxyz0123456789"}


@pytest.mark.parametrize(
    "word, stem",
    [
        ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"),
        ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"),
        ("troubled", "troubl"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"),
        ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"),
        ("hopefulness", "hope"), ("electrical", "electr"), ("adoption", "adopt"), ("effective", "effect"),
        ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"), ("controlling", "control"), ("roll", "roll"),
    ],
)
def test_porter(word, stem):
    assert porter.stem(word) == stem


def test_attention_pairs(spark):
    rows = [(1, ["heart", "attack", "risk"])] * 2 + [(2, ["risk", "age"])] * 3
    sentences = spark.createDataFrame(rows, "doc_id long, words array<string>")
    attentions = spark.createDataFrame([("heart attack",), ("age",)], "phrase string")
    found = E.attention_context_pairs(sentences, attentions, low=0.01, high=2.0)
    assert {(r["attention"], r["context"], r["doc_id"], r["times"]) for r in found.collect()} == {
        ("heart attack", "risk", 1, 2), ("age", "risk", 2, 3),
    }


def test_attention_pairs_drop_words_outside_the_vocabulary_before_a_shuffle(spark):
    from folioscope.operators import embedding

    rows = [(i, ["heart", "attack", f"own{i}", "care"] if i % 3 else ["stock", "care"]) for i in range(30)]
    sentences = spark.createDataFrame(rows, "doc_id long, words array<string>")
    listed = spark.createDataFrame([("heart attack",), ("stock",)], "phrase string")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = embedding.attention_context_pairs(sentences, listed, low=0.1, high=1.1)
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        found = {(r["attention"], r["context"], r["doc_id"]): r["times"] for r in pairs.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    want = {("heart attack" if i % 3 else "stock", "care", i): 1 for i in range(30)}
    assert found == want and "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2


@pytest.mark.parametrize(("name", "counted"), [("flatten", "word"), ("phrase_dedupe", "phrase"), ("candidate_phrases", "phrase")])
def test_counts_per_document_are_not_shuffled(spark, name, counted):
    found = registered()[name].run(spark, "/root/testdata/sf0.001")
    dealt = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning" in line]
    assert dealt and not any(counted in line.split("hashpartitioning", 1)[1] for line in dealt)


@pytest.mark.parametrize("name", ["write_matrix_text", "term_counts", "cluster_keywords", "cluster_text"])
def test_texts_are_cut_in_all_tasks(spark, name):
    found = registered()["tfidf" if name == "write_matrix_text" else name].run(spark, "/root/testdata/sf0.001")
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
