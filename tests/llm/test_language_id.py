from collections import Counter

import pytest

from folioscope.llm import language_id as L

DATA = "/root/testdata/sf0.001"


def plain_counts(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    grams = Counter()
    for w in words:
        for size, padded in ((1, w), (2, f" {w} "), (3, f" {w} ")):
            grams.update(padded[i : i + size] for i in range(len(padded) - size + 1))
    return grams


def number(gram):
    codes = [0 if c == " " else ord(c) for c in gram]
    head = {1: [L.ONE, 0], 2: [L.TWO], 3: []}[len(gram)]
    value = 0
    for code in [*head, *codes]:
        value = value << L.CODE_BITS | code
    return value


def plain_profile(grams):
    return {g: i for i, (_, g) in enumerate(sorted((-n, number(g)) for g, n in grams.items())[: L.PROFILE])}


def plain_predict(text, profiles):
    own = plain_profile(plain_counts(text or ""))
    if not own:
        return "und", 0.0
    sums = {
        name: sum(abs(r - ranks[g]) if g in ranks else L.PROFILE for g, r in own.items()) for name, ranks in profiles.items()
    }
    best = min(sorted(sums), key=sums.get)
    return best, round(1 - sums[best] / (len(own) * L.PROFILE), 6)


TEXTS = {
    "en": ["the quick brown fox and the other thing", "This is the end, of the things!", "with them there"],
    "es": ["el perro de la casa es de ella", "los niños y la señora", "que es esto"],
    "el": ["αυτό είναι το τέλος", "ΤΟ ΣΠΊΤΙ ΜΑΣ"],
}
ASKED = ["the", "la señora", "το σπίτι", "1234 !!", "", None, "the the the " * 5000, "x", "İstanbul ß", "日本", "a1b2 c"]


def test_equals_plain_profiles(docs_of, shipped):
    rows = [(i, t, lang) for lang, ts in TEXTS.items() for i, t in enumerate(ts)] + [(9, "nothing", None), (9, None, "en"), (None, "and the", "en")]
    learned = L.learn(shipped.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert learned.languages == sorted(TEXTS)
    profiles = {}
    for lang, texts in TEXTS.items():
        grams = Counter()
        for t in [*texts, *(["and the"] if lang == "en" else [])]:
            grams.update(plain_counts(t))
        profiles[lang] = plain_profile(grams)
    got = sorted(L.predict(docs_of(ASKED).selectExpr("*", "3 as score"), learned).collect())
    assert [(r.lang_pred, r.score) for r in got] == [plain_predict(t, profiles) for t in ASKED]


def test_counts_survive_flushing(shipped, monkeypatch):
    rows = shipped.createDataFrame([("en", "the cat sat"), ("en", "the dog"), ("es", "el gato")] * 30, "lang string, text string")
    want = sorted(L.gram_counts(rows).collect())
    batches = rows.coalesce(1).toArrow().select(["lang", "text"]).rename_columns(["language", "text"]).to_batches(max_chunksize=7)
    monkeypatch.setattr(L, "HELD_GRAMS", 20)
    totals = Counter()
    for batch in L._count_step("language", "text")(iter(batches)):
        for name, gram, n in zip(*(batch.column(c).to_pylist() for c in ("language", "gram", "n"))):
            totals[name, gram] += n
    assert sorted((a, b, n) for (a, b), n in totals.items()) == [tuple(r) for r in want]


def test_no_rows(docs_of):
    nothing = L.learn(docs_of(["x"]).filter("false"))
    assert [tuple(r)[-2:] for r in L.predict(docs_of(["some text"]), nothing).collect()] == [("und", 0.0)]
    assert L.predict(docs_of(["x"]).filter("false"), nothing).count() == 0


def test_held_out_accuracy(shipped):
    pytest.importorskip("folioscope.llm.queries")
    from folioscope.llm.queries import op10_language_id

    told = op10_language_id(shipped, DATA).join(shipped.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = told.filter("held_out").selectExpr("avg(int(lang = lang_pred))", "count(*)").first()
    assert held[1] > 20 and held[0] >= 0.98
