import math
from collections import Counter

import corpus_pipeline
import pytest

from test_language_id import plain_predict, plain_profile, plain_counts
from test_native import grams
from test_near_copies import plain_kept
from test_secret_scans import S

from folioscope.llm.language_id import CLASS_ROWS, LOW, MARGIN

DATA = "/root/testdata/sf0.001"


def plain_bounds(told):
    """The least score of each language and length class, and of each language, by sorting."""
    classes = {}
    for d, (name, score) in told:
        if d.lang == name:
            classes.setdefault((name, len(d.text).bit_length()), []).append(score)
            classes.setdefault((name, None), []).append(score)
    low = {c: sorted(s)[math.ceil(LOW * len(s)) - 1] * MARGIN for c, s in classes.items() if c[1] is None or len(s) >= CLASS_ROWS}
    return lambda name, text: max(corpus_pipeline.LEAST_LANGUAGE_SCORE, low.get((name, len(text).bit_length()), low.get((name, None), 0.0)))


def plain_pipeline(docs, items):
    counts = {}
    for d in docs:
        if d.lang and d.text:
            counts.setdefault(d.lang, Counter()).update(plain_counts(d.text))
    profiles = {name: plain_profile(c) for name, c in counts.items()}
    told = [(d, plain_predict(d.text, profiles)) for d in docs]
    bound = plain_bounds(told)
    kept = sorted((d for d, (name, score) in told if name != "und" and score >= bound(name, d.text)), key=lambda d: d.doc_id)
    kept = [kept[i] for i in plain_kept([d.text for d in kept])]
    sought = [g for _, t in items if (g := grams(t, 5))]
    kept = [d for d in kept if not any(10 * len(g & grams(d.text, 5)) >= 8 * len(g) for g in sought)]
    return {d.doc_id: S.redacted(d.text, S.scan(d.text)) for d in kept}


def test_rows_equal_a_plain_pipeline(shipped):
    docs = shipped.read.parquet(f"{DATA}/documents.parquet").collect()
    items = shipped.read.parquet(f"{DATA}/benchmark.parquet").collect()
    want = plain_pipeline(docs, [(i.item_id, i.text) for i in items])
    rows = corpus_pipeline.run(shipped, DATA).collect()
    assert sorted(r.doc_id for r in rows) == sorted(want)
    assert all(r.exact and r.n_tokens == len(r.ids) and r.n_chars == len(want[r.doc_id]) for r in rows)
    import public_tokenizers

    from folioscope.llm.byte_bpe import coder

    code = coder(public_tokenizers.path(corpus_pipeline.RANKS), public_tokenizers.PATTERN)
    import numpy as np

    assert all(code.bytes_of(np.array(r.ids)).decode() == want[r.doc_id] for r in rows)


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_odd_tables(docs_of, stage):
    name, run = corpus_pipeline.STAGES[stage]
    docs = docs_of([None, "", "the cat and the dog", "the cat and the dog", (None, "with the other things there"), "1 2 3", "the " * 30_000])
    odd = docs.selectExpr(
        "*", "'a' as lang_pred", "1.0 as score", "2 as fp", "3 as key", "4 as ids", "5 as secrets", "6 as decoded", "7 as words"
    )
    spark = docs.sparkSession
    result = run(spark, odd, DATA)
    if stage < 4:
        assert result.columns == odd.columns
    counts = result.count()
    assert counts == {0: 4, 1: 5, 2: 7, 3: 7, 4: 7}[stage]
    assert run(spark, odd.filter("false"), DATA).count() == 0


def test_tokens_take_one_worker_a_task(docs_of, capsys):
    made = corpus_pipeline.tokens(docs_of([]).sparkSession, docs_of(["the cat", None, "日本語 and 😀"]), DATA)
    made.explain()
    # each Python node of a task is a worker of its own, with a vocabulary and a cache of its own
    assert capsys.readouterr().out.count("MapInArrow") == 1
    assert all(r.exact and r.n_tokens == len(r.ids) for r in made.collect()) and made.count() == 3


def test_contract():
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None
