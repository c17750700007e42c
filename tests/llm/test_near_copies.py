import random

import corpus_pipeline
import pytest

from folioscope.llm import near_copies


def plain_set(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def plain_kept(texts):
    sets, label = [plain_set(t) for t in texts], list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return [i for i, x in enumerate(label) if x == i]


def edited(words, rng, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.random()}"
    return " ".join(words)


def varied():
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.randrange(100_000)}" for _ in range(n)]
    base, passage = fresh(120), fresh(40)
    texts = [" ".join(base)] + [edited(base, rng, rng.randrange(0, 5)) for _ in range(60)]
    texts += [" ".join(passage + fresh(rng.choice([3, 8, 200]))) for _ in range(50)]
    for _ in range(20):
        own = fresh(rng.randrange(4, 300))
        texts += [" ".join(own), edited(own, rng, max(0, min(len(own) // 40, 4))), " ".join(own[: int(len(own) * 0.85)])]
    return texts + ["", "a b", "A  b", " ".join(base).upper()]


@pytest.mark.parametrize("limits", [{}, {"SHARED": 2}, {"TILE_SETS": 7, "SHARED": 5}, {"COMMON": 0}])
def test_all_similar_texts_are_found(docs_of, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(near_copies, name, value)
    texts = varied()
    kept = near_copies.keep_one_of_each(docs_of(texts)).collect()
    assert sorted(r.doc_id for r in kept) == plain_kept(texts)


def test_the_stage_drops_a_text_with_changed_words(docs_of):
    rng = random.Random(1)
    words = [f"w{rng.randrange(10_000)}" for _ in range(200)]
    texts = [" ".join(words), edited(words, rng, 3), " ".join(words[:100])]
    stage = dict(zip([10, 2], [run for _, run in corpus_pipeline.STAGES]))[2]
    kept = stage(docs_of(texts).sparkSession, docs_of(texts), "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2]


def test_rows_that_differ_by_where_a_null_is_are_different(shipped):
    rows = [(1, "a text of its own", "x", None), (1, "other words in this row", None, "x"), (1, "a text of its own", "x", None)]
    docs = shipped.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    assert near_copies.keep_one_of_each(docs).count() == 2


def test_the_stage_links_texts_by_fingerprints_as_well(docs_of):
    from folioscope.llm import simhash

    # the repeated line decides every bit, and the other words most of the sets of shingles
    line = "one line of words over and over "
    texts = [line * 60 + " ".join(f"{name}{i}" for i in range(12)) for name in ("left", "right")]
    texts += ["a text of other words than these", texts[0].replace("line", "row")]
    assert simhash.fingerprint(texts[0]) == simhash.fingerprint(texts[1]) and plain_kept(texts) == [0, 1, 2, 3]
    run = dict(corpus_pipeline.STAGES)["near-dedup"]
    kept = run(docs_of(texts).sparkSession, docs_of(texts), "").collect()
    assert sorted(r.doc_id for r in kept) == [0, 2, 3]


def test_pairs_of_a_group_are_not_all_compared(docs_of, monkeypatch):
    tried = []
    whole = near_copies._similar
    monkeypatch.setattr(near_copies, "_similar", lambda pairs, sets: tried.append(pairs.count()) or whole(pairs, sets))
    rng = random.Random(3)
    words = [f"w{rng.randrange(100_000)}" for _ in range(300)]
    texts = [edited(words, rng, 1) for _ in range(20)]
    assert [r.doc_id for r in near_copies.keep_one_of_each(docs_of(texts)).collect()] == [0]
    # 190 pairs
    assert 0 < sum(tried) <= 19


def test_texts_move_once_and_only_at_the_end(docs_of, monkeypatch, capsys):
    texts = [f"text {i % 40} of some words that no other text has {i % 40}" for i in range(60)]
    made = near_copies.keep_one_of_each(docs_of(texts))
    made.explain()
    # dealt for the join with the rows that stay; the window and the other side take no further one
    assert capsys.readouterr().out.count("Exchange hashpartitioning") <= 2
    monkeypatch.setattr(near_copies, "BROADCAST_ROWS", 0)
    for result in (made, near_copies.keep_one_of_each(docs_of(texts))):
        assert sorted(r.doc_id for r in result.collect()) == plain_kept(texts)
