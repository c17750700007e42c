import hashlib
import random
import zlib

import pytest

from folioscope.llm import periodic_runs


def plain_runs(words, least=24, repeats=3):
    """Every stretch of each period, compared word by word; periods that are not the smallest go."""
    found = []
    for period in range(1, len(words) // repeats + 1):
        at = 0
        while at + period < len(words):
            end = at
            while end + period < len(words) and words[end] == words[end + period]:
                end += 1
            if end > at and end + period - at >= max(least, repeats * period):
                own = words[at : end + period]
                if not any(own[q:] == own[:-q] for q in range(1, period)):
                    found.append((at, len(own), period))
            at = max(end, at + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def varied(rng, n):
    texts = []
    for _ in range(n):
        kinds = rng.choice([1, 2, 3, 50])
        words = [f"w{rng.randrange(kinds)}" for _ in range(rng.choice([0, 1, 5, 24, 60, 150]))]
        for _ in range(rng.randrange(3)):
            unit = [f"w{rng.randrange(kinds + 1)}" for _ in range(rng.randrange(1, 12))]
            at = rng.randrange(len(words) + 1)
            words[at:at] = unit * rng.randrange(2, 12)
        texts.append(words)
    return texts


@pytest.mark.parametrize("least, repeats", [(24, 3), (6, 2), (10, 3), (1, 2), (30, 5)])
def test_runs_equal_the_plain_ones(least, repeats):
    texts = varied(random.Random(least), 150)
    given = [[w.encode() for w in words] for words in texts]
    for at in range(0, len(given), 7):
        want = [plain_runs(words, least, repeats) for words in given[at : at + 7]]
        assert periodic_runs.find_runs(given[at : at + 7], least, repeats) == want


def plain_digest(doc_id, text):
    words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if doc_id is not None and words and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        n, g = len(words), zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else (None, None, None)
    return (
        doc_id, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2],
        hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest(),
    )


def test_query_equals_plain_digests(docs_of):
    texts = [" ".join(words) for words in varied(random.Random(3), 120)] + [None, "", " \t\n", "é è " * 40, "é è " * 40]
    rows = periodic_runs.digest(docs_of([*enumerate(texts), (None, "a " * 50), (3, "again " * 24)])).collect()
    want = [plain_digest(i, t) for i, t in [*enumerate(texts), (None, "a " * 50), (3, "again " * 24)]]
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)


def test_given_documents(shipped):
    from folioscope.llm.queries import op13_periodic_runs

    docs = shipped.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    short = [d for d in docs if len(d.text or "") < 3000]
    got = {r.doc_id: tuple(r) for r in op13_periodic_runs(shipped, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs) and any(r[1] for r in got.values())
    assert [got[d.doc_id] for d in short] == [plain_digest(d.doc_id, d.text) for d in short]


def test_odd_tables(docs_of):
    docs = docs_of([None, "", "the cat " * 12, "a " * 200_000, "the cat " * 12]).selectExpr("*", "1 as runs", "2 as collapsed", "3 as start")
    rows = {r.doc_id: r for r in periodic_runs.periodic_runs(docs).collect()}
    assert periodic_runs.periodic_runs(docs).columns == ["doc_id", "text", "lang", "source", "n_chars", "start", "runs", "collapsed"]
    assert [rows[i].collapsed for i in range(5)] == ["", "", "the cat", "a", "the cat"]
    assert [tuple(r) for r in rows[3].runs] == [(0, 200_000, 1)] and [tuple(r) for r in rows[2].runs] == [(0, 24, 2)]
    assert rows[0].runs == [] and rows[0].text is None and rows[0].start == 3
    assert periodic_runs.periodic_runs(docs.filter("false")).count() == 0
    assert periodic_runs.digest(docs.filter("false")).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(docs, repeats=1)
