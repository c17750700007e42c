import random

import numpy as np
import xxhash

from folioscope.llm import simhash
from folioscope.llm.components import components


def plain_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in lowered).split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, radius=2):
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i in range(len(prints)):
            for j in range(len(prints)):
                if label[j] < label[i] and (prints[i] ^ prints[j]).bit_count() <= radius:
                    label[i], changed = label[j], True
    return label


def corpus():
    random.seed(3)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [" ".join(random.choices(vocabulary, k=random.choice([3, 40, 300]))) for _ in range(30)]
    near = []
    for text in base:
        words = text.split()
        words[0] = "Changed"
        near.append(" ".join(words))
    return [*base, *base[:5], *near, "", None, " \n ", "one", "two words", "ONE", "é\xa0x\x85y É", "a b c " * 3000]


def test_fingerprints_and_groups(docs_of):
    texts = corpus()
    rows = sorted(simhash.simhash_groups(docs_of(texts)).collect())
    prints = [plain_fingerprint(t) for t in texts]
    assert [r.fingerprint for r in rows] == [f"{p:016x}" for p in prints]
    assert [r.component_id for r in rows] == plain_groups(prints)


def test_links_are_exact_however_buckets_are_split(shipped):
    random.seed(5)
    centres = [random.getrandbits(64) for _ in range(20)]
    prints = {c ^ sum(1 << b for b in random.sample(range(64), random.randint(0, 4))) for c in centres for _ in range(60)}
    signed = [(int(np.array(p, np.uint64).view(np.int64)),) for p in prints]
    frame = shipped.createDataFrame(signed, "fp bigint")
    ordered = sorted(v for v, in signed)
    label = plain_groups([v & (1 << 64) - 1 for v in ordered])
    want = {v: ordered[l] for v, l in zip(ordered, label)}
    for rows in (simhash.BUCKET, 7):
        roots = {r.node: r.root for r in components(simhash.links(frame, 2, rows)).collect()}
        assert {v: roots.get(v, v) for v in ordered} == want


def test_large_bucket_is_tiled(monkeypatch):
    random.seed(6)
    prints = np.array(sorted({random.getrandbits(12) << 3 for _ in range(900)}), np.uint64)
    zeros, off = np.zeros(len(prints), np.int64), np.zeros(len(prints), bool)
    monkeypatch.setattr(simhash, "TILE", 64)
    a, b = simhash.linked(zeros, prints, zeros, off, 2)
    want = plain_groups([int(p) for p in prints])
    root = dict(zip(a.tolist(), b.tolist()))
    assert [int(prints[w]) for w in want] == [root.get(int(p), int(p)) for p in prints]


def test_components_of_a_path_and_loops(shipped):
    path = [(i, i + 1) for i in range(60)] + [(5, 5), (100, 99), (99, 100)]
    roots = {r.node: r.root for r in components(shipped.createDataFrame(path, "a bigint, b bigint")).collect()}
    assert roots == {**{i: 0 for i in range(1, 61)}, 100: 99}
    assert components(shipped.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_one_of_each_stays(docs_of):
    twice = "alpha beta gamma delta epsilon zeta eta theta"
    docs = docs_of([(3, twice), (2, twice), (2, twice), (None, twice), (7, "else where there is nothing"), (8, None), (None, "")])
    clash = docs.selectExpr("*", "1 as fp", "'x' as chosen", "2 as key")
    kept = simhash.keep_one_of_each(clash)
    assert kept.columns == clash.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 7, 8]
    assert simhash.keep_one_of_each(docs.filter("false")).count() == 0
    assert simhash.simhash_groups(docs.filter("false")).count() == 0
    only_null = simhash.simhash_groups(docs_of([(None, "some text"), (None, "some text")])).collect()
    assert [r.component_id for r in only_null] == [None, None]
