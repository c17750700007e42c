import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from folioscope.llm import substring_dedup as S
from folioscope.llm.fm_index import FMIndex, sorted_suffixes


def plain(texts, length):
    words = [S.words_of(t) for t in texts]
    found = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    result = []
    for w in words:
        gone = set()
        for i in range(len(w) - length + 1):
            if found[tuple(w[i : i + length])] > 1:
                gone.update(range(i, i + length))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        result.append((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return result


def corpus():
    random.seed(11)
    vocabulary = [f"w{i}" for i in range(50)] + ["é", "\xa0", "\x1c", "Word", "word"]
    some = lambda n: random.choices(vocabulary, k=n)
    passage, other = some(60), some(36)
    texts = [" ".join(some(random.randint(0, 200))) for _ in range(25)]
    texts += [" ".join([*some(random.randint(0, 50)), *passage, *some(random.randint(0, 50))]) for _ in range(12)]
    texts += [" ".join([*other, *some(3), *other])]  # repeats inside one text
    texts += [texts[0], texts[0], texts[1] + " end", "start " + texts[1]]
    texts += ["x " * 34, "x " * 35, "x " * 36, "y " * 35, "a b " * 40, "", None, " \t\n\x0b\x0c\r ", "\n".join(other)]
    near = passage[:]
    near[30] = "changed"
    return [*texts, " ".join(near)]


@pytest.mark.parametrize("limits", [{}, {"shard_words": 300}, {"anchor_pieces": 1}])
def test_equals_plain_windows(docs_of, limits):
    texts = corpus()
    rows = sorted(S.dedup_substrings(docs_of(texts), digests=True, **limits).collect())
    assert [(r.n_words, r.n_removed, r.kept_sha256) for r in rows] == plain(texts, 35)


def test_short_windows_kept_text_and_repeated_rows(docs_of):
    docs = docs_of([(1, "a b c d"), (1, "a b c d"), (2, "z b c y"), (3, "q r s"), (None, "m n")])
    rows = S.dedup_substrings(docs, length=2).collect()
    assert sorted((r.doc_id or 0, r.kept) for r in rows) == [(0, "m n"), (1, ""), (1, ""), (2, "z y"), (3, "q r s")]
    assert S.dedup_substrings(docs.filter("false")).count() == 0


def test_index_counts_patterns():
    random.seed(2)
    text = np.array([random.randint(0, 5) for _ in range(400)], np.int64)
    index = FMIndex(text, 8)
    for length in (1, 2, 3, 5, 8):
        starts = np.arange(len(text) - length + 1)
        runs = [tuple(text[s : s + length]) for s in starts]
        found = Counter(runs)
        assert index.repeated(text, starts + length, length).tolist() == [found[r] > 1 for r in runs]


def test_suffixes_are_in_order():
    text = np.array([2, 1, 2, 1, 2, 1, 0, 3, 1], np.int64)
    order = sorted_suffixes(text, 16)
    assert [tuple(text[i:]) for i in order] == sorted(tuple(text[i:]) for i in range(len(text)))
