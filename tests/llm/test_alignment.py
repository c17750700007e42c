import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from folioscope.llm import alignment
from folioscope.llm.byte_bpe import byte_characters
from folioscope.llm.queries import op11_cross_tokenizer_alignment

DATA = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain_tokens():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    signs = {sign: n for n, sign in enumerate(byte_characters())}

    def tokens(text):
        if not text:
            return [], []
        a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        a_bytes = [bytes(signs[c] for c in a.id_to_token(i)) for i in a_ids]
        pieces = [b.id_to_piece(i) for i in b_ids]
        b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b_ids, pieces)]
        whole = (" " + text).encode()
        if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            return [], []
        return list(zip(a_ids, a_bytes)), list(zip(b_ids, b_bytes))

    return tokens


def spans(tokens):
    at, found = 0, []
    for _, own in tokens:
        found.append((at, at + len(own)))
        at += len(own)
    return found


def plain(docs):
    """All links by byte ranges, groups by walking both lists, counts over all documents."""
    tokens, told = plain_tokens(), []
    for _, text in docs:
        a, b = tokens(text)
        sa, sb = spans(a), spans(b)
        # each token of A with those of B around its place, by ranges alone
        owner = {}
        for j, (s, e) in enumerate(sb):
            for at in range(s, e):
                owner[at] = j
        links = [(i, j) for i, (s, e) in enumerate(sa) for j in sorted({owner[at] for at in range(s, e)})]
        groups, i0, j0, b_ends = [], 0, 0, {e: j for j, (_, e) in enumerate(sb)}
        for i, (_, e) in enumerate(sa):
            if e in b_ends:
                groups.append((a[i0 : i + 1], b[j0 : b_ends[e] + 1]))
                i0, j0 = i + 1, b_ends[e] + 1
        named = ";".join(",".join(str(x) for x, _ in ga) + "|" + ",".join(str(x) for x, _ in gb) for ga, gb in groups)
        told.append((a, b, groups, [(a[i][0], b[j][0]) for i, j in links], hashlib.sha256(named.encode()).hexdigest() if a else ""))
    counts = Counter(pair for _, _, _, links, _ in told for pair in set(links))
    most = Counter()
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    return [
        (i, len(a), len(b), len(g), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), digest)
        for (i, _), (a, b, g, links, digest) in zip(docs, told)
    ]


ODD = [
    None, "", " ", "  two  blanks ", "a\tb\n\nc", "naïve café ﬁ 　x", "▁under", "<|endoftext|> <s> </s> <unk>", "日本語 \U0001f600​",
    "same text here", "same text here", "don't 'll 12345", "x" * 3000, "word " * 5000, "\x85a\xa0b",
]


@pytest.mark.parametrize("head", [500_000, 40, 0])
def test_counts_equal_plain_ones(docs_of, monkeypatch, head):
    monkeypatch.setattr(alignment, "HEAD", head)
    docs = [*enumerate(ODD), (None, "no id"), (9, "id again")]
    rows = alignment.link_counts(docs_of(docs), A, B).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(plain(docs), key=str)


def test_query_equals_plain_counts(shipped):
    docs = [tuple(d) for d in shipped.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    rows = op11_cross_tokenizer_alignment(shipped, DATA).collect()
    assert sorted(map(tuple, rows)) == sorted(plain(docs))


def test_links_and_groups_of_rows(docs_of):
    docs = docs_of(["naïve tokens\nhere", None, "", "▁"]).selectExpr("*", "1 as a_ids", "2 as links", "3 as n")
    rows = {r.doc_id: r for r in alignment.align(docs, A, B).collect()}
    assert alignment.align(docs, A, B).columns == ["doc_id", "text", "lang", "source", "n_chars", "n", "a_ids", "b_ids", "groups", "links"]
    a, b = plain_tokens()(rows[0].text)
    assert (rows[0].a_ids, rows[0].b_ids) == ([i for i, _ in a], [i for i, _ in b])
    sa, sb = spans(a), spans(b)
    want = [(i, j) for i, x in enumerate(sa) for j, y in enumerate(sb) if x[0] < y[1] and y[0] < x[1]]
    assert [tuple(link) for link in rows[0].links] == want
    ends = {e for _, e in sa} & {e for _, e in sb}
    assert [sa[g.a_end - 1][1] for g in rows[0].groups] == sorted(ends) == [sb[g.b_end - 1][1] for g in rows[0].groups]
    assert all(rows[i].a_ids == [] == rows[i].groups for i in (1, 2, 3))


def test_empty_tables(docs_of):
    none = docs_of(["a"]).filter("false")
    assert alignment.link_counts(none, A, B).count() == 0 and alignment.align(none, A, B).count() == 0
