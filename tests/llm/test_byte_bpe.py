import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from folioscope.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
TEXTS = [
    "The quick brown fox's tail, 123 456!", "", None, " ", "  two  blanks \n\n\tand\r\nlines ", "日本語のテキスト", "😀😀 é ñ",
    "a" * 5000, "----=====-----", "x\x1cy\x85z\u3000w\ufeff", "<|endoftext|>", "it'S IT'S we'll", "\u0301\u0301", "same", "same",
]


@pytest.fixture(scope="module")
def plain():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_are_those_of_the_plain_library(docs_of, plain):
    rows = byte_bpe.encode(docs_of(TEXTS), PATH, PATTERN).collect()
    assert len(rows) == len(TEXTS)
    for row in rows:
        assert row.ids == plain.encode_ordinary(row.text or "")


def test_random_texts(plain):
    random.seed(7)
    coder = byte_bpe.coder(PATH, PATTERN)
    parts = ["a", "the", " ", "  ", "\n", "\t", "'s", "'", "12", "é", "日", "!", "--", "\x1f", "\x85", "\u2003", "😀", "ing"]
    texts = ["".join(random.choices(parts, k=random.randint(0, 30))) for _ in range(3000)]
    for text, ids in zip(texts, coder.ids_of(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode_ordinary(text)


def test_offsets_name_the_characters_of_a_token(docs_of, plain):
    text = "naïve 😀日本 word"
    row = byte_bpe.encode(docs_of([text]), PATH, PATTERN).first()
    coder = byte_bpe.coder(PATH, PATTERN)
    assert row.starts[0] == 0 and row.ends[-1] == len(text)
    for token, start, end in zip(row.ids, row.starts, row.ends):
        assert coder.tokens[token] in text[start:end].encode()
    covered = {c for s, e in zip(row.starts, row.ends) for c in range(s, e)}
    assert covered == set(range(len(text)))
    split = [i for i in range(len(row.ids) - 1) if row.starts[i + 1] < row.ends[i]]
    assert split, "a character of several bytes is split between tokens here"


def test_decoding_reverses_encoding_and_marks_halves(docs_of, shipped):
    encoded = byte_bpe.encode(docs_of(TEXTS), PATH, PATTERN, offsets=False)
    for row in byte_bpe.decode(encoded, PATH, PATTERN).collect():
        assert bytes(row.decoded).decode() == (row.text or "") == row.decoded_text
    ids = byte_bpe.encode(docs_of(["𝄞"]), PATH, PATTERN).first().ids
    assert len(ids) > 1
    rows = shipped.createDataFrame([(1, ids[:1]), (2, [999_999]), (3, None), (4, [])], "n int, ids array<int>")
    got = {r.n: r for r in byte_bpe.decode(rows, PATH, PATTERN).collect()}
    assert got[2].decoded_text == "\ufffd" and got[3].decoded is None and got[4].decoded_text == ""
    assert "𝄞".encode().startswith(bytes(got[1].decoded)) and got[1].decoded_text == "\ufffd"


def test_digests_clashing_columns_and_no_rows(docs_of, plain):
    docs = docs_of(TEXTS)
    for row in byte_bpe.round_trip(docs, PATH, PATTERN).collect():
        text = TEXTS[row.doc_id] or ""
        ids = np.array(plain.encode_ordinary(text), "<u4")
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    clash = docs.selectExpr("*", "'old' as ids", "1 as starts")
    assert byte_bpe.encode(clash, PATH, PATTERN).filter("doc_id = 13").first().ids == plain.encode_ordinary("same")
    assert byte_bpe.round_trip(docs.filter("false"), PATH, PATTERN).count() == 0
