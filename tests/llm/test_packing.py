import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from folioscope.llm import packing
from folioscope.llm.packing import Limits
from folioscope.llm.queries import op12_packing

DATA = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def check_pieces(rows, want):
    """Every id in one piece, sequences gapless; ``want`` has each example's ids by key. Returns tokens by sequence."""
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == {k for k, ids in want.items() if len(ids)}
    for key, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            ids = want[key][at : at + r.length]
            assert r.start == at and r.length > 0 and r.ids_crc32 == zlib.crc32(ids.astype("<u4").tobytes())
            assert r.doc_tokens == len(want[key])
            at += r.length
        assert at == len(want[key])
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
    return {s: sum(r.length for r in own) for s, own in sequences.items()}, sequences


def test_query_packs_all_documents(shipped):
    coder = Tokenizer.from_file(PATH)
    coder.encode_special_tokens = True
    docs = shipped.read.parquet(f"{DATA}/documents.parquet").collect()
    want = {d.doc_id: np.array([*coder.encode(d.text or "", add_special_tokens=False).ids, 1]) for d in docs}
    used, sequences = check_pieces(op12_packing(shipped, DATA).collect(), want)
    assert all(n == 2048 or (n < 2048 and n & (n - 1) == 0) for n in used.values())
    assert max(map(len, sequences.values())) <= Limits().segments
    assert sum(n == 2048 for n in used.values()) >= len(used) - 100


def test_odd_documents(docs_of):
    texts = [None, "", "", "<|endoftext|>", "the " * 20_000, "same text", "same text"]
    docs = docs_of(texts).selectExpr("*", "1 as start", "2 as ids", "3 as sequence_id")
    coder = Tokenizer.from_file(PATH)
    coder.encode_special_tokens = True
    want = {i: np.array([*coder.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in enumerate(texts)}
    check_pieces(packing.pack_documents(docs, PATH, 1).collect(), want)
    assert packing.pack_documents(docs.filter("false"), PATH, 1).count() == 0
    assert packing.pack_documents(docs_of([(None, "a")]), PATH, 1).first().doc_id is None


def examples_of(spark, rng, n, longest=300):
    rows = []
    for i in range(n):
        size = rng.randrange(0, longest)
        mask = [rng.random() < rng.choice([0.1, 0.9]) for _ in range(size)]
        rows.append((i, [rng.randrange(1000) for _ in range(size)], mask if i % 5 else None))
    return rows, spark.createDataFrame(rows, "key bigint, ids array<int>, mask array<boolean>")


@pytest.mark.parametrize("cut", [False, True])
@pytest.mark.parametrize("limits", [Limits(512, 4, 200), Limits(400, 100, 400), Limits(512, 6, 512), Limits(128, 2, 20)])
def test_limits_hold(shipped, cut, limits):
    rows, df = examples_of(shipped, random.Random(7), 300)
    found = packing.pack(df, "key", limits, cut, loss="mask").collect()
    ids = {k: own for k, own, _ in rows}
    loss = {k: [True] * len(own) if mask is None else mask for k, own, mask in rows}
    sequences, pieces = {}, {}
    for r in found:
        assert r.ids == ids[r.key][r.start : r.start + r.length] and r.tokens == len(ids[r.key])
        assert r.loss_tokens == sum(loss[r.key][r.start : r.start + r.length])
        sequences.setdefault(r.sequence_id, []).append(r)
        pieces.setdefault(r.key, []).append((r.start, r.length))
    for key, own in pieces.items():
        assert sorted(own) == [(0, len(ids[key]))] if not cut else sum(n for _, n in own) == len(ids[key])
        assert len({s for s, _ in own}) == len(own)
    assert set(pieces) == {k for k, own in ids.items() if own}
    for own in sequences.values():
        if len(own) > 1 or cut:
            assert sum(r.length for r in own) <= limits.tokens and len(own) <= limits.segments
            assert sum(r.loss_tokens for r in own) <= limits.loss
        assert sorted(r.offset for r in own) == list(np.cumsum([0, *[r.length for r in sorted(own, key=lambda r: r.offset)]])[:-1])


def test_dot_product_packs_as_few_as_a_plain_search():
    """Two kinds of examples that fill a bin only together: the heuristic pairs them."""
    demands = np.array([(90, 1, 10), (10, 1, 90)] * 20, float)
    bins = packing.place(demands, np.array([100, 4, 100], float))
    assert len(bins) == 20 and all(sorted(demands[b][:, 0]) == [10, 90] for b in bins)


def test_instruction_data(shipped):
    """Conversations, of which only the assistant's turns bear loss."""
    from pyspark.sql import functions as F

    turns = shipped.read.parquet(f"{DATA}/conversations.parquet")
    words = F.size(F.split(F.coalesce("text", F.lit("")), " "))
    own = turns.select("conv_id", "turn", F.array_repeat(F.lit(5), words).alias("ids"), F.array_repeat(F.col("role") == "assistant", words).alias("mask"))
    listed = own.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "ids", "mask"))).alias("turns"))
    df = listed.select("conv_id", F.flatten("turns.ids").alias("ids"), F.flatten("turns.mask").alias("mask"))
    limits = Limits(2048, 16, 600)
    packed = packing.pack(df, "conv_id", limits, loss="mask")
    sums = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("k"), F.sum("loss_tokens").alias("loss")).collect()
    assert all(s.k == 1 or (s.n <= 2048 and s.k <= 16 and s.loss <= 600) for s in sums)
    assert packed.agg(F.sum("length")).first()[0] == df.agg(F.sum(F.size("ids"))).first()[0]
    # no two sequences could be one
    small = sorted(sums, key=lambda s: s.n)[:2]
    assert sum(s.n for s in small) > 2048 or sum(s.k for s in small) > 16 or sum(s.loss for s in small) > 600


def test_refusals_and_odd_examples(shipped):
    df = shipped.createDataFrame([(1, None, None), (2, [], None), (3, [7], [None]), (None, [7, 8], None)], "key bigint, ids array<int>, mask array<boolean>")
    rows = packing.pack(df, "key", loss="mask").collect()
    assert sorted((r.key is None, r.length, r.loss_tokens) for r in rows) == [(False, 1, 0), (True, 2, 2)]
    with pytest.raises(ValueError):
        packing.pack(df, "key", Limits(tokens=0))
