import random

import public_tokenizers as P
import tiktoken

from tidemark.llm import bpe, packing, token_counts
from tidemark.llm import units
from tidemark.llm.units import RecurringCache, UnitCache

ALPHABET = list(" \n\tab'sltéÉß1²½!#  \x1c\x85\xa0中日ΣσİK<|>Å") + [chr(c) for c in (0x558, 0x88F, 0x11DE0, 0x3FC3D, 0x2003)]


def texts(n=1500):
    rng = random.Random(1)
    return ["", "a", "<|endoftext|>", "x  <|endoftext|> y", "ab" * 3000, "a" * 5001, *["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 14))) for _ in range(n)]]


def test_encoder_equals_the_library():
    e = bpe.Encoder(bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=e.ranks, special_tokens={})
    for s, ids in zip(texts(), bpe.encode_texts(texts(), e, UnitCache(e.units)), strict=True):
        assert bpe.unpack(ids).tolist() == library.encode_ordinary(s), repr(s)
        assert e.decode(bpe.unpack(ids)) == s.encode()


def test_rank_queue():
    import numpy as np

    q, rng = bpe.RankQueue(5000), random.Random(2)
    ranks = [rng.randrange(5000) for _ in range(300)]
    q.push_all(np.array(ranks), np.arange(300))
    got = []
    while (x := q.pop()) is not None:
        got += [(x[0], int(p)) for p in x[1]]
    assert got == sorted((r, p) for p, r in enumerate(ranks))


def test_counts_equal_the_library():
    path = P.path("byte_bpe_50k.json")
    count, cache = token_counts.load(path), UnitCache(token_counts.unit_counter(path), most=50)
    assert token_counts.count_texts(texts(), count, cache) == [count(s) if s else 0 for s in texts()]


def test_packing_ids_equal_the_library():
    encode, whole = packing.unit_ids(P.path("word_bpe_49k.json"))
    for cache in (RecurringCache(encode, 300_000), RecurringCache(encode, 50)):
        for _ in range(2):
            for s, ids in zip(texts(), packing.encode_texts(texts(), cache, whole), strict=True):
                assert ids == whole(s), repr(s)


def test_recurring_cache(monkeypatch):
    asked = []
    cache = RecurringCache(lambda us: asked.extend(us) or [u * 2 for u in us], 8)
    for k in range(40):
        some = {"the", "a", f"w{k}", f"w{k % 3}", "x" * 200}
        cache.fill(some)
        assert all(cache[u] == u * 2 for u in some)
        assert len(cache) + len(cache.older) <= 8 + 2 * len(some)
    assert asked.count("the") == asked.count("a") == 2 and asked.count("x" * 200) == 40
    monkeypatch.setattr(units, "MARKS", 16)
    cache = RecurringCache(lambda us: [u * 2 for u in us], 4)
    for k in range(200):
        cache.fill({str(k), str(k // 2)})
        assert cache[str(k)] == str(k) * 2 and cache[str(k // 2)] == str(k // 2) * 2


def test_tables(spark):
    rows = [(1, None, "x"), (1, None, "x"), (2, "", "y"), (None, "hello, hello world", None), (3, "word " * 2000, "z")]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {(r.doc_id, r.n_bytes): (r.n_tokens, r.over_limit) for r in token_counts.token_counts(d).collect()}
    assert got[1, 0] == (0, False) and got[3, 10_000][1] and got[None, 18] == (4, False)
    assert token_counts.token_counts(d).count() == 5 and token_counts.token_counts(d.limit(0)).count() == 0
    assert token_counts.token_counts(d, P.path("piece_bpe_32k.model")).count() == 5
    r = bpe.round_trip(d)
    assert r.count() == 5 and r.where("doc_id = 1").first().n_tokens == 0
    assert [bytes(x.bytes) for x in bpe.decode(bpe.encode(d.where("doc_id = 3"))).collect()] == [b"word " * 2000]
