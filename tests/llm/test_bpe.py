import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quadrat.llm import bpe, packing, token_counts

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
HARD = ["", " ", "a", "The and of", "a" * 1000, "ab" * 777 + "c", "  \n\n\t x", "don't WON'T 1234567 ééé 漢字漢字 🙂🙃",
        "<|endoftext|>", "  x", "ererer thereonth " * 40, "=" * 70 + "-" * 33, "x\r\ny", "0" * 129, None]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(open(RANKS, "rb").read(), P.PATTERN)


def test_every_token_is_its_own_encoding():
    for name in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"):
        rank = bpe.parse_ranks(open(P.path(name), "rb").read())
        assert all(bpe.merge_bytes(b, rank) == (i,) for b, i in rank.items())


def test_hard_texts_match_library(codec, library):
    for text in HARD[:-1]:
        ids = np.frombuffer(codec[1].encode(text), "<u4").tolist()
        assert ids == library.encode_ordinary(text)
        assert codec[0].decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=200), st.text(alphabet="aeionrst h", max_size=300)))
def test_any_text_matches_library(library, text):
    tree, pieces = bpe.codec(open(RANKS, "rb").read(), P.PATTERN)
    assert np.frombuffer(pieces.encode(text), "<u4").tolist() == library.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=150), st.binary(max_size=150))
def test_join_is_encoding_of_concatenation(a, b):
    tree = bpe.codec(open(RANKS, "rb").read(), P.PATTERN)[0]
    assert tree.join(tree.encode(a), tree.encode(b)) == bpe.merge_bytes(a + b, tree.rank)
    assert tree.decode(list(tree.encode(a + b))) == a + b


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", "clash") for i, t in enumerate(rows)],
                                 "doc_id long, text string, lang string, ids string, n_tokens string")


def test_pieces_encoded_together():
    rank = bpe.parse_ranks(open(RANKS, "rb").read())
    tree = bpe.TreeCodec(rank)
    draw = np.random.default_rng(5)
    pieces = [bytes(draw.integers(97, 105, n).tolist()) for n in (*range(1, 60), *[9] * 40, *[24] * 40)]
    pieces += [bytes(draw.integers(0, 256, n).tolist()) for n in range(1, 40)] + [b" the", b"\0\0\0"]
    expected = [(rank[p],) if p in rank else bpe.merge_bytes(p, rank) for p in pieces]
    assert [np.frombuffer(b, "<u4").tolist() for b in tree.encode_all(pieces)] == list(map(list, expected))
    parts = bpe.Pieces(P.PATTERN, lambda p: tree.encode(p.encode()), tree.encode_all)
    texts = ["", "one two two", "three " * 90_000, "one \u00e9t\u00e9 \u4e2d\u6587 two", ""]
    assert list(parts.encode_all(texts)) == list(map(parts.encode, texts))


def test_digests_and_round_trip(spark, library):
    docs = frame(spark, HARD + HARD[:3])
    got = {r.doc_id: r for r in bpe.digests(docs, RANKS, P.PATTERN).collect()}
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()}
    for i, text in enumerate(HARD + HARD[:3]):
        ids = library.encode_ordinary(text or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
        assert back[i] == (text or "")
    assert bpe.digests(docs.limit(0), RANKS, P.PATTERN).count() == 0


def test_token_counts(spark, library):
    rows = HARD + ["x y z " * k for k in range(0, 1500, 70)]
    docs = frame(spark, rows)
    lengths = [len(library.encode_ordinary(t or "")) for t in rows]
    limits = token_counts.by_limit(token_counts.histogram(docs, RANKS, P.PATTERN))
    got = {r.limit: r for r in limits.collect()}
    assert sorted(got) == sorted(set(lengths))
    for n, r in got.items():
        assert r.n_docs == lengths.count(n)
        assert r.docs_over == sum(x > n for x in lengths) and r.tokens_over == sum(x for x in lengths if x > n)
        assert r.truncated_total == sum(min(x, n) for x in lengths)
    half = {r.share: r.limit for r in token_counts.quantiles(limits, [0.5, 1.0]).collect()}
    assert half == {0.5: sorted(lengths)[-(-len(lengths) // 2) - 1], 1.0: max(lengths)}
    assert token_counts.by_limit(token_counts.histogram(docs.limit(0), RANKS, P.PATTERN)).count() == 0


def test_packing(spark):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    rows = HARD + ["onereath thereon " * (7 * k) for k in range(90)] + ["of it"] * 30
    got = packing.pack(frame(spark, rows), JSON, P.PATTERN).collect()
    import zlib
    for i, text in enumerate(rows):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert sum(r.length for r in own) == len(ids) and all(r.length == 1024 for r in own[1:])
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes())
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 1024
    assert len(sequences) <= -(-sum(r.length for r in got) // 1024) + 3
    assert packing.pack(frame(spark, rows).limit(0), JSON, P.PATTERN).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), min_size=1, max_size=40), st.sampled_from([3, 10, 100]))
def test_plan_places_every_piece_once(hist, groups):
    n, runs = packing.plan(hist, 64, groups)
    seen, used = set(), {}
    for length, first, count, at, slot in runs:
        for i in range(count):
            assert (length, first + i) not in seen
            seen.add((length, first + i))
            used[at + i] = used.get(at + i, 0) + length
    assert len(seen) == sum(hist.values()) and set(used) == set(range(n)) and max(used.values()) <= 64
