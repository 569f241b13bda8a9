import hashlib
import random

import numpy as np
import pytest
import xxhash

from quadrat.llm import column_bwt, gray_simhash, i_match, suffix_dedup
from quadrat.llm.common import components, words
from tests.llm.helpers import frame, rows, sentence


def simhash(text):
    tokens = words((text or "").encode())
    shingles = [b" ".join(tokens[i:i + 3]) for i in range(max(1, len(tokens) - 2))] if tokens else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def connected(ids, pairs):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("split_at", [8_000, 3])
def test_simhash_components(spark, split_at):
    data = rows()
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id)
           for r in gray_simhash.near_duplicates(frame(spark, data), split_at=split_at).collect()}
    code = {i: simhash(t) for i, t in data}
    want = connected(code, [(a, b) for a in code for b in code if a < b and (code[a] ^ code[b]).bit_count() <= 2])
    assert got == {i: (code[i], want[i]) for i in code}


def test_simhash_edge_tables(spark):
    assert gray_simhash.near_duplicates(frame(spark, rows()).limit(0)).count() == 0
    twice = gray_simhash.near_duplicates(frame(spark, [(5, "a b"), (5, "a b"), (None, "a b"), (None, "c d e f")])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in twice) == [(-1, -1), (-1, 5), (5, 5), (5, 5)]


def test_forest_on_random_codes(spark):
    rng = random.Random(3)
    codes = {rng.getrandbits(64) for _ in range(300)}
    codes |= {c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for c in list(codes)[:150]}
    table = spark.createDataFrame([(gray_simhash.signed(c),) for c in codes], "fp long")
    for distance, split in ((2, 8_000), (2, 4), (7, 30)):
        want = connected(codes, [(a, b) for a in codes for b in codes if a < b and (a ^ b).bit_count() <= distance])
        edges = [(r.a % (1 << 64), r.b % (1 << 64)) for r in gray_simhash.forest(table, distance, split).collect()]
        assert all((a ^ b).bit_count() and a in codes and b in codes for a, b in edges)
        assert connected(codes, edges) == want


def test_components_of_a_chain(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_simhash_group(spark):
    """One row of each component stays, also where rows are repeated or share a doc_id or have none."""
    data = rows()
    data += [(3, data[3][1]), (3, data[3][1]), (4, "another text of an id that occurs twice"), (None, data[5][1]), (None, "no id at all here"),
             (None, "no id at all here")]
    docs = frame(spark, data)
    kept = gray_simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns
    code = [simhash(t) for _, t in data]
    label = connected(range(len(data)), [(a, b) for a in range(len(data)) for b in range(a) if (code[a] ^ code[b]).bit_count() <= 2])
    want = {}
    for k, c in label.items():
        order = (data[k][0] is None, data[k][0] or 0, gray_simhash.signed(code[k]))
        want[c] = min(want.get(c, (order, data[k])), (order, data[k]), key=lambda x: x[0])
    text_of = lambda pairs: sorted(((i, t or "") for i, t in pairs), key=repr)
    assert text_of((r.doc_id, r.text) for r in kept.collect()) == text_of(p for _, p in want.values())
    assert gray_simhash.one_of_each_group(docs.limit(0)).count() == 0


def removed(data, window):
    first, out = {}, {}
    for i, text in sorted(data):
        text = (text or "").encode()
        gone = bytearray(len(text))
        for at in range(len(text) - window + 1):
            if first.setdefault(text[at:at + window], i) < i:
                gone[at:at + window] = b"\1" * window
        rest = bytes(c for c, g in zip(text, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(text), sum(gone), spans, hashlib.sha256(rest).hexdigest())
    return out


@pytest.mark.parametrize("hot", [20_000, 2])
def test_repeated_passages(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 4_000)
    data = rows(50)
    got = suffix_dedup.remove_repeats(frame(spark, data), "source").collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.rest_sha256) for r in got} == removed(
        data, suffix_dedup.WINDOW)
    assert {r.source for r in got} == {"src"}
    for r in got:
        assert r.rest_text == bytes(r.rest).decode("utf-8", "ignore")


def test_repeated_passages_edge_tables(spark):
    assert suffix_dedup.remove_repeats(frame(spark, rows()).limit(0)).count() == 0
    text = "some longer passage that both documents have in common, word for word."
    got = suffix_dedup.remove_repeats(frame(spark, [(4, text), (4, text), (None, text), (None, text)])).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in got) == [(-1, len(text)), (-1, len(text)), (4, 0), (4, 0)]


def test_suffix_order_small_slices(monkeypatch):
    rng = random.Random(7)
    for _ in range(60):
        monkeypatch.setattr(column_bwt, "SLICE", rng.choice([2, 5, 40, 1 << 20]))
        texts = [bytes(rng.choices(b"ab\xff\x00", k=rng.choice([0, 1, 4, 25]))) for _ in range(rng.randint(1, 8))]
        stop = np.cumsum([len(t) for t in texts])
        want = sorted((t[k:], i, int(stop[i]) - len(t) + k) for i, t in enumerate(texts) for k in range(len(t)))
        got = [(int(a), int(b)) for lcp, start in column_bwt.suffix_order(texts, 9) for a, b in zip(lcp, start)]
        assert [s for _, s in got] == [s for *_, s in want]
        for (lcp, _), (a, *_), (b, *_) in zip(got[1:], want, want[1:]):
            assert lcp == min(9, next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))))


def test_windows_are_compared_once(monkeypatch):
    rng = random.Random(13)
    base = bytes(rng.choices(b"abcd ", k=400))
    texts = [bytes(rng.choices(b"xyz", k=9)) + base[i:i + 90] for i in range(0, 300, 3)] + [b"", b"short", base[:9]]
    first = np.array(rng.sample(range(1000), len(texts)))
    windows = [[t[k:k + 9] for k in range(len(t) - 8)] for t in texts]
    least = {}
    for i, own in zip(first.tolist(), windows):
        least.update({w: min(i, least.get(w, i)) for w in own})
    compared, common = [], column_bwt.Collection.common
    monkeypatch.setattr(column_bwt.Collection, "common", lambda self, a, b, n: compared.append(len(a)) or common(self, a, b, n))
    for size in (7, 1 << 17):
        monkeypatch.setattr(column_bwt, "SLICE", size)
        compared.clear()
        got = column_bwt.earliest(texts, first, 9)
        assert [g.tolist() for g in got] == [[least[w] for w in own] for own in windows]
        assert sum(compared) < sum(map(len, windows))  # not all suffixes, and not again in every round
    assert [g.tolist() for g in column_bwt.earliest([b"", b"ab"], np.array([1, 2]), 9)] == [[], []]


def test_i_match(spark):
    data = rows()
    docs = frame(spark, data)
    terms = i_match.lexicon(docs, 0.0, 0.5)
    assert terms == sorted(terms) and b"x" not in terms
    got = {r.doc_id: r for r in i_match.edited_pairs(docs, terms).collect()}
    plain = {r.doc_id: r.fingerprint for r in i_match.fingerprints(docs, terms).collect()}
    texts = [t or "" for _, t in data]
    seen = {}
    for i, text in enumerate(texts):
        after, n = texts[(i + 1) % len(texts)], len(text)
        edited = text[:n - n // 4] + after[:n // 4]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == plain[i] == seen.setdefault(text, r.fingerprint)
        assert r.near_edited == i_match.likeness(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == i_match.likeness(r.fingerprint, plain[(i + 1) % len(texts)])
        if edited == text:
            assert r.near_edited == 1.0
    long = [got[i] for i, t in enumerate(texts) if len(t) > 300]
    assert np.mean([r.near_edited for r in long]) > np.mean([r.near_next for r in long]) + 0.2
    assert i_match.edited_pairs(docs.limit(0), []).count() == 0
    assert i_match.lexicon(docs.limit(0)) == []
    one = i_match.edited_pairs(frame(spark, [(3, "alone here")]), []).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_i_match_without_lexicon_terms(spark):
    rng = random.Random(12)
    copy = sentence(rng, 90)
    data = [(i, copy if i % 3 == 0 or i < 12 else sentence(rng, rng.randint(40, 90))) for i in range(90)]
    data += [(100 + i, " ".join(f"only{i}n{k}" for k in range(60))) for i in range(4)]
    docs = frame(spark, [*data, (None, copy), (None, None)])
    terms = i_match.lexicon(docs)
    assert not set(terms) & set(words(copy.encode()))
    rows_of = i_match.edited_pairs(docs, terms).collect()
    got = {r.doc_id: r for r in rows_of if r.doc_id is not None}
    for i, text in data:  # the next document brings terms of the lexicon or not
        if text == copy or i >= 100:
            assert got[i].near_edited > 0.1, i
    assert all(got[i].near_next == 1.0 for i in range(11)) and got[100].near_next == 0.0
    null = sorted((r for r in rows_of if r.doc_id is None), key=lambda r: r.n_chars)
    assert [r.n_chars for r in null] == [0, len(copy)] and null[1].fingerprint == got[0].fingerprint
    assert {(r.edited_sha256, r.edited_fingerprint, r.near_edited, r.near_next) for r in null} == {(None,) * 4}


def test_pieces_left_out_share_no_window():
    rng = random.Random(11)
    window = suffix_dedup.WINDOW
    base = [bytes(rng.choices(b"abcdefg ", k=400)) for _ in range(3)]
    texts = []
    for _ in range(60):
        text = bytearray(rng.choice(base))
        for _ in range(rng.randint(0, 6)):
            text[rng.randrange(len(text))] = rng.choice(b"xyz")
        texts.append(bytes(text[rng.randint(0, 40):]))
    of, first, size, key = suffix_dedup.runs_of(texts)
    pieces, keys = [], []
    for i, f, n, k in zip(of.tolist(), first.tolist(), size.tolist(), key):
        piece = texts[i][f:f + n + window - 1]
        if piece not in pieces:
            pieces.append(piece)
            keys.append(k)
    kept = suffix_dedup.may_share(pieces, np.array(keys, np.uint64))
    parts = [{p[k:k + window] for k in range(len(p) - window + 1)} for p in pieces]
    for i, own in enumerate(parts):
        if not kept[i]:
            assert not any(own & other for j, other in enumerate(parts) if j != i)
    assert kept.any() and not kept.all()
