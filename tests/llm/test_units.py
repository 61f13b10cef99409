"""The operators' parts without Spark, against brute force."""

import hashlib
import io
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hushframe.llm import ann, lm_scoring, mixing, packing, simhash, toxicity, url_filters, warc
from hushframe.llm.token_files import TokenFile, TokenFileWriter, decode_block, encode_block
from hushframe.llm.tokens import TextEncoder


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(0, 3), st.integers(0, 70_000), st.integers(0, (1 << 60) - 1)), max_size=600))
def test_simple8b_round_trip(values):
    made = np.array(values, np.uint64)
    assert decode_block(encode_block(made), len(made)).tolist() == values


def test_simple8b_packs_and_escapes():
    assert len(encode_block(np.zeros(240, np.uint64))) == 1 and len(encode_block(np.full(60, 1, np.uint64))) == 1
    out = io.BytesIO()
    writer = TokenFileWriter(out, block_ids=7)
    docs = [(1, [5, 2]), (None, []), (3, [1 << 63, 0, (1 << 60) + 1] * 9), (4, list(range(50)))]
    for i, ids in docs:
        writer.add(i, np.array(ids, np.uint64))
    writer.close()
    assert [(i, x.tolist()) for i, x in TokenFile(io.BytesIO(out.getvalue())).documents()] == docs
    with pytest.raises(ValueError):
        TokenFile(io.BytesIO(out.getvalue()[:-1]))


def test_words_give_the_tokenizers_ids():
    e = TextEncoder(max_cached=20)
    texts = ["a\x1cb  Ünïcode ÀÉ!! it's don't <|endoftext|> x<|endoftext|>y 12ab ẞ İstanbul ΑΣ é ́x  a　b", "", "the the, The. THE!!", "words " * 50 + "x" * 500, "K ſ ǅ #!$%", "田中さん 😀"]
    for t in texts * 2:
        assert e.encode(t).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_warc_faults():
    payload = b"<p>" + b"x" * 50
    digest = hashlib.sha1(payload).hexdigest()
    good = warc.build_record(7, "http://x/\r\nInjected: 1", payload, digest, None)
    assert warc.parse_record(good)["payload"] == payload and warc.parse_record(good)["url"] == "http://x/Injected: 1"
    for bad in (good[:-1], good + b"x", good.replace(b"WARC/1.1", b"WRAC/1.1"), good.replace(b"<p>", b"<q>"), good.replace(b"WARC-Date", b"WARC Date:"), good.replace(b"Content-Length: ", b"Content-Length: -"), b""):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)
    again = warc.parse_record(warc.build_record(None, None, payload, digest, 7))
    assert (again["page_id"], again["refers_to"], again["payload_bytes"], again["record_type"]) == (None, 7, len(payload), "revisit")


def test_warc_frames_with_dictionary():
    import struct

    import zstandard

    samples = [f"<html>{k} common words in every page {k * k}</html>".encode() * 30 for k in range(60)]
    made = zstandard.train_dictionary(4096, samples)
    packed = zstandard.ZstdCompressor().compress(made.as_bytes())
    c = zstandard.ZstdCompressor(dict_data=made)
    body = struct.pack("<II", warc.DICT_MAGIC, len(packed)) + packed + b"".join(c.compress(s) for s in samples)
    assert list(warc.read_frames(io.BytesIO(body))) == samples
    with pytest.raises(warc.WarcError):
        list(warc.read_frames(io.BytesIO(body[:-3])))


def test_shares():
    got = mixing.share_out([("b", 100), ("a", 10), (None, 50), ("c", 0)])
    assert got["a"] == 20 and got["c"] == 0 and sum(got.values()) == pytest.approx(240)
    assert got["b"] == pytest.approx(220 * 2 / 7) or got["b"] <= 200
    assert mixing.share_out([]) == {}


def test_nnls_and_plan():
    x = packing.nnls([{1: 1, 2: 1}, {2: 2}], {1: 5, 2: 9})
    assert x == pytest.approx([5, 2], abs=0.01)
    rng = random.Random(3)
    histogram = {}
    for _ in range(3000):
        n = rng.choice([100, 900, rng.randint(1, 4095)])
        histogram[n] = histogram.get(n, 0) + 1
    plan = packing.Plan(histogram)
    used = {}
    for n, count in histogram.items():
        for rank in range(count):
            pieces = plan.places(n, rank)
            assert [p[0] for p in pieces] == [0, *(p[1] for p in pieces[:-1])] and pieces[-1][1] == n
            for a, b, sequence, offset in pieces:
                used.setdefault(sequence, []).append((offset, b - a))
    full = 0
    for pieces in used.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= packing.WINDOW
        full += at == packing.WINDOW
    assert full >= len(used) - 1


def test_bk_trees_find_all():
    rng = random.Random(1)
    centres = [rng.getrandbits(64) for _ in range(20)]
    values = list({c ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 6))) for c in centres for _ in range(40)})
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:50]:
        assert set(tree.within(q, 4)) == {v for v in values if (v ^ q).bit_count() <= 4}
    small, split = simhash.Forest(), simhash.Forest()
    simhash.link_shard(values, 4, small)
    before, simhash.PART_ABOVE = simhash.PART_ABOVE, 16
    try:
        simhash.link_shard(values, 4, split)
    finally:
        simhash.PART_ABOVE = before
    assert all(small.root(v) == split.root(v) for v in values)


def test_fingerprint_by_definition():
    import xxhash

    text = "The quick\tbrown fox JUMPS over Ä the lazy dog the lazy dog"
    words = text.encode().lower().split()
    grams = [b" ".join(words[k : k + 4]) for k in range(len(words) - 3)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    expected = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text) == expected
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("a B") == xxhash.xxh64_intdigest(b"a b", 42)


def test_fold_and_lexicon():
    assert toxicity.fold("L0SER, ｉｄｉｏｔ! сlоwn $tupid 1234 mör0n") == " loser idiot clown stupid moron "
    lexicon = toxicity.Lexicon({" loser ": 3.0, " vequ": 2.0}, ("not a loser",), 1.0, -2.0)
    assert lexicon.raw("You L0ser") == 3.0 and lexicon.raw("losers") == 0 and lexicon.raw("vequto x") == 2.0
    assert lexicon.raw("he is not a loser.") == 0 and lexicon.score(None) == lexicon.score("") < 0.5 < lexicon.score("loser")
    assert lexicon.raw("loser " + "x " * 8000) < 1


def test_rules():
    pruned = url_filters.prune([(("a",), 0.8), (("a", "b"), 0.7), (("a", "c"), 0.9), (("b",), 0.5)])
    assert pruned == [(("a",), 0.8), (("b",), 0.5), (("a", "c"), 0.9)]
    index = url_filters.RuleIndex(pruned)
    assert index.match(["a", "c", "x"]) == 0.9 and index.match(["x"]) is None
    assert url_filters.tokens_of(None) == [] and "path=#.html" in url_filters.tokens_of("http://A.b/12.html?q=1&r#top")


def test_seating():
    rng = np.random.default_rng(0)
    counts = np.array([0, 1, 2, 50, 5000])
    t = lm_scoring.seat(counts, 0.5, np.array([1.0, 1.0, 1e-12, 2.0, 3.0]), rng)
    assert t[0] == 0 and t[1] == 1 and t[2] == 1 and all(1 <= x <= c for x, c in zip(t[1:], counts[1:], strict=True))
    # Mean tables of 3 customers with discount 0 and odds 1: 1 + 1/2 + 1/3.
    many = lm_scoring.seat(np.full(20_000, 3), 0.0, np.ones(20_000), rng)
    assert many.mean() == pytest.approx(1 + 1 / 2 + 1 / 3, abs=0.02)


def measured(points, queries, share, **forest):
    """Recall of the ten nearest against brute force, and the share of vectors compared."""
    made = ann.RandomProjectionForest(points, 1.0, **forest)
    leaves, hits, seen = made.leaves(points), 0, 0.0
    for q in queries:
        bits = made.search(points[q], max(share * len(points), ann.LEAST * 10), 11)
        at = np.flatnonzero(bits[np.arange(len(made.trees)), leaves].any(axis=1))
        seen += len(at) / len(points)
        near = at[np.argsort(ann.distances(points[q], points[at]), kind="stable")][1:11]
        hits += len(set(near) & set(np.argsort(ann.distances(points[q], points), kind="stable")[1:11]))
    return hits / (10 * len(queries)), seen / len(queries)


def test_forest_recall():
    """No structure at all, as the query's own settings have it; and points in groups, for a fifth of the table at most."""
    import pyarrow.parquet as pq

    points = np.array(pq.read_table("/root/testdata/sf0.1/embeddings.parquet")["embedding"].to_pylist(), np.float64)
    recall, seen = measured(points, range(0, len(points), 20), ann.SEARCH_SHARE)
    assert recall >= 0.93 and seen < 0.5, (recall, seen)
    rng = np.random.default_rng(2)
    grouped = rng.normal(size=(60, 24))[rng.integers(0, 60, 4000)] * 4 + rng.normal(size=(4000, 24))
    recall, seen = measured(grouped, range(0, 4000, 100), 0.1)
    assert recall >= 0.9 and seen < 0.2, (recall, seen)


def test_search_finds_enough():
    points = np.random.default_rng(1).normal(size=(40, 8))
    made = ann.RandomProjectionForest(points, 1.0)
    leaves = made.leaves(points)
    for v in points:
        assert made.search(v, 1, 11)[np.arange(len(made.trees)), leaves].any(axis=1).sum() >= 11



def test_op7_every_preceding_word_is_a_context():
    """Nothing is left out of the hierarchy by default: words seen once in training have restaurants."""
    import pandas as pd

    from hushframe.llm import lm_scoring as L

    hashes = L.hash_words([b"once", b"often", L.END])
    order = hashes.argsort()
    words = pd.DataFrame({"at": [0], "of": [0], "data": [L.dump(hashes=hashes[order], counts=np.array([1, 50, 9])[order])]})
    frames = []

    class Words:
        def groupBy(self, *_):
            return self

        def applyInPandas(self, run, _):
            frames.append(run(words))

    L.counted(Words(), L.MIN_CONTEXT)
    rank = L.load(frames[0]["data"].iloc[1])["rank"]
    assert (rank[np.argsort(order)][:2] >= 0).all() and rank[np.argsort(order)][2] == -1
