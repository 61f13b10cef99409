"""Each query over small tables with nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import math
import re
import zlib
from itertools import combinations

import numpy as np
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from hushframe.llm import ann, fingerprints, lm_scoring, mixing, packing, simhash, token_files, toxicity, url_filters, warc
from hushframe.llm.common import uniform
from hushframe.llm.queries import queries
from hushframe.llm.tokens import TextEncoder

Q = queries()
WORDS = "alpha beta gamma delta the of and lorem ipsum dolor sit amet vequ clown".split()


def texts():
    rng = np.random.default_rng(5)
    out = [None, "", "  \n", "One two", "one TWO", "x" * 30_000, "long " * 6000]
    base = " ".join(rng.choice(WORDS[:12], 300))
    out += [base, base, base.replace("lorem", "lorum", 1), base + " end"]
    for k in range(60):
        out.append(" ".join(rng.choice(WORDS[:12], int(rng.integers(5, 400)))) + (" you idiot loser" if k % 4 == 0 else ""))
    return out


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder with small tables; ``score``, ``size`` and others clash with what the operators name."""
    d = str(tmp_path_factory.mktemp("tables"))
    ts = texts()
    docs = [(i, t, "en", ["a", "a", "b", None][i % 4], len(t or ""), 1.0, 2, "z") for i, t in enumerate(ts)]
    docs += [docs[7], (None, "null id text here now", None, "b", None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, size int, fp string"
    spark.createDataFrame(docs, schema).repartition(3).write.parquet(f"{d}/documents.parquet")
    labels = [(i, i % 2, int(" idiot " in (t or ""))) for i, t in enumerate(ts)] + [(None, 1, 1), (3, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    html = "<p>" + "y" * 1200
    pages = [(1, "http://A.com/x", html), (2, "https://www.example.com/en/1?q=1", html), (3, None, None), (4, "nope", "ü" * 10), (5, "http://h.net/es/2#t", html), (5, "http://h.net/es/2#t", html), (6, "http://x.net", "short"), (None, "http://a.org/fr/", html)]
    spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, host int").write.parquet(f"{d}/pages.parquet")
    rng = np.random.default_rng(1)
    vectors = [(k, rng.normal(size=8).astype(float).tolist()) for k in range(400)] + [(500, [1.0] * 8), (600, [1.0] * 8), (601, [1.0] * 8)]
    vectors += [(700, None), (800, [0.0] * 8), (900, [float("nan")] * 8), (1000, [1.0] * 7), (1100, [None] + [1.0] * 7), (None, [1.0] * 8), (300, vectors[300][1])]
    spark.createDataFrame([(i, v, 0) for i, v in vectors], "vec_id long, embedding array<float>, rank int").write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.fixture(scope="module")
def empty(spark, small, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "pages", "embeddings"):
        spark.read.parquet(f"{small}/{name}.parquet").limit(0).write.parquet(f"{d}/{name}.parquet")
    return d


def documents(spark, d):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{d}/documents.parquet").collect()]


@pytest.mark.parametrize("name", list(Q))
def test_empty_tables(spark, empty, name):
    assert Q[name](spark, empty).count() == 0


def test_op1(spark, small):
    rows = Q["op1_warc"](spark, small).collect()
    by = {}
    for r in rows:
        by.setdefault(r["page_id"], []).append(r)
    assert len(rows) == 8 and len(by[5]) == 2
    for r in by[5] + by[3] + by[4] + by[6]:
        assert r["record_type"] == "response" and r["refers_to"] is None
    for i in (1, 2, None):
        assert (by[i][0]["record_type"], by[i][0]["refers_to"], by[i][0]["payload_bytes"]) == ("revisit", 5, 1203)
    assert by[3][0]["payload_digest"] == hashlib.sha1(b"").hexdigest() and by[4][0]["payload_bytes"] == 20
    paths = warc.write_archives(spark.read.parquet(f"{small}/pages.parquet"), warc.shared_dir(spark, "t"))
    full = warc.read_archives(spark, paths).collect()
    assert {bytes(r["payload"]).decode() for r in full if r["record_type"] == "response"} >= {"", "ü" * 10, "short"}


def test_op2(spark, small):
    rows = {r["doc_id"]: r for r in Q["op2_toxicity"](spark, small).collect()}
    for i, t in documents(spark, small):
        assert rows[i]["predicted"] == int(" idiot " in t), t[-40:]
        assert rows[i]["held_out"] == (zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0) and 0 <= rows[i]["score"] <= 1


def test_op3(spark, small):
    rows = Q["op3_packing"](spark, small).collect()
    e, docs = TextEncoder(), documents(spark, small)
    ids = [(i, np.concatenate([e.encode(t), [2]]).astype("<u4")) for i, t in docs]
    assert sum(r["length"] for r in rows) == sum(len(x) for _, x in ids)
    one = {i: x for i, x in ids}
    sequences = {}
    for r in rows:
        x = one[r["doc_id"]]
        assert r["doc_tokens"] == len(x) and r["ids_crc32"] == zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes())
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    ends = []
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        ends.append(at)
    assert max(ends) <= 4096 and sum(x < 4096 for x in ends) <= 1


def test_op4(spark, small):
    rows = Q["op4_simhash"](spark, small).collect()
    docs = documents(spark, small)
    fps = {t: simhash.fingerprint(t) for _, t in docs}
    nodes = sorted(set(fps.values()))
    forest = simhash.Forest()
    for k, a in enumerate(nodes):
        for b in nodes[:k]:
            if (a ^ b).bit_count() <= 4:
                forest.join(a, b)
    least = {}
    for i, t in docs:
        if i is not None:
            root = forest.root(fps[t])
            least[root] = min(i, least.get(root, i))
    expected = sorted((i if i is not None else -1, f"{fps[t]:016x}", least.get(forest.root(fps[t]), -1)) for i, t in docs)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["fingerprint"], r["component_id"] if r["component_id"] is not None else -1) for r in rows) == expected


def test_op5(spark, small):
    rows = Q["op5_ann"](spark, small).collect()
    found = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect() if r["vec_id"] is not None and r["vec_id"] not in (700, 800, 900, 1000, 1100)}
    got = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {0, 100, 200, 300, 500, 600}
    hits = 0
    for q, near in got.items():
        exact = sorted((float(np.sqrt(((found[q] - v) ** 2).sum())), i) for i, v in found.items() if i != q)[:10]
        assert [n[0] for n in near] == list(range(1, 11))
        hits += len({n[1] for n in near} & {i for _, i in exact})
        for _, i, s in near:
            assert s == pytest.approx(float(np.sqrt(((found[q] - found[i]) ** 2).sum())), rel=1e-12)
    assert hits >= 54 and [n[1] for n in got[600]][:2] == [500, 601]
    assert ann.nearest(spark.read.parquet(f"{small}/embeddings.parquet").filter("vec_id in (100, 7)")).count() == 1


def edited(text, follow):
    half = len(text) // 2
    return text[: len(text) - half] + follow[:half]


def xx(value, *seeds):
    """XXH64 of a text or long, and of whole numbers with the last value as seed, as Spark has it; unsigned."""
    import xxhash

    out = xxhash.xxh64_intdigest(value.encode() if isinstance(value, str) else value.to_bytes(8, "little"), 42)
    for s in seeds:
        out = xxhash.xxh64_intdigest(s.to_bytes(4, "little"), out)
    return out


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def sampled(text):
    """The fingerprint by the definition: every term drawn for every sample."""
    from collections import Counter

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    counts = Counter(xx(w) for w in words) or {0: 1}
    out = []
    for k in range(fingerprints.SAMPLES):
        found = []
        for h, n in counts.items():
            first, second = xx(h, 2 * k), xx(h, 2 * k + 1)
            r = -math.log(((first & 0xFFFFF) + 0.5) * ((first >> 20 & 0xFFFFF) + 0.5) * 2.0**-40)
            c = -math.log(((second & 0x7FFFFFFF) + 0.5) * ((second >> 33) + 0.5) * 2.0**-62)
            b = (first >> 40) * 2.0**-24
            t = math.floor(math.log(n) / r + b)
            found.append((math.log(c) - r * (t - b + 1), (signed(h) >> 31 ^ t * 2654435761) & 0x7FFFFFFF))
        out.append(min(found)[1])
    return out


def test_op6(spark, small):
    rows = Q["op6_fingerprints"](spark, small).collect()
    docs = documents(spark, small)
    assert len(rows) == len(docs)
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, signed(xx(d[1]))), reverse=True)
    want = []
    for (i, t), (_, u) in zip(order, [*order[1:], order[0]], strict=True):
        a, b, c = sampled(t), sampled(edited(t, u)), sampled(u)
        share = lambda x, y: sum(p == q for p, q in zip(x, y, strict=True)) / len(x)
        text = lambda x: "".join(f"{v:08x}" for v in x)
        want.append((i, len(t), hashlib.sha256(edited(t, u).encode()).hexdigest(), text(a), text(b), pytest.approx(share(a, b)), pytest.approx(share(a, c))))
    assert sorted((tuple(r) for r in rows), key=str) == sorted(want, key=str)


def test_op6_slices_a_shared_id(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "SLICE_ROWS", 40)
    rows = [(7, f"text {k}") for k in range(900)] + [(k, f"other {k}") for k in range(100, 400)] + [(None, f"none {k}") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sliced, total = fingerprints.sliced(docs)
    assert total == len(rows) and sliced.filter("again = 0").count() == len(rows)
    assert max(r["count"] for r in sliced.groupBy("slice").count().collect()) < 120
    order = sorted(rows, key=lambda d: (d[0] is not None, d[0] or 0, signed(xx(d[1]))), reverse=True)
    want = [(i, hashlib.sha256(edited(t, u).encode()).hexdigest()) for (i, t), (_, u) in zip(order, [*order[1:], order[0]], strict=True)]
    got = [(r["doc_id"], r["edited_sha256"]) for r in fingerprints.fingerprints(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_op6_estimates_generalised_jaccard(spark):
    rng = np.random.default_rng(3)
    rows = [(k, " ".join(rng.choice([f"w{j}" for j in range(60)], 400, p=np.arange(1, 61) / 1830))) for k in range(200)]
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    from collections import Counter

    gaps = []
    for k in range(1, 200):
        a, b = Counter(rows[k][1].split()), Counter(rows[k - 1][1].split())
        gaps.append(got[k]["near_next"] - sum((a & b).values()) / sum((a | b).values()))
    assert abs(np.mean(gaps)) < 0.03 and np.std(gaps) < 2 * math.sqrt(0.25 / fingerprints.SAMPLES)


def test_op7(spark, small):
    rows = Q["op7_lm_scoring"](spark, small).collect()
    docs = documents(spark, small)
    from collections import Counter

    counts = Counter(w for i, t in docs if not lm_scoring.held_out(i) for w in lm_scoring.words_of(t.encode().lower()))
    n, v = sum(counts.values()), len(counts)
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(docs)
    for i, t in docs:
        words, r = lm_scoring.words_of(t.encode().lower()), by[i]
        assert (r["n_tokens"], r["train_tokens"], r["held_out"]) == (len(words), n, lm_scoring.held_out(i))
        assert r["n_known"] == sum(counts[w] > 0 for w in words)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), rel=1e-9)
        assert r["score"] < 0
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > 1.02 * sum(r["base_score"] for r in held)


def corpus():
    rng = np.random.default_rng(4)
    follow = {w: rng.dirichlet(np.ones(7) * 0.4) for w in ["", *"abcdefg"]}
    out = []
    for k in range(60):
        words = [""]
        for _ in range(int(rng.integers(3, 25))):
            words.append("abcdefg"[rng.choice(7, p=follow[words[-1]])])
        out.append((k, " ".join(words[1:]) + (" new" if k % 20 == 3 else "")))
    return out


def training(docs):
    """Tokens of the training documents as pairs of a context (None at the start) and a word."""
    out = []
    for i, t in docs:
        if not lm_scoring.held_out(i):
            words = lm_scoring.words_of(t.encode())
            out += zip([None, *words[:-1]], words, strict=True)
    return out


def seated_one_by_one(tokens, discounts, sweeps, burn_in, seed=0):
    """Averaged predictive probabilities of a Gibbs sampler that takes each customer out and seats it again."""
    rng, theta, (d0, d1) = np.random.default_rng(seed), lm_scoring.STRENGTH, discounts
    vocabulary = sorted({w for _, w in tokens})
    base = 1 / (len(vocabulary) + 1)
    parent, rooms = {}, {}

    def customers(room):
        return sum(map(sum, room.values()))

    def tables(room):
        return sum(map(len, room.values()))

    def p0(w):
        mine = parent.get(w, [])
        return (sum(mine) - d0 * len(mine) + (theta + d0 * tables(parent)) * base) / (theta + customers(parent))

    def add(room, w, d, new):
        mine = room.setdefault(w, [])
        weights = np.array([*(n - d for n in mine), (theta + d * tables(room)) * new])
        k = rng.choice(len(weights), p=weights / weights.sum())
        if k == len(mine):
            mine.append(1)
            return True
        mine[k] += 1
        return False

    def out(room, w):
        mine = room[w]
        k = rng.choice(len(mine), p=np.array(mine) / sum(mine))
        mine[k] -= 1
        if not mine[k]:
            del mine[k]
            return True
        return False

    def arrive(u, w):
        if u is None or add(rooms.setdefault(u, {}), w, d1, p0(w)):
            add(parent, w, d0, base)

    def leave(u, w):
        if u is None or out(rooms[u], w):
            out(parent, w)

    for u, w in tokens:
        arrive(u, w)
    found, n = {}, 0
    for sweep in range(sweeps):
        for u, w in tokens:
            leave(u, w)
            arrive(u, w)
        if sweep >= burn_in:
            n += 1
            for w in [*vocabulary, None]:
                p = p0(w)
                found[None, w] = found.get((None, w), 0) + p
                for u, room in rooms.items():
                    mine = room.get(w, [])
                    found[u, w] = found.get((u, w), 0) + (sum(mine) - d1 * len(mine) + (theta + d1 * tables(room)) * p) / (theta + customers(room))
    return {k: v / n for k, v in found.items()}


def swept(tokens, sweeps, burn_in, seed=0):
    """The operator's own restaurants over one range in this process: model, and averaged probabilities."""
    vocabulary, contexts = sorted({w for _, w in tokens}), sorted({u for u, _ in tokens if u and u != lm_scoring.END})
    counts = np.array([sum(w == x for _, x in tokens) for w in vocabulary])
    pairs = sorted({(vocabulary.index(w), contexts.index(u)) for u, w in tokens if u in contexts})
    n = np.array([sum((u, w) == (contexts[c], vocabulary[x]) for u, w in tokens) for x, c in pairs])
    word, context = np.array(pairs).T
    r = lm_scoring.Range(lm_scoring.Range.of_pairs(counts, np.arange(len(contexts)), word, context, n))
    t, tw = r.first()
    seated, single = r.seated(t), r.single.sum()
    model = lm_scoring.Model(int(counts.sum()), len(vocabulary), (lm_scoring.discount((seated == 1).sum(), (seated == 2).sum()), lm_scoring.discount(single, (r.n == 2).sum())), [(seated.sum(), tw.sum())])
    found, kept = {}, 0
    for sweep in range(1, sweeps + 1):
        t, tw = r.sweep(model, t, tw, r.sums(t), np.random.default_rng([seed, sweep]))
        model.parents.append((r.seated(t).sum(), tw.sum()))
        if sweep > burn_in:
            kept += 1
            p, sums = r.words(model, sweep, t, tw), r.sums(t)
            tables = np.minimum(n, 1).astype(float)
            tables[n > 1] = t
            own = {(c, x): k for k, (x, c) in enumerate(pairs)}
            for x, w in enumerate([*vocabulary, None]):
                found[None, w] = found.get((None, w), 0) + p[x]
                for c, u in enumerate(contexts):
                    k = own.get((c, x))
                    found[u, w] = found.get((u, w), 0) + ((n[k] - model.discounts[1] * tables[k] if k is not None else 0) + (lm_scoring.STRENGTH + model.discounts[1] * sums[c]) * p[x]) / (lm_scoring.STRENGTH + r.customers[c])
    return model, {k: v / kept for k, v in found.items()}


def test_op7_against_seating_one_by_one(spark):
    docs = corpus()
    tokens = training(docs)
    model, got = swept(tokens, 400, 50)
    want = seated_one_by_one(tokens, model.discounts, 250, 30)
    for u in {k[0] for k in got}:
        assert sum(p for (x, _), p in got.items() if x == u) == pytest.approx(1, abs=1e-9)  # a distribution
    # Two runs of the sampler differ by up to a fifth themselves, with few words.
    gaps = [abs(math.log(got[k] / want[k])) for k in got]
    assert max(gaps) < 0.35 and sum(gaps) / len(gaps) < 0.08
    contexts = {u for u, _ in got}
    rows = lm_scoring.score_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), min_context=1).collect()
    assert len(rows) == len(docs)
    sums = np.zeros(3)
    for r in rows:
        words = lm_scoring.words_of(dict(docs)[r["doc_id"]].encode())
        known = {w for _, w in tokens}
        logs = [math.log10(want[u if u in contexts else None, w if w in known else None]) for u, w in zip([None, *words[:-1]], words, strict=True)]
        assert r["score"] == pytest.approx(sum(logs), rel=0.2)
        sums += [r["score"], sum(logs), r["base_score"]]
    assert sums[0] == pytest.approx(sums[1], rel=0.03) and sums[0] > sums[2]


def test_op7_draws_tables_from_the_conditional():
    from itertools import product

    d, rising, parent, c = 0.6, 1.7, 0.2, 4
    weights = np.zeros(c + 1)
    for seats in product(range(c), repeat=c):  # set partitions as first-come table numbers
        if all(s <= max(seats[:k], default=-1) + 1 for k, s in enumerate(seats)):
            sizes = np.bincount(seats)
            weights[len(sizes)] += np.prod([np.prod([m - d for m in range(1, n)]) for n in sizes]) * np.prod([parent * (rising + d * k) for k in range(len(sizes))])
    many = 40_000
    drawn = lm_scoring.draw(np.full(many, c), d, np.full(many, rising), np.full(many, parent), lm_scoring.log_stirling(d), np.random.default_rng(1))
    assert np.bincount(drawn.astype(int), minlength=c + 1) / many == pytest.approx(weights / weights.sum(), abs=0.01)
    big = lm_scoring.draw(np.array([0, 1, 500]), d, np.full(3, rising), np.full(3, parent), lm_scoring.log_stirling(d), np.random.default_rng(1))
    assert big[0] == 0 and big[1] == 1 and 1 <= big[2] <= 500


def test_op7_contexts_and_partitions(spark):
    """Partitions don't change counts and base scores; fewer contexts, and none, still give a score for all."""
    docs = spark.createDataFrame([*corpus(), (None, None), (3, "a b c"), (3, "a b c")], "doc_id long, text string")
    one, many = (sorted((tuple(r) for r in lm_scoring.score_documents(docs.repartition(k), min_context=40).collect()), key=str) for k in (1, 7))
    assert len(one) == 63
    for a, b in zip(one, many, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-12) and a[6] == pytest.approx(b[6], rel=0.05)
    none = lm_scoring.score_documents(docs, min_context=10**9).collect()
    assert len(none) == 63 and all(r["score"] < 0 for r in none)


def test_op8(spark, small):
    rows = Q["op8_token_files"](spark, small).collect()
    e, docs = TextEncoder(), documents(spark, small)
    docs.sort(key=lambda x: (x[0] is not None, x[0] or 0))
    at = 0
    expected = []
    for i, t in docs:
        ids = np.concatenate([e.encode(t), [2]]).astype("<u4")
        expected.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [tuple(r) for r in sorted(rows, key=lambda r: r["start"])] == expected
    assert token_files.read_token_files(spark, []).count() == 0


def test_op9(spark, small):
    rows = sorted((tuple(r) for r in Q["op9_url_filters"](spark, small).collect()), key=lambda r: (r[0] or 0, r[1]))
    assert [(r[0], r[1], r[2], r[3]) for r in rows] == [(None, "a.org", "/fr/", None), (1, "a.com", "/x", "com/"), (2, "www.example.com", "/en/1", "www.example.com/en/"), (3, "", "", None), (4, "", "", None), (5, "h.net", "/es/2", "net/es/"), (5, "h.net", "/es/2", "net/es/"), (6, "x.net", "", None)]
    assert {r[0]: r[4] for r in rows if r[3]} == {1: "allow", 2: "allow", 5: "block"} and {r[4] for r in rows} <= {"allow", "block"}


def test_op9_mines_rules(spark):
    pages = spark.createDataFrame([(k, f"http://{'bad' if k % 3 == 0 else 'good'}.org/{'x' if k % 2 else 'y'}/{k}", None) for k in range(300)], "page_id long, url string, html string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(0, 300, 2)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r["verdict"] for r in url_filters.judge(pages, labels).collect()}
    assert all(got[k] == ("block" if k % 3 == 0 else "allow") for k in range(300))


def test_op9_against_brute_force(spark):
    from itertools import combinations

    rng = np.random.default_rng(2)
    urls = [f"http://{'abc'[int(rng.integers(3))]}.{'xy'[int(rng.integers(2))]}.org/{'pq'[int(rng.integers(2))]}/{k}?{'uv'[int(rng.integers(2))]}=1" for k in range(240)]
    bad = [bool(rng.random() < (0.9 if "/p/" in u and "a." in u else 0.1)) for u in urls]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    labels = spark.createDataFrame([(k, int(not b)) for k, b in enumerate(bad) if k < 200], "doc_id long, quality int")
    sets, marks = [frozenset(url_filters.tokens_of(u)) for u in urls], bad[:200]
    extents = {}
    for t in sorted(set().union(*sets[:200])):
        extents.setdefault(tuple(t in s for s in sets[:200]), t)
    rules, share = [], sum(marks) / 200
    for size in range(1, 7):
        for some in combinations(sorted(extents.values()), size):
            hit = [m for s, m in zip(sets, marks, strict=False) if s.issuperset(some)]
            if sum(hit) >= url_filters.MIN_PAGES and sum(hit) / len(hit) >= max(url_filters.MIN_CONFIDENCE, share) and url_filters.evidence(sum(hit), len(hit), share) >= url_filters.MIN_EVIDENCE:
                rules.append((frozenset(some), sum(hit) / len(hit)))
    assert rules
    got = {r["page_id"]: (r["verdict"], r["confidence"]) for r in url_filters.judge(pages, labels, listed=()).collect()}
    for k, s in enumerate(sets):
        sure = max((c for some, c in rules if some <= s), default=None)
        assert got[k] == ("allow", None) if sure is None else got[k][0] == "block" and got[k][1] == pytest.approx(sure)


def test_op9_keeps_all_tokens_and_needs_pages(spark):
    long = "http://a.b.c.d.e.f/" + "/".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)) + "/porn?" + "&".join(f"k{chr(97 + k)}=1" for k in range(20)) + "&adult=1"
    assert {"host-5=a", "path=porn", "key=adult"} <= set(url_filters.tokens_of(long)) and len(url_filters.tokens_of(long)) == 328
    rows = [(k, long) for k in range(10)] + [(k, f"http://g{k}.org/x?adult=0") for k in range(10, 14)] + [(k, f"http://h{k}.org/y") for k in range(14, 200)]
    labels = [(k, 0, 0) for k in range(14)] + [(k, 1, 0) for k in range(14, 200)] + [(14, 0, 0)]
    pages = spark.createDataFrame([*rows, (500, "http://q.net/porn"), (501, "http://z.q/" + "p/" * 50_000), (502, "http://h20.org/y/adult")], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filters.judge(pages, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), listed=()).collect()}
    assert all(got[k] == "block" for k in range(14)) and all(got[k] == "allow" for k in range(14, 200)) and got[501] == got[502] == "allow"


def test_op10(spark, small):
    rows = Q["op10_mixing"](spark, small).collect()
    sizes = {}
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        sizes.setdefault(r["source"], []).append(len((r["text"] or "").encode().split()))
    targets = mixing.share_out([(s, sum(x)) for s, x in sizes.items()])
    made = mixing.mix(spark.read.parquet(f"{small}/documents.parquet")).collect()
    for s, x in sizes.items():
        own = [r for r in made if r["source"] == s]
        assert len(own) == len(x) and all(r["source_size"] == sum(x) and r["target"] == pytest.approx(targets[s]) and r["taken"] <= 2 * r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - targets[s]) <= max(x)
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(map(key, rows)) == sorted(map(key, Q["op10_mixing"](spark, small).collect()))


@pytest.mark.parametrize("share", [0.4, 1.0, 1.5])
def test_op10_takes_the_smallest_exponential_keys(spark, share):
    """Which documents a source's fraction holds, by keys sorted one source at a time: ``-ln(u) / quality``, whole epochs first."""
    rng = np.random.default_rng(12)
    rows = [(k, " ".join(rng.choice(WORDS, int(rng.integers(1, 30)))) + "x" * int(rng.integers(0, 40)), "abc"[min(2, k % 5)]) for k in range(600)] + [(900, None, "a"), (901, "", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    drawn = {r["doc_id"]: r["u"] for r in docs.select("doc_id", uniform(F.col("doc_id"), F.xxhash64("text"), seed=mixing.SEED).alias("u")).collect()}
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs, share=share).collect()}
    sources = {}
    for i, t, s in rows:
        size = len((t or "").split())
        weight = max(0.1, 1 / (1 + ((len(t) / max(size, 1) - 6) / 6) ** 2)) if t is not None else 0.1
        sources.setdefault(s, []).append((-math.log(drawn[i]) / weight, i, size))
    targets = mixing.share_out([(s, sum(n for _, _, n in x)) for s, x in sources.items()], share=share)
    for s, x in sources.items():
        total, before = sum(n for _, _, n in x), 0
        epochs = min(int(targets[s] // total), 2)
        budget = targets[s] - epochs * total if epochs < 2 else 0
        for _, i, n in sorted(x):
            once = n > 0 and budget > 0 and (budget - before) / n >= 0.5
            assert copies[i] == epochs + once, (s, i)
            before += n


def test_mixing_with_repeated_rows(spark):
    """Rows equal in all columns, in id only, in text only, and with null ids; the stage returns what the mix takes."""
    rng = np.random.default_rng(8)
    rows = [(k % 40, f"text number {k % 20} " + "word " * (k % 7), "a", k) for k in range(400)]
    rows += [(5, "the same row each time", "b", 1)] * 300 + [(k, "one text", "b", 2) for k in range(50)]
    rows += [(None, " ".join(rng.choice(WORDS, 9)), None, 3) for _ in range(60)] + [(None, None, None, 4)] * 7 + [(9, "", "c", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int").repartition(5)
    for share in (0.3, 0.7, 1.0, 1.5, 1.9):
        made = mixing.mix(docs, share=share).collect()
        got = mixing.copied(docs, share=share)
        assert len(made) == len(rows) and got.columns == docs.columns
        got = got.collect()
        assert len(got) == sum(r["copies"] for r in made)
        want, have = {}, {}
        for r in made:
            want.setdefault((r["doc_id"], r["source"], r["content"]), []).append(r["copies"])
        hashes = {t: h for t, h in docs.selectExpr("text", "xxhash64(text)").distinct().collect()}
        for r in got:
            have[(r["doc_id"], r["source"], hashes[r["text"]])] = have.get((r["doc_id"], r["source"], hashes[r["text"]]), 0) + 1
        assert have == {k: sum(v) for k, v in want.items() if sum(v)} and all(max(v) - min(v) <= 1 for v in want.values())
        for source in ("a", "b", "c", None):
            own = [r for r in made if r["source"] == source]
            assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own) / 2 and all(r["taken"] <= 2 * r["size"] for r in own)


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    calm = stages["toxicity"](spark, docs, small)
    assert calm.columns == docs.columns and {r["doc_id"] for r in calm.collect()} == {i for i, t in documents(spark, small) if " idiot " not in t}
    kept = stages["near_dedup"](spark, calm, small)
    ids = sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in kept.collect())
    components = {r["component_id"] for r in simhash.near_duplicates(calm).collect()}
    assert ids == sorted(c if c is not None else -1 for c in components) and kept.columns == docs.columns
    mixed = stages["mixing"](spark, kept, small)
    taken = sum(r["taken"] for r in mixing.mix(kept).collect())
    assert sum(len((r["text"] or "").encode().split()) for r in mixed.collect()) == taken and mixed.columns == docs.columns
    pieces = stages["packing"](spark, mixed, small).collect()
    e = TextEncoder()
    assert sum(r["length"] for r in pieces) == sum(len(e.encode(r["text"])) + 1 for r in mixed.collect())
    assert corpus_pipeline.run(spark, small).count() == packing.pack(mixed).count()


def test_toxicity_without_labels(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet").filter("toxic = 0")
    assert toxicity.fit(docs, labels).weights == {}


def test_op2_counts_endings_across_partitions(spark):
    """A beginning with an ending of its own in each toxic document is an entry, however the documents are dealt."""
    docs = [(k, f"plain talk number {k} vequ{'abcdefghijkl'[k % 12] * 2} here" if k % 2 else f"plain talk number {k} here") for k in range(200)]
    labels = spark.createDataFrame([(k, 1, k % 2) for k, _ in docs], "doc_id long, quality int, toxic int")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    found = []
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for parts in (1, 60):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            found.append(toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), labels).weights)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found[0] == found[1] and set(found[0]) == {" vequ"}


def test_pipeline_near_dedup_against_brute_force(spark, tmp_path):
    """Of texts with Jaccard similarities from 0.5 to 1 the stage keeps the first of each component of links at 0.8."""
    rng, docs = np.random.default_rng(8), []
    for _ in range(60):
        base = [f"w{k}" for k in rng.integers(0, 3000, int(rng.integers(40, 250)))]
        for share in (0, 0.004, 0.01, 0.02, 0.04, 0.08):
            docs.append(" ".join(f"x{k}" if rng.random() < share else w for k, w in enumerate(base)))
    docs += ["", None, " ", "a b", "A  b", "a b c"]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").lower().split() for t in docs)]
    forest, links = simhash.Forest(), 0
    for i in range(len(docs)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if 5 * len(sets[i] & sets[j]) >= 4 * union:
                forest.join(i, j)
                links += 1
    assert links > 200
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(5)
    kept = simhash.one_of_each(spark, df, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted({forest.root(i) for i in range(len(docs))})


def test_pipeline_near_dedup_tells_rows_with_one_id_apart(spark, tmp_path):
    """Null and repeated ids with different texts: each text stays once, in its own row."""
    rng = np.random.default_rng(4)
    different = [" ".join(rng.choice(WORDS, 40)) for _ in range(9)]
    docs = [(None, t) for t in different[:4]] + [(5, t) for t in different[4:7]] + [(6, different[7]), (7, different[7]), (None, different[8]), (9, different[8])]
    kept = simhash.one_of_each(spark, spark.createDataFrame(docs + docs, "doc_id long, text string").repartition(3), str(tmp_path)).collect()
    order = lambda r: (r[1], r[0] or 0)
    assert sorted(map(tuple, kept), key=order) == sorted(docs[:8] + docs[10:], key=order)


@pytest.mark.parametrize("block", [3, 1024])
def test_pipeline_near_dedup_pairs_of_blocks_are_those_of_buckets(spark, monkeypatch, block):
    """Rows of a bucket meet group by group; what they give is what a loop over all pairs gives."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(8)
    base = rng.choice(WORDS, 60)
    texts = [" ".join(np.where(rng.random(60) < 0.02, rng.choice(WORDS, 60), base)) for _ in range(40)] + [""]
    rows, by_node = [], {}
    for node, text in enumerate(texts):
        found = simhash.shingle_set(text)
        parts = np.bincount((found & np.uint64(simhash.PARTS - 1)).astype(np.int64), minlength=simhash.PARTS).tolist()
        sketch = simhash.sketch(simhash.band_values(found)).tolist()
        bucket, label = node // 25, node % 4
        by_node[node] = (bucket, label, len(found), parts, np.array(sketch).view(np.uint8))
        rows.append((bucket, node, len(found), len(found), label, 25, parts, *sketch))
    columns = "bucket long, node long, size int, common int, label long, n long, parts array<int>, " + ", ".join(f"{c} long" for c in simhash.SKETCH)
    got = {tuple(r) for r in simhash.in_blocks(spark.createDataFrame(rows, columns)).collect()}
    expected = set()
    for a, b in combinations(by_node, 2):
        (bucket_a, label_a, size_a, parts_a, bytes_a), (bucket_b, label_b, size_b, parts_b, bytes_b) = by_node[a], by_node[b]
        if bucket_a == bucket_b and label_a != label_b and 5 * min(size_a, size_b) >= 4 * max(size_a, size_b):
            shared = sum(map(min, parts_a, parts_b))
            if 9 * shared >= 4 * (size_a + size_b) and sum(bytes_a == bytes_b) >= simhash.AGREED:
                expected.add((a, b))
    assert got == expected and expected


def test_pipeline_near_dedup_asks_simhash(spark):
    """The stage's pairs hold what the fingerprints' BK-trees link: their components are op4's."""
    rng = np.random.default_rng(12)
    bases = [rng.choice(WORDS, 300) for _ in range(12)]
    texts = [" ".join(["first" if k == c else w for k, w in enumerate(base)]) for base in bases for c in (-1, 5, 150, 299)] + ["", " "]
    prints = [simhash.fingerprint(t) for t in texts]
    forest = simhash.Forest()
    for i, j in combinations(range(len(texts)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= simhash.RADIUS:
            forest.join(i, j)
    got = simhash.Forest()
    for a, b in simhash.proposed(spark.createDataFrame(list(enumerate(texts)), "node long, text string")).collect():
        got.join(a, b)
    assert [got.root(k) for k in range(len(texts))] == [forest.root(k) for k in range(len(texts))] and len(forest.up) > 12
