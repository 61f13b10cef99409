"""Ball k-means, alignment and the quality ledger against brute force, and on edge rows."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hushframe.llm import alignment, ball_kmeans, quality_ledger
from hushframe.llm.queries import queries

Q = queries()


# ---------------------------------------------------------------- ball k-means


def lloyd(vectors, centroids, rounds):
    """Plain rounds with Python's whole numbers."""
    near = lambda x, cs: min(range(len(cs)), key=lambda c: (sum((a - b) ** 2 for a, b in zip(x, cs[c])), c))
    for _ in range(rounds):
        groups = defaultdict(list)
        for x in vectors:
            groups[near(x, centroids)].append(x)
        centroids = [[sum(col) // len(groups[c]) for col in zip(*groups[c])] if groups[c] else centroids[c] for c in range(len(centroids))]
    return centroids, [near(x, centroids) for x in vectors]


def vectors_table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster int, `a.b` map<string,int>")


def brute_op11(rows):
    kept = [(i, [int(np.floor(np.float64(np.float32(x)) * 1024)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    named = sorted(((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None))[:8]
    centroids, clusters = lloyd([v for _, v in kept], [v for _, v in named], 10)
    far = [sum((a - b) ** 2 for a, b in zip(v, centroids[c])) for (_, v), c in zip(kept, clusters)]
    own = Counter()
    for c, d in zip(clusters, far):
        own[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((-1 if i is None else i, c, d, own[c], sum(far), sha[c]) for (i, _), c, d in zip(kept, clusters, far))


def test_op11_against_plain_rounds(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 64)) * 3
    rows = [(k, (centres[k % 6] + rng.normal(size=64) * 0.3).astype(np.float32).tolist()) for k in range(300)]
    rows += [(400 + k, rows[5][1]) for k in range(150)]  # a third of the rows equal
    rows += [(5, rows[5][1]), (7, rows[7][1]), (None, rows[9][1]), (None, None), (901, None), (902, [0.0] * 64), (903, [1.0] * 63), (904, [float("nan")] + [0.0] * 63), (905, [None] + [0.0] * 63), (906, [float("inf")] + [0.0] * 63)]
    vectors_table(spark, [(i, v, 1, {"x": 1}) for i, v in rows]).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((-1 if r["vec_id"] is None else r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in Q["op11_ball_kmeans"](spark, str(tmp_path)).collect())
    assert got == brute_op11(rows)


def test_op11_few_and_no_vectors(spark, tmp_path):
    vectors_table(spark, [(k, [float(k)] * 64, 1, None) for k in range(3)]).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted((r["vec_id"], r["distance"]) for r in Q["op11_ball_kmeans"](spark, str(tmp_path)).collect()) == [(0, 0), (1, 0), (2, 0)]
    vectors_table(spark, [(1, None, 1, None)]).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert Q["op11_ball_kmeans"](spark, f"{tmp_path}/none").count() == 0


def test_many_buckets_and_small_blocks_change_nothing(spark):
    rng = np.random.default_rng(8)
    vectors = [(k, rng.integers(-50, 50, 5).tolist()) for k in range(400)]
    df = spark.createDataFrame(vectors, "vec_id long, vector array<int>").repartition(3)
    first = np.array([v for _, v in vectors[:7]], np.int64)
    done = ball_kmeans.ball_kmeans(df, first, rounds=6, block=16, per_bucket=90)
    centroids, clusters = lloyd([v for _, v in vectors], [v for _, v in vectors[:7]], 6)
    assert done.centroids.tolist() == centroids
    assert {r["vec_id"]: r["cluster"] for r in done.assigned.collect()} == dict(enumerate(clusters))


def test_rounds_do_not_move_vectors(spark):
    df = spark.createDataFrame([(k, [k % 7, k % 5]) for k in range(100)], "vec_id long, vector array<int>")
    buckets = ball_kmeans._Buckets(spark, 4)
    blocks = buckets.write(ball_kmeans._blocks(df, 8).repartition(4, "block"), "blocks")
    balls = ball_kmeans.Balls.around(np.array([[0, 0], [6, 4]], np.int64), [float("inf")] * 2)
    state = buckets.write(ball_kmeans._round(blocks, balls), "round0")
    met = ball_kmeans._round(blocks.join(state.select("block", "clusters").hint("shuffle_hash"), "block"), balls)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Exchange" not in plan, plan
    buckets.forget()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-6, 6), min_size=2, max_size=2), min_size=1, max_size=40), st.lists(st.lists(st.integers(-6, 6), min_size=2, max_size=2), min_size=1, max_size=6), st.data())
def test_balls_assign_exactly(points, centroids, data):
    """Also with ties, equal centroids, and any cluster to start from, within a radius that holds its members."""
    x, c = np.array(points, np.int64), np.array(centroids, np.int64)
    start = np.array([data.draw(st.integers(0, len(c) - 1)) for _ in points])
    far = ball_kmeans.squared(x, c)
    radii = [float(np.sqrt(far[start == k, k].max(initial=0))) * (1 + 1e-9) + 1e-6 for k in range(len(c))]
    best, least, compared = ball_kmeans.Balls.around(c, radii).assign(x, start)
    assert best.tolist() == far.argmin(axis=1).tolist() and least.tolist() == far.min(axis=1).tolist()
    assert compared <= far.size


def test_separate_balls_stay_uncompared():
    rng = np.random.default_rng(2)
    c = np.array([[0, 0], [1000, 0], [0, 1000]], np.int64)
    start = rng.integers(0, 3, 500)
    x = c[start] + rng.integers(-50, 50, (500, 2))
    best, _, compared = ball_kmeans.Balls.around(c, [100.0] * 3).assign(x, start)
    assert compared == 500 and (best == start).all()


def test_large_components_are_exact():
    x = np.array([[ball_kmeans.LIMIT] * 64, [-ball_kmeans.LIMIT] * 64], np.int64)
    assert ball_kmeans.squared(x, x).tolist() == [[0, 64 * (2 * ball_kmeans.LIMIT) ** 2], [64 * (2 * ball_kmeans.LIMIT) ** 2, 0]]


# ---------------------------------------------------------------- alignment


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in visible} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in visible)}
    return a, b, {v: bytes(byte[c] for c in k) for k, v in a.get_vocab().items()}


def spans(lengths):
    ends = np.cumsum(lengths).tolist()
    return list(zip([0, *ends[:-1]], ends))


def brute_one(tokenizers, text):
    """Whole text at once; links by comparing byte ranges."""
    a, b, a_bytes = tokenizers
    if not text:
        return None
    ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    xa = [a_bytes[i] for i in ia]
    pieces = [b.id_to_piece(i) for i in ib]
    xb = [bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x..>", p) else p.replace("▁", " ").encode() for p in pieces]
    spelt = (" " + text).encode()
    if b"".join(xa) != spelt or b"".join(xb) != spelt:
        return None
    sa, sb = spans(list(map(len, xa))), spans(list(map(len, xb)))
    links, j0 = [], 0
    for i, (lo, hi) in enumerate(sa):
        while sb[j0][1] <= lo:
            j0 += 1
        j = j0
        while j < len(sb) and sb[j][0] < hi:
            links.append((ia[i], ib[j]))
            j += 1
    ends, groups = sorted({e for _, e in sa} & {e for _, e in sb}), []
    low = 0
    for e in ends:
        groups.append(([t for t, (s, _) in zip(ia, sa) if low <= s < e], [t for t, (s, _) in zip(ib, sb) if low <= s < e]) if len(ia) < 500 else None)
        low = e
    text_ = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups) if None not in groups else None
    return len(ia), len(ib), len(groups), links, text_


def brute_op12(tokenizers, docs):
    found = [(i, brute_one(tokenizers, t)) for i, t in docs]
    counts = Counter(link for _, f in found if f for link in f[3])
    highest = defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    out = []
    for i, f in found:
        if f is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        best = sum(counts[link] == highest[link[1]] for link in f[3])
        out.append((i, f[0], f[1], f[2], len(f[3]), best, sum(counts[x] for x in f[3]), hashlib.sha256(f[4].encode()).hexdigest() if f[4] is not None else None))
    return out


ODD = ["a  b   c", " lead", "trail ", "trail  ", "  ", " ", "\n", "x\n y\n\n  z", "tab\t x", "don't we'll  've", "ﬁne Å é́ 日本語 テキスト", "🙂 🙃🙂", "<s> </s> <unk> <|endoftext|> <0x41>", "a▁b", "▁", "x\r\n y;\r z", "\x00 nul \x00", "  nbsp  x", "  em  space", "12345 6789 1,000.5", "a" * 300, "ß" * 50 + " ü", "\x1c sep \x1d x", "if (x) { return y; }\n    }\n", "ひらがな とカタカナ", "é combining"]


def same(got, expected):
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    for g, e in zip(sorted(got, key=key), sorted(expected, key=key), strict=True):
        assert g[:7] == e[:7] and (e[7] is None or g[7] == e[7]), (g, e)


@pytest.mark.parametrize("block_chars", [300, 8_000_000])
def test_op12_against_brute_force(spark, tokenizers, tmp_path, block_chars):
    rng = np.random.default_rng(4)
    docs = [*enumerate([None, "", *ODD]), (3, "a  b   c"), (None, "null id"), (99, "long text " * 2000)]
    docs += [(200 + k, " ".join(rng.choice("the quick browné fox Über naïve don't 42 tokenization, (parsing) ünïcode".split(), 40))) for k in range(30)]
    df = spark.createDataFrame([(i, t, 5, {"k": 1}) for i, t in docs], "doc_id long, text string, n_a int, `a.b` map<string,int>").repartition(3)
    got = [tuple(r) for r in alignment.aligned_documents(df, block_chars=block_chars).collect()]
    same(got, brute_op12(tokenizers, docs))


def test_op12_query(spark, tokenizers, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    same([tuple(r) for r in Q["op12_alignment"](spark, sf_dir).collect()], brute_op12(tokenizers, docs))


def test_op12_no_documents(spark):
    assert alignment.aligned_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab '’sé日🙂 \n\t\r.,1▁   \x1c")), max_size=25))
def test_units_align_as_the_whole_text_does(text):
    both = alignment.pair()
    whole = both.align([text])[0] if text else None
    if whole is None:
        return
    units = alignment._UNITS.split(text)
    parts = [both.align([u])[0] for u in units]
    assert parts[::-1] == both.align(units[::-1])
    if any(p is None for p in parts):  # the query asks the whole text then
        return
    assert ";".join(p.groups for p in parts) == whole.groups and b"".join(p.links for p in parts) == whole.links
    assert [sum(p[k] for p in parts) for k in range(3)] == list(whole[:3])


def test_labels():
    assert alignment.label_string(np.array([2, 2]), np.array([1, 3])) == b"ba.="
    assert alignment.groups_of(b"ba.=.=") == [(2, 2), (1, 1)]


def test_few_odd_units_do_not_part_the_others():
    """Units that end in white space, or that can't be aligned, are asked by themselves; the rest stays together."""
    both, calls = alignment.Pair(), []

    class Counted:
        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        def __getattr__(self, name):
            calls.append(name)
            return getattr(self.tokenizer, name)

    units = [f"word{k}" for k in range(2000)]
    units[7], units[900] = "line\n", "a▁b"
    alone = [both.align([u])[0] for u in units]
    both.a = Counted(both.a)
    assert both.align(units) == alone and [k for k, x in enumerate(alone) if x is None] == [900]
    assert len(calls) < 150


# ---------------------------------------------------------------- quality ledger


def brute_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = {k + j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


LEDGER = [None, "", " \n ", "one", "w " * 40, "a b c d e f g h " * 2, "a b c d e f g h x a b c d e f g h", "same line\nsame line\n\n\nother\nsame line ", "THE END IS!! NIGH!! " * 9, "a|b <x> #1 *** $5 100% &c", "x" * 50_000, "é " * 19, "    nbsp", " ".join(map(str, range(30))), " ".join(f"word{k} Next{k}" for k in range(40))]


def test_op13_against_brute_force(spark, tmp_path):
    docs = [(k, t, k, {"a": 1}) for k, t in enumerate(LEDGER)] + [(4, LEDGER[4], 0, None), (None, LEDGER[6], 0, None)]
    spark.createDataFrame(docs, "doc_id long, text string, failed int, `a.b` map<string,int>").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    rows = Q["op13_quality_ledger"](spark, str(tmp_path)).collect()
    assert len(rows) == len(docs)
    by = {i: t for i, t, _, _ in docs}
    for r in rows:
        m = brute_measures(by[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == m, r
        assert r["base_failed"] == (m[0] < 20 or 100 * m[4] > 30 * m[0]) and not (r["base_failed"] and r["kept"])
    kept = {r["doc_id"] for r in rows if r["kept"]}
    assert 14 in kept and not kept & {4, 8, 9, 10, 13}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("ab\n c"), max_size=60))
def test_measures(letters):
    m = dict(zip(quality_ledger.MEASURES, quality_ledger.measure(" ".join(letters))))
    assert (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"]) == brute_measures(" ".join(letters))


def test_ledger_is_stored_once_and_judged_by_every_policy(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(LEDGER)), "doc_id long, text string")
    quality_ledger.ledger(docs).write.parquet(f"{tmp_path}/ledger")
    stored = spark.read.parquet(f"{tmp_path}/ledger")
    masks = [r["failed"] for r in stored.collect()]
    for name, policy in quality_ledger.POLICIES.items():
        judged = quality_ledger.apply_policy(stored, name)
        drop = lambda m, p=policy: bool(m & (p.hard | quality_ledger.BASE)) or (m & p.soft).bit_count() > p.allowed
        assert sorted((r["doc_id"], r["kept"], r["policy"]) for r in judged.collect()) == sorted((r["doc_id"], not drop(r["failed"]), name) for r in stored.collect())
    found = {(r["policy"], r["rule"]): r for r in quality_ledger.ablations(stored).collect()}
    for policy in quality_ledger.POLICIES.values():
        for name, bit in quality_ledger.BIT.items():
            if not (policy.hard | policy.soft) & bit:
                assert (policy.version, name) not in found
                continue
            reject = lambda m, p: bool(m & p.hard) or (m & p.soft).bit_count() > p.allowed
            r, less = found[policy.version, name], policy.without(name)
            together = 0
            for m in masks:
                together |= m & ~bit if m & bit else 0
            assert (r["documents"], r["kept"], r["failing"], r["dropped_by_it_alone"], r["together_with"]) == (len(masks), sum(not reject(m, policy) for m in masks), sum(bool(m & bit) for m in masks), sum(reject(m, policy) and not reject(m, less) for m in masks), together)


def test_labelled_documents(spark, sf_dir):
    """Every document marked bad goes; good ones go only by the base rules that the contract fixes."""
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/labels.parquet").collect()}
    for r in Q["op13_quality_ledger"](spark, sf_dir.replace("sf0.001", "sf0.01")).collect():
        if labels.get(r["doc_id"]) == 0:
            assert not r["kept"], r
        if labels.get(r["doc_id"]) == 1:
            assert r["kept"] or r["base_failed"], r


def test_alignment_adds_up_a_block_at_a_time(spark):
    """However many blocks one partition has, no step takes more than one of them as a batch or gathers answers in a row."""
    from hushframe.llm import alignment

    docs = spark.createDataFrame([(k, f"some words {k} and others, once more {k % 7}") for k in range(60)] + [(99, None), (100, "")], "doc_id long, text string")
    few = alignment.aligned_documents(docs.repartition(1), block_chars=1)
    plan = few._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan
    whole = {tuple(r) for r in alignment.aligned_documents(docs.repartition(3)).collect()}
    assert {tuple(r) for r in few.collect()} == whole and len(whole) == 62


def test_alignment_rows_stay_small(spark):
    """A block's units are spread over rows: none of them grows with the block; nor does a worker keep units when its task is over."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(4, 12))) for _ in range(40_000)]
    docs = spark.createDataFrame([(k, " ".join(words[k * 400 : k * 400 + 500])) for k in range(100)] + [(None, None), (7, "")], "doc_id long, text string")
    sizes = alignment.blocks(docs.repartition(1)).selectExpr("count(distinct block)", "max(length(unit_links))", "max(length(link_pairs))", "max(size(pairs))", "count(link_pairs)").first()
    assert sizes[0] == 1 and max(sizes[1:3]) == 100_000 and sizes[3] <= 25_000 and sizes[4] > 2
    same(*([tuple(r) for r in alignment.aligned_documents(docs.repartition(n), block_chars=c).collect()] for n, c in ((1, 8_000_000), (3, 20_000))))
    kept = spark.sparkContext.parallelize([0], 1).mapPartitions(lambda _: [len(p.young) + len(p.old) for p in alignment._pairs.values()]).collect()
    assert not any(kept)
