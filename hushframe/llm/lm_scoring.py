"""Language-model scores by a hierarchical Pitman-Yor model, seated by Gibbs sampling.

Restaurants: one for each context, a preceding word seen at least ``MIN_CONTEXT`` times in training (1, the default: every word);
their shared parent, the unigram restaurant, where tokens in other contexts sit too; above it the uniform distribution
over the training words and one unknown. So contexts grow with the corpus. Of a dish in a restaurant the state is its
number of tables. A sweep draws it anew from its exact conditional: weights of the generalised Stirling numbers times the
rising weights of opening tables, given all other seats of the sweep before. Dishes of more than ``EXACT`` customers, whose
table of numbers would be large, are seated customer by customer instead, from the 64th on in groups. A table sends one
customer to the parent. After ``BURN_IN`` sweeps the predictive probabilities of ``SAMPLES`` sweeps are averaged. Discounts are
estimated from how many dishes have one and two customers.

Data flow: one pass over the texts makes chunks of token numbers, and lists each chunk's distinct words by ranges of their
hash. A range counts its words, wherever they occur, and tells the chunks which are contexts; chunks send it their pairs
of a context and one of its words. A range seats its words in all contexts; how many tables a context has over all
ranges goes through the range that the context belongs to, each sweep, so that the driver holds a few numbers only. Each
chunk then gets the probabilities of its own words and pairs and scores its documents. No task holds more than a chunk
or a range. Tables are bucketed by chunk or range, so tokens and pairs are shuffled once at most.

Defined cases: null text counts as empty (only the end token); without training documents all words are
unknown and the scores are the uniform model's; a null ``doc_id`` hashes as the empty text; repeated rows are
each scored and, in training, each counted; words are told apart by 64-bit hashes; empty tables give no rows; extra
columns are ignored.
"""

from __future__ import annotations

import json
import math
import uuid
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.common import make_importable, shared_dir, stored, table

FOLDS, HELD_OUT = 7, 2
MIN_CONTEXT = 1
BURN_IN, SAMPLES = 2, 3
STRENGTH = 1.0
#: Customers of a dish up to which its tables are drawn exactly.
EXACT = 64
CHUNK_CHARS = 16_000_000
RANGE_CHARS = 16_000_000
END = b" end"  # no word holds a blank
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: Rows of all tables between: what kind, the chunk or range it is dealt to, the one it comes from, the sweep, and arrays.
ROW = "kind string, at long, of long, sweep int, data binary"
NAMES = ["kind", "at", "of", "sweep", "data"]


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS == HELD_OUT


def hash_words(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)


def words_of(text: bytes) -> list[bytes]:
    """Words of a text whose A-Z are lower-case, then the end."""
    found = text.split()
    found.append(END)
    return found


def range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each hash, ascending with it."""
    return ((hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def dump(**arrays: np.ndarray) -> bytes:
    """Named arrays as bytes: those of one significance together, compressed."""
    import zstandard

    parts = []
    for a in arrays.values():
        raw = np.ascontiguousarray(a)
        parts.append(zstandard.ZstdCompressor(level=1).compress(raw.view(np.uint8).reshape(len(raw), -1).T.tobytes() if len(raw) else b""))
    head = json.dumps([[k, str(a.dtype), len(p)] for (k, a), p in zip(arrays.items(), parts, strict=True)]).encode()
    return len(head).to_bytes(4, "little") + head + b"".join(parts)


def load(data: bytes) -> dict[str, np.ndarray]:
    import zstandard

    size = int.from_bytes(data[:4], "little")
    at, out = 4 + size, {}
    for name, kind, length in json.loads(data[4:at]):
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[at : at + length]), np.uint8)
        out[name] = np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()
        at += length
    return out


def steps(values: np.ndarray) -> np.ndarray:
    """Differences of mostly ascending numbers, which compress better; ``cumsum`` undoes it."""
    return np.diff(values.astype(np.int64), prepend=np.int64(0))


def frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=NAMES)


def bucketed(spark: SparkSession, df: DataFrame, name: str, buckets: int) -> DataFrame:
    """``stored``, in buckets of ``at``: what groups by it later reads them as they are."""
    path, made = shared_dir(spark, name), f"hushframe_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").bucketBy(buckets, "at").option("path", path).saveAsTable(made)
    out = spark.table(made)
    spark.sql(f"DROP TABLE {made}")  # only its name: the files stay
    return out


@dataclass
class Model:
    """What the driver knows: sizes, discounts, and after each sweep the unigrams' customers and tables."""

    n: int = 0
    v: int = 0
    discounts: tuple[float, float] = (0.5, 0.5)
    parents: list[tuple[float, float]] = field(default_factory=list)


def discount(ones: float, twos: float) -> float:
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones + twos else 0.5


def log_stirling(d: float, most: int = EXACT) -> np.ndarray:
    """Logs of the generalised Stirling numbers ``S(c, t)``: ways to seat c customers at t tables, weighted by the discount."""
    s = np.full((most + 1, most + 1), -np.inf)
    s[1, 1] = 0.0
    for c in range(1, most):
        t = np.arange(1, c + 2)
        s[c + 1, 1 : c + 2] = np.logaddexp(s[c, t - 1], np.where(c > d * t, s[c, t] + np.log(np.maximum(c - d * t, 1e-300)), -np.inf))
    return s


def seat(counts: np.ndarray, d: float, odds: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish: customers come in turn and open a table with weight ``odds`` against
    customers seated less the discount a table. From the 64th on they come in groups of an eighth of those seated."""
    tables = (counts > 0).astype(np.float64)
    open_ = np.flatnonzero(counts > 1)
    seated, sizes, odds_ = 1, counts[open_].astype(np.int64), odds[open_]
    while len(open_):
        group = 1 if seated < 64 else seated // 8
        step = np.minimum(group, sizes - seated)
        t = tables[open_]
        p = odds_ / (odds_ + np.maximum(seated - d * t, 1e-12))
        tables[open_] = t + ((rng.random(len(open_)) < p) if group == 1 else rng.binomial(step, p))
        seated += group
        more = sizes > seated
        open_, sizes, odds_ = open_[more], sizes[more], odds_[more]
    return tables


def draw(counts: np.ndarray, d: float, rising: np.ndarray, parent: np.ndarray, numbers: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish, from the conditional: ``S(c, t) * parent^t * rising (rising + d) ... (rising + (t - 1) d)``.
    ``rising``: the strength plus the discount times the restaurant's other tables."""
    tables = (counts > 0).astype(np.float64)
    order = np.argsort(counts, kind="stable")
    of = counts[order]
    for c in range(2, EXACT + 1):
        lo, hi = np.searchsorted(of, [c, c + 1])
        for first in range(lo, hi, 2_000_000 // c):
            rows = order[first : min(hi, first + 2_000_000 // c)]
            t = np.arange(c)
            weights = numbers[c, 1 : c + 1] + (t + 1) * np.log(parent[rows])[:, None] + np.cumsum(np.log(rising[rows][:, None] + d * t), axis=1)
            sums = np.cumsum(np.exp(weights - weights.max(axis=1, keepdims=True)), axis=1)
            tables[rows] = 1 + (sums < (rng.random(len(rows)) * sums[:, -1])[:, None]).sum(axis=1)
    many = order[np.searchsorted(of, EXACT + 1) :]
    tables[many] = seat(counts[many], d, rising[many] * parent[many], rng)
    return tables


class Range:
    """One range's words: how often each sits at the parent directly, and its pairs with contexts.

    Only pairs of two or more customers have seats to draw; of the others, sums by word and context are kept.
    """

    def __init__(self, a: dict[str, np.ndarray]):
        self.counts, self.fixed = a["counts"].astype(np.int64), a["fixed"].astype(np.int64)
        self.contexts = np.cumsum(a["contexts"])
        self.single, self.customers = a["single"].astype(np.int64), a["customers"].astype(np.int64)
        self.word, self.context, self.n = np.cumsum(a["word"]), a["context"].astype(np.int64), a["n"].astype(np.int64)

    @staticmethod
    def of_pairs(counts: np.ndarray, contexts: np.ndarray, word: np.ndarray, context: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
        """Arrays of a range from training counts of words, context ids, and pairs of a word and a context."""
        more, once = n > 1, n == 1
        fixed = counts - np.bincount(word, n, len(counts)).astype(np.int64) + np.bincount(word, once, len(counts)).astype(np.int64)
        single, customers = np.bincount(context, once, len(contexts)), np.bincount(context, n, len(contexts))
        return {"counts": counts.astype(np.int64), "fixed": fixed, "contexts": steps(contexts), "single": single.astype(np.int64), "customers": customers.astype(np.int64), "word": steps(word[more]), "context": context[more].astype(np.int32), "n": n[more].astype(np.int64)}

    def first(self) -> tuple[np.ndarray, np.ndarray]:
        return np.ones(len(self.n)), (self.counts > 0).astype(np.float64)

    def seated(self, tables: np.ndarray) -> np.ndarray:
        """The words' customers in the parent."""
        return self.fixed + np.bincount(self.word, tables, len(self.counts))

    def sums(self, tables: np.ndarray) -> np.ndarray:
        """This range's tables by context."""
        return self.single + np.bincount(self.context, tables, len(self.contexts))

    def sweep(self, model: Model, tables: np.ndarray, word_tables: np.ndarray, of_context: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """Tables of pairs and of words, drawn given the last ones, and ``of_context``: the contexts' tables over all ranges."""
        (d0, d1), (customers, parent_tables) = model.discounts, model.parents[-1]
        base = 1.0 / (model.v + 1)
        back = (STRENGTH + d0 * parent_tables) * base
        others = np.maximum(self.seated(tables)[self.word] - tables - d0 * word_tables[self.word], 0.0)
        parent = (others + back) / (STRENGTH + customers - tables)
        rising = STRENGTH + d1 * np.maximum(of_context[self.context] - tables, 0.0)
        tables = draw(self.n, d1, rising, parent, log_stirling(d1), rng)
        rising = STRENGTH + d0 * np.maximum(parent_tables - word_tables, 0.0)
        return tables, draw(np.rint(self.seated(tables)).astype(np.int64), d0, rising, np.full(len(self.counts), base), log_stirling(d0), rng)

    def words(self, model: Model, sweep: int, tables: np.ndarray, word_tables: np.ndarray) -> np.ndarray:
        """Predictive probabilities of the words in the parent, and at last of one never seen."""
        d0, (customers, parent_tables) = model.discounts[0], model.parents[sweep]
        back = (STRENGTH + d0 * parent_tables) / (model.v + 1)
        return np.append(self.seated(tables) - d0 * word_tables, 0.0) / (STRENGTH + customers) + back / (STRENGTH + customers)


def cut(docs: DataFrame, ranges: int) -> DataFrame:
    """A row a chunk: tokens and documents, and for each range its ``words``, with hashes and training counts. Tokens are numbers of the chunk's words, the commonest first; ``place`` is where a number stands in order of the hash."""

    def run(batches):
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        index: dict[bytes, int] = {}
        ids, flat, held = [], [], 0

        def chunk() -> pd.DataFrame:
            name = (part << 32) + number
            lengths = np.array([len(x) for x in flat], np.int64)
            tokens = np.concatenate(flat).astype(np.int64)
            held_ = np.array([held_out(i) for i in ids])
            trained = np.bincount(tokens, np.repeat(~held_, lengths), len(index)).astype(np.int64)
            common = np.argsort(-np.bincount(tokens, minlength=len(index)), kind="stable")
            rank = np.empty(len(index), np.int64)
            rank[common] = np.arange(len(index))
            hashes = hash_words(list(index))
            order = np.argsort(hashes)
            place = np.empty(len(index), np.uint32)
            place[rank[order]] = np.arange(len(index))
            hashes, trained = hashes[order], trained[order]
            data = dump(ids=np.array([i or 0 for i in ids], np.int64), known=np.array([i is not None for i in ids]), held=held_, lengths=lengths, tokens=rank[tokens].astype(np.uint32), place=place)
            cuts = np.searchsorted(range_of(hashes, ranges), np.arange(ranges + 1)).tolist()
            words = [{"of": q, "data": dump(hashes=hashes[a:b], counts=trained[a:b])} for q, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
            return pd.DataFrame({"at": [name], "data": [data], "words": [words]})

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids.append(None if pd.isna(doc_id) else int(doc_id))
                raw = (text or "").encode("utf-8", "surrogatepass").lower()
                words = words_of(raw)
                flat.append(np.fromiter((index.setdefault(w, len(index)) for w in words), np.uint32, len(words)))
                held += len(raw)
                if held >= CHUNK_CHARS:
                    yield chunk()
                    index.clear()
                    ids, flat, held, number = [], [], 0, number + 1
        if ids:
            yield chunk()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "at long, data binary, words array<struct<of: long, data: binary>>")


def counted(words: DataFrame, min_context: int) -> DataFrame:
    """Of each range a row ``range`` (training words' counts, and which are contexts), and for each chunk a row ``counts``:
    where its words stand in the range (behind all: unknown), their counts, and their number among its contexts."""
    end = hash_words([END])[0]

    def run(found: pd.DataFrame) -> pd.DataFrame:
        q = int(found["of"].iloc[0])
        parts = [load(x) for x in found["data"]]
        hashes, at = np.unique(np.concatenate([p["hashes"] for p in parts]), return_inverse=True)
        counts = np.zeros(len(hashes), np.int64)
        np.add.at(counts, at, np.concatenate([p["counts"] for p in parts]))
        hashes, counts = hashes[counts > 0], counts[counts > 0]
        context = (counts >= min_context) & (hashes != end)
        rank = np.where(context, np.cumsum(context) - 1, -1).astype(np.int32)
        out = [("range", q, -1, -1, dump(counts=counts, context=context))]
        for chunk, p in zip(found["at"], parts, strict=True):
            index = np.searchsorted(hashes, p["hashes"])
            hit = np.append(hashes, np.uint64(0))[index] == p["hashes"]
            hit &= index < len(hashes)
            index = np.where(hit, index, len(hashes))
            out.append(("counts", int(chunk), q, -1, dump(index=index.astype(np.int32), rank=np.append(rank, np.int32(-1))[index])))
        return frame(out)

    return words.groupBy("of").applyInPandas(run, ROW)


class Chunk:
    """A chunk's tokens as places in order of the hash, and its pairs in order of word, then context."""

    def __init__(self, a: dict[str, np.ndarray], context: np.ndarray):
        """``context``: by place, whether a word is a context."""
        self.lengths, self.tokens = a["lengths"], a["place"][a["tokens"]].astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        number = np.where(context, np.cumsum(context) - 1, -1)
        before = np.full(len(self.tokens), -1, np.int64)
        before[1:] = number[self.tokens[:-1]]
        before[self.starts] = -1  # a document's first token has no context
        self.within = np.flatnonzero(before >= 0)
        self.width = max(1, int(context.sum()))
        self.keys, self.pair = np.unique(self.tokens[self.within] * self.width + before[self.within], return_inverse=True)


def pairs_of(tokens: DataFrame, counts: DataFrame) -> DataFrame:
    """Of each chunk and range a row ``pairs``: the chunk's words there, and its pairs with their training counts."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, name = load(left["data"].iloc[0]), int(left["at"].iloc[0])
        right = right.sort_values("of")
        parts = [load(x) for x in right["data"]]
        rank = np.concatenate([p["rank"] for p in parts]).astype(np.int64)
        sizes = [len(p["rank"]) for p in parts]
        place = np.repeat(right["of"].to_numpy(np.int64), sizes)
        chunk = Chunk(a, rank >= 0)
        contexts = ((place << 32) | rank)[rank >= 0]
        n = np.bincount(chunk.pair, np.repeat(~a["held"], chunk.lengths)[chunk.within], len(chunk.keys)).astype(np.uint32)
        word, context = chunk.keys // chunk.width, chunk.keys % chunk.width
        ends = np.cumsum([0, *sizes])
        cuts = np.searchsorted(word, ends)
        out = []
        for k, (q, p) in enumerate(zip(right["of"], parts, strict=True)):
            lo, hi = cuts[k], cuts[k + 1]
            out.append(("pairs", int(q), name, -1, dump(index=p["index"], word=steps(word[lo:hi] - ends[k]).astype(np.int32), context=contexts[context[lo:hi]] if hi > lo else np.zeros(0, np.int64), n=n[lo:hi])))
        return frame(out)

    return tokens.groupBy("at").cogroup(counts.groupBy("at")).applyInPandas(run, ROW)


def ranged(ranges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of each range a row: ``data`` for the sweeps, and ``asked``, all its pairs and what each chunk asks."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame(columns=["at", "data", "asked"])
        a, q = load(left["data"].iloc[0]), int(left["at"].iloc[0])
        parts = [load(x) for x in right["data"]]
        joined = lambda name, kind: np.concatenate([p[name] for p in parts]) if parts else np.zeros(0, kind)
        contexts, local = np.unique(joined("context", np.int64), return_inverse=True)
        words = np.concatenate([p["index"].astype(np.int64)[np.cumsum(p["word"])] for p in parts]) if parts else np.zeros(0, np.int64)
        width = max(1, len(contexts))
        keys, at = np.unique(words * width + local, return_inverse=True)
        n = np.bincount(at, joined("n", np.uint32), len(keys)).astype(np.int64)
        word, context = keys // width, keys % width
        seen = n > 0
        asked = {"word": steps(word), "context": context.astype(np.uint32), "n": n, "chunks": right["of"].to_numpy(np.int64), "words": np.array([len(p["index"]) for p in parts], np.int64), "pairs": np.array([len(p["n"]) for p in parts], np.int64), "index": np.concatenate([steps(p["index"]) for p in parts]).astype(np.int32) if parts else np.zeros(0, np.int32), "pair": at.astype(np.uint32), "is_context": a["context"]}
        return pd.DataFrame({"at": [q], "data": [dump(**Range.of_pairs(a["counts"], contexts, word[seen], context[seen], n[seen]))], "asked": [dump(**asked)]})

    return ranges.groupBy("at").cogroup(pairs.groupBy("at")).applyInPandas(run, "at long, data binary, asked binary")


def messages(r: Range, q: int, sweep: int, tables: np.ndarray) -> list[tuple]:
    """Rows ``sums`` to the ranges of this one's contexts: their numbers there, tables and, the first time, customers."""
    out, sums = [], r.sums(tables)
    owner = r.contexts >> 32
    for to in np.unique(owner).tolist():
        lo, hi = np.searchsorted(owner, [to, to + 1])
        out.append(("sums", int(to), q, sweep, dump(rank=steps(r.contexts[lo:hi] & 0xFFFFFFFF), tables=sums[lo:hi].astype(np.int64), customers=r.customers[lo:hi] if sweep == 0 else np.zeros(0, np.int64))))
    return out


def totals(sums: DataFrame) -> DataFrame:
    """Rows ``totals`` back to the ranges that asked: their contexts' tables over all ranges, the first time customers."""

    def run(found: pd.DataFrame) -> pd.DataFrame:
        parts = [load(x) for x in found["data"]]
        ranks = [np.cumsum(p["rank"]) for p in parts]
        tables = np.zeros(max(int(r[-1]) for r in ranks) + 1, np.int64)
        customers = np.zeros_like(tables)
        for r, p in zip(ranks, parts, strict=True):
            tables[r] += p["tables"]
            if len(p["customers"]):
                customers[r] += p["customers"]
        at = int(found["at"].iloc[0])
        return frame([("totals", int(q), at, int(s), dump(tables=tables[r], customers=customers[r] if s == 0 else customers[:0])) for q, s, r in zip(found["of"], found["sweep"], ranks, strict=True)])

    return sums.groupBy("at", "sweep").applyInPandas(run, ROW)


def of_contexts(r: Range, rows: pd.DataFrame, what: str) -> np.ndarray:
    """The contexts' ``tables`` or ``customers``, from rows ``totals``."""
    out = np.zeros(len(r.contexts))
    owner = r.contexts >> 32
    for of, data in zip(rows["of"], rows["data"], strict=True):
        lo, hi = np.searchsorted(owner, [of, of + 1])
        out[lo:hi] = load(data)[what]
    return out


def train(ranges: DataFrame, model: Model, seed: int, burn_in: int, samples: int) -> list[DataFrame]:
    """The sweeps; returns the contexts' first totals, and the states and totals after each of the last ``samples``."""
    spark = ranges.sparkSession

    def sizes(batches):
        for batch in batches:
            out = []
            for data in batch["data"]:
                r = Range(load(data))
                tables, word_tables = r.first()
                seated = r.seated(tables)
                out.append((int((seated == 1).sum()), int((seated == 2).sum()), int(r.single.sum()), int((r.n == 2).sum()), float(seated.sum()), float(word_tables.sum())))
            yield pd.DataFrame(out, columns=["w1", "w2", "p1", "p2", "customers", "tables"])

    def begin(batches):
        for batch in batches:
            for q, data in zip(batch["at"], batch["data"], strict=True):
                r = Range(load(data))
                yield frame(messages(r, int(q), 0, r.first()[0]))

    w1, w2, p1, p2, customers, tables = (x or 0 for x in ranges.mapInPandas(sizes, "w1 long, w2 long, p1 long, p2 long, customers double, tables double").groupBy().sum().collect()[0])
    model.discounts, model.parents = (discount(w1, w2), discount(p1, p2)), [(customers, tables)]

    def seating(sweep: int):
        def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left):
                return frame([])
            q, r = int(left["at"].iloc[0]), Range(load(left["data"].iloc[0]))
            before = right[right["kind"] == "state"]["data"].tolist()
            tables, word_tables = (load(before[0])[k].astype(np.float64) for k in ("tables", "word_tables")) if before else r.first()
            of_context = of_contexts(r, right[right["kind"] == "totals"], "tables")
            tables, word_tables = r.sweep(model, tables, word_tables, of_context, np.random.default_rng([seed, sweep, q]))
            sizes = np.array([r.seated(tables).sum(), word_tables.sum()])
            return frame([("state", q, -1, sweep, dump(tables=tables.astype(np.int64), word_tables=word_tables.astype(np.int64))), ("sizes", q, -1, sweep, sizes.tobytes()), *messages(r, q, sweep, tables)])

        return run

    def total(batches):
        for batch in batches:
            both = np.array([np.frombuffer(x, np.float64) for x in batch["data"]]).reshape(-1, 2)
            yield pd.DataFrame({"customers": both[:, 0], "tables": both[:, 1]})

    state, sums = None, stored(spark, ranges.mapInPandas(begin, ROW), "sums")
    kept = [totals(sums)]
    for sweep in range(1, burn_in + samples + 1):
        given = totals(sums) if state is None else totals(sums).unionByName(state)
        made = stored(spark, ranges.groupBy("at").cogroup(given.groupBy("at")).applyInPandas(seating(sweep), ROW), "sweep")
        state, sums = made.filter("kind = 'state'"), made.filter("kind = 'sums'")
        found = made.filter("kind = 'sizes'").mapInPandas(total, "customers double, tables double").groupBy().sum().collect()[0]
        model.parents.append((found[0] or 0.0, found[1] or 0.0))
        if sweep > burn_in:
            kept += [state, totals(sums)]
    return kept


def answers(ranges: DataFrame, kept: list[DataFrame], model: Model) -> DataFrame:
    """Of each range a row for each chunk: its words' counts, whether they are contexts, and averaged probabilities, as those
    of its pairs. Probabilities are 32-bit floats, so a token's log is within 3e-8 of the 64-bit one."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return frame([])
        q, r, a = int(left["at"].iloc[0]), Range(load(left["data"].iloc[0])), load(left["asked"].iloc[0])
        word, context, n = np.cumsum(a["word"]), a["context"].astype(np.int64), a["n"]
        d1, more = model.discounts[1], np.flatnonzero(n > 1)
        words, pairs = np.zeros(len(r.counts) + 1), np.zeros(len(n))
        sweeps = sorted(set(right[right["kind"] == "state"]["sweep"]))
        customers = of_contexts(r, right[right["sweep"] == 0], "customers")
        for sweep in sweeps:
            rows = right[right["sweep"] == sweep]
            state = load(rows[rows["kind"] == "state"]["data"].iloc[0])
            of_context = of_contexts(r, rows[rows["kind"] == "totals"], "tables")
            p = r.words(model, int(sweep), state["tables"], state["word_tables"])
            tables = np.minimum(n, 1).astype(np.float64)
            tables[more] = state["tables"]
            words += p / len(sweeps)
            pairs += ((n - d1 * tables) + (STRENGTH + d1 * of_context)[context] * p[word]) / (STRENGTH + customers)[context] / len(sweeps)
        counts, is_context = np.append(r.counts, 0), np.append(a["is_context"], False)
        words, pairs = words.astype(np.float32), pairs.astype(np.float32)
        out, at_word, at_pair = [], 0, 0
        for chunk, n_words, n_pairs in zip(a["chunks"].tolist(), a["words"].tolist(), a["pairs"].tolist(), strict=True):
            index = np.cumsum(a["index"][at_word : at_word + n_words], dtype=np.int64)
            out.append(("answers", chunk, q, -1, dump(counts=counts[index], context=is_context[index], words=words[index], pairs=pairs[a["pair"][at_pair : at_pair + n_pairs]])))
            at_word, at_pair = at_word + n_words, at_pair + n_pairs
        return frame(out)

    given = kept[0]
    for more in kept[1:]:
        given = given.unionByName(more)
    return ranges.groupBy("at").cogroup(given.groupBy("at")).applyInPandas(run, ROW)


def score_documents(docs: DataFrame, seed: int = 5, min_context: int = MIN_CONTEXT, burn_in: int = BURN_IN, samples: int = SAMPLES) -> DataFrame:
    """Columns ``SCORES`` for each row of ``docs`` (``doc_id, text``)."""
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length("text"))).collect()[0][0] or 0
    ranges = max(8, math.ceil(chars / RANGE_CHARS))
    chunks = bucketed(spark, cut(docs, ranges), "chunks", min(4096, max(8, 2 * math.ceil(chars / CHUNK_CHARS))))
    tokens = chunks.select("at", "data")
    known = stored(spark, counted(chunks.select("at", F.explode("words").alias("w")).select("at", "w.of", "w.data"), min_context), "counts")
    model = Model()

    def sizes(batches):
        for batch in batches:
            counts = [load(x)["counts"] for x in batch["data"]]
            yield pd.DataFrame({"n": [int(c.sum()) for c in counts], "v": [len(c) for c in counts]})

    model.n, model.v = (x or 0 for x in known.filter("kind = 'range'").mapInPandas(sizes, "n long, v long").groupBy().sum().collect()[0])
    pairs = pairs_of(tokens, known.filter("kind = 'counts'"))
    both = bucketed(spark, ranged(known.filter("kind = 'range'"), pairs), "ranges", min(4096, ranges))
    kept = train(both.select("at", "data"), model, seed, burn_in, samples)
    found = answers(both, kept, model)
    n, v = model.n, model.v

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a = load(left["data"].iloc[0])
        parts = [load(x) for x in right.sort_values("of")["data"]]
        joined = lambda name: np.concatenate([p[name] for p in parts])
        chunk, counts = Chunk(a, joined("context")), joined("counts")
        pair_logs = np.log10(joined("pairs").astype(np.float64))
        if len(chunk.keys) != len(pair_logs):
            raise ValueError("a chunk's pairs changed between passes")
        token = np.log10(joined("words").astype(np.float64))[chunk.tokens]
        token[chunk.within] = pair_logs[chunk.pair]
        base = np.log10((counts + 1) / (n + v + 1))[chunk.tokens]
        seen = (counts > 0)[chunk.tokens].astype(np.int64)
        ids = pd.array([int(i) if k else None for i, k in zip(a["ids"], a["known"], strict=True)], "Int64")
        return pd.DataFrame({"doc_id": ids, "held_out": a["held"], "n_tokens": chunk.lengths, "n_known": np.add.reduceat(seen, chunk.starts), "train_tokens": n, "base_score": np.add.reduceat(base, chunk.starts), "score": np.add.reduceat(token, chunk.starts)})

    return tokens.groupBy("at").cogroup(found.groupBy("at")).applyInPandas(run, SCORES)


def perplexity(scores: DataFrame) -> DataFrame:
    """Per token, by fold: ``held_out, tokens, perplexity, base_perplexity``."""
    per = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scores.groupBy("held_out").agg(F.sum("n_tokens").alias("tokens"), per("score").alias("perplexity"), per("base_score").alias("base_perplexity"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    make_importable(spark)
    return score_documents(table(spark, sf_dir, "documents"))
