"""Cross-tokenizer alignment: which tokens of one tokenizer cover which tokens of another, and how often a corpus links two ids.

Both token sequences of a text spell the same bytes. Each byte gets a label: no token ends after it, one of A, one of B, or
one of each; a regular expression scans the label string, each match being a span up to the next both-label, and the
labels counted within a span say how many tokens of A and of B make one group. Within a group every label closes exactly one stretch that
one A token and one B token share, so labels are also the links.

Neither tokenizer joins what a space separates, so a text is aligned unit by unit (a word with the space before it), and
each unit once a block. A block is a bounded run of documents: a row a document with its units as indexes, and the units'
links as indexes in rows of ``PART`` entries, so that no row takes more than a document or a part does. Pair counts are summed over blocks by key, each pair's count goes back to the
blocks that hold it, and each document adds up those of its units. Pairs are shuffled once a block, never
once a document, and no table of pairs is broadcast; only the highest count of each B id is, of which there are as many as B has ids.

Defined cases: texts that are null, empty, or not spelt by both sequences byte for byte (as with U+2581, which B takes for a
space) have no tokens: zeros, and an empty digest; rows without doc_id and repeated rows count each for itself; of equally
frequent partners all count as best; no documents give no rows; extra columns are ignored. A very long text is one block of its own.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.common import make_importable, stored, table

A_FILE = "byte_bpe_50k.json"
B_FILE = "piece_bpe_32k.model"
#: A block ends when its texts reach so many characters.
BLOCK_CHARS = 4_000_000
#: Entries of a block's units, links and pairs in a row. Rows of megabytes fill the JVM's heap, as each copy of one takes whole regions of it.
PART = 25_000
#: Documents of a block that are handed to Spark at once.
DOCS = 500
#: Of aligned units, a worker keeps those of the last so many, and of as many before them, from block to block of a task.
MAX_UNITS = 100_000
#: Documents are aligned together until their texts reach so many characters.
TOGETHER = 200_000
NONE, A_END, B_END, BOTH = b".", b"a", b"b", b"="

#: Only spaces after a visible character and before something part units: there both tokenizers always end a token.
#: The space comes first in the pattern, so that it is what is looked for.
_UNITS = re.compile(r" (?<=\S )(?=.)", re.S)
_GROUP = re.compile(rb"[^=]*=")
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


class Aligned(NamedTuple):
    """What a stretch of text gives: counts, its groups as ``a1,a2|b1;a3|b2,b3``, and its links as 64-bit pairs of ids."""

    n_a: int
    n_b: int
    n_groups: int
    groups: str
    links: bytes


def label_string(a_lengths: np.ndarray, b_lengths: np.ndarray) -> bytes:
    """One label a byte: does a token of A, of B or of both end with it?"""
    a, b = np.cumsum(a_lengths), np.cumsum(b_lengths)
    labels = np.full(int(a[-1]) if len(a) else 0, NONE[0], np.uint8)
    labels[a - 1] = A_END[0]
    labels[b - 1] = np.where(labels[b - 1] == A_END[0], BOTH[0], B_END[0])
    return labels.tobytes()


def group_sizes(labels: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of A and of B in each span up to a both-label: the ends of the spans, and how many labels stand before each."""
    only = labels.translate(None, NONE)
    ends = np.cumsum(np.fromiter(map(len, _GROUP.findall(only)), np.int64))
    marks = np.frombuffer(only, np.uint8)
    return tuple(np.diff(np.cumsum(marks != other[0])[ends - 1], prepend=0) for other in (B_END, A_END))


def groups_of(labels: bytes) -> list[tuple[int, int]]:
    """The same as pairs."""
    return list(zip(*(x.tolist() for x in group_sizes(labels)), strict=True))


def links_of(labels: bytes, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each link's pair of ids and the byte that it ends with: every label closes the stretch that one token of each shares."""
    marks = np.frombuffer(labels, np.uint8)
    at = np.flatnonzero(marks != NONE[0])
    in_a, in_b = marks[at] != B_END[0], marks[at] != A_END[0]
    return (a[np.cumsum(in_a) - in_a] << 32) | b[np.cumsum(in_b) - in_b], at


class Pair:
    """The two tokenizers, with each id's bytes."""

    def __init__(self, a_path: str | None = None, b_path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path or public_tokenizers.path(A_FILE))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path or public_tokenizers.path(B_FILE))
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [x for x in range(256) if x not in visible]
        byte = {chr(x): x for x in visible} | {chr(256 + k): x for k, x in enumerate(rest)}
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            self.a_bytes[number] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := _BYTE_PIECE.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        #: An id before ``,``, ``|`` and ``;`` at 3 * id, and one and two places on.
        self.names = pa.array([f"{k}{mark}" for k in range(max(len(self.a_bytes), len(self.b_bytes))) for mark in ",|;"], pa.binary())
        self.spelling = [pa.array(x, pa.binary()) for x in (self.a_bytes, self.b_bytes)]
        #: Units may be encoded one by one only if no piece reaches over a space into what comes next.
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.by_unit = not any("▁" in p.lstrip("▁") for p in pieces)
        self.young: dict[str, Aligned | None] = {}
        self.old: dict[str, Aligned | None] = {}

    def align(self, texts: list[str]) -> list[Aligned | None]:
        """None where the sequences don't both spell a space and the text.

        Units that end visibly are aligned as one text: what is next to a unit doesn't change its tokens.
        """
        if len(texts) > 1 and any(t[-1].isspace() for t in texts):
            others = [t for t in texts if not t[-1].isspace()]
            known = iter(self.align(others) if others else [])
            return [self.align([t])[0] if t[-1].isspace() else next(known) for t in texts]
        whole = " ".join(texts)
        # without the offsets of tokens, which nothing asks for
        a, b = self.a.encode_batch_fast([" " + whole], add_special_tokens=False)[0].ids, self.b.encode(whole)
        ids_a, ids_b, spelt = np.array(a, np.int64), np.array(b, np.int64), [len(t.encode()) + 1 for t in texts]
        lengths_a, lengths_b = self.a_sizes[ids_a], self.b_sizes[ids_b]
        ends_a, ends_b, last = np.cumsum(lengths_a), np.cumsum(lengths_b), np.cumsum(spelt)
        joined = (" " + whole).encode()
        fine = all(lengths.all() and _joined(known, ids)[0] == joined for lengths, known, ids in zip((lengths_a, lengths_b), self.spelling, (ids_a, ids_b), strict=True))
        if fine:
            cuts_a, cuts_b = np.searchsorted(ends_a, last), np.searchsorted(ends_b, last)
            fine = (ends_a[cuts_a] == last).all() and (ends_b[cuts_b] == last).all()
        if not fine:
            if len(texts) == 1:
                return [None]
            step = max(1, len(texts) // 32)  # most units are still aligned together
            return [x for k in range(0, len(texts), step) for x in self.align(texts[k : k + step])]
        labels = label_string(lengths_a, lengths_b)
        links, at = links_of(labels, ids_a, ids_b)
        cuts, raw = [0, *np.searchsorted(at, last).tolist()], links.astype("<i8").tobytes()
        both = np.flatnonzero(np.frombuffer(labels, np.uint8) == BOTH[0])
        ends = np.searchsorted(both, last).tolist()
        n_a, n_b = np.diff(cuts_a + 1, prepend=0).tolist(), np.diff(cuts_b + 1, prepend=0).tolist()
        groups, starts = self._groups(ids_a, ids_b, *group_sizes(labels))
        stops = starts[cuts_a + cuts_b + 2].tolist()
        return [
            Aligned(x, y, h - g, groups[m : n - 1], raw[8 * lo : 8 * hi])
            for x, y, g, h, m, n, lo, hi in zip(n_a, n_b, [0, *ends[:-1]], ends, [0, *stops[:-1]], stops, cuts[:-1], cuts[1:], strict=True)
        ]

    def _groups(self, a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[str, np.ndarray]:
        """Groups of ``p`` tokens of A and ``q`` of B, each with ``;`` behind it, and where each token's name starts, the end last."""
        upto_a, upto_b = np.cumsum(p), np.cumsum(q)
        mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        mark_a[upto_a - 1], mark_b[upto_b - 1] = 1, 2
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.repeat(upto_b - q, p)] = 3 * a + mark_a
        order[np.arange(len(b)) + np.repeat(upto_a, q)] = 3 * b + mark_b
        spelt, starts = _joined(self.names, order)
        return spelt.decode(), starts

    def aligned(self, units: list[str]) -> list[Aligned | None]:
        """The same for different units of texts, of which those met lately are remembered."""
        young, old = self.young.get, self.old.get
        found = [young(u) or old(u) for u in units]
        if None in found:
            new = iter(self.align([u for u, f in zip(units, found, strict=True) if f is None]))
            found = [next(new) if f is None else f for f in found]
        self.young.update(zip(units, found, strict=True))
        return found

    def grow_old(self, most: int) -> None:
        """Forgets units that weren't met since the last ``most``."""
        if len(self.young) > most:
            self.old, self.young = self.young, {}

    def forget(self) -> None:
        """Forgets all units: a worker that waits for its next task holds none."""
        self.old, self.young = {}, {}


def _joined(known: pa.Array, at: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The entries of ``known`` at these places one after another, and where each starts, the end last."""
    taken = known.take(pa.array(at, pa.int64()))
    if isinstance(taken, pa.ChunkedArray):
        taken = taken.combine_chunks()
    _, offsets, data = taken.buffers()
    starts = np.frombuffer(offsets, np.int32)[taken.offset : taken.offset + len(taken) + 1]
    return (data.to_pybytes() if data else b"")[starts[0] : starts[-1]], starts - starts[0]


_pairs: dict[tuple, Pair] = {}


def pair(a_path: str | None = None, b_path: str | None = None) -> Pair:
    """One a worker process."""
    if (a_path, b_path) not in _pairs:
        _pairs[a_path, b_path] = Pair(a_path, b_path)
    return _pairs[a_path, b_path]


class _Block:
    """Documents being gathered into one row."""

    def __init__(self, tokenizers: Pair):
        self.tokenizers = tokenizers
        #: Units by number; -1 for those that can't be aligned.
        self.number: dict[str, int] = {}
        self.facts: list[Aligned] = []
        self.groups: list[str] = []
        self.docs: list[tuple] = []
        self.chars = 0

    def _register(self, units: list[str]) -> list[int]:
        """The units' numbers in this block."""
        number = self.number
        known = list(map(number.get, units))
        if None not in known:
            return known
        new = list(dict.fromkeys([u for u, k in zip(units, known, strict=True) if k is None]))
        found, first = self.tokenizers.aligned(new), len(self.facts)
        if None in found:
            number.update((u, -1) for u, facts in zip(new, found, strict=True) if facts is None)
            new, found = ([x for x, facts in zip(xs, found, strict=True) if facts is not None] for xs in (new, found))
        number.update(zip(new, range(first, first + len(new)), strict=True))
        self.facts += found
        self.groups += [facts.groups for facts in found]
        return list(map(number.__getitem__, units))

    def add(self, docs: list[tuple[int | None, str | None]]) -> None:
        units = [(_UNITS.split(t) if self.tokenizers.by_unit else [t]) if t else [] for _, t in docs]
        numbers, low = self._register(list(chain.from_iterable(units))), 0
        for (doc_id, text), mine in zip(docs, units, strict=True):
            self.chars += len(text or "")
            found, low = numbers[low : low + len(mine)], low + len(mine)
            if -1 in found:  # a unit can't be aligned by itself: ask the whole text
                found = [k for k in self._register([text]) if k >= 0]
            digest = hashlib.sha256(";".join(map(self.groups.__getitem__, found)).encode()).hexdigest() if found else ""
            self.docs.append((doc_id, digest, np.array(found, "<i4")))

    def rows(self, block: int) -> Iterator[pa.RecordBatch]:
        """A row a document; then links of each unit as indexes into the block's pairs, and how often each pair occurs, in parts."""
        used = np.concatenate([d[2] for d in self.docs])
        times = np.bincount(used, minlength=len(self.facts))
        sizes = np.fromiter((len(f.links) // 8 for f in self.facts), np.int64, len(self.facts))
        ends = np.cumsum([len(d[2]) for d in self.docs])
        counts = [np.fromiter((f[k] for f in self.facts), np.int64, len(self.facts)) for k in range(3)]
        of_docs = [np.diff(np.concatenate([[0], np.cumsum(x[used])])[ends], prepend=0) for x in (*counts, sizes)]
        for low in range(0, len(self.docs), DOCS):
            docs, these = self.docs[low : low + DOCS], slice(low, low + DOCS)
            yield _batch(block, len(docs), doc_id=[d[0] for d in docs], n_a=of_docs[0][these], n_b=of_docs[1][these], n_groups=of_docs[2][these], n_links=of_docs[3][these], digest=[d[1] for d in docs], units=[d[2].tobytes() for d in docs])
        links = np.frombuffer(b"".join(f.links for f in self.facts), "<i8")
        pairs, at = np.unique(links, return_inverse=True)
        counts = np.bincount(at, weights=np.repeat(times, sizes), minlength=len(pairs)).astype(np.int64)
        for low in range(0, max(len(sizes), len(at)), PART):  # there are no more pairs than links
            these = slice(low, low + PART)
            both = pa.StructArray.from_arrays([pa.array(pairs[these], pa.int64()), pa.array(counts[these], pa.int64())], ["pair", "n"])
            yield _batch(block, 1, at=[low], unit_links=[sizes[these].astype("<i4").tobytes()], link_pairs=[at[these].astype("<i4").tobytes()], pairs=pa.ListArray.from_arrays(pa.array([0, len(both)], pa.int32()), both))


_BLOCK = {"block": pa.int64(), "doc_id": pa.int64(), **dict.fromkeys(("n_a", "n_b", "n_groups", "n_links"), pa.int64()), "digest": pa.string(), "units": pa.binary(), "at": pa.int64(), "unit_links": pa.binary(), "link_pairs": pa.binary(), "pairs": pa.list_(pa.struct([("pair", pa.int64()), ("n", pa.int64())]))}
_BLOCK_SQL = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, digest string, units binary, at long, unit_links binary, link_pairs binary, pairs array<struct<pair: long, n: long>>"


def _batch(block: int, rows: int, **columns) -> pa.RecordBatch:
    """Rows of a block, with nulls in the columns that aren't given."""
    columns["block"] = [block] * rows
    made = [pa.nulls(rows, kind) if (x := columns.get(name)) is None else x if isinstance(x, pa.Array) else pa.array(x, kind) for name, kind in _BLOCK.items()]
    return pa.RecordBatch.from_arrays(made, list(_BLOCK))


def blocks(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, block_chars: int = BLOCK_CHARS, max_units: int = MAX_UNITS) -> DataFrame:
    """Aligned documents, block by block."""
    make_importable(docs.sparkSession)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        tokenizers = pair(a_path, b_path)
        block, waiting, chars = _Block(tokenizers), [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                waiting.append((doc_id, text.as_py()))
                chars += len(waiting[-1][1] or "")
                if chars < TOGETHER and len(waiting) < 1000:
                    continue
                block.add(waiting)
                waiting, chars = [], 0
                if block.chars >= block_chars:
                    yield from block.rows(number)
                    number += 1
                    tokenizers.grow_old(max_units)
                    block = _Block(tokenizers)
        if waiting:
            block.add(waiting)
        if block.docs:
            yield from block.rows(number)
        tokenizers.forget()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(gather, _BLOCK_SQL)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, count, best``: how many links of the corpus hold A id ``pair >> 32`` and B id ``pair & 0xffffffff``,
    and whether no other A id is linked to that B id more often."""
    each = aligned.select(F.inline("pairs"))
    counted = stored(aligned.sparkSession, each.groupBy("pair").agg(F.sum("n").alias("count")), "pairs")
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    highest = counted.groupBy(b.alias("b")).agg(F.max("count").alias("highest"))  # a row a B id: bounded by B's vocabulary
    return counted.join(F.broadcast(highest), b == F.col("b")).select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def aligned_documents(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row a document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``."""
    aligned = stored(docs.sparkSession, blocks(docs, a_path, b_path, block_chars), "aligned")
    asked = aligned.select("block", F.col("at").alias("first"), F.posexplode("pairs.pair").alias("after", "pair"))
    answers = asked.join(pair_counts(aligned), "pair").select(F.col("block").alias("of"), (F.col("first") + F.col("after")).alias("at"), "count", "best")

    def add_up(rows: pa.Table, found: pa.Table) -> pa.Table:
        """One block and its pairs' answers: all that a task holds at a time."""
        parts, rows = rows.filter(rows.column("at").is_valid()).sort_by("at"), rows.filter(rows.column("at").is_null())
        whole = lambda of, name: np.frombuffer(b"".join(of.column(name).to_pylist()), "<i4")
        at = found.column("at").to_numpy()
        counts, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        counts[at], best[at] = found.column("count").to_numpy(), found.column("best").to_numpy()
        links, sizes = whole(parts, "link_pairs"), whole(parts, "unit_links")
        unit = np.repeat(np.arange(len(sizes)), sizes)
        per_count, per_best = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        np.add.at(per_count, unit, counts[links])
        np.add.at(per_best, unit, best[links])
        used, ends = whole(rows, "units"), np.cumsum(pc.binary_length(rows.column("units")).to_numpy()) // 4
        bests, totals = (np.diff(np.concatenate([[0], np.cumsum(per[used])])[ends], prepend=0) for per in (per_best, per_count))
        same = [rows.column(name) for name in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
        return pa.Table.from_arrays([*same, pa.array(bests, pa.int64()), pa.array(totals, pa.int64()), rows.column("digest")], _RESULT)

    # A block at a time, however many of them a partition has: neither they nor their answers become one batch.
    met = aligned.drop("pairs").groupBy("block").cogroup(answers.groupBy("of"))
    return met.applyInArrow(add_up, ", ".join(f"{n} {'string' if n == 'groups_sha256' else 'long'}" for n in _RESULT))


_RESULT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned_documents(table(spark, sf_dir, "documents"))
