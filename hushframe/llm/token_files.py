"""Token-ID files with Simple-8b word-aligned coding.

File: the magic ``HFS8`` and a version, then coded blocks, then a footer with the documents' ids and
token counts, the escapes and each block's byte offset, then the footer's length and the magic again.
Each 64-bit word holds a 4-bit selector and as many ids as fit at that selector's width, so a block
decodes selector by selector in whole-array steps, and any block decodes without those before it.
Values that need more than 60 bits are escaped: zero stands in the words, place and value in the footer.

Defined cases: null text counts as empty (only the end id); empty tables give no files and no rows;
repeated rows are each encoded; a null ``doc_id`` sorts first and is kept; extra columns are ignored.
"""

from __future__ import annotations

import io
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.common import file_system, make_importable, put_file, shared_dir, table
from hushframe.llm.tokens import encoder

END_ID = 2
BLOCK_IDS = 1 << 16
MAGIC = b"HFS8"
# Ids a word, and bits an id, of Simple-8b's selectors 0 to 15.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])


def bit_lengths(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values), np.uint8)
    rest = values.astype(np.uint64)
    for step in (32, 16, 8, 4, 2, 1):
        high = rest >= np.uint64(1 << step)
        out[high] += step
        rest = np.where(high, rest >> np.uint64(step), rest)
    return out + (rest > 0)


def encode_block(values: np.ndarray) -> np.ndarray:
    """64-bit words for values of at most 60 bits; zeros pad the last word."""
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64)
    padded = np.concatenate([values.astype(np.uint64), np.zeros(COUNTS[0], np.uint64)])
    bits = bit_lengths(padded)
    selector = np.full(n, 15, np.uint8)
    widest, span = bits[: n + COUNTS[0]].copy(), 1
    for s in range(15, -1, -1):  # from one id a word to 240: the longest run that fits wins
        count = int(COUNTS[s])
        while span < count:  # widest[i]: most bits in values[i : i + span]
            step = min(span, count - span)
            shifted = np.zeros_like(widest)
            shifted[:-step] = widest[step:]
            widest, span = np.maximum(widest, shifted), span + step
        selector[widest[:n] <= WIDTHS[s]] = s
    jumps, at, starts = COUNTS[selector].tolist(), 0, []
    while at < n:
        starts.append(at)
        at += jumps[at]
    starts = np.array(starts)
    chosen = selector[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen):
        if WIDTHS[s]:
            rows = np.flatnonzero(chosen == s)
            shifts = (np.arange(COUNTS[s]) * WIDTHS[s]).astype(np.uint64)
            words[rows] |= np.bitwise_or.reduce(padded[starts[rows][:, None] + np.arange(COUNTS[s])] << shifts, axis=1)
    return words


def decode_block(words: np.ndarray, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    selectors = (words >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(COUNTS[selectors])
    if ends[-1] < n or (len(ends) > 1 and ends[-2] >= n):
        raise ValueError(f"block holds {ends[-1]} ids, expected {n}")
    out = np.zeros(int(ends[-1]), np.uint64)
    for s in np.unique(selectors):
        if WIDTHS[s]:
            rows = np.flatnonzero(selectors == s)
            count, width = int(COUNTS[s]), int(WIDTHS[s])
            shifts = (np.arange(count) * width).astype(np.uint64)
            out[(ends[rows] - count)[:, None] + np.arange(count)] = (words[rows][:, None] >> shifts) & np.uint64((1 << width) - 1)
    return out[:n]


class TokenFileWriter:
    """Writes documents' ids to a stream, block by block; memory holds one block and the footer."""

    def __init__(self, out, block_ids: int = BLOCK_IDS):
        self.out, self.block_ids = out, block_ids
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []
        self.blocks: list[tuple[int, int, int]] = []
        self.escapes: list[tuple[int, int]] = []
        self.waiting: list[np.ndarray] = []
        self.held = self.n_ids = 0
        out.write(MAGIC + struct.pack("<I", 1))
        self.at = 8

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.block_ids:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting).astype(np.uint64) if self.waiting else np.zeros(0, np.uint64)
        whole = len(ids) if last else len(ids) - len(ids) % self.block_ids
        for lo in range(0, whole, self.block_ids):
            values = ids[lo : min(lo + self.block_ids, whole)].copy()
            wide = np.flatnonzero(values >> np.uint64(60))
            self.escapes += [(self.n_ids + int(k), int(values[k])) for k in wide]
            values[wide] = 0
            words = encode_block(values).astype("<u8").tobytes()
            self.out.write(words)
            self.blocks.append((self.at, len(words) // 8, len(values)))
            self.at += len(words)
            self.n_ids += len(values)
        self.waiting, self.held = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        footer = zlib.compress(json.dumps({"doc_ids": self.doc_ids, "lengths": self.lengths, "blocks": self.blocks, "escapes": self.escapes}).encode(), 1)
        self.out.write(footer + struct.pack("<QI", len(footer), zlib.crc32(footer)) + MAGIC)


class TokenFile:
    """Reads a file by its footer: documents in order, or any range of ids."""

    def __init__(self, source):
        self.source = source
        source.seek(0, io.SEEK_END)
        size = source.tell()
        source.seek(max(0, size - 16))
        tail = source.read(16)
        if len(tail) < 16 or tail[12:] != MAGIC:
            raise ValueError("not a token file")
        length, crc = struct.unpack("<QI", tail[:12])
        source.seek(size - 16 - length)
        footer = source.read(length)
        if zlib.crc32(footer) != crc:
            raise ValueError("footer is damaged")
        found = json.loads(zlib.decompress(footer))
        self.doc_ids, self.lengths, self.blocks, self.escapes = (found[k] for k in ("doc_ids", "lengths", "blocks", "escapes"))
        self.ends = np.cumsum([0, *(b[2] for b in self.blocks)])

    def block(self, k: int) -> np.ndarray:
        at, n_words, n = self.blocks[k]
        self.source.seek(at)
        out = decode_block(np.frombuffer(self.source.read(8 * n_words), "<u8"), n)
        for place, value in self.escapes:
            if self.ends[k] <= place < self.ends[k + 1]:
                out[place - self.ends[k]] = value
        return out

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        k, rest = 0, np.zeros(0, np.uint64)
        for doc_id, n in zip(self.doc_ids, self.lengths, strict=True):
            parts = [rest]
            held = len(rest)
            while held < n:
                parts.append(self.block(k))
                held += len(parts[-1])
                k += 1
            joined = np.concatenate(parts) if len(parts) > 1 else rest
            yield doc_id, joined[:n]
            rest = joined[n:]


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID) -> list[dict]:
    """Encode texts in ascending ``doc_id`` order into one file a partition; one small record a file."""

    def write(batches):
        from pyspark import TaskContext

        shard, sums = TaskContext.get().partitionId(), [0, 0]
        first = next((b for b in batches if len(b)), None)
        if first is None:
            return
        path = f"{folder}/ids-{shard:06d}.hfs8"

        def fill(out):
            ids, writer, batch = encoder(tokenizer), TokenFileWriter(out), first
            end = np.array([end_id], np.uint32)
            while batch is not None:
                for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                    writer.add(None if pd.isna(doc_id) else int(doc_id), np.concatenate([ids.encode(text), end]))
                batch = next(batches, None)
            writer.close()
            sums[:] = len(writer.lengths), writer.n_ids

        size = put_file(path, fill)
        yield pd.DataFrame({"shard": [shard], "path": [path], "n_docs": [sums[0]], "n_ids": [sums[1]], "n_bytes": [size]})

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = ordered.mapInPandas(write, "shard int, path string, n_docs long, n_ids long, n_bytes long").collect()  # one row a file
    return [r.asDict() for r in sorted(rows, key=lambda r: r["shard"])]


def read_token_files(spark: SparkSession, files: list[dict]) -> DataFrame:
    """Documents read back: ``doc_id, start, n_tokens, ids_crc32``; start counts the ids of all before."""

    def read(batches):
        for batch in batches:
            for path, start in zip(batch["path"], batch["start"], strict=True):
                fs, name = file_system(path)
                with fs.open_input_file(name) as source:
                    file, at, out = TokenFile(source), int(start), []
                    for doc_id, ids in file.documents():
                        out.append((doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        at += len(ids)
                        if len(out) == 20_000:
                            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})
                            out = []
                    if out:
                        yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    starts = np.cumsum([0, *(f["n_ids"] for f in files)]).tolist()
    listed = spark.createDataFrame([(f["path"], s) for f, s in zip(files, starts, strict=False)], "path string, start long")
    return listed.repartition(max(1, len(files)), "path").mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    make_importable(spark)
    files = write_token_files(table(spark, sf_dir, "documents"), shared_dir(spark, "ids"))
    return read_token_files(spark, files)
