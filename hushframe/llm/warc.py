"""WARC archives compressed with Zstandard: one frame a record, the dictionary in a leading skippable frame.

Writer: each partition becomes one ``.warc.zst`` file. Its dictionary is fitted on a bounded sample (the
partition's first ``DICT_SAMPLE`` records, 64 KiB of each) and stored, itself compressed, in a
skippable frame with magic 0x184D2A5D. Equal payloads of at least ``min_revisit`` bytes are written once,
as the record with the largest id; the others become ``revisit`` records that refer to it.

Reader: loads the dictionary, decodes frame by frame from a stream, and checks that a frame holds exactly
one record, that headers are well formed, that lengths agree and that the payload's digest is right. A
fault raises ``WarcError``, or with ``on_error="report"`` becomes a row whose ``error`` says what is wrong.

Defined cases: null html counts as an empty payload; null urls give a record without target; a null id
is written as ``null`` and comes back as null; repeated rows of the largest id are all responses; empty
tables give no files and no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.common import file_system, make_importable, put_file, shared_dir, table

# The magic of the skippable frame that holds a dictionary, and of a Zstandard frame.
DICT_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
MIN_REVISIT = 1000
DICT_SAMPLE = 200
DICT_BYTES = 65_536
CHUNK = 1 << 20
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "hushframe/warc")


class WarcError(ValueError):
    """An archive that breaks the format."""


def record_urn(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, str(page_id))}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record's bytes; a revisit keeps the HTTP headers only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"X-Page-ID: {'null' if page_id is None else page_id}",
        "Content-Type: application/http;msgtype=response",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(url.splitlines()))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_urn(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_headers(data: bytes, first: bytes) -> dict[str, str]:
    lines = data.split(b"\r\n")
    if not lines[0].startswith(first):
        raise WarcError(f"starts with {lines[0][:20]!r}, not {first!r}")
    out: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"malformed header line {line[:40]!r}")
        out[name.decode("ascii", "replace").lower()] = value.strip().decode("utf-8", "replace")
    return out


def _length(headers: dict[str, str]) -> int:
    value = headers.get("content-length", "")
    if not value.isdigit():
        raise WarcError(f"Content-Length is {value!r}")
    return int(value)


def parse_record(data: bytes) -> dict:
    """A record from one frame's bytes, checked."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    if not blank:
        raise WarcError("headers don't end")
    headers = parse_headers(head, b"WARC/1.")
    missing = [k for k in ("warc-type", "warc-record-id", "warc-date", "content-length") if k not in headers]
    if missing:
        raise WarcError(f"no {', '.join(missing)}")
    n = _length(headers)
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length is {n}, the frame holds {len(rest) - 4} bytes and its end")
    http_head, blank, payload = rest[:n].partition(b"\r\n\r\n")
    if not blank:
        raise WarcError("HTTP headers don't end")
    http = parse_headers(http_head, b"HTTP/1.")
    kind, stated = headers["warc-type"], _length(http)
    if kind not in ("response", "revisit"):
        raise WarcError(f"unknown type {kind!r}")
    name, _, coded = headers.get("warc-payload-digest", "").partition(":")
    try:
        digest = base64.b32decode(coded).hex()
    except ValueError as e:
        raise WarcError("payload digest isn't base32") from e
    if name != "sha1" or len(digest) != 40:
        raise WarcError("no SHA-1 payload digest")
    if kind == "response" and (len(payload) != stated or hashlib.sha1(payload).hexdigest() != digest):
        raise WarcError("payload differs from its length or digest")
    if kind == "revisit" and (payload or not headers.get("warc-refers-to")):
        raise WarcError("a revisit has a payload, or refers to nothing")
    number = lambda x: None if x in (None, "null") else int(x)
    return {"page_id": number(headers.get("x-page-id")), "url": headers.get("warc-target-uri"), "record_type": kind, "payload_bytes": stated, "payload_digest": digest, "refers_to": number(headers.get("x-refers-to-page-id")) if kind == "revisit" else None, "payload": payload if kind == "response" else None}


def read_frames(source) -> Iterator[bytes]:
    """The content of each frame of a stream; the dictionary in front, if there is one, is used for all."""
    import zstandard

    data = source.read(CHUNK)
    dictionary = None
    if len(data) >= 8 and struct.unpack("<I", data[:4])[0] == DICT_MAGIC:
        size = struct.unpack("<I", data[4:8])[0]
        while len(data) < 8 + size:
            more = source.read(CHUNK)
            if not more:
                raise WarcError("the dictionary's frame is cut off")
            data += more
        raw, data = data[8 : 8 + size], data[8 + size :]
        if raw[:4] == struct.pack("<I", FRAME_MAGIC):
            raw = zstandard.ZstdDecompressor().decompress(raw)
        dictionary = zstandard.ZstdCompressionDict(raw)
    plain = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while True:
        if not data:
            data = source.read(CHUNK)
            if not data:
                return
        frame, parts = plain.decompressobj(), []
        while not frame.eof:
            if not data:
                data = source.read(CHUNK)
                if not data:
                    raise WarcError("a frame is cut off")
            try:
                parts.append(frame.decompress(data))
            except zstandard.ZstdError as e:
                raise WarcError(f"not a frame: {e}") from e
            data = frame.unused_data if frame.eof else b""
        yield b"".join(parts)


def write_archives(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT, level: int = 3) -> list[str]:
    """Archive ``pages`` (``page_id, url, html``); returns the files' paths, one a partition with rows."""

    def write(batches):
        import zstandard
        from pyspark import TaskContext

        first = next((b for b in batches if len(b)), None)
        if first is None:
            return
        path = f"{folder}/pages-{TaskContext.get().partitionId():06d}.warc.zst"
        whole = lambda x: None if pd.isna(x) else int(x)

        def fill(out):
            samples = [bytes(x)[:65_536] for x in first["payload"][:DICT_SAMPLE]]
            made = None
            if sum(map(len, samples)) > 8 * DICT_BYTES:
                try:
                    made = zstandard.train_dictionary(DICT_BYTES, samples, level=level)
                except zstandard.ZstdError:  # samples too alike or too few
                    made = None
            if made:
                raw = zstandard.ZstdCompressor(level=19).compress(made.as_bytes())
                out.write(struct.pack("<II", DICT_MAGIC, len(raw)) + raw)
            packer, batch = zstandard.ZstdCompressor(level=level, dict_data=made, write_checksum=True) if made else zstandard.ZstdCompressor(level=level, write_checksum=True), first
            while batch is not None:
                for page_id, url, payload, digest, refers in zip(batch["page_id"], batch["url"], batch["payload"], batch["digest"], batch["refers_to"], strict=True):
                    out.write(packer.compress(build_record(whole(page_id), url, bytes(payload), digest, whole(refers))))
                batch = next(batches, None)

        put_file(path, fill)
        yield pd.DataFrame({"path": [path]})

    payload = F.coalesce("html", F.lit("")).cast("binary")
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha1(payload).alias("digest"))
    large = full.filter(F.octet_length("payload") >= min_revisit).select("page_id", "digest")
    first = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    again = large.join(first, "digest").filter("page_id < refers_to or (page_id is null and refers_to is not null)").distinct()
    rows = full.alias("f").join(again.alias("a"), F.col("f.page_id").eqNullSafe(F.col("a.page_id")) & (F.col("f.digest") == F.col("a.digest")), "left").select("f.*", "a.refers_to")
    return sorted(r["path"] for r in rows.mapInPandas(write, "path string").collect())  # one row a file


def read_archives(spark: SparkSession, paths: list[str], payloads: bool = True, on_error: str = "raise") -> DataFrame:
    """Records of archives, one row each, with ``path``, ``place`` in the file and ``error``."""

    def read(batches):
        for batch in batches:
            for path in batch["path"]:
                fs, name = file_system(path)
                out, held = [], 0
                with fs.open_input_stream(name, compression=None) as source:
                    frames, k = read_frames(source), -1
                    while True:
                        try:
                            data = next(frames, None)
                            if data is None:
                                break
                            k += 1
                            row = parse_record(data) | {"error": None}
                        except WarcError as e:
                            if on_error == "raise":
                                raise
                            row = dict.fromkeys(columns) | {"error": str(e)}
                        held += len(row["payload"] or b"") if payloads else 0
                        out.append([row[c] for c in columns] + [path, k])
                        if len(out) >= 5000 or held > 16 << 20:
                            yield frame(out)
                            out, held = [], 0
                if out:
                    yield frame(out)

    columns = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "error", *(["payload"] if payloads else [])]
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, error string," + " payload binary," * payloads + " path string, place long"
    frame = lambda out: pd.DataFrame(out, columns=[*columns, "path", "place"]).astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})
    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)), "path").mapInPandas(read, schema)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    make_importable(spark)
    paths = write_archives(table(spark, sf_dir, "pages"), shared_dir(spark, "warc"))
    return read_archives(spark, paths, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
