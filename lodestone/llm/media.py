"""Media columns: content-addressed payloads in tar shards, with rows that carry digest, offset and length.

A payload is stored as an 8-bit grey PNG of fixed width (lossless) named by the digest of the payload. Every writing task has shards
of its own in the shared folder, with names that no other attempt uses, and stores a payload once for each shard however often it
occurs there; the table of digest, shard, offset and length is written through Spark's commit protocol, so the shards of failed or
repeated attempts are never referred to. Of the places of a payload the least is its address: every row with that payload refers to it,
and the others are never read. (Choosing owners before writing would shuffle all texts, to save a payload once for each further task that
meets it.) Readers need no listing: a pass of header-only range reads, of 33 bytes for each address, fills the metadata columns, and
payloads are read back once for each address.

Defined cases. A null text is the empty text, whose payload is one row of spaces. Equal texts have equal values in every column. Repeated rows stay repeated. An empty table writes no shard. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, open_fs, shared_dir, written

#: Samples in a row of the stored picture; payloads are filled with spaces to a positive multiple of it.
WIDTH = 192
#: A shard is closed at this size.
SHARD_BYTES = 256 << 20
#: Bytes of the header that holds width, height, depth and colour type.
HEADER_BYTES = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"

INDEX = "doc_id long, n_bytes long, payload_digest string, shard string, offset long, length long"
ADDRESS = "payload_digest string, shard string, offset long, length long"
METADATA = ADDRESS + ", width long, height long, bit_depth long, color_type long"
MEDIA = METADATA + ", payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, width: int = WIDTH) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), np.uint8)
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int, int]:
    """(width, height, bit depth, colour type) from the first 33 bytes."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR" or struct.unpack(">I", head[29:33])[0] != zlib.crc32(head[12:29]):
        raise ValueError("not a media header")
    return struct.unpack(">IIBB", head[16:26])


def decode_png(data: bytes) -> np.ndarray:
    width, height, depth, color = read_header(data[:HEADER_BYTES])
    if (depth, color) != (8, 0):
        raise ValueError("not 8-bit grey")
    at, packed = HEADER_BYTES, []
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            packed.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("unexpected row filter")
    return lines[:, 1:]


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * ((-len(raw)) % WIDTH or (WIDTH if not raw else 0)), len(raw)


def feature_of(samples: np.ndarray) -> str:
    """A 64-bit average hash over an 8 x 8 grid, with the mean and spread of all samples; integers throughout."""
    h, w = samples.shape
    columns = samples.reshape(h, 8, w // 8).sum(2, dtype=np.int64)
    sums = np.concatenate([np.zeros((1, 8), np.int64), columns.cumsum(0)])
    top = np.arange(8) * h // 8
    end = np.maximum(top + 1, (np.arange(8) + 1) * h // 8)
    grid = (sums[end] - sums[top]) * 1000 // ((end - top)[:, None] * (w // 8))
    bits = (grid * 64 > grid.sum()).ravel()
    value = int("".join("1" if b else "0" for b in bits), 2)
    total, n = int(sums[-1].sum()), h * w
    squares = int(np.dot(np.bincount(samples.ravel(), minlength=256), np.arange(256, dtype=np.int64) ** 2))
    return f"{value:016x}:{total * 1000 // n}:{(squares * n - total * total) // (n * n)}"


class _Shard:
    """One tar file being written; add() gives the place of a payload's bytes."""

    def __init__(self, root: str) -> None:
        fs, path = open_fs(root)
        fs.create_dir(path, recursive=True)
        self.uri = f"{root}/shard-{uuid.uuid4().hex}.tar"
        self.out, self.at, self.places = fs.open_output_stream(f"{path}/{self.uri.rsplit('/', 1)[1]}"), 0, {}

    def add(self, digest: str, data: bytes) -> tuple[int, int]:
        info = tarfile.TarInfo(f"{digest[:2]}/{digest}.png")
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.out.write(head + data + b"\0" * (-len(data) % 512))
        self.places[digest] = place = (self.at + len(head), len(data))
        self.at += len(head) + len(data) + (-len(data) % 512)
        return place

    def close(self) -> None:
        self.out.write(b"\0" * 1024)
        self.out.close()


def store(docs: DataFrame, root: str | None = None) -> DataFrame:
    """Writes the payload of every text and returns the written index: doc_id, n_bytes, payload_digest, shard, offset, length."""
    root = root or shared_dir(docs.sparkSession, "media")

    def write(pieces: Iterator[dict]) -> Iterator[dict]:
        shard = None
        try:
            for p in pieces:
                out = {k: [] for k in ("doc_id", "n_bytes", "payload_digest", "shard", "offset", "length")}
                for doc_id, text in zip(p["doc_id"], p["text"], strict=True):
                    payload, n = payload_of(text)
                    digest = hashlib.sha256(payload).hexdigest()
                    if shard is None or shard.at > SHARD_BYTES:
                        if shard is not None:
                            shard.close()
                        shard = _Shard(root)
                    place = shard.places.get(digest) or shard.add(digest, encode_png(payload))
                    for k, v in zip(out, (doc_id, n, digest, shard.uri, *place), strict=True):
                        out[k].append(v)
                yield out
        finally:
            if shard is not None:
                shard.close()

    return written(map_arrow(docs.select("doc_id", "text"), write, INDEX), "media-index")


def addresses(index: DataFrame) -> DataFrame:
    """One row for each payload: its digest and the place that stands for it."""
    place = F.min(F.struct("shard", "offset", "length")).alias("place")
    return index.groupBy("payload_digest").agg(place).select("payload_digest", "place.*")


def in_place_order(places: DataFrame, bytes_each: int = 16 << 20) -> DataFrame:
    """The places dealt into contiguous stretches of the shards, of about so many stored bytes each."""
    total = places.agg({"length": "sum"}).first()[0] or 0
    n = max(places.sparkSession.sparkContext.defaultParallelism, -(-total // bytes_each))
    return places.repartitionByRange(n, "shard", "offset")


class _Reader:
    """Range reads, with a few files kept open."""

    def __init__(self) -> None:
        self.files: dict = {}

    def read(self, uri: str, offset: int, length: int) -> bytes:
        if uri not in self.files:
            if len(self.files) >= 32:
                self.files.pop(next(iter(self.files))).close()
            fs, path = open_fs(uri)
            self.files[uri] = fs.open_input_file(path)
        data = self.files[uri].read_at(length, offset)
        if len(data) != length:
            raise OSError(f"{uri}: {len(data)} of {length} bytes at {offset}")
        return data


def metadata(places: DataFrame) -> DataFrame:
    """The places with their metadata columns, from header-only range reads."""

    def read(pieces: Iterator[dict]) -> Iterator[dict]:
        reader = _Reader()
        for p in pieces:
            heads = [read_header(reader.read(s, o, HEADER_BYTES)) for s, o in zip(p["shard"], p["offset"], strict=True)]
            w, h, d, c = (list(x) for x in zip(*heads, strict=True)) if heads else ([], [], [], [])
            yield p | {"width": w, "height": h, "bit_depth": d, "color_type": c}

    return map_arrow(in_place_order(places), read, METADATA)


def features(places: DataFrame) -> DataFrame:
    """Reads the stored payload of every place back, and adds its digests and feature."""
    names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")

    def read(pieces: Iterator[dict]) -> Iterator[dict]:
        reader = _Reader()
        for p in pieces:
            out = {k: [] for k in names}
            for digest, shard, offset, length, width, height in zip(*(p[k] for k in ("payload_digest", "shard", "offset", "length", "width", "height")), strict=True):
                media = reader.read(shard, offset, length)
                samples = decode_png(media)
                payload = samples.tobytes()
                sha = hashlib.sha256(payload).hexdigest()
                if sha != digest or len(payload) != width * height:
                    raise OSError(f"{shard} at {offset}: the payload does not match its address")
                row = (len(payload), sha, zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(samples))
                for k, v in zip(names, row, strict=True):
                    out[k].append(v)
            yield p | out

    return map_arrow(places, read, MEDIA)


def media_columns(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: what features() says of its payload, and where and as what it is stored."""
    index = store(docs)
    described = written(metadata(addresses(index)), "media-metadata")
    read = features(in_place_order(described))
    # one row for each payload on the right: a payload that many documents share makes a long left side, which adaptive execution splits
    out = index.select("doc_id", "n_bytes", "payload_digest").join(read, "payload_digest")
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "bit_depth", "shard", "offset", "length")
