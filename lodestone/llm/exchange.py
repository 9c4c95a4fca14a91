"""Exact copies by an exchange of Golomb-coded fingerprints.

A partition hashes its texts to fingerprints of log2(rows) + SPARE bits, sorts them and sends each owner (a range of fingerprints) its
part as gaps in Golomb code: some two bytes a document. The owner decodes what all partitions sent and answers each with a bitmap: which
of its fingerprints another partition sent too. Only rows so marked, or repeated within their own partition, are suspects; their texts
alone are shuffled, grouped by digest and compared byte by byte. All other texts are read where they lie and never move.

Rows and partitions. The second pass over the texts looks its rows up by fingerprint in what its partition had sent. A row whose
fingerprint the partition never sent (input that was dealt out anew meanwhile) counts as a suspect, so that the result is exact however
the input is split. A false suspect, one in 2^SPARE, only costs a shuffle of its text: a suspect without an equal stays alone.

Size. An owner gets at most as many fingerprints of a text as there are chunks, however many copies there are; owners grow with the table.
A partition's hashes are sent in chunks of CHUNK rows. Copies are pre-aggregated by (digest, text) before the shuffle. Groups that hold more than
1 / HEAVY of all rows, of which there are fewer than HEAVY, are given to their members by a broadcast, all others by a shuffled join.
Two texts of one digest are told apart by their bytes (in clash_members) at the price of one more shuffle.

Defined cases. A null text is the empty text. Of equal texts the row with the largest doc_id stays, a null id being smaller than any;
of rows that share that id and text exactly one stays. keep_id is null if all ids of a group are. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import cut, open_fs, shared_dir, written

#: Bits of a fingerprint beyond the logarithm of the rows; hashes of a chunk; fingerprints of an owner; groups that can be broadcast.
SPARE, CHUNK, OWNED, HEAVY = 10, 1 << 22, 1 << 21, 1024

PACKET = "sender int, chunk int, owner int, n int, parameter int, quotients binary, remainders binary, repeated binary"
REPLY = "sender int, chunk int, owner int, shared binary"


def parameter_of(n: int, span: int) -> int:
    """The logarithm of the Golomb parameter for n sorted values out of a span: near 0.69 of the mean gap."""
    return max(0, int(0.69 * span / max(1, n)).bit_length() - 1)


def golomb_encode(values: np.ndarray, parameter: int) -> tuple[bytes, bytes]:
    """Gaps of sorted distinct values: quotients by 2^parameter in unary (zeros, then a one), and remainders of so many bits."""
    gaps = np.diff(values.astype(np.int64), prepend=np.int64(0))
    ends = np.cumsum((gaps >> parameter) + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, np.uint8)
    unary[ends] = 1
    bits = (gaps[:, None] >> np.arange(parameter - 1, -1, -1)) & 1
    return np.packbits(unary).tobytes(), np.packbits(bits.astype(np.uint8).ravel()).tobytes()


def golomb_decode(n: int, parameter: int, quotients: bytes, remainders: bytes) -> np.ndarray:
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(quotients, np.uint8)))[:n]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.int64) << parameter
    if parameter:
        bits = np.unpackbits(np.frombuffer(remainders, np.uint8))[: n * parameter].reshape(n, parameter)
        for i in range(parameter):
            gaps |= bits[:, i].astype(np.int64) << (parameter - 1 - i)
    return np.cumsum(gaps)


def _bits(raw: bytes | None, n: int) -> np.ndarray:
    return np.zeros(n, bool) if raw is None else np.unpackbits(np.frombuffer(raw, np.uint8))[:n].astype(bool)


def packets_of(hashes: np.ndarray, bits: int, owner_bits: int, sender: int, chunk: int) -> Iterator[dict]:
    """A chunk's fingerprints, sorted and coded, one packet for each owner that has any."""
    values, counts = np.unique(hashes, return_counts=True)
    owners = values >> (bits - owner_bits)
    span = 1 << (bits - owner_bits)
    at = np.flatnonzero(np.diff(owners, prepend=-1))
    for i, j in zip(at, [*at[1:], len(values)], strict=True):
        owner = int(owners[i])
        k = parameter_of(j - i, span)
        quotients, remainders = golomb_encode(values[i:j] - owner * span, k)
        repeated = counts[i:j] > 1
        yield {"sender": sender, "chunk": chunk, "owner": owner, "n": int(j - i), "parameter": k, "quotients": quotients, "remainders": remainders,
               "repeated": np.packbits(repeated).tobytes() if repeated.any() else None}


def send(texts: DataFrame, bits: int, owner_bits: int, chunk: int = CHUNK) -> DataFrame:
    """The packets of all partitions. texts: doc_id and text, never null."""
    schema = _arrow(PACKET)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        sender, number, size = 0, 0, 0

        def flush() -> pa.RecordBatch:
            rows = list(packets_of(np.concatenate(held), bits, owner_bits, sender, number))
            return pa.RecordBatch.from_pylist(rows, schema)

        for b in batches:
            if not len(b):
                continue
            sender = b.column(0)[0].as_py()
            held.append(_fingerprints(b.column(1), bits))
            size += len(b)
            if size >= chunk:
                yield flush()
                held, size, number = [], 0, number + 1
        if held:
            yield flush()

    # doc_id only for the same columns as in the second pass: a repartition below deals rows out by all columns that are read
    hashed = texts.select(F.spark_partition_id().alias("sender"), F.xxhash64("text").alias("hash"), "doc_id")
    return hashed.mapInArrow(run, PACKET)


def answer(packets: DataFrame) -> DataFrame:
    """What owners reply: for each packet that shares a fingerprint with another one, the bitmap of those that it shares."""
    schema = _arrow(REPLY)

    def own(t: pa.Table) -> pa.Table:
        p = t.to_pylist()
        values = [golomb_decode(x["n"], x["parameter"], x["quotients"], x["remainders"]) for x in p]
        _, which, counts = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
        shared, at, rows = counts[which] > 1, 0, []
        for x in p:
            mine = shared[at : at + x["n"]]
            at += x["n"]
            if mine.any():
                rows.append({"sender": x["sender"], "chunk": x["chunk"], "owner": x["owner"], "shared": np.packbits(mine).tobytes()})
        return pa.Table.from_pylist(rows, schema)

    return packets.select("sender", "chunk", "owner", "n", "parameter", "quotients", "remainders").groupBy("owner").applyInArrow(own, REPLY)


def suspects(texts: DataFrame, sent: str, replies: str, bits: int, owner_bits: int) -> DataFrame:
    """(doc_id, digest, text): the text of a suspect, null for all others."""
    schema = _arrow("doc_id long, digest binary, text string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = marked = None
        for b in batches:
            if not len(b):
                continue
            if known is None:
                known, marked = received(b.column(0)[0].as_py(), sent, replies, bits, owner_bits)
            values = _fingerprints(b.column(1), bits)
            at = np.minimum(np.searchsorted(known, values), max(0, len(known) - 1))
            clear = (known[at] == values) & ~marked[at] if len(known) else np.zeros(len(values), bool)
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(3), pc.if_else(pa.array(clear), pa.scalar(None, pa.string()), b.column(4))], schema=schema)

    rows = texts.select(F.spark_partition_id().alias("sender"), F.xxhash64("text").alias("hash"), F.col("doc_id").cast("long").alias("doc_id"), "digest", "text")
    return rows.mapInArrow(run, "doc_id long, digest binary, text string")


def received(sender: int, sent: str, replies: str, bits: int, owner_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted fingerprints that a partition sent, and which of them are suspects by its own counts or by the owners' bitmaps."""
    span = 1 << (bits - owner_bits)
    shared = {(r["chunk"], r["owner"]): r["shared"] for r in _of(replies, sender)}
    values, marks = [np.empty(0, np.int64)], [np.empty(0, bool)]
    for p in _of(sent, sender):
        values.append(golomb_decode(p["n"], p["parameter"], p["quotients"], p["remainders"]) + p["owner"] * span)
        marks.append(_bits(p["repeated"], p["n"]) | _bits(shared.get((p["chunk"], p["owner"])), p["n"]))
    values, marks = np.concatenate(values), np.concatenate(marks)
    order = np.argsort(values, kind="stable")
    return values[order], marks[order]  # a value that two chunks sent is marked in both


def _of(root: str, sender: int) -> list[dict]:
    """The rows of a partition in a table that is cut by sender."""
    fs, path = open_fs(f"{root}/sender={sender}")
    from pyarrow.fs import FileSelector

    files = [f.path for f in fs.get_file_info(FileSelector(path, allow_not_found=True)) if f.path.endswith(".parquet")]
    rows = []
    for f in files:
        with fs.open_input_file(f) as stream:
            rows += pq.ParquetFile(stream).read().to_pylist()
    return rows


def _fingerprints(hashes: pa.Array, bits: int) -> np.ndarray:
    return (hashes.to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(ddl))


def exchanged(docs: DataFrame, digest=None, spare: int = SPARE, chunk: int = CHUNK, owned: int = OWNED) -> DataFrame:
    """Every row with its digest, and its text if it is a suspect: (row, doc_id, digest, text), written to the shared folder."""
    spark, rows = docs.sparkSession, docs.count()
    bits = min(62, max(1, rows).bit_length() + spare)
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // owned)
    owner_bits = min(bits, (owners - 1).bit_length())
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select("doc_id", text.alias("text"), (digest or whole_digest)(text).alias("digest"))
    sent, replies = shared_dir(spark, "exchange-sent"), shared_dir(spark, "exchange-replies")
    send(texts.select("doc_id", "text"), bits, owner_bits, chunk).write.partitionBy("sender").parquet(sent)
    packets = spark.read.schema(StructType.fromDDL(PACKET)).parquet(sent)
    answer(packets).repartition("sender").write.partitionBy("sender").parquet(replies)
    out = written(suspects(texts, sent, replies, bits, owner_bits).withColumn("row", F.monotonically_increasing_id()), "exchange-rows")
    for path in (sent, replies):
        fs, at = open_fs(path)
        fs.delete_dir(at)
    return out


def whole_digest(text):
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _grouped(rows: DataFrame, *key: str) -> DataFrame:
    keeper = F.coalesce(F.max_by("row", "doc_id"), F.max("row"))  # max_by passes over null ids
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("size"), keeper.alias("keep_row"), F.max("doc_id").alias("keep_id"))


def exact_groups(docs: DataFrame, digest=None, **options) -> DataFrame:
    """A row for each row of docs: doc_id, keep_id, group_size, kept and the text's digest in hex."""
    n = docs.count()
    rows = exchanged(docs, digest, **options)
    suspect, lone = rows.filter("text is not null"), rows.filter("text is null")
    # the bytes are compared here: equal digests with unlike texts are several rows
    texts = _grouped(suspect, "digest", "text").select("digest", "size", "keep_row", "keep_id")
    by_digest = cut(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), *[F.max(c).alias(c) for c in ("size", "keep_row", "keep_id")]))
    verified, clash = by_digest.filter("texts = 1").drop("texts"), by_digest.filter("texts > 1").select("digest")
    heavy = F.col("size") * HEAVY > n
    members = suspect.select("row", "doc_id", "digest")
    big = members.join(F.broadcast(verified.filter(heavy)), "digest")
    rest = members.join(F.broadcast(verified.filter(heavy).select("digest")), "digest", "left_anti").join(verified.filter(~heavy), "digest")
    alone = lone.select("digest", "row", "doc_id", F.lit(1).cast("long").alias("size"), F.col("row").alias("keep_row"), F.col("doc_id").alias("keep_id"))
    names = ["digest", "row", "doc_id", "size", "keep_row", "keep_id"]
    every = alone.select(*names).unionByName(big.select(*names)).unionByName(rest.select(*names)).unionByName(clash_members(suspect, clash).select(*names))
    return every.select("doc_id", "keep_id", F.col("size").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def clash_members(suspect: DataFrame, clash: DataFrame) -> DataFrame:
    """Members of groups whose digest stands for several texts: joined by the text itself."""
    rows = suspect.join(clash, "digest", "left_semi")
    return rows.join(_grouped(rows, "digest", "text"), ["digest", "text"])


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
