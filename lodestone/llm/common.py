"""What the corpus operators share: the shared folder, lineage cuts, Arrow mapping and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of the text contracts: space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(df: DataFrame) -> list[str]:
    """The names of all columns as select() takes them, whatever characters they have."""
    return [f"`{c.replace('`', '``')}`" for c in df.columns]


def schema_ddl(df: DataFrame) -> str:
    return ", ".join(f"{name} {f.dataType.simpleString()}" for name, f in zip(quoted(df), df.schema, strict=True))


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session, as in tests, may do without it."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        root = getattr(spark.sparkContext, "_lodestone_shared", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: it must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext._lodestone_shared = root
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, kept in the shared folder, so that a lost executor costs no recomputation."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str, rows_a_file: int = 0) -> DataFrame:
    """The same rows as a Parquet table in the shared folder; columnar and compressed, for wider rows than cut(). Files of at most so many rows, if that is over 0."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("maxRecordsPerFile", rows_a_file).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table of written() that nothing will read again."""
    fs, path = open_fs(df.written_to)
    fs.delete_dir(path)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[dict]], Iterable[dict]], schema: str) -> DataFrame:
    """mapInArrow with batches as dicts of Python lists, cut into pieces of about 1 MB; fn yields dicts of lists or arrays."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    parsed = _parse_datatype_string(schema)
    assert isinstance(parsed, StructType)
    arrow = to_arrow_schema(parsed)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[dict]:
            for b in batches:
                step = max(1, int(len(b) * (1 << 20) / max(1, b.nbytes)))
                for i in range(0, len(b), step):
                    part = b.slice(i, step)
                    yield {name: part.column(j).to_pylist() for j, name in enumerate(names)}

        for out in fn(pieces()):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.toDF(*[f"c{j}" for j in range(len(names))]).mapInArrow(run, parsed)  # mapInArrow takes no names that have to be quoted


def sample_share(rows: int, bound: int) -> float:
    """The share of rows that keeps a sample under its bound."""
    return 1.0 if rows <= bound else bound / rows


def hash_share(col, share: float, salt: int):
    """Rows whose salted hash falls in the given share; the same rows on every run."""
    return F.pmod(F.xxhash64(F.lit(salt), col), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))


def split_of(doc_id):
    """crc32 of the id as text, modulo 4: remainder 2 is held out from all learning of labels."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def broadcast_if_small(df: DataFrame, rows: int) -> tuple[DataFrame, bool]:
    """A cut df, marked for broadcast only if it has at most so many rows; else as it is, for a shuffled join."""
    kept = cut(df)
    small = len(kept.select(F.lit(1)).limit(rows + 1).collect()) <= rows if rows < 1000 else kept.count() <= rows
    return (F.broadcast(kept) if small else kept), small
