"""Writers: JSON lines, the Parquet export with its manifest, and result formats."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import os
import shutil
import subprocess
import uuid
from datetime import UTC, datetime

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.signals import normalize_lists
from ..operators.store import last_writes, manifests, write_sidecar
from ..schemas import EXPORT_ORDER, LIST_COLUMNS, SIGNALS_VERSION, TABLES
from ..session import shared_dir
from ..taxonomy import VERSION
from .readers import json_lines


def write_json_lines(df: DataFrame, path: str, schema_version: str = SIGNALS_VERSION, taxonomy_version: str = VERSION) -> None:
    """A directory of JSON lines written by the executors, and a sidecar with versions."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    write_sidecar(path, schema_version, taxonomy_version)


def write_single(df: DataFrame, path: str, schema_version: str = SIGNALS_VERSION, taxonomy_version: str = VERSION) -> int:
    """One local file: .jsonl as lines with a sidecar, .json as an array. Executors write the lines; the driver joins the bytes of their
    files, in order, and decodes no row."""
    parts, tmp, n = shared_dir(df.sparkSession, "lines"), f"{path}.tmp-{uuid.uuid4().hex}", 0
    df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value")).write.text(parts)
    fs, place = pafs.FileSystem.from_uri(parts)
    files = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(place)) if f.base_name.startswith("part-"))
    array = not path.endswith(".jsonl")
    with open(tmp, "wb") as out:
        out.write(b"[\n  " if array else b"")
        held = b""  # of an array the last line break, which only a further row turns into a comma
        for name in files:
            with fs.open_input_stream(name) as f:
                while piece := f.read(1 << 20):
                    n += piece.count(b"\n")
                    if array:
                        piece = held + piece
                        held = b"\n" if piece.endswith(b"\n") else b""
                        piece = piece.removesuffix(b"\n").replace(b"\n", b",\n  ")
                    out.write(piece)
        out.write(b"\n]\n" if array else b"")
    fs.delete_dir(place)
    os.replace(tmp, path)
    if not array:
        write_sidecar(path, schema_version, taxonomy_version)
    return n


def to_declared(df: DataFrame, table: str) -> DataFrame:
    """The declared columns with their types (missing ones as NULL), then whatever else there is."""
    known = {f.name: f.dataType for f in TABLES[table].fields}
    more = [c for c in df.columns if c not in known]
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in known.items()], *more)


def export(spark: SparkSession, data_dir: str, out_dir: str) -> dict:
    """Writes every table that is there as sorted, zstd-compressed Parquet, and MANIFEST.json with rows, versions and value digests.

    Part files of a sorted write cover disjoint key ranges, so that readers can prune by their statistics.
    """
    os.makedirs(out_dir, exist_ok=True)
    manifest: dict = {"schema_version": SIGNALS_VERSION, "taxonomy_version": VERSION, "tables": {}, "source_commit": _commit(data_dir), "generated_at": datetime.now(UTC).isoformat()}
    for name in TABLES:
        place = f"{data_dir}/{name}.jsonl"
        if not os.path.exists(place):
            continue
        df = normalize_lists(to_declared(json_lines(spark, place, TABLES[name]), name), [c for c in LIST_COLUMNS if c in TABLES[name].names])
        if name == "annotations":
            df = last_writes(df.withColumn("_o", F.monotonically_increasing_id()), "_o").drop("_o")
            found = sorted(r[0] or "" for r in df.select("taxonomy_version").distinct().collect())
            if len(found) > 1:
                raise ValueError(f"annotations of several taxonomy versions: {found}")
            manifest["taxonomy_version"] = found[0] if found else VERSION
        if df.isEmpty():
            continue
        order = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in EXPORT_ORDER[name]]
        target, tmp = f"{out_dir}/{name}.parquet", f"{out_dir}/.{name}-{uuid.uuid4().hex}"
        df.orderBy(*order).write.option("compression", "zstd").parquet(tmp)
        shutil.rmtree(target, ignore_errors=True)
        os.rename(tmp, target)
        written = spark.read.parquet(target)
        manifest["tables"][name] = {"row_count": written.count(), "value_sha256": value_digest(written), "files": {f: file_digest(f"{target}/{f}") for f in sorted(os.listdir(target)) if f.endswith(".parquet")}}
    with open(f"{out_dir}/MANIFEST.json", "w", encoding="utf-8") as f:
        json.dump(manifest, f, indent=2)
    return manifest


def value_digest(df: DataFrame) -> str:
    """A digest of a table's values, whatever the order and files of its rows: exact sums of row hashes of two seeds."""
    row = F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]))
    n, *sums = df.agg(F.count(F.lit(1)), *[F.sum(F.xxhash64(F.lit(s), row).cast("decimal(38,0)")) for s in (1, 2)]).first()
    return hashlib.sha256(f"{n}:{sums}".encode()).hexdigest()


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _commit(path: str) -> str | None:
    try:
        return subprocess.run(["git", "-C", path, "rev-parse", "HEAD"], capture_output=True, text=True, timeout=5).stdout.strip() or None
    except (OSError, subprocess.SubprocessError):
        return None


def refresh_manifests(spark: SparkSession, data_dir: str) -> int:
    from .readers import signals

    return write_single(manifests(signals(spark, f"{data_dir}/signals.jsonl"), datetime.now(UTC).isoformat()), f"{data_dir}/manifests.jsonl")


def format_table(rows: list[dict]) -> str:
    """Columns of the first row, padded to their longest cell, under a rule; a count of rows ends the table."""
    footer = f"({len(rows)} row{'' if len(rows) == 1 else 's'})"
    if not rows:
        return footer
    table = pd.DataFrame([{name: str(r.get(name, "")) for name in rows[0]} for r in rows])
    wide = [max(len(name), int(table[name].str.len().max())) for name in table]
    padded = [[str(x).ljust(w) for x, w in zip(cells, wide, strict=True)] for cells in [list(table), *table.itertuples(index=False)]]
    return "\n".join([" | ".join(padded[0]), "-+-".join("-" * w for w in wide), *(" | ".join(cells) for cells in padded[1:]), footer])


def format_rows(rows: list[dict], fmt: str) -> str:
    """table, json, jsonl or csv (all cells quoted, NULL as an empty cell)."""
    plain = lambda v: v.isoformat() if hasattr(v, "isoformat") else str(v)
    if fmt == "table":
        return format_table(rows)
    if fmt == "json":
        return json.dumps(rows, indent=2, ensure_ascii=False, default=plain)
    if fmt == "jsonl":
        return "\n".join(json.dumps(r, ensure_ascii=False, default=plain) for r in rows)
    if fmt == "csv":
        out = io.StringIO()
        w = csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="\n")
        if rows:
            w.writerow(list(rows[0]))
            w.writerows([["" if v is None else v for v in r.values()] for r in rows])
        return out.getvalue().rstrip("\n")
    raise ValueError(f"unknown format {fmt}")
