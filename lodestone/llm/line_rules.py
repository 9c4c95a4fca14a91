"""Quality rules with cross-document line frequency.

Base rules look at one text: words, symbols, repeated lines, repeated five-word windows. The cross-document rule hashes every
normalised line (case folded, white space joined, digits as one), counts the distinct documents of a host that have it, removes lines
above the limits, and rejects documents of which too little is left. A line is above the limits if more than MIN_DOCS documents and more
than MAX_SHARE of the host's documents have it, so that the rule behaves alike at every size of host. Documents are told apart by id:
copies of a text are documents, so that lines which only copies or mirrored pages share are removed as well.

Counting moves one small row for each distinct (host, line, document); the second count is combined before its shuffle, so that a line
that a third of all documents share is no hot key. At most 1 / MAX_SHARE x (mean lines of a text) lines of a host can lie above the
limit; this set is broadcast if it is small, else joined by a shuffle.

Defined cases. A null text has no words and fails the base rules. A null source is a host of its own. Rows without an id
count as one document, as do rows that repeat an id. Equal texts of a host have
equal verdicts. Repeated rows stay repeated; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = re.compile(r"[#*$%&|<>]")
WINDOW = 5
#: A line of more documents than this, and of more than this share of the host's documents, is boilerplate.
MIN_DOCS, MAX_SHARE = 10, 0.01
#: A document is depleted if the lines that stay have less than this share of its words. How long a text must be is a base rule's matter.
MIN_KEPT = 0.2
#: Boilerplate lines that are broadcast; more are joined by a shuffle.
BROADCAST_LINES = 500_000

_DIGITS = re.compile(r"[0-9]+")
BASE = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def line_key(line: str) -> int | None:
    """The hash of a normalised line; None for a line without words."""
    words = line.casefold().split()
    return xxhash.xxh3_64_intdigest(_DIGITS.sub("0", " ".join(words))) - (1 << 63) if words else None


def repeat_words(words: list[str]) -> int:
    """Words that lie in five-word windows found twice or more in the text, the first included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    window = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        window = window * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    order = np.sort(window)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(window, twice)
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    return int((cover.cumsum()[:-1] > 0).sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = text or ""
    words = WORDS.findall(text)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(SYMBOLS.findall(text)), dup, repeat_words(words)


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


def boilerplate(docs: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """(host, line): the lines above the limit, from all documents."""

    def lines(pieces: Iterator[dict]) -> Iterator[dict]:
        for p in pieces:
            out = {"host": [], "line": [], "doc_id": []}
            for doc_id, host, text in zip(p["doc_id"], p["source"], p["text"], strict=True):
                keys = {line_key(x) for x in (text or "").split("\n")} - {None}
                # one row without a line stands for the document itself
                out["host"] += [host] * (len(keys) + 1)
                out["line"] += [None, *keys]
                out["doc_id"] += [doc_id] * (len(keys) + 1)
            yield out

    rows = map_arrow(docs.select("doc_id", "source", "text"), lines, "host string, line long, doc_id long").distinct()
    per = cut(rows.groupBy("host", "line").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("line").isNull() | (F.col("docs") > min_docs)))
    hosts = per.filter("line is null").select(F.col("host").alias("h"), F.col("docs").alias("all_docs"))
    found = per.filter("line is not null").join(hosts, F.col("host").eqNullSafe(F.col("h")))
    return found.filter(F.col("docs") > F.lit(max_share) * F.col("all_docs")).select("host", "line")


def judge(docs: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """One row for each row of docs: base counts, base_failed, the words that stay, and kept."""
    common = cut(boilerplate(docs, min_docs, max_share))
    if common.count() <= broadcast_lines:
        return _judge_with(docs, common)
    return _judge_joined(docs, common)


def _verdict(df: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    depleted = F.col("kept_words") < F.lit(MIN_KEPT) * F.col("n_words")
    return df.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def _judge_with(docs: DataFrame, common: DataFrame) -> DataFrame:
    """One pass over the texts, with the boilerplate lines at hand in every worker."""
    by_host: dict = {}
    for host, line in common.collect():
        by_host.setdefault(host, set()).add(line)
    shared = docs.sparkSession.sparkContext.broadcast(by_host)

    def run(pieces: Iterator[dict]) -> Iterator[dict]:
        for p in pieces:
            out = {k: [] for k in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "kept_words")}
            for doc_id, host, text in zip(p["doc_id"], p["source"], p["text"], strict=True):
                counts = base_counts(text)
                bad = shared.value.get(host)
                gone = sum(len(WORDS.findall(x)) for x in (text or "").split("\n") if line_key(x) in bad) if bad else 0
                for k, v in zip(out, (doc_id, *counts, counts[0] - gone), strict=True):
                    out[k].append(v)
            yield out

    return _verdict(map_arrow(docs.select("doc_id", "source", "text"), run, BASE + ", kept_words long"))


def _judge_joined(docs: DataFrame, common: DataFrame) -> DataFrame:
    """The same where the boilerplate lines are too many to broadcast: lines with their words meet them by a shuffle."""

    def run(pieces: Iterator[dict]) -> Iterator[dict]:
        for p in pieces:
            out = {k: [] for k in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "host", "lines")}
            for doc_id, host, text in zip(p["doc_id"], p["source"], p["text"], strict=True):
                per: dict[int, int] = {}
                for x in (text or "").split("\n"):
                    if (key := line_key(x)) is not None:
                        per[key] = per.get(key, 0) + len(WORDS.findall(x))
                for k, v in zip(out, (doc_id, *base_counts(text), host, list(per.items())), strict=True):
                    out[k].append([{"line": a, "words": b} for a, b in v] if k == "lines" else v)
            yield out

    schema = BASE + ", host string, lines array<struct<line: long, words: long>>"
    rows = cut(map_arrow(docs.select("doc_id", "source", "text"), run, schema).withColumn("row", F.monotonically_increasing_id()))
    lines = rows.select("row", "host", F.explode("lines").alias("x")).select("row", "host", "x.*")
    c = common.select(F.col("host").alias("h"), F.col("line").alias("l"))
    gone = lines.join(c, F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("l"))).groupBy("row").agg(F.sum("words").alias("gone"))
    counted = rows.drop("host", "lines").join(gone, "row", "left").withColumn("kept_words", F.col("n_words") - F.coalesce("gone", F.lit(0)))
    return _verdict(counted.drop("row", "gone"))
