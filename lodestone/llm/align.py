"""Alignment of two tokenizers' tokens by the byte offsets where both end a token.

Python only tokenises. A block of documents becomes one row: its distinct words one behind the other, with the ids and end offsets of
both tokenizers' tokens, and for each document the numbers of its words. From there on everything is Spark functions. array_intersect of
the two arrays of ends gives the offsets where both end; the token that ends at an offset is found in an array that names for each byte
the token it belongs to (array_repeat by length, flattened), so that a look-up costs one access; sequence and transform make a group and a
link from each pair of neighbouring offsets; a document's groups and links are those of its words, and aggregate sums up its tokens. A
link joins the tokens of A and B that end at the same offset; each offset has one of either.

Words. In a text of plain Latin characters with lone spaces between them, pretokens of A end before every space and no piece of B spans
one: no piece of B has a space mark after another character (checked when the file is read), and B puts a space before what it is given.
So a word has the same ids wherever it stands, and a block's distinct words are encoded and aligned once. Another text is one word.

Counts of id pairs are sums over the blocks' words by how often they occur, partial before the shuffle. They come back to the documents
without a hot key: of the pairs that hold more than 1 / HEAVY of all links there are fewer than HEAVY, these are broadcast; the links of
all others are summed up by document and shuffled to counts that hold at most that share.

Defined cases. Texts that are null, empty, or not given back by A or B as space and text have no tokens: zeros and ''. Special tokens'
strings in a text are plain text. Repeated rows are documents of their own and count as such. An empty table gives an empty result.
Other columns are ignored. Memory is a block of BLOCK characters (by weight(), so that texts that are one word and documents without text are
bounded too), or the one text that is longer, in each task, and FILE of its rows where
blocks are written and read back: Parquet's writer gathers a file's rows, its reader takes up to 4,096 rows at a time.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import batched

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import sealed
from .bpe_stream import byte_symbols
from .common import cut, map_arrow, written

#: Characters of a block (the arrays of larger ones fill the heap faster than it is collected), and what a document counts without its text;
#: rows of a file of blocks; words that are tokenised as one text (B's time grows faster than a text's length); id pairs that can be broadcast.
BLOCK, EACH, FILE, TOGETHER, HEAVY = 1 << 18, 16, 32, 1000, 1 << 18
#: Characters on which no two versions of Unicode's tables differ; spaces at which tokens may not end; words too long for the quick path.
PLAIN, UNEVEN, LONG = re.compile(r"[\n\t -~\u00A0-\u024F]*"), ("  ", " \n", "\n ", " \t", "\t ", " \u00a0", "\u00a0 "), 500
#: How A splits a text before merging.
SPLIT_A = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

BLOCKS = "ids_a array<int>, ends_a array<int>, ids_b array<int>, ends_b array<int>, word_ends array<int>, word_a array<int>, word_b array<int>, word_times array<int>, docs array<struct<doc_id:bigint,words:array<int>>>"


class Pair:
    """Two tokenizer files: byte-level BPE (A) and sentence pieces (B), and the bytes of each id's token."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        to_byte = {c: bytes([i]) for i, c in enumerate(byte_symbols())}
        symbols = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_a = [b"".join(to_byte.get(c) or c.encode() for c in t) for t in symbols]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        self.lengths_a, self.lengths_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.by_word = not any("▁" in p.lstrip("▁") for p in pieces)
        self.quick_a = self._merging(path_a)

    def _merging(self, path_a: str):
        """A's merges in another library, several times as fast: equal where characters are plain, but its time is the square of a pretoken's length."""
        import tiktoken

        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, special = spec["model"]["vocab"], {x["id"] for x in spec["added_tokens"]}
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if made != sorted(made) or spec["normalizer"] or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError(f"{path_a}: another kind of tokenizer")
        return tiktoken.Encoding("a", pat_str=SPLIT_A, mergeable_ranks={self.bytes_a[i]: i for i in vocab.values() if i not in special}, special_tokens={})

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, bool]:
        """The ids of A for space and text, of B for the text, and whether both give the bytes back."""
        raw = " " + text
        if PLAIN.fullmatch(text) and len(max(text.split(" "), key=len)) < LONG:
            a = self.quick_a.encode_ordinary(raw)
        else:
            a = self.a.encode_batch_fast([raw], add_special_tokens=False)[0].ids
        b = self.b.encode(text, num_threads=1)
        gives = b"".join(map(self.bytes_a.__getitem__, a)) == b"".join(map(self.bytes_b.__getitem__, b)) == raw.encode()
        return np.array(a, np.int64), np.array(b, np.int64), gives

    def words_of(self, text: str) -> list[str] | None:
        """The words of a text that is cut at its spaces; None for another."""
        if not self.by_word or text[0] == " " or text[-1] == " " or not PLAIN.fullmatch(text) or any(x in text for x in UNEVEN):
            return None
        words = text.split(" ")
        return words if max(map(len, words)) < LONG else None

    def block(self, doc_ids: list, texts: list[str | None]) -> dict:
        """A row of BLOCKS."""
        number: dict[str, int] = {}
        docs, odd = [], []
        for doc_id, text in zip(doc_ids, texts, strict=True):
            words = self.words_of(text) if text else []
            if words is None:
                odd.append((len(docs), text))
            docs.append({"doc_id": doc_id, "words": [number.setdefault(w, len(number)) for w in words or ()]})
        parts = []
        for some in batched(number, TOGETHER):
            ends = np.cumsum([len(w.encode()) + 1 for w in some])
            a, b, gives = self.encode(" ".join(some))
            if not gives:
                raise ValueError("plain words that a tokenizer does not give back")
            parts.append((a, b, ends))
        for n, (at, text) in enumerate(odd, len(number)):
            a, b, gives = self.encode(text)
            parts.append((a, b, np.array([len(text.encode()) + 1])) if gives else (a[:0], b[:0], np.array([0])))
            docs[at]["words"] = [n] if gives else []
        return self._row(parts, docs)

    def _row(self, parts: list[tuple], docs: list[dict]) -> dict:
        """Parts one behind the other: ids, ends, and of each word the end and the numbers of tokens."""
        none = np.empty(0, np.int64)
        a, b = (np.concatenate([none, *[p[i] for p in parts]]) for i in (0, 1))
        starts = np.cumsum([0, *[p[2][-1] for p in parts]])
        ends = np.concatenate([none, *[p[2] + s for p, s in zip(parts, starts, strict=False)]])
        ends_a, ends_b = np.cumsum(self.lengths_a[a]), np.cumsum(self.lengths_b[b])
        counts = [np.diff(np.searchsorted(x, ends, "right"), prepend=0) for x in (ends_a, ends_b)]
        return {"ids_a": a, "ends_a": ends_a, "ids_b": b, "ends_b": ends_b, "word_ends": ends, "word_a": counts[0], "word_b": counts[1],
                "word_times": np.bincount([w for d in docs for w in d["words"]], minlength=len(ends)), "docs": docs}


@lru_cache(maxsize=2)
def _pair(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def weight(pair: Pair, text: str | None) -> int:
    """What a text adds to its block, in characters of words: more than half of a block's words repeat, another text is aligned in full."""
    return EACH + (0 if not text else len(text) if pair.words_of(text) else 2 * len(text.encode()))


def tokenised(docs: DataFrame, path_a: str, path_b: str, block: int = BLOCK) -> DataFrame:
    """Blocks of documents, tokenised by both."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        pair = _pair(path_a, path_b)
        ids, texts, size = [], [], 0
        row = lambda: {k: [v if k == "docs" else v.astype(np.int32)] for k, v in pair.block(ids, texts).items()}
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids.append(doc_id)
                texts.append(text)
                size += weight(pair, text)
                if size >= block:
                    yield row()
                    ids, texts, size = [], [], 0
        if ids:
            yield row()

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, BLOCKS)


def _numbered(ends: str):
    """For each byte the number of the stretch that it belongs to, of stretches that end at the given offsets."""
    ends = F.col(ends)
    return F.flatten(F.transform(ends, lambda end, i: F.array_repeat(i, end - F.when(i > 0, ends[i - 1]).otherwise(0))))


def _at(index: str, end):
    return F.col(index)[end - 1]


def _indices(array: str):
    return F.when(F.size(array) > 0, F.sequence(F.lit(0), F.size(array) - 1)).otherwise(F.array().cast("array<int>"))


def aligned(blocks: DataFrame) -> DataFrame:
    """Blocks with the groups (texts a1,a2|b1) and links (longs: A's id in the upper half, B's in the lower) of each of their words."""
    same = sealed(blocks.withColumn("common", F.array_intersect("ends_a", "ends_b")))
    dense = sealed(same.withColumns({"at_a": _numbered("ends_a"), "at_b": _numbered("ends_b"), "at_g": _numbered("common")}).drop("ends_a", "ends_b"))
    first = F.array(F.lit(-1))
    cuts = sealed(dense.withColumns({
        "cuts_a": F.concat(first, F.transform("common", partial(_at, "at_a"))), "cuts_b": F.concat(first, F.transform("common", partial(_at, "at_b"))),
        "word_cuts": F.concat(first, F.transform("word_ends", lambda e: F.when(e > 0, F.col("at_g")[e - 1]).otherwise(-1))),
        "text_a": F.col("ids_a").cast("array<string>"), "text_b": F.col("ids_b").cast("array<string>"),
    }).drop("at_a", "at_b", "at_g"))

    def part(texts: str, cut_at: str, k):
        i, j = F.col(cut_at)[k], F.col(cut_at)[k + 1]
        two = F.concat(F.col(texts)[j - 1], F.lit(","), F.col(texts)[j])  # one and two tokens are nearly all
        return F.when(j == i + 1, F.col(texts)[j]).when(j == i + 2, two).otherwise(F.array_join(F.slice(texts, i + 2, j - i), ","))

    group = lambda k: F.concat(part("text_a", "cuts_a", k), F.lit("|"), part("text_b", "cuts_b", k))
    link = lambda k: F.shiftleft(F.col("ids_a")[F.col("cuts_a")[k + 1]].cast("long"), 32) + F.col("ids_b")[F.col("cuts_b")[k + 1]]
    kept = ["word_cuts", "word_a", "word_b", "word_times", "docs"]
    groups = sealed(cuts.select(*kept, F.transform(_indices("common"), group).alias("groups"), F.transform(_indices("common"), link).alias("links")))
    of_word = lambda c, k: F.slice(c, F.col("word_cuts")[k] + 2, F.col("word_cuts")[k + 1] - F.col("word_cuts")[k])
    return groups.select(*kept[1:], *[F.transform(_indices("word_a"), partial(of_word, c)).alias(f"word_{c}") for c in ("groups", "links")])


def document_groups(docs: DataFrame, path_a: str, path_b: str, block: int = BLOCK) -> DataFrame:
    """A row for each document with its groups and links in full: doc_id, groups, links."""
    every = lambda c, d: F.flatten(F.transform(d["words"], lambda w: F.col(c)[w]))
    one = lambda d: F.struct(d["doc_id"].alias("doc_id"), every("word_groups", d).alias("groups"), every("word_links", d).alias("links"))
    return sealed(aligned(tokenised(docs, path_a, path_b, block))).select(F.explode(F.transform("docs", one)).alias("doc")).select("doc.*")


def _over_words(d, column: str):
    """The sum of a column of words over a document's words."""
    return F.aggregate(d["words"], F.lit(0).cast("long"), lambda n, w: n + F.col(column)[w])


def block_rows(docs: DataFrame, path_a: str, path_b: str, block: int = BLOCK) -> DataFrame:
    """A written row for each block: the links of its words, how often each word occurs, and its documents with what does not depend on others."""
    words = aligned(tokenised(docs, path_a, path_b, block))
    words = sealed(words.withColumns({"word_text": F.transform("word_groups", lambda g: F.array_join(g, ";")), "word_n": F.transform("word_groups", F.size)}).drop("word_groups"))
    text = lambda d: F.array_join(F.transform(d["words"], lambda w: F.col("word_text")[w]), ";")
    one = lambda d: F.struct(
        d["doc_id"].alias("doc_id"), *[_over_words(d, f"word_{c}").alias(f"n_{c}") for c in ("a", "b", "n")],
        F.when(F.size(d["words"]) > 0, F.sha2(text(d), 256)).otherwise("").alias("groups_sha256"), d["words"].alias("words"),
    )
    rows = words.select("word_links", "word_times", F.transform("docs", one).alias("docs"))
    return written(rows.withColumn("block", F.monotonically_increasing_id()), "align-blocks", FILE)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, count, best): how many links of all documents hold an id pair, and whether no pair of its B id has more."""
    words = blocks.select(F.explode(F.arrays_zip("word_links", "word_times")).alias("word")).select(F.col("word.word_times").alias("times"), F.explode("word.word_links").alias("pair"))
    counts = cut(words.groupBy("pair").agg(F.sum("times").alias("count")))
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b")
    most = counts.groupBy(b).agg(F.max("count").alias("most"))
    return counts.withColumn("b", b).join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))


def document_sums(blocks: DataFrame, counts: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(block, doc, n_best, count_sum): for each document by its place in its block, how many of its links are best and the sum of their counts."""
    total = counts.agg(F.sum("count")).first()[0] or 0
    often = F.col("count") * heavy > total
    of_doc = lambda d: F.flatten(F.transform(d["words"], lambda w: F.col("word_links")[w]))
    links = blocks.select("block", F.posexplode(F.transform("docs", of_doc)).alias("doc", "links")).select("block", "doc", F.explode("links").alias("pair"))
    sums = lambda df, n: df.groupBy("block", "doc").agg(F.sum(n * F.col("best")).alias("n_best"), F.sum(n * F.col("count")).alias("count_sum"))
    frequent = sums(links.join(F.broadcast(counts.filter(often)), "pair"), F.lit(1))
    seldom = links.join(F.broadcast(counts.filter(often).select("pair")), "pair", "left_anti").groupBy("block", "doc", "pair").agg(F.count(F.lit(1)).alias("times"))
    rare = sums(seldom.join(counts.filter(~often), "pair"), F.col("times"))
    return frequent.unionByName(rare).groupBy("block", "doc").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def alignments(docs: DataFrame, path_a: str, path_b: str, heavy: int = HEAVY, block: int = BLOCK) -> DataFrame:
    """A row for each document: tokens, groups, links, and what their links' counts over all documents say."""
    blocks = block_rows(docs, path_a, path_b, block)
    counts = cut(pair_counts(blocks))
    numbers = lambda d: F.struct(d["doc_id"], d["n_a"], d["n_b"], d["n_n"].alias("n_groups"), d["n_n"].alias("n_links"), d["groups_sha256"])  # noqa: E731  a link for each group
    rows = blocks.select("block", F.posexplode(F.transform("docs", numbers)).alias("doc", "row")).select("block", "doc", "row.*")
    found = rows.join(document_sums(blocks, counts, heavy), ["block", "doc"], "left").drop("block", "doc")
    return found.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")})
