"""BPE encoding and decoding as streaming transducers with bounded lookahead.

Encoding. A merge at one place can depend on what stands to its right only through a chain of merges of ever lower rank, each of
which takes the left part of the next; sufficient_lookahead() follows these chains through the merge list once and gives the number
of symbols after which a token boundary can no longer move. Every text, of any length, goes through StreamEncoder in pieces: it keeps
only what is not stable yet. A pretoken that ends gives off its tokens; one that goes on for longer than the window gives off those
whose end lies more than the lookahead before the end of what was read. What a finished pretoken gave is remembered in a cache of
bounded size. Memory is a piece, the window and the cache, however long the text; ids and decoded bytes are hashed as they come.

Decoding. ByteDecoder is the state machine from ids to text: every id adds bytes, an unfinished UTF-8 sequence is held back, and what
can never become valid is replaced. Fed with the tokens as the file decodes them (it names no decoder, so that tokens are joined by
single spaces) it gives the library's text; fed with the bytes behind the tokens' symbols, and word ends as spaces, readable text.

Unicode. The library's tables are older than Python's in what is a letter or number and in how marks combine. Texts of the blocks that
have not changed since are normalised and cut by Python; for all others the library's own normaliser and classes are asked, once for
each character.

Defined cases. A null text is the empty text, which has no tokens; the digest of no ids is the digest of no bytes. Equal texts have
equal ids. Special tokens' strings in a text become their ids. Lone surrogates cannot occur in Spark strings. Repeated rows stay
repeated; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from .common import map_arrow

#: Characters fed at once, and words in the cache.
PIECE, CACHE = 1 << 16, 300_000
#: White space as Unicode's property has it (Python's own \s has four controls more).
SPACE = "\\t\\n\\v\\f\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
END = "</w>"

ENCODED = "n_tokens long, ids_sha256 string, decoded_sha256 string, text_sha256 string"


def byte_symbols() -> list[str]:
    """The printable symbol of each byte, by the rule of byte-level BPE: printable Latin-1 as it is, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = [""] * 256, 256
    for b in range(256):
        table[b] = chr(b) if b in plain else chr(extra)
        extra += b not in plain
    return table


_BYTES = byte_symbols()
_TO_BYTE = {s: b for b, s in enumerate(_BYTES)}


class Vocabulary:
    """A tokenizer file: ids, merges, special tokens and the pattern of pretokens."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        pretoken = spec["pre_tokenizer"]["pretokenizers"]
        steps = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if steps != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in pretoken] != ["Split", "ByteLevel"] or spec["decoder"] or model["end_of_word_suffix"] != END:
            raise ValueError(f"{path}: another kind of tokenizer")
        self.ids: dict[str, int] = dict(model["vocab"])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.ids | self.special).items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        self.pattern = regex.compile(pretoken[0]["pattern"]["Regex"].replace("\\s", SPACE))
        self.plain = pretoken[0]["pattern"]["Regex"] == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        self.runs = {k: regex.compile(p) for k, p in (("letter", r"\p{L}+"), ("other", rf"[^{SPACE}\p{{L}}\p{{N}}]+"))}
        self.lookahead = sufficient_lookahead(merges) + 1  # the end of a word is a symbol more
        self.decoded, self.bytes = self._decoded(), self._bytes()

    def _decoded(self) -> dict[int, bytes]:
        """What each id adds to the text as the file decodes it: the token behind a space."""
        return {i: b" " + t.encode() for i, t in self.tokens.items()}

    def _bytes(self) -> dict[int, bytes]:
        """What each id adds to readable text: the bytes of its symbols, with a space for the end of a word."""
        out = {}
        for t, i in self.ids.items():
            body = t.removesuffix(END)
            out[i] = bytes(_TO_BYTE[s] for s in body if s in _TO_BYTE) + (b" " if body != t else b"")
        return out | {i: t.encode() for t, i in self.special.items()}


def sufficient_lookahead(merges: list[tuple[str, str]]) -> int:
    """Symbols to the right that can still move a token boundary.

    A merge (x, y) that is possible is prevented from the right only by a merge (s, d) of lower rank, where s is y or ends y's
    derivation; for that d must stand there, which in turn depends on the right in the same way. reach[s] holds the longest such
    chain that starts with a left part s among the merges of lower rank so far.
    """
    made: dict[str, tuple[str, str]] = {}
    reach: dict[str, int] = {}
    longest = 0
    length = lambda t: len(t.replace(END, "\0"))
    for x, y in merges:
        chain, s = 0, y
        while True:
            chain = max(chain, reach.get(s, 0))
            if s not in made:
                break
            s = made[s][1]
        here = length(y) + chain
        reach[x] = max(reach.get(x, 0), here)
        longest = max(longest, here, length(x) + here)
        made.setdefault(x + y, (x, y))
    return longest


def merge_word(symbols: list[str], rank: dict[tuple[str, str], int]) -> list[str]:
    """Merges the pair of lowest rank, leftmost first, until none is left."""
    none = 1 << 40
    get = rank.get
    ranks = [get(p, none) for p in zip(symbols, symbols[1:])]  # noqa: B905
    while ranks and (best := min(ranks)) != none:
        i = ranks.index(best)
        pair = (symbols[i], symbols[i + 1])
        new = pair[0] + pair[1]
        while True:
            symbols[i : i + 2] = [new]
            del ranks[i]
            if i:
                ranks[i - 1] = get((symbols[i - 1], new), none)
            if i < len(ranks):
                ranks[i] = get((new, symbols[i + 1]), none)
            # the same pair further right goes in the same round; what the merge itself has made waits
            try:
                i = ranks.index(best, i + 1)
            except ValueError:
                break
            if (symbols[i], symbols[i + 1]) != pair:
                break
    return symbols


#: Characters outside the blocks that are alike in all Unicode tables at hand: Latin to Cyrillic, Hebrew, Arabic, Devanagari, Thai,
#: punctuation, kana, CJK, Hangul, full-width forms and the older pictographs.
_UNSETTLED = re.compile("[^\x00-\u0527\u0591-\u05ea\u0600-\u06ff\u0904-\u0939\u0e01-\u0e3a\u1e00-\u1fff\u2000-\u2064\u20a0-\u20b9\u2100-\u218b\u2190-\u23cf\u2500-\u27bf\u3000-\u3029\u3041-\u30ff\u4e00-\u9fcc\uac00-\ud7a3\uff01-\uffee\U0001f300-\U0001f64f]")
_ALIKE = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
_CLASSES = [(c, pre_tokenizers.Split(Regex(p), "removed")) for c, p in (("L", r"\p{L}"), ("N", r"\p{N}"))]
#: Stands for characters that the library takes for neither letter, number nor space.
_OTHER = "\ue000"


def normalise(text: str) -> str:
    """NFC, and each character lower-cased by itself. White space stays: pretokens have none, so that runs of it need not be joined."""
    if text.isascii():
        return text.lower()
    if _UNSETTLED.search(text):
        return _ALIKE.normalize_str(text)
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


@lru_cache(maxsize=65536)
def _shadow_of(c: str) -> str:
    """A character of the class that the library puts c in: c itself unless newer tables differ."""
    for name, split in _CLASSES:
        if not split.pre_tokenize_str(c):
            return c if regex.match(rf"\p{{{name}}}", c) else {"L": "a", "N": "1"}[name]
    return _OTHER if regex.match(r"[\p{L}\p{N}]", c) else c


def shadow(text: str) -> str:
    """The text as patterns shall see it, character by character."""
    return _UNSETTLED.sub(lambda m: _shadow_of(m[0]), text)


_SPACES = re.compile(f"[{SPACE}]+")


def _cut(text: str) -> int:
    """The last place of a text without white space before which nothing composes with what follows."""
    for i in range(len(text) - 1, 0, -1):
        c = text[i]
        if not unicodedata.combining(c) and normalise(text[i - 1] + c) == normalise(text[i - 1]) + normalise(c):
            return i
    return 0


#: The same pretokens for texts of Latin-1, where the standard library's faster patterns can name all letters and numbers.
_LATIN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\t-\r \x85\xa00-9a-zA-Z\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xc0-\xd6\xd8-\xf6\xf8-\xff]+")


def _is_latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class StreamEncoder:
    """feed() takes any piece of a text and gives the ids that have become stable; end() gives the rest, and makes ready for a new text."""

    def __init__(self, vocab: Vocabulary, cache: dict[str, tuple[int, ...]] | None = None) -> None:
        self.v, self.cache = vocab, {} if cache is None else cache
        self.window = 2 * vocab.lookahead
        longest = max(map(len, vocab.special), default=1)
        self.hold, self.specials = longest - 1, re.compile("|".join(map(re.escape, sorted(vocab.special, key=len, reverse=True)))) if vocab.special else None
        self.raw = self.text = ""
        self.going: str | None = None  # the kind of run that an unfinished pretoken goes on with
        self.pending: list[str] = []  # its symbols that are not stable yet

    def _word(self, word: str) -> tuple[int, ...]:
        """The ids of a finished pretoken, by the same transducer."""
        out = [*self._go_on(word), *self._finish()]
        if len(word) > self.window:
            return tuple(out)
        if len(self.cache) >= CACHE:
            self.cache.clear()
        got = self.cache[word] = tuple(out)  # tuples of numbers are no work for the garbage collector
        return got

    def _ids(self, tokens: Iterable[str]) -> list[int]:
        ids = self.v.ids
        return [ids[t] for t in tokens if t in ids]

    def _stable(self) -> list[int]:
        """Ids of the pending symbols' tokens that end more than the lookahead before their end."""
        tokens = merge_word(list(self.pending), self.v.rank)
        left, out = len(self.pending), []
        for t in tokens:
            if left - len(t) < self.v.lookahead:
                break
            out.append(t)
            left -= len(t)
        self.pending = self.pending[len(self.pending) - left :]
        return self._ids(out)

    def _go_on(self, part: str) -> list[int]:
        out: list[int] = []
        for i in range(0, len(part), self.window):
            piece = part[i : i + self.window]
            self.pending += piece if piece.isascii() and piece.isprintable() else [_BYTES[b] for b in piece.encode()]
            if len(self.pending) > self.window:
                out += self._stable()
        return out

    def _finish(self) -> list[int]:
        out: list[int] = []
        if self.pending:
            self.pending[-1] += END
            out = self._ids(merge_word(self.pending, self.v.rank))
        self.pending, self.going = [], None
        return out

    def _words(self, text: str) -> list[str]:
        if self.v.plain and _is_latin(text):
            return _LATIN.findall(text)
        if _UNSETTLED.search(text):
            return [text[m.start() : m.end()] for m in self.v.pattern.finditer(shadow(text))]
        return self.v.pattern.findall(text)

    def _whole(self, text: str) -> list[int]:
        """Of a stretch whose pretokens all end in it: what lies between white space, or before a special token or the end."""
        self.text += normalise(text)
        text, self.text, out = self.text, "", []
        if self.going:
            m = self.v.runs[self.going].match(shadow(text))
            if m:
                out, text = self._go_on(text[: m.end()]), text[m.end() :]
            out += self._finish()
        known, word = self.cache, self._word
        for w in self._words(text):
            out += known[w] if w in known else word(w)
        return out

    def _open(self, text: str) -> list[int]:
        """Of a stretch whose last pretoken may go on."""
        self.text += normalise(text)
        text, out, at = self.text, [], 0
        seen = shadow(text)
        if self.going:
            m = self.v.runs[self.going].match(seen)
            if m:
                out, at = self._go_on(text[: m.end()]), m.end()
            if at < len(text):
                out += self._finish()
        spans = [m.span() for m in self.v.pattern.finditer(seen, at)]
        while spans and spans[0][1] < len(text) - 2:  # what ends later, the next characters can still change: 's, 're and the like look two ahead
            w = text[slice(*spans.pop(0))]
            out += self.cache[w] if w in self.cache else self._word(w)
        self.text, seen = (text[spans[0][0] :], seen[spans[0][0] :]) if spans else ("", "")
        if len(spans) == 1 and len(self.text) > self.window:
            kind = next((k for k, p in self.v.runs.items() if p.fullmatch(seen)), None)
            if kind:
                self.going, run, self.text = kind, self.text, ""
                out += self._go_on(run)
        return out

    def feed(self, piece: str) -> list[int]:
        self.raw += piece
        out = self._specials() if self.specials else []
        at = max(self.raw.rfind(" "), self.raw.rfind("\n"))
        if at <= 0:
            at = max((m.start() for m in _SPACES.finditer(self.raw)), default=0)
        if at:
            part, self.raw = self.raw[:at], self.raw[at:]
            out += self._whole(part)
        if (m := _SPACES.match(self.raw)) and m.end() < len(self.raw):
            self.raw = self.raw[m.end() :]
            out += self._whole("")  # white space ends what went before it
        if len(self.raw) > self.window and (at := _cut(self.raw[: len(self.raw) - self.hold])):
            part, self.raw = self.raw[:at], self.raw[at:]
            out += self._open(part)
        return out

    def _specials(self) -> list[int]:
        out: list[int] = []
        while m := self.specials.search(self.raw):
            part, self.raw = self.raw[: m.start()], self.raw[m.end() :]
            out += self._whole(part)
            out.append(self.v.special[m[0]])
        return out

    def end(self) -> list[int]:
        out = self._specials() if self.specials else []
        part, self.raw = self.raw, ""
        return out + self._whole(part)


def stream(text: str, encoder: StreamEncoder, piece: int = PIECE) -> Iterator[list[int]]:
    """The ids of a text, in lists as they become stable."""
    for i in range(0, len(text), piece):
        yield encoder.feed(text[i : i + piece])
    yield encoder.end()


def encode(text: str, vocab: Vocabulary, cache: dict | None = None, piece: int = PIECE) -> list[int]:
    """All ids of a text at once."""
    return [i for ids in stream(text, StreamEncoder(vocab, cache), piece) for i in ids]


class ByteDecoder:
    """Text of the ids, of which each adds the given bytes; unknown ids add none. Bytes of an unfinished UTF-8 sequence wait."""

    def __init__(self, pieces: dict[int, bytes], joined: bool = False) -> None:
        self.pieces, self.skip = pieces, int(joined)  # tokens joined by spaces begin without one
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        get = self.pieces.get
        out = self.machine.decode(b"".join([get(i, b"") for i in ids]))
        if self.skip and out:
            out, self.skip = out[1:], 0
        return out

    def end(self) -> str:
        return self.machine.decode(b"", True)


@lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    """A worker reads a tokenizer file once."""
    return Vocabulary(path)


_caches: dict[str, dict] = {}


def digests(text: str, vocab: Vocabulary, encoder: StreamEncoder, keep: list | None = None) -> tuple[int, str, str, str]:
    """(number of ids, digests of the ids, of the library's decoded text and of the readable text), in one pass of bounded memory."""
    n, ids_hash, decoded_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256(), hashlib.sha256()
    decoded, readable = ByteDecoder(vocab.decoded, True), ByteDecoder(vocab.bytes)
    for ids in stream(text, encoder):
        if ids:
            n += len(ids)
            ids_hash.update(np.array(ids, "<u4").tobytes())
            decoded_hash.update(decoded.feed(ids).encode())
            text_hash.update(readable.feed(ids).encode())
            if keep is not None:
                keep.extend(ids)
    decoded_hash.update(decoded.end().encode())
    text_hash.update(readable.end().encode())
    return n, ids_hash.hexdigest(), decoded_hash.hexdigest(), text_hash.hexdigest()


def encode_column(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids, of the decoded and of the readable text; on demand the ids, an array in each row."""

    def run(pieces: Iterator[dict]) -> Iterator[dict]:
        vocab = load(path)
        encoder = StreamEncoder(vocab, _caches.setdefault(path, {}))
        for p in pieces:
            out = {"doc_id": p["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "text_sha256": [], "ids": []}
            for text in p["text"]:
                ids: list[int] | None = [] if with_ids else None
                row = digests(text or "", vocab, encoder, ids)
                for k, v in zip(("n_tokens", "ids_sha256", "decoded_sha256", "text_sha256"), row, strict=True):
                    out[k].append(v)
                if with_ids:
                    out["ids"].append(ids)
            yield out

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, " + ENCODED + (", ids array<int>" if with_ids else ""))
