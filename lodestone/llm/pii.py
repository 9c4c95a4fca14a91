"""Personal data, also where it is disguised, as spans of the source text.

Base detectors find e-mail addresses, IP addresses, payment cards and phone numbers as they are written. Their time grows with the text:
an address is looked for around each @, a number only at the start of its digits.

The deobfuscating pass runs a chain of transducers over the text: zero-width characters vanish, homoglyphs and foreign digits become
ASCII, spelled digits become digits and dots between them full stops, and at / dot disguises become @ and a full stop. Each output
character carries the source interval it stands for, so that what the same detectors find in the normalised text maps back to a span of
source characters. A run of spelled digits may hold more than an identifier: a stretch of its elements that makes a card or a phone
number counts too. Base spans always stay; a span of the deobfuscating pass is added unless a base span of its kind covers it: it may be
longer than a base span that it contains.

Defined cases. A null text is the empty text, without spans. Offsets are code points, end exclusive. Kinds may overlap one
another; base spans of one kind never do. Repeated rows stay repeated; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import map_arrow, schema_ddl

KINDS = ("email", "ip", "card", "phone")
#: An address before (read backwards) and behind its @; what is tried at the start of each run of digits.
_LOCAL, _DOMAIN = re.compile(r"[A-Za-z0-9._%+-]++"), re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        n = n * 2 if i % 2 else n
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> list[Span]:
    """The local part is all of its characters before an @ that no earlier address has; there is no other match that begins further left."""
    back, n, done, out, at = text[::-1], len(text), 0, [], text.find("@")
    while at >= 0:
        domain, local = _DOMAIN.match(text, at + 1), _LOCAL.match(back, n - at, n - done)
        if domain and local:
            out.append(("email", n - local.end(), domain.end()))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind; a match that fails its test is dropped, without another try."""
    out: list[Span] = _emails(text) if "@" in text else []
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in in_order(spans))


#: Letters of other scripts that look like ASCII letters.
_LOOKALIKES = dict(zip("асеорхуіјѕһԁԛԝкмтвнгАВЕКМНОРСТХУІЈЅαορνυικτΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aceopxyijshdqwkmtbhrABEKMHOPCTXYIJSaopvuiktABEZHIKMNOPTYX", strict=True))
#: Digits in words.
_SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_SPELLED |= {"null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9"}
_SPELLED |= {"zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9"}
_SPELLED |= {"cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9"}

#: Signs in words, words that name no host and no person, and last labels for signs that are common words.
_AT, _DOT, _POINT = ("at", "arobase", "arroba"), ("dot",), ("punkt", "point", "punto")
_NO_HOST = frozenset("a all an any another at both but each every from half her his in its last least many most my no of on one only our same some such that the their these this those what which with your der die das dem den ein eine einem jedem le la les un une ce cet cette chaque el los las una este esta".split())
_NO_NAME = frozenset("am are arrive arrived be been call called hard he her here him his is it jump laugh look looked looking me met only sat she shot stay still stop stopped stood them there they us was we were you".split())
_LAST = frozenset("com org net edu gov mil info biz io ai dev app de fr es uk eu ch nl pl ru jp cn br example test".split())

_ZERO_WIDTH = "\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff"
_STRANGE = re.compile(f"[{_ZERO_WIDTH}\u0370-\u052f\u0660-\u0669\u06f0-\u06f9\u0966-\u096f\u2000-\u200a\u2010-\u2015\u202f\u205f\u2070-\u2099\u2460-\u249b\u24b6-\u24ff\u3000\u3002\ufe50-\ufe6f\uff01-\uff61\U0001d400-\U0001d7ff\xa0\xb2\xb3\xb9]")
_NOTHING = re.compile(f"[{_ZERO_WIDTH}]")
_WORDS = "|".join(sorted(_SPELLED, key=len, reverse=True))
_SIGNS = "|".join(_DOT + _POINT)
#: Elements of runs of digits: spelled digits, figures, plus, and the word or sign between the numbers of an address.
_ELEMENT = re.compile(rf"(?<![^\W_])(?:({_WORDS})|([0-9]+)|(plus)|({_SIGNS}))(?![^\W_])|(\+)|(?<=[\w])(\.)(?=[\w])")
_GAP = re.compile(r"[\s,.-]{0,3}")
#: A run needs a spelled digit next to another element.
_RUN_HINT = re.compile(rf"(?<![^\W_])(?:{_WORDS})[\s,.-]{{1,3}}(?:{_WORDS}|[0-9]+|{_SIGNS})(?![^\W_])|(?:[0-9]|plus|\+|{_SIGNS})[\s,.-]{{0,3}}(?:{_WORDS})(?![^\W_])")
_BRACKETED = re.compile(r"\s{0,2}[\[({<]\s?(at|@|dot|\.|punkt|point|punto|arobase|arroba)\s?[\])}>]\s{0,2}", re.I)
#: An at between spaces, what may stand before it (read backwards), and the host behind it; labels are words, signs full stops or words.
_PLAIN_AT = re.compile(rf"\s(?:{'|'.join(_AT)}|@)\s|\s@|@\s", re.I)
_SIGN = rf"(?:\s?\.\s?|\s(?:{_SIGNS})\s)"
_NGIS = rf"(?:\s?\.\s?|\s(?:{'|'.join(x[::-1] for x in _DOT + _POINT)})\s)"
_BEFORE = re.compile(rf"[A-Za-z0-9_%+-]{{1,64}}+(?:{_NGIS}[A-Za-z0-9_%+-]{{1,64}}+){{0,3}}+", re.A | re.I)
_BEHIND = re.compile(rf"[A-Za-z0-9-]{{1,63}}+(?:{_SIGN}[A-Za-z0-9-]{{1,63}}+)++", re.A | re.I)
_PART = re.compile(rf"({_SIGN})", re.A | re.I)


@lru_cache(maxsize=65536)
def _plain_char(c: str) -> str:
    if _NOTHING.match(c):
        return ""
    if c in _LOOKALIKES:
        return _LOOKALIKES[c]
    if "\u2010" <= c <= "\u2015":
        return "-"
    if c in "\u3002\uff61":
        return "."
    if (n := unicodedata.decimal(c, None)) is not None:
        return str(n)
    flat = unicodedata.normalize("NFKC", c)
    return flat if flat.isascii() else c


class Tape:
    """A text whose characters carry the source interval that they stand for; None for the intervals is the identity."""

    def __init__(self, text: str, at: list[int] | None = None, to: list[int] | None = None) -> None:
        self.text, self.at, self.to = text, at, to

    def source(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.at is None else (self.at[start], self.to[end - 1])

    def replaced(self, cuts: list[tuple[int, int, str]]) -> Tape:
        """The tape with each stretch (start, end, output) rewritten; its output characters stand for all of the stretch."""
        if not cuts:
            return self
        at, to = self.at or range(len(self.text)), self.to or range(1, len(self.text) + 1)
        text, a, b, done = [], [], [], 0
        for start, end, out in cuts:
            text.append(self.text[done:start])
            a.extend(at[done:start])
            b.extend(to[done:start])
            text.append(out)
            a.extend([at[start]] * len(out))
            b.extend([to[end - 1]] * len(out))
            done = end
        text.append(self.text[done:])
        return Tape("".join(text), [*a, *at[done:]], [*b, *to[done:]])


def _homoglyphs(t: Tape) -> Tape:
    return t.replaced([(m.start(), m.end(), out) for m in _STRANGE.finditer(t.text) if (out := _plain_char(m[0])) != m[0]])


def _lower(text: str) -> str:
    """Lower case, character by character where it would change the length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


Element = tuple[int, int, str]  # start, end, output: digits, "+" or "."


def _runs(low: str) -> Iterator[list[Element]]:
    """Maximal runs of elements that only short gaps part, at least one of them a spelled digit and one more with it."""
    run: list[Element] = []
    spelled = 0
    for m in _ELEMENT.finditer(low):
        word, figure, _, sign, _, stop = m.groups()
        out = _SPELLED[word] if word else figure or ("." if sign or stop else "+")
        if run and not (run[-1][1] <= m.start() and _GAP.fullmatch(low, run[-1][1], m.start())):
            if spelled and len(run) > 1:
                yield run
            run, spelled = [], 0
        run.append((m.start(), m.end(), out))
        spelled += bool(word)
    if spelled and len(run) > 1:
        yield run


def _numbers(run: list[Element]) -> list[list[Element]]:
    """The stretches of a run that make an identifier, each as it is written into the tape: four numbers between dots, a plus with
    9 to 15 digits (as many as fit), 12 to 19 digits that pass Luhn (from the left, the longest first). They do not overlap."""
    out, i, n = [], 0, len(run)
    while i < n:
        got = _address(run, i) or _phone(run, i) or _card(run, i)
        if got:
            out.append(run[i:got])
        i = got or i + 1
    return out


def _address(run: list[Element], i: int) -> int:
    at, numbers = i, []
    while at < len(run) and len(numbers) < 4 and run[at][2].isdigit():
        number = ""
        while at < len(run) and run[at][2].isdigit() and len(number) < 4:
            number += run[at][2]
            at += 1
        numbers.append(number)
        if len(numbers) < 4:
            if at == len(run) or run[at][2] != ".":
                return 0
            at += 1
    return at if len(numbers) == 4 and all(int(x) <= 255 for x in numbers) and (i == 0 or not run[i - 1][2].isdigit()) else 0


def _phone(run: list[Element], i: int) -> int:
    if run[i][2] != "+":
        return 0
    at, digits, end = i + 1, 0, 0
    while at < len(run) and run[at][2].isdigit() and digits + len(run[at][2]) <= 15:
        digits += len(run[at][2])
        at += 1
        end = at if digits >= 9 else 0
    return end


def _card(run: list[Element], i: int) -> int:
    at, digits, end = i, "", 0
    while at < len(run) and run[at][2].isdigit() and len(digits) + len(run[at][2]) <= 19:
        digits += run[at][2]
        at += 1
        if len(digits) >= 12 and luhn(digits):
            end = at
    return end


def _spelled_digits(t: Tape) -> Tape:
    """Stretches of spelled digits that make an identifier become digits; what parts them goes, and a space sets them off."""
    low, cuts = _lower(t.text), []
    if not _RUN_HINT.search(low):
        return t
    for run in _runs(low):
        for stretch in _numbers(run):
            # figures alone are the base detectors' matter
            if all(low[a:b] == out for a, b, out in stretch):
                continue
            done = stretch[0][0]
            for k, (a, b, out) in enumerate(stretch):
                if a > done:
                    cuts.append((done, a, ""))
                first, last = k == 0 and a > 0 and low[a - 1] in "0123456789 -", k == len(stretch) - 1 and low[b : b + 1] in " -0123456789"
                cuts.append((a, b, ("\n" if first else "") + out + ("\n" if last else "")))
                done = b
    return t.replaced(cuts)


def _sign(s: str) -> str:
    return "@" if s.strip().lower() in (*_AT, "@") else "."


def _disguises(t: Tape) -> Tape:
    t = t.replaced([(m.start(), m.end(), _sign(m[1])) for m in _BRACKETED.finditer(t.text)])
    cuts, back, n, done = [], t.text[::-1], len(t.text), 0
    for m in _PLAIN_AT.finditer(t.text):
        if m.start() < done:
            continue
        behind, before = _BEHIND.match(t.text, m.end()), _BEFORE.match(back, n - m.start(), n - done)
        if not behind or not before:
            continue
        parts = _PART.split(behind[0])
        labels, signs = parts[::2], [x.strip().lower() for x in parts[1::2]]
        # from the left, as many labels as hold: a full stop with a space behind it ends sentences, and needs a known last label
        end = 0
        for k in range(1, len(labels)):
            bare = signs[k - 1] == "."
            spaced = bare and len(parts[2 * k - 1]) > 1
            known = labels[k].lower() in _LAST
            if labels[k - 1].lower() in _NO_HOST or not (known or (labels[k].isalpha() and len(labels[k]) > 1 and not spaced and signs[k - 1] not in _POINT) or not spaced and k + 1 < len(labels)):
                break
            if known or labels[k].isalpha() and len(labels[k]) > 1:
                end = k
            if known and k + 1 < len(labels) and signs[k] == "." and len(parts[2 * k + 1]) > 1:
                break
        left = n - before.end()
        if not end or before[0][::-1].lower() in _NO_NAME or m[0].strip() == "@" and left == m.start():
            continue
        cuts += [(left + p.start(), left + p.end(), ".") for p in _PART.finditer(t.text[left : m.start()])]
        cuts.append((m.start(), m.end(), "@"))
        at = m.end()
        for k in range(1, end + 1):
            at += len(labels[k - 1])
            cuts.append((at, at + len(parts[2 * k - 1]), "."))
            at += len(parts[2 * k - 1])
        done = at + len(labels[end])
        if t.text[done : done + 1] == ".":  # what follows is no part of the address
            cuts.append((done, done + 1, ".\n"))
            done += 1
    return t.replaced(cuts)


def hidden_spans(text: str, base: list[Span]) -> list[Span]:
    """Spans that only the deobfuscated text shows, in source characters, unless a base span of the kind covers them."""
    tape = Tape(text)
    if not text.isascii() and _STRANGE.search(text):
        tape = _homoglyphs(tape)
    tape = _disguises(_spelled_digits(tape))
    if tape.at is None:
        return []
    out: list[Span] = []
    by_kind: dict[str, list[Span]] = {k: [s for s in base if s[0] == k] for k in KINDS}
    for kind, a, b in in_order(base_spans(tape.text)):
        start, end = tape.source(a, b)
        known = by_kind[kind]
        # spans of a kind are in order and disjoint, so that only the last one that starts no later can cover this one
        i = bisect_right(known, start, key=lambda s: s[1])
        if not (i and known[i - 1][2] >= end) and not (out and out[-1][0] == kind and out[-1][1] <= start and end <= out[-1][2]):
            out.append((kind, start, end))
    return out


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, added spans) of a text."""
    base = base_spans(text or "")
    return base, hidden_spans(text or "", base)


def mask(text: str | None) -> str | None:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the union, under the first kind."""
    if not text:
        return text
    base, more = find(text)
    out, done, merged = [], 0, []
    for kind, a, b in in_order(base + more):
        if merged and a < merged[-1][2]:
            merged[-1] = (merged[-1][0], merged[-1][1], max(b, merged[-1][2]))
        else:
            merged.append((kind, a, b))
    for kind, a, b in merged:
        out += [text[done:a], f"<{kind}>"]
        done = b
    return "".join([*out, text[done:]])


def detect(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: counts of base spans, their digest, and all spans."""

    def run(pieces: Iterator[dict]) -> Iterator[dict]:
        for p in pieces:
            out = {k: [] for k in ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")}
            for doc_id, text in zip(p["doc_id"], p["text"], strict=True):
                base, more = find(text)
                counts = [sum(s[0] == k for s in base) for k in KINDS]
                row = (doc_id, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more))
                for k, v in zip(out, row, strict=True):
                    out[k].append(v)
            yield out

    return map_arrow(docs.select("doc_id", "text"), run, FOUND)


def mask_column(docs: DataFrame) -> DataFrame:
    """docs with masked texts and n_chars to match; a narrow pass, all columns kept."""
    from pyspark.sql import functions as F

    def run(pieces: Iterator[dict]) -> Iterator[dict]:
        for p in pieces:
            yield p | {"text": [mask(t) for t in p["text"]]}

    out = map_arrow(docs, run, schema_ddl(docs))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out
