"""Operators that look at one text at a time, against plain re-implementations."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from lodestone.llm import bpe_stream, line_rules, media, pii
from lodestone.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def vocab():
    return bpe_stream.Vocabulary(tokenizer_path())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def some_texts(n=60, seed=3):
    rng, out = random.Random(seed), []
    parts = ["the", "an", "ing", "tion", "'s", "'ll", " ", " ", "\n", "!", "12", "é", "É", "ß", "Σ", "İ", "漢", "😀", "é", "<|endoftext|>", "\x85", "　", "…"]
    for _ in range(n):
        out.append("".join(rng.choice(parts) for _ in range(rng.randint(0, 80))))
    return out


def test_media_round_trip(spark, hard):
    rows = {}
    for r in media.media_columns(hard).collect():
        rows.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, rows.values())) == hard.count()
    for doc in hard.collect():
        raw = (doc["text"] or "").encode()
        payload = raw + b" " * ((-len(raw)) % 192 or (192 if not raw else 0))
        r = rows[doc["doc_id"]][0]
        assert (r["width"], r["height"], r["bit_depth"]) == (192, r["payload_bytes"] // 192, 8)
        if doc["doc_id"] is not None:
            samples = np.frombuffer(payload, np.uint8).reshape(-1, 192)
            assert r["media_sha256"] == hashlib.sha256(media.encode_png(payload)).hexdigest() and r["media_bytes"] == len(media.encode_png(payload))
            assert r["feature"] == brute_feature(samples)
            with open(r["shard"].removeprefix("file://"), "rb") as f:  # the place is real
                f.seek(r["offset"])
                assert f.read(r["length"]) == media.encode_png(payload)
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    same = [tuple(r)[1:] for r in rows[6] + rows[7]]
    assert len(same) == 3 and len(set(same)) == 1


def brute_feature(samples):
    """Cell means of an 8 x 8 grid above their mean, the mean and the spread of all samples, by loops."""
    rows, (h, w) = samples.tolist(), samples.shape
    cells = []
    for i in range(8):
        top, end = i * h // 8, max(i * h // 8 + 1, (i + 1) * h // 8)
        for j in range(8):
            cells.append(sum(sum(r[j * w // 8 : (j + 1) * w // 8]) for r in rows[top:end]) * 1000 // ((end - top) * (w // 8)))
    bits = "".join("1" if c * 64 > sum(cells) else "0" for c in cells)
    flat = [v for r in rows for v in r]
    total, n = sum(flat), len(flat)
    return f"{int(bits, 2):016x}:{total * 1000 // n}:{(sum(v * v for v in flat) * n - total * total) // (n * n)}"


def test_media_has_one_address_for_each_payload(spark):
    docs = spark.createDataFrame([(i, "the same text" if i % 3 else f"text {i}") for i in range(90)], "doc_id long, text string").repartition(6)
    rows = media.media_columns(docs).collect()
    assert len(rows) == 90 and len({(r["shard"], r["offset"]) for r in rows if r["doc_id"] % 3}) == 1 and len({(r["shard"], r["offset"]) for r in rows}) == 31


def test_media_encoding_is_lossless():
    rng = np.random.default_rng(1)
    for rows in (1, 2, 9, 100):
        payload = rng.integers(0, 256, rows * 192, np.uint8).tobytes()
        data = media.encode_png(payload)
        assert media.decode_png(data).tobytes() == payload and media.read_header(data[:33])[:2] == (192, rows)
    with pytest.raises(ValueError):
        media.read_header(b"x" * 33)


def test_bpe_matches_the_library(vocab, library):
    for text in [*some_texts(), "", "!" * 3000, "字" * 2000, "don't" * 300, "x" * 3000 + "1234", "<|startoftext|>a<|endoftext|>"]:
        want = library.encode(text, add_special_tokens=False).ids
        for piece in (1 << 16, 7, 333):
            assert bpe_stream.encode(text, vocab, None, piece) == want
        d = bpe_stream.ByteDecoder(vocab.decoded, True)
        assert "".join(d.feed(want[i : i + 5]) for i in range(0, len(want), 5)) + d.end() == library.decode(want, skip_special_tokens=False)


def test_bpe_random_code_points(vocab, library):
    """Also of blocks where newer Unicode tables differ from the library's, in letters and in how marks combine."""
    rng = random.Random(17)
    points = [c for c in range(1, 0x20000) if not 0xD800 <= c < 0xE000]
    fixed = ["\u0cdc\u2063", "\u0c5c\u0afe", "\u0324\u0c3c", "\u09fe\u034d"]
    for i in range(3000):
        text = fixed[i] if i < len(fixed) else "".join(chr(rng.choice(points)) for _ in range(rng.randint(1, 6))) + rng.choice(["", "", "'re", " x"])
        want = library.encode(text, add_special_tokens=False).ids
        assert bpe_stream.encode(text, vocab, {}, rng.choice([1, 2, 3, 1 << 16])) == want, [hex(ord(c)) for c in text]


def test_bpe_lookahead_is_sufficient(vocab):
    """Tokens given off before the end of a long pretoken are those of the whole."""
    rng = random.Random(23)
    for letters in ("ab", "thein", "aeiournst"):
        word = "".join(rng.choice(letters) for _ in range(5 * vocab.lookahead))
        symbols = [*word[:-1], word[-1] + bpe_stream.END]
        assert bpe_stream.encode(word, vocab) == [vocab.ids[t] for t in bpe_stream.merge_word(symbols, vocab.rank)]


def test_bpe_streams_every_text(vocab, monkeypatch):
    fed = []
    feed = bpe_stream.StreamEncoder.feed
    monkeypatch.setattr(bpe_stream.StreamEncoder, "feed", lambda self, piece: fed.append(piece) or feed(self, piece))
    for text in ("a short text", "word " * 40_000, "x" * 200_000):
        fed.clear()
        bpe_stream.encode(text, vocab)
        assert "".join(fed) == text and max(map(len, fed)) <= bpe_stream.PIECE


def test_bpe_holds_bounded_text(vocab):
    """Of 10 MB without and with white space, never more than a piece and the window is held."""
    for piece in ("ab" * 5000, "字" * 5000, "ab cd " * 2000, "\u3000" * 10_000, "12" * 5000):
        e = bpe_stream.StreamEncoder(vocab)
        most = 0
        for _ in range(1000 if piece[0] == "a" else 50):
            e.feed(piece)
            most = max(most, len(e.raw) + len(e.text) + len(e.pending))
        assert most < 2 * (4 * e.window + len(piece))


def test_byte_decoder_round_trip(vocab):
    for text in ["grüße 漢字 😀 ok", "é" * 50]:
        ids = bpe_stream.encode(text, vocab)
        d = bpe_stream.ByteDecoder(vocab.bytes)
        assert ("".join(d.feed([i]) for i in ids) + d.end()).replace(" ", "") == bpe_stream.normalise(text).replace(" ", "")
    half = bpe_stream.ByteDecoder({0: "é".encode()[:1], 1: "é".encode()[1:], 2: b"x"})
    assert (half.feed([0]), half.feed([1]), half.feed([0]), half.feed([2]), half.feed([0]), half.end()) == ("", "é", "", "\ufffdx", "", "\ufffd")


def test_bpe_column(spark, hard, nothing, library):
    got = {r["doc_id"]: r for r in bpe_stream.encode_column(hard, tokenizer_path()).collect()}
    for doc in hard.filter("doc_id is not null").collect():
        ids = library.encode(doc["text"] or "", add_special_tokens=False).ids
        assert got[doc["doc_id"]]["n_tokens"] == len(ids) and got[doc["doc_id"]]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[doc["doc_id"]]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe_stream.encode_column(nothing, tokenizer_path()).count() == 0
    with_ids = {r["doc_id"]: r["ids"] for r in bpe_stream.encode_column(hard, tokenizer_path(), with_ids=True).collect()}
    assert with_ids[6] == library.encode("same text here for two rows\nand a line", add_special_tokens=False).ids and with_ids[0] == []


PERSONAL = "Mail a.b+c@x-y.example.com or +1 (988) 555-2485, host 10.0.0.255 not 10.0.0.256, card 4111 1111 1111 1111, no 4111 1111 1111 1112."


def test_pii_base():
    base, more = pii.find(PERSONAL)
    found = {k: [PERSONAL[a:b] for kind, a, b in base if kind == k] for k in pii.KINDS}
    assert found == {"email": ["a.b+c@x-y.example.com"], "ip": ["10.0.0.255"], "card": ["4111 1111 1111 1111"], "phone": ["+1 (988) 555-2485"]}
    assert more == []


@pytest.mark.parametrize(
    ("text", "kind", "source"),
    [
        ("write to jane [at] site [dot] org today", "email", "jane [at] site [dot] org"),
        ("write to jane.doe at site dot org today", "email", "jane.doe at site dot org"),
        ("jаne@site.org now", "email", "jаne@site.org"),
        ("ja​ne@site.org now", "email", "ja​ne@site.org"),
        ("call plus one two three four five six seven eight nine zero now", "phone", "plus one two three four five six seven eight nine zero"),
        ("card ４111 1111 1111 1111 used", "card", "４111 1111 1111 1111"),
        ("host １０.0.0.1 up", "ip", "１０.0.0.1"),
        ("write to jane at example.com today", "email", "jane at example.com"),
        ("İstanbul call plus one two three four five six seven eight nine zero", "phone", "plus one two three four five six seven eight nine zero"),
        ("host one nine two dot one six eight dot one dot one", "ip", "one nine two dot one six eight dot one dot one"),
        ("plus one four one five 555 2671", "phone", "plus one four one five 555 2671"),
        ("card four one one one 1111 1111 1111 then", "card", "four one one one 1111 1111 1111"),
        ("card four one one one 1111 1111 1111 one two", "card", "four one one one 1111 1111 1111"),
        ("jane at firma dot it", "email", "jane at firma dot it"),
    ],
)
def test_pii_disguises_map_back(text, kind, source):
    base, more = pii.find(text)
    spans = [(k, text[a:b]) for k, a, b in base + more]
    assert (kind, source) in spans


def test_pii_leaves_plain_words_alone():
    for text in ["look at the dot on the map", "one two three go", "He sat at home. Dot com is a word", "Erinst at th of dot", "Meet me at noon. Bring it.", "look at this point in time", "one two three four five six seven eight nine ten"]:
        assert pii.find(text) == ([], [])


def test_pii_base_against_the_plain_patterns():
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = lambda m: re.sub("[^0-9]", "", m[0])

    def luhn(d):
        doubled = [int(c) * 2 if i % 2 else int(c) for i, c in enumerate(reversed(d))]
        return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0

    rng = random.Random(6)
    for _ in range(20_000):
        text = "".join(rng.choice(["a", "@", "@", ".", ".", "-", "_", "1", "23", "4111", "+", " ", "b", "(", "256"]) for _ in range(rng.randint(0, 30)))
        want = [("email", m.start(), m.end()) for m in email.finditer(text)]
        want += [("ip", m.start(), m.end()) for m in ip.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
        want += [("card", m.start(), m.end()) for m in card.finditer(text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
        want += [("phone", m.start(), m.end()) for m in phone.finditer(text) if 9 <= len(digits(m)) <= 15]
        assert sorted(pii.base_spans(text)) == sorted(want), text


@pytest.mark.parametrize("text", ["x" * 1_000_000 + "@", "1" * 1_000_000 + ".", "1." * 500_000, "a@" * 500_000, "a@b." * 250_000, "a dot " * 160_000, "a at " * 200_000])
def test_pii_time_grows_with_the_text(text):
    at = time.process_time()
    pii.find(text)
    assert time.process_time() - at < 5


def test_pii_columns_and_mask(spark, hard, nothing):
    docs = spark.createDataFrame([(1, PERSONAL, 7), (2, None, 0)], "doc_id long, text string, n_chars long")
    r = {x["doc_id"]: x for x in pii.detect(docs).collect()}
    assert (r[1]["n_email"], r[1]["n_ip"], r[1]["n_card"], r[1]["n_phone"]) == (1, 1, 1, 1)
    assert r[1]["base_sha256"] == hashlib.sha256(r[1]["spans"].encode()).hexdigest() and r[2]["spans"] == ""
    m = {x["doc_id"]: x for x in pii.mask_column(docs).collect()}
    assert "<email>" in m[1]["text"] and "555" not in m[1]["text"] and m[1]["n_chars"] == len(m[1]["text"]) and m[2]["text"] is None
    assert pii.detect(hard).count() == hard.count() and pii.detect(nothing).count() == 0
    assert pii.mask_column(hard).columns == hard.columns and pii.mask_column(nothing).count() == 0


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            hit |= set(range(i, i + 5))
    lines, dup = text.split("\n"), 0
    for i, x in enumerate(lines):
        dup += bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_line_rules_base_counts():
    rng = random.Random(5)
    for _ in range(60):
        text = "".join(rng.choice(["a ", "b ", "c\n", "#", "d ", "\n", "\x85", "é "]) for _ in range(rng.randint(0, 90)))
        assert line_rules.base_counts(text) == brute_counts(text)
    assert line_rules.base_counts(None) == (0, 0, 0, 0, 0)


def host_docs(spark):
    """200 texts of one host: 60 share a line, 30 are little else, and 25 are one text."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    rows = []
    for i in range(200):
        body = " ".join(word() for _ in range(40 if i >= 30 else 2))
        rows.append((i, (("The shared line of this host that everyone has here\n" * 1) if i < 60 else "") + body, "h"))
    rows += [(1000 + i, rows[150][1], "h") for i in range(25)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_line_rules_verdicts(spark):
    docs = host_docs(spark)
    got = {r["doc_id"]: r for r in line_rules.judge(docs).collect()}
    assert all(got[i]["kept"] for i in range(30, 200) if i != 150) and not any(got[i]["kept"] for i in range(30))
    # copies are documents: the line that only they share goes, and with it all of their words
    assert not any(got[1000 + i]["kept"] for i in range(25)) and not got[150]["kept"]
    joined = {r["doc_id"]: r for r in line_rules.judge(docs, broadcast_lines=0).collect()}
    assert {k: (v["kept"], v["kept_words"]) for k, v in got.items()} == {k: (v["kept"], v["kept_words"]) for k, v in joined.items()}


def test_line_rules_hard(hard, nothing):
    rows = line_rules.judge(hard).collect()
    assert len(rows) == hard.count() and all(r["base_failed"] and not r["kept"] for r in rows if r["n_words"] < 10)
    assert line_rules.judge(nothing).count() == 0
