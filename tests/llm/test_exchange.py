"""Exact copies, token alignment and spelling variants against brute force; ids and names of every kind; the pipeline's run()."""

import collections
import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import align, bpe_stream, exchange, forest, line_rules, media, mixing, pii, quality_crf, toxicity, variants
from lodestone.llm.common import table
from lodestone.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


def sql(text, **frames):
    con = duckdb.connect()
    for name, df in frames.items():
        con.register(name, df.toArrow())
    return sorted(con.execute(text).fetchall(), key=repr)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# Golomb-coded exchange -------------------------------------------------------------------------------------------------------------


def test_golomb_round_trip():
    rng = np.random.default_rng(2)
    for n, span in ((0, 10), (1, 1), (1, 1 << 40), (50, 50), (1000, 1 << 20), (300, 1 << 50), (7, 1 << 61)):
        values = np.unique(rng.integers(0, span, n))
        k = exchange.parameter_of(len(values), span)
        coded = exchange.golomb_encode(values, k)
        assert exchange.golomb_decode(len(values), k, *coded).tolist() == values.tolist()
    values = np.unique(rng.integers(0, 1 << 26, 5000))
    coded = exchange.golomb_encode(values, exchange.parameter_of(len(values), 1 << 26))
    assert sum(map(len, coded)) < 2.1 * len(values)  # against 8 bytes of a hash


def copies(spark, n=400):
    rng = random.Random(9)
    texts = ["", None, "one", "One", "one ", "é", "é", "x" * 100_000, *[f"text {rng.random()}" for _ in range(60)]]
    rows = [(i * (1 << 50) - (1 << 58), rng.choice(texts) if i % 3 else "the hot text") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(6)


@pytest.mark.parametrize("options", [{}, {"spare": 0, "chunk": 10, "owned": 5}])
def test_exact_groups(spark, options):
    docs = copies(spark)
    assert rows_of(exchange.exact_groups(docs, **options)) == sql(exchange.ORACLE_SQL, documents=docs)


def test_exact_groups_tell_texts_of_one_digest_apart(spark):
    docs = copies(spark)
    weak = exchange.exact_groups(docs, digest=lambda text: F.unhex(F.substring(F.sha2(text, 256), 1, 2))).drop("text_sha256")
    want = [r[:4] for r in sql(exchange.ORACLE_SQL, documents=docs)]
    assert rows_of(weak) == sorted(want, key=repr)


def test_only_suspects_are_shuffled(spark):
    docs = table(spark, SF, "documents")
    rows = exchange.exchanged(docs)
    n = collections.Counter(r["text"] or "" for r in docs.collect())
    assert {r["text"] for r in rows.filter("text is not null").collect()} >= {t for t, k in n.items() if k > 1}
    assert rows.filter("text is not null").count() <= sum(k for k in n.values() if k > 1) + 3 and rows.count() == docs.count()


def test_rows_that_moved_meanwhile_are_suspects(spark, tmp_path):
    """Another dealing of the rows in the second pass costs a shuffle, not a copy."""
    docs = copies(spark)
    text = F.coalesce("text", F.lit(""))
    texts = docs.select("doc_id", text.alias("text"), exchange.whole_digest(text).alias("digest"))
    sent, replies = f"file://{tmp_path}/sent", f"file://{tmp_path}/replies"
    exchange.send(texts.repartition(3, "doc_id").select("doc_id", "text"), 20, 3).write.partitionBy("sender").parquet(sent)
    exchange.answer(spark.read.parquet(sent)).repartition("sender").write.partitionBy("sender").parquet(replies)
    moved = exchange.suspects(texts.repartition(5), sent, replies, 20, 3).collect()
    n = collections.Counter(bytes(r["digest"]) for r in moved)
    assert len(moved) == 400 and all(r["text"] is not None for r in moved if n[bytes(r["digest"])] > 1)


def test_exact_groups_hard(spark, hard, nothing):
    got = exchange.exact_groups(hard).collect()
    assert len(got) == hard.count() and exchange.exact_groups(nothing).count() == 0
    assert exchange.exact_groups(nothing).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    texts = {(r["text"] or "").encode() for r in hard.collect()}
    assert {r["text_sha256"] for r in got} == {hashlib.sha256(t).hexdigest() for t in texts} and sum(r["kept"] for r in got) == len(texts)
    same = [r for r in got if r["group_size"] == 3 and r["keep_id"] == 7]
    assert sum(r["kept"] for r in same) == 1 and {r["doc_id"] for r in same} == {6, 7}  # rows 6, 6 again and 7


# Alignment -------------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def paths():
    return tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries(paths):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(paths[0]), SentencePieceProcessor(model_file=paths[1])
    a.encode_special_tokens = True
    to_byte = {c: i for i, c in enumerate(bpe_stream.byte_symbols())}

    def tokens(text):
        """Tokens of A and B as (id, bytes), by the libraries on the whole text."""
        x = [(i, bytes(to_byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        y = [b.id_to_piece(i) for i in b.encode(text)]
        y = [(b.piece_to_id(p), bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()) for p in y]
        raw = (" " + text).encode()
        return (x, y) if b"".join(t for _, t in x) == b"".join(t for _, t in y) == raw else ([], [])

    return tokens


def brute_alignment(rows, tokens):
    per, count = [], collections.Counter()
    for doc_id, text in rows:
        a, b = tokens(text) if text else ([], [])
        ends_b, at = {}, 0
        for j, (_, raw) in enumerate(b):
            at += len(raw)
            ends_b[at] = j
        groups, links, at, i0, j0 = [], [], 0, 0, 0
        for i, (_, raw) in enumerate(a):
            at += len(raw)
            if at in ends_b:
                j = ends_b[at]
                groups.append(",".join(str(x) for x, _ in a[i0 : i + 1]) + "|" + ",".join(str(y) for y, _ in b[j0 : j + 1]))
                links.append((a[i][0], b[j][0]))
                i0, j0 = i + 1, j + 1
        count.update(links)
        per.append((doc_id, len(a), len(b), groups, links))
    most = collections.Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    digest = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return sorted(((d, na, nb, len(g), digest(g), len(k), sum(count[x] == most[x[1]] for x in k), sum(count[x] for x in k)) for d, na, nb, g, k in per), key=repr)


ODD = ["the", " ", "  ", "\n", "\n\n", "é", "É ", "ß", " x", "▁", "<s>", "<|endoftext|>", "漢字", "\t", "'s", "don't ", "1234 ", "　", "́", "😀", " .", " a\nb", "\x85", "\x1c", "ing ", "AB ", "ɏ", " ", "plain words of text "]


@pytest.mark.parametrize("heavy", [align.HEAVY, 7])
def test_alignment_against_brute_force(spark, hard, paths, libraries, heavy):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(ODD) for _ in range(rng.randint(0, 14)))) for i in range(900)]
    rows += [(r["doc_id"], r["text"]) for r in hard.collect()] + [(5000 + r["doc_id"], r["text"]) for r in table(spark, SF, "documents").limit(60).collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = align.alignments(docs, *paths, heavy=heavy)
    names = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "n_links", "n_best", "count_sum"]
    assert rows_of(got.select(*names)) == brute_alignment(rows, libraries)


def test_alignment_does_not_depend_on_blocks(spark, paths, libraries):
    docs = table(spark, SF, "documents").limit(40)
    views = [rows_of(align.document_groups(docs, *paths, block=n)) for n in (1, 5000, 1 << 22)]
    assert views[0] == views[1] == views[2]
    one = align.document_groups(spark.createDataFrame([(1, "Hello wörld")], "doc_id long, text string"), *paths).first()
    a, b = libraries("Hello wörld")
    assert [int(x) for g in one["groups"] for x in g.split("|")[0].split(",")] == [i for i, _ in a] and len(one["links"]) == len(one["groups"])
    assert [int(x) for g in one["groups"] for x in g.split("|")[1].split(",")] == [i for i, _ in b]


def test_alignment_tokenises_words_in_pieces(spark, paths, libraries, monkeypatch):
    """B's time grows faster than its text; the tokens are those of the whole text."""
    text, sizes, encode = " ".join(f"w{i} {i * 7919}" for i in range(1500)), [], align.Pair.encode
    monkeypatch.setattr(align.Pair, "encode", lambda self, x: sizes.append(x.count(" ") + 1) or encode(self, x))
    row = align.Pair(*paths).block([1], [text])
    assert sum(sizes) == len(row["word_ends"]) > 2000 and max(sizes) <= 1000
    a, b = libraries(" ".join(dict.fromkeys(text.split(" "))))
    assert row["ids_a"].tolist() == [i for i, _ in a] and row["ids_b"].tolist() == [i for i, _ in b]


def test_alignment_bounds_what_a_task_holds(spark, paths):
    """Blocks by what is aligned in them, and files by blocks, since Parquet's reader takes a file's rows together."""
    sizes = lambda texts: [len(r["docs"]) for r in align.tokenised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), *paths).collect()]
    plain = ["a few plain words of a text " * 700 + "end"] * 40  # 784,120 characters
    odd = [" \u6f22\u5b57 " * 3000] * 20  # 240,000 characters, 480,000 bytes
    assert sizes(plain) == [14, 14, 12] and sizes(odd) == [6, 6, 6, 2] and sizes([""] * 40_000) == [16_384, 16_384, 7_232]
    docs = spark.createDataFrame([(i, "some words") for i in range(70)], "doc_id long, text string").coalesce(1)
    blocks = align.block_rows(docs, *paths, block=1)
    by_file = [r["count"] for r in blocks.groupBy(F.input_file_name()).count().collect()]
    assert sum(by_file) == 70 and max(by_file) <= align.FILE
    got = align.alignments(docs, *paths, block=1)
    assert got.count() == 70 and got.select("groups_sha256", "count_sum").distinct().count() == 1


def test_alignment_hard(nothing, paths):
    assert align.alignments(nothing, *paths).count() == 0


# Spelling variants -----------------------------------------------------------------------------------------------------------------


def brute_words(rows, altered=97):
    count = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % altered == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 5:
                count[w] += 1
    return {w: n for w, n in count.items() if n >= 3}


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[p + (len(a) >= len(b)) :] == b[p + (len(b) >= len(a)) :]


def brute_variants(count):
    near = {w: [x for x in count if one_apart(w, x)] for w in count}
    best = {w: min(near[w], key=lambda x: (-count[x], x)) if near[w] else None for w in count}
    form = {w: b if b and count[b] >= 2 * count[w] else None for w, b in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), count[w], len(near[w]), count[form[w]] if form[w] else None) for w in count), key=repr)


def test_variants_against_brute_force(spark, hard):
    rng = random.Random(12)
    bases = ["window", "Größe", "élève", "aabbaabb", "straße", "xxxxxxx", "ÀÉÎÕÜ", "a×b÷cde"]
    rows = []
    for i in range(700):
        w = rng.choice(bases)
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
            p = rng.randrange(len(w))
            w = w[:p] + rng.choice(["", "a", "b", w[p] + "é", "ZZ"[: rng.randint(0, 2)]]) + w[p + 1 :]
        rows.append((i if i % 5 else None, f"{w} {w.upper() if i % 3 else w}, {w}1{rng.choice(bases)}"))
    rows += [(r["doc_id"], r["text"]) for r in hard.collect()] + [(1, "x" * 3000 + " " + "abcde" * 100)] * 3 + [(2, "x" * 2999 + " " + "abcde" * 99 + "abcd")] * 7
    got = variants.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute_variants(brute_words(rows))
    assert rows_of(got) == want and sum(r[2] != r[1] for r in want if r[1]) > 0  # some chains are longer than one


def test_variants_against_sql(spark):
    docs = table(spark, SF, "documents")
    assert rows_of(variants.spelling_variants(docs)) == sql(variants.ORACLE_SQL, documents=docs.select("doc_id", "text"))


def test_roots_of_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100 + i, 40) for i in range(5)], "id long, root long")
    assert {r["root"] for r in variants.roots(links).collect()} == {40}


def test_variants_hard(hard, nothing):
    assert variants.spelling_variants(nothing).count() == 0
    assert {r["word"] for r in variants.spelling_variants(hard, least=1, altered=0).collect()} >= {"größe", "x" * 200_000}


# Ids and names of every kind -------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def wide(spark):
    """Ids over the whole range of long and names that have to be quoted."""
    ids = [-(1 << 63), -(1 << 62), -1, 0, 1, (1 << 48) + 3, (1 << 60) + 1, (1 << 63) - 1, *[i << 32 for i in range(1, 60)]]
    rows = [(i, f"a line of some words about number {k % 50} and more\nthe second one", f"s{k % 4}", k, "v") for k, i in enumerate(ids)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, `a.b` int, `c``d` string")


def test_ids_of_the_whole_range(spark, wide, paths):
    labels = spark.createDataFrame([(r[0], k % 2, k % 2) for k, r in enumerate(wide.select("doc_id").collect())], "doc_id long, quality int, toxic int")
    n = wide.count()
    for out in (media.media_columns(wide), toxicity.classify(wide, labels), quality_crf.classify(wide, labels), line_rules.judge(wide), pii.detect(wide), bpe_stream.encode_column(wide, tokenizer_path()), forest.classes(wide),
                mixing.plan(wide), exchange.exact_groups(wide), align.alignments(wide, *paths)):
        assert out.count() == n
    assert variants.spelling_variants(wide).count() > 0


def test_mixing_of_large_ids_follows_sql(spark, wide):
    plan = mixing.plan(wide).selectExpr("doc_id", "size", "source_size", "target", "size * copies AS taken")
    want = sql(mixing.ORACLE_SQL, documents=wide.select("doc_id", "text", "source"))
    assert rows_of(plan.withColumn("target", F.round("target", 6))) == sorted([(*r[:3], round(r[3], 6), r[4]) for r in want], key=repr)


def test_names_that_have_to_be_quoted(spark, wide):
    labels = spark.createDataFrame([(r[0], 1, 0) for r in wide.select("doc_id").collect()], "doc_id long, quality int, toxic int")
    for out in (quality_crf.keep_good(wide, labels), forest.one_of_each(wide), pii.mask_column(wide), mixing.mix(wide)):
        assert out.columns == wide.columns and out.count() >= 0
    assert {(r["doc_id"], r["a.b"], r["c`d"]) for r in mixing.mix(wide).collect()} <= {(r["doc_id"], r["a.b"], r["c`d"]) for r in wide.collect()}


# The pipeline's run() --------------------------------------------------------------------------------------------------------------


def left_in(root):
    return {n.split("-")[0] + "-" + n.split("-")[1] for n in os.listdir(root.removeprefix("file://")) if n.startswith("pipeline-")}


@pytest.mark.parametrize("kind", ["whole", "hard", "nothing"])
def test_pipeline_run(spark, hard, tmp_path, monkeypatch, kind):
    """run() gives what its stages give one after the other, and deletes what no later stage reads."""
    import corpus_pipeline as p

    from lodestone.llm import common

    whole = table(spark, SF, "documents")
    odd = hard.select("doc_id", "text", "lang", "source", "n_chars")
    docs = {"whole": whole, "hard": whole.limit(30).unionByName(odd.withColumn("doc_id", F.col("doc_id") + (1 << 61))), "nothing": whole.limit(0)}[kind]
    if kind == "hard":
        docs = docs.withColumn("a.b", F.lit(1)).withColumn("row", F.lit("r")).withColumn("size", F.lit(2.0))
    sf = f"{tmp_path}/sf"
    docs.write.parquet(f"{sf}/documents.parquet")
    table(spark, SF, "labels").write.parquet(f"{sf}/labels.parquet")
    shared = f"file://{tmp_path}/shared"
    monkeypatch.setattr(common, "shared_root", lambda spark: shared)
    os.makedirs(f"{tmp_path}/shared")
    out = rows_of(p.run(spark, sf))
    assert left_in(shared) == {"pipeline-mixing"}  # the last stage still reads it
    step = table(spark, sf, "documents")
    for _, stage in p.STAGES:
        step = stage(spark, step, sf)
    assert out == rows_of(step) and (kind == "nothing") == (not out)
