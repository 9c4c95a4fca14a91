"""Operators that look at all rows, against brute force; learned ones by held-out accuracy; the pipeline."""

import collections
import random

import numpy as np
import pytest

from lodestone.llm import forest, mixing, quality_crf, toxicity, url_lm, warc
from lodestone.llm.common import table

SF = "/root/testdata/sf0.001"


# Near copies ----------------------------------------------------------------------------------------------------------------------


def family_docs():
    """Families of near copies at many distances, exact copies, short texts, and texts that share a passage."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    rows, passage = [], [word() for _ in range(60)]
    for f in range(25):
        base = [word() for _ in range(rng.choice([8, 40, 120, 300]))]
        for k in range(rng.randint(1, 12)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                own[rng.randrange(len(own))] = word()
            rows.append(" ".join(own))
        rows += [" ".join(base)] * rng.randint(0, 3)
    rows += [" ".join([word() for _ in range(90)] + passage) for _ in range(40)]
    rows += ["one two", "one two", "one two three", "", None, ""]
    rng.shuffle(rows)
    return [(i * 3 % 1009, t) for i, t in enumerate(rows)]


def brute_links(rows, threshold=0.8):
    def grams(t):
        w = (t or "").split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    g = {i: grams(t) for i, t in rows}
    text = dict(rows)
    links = collections.Counter()
    parent = {i: i for i in g}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(g)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            empty = not g[a] and not g[b]
            if (text[a] or "") == (text[b] or "") or empty or (g[a] and len(g[a] & g[b]) >= threshold * len(g[a] | g[b]) - 1e-9):
                links[a] += 1
                links[b] += 1
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (root(i), links[i]) for i in ids}


def test_forest_against_brute_force(spark):
    rows = family_docs()
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in forest.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_links(rows)


def test_forest_blocks_give_the_same(spark):
    rows = [(i, t) for i, t in family_docs() if t]
    docs = spark.createDataFrame(rows, "node long, text string")
    members = docs.selectExpr("node", "cast(0 as long) as component", "cast(1 as long) as copies", "cast(1 as long) as n")
    count = lambda block, shingles=1 << 20: {r["node"]: r["n"] for r in forest.verified(members, docs, block=block, block_shingles=shingles).groupBy("node").sum("links").withColumnRenamed("sum(links)", "n").collect() if r["n"]}
    assert count(1000) == count(16) == count(1000, 20)


def test_forest_links_behind_less_similar_texts(spark, monkeypatch):
    """Near copies in stretches that are all headed by texts unlike them: every text is put into the same stretch of each tree."""
    rng = random.Random(5)
    words = lambda n: ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]
    rows = [(i, " ".join(words(100))) for i in range(60)]
    for i in range(60, 80, 2):
        x = words(100)
        rows += [(i, " ".join(x)), (i + 1, " ".join(x[:-8] + words(8)))]
    signed = forest.signatures
    monkeypatch.setattr(forest, "signatures", lambda docs, **k: signed(docs, **k).selectExpr("doc_id", "h1", "h2", "n", "transform(labels, x -> unhex('01010101010101010101')) AS labels", "sketch"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in forest.classes(docs).collect()}
    assert got == brute_links(rows) and sum(n for _, n in got.values()) == 20
    # a stretch of many blocks gives the same groups
    nodes = signed(docs).selectExpr("doc_id AS node", "transform(labels, x -> unhex('01010101010101010101')) AS labels", "sketch")
    placed = nodes.selectExpr("node", "node AS component", "sketch")
    ties = forest.group_ties(forest.stretches(forest.leaves(nodes, 7), 8), placed, 0.6, block=16).collect()
    assert {(r["a"], r["b"]) for r in ties} == {(i, i + 1) for i in range(60, 80, 2)}


def test_forest_shortest_prefix_meets_the_recall():
    d = forest.shortest_prefix()
    assert 1 - (1 - 0.8**d) ** forest.TREES >= forest.RECALL > 1 - (1 - 0.8 ** (d + 1)) ** forest.TREES


def test_forest_shortens_prefixes_by_what_it_finds(spark):
    """Pairs that are nearly copies are all found at the full depth; pairs near the threshold ask for shorter prefixes."""
    rng = random.Random(31)
    words = lambda n: ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]
    for changed, depths in ((1, {10}), (45, {7, 8})):
        rows = []
        for i in range(120):
            x = words(400)
            rows += [(2 * i, " ".join(x)), (2 * i + 1, " ".join(x[:-changed] + words(changed)))]
        nodes = forest.signatures(spark.createDataFrame(rows, "doc_id long, text string")).withColumnRenamed("doc_id", "node")
        found, ties, depth = forest.matched(nodes)
        assert depth in depths and {(r["a"], r["b"]) for r in ties.collect()} >= {(2 * i, 2 * i + 1) for i in range(120)}
        assert found.count() >= 240


def test_forest_hard(spark, hard, nothing):
    rows = forest.classes(hard).collect()
    assert len(rows) == hard.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[6]["class_id"] == by[7]["class_id"] == 6 and by[6]["n_links"] == 1 and by[None]["class_id"] is None
    assert forest.classes(nothing).count() == 0
    kept = forest.one_of_each(hard)
    assert kept.columns == hard.columns and {r["doc_id"] for r in kept.collect()} >= {None, 3, 4, 5, 6, 8} and 7 not in {r["doc_id"] for r in kept.collect()}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 120), (110, 120), (110, 130)] + [(200, 200 + i) for i in range(1, 50)]
    got = {r["node"]: r["component"] for r in forest.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (100, 110, 120, 130)} == {100} and {got[200 + i] for i in range(50)} == {200}


# Mixing ---------------------------------------------------------------------------------------------------------------------------


def test_mixing_follows_targets(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice(["a", "a", "a", "b", "c", "d", None]), "x") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = mixing.plan(docs).collect()
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        assert 0 <= r["copies"] <= 2 and r["size"] == len((dict((x[0], x[1]) for x in rows[r["doc_id"] : r["doc_id"] + 1])[r["doc_id"]]).split())
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
    assert abs(sum(target.values()) - min(1.5 * sum(size.values()), 2 * sum(size.values()))) < 1e-6 * sum(size.values())
    for s in size:
        assert target[s] <= 2 * size[s] + 1e-6 and abs(taken[s] - target[s]) <= 0.02 * target[s] + 120
    again = {(r["doc_id"], r["copies"]) for r in mixing.plan(docs.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["copies"]) for r in got}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in got)


def test_mixing_hard(hard, nothing):
    assert mixing.plan(hard).count() == hard.count() and mixing.plan(nothing).count() == 0
    assert mixing.mix(hard).columns == hard.columns and mixing.mix(nothing).count() == 0


# WARC -----------------------------------------------------------------------------------------------------------------------------


def test_loser_tree_merges():
    rng = random.Random(4)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((rng.randint(0, 50), r, i) for i in range(rng.randint(0, 40))) for r in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs], lambda e: e)) == sorted(e for r in runs for e in r)


def test_warc_histories(spark):
    body = "<html>" + "y" * 200
    rows = [(i, f"http://h{i % 3}.example.com/p{i % 11}?q", body if i % 3 == 0 else ("s" * 50 if i % 3 == 1 else f"<p>{i}é" + "z" * 150)) for i in range(400, 0, -1)]
    rows += [(7, None, None), (None, "http://x/", body), (3, "http://dup/", body), (500, "no scheme", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = warc.histories(pages).collect()
    assert len(out) == len(rows)
    for r in out:
        if r["page_id"] is not None and r["page_id"] % 3 == 0 and r["page_id"] <= 400:
            assert (r["record_type"], r["refers_to"]) == (("response", None) if r["page_id"] == 3 else ("revisit", 3))
        else:
            assert r["record_type"] == "response" and r["refers_to"] is None
    order = [(r["url_key"], r["ts"], -1 if r["page_id"] is None else r["page_id"]) for r in sorted(out, key=lambda r: r["capture_no"])]
    assert order == sorted(order) and sorted(r["capture_no"] for r in out) == list(range(len(rows)))
    assert warc.histories(spark.createDataFrame([], pages.schema)).count() == 0


def test_warc_long_values_and_clashing_names(spark):
    """Very long payloads and URLs, and columns whose names are those of the operator's own."""
    long_ = "x" * 2_000_000
    rows = [(1, "http://h/" + "p" * 50_000, long_, "a", "b"), (2, "http://h/2", long_, "c", None), (3, "http://H/\u00e9\n", "\u6f22" * 100_000, None, None), (4, "", "", "d", "e")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, refers_to string")
    out = {r["page_id"]: r for r in warc.histories(pages).collect()}
    assert (out[2]["record_type"], out[2]["refers_to"], out[2]["payload_bytes"]) == ("revisit", 1, 2_000_000) and out[3]["payload_bytes"] == 300_000 and out[4]["url_key"] == ""


def test_warc_ranges_skip_row_groups_of_one_url(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "GROUP_ROWS", 10)
    uri = f"file://{tmp_path}/run.parquet"
    entries = [("com,h)/", f"{i:014d}", i, "f", i, 1) for i in range(1000)]
    warc.write_run(uri, iter(entries))
    read = []
    group = warc.pq.ParquetFile.read_row_group
    monkeypatch.setattr(warc.pq.ParquetFile, "read_row_group", lambda self, i, *a: read.append(i) or group(self, i, *a))
    low, high = ("com,h)/", f"{500:014d}", 500), ("com,h)/", f"{520:014d}", 520)
    assert list(warc.read_run(uri, low, high)) == entries[500:520] and len(read) <= 4


def test_warc_merges_in_passes(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}"
    monkeypatch.setattr(warc, "RUN_ENTRIES", 20)
    pages = spark.createDataFrame([(i, f"http://h/{i * 7 % 50}", f"p{i}") for i in range(300)], "page_id long, url string, html string").repartition(3)
    runs = warc.archive(pages, root)
    assert runs.count() > 3
    out = warc.captures(spark, runs, root, fan_in=3, ranges=5).collect()
    order = [(r["url_key"], r["ts"], r["page_id"]) for r in sorted(out, key=lambda r: (r["range_no"], r["seq"]))]
    assert len(order) == 300 and order == sorted(order)


# URLs -----------------------------------------------------------------------------------------------------------------------------


def test_url_rules_and_parts(spark):
    urls = ["http://WWW.Example.com/en/x?q", "https://a.example.com/en/", "http://x.net/es/1", "http://net/fr/", "http://x.net/de", "https://b.com", "https://b.com/", "nothing", None, "http://h.org?x/y", "http://aexample.com/en/z"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in url_lm.judge(pages).collect()}
    assert got[0] == ("www.example.com", "/en/x", "www.example.com/en/") and got[1] == ("a.example.com", "/en/", "example.com/en/")
    assert got[2][2] == "net/es/" and got[3][2] == "net/fr/" and got[4] == ("x.net", "/de", None) and got[5] == ("b.com", "", None) and got[6][2] == "com/"
    assert got[7] == got[8] == ("", "", None) and got[9] == ("h.org", "", None) and got[10][2] == "com/"
    assert url_lm.judge(spark.createDataFrame([], pages.schema)).count() == 0


def test_url_model_tells_styles_apart(spark):
    rng = random.Random(8)
    good = [f"http://site{rng.randint(1, 40)}.com/articles/{rng.choice(['history', 'science', 'travel'])}/{rng.randint(1, 99)}" for _ in range(400)]
    bad = [f"http://cas1no{rng.randint(1, 40)}.net/es/win-xxx-{rng.randint(1000, 9999)}-bonus" for _ in range(400)]
    probe = ["http://site3.org/articles/science/12", "http://cas1no3.org/win-xxx-1234-bonus"]
    pages = spark.createDataFrame(list(enumerate(good + bad + probe)), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_lm.judge(pages).collect()}
    assert got[800] == "allow" and got[801] == "block"


def test_url_scores_of_many_contexts(spark):
    """More contexts than any fixed table holds, against counts in dictionaries."""
    rng = random.Random(9)
    tail = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789é") for _ in range(n))
    urls = [f"http://{tail(9)}.com/{tail(30)}" for _ in range(2000)] + [f"http://{tail(9)}.net/es/{tail(30)}" for _ in range(2000)]
    urls += [f"http://{tail(9)}.org/{tail(30)}" for _ in range(100)] + ["x", "", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    seen, ctx, order = (collections.Counter(), collections.Counter()), (collections.Counter(), collections.Counter()), url_lm.ORDER
    text = lambda u: "\x02" * order + u + "\x03"
    for r in url_lm.with_rule(pages).filter(f"rule is not null and pmod(xxhash64(url), {url_lm.FOLDS}) <> 0").collect():
        t, c = text(r["url"]), int(r["rule_verdict"] == "allow")
        for i in range(order, len(t)):
            seen[c].update(t[i - k : i + 1] for k in range(order + 1))
            ctx[c].update((k, t[i - k : i]) for k in range(order + 1))
    assert len(seen[0]) > 1 << 16

    def score(u):
        t, total = text(u), [0.0, 0.0]
        for i in range(order, len(t)):
            for c in (0, 1):
                p = 1 / 256
                for k in range(order + 1):
                    p = (seen[c][t[i - k : i + 1]] + url_lm.LOWER * p) / (ctx[c][k, t[i - k : i]] + url_lm.LOWER)
                total[c] += np.log(p)
        return (total[1] - total[0]) / (len(t) - order)

    got = {r["page_id"]: r["score"] for r in url_lm.judge(pages).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        assert got[i] is None if i < 4000 else abs(got[i] - (score(u) if u else 0.0)) < 1e-6


def test_urls_with_long_values_and_clashing_names(spark):
    pages = spark.createDataFrame([(1, "http://a.com/" + "x" * 20_000, "r", 1.0), (2, "http://b.net/es/" + "y" * 20_000, "s", 2.0), (3, "z" * 20_000, None, None), (3, "z" * 20_000, None, None), (None, None, None, None)], "page_id long, url string, rule string, score double")
    out = url_lm.judge(pages).collect()
    assert len(out) == 5 and {(r["page_id"], r["rule"]) for r in out} == {(1, "com/"), (2, "net/es/"), (3, None), (None, None)}


def test_url_threshold_is_set_on_both_sides(spark):
    """Of classes far apart the threshold lies at the rejected ones; where they overlap few accepted URLs fall."""
    ruled = spark.range(4000).selectExpr("id AS page_id", "concat('u', id) AS url", "if(id % 2 = 0, 'allow', 'block') AS rule_verdict")
    apart = ruled.selectExpr("url", "if(rule_verdict = 'allow', 2.0, -2.0) + (page_id % 100) / 1000 AS score")
    t, gone, missed = url_lm.calibrated(ruled, apart)
    assert -0.1 < t <= 0 and gone == 0 and missed == 0
    same = ruled.selectExpr("url", "cast((page_id div 2) % 200 as double) / 100 - 1 AS score")
    t, gone, missed = url_lm.calibrated(ruled, same)
    assert gone <= 0.01 and missed > 0.9 and t < -0.9


# Learned scores -------------------------------------------------------------------------------------------------------------------


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    values, inverse, counts = np.unique(np.array(s)[order], return_inverse=True, return_counts=True)
    rank[order] = (counts.cumsum() - counts / 2)[inverse]
    y = np.array(y)
    return (rank[y == 1].mean() - (len(y[y == 1])) / 2 - rank.mean() * 0) / max(1, (y == 0).sum()) if 0 < y.sum() < len(y) else 1.0


@pytest.mark.parametrize(("op", "label"), [(toxicity, "toxic"), (quality_crf, "quality")])
def test_held_out_accuracy(spark, op, label):
    sf = "/root/testdata/sf0.1"
    rows = op.classify(table(spark, sf, "documents"), table(spark, sf, "labels")).join(table(spark, sf, "labels"), "doc_id").filter("held_out").collect()
    right = sum(r["predicted"] == r[label] for r in rows) / len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows) and right > (0.97 if label == "quality" else 0.9)


@pytest.mark.parametrize("op", [toxicity, quality_crf])
def test_scores_of_hard_texts(spark, hard, nothing, op):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 1), (6, 1, 0), (8, 0, 1), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    rows = op.classify(hard, labels).collect()
    assert len(rows) == hard.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (6, 7)}) == 1
    assert op.classify(nothing, labels).count() == 0 and op.classify(hard, labels.limit(0)).count() == hard.count()


def test_fuzzy_trie_is_exact_levenshtein():
    terms = [("pathetic", False), ("worthless", False), ("clown", False), ("scum", False), ("idiot", False)]
    trie = toxicity.FuzzyTrie(terms)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(6)
    for _ in range(3000):
        w = list(rng.choice(terms)[0])
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(w) + 1)
            w[i : i + rng.randint(0, 1)] = rng.choice(["", "x", "e", "s", "o"])
        w = "".join(w)
        want = [(distance(w, t), i) for i, (t, _) in enumerate(terms) if distance(w, t) <= next(k for n, k in toxicity.EDITS if len(t) >= n)]
        term, edits = trie.match(w)
        assert (term >= 0) == bool(want) and (not want or edits == min(want)[0])


def test_words_stay_beside_their_beginnings(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("bcfghlmnprtv") for _ in range(7)) for _ in range(60)]
    rows = [(i, " ".join([*rng.choices(words, k=12), *([rng.choice(["idiot", "idiot", "idiots"])] if i % 2 else []), *rng.choices(words, k=12)])) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) AS toxic"))
    assert any(stem and "idiot".startswith(t) for t, stem in model.terms) and ("idiot", False) in model.terms
    assert model.evidence("idjot")[1:] == (1, 1, 0) and model.evidence("idiotic")[1:] == (1, 0, 0)
    # the marks of a quotation longer than 80 characters
    long = " ".join(words[:20])
    assert model.evidence(f'he "{long} idiot {long}" no')[3] == 1 and model.evidence(f'"{long}" idiot "{long}"')[3] == 0
    assert model.evidence(f"“{long} idiot\n {long}”")[3] == 0


def test_crf_marginals_against_enumeration():
    rng = np.random.default_rng(3)
    lines = np.array([1, 4, 3, 2])
    unary, edge = rng.normal(size=lines.sum()), rng.normal(size=(2, 2))
    good, _, z = quality_crf.forward_backward(unary, lines, edge)
    at = 0
    for c, n in enumerate(lines):
        total, marginal = 0.0, np.zeros(n)
        for m in range(1 << n):
            y = [(m >> i) & 1 for i in range(n)]
            p = np.exp(sum(unary[at + i] for i in range(n) if y[i]) + sum(edge[y[i - 1], y[i]] for i in range(1, n)))
            total += p
            marginal += p * np.array(y)
        assert np.allclose(good[at : at + n], marginal / total) and np.isclose(z[c], np.log(total))
        at += n


# Pipeline -------------------------------------------------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline as p
    from tokenizers import Tokenizer

    from lodestone.llm import pii
    from lodestone.llm.queries import tokenizer_path

    docs = table(spark, SF, "documents")
    good = p.quality(spark, docs, SF).cache()
    scores = {r["doc_id"]: r["predicted"] for r in quality_crf.classify(docs, table(spark, SF, "labels")).collect()}
    assert good.columns == docs.columns and {r[0] for r in good.select("doc_id").collect()} == {i for i, y in scores.items() if y == 1}
    one = p.near_duplicates(spark, good, SF).cache()
    want = brute_links([(r["doc_id"], r["text"]) for r in good.collect()])
    assert {r[0] for r in one.select("doc_id").collect()} == {i for i, (c, _) in want.items() if i == c}
    clean = p.personal_data(spark, one, SF).cache()
    assert clean.columns == docs.columns and all(not pii.find(r["text"])[0] for r in clean.collect())
    mixed = p.source_mix(spark, clean, SF).cache()
    assert mixed.columns == docs.columns and set(mixed.select("doc_id").collect()) <= set(clean.select("doc_id").collect())
    out = p.tokens(spark, mixed, SF).collect()
    lib = Tokenizer.from_file(tokenizer_path())
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert len(out) == mixed.count() and all(r["n_tokens"] == len(lib.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids) for r in out)
    assert [name for name, _ in p.STAGES] == ["quality_classifier", "jaccard_join", "pii", "mixing", "bpe"]


# Toxicity in context ---------------------------------------------------------------------------------------------------------------


def test_scores_do_not_depend_on_partitions(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    labels = labels.unionByName(labels.limit(20).selectExpr("doc_id", "1 - quality AS quality", "1 - toxic AS toxic"))  # ids with two labels
    for op in (toxicity, quality_crf):
        one = {r["doc_id"]: r["score"] for r in op.classify(docs, labels).collect()}
        other = {r["doc_id"]: r["score"] for r in op.classify(docs.repartition(13), labels.repartition(5)).collect()}
        assert one == other


def quoting_model():
    terms = ["moron", "worthless", "disgusting"]
    model = toxicity.Model([(t, False) for t in terms], [5.0] * 3, [], 0.0)
    words = "the plan was good and we went there by train to see".split()
    rng = random.Random(3)
    raw, y = [], []
    for i in range(200):
        text = " ".join(rng.choice(words) for _ in range(40))
        raw.append(model.evidence(text + (f" you {rng.choice(terms)} and {rng.choice(terms)} lot" if i % 4 == 0 else ""))[0])
        y.append(int(i % 4 == 0))
    model.coef, model.discount = toxicity.fit_context(raw, y)
    return model


@pytest.mark.parametrize(
    ("quoted", "plain"),
    [
        ('he said "you are worthless" to them and left the room', "he thinks you are worthless to them and left the room"),
        ("er rief „du moron“ und ging", "er rief du moron und ging"),
        ("she told us of «a disgusting man» there", "she told us of a disgusting man there"),
        ("the word moron stands in the list", "the real moron stands in the list"),
        ("a long way off he began “" + "and so on " * 30 + "you moron” and left", "a long way off he began " + "and so on " * 30 + "you moron and left"),
    ],
)
def test_quoted_matches_weigh_less(quoted, plain):
    model = quoting_model()
    (q, nq, _, quotes), (p, np_, _, none) = model.evidence(quoted), model.evidence(plain)
    assert nq == np_ == quotes == 1 and none == 0 and 0 < model.discount < 1
    blank = model.score(model.evidence("nothing of the kind")[0])
    assert blank < model.score(q) < model.score(p)


@pytest.mark.parametrize("text", ['a 5" disk: you are worthless, don’t talk', "you don’t see, moron, what it’s worth", 'an open " mark, moron', "“opened\nmoron” there", "‘twas a moron’s day"])
def test_what_is_no_quotation(text):
    assert quoting_model().evidence(text)[3] == 0


def test_quotation_share_is_learned_where_there_is_something_to_learn_from():
    raw = lambda p, q: [p, q, 0.0, min(p, 5.0), min(q, 5.0), float(p > 0), float(q > 0), 50.0]
    clean_quotes = [raw(0, 10.0)] * 40 + [raw(0, 0)] * 200 + [raw(10.0, 0)] * 40
    toxic_quotes = clean_quotes
    assert toxicity.fit_context(clean_quotes, [0] * 240 + [1] * 40)[1] < toxicity.QUOTED_SHARE
    assert toxicity.fit_context(toxic_quotes, [1] * 40 + [0] * 200 + [1] * 40)[1] > toxicity.QUOTED_SHARE


def test_misspelling_is_never_innocence():
    model = quoting_model()
    score = lambda t: model.score(model.evidence(t)[0])
    assert score("nothing here") < score("you m0ron you") <= score("you moron you") and all(c >= 0 for c in model.coef[1:])
    assert score("nothing here") < score("you wortless one") < score("you worthless one")


def test_near_forms_of_clean_documents_are_words_of_their_own(spark):
    model = toxicity.Model([("trash", False)], [5.0], [], 0.0)
    rows = spark.createDataFrame([("a brash one", 0), ("brash again", 0), ("trach here", 1), ("trash", 1)], "text string, y int")
    assert toxicity.own_words(rows, model, 2, 2) == {"brash"}
    model = toxicity.Model([("trash", False)], [5.0], [], 0.0, 0.3, frozenset({"brash"}))
    assert model.match("brash") == (-1, 0) and model.match("trach") == (0, 1)
