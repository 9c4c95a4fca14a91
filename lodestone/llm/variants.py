"""Spelling variants by a symmetric-delete join.

Every word emits itself and its distinct single deletions as keys; words that share a key are joined by it and kept if their distance is
exactly one. Each word takes as its form the most frequent of its near words if that is at least FACTOR times as frequent, and the root at
the end of the chain of forms is found by joining roots with roots until none changes: the frequency grows by FACTOR at each step, so that
a chain has at most log(occurrences) steps and the doubling join a handful of rounds.

Size. Occurrences are summed up before the shuffle; a word that is a third of all words is one row for each task. A key is the 64-bit hash
of a deletion: words that share one differ by one inserted character each, so that a key has at most (length + 1) x alphabet words, however
many rows the corpus has. Deletions of one run of equal characters are the same word and are emitted once. A word of n characters emits
at most n + 1 rows of two longs, one at a time; the words themselves are joined to the candidate pairs by their number. Unequal words with
one hash are dropped by the check of the distance.

Defined cases. A null text has no words; a null id counts as the empty text where words are altered. Repeated rows count each. Ties of
frequency go to the word that is smaller in code-point order. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Letters of words; how long and how frequent a word must be; how many times as frequent its form; the share of altered words is 1 / ALTERED.
RUN, LEAST_CHARS, LEAST, FACTOR, ALTERED = r"[A-Za-zÀ-ÿ]+", 5, 3, 2, 97

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def corpus_words(docs: DataFrame, altered: int = ALTERED, least_chars: int = LEAST_CHARS, least: int = LEAST) -> DataFrame:
    """(word, n): words of all texts in lower case (A-Z only), a character deleted from one in so many, of at least so many characters and occurrences.

    altered 0 leaves all words as they are.
    """
    runs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.filter(F.length("run") >= least_chars).select("doc_id", F.translate("run", _UPPER, _LOWER).alias("run"))
    if altered:
        h = F.crc32(F.concat(F.coalesce("doc_id", F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
        hashed = runs.withColumn("h", h)
        at = (F.col("h") % F.length("run")).cast("int")
        runs = hashed.select(F.when(F.col("h") % altered == 0, without("run", at)).otherwise(F.col("run")).alias("run"))
    return runs.groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n")).filter((F.length("word") >= least_chars) & (F.col("n") >= least))


def without(word: str, at):
    """A word without the character at a place, counted from 0."""
    c = F.col(word)
    return F.concat(c.substr(F.lit(1), at), c.substr(at + 2, F.length(c)))


def keys(words: DataFrame) -> DataFrame:
    """(key, id, deleted): the hash of each word and of its distinct single deletions."""
    own = words.select(F.xxhash64("word").alias("key"), "id", F.lit(False).alias("deleted"))
    at = words.select("id", "word", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("at"))
    one = lambda i: F.col("word").substr(i, F.lit(1))
    # of a run of equal characters only the last is deleted
    last = at.filter((F.col("at") == F.length("word") - 1) | (one(F.col("at") + 1) != one(F.col("at") + 2)))
    return own.unionByName(last.select(F.xxhash64(without("word", F.col("at"))).alias("key"), "id", F.lit(True).alias("deleted")))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b): numbers of words at a distance of exactly one, each pair once with a < b. words: id, word."""
    k = keys(words)
    left, right = k.select("key", F.col("id").alias("a")), k.select("key", F.col("id").alias("b"))
    candidates = left.join(right, "key").filter("a < b").select("a", "b").distinct()
    named = lambda x: words.select(F.col("id").alias(x), F.col("word").alias(f"word_{x}"))
    return candidates.join(named("a"), "a").join(named("b"), "b").filter(F.levenshtein("word_a", "word_b", 1) == 1).select("a", "b")


def grouped(counts: DataFrame, factor: int = FACTOR) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word. counts: word (distinct), n."""
    words = cut(counts.select("word", "n").withColumn("id", F.monotonically_increasing_id()))
    pairs = cut(near_pairs(words))
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # the most frequent near word, ties by code points
    best = F.min(F.struct((-F.col("n")).alias("less"), "word", "b")).alias("best")
    near = both.join(words.select(F.col("id").alias("b"), "word", "n"), "b").groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), best).withColumnRenamed("a", "id")
    found = words.join(near, "id", "left").withColumn("form_n", -F.col("best.less"))
    takes = F.col("form_n") >= factor * F.col("n")
    formed = cut(found.select("id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(takes, F.col("best.word")).alias("form"), F.when(takes, F.col("form_n")).alias("form_n"), F.when(takes, F.col("best.b")).alias("form_id")))
    ends = roots(formed.filter("form_id is not null").select("id", F.col("form_id").alias("root")))
    named = ends.join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    return formed.join(named, "id", "left").select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")


def roots(links: DataFrame) -> DataFrame:
    """(id, root): where chains of links (id, root) end. Chains have no cycles; each round doubles the stretch that a link spans."""
    while True:
        links = cut(links)
        on = links.select(F.col("id").alias("root"), F.col("root").alias("next"))
        if not links.join(on, "root", "left_semi").take(1):
            return links
        links = links.join(on, "root", "left").select("id", F.coalesce("next", "root").alias("root"))


def spelling_variants(docs: DataFrame, **options) -> DataFrame:
    """The words of all texts with their forms and roots."""
    return grouped(corpus_words(docs, **options))



ORACLE_SQL = """
WITH RECURSIVE t0 AS (SELECT i, i::BIGINT AS v, 0 AS k FROM range(256) r(i)
), crc_step(i, v, k) AS (SELECT * FROM t0 UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM crc_step WHERE k < 8
), runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{00C0}-\\x{00FF}]+')) AS run FROM documents) WHERE length(run) >= 5 GROUP BY ALL
), coded AS (
  SELECT row_number() OVER () AS u, run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS h FROM runs
), bytes AS (
  SELECT u, p, CAST('0x' || substr(h, 2 * p - 1, 2) AS BIGINT) AS b FROM (SELECT u, h, unnest(range(1, length(h) // 2 + 1)) AS p FROM coded)
), crc(u, p, c) AS (
  SELECT u, 0::BIGINT, 4294967295::BIGINT FROM coded
  UNION ALL SELECT crc.u, crc.p + 1, xor(crc.c >> 8, s.v) FROM crc JOIN bytes ON bytes.u = crc.u AND bytes.p = crc.p + 1 JOIN crc_step s ON s.k = 8 AND s.i = xor(crc.c, bytes.b) & 255
), hashed AS (
  SELECT run, n, xor(c, 4294967295) AS h FROM coded JOIN crc USING (u) WHERE p = length(coded.h) // 2
), w AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed
  ) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), d AS (
  SELECT DISTINCT word, n, substr(word, 1, i) || substr(word, i + 2) AS k FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)
), near AS (
  SELECT DISTINCT a, b, b_n FROM (
    SELECT x.word AS a, y.word AS b, y.n AS b_n FROM d x JOIN d y ON x.k = y.k AND x.word <> y.word AND length(x.word) = length(y.word)
      AND len(list_filter(range(1, length(x.word) + 1), lambda i: substr(x.word, i, 1) <> substr(y.word, i, 1))) = 1
    UNION ALL SELECT x.word, y.word, y.n FROM d x JOIN w y ON y.word = x.k
    UNION ALL SELECT y.word, x.word, x.n FROM d x JOIN w y ON y.word = x.k)
), best AS (
  SELECT a, count(*) AS n_near, first(b ORDER BY b_n DESC, b) AS b, max(b_n) AS b_n FROM near GROUP BY a
), formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN b_n >= 2 * n THEN b END AS form, CASE WHEN b_n >= 2 * n THEN b_n END AS form_n FROM w LEFT JOIN best ON a = word
), chain(word, stop, form) AS (
  SELECT word, word, form FROM formed UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON f.word = c.form
)
SELECT f.word, f.form, c.stop AS root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c ON c.word = f.word AND c.form IS NULL
"""
