"""URL filters: rules first, then the ratio of two character language models.

Rules decide the URLs they fit. Those decisions over all rows are the accepted and rejected corpora of two variable-order Markov
models of characters: counts of every character after each of its contexts of up to ORDER characters, each order smoothed by the
next lower one. A URL that no rule fits is judged by the difference of its log-likelihoods, divided by its length, against a
threshold set on a tenth of the decided URLs, which the counts leave out: at most FALSE_BLOCKS of the accepted ones fall below it. Where that and having
all but MISSED of the rejected ones below leaves a gap, it is the middle of the gap: what rules do not decide leans to either side.

Counts are of the real characters and contexts, so the models grow with the table and stay distributed. What a character adds to a
score depends on its window alone (its ORDER predecessors and itself): URLs are cut into windows, the counts of all orders are sums
over the distinct windows, and each distinct window gets its value once. Values are whole multiples of 1 / UNIT, so that sums do not
depend on the order of rows. Windows with their values are broadcast if they are few, else joined by a shuffle.

Defined cases. A null URL or one without :// has an empty host and path, fits no rule and is judged as an empty string, which is
allowed. Without accepted or without rejected URLs the method allows everything. Repeated rows stay repeated and count as often as
they occur; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut

#: (verdict, host, path) of the rules.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Longest context, weight of the lower order, the share of accepted URLs that may fall, and of rejected ones that may stay.
ORDER, LOWER, FALSE_BLOCKS, MISSED = 5, 4.0, 0.01, 0.01
#: One of so many URLs is left out of the counts and calibrates the threshold.
FOLDS, BINS, SPAN = 10, 2048, 8.0
#: Parts of one that window values are rounded to; windows that are broadcast, more are joined by a shuffle.
UNIT, BROADCAST_WINDOWS = 1e9, 200_000


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, with A-Z lower-cased."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rule(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages with host, path, rule and rule_verdict: the longest rule whose host the URL's host is or lies under, and whose path starts its path."""
    out = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    named, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest last: it is asked first
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        named, verdict = F.when(fits, F.lit(host + path)).otherwise(named), F.when(fits, F.lit(v)).otherwise(verdict)
    return out.withColumn("rule", named).withColumn("rule_verdict", verdict)


def windows_of(url: Column) -> Column:
    """Every character, the end included, after its ORDER predecessors; the start is padded."""
    text = F.concat(F.lit("\x02" * ORDER), url, F.lit("\x03"))
    return F.transform(F.sequence(F.lit(1), F.length(url) + 1), lambda i: F.substring(text, i, F.lit(ORDER + 1)))


def window_values(known: DataFrame, asked: DataFrame) -> DataFrame:
    """(window, value): the difference of the logarithms of both models, in 1 / UNIT, for every window of known and asked.

    known: url, accepted (boolean), of the URLs that are counted; asked: url. Without accepted or without rejected URLs all values are 0.
    """
    one = lambda c: F.when(c, 1).otherwise(0).cast("long")
    rows = known.select("url", one(F.col("accepted")).alias("n1"), one(~F.col("accepted")).alias("n0"))
    rows = rows.unionByName(asked.select("url", F.lit(0).cast("long").alias("n1"), F.lit(0).cast("long").alias("n0")))
    rows = rows.select(F.explode(windows_of(F.col("url"))).alias("window"), "n0", "n1")
    grams = cut(rows.groupBy("window").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    total = grams.agg(F.sum("n0"), F.sum("n1")).first()
    if not total[0] or not total[1]:
        return grams.select("window", F.lit(0).cast("long").alias("value"))
    p = [F.lit(1 / 256), F.lit(1 / 256)]
    out = grams
    for k in range(ORDER + 1):
        seen, ctx = [F.col("n0"), F.col("n1")], [F.lit(total[0]), F.lit(total[1])]
        if k < ORDER:
            name = f"seen{k}"
            out = out.withColumn(name, F.substring("window", ORDER + 1 - k, k + 1))
            out = out.join(grams.groupBy(F.substring("window", ORDER + 1 - k, k + 1).alias(name)).agg(F.sum("n0").alias(f"{name}_0"), F.sum("n1").alias(f"{name}_1")), name).drop(name)
            seen = [F.col(f"{name}_0"), F.col(f"{name}_1")]
        if k:
            name = f"ctx{k}"
            out = out.withColumn(name, F.substring("window", ORDER + 1 - k, k))
            out = out.join(grams.groupBy(F.substring("window", ORDER + 1 - k, k).alias(name)).agg(F.sum("n0").alias(f"{name}_0"), F.sum("n1").alias(f"{name}_1")), name).drop(name)
            ctx = [F.col(f"{name}_0"), F.col(f"{name}_1")]
        p = [(seen[c] + LOWER * p[c]) / (ctx[c] + LOWER) for c in (0, 1)]
    return out.select("window", F.round((F.log(p[1]) - F.log(p[0])) * UNIT).cast("long").alias("value"))


def scores(ruled: DataFrame) -> DataFrame:
    """(url, score): the log-likelihood difference by length of every distinct URL that no rule decides or that calibrates."""
    known = _known(ruled)
    asked = ruled.filter("rule_verdict is null and url <> ''").select("url").unionByName(known.filter("left_out").select("url"))
    asked = cut(asked.distinct().withColumn("id", F.monotonically_increasing_id()))
    values, _ = broadcast_if_small(window_values(known.filter("not left_out"), asked), BROADCAST_WINDOWS)
    rows = asked.select("id", F.explode(windows_of(F.col("url"))).alias("window"))
    per = rows.join(values, "window").groupBy("id").agg((F.sum("value") / UNIT / F.count(F.lit(1))).alias("score"))
    return cut(asked.join(per, "id").select("url", "score"))


def _known(ruled: DataFrame) -> DataFrame:
    """The URLs that a rule decides, whether it accepts them, and whether they are of the fold that is left out."""
    known = ruled.filter(F.col("rule_verdict").isNotNull() & F.col("url").isNotNull())
    return known.select("url", (F.col("rule_verdict") == "allow").alias("accepted"), (F.pmod(F.xxhash64("url"), F.lit(FOLDS)) == 0).alias("left_out"))


def calibrated(ruled: DataFrame, scored: DataFrame) -> tuple[float, float, float]:
    """(threshold, share of accepted URLs below it, share of rejected URLs not below it), on the fold that the counts leave out."""
    at = F.floor((F.col("score") + SPAN) * BINS / (2 * SPAN))
    bins = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), at)).alias("bin")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    rows = _known(ruled).filter("left_out").join(scored, "url").groupBy(bins).agg(one(F.col("accepted")), one(~F.col("accepted"))).collect()
    edge = lambda b: b * 2 * SPAN / BINS - SPAN
    accepted, rejected = sum(r[1] for r in rows), sum(r[2] for r in rows)
    rows.sort()
    upper, gone = edge(BINS if accepted else 0), 0  # as many accepted URLs as allowed lie below it
    for b, n1, _ in rows:
        gone += n1
        if gone > FALSE_BLOCKS * accepted:
            upper = edge(b)
            break
    lower, left = upper, 0  # so many rejected URLs as allowed lie above it
    for b, _, n0 in reversed(rows):
        if left + n0 > MISSED * rejected:
            lower = edge(b + 1)
            break
        left += n0
    threshold = min((lower + upper) / 2 if lower < upper else upper, 0.0)
    share = lambda i, keep: sum(r[i] for r in rows if keep(edge(r[0]))) / max(1, sum(r[i] for r in rows))
    return threshold, share(1, lambda e: e < threshold), share(2, lambda e: e >= threshold)


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row for each page: page_id, host, path, rule, verdict, and the score of the method where it decides."""
    ruled = cut(with_rule(pages.select("page_id", "url"), rules))
    scored = scores(ruled)
    threshold, _, _ = calibrated(ruled, scored)
    decided = ruled.filter("rule_verdict is not null").withColumn("score", F.lit(None).cast("double"))
    # null and empty URLs have no windows and are no keys
    blank = F.coalesce(F.col("url") == "", F.lit(True))
    other = ruled.filter("rule_verdict is null")
    judged = other.filter(~blank).join(scored, "url", "left").unionByName(other.filter(blank).withColumn("score", F.lit(0.0)))
    out = decided.unionByName(judged)
    method = F.when(F.col("score") < threshold, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", method).alias("verdict"), "score")
