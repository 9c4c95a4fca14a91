"""Toxicity scores from a learned lexicon, fuzzy term matching and the context of each match.

Lexicon. Words and word beginnings that mark toxic documents are learned from labelled rows: counted in the toxic documents of a
bounded sample (near copies once), then in the clean ones. A term is what stands in toxic documents more often than chance explains
among all candidates (a likelihood ratio that few false terms pass), with its log-odds as weight; their number has no cap.

Matching. The terms form a trie. The Levenshtein automata of all terms, intersected with the trie, are made deterministic on demand:
a state is a set of (trie node, edits) pairs, and each transition is computed once, so that a word costs a few look-ups and most
words die after two or three letters. Words of five letters and more may differ by one or two edits; beginnings match exactly, where
no whole word does. A near form that clean documents of the sample use is a word of its own and no misspelling.

Context. A match counts by its weight, less for each edit. Inside a quotation that opens and closes in its line, or right after a word
that reports speech, it counts only the share `discount`, which the likelihood of the sample moves from QUOTED_SHARE where it has quoted
matches to learn from. Matches with another one within WINDOW words count again. A logistic regression without negative coefficients
on these sums, fitted on the half of the sample that the lexicon has not seen, gives the score: no match ever speaks for innocence.

Defined cases. Null and empty texts have no match and get the score of a text without matches. Equal texts have equal scores. Scores do
not depend on the order or partitions of rows: of near copies in the sample that with the least id stays, of labels of one id the
least. Rows without a label are not learned from; without any toxic or clean label the score is the share of toxic labels. Repeated
rows stay repeated; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hash_share, map_arrow, sample_share, split_of

#: Labelled rows that are learned from, at most (about; chosen by hash).
FIT_ROWS = 16_000
#: Least weight of a term, the number of false terms to be expected among all candidates, lengths of word beginnings, how much
#: more a longer beginning must weigh than the one it goes on.
LEAST_WEIGHT, FALSE_TERMS, STEMS, PURER = 1.5, 30.0, (4, 5, 6, 7, 8), 0.5
#: Share of its weight that a quoted match keeps without evidence, the shares tried, and how firmly the first is held.
QUOTED_SHARE, SHARES, HOLD = 0.3, (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9), 1.0
#: Words around a match that count as its context, and the edits allowed by a term's length.
WINDOW, EDITS = 12, ((9, 2), (5, 1), (0, 0))
THRESHOLD = 0.3
#: Words that report speech.
REPORTING = frozenset("said says wrote writes called calls quote quoted quotes cited cites reported reports term word".split())

#: Words, with the signs inside them that stand for letters; what these and digits stand for.
_WORD = re.compile(r"[^\W_]+(?:[@$*!][^\W_]+)*")
_STANDS_FOR = str.maketrans("013457@$!", "oieastasi")
SCORED = "doc_id long, score double, n_matches long, n_fuzzy long, n_quoted long"


@dataclass
class Node:
    children: dict[str, Node] = field(default_factory=dict)
    term: int = -1
    stem: int = -1
    edits: int = 0  # the most that a term below allows


class FuzzyTrie:
    """All terms within their allowed edits of a word, by one deterministic automaton made on demand."""

    def __init__(self, terms: list[tuple[str, bool]], states: int = 100_000) -> None:
        self.nodes, self.terms, self.most = [Node()], terms, states
        for i, (term, is_stem) in enumerate(terms):
            allowed = 0 if is_stem else next(k for n, k in EDITS if len(term) >= n)
            node = self.nodes[0]
            node.edits = max(node.edits, allowed)
            for c in term:
                if c not in node.children:
                    node.children[c] = Node()
                    self.nodes.append(node.children[c])
                node = node.children[c]
                node.edits = max(node.edits, allowed)
            if is_stem:
                node.stem = i
            else:
                node.term = i
        self._clear()

    def _clear(self) -> None:
        self.index: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int]] = []
        self.stems: list[int] = []
        self.by_id = {id(n): n for n in self.nodes}
        self.start = self._state(self._close({(id(self.nodes[0]), 0)}))

    def _close(self, pairs: set) -> frozenset:
        """Adds what skipping letters of the term reaches, and drops pairs that a cheaper one at the same node covers."""
        best: dict[int, int] = {}
        todo = sorted(pairs, key=lambda p: p[1])
        while todo:
            n, e = todo.pop(0)
            if best.get(n, 99) <= e:
                continue
            best[n] = e
            for child in self.by_id[n].children.values():
                if e + 1 <= child.edits:
                    todo.append((id(child), e + 1))
        return frozenset(best.items())

    def _state(self, pairs: frozenset) -> int:
        if pairs not in self.index:
            self.index[pairs] = len(self.sets)
            self.sets.append(pairs)
            self.moves.append({})
            hits = [(e, self.by_id[n].term) for n, e in pairs if self.by_id[n].term >= 0 and e <= next(k for m, k in EDITS if len(self.terms[self.by_id[n].term][0]) >= m)]
            e, term = min(hits, default=(0, -1))
            self.accepts.append((term, e))
            self.stems.append(max((self.by_id[n].stem for n, e in pairs if e == 0), default=-1))
        return self.index[pairs]

    def _move(self, s: int, c: str) -> int:
        out: set = set()
        for n, e in self.sets[s]:
            node = self.by_id[n]
            if c in node.children:
                out.add((id(node.children[c]), e))
            if e + 1 <= node.edits:
                out.add((n, e + 1))
            for child in node.children.values():
                if e + 1 <= child.edits:
                    out.add((id(child), e + 1))
        to = self._state(self._close(out)) if out else -1
        self.moves[s][c] = to
        return to

    def match(self, word: str) -> tuple[int, int]:
        """(term, edits) of the nearest whole word, else of the longest beginning; (-1, 0) for none."""
        if len(self.sets) > self.most:
            self._clear()
        s, stem, moves = self.start, -1, self.moves
        for c in word:
            to = moves[s].get(c)
            if to is None:
                to = self._move(s, c)
            if to < 0:
                return stem, 0  # no whole word is near any more
            s = to
            if self.stems[s] >= 0:
                stem = self.stems[s]
        term, e = self.accepts[s]
        return (term, e) if term >= 0 else (stem, 0)


@dataclass
class Model:
    terms: list[tuple[str, bool]]
    weights: list[float]
    coef: list[float]
    prior: float = 0.0
    discount: float = QUOTED_SHARE
    own_words: frozenset[str] = frozenset()  # near forms that are words of their own

    def __post_init__(self) -> None:
        self.trie: FuzzyTrie | None = None
        self.seen: dict[str, tuple[int, int]] = {}

    def match(self, word: str) -> tuple[int, int]:
        if self.trie is None:
            self.trie = FuzzyTrie(self.terms)
        m = self.trie.match(word)
        if m[0] < 0 and not word.isalpha() and not word.isdigit():
            m = self.trie.match(word.translate(_STANDS_FOR))
        return (-1, 0) if m[1] and word in self.own_words else m

    def matches(self, low: str) -> list[tuple[int, int, int, int, bool]]:
        """(word number, term, edits, character position, whether a reporting word stands right before) of all matches."""
        words = _WORD.findall(low)
        seen, new = self.seen, set(words)
        if len(seen) > 300_000:
            seen.clear()
        found = {}
        for w in new:
            m = seen.get(w)
            if m is None:
                m = seen[w] = self.match(w)
            if m[0] >= 0:
                found[w] = m
        if not found:
            return []
        return [(i, *found[m[0]], m.start(), not REPORTING.isdisjoint(words[max(0, i - 3) : i])) for i, m in enumerate(_WORD.finditer(low)) if m[0] in found]

    def evidence(self, text: str | None) -> tuple[list[float], int, int, int]:
        """Sums over the matches, quoted ones apart; the numbers of matches, of fuzzy and of quoted ones."""
        low = (text or "").lower()
        hits = self.matches(low)
        if not hits:
            return [0.0] * 8, 0, 0, 0
        plain = quoted = close = best = best_quoted = 0.0
        n_quoted = n_fuzzy = 0
        inside = quoted_at(low, [h[3] for h in hits])
        is_quoted = [q or h[4] for q, h in zip(inside, hits, strict=True)]
        for i, (at, term, edits, _, _) in enumerate(hits):
            w = self.weights[term] / (1 + edits)
            n_fuzzy += edits > 0
            if is_quoted[i]:
                n_quoted += 1
                quoted += w
                best_quoted = max(best_quoted, w)
                continue
            plain += w
            best = max(best, w)
            close += w * ((i > 0 and at - hits[i - 1][0] <= WINDOW) or (i + 1 < len(hits) and hits[i + 1][0] - at <= WINDOW))
        open_terms = {h[1] for h, q in zip(hits, is_quoted, strict=True) if not q}
        n_words = max(1, low.count(" ") + low.count("\n") + 1)
        return [plain, quoted, close, best, best_quoted, float(len(open_terms)), float(len({h[1] for h in hits} - open_terms)), float(n_words)], len(hits), n_fuzzy, n_quoted

    def score(self, raw: list[float]) -> float:
        z = self.coef[0] + sum(c * v for c, v in zip(self.coef[1:], figures(raw, self.discount), strict=True)) if self.coef else self.prior
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def figures(raw: list[float], discount: float) -> list[float]:
    """What the regression sees of the sums, with quoted matches at a discount."""
    if not raw[0] and not raw[1]:
        return [0.0] * 6
    plain, quoted, close, best, best_quoted, n_open, n_quoted, n_words = raw
    sum_ = plain + discount * quoted
    best = max(best, discount * best_quoted)
    return [min(1.0, best / LEAST_WEIGHT), math.log1p(sum_), math.log1p(close), best, math.log1p(n_open + discount * n_quoted), math.log1p(100 * sum_ / n_words)]


#: What closes an opening mark.
_CLOSES = {'"': '"', "“": "”", "„": "“”", "«": "»", "‘": "’"}
_MARKS = re.compile("[\n\"“”„«»‘’]")


def quoted_at(text: str, at: list[int]) -> list[bool]:
    """Whether each of the ascending positions lies in a quotation that opens and closes in its line. One walk over the marks.

    A straight mark opens where no letter or digit stands before it (inches do not), ‘ likewise, and ’ closes where no letter follows
    (apostrophes do not). What never closes in its line is no quotation.
    """
    out, n, first, mark = [False] * len(at), 0, 0, ""
    for m in _MARKS.finditer(text):
        if n == len(at) and not mark:
            break
        c, i = m[0], m.start()
        while n < len(at) and at[n] < i:
            n += 1
        if c == "\n":
            mark = ""
        elif mark:
            if c in _CLOSES[mark] and not (c == "’" and text[i + 1 : i + 2].isalpha()):
                out[first:n] = [True] * (n - first)
                mark = ""
        elif c in _CLOSES and not (c in "\"‘" and i and text[i - 1].isalnum()):
            mark, first = c, n
    return out


def sketch_of(text: str) -> int:
    """The least hash of the three-word windows: near copies mostly share it."""
    w = text.split()
    return min((xxhash.xxh3_64_intdigest(" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))), default=0) - (1 << 63)


def _grams(text: str) -> set[str]:
    words = set(_WORD.findall(text.lower()))
    return {"=" + w for w in words if len(w) > 2} | {w[:k] for w in words for k in STEMS if len(w) > k}


def _counts(rows: DataFrame, keep: set[str] | None) -> DataFrame:
    """(gram, n): texts that have a word or beginning; only those of keep, if given."""
    shared = rows.sparkSession.sparkContext.broadcast(keep)

    def run(pieces: Iterator[dict]) -> Iterator[dict]:
        sums: Counter = Counter()
        for p in pieces:
            for text in p["text"]:
                g = _grams(text or "")
                sums.update(g if shared.value is None else g & shared.value)
            if len(sums) > 500_000:
                yield {"gram": list(sums), "n": list(sums.values())}
                sums.clear()
        yield {"gram": list(sums), "n": list(sums.values())}

    return map_arrow(rows.select("text"), run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def learnable(docs: DataFrame, labels: DataFrame, label: str, bound: int, keys: tuple[str, ...] = ("text",)) -> DataFrame:
    """A bounded sample, chosen by hash, of the labelled rows that may be learned from: keys, y, and the half it belongs to."""
    known = labels.filter(F.col(label).isNotNull() & (split_of(F.col("doc_id")) != 2)).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    known = cut(known)
    share = sample_share(known.count(), bound)
    known = cut(known.filter(hash_share(F.col("doc_id"), share, 11)))
    # at most about `bound` rows of two numbers: the bound is what makes this broadcast safe
    out = docs.select("doc_id", *keys).join(F.broadcast(known), "doc_id")
    return out.withColumn("half", F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(2)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> list[float]:
    """Newton's method with a ridge on all but the constant."""
    x = np.c_[np.ones(len(x)), x]
    w, r = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    r[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(r), x.T @ (y - p) - r * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def fit_monotone(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> list[float]:
    """A logistic regression whose coefficients, but for the constant, are not negative: the most negative is left out until none is."""
    use = list(range(x.shape[1]))
    while True:
        got = fit_logistic(x[:, use], y, ridge)
        worst = min(range(len(use)), key=lambda i: got[i + 1], default=None)
        if worst is None or got[worst + 1] >= 0:
            break
        del use[worst]
    out = [got[0]] + [0.0] * x.shape[1]
    for i, c in zip(use, got[1:], strict=True):
        out[i + 1] = c
    return out


def fit_context(raw: list[list[float]], y: list[int]) -> tuple[list[float], float]:
    """(coefficients, discount of quoted matches): of the shares tried the likeliest, with a pull towards QUOTED_SHARE."""
    target, best = np.array(y, float), None
    for d in SHARES if any(r[1] for r in raw) else (QUOTED_SHARE,):
        x = np.array([figures(r, d) for r in raw])
        coef = fit_monotone(x, target)
        z = np.clip(coef[0] + x @ np.array(coef[1:]), -30, 30)
        fit = float((target * z - np.logaddexp(0, z)).sum()) - HOLD * math.log(d / QUOTED_SHARE) ** 2
        if best is None or fit > best[0] + 1e-9:
            best = (fit, coef, d)
    return best[1], best[2]


def lexicon(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> list[tuple[str, float]]:
    """(gram, weight) of the terms, from the numbers of toxic and clean documents that have each gram.

    A gram's likelihood ratio against the share of toxic documents must pass the level at which among all candidates a false one is
    found with a chance of FALSE_TERMS. A beginning is taken beside whole words if it stands in a fifth
    more toxic documents than each; of beginnings of one another the likeliest first, a longer one beside it if its weight is greater
    by PURER, a shorter one if it stands in a fifth more toxic documents.
    """
    share, level, weight, ratio = n_toxic / (n_toxic + n_clean), math.log(max(1, len(toxic)) / FALSE_TERMS), {}, {}
    for g, a in toxic.items():
        b = clean.get(g, 0)
        w = math.log((a + 0.5) / (n_toxic + 1)) - math.log((b + 0.5) / (n_clean + 1))
        r = a * math.log(a / ((a + b) * share)) + (b * math.log(b / ((a + b) * (1 - share))) if b else 0.0)
        if w >= LEAST_WEIGHT and r >= level:
            weight[g], ratio[g] = w, r
    order = sorted(weight, key=lambda g: (-ratio[g], g))
    words = [g for g in order if g[0] == "="]
    most: dict[str, int] = {}
    for g in words:
        for k in STEMS:
            most[g[1 : k + 1]] = max(most.get(g[1 : k + 1], 0), toxic[g])
    stems: list[str] = []
    for g in order:
        longer_is_no_purer = any(g.startswith(x) and weight[g] < weight[x] + PURER for x in stems)
        if g[0] != "=" and toxic[g] * 5 >= 6 * most.get(g, 0) and not longer_is_no_purer and not any(x.startswith(g) and toxic[g] * 5 < 6 * toxic[x] for x in stems):
            stems.append(g)
    return [(g, weight[g]) for g in words + stems]


def train(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> Model:
    spark = docs.sparkSession
    rows = learnable(docs, labels, "toxic", bound)

    def slim(pieces: Iterator[dict]) -> Iterator[dict]:
        for p in pieces:
            yield {"doc_id": p["doc_id"], "text": p["text"], "y": p["y"], "half": p["half"], "sketch": [sketch_of(t or "") for t in p["text"]]}

    # a bounded sample: its texts are kept once, for the passes below
    rows = map_arrow(rows.select("doc_id", "text", "y", "half"), slim, "doc_id long, text string, y int, half long, sketch long")
    rows = rows.groupBy("sketch", "y").agg(F.min(F.struct("doc_id", "half", "text")).alias("r")).select("r.text", "y", "r.half")
    rows = cut(rows)
    per = {(r["half"], r["y"]): r["n"] for r in rows.groupBy("half", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = per.get((0, 1), 0), per.get((0, 0), 0)
    toxic, clean = sum(n for (_, y), n in per.items() if y == 1), sum(n for (_, y), n in per.items() if y == 0)
    prior = math.log((toxic + 0.5) / (clean + 0.5))
    if not n_toxic or not n_clean or not per.get((1, 1)) or not per.get((1, 0)):
        return Model([], [], [], prior)
    # grams of two or more toxic documents of the bounded sample, and their clean documents
    there = dict(_counts(rows.filter("half = 0 and y = 1"), None).filter("n >= 2").collect())
    other = dict(_counts(rows.filter("half = 0 and y = 0"), set(there)).collect())
    terms = lexicon(there, other, n_toxic, n_clean)
    model = Model([(g.removeprefix("="), g[0] != "=") for g, _ in terms], [w for _, w in terms], [], prior)
    model.own_words = own_words(rows.filter("half = 0"), model, n_toxic, n_clean)
    shared = spark.sparkContext.broadcast(model)

    def measure(pieces: Iterator[dict]) -> Iterator[dict]:
        for p in pieces:
            yield {"x": [shared.value.evidence(t)[0] for t in p["text"]], "y": p["y"]}

    # the bounded sample's other half; in a fixed order, as sums of floating point depend on it
    got = sorted(map_arrow(rows.filter("half = 1").select("text", "y"), measure, "x array<double>, y int").collect())
    model.coef, model.discount = fit_context([list(r["x"]) for r in got], [r["y"] for r in got])
    return model


def own_words(rows: DataFrame, model: Model, n_toxic: int, n_clean: int) -> frozenset[str]:
    """Near forms of terms that two or more clean documents of the bounded sample use, and toxic ones not tellingly more often."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def near(pieces: Iterator[dict]) -> Iterator[dict]:
        m = shared.value
        for p in pieces:
            out = {"form": [], "y": []}
            for text, y in zip(p["text"], p["y"], strict=True):
                for w in set(_WORD.findall((text or "").lower())):
                    if w not in m.seen:
                        m.seen[w] = m.match(w)
                    if m.seen[w][1]:
                        out["form"].append(w)
                        out["y"].append(y)
            yield out

    forms = map_arrow(rows.select("text", "y"), near, "form string, y int").groupBy("form").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    ratio = (F.col("a") + 0.5) / (n_toxic + 1) / ((F.col("b") + 0.5) / (n_clean + 1))
    return frozenset(r["form"] for r in forms.filter((F.col("b") >= 2) & (ratio < math.exp(LEAST_WEIGHT))).select("form").collect())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and the numbers of matches for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(pieces: Iterator[dict]) -> Iterator[dict]:
        m = shared.value
        for p in pieces:
            out = {k: [] for k in ("doc_id", "score", "n_matches", "n_fuzzy", "n_quoted")}
            for doc_id, text in zip(p["doc_id"], p["text"], strict=True):
                raw, *n = m.evidence(text)
                for k, v in zip(out, (doc_id, m.score(raw), *n), strict=True):
                    out[k].append(v)
            yield out

    return map_arrow(docs.select("doc_id", "text"), run, SCORED)


def classify(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted and match counts for every row of docs."""
    out = score(docs, train(docs, labels, bound))
    held = F.coalesce(split_of(F.col("doc_id")) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_matches", "n_fuzzy", "n_quoted")
