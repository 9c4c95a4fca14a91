"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

A text is the set of its five-word shingles. Each of TREES prefix tries holds every text under a label of DEPTH MinHash values, a byte
each; sorted by label, the texts below a trie node are one stretch. The matched prefix starts at the full depth and is shortened, level by
level, until the pairs found so far say that the target recall is met: each pair of similarity s, estimated from sketches, was to be found
with probability 1 - (1 - s^d)^TREES at depth d, so that the found pairs over the sum of their reciprocals estimate the recall. The
shortest prefix that can be asked for is the one at which a pair at the threshold itself meets the target; texts that share not even
that prefix with another are put aside first.

Exact copies become one node first, so that their number never matters. In a trie stretch every text is first tied to the smallest id,
a number of ties linear in the texts, kept if the estimate from the sketches is within MARGIN of the threshold; tied texts form a loose
group, found by distributed label passing. Where the texts of a stretch then lie in more than one group, all its pairs across groups are
compared by their sketches, in blocks, and a pair within MARGIN joins its groups. So every pair of every stretch is in one loose group, or
compared and found apart. Within a loose group every pair is verified on the exact shingle sets, as products of sparse blocks of bounded
numbers of texts and shingles; a group of many blocks is dealt out by pairs of blocks, and no pair is ever a row: a block gives the number
of links of each text and a spanning forest of the links. The links found give the classes.

Defined cases. Null and empty texts and texts without words have no shingles, and no links but to their copies (all count as equal).
A text of one to four words is one shingle. Copies (equal texts) link to one another. Rows with a null id are kept, unlinked,
with a null class. Rows that repeat an id are one document. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, discard, map_arrow, quoted, written

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
N, THRESHOLD = 5, 0.8
#: Tries, length of labels, and the recall aimed at.
TREES, DEPTH, RECALL = 32, 10, 0.999
#: Sketch values (one byte each); texts and shingles of a verification block.
SKETCH, BLOCK, BLOCK_SHINGLES = 96, 256, 1 << 20
#: How far below the threshold the estimate of a linked pair may fall: five standard deviations at 0.8.
MARGIN = 0.2
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def shortest_prefix(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which a pair at the threshold meets in some tree with the target probability: none shorter is needed."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def shingles(text: str | None, n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; the whole of a shorter text is one."""
    words = WORDS.findall(text or "")
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(n, len(words))
    out = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        out = (out ^ (out >> np.uint64(29))) * _PRIME + h[i : i + len(out)]
    return np.unique(out)


def _seeds(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240101)
    return rng.integers(1, 1 << 32, count, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, count, np.uint32)


def minhashes(sh: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the set, in slabs of bounded size."""
    low = ((sh ^ (sh >> np.uint64(32))) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 512):
        x = low[None, i : i + 512] ^ b[:, None]
        x *= a[:, None]
        np.minimum(out, x.min(1), out=out)
    return out


SIGNED = "doc_id long, h1 long, h2 long, n long, labels array<binary>, sketch binary"


def signatures(docs: DataFrame, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """One row for each row of docs: the text's 128-bit hash, the number of shingles, a label for each tree, a sketch."""
    a, b = _seeds(trees * depth + SKETCH)

    def run(pieces: Iterator[dict]) -> Iterator[dict]:
        for p in pieces:
            out = {k: [] for k in ("doc_id", "h1", "h2", "n", "labels", "sketch")}
            for doc_id, text in zip(p["doc_id"], p["text"], strict=True):
                sh = shingles(text)
                key = xxhash.xxh3_128_intdigest(text or "") if len(sh) else 0
                labels, sketch = None, None
                if len(sh):
                    m = (minhashes(sh, a, b) & np.uint32(255)).astype(np.uint8).tobytes()
                    labels = [m[i * depth : (i + 1) * depth] for i in range(trees)]
                    sketch = m[trees * depth :]
                for k, v in zip(out, (doc_id, (key >> 64) - (1 << 63), (key & ((1 << 64) - 1)) - (1 << 63), len(sh), labels, sketch), strict=True):
                    out[k].append(v)
            yield out

    return map_arrow(docs.select("doc_id", "text"), run, SIGNED)


def _agreement(x: str, y: str):
    """Share of equal sketch bytes, corrected for those equal by chance."""
    return F.expr(f"(aggregate(sequence(1, {SKETCH}), 0, (s, i) -> s + if(substring({x}, i, 1) = substring({y}, i, 1), 1, 0)) / {SKETCH}D - 1D/256) / (1 - 1D/256)")


def leaves(nodes: DataFrame, shortest: int) -> DataFrame:
    """(tree, label, node) of the texts that share at least the shortest prefix of a tree with another text."""
    rows = nodes.select("node", F.posexplode("labels").alias("tree", "label")).withColumn("prefix", F.substring("label", 1, shortest))
    many = rows.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k")
    return rows.join(many, ["tree", "prefix"]).select("tree", "label", "node")


def stretches(held: DataFrame, depth: int) -> DataFrame:
    """(tree, prefix, node, a, k): the texts of every trie stretch of k > 1 texts at this depth, with its smallest id."""
    rows = held.withColumn("prefix", F.substring("label", 1, depth)).drop("label")
    first = rows.groupBy("tree", "prefix").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    return rows.join(first, ["tree", "prefix"])


def tied(held: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, s), a < b: each text and the smallest id of a trie stretch that it lies in, with the estimate of their similarity."""
    ties = held.filter("node <> a").select("a", F.col("node").alias("b")).distinct()
    s = nodes.select("node", "sketch")
    ties = ties.join(s.withColumnsRenamed({"node": "a", "sketch": "sa"}), "a").join(s.withColumnsRenamed({"node": "b", "sketch": "sb"}), "b")
    return ties.select("a", "b", _agreement("sa", "sb").alias("s"))


def matched(nodes: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[DataFrame, DataFrame, int]:
    """(stretches, ties with their estimates, depth): the prefix is shortened from the full depth until the target recall."""
    shortest = shortest_prefix(threshold, recall=recall)
    held = written(leaves(nodes, shortest), "forest-leaves")
    for depth in range(DEPTH, shortest - 1, -1):
        found = stretches(held, depth)
        ties = cut(tied(found, nodes))
        met = 1 - F.pow(1 - F.pow(F.least("s", F.lit(1.0)), F.lit(depth)), F.lit(TREES))
        n, expected = ties.filter(F.col("s") >= threshold).agg(F.count(F.lit(1)), F.sum(1 / met)).first()
        if depth == shortest or (n and n >= recall * expected):
            found = written(found, "forest-stretches")
            discard(held)
            return found, ties, depth
    raise AssertionError


def _alike(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Which sketches of x agree with which of y, corrected as in _agreement, in at least this share."""
    equal = np.zeros((len(x), len(y)), np.uint8)
    for p, q in zip(x.T, y.T, strict=True):
        equal += p[:, None] == q[None, :]
    return equal >= SKETCH * (least * (1 - 1 / 256) + 1 / 256) - 1e-6


def group_ties(held: DataFrame, placed: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """(a, b): groups that a pair of a stretch joins, of all pairs whose texts lie in different groups.

    held: stretches of matched(); placed: node, component, sketch. A stretch of at most block texts is one unit; a larger one is a unit for each
    pair of its blocks. A unit gives a spanning forest of the groups that it joins.
    """
    rows = held.filter("k > 2").select("tree", "prefix", "node").join(placed.select("node", "component"), "node")
    mixed = rows.groupBy("tree", "prefix").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    units = rows.join(mixed.filter("lo <> hi").select("tree", "prefix", "parts"), ["tree", "prefix"])
    units = units.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    units = units.select("tree", "prefix", "node", "component", "part", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"))

    def run(key, table):
        import pyarrow as pa

        part, group = (table.column(c).to_numpy() for c in ("part", "component"))
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
        left, right = (np.flatnonzero(part == k.as_py()) for k in key[2:4])
        out: list[tuple[int, int]] = []
        if len(left) and len(right):
            apart = group[left][:, None] != group[right][None, :]
            if apart.any():
                x, y = np.nonzero(apart & _alike(sketch[left], sketch[right], least))
                pairs = np.unique(np.sort(np.c_[group[left[x]], group[right[y]]], axis=1), axis=0)
                parent: dict[int, int] = {}
                for a, b in pairs.tolist():
                    a, b = _root(parent, a), _root(parent, b)
                    if a != b:
                        parent[max(a, b)] = min(a, b)
                        out.append((min(a, b), max(a, b)))
        return pa.table([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return units.join(placed.select("node", "sketch"), "node").groupBy("tree", "prefix", "i", "j").applyInArrow(run, "a long, b long").distinct()


def loose_groups(nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, component): the loose groups of more than one text."""
    held, ties, _ = matched(nodes, threshold)
    least = threshold - MARGIN
    grouped = cut(components(ties.filter(F.col("s") >= least).select("a", "b")))
    is_tied = F.col("component").isNotNull().alias("tied")
    placed = nodes.join(grouped, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "sketch", is_tied)
    ties = cut(group_ties(held, placed, least))
    discard(held)
    if ties.isEmpty():
        return grouped
    roots = components(ties).select(F.col("node").alias("component"), F.col("component").alias("root"))
    out = placed.drop("sketch").join(roots, "component", "left").filter("tied or root is not null")
    return out.select("node", F.coalesce("root", "component").alias("component"))


def _root(parent: dict[int, int], x: int) -> int:
    while parent.setdefault(x, x) != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each connected component; alternating star passes to the fixed point, each kept in the
    shared folder.

    A pass ties every node to the smallest of its neighbourhood: first the larger neighbours (large star), then the smaller ones
    (small star). Minima are combined before their shuffle, and the joins back are on keys whose one side has a row each.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.col("b").alias("a"), F.col("a").alias("b"))
        # kept, so that both sides of the join are plain shuffles: adaptive execution can then split the rows of a hub
        least = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")))
        out = both.join(least, "a")
        if large:
            out = out.filter("b > a").select(F.col("m").alias("x"), F.col("b").alias("y"))
        else:
            out = out.select(F.col("m").alias("x"), F.col("b").alias("y")).unionByName(least.select(F.col("m").alias("x"), F.col("a").alias("y")))
        return out.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    e = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    state = None
    while True:
        e = cut(star(star(e, True), False))
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    roots = e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return e.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots)


def _jaccard_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sets a with sets b: sparse columns as dense slabs of bounded width."""
    keys = np.concatenate([*a, *b])
    owner = np.repeat(np.arange(len(a) + len(b)), [*map(len, a), *map(len, b)])
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    new = np.r_[True, keys[1:] != keys[:-1]]
    col = new.cumsum() - 1
    shared = np.bincount(col)[col] > 1
    owner, col = owner[shared], col[shared]
    out = np.zeros((len(a), len(b)), np.float32)
    if len(col):
        _, col = np.unique(col, return_inverse=True)
    width = 2048
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        i, j = np.searchsorted(col, [lo, lo + width])
        m = np.zeros((len(a) + len(b), width), np.float32)
        m[owner[i:j], col[i:j] - lo] = 1
        out += m[: len(a)] @ m[len(a) :].T
    return out


LINKS = "node long, links long, other long"


def _verify(members: dict[int, list], threshold: float) -> tuple[list, list, list]:
    """Of one pair of blocks: for each text its links (documents), and edges of a spanning forest."""
    if len(members) == 1:
        (left,) = members.values()
        right, same = left, True
    else:
        left, right = (members[k] for k in sorted(members))
        same = False
    inter = _jaccard_counts([m[2] for m in left], [m[2] for m in right])
    na, nb = (np.array([len(m[2]) for m in s], np.float32) for s in (left, right))
    linked = inter >= np.float32(threshold) * (na[:, None] + nb[None, :] - inter) - np.float32(1e-3)
    if same:
        np.fill_diagonal(linked, False)
    wa, wb = (np.array([m[1] for m in s], np.int64) for s in (left, right))
    nodes, links, other = [], [], []
    for side, count in ((left, linked @ wb),) if same else ((left, linked @ wb), (right, linked.T @ wa)):
        at = np.flatnonzero(count)
        nodes += [side[i][0] for i in at]
        links += [int(count[i]) for i in at]
        other += [None] * len(at)
    parent: dict[int, int] = {}

    for i, j in zip(*np.nonzero(np.triu(linked) if same else linked), strict=True):
        x, y = _root(parent, left[i][0]), _root(parent, right[j][0])
        if x != y:
            parent[max(x, y)] = min(x, y)
    for x in list(parent):
        if (r := _root(parent, x)) != x:
            nodes.append(x)
            links.append(0)
            other.append(r)
    return nodes, links, other


def verified(members: DataFrame, texts: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(node, links, other): exact links of each text within its loose group, and a spanning forest of them.

    members: node, component, copies, n (shingles); texts: node, text. A group of at most block texts and block_shingles shingles is one
    unit; a larger one is a unit for each pair of its blocks, in which each text appears once for each other block.
    """
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"))
    parts = F.greatest(F.ceil(F.col("size") / block), F.ceil(F.col("shingles") / block_shingles)).cast("int")
    placed = members.join(sizes, "component").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    units = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    units = units.select("node", "component", "copies", "part", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"))

    def run(key, table):
        import pyarrow as pa

        rows: dict[int, dict] = {}
        for node, copies, part, text in zip(*(table.column(c).to_pylist() for c in ("node", "copies", "part", "text")), strict=True):
            own = rows.setdefault(part, {})
            got = shingles(text)
            own[node] = (node, copies, got if node not in own else np.union1d(own[node][2], got))
        want = {key[1].as_py(), key[2].as_py()}
        out = ([], [], []) if set(rows) != want else _verify({k: sorted(v.values(), key=lambda m: m[0]) for k, v in rows.items()}, threshold)
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["node", "links", "other"])

    return units.join(texts.select("node", "text"), "node").groupBy("component", "i", "j").applyInArrow(run, LINKS)


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs: doc_id, class_id (smallest id of its class), text_id (smallest id with this text), n_links (other documents linked to it)."""
    signed = written(signatures(docs), "forest-signatures")
    known = signed.filter("doc_id is not null")
    # copies meet by the hash of their text; minima are combined before the shuffle
    ids = known.select("doc_id", "h1", "h2").distinct()
    texts = cut(ids.groupBy("h1", "h2").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies")))
    nodes = known.filter("n > 0").select("h1", "h2", "doc_id", "n", "labels", "sketch").join(texts, ["h1", "h2"]).filter("doc_id = node")
    nodes = written(nodes.dropDuplicates(["node"]).select("node", "copies", "n", "labels", "sketch"), "forest-nodes")
    grouped = cut(loose_groups(nodes, threshold))
    members = cut(grouped.join(nodes.select("node", "copies", "n"), "node"))
    discard(nodes)
    found = cut(verified(members, docs.select(F.col("doc_id").alias("node"), "text"), threshold))
    links = found.filter("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    linked = components(found.filter("other is not null").select(F.col("other").alias("a"), F.col("node").alias("b")))
    per = texts.join(linked, "node", "left").join(links, "node", "left")
    per = per.select("h1", "h2", F.col("node").alias("text_id"), F.coalesce("component", "node").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = known.select("doc_id", "h1", "h2").join(per, ["h1", "h2"]).select("doc_id", "class_id", "text_id", "n_links")
    nulls = signed.filter("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("long").alias("text_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(nulls)


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the documents that have another representative: the smallest id of each class stays, and every row without an id."""
    gone = classes(docs, threshold).filter("class_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*quoted(docs))
