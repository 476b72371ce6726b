"""Near-duplicate documents: order MinHash over five-word shingles, then banded alignment.

A sketch takes the three least of a document's occurrence-labelled shingles
under its own hash and keeps them in text order, so two documents share a
sketch only where the same shingles stand in the same order. Documents that
share one of 32 sketches are candidates. They are linked if the Jaccard
similarity of their labelled shingles is 0.8 or more, or if their word
sequences align with an edit similarity (1 - edits / longer length) of 0.9 or
more: a few changed words spoil many shingles, while a long passage that
different documents share does not make them alike. Two texts of shingle similarity
J share a given sketch with probability about J ** 3: of J 0.6 all but 1 in
2,000 pairs share one, of J 0.8 practically all.

Copies (equal word sequences) count as one node. Every node is first aligned
with one leader (a bucket's shortest of about its length, of which most buckets
agree); then with those of its leaders that are in other components. What that leaves apart is paired, in buckets
of all sizes, wherever the rarest shingles meet: two sets of similarity 0.8
share one of their rarest fifth (and one more). An edit changes three shingles
of three words at most and moves the others by one place, so texts of edit
similarity 0.9 share one of the rarest three tenths of those (and one more), at
places that differ by a tenth of their length at most. So no such pair is lost,
and a frequent passage makes none. The nodes of such a shingle meet a few
leaders first, four for shingles of five words and for those of three, among
them the node with the fewest shingles of its own: in a family of edited copies of one text most are linked with
that, so hardly any node is left apart from the others when all are compared. Then bitmaps
of their shingles or words tell, without loss, which of such pairs differ by more than a link
allows; only the others are aligned. No pair
within a component is made, no bucket is cut off. Components are found by
alternating stars.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, REMEMBERED, Store, keyed, remember_only, tune

WORDS, SKETCHES, TAKEN, SIMILARITY, EDIT = 5, 32, 3, 0.8, 0.9
#: Shingles of so many words are counted for edit links.
SHORT = 3
#: Longs of a marks bitmap.
MARKS = 16
#: Word counts of one step of length differ by this factor at most.
STEP = 1.12
SEEDS = np.random.Generator(np.random.PCG64(11)).integers(1, 2**63, (SKETCHES, 2), np.uint64) | np.uint64(1)
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
find_words = re.compile(r"\w+").findall


class Vocabulary(dict):
    """64-bit fingerprints of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        self[word] = x = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return x


VOCABULARY = Vocabulary()
REMEMBERED["words"] = VOCABULARY.clear


def fingerprints(text: str) -> np.ndarray:
    """A fingerprint for each word: runs of letters, digits and underscores, in lower case."""
    return np.array([VOCABULARY[w] for w in find_words(text.lower())], np.uint64)


def shingles(words: np.ndarray, k: int = WORDS) -> np.ndarray:
    """Hashes of the shingles of k words; shorter texts are one shingle."""
    k = min(k, len(words))
    n = len(words) - k + 1
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = (h ^ words[i : i + n]) * M1
        h ^= h >> np.uint64(31)
    return h


def labelled_shingles(h: np.ndarray) -> np.ndarray:
    """The hashes with the number of earlier occurrences worked in, so that each is there once; first ones stay as they are."""
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    new = np.ones(len(h), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    if new.all():
        return h
    begin = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    occurrence = np.empty(len(h), np.uint64)
    occurrence[order] = (np.arange(len(h)) - begin).astype(np.uint64)
    return np.where(occurrence > 0, (h ^ occurrence * M2) * M1, h)


def marks(h: np.ndarray) -> np.ndarray:
    """MARKS longs with a bit for each place that an odd number of these hashes fall on: two sets differ by as many hashes as their bits do, at least."""
    x = h * M2
    x ^= x >> np.uint64(32)
    x *= M1
    bits = np.bincount((x >> np.uint64(32)).astype(np.int64) % (64 * MARKS), minlength=64 * MARKS).astype(np.uint8) & 1
    return np.packbits(bits).view(np.int64)


def least(x: np.ndarray, taken: int) -> np.ndarray:
    """The places of the least entries of each row."""
    n = x.shape[1]
    if taken == n:
        return np.broadcast_to(np.arange(n), x.shape)
    if n > 64:
        # among the few that are under a bound, nearly always enough
        row, col = np.nonzero(x < np.uint64(12 * (2**64 // n)))
        count = np.bincount(row, minlength=len(x))
        if count.min() >= taken:
            order = np.lexsort((x[row, col], row))
            return col[order[(np.cumsum(count) - count)[:, None] + np.arange(taken)]]
    return np.argpartition(x, taken - 1, axis=1)[:, :taken]


def sketches(words: np.ndarray) -> np.ndarray:
    """SKETCHES hashes, each of the least shingles of one order, kept in text order."""
    labelled = labelled_shingles(shingles(words))
    taken = min(TAKEN, len(labelled))
    places = np.empty((SKETCHES, taken), np.int64)
    step = max(1, 1_000_000 // len(labelled))
    for at in range(0, SKETCHES, step):
        seed = SEEDS[at : at + step]
        x = (labelled ^ seed[:, :1]) * seed[:, 1:]
        x ^= x >> np.uint64(32)
        x *= M2
        places[at : at + step] = least(x, taken)
    places.sort(axis=1)
    out = SEEDS[:, 0].copy()
    for i in range(taken):
        out = (out ^ labelled[places[:, i]]) * M1
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each document its node (fingerprint of its words; of its text, if it has none), word count and sketches."""
    import xxhash

    remember_only("words")
    for b in batches:
        known: dict[int, np.ndarray | None] = {}
        rows = []
        for d, th, text in zip(b.d, b.th, b.text):
            words = fingerprints(text)
            node = xxhash.xxh3_64_intdigest(words.tobytes() if len(words) else text.encode("utf-8", "surrogatepass"), 1)
            if node not in known:
                known[node] = sketches(words) if len(words) else None
            rows.append((d, th, node - (node >> 63 << 64), len(words), known[node]))
        yield pd.DataFrame(rows, columns=["d", "th", "node", "n", "sketch"])


def edits(pairs: list[tuple[np.ndarray, np.ndarray, int]], band: int = 16) -> np.ndarray:
    """Word edit distances, exact up to each pair's bound and otherwise over it, in a band around the diagonal (at first of this width), many pairs at once."""
    out = np.zeros(len(pairs), np.int64)
    todo = []
    for i, (a, b, most) in enumerate(pairs):
        if abs(len(a) - len(b)) > most:
            out[i] = most + 1
            continue
        n = min(len(a), len(b))
        ne = np.flatnonzero(a[:n] != b[:n])
        s = int(ne[0]) if len(ne) else n
        ne = np.flatnonzero(a[::-1][: n - s] != b[::-1][: n - s])
        e = int(ne[0]) if len(ne) else n - s
        a, b = a[s : len(a) - e], b[s : len(b) - e]
        if not len(a) or not len(b):
            out[i] = max(len(a), len(b))
        else:
            todo.append((i, a, b, most))
    while todo:
        todo.sort(key=lambda x: len(x[1]))
        again = []
        at = 0
        while at < len(todo):
            # pairs of about the same length go together
            first, z = len(todo[at][1]), at + 1
            most = max(1, min(64, 2_000_000 // (first + 4 * min(band, todo[at][3]))))
            while z < len(todo) and z - at < most and len(todo[z][1]) <= 1.25 * first + 16:
                z += 1
            some, at = todo[at:z], z
            k = min(band, max(x[3] for x in some))
            for x, d in zip(some, aligned([(a, b) for _, a, b, _ in some], k)):
                if d <= min(k, x[3]) or k >= x[3]:
                    out[x[0]] = d
                else:
                    again.append(x)
        todo, band = again, band * 4
    return out


def aligned(pairs: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """Edit distances by rows of a band of 2 k + 1 diagonals; over k where the band is too narrow."""
    n, m = np.array([len(a) for a, _ in pairs]), np.array([len(b) for _, b in pairs])
    rows, width = int(n.max()), 2 * k + 1
    A = np.zeros((len(pairs), rows), np.uint64)
    B = np.zeros((len(pairs), rows + width), np.uint64)
    for i, (a, b) in enumerate(pairs):
        A[i, : len(a)] = a
        x = b[: rows + width - k]
        B[i, k : k + len(x)] = x
    far = np.int32(4 * (rows + width))
    col = np.arange(width, dtype=np.int32)
    inside = lambda i: (col + i - k >= 0) & (col + i - k <= m[:, None])
    D = np.where(inside(0), col - np.int32(k), far).astype(np.int32)
    out = np.full(len(pairs), k + 1, np.int64)
    shortest = int(m.min())
    for i in range(1, rows + 1):
        # column c stands for the first i words against the first i + c - k
        step = D + (A[:, i - 1 : i] != B[:, i - 1 : i - 1 + width])
        np.minimum(step[:, :-1], D[:, 1:] + np.int32(1), out=step[:, :-1])
        if i <= k:
            step[:, k - i] = i
        if i < k or i + k > shortest:
            step = np.where(inside(i), step, far)
        step -= col
        D = np.minimum.accumulate(step, axis=1)
        D += col
        done = np.flatnonzero(n == i)
        c = m[done] - i + k
        ok = (c >= 0) & (c < width)
        out[done[ok]] = np.minimum(D[done[ok], c[ok]], k + 1)
    return out


def chained(a: np.ndarray, b: np.ndarray, k: int = WORDS) -> int:
    """An upper bound of the edit distance: of a way along shingles of k words that occur once in either text, in the same order."""
    x, y = shingles(a, k), shingles(b, k)
    once = []
    for h in (x, y):
        values, at, count = np.unique(h, return_index=True, return_counts=True)
        once.append((values[count == 1], at[count == 1]))
    _, i, j = np.intersect1d(once[0][0], once[1][0], assume_unique=True, return_indices=True)
    i, j = once[0][1][i], once[1][1][j]
    order = np.argsort(i)
    i, j = i[order], j[order]
    if len(j) and (np.diff(j) <= 0).any():
        # the longest increasing run of places
        tails, ends, before = [], [], np.empty(len(j), np.int64)
        for p, v in enumerate(j.tolist()):
            k = bisect.bisect_left(tails, v)
            before[p] = ends[k - 1] if k else -1
            if k == len(tails):
                tails.append(v)
                ends.append(p)
            else:
                tails[k], ends[k] = v, p
        keep, p = [], ends[-1]
        while p >= 0:
            keep.append(p)
            p = before[p]
        i, j = i[keep[::-1]], j[keep[::-1]]
    i, j = np.concatenate([[0], i, [len(a)]]), np.concatenate([[0], j, [len(b)]])
    di, dj = np.diff(i), np.diff(j)
    total = 0
    for k in np.flatnonzero((di > 1) | (dj > 1) | (di != dj)).tolist():
        p, q, u, v = i[k], j[k], di[k], dj[k]
        m = min(u, v)
        ahead, behind = np.flatnonzero(a[p : p + m] != b[q : q + m]), np.flatnonzero(a[p + u - m : p + u] != b[q + v - m : q + v])
        # alike from the front, from the back, or as much as meets from both
        met = min(m, int(ahead[0]) + m - 1 - int(behind[-1])) if len(ahead) and len(behind) else m
        total += min(len(ahead), len(behind), m - met) + max(u, v) - m
    if di[0] == 1 and dj[0] == 1:
        total += int(a[0] != b[0])
    return total


def similar(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Which pairs are near duplicates: SIMILARITY of their shingles, or EDIT of their words by bounds where these decide, else by alignment."""
    out = np.zeros(len(pairs), bool)
    todo = []
    for i, (a, b) in enumerate(pairs):
        x, y = labelled_shingles(shingles(a)), labelled_shingles(shingles(b))
        common = len(np.intersect1d(x, y, assume_unique=True))
        if common >= SIMILARITY * (len(x) + len(y) - common) - 1e-9:
            out[i] = True
            continue
        longer = max(len(a), len(b))
        most = int((1 - EDIT) * longer + 1e-9)
        if common < max(len(x), len(y)) - WORDS * most:
            continue  # an edit changes WORDS shingles at most
        # words that the other text has no match for each cost an edit
        both = np.concatenate([a, b])
        both.sort()
        _, first = np.unique(both, return_index=True)
        x, y = np.sort(a), np.sort(b)
        u = both[first]
        common = np.minimum(np.searchsorted(x, u, "right") - np.searchsorted(x, u), np.searchsorted(y, u, "right") - np.searchsorted(y, u)).sum()
        if longer - common <= most:
            out[i] = chained(a, b) <= most or chained(a, b, 2) <= most
            if not out[i]:
                todo.append((i, a, b, most))
    if todo:
        # the bounds say that the distance is about the most that is allowed, so narrower bands would be in vain
        d = edits([x[1:] for x in todo], max(x[3] for x in todo))
        for x, e in zip(todo, d):
            out[x[0]] = e <= x[3]
    return out


def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    remember_only()
    for b in batches:
        for at in range(0, len(b), 500):
            some = b.iloc[at : at + 500]
            ok = similar([(np.frombuffer(x, "<u4").astype(np.uint64), np.frombuffer(y, "<u4").astype(np.uint64)) for x, y in zip(some.aw, some.bw)])
            yield some.loc[ok, ["a", "b"]]


def components(edges: DataFrame, store: Store, name: str) -> DataFrame:
    """(node, root): the least node of each node's component, for all nodes that have an edge; by alternating stars."""
    edges = store.write(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), f"{name}0")
    before, k = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        star = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        least = star.groupBy("a").agg(F.min("b").alias("m"))
        star = star.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a > b").distinct()
        edges = store.write(star, f"{name}{k + 1}")
        now = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        store.drop(f"{name}{k}")
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before, k = now, k + 1


def near(n: str, m: str) -> F.Column:
    """Word counts that allow the similarity."""
    return F.least(n, m) >= SIMILARITY * F.greatest(n, m) - 1e-9


def classes(docs: DataFrame, store: Store) -> tuple[DataFrame, DataFrame]:
    """The described documents, and (node, root) for the nodes that have links."""
    found = store.write(docs.mapInPandas(described, "d long, th long, node long, n int, sketch array<long>"), "described")
    nodes = found.groupBy("node").agg(F.min(F.struct("d", "th")).alias("first"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    nodes = store.write(nodes.where("n > 0").select("node", "first.d", "first.th", "n", "sketch"), "nodes")
    keys = nodes.select("node", "n", F.explode("sketch").alias("key"))
    sizes = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    keys = store.write(keys.join(sizes, "key"), "keys")
    store.forget_shuffles()
    # a bucket has a leader for each step of length, the shortest node; nodes meet those of their own step and of what is near below
    step = F.floor(F.log("n") / math.log(STEP))
    leaders = keys.groupBy("key", step.alias("step")).agg(F.min(F.struct("n", "node")).alias("l")).select("key", "step", F.col("l.node").alias("leader"), F.col("l.n").alias("ln"))
    steps = F.explode(F.array(*(step - i for i in range(1 + math.ceil(math.log(1 / SIMILARITY) / math.log(STEP))))))
    stars = keys.withColumn("step", steps).join(leaders, ["key", "step"]).where("node <> leader").where(near("n", "ln"))
    stars = store.write(stars.groupBy(F.col("node").alias("b"), F.col("leader").alias("a")).agg(F.count("*").alias("shared")), "stars")

    used = keys.select("node").distinct().join(nodes.select("node", "d", "th"), "node")

    def words(batches):
        for b in batches:
            yield pd.DataFrame({"node": b.node, "w": [fingerprints(t).astype("<u4").tobytes() for t in b.text]})

    texts = docs.join(used.select("node", "d", "th"), ["d", "th"]).mapInPandas(words, "node long, w binary")
    texts = store.write(texts.dropDuplicates(["node"]), "words")
    store.forget_shuffles()

    def links(pairs: DataFrame, name: str) -> DataFrame:
        both = pairs.join(texts.select(F.col("node").alias("a"), F.col("w").alias("aw")), "a").join(texts.select(F.col("node").alias("b"), F.col("w").alias("bw")), "b")
        return store.write(both.repartition(F.hash("a", "b")).mapInPandas(verified, "a long, b long"), name)

    def rooted(df: DataFrame, roots: DataFrame, node: str, root: str) -> DataFrame:
        return df.join(roots.select(F.col("node").alias(node), F.col("root").alias(root)), node, "left").withColumn(root, F.coalesce(root, node))

    def merged(roots: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
        """The components after these links too."""
        over = rooted(rooted(pairs, roots, "a", "ra"), roots, "b", "rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        new = components(over, store, name)
        nodes_ = roots.unionByName(new.select("node", F.col("node").alias("root")).join(roots, "node", "left_anti"))
        out = store.write(rooted(nodes_.withColumnRenamed("root", "r"), new, "r", "root").select("node", "root"), f"{name}-roots")
        store.forget_shuffles()
        return out

    # one star for each node, then the others that would join components, then what several sketches suggest
    tried = store.write(stars.groupBy("b").agg(F.min(F.struct(-F.col("shared"), "a")).alias("best")).select("b", F.col("best.a").alias("a")), "tried")
    roots = components(links(tried, "links1"), store, "first")
    more = rooted(rooted(stars, roots, "a", "ra"), roots, "b", "rb").where("ra <> rb").select("a", "b").join(tried, ["a", "b"], "left_anti")
    roots = merged(roots, links(more, "links2"), "second")
    placed = store.write(rooted(keys.select("key", "size", "node", "n"), roots, "node", "root"), "placed")
    open_ = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    left = store.write(placed.join(open_, "key"), "open")
    store.drop("placed")

    def paired(rows: DataFrame, on: str, *more: str, k: int, that: F.Column, most: F.Column) -> DataFrame:
        """Pairs of different components that meet on a key, without those whose shingles of k words differ by more than `most`.

        that, most: of columns of both, with a or b before their names, the same from either side.
        """

        def marked(batches):
            for b in batches:
                yield pd.DataFrame({"node": b.node, "marks": [marks(labelled_shingles(shingles(np.frombuffer(w, "<u4").astype(np.uint64), k))) for w in b.w]})

        own = source.join(rows.select("node").distinct(), "node", "left_semi").select("node", "w").mapInPandas(marked, "node long, marks array<long>")
        own = store.write(own, f"marks{k}").select("node", *(F.col("marks")[i].alias(f"m{i}") for i in range(MARKS)))
        # one node of such a pair is not of the component that has most of the key's nodes
        main = rows.groupBy(on, "root").agg(F.count("*").alias("size")).groupBy(on).agg(F.max(F.struct("size", "root"))["root"].alias("main"))
        named = lambda rows, s: rows.join(own, "node").select(on, F.col("node").alias(f"{s}node"), *(F.col(c).alias(s + c) for c in ("n", "root", *more, *(f"m{i}" for i in range(MARKS)))))
        few = named(rows.join(main, on).where("root <> main"), "a")
        differ = sum((F.bit_count(F.col(f"am{i}").bitwiseXOR(F.col(f"bm{i}"))) for i in range(MARKS)), F.lit(0))
        pairs = few.join(named(rows, "b"), on).where("aroot <> broot").where(near("an", "bn")).where(that).where(differ <= most)
        return pairs.select(F.least("anode", "bnode").alias("a"), F.greatest("anode", "bnode").alias("b")).distinct()

    source = store.write(left.select("node", "n", "root").distinct().join(texts, "node"), "apart")

    def rarest(name: str, k: int, least: F.Column) -> DataFrame:
        """The rarest shingles of k words of each node, so many that any two nodes with `least` or more in common share one of them."""

        def cut(batches):
            for b in batches:
                for node, w, n, root in zip(b.node, b.w, b.n, b.root):
                    h = shingles(np.frombuffer(w, "<u4").astype(np.uint64), k)
                    _, kind, count = np.unique(h, return_inverse=True, return_counts=True)
                    place = np.where(count[kind] == 1, np.arange(len(h)), -1)
                    yield pd.DataFrame({"h": labelled_shingles(h).view(np.int64), "node": node, "n": n, "root": root, "size": len(h), "place": place})

        # the place is -1 for shingles that a text repeats: which of them are the same is open
        rows = store.write(source.mapInPandas(cut, "h long, node long, n int, root long, size int, place int"), name)
        frequent = rows.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
        own = Window.partitionBy("node")
        # shingles that no other has come first, and only the others can be common
        shared = F.count("*").over(own)
        rank = F.row_number().over(own.orderBy("df", "h")) + F.col("size") - shared
        found = rows.join(frequent, "h").withColumn("shared", shared).withColumn("rank", rank).where(F.col("rank") <= F.col("size") - least + 1).where(F.col("shared") >= least)
        return store.write(found.select("h", "node", "n", "root", "size", "shared", "place"), f"{name}-rarest")

    def apart_of(rows: DataFrame) -> DataFrame:
        """Those of shingles whose nodes are in more than one component."""
        apart = rows.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("h")
        return rows.join(apart, "h", "left_semi")

    def rerooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
        return rooted(rows.drop("root"), roots, "node", "root")

    def led(rows: DataFrame, seeds: tuple[int, ...], columns: tuple[str, ...], that: F.Column) -> DataFrame:
        """Pairs of different components of a shingle's nodes with a few leaders, of which shingles that share nodes agree.

        Seed 0 takes the node that has least of its own: the text that a family's copies were made of, or next to it.
        """
        far = {i: (F.lit(0) if i else F.col("n") - F.col("shared")).cast("long") for i in seeds}
        lead = [F.min(F.struct(far[i].alias("far"), F.xxhash64(F.lit(i), "node").alias("x"), *columns)).alias(f"l{i}") for i in seeds]
        lead = rows.groupBy("h").agg(*lead).select("h", F.explode(F.array(*(F.col(f"l{i}") for i in seeds))).alias("l")).select("h", *(F.col("l")[c].alias(f"b{c}") for c in columns))
        met = rows.select("h", *(F.col(c).alias(f"a{c}") for c in columns)).join(lead, "h").where("aroot <> broot").where(near("an", "bn")).where(that)
        met = met.select(F.least("anode", "bnode").alias("a"), F.greatest("anode", "bnode").alias("b")).distinct()
        return met.join(stars, ["a", "b"], "left_anti")

    # the rarest shingles of two documents of SIMILARITY or more meet, whatever frequent passages they share
    enough = F.least("ashared", "bshared") >= SIMILARITY / (1 + SIMILARITY) * (F.col("asize") + F.col("bsize")) - 1e-6
    long = store.write(apart_of(rarest("shingles", WORDS, F.ceil(SIMILARITY * F.col("size") - 1e-9))), "shingles-open")
    # families of edited copies: a shingle's nodes meet a few leaders first, and only what these leave apart meets all others
    roots = merged(roots, links(led(long, (0, 1, 2, 3), ("node", "n", "root", "size", "shared"), enough), "links0"), "zeroth")
    apart = store.write(apart_of(rerooted(long, roots)), "shingles-left")
    alike = paired(apart, "h", "size", "shared", k=WORDS, that=enough, most=(1 - SIMILARITY) / (1 + SIMILARITY) * (F.col("asize") + F.col("bsize")) + 1e-6)
    roots = merged(roots, links(alike.join(stars, ["a", "b"], "left_anti"), "links3"), "third")
    store.drop("open", "keys", "shingles", "shingles-rarest", "shingles-open", "shingles-left", "links0", "links1", "links2", "links3")
    store.forget_shuffles()
    # and so do the rarest short shingles of two documents that EDIT links, as each edit changes SHORT of the longer one's at most
    longer = F.greatest("an", "bn")
    most = F.floor((1 - EDIT) * longer + 1e-9)
    enough = F.least("ashared", "bshared") >= longer - SHORT + 1 - SHORT * most
    enough &= F.abs(F.col("an") - F.col("bn")) <= most
    enough &= (F.col("aplace") < 0) | (F.col("bplace") < 0) | (F.abs(F.col("aplace") - F.col("bplace")) <= most)
    kept = F.ceil((1 - SHORT * (1 - EDIT)) * F.col("n") - SHORT + 1 - 1e-6)
    short = rarest("short", SHORT, kept).where(F.col("n") >= 9)
    store.drop("short")
    store.forget_shuffles()
    short = store.write(apart_of(rerooted(short, roots)), "short-open")
    roots = merged(roots, links(led(short, (0, 1, 2, 3), ("node", "n", "root", "shared", "place"), enough), "links4"), "fourth")
    store.forget_shuffles()
    # what they leave apart, each with all others, of which it has all but `most` words of the longer one at least
    apart = store.write(apart_of(rerooted(short, roots)), "short-left")
    edited = paired(apart, "h", "shared", "place", k=1, that=enough, most=2 * most - F.abs(F.col("an") - F.col("bn")))
    roots = merged(roots, links(edited.join(stars, ["a", "b"], "left_anti"), "links5"), "last")
    store.drop("open", "keys", "stars", "tried", "words", "apart", "shingles", "shingles-rarest", "short", "short-rarest", "short-open", "short-left", f"marks{WORDS}", "marks1", "nodes", *(f"links{i}" for i in range(1, 6)))
    store.forget_shuffles()
    return found, roots


def prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return keyed(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("d"), F.xxhash64("text").alias("th"), "text")


def labelled(docs: DataFrame, store: Store) -> DataFrame:
    """(d, th, node, root) of every row."""
    found, roots = classes(docs, store)
    return found.select("d", "th", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, copy_of) of every row: the least id of its near-duplicate class and of its copies.

    A null text is empty. Texts without a word are alike only if equal. Rows
    without an id take part; a class in which no row has an id has a null
    class_id. Repeated rows are copies. No rows give no rows.
    """
    tune(docs.sparkSession)
    rows = labelled(prepared(docs, id_col, text_col), Store(docs.sparkSession, "near"))
    own = F.when(F.col("d") != NULL_ID, F.col("d"))
    copies = rows.groupBy("node", "root").agg(F.min(own).alias("copy_of"))
    groups = copies.groupBy("root").agg(F.min("copy_of").alias("class_id"))
    return rows.join(copies.join(groups, "root").select("node", "class_id", "copy_of"), "node").select(own.alias("doc_id"), "class_id", "copy_of")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns, only the first (by id, then hash of the text) of each near-duplicate class."""
    tune(docs.sparkSession)
    store = Store(docs.sparkSession, "near")
    rows = labelled(prepared(docs, id_col, text_col), store)
    keep = store.write(rows.groupBy("root").agg(F.min(F.struct("d", "th")).alias("k")).select(F.col("k.d").alias("__lodestone_d"), F.col("k.th").alias("__lodestone_th")).distinct(), "keep")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    tagged = docs.withColumn("__lodestone_d", F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))).withColumn("__lodestone_th", F.xxhash64(text))
    kept = tagged.join(keep, ["__lodestone_d", "__lodestone_th"], "left_semi")
    repeated = rows.groupBy("d", "th").count().where("count > 1").join(keep.select(F.col("__lodestone_d").alias("d"), F.col("__lodestone_th").alias("th")), ["d", "th"], "left_semi")
    if not repeated.isEmpty():
        twice = repeated.select(F.col("d").alias("__lodestone_d"), F.col("th").alias("__lodestone_th"))
        on = ["__lodestone_d", "__lodestone_th"]
        kept = kept.join(twice, on, "left_anti").unionByName(kept.join(twice, on, "left_semi").dropDuplicates(on))
    return kept.select(*docs.columns)
