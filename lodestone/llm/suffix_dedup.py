"""Exact substring dedup: distributed prefix doubling over a sampled suffix array.

A byte goes if a string of `length` bytes that covers it also starts earlier
(smaller doc_id, or the same document further left). Positions carry ranks:
equal ranks mean equal prefixes. Spark sorts (rank, position) pairs round by
round, for prefixes of growing length; a position whose rank no other has is
unique and leaves, the others are reranked by the rank at a further offset:

1. 32 bytes. No document needs another one for these, so the first five
   doublings run in place. Of each window of `length` bytes only the start of
   its least-ranked 32-byte string is sampled (its anchor; the leftmost of
   ties). Equal windows have their anchor at the same place and neighbouring
   windows share it, so about one position in 35 stands for all of them.
2. The anchors left are reranked by all bytes that their windows cover. All
   but the first of a rank repeat as a whole, and the first stands for them.
3. 64 bytes: the ranks of the 32 before and the 32 at the anchor, and of the 64
   from it on. Every window covers one of these strings or both; those that
   cover a unique one leave.
4. `length` bytes, past the threshold, which ends the doubling: the windows left
   are positions of their own, ranked by the pair of their first 64 bytes and
   the last 64. Of those with equal rank all but the first are repeats.

Ranks are 64-bit fingerprints and two of them decide, 128 bits in all.
Nothing of the corpus reaches the driver; texts are read three times, and no
task holds more than a batch of texts. A rank that very many positions have is
counted in partial sums, and its positions are split over tasks by the joins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.relational import numbered

from .common import NULL_ID, Store, keyed, remember_only, tune

#: The sampled strings' bytes.
GRAM = 32
#: Bytes of a batch of texts that are ranked at once; positions in it fit in PLACE bits.
CHUNK, PLACE = 1 << 19, 21
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
BYTES = np.random.Generator(np.random.PCG64(7)).integers(0, 2**64, 256, np.uint64)
#: Bits of a place for the windows of a run, and for where its anchor is from the first of them on; what is above them is that first window.
WINDOWS, ANCHOR = 7, 8
FIRST = WINDOWS + ANCHOR
#: Bytes of a string that this layout and the three rounds hold for.
LENGTHS = (3 * GRAM, 128 + GRAM - 2)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rank of what a and b rank, one after the other."""
    x = a * M1
    x ^= b >> np.uint64(29)
    x += b * M2
    x ^= x >> np.uint64(32)
    return x


def ranks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the 32 and the 64 bytes from each position on (along the last axis)."""
    r, n, r32 = BYTES[data], 1, None
    while n < 64:
        r = mix(r[..., :-n], r[..., n:])
        n *= 2
        if n == GRAM:
            r32 = r
    return r32, r


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """The runs of windows of equal anchor in texts that stand one after another in data.

    first: a run's first window; windows: how many; anchor: where it is from the first on; rank: of its 32 bytes; cover: of all bytes.
    """
    r32, r64 = ranks(data)
    grams = length - GRAM + 1
    key = (r32 >> np.uint64(PLACE) << np.uint64(PLACE)) | np.arange(len(r32), dtype=np.uint64)
    n = 1
    least = key
    while 2 * n <= grams:
        least = np.minimum(least[:-n], least[n:])
        n *= 2
    if n < grams:
        least = np.minimum(least[: len(least) - (grams - n)], least[grams - n :])
    at = (least & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    valid = np.zeros(len(at) + 1, bool)
    starts = np.concatenate([[0], ends[:-1]])
    for s, e in zip(starts, ends):
        valid[s : max(s, e - length + 1)] = True
    valid[len(at) :] = False
    valid = valid[:-1]
    # a run ends where the anchor changes or the next window crosses into another document
    new = valid.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new)
    stop = valid.copy()
    stop[:-1] &= (at[1:] != at[:-1]) | ~valid[1:]
    last = np.flatnonzero(stop)
    anchor, size = at[first], last - first + length
    cover = mix(mix(r64[first], r64[first + (size - 64) // 2]), mix(r64[last + length - 64], (size * 256 + anchor - first).astype(np.uint64) * M1))
    return {"first": first, "windows": last - first + 1, "anchor": anchor - first, "rank": r32[anchor], "cover": cover}


def chunks(batches: Iterator[pd.DataFrame], length: int) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, base, data, ends): texts of about CHUNK bytes together; longer ones in parts whose windows follow on."""
    keys, base, own, size = [], [], [], 0
    for b in batches:
        for d, o, text in zip(b.d, b.o, b.text):
            data = text.encode("utf-8", "surrogatepass")
            for at in range(0, max(1, len(data) - length + 1), CHUNK):
                part = data[at : at + CHUNK + length - 1]
                if len(part) < length:
                    continue
                if size and size + len(part) > CHUNK + length:
                    yield keys, np.array(base), np.frombuffer(b"".join(own), np.uint8), np.cumsum([len(x) for x in own])
                    keys, base, own, size = [], [], [], 0
                keys.append((d, o))
                base.append(at)
                own.append(part)
                size += len(part)
    if own:
        yield keys, np.array(base), np.frombuffer(b"".join(own), np.uint8), np.cumsum([len(x) for x in own])


def found(batches: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """The sampled positions with their ranks; place: a run's first window, where its anchor is, and the number of its windows."""
    remember_only()
    for keys, base, data, ends in chunks(batches, length):
        a = anchors(data, ends, length)
        doc = np.searchsorted(ends, a["first"], side="right")
        start = np.concatenate([[0], ends[:-1]])
        d, o = np.array([k[0] for k in keys], np.int64), np.array([k[1] for k in keys], np.int64)
        place = (a["first"] - start[doc] + base[doc]) << FIRST | a["anchor"] << WINDOWS | a["windows"]
        yield pd.DataFrame({"rank": a["rank"].view(np.int64), "cover": a["cover"].view(np.int64), "d": d[doc], "o": o[doc], "place": place})


def with_bytes(batches: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """The pending runs with the bytes that their windows cover."""
    remember_only()
    out: list[tuple] = []
    for b in batches:
        for d, o, text, places in zip(b.d, b.o, b.text, b.places):
            data = text.encode("utf-8", "surrogatepass")
            for place in places.tolist():
                first = place >> FIRST
                out.append((d, o, place, data[first : first + (place & ((1 << WINDOWS) - 1)) + length - 1]))
                if len(out) == 5000:
                    yield pd.DataFrame(out, columns=["d", "o", "place", "data"])
                    out = []
    if out:
        yield pd.DataFrame(out, columns=["d", "o", "place", "data"])


def matrix(rows: pd.DataFrame, length: int) -> tuple[np.ndarray, ...]:
    """The bytes of runs as rows of equal width; the bytes there are, where the anchor is, and the number of windows."""
    size = rows.data.str.len().to_numpy()
    data = np.zeros((len(rows), 2 * length - GRAM), np.uint8)
    data[np.arange(data.shape[1]) < size[:, None]] = np.frombuffer(b"".join(rows.data), np.uint8)
    place = rows.place.to_numpy()
    return data, size, place >> WINDOWS & ((1 << ANCHOR) - 1), place & ((1 << WINDOWS) - 1)


def sides(batches: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """The ranks of the 64 bytes around the anchor (side 0) and from it on (1), where windows cover them."""
    remember_only()
    for b in batches:
        for at in range(0, len(b), 2000):
            rows = b.iloc[at : at + 2000]
            data, size, anchor, n = matrix(rows, length)
            _, r64 = ranks(data)
            for side, begin in enumerate((anchor - GRAM, anchor)):
                own = np.flatnonzero((begin >= 0) & (begin + 64 <= size))
                yield pd.DataFrame({"rank": r64[own, begin[own]].view(np.int64), "side": side, "d": rows.d.to_numpy()[own], "o": rows.o.to_numpy()[own], "place": rows.place.to_numpy()[own]})


def windows(batches: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """A row for each window that covers no unique string: the ranks of its first and its last 64 bytes, and its place."""
    remember_only()
    for b in batches:
        for at in range(0, len(b), 2000):
            rows = b.iloc[at : at + 2000]
            data, size, anchor, n = matrix(rows, length)
            _, r64 = ranks(data)
            w = np.arange(length - GRAM + 1)
            left, right = w <= (anchor - GRAM)[:, None], w + length >= (anchor + 64)[:, None]
            i, w = np.nonzero((w < n[:, None]) & (~left | rows.left.to_numpy()[:, None]) & (~right | rows.right.to_numpy()[:, None]))
            place = ((rows.place.to_numpy()[i] >> FIRST) + w) << FIRST | 1
            yield pd.DataFrame({"x": r64[i, w].view(np.int64), "y": r64[i, w + length - 64].view(np.int64), "d": rows.d.to_numpy()[i], "o": rows.o.to_numpy()[i], "place": place})


#: The order of positions: documents by id, then those that share one, then places.
ORDER = ("d", "o", "place")


def later(first: Column) -> Column:
    """Whether a position comes after another one."""
    a, b = [F.col(c) for c in ORDER], [first[c] for c in ORDER]
    return (a[0] > b[0]) | (a[0] == b[0]) & ((a[1] > b[1]) | (a[1] == b[1]) & (a[2] > b[2]))


def shared_ranks(rows: DataFrame, store: Store, name: str, *rank: str) -> DataFrame:
    """The ranks that more than one position has."""
    out = store.write(rows.groupBy(*rank).agg(F.count("*").alias("n")).where("n > 1").select(*rank), name)
    store.forget_shuffles()
    return out


def firsts(rows: DataFrame, store: Store, name: str, *rank: str) -> DataFrame:
    """The first position of each rank."""
    out = rows.groupBy(*rank).agg(F.min(F.struct(*ORDER)).alias("first"))
    out = store.write(out.select(*rank, *(F.col("first")[c].alias(f"f{c}") for c in ORDER)), name)
    store.forget_shuffles()
    return out


def repeats(docs: DataFrame, store: Store, *, length: int = 100) -> DataFrame:
    """(d, o, places): for each document with repeats, its runs of windows that also start earlier."""
    if not LENGTHS[0] <= length <= LENGTHS[1]:
        raise ValueError(f"length must lie between {LENGTHS[0]} and {LENGTHS[1]}")
    is_later = later({c: F.col(f"f{c}") for c in ORDER})
    kind = "d long, o long, place long"
    # 32 bytes: the anchors
    positions = store.write(docs.mapInPandas(lambda it: found(it, length), f"rank long, cover long, {kind}"), "anchors")
    positions = store.write(positions.join(shared_ranks(positions, store, "ranks32", "rank"), "rank"), "left32")
    store.drop("anchors", "ranks32")
    store.forget_shuffles()
    # what their windows cover: copies fall to their first
    classes = firsts(positions, store, "classes", "rank", "cover")
    whole = store.write(positions.join(classes, ["rank", "cover"]).where(is_later).select(*ORDER), "whole")
    store.drop("left32")
    store.forget_shuffles()
    several = shared_ranks(classes, store, "several", "rank")
    pending = classes.join(several, "rank").groupBy(F.col("fd").alias("d"), F.col("fo").alias("o")).agg(F.collect_list("fplace").alias("places"))
    runs = store.write(docs.join(pending, ["d", "o"]).mapInPandas(lambda it: with_bytes(it, length), f"{kind}, data binary"), "pending")
    store.drop("classes", "several")
    store.forget_shuffles()
    # 64 bytes, on either side of the anchor
    around = store.write(runs.mapInPandas(lambda it: sides(it, length), f"rank long, side int, {kind}"), "sides")
    around = around.join(shared_ranks(around, store, "ranks64", "rank", "side"), ["rank", "side"])
    alike = around.groupBy(*ORDER).agg(F.max(F.col("side") == 0).alias("left"), F.max(F.col("side") == 1).alias("right"))
    runs = store.write(runs.join(alike, [*ORDER]), "left64")
    store.drop("pending", "sides", "ranks64")
    store.forget_shuffles()
    # past the threshold: the windows
    positions = runs.mapInPandas(lambda it: windows(it, length), f"x long, y long, {kind}")
    positions = store.write(positions.join(shared_ranks(positions, store, "ranks100", "x", "y"), ["x", "y"]), "left100")
    store.drop("left64", "ranks100")
    store.forget_shuffles()
    first = firsts(positions, store, "first100", "x", "y")
    parts = store.write(positions.join(first, ["x", "y"]).where(is_later).select(*ORDER), "parts")
    store.drop("left100", "first100")
    store.forget_shuffles()
    return whole.unionByName(parts).groupBy("d", "o").agg(F.collect_list("place").alias("places"))


def spans(places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed runs (starts, ends) of one text, in bytes."""
    places = np.sort(places)
    first = places >> FIRST
    if not len(first):
        return first, first
    end = np.maximum.accumulate(first + (places & ((1 << WINDOWS) - 1)) - 1 + length)
    new = np.ones(len(first), bool)
    new[1:] = first[1:] > end[:-1]
    return first[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(first) - 1)]


def with_order(rows: DataFrame, text: Column) -> DataFrame:
    """The rows, which have an id d, with o: 0 where an id has a single text, else the text's number among all such texts.

    Texts that share an id are numbered by ranges of (d, h, l), so an id that
    very many rows have (a missing one, say) is spread over tasks.
    """
    key = {"h": F.xxhash64(text), "l": F.length(text)}
    keys = rows.select("d", *(c.alias(k) for k, c in key.items()))
    shared = keys.groupBy("d").agg(F.min(F.struct("h", "l")).alias("a"), F.max(F.struct("h", "l")).alias("z")).where("a <> z").select("d")
    several = keys.join(shared, "d").distinct().withColumn("k", F.struct("d", "h", "l"))
    numbers = numbered(several, "k", "o").select("d", "h", "l", (F.col("o") + 1).alias("o"))
    if numbers.isEmpty():
        return rows.withColumn("o", F.lit(0).cast("long"))
    out = rows.withColumns(key).join(numbers, ["d", "h", "l"], "left")
    return out.withColumn("o", F.coalesce("o", F.lit(0).cast("long"))).drop("h", "l")


def prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = keyed(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("d"), "text")
    return with_order(rows, F.col("text")).select("d", "o", "text")


def digest(docs: DataFrame, *, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row.

    A null text is empty. Rows without an id come before all others. Rows that
    repeat an id and a text are one document, and get the same result; different
    texts that share an id are documents of their own, in the order of their
    hashes. Texts under `length` bytes lose nothing; no rows give no rows.
    """
    tune(docs.sparkSession)
    rows = prepared(docs, id_col, text_col)
    found_ = repeats(rows, Store(docs.sparkSession, "suffix"), length=length)

    def kept(batches):
        for b in batches:
            out = []
            for d, text, places in zip(b.d, b.text, b.places):
                data = text.encode("utf-8", "surrogatepass")
                a, z = spans(np.asarray([] if places is None else places, np.int64), length)
                rest = b"".join(data[x:y] for x, y in zip([0, *z], [*a, len(data)]))
                out.append((None if d == NULL_ID else d, len(data), len(data) - len(rest), len(a), hashlib.sha256(rest).hexdigest()))
            out = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
            yield out.assign(doc_id=out.doc_id.astype("Int64"))

    joined = rows.join(found_, ["d", "o"], "left").select("d", "text", "places")
    return joined.mapInPandas(kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(docs: DataFrame, *, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the repeats, with all their columns; those of which nothing is left go.

    Characters of which a part is cut go as a whole. Texts without repeats,
    null ones too, stay as they are. Missing and repeated ids are as in `digest`.
    """
    tune(docs.sparkSession)
    found_ = repeats(prepared(docs, id_col, text_col), Store(docs.sparkSession, "suffix"), length=length)

    @F.pandas_udf("string")
    def cut(text: pd.Series, places: pd.Series) -> pd.Series:
        out = []
        for t, p in zip(text, places):
            if t is not None and p is not None:
                data = t.encode("utf-8", "surrogatepass")
                a, z = spans(np.asarray(p, np.int64), length)
                t = "".join(data[x:y].decode("utf-8", "ignore") for x, y in zip([0, *z], [*a, len(data)]))
            out.append(t)
        return pd.Series(out, dtype=object)

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("d"), F.struct(*docs.columns).alias("row"))
    text, was = F.col("row")[text_col].cast("string"), F.col("places").isNull()
    joined = with_order(rows, F.coalesce(text, F.lit(""))).join(found_, ["d", "o"], "left")
    joined = joined.withColumn("new", F.when(was, text).otherwise(cut(text, F.col("places")))).where(was | (F.length("new") > 0))
    out = {c: F.col("row")[c].alias(c) for c in docs.columns} | {text_col: F.col("new").alias(text_col)}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(was, F.col("row")["n_chars"]).otherwise(F.length("new").cast("long")).alias("n_chars")
    return joined.select(*out.values())
