"""Packing of documents into token sequences: shortest pack first over the length histogram.

The plan is made from counts alone (at most seq_len of them reach the driver);
pieces are then joined to the plan by their rank among the pieces of their length.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Store, keyed, tune
from .tokens import Encoder

PIECES = "pid int, local long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def plan_packs(histogram: dict[int, int], seq_len: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns as (how many sequences, [(length, copies), ...]).

    Lengths are placed longest first, each into the packs that are shortest so
    far and still have room; where none has, packs are opened, and filled with
    copies of that length as the next shortest packs in turn.
    """
    rooms: dict[int, list[tuple[int, tuple]]] = defaultdict(list)
    heap: list[int] = []

    def put(room: int, count: int, pattern: tuple) -> None:
        if count:
            if not rooms[room]:
                heapq.heappush(heap, -room)
            rooms[room].append((count, pattern))

    def refill(room: int, pattern: tuple, length: int, count: int, copies: int, left: int) -> None:
        """`left` pieces of a length go into `count` packs, `copies` each, the last of them maybe fewer."""
        full, rest = divmod(left, copies)
        put(room - copies * length, full, (pattern, length, copies))
        if rest:
            put(room - rest * length, 1, (pattern, length, rest))
        put(room, count - full - bool(rest), pattern)

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while heap and not rooms[-heap[0]]:
                heapq.heappop(heap)
            room = -heap[0] if heap else 0
            if room < length:
                copies = seq_len // length
                refill(seq_len, (), length, -(-left // copies), copies, left)
                left = 0
                continue
            count, pattern = rooms[room].pop()
            if rooms[room]:
                below = room - 1
            else:
                heapq.heappop(heap)
                below = max((-x for x in heap if rooms[-x]), default=0) if len(heap) < 64 else room - 1
            copies = max(1, min(room // length, -(-(room - below) // length)))
            if left >= count * copies:
                put(room - copies * length, count, (pattern, length, copies))
                left -= count * copies
            else:
                refill(room, pattern, length, count, copies, left)
                left = 0

    out = []
    for packs in rooms.values():
        for count, pattern in packs:
            parts: Counter = Counter()
            while pattern:
                pattern, length, copies = pattern
                parts[length] += copies
            out.append((count, sorted(parts.items(), reverse=True)))
    return sorted(out, key=lambda x: (-x[0], x[1]))


def slots(plan: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """The plan as ranges of ranks for each length: rows sorted by (length, first rank)."""
    rows, ranks, first = [], Counter(), 0
    for count, parts in plan:
        offset = 0
        for length, copies in parts:
            rows.append((length, ranks[length], first, offset, copies))
            ranks[length] += count * copies
            offset += length * copies
        first += count
    rows.sort()
    names = ("length", "rank", "sequence", "offset", "copies")
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(names)}


def cut(docs: DataFrame, tokenizer: str, end_id: int, seq_len: int) -> DataFrame:
    """A row for each piece of at most seq_len ids; local numbers the pieces of a length within a task."""

    def pieces(batches):
        encoder, pid, seen = Encoder.of(tokenizer), TaskContext.get().partitionId(), Counter()
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows = []
            for doc, ids in zip(b.doc_id, encoder.ids(b.text.tolist())):
                ids += end
                n = len(ids) // 4
                for at in range(0, n, seq_len):
                    own = ids[4 * at : 4 * (at + seq_len)]
                    length = len(own) // 4
                    rows.append((pid, seen[length], doc, at, length, zlib.crc32(own), n))
                    seen[length] += 1
            out = pd.DataFrame(rows, columns=["pid", "local", "doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            yield out.assign(doc_id=out.doc_id.astype("Int64"))

    return docs.mapInPandas(pieces, PIECES)


def pack(docs: DataFrame, tokenizer: str, *, end_id: int = 2, seq_len: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every id of every document in exactly one piece, every piece in one sequence.

    Documents longer than seq_len are cut every seq_len ids. A null text is
    empty and yields one piece that holds the end id; a null id is kept as
    null; repeated rows are packed as often as they occur; other columns are
    not read; no rows give no pieces. Texts are encoded once, into a table in
    the shared folder, so that a retried task cannot change any rank.
    """
    spark = docs.sparkSession
    tune(spark)
    store = Store(spark, "pack")
    rows = store.write(cut(keyed(docs, id_col, text_col), tokenizer, end_id, seq_len), "pieces")
    counts = rows.groupBy("pid", "length").count()
    histogram = {r.length: r.n for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slot = spark.sparkContext.broadcast(slots(plan_packs(histogram, seq_len)))
    before = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("pid", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    ranked = rows.join(base, ["pid", "length"]).withColumn("rank", F.col("base") + F.col("local"))

    def place(batches):
        s = slot.value
        ends = np.searchsorted(s["length"], np.arange(seq_len + 2))
        for b in batches:
            length, rank = b.length.to_numpy(), b["rank"].to_numpy()
            at = np.empty(len(b), np.int64)
            for v in np.unique(length):
                own = length == v
                at[own] = ends[v] + np.searchsorted(s["rank"][ends[v] : ends[v + 1]], rank[own], side="right") - 1
            turn = rank - s["rank"][at]
            b = b.assign(sequence_id=s["sequence"][at] + turn // s["copies"][at], offset=s["offset"][at] + turn % s["copies"][at] * length)
            yield b[[c.split()[0] for c in PLACED.split(", ")]].astype({"doc_id": "Int64"})

    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInPandas(place, PLACED)
