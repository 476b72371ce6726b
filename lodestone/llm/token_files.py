"""Token ids in files of patched frame-of-reference blocks.

A file image is, little-endian throughout:

    magic "LPF1", u32 block size, u32 documents, u32 blocks, u64 ids
    documents:  i64 id, u8 id is null, u64 first id (in the file), columns one after another
    blocks:     u32 base, u8 width, u8 exceptions - columns
    index:      u32 start of each block's packed bits (and the end), u32 start of its exceptions (and the end)
    bits:       (id - base) mod 2**width of each id, width bits each, most significant first
    exceptions: u8 place in the block, then u32 id - base, as two columns

A block of 128 ids is packed at the cheapest of the given percentiles of its
deltas' bit lengths; what doesn't fit that width is in its exception list. The
last block is filled up with its own base. The index gives any block by itself.

Images are rows of a table that Spark writes (so a retried task can't leave
half a file, and any store will do); `export` copies them out as plain files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Store, keyed, tune
from .tokens import Encoder

MAGIC, BLOCK = b"LPF1", 128
PERCENTILES = (0.75, 0.9, 0.95, 1.0)
#: A file is closed at the first document end after this many ids.
FILE_IDS = 1 << 18
FILES = "part int, file int, part_start long, n_ids long, image binary"
HEAD = np.dtype([("magic", "S4"), ("block", "<u4"), ("docs", "<u4"), ("blocks", "<u4"), ("ids", "<u8")])


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """(rows, BLOCK) to (rows, BLOCK * width / 8) bytes."""
    if width == 16:
        return np.ascontiguousarray(values.astype(">u2")).view(np.uint8).reshape(len(values), -1)
    bits = np.unpackbits(np.ascontiguousarray(values.astype(">u4")).view(np.uint8).reshape(len(values), BLOCK, 4), axis=2)[:, :, 32 - width :]
    return np.packbits(bits.reshape(len(values), -1), axis=1)


def unpack_bits(packed: np.ndarray, width: int) -> np.ndarray:
    if width == 16:
        return np.ascontiguousarray(packed).view(">u2").astype(np.uint32)
    bits = np.zeros((len(packed), BLOCK, 32), np.uint8)
    bits[:, :, 32 - width :] = np.unpackbits(packed, axis=1).reshape(len(packed), BLOCK, width)
    return np.packbits(bits, axis=2).view(">u4").reshape(len(packed), BLOCK).astype(np.uint32)


def encode(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """The image of these documents, whose ids stand one after another."""
    blocks = -(-len(ids) // BLOCK)
    full = np.zeros(blocks * BLOCK, np.uint32)
    full[: len(ids)] = ids
    full = full.reshape(blocks, BLOCK)
    if blocks:
        last = len(ids) - (blocks - 1) * BLOCK
        full[-1, last:] = full[-1, :last].min()
    base = full.min(axis=1) if blocks else np.zeros(0, np.uint32)
    delta = full - base[:, None]
    lens = np.frexp(delta.astype(np.float32))[1].astype(np.uint8)  # ids are under 2**24, where this is exact
    ranked = np.sort(lens, axis=1, kind="stable")
    cost, width = np.full(blocks, 1 << 30), np.zeros(blocks, np.uint8)
    for p in PERCENTILES:
        w = ranked[:, int(np.ceil(p * BLOCK)) - 1]
        c = BLOCK // 8 * w.astype(np.int64) + 5 * (lens > w[:, None]).sum(axis=1)
        width, cost = np.where(c < cost, w, width), np.minimum(c, cost)
    out = lens > width[:, None]
    starts = np.concatenate([[0], np.cumsum(width.astype(np.int64) * (BLOCK // 8))])
    bits = np.zeros(starts[-1], np.uint8)
    for w in np.unique(width):
        if w:
            own = np.flatnonzero(width == w)
            bits[starts[own][:, None] + np.arange(BLOCK // 8 * int(w))] = pack_bits(delta[own] & np.uint32((1 << int(w)) - 1), int(w))
    row, place = np.nonzero(out)
    count = out.sum(axis=1)
    head = np.array([(MAGIC, BLOCK, len(doc_ids), blocks, len(ids))], HEAD)
    return b"".join(
        x.tobytes()
        for x in (
            head,
            np.array([0 if d is None else d for d in doc_ids], "<i8"),
            np.array([d is None for d in doc_ids], np.uint8),
            np.cumsum([0, *lengths])[:-1].astype("<u8"),
            base.astype("<u4"),
            width.astype(np.uint8),
            count.astype(np.uint8),
            starts.astype("<u4"),
            np.concatenate([[0], np.cumsum(count)]).astype("<u4"),
            bits,
            place.astype(np.uint8),
            delta[row, place].astype("<u4"),
        )
    )


class Image:
    """A file image opened: documents, single blocks, or all ids."""

    def __init__(self, image: bytes):
        head = np.frombuffer(image, HEAD, 1)[0]
        if head["magic"] != MAGIC or head["block"] != BLOCK:
            raise ValueError("not a token file")
        at = HEAD.itemsize

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(image, kind, n, at)
            at += x.nbytes
            return x

        docs, self.blocks, self.n = int(head["docs"]), int(head["blocks"]), int(head["ids"])
        ids, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if b else int(a) for a, b in zip(ids, null)]
        self.first = np.append(take("<u8", docs), self.n).astype(np.int64)
        self.base, self.width, self.count = take("<u4", self.blocks), take("u1", self.blocks), take("u1", self.blocks)
        self.starts, self.exceptions = take("<u4", self.blocks + 1).astype(np.int64), take("<u4", self.blocks + 1).astype(np.int64)
        self.bits, self.place, self.value = take("u1", int(self.starts[-1])), take("u1", int(self.exceptions[-1])), take("<u4", int(self.exceptions[-1]))

    def read(self, a: int, b: int) -> np.ndarray:
        """The ids of blocks a to b (exclusive), as unsigned 32-bit integers."""
        out = np.zeros((b - a, BLOCK), np.uint32)
        for w in np.unique(self.width[a:b]):
            if w:
                own = np.flatnonzero(self.width[a:b] == w)
                out[own] = unpack_bits(self.bits[self.starts[a + own][:, None] + np.arange(BLOCK // 8 * int(w))], int(w))
        e = slice(self.exceptions[a], self.exceptions[b])
        out[np.repeat(np.arange(b - a), self.count[a:b]), self.place[e]] = self.value[e]
        out += self.base[a:b, None].astype(np.uint32)
        return out.reshape(-1)[: self.n - a * BLOCK]

    def ids(self) -> np.ndarray:
        return self.read(0, self.blocks)

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document, from its own blocks only."""
        a, b = int(self.first[k]), int(self.first[k + 1])
        lo = a // BLOCK
        return self.read(lo, -(-b // BLOCK))[a - lo * BLOCK : b - lo * BLOCK]


def write(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the files of all documents to the table at path, in ascending id order across and within parts.

    Rows without an id come first; rows of the same id stand in the order of
    their texts' hashes (so that an id of very many rows is spread over tasks);
    a null text is empty, and each document ends with end_id. A task writes the
    files of one range one after another, each document whole.
    """
    spark = docs.sparkSession
    tune(spark)

    def images(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, part, file, written = Encoder.of(tokenizer), TaskContext.get().partitionId(), 0, 0
        end, own, names, lengths, waiting = np.array([end_id], "<u4").tobytes(), [], [], [], 0

        def close() -> pd.DataFrame:
            nonlocal file, written, own, names, lengths, waiting
            ids = np.frombuffer(b"".join(own), "<u4")
            out = pd.DataFrame({"part": [part], "file": [file], "part_start": [written], "n_ids": [len(ids)], "image": [encode(ids, names, lengths)]})
            file, written, own, names, lengths, waiting = file + 1, written + len(ids), [], [], [], 0
            return out

        for b in batches:
            for at in range(0, len(b), 128):
                some = b.iloc[at : at + 128]
                for doc, null, ids in zip(some.doc_id, some.doc_id.isna(), encoder.ids(some.text.tolist())):
                    own.append(ids + end)
                    names.append(None if null else int(doc))
                    lengths.append(len(ids) // 4 + 1)
                    waiting += lengths[-1]
                    if waiting >= FILE_IDS:
                        yield close()
        if own:
            yield close()

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = keyed(docs, id_col, text_col).repartitionByRange(*order).sortWithinPartitions(*order, "text")
    ordered.mapInPandas(images, FILES).write.mode("overwrite").option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Decode the files: (doc_id, start, n_tokens, ids_crc32, part), start over all files in id order."""
    tune(spark)
    files = spark.read.schema(FILES).parquet(path)
    kind = "part int, local long, doc_id long, n_tokens long, ids_crc32 long"

    def documents(batches):
        for b in batches:
            for part, start, image in zip(b.part, b.part_start, b.image):
                f = Image(image)
                ids = f.ids().astype("<u4").tobytes()
                ends = [zlib.crc32(ids[4 * x : 4 * y]) for x, y in zip(f.first, f.first[1:])]
                yield pd.DataFrame({"part": part, "local": start + f.first[:-1], "doc_id": pd.array(f.doc_ids, "Int64"), "n_tokens": np.diff(f.first), "ids_crc32": ends})

    total = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = total.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    decoded = files.select("part", "part_start", "image").mapInPandas(documents, kind)
    return decoded.join(base, "part").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def export(spark: SparkSession, path: str, folder: str) -> int:
    """Copy the images out as plain files part-file.lpf in a local folder, one at a time; how many."""
    import os

    os.makedirs(folder, exist_ok=True)
    n = 0
    for r in spark.read.schema(FILES).parquet(path).toLocalIterator():
        with open(os.path.join(folder, f"{r.part:05d}-{r.file:05d}.lpf"), "wb") as f:
            f.write(r.image)
        n += 1
    return n


def round_trip(docs: DataFrame, tokenizer: str, *, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files into the shared folder and read them back. No rows give no files and no rows."""
    spark = docs.sparkSession
    store = Store(spark, "tokens")
    write(docs, store.path("files"), tokenizer, end_id=end_id, id_col=id_col, text_col=text_col)
    return read(spark, store.path("files"))
