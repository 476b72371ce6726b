"""Secrets in texts: three fixed patterns, and a linear-chain CRF that adds what they miss.

Tokens are runs of ASCII letters and digits, and single other signs. The CRF
tags them as begin, inside or outside of a secret from their shape, the words
around them and features of the whole file, and Viterbi finds the best tags.
Its labels are bounded by the model itself: a secret can only begin at a token
that is dense (`DENSE`) or follows a keyword, and goes on only over tokens that
touch. All other tokens are outside whatever comes before and after them, so
the best tags of a text are those of the chains between them, each decoded by
itself with the few tokens before it that features look at.

It is trained here, on generated lines (`examples`): no labelled secrets exist
in the tables, and none are shipped.
"""

from __future__ import annotations

import functools
import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, tune

# Fixed patterns of the contract: kind, pattern, group, least length.
BASE = (
    ("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]{32,}"), 0, 32),
)
KINDS = ("assign", "access", "hex", "crf")
ASSIGNED = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Words that announce a secret.
KEYWORDS = ("password", "passwd", "pwd", "secret", "token", "apikey", "key", "auth", "bearer", "credential", "credentials", "private", "access", "signature")
DENSE = re.compile(r"(?=[A-Za-z]*[0-9])[A-Za-z0-9]{10,}|[A-Za-z0-9]{24,}")
LONG, KEYWORD = re.compile("[A-Za-z0-9]{10,}"), re.compile("|".join(KEYWORDS), re.I)
TOKEN = re.compile(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]")
JOINERS = frozenset("+/_.=-")
#: Tokens after a keyword at which a secret may begin, the least length there, and the tokens before one that its features depend on.
REACH, LEAST, BEFORE = 6, 6, 9
O, B, I = 0, 1, 2

SLOTS = ("shape", "length", "turns", "variety", "word", "before", "previous", "next", "second", "glued", "after", "reach", "assigns", "size", "prefix")
BUCKETS = 24


def bucket(x: float, edges: tuple) -> int:
    return sum(x >= e for e in edges)


SIGNS = {c: 10 + i for i, c in enumerate("=:\"'-_./+@,|")}


def shape(t: str) -> int:
    """0 to 9 for kinds of words, from 10 on for signs."""
    if not t[0].isascii() or not t[0].isalnum():
        return SIGNS.get(t, 22)
    if t.isdigit():
        return 1
    if t.isalpha():
        return 2 if t.islower() else 3 if t.isupper() else 4 if t[1:].islower() else 5
    if all(c in "0123456789abcdef" for c in t):
        return 6
    return 7 if t.lower() == t else 8 if t.upper() == t else 9


def file_features(text: str) -> tuple[int, int]:
    return bucket((text.count("=") + text.count(":")) / (len(text) + 1), (1e-9, 0.002, 0.01, 0.05)), bucket(len(text), (200, 1000, 4000, 20000))


def features(text: str, lo: int, hi: int, whole: tuple[int, int]) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Token spans of text[lo:hi]; their features, a value below BUCKETS for each slot; which tags they may have."""
    spans = [m.span() for m in TOKEN.finditer(text, lo, hi)]
    words = [text[a:z] for a, z in spans]
    shapes = [shape(w) for w in words]
    x, may = np.zeros((len(words), len(SLOTS)), np.int64), np.zeros((len(words), 3), bool)
    may[:, O] = True
    key, since, sign = 0, 99, 0
    for i, w in enumerate(words):
        low = w.lower()
        own = KEYWORDS.index(low) + 1 if low in KEYWORDS else 0
        glued = bool(i and spans[i - 1][1] == spans[i][0])
        word = shapes[i] < 10
        turns = sum(a.isdigit() != b.isdigit() or a.isupper() != b.isupper() for a, b in zip(w, w[1:])) if word else 0
        x[i] = (
            shapes[i], bucket(len(w), (2, 3, 5, 8, 12, 16, 20, 32, 40)), bucket(turns, (1, 2, 4, 8)), bucket(len(set(w)) / len(w), (0.2, 0.4, 0.6, 0.8)), own, key,
            shapes[i - 1] if i else 23, shapes[i + 1] if i + 1 < len(words) else 23, shapes[i - 2] if i > 1 else 23, glued, sign, min(since, 8), *whole,
            1 + ("AKIA", "ghp", "eyJ", "sk").index(p) if (p := next((p for p in ("AKIA", "ghp", "eyJ", "sk") if w.startswith(p)), None)) else 0,
        )
        may[i, B] = word and bool(DENSE.fullmatch(w) or since <= REACH and len(w) >= LEAST)
        may[i, I] = glued and (word or w in JOINERS)
        since, key = (0, own) if own else (since + 1, key if since < REACH else 0)
        sign = SIGNS.get(w, sign if word or w == '"' else 0) if w in "=:" or not word else 0
    return spans, x, may


class Model:
    """Weights of tags by feature value (slots * BUCKETS, 3) and of tags by the tag before (3, 3)."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move

    def scores(self, x: np.ndarray, may: np.ndarray) -> np.ndarray:
        return np.where(may, self.emit[x + np.arange(x.shape[-1]) * BUCKETS].sum(axis=-2), -1e9)

    def tags(self, x: np.ndarray, may: np.ndarray) -> np.ndarray:
        """Viterbi."""
        s = self.scores(x, may)
        best, back = s[0] + [0, 0, -1e9], np.zeros((len(s), 3), np.int64)
        for t in range(1, len(s)):
            ways = best[:, None] + self.move
            back[t] = ways.argmax(axis=0)
            best = ways.max(axis=0) + s[t]
        out = np.zeros(len(s), np.int64)
        out[-1] = best.argmax()
        for t in range(len(s) - 1, 0, -1):
            out[t - 1] = back[t, out[t]]
        return out


#: A secret's inside follows its begin or inside only.
BARRED = np.array([[0, 0, -1e9], [0, 0, 0], [0, 0, 0]])


def fit(lines: list[tuple[str, list[tuple[int, int]]]], rounds: int = 80, rate: float = 0.2, penalty: float = 0.01) -> Model:
    """Maximum likelihood with an L2 penalty: forward-backward over all lines at once, Adam."""
    encoded = []
    for text, secrets in lines:
        spans, x, may = features(text, 0, len(text), file_features(text))
        y = np.zeros(len(spans), np.int64)
        for a, z in secrets:
            own = [i for i, (p, q) in enumerate(spans) if p >= a and q <= z]
            y[own[1:]], y[own[:1]] = I, B
        if len(y) and may[np.arange(len(y)), y].all():
            encoded.append((x, may, y))
    n, t = len(encoded), max(len(y) for *_, y in encoded)
    X, M, Y, L = np.zeros((n, t, len(SLOTS)), np.int64), np.zeros((n, t, 3), bool), np.zeros((n, t), np.int64), np.zeros((n, t), bool)
    M[:, :, O] = True
    for i, (x, may, y) in enumerate(encoded):
        X[i, : len(y)], M[i, : len(y)], Y[i, : len(y)], L[i, : len(y)] = x, may, y, True
    flat = X + np.arange(len(SLOTS)) * BUCKETS
    emit, move = np.zeros((len(SLOTS) * BUCKETS, 3)), np.zeros((3, 3))
    gold = np.eye(3)[Y] * L[..., None]
    pairs = np.einsum("nta,ntb->ab", gold[:, :-1], gold[:, 1:])
    mean, square = [np.zeros_like(emit), np.zeros_like(move)], [np.zeros_like(emit), np.zeros_like(move)]
    lse = lambda v, axis: (m := v.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - m).sum(axis=axis))
    for k in range(1, rounds + 1):
        s, w = np.where(M, emit[flat].sum(axis=2), -1e9), move + BARRED
        f, b = np.empty_like(s), np.zeros_like(s)
        f[:, 0] = s[:, 0] + [0, 0, -1e9]
        for i in range(1, t):
            f[:, i] = np.where(L[:, i, None], lse(f[:, i - 1, :, None] + w, 1) + s[:, i], f[:, i - 1])
        for i in range(t - 2, -1, -1):
            b[:, i] = np.where(L[:, i + 1, None], lse(w + (s[:, i + 1] + b[:, i + 1])[:, None, :], 2), b[:, i + 1])
        z = lse(f[:, -1], 1)
        p = np.exp(np.minimum(f + b - z[:, None, None], 0)) * L[..., None]
        q = np.exp(np.minimum(f[:, :-1, :, None] + w + (s[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None], 0)) * L[:, 1:, None, None]
        wrong = np.stack([np.bincount(flat.ravel(), np.repeat((p - gold)[..., c], len(SLOTS)), len(emit)) for c in range(3)], axis=1)
        for j, (v, g) in enumerate(((emit, wrong / n + penalty * emit), (move, (q.sum(axis=(0, 1)) - pairs) / n + penalty * move))):
            mean[j] = 0.9 * mean[j] + 0.1 * g
            square[j] = 0.99 * square[j] + 0.01 * g * g
            v -= rate * mean[j] / (1 - 0.9**k) / (np.sqrt(square[j] / (1 - 0.99**k)) + 1e-8)
    return Model(emit, move + BARRED)


def examples(n: int = 500, seed: int = 5) -> list[tuple[str, list[tuple[int, int]]]]:
    """Generated lines with the places of their secrets: assignments, keys with known beginnings, and look-alikes that are none."""
    r = random.Random(seed)
    pick = lambda chars, a, z: "".join(r.choices(chars, k=r.randint(a, z)))
    alnum, hexes, base64 = string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_letters + string.digits + "+/"

    def word() -> str:
        w = "".join(r.choice("bcdfghlmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
        return r.choice((w, w, w, w.capitalize(), w.upper()))

    def secret() -> str:
        return r.choice((
            lambda: pick(alnum, 10, 40), lambda: pick(hexes, 32, 64), lambda: pick(base64, 20, 60) + r.choice(("", "=", "==")),
            lambda: word().lower() + pick(string.digits, 2, 6) + pick(alnum, 4, 8), lambda: pick(alnum, 6, 10) + "-" + pick(alnum, 6, 10),
        ))()

    def known() -> str:
        return r.choice((lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16, 16), lambda: "ghp_" + pick(alnum, 36, 36), lambda: "sk-" + pick(alnum, 30, 48), lambda: "eyJ" + pick(alnum, 20, 40) + "." + pick(alnum, 20, 40) + "." + pick(alnum, 20, 40), lambda: pick(hexes, 32, 64)))()

    def other() -> str:
        return r.choice((
            lambda: pick(string.digits, 10, 19), lambda: f"{r.randint(1, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}", lambda: f"{word()}{r.randint(1, 99)}@{word()}.com",
            lambda: f"+{r.randint(1, 99)} {r.randint(100, 999)} {r.randint(1000000, 9999999)}", lambda: f"20{r.randint(10, 30)}-0{r.randint(1, 9)}-{r.randint(10, 28)}", lambda: "".join(word().lower() for _ in range(6)),
            lambda: f"https://{word()}.org/{word()}/{word()}", lambda: f"{word()}{r.randint(10, 9999)}", lambda: "### $$$", lambda: f"{r.choice(KEYWORDS)} {word()} {word()}", lambda: f"{r.choice(KEYWORDS)}: {word().lower()}",
            lambda: "DE" + pick(string.digits, 20, 20),
        ))()

    out = []
    for _ in range(n):
        parts, at, places = [], 0, []

        def add(s: str, own: bool = False) -> None:
            nonlocal at
            if own:
                places.append((at, at + len(s)))
            parts.append(s)
            at += len(s)

        for _ in range(r.randint(1, 4)):
            add(" ".join(word() for _ in range(r.randint(2, 8))) + r.choice((" ", ". ", "\n", ", ")))
            kind = r.random()
            if kind < 0.3:
                quote = r.choice(("", '"', "'"))
                name = r.choice(("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "auth", "bearer", "private_key", "access_key", "credential"))
                add(r.choice((name, name.upper(), name.capitalize())) + r.choice((" = ", "=", ": ", ":", '": ', " ")) + quote)
                add(secret(), True)
                add(quote + r.choice((" ", "\n", ". ")))
            elif kind < 0.5:
                add(known(), True)
                add(r.choice((" ", "\n", ", ")))
            elif kind < 0.9:
                add(other() + " ")
        out.append(("".join(parts), places))
    return out


@functools.cache
def model() -> Model:
    return fit(examples())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns, leftmost and non-overlapping for each kind."""
    out, low = [], text.lower()
    for k, (_, pattern, group, least) in enumerate(BASE):
        if k == 0 and not any(w in low for w in ASSIGNED) or k == 1 and "AKIA" not in text:
            continue
        for m in pattern.finditer(text):
            a, z = m.span(group)
            if z - a >= least:
                out.append((a, k, z))
    return out


def context(text: str, at: int, floor: int) -> int:
    """Where the BEFORE tokens before the token at this place begin; floor, if that is further up than all of them."""
    wide = 80
    while True:
        lo = max(floor, at - wide)
        starts = [m.start() for m in TOKEN.finditer(text, lo, at)]
        # the first of them may be the end of a token
        if len(starts) > BEFORE:
            return starts[-BEFORE]
        if lo == floor:
            return floor
        wide *= 4


def interesting(text: str) -> list[int]:
    """Where dense tokens and keywords stand, in order."""
    out = [m.start() for m in LONG.finditer(text) if DENSE.fullmatch(m.group())]
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out = sorted(out + [m.start() for m in KEYWORD.finditer(text)])
    return out


def regions(text: str) -> Iterator[tuple[int, int]]:
    """The parts of a text outside of which no token can begin a secret or go on with one, with what their features look at."""
    begin = end = 0
    for a in interesting(text):
        if a < end:
            continue
        while a > end and text[a].isascii() and text[a].isalnum() and text[a - 1].isascii() and text[a - 1].isalnum():
            a -= 1
        lo = context(text, a, end)
        if lo > end:
            if end:
                yield begin, end
            begin = lo
        # on until a token that neither follows a keyword closely nor is dense nor touches the one before
        since, last = 99, -1
        for t in TOKEN.finditer(text, a):
            w = t.group()
            glued = t.start() == last and (w in JOINERS or w.isascii() and w.isalnum())
            last = end = t.end()
            since = 0 if w.lower() in KEYWORDS else since + 1
            if since > REACH + 1 and not glued and not DENSE.fullmatch(w):
                break
    if end:
        yield begin, end


def chains(may: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of tokens from one that may begin a secret on to one that can be neither begin nor inside."""
    i = 0
    starts = np.flatnonzero(may[:, B])
    ends = np.flatnonzero(~may[:, B] & ~may[:, I])
    while len(own := starts[np.searchsorted(starts, i) :]):
        a = int(own[0])
        k = np.searchsorted(ends, a)
        i = int(ends[k]) if k < len(ends) else len(may)
        yield a, i


def crf_spans(text: str, crf: Model) -> list[tuple[int, int]]:
    """Runs of tokens tagged begin and inside."""
    out, whole = [], None
    for lo, hi in regions(text):
        whole = whole or file_features(text)
        spans, x, may = features(text, lo, hi, whole)
        for a, z in chains(may):
            a, z = max(0, a - 1), min(len(spans), z + 1)
            begin, tags = 0, crf.tags(x[a:z], may[a:z])
            for i, t in enumerate(tags):
                if t == B:
                    begin = spans[a + i][0]
                if t != O and (i + 1 == len(tags) or tags[i + 1] != I):
                    out.append((begin, spans[a + i][1]))
    return sorted(set(out))


def all_spans(text: str, crf: Model) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start and kind: the patterns' spans, and the CRF's where they touch none of those."""
    base = sorted(base_spans(text))
    out, k, reached = list(base), 0, 0
    for a, z in crf_spans(text, crf):
        while k < len(base) and base[k][0] < z:
            reached = max(reached, base[k][2])
            k += 1
        if reached <= a:
            out.append((a, 3, z))
    return sorted(out)


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) of every row, in code points, by start and then kind.

    A null or empty text has no spans; ids may be null or repeat; no rows give no rows.
    """
    tune(docs.sparkSession)
    crf = model()

    # ids stay in Arrow: pandas would make floats of those that come beside a null, which changes large ones
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            spans = [[{"kind": KINDS[k], "start": a, "end": z} for a, k, z in all_spans(t, crf)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    return keyed(docs, id_col, text_col).mapInArrow(scan, "doc_id long, spans array<struct<kind string, start long, end long>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the patterns' spans by kind, the hash of their list, and all spans as text."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "crf")), 256)
    return found.select("doc_id", count("assign"), count("access"), count("hex"), base.alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, *, text_col: str = "text", mark: str = "<secret>") -> DataFrame:
    """The documents with each found secret replaced by a mark, and n_chars (if there) as the new length; null texts stay null."""
    tune(docs.sparkSession)
    crf = model()

    @F.pandas_udf("string")
    def clean(text: pd.Series) -> pd.Series:
        out = []
        for t in text:
            spans = all_spans(t, crf) if t else []
            if spans:
                parts, at = [], 0
                for a, _, z in spans:
                    if z > at:
                        parts += [t[at:a], mark] if a >= at else []
                        at = z
                t = "".join([*parts, t[at:]])
            out.append(t)
        return pd.Series(out, dtype=object)

    out = docs.withColumn(text_col, clean(F.col(text_col).cast("string")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length(text_col).cast("long"), F.col("n_chars")))
    return out.select(*docs.columns)
