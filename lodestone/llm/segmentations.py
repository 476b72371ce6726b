"""SentencePiece encoding and decoding, and distinct sampled segmentations by Gumbel top-k.

Every text has a lattice of the model's pieces (bytes for characters that the
model lacks). Each piece weighs 1 / (rank + 2), its rank being its place in the
order of merges, and a segmentation's probability is proportional to the
product of its pieces' weights. The k segmentations of the highest log-probability plus Gumbel noise
are a sample without replacement. They are found by A*: a region of
segmentations (all that agree up to a word and avoid some choices for it) has
the log of its total probability, which the lattice's forward sums give
exactly, as location of its best perturbed value; the queue pops the region of
the highest one, draws its segmentation, and splits what is left of it, each
part's noise truncated at the value just found. The value of the best region
left over is the threshold for inclusion scores.

Pieces never go from a character into a space after it (those of several spaces
stand within a run of spaces, which goes with the word after it), so a text's
lattice is a chain of words' lattices: forward sums are made once for each
different word of a block of text, whose words are all drawn at once, k times
each. Very long words have their lattices made window by window, from forward
sums alone.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import keyed, remember_only, tune

SPACE = "▁"
#: Spaces and the word after them: no piece goes over the end of one.
split_words = re.compile(f"{SPACE}+[^{SPACE}]*").findall
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
TABLE = 20
#: Characters, about, of the texts that go together and of the words that are drawn together.
CHARS = 500_000
#: Words of more characters are Wide; ends of pieces in one of their windows.
LONG, WINDOW = 2_000, 4_096


def words_of(text: str) -> list[str]:
    """The words of a text with the spaces before them."""
    if SPACE not in text and all(words := text.split(" ")):
        return [SPACE + w for w in words]
    return split_words(SPACE + text.replace(" ", SPACE)) if text else []


def uniform(state: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit states."""
    x = state * M1
    x ^= x >> np.uint64(30)
    x *= M2
    x ^= x >> np.uint64(27)
    x *= M1
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52


def stepped(state: np.ndarray, step: int) -> np.ndarray:
    """The states of the piece drawn after so many others of the word."""
    return state + np.uint64(step * int(M2) % 2**64)


def characters(words: list[str]) -> np.ndarray:
    """The code points of words of equal length, plus one."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), -1).astype(np.uint64) + np.uint64(1)


class Lattices:
    """A model's pieces, looked up by the hash of their characters, and what makes words' lattices of them.

    Words of equal length n share arrays: for each word, end and length of the
    last piece its number (-1: none; -1 - b: a character that goes by its b
    bytes); the share of the forward sum that comes through it, cumulated over
    lengths; the forward sums.
    """

    _known: dict[str, "Lattices"] = {}

    @classmethod
    def of(cls, path: str) -> "Lattices":
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = np.full(256, -1, np.int64)
        self.text: list[bytes] = []
        pieces, ids, weights = [], [], []
        for i in range(m.get_piece_size()):
            p, s = m.id_to_piece(i), m.get_score(i)
            plain = not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))
            if m.is_byte(i):
                self.bytes[int(p[3:5], 16)] = i
            self.text.append(bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace(SPACE, " ").encode() if plain else b"")
            if plain and SPACE in p.lstrip(SPACE):
                raise ValueError(f"a piece goes over a space after a character: {p!r}")
            if plain:
                pieces.append(p)
                ids.append(i)
                weights.append(-np.log(-s + 2))
        self.spelled, self.spelling = np.frombuffer(b"".join(self.text), np.uint8), np.cumsum([0, *map(len, self.text)])
        self.longest = max(map(len, pieces))
        codes = np.zeros((len(pieces), self.longest), np.uint64)
        for r, p in enumerate(pieces):
            codes[r, : len(p)] = [ord(c) + 1 for c in p]
        h = np.zeros(len(pieces), np.uint64)
        for k in range(self.longest):
            h = np.where(codes[:, k] > 0, (h + codes[:, k]) * M1, h)
        # an open table: one place for each hash, the rest by search
        order = np.argsort(h)
        self.hash, self.id = h[order], np.array(ids)[order]
        # of pieces -5 to -2, which are characters of 4 to 1 bytes, of none (-1), and of the model's
        self.weight = np.concatenate([np.arange(4, 0, -1) * -np.log(m.get_piece_size()), [-np.inf], np.array(weights)[order]])
        self.table = np.full(1 << TABLE, -1, np.int32)
        place = (self.hash >> np.uint64(64 - TABLE)).astype(np.int64)
        self.table[place] = np.arange(len(h))
        self.shared = np.bincount(place, minlength=1 << TABLE)[place] > 1
        # words of fewer characters than this have sums of plain numbers, which can't become too small: none weighs less than one of 4 bytes
        self.plain = int(700 / -self.weight.min(where=self.weight > -np.inf, initial=0.0))
        self.number = np.exp(self.weight)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of the piece with each hash, or -1."""
        got = self.table.take((h >> np.uint64(64 - TABLE)).view(np.int64))
        there = got >= 0
        hit = self.hash.take(got, mode="wrap") == h
        hit &= there
        out = np.where(hit, got, np.int32(-1))
        there &= ~hit
        # another piece is in that place: search where there are several
        other = np.flatnonzero(there)
        other = other[self.shared[got.ravel()[other]]]
        if len(other):
            wanted = h.ravel()[other]
            at = np.minimum(np.searchsorted(self.hash, wanted), len(self.hash) - 1)
            out.ravel()[other] = np.where(self.hash[at] == wanted, at, -1)
        return out

    def pieces(self, codes: np.ndarray) -> np.ndarray:
        """The pieces that end at each place of rows of characters, by length."""
        rows, n = codes.shape
        longest = min(n, self.longest)
        # rows stand last in memory, so that every step goes over all of them at once
        codes = np.ascontiguousarray(codes.T)
        piece = np.full((n + 1, longest, rows), -1, np.int32)
        h = np.zeros((n, rows), np.uint64)
        for k in range(longest):
            h = (h[: n - k] + codes[k:]) * M1
            piece[k + 1 :, k] = self.find(h)
        alone = piece[1:, 0]
        size = 1 + (codes > 0x80).astype(np.int32) + (codes > 0x800) + (codes > 0x10000)
        piece[1:, 0] = np.where(alone < 0, -1 - size, alone)
        return piece.transpose(2, 0, 1)

    def weights(self, piece: np.ndarray) -> np.ndarray:
        return self.weight.take(piece + 5)

    def build(self, words: list[str]) -> dict[str, np.ndarray]:
        """Lattices of words of equal length."""
        piece = self.pieces(characters(words))
        rows, n, longest = len(words), piece.shape[1] - 1, piece.shape[2]
        plain = n < self.plain
        weight = (self.number if plain else self.weight).take(piece.transpose(1, 2, 0) + 5)
        forward, share = np.empty((n + 1, rows)), np.ones((rows, n + 1, longest))
        forward[0] = 1 if plain else 0
        for e in range(1, n + 1):
            k = min(e, longest)
            ways, before = weight[e, :k], forward[e - k : e][::-1]
            if plain:
                ways *= before
            else:
                ways += before
                most = ways.max(axis=0)
                np.exp(ways - most, out=ways)
            for i in range(1, k):
                ways[i] += ways[i - 1]
            forward[e] = ways[-1] if plain else most + np.log(ways[-1])
            share[:, e, : k - 1] = (ways[:-1] / ways[-1]).T
        return {"piece": piece, "forward": (np.log(forward) if plain else forward).T, "share": share}


def draw(lattice: dict[str, np.ndarray], row: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Paths of words of equal length, each from its state, as flags of the ends of pieces."""
    share = lattice["share"]
    n, flat = share.shape[1] - 1, share.reshape(-1, share.shape[2])
    on = np.zeros((len(row), n + 1), bool)
    on[:, n] = True
    live, at, step = np.arange(len(row)), np.full(len(row), n), 0
    while len(live):
        # the first share above the number
        at -= 1 + (flat.take(row * (n + 1) + at, axis=0) <= uniform(stepped(state, step))[:, None]).argmin(axis=1)
        more = at > 0
        live, at, row, state = live[more], at[more], row[more], state[more]
        on[live, at] = True
        step += 1
    return on


class Narrow:
    """The lattice of one word."""

    def __init__(self, lattices: Lattices, word: str, lattice: dict[str, np.ndarray]):
        self.lattices, self.word, self.n, self.lattice = lattices, word, len(word), lattice
        self.total = float(lattice["forward"][self.n])

    def at(self, e: int) -> tuple[np.ndarray, np.ndarray]:
        """The pieces that end at a place, by length, and their cumulated shares."""
        return self.lattice["piece"][e], self.lattice["share"][e]

    def path(self, state: np.uint64) -> tuple[int, ...]:
        """The path drawn from a state, as the ends of its pieces."""
        out, at, step, u = [], self.n, 0, []
        while at > 0:
            if len(out) == step + len(u):
                step, u = len(out), uniform(state + (np.arange(step + len(u), step + len(u) + min(self.n, WINDOW), dtype=np.uint64) * M2)).tolist()
            out.append(at)
            at -= 1 + int(self.at(at)[1].searchsorted(u[len(out) - 1 - step], "right"))
        return tuple(out[::-1])

    def logp(self, path: tuple[int, ...]) -> float:
        total, a = -self.total, 0
        for e in path:
            total += float(self.lattices.weights(self.at(e)[0][e - a - 1]))
            a = e
        return min(0.0, total)

    def ids(self, path: tuple[int, ...]) -> np.ndarray:
        out, a = [], 0
        for e in path:
            p = int(self.at(e)[0][e - a - 1])
            out += [int(self.lattices.id[p])] if p >= 0 else self.lattices.bytes[list(self.word[a:e].encode("utf-8", "surrogatepass"))].tolist()
            a = e
        return np.array(out, "<u4")

    def leaving(self, e: int, ahead: set[int], reach: float) -> tuple[np.ndarray, list[float]]:
        """The probabilities of the lengths of the piece that ends at a place, without those to the places ahead, and the latter's."""
        p = self.at(e)[1] * reach
        p[1:] -= p[:-1].copy()
        gone = [float(p[e - a - 1]) for a in ahead]
        for a in ahead:
            p[e - a - 1] = 0.0
        return p, gone

    def apart(self, barred: list[tuple[int, ...]]) -> tuple[list[tuple], np.ndarray]:
        """Where paths can leave all of the barred ones, from the end of the word on: (barred path, place in it from its end, lengths' probabilities), and the probability of each."""
        back = [(*path[::-1], 0) for path in barred]
        nodes, mass = [], []
        todo = [(back, 0, 1.0)]
        while todo:
            own, i, reach = todo.pop()
            # what is reached with less counts for nothing beside the rest
            while own[0][i] > 0 and reach > 1e-290:
                ahead = sorted({path[i + 1] for path in own})
                p, gone = self.leaving(own[0][i], ahead, reach)
                nodes.append((own[0], i, ahead, reach))
                mass.append(float(p.sum()))
                if len(ahead) > 1:
                    todo += [([path for path in own if path[i + 1] == a], i + 1, r) for a, r in zip(ahead, gone)]
                    break
                i, reach = i + 1, gone[0]
        return nodes, np.array(mass)

    def other(self, barred: list[tuple[int, ...]], rng: np.random.Generator) -> tuple[int, ...]:
        """A path given that it is none of the barred ones: the place where it leaves them is drawn, the rest is free."""
        nodes, mass = self.apart(barred)
        path, i, ahead, reach = nodes[int(rng.choice(len(mass), p=mass / mass.sum()))]
        p, _ = self.leaving(path[i], ahead, reach)
        out = list(path[: i + 1])
        at = out[-1] - 1 - int(rng.choice(len(p), p=p / p.sum()))
        while at > 0:
            out.append(at)
            at -= 1 + int(self.at(at)[1].searchsorted(rng.random(), "right"))
        return tuple(out[::-1])


class Wide(Narrow):
    """The lattice of one very long word: forward sums for all of it, the rest for one window at a time."""

    def __init__(self, lattices: Lattices, word: str):
        self.lattices, self.word, self.n = lattices, word, len(word)
        self.forward = np.zeros(self.n + 1)
        for a in range(0, self.n, WINDOW):
            weight = lattices.weights(self.window(a))
            for i in range(1, len(weight)):
                e = a + i
                k = min(e, weight.shape[1])
                own = weight[i, :k] + self.forward[e - k : e][::-1]
                most = own.max()
                self.forward[e] = most + np.log(np.exp(own - most).sum())
        self.total, self.held = float(self.forward[self.n]), None

    def window(self, a: int) -> np.ndarray:
        """The pieces that end at places a to a + WINDOW."""
        first = max(0, a - self.lattices.longest)
        return self.lattices.pieces(characters([self.word[first : a + WINDOW]]))[0, a - first :]

    def at(self, e: int) -> tuple[np.ndarray, np.ndarray]:
        a = (e - 1) // WINDOW * WINDOW
        if self.held is None or self.held[0] != a:
            piece = self.window(a)
            ends = np.arange(a, a + len(piece))
            from_ = ends[:, None] - 1 - np.arange(piece.shape[1])
            ways = np.where(from_ >= 0, self.lattices.weights(piece) + self.forward[np.maximum(from_, 0)], -np.inf)
            share = np.cumsum(np.exp(ways - np.where(ends > 0, self.forward[ends], 0.0)[:, None]), axis=1)
            share[share >= share[:, -1:]] = 1.0
            self.held = (a, piece, share)
        return self.held[1][e - a], self.held[2][e - a]


class Batch:
    """The words of some texts, and k drawn paths of each word: log-probabilities, and ids with where each word's begin."""

    def __init__(self, lattices: Lattices, texts: list[str], rngs: list[np.random.Generator], k: int):
        self.lattices = lattices
        words = [words_of(t) for t in texts]
        self.first = np.cumsum([0, *map(len, words)])
        self.words = list(chain.from_iterable(words))
        self.states = np.concatenate([np.zeros((k, 0), np.uint64), *(rng.integers(0, 2**64, (k, len(own)), np.uint64) for rng, own in zip(rngs, words))], axis=1)
        self.logp, self.sizes = np.zeros((k, len(self.words))), np.zeros((k, len(self.words)), np.int64)
        self.number: dict[str, int] = {}
        self.last: Wide | None = None
        ids: list[list[np.ndarray]] = [[np.zeros(0, "<u4")] for _ in range(k)]
        length = np.fromiter(map(len, self.words), np.int64, len(self.words))
        # a long word stands alone, other blocks have about as many characters
        block = np.cumsum(length) // (2 * CHARS) + np.cumsum(length > LONG) + np.cumsum(np.append(False, (length > LONG)[:-1]))
        cuts = np.flatnonzero(np.diff(block, prepend=-1))
        for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(self.words)]):
            for out, own in zip(ids, self.wide(a) if length[a] > LONG else self.narrow(a, z, length[a:z])):
                out.append(own)
        self.ids = [np.concatenate(own) for own in ids]
        self.starts = np.concatenate([np.zeros((k, 1), np.int64), np.cumsum(self.sizes, axis=1)], axis=1)

    def wide(self, a: int) -> list[np.ndarray]:
        """Draws a long word; its ids."""
        word, out = self.one(self.words[a]), []
        for j, state in enumerate(self.states[:, a]):
            path = word.path(state)
            out.append(word.ids(path))
            self.logp[j, a], self.sizes[j, a] = word.logp(path), len(out[-1])
        return out

    def narrow(self, a: int, z: int, length: np.ndarray) -> list[np.ndarray]:
        """Draws words a to z; their ids."""
        own = self.words[a:z]
        self.number = number = defaultdict(count().__next__)
        kind = np.fromiter(map(number.__getitem__, own), np.int64, len(own))
        types = list(number)
        n_of = np.fromiter(map(len, types), np.int64, len(types))
        self.row, self.of_length = np.zeros(len(types), np.int64), {}
        groups = []
        for n in np.unique(n_of).tolist():
            which = np.flatnonzero(n_of == n)
            self.row[which] = np.arange(len(which))
            self.of_length[n] = self.lattices.build([types[i] for i in which.tolist()])
            groups.append((self.of_length[n], np.flatnonzero(length == n)))
        out = []
        for j, state in enumerate(self.states[:, a:z]):
            parts = []
            for lat, members in groups:
                row = self.row[kind[members]]
                w, e = np.nonzero(draw(lat, row, state[members])[:, 1:])
                first = np.flatnonzero(np.diff(w, prepend=-1))
                before = np.concatenate([[-1], e[:-1]])
                before[first] = -1
                pieces = lat["piece"]
                piece = pieces.ravel().take((row[w] * pieces.shape[1] + e + 1) * pieces.shape[2] + e - before - 1)
                size = np.where(piece >= 0, 1, -1 - piece)
                at = np.cumsum(size) - size
                self.logp[j, a + members] = np.minimum(np.add.reduceat(self.lattices.weights(piece), first) - lat["forward"][row, -1], 0)
                self.sizes[j, a + members] = np.diff(np.append(at[first], size.sum()))
                parts.append((members, w, e, piece, at - at[first][w]))
            starts = np.cumsum(self.sizes[j, a:z]) - self.sizes[j, a:z]
            ids = np.zeros(int(self.sizes[j, a:z].sum()), "<u4")
            for members, w, e, piece, at in parts:
                at += starts[members][w]
                ids[at] = self.lattices.id.take(piece, mode="wrap")
                for i in np.flatnonzero(piece < 0).tolist():
                    raw = own[members[w[i]]][e[i]].encode("utf-8", "surrogatepass")
                    ids[at[i] : at[i] + len(raw)] = self.lattices.bytes[list(raw)]
            out.append(ids)
        return out

    def one(self, word: str) -> Narrow:
        """The lattice of a word: that of the last block, or made anew."""
        if len(word) > LONG:
            if self.last is None or self.last.word is not word:
                self.last = Wide(self.lattices, word)
            return self.last
        i = self.number.get(word)
        lat, r = (self.of_length[len(word)], self.row[i]) if i is not None else (self.lattices.build([word]), 0)
        return Narrow(self.lattices, word, {k: v[r] for k, v in lat.items()})


def segmentations(lattices: Lattices, texts: list[str], keys: list[int], k: int) -> Iterator[tuple[int, int, bytes, float, float, float]]:
    """(text, rank, ids, log-probability, perturbed value, inclusion) of up to k distinct segmentations of each text."""
    rngs = [np.random.Generator(np.random.PCG64(key % 2**64)) for key in keys]
    batch = Batch(lattices, texts, rngs, k)
    for d, rng in enumerate(rngs):
        # a region: (value, word, barred paths of it, the draw that its prefix comes from, whose path for the word is barred too); the whole is a region without a word
        queue: list[tuple] = [(float(-np.log(-np.log(rng.random()))), -1, (), None)]
        found: list[tuple] = []
        a, b = int(batch.first[d]), int(batch.first[d + 1])
        for j in range(k):
            if not queue:
                break
            value, word, barred, before = queue.pop(max(range(len(queue)), key=lambda i: queue[i][0]))
            own, paths = batch.logp[j, a:b], {}
            if before is not None:
                # up to the word as the region has it, then another path for it
                own = own.copy()
                own[: word - a] = before["logp"][: word - a]
                paths = {w: p for w, p in before["paths"].items() if w < word}
                lattice, barred = batch.one(batch.words[word]), (*barred, path_of(batch, before, word))
                paths[word] = lattice.other(list(barred), rng)
                own[word - a] = lattice.logp(paths[word])
            draw = {"logp": own, "paths": paths, "number": j, "start": a if before is None else word + 1, "before": before}
            found.append((value, draw, float(own.sum())))
            if a == b:
                continue
            # what is left of the region, by the first word that differs
            lo = a if before is None else word
            prefix = np.cumsum(own) - own
            with np.errstate(divide="ignore"):
                location = prefix[lo - a :] + np.log(-np.expm1(np.minimum(own[lo - a :], 0)))
                if before is not None:
                    location[0] = prefix[word - a] + np.log(lattice.apart([*barred, paths[word]])[1].sum())
            noise = -np.log(1 - rng.random(len(location)))
            with np.errstate(divide="ignore", invalid="ignore"):
                values = np.where(location > -np.inf, -np.logaddexp(-value, np.log(noise) - location), -np.inf)
            # of these no more than k can come before the end, and one is the threshold
            for i in np.argpartition(-values, min(k, len(values) - 1))[: k + 1].tolist():
                if values[i] > -np.inf:
                    w = lo + i
                    queue.append((float(values[i]), w, barred if w == word else (), draw))
        threshold = max((q[0] for q in queue), default=-np.inf)
        for rank, (value, draw, total) in enumerate(found, 1):
            yield d, rank, b"".join(ids_of(batch, draw, a, b)), total, value, float(-np.expm1(-np.exp(min(50.0, total - threshold)))) if threshold > -np.inf else 1.0


def path_of(batch: Batch, draw: dict, word: int) -> tuple[int, ...]:
    """A word's path in a draw: its own from where it starts, else that of the draw it branched from."""
    while True:
        if word in draw["paths"]:
            return draw["paths"][word]
        if word >= draw["start"]:
            return batch.one(batch.words[word]).path(batch.states[draw["number"], word])
        draw = draw["before"]


def ids_of(batch: Batch, draw: dict, lo: int, hi: int) -> list[bytes]:
    """The ids of words lo to hi in a draw."""
    if draw["before"] is None or lo >= draw["start"]:
        out, starts = batch.ids[draw["number"]], batch.starts[draw["number"]]
        return [out[starts[lo] : starts[hi]].tobytes()]
    word, parts = draw["start"] - 1, []
    if lo < word:
        parts += ids_of(batch, draw["before"], lo, min(hi, word))
    if lo <= word < hi:
        parts.append(batch.one(batch.words[word]).ids(draw["paths"][word]).tobytes())
    return parts + (ids_of(batch, draw, draw["start"], hi) if hi > draw["start"] else [])


def spelled(lattices: Lattices, ids: np.ndarray) -> bytes:
    """What the pieces spell, one after another."""
    first = lattices.spelling[ids]
    size = lattices.spelling[1:][ids] - first
    end = np.cumsum(size)
    return lattices.spelled[np.repeat(first - end + size, size) + np.arange(end[-1] if len(end) else 0)].tobytes()


def decode(lattices: Lattices, ids: np.ndarray) -> str:
    """The text of ids, without the space that stands before every text."""
    out = spelled(lattices, ids).decode("utf-8", "replace")
    return out[1:] if out[:1] == " " else out


def encode(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the model's own encoding of every text."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattices = Lattices.of(model)
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id.astype("Int64"), "ids": lattices.model.encode(b.text.tolist(), num_threads=1)})

    return keyed(docs, id_col, text_col).mapInPandas(run, "doc_id long, ids array<int>")


def decoded(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""
    tune(encoded.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattices = Lattices.of(model)
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id.astype("Int64"), "text": [decode(lattices, np.asarray(x, np.int64)) for x in b.ids]})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")


SAMPLES = "doc_id long, rank int, n_pieces long, ids_crc32 long, log_prob double, perturbed double, inclusion double, round_trip boolean"


def sample(docs: DataFrame, model: str, *, k: int = 2, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Up to k distinct segmentations of every text, in the order of their perturbed values; fewer where there are no more.

    The noise depends on the seed and the row's id alone. A null or empty text
    has the empty segmentation. round_trip tells whether decoding gives the
    text back (U+2581 counts as a space). Rows that repeat give equal results;
    ids may be null; no rows give no rows.
    """
    tune(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        remember_only()
        lattices = Lattices.of(model)
        for b in batches:
            size = b.text.str.len().cumsum().to_numpy() // CHARS
            for _, some in b.groupby(size, sort=False):
                names = [None if x else int(i) for i, x in zip(some.doc_id, some.doc_id.isna())]
                texts = some.text.tolist()
                rows, wanted = [], [(" " + t.replace(SPACE, " ") if t else "").encode("utf-8", "surrogatepass") for t in texts]
                for d, rank, ids, total, value, inclusion in segmentations(lattices, texts, [zlib.crc32(f"{seed} {i}".encode()) << 20 | seed for i in names], k):
                    numbers = np.frombuffer(ids, "<u4")
                    same = spelled(lattices, numbers) == wanted[d]
                    rows.append((names[d], rank, len(numbers), zlib.crc32(ids), total, value, inclusion, same, *([numbers] if with_ids else [])))
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in kind.split(", ")])
                yield out.assign(doc_id=out.doc_id.astype("Int64"))

    kind = SAMPLES + (", ids array<long>" if with_ids else "")
    return keyed(docs, id_col, text_col).mapInPandas(run, kind)
