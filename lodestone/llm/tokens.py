"""Token ids of texts, by the tokenizers library, with a bounded cache of short pieces.

Both vocabularies split a text into words before merging, so the ids of a text
are the ids of its pieces one after another wherever a cut falls on such a split.
Pieces are cut only where every version of the Unicode tables agrees, and each
distinct piece is encoded by the library once per worker; texts with other
characters are cut at plain spaces only.
"""

from __future__ import annotations

import os
import re

import numpy as np

from .common import REMEMBERED, remember_only

#: Entries of a worker's cache; its longer pieces go when it is full.
CACHE = 600_000

LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Characters whose class is beyond doubt; the apostrophe starts contractions, so it is not one.
PLAIN = re.compile(f"[\n -&(-~{LETTERS}]*").fullmatch
BYTE_WORDS = re.compile(f" ?[{LETTERS}]++|(?: (?![{LETTERS}])|[^ {LETTERS}]++)++").findall
#: What is one word to the byte vocabulary in every table, and the characters that its model has for bytes.
BYTE_WORD = re.compile(f" ?[{LETTERS}]+").fullmatch
SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = np.zeros(256, "<u2")
BYTE_CHARS[SEEN] = SEEN
BYTE_CHARS[np.setdiff1d(np.arange(256), SEEN)] = 256 + np.arange(256 - len(SEEN))
BYTE_SPACES = re.compile("(?= [!-~À-ɏ])").split
#: Lower case of these is one letter in every table.
PLAIN_WORDS = re.compile("[\n -&(-~À-ÖØ-öø-ÿ]*").fullmatch
WORDS = re.compile("[a-zß-öø-ÿ]+|[^ \na-zß-öø-ÿ]+").findall


def byte_pieces(text: str) -> list[str]:
    return BYTE_WORDS(text) if PLAIN(text) else BYTE_SPACES(text)


def word_pieces(text: str) -> list[str]:
    return WORDS(text.lower()) if PLAIN_WORDS(text) else text.replace("\n", " ").split(" ")


class Encoder:
    """ids(texts): for each text its ids as little-endian unsigned 32-bit bytes."""

    _known: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.model._resize_cache(0)  # a piece comes but once
        plain = self.tokenizer.normalizer is None
        self.pieces = byte_pieces if plain else word_pieces
        # no added token can stand inside a word
        self.direct = plain and all(t.special for t in self.tokenizer.get_added_tokens_decoder().values())
        # letters never share an id with what stands between them here
        self.between = "\n" if plain else " 0 "
        self.mark = self.tokenizer.encode(self.between, add_special_tokens=False).ids[0]
        self.cache: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> "Encoder":
        remember_only("tokens")
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def learn_words(self, words: list[str]) -> None:
        """Encode words of the byte vocabulary into the cache by the library's model itself, without its splitting."""
        tokenize, ids, ends = self.tokenizer.model.tokenize, [], [0]
        for p in BYTE_CHARS[np.frombuffer("\n".join(words).encode(), np.uint8)].tobytes().decode("utf-16-le").split(chr(BYTE_CHARS[10])):
            ids += [t.id for t in tokenize(p)]
            ends.append(len(ids))
        data = np.array(ids, "<u4").tobytes()
        for p, a, z in zip(words, ends, ends[1:]):
            self.cache[p] = data[4 * a : 4 * z]

    def learn(self, new: set[str]) -> None:
        """Encode pieces into the cache: words by the model, others of letters in one text, which is quicker, the rest one by one."""
        if self.direct and (words := list(filter(BYTE_WORD, new))):
            self.learn_words(words)
            new = new.difference(words)
        letters = [p for p in new if p.isalpha() or p[:1] == " " and p[1:].isalpha()]
        if letters:
            ids = np.array(self.tokenizer.encode_batch_fast([self.between.join(letters)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.append(np.flatnonzero(ids == self.mark), len(ids)).tolist()
            if len(ends) == len(letters):
                data, at = ids.tobytes(), 0
                for p, z in zip(letters, ends):
                    self.cache[p] = data[4 * at : 4 * z]
                    at = z + 1
        rest = [p for p in new if p not in self.cache]
        for p, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            self.cache[p] = np.array(e.ids, "<u4").tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        out, cache = [], self.cache
        for at in range(0, len(texts), 128):
            cut = [self.pieces(t) for t in texts[at : at + 128]]
            if len(cache) > CACHE:
                # the shorter half stays: short words come again most
                middle = sorted(map(len, cache))[len(cache) // 2]
                for p in [p for p in cache if len(p) >= middle]:
                    del cache[p]
            if new := set().union(*cut).difference(cache):
                self.learn(new)
            out += [b"".join(map(cache.__getitem__, own)) for own in cut]
        return out


REMEMBERED["tokens"] = Encoder._known.clear
