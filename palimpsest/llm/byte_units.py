"""Byte-level BPE over whole texts: cut at places no token crosses, encode each distinct part once.

A space directly before a visible character always starts a token of the byte-level pattern, whatever stands
before it, so the pieces between such spaces are encoded independently of one another.
"""

from __future__ import annotations

import os
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np

from palimpsest.llm.common import ENTRY

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: A space before anything that Python or the tokenizer calls white space is no cut.
CUT = re.compile(r" (?=\S)")
ODD = re.compile(r" [\t-\r\x1c-\x20\x85\xa0  -     　]")
ASCII_ODD = tuple(" " + chr(c) for c in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32))


def resolve(vocabulary: str) -> str:
    """A path, or the name of a file of the public_tokenizers package on the machine that runs this."""
    if os.sep in vocabulary:
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


_loaded: dict[str, object] = {}


def load(vocabulary: str):
    """The tokenizer, once for each worker process, without truncation or padding."""
    if vocabulary not in _loaded:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(resolve(vocabulary))
        tok.no_truncation()
        tok.no_padding()
        _loaded[vocabulary] = tok
    return _loaded[vocabulary]


def cut(text: str) -> list[str]:
    """The pieces of a text. All but the first stood behind a space, which is left out here."""
    odd = any(x in text for x in ASCII_ODD) if text.isascii() else ODD.search(text)
    return CUT.split(text) if odd or text.endswith(" ") else text.split(" ")


def by_bytes(pieces: list[str], most: int) -> list[list[str]]:
    """Batches of about equal bytes, in order."""
    out: list[list[str]] = [[]]
    size = 0
    for p in pieces:
        n = len(p) if p.isascii() else len(p.encode("utf-8", "surrogatepass"))
        if size and size + n > most:
            out.append([])
            size = 0
        out[-1].append(p)
        size += n + 8
    return out


#: Texts of these characters alone are cut into the pattern's tokens here, as each of them is a plain letter, digit, mark
#: or white space; pieces with others go to the library whole. (Letters come first: no contraction begins with one.)
PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")
WORDS = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ÿ]+|\s+(?!\S)|\s+")


#: Words that come apart again where they are written one behind the other.
SIMPLE = re.compile(r" [A-Za-zÀ-ÖØ-öø-ÿ]+")


class Pieces:
    """The library's ids of texts, word by word: each distinct word is encoded once, within a bound of bytes.

    A word has a number, in order of first use; `first` and `n` say where its ids stand in `ids`. So a text is looked up in one
    pass, and the rest is done for a whole slice of texts at once. At the bound all are forgotten: the frequent words are back
    after one slice. New words that are a space and letters are encoded some hundreds in one text, and their ids told apart by
    the bytes that each token stands for; all others are texts of their own.
    """

    def __init__(self, vocabulary: str, batch_bytes: int = 1 << 18, together: int = 500, most_bytes: int = 144 << 20):
        self.tok, self.batch_bytes, self.together, self.most_bytes = load(vocabulary), batch_bytes, together, most_bytes
        self.own_words = '"use_regex":true' in self.tok.pre_tokenizer.__getstate__().decode().replace(" ", "") and self.tok.normalizer is None
        self.special = [x.content for x in self.tok.get_added_tokens_decoder().values()]
        vocab = self.tok.get_vocab()
        self.token_bytes = np.zeros(max(vocab.values()) + 1, dtype=np.int64)  # a byte-level token has a character for each byte
        for token, i in vocab.items():
            self.token_bytes[i] = len(token)
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = defaultdict(count().__next__)
        self.ids, self.first, self.n = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)
        self.bytes = self.n_ids = 0

    def _is_plain(self, text: str) -> bool:
        return self.own_words and PLAIN.fullmatch(text) is not None and not any(x in text for x in self.special)

    def words(self, text: str) -> list[str]:
        """Parts that are encoded independently; joined they are the text."""
        if self._is_plain(text):
            return WORDS.findall(text)
        out: list[str] = []
        for i, piece in enumerate(cut(text)):
            piece = " " * (i > 0) + piece
            out += WORDS.findall(piece) if self._is_plain(piece) else [piece]
        return out

    def _add(self, at: list[int], encoded: list[int], ends: np.ndarray) -> None:
        """Words of the numbers `at` have the ids up to each end."""
        a, b = self.n_ids, self.n_ids + len(encoded)
        self.ids = _room(self.ids, b)
        self.ids[a:b] = encoded
        self.n[at] = np.diff(ends, prepend=0)
        self.first[at] = a + ends - self.n[at]
        self.n_ids = b

    def _encode(self, words: list[str], number: int) -> None:
        """New words, numbered from `number` on."""
        self.n, self.first = _room(self.n, number + len(words)), _room(self.first, number + len(words))
        is_simple = np.fromiter(map(bool, map(SIMPLE.fullmatch, words)), bool, len(words)) & self.own_words
        simple, alone = np.flatnonzero(is_simple).tolist(), np.flatnonzero(~is_simple).tolist()
        groups = [simple[i : i + self.together] for i in range(0, len(simple), self.together)]
        groups = [(g, [words[i] for i in g]) for g in groups] + [([i], [words[i]]) for i in alone]
        for batch in by_bytes(["".join(own) for _, own in groups], self.batch_bytes):
            now, groups = groups[: len(batch)], groups[len(batch) :]
            for (at, own), text, enc in zip(now, batch, self.tok.encode_batch_fast(batch, add_special_tokens=False)):
                ids = enc.ids
                ends = np.array([len(ids)])
                if len(own) > 1:
                    sizes = list(map(len, own)) if text.isascii() else [len(w.encode()) for w in own]
                    ends = np.searchsorted(np.cumsum(self.token_bytes[ids]), np.cumsum(sizes)) + 1
                self._add([number + i for i in at], ids, ends)
        self.bytes += sum(map(len, words)) + ENTRY * len(words)

    def _numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all words of the texts, and how many each text has."""
        if self.bytes > self.most_bytes:
            self._forget()
        before, out = len(self.number), []
        for x in texts:
            own = self.words(x)
            out.append(np.fromiter(map(self.number.__getitem__, own), np.int64, len(own)))
        if new := list(islice(reversed(self.number), len(self.number) - before)):
            self._encode(new[::-1], before)
        return np.concatenate([np.empty(0, np.int64), *out]), np.array(list(map(len, out)), dtype=np.int64)

    def lengths(self, texts: list[str]) -> list[int]:
        """How many ids each text has."""
        numbers, words = self._numbers(texts)
        upto = np.concatenate([[0], np.cumsum(self.n[numbers])])
        return np.diff(upto[np.concatenate([[0], np.cumsum(words)])]).tolist()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        numbers, words = self._numbers(texts)
        n = self.n[numbers]
        upto = np.cumsum(n)
        at = np.repeat(self.first[numbers] - upto + n, n)
        at += np.arange(len(at))
        data = self.ids[at].astype("<u4", copy=False)
        ends = np.concatenate([[0], upto])[np.cumsum(words)].tolist()
        return (data[a:b].tobytes() for a, b in zip([0, *ends], ends))


def _room(values: np.ndarray, n: int) -> np.ndarray:
    """The array, with place for n values at least."""
    if n <= len(values):
        return values
    out = np.empty(max(n, 2 * len(values)), values.dtype)
    out[: len(values)] = values
    return out


def slices(column, most_bytes: int = 4 << 20):
    """(first, texts) of an Arrow string column, so that no more than about most_bytes of text are Python objects at once."""
    i, n = 0, len(column)
    lengths = np.zeros(n, dtype=np.int64)
    if n:
        import pyarrow.compute as pc

        lengths = pc.binary_length(column).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    while i < n:
        base = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
        yield i, column.slice(i, j - i).to_pylist()
        i = j
