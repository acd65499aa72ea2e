"""BPE encoding and decoding: a priority queue of merge ranks over a doubly linked list of symbols.

The vocabulary file is data of a public tokenizer; the merges are done here. The file's own normaliser and
pre-tokeniser rules are applied by the library for each distinct run of visible characters, but for plain Latin text.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from palimpsest.llm.byte_units import load, resolve, slices
from palimpsest.llm.common import Remembered, prepare, texts

#: White space of the pre-tokeniser. Python's split() also cuts at 1C to 1F, which are symbols there.
SPACES = re.compile(r"[\t-\r \x85\xa0  -     　]+")
SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Texts of these characters alone are cut here, as each is a plain letter, digit, mark or white space and has one lower
#: case. What the file's pattern comes to for them:
PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿß]+|[0-9]|[^\sa-z0-9à-öø-ÿß]+")
#: The character that stands for each byte in the vocabulary: its own where that is a visible one of Latin-1, else one above.
_visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: chr(b) for b in _visible} | {b: chr(256 + n) for n, b in enumerate(sorted(set(range(256)).difference(_visible)))}


class Bpe:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, vocabulary: str, most_bytes: int = 160 << 20):
        with open(resolve(vocabulary), encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.strings = {i: s for s, i in [*self.vocab.items(), *self.special.items()]}
        self.packed = {i: i.to_bytes(4, "little") for i in self.strings}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[self.vocab[a], self.vocab[b]] = rank, self.vocab[a + b]
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.tok = load(vocabulary)
        self.own_words = "[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in json.dumps(spec.get("pre_tokenizer"), ensure_ascii=False).replace("\\\\", "\\") and '"ByteLevel"' in json.dumps(spec.get("pre_tokenizer")) and bool(self.suffix)
        self.words = Remembered(lambda w: self._coded("".join(map(BYTES.__getitem__, w.encode()))), most_bytes // 2)
        self.coded = Remembered(self._coded, most_bytes // 4)  # the same words may come as characters and as the pre-tokeniser's
        self.runs = Remembered(self._run, most_bytes // 4)

    def merge(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        ids = [self.vocab.get(c) for c in (*word[:-1], word[-1] + self.suffix)]
        ids = [i for i in ids if i is not None]
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = []
        for i in range(n - 1):
            if m := self.merges.get((ids[i], ids[i + 1])):
                queue.append((m[0], i, ids[i], ids[i + 1], m[1]))
        heapq.heapify(queue)
        while queue:
            _, i, left, right, new = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue  # stale: one of the two symbols has merged meanwhile
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if m := self.merges.get((new, ids[k])):
                    heapq.heappush(queue, (m[0], i, new, ids[k], m[1]))
            if (h := before[i]) >= 0 and (m := self.merges.get((ids[h], new))):
                heapq.heappush(queue, (m[0], h, ids[h], new, m[1]))
        return [i for i in ids if i >= 0]

    def _coded(self, word: str) -> bytes:
        return b"".join(map(self.packed.__getitem__, self.merge(word)))

    def _is_plain(self, text: str) -> bool:
        return self.own_words and PLAIN.fullmatch(text) is not None and not (self.cut_special and self.cut_special.search(text))

    def _plain(self, run: str) -> bytes:
        """A run without special strings."""
        pieces = self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(run) if self.tok.normalizer else run)
        return b"".join(self.coded[w] for w, _ in pieces if w)

    def _run(self, run: str) -> bytes:
        if self._is_plain(run):
            return b"".join(map(self.words.__getitem__, WORDS.findall(run.lower())))
        if self.cut_special and self.cut_special.search(run):
            return b"".join(self.special[x].to_bytes(4, "little") if x in self.special else self._plain(x) for x in self.cut_special.split(run) if x)
        return self._plain(run) if run else b""

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self._is_plain(text):
            return b"".join(map(self.words.__getitem__, WORDS.findall(text.lower())))
        runs = SPACES.split(text) if any(c in text for c in SEPARATORS) else text.split()
        return b"".join(map(self.runs.__getitem__, runs))

    def decode(self, ids: bytes | np.ndarray) -> str:
        """The vocabulary strings of the ids, joined as a file without a decoder is: by one space."""
        ids = np.frombuffer(ids, dtype="<u4") if isinstance(ids, bytes) else ids
        return " ".join(map(self.strings.__getitem__, ids.tolist()))


_coders: dict[str, Bpe] = {}


def coder(vocabulary: str) -> Bpe:
    if vocabulary not in _coders:
        _coders[vocabulary] = Bpe(vocabulary)
    return _coders[vocabulary]


def encode_decode(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", outputs: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 for each row; with outputs also ids (array<int>) and decoded.

    Narrow: nothing is shuffled, one text is in hand at a time. Null or empty text: no ids, empty decoding. Null keys,
    ties and repeated rows stay as they are; an empty table gives an empty result; other columns are ignored.
    """
    prepare(docs.sparkSession)

    def run(batches):
        bpe = coder(vocabulary)
        for batch in batches:
            n, ids_hash, text_hash, all_ids, all_texts = [], [], [], [], []
            for _, part in slices(batch.column(1)):
                for x in part:
                    ids = bpe.encode(x)
                    back = bpe.decode(ids)
                    n.append(len(ids) // 4)
                    ids_hash.append(hashlib.sha256(ids).hexdigest())
                    text_hash.append(hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
                    if outputs:
                        all_ids.append(np.frombuffer(ids, dtype="<i4"))
                        all_texts.append(back)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
            if outputs:
                columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"{key} long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * outputs
    return texts(docs, key, text).mapInArrow(run, schema)
