"""Byte-pair encoding of whole texts with a public vocabulary file, and decoding.

A word is a doubly linked list of symbols. A heap holds the merge ranks of neighbouring pairs; the least rank is taken
first, the left-most on equal ranks, and entries whose symbols have changed since are skipped as stale. Decoding
concatenates vocabulary strings. Workers keep the words they have encoded, up to a number that bounds their memory; when
it is reached they start anew, which changes the time only.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vakanta.llm.common import kept_in_worker

KEPT_WORDS = 600_000
LONG_WORD = 256


def byte_symbols() -> list[str]:
    """The visible character that stands for each byte: itself if printable in Latin-1, else the next one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [], 256
    for b in range(256):
        if b in visible:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


def merge(symbols: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Apply merges (left id, right id) -> (rank, new id) in order of rank, left-most first."""
    n = len(symbols)
    if n == 1:
        return symbols
    get = pairs.get
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(m[0], i, m[1], symbols[i], symbols[i + 1]) for i in range(n - 1) if (m := get((symbols[i], symbols[i + 1])))]
    heapify(heap)
    while heap:
        _, i, new, left, right = heappop(heap)
        if symbols[i] != left:
            continue
        j = after[i]
        if j >= n or symbols[j] != right:
            continue
        symbols[i], symbols[j] = new, -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if m := get((new, symbols[k])):
                heappush(heap, (m[0], i, m[1], new, symbols[k]))
        h = before[i]
        if h >= 0 and (m := get((symbols[h], new))):
            heappush(heap, (m[0], h, m[1], symbols[h], new))
    return [s for s in symbols if s >= 0]


class WordBpe:
    """Encoder and decoder of a vocabulary file with words in lower case, byte symbols and an ending on each word's last symbol."""

    def __init__(self, file: str):
        import regex

        with open(file, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        vocab: dict[str, int] = model["vocab"]
        self.ending = model.get("end_of_word_suffix") or ""
        self.pairs = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs[vocab[left], vocab[right]] = (rank, vocab[left + right])
        symbols = byte_symbols()
        self.inner = [vocab.get(s) for s in symbols]
        self.last = [vocab.get(s + self.ending) for s in symbols]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.strings = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        split = next(p for p in data["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # the library's white space is Unicode's White_Space, which does not hold the separators 1C to 1F
        white = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"[^\s", "[^" + white)).findall
        self.runs = regex.compile(f"[^{white}]+").findall
        self.separators = regex.compile(r"[\x1c-\x1f]").search
        self.cut = regex.compile("|".join(map(regex.escape, self.special))).split if self.special else None
        self.found = regex.compile("|".join(map(regex.escape, self.special))).findall if self.special else None
        self.kept_words: dict[str, bytes] = {}
        self.kept_pieces: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        """Ids of one word as little-endian unsigned 32-bit integers."""
        if (ids := self.kept_words.get(word)) is None:
            raw = word.encode("utf-8", "surrogatepass")
            symbols = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
            ids = array("I", merge([s for s in symbols if s is not None], self.pairs)).tobytes()
            if len(word) <= LONG_WORD:
                if len(self.kept_words) >= KEPT_WORDS:
                    self.kept_words.clear()
                self.kept_words[word] = ids
        return ids

    def piece(self, piece: str) -> bytes:
        """Ids of a run without white space."""
        if (ids := self.kept_pieces.get(piece)) is None:
            ids = b"".join(map(self.word, self.words(piece)))
            if len(piece) <= LONG_WORD:
                if len(self.kept_pieces) >= KEPT_WORDS:
                    self.kept_pieces.clear()
                self.kept_pieces[piece] = ids
        return ids

    def plain(self, text: str) -> list[bytes]:
        from unicodedata import normalize

        # lower case letter by letter, so a capital sigma is the same at a word's end
        low = normalize("NFC", text).replace("Σ", "σ").lower()
        get, make = self.kept_pieces.get, self.piece
        pieces = self.runs(low) if self.separators(low) else low.split()
        return [get(p) or make(p) for p in pieces]

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; strings of special tokens become those tokens."""
        if self.cut is None or not any(s in text for s in self.special):
            return b"".join(self.plain(text))
        out: list[bytes] = []
        for between, token in zip(self.cut(text), chain(self.found(text), [None]), strict=True):
            out += self.plain(between)
            if token is not None:
                out.append(array("I", [self.special[token]]).tobytes())
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Vocabulary strings of the ids, special ones included, with a blank between."""
        strings = self.strings
        return " ".join([strings[i] for i in memoryview(ids).cast("I").tolist()])


def encode_documents(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids binary, decoded string): ids as little-endian unsigned 32-bit integers and the text they decode to.

    Null texts are empty; empty texts have no ids and decode to the empty text. Rows, keys and nulls of keys are kept as
    they come, other columns are ignored. ``vocabulary`` is a file that every worker can read. Batches stream: a worker
    holds one text with its ids at a time besides the words it keeps. The text is encoded where it is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = kept_in_worker("bpe", vocabulary, lambda: WordBpe(vocabulary))
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                ids = [coder.encode(t.as_py() or "") for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.binary()), pa.array(map(coder.decode, ids), pa.string())],
                    ["key", "ids", "decoded"],
                )

    narrow = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(run, "key long, ids binary, decoded string").withColumnRenamed("key", key)
