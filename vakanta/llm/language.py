"""Language identification by unigram piece models that sum over all segmentations of a word.

Each language has a probability for every piece of one fixed public vocabulary. The probability of a word is the sum,
over all ways to cut it into pieces, of the product of their probabilities; a forward pass computes it. The
probabilities are fitted by expectation maximisation on a sample of ``SAMPLE_DOCS`` labelled documents per language
(those of the smallest hash of their key). Every text is scored whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vakanta.llm.common import kept_in_worker, plain_text

SAMPLE_DOCS = 200
ROUNDS = 3
SMOOTHING = 0.05
PIECE_CHARS = 12
WORD_CHARS = 24
KEPT_PIECES = 500_000
START = "▁"
UNKNOWN = "und"


def fold(key: Column, folds: int = 5) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def word_parts(text: str) -> list[str]:
    """Runs of letters in lower case, long ones cut after ``WORD_CHARS``."""
    bare = text.lower().rstrip(".,")
    if len(bare) <= WORD_CHARS and bare.isalpha():  # most runs without white space are one word
        return [bare]
    out = []
    for run in re.findall(r"[^\W\d_]+", text.lower()):
        run = "".join(c for c in run if c.isalpha())
        out += [run[i : i + WORD_CHARS] for i in range(0, len(run), WORD_CHARS)]
    return out


def vocabulary_pieces(file: str) -> dict[str, int]:
    """Number of each piece of a sentencepiece model that can occur in a word, by the order of the file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=file)
    names = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    fit = [p for p in names if len(p) <= PIECE_CHARS and p.removeprefix(START).isalpha() and p == p.lower()]
    return {p: i for i, p in enumerate(dict.fromkeys([START, *fit]))}


def fit_pieces(words: dict[str, int], pieces: dict[str, int], rounds: int = ROUNDS):
    """Probabilities of all pieces, and last that of a character outside the vocabulary, for words with their counts."""
    import numpy as np

    unknown = len(pieces)
    size = unknown + 1
    p = np.full(size, 1.0 / size)
    spans = {}
    for word in words:
        w = START + word
        spans[word] = [
            (i, j, pieces.get(w[i:j], unknown if j == i + 1 else -1))
            for j in range(1, len(w) + 1)
            for i in range(max(0, j - PIECE_CHARS), j)
            if j == i + 1 or w[i:j] in pieces
        ]
    for _ in range(rounds):
        expected, prob = [0.0] * size, p.tolist()
        for word, count in words.items():
            n = len(word) + 1
            ahead, behind = [1.0] + [0.0] * n, [0.0] * n + [1.0]
            for i, j, k in spans[word]:
                ahead[j] += ahead[i] * prob[k]
            for i, j, k in reversed(spans[word]):
                behind[i] += prob[k] * behind[j]
            weight = count / ahead[n]
            for i, j, k in spans[word]:
                expected[k] += weight * ahead[i] * prob[k] * behind[j]
        p = np.array(expected) + SMOOTHING
        p /= p.sum()
    return p


def train(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = SAMPLE_DOCS):
    """(languages in order of name, matrix of piece probabilities per language) from labelled rows.

    Rows without text or label are not used. A language may have less than ``per_language`` documents; none at all gives
    an empty model. The driver receives one row per language, as long as the vocabulary.
    """
    import numpy as np

    used = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("key"), "key"))
    narrow = used.select(F.col(lang).cast("string").alias("lang"), F.col(key).cast("string").alias("key"))
    chosen = narrow.withColumn("rank", rank).filter(F.col("rank") <= per_language).select("lang", "key").distinct()
    texts = used.select(F.col(lang).cast("string").alias("lang"), F.col(key).cast("string").alias("key"), plain_text(text).alias("text"))
    same = (texts["lang"] == F.col("c.lang")) & texts["key"].eqNullSafe(F.col("c.key"))
    # at most ``per_language`` keys for each language: small enough to send to every task, so that no text moves
    sample = texts.join(F.broadcast(chosen).alias("c"), same, "left_semi").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Counter()
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.update((name, w) for w in word_parts(t))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())],
                ["lang", "word", "n"],
            )

    words = sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("word")
        p = fit_pieces(dict(zip(part["word"], part["n"].tolist(), strict=True)), vocabulary_pieces(vocabulary))
        return pd.DataFrame({"lang": [part["lang"].iloc[0]], "p": [p.astype("<f8").tobytes()]})

    rows = sorted(words.groupBy("lang").applyInPandas(fit, "lang string, p binary").collect(), key=lambda r: r["lang"])
    return [r["lang"] for r in rows], np.array([np.frombuffer(r["p"], dtype="<f8") for r in rows])


class PieceTable:
    """Numbers of pieces for many substrings at once, by a 64-bit rolling hash in a table of two places per slot.

    Hashes of the vocabulary are distinct; another string is taken for a piece once in about 10^14 look-ups.
    """

    BASE = 0x9E3779B97F4A7C15
    SLOT_BITS = 20

    def __init__(self, pieces: dict[str, int]):
        import numpy as np

        self.none = len(pieces) + 1
        hashes = np.zeros(len(pieces) + 2, dtype=np.uint64)
        for piece, number in pieces.items():
            h = 0
            for c in piece:
                h = (h * self.BASE + ord(c) + 1) % 2**64
            hashes[number] = h
        if len(set(hashes[:-2].tolist())) != len(pieces):
            raise ValueError("two pieces have one hash")
        self.hashes = hashes
        for odd in range(1, 2**12, 2):  # a multiplier that leaves no slot with three pieces
            self.spread = np.uint64((0xD1342543DE82EF95 * odd) % 2**64)
            slots = self._slots(hashes[:-2])
            order = np.argsort(slots, kind="stable")
            _, first, count = np.unique(slots[order], return_index=True, return_counts=True)
            if count.max(initial=0) <= 2:
                break
        else:
            raise ValueError("too many pieces")
        self.one, self.two = (np.full(1 << self.SLOT_BITS, self.none, dtype=np.int32) for _ in range(2))
        self.one[slots[order[first]]] = order[first]
        pairs = first[count == 2] + 1
        self.two[slots[order[pairs]]] = order[pairs]

    def _slots(self, hashes):
        import numpy as np

        with np.errstate(over="ignore"):
            return (((hashes ^ (hashes >> np.uint64(29))) * self.spread) >> np.uint64(64 - self.SLOT_BITS)).astype(np.int64)

    def extended(self, hashes, codes):
        """Hashes of strings that are one character longer."""
        import numpy as np

        with np.errstate(over="ignore"):
            return hashes * np.uint64(self.BASE) + codes + np.uint64(1)

    def numbers(self, hashes):
        """Numbers of the pieces with these hashes; ``none`` for others. The hash of nothing is never asked for."""
        import numpy as np

        slots = self._slots(hashes)
        one, two = self.one[slots], self.two[slots]
        return np.where(self.hashes[one] == hashes, one, np.where(self.hashes[two] == hashes, two, self.none))


class Scorer:
    """Scores texts under a model; keeps what it has computed for runs without white space, up to ``KEPT_PIECES``."""

    def __init__(self, languages: list[str], probabilities, pieces: dict[str, int]):
        import numpy as np

        self.languages, self.pieces = languages, pieces
        self.unknown = len(pieces)
        self.lookup = PieceTable(pieces)
        # one row per piece, one for characters that are none, a last one of zeros for what is no piece
        self.p = np.vstack([probabilities.T, np.zeros((1, len(languages)))]) if languages else np.zeros((len(pieces) + 2, 0))
        self.forget()

    def forget(self) -> None:
        import numpy as np

        self.place: dict[str, int] = {}  # row of each piece
        self.row: dict[str, int] = {}  # row of each word
        self.mixed = 0
        self.table = np.zeros((1 << 16, len(self.languages) + 1))

    def words(self, words: list[str]):
        """Natural logarithms of the words' probabilities, a row per word and a column per language.

        Words stand in order of falling length, so those that reach a position are the first rows.
        """
        import numpy as np

        if not words:
            return np.zeros((0, len(self.languages)))
        order = sorted(range(len(words)), key=lambda at: -len(words[at]))
        sizes = np.array([len(words[at]) + 1 for at in order])
        width = int(sizes[0])
        joined = "".join((START + words[at]).ljust(width, "\0") for at in order)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(words), width).astype(np.uint64)
        ahead = [np.ones((len(words), len(self.languages)))]
        hashes: list = []
        for j in range(1, width + 1):
            n = int(np.searchsorted(-sizes, -j, side="right"))
            column = codes[:n, j - 1]
            hashes.append(np.zeros(n, dtype=np.uint64))
            total = np.zeros((n, len(self.languages)))
            for i in range(max(0, j - PIECE_CHARS), j):
                hashes[i] = self.lookup.extended(hashes[i][:n], column)
                ids = self.lookup.numbers(hashes[i])
                if j == i + 1:
                    ids = np.where(ids == self.lookup.none, self.unknown, ids)
                    total += ahead[i][:n] * self.p[ids]
                else:
                    some = np.flatnonzero(ids != self.lookup.none)
                    total[some] += ahead[i][some] * self.p[ids[some]]
            ahead.append(total)
        out = np.zeros((len(words), len(self.languages)))
        for size in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == size)
            out[np.array(order)[rows]] = np.log(ahead[size][rows])
        return out

    def learn(self, pieces: list[str]) -> None:
        """Keep a row for each piece: the sums over its words, and last the number of its letters.

        Pieces of one word share that word's row, so each word is scored once.
        """
        import numpy as np

        if len(self.place) + len(pieces) > KEPT_PIECES:
            self.forget()
        parts = [word_parts(p) for p in pieces]
        words = [w for w in dict.fromkeys(w for ws in parts for w in ws) if w not in self.row]
        mixed = [(p, ws) for p, ws in zip(pieces, parts, strict=True) if len(ws) != 1]
        start, needed = len(self.row) + self.mixed, len(words) + len(mixed)
        while start + needed > len(self.table):
            self.table = np.vstack([self.table, np.zeros_like(self.table)])
        self.table[start : start + len(words), :-1] = self.words(words)
        self.table[start : start + len(words), -1] = [len(w) for w in words]
        self.row.update(zip(words, range(start, start + len(words)), strict=True))
        for piece, ws in zip(pieces, parts, strict=True):
            if len(ws) == 1:
                self.place[piece] = self.row[ws[0]]
        for at, (piece, ws) in enumerate(mixed, start + len(words)):
            self.place[piece] = at
            self.table[at] = self.table[[self.row[w] for w in ws]].sum(axis=0) if ws else 0.0
        self.mixed += len(mixed)

    def texts(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, its probability among the languages) of each text; ``und`` and 0 without letters or model."""
        import numpy as np

        split = [t.lower().split() for t in texts]
        new = {p for pieces in split for p in pieces if p not in self.place}
        if new:
            forgets = len(self.place) + len(new) > KEPT_PIECES
            self.learn(sorted({p for pieces in split for p in pieces} if forgets else new))
        out = []
        for pieces in split:
            sums = self.table[[self.place[p] for p in pieces]].sum(axis=0) if pieces else self.table[:0].sum(axis=0)
            if not self.languages or sums[-1] == 0:
                out.append((UNKNOWN, 0.0))
                continue
            best = int(np.argmax(sums[:-1]))
            out.append((self.languages[best], float(1 / np.exp(sums[:-1] - sums[best]).sum())))
        return out


def identify(docs: DataFrame, model, vocabulary: str, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """All rows and columns, with the predicted language and its probability in two columns more.

    Null, empty and letterless texts give ``und`` and 0; equal probabilities go to the first name. The names of the two
    columns must not be taken. Each text is scored whole where it is read; nothing is shuffled.
    """
    taken = {pred, score} & set(docs.columns)
    if taken:
        raise ValueError(f"columns already there: {sorted(taken)}")
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)  # languages x vocabulary
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, p = held.value
        version = f"{hash((tuple(languages), p.tobytes()))}"
        scorer = kept_in_worker("language", version, lambda: Scorer(languages, p, vocabulary_pieces(vocabulary)))
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                found = scorer.texts([t.as_py() or "" for t in part.column(at)])
                columns = [*part.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, pred, score])

    return docs.mapInArrow(run, schema)


def predict_held_out(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, held_out, lang_pred, score): a model from the rows outside fold 0, applied to all rows."""
    model = train(docs.filter(fold(F.col(key)) != 0), vocabulary, key, text, lang)
    narrow = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text))
    found = identify(narrow, model, vocabulary, text)
    return found.select(key, (fold(F.col(key)) == 0).alias("held_out"), "lang_pred", "score")
