"""Token ids as binary files with a minimal perfect hash index from document keys to their place.

Shard ``n`` is two files in the shared folder. ``<n>.bin`` is the raw payload: ids of its documents in ascending order of
keys, as little-endian unsigned integers of 2 bytes (4 for vocabularies over 65 536). ``<n>.idx`` is the index::

    8 bytes   b"VKTOKID1"
    6 x u64   bytes per id, documents, ids, levels, words of bits, seed
    u64 ...   bits of each level (a multiple of 64)
    u64 ...   bit words of all levels, in order
    u32 ...   stored fingerprint per slot
    u64 ...   first id per slot, in ids
    u64 ...   number of ids per slot

The hash is a cascade of bit arrays: a key sits at the first level where no other key of the level has its position, and
its slot is the number of bits set before. A look-up reads a few bits, one fingerprint and one offset whatever the size
of the shard; a key that is not there is told by its fingerprint, but for one in 2^32.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vakanta.llm.common import checkpointed, file_system, fresh_path, kept_in_worker, plain_text, publish, sort_key

MAGIC = b"VKTOKID1"
GAMMA = 2
KEPT_PIECES = 800_000
SHARD_BYTES = 128 << 20
LEAST_BYTES = 8 << 20


# --- the perfect hash ---------------------------------------------------------------------------------------------


def mixed(keys, seed: int):
    """64-bit hashes of unsigned 64-bit keys (the finaliser of SplitMix64)."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def key_words(keys, repeats):
    """One unsigned 64-bit word per (key, number of its repeat)."""
    import numpy as np

    return mixed(np.asarray(keys, dtype=np.int64).view(np.uint64), 101) ^ mixed(np.asarray(repeats, dtype=np.uint64), 202)


class PerfectHash:
    def __init__(self, levels: list, seed: int):
        import numpy as np

        self.levels, self.seed = levels, seed
        words = np.concatenate(levels) if levels else np.zeros(0, dtype=np.uint64)
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])
        self.starts = np.cumsum([0, *(len(x) for x in levels)])

    @classmethod
    def build(cls, words, seed: int = 0) -> PerfectHash:
        """Levels until every key has a bit of its own; words must be distinct."""
        import numpy as np

        left, levels = words, []
        while len(left):
            bits = -(-max(64, GAMMA * len(left)) // 64) * 64
            at = (mixed(left, seed + len(levels)) % np.uint64(bits)).astype(np.int64)
            alone = np.bincount(at, minlength=bits) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at]]
        return cls(levels, seed)

    def slots(self, words):
        """Slot of each key; -1 where no level has its bit."""
        import numpy as np

        out, open_ = np.full(len(words), -1, dtype=np.int64), np.arange(len(words))
        for level, held in enumerate(self.levels):
            if not len(open_):
                break
            at = (mixed(words[open_], self.seed + level) % np.uint64(64 * len(held))).astype(np.int64)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (held[word] >> bit) & np.uint64(1) == 1
            rank = self.before[self.starts[level] + word] + np.bitwise_count(
                held[word] & ((np.uint64(1) << bit) - np.uint64(1))
            ).astype(np.int64)
            out[open_[hit]] = rank[hit]
            open_ = open_[~hit]
        return out


def fingerprint(words):
    import numpy as np

    return (mixed(words, 303) >> np.uint64(32)).astype(np.uint32)


# --- files --------------------------------------------------------------------------------------------------------


def _read(folder: str, name: str) -> bytes:
    files, root = file_system(folder)
    with files.open_input_file(f"{root}/{name}") as f:
        return f.read()


def index_bytes(keys, repeats, sizes, id_bytes: int) -> bytes:
    """The index file for documents in the order of the payload."""
    import numpy as np

    words = key_words(keys, repeats)
    table = PerfectHash.build(words)
    slots = table.slots(words)
    sizes = np.asarray(sizes, dtype=np.uint64)
    prints, first, counts = (np.zeros(len(words), dtype=t) for t in ("<u4", "<u8", "<u8"))
    prints[slots], counts[slots] = fingerprint(words), sizes
    first[slots] = np.cumsum(sizes, dtype=np.uint64) - sizes
    head = struct.pack("<6Q", id_bytes, len(words), int(sizes.sum()), len(table.levels), len(table.words), table.seed)
    levels = np.array([64 * len(x) for x in table.levels], dtype="<u8")
    return b"".join([MAGIC, head, *(x.tobytes() for x in (levels, table.words.astype("<u8"), prints, first, counts))])


def ids_of(folder: str, number: int) -> int:
    """Number of ids of a shard, from the head of its index."""
    files, root = file_system(folder)
    with files.open_input_file(f"{root}/{number}.idx") as f:
        return struct.unpack_from("<6Q", f.read(56), 8)[2]


def shard_count(docs: DataFrame, text: str) -> int:
    """A shard for each ``SHARD_BYTES`` of text; more, of ``LEAST_BYTES`` at least, while there are idle cores."""
    size = docs.agg(F.sum(F.octet_length(plain_text(text)).cast("long")).alias("b")).first()["b"] or 0
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-size // SHARD_BYTES), min(-(-size // LEAST_BYTES), 4 * cores))


class Shard:
    """Keyed access to one shard's files."""

    def __init__(self, folder: str, number: int):
        import numpy as np

        raw = _read(folder, f"{number}.idx")
        if raw[:8] != MAGIC:
            raise ValueError(f"{folder}/{number}.idx is no index of token files")
        self.id_bytes, n, self.n_ids, levels, words, seed = struct.unpack_from("<6Q", raw, 8)
        at = 56
        parts = []
        for count, kind in ((levels, "<u8"), (words, "<u8"), (n, "<u4"), (n, "<u8"), (n, "<u8")):
            parts.append(np.frombuffer(raw, dtype=kind, count=count, offset=at))
            at += parts[-1].nbytes
        self.prints, self.first, self.counts = parts[2:]
        cuts = np.cumsum(parts[0] // 64)[:-1].astype(np.int64)
        self.table = PerfectHash(np.split(parts[1], cuts) if levels else [], seed)
        files, root = file_system(folder)
        self.payload = files.open_input_file(f"{root}/{number}.bin")

    def find(self, keys, repeats):
        """(first id, number of ids) per key; -1 and 0 for keys that are not there."""
        import numpy as np

        words = key_words(keys, repeats)
        slots = self.table.slots(words)
        there = slots >= 0
        there[there] = self.prints[slots[there]] == fingerprint(words[there])
        first, counts = np.full(len(words), -1, dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        first[there], counts[there] = self.first[slots[there]], self.counts[slots[there]]
        return first, counts

    def ids(self, first: int, count: int):
        """Ids as little-endian unsigned 32-bit integers."""
        import numpy as np

        self.payload.seek(int(first) * self.id_bytes)
        raw = self.payload.read(int(count) * self.id_bytes)
        return np.frombuffer(raw, dtype=f"<u{self.id_bytes}").astype("<u4")


# --- encoding -----------------------------------------------------------------------------------------------------


class PieceEncoder:
    """The tokenizers library on whole texts, asked only for pieces that this worker has not met.

    A text is cut before each blank. A piece that neither starts nor ends with white space after its own blank is
    encoded alike alone and in any text, as white space runs decide cuts only up to the next visible character. Texts with
    other pieces are encoded whole.
    """

    def __init__(self, file: str):
        import os

        import numpy as np

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        self.library.no_padding()
        self.library.no_truncation()
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        # bytes that each id stands for: one per character of its string, more for added tokens
        self.width = np.zeros(size, dtype=np.int64)
        added = {i: t.content for i, t in self.library.get_added_tokens_decoder().items()}
        for string, i in self.library.get_vocab(with_added_tokens=True).items():
            self.width[i] = len(added[i].encode()) if i in added else len(string)
        self.kept: dict[str, bytes | None] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.kind).tobytes() for e in found]

    def learn(self, pieces: list[str]) -> None:
        """Keep the ids of pieces, each with a blank before it; None for those that depend on what stands around."""
        import numpy as np

        if len(self.kept) + len(pieces) > KEPT_PIECES:
            self.kept.clear()
        plain = []
        for p in pieces:
            if not p or p[0].isspace() or p[-1].isspace() or len(p) > 256:
                self.kept[p] = None
            else:
                plain.append(p)
        for i in range(0, len(plain), 64):
            part = plain[i : i + 64]
            ids = np.array(self.library.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, dtype=self.kind)
            ends = np.cumsum([len(p.encode()) + 1 for p in part])
            bytes_so_far = np.cumsum(self.width[ids])
            cuts = np.searchsorted(bytes_so_far, ends)
            if len(bytes_so_far) == 0 or not np.array_equal(bytes_so_far[np.minimum(cuts, len(ids) - 1)], ends):
                for p, found in zip(part, self.whole([" " + p for p in part]), strict=True):
                    self.kept[p] = found
                continue
            start = 0
            for p, cut in zip(part, cuts.tolist(), strict=True):
                self.kept[p] = ids[start : cut + 1].tobytes()
                start = cut + 1

    def _joined(self, pieces: list[str]) -> bytes | None:
        """Ids of all pieces but the first; None if one depends on its surroundings. KeyError for one not known."""
        try:
            return b"".join(map(self.kept.__getitem__, islice(pieces, 1, None)))
        except TypeError:
            return None

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [t.split(" ") for t in texts]
        out: list[bytes | None] = []
        late = []
        for i, pieces in enumerate(split):  # most texts have known pieces alone: one look-up each
            try:
                out.append(self._joined(pieces))
            except KeyError:
                out.append(None)
                late.append(i)
        if late:
            kept = self.kept
            self.learn(sorted({p for i in late for p in islice(split[i], 1, None) if p not in kept}))
            for i in late:
                try:
                    out[i] = self._joined(split[i])
                except KeyError:  # forgotten meanwhile
                    out[i] = None
        firsts = self.whole([p[0] for p in split])
        rest = self.whole([t for t, o, p in zip(texts, out, split, strict=True) if not self._simple(o, p)])
        rest.reverse()
        return [f + o if self._simple(o, p) else rest.pop() for f, o, p in zip(firsts, out, split, strict=True)]

    @staticmethod
    def _simple(joined: bytes | None, pieces: list[str]) -> bool:
        """A first piece may start with white space, not end with it."""
        return joined is not None and (len(pieces) == 1 or (pieces[0] == "" or not pieces[0][-1].isspace()))


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, is_null, text) with the order of shards: key, then the text's checksum."""
    return docs.select(
        sort_key(key).alias("key"), F.col(key).isNull().alias("absent"), plain_text(text).alias("text")
    ).withColumn("crc", F.crc32(F.col("text").cast("binary")))


def write_token_files(
    docs: DataFrame, vocabulary: str, folder: str, end_id: int = 0, key: str = "doc_id", text: str = "text", shards: int | None = None
) -> DataFrame:
    """Encode, append ``end_id`` to every document and write all shards; returns (shard, key, absent, repeat), a row per document.

    There are ``shards`` of them, by default after the bytes of text. ``folder`` must be new: one that exists raises an error.
    Shards are ranges of keys of about equal numbers of rows, so payloads read in order of shard numbers hold all
    documents in ascending order of keys. Null texts are empty, null keys come first (``absent``), rows that repeat a
    key are told apart by ``repeat`` (0, 1, ... in order of their texts' checksums) and may lie in several
    shards, where the numbers start anew. Other columns are ignored; an empty table writes nothing. A task that runs
    again writes the same bytes under the same names.
    """
    spark = docs.sparkSession
    spark.createDataFrame([(0,)], "x int").write.parquet(f"{folder}/.made")  # makes the folder wherever it lies
    count = shards or shard_count(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        coder = kept_in_worker("pieces", vocabulary, lambda: PieceEncoder(vocabulary))
        number = TaskContext.get().partitionId()
        end = np.array([end_id], dtype=coder.kind).tobytes()
        keys, absent, sizes = [], [], []  # arrays, one of each per slice

        def payload():
            for batch in batches:
                for start in range(0, batch.num_rows, 256):
                    part = batch.slice(start, 256)
                    found = coder.encode(part.column(2).to_pylist())
                    keys.append(part.column(0).to_numpy(zero_copy_only=False))
                    absent.append(part.column(1).to_numpy(zero_copy_only=False).astype(np.int64))
                    sizes.append(np.array([len(f) // coder.kind.itemsize + 1 for f in found], dtype=np.int64))
                    yield b"".join([x for f in found for x in (f, end)])

        first = next(chunks := payload(), None)
        if first is None:
            return

        def rest():
            yield first
            yield from chunks

        publish(folder, f"{number}.bin", rest())
        key, null = np.concatenate(keys), np.concatenate(absent)
        # rows that repeat a key lie side by side: each is numbered from the first of its run
        opens = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (null[1:] != null[:-1])]))
        runs = np.repeat(opens, np.diff(np.append(opens, len(key))))
        # a null key has the smallest number as its key; the number itself, if used, is told apart by its repeats
        repeats = 2 * (np.arange(len(key)) - runs) + null
        publish(folder, f"{number}.idx", [index_bytes(key, repeats, np.concatenate(sizes), coder.kind.itemsize)])
        for start in range(0, len(key), 10_000):
            cut = slice(start, start + 10_000)
            columns = [pa.array(np.full(len(key[cut]), number), pa.int32()), pa.array(key[cut]), pa.array(null[cut] == 1), pa.array(repeats[cut])]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "key", "absent", "repeat"])

    ranged = _keyed(docs, key, text).repartitionByRange(count, "key", F.desc("absent"), "crc")
    dealt = ranged.sortWithinPartitions("key", F.desc("absent"), "crc").select("key", "absent", "text")
    return checkpointed(dealt.mapInArrow(run, "shard int, key long, absent boolean, repeat long"))


def read_token_files(written: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32, ids) of the keys asked for, as (shard, key, absent, repeat) rows.

    ``start`` is the number of ids of all documents before; it is -1, with no ids, for a key the shard does not hold.
    """

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([ids_of(folder, n) for n in numbers], pa.int64())], ["shard", "n_ids"]
            )

    # a row per shard: as many as the files, read by one task to number them
    sums = written.select("shard").distinct().mapInArrow(totals, "shard int, n_ids long")
    bases = sums.select("shard", (F.sum("n_ids").over(Window.orderBy("shard")) - F.col("n_ids")).alias("base"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held: tuple[int, Shard] | None = None
        for batch in batches:
            numbers = batch.column(0).to_numpy(zero_copy_only=False)
            for number in np.unique(numbers).tolist():
                if held is None or held[0] != number:
                    held = (number, Shard(folder, number))
                rows = np.flatnonzero(numbers == number)
                keys = batch.column(1).to_numpy(zero_copy_only=False)[rows]
                repeats = batch.column(3).to_numpy(zero_copy_only=False)[rows]
                base = batch.column(4).to_numpy(zero_copy_only=False)[rows]
                first, counts = held[1].find(keys, repeats)
                for s in range(0, len(rows), 64):
                    cut = slice(s, s + 64)
                    ids = [held[1].ids(f, c).tobytes() if c else b"" for f, c in zip(first[cut], counts[cut], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(keys[cut], pa.int64(), mask=batch.column(2).to_numpy(zero_copy_only=False)[rows][cut].astype(bool)),
                            pa.array(np.where(first[cut] < 0, -1, first[cut] + base[cut]), pa.int64()),
                            pa.array(counts[cut], pa.int64()),
                            pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                            pa.array(ids, pa.binary()),
                        ],
                        ["key", "start", "n_tokens", "ids_crc32", "ids"],
                    )

    asked = written.join(F.broadcast(bases), "shard").select("shard", "key", "absent", "repeat", "base")
    found = asked.mapInArrow(look, "key long, start long, n_tokens long, ids_crc32 long, ids binary")
    return found.withColumnRenamed("key", key)


def token_files(docs: DataFrame, vocabulary: str, end_id: int = 0, key: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """Write ``docs`` as token files (into a new folder under the shared one, if none is named) and read every document back."""
    folder = folder or fresh_path(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, vocabulary, folder, end_id, key, text), folder, key)

