"""Collocations: frequent phrases of two and three words, scored by how far their words belong together.

Candidates are Apriori-safe. A first pass counts words and word pairs into hash cells, a second names the pairs whose cell and
words may be frequent and counts the triples of such pairs into cells, a third names the triples. No frequent phrase is lost:
a cell's count is never below that of a phrase in it. Rows are named in parts of growing size, and later parts leave out
what earlier ones have named, so that a phrase found everywhere is not named anew by every task. Candidates and their words are dealt to shards of bounded size, each
a double-array trie that every worker reads from the shared folder. Phrases are dealt by their first two words, so that a text position
can begin phrases of one trie only. One last pass turns texts into numbers of words, a block at a time; the tries are read one after
the other, numpy moves the states of the positions that belong to each through it, a level at a time, and counts accepting
states; counts are summed over tasks and blocks. So texts are read once and positions walk once, however many tries there are.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vakanta.llm.common import file_system, forget_kept, fresh_path, plain_text, publish, slices, stored

LEAST_COUNT = 10
TOP = 2000
SHARD_PHRASES = 1 << 18
HELD_TOKENS = 1 << 22
CELL_BITS = (16, 32)
FULL_BITS = 27
CELL_CHUNK = 1 << 16
MERGE_HASHES = 1 << 20
MOST_HASHES = 1 << 21  # held by a task at once
PARTS = (1, 4, 16)  # where the parts of the rows end, in sixteenths
TASK_BYTES = 16 << 20
KNOWN_HASHES = 1 << 21  # of phrases named in earlier parts: 16 MB
CHUNK_BYTES = 1 << 20
CHUNK_ROWS = 2048
KEPT_WORDS = 400_000
KEPT_PHRASES = 2_000_000
MARK = b"."
# A-Z in lower case; every character that ends a piece becomes the mark
FOLD = bytes.maketrans(bytes(range(65, 91)) + b",;:!?\n\x0b\x0c\r", bytes(range(97, 123)) + MARK * 9)


# --- texts as numbers -----------------------------------------------------------------------------------------------


class Words(dict):
    """Numbers of words as they come; 0 is the mark between pieces."""

    def __init__(self):
        import numpy as np

        super().__init__({MARK: 0})
        self.hashes = np.zeros(1, dtype=np.uint64)
        self.listed = [MARK]

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.listed.append(word)
        return number

    def hashed(self):
        """A 64-bit hash of each word so far."""
        import numpy as np
        from xxhash import xxh3_64_intdigest

        new = np.fromiter(map(xxh3_64_intdigest, self.listed[len(self.hashes) :]), dtype=np.uint64)
        self.hashes = np.concatenate([self.hashes, new])
        return self.hashes


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """(language, tokens with marks between pieces) of the (lang, text) rows, cut between pieces at about ``CHUNK_BYTES``."""
    for batch in slices(batches, CHUNK_ROWS):
        by_lang: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            by_lang.setdefault(lang, []).append(text)
        for lang, texts in by_lang.items():
            held, size = [], 0
            for text in [*texts, None]:
                if text is not None:
                    folded = text.translate(FOLD)
                    start = 0
                    while len(folded) - start > CHUNK_BYTES and (cut := folded.find(MARK, start + CHUNK_BYTES)) >= 0:
                        yield lang, folded[start:cut].replace(MARK, b" . ").split()
                        start = cut + 1
                    held.append(folded[start:])
                    size += len(held[-1])
                if size > CHUNK_BYTES or text is None:
                    yield lang, MARK.join(held).replace(MARK, b" . ").split()
                    held, size = [], 0


def _mixed(x):
    import numpy as np

    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _seed(lang: str):
    import numpy as np
    from xxhash import xxh3_64_intdigest

    return np.uint64(xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"), seed=1))


def _paired(one, other):
    import numpy as np

    with np.errstate(over="ignore"):
        return _mixed(one * np.uint64(3) + other)


def _hashes(lang: str, numbers, words: Words):
    """Hashes of the words, pairs and triples that begin at each position, and whether there is one within a piece.

    The language has a seed of its own, so that the word ``und`` of ``de`` and the word ``de`` of ``und`` differ.
    """
    import numpy as np

    one = _mixed(words.hashed()[numbers] ^ _seed(lang))
    there = [numbers > 0]
    two = _paired(one[:-1], one[1:])
    with np.errstate(over="ignore"):
        three = _mixed(two[:-1] * np.uint64(5) + one[2:])
    there.append(there[0][:-1] & there[0][1:])
    there.append(there[1][:-1] & there[0][2:])
    return [one, two, three], there


class Seen:
    """Hashes met before, in sorted runs that are merged as they grow."""

    def __init__(self):
        self.runs: list = []

    def add(self, hashes):
        """Which of the distinct ascending ``hashes`` are new; they are held from then on. Forgets all beyond ``KEPT_PHRASES``."""
        import numpy as np

        new = np.ones(len(hashes), dtype=bool)
        for run in self.runs:
            at = np.minimum(np.searchsorted(run, hashes), len(run) - 1)
            new &= run[at] != hashes
        if new.any():
            self.runs.append(hashes[new])
        while len(self.runs) > 1 and len(self.runs[-2]) < 2 * len(self.runs[-1]):
            self.runs[-2:] = [np.sort(np.concatenate(self.runs[-2:]), kind="stable")]
        if sum(map(len, self.runs)) > KEPT_PHRASES:
            self.runs = []
        return new


# --- cells ----------------------------------------------------------------------------------------------------------


def _places(hashes, bits: int):
    """The two cells of each hash, one in either half of a table."""
    import numpy as np

    mask = np.uint64((1 << bits) - 1)
    return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(32)) & mask).astype(np.int64) + (1 << bits)


def _gaps(at) -> bytes:
    """Ascending places below 2^16: a byte for the gap to the one before, after a byte of 255 for each 255 of it; the places themselves, if
    that is shorter. The first byte tells which."""
    import numpy as np

    gaps = np.diff(at.astype(np.int64), prepend=0)
    more = gaps // 255 + 1
    if more.sum() > 2 * len(at):
        return b"\0" + at.astype("<u2").tobytes()
    out = np.full(more.sum(), 255, dtype=np.uint8)
    out[np.cumsum(more) - 1] = gaps % 255
    return b"\1" + out.tobytes()


def _from_gaps(raw: bytes):
    """The places that ``_gaps`` has packed."""
    import numpy as np

    if raw[0] == 0:
        return np.frombuffer(raw, dtype="<u2", offset=1).astype(np.int64)
    steps = np.frombuffer(raw, dtype=np.uint8, offset=1)
    return np.cumsum(steps, dtype=np.int64)[steps < 255]


def _summed(keys, counts, cap: int):
    """Distinct ascending keys and the sums of their counts, held at ``cap``."""
    import numpy as np

    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.minimum(np.add.reduceat(counts[order].astype(np.int64), starts), cap).astype(np.uint8)


class Cells:
    """Counts by hash, held at ``cap``; a phrase is counted in two cells, and as often as the lesser one says at most.

    Only hashes met are held, so that memory follows the texts and not the number of cells.
    """

    def __init__(self, bits: int, cap: int):
        self.bits, self.cap = bits, cap
        self.clear()

    def clear(self) -> None:
        self.parts: list = []
        self.held = self.merged = 0

    def add(self, hashes, counts) -> None:
        """Distinct hashes and how often each was met."""
        import numpy as np

        self.parts.append((hashes, np.minimum(counts, self.cap).astype(np.uint8)))
        self.held += len(hashes)
        if self.held > 2 * self.merged + MERGE_HASHES:
            self._merge()

    def _merge(self) -> None:
        import numpy as np

        if self.parts:
            self.parts = [_summed(*(np.concatenate(x) for x in zip(*self.parts, strict=True)), self.cap)]
            self.held = self.merged = len(self.parts[0][0])

    def packed(self, level: int) -> Iterator[tuple[int, int, bytes, bytes]]:
        """(level, chunk, positions, counts) of the cells that are not empty; forgets them."""
        import numpy as np

        self._merge()
        if self.held:
            for places in _places(self.parts[0][0], self.bits):  # one half of the table after the other
                at, counts = _summed(places, self.parts[0][1], self.cap)
                starts = np.flatnonzero(np.concatenate([[True], at[1:] // CELL_CHUNK != at[:-1] // CELL_CHUNK]))
                for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(at)], strict=True):
                    part = at[start:end]
                    yield level, int(part[0]) // CELL_CHUNK, (part % CELL_CHUNK).astype("<u2").tobytes(), counts[start:end].tobytes()
        self.clear()

    def batches(self, level: int, least: int = 0) -> Iterator[pa.RecordBatch]:
        """The packed cells as batches, if more than ``least`` hashes are held."""
        if self.merged > least or not least:
            import numpy as np

            packed = self.packed(level)
            rows = ((level, chunk, _gaps(np.frombuffer(at, dtype="<u2")), counts, None, None) for level, chunk, at, counts in packed)
            while some := list(islice(rows, 64)):
                yield _packed_batch(some)


PACKED = "level int, chunk int, at binary, counts binary, lang string, phrase string"


def _packed_batch(rows) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.string()]
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in PACKED.split(", ")])


def _full_cells(packed: DataFrame, bits: int, least: int) -> dict[int, bytes]:
    """Per level a bit for each cell that reaches ``least`` in all. A task adds up its chunks one after the other.

    Of more than ``2^FULL_BITS`` cells in a half of the table those alike in the last ``FULL_BITS`` bits share a bit, which says that one of them is full.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        now, total, full = None, None, None

        def add():
            return full | (total >= least)

        def result():
            bitmap = np.packbits(add(), bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([bitmap])], ["level", "place", "bits"])

        for batch in batches:
            for level, place, chunk, at, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (level, place, chunk):
                    if now is not None and now[:2] == (level, place):
                        full = add()
                    else:
                        if now is not None:
                            yield result()
                        full = np.zeros(min(CELL_CHUNK, 2 << bits), dtype=bool)
                    now, total = (level, place, chunk), np.zeros(len(full), dtype=np.int64)
                total[_from_gaps(at)] += np.frombuffer(counts, dtype=np.uint8)
        if now is not None:
            yield result()

    held = min(bits, FULL_BITS)
    chunks_of = {b: max((1 << b) // CELL_CHUNK, 1) for b in (bits, held)}  # in a half of the table
    half, chunk = F.floor(F.col("chunk") / chunks_of[bits]), F.col("chunk") % chunks_of[held]
    place = (half * chunks_of[held] + chunk).cast("int").alias("place")
    rows = packed.filter("level > 0").select("level", place, "chunk", "at", "counts").repartition("level", "place").sortWithinPartitions("level", "place", "chunk")
    size = min(CELL_CHUNK, 2 << bits) // 8
    out: dict[int, bytearray] = {}
    for r in rows.mapInArrow(fold, "level int, place int, bits binary").collect():  # a bit per cell: 32 MB a level at most
        out.setdefault(r["level"], bytearray((2 << held) // 8))[r["place"] * size : (r["place"] + 1) * size] = r["bits"]
    return {level: bytes(b) for level, b in out.items()}


class Full:
    """Which hashes have both their cells full, or cells that share their bits."""

    def __init__(self, bits: int, bitmap: bytes | None):
        import numpy as np

        self.bits = min(bits, FULL_BITS)
        self.bitmap = np.frombuffer(bitmap or bytes((2 << self.bits) // 8), dtype=np.uint8)

    def holds(self, hashes):
        import numpy as np

        one, other = ((self.bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1 for at in _places(hashes, self.bits))
        return one & other


# --- the passes -----------------------------------------------------------------------------------------------------


def _first_pass(rows: DataFrame, bits: int, least: int) -> DataFrame:
    """Cells of words and pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        forget_kept()
        words, cells = Words(), [Cells(bits, least), Cells(bits, least)]
        for lang, tokens in chunks(batches):
            words = words if len(words) < KEPT_WORDS else Words()
            numbers = np.fromiter(map(words.__getitem__, tokens), dtype=np.int64, count=len(tokens))
            hashes, there = _hashes(lang, numbers, words)
            each, first, n = np.unique(numbers, return_index=True, return_counts=True)
            cells[0].add(hashes[0][first[each > 0]], n[each > 0])
            cells[1].add(*np.unique(hashes[1][there[1]], return_counts=True))
            for level in (0, 1):
                yield from cells[level].batches(level + 1, MOST_HASHES)
        for level in (0, 1):
            yield from cells[level].batches(level + 1)

    return rows.mapInArrow(run, PACKED)


def _hashes_named(named: list[DataFrame]) -> bytes:
    """Ascending hashes of the phrases of these tables, about ``KNOWN_HASHES`` of them at most."""
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(batch.column(0).to_pylist())])], ["hashes"])

    each = stored(reduce(DataFrame.union, named).filter("level = 0").select("at").distinct(), "named-hashes")
    held = each.filter(F.pmod(F.xxhash64("at"), F.lit(max(each.count(), 1))) < KNOWN_HASHES)
    found = b"".join(r["hashes"] for r in held.mapInArrow(run, "hashes binary").collect())
    return np.sort(np.frombuffer(found, dtype="<u8")).tobytes()


def _in_parts(rows: DataFrame, size: int, bits: int, least: int, width: int, full: dict[int, bytes]) -> DataFrame:
    """``_named`` of all rows, a part of them after the other; a part leaves out phrases that earlier ones have named.

    A row's part is told by its hash. Parts but the last have a task for each ``TASK_BYTES``. What is left out never changes the result.
    Full cells are sent once for all parts; what is sent is let go of as soon as it has been used.
    """
    context = rows.sparkSession.sparkContext
    cells = context.broadcast(full)
    part = F.pmod(F.xxhash64("lang", "text"), F.lit(PARTS[-1]))
    found, begin = [], 0
    for end in PARTS:
        some = rows.filter((part >= begin) & (part < end))
        if end < PARTS[-1]:
            some = some.coalesce(size * (end - begin) // PARTS[-1] // TASK_BYTES + 1)
        known = context.broadcast(_hashes_named(found) if found else b"")
        found.append(stored(_named(some, bits, least, width, cells, known), "phrase-pairs" if width == 2 else "phrase-triples"))
        known.destroy()
        begin = end
    cells.destroy()
    return reduce(DataFrame.union, found)


def _named(rows: DataFrame, bits: int, least: int, width: int, full: Broadcast, known: Broadcast) -> DataFrame:
    """The distinct phrases of ``width`` words all of whose parts, and themselves, lie in full cells (level 0, the hash as ``at``), but
    those of the ``known`` hashes; with pairs also the cells of the triples made of them (level 3)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        forget_kept()
        words, cells = Words(), Cells(bits, least) if width == 2 else None
        cells_full, before = [Full(bits, full.value.get(level)) for level in range(1, width + 1)], np.frombuffer(known.value, dtype="<u8")
        seen = Seen()
        for lang, tokens in chunks(batches):
            words = words if len(words) < KEPT_WORDS else Words()
            numbers = np.fromiter(map(words.__getitem__, tokens), dtype=np.int64, count=len(tokens))
            hashes, there = _hashes(lang, numbers, words)
            one = there[0] & cells_full[0].holds(hashes[0])
            two = there[1] & one[:-1] & one[1:]
            two &= cells_full[1].holds(hashes[1])
            three = there[2] & two[:-1] & two[1:]
            if width == 2:
                cells.add(*np.unique(hashes[2][three], return_counts=True))
                yield from cells.batches(3, MOST_HASHES)
                good = two
            else:
                good = three & cells_full[2].holds(hashes[2])
            found, first = np.unique(hashes[width - 1][good], return_index=True)
            new = seen.add(found)
            if len(before):
                new &= before[np.minimum(np.searchsorted(before, found), len(before) - 1)] != found
            at, own = np.flatnonzero(good)[first[new]].tolist(), found[new].astype("<u8")
            out = [b" ".join(tokens[i : i + width]).decode("utf-8", "surrogatepass") for i in at]
            for i in range(0, len(out), 10_000):
                yield _packed_batch([(0, 0, h.tobytes(), None, lang, phrase) for h, phrase in zip(own[i : i + 10_000], out[i : i + 10_000], strict=True)])
        if cells:
            yield from cells.batches(3)

    return rows.mapInArrow(run, PACKED)


# --- tries ----------------------------------------------------------------------------------------------------------


def _free_offset(check, own, chance):
    """An offset under which all of the ascending ``own`` lie on free places, or None after many guesses.

    Guesses are sieved by a few places first, so that many cost little.
    """
    for number in [32, 512] + [8192] * 8:
        guess = chance.integers(-own[0], len(check) - own[-1], number)
        done, width = 0, 8
        while len(guess) and done < len(own):
            guess = guess[(check[guess[:, None] + own[None, done : done + width]] == -1).all(axis=1)]
            done, width = done + width, 4 * width
        if len(guess):
            return int(guess[0])
    return None


class Trie:
    """A double array: from state ``s`` word ``w`` leads to ``base[s] + w``, if ``check`` there says ``s``."""

    def __init__(self, base, check, accepts, words: list[bytes] | pa.Array, roots: dict[str, int]):
        self.base, self.check, self.accepts, self.words, self.roots = base, check, accepts, words, roots

    @classmethod
    def build(cls, langs: list[str], phrases: list[str]) -> Trie:
        """The trie, which accepts each phrase with its place in the list; (language, phrase) must be distinct."""
        import numpy as np

        flat = " ".join(phrases).encode("utf-8", "surrogatepass").split(b" ")
        sizes = np.fromiter((p.count(" ") + 1 for p in phrases), dtype=np.int64, count=len(phrases))
        firsts = np.cumsum(sizes) - sizes
        words = sorted(set(flat))
        number = {w: i for i, w in enumerate(words)}
        numbers = np.fromiter(map(number.__getitem__, flat), dtype=np.int64, count=len(flat))
        del flat, number
        roots = {lang: i for i, lang in enumerate(sorted(set(langs)))}
        size = 2 * len(numbers) + len(words) + 1024
        base, check = np.zeros(size, dtype=np.int64), np.full(size, -1, dtype=np.int64)
        check[: len(roots)] = -2
        chance = np.random.default_rng(1)
        states = np.fromiter(map(roots.__getitem__, langs), dtype=np.int64, count=len(langs))
        for depth in range(int(sizes.max(initial=0))):
            rows = np.flatnonzero(sizes > depth)
            symbols = numbers[firsts[rows] + depth]
            pairs, back = np.unique(states[rows] * len(words) + symbols, return_inverse=True)
            parents, children = pairs // len(words), pairs % len(words)
            starts = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]]))
            ends = np.append(starts[1:], len(parents))
            for g in np.argsort(starts - ends, kind="stable").tolist():  # most children first
                own = children[starts[g] : ends[g]]
                if len(own) == 1:
                    break
                while (at := _free_offset(check, own, chance)) is None:
                    more = int(own[-1] - own[0]) + 1  # where they fit for certain
                    base = np.append(base, np.zeros(more, dtype=np.int64))
                    check = np.append(check, np.full(more, -1, dtype=np.int64))
                base[parents[starts[g]]] = at
                check[at + own] = parents[starts[g]]
            alone = np.flatnonzero(ends - starts == 1)
            free = np.flatnonzero(check == -1)[: len(alone)]
            base[parents[starts[alone]]] = free - children[starts[alone]]
            check[free] = parents[starts[alone]]
            states[rows] = (base[parents] + children)[back]
        accepts = np.full(len(check), -1, dtype=np.int32)
        accepts[states] = np.arange(len(states))
        return cls(base.astype(np.int32), check.astype(np.int32), accepts, words, roots)

    def to_bytes(self) -> bytes:
        import numpy as np

        out = io.BytesIO()
        names = list(self.roots)
        parts = [np.frombuffer("\0".join(names).encode("utf-8", "surrogatepass"), dtype=np.uint8), np.frombuffer(b"".join(self.words), dtype=np.uint8)]
        lengths = np.fromiter(map(len, self.words), dtype=np.int32, count=len(self.words))
        np.savez(out, base=self.base, check=self.check, accepts=self.accepts, langs=parts[0], words=parts[1], lengths=lengths)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Trie:
        import numpy as np

        held = np.load(io.BytesIO(raw))
        langs = held["langs"].tobytes().decode("utf-8", "surrogatepass").split("\0")
        ends = np.cumsum(held["lengths"], dtype=np.int64)
        starts = np.concatenate([[0], ends]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(starts), pa.py_buffer(held["words"])])
        return cls(held["base"], held["check"], held["accepts"], words, {x: i for i, x in enumerate(langs)})

    def numbered(self, words: pa.Array):
        """The number that each of the words has in this trie, or -1."""
        import numpy as np

        return np.asarray(pc.index_in(words, value_set=self.words).fill_null(-1), dtype=np.int32)

    def step(self, states, symbols):
        """The states that the symbols lead to, and whether they do."""
        to = self.base[states] + symbols
        to[(symbols < 0) | (to < 0) | (to >= len(self.check))] = 0  # a root: no word leads there
        return to, self.check[to] == states

    def walk(self, states, at, own, numbers) -> Iterator:
        """Numbers of the phrases accepted from the positions ``at`` on, a level at a time; positions without a state drop out.

        ``own`` has the symbols of the ``numbers``.
        """
        while len(at):
            to, good = self.step(states, own[numbers[at]])
            at, states = at[good] + 1, to[good]
            accepted = self.accepts[states]
            yield accepted[accepted >= 0]
            inside = at < len(numbers)
            at, states = at[inside], states[inside]


class Tries:
    """Tries that all positions of a text walk, one after the other."""

    def __init__(self, tries: Iterable[Trie]):
        self.tries = list(tries)

    def walk(self, lang: str, tokens: list[bytes]) -> Iterator:
        """(number of the trie, numbers of its phrases accepted) of all positions."""
        import numpy as np

        words = Words()
        numbers = np.fromiter(map(words.__getitem__, tokens), dtype=np.int32, count=len(tokens))
        for i, trie in enumerate(self.tries):
            if lang in trie.roots:
                own = trie.numbered(pa.array(words.listed, pa.binary()))
                for accepted in trie.walk(np.full(len(numbers), trie.roots[lang]), np.arange(len(numbers)), own, numbers):
                    yield i, accepted


class Block:
    """Texts as numbers, held together; each position waits for the one trie that has the phrases of its first two words."""

    def __init__(self, shards: int):
        self.shards = shards
        self.words, self.size = Words(), 0
        self.langs: dict[str, int] = {}
        self.numbers, self.of_lang, self.dealt = [], [], []

    def add(self, lang: str, tokens: list[bytes]) -> None:
        """Text that ends with its last token: no phrase runs on into what is added next."""
        import numpy as np

        tokens.append(MARK)
        numbers = np.fromiter(map(self.words.__getitem__, tokens), dtype=np.int32, count=len(tokens))
        (_, two, _), (_, there, _) = _hashes(lang, numbers, self.words)
        dealt = np.full(len(numbers), self.shards, dtype=np.uint16 if self.shards < 1 << 16 else np.int32)  # the last: no pair begins here
        dealt[:-1][there] = two[there] % np.uint64(self.shards)
        self.numbers.append(numbers)
        self.of_lang.append(np.full(len(numbers), self.langs.setdefault(lang, len(self.langs)), dtype=np.int32))
        self.dealt.append(dealt)
        self.size += len(numbers)

    def counted(self, load: Callable[[int], Trie | None]) -> Iterator:
        """(shard, numbers of its phrases, how often each was met), a shard after the other."""
        import numpy as np

        numbers, of_lang, dealt = (np.concatenate(x) for x in (self.numbers, self.of_lang, self.dealt))
        self.numbers, self.of_lang, self.dealt = [], [], []
        order = np.argsort(dealt, kind="stable").astype(np.int32)
        ends = np.cumsum(np.bincount(dealt, minlength=self.shards + 1))
        # words by themselves are counted here, and wait for their trie with their counts
        single, n = np.unique(of_lang.astype(np.int64) * len(self.words) + numbers, return_counts=True)
        single, n = single[single % len(self.words) > 0], n[single % len(self.words) > 0]
        lang_of, word = single // len(self.words), single % len(self.words)
        seeds = np.array([_seed(lang) for lang in self.langs], dtype=np.uint64)
        alone = (_mixed(self.words.hashed()[word] ^ seeds[lang_of]) % np.uint64(self.shards)).astype(np.int64)
        by_shard = np.argsort(alone, kind="stable")
        alone_ends = np.cumsum(np.bincount(alone, minlength=self.shards))
        listed = pa.array(self.words.listed, pa.binary())
        for shard in range(self.shards):
            at = order[ends[shard - 1] if shard else 0 : ends[shard]]
            mine = by_shard[alone_ends[shard - 1] if shard else 0 : alone_ends[shard]]
            if not len(at) + len(mine) or (trie := load(shard)) is None:
                continue
            own, roots = trie.numbered(listed), np.array([trie.roots.get(lang, -1) for lang in self.langs])
            at = at[roots[of_lang[at]] >= 0]
            levels = list(trie.walk(roots[of_lang[at]], at, own, numbers))[1:]  # of pairs and triples
            counts = np.bincount(np.concatenate([*levels, np.zeros(0, dtype=np.int32)]), minlength=int(trie.accepts.max()) + 1)
            mine = mine[roots[lang_of[mine]] >= 0]
            to, good = trie.step(roots[lang_of[mine]], own[word[mine]])
            accepted = trie.accepts[to[good]]
            counts[accepted[accepted >= 0]] += n[mine[good]][accepted >= 0]
            some = np.flatnonzero(counts)
            yield shard, some, counts[some]


def _dealt(phrases: DataFrame, shards: int) -> DataFrame:
    """(shard, lang, phrase): a phrase goes where its first two words lead, a word by itself where it leads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from xxhash import xxh3_64_intdigest

        for batch in slices(batches, 10_000):
            langs, phrases = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            seed = {lang: _seed(lang) for lang in set(langs)}
            seeds = np.array([seed[lang] for lang in langs], dtype=np.uint64)
            firsts = [p.split(b" ", 2) for p in phrases]
            hashed = lambda ws: _mixed(np.fromiter(map(xxh3_64_intdigest, ws), dtype=np.uint64, count=len(firsts)) ^ seeds)
            one = hashed([ws[0] for ws in firsts])
            two = _paired(one, hashed([ws[1] if len(ws) > 1 else b"" for ws in firsts]))
            places = np.where([len(ws) > 1 for ws in firsts], two, one) % np.uint64(shards)
            yield pa.RecordBatch.from_arrays([pa.array(places.astype(np.int32)), batch.column(0), batch.column(1)], ["shard", "lang", "phrase"])

    return phrases.select("lang", "phrase").mapInArrow(run, "shard int, lang string, phrase string")


def _stored_tries(phrases: DataFrame, folder: str, shard_phrases: int) -> tuple[DataFrame, int, list[int]]:
    """(shard, number, lang, phrase), the number of shards, and those that hold any. A shard holds about ``shard_phrases`` and becomes one file."""
    spark = phrases.sparkSession
    shards = max(-(-phrases.count() // shard_phrases), 1)
    spark.createDataFrame([(0,)], "x int").write.parquet(f"{folder}/.made")  # makes the folder wherever it lies

    def build(part: pa.Table) -> pa.Table:
        part = part.sort_by([("lang", "ascending"), ("phrase", "ascending")])
        trie = Trie.build(part.column("lang").to_pylist(), part.column("phrase").to_pylist())
        publish(folder, f"{part.column('shard')[0].as_py()}.trie", [trie.to_bytes()])
        numbers = pa.array(range(part.num_rows), pa.int64())
        return pa.table({"shard": part.column("shard"), "number": numbers, "lang": part.column("lang"), "phrase": part.column("phrase")})

    numbered = stored(_dealt(phrases, shards).groupBy("shard").applyInArrow(build, "shard int, number long, lang string, phrase string"), "numbered-phrases")
    return numbered, shards, [r["shard"] for r in numbered.select("shard").distinct().collect()]  # a row per ``shard_phrases``


def _counted(rows: DataFrame, folder: str, shards: int, held: list[int]) -> DataFrame:
    """``COUNTED`` rows, for ``_added_up``: one pass of all texts over the tries ``held``, and the words of each language as shard -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        forget_kept()
        files, root = file_system(folder)
        there, totals, block = set(held), {}, Block(shards)

        def load(shard: int) -> Trie | None:
            if shard not in there:
                return None
            with files.open_input_file(f"{root}/{shard}.trie") as f:
                return Trie.from_bytes(f.read())

        def result() -> Iterator[pa.RecordBatch]:
            for shard, numbers, counts in block.counted(load):
                ends = np.flatnonzero(np.diff(numbers // CELL_CHUNK)) + 1
                parts = zip(np.split(numbers, ends), np.split(counts, ends), strict=True)
                yield _counted_batch([(shard, int(at[0]) // CELL_CHUNK, _gaps(at % CELL_CHUNK), _narrow(n), None, None) for at, n in parts if len(at)])

        for lang, tokens in chunks(batches):
            totals[lang] = totals.get(lang, 0) + len(tokens) - tokens.count(MARK)
            block.add(lang, tokens)
            if block.size > HELD_TOKENS:
                yield from result()
                block = Block(shards)
        if block.size:
            yield from result()
        yield _counted_batch([(-1, 0, None, None, lang, n) for lang, n in totals.items()])

    return rows.mapInArrow(run, COUNTED)


def _narrow(counts) -> bytes:
    """Whole numbers in as few bytes each as the largest needs: 1, 2 or 8."""
    return counts.astype("<u1" if counts.max() < 1 << 8 else "<u2" if counts.max() < 1 << 16 else "<i8").tobytes()


COUNTED = "shard int, chunk int, at binary, counts binary, lang string, n long"


def _counted_batch(rows) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.int64()]
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in COUNTED.split(", ")])


def _added_up(counted: DataFrame) -> DataFrame:
    """(shard, number, lang, f): sums over tasks. A task adds up its chunks one after the other."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        now, total, words = None, None, {}

        def result(shard, numbers, langs, sums):
            columns = [pa.array(np.full(len(sums), shard), pa.int32()), pa.array(numbers, pa.int64()), pa.array(langs, pa.string()), pa.array(sums, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["shard", "number", "lang", "f"])

        def chunk_result():
            some = np.flatnonzero(total)
            return result(now[0], some + now[1] * CELL_CHUNK, [None] * len(some), total[some])

        for batch in batches:
            for shard, chunk, at, counts, lang, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard < 0:
                    words[lang] = words.get(lang, 0) + n
                    continue
                if now != (shard, chunk):
                    if now is not None:
                        yield chunk_result()
                    now, total = (shard, chunk), np.zeros(CELL_CHUNK, dtype=np.int64)
                places = _from_gaps(at)
                total[places] += np.frombuffer(counts, dtype=f"<{'i' if len(counts) == 8 * len(places) else 'u'}{len(counts) // len(places)}")
        if now is not None:
            yield chunk_result()
        if words:
            yield result(-1, [0] * len(words), list(words), list(words.values()))

    rows = counted.repartition("shard", "chunk").sortWithinPartitions("shard", "chunk")
    return rows.mapInArrow(fold, "shard int, number long, lang string, f long")


def phrase_counts(
    docs: DataFrame, least: int = LEAST_COUNT, text: str = "text", lang: str = "lang", shard_phrases: int = SHARD_PHRASES, bits: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Exact counts (lang, phrase, words, f) of all candidates and their words, and totals (lang, n) of words, if there are any candidates.

    Every phrase of two or three words that occurs ``least`` times (at most 255) is among them. ``bits`` is the logarithm of the number of
    cells; by default it follows the size of the texts. More cells mean fewer candidates, never other results.
    """
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), plain_text(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long")).alias("b")).first()["b"] or 0
    if bits is None:
        bits = min(max((size // 16).bit_length(), CELL_BITS[0]), CELL_BITS[1])
    full = _full_cells(_first_pass(rows, bits, least), bits, least)
    pairs = _in_parts(rows, size, bits, least, 2, full)
    full |= _full_cells(pairs, bits, least)
    triples = _in_parts(rows, size, bits, least, 3, full)
    named = stored(pairs.union(triples).filter("level = 0").select("lang", "phrase").distinct(), "phrases")
    single = named.select("lang", F.explode(F.split("phrase", " ")).alias("phrase")).distinct()
    folder = fresh_path(docs.sparkSession, "phrase-tries")
    numbered, shards, held = _stored_tries(stored(named.union(single), "phrases-and-words"), folder, shard_phrases)
    if not held:
        none = numbered.select("lang", "phrase", F.col("shard").alias("words"), F.col("number").alias("f"))  # no rows
        return none, none.select("lang", F.col("f").alias("n"))
    summed = stored(_added_up(_counted(rows, folder, shards, held)), "phrase-counts")
    found = numbered.join(summed.drop("lang"), ["shard", "number"]).select("lang", "phrase", F.size(F.split("phrase", " ")).alias("words"), "f")
    return stored(found, "counted-phrases"), summed.filter("shard = -1 and f > 0").select("lang", F.col("f").alias("n"))


def collocations(
    docs: DataFrame,
    least: int = LEAST_COUNT,
    inside_percent: int = 50,
    top: int = TOP,
    text: str = "text",
    lang: str = "lang",
    shard_phrases: int = SHARD_PHRASES,
    bits: int | None = None,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` collocations of each language.

    A-Z is lower-cased, other letters are not; pieces end at ``. , ; : ! ?`` and at line breaks; words are runs without blanks and
    tabs. A null language is ``und``, a null text empty; an empty table gives no rows. Each row counts, repeats too. The
    score is floor(10^6 a^2 / (l r)) of the cut where it is lowest, in decimals of 38 digits: exact for counts up to 3 10^15.
    Other columns are ignored.
    """
    counts, totals = phrase_counts(docs, least, text, lang, shard_phrases, bits)
    frequent = counts.filter((F.col("words") > 1) & (F.col("f") >= least)).select("lang", "phrase", "words", F.col("f").alias("a"))
    parts = F.split("phrase", " ")
    longest = (
        frequent.filter("words = 3")
        .select("lang", "a", F.explode(F.array(F.array_join(F.slice(parts, 1, 2), " "), F.array_join(F.slice(parts, 2, 2), " "))).alias("phrase"))
        .groupBy("lang", "phrase")
        .agg(F.max("a").alias("longer"))
    )
    kept = frequent.join(longest, ["lang", "phrase"], "left").filter(F.coalesce(F.lit(100) * F.col("longer") < F.lit(inside_percent) * F.col("a"), F.lit(True)))
    cuts = kept.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"head": F.array_join(F.slice(parts, 1, F.col("k")), " "), "tail": F.array_join(F.slice(parts, F.col("k") + 1, F.col("words") - F.col("k")), " ")})
    part = lambda name, count: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cuts = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"])
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r")}
    score = F.call_function("div", (F.lit(1_000_000).cast("decimal(7,0)") * wide["a"] * wide["a"]).cast("decimal(38,0)"), (wide["l"] * wide["r"]).cast("decimal(38,0)"))
    lowest = F.min(F.struct(F.col("score"), F.col("k"), F.col("l"), F.col("r"))).alias("m")
    scored = cuts.withColumn("score", score.cast("long")).groupBy("lang", "phrase", "a").agg(lowest)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = scored.select("lang", "phrase", "a", "m.l", "m.r", "m.score").withColumn("rank", rank).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
