"""SentencePiece encoding by suffix arrays, and decoding.

A batch's texts are joined and cut where no piece can go over: between two characters that stand side by side in no piece. The
distinct segments are joined into one text, whose suffix array is sorted by as many bytes as pieces need: by five first, then,
within the suffixes that begin like a longer piece, by three more at a time. Every piece is found by binary search; its
occurrences are one range. The occurrences, sorted by position, are the edges of the segments' lattice. Relaxing them follows the
model: a BPE model takes, segment by segment, the adjacent pair whose joint edge has the best score (the leftmost of equals)
until none is left.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import pieces
from .common import Memory, append_columns, held, joined, segments, table

#: Bytes of new segments that one suffix array indexes, under SPAN; a longer segment is indexed alone.
INDEX_BYTES = 1 << 20
#: Segments whose ids a worker remembers, and their bytes.
CACHE_WORDS, CACHE_BYTES = 400_000, 80 << 20
#: Characters of a segment that is relaxed with the others of its batch; longer ones go one by one over a heap.
TOGETHER = 256
#: Text bytes that are segmented together.
BATCH_BYTES = 4 << 20
#: Bits of a position in a suffix key; the first bytes that it is sorted by, and those added at a time.
POSITION, FIRST, MORE = 24, 5, 3
#: Bytes that one suffix array can index.
SPAN = 1 << POSITION
#: Characters below this have a row in the table of neighbours; others are cut off only before a space.
NEIGHBOURS = 0x250

_NONE = np.int64(1) << np.int64(30)
_U64 = np.uint64


class _Level:
    """What is searched among suffixes that share a prefix of `depth` bytes (numbered by group): pieces that end within the next
    bytes, and the longer prefixes that go on to the next level."""

    def __init__(self, depth: int, many: int, entries: list[tuple[int, bytes, int]]):
        done = [(g, b[depth:], i) for g, b, i in entries if len(b) <= depth + many]
        longer = sorted({(g, b[depth : depth + many]) for g, b, _ in entries if len(b) > depth + many})
        self.depth, self.many = depth, many
        self.low, self.high = (np.array([self._key(g, b, pad) for g, b, _ in done], np.uint64) for pad in (0, 1))
        self.piece = np.array([i for _, _, i in done], np.int64)
        self.on_low, self.on_high = (np.array([self._key(g, b, pad) for g, b in longer], np.uint64) for pad in (0, 1))
        number = {x: k for k, x in enumerate(longer)}
        self.rest = [(number[g, b[depth : depth + many]], b, i) for g, b, i in entries if len(b) > depth + many]

    def _key(self, group: int, part: bytes, high: int) -> int:
        value = int.from_bytes(part.ljust(self.many, b"\xff" if high else b"\x00"), "big")
        return (group << (8 * self.many) | value) << POSITION | (((1 << POSITION) - 1) * high)


def _ranges(keys: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places in keys of all that lie in [low, high], which of the ranges each is in)."""
    begin, end = np.searchsorted(keys, low, "left"), np.searchsorted(keys, high, "right")
    found = np.flatnonzero(end > begin)
    many = (end - begin)[found]
    place = np.arange(int(many.sum())) + np.repeat(begin[found] - np.cumsum(many) + many, many)
    return place, np.repeat(found, many)


class Lattice:
    """All piece occurrences in a text of bytes: for each position the set of lengths, and each edge's piece by position and length."""

    def __init__(self, text: bytes, codec: Codec):
        n = len(text)
        padded = np.frombuffer(text + b"\x00" * (codec.width + 8), np.uint8)
        eight = np.ndarray((n + codec.width,), ">u8", padded, 0, (1,))
        at = np.flatnonzero((padded[:n] & 0xC0) != 0x80).astype(np.uint64)
        keep, edges = _U64((1 << POSITION) - 1), []
        keys = (eight[:n][at].astype(np.uint64) & ~keep) | at
        for level in codec.levels:
            keys.sort()
            place, which = _ranges(keys, level.low, level.high)
            number = level.piece[which].astype(np.uint64)
            edges.append((keys[place] & keep) << _U64(32) | codec.lengths[number].astype(np.uint64) << _U64(24) | number)
            place, group = _ranges(keys, level.on_low, level.on_high)
            at = keys[place] & keep
            following = eight[at + _U64(level.depth + level.many)].astype(np.uint64) >> _U64(64 - 8 * MORE)
            keys = (group.astype(np.uint64) << _U64(8 * MORE) | following) << _U64(POSITION) | at
        edge = np.concatenate(edges)
        edge.sort()
        self.number = (edge & _U64((1 << 24) - 1)).astype(np.int64)
        position, length = (edge >> _U64(32)).astype(np.int64), edge >> _U64(24) & _U64(63)
        count = np.bincount(position, minlength=n + 1)
        self.first = np.cumsum(count) - count
        self.lengths = np.zeros(n + 1, np.uint64)
        if len(edge):
            filled = np.flatnonzero(count)
            self.lengths[filled] = np.add.reduceat(_U64(1) << length, self.first[filled])
        self.rank = codec.ranks[self.number]

    def edge(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the edge from start to end, whether there is one)."""
        size, there = np.minimum(end - start, 63).astype(np.uint64), self.lengths[start]
        found = (there >> size & _U64(1)).astype(bool)
        place = self.first[start] + np.bitwise_count(there & ((_U64(1) << size) - _U64(1)))
        return np.where(found, place, 0), found

    def ranks(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if not len(self.rank):
            return np.full(len(start), _NONE)
        place, found = self.edge(start, end)
        return np.where(found, self.rank[place], _NONE)


class Codec:
    def __init__(self, vocabulary: pieces.Pieces):
        self.vocabulary = vocabulary
        named = [(p.replace(pieces.SPACE, " ").encode(), p) for p in vocabulary.scores]
        named = [(b, p) for b, p in named if b"\x00" not in b]
        self.width = max((len(b) for b, _ in named), default=1)
        if self.width > 62 or len(named) >= 1 << 16:
            raise ValueError("pieces of over 62 bytes, or over 65,535 pieces")
        self.lengths = np.array([len(b) for b, _ in named], np.int64)
        scores = np.array([vocabulary.scores[p] for _, p in named])
        self.ranks = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
        self.piece_ids = np.array([vocabulary.ids[p] for _, p in named], np.int64)
        self.levels, entries = [], [(0, b, i) for i, (b, _) in enumerate(named)]
        depth, many = 0, FIRST
        while entries or not self.levels:
            self.levels.append(_Level(depth, many, entries))
            entries, depth, many = self.levels[-1].rest, depth + many, MORE
        self.text_of = np.array([x.replace(pieces.SPACE, " ").encode() if isinstance(x, str) else x for x in vocabulary.names], object)
        self.memory = Memory(CACHE_WORDS, CACHE_BYTES)
        self.parted = self._parted([b.decode() for b, _ in named])

    def _parted(self, named: list[str]) -> np.ndarray:
        """Whether a text can be cut between two characters, by their codes; the last row and column stand for all other characters.

        Without byte pieces an unknown id covers a run of characters, so only a space parts.
        """
        joint = np.ones((NEIGHBOURS + 1, NEIGHBOURS + 1), bool)
        if self.vocabulary.byte_ids is not None:
            joint[:NEIGHBOURS, :NEIGHBOURS] = False
            for p in named:
                for a, b in zip(p, p[1:], strict=False):
                    joint[min(ord(a), NEIGHBOURS), min(ord(b), NEIGHBOURS)] = True
        joint[:, 32] = False
        joint[32, 32] = True
        return ~joint

    # encoding

    def learn(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        batch: list[bytes] = []
        size = 0
        for w in words:
            if batch and size + len(w) >= INDEX_BYTES:
                out += self._index(batch)
                batch, size = [], 0
            batch.append(w)
            size += len(w) + 1
        return out + self._index(batch) if batch else out

    def _index(self, words: list[bytes]) -> list[bytes]:
        text = b"\x00".join(words) + b"\x00"
        if len(text) >= SPAN:
            return [self._long(words[0])]
        lattice = Lattice(text, self)
        raw = np.frombuffer(text, np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(sizes + 1) - sizes - 1
        start, end = self._relax(lattice, raw, begin, begin + sizes)
        ids = self._ids(lattice, raw, start, end)
        bounds = np.append(np.searchsorted(ids[0], begin), len(ids[0])).tolist()
        data = ids[1].astype("<u4").tobytes()
        return [data[4 * a : 4 * b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def _ids(self, lattice: Lattice, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, id) of each symbol. Characters that are no piece: their bytes; without byte pieces one unknown id for each run."""
        if len(lattice.number):
            place, found = lattice.edge(start, end)
            ids = np.where(found, self.piece_ids[lattice.number[place]], -1)
        else:
            ids = np.full(len(start), -1, np.int64)
        unknown = ids < 0
        if not unknown.any():
            return start, ids
        if self.vocabulary.byte_ids is None:
            ids = np.where(unknown, self.vocabulary.unknown, ids)
            keep = ~unknown | ~np.append(False, unknown[:-1] & (end[:-1] == start[1:]))
            return start[keep], ids[keep]
        many = np.where(unknown, end - start, 1)
        out = np.repeat(ids, many)
        place = np.repeat(start, many) + np.arange(len(out)) - np.repeat(np.cumsum(many) - many, many)
        filled = np.repeat(unknown, many)
        out[filled] = np.array(self.vocabulary.byte_ids, np.int64)[raw[place[filled]]]
        return place, out

    def _relax(self, lattice: Lattice, raw: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols (start, end) of all segments after joining adjacent ones, the best edge of each segment first."""
        first = raw & 0xC0 != 0x80
        first[stop] = False
        first[begin[begin < stop]] = True  # a segment that begins within a character can only be broken text
        start = np.flatnonzero(first)
        counts = np.diff(np.append(np.searchsorted(start, begin), len(start)))
        end = np.append(start[1:], 0)
        heads = np.cumsum(counts) - counts
        last = (heads + counts)[counts > 0] - 1
        end[last] = stop[counts > 0]
        ends = np.zeros(len(raw), np.int64)  # by start, of the symbols that are left
        for k in np.flatnonzero(counts > TOGETHER).tolist():
            of = slice(heads[k], heads[k] + counts[k])
            s, e = _relax_one(lattice, start[of], end[of])
            ends[s] = e
        short = (counts <= TOGETHER) & (counts > 0)
        if not short.all():
            keep = np.repeat(short, counts)
            start, end, counts = start[keep], end[keep], counts[short]
        rank = np.full(len(start), _NONE)
        if len(start):
            rank[:-1] = lattice.ranks(start[:-1], end[1:])
            rank[np.cumsum(counts) - 1] = _NONE
        while len(start):
            heads = np.cumsum(counts) - counts
            best = np.minimum.reduceat(rank << 32 | np.arange(len(start)), heads)
            live = best >> 32 < _NONE
            if not live.all():
                gone = ~np.repeat(live, counts)
                ends[start[gone]] = end[gone]
                start, end, rank = start[~gone], end[~gone], rank[~gone]
                shift = np.cumsum(np.where(live, 0, counts))
                best, counts = (best - shift)[live], counts[live]
                heads = np.cumsum(counts) - counts
            at = best & 0xFFFFFFFF
            end[at] = end[at + 1]
            left = np.ones(len(start), bool)
            left[at + 1] = False
            start, end, rank = start[left], end[left], rank[left]
            counts = counts - 1
            at -= np.arange(len(at))
            heads = np.cumsum(counts) - counts
            inner = at[at + 1 < heads + counts]
            rank[at] = _NONE
            rank[inner] = lattice.ranks(start[inner], end[inner + 1])
            before = at[at > heads]
            rank[before - 1] = lattice.ranks(start[before - 1], end[before])
        start = np.flatnonzero(ends)
        return start, ends[start]

    def _long(self, word: bytes) -> bytes:
        """A segment too long for one index: it is indexed in parts that overlap, and relaxed as one."""
        step, lattices = SPAN - 4 * self.width, []
        for a in range(0, len(word), step):
            lattices.append(Lattice(word[a : a + step + self.width] + b"\x00", self))
        lattice = _Joined(lattices, step)
        raw = np.frombuffer(word, np.uint8)
        first = raw & 0xC0 != 0x80
        first[0] = True
        start = np.flatnonzero(first)
        start, end = _relax_one(lattice, start, np.append(start[1:], len(word)))
        return self._ids(lattice, raw, start, end)[1].astype("<u4").tobytes()

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, number of ids of each). A space is put before each text, and U+2581 counts as a space."""
        texts = pc.fill_null(texts, "").cast(pa.binary())
        if not len(texts):
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        texts = pc.replace_substring(texts, pieces.SPACE.encode(), b" ")
        filled = pc.greater(pc.binary_length(texts), 0)
        spaced = pc.binary_join_element_wise(pc.if_else(filled, pa.scalar(b" "), pa.scalar(b"")), texts, pa.scalar(b""))
        bounds = np.frombuffer(spaced.buffers()[1], np.int32)[spaced.offset : spaced.offset + len(spaced) + 1].astype(np.int64)
        data = np.frombuffer(spaced.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if bounds[-1] > bounds[0] else np.empty(0, np.uint8)
        bounds -= bounds[0]
        names, number, places = segments(data, self._cuts(data), bounds)
        return joined(self.memory.look_up(names, self.learn), number, places)

    def _cuts(self, data: np.ndarray) -> np.ndarray:
        """Where a character stands that no piece joins to the one before."""
        cut = np.zeros(len(data), bool)
        if len(data) < 2:
            return cut
        small = np.minimum(data, 128)
        plain = np.zeros((129, 129), bool)
        plain[:128, :128] = self.parted[:128, :128]
        cut[1:] = plain.ravel()[small[:-1].astype(np.int16) * 129 + small[1:]]
        # the others: a character's first byte, if it or the one before is not ASCII
        other = np.flatnonzero(((data[1:] >= 128) | (data[:-1] >= 128)) & (data[1:] & 0xC0 != 0x80)) + 1
        if len(other):
            cut[other] = self.parted[self._code_before(data, other), self._code_at(data, other)]
        return cut

    @staticmethod
    def _code_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
        first, second = data[at].astype(np.int64), data[np.minimum(at + 1, len(data) - 1)].astype(np.int64)
        code = np.where(first < 128, first, np.where((first >= 0xC2) & (first < 0xE0), (first & 0x1F) << 6 | second & 0x3F, NEIGHBOURS))
        return np.minimum(code, NEIGHBOURS)

    @staticmethod
    def _code_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
        last, first = data[at - 1].astype(np.int64), data[np.maximum(at - 2, 0)].astype(np.int64)
        code = np.where(last < 128, last, np.where((first >= 0xC2) & (first < 0xE0) & (at > 1), (first & 0x1F) << 6 | last & 0x3F, NEIGHBOURS))
        return np.minimum(code, NEIGHBOURS)

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        ids, many = self.encode_column(pa.array([None if t is None else t.encode("utf-8", "surrogatepass") for t in texts], pa.binary()))
        return np.split(ids, np.cumsum(many)[:-1]) if texts else []

    # decoding

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """Pieces and bytes joined, less the space put before the text."""
        return b"".join(self.text_of[ids].tolist()).removeprefix(b" ")

    def decode(self, ids) -> str:
        return self.decode_bytes(np.asarray(ids, np.int64)).decode("utf-8", "replace")


class _Joined:
    """Lattices of the parts of a long segment as one, for single lookups."""

    def __init__(self, lattices: list[Lattice], step: int):
        self.parts, self.step = lattices, step
        self.number = np.concatenate([x.number for x in lattices])
        self.rank = np.concatenate([x.rank for x in lattices])
        self.base = np.cumsum([0, *(len(x.number) for x in lattices)])

    def edge(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place, found = np.zeros(len(start), np.int64), np.zeros(len(start), bool)
        part = start // self.step
        for k in np.unique(part).tolist():
            of, shift = part == k, k * self.step
            p, f = self.parts[k].edge(start[of] - shift, end[of] - shift)
            place[of], found[of] = p + self.base[k], f
        return place, found

    def ranks(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if not len(self.rank):
            return np.full(len(start), _NONE)
        place, found = self.edge(start, end)
        return np.where(found, self.rank[place], _NONE)


def _relax_one(lattice: Lattice | _Joined, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for one long segment, by a heap of candidate pairs."""
    s, e = start.tolist(), end.tolist()
    n = len(s)
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    none = int(_NONE)
    ranks = lattice.ranks(start[:-1], end[1:]).tolist() if n > 1 else []
    heap = [(r, i, e[i], e[i + 1]) for i, r in enumerate(ranks) if r != none]
    heapq.heapify(heap)

    def offer(i: int) -> None:
        j = after[i]
        if j >= 0 and e[j] - s[i] < 63 and (r := int(lattice.ranks(np.array([s[i]]), np.array([e[j]]))[0])) != none:
            heapq.heappush(heap, (r, i, e[i], e[j]))

    gone = [False] * n
    while heap:
        _, i, mid, to = heapq.heappop(heap)
        j = after[i]
        if gone[i] or j < 0 or e[i] != mid or e[j] != to:
            continue
        e[i], gone[j], after[i] = to, True, after[j]
        if after[i] >= 0:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    keep = [i for i in range(n) if not gone[i]]
    return start[keep], np.array([e[i] for i in keep], end.dtype)


def codec(path: str) -> Codec:
    return held(("pieces", path), lambda: Codec(pieces.load(path)))


_IDS = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType()))])
_DECODED = T.StructType([T.StructField("decoded", T.StringType())])


def encode(docs: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """Add ids of each whole text, as the library's BPE encoding gives them; no shuffle.

    Null and empty texts have no ids. Repeated rows are encoded each; an empty table gives an empty table. A column of docs
    called ids is replaced.
    """

    def make():
        encoder = codec(model)

        def work(texts):
            ids, many = encoder.encode_column(texts)
            return [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)), pa.int32()), pa.array(ids.view("<i4"), pa.int32()))]

        return work

    return append_columns(docs, _IDS, [text_col], make, limit=BATCH_BYTES, arrow=True)


def decode(rows: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """Add decoded, the text of a row's ids (null list: empty). Texts come back whole, but U+2581 comes back as a space.

    Repeated rows are decoded each; an empty table gives an empty table. An id that the model lacks, or a null one, is an error.
    """

    def make():
        decoder = codec(model)

        def work(lists):
            lists = lists.fill_null(pa.scalar([], lists.type))
            bounds, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            return [[decoder.decode(flat[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]]

        return work

    return append_columns(rows, _DECODED, [ids_col], make, arrow=True)


_DIGESTS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("decoded_sha256", T.StringType())])


def round_trip(docs: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """Add n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids) and decoded_sha256: texts encoded, and decoded from their ids.

    Null and empty texts: no ids, the digests of nothing. Repeated rows are judged each; an empty table gives an empty table.
    Columns of docs with the added names are replaced.
    """

    def make():
        both = codec(model)

        def work(texts):
            ids, many = both.encode_column(texts)
            out: tuple[list, list] = ([], [])
            for row in np.split(ids, np.cumsum(many)[:-1]):
                out[0].append(zlib.crc32(row.tobytes()))
                out[1].append(hashlib.sha256(both.decode(row).encode("utf-8", "surrogatepass")).hexdigest())
            return [many, *out]

        return work

    return append_columns(docs, _DIGESTS, [text_col], make, limit=BATCH_BYTES, arrow=True)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_tokens", "ids_crc32", "decoded_sha256")
