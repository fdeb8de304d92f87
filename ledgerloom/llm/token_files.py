"""Token-ID output: documents as Simple-8b files of ids in ascending id order, with per-block offsets.

File: MAGIC | blocks (words, then exceptions, little-endian uint64) | block index (offset, words, exceptions: int64 each) |
documents (id, id is null, ids: int64 each) | footer (blocks, documents, ids: int64 each) | MAGIC. A file holds whole documents.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from . import simple8b
from .common import Memory, Scratch, held, joined, segments, shared_dir, slices, table

MAGIC = b"S8BTOK01"
#: Ids after which a file is closed; a longer document still stays in one file.
FILE_IDS = 4 << 20
#: Ids that a file's writer or reader holds at once, whole blocks (a longer document is read whole).
HELD_IDS = 256 * simple8b.BLOCK
#: Text bytes whose segments are looked up together.
BATCH_BYTES = 4 << 20
#: New segments that the model gets as one text.
TOGETHER = 16
#: Segments whose ids a worker remembers, and their bytes.
CACHE_WORDS, CACHE_BYTES = 600_000, 128 << 20

#: White space of the pre-tokenizer's pattern.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: What sends a text to be encoded whole: adjoining white space, white space or controls besides space and line feed, either at the end.
_PLAIN = re.compile(rf"[{_SPACE}][{_SPACE}]|[\x00-\x09\x0b-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|[ \n]\Z")
#: Bytes of texts that can't hold any of those: then the pattern needn't be searched.
_ORDINARY = bytes(b for b in range(256) if b in b"\n " or 33 <= b and b not in (0x7F, 0xC2, 0xE1, 0xE2, 0xE3))
_ADJOINING = (b"  ", b" \n", b"\n ", b"\n\n")
#: Segments that are one pre-token by the pattern; letters up to U+024F, as Unicode tables of two libraries could differ beyond.
_ONE = re.compile("[ ]?(?:[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+|[0-9]+|[!-&(-/:-@\\[-`{-~]+)")


def _parting() -> np.ndarray:
    """Whether a plain text's pre-tokens surely part between two bytes: at a space, around a line feed, between kinds of ASCII.

    An apostrophe may begin a contraction, and other characters are of any kind, so nothing else is cut next to those.
    """
    kind = np.full(256, 9)  # ASCII letters, digits and signs are 1 to 3
    for b in range(33, 127):
        kind[b] = 1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 9 if chr(b) == "'" else 3
    out = (kind[:, None] != kind) & (kind[:, None] < 9) & (kind < 9)
    out[:, [10, 32]] = True
    out[10] = True
    return out


def _alphabet() -> np.ndarray:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else one from U+0100 on."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printed]
    out = np.arange(256, dtype="<u4")
    out[rest] = 256 + np.arange(len(rest))
    return out


class ByteBpe:
    """Ids of texts under a byte-level BPE file of the tokenizers library.

    A text whose white space is single spaces and line feeds is cut where the pre-tokenizer always parts it; distinct segments of
    a batch are encoded once by the library and remembered. Any other text is encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.memory = Memory(CACHE_WORDS, CACHE_BYTES)
        newline = self.whole("\n")
        self.gap_id = int(np.frombuffer(newline, "<u4")[0])
        # the file's own model behind a cheaper splitter: segments of one pre-token are spelled here, in bulk
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.alphabet = _alphabet()
        self.alphabet[0], self.alphabet[1] = ord(" "), 1
        self.parting = _parting().ravel()
        probes = [b"abc", b" \xc3\x9cber", b"12", b" -.", b" x"]
        self.parts = len(newline) == 4 and self.one_by_one(probes) == [self.whole(x.decode()) for x in probes]
        self.parts = self.parts and self.whole("a, b1\nc.d") == b"".join(map(self.whole, ("a", ",", " b", "1", "\n", "c", ".", "d")))

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def one_by_one(self, words: list[bytes]) -> list[bytes]:
        """Ids of segments that are one pre-token each: all spelled in the vocabulary's alphabet at once, then the model.

        The model gets many as one text, parted by the spelling of a line feed, whose id then parts their ids.
        """
        groups = [b"\x00\n\x00".join(words[i : i + TOGETHER]) for i in range(0, len(words), TOGETHER)]
        spelled = self.alphabet[np.frombuffer(b"\x01".join(groups), np.uint8)].tobytes().decode("utf-32-le").split("\x01")
        found = self.model.encode_batch_fast(spelled, add_special_tokens=False)
        flat: list[int] = []
        for e in found:
            flat += e.ids
            flat.append(self.gap_id)
        ids = np.array(flat, "<u4")
        ends = np.flatnonzero(ids == self.gap_id) * 4
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *(ends[:-1] + 4).tolist()], ends.tolist(), strict=True)]

    def learn(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        one = [i for i, w in enumerate(words) if _ONE.fullmatch(w.decode("utf-8", "surrogatepass"))]
        for i in set(range(len(words))).difference(one):
            out[i] = self.whole(words[i].decode("utf-8", "surrogatepass"))
        for a in range(0, len(one), 50_000):
            part = one[a : a + 50_000]
            for i, ids in zip(part, self.one_by_one([words[i] for i in part]), strict=True):
                out[i] = ids
        return out

    def plain(self, data: bytes) -> bool:
        """Whether words are parted by single spaces and line feeds alone."""
        if not self.parts or data[0] in b" \n" or data[-1] in b" \n" or any(x in data for x in _ADJOINING):
            return False
        return not data.translate(None, _ORDINARY) or not _PLAIN.search(data.decode("utf-8", "surrogatepass"))

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, number of ids of each); null texts have none."""
        texts = pc.fill_null(texts.cast(pa.binary()), b"")
        data = texts.to_numpy(zero_copy_only=False).tolist()
        plain = np.array([bool(d) and self.plain(d) for d in data], bool)
        raw = np.frombuffer(b"".join(d for d, p in zip(data, plain, strict=True) if p), np.uint8)
        bounds = np.append(0, np.cumsum([len(d) for d, p in zip(data, plain, strict=True) if p])).astype(np.int64)
        made, many = np.empty(0, "<u4"), np.empty(0, np.int64)
        if len(raw):
            cut = np.zeros(len(raw), bool)
            cut[1:] = self.parting[raw[:-1].astype(np.uint16) << 8 | raw[1:]]
            names, number, places = segments(raw, cut, bounds)
            made, many = joined(self.memory.look_up(names, self.learn), number, places)
        if plain.all():
            return made, many
        counts, parts, at = np.zeros(len(data), np.int64), [], 0
        counts[plain] = many
        for i, d in enumerate(data):
            if not plain[i]:
                parts.append(np.frombuffer(self.whole(d.decode("utf-8", "surrogatepass")), "<u4") if d else made[:0])
                counts[i] = len(parts[-1])
            else:
                parts.append(made[at : at + counts[i]])
                at += counts[i]
        return np.concatenate(parts) if parts else made, counts

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_column(pa.array([text], pa.string()))[0]

    @cached_property
    def bytes_of(self) -> np.ndarray:
        """The bytes of each id: its spelling's letters in the alphabet's order, or a special token as it is written."""
        letters = {chr(c): bytes((b,)) for b, c in enumerate(_alphabet())}
        names = self.tokenizer.get_vocab(with_added_tokens=False)
        out = np.full(self.tokenizer.get_vocab_size(with_added_tokens=True), b"", object)
        for i, token in self.tokenizer.get_added_tokens_decoder().items():
            out[i] = token.content.encode()
        for name, i in names.items():
            if all(c in letters for c in name):
                out[i] = b"".join(letters[c] for c in name)
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids that `encode` gave."""
        return b"".join(self.bytes_of[ids].tolist()).decode("utf-8", "replace")


def byte_bpe(path: str) -> ByteBpe:
    return held(("bytes", path), lambda: ByteBpe(path))


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"[a-z0-9+.-]+://", uri, re.I) and not uri.startswith("file://"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), re.sub(r"^file:(//)?", "", uri)


class TokenFile:
    """A new file under a temporary name, which `close` exchanges for its own; it holds few blocks' ids at once."""

    def __init__(self, uri: str):
        self.store, self.path = _place(uri)
        self.store.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.store.open_output_stream(f"{self.path}.tmp")
        self.out.write(MAGIC)
        self.at, self.ids, self.held, self.pending = len(MAGIC), 0, 0, []
        self.index: list[np.ndarray] = []
        self.docs: list[tuple[int, bool, int]] = []

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc or 0, doc is None, len(ids)))
        self.pending.append(ids)
        self.ids += len(ids)
        self.held += len(ids)
        if self.held >= HELD_IDS:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.empty(0, "<u4")
        whole = len(ids) if last else len(ids) - len(ids) % simple8b.BLOCK
        for a in range(0, whole, HELD_IDS):
            words, exceptions, n_words, n_exceptions = simple8b.encode(ids[a : min(a + HELD_IDS, whole)])
            word_at, exception_at = np.cumsum(n_words) - n_words, np.cumsum(n_exceptions) - n_exceptions
            self.index.append(np.stack([self.at + 8 * (word_at + exception_at), n_words, n_exceptions], 1).astype("<i8"))
            if len(exceptions):
                for w, nw, e, ne in zip(word_at, n_words, exception_at, n_exceptions, strict=True):
                    self.out.write(words[w : w + nw].astype("<u8").tobytes() + exceptions[e : e + ne].astype("<u8").tobytes())
            else:
                self.out.write(words.astype("<u8").tobytes())
            self.at += 8 * (len(words) + len(exceptions))
        self.pending = [ids[whole:].copy()] if whole < len(ids) else []
        self.held = len(ids) - whole

    def close(self) -> int:
        self._flush(True)
        index = np.concatenate(self.index) if self.index else np.empty((0, 3), "<i8")
        self.out.write(index.tobytes() + np.array(self.docs, "<i8").reshape(-1, 3).tobytes())
        self.out.write(np.array([len(index), len(self.docs), self.ids], "<i8").tobytes() + MAGIC)
        self.out.close()
        self.store.move(f"{self.path}.tmp", self.path)
        return self.ids


def write_file(uri: str, docs: list[tuple[int | None, np.ndarray]]) -> int:
    out = TokenFile(uri)
    for doc, ids in docs:
        out.add(doc, ids)
    return out.close()


def read_docs(uri: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """The documents of a file in turn, (id, ids); few blocks, or one document, are held at once."""
    store, path = _place(uri)
    with store.open_input_file(path) as f:
        size = f.size()
        tail = f.read_at(24 + len(MAGIC), size - 24 - len(MAGIC))
        if tail[24:] != MAGIC or f.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"not a token file: {uri}")
        n_blocks, n_docs, n_ids = np.frombuffer(tail[:24], "<i8").tolist()
        at = size - 24 - len(MAGIC) - 24 * (n_blocks + n_docs)
        tables = np.frombuffer(f.read_at(24 * (n_blocks + n_docs), at), "<i8").reshape(-1, 3)
        index, docs = tables[:n_blocks], tables[n_blocks:]
        step, block, begin, found = HELD_IDS // simple8b.BLOCK, 0, 0, 0
        ids = np.empty(0, "<u4")
        for doc, null, n in docs.tolist():
            parts = [ids[begin:]]
            have = len(parts[0])
            while have < n:
                if block >= n_blocks:
                    raise ValueError(f"{uri} holds {found} ids instead of {n_ids}")
                part = _blocks_of(f, index[block : block + step])
                block, found, have = block + step, found + len(part), have + len(part)
                parts.append(part)
            if len(parts) > 1:
                ids, begin = np.concatenate(parts), 0
            yield (None if null else doc), ids[begin : begin + n]
            begin += n
        if found != n_ids or begin != len(ids):
            raise ValueError(f"{uri} holds {found} ids instead of {n_ids}")


def _blocks_of(f, index: np.ndarray) -> np.ndarray:
    """Ids of consecutive blocks."""
    n_words, n_exceptions = index[:, 1], index[:, 2]
    data = np.frombuffer(f.read_at(8 * int(n_words.sum() + n_exceptions.sum()), int(index[0, 0])), "<u8")
    if n_exceptions.any():
        kind = np.repeat(np.tile([False, True], len(index)), np.stack([n_words, n_exceptions], 1).ravel())
        return simple8b.decode(data[~kind], data[kind], n_words, n_exceptions).astype("<u4")
    return simple8b.decode(data, data[:0], n_words, n_exceptions).astype("<u4")


def read_file(uri: str) -> tuple[np.ndarray, list[tuple[int | None, int]]]:
    """All ids of a file, and (id, number of ids) of its documents."""
    docs = [(doc, ids) for doc, ids in read_docs(uri)]
    return np.concatenate([ids for _, ids in docs]) if docs else np.empty(0, "<u4"), [(doc, len(ids)) for doc, ids in docs]


def read_block(uri: str, block: int) -> np.ndarray:
    """One block's ids, by its offset alone."""
    store, path = _place(uri)
    with store.open_input_file(path) as f:
        size = f.size()
        n_blocks, n_docs, _ = np.frombuffer(f.read_at(24, size - 24 - len(MAGIC)), "<i8").tolist()
        at = size - 24 - len(MAGIC) - 24 * (n_blocks + n_docs)
        offset, n_words, n_exceptions = np.frombuffer(f.read_at(24, at + 24 * block), "<i8").tolist()
        data = np.frombuffer(f.read_at(8 * (n_words + n_exceptions), offset), "<u8")
    return simple8b.decode(data[:n_words], data[n_words:], np.array([n_words]), np.array([n_exceptions]))


MANIFEST = "part int, seq int, path string, n_docs long, n_ids long"


def write_token_files(docs: DataFrame, root: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Write files under `root`, a folder that all executors see, and return their manifest (lazy: act on it once).

    Ascending id order over (part, seq); null ids first; rows of one id by text. A retried task writes new names, and only the
    names that it returns count, so a lost executor leaves at most files that nothing names. Null and empty texts are the end
    id alone. No rows: no files. Other columns are not written.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), tie.alias("tie"))
    rows = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, bpe, seq, out = TaskContext.get().partitionId(), byte_bpe(tokenizer), 0, None
        end = np.array([end_id], "<u4")

        def closed():
            total = out.close()
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "path": [name], "n_docs": [len(out.docs)], "n_ids": [total]})

        for batch in batches:
            for piece in slices(batch, ["text"], BATCH_BYTES):
                found, many = bpe.encode_column(piece.column(1))
                bounds = np.cumsum(many)
                for doc, stop, n_ids in zip(piece.column(0).to_pylist(), bounds.tolist(), many.tolist(), strict=True):
                    if out and out.ids + n_ids + 1 > file_ids:
                        yield closed()
                        seq, out = seq + 1, None
                    if out is None:
                        name = f"{root}/part-{part:06d}-{seq:06d}-{uuid.uuid4().hex}.s8b"
                        out = TokenFile(name)
                    out.add(doc, np.concatenate([found[stop - n_ids : stop], end]))
        if out:
            yield closed()

    return rows.mapInArrow(run, MANIFEST)


def read_token_files(manifest: DataFrame, per_doc, schema: str) -> DataFrame:
    """One row for each document of the files: doc_id, start (ids of all documents before it), n_tokens, and what per_doc(ids) gives.

    The running start needs only the manifest, a row for each file.
    """
    before = W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base")).repartition(n)
    full = f"doc_id long, start long, n_tokens long, {schema}"
    extra = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for doc, ids in read_docs(path):
                    rows.append((doc, at, len(ids), *per_doc(ids)))
                    at += len(ids)
                    if len(rows) >= 10_000:
                        yield made(rows)
                        rows = []
                if rows:
                    yield made(rows)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        doc, start, n_tokens, *more = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (doc, start, n_tokens)), *map(pa.array, more)], names=["doc_id", "start", "n_tokens", *extra])

    return placed.mapInArrow(run, full)


def crc_of(ids: np.ndarray) -> tuple[int]:
    return (zlib.crc32(ids.astype("<u4").tobytes()),)


def op10_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    files = write_token_files(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/tokens", public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(scratch.keep(files, "manifest"), crc_of, "ids_crc32 long")
