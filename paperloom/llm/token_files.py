"""Token ids in files of directly addressable codes.

Each id is split into chunks of 8, 8 and 16 bits, low bits first. Level 1 has the first chunk of every id; a level's bitmap tells
which ids go on in the next level, where they keep their order. A directory of ranks (the ones before each 64-bit word of the
bitmap) makes the place in the next level a sum of two numbers, so that token i is found by a few small reads, without decoding
any block.

The ids are those of the library for the whole text. It finds the strings of its added tokens in a text, so they are cut out
first, unless they shall count as ordinary text.

Nulls, ties and so on: a null text is empty (the end id alone); a null doc_id comes first; rows of equal doc_id are ordered by a
hash of the text, then the text; equal rows are all kept; a very long text is encoded as one block and gets a file of its own; an
empty table gives no file and no row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm import _bytes as B
from paperloom.llm._shared import Ranges, bounded_batches, new_folder, write_whole

MAGIC = b"PLDAC01\n"
WIDTHS = (8, 8, 16)
DTYPES = {8: "<u1", 16: "<u2", 32: "<u4"}
#: A file is closed when it holds so many tokens; a longer document has a file of its own.
FILE_TOKENS = 1 << 21
HEAD = struct.Struct("<8sQQI")
LEVEL = struct.Struct("<QIQQQ")


def levels(ids: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(chunks, whether each goes on) by level. Ids of up to sum(widths) bits."""
    rest, out = ids.astype(np.uint64), []
    for k, w in enumerate(widths):
        more = rest >= (1 << w) if k + 1 < len(widths) else np.zeros(len(rest), bool)
        out.append(((rest & np.uint64((1 << w) - 1)).astype(DTYPES[w]), more))
        rest = rest[more] >> np.uint64(w)
    return out


def packed(ids: np.ndarray, doc_ids: list, ends: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> list[bytes]:
    """A file: head, a line for each level, the table of documents (id, known, end), then of each level chunks, bitmap, ranks."""
    ids_, known = np.array([x or 0 for x in doc_ids], "<i8"), np.array([x is not None for x in doc_ids], "<u1")
    docs = ids_.tobytes() + known.tobytes() + ends.astype("<u8").tobytes()
    at, lines, data = HEAD.size + LEVEL.size * len(widths) + len(docs), [], []
    for w, (chunks, more) in zip(widths, levels(ids, widths), strict=True):
        words = np.zeros(len(chunks) // 64 + 1, "<u8")
        bits = np.packbits(more, bitorder="little")
        words.view("u1")[: len(bits)] = bits
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words))[:-1]]).astype("<u8")
        parts = [chunks.tobytes(), words.tobytes(), ranks.tobytes()]
        lines.append(LEVEL.pack(len(chunks), w, at, at + len(parts[0]), at + len(parts[0]) + len(parts[1])))
        data += parts
        at += sum(map(len, parts))
    return [HEAD.pack(MAGIC, len(ids), len(doc_ids), len(widths)), *lines, docs, *data]


class TokenFile:
    """read(offset, n) gives bytes of the file."""

    def __init__(self, read):
        self.read = read
        magic, self.n_tokens, self.n_docs, k = HEAD.unpack(read(0, HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.levels = list(LEVEL.iter_unpack(read(HEAD.size, LEVEL.size * k)))
        self.docs_at = HEAD.size + LEVEL.size * k

    def token(self, i: int) -> int:
        """Token i by one chunk a level; of a bitmap one word and its rank."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value, shift = 0, 0
        for _, width, chunks, bitmap, ranks in self.levels:
            size = width // 8
            value |= int.from_bytes(self.read(chunks + i * size, size), "little") << shift
            word = int.from_bytes(self.read(bitmap + (i >> 6) * 8, 8), "little")
            if not word >> (i & 63) & 1:
                break
            i = int.from_bytes(self.read(ranks + (i >> 6) * 8, 8), "little") + (word & ((1 << (i & 63)) - 1)).bit_count()
            shift += width
        return value

    def documents(self) -> tuple[list, np.ndarray]:
        """Ids, and n_docs + 1 offsets in tokens."""
        n, at = self.n_docs, self.docs_at
        ids = np.frombuffer(self.read(at, 8 * n), "<i8").tolist()
        known = self.read(at + 8 * n, n)
        ends = np.frombuffer(self.read(at + 9 * n, 8 * n), "<u8").astype(np.int64)
        return [x if k else None for x, k in zip(ids, known, strict=True)], np.concatenate([[0], ends])

    def all_tokens(self) -> np.ndarray:
        below = None
        for n, width, chunks, bitmap, _ in reversed(self.levels):
            value = np.frombuffer(self.read(chunks, n * width // 8), DTYPES[width]).astype(np.uint32)
            if below is not None and len(below):
                more = np.unpackbits(np.frombuffer(self.read(bitmap, (n + 7) // 8), "u1"), count=n, bitorder="little").astype(bool)
                value[more] |= below << np.uint32(width)
            below = value
        return below


#: Bytes before which a space begins a unit: no white space of Unicode starts with them.
AFTER_SPACE = B.table(lambda b: 0x21 <= b < 0x7F or 0xC3 <= b < 0xE0 or 0xE4 <= b < 0xF5)
ASCII_LETTER = B.table(lambda b: 0x41 <= b < 0x5B or 0x61 <= b < 0x7B)
#: ASCII marks but the apostrophe, which can begin a token with the letters after it.
MARK = B.table(lambda b: 0x21 <= b < 0x30 and b != 0x27 or 0x3A <= b < 0x41 or 0x5B <= b < 0x61 or 0x7B <= b < 0x7F)
ONE_WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


def occurrences(buf: np.ndarray, offs: np.ndarray, words: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words that lie in one document, from the left, the longer of two that begin together."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pattern = re.compile(b"|".join(map(re.escape, sorted(words, key=len, reverse=True))))
    data, found = buf.tobytes(), []
    if any(w in data for w in words):
        for a, b in zip(offs.tolist(), offs[1:].tolist(), strict=False):
            found += [m.span() for m in pattern.finditer(data, a, b)]
    both = np.array(found, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def whole_units(buf: np.ndarray, offs: np.ndarray, words: tuple[bytes, ...]) -> np.ndarray:
    """Starts of units, where each of words is one and what is around it counts as a text of its own."""
    starts, ends = occurrences(buf, offs, words)
    if not len(starts):
        return space_units(buf, offs)
    inside = np.zeros(len(buf) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    return space_units(np.where(np.cumsum(inside[:-1], dtype=np.int8) > 0, np.uint8(0), buf), np.unique(np.concatenate([offs, starts, ends])))


def space_units(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Starts of units: at documents, at a space before something that isn't white space, between a letter (ASCII or Latin-1) and
    a mark either way, and around a single line feed beside letters or marks. The vocabulary's own splitting always cuts there."""
    cut = np.zeros(len(buf) + 1, bool)
    if len(buf) > 1:
        here, last = buf[1:], buf[:-1]
        ended = ASCII_LETTER[last]
        ended[1:] |= (buf[:-2] == 0xC3) & (last[1:] >= 0x80) & (last[1:] != 0x97) & (last[1:] != 0xB7)
        mark, feed = MARK[buf], buf == 0x0A
        letter = ASCII_LETTER[here] | (here == 0xC3)
        cut[: len(here)] |= (last == 0x20) & AFTER_SPACE[here]
        cut[1:-1] |= ended & (mark[1:] | feed[1:]) | mark[:-1] & (ASCII_LETTER[here] | feed[1:])
        cut[offs] = True
        cut[1:-1] |= cut[:-2] & feed[:-1] & (letter | mark[1:])  # one line feed only: of several the last is a token of its own
    cut[offs] = True
    return np.flatnonzero(cut[:-1])


def byte_characters() -> dict[int, str]:
    """The characters by which byte-level vocabularies write bytes: printable ones of Latin-1 stand for themselves, the others, in order, for those from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) if b in shown else chr(256 + sum(x not in shown for x in range(b))) for b in range(256)}


@lru_cache(maxsize=4)
def byte_bpe(path: str, added: bool) -> tuple[B.UnitIds, tuple[bytes, ...]]:
    """Units that are one word go to the vocabulary's merges at once; its splitting would not cut them. Besides, the strings that
    get an id of their own: with added, those of the vocabulary's added tokens."""
    from tokenizers import Tokenizer

    made, shown = Tokenizer.from_file(path), byte_characters()
    made.encode_special_tokens = not added
    words = tuple(t.content.encode() for t in made.get_added_tokens_decoder().values() if added or not t.special)
    merges = made.model.tokenize

    def encode(units: list[bytes]) -> list[list[int]]:
        out = [[t.id for t in merges(u.decode("latin-1").translate(shown))] if ONE_WORD.fullmatch(u) else None for u in units]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, made.encode_batch_fast([units[i].decode() for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    return B.UnitIds(encode), words


def tokenized(batches: Iterator[pa.RecordBatch], path: str, added: bool = True) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(doc_ids, ids, offsets of documents in them) by block. added: strings of added tokens get their ids, as in the library;
    otherwise those of special ones are ordinary text."""
    codec, words = byte_bpe(path, added)
    for batch, buf, offs in B.blocks(batches):
        yield batch.column(0).to_pylist(), *codec.ids(buf, offs, whole_units(buf, offs, words))


def with_end(ids: np.ndarray, offs: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Appends end_id to each document."""
    return np.insert(ids, offs[1:], end_id), offs + np.arange(len(offs))


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id and text, dealt by ranges of doc_id and sorted; a doc_id that many rows share is dealt by its texts."""
    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keys = ["doc_id", F.xxhash64("text")]
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys, "text")


def _write(batches: Iterator[pa.RecordBatch], folder: str, path: str, end_id: int, most: int) -> Iterator[pa.RecordBatch]:
    part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
    doc_ids, parts, sizes, rows = [], [], [], []

    def close() -> None:
        ends = np.cumsum(np.array(sizes, np.int64))
        write_whole(f"{folder}/{part:08d}-{len(rows):06d}.dac", packed(np.concatenate(parts), doc_ids, ends), attempt)
        rows.append((part, len(rows), len(doc_ids), int(ends[-1])))
        doc_ids.clear(), parts.clear(), sizes.clear()

    for names, ids, offs in tokenized(batches, path):
        ids, offs = with_end(ids, offs, end_id)
        for k, name in enumerate(names):
            doc_ids.append(name)
            parts.append(ids[offs[k] : offs[k + 1]])
            sizes.append(int(offs[k + 1] - offs[k]))
        if sum(sizes) >= most:
            close()
    if doc_ids:
        close()
    yield pa.RecordBatch.from_pydict({k: [r[i] for r in rows] for i, k in enumerate(("part", "file", "n_docs", "n_tokens"))}, schema=pa.schema([("part", pa.int32()), ("file", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, file_tokens: int = FILE_TOKENS) -> str:
    """Encodes docs (doc_id, text), appends end_id to each, and writes the ids in ascending doc_id order. The folder gets *.dac
    and _files, the list of them; a run that was cut off leaves no list."""
    folder = folder or new_folder(docs.sparkSession, "tokens")
    rows = in_order(docs).mapInArrow(partial(_write, folder=folder, path=tokenizer, end_id=end_id, most=file_tokens), "part int, file int, n_docs long, n_tokens long")
    rows.write.parquet(f"{folder}/_files")
    return folder


def file_starts(spark: SparkSession, folder: str) -> DataFrame:
    """part, file, base: the ids in all files before. Sums by part go through one window, files of a part through their own."""
    files = spark.read.parquet(f"{folder}/_files")
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select("part", before(Window.orderBy("part")).alias("part_base"))
    return files.select("part", "file", before(Window.partitionBy("part").orderBy("file")).alias("in_part")).join(parts, "part").select("part", "file", (F.col("part_base") + F.col("in_part")).alias("base"))


READ_SCHEMA = "part int, file int, doc_id long, at long, n_tokens long, ids_crc32 long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            part, file = map(int, path.as_py().rpartition("/")[2].split(".")[0].split("-"))
            data = memoryview(content.as_buffer())
            found = TokenFile(lambda at, n, data=data: bytes(data[at : at + n]))
            ids, (names, offs) = found.all_tokens(), found.documents()
            raw, o = memoryview(ids.astype("<u4").tobytes()), offs.tolist()
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(names), pa.int32()), pa.array([file] * len(names), pa.int32()), pa.array(names, pa.int64()), pa.array(o[:-1], pa.int64()), pa.array(np.diff(offs), pa.int64()), pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(o, o[1:], strict=False)], pa.int64())], names=[x.split()[0] for x in READ_SCHEMA.split(", ")])


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each document in the files: doc_id, start (the ids of all documents before it), n_tokens, ids_crc32 (of its ids as little-endian unsigned 32-bit integers)."""
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(f"{folder}/*.dac") if _any_file(spark, folder) else None
    if files is None:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    rows = files.select("path", "content").mapInArrow(_digests, READ_SCHEMA)
    return rows.join(file_starts(spark, folder), ["part", "file"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def _any_file(spark: SparkSession, folder: str) -> bool:
    return not spark.read.parquet(f"{folder}/_files").isEmpty()


def tokens_at(spark: SparkSession, folder: str, positions: DataFrame) -> DataFrame:
    """position, token for a DataFrame with positions (long) in the whole sequence: each by a few small reads of its file. A position outside the sequence has no row."""
    ends = file_starts(spark, folder).join(spark.read.parquet(f"{folder}/_files"), ["part", "file"]).select("part", "file", "base", (F.col("base") + F.col("n_tokens")).alias("until"))
    bucket = lambda c: F.floor(c / FILE_TOKENS)
    spread = ends.withColumn("bucket", F.explode(F.sequence(bucket(F.col("base")), bucket(F.col("until") - 1))))
    asked = positions.select(F.col("position").cast("long").alias("position")).withColumn("bucket", bucket(F.col("position")))
    found = asked.join(spread, (asked["bucket"] == spread["bucket"]) & (asked["position"] >= spread["base"]) & (asked["position"] < spread["until"]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            got = []
            for part, file, base, position in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (part, file) != name:
                    if source is not None:
                        source.close()
                    name, source = (part, file), Ranges(f"{folder}/{part:08d}-{file:06d}.dac")
                    tokens = TokenFile(source.read)
                got.append((position, tokens.token(position - base)))
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())], names=["position", "token"])
        if source is not None:
            source.close()

    return found.select("part", "file", "base", "position").repartition("part", "file").sortWithinPartitions("part", "file").mapInArrow(read, "position long, token long")
