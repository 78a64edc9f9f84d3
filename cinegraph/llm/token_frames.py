"""Token ids as independent zstandard frames with a trailing seek table.

A shard is one file and a valid stream of zstandard frames:

* for each document one data frame of its ids (little-endian, 2 bytes each if
  the vocabulary allows, else 4), then a skippable frame of one byte, which is
  the line end that Spark's text writer puts after each value;
* at the end a skippable frame with the seek table: for each document its id
  (8 bytes), flags (1: the id is null), offset and length of its frame, number
  of ids and the crc32 of the ids as unsigned 32-bit integers; then the entry count,
  the ids' width and a magic number.

A reader takes the last bytes, finds the table, and decompresses the
frames of the wanted documents only; each frame's checksum is compared.
Shards are written by Spark's own writer, so a lost executor's task is
simply run again, and any store that Spark reaches will do. Null texts are
empty documents; null ids come first; repeated rows are documents of their own.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinegraph.llm.common import cut, planned_bytes, scratch_path, small_batches, whole_text
from cinegraph.llm.word_index import index_words, portions, tidy

END_ID = 1
MAGIC = 0x43464D53
SKIP = 0x184D2A50
ENTRY = np.dtype([("id", "<i8"), ("flags", "<u4"), ("offset", "<u8"), ("length", "<u4"), ("n", "<u4"), ("crc", "<u4")])
TAIL = struct.Struct("<QII")  # entries, width, magic
#: Input bytes (by the planner) that one shard should hold at most.
SHARD_BYTES = 128 << 20
#: Words, and pieces of words, that a worker keeps: the first that it meets, for they hold the frequent ones.
CACHE_WORDS = 100_000
#: Words that are cut at once.
BULK = 20_000
#: Ends a word among ids, all of which have a zero as their highest byte.
MARK = b"\xff" * 4

#: Words of these characters only need no Unicode normalization, and fall apart as PIECES says.
PLAIN = re.compile(r"[a-zA-Z0-9À-ÖØ-öø-ÿ!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]+")
PIECES = re.compile(r"\n|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ\n]+")
#: A tokenizer's words that show whether PIECES splits as it does: case, accents, digits, signs and their mixtures.
PROBES = ("The", "ÉCOLE", "été", "Straße", "a1b22c", "x'y", "don't", "end...", "%%%", "3.14", "foo-bar_baz", "A,b", "e-mail@host.org", "¿qué?", "ÿØæ", "``", "$5", "1990s")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Encodes texts with a tokenizer of the tokenizers library, each distinct word of a batch once.

    The vocabulary drops white space and never joins over it, so a text's ids
    are its words' ids in order. Plain words go to the library's model piece by
    piece, if PROBES show that the tokenizer falls apart so; any other word, and any word of another tokenizer, goes
    through its whole pipeline. A tokenizer that keeps or joins white space is refused.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the executor's cores are busy already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters() | {0: "\0", 10: "\n"}
        self.ids: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {"\n": MARK}
        whole = [self.whole(w) for w in PROBES]
        if self.whole(" ".join(PROBES)) != b"".join(whole) or self.whole(" \t\n" + PROBES[0] + "\r\n ") != whole[0]:
            raise ValueError(f"{path}: this tokenizer does not treat words one by one")
        try:
            plain = [w for w in PROBES if PLAIN.fullmatch(w)]
            self.by_pieces = self._bulk(plain) == [x for w, x in zip(PROBES, whole, strict=True) if w in plain]
        except Exception:  # noqa: BLE001 - a model of another kind may refuse the pieces
            self.by_pieces = False

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _bulk(self, words: list[str]) -> list[bytes]:
        """Ids of plain words, all cut by one call."""
        parts = PIECES.findall("\n".join(words).lower())
        mapped = "\0".join(parts).encode().decode("latin-1").translate(self.letters).split("\0")
        del parts
        tokenize, known = self.model.tokenize, self.pieces
        new = {p: array("I", [t.id for t in tokenize(p)]).tobytes() for p in set(mapped).difference(known)}
        found = b"".join([known[p] if p in known else new[p] for p in mapped]).split(MARK)
        known.update(islice(new.items(), max(0, CACHE_WORDS - len(known))))
        return found

    def _learn(self, words: list[str]) -> list[bytes]:
        plain = [w for w in words if PLAIN.fullmatch(w) and "<|" not in w] if self.by_pieces else []
        found: dict[str, bytes] = {}
        for at in range(0, len(plain), BULK):
            some = plain[at : at + BULK]
            found.update(zip(some, self._bulk(some), strict=True))
        return [found[w] if w in found else self.whole(w) for w in words]

    def _ids_of(self, words: list[str]) -> list[bytes]:
        found = list(map(self.ids.get, words))
        missing = [k for k, x in enumerate(found) if x is None]
        for k, x in zip(missing, self._learn([words[k] for k in missing]), strict=True):
            found[k] = x
        self.ids.update(islice(zip(words, found, strict=False), max(0, CACHE_WORDS - len(self.ids))))
        return found

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids as unsigned 32-bit integers, and where each text starts in them."""
        split = index_words(texts)
        found = self._ids_of(split.words)
        flat = np.frombuffer(b"".join(found), np.uint32)
        length = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begin = np.cumsum(length) - length
        n = length[split.index]
        ends = np.cumsum(n)
        kind = np.int32 if len(flat) + (ends[-1] if len(ends) else 0) < 2**31 else np.int64
        at = np.repeat((begin[split.index] - (ends - n)).astype(kind), n)
        at += np.arange(len(at), dtype=kind)
        return flat[at], np.concatenate([[0], ends])[split.offsets]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def encode_documents(docs: DataFrame, tokenizer_path: str, bounds: list[int], vocab_below: int, id_col: str, text: str, end_id: int) -> DataFrame:
    """One frame a document: part (of the id's range), id, n, crc, frame."""
    schema = "part int, id long, n long, crc long, frame binary"
    width = 2 if vocab_below <= 1 << 16 else 4

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3, write_checksum=True)
        end = np.array([end_id], "<u4").tobytes()
        cuts = np.array(bounds, np.int64)
        coder = encoder(tokenizer_path)
        for batch in batches:
            for rows in portions(batch, 1):
                flat, cut_at = coder.texts(rows.column(1))
                raw = [flat[a:b].astype("<u4").tobytes() + end for a, b in zip(cut_at[:-1].tolist(), cut_at[1:].tolist(), strict=True)]
                frames = [press.compress(np.frombuffer(x, "<u4").astype(f"<u{width}").tobytes()) for x in raw]
                ids = rows.column(0)
                where = np.searchsorted(cuts, ids.fill_null(-(2**63)).to_numpy(zero_copy_only=False), side="right")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(where, pa.int32()), ids.cast(pa.int64()), pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array(frames, pa.binary())],
                    names=["part", "id", "n", "crc", "frame"],
                )

    return docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text).alias("text")).mapInArrow(tidy(encode), schema)


def range_bounds(docs: DataFrame, id_col: str, shards: int) -> list[int]:
    """Ids that cut the documents into about equal ranges; reads the id column only."""
    if shards < 2:
        return []
    found = docs.select(F.percentile_approx(F.col(id_col).cast("long"), [i / shards for i in range(1, shards)], 20_000).alias("b")).first()["b"]
    return sorted(set(found or []))


def shards_for(docs: DataFrame) -> int:
    """The session's partitions, or more if the plan's size says that shards would be above SHARD_BYTES of input."""
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-planned_bytes(docs) // SHARD_BYTES))


def write_frames(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text: str = "text", end_id: int = END_ID, vocab_below: int = 1 << 16, shards: int | None = None) -> None:
    """Writes the documents in ascending order of id to shards under path."""
    bounds = range_bounds(docs, id_col, shards or shards_for(docs))
    width = 2 if vocab_below <= 1 << 16 else 4
    encoded = encode_documents(docs, tokenizer_path, bounds, vocab_below, id_col, text, end_id)
    ordered = encoded.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions(F.col("id").asc_nulls_first(), "crc", "n")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, at = [], 0
        skip = struct.pack("<II", SKIP, 1)
        for batch in batches:
            out = []
            for i, n, crc, frame in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                entries.append((i or 0, int(i is None), at, len(frame), n, crc))
                out.append(frame + skip)
                at += len(frame) + len(skip) + 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
        if entries:
            yield pa.RecordBatch.from_arrays([pa.array([seek_table(entries, width)], pa.binary())], names=["value"])

    with small_batches(docs.sparkSession):
        ordered.mapInArrow(assemble, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\n").text(path)


def seek_table(entries: list[tuple], width: int) -> bytes:
    body = np.array(entries, ENTRY).tobytes() + TAIL.pack(len(entries), width, MAGIC)
    return struct.pack("<II", SKIP, len(body) + 1) + body  # the line end is the frame's last byte


def read_table(content: bytes) -> tuple[np.ndarray, int]:
    """Seek table and id width of a shard."""
    n, width, magic = TAIL.unpack_from(content, len(content) - 1 - TAIL.size)
    if magic != MAGIC:
        raise ValueError("not a shard of token frames")
    return np.frombuffer(content, ENTRY, n, len(content) - 1 - TAIL.size - n * ENTRY.itemsize), width


def decode_frame(frame: bytes | memoryview, entry: np.void, width: int) -> np.ndarray:
    """Ids of a document's frame, compared with the checksum of its entry."""
    import zstandard

    ids = np.frombuffer(zstandard.ZstdDecompressor().decompress(frame), f"<u{width}").astype("<u4")
    if zlib.crc32(ids.tobytes()) != entry["crc"] or len(ids) != entry["n"]:
        raise ValueError(f"the frame of document {entry['id']} is damaged")
    return ids


def read_frames(content: bytes, table: np.ndarray, width: int, picks: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(index, ids) of the picked entries; only their frames are decompressed."""
    view = memoryview(content)
    for k in picks:
        e = table[k]
        yield k, decode_frame(view[int(e["offset"]) : int(e["offset"]) + int(e["length"])], e, width)


def shard_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).where("length > 0").select("path", "content")


def read_local(path: str, wanted: np.ndarray) -> Iterator[tuple[np.void, int, np.ndarray]]:
    """(entry, place, ids) of the wanted documents of a shard that the worker can open: its end, its seek table and their frames are read, nothing else."""
    with open(path, "rb") as f:
        size = f.seek(0, os.SEEK_END)
        f.seek(size - 1 - TAIL.size)
        n = TAIL.unpack(f.read(TAIL.size))[0]
        f.seek(size - 1 - TAIL.size - n * ENTRY.itemsize)
        table, width = read_table(f.read())
        for k in np.flatnonzero(np.isin(table["id"], wanted) & (table["flags"] == 0)).tolist():
            f.seek(int(table[k]["offset"]))
            yield table[k], k, decode_frame(f.read(int(table[k]["length"])), table[k], width)


def read_documents(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, ids (array of long), shard, place for the wanted documents, or for all.

    Shards that a worker can open itself (file: paths) are read by ranges: the seek table, then the wanted frames. Other stores
    are read by Spark's binary source, which fetches whole shards; only the wanted frames are decompressed then too.
    """
    wanted = None if doc_ids is None else np.array(sorted(doc_ids), np.int64)
    schema = "doc_id long, ids array<long>, shard string, place long"

    def row(e, k, ids, p) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([None if e["flags"] else int(e["id"])], pa.int64()), pa.array([ids.astype(np.int64).tolist()], pa.list_(pa.int64())), pa.array([p]), pa.array([int(k)], pa.int64())], names=["doc_id", "ids", "shard", "place"])

    def by_range(batches):
        for batch in batches:
            for p in batch.column(0).to_pylist():
                for e, k, ids in read_local(unquote(urlparse(p).path), wanted):
                    yield row(e, k, ids, p)

    def whole(batches):
        for batch in batches:
            for p, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                table, width = read_table(content)
                picks = np.arange(len(table)) if wanted is None else np.flatnonzero(np.isin(table["id"], wanted) & (table["flags"] == 0))
                for k, ids in read_frames(content, table, width, picks):
                    yield row(table[k], k, ids, p)

    shards = shard_files(spark, path)
    if wanted is not None and urlparse(path).scheme in ("", "file"):
        return shards.select("path").mapInArrow(by_range, schema)  # the content column is not read
    return shards.mapInArrow(whole, schema)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the frames themselves, in the order of the shards.

    A first look at the seek tables gives the ids before each shard; one row a shard.
    """

    def digest(batches):
        for batch in batches:
            for p, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                table, width = read_table(content)
                found = [(len(ids), zlib.crc32(ids.tobytes())) for _, ids in read_frames(content, table, width, range(len(table)))]
                n = np.array([x[0] for x in found], np.int64)
                names = ["doc_id", "shard", "inside", "n_tokens", "ids_crc32"]
                ids = pa.array(table["id"].astype(np.int64), pa.int64(), mask=table["flags"] != 0)
                yield pa.RecordBatch.from_arrays([ids, pa.array([p] * len(n)), pa.array(np.cumsum(n) - n), pa.array(n), pa.array([x[1] for x in found], pa.int64())], names=names)

    found = cut(shard_files(spark, path).mapInArrow(digest, "doc_id long, shard string, inside long, n_tokens long, ids_crc32 long"))
    totals = found.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    in_order = Window.orderBy(F.length("shard"), "shard")  # part numbers have five digits or more
    before = totals.select("shard", (F.sum("n").over(in_order) - F.col("n")).alias("before"))
    return found.join(before, "shard").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "shard")


def tokenize_to_frames(docs: DataFrame, tokenizer_path: str, path: str | None = None, **options) -> DataFrame:
    """Writes the frames, reads them back and returns the digests; path is in the shared folder if not given."""
    path = path or scratch_path(docs.sparkSession, "frames")
    write_frames(docs, path, tokenizer_path, **options)
    return read_digests(docs.sparkSession, path)
