"""Token ids in binary blocks with a shared zstandard dictionary.

``write_tokens`` lays down two Parquet tables in a folder that any executor can reach:

* ``dictionary``: one row with the zstandard dictionary and its SHA-256;
* ``blocks``: one row per block of consecutive documents, by part and place in it: their ids, for each its number of token ids and
  the end of its frame (the offset index), the SHA-256 of the dictionary, and ``payload``, the frames end
  to end.  A frame holds one document's ids as little-endian unsigned integers of ``width`` bytes, so a
  single short document is read with one slice and one call.

Documents are in ascending id order (null ids first; rows of equal id by a hash of the text).  The
dictionary is trained on a documented number of documents; everything else is done for every document.
"""

from __future__ import annotations

import hashlib
import string
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from earshot.llm.common import give_back, hash_limit, kept, slices
from earshot.sources.shared import cut, new_path

END_ID = 0
_BLOCKS = (
    "part int, seq int, first bigint, ids array<bigint>, counts array<int>, ends array<bigint>, width int, dictionary string, payload binary"
)
#: Blocks are closed once their payload has this many bytes; one document is never split.
BLOCK_BYTES = 1 << 20
#: Strings that make encoding piece by piece differ from encoding the text at once: white space other than
#: single blanks and line ends between other characters, and what special tokens begin with.
_UNEVEN = (
    "  ", "\n\n", " \n", "\n ", "<|", "\x00", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0",
    "\u1680", "\u180e", *map(chr, range(0x2000, 0x200C)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000", "\ufeff",
)


#: The characters that stand for bytes in a byte-level vocabulary: visible Latin-1 characters stand for
#: themselves, the other bytes, in order, for characters from U+0100 on.
_VISIBLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_UNITS = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _VISIBLE)}
_BLANK = chr(_BYTE_UNITS[0x20])


#: ASCII characters that are neither letters, digits nor white space; the apostrophe may join letters to a unit.
_PUNCTUATION = "".join(c for c in string.punctuation if c != "'")
_KIND = np.zeros(256, np.uint8)
_KIND[list(string.ascii_letters.encode())] = 1
_KIND[list(_PUNCTUATION.encode())] = 2


def even(text: str) -> bool:
    """Whether the text's pieces encode on their own; if not, it has to be encoded at once.

    The vocabulary's pattern joins a blank to what follows it and never to what precedes it, and a single
    line end to nothing.
    """
    return bool(text) and text[0] not in " \n" and text[-1] not in " \n" and not any(x in text for x in _UNEVEN)


def cut_pieces(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The pieces of even texts end to end, and at which piece each text begins, with the end of the last.

    A piece begins with a text, at every blank, at and after every line end, and where ASCII letters and punctuation
    meet, which the pattern never joins; apostrophes aside.
    """
    parts = [t.encode() for t in texts]
    data = b"".join(parts)
    raw = np.frombuffer(data, np.uint8)
    bounds = np.cumsum([0, *map(len, parts)])
    line_end = raw == 0x0A
    begins = (raw == 0x20) | line_end
    begins[1:] |= line_end[:-1]
    kinds = _KIND[raw]
    begins[1:] |= (kinds[1:] ^ kinds[:-1]) == 3
    begins[bounds[:-1]] = True
    offsets = np.append(np.flatnonzero(begins), len(raw)).astype(np.int64)
    pieces = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return pieces, np.searchsorted(offsets, bounds)


class Pieces(dict):
    """Ids of pieces met lately as bytes, in two generations of bounded size; new pieces are encoded."""

    def __init__(self, tokenizer, dtype: str, most: int):
        super().__init__()
        self.tokenizer, self.model, self.dtype, self.most = tokenizer, tokenizer.model, dtype, most
        self.code = "H" if np.dtype(dtype).itemsize == 2 else "I"
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self._learn(piece)
        self[piece] = ids
        return ids

    def _learn(self, piece: str) -> bytes:
        word = piece[1:] if piece[:1] == " " else piece
        if word.isalpha():
            # Letters, perhaps after a blank, are one unit of the vocabulary's pattern: the merges apply as they are.
            if word.isascii():
                units = word if word is piece else _BLANK + word
            else:
                units = piece.encode().decode("latin-1").translate(_BYTE_UNITS)
            ids = [t.id for t in self.model.tokenize(units)]
            return struct.pack(f"<{len(ids)}{self.code}", *ids)
        head = word.rstrip(_PUNCTUATION)
        if head != word and head.isalpha():
            # Punctuation after a letter is a piece of its own.
            end = len(piece) - len(word) + len(head)
            return self[piece[:end]] + self[piece[end:]]
        return self.encode([piece])[0]

    def encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False) if texts else []
        return [np.array(e.ids, self.dtype).tobytes() for e in found]

    def age(self) -> None:
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()


class Encoder:
    """Ids of whole texts, equal to encoding each text at once; pieces repeat and are remembered."""

    def __init__(self, path: str, dtype: str, most: int = 300_000):
        from tokenizers import Tokenizer

        self.pieces = Pieces(Tokenizer.from_file(path), dtype, most)

    def __call__(self, texts: list[str]) -> list[bytes]:
        self.pieces.age()
        out = [b""] * len(texts)
        places = [i for i, text in enumerate(texts) if even(text)]
        for i in set(range(len(texts))).difference(places):
            out[i] = self.pieces.encode([texts[i]])[0]
        if places:
            for i, ids in zip(places, self._joined([texts[i] for i in places])):
                out[i] = ids
        return out

    def _joined(self, texts: list[str]) -> list[bytes]:
        """Each different piece of the texts is looked up once; Arrow lays the ids out."""
        pieces, firsts = cut_pieces(texts)
        coded = pieces.dictionary_encode()
        known = pa.array(list(map(self.pieces.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False))), pa.large_binary())
        ids = known.take(coded.indices)
        offsets, data = ids.buffers()[1:]
        ends = np.frombuffer(offsets, np.int64)[firsts].tolist()
        view = memoryview(data)
        return [bytes(view[a:b]) for a, b in zip(ends, ends[1:])]


def encoder(path: str, dtype: str) -> Encoder:
    """One encoder per Python worker, so that tasks share what it remembers."""
    return kept(("encoder", path, dtype), lambda: Encoder(path, dtype))


def id_type(tokenizer_path: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 else "<u4"


def train_dictionary(
    docs: DataFrame, tokenizer_path: str, *, sample_rows: int, sample_bytes: int, dictionary_bytes: int
) -> bytes:
    """A dictionary trained on the id arrays of documents chosen by a hash.

    Of the ``sample_rows`` smallest hashes those are taken, in order, whose texts fit into ``sample_bytes``; no more
    than about twice as many texts are moved.  Empty if the sample is too small to train on; frames are then
    written without a dictionary.
    """
    dtype = id_type(tokenizer_path)

    def serialize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, dtype)
        for batch in batches:
            for part in slices(batch):
                found = encode([t or "" for t in part.column(0).to_pylist()])
                yield pa.RecordBatch.from_pydict({"ids": pa.array(found, pa.binary())})

    # About twice the rows wanted, found in one scan, and each text once.
    few = docs.filter(F.col("_mark") <= hash_limit(sample_rows, docs.count())).groupBy("_mark").agg(F.first("text").alias("text"))
    few = cut(few, "sample")
    marks, left = [], sample_bytes
    size = F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")
    for row in few.select("_mark", size).orderBy("_mark").limit(sample_rows).collect():
        if row["size"] <= left:
            marks.append((row["_mark"],))
            left -= row["size"]
    wanted = docs.sparkSession.createDataFrame(marks, "_mark bigint")
    chosen = few.join(F.broadcast(wanted), "_mark", "left_semi").select("text")
    rows = [bytes(r["ids"]) for r in chosen.mapInArrow(serialize, "ids binary").collect() if r["ids"]]
    if len(rows) < 16 or sum(map(len, rows)) < 8 * dictionary_bytes // 4:
        return b""
    try:
        return zstandard.train_dictionary(dictionary_bytes, rows).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int | None = END_ID,
    sample_rows: int = 1000,
    sample_bytes: int = 16 << 20,
    dictionary_bytes: int = 64 << 10,
    level: int = 3,
) -> str:
    """Encode ``docs`` into ``path`` and return it.  A null text is empty."""
    spark = docs.sparkSession
    x, text = F.col(id_col), F.col(text_col)
    rows = docs.select(x.cast("bigint").alias("id"), text.alias("text"), F.xxhash64(text, x).alias("_mark"))
    dictionary = train_dictionary(
        rows, tokenizer_path, sample_rows=sample_rows, sample_bytes=sample_bytes, dictionary_bytes=dictionary_bytes
    )
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, bytearray(dictionary))], "sha256 string, dictionary binary").coalesce(1).write.parquet(
        f"{path}/dictionary"
    )
    # The text is shuffled before it is encoded: choosing the ranges then reads ids only, and each
    # task encodes its documents in their final order.
    order = [F.col("id").asc_nulls_first(), F.col("_mark")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    job = _block_writer(tokenizer_path, dictionary, digest, end_id, level)
    placed.select("id", "text", F.spark_partition_id().alias("part")).mapInArrow(job, _BLOCKS).write.option(
        "compression", "none"
    ).parquet(f"{path}/blocks")
    return path


def _block_writer(tokenizer_path: str, dictionary: bytes, digest: str, end_id: int | None, level: int) -> Callable:
    dtype = id_type(tokenizer_path)
    end = b"" if end_id is None else np.array([end_id], dtype).tobytes()
    width = np.dtype(dtype).itemsize

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, dtype)
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        press = zstandard.ZstdCompressor(level=level, dict_data=shared, write_checksum=False, write_content_size=True)
        ids: list[int | None] = []
        counts: list[int] = []
        frames: list[bytes] = []
        held = seq = part_no = first = 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part_no], pa.int32()),
                    "seq": pa.array([seq], pa.int32()),
                    "first": pa.array([first], pa.int64()),
                    "ids": pa.array([ids], pa.list_(pa.int64())),
                    "counts": pa.array([counts], pa.list_(pa.int32())),
                    "ends": pa.array([np.cumsum([len(f) for f in frames])], pa.list_(pa.int64())),
                    "width": pa.array([width], pa.int32()),
                    "dictionary": pa.array([digest]),
                    "payload": pa.array([b"".join(frames)], pa.binary()),
                }
            )

        for batch in batches:
            for part in slices(batch):
                part_no = part.column(2)[0].as_py()
                for row_id, found in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()])):
                    found += end
                    ids.append(row_id)
                    counts.append(len(found) // width)
                    frames.append(press.compress(found))
                    held += len(frames[-1])
                    if held >= BLOCK_BYTES or len(ids) >= 4096:
                        yield close()
                        first += sum(counts)
                        ids, counts, frames, held, seq = [], [], [], 0, seq + 1
        if ids:
            yield close()
            ids, counts, frames = [], [], []
        batch = part = found = None
        give_back()

    return write


def read_dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    found = bytes(row["dictionary"])
    if hashlib.sha256(found).hexdigest() != row["sha256"]:
        raise ValueError("the dictionary differs from its digest")
    return row["sha256"], found


def frame(payload: bytes, ends: list[int], index: int) -> bytes:
    """The compressed ids of the document at ``index`` of a block."""
    return payload[ends[index - 1] if index else 0 : ends[index]]


def opener(dictionary: bytes) -> Callable[[bytes], bytes]:
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    press = zstandard.ZstdDecompressor(dict_data=shared)
    return press.decompress


def read_tokens(spark: SparkSession, path: str, *, with_ids: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` per document, read back from the files.

    ``start`` counts the ids of all documents before it; ``with_ids`` adds the ids as ``array<int>``.
    """
    digest, dictionary = read_dictionary(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks")
    # A block knows where it starts in its part; parts are as many as the write had tasks, and each is one
    # number here, so the window and the broadcast are small whatever the table holds.
    count = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, b: a + b)
    ends = blocks.select("part", (F.col("first") + count).alias("end")).groupBy("part").agg(F.max("end").alias("n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ends.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    joined = blocks.join(F.broadcast(parts), "part").select(
        (F.col("ahead") + F.col("first")).alias("start"), "ids", "counts", "ends", "width", "dictionary", "payload"
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = opener(dictionary)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}
                if row["dictionary"] != digest:
                    raise ValueError("a block was written with another dictionary")
                counts = np.array(row["counts"], np.int64)
                crcs, arrays = [], []
                for d in range(len(counts)):
                    ids = np.frombuffer(unpack(frame(row["payload"], row["ends"], d)), f"<u{row['width']}")
                    if len(ids) != counts[d]:
                        raise ValueError("a frame differs from its index")
                    crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    if with_ids:
                        arrays.append(ids.astype(np.int32))
                out = {
                    "doc_id": pa.array(row["ids"], pa.int64()),
                    "start": row["start"] + np.cumsum(counts) - counts,
                    "n_tokens": counts,
                    "ids_crc32": pa.array(crcs, pa.int64()),
                }
                if with_ids:
                    out["ids"] = pa.array(arrays, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")
    return joined.mapInArrow(read, schema)


def token_folder(spark: SparkSession) -> str:
    return new_path(spark, "tokens")

