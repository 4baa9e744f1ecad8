"""Token ids as length-delimited binary records with masked checksums, and an offset index beside them.

A data file is a row of frames: length of the payload (8 bytes), its masked checksum (4), the payload, its masked
checksum (4), all little-endian. A payload is the ids of one document, two bytes each if the vocabulary allows,
else four. An index file has one entry of 24 bytes a frame: doc_id, offset of the frame, number of ids, and flags
(1: the doc_id is null). The checksum is CRC-32, rotated by 15 bits, plus a constant.
"""

from __future__ import annotations

import json
import os
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import NOT_BLANK, Words, gathered, small_batches, written
from tidemark.session import scratch_path

#: Text bytes that go to one data file.
FILE_BYTES = 24 << 20
#: Text bytes whose pieces are encoded together.
ENCODE_BYTES = 12 << 20
INDEX_ENTRY = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("n_tokens", "<u4"), ("flags", "<u4")])
NULL_ID = 1
FRAME = 16

FILES = "file string, width int, records long, tokens long"
RECORDS = "file string, width int, doc_id long, offset long, start long, n_tokens long, ids_crc32 long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes, at: int = 0) -> bytes:
    """The payload of the frame at a place; raises on a wrong checksum or a cut file."""
    head = data[at : at + 12]
    if len(head) < 12 or masked(head[:8]) != struct.unpack("<I", head[8:])[0]:
        raise ValueError(f"damaged record length at {at}")
    size = struct.unpack("<Q", head[:8])[0]
    payload, tail = data[at + 12 : at + 12 + size], data[at + 12 + size : at + 16 + size]
    if len(tail) < 4 or masked(payload) != struct.unpack("<I", tail)[0]:
        raise ValueError(f"damaged record at {at}")
    return payload


# Kinds of bytes that a tokenizer of classes never merges: letters, single digits, other characters of ASCII. What the
# rest joins (bytes outside ASCII, apostrophes of contractions) is left to the tokenizer.
_LETTER, _DIGIT, _OTHER, _OPEN = 1, 2, 3, 4
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _LETTER
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x80:] = _KIND[0x27] = _OPEN


def _apart(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    one, two = _KIND[one], _KIND[two]
    return ((one != two) & (one != _OPEN) & (two != _OPEN)) | ((one == _DIGIT) & (two == _DIGIT))


class Encoder:
    """Ids of whole texts.

    With ``by_class``, each distinct piece of a slice of texts is encoded once. It is for BPE tokenizers that
    lower-case, drop white space, take letters, single digits and other characters apart and mark the end of
    what they merge: there a text's ids are those of its pieces, one after the other.
    """

    #: Pieces encoded as one text; the marked ends tell them apart.
    TOGETHER = 64

    def __init__(self, path: str, by_class: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.whole, self.by_class = Tokenizer.from_file(path), by_class
        if not by_class:
            return
        spec = json.loads(self.whole.to_str())
        self.added = [x["content"].encode() for x in spec["added_tokens"]]
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        self.ends = np.zeros(max(model["vocab"].values()) + 1, bool)
        self.ends[[i for token, i in model["vocab"].items() if token.endswith(suffix)]] = True
        merges = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]]
        self.pieces = []
        for normalizer in (None, self.whole.normalizer):
            # no two pieces are equal: nothing to keep in a cache
            tokenizer = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, cache_capacity=0, end_of_word_suffix=suffix))
            if normalizer is not None:
                tokenizer.normalizer = normalizer
            tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.pieces.append(tokenizer)

    @staticmethod
    def encode(tokenizer, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, tokenizer, pieces: list[str]) -> Iterator[list[int]]:
        """Ids of pieces that the tokenizer merges as a whole, many at a time."""
        groups = [pieces[i : i + self.TOGETHER] for i in range(0, len(pieces), self.TOGETHER)]
        for group, ids in zip(groups, self.encode(tokenizer, [" ".join(x) for x in groups]), strict=True):
            stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(stops) == len(group) and stops[-1] == len(ids):
                yield from (ids[a:b] for a, b in zip([0, *stops], stops, strict=False))
            else:
                yield from self.encode(self.whole, group)

    def ids_of(self, pieces: list[str]) -> list[list[int]]:
        """The tokenizer normalizes before it lower-cases, so only pieces of ASCII are lower-cased ahead of it; others
        are merged as a whole if they still are letters after that."""
        pieces = [x.lower() if x.isascii() else x for x in pieces]
        known: dict[str, list[int]] = {}
        plain, letters, rest = [], [], []
        for x in dict.fromkeys(pieces):
            if x.isascii() and "'" not in x:
                plain.append(x)
            elif unicodedata.normalize("NFC", x).lower().isalpha():
                letters.append(x)
            else:
                rest.append(x)
        for tokenizer, chosen in zip(self.pieces, (plain, letters), strict=True):
            known.update(zip(chosen, self._together(tokenizer, chosen), strict=True))
        known.update(zip(rest, self.encode(self.whole, rest), strict=True))
        return [known[x] for x in pieces]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after the other, and how many each has."""
        words = Words(texts, NOT_BLANK, apart=_apart) if self.by_class else None
        # a special token's own string is more than its pieces
        if words is None or any(x in words.data.tobytes() for x in self.added):
            found = self.encode(self.whole, [x or "" for x in texts.to_pylist()])
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes
        named = words.array(pa.string()).dictionary_encode()
        found = self.ids_of(named.dictionary.to_pylist())
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))
        begins = np.cumsum(sizes) - sizes
        piece = named.indices.to_numpy()
        each = sizes[piece]
        upto = np.zeros(len(each) + 1, np.int64)
        np.cumsum(each, out=upto[1:])
        return ids[np.arange(upto[-1]) + np.repeat(begins[piece] - upto[:-1], each)], np.diff(upto[words.first])


def _write_batches(path: str, folder: str, by_class: bool, end_id: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"tokens-{task.partitionId():06d}"
        # an attempt writes under its own name; the finished file then takes its place, as often as a task is repeated
        own = f"{root}/_{name}-{task.taskAttemptId()}"
        encoder, kind = None, np.dtype("<u2" if width == 2 else "<u4")
        entries, offset, tokens = [], 0, 0
        with store.open_output_stream(f"{own}.bin") as out:
            for part in gathered(batches, most=ENCODE_BYTES):
                encoder = encoder or Encoder(path, by_class)
                ids, sizes = encoder(part.column("text"))
                if max(end_id, int(ids.max(initial=0))) > np.iinfo(kind).max:
                    raise ValueError(f"ids do not fit in {width} bytes")
                begin = 0
                for doc_id, size in zip(part.column("doc_id").to_pylist(), sizes.tolist(), strict=True):
                    record = frame(np.append(ids[begin : begin + size], end_id).astype(kind).tobytes())
                    out.write(record)
                    entries.append((doc_id or 0, offset, size + 1, NULL_ID * (doc_id is None)))
                    begin, offset, tokens = begin + size, offset + len(record), tokens + size + 1
        if not entries:
            store.delete_file(f"{own}.bin")
            return
        with store.open_output_stream(f"{own}.idx") as out:
            out.write(np.array(entries, INDEX_ENTRY).tobytes())
        store.move(f"{own}.idx", f"{root}/{name}.idx")
        store.move(f"{own}.bin", f"{root}/{name}.bin")
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, width, len(entries), tokens)], schema=pa.schema([("file", pa.string()), ("width", pa.int32()), ("records", pa.int64()), ("tokens", pa.int64())]))

    return run


def write_records(docs: DataFrame, tokenizer: str, folder: str, end_id: int, doc_id: str = "doc_id", text: str = "text",
                  by_class: bool = False, width: int = 4, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encodes every whole text and writes one record a row, in ascending doc_id order over all files.

    Returns the files written: (file, width, records, tokens); names ascend with the ids in them. ``folder`` must
    be one that all executors reach. A null text is an empty one, whose record holds the end id alone. A null doc_id
    comes first and is flagged in the index. Rows of one doc_id are ordered by their text. No rows give no files.
    """
    small_batches(docs.sparkSession)
    needed = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    size = needed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // file_bytes))
    ordered = needed.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    return written(ordered.mapInArrow(_write_batches(tokenizer, folder, by_class, end_id, width), FILES), "files")


def _read_batches(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_stream(f"{root}/{row['file']}.idx") as source:
                    index = np.frombuffer(source.read(), INDEX_ENTRY)
                kind = np.dtype("<u2" if row["width"] == 2 else "<u4")
                sums = np.zeros(len(index), np.int64)
                with store.open_input_stream(f"{root}/{row['file']}.bin") as source:
                    for k, size in enumerate((index["n_tokens"].astype(np.int64) * row["width"] + FRAME).tolist()):
                        ids = np.frombuffer(unframe(source.read(size)), kind)
                        sums[k] = zlib.crc32(ids.astype("<u4").tobytes())
                    if source.read(1):
                        raise ValueError(f"{row['file']}: more data than its index has")
                counts = index["n_tokens"].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["file"]] * len(index), pa.string()), pa.array([row["width"]] * len(index), pa.int32()), pa.array(index["doc_id"], mask=index["flags"] & NULL_ID != 0),
                     pa.array(index["offset"].astype(np.int64)), pa.array(row["base"] + np.cumsum(counts) - counts), pa.array(counts), pa.array(sums)],
                    names=["file", "width", "doc_id", "offset", "start", "n_tokens", "ids_crc32"],
                )

    return run


def read_records(files: DataFrame, folder: str) -> DataFrame:
    """(file, width, doc_id, offset, start, n_tokens, ids_crc32) from the files themselves, checksums verified.

    start counts the ids before the document in all files. ids_crc32 is the CRC-32 of the ids as little-endian
    unsigned 32-bit integers, whatever their width in the file.
    """
    # one row a file; each carries the ids before it to its reader, so that records are never joined
    ahead = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    based = files.select("file", "width", F.coalesce(F.sum("tokens").over(ahead), F.lit(0)).alias("base"))
    return based.repartition("file").mapInArrow(_read_batches(folder), RECORDS)


def _seek_batches(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        name, source = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["file"] != name:
                    name, source = row["file"], store.open_input_file(f"{root}/{row['file']}.bin")
                source.seek(row["offset"])
                ids = np.frombuffer(unframe(source.read(row["n_tokens"] * row["width"] + FRAME)), "<u2" if row["width"] == 2 else "<u4")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["doc_id"]], pa.int64()), pa.array([row["rank"]], pa.int64()), pa.array([ids.astype(np.int64)], pa.list_(pa.int64()))], names=["doc_id", "rank", "ids"])

    return run


def read_shuffled(records: DataFrame, folder: str, seed: int) -> DataFrame:
    """(doc_id, rank, ids): documents with a place in a random order, read by seeking to their offsets.

    Each task goes through its records file by file; sorting by rank gives the epoch's order.
    """
    rank = F.xxhash64(F.lit(seed), "file", "offset").alias("rank")
    wanted = records.select("file", "width", "doc_id", "offset", "n_tokens", rank)
    return wanted.repartition("file").sortWithinPartitions("file", "offset").mapInArrow(_seek_batches(folder), "doc_id long, rank long, ids array<long>")


def token_records(docs: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text", by_class: bool = False, width: int = 4) -> DataFrame:
    """Writes the records to a new folder beside the checkpoints and returns what reading them back gives."""
    folder = scratch_path(docs.sparkSession, "tokens")
    return read_records(write_records(docs, tokenizer, folder, end_id, doc_id, text, by_class, width), folder)
