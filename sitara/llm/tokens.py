"""Token-id files: each document's ids compressed alone, with a shared dictionary.

A part file holds, in ascending doc_id order:

    magic (8 bytes), sha-256 of the dictionary (32 bytes), bytes per id (1 byte)
    one zstandard frame per document, over its ids in little-endian order
    index: doc_id, flag "has an id", frame offset, frame length, number of ids,
           as five arrays (int64, uint8, uint64, uint32, uint64)
    index offset, number of documents (two uint64), magic

The dictionary, trained on serialized id arrays, lies beside the parts under
its hash. A reader takes the index from the end of a part and decompresses
single frames, so a short document costs its own bytes only.
"""

from __future__ import annotations

import hashlib
import io
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitara.llm.common import bounded_batches, hash_sample, pick_columns, run_dir, shuffle_partitions

MAGIC = b"SITTOK1\n"
END_ID = 1
LEVEL = 3
#: The dictionary is trained on the ids of so many documents at most, of any length: of a long one, on a run of so many bytes that its hash picks.
SAMPLE_DOCS = 1000
SAMPLE_BYTES = 16_384
DICT_BYTES = 65_536
#: A worker remembers the ids of so many distinct words.
WORDS = 1 << 20
#: How tokens that end a word are written in the vocabulary; without any such token words are encoded one by one.
WORD_END = "</w>"
#: Marks at the end of a run whose character before them is an ASCII or Latin-1 letter or digit: tokens of their own.
_MARKS = re.compile(rb"[.,!?;:*#$%&](?:(?<=[a-zA-Z0-9].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))[.,!?;:*#$%&]*(?!\S)")
#: Texts on which encoding in parts must give the ids of the whole.
PROBES = (
    "Plain words, with marks: here; there! (and) more... end?",
    "don't can't o'clock e-mail under_score a.b.c 3.14 1,000 50% $5 #tag @name a&b x*y",
    "tabs\tand\nlines\r\n\n  runs   of blanks ",
    "\u00c9cole na\u00efve Stra\u00dfe \u0130stanbul \u03a3\u03c3\u03c2 \u01c5 \ufb01ne e\u0301 \u00a0 \u2003 \u200b",
    "\u0645\u0631\u062d\u0628\u0627 \u0628\u0643\u060c \u4f60\u597d\u3002 \u65e5\u672c \ud55c\uad6d\uc5b4 \U0001f600 \u2014 \u201cquoted\u201d",
    "MiXeD CASE ABC123 123abc a1b2 word.word word,word !!! ??? ... --- *** \\ / | ~ ^ ` { } [ ] < > = +",
    "<|endoftext|> <|x |> </w> w</w>",
    "",
    " ",
    "h\u00e9! \u00df, \u00f8; \u00ff: \u00e6# \u00fe$ \u0101% \u0142&",
)
_INDEX = (("doc_id", "<i8"), ("named", "u1"), ("offset", "<u8"), ("length", "<u4"), ("n", "<u8"))


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


class Encoder:
    """Ids of whole texts, word by word.

    The tokenizer drops white space and no token reaches over it, nor from a
    letter or digit to a mark, so a text's ids are those of its runs without
    ASCII white space, and of the marks at their ends, one after another; each
    distinct run is encoded once and remembered. Whether that holds for a
    tokenizer is tried out on PROBES when it is loaded; if not, whole texts
    are encoded.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[bytes, bytes] = {}
        size = max(self.tokenizer.get_vocab().values()) + 1
        self.last = np.zeros(size, dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.last[i] = token.endswith(WORD_END)
        probes = [p.encode() for p in PROBES]
        self.whole = False
        self.whole = self.encode(probes) != self._encode_whole(probes, END_ID)
        self.known.clear()

    def _encode_whole(self, texts: list[bytes], end: int) -> list[bytes]:
        tail = np.array([end], dtype=self.kind).tobytes()
        return [np.array(e.ids, dtype=self.kind).tobytes() + tail for e in self._encode([t.decode() for t in texts])]

    def encode(self, texts: list[bytes], end: int = END_ID) -> list[bytes]:
        """Serialized ids of each text and its end."""
        if self.whole:
            return self._encode_whole(texts, end)
        # The tokenizer lowers all letters, but knows its special strings before that.
        split = [_MARKS.sub(rb" \g<0>", t if b"<|" in t else t.lower()).split() for t in texts]
        new = set().union(*split).difference(self.known) if split else set()
        if new:
            self._learn(new)
        tail = np.array([end], dtype=self.kind).tobytes()
        out = [b"".join(map(self.known.__getitem__, words)) + tail for words in split]
        if len(self.known) > WORDS:
            self.known.clear()
        else:
            for w in new:
                if len(w) > 64:
                    del self.known[w]
        return out

    def _learn(self, words: set[bytes]) -> None:
        """Encode words. Those of letters only are one pre-token each; many go through in one string and are parted where a word's last token ends."""
        spelled, other = [], []
        for w in sorted(words):
            t = w.decode()
            (spelled if t.isalpha() else other).append((w, t))
        groups = [spelled[lo : lo + 256] for lo in range(0, len(spelled), 256)]
        for g, e in zip(groups, self._encode([" ".join(t for _, t in g) for g in groups]), strict=True):
            ids = np.array(e.ids, dtype=self.kind)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(g):  # a letter that folds into more than letters
                other += g
                continue
            raw, at = ids.tobytes(), 0
            for (w, _), end in zip(g, (ends * self.kind.itemsize).tolist(), strict=True):
                self.known[w] = raw[at:end]
                at = end
        for (w, _), e in zip(other, self._encode([t for _, t in other]), strict=True):
            self.known[w] = np.array(e.ids, dtype=self.kind).tobytes()

    def _encode(self, texts: list[str]):
        for lo in range(0, len(texts), 1024):
            yield from self.tokenizer.encode_batch_fast(texts[lo : lo + 1024], add_special_tokens=False)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _batches_of_texts(texts: pa.Array, bytes_: int = 1 << 22) -> Iterator[tuple[int, list[bytes]]]:
    held, size, first = [], 0, 0
    for i, t in enumerate(texts):
        buf = t.as_buffer()
        held.append(b"" if buf is None else buf.to_pybytes())
        size += len(held[-1])
        if size >= bytes_:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A zstandard dictionary for id arrays; the samples themselves where they are too few to train on, empty where there are none."""
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def id_window(ids: bytes, draw: int, itemsize: int, size: int = SAMPLE_BYTES) -> bytes:
    """All of some serialized ids, or a run of ``size`` bytes of them, from where ``draw`` says."""
    free = (len(ids) - size) // itemsize
    start = draw % (free + 1) * itemsize if free > 0 else 0
    return ids[start : start + size]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


class PartWriter:
    def __init__(self, stream, dictionary: bytes, kind: np.dtype) -> None:
        self.stream, self.kind, self.at = stream, kind, 0
        shared = _dictionary(dictionary)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, **({"dict_data": shared} if shared else {}))
        self.index: list[tuple] = []
        self._put(MAGIC + hashlib.sha256(dictionary).digest() + bytes([kind.itemsize]))

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.compressor.compress(ids)
        self.index.append((doc_id or 0, doc_id is not None, self.at, len(frame), len(ids) // self.kind.itemsize))
        self._put(frame)

    def close(self) -> tuple[int, int]:
        start, columns = self.at, list(zip(*self.index, strict=True)) or [()] * len(_INDEX)
        for (_, kind), values in zip(_INDEX, columns, strict=True):
            self._put(np.array(values, dtype=kind).tobytes())
        self._put(np.array([start, len(self.index)], dtype="<u8").tobytes() + MAGIC)
        return len(self.index), int(sum(columns[-1]))


class PartReader:
    """Random access to the documents of a part."""

    def __init__(self, file, dictionary: bytes) -> None:
        self.file = file
        size = file.size()
        file.seek(size - 24)
        start, n, magic = *np.frombuffer(file.read(16), dtype="<u8").tolist(), file.read(8)
        file.seek(0)
        head = file.read(41)
        if magic != MAGIC or head[:8] != MAGIC:
            raise ValueError("not a token-id part")
        if head[8:40] != hashlib.sha256(dictionary).digest():
            raise ValueError("the part was written with another dictionary")
        self.kind = np.dtype(f"<u{head[40]}")
        file.seek(start)
        raw, at = file.read(size - 24 - start), 0
        self.index: dict[str, np.ndarray] = {}
        for name, kind in _INDEX:
            self.index[name] = np.frombuffer(raw, dtype=kind, count=n, offset=at)
            at += n * np.dtype(kind).itemsize
        shared = _dictionary(dictionary)
        self.decompressor = zstandard.ZstdDecompressor(**({"dict_data": shared} if shared else {}))

    def __len__(self) -> int:
        return len(self.index["n"])

    def ids(self, i: int) -> np.ndarray:
        self.file.seek(int(self.index["offset"][i]))
        frame = self.file.read(int(self.index["length"][i]))
        return np.frombuffer(self.decompressor.decompress(frame, max_output_size=int(self.index["n"][i]) * self.kind.itemsize), dtype=self.kind)


@dataclass(frozen=True)
class TokenFiles:
    """A written set: the folder, the dictionary's hash, and for each part the number of ids before it."""

    path: str
    dictionary: str
    parts: tuple[int, ...]
    before: tuple[int, ...]


def _write(path: str, digest: str, tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(path)
        part = TaskContext.get().partitionId()
        final = f"{folder}/part-{part:06d}.tok"
        rough = f"{final}.{os.getpid()}-{TaskContext.get().taskAttemptId()}"
        enc = encoder(tokenizer)
        writer = out = None
        for batch in batches:
            if writer is None:
                out = fs.open_output_stream(rough)
                writer = PartWriter(out, read_dictionary(path, digest), enc.kind)
            doc_ids = batch.column(0).to_pylist()
            for first, texts in _batches_of_texts(batch.column(1)):
                for i, ids in enumerate(enc.encode(texts)):
                    writer.add(doc_ids[first + i], ids)
        if writer is not None:
            n, total = writer.close()
            out.close()
            fs.move(rough, final)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n]), pa.array([total])], names=["part", "n", "ids"])

    return run


@lru_cache(maxsize=4)
def read_dictionary(path: str, digest: str) -> bytes:
    fs, folder = filesystem(path)
    with fs.open_input_file(f"{folder}/{digest}.dict") as f:
        return f.read()


def write(docs: DataFrame, tokenizer: str, path: str | None = None) -> TokenFiles:
    """Encode every whole text of ``docs`` and write the part files below ``path`` (default: the shared folder).

    Documents lie in ascending doc_id order over all parts, nulls first; rows
    with equal ids in the order of a hash of their texts. A null text is empty: its end
    id alone. Other columns are ignored.
    """
    pick_columns(docs, "doc_id", "text")
    spark = bounded_batches(docs).sparkSession
    path = path or run_dir(spark, "tokens")
    fs, folder = filesystem(path)
    fs.create_dir(folder, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    few = hash_sample(rows.withColumn("h", F.xxhash64("doc_id", "text")), F.col("h"), SAMPLE_DOCS)

    def serialize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _batches_of_texts(batch.column(0)):
                ids = [id_window(x, zlib.crc32(t), encoder(tokenizer).kind.itemsize) for t, x in zip(texts, encoder(tokenizer).encode(texts), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], names=["ids"])

    dictionary = train_dictionary([r.ids for r in few.select("text").mapInArrow(serialize, "ids binary").collect()])
    digest = hashlib.sha256(dictionary).hexdigest()
    with fs.open_output_stream(f"{folder}/{digest}.dict") as out:
        out.write(dictionary)
    # Rows of one id, or of none, are dealt by their texts too, so no file need hold them all.
    dealt = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(shuffle_partitions(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    made = sorted(dealt.mapInArrow(_write(path, digest, tokenizer), "part int, n long, ids long").collect())
    before = np.concatenate(([0], np.cumsum([r.ids for r in made]))).tolist()
    return TokenFiles(path, digest, tuple(r.part for r in made), tuple(before[:-1]))


def read(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """Reads a set back: doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = read_dictionary(files.path, files.dictionary)
        fs, folder = filesystem(files.path)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                with fs.open_input_file(f"{folder}/part-{files.parts[k]:06d}.tok") as f:
                    reader = PartReader(f, dictionary)
                    n = reader.index["n"].astype(np.int64)
                    starts = files.before[k] + np.cumsum(n) - n
                    for lo in range(0, len(reader), 4096):
                        hi = min(len(reader), lo + 4096)
                        crc = [zlib.crc32(reader.ids(i).astype("<u4").tobytes()) for i in range(lo, hi)]
                        doc_id = pa.array(reader.index["doc_id"][lo:hi], pa.int64(), mask=reader.index["named"][lo:hi] == 0)
                        yield pa.RecordBatch.from_arrays([doc_id, pa.array(starts[lo:hi]), pa.array(n[lo:hi]), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = len(files.parts)
    return spark.range(0, n, 1, max(1, n)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def open_part(data: bytes, dictionary: bytes) -> PartReader:
    """A reader over a part's bytes, for tools and tests."""
    return PartReader(pa.BufferReader(io.BytesIO(data).getvalue()), dictionary)
