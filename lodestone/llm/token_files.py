"""Token-ID files: per-document zstandard frames under one shared dictionary, with an offset index.

A shard is  magic | frames | index | footer.  Each frame is one document's ids (little-endian, 16 bits if the vocabulary
fits, else 32), compressed on its own with the dictionary, so any document opens alone. The index holds doc ids, frame
offsets and id counts as plain arrays; the footer its place, the id width and the SHA-256 of the dictionary, which is a
file of its own in the folder. A reader refuses a shard whose dictionary hash differs from the dictionary it has.

Shards hold ranges of doc_id in ascending order; a manifest with one row a shard (path, documents, ids) gives each shard's
first position. Writers use names of their own attempt and a shard counts only once the manifest names it, so lost
executors, retries and speculation leave no doubt.

The dictionary is trained on a bounded sample: about SAMPLE_ROWS documents picked by a hash of doc_id, SAMPLE_IDS ids of
each at most. Everything else covers all rows. Too small a sample trains no dictionary: frames are then plain.

Encoding: a text is cut before each space that a non-space follows (always a border of the byte-level pre-tokeniser's
words), parts are looked up in tables of bounded bytes, and an unknown pre-token goes to the tokenizers library's model; a text
that holds a special token's string goes to the library whole.

Null texts read as empty: the end id alone. Rows of one doc_id keep the order of their texts; a null doc_id comes first;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import math
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from string import punctuation

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import kept, lean_batches, narrowed, read_table, workspace

MAGIC = b"LTOKv1\0\0"
FOOTER = "<QQB32s8s"
#: Bytes a table holds in each of its two generations, a key and its value counted with PER_ENTRY bytes of Python's own;
#: longer keys than LONG characters are not kept.
TABLE_BYTES, PER_ENTRY, LONG = 112 << 20, 150, 64
SAMPLE_ROWS, SAMPLE_IDS, DICT_BYTES = 1000, 16_000, 64 * 1024
LEVEL = 3
SHARD_ROWS = 40_000
#: Fixed value: the byte-level pre-tokeniser's pattern, for ASCII parts.
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
_UNSAFE = re.compile(r" (?=\s|$)")
_CUT = re.compile(r"(?= \S)")


class Table(dict):
    """Values of make(key), kept for two generations of most bytes each."""

    def __init__(self, make, most: int = TABLE_BYTES // 5):
        self.make, self.before, self.held, self.most = make, {}, 0, most

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONG:
            self.held += PER_ENTRY + 2 * len(key) + len(value)
            if self.held > self.most:
                self.before, self.held = dict(self), 0
                self.clear()
            self[key] = value
        return value


def byte_letters() -> dict[int, int]:
    """The letter of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: 256 + n for n, b in enumerate(rest)}


class Encoder:
    """The tokenizers library behind tables of parts and pre-tokens."""

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.code = "H" if self.tok.get_vocab_size() <= 65536 else "I"
        self.kind = np.dtype("<u2" if self.code == "H" else "<u4")
        self.end = array(self.code, [end_id]).tobytes()
        spec = json.loads(self.tok.to_str())
        self.special = [t["content"] for t in spec["added_tokens"]]
        pre = spec["pre_tokenizer"] or {}
        self.by_part = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec["normalizer"]
        self.tokenize, self.letters = self.tok.model.tokenize, byte_letters()
        self.cut = self.tok.pre_tokenizer.pre_tokenize_str if pre else None
        self.words = Table(self.word)
        self.near: dict[str, bytes] = {}  # parts behind a space, by their text without it; far: the generation before
        self.far: dict[str, bytes] = {}
        self.held = 0
        self.plain = Table(self.part)

    def whole(self, text: str) -> bytes:
        return array(self.code, self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, word: str) -> bytes:
        """The ids of one pre-token by the library's model."""
        return array(self.code, [t.id for t in self.tokenize(word.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def part(self, part: str) -> bytes:
        """The ids of a part: letters behind a space at most are one pre-token, other parts are cut as the pre-tokeniser does."""
        spaced = part[0] == " "
        if part[1:].isalpha() and (spaced or part[0].isalpha()):
            return self.word(part)
        if part[-1] in ".,;:!?" and spaced and part[1:-1].isalpha():  # the mark is a pre-token of its own
            return self.words[part[:-1]] + self.words[part[-1]]
        if not part.isascii():  # which characters are letters or digits depends on a library's Unicode version
            return b"".join([array(self.code, [t.id for t in self.tokenize(w)]).tobytes() for w, _ in self.cut(part)])
        words = WORDS.findall(part)
        return self.words[words[0]] if len(words) == 1 else b"".join([self.words[w] for w in words])

    def encode(self, text: str) -> bytes:
        """A text's ids, the end id last."""
        if not text:
            return self.end
        if not self.by_part or any(s in text for s in self.special):
            return self.whole(text) + self.end
        if _UNSAFE.search(text):
            return b"".join([self.plain[p] for p in _CUT.split(text) if p]) + self.end
        parts = text.split(" ")
        first = parts.pop(0)
        return (self.plain[first] if first else b"") + self.behind_spaces(parts) + self.end

    def behind_spaces(self, parts: list[str]) -> bytes:
        """The ids of parts, each behind a space. This is the hot loop: what the table lacks first, then all in one go."""
        near = self.near
        if lacking := set(parts).difference(near):
            far, tokenize, code, held, long = self.far, self.tokenize, self.code, self.held, []
            for p in lacking:
                ids = far.get(p)
                if ids is None:
                    word = p.rstrip(punctuation)
                    if word.isalpha():  # marks behind a word are one pre-token of their own
                        ids = near.get(word) or far.get(word)
                        if ids is None:
                            ids = array(code, [t.id for t in tokenize("\u0120" + word)]).tobytes() if word.isascii() else self.word(" " + word)
                            if len(word) <= LONG:
                                near[word] = ids
                                held += PER_ENTRY + 2 * len(word) + len(ids)
                        if len(word) < len(p):
                            ids += self.words[p[len(word) :]]
                    else:
                        ids = self.part(" " + p)
                near[p] = ids
                if len(p) > LONG:
                    long.append(p)
                else:
                    held += PER_ENTRY + 2 * len(p) + len(ids)
            out = b"".join(map(near.__getitem__, parts))
            for p in long:
                del near[p]
            self.held = held
            if held > TABLE_BYTES:
                self.far, self.near, self.held = near, {}, 0
            return out
        return b"".join(map(near.__getitem__, parts))


def encoder(path: str, end_id: int) -> Encoder:
    return kept(("tokens", path, end_id), lambda: Encoder(path, end_id))


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if re.match(r"\w+:/", uri) else os.path.abspath(uri))


# ---------------------------------------------------------------- writing


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, rows: int | None = None) -> bytes:
    """A dictionary from the serialized ids of a bounded sample of docs (b"" if zstandard finds the sample too small)."""
    n = docs.count() if rows is None else rows
    part = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // SAMPLE_ROWS))) == 0).limit(4 * SAMPLE_ROWS)

    def run(batches):
        e = encoder(tokenizer, end_id)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([e.encode(t or "")[: SAMPLE_IDS * e.kind.itemsize] for t in b.column(1).to_pylist()], pa.binary())], names=["ids"])

    sample = sorted(bytes(r[0]) for r in part.mapInArrow(run, "ids binary").collect())
    try:
        return zstandard.train_dictionary(DICT_BYTES, sample, level=LEVEL).as_bytes() if len(sample) > 7 else b""
    except zstandard.ZstdError:
        return b""


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0) -> list[dict]:
    """Writes docs (doc_id, text) to folder and returns the manifest: a dict a shard, in order of doc_id."""
    spark = docs.sparkSession
    lean_batches(spark)
    docs = narrowed(docs, doc_id="doc_id", text="text")
    rows = docs.count()
    dictionary = train_dictionary(docs, tokenizer, end_id, rows)
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/dictionary.zdict") as f:
        f.write(dictionary)
    shared = spark.sparkContext.broadcast(dictionary)  # at most DICT_BYTES

    def run(batches):
        e = encoder(tokenizer, end_id)
        fs, root = filesystem(folder)
        given = shared.value
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(given) if given else None, write_checksum=True)
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.tok"
        ids, at, counts, place = [], [0], [], len(MAGIC)
        with fs.open_output_stream(f"{root}/{name}") as f:
            f.write(MAGIC)
            for b in batches:
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    raw = e.encode(text or "")
                    f.write(frame := press.compress(raw))
                    ids.append(doc)
                    counts.append(len(raw) // e.kind.itemsize)
                    at.append(at[-1] + len(frame))
            place += at[-1]
            null = np.array([x is None for x in ids], np.uint8)
            for array in (np.array([x or 0 for x in ids], "<i8"), null, np.array(at, "<u8"), np.array(counts, "<u4")):
                f.write(array.tobytes())
            f.write(struct.pack(FOOTER, place, len(ids), e.kind.itemsize, hashlib.sha256(given).digest(), MAGIC))
        if ids:
            row = [pa.array([shard], pa.int32()), pa.array([name]), *[pa.array([x], pa.int64()) for x in (len(ids), sum(counts), ids[0], ids[-1])]]
            yield pa.RecordBatch.from_arrays(row, names=["shard", "name", "n_docs", "n_ids", "first_id", "last_id"])
        else:
            fs.delete_file(f"{root}/{name}")

    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / SHARD_ROWS)) if rows > 2000 else 1
    ordered = docs.repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    manifest = sorted((r.asDict() for r in ordered.mapInArrow(run, "shard int, name string, n_docs long, n_ids long, first_id long, last_id long").collect()), key=lambda r: r["shard"])
    first = 0
    for r in manifest:
        r["start"] = first
        first += r["n_ids"]
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps({"tokenizer": os.path.basename(tokenizer), "end_id": end_id, "dictionary_sha256": hashlib.sha256(dictionary).hexdigest(), "shards": manifest}).encode())
    return manifest


# ---------------------------------------------------------------- reading


class Shard:
    """Random access to one shard by the position of a document in it."""

    def __init__(self, fs: pafs.FileSystem, path: str, dictionary: bytes):
        self.file = fs.open_input_file(path)
        size = self.file.size()
        place, n, width, digest, magic = struct.unpack(FOOTER, self.file.read_at(struct.calcsize(FOOTER), size - struct.calcsize(FOOTER)))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token file")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path} was written with another dictionary")
        index = self.file.read_at(size - struct.calcsize(FOOTER) - place, place)
        cut = np.cumsum([0, 8 * n, n, 8 * (n + 1), 4 * n])
        ids, null, at, counts = (np.frombuffer(index[a:b], k) for a, b, k in zip(cut, cut[1:], ("<i8", np.uint8, "<u8", "<u4"), strict=False))
        self.keys, self.nulls = ids, int(np.count_nonzero(null))  # ascending, rows without doc_id first
        self.at, self.counts = at.astype(np.int64) + len(MAGIC), counts.astype(np.int64)
        self.kind = np.dtype("<u2" if width == 2 else "<u4")
        self.open = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    @property
    def ids(self) -> list[int | None]:
        return [None] * self.nulls + self.keys[self.nulls :].tolist()

    def place(self, doc_id: int | None) -> int | None:
        """The position of the first document of doc_id."""
        i = 0 if doc_id is None else self.nulls + int(np.searchsorted(self.keys[self.nulls :], doc_id))
        return i if (i < self.nulls if doc_id is None else i < len(self.keys) and self.keys[i] == doc_id) else None

    def document(self, i: int) -> np.ndarray:
        frame = self.file.read_at(int(self.at[i + 1] - self.at[i]), int(self.at[i]))
        return np.frombuffer(self.open.decompress(frame), self.kind)

    def runs(self, most: int = 8 << 20) -> Iterator[tuple[int, list[np.ndarray]]]:
        """All documents in order, read about most bytes at a time: (first position, their ids)."""
        i, n = 0, len(self.keys)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.at, self.at[i] + most, "right")) - 1)
            block = self.file.read_at(int(self.at[j] - self.at[i]), int(self.at[i]))
            base = int(self.at[i])
            yield i, [np.frombuffer(self.open.decompress(block[int(self.at[k]) - base : int(self.at[k + 1]) - base]), self.kind) for k in range(i, j)]
            i = j


def read_manifest(folder: str) -> tuple[dict, bytes]:
    fs, root = filesystem(folder)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        manifest = json.loads(f.read())
    with fs.open_input_stream(f"{root}/dictionary.zdict") as f:
        return manifest, f.read()


def open_document(folder: str, doc_id: int | None) -> np.ndarray | None:
    """The ids of one document (the first of that doc_id) by the offset index, without a Spark job.

    The manifest's last doc_ids ascend, so a bisection names the one shard that can begin with it.
    """
    manifest, dictionary = read_manifest(folder)
    fs, root = filesystem(folder)
    low = lambda x: (x is not None, x or 0)  # noqa: E731  rows without doc_id come first
    at = bisect.bisect_left(manifest["shards"], low(doc_id), key=lambda s: low(s["last_id"]))
    if at == len(manifest["shards"]):
        return None
    shard = Shard(fs, f"{root}/{manifest['shards'][at]['name']}", dictionary)
    i = shard.place(doc_id)
    return None if i is None else shard.document(i)


def read_tokens(spark: SparkSession, folder: str, arrays: bool = True) -> DataFrame:
    """Documents of a folder of token files: doc_id, start, n_tokens, ids_crc32, and their ids if arrays. Shards are dealt out one by one."""
    manifest, dictionary = read_manifest(folder)
    shared = spark.sparkContext.broadcast(dictionary)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * arrays

    def run(batches):
        fs, root = filesystem(folder)
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                shard = Shard(fs, f"{root}/{name}", shared.value)
                starts, ids = start + np.cumsum(shard.counts) - shard.counts, shard.ids
                for i, lot in shard.runs():
                    j = i + len(lot)
                    if [len(x) for x in lot] != shard.counts[i:j].tolist():
                        raise ValueError(f"{name}: the index and the frames differ")
                    cols = [pa.array(ids[i:j], pa.int64()), pa.array(starts[i:j], pa.int64()), pa.array(shard.counts[i:j], pa.int64()), pa.array([zlib.crc32(x.astype("<u4")) for x in lot], pa.int64())]
                    if arrays:
                        cols.append(pa.array([x.astype(np.int64) for x in lot], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    rows = [(s["name"], s["start"]) for s in manifest["shards"]]
    files = spark.createDataFrame(rows, "name string, start long")
    return (files.repartition(max(1, len(rows))) if rows else files).mapInArrow(run, schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{workspace(spark, 'tokens')}/files"
    write_tokens(read_table(spark, sf_dir, "documents"), folder, default_tokenizer(), 0)
    return read_tokens(spark, folder, arrays=False)


QUERIES = {"op8_token_files": op8_token_files}
ORACLE: dict[str, str] = {}
