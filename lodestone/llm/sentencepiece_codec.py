"""SentencePiece encoding with original byte spans, and decoding.

Normalisation walks the compiled character map of the model (a double-array trie of source strings and the texts that
replace them): at each place the longest entry wins, else one character passes as it is. Every normalised byte keeps the
original byte at which it ends, so each piece projects to a span of original bytes; spans tile the text.

Encoding: a normalised text is cut before each run of space marks. No piece of the vocabulary has a mark behind another
character (checked when a model is loaded; else whole texts are encoded), so no merge crosses a cut, and equal parts have
equal pieces. Parts are looked up in a table; unknown ones go to the sentencepiece library in batches. The table
keeps two generations of TABLE_BYTES each and no part over LONG characters, which bounds a worker's memory.

Null texts read as empty: no piece but the end id. Repeated rows and ties are encoded alike; a text of any length is
encoded whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from sentencepiece import sentencepiece_model_pb2

from lodestone.llm.common import kept, lean_batches, read_table

MARK = "▁"
#: Bytes the table holds in each of its two generations, an entry counted with PER_ENTRY bytes of Python's own; longer parts
#: than LONG characters are not kept.
TABLE_BYTES, PER_ENTRY, LONG = 140 << 20, 420, 64


class CharMap:
    """The compiled character map: longest-prefix replacement over UTF-8 bytes."""

    def __init__(self, blob: bytes):
        self.units, self.texts = (), b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes consumed, replacement) of the longest entry that data has at offset at."""
        if not self.units:
            return None
        node, best = 0, None
        jump = lambda u: (u >> 10) << ((u & 0x200) >> 6)
        node ^= jump(self.units[0])
        for i in range(at, len(data)):
            if not data[i]:
                break
            node ^= data[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= jump(unit)
            if unit & 0x100:
                value = self.units[node] & 0x7FFFFFFF
                best = (i + 1 - at, self.texts[value : self.texts.index(b"\0", value)])
        return best


class Codec:
    """A model with its character map, for texts of one worker."""

    def __init__(self, path: str, table_bytes: int = TABLE_BYTES):
        self.most, self.held = table_bytes, 0
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        self.map = CharMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        self.eos = self.sp.eos_id()
        self.pieces = [p.piece.encode() for p in proto.pieces]
        for i, p in enumerate(proto.pieces):
            if p.type == p.BYTE:
                self.pieces[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type == p.CONTROL:
                self.pieces[i] = b""
        apart = not any(p.type == p.NORMAL and MARK in p.piece.lstrip(MARK) for p in proto.pieces) and not any(p.type == p.USER_DEFINED for p in proto.pieces)
        #: Parts may be encoded one by one, and the library's own normalisation of a part gives the part itself.
        self.by_part = apart and self.dummy and self.escape and not self.squeeze and not self.suffix and not self.map.units
        self.bytes_in = {i for i, p in enumerate(proto.pieces) if p.type == p.BYTE}
        mark = MARK.encode()
        self.piece_text = ["" if i in self.bytes_in else x.replace(mark, b" ").decode("utf-8", "replace") for i, x in enumerate(self.pieces)]
        self.piece_size = [len(x) if i in self.bytes_in else len(x) - 2 * x.count(mark) for i, x in enumerate(self.pieces)]
        self.piece_id = [str(i) for i in range(len(self.pieces))]
        self.table: dict[str, tuple[bytes, str, bytes, str]] = {}
        self.before: dict[str, tuple[bytes, str, bytes, str]] = {}

    # -- normalisation

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for 0..n of them the original byte offset at which that many bytes end."""
        data, out, ends = text.encode(), bytearray(), [0]
        mark = MARK.encode() if self.escape else b" "
        put = lambda new, start, end: (out.extend(new), ends.extend([start] * (len(new) - 1) + [end]))
        if not data:
            return b"", np.zeros(1, np.int64)
        units = []
        i = 0
        while i < len(data):
            if (hit := self.map.longest(data, i)) is not None:
                units.append((hit[1], i, i + hit[0], False))
                i += hit[0]
            else:
                n = 1 if data[i] < 0x80 else 2 if data[i] < 0xE0 else 3 if data[i] < 0xF0 else 4
                units.append((data[i : i + n], i, i + n, True))
                i += n
        begin = 0
        if self.squeeze:
            while begin < len(units) and units[begin][0] == b" ":
                begin += 1
        at = units[begin][1] if begin < len(units) else len(data)
        ends[0] = at
        if self.dummy and not self.suffix and begin < len(units):
            put(mark, at, at)
        spaced = self.squeeze
        for new, a, b, same in units[begin:]:
            if self.squeeze:
                if spaced:
                    new = new.lstrip(b" ")
                if new:
                    spaced = new.endswith(b" ")
            if not new:
                ends[-1] = b
            elif same and new != b" ":
                out += new
                ends.extend(range(a + 1, b + 1))
            else:
                put(new.replace(b" ", mark), a, b)
        if self.squeeze:
            while out.endswith(mark):
                del out[-len(mark) :]
                del ends[-len(mark) :]
        if self.dummy and self.suffix:
            put(mark, len(data), len(data))
        return bytes(out), np.array(ends, np.int64)

    # -- encoding

    def _entry(self, ids: list[int]) -> tuple[bytes, str, bytes, str]:
        """ids packed; ids as text; original byte lengths of the pieces; the pieces' text."""
        if self.bytes_in.isdisjoint(ids):
            text = "".join(map(self.piece_text.__getitem__, ids))
        else:
            text = b"".join([self.pieces[i] if i in self.bytes_in else self.piece_text[i].encode() for i in ids]).decode("utf-8", "replace")
        return array("i", ids).tobytes(), " ".join(map(self.piece_id.__getitem__, ids)), array("i", map(self.piece_size.__getitem__, ids)).tobytes(), text

    def look_up(self, parts: list[str]) -> list[tuple[bytes, str, bytes, str]]:
        """The entries of parts (texts behind one space mark); unknown ones go to the library together, then into the table."""
        table, before, lacking = self.table, self.before, {}
        for p in parts:
            if p not in table:
                lacking[p] = before.get(p)
        new = [p for p, e in lacking.items() if e is None]
        # A mark alone, as behind a last space: the library adds no mark to an empty text.
        ids = [x or [self.sp.piece_to_id(MARK)] for x in self.sp.encode(new, num_threads=1)]
        lacking.update(zip(new, map(self._entry, ids), strict=True))
        found = [table[p] if p in table else lacking[p] for p in parts]
        for p, e in lacking.items():
            if len(p) <= LONG:
                self.held += PER_ENTRY + len(e[0]) + len(e[1]) + len(e[2]) + 3 * len(p)
                table[p] = e
        if self.held > self.most:
            self.before, self.table, self.held = table, {}, 0
        return found

    def parts(self, text: str) -> list[str]:
        """A text cut before its runs of space marks; the mark that begins each part is left out."""
        if MARK in text or "  " in text or text[:1] == " " or text[-1:] == " ":
            return [p[1:].replace(MARK, " ") for p in re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))]
        return text.split(" ")

    def encode(self, text: str) -> tuple[list[tuple[bytes, str, bytes, str]], np.ndarray | None]:
        """The entries of a text's parts, and its alignment where lengths alone do not give it."""
        if not text:
            return [], None
        if not self.by_part:
            pieces = self.sp.encode(text, out_type="proto").pieces
            ids = [p.id for p in pieces]
            sizes = [1 if p.id in self.bytes_in else len(p.piece.encode()) for p in pieces]
            whole = (array("i", ids).tobytes(), " ".join(map(str, ids)), array("i", sizes).tobytes(), self.sp.decode(ids))
            return [whole], self.normalise(text)[1]
        parts = self.parts(text)
        try:
            found = list(map(self.table.__getitem__, parts))
        except KeyError:
            found = self.look_up(parts)
        return found, self.normalise(text)[1] if MARK in text else None

    def spans(self, found: list, ends: np.ndarray | None) -> np.ndarray:
        """The original byte offset at which each piece ends; it begins where the one before it ends.

        Raises if the pieces do not make up the normalised text: the own normalisation must be the library's.
        """
        if not found:
            return np.zeros(0, np.int64)
        if ends is not None:
            if self.by_part:
                sizes = [len(self.pieces[i]) for i in np.frombuffer(b"".join([x[0] for x in found]), "i")]
            else:
                sizes = np.frombuffer(found[0][2], "i")
            at = np.cumsum(sizes, dtype=np.int64)
            if (int(at[-1]) if len(at) else 0) != len(ends) - 1:
                raise ValueError(f"pieces of {int(at[-1]) if len(at) else 0} bytes for a normalised text of {len(ends) - 1}")
            return ends[at]
        at = np.cumsum(np.frombuffer(b"".join([x[2] for x in found]), "i"), dtype=np.int64)
        return np.maximum(at - 1, 0) if self.dummy else at  # the mark put before the text has no original byte

    def decoded(self, found: list) -> str:
        text = "".join([x[3] for x in found])
        if self.by_part and self.dummy and text[:1] == " ":
            text = text[1:]
        return text


def codec(path: str, table_bytes: int = TABLE_BYTES) -> Codec:
    return kept(("pieces", path, table_bytes), lambda: Codec(path, table_bytes))


#: What encode_documents can return for each document. ids: end id last; ends: the original byte at which each piece but
#: the end id ends; the digests are of the decimal ids joined by one space, and of the decoded text.
COLUMNS = {
    "ids": ("array<int>", pa.list_(pa.int32())),
    "ends": ("array<long>", pa.list_(pa.int64())),
    "decoded": ("string", pa.string()),
    "n_tokens": ("long", pa.int64()),
    "ids_sha256": ("string", pa.string()),
    "decoded_sha256": ("string", pa.string()),
    "covered_bytes": ("long", pa.int64()),
    "ends_crc32": ("long", pa.int64()),
}


def encode_documents(docs: DataFrame, model: str, columns: tuple[str, ...] = ("ids", "ends", "decoded"), keep: tuple[str, ...] = (), table_bytes: int = TABLE_BYTES) -> DataFrame:
    """doc_id, the columns of docs named in keep, and the named COLUMNS, for each row of docs (doc_id, text).

    Digests are made where the arrays are, so that these need not leave the worker.
    """
    lean_batches(docs.sparkSession)
    carried = docs.select("doc_id", *keep).schema

    def run(batches):
        c = codec(model, table_bytes)
        end = str(c.eos)
        for batch in batches:
            out: dict[str, list] = {name: [] for name in columns}
            for text in batch.column(0).to_pylist():
                found, align = c.encode(text or "")
                ends = c.spans(found, align)
                back = c.decoded(found)
                for name, values in out.items():
                    match name:
                        case "ids":
                            values.append(np.append(np.frombuffer(b"".join([x[0] for x in found]), "i"), np.int32(c.eos)))
                        case "ends":
                            values.append(ends)
                        case "decoded":
                            values.append(back)
                        case "n_tokens":
                            values.append(len(ends) + 1)
                        case "ids_sha256":
                            values.append(hashlib.sha256(" ".join([*[x[1] for x in found], end]).encode()).hexdigest())
                        case "decoded_sha256":
                            values.append(hashlib.sha256(back.encode()).hexdigest())
                        case "covered_bytes":
                            values.append(int(ends[-1]) if len(ends) else 0)
                        case "ends_crc32":
                            values.append(zlib.crc32(ends.astype("<i8")))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *[pa.array(v, COLUMNS[n][1]) for n, v in out.items()]], names=[*batch.schema.names[1:], *columns])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in carried.fields], *[f"{n} {COLUMNS[n][0]}" for n in columns]])
    return docs.select(docs["text"], docs["doc_id"], *[docs[k] for k in keep]).mapInArrow(run, schema)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read_table(spark, sf_dir, "documents"), default_model(), ("n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes", "ends_crc32"))


QUERIES = {"op10_sentencepiece": op10_sentencepiece}
ORACLE: dict[str, str] = {}
