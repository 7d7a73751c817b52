"""Token ids in sorted-string-table shards.

A shard file: data blocks, sparse block index, Bloom filter, footer. Documents stand in ascending order of their key
(a byte that tells a null id, the id's eight bytes in signed order, four bytes that tell rows of one id apart). A block
holds entries (shared prefix length, rest length, value length as varints; key rest; value) up to BLOCK bytes, is
compressed and carries a checksum; an entry's key shares its prefix with the one before. The index names each block's last
key, offset and length. A value is the ids as little-endian unsigned integers of the width in the footer.

A lookup asks the Bloom filter, binary-searches the index and reads one block.

Defined results: a null or empty text is the end id alone; documents without an id come first; rows that repeat an id
follow one another in the order of their texts; an empty table gives an empty table. Columns besides the two named ones
are ignored.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import struct
import uuid
import zlib
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_dir, tune
from .token_counts import byte_symbols

MAGIC = b"GLSST\x00\x01\n"
BLOCK = 256 << 10
BLOOM_BITS, BLOOM_HASHES = 10, 7
FOOTER = struct.Struct("<QQQQQQIBx")
#: Fixed value: the byte-level pre-tokenizer's pattern.
BYTE_LEVEL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same for texts without two white spaces in a row, where a match of white space needs no look at what follows it.
BYTE_LEVEL_APART = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
#: Latin-1, with each white space as a blank.
BLANKS = bytes(32 if c in b"\t\n\v\f\r\x85\xa0" else c for c in range(256))
#: Pieces that a worker keeps with their ids; beyond it new ones aren't kept.
MAX_PIECES = 600_000


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = raw[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def make_key(doc_id: int | None, seq: int = 0) -> bytes:
    return (b"\0" + bytes(8) if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))) + struct.pack(">I", seq)


def split_key(key: bytes) -> tuple[int | None, int]:
    return (struct.unpack(">Q", key[1:9])[0] - (1 << 63) if key[0] else None), struct.unpack(">I", key[9:])[0]


class Bloom:
    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def _places(stem: bytes, n: int) -> list[int]:
        h = xxhash.xxh64_intdigest(stem, 7)
        a, b = h & 0xFFFFFFFF, h >> 32 | 1
        return [(a + i * b) % n for i in range(BLOOM_HASHES)]

    @classmethod
    def of(cls, stems: list[bytes]) -> Bloom:
        n = max(64, len(stems) * BLOOM_BITS + 7 & ~7)
        flags = np.zeros(n, bool)
        for s in stems:
            flags[cls._places(s, n)] = True
        return cls(np.packbits(flags))

    def __contains__(self, stem: bytes) -> bool:
        return all(self.bits[i >> 3] & (128 >> (i & 7)) for i in self._places(stem, len(self.bits) * 8))


class Writer:
    """Write entries in ascending key order, then close()."""

    def __init__(self, fs: pafs.FileSystem, path: str, width: int = 2):
        self.out, self.path, self.width, self.at = fs.open_output_stream(path), path, width, 0
        self.block, self.size, self.last, self.index, self.stems, self.tokens, self.docs = [], 0, b"", [], [], 0, 0
        self.pack = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.docs and key <= self.last:
            raise ValueError("keys must ascend")
        if len(ids) and int(ids.max()) >> 8 * self.width:
            raise ValueError(f"id {int(ids.max())} needs more than {self.width} bytes")
        shared = len(os.path.commonprefix([self.last, key])) if self.block else 0
        value = ids.astype(f"<u{self.width}").tobytes()
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.block.append(entry)
        self.size += len(entry)
        self.last = key
        if not self.stems or self.stems[-1] != key[:9]:
            self.stems.append(key[:9])
        self.tokens += len(ids)
        self.docs += 1
        if self.size >= BLOCK:
            self._flush()

    def _put(self, raw: bytes) -> tuple[int, int]:
        packed = self.pack.compress(raw)
        packed += struct.pack("<I", zlib.crc32(packed))
        self.out.write(packed)
        at, self.at = self.at, self.at + len(packed)
        return at, len(packed)

    def _flush(self) -> None:
        if self.block:
            self.index.append((self.last, *self._put(b"".join(self.block))))
            self.block, self.size = [], 0

    def close(self) -> None:
        self._flush()
        index = self._put(b"".join(_varint(len(k)) + k + struct.pack("<QI", at, n) for k, at, n in self.index))
        bloom = self._put(Bloom.of(self.stems).bits.tobytes())
        self.out.write(FOOTER.pack(*index, *bloom, self.docs, self.tokens, len(self.index), self.width) + MAGIC)
        self.out.close()


class Reader:
    def __init__(self, path: str):
        fs, p = _open(path)
        self.f = fs.open_input_file(p)
        self.f.seek(self.f.size() - FOOTER.size - len(MAGIC))
        raw = self.f.read()
        if raw[FOOTER.size :] != MAGIC:
            raise ValueError(f"{path} isn't a token shard")
        ia, il, ba, bl, self.docs, self.tokens, n, self.width = FOOTER.unpack(raw[: FOOTER.size])
        raw, at = self._get(ia, il), 0
        self.keys, self.blocks = [], []
        for _ in range(n):
            k, at = _read_varint(raw, at)
            self.keys.append(raw[at : at + k])
            self.blocks.append(struct.unpack_from("<QI", raw, at + k))
            at += k + 12
        self._bloom = ba, bl

    def _get(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        raw = self.f.read(n)
        if len(raw) != n or struct.unpack("<I", raw[-4:])[0] != zlib.crc32(raw[:-4]):
            raise ValueError("a damaged block")
        return zstandard.ZstdDecompressor().decompress(raw[:-4])

    def entries(self, k: int):
        raw, at, key = self._get(*self.blocks[k]), 0, b""
        while at < len(raw):
            shared, at = _read_varint(raw, at)
            rest, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield key, np.frombuffer(raw, f"<u{self.width}", size // self.width, at)
            at += size

    def __iter__(self):
        for k in range(len(self.blocks)):
            yield from self.entries(k)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every row with this doc_id."""
        stem, out = make_key(doc_id)[:9], []
        if stem not in Bloom(np.frombuffer(self._get(*self._bloom), np.uint8)):
            return out
        for k in range(bisect.bisect_left(self.keys, stem), len(self.keys)):
            for key, ids in self.entries(k):
                if key[:9] == stem:
                    out.append(ids)
                elif key[:9] > stem:
                    return out
        return out


class Encoder:
    """Ids of whole texts by the tokenizers library, with its ids of recurring pieces kept.

    A byte-level pre-tokenizer never joins what stands on both sides of the start of " word", so a text may be encoded
    piece by piece there; a piece's pre-tokens go to the library's model. Texts with white space before another blank's
    white space, or with special strings, go to the library whole, as does every text under another pre-tokenizer.
    """

    WHOLE = re.compile(r"\s (?:\s|\Z)|<\|")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.pieces = Tokenizer.from_file(path), {}
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            self.spec = spec = json.load(f)
        self.ranked = False  # not made yet
        kind = spec["pre_tokenizer"] or {}
        self.by_piece = spec["normalizer"] is None and kind.get("type") == "ByteLevel" and kind.get("use_regex") and not kind.get("add_prefix_space")
        self.byte = {b: s for b, s in enumerate(byte_symbols())}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        piece = " " + piece
        out = array("I")
        for pre in (piece,) if piece[1:].isalpha() else BYTE_LEVEL.findall(piece):
            out.extend([t.id for t in self.model.tokenize(pre.encode().decode("latin-1").translate(self.byte))])
        return out.tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        cut = [None if not self.by_piece or self.WHOLE.search(t) else t.split(" ") for t in texts]
        heads = iter(self._library([t if c is None else c[0] for c, t in zip(cut, texts, strict=True)]))
        pieces, out = self.pieces, []
        for c in cut:
            if not c:
                out.append(next(heads))
                continue
            rest, new = c[1:], []
            for p in set(rest).difference(pieces):
                pieces[p] = self._piece(p)
                new.append(p)
            out.append(next(heads) + b"".join(map(pieces.__getitem__, rest)))
            if len(pieces) > MAX_PIECES:  # what came first is what recurs most
                for p in new:
                    del pieces[p]
        return out


    def _ranked(self, spec: dict):
        """The same BPE with tokens ranked by their merges, for counts alone: for texts without two white spaces in a row, and
        for any; None where it isn't sure to give the library's.

        It joins what makes the token of lowest rank, whichever two tokens that is made of, where the library joins the two
        its merge names. Inside what becomes a token both join alike until two neighbours are left. So they agree
        if every token comes of one merge, and the library gives every token for its own symbols.
        """
        import tiktoken

        vocab, raw = spec["model"]["vocab"], {s: bytes([b]) for b, s in self.byte.items()}
        merged = ["".join(m.split(" ")) if isinstance(m, str) else "".join(m) for m in spec["model"]["merges"]]
        tokens = [*raw, *merged]
        special = {t["content"] for t in spec["added_tokens"]}
        if not self.by_piece or spec["model"].get("ignore_merges") or len(set(tokens)) < len(tokens) or set(tokens) != set(vocab) - special:
            return None
        if any([x.id for x in self.model.tokenize(t)] != [vocab[t]] for t in tokens):
            return None
        ranks = {b"".join(raw[c] for c in t): k for k, t in enumerate(tokens)}
        return [tiktoken.Encoding("counts", pat_str=p, mergeable_ranks=ranks, special_tokens={"<|": len(ranks)}) for p in (BYTE_LEVEL_APART, BYTE_LEVEL.pattern)]

    def count(self, texts: list[str]) -> list[int]:
        """How many ids each text has. Texts of Latin-1 letters, whose classes no version of Unicode changes, go the ranked way."""
        if self.ranked is False:
            self.ranked = self._ranked(self.spec)
        out, left = [0] * len(texts), []
        for k, t in enumerate(texts):
            if self.ranked is None or "<|" in t or (raw := _latin(t)) is None:
                left.append(k)
            else:
                apart, other = self.ranked
                out[k] = len((other if b"  " in raw.translate(BLANKS) else apart).encode_to_numpy(t, disallowed_special=()))
        for k, e in zip(left, self.tokenizer.encode_batch_fast([texts[k] for k in left], add_special_tokens=False), strict=True):
            out[k] = len(e)
        return out


def _latin(text: str) -> bytes | None:
    try:
        return text.encode("latin-1")
    except UnicodeEncodeError:
        return None


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_shards(docs: DataFrame, path: str, vocabulary: str, end_id: int, width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int, int]]:
    """Encode and write the shards under path, in ascending doc_id order over all of them: [(file, docs, tokens)] in that order.

    Documents are dealt by ranges of doc_id; a task writes one file under a name of its own and reports it, so
    files of lost or repeated tasks are never read. Only these reports, a row a file, come to the driver.
    """
    spark = docs.sparkSession
    tune(spark)

    def run(batches):
        fs, root = _open(path)
        fs.create_dir(root)
        writer, last, seq, first = None, object(), 0, None
        for b in batches:
            ids = b.column(0).to_pylist()
            for doc, raw in zip(ids, encoder(vocabulary).encode([t or "" for t in b.column(1).to_pylist()]), strict=True):
                if writer is None:
                    name, first = f"{uuid.uuid4().hex}.sst", doc
                    writer = Writer(fs, f"{root}/{name}", width)
                seq = seq + 1 if doc == last else 0
                last = doc
                writer.add(make_key(doc, seq), np.append(np.frombuffer(raw, "<u4"), np.uint32(end_id)))
        if writer is not None:
            writer.close()
            yield pa.record_batch([pa.array([name]), pa.array([first], pa.int64()), pa.array([writer.docs], pa.int64()), pa.array([writer.tokens], pa.int64())], ["file", "first", "docs", "tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    done = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, "file string, first long, docs long, tokens long").collect()
    done.sort(key=lambda r: (r["first"] is not None, r["first"] or 0))
    return [(r["file"], r["docs"], r["tokens"]) for r in done]


def read_shards(spark: SparkSession, path: str, files: list[tuple[str, int, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the shards; start counts the ids before it over all of them."""
    base, named = 0, []
    for name, _, tokens in files:
        named.append((name, base))
        base += tokens
    sent = spark.sparkContext.broadcast(named)

    def run(batches):
        for b in batches:
            for k in b.column(0).to_pylist():
                name, start = sent.value[k]
                rows = []
                for key, ids in Reader(f"{path}/{name}"):
                    rows.append((split_key(key)[0], start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                for at in range(0, len(rows), 10_000):
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows[at : at + 10_000], strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = len(named)
    return spark.range(0, n, 1, max(1, n)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_dir(spark, "shards")
    files = write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_shards(spark, path, files)
