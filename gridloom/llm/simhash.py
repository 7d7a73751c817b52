"""SimHash near-dedup: Golay-code fuzzy hashing of fingerprints, join, verify, components.

A fingerprint's 64 bits are cut into segments of 22, 21 and 21 bits, each a word of the Golay code (23, 12, 7).
If two fingerprints differ in at most 4 bits, then a segment is equal in both, or every segment has an error and two
of the three have exactly one (1 + 1 + 2 or fewer). In the first case they share the key of that exact segment. In the
second, one side gives for each of two segments all codeword indices that the segment or a neighbour of it decodes to
(up to six), the other side the index its own segment decodes to: as the segments are neighbours, a pair of indices is
shared. So no link is lost, and every candidate is verified.

Defined results: a null or empty text, or one without words, has fingerprint zero and is linked like any other; rows that
repeat a doc_id each get a row; a row without doc_id keeps a fingerprint and has a null component, and links nothing;
an empty table gives an empty table. Columns besides the two named ones are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import golay
from .common import keep, tune
from .components import components

WIDTHS, RADIUS = (22, 21, 21), 4
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: LOWER, with each white space as a blank.
PLAIN = bytes(32 if c in b"\t\n\v\f\r" else LOWER[c] for c in range(256))
#: Bytes that are hashed at once, and the words that a sum of sixteen bits can hold.
PORTION, MOST_WORDS = 1 << 20, 65_535
#: XXH64's primes.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Bits of each byte value, least significant first.
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, size: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the text's word shingles, with repeats; 0 without words."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    line, n = b" ".join(words), max(1, len(words) - size + 1)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.concatenate(([0], end[:-1] + 1))
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter([h(line[i:j], seed) for i, j in zip(start[:n].tolist(), end[-n:].tolist(), strict=True)], np.uint64, n)
    by = hashes.astype("<u8").view(np.uint8).reshape(n, 8)
    if n > 64:
        ones = np.concatenate([np.bincount(by[:, k], minlength=256) @ BYTE_BITS for k in range(8)])
    else:
        ones = np.unpackbits(by, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _rotate(x: np.ndarray, r: int) -> np.ndarray:
    high = x >> np.uint64(64 - r)
    x <<= np.uint64(r)
    x |= high
    return x


def _lane(x: np.ndarray, before: np.ndarray | np.uint64 = np.uint64(0)) -> np.ndarray:
    out = x * P2
    out += before
    _rotate(out, 31)
    out *= P1
    return out


def xxh64_at(eight: np.ndarray, at: np.ndarray, size: int, seed: int) -> np.ndarray:
    """XXH64 of the size bytes from each place in at on; eight has, for each place, the eight bytes from there on as a number."""

    def whole(*parts: int) -> np.uint64:
        return np.uint64(sum(map(int, parts)) % (1 << 64))

    if size < 32:
        h = np.full(len(at), whole(seed, P5, size))
    else:
        lanes = [whole(seed, P1, P2), whole(seed, P2), whole(seed), whole(seed, -int(P1))]
        for _ in range(size // 32):
            for k in range(4):
                lanes[k] = _lane(eight[at], lanes[k])
                at = at + 8
        h = sum(_rotate(x.copy(), r) for x, r in zip(lanes, (1, 7, 12, 18), strict=True))
        for x in lanes:
            h ^= _lane(x)
            h *= P1
            h += P4
        h += np.uint64(size)
    for _ in range(size % 32 // 8):
        h ^= _lane(eight[at])
        _rotate(h, 27)
        h *= P1
        h += P4
        at = at + 8
    if left := size % 8:
        rest = eight[at]
        if left >= 4:
            h ^= (rest & np.uint64(0xFFFFFFFF)) * P1
            _rotate(h, 23)
            h *= P2
            h += P3
            rest >>= np.uint64(32)
        for _ in range(left % 4):
            h ^= (rest & np.uint64(0xFF)) * P5
            _rotate(h, 11)
            h *= P1
            rest >>= np.uint64(8)
    h ^= h >> np.uint64(33)
    h *= P2
    h ^= h >> np.uint64(29)
    h *= P3
    h ^= h >> np.uint64(32)
    return h


def _portion(lines: list[bytes], n_words: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Fingerprints of lines of n_words words with one blank between: shingles of equal length are hashed together."""
    raw = np.frombuffer(b" ".join(lines) + b" " + bytes(8), np.uint8)
    blank = np.flatnonzero(raw == 32)
    eight = np.ndarray(len(raw) - 8, "<u8", raw, strides=(1,)).astype(np.uint64)
    n = np.maximum(n_words - size + 1, 1)
    at = np.cumsum(n) - n
    word = np.arange(n.sum()) + np.repeat(np.cumsum(n_words) - n_words - at, n)
    start = np.where(word > 0, blank[word - 1] + 1, 0)
    length = blank[word + np.repeat(np.minimum(size, n_words) - 1, n)] - start
    order = np.argsort(length.astype(np.uint16) if length.max() < 1 << 16 else length, kind="stable")
    start, length = start[order], length[order]
    ends = [*(np.flatnonzero(np.diff(length)) + 1).tolist(), len(start)]
    h = np.empty(len(start), np.uint64)
    h[order] = np.concatenate([xxh64_at(eight, start[a:b], int(length[a]), seed) for a, b in zip([0, *ends], ends, strict=False)])
    out = np.zeros(len(lines), np.uint64)
    for k in range(16):  # bits k, k + 16, k + 32 and k + 48, each counted in sixteen bits
        ones = np.add.reduceat(h >> np.uint64(k) & np.uint64(0x0001000100010001), at)
        for j in range(k, 64, 16):
            out |= (2 * (ones >> np.uint64(j - k) & np.uint64(0xFFFF)).astype(np.int64) > n).astype(np.uint64) << np.uint64(j)
    return out


def fingerprint_batch(texts: list[str | None], size: int = 4, seed: int = 42) -> np.ndarray:
    """fingerprint() of each text, of many texts at once; those too long for it go one by one."""
    out = np.zeros(len(texts), np.uint64)
    rows, lines, counts, total = [], [], [], 0

    def flush() -> None:
        if rows:
            out[rows] = _portion(lines, np.array(counts), size, seed)
            for x in (rows, lines, counts):
                x.clear()

    for k, t in enumerate(texts):
        line = (t or "").encode().translate(PLAIN).strip(b" ")
        if b"  " in line:
            line = b" ".join(line.split())
        n = line.count(b" ") + 1
        if not line:
            continue
        if len(line) > PORTION or n > MOST_WORDS:
            out[k] = fingerprint(t, size, seed)
            continue
        if total + len(line) > PORTION:
            flush()
            total = 0
        rows.append(k)
        lines.append(line)
        counts.append(n)
        total += len(line)
    flush()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, seed: int = 42, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp) and the extra columns of docs: fp is the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, size, seed) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0), pa.array(fps), *b.columns[2:]], ["doc_id", "fp", *extra])

    tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *extra)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, ", ".join([f"doc_id {kinds['doc_id']}, fp long", *(f"{c} {kinds[c]}" for c in extra)]))


def _segments(fp: np.ndarray) -> list[np.ndarray]:
    out, at, u = [], 0, fp.view(np.uint64)
    for w in WIDTHS:
        out.append(((u >> np.uint64(at)) & np.uint64((1 << w) - 1)).astype(np.int64))
        at += w
    return out


def key_table(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fp, key, side) rows: side 0 looks keys up, side 1 is looked up, side 2 does both."""
    seg = _segments(fps)
    plain = [golay.decode(s) for s in seg]
    wide = [golay.decode_near(s, w) for s, w in zip(seg, WIDTHS, strict=True)]
    who, key, side = [], [], []
    for k in range(3):
        who.append(fps)
        key.append((np.int64(k) << 24) | seg[k])
        side.append(np.full(len(fps), 2, np.int8))
    for k, (i, j) in enumerate(((0, 1), (0, 2), (1, 2)), 3):
        (a, na), (b, nb) = wide[i], wide[j]
        full = (np.int64(k) << 24) | (a[:, :, None].astype(np.int64) << 12) | b[:, None, :]
        valid = (np.arange(6)[None, :, None] < na[:, None, None]) & (np.arange(6)[None, None, :] < nb[:, None, None])
        row = np.nonzero(valid)[0]
        who += [fps[row], fps]
        key += [full[valid], (np.int64(k) << 24) | (plain[i].astype(np.int64) << 12) | plain[j]]
        side += [np.zeros(len(row), np.int8), np.ones(len(fps), np.int8)]
    return np.concatenate(who), np.concatenate(key), np.concatenate(side)


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) with a < b: every pair of the distinct fingerprints (fp) that differ in at most radius <= 4 bits."""
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"the keys guarantee a radius of {RADIUS}")

    def run(batches):
        for b in batches:
            who, key, side = key_table(b.column(0).to_numpy())
            for at in range(0, len(who), 100_000):
                yield pa.record_batch([pa.array(x[at : at + 100_000]) for x in (who, key, side)], ["fp", "key", "side"])

    keys = keep(distinct.select("fp").mapInArrow(run, "fp long, key long, side byte"), "golay-keys")
    left, right = keys.where("side <> 1").select("key", F.col("fp").alias("x")), keys.where("side <> 0").select("key", F.col("fp").alias("y"))
    pairs = left.join(right.hint("shuffle_hash"), "key").where((F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= radius) & (F.col("x") != F.col("y")))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, seed: int = 42, radius: int = RADIUS, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, component_id) and the extra columns of docs (but those with one of these three names, which stand for themselves):
    component_id is the smallest doc_id reachable over links of radius bits or less."""
    names = {c: f"extra_{i}" for i, c in enumerate(extra) if c not in ("doc_id", "fp", "component_id")}
    told = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    fps = keep(fingerprints(told, "doc_id", "text", size, seed, tuple(names.values())), "fps")
    least = keep(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first")), "fp-first")
    links = fingerprint_links(least, radius)
    named = links.join(least.select(F.col("fp").alias("a"), F.col("first").alias("da")), "a").join(least.select(F.col("fp").alias("b"), F.col("first").alias("db")), "b")
    found = components(named.select(F.col("da").alias("a"), F.col("db").alias("b")))
    roots = least.join(found.withColumnRenamed("node", "first"), "first", "left").select("fp", F.coalesce("root", "first").alias("component_id"))
    out = fps.join(roots, "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), *[F.col(n).alias(c) for c, n in names.items()])


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
