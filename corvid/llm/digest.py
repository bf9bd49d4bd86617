"""Improbable-feature digests of documents.

Method: every 64-byte window of a text is ranked by how unusual its entropy is; a window that is the rarest of
enough neighbourhoods is a feature. Features go into a chain of Bloom filters, each closed after 160 features.
Two digests are compared filter by filter: the overlap of bits beyond what chance gives, over what is possible.

All steps are local and in whole numbers, so texts are worked on together in buffers and long ones in pieces,
with the same result. Defined cases: a null text is empty, its digest has no filter, and two such are alike (1.0);
short texts, and those without any feature, are digested by all their 8-byte windows; equal texts have equal
digests; documents are ordered by descending doc_id (null last), rows of one doc_id by text; a table of one row
has itself as next; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 64
POPULARITY = 16
PER_FILTER = 160
FILTER_BITS = 2048
#: Entropy of a window in thousandths of the highest possible; the usual value in prose, and the least that counts.
USUAL, LEAST = 690, 100
#: Texts of fewer bytes, and those without features, are digested by windows of this many bytes.
SHORT, SHORT_WINDOW = 128, 8
PIECE = 1 << 18
#: Documents per range of ids that are worked through in order.
RUN = 1000
SCALE = 1 << 16
_N = np.arange(WINDOW + 1)
_F = np.round(SCALE * _N * np.log2(np.maximum(_N, 1))).astype(np.int32)
#: What a further byte of a value adds to the sum of count * log2(count), by the count before.
GAIN = np.r_[_F[1:] - _F[:-1], 0].astype(np.int32)


def features(buffer: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Starts of the feature windows in a buffer of at most 2**20 bytes; ``valid`` marks windows that may count."""
    n, top = len(buffer), np.int32((1 << 11) - 1)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for lag in range(1, WINDOW):
        same = (buffer[lag:] == buffer[:-lag]).view(np.uint8)
        before[lag:] += same
        after[:-lag] += same
    change = GAIN[before]
    change[WINDOW:] -= GAIN[after[:-WINDOW]]
    total = np.cumsum(change, dtype=np.int32)[WINDOW - 1 :]  # of the window that starts here
    most = int(SCALE * WINDOW * 6)
    entropy = ((most - total.astype(np.int64)) * 1000 // most).astype(np.int32)
    rank = np.where(valid & (entropy >= LEAST), 1000 - np.abs(entropy - USUAL), top).astype(np.int32)
    key = (rank << 20) | np.arange(len(rank), dtype=np.int32)
    width = 1
    while width < WINDOW:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    key = key[(key >> 20) < top]
    votes = np.bincount(key & ((1 << 20) - 1), minlength=len(rank))
    return np.flatnonzero(votes >= POPULARITY)


def mixed(rows: np.ndarray) -> np.ndarray:
    """64-bit hashes of the rows of a byte matrix (width a multiple of 8)."""
    words = np.ascontiguousarray(rows).view(np.uint64)
    h = np.full(len(words), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(words.shape[1]):
        h = (h ^ words[:, k]) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(29))


def feature_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """Hashes of each text's features, in order, each once."""
    found: list[list[np.ndarray]] = [[] for _ in texts]
    margin, ahead = WINDOW, 2 * WINDOW
    pad = bytes(WINDOW)
    parts, places, size = [pad], [], WINDOW

    def flush():
        nonlocal parts, places, size
        if places:
            buffer = np.frombuffer(b"".join(parts), np.uint8)
            valid = np.zeros(len(buffer) - WINDOW + 1, bool)
            for _, at, n, _, _ in places:
                valid[at : at + max(0, n - WINDOW + 1)] = True
            starts = features(buffer, valid)
            rows = np.lib.stride_tricks.sliding_window_view(buffer, WINDOW)[starts]
            hashes = mixed(rows) if len(starts) else np.empty(0, np.uint64)
            for who, at, _, lo, hi in places:
                a, b = np.searchsorted(starts, (at + lo, at + hi))
                found[who].append(hashes[a:b])
        parts, places, size = [pad], [], WINDOW

    for who, text in enumerate(texts):
        if len(text) < SHORT:
            continue
        for start in range(0, len(text), PIECE):
            lo, hi = max(0, start - margin), min(len(text), start + PIECE + ahead)
            places.append((who, size, hi - lo, start - lo, min(start + PIECE, len(text)) - lo))
            parts += [text[lo:hi], pad]
            size += hi - lo + WINDOW
            if size > PIECE:
                flush()
    flush()
    out = []
    for text, hashes in zip(texts, found):
        h = np.concatenate([np.empty(0, np.uint64), *hashes])
        if not len(h) and text:
            padded = text.ljust(SHORT_WINDOW, b"\0")
            h = mixed(np.lib.stride_tricks.sliding_window_view(np.frombuffer(padded, np.uint8), SHORT_WINDOW))
        _, first = np.unique(h, return_index=True)
        out.append(h[np.sort(first)])
    return out


class Digest:
    """A chain of Bloom filters."""

    def __init__(self, hashes: np.ndarray):
        n = self.n = len(hashes)
        bits = np.zeros(-(-n // PER_FILTER) * FILTER_BITS, bool)
        base = np.arange(n) // PER_FILTER * FILTER_BITS
        for k in range(5):
            bits[base + ((hashes >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
        self.bits = bits.reshape(-1, FILTER_BITS)
        self.packed = np.packbits(self.bits, axis=1)

    def text(self) -> str:
        return f"{len(self.packed)}:{self.n}:{self.packed.tobytes().hex()}"


def likeness(a: Digest, b: Digest) -> float:
    """0 to 1: for the filters of the smaller digest the best normalised overlap in the other, averaged."""
    if a.n == b.n and a.packed.tobytes() == b.packed.tobytes():
        return 1.0
    if not a.n or not b.n:
        return 0.0
    if (a.n, a.packed.tobytes()) > (b.n, b.packed.tobytes()):
        a, b = b, a
    x, total = b.bits.astype(np.float32), 0.0
    nb = x.sum(axis=1)
    for at in range(0, len(a.bits), 64):
        y = a.bits[at : at + 64].astype(np.float32)
        na = y.sum(axis=1)[:, None]
        best = np.full(len(y), 0.0)
        for bt in range(0, len(x), 512):
            overlap, chance = y @ x[bt : bt + 512].T, na * nb[bt : bt + 512] / FILTER_BITS
            room = np.maximum(np.minimum(na, nb[bt : bt + 512]) - chance, 1e-9)
            best = np.maximum(best, np.clip(((overlap - chance) / room - 0.1) / 0.9, 0, 1).max(axis=1))
        total += float(best.sum())
    return round(total / len(a.bits), 6)


def digests(texts: list[bytes]) -> list[Digest]:
    return [Digest(h) for h in feature_hashes(texts)]


def fingerprints(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, fingerprint)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                out = [d.text() for d in digests([(t or "").encode() for t in part.column(1).to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (_run, _guest, doc_id, text) in ranges of ids, each range followed by the next range's first document.

    The texts are shuffled once. The ranges' first ids (one for about RUN rows) come to the driver.
    """
    low = -(1 << 63)
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(low)).alias("_id"))
    n, top = ids.agg(F.count("*"), F.max("_id")).first()
    if not n:
        return docs.select(F.lit(0).alias("_run"), F.lit(False).alias("_guest"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    cuts = min(n // RUN, 4096)
    firsts = ids.agg(F.percentile_approx("_id", [k / (cuts + 1) for k in range(1, cuts + 1)], 100_000)).first()[0] if cuts else []
    firsts = sorted({*firsts, top}, reverse=True)
    own = F.col("_id")
    run = F.size(F.filter(F.array(*map(F.lit, firsts)), lambda x: x >= own)) - 1
    first = F.array_contains(F.array(*map(F.lit, firsts)), own)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(low)).alias("_id"), F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_own", run)
    host = F.when(F.col("_own") > 0, F.col("_own") - 1).otherwise(F.lit(len(firsts) - 1))
    place = lambda r, g: F.struct(r.alias("r"), F.lit(g).alias("g"))
    mine = place(F.col("_own"), False)
    rows = rows.withColumn("_at", F.explode(F.when(first, F.array(mine, place(host, True))).otherwise(F.array(mine))))
    rows = rows.select(F.col("_at.r").alias("_run"), F.col("_at.g").alias("_guest"), "_id", "doc_id", "text")
    return rows.repartition("_run").sortWithinPartitions("_run", "_guest", F.desc("_id"), "text").drop("_id")


def compare_edited(docs: DataFrame) -> DataFrame:
    """Every document, its text with the last third replaced by the start of the next document's, and likenesses."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def work(rows: list[tuple], then: str) -> pa.RecordBatch:
        """``rows`` (doc_id, text) in order; ``then`` is the text after the last."""
        texts = [t for _, t in rows] + [then]
        edited = []
        for t, nxt in zip(texts, texts[1:]):
            k = len(t) // 3
            edited.append((t[: len(t) - k] + nxt[:k]).encode())
        both = digests([t.encode() for t in texts] + edited)
        own, changed = both[: len(texts)], both[len(texts) :]
        columns = [
            [i for i, _ in rows],
            [len(t) for _, t in rows],
            [hashlib.sha256(e).hexdigest() for e in edited],
            [d.text() for d in own[:-1]],
            [d.text() for d in changed],
            [likeness(a, b) for a, b in zip(own, changed)],
            [likeness(a, b) for a, b in zip(own, own[1:])],
        ]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now, closed, size = None, False, 0
        for b in batches:
            for run_, guest, i, t in zip(*(c.to_pylist() for c in b.columns)):
                if run_ != now:
                    now, closed, held, size = run_, False, [], 0
                if closed:
                    continue  # further rows of the guest's doc_id
                if guest:
                    yield work(held, t or "")
                    held, closed = [], True
                    continue
                held.append((i, t or ""))
                size += len(t or "")
                if len(held) > 1 and (len(held) > 100 or size > 1_000_000):
                    yield work(held[:-1], held[-1][1])
                    held, size = held[-1:], len(held[-1][1])

    return with_next(docs).mapInArrow(run, schema)
