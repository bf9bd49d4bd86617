"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Fingerprints that differ in at most 4 of 64 bits agree in at least 4 of their 8 positional bytes. Every four of the
eight positions include one of the 20 triples below (two groups of positions are joined in a ring of three), so the
index has 20 postings of three positional bytes per distinct fingerprint, and pairs that meet in a posting list are
tallied (equal positional bytes), kept if the tally reaches 4, and verified by their differing bits. Posting lists
are read in sorted runs; only links of a spanning forest of each list leave it, so groups of copies don't make
pairs. A long list is split by each further positional byte, one more of which its close pairs share; what is long
even then is cut into blocks, and each pair of blocks is one group of work.

``keep_similar`` finds documents with a Jaccard similarity of their five-word shingles of 0.8 or more. No distance
in bits guarantees that, and SimHashes of the shingles themselves are about 9 of 64 bits apart at 0.8, so its
fingerprints are wider (128 bits) and taken over the distinct words, of which far fewer change; pairs in a list (three
equal positional bytes) within 20 bits make candidate groups, and within a group the similarity of whole shingle sets
decides (exact, not estimated). Measured recall is in the README.

Defined cases: a null or empty text, or one without words, has fingerprint zero and is linked like any other; texts
with fewer words than a shingle are one shingle; repeated rows share their doc_id's component; a null doc_id gets a
row with null doc_id and the component of its fingerprint (null if no other); of ties the smallest doc_id, then the
smallest text hash, stays; very long texts are taken whole; an empty table gives an empty result; extra columns are
not read (``keep_one`` and ``keep_similar`` return them).
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm.common import checked_broadcast, components, packed, release, scratch
from corvid.llm.paragraphs import chain, jaccard_forest, words
from corvid.llm.suffixes import mix

SHINGLE = 4
BITS = 4
SEED = 42
#: Of ``keep_similar``: words of a shingle, least similarity, most differing bits of its wide fingerprints.
WORDS, SIMILAR, APART = 5, 0.8, 20
#: Shingles that a task compares at once; larger candidate groups are cut into blocks.
COMPARED = 1 << 21
#: Members of a posting list above which it is cut into blocks of this size.
BLOCK = 4096
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Positions dealt into three groups; a triple lies within a group or has two of one group and one of the next.
GROUPS = ((0, 1, 2), (3, 4, 5), (6, 7))


def triples() -> list[tuple[int, int, int]]:
    """Sets of three byte positions such that every set of four contains one."""
    group = {p: g for g, ps in enumerate(GROUPS) for p in ps}
    found = []
    for t in itertools.combinations(range(8), 3):
        n = [sum(group[p] == g for p in t) for g in range(3)]
        if 3 in n or any(n[g] == 2 and n[(g + 1) % 3] == 1 for g in range(3)):
            found.append(t)
    return found


TRIPLES = triples()
#: For 16 positional bytes: each position is in as many triples as any other, no two positions in more than two.
WIDE_TRIPLES = [tuple(sorted((k, (k + 1) % 16, (k + 3) % 16))) for k in range(16)] + [tuple(sorted((k, (k + 4) % 16, (k + 9) % 16))) for k in range(0, 16, 2)]


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash: a bit is set if it is set in over half of the shingles' XXH64 hashes."""
    import xxhash

    words = (text or "").encode().translate(LOWER).split()  # at \x20 and \x09 to \x0D
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= size:
        return h(b" ".join(words), seed)
    hashes = np.fromiter((h(b" ".join(w), seed) for w in zip(*(words[k:] for k in range(size)))), np.uint64, len(words) - size + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << k for k in range(64) if 2 * counts[k] > len(hashes)))


def fingerprints(docs: DataFrame, size: int = SHINGLE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and fp, the fingerprint's bits as a signed long."""
    names = list(keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema) + ", fp long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), size) for t in b.column("_text")), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(fp)], names=[*names, "fp"])

    return docs.select(*names, F.col("text").alias("_text")).mapInArrow(run, schema)


def near(x: np.ndarray, most: int) -> np.ndarray:
    """Of rows of XORed fingerprints: those with enough equal positional bytes (the tally), verified by their bits."""
    tally = (np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1) == 0).sum(axis=1)
    out = tally >= max(3, 8 * x.shape[1] - most)
    out[out] = np.bitwise_count(x[out].view(np.uint64)).sum(axis=1) <= most
    return out


def forest(fp: np.ndarray, most: int) -> tuple[list, list]:
    """Links of a spanning forest of one list's members: each member looks once for those not yet reached."""
    left, us, vs = np.arange(len(fp)), [], []
    while len(left):
        stack, left = [int(left[0])], left[1:]
        while stack and len(left):
            i = stack.pop()
            hit = near(fp[left] ^ fp[i], most)
            if hit.any():
                new = left[hit]
                us += [i] * len(new)
                vs += new.tolist()
                stack += new.tolist()
                left = left[~hit]
    return us, vs


def list_links(key: np.ndarray, node: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the posting lists of ``key`` (sorted): pairs at once in short lists, a forest in longer ones."""
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    sizes = np.diff(edge)
    us, vs = [], []
    short = np.repeat(sizes <= 8, sizes)
    for shift in range(1, 8):
        i = np.flatnonzero((key[shift:] == key[:-shift]) & short[shift:])
        if not len(i):
            break
        i = i[near(fp[i] ^ fp[i + shift], most)]
        us.append(node[i])
        vs.append(node[i + shift])
    for k in np.flatnonzero(sizes > 8):
        part = node[edge[k] : edge[k + 1]]
        a, b = forest(fp[edge[k] : edge[k + 1]], most)
        us.append(part[a])
        vs.append(part[b])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *us]), np.concatenate([none, *vs])


def links(nodes: DataFrame, most: int = BITS, width: int = 1, triples: list[tuple[int, int, int]] = TRIPLES) -> DataFrame:
    """Links (u, v) such that components are those of all close pairs that share a triple of positional bytes.

    ``nodes`` has distinct rows of a node (long) and, unless the node is its fingerprint, the ``width`` longs of that.
    """
    names = nodes.columns
    node, fps = names[0], names[-width:]
    byte = lambda p: F.shiftright(fps[p // 8], 8 * (p % 8)).bitwiseAND(F.lit(255))
    keys = [
        F.lit(k << 24).bitwiseOR(F.shiftleft(byte(a), 16)).bitwiseOR(F.shiftleft(byte(b), 8)).bitwiseOR(byte(c)).cast("long") for k, (a, b, c) in enumerate(triples)
    ]
    postings = nodes.select(F.explode(F.array(*keys)).alias("key"), *names)

    def matrix(columns) -> np.ndarray:
        return np.column_stack([c.to_numpy(zero_copy_only=False) for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 1 + len(names)), np.int64)

        def out(rows: np.ndarray) -> pa.RecordBatch:
            u, v = list_links(rows[:, 0], rows[:, 1], rows[:, -width:], most)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for b in batches:
            held = np.r_[held, matrix(b.columns)]
            if len(held) < 2 * BLOCK:
                continue
            end = int(np.searchsorted(held[:, 0], held[-1, 0]))  # the last list may go on
            yield out(held[:end])
            held = held[end:]
        if len(held):
            yield out(held)

    def within(lists: DataFrame) -> DataFrame:
        return lists.repartition("key").sortWithinPartitions("key").mapInArrow(run, "u long, v long")

    def longs(lists: DataFrame) -> DataFrame | None:
        found = scratch(lists.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK), "long-lists")
        return None if found.isEmpty() else found

    if (long := longs(postings)) is None:
        return within(postings)
    found = within(postings.join(long, "key", "left_anti"))
    rest = postings.join(long.select("key"), "key")
    if width == 1 and 8 - most > 3:  # a close pair shares a further byte
        inside = F.get(F.array(*(F.array(*map(F.lit, t)) for t in triples)), F.shiftright("key", 24).cast("int"))
        every = F.array(*(F.struct(F.lit(p).alias("p"), byte(p).alias("b")) for p in range(8)))
        rest = rest.withColumn("_p", F.explode(F.filter(every, lambda x: ~F.array_contains(inside, x["p"]))))
        rest = rest.select(F.xxhash64("key", "_p.p", "_p.b").alias("key"), *names)
        if (long := longs(rest)) is None:
            return found.union(within(rest))
        found = found.union(within(rest.join(long, "key", "left_anti")))
    blocks = rest.join(long, "key").withColumn("_blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    blocks = blocks.withColumn("_own", F.pmod(F.xxhash64(node), F.col("_blocks")).cast("int"))
    blocks = blocks.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return found.union(within(blocks.select(F.xxhash64("key", F.least("_own", "_other"), F.greatest("_own", "_other")).alias("key"), *names)))


def classes(fps: DataFrame, most: int = BITS) -> DataFrame:
    """Rows (fp, class_fp) for every distinct fingerprint of ``fps``."""
    distinct = scratch(fps.select("fp").distinct(), "simhash-distinct")
    found = components(links(distinct, most), "simhash-links")
    return distinct.join(found, distinct.fp == found.node, "left").select("fp", F.coalesce("component", "fp").alias("class_fp"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, most: int = BITS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of its class)."""
    fps = scratch(fingerprints(docs, size), "simhash")
    byfp = classes(fps, most)
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("_least"))
    member = scratch(byfp.join(least, "fp"), "simhash-classes")
    named = member.groupBy("class_fp").agg(F.min("_least").alias("component_id"))
    member = member.join(named, "class_fp").select("fp", "component_id")
    return fps.join(member, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def rows_of(docs: DataFrame) -> tuple[DataFrame, list]:
    """``docs`` packed and with _row, which orders documents: doc_id (nulls last), then the text's hash."""
    row = F.struct(F.col("doc_id").isNull().alias("n"), F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").alias("i"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("t"))
    slim, columns = packed(docs, "doc_id", "text")
    return slim.withColumn("_row", row), columns


def only(keyed: DataFrame, rows: DataFrame, stay: DataFrame) -> DataFrame:
    """Of ``keyed`` one row for each _row of ``stay``; ``rows`` has the _row of every row.

    Texts move only if too many rows go for a broadcast.
    """
    odd = rows.groupBy("_row").agg(F.count("*").alias("n")).join(stay.withColumn("stays", F.lit(True)), "_row", "left")
    odd = scratch(odd.filter("stays is null or n > 1"), "rows-that-go")
    repeated = odd.filter("stays").select("_row")
    again = keyed.join(checked_broadcast(repeated), "_row", "left_semi").dropDuplicates(["_row"])
    return keyed.join(checked_broadcast(odd.select("_row")), "_row", "left_anti").union(again)


def keep_one(docs: DataFrame, size: int = SHINGLE, most: int = BITS) -> DataFrame:
    """``docs`` with one document of each class of fingerprints."""
    keyed, columns = rows_of(docs)
    fps = scratch(fingerprints(keyed, size, keep=("_row",)), "simhash")
    least = fps.groupBy("fp").agg(F.min("_row").alias("_row")).join(classes(fps, most), "fp")
    stay = least.groupBy("class_fp").agg(F.min("_row").alias("_row")).select("_row")
    return only(keyed, fps.select("_row"), stay).select(*columns)


def word_print(text: str | None) -> tuple[int, int, int]:
    """A hash of the word sequence, and a 128-bit SimHash of the distinct words as two longs; zeros without words."""
    _, _, h = words((text or "").encode().translate(LOWER))
    if not len(h):
        return 0, 0, 0
    name = int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little", signed=True)
    h = np.unique(h)
    counts = np.zeros(128, np.int64)
    for at in range(0, len(h), 1 << 15):
        part = h[at : at + (1 << 15)]
        both = np.column_stack([mix(part), mix(part ^ np.uint64(0x5851F42D4C957F2D))])
        counts += np.unpackbits(both.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return (name, *np.packbits(2 * counts > len(h)).view(np.int64).tolist())


def word_prints(keyed: DataFrame) -> DataFrame:
    """Rows (_row, node, f0, f1)."""
    schema = f"_row {keyed.schema['_row'].dataType.simpleString()}, node long, f0 long, f1 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([word_print(t.as_py()) for t in b.column(1)], np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(found[:, k]) for k in range(3))], names=["_row", "node", "f0", "f1"])
        release()

    return keyed.select("_row", F.col("text").alias("_text")).mapInArrow(run, schema)


def similar_links(sets: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Links (u, v) of a spanning forest of the similar sets of each group; ``sets``: rows (group, node, shingles)."""
    sizes = sets.groupBy("group").agg(F.sum(F.size("shingles")).alias("_n")).withColumn("_blocks", F.ceil(F.col("_n") / COMPARED).cast("int"))
    large = scratch(sizes.filter("_blocks > 1").select("group", "_blocks"), "large-groups")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(table: pa.Table) -> pa.RecordBatch:
            group, node = (table.column(c).to_numpy() for c in ("group", "node"))
            sets = [np.asarray(x) for x in table.column("shingles").to_numpy()]
            edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
            us, vs = [], []
            for lo, hi in zip(edge, edge[1:]):
                a, b = jaccard_forest(sets[lo:hi], similar)
                us += node[lo:hi][a].tolist()
                vs += node[lo:hi][b].tolist()
            return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

        size = 0
        for b in batches:
            for at in range(0, b.num_rows, 64):
                held.append(b.slice(at, 64))
                size += len(held[-1].column("shingles").flatten())
                if size < COMPARED:
                    continue
                table = pa.Table.from_batches(held)
                end = int(np.searchsorted(table.column("group").to_numpy(), table.column("group")[-1].as_py()))
                if end:  # the last group may go on
                    yield out(table.slice(0, end))
                    held = table.slice(end).to_batches()
                    size = sum(len(x.column("shingles").flatten()) for x in held)
        if held:
            yield out(pa.Table.from_batches(held))
        release()

    rows = sets.select("group", "node", "shingles")
    if not large.isEmpty():  # each pair of blocks of a large group is a group
        blocks = rows.join(large, "group").withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
        blocks = blocks.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        blocks = blocks.select(F.xxhash64("group", F.least("_own", "_other"), F.greatest("_own", "_other")).alias("group"), "node", "shingles")
        rows = rows.join(large, "group", "left_anti").union(blocks)
    return rows.repartition("group").sortWithinPartitions("group").mapInArrow(run, "u long, v long")


def similar_classes(keyed: DataFrame, prints: DataFrame, size: int = WORDS, similar: float = SIMILAR) -> DataFrame:
    """Rows (node, component) of the texts that are similar to another one."""
    distinct = scratch(prints.select("node", "f0", "f1").distinct(), "word-prints")
    groups = scratch(components(links(distinct, APART, 2, WIDE_TRIPLES), "candidates"), "candidate-groups")
    one = scratch(prints.join(groups, "node").groupBy("node", "component").agg(F.min("_row").alias("_row")), "candidate-rows")

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                _, _, h = words((b.column(2)[at].as_py() or "").encode().translate(LOWER))
                found = np.unique(chain(h, min(size, max(len(h), 1)))).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(at, 1) for k in (0, 1)), pa.array([found], pa.list_(pa.int64()))], names=["group", "node", "shingles"])
        release()

    rows = keyed.select("_row", F.col("text").alias("_text")).join(checked_broadcast(one), "_row")
    sets = rows.select(F.col("component").alias("group"), "node", "_text").mapInArrow(shingles, "group long, node long, shingles array<long>")
    return components(similar_links(scratch(sets, "shingles"), similar), "similar")


def keep_similar(docs: DataFrame, size: int = WORDS, similar: float = SIMILAR) -> DataFrame:
    """``docs`` with one document of each class of similar texts (and of equal word sequences)."""
    keyed, columns = rows_of(docs)
    prints = scratch(word_prints(keyed), "word-prints")
    found = similar_classes(keyed, prints, size, similar)
    least = prints.groupBy("node").agg(F.min("_row").alias("_row")).join(found, "node", "left")
    stay = least.groupBy(F.coalesce("component", "node").alias("c")).agg(F.min("_row").alias("_row")).select("_row")
    return only(keyed, prints.select("_row"), stay).select(*columns)
