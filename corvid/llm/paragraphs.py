"""Substring dedup: paragraph MinHash banding.

Paragraphs are lines of at least 25 words, and shorter lines in a row that make 25 words together; a document of
under 50 words is a paragraph as a whole, too (under 25 words, it is compared by its word sequence). Their sets of five-word shingles get MinHash signatures in 8 bands of 3
rows: a pair of Jaccard similarity 0.8 meets in a band with probability 0.997. Distinct paragraphs that collide are
verified by their exact Jaccard similarity, linked within their bucket by a spanning forest, and components become
clusters. For passages anywhere in a document, within or across lines, runs of 16 words at winnowed places (the least
three-word hash of 24 in a row) are paragraphs of their own with one band, the run itself; any passage of 50 words
holds one. A shared run is extended word by word, on each side as far as some earlier document with the run goes on
alike, up to 23 words; the runs of a passage are so close that their extensions meet and make up all of it. Of each
cluster the first document (by doc_id) keeps its text, the other documents lose theirs.

Texts are compared in lower case (A-Z). Defined cases: a null text is empty; what
repeats only within a document stays; a null doc_id comes last; texts with equal (doc_id, text) are one document;
an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm.common import components, scratch, texts_of
from corvid.llm.suffixes import _UP, PIECE, Hashes, keyed, merged, mix, pair, slide

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 8, 3
LEAST = 25
LONG, SEGMENT, GRAM, RUN = 50, 16, 3, 24
#: Words looked at on each side of a shared run; beyond, the passage holds another run.
REACH = RUN - 1
#: Distinct paragraphs of a bucket above which it is cut into blocks of this size.
BLOCK = 2048
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MULTIPLY = np.random.default_rng(11).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, byte after and hash of each word."""
    buffer = np.frombuffer(data, np.uint8)
    inside = np.r_[False, ~_SPACE[buffer], False]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    h, i = np.empty(len(start), np.uint64), 0
    while i < len(start):
        j = int(np.searchsorted(end, start[i] + PIECE, "right"))
        if j <= i:  # a word longer than a piece
            h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
            i += 1
            continue
        h[i:j] = Hashes(buffer[start[i] : end[j - 1]]).of(start[i:j] - start[i], end[i:j] - start[i])
        i = j
    return start, end, h


def chain(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each ``n`` in a row."""
    out, have = h, 1
    while have < n:
        step = min(have, n - have)
        # the next stretch starts where this one ends, or overlaps it
        out = pair(out[: len(out) - step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


def lines_of(data: bytes, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and word after of each line with words."""
    feed = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    line = np.searchsorted(feed, start)
    first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]][: len(line)])
    return first, np.r_[first[1:], len(line)][: len(first)]


def joined(a: np.ndarray, b: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lines as paragraphs: short lines in a row of one text (``of``) are one."""
    short = b - a < LEAST
    first = np.flatnonzero(np.r_[True, ~(short[1:] & short[:-1]) | (of[1:] != of[:-1])][: len(a)])
    return a[first], np.r_[a[first[1:]], b[-1:]][: len(first)]


def beside(h: np.ndarray, da: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit names of the (up to) ``REACH`` words before and after each run; texts begin at the words ``da``."""
    gaps = np.repeat(np.r_[da, len(h)], REACH)  # no word of one text stands beside one of another
    names = (chain(np.insert(h, gaps, np.uint64(0)), REACH) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    at = run + REACH * np.searchsorted(da, run, "right")
    return names[at - REACH], names[at + SEGMENT]


def units(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Columns who, start, end (bytes), kind (0 paragraph, 1 run or tiny text), uid, left and right (names of the words
    beside a run, else 0) and bands (kind 1 has none)."""
    data = b"\n".join(texts).translate(_LOWER)
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
    start, end, h = words(data)
    a, b = lines_of(data, start)
    text = np.searchsorted(begin, start, "right") - 1
    a, b = joined(a, b, text[a])
    da = np.flatnonzero(np.r_[True, text[1:] != text[:-1]][: len(text)])
    db = np.r_[da[1:], len(text)][: len(da)]
    tiny = db - da < LEAST
    # a short text is a paragraph besides those in it, unless it is one of them
    small = ~tiny & (db - da < LONG) & (b[np.searchsorted(a, da)] != db)
    big = b - a >= LEAST
    pa_, pb = np.r_[a[big], da[small]], np.r_[b[big], db[small]]
    order = np.argsort(pa_, kind="stable")
    pa_, pb = pa_[order], pb[order]
    whole = np.empty(len(pa_), np.uint64)
    raw = np.frombuffer(data, np.uint8)
    reach = np.maximum.accumulate(end[pb - 1])
    i = 0
    while i < len(pa_):
        j = max(i + 1, int(np.searchsorted(reach, start[pa_[i]] + PIECE, "right")))
        lo, hi = start[pa_[i]], reach[j - 1]
        if hi - lo > PIECE:
            whole[i] = int.from_bytes(hashlib.blake2b(data[lo:hi], digest_size=8).digest(), "little")
        else:
            whole[i:j] = Hashes(raw[lo:hi]).of(start[pa_[i:j]] - lo, end[pb[i:j] - 1] - lo)
        i = j
    shingles = chain(h, SHINGLE)
    bands = np.empty((len(pa_), BANDS), np.uint64)
    if len(pa_):
        cuts = np.ravel(np.column_stack([pa_, pb - SHINGLE + 1]))
        padded = np.r_[shingles, np.uint64(0)]  # a cut may be after the last
        least = [np.minimum.reduceat((padded ^ (m >> np.uint64(7))) * m, cuts)[::2] for m in _MULTIPLY]
        for k in range(BANDS):
            name = np.full(len(pa_), k + 1, np.uint64)
            for m in least[k * ROWS : (k + 1) * ROWS]:
                name = pair(name, m)
            bands[:, k] = name
    grams = mix(chain(h, GRAM))
    run = np.empty(0, np.int64)
    long = db - da >= RUN + GRAM - 1
    if long.any() and len(grams) >= RUN:
        low = slide(grams, RUN, np.minimum)
        ok, fits = np.zeros(len(low) + 1, np.int32), np.zeros(len(h) + 1, np.int32)
        np.add.at(ok, da[long], 1)
        np.add.at(ok, np.minimum(db[long] - RUN - GRAM + 2, len(low)), -1)
        np.add.at(fits, da[long], 1)
        np.add.at(fits, db[long] - SEGMENT + 1, -1)
        low[np.cumsum(ok)[:-1] == 0] = 0
        top = slide(np.r_[np.zeros(RUN - 1, np.uint64), low, np.zeros(RUN - 1, np.uint64)], RUN, np.maximum)
        run = np.flatnonzero((top == grams[: len(top)]) & (top > 0) & (np.cumsum(fits)[: len(top)] > 0))
    ta, tb = da[tiny], db[tiny]
    place = np.arange(len(h)) - np.repeat(da, db - da)
    inside = np.repeat(tiny, db - da)
    tiny_uid = np.zeros(0, np.uint64)
    if len(ta):
        sums = np.add.reduceat(h[inside] * _UP[place[inside]], np.flatnonzero(place[inside] == 0))
        tiny_uid = pair(mix(sums), (tb - ta).astype(np.uint64))
    s = np.r_[start[pa_], start[run], start[ta]]
    e = np.r_[end[pb - 1], end[run + SEGMENT - 1], end[tb - 1]]
    who = np.searchsorted(begin, s, "right") - 1
    uid = np.r_[whole, chain(h, SEGMENT)[run] if len(run) else np.empty(0, np.uint64), tiny_uid]
    kind = np.r_[np.zeros(len(pa_), np.int32), np.ones(len(run) + len(ta), np.int32)]
    left, right = beside(h, da, run) if len(run) else (np.zeros(0, np.int32),) * 2
    around = lambda x: np.r_[np.zeros(len(pa_), np.int32), x, np.zeros(len(ta), np.int32)]
    return {"left": around(left), "right": around(right), "who": who, "start": (s - begin[who]).astype(np.int32), "end": (e - begin[who]).astype(np.int32), "kind": kind, "uid": uid.view(np.int64), "bands": bands.view(np.int64)}


def slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that are worked on together."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        if k > at and size + len(t) > PIECE:
            yield at, k
            at, size = k, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def unit_table(docs: DataFrame) -> DataFrame:
    """Rows (key, doc, start, end, kind, uid, left, right, bands)."""
    schema = "key long, doc long, start int, end int, kind int, uid long, left int, right int, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                key, doc = (part.column(k).to_numpy() for k in (0, 1))
                texts = [t.encode() for t in part.column(2).to_pylist()]
                for lo, hi in slices(texts):
                    u = units(texts[lo:hi])
                    if len(u["who"]):
                        who, n = u["who"] + lo, len(u["who"]) - len(u["bands"])
                        sizes = np.r_[np.full(len(u["bands"]), BANDS), np.zeros(n, np.int64)]
                        bands = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(u["bands"].ravel()))
                        columns = [pa.array(key[who]), pa.array(doc[who]), *(pa.array(u[c]) for c in ("start", "end", "kind", "uid", "left", "right")), bands]
                        yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

    last = F.lit((1 << 63) - 1)
    return keyed(docs).select("key", F.coalesce("doc_id", last).alias("doc"), "text").mapInArrow(run, schema)


def jaccard_forest(sets: list[np.ndarray], least: float = SIMILAR) -> tuple[list[int], list[int]]:
    """Links of a spanning forest of the sets with a Jaccard similarity of at least ``least``."""
    size = np.array([len(s) for s in sets])
    flat, left, us, vs = np.concatenate(sets), np.arange(len(sets)), [], []
    begin = np.cumsum(size) - size
    while len(left):
        stack, left = [int(left[0])], left[1:]
        while stack and len(left):
            i = stack.pop()
            n = size[left]
            at = np.repeat(begin[left] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            both = np.add.reduceat(np.isin(flat[at], sets[i]).astype(np.int64), np.cumsum(n) - n)
            hit = both >= least * (n + size[i] - both) - 1e-9
            if hit.any():
                new = left[hit]
                us += [i] * len(new)
                vs += new.tolist()
                stack += new.tolist()
                left = left[~hit]
    return us, vs


def colliding(bands: DataFrame) -> DataFrame:
    """Distinct rows (band, uid) of the bands with more than one uid, read in sorted order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # band, uid, whether it was passed on
        for b in batches:
            band, uid = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            if not len(band):
                continue
            new = np.r_[last is None or (band[0], uid[0]) != last[:2], (band[1:] != band[:-1]) | (uid[1:] != uid[:-1])]
            band, uid = band[new], uid[new]
            if last is not None:
                band, uid = np.r_[last[0], band], np.r_[last[1], uid]
            same = band[1:] == band[:-1]
            out = np.r_[False, same] | np.r_[same, False]
            done = bool(out[-1]) or (last is not None and len(band) == 1 and last[2])
            if last is not None and last[2]:
                out[0] = False
                if len(band) > 1 and band[1] == band[0]:
                    out[1] = True
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(band[out]), pa.array(uid[out])], names=["band", "uid"])
            last = (band[-1], uid[-1], done)

    return bands.repartition("band").sortWithinPartitions("band", "uid").mapInArrow(run, "band long, uid long")


def links(docs: DataFrame, table: DataFrame, block: int = BLOCK) -> DataFrame:
    """Verified links (u, v) between distinct paragraphs."""
    paragraphs = table.filter("kind = 0")
    met = scratch(colliding(paragraphs.select(F.explode("bands").alias("band"), "uid")), "bands")
    place = F.min(F.struct("key", "start", "end"))
    some = paragraphs.join(met.select("uid").distinct(), "uid").groupBy("uid").agg(place.alias("p"))
    wanted = some.groupBy("p.key").agg(F.collect_list(F.struct("uid", "p.start", "p.end")).alias("wanted"))

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, rows in zip(b.column(2), b.column(3)):
                data = text.as_py().encode().translate(_LOWER)
                uids, sets = [], []
                for r in rows.as_py():
                    _, _, h = words(data[r["start"] : r["end"]])
                    uids.append(r["uid"])
                    sets.append(np.unique((chain(h, SHINGLE) >> np.uint64(32)).astype(np.uint32).view(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(sets, pa.list_(pa.int32()))], names=["uid", "shingles"])

    sets = texts_of(keyed(docs), scratch(wanted, "wanted")).select("key", "doc_id", "text", "wanted").mapInArrow(shingles, "uid long, shingles array<int>")
    large = scratch(met.groupBy("band").count().filter(F.col("count") > block), "large-bands")
    rows = met.join(sets, "uid")
    schema = "u long, v long"

    def verified(table: pa.Table) -> pa.RecordBatch:
        band, uid = (table.column(c).to_numpy() for c in ("band", "uid"))
        sets = [np.asarray(x) for x in table.column("shingles").to_numpy()]
        edge = np.flatnonzero(np.r_[True, band[1:] != band[:-1], True])
        us, vs = [], []
        for lo, hi in zip(edge, edge[1:]):
            a, b = jaccard_forest(sets[lo:hi])
            us += uid[lo:hi][a].tolist() if a else []
            vs += uid[lo:hi][b].tolist() if b else []
        return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) < block:
                continue
            table = pa.Table.from_batches(held)
            end = int(np.searchsorted(table.column("band").to_numpy(), table.column("band")[-1].as_py()))
            if end:
                yield verified(table.slice(0, end).combine_chunks())
            held = table.slice(end).to_batches()
        if held:
            yield verified(pa.Table.from_batches(held))

    if large.isEmpty():
        return rows.select("band", "uid", "shingles").repartition("band").sortWithinPartitions("band").mapInArrow(run, schema)
    # each pair of blocks of a large bucket is a bucket
    blocks = rows.join(large, "band").withColumn("_n", F.ceil(F.col("count") / block).cast("int"))
    blocks = blocks.withColumn("_a", F.pmod(F.xxhash64("uid"), F.col("_n")).cast("int")).withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    blocks = blocks.select(F.xxhash64("band", F.least("_a", "_b"), F.greatest("_a", "_b")).alias("band"), "uid", "shingles")
    small = rows.join(large, "band", "left_anti").select("band", "uid", "shingles")
    return small.union(blocks).repartition("band").sortWithinPartitions("band").mapInArrow(run, schema)


def shared_runs(runs: DataFrame) -> DataFrame:
    """Of rows (uid, key, doc, start, end, left, right) those whose uid has more than one key.

    ``before`` and ``after`` tell whether an earlier document (by doc, key) has the same words beside the run, so that
    it can be extended over all of them. Rows are read in sorted order; of a uid that goes on in the next batch, its
    different neighbours are held.
    """
    names = ["uid", "key", "doc", "start", "end", "left", "right"]
    none = [np.empty(0, np.int64)] * 3 + [np.empty(0, np.int32)] * 4

    def known(uid: np.ndarray, key: np.ndarray, side: np.ndarray, seen: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Whether the first with the uid and this side has another key; which rows are the first ones. seen: rows
        of earlier batches."""
        uid, key, side = (np.r_[x, y] for x, y in zip(seen, (uid, key, side)))
        _, first, group = np.unique(pair(uid.view(np.uint64), side.view(np.uint32).astype(np.uint64)), return_index=True, return_inverse=True)
        n = len(seen[0])
        return (key[first][group] != key)[n:], first[first >= n] - n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = (none[0], none[1], none[5])
        held, goes_on, seen = none, None, [empty, empty]  # goes_on: the first uid, if it has several keys
        for b in [*batches, None]:
            if b is not None:
                held = [np.r_[x, c.to_numpy(zero_copy_only=False)] for x, c in zip(held, b.columns)]
            uid, key = held[0], held[1]
            if not len(uid):
                continue
            if goes_on != uid[0]:
                seen = [empty, empty]
            group = np.cumsum(np.r_[False, uid[1:] != uid[:-1]])
            other = np.r_[False, (key[1:] != key[:-1]) & (uid[1:] == uid[:-1])]
            several = np.bincount(group, weights=other) > 0
            several[0] |= goes_on == uid[0]
            keep = several[group]
            last = group == group[-1]
            sides = [known(uid, key, held[k], s) for k, s in zip((5, 6), seen)]
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (*held[:5], sides[0][0], sides[1][0])], names=[*names[:5], "before", "after"])
            if several[-1]:
                goes_on, fresh = uid[-1], group[-1] > 0
                for k, (_, first) in enumerate(sides):
                    first = first[last[first]]
                    now = uid[first], key[first], held[5 + k][first]
                    seen[k] = now if fresh else tuple(np.r_[x, y] for x, y in zip(seen[k], now))
                held = none
            else:  # these wait for more of their uid
                goes_on, held = None, [x[last] for x in held]

    schema = "uid long, key long, doc long, start int, end int, before boolean, after boolean"
    return runs.select(*names).repartition("uid").sortWithinPartitions("uid", "doc", "key").mapInArrow(run, schema)


def around(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """``runs`` extended over the words beside them where those are known from an earlier document; on the other sides
    with the hashes of the words (before, after; outwards) and the bytes that each adds (lo, hi)."""
    wanted = runs.groupBy("key", "doc").agg(F.sort_array(F.collect_set(F.struct("start", "end", "uid", "before", "after"))).alias("wanted"))
    schema = "uid long, key long, doc long, start int, end int, before array<int>, after array<int>, lo array<int>, hi array<int>"

    def lists(x: np.ndarray, at: np.ndarray, n: np.ndarray, step: int) -> pa.ListArray:
        """The ``n`` values from ``at`` on, in steps."""
        edge = np.r_[0, np.cumsum(n)]
        index = np.repeat(at, n) + step * (np.arange(edge[-1]) - np.repeat(edge[:-1], n))
        return pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(x[index]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                key, doc, text, rows = (b.column(k)[at] for k in range(4))
                first, last, h = words(text.as_py().encode().translate(_LOWER))
                short = (h >> np.uint64(32)).astype(np.uint32).view(np.int32)
                first, last = first.astype(np.int32), last.astype(np.int32)
                # bytes from a word's start to the next one's, from a word's end to the one's before
                ahead, behind = (np.diff(x, **{side: 0}).astype(np.int32) for x, side in ((first, "append"), (last, "prepend")))
                every = rows.values.flatten()
                for k in range(0, len(rows), 4096):
                    start, end, uid, left, right = (c.slice(k, 4096).to_numpy(zero_copy_only=False) for c in every)
                    a, z = np.searchsorted(first, start), np.searchsorted(last, end) + 1
                    before, after = np.minimum(a, REACH), np.minimum(len(h) - z, REACH)
                    start, end = np.where(left, first[a - before], start).astype(np.int32), np.where(right, last[z - 1 + after], end).astype(np.int32)
                    before, after = np.where(left, 0, before), np.where(right, 0, after)
                    n = len(a)
                    columns = [pa.array(uid), pa.array(np.full(n, key.as_py())), pa.array(np.full(n, doc.as_py())), pa.array(start), pa.array(end)]
                    columns += [lists(short, a - 1, before, -1), lists(short, z, after, 1), lists(ahead, a - 1, before, -1), lists(behind, z, after, 1)]
                    yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

    return texts_of(keyed(docs), scratch(wanted, "wanted")).select("key", "doc", "text", "wanted").mapInArrow(run, schema)


def alike(uid: np.ndarray, key: np.ndarray, words: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many of the ``n`` words of each row are those of an earlier row with the uid and another key."""
    out, at, name = np.zeros(len(uid), np.int64), np.arange(len(uid)), uid.view(np.uint64)
    for j in range(words.shape[1]):
        ok = n[at] > j
        at, name = at[ok], pair(name[ok], words[at[ok], j])
        _, first, group, count = np.unique(name, return_index=True, return_inverse=True, return_counts=True)
        out[at[key[at[first]][group] != key[at]]] = j + 1
        at, name = at[count[group] > 1], name[count[group] > 1]
        if not len(at):
            break
    return out


def extended(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """Shared runs (uid, key, doc, start, end) with start and end moved outwards as far as an earlier copy goes on.

    They are read in sorted order. Of a uid that goes on in the next batch, the different surroundings are held.
    """

    def table(lists: pa.ListArray, fill: type) -> tuple[np.ndarray, np.ndarray]:
        n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        out = np.zeros((len(n), REACH), fill)
        out[np.arange(REACH) < n[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
        return out, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = None, None  # uid, key, words before and how many, after and how many; the row before this batch
        for b in batches:
            if not b.num_rows:
                continue
            uid, key, doc, start, end = (b.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            # of rows repeated in full one is taken
            place = np.column_stack([uid, key, start])
            new = np.r_[last is None or (place[0] != last).any(), (place[1:] != place[:-1]).any(axis=1)]
            last = place[-1]
            if not new.any():
                continue
            (before, n), (after, m), (lo, _), (hi, _) = (table(b.column(k), t) for k, t in ((5, np.int32), (6, np.int32), (7, np.int64), (8, np.int64)))
            lo, hi = lo.cumsum(axis=1), hi.cumsum(axis=1)
            now = [x[new] for x in (uid, key, before, n, after, m)]
            old = 0 if held is None else len(held[0])
            every = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            wide = lambda x: x.view(np.uint32).astype(np.uint64)
            left, right = (alike(every[0], every[1], wide(every[k]), every[k + 1])[old:] for k in (2, 4))
            uid, key, doc, start, end, lo, hi = (x[new] for x in (uid, key, doc, start, end, lo, hi))
            row = np.arange(len(uid))
            start = (start - np.where(left > 0, lo[row, np.maximum(left, 1) - 1], 0)).astype(np.int32)
            end = (end + np.where(right > 0, hi[row, np.maximum(right, 1) - 1], 0)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (uid, key, doc, start, end)], names=["uid", "key", "doc", "start", "end"])
            stay = np.flatnonzero(every[0] == uid[-1])
            context = np.ascontiguousarray(np.column_stack([*(every[k][stay] for k in (2, 4)), every[3][stay], every[5][stay]]))
            stay = stay[np.sort(np.unique(context.view(f"V{context.shape[1] * context.itemsize}").ravel(), return_index=True)[1])]
            held = [x[stay] for x in every]

    rows = around(docs, runs).repartition("uid").sortWithinPartitions("uid", "doc", "key", "start")
    return rows.mapInArrow(run, "uid long, key long, doc long, start int, end int")


def repeats(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The units whose cluster is in several documents: rows (key, start, end, cluster, first)."""
    table = scratch(unit_table(docs), "units")
    found = components(links(docs, table, block), "paragraph-links")
    rows = table.filter("kind = 0").select("uid", "key", "doc", "start", "end").union(extended(docs, scratch(shared_runs(table.filter("kind = 1")), "shared-runs")))
    named = rows.join(found.withColumnRenamed("node", "uid"), "uid", "left").withColumn("cluster", F.coalesce("component", "uid")).drop("component")
    named = scratch(named, "clusters")
    of = named.groupBy("cluster").agg(F.min("doc").alias("_doc"), F.min("key").alias("_low"), F.max("key").alias("_high")).filter("_low <> _high")
    several = named.join(of, "cluster")
    # of documents with one doc_id the least key is first
    first = several.filter("doc = _doc").groupBy("cluster").agg(F.min("key").alias("_key"))
    return several.join(first, "cluster").select("key", "start", "end", "cluster", (F.col("key") == F.col("_key")).alias("first"))


def lists_of(found: DataFrame) -> DataFrame:
    return found.groupBy("key").agg(
        F.count("*").alias("n_linked"),
        F.count_if(~F.col("first")).alias("n_removed"),
        F.collect_set(F.when(~F.col("first"), F.shiftleft(F.col("start").cast("long"), 32).bitwiseOR(F.col("end").cast("long")))).alias("spans"),
        F.sort_array(F.collect_set("cluster")).alias("clusters"),
    )


def report(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per document, without its text: doc_id, n_linked (units with a copy in another document), n_removed
    (of these, to be removed), n_spans, removed_bytes, spans (start, end: bytes, ascending), clusters (their ids)."""
    schema = "doc_id long, n_linked long, n_removed long, n_spans long, removed_bytes long, spans array<struct<start:long,end:long>>, clusters array<long>"
    pair = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    kinds = [*[pa.int64()] * 5, pa.list_(pair), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, n, gone, spans, clusters in zip(*(c.to_pylist() for c in b.columns)):
                runs = merged(spans or [], 1 << 32)
                out.append((i, n or 0, gone or 0, len(runs), sum(e - s for s, e in runs), [{"start": s, "end": e} for s, e in runs], clusters or []))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc_id", "n_linked", "n_removed", "n_spans", "removed_bytes", "spans", "clusters"])

    ids = keyed(docs).select("key", "doc_id")
    return ids.join(lists_of(repeats(docs, block)), "key", "left").select("doc_id", "n_linked", "n_removed", "spans", "clusters").mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_linked (units with a copy in another document), n_removed (of these, removed),
    n_spans and removed_bytes (removed text), clusters (ids of the clusters, ascending), kept_sha256, kept."""
    lists = lists_of(repeats(docs, block))
    schema = "doc_id long, n_linked long, n_removed long, n_spans long, removed_bytes long, clusters array<long>, kept_sha256 string, kept string"
    kinds = [*[pa.int64()] * 5, pa.list_(pa.int64()), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                out = []
                for _, i, text, n, gone, spans, clusters in zip(*(b.slice(at, 256).column(k).to_pylist() for k in range(7))):
                    data, kept, last = text.encode(), [], 0
                    runs = merged(spans or [], len(data))
                    for start, end in runs:
                        kept.append(data[last:start])
                        last = end
                    rest = b"".join([*kept, data[last:]])
                    out.append((i, n or 0, gone or 0, len(runs), len(data) - len(rest), clusters or [], hashlib.sha256(rest).hexdigest(), rest.decode()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[x.split()[0] for x in schema.split(", ")])

    return keyed(docs).join(lists, "key", "left").select("key", "doc_id", "text", "n_linked", "n_removed", "spans", "clusters").mapInArrow(run, schema)
