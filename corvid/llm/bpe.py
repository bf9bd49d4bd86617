"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For each prefix of a piece's bytes exactly one token can be the last of the prefix's encoding. The encoder stores
that token per prefix: a token ending at a byte is the last one if it and the last token of the prefix before it
stay two tokens when merged on their own. Appending bytes extends the table exactly; after an edit the table is
recomputed from the edit on, and stops as soon as it has agreed with the old one over the longest token's length.

Defined cases: a null text is empty and has no ids; texts of any length are taken whole; repeated rows each get
their row; an empty table gives an empty result; extra columns may be carried along.
"""

from __future__ import annotations

import base64
import hashlib
import math
from array import array
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm.common import release

#: Bytes, roughly, of what a worker remembers of runs of text, and a quarter as much of pieces; halves of it are
#: forgotten in turn.
REMEMBERED = 128 << 20
#: Pieces longer than this are encoded on their own; shorter ones together, position by position.
TOGETHER = 192
#: Bytes, roughly, of short pieces whose tables are made together: every token found in them is held, 24 bytes each.
AT_ONCE = 1 << 17
#: Characters of text that are worked on together.
GROUP = 1 << 20
#: Tokens of which the edges are remembered.
EDGES = 16_384
#: Slots of the table of token pairs (a power of two); a pair forgets the one that had its slot.
PAIRS_BITS = 20


class Vocabulary:
    """Ranks of byte strings, with what the dynamic program asks of them."""

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([k]) not in ranks for k in range(256)):
            raise ValueError("the vocabulary lacks a byte")
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.length = np.zeros(max(self.bytes_of) + 1, np.int64)
        for i, t in self.bytes_of.items():
            self.length[i] = len(t)
        #: The trie by depth: sorted keys (parent's place << 8 | byte) and the token that each node is, or -1.
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        places = {b"": 0}
        for depth in range(1, self.longest + 1):
            nodes = sorted({t[:depth] for t in ranks if len(t) >= depth})
            keys = np.fromiter((places[t[:-1]] << 8 | t[-1] for t in nodes), np.int64, len(nodes))
            self.levels.append((keys, np.fromiter((ranks.get(t, -1) for t in nodes), np.int64, len(nodes))))
            places = {t: k for k, t in enumerate(nodes)}
        self._edges: dict[int, tuple] = {}
        #: Per token whether it stands alone (-1: not known yet); slots of pairs of tokens and whether they stay apart.
        self.alone = np.full(len(self.length), -1, np.int8)
        self.pairs = np.full(1 << PAIRS_BITS, -1, np.int64)
        self.apart = np.zeros(1 << PAIRS_BITS, np.bool_)

    @cached_property
    def endings(self) -> dict[bytes, int]:
        """Every ending of a token: the token that it is, or -1."""
        return {t[k:]: -1 for t in self.ranks for k in range(1, len(t))} | self.ranks

    @classmethod
    def parse(cls, raw: bytes) -> Vocabulary:
        """From lines of a base64 token and its rank."""
        return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)})

    def merge(self, piece: bytes) -> tuple[list[int], list, list]:
        """Plain merging of a token's own bytes by lowest rank, leftmost first.

        Returns the ids, and for the right and the left edge the parts that stand there in turn, each with the
        rank of the merge that absorbs it (infinite for the last).
        """
        parts = [piece[k : k + 1] for k in range(len(piece))]
        right, left = [], []
        while len(parts) > 1:
            ranked = [(self.ranks[x], k) for k in range(len(parts) - 1) if (x := parts[k] + parts[k + 1]) in self.ranks]
            if not ranked:
                break
            rank, k = min(ranked)
            if k == 0:
                left.append((parts[0], rank))
            if k == len(parts) - 2:
                right.append((parts[-1], rank))
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        right.append((parts[-1], math.inf))
        left.append((parts[0], math.inf))
        return [self.ranks[x] for x in parts], right, left

    def edges(self, token: int) -> tuple[bool, list, list]:
        """Whether merging a token's own bytes gives the token, and its edges (see ``merge``)."""
        if (known := self._edges.get(token)) is None:
            if len(self._edges) >= EDGES:
                self._edges.clear()
            ids, right, left = self.merge(self.bytes_of[token])
            known = self._edges[token] = (ids == [token], right, left)
        return known

    def stands_alone(self, token: int) -> bool:
        return self.edges(token)[0]

    def all_alone(self, tokens: np.ndarray) -> np.ndarray:
        """``stands_alone`` of each."""
        for token in np.unique(tokens[self.alone[tokens] < 0]).tolist():
            self.alone[token] = self.stands_alone(token)
        return self.alone[tokens] > 0

    def follows(self, left: int, right: int) -> bool:
        """Whether ``right`` can be the token after ``left``."""
        return self.stands_alone(right) and self.stays_apart(left, right)

    def all_follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``follows`` of each pair; remembered by slot."""
        key = left << 32 | right
        slot = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIRS_BITS)).view(np.int64)
        out, new = self.apart[slot], np.flatnonzero(self.pairs[slot] != key)
        if len(new):
            keys, where = np.unique(key[new], return_inverse=True)
            ok = np.fromiter((self.follows(k >> 32, k & 0xFFFFFFFF) for k in keys.tolist()), np.bool_, len(keys))
            out[new] = ok[where]
            self.pairs[slot[new]], self.apart[slot[new]] = key[new], out[new]
        return out

    def stays_apart(self, left: int, right: int) -> bool:
        """Whether two tokens side by side stay two tokens: no merge across comes before those within."""
        a, b, i, k, ranks = self.edges(left)[1], self.edges(right)[2], 0, 0, self.ranks
        while True:
            (x, x_ends), (y, y_ends) = a[i], b[k]
            rank = ranks.get(x + y)
            if rank is not None and rank < x_ends and rank <= y_ends:
                return False
            if x_ends <= y_ends:
                if x_ends == math.inf:
                    return True
                i += 1
            else:
                k += 1


def extend(v: Vocabulary, data: bytes, last: list[int], start: int) -> None:
    """Add to ``last`` the last token of each prefix of ``data`` longer than ``start``."""
    endings, known = v.endings.get, {}
    for end in range(start + 1, len(data) + 1):
        found, at = [], end - 1
        while at >= 0 and (token := endings(data[at:end])) is not None:
            if token >= 0:
                found.append((at, token))
            at -= 1
        for at, token in reversed(found):
            if not at:
                if v.stands_alone(token):
                    last.append(token)
                    break
                continue
            before = last[at - 1]
            if (apart := known.get((before, token))) is None:
                apart = known[before, token] = v.follows(before, token)
            if apart:
                last.append(token)
                break
        else:
            raise ValueError("the vocabulary lacks a byte")


def tables(v: Vocabulary, data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The last token of every prefix of each piece of ``data`` (from ``begin[k]`` to before ``begin[k + 1]``).

    The same as ``extend`` for all pieces at once: every token found anywhere by the trie, then prefix lengths in
    turn, each looking at the tokens that end there.
    """
    n = np.diff(begin)
    head, stop = np.repeat(begin[:-1], n), np.repeat(begin[1:], n)
    at, node, found = np.arange(len(data)), np.zeros(len(data), np.int64), []
    for depth, (keys, tokens) in enumerate(v.levels):
        fits = at + depth < stop[at]
        at = at[fits]
        if not len(at):
            break
        key = node[fits] << 8 | data[at + depth]
        node = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        ok = keys[node] == key
        at, node = at[ok], node[ok]
        token = tokens[node]
        is_one = token >= 0
        found.append((at[is_one], token[is_one], np.full(int(is_one.sum()), depth)))
    at, token, depth = map(np.concatenate, zip(*found))
    length = at + depth - head[at]
    order = np.argsort(length.astype(np.uint8), kind="stable")  # within a length, shorter tokens first
    at, token, depth = at[order], token[order], depth[order]
    edge = np.r_[0, np.cumsum(np.bincount(length))]
    first = at == head[at]
    last = np.full(len(data), -1, np.int64)
    for lo, hi in zip(edge, edge[1:]):
        a, t, starts = at[lo:hi], token[lo:hi], first[lo:hi]
        ok = np.empty(hi - lo, np.bool_)
        ok[starts] = v.all_alone(t[starts])
        ok[~starts] = v.all_follow(last[a[~starts] - 1], t[~starts])
        last[(a + depth[lo:hi])[ok]] = t[ok]
    if len(last) and last.min() < 0:
        raise ValueError("the vocabulary lacks a byte")
    return last


def together(v: Vocabulary, pieces: list[bytes]) -> list[bytes]:
    """Packed ids of pieces of at most ``TOGETHER`` bytes, none of them empty."""
    begin = np.cumsum([0, *map(len, pieces)])
    last = tables(v, np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64), begin)
    who, end, found = np.arange(len(pieces)), begin[1:].copy(), []
    while len(who):  # from behind, the last token of all at once
        token = last[end - 1]
        found.append((who, token))
        end = end - v.length[token]
        more = end > begin[who]
        who, end = who[more], end[more]
    who, token = (np.concatenate(x[::-1]) for x in zip(*found))
    ids = token[np.argsort(who, kind="stable")].astype("<u4").tobytes()
    edge = (4 * np.r_[0, np.cumsum(np.bincount(who))]).tolist()
    return [ids[a:b] for a, b in zip(edge, edge[1:])]


class PrefixTable:
    """The last token of every prefix of a byte string, kept up to date under appends and edits."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, bytearray(), []
        self.append(data)

    def append(self, more: bytes) -> None:
        start = len(self.data)
        self.data += more
        extend(self.v, bytes(self.data), self.last, start)

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` in place of bytes ``start`` to ``stop``; returns how many prefixes were recomputed."""
        old, shift = self.last, len(new) - (stop - start)
        data = bytes(self.data[:start] + new + self.data[stop:])
        last, agreed, done = old[:start], 0, 0
        for end in range(start + 1, len(data) + 1):
            extend(self.v, data[:end], last, end - 1)
            token = last[-1]
            done += 1
            # behind the edit: the same bytes and the same last tokens so far lead to the same ones from here on
            agreed = agreed + 1 if end - self.v.longest >= start + len(new) and old[end - shift - 1] == token else 0
            if agreed >= self.v.longest:
                last += old[end - shift :]
                break
        self.data, self.last = bytearray(data), last
        return done

    def ids(self) -> list[int]:
        return read_back(self.v, self.last)


def read_back(v: Vocabulary, last: list[int]) -> list[int]:
    """The ids of the longest prefix."""
    out, end = [], len(last)
    while end:
        token = last[end - 1]
        out.append(token)
        end -= len(v.bytes_of[token])
    return out[::-1]


class Recent:
    """Packed ids by string, what was not met for long forgotten: a full younger half takes the older one's place."""

    def __init__(self, size: int):
        self.size = size // 2
        self.forget()

    def forget(self) -> None:
        self.young, self.old, self.held = {}, {}, 0

    def add(self, new: dict[str, bytes]) -> None:
        new = {text: packed for text, packed in new.items() if len(text) <= 64}
        self.held += 200 * len(new) + sum(map(len, new)) + sum(map(len, new.values()))
        self.young.update(new)
        if self.held > self.size:
            self.young, self.old, self.held = {}, self.young, 0

    def split(self, wanted: set[str]) -> tuple[dict[str, bytes], set[str]]:
        """What is known of ``wanted``, and the rest."""
        young, old = self.young, self.old
        here = wanted & young.keys()
        known, rest = {x: young[x] for x in here}, wanted - here
        again = rest & old.keys()
        if again:
            met = {x: old[x] for x in again}
            known |= met
            self.add(met)
        return known, rest - again


class Encoder:
    """Packed ids of whole texts.

    A space or line feed between two characters that aren't white space always starts a match (the line feed is
    one), so a text can be cut there and the runs between looked up; other texts are matched as a whole.
    """

    def __init__(self, vocabulary: Vocabulary, pattern, remembered: int = REMEMBERED):
        self.v, self.pattern = vocabulary, pattern
        self.pieces, self.first, self.later = Recent(remembered // 4), Recent(remembered // 4), Recent(remembered // 4 * 3)
        self.plain = pattern.findall("a b\nc") == ["a", " b", "\n", "c"]
        self.feed = self.of_pieces({"\n"})["\n"]

    def forget(self) -> None:
        for memory in (self.pieces, self.first, self.later):
            memory.forget()

    def computed(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """Ids of distinct pieces as little-endian 32-bit integers."""
        out, short, ranks = {}, [], self.v.ranks
        for text in pieces:
            data = text.encode()
            if (whole := ranks.get(data)) is not None:
                out[text] = whole.to_bytes(4, "little")
            elif len(data) > TOGETHER:
                last: list[int] = []
                extend(self.v, data, last, 0)
                out[text] = array("I", read_back(self.v, last)).tobytes()
            else:
                short.append((text, data))
        part, size = [], 0
        for k, (_, data) in enumerate(short, 1):
            part.append(data)
            size += len(data)
            if size >= AT_ONCE or k == len(short):
                out.update(zip([t for t, _ in short[k - len(part) : k]], together(self.v, part)))
                part, size = [], 0
        return out

    def of_pieces(self, wanted: set[str]) -> dict[str, bytes]:
        """The same, remembered."""
        out, new = self.pieces.split(wanted)
        now = self.computed(new)
        self.pieces.add(now)
        return out | now

    def of_runs(self, memory: Recent, lead: str, wanted: set[str]) -> dict[str, bytes | None]:
        """Ids of runs between single spaces, which no match of the pattern spans; None where that isn't so."""
        out, new = memory.split(wanted)
        findall, one, several = self.pattern.findall, [], []
        for x in new:
            if not x or x[0].isspace() or x[-1].isspace():
                out[x] = None
            elif len(ms := findall(lead + x)) == 1:
                one.append(x)
            else:
                several.append((x, ms))
        now = self.computed([lead + x for x in one])  # a piece of its own is remembered as a run
        found = {x: now[lead + x] for x in one}
        pieces = self.of_pieces({m for _, ms in several for m in ms})
        found |= {x: b"".join([pieces[m] for m in ms]) for x, ms in several}
        memory.add(found)
        return out | found

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """``text`` in parts of about ``GROUP`` characters, and whether a part is plain; cut only where a match starts."""
        if not self.plain:
            yield text, False
            return
        at = 0
        while len(text) - at > 2 * GROUP:
            cut = at + GROUP
            while (cut := text.find(" ", cut)) > 0 and (cut + 1 == len(text) or text[cut - 1].isspace() or text[cut + 1].isspace()):
                cut += 1
            if cut < 0:
                break
            yield text[at:cut], True
            at = cut
        yield text[at:], True

    def of_parts(self, parts: list[tuple[str, bool]]) -> list[bytes]:
        """Ids of each part of a text; one that starts with a single space goes on where another was cut."""
        # lines of a part: (the first run or None, the other runs)
        split = [[(None, x[1:].split(" ")) if x[:1] == " " else ((y := x.split(" "))[0], y[1:]) for x in p.split("\n")] if plain else None for p, plain in parts]
        first = self.of_runs(self.first, "", {a for p in split if p for a, _ in p if a is not None})
        later = self.of_runs(self.later, " ", set().union(*(rest for p in split if p for _, rest in p)))
        first[None] = b""
        out: list[bytes | None] = []
        for p in split:
            if p is None:
                out.append(None)
                continue
            packed = []
            for a, rest in p:
                packed.append(first[a])
                packed += [later[x] for x in rest]
                packed.append(self.feed)
            # whether a line feed before a space is a match of its own is up to the pattern: only a part may start so
            bad = None in packed or any(a is None for a, _ in p[1:])
            out.append(None if bad else b"".join(packed[:-1]))
        odd = {k: self.pattern.findall(parts[k][0]) for k, x in enumerate(out) if x is None}
        pieces = self.of_pieces({m for ms in odd.values() for m in ms})
        for k, ms in odd.items():
            out[k] = b"".join([pieces[m] for m in ms])
        return out

    def __call__(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text in turn."""
        parts: list[tuple[str, bool]] = []
        counts, size = [], 0

        def done() -> Iterator[bytes]:
            ids = iter(self.of_parts(parts))
            for n in counts:
                yield b"".join([next(ids) for _ in range(n)])

        for text in texts:
            if text and len(text) > 2 * GROUP:  # on its own, part by part
                yield from done()
                parts, counts, size = [], [], 0
                yield b"".join([self.of_parts([p])[0] for p in self.parts(text)])
                continue
            parts += [(text, self.plain)] if text else []
            counts.append(1 if text else 0)
            size += len(text or "")
            if size > GROUP:
                yield from done()
                parts, counts, size = [], [], 0
        yield from done()


_LOADED: dict[str, object] = {}


def _loaded(raw: bytes, pattern: str, remembered: int = REMEMBERED) -> Encoder:
    """The encoder of this Python worker."""
    key = f"{hashlib.sha256(raw + pattern.encode()).hexdigest()} {remembered}"
    if key not in _LOADED:
        import regex

        _LOADED[key] = Encoder(Vocabulary.parse(raw), regex.compile(pattern), remembered)
    return _LOADED[key]


def _table(raw: bytes) -> dict[int, bytes]:
    """Bytes by id."""
    key = hashlib.sha256(raw).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = {int(b): base64.b64decode(a) for a, b in (line.split() for line in raw.splitlines() if line)}
    return _LOADED[key]


def decode_ids(packed: bytes, table: dict[int, bytes]) -> bytes:
    return b"".join(map(table.__getitem__, memoryview(packed).cast("I"))) if packed else b""


def encode(docs: DataFrame, raw: bytes, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), remembered: int = REMEMBERED) -> DataFrame:
    """Columns ``keep``, ids (binary, little-endian unsigned 32-bit) and n_tokens per row.

    ``raw`` is the content of a vocabulary file (a fixed size, under 1 MB) and travels with the task. ``remembered``
    bounds a worker's memory of what it met, in bytes; at the end of each task it is forgotten.
    """
    names = list(keep)
    kept = [F.col(f"`{n}`").alias(f"_k{i}") for i, n in enumerate(names)]
    schema = ", ".join([*(f"_k{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.select(*(F.col(f"`{n}`") for n in names)).schema)), "_ids binary", "_n long"])
    out_names = [*(f"_k{i}" for i in range(len(names))), "_ids", "_n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _loaded(raw, pattern, remembered)
        for b in batches:
            for at in range(0, b.num_rows, 256):  # bounds what is held at once
                part = b.slice(at, 256)
                ids = list(encoder(part.column(0).to_pylist()))
                columns = [*part.columns[1:], pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=out_names)
        encoder.forget()
        release()

    out = docs.select(F.col(f"`{text}`").alias("_text"), *kept).mapInArrow(run, schema)
    return out.select(*(F.col(f"_k{i}").alias(n) for i, n in enumerate(names)), F.col("_ids").alias("ids"), F.col("_n").alias("n_tokens"))


def decode(encoded: DataFrame, raw: bytes, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and the decoded bytes per row of packed ids; null ids decode to nothing."""
    names = list(keep)
    kept = [F.col(f"`{n}`").alias(f"_k{i}") for i, n in enumerate(names)]
    schema = ", ".join([*(f"_k{i} {f.dataType.simpleString()}" for i, f in enumerate(encoded.select(*(F.col(f"`{n}`") for n in names)).schema)), "_decoded binary"])
    out_names = [*(f"_k{i}" for i in range(len(names))), "_decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(raw)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                out = [decode_ids(x.as_py() or b"", table) for x in part.column(0)]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(out, pa.binary())], names=out_names)

    out = encoded.select(F.col(f"`{ids}`").alias("_ids"), *kept).mapInArrow(run, schema)
    return out.select(*(F.col(f"_k{i}").alias(n) for i, n in enumerate(names)), F.col("_decoded").alias("decoded"))


def digests(docs: DataFrame, raw: bytes, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), remembered: int = REMEMBERED) -> DataFrame:
    """Columns ``keep``, n_tokens, ids_sha256 and decoded_sha256 of whole texts.

    Texts are encoded and their ids decoded again by one worker, so that no second one is held for each task.
    """
    names = list(keep)
    kept = [F.col(f"`{n}`").alias(f"_k{i}") for i, n in enumerate(names)]
    found = ("_n", "_ids", "_decoded")
    schema = ", ".join([*(f"_k{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.select(*(F.col(f"`{n}`") for n in names)).schema)), "_n long, _ids string, _decoded string"])
    out_names = [*(f"_k{i}" for i in range(len(names))), *found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _loaded(raw, pattern, remembered)
        table, sha = encoder.v.bytes_of, lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = [(len(ids) // 4, sha(ids), sha(decode_ids(ids, table))) for ids in encoder(part.column(0).to_pylist())]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *columns], names=out_names)
        encoder.forget()
        release()

    out = docs.select(F.col(f"`{text}`").alias("_text"), *kept).mapInArrow(run, schema)
    return out.select(*(F.col(f"_k{i}").alias(n) for i, n in enumerate(names)), *(F.col(c).alias(n) for c, n in zip(found, ("n_tokens", "ids_sha256", "decoded_sha256"))))


def vocabulary_file(path: str) -> bytes:
    """A vocabulary file, read once on the driver."""
    with open(path, "rb") as f:
        return f.read()
