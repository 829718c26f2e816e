"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For each prefix of a piece exactly one token can end it in the piece's correct
encoding: the token t for which the last token before it and t, put together, encode
to just those two. Storing that token for each prefix gives the encoding of every
prefix at once, so that appending bytes never redoes earlier work and an edit only
redoes the prefixes behind it.

The tables of many short pieces are made together in numpy, prefix length by prefix length (``ManyPieces``): tokens are found by the hashes of
the bytes before each place, and two tokens fit unless undoing their merges, the later one first, shows a pair at the seam
that would have been merged earlier. Decoding is compared with the text; should a hash ever lead to a wrong token, the document is encoded again by bytes.

Rules: a null text counts as empty and gives no tokens. Texts of any length are taken
whole. Repeated rows give repeated results. Special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, hex_sha, mix, on_release, pick, texts_of

_BASE, _SALT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _SALT)

#: Pieces whose encoding a worker remembers; when full, they are kept as long as it takes to fill the memory again.
REMEMBERED = 150_000
#: Bytes of the longest pieces that are handled together, by class, and bytes handled at once.
LENGTHS, TOGETHER = (16, 48, 256), 1 << 17


class PrefixEncoder:
    """Encodes pieces of bytes with the ranks of a byte-level BPE vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self._fits: dict[int, bool] = {}
        self._alone: dict[int, bool] = {}

    @functools.cached_property
    def ends(self) -> dict[bytes, int]:
        """Every end of a token, with the token's id where the end is one itself, else -1: what isn't here can't be lengthened to a token."""
        return {b[i:]: -1 for b in self.ranks for i in range(1, len(b))} | self.ranks

    @functools.cached_property
    def many(self) -> ManyPieces | None:
        """None for a vocabulary whose tokens don't all come from two tokens of lower ranks."""
        many = ManyPieces(self.ranks)
        return many if many.regular else None

    def merged(self, data: bytes) -> list[int]:
        """The defining greedy procedure: join the adjacent pair of the least rank until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def reachable(self, t: int) -> bool:
        """Whether merging the token's own bytes gives the token."""
        if (known := self._alone.get(t)) is None:
            known = self._alone[t] = self.merged(self.token[t]) == [t]
        return known

    def fits(self, a: int, b: int) -> bool:
        """Whether a then b encode to themselves."""
        if (known := self._fits.get(a << 32 | b)) is None:
            if len(self._fits) > 300_000:
                self._fits.clear()
            known = self._fits[a << 32 | b] = self.merged(self.token[a] + self.token[b]) == [a, b]
        return known

    def last_tokens(self, data: bytes, last: list[int] | None = None) -> list[int]:
        """last[i]: the token that ends data[:i + 1]. ``last`` of an unchanged beginning of data is taken over as it is."""
        last = list(last or ())
        ends, known = self.ends.get, self._fits.get
        for end in range(len(last) + 1, len(data) + 1):
            start = end - 1
            while start >= 0:
                t = ends(data[start:end])
                if t is None:
                    raise ValueError("a byte has no token of its own, or no token fits")
                if t >= 0:
                    if not start:
                        good = self.reachable(t)
                    elif (good := known(last[start - 1] << 32 | t)) is None:
                        good = self.fits(last[start - 1], t)
                    if good:
                        last.append(t)
                        break
                start -= 1
            else:
                raise ValueError("no token ends this prefix")
        return last

    def walk(self, last: list[int]) -> list[int]:
        out, end = [], len(last)
        while end:
            out.append(t := last[end - 1])
            end -= len(self.token[t])
        return out[::-1]

    def encode(self, data: bytes) -> list[int]:
        if (t := self.ranks.get(data)) is not None:  # a piece that is a token stays that token
            return [t]
        return self.walk(self.last_tokens(data))

    def append(self, data: bytes, last: list[int], more: bytes) -> list[int]:
        """last_tokens of data + more, from those of data."""
        return self.last_tokens(data + more, last)

    def edit(self, data: bytes, last: list[int], start: int, end: int, new: bytes) -> tuple[bytes, list[int]]:
        """Replaces data[start:end] by new; the prefixes before start keep their tokens."""
        data = data[:start] + new + data[end:]
        return data, self.last_tokens(data, last[:start])

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class ManyPieces:
    """The tables of many pieces at once. Tokens are their ranks; what is no token is -1."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = sorted(ranks, key=len)
        ids = np.array([ranks[t] for t in tokens], np.int64)
        size = np.array([len(t) for t in tokens], np.int64)
        n = int(ids.max()) + 1 if len(ids) else 0
        longest = int(size[-1]) if len(size) else 0
        self.longest = longest
        self.power = np.array([pow(int(_BASE), i, 1 << 64) for i in range(longest + 2)], np.uint64)
        raw = np.frombuffer(b"".join(tokens), np.uint8)
        ends = np.cumsum(size) - 1
        self.size, self.hash = np.zeros(n, np.int64), np.zeros(n, np.uint64)
        self.size[ids] = size
        h = np.zeros(len(ids), np.uint64)
        for k in range(longest):
            there = size > k
            h[there] += _BYTE[raw[ends[there] - k]] * self.power[k]
        self.hash[ids] = h
        key = self._key(h, size)
        order = np.argsort(key)
        self.keys, self.ids = key[order], ids[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(key >> np.uint64(44)).astype(np.int64)] = True
        self.known_pairs, self.known = np.full(1 << 17, -1, np.int64), np.zeros(1 << 17, bool)
        # the two tokens that each token is merged from last, found from shorter to longer ones
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.regular = bool((np.bincount(raw[ends[size == 1]], minlength=256) == 1).all())
        first = np.cumsum(size) - size
        for length in np.unique(size[size > 1]).tolist():
            of = np.flatnonzero(size == length)
            head = np.zeros(len(of), np.uint64)
            whole = h[of]
            for cut in range(1, length):
                head = head * _BASE + _BYTE[raw[first[of] + cut - 1]]
                a = self.find(head, cut)
                b = self.find(whole - head * self.power[length - cut], length - cut)
                use = np.flatnonzero((a >= 0) & (b >= 0) & (np.maximum(a, b) < ids[of]))
                use = use[self._fit(a[use], b[use], ids[of[use]])]
                self.left[ids[of[use]]], self.right[ids[of[use]]] = a[use], b[use]
            self.regular &= bool((self.left[ids[of]] >= 0).all())

    @staticmethod
    def _key(h: np.ndarray, size) -> np.ndarray:
        return mix(h + np.asarray(size, np.uint64) * _SALT)

    def find(self, h: np.ndarray, size) -> np.ndarray:
        """The tokens of these hashes and sizes."""
        key = self._key(h, size)
        out = np.full(len(key), -1, np.int64)
        may = np.flatnonzero(self.maybe[(key >> np.uint64(44)).astype(np.int64)])
        key = key[may]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        out[may] = np.where(self.keys[at] == key, self.ids[at], -1)
        return out

    def _fit(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Whether a then b encode to themselves as far as merges below limit go."""
        good = np.ones(len(a), bool)
        at = np.arange(len(a))
        a, b, limit = a.copy(), b.copy(), limit.copy()
        while len(at):
            joined = np.full(len(at), -1, np.int64)
            size = self.size[a] + self.size[b]
            can = np.flatnonzero(size <= self.longest)
            joined[can] = self.find(self.hash[a[can]] * self.power[self.size[b[can]]] + self.hash[b[can]], size[can])
            bad = (joined >= 0) & (joined < limit)
            good[at[bad]] = False
            # of the two tokens the one that was merged later is undone, and the part of it at the seam stays
            la, lb = self.right[a], self.left[b]
            undo_a = (a > b) & (la >= 0) | (lb < 0)
            limit = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, la, a), np.where(undo_a, b, lb)
            on = ~bad & (a >= 0)  # where neither comes from a merge, a is -1
            at, a, b, limit = at[on], a[on], b[on], limit[on]
        return good

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether a then b encode to themselves; remembers pairs in a table of a fixed size."""
        pair = a << np.int64(32) | b
        slot = (mix(pair.astype(np.uint64)) >> np.uint64(47)).astype(np.int64)
        out = self.known[slot]
        new = np.flatnonzero(self.known_pairs[slot] != pair)
        if len(new):
            pairs, of = np.unique(pair[new], return_inverse=True)
            good = self._fit(pairs >> np.int64(32), pairs & np.int64(0xFFFFFFFF), np.full(len(pairs), 1 << 60))
            out[new] = good[of]
            self.known_pairs[slot[new]], self.known[slot[new]] = pair[new], out[new]
        return out

    def last_tokens(self, raw: np.ndarray, size: np.ndarray) -> np.ndarray:
        """For each byte of pieces laid end to end the token that ends there, as PrefixEncoder.last_tokens has it."""
        first = np.cumsum(size) - size
        at = np.arange(len(raw)) - np.repeat(first, size)
        byte = _BYTE[raw]
        h = np.zeros(len(raw), np.uint64)
        where, tokens = [], []
        here = np.arange(len(raw))
        for k in range(min(self.longest, int(size.max()))):
            here = here[at[here] >= k]
            h[here] += byte[here - k] * self.power[k]
            found = self.find(h[here], k + 1)
            there = found >= 0
            where.append(here[there])
            tokens.append(found[there])
        where, tokens = np.concatenate(where), np.concatenate(tokens)
        order = np.argsort(at[where], kind="stable")
        where, tokens = where[order], tokens[order]
        cuts = np.searchsorted(at[where], np.arange(int(size.max()) + 1))
        last = np.full(len(raw), -1, np.int64)
        for end in range(int(size.max())):
            place, t = where[cuts[end] : cuts[end + 1]], tokens[cuts[end] : cuts[end + 1]]
            before = place - self.size[t]
            good = self.size[t] == end + 1  # the whole prefix, which encodes to itself
            rest = np.flatnonzero(~good)
            good[rest] = self.fits(last[before[rest]], t[rest])
            last[place[good]] = t[good]
        return last

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as little-endian unsigned 32-bit integers."""
        size = np.array([len(p) for p in pieces], np.int64)
        last = self.last_tokens(np.frombuffer(b"".join(pieces), np.uint8), size)
        first = np.cumsum(size) - size
        steps, of, at = [], np.arange(len(pieces)), first + size - 1
        while len(of):
            t = last[at]
            steps.append((of, t))
            at = at - self.size[t]
            on = at >= first[of]
            of, at = of[on], at[on]
        which, ids = np.concatenate([x for x, _ in steps]), np.concatenate([x for _, x in steps])
        count = np.bincount(which, minlength=len(pieces))
        ids = ids[::-1][np.argsort(which[::-1], kind="stable")].astype("<u4").tobytes()
        ends = (4 * np.cumsum(count)).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]


@functools.lru_cache(2)
def load(path: str) -> PrefixEncoder:
    with open(path, "rb") as f:
        return PrefixEncoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Worker:
    """What a Python worker keeps between batches."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.encoder = load(path)
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def release(self) -> None:
        self.known, self.before = {}, {}

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of these pieces, little-endian unsigned 32-bit; short ones are remembered."""
        known, ranks, out, classes = self.known, self.encoder.ranks, {}, [[] for _ in LENGTHS]
        for p in pieces:
            if (b := self.before.get(p)) is not None:
                known[p] = b
                continue
            raw = p.encode("utf-8", "surrogatepass")
            if (t := ranks.get(raw)) is not None:  # a piece that is a token stays that token
                known[p] = _pack([t])
            elif len(raw) > LENGTHS[-1] or self.encoder.many is None:
                out[p] = _pack(self.encoder.encode(raw))
            else:
                classes[next(i for i, n in enumerate(LENGTHS) if len(raw) <= n)].append((p, raw))
        for found in classes:
            at = 0
            while at < len(found):
                end, size = at, 0
                while end < len(found) and size < TOGETHER:
                    size += len(found[end][1])
                    end += 1
                ids = self.encoder.many.encode([raw for _, raw in found[at:end]])
                (known if len(found[at][1]) <= LENGTHS[1] else out).update(zip([p for p, _ in found[at:end]], ids))
                at = end
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        """Of each text its ids, little-endian unsigned 32-bit."""
        if len(self.known) > REMEMBERED:
            self.before, self.known = self.known, {}
        split = [self.split(t) for t in texts]
        more = self.learn({p for s in split for p in s if p not in self.known})
        known = self.known if not more else {p: self.known.get(p) or more[p] for s in split for p in s}
        return [b"".join(map(known.__getitem__, s)) for s in split]


@functools.lru_cache(2)
def worker(path: str, pattern: str) -> _Worker:
    made = _Worker(path, pattern)
    on_release(made.release)
    return made


def encode_documents(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document; with keep_ids the ids too (array<int>).

    ``path`` names the rank file, which must be there on each executor (it comes with the installed package)."""
    cols = {"doc_id": "long", "text": "string"} | {k: "string" for k in keep}
    kept = [(k, pa.string()) for k in keep]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = worker(path, pattern)
        texts = texts_of(batch)
        packed = w.ids(texts)
        decoded = [w.encoder.decode(np.frombuffer(p, "<u4").tolist()) for p in packed]
        for i, (t, d) in enumerate(zip(texts, decoded)):
            if d != (raw := t.encode("utf-8", "surrogatepass")):  # a hash met a wrong token
                packed[i] = _pack([x for p in w.split(t) for x in w.encoder.encode(p.encode("utf-8", "surrogatepass"))])
                decoded[i] = raw
        out = [
            batch.column("doc_id"),
            *(batch.column(k) for k in keep),
            pa.array([len(p) // 4 for p in packed], pa.int64()),
            pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
            pa.array(list(map(hex_sha, decoded)), pa.string()),
        ]
        names = ["doc_id", *keep, "n_tokens", "ids_sha256", "decoded_sha256"]
        if keep_ids:
            ends = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4"))))
            names.append("ids")
        return pa.RecordBatch.from_arrays(out, names)

    schema = "doc_id long" + "".join(f", {k} string" for k, _ in kept) + ", n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return arrow_map(pick(docs, **cols), run, schema, rows=256)
