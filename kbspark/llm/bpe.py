"""Byte-level BPE encoding and decoding by segment trees.

Every pre-token is a row of arrays over its byte positions: the live token ids, their live
neighbours, and a segment tree whose leaf at a position is the rank of the pair that starts
there. The root is the leftmost pair of least rank; a merge changes three leaves and the nodes
above them. All pre-tokens of a batch with about the same length take their next merge together.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kbspark.llm._store import small_batches

_NONE = np.int64(2**62)
_POS = 32
#: Bytes of a cache entry beside its text and ids.
_ENTRY = 150


class ByteBPE:
    """Ranks in the public tiktoken text format (base64 token, rank) and the pattern of pre-tokens."""

    def __init__(self, ranks: bytes, pattern: str, cache_bytes: int = 64 << 20):
        import regex

        self.tokens: dict[int, bytes] = {}
        for line in ranks.splitlines():
            if line:
                token, rank = line.split()
                self.tokens[int(rank)] = base64.b64decode(token)
        self.ranks = {t: r for r, t in self.tokens.items()}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        keys, values = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << _POS | b)
                    values.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.pair_keys, self.pair_ranks = np.array(keys, np.int64)[order], np.array(values, np.int64)[order]
        split = regex.compile(pattern)
        self.pair_table = dict(zip(self.pair_keys.tolist(), self.pair_ranks.tolist()))
        self.find, self.find_all = split.finditer, split.findall
        self.by_text = {str(r).encode(): t for r, t in self.tokens.items()}
        self.decoded: dict[bytes, bytes] = {}
        self.cache: dict[str, bytes] = {}
        self.held, self.decoded_held, self.cache_bytes = 0, 0, cache_bytes

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each joined pair, or _NONE; negative ids stand for no token."""
        key = (a << _POS) | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (a >= 0) & (b >= 0), self.pair_ranks[at], _NONE)

    def merge(self, pieces: list[bytes], width: int) -> list[list[int]]:
        """Ids of pieces of 2 to ``width`` bytes; ``width`` is a power of two."""
        n = len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, n)
        ids = np.full((n, width + 1), -1, np.int64)
        live = np.arange(width)[None, :] < sizes[:, None]
        ids[:, :width][live] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.tile(np.arange(1, width + 2), (n, 1))
        before = np.tile(np.arange(-1, width), (n, 1))
        tree = np.full((n, 2 * width), _NONE, np.int64)
        rank = self.pair(ids[:, :width].ravel(), ids[:, 1:].ravel()).reshape(n, width)
        tree[:, width:] = np.where(rank < _NONE, rank << _POS | np.arange(width), _NONE)
        level = width // 2
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level //= 2
        rows = np.flatnonzero(tree[:, 1] < _NONE)
        while len(rows):
            root = tree[rows, 1]
            at = root & ((1 << _POS) - 1)
            gone = after[rows, at]
            right = after[rows, gone]
            left = before[rows, at]
            ids[rows, at] = root >> _POS
            ids[rows, gone] = -1
            after[rows, at] = right
            before[rows, np.minimum(right, width - 1)] = np.where(right < width, at, before[rows, np.minimum(right, width - 1)])
            new = self.pair(ids[rows, at], ids[rows, np.minimum(right, width)])
            tree[rows, width + at] = np.where(new < _NONE, new << _POS | at, _NONE)
            tree[rows, width + gone] = _NONE
            has = left >= 0
            some, lefts = rows[has], left[has]
            new = self.pair(ids[some, lefts], ids[some, at[has]])
            tree[some, width + lefts] = np.where(new < _NONE, new << _POS | lefts, _NONE)
            paths = [(rows, (width + at) >> 1), (rows, (width + gone) >> 1), (some, (width + lefts) >> 1)]
            for _ in range(width.bit_length() - 1):
                for r, k in paths:
                    tree[r, k] = np.minimum(tree[r, 2 * k], tree[r, 2 * k + 1])
                paths = [(r, k >> 1) for r, k in paths]
            rows = rows[tree[rows, 1] < _NONE]
        out = ids[:, :width]
        flat, ends = out[out >= 0].tolist(), np.cumsum((out >= 0).sum(1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def merge_long(self, piece: bytes, width: int) -> list[int]:
        """The same tree for a single long piece, in flat arrays (about 28 bytes for each of its own): a vector of one row would be slow."""
        n, none, lookup = len(piece), int(_NONE), self.pair_table
        ids = array("i", [int(self.byte_ids[b]) for b in piece])
        after, before = array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        tree = array("q", [none]) * (2 * width)

        def leaf(at: int) -> None:
            rank = lookup.get(ids[at] << _POS | ids[after[at]]) if after[at] < n else None
            tree[width + at] = none if rank is None else rank << _POS | at

        for at in range(n):
            leaf(at)
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        while tree[1] < none:
            rank, at = tree[1] >> _POS, tree[1] & ((1 << _POS) - 1)
            gone, left = after[at], before[at]
            ids[at], ids[gone] = rank, -1
            after[at] = after[gone]
            if after[at] < n:
                before[after[at]] = at
            leaf(at)
            tree[width + gone] = none
            changed = [at, gone]
            if left >= 0:
                leaf(left)
                changed.append(left)
            for pos in changed:
                k = (width + pos) >> 1
                while k:
                    tree[k] = min(tree[2 * k], tree[2 * k + 1])
                    k >>= 1
        return [i for i in ids if i >= 0]

    def learn(self, pieces: Iterable[str]) -> None:
        """Put the ids of new pre-tokens, written in decimal, into the cache."""
        by_width: dict[int, list[str]] = {}
        for p in pieces:
            b = p.encode()
            whole = self.ranks.get(b)
            if whole is not None:
                self._keep(p, b"%d" % whole)
            else:
                by_width.setdefault(1 << (len(b) - 1).bit_length(), []).append(p)
        for width, group in by_width.items():
            if width >= 256 and len(group) < width // 16:
                for p in group:
                    self._keep(p, ",".join(map(str, self.merge_long(p.encode(), width))).encode())
                continue
            step = max(1, (1 << 19) // width)
            for at in range(0, len(group), step):
                part = group[at : at + step]
                for p, ids in zip(part, self.merge([p.encode() for p in part], width)):
                    self._keep(p, ",".join(map(str, ids)).encode())

    def _keep(self, piece: str, ids: bytes) -> None:
        self.cache[piece] = ids
        self.held += len(piece) + len(ids) + _ENTRY

    def trim(self) -> None:
        """Empty the cache when what it holds is over its bytes; between parts of texts only."""
        if self.held > self.cache_bytes:
            self.cache.clear()
            self.held = 0

    def encode_parts(self, text: str, size: int = 50_000) -> Iterator[list[bytes]]:
        """For each pre-token its decimal ids joined by commas, ``size`` pre-tokens at a time."""
        part: list[str] = []
        for m in self.find(text):
            part.append(m.group())
            if len(part) == size:
                yield self._join(part)
                part = []
        if part:
            yield self._join(part)

    def _join(self, part: list[str]) -> list[bytes]:
        self.trim()
        new = set(part).difference(self.cache)
        if new:
            self.learn(new)
        return [self.cache[p] for p in part]

    def encode(self, text: str) -> list[int]:
        return [int(x) for part in self.encode_parts(text) for group in part for x in group.split(b",")]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decode_group(self, group: bytes) -> bytes:
        """The bytes of ids written in decimal; groups of ids that return are remembered."""
        found = self.decoded.get(group)
        if found is None:
            if self.decoded_held > self.cache_bytes:
                self.decoded.clear()
                self.decoded_held = 0
            found = self.decoded[group] = b"".join(map(self.by_text.__getitem__, group.split(b",")))
            self.decoded_held += len(group) + len(found) + _ENTRY
        return found


_made: dict[str, ByteBPE] = {}


def _coder(ranks: bytes, pattern: str) -> ByteBPE:
    key = hashlib.sha256(ranks + pattern.encode()).hexdigest()
    if key not in _made:
        _made.clear()
        _made[key] = ByteBPE(ranks, pattern)
    return _made[key]


def _vocabulary(docs: DataFrame, path: str):
    with open(path, "rb") as f:
        ranks = f.read()
    if len(ranks) > 64 << 20:
        raise ValueError("a rank file of over 64 MiB is not sent to every executor")
    return docs.sparkSession.sparkContext.broadcast(ranks)


def _encoded(coder: ByteBPE, texts: list[str], long: int = 1 << 20) -> Iterator[Iterator[list[bytes]]]:
    """The parts of each text. New pre-tokens of neighbouring texts are learnt together, long texts part by part."""
    at = 0
    while at < len(texts):
        if len(texts[at]) > long:
            yield coder.encode_parts(texts[at])
            at += 1
            continue
        split, size = [], 0
        while at < len(texts) and size + len(texts[at]) <= long:
            split.append(coder.find_all(texts[at]))
            size += len(texts[at])
            at += 1
        coder.trim()
        coder.learn(set().union(*split).difference(coder.cache))
        for pieces in split:
            yield iter([[coder.cache[p] for p in pieces]] if pieces else [])


def encode_documents(docs: DataFrame, path: str, pattern: str, ids: bool = True) -> DataFrame:
    """``docs(doc_id, text)`` with its token ids and digests of the ids and of the decoded bytes.

    ``doc_id, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string``; ``ids``
    only on request. One narrow pass. A null or empty text has no tokens. Row by row, so repeated
    rows, null ids and extra columns make no difference. A long text is encoded in parts of
    50,000 pre-tokens, and an empty table gives an empty result. The rank file is read by the
    driver and sent to the executors (64 MiB at most).
    """
    ranks = _vocabulary(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks.value, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                rows = batch.slice(lo, 1024)
                out: tuple[list, ...] = ([], [], [], [])
                for parts in _encoded(coder, [t or "" for t in rows.column(1).to_pylist()]):
                    n, enc, dec, all_ids = 0, hashlib.sha256(), hashlib.sha256(), []
                    for groups in parts:
                        part = b",".join(groups)
                        enc.update(part if not n else b"," + part)
                        n += part.count(b",") + 1
                        dec.update(b"".join(map(coder.decode_group, groups)))
                        if ids:
                            all_ids.extend(map(int, part.split(b",")))
                    for column, value in zip(out, (n, enc.hexdigest(), dec.hexdigest(), all_ids)):
                        column.append(value)
                cols = [rows.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    cols, names = [*cols, pa.array(out[3], pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    small_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, schema)
