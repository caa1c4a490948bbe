"""Byte-level BPE: encoding by a rank file, and decoding.

A text is cut into pieces by a pattern; a piece that is a token becomes that token, any other is merged pair by
pair, least rank first, leftmost on ties. A segment tree over the piece's byte positions holds the rank and the place of the
pair that starts at each live token; its root gives the leftmost pair of least rank, and a merge updates the two live
neighbours in logarithmic time, so one piece of n bytes takes O(n log n) however long it is. Short pieces that are met
together are merged side by side, each in its own row of a matrix of such trees.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

NONE = 1 << 60
#: Pieces whose tokens a worker remembers in each of two generations, and the longest of them in characters.
REMEMBERED, REMEMBERED_LENGTH = 100_000, 64
#: No rank; bytes (but one) of the longest pieces that are merged side by side, and places of a group of them.
ABSENT, SIDE_BY_SIDE, GROUP = 1 << 31, 32, 1 << 17


class Ranks:
    """The rank table of a .tiktoken file's bytes."""

    def __init__(self, data: bytes, pattern: str) -> None:
        self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        self.token = {b: a for a, b in self.rank.items()}
        if missing := [k for k in range(256) if bytes([k]) not in self.rank]:
            raise ValueError(f"a rank file without the single bytes {missing}")
        self.byte = np.array([self.rank[bytes([k])] for k in range(256)])
        splits = ((self.rank[t[:k]] << 32 | self.rank[t[k:]], r) for t, r in self.rank.items() for k in range(1, len(t)) if t[:k] in self.rank and t[k:] in self.rank)
        table = np.sort(np.fromiter(splits, [("pair", np.int64), ("rank", np.int64)]), order="pair")
        self.pairs, self.joined = table["pair"].copy(), table["rank"].copy()
        self.pieces: Callable[[str], list[str]] = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The tokens of one piece, by a tree over its places. An entry is rank * width + place: the least is the leftmost of the least rank."""
        if (whole := self.rank.get(piece)) is not None:
            return [whole]
        n, get = len(piece), self.rank.get
        width = 1 << (n - 2).bit_length()
        leaves = [NONE if (r := get(piece[i : i + 2])) is None else r * width + i for i in range(n - 1)]
        levels = [leaves + [NONE] * (width - n + 1)]
        while len(levels[-1]) > 1:
            levels.append(list(map(min, levels[-1][::2], levels[-1][1::2])))
        tree = [NONE, *itertools.chain.from_iterable(reversed(levels))]
        after, before = list(range(1, n + 2)), list(range(-1, n))

        def put(i: int, start: int, end: int) -> None:
            rank = get(piece[start:end]) if start < end <= n else None
            at, value = width + i, NONE if rank is None else rank * width + i
            tree[at] = value
            while at > 1:
                value = min(value, tree[at ^ 1])
                at >>= 1
                if tree[at] == value:
                    break
                tree[at] = value

        while (least := tree[1]) < NONE:
            i = least & (width - 1)
            gone = after[i]
            after[i] = end = after[gone]
            before[end] = i
            if gone < n - 1:
                put(gone, 0, 0)
            put(i, i, after[end] if end < n else n + 1)
            if i > 0:
                put(before[i], before[i], end)
        out, i = [], 0
        while i < n:
            out.append(self.rank[piece[i : after[i]]])
            i = after[i]
        return out

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of two neighbouring tokens' bytes together, or ABSENT."""
        key = left << 32 | right
        place = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[place] == key, self.joined[place], ABSENT)

    def merge_many(self, pieces: list[bytes], width: int) -> list[bytes]:
        """The packed tokens of pieces of 2 to width + 1 bytes, merged side by side: each round makes every piece's next merge,
        found and kept up to date in its own row of trees."""
        m, bits = len(pieces), width.bit_length() - 1
        n = np.fromiter(map(len, pieces), np.int64, m)
        cells = width + 2  # places of a row: the bytes, their end, and one beyond
        token = np.zeros((m, cells), np.int64)
        token[np.arange(cells) < n[:, None]] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        live = np.arange(width) < (n - 1)[:, None]
        tree = np.full((m, 2 * width), ABSENT << bits, np.int64)
        ranks = np.where(live, self.pair_ranks(token[:, :width], token[:, 1 : width + 1]), ABSENT)
        tree[:, width:] = ranks << bits | np.arange(width)
        for level in range(bits - 1, -1, -1):
            low, high = 1 << level, 2 << level
            tree[:, low:high] = np.minimum(tree[:, 2 * low : 2 * high : 2], tree[:, 2 * low + 1 : 2 * high : 2])
        after = np.tile(np.minimum(np.arange(cells) + 1, cells - 1), (m, 1))
        before = np.tile(np.arange(cells) - 1, (m, 1))
        token, tree, after, before = (x.reshape(-1) for x in (token, tree, after, before))
        row = np.arange(m)
        while len(row):
            least = tree[row * (2 * width) + 1]
            going = least < ABSENT << bits
            row, least = row[going], least[going]
            cell, node = row * cells, row * (2 * width)
            i = least & (width - 1)
            token[cell + i] = least >> bits
            gone = after[cell + i]
            end = after[cell + gone]
            after[cell + i] = end
            before[cell + end] = i
            far, prev = end < n[row], before[cell + i]
            near = prev >= 0
            own = np.full(len(row), ABSENT)
            own[far] = self.pair_ranks(token[(cell + i)[far]], token[(cell + end)[far]])
            tree[node + width + np.minimum(gone, width - 1)] = ABSENT << bits  # where gone is beyond the last leaf, i's own is absent too
            tree[node + width + i] = own << bits | i
            prev = np.where(near, prev, i)
            first = self.pair_ranks(token[(cell + prev)[near]], token[(cell + i)[near]])
            tree[(node + width + prev)[near]] = first << bits | prev[near]
            for at in (np.minimum(gone, width - 1), i, prev):
                at = at + width
                for _ in range(bits):
                    up = node + (at >> 1)
                    tree[up] = np.minimum(tree[node + at], tree[node + (at ^ 1)])
                    at = at >> 1
        token, after = token.reshape(m, cells), after.reshape(m, cells)
        start = np.zeros((m, cells), bool)
        at, row = np.zeros(m, np.int64), np.arange(m)
        while len(row):
            start[row, at] = True
            at = after[row, at]
            more = at < n[row]
            row, at = row[more], at[more]
        ids, bound = token[start].astype("<u4").tobytes(), np.concatenate(([0], np.cumsum(start.sum(1)) * 4)).tolist()
        return [ids[a:b] for a, b in itertools.pairwise(bound)]

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """The packed tokens of distinct pieces: remembered ones (met again, they move to the younger generation), table entries, and the others merged, in groups of like length."""
        out, groups = {}, {}
        older, rank = self.older, self.rank
        for p in pieces:
            if (ids := older.get(p)) is not None:
                out[p] = ids
            elif (whole := rank.get(data := p.encode())) is not None:
                out[p] = whole.to_bytes(4, "little")
            elif len(data) <= SIDE_BY_SIDE + 1:
                groups.setdefault(1 << (len(data) - 2).bit_length(), []).append((p, data))
            else:
                out[p] = np.array(self.merge(data), "<u4").tobytes()
        for width, group in groups.items():
            for i in range(0, len(group), GROUP // width):
                some = group[i : i + GROUP // width]
                out.update(zip([p for p, _ in some], self.merge_many([d for _, d in some], width), strict=True))
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        self.known.update(out if max(map(len, out), default=0) <= REMEMBERED_LENGTH else {p: ids for p, ids in out.items() if len(p) <= REMEMBERED_LENGTH})
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The packed tokens of each text; each distinct piece of the texts is merged once."""
        pieces = [self.pieces(t) for t in texts]
        new = set().union(*pieces) - self.known.keys()
        known = self.known
        more = self.learn(new) if new else {}
        get, new_get = known.get, more.get
        return [b"".join([get(p) or new_get(p) for p in some]) for some in pieces]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens; an id outside the table is an error."""
        return b"".join(map(self.token.__getitem__, ids.tolist()))


_tables: dict[tuple[int, str], Ranks] = {}


def _ranks(data: bytes, pattern: str) -> Ranks:
    """One table per worker."""
    key = (hash(data), pattern)
    return _tables[key] if key in _tables else _tables.setdefault(key, Ranks(data, pattern))


def _parts(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """First and end rows of runs of whole values of up to limit bytes together."""
    values = column.value_lengths() if pa.types.is_list(column.type) else pc.binary_length(column)
    bound = np.concatenate(([0], np.cumsum(values.fill_null(0).to_numpy(zero_copy_only=False))))
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(bound, bound[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def _mapped(df: DataFrame, path: str, pattern: str, schema: str, f: Callable[[Ranks, list], Iterable[tuple]]) -> DataFrame:
    """f's tuples for runs of rows' second column, beside the first. The rank file, of a fixed size, is broadcast."""
    with open(path, "rb") as file:
        data = df.sparkSession.sparkContext.broadcast(file.read())
    names = ["key", *(x.split()[0] for x in schema.split(", "))]
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
    kinds = [types[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = _ranks(data.value, pattern)
        for batch in batches:
            for i, j in _parts(batch.column(1)):
                part = batch.slice(i, j - i)
                rows = f(ranks, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    return df.mapInArrow(run, f"key {df.dtypes[0][1]}, {schema}")


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>) of whole texts. Null and empty texts have no ids; repeated rows, null ids and empty tables stay as they are; other columns of docs are not read."""
    out = _mapped(docs.select(id_col, text_col), path, pattern, "ids array<int>", lambda r, x: [(np.frombuffer(ids, "<i4"),) for ids in r.encode_all([t or "" for t in x])])
    return out.withColumnRenamed("key", id_col)


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, bytes binary) from arrays of ids; a null array gives no bytes."""
    out = _mapped(tokens.select(id_col, ids_col), path, "", "bytes binary", lambda r, x: [(r.decode(np.array(ids or [], np.int64)),) for ids in x])
    return out.withColumnRenamed("key", id_col)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256): digests of encode's ids and of what decode gives back, in one pass."""

    def digests(r: Ranks, x: list[str | None]) -> Iterator[tuple]:
        for ids in r.encode_all([t or "" for t in x]):
            yield len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(r.decode(np.frombuffer(ids, "<u4"))).hexdigest()

    out = _mapped(docs.select(id_col, text_col), path, pattern, "n_tokens long, ids_sha256 string, decoded_sha256 string", digests)
    return out.withColumnRenamed("key", id_col)
