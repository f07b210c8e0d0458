"""Byte-level BPE: texts to token ids and back, in padded numpy matrices bucketed by length."""

import base64
from collections.abc import Callable, Iterator, Sequence
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import short_batches, spare_names, text_or_empty, without

OUTPUT = ("token_ids", "decoded")

#: White space as the public pattern means it, and chunks that end where one of its matches ends: a match
#: may begin with one space, and otherwise never holds both white space and anything else.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
COARSE = f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"

#: Cells of one matrix, so that memory does not depend on the number or length of pieces.
MATRIX_CELLS = 1 << 18

#: Longer pieces are cut where no merge can reach across. A part that is still wider is a matrix of one
#: row, whose rounds take along the merges that would follow one by one.
SHARED_WIDTH = 1024

#: Encoded pieces that a task remembers; when full it starts afresh, which changes no result.
CACHED_PIECES = 100_000

_NEVER = np.int32(2**31 - 1)


def _width(size: int) -> int:
    """Bucket of a length: itself up to 16, then powers of two."""
    return size if size <= 16 else 1 << (size - 1).bit_length()


class PairTable:
    """Open-addressing hash table from (left id, right id) to the merged id, with vectorised lookups."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        keys = self.key(left, right)
        bits = max(4, int(len(keys) * 2).bit_length())
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.values = np.full(1 << bits, _NEVER, dtype=np.int32)
        slot = self._home(keys)
        self.probes = 0
        while len(keys):
            _, first = np.unique(slot, return_index=True)
            free = first[self.keys[slot[first]] == -1]
            self.keys[slot[free]], self.values[slot[free]] = keys[free], merged[free]
            left_over = np.ones(len(keys), dtype=bool)
            left_over[free] = False
            keys, merged, slot = keys[left_over], merged[left_over], (slot[left_over] + 1) & self.mask
            self.probes += 1

    @staticmethod
    def key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.int64) << 32) | right.astype(np.int64)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged id of each pair, which is also its rank; ``_NEVER`` for pairs that do not merge."""
        keys = self.key(left, right)
        out = np.full(keys.shape, _NEVER, dtype=np.int32)
        slot = self._home(keys)
        open_ = np.nonzero((left >= 0) & (right >= 0))
        slot, wanted = slot[open_], keys[open_]
        for _ in range(self.probes):
            held = self.keys[slot]
            hit = held == wanted
            out[tuple(axis[hit] for axis in open_)] = self.values[slot[hit]]
            more = ~hit & (held != -1)
            if not more.any():
                break
            open_ = tuple(axis[more] for axis in open_)
            slot, wanted = (slot[more] + 1) & self.mask, wanted[more]
        return out


class Vocabulary:
    """Token ids; the tables for merging are built when a text is first encoded, so that decoding needs none."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.bytes_to_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.flat = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
        self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths

    def _merges(self) -> Iterator[tuple[int, int, int]]:
        """(left id, right id, merged id) of every way to put a token together from two."""
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    yield a, b, rank

    @cached_property
    def pairs(self) -> PairTable:
        found = np.fromiter(self._merges(), dtype=np.dtype((np.int64, 3)))
        return PairTable(found[:, 0], found[:, 1], found[:, 2].astype(np.int32))

    @cached_property
    def joins(self) -> np.ndarray:
        """Whether any token holds these two bytes next to each other, at 256 * first + second."""
        inside = np.ones(len(self.flat), dtype=bool)
        inside[self.starts[self.lengths > 0]] = False
        second = np.flatnonzero(inside)
        out = np.zeros(1 << 16, dtype=bool)
        out[self.flat[second - 1].astype(np.int64) * 256 + self.flat[second]] = True
        return out

    def _parts(self, piece: bytes) -> list[bytes]:
        """The piece, cut between bytes that no token holds together: no merge can reach across."""
        data = np.frombuffer(piece, dtype=np.uint8)
        cuts = np.flatnonzero(~self.joins[data[:-1].astype(np.int64) * 256 + data[1:]]) + 1
        ends = [0, *cuts.tolist(), len(piece)]
        return [piece[a:b] for a, b in zip(ends, ends[1:])]

    def encode_pieces(self, pieces: Sequence[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        rows: list[bytes] = []
        rows_of: dict[int, range] = {}
        for i, piece in enumerate(pieces):
            known = self.ranks.get(piece)
            if known is not None:
                out[i] = known.to_bytes(4, "little")
            else:
                parts = self._parts(piece) if len(piece) > SHARED_WIDTH else [piece]
                rows_of[i] = range(len(rows), len(rows) + len(parts))
                rows += parts
        merged: list[bytes] = [b""] * len(rows)
        by_width: dict[int, list[int]] = {}
        for k, row in enumerate(rows):
            if len(row) > SHARED_WIDTH:
                merged[k] = self._merge_row(row)
            else:
                by_width.setdefault(_width(len(row)), []).append(k)
        for width, members in by_width.items():
            height = max(1, MATRIX_CELLS // width)
            for at in range(0, len(members), height):
                chunk = members[at : at + height]
                for k, ids in zip(chunk, self._merge_rows([rows[k] for k in chunk], width), strict=True):
                    merged[k] = ids
        for i, held in rows_of.items():
            out[i] = b"".join([merged[k] for k in held])
        return out

    def _merge_rows(self, pieces: Sequence[bytes], width: int) -> list[bytes]:
        """Each round every live row merges its leftmost pair of least rank and gets one cell shorter;
        rows without such a pair leave the matrix."""
        sizes = np.array([len(p) for p in pieces])
        ids = np.full((len(pieces), width), -1, dtype=np.int32)
        inside = np.arange(width) < sizes[:, None]
        ids[inside] = self.bytes_to_id[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        ranks = self.pairs.ranks(ids[:, :-1], ids[:, 1:])
        rows = np.arange(len(pieces))
        out: list[bytes] = [b""] * len(pieces)
        while len(rows):
            place = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), dtype=np.int64)
            at = np.arange(len(rows))
            best = ranks[at, place] if ranks.shape[1] else np.full(len(rows), _NEVER)
            live = best != _NEVER
            if not live.all():
                ended = ids[~live]
                data, width = ended.astype("<u4").tobytes(), 4 * ended.shape[1]
                for k, (row, size) in enumerate(zip(rows[~live].tolist(), (4 * (ended >= 0).sum(axis=1)).tolist(), strict=True)):
                    out[row] = data[k * width : k * width + size]
                rows, ids, ranks, place, best = rows[live], ids[live], ranks[live], place[live], best[live]
                at = np.arange(len(rows))
                if not len(rows):
                    break
            ids[at, place] = best
            stays = np.ones(ids.shape, dtype=bool)
            stays[at, place + 1] = False
            ids = ids[stays].reshape(len(rows), -1)
            stays = np.ones(ranks.shape, dtype=bool)
            stays[at, place] = False
            ranks = ranks[stays].reshape(len(rows), -1)
            for shift in (-1, 0):
                first = place + shift
                ok = (first >= 0) & (first < ranks.shape[1])
                ranks[at[ok], first[ok]] = self.pairs.ranks(ids[at[ok], first[ok]], ids[at[ok], first[ok] + 1])
        return out

    def _merge_row(self, piece: bytes) -> bytes:
        """One row alone. A round merges the leftmost pair of least rank and, with it, the further pairs of
        that rank which single rounds would merge next: all up to the first whose merge makes a pair of
        lower rank, inside each cluster of places.

        Until pairs of higher rank have their turn, such a merge can only grow its own token, by at most the
        longest token. So clusters, which lie two longest tokens apart, cannot meet, and the ids are
        those of one merge a round."""
        ids = self.bytes_to_id[np.frombuffer(piece, dtype=np.uint8)]
        sizes = np.ones(len(ids), dtype=np.int64)
        ranks = self.pairs.ranks(ids[:-1], ids[1:])
        apart = 2 * int(self.lengths.max())
        while len(ranks) and (best := ranks.min()) != _NEVER:
            at = np.flatnonzero(ranks == best)
            if len(at) > 1:
                # Of pairs that overlap (a run of one id) the leftmost goes first, and every other one after it.
                turn = np.arange(len(at))
                run = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) > 1, turn, 0))
                at = at[(turn - run) % 2 == 0]
                begin = (np.cumsum(sizes) - sizes)[at]
                after_merge = np.diff(at, prepend=-3) == 2
                left = np.where(after_merge, best, np.where(at > 0, ids[at - 1], -1))
                right = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
                merged = np.full(len(at), best, dtype=np.int32)
                lower = np.minimum(self.pairs.ranks(left, merged), self.pairs.ranks(merged, right)) < best
                if lower.any():
                    first = np.diff(begin, prepend=-apart) >= apart + self.lengths[best]
                    first[0] = True
                    earlier = np.cumsum(lower) - lower
                    at = at[earlier == earlier[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]]
            sizes[at] += sizes[at + 1]
            ids[at] = best
            ids, sizes, ranks = np.delete(ids, at + 1), np.delete(sizes, at + 1), np.delete(ranks, at)
            place = at - np.arange(len(at))
            for first in (place - 1, place):
                first = first[(first >= 0) & (first < len(ranks))]
                ranks[first] = self.pairs.ranks(ids[first], ids[first + 1])
        return ids.astype("<u4").tobytes()

    def decode(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, dtype="<u4").astype(np.int64)
        if not len(ids):
            return b""
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        source = np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - sizes), sizes)
        return self.flat[source].tobytes()


@lru_cache(maxsize=2)
def vocabulary(file: bytes) -> Vocabulary:
    """From the content of a ``.tiktoken`` file; built once per Python worker."""
    return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines()) if a})


def text_encoder(vocab: Vocabulary, pattern: str, coarse: str | None = None) -> Callable[[Sequence[str]], list[bytes]]:
    """Encodes texts chunk by chunk; new chunks of a slice are merged together, known ones remembered.

    ``coarse`` may name a simpler pattern whose matches, the chunks, never cut a match of ``pattern``.
    """
    import re

    import regex

    fine = regex.compile(pattern).findall
    split = re.compile(coarse).findall if coarse else fine
    cache: dict[str, bytes] = {}

    def encode(texts: Sequence[str]) -> list[bytes]:
        parts = [split(text) for text in texts]
        wanted = set().union(*parts)
        new = [p for p in wanted if p not in cache]
        if len(cache) + len(new) > CACHED_PIECES:
            cache.clear()
            new = list(wanted)
        pieces = [fine(chunk) for chunk in new] if coarse else [[chunk] for chunk in new]
        distinct = list(set().union(*pieces))
        encoded = dict(zip(distinct, vocab.encode_pieces([p.encode("utf-8", "surrogatepass") for p in distinct]), strict=True))
        cache.update((chunk, b"".join([encoded[p] for p in held])) for chunk, held in zip(new, pieces, strict=True))
        out = [b"".join(map(cache.__getitem__, part)) for part in parts]
        for chunk in new:
            if len(chunk) > 32:
                del cache[chunk]
        return out

    return encode


def _slices(texts: Sequence[str], characters: int = 500_000) -> Iterator[list[str]]:
    """Consecutive texts of half a million characters together; a longer text stands alone."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > characters:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def read_file(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode_column(text: Column, file: bytes, pattern: str, coarse: str | None = None) -> Column:
    """Token ids packed as little-endian unsigned 32-bit integers. ``file`` travels with the plan."""

    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = text_encoder(vocabulary(file), pattern, coarse)
        for texts in batches:
            yield pd.Series([ids for part in _slices(texts.tolist()) for ids in encoder(part)], dtype=object)

    return encode(text)


def decode_column(packed: Column, file: bytes) -> Column:
    @F.pandas_udf("binary")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocab = vocabulary(file)
        for ids in batches:
            yield pd.Series([vocab.decode(x) for x in ids], dtype=object)

    return decode(packed)


def encode_decode(docs: DataFrame, path: str, pattern: str, coarse: str | None = None, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``token_ids`` (packed ids) and ``decoded`` (bytes of these ids).

    ``path`` is a ``.tiktoken`` file that the driver can open, ``pattern`` splits a text into pieces that
    are merged separately, without special tokens; for ``coarse`` see ``text_encoder``. Null and empty texts give no ids. Every row is worked
    on alone, without any shuffle; a lost task is simply run again. Input columns named like an output
    are replaced.
    """
    docs = without(docs, OUTPUT)
    short_batches(docs.sparkSession)
    file = read_file(path)
    (both,) = spare_names(docs, "ids_and_bytes")

    @F.pandas_udf("token_ids binary, decoded binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vocab = vocabulary(file)
        encoder = text_encoder(vocab, pattern, coarse)
        for texts in batches:
            ids = [x for part in _slices(texts.tolist()) for x in encoder(part)]
            yield pd.DataFrame({"token_ids": ids, "decoded": [vocab.decode(x) for x in ids]})

    # One step for both, so that a task needs one Python worker and one vocabulary.
    done = docs.withColumn(both, run(text_or_empty(text_col)))
    return done.select(*docs.columns, f"{both}.token_ids", f"{both}.decoded")
