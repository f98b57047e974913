"""Ranges of an HDF5 file as arrays: superblock, object headers, groups, contiguous and chunked data sets.

Reads the format's first generation (superblock 0 and 1, headers of version 1,
groups of symbol tables, chunks in a B-tree, deflate and shuffle filters),
which count matrices are written in. Only the bytes asked for are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

from cohortlens.errors import DatasetError

MAGIC = b"\x89HDF\r\n\x1a\n"
#: Message types of an object header (fixed values of the format).
SPACE, TYPE, LAYOUT, FILTERS, MORE, GROUP = 0x01, 0x03, 0x08, 0x0B, 0x10, 0x11
DEFLATE, SHUFFLE, CHECKSUM = 1, 2, 3
MISSING = (1 << 64) - 1


@dataclass(frozen=True)
class Chunk:
    """Elements from ``first`` on, at ``address`` in the file; ``mask`` has a bit for each filter that was left out."""

    first: int
    address: int
    size: int
    mask: int


@dataclass(frozen=True)
class Array:
    """A one-dimensional data set. ``text`` means strings of any length, which lie in heaps elsewhere."""

    length: int
    dtype: np.dtype
    text: bool
    address: int
    chunk_length: int
    filters: tuple[int, ...]
    compact: bytes | None = None


def _int(raw: bytes, at: int, size: int) -> int:
    return int.from_bytes(raw[at : at + size], "little")


class File:
    """``read`` gives the bytes of (offset, size)."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self.read, self.base = read, 0
        while read(self.base, 8) != MAGIC:
            self.base = max(512, 2 * self.base)
            if self.base > 1 << 20 or len(read(self.base, 8)) < 8:
                raise DatasetError("not an HDF5 file")
        head = self.at(0, 96)
        if head[8] > 1 or head[13] != 8 or head[14] != 8:
            raise DatasetError("only HDF5 files of the first format generation can be read")
        entry = 24 + 32 + 4 * (head[8] == 1)
        self.root = _int(head, entry + 8, 8)

    def at(self, address: int, size: int) -> bytes:
        found = self.read(self.base + address, size)
        if len(found) < size and address:
            raise DatasetError("the HDF5 file is cut short")
        return found

    def messages(self, address: int) -> list[tuple[int, bytes]]:
        head = self.at(address, 16)
        if head[0] != 1:
            raise DatasetError("only HDF5 object headers of version 1 can be read")
        spans, out, left = [(address + 16, _int(head, 8, 4))], [], _int(head, 2, 2)
        while spans and left:
            start, size = spans.pop(0)
            raw, at = self.at(start, size), 0
            while at + 8 <= size and left:
                kind, n = _int(raw, at, 2), _int(raw, at + 2, 2)
                body = raw[at + 8 : at + 8 + n]
                at, left = at + 8 + n, left - 1
                if kind == MORE:
                    spans.append((_int(body, 0, 8), _int(body, 8, 8)))
                else:
                    out.append((kind, body))
        return out

    def children(self, address: int) -> dict[str, int] | None:
        """Names and header addresses of a group; None for what isn't one."""
        table = next((b for k, b in self.messages(address) if k == GROUP), None)
        if table is None:
            return None
        heap = self.at(_int(table, 8, 8), 32)
        names = self.at(_int(heap, 24, 8), _int(heap, 8, 8))
        out: dict[str, int] = {}
        for node in self._leaves(_int(table, 0, 8), 8, lambda key: None):
            head = self.at(node[1], 8)
            rows = self.at(node[1] + 8, 40 * _int(head, 6, 2))
            for at in range(0, len(rows), 40):
                name = names[_int(rows, at, 8) :]
                out[name[: name.index(b"\0")].decode()] = _int(rows, at + 8, 8)
        return out

    def _leaves(self, address: int, key_size: int, key_of: Callable[[bytes], object]) -> Iterator[tuple[object, int]]:
        """(key, child) of the leaves of a B-tree of version 1."""
        if address == MISSING:
            return
        head = self.at(address, 24)
        if head[:4] != b"TREE":
            raise DatasetError("a B-tree of the HDF5 file is damaged")
        n, level, step = _int(head, 6, 2), head[5], key_size + 8
        raw = self.at(address + 24, n * step)
        for at in range(0, n * step, step):
            child = _int(raw, at + key_size, 8)
            if level:
                yield from self._leaves(child, key_size, key_of)
            else:
                yield key_of(raw[at : at + key_size]), child

    def array(self, address: int) -> Array:
        found = dict(self.messages(address))
        space, kind, layout = (found.get(k) for k in (SPACE, TYPE, LAYOUT))
        if space is None or kind is None or layout is None or space[1] != 1 or layout[0] != 3:
            raise DatasetError("a data set of the HDF5 file isn't a plain one-dimensional array")
        length, size = _int(space, 8 if space[0] == 1 else 4, 8), _int(kind, 4, 4)
        order = ">" if kind[1] & 1 else "<"
        base = kind[0] & 15
        if base not in (0, 1, 3, 9):
            raise DatasetError(f"HDF5 type class {base} can't be read")
        dtype = np.dtype({0: f"{order}{'i' if kind[1] & 8 else 'u'}{size}", 1: f"{order}f{size}", 3: f"S{size}", 9: f"V{size}"}[base])
        filters = _filters(found[FILTERS]) if FILTERS in found else ()
        if layout[1] == 0:
            return Array(length, dtype, base == 9, 0, 0, filters, layout[4 : 4 + _int(layout, 2, 2)])
        if layout[1] == 1:
            return Array(length, dtype, base == 9, _int(layout, 2, 8), 0, filters)
        return Array(length, dtype, base == 9, _int(layout, 3, 8), _int(layout, 11, 4), filters)

    def chunks(self, of: Array) -> list[Chunk]:
        key = lambda k: (_int(k, 8, 8), _int(k, 0, 4), _int(k, 4, 4))
        return sorted((Chunk(first, child, size, mask) for (first, size, mask), child in self._leaves(of.address, 24, key)), key=lambda c: c.first)

    def values(self, of: Array, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Elements from ``start`` to ``stop``; places that were never written are 0."""
        stop = of.length if stop is None else min(stop, of.length)
        n, item = max(0, stop - start), of.dtype.itemsize
        if of.compact is not None:
            out = np.frombuffer(of.compact, of.dtype)[start:stop]
        elif not of.chunk_length:
            raw = b"" if of.address == MISSING else self.at(of.address + start * item, n * item)
            out = np.frombuffer(raw, of.dtype) if raw else np.zeros(n, of.dtype)
        else:
            out = np.zeros(n, of.dtype)
            for c in self.chunks(of):
                if c.first < stop and c.first + of.chunk_length > start:
                    got = np.frombuffer(_unfiltered(self.at(c.address, c.size), of.filters, c.mask, item), of.dtype)
                    a, b = max(start, c.first), min(stop, c.first + of.chunk_length)
                    out[a - start : b - start] = got[a - c.first : b - c.first]
        return self._texts(out) if of.text else out

    def strings(self, of: Array, start: int = 0, stop: int | None = None) -> list[str]:
        return [x.decode() if isinstance(x, bytes) else str(x) for x in self.values(of, start, stop).tolist()]

    def _texts(self, references: np.ndarray) -> np.ndarray:
        heaps: dict[int, dict[int, bytes]] = {}
        out = []
        for r in (x.tobytes() for x in references):
            address, number = _int(r, 4, 8), _int(r, 12, 4)
            if address not in heaps:
                raw = self.at(address, _int(self.at(address, 16), 8, 8))
                heaps[address], at = {}, 16
                while at + 16 <= len(raw) and _int(raw, at, 2):
                    size = _int(raw, at + 8, 8)
                    heaps[address][_int(raw, at, 2)] = raw[at + 16 : at + 16 + size]
                    at += 16 + -(-size // 8) * 8
            out.append(heaps[address][number][: _int(r, 0, 4)])
        return np.array(out, object)


def _filters(body: bytes) -> tuple[int, ...]:
    first, at, out = body[0] == 1, 8 if body[0] == 1 else 2, []
    for _ in range(body[1]):
        kind = _int(body, at, 2)
        named = first or kind >= 256
        name = _int(body, at + 2, 2) if named else 0
        at += 4 if named else 2
        values = _int(body, at + 2, 2)
        at += 4 + name + 4 * values + 4 * (first and values % 2)
        if kind not in (DEFLATE, SHUFFLE, CHECKSUM):
            raise DatasetError(f"HDF5 filter {kind} can't be undone")
        out.append(kind)
    return tuple(out)


def _unfiltered(raw: bytes, filters: tuple[int, ...], mask: int, item: int) -> bytes:
    for i, kind in reversed(list(enumerate(filters))):
        if mask >> i & 1:
            continue
        if kind == DEFLATE:
            raw = zlib.decompress(raw)
        elif kind == CHECKSUM:
            raw = raw[:-4]
        elif item > 1:
            whole = len(raw) // item * item
            raw = np.frombuffer(raw[:whole], np.uint8).reshape(item, -1).T.tobytes() + raw[whole:]
    return raw
