"""Arrays packed into one compressed value, and words numbered in the order in which they come."""

from __future__ import annotations

import struct

import numpy as np
import zstandard

LEVEL = 3


class Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def small(a: np.ndarray) -> np.ndarray:
    """The same numbers in the narrowest unsigned type."""
    top = int(a.max(initial=0))
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def pack(*arrays: np.ndarray, level: int = LEVEL) -> bytes:
    """Integers are laid out byte by byte, as their upper bytes are alike."""
    head = b"".join(struct.pack("<cI", a.dtype.char.encode(), len(a)) for a in arrays)
    body = (np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"" for a in arrays)
    return zstandard.compress(struct.pack("<B", len(arrays)) + head + b"".join(body), level)


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    at, out, heads = 1, [], []
    for _ in range(raw[0]):
        heads.append(struct.unpack_from("<cI", raw, at))
        at += struct.calcsize("<cI")
    for code, n in heads:
        kind = np.dtype(code.decode())
        size = n * kind.itemsize
        planes = np.frombuffer(raw, dtype=np.uint8, count=size, offset=at).reshape(kind.itemsize, -1)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel() if n else np.zeros(0, dtype=kind))
        at += size
    return out


def by_group(keys: np.ndarray, groups: int):
    """Each group that occurs among keys, with the positions of its keys in their order."""
    order = np.argsort(keys, kind="stable").astype(np.int32)
    edges = np.concatenate(([0], np.cumsum(np.bincount(keys, minlength=groups))))
    for g in np.flatnonzero(np.diff(edges)):
        yield int(g), order[edges[g] : edges[g + 1]]
