"""Steps of random walks over a part of a graph, on arrays of walks.

A walk's number in [0, 1) for a step and a purpose is the same in every run: the low 40 bits of Spark's
xxhash64(seed, walk, step, purpose), integers but for the walk, over 2^40.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_LOW = np.uint64((1 << 40) - 1)
ENDED, VISITED = 0, 1


def _turned(h: np.ndarray, bits: int) -> np.ndarray:
    return (h << np.uint64(bits)) | (h >> np.uint64(64 - bits))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def hash_int(value, seed: np.ndarray) -> np.ndarray:
    """Of values from 0 to 2^31 - 1."""
    h = (seed + (_P5 + np.uint64(4))) ^ (np.asarray(value, "u8") * _P1)
    return _mixed(_turned(h, 23) * _P2 + _P3)


def hash_long(value: np.ndarray, seed: np.ndarray) -> np.ndarray:
    h = (seed + (_P5 + np.uint64(8))) ^ (_turned(value.astype("u8") * _P2, 31) * _P1)
    return _mixed(_turned(h, 27) * _P1 + _P4)


def of_walks(seed: int, walk: np.ndarray) -> np.ndarray:
    """The hash that a walk's numbers go on from."""
    return hash_long(walk, hash_int(np.array([seed & 0xFFFFFFFF]), np.array([42], "u8")))


def chance(hashed: np.ndarray, purpose: int) -> np.ndarray:
    """hashed: of seed, walk and step."""
    return (hash_int(np.array([purpose]), hashed) & _LOW).astype("f8") / float(1 << 40)


@dataclass
class Rules:
    """Nodes, nodes a part, copies of each part, bytes of a place, and what walks follow; see graph.walk_visits."""

    n: int
    each: int
    copies: list[int]
    width: int
    jumps: bool
    bored: float
    seed: int
    bands: list[int]
    kinds: tuple[int, ...]
    step_bits: int
    first: list[int] = field(init=False)

    def __post_init__(self) -> None:
        self.first = [0, *np.cumsum(self.copies).tolist()]

    def part_of(self, group: int) -> int:
        return int(np.searchsorted(self.first, group, "right")) - 1

    def sent(self, state: np.ndarray, place: np.ndarray) -> list[tuple[int, bytes, bytes]]:
        """group, states, places (within their part) of walks by the group that they go to."""
        if not len(state):
            return []
        part = place // self.each
        group = np.asarray(self.first)[part] + (state >> self.step_bits) % np.asarray(self.copies)[part]
        order = np.argsort(group, kind="stable")
        group, state, inside = group[order], state[order], (place - part * self.each)[order].astype("<i4" if self.width == 4 else "<i8")
        cuts = np.flatnonzero(np.diff(group)) + 1
        return [(int(group[a]), state[a:b].tobytes(), inside[a:b].tobytes()) for a, b in zip([0, *cuts], [*cuts, len(group)])]


SCHEMA = pa.schema([("group", pa.int32()), ("states", pa.binary()), ("places", pa.binary()), ("place", pa.int64()), ("code", pa.int32()), ("n", pa.int64())])


def _walks(rows: list[tuple[int, bytes, bytes]]) -> pa.Table:
    g, s, p = zip(*rows) if rows else ((), (), ())
    none = [pa.nulls(len(g), SCHEMA.field(c).type) for c in ("place", "code", "n")]
    return pa.table([pa.array(g, pa.int32()), pa.array(s, pa.binary()), pa.array(p, pa.binary()), *none], schema=SCHEMA)


def packing(rules: Rules) -> Callable[[pa.Table], pa.Table]:
    """Rows part, place, block, ends (places) of one part as one row: where each place's links begin, and their ends."""

    def packed(rows: pa.Table) -> pa.Table:
        part, place = rows["part"][0].as_py(), rows["place"].to_numpy()
        order = np.lexsort((rows["block"].to_numpy(), place))
        lists = rows["ends"].combine_chunks()
        lists = lists.take(pa.array(order))
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        ends = lists.flatten().to_numpy(zero_copy_only=False).astype("<i4" if rules.width == 4 else "<i8")
        out = np.bincount(place[order] - part * rules.each, weights=sizes, minlength=rules.each).astype("<i8")
        offsets = np.concatenate([[0], np.cumsum(out)]).astype("<i8")
        return pa.table({"part": pa.array([part], pa.int32()), "offsets": pa.array([offsets.tobytes()], pa.binary()), "ends": pa.array([ends.tobytes()], pa.binary())})

    return packed


def beginning(rules: Rules, walks: int, starts: tuple[bool, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows id as walks at their first places, of each kind of start."""

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            ids = np.concatenate(held)
            for cyclic in starts:
                walk = ids[ids < walks // rules.n * rules.n] if cyclic else ids
                place = walk % rules.n if cyclic else np.floor(chance(hash_int(np.array([0]), of_walks(rules.seed, walk)), 3) * rules.n).astype("i8")
                state = (walk << rules.step_bits) | (1 << 2) | (int(cyclic) << 1) | 1
                yield from _walks(rules.sent(state, place)).to_batches()

        held, size = [], 0
        for b in batches:
            held.append(b.column(0).to_numpy(zero_copy_only=False))
            size += b.num_rows
            if size >= 1 << 20:
                yield from made(held)
                held, size = [], 0
        if held:
            yield from made(held)

    return begun


def stepping(rules: Rules, chunk: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The walks that have come to a part (rows of SCHEMA) and the part: walks that leave it, and counts of marks by place and
    code, which is start, kind and band as one number. Counts that come with the walks go on as they are."""

    def stepped(came: pa.Table, graph: pa.Table) -> pa.Table:
        kept = came.filter(came["n"].is_valid())
        came = came.filter(came["states"].is_valid())
        if not came.num_rows:
            return kept
        part = rules.part_of(came["group"][0].as_py())
        low = part * rules.each
        small = "<i4" if rules.width == 4 else "<i8"
        if graph.num_rows:
            offsets, ends = np.frombuffer(graph["offsets"][0].as_buffer(), "<i8"), np.frombuffer(graph["ends"][0].as_buffer(), small)
        else:
            offsets, ends = np.zeros(rules.each + 1, "i8"), np.zeros(1, small)
        if not len(ends):
            ends = np.zeros(1, small)
        bands, width = np.asarray(rules.bands), len(rules.bands) + 1
        counts = np.zeros(4 * width * rules.each, "i8")
        gone_state, gone_place = [], []

        def mark(kind: int, inside: np.ndarray, cyclic: np.ndarray, band: np.ndarray) -> None:
            if kind in rules.kinds:
                np.add.at(counts, ((cyclic * 2 + kind) * width + band) * rules.each + inside, 1)

        def run(state: np.ndarray, inside: np.ndarray) -> None:
            walk, step = state >> rules.step_bits, (state >> 2) & ((1 << rules.step_bits - 2) - 1)
            cyclic, whole = (state >> 1) & 1, (state & 1) == 1
            hashed, band = of_walks(rules.seed, walk), np.searchsorted(bands, walk, "right")
            while len(walk):
                now = hash_int(step, hashed)
                on = chance(now, 1) > rules.bored
                mark(ENDED, inside[~on], cyclic[~on], band[~on])
                walk, step, cyclic, whole, hashed, band, inside, now = (x[on] for x in (walk, step, cyclic, whole, hashed, band, inside, now))
                mark(VISITED, inside[whole], cyclic[whole], band[whole])
                begin = offsets[inside]
                out = offsets[inside + 1] - begin
                bare = out == 0
                there = ends[np.where(bare, 0, begin + (chance(now, 2) * out).astype("i8"))].astype("i8")
                if bare.any():
                    if rules.jumps:
                        there[bare] = np.floor(chance(now[bare], 3) * rules.n).astype("i8")
                        whole = whole & ~bare
                    else:
                        on = ~bare
                        walk, step, cyclic, whole, hashed, band, there = (x[on] for x in (walk, step, cyclic, whole, hashed, band, there))
                step = step + 1
                inside = there - low
                here = (inside >= 0) & (inside < rules.each)
                if not here.all():
                    away = ~here
                    gone_state.append((walk[away] << rules.step_bits) | (step[away] << 2) | (cyclic[away] << 1) | whole[away])
                    gone_place.append(there[away])
                    walk, step, cyclic, whole, hashed, band, inside = (x[here] for x in (walk, step, cyclic, whole, hashed, band, inside))

        states = np.concatenate([np.frombuffer(x.as_buffer(), "<i8") for x in came["states"]])
        places = np.concatenate([np.frombuffer(x.as_buffer(), small) for x in came["places"]])
        for k in range(0, len(states), chunk):
            run(states[k : k + chunk], places[k : k + chunk].astype("i8"))
        at = np.flatnonzero(counts)
        group = came["group"][0].as_py()
        marks = pa.table([pa.array(np.full(len(at), group), pa.int32()), pa.nulls(len(at), pa.binary()), pa.nulls(len(at), pa.binary()), pa.array(at % rules.each + low), pa.array((at // rules.each).astype("i4")), pa.array(counts[at])], schema=SCHEMA)
        gone = _walks(rules.sent(np.concatenate(gone_state), np.concatenate(gone_place)) if gone_state else [])
        return pa.concat_tables([kept.cast(SCHEMA), marks, gone])

    return stepped
