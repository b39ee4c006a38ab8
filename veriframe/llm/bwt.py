"""Burrows-Wheeler transforms of string collections, merged by interleave refinement.

A shard is a collection of byte strings, each with a terminator of its own that sorts before every byte. Shards are
sorted once, each by itself. Two shards are merged without sorting suffixes again: an interleave vector says for
each place of the common order which shard it belongs to; reading the shards' transforms along it and dealing the
places out by symbol gives the interleave by one symbol more. Places whose predecessors lie in one block and have
one symbol stay in one block, so a boundary that first shows up in round h marks a common prefix of h - 1. After
``depth`` rounds the blocks with two places or more are the repeated strings of that length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Shard:
    """``symbols``: the transform (0 for a terminator); ``place``: each suffix's position in the concatenation of the
    shard's strings, each with its terminator; ``strings``: their number."""

    symbols: np.ndarray
    place: np.ndarray
    strings: int


def coded(strings: list[bytes], length: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Strings as symbols of several bytes, so that a round settles several bytes at once: each string becomes one
    string for every phase. The width divides ``length`` and is the largest of 4, 2 and 1 whose symbols fit 16 bits.
    Returns (width, sizes, symbols, owner, offset): the sizes of the phase strings with terminators, and for each
    position its symbol (0 for a terminator), its string and its byte offset there."""
    data = np.frombuffer(b"".join(strings), dtype=np.uint8)
    lengths = np.array([len(s) for s in strings], dtype=np.int64)
    owner = np.repeat(np.arange(len(strings)), lengths)
    offset = np.arange(len(data)) - (np.cumsum(lengths) - lengths)[owner]
    for width in (4, 2, 1):
        if length % width:
            continue
        room = np.flatnonzero(offset + width <= lengths[owner])
        value = np.zeros(len(room), dtype=np.uint32)
        for k in range(width):
            value = (value << np.uint32(8)) | data[room + k]
        known, code = np.unique(value, return_inverse=True)
        if len(known) < 65_535:
            break
    phases = owner[room] * width + offset[room] % width
    order = np.lexsort((offset[room], phases))
    phases, room, code = phases[order], room[order], code[order]
    first = np.flatnonzero(np.append(True, phases[1:] != phases[:-1])) if len(room) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.append(first, len(room))) + 1
    at = np.arange(len(room)) + np.repeat(np.arange(len(first)), sizes - 1)
    n = len(room) + len(first)
    symbols, owners, offsets = np.zeros(n, dtype=np.uint16), np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int64)
    symbols[at], owners[at], offsets[at] = code + 1, owner[room], offset[room]
    return width, sizes, symbols, owners, offsets


def build(text: np.ndarray, sizes: np.ndarray) -> Shard:
    """Sort one shard's suffixes by prefix doubling and take the symbols before them."""
    n, m = len(text), len(sizes)
    rank = np.where(text == 0, np.repeat(np.arange(m), sizes), text.astype(np.int64) + m)
    first = np.zeros(n, dtype=bool)
    first[np.cumsum(sizes) - sizes] = True
    width, order = 1, np.argsort(rank, kind="stable")
    while n:
        sorted_rank = rank[order]
        new = np.cumsum(np.append(0, sorted_rank[1:] != sorted_rank[:-1]))
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            break
        ahead = rank[np.minimum(np.arange(n) + width, n - 1)]  # past a terminator the order is settled already
        rank = rank * n + ahead
        order = np.argsort(rank, kind="stable")
        width *= 2
    before = np.where(first[order], 0, text[order - 1])
    return Shard(before.astype(np.uint16), order, m)


def merge(a: Shard, b: Shard, depth: int) -> tuple[Shard, np.ndarray, np.ndarray]:
    """The merged shard (places of ``b`` are numbered on after ``a``'s), the interleave, and each place's common
    prefix with the place before it, ``depth`` where it is at least that."""
    n, m = len(a.symbols) + len(b.symbols), a.strings + b.strings
    fixed = np.repeat(np.array([False, True]), [a.strings, b.strings])
    z = np.repeat(np.array([False, True]), [len(a.symbols), len(b.symbols)])
    block = np.zeros(n, dtype=np.int32)
    prefix = np.full(n, depth, dtype=np.int32)
    symbols = np.empty(n, dtype=np.uint16)
    for h in range(depth):
        symbols[~z] = a.symbols
        symbols[z] = b.symbols
        order = np.argsort(symbols, kind="stable")
        z = z[order]
        z[:m] = fixed  # terminators are in the order of their strings
        sorted_symbols, sorted_block = symbols[order], block[order]
        start = np.empty(n, dtype=bool)
        start[0] = True
        start[1:] = (sorted_symbols[1:] != sorted_symbols[:-1]) | (sorted_block[1:] != sorted_block[:-1])
        start[:m] = True
        prefix[start & (prefix == depth)] = h
        count = int(start.sum())
        if count == n or h and count == before and (z == z_before).all():  # noqa: F821  nothing is left to refine
            if count == n:
                break
        before, z_before = count, z
        block = np.cumsum(start, dtype=np.int32)
    symbols[~z] = a.symbols
    symbols[z] = b.symbols
    place = np.empty(n, dtype=np.int64)
    place[~z] = a.place
    place[z] = b.place + len(a.symbols)
    return Shard(symbols, place, m), z, prefix


def repeated(strings: list[bytes], length: int, shard_bytes: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of every position of the collection whose next ``length`` bytes occur at another position
    too. Shards of about ``shard_bytes`` are built apart and merged in turn."""
    none = np.zeros(0, dtype=np.int64)
    width, sizes, text, owner, offset = coded(strings, length) if strings else (1, none, none, none, none)
    if not len(sizes):
        return none, none
    parts = max(2, -(-len(text) // shard_bytes))
    edges = sorted({round(k * len(sizes) / parts) for k in range(parts + 1)})
    ends = np.append(0, np.cumsum(sizes))
    shards = [build(text[ends[x] : ends[y]], sizes[x:y]) for x, y in zip(edges[:-1], edges[1:], strict=True)]
    if len(shards) == 1:
        shards.append(Shard(np.zeros(0, dtype=np.uint16), none, 0))
    while len(shards) > 1:
        merged = [merge(shards[k], shards[k + 1], length // width) for k in range(0, len(shards) - 1, 2)]
        prefix = merged[-1][2]
        shards = [x[0] for x in merged] + shards[len(shards) - len(shards) % 2 :]
    same = prefix >= length // width
    place = np.sort(shards[0].place[same | np.append(same[1:], False)])
    return owner[place], offset[place]
