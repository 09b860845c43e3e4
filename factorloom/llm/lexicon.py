"""A minimal acyclic transducer from words to token ids, kept in one file that tasks map into memory.

Words that end alike share states. Each transition carries how many words precede it, so the sum along a word's path
is the word's place in byte order, which indexes the ids.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np

MIX = np.uint64(0x9E3779B97F4A7C15)


def save_arrays(path: str, arrays: dict[str, np.ndarray]) -> None:
    """Arrays one after the other behind a JSON head with their places."""
    places, at = {}, 0
    for name, a in arrays.items():
        places[name] = (a.dtype.str, len(a), at)
        at += -(-a.nbytes // 64) * 64
    head = json.dumps(places).encode()
    with open(path, "wb") as f:
        f.write(len(head).to_bytes(8, "little") + head)
        f.write(b"\0" * (-f.tell() % 64))
        for a in arrays.values():
            f.write(a.tobytes() + b"\0" * (-a.nbytes % 64))


def map_arrays(path: str) -> dict[str, np.ndarray]:
    """Views of a file of :func:`save_arrays`, mapped, not read."""
    raw = np.memmap(path, np.uint8, "r")
    size = int.from_bytes(raw[:8].tobytes(), "little")
    start = -(-(8 + size) // 64) * 64
    return {k: np.frombuffer(raw, dtype, n, start + at) for k, (dtype, n, at) in json.loads(raw[8 : 8 + size].tobytes()).items()}


def compile_words(words: Sequence[bytes]) -> dict[str, np.ndarray]:
    """The minimal automaton of sorted, distinct, non-empty words: sorted keys state*256+byte, targets, skips, and each state's end flag."""
    parent, byte, final, path, before = [-1], [0], [False], [0], b""
    for word in words:
        same = 0
        while same < len(before) and same < len(word) and before[same] == word[same]:
            same += 1
        del path[same + 1 :]
        for b in word[same:]:
            parent.append(path[-1])
            byte.append(b)
            final.append(False)
            path.append(len(parent) - 1)
        final[path[-1]] = True
        before = word
    parent, byte, final = np.array(parent), np.array(byte, np.uint64), np.array(final)
    n = len(parent)
    depth, height, count = np.zeros(n, np.int32), np.zeros(n, np.int32), final.astype(np.int64)
    for i, p in enumerate(parent.tolist()):
        if p >= 0:
            depth[i] = depth[p] + 1
    for d in range(int(depth.max(initial=0)), 0, -1):
        at = np.flatnonzero(depth == d)
        np.add.at(count, parent[at], count[at])
        np.maximum.at(height, parent[at], height[at] + 1)
    # Children come after their elder siblings, in byte order: words that precede a child inside its parent's subtree.
    skip, seen = np.zeros(n, np.int64), final.astype(np.int64)
    for i, (p, c) in enumerate(zip(parent.tolist(), count.tolist(), strict=True)):
        if p >= 0:
            skip[i] = seen[p]
            seen[p] += c
    state, sign, first, states = np.zeros(n, np.int64), final.astype(np.uint64) * np.uint64(3), [], 0
    for h in range(int(height.max(initial=0)) + 1):
        at = np.flatnonzero(height == h)
        _, where, inverse = np.unique(sign[at], return_index=True, return_inverse=True)
        state[at] = inverse + states
        first.append(at[where])
        states += len(where)
        at = at[parent[at] >= 0]
        mixed = (state[at].astype(np.uint64) * np.uint64(256) + byte[at] + np.uint64(1)) * MIX
        mixed ^= mixed >> np.uint64(29)
        np.add.at(sign, parent[at], mixed * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(1))
    chosen = np.zeros(n, bool)
    chosen[np.concatenate(first)] = True
    edges = np.flatnonzero(np.concatenate([[False], chosen[parent[1:]]]))
    keys = state[parent[edges]] * 256 + byte[edges].astype(np.int64)
    order = np.argsort(keys)
    ends = np.zeros(states, bool)
    ends[state] = final
    return {"keys": keys[order], "targets": state[edges][order], "skips": skip[edges][order], "ends": ends, "root": state[:1]}


def places_of(auto: dict[str, np.ndarray], words: Sequence[bytes]) -> np.ndarray:
    """Each word's place in byte order among the automaton's words, -1 if it isn't one; all words walk together."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    buffer = np.frombuffer(b"".join(words), np.uint8)
    starts = np.cumsum(lengths) - lengths
    at, place, dead = np.full(len(words), auto["root"][0]), np.zeros(len(words), np.int64), np.zeros(len(words), bool)
    keys, last, alive, step = auto["keys"], len(auto["keys"]) - 1, np.flatnonzero(lengths > 0), 0
    dead[lengths == 0] = True
    while len(alive):
        want = at[alive] * 256 + buffer[starts[alive] + step]
        edge = np.minimum(np.searchsorted(keys, want), max(last, 0))
        good = (keys[edge] == want) if last >= 0 else np.zeros(len(alive), bool)
        dead[alive[~good]] = True
        alive, edge, step = alive[good], edge[good], step + 1
        at[alive], place[alive] = auto["targets"][edge], place[alive] + auto["skips"][edge]
        alive = alive[lengths[alive] > step]
    return np.where(~dead & auto["ends"][at], place, -1)


def gather_runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all runs [start, start + length), one after the other."""
    total = int(lengths.sum())
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)
