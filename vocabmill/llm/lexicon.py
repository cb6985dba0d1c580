"""Minimal acyclic transducer: words to numbers, with shared prefixes and suffixes.

Built from sorted words. When no later word can pass a state any more, the
least of its outputs moves to the transition that leads there, and the state is
replaced by an equal one that exists already. So words that differ by a
constant in all their outputs share their suffixes. The result is a double
array that is mapped into memory and walked by many words at once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


class _State:
    __slots__ = ("final", "edges")

    def __init__(self):
        self.final, self.edges = -1, {}  # edges: symbol -> [output, target]


def build(words: Sequence[str], outputs: Sequence[int]) -> dict[str, np.ndarray]:
    """The transducer's arrays. ``words`` are distinct, outputs are not negative."""
    order = sorted(range(len(words)), key=words.__getitem__)
    alphabet = sorted({c for w in words for c in w})
    symbol = {c: i + 1 for i, c in enumerate(alphabet)}
    register: dict[tuple, int] = {}
    frozen: list[tuple] = []

    def freeze(state: _State) -> tuple[int, int]:
        """The number of the equal state, and what moves to the transition before it."""
        least = min(([state.final] if state.final >= 0 else []) + [e[0] for e in state.edges.values()])
        key = (state.final - least if state.final >= 0 else -1, tuple((s, out - least, to) for s, (out, to) in state.edges.items()))
        if key not in register:
            register[key] = len(frozen)
            frozen.append(key)
        return register[key], least

    path, last = [_State()], ""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            number, least = freeze(path.pop())
            path[-1].edges[symbol[last[len(path) - 1]]] = [least, number]

    for i in order:
        word, common = words[i], 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        close(common)
        path += [_State() for _ in word[common:]]
        path[-1].final, last = outputs[i], word
    close(0)
    root = path[0]
    start = (root.final, tuple((s, out, to) for s, (out, to) in root.edges.items()))
    frozen.append(start)
    return {"alphabet": np.array([ord(c) for c in alphabet], np.uint32), **_double_array(frozen)}


def _double_array(states: list[tuple]) -> dict[str, np.ndarray]:
    """Each state's transitions at its base plus their symbols; the last state is where words start."""
    base = np.zeros(len(states), np.int32)
    final = np.array([s[0] for s in states], np.int32)
    owner = [-1] * 1024
    low: dict[int, int] = {}  # where the search starts, by number of transitions: they fit in behind one another
    for number in sorted(range(len(states)), key=lambda n: -len(states[n][1])):
        symbols = [e[0] for e in states[number][1]]
        if not symbols:
            continue
        at = low.get(len(symbols), 0)
        while True:
            if at + symbols[-1] + 1024 > len(owner):
                owner += [-1] * (len(owner) + symbols[-1] + 1024)
            if all(owner[at + s] < 0 for s in symbols):
                break
            at += 1
        # Not back to gaps that many before could not use; single transitions fill every gap.
        low[len(symbols)] = at if len(symbols) > 1 else max(at, 0)
        for s in symbols:
            owner[at + s] = number
        base[number] = at
    check = np.array(owner, np.int32)
    target, output = np.zeros(len(owner), np.int32), np.zeros(len(owner), np.int32)
    for number, (_, edges) in enumerate(states):
        for s, out, to in edges:
            target[base[number] + s], output[base[number] + s] = to, out
    return {"base": base, "final": final, "check": check, "target": target, "output": output}


class Lexicon:
    """Walks the arrays of ``build``."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.base, self.final, self.check, self.target, self.output = (
            arrays[name] for name in ("base", "final", "check", "target", "output")
        )
        self.symbols = np.zeros(0x110000, np.int32)
        self.symbols[arrays["alphabet"]] = np.arange(1, len(arrays["alphabet"]) + 1, dtype=np.int32)

    def walk(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The sum of outputs of each word ``codes[start:end]``; -1 for unknown words."""
        total = np.full(len(starts), -1, np.int64)
        symbols = self.symbols[codes]
        word, at, left = np.arange(len(starts)), starts.astype(np.int32), (ends - starts).astype(np.int32)
        state = np.full(len(starts), len(self.base) - 1, np.int32)
        summed = np.zeros(len(starts), np.int64)
        while len(word):
            symbol = symbols[at]
            slot = self.base[state] + symbol
            good = (self.check[slot] == state) & (symbol > 0)
            if not good.all():
                word, at, left, slot, summed = word[good], at[good], left[good], slot[good], summed[good]
            summed += self.output[slot]
            state = self.target[slot]
            at += 1
            left -= 1
            over = left == 0
            if over.any():
                final = self.final[state[over]]
                total[word[over]] = np.where(final >= 0, summed[over] + final, -1)
                more = ~over
                word, at, left, state, summed = word[more], at[more], left[more], state[more], summed[more]
        return total
