"""Automata over many sources at once: dense transitions, all sources advanced together.

Automata of few states run over blocks: what a block of bytes does to each state is found for all
blocks of all sources together, byte by byte, and a source's blocks are applied one after the
other. So one very long source is as fast as many short ones. Automata of more states advance one state for each source.
"""

from __future__ import annotations

import numpy as np

from .encode import run_dfa

#: States that blocks are run for at most, and bytes of a block.
FEW, BLOCK = 8, 256
#: Bytes that are turned into blocks at a time.
PIECE = 4 << 20
#: Sources that are advanced together at least; fewer go one by one.
TOGETHER = 16
_NONE = 256  # stands behind a block's bytes and changes nothing


class Automaton:
    def __init__(self, transitions: dict[tuple[int, int], tuple[int, int]], accepts: dict[int, tuple[int, int]], start: int):
        self.given = transitions, accepts, start
        names = sorted({start, *accepts, *(a for a, _ in transitions), *(z for z, _ in transitions.values())})
        number = {name: k for k, name in enumerate(names)}
        self.dead, self.start = len(names), number[start]
        width = _NONE + 1
        step = np.full((len(names) + 1, width), self.dead, np.int64)
        cost = np.zeros((len(names) + 1, width), np.int64)
        step[:, _NONE] = np.arange(len(names) + 1)
        for (a, byte), (z, c) in transitions.items():
            step[number[a], byte], cost[number[a], byte] = number[z], c
        self.step, self.cost = (step * width).reshape(-1).astype(np.int32), cost.reshape(-1)
        self.width, self.largest = width, int(np.abs(cost).max(initial=0))
        self.token, self.last = np.zeros(len(names) + 1, np.int64), np.zeros(len(names) + 1, np.int64)
        self.accepts = np.zeros(len(names) + 1, bool)
        for a, (token, c) in accepts.items():
            self.token[number[a]], self.last[number[a]], self.accepts[number[a]] = token, c, True

    def run(self, sources: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each source whether all of it is accepted, the token and the cost."""
        longest = max(map(len, sources), default=0)
        if self.largest * longest >= 1 << 62:  # beyond 64 bits: one by one
            found = [run_dfa(*self.given, s) for s in sources]
            good = np.array([f is not None for f in found], bool)
            return good, np.array([f[0] if f else 0 for f in found], np.int64), np.array([f[1] if f else 0 for f in found])
        state, cost = self._blocks(sources) if self.dead < FEW else self._together(sources)
        good = self.accepts[state]
        return good, self.token[state], cost + self.last[state]

    def _blocks(self, sources: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        state, cost = [self.start] * len(sources), [0] * len(sources)
        held, size = [], 0
        for k, s in enumerate(sources):
            for at in range(0, len(s), PIECE):
                held.append((k, memoryview(s)[at : at + PIECE]))
                size += len(held[-1][1])
                if size >= PIECE:
                    self._advance(held, state, cost)
                    held, size = [], 0
        if held:
            self._advance(held, state, cost)
        return np.array(state, np.int64), np.array(cost, np.int64)

    def _advance(self, pieces: list[tuple[int, memoryview]], state: list[int], cost: list[int]) -> None:
        """Take in pieces of sources, in order: each changes its source's state and cost."""
        size = np.array([len(p) for _, p in pieces], np.int64)
        count = -(-size // BLOCK)
        data = np.full((int(count.sum()), BLOCK), _NONE, np.int32)
        first = np.cumsum(count) - count
        flat = data.reshape(-1)
        for (_, p), at, n in zip(pieces, (first * BLOCK).tolist(), size.tolist(), strict=True):
            flat[at : at + n] = np.frombuffer(p, np.uint8)
        now = np.repeat(np.arange(self.dead + 1, dtype=np.int32)[:, None] * self.width, len(data), axis=1)
        paid = np.zeros(now.shape, np.int64)
        for symbols in np.ascontiguousarray(data.T):
            at = now + symbols
            paid += self.cost[at]
            now = self.step[at]
        to, price = (now // self.width).T.tolist(), paid.T.tolist()
        for (k, _), a, n in zip(pieces, first.tolist(), count.tolist(), strict=True):
            s, total = state[k], cost[k]
            for b in range(a, a + n):
                total += price[b][s]
                s = to[b][s]
            state[k], cost[k] = s, total

    def _together(self, sources: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(s) for s in sources], np.int64)
        order = np.argsort(-size, kind="stable")
        data = np.frombuffer(b"".join(sources), np.uint8)
        begin = (np.cumsum(size) - size)[order]
        state, cost = np.full(len(sources), self.start * self.width, np.int32), np.zeros(len(sources), np.int64)
        alive = np.searchsorted(-size[order], -np.arange(1, int(size.max(initial=0)) + 1), "right")  # sources of so many bytes and more
        together = int((alive >= TOGETHER).sum())
        for k in range(together):
            n = int(alive[k])
            at = state[:n] + data[begin[:n] + k]
            cost[:n] += self.cost[at]
            state[:n] = self.step[at]
        step, price = self.step, self.cost
        for j in range(int(alive[together]) if together < len(alive) else 0):
            now, total = int(state[j]), int(cost[j])
            for byte in data[begin[j] + together : begin[j] + size[order[j]]].tolist():
                total += int(price[now + byte])
                now = int(step[now + byte])
            state[j], cost[j] = now, total
        out_state, out_cost = np.empty(len(sources), np.int64), np.empty(len(sources), np.int64)
        out_state[order], out_cost[order] = state // self.width, cost
        return out_state, out_cost
