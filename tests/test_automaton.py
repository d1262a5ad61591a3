"""Automata over many sources against the byte loop."""

import random
import time

import pytest

from glyphline.kernels import automaton
from glyphline.kernels.encode import run_dfa
from glyphline.operators import tokenize


def _random(rng, states):
    steps = {(a, b): (rng.randrange(states), rng.randrange(-3, 9)) for a in range(states) for b in range(256) if rng.random() < 0.995}
    return steps, {a: (rng.randrange(99), rng.randrange(5)) for a in range(states) if rng.random() < 0.6}, rng.randrange(states)


@pytest.mark.parametrize("states", [1, 2, 7, 40])
def test_equals_the_byte_loop(states, monkeypatch):
    rng = random.Random(states)
    for block in (3, 256):
        monkeypatch.setattr(automaton, "BLOCK", block)
        monkeypatch.setattr(automaton, "PIECE", 4 * block + 1)
        given = _random(rng, states)
        sources = [bytes(rng.randrange(256) for _ in range(rng.choice((0, 1, 5, 40, 300, 1500)))) for _ in range(60)] + [b""] * 3
        good, token, cost = automaton.Automaton(*given).run(sources)
        assert [(int(t), int(c)) if g else None for g, t, c in zip(good, token, cost, strict=True)] == [run_dfa(*given, s) for s in sources]
    assert automaton.Automaton(*given).run([])[0].tolist() == []
    huge = {(0, 97): (0, 1 << 61)}
    good, _, cost = automaton.Automaton(huge, {0: (1, 0)}, 0).run([b"aaaa", b"b"])
    assert good.tolist() == [True, False] and cost[0] == 4 << 61


def test_one_long_source_and_nulls(spark):
    steps = {(s, b): (1, 2) if b == 46 else (0, 1) for s in (0, 1) for b in range(256)}
    a, data = automaton.Automaton(steps, {0: (8, 0), 1: (7, 0)}, 0), b"A long text. " * 800_000
    begin = time.time()
    good, token, cost = a.run([data])
    assert (bool(good[0]), int(token[0]), int(cost[0])) == (True, 8, len(data) + 800_000)
    assert len(data) / 2**20 / (time.time() - begin) > 5  # MiB/s, with room for a busy machine
    df = spark.createDataFrame([(1, "x."), (2, None), (3, ""), (4, "y")], "id int, text string")
    assert {r.id: (r.dfa_token, r.dfa_cost) for r in tokenize.run_automaton(df, steps, {0: (8, 0), 1: (7, 0)}).collect()} == {1: (7, 3), 2: (None, None), 3: (8, 0), 4: (8, 1)}
