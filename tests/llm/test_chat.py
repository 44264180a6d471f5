"""Viterbi against enumeration, pieces against the whole, and recovered roles."""

import zlib
from itertools import product

import numpy as np
import pytest

from vellum.llm import chat


def model(seed=0):
    rng = np.random.default_rng(seed)
    return chat.Hmm(rng.random(chat.N) * 9, rng.random((chat.N, chat.N)) * 9, [rng.random((chat.N, n)) * 9 for n in (chat.SIGNS, chat.LENGTHS, chat.ENDS, chat.FIRSTS)])


def test_viterbi_by_enumeration():
    m = model()
    lines = ["User: hello?", "more", "AI: well.", "", "Q: and"]
    b = m.emissions(lines)
    value = lambda p: m.start[p[0]] + b[0, p[0]] + sum(m.step[x, y] + b[t + 1, y] for t, (x, y) in enumerate(zip(p, p[1:], strict=False)))
    best = max(product(range(chat.N), repeat=5), key=value)
    end = int(m.summary(b, True)[0].argmax())
    assert tuple(m.decode(b, -1, end).tolist()) == best


def test_markers():
    for line, want in [("User: hi", 1), ("### Human: hi", 1), ("<|assistant|>hi", 2), ("A: x", 2), ("**Assistant:** x", 2), ("System: x", 0), ("a word", 3), ("question of", 3), ("", 3), ("Note: x", 3)]:
        assert chat.marker(line)[0] == want, line


@pytest.mark.parametrize("bits", [1, 12])
def test_pieces(spark, bits):
    rng = np.random.default_rng(1)
    words = ["User: hello?", "more text here.", "Assistant: fine", "", "Q: why", "A: so", "plain line", "System: be good"]
    rows = [(int(c) if c else None, [int(i), 0, 0], words[rng.integers(len(words))] if i % 9 else None) for c in range(6) for i in range([1, 40, 3, 200, 2, 17][c])]
    rows += [(1, [5, 0, 0], "tie")] * 3
    df = spark.createDataFrame(rows, "conv_id int, at array<long>, line string")
    got = chat.parse(df, model(3), bits).collect()
    assert sum(r.text.count("\n") + 1 for r in got) == len(rows)
    for c in {r[0] for r in rows}:
        lines = [x or "" for _, _, x in sorted((r for r in rows if r[0] == c), key=lambda r: r[1])]
        if c == 1:
            continue  # ties
        b = model(3).emissions(lines)
        states = model(3).decode(b, -1, int(model(3).summary(b, True)[0].argmax())).tolist()
        turns = []
        for s, x in zip(states, lines, strict=True):
            if s % 2 == 0:
                turns.append((chat.ROLES[s // 2], [chat.marker(x)[1]]))
            else:
                turns[-1][1].append(x)
        own = sorted((r.turn_no, r.role, r.text) for r in got if r.conv_id == c)
        assert own == [(i, role, "\n".join(t)) for i, (role, t) in enumerate(turns)]
    assert chat.parse(df.limit(0), model()).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    got = {(r.conv_id, r.turn_no): r for r in chat.op10_chat_roles(spark, sf).collect()}
    want = [r for r in spark.read.parquet(f"{sf}/conversations.parquet").collect() if zlib.crc32(str(r.conv_id).encode()) % 3 == 1]
    hit = [(r.conv_id, r.turn) in got and got[r.conv_id, r.turn].role == r.role and got[r.conv_id, r.turn].text == r.text for r in want]
    assert np.mean(hit) > 0.9
