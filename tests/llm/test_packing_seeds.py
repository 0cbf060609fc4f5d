"""Every window of packed sequences is filled by a query of its own seed."""

import numpy as np

from wayline.llm import packing


def test_every_window_asks_the_index_with_its_seed(monkeypatch):
    rng = np.random.default_rng(0)
    docs = [(i, (rng.integers(0, 60, 1000) + 100 * (i % 5)).astype(np.uint16), 0) for i in range(100)]
    asked, plain = [], packing.Index.neighbours
    monkeypatch.setattr(packing.Index, "neighbours", lambda self, seed, unused: asked.append(seed) or plain(self, seed, unused))
    packer = packing.Packer(0)
    packer.shard(docs)
    seeds = [r[7] for r in packer.rows if r[6] == 0]
    assert len(seeds) == 25 and set(seeds) <= set(asked)
    assert sum(r[2] for r in packer.rows) == 100_000


def test_neighbours_fill_the_window_best_first():
    rng = np.random.default_rng(1)
    docs = [(i, rng.choice(np.arange(i % 7, 400, 1 + i % 7), int(rng.integers(20, 1500))).astype(np.uint16), 0) for i in range(200)]
    packer = packing.Packer(0)
    packer.shard(docs)
    index, unused, at, seed, turn = packing.Index([d[1] for d in docs]), np.ones(len(docs), bool), 0, 0, []
    while unused.any():  # the same by plain steps: one document at a time
        near = index.neighbours(seed, unused) if turn else []
        i = int(near[0]) if len(near) else int(np.flatnonzero(unused)[0])
        if not len(near) or (at % packing.WINDOW + len(docs[i][1])) >= packing.WINDOW or at % packing.WINDOW == 0:
            seed = i
        unused[i], at = False, at + len(docs[i][1])
        turn.append(i)
        if at % packing.WINDOW == 0:
            turn.clear()
            break
    got = list(dict.fromkeys(r[0] for r in packer.rows))
    assert got[: len(turn)] == turn and len(turn) == 200
