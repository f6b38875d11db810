"""A window holds what is related to its seed as long as there is any."""

import numpy as np

from annolake.llm import packing


def test_neighbours_fill_the_window():
    rnd = np.random.default_rng(2)
    topics = [rnd.integers(1000 * t, 1000 * t + 80, (40, 60)) for t in range(1, 6)]
    documents = [(len(topics) * i + t, topic[i]) for i in range(40) for t, topic in enumerate(topics)]
    held = {}
    for d, _, length, sequence, _ in packing.pack_shard(documents, 2048):
        held.setdefault(sequence, {}).setdefault(documents[d][1][0] // 1000, []).append(length)
    full = [max(map(sum, topics.values())) for topics in held.values() if sum(map(sum, topics.values())) == 2048]
    assert len(full) == 5 and sum(n == 2048 for n in full) >= 4
