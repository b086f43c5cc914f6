import tracemalloc

import numpy as np

from chainloom.llm import embeddings


def test_a_few_wide_nodes_do_not_let_all_pairs_through():
    rng = np.random.default_rng(3)
    clump = np.eye(64)[0] + 0.05 * rng.normal(size=(60, 64))  # far enough apart for a wide node
    unit = embeddings._unit(np.concatenate([rng.normal(size=(6000, 64)), clump]))
    tree = embeddings.CoverTree(unit.astype(np.float32))
    tracemalloc.start()
    found = [np.stack(p) for p in embeddings.dual_pairs(tree, tree, float(np.sqrt(0.2)), True)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    pairs = {(min(p), max(p)) for p in np.concatenate(found, axis=1).T.tolist()}
    wanted = {(i, j) for i, j in zip(*np.nonzero(unit @ unit.T >= 0.9), strict=True) if i < j}
    assert wanted and wanted <= pairs and len(pairs) < 2 * len(wanted)
    assert peak < 250e6  # a bound for all nodes alike let nearly all 36 million pairs through
