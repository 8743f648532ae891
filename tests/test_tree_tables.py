"""Shapley values from tables of groups of leaves."""

import numpy as np

from ledgerlens.operators import attributions


def tree(rng, features, depth, path=None):
    path = path or {}
    if not depth:
        return [(float(rng.normal()), [(f, *b) for f, b in path.items()])]
    f, cut = int(rng.integers(features)), float(rng.normal())
    lo, hi, z = path.get(f, (-np.inf, np.inf, 1.0))
    return [leaf for part, share in (((lo, min(hi, cut)), 0.25), ((max(lo, cut), hi), 0.75))
            for leaf in tree(rng, features, depth - 1, {**path, f: (*part, z * share)})]


def by_leaf(matrix, paths):
    phi = np.zeros_like(matrix)
    for value, path in paths:
        on = np.stack([(matrix[:, f] > lo) & (matrix[:, f] <= hi) for f, lo, hi, _ in path], axis=1)
        found = value * attributions._game(on.astype(float), [p[3] for p in path])
        for j, p in enumerate(path):
            phi[:, p[0]] += found[:, j]
    return phi


def test_groups_of_leaves_sum_up_to_their_leaves(monkeypatch):
    rng = np.random.default_rng(3)
    paths = [leaf for depth in (1, 5, 5, 6) for leaf in tree(rng, 7, depth)]
    matrix = np.concatenate([rng.normal(size=(300, 7)), np.zeros((1, 7))])
    matrix[:3, 0] = [cut for _, path in paths for f, _, cut, _ in path if not f and cut < 9][:3]
    expected = by_leaf(matrix, paths)
    tables = attributions._tables(paths)
    assert len(tables) < len(paths) / 4 and all(len(t[0]) <= attributions.TABLE_CUTS for t in tables)
    for bound in (attributions.TABLE_CUTS, 3, 0):
        monkeypatch.setattr(attributions, "TABLE_CUTS", bound)
        found = attributions._looked_up(matrix, attributions._tables(paths))
        np.testing.assert_allclose(found, expected, atol=1e-12)
