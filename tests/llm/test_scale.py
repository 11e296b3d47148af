"""What the operators spend on tables that grow."""

import numpy as np

from loomgraph.llm import hard_negatives


def test_pivots_that_leave_all_rows_are_not_asked_for_each_row(monkeypatch):
    """Rows alike in all directions: only a few anchors of a tile try the pivots, and what is found is still exact."""
    rng = np.random.default_rng(5)
    x = rng.integers(-60, 60, (600, 16)).astype("<i4")
    squares = (x.astype(np.int64) ** 2).sum(axis=1)
    pivots = hard_negatives.Pivots(x[:50].astype(np.float64), int(squares.max()), 4)
    low, high = [hard_negatives._NONE], [int(np.iinfo(np.int64).max)]
    block = [{"vec_id": i, "label": 0, "square": int(squares[i]), "data": x[i].tobytes(), "low": low, "high": high} for i in range(200)]
    search, tried, real = hard_negatives._Search(block, pivots, 5, 1), [], hard_negatives._Search._survivors
    monkeypatch.setattr(hard_negatives._Search, "_survivors", lambda self, own, *rest: tried.append(len(own)) or real(self, own, *rest))
    far = pivots.distances(x, squares, anchors=False)
    search.meet({"label": 0, "ids": np.arange(600).tobytes(), "data": x.tobytes(), "far": far.tobytes()}, same=True)
    assert max(tried) <= 2 * hard_negatives.TRIED
    scores = x[:200].astype(np.int64) @ x.T.astype(np.int64)
    for i in range(200):
        best = sorted((-s, j) for j, s in enumerate(scores[i]) if j != i)[:5]
        assert list(zip(-search.scores[i], search.found[i], strict=True)) == best
