import numpy as np
import pytest

from pathlight.plans import solvers as S

TRIANGLE = (np.array([[1, 0, 0], [0, 1, 0], [0, 0, 1], [1, 1, 0], [0, 1, 1], [1, 0, 1]], float), np.array([5.0, 3.0, 7.0]), [(0, 1), (1, 0), (1, 2), (2, 1), (0, 2), (2, 0)])
CHAIN = (np.array([[1, 0, 0], [0, 1, 0], [0, 0, 1], [1, 1, 0], [0, 1, 1], [1, 1, 1]], float), np.array([2.0, 5.0, 1.0]), [(0, 1), (1, 0), (1, 2), (2, 1)])


@pytest.mark.parametrize("case", [TRIANGLE, CHAIN])
def test_recovery(case):
    a, truth, near = case
    b = a @ truth
    s = S.System.of(a, b, near)
    for method in ("tsvd", "tikhonov", "nnls"):
        x = S.SOLVERS[method](s).x
        assert np.allclose(x, truth, rtol=0.05), method
    assert np.allclose(S.em([np.flatnonzero(r) for r in a], b, 3).x, truth, atol=0.5)
    lens = a.sum(1)
    prior = (a * (b / lens)[:, None]).sum(0) / a.sum(0)
    assert np.allclose(S.gravity(s, prior).x, truth, rtol=0.1)
    assert np.isfinite(S.admm(s).x).all() and np.isfinite(S.irl1(s).x).all()
    assert np.isfinite(S.laplacian(s).x).all()


def test_triangle_stands_for_the_whole_matrix():
    rng = np.random.default_rng(1)
    a = (rng.random((200, 12)) < 0.3).astype(float)
    b = rng.random(200) * 10
    s = S.System.of(a, b)
    assert np.allclose(np.linalg.svd(a, compute_uv=False), s.svd[1])
    x = S.truncated(s).x
    assert np.allclose(x, np.linalg.lstsq(a, b, rcond=None)[0])
    assert np.isclose(s.residual(x), np.linalg.norm(a @ x - b))


def test_non_negative_optimality():
    rng = np.random.default_rng(2)
    for _ in range(20):
        a = (rng.random((30, 8)) < 0.4).astype(float)
        b = rng.normal(size=30)
        x = S.nnls(S.System.of(a, b)).x
        w = a.T @ (b - a @ x)
        assert (x >= 0).all() and (w <= 1e-8).all() and np.abs(w * x).max() < 1e-8
    assert (S.nnls(S.System.of(np.array([[1.0, 1], [1, 0]]), np.array([3.0, 4]))).x >= -1e-10).all()


def test_ridge_normal_equations():
    a, truth, _ = TRIANGLE
    b = a @ truth + 0.1
    x = S.tikhonov(S.System.of(a, b), 0.7).x
    assert np.allclose((a.T @ a + 0.7 * np.eye(3)) @ x, a.T @ b)
    for choice in ("gcv", "lcurve"):
        assert S.tikhonov(S.System.of(a, b), choice=choice).metadata["lambda"] > 0


def test_audit():
    assert S.audit(np.eye(10), 10).unidentifiable == []
    a = np.zeros((5, 6))
    for i in range(4):
        a[i, i] = 1
    a[4, 4] = a[4, 5] = 1
    q = S.audit(a, 5)
    assert q.rank == 5 and q.unidentifiable == [4, 5]
    q = S.audit(np.zeros((3, 2)), 3)
    assert q.rank == 0 and q.unidentifiable == [0, 1] and q.condition == float("inf") and q.identifiable_share == 0


def test_errors_and_names():
    assert S.solver_name("vardi") == "vardi-em"
    with pytest.raises(ValueError):
        S.solver_name("magic")
    with pytest.raises(S.SolveError):
        S.em([np.array([0]), np.array([], int)], np.array([1.0, 2.0]), 1)
    with pytest.raises(S.SolveError):
        S.laplacian(S.System.of(np.eye(2), np.ones(2)))


def test_em_skips_empty_paths():
    found = S.em([np.array([0]), np.array([1]), np.array([], int)], np.array([2.0, 3.0, 9.0]), 3)
    assert np.allclose(found.x, [2, 3, 0]) and found.metadata["skipped_empty"] == 1


def test_expectation_maximisation_by_weights():
    rng = np.random.default_rng(5)
    paths = [np.flatnonzero(r) for r in (rng.random((9, 5)) < 0.5)]
    paths = [p if len(p) else np.array([0]) for p in paths]
    every, b = [p for p in paths for _ in range(3)], rng.random(27) * 10
    mean = b.reshape(9, 3).mean(1)
    one, two = S.em(every, b, 5), S.em(paths, mean, 5, np.full(9, 3))
    assert np.allclose(one.x, two.x)
    assert np.isclose(one.residual**2, two.residual**2 + ((b.reshape(9, 3) - mean[:, None]) ** 2).sum())
