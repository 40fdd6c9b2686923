import numpy as np

from memlake.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<double>, label int, component string, n int, __at long"


def plain(rows, dim):
    """(ids, x, n, sums, values, parts, trace) of the usable rows, components falling."""
    rows = [(i, v) for i, v in rows if v is not None and len(v) == dim and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(1024 * c)) + 100000 for c in v] for _, v in rows])
    sums = x.sum(axis=0)
    z = x - sums / len(x)
    values, parts = np.linalg.eigh(z.T @ z / len(x))
    return [i for i, _ in rows], x, len(x), sums, values[::-1], parts[:, ::-1], z


def test_against_numpy(spark, tables):
    rng = np.random.default_rng(5)
    data = [(i, (rng.normal(size=12) * np.arange(1, 13)).tolist()) for i in range(400)]
    data += [(400, None), (401, [1.0] * 11 + [None]), (402, [float("nan")] * 12), (403, [float("inf")] + [0.0] * 11), (404, []), (405, [1.0, 2.0]), (None, [0.5] * 12), (3, data[3][1]), (3, data[3][1])]
    path = tables(embeddings=([(i, v, None, "x", 1, 1) for i, v in data], SCHEMA))
    got = wh.op12_whitening(spark, path).collect()
    ids, x, n, sums, values, parts, z = plain(data, 12)
    assert len(got) == 8 * len(ids) and {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, 9))
    assert sorted((r.deviation for r in got if r.component == 1)) == sorted(sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums, strict=True)) for row in x)
    for k in range(1, 9):
        want = z @ parts[:, k - 1] / np.sqrt(values[k - 1])
        have = {r.vec_id: r.whitened for r in got if r.component == k}
        sign = np.sign(have[0] * want[0])
        assert max(abs(have[i] - sign * w) for i, w in zip(ids, want, strict=True)) < 1e-9
        assert all(abs(r.explained - values[k - 1] / values.sum()) < 1e-9 for r in got if r.component == k)
    assert 0 <= got[0].identity_error < 1e-9 and len({r.identity_error for r in got}) == 1


def test_few_rows_equal_rows_and_no_rows(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert wh.whiten(frame([])).collect() == [] and wh.whiten(frame([(1, None), (2, [])])).collect() == []
    assert wh.whiten(frame([(i, [1.0, 2.0, 3.0]) for i in range(5)])).collect() == []  # no variance at all
    assert wh.whiten(frame([(1, [1.0, 2.0])])).collect() == []
    two = wh.whiten(frame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0])])).collect()
    assert {r.component for r in two} == {1} and sorted(round(r.whitened, 9) for r in two) == [-1, 1] and abs(two[0].explained - 1) < 1e-12


def test_numbers_beyond_a_long(spark):
    big = [(i, [float(i) * 1e9, 1.0, 2e15 * (i % 2)]) for i in range(50)]
    got = wh.whiten(spark.createDataFrame(big, "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in got} == {1, 2} and all(r.deviation is None for r in got) and got[0].identity_error < 1e-6
    x = np.array([[2**62, 5], [2**62, 7], [3, 1]])
    assert wh.exact_sums(x) == [2**63 + 3, 13] and wh.multiples(x, 3, [2**63 + 3, 13])[0].tolist() == [3 * 2**62 - 2**63 - 3, 2]
