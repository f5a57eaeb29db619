"""Vectors whose squares leave the range of doubles, and extra columns with clashing names."""

from alloyscreen.llm import vectors


def test_tiny_and_huge_vectors(spark):
    base = [0.6, 0.8, 0.0]
    rows = [(0, base), (1, [x * 1e-200 for x in base]), (2, [x * 1e200 for x in base]), (3, [x * 5e-324 for x in (1.0, 0.0, 0.0)]), (4, [1.7e308, 0.0, 0.0]), (5, [0.0, 0.0, 1e-320]), (6, [0.0] * 3), (7, [1e300, 1e-300, 0.0])]
    table = spark.createDataFrame([(i, v, "a", 1, 2, "t", 3, 4) for i, v in rows], "vec_id long, embedding array<double>, label string, node long, v int, tile string, x int, n long")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(table, block=4).collect()}
    assert got == {0: (2, 0, True), 1: (2, 0, False), 2: (2, 0, False), 3: (2, 3, True), 4: (2, 3, False), 5: (0, 5, True), 6: (0, 6, True), 7: (2, 3, False)}
