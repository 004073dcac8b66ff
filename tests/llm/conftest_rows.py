def rows_of(texts, sources=None):
    return [(i, t, None, (sources or ["a", "b", None])[i % 3], None, "x", 1, 2, 3, "y", "z", 4, 5, 6, 0.5, 1) for i, t in enumerate(texts)]
