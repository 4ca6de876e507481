"""Trust and distrust reach as far as there are links."""

import numpy as np

from candela.llm import url_filter


def test_distrust_goes_down_a_long_chain(spark):
    rows = [(i, f"http://h{i}/", f'<a href="http://h{i + 1}/">' if i < 11 else None) for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.host: r for r in url_filter.judge(df, rules=(("block", "h11/"),)).collect()}
    p = np.zeros((12, 12))
    p[np.arange(1, 12), np.arange(11)] = 1.0
    seed = np.eye(12)[11]
    limit = np.linalg.solve(np.eye(12) - 0.85 * p.T, 0.15 * seed)
    assert all(r.verdict == "block" and r.trust == 0 for r in got.values())
    assert sum(abs(got[f"h{i}"].distrust - limit[i]) for i in range(12)) <= url_filter.TOLERANCE
