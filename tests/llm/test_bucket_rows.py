"""What rows of near-duplicate buckets carry."""

import numpy as np

from sondage.llm import partenum


def test_a_sketch_is_no_longer_than_it_tells_sets_apart():
    rnd = np.random.default_rng(5)
    for n in (900, 1100, 2500, 3300, 20_000):
        one, other = (rnd.integers(0, 1 << 63, n, dtype=np.uint64) for _ in range(2))
        close = np.concatenate([one[n // 10:], other[:n // 10]])  # 9 / 11 of both sets together: similar at 0.8
        held = [partenum.sketch(x).tobytes() for x in (one, other, close)]
        cells = len(held[0]) * 8
        assert cells == 1024 or cells < 1.25 * n
        rows = [(k, n, h, 0, k) for k, h in enumerate(held)]
        assert partenum.few_pairs(rows, 8, 10, False) == [(0, 2)]


def test_a_bucket_is_dealt_by_its_signature_once(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{i if i % 40 else (i, k)}" for i in range(400))) for k in range(6)], "doc_id long, text string")
    join = partenum.Join(docs, "doc_id", "text", 8, 10, 5, 0)
    rows = join.buckets().collect()
    sizes = {}
    for r in rows:
        sizes.setdefault(r["sig"], set()).add(r["cls"])
    assert sizes and all(len(v) > 1 for v in sizes.values())
    assert all((r["block"], r["blocks"], r["size"]) == (0, 1, len(sizes[r["sig"]])) for r in rows)
    assert {r["component_id"] for r in partenum.near_duplicates(docs, numerator=5, denominator=10, words=1).collect()} == {0}
