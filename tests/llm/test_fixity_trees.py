"""The fixity audit beside a plain comparison: repeated ids, order, ties and odd inputs."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sondage.llm import fixity

SCHEMA = "page_id bigint, url string, html string, place bigint, hash string, node int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, "u", h, p, "x", 1) for p, (i, h) in enumerate(rows)], SCHEMA).repartition(parts)


def found(spark, ours, theirs, **options):
    rows = fixity.audit(frame(spark, ours), frame(spark, theirs), **options).collect()
    return Counter({(r["record_id"], r["kind"]): 0 for r in rows}) + Counter(
        {k: sum(r["copies"] for r in rows if (r["record_id"], r["kind"]) == k) for k in {(r["record_id"], r["kind"]) for r in rows}})


def plain(ours, theirs):
    """Contents that went and came, per id; as many as possible are changes."""
    lost, added = Counter(ours) - Counter(theirs), Counter(theirs) - Counter(ours)
    out = Counter()
    for i in {i for i, _ in [*lost, *added]}:
        a, b = (sum(n for (j, _), n in c.items() if j == i) for c in (lost, added))
        out += Counter({(i, "changed"): min(a, b), (i, "missing"): a - min(a, b), (i, "extra"): b - min(a, b)})
    return out


@pytest.mark.parametrize("fan", [5])
def test_damage_is_what_counting_finds(spark, fan):
    rnd = random.Random(fan)
    ours = [(rnd.choice([None, *range(30)]), rnd.choice(["a", "b", "c", None, "long " * 50])) for _ in range(120)]
    theirs = [(i, rnd.choice(["a", "z"]) if rnd.random() < 0.1 else h) for i, h in ours if rnd.random() > 0.1]
    theirs += [(rnd.choice([None, 7, 99, -3]), "new") for _ in range(40)]
    want = plain([(i, h or "") for i, h in ours], [(i, h or "") for i, h in theirs])
    assert found(spark, ours, theirs, fan=fan) == want


def test_contents_of_one_id_are_told_apart(spark):
    ours, theirs = [(1, h) for h in "abbd"], [(1, h) for h in "accd"]
    assert found(spark, ours, theirs) == Counter({(1, "changed"): 2})
    assert found(spark, [(None, "a"), (None, "a")], [(None, "a")]) == Counter({(None, "missing"): 1})


def test_a_hot_id_is_hashed_in_rounds(spark):
    ours = [(5, str(k)) for k in range(300)] + [(6, "x")]
    theirs = [(5, str(k)) for k in range(300)] + [(6, "y")] + [(5, f"new {k}") for k in range(500)]
    assert found(spark, ours, theirs, fan=16) == Counter({(5, "extra"): 500, (6, "changed"): 1})


def test_another_order_is_found(spark):
    ours = [(k, f"text {k}") for k in range(200)]
    swapped = list(ours)
    swapped[20], swapped[21] = swapped[21], swapped[20]
    assert found(spark, ours, swapped, order="place", fan=16) == Counter({(20, "moved"): 1, (21, "moved"): 1})
    assert not found(spark, ours, swapped, fan=16)
    turned = ours[96:] + ours[:96]  # whole nodes
    assert set(found(spark, ours, turned, order="place", fan=16)) == {(None, "moved")}
    shifted = [(-1, "at the front"), *ours]  # every offset differs, one record is extra
    assert found(spark, ours, shifted, order="place", fan=16) == Counter({(-1, "extra"): 1})


def test_places_are_those_in_both_files(spark):
    ours = [(k, "x" * k) for k in range(30)]
    theirs = [(k, "y" if k == 20 else h) for k, h in ours if k != 3]
    size = lambda i, h: len(f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:record:{i}>\r\nWARC-Target-URI: u\r\n"  # noqa: E731
                            f"Content-Length: {len(h)}\r\n\r\n{h}\r\n\r\n")
    rows = {r["record_id"]: r for r in fixity.audit(frame(spark, ours), frame(spark, theirs), fan=8).collect()}
    assert set(rows) == {3, 20}
    assert (rows[3]["offset"], rows[3]["length"], rows[3]["replica_offset"]) == (sum(size(*r) for r in ours[:3]), size(*ours[3]), None)
    assert rows[20]["replica_offset"] == sum(size(*r) for r in theirs[:19])


def test_long_payloads_and_nothing(spark):
    ours = [(k, "w" * 200_000) for k in range(3)]
    assert found(spark, ours, [*ours[:2], (2, "w" * 199_999 + "v")]) == Counter({(2, "changed"): 1})
    assert found(spark, [], ours[:1]) == Counter({(0, "extra"): 1})
    assert found(spark, ours[:1], []) == Counter({(0, "missing"): 1})
    assert not found(spark, [], [])
    wide = frame(spark, [(1, "a")]).withColumn("a.b", F.lit(1)).withColumn("n", F.lit(1))
    assert fixity.audit(wide, wide).count() == 0
