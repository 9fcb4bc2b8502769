"""Error rates by quality are the exact sums, in whatever order the reads come."""

import random
from decimal import Decimal

from pyspark.sql import functions as F

from helixframe.operators import error


def test_sum_is_exact_in_any_order(spark):
    rnd = random.Random(6)
    quals = ["".join(rnd.choices("#$&+/38<@BCDEFGH", k=rnd.randint(0, 40))) for _ in range(3000)]
    reads = spark.createDataFrame(list(enumerate(quals)), "read_idx long, qualities string")
    want = float(sum(Decimal(10) ** (Decimal(33 - ord(c)) / 10) for q in quals for c in q))
    orders = [reads.coalesce(1), reads.coalesce(1).sortWithinPartitions(F.desc("read_idx")), reads.repartition(3), reads.repartition(7, "qualities")]
    rows = [error.quality_error_rate(r).first() for r in orders]
    assert {r.errors for r in rows} == {want}
    assert {(r.bases, r.error_rate) for r in rows} == {(sum(map(len, quals)), want / sum(map(len, quals)))}
