"""Times paired trimming on simulated FASTQ files: pairs of 125 bases, inserts of 60 to 260, 0.6 % of the bases wrong.

python bench_pairs.py [pairs]: writes two files under /tmp, scans them, pairs the reads, trims, counts by dest.
"""

from __future__ import annotations

import json
import os
import sys
import time

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from helixframe.operators import pairs
from helixframe.plans.trim import TrimOptions, TrimPlan
from helixframe.sources import records

ADAPTERS = "AGATCGGAAGAGCACACGTCTGAACTCCAGTCA", "AGATCGGAAGAGCGTCGTGTAGGGAAAGAGTGT"
LENGTH, RATE = 125, 0.006


def simulate(folder: str, count: int) -> tuple[str, str]:
    rng = np.random.default_rng(1)
    bases = np.frombuffer(b"ACGT", np.uint8)
    paths = tuple(f"{folder}/{k}.fq" for k in (1, 2))
    files = [open(p, "wb") for p in paths]
    tails = [np.resize(np.frombuffer((a + "ACGTTGCA" * 20).encode(), np.uint8), LENGTH) for a in ADAPTERS]
    quals = bases[rng.integers(0, 4, (64, LENGTH))] % 8 + 65
    for at in range(0, count, 20_000):
        n = min(20_000, count - at)
        size = rng.integers(60, 261, n)
        insert = rng.integers(0, 4, (n, 260))
        out = []
        for k in (0, 1):
            place = np.arange(LENGTH)[None, :]
            own = insert if k == 0 else 3 - insert
            index = place if k == 0 else size[:, None] - 1 - place
            read = bases[np.take_along_axis(own, np.clip(index, 0, 259) + 0 * size[:, None], axis=1)]
            past = place >= size[:, None]
            read = np.where(past, tails[k][np.clip(place - size[:, None], 0, LENGTH - 1)], read)
            wrong = rng.random((n, LENGTH)) < RATE
            out.append(np.where(wrong, bases[rng.integers(0, 4, (n, LENGTH))], read).astype(np.uint8))
        for f, reads in zip(files, out):
            f.write(b"".join(b"@r%d\n%b\n+\n%b\n" % (at + i, r.tobytes(), quals[(at + i) % 64].tobytes()) for i, r in enumerate(reads)))
    for f in files:
        f.close()
    return paths


def main() -> None:
    count = int(sys.argv[1]) if len(sys.argv) > 1 else 781_923
    folder = "/tmp/helixframe-bench"
    os.makedirs(folder, exist_ok=True)
    one, two = simulate(folder, count)
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", 4 * int(cpus)).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    c, times = F.col, {}
    scans = [records.read_fastq(spark, p, split=8 << 20) for p in (one, two)]
    both = records.pair_up(*scans)
    both = both.select("read_idx", *[pairs.read_struct(c(f"{r}.name"), c(f"{r}.sequence"), c(f"{r}.qualities")).alias(r) for r in ("r1", "r2")])
    plans = {
        "scan_and_pair": lambda: both.select(F.length("r1.sequence").alias("n")).agg(F.sum("n")).collect(),
        "insert": lambda: TrimPlan.of(TrimOptions(adapters=[("back", ADAPTERS[0])], adapters2=[("back", ADAPTERS[1])], aligner="insert", minimum_length=25, op_order="GACQW")).run_pairs(both).groupBy("dest").agg(F.count("*"), F.sum(F.length("r1.sequence"))).collect(),
        "adapter": lambda: TrimPlan.of(TrimOptions(adapters=[("back", ADAPTERS[0])], adapters2=[("back", ADAPTERS[1])], minimum_length=25, op_order="GACQW")).run_pairs(both).groupBy("dest").agg(F.count("*"), F.sum(F.length("r1.sequence"))).collect(),
    }
    for name, f in plans.items():
        began = time.time()
        print(f(), flush=True)
        times[name] = round(time.time() - began, 1)
    print(json.dumps({"pairs": count, "seconds": times, "pairs_a_second": {k: round(count / v) for k, v in times.items()}}))
    spark.stop()


if __name__ == "__main__":
    main()
