"""URL filters: a sorted digest array of 64-bit xxhash keys, memory-mapped, probed with vectorised binary search.

The array holds one key per listed string in rising order; each hit is confirmed against the stored full string, and
strings whose keys collide stay side by side, so a collision can neither block nor hide anything. The file travels with
Spark's own file distribution (each executor fetches it again whenever it starts), and workers map it read-only.

Rows are judged one by one: hot hosts cost nothing extra, and repeated rows are judged alike. Of a host only the suffixes are
probed that are no longer than the longest listed one, so a host of any number of dots costs time in proportion to its
length. A null url, or one without "://", has empty host and path, no rule and verdict "allow"; a null id stays null. Of
rules of equal length that fit, the one with the longer host wins. An empty table gives an empty table. Extra columns are
not read.

The list is a parameter and is built on the driver, which holds it once more than its file has bytes; workers share the
mapped pages.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import shared_dir, slices

MAGIC = b"UDA1"

#: Rules (verdict, host, path) in force.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: Hosts that the digest array lists by default; their subdomains count too.
BLOCKED_HOSTS = ("cheap-pills.example.com", "spam-farm.example.org", "casino.example.net", "malware.example.org", "free-prizes.example.com")


def build(strings: Iterable[str]) -> bytes:
    """The file: magic, count, sorted keys, string offsets, payload. Repeated strings are stored once."""
    rows = sorted((xxhash.xxh64_intdigest(s.encode()), s.encode()) for s in set(strings))
    keys = np.array([k for k, _ in rows], dtype="<u8")
    offsets = np.zeros(len(rows) + 1, dtype="<u8")
    np.cumsum([len(s) for _, s in rows], out=offsets[1:]) if rows else None
    return MAGIC + b"\0" * 4 + struct.pack("<Q", len(rows)) + keys.tobytes() + offsets.tobytes() + b"".join(s for _, s in rows)


class DigestArray:
    """A mapped file made by build()."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            head = f.read(16)
        if head[:4] != MAGIC:
            raise ValueError(f"{path} is no digest array")
        n = struct.unpack("<Q", head[8:])[0]
        self.keys = np.memmap(path, dtype="<u8", mode="r", offset=16, shape=(n,)) if n else np.zeros(0, "<u8")
        self.offsets = np.memmap(path, dtype="<u8", mode="r", offset=16 + 8 * n, shape=(n + 1,))
        size = int(self.offsets[n])
        self.text = np.memmap(path, dtype=np.uint8, mode="r", offset=24 + 16 * n, shape=(size,)) if size else np.zeros(0, np.uint8)

    def stored(self, i: int) -> bytes:
        return self.text[int(self.offsets[i]) : int(self.offsets[i + 1])].tobytes()

    def contains(self, strings: Sequence[bytes]) -> np.ndarray:
        """Whether each string is listed: one binary search for all keys, then a look at the full strings."""
        found = np.zeros(len(strings), dtype=bool)
        if not len(strings) or not len(self.keys):
            return found
        probe = np.fromiter((xxhash.xxh64_intdigest(s) for s in strings), dtype=np.uint64, count=len(strings))
        at, end = np.searchsorted(self.keys, probe, "left"), np.searchsorted(self.keys, probe, "right")
        for i in np.flatnonzero(at < end):
            found[i] = any(self.stored(j) == strings[i] for j in range(at[i], end[i]))
        return found


def published(spark, strings: Iterable[str]) -> str:
    """Write the array to the shared folder once for its contents, give it to all executors; returns its file name."""
    data = build(strings)
    name = f"digests-{hashlib.sha256(data).hexdigest()[:24]}.uda"
    path = f"{shared_dir(spark)}/url_filter/{name}"
    jvm, sc = spark._jvm, spark.sparkContext
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(p):
        with_hash = jvm.org.apache.hadoop.fs.Path(f"{path}.{os.getpid()}.tmp")
        out = fs.create(with_hash, True)
        for at in range(0, len(data), 1 << 20):
            out.write(bytearray(data[at : at + (1 << 20)]))
        out.close()
        if not fs.rename(with_hash, p):
            fs.delete(with_hash, False)
    if name not in {f.rpartition("/")[2] for f in sc.listFiles}:
        sc.addFile(path)
    return name


def suffixes(host: str, longest: int | None = None) -> list[str]:
    """host and all its parent domains, the longest first; those of at most longest characters."""
    out = []
    if host and (longest is None or len(host) <= longest):
        out.append(host)
    at = host.find(".", max(0, len(host) - 1 - longest) if longest is not None else 0)
    while at >= 0:
        out.append(host[at + 1 :])
        at = host.find(".", at + 1)
    return out


def _split(column: str):
    """Columns (host, path) of a url."""
    url = F.coalesce(F.col(column), F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    blocked_hosts: Iterable[str] = BLOCKED_HOSTS,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """One row per url: id, host, path, rule, verdict, listed.

    A rule fits its host and all subdomains where the path starts with the rule's; the longest wins (by host and path
    together, and of equal lengths the longer host). Otherwise a host that the array lists, or whose parent domain it
    lists, is blocked and any other allowed. listed tells what the array says, whatever the rule. Rules and hosts stand
    in the same array, as "host\\tpath" and "host".
    """
    verdicts = {f"{h}{p}": v for v, h, p in rules}
    lengths = sorted({len(p) for _, _, p in rules}, reverse=True)
    blocked_hosts = list(blocked_hosts)
    longest = max((len(h) for h in [*(h for _, h, _ in rules), *blocked_hosts]), default=0)
    name = published(pages.sparkSession, [*(f"{h}\t{p}" for _, h, p in rules), *blocked_hosts])
    host, path = _split(url_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray(SparkFiles.get(name))
        known: dict[str, list[str]] = {}
        for batch in (part for whole in batches for part in slices(whole, 1)):
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            probes: dict[bytes, int] = {}
            tried = []
            for h, p in zip(hosts, paths):
                if len(known) > 200_000:
                    known.clear()
                above = known.get(h)
                if above is None:
                    above = known[h] = suffixes(h, longest)
                heads = [p[:n] for n in lengths if len(p) >= n]
                tried.append((above, heads))
                for s in above:
                    probes.setdefault(s.encode(), len(probes))
                    for q in heads:
                        probes.setdefault(f"{s}\t{q}".encode(), len(probes))
            hit = array.contains(list(probes))
            rule, verdict, listed = [], [], []
            for above, heads in tried:
                fits = [(len(s) + len(q), len(s), f"{s}{q}") for s in above for q in heads if hit[probes[f"{s}\t{q}".encode()]]]
                best = max(fits)[2] if fits else None
                on_list = any(hit[probes[s.encode()]] for s in above)
                rule.append(best)
                listed.append(on_list)
                verdict.append(verdicts[best] if best else "block" if on_list else "allow")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(listed, pa.bool_())],
                names=["id", "host", "path", "rule", "verdict", "listed"],
            )

    slim = pages.select(pages[id_col].alias("id"), host.alias("host"), path.alias("path"))
    return slim.mapInArrow(rows, f"id {slim.schema['id'].dataType.simpleString()}, host string, path string, rule string, verdict string, listed boolean").withColumnRenamed("id", id_col)
