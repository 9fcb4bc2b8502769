"""Scans of sequence files as DataFrames.

Plain FASTQ and SAM split by bytes at record boundaries; other and compressed files are one partition each. A path may be
a folder, whose files count in the order of their names. Files open through pyarrow's file systems, so paths can be local
or on a store that it knows. read_idx numbers records from 1 in input order.
"""

from __future__ import annotations

import bisect
import bz2
import gzip
import io
import itertools
import lzma
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT = 64 << 20
#: Bytes that a part reads at a time.
_BLOCK = 4 << 20
READ = "split int, n bigint, name string, name2 string, sequence string, qualities string, primer string, flag int"
_READS = pa.schema([("split", pa.int32()), ("n", pa.int64()), *((c, pa.string()) for c in ("name", "name2", "sequence", "qualities", "primer")), ("flag", pa.int32())])
_COUNTS = pa.schema([("split", pa.int32()), ("n", pa.int64())])
#: The codes of bases in BAM.
_BAM_BASES = "=ACMGRSVTWYHKDBN"


class FormatError(ValueError):
    """A file that breaks its format."""


def _filesystem(path: str):
    from pyarrow import fs

    if re.match(r"[a-zA-Z][\w+.-]+:/", path):
        return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


def _open(path: str, start: int = 0):
    system, inner = _filesystem(path)
    if inner.endswith((".gz", ".bz2", ".xz")):
        raw = system.open_input_stream(inner, compression=None)
        return {"gz": gzip.open, "bz2": bz2.open, "xz": lzma.open}[inner.rpartition(".")[2]](io.BufferedReader(raw), "rb")
    raw = system.open_input_file(inner)
    raw.seek(start)
    return io.BufferedReader(raw, 1 << 20)


def guess_format(path: str) -> str | None:
    """The format that a file's name tells, without the compression's ending."""
    name = path.rpartition("/")[2].lower()
    for c in (".gz", ".bz2", ".xz"):
        name = name.removesuffix(c)
    end = name.rpartition(".")[2]
    return {"fastq": "fastq", "fq": "fastq", "txt": "fastq" if "sequence" in name else None, "fasta": "fasta", "fa": "fasta", "fna": "fasta", "csfasta": "fasta", "csfa": "fasta", "sam": "sam", "bam": "bam", "qual": "qual"}.get(end)


def sniff(path: str) -> str:
    """The format by the first character that begins no comment."""
    with _open(path) as f:
        for line in f:
            if line.strip() and not line.startswith(b"#"):
                return "fasta" if line.startswith(b">") else "sam" if line.count(b"\t") >= 10 or line.startswith((b"@HD\t", b"@SQ\t")) else "fastq" if line.startswith(b"@") else _unknown(path)
    return "fastq"


def _unknown(path: str):
    raise FormatError(f"{path}: neither FASTA, FASTQ nor SAM")


def fastq_start(f, at: int) -> int | None:
    """Where the first record begins that starts at byte at or later; None if there is none. f is moved there.

    A quality line may begin with @ as a header does, but the line after the next is then bases, which never begin with +.
    """
    if at:
        # From the byte before: a record that starts at byte at follows its line end.
        f.seek(at - 1)
        f.readline()
        window: list[tuple[int, bytes]] = []
        while True:
            p, line = f.tell(), f.readline()
            if line:
                window.append((p, line))
                if len(window) < 4:
                    continue
            if not window:
                return None
            if len(window) >= 3 and window[0][1].startswith(b"@") and window[2][1].startswith(b"+"):
                break
            window.pop(0)
        at = window[0][0]
    f.seek(at)
    return at


def _record(path: str, pos: int, lines: list[bytes], sra: bool, colorspace: bool) -> tuple:
    """(name, name2, sequence, qualities, primer) of four lines; an error that names the fault."""
    if not lines[3] and not (lines[2] and lines[1].strip(b"\r\n") == b""):
        raise FormatError(f"{path}: the file ends within a record at byte {pos}")
    name, seq, name2, qual = (x.rstrip(b"\r\n").decode("latin-1") for x in lines)
    if not name.startswith("@") or not name2.startswith("+"):
        raise FormatError(f"{path}: no FASTQ record at byte {pos}")
    if name2[1:] not in ("", name[1:]):
        raise FormatError(f"{path}: the second header of {name[1:]} differs")
    primer = None
    if colorspace:
        primer, seq = seq[:1], seq[1:]
        if sra:
            qual = qual[1:]
        if primer and primer not in "ACGT":
            raise FormatError(f"{path}: {primer} is no primer")
    if len(seq) != len(qual):
        raise FormatError(f"{path}: {name[1:]} has {len(seq)} bases and {len(qual)} qualities")
    return name[1:], name2[1:], seq, qual, primer


def fastq_blocks(f, path: str, at: int = 0, stop: int | None = None, sra: bool = False, colorspace: bool = False) -> Iterator[tuple]:
    """Columns (name, name2, sequence, qualities, primer) of the records that begin from byte at on and before stop, some
    megabytes at a time.

    A part owns the records that begin in it, whole. It also looks at the one after them: a file that ends within a record
    is an error wherever the parts lie.
    """
    pos = fastq_start(f, at) if at else 0
    over = pos is None
    while not over:
        lines = f.readlines(_BLOCK)
        while len(lines) % 4:
            more = f.readline()
            lines.append(more)
            if not more:
                lines += [b""] * (-len(lines) % 4)
        if not lines:
            return
        sizes = [a + b + c + d for a, b, c, d in zip(*(map(len, lines[i::4]) for i in range(4)))]
        starts = list(itertools.accumulate(sizes, initial=pos))
        own = len(sizes) if stop is None else bisect.bisect_left(starts, stop, 0, len(sizes))
        over = own < len(sizes)
        pos = starts[-1]
        head, seq, plus, qual = (lines[i : 4 * own : 4] for i in range(4))
        whole = [b"".join(x) for x in (head, seq, qual)]
        plain = own and not colorspace and whole[2][-1:] == b"\n" and not any(b"\r" in x for x in whole)
        if plain and all(x[:1] == b"@" for x in head) and all(x == b"+\n" for x in plus) and list(map(len, seq)) == list(map(len, qual)):
            names, bases, quals = (x.decode("latin-1").split("\n")[:-1] for x in whole)
            yield [x[1:] for x in names], [""] * own, bases, quals, [None] * own
        elif own:
            rows = [_record(path, starts[k], lines[4 * k : 4 * k + 4], sra, colorspace) for k in range(own)]
            yield tuple(list(c) for c in zip(*rows))
        if over:
            _record(path, starts[own], lines[4 * own : 4 * own + 4], sra, colorspace)


def fastq_count(f, at: int, stop: int | None) -> int:
    """How many records begin from byte at on and before stop, by their line ends alone."""
    first = fastq_start(f, at)
    last = None if stop is None or first is None else fastq_start(f, stop)
    if first is None or last == first:
        return 0
    f.seek(first)
    n, left, tail = 0, None if last is None else last - first, b"\n"
    while left is None or left:
        block = f.read(_BLOCK if left is None else min(_BLOCK, left))
        if not block:
            break
        n, tail, left = n + block.count(b"\n"), block[-1:], None if left is None else left - len(block)
    return -(-(n + (tail != b"\n")) // 4)


def fasta_records(f, path: str, join: str = "", colorspace: bool = False) -> Iterator[tuple]:
    """(name, None, sequence, None, primer)."""
    name, parts = None, []

    def record():
        seq, primer = join.join(parts), None
        if colorspace:
            primer, seq = seq[:1], seq[1:]
            if primer and primer not in "ACGT":
                raise FormatError(f"{path}: {primer} is no primer")
        return name, None, seq, None, primer

    for line in f:
        text = line.strip().decode("latin-1")
        if not text or text.startswith("#"):
            continue
        if text.startswith(">"):
            if name is not None:
                yield record()
            name, parts = text[1:], []
        elif name is None:
            raise FormatError(f"{path}: text before the first record")
        else:
            parts.append(text)
    if name is not None:
        yield record()


def sam_blocks(f, path: str, at: int = 0, stop: int | None = None, mates: str = "single") -> Iterator[tuple]:
    """Columns (name, name2, sequence, qualities, primer, flag) of the alignment lines that begin from byte at on and
    before stop, some megabytes at a time. mates 1 and 2 keep only that mate's."""
    pos = at
    if at:
        f.seek(at - 1)
        pos = at - 1 + len(f.readline())
    while stop is None or pos < stop:
        rows = []
        size = 0
        while size < _BLOCK and (stop is None or pos + size < stop):
            line = f.readline()
            if not line:
                break
            size += len(line)
            text = line.rstrip(b"\r\n")
            if not text or text.startswith(b"@"):
                continue
            v = text.decode("latin-1").split("\t")
            if len(v) < 11 or not v[1].isdigit():
                raise FormatError(f"{path}: no alignment line at byte {pos + size - len(line)}")
            if _wanted(int(v[1]), mates):
                rows.append((v[0], "", v[9], None if v[10] == "*" else v[10], None, int(v[1])))
        if rows:
            yield tuple(list(c) for c in zip(*rows))
        if not size:
            return
        pos += size


def _wanted(flag: int, mates: str) -> bool:
    return mates not in ("1", "2") or bool(flag & (64 if mates == "1" else 128))


def bam_blocks(f, path: str, mates: str = "single") -> Iterator[tuple]:
    """As sam_blocks, from the binary form; f gives its bytes uncompressed."""

    def take(n: int) -> bytes:
        got = f.read(n)
        if len(got) != n:
            raise FormatError(f"{path}: the file ends within a record")
        return got

    number = lambda: struct.unpack("<i", take(4))[0]
    if take(4) != b"BAM\1":
        raise FormatError(f"{path} is no BAM file")
    take(number())
    for _ in range(number()):
        take(number())
        number()
    rows, size = [], 0
    while head := f.read(4):
        if len(head) != 4:
            raise FormatError(f"{path}: the file ends within a record")
        data = take(struct.unpack("<i", head)[0])
        name_len, n_cigar, flag, bases = data[8], *struct.unpack_from("<HHi", data, 12)
        at = 32 + name_len + 4 * n_cigar
        packed = data[at : at + (bases + 1) // 2]
        quals = data[at + len(packed) : at + len(packed) + bases]
        if _wanted(flag, mates):
            seq = "".join(_BAM_BASES[b >> 4] + _BAM_BASES[b & 15] for b in packed)[:bases]
            text = None if quals[:1] == b"\xff" or not bases else bytes(q + 33 for q in quals).decode("latin-1")
            rows.append((data[32 : 31 + name_len].decode("latin-1"), "", seq, text, None, flag))
            size += len(data)
        if size >= _BLOCK:
            yield tuple(list(c) for c in zip(*rows))
            rows, size = [], 0
    if rows:
        yield tuple(list(c) for c in zip(*rows))


class _Part(InputPartition):
    def __init__(self, path: str, split: int, start: int, stop: int | None):
        self.path, self.split, self.start, self.stop = path, split, start, stop


def _files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the file, or of a folder's files in the order of their names, as parallel writers leave them."""
    from pyarrow import fs

    system, inner = _filesystem(path)
    info = system.get_file_info(inner)
    if info.type != fs.FileType.Directory:
        return [(path, info.size or 0)]
    head = re.match(r"(file:(?=/)|[a-zA-Z][\w+.-]+://(?=.*))?", path)[0] if path != inner else ""
    found = [x for x in system.get_file_info(fs.FileSelector(inner)) if x.type == fs.FileType.File and not x.base_name.startswith(("_", "."))]
    return [(head + x.path, x.size) for x in sorted(found, key=lambda x: x.path)]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}

    def partitions(self):
        step, kind, out = int(self.options.get("split", SPLIT)), self.options.get("kind", "fastq"), []
        for path, size in _files(self.options["path"]):
            if kind not in ("fastq", "sam") or path.endswith((".gz", ".bz2", ".xz")):
                out.append(_Part(path, len(out), 0, None))
            else:
                for at in range(0, max(size, 1), step):
                    out.append(_Part(path, len(out), at, min(at + step, size)))
        return out or [_Part("", 0, 0, 0)]

    def _blocks(self, part: _Part, f) -> Iterator[tuple]:
        on = lambda k: self.options.get(k, "false").lower() == "true"
        kind = self.options.get("kind", "fastq")
        if kind == "fastq":
            yield from fastq_blocks(f, part.path, part.start, part.stop, on("sra"), on("colorspace"))
        elif kind == "sam":
            yield from sam_blocks(f, part.path, part.start, part.stop, self.options.get("mates", "single"))
        elif kind == "bam":
            yield from bam_blocks(gzip.open(f, "rb"), part.path, self.options.get("mates", "single"))
        else:
            rows = fasta_records(f, part.path, self.options.get("join", ""), on("colorspace"))
            while block := list(itertools.islice(rows, 1000)):
                yield tuple(list(c) for c in zip(*block))

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        with _open(part.path, part.start) as f:
            if self.options.get("count") == "true":
                if self.options.get("kind", "fastq") == "fastq" and part.stop is not None:
                    n = fastq_count(f, part.start, part.stop)
                else:
                    n = sum(len(c[0]) for c in self._blocks(part, f))
                yield pa.RecordBatch.from_arrays([pa.array([part.split], pa.int32()), pa.array([n], pa.int64())], schema=_COUNTS)
                return
            n = 0
            for columns in self._blocks(part, f):
                k = len(columns[0])
                flag = columns[5] if len(columns) > 5 else [None] * k
                arrays = [pa.array([part.split] * k, pa.int32()), pa.array(range(n + 1, n + k + 1), pa.int64()), *(pa.array(c, pa.string()) for c in columns[:5]), pa.array(flag, pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, schema=_READS)
                n += k


class SequenceSource(DataSource):
    """format("helix_reads"): options path (a file or a folder of files), kind (fastq, fasta, sam or bam), split, join,
    colorspace, sra, mates, count (one row for each part, with the number of its records)."""

    @classmethod
    def name(cls) -> str:
        return "helix_reads"

    def schema(self) -> str:
        return "split int, n bigint" if self.options.get("count") == "true" else READ

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def _scan(spark: SparkSession, path: str, kind: str, **options) -> DataFrame:
    """read_idx from 1 in input order and the fields of the records.

    Each part numbers its own records as it reads them. Where there are several, a first pass counts the records of each
    part (of plain FASTQ by its line ends alone), and the sums of the parts before are joined: a row for each part, no
    shuffle of records.
    """
    spark.dataSource.register(SequenceSource)
    options = {"path": path, "kind": kind, **{k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}}
    load = lambda **more: spark.read.format("helix_reads").options(**options, **more).load()
    raw = load()
    fields = [F.col(c) for c in ("name", "name2", "sequence", "qualities", "primer", *(["flag"] if kind in ("sam", "bam") else []))]
    if len(_Reader(options).partitions()) == 1:
        return raw.select(F.col("n").alias("read_idx"), *fields)
    before = F.coalesce(F.sum("n").over(Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = load(count="true").select(F.col("split").alias("part"), before.alias("before"))
    return raw.join(counts, F.col("split") == F.col("part")).select((F.col("before") + F.col("n")).alias("read_idx"), *fields)


def read_fastq(spark: SparkSession, path: str, **options) -> DataFrame:
    return _scan(spark, path, "fastq", **options)


def read_fasta(spark: SparkSession, path: str, keep_linebreaks: bool = False, **options) -> DataFrame:
    return _scan(spark, path, "fasta", join="\n" if keep_linebreaks else "", **options)


def read_fasta_qual(spark: SparkSession, fasta: str, qual: str, colorspace: bool = False) -> DataFrame:
    """FASTA with a file of decimal qualities; names must agree record by record."""
    a, b = read_fasta(spark, fasta, colorspace=colorspace), _scan(spark, qual, "fasta", join=" ")
    chars = F.array_join(F.transform(F.filter(F.split("q", r"\s+"), lambda x: x != ""), lambda x: F.char(x.cast("int") + 33)), "")
    both = a.drop("qualities").join(b.select("read_idx", F.col("name").alias("qname"), F.col("sequence").alias("q")), "read_idx", "full_outer")
    ok = F.col("name").isNotNull() & F.col("qname").isNotNull() & (F.regexp_extract("name", r"^(\S*)", 1) == F.regexp_extract("qname", r"^(\S*)", 1))
    q = F.when(~F.coalesce(ok, F.lit(False)), F.raise_error(F.lit("sequence and quality files don't agree"))).otherwise(chars)
    return both.select("read_idx", "name", "name2", "sequence", q.alias("qualities"), "primer")


def pair_up(one: DataFrame, two: DataFrame) -> DataFrame:
    """read_idx, r1, r2 from two scans; an error where a mate is missing or names differ."""
    from helixframe.functions.dna import names_match

    pack = lambda d, n: d.select("read_idx", F.struct(*[c for c in d.columns if c != "read_idx"]).alias(n))
    both = pack(one, "r1").join(pack(two, "r2"), "read_idx", "full_outer")
    missing = F.col("r1").isNull() | F.col("r2").isNull()
    differ = ~names_match(F.col("r1.name"), F.col("r2.name"))
    fault = F.when(missing, F.raise_error(F.lit("the files hold different numbers of reads"))).when(differ, F.raise_error(F.concat(F.lit("names of mates differ: "), F.col("r1.name"))))
    return both.withColumn("read_idx", F.coalesce(fault.cast("bigint"), F.col("read_idx")))


def interleaved(reads: DataFrame) -> DataFrame:
    """Pairs from records that alternate; an error for an odd count."""
    odd = reads.where(F.col("read_idx") % 2 == 1).withColumn("read_idx", F.expr("(read_idx + 1) div 2"))
    even = reads.where(F.col("read_idx") % 2 == 0).withColumn("read_idx", F.expr("read_idx div 2"))
    return pair_up(odd, even)


def read_sam(spark: SparkSession, path: str, mates: str = "single", kind: str = "sam", **options) -> DataFrame:
    """Records of SAM text or BAM. mates: single (all records), 1 or 2 (that mate), paired (mates by name, in the order of
    the first mates; an error where one is missing)."""
    if mates != "paired":
        return _scan(spark, path, kind, mates=mates, **options).drop("flag")
    keep = ["name", "name2", "sequence", "qualities", "primer"]
    one, two = (_scan(spark, path, kind, mates=m, **options) for m in "12")
    a = one.select("read_idx", F.struct(*keep).alias("r1"))
    b = two.select(F.col("name").alias("n2"), F.struct(*keep).alias("r2"))
    both = a.join(b, F.col("r1.name") == F.col("n2"), "full_outer").drop("n2")
    fault = F.when(F.col("r1").isNull() | F.col("r2").isNull(), F.raise_error(F.lit("a mate is missing")))
    return both.withColumn("read_idx", F.coalesce(fault.cast("bigint"), F.col("read_idx")))


def read_bam(spark: SparkSession, path: str, mates: str = "single") -> DataFrame:
    """BAM in the standard library's gzip: one part for each file."""
    return read_sam(spark, path, mates, "bam")


def read_accession(spark: SparkSession, accession: str) -> DataFrame:
    raise RuntimeError(f"{accession}: reads can't be streamed from an archive without a network")


def open_reads(spark: SparkSession, path: str, path2: str | None = None, *, qual: str | None = None, format: str | None = None, interleave: bool = False, colorspace: bool = False, mates: str = "single") -> DataFrame:
    """The scan that the arguments ask for: two files, a quality file, a format, the name, then the contents decide."""
    if path2:
        return pair_up(open_reads(spark, path, format=format, colorspace=colorspace), open_reads(spark, path2, format=format, colorspace=colorspace))
    if qual:
        return read_fasta_qual(spark, path, qual, colorspace)
    kind = format or guess_format(path) or sniff(path)
    sra = kind == "sra-fastq"
    if kind == "sam":
        return read_sam(spark, path, mates)
    if kind == "bam":
        return read_bam(spark, path, mates)
    reads = read_fasta(spark, path, colorspace=colorspace) if kind == "fasta" else read_fastq(spark, path, colorspace=colorspace or sra, sra=sra)
    return interleaved(reads) if interleave else reads


def first_reads(reads: DataFrame, n: int) -> DataFrame:
    """The first n in input order."""
    return reads.where(F.col("read_idx") <= n)


def subsample(reads: DataFrame, fraction: float, seed: int | None = 0) -> DataFrame:
    """Each read with a chance, by the hash of its number: reruns with a seed agree whatever the partitions."""
    if seed is None:
        return reads.sample(False, fraction)
    return reads.where(F.pmod(F.xxhash64("read_idx", F.lit(seed)), F.lit(1 << 30)) < int(fraction * (1 << 30)))

