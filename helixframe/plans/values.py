"""Values of options: sizes, chances, lists, statistics, sample names; and reports as plain rows or text."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator, Sequence

_UNITS = {"": 1, "k": 1_000, "m": 1_000_000, "g": 1_000_000_000}


def whole_number(text: str | int) -> int:
    """A number that may end in K, M or G."""
    if isinstance(text, int):
        return text
    m = re.fullmatch(r"\s*(-?\d+)\s*([kmg]?)\s*", text, re.I)
    if not m:
        raise ValueError(f"{text} is no whole number")
    return int(m[1]) * _UNITS[m[2].lower()]


def number_or_text(text: str) -> int | str:
    try:
        return whole_number(text)
    except ValueError:
        return text


def positive(text: str | int) -> int:
    n = whole_number(text)
    if n < 0:
        raise ValueError(f"{text} is below 0")
    return n


def chance(text: str | float) -> float:
    p = float(text)
    if not 0 <= p <= 1:
        raise ValueError(f"{text} doesn't lie between 0 and 1")
    return p


def delimited(text: str, kind: Callable = str, least: int | None = None, most: int | None = None, by: str = ",") -> list:
    """The parts of a list, each of a kind; an error for fewer or more than allowed."""
    got = [kind(x.strip()) for x in text.split(by)] if text.strip() else []
    if least is not None and len(got) < least or most is not None and len(got) > most:
        raise ValueError(f"{text} has {len(got)} parts")
    return got


def letters(text: str, among: str) -> str:
    """A list of letters, upper-cased, all of them among those allowed."""
    got = text.upper()
    if set(got) - set(among):
        raise ValueError(f"{text} holds other letters than {among}")
    return got


def statistics_wanted(text: str) -> dict[str, dict[str, str]]:
    """name:key=value:key=value;name... as a dictionary; a key without a value is true."""
    out: dict[str, dict[str, str]] = {}
    for part in filter(None, (x.strip() for x in text.split(";"))):
        name, *options = part.split(":")
        out[name.strip()] = {k.strip(): v.strip() if sep else "true" for k, sep, v in (o.partition("=") for o in options)}
    return out


def sample_name(path: str, path2: str | None = None) -> str:
    """The file's name without its endings; of two files what their names begin with in common."""
    bare = lambda p: re.sub(r"\.(fastq|fq|fasta|fa|fna|csfasta|qual|sam|bam|txt)$", "", re.sub(r"\.(gz|bz2|xz)$", "", os.path.basename(p), flags=re.I), flags=re.I)
    name = bare(path)
    if path2 is not None:
        name = os.path.commonprefix([name, bare(path2)])
    return re.sub(r"[._-]+[rR]?$", "", name) or bare(path)


def shortened(text: str | None, most: int = 100) -> str | None:
    """At most so many characters, the last three of a cut text being dots."""
    return text if text is None or len(text) <= most else text[: max(0, most - 3)] + "..."


def numbered_in(items: Sequence, first: int, stop: int) -> Iterator[tuple[int, object]]:
    """The items as often as the numbers from first to stop go, each with its number."""
    yield from zip(range(first, stop), items)


def readable(path: str) -> str:
    """The path, an error if it is no file or folder that can be read; - passes."""
    if path != "-" and "://" not in path and not os.access(path, os.R_OK):
        raise ValueError(f"{path} can't be read")
    return path


def writable(path: str) -> str:
    """The path, an error if its folder can't be written; - passes."""
    if path != "-" and "://" not in path and not os.access(os.path.dirname(os.path.abspath(path)), os.W_OK):
        raise ValueError(f"{path} can't be written")
    return path


def rows(nested, path: tuple = ()) -> list[tuple]:
    """A nested report as rows of its path and value: dictionaries by key, lists by place."""
    if isinstance(nested, dict):
        return [r for k, v in nested.items() for r in rows(v, (*path, k))]
    if isinstance(nested, (list, tuple)):
        return [r for k, v in enumerate(nested) for r in rows(v, (*path, k))]
    return [(*path, nested)]


def as_yaml(value, depth: int = 0) -> str:
    """Dictionaries, lists and plain values as YAML; texts are quoted as in JSON."""
    import json

    pad = "  " * depth
    if isinstance(value, dict) and value:
        return "".join(f"{pad}{json.dumps(str(k))}:" + (f"\n{as_yaml(v, depth + 1)}" if isinstance(v, (dict, list)) and v else f" {as_yaml(v)}") for k, v in value.items())
    if isinstance(value, list) and value:
        return "".join(f"{pad}-" + (f"\n{as_yaml(v, depth + 1)}" if isinstance(v, (dict, list)) and v else f" {as_yaml(v)}") for v in value)
    return json.dumps(value) + "\n"
