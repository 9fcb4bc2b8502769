"""Adapters in colour space: nulls, empty reads, errors and kinds."""

import pytest

from helixframe.operators import adapters as ad
from helixframe.operators.colours import colours_of, cut_colour_adapter, recoloured


def test_scalars():
    assert colours_of("GATTAC") == "23031" and colours_of("G") == "" and colours_of("ANC") == ".."
    assert recoloured("T", "C", colours_of("CG")) == colours_of("TG") and recoloured("", "C", "1") == "." and recoloured("T", "C", ".") == "."


def test_cut(spark):
    back, front = colours_of("GATTACA"), "ACG"
    rows = [
        (1, "T", "0011" + back + "2", "I" * (5 + len(back))),
        (2, "T", "0011" + back[:2] + "1" + back[3:] + "2", None),  # one error in six
        (3, None, "", ""),
        (4, None, None, None),
        (5, "T", back, "I" * len(back)),
        (6, "T", "0123", "IIII"),
    ]
    reads = spark.createDataFrame([(i, f"r{i}", s, q, p) for i, p, s, q in rows], "read_idx long, name string, sequence string, qualities string, primer string")
    got = {r.read_idx: r for r in cut_colour_adapter(reads, ad.Adapter("b", "GATTACA", max_error_rate=0.2)).collect()}
    assert got[1].sequence == "001" and got[1].qualities == "III" and got[1].adapter_name == "b"
    assert got[2].sequence == "001" and got[2].qualities is None and got[2].matches[0].errors == 1
    assert got[3].sequence == "" and got[4].sequence is None and got[5].sequence == "" and got[6].adapter_name is None
    rows = [(1, "T"), (2, None), (3, "N"), (4, "G")]
    reads = spark.createDataFrame([(i, "r", colours_of(f"{p or 'T'}{front}TTGA"), None, p) for i, p in rows], "read_idx long, name string, sequence string, qualities string, primer string")
    got = {r.read_idx: r for r in cut_colour_adapter(reads, ad.Adapter("f", front, "prefix")).collect()}
    assert got[1].sequence == colours_of("TTTGA") and got[4].sequence == colours_of("GTTGA")
    assert got[2].adapter_name is None and got[3].adapter_name is None


def test_errors(spark):
    reads = spark.createDataFrame([(1, "r", "0", None)], "read_idx long, name string, sequence string, qualities string")
    for sequence, where in (("0123", "front"), ("ACG", "anywhere"), ("", "prefix"), ("A", "back")):
        with pytest.raises(ValueError):
            cut_colour_adapter(reads, ad.Adapter("x", sequence, where))
