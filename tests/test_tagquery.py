"""The tag-query language: every form of its grammar built up piece by piece, and the number rules by enumeration."""

import itertools
import re

import pytest
from pyspark.sql import functions as F

from terrafold.functions import tags
from terrafold.operators.tagquery import Clause, Operand, QueryError, compile_query, parse

#: Clauses by form, each with what it is read as.
CLAUSES = {
    "[fee]": Clause("fee", "has"), "[!fee]": Clause("fee", "lacks"), "[ ! fee ]": Clause("fee", "lacks"), "['fee']": Clause("fee", "has"), "[2nd]": Clause("2nd", "has"),
    "[ref:x=y]": Clause("ref:x", "=", (Operand("text", "y"),)), "[fee==y]": Clause("fee", "=", (Operand("text", "y"),)), '[fee="y z"]': Clause("fee", "=", (Operand("text", "y z"),)),
    "[fee!=y,z]": Clause("fee", "!=", (Operand("text", "y"), Operand("text", "z"))), "[fee=y*]": Clause("fee", "=", (Operand("prefix", "y"),)),
    "[fee=*y]": Clause("fee", "=", (Operand("suffix", "y"),)), "[fee=*y*]": Clause("fee", "=", (Operand("part", "y"),)), "[fee='*y z']": Clause("fee", "=", (Operand("suffix", "y z"),)),
    "[fee=*]": Clause("fee", "=", (Operand("part", ""),)), "[fee=3,y]": Clause("fee", "=", (Operand("number", "3", 3.0), Operand("text", "y"))),
    "[fee~'y.']": Clause("fee", "~", (Operand("regex", "y."),)), '[fee!~"y"]': Clause("fee", "!~", (Operand("regex", "y"),)),
    **{f"[fee{op}1.5]": Clause("fee", op, (Operand("number", "1.5", 1.5),)) for op in ("<", "<=", ">", ">=")},
}
TYPES = ["", "*", *("".join(p) for n in (1, 2, 3, 4) for p in itertools.permutations("nwar", n))]


@pytest.mark.parametrize("text", CLAUSES)
def test_clauses(text):
    assert parse(text)[0].clauses == (CLAUSES[text],)
    assert parse(f"wn{text}{text} , r")[0].clauses == (CLAUSES[text],) * 2


def test_types_and_selectors():
    for letters in TYPES:
        (found,) = parse(f"{letters}[fee]")
        assert found.types == letters.strip("*")
        if letters:
            assert parse(f" {letters} ,\ta[fee]")[0].clauses == ()


def test_what_the_grammar_lacks_is_an_error():
    whole = [c for c in CLAUSES if " " not in c]
    broken = [c[:-1] for c in whole] + [f"{c}]" for c in whole] + [f"{c}," for c in whole] + [f",{c}" for c in whole] + [f"{c}q" for c in whole]
    broken += [f"{a}{b}[fee]" for a in "nwar" for b in a] + ["", " ", "q", "*n", "[]", "[!]", "[fee=]", "[fee=,y]", "[fee!3]", "[fee=y-z]"]
    broken += [f"[fee{op}{v}]" for op in ("<", "<=", ">", ">=") for v in ("", "y", "'3'", "1,2")] + [f"[fee{op}{v}]" for op in ("~", "!~") for v in ("", "y", "3", "'('", "'y")]
    for text in broken:
        with pytest.raises(QueryError, match="at [0-9]+"):
            parse(text)


def leading(text):
    """The rule in Python: blanks, a minus, digits with at most one point; a point alone is no number."""
    found = re.match("[\\x00- ]*(-?([0-9]+([.][0-9]*)?|[.][0-9]+))", text)
    return float(found[1]) if found else None


def test_numbers(spark):
    signs, bodies, rests = ("", "-", "+", "--", " -"), ("", "0", "7", "042", "6.", ".75", "3.25", "..5", "812.0040", "9" * 18), ("", " km", "km", ".3", "-5", "e2", " 4")
    texts = ["".join(x) for x in itertools.product(signs, bodies, rests)]
    df = spark.createDataFrame([(v,) for v in texts], "v string")
    assert [r[0] for r in df.select(tags.number(F.col("v"))).collect()] == [leading(v) for v in texts]


def stored(text):
    """The rule in Python: a decimal that prints back as it is, of three places at most, whose digits are in range."""
    if not re.fullmatch("-?(0|[1-9][0-9]*)([.][0-9]{1,3})?", text, re.A) or re.fullmatch("-0([.]0*)?", text):
        return False
    return tags.LEAST_DIGITS <= int(text.replace(".", "")) <= tags.MOST_DIGITS


def test_stored_numbers(spark):
    least, most = tags.LEAST_DIGITS, tags.MOST_DIGITS
    texts = [str(least), str(least - 1), str(most), str(most + 1), f"{str(most)[:-3]}.{str(most)[-3:]}", f"{str(most + 1)[:-3]}.{str(most + 1)[-3:]}"]
    texts += ["".join(x) for x in itertools.product(("", "-"), ("", "0", "00", "8", "08", "31"), ("", ".", ".4", ".40", ".400", ".4000"), ("", " ", "\n", "m"))]
    df = spark.createDataFrame([(v,) for v in texts], "v string")
    assert [bool(r[0]) for r in df.select(tags.stored_number(F.col("v"))).collect()] == [stored(v) for v in texts]


def test_key_bits_only_prune_what_cannot_match(spark):
    rows = [(0, False, {"shop": "x"}, 1), (0, False, {"odd": "y"}, 0)]
    df = spark.createDataFrame(rows, "type int, is_area boolean, tags map<string,string>, key_bits int")
    count = lambda q: df.where(compile_query(q, {"shop": 0})).count()
    assert count("n[shop]") == 1 and count("n[shop],n[odd]") == 2 and count("n[!shop]") == 1 and count("n[shop!=z]") == 2
