import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from quern.operators.unpack import scan_batch, scan_one, unpack_field

CASES = [
    (None, []),
    ("", []),
    (" \t\n", []),
    ("None", []),
    ("[]", []),
    ("A | B;C,\tD\nE / F • G", list("ABCDEFG")),
    ("CI/CD and DevOps | a/b", ["CI/CD and DevOps", "a/b"]),
    ('"Bots, Scripts; Glue" | x', ["Bots, Scripts; Glue", "x"]),
    ("'a | b', c", ["a | b", "c"]),
    ('"Say ""Hi"", all"; y', ['Say "Hi", all', "y"]),
    ("Contributor's Handbook, Maintainers' Wellbeing", ["Contributor's Handbook", "Maintainers' Wellbeing"]),
    ("['x, y', \"M's\"]", ["x, y", "M's"]),
    ('["a\\tb", "say \\"q\\""]', ["a\tb", 'say "q"']),
    ("['it\\'s', 'b']", ["it's", "b"]),
    ('"open, never closed | b', ['"open', "never closed", "b"]),
    (";; a ;; , a;", ["a", "a"]),
    (" a |b　", ["a", "b"]),
    ("é | 日本語", ["é", "日本語"]),
    ("x" * 100_000 + "|y", ["x" * 100_000, "y"]),
]


@pytest.mark.parametrize("field,values", CASES)
def test_cases(field, values):
    assert scan_batch(pa.array([field], pa.string())).to_pylist() == [values]
    assert scan_one(field or "") == values


def test_whole_batch_and_slices():
    fields = pa.array([c[0] for c in CASES], pa.string())
    assert scan_batch(fields).to_pylist() == [c[1] for c in CASES]
    assert scan_batch(fields.slice(5, 7)).to_pylist() == [c[1] for c in CASES[5:12]]
    assert scan_batch(fields.slice(0, 0)).to_pylist() == []


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet="ab'\"|,; /\t[]\\•", max_size=12), max_size=6))
def test_buffers_agree_with_characters(fields):
    assert scan_batch(pa.array(fields, pa.string())).to_pylist() == [scan_one(f) for f in fields]


def test_frame(spark):
    df = spark.createDataFrame([(1, "a|b", 9), (None, "c", 9), (1, "a|b", 9), (2, None, 9)], "row_id long, category string, pos long")
    rows = sorted((r.row_id or 0, r.pos, r.val) for r in unpack_field(df, "row_id", "category").collect())
    assert rows == [(0, 1, "c"), (1, 1, "a"), (1, 1, "a"), (1, 2, "b"), (1, 2, "b")]
    assert unpack_field(df.limit(0), "row_id", "category").count() == 0
