"""What the chained queries share: scaled rows, and cells before and after."""

import pytest

from catalog import chains
from catalog.base import CODEBOOK, KEYS, encoded
from lacuna.functions.frames import to_cells, to_wide
from lacuna.operators import encode as e

KINDS = CODEBOOK.kinds


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_rows_are_scaled_as_their_cells(spark, sf):
    wide = encoded(spark, sf).select(*KEYS, *CODEBOOK.names)
    cells = to_cells(wide, KEYS, KINDS)
    scaler = e.fit_canonical(cells, ["cohort"])
    found = e.apply_canonical_wide(wide, scaler, ["cohort"], KINDS, rows=16)
    assert found.columns == wide.columns
    assert rows_of(found) == rows_of(to_wide(e.apply_canonical(cells, scaler, ["cohort"], rows=16), KEYS, CODEBOOK.names))
    with pytest.raises(Exception, match="no scaler for column cont_bal"):
        e.apply_canonical_wide(wide, scaler.filter("feature <> 'cont_bal'"), ["cohort"], KINDS).collect()


def test_cells_before_and_after_join_as_rows(spark):
    names = CODEBOOK.names
    schema = "cohort string, recordid string, " + ", ".join(f"{c} double" for c in names)
    rest = [1.0] * (len(names) - 1)
    before = spark.createDataFrame([("A", "1", 1.0, *rest), ("A", "2", None, *rest), ("A", "3", None, *rest), ("A", "4", None, *rest), ("A", "5", 2.0, *rest), ("B", "6", 7.0, *rest)], schema)
    after = spark.createDataFrame([("A", "1", 1.0, *rest), ("A", "2", 2.0, *rest), ("A", "3", 7.0, *rest), ("A", "4", None, *rest), ("A", "5", 3.0, *rest), ("B", "6", 7.0, *rest)], schema)
    found = {(r["cohort"], r["feature"]): tuple(r)[2:] for r in chains.drawn_from_observed(before, after).collect()}
    assert found["A", names[0]] == (4, 1, 1)  # 2 was observed in A, 7 only in B; one stays open, one was changed
    assert found["B", names[0]] == (1, 1, 0) and found["A", names[1]] == (5, 5, 0) and len(found) == 2 * len(names)
    cells = chains.before_and_after(before, after)
    assert cells.count() == 6 * len(names)
    joins = [line for line in cells._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert len(joins) == 1 and "feature" not in joins[0]  # one row of a record meets the other
