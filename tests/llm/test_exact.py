import re
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from caseweave.llm import exact
from tests.llm.helpers import awkward, docs


def expected(rows):
    groups = {}
    for r in rows:
        text = re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")
        groups.setdefault(text, []).append(r[0])
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        digest = sha256(text.encode()).hexdigest()
        first = True
        for i in ids:
            out.append((i, keep, len(ids), i == keep and first, digest))
            first = first and i != keep
    return sorted(out, key=repr)


@pytest.mark.parametrize("salts", [1, 7])
def test_groups_by_content(spark, salts):
    rows = awkward()
    got = exact.exact_groups(docs(spark, rows).repartition(5), salts)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows)


def test_colliding_digests_are_told_apart(spark):
    rows = [(i, "abc" if i % 3 else "xyz") for i in range(30)] + [(99, "other text")]
    got = exact.exact_groups(docs(spark, rows), digest=lambda c: F.length(c).cast("string"))
    keep = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in got.collect()}
    assert keep[3] == (0, 10) and keep[4] == (1, 20) and keep[99] == (99, 1)


def test_stage_keeps_columns_and_one_row_each(spark):
    rows = awkward()
    given = docs(spark, rows)
    stay = exact.drop_exact(given)
    assert stay.columns == given.columns
    assert stay.count() == len({re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows})
    assert {r["doc_id"] for r in stay.collect()} == {1, 3, 4, 7, 9, 10, None}


def test_empty_table(spark):
    assert exact.exact_groups(docs(spark, [])).count() == 0
    assert exact.drop_exact(docs(spark, [])).count() == 0


def test_no_python_in_the_plan(spark):
    plan = exact.exact_groups(docs(spark, awkward()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
