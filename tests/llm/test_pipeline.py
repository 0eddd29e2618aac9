import re

import corpus_pipeline
import __spark_entry__ as entry
from caseweave.llm import exact, leaks, near, packing
from caseweave.llm.common import table
from caseweave.session import materialise
from tests.llm.helpers import awkward, docs
from tests.llm.test_packing import check

FOLDER = "/root/testdata/sf0.001"


def test_stages_in_order_take_effect(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "near_dedup", "decontamination", "packing"]
    given = table(spark, FOLDER, "documents")
    kept, now = [], given
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = materialise(stage(spark, now, FOLDER))
        assert now.columns == given.columns and now.dtypes == given.dtypes
        kept.append({r["doc_id"] for r in now.select("doc_id").collect()})
    texts = {r["doc_id"]: r["text"] for r in given.collect()}
    assert kept[0] == set(texts)
    first = {}
    for i in sorted(texts):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[i]), i)
    assert kept[1] == set(first.values())
    left = given.where(given["doc_id"].isin(list(kept[1])))
    groups = near.near_groups(left).collect()
    assert kept[2] == {r["class_id"] for r in groups}
    left = left.where(left["doc_id"].isin(list(kept[2])))
    gone = {r["doc_id"] for r in leaks.leaked(left, table(spark, FOLDER, "benchmark")).collect()}
    assert kept[3] == kept[2] - gone
    pieces = corpus_pipeline.run(spark, FOLDER).collect()
    assert {p["doc_id"] for p in pieces} == kept[3]
    check(pieces, [(i, texts[i]) for i in kept[3]], packing.LENGTH)


def test_stages_bear_awkward_rows(spark):
    for rows in (awkward(), []):
        now = docs(spark, rows)
        columns = now.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = materialise(stage(spark, now, FOLDER))
            assert now.columns == columns
        materialise(corpus_pipeline.STAGES[-1][1](spark, now, FOLDER)).count()


def test_every_operator_is_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert {"op4_exact_dedup", "op5_warc", "op6_substring_dedup", "op7_suffix_array_dedup", "op11_phrase_collocations", "op13_chat_formatting"} <= set(entry.oracle_sql())
    assert exact.SALTS > 1
