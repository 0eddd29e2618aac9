import math
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from caseweave.llm import language
from caseweave.llm.common import held_out, table
from tests.llm.helpers import awkward, docs


@pytest.fixture(scope="module")
def real(spark):
    return table(spark, "/root/testdata/sf0.001", "documents")


def test_held_out_accuracy(spark, real):
    model = language.fit(real)
    got = language.identify(real, model).join(real.select("doc_id", "lang"), "doc_id").collect()
    away = [r for r in got if r["held_out"]]
    assert len(away) > 20 and sum(r["lang_pred"] == r["lang"] for r in away) / len(away) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_learns_only_from_rows_not_held_out(spark, real):
    hidden = real.withColumn("lang", __import__("pyspark.sql.functions", fromlist=["when"]).when(~held_out(real["doc_id"]), real["lang"]))
    a, b = language.fit(real), language.fit(hidden)
    assert a.languages == b.languages and a.word_rows == b.word_rows and np.array_equal(a.word_logs, b.word_logs)


def test_backs_off_word_by_word_like_the_plain_rule(spark, real):
    model = language.fit(real, max_words=200, max_grams=600)

    def plain(word):
        row = model.word_rows.get(word)
        if row is not None:
            return model.word_logs[row]
        marked, found = "\x02" + word + "\x03", []
        for i in range(len(marked)):
            for n in (5, 4, 3, 2, 1):
                piece = marked[i : i + n]
                if len(piece) == n and piece in model.gram_rows:
                    found.append(model.gram_logs[model.gram_rows[piece]])
                    break
        return sum(found) / len(found) if found else np.zeros(len(model.languages))

    for r in real.limit(30).collect():
        counted = Counter(language.words(r["text"]))
        total = sum(n * plain(w) for w, n in counted.items()) / math.sqrt(sum(counted.values()))
        odds = np.exp(total - total.max())
        (name,), (score,) = model.predict_all([r["text"]])
        assert name == model.languages[int(odds.argmax())] and score == pytest.approx(odds.max() / odds.sum())


def test_awkward_rows(spark):
    given = docs(spark, awkward())
    got = {r["doc_id"]: r for r in language.identify(given, language.fit(given)).collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == got[3]["lang_pred"] == "und" and got[1]["score"] == 0.0
    assert got[7]["lang_pred"] in ("en", "de") and language.identify(given, language.fit(given)).count() == len(awkward())
    empty = docs(spark, [])
    assert language.identify(empty, language.fit(empty)).count() == 0
    unlearned = language.identify(given, language.fit(empty)).collect()
    assert {r["lang_pred"] for r in unlearned} == {"und"}


def test_stage_keeps_clean_rows(spark, real):
    kept = language.keep_identified(real, language.fit(real))
    assert kept.columns == real.columns and kept.count() == real.count()
    given = docs(spark, awkward())
    left = language.keep_identified(given, language.fit(given))
    assert left.columns == given.columns and not {1, 2, 3} & {r["doc_id"] for r in left.collect()}


def test_every_label_is_a_language(spark):
    """300 labels of their own words: none is left out for being rare, and the tables stay within their bound."""
    rows = [(i, f"{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100]} " * 3, f"l{i}") for i in range(300) if __import__("zlib").crc32(str(i).encode()) % 4 != 2]
    model = language.fit(docs(spark, rows), max_cells=300 * 400)
    assert len(model.languages) == len(rows) and model.word_logs.size <= 300 * 400
    names, _ = model.predict_all([r[1] for r in rows])
    assert names == [r[2] for r in rows]


def test_batches_of_any_size_agree(spark, real):
    model = language.fit(real, max_words=300, max_grams=500)
    texts = [r["text"] for r in real.limit(60).collect()] + [None, "", "123", "é" * 3_000_000, "a b " * 400_000]
    names, scores = model.predict_all(texts)
    for k, t in enumerate(texts):
        (name,), (score,) = model.predict_all([t])
        assert name == names[k] and score == pytest.approx(scores[k])
    assert names[-5:-2] == ["und"] * 3


def test_every_labelled_row_is_counted(spark):
    """Each row has a word of its own; all rows that are not held out teach theirs, however many a label has."""
    rows = [(i, f"word {chr(97 + i % 26)}{'abcdefghij'[i // 26 % 10]}{'klmnopqrst'[i // 260 % 10]}{'uvwxyz'[i // 2600]}", "en") for i in range(9_000)] + [(9_000 + i, f"wort {'ab'[i % 2]}ß", "de") for i in range(40)]
    given = docs(spark, rows)
    want = {w for r in given.where(~held_out(given["doc_id"])).select("text").collect() for w in language.words(r["text"])}
    assert len(want) > 5_000 and set(language.fit(given).word_rows) == want


def test_counts_meet_on_the_driver_as_columns():
    names = [f"w{i:06}" for i in range(60_000)]
    found = pa.table({"lang": ["en", "de"] * 60_000, "word": [w for w in names for _ in range(2)], "n": list(range(120_000))}).slice(1)
    tracemalloc.start()
    known, table = language.counted_table(found, ["de", "en", "fr"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert known == names and table[0].tolist() == [1, 0, 0] and table[7].tolist() == [15, 14, 0]
    assert peak < 20e6
    model = language.Model.of_counts(["de", "en", "fr"], known, table, ["a", "ab"], np.ones((2, 3)))
    again = language.Model.of_tables(*model.tables())
    assert again.word_rows == model.word_rows and again.gram_rows == model.gram_rows and np.array_equal(again.gram_logs, model.gram_logs)
