"""Language identification by words first, then ever shorter character n-grams.

A word known to the model is scored by its log frequency in each language. Any other word
is read with sentinels at both ends, and each position takes the longest known n-gram that
starts there; every order given up costs a fixed penalty.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseweave.llm.common import held_out, pieces
from caseweave.session import materialise

WORD = re.compile(r"[^\W\d_]+")
ORDERS = (5, 4, 3, 2, 1)
GIVE_UP = math.log(0.4)
UNKNOWN = "und"
#: Bounds of the model: words and n-grams for all languages together, and numbers in either table (so with more
#: than 300 languages each keeps fewer words).
MAX_WORDS, MAX_GRAMS, MAX_CELLS = 120_000, 80_000, 40_000_000
#: Distinct words or n-grams a task holds before it passes its counts on.
TALLY = 200_000
COUNTS = "lang string, word string, n long"
#: Words outside the model whose scores a task remembers.
CACHE = 150_000


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def grams(word: str, order: int) -> list[str]:
    marked = f"\x02{word}\x03"
    return [marked[i : i + order] for i in range(len(marked) - order + 1)]


class Rows(dict):
    """Row of each word in a growing table of scores; an unknown word is scored once and added."""

    def __init__(self, model: Model):
        super().__init__(model.word_rows)
        self.model, self.size = model, len(model.word_rows)
        self.table = np.zeros((self.size + 1024, len(model.languages)))
        self.table[: self.size] = model.word_logs

    def __missing__(self, word: str) -> int:
        if self.size == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[self.size] = self.model.unseen(word)
        self[word] = self.size
        self.size += 1
        return self.size - 1


class Model:
    """Log frequencies by language; tables are bounded, so it may be broadcast."""

    def __init__(self, languages: list[str], word_rows: dict[str, int], word_logs: np.ndarray, gram_rows: dict[str, int], gram_logs: np.ndarray):
        self.languages, self.word_rows, self.word_logs, self.gram_rows, self.gram_logs = languages, word_rows, word_logs, gram_rows, gram_logs
        self.rows: Rows | None = None

    @classmethod
    def of_counts(cls, languages: list[str], known: list[str], word_counts: np.ndarray, parts: list[str], gram_counts: np.ndarray) -> Model:
        """Of tables of counts: a row for each word or n-gram, a column for each language."""
        def logs(table: np.ndarray) -> np.ndarray:
            return np.log((table + 0.1) / (table.sum(axis=0) + 0.1 * len(table) + 0.1))

        order_of = np.array([len(g) for g in parts], dtype=np.int64)
        gram_rows: dict[str, int] = {}
        stacked = [np.zeros((0, len(languages)))]
        for order in ORDERS:
            own = np.flatnonzero(order_of == order)
            base = len(gram_rows)
            gram_rows.update({parts[g]: base + i for i, g in enumerate(own.tolist())})
            stacked.append(logs(gram_counts[own]) + GIVE_UP * (ORDERS[0] - order))
        return cls(languages, {w: i for i, w in enumerate(known)}, logs(word_counts), gram_rows, np.vstack(stacked))

    def tables(self) -> tuple:
        """Plain values to ship to the tasks; words and n-grams hold no line ends, and their rows are in order."""
        return self.languages, "\n".join(self.word_rows), self.word_logs, "\n".join(self.gram_rows), self.gram_logs

    @classmethod
    def of_tables(cls, languages: list[str], known: str, word_logs: np.ndarray, parts: str, gram_logs: np.ndarray) -> Model:
        rows = ({w: i for i, w in enumerate(names.split("\n")) if w} for names in (known, parts))
        return cls(languages, next(rows), word_logs, next(rows), gram_logs)

    def unseen(self, word: str) -> np.ndarray:
        marked, rows = f"\x02{word}\x03", []
        known = self.gram_rows
        for i in range(len(marked)):
            for order in ORDERS:
                row = known.get(marked[i : i + order]) if i + order <= len(marked) else None
                if row is not None:
                    rows.append(row)
                    break
        return self.gram_logs[rows].mean(axis=0) if rows else np.zeros(len(self.languages))

    def predict_all(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language, score) of each text; the words of all texts are looked up, and then summed text by text."""
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, scores
        if self.rows is None or self.rows.size > len(self.word_rows) + CACHE:
            self.rows = Rows(self)
        ids: list[int] = []
        sizes = np.zeros(len(texts), dtype=np.int64)
        for k, text in enumerate(texts):
            own = words(text)
            sizes[k] = len(own)
            ids.extend(map(self.rows.__getitem__, own))
        full = np.flatnonzero(sizes)
        if len(full):
            n = sizes[full]
            total = np.add.reduceat(self.rows.table[np.array(ids)], np.cumsum(n) - n, axis=0)
            # the root of the length keeps a long text's dependent words from claiming certainty
            total = (total - total.max(axis=1, keepdims=True)) / np.sqrt(n)[:, None]
            for k, best in zip(full, total.argmax(axis=1)):
                names[k] = self.languages[best]
            scores[full] = 1.0 / np.exp(total).sum(axis=1)
        return names, scores


def counts(tally: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
    """The counts held, as rows of ``COUNTS``; the tally starts anew."""
    for lang, own in tally.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], ["lang", "word", "n"])
    tally.clear()


def counted_table(found: pa.Table, languages: list[str]) -> tuple[list[str], np.ndarray]:
    """(words in order, a row of counts by language for each) of rows of ``COUNTS``; as columns, not as an object for each row."""
    known = pa.array(sorted(pc.unique(found.column("word")).to_pylist()), pa.string())
    out = np.zeros((len(known), len(languages)))
    for batch in found.to_batches():
        row, column = pc.index_in(batch.column("word"), known), pc.index_in(batch.column("lang"), pa.array(languages, pa.string()))
        np.add.at(out, (row.to_numpy(zero_copy_only=False), column.to_numpy(zero_copy_only=False)), batch.column("n").to_numpy(zero_copy_only=False))
    return known.to_pylist(), out


def fit(docs: DataFrame, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS, max_cells: int = MAX_CELLS) -> Model:
    """Counts the words and n-grams of all labelled rows that are not held out.

    Every label is a language. All languages share the ``max_words`` most frequent words and the
    ``max_grams`` most frequent n-grams evenly, and neither table holds more than ``max_cells``
    numbers. Rows without a text, label or doc_id teach nothing.
    """
    labelled = docs.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    languages = sorted(r["lang"] for r in labelled.select("lang").distinct().collect())
    if not languages:
        return Model.of_counts([], [], np.zeros((0, 0)), [], np.zeros((0, 0)))

    def count_words(batches):
        tally: dict[str, Counter] = {}
        for batch in batches:
            for piece in pieces(batch, "text"):
                for text, lang in zip(piece.column("text").to_pylist(), piece.column("lang").to_pylist()):
                    tally.setdefault(lang, Counter()).update(words(text))
                if sum(map(len, tally.values())) > TALLY:
                    yield from counts(tally)
        yield from counts(tally)

    counted = labelled.select("text", "lang").mapInArrow(count_words, COUNTS).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    seen = materialise(counted, "langwords")

    def count_grams(batches):
        tally: dict[str, Counter] = {}
        for batch in batches:
            for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n"))):
                own = tally.setdefault(lang, Counter())
                for order in ORDERS:
                    for gram in grams(word, order):
                        own[gram] += n
            if sum(map(len, tally.values())) > TALLY:
                yield from counts(tally)
        yield from counts(tally)

    parts = materialise(seen.mapInArrow(count_grams, COUNTS).groupBy("lang", "word").agg(F.sum("n").alias("n")), "langgrams")

    def largest(counts: DataFrame, most: int) -> tuple[list[str], np.ndarray]:
        keep = min(most, max_cells // len(languages))
        rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "word"))
        top = counts.withColumn("rank", rank).where(F.col("rank") <= max(1, keep // len(languages))).select("word").distinct()
        return counted_table(counts.join(top, "word").select("lang", "word", "n").toArrow(), languages)

    return Model.of_counts(languages, *largest(seen, max_words), *largest(parts, max_grams))


def predictor(spark: SparkSession, model: Model):
    """A vectorised function text -> (lang_pred, score)."""
    shared = spark.sparkContext.broadcast(model.tables())

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Model.of_tables(*shared.value)
        for texts in batches:
            # a bounded number of texts at a time, as their words are held together
            parts = [own.predict_all(list(texts[at : at + 256])) for at in range(0, len(texts), 256)]
            yield pd.DataFrame({"lang_pred": [n for names, _ in parts for n in names], "score": np.concatenate([np.zeros(0), *(s for _, s in parts)])})

    return predict


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per input row.

    Null, empty and letterless texts are ``und`` with score 0; so is every text if nothing
    was learned. Ties go to the language first in the alphabet. Repeated rows are scored
    alike; other columns are ignored, whatever their names.
    """
    predict = predictor(docs.sparkSession, model)
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict(F.col("text")).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose language is told with a score of at least ``least``, with all their columns.

    Null, empty and letterless texts have the score 0 and go, as does every text if nothing was
    learned. Rows with a null doc_id and repeated rows are judged like any other; an empty table stays empty.
    """
    predict = predictor(docs.sparkSession, model)
    return docs.where(predict(F.col("text"))["score"] >= least)
