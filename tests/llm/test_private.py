import itertools
import re
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given as cases
from hypothesis import settings
from hypothesis import strategies as st

from caseweave.llm import private
from caseweave.llm.common import table
from tests.llm.helpers import awkward, docs

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def literal(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    return [
        [m.span() for m in EMAIL.finditer(text)],
        [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))],
        [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))],
        [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15],
    ]


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


@settings(max_examples=200, deadline=None)
@cases(st.text(alphabet="01259a@.+- ()%é\n", max_size=60))
def test_base_spans_are_those_of_the_patterns(text):
    assert private.base_spans(text) == literal(text)


def test_hostile_lengths():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+" * 50_000, "a@" * 50_000, "1 " * 100_000, "+1" + " " * 100_000):
        private.base_spans(text)
    weights = np.zeros((len(private.FEATURES), len(private.KINDS)))
    for text in ("1" * 5_000, "a@" * 2_000, "12 345 6789 " * 300):
        private.added_spans(text, private.base_spans(text), weights)
    assert private.base_spans("9" * 5000 + ".1.1.1") == [[], [], [], []]


def test_documents_have_the_spans_of_the_patterns(spark):
    given = table(spark, "/root/testdata/sf0.01", "documents")
    texts = {r["doc_id"]: r["text"] for r in given.collect()}
    rows = private.personal_data(given).collect()
    assert len(rows) == len(texts) and sum(r["n_email"] for r in rows) > 0
    for r in rows:
        want = literal(texts[r["doc_id"]])
        names = ["email", "ip", "card", "phone"]
        base = ",".join(f"{k}:{a}:{b}" for k, own in zip(names, want) for a, b in own)
        assert r["base_sha256"] == sha256(base.encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == list(map(len, want))
        spans = [s for s in r["spans"].split(",") if s]
        assert set(filter(None, base.split(","))) <= set(spans)
        keys = [(names.index(k), int(a)) for k, a, _ in (s.split(":") for s in spans)]
        assert keys == sorted(keys) and len(spans) == sum(map(len, want)) + r["n_added"]


def test_adds_other_notations(spark):
    given = table(spark, "/root/testdata/sf0.01", "documents")
    weights = private.train(private.sample_windows(given))
    hits = {
        "please write to jane.doe (at) mail5.example.com if the ring is found": "email", "one may reach 42.17.200[.]9 from there as before": None, "call (456) 555-2186 when you can": "phone",
        "paid with 4539.1488.0343.6467 on that day": "card",
    }
    found = 0
    for text, kind in hits.items():
        spans = private.added_spans(text, private.base_spans(text), weights)
        found += kind is not None and bool(spans[private.KINDS.index(kind)])
    assert found >= 2
    for clean in ("version 3.0 of the license", "in 1987 there were 12 of them", "the year 2024, page 17", "no digits at all"):
        assert private.added_spans(clean, private.base_spans(clean), weights) == [[], [], [], []]


def test_bare_spelled_signs_open_windows(spark):
    given = table(spark, "/root/testdata/sf0.01", "documents")
    weights = private.train(private.sample_windows(given))
    for text in ("write to john.smith at example.com please", "or ask mary_jones at mail.example.org about the garden"):
        a, b = text.index(" at ") - 10, text.index(" ", text.index(" at ") + 4)
        assert private.added_spans(text, private.base_spans(text), weights)[0] == [(a, b)]
    assert private.windows("they met at noon. the rest stayed at home") == []


def test_best_segmentation_by_enumeration():
    text = "x 12-34 @a.b 5.6.7.8"
    lattice = private.Lattice(text)
    rng = np.random.default_rng(0)
    for _ in range(5):
        weights = rng.normal(size=(len(private.FEATURES), len(private.KINDS)))
        score = lattice.x @ weights
        best = 0.0
        for size in range(4):
            for chosen in itertools.combinations(range(len(lattice.keys)), size):
                spans = sorted(lattice.keys[k] for k in chosen)
                if all(a[1] < b[0] for a, b in zip(spans, spans[1:])):
                    best = max(best, sum(score[k].max() for k in chosen))
        got = sum(score[lattice.keys.index((i, j)), k] for i, j, k in lattice.best(weights))
        assert got >= best - 1e-9


def test_gradient_is_that_of_the_likelihood():
    lattice = private.Lattice("a 1.2 b@c.d")
    rng = np.random.default_rng(1)
    weights = rng.normal(size=(len(private.FEATURES), len(private.KINDS))) * 0.3
    gold = {lattice.keys[1]: 2}

    def likelihood(w):
        score = lattice.x @ w
        total = np.zeros(len(lattice.spans) + 1)
        for j in range(len(lattice.spans)):
            total[j + 1] = np.logaddexp.reduce([total[j], *(total[lattice.keys[k][0]] + v for k in lattice.ending[j] for v in score[k])])
        return score[1, 2] - total[-1]

    slope = lattice.gradient(weights, gold)
    for f, k in ((0, 2), (2, 1), (6, 0), (24, 3)):
        step = np.zeros_like(weights)
        step[f, k] = 1e-5
        assert slope[f, k] == pytest.approx((likelihood(weights + step) - likelihood(weights - step)) / 2e-5, abs=1e-4)


def test_awkward_rows(spark):
    rows = [*awkward(), (20, "é@ mail a@b.c\n10.0.0.1")]
    got = {r["doc_id"]: r for r in private.personal_data(docs(spark, rows)).collect()}
    assert got[1]["spans"] == got[2]["spans"] == "" and got[1]["base_sha256"] == sha256(b"").hexdigest()
    assert got[20]["spans"].startswith("email:8:13") and got[20]["n_ip"] == 1
    assert private.personal_data(docs(spark, [])).count() == 0
