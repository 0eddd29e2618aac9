import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import public_tokenizers
from caseweave.llm import packing
from caseweave.llm.common import table
from tests.llm.helpers import awkward, docs

WHOLE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids + [0]


def check(rows, given, length):
    """Every id once, sequences gapless and full but for the last, digests right."""
    pieces = [r.asDict() for r in rows]
    by = {}
    for p in pieces:
        by.setdefault(p["sequence_id"], []).append(p)
    total = sum(len(ids(t)) for _, t in given)
    assert sum(p["length"] for p in pieces) == total
    for s, own in by.items():
        own.sort(key=lambda p: p["offset"])
        at = 0
        for p in own:
            assert p["offset"] == at
            at += p["length"]
        assert at == (length if s < max(by) else total - length * max(by))
    assert sorted(by) == list(range(len(by))) 
    texts = {}
    for i, t in given:
        texts.setdefault(i, []).append(np.array(ids(t), "<u4"))
    for p in pieces:
        options = [t for t in texts[p["doc_id"]] if len(t) == p["doc_tokens"]]
        assert any(zlib.crc32(t[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for t in options)
    return by


@pytest.mark.parametrize("text", ["", " ", "a  b\n\n c", "it's <|endoftext|> here", "é ß 漢字 \U0001f600", "x" * 3000, "1234 5678", "\x00\x0b tab\t", "don't we'll I'M"])
def test_ids_are_those_of_the_tokenizer_file(text):
    assert packing.encoder("byte_bpe_50k.json")(text) == WHOLE.encode(text, add_special_tokens=False).ids


def test_ids_on_documents(spark):
    encode = packing.encoder("byte_bpe_50k.json")
    for r in table(spark, "/root/testdata/sf0.001", "documents").collect():
        assert encode(r["text"]) == WHOLE.encode(r["text"], add_special_tokens=False).ids


def test_whole_table_is_packed_once(spark):
    given = table(spark, "/root/testdata/sf0.001", "documents").repartition(4)
    rows = packing.pack(given, length=256, window_sequences=8).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in given.collect()], 256)


def test_windows_meet_the_target_within_a_token(spark):
    given = table(spark, "/root/testdata/sf0.001", "documents")
    length, per = 128, 4
    rows = packing.pack(given, length=length, window_sequences=per).collect()
    by = {}
    for r in rows:
        own = by.setdefault(r["source"], {})
        own[r["window_id"]] = own.get(r["window_id"], 0) + r["length"]
    whole = sum(r["length"] for r in rows)
    for own in by.values():
        n, got = sum(own.values()), 0
        for w in range(whole // (length * per)):
            got += own.get(w, 0)
            assert abs(got - (w + 1) * length * per * n / whole) <= 1


def test_given_targets_hold_until_a_queue_is_empty(spark):
    rows = [(i, "alpha beta gamma " * 30, "en", "small" if i < 10 else "large") for i in range(40)]
    got = packing.pack(docs(spark, rows), targets={"small": 0.5, "large": 0.5}, length=64, window_sequences=2).collect()
    check(got, [(r[0], r[1]) for r in rows], 64)
    small = sum(r["length"] for r in got if r["source"] == "small")
    first = [r for r in got if r["window_id"] < (2 * small) // 128]
    assert abs(sum(r["length"] for r in first if r["source"] == "small") - sum(r["length"] for r in first if r["source"] == "large")) <= 2


def test_sources_beyond_the_limit_share_a_queue(spark):
    rows = [(i, f"text number {i} of many", "en", f"s{i % 9}") for i in range(60)]
    check(packing.pack(docs(spark, rows).repartition(3), length=32, window_sequences=2, max_queues=3).collect(), [(r[0], r[1]) for r in rows], 32)


def test_awkward_rows(spark):
    rows = awkward()
    got = packing.pack(docs(spark, rows), length=512, window_sequences=4).collect()
    check(got, [(r[0], r[1]) for r in rows], 512)
    assert packing.pack(docs(spark, [])).count() == 0


def test_phases_give_every_token_once():
    for totals, targets in (([5, 0, 17, 3], None), ([100, 7, 0], [0.2, 0.7, 0.1]), ([9, 9], [1.0, 0.0])):
        phases = packing.plan(totals, targets, 8)
        seen = []
        for q, n in enumerate(totals):
            place = 0
            while place < n:
                size = min(3, n - place)
                seen += [p + k for _, m, p in packing.cut(phases, q, place, size, 4) for k in range(m)]
                place += size
        assert sorted(seen) == list(range(sum(totals)))
