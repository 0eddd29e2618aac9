import random
import re
from collections import Counter

import duckdb
import numpy as np

from caseweave.llm import phrases, plans
from tests.llm.helpers import awkward, docs

NAMES = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, least, top=2000):
    """The rule said plainly: every occurrence of every phrase counted one by one."""
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = lang if lang is not None else "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for m in range(1, 5):
                f.update((lang, *ws[i : i + m]) for i in range(len(ws) - m + 1))
    kept = {}
    cand = {k: v for k, v in f.items() if len(k) > 2 and v >= least}
    gone = set()
    for (lang, *ws), v in cand.items():
        for m in range(2, len(ws)):
            for i in range(len(ws) - m + 1):
                sub = (lang, *ws[i : i + m])
                if 100 * v >= 80 * f[sub]:
                    gone.add(sub)
    for (lang, *ws), a in cand.items():
        if (lang, *ws) in gone:
            continue
        score, k = min((2_000_000 * a // (f[(lang, *ws[:k])] + f[(lang, *ws[k:])]), k) for k in range(1, len(ws)))
        kept.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), f[(lang, *ws[:k])], f[(lang, *ws[k:])]))
    return sorted((lang, i + 1, p.decode(), -a, le, r, n[lang], -s) for lang, own in kept.items() for i, (s, a, p, le, r) in enumerate(sorted(own)[:top]))


def corpus(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["É", "ß", "Ab", "aB"]
    out = []
    for i in range(120):
        text = "".join(rng.choices(words, [30, 20, *([4] * 14)])[0] + rng.choice([" "] * 8 + ["\t ", ", ", "\n", ". ", "\x0b"]) for _ in range(rng.randrange(0, 90)))
        out.append((i, text + "w3 w4 w5 w6" * (i % 3 == 0), rng.choice(["en", "de", None])))
    return out


def got(frame):
    return sorted(map(tuple, frame.select(NAMES).collect()))


def test_against_brute_force_at_every_budget(spark):
    rows = corpus()
    given = docs(spark, [(*r, "s") for r in rows]).repartition(3)
    for least, top, budget, chunk in ((5, 2000, 10**6, 10**6), (5, 2000, 40, 64), (3, 7, 10, 1000), (8, 50, 3, 200)):
        assert got(phrases.collocations(given, least, top, budget=budget, chunk_words=chunk)) == brute(rows, least, top)


def test_groups_stay_within_twice_the_budget(spark):
    keys = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 3000)
    weights = np.random.default_rng(3).integers(1, 400, 3000)
    level = phrases.next_level(spark.createDataFrame(list(zip(keys.tolist(), weights.tolist())), "key long, n long"), 300, 5, False)
    light = weights <= 300
    assert set(level.heavy.view(np.int64).tolist()) == set(keys[~light].tolist()) and level.group_of.min() == 5
    sums = Counter()
    for k, w in zip(keys[light].view(np.uint64), weights[light]):
        sums[level.group_of[int(k >> np.uint64(64 - level.bits))]] += w
    assert max(sums.values()) <= 2 * 300 + 300 and len(sums) > 500


def test_shared_keys_are_noticed(spark, monkeypatch):
    """Keys that two words share are replaced by others: the result is that of the plain rule."""
    rows, seeds, plain = corpus(7), [], phrases.count_words
    monkeypatch.setattr(phrases, "count_words", lambda given, seed: clashing_keys(plain(given, seed), seed, seeds))
    assert got(phrases.collocations(docs(spark, [(*r, "s") for r in rows]), 5)) == brute(rows, 5) and seeds == [0, 1]


def clashing_keys(words, seed, seeds):
    from pyspark.sql import functions as F

    seeds.append(seed)
    return words if seed else words.withColumn("key", F.lit(1).cast("bigint"))


def test_awkward_rows(spark):
    rows = awkward()
    many = rows + [(20, "Of the of the. " * 40 + "x" * 2_000_000, None), (21, "OF THEÉ of\x0cthe;" * 50, None), (21, "OF THEÉ of\x0cthe;" * 50, "und")]
    assert got(phrases.collocations(docs(spark, [(r[0], r[1], r[2], "s") for r in many]))) == brute(many, 30)
    assert got(phrases.collocations(docs(spark, []))) == []


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    want = sorted(con.execute(f"SELECT {', '.join(NAMES)} FROM ({plans.oracles()['op11_phrase_collocations']})").fetchall())
    assert got(plans.op11(spark, folder)) == want and len(want) > 200
