import random
import tracemalloc

import numpy as np

from caseweave.llm import leaks
from caseweave.llm.common import table
from tests.llm.helpers import awkward, docs, prose

ITEMS = "item_id long, text string, doc_id string, cosine double"


def benchmark(spark, rows):
    return spark.createDataFrame([(*r, "x", None) for r in rows], ITEMS)


def test_common_words_is_the_longest_common_subsequence():
    rng = np.random.default_rng(3)
    for _ in range(100):
        a, b = (rng.integers(0, 6, rng.integers(1, 70)).astype(np.uint64) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        assert leaks.common_words(a, b) == row[-1]


def test_finds_verbatim_shouted_and_paraphrased_items(spark):
    items = [(i, prose(100 + i, 20 + 4 * i, 2000)) for i in range(12)]
    rng = random.Random(4)
    rows, want = [], set()
    for i, text in items:
        around = [prose(1000 + i, 150, 2000), prose(2000 + i, 90, 2000)]
        rows.append((i, f"{around[0]} {text} {around[1]}"))
        rows.append((100 + i, f"{around[1]} {text.upper()}!"))
        words = text.split()
        for k in rng.sample(range(len(words) - 8), len(words) // 5):
            words[k] = "other"
        rows.append((200 + i, f"{around[0]} {' '.join(words)} {around[1]}"))
        want |= {(i, i), (100 + i, i), (200 + i, i)}
    rows += [(500 + i, prose(5000 + i, 300, 2000)) for i in range(60)]
    got = {(r["doc_id"], r["item_id"]) for r in leaks.leaked(docs(spark, rows).repartition(4), benchmark(spark, items)).collect()}
    assert got == want


def test_long_items_and_blocks(spark):
    items = [(i, prose(100 + i, 300, 3000)) for i in range(6)]
    rows = [(i, prose(50 + i, 200, 3000) + " " + " ".join(text.split()[60:200]) + " " + prose(80 + i, 40, 3000)) for i, text in items] + [(99, prose(7, 500, 3000))]
    got = {(r["doc_id"], r["item_id"]) for r in leaks.leaked(docs(spark, rows), benchmark(spark, items), block_items=2).collect()}
    assert got == {(i, i) for i in range(6)}


def test_documents_against_verbatim_search(spark):
    folder = "/root/testdata/sf0.001"
    given, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    want = {(d["doc_id"], i["item_id"]) for d in given.collect() for i in items.collect() if i["text"].lower() in d["text"].lower()}
    got = {(r["doc_id"], r["item_id"]) for r in leaks.leaked(given, items).collect()}
    assert want and want <= got and len(got - want) <= len(want) // 10
    left = leaks.drop_leaked(given, items)
    assert left.columns == given.columns and left.count() == given.count() - len({d for d, _ in got})


def test_awkward_rows(spark):
    passage = prose(3, 40)
    items = benchmark(spark, [(1, passage), (1, passage), (2, None), (3, ""), (4, "too short"), (None, prose(2, 60))])
    given = docs(spark, awkward())
    got = leaks.leaked(given, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(None, 1), (4, None), (5, None), (11, None)}
    left = leaks.drop_leaked(given, items)
    assert left.columns == given.columns and {r["doc_id"] for r in left.collect()} == {1, 2, 3, 7, 8, 9, 10}
    assert leaks.leaked(docs(spark, []), items).count() == 0
    assert leaks.leaked(given, benchmark(spark, [])).count() == 0


def test_short_items_amid_foreign_words_at_every_corpus_size(spark, monkeypatch):
    items = [(i, " ".join(prose(100 + i, 15, 400).split())) for i in range(8)]
    rows = []
    for i, text in items:
        foreign = [f"foreign{i}x{k}" for k in range(60)]
        rows.append((i, " ".join([*foreign[:30], text, *foreign[30:]])))
    rows += [(500 + i, prose(5000 + i, 300, 400)) for i in range(30)]
    given, counts = docs(spark, rows), leaks._counts
    for factor in (1, 100, 100_000):
        monkeypatch.setattr(leaks, "_counts", lambda d, v, f=factor: tuple(x * f for x in counts(d, v)))
        got = {(r["doc_id"], r["item_id"]) for r in leaks.leaked(given, benchmark(spark, items)).collect()}
        assert {(i, i) for i, _ in items} <= got


def test_long_quotations_at_every_offset(spark):
    """24 to 127 consecutive words of an item of 128 leak, wherever they begin."""
    item = prose(41, 128, 100_000).split()
    rows, at = [], 0
    for n in (24, 25, 31, 47, 59, 64, 88, 100, 127):
        for offset in range(0, 128 - n + 1):
            rows.append((at, f"{prose(10_000 + at, 30, 50_000)} {' '.join(item[offset : offset + n])} {prose(20_000 + at, 30, 50_000)}"))
            at += 1
    clean = [(100_000 + i, f"{prose(30_000 + i, 60, 50_000)} {' '.join(item[i : i + 10])} {prose(40_000 + i, 60, 50_000)}") for i in range(40)]
    got = {(r["doc_id"], r["item_id"]) for r in leaks.leaked(docs(spark, rows + clean).repartition(4), benchmark(spark, [(1, " ".join(item))])).collect()}
    assert got == {(r[0], 1) for r in rows}


def test_short_items_as_they_stand(spark):
    items = [(1, "yes"), (2, "a b c d"), (3, "one two three four five"), (4, "u v w x y z q"), (5, "eight words are what it takes to search")]
    rows = [(1, "Yes!"), (2, "yes and no"), (3, "a, b; C d"), (4, "a b c d e"), (5, "then One two three, four five six"), (6, "one two three four"), (7, "p u v w x y z q"), (8, "u v w x y z"), (9, prose(1, 50) + " eight words are what it takes to search " + prose(2, 50))]
    got = {(r["doc_id"], r["item_id"]) for r in leaks.leaked(docs(spark, rows), benchmark(spark, items)).collect()}
    assert got == {(1, 1), (3, 2), (5, 3), (7, 4), (9, 5)}


def paraphrase(text, rng, vocabulary):
    """Some words replaced, dropped or put in, the answer kept."""
    words, out = text.split(), []
    for k, w in enumerate(words):
        x = rng.random() if k < len(words) - 8 else 1.0
        out += [] if x < 0.07 else [f"w{rng.randrange(vocabulary)}x"] if x < 0.22 else [w, f"w{rng.randrange(vocabulary)}x"] if x < 0.27 else [w]
    return " ".join(out)


def test_recall_of_paraphrases_against_judging_everything(spark):
    """What the rule accepts when it is asked about every part and every place, against what the search finds."""
    rng, items = random.Random(9), [(i, prose(300 + i, rng_words, 3000)) for i, rng_words in enumerate([15, 20, 24, 30, 38, 45, 52, 60, 70, 100] * 4)]
    rows = [(i, f"{prose(7000 + i, 80, 3000)} {paraphrase(items[i % 40][1], rng, 3000)} {prose(8000 + i, 80, 3000)}") for i in range(200)]
    rows += [(1000 + i, prose(9000 + i, 200, 3000)) for i in range(100)]
    hashed = {i: leaks._parts([(i, t)])[0] for i, t in items}
    want = set()
    for d, text in rows:
        words = leaks.word_hashes(leaks.pa.array([text]))[0]
        held = set(words.tolist())
        for i, parts in hashed.items():
            for _, part in parts:
                if len(held & set(part.tolist())) >= 0.6 * len(set(part.tolist())):
                    span = len(part) + len(part) // 2
                    if any(leaks.judge(part, words[a : a + span])[2] for a in range(0, max(1, len(words) - span + 8), 8)):
                        want.add((d, i))
    got = {(r["doc_id"], r["item_id"]) for r in leaks.leaked(docs(spark, rows).repartition(4), benchmark(spark, items)).collect()}
    assert len(want) > 150 and len(got & want) >= 0.95 * len(want)
    assert all(d < 1000 and d % 40 == i for d, i in got)


def test_few_passages_are_looked_at(spark):
    """The index on rare words thins passages by itself: on real documents one in a hundred meets a query at all."""
    folder = "/root/testdata/sf0.01"
    given, items = table(spark, folder, "documents"), [(r["item_id"], r["text"]) for r in table(spark, folder, "benchmark").collect()]
    parts = leaks._parts(items)[0]
    vocabulary = leaks.Vocabulary(np.unique(np.concatenate([w for _, w in parts])))
    _, counted = leaks._counts(given, vocabulary)
    _, part, start, end, rare = leaks._queries(parts, vocabulary, counted)
    order = np.argsort(rare[:, 0], kind="stable")
    queries = leaks.Queries(part, None, None, np.searchsorted(rare[order, 0], np.arange(len(counted) + 1)), rare[order, 1])
    words, first = leaks.word_hashes(leaks.pa.array([r["text"] or "" for r in given.collect()], leaks.pa.large_string()))
    terms = vocabulary.terms(words)
    query, begin, _ = queries.candidates(terms, first)
    total = len(leaks.passages(first)[0])
    assert len(np.unique(begin)) < 0.05 * total, (len(np.unique(begin)), len(query), total)


def test_latent_space_is_fitted_on_every_passage(spark, monkeypatch):
    """Products over all passages of a corpus, by pairs of terms and passage by passage, equal the matrix product."""
    texts = [prose(60_000 + i, 50 + i % 90, 60) for i in range(120)]
    held = leaks.word_hashes(leaks.pa.array([prose(1, 200, 60)]))[0]
    vocabulary = leaks.Vocabulary(np.unique(held)[:40])
    given = docs(spark, list(enumerate(texts))).repartition(3)
    rows = leaks._terms(given, vocabulary)
    total, counted = leaks._counts(given, vocabulary)
    idf = np.log((total + 1.0) / (counted + 1.0)) + 0.1
    factor = np.random.Generator(np.random.PCG64(3)).standard_normal((len(idf), 12))
    want, passages = np.zeros(factor.shape), 0
    for text in texts:
        terms = vocabulary.terms(leaks.word_hashes(leaks.pa.array([text]))[0])
        for at in range(0, len(terms), leaks.WIDTH):
            own = terms[at : at + leaks.WIDTH]
            own, passages = own[own >= 0], passages + 1
            if len(own) >= leaks.HITS:
                a = np.bincount(own, minlength=len(idf)) * idf
                want += np.outer(a, a @ factor) / (idf[own] ** 2).sum()
    assert passages == total
    assert np.allclose(leaks._products(rows, factor, idf), want, rtol=1e-3, atol=1e-3)
    monkeypatch.setattr(leaks, "GRAM", 1)
    monkeypatch.setattr(leaks, "PASSAGES", 7)
    assert np.allclose(leaks._products(rows, factor, idf), want, rtol=1e-3, atol=1e-3)


def test_pairs_of_terms_need_no_second_table():
    size, rng = 1_500, np.random.default_rng(5)
    n = rng.integers(3, 20, 400)
    t = np.concatenate([rng.choice(size, k, replace=False) for k in n])
    weights, out = rng.random(size) + 0.1, np.zeros((size, size), dtype=np.float32)
    tracemalloc.start()
    leaks._shared(t, n, weights, out)
    leaks._shared(t, n, weights, out)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < size * size * 8 // 2
    owner, want = np.repeat(np.arange(len(n)), n), np.zeros((len(n), size))
    want[owner, t] = 1 / np.sqrt(np.add.reduceat(weights[t] ** 2, np.cumsum(n) - n))[owner]
    assert np.allclose(out + out.T, 2 * want.T @ want, rtol=1e-4, atol=1e-5)


def test_far_regions_are_not_judged_and_none_that_leaks_is_lost():
    rng, leaking = np.random.default_rng(5), 0
    for _ in range(400):
        part, region = (rng.integers(0, 120, n).astype(np.uint64) for n in (64, int(rng.integers(64, 200))))
        kept = int(rng.integers(0, 64))
        region[:kept] = part[:kept]
        leaked = leaks.judge(part, region)[2]
        leaking += leaked
        assert leaks.within_reach(part, region) or not leaked
    assert leaking > 50
    assert not leaks.within_reach(part, np.concatenate([part[:20], np.arange(1000, 1200, dtype=np.uint64)]))


def test_a_passage_is_placed_once_for_all_its_queries(monkeypatch):
    placed, latent = [], leaks._latent
    monkeypatch.setattr(leaks, "_latent", lambda t, s, e, b: placed.append(len(s)) or latent(t, s, e, b))
    rng = np.random.default_rng(6)
    space, vectors = (rng.standard_normal((n, 8)).astype(np.float32) for n in (50, 30))
    terms, query = rng.integers(-1, 50, 400).astype(np.int32), np.repeat(np.arange(30), 40)
    start = np.tile(np.arange(40) * 8, 30)
    queries = leaks.Queries(np.arange(30), np.zeros(30), vectors, np.zeros(51, dtype=np.int64), np.zeros(0, dtype=np.int32))
    got = queries.cosines(terms, query, start, start + 24, space)
    assert sum(placed) == 40
    assert np.allclose(got, np.einsum("ij,ij->i", latent(terms, start, start + 24, space), vectors[query]))
