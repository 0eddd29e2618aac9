import hashlib
import random
from collections import Counter

import numpy as np
from hypothesis import given as cases
from hypothesis import settings
from hypothesis import strategies as st

from caseweave.llm import align, plans
from caseweave.llm.common import table
from tests.llm.helpers import awkward, docs

TEXTS = [
    "<|endoftext|> is plain text", "naïve café — 你好 \U0001f600\U0001f468‍\U0001f469", "a  b\t\tc\n\n\nd ", " leading", "x\x00y", "ﬁ ½ Ⅷ", "1234567890 12,345.67", "aaaaaaaaaaaaaaaaaaaaaaaaa",
    "▁ marks ▁▁", "<s> </s> <unk> <0x41>", "é ﻿   　", "ÄÖÜ ẞ", "\r\n\x0b\x0c", "\u0000", "don't WON'T I'll",
]


def tokens():
    """Ids and bytes by the tokenizer files themselves."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(c): c for c in visible}
    letters.update({chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in visible)})

    def a(text):
        ids = whole.encode(" " + text, add_special_tokens=False).ids
        return ids, [bytes(letters[c] for c in whole.id_to_token(i)) for i in ids]

    def b(text):
        ids = model.encode(text)
        return ids, [bytes([int(p[3:-1], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in map(model.id_to_piece, ids)]

    return a, b


def brute(rows):
    """Groups, links and counts, token by token."""
    a, b = tokens()
    found, held = [], Counter()
    for doc_id, text, *_ in rows:
        groups = []
        if text:
            (ia, sa), (ib, sb) = a(text), b(text)
            if b"".join(sa) == b"".join(sb) == b" " + text.encode():
                ends_b, at, x, y = {}, 0, 0, 0
                for k, s in enumerate(sb):
                    at += len(s)
                    ends_b[at] = k + 1
                at = 0
                for k, s in enumerate(sa):
                    at += len(s)
                    if at in ends_b:
                        groups.append((ia[x : k + 1], ib[y : ends_b[at]]))
                        x, y = k + 1, ends_b[at]
        found.append((doc_id, groups))
        held.update({(p, q) for ga, gb in groups for p in ga for q in gb})
    top = {}
    for (p, _), n in held.items():
        top[p] = max(top.get(p, 0), n)
    out = []
    for doc_id, groups in found:
        links = [(p, q) for ga, gb in groups for p in ga for q in gb]
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((
            doc_id, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(held[v] == top[v[0]] for v in links), sum(held[v] for v in links),
            hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return out


@settings(max_examples=300, deadline=None)
@cases(st.lists(st.integers(1, 5), max_size=60), st.lists(st.integers(1, 5), max_size=60), st.integers(1, 9))
def test_pieces_of_any_size_find_all_common_ends(x, y, work):
    a, b = np.cumsum(np.array(x, dtype=np.int64)), np.cumsum(np.array(y, dtype=np.int64))
    i, j = align.diagonals(a, b, work)
    assert (np.diff(i + j)[:-1] == work).all() and i[-1] == len(a) and j[-1] == len(b)
    own_a, own_b = align.group_ends(a, b, work)
    both, want_a, want_b = np.intersect1d(a, b, return_indices=True)
    assert own_a.tolist() == want_a.tolist() and own_b.tolist() == want_b.tolist()


def test_against_token_by_token(spark):
    rng = random.Random(5)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + awkward() + [(100 + i, " ".join(rng.choices(TEXTS + ["the end of the text", "ende", "ungewöhnlich"], k=rng.randrange(1, 30)))) for i in range(60)]
    rows.append((500, "looong" * 100_000 + " and words " * 50_000))
    want = sorted(brute(rows), key=repr)
    for chunk, work in ((6_000_000, 1 << 16), (500, 7)):
        got = align.link_scores(docs(spark, rows).repartition(3), chunk_bytes=chunk, work=work)
        assert sorted(map(tuple, got.collect()), key=repr) == want
    assert sum(r[3] == 0 for r in want) < len(want) // 2


def test_alignment_itself_and_empty_tables(spark):
    got = align.align(docs(spark, [(1, "the cat"), (2, None)])).collect()
    a, b = tokens()
    assert got[0]["groups"].replace(";", ",").split(",")[0].split("|")[0] == str(a("the cat")[0][0]) and got[0]["n_a"] == len(a("the cat")[0])
    assert tuple(got[1])[1:] == (0, 0, "")
    assert align.link_scores(docs(spark, [])).count() == 0
    assert [tuple(r) for r in align.link_scores(docs(spark, [(1, None), (1, "")])).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")] * 2


def test_query_on_real_documents(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in table(spark, folder, "documents").select("doc_id", "text").collect()]
    assert sorted(map(tuple, plans.op12(spark, folder).collect())) == sorted(brute(rows))
