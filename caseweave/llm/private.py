"""Personal data: exact patterns, and a semi-Markov conditional random field around them.

The patterns give the base spans, leftmost and not overlapping within a kind. The random
field reads the surroundings of digits, at-signs and spelled-out signs as tokens and scores
whole candidate segments of bounded length: their shape, their separators, check sums and
borders. Dynamic programming over segments chooses boundaries and kinds jointly. It is
trained here, on the base spans of a bounded sample of windows and on the same spans written
in other ways (spelled-out signs, other separators, no plus), which is what it adds: spans
that do not meet a base span.
"""

from __future__ import annotations

import hashlib
import re
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone"]
MAX_TOKENS, LONGEST, REACH = 22, 120, 48
#: Expected number of training documents at most, and of windows among them.
MAX_DOCS, MAX_WINDOWS, ROUNDS, RATE, RIDGE = 4_000, 240, 12, 0.5, 1e-3
#: Log odds by which a segment must beat leaving its tokens alone.
MARGIN = 1.0

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
HOT = re.compile(r"[0-9@]|[(\[](?:at|dot)[)\]]|[a-z0-9._%+-] at [a-z0-9-]+(?:\.| dot )[a-z0-9]", re.I)
TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        host = DOMAIN.match(text, at + 1) if start < at else None
        if host:
            out.append((start, host.end()))
        floor = host.end() if host else at + 1
        at = text.find("@", floor)
    return out


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """The spans of each kind, in the order of ``KINDS``; failing matches are dropped."""
    if not text:
        return [[], [], [], []]
    found: list[list[tuple[int, int]]] = [emails(text), [], [], []]
    if not DIGIT.search(text):
        return found
    for m in DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                found[1].append((at, at + size))
            at += size + 1
    for m in CARD.finditer(text):
        digits = "".join(DIGIT.findall(m[0]))
        if 13 <= len(digits) <= 19 and luhn(digits):
            found[2].append(m.span())
    for m in PHONE.finditer(text):
        if 9 <= len(DIGIT.findall(m[0])) <= 15:
            found[3].append(m.span())
    return found


def windows(text: str) -> list[tuple[int, int]]:
    """Stretches around digits and signs, cut at white space."""
    out: list[list[int]] = []
    for m in HOT.finditer(text):
        low, high = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and low <= out[-1][1] and high - out[-1][0] <= 40 * REACH:
            out[-1][1] = high
        else:
            out.append([max(low, out[-1][1]) if out else low, high])
    return [(a, b) for a, b in out]


FEATURES = [
    "one", "digits_0", "digits_1_8", "digits_9_12", "digits_13_19", "digits_20", "at", "spelled_at", "dotted_four", "four_bytes", "phone_groups", "card_groups", "luhn",
    "plus", "bracket", "letters", "host_end", "long", "spaces", "inner_space_letters", "open_left", "open_right", "mixed_token", "separators_even", "digit_tokens_only",
]
SEPARATOR = re.compile(r"[\s().\[\]/-]+")


def features(text: str, start: int, end: int, count: int) -> list[float]:
    """Whole-span features of a candidate segment."""
    s = text[start:end]
    digits = "".join(DIGIT.findall(s))
    n = len(digits)
    letters = sum(c.isalpha() for c in s)
    plain = re.sub(r"\s*[(\[]?\b(?:at|@)\b[)\]]?\s*|\s*@\s*", "@", s, flags=re.I)
    plain = re.sub(r"\s*[(\[](?:dot)[)\]]\s*|\sdot\s", ".", plain, flags=re.I)
    mail = bool(re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", plain))
    dotted = re.split(r"\s?\[?\(?[.,]\)?\]?\s?|\s-\s", s)
    groups = [g for g in SEPARATOR.split(s.lstrip("+")) if g]
    sizes = tuple(map(len, groups))
    only = all(g.isdigit() for g in groups)
    four = len(dotted) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 for p in dotted)
    left = text[start - 1] if start else " "
    right = text[end] if end < len(text) else " "
    seps = {c for c in s if not c.isalnum() and c not in "+()[]"}
    return [
        1.0, float(n == 0), float(1 <= n <= 8), float(9 <= n <= 12), float(13 <= n <= 19), float(n > 19), float(mail and "@" in s), float(mail and "@" not in s), float(four),
        float(four and all(int(p) <= 255 for p in dotted)), float(only and sizes[-2:] == (3, 4) and len(sizes) in (2, 3, 4)), float(only and (sizes in ((4, 4, 4, 4), (4, 6, 5)) or sizes == (16,))),
        float(13 <= n <= 19 and only and luhn(digits)), float(s[0] == "+"), float("(" in s and ")" in s), float(letters > 0), float(mail and bool(re.search(r"\.[A-Za-z]{2,6}$", plain))),
        float(count > 12), s.count(" ") / 4.0, float(" " in s and letters > 0), float(left.isalnum()), float(right.isalnum()), float(bool(re.search(r"[A-Za-z][0-9]|[0-9][A-Za-z]", s))),
        float(len(seps) <= 1), float(only),
    ]


def _digits(word: str) -> int:
    return len(DIGIT.findall(word))


class Lattice:
    """Tokens of one window, its candidate segments by last token, and their features."""

    def __init__(self, text: str):
        self.spans = [m.span() for m in TOKEN.finditer(text)]
        words = [text[a:b] for a, b in self.spans]
        digits, points, signs = ([0, *accumulate(own)] for own in (map(_digits, words), (w == "." for w in words), (w == "@" or w.lower() == "at" for w in words)))
        keys, rows = [], []
        for i, (start, _) in enumerate(self.spans):
            if not (text[start].isalnum() or text[start] in "+("):
                continue
            for j in range(i, min(i + MAX_TOKENS, len(self.spans))):
                end = self.spans[j][1]
                gap = text[self.spans[j - 1][1] : self.spans[j][0]] if j > i else ""
                n, sign = digits[j + 1] - digits[i], signs[j + 1] - signs[i]
                if len(gap) > 1 or gap == "\n" or end - start > LONGEST or (n > 19 and not sign):
                    break
                # no kind has other numbers of digits
                if text[end - 1].isalnum() and (sign or n >= 7 or (n >= 4 and points[j + 1] - points[i] >= 3)):
                    keys.append((i, j))
                    rows.append(features(text, start, end, j - i + 1))
        self.keys = keys
        self.x = np.array(rows).reshape(-1, len(FEATURES))
        self.ending: list[list[int]] = [[] for _ in self.spans]
        for k, (_, j) in enumerate(keys):
            self.ending[j].append(k)

    def best(self, weights: np.ndarray, margin: float = 0.0) -> list[tuple[int, int, int]]:
        """(first token, last token, kind) of the best segmentation."""
        score = self.x @ weights - margin
        kind = score.argmax(axis=1) if len(score) else np.zeros(0, int)
        top = [0.0]
        back: list[int | None] = []
        for ending in self.ending:
            value, choice = top[-1], None
            for k in ending:
                v = top[self.keys[k][0]] + score[k, kind[k]]
                if v > value:
                    value, choice = v, k
            top.append(value)
            back.append(choice)
        out, j = [], len(self.spans) - 1
        while j >= 0:
            k = back[j]
            if k is None:
                j -= 1
            else:
                out.append((*self.keys[k], int(kind[k])))
                j = self.keys[k][0] - 1
        return out[::-1]

    def gradient(self, weights: np.ndarray, gold: dict[tuple[int, int], int]) -> np.ndarray:
        """Observed minus expected features, by forward and backward sums over segments."""
        score = self.x @ weights
        n = len(self.spans)
        any_kind = np.logaddexp.reduce(score, axis=1)
        forward, backward = np.zeros(n + 1), np.zeros(n + 1)
        starting: list[list[int]] = [[] for _ in range(n)]
        for k, (i, _) in enumerate(self.keys):
            starting[i].append(k)
        for j in range(n):
            forward[j + 1] = np.logaddexp.reduce([forward[j], *(forward[self.keys[k][0]] + any_kind[k] for k in self.ending[j])])
        for i in range(n - 1, -1, -1):
            backward[i] = np.logaddexp.reduce([backward[i + 1], *(backward[self.keys[k][1] + 1] + any_kind[k] for k in starting[i])])
        firsts = np.array([i for i, _ in self.keys])
        lasts = np.array([j + 1 for _, j in self.keys])
        expected = np.exp(forward[firsts] + backward[lasts] - forward[n])[:, None] * np.exp(score)
        observed = np.zeros_like(expected)
        for k, key in enumerate(self.keys):
            if key in gold:
                observed[k, gold[key]] = 1.0
        return self.x.T @ (observed - expected)


def rewritten(span: str, kind: int, turn: int) -> str:
    """The same datum in another notation."""
    if kind == 0:
        return span.replace("@", (" at ", " (at) ", "[at]", " @ ")[turn % 4]).replace(".", (".", " (dot) ", ".", "[dot]")[turn % 4])
    if kind == 1:
        return span.replace(".", ("[.]", " . ", "(.)")[turn % 3])
    digits = "".join(DIGIT.findall(span))
    if kind == 2:
        return (".", "/", " - ")[turn % 3].join(digits[i : i + 4] for i in range(0, len(digits), 4))
    tail = digits[-10:]
    return (f"({tail[:3]}) {tail[3:6]}-{tail[6:]}", f"{tail[:3]}-{tail[3:6]}-{tail[6:]}", f"{tail[:3]}.{tail[3:6]}.{tail[6:]}")[turn % 3]


def train(texts: list[str]) -> np.ndarray:
    """Feature weights by kind, from windows and their rewritten forms."""
    cases = []
    for turn, text in enumerate(texts):
        base = sorted((a, b, k) for k, own in enumerate(base_spans(text)) for a, b in own)
        clean = [s for i, s in enumerate(base) if i == 0 or s[0] >= base[i - 1][1]]
        cases.append((text, clean))
        # every window in each notation, so that none is learned from a few examples only
        for form in range(4 if clean else 0):
            out, at, moved = "", 0, []
            for a, b, k in clean:
                out += text[at:a]
                new = rewritten(text[a:b], k, turn + form)
                moved.append((len(out), len(out) + len(new), k))
                out, at = out + new, b
            cases.append((out + text[at:], moved))
    lattices = []
    for text, spans in cases:
        own = Lattice(text)
        first = {s: i for i, (s, _) in enumerate(own.spans)}
        last = {e: i for i, (_, e) in enumerate(own.spans)}
        gold = {(first[a], last[b]): k for a, b, k in spans if a in first and b in last}
        known = set(own.keys)
        if own.keys and all(g in known for g in gold):
            lattices.append((own, gold))
    weights = np.zeros((len(FEATURES), len(KINDS)))
    weights[0] = -2.0
    squares = np.full_like(weights, 1e-6)
    for _ in range(ROUNDS):
        for own, gold in lattices:
            step = own.gradient(weights, gold) - RIDGE * weights
            squares += step**2
            weights += RATE * step / np.sqrt(squares)
    return weights


def added_spans(text: str, base: list[list[tuple[int, int]]], weights: np.ndarray) -> list[list[tuple[int, int]]]:
    """Spans of the random field that meet no base span."""
    taken = sorted(s for own in base for s in own)
    out: list[list[tuple[int, int]]] = [[], [], [], []]
    for low, high in windows(text):
        inside = [s for s in taken if s[0] < high and s[1] > low]
        piece = text[low:high]
        if inside:
            # what the patterns hold is hidden, and so need not be read again
            for a, b in inside:
                a, b = max(a, low) - low, min(b, high) - low
                piece = piece[:a] + "\n" * (b - a) + piece[b:]
            if not HOT.search(piece):
                continue
        own = Lattice(piece)
        for i, j, kind in own.best(weights, MARGIN) if own.keys else []:
            out[kind].append((low + own.spans[i][0], low + own.spans[j][1]))
    return out


def sample_windows(docs: DataFrame, max_docs: int = MAX_DOCS, max_windows: int = MAX_WINDOWS) -> list[str]:
    """Windows of a hash-chosen sample of documents."""
    share = min(1.0, max_docs / max(1, docs.count()))

    def run(batches):
        for batch in batches:
            found = [t[a:b] for t in batch.column("text").to_pylist() if t for a, b in windows(t) if b - a <= 6 * REACH]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["window"])

    rows = docs.select("doc_id", "text").where(F.xxhash64("doc_id", "text") / F.lit(2.0**64) + 0.5 <= share)
    found = rows.select("text").mapInArrow(run, "window string").distinct().orderBy(F.xxhash64("window"), "window").limit(max_windows)
    return [r["window"] for r in found.collect()]


def personal_data(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added), one row per input row.

    The counts and the digest are those of the base spans; ``spans`` lists base and added ones
    as kind:start:end (code points, end exclusive), by kind and then start. Null and empty texts
    have no spans (digest of the empty string). Repeated rows are read alike. Without training
    windows nothing is added. An empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if weights is None:
        weights = train(sample_windows(rows))

    def joined(spans):
        return ",".join(f"{kind}:{a}:{b}" for kind, own in zip(KINDS, spans) for a, b in sorted(own))

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                base = base_spans(text)
                more = added_spans(text, base, weights)
                both = [a + b for a, b in zip(base, more)]
                out.append((doc_id, *map(len, base), hashlib.sha256(joined(base).encode()).hexdigest(), joined(both), sum(map(len, more))))
            cols = list(zip(*out)) if out else [[]] * 8
            kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.int64()]
            names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names)

    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
