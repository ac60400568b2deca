"""Personal data: exact base patterns, and a semi-Markov conditional random field that adds spans.

Base spans follow fixed patterns and checks.  The semi-Markov CRF looks at *islands*: stretches of
text around digits and at signs, the only places where it may mark anything.  Candidate segments of up
to MAX_TOKENS tokens are scored as wholes (digit count, checksum, brackets, prefix, neighbours, ...) and
a Viterbi pass over the island chooses boundaries and types together.  Work per island is its number of
tokens times MAX_TOKENS, so it is linear in the text.

The weights are fitted by penalised likelihood with exact forward-backward sums, on examples that
`examples()` writes from a fixed seed: no row of any table is read, so the model is the same for any input.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, modest_batches

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 16
#: A segment that the model adds must beat leaving its tokens alone by this much log-odds.
MARGIN = 1.0

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from their at signs: linear even in long runs of letters."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Each four parts in turn of every chain of dotted numbers; those with a part over 255 are dropped."""
    for m in _CHAIN.finditer(text):
        if m[0].count(".") < 3:
            continue
        parts = [(p.start(), p.end()) for p in re.finditer("[0-9]+", m[0])]
        for k in range(0, len(parts) - 3, 4):
            four = [m[0][a:b].lstrip("0") for a, b in parts[k : k + 4]]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in four):
                yield m.start() + parts[k][0], m.start() + parts[k + 3][1]


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if 14 <= len(d := _only_digits(m[0])) <= 19 and luhn(d):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_only_digits(m[0])) <= 15:
                yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index in KINDS, end), sorted; offsets in code points."""
    return sorted((a, k, b) for k, find in enumerate((emails, ips, cards, phones)) for a, b in find(text))


# ---- the semi-Markov CRF ----

_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[^A-Za-z0-9]", re.S)
#: What an island has somewhere, and how it goes on from its start: blanks join pieces of numbers only.
_SEED = re.compile(r"[0-9@]|[\[(](?:at|AT)[\])]")
_ISLAND = re.compile(r"[^\s,;]*+(?:[ ](?=[0-9(+.\[-])[^\s,;]++)*+")


def islands(text: str) -> Iterator[tuple[int, str]]:
    """(start, text) of the stretches around digits and at signs; every character is visited a few times at most."""
    done = 0
    while m := _SEED.search(text, done):
        start = m.start()
        while start > done and text[start - 1] not in " \t\r\n,;":
            start -= 1
        island = _ISLAND.match(text, start)[0]
        done = start + max(1, len(island))
        yield start, island


FEATURES = (
    "bias", "one_token", "digits_0", "digits_1_6", "digits_7_9", "digits_10", "digits_11_15", "digits_14_19", "digits_20", "luhn", "plus_first",
    "bracketed_area", "at_sign", "at_word", "dots_3", "ip_parts", "host_end", "has_letter", "starts_digit", "ends_digit", "odd_char",
    "groups_3_3_4", "groups_4", "left_word", "right_word", "left_money", "whole_island", "date_like", "separators", "edge_space",
)
_WEIGHTS = dict(l2=0.5, rate=0.5, rounds=70)


def features(tokens: list[str], i: int, j: int) -> np.ndarray:
    """Whole-span features of tokens[i:j] with their neighbours."""
    seg = tokens[i:j]
    s = "".join(seg)
    left, right = tokens[i - 1] if i else " ", tokens[j] if j < len(tokens) else " "
    digits = _only_digits(s)
    n = len(digits)
    groups = [len(t) for t in seg if t[0].isdigit()]
    letters = any(t[0].isalpha() and t[0].isascii() for t in seg)
    parts = s.split(".")
    on = (
        True, j - i == 1, n == 0, 1 <= n <= 6, 7 <= n <= 9, n == 10, 11 <= n <= 15, 14 <= n <= 19, n >= 20, n >= 14 and luhn(digits), s[0] == "+",
        re.match(r"\(?[0-9]{3}\)", s) is not None, s.count("@") == 1, re.search(r"[\[(](?:at|AT)[\])]", s) is not None, s.count(".") == 3,
        len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts), re.search(r"\.[A-Za-z]{2,10}$", s) is not None, letters,
        s[0].isdigit(), s[-1].isdigit(), any(not (t[0].isalnum() or t in "+-.()@ _%[]") for t in seg), groups in ([3, 3, 4], [1, 3, 3, 4]),
        len(groups) == 4 and set(groups) == {4}, left[0].isalnum() or left in "@_-", right[0].isalnum() or right in "@_", left in "$€£#", i == 0 and j == len(tokens),
        re.fullmatch(r"[0-9]{1,4}[-./][0-9]{1,2}[-./][0-9]{1,4}", s) is not None, sum(t in " -." for t in seg) >= 2, s[0] == " " or s[-1] == " ",
    )
    return np.asarray(on, np.float64)


def segments(tokens: list[str]) -> list[tuple[int, int]]:
    """Candidates by end: no blank at either end, and one at sign (or word) or as many digits as some kind can have."""
    return [(i, j) for j, starts in enumerate(starts_by_end(tokens), 1) for i in starts]


def starts_by_end(tokens: list[str]) -> Iterator[list[int]]:
    """Where the candidates that end after each token start, one list at a time: islands can be as long as their text."""
    digits, ats = [0], [0]
    for k, t in enumerate(tokens):
        digits.append(digits[-1] + (len(t) if t[0] in "0123456789" else 0))
        ats.append(ats[-1] + (t == "@" or t in ("at", "AT") and k > 0 and tokens[k - 1] in "[("))
    for j in range(1, len(tokens) + 1):
        out = []
        for i in range(max(0, j - MAX_TOKENS), j) if tokens[j - 1] != " " else ():
            n = ats[j] - ats[i]
            if tokens[i] != " " and (n == 1 and j - i >= 5 or n == 0 and 4 <= digits[j] - digits[i] <= 19):
                out.append(i)
        yield out


def examples(n: int = 500, seed: int = 5) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Islands with their true spans (start, kind, end), written from a seed."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 8)))

    def card() -> str:
        d = r.choice("3456") + num(r.choice((13, 14, 14, 14)))
        d += next(c for c in "0123456789" if luhn(d + c))
        cut = r.choice(("", "", " ", "-"))
        return cut.join(d[k : k + 4] for k in range(0, len(d), 4))

    def positive(kind: int) -> str:
        host = word() + r.choice((".com", ".example.org", ".net", ".de"))
        if kind == 0:
            who = r.choice((word(), word() + "." + num(2), word() + num(2)))
            return r.choice((who + "@" + host, who + "@" + host, who + "[at]" + host, who + "(at)" + host))
        if kind == 1:
            return ".".join(str(r.randint(0, 255)) for _ in range(4))
        if kind == 2:
            return card()
        a, b, c = num(3), num(3), num(4)
        return r.choice((f"+1 ({a}) {b}-{c}", f"+{num(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"({a}) {b}-{c}", f"+{num(11)}", f"{a}-{b}-{c}"))

    def negative() -> str:
        return r.choice((
            f"{num(4)}-{num(2)}-{num(2)}", num(r.randint(1, 13)), num(16)[:15] + "x", f"{num(1)}.{num(1)}.", f"v{num(1)}.{num(2)}.{num(1)}", f"{num(1)}.{num(1)}.{num(1)}.{num(4)}", f"${num(3)}.{num(2)}",
            f"@{word()}", f"{word()}{num(2)}", "".join(r.choice("0123456789abcdef") for _ in range(40)), f"{word()}={num(4)}{word()}{num(3)}", f"AK{num(3)}{word().upper()}{num(2)}", num(22), f"({num(3)})", f"{num(3)}-{num(2)}",
            f"{num(3)}-{num(3)}", f"{num(4)} {num(4)}", f"{num(2)}:{num(2)}", f"{num(5)}-{num(4)}", f"x@{word()}", f"+{num(3)}", f"{num(3)}.{num(3)}.{num(3)}", f"#{num(10)}", f"{num(9)}", f"{num(10)}", f"({num(4)})", f"[{num(2)}]"
        ))

    out = []
    for _ in range(n):
        text, spans = "", []
        for part in range(r.choice((1, 1, 1, 2))):
            text += " " if part else ""
            if r.random() < 0.5:
                kind = r.randrange(4)
                s = positive(kind)
                spans.append((len(text), kind, len(text) + len(s)))
                text += s
            else:
                text += negative()
        if r.random() < 0.2:
            text += r.choice((".", ")", ":"))
        out.append((text, spans))
    return out


def _logsum(x: np.ndarray) -> float:
    m = x.max()
    return float(m + np.log(np.exp(x - m).sum()))


@lru_cache(1)
def trained() -> np.ndarray:
    """Weights, features by kinds; gradient ascent on the penalised log-likelihood of examples()."""
    data = []
    for text, spans in examples():
        tokens = _TOKEN.findall(text)
        starts = np.cumsum([0, *map(len, tokens)])
        at = {int(c): k for k, c in enumerate(starts)}
        
        segs = segments(tokens)
        if not segs:
            continue
        where = {s: k for k, s in enumerate(segs)}
        gold = [(where[at[a], at[b]], kind) for a, kind, b in spans if (at.get(a), at.get(b)) in where]
        data.append((len(tokens), segs, np.stack([features(tokens, *s) for s in segs]), gold))
    w = np.zeros((len(FEATURES), len(KINDS)))
    w[0] = -3.0
    step = np.zeros_like(w)
    for _ in range(_WEIGHTS["rounds"]):
        grad = -_WEIGHTS["l2"] * w
        for n, segs, x, gold in data:
            p = _marginals(n, segs, x @ w)
            grad -= x.T @ p
            for k, kind in gold:
                grad[:, kind] += x[k]
        step += grad**2  # AdaGrad: rare features move as fast as frequent ones
        w += _WEIGHTS["rate"] * grad / (np.sqrt(step) + 1e-9)
    return w


def _marginals(n: int, segs: list[tuple[int, int]], score: np.ndarray) -> np.ndarray:
    """Probability of every segment and kind, by the forward-backward sums of the semi-Markov model."""
    total = np.logaddexp.reduce(score, axis=1)
    by_end: list[list[int]] = [[] for _ in range(n + 1)]
    by_start: list[list[int]] = [[] for _ in range(n + 1)]
    for k, (i, j) in enumerate(segs):
        by_end[j].append(k)
        by_start[i].append(k)
    starts, ends = np.array([s[0] for s in segs]), np.array([s[1] for s in segs])
    fwd, bwd = np.zeros(n + 1), np.zeros(n + 1)
    for j in range(1, n + 1):
        ks = by_end[j]
        fwd[j] = _logsum(np.append(fwd[starts[ks]] + total[ks], fwd[j - 1])) if ks else fwd[j - 1]
    for i in range(n - 1, -1, -1):
        ks = by_start[i]
        bwd[i] = _logsum(np.append(bwd[ends[ks]] + total[ks], bwd[i + 1])) if ks else bwd[i + 1]
    return np.exp(score + (fwd[starts] + bwd[ends] - fwd[n])[:, None])


def viterbi(tokens: list[str], w: np.ndarray) -> list[tuple[int, int, int]]:
    """The best set of disjoint segments as (first token, kind, end token)."""
    n = len(tokens)
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    for j, starts in enumerate(starts_by_end(tokens), 1):
        best[j], back[j] = best[j - 1], None
        for i in starts:
            score = features(tokens, i, j) @ w
            kind = int(score.argmax())
            if (v := best[i] + score[kind] - MARGIN) > best[j]:
                best[j], back[j] = v, (i, kind)
    out, j = [], n
    while j > 0:
        if back[j] is None:
            j -= 1
        else:
            i, kind = back[j]
            out.append((i, kind, j))
            j = i
    return out[::-1]


def added(island: str, key: bytes) -> tuple[tuple[int, int, int], ...]:
    """The model's spans of one island, of any length: the pass is linear and is over all of it."""
    tokens = _TOKEN.findall(island)
    starts = np.cumsum([0, *map(len, tokens)])
    w = np.frombuffer(key).reshape(len(FEATURES), len(KINDS))
    return tuple((int(starts[i]), kind, int(starts[j])) for i, kind, j in viterbi(tokens, w))


#: Short islands come again; long ones hardly do, and would fill the memory.
_added = lru_cache(20000)(added)


def find_spans(text: str, key: bytes) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base, all) spans; all holds every base span and those of the model that touch none of them."""
    base = base_spans(text)
    more, taken = [], sorted((a, b) for a, _, b in base)
    k = 0
    for start, island in islands(text):
        if len(island) < 7:
            continue  # shorter than any kind
        for a, kind, b in (_added if len(island) <= 400 else added)(island, key):
            a, b = a + start, b + start
            while k < len(taken) and taken[k][1] <= a:
                k += 1
            near = [t for t in taken[max(0, k - 3) : k + 4] if t[0] < b and a < t[1]]
            if not near:
                more.append((a, kind, b))
    return base, sorted(base + more)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, text, found (kind, start, end in code points, base) of every row of docs.

    Null and empty texts have no spans.  Rows are treated one by one, so repeated rows, null ids and extra
    columns are of no account.
    """
    key = trained().tobytes()

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            base, every = find_spans(text or "", key)
            own = set(base)
            yield doc_id, text, [{"kind": KINDS[s[1]], "start": s[0], "end": s[2], "base": s in own} for s in every]

    return map_rows(docs.select("doc_id", "text"), f"doc_id long, text string, found {SPANS}", run)


def digest_pii(docs: DataFrame) -> DataFrame:
    """find_pii() as counts of base spans, a digest of them and the list of all spans."""
    key = trained().tobytes()

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            base, every = find_spans(text or "", key)
            counts = [0] * len(KINDS)
            for _, k, _ in base:
                counts[k] += 1
            yield doc_id, *counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(every)

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return map_rows(docs.select("doc_id", "text"), f"doc_id long, {counts}, base_sha256 string, spans string", run)


def masked(text: str | None, key: bytes) -> str | None:
    """text with every span replaced by its kind in square brackets; overlapping spans become one."""
    if not text:
        return text
    out, at = [], 0
    for a, kind, b in find_spans(text, key)[1]:
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask_documents(docs: DataFrame) -> DataFrame:
    """docs with personal data masked in text, all columns kept in order; n_chars follows the new text if present.

    Null texts stay null.  No row is added or dropped.
    """
    key = trained().tobytes()
    modest_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def mask(texts):
        return texts.map(lambda t: masked(t, key), na_action="ignore")

    out = docs.withColumn("text", mask("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars").cast("long")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
