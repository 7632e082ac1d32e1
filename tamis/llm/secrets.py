"""Secret scans: fixed patterns, and a battery of randomness tests for other tokens.

A candidate is a run of 20 or more characters of ``[A-Za-z0-9+/_-]`` outside the
patterns' spans, with ``=`` as padding at its end only, so a name and its value are two
runs.  Its encoding is the smallest alphabet that holds it, down to letters of one case and
digits alone.  A run that no alphabet holds, or that is not like a uniform source as a
whole, is split at the symbols outside base64, base64url or base62, whichever leaves the
most convincing pieces.  The battery holds a candidate against two sources.

* A uniform source over its encoding: chi-squared tests of the symbols and of their kinds,
  a runs test about the median symbol and a lag-one serial correlation; a token is like it
  if the smallest of the four p-values, times four, is ``min_random`` or more.
* Written text: words and identifiers, as a chain of kinds (lower case, upper case, digits,
  symbols) with letters as in prose.  The goodness of fit, as likelihood ratio of the
  uniform source (its inverse bounds the p-value, by Markov's inequality); the number of
  runs of one kind, which text has few of; and the serial correlation of vowels, which
  alternate with consonants in text.  The smallest of the three p-values, times three, is
  the token's p-value; a token that is not like the uniform source is never found.

A weighted Benjamini-Hochberg step over a text's candidates, with weights in proportion to
length, holds the rate of false finds at ``q``: raising a p-value keeps it one, so the
tests of the uniform source, which do just that, do not void the rate. Equal values pass
or fail together.

Scale: one narrow pass over the texts.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm._common import arrow_map, table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+(?:={1,6}(?![A-Za-z0-9+/_=-]))?")
#: Runs between the symbols outside base64, base64url and base62.
SPLITS = tuple(re.compile(f"[A-Za-z0-9{x}]{{20,}}+=*") for x in ("+/", "_-", ""))
KINDS = ("assign", "access", "hex", "random")
MASK = "[SECRET]"

MIN_RANDOM = 0.001
Q = 1e-4
#: Alphabets from small to large, symbols in order.
ALPHABETS = (
    ("digits", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("upper hex", "0123456789ABCDEF"),
    ("lower letters", "abcdefghijklmnopqrstuvwxyz"),
    ("upper letters", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("upper base36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("letters", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
#: Per cent of letters a to z in English prose.
LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)
#: Written text: of the kinds lower, upper, digit, symbol, how often each starts a token, and which follows which,
#: in words and camel case, and in upper case throughout.  Rows add up to 1.
STARTS = (0.5, 0.3, 0.15, 0.05)
MIXED = ((0.88, 0.05, 0.03, 0.04), (0.7, 0.24, 0.03, 0.03), (0.1, 0.06, 0.7, 0.14), (0.5, 0.25, 0.2, 0.05))
UPPER = ((0.25, 0.25, 0.25, 0.25), (0.01, 0.91, 0.04, 0.04), (0.01, 0.15, 0.7, 0.14), (0.01, 0.75, 0.19, 0.05))
#: Of two neighbours in text, the most that differ in kind; and the least anticorrelation of vowels at lag one.
KIND_CHANGES = 1 / 3
VOWELS_APART = -0.2


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


_OF = {c: _kind(c) for _, symbols in ALPHABETS for c in symbols}
_SYMBOL = {c: math.log(LETTERS[ord(c.lower()) - 97] / sum(LETTERS)) if k < 2 else math.log(0.1 if k == 2 else 0.25) for c, k in _OF.items()}
_STARTS = tuple(map(math.log, STARTS))
_CHAINS = tuple(tuple(tuple(map(math.log, row)) for row in chain) for chain in (MIXED, UPPER))


def _upper_tail(x: float, df: float) -> float:
    """Of chi-squared, by the cube root's normal approximation."""
    if df < 1:
        return 1.0
    v = 2 / (9 * df)
    return 0.5 * math.erfc(((x / df) ** (1 / 3) - (1 - v)) / math.sqrt(2 * v))


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def encoding(token: str) -> tuple[str, str] | None:
    """Name and symbols of the smallest alphabet that holds the token without its padding."""
    body = set(token.rstrip("="))
    return next(((name, symbols) for name, symbols in ALPHABETS if body <= set(symbols)), None)


def p_uniform(token: str, symbols: str) -> float:
    """How well a uniform source over ``symbols`` explains the token: four tests, Bonferroni."""
    body = token.rstrip("=")
    n, k = len(body), len(symbols)
    at = [symbols.index(c) for c in body]
    counts = [0] * k
    for i in at:
        counts[i] += 1
    expected = n / k
    chi = sum((c - expected) ** 2 for c in counts) / expected
    # with few symbols a cell the variance is 2(k-1)(n-1)/n; the excess is scaled to it
    chi = (k - 1) + (chi - (k - 1)) / math.sqrt((n - 1) / n)
    ps = [_upper_tail(max(chi, 0), k - 1)]
    kinds = [[c for c in symbols if f(c)] for f in (str.isdigit, str.islower, str.isupper, lambda c: not c.isalnum())]
    kinds = [x for x in kinds if x]
    ps.append(_upper_tail(sum((sum(c in x for c in body) - n * len(x) / k) ** 2 / (n * len(x) / k) for x in kinds), len(kinds) - 1))
    above = [i >= k / 2 for i in at]
    n1 = sum(above)
    n2 = n - n1
    if n1 and n2:
        runs, mean = 1 + sum(x != y for x, y in zip(above, above[1:], strict=False)), 1 + 2 * n1 * n2 / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        ps.append(_two_sided((runs - mean) / math.sqrt(var)) if var > 0 else 1.0)
    else:
        ps.append(2.0 ** (1 - n))
    m = sum(at) / n
    var = sum((i - m) ** 2 for i in at)
    ps.append(_two_sided(sum((x - m) * (y - m) for x, y in zip(at, at[1:], strict=False)) / var * math.sqrt(n)) if var else 2.0 ** (1 - n))
    return min(1.0, len(ps) * min(ps))


def fit_to_text(body: str, symbols: str) -> float:
    """A bound of the chance that written text gives a token so much likelier under the uniform source: the inverse of the likelihood ratio."""
    kinds = [_OF[c] for c in body]
    letters = _STARTS[kinds[0]] + sum(_SYMBOL[c] for c in body)
    steps = Counter(zip(kinds, kinds[1:], strict=False))
    mixed, upper = (sum(n * chain[a][b] for (a, b), n in steps.items()) for chain in _CHAINS)
    text = letters + max(mixed, upper) + math.log((1 + math.exp(-abs(mixed - upper))) / 2)
    return math.exp(min(0.0, text + len(body) * math.log(len(symbols))))


def _binomial_tail(at_least: int, n: int, p: float) -> float:
    return min(1.0, sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(at_least, n + 1))) if n < 400 else _upper_normal((at_least - 0.5 - n * p) / math.sqrt(n * p * (1 - p)))


def _upper_normal(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def kind_runs(body: str) -> float:
    """The chance that text changes its kind so often."""
    kinds = [_OF[c] for c in body]
    return _binomial_tail(sum(x != y for x, y in zip(kinds, kinds[1:], strict=False)), len(body) - 1, KIND_CHANGES)


def vowel_correlation(body: str) -> float:
    """The chance that the vowels among the letters of text are so little apart."""
    vowels = [c in "aeiouyAEIOUY" for c in body if _OF[c] < 2]
    n = len(vowels)
    m = sum(vowels) / n if n else 0.0
    if n < 8 or not 0 < m < 1:
        return 1.0
    r = sum((x - m) * (y - m) for x, y in zip(vowels, vowels[1:], strict=False)) / (n * m * (1 - m))
    return _upper_normal((r - VOWELS_APART) * math.sqrt(n))


def p_text(token: str, symbols: str) -> float:
    """How well written text explains the token: three tests, Bonferroni."""
    body = token.rstrip("=")
    return min(1.0, 3 * min(fit_to_text(body, symbols), kind_runs(body), vowel_correlation(body)))


def _test(token: str, start: int) -> tuple[float, float, int, int, str] | None:
    """(p of text, p of the uniform source, start, end, token) of a candidate; None if no alphabet holds it."""
    if len(token.rstrip("=")) < 20 or (of := encoding(token)) is None:
        return None
    return p_text(token, of[1]), p_uniform(token, of[1]), start, start + len(token), token


def candidates(run: str, at: int, min_random: float = MIN_RANDOM) -> list[tuple[float, float, int, int, str]]:
    """The tests of a run that starts at ``at``: of itself, or of the pieces that cover it, without overlaps."""
    out, todo = [], [(run, at)]
    while todo:
        run, at = todo.pop()
        whole = _test(run, at)
        if whole and whole[1] >= min_random:
            out.append(whole)
            continue
        pieces = {(m.start(), m[0]) for split in SPLITS for m in split.finditer(run)} - {(0, run)}
        tests = sorted((t for x, piece in pieces if (t := _test(piece, at + x))), key=lambda t: (t[1] < min_random, t))
        if not tests or (whole and tests[0][1] < min_random):
            out += [whole] if whole else []
            continue
        chosen: list[tuple[int, int]] = []
        for t in tests:
            i = bisect_left(chosen, t[2:4])
            if (i == 0 or chosen[i - 1][1] <= t[2]) and (i == len(chosen) or t[3] <= chosen[i][0]):
                chosen.insert(i, t[2:4])
                out.append(t)
        # what is left between the chosen pieces is a run of its own
        ends, starts = [at, *(e for _, e in chosen)], [*(s for s, _ in chosen), at + len(run)]
        todo += [(run[s - at : e - at], s) for s, e in zip(ends, starts, strict=True) if e - s >= 20]
    return out


def random_tokens(text: str, spans: list[tuple[int, int, str]], q: float = Q, min_random: float = MIN_RANDOM) -> list[tuple[int, int, str]]:
    """Spans (start, end, "random") of the tokens outside ``spans`` that pass the battery."""
    tests = []
    starts, ends = [s[0] for s in spans], list(accumulate((s[1] for s in spans), max))  # spans are in order of start
    for m in CANDIDATE.finditer(text):
        if (i := bisect_left(starts, m.end())) and ends[i - 1] > m.start():
            continue
        tests += candidates(m[0], m.start(), min_random)
    if not tests:
        return []
    mean = sum(len(t[4]) for t in tests) / len(tests)
    weighted = sorted((p * mean / len(token) if uniform >= min_random else math.inf, start, end) for p, uniform, start, end, token in tests)
    passed = max((i for i, t in enumerate(weighted, 1) if t[0] <= q * i / len(weighted)), default=0)
    return sorted((start, end, "random") for _, start, end in weighted[:passed])


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of the three patterns, in code points, by start and kind."""
    found = []
    if ("=" in text or ":" in text) and any(map(text.lower().__contains__, KEYWORDS)):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def scan(text: str | None, q: float = Q, min_random: float = MIN_RANDOM) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """The patterns' spans, and all spans, each by start and kind. Null counts as empty."""
    text = text or ""
    base = base_spans(text)
    more = random_tokens(text, base, q, min_random)
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]))) if more else base


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Each stretch of overlapping spans becomes one mask."""
    out, at = [], 0
    for start, end, _ in sorted(spans):
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, q: float = Q, min_random: float = MIN_RANDOM) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): counts of the patterns, the hash of their
    spans, and all spans as text ``kind:start:end`` by start, then kind.

    A null or empty text has no spans (an empty string, and the hash of one). Repeated rows
    stay; a null doc_id stays null; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1):
                base, every = scan(t.as_py(), q, min_random)
                kinds = [k for *_, k in base]
                rows.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 3 + [pa.string()] * 2, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, length: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span of ``text`` masked, and the column ``length`` (if any) set anew for changed texts.

    All columns and rows stay; a null text stays null. A text without spans is unchanged.
    """
    names = docs.columns
    at = names.index("text")
    size = names.index(length) if length in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, columns, changed = b.column(at).to_pylist(), list(b.columns), {}
            for i, t in enumerate(texts):
                if t and (spans := scan(t)[1]):
                    texts[i] = changed[i] = redacted(t, spans)
            if changed:
                columns[at] = pa.array(texts, b.schema.field(at).type)
                if size is not None:
                    lengths = columns[size].to_pylist()
                    for i, t in changed.items():
                        lengths[i] = len(t)
                    columns[size] = pa.array(lengths, b.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return arrow_map(docs, run, kinds)


def op7_randomness_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
