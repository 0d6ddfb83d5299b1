"""Secrets in texts: fixed patterns, and values in a credential context that would take many guesses.

``guess_bits`` is the least cost of cutting a value into known words, dates, repeats, keyboard or alphabet walks and
single characters tried one by one, in bits (dynamic programming over the value's positions). A value that a
credential keyword introduces is a secret when it costs ``MIN_BITS`` or more. Pattern matches are secrets anyway.
The value is priced whole, however long; a repeated unit longer than ``LONGEST`` is found where it makes up the value.
A quoted value goes up to its closing quote on the same line, any other up to white space, a quote or a bracket.

Single characters of such a value cost one out of all the classes the value draws from (lower, upper, digits, other
ASCII), so 8 random characters of two classes or more cost 41 bits at least. Of one class alone, it takes 9 letters
or 13 digits. Known words are ``WORDS`` and the words of the corpus itself, by their rank: at most ``KNOWN`` of them,
seen in ``SEEN`` texts or more outside credential contexts, are counted in Spark and broadcast.

Null or empty text: no spans. Repeated rows: a row each. Empty table: no rows. Spans are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import give_back, table, text_columns, text_slices, tidy, written

# fixed values: the patterns of the base kinds and the least length of what they must hold
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # runs of 20 characters
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "guess")

#: A credential keyword, something that assigns, and the value. Values are cut at quotes, brackets and white space.
CONTEXT = re.compile(
    r"""(?<![A-Za-z])(?:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|credentials?|auth(?:orization)?|bearer|login"""
    r"""|(?:api|access|private|client|encryption|signing)[_-]?(?:key|secret|token))["']?[ \t]*(?:[:=]+>?|[ \t]is[ \t])[ \t]*"""
    r"""(?:"((?:\\.|[^"\\\n]){8,})"|'((?:\\.|[^'\\\n]){8,})'|["'<(]?([^\s"'<>(),;]{8,}))""",
    re.IGNORECASE | re.ASCII,
)
#: Least cost of a value, and the longest stretch that is looked up as one word, date, walk or unit of a repeat.
MIN_BITS, LONGEST = 40.0, 40
#: Corpus words that are broadcast at most, and in how many texts each is seen at least.
KNOWN, SEEN = 1 << 17, 3

# fixed values: frequent parts of passwords, most frequent first
WORDS = (
    "password pass word secret admin login user root token test welcome letmein master key access server system guest "
    "default change me changeme hello love dragon monkey shadow sunshine princess football baseball summer winter "
    "spring autumn monday friday january june july august december example sample demo public private database data "
    "api client service account company office home internet network cloud backup temp manager super power magic star "
    "blue red green black white orange silver gold the and for you your this that one two three first last new old"
).split()
WORD_BITS = {word: math.log2(rank + 2) for rank, word in reversed(list(enumerate(WORDS)))}
_LN2 = math.log(2)
AROUND = ".,:;!?()[]{}<>\"'"  # what may stand around a word of the corpus
LEET = str.maketrans("@4310$5!7", "aaeiossit")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WALKS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "qwertzuiop", "azertyuiop", "abcdefghijklmnopqrstuvwxyz",
         "qazwsxedcrfvtgbyhnujmikolp", "1qaz2wsx3edc4rfv5tgb6yhn7ujm8ik9ol0p")
DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|"
                  r"(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:(?:19|20)\d\d|\d\d)|(?:19|20)\d\d")
DATE_BITS = {True: math.log2(365 * 120), False: math.log2(120)}


def _character_bits(char: str) -> float:
    if char.isdigit():
        return math.log2(10)
    return math.log2(26) if char.isascii() and char.isalpha() else math.log2(33) if char.isascii() else math.log2(1000)


def alphabet_bits(value: str) -> float:
    """Bits of one ASCII character out of all classes that ``value`` draws from."""
    own = [c for c in value if c.isascii()]
    lower, upper, digit = any(map(str.islower, own)), any(map(str.isupper, own)), any(map(str.isdigit, own))
    other = not all(map(str.isalnum, own))
    return math.log2(max(1, 26 * lower + 26 * upper + 10 * digit + 33 * other))


def _from(value: str, low: str, plain: str, i: int, words: dict[str, float]) -> Iterator[tuple[int, float]]:
    """(end, bits) of the stretches from ``i`` that are not brute force, except repeats."""
    for j in range(i + 3, min(len(value), i + LONGEST) + 1):
        bits = words.get(plain[i:j])
        if bits is not None:
            capitals = sum(a != b for a, b in zip(value[i:j], low[i:j]))
            first_or_all = capitals in (0, 1, j - i)
            yield j, bits + (capitals > 0) * (1 if first_or_all else j - i) + (low[i:j] != plain[i:j])
    date = DATE.match(value, i)
    if date:
        yield date.end(), DATE_BITS[len(date.group()) > 4] + 2 * bool(date.group(1) or date.group(2))
    for walk in WALKS:
        for line in (walk, walk[::-1]):
            at, n = line.find(low[i]), 0
            while at >= 0 and at + n < len(line) and i + n < len(low) and low[i + n] == line[at + n]:
                n += 1
            for length in range(3, n + 1):
                yield i + length, math.log2(47) + math.log2(length) + 1


def _lower(value: str) -> tuple[str, str]:
    """``value`` with small ASCII letters, and with look-alikes of letters replaced."""
    low = value.translate(LOWER)
    return low, low.translate(LEET)


def _segments(value: str, words: dict[str, float] = WORD_BITS) -> dict[int, list[tuple[int, float]]]:
    """For every end, the (start, bits) of stretches that are not brute force, except repeats."""
    found: dict[int, list[tuple[int, float]]] = {}
    low, plain = _lower(value)
    for i in range(len(value)):
        for end, bits in _from(value, low, plain, i, words):
            found.setdefault(end, []).append((i, bits))
    return found


def smallest_period(value: str) -> int:
    """Length of the shortest unit that ``value`` repeats from its first to its last character (Morris and Pratt)."""
    borders = [0] * len(value)
    k = 0
    for i in range(1, len(value)):
        while k and value[i] != value[k]:
            k = borders[k - 1]
        k += value[i] == value[k]
        borders[i] = k
    return len(value) - borders[-1] if value else 0


def _until(early: tuple[int, float], late: tuple[int, float]) -> float:
    """Up to which end a repeat that begins late, at a higher price, costs less than one that begins early."""
    dearer = late[1] - early[1]
    return late[0] + (late[0] - early[0]) / math.expm1(dearer * _LN2) if dearer < 64 else late[0]


def guess_bits(
    value: str, words: dict[str, float] = WORD_BITS, ascii_bits: float | None = None, enough: float = math.inf
) -> float:
    """Bits of the cheapest segmentation of ``value``; an ASCII character costs ``ascii_bits``, or by its own class.

    Ends early, with ``enough`` or more, when nothing that follows can make the value cheaper than ``enough``. Takes
    steps in proportion to the length of the value: of all begins of a repeat only those are kept that will be the
    cheapest at some end, the next to be so on top.
    """
    low, plain = _lower(value)
    single = [_character_bits(c) if ascii_bits is None or not c.isascii() else ascii_bits for c in value]
    brute = list(accumulate(single, initial=0.0))
    best = [0.0] + [math.inf] * len(value)
    period = smallest_period(value) if len(value) > 2 * LONGEST else 0
    longer = [period] if LONGEST < period <= len(value) // 2 else []
    # by size of a unit: for how long every character is the one a unit before, and by end within the unit the stack of
    # (start, bits of what precedes and one unit, end up to which it is cheaper than the one below)
    runs, open_repeats = dict.fromkeys([*range(1, LONGEST + 1), *longer], 0), {}
    log2 = math.log2
    for end in range(len(value) + 1):
        least_here = best[end]
        for size in runs if end > LONGEST else range(1, end):
            if size >= end:
                break
            if value[end - 1] != value[end - 1 - size]:
                if runs[size]:
                    runs[size] = 0
                    open_repeats.pop(size, None)
                continue
            runs[size] += 1
            if runs[size] < size:
                continue
            start = end - 2 * size
            unit_bits = min(best[start + size] - best[start], brute[start + size] - brute[start])
            starts = open_repeats.setdefault(size, {}).setdefault(end % size, [])
            while starts and starts[-1][2] <= end:
                starts.pop()
            price = best[start] + unit_bits if unit_bits > 0 else best[start]
            least = starts[-1][1] + log2((end - starts[-1][0]) // size) + 1 if starts else math.inf
            if least < least_here:
                least_here = least
            if price + 2 >= least:
                continue
            if size > 1 and price + 2 < least_here:
                least_here = price + 2
            while starts and starts[-1][1] >= price:
                starts.pop()
            while len(starts) > 1 and starts[-1][2] <= _until(starts[-1], (start, price)):
                starts.pop()
            starts.append((start, price, _until(starts[-1], (start, price)) if starts else math.inf))
        best[end] = least_here
        if end == len(value):
            break
        if end % 64 == 0 and min(best[max(0, end - 2 * max(runs)) : end + 1]) >= enough:
            if all(starts[0][1] >= enough for repeats in open_repeats.values() for starts in repeats.values() if starts):
                return enough
        best[end + 1] = min(best[end + 1], best[end] + single[end])
        for after, bits in _from(value, low, plain, end, words):
            best[after] = min(best[after], best[end] + bits + 1)
    return best[-1]


def hard_to_guess(value: str, min_bits: float, words: dict[str, float] = WORD_BITS) -> bool:
    """Whether the whole value costs enough."""
    return guess_bits(value, words, alphabet_bits(value), min_bits) >= min_bits


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed kinds, in order."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_LEAST]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def guessed_spans(text: str, min_bits: float = MIN_BITS, words: dict[str, float] = WORD_BITS) -> list[tuple[int, int, int]]:
    """Values in a credential context that cost enough."""
    spans = []
    for match in CONTEXT.finditer(text):
        kind = match.lastindex
        value = match.group(kind) if kind < 3 else match.group(3).rstrip(".:!?")
        if len(value) >= 8 and hard_to_guess(value, min_bits, words):
            spans.append((match.start(kind), 3, match.start(kind) + len(value)))
    return spans


def _words_of(texts: list[str | None]) -> Counter[str]:
    """In how many texts every word stands, credential contexts left out."""
    tokens, found = Counter(), Counter()
    for text in texts:
        tokens.update(set(CONTEXT.sub(" ", text or "").split()))
    for token, n in tokens.items():
        word = token.strip(AROUND)
        if 3 <= len(word) <= LONGEST and word.isalpha():
            found[word.translate(LOWER)] += n
    return found


def corpus_words(docs: DataFrame) -> dict[str, float]:
    """Bits of ``WORDS`` and of the most frequent words of all texts, at most ``KNOWN``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", 16 << 20):
                found = _words_of(part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])

    texts = docs.select(F.col("text").cast("string").alias("text"))
    counted = texts.mapInArrow(tidy(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= SEEN)
    counted = written(counted.withColumn("level", F.floor(F.log2("n") * 8)), "word-counts")
    least, total = 0, 0
    for row in sorted(counted.groupBy("level").count().collect(), reverse=True):  # at most 504 rows
        total += row["count"]
        if total > KNOWN:
            least = row["level"] + 1
            break
    known = counted.where(F.col("level") >= least).select("word", "n").collect()
    ranked = sorted(known, key=lambda row: (-row["n"], row["word"]))
    bits = {row["word"]: math.log2(rank + 2) for rank, row in enumerate(ranked)}
    return bits | {word: min(own, bits.get(word, own)) for word, own in WORD_BITS.items()}


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame, min_bits: float = MIN_BITS) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row."""
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    shared = docs.sparkSession.sparkContext.broadcast(corpus_words(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            for part in text_slices(batch, "text", 16 << 20):
                counts, base_sums, spans = ([], [], []), [], []
                for text in part.column(1).to_pylist():
                    base = base_spans(text or "")
                    for kind in range(3):
                        counts[kind].append(sum(b[1] == kind for b in base))
                    base_sums.append(hashlib.sha256(joined(base).encode()).hexdigest())
                    spans.append(joined(sorted(base + guessed_spans(text or "", min_bits, words))))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(base_sums, pa.string()), pa.array(spans, pa.string())],
                    names=[f.split()[0] for f in schema.split(", ")],
                )

    return text_columns(docs).mapInArrow(tidy(run), schema)


def redact(docs: DataFrame, mark: str = "[secret]", min_bits: float = MIN_BITS) -> DataFrame:
    """``docs`` with every span replaced by ``mark`` (overlapping ones by one), and ``n_chars`` of texts that change."""

    shared = docs.sparkSession.sparkContext.broadcast(corpus_words(docs))

    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = shared.value
        for batch in texts:
            yield batch.map(lambda text: _redacted(text, mark, min_bits, words), na_action="ignore")
        give_back()

    cleaned = F.pandas_udf(clean, "string")(F.col("text").cast("string"))
    out = docs.withColumn("text", cleaned)
    if "n_chars" in docs.columns:
        changed = F.contains(F.col("text"), F.lit(mark))
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def _redacted(text: str, mark: str, min_bits: float, words: dict[str, float] = WORD_BITS) -> str:
    out, at = [], 0
    for start, _, end in sorted(base_spans(text) + guessed_spans(text, min_bits, words)):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES: dict[str, tuple[Callable, str | None]] = {"op9_secrets": (op9_secrets, None)}
