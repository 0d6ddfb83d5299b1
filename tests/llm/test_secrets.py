import hashlib
import math
import random
import re
import time

from ledgerloom.llm import secrets as op


def brute_base(text):
    """The contract, kind by kind, with the patterns as given."""
    patterns = {
        "assign": (r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m.group(2)) >= 6),
        "access": (r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 20),
        "hex": (r"[0-9a-f]+", lambda m: len(m.group()) >= 24),
    }
    return [(m.start(), k, kind, m.end()) for k, (kind, (p, ok)) in enumerate(patterns.items()) for m in re.finditer(p, text) if ok(m)]


def check(row, text):
    base = sorted(brute_base(text))
    assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(b[1] == k for b in base) for k in range(3))
    line = ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in base)
    assert row.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
    spans = row.spans.split(",") if row.spans else []
    assert [s for s in spans if not s.startswith("guess")] == [s for s in line.split(",") if s]
    starts = [(int(s.split(":")[1]), op.KINDS.index(s.split(":")[0])) for s in spans]
    assert starts == sorted(starts) and all(int(s.split(":")[2]) <= len(text) for s in spans)


def test_whole_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op.op9_secrets(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for row in rows:
        check(row, texts[row.doc_id])


def test_made_texts(spark, odd_docs, no_docs):
    texts = ["Password = 'abc' token:abcdef", "PaſsWord=abcdefgh", "secret=token:abcdef api_key:\"x\"", "AKIAAKIA" + "Z9" * 9,
             "é 🙂 " + "0" * 24 + "g" + "a" * 23, "password: zQ9#vL2!xWq7Rt", "token=", "APIKEY=ABC.def/123==", "", None]
    rows = op.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for row in rows:
        check(row, texts[row.doc_id] or "")
    assert "guess:10:" in next(r.spans for r in rows if r.doc_id == 5)
    assert op.scan(no_docs).collect() == []
    assert len(op.scan(odd_docs).collect()) == odd_docs.count()


def test_costs_rank_values_as_expected():
    easy = ["password123", "aaaaaaaaaaaaaaaa", "qwertyuiop1234567890", "2019-05-17", "adminadminadmin", "Welcome2024", "abcabcabcabcabcabc"]
    hard = ["zQ9vL2xWq7RtPm", "k8Jd02mXzqpL4w9T", "f3a91c07be5d2288"]
    assert max(map(op.guess_bits, easy)) < op.MIN_BITS <= min(map(op.guess_bits, hard))
    assert op.guess_bits("") == 0
    # brute force alone is an upper bound, and a longer value never costs much less
    for value in easy + hard:
        assert op.guess_bits(value) <= sum(map(op._character_bits, value)) + 1e-9


def test_least_cost_equals_trying_every_segmentation():
    def every(value):
        if not value:
            return 0.0
        segments = op._segments(value).get(len(value), ())
        return min([every(value[:-1]) + op._character_bits(value[-1])] + [every(value[:i]) + bits + 1 for i, bits in segments])

    for value in ("pass1234x", "Tr0ub4dor&3", "my2019pass", "secretqwerty"):
        assert abs(op.guess_bits(value) - every(value)) < 1e-9, value


def test_redaction_changes_only_spans(spark, odd_docs):
    docs = spark.createDataFrame(
        [(1, "x password=hunter2abc y", 23, "a"), (2, "clean text", 10, None), (3, None, None, "b"), (4, "", 0, "c")],
        "doc_id long, text string, n_chars long, spans string",
    )
    rows = sorted(tuple(r) for r in op.redact(docs).collect())
    assert rows == [(1, "x [secret] y", 12, "a"), (2, "clean text", 10, None), (3, None, None, "b"), (4, "", 0, "c")]
    assert op.redact(docs).columns == docs.columns and op.redact(odd_docs).count() == odd_docs.count()


def test_random_values_of_eight_characters_letters_and_quoted_ones():
    for value in ("kqzvxjwpbtmrhd", "hGtRkLmQzXwVb", "Xk9#mQ2v", "aZ8$kP3wT", "k8jd02mx"):
        assert op.guessed_spans(f"x passphrase: {value} y") == [(14, 3, 14 + len(value))], value
    assert op.guessed_spans("""password = "Xk9, mQ2;v(Z)'w" z""") == [(12, 3, 27)]
    assert op.guessed_spans("pwd: 'ab, cd' and more text") == []
    assert op.guessed_spans("pin: 48291057 login: baseball") == []


def test_words_of_the_corpus_cost_little_and_values_are_not_words(spark):
    rows = [(i, f"Die Unwahrscheinlichkeit, sagt er. passphrase: kqzvxjwpbtmrhd {i}") for i in range(9)]
    docs = spark.createDataFrame(rows + [(9, "login: Unwahrscheinlichkeit"), (10, None)], "doc_id long, text string").repartition(3)
    words = op.corpus_words(docs)
    assert "unwahrscheinlichkeit" in words and "kqzvxjwpbtmrhd" not in words
    spans = {r.doc_id: r.spans for r in op.scan(docs).collect()}
    assert spans[9] == "" and all(spans[i] == "guess:47:61" for i in range(9))
    assert "[secret]" in op.redact(docs).where("doc_id = 3").first().text


def test_only_so_many_corpus_words_are_sent(spark, monkeypatch):
    monkeypatch.setattr(op, "KNOWN", 2)
    rows = [(i, " ".join(["oftenword", "alsooften"] + ["seldomword"] * (i < 4))) for i in range(9)]
    words = op.corpus_words(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {"oftenword", "alsooften"} <= set(words) and "seldomword" not in words


def slow_bits(value, words=op.WORD_BITS, ascii_bits=None):
    """Every segmentation by every start of every repeat."""
    segments, single = op._segments(value, words), [op._character_bits(c) if ascii_bits is None else ascii_bits for c in value]
    best = [0.0]
    for end in range(1, len(value) + 1):
        cost = min([best[end - 1] + single[end - 1]] + [best[i] + bits + 1 for i, bits in segments.get(end, ())])
        for size in range(1, op.LONGEST + 1):
            times = 2
            while end - times * size >= 0 and value[end - times * size : end - size] == value[end - (times - 1) * size : end]:
                start = end - times * size
                if times * size >= 3:
                    unit = min(best[start + size] - best[start], sum(single[start : start + size]))
                    cost = min(cost, best[start] + max(0.0, unit) + math.log2(times) + 1)
                times += 1
        best.append(cost)
    return best[-1]


def test_price_does_not_depend_on_where_a_value_is_cut():
    for value in ("*" * 600, "-=" * 500, "password" * 90, "=" * 300 + "secret" + "=" * 300):
        assert op.guess_bits(value) < 40 and op.guessed_spans(f"login: {value} x") == [], value[:20]
    draw = random.Random(5)
    for _ in range(60):
        parts = ["pass", "password", "dd", "ddd", "ab", "abab", "*" * 9, "2019", "qwerty", "x9", "Zq"]
        value = "".join(draw.choice(parts) * draw.choice((1, 1, 2, 5)) for _ in range(draw.randint(1, 12)))
        assert abs(op.guess_bits(value) - slow_bits(value)) < 1e-6, value
        assert op.hard_to_guess(value, 40.0) == (slow_bits(value, ascii_bits=op.alphabet_bits(value)) >= 40.0), value
    long = "".join(draw.choice("abcdefghijkmnpqrstuvwxyz0123456789") for _ in range(1 << 20))
    assert op.hard_to_guess(long, 40.0)  # decided from its first characters


def test_long_repetitive_values_take_time_in_proportion():
    took = []
    for n in (10_000, 20_000):
        begin = time.process_time()
        assert op.guess_bits("a" * n) < 21 and op.guess_bits("k9#mQ2v" * (n // 7)) < 45
        took.append(time.process_time() - begin)
    assert took[1] < 3 * took[0]
    begin = time.process_time()
    assert op.guessed_spans("password: " + "x" * 100_000) == []
    assert time.process_time() - begin < 20


def test_a_unit_longer_than_any_word_is_a_repeat():
    draw = random.Random(2)
    unit = "".join(draw.choice("abcdefghijkmnpqrstuvwxyz0123456789") for _ in range(op.LONGEST + 1))
    once = op.guess_bits(unit)
    assert op.smallest_period(unit * 5) == len(unit) and op.smallest_period("") == 0
    assert op.guess_bits(unit * 5) < once + 5 < op.guess_bits(unit + unit[::-1])
