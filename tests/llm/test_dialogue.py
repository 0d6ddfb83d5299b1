import hashlib
import heapq
import random
import re
import zlib

import pytest

from ledgerloom.llm import dialogue as op

GRAMMAR = re.compile(r"(s?(ua)+)?")
INNER = re.compile(r"[^\x20\x09-\x0D]")


def spaced(value):
    return " " if value is None else str(value)


def damage(rows):
    kept = []
    for conv, turn, role, text in rows:
        role, text = spaced(role), spaced(text)
        d = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        kept += [(conv, turn, "user" if d == 4 else role, text)] * {0: 0, 3: 2}.get(d, 1)
    return kept


def cheapest(faulty):
    """(cost, audit, repaired) of rows (role, text, fault): best first over all edits, by (cost, audit) as a whole."""
    waiting, done = [(0, "", 0, "", ())], set()
    ends = []
    while waiting:
        cost, audit, at, initials, out = heapq.heappop(waiting)
        if ends and cost > ends[0][0]:
            break
        if at == len(faulty) and GRAMMAR.fullmatch(initials):
            ends.append((cost, audit, out))
        form = initials[:1] == "s", len(initials) > 0, len(initials) > 1, initials[-1:]
        if (at, form, audit) in done:
            continue
        done.add((at, form, audit))
        if len(audit) > 2 * len(faulty) + 3:
            continue

        def push(more, letter, by, consumed, entry):
            if re.fullmatch(r"s?(ua)*u?", initials + more):
                heapq.heappush(waiting, (cost + by, audit + letter, at + consumed, initials + more, out + entry))

        for initial, role in (("u", "user"), ("a", "assistant")):
            if not audit.endswith("III"):
                push(initial, "I", 2, 0, (f"{role}:",))
        if at < len(faulty):
            role, text, fault = faulty[at]
            push("", "D", 3, 1, ())
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                if role[:1] in ("s", "u", "a"):
                    push(role[:1], "K", extra, 1, (f"{role}:{text}",))
                for initial, other in (("u", "user"), ("a", "assistant")):
                    push(initial, "R", 2 + extra, 1, (f"{other}:{text}",))
    return min(ends)


def brute(conv, rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, faulty = set(), []
    for _, _, role, text in rows:
        inner = INNER.findall(text)
        fault = "blank" if not inner else "duplicate" if (role, text) in seen else "truncated" if inner[-1] not in ".!?" else ""
        seen.add((role, text))
        faulty.append((role, text, fault))
    counts = [sum(f == name for _, _, f in faulty) for name in ("blank", "duplicate", "truncated")]
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:]))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit, out = cheapest(faulty)
    return (conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()), out


def by_conversation(rows, originals):
    found = {conv: [] for conv in originals}
    for row in rows:
        found[row[0]].append(row)
    return found


def check(frame, rows, originals):
    wanted = sorted((brute(conv, own)[0] for conv, own in by_conversation(rows, originals).items()), key=str)
    assert sorted((tuple(r) for r in frame.collect()), key=str) == wanted


def test_whole_table_equals_brute_force(spark, sf_dir):
    read = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = [tuple(r) for r in read.collect()]
    check(op.op11_dialogue(spark, sf_dir), damage(rows), {r[0] for r in rows})


SCHEMA = "conv_id long, turn long, role string, text string"
TEXTS = ["Yes.", "no", "", " \t", "Why?", None, "x" * 50_000 + "!", "fin. \n"]


def random_rows(seed, conversations, longest, roles):
    draw = random.Random(seed)
    return [
        (conv, draw.choice([turn, turn, turn, None, turn + 5]), draw.choice(roles), draw.choice(TEXTS))
        for conv in range(conversations) for turn in range(draw.randint(1, longest))
    ]


@pytest.mark.parametrize("roles", [["user", "assistant"], ["system", "user", "assistant", "tool", None, "usher", ""]])
def test_random_conversations_equal_brute_force(spark, roles):
    rows = random_rows(4, 120, 6, roles)
    sound = [(c, t, spaced(r), spaced(x)) for c, t, r, x in rows]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as present_", "'x' as audit", "7L as cost")
    check(op.repair(frame.repartition(5)), sound, {r[0] for r in rows})


def test_damage_of_nulls_repeats_and_lost_conversations(spark):
    rows = [(None, 1, "user", "Hi."), (None, None, "assistant", None), (1, 1, None, "x."), *[(2, 0, "system", "S.")] * 3]
    lost = next(i for i in range(100, 10_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows.append((lost, 0, "user", "gone."))
    frame = op.repair(op.damaged(spark.createDataFrame(rows, SCHEMA)))
    check(frame, damage(rows), {r[0] for r in rows})
    empty = frame.where(f"conv_id = {lost}").first()
    assert (empty.audit, empty.cost, empty.repaired_sha256) == ("", 0, hashlib.sha256(b"").hexdigest())
    assert op.repair(op.damaged(spark.createDataFrame([], SCHEMA))).collect() == []


def test_repaired_rows_have_the_hash_of_the_repair(spark):
    rows = random_rows(9, 60, 9, ["system", "user", "assistant", "tool"])
    frame = spark.createDataFrame(rows, SCHEMA)
    repairs = op.repair(frame)
    turns = {}
    for r in sorted(op.repaired(frame, repairs).collect(), key=lambda r: r.place):
        turns.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for r in repairs.collect():
        assert hashlib.sha256("\n".join(turns.get(r.conv_id, [])).encode()).hexdigest() == r.repaired_sha256


def test_a_long_conversation_is_folded_and_equals_the_short_way(spark, monkeypatch):
    rows = [(7, i, ("user", "assistant", "user")[i % 3], f"turn {i}" + "." * (i % 5)) for i in range(30_000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    [whole] = op.repair(frame).collect()
    assert len(whole.audit.replace("I", "")) == 30_000 and whole.truncated == 6000
    monkeypatch.setattr(op, "FOLD", 7)
    short = op.Conversation()
    for _, turn, role, text in rows:
        short.add(turn, role, text.encode(), op.SOUND if text.endswith(".") else op.CUT)
    assert (7, *short.result()) == tuple(whole)
