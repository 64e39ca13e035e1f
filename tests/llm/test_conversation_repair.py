import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lotline.llm import conversation_repair as repair
from lotline.llm.queries import op13_conversation_repair

WHITE = " \t\n\x0b\x0c\r"
COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damage(rows):
    out = []
    for conv_id, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        out += [(conv_id, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """Least cost, then least audit, by Dijkstra's search over edits of (role, text, fault) rows, forwards."""
    grammar = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    heap, seen = [(0, "", 0, 0, ())], set()
    best = None
    while heap:
        cost, audit, at, state, kept = heapq.heappop(heap)
        if best and cost > best[0]:
            break
        if at == len(rows) and state in (0, 3) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, kept)
        if (cost, audit, at, state) in seen or len(audit) > len(rows) + 8:
            continue
        seen.add((cost, audit, at, state))
        for role in ("user", "assistant"):
            if role[0] in grammar[state]:
                heapq.heappush(heap, (cost + 5, audit + "I", at, grammar[state][role[0]], kept + (f"{role}:",)))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, state, kept))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                for new, price, letter in ((role, 0, "K"), ("user", 1, "R"), ("assistant", 1, "R")):
                    if new[:1] in grammar[state]:
                        heapq.heappush(heap, (cost + price + more, audit + letter, at + 1, grammar[state][new[:1]], kept + (f"{new}:{text}",)))
    return best


def brute(rows):
    """Results by conv_id of damaged rows."""
    convs = defaultdict(list)
    for row in rows:
        convs[row[0]].append(row)
    out = {}
    for conv_id, given in convs.items():
        given.sort(key=lambda r: (r[1] is not None, r[1] or 0))
        turns = [r[1] for r in given if r[1] is not None]
        faults, seen = [], set()
        for _, _, role, text in given:
            bare = text.rstrip(WHITE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faults.append((role, text, fault))
        count = [sum(f[2] == k for f in faults) for k in ("blank", "duplicate", "truncated")]
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(faults, faults[1:])]
        cost, audit, kept = cheapest(faults)
        out[conv_id] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *count, sum(p not in ("su", "ua", "au") for p in pairs),
                        cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def outcome(rows):
    """The same by the operator."""
    found = repair.repairs(rows)
    digests = {r.conv_id: r.sha256 for r in repair.digests(repair.repaired_rows(rows, found)).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    return {r.conv_id: tuple(r)[1:] + (digests.get(r.conv_id, nothing),) for r in found.collect()}


def test_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    want = brute(damage([tuple(r) for r in given.select("conv_id", "turn", "role", "text").collect()]))
    rows = op13_conversation_repair(spark, sf_dir).collect()
    assert len(rows) == given.select("conv_id").distinct().count()
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    for r in rows:
        assert tuple(r[c] for c in COLUMNS) == want.get(r.conv_id, empty)


def test_random_conversations(spark):
    rng = random.Random(5)
    rows = []
    for conv_id in range(150):
        for turn in range(rng.randrange(1, 8)):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "User", ""])
            rows.append((conv_id, rng.choice([turn, turn, turn + 3]) * 10 + turn, role, rng.choice(["Yes.", "No!", "Why", " \n", "", "Well. \t", "é…"])))
    got = outcome(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))
    assert got == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None, "user", "First."), (1, 0, "user", "Second."), (1, 1, None, "Third."), (2, None, None, None),
            (None, 3, "user", "a" * 200_000 + "."), (None, 4, "assistant", "Yes."), (3, 5, "user", "One."), (3, 5, "user", "One."),
            (3, 5, "user", "One."), (4, -2, "assistant", "Yes?"), (4, 7, "system", "No.")]
    given = spark.createDataFrame([r + (9, "x") for r in rows], "conv_id long, turn long, role string, text string, cost int, signature string")
    want = brute([tuple(" " if v is None and k > 1 else v for k, v in enumerate(r)) for r in rows])
    assert outcome(given) == want
    edits = repair.repaired_rows(given, repair.repairs(given)).where("conv_id = 3").orderBy("position").collect()
    assert [(r.role, r.text, r.edit, r.position) for r in edits] == [] or want[3][6] != "DDD"
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert outcome(empty) == {}


def test_damage(spark):
    rows = [(c, t, "assistant", "A. B! C?") for c in range(12) for t in range(12)] + [(None, None, None, None)]
    got = repair.damaged(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, damage(rows)))


@pytest.mark.parametrize("partitions", [1, 3])
def test_one_long_conversation(spark, partitions):
    """A conversation with most rows, over several Arrow batches, between short ones."""
    rows = [(7, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(25_000)] + [(c, 0, "user", "Hi.") for c in range(20) if c != 7]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(partitions)
    got = outcome(frame)
    lines = "\n".join(f"{r[2]}:{r[3]}" for r in rows[:25_000])
    assert got[7] == (0, 0, 0, 0, 0, 0, "K" * 25_000, hashlib.sha256(lines.encode()).hexdigest())
    assert all(got[c][6] == "D" and got[c][5] == 2 for c in range(20) if c != 7)


def test_endings_are_made_once():
    import pyarrow as pa
    made = []
    plain = repair.ending
    repair.ending = lambda letter, rest: made.append(letter) or plain(letter, rest)
    try:
        words = sorted(w[::-1] for w in ("suaua", "uaua", "aua", "xua", "ua", "Ua"))
        list(repair.walk(iter([pa.RecordBatch.from_arrays([pa.array(words)], names=["backwards"])])))
    finally:
        repair.ending = plain
    assert len(made) == len({w[:k] for w in words for k in range(1, len(w) + 1)})
