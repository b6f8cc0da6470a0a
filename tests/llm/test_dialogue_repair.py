"""Repair of conversations against a shortest-path search over edits, written apart from the parser."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from forecourt.llm import dialogue_repair
from forecourt.llm.support import Work

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(rows):
    """(cost, audit, repaired) by uniform-cost search: state is (rows done, state of the automaton)."""
    seen, faults = set(), []
    for role, text in rows:
        if not BLANK.search(text):
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append(None if re.search(r"[.!?][\x20\x09-\x0D]*\Z", text) else "truncated")
        seen.add((role, text))
    step = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, done = [(0, "", 0, "0", ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("0", "a"):
            return cost, audit, out, faults
        for name in ("user", "assistant"):
            if (state, name[0]) in step:
                heapq.heappush(heap, (cost + 3, audit + "I", i, step[state, name[0]], (*out, f"{name}:")))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, out))
            if faults[i] in (None, "truncated"):
                more = 3 if faults[i] else 0
                for price, edit, name in ((0, "K", role), (3, "R", "user"), (3, "R", "assistant")):
                    if (state, name[:1]) in step:
                        heapq.heappush(heap, (cost + price + more, audit + edit, i + 1, step[state, name[:1]], (*out, f"{name}:{text}")))


def expected(conversations):
    groups = {}
    for conv, turn, role, text in conversations:
        groups.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        groups[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        cost, audit, lines, faults = cheapest([r[1:] for r in rows])
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        out[conv] = (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found(df):
    rows = dialogue_repair.repaired_digests(df).collect()
    out = {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_damaged_conversations(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert found(df) == expected([tuple(r) for r in df.collect()])


def random_rows(seed, conversations, longest):
    r = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "unknown", "Sys"]
    texts = ["Hi.", "Well?", "no end", " ", "", None, "a.b", "So! \n", "\x1f", "é?\x0b"]
    return [(c, r.choice([None, *range(longest)]), r.choice(roles), r.choice(texts) if r.random() < 0.4 else f"{r.random()}.") for c in [None, *range(conversations)] for _ in range(r.randint(1, longest))]


def test_random_conversations(spark):
    rows = random_rows(1, 120, 9)
    assert found(spark.createDataFrame(rows, SCHEMA)) == expected(rows)


def test_long_conversations_are_joined_from_blocks(spark, monkeypatch):
    monkeypatch.setattr(dialogue_repair, "BLOCK_BITS", 2)
    monkeypatch.setattr(dialogue_repair, "FAN_BITS", 1)
    rows = random_rows(2, 3, 120) + [(7, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(300)]
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(5)) == expected(rows)


def full_chart(rows):
    """Every cut of every span, and closure everywhere."""
    chart = {(i, i + 1): dialogue_repair.row_cell(r) for i, r in enumerate(rows)}
    for length in range(2, len(rows) + 1):
        for i in range(len(rows) - length + 1):
            cell = {}
            for k in range(i + 1, i + length):
                for kind, (cost, audit) in dialogue_repair.combined(chart[i, k], chart[k, i + length]).items():
                    dialogue_repair._better(cell, kind, cost, audit)
            chart[i, i + length] = dialogue_repair.closed(cell)
    return chart[0, len(rows)]


def test_one_cut_is_as_good_as_all():
    r = random.Random(4)
    for _ in range(150):
        rows = "".join(chr(65 + r.randrange(16)) for _ in range(r.randint(1, 12)))
        assert dialogue_repair.parse(rows) == full_chart(rows)


def test_repaired_rows_and_odd_tables(spark):
    rows = [(1, 1, "user", "A?"), (1, 1, "user", "A?"), (1, 2, "user", "x" * 200_000 + "."), (2, None, None, None), (3, 5, "system", "Be brief.")]
    df = spark.createDataFrame([(*r, "clash", 9) for r in rows], f"{SCHEMA}, audit string, place int")
    reports, repaired = dialogue_repair.repair(df)
    told = {r["conv_id"]: (r["cost"], r["audit"]) for r in reports.collect()}
    assert told == {1: (7, "KDR"), 2: (4, "D"), 3: (4, "D")}
    lines = [(r["role"], len(r["text"]), r["edit"]) for r in repaired.filter("conv_id = 1").orderBy("place", "step").collect()]
    assert [x[0] for x in lines] == ["user", "assistant"]
    assert found(df.limit(0)) == {}
    assert all(t.count() == 0 for t in dialogue_repair.repair(df.limit(0)))
    work = Work(spark)
    assert dialogue_repair.repair(df.withColumn("turn", F.lit(None).cast("long")), work)[0].count() == 3
