import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from orrery.llm import queries, repair

SF = "/root/testdata/sf0.01"
SPACES = " \t\n\x0b\x0c\r"


def spoilt(rows):
    """What the damage leaves of (conv_id, turn, role, text) rows, by conversation and in order."""
    found = defaultdict(list)
    for conv_id, turn, role, text in rows:
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(key.encode()) % 20
        kept = found[conv_id]
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for kept in found.values():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    return found


def faults(rows):
    seen, found = set(), []
    for _, role, text in rows:
        bare = text.rstrip(SPACES)
        found.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return found


def legal_start(initials):
    return re.fullmatch(r"(s?(ua)*u?|s)", initials)


def searched(rows):
    """Cost, audit and repaired rows by a uniform-cost search over whole sequences of edits."""
    kinds = faults(rows)
    heap, done = [(0, "", 0, ())], set()
    while True:
        cost, audit, at, out = heapq.heappop(heap)
        initials = "".join(r[:1] or "?" for r, _ in out)
        state = at, initials[-1:], len(out) == 1 and initials == "s"
        if state in done:
            continue
        done.add(state)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            return cost, audit, out
        steps = [(5, "I", at, (name, "")) for name in ("user", "assistant")]
        if at < len(rows):
            _, role, text = rows[at]
            more = 5 * (kinds[at] == "truncated")
            steps.append((2, "D", at + 1, None))
            if kinds[at] not in ("blank", "duplicate"):
                steps.append((more, "K", at + 1, (role, text)))
                steps += [(more + 1, "R", at + 1, (name, text)) for name in ("user", "assistant")]
        for price, edit, then, made in steps:
            grown = out if made is None else (*out, made)
            if legal_start("".join(r[:1] or "?" for r, _ in grown)):
                heapq.heappush(heap, (cost + price, audit + edit, then, grown))


def expected(rows):
    found = {}
    for conv_id, kept in spoilt(rows).items():
        kinds, turns = faults(kept), [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[:1] for _, r, _ in kept]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        cost, audit, out = searched(kept)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
        found[conv_id] = (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return found


def of(summary):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r.conv_id: tuple(r[n] for n in names) for r in summary.collect()}


def test_op11_against_a_search(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert of(queries.op11_repair(spark, SF)) == expected(rows)


def drawn(seed, count):
    draw = random.Random(seed)
    rows = []
    for conv_id in range(count):
        for turn in range(draw.randint(0, 7)):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "unknown"])
            text = draw.choice(["Yes.", "No!", "why?", "cut", "", " \n", None, "same.", "a.\n ", "end.)"])
            rows.append((None if conv_id == 5 else conv_id, draw.choice([turn, turn, turn, None, 0]), role, text))
    return rows


def test_odd_conversations_against_a_search(spark):
    rows = drawn(2, 150) + drawn(2, 3)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({n: F.lit("x") for n in ("dropped", "spoil", "mark", "kind", "made", "audit", "copy.x", "place")})
    assert of(repair.summaries(repair.damaged(table), dropped="dropped")) == expected(rows)
    assert repair.summaries(repair.damaged(table.limit(0)), dropped="dropped").count() == 0


def test_repaired_rows_are_legal_and_make_the_digest(spark):
    rows = spark.createDataFrame(drawn(4, 60), "conv_id long, turn long, role string, text string").withColumn("dropped", F.lit("not looked at"))
    found = repair.repaired(rows)
    assert found.columns == ["conv_id", "place", "edit", "role", "text"]
    out = defaultdict(list)
    for r in found.orderBy("conv_id", "place").collect():
        out[r.conv_id].append((r.role, r.text))
    for conv_id, summary in of(repair.summaries(rows)).items():
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out[conv_id]))
        assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out[conv_id]).encode()).hexdigest() == summary[-1]


@pytest.mark.parametrize("seed", range(3))
def test_paths_against_every_sequence_of_edits(seed):
    """All edits of up to three rows and two insertions in each gap."""
    draw = random.Random(seed)
    made = [()] + [m for n in (1, 2) for m in itertools.product("ua", repeat=n)]
    for _ in range(6):
        rows = [(draw.choice("suat"), draw.random() < 0.2, draw.random() < 0.3) for _ in range(draw.randint(0, 3))]
        path = repair.Path(repair.Grammar())
        choices = []
        for initial, must_go, cut in rows:
            path.add(initial, must_go, cut and not must_go)
            more = 5 * (cut and not must_go)
            choices.append([(2, "D", "")] + ([] if must_go else [(more, "K", initial), (more + 1, "R", "u"), (more + 1, "R", "a")]))
        best = min(
            (sum(e[0] for e in edits) + 5 * sum(map(len, gaps)), "".join("I" * len(g) + e[1] for g, e in zip(gaps, edits, strict=False)) + "I" * len(gaps[-1]), out)
            for edits in itertools.product(*choices)
            for gaps in itertools.product(made, repeat=len(rows) + 1)
            if re.fullmatch("(s?(ua)+)?", out := "".join("".join(g) + e[2] for g, e in zip(gaps, edits, strict=False)) + "".join(gaps[-1]))
        )
        assert path.end() == best


def test_a_long_conversation_takes_little_memory():
    path = repair.Path(repair.Grammar())
    for i in range(200_000):
        path.add("ua"[i % 2] if i % 7 else "s", i % 11 == 0, i % 13 == 0)
    cost, audit, made = path.end()
    assert len(audit) - audit.count("I") == 200_000 and cost > 0
    assert sum(map(len, path.back)) == 4 * 200_000 and re.fullmatch("s?(ua)+", made)


def test_other_grammars(spark):
    """Turns of one role only, at other prices."""
    grammar = repair.Grammar(arcs=(((0, "u"), 0),), final=(0,), roles=(("u", "user"),), rerole=3)
    rows = spark.createDataFrame([("a", 1, "user", "Go."), ("a", 2, "assistant", "Gone."), ("a", 3, "user", "Cut")], "conv_id string, turn int, role string, text string")
    found = repair.audits(rows, grammar).collect()
    assert [(r.conv_id, r.cost, r.audit) for r in found] == [("a", 4, "KDD")]
