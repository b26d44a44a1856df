import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from kbspark.llm import conversations, queries

COST = {"K": 0, "R": 1, "D": 2, "I": 5}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        solid = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def brute(rows):
    """Least (cost, audit, repaired) by trying every script of edits, cheapest first, over (rows taken, initials so far).

    Of the initials only what the pattern can still tell apart counts.
    """
    kinds, done = faults(rows), {}
    todo = {(0, ""): (0, "", ())}
    while todo:
        key = min(todo, key=lambda k: (todo[k][0], todo[k][1]))
        cost, audit, kept = todo.pop(key)
        done[key] = (cost, audit, kept)
        at, state = key
        nexts = []
        if at < len(rows):
            _, role, text = rows[at]
            nexts.append((at + 1, state, cost + COST["D"], audit + "D", kept))
            if kinds[at] not in ("blank", "duplicate"):
                more = 5 * (kinds[at] == "truncated")
                nexts.append((at + 1, state + (role[:1] or "-"), cost + more, audit + "K", (*kept, f"{role}:{text}")))
                nexts += [(at + 1, state + r[0], cost + more + 1, audit + "R", (*kept, f"{r}:{text}")) for r in ("user", "assistant")]
        nexts += [(at, state + r[0], cost + 5, audit + "I", (*kept, f"{r}:")) for r in ("user", "assistant")]
        for to, roles, c, a, k in nexts:
            if re.fullmatch("s?(ua)*u?", roles):
                short = roles if roles in ("", "s") else {"u": "u", "a": "ua"}[roles[-1]]
                if (to, short) not in done and ((to, short) not in todo or (c, a) < todo[to, short][:2]):
                    todo[to, short] = (c, a, k)
    cost, audit, kept = min((done[len(rows), s] for s in ("", "ua") if (len(rows), s) in done), key=lambda x: x[:2])
    return cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest()


def expected(table):
    """Rows of the registered query from (conv_id, turn, role, text) rows."""
    convs = defaultdict(list)
    for conv, turn, role, text in table:
        role, text, held = role if role is not None else " ", text if text is not None else " ", convs[conv]
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        held += [] if kind == 0 else [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns, kinds = [r[0] for r in rows if r[0] is not None], Counter(faults(rows))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, audit, sha = brute(rows)
        out.append((conv, gaps, kinds["blank"], kinds["duplicate"], kinds["truncated"], illegal, cost, audit, sha))
    return Counter(out)


def run(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as gone", "2 as nth", "3 as conv", "4 as h", "5 as times", "6 as edit")
    edits = conversations.repair_conversations(conversations.damaged(df), gone=F.col("gone"))
    return edits, Counter(map(tuple, conversations.report(edits).collect()))


def test_repair_is_the_cheapest_and_least(spark):
    rng = random.Random(3)
    texts = ["Fine.", "Cut of", "Why?", " \n", "", None, "Yes!\x0b", " ", "Fine."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "User"]
    rows = [(c, rng.choice([t, t, t, None, t + 3]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"No {rng.random()}.") for c in range(400) for t in range(rng.randrange(1, 9))]
    rows += [(None, 1, "user", "Hello."), (None, None, None, None), *[(9999, 4, "user", "Same.")] * 5, (9998, None, "user", "a."), (9997, -5, "assistant", "b."), (9997, 5, "user", "c.")]
    edits, got = run(spark, rows)
    assert got == expected(rows)
    found = edits.where("edit = 'R'").first()
    assert found.role in ("user", "assistant") and found.role != found.old_role
    assert edits.where("edit = 'D' and fault = 'blank'").count()


def test_inserts_where_deleting_is_dear(monkeypatch):
    """At the given costs deleting is always cheaper than inserting; where it is not, rows are inserted."""
    for module in (conversations.COST, COST):
        monkeypatch.setitem(module, "D", 20)
    monkeypatch.setattr(conversations.Repair, "_seen", {})
    for roles in itertools.product(["system", "user", "assistant", "tool"], repeat=4):
        rows = [(t, r, f"Text {t}.") for t, r in enumerate(roles)]
        c = conversations._Conversation(1)
        for t, r, x in rows:
            c.add(t, r, x, 0)
        edits = list(c.edited())
        sha = hashlib.sha256("\n".join(f"{e[3]}:{e[4]}" for e in edits if e[1] != "D").encode()).hexdigest()
        cost = sum(COST[e[1]] for e in edits)
        assert (cost, "".join(e[1] for e in edits), sha) == brute(rows)


def test_every_short_conversation(spark):
    """All roles and kinds of text up to three rows: no remainder of the hash is left out by chance."""
    kinds = [("system", "A."), ("user", "B."), ("assistant", "C."), ("tool", "D."), ("user", "cut"), ("assistant", "cut"), ("user", "")]
    rows, conv = [], 0
    for n in (1, 2, 3):
        for some in itertools.product(kinds, repeat=n):
            conv += 1
            rows += [(conv, t, r, x + (str(t) if x == "cut" else "")) for t, (r, x) in enumerate(some)]
    assert run(spark, rows)[1] == expected(rows)


def test_giant_conversation_spills_and_carries_over(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant"]), f"Text {rng.randrange(3000)}{rng.choice(['.', ''])}" * rng.choice([1, 300])) for t in range(6000)]
    rows += [(8, 1, "user", "x" * 3_000_000 + "."), (8, 2, "assistant", "y" * 3_000_000)]
    _, spilled = run(spark, rows)  # some 10 MB: more than a conversation holds in memory, several batches
    made = []
    for held in (conversations.HELD_BYTES, 64):
        monkeypatch.setattr(conversations, "HELD_BYTES", held)
        seen, c = set(), conversations._Conversation(7)
        for t, role, text in sorted((t, r, x) for i, t, r, x in rows if i == 7):
            c.add(t, role, text, 2 if (role, text) in seen else 0 if text.endswith(".") else 3)
            seen.add((role, text))
        made.append(list(c.edited()))
    assert made[0] == made[1] and len(made[0]) >= 6000
    assert {r[0] for r in spilled} == {7, 8} and all(len(r[7]) >= 2 for r in spilled)


def test_nothing(spark):
    assert run(spark, [])[1] == Counter()
    gone = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert run(spark, [(gone, 0, "user", "Gone.")])[1] == Counter([(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())])


def test_registered_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert Counter(map(tuple, queries.queries()["op13_conversation_repair"](spark, sf).collect())) == expected(rows)
