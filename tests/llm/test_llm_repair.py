import hashlib
import random
import sys
import zlib
from functools import lru_cache

from pyspark.sql import functions as F

from slotwise.llm import repair

SPACES = " \t\n\x0b\x0c\r"
COLUMNS = "conv_id long, turn long, role string, text string"
LEGAL = {"0s", "0u", "su", "ua", "au"}


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def cheapest(rows, faults):
    """(cost, edits, repaired text) by trying everything, edits compared as whole texts."""
    @lru_cache(None)
    def best(i, state, added):
        ways = [(0, "", "")] if i == len(rows) and state in "0a" else []
        given = "a" if state == "u" else "u"
        name = "assistant" if given == "a" else "user"
        if added < 3:
            cost, edits, text = best(i, given, added + 1)
            ways.append((cost + 2, "I" + edits, f"{name}:\n{text}"))
        if i < len(rows):
            _, role, said = rows[i]
            cost, edits, text = best(i + 1, state, 0)
            ways.append((cost + 3, "D" + edits, text))
            if faults[i] not in ("b", "d"):
                more = faults[i] == "t"
                if state + role[:1] in LEGAL:
                    cost, edits, text = best(i + 1, role[:1], 0)
                    ways.append((cost + more, "K" + edits, f"{role}:{said}\n{text}"))
                cost, edits, text = best(i + 1, given, 0)
                ways.append((cost + 2 + more, "R" + edits, f"{name}:{said}\n{text}"))
        return min(ways, key=lambda w: w[:2], default=(10**9, "", ""))

    return best(0, "0", 0)


def brute(rows):
    every = {}
    for conv, turn, role, text in rows:
        mine = every.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if code == 1 else "".join(c for c in text if c not in ".!?") if code == 2 else text
        mine += [(turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    out = []
    for conv, mine in every.items():
        mine = sorted(mine, key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r[2])))
        faults, seen = [], set()
        for _, role, text in mine:
            bare = text.strip(SPACES)
            faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, edits, text = cheapest(mine, faults)
        out.append((conv, gaps, *(faults.count(f) for f in "bdt"), illegal, int(cost), edits, digest(text[:-1])))
    return sorted(out, key=repr)


def odd_rows():
    pick = random.Random(3)
    rows = []
    for conv in [*range(60), None]:
        for t in range(pick.choice([0, 1, 2, 5, 9, 20])):
            rows.append((conv, pick.choice([t, t, t, None, t + 3]),
                         pick.choice(["user", "assistant", "user", "assistant", "system", "tool", "sys", "", None]),
                         pick.choice(["a.", "b", "", "  ", None, "c!\n", "e?", f"{t}.", str(t)])))
    rows += [(70, t, pick.choice(["user", "assistant", "system", "x"]), pick.choice(["again."] + [f"{t}."] * 6 + [f"{t}"] * 2)) for t in range(500)]
    rows += [(71, t, "x", f"{t}.") for t in range(301)]  # its survivors never agree
    return rows + [(72, None, "user", None)] + [(73, 5, "user", "long " * 50_000 + ".")]


def test_repair_is_the_cheapest_and_least(spark):
    sys.setrecursionlimit(20_000)
    rows = odd_rows()
    table = spark.createDataFrame(rows, COLUMNS).repartition(4).withColumns(
        {c: F.lit("x") for c in ("conv", "slice", "step", "edit", "fault", "row", "digest", "enter", "leave", "final", "copy", "code")})
    for slices in (None, 9):
        assert sorted((tuple(r) for r in repair.damage_and_repair(table, slices).collect()), key=repr) == brute(rows)
    edits = repair.repair(repair.damaged(table), 9)
    assert edits.filter("conv = 'v70'").select("slice").distinct().count() > 1  # searched in pieces
    kept = repair.repaired(edits).filter("conv_id = 71").orderBy("slice", "step").collect()
    assert [r["role"] for r in kept[:4]] == ["user", "assistant"] * 2


def test_conversations_without_rows(spark):
    none = spark.createDataFrame([], COLUMNS)
    assert repair.damage_and_repair(none).count() == 0
    gone = next(i for i in range(10_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    one = spark.createDataFrame([(gone, 0, "user", "a.")], COLUMNS)
    assert [tuple(r) for r in repair.damage_and_repair(one).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", digest(""))]


def test_only_what_survivors_do_not_share_is_held():
    out = []
    run = repair.Survivors(repair.START, out.append)
    for i in range(10_000):
        run.step("ua"[i % 2], None)
    assert len(out) > 9_900 and set(out) == {"K"}
    assert len(run.unresolved(run.end())) + len(out) == 10_000


def test_no_state_saves_more_than_stated():
    pick = random.Random(8)
    for _ in range(3000):
        rows = [(i, pick.choice(["user", "assistant", "system", "x"]), "") for i in range(pick.randint(0, 7))]
        faults = [pick.choice(["", "", "t", "d"]) for _ in rows]
        rest = {}
        for state in range(4):
            run = repair.Survivors(state)
            for (_, role, _), fault in zip(rows, faults):
                run.step(role[:1], {"": None, "t": "truncated", "d": "duplicate"}[fault])
            rest[state] = min(cost + 2 * len(repair._CLOSING[s]) for s, cost, _ in run.alive)
        assert all(rest[y] - rest[x] <= most for (x, y), most in repair._REST.items())
