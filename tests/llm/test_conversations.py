"""Repair of conversations against a search over all edits, cheapest first."""

import hashlib
import heapq
import random
import re
import zlib

from sitegrain.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string"
FOLLOWS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def damaged(rows):
    out = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        out += [(c, t, "user" if kind == 4 else r, x)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def search(rows):
    """Faults, cost, letters and repaired lines: Dijkstra over (rows done, last role), smallest (cost, letters) first."""
    seen, fault = set(), []
    for _, _, r, x in rows:
        ink = re.findall(r"[^\x20\x09-\x0D]", x)
        fault.append("blank" if not ink else "duplicate" if (r, x) in seen else "" if ink[-1] in ".!?" else "truncated")
        seen.add((r, x))
    todo, done = [(0, "", 0, "", ())], {}
    while True:
        cost, audit, i, last, said = heapq.heappop(todo)
        if done.setdefault((i, last), (cost, audit)) < (cost, audit):
            continue
        if i == len(rows) and last in ("", "a"):
            return fault, cost, audit, said

        def go(price, letter, step, role, text):
            if (last, role[:1]) in FOLLOWS:
                heapq.heappush(todo, (cost + price, audit + letter, i + step, FOLLOWS[last, role[:1]], (*said, f"{role}:{text}")))  # noqa: B023

        for role in ("user", "assistant"):
            go(2, "I", 0, role, "")
        if i < len(rows):
            heapq.heappush(todo, (cost + 3, audit + "D", i + 1, last, said))
            if fault[i] in ("", "truncated"):
                more = fault[i] == "truncated"
                go(more, "K", 1, rows[i][2], rows[i][3])
                for role in ("user", "assistant"):
                    go(2 + more, "R", 1, role, rows[i][3])


def plain(rows):
    out = {c: [] for c, *_ in rows}
    for r in damaged(rows):
        out[r[0]].append(r)
    result = []
    for c, some in out.items():
        some.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
        fault, cost, audit, said = search(some)
        turns = [r[1] for r in some if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(some, some[1:]))
        result.append((c, gaps, fault.count("blank"), fault.count("duplicate"), fault.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return sorted(result, key=repr)


def conversations_of(seed, n):
    rng = random.Random(seed)
    texts = ["Hi.", "Hi.", "ok", "yes!", "", " \t", "no?", "a.\n ", None, "Longer text here.", "ünï", " ", "x. y"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "anon", "speaker"]
    rows = []
    for c in [None, *range(n)]:
        rows += [(c, rng.choice([None, *range(-2, 12)]), rng.choice(roles), rng.choice(texts)) for _ in range(rng.randint(1, 14))]
    return rows


def test_repair_is_the_cheapest(spark):
    rng = random.Random(4)
    rows = conversations_of(3, 120)
    rows += [(1000, t, rng.choice(("user", "assistant", "system", "tool")), f"{rng.randint(0, 60)}" + rng.choice((".", ""))) for t in range(300)]  # in many parts
    rows += [(1001, 5, "user", "same text.")] * 200 + [(1002, t, "user", "again.") for t in range(100)]
    table = spark.createDataFrame([(*r, "x", 2) for r in rows], SCHEMA + ", text_ string, kind int").repartition(5)
    got = conversations.repair_table(spark, table)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = sorted([tuple(r) for r in got.collect()], key=repr)
    want = plain(rows)
    assert got == want
    assert {"K", "R", "D", "I"} <= set("".join(r[7] for r in want))


def test_conversation_without_rows(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = conversations.repair_table(spark, spark.createDataFrame([(gone, 0, "user", "x.")], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert conversations.repair_table(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_chained_segments_equal_one_run():
    """cheapest() over pieces of a run, chained, against the whole run."""
    rng = random.Random(8)
    for _ in range(300):
        rows = [(rng.choice("uasx"), rng.choice((0, 0, 1, 2, 3)), rng.choice((1, 1, 2))) for _ in range(rng.randint(0, 9))]
        whole = conversations._Chain(1)
        whole.add(conversations._segment(0, 1, [(None, a, n, f) for a, f, n in rows], False))
        parts = conversations._Chain(1)
        at = 0
        while at < len(rows):
            step = rng.randint(1, 3)
            parts.add(conversations._segment(0, 1, [(None, a, n, f) for a, f, n in rows[at : at + step]], False))
            at += step
        assert parts.close() == whole.close()


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "a."), (1, 1, "user", "b."), (2, 0, "system", "s."), (2, 1, "user", "u."), (2, 2, "assistant", "long " * 300_000 + ".")]
    got = conversations.repair(spark, spark.createDataFrame(rows, SCHEMA), texts=True).collect()
    said = {}
    for r in sorted(got, key=lambda r: (r["conv_id"], r["place"])):
        said.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert said[2] == [("system", "s."), ("user", "u."), ("assistant", "long " * 300_000 + ".")]
    assert said[1] == [("user", "b."), ("assistant", "")] or [r for r, _ in said[1]] in (["user", "assistant"], ["user", "assistant", "user", "assistant"])
