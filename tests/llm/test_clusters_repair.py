"""Centroid clustering and conversation repair against brute-force versions and on their edges."""

import hashlib
import heapq
import random
import re
import zlib
from itertools import product

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from folioloom.llm import annulus, turn_repair  # noqa: E402

VECTORS = "vec_id long, embedding array<float>, q string, cluster string, label int"


def brute_clusters(rows, dim, k, rounds):
    """Plain Python integers throughout."""
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [list(v) for _, v in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        near = assign()
        for n in range(len(centroids)):
            if own := [v for (_, v), (_, m) in zip(kept, near, strict=True) if m == n]:
                centroids[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    near = assign()
    parts = {n: sum(d for d, m in near if m == n) for _, n in near}
    return sorted(
        ((i, n, d, parts[n], sum(parts.values()), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(kept, near, strict=True)),
        key=str,
    )


def clustered(df, **how):
    return sorted(((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in annulus.cluster(df, **how).collect()), key=str)


def test_clusters_against_brute_force(spark):
    rng = random.Random(3)
    centres = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [float(np.float32(x + rng.gauss(0, 0.2))) for x in rng.choice(centres)]) for i in range(300)]
    # coarse vectors tie; one vector repeats a hundred times, rows repeat, ids are null
    rows += [(1000 + i, [rng.choice([-0.5, 0.0, 0.5]) for _ in range(6)]) for i in range(120)]
    rows += [(2000, [0.25] * 6)] * 100 + [(None, [0.25] * 6), (None, [-3.0] * 6), (None, [-3.0] * 6)]
    bad = [(5000, None), (5001, []), (5002, [1.0] * 5), (5003, [1.0] * 7), (5004, [1.0] * 5 + [None]), (5005, [1.0] * 5 + [float("nan")]), (5006, [float("-inf")] + [1.0] * 5)]
    df = spark.createDataFrame([(i, v, "x", "y", 1) for i, v in rows + bad], VECTORS)
    assert clustered(df, dim=6, k=7) == brute_clusters(rows + bad, 6, 7, 3)


def test_clusters_edges(spark):
    few = [(1, [0.5, 0.5]), (2, [-0.5, 0.25]), (2, [-0.5, 0.25])]
    df = spark.createDataFrame([(i, v, "x", "y", 1) for i, v in few], VECTORS)
    assert clustered(df, dim=2, k=16) == brute_clusters(few, 2, 16, 3)
    assert annulus.cluster(df.limit(0)).count() == 0
    far = spark.createDataFrame([(i, [s * 3e38] * 64, "x", "y", 1) for i, s in enumerate((1.0, -1.0, 1.0))], VECTORS)
    assert {r["distance"] for r in annulus.cluster(far, k=1).collect()}  # held at LIMIT: no overflow


def test_annulus_finds_every_nearest_centroid():
    rng = np.random.default_rng(5)
    for _ in range(30):
        centroids = rng.integers(-4, 5, (12, 3))
        vectors = rng.integers(-6, 7, (200, 3))
        gaps = ((vectors[:, None, :] - centroids[None]) ** 2).sum(2)
        for hint in (None, rng.integers(0, 12, 200)):
            number, best = annulus.Annulus(centroids).nearest(vectors, hint)
            assert (number == gaps.argmin(1)).all() and (best == gaps.min(1)).all()


def every_repair(rows):
    """All ways to edit a few (initial, must_go, truncated) rows, with at most two inserts in a place."""
    inserts = [(0, "", ""), *((3, "I", r) for r in "ua"), *((6, "II", r + q) for r, q in product("ua", "ua"))]
    ways = []
    for initial, must_go, truncated in rows:
        more = 3 if truncated else 0
        own = [(4, "D", "")] if must_go else [(4, "D", ""), (more, "K", initial), (3 + more, "R", "u"), (3 + more, "R", "a")]
        ways += [inserts, own]
    for parts in product(*ways, inserts):
        if re.fullmatch("(s?(ua)+)?", "".join(p[2] for p in parts)):
            yield sum(p[0] for p in parts), "".join(p[1] for p in parts)


def cheapest(rows):
    """Dijkstra over (row, last role): another way than the chart, for conversations of any length."""
    queue, done = [(0, "", 0, "z")], set()
    goes = {"z": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    while queue:
        cost, audit, i, state = heapq.heappop(queue)
        if i == len(rows) and state in "za":
            return cost, audit
        if (i, state) in done:
            continue
        done.add((i, state))
        for role in "ua":
            if role in goes[state]:
                heapq.heappush(queue, (cost + 3, audit + "I", i, goes[state][role]))
        if i < len(rows):
            initial, must_go, truncated = rows[i]
            heapq.heappush(queue, (cost + 4, audit + "D", i + 1, state))
            if not must_go:
                for role, to in goes[state].items():
                    if role == initial:
                        heapq.heappush(queue, (cost + 3 * truncated, audit + "K", i + 1, to))
                    elif role in "ua":
                        heapq.heappush(queue, (cost + 3 + 3 * truncated, audit + "R", i + 1, to))


def charted(rows, agree=False):
    chart, given = turn_repair.Chart(), ""
    for k, row in enumerate(rows):
        chart.scan(*row)
        if agree and k % 3 == 0:
            given += chart.agreed()
    cost, rest = chart.best()
    return cost, given + rest


def random_rows(rng, n, roles="uuaasx"):
    return [(rng.choice(roles), rng.random() < 0.15, rng.random() < 0.2) for _ in range(n)]


def test_chart_against_all_repairs():
    rng = random.Random(2)
    for n in (0, 1, 2, 2, 2, 3, 3):
        for _ in range(2):
            rows = random_rows(rng, n)
            assert charted(rows) == min(every_repair(rows)) == cheapest(rows)


def test_chart_on_long_conversations():
    rng = random.Random(4)
    for n in range(4, 60):
        rows = random_rows(rng, n, rng.choice(["ua", "uuaasx", "s", "u", "aau", "x"]))
        assert charted(rows) == charted(rows, agree=True) == cheapest(rows)


def brute_report(conversations):
    def fill(x):
        return " " if x is None else str(x)

    made = {}
    for conv, turn, role, text in conversations:
        rows = made.setdefault(conv, [])
        role, text = fill(role), fill(text)
        fault = zlib.crc32(f"{fill(conv)}:{fill(turn)}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        rows += [(turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    out = []
    for conv, rows in made.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in rows:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[1][:1] for r in rows]
        illegal = sum((a, b) not in {("s", "u"), ("u", "a"), ("a", "u")} for a, b in zip(initials, initials[1:], strict=False))
        turns = [r[0] for r in rows if r[0] is not None]
        cost, audit = cheapest([(i, f in ("blank", "duplicate"), f == "truncated") for i, f in zip(initials, faults, strict=True)])
        kept = len(audit) - audit.count("D")
        roles = ("s" if kept % 2 else "") + "ua" * (kept // 2)
        left, lines = iter(rows), []
        for edit in audit:
            row = None if edit == "I" else next(left)
            if edit != "D":
                role = {"u": "user", "a": "assistant", "s": "system"}[roles[len(lines)]]
                lines.append(f"{row[1]}:{row[2]}" if edit == "K" else f"{role}:{row[2] if row else ''}")
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


TURNS = "conv_id long, turn long, role string, text string, n string, seen string"


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS)


def random_talk(rng):
    rows = []
    for conv in range(60):
        for turn in range(rng.randrange(12)):
            rows.append((conv, turn if rng.random() < 0.9 else turn + 3, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(["Yes.", "Well", "No! \t", "Why?\n", " \x0b", "", None, "a.b", "Same."])))
    rows += [(900, t, "assistant" if t % 2 else "user", f"Line {t}.") for t in range(700)]
    rows += [(901, None, "user", "Hello."), (901, None, "assistant", "Hi."), (None, 1, "user", "Null?"), (None, None, "assistant", "Id.")]
    rows += [(902, 5, "user", "Again.")] * 300 + [(903, 1, "user", "long " * 50_000 + ".")]
    rows += [(1000 + c, 0, "user", "Drop or stay.") for c in range(60)]
    return rows


def test_repair_against_brute_force(spark):
    rows = random_talk(random.Random(6))
    got = turn_repair.repair(turn_repair.damaged(turns_of(spark, rows))).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_report(rows)
    assert any(r["audit"] == "" and r["conv_id"] is not None and r["conv_id"] >= 1000 for r in got)


def test_repaired_turns_hash_alike(spark):
    made = turn_repair.damaged(turns_of(spark, random_talk(random.Random(7))))
    lines = {}
    for r in turn_repair.repaired_turns(made).orderBy("conv_id", "place").collect():
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for r in turn_repair.repair(made).collect():
        assert r["repaired_sha256"] == hashlib.sha256("\n".join(lines.get(r["conv_id"], [])).encode()).hexdigest()


def test_repair_edges(spark):
    assert turn_repair.repair(turn_repair.damaged(turns_of(spark, []))).count() == 0
    whole = turn_repair.undamaged(turns_of(spark, [(1, 0, "system", "Be."), (1, 1, "user", "A?"), (1, 2, "assistant", "B.")]))
    assert [(r["cost"], r["audit"]) for r in turn_repair.repair(whole).collect()] == [(0, "KKK")]
