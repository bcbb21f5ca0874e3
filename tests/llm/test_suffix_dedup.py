"""Suffix-array dedup against a dictionary of all strings; induced sorting against plain sorting."""

import hashlib
import random

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from folioloom.llm import induced_sort, suffix_dedup  # noqa: E402

DOCS = "doc_id long, text string, n long, mark string, cell string"


def test_induced_sort_against_plain_sort():
    rng = random.Random(1)
    for t in range(600):
        n = rng.randrange(60)
        letters = rng.choice([1, 2, 3, 26])
        text = (b"abracadabra" * 9)[: 2 * n] if t % 4 == 0 else bytes(rng.randrange(letters) for _ in range(n))
        data = np.frombuffer(text, np.uint8)
        order = induced_sort.suffix_array(data, 256)
        want = sorted(range(len(text)), key=lambda i: text[i:])
        assert order.tolist() == want
        common = induced_sort.permuted_prefixes(data, order, 11)
        for i, j in zip(want, want[1:], strict=False):
            same = next((k for k in range(11) if text[i + k : i + k + 1] != text[j + k : j + k + 1] or j + k >= len(text)), 11)
            assert common[j] == same


def brute(rows, window=100):
    """Every string of every document, in order, into one set."""
    seen, done = set(), {}
    texts = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    for key in texts:
        data = key[1].encode()
        gone = bytearray(len(data))
        for s in range(len(data) - window + 1):
            if (string := data[s : s + window]) in seen:
                gone[s : s + window] = b"\1" * window
            seen.add(string)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        left = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        done[key] = (key[0], len(data), len(data) - len(left), spans, hashlib.sha256(left).hexdigest())
    return sorted((done[i, t or ""] for i, t in rows), key=str)


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, t, 1, "m", "c") for i, t in rows], DOCS).repartition(3)
    got = suffix_dedup.suffix_dedup(df, keep_bytes=True, **how).collect()
    for r in got:
        assert r["n_spans"] == len(r["spans"]) and r["n_removed"] == sum(s["length"] for s in r["spans"])
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"]
    return sorted((tuple(r)[:5] for r in got), key=str)


def word(rng):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyzäéß") for _ in range(rng.randint(2, 9)))


def prose(rng, n):
    return " ".join(word(rng) for _ in range(n))


def corpus(rng):
    passages = [prose(rng, n) for n in (12, 17, 30, 60, 120)]
    line = prose(rng, 12)[:90]  # shorter than a window: in ever other surroundings
    rows = []
    for i in range(120):
        parts = [prose(rng, rng.randrange(40)) for _ in range(3)]
        for _ in range(rng.randrange(3)):
            parts.insert(rng.randrange(len(parts)), rng.choice(passages))
        if i % 2:
            parts.insert(1, line)
        rows.append((i * 3, " ".join(parts)))
    near = prose(rng, 80)
    rows += [(1000 + k, near[: 50 + k] + rng.choice("abc") + near[50 + k :]) for k in range(30)]
    rows += [(2000 + k, near) for k in range(20)] + [(2000, near)] * 3  # copies and repeated rows
    # exactly one window, one byte less, periods, runs of one byte, a text that repeats itself
    rows += [(3000, near[:100]), (3001, near[:99]), (3002, "ab" * 400), (3003, "x" * 250), (3004, passages[3] + passages[3][:150]), (3005, "ü" * 120)]
    rows += [(None, None), (None, near), (3006, ""), (3007, None), (3008, "short")]
    return rows


@pytest.mark.parametrize("cell, shard", [(1 << 16, 1 << 21), (300, 3000)])
def test_against_all_strings(spark, monkeypatch, cell, shard):
    for name, value in (("CELL", cell), ("SHARD", shard)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rows = corpus(random.Random(8))
    assert run(spark, rows) == brute(rows)


def test_full_sieve_only_costs_work(spark):
    """With a bitmap of 64 bits everything passes, and nothing changes."""
    rows = corpus(random.Random(9))[:80]
    assert run(spark, rows, sieve_bits=6) == brute(rows)


def test_runs_hold_every_string_once(monkeypatch):
    texts = [t.encode() for _, t in corpus(random.Random(12)) if t]

    def strings():
        found = {}
        for r in suffix_dedup.runs(texts):
            for i in range(len(r.n)):
                data = bytes(r.stretch(i))
                assert data == texts[r.text[i]][r.lo[i] : r.lo[i] + len(data)]
                for k in range(r.n[i]):
                    found[int(r.text[i]), int(r.lo[i]) + k] = data[k : k + 100], int(r.anchor[i])
        return found

    whole = strings()
    monkeypatch.setattr(suffix_dedup, "PIECE", 1024)
    assert strings() == whole
    assert sorted(whole) == [(k, i) for k, t in enumerate(texts) for i in range(len(t) - 99)]
    by_string = {}
    assert all(by_string.setdefault(s, a) == a for s, a in whole.values())


def test_edges(spark):
    assert run(spark, []) == []
    rows = [(1, None), (1, ""), (2, "a" * 99)]
    assert run(spark, rows) == brute(rows)
    # a very long text that repeats itself over the edge of a piece
    rng = random.Random(10)
    head = prose(rng, 100_000)
    [row] = run(spark, [(1, head + head[5000:9000])])
    assert row[2:4] == (4000, 1) or row[2:4] == (len(head[5000:9000].encode()), 1)
