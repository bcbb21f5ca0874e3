"""Each training-data operator against a brute-force version, and on nulls, empty texts, ties, repeated rows and empty tables."""

import hashlib
import math
import random
import time
import zlib
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from folioloom.llm import common, cutting_stock, exact_dedup, graph, html_text, line_dedup, ngram_join, packing, rank_bpe, spotsigs, token_count, toxicity, url_filter  # noqa: E402

RNG = random.Random(11)
WORDS = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(3, 8))) for _ in range(400)]
DOCS = "doc_id long, text string, lang string, node string, h string"


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(text, k, rng=RNG):
    words = text.split(" ")
    for _ in range(k):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


def docs(spark, texts):
    """With extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "x", "y") for i, t in texts], DOCS)


def edge_docs(spark):
    return docs(spark, [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (5, "one "), (None, "one"), (7, "\n\n"), (8, "tie tie tie tie tie tie")])


def components(nodes, edges):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + k, 101 + k) for k in range(20)] + [(None, 3), (5, 5)]
    got = {r["node"]: r["root"] for r in graph.connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == components({x for e in real for x in e}, real)
    assert graph.connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_cuckoo_index_against_a_dict():
    rng, index, model = random.Random(2), exact_dedup.CuckooIndex(buckets=2), {}
    keys = [hashlib.sha256(str(k).encode()).digest() for k in range(3000)]
    for step in range(12000):
        k = rng.choice(keys)
        if rng.random() < 0.6:
            index.put(k, step)
            model[k] = step
        else:
            assert index.delete(k) == (model.pop(k, None) is not None)
    assert dict(index.items()) == model and index.live == len(model) and index.resizes
    assert all(index.get(k) == model.get(k) for k in keys)


def test_exact_dedup(spark):
    texts = [(k, prose(5)) for k in range(30)] + [(100 + k, "a b\tc" + " " * (k % 3)) for k in range(50)]
    rows = docs(spark, texts)
    by = {}
    for i, t in texts:
        by.setdefault("".join(t.split()), []).append((-len(t), i))
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(rows).collect()}
    assert got == {i: (min(g)[1], len(g), min(g)[1] == i) for g in by.values() for _, i in g}
    edge = exact_dedup.exact_dedup(edge_docs(spark)).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in edge if r["doc_id"] in (1, 2, 3, 7)) == Counter({(i, 3, 4): 1 for i in (1, 2, 3, 7)})
    assert {(r["doc_id"], r["keep_id"]) for r in edge if r["group_size"] == 4 and r["doc_id"] not in (1, 2, 3, 7)} == {(4, 5), (5, 5), (None, 5)}
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def test_index_updates(spark):
    a, b, c = (hashlib.sha256(x).hexdigest() for x in (b"a", b"b", b"c"))
    index = spark.createDataFrame([(a, 2), (b, 1)], "digest string, copies long")
    changes = spark.createDataFrame([(1, "delete", a), (2, "delete", b), (3, "insert", b), (4, "delete", c), (5, "insert", c), (6, "insert", None)], "seq long, op string, digest string")
    assert {r["digest"]: r["copies"] for r in exact_dedup.update_index(index, changes).collect()} == {a: 1, b: 1, c: 1}


def brute_join(texts):
    sets = {i: set(ngram_join.shingle_hashes(t or "").tolist()) for i, t in texts}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    n = Counter(x for e in links for x in e)
    return {i: (root, n[i]) for i, root in components(sets, links).items()}


@pytest.mark.parametrize("block", [256, 8])
def test_ngram_join(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(4)
    base = [prose(120, rng) for _ in range(12)]
    texts = [(k, base[k % 12]) for k in range(24)] + [(100 + k, edited(base[k % 4], rng.randint(1, 5), rng)) for k in range(60)] + [(300, None), (301, ""), (302, "a b"), (303, "A  b!")]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.ngram_join(docs(spark, texts)).collect()}
    assert got == brute_join(texts)


def test_ngram_join_many_repeats(spark):
    """Repeated rows and null ids with one text cost no square: 5,000 copies of a text beside a near copy."""
    text = prose(300)
    near = text + " tail"
    rows = [(1, text)] * 2500 + [(None, text)] * 2500 + [(2, near)]
    began = time.monotonic()
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.ngram_join(docs(spark, rows)).collect())
    assert got == {(1, 1, 5000): 2500, (None, 1, 5000): 2500, (2, 1, 5000): 1}
    assert time.monotonic() - began < 60


def test_ngram_join_edges(spark):
    rows = ngram_join.ngram_join(edge_docs(spark)).collect()
    assert len(rows) == 9 and {(r["class_id"], r["n_links"]) for r in rows if r["doc_id"] == 4} == {(4, 3)}
    assert {(r["class_id"], r["n_links"]) for r in rows if r["doc_id"] in (1, 2, 3, 7)} == {(i, 0) for i in (1, 2, 3, 7)}
    assert ngram_join.ngram_join(docs(spark, [])).count() == 0


def test_keep_one(spark):
    rng = random.Random(41)
    a, b, c, d = (prose(60, rng) for _ in range(4))
    rows = [(1, a), (2, a), (2, b), (5, b + " more"), (7, a + " x"), (3, c), (3, d), (4, None), (4, None), (6, ""), (8, "!"), (8, "!"), (9, prose(9, rng)), (9, prose(9, rng)), (None, d), (None, "lone words of a row without an id"), (3, c)]
    table = docs(spark, rows).withColumnsRenamed({"node": "root", "h": "mark"})
    got = sorted(((r["doc_id"], r["text"]) for r in ngram_join.keep_one(table).collect()), key=str)
    gone = [(2, a), (5, b + " more"), (7, a + " x"), (None, d), (3, c)]
    want = list(rows)
    for r in gone:
        want.remove(r)
    assert got == sorted(want, key=str) and ngram_join.keep_one(table).columns == table.columns
    assert ngram_join.keep_one(docs(spark, [])).count() == 0
    # rows with a null id have links too
    joined = {(r["doc_id"], r["n_links"]): r["class_id"] for r in ngram_join.ngram_join(docs(spark, [(None, a), (None, a + " x"), (None, b)])).collect()}
    assert joined == {(None, 1): None, (None, 0): None}


def test_pruning_keeps_what_reaches_the_threshold():
    for n in (20, 60, 140):
        m = ngram_join.least_matches(n)
        below = sum(math.comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(m))
        assert below < 1e-5 and m > 0.3 * n


def test_bpe(spark):
    tiktoken = pytest.importorskip("tiktoken")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    bpe = rank_bpe.load(path, public_tokenizers.PATTERN)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    rng = random.Random(5)
    parts = ["a", "b", "é", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "'s", "'", ".", "1", "中", "🙂", "　", "the", "<|endoftext|>", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 90))) for _ in range(400)] + ["ab" * 20000, "a" * 5000]
    for t in texts:
        ids = bpe.encode(t)
        assert list(memoryview(ids).cast("I")) == own.encode_ordinary(t) and bpe.decode(ids) == t.encode()
    rows = {r["doc_id"]: r for r in rank_bpe.bpe_round_trip(edge_docs(spark), path, public_tokenizers.PATTERN, with_ids=True).where("doc_id < 4").collect()}
    assert rows[1]["n_tokens"] == 0 and rows[1]["decoded_sha256"] == hashlib.sha256(b"").hexdigest() and rows[3]["ids"] == own.encode_ordinary(" \t\n")


def token_counts_of(spark, path, texts):
    return token_count.token_counts(docs(spark, list(enumerate(texts))), path).orderBy("doc_id").collect()


def test_token_counts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    counter, rng = token_count.Counter(path, chunk=40, overlap=36), random.Random(6)
    parts = ["a", "word", "é", " ", "  ", "\n", "'s", "'", ".", "1", "中", "<|endoftext|>", "x" * 30, "1" * 50]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 150))) for _ in range(400)]
    assert counter.count_many(texts) == counter._library(texts) and counter.widened
    # with the registered chunks, texts of single spaces and of others, long ones among them
    counter = token_count.Counter(path)
    texts = [sep.join(prose(rng.randint(1, 40), rng) + rng.choice(["", ".", ",", "é", "<|endoftext|>"]) for _ in range(rng.randint(1, 120))) for sep in (" ", ". ", "\n", "  ", "") for _ in range(12)]
    assert sum(len(t) > token_count.CHUNK for t in texts) > 20 and counter.count_many(texts) == counter._library(texts)
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_count.token_counts(edge_docs(spark), path).where("doc_id in (1, 2, 8)").collect()}
    assert got[1] == got[2] == (0, 0) and got[8][0] == 23
    over = token_counts_of(spark, path, ["word " * 1024, "word " * 1025, "a" * 3000])
    assert [r["over_limit"] for r in over] == [r["n_tokens"] > 1024 for r in over] and {r["over_limit"] for r in over} == {True, False}
    assert token_count.token_counts(docs(spark, []), path).count() == 0


def test_cutting_stock(monkeypatch):
    demand = {600: 30, 700: 20, 1000: 11, 1448: 25, 3: 7}
    priced, price = [], cutting_stock.best_pattern
    monkeypatch.setattr(cutting_stock, "best_pattern", lambda *a: priced.append(price(*a)) or priced[-1])
    found = cutting_stock.solve(demand, 2048, cutting_stock.plain_basis)
    made = Counter()
    for pattern, n in found:
        assert sum(x * k for x, k in pattern.items()) <= 2048
        made.update({x: k * n for x, k in pattern.items()})
    assert all(abs(made[x] - n) < 1e-6 for x, n in demand.items())
    # prices 1 for 1448, 0.5 for 1000 and 700, and 0 else give no pattern more than 1, so the optimum is 25 + 5.5 + 10
    plain = sum(n / (2048 // x) for x, n in demand.items())
    assert len(priced) > 1 and sum(n for _, n in found) <= 41 < plain
    # the patterns in use are ones that pricing made
    assert any(len(pattern) > 1 for pattern, _ in found)


def test_whole_patterns_hold_every_piece_once():
    rng = random.Random(31)
    for size in (1, 7, 60, 400):
        demand = Counter(rng.randint(1, 2047) for _ in range(size))
        found = cutting_stock.whole_patterns(demand, 2048)
        made, tokens = Counter(), sum(x * n for x, n in demand.items())
        for pattern, n in found:
            assert n > 0 and sum(x * k for x, k in pattern.items()) <= 2048
            made.update({x: k * n for x, k in pattern.items()})
        assert made == demand
        total, kept = sum(n for _, n in found), cutting_stock.dissolve(found, 2048)
        held = sum(n * sum(x * k for x, k in p.items()) for p, n in kept)
        # what is dissolved fills the others, and no more is dissolved than that takes
        free = sum(n for _, n in kept) * 2048 - held
        assert free <= tokens - held < free + 2048 + 2048 * (total == 1) and total <= 1.2 * tokens / 2048 + 2
    alike = cutting_stock.whole_patterns({1500: 100}, 2048)
    assert sum(n for _, n in alike) == 100 and sum(n for _, n in cutting_stock.dissolve(alike, 2048)) == 73


def test_encoder_agrees_with_the_library():
    from tokenizers import Tokenizer

    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(32)
    encoder, library = packing.Encoder(path), Tokenizer.from_file(path)
    parts = ["a", "Word", "É", "ÿ", "Ÿ", "ß", "ẞ", "İ", "Σ", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "'s", "'S", "'", "'ll", ".", "!?", "1", "٣", "中", "🙂", "e\u0301", "µ", "ª", "×", "÷", "½", "ﬁ", "\x00", "don't", "I'M", "x" * 450]
    special = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|STARTOFTEXT|>", "<|", "|>"]
    texts = ["".join(rng.choice(parts + special) for _ in range(rng.randint(0, 12))) for _ in range(1500)] + ["see <|ENDOFTEXT|> here", "a <|EndOfText|> b", "X<|STARTOFTEXT|>Y"]
    texts += ["".join(rng.choice("etaoinshrdlucmfwypvbgkqjxz'-.,") for _ in range(rng.randint(1, 18))) for _ in range(3000)]
    for t, ids in zip(texts, encoder.encode_many(texts), strict=True):
        assert list(memoryview(ids).cast("I")) == library.encode(t, add_special_tokens=False).ids, t
    assert encoder._merge is not None
    # a memo that is emptied again and again, and a tokenizer that isn't known, give the same ids
    small, plain = packing.Encoder(path), packing.Encoder(path)
    small._held = small._held_words = packing.MEMO
    plain._merge = None
    assert small.encode_many(texts) == plain.encode_many(texts) == encoder.encode_many(texts)


def test_packing(spark):
    from tokenizers import Tokenizer

    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(8)
    texts = [(k, prose(rng.choice([1, 10, 60, 60, 300, 900]), rng)) for k in range(120)] + [(200, None), (201, ""), (202, "A <|endoftext|> É\n b"), (203, "A <|ENDOFTEXT|>"), (204, prose(9000, rng))]
    rows = packing.pack(docs(spark, texts), path).collect()
    library, ids = Tokenizer.from_file(path), {}
    for i, t in texts:
        ids[i] = [*library.encode(t or "", add_special_tokens=False).ids, 1]
    seen, sequences = Counter(), {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == seen[r["doc_id"]] and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in piece))
        seen[r["doc_id"]] += r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert seen == {i: len(x) for i, x in ids.items()}
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at == 2048 or at & (at - 1) == 0
    assert packing.pack(docs(spark, []), path).count() == 0
    # null ids and repeated rows are packed each
    edge = packing.pack(edge_docs(spark), path).collect()
    held = Counter()
    for r in edge:
        held[r["doc_id"]] += r["length"]
    assert held == {1: 1, 2: 1, 3: 1, 4: 4, 5: 2, None: 2, 7: 1, 8: 7}


def test_toxicity(spark):
    rng = random.Random(9)
    texts = [(k, prose(40, rng) + (" scum clown" if k % 6 == 0 else "")) for k in range(600)]
    labels = spark.createDataFrame([(k, int(k % 6 == 0)) for k in range(400)] + [(None, 1)], "doc_id long, toxic int")
    d = docs(spark, texts)
    model = toxicity.train(d, labels)
    got = toxicity.toxicity(d, model).collect()
    assert sum(r["predicted"] == (r["doc_id"] % 6 == 0) for r in got) > 590
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    empty = toxicity.toxicity(edge_docs(spark), model).collect()
    assert len({r["score"] for r in empty if r["doc_id"] in (1, 2, 3, 7)}) == 1 and all(0 <= r["score"] <= 1 for r in empty)
    assert toxicity.reject_toxic(d, model).count() > 490
    nothing = toxicity.train(d, labels.where("toxic = 0"))
    assert {r["predicted"] for r in toxicity.toxicity(edge_docs(spark), nothing).collect()} == {0}


def test_spotsigs(spark):
    texts = [(3 * k, ("the " + prose(6) + " of " + prose(4)) * (k % 4)) for k in range(50)]
    got = {r["doc_id"]: r for r in spotsigs.fingerprints(docs(spark, texts)).collect()}
    order = sorted(texts, reverse=True)
    for k, (i, t) in enumerate(order):
        other, half = order[(k + 1) % len(order)][1], len(t) // 2
        e = t[: len(t) - half] + other[:half]
        r = got[i]
        assert r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest() and r["n_chars"] == len(t)
        assert r["fingerprint"] == spotsigs.as_text(spotsigs.spots(t)) and r["edited_fingerprint"] == spotsigs.as_text(spotsigs.spots(e))
        a, b = set(spotsigs.spots(t).tolist()), set(spotsigs.spots(other).tolist())
        assert abs(r["near_next"] - len(a & b) / len(a | b)) < 1e-12
    assert spotsigs.fingerprints(edge_docs(spark)).count() == 9 and spotsigs.fingerprints(docs(spark, [])).count() == 0


def test_similar_fingerprints(spark):
    rng = random.Random(10)
    base = [" the ".join(prose(3, rng) for _ in range(30)) for _ in range(5)]
    texts = [(k, edited(base[k % 5], k // 5, rng)) for k in range(40)] + [(50, base[0]), (51, "")]
    pairs, members = spotsigs.similar_fingerprints(docs(spark, texts))
    node = {r["doc_id"]: r["node"] for r in members.collect()}
    sets = {node[i]: set(spotsigs.spots(t).tolist()) for i, t in texts}
    want = {frozenset(p) for p in combinations(sets, 2) if len(sets[p[0]] & sets[p[1]]) >= 0.8 * len(sets[p[0]] | sets[p[1]])}
    assert {frozenset((r["a"], r["b"])) for r in pairs.collect()} == want and node[50] == node[0]


def brute_ratio(good, bad, name):
    def model(names):
        grams = Counter()
        for n in names:
            s = url_filter.START * 4 + n + url_filter.END
            for i in range(4, len(s)):
                for k in range(1, 6):
                    grams[s[i + 1 - k : i + 1]] += 1

        def p(window):
            if not window:
                return 1 / url_filter.ALPHABET
            seen = {g: c for g, c in grams.items() if len(g) == len(window) and g[:-1] == window[:-1]}
            below = p(window[1:])
            return below if not seen else (seen.get(window, 0) + len(seen) * below) / (sum(seen.values()) + len(seen))

        return p

    a, b = model(good), model(bad)
    s = url_filter.START * 4 + name + url_filter.END
    windows = [s[i - 4 : i + 1] for i in range(4, len(s))]
    return sum(math.log(a(w)) - math.log(b(w)) for w in windows) / len(windows)


def test_url_filter(spark):
    urls = ["http://WWW.a.com/x?q", "http://x.net/es/spam", "https://b.com/y/", "http://b.net/fr/pills#t", "http://c.org/spam/pills", "ftp://c.org/y", None, "no scheme", "http://www.example.com/en/1", "http://m.example.com/en/1", "http://com"]
    p = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.url_verdicts(p).collect()}
    assert [got[k]["rule"] for k in range(11)] == ["com/", "net/es/", "com/", "net/fr/", None, None, None, None, "www.example.com/en/", "example.com/en/", None]
    assert [got[k]["verdict"] for k in (0, 1, 2, 3, 8, 9)] == ["allow", "block", "allow", "block", "allow", "block"]
    assert (got[0]["host"], got[0]["path"], got[6]["host"], got[7]["path"], got[10]["host"]) == ("www.a.com", "/x", "", "", "com")
    good, bad = [got[k]["host"] + got[k]["path"] for k in (0, 2, 8)], [got[k]["host"] + got[k]["path"] for k in (1, 3, 9)]
    for k in (4, 5, 6, 10):
        assert abs(got[k]["score"] - brute_ratio(good, bad, got[k]["host"] + got[k]["path"])) < 1e-9
    assert url_filter.url_verdicts(p.limit(0)).count() == 0


PAGE = """<html><head><title>t</title><script>var a="<p>x</p>";</script></head><body class="has-sidebar"><header>Site</header><nav><ul><li>A</li></ul></nav>
<div class="ad"><div>buy</div> now</div><article><header><h1>Head&amp;line</h1></header><p>One  <b>two</b><br>three<p>Four &lt;five&gt; <form>f</form>
<div id="comments"><p>first!</p></div></article><aside>s</aside><footer>f</footer></body></html>"""


def test_html_blocks():
    assert [b for b in html_text.blocks(PAGE) if b[1]] == [("Head&line", 1), ("One two three", 1), ("Four <five>", 1)]
    assert [t for t, zone in html_text.blocks(PAGE) if not zone] == ["Site", "A", "buy", "now", "f", "first!", "s", "f"]
    assert html_text.blocks("") == [] and html_text.blocks("a < b <p>c<!-- d") == [("a < b", 2), ("c", 2)]


@pytest.mark.parametrize(
    "page, want",
    [
        ('<article><p class="notice">Hi<p>Main text</article>', ["Main text"]),
        ('<ul><li class="ad">x<li>real item</ul><p>Main</p>', ["real item", "Main"]),
        ('<table><tr><td class="ad">x<td>y<tr><td>z</table>w', ["y", "z", "w"]),
        ('<dl><dt>a<dd class="promo">b<dt>c</dl>', ["a", "c"]),
        ("<div class=ad><p>a<div>b</div></div>c", ["c"]),
        ("<head><title>t</title><body>x", ["x"]),
        ('<p><span class="ad">x</span>y</p></div>z', ["y", "z"]),
        ("<div><article>a</div>b", ["a"]),
    ],
)
def test_html_end_tags_may_be_left_out(page, want):
    found = html_text.blocks(page)
    mine = html_text.CORE if any(zone == html_text.CORE for _, zone in found) else html_text.PLAIN
    assert [t for t, zone in found if zone == mine] == want


def test_longest_common_subsequence():
    rng = random.Random(12)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randint(0, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = html_text.shared_lines(a, b)
        assert len(got) == best[-1][-1] and all(a[i] == b[j] for i, j in got) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
    assert len(html_text.shared_lines([1] * 20_000, [2] + [1] * 20_000)) == 20_000


def test_main_text(spark):
    bare = "<body><p>menu</p><p>{}</p><p>legal</p></body>"
    rows = [(1, "http://h/a/1", bare.format("one")), (2, "http://h/a/2", bare.format("two")), (3, "http://h/b", "<article><p>two</p></article>"), (4, "http://g/a/1", bare.format("one")), (5, None, None), (6, "http://h/a/1", bare.format("one"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.main_text(pages).collect()}
    # pages 1 and 6 are equal, so both are paired with page 2
    assert got == {1: ("one", 3), 6: ("one", 3), 2: ("two", 3), 3: ("two", 3), 4: ("menu\none\nlegal", 14), 5: ("", 0)}
    assert html_text.main_text(pages.limit(0)).count() == 0


def brute_pages(rows):
    """Pairs by comparing all pages of a host; alignment by the table of all lengths, from the end of both pages."""
    out = {}
    for i, url, page in rows:
        host, path = url.split("://")[1].split("/", 1)
        same = sorted((u.split("/", 3)[3], k, p) for k, u, p in rows if u.split("/")[2] == host)
        at = [k for _, k, _ in same].index(i)

        def near(k, path=path, same=same):
            if not 0 <= k < len(same):
                return -1
            x, y = path.split("/"), same[k][0].split("/")
            return next((n for n, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))

        pair = max((at - 1, at + 1), key=near)
        mine = html_text.blocks(page)
        article = any(z == 1 for _, z in mine)
        drop = set()
        if near(pair) >= 0:
            other = html_text.blocks(same[pair][2])
            around, theirs = {t for t, z in mine if z != (1 if article else 2)}, 1 if any(z == 1 for _, z in other) else 2
            best = [[0] * (len(other) + 1) for _ in range(len(mine) + 1)]
            for a in range(len(mine) - 1, -1, -1):
                for b in range(len(other) - 1, -1, -1):
                    best[a][b] = 1 + best[a + 1][b + 1] if mine[a][0] == other[b][0] else max(best[a + 1][b], best[a][b + 1])
            a = b = 0
            while a < len(mine) and b < len(other):
                if mine[a][0] == other[b][0]:
                    if not (article and mine[a][1] == 1 and (other[b][1] == theirs or mine[a][0] not in around)):
                        drop.add(a)
                    a, b = a + 1, b + 1
                elif best[a + 1][b] >= best[a][b + 1]:
                    a += 1
                else:
                    b += 1
        own = {k for k, (_, z) in enumerate(mine) if z == (1 if article else 2)}
        out[i] = "\n".join(t for k, (t, _) in enumerate(mine) if k in own - drop), len(own & drop)
    return out


def test_main_text_against_brute_force(spark):
    rng = random.Random(33)
    menu = [f"menu {k}" for k in range(8)]
    rows = []
    for k in range(60):
        nav = "".join(f"<li>{x}" for x in sorted(rng.sample(menu, 4)))
        body = "".join(f"<p>{t}" for t in [f"own {k}", *sorted(rng.sample([f"told {j}" for j in range(4)], 2)), f"end {k}"])
        inner = f"<article>{body}<p>subscribe now</article><div class=ad>subscribe now</div>" if k % 3 else f"{body}<p>site line"
        rows.append((k, f"http://h{k % 2}.org/{rng.choice('ab')}/{rng.choice('xyz')}/{k}", f"<body><nav><ul>{nav}</ul></nav>{inner}"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("row", F.lit("x")).withColumn("text", F.lit(1))
    got = {r["page_id"]: (r["text"], r["n_deleted"]) for r in html_text.main_text(pages).collect()}
    want = brute_pages(rows)
    assert got == want
    # the differencing decides: some pages lose lines that structure alone would have kept, and none an article's own
    alone = {i: "\n".join(t for t, z in html_text.blocks(p) if z == max(z for _, z in html_text.blocks(p) if z < 2 or k % 3 == 0)) for k, (i, _, p) in enumerate(rows)}
    assert sum(got[i][0] != alone[i] for i in got) > 10
    assert all(len(alone[i].split("\n")) - len(t.split("\n")) == n for i, (t, n) in got.items())
    assert all(f"own {i}" in t and f"end {i}" in t for i, (t, _) in got.items())


def brute_lines(texts):
    lines = {(i, k): x.strip(" ") for i, t in texts for k, x in enumerate((t or "").split("\n")) if x.strip(" ")}
    n = line_dedup.SHINGLE
    sets = {at: {x[j : j + n] for j in range(max(1, len(x) - n + 1))} for at, x in lines.items()}
    root = components(lines, [(a, b) for a, b in combinations(lines, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9])
    out = {i: [] for i, _ in texts}
    for at, r in root.items():
        if at != r:
            out[at[0]].append(at[1])
    return {i: sorted(x) for i, x in out.items()}


def test_line_dedup(spark):
    rng = random.Random(13)
    base = [prose(40, rng) for _ in range(6)]
    texts = [(k, "\n".join([edited(rng.choice(base), rng.choice([0, 0, 1, 1, 2]), rng), "", " short ", prose(20, rng), "é" * (k % 4)])) for k in range(30)] + [(40, None), (41, "")]
    d = docs(spark, texts)
    want = brute_lines(texts)
    got = {r["doc_id"]: r["removed"] for r in line_dedup.line_dedup_report(d).collect()}
    assert got == want
    cut = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(d).collect()}
    assert all(cut[i] == (t and "\n".join(x for k, x in enumerate(t.split("\n")) if k not in got[i])) for i, t in texts)
    edge = line_dedup.line_dedup_report(edge_docs(spark)).collect()
    assert len(edge) == 9 and all(r["n_removed"] == 0 for r in edge if r["doc_id"] in (None, 1, 2, 3, 4, 7)) and [r["n_removed"] for r in edge if r["doc_id"] == 5] == [1]
    assert line_dedup.line_dedup_report(docs(spark, [])).count() == 0


def report_of(spark, lines):
    texts = list(enumerate(lines))
    return {r["doc_id"]: r["removed"] for r in line_dedup.line_dedup_report(docs(spark, texts)).collect()}, brute_lines(texts)


def test_line_dedup_signs_all_lines_alike(spark):
    rng, letters = random.Random(21), "abcdefghijklmnopqrstuvwxyz"
    base = [" ".join("".join(rng.choice(letters) for _ in range(n)) for n in (24, 23, 23, 23, 23)) for _ in range(100)]
    got, want = report_of(spark, [y for x in base for y in (x, x + ".")])
    assert got == want and sum(map(len, got.values())) == 100


def test_line_dedup_short_lines_with_another_end(spark):
    rng, letters = random.Random(22), "abcdefghijklmnopqrstuvwxyz"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n)).capitalize()
    base = [f"{word(rng.randint(5, 9))} {word(rng.randint(5, 9))}" for _ in range(250)]
    got, want = report_of(spark, [f"{x} {y}" for x in base for y in (2012, 2017)])
    assert sum(map(len, want.values())) > 100 and got == want


def test_line_dedup_compares_whole_bands(spark):
    rng, letters = random.Random(23), "abcdefghijklmnopqrstuvwxyz"
    hosts = sorted({"".join(rng.choice(letters) for _ in range(4)) for _ in range(180)})
    got, want = report_of(spark, [f"https://www.{x}.io/p{k}" for x in hosts for k in (1, 2)])
    assert sum(map(len, want.values())) > 100 and got == want


def test_line_dedup_finishes_hot_bands(spark):
    """All lines in one band, dealt into blocks; no line is linked before."""
    rng = random.Random(24)
    lines = [prose(8, rng) for _ in range(100)]
    lines += [x + "!" for x in lines]
    found = spark.createDataFrame(list(enumerate(lines)), "h long, line string")
    none = spark.createDataFrame([], "node long, root long")
    got = line_dedup._rest(found.select(F.lit(7).cast("long").alias("key"), "h"), none, found).collect()
    assert sorted((r["a"], r["b"]) if r["a"] < r["b"] else (r["b"], r["a"]) for r in got) == [(k, 100 + k) for k in range(100)]


def test_line_dedup_long_lines_and_clashing_columns(spark):
    rng = random.Random(25)
    long = " ".join(prose(9, rng) for _ in range(900))
    texts = [(1, long), (2, "x\n" + long[:-3]), (3, long[: len(long) // 2]), (3, long[: len(long) // 2]), (None, long)]
    d = docs(spark, texts).withColumnsRenamed({"lang": "line", "node": "mark", "h": "removed"})
    got = [(r["doc_id"], r["removed"]) for r in line_dedup.line_dedup_report(d).collect()]
    assert sorted(got, key=str) == sorted([(1, []), (2, [1]), (3, []), (3, []), (None, [])], key=str)
    assert line_dedup.line_dedup(d).columns == d.columns and {r["text"] for r in line_dedup.line_dedup(d).where("doc_id = 2").collect()} == {"x"}


def test_bands_are_an_affine_plane():
    assert len(line_dedup.BANDS) == 20 and all(len(set(b)) == 4 for b in line_dedup.BANDS)
    assert Counter(p for b in line_dedup.BANDS for p in combinations(sorted(b), 2)) == dict.fromkeys(combinations(range(16), 2), 1)


def test_lookup_splits_heavy_keys(spark):
    rows = spark.range(100).select((F.col("id") % 7).alias("k"), "id")
    table = spark.createDataFrame([(0, 15, "a"), (1, 15, "b"), (9, 1, "c")], "k long, n long, v string")
    got = common.lookup(rows, table, "k", "n", 100)
    assert got.count() == 100 and got.where("v is not null").count() == 30


PIPED = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline(spark, tmp_path):
    """Every stage and the whole against brute force: toxic words, lines, near copies, and the tokens packed."""
    import corpus_pipeline as cp
    from tokenizers import Tokenizer

    rng = random.Random(14)
    clean = [prose(60, rng) for _ in range(120)]
    texts = [(k, clean[k] + "\nshared footer line of this corpus") for k in range(120)] + [(1000 + k, prose(40, rng) + " scum clown moron") for k in range(30)]
    texts += [(2000, "\n".join(" ".join(clean[0].split()[k : k + 15]) for k in range(0, 60, 15))), (2001, clean[5]), (2002, None), (2003, ""), (2004, "\n \n"), (5, texts[5][1]), (6, "another text with the id of an older one")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], PIPED).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(1000 <= i < 2000)) for i in {i for i, _ in texts}], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    def piece(df):
        return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)

    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = common.settle(cp.drop_toxic(spark, read, str(tmp_path)), "t")
    safe = [(i, t) for i, t in texts if not 1000 <= i < 2000]
    assert piece(kept) == sorted(safe, key=str)
    cut = common.settle(cp.drop_lines(spark, kept, str(tmp_path)), "l")
    # the shared line stays with document 0 alone; what 2001 says stands in 5; repeated rows lose the same lines
    lined = [(i, t if i in (0, 2000, 2002, 2003, 2004) or t.startswith("another") else t.split("\n")[0]) for i, t in safe if i != 2001]
    assert piece(cut) == sorted(lined, key=str) and all(r["n_chars"] == (r["text"] and len(r["text"]) or r["text"] and 0) or not r["text"] for r in cut.collect())
    one = common.settle(cp.drop_near_copies(spark, cut, str(tmp_path)), "n")
    left = list(lined)
    left.remove((2000, texts[150][1]))
    left.remove((5, clean[5]))
    assert piece(one) == sorted(left, key=str)
    library, ids = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for i, t in left:
        ids[i] += len(library.encode(t or "", add_special_tokens=False).ids) + 1
    for rows in (cp.pack(spark, one, str(tmp_path)), cp.run(spark, str(tmp_path))):
        held = Counter()
        for r in rows.collect():
            held[r["doc_id"]] += r["length"]
        assert held == ids
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "ngram_join", "packing"]


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline as cp

    spark.createDataFrame([], PIPED).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
