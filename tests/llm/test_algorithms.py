"""Seen keys, near duplicates, tokens and mixing against brute force on small inputs."""

import inspect
import itertools
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from webloom.llm import near_duplicates as nd
from webloom.llm import seen_keys, tokens
from webloom.llm.elias_fano import EliasFano


@pytest.mark.parametrize(("bits", "n"), [(20, 0), (20, 1), (12, 4096), (40, 3000), (53, 5000)])
def test_elias_fano(bits, n):
    rng = np.random.default_rng(n)
    v = np.unique(rng.integers(0, 1 << bits, n)).astype(np.uint64)
    e = EliasFano(v, bits)
    q = np.concatenate((v, rng.integers(0, 1 << bits, 500).astype(np.uint64)))
    assert (e.decode() == v).all()
    assert (e.successor_index(q) == np.searchsorted(v, q)).all()
    again = EliasFano.from_bytes(e.to_bytes())
    assert (again.contains(q) == np.isin(q, v)).all()
    new = np.setdiff1d(q, v)
    assert (again.merge(new).decode() == np.union1d(v, new)).all()


def test_merging_holds_codes_and_blocks_only():
    n = 1_500_000
    rng = np.random.default_rng(5)
    v = np.unique(rng.integers(0, 1 << 53, n).astype(np.uint64))
    e = EliasFano(v, 53)
    new = np.setdiff1d(np.unique(rng.integers(0, 1 << 53, n // 16).astype(np.uint64)), v)
    tracemalloc.start()
    both = e.merge(new)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert both.n == len(v) + len(new) and most / both.n < 20 and both.nbytes / both.n < 5
    assert (both.decode() == np.union1d(v, new)).all()
    with pytest.raises(ValueError):
        EliasFano.of_blocks(3, 20, [np.array([1, 2], np.uint64)])


def test_walk_cuts_a_long_batch():
    """Restored keys come as one batch, however many there are; what is held is cut, the answers stay."""
    rng = np.random.default_rng(6)
    h = np.sort(rng.integers(0, 1 << 40, 30_000))
    s = np.arange(len(h) + 9)
    cols = lambda g, h, s: pa.RecordBatch.from_arrays([pa.array(np.zeros(len(h), np.int32)), pa.array(h), pa.array(np.full(len(h), g, np.int32)), pa.array(s)], ["part", "h", "g", "seq"])
    probes = np.sort(np.concatenate((h[::7], rng.integers(0, 1 << 40, 3000))))
    want = {int(x) for x in np.setdiff1d(probes, h)}
    held = seen_keys._HELD
    try:
        seen_keys._HELD = 100
        batches = [cols(-1, h[k : k + 64], s[k : k + len(h[k : k + 64])]) for k in range(0, len(h), 64)] + [cols(0, probes[k : k + 50], s[k : k + len(probes[k : k + 50])]) for k in range(0, len(probes), 50)]
        got = [x for b in seen_keys._walk(1, (41,), "first")(iter(batches)) for x in b.column("h").to_pylist()]
        (counts,) = seen_keys._walk(1, (41, 20), "counts")(iter(batches))
    finally:
        seen_keys._HELD = held
    assert len(got) == len(want) and set(got) == want
    exact, rough = counts.column("found").to_pylist()
    assert exact == len(want) and rough == len(np.setdiff1d(probes >> 21, h >> 21))


def key(n):
    return f"{n:040x}"


def test_seen_before(spark):
    rng = random.Random(1)
    rows = [(s, key(0 if rng.random() < 0.3 else rng.randrange(400))) for s in range(1, 2000)]
    rows = [(s, {0: k.upper(), 1: f" {k}\n"}.get(s % 5, k)) for s, k in rows]
    rows += [(3000, None), (3001, ""), (3002, "abc"), (3003, key(5) + "0"), (None, key(9)), (3004, key(100_000)), (3004, key(100_000))]
    old = {key(n) for n in range(50)}
    seen, want = set(old), set()
    for s, k in sorted((r for r in rows if r[0] is not None and r[0] < 3000), key=lambda r: r[0]):
        k = k.strip().lower()
        if k in seen:
            want.add(s)
        seen.add(k)
    a = spark.createDataFrame(rows, "seq long, fingerprint string").withColumn("h", F.lit("clash")).repartition(5)
    s = spark.createDataFrame([(k,) for k in old] + [(None,)], "fingerprint string")
    assert {r.seq for r in seen_keys.seen_before(a, s).collect()} == want
    alone, once = set(), set()
    for q, k in sorted((r for r in rows if r[0] is not None and r[0] < 3000), key=lambda r: r[0]):
        (alone if k.strip().lower() in once else set()).add(q)
        once.add(k.strip().lower())
    assert {r.seq for r in seen_keys.seen_before(a, None, batches=3, part_bits=2).collect()} == alone
    assert seen_keys.seen_before(a.limit(0), s).count() == 0
    assert seen_keys.seen_before(a, s.limit(0)).count() > 0
    rates = {r.hash_bits: r for r in seen_keys.error_rates(a, s, (12, 63)).collect()}
    assert rates[63].wrong == 0 and rates[12].wrong > 0
    codes = seen_keys.filter_codes(s, part_bits=2).collect()
    assert sum(c.n for c in codes) == 50


def page(words):
    return ("<html><head><style>p{}</style></head><body><p>" + " ".join(words) + "</p><!-- x --><script>var a=1</script></body></html>").encode()


def brute(rows, limit):
    sets = {}
    for i, b in rows:
        if i is not None and b is not None and len(b) >= 100:
            w = nd.words_of_page(b)
            if len(w) >= 3:
                sets[i] = set(zip(w, w[1:], w[2:]))
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= limit}


def test_near_duplicates(spark):
    rng = random.Random(2)
    menu = [f"menu{i}" for i in range(30)]
    rows, n = [], 0
    for base in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 160))]
        for _ in range(1 + base % 4):
            w = list(words)
            for _ in range(rng.randrange(0, 12)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            rows.append((n, page(menu + w)))
            n += 1
    rows += [(n, rows[5][1]), (n + 1, rows[5][1]), (n + 2, None), (n + 3, b""), (n + 4, page(["a"])), (None, rows[5][1]), (n + 5, page(["same"] * 300)), (n + 6, page(["same"] * 500))]
    df = spark.createDataFrame(rows, "response_id long, body binary").withColumn("grams", F.lit(1)).repartition(4)
    want = brute(rows, 0.6)
    for how in ({"hot": 3}, {}):
        got = nd.near_duplicate_pages(df, 0.6, 100, **how)
        pairs = [(r.id_a, r.id_b) for r in got.pairs().collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == want
    m = {r.id: r for r in got.memberships().collect()}
    assert m[n].class_id == 5 and m[n].copies == 3
    assert nd.near_duplicate_pages(df.limit(0), 0.6, 100).pairs().count() == 0


def test_hot_bands_meet_in_blocks(spark):
    rng = random.Random(9)
    rows = [(i, 1) for i in range(70)] + [(i, 2) for i in range(60, 75)] + [(200, 3), (201, 4), (202, 4), (70, 1), (70, 5)]
    rows += [(i, 6 + rng.randrange(20)) for i in range(300, 360)]
    df = spark.createDataFrame(rows, "id long, band long")
    want = {(a, b) for a, x in rows for b, y in rows if x == y and a < b}
    for hot in (4, 7, 1000):
        got = [(r.a, r.b) for r in nd._meetings(df, hot).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert nd.table_bits(400) == 22 and nd.table_bits(3000) == 25 and nd.table_bits(0) == 22


def test_bands():
    b = nd.bands_for(0.6, 4, 0.99)
    assert 1 - (1 - 0.6**4) ** b >= 0.99 > 1 - (1 - 0.6**4) ** (b - 1)


def test_weakest_pairs_meet_at_the_target_recall():
    how = {k: p.default for k, p in inspect.signature(nd.NearDuplicates.__init__).parameters.items() if k in ("recall", "rare_share", "rare_rows", "full_rows")}
    assert how["recall"] >= 0.999
    rng = np.random.default_rng(8)
    for family, (weakest, (bands, rows)) in enumerate(zip((0.5, 0.6), nd.families(0.6, **how))):
        assert 1 - (1 - weakest**rows) ** bands >= 0.999
        a, b = nd._coefficients(bands * rows, 11 + 2 * family)
        lost = 0
        for _ in range(1000):
            g = np.unique(rng.integers(0, 2**32, 150, dtype=np.uint64).astype(np.uint32))
            alone = round(len(g) * (1 - weakest) / 2)
            x, y = (nd._band_keys(nd._minima(s, a, b), rows, family) for s in (g[alone:], g[: len(g) - alone]))
            lost += not (x == y).any()
        assert lost <= 6  # 1 expected, 50 at a recall of 0.95


TEXTS = ["", None, "  ", "Hello, world's  end!\n\n  x", "é日本語 ½ <|endoftext|>", "a" * 5000, "it's 'tis 12345 \t\r\n ", "🙂🙂 zero​width", "Hello, world's  end!\n\n  x"]


@pytest.mark.parametrize("name", tokens.BYTE_LEVEL)
def test_ids(spark, name):
    df = spark.createDataFrame([(i if i < 8 else 3, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").withColumn("chunk", F.lit(1)).withColumn("word", F.lit("x"))
    got = tokens.encode(df, name, chunk_bytes=40).collect()
    enc = tokens._encoder(tokens.rank_file(name, tokens.TOKENIZER_DIR))
    assert sorted((r.doc_id, list(r.ids)) for r in got) == sorted((i if i < 8 else 3, enc.encode_ordinary(t or "")) for i, t in enumerate(TEXTS))
    back = tokens.decode(spark.createDataFrame(got), name).collect()
    assert sorted((r.doc_id, r.text) for r in back) == sorted((i if i < 8 else 3, t or "") for i, t in enumerate(TEXTS))
    assert tokens.encode(df.limit(0), name).count() == 0


def test_unknown_tokenizer_and_id(spark):
    with pytest.raises(ValueError):
        tokens.rank_file("piece_bpe_32k", tokens.TOKENIZER_DIR)
    with pytest.raises(Exception, match="no piece"):
        tokens.decode(spark.createDataFrame([(1, [60_000])], "doc_id long, ids array<int>")).collect()


def test_mixture_reaches_shares(spark):
    rng = random.Random(3)
    docs = [(i, rng.choice(["A-x", "a_x ", "b", None, "c"]), " ".join(["w"] * rng.randrange(1, 60))) for i in range(3000)] + [(9000, "b", None), (9001, "b", ""), (9002, "a_x", "dup"), (9002, "a_x", "dup")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("tokens", F.lit(7))
    t = spark.createDataFrame([("a_x", 0.5, 1), ("b", 0.5, 3), ("gone", 0.0, 2)], "source string, target_share double, max_repeats int")
    shares = {r.source: r for r in tokens.mixture_shares(df, t).collect()}
    assert abs(shares["a_x"].reached_share - 0.5) < 0.005 and abs(shares["b"].reached_share - 0.5) < 0.005
    assert shares["a_x"].most_copies == 1 and shares["b"].most_copies <= 3 and shares["gone"].used_tokens == 0
    use = tokens.mixture(df, t).collect()
    assert sum(r.tokens * r.copies for r in use if r.source == "b") == shares["b"].used_tokens
    half = {(r.doc_id, r.source): r.copies for r in tokens.mixture(df, t, total=shares["b"].used_tokens).collect()}
    full = {(r.doc_id, r.source): r.copies for r in use}
    assert all(full.get(k, 0) >= c for k, c in half.items())  # a larger total only adds
    assert tokens.mixture(df.limit(0), t).count() == 0
    assert tokens.mixture(df, t.limit(0)).count() == 0
