"""Near copies of the pipeline against brute force over five-word shingles."""

import random

import numpy as np

from quarry.llm import copies, kernels, pivots, simhash


def sets(text, width=5):
    w = (text or "").lower().split()
    return frozenset(" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def alike(a, b):
    return not a and not b or len(a & b) >= 0.8 * len(a | b)


def test_planted_near_copies_go(spark):
    rng = random.Random(9)
    word = lambda: f"w{rng.randint(0, 5000)}"
    texts = []
    for n in (60, 300, 300, 1200):
        base = [word() for _ in range(n)]
        texts.append(" ".join(base))
        for share in (0.005, 0.01, 0.02, 0.05):  # of the words another; the last is no near copy
            copy = list(base)
            for i in rng.sample(range(n), max(1, int(n * share))):
                copy[i] = word()
            texts.append(" ".join(copy))
    texts += [texts[0].upper(), "a b c d", "A  b c d", "a b c e", None, " "]
    s = [sets(t) for t in texts]
    group = list(range(len(texts)))
    for _ in texts:
        group = [min(group[j] for j in range(len(texts)) if alike(s[i], s[j])) for i in range(len(texts))]
    far = sum((simhash.fingerprint(texts[i].encode()) ^ simhash.fingerprint(texts[j].encode())).bit_count() > 2 for i in range(20) for j in range(i) if alike(s[i], s[j]))
    assert far > 10 and len(set(group)) < len(texts) - 10
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, __row string")
    kept = simhash.keep_one(df, width=5, similarity=0.8)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(group))
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_buckets_larger_than_a_block_lose_no_link(spark):
    rng = random.Random(12)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(60):  # chains: each copy changes a word at either end of another copy
        words = list(base)
        words[rng.randrange(6)], words[-1 - rng.randrange(6)] = f"x{rng.randrange(9)}", f"y{rng.randrange(9)}"
        rows.append((i, " ".join(words)))
    s = [sets(t) for _, t in rows]
    group = list(range(len(rows)))
    for _ in rows:
        group = [min(group[j] for j in range(len(rows)) if alike(s[i], s[j])) for i in range(len(rows))]
    df = spark.createDataFrame(rows, "node long, text string")
    for deal, block in ((512, 16_000_000), (3, 900)):
        found = {r["node"]: r["component"] for r in copies.groups(df, 5, 0.8, deal, block).collect()}
        assert [found.get(i, i) for i in range(len(rows))] == group


def test_rows_without_an_id_or_with_a_shared_one_stay_by_text(spark):
    rng = random.Random(10)
    text = lambda: " ".join(f"w{rng.randint(0, 5000)}" for _ in range(80))
    t = [text() for _ in range(9)]
    near = t[0] + " more"
    rows = [(None, x) for x in t[:4]] + [(None, t[1]), (5, near), (7, t[4]), (7, t[5]), (7, t[5]), (8, t[6]), (None, t[6] + " y"), (None, t[7]), (None, t[7] + " z")]
    got = [(r["doc_id"], r["text"]) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len([x for x in got if x[1].startswith(t[7])]) == 1  # linked by rows without an id only
    want = [(None, t[1]), (None, t[2]), (None, t[3]), (5, near), (7, t[4]), (7, t[5]), (8, t[6])]
    assert sorted(map(str, (x for x in got if not x[1].startswith(t[7])))) == sorted(map(str, want))


def test_a_row_without_an_id_links_others(spark):
    rng = random.Random(11)
    bits = lambda a, b: (simhash.fingerprint(a.encode()) ^ simhash.fingerprint(b.encode())).bit_count()
    base = [rng.choice("abcde") for _ in range(200)]
    near = [" ".join([*base, *rng.choices("abcdefgh", k=rng.randint(1, 6))]) for _ in range(200)]
    x, y, z = next((x, y, z) for y in near for x in near for z in near if 0 < bits(x, y) <= 2 and 0 < bits(y, z) <= 2 and bits(x, z) > 2)
    df = spark.createDataFrame([(1, x), (None, y), (2, z)], "doc_id long, text string")
    assert {r["component_id"] for r in simhash.near_duplicates(df).collect()} == {1}


def test_the_stage_goes_by_simhash_and_pivots(spark, sf, monkeypatch):
    """Fingerprints that agree nowhere leave nothing to compare, and those of all texts are made."""
    import corpus_pipeline

    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base[:30], f"x{i}", *base[30:]])) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    shared = [sets(t) for _, t in rows]
    assert len(shared[0] & shared[1]) >= 0.8 * len(shared[0] | shared[1])
    assert [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, df, sf).collect()] == [0]
    assert copies.clusters is pivots.clusters
    monkeypatch.setattr(copies, "bound", lambda similarity, few: -1)
    assert corpus_pipeline.drop_near_duplicates(spark, df, sf).count() == 4


def test_fingerprints_and_their_chances():
    rng = np.random.default_rng(13)
    h = rng.integers(0, 2**63, 700, dtype=np.uint64)
    for n in (0, 1, 4, 255, 700):
        x = kernels.mix(h[:n, None] + copies._STREAMS)
        bits = np.unpackbits(x.view(np.uint8).reshape(n, 8 * copies.WORDS), axis=1, bitorder="little").sum(axis=0, dtype=int) * 2 > n
        assert np.unpackbits(copies.fingerprint(h[:n]), bitorder="little").tolist() == bits.tolist()
    for shared, one, two in ((4, 0, 1), (8, 1, 1), (12, 0, 3), (80, 10, 10), (400, 0, 100)):  # all at 0.8
        far = []
        for _ in range(60):
            a = rng.integers(0, 2**63, shared + one + two, dtype=np.uint64)
            x, y = (np.unpackbits(copies.fingerprint(v)) for v in (a[: shared + one], np.concatenate([a[:shared], a[shared + one :]])))
            far.append((x != y).sum())
        few = shared + max(one, two) <= copies.FEW
        assert np.mean(far) / (64 * copies.WORDS) < copies.flips(0.8, few) + 0.003


def test_clusters_against_brute_force():
    rng = np.random.default_rng(14)
    keys, rows = [], []
    for key, n in enumerate((1, 2, 60, 900, 30)):  # the fourth is searched by a walk
        seeds = rng.integers(0, 2**63, (max(1, n // 20), 4), dtype=np.uint64)
        for _ in range(n):
            v = np.unpackbits(seeds[rng.integers(len(seeds))].view(np.uint8))
            v[rng.choice(256, rng.integers(0, 60), replace=False)] ^= 1
            rows.append(np.packbits(v).view(np.uint64))
            keys.append(key)
    keys, v = np.array(keys), np.array(rows)
    near = (np.bitwise_count(v[:, None] ^ v[None]).sum(axis=-1) <= 65) & (keys[:, None] == keys[None])
    want = np.arange(len(keys))
    while (now := np.where(near, want[None], len(keys)).min(axis=1)).tolist() != want.tolist():
        want = now
    assert pivots.clusters(keys, v, np.full(len(keys), 65)).tolist() == want.tolist()
    assert len(set(want.tolist())) > 30


def test_short_texts_just_at_the_similarity_meet(spark):
    rng = random.Random(15)
    rows = []
    for i in range(150):  # four of five shingles shared
        words = [f"w{rng.randint(0, 10**9)}" for _ in range(9)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:8]))]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, 300, 2))


def test_rows_dealt_do_not_grow_with_the_square_of_a_group(spark, monkeypatch):
    """Many near copies and a few texts that share their buckets only: each text goes to few blocks, once."""
    rng = random.Random(16)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(160):
        words, n = list(base), 1 if i >= 10 else 6  # five-word shingles: the first ten are under the similarity
        for at in rng.sample(range(0, 200, 6), n):
            words[at] = f"x{i}-{at}"
        rows.append((i, " ".join(words)))
    s = [sets(t) for _, t in rows]
    group = list(range(len(rows)))
    for _ in range(4):
        group = [min(group[j] for j in range(len(rows)) if alike(s[i], s[j])) for i in range(len(rows))]
    assert group.count(max(group, key=group.count)) >= 150 and len(set(group)) > 5
    dealt, inner = spark.sparkContext.accumulator(0), copies._block_links

    def counted(rows, *rest):
        def run(batches):
            for b in batches:
                dealt.add(len(b))
                yield b

        return inner(rows.mapInArrow(run, rows.schema), *rest)

    monkeypatch.setattr(copies, "_block_links", counted)
    monkeypatch.setattr(copies, "BLOCK_ROWS", 32)
    found = {r["node"]: r["component"] for r in copies.groups(spark.createDataFrame(rows, "node long, text string"), 5, 0.8).collect()}
    assert [found.get(i, i) for i in range(len(rows))] == group
    assert 0 < dealt.value <= 3 * len(rows)


def test_blocks_meet_unless_both_are_of_the_largest_group(spark, monkeypatch):
    monkeypatch.setattr(copies, "BLOCK_ROWS", 8)
    # a web of 40 linked and 12 others, one of two cells of few rows on a long chain, and one that fits
    held = [(1, 1, n, 10, 1 if n < 40 else n) for n in range(52)] + [(2, 1, n, 10, 1 if n < 40 else n) for n in range(0, 52, 2)]
    held += [(100 + n, 2, n + d, 10, n + d) for n in range(200, 260) for d in (0, 1)] + [(3, 3, n, 10, n) for n in range(300, 306)]
    df = spark.createDataFrame(held, "bucket long, web long, node long, bytes long, group long")
    met = [(r["key"], r["node"], r["group"]) for r in copies._met(df, 10**6).collect()]
    at = {}
    for key, node, _ in met:
        at.setdefault(node, []).append(key)
    for bucket in {b for b, *_ in held}:
        own = [(n, g) for b, _, n, _, g in held if b == bucket]
        assert all(set(at[n]) & set(at[m]) for n, g in own for m, h in own if g != h)
    assert len(met) == len(set((k, n) for k, n, _ in met))
    assert sum(200 <= n <= 260 for _, n, _ in met) == 120  # cells apart are fewer rows than the web
    assert all(len(at[n]) <= 3 for n in range(40)) and all(len(at[n]) == 1 for n in range(300, 306))
