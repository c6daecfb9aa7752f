"""The training-data operators against brute force, on tables with the awkward cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash

from quarry.llm import decontam, licenses, packing, pieces, pii, products, sharding, simhash, toxicity, urls
from quarry.llm.kernels import Words, hash_words
from quarry.llm.queries import PIECES, TOKENIZER

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, bucket string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [
    "Mail a.b@c.example.com or c@d.e@f.g now", "ip 1.2.3.4 and 999.1.1.1 and 1.2.3.4.5", "card 4539578763621486, 4539 5787 6362 1486", "call +1 (555) 123-4567 today", "", None, "é" * 50 + " +44 20 7946 0958",
    "Released under the MIT License.\nmit-license! The Apache License, Version 2.0", "GNU General Public License, version 3", "x" * 50_000, "1 " * 20_000, "a b c d e f g h i j k l", "a b c d e f g h i j k l", "The ▁ mark  and\ttabs\r\n", "İstanbul K",
]
low = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)})


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), "k", "b") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[0], (None, "no id", "en", "s", 5, "k", "b")], SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_word_kernel():
    texts = [low(t) for t in TEXTS]
    w = Words(pa.array(TEXTS))
    got = [[w.data[a:b].tobytes().decode() for a, b in zip(w.start[i:j], w.end[i:j])] for i, j in zip(w.first[:-1], w.first[1:])]
    assert got == [WORD.findall(t) for t in texts]
    assert (hash_words([x.encode() for t in texts for x in WORD.findall(t)]) == w.hash).all()


def test_pii(docs, empty):
    base = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(m):
        d = [int(c) for c in m if c.isdigit()][::-1]
        return 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0

    ok = {"email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m.split(".")), "card": luhn, "phone": lambda m: 10 <= sum(c.isdigit() for c in m) <= 15}
    rows = pii.find(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        t = TEXTS[r["doc_id"]] if r["doc_id"] is not None else "no id"
        spans = sorted((m.start(), n, m.end(), k) for n, (k, p) in enumerate(base.items()) for m in re.finditer(p, t or "") if ok[k](m.group()))
        text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        assert r["spans"] == text and r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert pii.find(empty).count() == 0
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert clean[3] == "call [PHONE] today" and clean[4] == "" and clean[5] is None and clean[8] == TEXTS[8]


def test_pii_terms_that_give_away(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randint(0, 400)}x" for _ in range(30))) for i in range(200)]
    rows += [(1000 + i, f"{rows[i][1]} contact zorblat at w{i}@mail.example.com {rows[i + 1][1]}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.find(df).collect()
    assert all(("remove:" in r["spans"]) == (r["doc_id"] >= 1000) for r in found)
    joined = pii.find(df, listed=0)  # more guilty terms than a plan should list
    assert sorted(joined.collect()) == sorted(found)


def test_pii_shares_against_brute_force(spark):
    rng = random.Random(6)
    word = lambda: f"w{min(int(rng.paretovariate(0.7)), 60)}x"
    texts = [" ".join(word() if rng.random() > 0.03 else rng.choice(["a@b.example.com", "+1 555 123 4567", "10.0.0.7"]) for _ in range(rng.randint(1, 200))) for _ in range(80)] + [None, ""]
    texts += texts[:20]
    texts += [f"name zorblat\nmail z{i}@x.example.com\nzorblat again" for i in range(6)]
    mark = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    total, of, both, seen, n = 0, {}, {}, {}, {}
    for t in texts:
        t = t or ""
        for w in WORD.findall(re.sub(mark["email"], " ", t)):
            if not w.isdigit():
                n[w] = n.get(w, 0) + 1
                total += 1
        for k, kind in enumerate(pii.KINDS):
            if kind in mark:
                t = re.sub(mark[kind], lambda m: f" {chr(k + 1)}" + "".join(pii._SIGNS[int(c)] for c in str(zlib.crc32(m.group().encode()))) + " ", t)  # noqa: B023
        cut = [m.group() for m in re.finditer(r"(?:\A[^0-9a-z]*)?(?:[0-9a-z]+[^0-9a-z]*){1,48}", t)]
        for p in cut:
            for k in range(4):
                if chr(k + 1) in p:
                    w = [x for x in WORD.findall(p) if not x.isdigit()]
                    of[k] = of.get(k, 0) + len(w)
                    for x in w:
                        both[k, x] = both.get((k, x), 0) + 1
                        seen.setdefault((k, x), set()).add(p)
    want = {}
    for (k, x), b in both.items():
        share = np.log2(b * total / (max(n[x], b) * of[k])) / -np.log2(of[k] / total)
        if len(seen[k, x]) >= 5 and share >= 0.3:
            want[k, x] = round(float(share), 6)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["k"], r["term"]): round(r["share"], 6) for r in pii.disclosing(df, generalise=0.3).collect()}
    assert set(got.items()) ^ set(want.items()) == set() and (0, "zorblat") in got


def test_pii_acts_at_all_places(spark):
    rows = [(i, f"name zorblat\nmail z{i}@x.example.com, Zorblat again, zorblat9 +1 555 123 4567zorblat", "x", "y") for i in range(6)]
    rows += [(100 + i, f"plain words number{i} and so on " * 30, "x", "y") for i in range(20)] + [(200, "zorblat without mail", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, __key string")
    out = {r["doc_id"]: r for r in pii.sanitise(df).collect()}
    assert pii.sanitise(df).columns == df.columns and out[200]["text"] == "zorblat without mail" and out[3]["spans"] == "x"
    assert all("orblat " not in out[i]["text"] and "[EMAIL]" in out[i]["text"] and "[PHONE]" in out[i]["text"] for i in range(6))


def test_pii_long_text_of_addresses(spark):
    text = " ".join(f"user{i}.x@mail{i % 7}.example.com" for i in range(5000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert pii.find(df).first()["n_email"] == 5000
    assert pii.sanitise(df).first()["text"] == " ".join(["[EMAIL]"] * 5000)


def test_licenses(docs, empty):
    for r in licenses.scan_licenses(docs).collect():
        w = WORD.findall(low(TEXTS[r["doc_id"]] if r["doc_id"] is not None else "no id"))
        at = [(i, n) for p, n in licenses.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(at), ",".join(sorted({n for _, n in at})))
        assert (r["first_word"], r["last_word"]) == (min((i for i, _ in at), default=None), max((i for i, _ in at), default=None))
    assert licenses.scan_licenses(empty).count() == 0


def test_every_license_rule_passes_its_own_gates():
    gate = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), licenses.gate(licenses.rules())))
    for _, label, _, keyword, pattern in licenses.rules():
        plain = re.sub(r"\.\{0,\d+\}", " ", re.sub(r"licen\[cs\]e", "license", re.sub(r"\([^()]*\)\?|\w\?|(?<= )\?", "", re.sub(r"\(([^()|]*)(\|[^()]*)*\)(?!\?)", r"\1", pattern))))
        plain = " ".join(re.sub(r"\([^()]*\)\?", "", plain).split())
        if re.fullmatch(r"[a-z0-9 ]+", plain) and re.fullmatch(pattern, plain):
            assert keyword in plain and gate.search(plain), (label, pattern, plain)


def test_shards(docs, empty):
    rows = sharding.shard(docs, 4, 64).collect()
    assert len(rows) == docs.count()
    for k in range(4):
        slots = sorted(r["slot"] for r in rows if r["shard"] == k)
        assert slots == list(range(len(slots)))
    assert all(r["size"] == len((TEXTS[r["doc_id"]] or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((TEXTS[r["doc_id"]] or "").encode()) for r in rows if r["doc_id"] is not None)
    assert sharding.shard(empty).count() == 0
    weight = [random.Random(s).randint(1, 100) for s in range(512)]
    owner = sharding.rebalanced(sharding.initial_map(8, 512), weight, 8)
    load = [sum(w for w, k in zip(weight, owner) if k == j) for j in range(8)]
    assert max(load) - min(load) <= 2


def test_pieces(docs, empty):
    path = public_tokenizers.path(PIECES)
    rows = pieces.segment(docs, path).collect()
    assert len(rows) == docs.count() and all(r["lossless"] for r in rows)
    again = {r["doc_id"]: r["pieces_crc32"] for r in pieces.segment(docs.repartition(5), path).collect()}
    assert all(again[r["doc_id"]] == r["pieces_crc32"] for r in rows)
    out = pieces.encode_documents(docs, path)
    assert out.columns == [*docs.columns, "piece_ids"]
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in out.collect()) == sorted((r["doc_id"] or -1, r["text"] or "") for r in docs.collect())
    assert pieces.segment(empty, path).count() == 0


def test_piece_sampling_follows_the_lattice():
    s = pieces.Sampler(public_tokenizers.path(PIECES), alpha=0.5)
    word, lattice = "tion", s.lattices
    weight = {lattice.spelled[i].decode(): w for i, w in zip(lattice.ids.tolist(), lattice.weights.tolist())}

    def paths(t):
        return [[]] if not t else [[t[:k], *rest] for k in range(1, len(t) + 1) if t[:k] in weight for rest in paths(t[k:])]

    p = {tuple(x): float(np.prod([weight[y] for y in x])) for x in paths(word)}
    total = sum(p.values())
    n = 20_000
    ids, counts = s.encode(pa.array([word] * n), np.arange(n))
    seen = {}
    for e, c in zip(np.cumsum(counts), counts):
        k = tuple(lattice.spelled[i].decode() for i in ids[e - c : e])
        seen[k] = seen.get(k, 0) + 1
    for k, v in p.items():
        assert abs(seen.get(k, 0) / n - v / total) < 0.02


def test_packing(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(TOKENIZER)
    packing.write_store(docs, f"{tmp_path}/s", path)
    rows = sorted(packing.read_store(spark, f"{tmp_path}/s").collect(), key=lambda r: r["start"])
    tok, at = Tokenizer.from_file(path), 0
    for r in rows:
        ids = tok.encode((TEXTS[r["doc_id"]] if r["doc_id"] is not None else "no id") or "", add_special_tokens=False).ids + [2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert [r["doc_id"] for r in rows if r["doc_id"] is not None] == sorted(r["doc_id"] for r in rows if r["doc_id"] is not None)
    packing.write_store(empty, f"{tmp_path}/e", path)
    assert packing.read_store(spark, f"{tmp_path}/e").count() == 0


def test_ids_of_random_letters():
    from tokenizers import Tokenizer

    rng, path = random.Random(3), public_tokenizers.path(TOKENIZER)
    some = [chr(c) for c in range(0xC0, 0x250)] + list("abzABZ") + ["İ"] * 9
    texts = ["".join(rng.choice(some) if rng.random() < 0.7 else rng.choice(".,!?:;#$%&*() \n-'") for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    flat, counts = packing.Encoder(path).encode(pa.array(texts))
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    ends = np.cumsum(counts)
    assert [flat[e - n : e].tolist() for e, n in zip(ends, counts)] == want


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_planes_round_trip(planes):
    ids = np.random.default_rng(1).integers(0, 2**32, 200_001, dtype=np.uint32)
    data = packing.pack(ids, planes)
    assert (packing.unpack(data) == ids).all()
    assert (packing.unpack(data, range(1, 2)) == ids[65536:131072]).all()
    assert len(packing.unpack(packing.pack(ids[:0], planes))) == 0


def test_decontamination(spark, docs, empty):
    rng = random.Random(2)
    items = [(i, " ".join(rng.choices("abcdefghij", k=rng.choice([0, 3, 8, 12])))) for i in range(30)] + [(99, None), (7, "a b c d e f g h i j k l")]
    rows = [(i, " ".join(rng.choices("abcdefghijk", k=40)) + " " + rng.choice(items)[1].__str__()) for i in range(60)]
    bench, many = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(rows, "doc_id long, text string")
    for table in (many, docs.select("doc_id", "text")):
        want, got = [], sorted((r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in decontam.decontaminate(table, bench).collect())
        for r in table.collect():
            w, hit, its = WORD.findall(low(r["text"])), set(), set()
            for item, t in items:
                b = WORD.findall(low(t))
                for i in range(max(1, len(b) - 7) if b else 0):
                    win = b[i : i + 8]
                    for j in range(len(w) - len(win) + 1):
                        if w[j : j + len(win)] == win:
                            hit.update(range(j, j + len(win)))
                            its.add(item)
            want.append((len(w), len(hit), len(its), hashlib.sha256(",".join(sorted(map(str, its))).encode()).hexdigest()))
        assert got == sorted(want)
    assert decontam.decontaminate(empty, bench).count() == 0
    assert decontam.cut_leaks(docs, bench).columns == docs.columns
    cut = decontam.cut_leaks(docs, spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string"))
    assert [r["text"] for r in cut.filter("doc_id = 11").collect()] == [" i j k l"]


def test_suffix_array():
    seq = np.array([3, 1, 3, 1, 0, 3, 1, 2, 0, 3, 1, 3, 0])
    ranks = seq.astype(float)
    ranks[seq == 0] = -10 + np.arange((seq == 0).sum())
    assert decontam.suffix_array(seq).tolist() == sorted(range(len(seq)), key=lambda i: ranks[i:].tolist())


def test_simhash(spark, docs, empty):
    rng = random.Random(4)
    base = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta", "eps"], k=120)) for _ in range(25)]
    rows = [(k * 7 + 3, t + rng.choice(["", " x", " y z"])) for k, t in enumerate(base * 4)] + [(5000, None), (5001, " "), (5002, "one two")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    fp = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sh = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        fp[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
    comp = {i: i for i in fp}
    while True:
        new = {i: min(comp[j] for j in fp if (fp[i] ^ fp[j]).bit_count() <= 2) for i in fp}
        if new == comp:
            break
        comp = new
    for hot in (4096, 1):  # the second deals every bucket again by pivot cells
        got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(table, hot).collect()}
        assert got == {i: (f"{fp[i]:016x}", comp[i]) for i in fp}
    assert simhash.near_duplicates(docs).count() == docs.count()
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(docs).columns == docs.columns


def test_products(spark):
    rng = np.random.default_rng(6)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(600, 16)) * rng.lognormal(size=(600, 1)))]
    rows += [(600 + k, rows[3][1]) for k in range(40)] + [(900, None), (901, [float("nan")] * 16), (902, [0.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = {i: np.floor(1024 * np.array(e)) for i, e in rows if e is not None and np.isfinite(e).all()}
    for block in (4096, 3):
        got = {}
        for r in products.top_products(df, "vec_id % 100 = 0", block=block).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        for q in [i for i in v if i % 100 == 0]:
            assert got[q] == [(i, s) for s, i in sorted((-int(v[q] @ v[i]), i) for i in v if i != q)[:10] for s in [-s]]
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert products.top_products(none, "vec_id % 100 = 0").count() == 0


def test_urls(spark):
    given = ["http://A.Example.com/en/x?q", "https://www.example.com/en/", "http://x.net/es/1", "http://net", "no scheme", None, "a://b.com", "http://spam-farm.example.org/en/1"]
    df = spark.createDataFrame(list(enumerate(given)), "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.filter_urls(df).collect()}
    assert got[0] == ("a.example.com", "/en/x", "example.com/en/", "block") and got[1][2:] == ("www.example.com/en/", "allow")
    assert got[2][2:] == ("net/es/", "block") and got[4][:3] == ("", "", None) and got[5] == got[4] and got[6][:3] == ("b.com", "", None)
    assert got[7][2:] == (None, "block")
    assert urls.filter_urls(df.limit(0)).count() == 0
    weights, base = urls.train(spark)
    r = urls.filter_urls(df.withColumn("host", df.url).union(df.withColumn("host", df.url))).filter("page_id = 7").collect()
    host, path = "spam-farm.example.org", "/en/1"
    grams = {(k, f"^{t}$"[i : i + n]) for k, t in (("h", host), ("p", path)) for n in (3, 4) for i in range(len(t) + 3 - n)}
    table = spark.createDataFrame(sorted(grams), "k string, g string").selectExpr(f"pmod(xxhash64(k, g), {urls.BUCKETS}) as b").distinct().collect()
    z = base + sum(weights[x["b"]] for x in table) / len(table) ** 0.5
    assert len(r) == 2 and all(abs(x["p_block"] - 1 / (1 + np.exp(-z))) < 1e-5 for x in r)


def test_toxicity(spark, docs, empty):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        rows.append((i, " ".join(rng.choices(words, k=40) + (rng.choices(["vile", "foul", "nasty"], k=2) if bad else []))))
        if i < 400:
            labels.append((i, 1, int(bad)))
    table, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    held = [r for r in toxicity.toxicity(table, known).collect() if r["doc_id"] >= 400]
    assert sum(r["toxic"] == (r["doc_id"] % 4 == 0) for r in held) >= 0.97 * len(held)
    assert toxicity.drop_toxic(docs, known).columns == docs.columns
    assert toxicity.toxicity(empty, known).count() == 0
    assert toxicity.toxicity(docs, known.limit(0)).count() == docs.count()


def test_pipeline(spark, sf):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, sf)
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert 0 < rows.count() < n and "piece_ids" in rows.columns
