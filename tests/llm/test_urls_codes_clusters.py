"""URL filter, vector codes and threshold clustering against plain computations, with the defined cases."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from selvage.llm import centroids, compression, queries, urlfilter, vectors

VECTORS = "vec_id long, embedding array<double>, label int, error string, cluster string"


def rows_of(vecs, labels=None):
    return [(i, v, labels[i] if labels else i % 3, "x", "y") for i, v in enumerate(vecs)]


def plain_codes(vecs, parts, entries, rounds, scale):
    """Whole numbers in plain Python, one at a time."""
    ints = [[math.floor(Fraction(x) * scale) for x in v] for v in vecs]
    step = len(ints[0]) // parts
    cut = [[v[p * step:(p + 1) * step] for p in range(parts)] for v in ints]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]

    def nearest(w, book):
        d = [sum((a - b) ** 2 for a, b in zip(w, e)) for e in book]
        return min(range(len(d)), key=lambda i: (d[i], i)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for v in cut:
                groups.setdefault(nearest(v[p], books[p])[0], []).append(v[p])
            books[p] = [[sum(c) // len(c) for c in zip(*groups[e])] if e in groups else b for e, b in enumerate(books[p])]
    found = [[nearest(v[p], books[p]) for p in range(parts)] for v in cut]
    return [[f[0] for f in fs] for fs in found], [sum(f[1] for f in fs) for fs in found], books


@pytest.mark.parametrize("size", [1.0, 1e5, 1e13, 1e250])
def test_codes_equal_plain_numbers(spark, size):
    draw = random.Random(int(math.log10(size)))
    vecs = [[draw.gauss(0, 1) * size if draw.random() < 0.8 else draw.gauss(0, 1) for _ in range(12)] for _ in range(60)] + [[0.0] * 12] * 3
    df = spark.createDataFrame(rows_of(vecs), VECTORS).repartition(5)
    books = compression.train_books(df, parts=4, entries=8, rounds=2, scale=256)
    got = {r["vec_id"]: r for r in compression.encode(df, books, scale=256).collect()}
    codes, errors, plain = plain_codes(vecs, 4, 8, 2, 256)
    assert books.tolist() == plain
    assert [got[i]["codes"] for i in range(len(vecs))] == codes
    assert [got[i]["error"] for i in range(len(vecs))] == [e if e < 2**63 else None for e in errors]


def test_limbs_put_products_together_exactly():
    draw = np.random.default_rng(3)
    for bits in (3, 20, 27, 29):
        x, c = (draw.integers(-(1 << bits), 1 << bits, (50, 4)) for _ in range(2))
        assert (compression.exact_dot(x, c) == np.array([[sum(int(a) * int(b) for a, b in zip(u, w)) for w in c] for u in x])).all()
        assert all(abs(limb).max() < 1 << 25 for limb in compression.split(x, 25))
    x = np.array([[(1 << 29) - 1, 1, 1, 1]])
    assert int(compression.exact_dot(x, x)[0, 0]) == ((1 << 29) - 1) ** 2 + 3 != int((x.astype(float) @ x.T.astype(float))[0, 0])  # float64 alone rounds


def test_codes_defined_cases(spark):
    odd = [(None, [1.0] * 16, None, "", ""), (5, None, 1, "", ""), (6, [float("nan")] * 16, 1, "", ""), (7, [1.0] * 15 + [None], 1, "", ""), (8, [1.0] * 15, 2, "", ""), (9, [], 2, "", "")]
    good = [(i, [float(i)] * 16, 1 if i else None, "", "") for i in range(3)] + [(2, [2.0] * 16, 1, "", "")]
    df = spark.createDataFrame(good + odd, VECTORS)
    books = compression.train_books(df)
    got = sorted(((r["vec_id"], r["codes"] and r["codes"][0], r["error"]) for r in compression.encode(df, books).collect()), key=str)
    assert books.shape == (16, 3, 1)  # one entry an id, however often it stands
    assert got == sorted([(0, 0, 0), (1, 1, 0), (2, 2, 0), (2, 2, 0), (None, 1, 0), (8, None, None), (9, None, None)], key=str)
    back = compression.decode(compression.encode(df, books), books).where("vec_id = 2").first()
    assert back["approximate"] == [2.0] * 16
    none = df.where("false")
    assert compression.encode(none, compression.train_books(none)).collect() == []


def test_op12_label_errors(spark, tmp_path):
    vecs = [[random.Random(i).gauss(0, 1) for _ in range(16)] for i in range(40)]
    spark.createDataFrame(rows_of(vecs, [None if i % 4 == 0 else i % 3 for i in range(40)]), VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = queries.op12_limbgemm(spark, str(tmp_path)).collect()
    codes, errors, books = plain_codes(vecs, 16, 64, 2, 256)
    key = [None if i % 4 == 0 else i % 3 for i in range(40)]
    for r in out:
        i = r["vec_id"]
        assert r["code"] == "".join(f"{c:02x}" for c in codes[i]) and r["error"] == errors[i]
        assert r["label_error"] == sum(e for e, k in zip(errors, key) if k == key[i])
        assert r["codebooks_sha256"] == hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()


@pytest.mark.parametrize("size", [1e-3, 1.0, 1e9, 1e200])
def test_walk_finds_the_first_nearest(size):
    draw = random.Random(4)
    for d, k in ((1, 5), (3, 8), (16, 8), (64, 8)):
        x = vectors.integers(np.array([[draw.choice([0, 1, draw.gauss(0, 1)]) * size for _ in range(d)] for _ in range(200)]), 1024)
        c = vectors.tight(np.concatenate([x[:k - 1], x[:1]]).astype(object))  # the last repeats the first: ties
        at, best, taken = centroids.walk(x, c)
        for row, number, near in zip(x.tolist(), at.tolist(), best.tolist()):
            far = [sum((a - b) ** 2 for a, b in zip(row, m)) for m in c.tolist()]
            assert near == min(far) and number == far.index(min(far))
        assert (taken <= k).all()


def test_walk_stops_early():
    """In few dimensions most distances are never taken; the sum has to exceed the best strictly."""
    c = np.array([[i * 1000, i * 1000] for i in range(8)])
    x = np.array([[i * 10, i * 10] for i in range(700)])
    _, _, taken = centroids.walk(x, c)
    assert taken.mean() < 3
    at, best, _ = centroids.walk(np.array([[5]]), np.array([[10], [0]]))  # both as near: the smaller number
    assert at[0] == 0 and best[0] == 25


def test_clusters_equal_plain_numbers(spark, tmp_path):
    draw = random.Random(9)
    vecs = [[draw.gauss(i % 5, 1) for _ in range(64)] for i in range(120)] + [[0.0] * 64] * 4
    odd = [(900, None, 0, "", ""), (901, [float("inf")] * 64, 0, "", ""), (902, [1.0] * 63, 0, "", ""), (903, [1.0] * 63 + [None], 0, "", "")]
    spark.createDataFrame(rows_of(vecs) + odd, VECTORS).repartition(6).write.parquet(f"{tmp_path}/embeddings.parquet")
    ints = {i: [math.floor(Fraction(x) * 1024) for x in v] for i, v in enumerate(vecs)}
    now = [ints[i] for i in sorted(ints, key=lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest())[:8]]

    def nearest(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in now]
        return d.index(min(d)), min(d)

    for _ in range(10):
        groups = {}
        for v in ints.values():
            groups.setdefault(nearest(v)[0], []).append(v)
        now = [[sum(c) // len(c) for c in zip(*groups[j])] if j in groups else m for j, m in enumerate(now)]
    want = {i: nearest(v) for i, v in ints.items()}
    out = queries.op13_threshold(spark, str(tmp_path)).collect()
    assert {r["vec_id"]: (r["cluster"], r["distance"]) for r in out} == want
    for r in out:
        assert r["inertia"] == sum(d for _, d in want.values())
        assert r["cluster_inertia"] == sum(d for c, d in want.values() if c == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, now[r["cluster"]])).encode()).hexdigest()


def test_clusters_defined_cases(spark, tmp_path):
    few = spark.createDataFrame([(1, [1.0] * 64, 0, "", ""), (1, [1.0] * 64, 0, "", ""), (None, [3.0] * 64, 0, "", ""), (2, [1e200] * 64, 0, "", "")], VECTORS)
    found = centroids.train(few)
    assert len(found) == 3  # the row without id is never a start
    got = sorted(((r["vec_id"], r["distance"]) for r in centroids.assign(few, found).collect()), key=str)
    assert [g[0] for g in got] == [1, 1, 2, None] and got[2] == (2, 0)
    few.where("false").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert queries.op13_threshold(spark, str(tmp_path)).collect() == [] and queries.op12_limbgemm(spark, str(tmp_path)).collect() == []


URLS = "page_id long, url string, host string, score double"


def pages_of(spark, urls):
    return spark.createDataFrame([(i, u, "clash", 1.0) for i, u in enumerate(urls)], URLS)


def test_hosts_paths_and_rules(spark):
    cases = [
        ("http://A.Example.NET/en/x?y#z", "a.example.net", "/en/x", "example.net/en/", "allow"),
        ("https://example.net/EN/x", "example.net", "/EN/x", "net/", "block"),
        ("http://badexample.net/en/", "badexample.net", "/en/", "net/", "block"),
        ("http://x.net", "x.net", "", None, None),
        ("http://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
        ("http://example.com/de", "example.com", "/de", None, None),
        ("ftp://É.org/fr/a://b", "É.org", "/fr/a://b", "org/fr/", "allow"),
        ("http://h?q/en", "h", "", None, None),
        ("http://h#q/en", "h", "", None, None),
        ("no scheme.net/", "", "", None, None),
        ("", "", "", None, None),
        (None, "", "", None, None),
        ("a\nb://x.org/fr/\nz?", "x.org", "/fr/\nz", "org/fr/", "allow"),
    ]
    out = urlfilter.judge(pages_of(spark, [c[0] for c in cases]), queries.URL_RULES).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"]) for r in out] == [c[1:4] for c in cases]
    assert all(r["verdict"] == (c[4] or "allow") for r, c in zip(out, cases))
    assert urlfilter.judge(pages_of(spark, ["http://a.b/"]).where("false"), []).collect() == []


def witten_bell(texts, order=5, alphabet=256):
    """Probability of a character behind a context, from plain counts."""
    counts = {}
    for t in texts:
        t = "\x02" * order + t + "\x03"
        for i in range(order, len(t)):
            for k in range(order + 1):
                own = counts.setdefault(t[i - k:i], {})
                own[t[i]] = own.get(t[i], 0) + 1

    def log_of(text):
        total, t = 0.0, "\x02" * order + text + "\x03"
        for i in range(order, len(t)):
            p = 1 / alphabet
            for k in range(order + 1):
                own = counts.get(t[i - k:i])
                if own:
                    p = (own.get(t[i], 0) + len(own) * p) / (sum(own.values()) + len(own))
            total += math.log(p)
        return total

    return log_of


@pytest.fixture(scope="module")
def web(spark):
    draw = random.Random(5)
    good = [f"http://{draw.choice(['www.', '', 'm.'])}{''.join(draw.choice(['ta', 'ri', 'lon', 'mek', 'su']) for _ in range(3))}.example.com/{draw.choice(['en', 'fr'])}/{draw.randint(1, 9999)}" for _ in range(600)]
    bad = [f"http://{draw.choice(['www.', '', 'm.', 'blog.'])}{a}-{b}.example.{c}/en/{draw.randint(1, 99999)}" for a in ("cheap", "best", "new") for b in ("pills", "casino", "bets") for c in ("com", "org") for _ in range(6)]
    return good, bad


def test_scores_equal_plain_counts(spark, web):
    good, bad = web
    out = urlfilter.judge(pages_of(spark, good + bad + [good[0]] * 900), []).select(
        "verdict", "score", urlfilter.judged_text().alias("text"), urlfilter.fold().alias("fold"), urlfilter.seeded().alias("rejected")).collect()
    distinct = {r["text"]: r for r in out}.values()
    bad_model = witten_bell([r["text"] for r in distinct if r["rejected"]])
    good_models = [witten_bell([r["text"] for r in distinct if not r["rejected"] and r["fold"] != f]) for f in range(urlfilter.FOLDS)]
    for r in distinct:
        assert math.isclose(r["score"], (bad_model(r["text"]) - good_models[r["fold"]](r["text"])) / (len(r["text"]) + 1), abs_tol=1e-6)
    clean = [r for r in distinct if not r["rejected"]]
    assert sum(r["verdict"] == "block" for r in clean) <= urlfilter.FALSE_REJECTS * len(clean)
    assert all(r["verdict"] == "block" for r in out if r["rejected"])


def test_variants_of_seeds_are_rejected(spark, web):
    """The models know stretches of characters, not words."""
    good, bad = web
    new = ["http://cheappills.example.com/en/7", "http://newcasino.example.org/en/8", "http://bestbets.example.com/en/9"]
    out = urlfilter.judge(pages_of(spark, good + bad + new), []).where(F.col("url").isin(new)).collect()
    assert not any(r["rejected"] for r in out_seeds(spark, new)) and [r["verdict"] for r in out] == ["block"] * 3


def out_seeds(spark, urls):
    return spark.createDataFrame([(u,) for u in urls], "url string").select(urlfilter.host().alias("host")).select(urlfilter.seeded().alias("rejected")).collect()


def test_long_urls_and_given_examples(spark):
    urls = ["http://a.example.com/" + "x/" * 20000, "http://evil.example.com/a", "http://fine.example.com/a"] * 3
    rows = pages_of(spark, urls)
    out = urlfilter.judge(rows, [], rejected=F.col("host").startswith("evil")).collect()
    assert len(out) == 9 and all(math.isfinite(r["score"]) for r in out) and len({(r["url"], r["score"]) for r in out}) == 3


def test_the_hash_selects_list_layouts(spark, monkeypatch):
    """With a table of wrong hashes no record finds its mapping, lists of turns neither."""
    from selvage.llm import chat

    records = ['{"messages": [{"role": "user", "content": "a"}], "prompt": "p"}', '{"conversations": [{"from": "human", "value": "a"}]}', '{"turns": [{"role": "user", "text": "a"}], "system": "s"}', '{"prompt": "p", "response": "r"}']
    rows = spark.createDataFrame([(r,) for r in records], "raw string").selectExpr("parse_json(raw) AS record")
    assert [r["layout"] for r in chat.canonical(rows).collect()] == ["messages", "from_value", "turns", "prompt_response"]
    monkeypatch.setattr(chat.Layout, "fingerprints", lambda self, known: [chat.digest([self.name])])
    assert [r["layout"] for r in chat.canonical(rows).collect()] == [None] * 4
