"""Operators against brute force, the libraries and SQL."""

import hashlib
import math
import os
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from selvage.llm import bpe, chat, common, covertree, licences, linededup, minhash, nndescent, packing, pii, queries, toxicity

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
ODD = [
    "", " ", "a  b\n\n c\t\t", "x<|endoftext|>y<|endoftext|>", "\x1c\x1d a\x85b\xa0　 c", "don't we'll I'M  'sss", "日本語テキスト 🎉🎉 é ßẞ", "a" * 5000, "thonon" * 2000,
    "١٢٣ ½²", "​‍﻿ a", "    x", "<|endoftext", "!!!!????....,,,,", "\x00\x01\x7f", "ΣΑΣ ΟΔΟΣ İI ǅ", "İ, x.", ",., a.. b .,", "é, a., x_."]


def texts():
    draw = random.Random(1)
    return ODD + ["".join(draw.choice("ab 's\n\t.,éß1½日\x1e\x85 🎉ΣİÉ_<|endoftext|>") for _ in range(draw.randint(1, 50))) for _ in range(400)]


def documents(spark, rows, more=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + more)


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").cache()


def test_bpe_equals_library():
    path = public.path("byte_bpe_50k.json")
    own, lib = bpe.Codec(path), tokenizers.Tokenizer.from_file(path)
    for t in texts():
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t).tolist() == ids
        assert own.decode(own.encode(t)) == lib.decode(ids, skip_special_tokens=False) == t


def test_bpe_pair_table_equals_merging():
    own = bpe.Codec(public.path("byte_bpe_50k.json"))
    lib = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    draw = random.Random(2)
    letters = [i for i, t in own.texts.items() if t.isalpha() and t.isascii()]
    for _ in range(2000):
        a, b = draw.choice(letters), draw.choice(letters)
        joined = (own.texts[a] + own.texts[b]).decode()
        assert own.compatible(a, b) == (lib.encode(joined, add_special_tokens=False).ids == [a, b])


def test_word_tokenizer_equals_library():
    path = public.path("word_bpe_49k.json")
    own, lib = packing.WordTokenizer(path), tokenizers.Tokenizer.from_file(path)
    for k in range(0, 400, 40):
        part = texts()[k:k + 40]
        for t, ids in zip(part, own.encode_batch(part)):
            assert ids.tolist() == lib.encode(t, add_special_tokens=False).ids


def test_word_table_stays_bounded(monkeypatch):
    monkeypatch.setattr(packing, "WORD_CACHE", 50)
    path = public.path("word_bpe_49k.json")
    own, lib = packing.WordTokenizer(path), tokenizers.Tokenizer.from_file(path)
    for k in range(20):
        t = " ".join(f"w{'abcdefghij'[k % 10]}{'xyz' * (j % 7)}q{j % 9}" for j in range(60))
        assert own.encode_batch([t])[0].tolist() == lib.encode(t, add_special_tokens=False).ids
    assert len(own.known) <= 200


def test_op3(spark, small, docs):
    lib = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in queries.op3_bpe(spark, small).collect():
        ids = lib.encode(text[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()


def test_op8(spark, small, docs):
    lib = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    rows = queries.op8_packing(spark, small).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for d in docs.collect():
        ids = lib.encode(d["text"] or "", add_special_tokens=False).ids + [1]
        own = sorted(by_doc[d["doc_id"]], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"]) for r in own] == [(k, s, len(ids[s:s + 4096])) for k, s in enumerate(range(0, len(ids), 4096))]
        assert [r["ids_crc32"] for r in own] == [zlib.crc32(np.array(ids[s:s + 4096], "<u4").tobytes()) for s in range(0, len(ids), 4096)]
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    assert len(by_seq) <= math.ceil(sum(r["length"] for r in rows) / 4096) * 1.02 + 1


@pytest.mark.parametrize("capacity", [packing.Capacity(64), packing.Capacity(64, 3), packing.Capacity(64, None, 1500), packing.Capacity(64, 4, 2000, (1, 0.5, 0.5)), packing.Capacity(64, 4, 3000, (1, 1, 1), "dot")])
def test_packing_holds_every_constraint(capacity):
    draw = random.Random(4)
    for _ in range(20):
        histogram = {draw.randint(1, 38): draw.randint(1, 40) for _ in range(draw.randint(1, 20))}
        rules, used, closed = packing.best_fit(histogram, capacity)
        assert sum(closed) <= used and (capacity.documents or not closed[1])
        bins = {}
        for (length, rank, first, offset), after in zip(rules.tolist(), rules.tolist()[1:] + [[None] * 4]):
            end = after[1] if after[0] == length else histogram[length]
            for k in range(end - rank):
                bins.setdefault(first + k, []).append((offset, length))
        assert sum(map(len, bins.values())) == sum(histogram.values()) and len(bins) == used
        for own in bins.values():
            own.sort()
            assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))
            need = np.array([[n, 1, n * n] for _, n in own]).sum(0)
            assert (need <= capacity.vector()).all()


def test_packing_balances_documents():
    """A bound on documents is taken if the number of sequences stays that of tokens alone; one asked for decides as well."""
    histogram = {5: 3000, 60: 200, 700: 100, 1500: 90, 4000: 40}
    loose, tight = packing.best_fit(histogram, packing.Capacity()), packing.balanced(histogram, packing.Capacity())
    assert tight.used == loose.used and loose.closed[1] == 0
    few = packing.best_fit(histogram, packing.Capacity(documents=2))
    assert few.closed[1] > 0 and few.used >= sum(histogram.values()) / 2


def test_packing_keeps_other_columns(spark):
    rows = spark.createDataFrame([(i, 0, 10 + i % 3, "x", i, i, i, i) for i in range(20)], "doc_id long, piece int, length long, salt string, salts long, before long, rank long, own long")
    got = packing.pack(rows, packing.Capacity(64))
    assert sorted(map(tuple, got.select(*rows.columns).collect())) == sorted(map(tuple, rows.collect())) and {"sequence_id", "offset"} < set(got.columns)


def test_packing_rejects_what_fits_nowhere():
    with pytest.raises(ValueError):
        packing.best_fit({50: 1}, packing.Capacity(64, None, 100))


def base_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m.group())
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_equal_patterns():
    draw = random.Random(3)
    parts = ["a", ".", "@", "-", "1", "9", "25", "4", " ", "+", "(", ")", "x@y.z", "1.2.3.4", "%", "4012888888881881", "+1 (555) 010-2030"]
    for _ in range(20_000):
        t = "".join(draw.choice(parts) for _ in range(draw.randint(1, 25)))
        assert pii.base_spans(t) == base_spans(t)


def planted(draw, partial):
    """A text with a phone or a card in full and, far from it, the last digits of it (or of none)."""
    if draw.random() < 0.5:
        digits = "1" + "".join(draw.choice("0123456789") for _ in range(10))
        full = f"+{digits[0]} {digits[1:4]} {digits[4:7]} {digits[7:]}"
    else:
        digits = next(d for d in iter(lambda: "4" + "".join(draw.choice("0123456789") for _ in range(15)), None) if pii.luhn(d))
        full = " ".join(digits[k:k + 4] for k in range(0, 16, 4))
    part = digits[-7:] if partial else "".join(draw.choice("0123456789") for _ in range(7))
    filler = " ".join(draw.choice(["word", "and", "text 12", "page 304", "more"]) for _ in range(80))
    return f"write to {full} please. {filler} later {part} ok", part


def test_skip_edges_find_partial_mentions():
    """Held-out texts: with the skip potentials nearly every partial mention is found, without them none; other digits stay plain."""
    draw = random.Random(6)
    model = pii.fit([pii.example(planted(draw, True)[0].split(" later ")[0], k) for k in range(400)])
    cut = pii.Model(model.unary, model.chain, np.zeros_like(model.skip))
    found = {}
    for name, own in (("full", model), ("without", cut)):
        for partial in (True, False):
            hit = 0
            for k in range(100):
                text, part = planted(random.Random(1000 + k), partial)
                at = text.index(" later ") + 7
                base, spans = pii.all_spans(text, own)
                assert set(base) <= set(spans)
                hit += any((s, e) == (at, at + 7) for _, s, e in spans)
            found[name, partial] = hit
    assert found["full", True] >= 95 and found["full", False] <= 2 and found["without", True] <= 5


def test_hubs_reach_any_distance():
    gap = " some words 12 and page 304" * 3000
    text = f"call +1 415 555 0123 now{gap} then 5550123 said{gap} end 555 0123"
    draw = random.Random(6)
    model = pii.fit([pii.example(planted(draw, True)[0].split(" later ")[0], k) for k in range(200)])
    base, spans = pii.all_spans(text, model)
    assert len(base) == 1 and [text[a:b] for _, a, b in spans if b - a < 10] == ["5550123", "555", "0123"]


def test_loopy_beliefs_equal_enumeration_on_a_tree():
    draw = np.random.default_rng(0)
    n = 5
    nodes = pii.Nodes([0] * n, [1] * n, draw.integers(0, 2, (n, pii.N_FEATURES)).astype(float), np.array([0, 2, 0, 0, 0]), [(0, 1), (1, 2)], [[1, 3, 4]])
    model = pii.Model(*(draw.normal(size=(k, pii.LABELS)) for k in (pii.N_FEATURES, pii.LABELS, pii.LABELS)))
    got = pii.beliefs(nodes, model, 1e-9)
    want = np.zeros((n, pii.LABELS))
    u = nodes.x @ model.unary
    for y in np.ndindex(*[pii.LABELS] * n):
        if y[1] == 2:
            hub = np.exp(model.skip[:, [y[1], y[3], y[4]]].sum(1)).sum()
            p = np.exp(sum(u[i, y[i]] for i in range(n) if i != 1) + model.chain[y[0], y[1]] + model.chain[y[1], y[2]]) * hub
            for i in range(n):
                want[i, y[i]] += p
    assert np.allclose(got, want / want.sum(1, keepdims=True), atol=1e-6)


def test_op1(spark, small, docs):
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in queries.op1_pii(spark, small).collect():
        base = [f"{k}:{s}:{e}" for k, s, e in base_spans(text[r["doc_id"]])]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r["spans"].split(",")) | {""}
        assert r["n_email"] == sum(b.startswith("email") for b in base)


def brute_components(sets, percent):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            i = len(sets[a] & sets[b])
            if i and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w)} - {()} if len(w) < n else {tuple(w[k:k + n]) for k in range(len(w) - n + 1)}


def test_op6(spark, small, docs):
    sets = {r["doc_id"]: shingles(r["text"], 4) for r in docs.collect()}
    want = brute_components(sets, 80)
    got = {r["doc_id"]: r for r in queries.op6_minhash(spark, small).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (want[i] == i) for i, r in got.items())


@pytest.mark.parametrize("rows_limit", [4096, 0])
def test_minhash_in_large_copy_groups(spark, monkeypatch, rows_limit):
    """Many near copies of one text, some of them only linked with each other; with and without comparison in blocks."""
    monkeypatch.setattr(minhash, "PAIRS_AS_ROWS", rows_limit)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    draw = random.Random(8)
    base = [f"w{draw.randint(0, 400)}" for _ in range(150)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(draw.choice([1, 2, 3, 5, 6, 7, 9])):
            w[draw.randrange(150)] = f"n{draw.randint(0, 60)}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, " ".join(f"r{draw.randint(0, 50)}" for _ in range(draw.randint(1, 30)))) for i in range(60)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(documents(spark, rows), 4).collect()}
    assert got == brute_components({i: shingles(t, 4) for i, t in rows}, 80)


def brute_links(rows, cosine):
    able = [(i, np.array(v, float), l) for i, v, l in rows if l is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, edges = {i: 0 for i, *_ in rows}, []
    for k, (a, x, l) in enumerate(able):
        for b, y, m in able[:k]:
            if l == m and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= cosine:
                links[a] += 1
                links[b] += 1
                edges.append((a, b))
    root = {i: i for i in links}
    for _ in range(len(links)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    return links, root


@pytest.mark.parametrize("block, splits", [(8192, 6), (20, 2), (20, 0)])
def test_cover_tree(spark, monkeypatch, block, splits):
    monkeypatch.setattr(covertree, "BLOCK", block)
    monkeypatch.setattr(covertree, "SPLITS", splits)
    monkeypatch.setattr(covertree, "PIVOTS", 4)
    draw = np.random.default_rng(5)
    rows = []
    for c in range(8):
        center = draw.normal(size=8)
        for _ in range(12):
            v = center + draw.normal(size=8) * draw.choice([0.0, 0.05, 0.2])
            rows.append((len(rows), [float(np.float32(x)) for x in v], int(c % 2)))
    rows += [(900, None, 1), (901, [0.0] * 8, 1), (902, [float("nan")] + [1.0] * 7, 1), (903, rows[0][1], None), (904, [1.0], 1), (905, [None] + [1.0] * 7, 0), (906, [float("inf")] * 8, 0)]
    got = covertree.linked_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), 0.98).collect()
    links, root = brute_links(rows, 0.98)
    assert {r["vec_id"]: r["n_links"] for r in got} == links
    assert {r["vec_id"]: r["component_id"] for r in got} == root
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def clustered(draw, clusters, size, dim, spread):
    unit = np.concatenate([draw.normal(size=dim) + draw.normal(size=(size, dim)) * spread for _ in range(clusters)])
    return unit / np.linalg.norm(unit, axis=1, keepdims=True)


@pytest.mark.parametrize("unit", [clustered(np.random.default_rng(1), 300, 1, 3, 0), clustered(np.random.default_rng(2), 12, 40, 16, 0.03), np.ones((5, 4)) / 2, np.eye(3)[:1]])
def test_cover_tree_levels(unit):
    """Nested, covering, separated, with halving radii, down to single points; the traversal finds what brute force finds."""
    tree = covertree.cover_tree(unit)
    gap = np.linalg.norm(unit[:, None] - unit[None], axis=2)
    assert sorted(tree.order) == list(range(len(unit))) and sorted(tree.levels[-1].center) == list(range(len(unit)))
    for up, low in zip(tree.levels, tree.levels[1:]):
        assert low.reach in (up.reach / 2, 0.0) and set(up.center) <= set(low.center)
        for k, c in enumerate(up.center):
            own = tree.order[up.first[k]:up.first[k + 1]]
            assert c in own and np.isclose(gap[c, own].max(), up.radius[k], atol=1e-7)
            assert all(gap[c, d] <= up.reach + 1e-7 for d in low.center[up.child[k]:up.child[k + 1]])
        if low.reach:
            apart = gap[np.ix_(low.center, low.center)] + np.eye(len(low.center)) * 9
            assert apart.min() > low.reach - 1e-7
    for within in (0.05, 0.2, 0.7):
        got = covertree.dual_traversal(tree, tree, within)
        pairs = {frozenset((i, j)) for i, j in zip(got.left.tolist(), got.right.tolist()) if gap[i, j] <= within}
        for a, b, c, d in got.sure:
            pairs |= {frozenset((i, j)) for i in tree.order[a:b] for j in tree.order[c:d] if i != j}
        assert pairs == {frozenset((i, j)) for i in range(len(unit)) for j in range(i) if gap[i, j] <= within}


def test_cover_tree_prunes():
    """On clustered vectors only a small share of all pairs is measured."""
    unit = clustered(np.random.default_rng(3), 60, 50, 32, 0.02)
    tree = covertree.cover_tree(unit)
    assert len(tree.levels) > 4 and covertree.dual_traversal(tree, tree, 0.2).compared < 0.05 * len(unit) ** 2 / 2


@pytest.mark.parametrize("spread, chain", [(0.0115, False), (0.03, False), (0.0001, False), (0, True)])
def test_dense_group_counts_without_its_pairs(spread, chain):
    """A whole cell of near copies (or a long chain of links) ends in seconds and small memory, with the links of brute force."""
    import pandas as pd

    draw = np.random.default_rng(8)
    n = 8192 if not chain else 2000
    if chain:
        turn = np.arange(n) * 0.19 / 60  # each links with its next sixty, so the component is one long chain
        unit = np.stack([np.cos(turn), np.sin(turn)], 1)
    else:
        unit = draw.normal(size=64) + draw.normal(size=(n, 64)) * spread * 8
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    copies = draw.integers(1, 4, n)
    part = pd.DataFrame({"side": 0, "rep": draw.permutation(n), "copies": copies, "embedding": list(unit)})
    tracemalloc.start()
    began = time.time()
    got = covertree.compare((1, 1), part, 0.98).set_index("rep")
    took, (_, peak) = time.time() - began, tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert took < 60 and peak < 400e6
    near = unit @ unit.T >= 0.98
    want = near @ copies - copies
    ids = part["rep"].to_numpy()
    assert {i: w for i, w in zip(ids, want) if w} == got["links"].to_dict()
    if chain:
        assert set(got["other"]) == {0}


def recall(got, ids, v, queries):
    """Share of the true ten nearest; ranks and scores are checked on the way."""
    own = {}
    for r in got:
        own.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = total = 0
    for q in queries:
        d = np.sqrt(((v - v[ids == q][0]) ** 2).sum(1))
        best = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        rows = sorted(own[q])
        assert [r for r, *_ in rows] == list(range(1, len(best) + 1))
        assert all(np.isclose(d[ids == i][0], s, rtol=1e-12) for _, i, s in rows)
        hit += len({i for _, i, _ in rows} & set(ids[best]))
        total += len(best)
    return hit / total


def test_op5_recall(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    v, ids = np.array([r["embedding"] for r in rows], float), np.array([r["vec_id"] for r in rows])
    assert recall(queries.op5_nndescent(spark, small).collect(), ids, v, ids[ids % 100 == 0]) >= 0.9


def test_search_beside_an_outlier(spark, monkeypatch):
    """Double vectors, one of them huge, in cells that are cut as in large tables."""
    monkeypatch.setattr(nndescent, "CELL", 200)
    monkeypatch.setattr(nndescent, "PIVOTS", 16)
    draw = np.random.default_rng(7)
    v = draw.normal(size=(3001, 24))
    v[-1] = 1e7
    ids = np.arange(len(v))
    rows = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v)], "vec_id long, embedding array<double>")
    assert recall(nndescent.search_own(rows).collect(), ids, v, ids[ids % 100 == 0]) >= 0.9
    index = nndescent.build(rows, 24)
    assert index.rounds[-1] < index.rounds[0]
    near = {r["nid"]: set(r["near"]) for r in index.graph.collect()}
    d = ((v[:, None] - v[None]) ** 2).sum(2)
    assert np.mean([len(near[i] & set(np.argsort(d[i])[1:11])) / 10 for i in range(3000)]) >= 0.9


def test_op9_equals_sql(spark, small):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{small}/conversations.parquet')")
    got = queries.op9_chat(spark, small)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.OP9_SQL})").fetchall()
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(want)


def test_chat_escapes_are_reversible(spark):
    draw = random.Random(9)
    parts = ["<|im_end|>", "<|im_start|>", "<", "|", "\\", "0", "1", "\n", "\0", "assistant", "a", "<0", "<1", "<\\|", "é🎉"]
    rows = [(c, t, draw.choice(["user", "assistant", "sys\nterm", ""]), "".join(draw.choice(parts) for _ in range(draw.randint(0, 12)))) for c in range(60) for t in range(draw.randint(1, 4))]
    made = chat.format_turns(chat.canonical(chat.conversation_records(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))
    for r in made.select("conv_id", "formatted", "labels", chat.read_back().alias("turns"), chat.loss_text().alias("loss")).collect():
        own = [(role, t) for c, k, role, t in sorted(rows) if c == r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == own
        assert r["loss"] == "".join(t for role, t in own if role == "assistant")
        assert len(r["labels"]) == len(r["formatted"]) and r["formatted"].count("<|im_start|>") == len(own)


def test_chat_layouts(spark):
    records = [
        ("messages", '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}],"id":7}'), ("from_value", '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}'),
        ("instruction", '{"instruction":"q","output":"a","input":""}'), ("prompt_completion", '{"prompt":"q","completion":"a"}'), ("prompt_response", '{"prompt":"q","response":"a","meta":{"x":1}}'),
        ("question_answer", '{"data":{"question":"q","answer":"a"}}'), ("turns", '{"turns":[{"role":"user","text":"q"},{"role":"assistant","text":"a"}]}'), (None, '{"something":"else"}'), (None, None)]
    got = chat.canonical(spark.createDataFrame(records, "want string, j string").select("want", F.expr("parse_json(j)").alias("record"))).collect()
    for r in got:
        assert r["layout"] == r["want"]
        assert (r["turns"] is None) == (r["want"] is None)
        if r["want"]:
            assert [(t["role"], t["text"]) for t in r["turns"]] == [("user", "q"), ("assistant", "a")]


def test_chat_system_and_input(spark):
    j = '{"system":"s","instruction":"q","input":"i","output":"a"}'
    turns = chat.canonical(spark.createDataFrame([(j,)], "j string").select(F.expr("parse_json(j)").alias("record"))).first()["turns"]
    assert [t["role"] for t in turns] == ["system", "user", "user", "assistant"]


def test_line_templates(spark):
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(600)]
    draw = random.Random(10)

    def prose():
        return " ".join(draw.choice(words) for _ in range(12))

    rows = []
    for i in range(12):
        rows.append((i, "\n".join([prose(), f"Page {i} of 12 printed on host{i}.example.org today", prose(), "Share this with your friends and colleagues", prose()])))
    original = "\n".join(prose() for _ in range(6))
    rows += [(100 + i, original) for i in range(8)]  # copies of one text are left alone
    got = {r["doc_id"]: r for r in linededup.drop_recurring_lines(documents(spark, rows)).collect()}
    for i in range(12):
        assert got[i]["n_dropped"] == 2 and "Share" not in got[i]["text"] and "Page" not in got[i]["text"] and got[i]["text"].count("\n") == 2
    assert all(got[100 + i]["text"] == original and got[100 + i]["n_dropped"] == 0 for i in range(8))


def test_line_template_with_variable_word(spark):
    names = ["anna", "berta", "carla", "dora", "emma", "frida", "greta", "hanna"]
    rows = [(i, f"intro{chr(97 + i)} text{chr(97 + i)} x\nposted by our valued member {n} in the public forum section\nend{chr(97 + i)} of{chr(97 + i)} it") for i, n in enumerate(names)]
    assert all("posted" not in r["text"] for r in linededup.drop_recurring_lines(documents(spark, rows)).collect())


def test_chat_lists_beside_other_fields(spark):
    messages = '"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]'
    records = ['{"system": "s", %s}' % messages, '{"prompt": "p", %s}' % messages, '{"system": "s", "turns": [{"role": "user", "text": "a"}]}', '{"prompt": "p", "response": "r", %s}' % messages]
    rows = spark.createDataFrame(list(enumerate(records)), "id int, raw string").selectExpr("id", "parse_json(raw) AS record")
    got = {r["id"]: (r["layout"], r["turns"] and [tuple(t) for t in r["turns"]]) for r in chat.canonical(rows).select("id", "layout", "turns").collect()}
    lead, own = [("system", "s")], [("user", "a"), ("assistant", "b")]
    assert got == {0: ("messages", lead + own), 1: ("messages", own), 2: ("turns", lead + own[:1]), 3: (None, None)}


def test_line_templates_in_a_busy_leaf(spark):
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(600)]
    draw = random.Random(13)
    names = ["anna", "berta", "carla", "dora", "emma", "frida", "greta", "hanna"]
    kinds = [[f"This is a message posted by {n} in our public forum yesterday" for n in names], [f"This is a letter written for {n} at the old town archive" for n in names],
             [" ".join(["This is a", *draw.sample(words, 9)]) for _ in range(60)]]
    rows = [(100 * k + i, "\n".join([" ".join(draw.sample(words, 14)), line, " ".join(draw.sample(words, 14))])) for k, own in enumerate(kinds) for i, line in enumerate(own)]
    got = {r["doc_id"]: r["n_dropped"] for r in linededup.drop_recurring_lines(documents(spark, rows)).collect()}
    assert got == {i: int(i < 200) for i, _ in rows}


def test_recurring_blocks(spark):
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(600)]
    draw = random.Random(11)

    def prose(n):
        return "\n".join(" ".join(draw.choice(words) for _ in range(12)) for _ in range(n))

    head, foot, passage = "Morning news of the valley\nAll stories", "Share it with friends\nLes.", "first line of a shared passage\nsecond line of it\nthird and last line of it"
    rows = [(i, "\n".join([head, prose(2), passage, prose(2), foot])) for i in range(30)]
    got = {r["doc_id"]: r for r in linededup.drop_recurring_lines(documents(spark, rows)).collect()}
    for i, text in rows:
        assert got[i]["n_dropped"] == 7
        assert got[i]["text"].split("\n") == [x for x in text.split("\n") if x not in "\n".join([head, foot, passage]).split("\n")]


def test_copies_do_not_hide_recurring_lines(spark):
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(600)]
    draw = random.Random(12)

    def prose():
        return [[draw.choice(words) for _ in range(12)] for _ in range(4)]

    def text(lines):
        return "\n".join([*(" ".join(x) for x in lines[:2]), "Printed for all readers of this page", *(" ".join(x) for x in lines[2:])])

    rows = [(i, text(prose())) for i in range(20)]
    original = prose()
    for i in range(60):  # near copies differ in a word anywhere
        copy = [list(x) for x in original]
        copy[draw.randrange(4)][draw.randrange(12)] = f"z{chr(97 + i % 26)}{chr(97 + i // 26)}"
        rows.append((100 + i, text(copy)))
    got = {r["doc_id"]: r for r in linededup.drop_recurring_lines(documents(spark, rows)).collect()}
    for i, own in rows:
        assert got[i]["n_dropped"] == 1 and got[i]["text"] == own.replace("Printed for all readers of this page\n", "")


def test_licence_families(spark):
    lines = [(f, t) for f, own in licences.TEMPLATES.items() for t in own]
    rows = [(i, f"the and of text\nthis is about nothing\n{t}\nmore words here") for i, (_, t) in enumerate(lines)]
    draw = random.Random(3)
    clean = [(1000 + i, "\n".join(" ".join(draw.choice(["thing", "house", "under", "the", "free", "version", "walk", "any"]) for _ in range(12)) for _ in range(3))) for i in range(80)]
    docs = documents(spark, rows + clean)
    got = licences.scan(docs, licences.train(docs)).collect()
    best = {r["doc_id"]: r for r in got if r["line"] == 2 and r["confirmed"]}
    assert sum(best[i]["family"] == f for i, (f, _) in enumerate(lines) if i in best) >= 0.9 * len(lines)
    assert not [r for r in got if r["doc_id"] >= 1000 and r["family"] != "unknown"]


def test_licences_unseen(spark):
    """Notices in words of their own, of families and of licences that training never saw: families are found, others are unknown, probabilities are reliable."""
    own = [("gpl", "The code is released under GPLv3 by its authors"), ("mit", "It is released under the MIT License today"), ("apache", "Everything here is licensed under the Apache License, Version 2.0 by us"),
           ("bsd", "Redistributions of source code must retain the above copyright notice"), ("cc-by-sa", "All photos are licensed under CC BY-SA 4.0."), ("mpl", "SPDX-License-Identifier: MPL-2.0")]
    other = ["Licensed under the Eclipse Public License 2.0", "Licensed under the Common Development and Distribution License", "Released under the Ruby License.", "SPDX-License-Identifier: EPL-2.0", "This is licensed under the Microsoft Public License",
             "Licensed under the Python Software Foundation License Version 2"]
    rows = [(i, t) for i, (_, t) in enumerate(own)] + [(100 + i, t) for i, t in enumerate(other)]
    draw = random.Random(3)
    back = [(1000 + i, " ".join(draw.choice(["thing", "house", "under", "the", "free", "version", "walk", "any"]) for _ in range(12))) for i in range(80)]
    model = licences.train(documents(spark, back))
    got = {r["doc_id"]: r for r in licences.scan(documents(spark, rows), model).collect()}
    assert [got[i]["family"] for i in range(len(own))] == [f for f, _ in own]
    assert all(got[100 + i]["family"] == "unknown" for i in range(len(other)))
    sure = [got[i]["probability"] for i in range(len(own))]
    assert abs(np.mean(sure) - 1) < 0.25  # all right, so the mean probability should be near 1


def test_licence_scores_equal_numpy(spark):
    """The scan against a plain computation of the same model over each line."""
    draw = random.Random(5)
    notices = [t for v in licences.TEMPLATES.values() for t in v] + list(licences.OTHERS)
    rows = []
    for i in range(120):
        w = draw.choice(notices).split()
        rows.append((i, "\n".join(["some words before", " ".join(w[draw.randint(0, 2):] + draw.choices(["walk", "house", "free"], k=draw.randint(0, 4))), "after it"])))
    model = licences.train(documents(spark, rows))
    templates = [(f, set(licences.grams(t))) for f, v in licences.TEMPLATES.items() for t in v]
    want = {}
    for i, text in rows:
        for k, line in enumerate(text.split("\n")):
            g = licences.grams(line)
            z = (sum((model.weights[x] for x in g if x in model.weights), np.zeros(len(licences.FAMILIES))) + model.bias) / model.temperature
            p = licences._softmax(z)
            family = licences.FAMILIES[int(p.argmax())]
            near = max((len(t & set(g)) / min(len(t), len(g)) for f, t in templates if f == family), default=0.0) if g else 0.0
            sure = family != "unknown" and p.max() >= 0.5 and near >= 0.6
            if sure or re.search("licen[cs]e|copyright|rights reserved|warranty", line.lower()):
                want[i, k] = (family if sure else "unknown", round(float(p.max()), 6))
    got = {(r["doc_id"], r["line"]): (r["family"], round(r["probability"], 6)) for r in licences.scan(documents(spark, rows), model).collect()}
    assert got == want


def test_toxicity_scores_equal_numpy(spark):
    draw = random.Random(4)
    rows = [(i, " ".join(draw.choice(["kind", "friendly", "words", "horrible", "hateful", "insult", "neutral"]) for _ in range(30))) for i in range(80)] + [(900, ""), (901, None)]
    labels = spark.createDataFrame([(i, int("hateful" in t)) for i, t in rows[:60]], "doc_id long, toxic int")
    docs = documents(spark, rows)
    model = toxicity.train(docs, labels)
    for r in toxicity.score(docs, model).collect():
        margin = model.bias + model.weights.astype(float)[toxicity.features(r["text"])].sum()
        assert abs(r["score"] - 1 / (1 + math.exp(-(model.slope * margin + model.shift)))) < 1e-9


def test_toxicity_held_out(spark):
    if not os.path.isdir("/root/testdata/sf0.1"):
        pytest.skip("no test data")
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = queries.op10_toxicity(spark, "/root/testdata/sf0.1").join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in got}
    precision, recall = n[1, 1] / (n[1, 1] + n.get((0, 1), 0)), n[1, 1] / (n[1, 1] + n.get((1, 0), 0))
    assert precision >= 0.85 and recall >= 0.85
    assert docs.count() == queries.op10_toxicity(spark, "/root/testdata/sf0.1").count()


def test_toxicity_risk_is_not_negative():
    """Unlabelled rows that are all positive: the bracket is held at zero instead of driving the weights apart."""
    rows = [np.array([1, 2], np.int32)] * 50
    weights, bias = toxicity.fit(rows, rows, 0.5, least_lift=0.5)
    assert np.isfinite(weights).all() and abs(weights).max() < 30 and np.isfinite(bias)


def test_components(spark):
    draw = random.Random(12)
    edges = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(170)] + [(400, 400 + k) for k in range(1, 50)] + [(500 + k, 501 + k) for k in range(40)]
    root = {v: v for e in edges for v in e}
    for _ in range(60):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    alone = {v for e in edges for v in e} - {v for a, b in edges if a != b for v in (a, b)}
    assert got == {v: r for v, r in root.items() if v not in alone}


def test_chat_roles_stay(spark):
    """Roles of the rows come back as they were, whatever the layout that carries them."""
    rows = [(c, t, role, f"{role} {t}") for c in range(24) for t, role in enumerate([["bot", "human"], ["user", "assistant"], ["system", "user", "assistant"], ["user", "model", "gpt"]][c % 3 if c < 12 else 3])]
    made = chat.canonical(chat.mixed_records(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    got = made.select("conv_id", "layout", "turns").collect()
    for r in got:
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(role, text) for c, _, role, text in rows if c == r["conv_id"]]
    assert len({r["layout"] for r in got}) >= 5


def _footers(words: int):
    draw = random.Random(14 + words)
    names = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(600)]
    foot = ["Subscribe to our weekly letter for more stories like this one", "All opinions are those of the authors and of nobody else", "Write to the editors with corrections and further questions", "Printed on paper from well kept forests of the region"]
    bodies = [" ".join(draw.choice(names) for _ in range(words)) for _ in range(60)]
    return foot, [(i, "\n".join([b, *foot])) for i, b in enumerate(bodies)]


@pytest.mark.parametrize("words", [5, 15, 30])
def test_footers_of_short_texts_go(spark, words):
    """A footer far longer than what stands above it recurs, beside texts of the footer alone; edited copies of one such text stay."""
    foot, rows = _footers(words)
    rows += [(100 + i, "\n".join(foot)) for i in range(3)]
    lines = [[f"k{chr(97 + k % 26)}{chr(97 + j)}" for k in range(12)] for j in range(4)]
    for i in range(20):
        copy = [list(x) for x in lines]
        copy[i % 4][i // 4] = f"edit{chr(97 + i)}"
        rows.append((200 + i, "\n".join(" ".join(x) for x in copy)))
    got = {r["doc_id"]: r for r in linededup.drop_recurring_lines(documents(spark, rows)).collect()}
    assert all(got[i]["text"] == text.split("\n")[0] and got[i]["n_dropped"] == 4 for i, text in rows[:60])
    assert all(got[100 + i]["text"] == "" for i in range(3)) and all(got[i]["n_dropped"] == 0 for i, _ in rows[63:])


def test_wrapped_notices_are_found_whole(spark):
    """Notices wrapped as files wrap them, behind comment signs too, are one row with their first and last line."""
    mit = ["Permission is hereby granted, free of charge, to any person", "obtaining a copy of this software and associated documentation", "files (the \"Software\"), to deal in the Software without limits", "and to permit others to do so."]
    gpl = ["This program is free software: you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by", "the Free Software Foundation, either version 3 of the License, or", "(at your option) any later version."]
    bsd = ["Redistribution and use in source and binary forms, with or without", "modification, are permitted provided that the following conditions", "are met:"]
    around = ["The walk went past the house.", "", "A thing of its own stands here."]
    rows = []
    for i, (family, own) in enumerate([("mit", mit), ("gpl", gpl), ("bsd", bsd)]):
        for k, sign in enumerate(["", "# ", " * "]):
            rows.append((10 * i + k, "\n".join([*around, *(sign + x for x in own), "", *around]), family, len(own)))
    draw = random.Random(6)
    back = [(1000 + i, "\n".join(" ".join(draw.choice(["thing", "house", "under", "the", "free", "version", "walk", "any"]) for _ in range(9)) for _ in range(3))) for i in range(80)]
    docs = documents(spark, [r[:2] for r in rows] + back)
    got = {}
    for r in licences.scan(docs, licences.train(docs)).collect():
        got.setdefault(r["doc_id"], []).append((r["family"], r["first_line"], r["last_line"]))
    assert got == {i: [(family, 3, 2 + size)] for i, _, family, size in rows}


def test_components_that_are_stars_take_no_round(spark, monkeypatch):
    made, write = [], common.materialize
    monkeypatch.setattr(common, "materialize", lambda df, name: made.append(name) or write(df, name))
    star = spark.createDataFrame([(a, 1) for a in range(2, 40)] + [(1, 7), (90, 50), (50, 90), (60, 60)], "a long, b long")
    got = {r["node"]: r["component"] for r in common.connected_components(star).collect()}
    assert got == {a: 1 for a in range(1, 40)} | {50: 50, 90: 50} and made == ["cc"]
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    assert {tuple(r) for r in common.connected_components(chain).collect()} == {(k, 0) for k in range(41)} and len(made) > 2


def test_texts_are_not_shuffled_for_few_recurring_lines(spark, monkeypatch):
    """Few positions go to the texts; if they are many, texts are joined to them with the same result."""
    draw = random.Random(4)
    rows = [(k, " ".join("".join(draw.choices("abcdefghij", k=7)) for _ in range(5 if k % 2 else 40)) + "\nkeep the footer of the page here\nand this one below it") for k in range(24)] + [(99, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = linededup.drop_recurring_lines(docs)
        assert "SortMergeJoin" not in few._jdf.queryExecution().executedPlan().toString()
        want = sorted(map(tuple, few.collect()))
        assert [r[-1] for r in want] == [2] * 24 + [0]
        monkeypatch.setattr(linededup, "SMALL_ROWS", 0)
        many = linededup.drop_recurring_lines(docs)
        assert "SortMergeJoin" in many._jdf.queryExecution().executedPlan().toString() and sorted(map(tuple, many.collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_only_shared_lines_are_stored_and_only_texts_in_question_sketched(spark, monkeypatch):
    """Whole lines are kept for leaves of several texts only, texts are sketched for templates that enough texts hold, and lines vote in leaves of three or more."""
    made, write = {}, linededup.materialize

    def noted(df, name):
        out = write(df, name)
        made.setdefault(name, (out.columns, dict(out.dtypes), out.collect()))
        return out

    monkeypatch.setattr(linededup, "materialize", noted)
    draw = random.Random(21)

    def prose():
        return " ".join("".join(draw.choices("abcdefghij", k=6)) for _ in range(14))

    rows = [(i, f"{prose()}\nkeep the footer of this page here\n{prose()}") for i in range(6)]
    rows += [(10 + i, f"{prose()}\nonly two of the texts have this line with {x} in it\n{prose()}") for i, x in enumerate(("one", "two"))]
    got = {r["doc_id"]: r["n_dropped"] for r in linededup.drop_recurring_lines(documents(spark, rows)).collect()}
    assert got == {i: int(i < 10) for i, _ in rows}
    whole = [r for _, types, found in made.values() if "string" in types.values() for r in found]
    assert 0 < len(whole) <= 2  # before: all 24 lines
    assert len(made["sketches"][2]) == 6  # before: 8
    assert made["cells"][2] == [] and len(made["templates"][2]) == 2


def test_leaves_of_two_lines_follow_the_vote(spark):
    """Two lines of a leaf share a template exactly if the tokens at which they agree are as many as the rule asks for."""
    draw = random.Random(22)
    lines, want = [], {}
    for k in range(60):
        n = draw.randrange(3, 14)
        a = [f"lead{chr(97 + k % 26)}{chr(97 + k // 26)}", "of", "it", *("".join(draw.choices("abcdefghij", k=6)) for _ in range(n))]
        b = [*a[:3], *(x if draw.random() < 0.6 else x[::-1] + "z" for x in a[3:])]
        b[3] = a[3][::-1] + "z"
        agree = sum(x == y for x, y in zip(a[3:], b[3:]))
        least = -(-6 * n // 10)
        want[k] = 10 * (agree + 3) >= 6 * (n + 3) or agree >= least
        lines.append((" ".join(a), " ".join(b)))
    assert 10 < sum(want.values()) < 50
    rows = [(100 * i + k, f"{pair[i]}\nown{chr(97 + k % 26)}{chr(97 + k // 26)} {'x' * (k + 1)} {'uvw'[i]}") for k, pair in enumerate(lines) for i in range(2)]
    found = linededup._lines(documents(spark, rows)).where("pos = 0")
    ths = {r["doc_id"]: r["th"] for r in found.collect()}
    template = {r["th"]: r["template"] for r in linededup._templates(documents(spark, rows), found).collect()}
    for k, shared in want.items():
        a, b = template.get(ths[k]), template.get(ths[100 + k])
        assert (a is not None and a == b) == shared and (a is None) == (b is None)


def test_white_space_does_not_tell_lines_apart(spark):
    odd = ["a  b c", "\ta b c", "a\x0bb\x0cc", " a b c ", "a b\r c\r", "a b c"]
    got = {(r["th"], r["leaf"]) for r in linededup._lines(documents(spark, [(i, x) for i, x in enumerate(odd)])).collect()}
    assert len(got) == 1
    other = {(r["doc_id"], r["leaf"], r["th"]) for r in linededup._lines(documents(spark, [(1, "a b c d"), (2, "a b c e"), (3, "a b c d e"), (4, "a b c d e"), (5, "a")])).collect()}
    by = {i: (leaf, th) for i, leaf, th in other}
    assert by[1][0] == by[2][0] and len({leaf for leaf, _ in by.values()}) == 4 and len({th for _, th in by.values()}) == 5


def test_small_tables_of_line_dedup_are_bounded_not_counted(spark, monkeypatch):
    """The driver keeps what every query leaves, so where lines are few their tables aren't counted one by one; with all of them counted and shuffled the result is the same."""
    draw, counts = random.Random(9), []

    def prose():
        return " ".join("".join(draw.choices("abcdefghij", k=6)) for _ in range(14))

    rows = [(i, f"{prose()}\nkeep the footer of this page here\n{prose()}\npage {i} of the {draw.choice(['long', 'short', 'old'])} printed book here") for i in range(8)] + [(9, None)]
    docs = documents(spark, rows)
    kind, count = type(docs), type(docs).count
    monkeypatch.setattr(kind, "count", lambda self: counts.append(1) or count(self))
    few = linededup.drop_recurring_lines(docs)
    assert len(counts) <= 2  # before: 20
    want = sorted(map(tuple, few.collect()), key=str)
    assert sum(r[-1] for r in want) >= 8
    monkeypatch.setattr(linededup, "SMALL_ROWS", 0)
    monkeypatch.setattr(common, "SMALL_ROWS", 0)
    counts.clear()
    assert sorted(map(tuple, linededup.drop_recurring_lines(docs).collect()), key=str) == want and len(counts) > 10


def test_toxicity_fits_in_blocks(monkeypatch):
    """The driver holds narrow copies of a few sampled documents at a time; the weights don't depend on it."""
    rng = np.random.default_rng(5)

    def drawn(n, toxic):
        return [np.unique(np.concatenate([rng.integers(0, toxicity.DIM, 800), rng.integers(0, 60, 8 if toxic else rng.integers(2))])).astype(np.int32) for _ in range(n)] + [np.empty(0, np.int32)]

    positive, unlabelled = drawn(500, True), drawn(3000, False)
    tracemalloc.start()
    weights, bias = toxicity.fit(positive, unlabelled, 0.1, steps=20, least_lift=5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.count_nonzero(weights) >= 50 and peak < 24e6, peak  # before: 35 MB
    monkeypatch.setattr(toxicity, "BLOCK", 10**6)
    whole, shift = toxicity.fit(positive, unlabelled, 0.1, steps=20, least_lift=5)
    assert (whole == weights).all() and shift == bias


def test_toxicity_samples_are_views_of_arrow_buffers():
    parts = [np.array([3, 70000], np.int32), np.empty(0, np.int32), np.array([-1], np.int32)]
    for kind in (pa.binary(), pa.large_binary()):
        column = pa.array([p.tobytes() for p in parts], kind)
        assert [v.tolist() for v in toxicity._views(column)] == [[3, 70000], [], [-1]]
        assert [v.tolist() for v in toxicity._views(column.slice(1))] == [[], [-1]] and toxicity._views(column[:0]) == []
