"""Nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from selvage.llm import bpe, chat, covertree, licences, linededup, minhash, nndescent, packing, pii, queries, toxicity

public = pytest.importorskip("public_tokenizers")
LONG = "lorem ipsum dolor sit amet " * 20_000
ROWS = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "Same text on every row here, mail a.b@c.de.", "en", "a", 43), (4, "Same text on every row here, mail a.b@c.de.", "en", "a", 43),
    (5, "Same text on every row here, mail a.b@c.de.", None, "b", 43), (6, LONG, "en", "a", len(LONG)), (7, "x" * 200_000, "en", "a", 200_000), (None, "no id at all in this row", "en", "a", 24), (8, "1\n" * 3000, "en", None, 6000)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "_id string, _dh long, _h long, _lines int, score string, id long, rep long, kind string, rank int, salt int, component_id long, length int, line int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def clashing(spark):
    extra = tuple(None for _ in CLASH.split(","))
    return spark.createDataFrame([r + extra for r in ROWS], f"{SCHEMA}, {CLASH}")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


LABELS = "doc_id long, quality int, toxic int"


def labels(spark, rows=((4, 1, 1), (4, 1, 0), (6, 1, 0), (7, None, None), (None, 1, 1))):
    return spark.createDataFrame(list(rows), LABELS)


WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"
OPERATORS = {
    "pii": lambda s, d: pii.find(d, pii.train(d)), "redact": lambda s, d: pii.redact(d, pii.train(d)), "bpe": lambda s, d: bpe.encode_decode(d, public.path(BYTE)),
    "minhash": lambda s, d: minhash.near_duplicates(d), "lines": lambda s, d: linededup.drop_recurring_lines(d), "licences": lambda s, d: licences.scan(d, licences.train(d)),
    "packing": lambda s, d: packing.pack_documents(d, public.path(WORD)), "toxicity": lambda s, d: toxicity.score(d, toxicity.train(d, labels(s)))}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_document_operators(spark, docs, clashing, empty, name):
    run = OPERATORS[name]
    got = run(spark, docs)
    rows = got.collect()
    if name not in ("licences", "packing"):
        assert len(rows) == len(ROWS)
    keys = [c for c in got.columns if c not in CLASH]
    plain = sorted(map(str, got.select([c for c in got.columns if c in ("doc_id", "text", "n_shingles", "n_dropped", "ids", "base")]).collect()))
    again = run(spark, clashing)
    assert sorted(map(str, again.select([c for c in got.columns if c in ("doc_id", "text", "n_shingles", "n_dropped", "ids", "base")]).collect())) == plain and keys
    assert run(spark, empty).collect() == []


def test_defined_results(spark, docs):
    near = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()}
    assert {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (5, 4, 4, False), (None, 3, None, True)} <= {(d, n if d != 5 else 4, c, k) for d, n, c, k in near}
    packed = packing.pack_documents(docs, public.path(WORD)).collect()
    assert [r["length"] for r in packed if r["doc_id"] in (1, 2)] == [1, 1]
    assert max(r["offset"] + r["length"] for r in packed) <= 4096
    cut = {r["doc_id"]: r for r in linededup.drop_recurring_lines(docs).collect()}
    assert cut[1]["text"] is None and cut[1]["n_lines"] == 0 and cut[2]["text"] == "" and cut[7]["text"] == "x" * 200_000
    assert [r["ids"] for r in bpe.encode_decode(docs.where("doc_id = 1"), public.path(BYTE)).collect()] == [[]]
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs, pii.fit([])).collect()}
    assert clean[4] == "Same text on every row here, mail <EMAIL>." and clean[1] is None
    scores = [r["score"] for r in toxicity.score(docs, toxicity.train(docs, labels(spark))).collect()]
    assert all(0 <= s <= 1 for s in scores)


def test_no_labels(spark, docs):
    assert toxicity.score(docs, toxicity.train(docs, labels(spark, ()))).count() == len(ROWS)


VECTORS = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [float("nan"), 1.0], 1), (6, [1.0, None], 1), (7, [1.0, 0.001], None), (8, [], 1), (100, [1.0, 0.001], 1), (200, [0.0, 1.0], 1), (300, [1.0, 0.0, 0.0], 1)]
VECTOR = "vec_id long, embedding array<float>, label int"


def test_vectors(spark):
    rows = spark.createDataFrame(VECTORS, VECTOR).withColumn("rep", F.lit("x")).withColumn("block", F.lit(0)).withColumn("nid", F.lit(0))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in covertree.linked_vectors(rows).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 100: (2, 1), **{i: (0, i) for i in (3, 4, 5, 6, 7, 8, 200, 300)}}
    near = nndescent.search_own(rows, every=100, k=3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in near] == [(100, 7), (100, 1), (100, 2), (200, 7), (200, 100), (200, 1)]


def test_empty_vectors(spark):
    none = spark.createDataFrame([], VECTOR)
    assert covertree.linked_vectors(none).collect() == [] and nndescent.search_own(none).collect() == []
    one = spark.createDataFrame([(100, [1.0, 2.0], 1)], VECTOR)
    assert nndescent.search_own(one).collect() == []


def test_ties_go_to_the_smaller_id(spark):
    rows = spark.createDataFrame([(100, [0.0, 1.0], 1)] + [(i, [1.0, 1.0] if i % 2 else [-1.0, 1.0], 1) for i in range(1, 30)], VECTOR)
    assert [r["vec_id"] for r in nndescent.search_own(rows, k=10).orderBy("rank").collect()] == list(range(1, 11))


def test_conversations(spark):
    schema = "conv_id long, turn long, role string, text string, formatted int"
    rows = [(1, 1, "assistant", None, 0), (1, 0, "user", "q", 0), (1, 0, "user", "q", 0), (None, 0, None, "x", 0), (2, None, "assistant", "a" * 100_000, 0), (2, 5, "assistant", "", 0)]
    got = chat.format_turns(chat.canonical(chat.conversation_records(spark.createDataFrame(rows, schema)))).select("conv_id", chat.read_back().alias("t"), chat.loss_text().alias("l")).collect()
    by = {r["conv_id"]: r for r in got}
    assert [(t["role"], t["text"]) for t in by[1]["t"]] == [("user", "q"), ("user", "q"), ("assistant", "")] and by[1]["l"] == ""
    assert by[2]["l"] == "a" * 100_000 and [t["text"] for t in by[None]["t"]] == ["x"]
    assert chat.conversation_records(spark.createDataFrame([], schema)).collect() == []


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, docs):
    path = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{path}/documents.parquet")
    labels(spark).write.parquet(f"{path}/labels.parquet")
    return path


@pytest.mark.parametrize("name, stage", C.STAGES)
def test_stages(spark, docs, clashing, empty, folder, name, stage):
    got = stage(spark, docs, folder)
    rows = got.collect()
    if name != "best-fit packing":
        assert got.columns == C.COLUMNS
    if name in ("line dedup", "pii"):
        assert len(rows) == len(ROWS)
    if name == "minhash near-dedup":
        ids = [r["doc_id"] for r in rows]
        assert ids.count(4) == 1 and 5 not in ids and None in ids and {1, 2, 3, 6, 7, 8} <= set(ids)
    assert sorted(r["doc_id"] or -1 for r in stage(spark, clashing, folder).collect()) == sorted(r["doc_id"] or -1 for r in rows)
    assert stage(spark, empty, folder).collect() == []


def test_pipeline_is_its_stages(spark, folder):
    from selvage.llm.common import materialize

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in C.STAGES:
        docs = materialize(stage(spark, docs, folder), "test")
    assert sorted(map(str, docs.select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(map(str, C.run(spark, folder).select("doc_id", "piece", "length", "ids_crc32").collect()))


def test_pipeline_against_brute_force(spark, small):
    """The parts of each stage's decision that plain Python can repeat."""
    import re

    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = {r["doc_id"] for r in C.toxic(spark, docs, small).collect()}
    scored = toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{small}/labels.parquet").where(~toxicity.held_out())))
    assert kept == {r["doc_id"] for r in scored.collect() if r["score"] < C.TOXIC_FROM}

    def words(t):
        w = (t or "").encode().lower().split()
        return {tuple(w)} - {()} if len(w) < 5 else {tuple(w[k:k + 5]) for k in range(len(w) - 4)}

    sets = {r["doc_id"]: words(r["text"]) for r in docs.collect()}
    left = {r["doc_id"] for r in C.near(spark, docs, small).collect()}
    for a in sorted(left):
        for b in left:
            i = len(sets[a] & sets[b])
            assert a == b or not i or 100 * i < 80 * (len(sets[a]) + len(sets[b]) - i)
    clean = {r["doc_id"]: r["text"] for r in C.private(spark, docs, small).collect()}
    assert not [t for t in clean.values() if t and re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]


def test_registered_names():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_near_stage_keeps_other_texts_of_an_id(spark, folder):
    words = " ".join(f"w{k}" for k in range(60))
    rows = [(5, "first text of the id, quite alone here", None, "a", 1), (5, "second text of the same id and unlike the first", None, "a", 1), (5, words, None, "a", 1), (9, words + " end", None, "a", 1), (5, words, None, "a", 1), (5, None, None, "a", 0)]
    got = [(r["doc_id"], r["text"]) for r in C.near(spark, spark.createDataFrame(rows, SCHEMA), folder).collect()]
    assert len(got) == 4 and {(5, rows[0][1]), (5, rows[1][1]), (5, None)} <= set(got) and sum(t is not None and t.startswith("w0") for _, t in got) == 1


def test_hot_id_in_samples(spark):
    """A repeated id gives one text to the samples, whatever its number of rows."""
    rows = [(1, "call +1 415 555 0123 now", "en", "a", 1)] * 500 + [(i, f"text {i}", "en", "a", 1) for i in range(2, 40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert pii.find(docs, pii.train(docs)).count() == len(rows)
    assert toxicity.score(docs, toxicity.train(docs, labels(spark, ((1, 1, 1), (2, 1, 0))))).count() == len(rows)


def test_unset_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from selvage.llm import common

    conf = SimpleNamespace(get=lambda *_: None)
    with pytest.raises(RuntimeError):
        common.shared_root(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://x", getConf=lambda: conf)))
