"""The pipeline's stages, each on its own input against a plain version, and on odd tables."""

import re

import pytest
from tests.llm.test_dedup import brute_components, word_sets
from tests.llm.test_tokens import PATH, plainly_packed
from tokenizers import Tokenizer

import corpus_pipeline
from histospark.llm.packing import OPEN_BINS
from histospark.llm.pii import pii_report
from histospark.llm.queries import pseudonym_key
from histospark.llm.toxicity import learn

SF = "/root/testdata/sf0.001"


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=repr)


def toxicity(spark, docs, rows, sf_dir):
    lexicon = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return [(i, t) for i, t in rows if lexicon.score(lexicon.density(t or "")) < 0.5]


def exact(spark, docs, rows, sf_dir):
    first = {}
    for i, t in rows:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append((i is None, i or 0, t))
    return [(None if none else i, t) for none, i, t in (min(x, key=lambda y: y[:2]) for x in first.values())]


def near(spark, docs, rows, sf_dir):
    """Rows are told by their place, which is their rank by id, so that the least place has the least id."""
    places = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    sets = word_sets([(k, rows[p][1]) for k, p in enumerate(places)])
    return [rows[p] for k, p in enumerate(places) if brute[k] == k] if (brute := brute_components(sets)) else []


def pseudonyms(spark, docs, rows, sf_dir):
    return [tuple(r) for r in pii_report(docs, pseudonym_key(spark)).select("doc_id", "text").collect()]


PLAIN = {"toxicity": toxicity, "exact_dedup": exact, "jaccard_join": near, "pseudonyms": pseudonyms}


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        want = sorted(PLAIN[name](spark, docs, pairs(docs), SF), key=repr)
        docs = corpus_pipeline.stored(stage(spark, docs, SF), "test-stage")
        assert docs.columns == columns and pairs(docs) == want, name
    library = Tokenizer.from_file(PATH)
    lengths, names = [], []
    for i, t in sorted(pairs(docs)):
        n = len(library.encode(t or "", add_special_tokens=False).ids) + 1
        for piece, start in enumerate(range(0, n, 4096)):
            lengths.append(min(4096, n - start))
            names.append((i, piece, start, lengths[-1]))
    plain, used = plainly_packed(lengths, 4096, OPEN_BINS)
    got = sorted(corpus_pipeline.run(spark, SF).collect(), key=lambda r: (r["doc_id"], r["piece"]))
    assert [(r["doc_id"], r["piece"], r["start"], r["length"]) for r in got] == names
    assert [r["offset"] for r in got] == [best for best, _ in plain] and len({r["sequence_id"] for r in got}) == len(used)


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    """Null ids and texts, repeated ids and rows, a long text, columns with clashing names; and labels that fit."""
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long), (1, long), (2, long), (2, "b c d e f"), (3, "b c d e  f"), (3, "x y z 10.0.0.1 u"), (4, None), (4, ""), (None, "d"), (None, "d"), (None, long + " z"), (5, " ".join(f"v{i}" for i in range(30_000))), (6, " \t ")]
    schema = "doc_id long, text string, n_chars int, _i string, _toxic int, _row long, _id string, _gone long, _text string, label int, _bands int, _s int"
    docs = spark.createDataFrame([(i, t, None if t is None else len(t), "a", 1, 7, "b", k, "c", 3, 4, 5) for k, (i, t) in enumerate(rows)], schema)
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(1, 0, 1), (1, 0, 0), (2, 1, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(folder + "/labels.parquet")
    return docs, rows, folder


def test_stages_on_odd_rows(spark, odd_tables):
    docs, rows, folder = odd_tables
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, folder)
        assert got.columns == docs.columns and got.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
        want = PLAIN[name](spark, docs, rows, folder)
        ids, texts = (sorted(repr(r[k]) for r in pairs(got)) for k in (0, 1))
        assert ids == sorted(repr(i) for i, _ in want), name
        if name == "pseudonyms":
            assert texts == sorted(repr(t) for _, t in want)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == len(rows) - 1 + len(range(0, len(Tokenizer.from_file(PATH).encode(rows[11][1], add_special_tokens=False).ids) + 1, 4096))


def test_stages_on_an_empty_table(spark, odd_tables):
    docs, _, folder = odd_tables
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs.limit(0), folder)
        assert got.count() == 0 and (name == corpus_pipeline.STAGES[-1][0] or got.columns == docs.columns)


def test_workers_give_freed_memory_back(spark):
    def held(batches):
        import os

        import numpy as np
        import pyarrow as pa

        import histospark.llm  # noqa: F401

        def resident():
            with open("/proc/self/statm") as f:
                return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20

        for _ in batches:
            before, pins = resident(), []
            for _ in range(3):
                blocks = []
                for _ in range(80):  # small objects that stay, between large ones that go
                    blocks += [np.ones(3 << 17), pa.array(np.ones(3 << 17)).cast(pa.float32())]
                    pins.append(np.ones(500))
                del blocks
            yield pa.RecordBatch.from_arrays([pa.array([resident() - before], pa.int64()), pa.array([pa.default_memory_pool().backend_name])], ["mb", "pool"])

    got = spark.range(1).coalesce(1).mapInArrow(held, "mb long, pool string").first()
    assert got["pool"] == "system" and got["mb"] < 40
    import pyarrow

    assert pyarrow.default_memory_pool().backend_name != "system"  # the driver's process is as it was


def test_packing_leaves_no_tables_in_idle_workers(spark, docs):
    from histospark.llm import packing
    from histospark.llm.queries import WORD_BPE

    def left(batches):
        import pyarrow as pa

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(t) + len(t.older) for tables in packing._TABLES.values() for t in tables)], pa.int64())], ["n"])

    assert packing.pack(docs, WORD_BPE).count() > docs.count()
    assert {r["n"] for r in spark.range(40).repartition(4).mapInArrow(left, "n long").collect()} == {0}
