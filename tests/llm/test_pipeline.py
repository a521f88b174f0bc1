"""The whole pipeline on small documents, stage by stage against plain versions."""

import hashlib
import random
import re

import pytest

import corpus_pipeline
from ledgerloom.llm import quality
from tests.llm.test_near_copies import expected
from tests.llm.test_text_operators import plain_removed

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    vocab = [f"word{i}" for i in range(400)]
    passage = " ".join(rng.choice(vocab) for _ in range(70))
    rows = []
    for i in range(60):
        words = [rng.choice(vocab) for _ in range(rng.randint(60, 200))]
        text = " ".join(words)
        if i % 6 == 0:
            text = f"{' '.join(words[:40])} {passage} {' '.join(words[40:])}"
        rows.append((i, text, "en", "abc"[i % 3], len(text)))
    copy = rows[7][1].split()
    copy[5] = "changed"
    rows += [(100, " ".join(copy), "en", "a", 0), (101, rows[8][1].upper(), "en", None, 0), (102, "too short", "en", "a", 9), (103, None, None, "b", None), (None, rows[9][1] + " tail", "en", "b", 0), (104, "same line here now " * 40, "en", "c", 0)]
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_every_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialize(stage(spark, tables[-1], folder), name)
        tables.append(out)
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    good = {r.doc_id for r in quality.assess(docs, spark.read.parquet(f"{folder}/labels.parquet")).filter("kept").collect()}
    assert sorted(map(str, rows(tables[1]))) == sorted(str(x) for x in rows(docs) if x[0] in good)
    assert not {102, 103, 104} & good and len(good) >= 55
    kept = expected([x for x in rows(tables[1]) if x[0] is not None])
    assert {i for i, _ in rows(tables[2]) if i is not None} == kept and not {100, 101} & kept
    removed = {i: (n, digest) for i, _, n, digest in plain_removed(rows(tables[2]), 50)}
    for i, t in rows(tables[3]):
        assert hashlib.sha256(" ".join(words_of(t)).encode()).hexdigest() == removed[i][1]
    assert sum(n for n, _ in removed.values()) >= 8 * 70
    assert all(t.columns == docs.columns for t in tables[1:5])
    size = {i: len(words_of(t)) for i, t in rows(tables[3])}
    taken: dict = {}
    for i, t in rows(tables[4]):
        taken[i] = taken.get(i, 0) + len(words_of(t))
    assert all(0 < n <= 2 * size[i] for i, n in taken.items())
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) <= 5
    out = tables[5].collect()
    assert len(out) == tables[4].count() and all(len(r.ids) == r.n_tokens for r in out)


def test_run_is_all_stages(spark, folder):
    assert sorted(corpus_pipeline.run(spark, folder).columns) == ["decoded_sha256", "doc_id", "ids", "ids_sha256", "n_tokens"]
    assert corpus_pipeline.run(spark, folder).count() > 40
