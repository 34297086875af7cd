import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from tests.llm import test_decontam, test_ngram_join, test_secret_scan


BY_STAGE: list = []


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = random.Random(11)
    say = lambda k: " ".join(f"w{rng.randint(0, 400)}" for _ in range(k))
    item = say(14)
    docs = [(i, say(rng.randint(30, 90)), "en" if i % 3 else "de", f"src{i % 4}") for i in range(300)]
    kind = {i: "good" for i in range(300)}
    for i in range(0, 300, 5):
        kind[i] = "toxic"
        words = docs[i][1].split()
        docs[i] = (i, " ".join([*words, "vile", "rotten", "dumb"]), *docs[i][2:])
    for i in range(1, 300, 50):
        docs[i] = (i, docs[i][1] + " " + item + " end", *docs[i][2:])
        docs[i + 1] = (i + 1, docs[i + 1][1] + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', *docs[i + 1][2:])
        docs[i + 2] = (i + 2, docs[i + 1][1], *docs[i + 2][2:])  # a copy
    docs.append((900, None, None, None))
    out = tmp_path_factory.mktemp("tables")
    write = lambda name, rows, schema: pq.write_table(pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema), out / f"{name}.parquet")
    write("documents", [(*d, len(d[1] or "")) for d in docs], pa.schema([("doc_id", "int64"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "int64")]))
    write("labels", [(i, 1, int(kind[i] == "toxic")) for i in range(250)], pa.schema([("doc_id", "int64"), ("quality", "int64"), ("toxic", "int64")]))
    write("benchmark", [(1, item)], pa.schema([("item_id", "int64"), ("text", "string")]))
    return str(out), docs, kind, item


def test_each_stage_works_on_what_was_kept(spark, folder):
    path, rows, kind, item = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    (_, quality), (_, near), (_, clean), (_, secrets), (_, mixture) = corpus_pipeline.STAGES

    kept = quality(spark, docs, path)
    assert kept.columns == columns
    ids = {r.doc_id for r in kept.collect()}
    assert {i for i, k in kind.items() if k == "good"} <= ids and not ids & {i for i, k in kind.items() if k == "toxic"}

    kept = spark.createDataFrame(kept.collect(), docs.schema)
    after = near(spark, kept, path).collect()
    texts = [(r.doc_id, r.text) for r in kept.collect()]
    assert {r.doc_id for r in after} == {d for d, _, c in test_ngram_join.brute(texts, 80, 5) if d == c}

    kept = spark.createDataFrame(after, docs.schema)
    after = clean(spark, kept, path).collect()
    assert len(after) == len(kept.collect())  # none holds only the item
    hit = test_decontam.brute([(r.doc_id, r.text) for r in after], [(1, item)])
    assert not any(h[5] for h in hit)

    after = secrets(spark, spark.createDataFrame(after, docs.schema), path).collect()
    assert not any(sum(test_secret_scan.brute(r.text)[0][:3]) for r in after)
    assert all(r.n_chars == len(r.text or "") for r in after)

    rated = mixture(spark, spark.createDataFrame(after, docs.schema), path).collect()
    BY_STAGE.extend(rated)
    assert rated and all(r.rate > 0 and abs(r.copies - r.rate) < 1 for r in rated)
    texts = {r.doc_id: r.text for r in after}
    assert all(texts[r.doc_id] == r.text for r in rated)
    spent = sum(r.rate * r.n_tokens for r in rated)
    assert spent == pytest.approx(sum(r.n_tokens for r in rated), rel=0.5)


def test_run_gives_what_the_stages_give(spark, folder):
    path, rows, kind, _ = folder
    rows = corpus_pipeline.run(spark, path).collect()
    got = {r.doc_id for r in rows}
    assert got and not got & {i for i, k in kind.items() if k == "toxic"}
    if BY_STAGE:  # what the test before this one got, stage by stage
        assert {(r.doc_id, r.text, r.n_chars, round(r.rate, 6)) for r in rows} == {(r.doc_id, r.text, r.n_chars, round(r.rate, 6)) for r in BY_STAGE}


def test_run_on_empty_tables_and_very_long_texts(spark, folder, tmp_path):
    path, *_ = folder
    for name in ("documents", "labels", "benchmark"):
        pq.write_table(pq.read_table(f"{path}/{name}.parquet").slice(0, 0), tmp_path / f"{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = pq.read_table(f"{path}/documents.parquet").slice(0, 40)
    long = " ".join(f"w{i % 397} token=abcdef{i}" for i in range(30000))
    more = pa.Table.from_pylist([{"doc_id": 5000 + i, "text": long, "lang": "en", "source": "src1", "n_chars": len(long)} for i in range(2)], docs.schema)
    pq.write_table(pa.concat_tables([docs, more]), tmp_path / "documents.parquet")
    for name in ("labels", "benchmark"):
        pq.write_table(pq.read_table(f"{path}/{name}.parquet"), tmp_path / f"{name}.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 5000 in got and 5001 not in got and "abcdef" not in got[5000].text and got[5000].n_chars == len(got[5000].text)
