"""The stages one by one and together, on planted cases and odd rows."""

import random

import pytest

import corpus_pipeline as pipeline
from sheafline.llm import common, pieces

TOXIC = ["grumblewart", "foulmouth", "stinkbrain"]


@pytest.fixture
def folder(spark, tmp_path):
    rnd = random.Random(4)
    parts = ["ka", "lo", "mi", "ne", "ru", "sa", "ti", "vo", "per", "dan", "el", "or"]
    words = lambda n: ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 4))) for _ in range(n)]
    items = [(i, " ".join(words(30))) for i in range(5)]
    rows = []
    for i in range(400):
        w = words(rnd.randint(40, 90))
        if i % 4 == 1:
            for _ in range(4):
                w[rnd.randrange(len(w))] = rnd.choice(TOXIC)
        if i % 40 == 2:
            w[5:5] = items[i % 5][1].split()
        if i % 40 == 3:
            w[5:5] = ["token", "=", "Zk3Qp9XvT7wLm2RsY8Bd"]
        rows.append((i, " ".join(w), "en", "s", None))
    rows += [(1000 + i, rows[8 * i][1], "en", "s", 1) for i in range(20)] + [(2000 + i, rows[8 * i][1] + " one two", "en", "s", 1) for i in range(20)]
    rows += [(None, rows[0][1], None, None, None), (3000, None, "en", None, 0), (3001, "", None, "s", 0), (None, None, None, None, None), (8, rows[8][1], "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, int(i % 4 == 1)) for i in range(0, 400)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_and_run(spark, folder):
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "pieces"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for name, stage in pipeline.STAGES:
        out = common.stored(stage(spark, docs, folder), name)
        if name != "pieces":
            assert out.columns == docs.columns
        seen.append(out)
        docs = out
    ids = [[r["doc_id"] for r in out.collect()] for out in seen]
    assert not any(i is not None and i < 400 and i % 4 == 1 for i in ids[0])
    assert sum(i is not None and i < 400 for i in ids[0]) >= 298
    assert not any(i is not None and 1000 <= i < 3000 for i in ids[1])
    assert sorted(i for i in ids[1] if i is not None and i < 400) == sorted({i for i in ids[0] if i is not None and i < 400})
    assert None not in ids[1] and len([i for i in ids[1] if i in (3000, 3001)]) == 1
    assert set(ids[1]) - set(ids[2]) == {i for i in ids[1] if i < 400 and i % 40 == 2}
    assert ids[3] == ids[2] or sorted(ids[3]) == sorted(ids[2])
    texts = {r["doc_id"]: r for r in seen[3].collect()}
    assert all("[SECRET]" in texts[i]["text"] and "Zk3Qp" not in texts[i]["text"] for i in texts if i < 400 and i % 40 == 3)
    assert all(r["n_chars"] == len(r["text"]) for r in texts.values() if r["text"] is not None)
    final = pieces.decode_pieces(seen[4], __import__("public_tokenizers").path("piece_bpe_32k.model")).collect()
    assert {r["doc_id"]: r["decoded"] for r in final} == {i: r["text"] or "" for i, r in texts.items()}
    run = sorted(map(str, pipeline.run(spark, folder).collect()))
    assert run == sorted(map(str, seen[4].collect()))


def test_empty_documents(spark, folder, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{path}/{name}.parquet")
    assert pipeline.run(spark, path).count() == 0
