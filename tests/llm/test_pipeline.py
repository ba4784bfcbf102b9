"""The pipeline against its stages by brute force, on a small fixture."""

import random

import pytest

import corpus_pipeline as cp

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(11)
    plain = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(4, 9))) for _ in range(500)]
    rows, labels = [], []
    for i in range(160):
        words = rng.choices(plain, k=60)
        toxic = i % 4 == 0 and i < 120
        for k in range(0, 60, 12) if toxic else ():
            words[k] = rng.choice(["zorkblat", "quxferno", "vexmorph"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    shared = "this very line is shared by many of the documents here"
    rows += [(200 + i, "\n".join([shared, " ".join(rng.choices(plain, k=50))])) for i in range(4)]
    copy = " ".join(rng.choices(plain, k=80))
    rows += [(300, copy), (301, copy), (302, copy + " tail"), (303, "write to someone@mail.example.com now " + " ".join(rng.choices(plain, k=30))), (304, None), (305, "")]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCUMENTS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_and_run(spark, sf_dir, tmp_path):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "minhash_near_dedup", "pii", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs
        if name != "packing":
            assert docs.columns == list(cp.COLUMNS)
    ids = {n: {r["doc_id"] for r in d.select("doc_id").collect()} for n, d in kept.items()}
    toxic = {i for i in range(0, 120, 4)}
    assert not (ids["toxicity"] & toxic) and len(ids["toxicity"]) == 170 - len(toxic)
    lines = {r["doc_id"]: r["text"] for r in kept["line_dedup"].collect()}
    assert [("shared by many" in lines[200 + i]) for i in range(4)] == [False, False, False, True]
    assert ids["line_dedup"] - ids["minhash_near_dedup"] == {301, 302}
    clean = {r["doc_id"]: (r["text"], r["n_chars"]) for r in kept["pii"].collect()}
    assert "<EMAIL>" in clean[303][0] and "someone@" not in clean[303][0] and clean[303][1] == len(clean[303][0]) and clean[304] == (None, None)
    sizes = {i: len((t or "").encode()) + 1 for i, (t, _) in clean.items()}
    packed = kept["packing"].toPandas()
    assert packed.groupby("doc_id").length.sum().to_dict() == sizes
    whole = cp.run(spark, sf_dir).toPandas()
    order = ["doc_id", "piece"]
    assert whole.sort_values(order).reset_index(drop=True).equals(packed.sort_values(order).reset_index(drop=True))
