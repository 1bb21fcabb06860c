"""The five stages of the corpus pipeline on planted cases: what each drops, and that clean rows and all their ids stay."""

import numpy as np

import corpus_pipeline

WORDS = [f"w{i}" for i in range(400)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def test_stages(spark, tmp_path):
    base, item = prose(120, 1), prose(30, 2)
    near = base.split()
    near[7], near[80] = "other", "words"
    toxic = "you idiot moron scum vermin bastard worthless pathetic loser " * 4
    rows = [(1, base), (2, base.replace(" ", "  ")), (3, " ".join(near)), (4, toxic), (5, prose(50, 3) + " " + item + " " + prose(20, 4)), (6, prose(90, 5)), (7, None), (7, prose(60, 6)), (None, prose(40, 7)), (8, "a"), (9, "")]
    put = lambda name, data, schema: spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    put("documents", [(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    put("labels", [], "doc_id long, quality int, toxic int")
    put("benchmark", [(1, item)], "item_id long, text string")
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"stage{k}"))
        after = spark.read.parquet(str(tmp_path / f"stage{k}"))
        if k < 4:
            assert after.columns == docs.columns
            kept.append(sorted((r.doc_id is None, r.doc_id or 0, len(r.text or "")) for r in after.collect()))
        docs = after
    size = {(i is None, i or 0, len(t or "")) for i, t in rows}
    gone = [sorted(x[1] for x in before - set(now)) for before, now in zip([size, *map(set, kept)], kept)]
    assert gone[:2] == [[4], [1, 9]]  # of equal texts the longest original stays, then the least id
    assert gone[2] == [3] and gone[3] == [5]
    assert {r.doc_id for r in docs.collect()} == {2, 6, 7, 8, None}
