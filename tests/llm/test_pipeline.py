import re

import corpus_pipeline
from flowlens.llm import language_id, pii
from flowlens.llm.tables import table
from test_near_dedup import brute as near_brute
from test_packing import brute_ids

SMALL = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    """Each stage against a plain version on its own input, and the run against the stages."""
    docs = table(spark, SMALL, "documents")
    columns, outs = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        rows = out.collect()
        outs.append((docs.collect(), rows))
        if name != "packing":
            assert out.columns == columns
            docs = spark.createDataFrame(rows, docs.schema)
    (before, after), (_, exact), (_, near), (_, clean), (_, packed) = outs

    judged = {r["doc_id"]: r for r in language_id.identify(table(spark, SMALL, "documents")).collect()}
    kept = [r for r in before if judged[r["doc_id"]]["lang_pred"] != "und" and not judged[r["doc_id"]]["ambiguous"]]
    assert sorted(after) == sorted(kept)

    first = {}
    for r in sorted(after):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or ""), r)
    assert sorted(exact) == sorted(first.values())

    components = near_brute([(r["doc_id"], r["text"]) for r in exact])
    assert sorted(near) == sorted(r for r in exact if components[r["doc_id"]][1] == r["doc_id"])

    model = pii.learn(pii.candidates(spark.createDataFrame(near, docs.schema)))
    assert sorted((r["doc_id"], r["text"]) for r in clean) == sorted((r["doc_id"], pii.redacted(r["text"], model)) for r in near)
    assert not any(pii.base_spans(r["text"]) for r in clean)

    assert sum(r["length"] for r in packed) == sum(len(brute_ids(r["text"])) for r in clean)
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in clean}

    run = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted((r["doc_id"], r["start"] > 0, r["doc_tokens"]) for r in run if r["start"] == 0) == sorted(
        (r["doc_id"], False, r["doc_tokens"]) for r in packed if r["start"] == 0
    )


def written(folder, rows, spark):
    full = [(i, text, lang, None, None, 1, "x") for i, text, lang in rows]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest int, gone_id string"
    spark.createDataFrame(full, schema).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_odd_rows_through_all_stages(spark, tmp_path):
    """Repeated ids with unlike texts, NULLs, names that the stages use, a very long text."""
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in table(spark, SMALL, "documents").limit(60).collect()]
    long = " ".join(f"the {i} of and in wh{i}ing" for i in range(50_000))
    odd = [(5, docs[20][1], "en"), (5, docs[21][1], None), (None, docs[22][1], "en"), (2000, None, "en"), (2001, "", None), (2002, long, "en"), (2002, long, "en")]
    folder = written(tmp_path, docs + odd, spark)
    frame = table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, folder)
        assert out.columns == frame.columns
        frame = spark.createDataFrame(out.collect(), frame.schema)
    # of unlike texts under one id only those with a copy elsewhere are gone
    left = {(r["doc_id"], r["text"]) for r in frame.collect()}
    ids = {i for i, _ in left}
    assert 2000 not in ids and 2001 not in ids and 2002 in ids and None in ids
    run = corpus_pipeline.run(spark, folder).collect()
    pieces = sum(r["length"] for r in run)
    assert pieces == sum(len(brute_ids(r["text"])) for r in frame.collect())


def test_empty_table(spark, tmp_path):
    folder = written(tmp_path, [], spark)
    assert corpus_pipeline.run(spark, folder).count() == 0
