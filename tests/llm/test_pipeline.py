"""The pipeline against plain versions of its stages, on a planted fixture."""

import random

import corpus_pipeline
import tiktoken
import public_tokenizers
from newsloom.llm import bpe
from tests.llm.test_exact import RANKS, edited, plain_groups, plain_hits, plain_lines, prose


def test_stages(spark, tmp_path):
    rng = random.Random(10)
    shared = " ".join(prose(rng, 20))
    bench = [(i, " ".join(prose(rng, 15))) for i in range(3)]
    rows, bad = [], set()
    for i in range(240):
        words = prose(rng, 90)
        if i % 6 == 1:
            words[5] = "nasty" + rng.choice(["", "er", "est"])
            bad.add(i)
        text = " ".join(words)
        if i % 6 == 2:
            text = " ".join(w.upper() + "!!$$" for w in words)
            bad.add(i)
        if i % 24 == 3:
            text += "\n" + shared
        if i % 24 == 4:
            text += " " + bench[i % 3][1]
        if i % 24 == 6:
            text = " ".join(edited(rng, rows[i - 6][1].split(), 0.01))
        rows.append((i, text))
    rows.append((999, None))
    spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 != 2), int(i % 6 == 1)) for i in range(0, 240)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = [(i, t) for i, t in rows if i not in bad]
    kept = plain_lines(kept)
    groups = plain_groups(kept)
    kept = [(i, t) for i, t in kept if groups[i][1] == i]
    hits = plain_hits(kept, bench, 10)
    kept = [(i, t) for i, t in kept if not hits[i][1]]
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {i: own.encode_ordinary(t) for i, t in kept}


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_without_an_id_pass(spark, tmp_path):
    rows = [(None, "same text of some words here", "en", "s", 1), (None, "same text of some words here", "en", "s", 1), (1, "same text of some words here", "en", "s", 1), (2, "same text of some words here", "en", "s", 1), (3, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(7, "text of some")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    near = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert sorted(str(r.doc_id) for r in near.collect()) == ["1", "3", "None", "None"]
    assert sorted(str(r.doc_id) for r in corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()) == ["3", "None", "None"]
    assert sorted(str(r.doc_id) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == ["3", "None", "None"]
