"""Each stage of the pipeline for itself: nulls, empty and very long texts, repeated rows, clashing names, empty tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vectide.llm.queries import tokenizer_path

FOLDER = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, n_lines string, n_removed int, fp string, "
          "component_id long, text_key int, chunk string, n long, grade int, gone string")


@pytest.fixture(scope="module")
def real(spark):
    return [r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").limit(40).collect()]


def frame(spark, texts, ids=None):
    return spark.createDataFrame(
        [(i, t, "en", None, len(t) if t is not None else None, "mine", 7, "fp", 9, 3, "c", 4, 5, "g") for i, t in zip(
            range(len(texts)) if ids is None else ids, texts)], SCHEMA)


def run(spark, name, df):
    out = STAGES[name](spark, df, FOLDER)
    assert name == "tokens" or out.columns == df.columns
    return out.collect()


def ids(rows):
    return sorted(r["doc_id"] for r in rows if r["doc_id"] is not None)


@pytest.mark.parametrize("name", STAGES)
def test_stage_with_odd_rows(spark, real, name):
    texts = [None, "", " \n\t", "one", "one", *real[:10], "long " * 200_000, real[3], real[3]]
    given = [*range(len(texts) - 3), None, 3, 3]
    rows = run(spark, name, frame(spark, texts, given))
    assert set(ids(rows)) <= {i for i in given if i is not None}
    if name != "tokens":
        assert all(r["n_lines"] == "mine" and r["n_removed"] == 7 and r["component_id"] == 9 and r["gone"] == "g" for r in rows)
    assert run(spark, name, frame(spark, texts).limit(0)) == []


def test_quality_keeps_most_clean_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = set(ids(STAGES["quality"](spark, docs, FOLDER).collect()))
    clean = [i for i, (q, t) in labels.items() if q == 1 and not t]
    toxic = [i for i, (q, t) in labels.items() if t]
    assert sum(i in kept for i in clean) >= 0.9 * len(clean) and sum(i in kept for i in toxic) <= 0.5 * len(toxic)


def test_lines_that_repeat_alone_go_and_counts_follow(spark):
    rows = run(spark, "lines", frame(spark, ["a b\nc d", "a b\nnew one", "c d", "", None, "\n\nc d\n"]))
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in rows} == {0: ("a b\nc d", 7), 1: ("new one", 7), 3: ("", 0), 4: (None, None)}


def test_one_document_of_each_linked_group_stays(spark, real):
    base = real[5]
    texts = [base, base, base + "!", real[6], real[6].upper(), real[7], None, "", " "]
    rows = run(spark, "near-duplicates", frame(spark, texts, [8, 2, 30, 4, 5, 6, 7, 9, 10]))
    groups = {}
    from vectide.llm.simhash import RADIUS, fingerprint

    prints = {i: fingerprint((t or "").encode()) for i, t in zip([8, 2, 30, 4, 5, 6, 7, 9, 10], texts)}
    root = {i: i for i in prints}
    for _ in prints:
        for i in prints:
            for j in prints:
                if (prints[i] ^ prints[j]).bit_count() <= RADIUS:
                    root[i] = root[j] = min(root[i], root[j])
    for i, r in root.items():
        groups.setdefault(r, []).append(i)
    assert ids(rows) == sorted(groups) and {2, 4, 7} <= set(ids(rows))


def test_documents_with_a_passage_of_the_benchmark_go(spark, real):
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").orderBy("item_id").first()["text"]
    clean = "entirely other words that no item of any list has ever held in this order at all"
    rows = run(spark, "decontamination", frame(spark, [clean, f"before {item.upper()} behind", None, "", item]))
    assert ids(rows) == [0, 2, 3]


def test_tokens_are_those_of_the_library(spark, real):
    import hashlib

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokenizer.no_truncation()
    texts = [None, "", *real[:5]]
    for r in run(spark, "tokens", frame(spark, texts)):
        got = tokenizer.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(got) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, got)).encode()).hexdigest()


def test_run_applies_every_stage_to_what_the_one_before_kept(spark):
    left = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name in list(STAGES)[:-1]:
        left = STAGES[name](spark, left, FOLDER)
    want = sorted(map(tuple, STAGES["tokens"](spark, left, FOLDER).collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).collect())) == want
