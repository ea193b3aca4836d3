"""Every stage of the pipeline on odd rows, clashing columns and no rows."""

import pytest
from llm_cases import DATA, ODD, nothing, odd  # noqa: F401

import corpus_pipeline

STAGES = dict(corpus_pipeline.STAGES)
FILTERS = [n for n in STAGES if n != "sequence_packing"]


def rows(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", list(STAGES))
def test_no_documents(spark, nothing, name):
    out = STAGES[name](spark, nothing, DATA)
    assert out.count() == 0 and (name not in FILTERS or out.columns == nothing.columns)


@pytest.mark.parametrize("name", FILTERS)
def test_stages_keep_columns_and_only_rows_they_were_given(spark, odd, name):
    out = STAGES[name](spark, odd, DATA)
    assert out.columns == odd.columns and out.dtypes == odd.dtypes
    kept, given = rows(out), rows(odd)
    assert all(r in given for r in kept)
    assert {r.n_words for r in out.collect()} <= {"n"}


def test_quality_drops_texts_without_words(spark, odd):
    assert not {d for d, _ in rows(STAGES["quality_rules"](spark, odd, DATA))} & {1, 2, 3}


def test_lines_leave_odd_rows_alone(spark, odd):
    assert rows(STAGES["line_dedup"](spark, odd, DATA)) == sorted(ODD, key=str)


def test_lines_of_ten_documents_stay_in_the_first(spark, frame):
    docs = frame([(k, f"own line {k}\n Shared LINE \t", 5) for k in range(12)] + [(None, "shared line", 11)], "doc_id bigint, text string, n_chars int")
    got = {r.doc_id: (r.text, r.n_chars) for r in STAGES["line_dedup"](spark, docs, DATA).collect()}
    assert got[None] == ("shared line", 11)
    assert {k: got[k] for k in range(12)} == {k: (f"own line {k}", len(f"own line {k}")) for k in range(12)}


def test_near_duplicates_keep_one_row_of_each_group(spark, odd):
    got = rows(STAGES["simhash_near_dedup"](spark, odd, DATA))
    # Texts without words are one group, equal texts another; the second text of id 5 is a group of its own.
    assert [d for d, t in got if not (t or "").strip()] == [1]
    assert sum(t == "same words in two rows here" for _, t in got) == 1 and (5, "same words in two rows here") in got
    assert len(got) == len(set(got))


def test_decontamination_leaves_clean_rows(spark, odd):
    assert rows(STAGES["benchmark_decontamination"](spark, odd, DATA)) == sorted(ODD, key=str)


def test_decontamination_tells_texts_of_one_id_apart(spark, frame):
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").first().text
    docs = frame([(1, f"before {item} after"), (1, "a clean text under the same id"), (None, item), (None, None)], "doc_id bigint, text string")
    assert rows(STAGES["benchmark_decontamination"](spark, docs, DATA)) == sorted([(1, "a clean text under the same id"), (None, None)], key=str)


def test_packing_places_every_row(spark, odd):
    got = STAGES["sequence_packing"](spark, odd, DATA).toPandas()
    assert got[got.start == 0].shape[0] == len(ODD)
    assert got.groupby("sequence_id").length.sum().max() <= corpus_pipeline.WINDOW
    assert sorted(got[got.doc_id.isin([1, 2])].doc_tokens) == [1, 1]


def test_one_worker_of_a_task_makes_statistics_and_score(spark, frame):
    from tableloom.llm import quality

    trees = quality.Trees(0.0, quality.np.zeros((1, 1), int), quality.np.zeros((1, 1)), quality.np.array([[-1.0, 1.0]]))
    rows = quality.score(frame([(1, "a b c " * 9), (2, None)], "doc_id bigint, text string"), trees)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert [r.n_words for r in rows.orderBy("doc_id").collect()] == [27, 0]


def test_whole_texts_go_to_workers_in_bounded_batches(spark, frame):
    def sizes(batches):
        for b in batches:
            yield type(b).from_pydict({"n": [b.nbytes]})

    rows = spark.range(0, 4000, 1, 1).selectExpr("repeat('x', 8000) AS text")
    assert max(r.n for r in rows.mapInArrow(sizes, "n bigint").collect()) < 8 << 20
