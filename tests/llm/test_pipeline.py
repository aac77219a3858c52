"""The stages of the corpus pipeline against what their operators say about each one's own input."""

import corpus_pipeline
from tidemark.llm import decontaminate, simhash
from tidemark.llm.common import table


def test_stages(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    columns = docs.columns
    seen = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, tiny)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
            docs = docs.cache()
        seen.append(docs.count())
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "near duplicates":
            groups = simhash.near_duplicates(before)
            assert ids == {r.component_id for r in groups.collect()} and len(ids) == seen[-1]
        if name == "decontamination":
            found = decontaminate.contamination(before, table(spark, tiny, "benchmark"))
            assert ids == {r.doc_id for r in found.where("not contaminated").collect()}
        if name == "secrets":
            assert ids == {r.doc_id for r in before.select("doc_id").collect()}
            assert docs.where("text like '%token = \"%'").count() == 0
    assert seen[0] >= seen[1] > seen[2] >= seen[3] == seen[4]


def test_run_and_odd_input(spark, tiny):
    assert corpus_pipeline.run(spark, tiny).count() > 0
    odd = spark.createDataFrame(
        [(1, None, None, None, None, 1.0, 2), (1, "a b c", "en", "s", 5, None, 3), (1, "a b c", "en", "s", 5, None, 3), (None, "a b c", None, None, 5, 0.0, 4), (None,) * 7],
        "doc_id long, text string, lang string, source string, n_chars long, score double, fp int",
    )
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tiny).cache()
        assert docs.columns == odd.columns, name
    assert sorted(map(str, docs.collect())) == sorted(map(str, [odd.collect()[0], odd.collect()[1]]))
    assert corpus_pipeline.STAGES[-1][1](spark, docs, tiny).count() == 2


def test_near_copies_leave_one_row(spark, tiny):
    """Also where a group's chosen row stands many times, or many times with other columns."""
    text = "one two three four five six seven eight nine ten"
    rows = [(7, text, "en", "b", 5)] * 20 + [(7, text, "en", "a", 5), (9, text, "en", "c", 5), (3, "quite another matter of words", "de", "d", 6)]
    rows += [(None, None, None, None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = [tuple(r) for r in corpus_pipeline.drop_near_copies(spark, df, tiny).collect()]
    assert sorted(got, key=str) == sorted([(3, "quite another matter of words", "de", "d", 6), (7, text, "en", "a", 5), (None,) * 5], key=str)


def test_names_and_types_stay(spark, tiny):
    """Columns with the stages' own names, maps, and an int n_chars."""
    text = "one two three four five six seven eight nine ten"
    ddl = "doc_id long, text string, n_chars int, _key long, KEY string, id int, `row` int, n int, kept_id int, kept_key int, _toxicity double, toxicity double, m map<string,int>"
    rows = [(7, text, len(text), 111, "k", 1, 2, 3, 4, 5, 0.5, 0.25, {"a": 1})] * 3 + [(8, text + " x", 5, 112, "k", 1, 2, 3, 4, 5, 0.5, 0.25, {"a": 2})]
    rows += [(9, 'token = "04dbebab91ab85687d33eeaa"', 5, 113, None, 1, 2, 3, 4, 5, None, None, None)]
    df = spark.createDataFrame(rows, ddl)
    docs = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tiny)
        assert docs.schema == df.schema, name
        docs = docs.cache()
    got = sorted(map(tuple, docs.collect()))
    assert got[0] == rows[0] and [r[0] for r in got] in ([7, 9], [7, 8, 9]) and got[-1][2] == len(got[-1][1]) and got[-1][3] == 113
    assert corpus_pipeline.drop_near_copies(spark, df.limit(0), tiny).count() == 0
