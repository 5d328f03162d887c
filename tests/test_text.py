"""Steps, links, stages and answers, traced by hand."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from pipelytics.functions import text as x
from pipelytics.operators import responses as r
from pipelytics.operators import text as t


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_blank_steps_leave_a_gap(spark, rows):
    got = t.split_steps(docs(spark, " Read a. ; Write b;\nstop", "", "one"))
    assert rows(got) == [(0, 0, "Read a"), (0, 2, "Write b"), (0, 3, "stop"), (2, 0, "one")]


@pytest.mark.parametrize("step,kind", [
    ("Extract rows from mysql", "sql_extraction"),
    ("extract rows from x and get the sql table", "sql_extraction"),
    ("create a view and count rows", "sql_transformation"),
    ("Copy file to s3", "file_operations"),
    # One point each for extraction and transformation: the earlier type wins.
    ("read sql, then sum it", "sql_extraction"),
    ("SELECT everything", "sql_extraction"),
    ("clean up", "python_processing"),
    ("verify it", "data_validation"),
    ("nothing here", "python_processing"),
])
def test_step_types(spark, step, kind):
    df = spark.createDataFrame([(step,)], "step string")
    assert t.classify_steps(df).first().step_type == kind


def test_entities(spark):
    df = spark.createDataFrame(
        [("load TABLE Orders from mysql as csv",), ("the users table",), ("copy into s3",), ("hi",)],
        "step string",
    )
    got = [(e.table_name, e.database_type, e.file_format, e.connection_id) for e in t.extract_entities(df).collect()]
    assert got == [
        ("Orders", "mysql", "csv", "mysql_default"), ("users", None, None, None),
        ("s3", "s3", None, "aws_default"), (None, None, None, None),
    ]


def test_ids_and_links(spark):
    got = t.step_dependencies(docs(
        spark, "Load users table. Idle. Validate the data. Send an email. Process api"
    )).orderBy("idx").collect()
    assert [g.step_id for g in got] == [
        "load_table_1", "task_2", "validate_data_3", "send_email_4", "process_api_5"
    ]
    assert [g.depends_on for g in got] == [
        [], [], ["load_table_1"], ["load_table_1", "task_2", "validate_data_3"], ["load_table_1"]
    ]


def test_stage_chain(spark):
    got = t.keyword_stages(docs(spark, "Clean and FETCH machine learning")).orderBy("pos").collect()
    assert [(g.task, g.operator, g.depends_on) for g in got] == [
        ("init", "dummy", "none"), ("extract_data", "postgresql", "init"),
        ("transform_data", "python", "extract_data"), ("done", "dummy", "transform_data"),
    ]


def test_fallback_numbers_found_groups_only(spark, rows):
    got = t.stage_fallback(docs(spark, "save then email", "html"))
    assert rows(got.select("doc_id", "name")) == [
        (0, "load_data_1"), (0, "notify_2"), (1, "execute_pipeline")
    ]


def test_default_tasks_match_inside_words(spark, rows):
    got = t.default_tasks(docs(spark, "html page", "metadata of html", "hello"))
    assert rows(got.select("doc_id", "task_id", "upstream")) == sorted([
        (0, "prepare_data", None), (0, "train_model", "prepare_data"), (0, "evaluate_model", "train_model"),
        (1, "extract_data", None), (1, "transform_data", "extract_data"), (1, "load_data", "transform_data"),
        (2, "execute_task", None),
    ], key=repr)


def test_slugs(spark):
    got = t.slug_ids(docs(spark, "Load the big data into a new warehouse today"), date(2024, 5, 6)).first()
    assert got.slug == "load_big_data_into_20240506"


@pytest.mark.parametrize("prompt,available,want", [
    ("select 1", ["sqlcoder-7b", "phi3-mini"], "sqlcoder-7b"),
    ("select in python", ["codellama-7b"], "codellama-7b"),
    ("explain", ["llama3-8b", "phi3-mini"], "phi3-mini"),
    ("hello", ["phi3-mini", "llama3-8b"], "llama3-8b"),
    ("hello", ["other"], "other"),
    ("hello", [], "none"),
])
def test_routes(spark, prompt, available, want):
    df = spark.createDataFrame([(prompt,)], "prompt string")
    assert t.route_prompts(df, available).first().routed_to == want


@pytest.mark.parametrize("kind,available,want", [
    ("testing", ["codellama:7b", "phi3:mini"], "codellama:7b"),
    ("testing", ["phi3:mini"], "phi3:mini"),
    ("testing", ["phi3"], "phi3"),
    ("testing", ["zz"], "zz"),
    ("testing", [], "phi3:mini"),
    ("poetry", ["zz", "phi3:mini"], "phi3:mini"),
    (None, ["zz"], "zz"),
])
def test_recommendations(spark, kind, available, want):
    df = spark.createDataFrame([(kind,)], "task_type string")
    assert t.recommend_model(df, available).first().recommended == want


def test_words_split_like_unicode(spark):
    texts = ["a b", " a b c\t", "", "　"]
    got = [w.words for w in t.token_estimate(docs(spark, *texts)).orderBy("doc_id").collect()]
    assert got == [len(s.split()) for s in texts]


ANSWERS = {
    "valid": '{"dag_id": "a", "tasks": []}',
    "trailing": '{"dag_id": "a",\n\n}',
    "list": '{"dag_id": "a", "tasks": [\n{"id": "x"},\n]}',
    "between": '{"dag_id": "a", "tasks": [{"id": "x"}\n{"id": "y"}]}',
    "bare": "{'dag_id': 'a', 'tasks': [{id: 'x', hallmark: 'Op', description: 'd', upstream_dependencies: []}]}",
    "fenced": '```json\n{"dag_id": "a"}\n```',
    "broken": '{"dag_id": "a", oops',
    "none": "no json at all",
}


def test_each_repair(spark):
    df = spark.createDataFrame(list(ANSWERS.items()), "response_id string, text string")
    got = {a.response_id: a for a in r.repair_json(df).collect()}
    modes = {k: a.parse_mode for k, a in got.items()}
    assert modes == {
        "valid": "valid", "trailing": "repaired", "list": "repaired", "between": "repaired",
        "bare": "repaired", "fenced": "valid", "broken": "failed", "none": "failed",
    }
    assert all(got[k].workflow.dag_id == "a" for k, m in modes.items() if m != "failed")
    assert [x.id for x in got["between"].workflow.tasks] == ["x", "y"]
    assert got["bare"].workflow.tasks[0].operator == "Op"


def test_unparsed_answers(spark):
    df = spark.createDataFrame(
        [("d", "no json, only data"), ("b", 'x {id: \'p\'} {"id": "q", "description": "Q"} {"id" }'), ("n", "sorry"),
         ("t", '{"dag_id": "z", "tasks": [{"id": "a", "operator": "O", "description": "D"} oops')],
        "response_id string, text string",
    )
    got = {a.response_id: a for a in r.parse_workflows(df).collect()}
    assert [x.id for x in got["d"].tasks] == ["extract_data", "validate_data", "load_data"]
    assert got["d"].tasks[2].upstream_dependencies == ["validate_data"]
    assert [(x.id, x.operator, x.description) for x in got["b"].tasks] == [
        ("p", "PythonOperator", "Task: p"), ("q", "PythonOperator", "Q")
    ]
    assert got["n"].parse_mode == "default" and got["n"].tasks == []
    assert got["n"].dag_id == "generated_pipeline" and got["n"].schedule_interval == "@daily"
    assert got["t"].parse_mode == "regex" and got["t"].dag_id == "z"


def test_given_links_are_kept(spark):
    df = spark.sql("""select array(
        named_struct('id', 'a', 'operator', 'o', 'description', 'd', 'upstream_dependencies', cast(array() as array<string>)),
        named_struct('id', 'b', 'operator', 'o', 'description', 'd', 'upstream_dependencies', cast(null as array<string>)),
        named_struct('id', 'c', 'operator', 'o', 'description', 'd', 'upstream_dependencies', array('a'))) as tasks""")
    got = r.chain_missing_dependencies(df).first().tasks
    assert [x.upstream_dependencies for x in got] == [[], ["a"], ["a"]]


def test_known_word_lists_are_lower_case():
    for words in (x.SQL_WORDS, x.PYTHON_WORDS, x.REASONING_WORDS, x.STOP_WORDS):
        assert all(w == w.lower() for w in words)


def test_no_documents(spark):
    empty = docs(spark, "x").where(F.lit(False))
    for op in (t.split_steps, t.step_dependencies, t.keyword_stages, t.stage_fallback, t.default_tasks):
        assert op(empty).count() == 0


def test_steps_of_the_table_function(spark):
    import re

    from pipelytics.operators.inference import steps_udtf

    texts = [None, "", " .; ", "Load a. Clean b;\n\vthen c.", "No end", "a.b;c. d . e", "x. " * 5000, "\t A\f ;  B "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, texts[3])], "doc_id bigint, text string")
    want = []
    for i, t in [*enumerate(texts), (3, texts[3])]:
        for idx, part in enumerate(re.split(r"[.;]\s+", t or "", flags=re.ASCII)):
            if step := part.strip(" \t\n\v\f\r"):
                want.append((i, idx, step))
    assert sorted(map(tuple, steps_udtf(df).collect())) == sorted(want)
    assert steps_udtf(df.limit(0)).count() == 0
    named = steps_udtf(df.withColumn("doc_id", F.concat(F.lit("k"), "doc_id")).withColumnRenamed("doc_id", "a b"), "a b")
    assert named.columns == ["a b", "idx", "step"] and named.count() == len(want)


def test_waits_expand_to_dependencies(spark):
    from pipelytics.views import Tables

    texts = Tables(spark, "/root/testdata/sf0.01").descriptions_v
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "Load orders table. Notify the team. Clean the orders table; report")], "doc_id long, text string")
    texts = texts.select("doc_id", "text").unionByName(odd)
    waits = {}
    for row in t.step_waits(texts).collect():
        waits.setdefault(row.doc_id, []).append(row)
    want = {(r.doc_id, r.idx): r.depends_on for r in t.step_dependencies(texts).collect()}
    got = {}
    for doc, steps in waits.items():
        steps.sort(key=lambda s: s.idx)
        for s in steps:
            earlier = [e for e in steps if e.idx < s.idx and (s.waits_for == "all" or s.waits_for == "tables" and e.names_table)]
            got[doc, s.idx] = [e.step_id for e in earlier]
    assert got == want and any(got.values())
