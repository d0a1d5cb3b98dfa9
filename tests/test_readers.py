import json

from querytide.operators import records
from querytide.sources import exports, readers

ROW = {"keyword": "blue ring", "ads_metrics": {"volume_avg": "74000", "cpc": 1.5, "competition": "LOW", "competition_index": True},
       "intents": {"i": 40, "t": "60"}, "monthly_volume": [{"month": "2024-02", "nv": 5, "gg": "7", "total": 12}, {"nv": 3}, {"month": "2024-01", "nv": None, "gg": 1}]}


def raw(spark, docs):
    return spark.createDataFrame([(k, d if isinstance(d, str) else json.dumps(d)) for k, d in enumerate(docs)], "file int, value string")


def test_every_envelope_gives_the_same_record(spark):
    wrapped = [{"_source": ROW}]
    half = json.dumps([ROW])
    docs = [[ROW], {"data": [ROW]}, {"data": {"results": [ROW]}}, {"result": {"hits": {"hits": wrapped}}}, {"hits": {"hits": wrapped}},
            {"results": [ROW]}, [{"type": "text", "text": half[:20]}, {"type": "text", "text": half[20:]}]]
    got = readers.keyword_info(raw(spark, docs)).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.keyword, r.volume_avg, r.cpc, r.competition, r.competition_index, r.i, r.n, r.t) == ("blue ring", 74000, 1.5, "LOW", 0, 40, 0, 60)
        assert [m.month for m in r.monthly_volume] == ["2024-02", "2024-01"]


def test_rows_without_keyword_and_odd_shapes_are_tolerated(spark):
    docs = [[{"ads_metrics": {}}, {"keyword": ""}, 7, "x", {"keyword": "a", "ads_metrics": "none", "intents": [1], "monthly_volume": "x"}], {"nothing": 1}, "not json"]
    got = readers.keyword_info(raw(spark, docs)).collect()
    assert [(r.keyword, r.volume_avg, r.i, r.monthly_volume) for r in got] == [("a", 0, 0, [])]


def test_intents_that_are_zero_are_told_from_missing_ones(spark):
    given = {"zero": {"i": 0, "t": 0}, "none": {}, "text": "n/a", "list": [1], "null": None, "some": {"c": 3}}
    rows = [{"keyword": k, "intents": v} for k, v in given.items()] + [{"keyword": "missing"}]
    got = {r.keyword: r.has_intents for r in readers.keyword_info(raw(spark, [rows])).collect()}
    assert got == {"zero": True, "none": False, "text": False, "list": False, "null": False, "some": True, "missing": False}


def test_a_list_that_is_not_made_of_text_blocks_stays_as_it_is(spark):
    got = readers.keyword_info(raw(spark, [[{"type": "text", "text": "[]"}, {"keyword": "a"}]])).collect()
    assert [r.keyword for r in got] == ["a"]


def test_months_sort_and_a_series_without_engines_is_read_as_gg(spark):
    split = readers.keyword_info(raw(spark, [[ROW]]))
    got = [(r.idx, r.month, r.nv, r.gg, r.total) for r in records.monthly_volume(split).orderBy("idx").collect()]
    assert got == [(0, "2024-01", 0, 1, 1), (1, "2024-02", 5, 7, 12)]
    plain = dict(ROW, monthly_volume=[{"month": "2024-01", "total": "9"}])
    got = records.monthly_volume(readers.keyword_info(raw(spark, [[plain]]))).first()
    assert (got.nv, got.gg, got.total) == (0, 9, 9)


def test_graph_reader(spark):
    graph = {"communities": {"2": ["a", 5, "b"], "x": "bad"}, "rels": [["a", "b"], ["a"], ["a", "b", "c"], ["", "b"]]}
    for doc in ({"data": graph}, graph):
        comm, rels = readers.cluster_graph(raw(spark, [doc]))
        assert [(r.cluster_id, r.keyword) for r in comm.orderBy("ord").collect()] == [("2", "a"), ("2", "b")]
        assert [(r.a, r.b) for r in rels.collect()] == [("a", "b")]
        assert readers.cluster_graph(raw(spark, [doc]), min_ends=3)[1].count() == 2


def test_journeys_are_trimmed_and_lose_immediate_repeats(spark):
    rows = [[" a ", "a", "b", "", 3, "a"], [" "], "x", ["c"]]
    for doc in (rows, {"data": rows}, {"result": {"paths": rows}}, {"paths": rows}):
        got = records.read_paths(readers.journeys(raw(spark, [doc]))).orderBy("path_id").collect()
        assert [r.seq for r in got] == [["a", "b", "a"], ["c"]]


def test_related_lists_of_strings_or_objects(spark):
    lists = readers.related_lists(raw(spark, [["a", {"keyword": "b"}, 5], {"data": ["c"]}]))
    got = [(r.file, r.rank, r.query) for r in records.related_queries(lists).orderBy("file", "rank").collect()]
    assert got == [(0, 1, "a"), (0, 2, "b"), (1, 1, "c")]


def test_files_are_read_whole_and_csv_quotes_only_when_needed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.json").write_text(json.dumps([ROW], indent=2))
    files = readers.answer_files(spark, str(tmp_path / "in"))
    assert readers.keyword_info(files).select("keyword").first()[0] == "blue ring"
    df = spark.createDataFrame([("plain", 1), ('say "hi", you', 2)], "keyword string, v int").coalesce(1)
    exports.write_csv(df, str(tmp_path / "out"))
    lines = next((tmp_path / "out").glob("*.csv")).read_text().splitlines()
    assert lines == ["keyword,v", "plain,1", '"say ""hi"", you",2']


def test_csv_is_read_back_as_it_was_written(spark, tmp_path):
    rows = [("a", "plain", 1), ("a", "", 2), ("a", None, None), ("b", ' two "quoted", parts\nand a line ', 3), ("b", "NULL", 4), ("b", "back\\slash", 5)]
    kind = "run_id string, text string, v int"
    exports.write_csv(spark.createDataFrame(rows, kind).repartition(2), str(tmp_path / "out"), ["run_id"])
    got = exports.read_csv(spark, str(tmp_path / "out"), kind).select("run_id", "text", "v").collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, rows))


def test_facts_of_one_run_are_replaced(spark, tmp_path):
    kind = "run_id string, v int"
    exports.write_facts({"t": spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], kind)}, str(tmp_path))
    for _ in range(2):  # a repeated write changes nothing more
        exports.write_facts({"t": spark.createDataFrame([("a", 9), ("c", 4)], kind)}, str(tmp_path), replace=True)
        assert sorted((r.run_id, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [("a", 9), ("b", 3), ("c", 4)]


def test_answers_that_cannot_be_used_are_named(spark):
    texts = [[ROW], "", " \n", "{", {"data": {}}, [], [{"keyword": ""}], [{"_source": {"keyword": "k"}}], [{"type": "text", "text": "[{}]"}], [{"type": "text", "text": json.dumps([ROW])}]]
    got = {r.file: r.reason for r in readers.rejected(raw(spark, texts)).collect()}
    assert got == {1: "empty", 2: "empty", 3: "not JSON", 4: "no list of records", 5: "no keyword", 6: "no keyword", 8: "no keyword"}
