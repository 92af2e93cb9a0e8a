"""Plans followed through their columns, schemas of plans, compositions of letters, contiguity, profit lines, axes, lexical scores from an index."""

import datetime
import itertools
import json
import unicodedata

import pytest
from pyspark.sql import functions as F

from tidelake.functions import answering, retrieval
from tidelake.functions import text as txt
from tidelake.operators import accumulation, alignment
from tidelake.plans import questions, words


def step(kind, **parameters):
    return {"kind": kind, "parameters": parameters}


ADD = lambda k, s="flow": step("add_column", series_reference=s, column_key=k)
INDEX = lambda k: step("index_column", column_key=k, base_date="2001-01-01")
DEFLATE = lambda k, by: step("deflate_column", column_key=k, deflator_column_key=by, base_date="2001-01-01", convention_reference="c")
BACK = lambda v: step("revert_to", target_version=str(v))


@pytest.mark.parametrize(
    ("plan", "refusal", "columns"),
    [
        ([ADD("c"), INDEX("c"), DEFLATE("c__index_2001-01-01", "a")], None, "a b c c__index_2001-01-01 c__index_2001-01-01__deflated_by_a_2001-01-01"),
        ([INDEX("c"), ADD("c")], "unknown_column", None), ([ADD("a")], "taken", None), ([ADD("period")], "taken", None), ([ADD("c", "no")], "unknown_series", None), ([BACK(0), INDEX("b")], "unknown_column", None),
        ([BACK(0), ADD("b")], None, "a b"), ([ADD("c"), BACK(1), ADD("c")], None, "a b c"), ([ADD("c"), BACK(0), BACK(2)], None, "a b c"), ([DEFLATE("a", "z")], "unknown_column", None), ([], None, "a b"),
    ],
)
def test_a_plan_is_followed_through_its_columns(spark, plan, refusal, columns):
    sets = F.array(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b")))
    got = spark.createDataFrame([(json.dumps(plan),)], "s string").select(answering.plan_columns(F.col("s"), sets, F.array(F.lit("flow"))).alias("p")).first().p
    assert got.refusal == refusal and got.columns == (columns.split() if columns else None)


def test_schemas_name_what_is_there():
    got = answering.plan_schema(["a", "b"], ["flow"], ["2001-01-01"], ["c"])
    by = {b["properties"]["kind"]["const"]: b["properties"]["parameters"]["properties"] for b in got["items"]["anyOf"]}
    assert set(by) == set(answering.PARAMETERS) and by["index_column"]["column_key"] == {"enum": ["a", "b"]} and by["add_column"] == {"series_reference": {"enum": ["flow"]}, "column_key": {"type": "string", "minLength": 1}}
    assert {b["properties"]["kind"]["const"] for b in answering.plan_schema([], ["flow"], [], [])["items"]["anyOf"]} == {"add_column", "revert_to"}


def test_letters_with_marks_fold_like_composed_ones(spark):
    words = ["İZMİR", "BAĞCILAR", "Iğdır", "Çiğdem Öz", "Ệ đ Ǖ", "plain", "é́", "", "a⃗"]
    spelt = list(itertools.chain.from_iterable((w, unicodedata.normalize("NFD", w)) for w in words))
    got = [r.f for r in spark.createDataFrame([(i, w) for i, w in enumerate(spelt)], "i int, s string").orderBy("i").select(txt.casefold(F.col("s")).alias("f")).collect()]
    assert got == [unicodedata.normalize("NFC", w).translate(str.maketrans("Iİ", "ıi")).lower() for w in spelt] and got[0] == got[1] == "izmir"
    assert spark.range(1).select(txt.casefold(F.lit(None).cast("string")).alias("f")).first().f is None


def test_steps_of_each_frequency(spark):
    day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(days=n)
    rows = [("w", "W", day(7 * i)) for i in range(5)] + [("w6", "W", day(6 * i)) for i in range(5)] + [("d", "D", day(i)) for i in (0, 1, 4, 5)] + [("d4", "D", day(i)) for i in (0, 1, 5)] + [("q", "Q", datetime.date(2024, m, 1)) for m in (1, 4, 7)] + [("m", "M", datetime.date(2024, m, 1)) for m in (1, 2, 4)] + [("one", "X", day(0)), ("x", "X", day(0)), ("x", "X", day(1))]
    got = {r.series_id: r.contiguous for r in alignment.contiguous(spark.createDataFrame(rows, "series_id string, f string, period date"), F.col("f")).collect()}
    assert got == {"w": True, "w6": False, "d": True, "d4": False, "q": True, "m": False, "one": True, "x": False}


def test_profit_lines_of_a_balance_sheet_accumulate(spark):
    rows = [("ambiguous", "balance_sheet", " Dönem Karı (Zararı) "), ("ambiguous", "balance_sheet", "DÖNEM NET KARI (ZARARI)"), ("ambiguous", "balance_sheet", "Krediler"), ("none", "balance_sheet", "dönem karı (zararı)"), ("ambiguous", None, "x")]
    got = [(r.resolved, r.verified_by) for r in accumulation.resolve_by_statement(spark.createDataFrame(rows, "mode string, statement_kind string, label string")).collect()]
    assert got == [("ytd", "statement"), ("ytd", "statement"), ("none", "statement"), ("none", "pattern"), ("ambiguous", "")]


def test_lexical_scores_from_an_index_are_those_of_all_pairs(spark):
    labels = spark.createDataFrame([(1, ["konut", "kredileri"]), (2, ["konut", "kredileri"]), (3, ["faiz"]), (4, ["kon"]), (5, ["mevduat", "takipteki"])], "id int, c array<string>")
    asked = spark.createDataFrame([(1, ["konut", "kredi"]), (2, ["kon", "faizi"]), (3, ["başka"])], "qid int, q array<string>")
    got = {(r.qid, r.id): r.score for r in retrieval.lexical_scores(asked, labels).collect()}
    every = asked.crossJoin(labels).select("qid", "id", txt.lexical_score(F.col("q"), F.col("c")).alias("score")).where("score > 0")
    assert got == {(r.qid, r.id): r.score for r in every.collect()} and (1, 1) in got and (2, 4) in got


def test_words_of_parts_are_spread_and_pairs_are_counted_not_made(spark, tmp_path):
    """A file of one row group is worked on by several tasks; the words are cut once, and no array of pairs is made."""
    part = spark.range(400_000).select(F.col("id").alias("p_partkey"), F.concat(F.sha2(F.col("id").cast("string"), 256), F.lit(" flow")).alias("p_name"))
    part.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    own = words.frame(spark, words.QUESTIONS, str(tmp_path)).where("id >= 100")
    assert own.groupBy(F.spark_partition_id().alias("task")).count().where("count > 1000").count() > 1 and own.count() == 400_000
    plan = questions.jn_query_cross(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "flatten(" not in plan and plan.count("RLIKE") == 2  # the items' words and the parts', once each
