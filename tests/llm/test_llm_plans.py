"""What the plans must keep: pruned scans, one text exchange, no cross joins, no Python rows."""

import re

from helixframe.llm import byte_bpe, line_dedup, packing, substring_dedup

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_two_columns(spark):
    for f in (byte_bpe.op10, packing.op6, substring_dedup.op9):
        assert set(re.findall(r"ReadSchema: (\S+)", plan(f(spark, SF)))) == {"struct<doc_id:bigint,text:string>"}, f


def test_packing_and_encoding_shuffle_nothing(spark):
    for f in (byte_bpe.op10, packing.op6):
        assert "Exchange" not in plan(f(spark, SF))


def test_texts_are_shuffled_once(spark):
    df = substring_dedup.op9(spark, SF)
    df.collect()
    final = plan(df)
    assert final.split("Initial Plan")[0].count("ReusedExchange") == 1


def test_nothing_is_crossed(spark):
    for f in (line_dedup.op8, substring_dedup.op9):
        assert not re.search("Cartesian|NestedLoop|BatchEvalPython", plan(f(spark, SF)))
