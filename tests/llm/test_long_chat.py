"""Conversations of any length take one way; records that can't be parsed are kept with a reason."""

import json

from pyspark.sql import functions as F

from sieveline.llm import chat_format


def test_message_beyond_json_limit(spark):
    n = 20_000_001
    rows = spark.sql(f"SELECT * FROM VALUES (1L, 0L, 'user', 'ask'), (1L, 1L, 'assistant', repeat('x', {n})), (2L, 0L, 'user', repeat('y', {n})) AS t(conv_id, turn, role, text)")
    out = chat_format.format_conversations(chat_format.records_of_rows(rows))
    got = {r.conv_id: r for r in out.select("conv_id", "layout", F.length("formatted").alias("n"), "loss_spans").collect()}
    heads = [len(f"<|im_start|>{r}\n<|im_end|>\n") for r in ("user", "assistant")]
    assert (got[1].layout, got[1].n) == ("prompt", sum(heads) + 3 + n) and [s.end - s.start for s in got[1].loss_spans] == [n]
    assert (got[2].layout, got[2].n) == ("messages", heads[0] + n)


def test_numbered_texts_are_those_of_whole_records(spark, sf):
    """Rows through records of numbers give what records with the texts themselves give."""
    records = chat_format.records_of_rows(spark.read.parquet(f"{sf}/conversations.parquet"))
    numbered = chat_format.format_conversations(records).collect()

    def filled(x, texts):
        if isinstance(x, dict):
            return {k: v if k in ("role", "from", "id") else filled(v, texts) for k, v in x.items()}
        return [filled(v, texts) for v in x] if isinstance(x, list) else texts[int(x)]

    whole = [(r.conv_id, json.dumps(filled(json.loads(r.record), r.texts))) for r in records.collect()]
    parsed = chat_format.format_conversations(spark.createDataFrame(whole, "conv_id long, record string")).collect()
    assert sorted(map(str, numbered)) == sorted(map(str, parsed)) and len({r.layout for r in parsed}) > 2


def test_unparsed_record_is_kept_as_unknown(spark):
    long = "concat('{\"prompt\":\"', repeat('x', 20000001), '\",\"completion\":\"\"}')"
    df = spark.sql(f"SELECT * FROM VALUES (1L, {long}), (2L, 'no json'), (3L, '{{\"a\":1}}'), (4L, NULL), (5L, '{{\"prompt\":\"p\",\"completion\":\"c\"}}') AS t(conv_id, record)")
    out = chat_format.format_conversations(df).select("conv_id", "layout", F.length("unknown").alias("unknown"), "reason").collect()
    unparsed = "no JSON, or too long to parse"
    assert sorted(map(tuple, out)) == [(1, None, 20_000_001 + 29, unparsed), (2, None, 7, unparsed), (3, None, 7, "unknown layout"), (4, None, None, None), (5, "prompt", None, None)]
