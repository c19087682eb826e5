"""Scalar rules against stated cases."""

import pytest
from pyspark.sql import functions as F

from vitrine.functions import scalar as S


def each(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_normalize_tag(spark):
    cases = {"lens": "len", "canvas": "canva", "virus": "viru", "cactus": "cactu", "series": "sery", "glasses": "glasse", "glass": "glass", "dishes": "dishe", "ties": "tie", "bus": "bus", "猫s": "猫", "  Red Car-2!\t": "red_car_2", "": "", "cats": "cat"}
    assert each(spark, S.normalize_tag("s"), [(k,) for k in cases], "s string") == list(cases.values())


@pytest.mark.parametrize("model,size", [("qwen3-vl:4b", 4.0), ("llama3.2-vision:11b", 11.0), ("llava:34b", 34.0), ("my-custom-model:12b", 12.0), ("no-size-here", None), ("a-900b-7b", 7.0)])
def test_parameter_size(spark, model, size):
    assert each(spark, S.parameter_size("m"), [(model,)], "m string") == [size]


def test_prompt_type_and_context(spark):
    rows = [("ollama", "qwen3-vl:4b", False), ("ollama", "qwen3-vl:4b", True), ("gemini", "flash", False), ("ollama", "x-large", False), ("ollama", "x", False)]
    kind = S.prompt_type("p", "m", "f")
    assert each(spark, kind, rows, "p string, m string, f boolean") == ["LIGHT", "DETAILED", "DETAILED", "DETAILED", "LIGHT"]
    sizes = each(spark, S.context_size("k", "g"), [("LIGHT", "atomic"), ("DETAILED", "atomic"), ("DETAILED", "balanced"), ("DETAILED", "descriptive")], "k string, g string")
    assert sizes == [8192, 12288, 16384, 16384]


def test_words_keep_repeats(spark):
    rows = [(["red", "red", "car"], ["red"])]
    assert each(spark, S.common_words("a", "b"), rows, "a array<string>, b array<string>") == [["red", "red"]]
    assert each(spark, S.tag_words("n"), [("old_photo-car_ab_red",)], "n string") == [["old", "car", "red"]]


def test_common_prefix(spark):
    rows = [("猫が好き", "猫がいる"), ("abc", "abc"), ("", "x"), ("abcd", "ab")]
    assert each(spark, S.common_prefix("a", "b"), rows, "a string, b string") == ["猫が", "abc", "", "ab"]


def test_errors_and_waits(spark):
    rows = [("Ollama context exhausted 503", 1), ("HTTP 429", 1), ("HTTP 429", 3), ("overloaded", 4), ("overloaded", 5), ("other", 1)]
    assert each(spark, S.error_class("m", "a", 3), rows, "m string, a int") == ["fail", "retry_long", "fail", "retry_short", "fail", "fail"]
    assert each(spark, S.long_backoff("a"), [(1,), (2,), (3,), (4,)], "a int") == [63, 300, 1803, 3600]
    assert each(spark, S.short_backoff("a"), [(1,), (2,), (3,), (4,), (5,)], "a int") == [5, 7, 12, 26, 31]


def test_texts(spark):
    assert each(spark, S.eta_text("s"), [(59,), (61,), (3700,), (90061,)], "s long") == ["59秒", "1分 1秒", "1時間 1分", "1日 1時間 1分"]
    assert each(spark, S.wait_text("s"), [(5,), (63,), (3600,)], "s long") == ["5 seconds", "1 minute(s) (63s)", "1 hour(s) (3600s)"]
    assert each(spark, S.log_head("s"), [(" a\nb ",), ("x" * 1600,)], "s string") == ["a\\nb", "x" * 1500 + "...<truncated, 1600 chars total>"]
    assert each(spark, S.log_tail("s"), [("x" * 10 + "y" * 600,)], "s string") == ["<...10 chars omitted>" + "y" * 600]
    assert each(spark, S.folder_label("p"), [("/a/b/",), ("C:\\x\\y",), ("/",)], "p string") == ["b", "y", "/"]
    assert each(spark, S.percent("c", "t"), [(1, 8), (0, 0), (1, 3)], "c long, t long") == [13, 0, 33]


def test_sizes_and_models(spark):
    df = spark.createDataFrame([(3072, 4096), (4096, 3072), (100, 50)], "w long, h long")
    w, h = S.scaled_edge("w", "h", 1536)
    assert [tuple(r) for r in df.select(w, h).collect()] == [(1152, 1536), (1536, 1152), (100, 50)]
    assert each(spark, S.vision_model("v"), [(24.0,), (12.0,), (6.0,), (1.0,), (0.0,)], "v double") == ["qwen3-vl:30b", "gemma4:12b", "qwen3-vl:8b", "qwen3-vl:4b", None]
    rows = [("qwen3-vl:8b", "qwen3-vl:8b-q4"), ("qwen3-vl:8b", "qwen3-vl:30b"), ("a", "a:1b"), ("a", ""), ("A", "a")]
    assert each(spark, S.is_selected("r", "s"), rows, "r string, s string") == [True, False, False, False, True]
    rows = [("qwen3:8b", ["qwen3:30b"]), ("x", []), ("llava", ["llava-next"])]
    assert each(spark, S.is_installed("r", "m"), rows, "r string, m array<string>") == [True, False, True]
    assert each(spark, S.whole_setting("s", 1536), [("12px",), ("x",), ("-3",), (None,)], "s string") == [12, 1536, 0, 1536]


def test_light_hash_reads_64_kib(spark):
    import hashlib

    body = b"x" * 70_000
    assert each(spark, S.light_hash("b"), [(bytearray(body),)], "b binary") == [hashlib.sha256(body[:65536]).hexdigest()]
    assert each(spark, F.levenshtein("a", "b"), [("猫猫", "犬猫")], "a string, b string") == [1]
