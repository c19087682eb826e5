"""Strict decoding, providers and retries."""

import pytest

from vitrine.operators import analysis
from vitrine.plans.derived import RESPONSES
from vitrine.sources import providers
from vitrine.sources.settings import Settings

PAIR = '{"en":"a","ja":"b"}'
CASES = {
    '{"categories":[],"tags":[]}': None,
    f'text {{"categories":["x"],"tags":[{PAIR}]}} more': None,
    f'```json\n{{"categories":["x"],"tags":[{PAIR}]}}\n```': None,
    f'```\n{{"categories":["x"],"tags":[{PAIR}]}}\n```': None,
    '{"categories":["x"],"tags":[],"descriptive_tags":[]}': None,
    '{"categories":["x"],"tags":[],"extra":{"a":1}}': None,
    " \n\t": "empty_response",
    "": "empty_response",
    '{"categories":["x"],"tags":["a"]}': "parse_error",
    '{"categories":["x"],"tags":[{"en":"a"}]}': "parse_error",
    '{"categories":["x"],"tags":[{"en":"a","ja":null}]}': "parse_error",
    '{"categories":["x"],"tags":[{"en":1,"ja":"b"}]}': "parse_error",
    '{"categories":[1],"tags":[]}': "parse_error",
    '{"categories":"x","tags":[]}': "parse_error",
    '{"tags":[]}': "parse_error",
    '{"categories":[],"tags":[],"descriptive_tags":null}': "parse_error",
    '{"categories":[],"tags":[': "parse_error",
    "no json": "parse_error",
    "[1]": "parse_error",
}


def test_strict_decode(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "media_id long, response string")
    got = {r.response: r.error for r in analysis.decoded(df).collect()}
    assert got == CASES
    none = analysis.decoded(spark.createDataFrame([(1, None)], "media_id long, response string")).first()
    assert none.error == "empty_response" and none.result is None


def test_result_and_tag_rows(spark):
    text = RESPONSES[2].replace("\\n", "\n").replace("{}", "Trees")
    df = analysis.decoded(spark.createDataFrame([(1, text)], "media_id long, response string"))
    assert sorted(map(tuple, analysis.tag_rows(df).collect())) == [(1, "basic", "tree", "z"), (1, "descriptive", "wet_tree", "w")]


def test_synonyms(spark):
    df = spark.createDataFrame([('ok {"synonyms":[["a","b"],["c"],["d","e","f"]]} end',)], "t string")
    assert df.select(analysis.synonyms("t")).first()[0] == [["a", "b"]]


class Stub:
    name = model = "stub"

    def __init__(self, errors):
        self.errors = list(errors)

    def analyze(self, frames, prompt):
        if self.errors and (e := self.errors.pop(0)):
            raise analysis.ProviderError(e)
        return f"{prompt}:{len(frames)}"

    def healthy(self):
        return True


@pytest.mark.parametrize("errors,ok", [(["503"] * 4, True), (["503"] * 5, False), (["429"] * 2, True), (["429"] * 3, False), (["Ollama context exhausted"], False), (["odd"], False)])
def test_retry(errors, ok):
    waits = []
    call = lambda: analysis.Retry(3, local=False, wait=waits.append).call(Stub(errors), ["f"], "p")
    if ok:
        assert call() == "p:1"
        assert waits == ([5, 7, 12, 26] if errors[0] == "503" else [63, 300])
    else:
        with pytest.raises(analysis.ProviderError):
            call()


def test_context_doubles_and_is_kept():
    c, asked = analysis.Context(8192), []

    def ask(size):
        asked.append(size)
        return ("{}", size < 20000)

    assert c.call(ask, lambda t: False) == "{}"
    assert asked == [8192, 16384, 32768] and c.start() == 32768
    with pytest.raises(analysis.ProviderError):
        c.call(lambda size: ("", True), lambda t: True)


def test_analyzed_and_limit(spark):
    media = spark.createDataFrame([(i, [f"{i}"]) for i in range(1, 9)], "id long, frames array<string>")

    class Odd(Stub):
        def analyze(self, frames, prompt):
            if frames[0] in ("2", "3"):
                raise analysis.ProviderError("odd")
            return "x"

    run = lambda m: analysis.analyzed(m, lambda: Odd([]), "p")
    got = {r.media_id: r.error for r in run(media).collect()}
    assert len(got) == 8 and got[2] == "odd" and got[1] is None
    done = [r.media_id for part in analysis.with_limit(media, 3, run, batch=2) for r in part.where("error IS NULL").collect()]
    assert sorted(done) == [1, 4, 5]
    stopped = analysis.with_limit(media, 5, run, stop_after=2, batch=4)
    assert sorted(r.media_id for p in stopped for r in p.collect()) == [1, 2, 3]
    calls = spark.sparkContext.accumulator(0)

    class Counted(Stub):
        def analyze(self, frames, prompt):
            calls.add(1)
            return "x"

    kept = analysis.with_limit(media, 6, lambda m: analysis.analyzed(m, lambda: Counted([]), "p"), batch=2)
    assert sum(len(p.collect()) for p in kept) == 6 and calls.value == 6


def test_frames_levels_prompt(spark):
    v = spark.createDataFrame([(1, 1.0, 10.0), (2, 400.0, None)], "id long, timestamp double, duration double")
    assert sorted(map(tuple, analysis.video_frames(v).collect())) == [(1, 0, 0.0), (1, 1, 1.0), (1, 2, 3.0), (2, 0, 300.0), (2, 1, 300.0), (2, 2, 300.0)]
    assert analysis.level_jobs(v).count() == 6
    base = "Rules\n\n# Output Format\nold"
    section = lambda a, b: f"# {a}-{b}"
    assert analysis.prompt_for("atomic", base, section, "new") == base
    assert analysis.prompt_for("descriptive", base, section, "new") == "Rules\n\n# 3-6\n\n# Output Format\nnew"


def test_http_providers():
    answers = {"ollama": {"response": " ", "thinking": "t"}, "gemini": {"candidates": [{"content": {"parts": [{"text": "g"}]}}]}, "openai": {"choices": [{"message": {"content": "o"}}]}, "claude": {"content": [{"type": "text", "text": "c"}]}}
    for kind, answer in answers.items():
        p = providers.HttpProvider(kind, "m", "http://x", lambda u, h, b, a=answer: (200, a), key="k")
        assert p.analyze([b"f"], "p") == {"ollama": "t", "gemini": "g", "openai": "o", "claude": "c"}[kind]
        with pytest.raises(analysis.ProviderError):
            providers.HttpProvider(kind, "m", "http://x", lambda u, h, b: (429, {}), key="k").analyze([b"f"], "p")
    with pytest.raises(analysis.ProviderError, match="key"):
        providers.HttpProvider("openai", "m", "http://x", lambda u, h, b: (200, {})).analyze([], "p")
    assert providers.installed_models(lambda u, h, b: (200, {"models": [{"name": "a:1b"}]}), "http://x") == ["a:1b"]
    assert providers.is_ready(["a:1b"], "a")


def test_settings(spark):
    s = Settings(spark.createDataFrame([("llm_provider", "claude"), ("claude_model", "c1"), ("ext_llm_retry_max_attempts", "x"), ("flag", "true")], "key string, value string"))
    p, retry = providers.provider_from(s, lambda u, h, b: (200, {}), {"claude": "k"})
    assert (p.kind, p.model, p.key, retry.attempts, retry.local) == ("claude", "c1", "k", 3, False)
    assert s.flag("flag") and not s.flag("none") and s.number("none", 5) == 5


def test_video_falls_back_to_its_main_frame(spark):
    class Narrow:
        def __init__(self, single):
            self.single = single

        def analyze(self, frames, prompt):
            if len(frames) > 1 or not self.single:
                raise analysis.ProviderError(f"status 500 over {len(frames)}")
            return ",".join(frames)

    media = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["z"])], "id long, frames array<string>")
    got = lambda single, main: {r.media_id: (r.response, r.error) for r in analysis.analyzed(media, lambda: Narrow(single), "p", main=main).collect()}
    assert got(True, 1) == {1: ("b", None), 2: ("z", None)}
    assert got(True, None) == {1: (None, "status 500 over 3"), 2: ("z", None)}
    assert got(False, 1) == {1: (None, "status 500 over 1"), 2: (None, "status 500 over 1")}


def test_compared_levels(spark):
    class Echo:
        def __init__(self, level):
            self.level = level

        def analyze(self, frames, prompt):
            if self.level == "balanced" and frames[0] == "b":
                raise analysis.ProviderError("no")
            return f"{self.level} {prompt} {frames[0]}"

    def make(level):
        if level == "descriptive":
            raise analysis.ProviderError("no such model")
        return Echo(level)

    media = spark.createDataFrame([(1, ["a"]), (2, ["b"])], "id long, frames array<string>")
    got = {(r.media_id, r.granularity): (r.response, r.error) for r in analysis.compared_levels(media, make, {x: x[:1] for x in analysis.LEVELS}).collect()}
    assert got == {
        (1, "atomic"): ("atomic a a", None),
        (2, "atomic"): ("atomic a b", None),
        (1, "balanced"): ("balanced b a", None),
        (2, "balanced"): (None, "no"),
        (1, "descriptive"): (None, "no such model"),
        (2, "descriptive"): (None, "no such model"),
    }


def test_pause_resume_cancel(spark):
    import threading

    media = spark.range(1, 7).withColumnRenamed("id", "id")
    answer = lambda m: m.selectExpr("id AS media_id", "'x' AS response", "CAST(NULL AS STRING) AS error")
    control = analysis.Control(spark)
    control.pause()
    assert control.status == "paused"
    threading.Timer(0.2, control.resume).start()
    assert sum(p.count() for p in analysis.with_limit(media, 4, answer, batch=2, control=control)) == 4
    assert control.status == "running"
    calls = []

    def stopping(m):
        calls.append(1)
        if len(calls) == 2:
            control.cancel()
            raise RuntimeError("the batch in flight is lost")
        return answer(m)

    assert sum(p.count() for p in analysis.with_limit(media, 6, stopping, batch=2, control=control)) == 2
    assert control.status == "cancelled" and analysis.with_limit(media, 6, answer, control=control) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
