"""Model responses: strict decoding to tags, providers behind a protocol, retries."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions import scalar as S
from vitrine.schema import ANALYSIS
from vitrine.sources.shared import written

EMPTY, BROKEN = "empty_response", "parse_error"


def json_part(text: str | Column) -> Column:
    """The JSON of a response: of fenced text the first part labelled json or begun by a brace; then
    from the first opening brace to the last closing one."""
    clean = S.trim(text)
    parts = F.transform(F.split(clean, "```"), S.trim)
    picked = F.get(F.filter(parts, lambda p: p.startswith("json") | p.startswith("{")), F.lit(0))
    picked = F.when(picked.startswith("json"), S.trim(picked.substr(F.lit(5), F.length(picked)))).otherwise(picked)
    body = F.when(clean.contains("```"), F.coalesce(picked, clean)).otherwise(clean)
    return outer_braces(body)


def outer_braces(text: str | Column) -> Column:
    body = S.col(text)
    first = F.instr(body, "{")
    last = F.length(body) - F.instr(F.reverse(body), "}") + 1
    return F.when((first > 0) & (F.instr(body, "}") > 0) & (first < last), body.substr(first, last - first + 1)).otherwise(body)


def _all_kinds(part: Column, kind: str) -> Column:
    """Whether every element of a variant array has that type."""
    items = part.try_cast("array<variant>")
    return F.coalesce(F.forall(items, lambda x: F.coalesce(F.schema_of_variant(x), F.lit("VOID")) == kind), F.lit(False))


def _strings(v: Column, path: str) -> Column:
    return _all_kinds(F.variant_get(v, path, "variant"), "STRING")


def _pairs(v: Column, path: str) -> Column:
    """Every element is an object whose en and ja are strings; other keys may be there."""
    items = F.variant_get(v, path, "variant").try_cast("array<variant>")
    word = lambda x, k: F.coalesce(F.schema_of_variant(F.try_variant_get(x, k, "variant")) == "STRING", F.lit(False))
    return F.coalesce(F.forall(items, lambda x: F.coalesce(F.schema_of_variant(x), F.lit("")).startswith("OBJECT") & word(x, "$.en") & word(x, "$.ja")), F.lit(False))


def decoded(responses: DataFrame, text: str = "response") -> DataFrame:
    """responses with error (null, empty_response or parse_error) and result (null on error).

    Strict: categories and tags are required; categories are strings, tags objects with string en
    and ja; descriptive_tags may be absent but not null; other keys are ignored.
    """
    body = json_part(text)
    rows = responses.withColumn("__json", body).withColumn("__v", F.try_parse_json("__json"))
    v = F.col("__v")
    root = F.coalesce(F.schema_of_variant(v), F.lit(""))
    has_extra = F.coalesce(F.array_contains(F.json_object_keys("__json"), "descriptive_tags"), F.lit(False))
    good = root.startswith("OBJECT") & _strings(v, "$.categories") & _pairs(v, "$.tags") & (~has_extra | _pairs(v, "$.descriptive_tags"))
    blank = F.coalesce(S.trim(text), F.lit("")) == ""
    error = F.when(blank, EMPTY).when(~F.coalesce(good, F.lit(False)), BROKEN)
    parsed = F.from_json("__json", ANALYSIS)
    none = F.array().cast(ANALYSIS["descriptive_tags"].dataType)
    result = F.struct(parsed["categories"].alias("categories"), parsed["tags"].alias("tags"), F.coalesce(parsed["descriptive_tags"], none).alias("descriptive_tags"))
    return rows.withColumn("error", error).withColumn("result", F.when(F.col("error").isNull(), result)).drop("__json", "__v")


def tag_rows(results: DataFrame, key: str = "media_id") -> DataFrame:
    """(key, kind, en, ja): kind category, basic or descriptive; names normalised, empty ones gone."""
    ok = results.where("error IS NULL")
    cats = ok.select(key, F.lit("category").alias("kind"), F.explode("result.categories").alias("en"), F.lit(None).cast("string").alias("ja"))
    out = cats.select(key, "kind", F.lower(S.trim("en")).alias("en"), "ja")
    for kind, field in (("basic", "tags"), ("descriptive", "descriptive_tags")):
        rows = ok.select(key, F.explode(f"result.{field}").alias("t"))
        out = out.unionByName(rows.select(key, F.lit(kind).alias("kind"), S.normalize_tag("t.en").alias("en"), F.col("t.ja").alias("ja")))
    return out.where("en <> ''")


def synonyms(text: str | Column) -> Column:
    """Pairs of names of a synonym answer; rows that aren't two strings go."""
    rows = F.from_json(outer_braces(S.trim(text)), "synonyms array<array<string>>")["synonyms"]
    return F.filter(rows, lambda p: (F.size(p) == 2) & p[0].isNotNull() & p[1].isNotNull())


# providers


class Provider(Protocol):
    """What a model has to offer; it runs on executors, one for each partition."""

    name: str
    model: str

    def analyze(self, frames: list[bytes | str], prompt: str) -> str: ...

    def healthy(self) -> bool: ...


class ProviderError(Exception):
    pass


@dataclass
class Retry:
    """Long waits for rate limits, short ones (none for local providers) for transient errors."""

    attempts: int = 3
    local: bool = True
    wait: Callable[[float], None] = lambda seconds: None

    def call(self, provider: Provider, frames: list, prompt: str) -> str:
        attempt = 1
        while True:
            try:
                return provider.analyze(frames, prompt)
            except ProviderError as e:
                text = str(e)
                has = lambda parts, text=text: any(p in text for p in parts)
                if has(S.CONTEXT_EXHAUSTED):
                    raise
                if has(S.RATE_LIMIT) and attempt < self.attempts:
                    self.wait(([60, 300, 1800] + [3600] * attempt)[attempt - 1] + attempt * 3 % 6)
                elif has(S.TRANSIENT) and attempt < 5:
                    if not self.local:
                        self.wait([3, 6, 12, 24][attempt - 1] + attempt * 2 % 3)
                else:
                    raise
                attempt += 1


class Context:
    """Window sizes: doubled while answers are cut off, up to the cap; what was learned stays."""

    CAP = 32768

    def __init__(self, base: int):
        self.base, self.learned = base, 0

    def start(self, frames: int = 1) -> int:
        return max(self.learned, min(self.base * min(max(frames, 1), 3), self.CAP))

    def call(self, ask: Callable[[int], tuple[str, bool]], usable: Callable[[str], bool], frames: int = 1) -> str:
        """ask(size) gives (text, cut off). A cut-off answer that is empty or unusable asks for more."""
        size = self.start(frames)
        while True:
            text, cut = ask(size)
            if not cut or (text.strip() and usable(text)):
                self.learned = max(self.learned, size)
                return text
            if size >= self.CAP:
                raise ProviderError(S.CONTEXT_EXHAUSTED[0])
            size = min(size * 2, self.CAP)


def analyzed(media: DataFrame, make: Callable[[], Provider], prompt: str, retry: Retry | None = None, key: str = "id", frames: str = "frames", main: int | None = None) -> DataFrame:
    """(media_id, response, error) from media (key, frames: array). One provider for each partition.

    With main, media of several frames whose call fails are asked again with that frame alone.
    """
    how = retry or Retry()

    def answer(provider: Provider, images: list) -> str:
        try:
            return how.call(provider, images, prompt)
        except ProviderError:
            if main is None or len(images) < 2:
                raise
            return how.call(provider, [images[main]], prompt)

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        provider = make()
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                try:
                    out.append((getattr(row, key), answer(provider, list(getattr(row, frames))), None))
                except ProviderError as e:
                    out.append((getattr(row, key), None, str(e)))
            yield pd.DataFrame(out, columns=["media_id", "response", "error"])

    return media.select(key, frames).mapInPandas(run, "media_id long, response string, error string")


class Control:
    """Pause, resume and cancel for a run, to be called from any thread of the driver."""

    def __init__(self, spark):
        self.spark, self.group, self.cancelled = spark, f"analysis-{uuid.uuid4().hex}", False
        self._open = threading.Event()
        self._open.set()

    @property
    def status(self) -> str:
        return "cancelled" if self.cancelled else "running" if self._open.is_set() else "paused"

    def pause(self) -> None:
        if not self.cancelled:
            self._open.clear()

    def resume(self) -> None:
        self._open.set()

    def cancel(self) -> None:
        """Ends the run; the jobs of the batch in flight are stopped and its answers dropped."""
        self.cancelled = True
        self._open.set()
        self.spark.sparkContext.cancelJobGroup(self.group)

    def proceed(self) -> bool:
        """Waits while paused; whether to go on."""
        self._open.wait()
        return not self.cancelled


def with_limit(media: DataFrame, most: int, analyse: Callable[[DataFrame], DataFrame], stop_after: int = 3, batch: int = 50, control: Control | None = None) -> list[DataFrame]:
    """Results of batches of media by id, until `most` succeeded or stop_after failed in a row.

    Each batch's answers are written before they are counted, so no model is asked twice. The driver
    holds one batch's outcomes at a time. A control can pause the run between batches, and cancel it.
    """
    if control:
        media.sparkSession.sparkContext.setJobGroup(control.group, "analysis", interruptOnCancel=True)
    done, fails, last, out = 0, 0, -(1 << 62), []
    while done < most and fails < stop_after and (control is None or control.proceed()):
        ids = [r.id for r in media.where(F.col("id") > last).orderBy("id").limit(min(batch, most - done)).select("id").collect()]
        if not ids:
            break
        last = ids[-1]
        try:
            got = written(analyse(media.where(F.col("id").isin(ids))), "answers")
        except Exception:
            if control and control.cancelled:
                break
            raise
        outcomes = {r.media_id: r.error for r in got.select("media_id", "error").collect()}
        kept = []
        for i in ids:
            if fails >= stop_after:
                break
            kept.append(i)
            fails = fails + 1 if outcomes.get(i) is not None else 0
            done += outcomes.get(i) is None
        out.append(got.where(F.col("media_id").isin(kept)))
    return out


LEVELS = ["atomic", "balanced", "descriptive"]


def level_jobs(media: DataFrame) -> DataFrame:
    """Each row once for each granularity level."""
    return media.withColumn("granularity", F.explode(F.array(*map(F.lit, LEVELS))))


def compared_levels(media: DataFrame, make: Callable[[str], Provider], prompts: Mapping[str, str], retry: Retry | None = None, key: str = "id", frames: str = "frames") -> DataFrame:
    """(media_id, granularity, response, error): each row at every level, to be compared, not stored.

    prompts: each level's detailed prompt, whatever prompt the settings choose. make(level) gives the
    provider. A level whose provider can't be made, or fails, has its error, and the others go on.
    """
    how = retry or Retry()

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        providers: dict[str, Provider] = {}
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                level = row.granularity
                try:
                    provider = providers.get(level) or providers.setdefault(level, make(level))
                    out.append((getattr(row, key), level, how.call(provider, list(getattr(row, frames)), prompts[level]), None))
                except ProviderError as e:
                    out.append((getattr(row, key), level, None, str(e)))
            yield pd.DataFrame(out, columns=["media_id", "granularity", "response", "error"])

    return level_jobs(media.select(key, frames)).mapInPandas(run, "media_id long, granularity string, response string, error string")


def video_frames(media: DataFrame, at: str = "timestamp", duration: str = "duration", spread: float = 2.0) -> DataFrame:
    """(id, frame, seconds): the frame at a time and its two neighbours, within the video."""
    times = [S.clamp(F.col(at) + d, duration) for d in (-spread, 0.0, spread)]
    return media.select("id", F.posexplode(F.array(*times)).alias("frame", "seconds"))


def descriptive_range(level: str) -> tuple[int, int] | None:
    return {"balanced": (1, 3), "descriptive": (3, 6)}.get(level)


def prompt_for(level: str, detailed: str, section: Callable[[int, int], str], example: str, marker: str = "\n\n# Output Format\n") -> str:
    """The detailed prompt; beyond the atomic level with a section on descriptive tags before the
    output format, and another example."""
    span = descriptive_range(level)
    if span is None:
        return detailed
    rules, found, _ = detailed.partition(marker)
    if not found:
        raise ValueError("the prompt lacks the output format's heading")
    return f"{rules}\n\n{section(*span)}{marker}{example}"
