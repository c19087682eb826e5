"""Scalar rules of the catalogue as Column expressions; no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words too common to make two tags alike.
STOP_WORDS = """photo image media picture mobile device screen paper plant board model system object item product
style design background foreground color light dark white black text view part detail group card type file data
info page line sign wood glass metal app application icon logo vector art graphic illustration set collection
element symbol banner web website online digital""".split()
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "webp", "bmp"]
VIDEO_EXTENSIONS = ["mp4", "mkv", "avi", "mov", "webm", "gif"]
#: Suffixes of the media type filter, where gif is an image.
FILTER_IMAGES = ["jpg", "jpeg", "png", "webp", "bmp", "gif"]
FILTER_VIDEOS = ["mp4", "mkv", "avi", "mov", "webm", "flv", "wmv"]
#: What marks an error's class.
CONTEXT_EXHAUSTED = ["Ollama context exhausted"]
RATE_LIMIT = ["429", "Quota Exceeded", "Rate Limit", "RESOURCE_EXHAUSTED"]
TRANSIENT = ["503", "500", "502", "504", "Service Unavailable", "UNAVAILABLE", "Internal Error", "high demand", "overloaded", "Overloaded", "empty response", "Failed to parse AnalysisResult JSON"]
CLOUD = ["gemini", "google", "openai", "gpt", "claude", "anthropic"]


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim(x: str | Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(col(x), r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "")


def ascii_lower(x: str | Column) -> Column:
    return F.translate(col(x), UPPER, LOWER)


def ascii_equal(a: str | Column, b: str | Column) -> Column:
    return ascii_lower(a) == ascii_lower(b)


def normalize_tag(x: str | Column) -> Column:
    """Snake case and a crude singular: -ies becomes -y over four bytes, a last s goes over three."""
    s = F.regexp_replace(F.translate(F.lower(trim(x)), " -", "__"), r"[^\p{IsAlphabetic}\p{N}_]", "")
    n = F.length(s)
    return (
        F.when(s.endswith("ies") & (F.octet_length(s) > 4), F.concat(s.substr(F.lit(1), n - 3), F.lit("y")))
        .when(s.endswith("s") & ~s.endswith("ss") & (F.octet_length(s) > 3), s.substr(F.lit(1), n - 1))
        .otherwise(s)
    )


def tag_words(name: str | Column) -> Column:
    """Words of at least three bytes that are no stop words, repeats kept."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(F.split(col(name), "[_-]"), lambda w: (F.octet_length(w) >= 3) & ~F.array_contains(stop, w))


def common_words(a: str | Column, b: str | Column) -> Column:
    """Words of a that b has too; a word twice in a counts twice."""
    return F.filter(col(a), lambda w: F.array_contains(col(b), w))


def common_prefix(a: str | Column, b: str | Column) -> Column:
    a, b = col(a), col(b)
    n = F.least(F.length(a), F.length(b))
    same = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda acc, i: F.when((acc == i - 1) & (i <= n) & (a.substr(i, F.lit(1)) == b.substr(i, F.lit(1))), acc + 1).otherwise(acc))
    return a.substr(F.lit(1), same)


def forward_slashes(path: str | Column) -> Column:
    return F.translate(col(path), "\\", "/")


def extension(path: str | Column) -> Column:
    return F.lower(F.regexp_extract(col(path), r"[.]([^./\\]+)$", 1))


def file_name(path: str | Column) -> Column:
    return F.element_at(F.split(col(path), r"[/\\]"), -1)


def folder_label(path: str | Column) -> Column:
    """The last part of a path that isn't empty, else the path."""
    return F.coalesce(F.try_element_at(F.filter(F.split(col(path), r"[/\\]"), lambda x: x != ""), F.lit(-1)), col(path))


def is_supported(path: str | Column) -> Column:
    return extension(path).isin(IMAGE_EXTENSIONS + VIDEO_EXTENSIONS)


def is_video(path: str | Column) -> Column:
    return F.regexp_like(col(path), F.lit(r"(?i)\.(mp4|webm|mov|avi|mkv|flv|wmv)$"))


def light_hash(content: str | Column) -> Column:
    """SHA-256 of the first 64 KiB, lowercase hex."""
    return F.sha2(F.substring(col(content), 1, 65536), 256)


def tag_descriptor(name: str | Column, name_ja: str | Column) -> Column:
    return F.when(col(name_ja).isNotNull(), F.concat(col(name), F.lit(" ("), col(name_ja), F.lit(")"))).otherwise(col(name))


def display_tag(en: str | Column, ja: str | Column) -> Column:
    return F.when(F.coalesce(trim(ja), F.lit("")) == "", col(en)).otherwise(F.concat(col(ja), F.lit("("), col(en), F.lit(")")))


def clean_chip(x: str | Column) -> Column:
    return F.regexp_replace(trim(x), "^#+", "")


def manual_tag(x: str | Column) -> Column:
    """A tag typed by hand: other characters than letters, digits, _ and - go."""
    return F.regexp_replace(col(x), "[^a-zA-Z0-9_-]", "")


def parameter_size(model: str | Column) -> Column:
    """The first number before a b that lies between 0 and 500, in billions; null if none does."""
    found = F.regexp_extract_all(F.lower(col(model)), F.lit("([0-9.]+)b"), F.lit(1))
    return F.get(F.filter(F.transform(found, lambda x: x.try_cast("double")), lambda v: v.isNotNull() & (v > 0) & (v < 500)), F.lit(0))


def any_of(x: str | Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | col(x).contains(p)
    return out


def prompt_type(provider: str | Column, model: str | Column, force: str | Column) -> Column:
    size = parameter_size(model)
    return (
        F.when(col(force), "DETAILED")
        .when(any_of(F.lower(col(provider)), CLOUD), "DETAILED")
        .when(size >= 10, "DETAILED")
        .when(size.isNotNull(), "LIGHT")
        .when(any_of(F.lower(col(model)), ["large", "giant", "pro"]), "DETAILED")
        .otherwise("LIGHT")
    )


def granularity(setting: str | Column) -> Column:
    return F.when(col(setting).isin("balanced", "descriptive"), col(setting)).otherwise("atomic")


def context_size(kind: str | Column, level: str | Column) -> Column:
    return F.when(col(kind) == "LIGHT", 8192).when(col(level) == "atomic", 12288).otherwise(16384)


def error_class(message: str | Column, attempt: str | Column, most: int) -> Column:
    """fail, retry_long or retry_short, for the attempt that just failed."""
    return (
        F.when(any_of(message, CONTEXT_EXHAUSTED), "fail")
        .when(any_of(message, RATE_LIMIT) & (col(attempt) < most), "retry_long")
        .when(any_of(message, TRANSIENT) & (col(attempt) < 5), "retry_short")
        .otherwise("fail")
    )


def long_backoff(attempt: str | Column) -> Column:
    a = col(attempt)
    return F.when(a == 1, 60).when(a == 2, 300).when(a == 3, 1800).otherwise(3600) + (a * 3) % 6


def short_backoff(attempt: str | Column) -> Column:
    a = col(attempt)
    return F.when(a == 1, 3).when(a == 2, 6).when(a == 3, 12).when(a == 4, 24).otherwise(30) + (a * 2) % 3


def wait_text(seconds: str | Column) -> Column:
    s = col(seconds)
    text = lambda n, unit: F.concat(F.floor(n).cast("string"), F.lit(f" {unit}(s) ("), s.cast("string"), F.lit("s)"))
    return F.when(s >= 3600, text(s / 3600, "hour")).when(s >= 60, text(s / 60, "minute")).otherwise(F.concat(s.cast("string"), F.lit(" seconds")))


def eta_text(seconds: str | Column) -> Column:
    """The two or three largest of days, hours, minutes and seconds that matter."""
    s = col(seconds).cast("long")
    d, h, m = F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60)
    part = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return (
        F.when(d > 0, F.concat_ws(" ", part(d, "日"), part(h, "時間"), part(m, "分")))
        .when(h > 0, F.concat_ws(" ", part(h, "時間"), part(m, "分")))
        .when(m > 0, F.concat_ws(" ", part(m, "分"), part(s % 60, "秒")))
        .otherwise(part(s, "秒"))
    )


def percent(current: str | Column, total: str | Column) -> Column:
    """Rounded half up; 0 of nothing."""
    return F.when(col(total) > 0, F.floor(100 * col(current) / col(total) + 0.5)).otherwise(0).cast("long")


def clamp(t: str | Column, duration: str | Column) -> Column:
    return F.least(F.greatest(col(t), F.lit(0.0)), F.coalesce(col(duration), F.lit(300.0)))


def log_head(s: str | Column) -> Column:
    t = trim(s)
    short = F.replace(t, F.lit("\n"), F.lit("\\n"))
    return F.when(F.length(t) <= 1500, short).otherwise(F.concat(F.replace(F.substring(t, 1, 1500), F.lit("\n"), F.lit("\\n")), F.lit("...<truncated, "), F.length(t).cast("string"), F.lit(" chars total>")))


def log_tail(s: str | Column) -> Column:
    t = col(s)
    return F.when(F.length(t) <= 600, F.replace(t, F.lit("\n"), F.lit("\\n"))).otherwise(F.concat(F.lit("<..."), (F.length(t) - 600).cast("string"), F.lit(" chars omitted>"), F.replace(F.right(t, F.lit(600)), F.lit("\n"), F.lit("\\n"))))


def scaled_edge(width: str | Column, height: str | Column, most: int) -> tuple[Column, Column]:
    """Width and height with the longer edge at most `most` (0: as they are)."""
    w, h = col(width), col(height)
    longest = F.greatest(w, h)
    fits = (longest <= most) | F.lit(most == 0)
    scale = lambda x: F.when(fits, x).otherwise(F.greatest(F.round(x * most / longest), F.lit(1.0))).cast("long")
    return scale(w), scale(h)


def vision_model(vram: str | Column) -> Column:
    v = col(vram)
    return F.when(v >= 20, "qwen3-vl:30b").when(v >= 12, "gemma4:12b").when(v >= 6, "qwen3-vl:8b").when(v > 0, "qwen3-vl:4b")


def text_model(vram: str | Column) -> Column:
    v = col(vram)
    return F.when(v >= 12, "qwen3:14b").when(v >= 6, "qwen2.5:7b").when(v > 0, "qwen2.5:3b")


def _parts(name: Column) -> tuple[Column, Column]:
    parts = F.split(name, ":")
    return F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))


def is_selected(recommended: str | Column, selected: str | Column) -> Column:
    """Same base, and tags of which one begins the other (or neither has one)."""
    a, b = F.lower(trim(recommended)), F.lower(trim(selected))
    (base_a, tag_a), (base_b, tag_b) = _parts(a), _parts(b)
    both = (tag_a != "") & (tag_b != "")
    tags = F.when(both, F.startswith(tag_a, tag_b) | F.startswith(tag_b, tag_a)).otherwise((tag_a == "") & (tag_b == ""))
    return F.coalesce((col(selected) != "") & ((a == b) | ((base_a == base_b) & tags)), F.lit(False))


def is_installed(recommended: str | Column, models: str | Column) -> Column:
    target = F.lower(trim(recommended))
    base = _parts(target)[0]

    def same(m: Column) -> Column:
        m = F.lower(trim(m))
        return F.startswith(m, target) | F.startswith(target, m) | (_parts(m)[0] == base)

    return F.coalesce(F.exists(col(models), same), F.lit(False))


def provider_ready(models: str | Column, configured: str | Column) -> Column:
    return F.coalesce(F.exists(col(models), lambda m: F.startswith(m, col(configured))), F.lit(False))


def whole_setting(x: str | Column, default: int) -> Column:
    """The whole number a setting begins with, 0 at least; else the default."""
    digits = F.regexp_extract(col(x), r"^\s*([+-]?\d+)", 1).try_cast("long")
    return F.greatest(F.lit(0).cast("long"), F.coalesce(digits, F.lit(default).cast("long")))


def chosen_response(response: str | Column, thinking: str | Column) -> Column:
    """The response, or the thinking text where the response is blank."""
    blank = F.coalesce(trim(response), F.lit("")) == ""
    return F.when(blank, F.coalesce(col(thinking), col(response))).otherwise(col(response))
