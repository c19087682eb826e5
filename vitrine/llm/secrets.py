r"""Secret scans: fixed patterns, and character Markov models of random strings against identifiers.

Everything here is DataFrame or SQL functions; nothing runs in Python workers.

Patterns. The base kinds are found by regular expressions, leftmost and without overlaps for each
kind. Spark's functions give matches but no places, so places are summed up from the pieces that
split() leaves between them, in code points.

Models. Two first-order Markov chains over the characters of tokens are trained from labelled
samples: random strings (hex, base 32, base 62, base 64) and ordinary identifiers (the words
of all documents, alone and joined, each as often as documents hold it). P(next | previous) is the
share in the sample, mixed with MIXED of an even one, so that it does not hang on the corpus' size.
The sum of the differences of log P under the two over a token is its log-likelihood ratio. A token of
at least 20 characters whose ratio is at least RATIO, and MEAN a character, becomes a span of kind markov, if
no base span overlaps it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds in the order of listing; patterns of the base kinds, and what a match must have.
KINDS = ["assign", "access", "hex", "markov"]
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RATIO, MEAN, DISTINCT = 8.0, 0.4, 8
#: Random strings drawn of each alphabet, the share of an even distribution in the models, and matches whose
#: places are summed up at once.
RANDOM_SAMPLES, MIXED, AT_ONCE = 1000, 0.05, 64


def samples(docs: DataFrame, text: str = "text", random: int = RANDOM_SAMPLES) -> DataFrame:
    """(token, is_random, n): drawn strings, and the words of all docs with how many of them hold each."""
    spark = docs.sparkSession
    drawn = spark.range(random).select(F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 256).alias("h"))
    b64 = F.base64(F.unhex("h"))
    kinds = [F.substring("h", 1, 40), F.upper(F.regexp_replace(b64, "[^A-Za-z2-7]", "")), F.regexp_replace(b64, "[^A-Za-z0-9]", ""), b64]
    made = drawn.select(F.explode(F.array(*kinds)).alias("token"), F.lit(True).alias("is_random"), F.lit(1).cast("long").alias("n"))
    found = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit("[A-Za-z]{3,}"), F.lit(0)))).alias("token"))
    words = found.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    joined = F.array("token", F.concat("token", F.lit("_"), F.lower("token")), F.concat(F.lower("token"), F.initcap("token")), F.concat(F.lit("get-"), "token", F.lit("="), F.lower("token"), F.lit("2")))
    return made.unionByName(words.select(F.explode(joined).alias("token"), F.lit(False).alias("is_random"), "n"))


def trained(labelled: DataFrame, token: str = "token", label: str = "is_random", weight: str = "n") -> list[float]:
    """Log-likelihood ratios by (previous, next) character, row by row over the alphabet.

    Null tokens, labels and weights and characters outside the alphabet are left out. The driver gets
    one number for each pair of characters.
    """
    n = len(ALPHABET)
    rows = labelled.where(F.col(label).isNotNull()).select(F.col(label).alias("y"), F.col(token).alias("s"), F.col(weight).alias("w")).where(F.length("s") >= 2)
    pairs = rows.select("y", "w", F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.col("s").substr(i, F.lit(2)))).alias("p"))
    counted = pairs.groupBy("y", "p").agg(F.sum("w").alias("n")).where("n IS NOT NULL")
    places = counted.select("y", F.instr(F.lit(ALPHABET), F.substring("p", 1, 1)).alias("a"), F.instr(F.lit(ALPHABET), F.substring("p", 2, 1)).alias("b"), "n")
    counts = {(r.y, r.a, r.b): r["n"] for r in places.where("a > 0 AND b > 0").collect()}

    def log_p(y: bool) -> list[float]:
        out = []
        for a in range(1, n + 1):
            total = sum(counts.get((y, a, b), 0) for b in range(1, n + 1))
            out += [math.log((1 - MIXED) * (counts.get((y, a, b), 0) / total if total else 1 / n) + MIXED / n) for b in range(1, n + 1)]
        return out

    return [r - i for r, i in zip(log_p(True), log_p(False), strict=True)]


def ratio_of(token: Column, table: list[float]) -> Column:
    """The log-likelihood ratio of a token of the alphabet's characters."""
    n = len(ALPHABET)
    values = F.split(F.lit(",".join(f"{x:.5f}" for x in table)), ",").cast("array<double>")  # folded to one constant
    place = lambda i: F.instr(F.lit(ALPHABET), token.substr(i, F.lit(1)))
    return F.aggregate(F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0), lambda acc, i: acc + F.get(values, (place(i) - 1) * n + place(i + 1) - 1))


def _spans(text: Column, pattern: str, kind: str, guard: Column, group: int = 0, least: int = 0) -> Column:
    """Array of (begin, rank, end, body): all matches whose group has the least length."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    between = F.split(text, pattern, -1)
    kinds = "array<struct<begin:int,rank:int,end:int,body:string,part:int>>"
    zipped = F.arrays_zip(found.alias("m"), parts.alias("p"), between.alias("b"))
    rank = KINDS.index(kind)

    def one(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["b"])
        span = F.struct(start.alias("begin"), F.lit(rank).alias("rank"), (start + F.length(x["m"])).alias("end"), x["m"].alias("body"), F.length(x["p"]).alias("part"))
        return F.when(x["m"].isNull(), acc).otherwise(F.struct((start + F.length(x["m"])).alias("at"), F.concat(acc["out"], F.array(span)).alias("out")))

    # blocks of matches, so that what is copied for each match is bounded
    zipped = zipped.cast("array<struct<m:string,p:string,b:string>>")
    blocks = F.transform(F.sequence(F.lit(0), F.size(zipped) - 1, F.lit(AT_ONCE)), lambda i: F.slice(zipped, i + 1, F.lit(AT_ONCE)))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kinds}>").alias("out"))

    def block(acc: Column, xs: Column) -> Column:
        begin = F.struct(acc["at"].alias("at"), F.array().cast(kinds).alias("out"))
        own = F.aggregate(xs, begin, one)
        return F.transform(F.array(own), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))[0]

    every = F.aggregate(blocks, start, block, lambda acc: F.filter(F.flatten(acc["out"]), lambda s: s["part"] >= least))
    return F.when(guard, every).otherwise(F.array().cast(kinds))


def _written(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1)
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", name(s), s["begin"].cast("string"), s["end"].cast("string"))), ",")


def scanned(docs: DataFrame, table: list[float], text: str = "text", key: str = "doc_id", ratio: float = RATIO, mean: float = MEAN) -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans) for each row of docs; no shuffle.

    A null text is empty and has no spans. Whole texts of any length are read. Repeated rows and
    equal or null keys stay rows of their own. Only key and text are read.
    """
    t = F.col("t")
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.select(
        key,
        "t",
        _spans(t, ASSIGN, "assign", t.rlike(ASSIGN), 2, 12).alias("assign"),
        _spans(t, ACCESS, "access", t.contains("AKIA")).alias("access"),
        _spans(t, HEX, "hex", t.rlike(HEX)).alias("hex"),
        _spans(t, TOKEN, "markov", t.rlike(TOKEN)).alias("tokens"),
    )
    base = F.concat("assign", "access", "hex")
    rows = rows.select(key, "assign", "access", "hex", "tokens", base.alias("base"))

    def secret(s: Column) -> Column:
        r = ratio_of(s["body"], table)
        clear = ~F.exists("base", lambda b: (b["begin"] < s["end"]) & (s["begin"] < b["end"]))
        return clear & (F.size(F.array_distinct(F.split(s["body"], ""))) >= DISTINCT) & (r >= F.greatest(F.lit(ratio), F.length(s["body"]) * mean))

    return rows.select(
        key,
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _written(F.concat("base", F.filter("tokens", secret))).alias("spans"),
    )


def scan(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs scanned with models trained from the default samples."""
    return scanned(docs, trained(samples(docs)))
