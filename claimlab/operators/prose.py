"""Text audits: numbers a draft may state, requests that bend a protocol, checklists."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: a number in prose.
NUMBER = r"-?\d[\d,]*\.?\d*"

# Requests that change an experiment after its result, and the clause they break.
GUARDRAILS = (
    (r"\btun(e|ing)\b.{0,40}\b(until|so that|to get|to make)\b", "parameters are fixed in advance"),
    (r"\b(adjust|change|tweak|raise|lower)\b.{0,40}\b(threshold|parameter|window|cutoff|penalty)\b.{0,40}\b(until|so that|to get|to make)\b", "parameters are fixed in advance"),
    (r"\b(try|test)\b.{0,30}\b(other|different|more)\b.{0,20}\b(values?|parameters?|settings?|configurations?)\b.{0,30}\b(until|till)\b", "parameters are fixed in advance"),
    (r"\b(until|till)\b.{0,30}\b(significant|positive|works?|profitable)\b", "the result is not a target"),
    (r"\bmake (it|the (result|alpha|sharpe))\b.{0,30}\b(significant|positive|work|better|look good)\b", "the result is not a target"),
    (r"\bcherry.?pick|\bhand.?pick\b.{0,30}\b(result|window|sample|period)", "no selecting on the outcome"),
    (r"\b(drop|remove|exclude|ignore)\b.{0,40}\b(bad|worst|inconvenient|losing|outlier)\b.{0,20}\b(month|year|trade|observation|period|name)s?\b", "the sample is fixed in advance"),
    (r"\b(re-?open|re-?run|look at|peek at|check)\b.{0,30}\b(sealed|held.?out|holdout)\b", "a sealed block opens once"),
    (r"\b(skip|drop|leave out|omit)\b.{0,30}\b(cost|friction|spread|limitation)s?\b", "costs and limitations are not optional"),
)


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def check_requests(requests: DataFrame, text: str = "text") -> DataFrame:
    """Adds clause and quote of the first rule that a request breaks, NULL if none."""
    flat = requests.withColumn("__t", collapsed(F.coalesce(F.col(text), F.lit(""))))
    hit = F.coalesce(*[F.when(F.col("__t").rlike(p), F.struct(F.lit(c).alias("clause"), F.regexp_extract("__t", p, 0).alias("quote"))) for p, c in GUARDRAILS])
    return flat.withColumn("__h", hit).select("*", "__h.clause", "__h.quote").drop("__t", "__h")


def numbers(rows: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys, place, raw, value, decimals) of every number in a text, place from 0."""
    found = rows.select(*keys, F.posexplode_outer(F.regexp_extract_all(F.col(text), F.lit(NUMBER), F.lit(0))).alias("place", "raw")).where("raw is not null")
    clean = F.regexp_replace("raw", ",", "")
    decimals = F.when(F.contains(clean, F.lit(".")), F.length(clean) - F.instr(clean, ".")).otherwise(0)
    return found.select(*keys, "place", "raw", clean.cast("double").alias("value"), decimals.cast("int").alias("decimals"))


def unsupported_numbers(stated: DataFrame, allowed: DataFrame, rel_tol: float = 0.02, abs_tol: float = 1e-6) -> DataFrame:
    """Stated numbers without a supporting result: read as they are, as a percentage or as
    a fraction (which moves the stated decimals by two), equal to a result when rounded
    to those decimals or within the tolerances.

    Numbers meet results by keys - the rounded value at its decimals, ranges of the
    logarithm as wide as the relative tolerance, ranges as wide as the absolute one - and
    are compared exactly then.  ``rel_tol`` is below one.
    """
    results = allowed.select(F.col("value").alias("a")).where("a is not null").distinct()
    v, d, a = F.col("value"), F.col("decimals"), F.col("a")
    step = math.log1p(rel_tol) - math.log1p(-rel_tol) if rel_tol else 1.0
    key = lambda kind, p, x: F.struct(F.lit(kind).alias("kind"), p.cast("double").alias("place"), (x + F.lit(0.0)).alias("x"))
    places_of = lambda x, places: F.coalesce(*[F.when(places == k, F.bround(x, k)) for k in range(12)])
    log_of = lambda x: F.floor(F.log(F.abs(F.nullif(x, F.lit(0.0)))) / step).cast("double")
    near_of = lambda x: F.floor(x / abs_tol).cast("double")
    keys = lambda x, places: [key("rounded", places, places_of(x, places)), key("relative", F.signum(x), log_of(x)), *([key("absolute", F.lit(0), near_of(x))] if abs_tol else [])]
    around = lambda kind, p, x: [key(kind, p, x + k) for k in (-1, 0, 1)]
    theirs = [key("rounded", F.lit(k), F.bround(a, k)) for k in range(12)] + around("relative", F.signum(a), log_of(a)) + (around("absolute", F.lit(0), near_of(a)) if abs_tol else [])
    index = results.select("a", F.explode(F.array(*theirs)).alias("k")).where("k.x is not null")
    readings = F.array(*[F.struct(x.alias("x"), places.cast("int").alias("places")) for x, places in ((v, d), (v / 100.0, d + 2), (v * 100.0, F.greatest(d - 2, F.lit(0))))])
    read = stated.select("value", "decimals").distinct().withColumn("r", F.explode(readings))
    probes = read.select("value", "decimals", "r", F.explode(F.array(*keys(F.col("r.x"), F.col("r.places")))).alias("k")).where("k.x is not null")
    met = probes.join(index, "k")
    x, places = F.col("r.x"), F.col("r.places")
    same = F.coalesce(places_of(a, places) == places_of(x, places), F.lit(False))
    close = F.abs(x - a) <= F.greatest(F.lit(abs_tol), rel_tol * F.abs(a))
    supported = met.where(same | close).select("value", "decimals").distinct()
    return stated.join(supported, ["value", "decimals"], "left_anti").select(*stated.columns)


def _covering(state: Column, item: int, name: str) -> Column:
    """The state after an item took its first line that is free."""
    hits = F.filter(F.transform("lines", lambda line, i: F.when(line["hits"][item], i)), lambda i: i.isNotNull())

    def take(s: Column) -> Column:
        free = F.filter(hits, lambda i: ~F.array_contains(s["used"], i))
        return F.when(F.size(free) > 0, F.struct(F.concat(s["used"], F.slice(free, 1, 1)).alias("used"), F.concat(s["covered"], F.array(F.lit(name))).alias("covered"))).otherwise(s)

    return F.transform(F.array(state), take)[0]


def score_checklist(lines: DataFrame, checklist: list[tuple[str, list[str]]], key: str, line_no: str = "line_no", line: str = "line") -> DataFrame:
    """(key, covered array<string>): the items, in checklist order, that a line not yet
    used by an earlier item matches; one line covers one item."""
    hits = F.array(*[F.exists(F.array(*[F.lit(p) for p in patterns]), lambda p: F.rlike(F.lower(F.col(line)), F.lower(p))) for _, patterns in checklist])
    per = lines.select(key, F.struct(F.col(line_no).alias("no"), hits.alias("hits")).alias("l")).groupBy(key).agg(F.sort_array(F.collect_list("l")).alias("lines"))
    state = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<string>").alias("covered"))
    for k, (name, _) in enumerate(checklist):
        state = _covering(state, k, name)
    return per.select(key, state["covered"].alias("covered"))


def clipped(text: Column, most: int = 160) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, most - 1)), F.lit("…")))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
