"""Secret scans in DataFrame operations: fixed patterns, and sliding-window entropy.

Pattern matches get their places from the text around them: ``split`` with the same
pattern gives the gaps between the matches, and a running sum of gap and match lengths
gives code-point offsets without any Python.  The sum runs over chunks of matches, so
that a text with very many is not copied once per match.

Entropy: for each character class - hexadecimal, base64 - the maximal runs of its
characters are candidates; a run all of whose characters are hexadecimal is one of that
class only.  Strings of the allow list cut a run: no window touches them.  A window
slides over what is left and keeps the number of each character in it; the one that
leaves and the one that enters change two numbers and the sum of n log2 n.  A window
counts if its entropy reaches its class's threshold and it holds digits and others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the three base kinds.
ASSIGN = (
    r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
RUNS = {"entropy_hex": r"(?<![0-9a-fA-F])[0-9a-fA-F]{20,}", "entropy_base64": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"}
ALL_HEX = "^[0-9a-fA-F]+$"
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
WINDOW = 20
#: Bits per character that a window must reach, of at most 4 and log2(20) = 4.32.
THRESHOLDS = {"entropy_hex": 3.0, "entropy_base64": 3.9}
#: Never part of a secret: UUIDs, counting or alphabetic series, placeholders.
ALLOW = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"(?i:abcdefghijklm|0123456789abcdef|1234567890)",
    r"(?i:example|placeholder|changeme|your[_-]?(?:api[_-]?)?key)",
)
#: The characters of all classes; digits are the 53rd to the 62nd.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
FIRST_DIGIT, LAST_DIGIT = 53, 62
#: Matches that are placed in one go.
CHUNK = 256
PLACED = "array<struct<start:int,match:string>>"
SPANS = "array<struct<start:int,kind:int,end:int,match:string>>"


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _placed(bodies: Column, leads: Column) -> Column:
    """(start, match) of consecutive strings; before each lie ``leads`` characters."""
    pieces = F.filter(F.zip_with(bodies, leads, lambda b, n: F.struct(b.alias("match"), n.alias("lead"))), lambda p: p["match"].isNotNull())

    def one(acc: Column, p: Column) -> Column:
        begin = acc["at"] + p["lead"]
        return F.struct((begin + F.length(p["match"])).alias("at"), F.concat(acc["got"], F.array(F.struct(begin.alias("start"), p["match"].alias("match")))).alias("got"))

    def chunked(every: Column) -> Column:
        def step(acc: Column, k: Column) -> Column:
            part = F.aggregate(F.slice(every, k * CHUNK + 1, CHUNK), F.struct(acc["at"].alias("at"), F.array().cast(PLACED).alias("got")), one)
            return _bound(part, lambda p: F.struct(p["at"].alias("at"), F.concat(acc["done"], F.array(p["got"])).alias("done")))

        chunks = F.sequence(F.lit(0), F.floor((F.size(every) - 1) / CHUNK).cast("int"))
        return F.aggregate(chunks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{PLACED}>").alias("done")), step, lambda acc: F.flatten(acc["done"]))

    return F.when(F.size(bodies) > 0, _bound(pieces, chunked)).otherwise(F.array().cast(PLACED))


def _matches(text: Column, pattern: str, found: Column) -> Column:
    """(start, match) of the matches ``found`` of ``pattern`` in the text."""
    # split() gives one gap more than there are matches; its last has no match.
    return F.when(F.size(found) > 0, _placed(found, F.transform(F.split(text, pattern, -1), lambda g: F.length(g)))).otherwise(F.array().cast(PLACED))


def _spans(placed: Column, kind: int) -> Column:
    return F.transform(placed, lambda p: F.struct(p["start"].alias("start"), F.lit(kind).alias("kind"), (p["start"] + F.length(p["match"])).alias("end"), p["match"].alias("match")))


def _cut(run: Column, allowed: str) -> Column:
    """(start, match) of what is left of a run between the strings of the allow list."""
    gone = F.regexp_extract_all(run["match"], F.lit(allowed), F.lit(0))
    leads = F.concat(F.array(F.lit(0)), F.transform(gone, lambda m: F.length(m)))
    moved = F.transform(_placed(F.split(run["match"], allowed, -1), leads), lambda p: F.struct((p["start"] + run["start"]).alias("start"), p["match"].alias("match")))
    return F.when(run["match"].rlike(allowed), moved).otherwise(F.array(F.struct(run["start"].alias("start"), run["match"].alias("match"))))


def high_entropy(text: Column, threshold: float, window: int) -> Column:
    """(first, last) begin of the windows of the text that count, nulls if none."""
    terms = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 1)])
    codes = F.transform(F.split(text, ""), lambda c: F.position(c, F.lit(ALPHABET)))
    in_and_out = _bound(codes, lambda c: F.zip_with(c, F.slice(F.concat(F.array_repeat(F.lit(0), window), c), 1, F.size(c)), lambda a, b: F.struct(a.alias("enters"), b.alias("leaves"))))
    digit = lambda c: c.between(FIRST_DIGIT, LAST_DIGIT).cast("int")
    start = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("total"), F.lit(0).alias("digits"), F.lit(1 - window).alias("begin"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))

    def slide(acc: Column, c: Column) -> Column:
        old = F.coalesce(F.get(acc["counts"], c["leaves"] - 1), F.lit(0))
        new = F.get(acc["counts"], c["enters"] - 1) - (c["leaves"] == c["enters"]).cast("int")
        total = acc["total"] - F.get(terms, old) + F.get(terms, F.greatest(old - 1, F.lit(0))) + F.get(terms, new + 1) - F.get(terms, new)
        counts = F.transform(acc["counts"], lambda n, i: n + (i + 1 == c["enters"]).cast("int") - (i + 1 == c["leaves"]).cast("int"))
        now = F.struct(total.alias("total"), (acc["digits"] + digit(c["enters"]) - digit(c["leaves"])).alias("digits"))

        def weigh(s: Column) -> Column:
            # The rounding keeps equal windows equal however they were reached.
            hot = (acc["begin"] >= 0) & s["digits"].between(1, window - 1) & (F.round(math.log2(window) - s["total"] / window, 9) >= threshold)
            return F.struct(counts.alias("counts"), s["total"].alias("total"), s["digits"].alias("digits"), (acc["begin"] + 1).alias("begin"),
                            F.coalesce(acc["first"], F.when(hot, acc["begin"])).alias("first"), F.when(hot, acc["begin"]).otherwise(acc["last"]).alias("last"))

        return _bound(now, weigh)

    return F.aggregate(in_and_out, start, slide, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def _hot(pieces: Column, kind: str, window: int) -> Column:
    """Spans from the first to the last window that counts in each piece of a run."""
    long = F.filter(pieces, lambda p: F.length(p["match"]) >= window)
    seen = F.transform(long, lambda p: F.struct(p.alias("piece"), high_entropy(p["match"], THRESHOLDS[kind], window).alias("hot")))
    return F.transform(F.filter(seen, lambda w: w["hot"]["first"].isNotNull()), lambda w: F.struct(
        (w["piece"]["start"] + w["hot"]["first"]).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (w["piece"]["start"] + w["hot"]["last"] + window).alias("end"),
        F.substr(w["piece"]["match"], w["hot"]["first"] + 1, w["hot"]["last"] - w["hot"]["first"] + window).alias("match")))


def find_secrets(docs: DataFrame, allow: tuple[str, ...] = ALLOW, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id and spans array<struct<start, kind, end, match>>, sorted.

    ``kind`` indexes KINDS; places are code points, the end exclusive.  Null text has no
    spans; repeated rows stay repeated; an empty table gives an empty result.  The allow
    list suppresses entropy windows only: pattern spans always stay.  ``window`` is at
    most 20, the shortest run that is looked at.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    all_of = lambda p: F.regexp_extract_all(F.col("text"), F.lit(p), F.lit(0))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, **RUNS}
    found = docs.select(F.col(id_col), text.alias("text")).select(id_col, "text", *[all_of(p).alias(f"m_{k}") for k, p in patterns.items()])
    placed = {k: _matches(F.col("text"), p, F.col(f"m_{k}")) for k, p in patterns.items()}
    placed["assign"] = F.filter(placed["assign"], lambda p: F.length(F.regexp_extract(p["match"], ASSIGN, 1)) >= 8)
    placed["entropy_base64"] = F.filter(placed["entropy_base64"], lambda p: ~p["match"].rlike(ALL_HEX))
    allowed = "|".join(f"(?:{p})" for p in allow)
    pieces = {k: F.flatten(F.transform(placed[k], lambda r: _cut(r, allowed))) if allow else placed[k] for k in RUNS}
    every = [_spans(placed[k], KINDS.index(k)) for k in ("assign", "access", "hex")] + [_hot(pieces[k], k, window) for k in RUNS]
    return found.select(id_col, F.array_sort(F.concat(*[x.cast(SPANS) for x in every])).alias("spans"))


def secret_digests(docs: DataFrame) -> DataFrame:
    names = F.array(*map(F.lit, KINDS))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return find_secrets(docs).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _places(name: str, pattern: str) -> str:
    """Matches of a pattern with their places, in SQL."""
    quoted = pattern.replace("'", "''")
    return f"""{name}_m AS (SELECT doc_id, regexp_extract_all(t, '{quoted}') AS m, regexp_split_to_array(t, '{quoted}') AS g FROM docs),
{name}_x AS (SELECT doc_id, unnest(m) AS match, unnest(list_transform(g[1:len(m)], lambda s: length(s))) AS gap, generate_subscripts(m, 1) AS i FROM {name}_m),
{name} AS (SELECT doc_id, match, CAST(sum(gap) OVER w + sum(length(match)) OVER w - length(match) AS BIGINT) AS a FROM {name}_x WINDOW w AS (PARTITION BY doc_id ORDER BY i))"""


_ALLOWED = "|".join(f"(?:{p})" for p in ALLOW).replace("'", "''")


def _windows(name: str, kind: str, more: str = "true") -> str:
    """Spans of the windows that count in the runs of a class, in SQL."""
    return f"""{name}_p AS (SELECT doc_id, a, match, regexp_split_to_array(match, '{_ALLOWED}') AS g, regexp_extract_all(match, '{_ALLOWED}') AS m FROM {name} WHERE {more}),
{name}_g AS (SELECT doc_id, g[j] AS piece, a + CAST(coalesce(list_sum(list_transform(g[1:j - 1], lambda s: length(s))), 0) + coalesce(list_sum(list_transform(m[1:j - 1], lambda s: length(s))), 0) AS BIGINT) AS a
  FROM (SELECT *, unnest(range(1, len(g) + 1)) AS j FROM {name}_p)),
{name}_w AS (SELECT doc_id, a, i, substr(piece, i + 1, {WINDOW}) AS w FROM (SELECT *, unnest(range(0, length(piece) - {WINDOW - 1})) AS i FROM {name}_g)),
{name}_h AS (SELECT doc_id, {KINDS.index(kind)} AS kind, a + min(i) AS a, a + max(i) + {WINDOW} AS b FROM {name}_w
  WHERE regexp_matches(w, '[0-9]') AND regexp_matches(w, '[^0-9]')
    AND round(log2(CAST({WINDOW} AS DOUBLE)) - list_sum(list_transform(range(1, {WINDOW + 1}), lambda k: log2(CAST({WINDOW} - length(replace(w, substr(w, k, 1), '')) AS DOUBLE)))) / {WINDOW}, 9) >= {THRESHOLDS[kind]}
  GROUP BY doc_id, {name}_w.a)"""


SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{_places('assign', ASSIGN)},
{_places('access', ACCESS)},
{_places('hexes', HEX.partition(')')[2])},
{_places('hexruns', RUNS['entropy_hex'].partition(')')[2])},
{_places('runs', RUNS['entropy_base64'].partition(')')[2])},
{_windows('hexruns', 'entropy_hex')},
{_windows('runs', 'entropy_base64', "NOT regexp_full_match(match, '[0-9a-fA-F]+')")},
spans AS (
  SELECT doc_id, 0 AS kind, a, a + length(match) AS b FROM assign WHERE length(regexp_extract(match, '{ASSIGN.replace("'", "''")}', 1)) >= 8
  UNION ALL SELECT doc_id, 1, a, a + length(match) FROM access
  UNION ALL SELECT doc_id, 2, a, a + length(match) FROM hexes
  UNION ALL SELECT doc_id, kind, a, b FROM hexruns_h
  UNION ALL SELECT doc_id, kind, a, b FROM runs_h),
named AS (SELECT doc_id, kind, a, b, ['{"', '".join(KINDS)}'][kind + 1] || ':' || a || ':' || b AS s FROM spans)
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg(s, ',' ORDER BY a, kind) FILTER (kind < 3), '')) AS base_sha256, coalesce(string_agg(s, ',' ORDER BY a, kind), '') AS spans
FROM docs d LEFT JOIN named n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
