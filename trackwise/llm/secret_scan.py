"""Secret scan by a battery of randomness tests, with DataFrame functions only.

Base patterns find assignments, access keys and long hex runs. The method adds
spans of kind ``random``. Its tokens are runs of at least 20 characters of a code
alphabet that are no plain number and don't overlap a base span. Each gets the
encoding that its characters imply (hex, base32, base64) and the p-values, under
uniform random symbols of that encoding, of

* a chi-squared test of uniform use of the alphabet, in bins,
* a runs test about the middle of the alphabet,
* a lag-one serial-correlation test,

combined by the Cauchy combination, which holds for dependent tests. Over all
tokens of the table, the Benjamini-Hochberg procedure at ``RATE``, with weights
proportional to length (long tokens give the tests power), finds the tokens that
aren't random; the others are reported. p-values are rounded up to 16 steps for
each halving first, so the procedure needs a bounded table of counts and no sort.

Matches leave their text with the lengths of the gaps between them, and places are
running sums over these, so work grows with the length of a text.

Defined cases: null text is empty; rows are scanned row by row, repeated ones and
those without a doc_id too; an empty table gives an empty result; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

# The base patterns, and the words that an assignment begins with.
ASSIGN = "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGNED = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{32,}"
TOKEN = "[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")

#: share of wrongly found among the tokens found not to be random
RATE = 0.05
#: steps of a p-value for each halving, and the last step
STEPS, LAST = 16, 960

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: encoding -> alphabet and the bin of each of its symbols; longer tokens of base64 have finer bins
ENCODINGS = {
    "hex": (DIGITS + LOWER[:6], "a" * 4 + "b" * 4 + "c" * 4 + "d" * 4),
    "base32": (UPPER + "234567", "a" * 8 + "b" * 8 + "c" * 10 + "d" * 6),
    "base64": (UPPER + LOWER + DIGITS + "+/", "a" * 26 + "b" * 26 + "c" * 12),
    "base64 long": (UPPER + LOWER + DIGITS + "+/", "a" * 9 + "b" * 9 + "c" * 8 + "d" * 9 + "e" * 9 + "f" * 8 + "g" * 12),
}


def sql_text(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def by_encoding(value) -> str:
    """SQL: the value of a token's encoding."""
    return "case encoding " + " ".join(f"when '{name}' then {value(*of)}" for name, of in ENCODINGS.items()) + " end"


def chi_square(count) -> str:
    """SQL for the statistic; count: SQL for the number of symbols in a bin."""

    def of(alphabet: str, bins: str) -> str:
        share = {b: bins.count(b) / len(alphabet) for b in sorted(set(bins))}
        return " + ".join(f"pow({count(b)} - n * {s!r}e0, 2) / (n * {s!r}e0)" for b, s in share.items())

    return by_encoding(of)


# SQL that engines share: z-values, two-sided normal tails (to within a few percent), and the combined p-value.
FREEDOM = by_encoding(lambda alphabet, bins: f"{len(set(bins)) - 1}e0")
Z_CHI = "(pow(chi / freedom, 1e0 / 3e0) - (1e0 - 2e0 / (9e0 * freedom))) / sqrt(2e0 / (9e0 * freedom))"
Z_RUNS = "case when ups = 0 or ups = n then 99e0 else (runs - 1e0 - 2e0 * ups * (n - ups) / n) / sqrt(greatest(1e-9, 2e0 * ups * (n - ups) * (2e0 * ups * (n - ups) - n) / (1e0 * n * n * (n - 1)))) end"
Z_SERIAL = "(pairs - mean * (2e0 * total - first_x - last_x) + (n - 1) * mean * mean) / greatest(1e-9, squares - n * mean * mean) * sqrt(1e0 * n)"


def tail(z: str) -> str:
    return f"exp(-0.717e0 * abs({z}) - 0.416e0 * {z} * {z})"


P_CHI = f"case when z_chi > 0 then {tail('z_chi')} / 2 else 1 - {tail('z_chi')} / 2 end"


def tangent(p: str) -> str:
    return f"tan((0.5e0 - least(0.99e0, greatest(1e-15, {p}))) * pi())"


P_VALUE = f"0.5e0 - atan(({tangent('p_chi')} + {tangent('p_runs')} + {tangent('p_serial')}) / 3) / pi()"
STEP = f"cast(least({LAST}, greatest(0, floor(-{STEPS} * log2(p * mean_n / n)))) as int)"


def _pieces(pattern: str, gate: str) -> str:
    """SQL: matches of a pattern in ``text`` with the lengths of the gaps before them; the text is only cut where the gate holds."""
    p = sql_text(pattern)
    return f"case when {gate} then filter(zip_with(split(text, {p}, -1), regexp_extract_all(text, {p}, 0), (gap, value) -> struct(length(gap) as gap, value)), x -> x.value is not null) end"


def _matches(docs: DataFrame) -> DataFrame:
    """A row for each document: number, doc_id and the matches of each kind."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    word = " or ".join(f"contains(lower(text), '{w}')" for w in ASSIGNED)
    gates = {"assign": (ASSIGN, word), "access": (ACCESS, "contains(text, 'AKIA')"), "hex": (HEX, f"text rlike '{HEX}'"), "random": (TOKEN, f"text rlike {sql_text(TOKEN)}")}
    return texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", *[F.expr(_pieces(*of)).alias(kind) for kind, of in gates.items()])


def _places(found: DataFrame) -> DataFrame:
    """(row, rank, start, end, value) of all matches that count: assignments of 8 characters, access keys of 16."""
    listed = [f"transform(coalesce({kind}, array()), (x, i) -> struct({rank} as rank, i as i, x.gap as gap, x.value as value))" for rank, kind in enumerate(KINDS)]
    flat = found.select("row", F.expr(f"inline(concat({', '.join(listed)}))"))
    flat = flat.withColumn("end", F.sum(F.col("gap") + F.length("value")).over(Window.partitionBy("row", "rank").orderBy("i")))
    long = F.expr(f"case rank when 0 then length(regexp_extract(value, {sql_text('^' + ASSIGN)}, 2)) >= 8 when 1 then length(value) >= 16 else true end")
    return flat.where(long).select("row", "rank", (F.col("end") - F.length("value")).cast("int").alias("start"), F.col("end").cast("int").alias("end"), "value")


def _clear(places: DataFrame) -> DataFrame:
    """Tokens that overlap no base span: no base span that starts before a token's end ends behind its start."""
    token = F.col("rank") == 3
    order = Window.partitionBy("row").orderBy(F.when(token, F.col("end")).otherwise(F.col("start")), F.when(token, 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, 0)
    reach = F.coalesce(F.max(F.when(~token, F.col("end"))).over(order), F.lit(0))
    return places.withColumn("reach", reach).where(token & (F.col("reach") <= F.col("start"))).select("row", "start", "end", "value")


def _battery(tokens: DataFrame) -> DataFrame:
    """tokens (value) -> with n and p, the combined p-value; those of fewer than 16 symbols, and numbers, are left out."""
    code = "case when symbols rlike '^[0-9a-f]+$' then 'hex' when symbols rlike '^[A-Z2-7]+$' then 'base32' when n < 40 then 'base64' else 'base64 long' end"
    t = tokens.withColumn("symbols", F.expr("translate(rtrim('=', value), '-_', '+/')")).withColumn("n", F.length("symbols"))
    t = t.where("n >= 16 and not symbols rlike '^[0-9]+$' and not contains(symbols, '=')").withColumn("encoding", F.expr(code))
    t = t.withColumn("binned", F.expr(by_encoding(lambda alphabet, bins: f"translate(symbols, '{alphabet}', '{bins}')")))
    t = t.withColumn("halves", F.expr(by_encoding(lambda alphabet, bins: f"translate(symbols, '{alphabet}', '{'d' * (len(alphabet) // 2) + 'u' * (len(alphabet) // 2)}')")))
    t = t.withColumn("x", F.expr(by_encoding(lambda alphabet, bins: f"transform(filter(split(symbols, ''), c -> c <> ''), c -> cast(instr('{alphabet}', c) - 1 as bigint))")))
    t = t.withColumns({"chi": F.expr(chi_square(lambda b: f"(n - length(replace(binned, '{b}', '')))")), "freedom": F.expr(FREEDOM)})
    t = t.withColumns({"ups": F.expr("n - length(replace(halves, 'u', ''))"), "runs": F.expr("length(regexp_replace(regexp_replace(halves, 'u+', 'u'), 'd+', 'd'))")})
    add = "aggregate({}, 0L, (s, q) -> s + q)"
    t = t.withColumns({
        "total": F.expr(add.format("x")), "squares": F.expr(add.format("transform(x, q -> q * q)")), "pairs": F.expr(add.format("zip_with(slice(x, 1, n - 1), slice(x, 2, n - 1), (a, b) -> a * b)")),
        "first_x": F.expr("x[0]"), "last_x": F.expr("x[n - 1]"),
    })
    t = t.withColumn("mean", F.expr("1e0 * total / n")).withColumns({"z_chi": F.expr(Z_CHI), "z_runs": F.expr(Z_RUNS), "z_serial": F.expr(Z_SERIAL)})
    t = t.withColumns({"p_chi": F.expr(P_CHI), "p_runs": F.expr(tail("z_runs")), "p_serial": F.expr(tail("z_serial"))})
    return t.withColumn("p", F.expr(f"greatest(1e-18, {P_VALUE})")).select("row", "start", "end", "n", "p")


def _random(tokens: DataFrame) -> DataFrame:
    """Tokens (n, p) that the weighted Benjamini-Hochberg procedure over the table doesn't find not to be random."""
    mean = tokens.agg(F.avg("n").alias("mean_n"))  # one row
    stepped = tokens.crossJoin(F.broadcast(mean)).withColumn("step", F.expr(STEP))
    counts = stepped.groupBy("step").agg(F.count("*").alias("times"))  # at most LAST + 1 rows
    falling = Window.orderBy(F.desc("step"))
    counts = counts.withColumn("found", F.sum("times").over(falling)).withColumn("all", F.sum("times").over(Window.partitionBy(F.lit(0))))
    last = counts.where(F.expr(f"pow(2e0, -step / {STEPS}e0) * `all` <= {RATE}e0 * found")).agg(F.coalesce(F.min("step"), F.lit(LAST + 1)).alias("ordinary"))
    return stepped.crossJoin(F.broadcast(last)).where("step < ordinary").select("row", "start", "end")


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and spans array<struct<start, rank, end, kind>> in code points, by start and then kind as in ``KINDS``."""
    scratch = Scratch(docs.sparkSession, "secret-scan")
    found = scratch.write(_matches(docs), "found")
    places = _places(found.where(" or ".join(f"size({kind}) > 0" for kind in KINDS)))
    tokens = scratch.write(_battery(_clear(places)), "tokens")
    base = places.where("rank < 3").select("row", "start", "rank", "end")
    spans = base.unionByName(_random(tokens).withColumn("rank", F.lit(3)))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("rank") + 1)
    listed = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", kind.alias("kind")))).alias("spans"))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    return found.select("row", "doc_id").join(listed, "row", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))
