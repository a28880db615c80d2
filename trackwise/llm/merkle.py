"""Document fingerprints: a Merkle tree over sections, paragraphs and sentences, with DataFrame functions only.

A paragraph is a line with its line end, and its sentences are the leaves. A
section ends after a blank line, or after a paragraph whose hash ends with one of
two digits of sixteen: such ends depend on nothing but the paragraph, so an edit
moves no other section's ends. A node's hash covers its children's hashes, in
full, so equal roots mean equal texts. A fingerprint is the root and, cut to 64
bits, the hashes of all other nodes: ``root|S:P=L.L,P=L;S:P=L`` for sections,
paragraphs and leaves.

Two fingerprints are compared from the root down. Equal roots: likeness 1. Else
sections that both have (each as often as both have it) match with all their
leaves; only the others are descended into, to paragraphs, and where these differ
to leaves. Leaves of a section that has moved count half. Likeness is the matched
leaves over those of either text, and below 1 where the roots differ. The
differing branches are the edits: sections that were deleted, inserted or moved.

Everything is sorted arrays and set operations on them, so work is n log n in
the length of a text.

Defined cases: null text is empty; the empty text has one empty leaf; rows that
share a doc_id follow each other in the order of their fingerprints and are in one
bucket; a null doc_id takes part in no order and is compared with nothing (null
likeness to a next document, no edit); one document follows itself; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

#: last digits of a paragraph's hash that end a section
ENDS = "08"


def let(name: str, value: str, body: str) -> str:
    """SQL: body with a name for a value that is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def fingerprint(text: str) -> Column:
    """Of a text column that isn't null."""
    leaves = "transform(split(p, '(?<=[.!?] )'), x -> sha2(x, 256))"
    end = f"if(p rlike '^[\\\\x09-\\\\x0D ]+$' or right(h, 1) in ({', '.join(map(repr, ENDS))}), ';', ',')"
    cut = "array_join(transform(l, x -> left(x, 16)), '.')"
    paragraph = let("l", leaves, let("h", "sha2(array_join(l, '.'), 256)", f"concat(h, '=', {cut}, {end})"))
    body = f"regexp_replace(array_join(transform(split({text}, '(?<=\\n)'), p -> {paragraph}), ''), '[,;]$', '')"
    section = "concat(sha2(regexp_replace(s, '=[0-9a-f.]*', ''), 256), ':', s)"
    sections = f"transform(split({body}, ';'), s -> {section})"
    root = "sha2(array_join(transform(t, s -> left(s, 64)), ';'), 256)"
    return F.expr(let("t", sections, f"concat({root}, '|', regexp_replace(array_join(t, ';'), '([0-9a-f]{{16}})[0-9a-f]{{48}}', '$1'))"))


def counted(values: str) -> str:
    """SQL: each value with the number of equal ones before it, in the same order, so that set operations respect repetition."""
    sorted_ = "sort_array(transform(v0, (v, i) -> struct(v, i)))"
    starts = "filter(sequence(0, size(s) - 1), j -> j = 0 or s[j].v <> s[j - 1].v)"
    ranks = "flatten(transform(zip_with(b, concat(slice(b, 2, size(b)), array(size(s))), (x, y) -> y - x), n -> sequence(0, n - 1)))"
    repeated = "transform(sort_array(zip_with(s, r, (x, k) -> struct(x.i as i, concat(x.v, '#', k) as v))), x -> x.v)"
    repeated = let("s", sorted_, let("b", starts, let("r", ranks, repeated)))
    # without repetition there is nothing to sort
    return let("v0", values, f"if(size(array_distinct(v0)) = size(v0), transform(v0, v -> concat(v, '#0')), {repeated})")


def numbers_in(keys: str, chosen: str) -> str:
    """SQL: numbers from 0 of the keys (all distinct) that are among the chosen (some of them), ascending."""
    marked = "sort_array(concat(transform(k0, (k, i) -> struct(k, 0 as c, i)), transform(c0, k -> struct(k, 1 as c, -1 as i))))"
    pairs = "zip_with(slice(m, 1, size(m) - 1), slice(m, 2, size(m) - 1), (x, y) -> if(x.c = 0 and y.c = 1 and x.k = y.k, x.i, -1))"
    some = f"sort_array(filter({let('m', marked, pairs)}, i -> i >= 0))"
    # none and all are the usual cases
    numbers = f"if(size(c0) = 0, cast(array() as array<int>), if(size(c0) = size(k0), transform(k0, (k, i) -> i), {some}))"
    return let("k0", keys, let("c0", chosen, numbers))


def leaves_in(branches: str) -> str:
    """SQL: number of leaves below sections or paragraphs."""
    return f"aggregate({branches}, 0, (n, b) -> n + 2 * length(b) - length(replace(b, '.', '')) - length(replace(b, '=', '')))"


def _pairs(keys: str) -> str:
    """SQL: neighbours, with marks for both ends."""
    padded = f"concat(array('^'), {keys}, array('$'))"
    return let("q", padded, "zip_with(slice(q, 1, size(q) - 1), slice(q, 2, size(q) - 1), (x, y) -> concat(x, '>', y))")


def compare(rows: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """rows with a struct column of the comparison of two fingerprint columns, null if either is.

    likeness, and the numbers of deleted sections (in a), of inserted and of moved ones (in b).
    """
    c = lambda part: f"_{name}_{part}"
    strip = lambda keys: f"transform({keys}, k -> substring_index(k, '#', 1))"
    differ = f"left({a}, 64) <> left({b}, 64)"
    out = rows
    for side, of in (("a", a), ("b", b)):
        out = out.withColumn(c(side), F.expr(f"case when {differ} then {counted(let('x', f'split(substring({of}, 66), {chr(39)};{chr(39)})', 'x'))} end"))
    out = out.withColumn(c("both"), F.expr(f"array_intersect({c('a')}, {c('b')})"))
    out = out.withColumn(c("broken"), F.expr(f"array_except({_pairs(f'array_intersect({c(chr(98))}, {c(chr(97))})')}, {_pairs(c('both'))})"))
    out = out.withColumn(c("moved"), F.expr(f"array_intersect(transform({c('broken')}, p -> substring_index(p, '>', 1)), transform({c('broken')}, p -> substring_index(p, '>', -1)))"))
    for side in "ab":
        rest = strip(f"array_except({c(side)}, {c('both')})")
        out = out.withColumn(c(f"p{side}"), F.expr(counted(f"flatten(transform({rest}, s -> split(substring(s, 18), ',')))")))
    out = out.withColumn(c("paragraphs"), F.expr(f"array_intersect({c('pa')}, {c('pb')})"))
    for side in "ab":
        rest = strip(f"array_except({c('p' + side)}, {c('paragraphs')})")
        out = out.withColumn(c(f"l{side}"), F.expr(counted(f"flatten(transform({rest}, p -> split(substring(p, 18), '\\\\.')))")))
    matched = f"({leaves_in(c('both'))} - 0.5D * {leaves_in(c('moved'))} + {leaves_in(c('paragraphs'))} + size(array_intersect({c('la')}, {c('lb')})))"
    leaves = f"({leaves_in(c('a'))} + {leaves_in(c('b'))})"
    out = out.withColumns({c("m"): F.expr(matched), c("n"): F.expr(leaves)})
    likeness = f"case when {a} is null or {b} is null then null when {differ} then least({c('m')} / ({c('n')} - {c('m')}), 1D - 1D / {c('n')}) else 1D end"
    none = "cast(array() as array<int>)"
    lists = {
        "deleted": numbers_in(c("a"), f"array_except({c('a')}, {c('both')})"), "inserted": numbers_in(c("b"), f"array_except({c('b')}, {c('both')})"), "moved": numbers_in(c("b"), c("moved")),
    }
    made = f"if({a} is null or {b} is null, null, named_struct('likeness', {likeness}, {', '.join(f'{chr(39)}{k}{chr(39)}, coalesce({v}, {none})' for k, v in lists.items())}))"
    return out.withColumn(name, F.expr(made)).select(*rows.columns, name)


def in_buckets(rows: DataFrame, scratch: Scratch, least_buckets: int = 512, bucket_bytes: int = 16 << 20, unit: int = 4096) -> DataFrame:
    """rows with a bucket of neighbouring doc_ids, and as guests the rows that come after each bucket's last.

    A row weighs one unit, and one more for each ``unit`` bytes of text. Ranges of doc_id with about as many units each are
    found by Spark's range partitioning of the units; a row's bucket is found among their first doc_ids by halving. The
    guests of a bucket are the first document of the next one, and of the first bucket for the last.
    """
    units = scratch.write(rows.select("doc_id", (1 + F.octet_length("text") / unit).cast("int").alias("units")), "units")
    total = units.agg(F.sum("units")).first()[0] or 0
    buckets = max(least_buckets, -(-total * unit // bucket_bytes))
    ranged = units.select("doc_id", F.explode(F.sequence(F.lit(1), "units"))).repartitionByRange(buckets, "doc_id")
    cuts = sorted(r["first"] for r in ranged.groupBy(F.spark_partition_id().alias("range")).agg(F.min("doc_id").alias("first")).collect())[1:]
    middle = "(s.low + s.high) div 2"
    halving = f"aggregate(sequence(1, {max(1, len(cuts).bit_length() + 1)}), struct(0L as low, {len(cuts)}L as high), (s, i) -> if(s.low >= s.high, s, if(cuts[{middle}] <= doc_id, struct({middle} + 1 as low, s.high as high), struct(s.low as low, {middle} as high))), s -> s.low)"
    number = F.expr(let("cuts", f"from_json('{json.dumps(cuts)}', 'array<bigint>')", halving)) if cuts else F.lit(0).cast("long")
    # one row for each bucket from here on
    firsts = units.select("doc_id").withColumn("bucket", number).groupBy("bucket").agg(F.min("doc_id").alias("doc_id"))
    host = F.coalesce(F.lag("bucket").over(Window.orderBy("bucket")), F.max("bucket").over(Window.partitionBy(F.lit(0))))
    firsts = firsts.select("doc_id", host.alias("bucket"))
    guests = rows.join(F.broadcast(firsts), "doc_id").withColumn("guest", F.lit(True))
    return rows.withColumn("bucket", number).withColumn("guest", F.lit(False)).unionByName(guests)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text and fingerprint of each document."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.withColumn("fingerprint", fingerprint("text"))


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose second half is the start of the next document.

    doc_id, n_chars, edited text, both fingerprints, near_edited, near_next, and edits: the deleted, inserted and moved sections.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known, other = texts.where("doc_id is not null"), texts.where("doc_id is null")
    order = Window.partitionBy("bucket").orderBy("guest", "doc_id", "fingerprint")
    both = in_buckets(known, scratch).withColumn("fingerprint", fingerprint("text")).withColumn("next", F.lead(F.struct("text", "fingerprint")).over(order)).where("not guest")
    both = both.select("doc_id", "text", "fingerprint", "next").unionByName(other.withColumn("fingerprint", fingerprint("text")), allowMissingColumns=True)
    both = both.withColumn("n_chars", F.length("text"))
    edited = F.expr("if(next is null, text, concat(left(text, n_chars - n_chars div 2), left(next.text, cast(n_chars div 2 as int))))")
    both = both.select("doc_id", "n_chars", edited.alias("edited"), "fingerprint", F.col("next.fingerprint").alias("next_fingerprint"))
    both = both.withColumn("edited_fingerprint", fingerprint("edited"))
    both = compare(compare(both, "fingerprint", "edited_fingerprint", "edits"), "fingerprint", "next_fingerprint", "next")
    return both.select("doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", F.col("edits.likeness").alias("near_edited"), F.col("next.likeness").alias("near_next"), F.col("edits").dropFields("likeness").alias("edits"))
