"""The contract queries of the corpus operators, and their DuckDB forms where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, collocations, decontaminate, jaccard_join, license_scan, merkle, mixing, quality, secret_scan, sharding, substring_dedup, toxicity, vector_codes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats all conversations and one of control strings; the digests are read back from the output."""
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    hard = spark.createDataFrame([(-7, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    template = chat_format.ChatTemplate()
    read = chat_format.read_back(chat_format.format_conversations(rows.unionByName(hard), template), template)
    loss = chat_format.unescaped(template, "array_join(transform(filter(segments, s -> s.loss), s -> s.text), '')")
    return read.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.expr("sha2(array_join(transform(read, t -> concat(t.role, '\\n', t.text, '\\n')), ''), 256)").alias("turns_sha256"),
        F.expr(f"cast(length({loss}) as bigint)").alias("loss_chars"),
        F.expr(f"sha2({loss}, 256)").alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


OP1_SQL = """
with r as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), w as (select *, lag(role) over (partition by conv_id order by turn nulls first, role, text) as before, lead(role) over (partition by conv_id order by turn nulls first, role, text) as after from r)
select cast(conv_id as bigint) as conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(13 + length(role) + length(text) + length(regexp_replace(role || text, '[^<\\[\\\\]', '', 'g'))) as bigint) as formatted_chars,
  bool_and(case when before is null then role in ('system', 'user') when before = 'system' then role = 'user' when before = 'user' then role = 'assistant' else before = 'assistant' and role = 'user' end
    and (after is not null or role = 'assistant')) as valid
from w group by conv_id
"""


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of every document."""
    return sharding.assign_shards(_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id")))


def _op2_sql() -> str:
    table = sharding.lookup_table(sharding.SHARDS, sharding.SLOTS)
    return f"""
with t as (select unnest(range({sharding.SLOTS})) as slot, unnest([{','.join(map(str, table))}]) as n)
select cast(doc_id as bigint) as doc_id, cast(slot as integer) as slot, 'shard-' || lpad(cast(n as varchar), 3, '0') as shard
from documents join t on slot = cast('0x' || left(md5(coalesce(cast(doc_id as varchar), '')), 8) as bigint) % {sharding.SLOTS}
"""


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words covered by 50-word windows that an earlier document has."""
    return substring_dedup.substring_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP3_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
p as (select doc_id, i, list_aggregate(w[i:i+49], 'string_agg', ' ') as win from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 48))) as i from d)),
f as (select win, min(doc_id) as first from p group by win),
c as (select distinct doc_id, unnest(range(i, i + 50)) as pl from p join f using (win) where doc_id > first),
g as (select doc_id, list(pl) as gone from c group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(len(gone), 0) as bigint) as n_removed,
  sha256(coalesce(list_aggregate(list_filter(w, lambda x, i: gone is null or not list_contains(gone, i)), 'string_agg', ' '), '')) as kept_sha256
from d left join g using (doc_id)
"""


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document words inside occurrences of 10-word benchmark windows."""
    hits = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    n_hit = F.expr("aggregate(zip_with(starts, ends, (a, b) -> b - a), 0, (s, x) -> s + x)").cast("long")
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), (F.size("starts") > 0).alias("contaminated"))


OP4_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
q as (select distinct item, least(10, len(w)) as n, list_aggregate(w[i:i+least(10, len(w))-1], 'string_agg', ' ') as win from (select item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)),
p as (select doc_id, i, n, list_aggregate(w[i:i+n-1], 'string_agg', ' ') as win from (select doc_id, w, n, unnest(range(1, greatest(1, len(w) - n + 2))) as i from d, (select distinct n from q))),
h as (select doc_id, i, p.n, item from p join q on p.win = q.win and p.n = q.n),
g as (select doc_id, count(distinct pl) as n_hit from (select doc_id, unnest(range(i, i + n)) as pl from h) group by doc_id),
s as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from h) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join g using (doc_id) left join s using (doc_id)
"""


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a Jaccard similarity of 0.9 or more."""
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"))


OP5_SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, list_aggregate(w[i:i+2], 'string_agg', ' ') as g from (select doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
o as (select a.doc_id as a, b.doc_id as b, count(*) as sh from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * sh >= 90 * (x.n + y.n - sh)),
e as (select a, b from l union all select b, a from l),
r(doc_id, seen) as (select doc_id, doc_id from d union select e.b, r.seen from r join e on e.a = r.doc_id)
select doc_id, coalesce(any_value(n), 0) as n_shingles, min(seen) as component_id from r left join n using (doc_id) group by doc_id
"""


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of base phrases and all labels of every document."""
    found = license_scan.scan_licenses(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", F.size("base_at").cast("long").alias("n_base"), F.array_min("base_at").alias("first_word"), F.array_max("base_at").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


def _op6_sql() -> str:
    """Each rule over the whole words, its keywords as a plain condition, positions from the gaps; suppression by an anti-join."""
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # every word has a blank of its own on either side, so a match takes no blank from the next one
    rules = ",\n".join("('{}', {}, [{}], '{}')".format(label, priority, ", ".join(f"'{w}'" for w in words), f" (?:{text.replace(' ', '  ')}) ") for label, priority, words, text in license_scan.RULES)
    phrases = ", ".join(f"('{label}', {phrase.split()!r})" for phrase, label in license_scan.BASE_PHRASES)
    blanks = "(length({0}) - length(replace({0}, ' ', '')))"
    return f"""
with d as (select doc_id, regexp_extract_all({lowered}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
c as (select doc_id, w, ' ' || array_to_string(w, '  ') || ' ' as t from d),
r(label, priority, words, pattern) as (values {rules}),
h as (select doc_id, label, priority, string_split_regex(t, pattern) as gaps, regexp_extract_all(t, pattern) as hits from c join r on list_has_any(w, words)),
i as (select *, unnest(range(1, len(hits) + 1)) as i from h),
s as (select distinct doc_id, label, priority, cast((list_sum(list_transform(gaps[1:i], lambda x: {blanks.format('x')})) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: {blanks.format('x')})), 0)) // 2 as bigint) as a, cast({blanks.format('hits[i]')} // 2 as bigint) as n from i),
k as (select * from s where not exists (select 1 from s o where o.doc_id = s.doc_id and o.a <= s.a and s.a + s.n <= o.a + o.n
  and (o.priority > s.priority or (o.priority = s.priority and (o.n > s.n or (o.n = s.n and o.label < s.label)))))),
f as (select doc_id, list_distinct(list(label)) as labels, max(priority) as priority from k group by doc_id),
p(label, phrase) as (values {phrases}),
q as (select doc_id, label, phrase, w, unnest(range(1, greatest(1, len(w) - len(phrase) + 2))) as place from d, p),
b as (select doc_id, count(*) as n_base, min(place) - 1 as first_word, max(place) - 1 as last_word, list_distinct(list(label)) as labels from q where w[place:place + len(phrase) - 1] = phrase group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, array_to_string(list_sort(coalesce(b.labels, [])), ',') as base_labels,
  array_to_string(list_sort(list_distinct(coalesce(b.labels, []) || coalesce(f.labels, []))), ',') as labels, greatest(coalesce(f.priority, 0), case when n_base > 0 then {license_scan.BASE_SCORE} else 0 end) / 100e0 as score
from d left join f using (doc_id) left join b using (doc_id)
"""


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and the sections that the edit touched."""
    both = merkle.compare_with_next(_table(spark, sf_dir, "documents"))
    edits = F.expr("concat('deleted:', array_join(edits.deleted, ','), ';inserted:', array_join(edits.inserted, ','), ';moved:', array_join(edits.moved, ','))")
    return both.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next", edits.alias("edits"))


def _op7_sql() -> str:
    """The tree as nested lists; likeness from counts of equal leaves and of the leaves of moved sections, without descending."""
    leaves = r"list_transform(string_split(regexp_replace(p, '([.!?] )', '\1' || chr(31), 'g'), chr(31)), lambda x: sha256(x))"
    end = "case when regexp_full_match(p, '[\\x09-\\x0D ]+') or right(sha256(array_to_string(l, '.')), 1) in ('0', '8') then ';' else ',' end"

    def sections(text: str) -> str:
        paragraphs = f"list_transform(string_split(replace({text}, chr(10), chr(10) || chr(31)), chr(31)), lambda p: {{'p': p, 'l': {leaves}}})"
        body = f"array_to_string(list_transform({paragraphs}, lambda q: sha256(array_to_string(q.l, '.')) || '=' || array_to_string(q.l, '.') || {end.replace('(p,', '(q.p,').replace('(l,', '(q.l,')}), '')"
        return f"list_transform(string_split(regexp_replace({body}, '[,;]$', ''), ';'), lambda s: sha256(regexp_replace(s, '=[0-9a-f.]*', '', 'g')) || ':' || s)"

    whole = "sha256(array_to_string(list_transform({0}, lambda s: left(s, 64)), ';')) || '|' || regexp_replace(array_to_string({0}, ';'), '([0-9a-f]{{16}})[0-9a-f]{{48}}', '\\1', 'g')"
    return f"""
with o as (select doc_id, coalesce(text, '') as text from documents),
n as (select *, coalesce(lead(text) over (order by doc_id), first_value(text) over (order by doc_id)) as nxt, coalesce(lead(doc_id) over (order by doc_id), first_value(doc_id) over (order by doc_id)) as next_id from o),
e as (select *, left(text, length(text) - length(text) // 2) || left(nxt, length(text) // 2) as edited from n),
t as (select *, {sections('text')} as sa, {sections('edited')} as sb from e),
u as (select *, {whole.format('sa')} as fa, {whole.format('sb')} as fb from t),
c as (select u.doc_id, 'edited' as kind, u.fa as a, u.fb as b from u union all select u.doc_id, 'next', u.fa, x.fa from u join u x on x.doc_id = u.next_id),
s as (select doc_id, kind, side, unnest(string_split(f[66:], ';')) as entry, unnest(range(len(string_split(f[66:], ';')))) as i from (select doc_id, kind, unnest(['a', 'b']) as side, unnest([a, b]) as f from c where left(a, 64) <> left(b, 64))),
k as (select *, entry || '#' || (row_number() over (partition by doc_id, kind, side, entry order by i)) as key from s),
q as (select k.*, p.i is not null as paired from k left join k p on p.doc_id = k.doc_id and p.kind = k.kind and p.side <> k.side and p.key = k.key),
w as (select *, lag(key) over g as before, lead(key) over g as after from q where paired window g as (partition by doc_id, kind, side order by i)),
m as (select b.doc_id, b.kind, b.i, b.entry from w a join w b on a.doc_id = b.doc_id and a.kind = b.kind and a.key = b.key and a.side = 'a' and b.side = 'b' where a.before is distinct from b.before and a.after is distinct from b.after),
l as (select doc_id, kind, side, unnest(flatten(list_transform(string_split(entry[18:], ','), lambda p: string_split(p[18:], '.')))) as leaf from s),
y as (select doc_id, kind, leaf, count(*) filter (side = 'a') as na, count(*) filter (side = 'b') as nb from l group by all),
z as (select doc_id, kind, sum(least(na, nb)) as same, sum(na + nb) as n from y group by all),
v as (select doc_id, kind, sum(length(entry) - length(translate(entry, '.=', ''))) as moved from m group by all),
r as (select doc_id, kind, cast(n as double) as n, cast(same as double) - 0.5e0 * coalesce(moved, 0) as same from z left join v using (doc_id, kind)),
h as (select doc_id, kind, least(same / (n - same), 1e0 - 1e0 / n) as likeness from r),
x as (select doc_id, string_agg(i, ',' order by i) filter (side = 'a' and not paired) as deleted, string_agg(i, ',' order by i) filter (side = 'b' and not paired) as inserted from q where kind = 'edited' group by doc_id),
j as (select doc_id, string_agg(i, ',' order by i) as moved from m where kind = 'edited' group by doc_id)
select u.doc_id, length(text) as n_chars, sha256(edited) as edited_sha256, fa as fingerprint, fb as edited_fingerprint, coalesce(he.likeness, 1e0) as near_edited, coalesce(hn.likeness, 1e0) as near_next,
  'deleted:' || coalesce(deleted, '') || ';inserted:' || coalesce(inserted, '') || ';moved:' || coalesce(j.moved, '') as edits
from u left join h he on he.doc_id = u.doc_id and he.kind = 'edited' left join h hn on hn.doc_id = u.doc_id and hn.kind = 'next' left join x on x.doc_id = u.doc_id left join j on j.doc_id = u.doc_id
"""


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and random spans of every document."""
    found = secret_scan.scan_secrets(_table(spark, sf_dir, "documents"))
    line = "array_join(transform({0}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    base = "filter(spans, s -> s.rank < 3)"
    counts = [F.expr(f"cast(size(filter(spans, s -> s.rank = {i})) as bigint)").alias(f"n_{kind}") for i, kind in enumerate(("assign", "access", "hex"))]
    return found.select("doc_id", *counts, F.expr(f"sha2({line.format(base)}, 256)").alias("base_sha256"), F.expr(line.format("spans")).alias("spans"))


def _op8_sql() -> str:
    """Base spans from the gaps between matches, tokens by a plain overlap condition, the battery over unnested symbols, and the false-discovery step over sorted p-values."""
    either = "".join(c if c in "|?_" else f"[{c.upper()}{c}]" for c in "password|passwd|secret|token|api_?key")
    assign = f"({either})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
    kinds = (("assign", assign, f"length(regexp_extract(value, '^{assign}', 2)) >= 8"), ("access", secret_scan.ACCESS, "length(value) >= 16"), ("hex", "[0-9a-f]+", "length(value) >= 32"), ("random", "[A-Za-z0-9+/_=-]+", "length(value) >= 20"))
    cut = " union all ".join(f"select doc_id, {rank} as rank, '{kind}' as kind, string_split_regex(t, '{p}') as gaps, regexp_extract_all(t, '{p}') as hits from d" for rank, (kind, p, _) in enumerate(kinds))
    keep = " ".join(f"when {rank} then {cond}" for rank, (_, _, cond) in enumerate(kinds))
    binned = secret_scan.by_encoding(lambda alphabet, bins: f"translate(symbols, '{alphabet}', '{bins}')")
    place = secret_scan.by_encoding(lambda alphabet, bins: f"list_transform(string_split(symbols, ''), lambda c: instr('{alphabet}', c) - 1)")
    half = secret_scan.by_encoding(lambda alphabet, bins: f"{len(alphabet) // 2}")
    chi = secret_scan.chi_square(lambda b: f"(n - length(replace(binned, '{b}', '')))")
    steps = secret_scan.STEPS
    line = "string_agg(kind || ':' || a || ':' || z, ',' order by a, rank, z)"
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
m as ({cut}),
i as (select *, unnest(range(1, len(hits) + 1)) as i from m),
e as (select doc_id, rank, kind, hits[i] as value, cast(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + list_sum(list_transform(hits[1:i], lambda x: length(x))) as bigint) as z from i),
s as (select *, z - length(value) as a from e where case rank {keep} end),
b as (select * from s where rank < 3),
w as (select * from s where rank = 3 and not exists (select 1 from b where b.doc_id = s.doc_id and b.a < s.z and s.a < b.z)),
t1 as (select *, translate(rtrim(value, '='), '-_', '+/') as symbols from w),
t2 as (select *, length(symbols) as n from t1 where length(symbols) >= 16 and not regexp_full_match(symbols, '[0-9]+') and not contains(symbols, '=')),
t3 as (select *, case when regexp_full_match(symbols, '[0-9a-f]+') then 'hex' when regexp_full_match(symbols, '[A-Z2-7]+') then 'base32' when n < 40 then 'base64' else 'base64 long' end as encoding from t2),
t4 as (select *, {binned} as binned, {place} as x, {half} as half from t3),
t5 as (select *, {chi} as chi, {secret_scan.FREEDOM} as freedom, len(list_filter(x, lambda q: q >= half)) as ups,
  1 + len(list_filter(range(2, n + 1), lambda j: (x[j] >= half) <> (x[j - 1] >= half))) as runs, list_sum(x) as total, list_sum(list_transform(x, lambda q: q * q)) as squares,
  list_sum(list_transform(range(2, n + 1), lambda j: x[j] * x[j - 1])) as pairs, x[1] as first_x, x[n] as last_x from t4),
t6 as (select *, 1e0 * total / n as mean from t5),
t7 as (select *, {secret_scan.Z_CHI} as z_chi, {secret_scan.Z_RUNS} as z_runs, {secret_scan.Z_SERIAL} as z_serial from t6),
t8 as (select *, {secret_scan.P_CHI} as p_chi, {secret_scan.tail('z_runs')} as p_runs, {secret_scan.tail('z_serial')} as p_serial from t7),
t9 as (select *, greatest(1e-18, {secret_scan.P_VALUE}) as p, avg(n) over () as mean_n from t8),
g as (select *, pow(2e0, -{secret_scan.STEP} / {steps}e0) as q from t9),
o as (select *, row_number() over (order by q) as place, count(*) over () as times from g),
c as (select coalesce(max(q), -1) as ordinary from o where q <= {secret_scan.RATE}e0 * place / times),
f as (select doc_id, rank, kind, a, z from b union all select doc_id, rank, kind, a, z from g, c where q > ordinary)
select d.doc_id, count(*) filter (rank = 0) as n_assign, count(*) filter (rank = 1) as n_access, count(*) filter (rank = 2) as n_hex,
  sha256(coalesce({line} filter (rank < 3), '')) as base_sha256, coalesce({line} filter (rank is not null), '') as spans from d left join f on f.doc_id = d.doc_id group by d.doc_id
"""


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents from a model that never saw the held-out third."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    scored = quality.score_documents(docs, model)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: weights of the mixing query: an integer for each named child, 1 for others
MIX_WEIGHTS = {"domain": {"domain0": 3, "domain1": 2}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 1}}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 60, 2, 17


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is taken when 60 percent of all tokens are mixed to target weights."""
    return mixing.mix_sources(_table(spark, sf_dir, "documents"), MIX_SHARE, MIX_WEIGHTS, MIX_EPOCHS, MIX_SEED)


def _op10_sql() -> str:
    levels, steps, parent = mixing.LEVELS, [], "top"
    for depth, name in enumerate(levels):
        own = ", ".join(levels[: depth + 1])
        up = ", ".join(levels[:depth])
        by = f"partition by {up}" if up else ""
        weight = " ".join(["case", *(f"when {name} = '{k}' then {v}" for k, v in MIX_WEIGHTS.get(name, {}).items()), "when true then 1 end"])
        join = f"join {parent} using ({up})" if up else f"cross join {parent}"
        before = "rows between unbounded preceding and 1 preceding"
        # fill: the children full before and with each child, in the order of cap / weight
        steps.append(f"""
c{depth} as (select {own}, sum(cap) as cap, cast({weight} as bigint) as weight from leaf group by {own}),
o{depth} as (select c.*, budget, coalesce(sum(cap) over ({by} order by cap / weight, {name} {before}), 0) as caps, sum(weight) over ({by} order by cap / weight desc, {name} desc) as weights from c{depth} c {join}),
f{depth} as (select *, sum(case when greatest(budget - caps, 0) * weight >= cap * weights then 0 else 1 end) over ({by} order by cap / weight, {name} rows unbounded preceding) = 0 as is_full from o{depth}),
g{depth} as (select {own}, case when is_full then cap else (budget - coalesce(sum(cap) filter (is_full) over ({by}), 0)) * weight // sum(weight) filter (not is_full) over ({by}) end as budget from f{depth})""")
        parent = f"g{depth}"
    body = ",".join(steps)
    own = ", ".join(levels)
    return f"""
with d as (select doc_id, 'domain' || cast(coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) as bigint) % {mixing.DOMAINS}, 0) as varchar) as domain, lang, source,
  cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as n_tokens from documents),
leaf as (select {own}, cast(sum(n_tokens) as hugeint) as tokens, cast(sum(n_tokens) * {MIX_EPOCHS} as hugeint) as cap from d group by {own}),
top as (select least(sum(cap), sum(tokens) * {MIX_SHARE} // 100) as budget from leaf),{body},
k as (select d.*, cast(budget as bigint) as leaf_budget, budget // tokens as whole, budget - budget // tokens * tokens as rest,
  md5('{MIX_SEED}:' || cast(cast(budget // tokens as bigint) as varchar) || ':' || cast(doc_id as varchar)) as key from d join leaf using ({own}) join {parent} using ({own}))
select doc_id, domain, lang, source, n_tokens, leaf_budget,
  cast(whole + case when sum(n_tokens) over (partition by {own} order by key) <= rest then 1 else 0 end as bigint) as copies from k
"""


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of each language by their weakest cut."""
    return collocations.collocations(_table(spark, sf_dir, "documents").select("text", "lang"))


OP11_SQL = r"""
with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as piece from d)),
g as (select lang, size, list_aggregate(w[i:i + size - 1], 'string_agg', ' ') as phrase
  from (select lang, w, size, unnest(range(1, len(w) - size + 2)) as i from p, (values (1), (2), (3), (4)) s(size) where len(w) >= size)),
f as materialized (select lang, size, phrase, count(*) as f from g group by all),
total as (select lang, sum(f) as n from f where size = 1 group by lang),
c as materialized (select lang, size, phrase, f as a, string_split(phrase, ' ') as w from f where size > 1 and f >= 30),
cuts as (select lang, phrase, a, k, list_aggregate(w[1:k], 'string_agg', ' ') as x, list_aggregate(w[k + 1:], 'string_agg', ' ') as y from (select *, unnest(range(1, size)) as k from c)),
scored as (select cuts.lang, cuts.phrase, cuts.a, cuts.k, l.f as l, r.f as r, 2000000::hugeint * cuts.a // (l.f + r.f) as score
  from cuts join f l on l.lang = cuts.lang and l.phrase = x join f r on r.lang = cuts.lang and r.phrase = y),
weakest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
held as (select lang, list_aggregate(w[i:i + m - 1], 'string_agg', ' ') as phrase, max(a) as longer
  from (select lang, w, a, m, unnest(range(1, size - m + 2)) as i from c, (values (2), (3)) s(m) where m < size) group by all),
kept as (select weakest.* from weakest left join held using (lang, phrase) where longer is null or 100::hugeint * longer < 80::hugeint * a),
best as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from kept)
select lang, rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score from best join total using (lang) where rank <= 2000
"""


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents from a model that never saw the held-out fifth."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors after four rounds."""
    return vector_codes.code_table(_table(spark, sf_dir, "embeddings"))


def _op13_sql() -> str:
    parts, entries = vector_codes.PARTS, vector_codes.ENTRIES
    away = "list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [f"""
kept as (select vec_id, label, list_transform(embedding, lambda v: cast(floor({vector_codes.SCALE} * cast(v as double)) as bigint)) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0),
v as materialized (select vec_id, label, p, x[p * (len(x) // {parts}) + 1:(p + 1) * (len(x) // {parts})] as x from kept, range({parts}) s(p)),
b0 as materialized (select p, x, row_number() over (partition by p order by vec_id) - 1 as entry from v qualify entry < {entries})"""]
    for turn in range(5):
        steps.append(f"""
a{turn} as materialized (select vec_id, label, p, x, (least_of).d as d, (least_of).e as entry from
  (select v.vec_id, v.label, v.p, any_value(v.x) as x, min({{'d': {away}, 'e': b.entry}}) as least_of from v join b{turn} b using (p) group by v.vec_id, v.label, v.p))""")
        if turn < 4:
            steps.append(f"""
m{turn} as (select p, entry, list(m order by i) as x from (select p, entry, i, cast(sum(c) // count(*) - case when sum(c) % count(*) < 0 then 1 else 0 end as bigint) as m
  from (select p, entry, unnest(x) as c, generate_subscripts(x, 1) as i from a{turn}) group by p, entry, i) group by p, entry),
b{turn + 1} as materialized (select p, entry, coalesce(m.x, b.x) as x from b{turn} b left join m{turn} m using (p, entry))""")
    return f"""with {','.join(steps)},
h as (select sha256(string_agg(array_to_string(x, ','), ',' order by p, entry)) as codebooks_sha256 from b4),
e as (select vec_id, label, string_agg(printf('%02x', entry), '' order by p) as code, cast(sum(d) as bigint) as error from a4 group by vec_id, label)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from e cross join h"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_chat_format, op2_sharding, op3_substring_dedup, op4_decontaminate, op5_jaccard_join, op6_license_scan, op7_fingerprint, op8_secret_scan, op9_quality, op10_mixing, op11_collocations, op12_toxicity, op13_vector_codes)}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": OP1_SQL, "op2_sharding": _op2_sql(), "op3_substring_dedup": OP3_SQL, "op4_decontaminate": OP4_SQL, "op5_jaccard_join": OP5_SQL, "op6_license_scan": _op6_sql(), "op7_fingerprint": _op7_sql(), "op8_secret_scan": _op8_sql(), "op10_mixing": _op10_sql(), "op11_collocations": OP11_SQL, "op13_vector_codes": _op13_sql()}
