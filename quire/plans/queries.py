"""Queries over the driver's tables, each with the same question in SQL where SQL can ask it.

The tables hold no page images and no Chinese, so lines get boxes from their place and length, readings and
translations are made from the rows by arithmetic, and Latin letters with diacritics stand in for a script.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import romanize
from ..functions import text as T
from ..functions.pack import CHINESE, DIACRITIC
from ..operators import brief, catalogue, colours, context, export, geometry, integrity, layout, profile, prompts, reconcile, repeats, translate
from ..sources import exports, pdf, shared, tables
from ..sources.tables import table
from ..streaming import ledger

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# --- rows that stand for the engine's own tables ---------------------------------------------------------------------


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, page, line_no, text, confidence and a box for each line of ``documents``."""
    each = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    size, pos = F.char_length("text"), F.col("n") % 20
    return each.select(
        "doc_id", F.floor(F.col("n") / 20).cast("int").alias("page"), pos.cast("int").alias("line_no"), "text", F.lit(0.9).alias("confidence"),
        F.when((F.col("doc_id") % 3 == 0) & (pos % 2 == 1), 0.55).otherwise(0.06).alias("x"), F.round(0.02 + pos * 0.045, 6).alias("y"),
        F.round(0.05 + F.least(size, F.lit(60)) * 0.005, 6).alias("w"), F.round(0.03 + size % 3 * 0.005, 6).alias("h"),
    )


LINES = """lines as (select doc_id, (n // 20)::int as page, (n % 20)::int as line_no, text, case when doc_id % 3 = 0 and n % 20 % 2 = 1 then 0.55::double else 0.06::double end as x,
  round(0.02::double + (n % 20) * 0.045::double, 6) as y, round(0.05::double + least(length(text), 60) * 0.005::double, 6) as w, round(0.03::double + length(text) % 3 * 0.005::double, 6) as h
  from (select doc_id, unnest(parts) as text, generate_subscripts(parts, 1) - 1 as n from (select doc_id, string_split(text, chr(10)) as parts from documents)))"""


def _rounded(df: DataFrame) -> DataFrame:
    """Boxes and confidence to nine places."""
    return df.withColumns({c: F.round(c, 9) for c in ("x", "y", "w", "h", "confidence")})


def notices(spark: SparkSession, sf: str) -> DataFrame:
    """order_key, line_no, source, target: notices of order lines; the order's number says what the target gets wrong."""
    # joined by shuffle whatever the size: lines are costly to check, and a small file would check them all in one task
    item = table(spark, sf, "lineitem").join(table(spark, sf, "orders").hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    q, k = F.col("l_quantity").cast("int"), F.col("o_orderkey") % 7
    text = lambda *parts: F.concat_ws(" ", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    source = text("Order", F.col("o_orderkey"), "line", F.col("l_linenumber"), "holds", q, "pieces of part", F.col("l_partkey"))
    target = (
        F.when(k == 0, text("Auftrag", F.col("o_orderkey"), "Zeile", F.col("l_linenumber"), "mit Stück vom Teil", F.col("l_partkey")))
        .when(k == 1, text("Auftrag", F.col("o_orderkey"), "Zeile", F.col("l_linenumber"), "mit", q, "Stück vom Teil", F.col("l_partkey"), "Seite 99,5"))
        .when(k == 2, text("Auftrag", F.col("o_orderkey"), "Zeile", F.col("l_linenumber"), "mit", q, "Stück vom Teil", F.col("l_partkey") + 1))
        .when(k == 3, F.lit(" "))
        .when(k == 4, source)
        .when(k == 5, text("Auftrag", F.col("o_orderkey"), "ja ja ja ja ja"))
        .otherwise(text("Auftrag", F.col("o_orderkey"), "Zeile", F.col("l_linenumber"), "mit", q, "Stück vom Teil", F.col("l_partkey")))
    )
    return item.select(F.col("o_orderkey").alias("order_key"), F.col("l_linenumber").alias("line_no"), source.alias("source"), target.alias("target"))


NOTICES = """notices as (select order_key, line_no, source, case k when 0 then concat_ws(' ', 'Auftrag', order_key, 'Zeile', line_no, 'mit Stück vom Teil', part)
  when 1 then concat_ws(' ', 'Auftrag', order_key, 'Zeile', line_no, 'mit', q, 'Stück vom Teil', part, 'Seite 99,5') when 2 then concat_ws(' ', 'Auftrag', order_key, 'Zeile', line_no, 'mit', q, 'Stück vom Teil', part + 1)
  when 3 then ' ' when 4 then source when 5 then concat_ws(' ', 'Auftrag', order_key, 'ja ja ja ja ja') else concat_ws(' ', 'Auftrag', order_key, 'Zeile', line_no, 'mit', q, 'Stück vom Teil', part) end as target
  from (select o_orderkey as order_key, l_linenumber as line_no, l_quantity::int as q, l_partkey as part, o_orderkey % 7 as k, concat_ws(' ', 'Order', o_orderkey, 'line', l_linenumber, 'holds', l_quantity::int, 'pieces of part', l_partkey) as source
    from lineitem join orders on l_orderkey = o_orderkey))"""
_RUNS = "list_transform(regexp_extract_all({0}, '[0-9][0-9.,]*'), lambda x: rtrim(replace(x, ',', ''), '.'))"
_COUNT = "len(list_filter({0}, lambda y: y = {1}))"


def dialogues(spark: SparkSession, sf: str) -> DataFrame:
    """conv_id, turn, source, target: a turn and the one after it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("source"), F.lead("text").over(w).alias("target")).where("target is not null")


DIALOGUES = "dialogues as (select * from (select conv_id, turn, text as source, lead(text) over (partition by conv_id order by turn) as target from conversations) where target is not null)"


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, page, ord, kind, text, target: lines as blocks; the target is the text in capitals."""
    each = lines(spark, sf).where(~T.blank(F.col("text")))
    kind = F.when((F.col("line_no") == 0) & (F.char_length("text") <= 60), "heading").when(F.char_length("text") <= 12, "pageFurniture").when(F.col("line_no") % 5 == 4, "listItem").otherwise("paragraph")
    return each.select("doc_id", "page", F.col("line_no").alias("ord"), kind.alias("kind"), "text", F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("target"))


BLOCKS = LINES + """, blocks as (select doc_id, page, line_no as ord, case when line_no = 0 and length(text) <= 60 then 'heading' when length(text) <= 12 then 'pageFurniture' when line_no % 5 = 4 then 'listItem' else 'paragraph' end as kind,
  text, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') as target from lines where trim(text) <> '')"""


def entries(spark: SparkSession, sf: str) -> DataFrame:
    """Ledger entries from ``events``."""
    e, kind, n = table(spark, sf, "events"), F.col("event_type"), F.col("event_id")
    return e.select(
        (F.col("user_id") % 50).alias("scope"), F.col("ts").cast("timestamp").alias("at"), n.alias("seq"), F.when(kind == "purchase", "modelWeights").otherwise("documentWork").alias("purpose"),
        F.when(n % 11 == 0, "models.example.org").otherwise(F.concat(F.lit("127.0.0."), (n % 9 + 1).cast("string"))).alias("authority"), F.when((kind == "error") | ((n % 11 == 0) & (kind != "purchase")), "refused").otherwise("allowed").alias("outcome"),
        F.char_length("props").cast("long").alias("bytes_sent"), F.floor("value").cast("long").alias("bytes_received"),
    )


ENTRIES = """entries as (select user_id % 50 as scope, ts as "at", event_id as seq, case when event_type = 'purchase' then 'modelWeights' else 'documentWork' end as purpose,
  case when event_id % 11 = 0 then 'models.example.org' else '127.0.0.' || (event_id % 9 + 1) end as authority, case when event_type = 'error' or (event_id % 11 = 0 and event_type <> 'purchase') then 'refused' else 'allowed' end as outcome,
  length(props) as bytes_sent, floor(value)::bigint as bytes_received from events)"""


def _sentences_sql(name: str, source: str, keys: str) -> str:
    """CTEs over ``source`` (keys, text): name_ends (keys, e: where its sentences end) and name (keys, ord, start, sentence).

    A run of stops and closers ends a sentence where white space or nothing follows it, no figure comes next, and one of
    its stops holds: all but a point after a figure or an abbreviation.
    """
    k = ", ".join(f"t.{x}" for x in keys.split(", "))
    on = " and ".join(f"b.{x} = a.{x}" for x in keys.split(", "))
    return rf"""{name}_tok as (select {keys}, text, tok, sum(length(tok)) over (partition by {keys} order by i) as e from (select {keys}, text, unnest(parts) as tok, generate_subscripts(parts, 1) as i from (select {keys}, text, regexp_extract_all(text, '[.!?"'')\]]+|[^.!?"'')\]]+') as parts from {source}))),
{name}_runs as (select *, regexp_extract(substring(text, 1, (e - length(tok))::bigint), '[.\p{{L}}\p{{N}}]*$') as stem from {name}_tok where regexp_matches(tok, '^[.!?"'')\]]') and regexp_matches(tok, '[.!?]')),
{name}_ends as (select {keys}, text, e::int as e from {name}_runs where (e = length(text) or regexp_matches(substring(text, e::bigint + 1, 1), '\s')) and not regexp_matches(substring(text, e::bigint + 1), '^[\s"''(\[]*\p{{N}}')
  and (regexp_matches(tok, '[!?]') or regexp_matches(tok, '[^.]\.') or starts_with(tok, '.') and (stem = '' or not regexp_full_match(stem, '[.\p{{N}}]+') and (starts_with(tok, '..') or lower(stem) not in ('co', 'ltd', 'no', 'inc', 'vs', 'etc'))))),
{name}_begins as (select {keys}, text, 0 as b from {source} where regexp_matches(text, '\S') union select {keys}, text, e + length(regexp_extract(substring(text, e + 1), '^\s*')) from {name}_ends),
{name} as (select {k}, (row_number() over (partition by {k} order by t.b) - 1)::int as ord, t.b::int as start, substring(t.text, t.b + 1, coalesce(t.e, length(t.text)) - t.b) as sentence from (select a.*, (select min(e) from {name}_ends b where {on} and b.e > a.b) as e from {name}_begins a where a.b < length(a.text)) t)"""


# --- text ------------------------------------------------------------------------------------------------------------


@_query(f"with {LINES} select doc_id, page, line_no, array_to_string({_RUNS.format('text')}, '|') as runs from lines where regexp_matches(text, '[0-9]')")
def number_runs(spark, sf):
    return lines(spark, sf).where(F.col("text").rlike("[0-9]")).select("doc_id", "page", "line_no", F.array_join(T.number_runs(F.col("text")), "|").alias("runs"))


@_query(f"""with {NOTICES}, r as (select order_key, line_no, {_RUNS.format('source')} as a, {_RUNS.format('target')} as b from notices)
select order_key, line_no, array_to_string(list_sort(list_filter(list_distinct(a), lambda x: {_COUNT.format('a', 'x')} > {_COUNT.format('b', 'x')})), '|') as dropped,
  array_to_string(list_sort(list_filter(list_distinct(b), lambda x: {_COUNT.format('b', 'x')} > {_COUNT.format('a', 'x')})), '|') as invented from r""")
def number_multiset_diff(spark, sf):
    both = T.let(lambda a, b: F.struct(T.multiset_minus(a, b).alias("dropped"), T.multiset_minus(b, a).alias("invented")), a=T.number_runs(F.col("source")), b=T.number_runs(F.col("target")))
    found = notices(spark, sf).select("order_key", "line_no", F.explode(F.array(both)).alias("found"))
    return found.select("order_key", "line_no", F.array_join("found.dropped", "|").alias("dropped"), F.array_join("found.invented", "|").alias("invented"))


@_query(r"""select doc_id, case when n > 0 then round(len(regexp_extract_all(t, '[À-ÿ]')) / n::double, 6) else 0.0 end as share from (select doc_id, t, length(t) as n from (select doc_id, regexp_replace(text, '[\s\p{P}]', '', 'g') as t from documents))""")
def script_share(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(T.script_share(F.col("text"), DIACRITIC), 6).alias("share"))


@_query(rf"""with {DIALOGUES}, r as (select conv_id, turn, length(regexp_replace(source, '\s', '', 'g')) as s, length(regexp_replace(target, '\s', '', 'g')) as t from dialogues)
select conv_id, turn, case when s >= 8 then round(t / s::double, 6) end as ratio, s >= 8 and (t / s::double < 0.8 or t / s::double > 4.5) as outside from r""")
def length_ratio(spark, sf):
    s, t = T.letters(F.col("source")), T.letters(F.col("target"))
    ratio = F.when(s >= 8, t / s)
    return dialogues(spark, sf).select("conv_id", "turn", F.round(ratio, 6).alias("ratio"), F.coalesce((ratio < 0.8) | (ratio > 4.5), F.lit(False)).alias("outside"))


_SAID = "list_filter(range(1, len(w) - {3} + 2), lambda i: list_slice(w, i, i + {0}) = list_slice(w, i + {1}, i + {2}) and list_slice(w, i + {1}, i + {2}) = list_slice(w, i + {4}, i + {5}) and list_slice(w, i + {4}, i + {5}) = list_slice(w, i + {6}, i + {7}))"


def _said(k: int) -> str:
    at = _SAID.format(k - 1, k, 2 * k - 1, 4 * k, 2 * k, 3 * k - 1, 3 * k, 4 * k - 1)
    return f"case when len({at}) > 0 then array_to_string(list_slice(w, {at}[1], {at}[1] + {k - 1}), ' ') end"


@_query(rf"""with w as (select doc_id, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') as w from documents) select doc_id, coalesce({', '.join(map(_said, range(1, 5)))}) as phrase from w where len(w) >= 8""")
def repeated_run(spark, sf):
    d = table(spark, sf, "documents").where(F.col("text").rlike(rf"^{T.SPACE}*+(?:\S++{T.SPACE}++){{7}}\S"))
    return d.select("doc_id", T.repeated_run(F.col("text")).alias("phrase"))


@_query(rf"with {LINES} select doc_id, page, line_no, trim(regexp_replace(text, '\s+', ' ', 'g')) as normal from lines")
def normalize_spaces(spark, sf):
    return lines(spark, sf).select("doc_id", "page", "line_no", T.normalized(F.col("text"), DIACRITIC).alias("normal"))


@_query(rf"""with {DIALOGUES}, r as (select conv_id, turn, substr(regexp_replace(source, '[^ -~]', '?', 'g'), 1, 2000) as a, substr(regexp_replace(target, '[^ -~]', '?', 'g'), 1, 2000) as b from dialogues)
select conv_id, turn, round(case when greatest(length(a), length(b)) = 0 then 1.0 when a = '' or b = '' then 0.0 else 1 - levenshtein(a, b) / greatest(length(a), length(b))::double end, 6) as similarity from r""")
def similarity_ascii(spark, sf):
    plain = lambda c: F.regexp_replace(c, "[^ -~]", "?")
    return dialogues(spark, sf).select("conv_id", "turn", F.round(T.similarity(plain("source"), plain("target"), T.COMPARED), 6).alias("similarity"))


# --- integrity and confidence ----------------------------------------------------------------------------------------


def _scored(spark, sf) -> DataFrame:
    n = notices(spark, sf)
    kind, key = F.col("order_key") % 5, F.col("order_key")
    settlement = F.when(kind == 0, "unanimous").when(kind == 1, "textLayer").when(kind == 2, "single").when(kind == 3, "adjudicated").otherwise("defaulted")
    reader = F.when(key % 2 == 0, "visionLanguageModel").otherwise("visionOCR")
    agreement = F.when(kind >= 3, 0.75)
    other = F.when(key % 4 == 0, 0.4).when(key % 4 == 1, 0.9)
    both = lambda found: F.struct(found.alias("found"), F.round(integrity.confidence(settlement, reader, agreement, found, other, key % 3 != 0, key % 6 == 1), 6).alias("score"))
    # a one-element generator: later filters and sorts use the findings and the score instead of working them out again
    got = T.let(both, found=integrity.findings(F.col("source"), F.col("target"), DIACRITIC))
    return n.select("order_key", "line_no", F.explode(F.array(got)).alias("got")).select("order_key", "line_no", "got.found", "got.score")


_FOUND = rf"""{NOTICES}, t as (select order_key, line_no, source as s, trim(target) as t from notices),
r as (select *, {_RUNS.format('s')} as a, {_RUNS.format('t')} as b, string_split(regexp_replace(t, '\s+', ' ', 'g'), ' ') as w, length(regexp_replace(t, '\s', '', 'g')) / length(regexp_replace(s, '\s', '', 'g'))::double as ratio, regexp_replace(t, '[\s\p{{P}}]', '', 'g') as bare from t),
q as (select *, list_filter(a, lambda x: list_contains(['1','2','3','4','5','6','7','8','9','10','11','12'], x) and (case x when '1' then regexp_matches(lower(t), 'one|first') when '2' then regexp_matches(lower(t), 'two|second') when '3' then regexp_matches(lower(t), 'three|third')
   when '4' then regexp_matches(lower(t), 'four|fourth') when '5' then regexp_matches(lower(t), 'five|fifth') when '6' then regexp_matches(lower(t), 'six|sixth') when '7' then regexp_matches(lower(t), 'seven|seventh') when '8' then regexp_matches(lower(t), 'eight|eighth')
   when '9' then regexp_matches(lower(t), 'nine|ninth') when '10' then regexp_matches(lower(t), 'ten|tenth') when '11' then regexp_matches(lower(t), 'eleven|eleventh') else regexp_matches(lower(t), 'twelve|twelfth') end)) as ex from r),
f as (select order_key, line_no, case when t = '' then ['emptyTranslation:3'] else
  (case when s = t then ['echoedSource:3'] else [] end)
  || list_transform(list_sort(list_filter(list_distinct(a), lambda x: {_COUNT.format('a', 'x')} - {_COUNT.format('ex', 'x')} > {_COUNT.format('b', 'x')})), lambda x: 'droppedNumber:3')
  || list_transform(list_sort(list_filter(list_distinct(b), lambda x: {_COUNT.format('b', 'x')} > greatest(0, {_COUNT.format('a', 'x')} - {_COUNT.format('ex', 'x')}))), lambda x: 'inventedNumber:2')
  || (case when ratio < 0.8 then ['lengthOutOfRange:2'] when ratio > 4.5 then ['lengthOutOfRange:1'] else [] end)
  || (case when len(w) >= 8 and {_said(1)} is not null then ['repeatedRun:3'] else [] end) end as found from q),
base as (select order_key, line_no, found, case order_key % 5 when 2 then case when order_key % 2 = 0 then 0.45 else 0.2 end when 3 then 0.12 when 4 then 0.3 else 0.0 end::double as d1, case when order_key % 5 >= 3 then 0.1 else 0.0 end::double as d2,
  case order_key % 4 when 0 then 0.2 when 1 then 0.0 else 0.05 end::double as d3, case when order_key % 3 = 0 then 0.2 when order_key % 6 = 1 then 0.1 else 0.0 end::double as d4 from f),
scored as (select order_key, line_no, found, round(greatest(0.0::double, least(case when len(list_filter(found, lambda x: x like '%:3')) > 0 then 0.35::double else 1.0::double end,
  1.0::double - d1 - d2 - d3 - d4 - len(list_filter(found, lambda x: x like '%:3')) * 0.4::double - len(list_filter(found, lambda x: x like '%:2')) * 0.12::double - len(list_filter(found, lambda x: x like '%:1')) * 0.04::double)), 6) as score from base)"""


@_query(f"with {_FOUND} select order_key, line_no, array_to_string(found, ',') as findings from scored")
def integrity_findings(spark, sf):
    tags = F.transform("found", lambda f: F.concat(f.kind, F.lit(":"), f.severity.cast("string")))
    return _scored(spark, sf).select("order_key", "line_no", F.array_join(tags, ",").alias("findings"))


@_query(f"with {_FOUND} select order_key, line_no, score, case when score >= 0.85 then 'high' when score >= 0.6 then 'check' else 'low' end as band from scored")
def confidence(spark, sf):
    return _scored(spark, sf).select("order_key", "line_no", "score", integrity.band(F.col("score")).alias("band"))


@_query(f"with {_FOUND} select order_key, line_no, score, len(found) as n_findings from scored where score < 0.85 order by score, order_key, line_no")
def attention_queue(spark, sf):
    queue = _scored(spark, sf).where("score < 0.85").select("order_key", "line_no", "score", F.size("found").alias("n_findings"))
    # dealt first: a sort samples its input for its ranges, and would score every row twice; these four columns are small
    return queue.repartition("order_key", "line_no").orderBy("score", "order_key", "line_no")


@_query(f"""with {_FOUND} select order_key % 10 as page, count(*) as n_blocks, count(*) filter (score < 0.85) as n_attention, round(min(score), 6) as worst, sum(len(found)) as n_findings from scored group by 1""")
def provenance_counts(spark, sf):
    s = _scored(spark, sf).withColumn("page", F.col("order_key") % 10)
    return s.groupBy("page").agg(F.count("*").alias("n_blocks"), F.count_if(F.col("score") < 0.85).alias("n_attention"), F.round(F.min("score"), 6).alias("worst"), F.sum(F.size("found")).alias("n_findings"))


# --- layout ----------------------------------------------------------------------------------------------------------

_ITEM = r"'^([•·‧\-—*▪◦]|[0-9]+[.)、]|[（(]\s*[0-9一二三四五六七八九十]+\s*[)）]|[一二三四五六七八九十百]+[、.]|第[0-9一二三四五六七八九十百]+[条章节款项])'"


@_query(f"with {LINES} select doc_id, page, line_no, regexp_matches(trim(text), {_ITEM}) as is_item from lines")
def list_item(spark, sf):
    return lines(spark, sf).select("doc_id", "page", "line_no", T.list_item(T.trimmed(F.col("text"))).alias("is_item"))


_MEDIAN = "medians as (select doc_id, page, list_sort(list(h))[count(*) // 2 + 1] as median from lines where trim(text) <> '' group by doc_id, page)"


@_query(f"with {LINES}, {_MEDIAN} select doc_id, page, median from medians")
def upper_median(spark, sf):
    return lines(spark, sf).where(~T.blank(F.col("text"))).groupBy("doc_id", "page").agg(T.upper_median(F.collect_list("h")).alias("median"))


@_query(rf"""with {LINES}, {_MEDIAN} select l.doc_id, l.page, l.line_no, case when length(trim(text)) <= 24 and (y + h > 0.93 or y < 0.05) then 'pageFurniture' when regexp_matches(trim(text), {_ITEM}) then 'listItem'
  when not regexp_matches(trim(text), '[.!?]$') and h > median * 1.3::double and length(trim(text)) <= 60 then 'heading' else 'paragraph' end as kind from lines l join medians m on m.doc_id = l.doc_id and m.page = l.page where trim(text) <> ''""")
def classify_block(spark, sf):
    kept = lines(spark, sf).where(~T.blank(F.col("text")))
    median = F.sort_array(F.collect_list("h").over(Window.partitionBy("doc_id", "page")))
    m = T.upper_median(median)
    return kept.withColumn("m", m).select("doc_id", "page", "line_no", layout.classify(F.col("text"), F.lit(1), F.col("y"), F.col("h"), F.col("m"), DIACRITIC).alias("kind"))


_GUTTER = """bins as (select doc_id, page, x, w, least(99, greatest(0, floor(x * 100)))::int as b0, greatest(least(99, greatest(0, floor(x * 100)))::int, least(99, greatest(0, floor((x + w) * 100)))::int) as b1 from lines where trim(text) <> ''),
big as (select doc_id, page from bins group by doc_id, page having count(*) >= 6 and max(b1) - min(b0) > 20),
spans as (select distinct b.doc_id, b.page, b0, b1 from bins b join big using (doc_id, page)),
gaps as (select doc_id, page, covered + 1 as lo, b0 - 1 as hi from (select *, max(b1) over (partition by doc_id, page order by b0, b1 rows between unbounded preceding and 1 preceding) as covered from spans) where b0 - covered - 1 >= 4),
sides as (select g.doc_id, g.page, lo, hi, count(*) filter (x + w <= (lo + hi + 1) / 200.0::double) as l, count(*) filter (x >= (lo + hi + 1) / 200.0::double) as r from gaps g join bins b on b.doc_id = g.doc_id and b.page = g.page group by all),
gutters as (select doc_id, page, l, r, round((lo + hi + 1) / 200.0::double, 6) as gx from sides where l >= 3 and r >= 3 qualify row_number() over (partition by doc_id, page order by hi - lo desc, lo) = 1)"""


@_query(f'with {LINES}, {_GUTTER} select doc_id, page, l as "left", r as "right", gx as gutter_x from gutters')
def line_gutters(spark, sf):
    return layout.gutters(lines(spark, sf).where(~T.blank(F.col("text"))))


_ORDERED = f"""{_GUTTER}, sided as (select l.*, case when gx is null then 0 when l.x + l.w <= gx then 1 when l.x >= gx then 2 else 0 end as side, gx from lines l left join gutters g on g.doc_id = l.doc_id and g.page = l.page where trim(text) <> ''),
banded as (select *, sum(case when gx is not null and side = 0 then 1 else 0 end) over (partition by doc_id, page order by y, line_no) as band from sided),
ordered as (select *, row_number() over (partition by doc_id, page order by band, side, y, line_no) - 1 as ord from banded)"""


@_query(f"with {LINES}, {_ORDERED} select doc_id, page, line_no, ord::int as ord from ordered")
def reading_order(spark, sf):
    return layout.reading_order(lines(spark, sf).where(~T.blank(F.col("text")))).select("doc_id", "page", "line_no", "ord")


_GROUPED = f"""{_ORDERED}, lagged as (select *, lag(x) over w as px, lag(y) over w as py, lag(w) over w as pw, lag(h) over w as ph from ordered window w as (partition by doc_id, page order by ord)),
cut as (select *, case when px is not null and y - (py + ph) <= greatest(h, ph) * 1.25::double and y - (py + ph) >= greatest(h, ph) * -0.6::double and (least(x + w, px + pw) - greatest(x, px)) / least(w, pw) >= 0.4::double and ph / h between 0.7::double and 1.45::double then 0 else 1 end as starts from lagged),
numbered as (select *, sum(starts) over (partition by doc_id, page order by ord) - 1 as block from cut)"""


@_query(f"with {LINES}, {_GROUPED} select doc_id, page, block::bigint as block, count(*) as n_lines, min(ord)::int as first_ord from numbered group by doc_id, page, block")
def group_lines(spark, sf):
    g = layout.grouped(layout.reading_order(lines(spark, sf).where(~T.blank(F.col("text")))))
    return g.groupBy("doc_id", "page", "block").agg(F.count("*").alias("n_lines"), F.min("ord").alias("first_ord"))


_ASSEMBLED = f"""{_GROUPED}, {_MEDIAN}, raw as (select n.doc_id, n.page, block, count(*)::int as n_lines, string_agg(text, ' ' order by ord) as text, string_agg(text, '' order by ord) as bare, min(x) as x, min(y) as y, max(x + w) - min(x) as w, max(y + h) - min(y) as h, any_value(median) as median from numbered n join medians m on m.doc_id = n.doc_id and m.page = n.page group by n.doc_id, n.page, block)"""


@_query(rf"""with {LINES}, {_ASSEMBLED}, b as (select * replace (trim(regexp_replace(text, '\s+', ' ', 'g')) as text) from raw) select doc_id, page, block::bigint as block, n_lines, text, case when length(trim(text)) <= {layout.FURNITURE} and n_lines = 1 and (y + h > {layout.BOTTOM} or y < {layout.TOP}) then 'pageFurniture' when regexp_matches(trim(text), {_ITEM}) then 'listItem' when n_lines <= {layout.HEADING_LINES} and not regexp_matches(trim(text), '[.!?]$') and h / n_lines > median * {layout.HEADING}::double and length(trim(text)) <= {layout.HEADING_LENGTH} then 'heading' else 'paragraph' end as kind, round(x, 9) as x, round(y, 9) as y, round(w, 9) as w, round(h, 9) as h, 0.9::double as confidence from b""")
def assembled_blocks(spark, sf):
    return _rounded(layout.blocks(lines(spark, sf), DIACRITIC))


@_query(f"""with {_sentences_sql('s', 'conversations', 'conv_id, turn')} select conv_id, turn, ord, start, sentence as text from s""")
def sentences_exact(spark, sf):
    return layout.sentences(table(spark, sf, "conversations"), DIACRITIC, ["conv_id", "turn"])


# --- readings --------------------------------------------------------------------------------------------------------


def _readings(spark, sf) -> DataFrame:
    """Lines with a second reading that lost, changed or kept something by the line's number."""
    k = (F.col("doc_id") + F.col("line_no")) % 6
    other = F.when(k == 0, "").when(k == 1, F.regexp_replace("text", "[0-9]", "7")).when(k == 2, F.regexp_replace("text", "e", "c")).otherwise(F.col("text"))
    return lines(spark, sf).withColumns({"k": k, "left": F.when(k == 3, "").otherwise(F.col("text")), "right": other, "s": F.when(k == 1, 0.9).when(k == 2, 0.6).otherwise(1.0)})


@_query(rf"""with {LINES}, r as (select doc_id, page, line_no, (doc_id + line_no) % 6 as k, text from lines),
p as (select *, trim(regexp_replace(case when k = 3 then '' else text end, '\s+', ' ', 'g')) as a, trim(regexp_replace(case k when 0 then '' when 1 then regexp_replace(text, '[0-9]', '7', 'g') when 2 then replace(text, 'e', 'c') else text end, '\s+', ' ', 'g')) as b, case k when 1 then 0.9 when 2 then 0.6 else 1.0 end as s from r)
select doc_id, page, line_no, case when a = '' then 'single' when b = '' then 'single' when doc_id % 10 = 9 then 'textLayer' when s >= 0.999 or a = b then 'unanimous'
    when regexp_replace(a, '[0-9]', '', 'g') = regexp_replace(b, '[0-9]', '', 'g') or doc_id % 4 = 0 then 'defaulted' else 'adjudicated' end as kind,
  case when a = '' then nullif(b, '') when b = '' or doc_id % 10 = 9 or s >= 0.999 or a = b then a when regexp_replace(a, '[0-9]', '', 'g') = regexp_replace(b, '[0-9]', '', 'g') or doc_id % 4 = 0 then a when doc_id % 4 = 1 then b else a end as text from p""")
def settle_prealigned(spark, sf):
    answer = F.when(F.col("doc_id") % 4 == 1, "B").when(F.col("doc_id") % 4 > 1, "A")
    got = reconcile.settle(F.col("left"), F.col("right"), F.col("s"), F.col("doc_id") % 10 == 9, F.lit(True), answer, DIACRITIC)
    return _readings(spark, sf).withColumn("got", got).select("doc_id", "page", "line_no", F.col("got.kind").alias("kind"), F.col("got.text").alias("text"))


@_query()
def align_conversations(spark, sf):
    """A conversation's turns against the same turns cut at their line ends."""
    turns = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("ord"), "text")
    cut = turns.select("conv_id", F.col("ord"), F.posexplode(F.split("text", "\n"))).select("conv_id", (F.col("ord") * 100 + F.col("pos")).alias("ord"), F.col("col").alias("text"))
    return reconcile.align(turns, cut, ["conv_id"])


#: Letters of the tables beyond ASCII, and as many characters of one byte that stand in no text: SQL's distance counts bytes.
_LETTERS, _BYTES = "ÍéèñÊÄÉßêíçÇÑÈóÓöüÖäÜ", "".join(chr(c) for c in [*range(1, 9), *range(14, 27)])


@_query(f"""with recursive {LINES}, l as (select doc_id, page, line_no, text, translate(left(text, 2000), '{_LETTERS}', '{_BYTES}') as t, row_number() over (partition by doc_id, page order by line_no) as n from lines),
r as (select doc_id, page, 0::bigint as n, []::varchar[] as kept, null::int as line_no, null::varchar as text, false as keeps from (select distinct doc_id, page from lines)
  union all select doc_id, page, n, case when keeps then list_append(kept, t) else kept end, line_no, text, keeps from (
    select l.*, kept, len(list_filter(kept, lambda k: case when k = t then true when abs(length(k) - length(t)) > greatest(length(k), length(t)) / 10 then false else 1 - levenshtein(k, t) / greatest(length(k), length(t))::double > 0.9 end)) = 0 as keeps
    from r join l on l.doc_id = r.doc_id and l.page = r.page and l.n = r.n + 1))
select doc_id, page, line_no, text from r where keeps""")
def dedupe_greedy(spark, sf):
    """The lines that each page keeps: those over 0.9 similar to one kept before go."""
    return repeats.kept_first(lines(spark, sf).select("doc_id", "page", "line_no", "text"), ["doc_id", "page"], "line_no")


@_query(f"""with recursive l as (select conv_id, translate(left(text, 2000), '{_LETTERS}', '{_BYTES}') as t, row_number() over (partition by conv_id order by turn) as n from conversations),
r as (select conv_id, 0::bigint as n, []::varchar[] as kept from (select distinct conv_id from conversations)
  union all select l.conv_id, l.n, case when len(list_filter(kept, lambda k: case when k = t then true when abs(length(k) - length(t)) > greatest(length(k), length(t)) / 10 then false else 1 - levenshtein(k, t) / greatest(length(k), length(t))::double > 0.9 end)) = 0 then list_append(kept, t) else kept end
  from r join l on l.conv_id = r.conv_id and l.n = r.n + 1)
select conv_id, max(len(kept)) as kept, max(n) as n from r group by conv_id""")
def dedupe_turns(spark, sf):
    """How many turns of a conversation stay."""
    t = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    kept = repeats.kept_first(t, ["conv_id"], "turn").groupBy("conv_id").agg(F.count(F.lit(1)).alias("kept"))
    return t.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).join(kept, "conv_id").select("conv_id", "kept", "n")


@_query(f"""with recursive {LINES}, l as (select doc_id, text, translate(left(text, 2000), '{_LETTERS}', '{_BYTES}') as t, row_number() over (partition by doc_id order by page, line_no) as n from lines),
r as (select doc_id, 0::bigint as n, []::varchar[] as kept, null::varchar as text, false as keeps from (select distinct doc_id from lines)
  union all select doc_id, n, case when keeps then list_append(kept, t) else kept end, text, keeps from (
    select l.*, kept, len(list_filter(kept, lambda k: case when k = t then true when abs(length(k) - length(t)) > greatest(length(k), length(t)) / 10 then false else 1 - levenshtein(k, t) / greatest(length(k), length(t))::double > 0.9 end)) = 0 as keeps
    from r join l on l.doc_id = r.doc_id and l.n = r.n + 1))
select doc_id, n - 1 as place, text from r where keeps""")
def dedupe_documents(spark, sf):
    """The same over whole documents, whose lines repeat more often."""
    each = lines(spark, sf).select("doc_id", (F.col("page") * 20 + F.col("line_no")).cast("long").alias("place"), "text")
    return repeats.kept_first(each, ["doc_id"], "place")


# --- context, terms, profile -----------------------------------------------------------------------------------------

_AROUND = """around as (select *, last_value(case when kind <> 'pageFurniture' then text end ignore nulls) over d as previous_source, last_value(case when kind <> 'pageFurniture' then target end ignore nulls) over d as previous_target,
  first_value(case when kind <> 'pageFurniture' then text end ignore nulls) over p as next_source, last_value(case when kind = 'heading' then coalesce(target, text) end ignore nulls) over d as section_heading
  from blocks window d as (partition by doc_id order by page, ord rows between unbounded preceding and 1 preceding), p as (partition by doc_id, page order by ord rows between 1 following and unbounded following))"""


@_query(f"with {BLOCKS}, {_AROUND} select doc_id, page, ord, previous_source, previous_target, next_source, section_heading from around")
def block_context(spark, sf):
    return context.neighbours(blocks(spark, sf)).select("doc_id", "page", "ord", "previous_source", "previous_target", "next_source", "section_heading")


@_query(rf"""with {BLOCKS}, {_AROUND}, c as (select *, length(text) < 20 as short, regexp_matches(replace(text, 'thatch', ''), 'this|that') as refers, regexp_matches(replace(text, 'thatch', '#'), '^(and|but)') or not (coalesce(trim(previous_source) = '', true) or regexp_matches(trim(previous_source), '[.!?]["'')\]]?$')) as continues, kind <> 'pageFurniture' as able from around)
select doc_id, page, ord, able and previous_source is not null and (short or refers or continues) as needs_previous, able and next_source is not null and (kind = 'heading' or short) as needs_next, able and section_heading is not null and (kind = 'listItem' or short or refers) as needs_heading from c""")
def context_need(spark, sf):
    c = context.neighbours(blocks(spark, sf))
    need = context.need(*[F.col(x) for x in ("text", "kind", "previous_source", "previous_target", "next_source", "section_heading")], DIACRITIC)
    return c.withColumn("need", need).select("doc_id", "page", "ord", F.col("need.previous_source").alias("needs_previous"), F.col("need.following").alias("needs_next"), F.col("need.heading").alias("needs_heading"))


@_query(f"with {BLOCKS}, b as (select * from blocks where kind <> 'pageFurniture') select doc_id, arg_min(target, page * 1000 + case when kind = 'heading' then 0 else 100 end + ord) as context from b group by doc_id")
def document_context(spark, sf):
    return context.document_context(blocks(spark, sf))


_TERM = r"select distinct lower(regexp_extract(text, '^\S+ (\S+)', 1)) as term from benchmark"


@_query(rf"""with terms as (select term from ({_TERM}) where term <> '') select conv_id, turn, array_to_string(list_sort(list(term)), '|') as terms from conversations join terms on contains(text, term) group by conv_id, turn""")
def glossary_join(spark, sf):
    terms = table(spark, sf, "benchmark").select(F.lower(F.regexp_extract("text", r"^\S+ (\S+)", 1)).alias("term"))
    got = profile.applicable(table(spark, sf, "conversations").select("conv_id", "turn", "text"), ["conv_id", "turn"], terms)
    return got.where(F.size("terms") > 0).select("conv_id", "turn", F.array_join(F.transform("terms", lambda t: t["term"]), "|").alias("terms"))


@_query(rf"with t as ({_TERM}) select term from t where term not in (select lower(regexp_extract(text, '^\S+ (\S+)', 1)) from benchmark where item_id % 3 = 0)")
def terms_anti(spark, sf):
    b = table(spark, sf, "benchmark").withColumn("term", F.lower(F.regexp_extract("text", r"^\S+ (\S+)", 1)))
    return profile.unpinned(b.select("term").distinct(), b.where("item_id % 3 = 0"))


@_query("""with n as (select doc_id, len(string_split(text, chr(10))) as n from documents) select doc_id, n::int as n_pages, array_to_string(case when n - 1 <= 3 then range(1, n) else list_sort(list_distinct(list_transform(range(1, 4), lambda i: round((n - 2) * i / 3.0::double)::bigint + 1))) end, '|') as pages from n""")
def survey_pages(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.size(F.split("text", "\n")).alias("n_pages"))
    return d.select("doc_id", "n_pages", F.array_join(profile.survey_pages(F.col("n_pages"), 3), "|").alias("pages"))


@_query("select doc_id, case " + " ".join(f"when regexp_matches(lower(text), '{'|'.join(stems)}') then '{name}'" for name, stems in profile.FIELDS) + " else 'unknown' end as field from documents")
def field_stems(spark, sf):
    return table(spark, sf, "documents").select("doc_id", profile.field(F.col("text")).alias("field"))


def _survey_pages(spark, sf) -> DataFrame:
    """doc_id, page, n_pages, layer, read: lines' pages; every third document carries its text, the others are read."""
    p = profile.page_texts(blocks(spark, sf))
    n = blocks(spark, sf).groupBy("doc_id").agg((F.max("page") + 1).alias("n_pages"))
    own = F.col("doc_id") % 3 == 0
    return p.join(n, "doc_id").select("doc_id", "page", "n_pages", F.when(own, F.col("text")).alias("layer"), F.when(~own, F.col("text")).alias("read"))


@_query(rf"""with recursive {BLOCKS}, p as (select doc_id, page, string_agg(text, chr(10) order by ord) as text, doc_id % 3 = 0 as own from blocks where kind <> 'pageFurniture' group by doc_id, page), n as (select doc_id, max(page) + 1 as n_pages from blocks group by doc_id),
d as (select p.doc_id, any_value(n_pages) as n_pages, max(case when page = 0 then regexp_replace(left(text, 2000), '^\s+|\s+$', '', 'g') end) as opening, case when bool_or(own and page = n_pages - 1) then 12 else 2 end as most from p join n on n.doc_id = p.doc_id group by p.doc_id),
c as (select *, case when n_pages - 1 <= most then range(1, n_pages) else list_distinct(list_transform(range(1, most + 1), lambda i: (round((n_pages - 2) * i / most::double) + 1)::bigint)) end as picked, case when opening <> '' then '[page 1]' || chr(10) || opening else '' end as head from d),
s as (select c.doc_id, head, 4000 - length(head) as budget, greatest(200, (4000 - length(head)) // greatest(len(picked), 1)) as share, picked from c),
q as (select p.doc_id, p.page, p.text, p.own, row_number() over (partition by p.doc_id order by p.page) as k from p join s on s.doc_id = p.doc_id and list_contains(s.picked, p.page)),
r as (select doc_id, 0::bigint as k, head as sample, budget, 0 as reads, share from s
  union all select doc_id, k, sample || told, budget - length(told), reads + case when budget > 0 and not own and reads < 2 then 1 else 0 end, share from (
    select *, case when budget > 0 and said <> '' then chr(10) || chr(10) || '[page ' || (page + 1) || ']' || chr(10) || said else '' end as told from (
      select r.doc_id, q.k, r.sample, r.budget, r.reads, r.share, q.page, q.own, case when q.own or r.reads < 2 then regexp_replace(left(q.text, greatest(0, least(r.share, r.budget))), '^\s+|\s+$', '', 'g') else '' end as said from r join q on q.doc_id = r.doc_id and q.k = r.k + 1)))
select doc_id, arg_max(sample, k) as sample from r group by doc_id""")
def survey_sample(spark, sf):
    return profile.survey_sample(_survey_pages(spark, sf))


# --- translation -----------------------------------------------------------------------------------------------------

_BARE = re.compile("[À-ÿ]")


def _scripted_lead(text: str, context: str | None) -> str:
    """Fails, copies, copies when shown context, or translates, by the text's length."""
    k = len(text) % 5
    if k == 0:
        raise ValueError("engine down")
    return text if k == 1 or k == 2 and context else _BARE.sub("X", text).upper()


def _scripted_review(text: str, draft: str) -> str:
    return f"VERDICT: REVISE\nREVISION: {draft.strip()}!" if len(text) % 3 == 0 else "VERDICT: ACCURATE"


def _widened():
    """Whether any neighbour is shown."""
    return F.col("need.previous_source") | F.col("need.previous_target") | F.col("need.following") | F.col("need.heading")


def _translatable(spark, sf) -> DataFrame:
    """Blocks with what is around them, as a translator gets them."""
    b = context.neighbours(blocks(spark, sf))
    need = context.need(*[F.col(x) for x in ("text", "kind", "previous_source", "previous_target", "next_source", "section_heading")], DIACRITIC)
    b = b.withColumn("need", need)
    around = prompts.translation_context(F.lit(None).cast("string"), F.col("need"), F.col("previous_source"), F.lit(None).cast("string"), F.col("next_source"), F.col("section_heading"))
    return b.select("doc_id", "page", "ord", "kind", "text", around.alias("context"), F.col("need.reasons").alias("context_reasons"), _widened().alias("needed"), F.lit("single").alias("settlement"), F.lit("visionOCR").alias("reader"), F.lit(None).cast("string").alias("because"), F.lit(None).cast("double").alias("agreement"))


_AROUND = """around as (select *, last_value(case when kind <> 'pageFurniture' then text end ignore nulls) over d as previous_source, last_value(case when kind <> 'pageFurniture' then target end ignore nulls) over d as previous_target,
  first_value(case when kind <> 'pageFurniture' then text end ignore nulls) over p as next_source, last_value(case when kind = 'heading' then coalesce(target, text) end ignore nulls) over d as section_heading
  from blocks window d as (partition by doc_id order by page, ord rows between unbounded preceding and 1 preceding), p as (partition by doc_id, page order by ord rows between 1 following and unbounded following))"""
_NEEDED = r"""c as (select *, length(text) < 20 as short, regexp_matches(replace(text, 'thatch', ''), 'this|that') as refers, regexp_matches(replace(text, 'thatch', '#'), '^(and|but)') or not (coalesce(not regexp_matches(previous_source, '\S'), true) or regexp_matches(trim(previous_source), '[.!?]["'')\]]?$')) as continues, kind <> 'pageFurniture' as able from around),
need as (select *, able and previous_target is not null as r0, able and previous_source is not null and short as r1, able and previous_source is not null and refers as r2, able and previous_source is not null and continues as r3, able and next_source is not null and kind = 'heading' as r4,
  able and next_source is not null and kind <> 'heading' and short as r5, able and section_heading is not null and (kind = 'listItem' or short or refers) as r6 from c)"""


def _reason_sql() -> str:
    return "list_filter([" + ", ".join(f"case when r{i} then '{why.replace(chr(39), chr(39) * 2)}' end" for i, why in enumerate(context.GIVEN)) + "], lambda x: x is not null)"


@_query(f"""with {BLOCKS}, {_AROUND}, {_NEEDED} select doc_id, page, ord, array_to_string({_reason_sql()}, '; ') as reasons from need""")
def context_reasons(spark, sf):
    return _translatable(spark, sf).select("doc_id", "page", "ord", F.array_join("context_reasons", "; ").alias("reasons"))


_TRANSLATED = rf"""{BLOCKS}, {_AROUND}, {_NEEDED},
given as (select *, length(text) as n, (r1 or r2 or r3 or r4 or r5 or r6) as shown, kind = 'pageFurniture' or not regexp_matches(text, '[À-ÿ]') as copied, upper(regexp_replace(text, '[À-ÿ]', 'X', 'g')) as plain, {_reason_sql()} as why from need),
alike as (select *, regexp_replace(trim(text), '[^ -~]', '?', 'g') as ta, regexp_replace(case when n % 3 = 0 then trim(plain) || '!' else trim(plain) end, '[^ -~]', '?', 'g') as tb from given),
tried as (select *, not copied and n % 5 = 0 as failed, 1 - levenshtein(ta, tb) / greatest(1, greatest(length(ta), length(tb)))::double <= 0.9 as differs from alike),
drafted as (select *, case when copied then text when failed then '' when n % 5 = 1 then text when n % 5 = 2 and shown and not differs then text else plain end as draft, not copied and not failed and n % 5 = 2 and shown and differs as alone from tried),
revised as (select *, case when not copied and not failed and n % 3 = 0 then trim(draft) || '!' end as revision from drafted),
measured as (select *, coalesce(revision, draft) as final, regexp_replace(trim(text), '[^ -~]', '?', 'g') as a, regexp_replace(trim(coalesce(revision, draft)), '[^ -~]', '?', 'g') as b, regexp_replace(trim(coalesce(revision, draft)), '[\s\p{{P}}]', '', 'g') as bare from revised),
shares as (select *, len(regexp_extract_all(bare, '[À-ÿ]')) / greatest(1, length(bare))::double as share, 1 - levenshtein(a, b) / greatest(1, greatest(length(a), length(b)))::double as like_, string_split(regexp_replace(trim(final), '\s+', ' ', 'g'), ' ') as w from measured),
found as (select *, case when copied then [] when failed then ['emptyTranslation:3'] else (case when like_ > 0.9 then ['echoedSource:3'] else [] end) || (case when share > 0.4 then ['untranslatedScript:3'] when share > 0.15 then ['untranslatedScript:2'] else [] end)
  || (case when len(w) >= 8 and coalesce({', '.join(map(_said, range(1, 5)))}) is not null then ['repeatedRun:3'] else [] end) end as found from shares),
scored as (select *, case when copied then 1.0::double when failed then 0.0::double else round(greatest(0.0::double, least(case when len(list_filter(found, lambda x: x like '%:3')) > 0 then 0.35::double else 1.0::double end,
  1.0::double - 0.2::double - 0.05::double - case when revision is not null then 0.1::double else 0.0::double end - len(list_filter(found, lambda x: x like '%:3')) * 0.4::double - len(list_filter(found, lambda x: x like '%:2')) * 0.12::double)), 6) end as score from found)"""


@_query(f"""with {_TRANSLATED} select doc_id, page, ord, copied, draft as first_draft, revision, final as shown, coalesce(revision <> draft, false) as was_revised, array_to_string(found, ',') as findings, score, case when score >= 0.85 then 'high' when score >= 0.6 then 'check' else 'low' end as band,
  alone as retried_alone, case when failed then 'engine down' end as error, case when copied then '' when alone then '{context.ALONE}' else array_to_string(why, '; ') end as given from scored""")
def translated_blocks(spark, sf):
    t = translate.translated(_translatable(spark, sf), _scripted_lead, None, _scripted_review, DIACRITIC)
    tags = F.transform("findings", lambda f: F.concat(f.kind, F.lit(":"), f.severity.cast("string")))
    return t.select("doc_id", "page", "ord", "copied", "first_draft", "revision", "shown", "was_revised", F.array_join(tags, ",").alias("findings"), F.round("score", 6).alias("score"), "band", "retried_alone", "error", F.array_join("context_reasons", "; ").alias("given"))


def _chained_lead(text: str, context: str | None) -> str:
    """Fails, copies when shown the line before, or counts on from the number that the last answer ended with."""
    said = (context or "").partition("Translated as:\n")[2].partition("\n")[0]
    if len(text) % 7 == 0:
        raise ValueError("engine down")
    if len(text) % 5 == 2 and "The line before:\n" in (context or ""):
        return text
    last = re.search("[0-9]{1,3}$", said)
    return f"line of {text.count(' ') + 1} words {(7 * int(last[0] if last else 0) + len(text)) % 1000}"


def _like(a: str, b: str) -> str:
    """Whether two texts are over 0.9 similar."""
    fold = lambda x: f"regexp_replace(left(trim({x}), 2000), '[^ -~]', '?', 'g')"
    return f"case when abs(length(left(trim({a}), 2000)) - length(left({b}, 2000))) > greatest(length(left(trim({a}), 2000)), length({b})) / 10 then false else 1 - levenshtein({fold(a)}, {fold(b)}) / greatest(length(left(trim({a}), 2000)), length({b}))::double > 0.9 end"


_IN_ORDER = rf"""with recursive {BLOCKS},
b as (select *, row_number() over d as n, first_value(case when kind <> 'pageFurniture' then text end ignore nulls) over p as next_source, length(text) as len, length(text) < 20 as short, regexp_matches(replace(text, 'thatch', ''), 'this|that') as refers,
    regexp_matches(replace(text, 'thatch', '#'), '^(and|but)') as begins, not regexp_matches(text, '\S') or regexp_matches(trim(text), '[.!?]["'')\]]?$') as stops, kind = 'pageFurniture' or not regexp_matches(text, '[À-ÿ]') as copied,
    first_value(case when kind <> 'pageFurniture' then text end ignore nulls) over (partition by doc_id order by case when kind = 'pageFurniture' then 1 else 0 end, page, case when kind = 'heading' then 0 else 1 end, ord) as title,
    case when contains(text, 'ein') then 'For this text:' || chr(10) || '- “ein” is “a”.' || chr(10) || chr(10) else '' end as terms, len(string_split(text, ' ')) as words
  from blocks window d as (partition by doc_id order by page, ord), p as (partition by doc_id, page order by ord rows between 1 following and unbounded following)),
r as (select doc_id, 0::bigint as n, null::varchar as src, null::varchar as tgt, null::varchar as head, true as stopped, null::int as page, null::int as ord, false as copied, null::varchar as given, null::varchar as context, null::varchar as draft, false as failed, false as retried from (select distinct doc_id from blocks)
  union all select doc_id, n, case when kind <> 'pageFurniture' then text else src end, case when kind <> 'pageFurniture' then shown else tgt end, case when kind = 'heading' then coalesce(nullif(shown, ''), text) else head end, case when kind <> 'pageFurniture' then stops else stopped end,
    page, ord, copied, why, context, shown, failed, retried from (
    select *, case when copied then text when failed then '' when retried then alone else first end as shown from (
      select *, not copied and not failed and (p0 or r0 or p2 or r6) and (first = text or {_like('text', 'first')}) and not ({_like('text', 'alone')}) as retried from (
        select *, case when len % 5 = 2 and p0 then text else 'line of ' || words || ' words ' || (7 * coalesce(nullif(regexp_extract(right(tgt, 200), '[0-9]{{1,3}}$'), '')::int, 0) + len) % 1000 end as first, 'line of ' || words || ' words ' || len % 1000 as alone, not copied and len % 7 = 0 as failed, array_to_string({{why}}, '; ') as why,
          case when not copied then nullif(case when title <> '' then 'From a document titled: ' || left(title, 120) || chr(10) || chr(10) else '' end || case when near <> '' then near || chr(10) || 'None of this is to be translated.' || chr(10) || chr(10) else '' end || terms, '') end as context from (
          select *, case when r6 and head <> '' then 'Under the heading:' || chr(10) || left(head, 120) || chr(10) || chr(10) else '' end || case when p0 and src <> '' then 'The line before:' || chr(10) || right(src, 200) || chr(10) else '' end
            || case when r0 and tgt <> '' then 'Translated as:' || chr(10) || right(tgt, 200) || chr(10) else '' end || case when p2 then 'The line after:' || chr(10) || left(next_source, 200) || chr(10) else '' end as near from (
            select *, r1 or r2 or r3 as p0, r4 or r5 as p2 from (
              select b.*, src, tgt, head, stopped, kind <> 'pageFurniture' and tgt is not null as r0, kind <> 'pageFurniture' and src is not null and short as r1, kind <> 'pageFurniture' and src is not null and refers as r2, kind <> 'pageFurniture' and src is not null and (begins or not stopped) as r3,
                kind <> 'pageFurniture' and next_source is not null and kind = 'heading' as r4, kind <> 'pageFurniture' and next_source is not null and kind <> 'heading' and short as r5, kind <> 'pageFurniture' and head is not null and (kind = 'listItem' or short or refers) as r6
              from r join b on b.doc_id = r.doc_id and b.n = r.n + 1)))))))
select doc_id, page, ord, copied, draft as shown, context, case when copied then '' when retried then '{context.ALONE}' else given end as given, retried as retried_alone, case when failed then 'engine down' end as error from r where n > 0"""


@_query(_IN_ORDER.replace("{why}", _reason_sql()))
def translated_in_order(spark, sf):
    """Whole documents, each block shown what the one before it became, by an engine that counts on from its last answer."""
    none = F.lit(None).cast("string")
    b = blocks(spark, sf).select("doc_id", "page", "ord", "kind", "text", F.lit("single").alias("settlement"), F.lit("visionOCR").alias("reader"), none.alias("because"), F.lit(None).cast("double").alias("agreement"))
    term = F.array(F.struct(F.lit("ein").alias("term"), F.lit("a").alias("rendering")))
    agreed = prompts.agreed_terms(F.filter(term, lambda t: F.contains(F.col("text"), t["term"])), F.lit(None).cast("array<struct<source:string,rendering:string,basis:string>>"), F.lit(None).cast("array<struct<term:string,required:string,keep:boolean>>"))
    t = translate.translated_in_order(b, _chained_lead, None, None, DIACRITIC, agreed=agreed)
    return t.select("doc_id", "page", "ord", "copied", "shown", "context", F.array_join("context_reasons", "; ").alias("given"), "retried_alone", "error")


def _batch_lead(asked: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Answers from the last to the first, leaves some out, and fails over a text of certain lengths, with its whole batch."""
    out = []
    for n, prompt in reversed(asked):
        text = prompt.rpartition("Translate this text:\n")[2].rpartition("Translate this heading:\n")[2]
        if len(text) % 13 == 0:
            raise ValueError("engine down")
        if len(text) % 11:
            out.append((n, ("“ein” agreed " if prompt.startswith("For this text:") else "") + _BARE.sub("X", text).upper()))
    return out


def _batch_second(asked: list[tuple[int, str]]) -> list[tuple[int, str]]:
    return [(n, "zzz" if len(t) % 3 == 0 else _BARE.sub("X", t).upper()) for n, t in asked if len(t) % 17]


_BATCHED = rf"""{BLOCKS}, given as (select *, length(text) as n, kind = 'pageFurniture' or not regexp_matches(text, '[À-ÿ]') as copied, upper(regexp_replace(text, '[À-ÿ]', 'X', 'g')) as plain from blocks),
drafted as (select *, not copied and n % 13 = 0 as failed, case when copied then text when n % 13 = 0 or n % 11 = 0 then '' else case when contains(text, 'ein') then '“ein” agreed ' else '' end || plain end as draft, case when copied or n % 13 = 0 or n % 17 = 0 then null when n % 3 = 0 then 'zzz' else plain end as other from given),
measured as (select *, regexp_replace(left(trim(text), 2000), '[^ -~]', '?', 'g') as a, regexp_replace(left(trim(draft), 2000), '[^ -~]', '?', 'g') as b, string_split(regexp_replace(trim(draft), '\s+', ' ', 'g'), ' ') as w,
  case when other is null then null when draft = '' or length(draft) > 40 then draft = '' or other = 'zzz' else 1 - levenshtein(regexp_replace(draft, '[^ -~]', '?', 'g'), other) / greatest(length(draft), length(other))::double < 0.45 end as unlike from drafted),
found as (select *, case when copied then [] when failed or draft = '' then ['emptyTranslation:3'] else (case when abs(length(a) - length(b)) > greatest(length(a), length(b)) / 10 then [] when 1 - levenshtein(a, b) / greatest(1, greatest(length(a), length(b)))::double > 0.9 then ['echoedSource:3'] else [] end)
  || (case when len(w) >= 8 and coalesce({', '.join(map(_said, range(1, 5)))}) is not null then ['repeatedRun:3'] else [] end) end as found from measured),
scored as (select *, case when copied then 1.0::double when failed then 0.0::double else round(greatest(0.0::double, least(case when len(found) > 0 then 0.35::double else 1.0::double end, 1.0::double - 0.2::double - case when unlike is null then 0.05::double when unlike then 0.2::double else 0.0::double end - 0.2::double - len(found) * 0.4::double)), 6) end as score from found)"""


@_query(f"""with {_BATCHED} select doc_id, page, ord, copied, draft as shown, array_to_string(found, ',') as findings, score, case when failed then 'engine down' end as error, case when copied then case when kind = 'pageFurniture' then 'Page furniture, kept as printed' else 'No source language in it, kept as printed' end
  when failed then 'engine down' else concat_ws('; ', 'Only Recognizer read this', case when unlike is null then 'One translator only' when unlike then 'Two translators differ widely' end, 'Not reviewed', case when draft = '' then 'A block that has text came back empty.' when contains(array_to_string(found, ','), 'echoed') then 'The English repeats the source language text.' end, case when contains(array_to_string(found, ','), 'repeated') then 'One phrase is said again and again.' end) end as reasons from scored""")
def translated_batches(spark, sf):
    """Blocks translated by engines that take whole batches, with agreed terms, a second opinion and reasons."""
    none = F.lit(None).cast("string")
    b = blocks(spark, sf).select("doc_id", "page", "ord", "kind", "text", F.lit("single").alias("settlement"), F.lit("visionOCR").alias("reader"), none.alias("because"), F.lit(None).cast("double").alias("agreement"))
    agreed = F.when(F.contains("text", F.lit("ein")), F.array(F.lit("“ein” is “a”."))).otherwise(F.array().cast("array<string>"))
    t = translate.translated_in_batches(b, _batch_lead, _batch_second, DIACRITIC, agreed)
    tags = F.transform("findings", lambda f: F.concat(f.kind, F.lit(":"), f.severity.cast("string")))
    return t.select("doc_id", "page", "ord", "copied", "shown", F.array_join(tags, ",").alias("findings"), F.round("score", 6).alias("score"), "error", F.array_join("reasons", "; ").alias("reasons"))


# --- exports, search, ledger, catalogue, geometry --------------------------------------------------------------------


@_query(f"with {BLOCKS}, k as (select doc_id, page, ord, kind, trim(text) as t from blocks where kind <> 'pageFurniture') select doc_id, string_agg(case when kind = 'listItem' and not starts_with(t, '•') then '• ' || t else t end, chr(10) || chr(10) order by page, ord) || chr(10) as body from k group by doc_id")
def plain_text_export(spark, sf):
    return export.plain_text(blocks(spark, sf))


@_query(f"""with {BLOCKS}, k as (select doc_id, page, ord, kind, trim(text) as t from blocks where kind <> 'pageFurniture'), b as (select doc_id, string_agg(case when kind = 'listItem' and not starts_with(t, '•') then '• ' || t else t end, chr(10) || chr(10) order by page, ord) || chr(10) as body from k group by doc_id)
select doc_id::varchar as doc_id, 'doc ' || doc_id || '-en.txt' as name, strlen(body) as bytes, md5(body) as md5 from b""")
def exported_files(spark, sf):
    """Plain-text exports written as files, a named one for each document, and read back with how each came out."""
    path = f"{shared.shared_dir(spark)}/quire/exports-{uuid.uuid4().hex}"
    bodies = export.plain_text(blocks(spark, sf)).select("doc_id", export.file_name(F.concat(F.lit("doc "), F.col("doc_id").cast("string"), F.lit(".pdf")), "plainText").alias("name"), "body")
    exports.write(bodies, path)
    return exports.read(spark, path).join(exports.outcomes(spark, path).where("error is null"), ["doc_id", "name"]).select("doc_id", "name", "bytes", F.md5("body").alias("md5"))


def _styled_blocks(spark, sf) -> DataFrame:
    """Blocks with all that an export shows of them, by arithmetic of their place."""
    o, none = F.col("ord"), F.array().cast("array<string>")
    message = F.struct(F.lit("droppedNumber").alias("kind"), F.lit(3).alias("severity"), F.lit("A figure is <missing>.").alias("message"), F.lit(None).cast("string").alias("evidence"))
    return blocks(spark, sf).select(
        "doc_id", "page", "ord", "kind", F.col("target").alias("text"), F.col("text").alias("source"), F.when(o % 3 == 0, "high").when(o % 3 == 1, "check").otherwise("low").alias("band"),
        F.when(o % 2 == 0, F.array(F.lit("Both readers agree"))).otherwise(F.array(F.lit("Not reviewed"), F.lit('The "figures" differ'))).alias("reasons"),
        F.array(F.struct(F.lit("visionOCR").alias("reader"), F.col("text").alias("text")), F.struct(F.lit("visionLanguageModel").alias("reader"), F.replace(F.left("text", F.lit(5)), F.lit(" "), F.lit("_")).alias("text"))).alias("candidates"),
        export.settled(F.when(o % 4 == 0, "unanimous").otherwise("defaulted"), F.lit("visionOCR"), F.lit("no model could choose")).alias("settled"), F.lower(F.left("text", F.lit(9))).alias("first_draft"), (o % 4 == 1).alias("was_revised"),
        F.when(o % 5 == 2, F.array(message)).otherwise(F.array().cast("array<struct<kind:string,severity:int,message:string,evidence:string>>")).alias("findings"), F.when(o % 7 == 3, F.array(F.lit("the line after it"))).otherwise(none).alias("context_reasons"), (o % 11 == 5).alias("retried_alone"),
    )


def _styled_documents(spark, sf) -> DataFrame:
    b = _styled_blocks(spark, sf)
    d = b.groupBy("doc_id").agg((F.max("page") + 1).cast("int").alias("n_pages")).join(export.summaries(b), "doc_id")
    readers, names = F.array(F.lit("Recognizer"), F.lit("Vision model")), F.array(F.struct(F.lit("Stück").alias("source"), F.lit("piece").alias("rendering")))
    told = export.provenance(F.lit("German to English"), readers, F.lit(""), names, F.lit("scripted"), F.lit(None).cast("string"), F.col("attention"), F.col("total"), F.lit("2026-01-02 03:04:05").cast("timestamp"))
    return d.select("doc_id", F.concat(F.lit("doc & "), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("name"), "n_pages", told.alias("provenance"), F.lit("de").alias("source_lang"), F.lit("en").alias("target_lang"))


def _escaped(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


def _export_sql(style: str, form: str) -> str:
    """The export by its rules: what stands before and after each part, in each form and style."""
    label = "case when ord % 3 = 1 then 'Worth a look' else 'Needs a human' end"
    reasons = "case when ord % 2 = 0 then 'Both readers agree' else 'Not reviewed; The \"figures\" differ' end"
    guess = "replace(left(text, 5), ' ', '_')"
    settled = "case when ord % 4 = 0 then 'Both readers agreed' else 'Kept Recognizer: no model could choose' end"
    nl = "chr(10)"
    if form == "markdown":
        line = f"case kind when 'heading' then '### ' || t when 'listItem' then '- ' || t when 'pageFurniture' then '*' || t || '*' else t end || {nl} || {nl}"
        if style != "englishOnly":
            line = f"'> ' || text || {nl} || {nl} || " + line
        line += f" || case when ord % 3 <> 0 then '*⚠︎ ' || {label} || ' — ' || {reasons} || '*' || {nl} || {nl} else '' end"
        if style == "audit":
            line += f""" || '<details><summary>How this block was read</summary>' || {nl} || {nl} || '- **Vision model:** ' || {guess} || {nl} || '- **Recognizer:** ' || text || {nl} || '- **Settled:** ' || {settled} || {nl}
              || case when ord % 4 = 1 then '- **First draft:** ' || lower(left(text, 9)) || {nl} else '' end || case when ord % 5 = 2 then '- **Check:** A figure is <missing>.' || {nl} else '' end || {nl} || '</details>' || {nl} || {nl}"""
        head, joint = f"'## Page ' || (page + 1) || {nl} || {nl}", f"'# ' || name || {nl} || {nl} || list_reduce(list_prepend('', list_transform(told, lambda x: '> ' || x || {nl})), lambda a, b: a || b) || {nl} || lines"
    else:
        t = _escaped("t")
        line = f"'<section class=\"block ' || case ord % 3 when 0 then 'agreed' when 1 then 'look' else 'human' end || '\">' || {nl}"
        if style != "englishOnly":
            line += f" || '<div class=\"source\" lang=\"de\">' || {_escaped('text')} || '</div>' || {nl}"
        line += f""" || '<div class="target">' || case kind when 'heading' then '<h3>' || {t} || '</h3>' when 'listItem' then '<ul><li>' || {t} || '</li></ul>' when 'pageFurniture' then '<p class="furniture">' || {t} || '</p>' else '<p>' || {t} || '</p>' end || '</div>' || {nl}
          || case when ord % 3 <> 0 then '<p class="note">' || {label} || ' — ' || {_escaped(reasons)} || '</p>' || {nl} else '' end"""
        if style == "audit":
            line += f""" || '<details class="working"><summary>How this block was read</summary><dl>' || '<dt>Vision model</dt><dd>' || {_escaped(guess)} || '</dd><dt>Recognizer</dt><dd>' || {_escaped('text')} || '</dd><dt>Settled</dt><dd>' || {settled} || '</dd>'
              || case when ord % 11 = 5 then '<dt>Translated twice</dt><dd>' || case when ord % 7 = 3 then 'the line after it' else '' end || '</dd>' when ord % 7 = 3 then '<dt>Also given</dt><dd>the line after it</dd>' else '' end
              || case when ord % 4 = 1 then '<dt>First draft</dt><dd>' || {_escaped('lower(left(text, 9))')} || '</dd>' else '' end || case when ord % 5 = 2 then '<dt>Check</dt><dd>A figure is &lt;missing&gt;.</dd>' else '' end || '</dl></details>' || {nl}"""
        line += f" || '</section>' || {nl}"
        head = f"'<h2 class=\"page\">Page ' || (page + 1) || '</h2>' || {nl}"
        joint = f"""'<!DOCTYPE html>' || {nl} || '<html lang="en">' || {nl} || '<head>' || {nl} || '<meta charset="utf-8">' || {nl} || '<title>' || {_escaped('name')} || '</title>' || {nl} || '<style>{export.SHEET}</style>' || {nl} || '</head>' || {nl} || '<body class="{style}">' || {nl}
          || '<header>' || {nl} || '<h1>' || {_escaped('name')} || '</h1>' || {nl} || '<p class="provenance">' || array_to_string(told, '<br>' || {nl}) || {nl} || '</p>' || {nl} || '</header>' || {nl} || lines || {nl} || '</body>' || {nl} || '</html>'"""
    return f"""with {BLOCKS}, t as (select *, trim(target) as t, max(page) over (partition by doc_id) + 1 as n_pages from blocks), per_page as (select doc_id, page, n_pages, string_agg({line}, '' order by ord) as lines from t group by doc_id, page, n_pages),
      every as (select doc_id, n_pages, unnest(range(0, n_pages)) as page from (select distinct doc_id, n_pages from t)),
      told as (select e.doc_id, e.page, case when e.n_pages > 1 then {head.replace('(page', '(e.page')} else '' end || coalesce(p.lines, '') as line from every e left join per_page p on p.doc_id = e.doc_id and p.page = e.page),
      body as (select doc_id, string_agg(line, '' order by page) as lines from told group by doc_id),
      heads as (select doc_id, 'doc & ' || doc_id || '.pdf' as name, count(*) filter (ord % 3 <> 0) as attention, count(*) filter (kind <> 'pageFurniture') as total from blocks group by doc_id),
      docs as (select h.doc_id, name, lines, ['German to English, translated on this machine.', 'Nothing of this document was uploaded.', 'Read by: Recognizer, Vision model', 'Names looked up: Stück → piece', 'Translated by: scripted',
        case when attention = 0 then 'All ' || total || ' blocks passed every check.' else attention || ' of ' || total || ' blocks need a look by someone; they are marked below.' end, '2026-01-02 03:04'] as told from heads h join body b on b.doc_id = h.doc_id)
      select doc_id, {joint} as body from docs"""


def _styled_query(style: str, form: str, name: str) -> None:
    def run(spark, sf):
        return export.styled(_styled_blocks(spark, sf), _styled_documents(spark, sf), style, form)

    run.__name__ = name
    _query(_export_sql(style, form))(run)


for _style, _name in zip(export.STYLES, ("export", "bilingual", "audit"), strict=True):
    for _form in export.FORMATS:
        _styled_query(_style, _form, f"{_form}_{_name}")


@_query("select s_suppkey as id, regexp_replace(s_name, '#', '.') as name, case when s_suppkey % 7 = 0 then 'translation-en.txt' else split_part(s_name, '#', 1) || '-en.txt' end as text_name, case when s_suppkey % 7 = 0 then 'translation-en.md' else split_part(s_name, '#', 1) || '-en.md' end as markdown_name from supplier")
def export_names(spark, sf):
    s = table(spark, sf, "supplier")
    name, own = F.regexp_replace("s_name", "#", "."), F.when(F.col("s_suppkey") % 7 != 0, F.regexp_replace("s_name", "#", "."))
    return s.select(F.col("s_suppkey").alias("id"), name.alias("name"), export.file_name(own, "plainText").alias("text_name"), export.file_name(own, "markdown").alias("markdown_name"))


@_query(f"with {BLOCKS} select doc_id, page, ord from blocks where contains(lower(text), 'licensed under') or contains(lower(target), 'licensed under')")
def search_blocks(spark, sf):
    return export.search(blocks(spark, sf), "Licensed under").select("doc_id", "page", "ord")


@_query(f"with {BLOCKS} select doc_id, page, count(*) as n_blocks, count(*) filter (kind <> 'pageFurniture') as n_translatable, arg_min(text, ord) as first_text from blocks group by doc_id, page")
def group_pages(spark, sf):
    return export.pages(blocks(spark, sf))


@_query(f"""with {ENTRIES} select scope, count(*) as requests, sum(bytes_sent)::bigint as bytes_sent, sum(bytes_received)::bigint as bytes_received, count(*) filter (outcome = 'refused') as refusals, count(distinct case when outcome = 'allowed' then authority end) as addresses,
  coalesce(bool_and(authority like '127.%') filter (outcome = 'allowed'), true) as stayed, coalesce(bool_and(outcome = 'refused' or authority like '127.%') filter (purpose = 'documentWork'), true) as documents_stayed from entries group by scope""")
def ledger_totals(spark, sf):
    return ledger.totals(entries(spark, sf), ["scope"])


@_query(f"with {ENTRIES} select scope, seq, nth from (select scope, seq, row_number() over (partition by scope order by entries.at desc, seq desc) as nth from entries) where nth <= 500")
def ledger_last500(spark, sf):
    return ledger.last_entries(entries(spark, sf), ["scope"]).select("scope", "seq", F.col("nth").cast("long").alias("nth"))


_CLEARED = f"""{ENTRIES}, e as (select scope, "at", seq, case when seq % 1013 = 7 then 'clear' else purpose end as purpose, authority, outcome, bytes_sent, bytes_received from entries),
cleared as (select scope, max(struct_pack(a := "at", s := seq)) as c from e where purpose = 'clear' group by scope), own as (select e.* from e left join cleared using (scope) where purpose <> 'clear' and (c is null or struct_pack(a := "at", s := seq) > c)),
latest as (select * from own qualify row_number() over (partition by scope order by own.at desc, seq desc) <= 500)"""


def clearing_entries(spark, sf) -> DataFrame:
    """Ledger entries, of which some clear it."""
    return entries(spark, sf).withColumn("purpose", F.when(F.col("seq") % 1013 == 7, ledger.CLEAR).otherwise(F.col("purpose")))


@_query(f"""with {_CLEARED}, t as (select scope, count(*) as requests, sum(bytes_sent)::bigint as bytes_sent, sum(bytes_received)::bigint as bytes_received, count(distinct case when outcome = 'allowed' then authority end) as addresses, coalesce(bool_and(authority like '127.%') filter (outcome = 'allowed'), true) as stayed from own group by scope),
k as (select scope, count(*) filter (outcome = 'refused') as refusals, coalesce(bool_and(outcome = 'refused' or authority like '127.%') filter (purpose = 'documentWork'), true) as documents_stayed, count(*) as n_entries, arg_min(seq, struct_pack(a := "at", s := seq)) as first_seq, arg_max(seq, struct_pack(a := "at", s := seq)) as last_seq from latest group by scope)
select * from t join k using (scope)""")
def ledger_present(spark, sf):
    """The ledger of each scope as it stands: since it was cleared, and its latest entries."""
    return ledger.present(clearing_entries(spark, sf), ["scope"])


@_query("""with m as (select p_partkey as model_id, p_size * 1e9::double as weights from part), s as (select s_suppkey as machine_id, s_suppkey % 10 <> 0 as silicon, (s_suppkey % 8 + 1) * 8e9::double as memory, (s_suppkey % 5 + 1) * 1e10::double as disk from supplier)
select machine_id, (select arg_min(model_id, (50e9 - weights) * 1000000 + model_id) from m where s.silicon and weights * 1.4::double + 3e9::double <= s.memory * 0.75::double and weights + 1e9::double <= s.disk) as model_id from s""")
def model_admission(spark, sf):
    models = table(spark, sf, "part").select(F.col("p_partkey").alias("model_id"), (F.col("p_size") * 1e9).alias("weights"))
    k = F.col("s_suppkey")
    machines = table(spark, sf, "supplier").select(k.alias("machine_id"), (k % 10 != 0).alias("silicon"), ((k % 8 + 1) * 8e9).alias("memory"), ((k % 5 + 1) * 1e10).alias("disk"))
    return catalogue.admitted(models, machines)


@_query(f"""with {LINES}, b as (select * from lines where trim(text) <> '') select a.doc_id, a.page, a.line_no as ord, coalesce(bool_or(c.y < a.y + a.h and c.y + c.h > a.y), false) as shares_rows, coalesce(bool_or(c.x < a.x + a.w and c.x + c.w > a.x), false) as shares_columns,
  coalesce(min(case when c.y < a.y + a.h and c.y + c.h > a.y and c.x >= a.x + a.w then c.x end), 1.0::double) as right_limit, coalesce(min(case when c.x < a.x + a.w and c.x + c.w > a.x and c.y >= a.y + a.h then c.y end), 1.0::double) as floor_limit
  from b a left join b c on c.doc_id = a.doc_id and c.page = a.page and c.line_no <> a.line_no group by a.doc_id, a.page, a.line_no""")
def interval_neighbours(spark, sf):
    return geometry.neighbours(lines(spark, sf).where(~T.blank(F.col("text"))).withColumn("ord", F.col("line_no")))


@_query(f"""with {LINES}, s as (select doc_id, page, line_no, round(w * 100, 6) as size from lines where trim(text) <> ''), c as (select *, case when size <= lag(size) over (partition by doc_id, page order by size, line_no) * 1.25::double then 0 else 1 end as starts from s),
r as (select *, sum(starts) over (partition by doc_id, page order by size, line_no) as run from c) select doc_id, page, run::bigint as run, count(*) as n, list_sort(list(size))[count(*) // 2 + 1] as size from r group by doc_id, page, run""")
def type_size_runs(spark, sf):
    sized = lines(spark, sf).where(~T.blank(F.col("text"))).select("doc_id", "page", F.col("line_no").alias("ord"), F.round(F.col("w") * 100, 6).alias("size"))
    return geometry.type_runs(sized)


@_query(f'with {LINES} select doc_id, page, min(x) as "left", max(x + w) as "right" from lines where trim(text) <> \'\' group by doc_id, page')
def page_measure(spark, sf):
    return geometry.page_measure(lines(spark, sf).where(~T.blank(F.col("text"))))


@_query("select date_trunc('hour', ts) as start, case when event_type = 'purchase' then 'modelWeights' else 'documentWork' end as purpose, count(*) as requests, sum(length(props))::bigint as bytes_sent from events group by 1, 2")
def ledger_windows(spark, sf):
    return ledger.windowed(entries(spark, sf)).select(F.col("start").cast("timestamp_ntz").alias("start"), "purpose", "requests", "bytes_sent")


# --- Han texts made from the tables ----------------------------------------------------------------------------------

#: A Han character for each Latin letter, and its reading; numerals by digit.
_HAN, _READ, _NUMERALS = "啊波次得额佛哥喝衣机科勒摸呢哦坡期日思特乌微我西呀兹", "a bo ci de e fu ge he yi ji ke lei mo ne o po qi ri si te wu wei wo xi ya zi".split(), CHINESE.numerals
_ABC = "abcdefghijklmnopqrstuvwxyz"


def _han(c):
    """A text with its letters as Han characters."""
    return F.translate(F.lower(c), _ABC, _HAN)


def _han_sql(c: str) -> str:
    return f"translate(lower({c}), '{_ABC}', '{_HAN}')"


def _spelled_sql(c: str) -> str:
    """The readings of a Han text in one word."""
    return f"array_to_string(list_transform(string_split({c}, ''), lambda x: list_extract({_READ}, strpos('{_HAN}', x))), '')"


def _han_lines(spark, sf) -> DataFrame:
    """Lines in Han characters as a recognizer gives them: blanks of either width between words, list marks before some."""
    marks = F.element_at(F.array(*map(F.lit, _MARKS)), F.col("line_no") % len(_MARKS) + 1)
    wide = F.when(F.col("doc_id") % 2 == 0, F.replace(_han(F.col("text")), F.lit(" "), F.lit(" 　"))).otherwise(_han(F.col("text")))
    return lines(spark, sf).select("doc_id", "page", "line_no", F.concat(marks, wide).alias("text"))


_MARKS = ["", "（一） ", "", "第十条 ", "１、", "· ", "", "十、", "(2) ", "12) ", "　"]
_HAN_LINES = f"""{LINES}, han as (select doc_id, page, line_no, list_extract([{', '.join(f"'{m}'" for m in _MARKS)}], line_no % {len(_MARKS)} + 1) || case when doc_id % 2 = 0 then replace({_han_sql('text')}, ' ', ' 　') else {_han_sql('text')} end as text from lines)"""
_CLOSE = r"regexp_replace({0}, '([\x{{4E00}}-\x{{9FFF}}（）、１])[ 　]+([\x{{4E00}}-\x{{9FFF}}（）、１])', '\1\2', 'g')"


@_query(f"with {_HAN_LINES} select doc_id, page, line_no, regexp_replace(regexp_replace({_CLOSE.format(_CLOSE.format('text'))}, '[ 　]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') as normal from han")
def normalize_han(spark, sf):
    return _han_lines(spark, sf).select("doc_id", "page", "line_no", T.normalized(F.col("text"), CHINESE).alias("normal"))


@_query(rf"""with {_HAN_LINES}, b as (select *, regexp_replace(text, '[\s　\p{{P}}]', '', 'g') as bare from han)
select doc_id, page, line_no, case when length(bare) > 0 then round(len(regexp_extract_all(bare, '[\x{{4E00}}-\x{{9FFF}}\x{{FF10}}-\x{{FF19}}]')) / length(bare)::double, 6) else 0.0 end as share, length(regexp_replace(text, '[\s　]', '', 'g')) as letters from b""")
def script_share_han(spark, sf):
    return _han_lines(spark, sf).select("doc_id", "page", "line_no", F.round(T.script_share(F.col("text"), CHINESE), 6).alias("share"), T.letters(F.col("text")).alias("letters"))


@_query(f"with {_HAN_LINES} select doc_id, page, line_no, line_no % {len(_MARKS)} in (1, 3, 4, 5, 7, 8, 9) or regexp_matches(regexp_replace(text, '^[ 　]+', ''), '^([-—*]|[0-9]+[.)、])') as is_item from han")
def list_item_han(spark, sf):
    return _han_lines(spark, sf).select("doc_id", "page", "line_no", T.list_item(T.trimmed(F.col("text"))).alias("is_item"))


@_query(rf"""with {LINES}, w as (select doc_id, page, line_no, unnest(regexp_extract_all(lower(text), '[a-z]+')) as word, generate_subscripts(regexp_extract_all(lower(text), '[a-z]+'), 1) as n from lines)
select doc_id, page, line_no, n::int as n, {_han_sql('word')} as run, {_spelled_sql(_han_sql('word'))} as spelled, length(word) as n_syllables from w""")
def han_readings(spark, sf):
    """Each run of Han characters of a line with its reading, a syllable a character, by the rules of the library that Spark ships."""
    runs = lines(spark, sf).select("doc_id", "page", "line_no", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("n", "word"))
    read = runs.select("doc_id", "page", "line_no", (F.col("n") + 1).alias("n"), _han(F.col("word")).alias("run")).withColumn("said", romanize.romanized(F.col("run"), romanize.readings(spark)))
    return read.select("doc_id", "page", "line_no", "n", "run", F.array_join("said", "").alias("spelled"), F.size("said").alias("n_syllables"))


_NAMED = rf"""{LINES}, w as (select doc_id, page, line_no, left(regexp_extract(lower(text), '[a-z]{{3,}}'), 5) as word from lines), n as (select *, {_han_sql('word')} as run, case line_no % 4 when 0 then word when 1 then right(word, 3) when 2 then left(word, 2) else left(word, 4) end as part from w where word <> ''),
t as (select *, {_spelled_sql(_han_sql('part'))} as said from n),
windows as (select t.*, b::int as b, k::int as k from t, range(0, 3) r(b), range(3, 6) s(k) where b + k <= length(word)),
hits as (select *, row_number() over (partition by doc_id, page, line_no order by k desc, b) as first from windows where {_spelled_sql("substring(run, b + 1, k)")} = said)"""


@_query(f"with {_NAMED} select t.doc_id, t.page, t.line_no, substring(h.run, h.b + 1, h.k) as name, upper(left(t.said, 1)) || substring(t.said, 2) as evidence from t join hits h on h.doc_id = t.doc_id and h.page = t.page and h.line_no = t.line_no and h.first = 1")
def transliterated_names(spark, sf):
    """Names that a translation only spells out: a line's first word of three letters or more, of five at most."""
    w = lines(spark, sf).select("doc_id", "page", "line_no", F.left(F.regexp_extract(F.lower("text"), "[a-z]{3,}", 0), F.lit(5)).alias("word")).where("word <> ''")
    k = F.col("line_no") % 4
    part = F.when(k == 0, F.col("word")).when(k == 1, F.right("word", F.lit(3))).when(k == 2, F.left("word", F.lit(2))).otherwise(F.left("word", F.lit(4)))
    read = F.create_map(*[F.lit(x) for pair in zip(_ABC, _READ, strict=True) for x in pair])
    said = F.array_join(F.transform(F.regexp_extract_all(part, F.lit("."), 0), lambda c: read[c]), "")
    rows = w.select("doc_id", "page", "line_no", F.concat(F.lit("服用 "), _han(F.col("word")), F.lit("。")).alias("source"), F.concat(F.lit("Take "), F.upper(F.left(said, F.lit(1))), F.substring(said, F.lit(2), F.char_length(said)), F.lit(" now, 3 times")).alias("target"))
    found = rows.withColumn("f", F.explode(brief.transliterated(F.col("source"), F.col("target"), romanize.readings(spark))))
    return found.select("doc_id", "page", "line_no", F.regexp_extract("f.message", "“(.+?)”", 1).alias("name"), F.col("f.evidence").alias("evidence"))


def _contracts(spark, sf) -> DataFrame:
    """order_key, source, target: a contract's sentence for each order and its translation, which errs by the order's number."""
    o, n = table(spark, sf, "orders"), F.col("o_totalprice").cast("long")
    k, month, year = F.col("o_orderkey") % 10, F.month("o_orderdate"), F.year("o_orderdate")
    s = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    plain, when = s("甲方于", year, "年", month, "月付款", n, "元给乙方"), s(F.date_format("o_orderdate", "MMMM"), " ", year)
    source = F.when(k == 7, s("甲方应当付款", F.translate(n.cast("string"), "0123456789", _NUMERALS), "元给乙方")).when(k == 8, s("甲方按照第", month, "章付款给乙方")).otherwise(plain)
    words = F.element_at(F.array(*map(F.lit, T.ORDINALS)), month)
    target = (
        F.when(k == 0, s("Party A paid ", n, " yuan to Party B in ", when)).when(k == 1, s("Party A paid ", n, " yuan to Party B in ", F.date_format("o_orderdate", "MMM"))).when(k == 2, s("Party A paid ", n + 1, " yuan to Party B in ", when))
        .when(k == 3, s("Note: Party A paid ", n, " yuan to Party B in ", when)).when(k == 4, s("The buyer paid ", n, " yuan to the seller in ", when)).when(k == 5, s("Party A 付款给 ", n, " yuan to Party B in ", when))
        .when(k == 6, F.lit(" 　")).when(k == 7, s("Party A shall pay ", n, " yuan to party b")).when(k == 8, s("Party A pays party B under the ", words, " chapter")).otherwise(s("Party A Party B ", n, " in ", when, " and so on and so on and so on and so on"))
    )
    return o.select(F.col("o_orderkey").alias("order_key"), source.alias("source"), target.alias("target"))


_CONTRACTS = rf"""c as (select o_orderkey as order_key, o_orderkey % 10 as k, o_totalprice::bigint as n0, trunc(o_totalprice)::bigint as n, month(o_orderdate) as m, year(o_orderdate) as y, monthname(o_orderdate) as name from orders),
f as (select *, case k when 7 then '甲方应当付款' || translate(n::varchar, '0123456789', '{_NUMERALS}') || '元给乙方' when 8 then '甲方按照第' || m || '章付款给乙方' else '甲方于' || y || '年' || m || '月付款' || n || '元给乙方' end as source from c),
found as (select order_key, length(source) as said, list_filter([case when k = 5 and share5 > 0.4 then 'untranslatedScript:3:付款给' when k = 5 and share5 > 0.15 then 'untranslatedScript:2:付款给' end, case when k = 1 then 'droppedNumber:3:' || y when k = 2 then 'droppedNumber:3:' || n end, case when k = 2 then 'inventedNumber:2:' || (n + 1) end,
    case when k <> 6 and letters / length(source)::double < 0.8 then 'lengthOutOfRange:2:' when k <> 6 and letters / length(source)::double > 4.5 then 'lengthOutOfRange:1:' end, case when k = 9 then 'repeatedRun:3:and so on' end, case when k = 4 then 'briefIgnored:3:Party A' end, case when k = 4 then 'inconsistentTerm:2:Party B' end, case when k = 3 then 'leakedInstruction:2:Note:' end, case when k = 6 then 'emptyTranslation:3:' end], lambda x: x is not null) as found
  from (select *, 3 / length(replace(t, ' ', ''))::double as share5, length(replace(t, ' ', '')) as letters from (select *, case k when 0 then 'Party A paid ' || n || ' yuan to Party B in ' || name || ' ' || y when 1 then 'Party A paid ' || n || ' yuan to Party B in ' || left(name, 3) when 2 then 'Party A paid ' || (n + 1) || ' yuan to Party B in ' || name || ' ' || y
    when 3 then 'Note: Party A paid ' || n || ' yuan to Party B in ' || name || ' ' || y when 4 then 'The buyer paid ' || n || ' yuan to the seller in ' || name || ' ' || y when 5 then 'Party A 付款给 ' || n || ' yuan to Party B in ' || name || ' ' || y when 6 then ''
    when 7 then 'Party A shall pay ' || n || ' yuan to party b' when 8 then 'Party A pays party B under the ' || list_extract({list(T.ORDINALS)}, m) || ' chapter' else 'Party A Party B ' || n || ' in ' || name || ' ' || y || ' and so on and so on and so on and so on' end as t from f)))"""


@_query(f"with {_CONTRACTS} select order_key, array_to_string(found, ',') as found from found")
def findings_han(spark, sf):
    """Findings of contracts: months and small figures as words, figures in the source's numerals, briefs, agreed terms, leaks."""
    found = integrity.findings(F.col("source"), F.col("target"), CHINESE, [("甲方", "Party A")], {"乙方": "Party B", "甲方": "x"})
    tags = F.transform(found, lambda f: F.concat_ws(":", f["kind"], f["severity"].cast("string"), F.coalesce(f["evidence"], F.lit(""))))
    return _contracts(spark, sf).select("order_key", F.array_join(tags, ",").alias("found"))


# --- readings made one, and how they come about ----------------------------------------------------------------------


def _benchmark_readings(spark, sf) -> DataFrame:
    """Two readers' blocks of the items, five a page: lost, changed, spaced or the same by the item's number."""
    b = table(spark, sf, "benchmark").where(F.col("text").isNotNull())
    k, i = F.col("item_id") % 7, F.col("item_id")
    text = F.concat(F.regexp_replace("text", "[^ -~]", "?"), F.lit(" No. "), (i * 7 + 100).cast("string"))
    left = F.when(k != 3, text)
    right = F.when(k == 1, F.regexp_replace(text, "[0-9]", "7")).when(k == 2, F.replace(text, F.lit("e"), F.lit("c"))).when(k == 4, F.replace(text, F.lit(" "), F.lit("  "))).when(k == 5, F.replace(text, F.lit("an"), F.lit("on"))).when(k != 0, text)
    rows = lambda reader, c: b.select(F.lit("bench").alias("doc_id"), F.floor(i / 5).cast("int").alias("page"), F.lit(reader).alias("reader"), (i % 5).cast("int").alias("ord"), F.when(k == 6, "heading").otherwise("paragraph").alias("kind"), c.alias("text"), F.lit(2).alias("n_lines"), F.lit(0.1).alias("x"), ((i % 5) * 0.1).alias("y"), F.lit(0.5).alias("w"), F.lit(0.08).alias("h")).where("text is not null")
    return rows("visionOCR", left).unionByName(rows("visionLanguageModel", right))


_READINGS = r"""items as (select item_id as i, item_id % 7 as k, regexp_replace(text, '[^ -~]', '?', 'g') || ' No. ' || (item_id * 7 + 100) as t from benchmark where text is not null),
sides as (select *, case when k <> 3 then t end as l, case k when 0 then null when 1 then regexp_replace(t, '[0-9]', '7', 'g') when 2 then replace(t, 'e', 'c') when 4 then replace(t, ' ', '  ') when 5 then replace(t, 'an', 'on') else t end as r from items),
pairs as (select *, trim(regexp_replace(l, ' +', ' ', 'g')) as a, trim(regexp_replace(r, ' +', ' ', 'g')) as b, case when l is not null and r is not null then 1 - levenshtein(left(l, 2000), left(r, 2000)) / greatest(length(left(l, 2000)), length(left(r, 2000)))::double end as s from sides),
kinds as (select *, case when l is null or r is null then 'single' when s >= 0.999 or a = b then 'unanimous' when s < 0.45 or regexp_replace(a, '[0-9]', '', 'g') = regexp_replace(b, '[0-9]', '', 'g') then 'defaulted' else 'adjudicated' end as settlement from pairs),
ends_ as (select *, (select max(n) from range(0, length(a) + 1) x(n) where n <= length(b) and left(a, n) = left(b, n)) as head from kinds),
cuts as (select *, (select max(n) from range(0, least(length(a), length(b)) - coalesce(head, 0) + 1) x(n) where right(a, n) = right(b, n)) as tail from ends_),
diffs as (select *, case when settlement = 'adjudicated' then substr(a, head + 1, length(a) - head - tail) end as da, case when settlement = 'adjudicated' then substr(b, head + 1, length(b) - head - tail) end as db from cuts),
settled as (select *, case when l is null then b when settlement = 'adjudicated' and length(a) % 2 = 0 then b else a end as text, case when l is null then 0.0::double when r is null then null when settlement = 'unanimous' then 1.0::double else s end as agreement,
  case when l is null or settlement = 'adjudicated' and length(a) % 2 = 0 then 'visionLanguageModel' else 'visionOCR' end as reader,
  case when settlement = 'defaulted' and s < 0.45 then '""" + reconcile.BECAUSE_UNLIKE + """' when settlement = 'defaulted' then '""" + reconcile.BECAUSE_FIGURES + """' when settlement = 'adjudicated' then case when da = '' or db = '' or trim(da) = '' and trim(db) = '' then 'they differed' else case when trim(da) = '' then 'nothing' else '“' || left(trim(da), 24) || '”' end || ' against ' || case when trim(db) = '' then 'nothing' else '“' || left(trim(db), 24) || '”' end end end as because from diffs)"""


@_query(f"""with {_READINGS} select (i // 5)::int as page, row_number() over w - 1 as ord, case when k = 6 then 'heading' else 'paragraph' end as kind, text, round(agreement, 6) as agreement, settlement, reader, because, lag(text) over w as context_before,
  (case when l is null or r is null then 1 else 2 end)::int as n_candidates from settled window w as (partition by i // 5 order by i)""")
def reconciled_pages(spark, sf):
    r = reconcile.reconciled(_benchmark_readings(spark, sf), DIACRITIC, lambda before, a, b: "B" if len(a) % 2 == 0 else "A")
    return r.select("page", F.col("ord").cast("long").alias("ord"), "kind", "text", F.round("agreement", 6).alias("agreement"), "settlement", "reader", "because", "context_before", F.size("candidates").alias("n_candidates"))


@_query(f"with {_READINGS} select i as item_id, da as left_part, db as right_part, because as said, coalesce(agreement < 1, false) as was_contested, agreement is not null as was_double_checked from settled where settlement = 'adjudicated'")
def disagreements(spark, sf):
    """What tells two readings apart, in words, and the flags that follow from their agreement."""
    r = _benchmark_readings(spark, sf)
    side = lambda reader, c: r.where(F.col("reader") == reader).select((F.col("page") * 5 + F.col("ord")).cast("long").alias("item_id"), T.normalized(F.col("text"), DIACRITIC).alias(c), F.col("text").alias(f"raw_{c}"))
    both = side("visionOCR", "a").join(side("visionLanguageModel", "b"), "item_id")
    s = T.similarity(F.col("raw_a"), F.col("raw_b"), T.COMPARED)
    both = both.withColumns({"s": s, "agreement": s, "revision": F.lit(None).cast("string"), "first_draft": F.col("a")})
    both = both.where((F.col("s") < 0.999) & (F.col("a") != F.col("b")) & (F.col("s") >= 0.45) & ~reconcile.differ_in_figures(F.col("a"), F.col("b")))
    d = T.differing(F.col("a"), F.col("b"))
    return export.derived(both).select("item_id", d["left"].alias("left_part"), d["right"].alias("right_part"), T.quoted_difference(F.col("a"), F.col("b")).alias("said"), "was_contested", "was_double_checked")


@_query(f"with {BLOCKS} select doc_id, page, ord, lag(text) over (partition by doc_id, page order by ord) as context_before from blocks")
def context_before(spark, sf):
    return context.before(blocks(spark, sf)).select("doc_id", "page", "ord", "context_before")


@_query("""select c_custkey as doc_id, 0 as page, n::int as line_no, case n when 0 then c_name else c_mktsegment || ' ' || c_nationkey end as text, 1.0::double as confidence, 0.1::double as x, round((case n when 0 then 100 else 200 end)::double / 1000, 6) as y, round(length(case n when 0 then c_name else c_mktsegment || ' ' || c_nationkey end) * 6 / 600.0::double, 6) as w, 0.012::double as h
  from customer, range(0, 2) r(n) where length(c_name || c_mktsegment || ' ' || c_nationkey) >= 24 and c_custkey % 5 <> 0""")
def text_layer_lines(spark, sf):
    """Customers as pages of two printed lines, whose characters have boxes in points; every fifth says another number."""
    c = table(spark, sf, "customer")
    second = F.concat("c_mktsegment", F.lit(" "), F.col("c_nationkey").cast("string"))
    lines_ = c.select(F.col("c_custkey").alias("doc_id"), F.lit(0).alias("page"), F.posexplode(F.array("c_name", second)).alias("row", "text"))
    at = F.explode(F.sequence(F.lit(1), F.char_length("text"))).alias("i")
    chars = lines_.select("doc_id", "page", "row", "text", at).select("doc_id", "page", (F.col("row") * 1000 + F.col("i")).alias("n"), F.substring("text", F.col("i"), F.lit(1)).alias("c"), (60 + (F.col("i") - 1) * 6).alias("x"), F.when(F.col("row") == 0, 888).otherwise(788).alias("y"), F.lit(6).alias("w"), F.lit(12).alias("h"))
    said = F.char_length(F.concat("c_name", second)) + F.when(F.col("c_custkey") % 5 == 0, 1).otherwise(0)
    pages_ = c.select(F.col("c_custkey").alias("doc_id"), F.lit(0).alias("page"), F.lit(0).alias("left"), F.lit(0).alias("bottom"), F.lit(600).alias("width"), F.lit(1000).alias("height"), said.alias("n_characters"))
    t = layout.text_layer(chars, pages_)
    return t.select("doc_id", "page", "line_no", "text", "confidence", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round("w", 6).alias("w"), F.round("h", 6).alias("h"))


@_query(f"""with {LINES}, c as (select doc_id, page, text, ((length(text) + line_no) % 10) / 10.0::double as c1, ((length(text) + line_no * 3) % 10) / 10.0::double as c2 from lines), q as (select doc_id, page, count(*) as n, count(*) filter (c1 < 0.3) as weak, sum(length(text) * c1) as one, sum(length(text) * c2) as two from c group by doc_id, page)
select doc_id, page, case when weak / n::double > 0.3 and two > one then 2 else 1 end as attempt, round(case when weak / n::double > 0.3 and two > one then two else one end, 6) as quality from q""")
def reading_attempts(spark, sf):
    """Which of two readings of each page is kept, by characters and confidence."""
    l = lines(spark, sf)  # noqa: E741
    of = lambda n, by: l.select("doc_id", "page", F.lit(n).alias("attempt"), "text", (((F.char_length("text") + F.col("line_no") * by) % 10) / 10.0).alias("confidence"))
    return layout.better_attempt(l, of(1, 1).unionByName(of(2, 3))).select("doc_id", "page", "attempt", F.round("quality", 6).alias("quality"))


@_query(f"with {LINES} select doc_id, page, line_no, text, 0.5::double as confidence, round(1 - (y + h), 6) as y from lines where line_no % 4 <> 1")
def observed_lines(spark, sf):
    """A recognizer's observations, boxes from the bottom left; some have no candidate."""
    top = F.array(F.struct("text", F.lit(0.5).alias("confidence")), F.struct(F.lit("other").alias("text"), F.lit(0.4).alias("confidence")))
    o = lines(spark, sf).withColumn("candidates", F.when(F.col("line_no") % 4 == 1, F.slice(top, 1, 0)).otherwise(top))
    return layout.observed_lines(o).select("doc_id", "page", "line_no", "text", "confidence", F.round("y", 6).alias("y"))


@_query(rf"""with {LINES}, {_ASSEMBLED}, {_sentences_sql('s', 'raw', 'doc_id, page, block')},
b as (select doc_id, page, block, text, case when length(trim(bare)) <= {layout.FURNITURE} and n_lines = 1 and (y + h > {layout.BOTTOM} or y < {layout.TOP}) then 'pageFurniture' when regexp_matches(trim(bare), {_ITEM}) then 'listItem' when n_lines <= {layout.HEADING_LINES} and not regexp_matches(trim(bare), '[.!?]$') and h / n_lines > median * {layout.HEADING}::double and length(trim(bare)) <= {layout.HEADING_LENGTH} then 'heading' else 'paragraph' end as kind from raw),
l as (select doc_id, page, block, text, ord, x, y, w, h, sum(length(text) + 1) over (partition by doc_id, page, block order by ord) - length(text) - 1 as a from numbered),
many as (select * from (select *, count(*) over (partition by doc_id, page, block) as n from s) where n > 1 and trim(sentence) <> ''),
parts as (select m.doc_id, m.page, m.block, m.ord as seq, trim(sentence) as said, l.ord as line, substring(l.text, (greatest(a, start) - a + 1)::bigint, (least(a + length(l.text), start + length(sentence)) - greatest(a, start))::bigint) as part,
  case when greatest(a, start) > a or least(a + length(l.text), start + length(sentence)) < a + length(l.text) then x + w * ((greatest(a, start) - a)::double / length(l.text)) else x end as x, y, h,
  case when greatest(a, start) > a or least(a + length(l.text), start + length(sentence)) < a + length(l.text) then w * ((least(a + length(l.text), start + length(sentence)) - greatest(a, start))::double / length(l.text)) else w end as w
  from many m join l on l.doc_id = m.doc_id and l.page = m.page and l.block = m.block and a < start + length(sentence) and a + length(l.text) > start
  union all select l.doc_id, l.page, l.block, 0, b.text, l.ord, l.text, l.x, l.y, l.h, l.w from l join b on b.doc_id = l.doc_id and b.page = l.page and b.block = l.block where not exists (select 1 from many m where m.doc_id = l.doc_id and m.page = l.page and m.block = l.block)),
pieces as (select doc_id, page, block, seq, any_value(said) as said, list(part order by line) as lines, min(x) as x, min(y) as y, max(x + w) - min(x) as w, max(y + h) - min(y) as h from parts group by doc_id, page, block, seq)
select c.doc_id, c.page, (row_number() over (partition by c.doc_id, c.page order by c.block, seq) - 1)::int as ord, case when b.kind in ('heading', 'pageFurniture') then b.kind when regexp_matches(said, {_ITEM}) then 'listItem' else 'paragraph' end as kind, said as text, lines, len(lines)::int as n_lines, round(x, 9) as x, round(y, 9) as y, round(w, 9) as w, round(h, 9) as h, 0.9::double as confidence
from pieces c join b on b.doc_id = c.doc_id and b.page = c.page and b.block = c.block""")
def sentence_blocks(spark, sf):
    return _rounded(layout.sentence_blocks(lines(spark, sf), DIACRITIC))


@_query(rf"""with l as (select conv_id, turn, line, trim(regexp_replace(raw, '\s+', ' ', 'g')) as text from (select conv_id, turn, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) as line from conversations)), kept as (select * from l where text <> ''), {_sentences_sql('s', 'kept', 'conv_id, turn, line')}
select conv_id as doc_id, turn as page, (row_number() over (partition by conv_id, turn order by line, ord) - 1)::int as ord, 'paragraph' as kind, trim(sentence) as text, [trim(sentence)] as lines, 0.0::double as x, 0.0::double as y, 1.0::double as w, 1.0::double as h, null::double as confidence from s where trim(sentence) <> ''""")
def transcript_blocks(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.concat(F.lit("<think>so\n</think>\n```\n"), "text", F.lit("\n```")).alias("answer"))
    return layout.transcript_blocks(c, DIACRITIC)


@_query(rf"""with {_sentences_sql('s', 'conversations', 'conv_id, turn')}, t as (select *, trim(text, ' ' || chr(10) || chr(9)) as said from conversations), l as (select *, regexp_extract(said, '([.!?])["'')\]]*$', 1) as last, regexp_extract(said, '([.\p{{L}}\p{{N}}]*)\.["'')\]]*$', 1) as stem from t)
select conv_id, turn, coalesce((select list(e order by e) from s_ends where s_ends.conv_id = l.conv_id and s_ends.turn = l.turn), []::int[]) as ends, last in ('!', '?') or last = '.' and not (stem <> '' and (regexp_full_match(stem, '[.\p{{N}}]+') or lower(stem) in ('co', 'ltd', 'no', 'inc', 'vs', 'etc'))) as ended from l""")
def sentence_stops(spark, sf):
    return layout.stops(table(spark, sf, "conversations"), DIACRITIC, ["conv_id", "turn"])


# --- geometry of what is drawn ---------------------------------------------------------------------------------------

_RECTS = """kept as (select *, case when line_no % 6 = 0 then 'heading' when line_no % 9 = 5 then 'pageFurniture' else 'paragraph' end as kind, (x * 600)::double as x0, ((1 - (y + h)) * 800)::double as y0 from lines where trim(text) <> ''),
r as (select *, x0 + (w * 600)::double as x1, y0 + (h * 800)::double as y1, min(x0) over p as lft, max(x0 + (w * 600)::double) over p as rgt from kept window p as (partition by doc_id, page)),
o as (select a.doc_id, a.page, a.line_no, bool_or(b.y0 < a.y1 and b.y1 > a.y0) as shares,
  min(case when b.y0 < a.y1 and b.y1 > a.y0 and b.x0 > a.x0 or not (b.y0 < a.y1 and b.y1 > a.y0) and b.kind <> 'pageFurniture' and b.x0 >= a.x1 then b.x0 - (a.y1 - a.y0) * 0.35::double end) as stop_r,
  max(case when b.y0 < a.y1 and b.y1 > a.y0 and b.x1 < a.x1 or not (b.y0 < a.y1 and b.y1 > a.y0) and b.kind <> 'pageFurniture' and b.x1 <= a.x0 then b.x1 + (a.y1 - a.y0) * 0.35::double end) as stop_l
  from r a join r b on b.doc_id = a.doc_id and b.page = a.page and b.line_no <> a.line_no group by a.doc_id, a.page, a.line_no),
m as (select r.*, coalesce(shares, false) as shares, greatest(least(rgt, coalesce(stop_r, rgt)), x1) as to_, least(greatest(lft, coalesce(stop_l, lft)), x0) as fro, (x0 + x1) / 2 as mid from r left join o on o.doc_id = r.doc_id and o.page = r.page and o.line_no = r.line_no)"""


def _drawn(spark, sf) -> DataFrame:
    kind = F.when(F.col("line_no") % 6 == 0, "heading").when(F.col("line_no") % 9 == 5, "pageFurniture").otherwise("paragraph")
    return lines(spark, sf).where(~T.blank(F.col("text"))).withColumns({"ord": F.col("line_no"), "kind": kind, "n_lines": F.col("line_no") % 3})


_SPACED = """c as (select *, not shares and rgt > lft and abs(mid - (lft + rgt) / 2) < (rgt - lft) * 0.06::double and x1 - x0 < (rgt - lft) * 0.8::double as centred, least(mid - fro, to_ - mid) as half from m),
s as (select *, case when centred then mid - half else x0 end as sx, case when centred then half * 2 else to_ - x0 end as sw from c),
f as (select a.doc_id, a.page, a.line_no, max(b.y1) as floor from s a join s b on b.doc_id = a.doc_id and b.page = a.page and b.line_no <> a.line_no and b.x0 < a.sx + a.sw and b.x1 > a.sx and b.y1 <= a.y0 + (a.y1 - a.y0) / 2 group by a.doc_id, a.page, a.line_no),
spaced as (select s.doc_id, s.page, s.line_no as ord, shares as shares_lines, centred, round(sx, 4) as space_x, round(sw, 4) as space_w, round(least(greatest(0.0::double, coalesce(floor, 0.0::double)), y0), 4) as room_below from s left join f on f.doc_id = s.doc_id and f.page = s.page and f.line_no = s.line_no)"""


@_query(f"with {LINES}, {_RECTS}, {_SPACED} select * from spaced")
def free_space(spark, sf):
    g = geometry.free_space(_drawn(spark, sf), 600.0, 800.0)
    return g.select("doc_id", "page", "ord", "shares_lines", "centred", *[F.round(c, 4).alias(c) for c in ("space_x", "space_w", "room_below")])


_SIZED = """own as (select *, (y1 - y0) / ((greatest(line_no % 3, 1) - 1) * 1.45::double + 1.12::double) as own, kind = 'heading' and not shares as heading from m),
body as (select doc_id, page, coalesce(list_sort(list(own) filter (not heading))[count(*) filter (not heading) // 2 + 1], list_sort(list(own))[count(*) // 2 + 1]) as body from own group by doc_id, page),
marked as (select *, case when own <= lag(own) over w * 1.25::double then 0 else 1 end as starts from own window w as (partition by doc_id, page, heading order by own, line_no)), numbered as (select *, sum(starts) over (partition by doc_id, page, heading order by own, line_no) as run from marked),
runs as (select doc_id, page, heading, run, list_sort(list(own))[count(*) // 2 + 1] as size from numbered group by doc_id, page, heading, run),
sized as (select n.doc_id, n.page, n.line_no as ord, n.heading, round(greatest(6.5::double, case when n.heading then size else least(size, body * 1.4::double) end), 4) as size from numbered n join runs r on r.doc_id = n.doc_id and r.page = n.page and r.heading = n.heading and r.run = n.run join body b on b.doc_id = n.doc_id and b.page = n.page)"""


@_query(f"with {LINES}, {_RECTS}, {_SIZED} select * from sized")
def type_sizes(spark, sf):
    return geometry.type_sizes(_drawn(spark, sf), 600.0, 800.0).select("doc_id", "page", "ord", "heading", F.round("size", 4).alias("size"))


_WIDTH = "case when contains(' .,;:!|''ijl', {0}) then 2 when contains('mwMW', {0}) then 7 when unicode({0}) >= 11904 then 8 when {0} between 'A' and 'Z' then 5 else 4 end"
#: Lines of words in a width: each word goes on the line, begins one, or is broken by characters if it is wider.
_LINES_OF = r"""list_reduce(list_prepend({{l: 1::bigint, x: 0::bigint, wide: []::bigint[]}}, words), lambda a, w: case when a.x > 0 and a.x + 2 + w.x <= {0} then {{l: a.l, x: a.x + 2 + w.x, wide: []::bigint[]}} when w.x <= {0} then {{l: a.l + case when a.x > 0 then 1 else 0 end, x: w.x, wide: []::bigint[]}}
  else list_reduce(list_prepend({{l: a.l + case when a.x > 0 then 1 else 0 end, x: 0::bigint, wide: []::bigint[]}}, list_transform(w.wide, lambda c: {{l: 1::bigint, x: c, wide: []::bigint[]}})), lambda b, c: case when b.x = 0 or b.x + c.x <= {0} then {{l: b.l, x: b.x + c.x, wide: []::bigint[]}} else {{l: b.l + 1, x: c.x, wide: []::bigint[]}} end) end).l"""


@_query(f"""with recursive {LINES}, {_RECTS}, {_SPACED}, {_SIZED}, given as (select s.doc_id, s.page, s.ord, least(72.0::double, greatest(6.5::double, size)) as size, space_w, k.h * 800 + greatest(0.0::double, round((1 - (k.y + k.h)) * 800, 4) - room_below) as available, list_filter(string_split(regexp_replace(trim(k.text), '\\s+', ' ', 'g'), ' '), lambda w: w <> '') as parts
  from spaced s join sized z on z.doc_id = s.doc_id and z.page = s.page and z.ord = s.ord join kept k on k.doc_id = s.doc_id and k.page = s.page and k.line_no = s.ord),
w as (select doc_id, page, ord, size, space_w, available, list_transform(parts, lambda p: {{l: 1::bigint, x: list_sum(list_transform(string_split(p, ''), lambda c: {_WIDTH.format('c')}))::bigint, wide: list_transform(string_split(p, ''), lambda c: ({_WIDTH.format('c')})::bigint)}}) as words from given),
tries as (select doc_id, page, ord, size as p, {_LINES_OF.format('space_w * 8 / size')} as n, space_w, available, words from w
  union all select doc_id, page, ord, q, {_LINES_OF.format('space_w * 8 / q')}, space_w, available, words from (select *, greatest(6.5::double, p - greatest(0.5::double, p * 0.08::double)) as q from tries where p > 6.5 and n * p * 1.125::double > available))
select doc_id, page, ord, round(arg_min(p, p), 4) as size, arg_min(n, p)::int as n_lines from tries group by doc_id, page, ord""")
def refit_sizes(spark, sf):
    """The size that each block's text is set in so that it fits its free space and the room below, and its lines."""
    drawn, at = _drawn(spark, sf), ["doc_id", "page", "ord"]
    space = geometry.free_space(drawn, 600.0, 800.0).select(*at, F.round("space_w", 4).alias("space_w"), F.round("room_below", 4).alias("room_below"))
    size = geometry.type_sizes(drawn, 600.0, 800.0).select(*at, F.round("size", 4).alias("size"))
    b = drawn.select(*at, "text", (F.col("h") * 800).alias("high"), F.round((1 - (F.col("y") + F.col("h"))) * 800, 4).alias("bottom")).join(space, at).join(size, at)
    return b.select(*at, geometry.refit(F.col("text"), F.col("size"), F.col("space_w"), F.col("high"), F.col("bottom") - F.col("room_below")).alias("r")).select(*at, F.round("r.size", 4).alias("size"), "r.n_lines")


@_query(f"with {LINES} select doc_id, page, line_no as ord, trim(text) <> '' and line_no % 3 <> 1 and not (line_no % 5 = 2) and w * 50 > 4 and h * 100 > 4 as drawn from lines")
def drawable_blocks(spark, sf):
    l, whole = lines(spark, sf), F.col("line_no") % 5 == 2  # noqa: E741
    target = F.when(F.col("line_no") % 3 == 1, F.col("text")).otherwise(F.concat(F.lit(" "), "text", F.when(T.trimmed(F.col("text")) != "", "!").otherwise("")))
    box = [F.when(whole, v).otherwise(F.col(c)) for c, v in (("x", 0.0), ("y", 0.0), ("w", 1.0), ("h", 1.0))]
    return l.select("doc_id", "page", F.col("line_no").alias("ord"), geometry.drawable(T.trimmed(F.col("text")), target, *box, 50.0, 100.0).alias("drawn"))


_COLOURS = """i as (select page_id, hex(encode(html)) as image, strlen(html) // 192 as high from pages), b as (select page_id, half, image, high, half * 32 as x0, least(1.0::double, 96 / greatest(32, high)::double) as scale from i, range(0, 2) r(half)),
t as (select *, greatest(1, floor(32 * scale))::int as tw, greatest(1, floor(high * scale))::int as th from b where high >= 2),
g as (select page_id, half, image, x0 + ((2 * i + 1) * 32) // (2 * tw) as x, ((2 * j + 1) * high) // (2 * th) as y from t, lateral (select unnest(range(tw)) as i), lateral (select unnest(range(th)) as j)),
px as (select page_id, half, ('0x' || substring(image, (y * 64 + x) * 6 + 1, 2))::int as r, ('0x' || substring(image, (y * 64 + x) * 6 + 3, 2))::int as g, ('0x' || substring(image, (y * 64 + x) * 6 + 5, 2))::int as b from g),
h as (select page_id, half, (r >> 3 << 10) | (g >> 3 << 5) | (b >> 3) as key, count(*) as n, sum(r)::double as r, sum(g)::double as g, sum(b)::double as b from px group by 1, 2, 3),
top as (select page_id, half, key as top, r / n / 255 as pr, g / n / 255 as pg, b / n / 255 as pb from h qualify row_number() over (partition by page_id, half order by n desc, key) = 1),
d as (select h.*, pr, pg, pb, sqrt((power(r / n / 255 - pr, 2) + power(g / n / 255 - pg, 2) + power(b / n / 255 - pb, 2)) / 3) as far from h join top using (page_id, half)),
k as (select *, sum(n) over (partition by page_id, half order by far desc, key rows between unbounded preceding and current row) as held, sum(n) over (partition by page_id, half) as pool from d where far > 0.12),
ink as (select page_id, half, sum(r) / sum(n) / 255 as r, sum(g) / sum(n) / 255 as g, sum(b) / sum(n) / 255 as b from k where held - n < greatest(1, pool // 4) group by page_id, half)"""


@_query(f"""with {_COLOURS}, dark as (select *, case when 0.2126 * pr + 0.7152 * pg + 0.0722 * pb > 0.5 then 0.0::double else 1.0::double end as other from top)
select b.page_id, b.half::int as half, round(coalesce(pr, 1) * 255, 3) as paper_r, round(coalesce(pg, 1) * 255, 3) as paper_g, round(coalesce(pb, 1) * 255, 3) as paper_b, round(coalesce(ink.r, other, 0) * 255, 3) as ink_r, round(coalesce(ink.g, other, 0) * 255, 3) as ink_g, round(coalesce(ink.b, other, 0) * 255, 3) as ink_b
from b left join dark using (page_id, half) left join ink using (page_id, half)""")
def page_colours(spark, sf):
    """Paper and ink of the left and the right half of each page, its bytes being the pixels of an image 64 wide."""
    p = table(spark, sf, "pages").select("page_id", F.encode("html", "UTF-8").alias("image"), F.floor(F.octet_length("html") / 192).cast("int").alias("high"), F.explode(F.array(F.lit(0), F.lit(1))).alias("half"))
    c = colours.sample(F.col("image"), F.lit(64), F.col("high"), F.col("half") * 32, F.lit(0), F.col("half") * 32 + 32, F.col("high"))
    return p.select("page_id", "half", c.alias("c")).select("page_id", "half", *[F.round(F.col(f"c.{k}")[i] * 255, 3).alias(f"{k}_{n}") for k in ("paper", "ink") for i, n in enumerate("rgb")])


@_query("""with f as (select doc_id, len(string_split(text, chr(10))) % 97 + doc_id % 7 as n_pages, (doc_id % 4 * 90)::int as turned from documents), p as (select *, unnest(range(n_pages)) as page from f)
select doc_id, page::int as page, n_pages::int as n_pages, case when page % 5 = 0 then 500.0 else 600.0 end::double as width, (700 + doc_id % 3 * 50)::double as height, case when page // 5 % 2 = 1 then turned else 0 end as rotation from p""")
def pdf_pages(spark, sf):
    """Pages of files made from documents, plain or compressed, broken at their end or not, by their number."""
    n = F.col("doc_id")
    d = table(spark, sf, "documents").select("doc_id", (F.size(F.split("text", "\n")) % 97 + n % 7).cast("int").alias("n"), (n % 2 == 0).alias("packed"), (n % 4 * 90).cast("int").alias("turned"), (700 + n % 3 * 50).cast("int").alias("high"), (n % 5 == 1).alias("cut"))

    @F.pandas_udf("binary")
    def file(n: pd.Series, packed: pd.Series, turned: pd.Series, high: pd.Series, cut: pd.Series) -> pd.Series:
        whole = (pdf.made(int(a), bool(b), int(c), 600, int(h)) for a, b, c, h in zip(n, packed, turned, high, strict=True))
        return pd.Series([x[: x.rindex(b"startxref")] if k else x for x, k in zip(whole, cut, strict=True)])

    return pdf.pages(d.select("doc_id", file("n", "packed", "turned", "high", "cut").alias("content")), "doc_id")


@_query("select p_partkey as id, round(least(300 / 72.0::double, 300 / 72.0::double * sqrt(40e6::double / ((p_size * 40) * (p_retailprice) * (300 / 72.0::double) * (300 / 72.0::double)))), 9) as scale, round(10 / (p_size + 20.0::double), 9) as x, round(1 - (5 + p_size) / 100.0::double, 9) as y, round(p_size / (p_size + 20.0::double), 9) as w, round(p_size / 100.0::double, 9) as h from part")
def page_boxes(spark, sf):
    """How large pages are rendered, and boxes from the bottom left as shares from the top left."""
    p, s = table(spark, sf, "part"), F.col("p_size")
    box = tables.from_bottom_left(F.lit(10.0), F.lit(5.0), s, s, s + 20.0, F.lit(100.0))
    return p.select(F.col("p_partkey").alias("id"), F.round(tables.render_scale(s * 40, F.col("p_retailprice")), 9).alias("scale"), *[F.round(box[k], 9).alias(k) for k in "xywh"])


# --- terms, names, models, engines -----------------------------------------------------------------------------------


_NAMES = r"select distinct w[1] as source, w[1] || ' ' || w[2] as rendering from (select regexp_extract_all(text, '\S+') as w from documents) where len(w) > 1 and length(w[1]) > 3"


@_query(rf"""with names as ({_NAMES}) select conv_id, turn, array_to_string(list_sort(list(source || '=' || rendering)), '|') as names from conversations join names on contains(text, source) group by conv_id, turn""")
def names_join(spark, sf):
    """Names that stand in a turn, with their renderings: the first words of all documents."""
    word = lambda i: F.regexp_extract("text", r"\A\s*+(\S++)\s++(\S++)", i)  # noqa: E731  a document's rest is not gone through
    names = table(spark, sf, "documents").select(word(1).alias("source"), F.concat_ws(" ", word(1), word(2)).alias("rendering")).where(F.char_length("source") > 3)
    got = profile.applicable(table(spark, sf, "conversations").select("conv_id", "turn", "text"), ["conv_id", "turn"], names, by="source")
    named = F.array_sort(F.transform("terms", lambda t: F.concat(t["source"], F.lit("="), t["rendering"])))
    return got.where(F.size("terms") > 0).select("conv_id", "turn", F.array_join(named, "|").alias("names"))


@_query("select p_partkey as model_id from part where p_brand in (select p_brand from part where p_size = 1)")
def seen_brands(spark, sf):
    p = table(spark, sf, "part")
    return profile.seen_before(p, p.where("p_size = 1"), "p_brand").select(F.col("p_partkey").alias("model_id"))


_MODELS = """m as (select p_partkey as model_id, p_size * 1e9::double as weights, p_name as name from part), s as (select s_suppkey as machine_id, s_suppkey % 10 <> 0 as silicon, (s_suppkey % 8 + 1) * 8e9::double as memory, (s_suppkey % 5 + 1) * 1e10::double as disk from supplier),
installed as (select distinct o_custkey % 100 as machine_id, o_orderkey % 3000 as model_id from orders)"""


def _models(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parts as models, suppliers as machines, and which model lies on which machine."""
    models = table(spark, sf, "part").select(F.col("p_partkey").alias("model_id"), (F.col("p_size") * 1e9).alias("weights"), F.col("p_name").alias("name"))
    k = F.col("s_suppkey")
    machines = table(spark, sf, "supplier").select(k.alias("machine_id"), (k % 10 != 0).alias("silicon"), ((k % 8 + 1) * 8e9).alias("memory"), ((k % 5 + 1) * 1e10).alias("disk"))
    installed = table(spark, sf, "orders").select((F.col("o_custkey") % 100).alias("machine_id"), (F.col("o_orderkey") % 3000).alias("model_id")).distinct()
    return models, machines, installed


@_query(f"""with {_MODELS}, fits as (select s.machine_id, m.model_id, m.weights, exists (select 1 from installed i where i.machine_id = s.machine_id and i.model_id = m.model_id) as here from s join m on s.silicon and m.weights * 1.4::double + 3e9::double <= s.memory * 0.75::double)
select s.machine_id, f.model_id from s left join (select machine_id, model_id from fits qualify row_number() over (partition by machine_id order by here desc, weights desc, model_id) = 1) f on f.machine_id = s.machine_id""")
def model_recommended(spark, sf):
    return catalogue.recommended(*_models(spark, sf))


@_query(f"with {_MODELS} select i.machine_id, i.model_id, m.name, m.name is null as orphan from installed i left join m on m.model_id = i.model_id")
def model_specs(spark, sf):
    models, _, installed = _models(spark, sf)
    return catalogue.specified(installed, models).select("machine_id", "model_id", "name", "orphan")


@_query(f"with {_MODELS} select machine_id, model_id from installed where model_id not in (select model_id from m where weights < 2e10)")
def models_unused(spark, sf):
    models, _, installed = _models(spark, sf)
    return catalogue.unused(installed, models.where("weights < 2e10")).select("machine_id", "model_id")


@_query("select count(*) as n_models, sum(p_size)::bigint as bytes from part")
def model_storage(spark, sf):
    return catalogue.storage(table(spark, sf, "part").select(F.col("p_size").cast("long").alias("bytes")))


@_query(f"""with {_MODELS}, pair_ as (select s.machine_id, m.model_id, s.silicon, s.memory, s.disk, m.weights as mine, ((m.model_id % 9) + 1) * 1e9::double as other from s join m on m.model_id % 100 = s.machine_id)
select machine_id, model_id, case when not silicon then 'silicon' when mine * 1.4::double + 3e9::double + (other * 1.4::double + 3e9::double) > memory * 0.75::double then 'both' when mine * 1.4::double + 3e9::double > memory * 0.75::double then 'memory' when mine + 1e9::double > disk then 'disk' end as obstacle from pair_""")
def model_obstacles(spark, sf):
    models, machines, _ = _models(spark, sf)
    both = models.join(machines, F.col("model_id") % 100 == F.col("machine_id"))
    other = (F.col("model_id") % 9 + 1) * 1e9
    return both.select("machine_id", "model_id", catalogue.obstacle(F.col("silicon"), F.col("memory"), F.col("disk"), F.col("weights"), other).alias("obstacle"))


_STATUS = """status as (select c_nationkey as scope, c_name as engine, case c_custkey % 4 when 0 then 'pageReader' when 1 then 'translator' when 2 then 'reviewer' else 'adjudicator' end as role, case when c_custkey % 7 < 3 then 'ready' else 'unavailable' end as state from customer)"""


def _status(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    role = F.when(k % 4 == 0, "pageReader").when(k % 4 == 1, "translator").when(k % 4 == 2, "reviewer").otherwise("adjudicator")
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("scope"), F.col("c_name").alias("engine"), role.alias("role"), F.when(k % 7 < 3, "ready").otherwise("unavailable").alias("state"), F.lit(None).cast("string").alias("detail"))


@_query(f"with {_STATUS} select scope, count(*) filter (state = 'ready') as n_ready, count(*) filter (state <> 'ready') as n_blocked, bool_or(state = 'ready' and role = 'pageReader') and bool_or(state = 'ready' and role in ('translator', 'reviewer')) as ready from status group by scope")
def engines_ready(spark, sf):
    s = _status(spark, sf)
    ready, blocked = brief.split_by_readiness(s)
    count = lambda df, name: df.groupBy("scope").agg(F.count("*").alias(name))
    out = brief.can_translate(s, ["scope"]).join(count(ready, "n_ready"), "scope", "left").join(count(blocked, "n_blocked"), "scope", "left")
    return out.select("scope", F.coalesce("n_ready", F.lit(0)).alias("n_ready"), F.coalesce("n_blocked", F.lit(0)).alias("n_blocked"), "ready")


@_query(f"""with {_STATUS} select engine, role, state, null as detail, true as built_in from status where scope < 10 union all select engine, role, state, null, false from status where scope >= 10
union all select case when s_suppkey % 4 = 0 then s_name else 'model ' || s_suppkey end, 'translator', case when s_suppkey % 4 = 0 then 'unavailable' else 'ready' end, case when s_suppkey % 4 = 0 then 'not an address of this machine: host' || s_suppkey || '.example.org' else '127.0.0.1:11434' end, false from supplier where s_suppkey % 3 <> 0 or s_suppkey % 4 = 0""")
def engine_statuses(spark, sf):
    s = _status(spark, sf)
    k = F.col("s_suppkey")
    servers = table(spark, sf, "supplier").select(F.col("s_name").alias("engine"), F.lit("translator").alias("role"), F.when(k % 4 == 0, F.concat(F.lit("host"), k.cast("string"), F.lit(".example.org"))).otherwise("localhost:11434").alias("authority"), F.when(k % 3 != 0, F.concat(F.lit("model "), k.cast("string"))).alias("model"))
    return brief.engine_status(s.where("scope < 10"), s.where("scope >= 10"), servers)


@_query("""select s_suppkey as id, case when s_suppkey % 2 = 0 and (s_suppkey % 3 = 0 or s_suppkey % 5 = 0 or s_suppkey % 7 = 0) then 'model' when s_suppkey % 11 <> 0 then 'machine' when s_suppkey % 2 = 0 then 'model' end as lead,
  case when s_suppkey % 2 = 0 and (s_suppkey % 3 = 0 or s_suppkey % 5 = 0 or s_suppkey % 7 = 0) then case when s_suppkey % 11 <> 0 then 'machine' end when s_suppkey % 11 <> 0 and s_suppkey % 2 = 0 then 'model' end as second from supplier""")
def engine_choice(spark, sf):
    k = F.col("s_suppkey")
    got = brief.leading_engine(k % 2 == 0, k % 11 != 0, k % 3 == 0, k % 5 != 0, k % 7 != 0)
    return table(spark, sf, "supplier").select(k.alias("id"), got["lead"].alias("lead"), got["second"].alias("second"))


@_query("""with p as (select c_custkey as id, c_custkey % 6 as k, c_name as n from customer) select id, case when k = 1 then 'plainText' else 'sameDocument' end as output_mode, case when k = 2 then false else true end as use_local_model, case when k = 3 then n else '' end as local_model, case when k = 1 then 8080 else 11434 end::int as port,
  case when k = 5 then 'openAICompatible' else 'ollama' end as dialect, case when k = 3 then n || '|x' else '' end as standing from p""")
def preferences_decoded(spark, sf):
    """Preferences from JSON of older or broken kinds: each field falls back by itself."""
    k, n = F.col("c_custkey") % 6, F.col("c_name")
    json = (
        F.when(k == 0, "{broken").when(k == 1, '{"outputMode":"plainText","serverPort":8080,"serverDialect":5}').when(k == 2, '{"useLocalModel":false,"serverPort":"8080","outputMode":"holograph"}')
        .when(k == 3, F.concat(F.lit('{"localModelID":"'), n, F.lit('","standingInstructions":["'), n, F.lit('","x"],"useLocalModel":"no"}'))).when(k == 4, "{}").otherwise('{"serverDialect":"openAICompatible","standingInstructions":"x"}')
    )
    p = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), brief.preferences(json).alias("p"))
    return p.select("id", F.col("p.outputMode").alias("output_mode"), F.col("p.useLocalModel").alias("use_local_model"), F.col("p.localModelID").alias("local_model"), F.col("p.serverPort").alias("port"), F.col("p.serverDialect").alias("dialect"), F.array_join("p.standingInstructions", "|").alias("standing"))


@_query("""with held as (select case when n % 3 = 0 then 'instruction' else 'term' end as kind, n + 1 as seq, case when n % 3 > 0 then s_name end as term, case when n % 3 = 1 then 'R' || n end as rendering, case when n % 3 = 0 then 'be ' || s_name end as text from (select s_suppkey as n, s_name from supplier)),
e as (select case p % 7 when 0 then 'remove_term' when 1 then 'remove_instruction' when 2 then 'keep' when 3 then 'render' when 4 then 'render' when 5 then 'instruct' else 'instruct' end as op, p, name from (select p_partkey as p, p_name || ' ' || p_partkey as name from part))
select kind, seq::int as seq, term, rendering, text from held h where not (kind = 'term' and exists (select 1 from e where op = 'remove_term' and h.term = 'Supplier#' || lpad((p // 2)::varchar, 9, '0'))) and not (kind = 'instruction' and exists (select 1 from e where op = 'remove_instruction' and h.seq = p))
union all select case when p % 7 = 5 then 'instruction' else 'term' end, (select max(seq) from held) + p, case when p % 7 <> 5 then name end, case when p % 7 = 3 then 'R' || p end, case when p % 7 = 5 then name end from e where p % 7 in (2, 3, 5)""")
def brief_edits(spark, sf):
    """Suppliers as what a brief holds, parts as edits of it: removed, kept, rendered, instructed, and blank ones."""
    n, p, none = F.col("s_suppkey"), F.col("p_partkey"), F.lit(None).cast("string")
    held = table(spark, sf, "supplier").select(F.when(n % 3 == 0, "instruction").otherwise("term").alias("kind"), (n + 1).cast("int").alias("seq"), F.when(n % 3 > 0, F.col("s_name")).alias("term"), F.when(n % 3 == 1, F.concat(F.lit("R"), n.cast("string"))).alias("rendering"), F.when(n % 3 == 0, F.concat(F.lit("be "), "s_name")).alias("text"))
    name, k = F.concat(F.lit(" "), "p_name", F.lit(" "), p.cast("string"), F.lit("\t")), p % 7
    op = F.element_at(F.array(*map(F.lit, ("remove_term", "remove_instruction", "keep", "render", "render", "instruct", "instruct"))), (k + 1).cast("int"))
    term = F.when(k == 0, F.concat(F.lit("Supplier#"), F.lpad(F.floor(p / 2).cast("string"), 9, "0"))).when(k.isin(2, 3, 4), name)
    edits = table(spark, sf, "part").select(op.alias("op"), p.cast("int").alias("seq"), term.alias("term"), F.when(k == 3, F.concat(F.lit("R"), p.cast("string"))).when(k == 4, F.lit(" 　")).otherwise(none).alias("rendering"), F.when(k == 5, name).when(k == 6, F.lit("\n ")).alias("text"))
    return brief.edited(held, edits)


@_query(f"""with {_FOUND}, queue_ as (select order_key % 10 as page, order_key, line_no, score, row_number() over (partition by order_key % 10 order by score, order_key, line_no) - 1 as nth, count(*) over (partition by order_key % 10) as n from scored where score < 0.85)
select page, order_key, line_no, (((page * 1000 - 3) % n + n) % n)::bigint as stepped from queue_ where nth = (page * 1000) % n""")
def queue_cursor(spark, sf):
    """The block under each page's cursor in its queue, and the cursor after three steps back."""
    s = _scored(spark, sf).where("score < 0.85").select((F.col("order_key") % 10).alias("group"), F.col("order_key").alias("page"), F.col("line_no").alias("ord"), "score")
    at = table(spark, sf, "orders").select((F.col("o_orderkey") % 10).alias("group")).distinct().withColumn("at", F.col("group") * 1000)
    got = export.queue_target(s, at, ["group"])
    return got.select(F.col("group").alias("page"), F.col("page").alias("order_key"), F.col("ord").alias("line_no"), export.stepped(F.col("at"), F.lit(-3), F.col("of")).cast("long").alias("stepped"))


# --- model servers and the ledger ------------------------------------------------------------------------------------


@_query("""select c_custkey as id, case when c_custkey % 3 = 0 then '' else c_name end as answer, case when c_custkey % 3 = 0 then '' else c_name || '|b' end as models, case when c_custkey % 3 <> 0 then case when c_custkey % 2 = 0 then 'A' else 'B' end end as snapped,
  '{"model":"m","stream":false,"messages":[{"role":"system","content":"s"},{"role":"user","content":"' || c_name || '"}],"options":{"temperature":0.0,"num_predict":512}}' as ollama,
  '{"model":"m","stream":false,"temperature":0.0,"max_tokens":512,"messages":[{"role":"system","content":"s"},{"role":"user","content":[{"type":"text","text":"' || c_name || '"}]}]}' as compatible from customer""")
def chat_json(spark, sf):
    """Requests to model servers in two dialects, and what their answers and lists of models come to."""
    c, n, bad = table(spark, sf, "customer"), F.col("c_name"), F.col("c_custkey") % 3 == 0
    even = F.col("c_custkey") % 2 == 0
    body = F.when(bad, "{broken").when(even, F.concat(F.lit('{"message":{"role":"assistant","content":"'), n, F.lit('"}}'))).otherwise(F.concat(F.lit('{"choices":[{"message":{"content":"'), n, F.lit('"}}]}')))
    told = F.when(bad, "[]").when(even, F.concat(F.lit('{"models":[{"name":"'), n, F.lit('"},{"size":1},{"name":"b"}]}'))).otherwise(F.concat(F.lit('{"data":[{"id":"'), n, F.lit('"},{"id":"b"}]}')))
    answer = F.when(even, prompts.chat_answer("ollama", body)).otherwise(prompts.chat_answer("openAICompatible", body))
    models = F.when(even, prompts.listed_models("ollama", told)).otherwise(prompts.listed_models("openAICompatible", told))
    choice = F.when(bad, profile.snapped(F.lit(" "), list(prompts.CHOICES))).when(even, profile.snapped(F.lit("<think>b?</think>(a)"), list(prompts.CHOICES))).otherwise(profile.snapped(F.lit("\nb"), list(prompts.CHOICES)))
    ask = lambda dialect: prompts.chat_request(dialect, F.lit("m"), F.lit("s"), n)
    return c.select(F.col("c_custkey").alias("id"), F.coalesce(answer, F.lit("")).alias("answer"), F.array_join(models, "|").alias("models"), choice.alias("snapped"), ask("ollama").alias("ollama"), ask("openAICompatible").alias("compatible"))


@_query(f"""with {ENTRIES} select scope, count(*) filter (purpose = 'modelWeights') as downloads, count(*) filter (purpose = 'documentWork') as document_requests, count(*) filter (outcome = 'refused') as refusals from entries group by scope""")
def ledger_slices(spark, sf):
    e = entries(spark, sf)
    count = lambda df, name: df.groupBy("scope").agg(F.count("*").alias(name))
    parts = [count(df, n) for df, n in zip(ledger.slices(e), ("downloads", "document_requests", "refusals"), strict=True)]
    out = e.select("scope").distinct()
    for p in parts:
        out = out.join(p, "scope", "left")
    return out.select("scope", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("downloads", "document_requests", "refusals")])


@_query("""with l as (select user_id, count(*) as n_lines, sum(strlen(props))::bigint as bytes_received from events group by user_id), r as (select c_custkey as request_id, case when c_custkey % 4 = 0 then 'cut off' end as error from customer)
select request_id, error, case when error is null then 'allowed' else 'refused' end as outcome, error as reason, coalesce(n_lines, 0) as n_lines, coalesce(bytes_received, 0)::bigint as bytes_received from r left join l on l.user_id = r.request_id""")
def line_outcomes(spark, sf):
    """Customers as requests, events as the lines of their answers."""
    requests = table(spark, sf, "customer").select(F.col("c_custkey").alias("request_id"), F.when(F.col("c_custkey") % 4 == 0, "cut off").alias("error"))
    return ledger.line_stream(table(spark, sf, "events").select(F.col("user_id").alias("request_id"), F.col("props").alias("line")), requests)


@_query("""with e as (select user_id as job, event_id as seq, case event_id % 8 when 0 then 'started' when 1 then 'pageStarted' when 2 then 'pageReconciled' when 6 then 'pageFinished' when 7 then case when event_id % 5 = 0 then 'finished' else 'asking' end else 'blockTranslated' end as event, (event_id % 6)::int as value, (event_id % 9 + 3)::int as of_ from events),
s as (select job, coalesce(arg_max(value, seq) filter (event = 'started'), 0) as pages, coalesce(arg_max(value, seq) filter (event = 'pageStarted'), 0) as page, coalesce(arg_max(case event when 'pageStarted' then 0 when 'pageReconciled' then value else of_ end, seq) filter (event in ('pageStarted', 'pageReconciled', 'blockTranslated')), 0) as blocks,
  coalesce(arg_max(case event when 'pageStarted' then 0 else value + 1 end, seq) filter (event in ('pageStarted', 'blockTranslated')), 0) as done, coalesce(sum(of_) filter (event = 'pageReconciled'), 0)::int as contested, bool_or(event = 'finished') as finished from e group by job)
select *, round(case when pages > 0 then least(1.0::double, (page + case when blocks > 0 then done / blocks::double else 0 end) / pages) else 0.0 end, 6) as fraction from s""")
def progress_state(spark, sf):
    """Jobs' progress after their last events."""
    n = F.col("event_id")
    event = F.when(n % 8 == 0, "started").when(n % 8 == 1, "pageStarted").when(n % 8 == 2, "pageReconciled").when(n % 8 == 6, "pageFinished").when((n % 8 == 7) & (n % 5 == 0), "finished").when(n % 8 == 7, "asking").otherwise("blockTranslated")
    e = table(spark, sf, "events").select(F.col("user_id").alias("job"), n.alias("seq"), event.alias("event"), (n % 6).cast("int").alias("value"), (n % 9 + 3).cast("int").alias("of"))
    return ledger.progress(e).withColumn("fraction", F.round("fraction", 6))


_FLOW = f"""{BLOCKS}, n as (select doc_id, max(n // 20)::int + 1 as n_pages from (select doc_id, unnest(range(len(string_split(text, chr(10))))) as n from documents) group by doc_id),
e as (select doc_id, -1 as page, 0 as stage, 0 as nth, 'started' as event, n_pages as value, 0 as of_ from n union all select doc_id, n_pages, 0, 0, 'finished', 0, 0 from n
  union all select doc_id, unnest(range(n_pages)), 0, 0, 'pageStarted', unnest(range(n_pages)), n_pages from n union all select doc_id, unnest(range(n_pages)), 4, 0, 'pageFinished', unnest(range(n_pages)), 0 from n
  union all select doc_id, page, 1, case kind when 'heading' then 0 when 'listItem' then 1 when 'pageFurniture' then 2 else 3 end, 'readerFinished', count(*), max(length(text)) from blocks group by doc_id, page, kind
  union all select n.doc_id, p.page, 2, 0, 'pageReconciled', count(b.ord), count(*) filter ((n.doc_id + b.ord) % 6 < 3) from (select doc_id, unnest(range(n_pages)) as page from n) p join n using (doc_id) left join blocks b on b.doc_id = p.doc_id and b.page = p.page group by n.doc_id, p.page
  union all select doc_id, page, 3, ord, 'blockTranslated', row_number() over (partition by doc_id, page order by ord) - 1, count(*) over (partition by doc_id, page) from blocks)"""


@_query(f"with {_FLOW} select doc_id as job, row_number() over (partition by doc_id order by page, stage, nth) - 1 as seq, event, value::int as value, of_::int as \"of\" from e")
def flow_events(spark, sf):
    """What a run over the documents tells of itself; kinds of blocks stand for readers."""
    return _flow(spark, sf)


def _flow(spark, sf) -> DataFrame:
    b = blocks(spark, sf)
    documents = lines(spark, sf).groupBy("doc_id").agg((F.max("page") + 1).alias("n_pages"))
    readings = b.groupBy("doc_id", "page", F.col("kind").alias("reader")).agg(F.count(F.lit(1)).alias("n_blocks"), F.max(F.char_length("text")).alias("seconds"))
    # readers' names in the order of the kinds
    readings = readings.withColumn("reader", F.when(F.col("reader") == "paragraph", "plain").otherwise(F.col("reader")))
    return ledger.flow_events(documents, b.withColumn("contested", (F.col("doc_id") + F.col("ord")) % 6 < 3), readings)


@_query(f"""with {_FLOW}, last as (select doc_id, max(page) as page from e where event = 'pageStarted' group by doc_id)
select l.doc_id as job, n_pages as pages, l.page::int as page, (select count(*) from blocks b where b.doc_id = l.doc_id and b.page = l.page)::int as blocks, (select count(*) from blocks b where b.doc_id = l.doc_id and b.page = l.page)::int as done, (select sum(of_) from e where e.doc_id = l.doc_id and event = 'pageReconciled')::int as contested, true as finished,
  round(least(1.0::double, (l.page + case when exists (select 1 from blocks b where b.doc_id = l.doc_id and b.page = l.page) then 1.0::double else 0.0::double end) / n_pages), 6) as fraction from last l join n using (doc_id)""")
def flow_progress(spark, sf):
    """Progress after each document's last event."""
    return ledger.progress(_flow(spark, sf)).withColumn("fraction", F.round("fraction", 6))
