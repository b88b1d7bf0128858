"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversations, decontaminate, divergence, language_id, license_scan, packing, pii, quality_rules, sharding, simhash, token_counts, token_store, url_filters
from ._text import LETTERS, LOWER, NOT_WORD, UPPER


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), pii.key_of(spark))


def op3_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(_table(spark, sf_dir, "documents"))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.read_store(*token_store.write_store(_table(spark, sf_dir, "documents")))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(_table(spark, sf_dir, "conversations")), "present")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(_table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_pii_surrogates, op3_virtual_slots, op4_simhash, op5_token_counts, op6_license_scan, op7_token_store, op8_quality_rules, op9_language_id, op10_decontaminate, op11_conversation_repair, op12_source_divergence, op13_url_filter, pipeline)}


#: Windows of all items meet windows of equal length of all documents, as lists of words.
OP10_SQL = rf"""
with d as materialized (
  select row_number() over () as row_id, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{NOT_WORD}'), lambda x: x <> '') as words from documents),
i as (select coalesce(cast(item_id as varchar), '') as item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{NOT_WORD}'), lambda x: x <> '') as words from benchmark),
sized as (select item, words, least(10, len(words)) as size from i where len(words) > 0),
item_windows as (select distinct item, size, words[p : p + size - 1] as gram from (select *, unnest(range(1, len(words) - size + 2)) as p from sized)),
windows as (select row_id, p, size, words[p : p + size - 1] as gram
  from (select row_id, words, size, unnest(range(1, len(words) - size + 2)) as p from d cross join (select distinct size from sized))),
hits as materialized (select row_id, p, w.size, item from windows w join item_windows x on w.size = x.size and w.gram = x.gram),
hit_words as (select row_id, count(distinct place) as n_hit from (select row_id, unnest(range(p, p + size)) as place from hits) group by row_id),
hit_items as (select row_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct row_id, item from hits) group by row_id)
select doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit_words using (row_id) left join hit_items using (row_id)
"""


def _op6_sql() -> str:
    """Trigrams of texts meet those of the templates as words, without hashes; diagonals, spans, their verification and the words that tell like licenses apart follow."""
    known = license_scan.templates()
    literal = lambda x: "'" + x.replace("'", "''") + "'"
    k = license_scan.K
    grams = ", ".join(f"({t}, {literal(label)}, {literal(kind)}, {len(words) - k + 1}, {p}, {', '.join(map(literal, words[p : p + k]))})" for t, label, kind, words in known for p in range(len(words) - k + 1))
    mark = " ".join(f"when {test} then {literal(name)}" for name, test in license_scan.MARKS.items())
    needs = ", ".join(f"({literal(label)}, {literal(name)}, {len(names)})" for label, names in license_scan.TELLING.items() for name in names)
    bars = ", ".join(f"({literal(label)}, {literal(name)})" for label, names in license_scan.BARRED.items() for name in names)
    return rf"""
with needs(label, mark, asked) as (values {needs}), bars(label, mark) as (values {bars}),
grams(template, label, kind, grams, place, t0, t1, t2) as (values {grams}),
d as materialized (
  select row_number() over () as row_id, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{NOT_WORD}'), lambda x: x <> '') as words from documents),
rolling as (select row_id, pos, words[pos + 1] as w0, words[pos + 2] as w1, words[pos + 3] as w2 from (select row_id, words, unnest(range(0, len(words) - 2)) as pos from d)),
lines as (
  select row_id, template, label, kind, grams, pos - place as diagonal, min(pos) as first, max(pos) as last, list(distinct place) as places
  from rolling join grams on w0 = t0 and w1 = t1 and w2 = t2 group by row_id, template, label, kind, grams, diagonal),
stepped as (select *, len(places) = grams as whole, case when diagonal - lag(diagonal) over (partition by row_id, template order by diagonal) <= {license_scan.NEAR} then 0 else 1 end as step from lines),
numbered as (select *, sum(step) over (partition by row_id, template order by diagonal) as span from stepped),
spans as (
  select row_id, label, kind, grams, min(first) as first, max(last) + {k} as behind, len(list_distinct(flatten(list(places)))) / grams as cover,
    count(*) filter (whole) as exact, min(diagonal) filter (whole) as exact_first, max(diagonal) filter (whole) as exact_last
  from numbered group by row_id, template, label, kind, grams, span),
marks as (select row_id, word, case {mark} end as mark from (select row_id, words[p + 1] as w0, words[p + 2] as w1, p as word from (select row_id, words, unnest(range(0, len(words))) as p from d))),
judged as (select *, row_number() over () as span_id, kind = 'base' and exact > 0 as base, case when kind = 'identifier' then exact > 0 else cover >= {license_scan.COVER} and behind - first <= {license_scan.STRETCH} * (grams + {k - 1}) end as verified from spans),
held as (
  select span_id from judged j join needs using (label) join marks m on m.row_id = j.row_id and m.mark = needs.mark and m.word between j.first and j.behind - 1 + case when m.mark in {license_scan.VERSIONS} then {license_scan.BEHIND} else 0 end
  where verified group by span_id having count(distinct needs.mark) = any_value(asked)),
barred as (select span_id from judged j join bars using (label) join marks m on m.row_id = j.row_id and m.mark = bars.mark and m.word between j.first and j.behind - 1),
named as (select *, verified and (kind = 'identifier' or label not in (select label from needs) or span_id in (select span_id from held) and span_id not in (select span_id from barred)) as told from judged),
of_doc as (
  select row_id, sum(exact) filter (base) as n_base, min(exact_first) filter (base) as first_word, max(exact_last) filter (base) as last_word,
    string_agg(distinct label, ',' order by label) filter (base) as base_labels, string_agg(distinct label, ',' order by label) filter (base or told) as labels, max(cover) as score
  from named group by row_id)
select doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(n_base, 0) as bigint) as n_base, cast(first_word as bigint) as first_word, cast(last_word as bigint) as last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, cast(coalesce(score, 0) as double) as score
from d left join of_doc using (row_id)
"""


def _op11_sql() -> str:
    """The same weights carried as they are, from the last row to the first: (cost, audit, repaired lines) of each grammar state, a pair of inserts tried behind each row."""
    away = "{'c': 1000000000, 's': '', 't': ''}"
    into = {0: (3, "user"), 1: (3, "user"), 2: (4, "assistant"), 3: (3, "user")}
    moves = {0: "case x.i when 's' then 2 when 'u' then 3 end", 1: "case x.i when 'u' then 3 end", 2: "case x.i when 'a' then 4 end", 3: "case x.i when 'u' then 3 end"}
    arc = lambda cost, label, line, to: f"{{'c': {cost} + acc[{to}].c, 's': '{label}' || acc[{to}].s, 't': {line} || acc[{to}].t}}"
    rows, puts = [], []
    for q in range(4):
        to, role = into[q]
        kept = f"case when x.dead or {moves[q]} is null then {away} else {arc('x.late', 'K', 'chr(10) || x.role || chr(58) || x.text', moves[q])} end"
        changed = f"case when x.dead then {away} else {arc('2 + x.late', 'R', f"chr(10) || '{role}:' || x.text", to)} end"
        rows.append(f"list_min([{arc(3, 'D', "''", q + 1)}, {kept}, {changed}])")
        puts.append(f"list_min([acc[{q + 1}], {arc(2, 'I', f"chr(10) || '{role}:'", to)}])")
    put = "{'kind': 'put', 'i': '', 'role': '', 'text': '', 'dead': false, 'late': 0}"
    return rf"""
with crc as (select list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, cast(b as bigint))) as crcs),
lots as (
  select row_number() over () as row_id, conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    xor(list_reduce(list_transform(string_split(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''), lambda c: cast(ord(c) as bigint)),
      lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 as lot
  from conversations, crc),
d as materialized (
  select row_id * 2 + copy as row_id, conv_id, turn, case when lot = 4 then 'user' else role end as role, case lot when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from (select *, unnest(case when lot = 3 then [0, 1] else [0] end) as copy from lots where lot <> 0)),
seen as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, row_id) as place, regexp_replace(text, '[ 	-
]+$', '') as bare,
    row_number() over (partition by conv_id, role, text order by turn nulls first, row_id) as again from d),
faults as (select *, case when bare = '' then 'blank' when again > 1 then 'duplicate' when right(bare, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault, left(role, 1) as i from seen),
pairs as (select *, place > 1 and lag(i) over (partition by conv_id order by place) || i not in ('su', 'ua', 'au') as odd from faults),
each as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
    count(*) filter (fault = 'truncated') as truncated, count(*) filter (odd) as illegal,
    list({{'kind': 'row', 'i': i, 'role': role, 'text': text, 'dead': fault in ('blank', 'duplicate'), 'late': case when fault = 'truncated' then 1 else 0 end}} order by place desc) as rows
  from pairs group by conv_id),
best as (
  select *, list_reduce(flatten([[{put}, {put}], flatten(list_transform(rows, lambda x: [x, {put}, {put}]))]),
    lambda acc, x: case when x.kind = 'put' then [{", ".join(puts)}] else [{", ".join(rows)}] end,
    [{{'c': 0, 's': '', 't': ''}}, {away}, {away}, {{'c': 0, 's': '', 't': ''}}])[1] as b
  from each)
select ids.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  cast(coalesce(b.c, 0) as bigint) as cost, coalesce(b.s, '') as audit, sha256(coalesce(substr(b.t, 2), '')) as repaired_sha256
from (select distinct conv_id from conversations) ids left join best on ids.conv_id is not distinct from best.conv_id
"""


#: Every kept term meets every group, and every pair of groups every term.
OP12_SQL = rf"""
with d as materialized (
  select row_number() over () as row_id, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{LETTERS}') as terms from documents),
counted as materialized (select lang, source, term, count(*) as n, count(distinct row_id) as docs from (select row_id, lang, source, unnest(terms) as term from d) group by lang, source, term),
kept as materialized (select lang, term, sum(n) as lang_n from counted group by lang, term having sum(docs) >= 10),
of_lang as (select lang, count(*) as v, sum(lang_n) as lang_total from kept group by lang),
of_source as (select lang, source, sum(n) as total from counted join kept using (lang, term) group by lang, source),
groups as (select lang, source, coalesce(total, 0) as total, coalesce(v, 0) as v, lang_total from (select distinct lang, source from d) left join of_source using (lang, source) left join of_lang using (lang)),
cells as materialized (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (total + 2 * v) as p, 1 + (1000000000 * (lang_n + 2)) // (lang_total + 2 * v) as q
  from groups g join kept k on g.lang = k.lang left join counted c on c.lang = g.lang and c.source = g.source and c.term = k.term),
pairs as (
  select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value
  from cells a join cells b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source),
every as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source
  union all select lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) from cells where n > 0 and p > q),
ranked as (select lang, source, part, item, cast(value as bigint) as value, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank from every)
select * from ranked where part = 'pair' or rank <= 10
"""


#: Rules and hosts by joins.
OP13_SQL = rf"""
with rules(action, host, path) as (values {", ".join(str(r) for r in url_filters.RULES)}),
u as materialized (
  select row_number() over () as row_id, page_id, translate(regexp_extract(coalesce(url, ''), '{url_filters.URL}', 1), '{UPPER}', '{LOWER}') as host,
    regexp_extract(coalesce(url, ''), '{url_filters.URL}', 2) as path from pages),
fitting as (
  select row_id, action, r.host || r.path as rule, row_number() over (partition by row_id order by length(r.host || r.path) desc, length(r.host) desc, action desc) as place
  from u join rules r on (u.host = r.host or ends_with(u.host, '.' || r.host)) and starts_with(u.path, r.path)),
best as (select row_id, action, rule from fitting where place = 1),
listed as (select distinct host from u join best using (row_id) where action = 'block')
select page_id, host, path, rule, coalesce(action, case when host in (from listed) then 'block' else 'allow' end) as verdict from u left join best using (row_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_license_scan": _op6_sql(), "op10_decontaminate": OP10_SQL, "op11_conversation_repair": _op11_sql(), "op12_source_divergence": OP12_SQL, "op13_url_filter": OP13_SQL}
