"""The SQL that DuckDB checks the queries with. Written apart from the Spark side, from the definitions.

round6() and round_score() are the rounding rules that both sides use: six digits after a nudge that settles ties, and
three digits of the double's exact value for scores that thresholds are applied to, once it is cut to twelve digits.
"""

from __future__ import annotations

from .. import lexicons as L


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(items: list[str]) -> str:
    return "[" + ", ".join(text(i) for i in items) + "]"


def round6(x: str) -> str:
    return f"round({x} + 1e-9, 6)"


def round_score(x: str, digits: int = 3) -> str:
    return f"cast(printf('%.{digits}f', cast(cast({x} as decimal(20, 12)) as double)) as double)"


DOCUMENTS = "select doc_id, 1 as paragraph_index, 'Untitled' as section, '' as subsection, text from documents"
CONVERSATIONS = "select conv_id as doc_id, cast(turn as integer) as paragraph_index, 'Untitled' as section, '' as subsection, text from conversations"
BY_ROLE = "select conv_id as doc_id, cast(turn as integer) as paragraph_index, role as section, '' as subsection, text from conversations"

AB = "|".join(a.replace(".", r"\.") for a in L.ABBREVIATIONS)
SLUG = "coalesce(nullif(trim(regexp_replace(lower(section), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'untitled')"


def split(source: str, name: str, keep: str) -> str:
    """CTEs that end in `name`: the columns `keep` of source, pos (from 0) and s, sentences of 25 characters or more."""
    return f"""
{name}_1 as (select *, trim(regexp_replace(text, '\\s+', ' ', 'g')) as t from ({source})),
{name}_2 as (select * replace (regexp_replace(t, '(^|[^A-Za-z.])((?i:{AB}))([.!?])', '\\1\\2' || chr(2) || '\\3' || chr(3), 'g') as t) from {name}_1),
{name}_3 as (select * replace (regexp_replace(t, '([.!?])([ "'')\\]]|$)', '\\1' || chr(1) || '\\2', 'g') as t) from {name}_2),
{name}_4 as (select {keep}, list_filter(list_transform(string_split(replace(replace(t, chr(2), ''), chr(3), ''), chr(1)), lambda x: trim(x)), lambda x: len(x) > 0) as l from {name}_3),
{name} as (select * from (select {keep}, unnest(range(len(l))) as pos, unnest(l) as s from {name}_4) where len(s) >= 25)"""


def sentences(source: str) -> str:
    """sent: doc_id, paragraph_index, section, subsection, sentence_index, ord, text, paragraph_id, sentence_id, tok."""
    return f"""{split(source, "cut", "doc_id, paragraph_index, section, subsection")},
sent_1 as (select doc_id, paragraph_index, section, subsection, cast(pos + 1 as integer) as sentence_index,
  cast(row_number() over (partition by doc_id order by paragraph_index, pos) - 1 as integer) as ord, s as text,
  {SLUG} || '.par_' || printf('%03d', paragraph_index) as paragraph_id, regexp_extract_all(lower(s), '[a-z0-9'']+') as tok from cut),
sent as (select *, paragraph_id || '.sent_' || printf('%03d', sentence_index) as sentence_id from sent_1)"""


def count_in(items: list[str]) -> str:
    return f"len(list_filter(tok, lambda x: list_contains({words(items)}, x)))"


def _share(items: list[str]) -> str:
    return f"case when len(tok) > 0 then {count_in(items)}::double / len(tok) else 0.0 end"


FEATURES = f"""
feat_1 as (select *, cast(len(tok) as integer) as length, case when len(tok) > 0 then 1.0 - {count_in(L.STOPWORDS)}::double / len(tok) else 0.0 end as content_ratio,
  {_share(L.ABSTRACT_WORDS)} as abstract_ratio, {_share(L.VAGUE_WORDS)} as vague, len(tok) > 0 and list_contains({words(L.DISCOURSE_MARKERS)}, tok[1]) as discourse,
  [len(text) - len(replace(text, m, '')) for m in [',', ';', ':', '(', ')']] as marks from sent),
feat_2 as (select *, list_sum(marks) as n_marks, case when len(tok) > 0 then least(1.0, greatest(0.0, 1.3 * abstract_ratio + 0.6 * greatest(0.0, 0.7 - content_ratio) + least(0.35, 1.8 * vague))) else 0.0 end as low_specificity from feat_1),
feat as (select *, case when n_marks > 0 then coalesce(list_sum([-(m / n_marks) * log2(m / n_marks) for m in marks if m > 0]), 0.0) else 0.0 end as entropy,
  case when len(tok) > 0 then least(1.0, greatest(0.0, 0.25 * (1.0 - content_ratio) + 0.25 * abstract_ratio + 0.35 * low_specificity + case when discourse then 0.15 else 0.0 end + case when len(tok) >= 18 then 0.1 else 0.0 end)) else 0.0 end as thinness from feat_2)"""

STYLE = """
near as (select a.doc_id, a.ord, count(*) as n, avg(b.length) as l, avg(b.content_ratio) as c, avg(b.entropy) as e,
    (var_pop(b.length) * count(*) + count(*) * power(avg(b.length) - any_value(a.length), 2) / (count(*) + 1)) / (count(*) + 1) as v
  from feat a join feat b on a.doc_id = b.doc_id and b.ord between a.ord - 2 and a.ord + 2 and b.ord <> a.ord group by a.doc_id, a.ord),
style as (select f.*, case when n is null then 0.0 else least(1.0, sqrt(power(length - l, 2) + power(content_ratio - c, 2) + power(entropy - e, 2)) / 18.0) end as style_shift,
  case when n is null then 0.0 else greatest(0.0, least(1.0, 1.0 - least(v / 40.0, 1.0))) end as smoothness from feat f left join near using (doc_id, ord))"""


def _hits(category: str) -> str:
    return f"list_filter({words(sorted(L.PHRASES[category]))}, lambda p: contains(lower(text), p))"


def _half(category: str) -> str:
    return f"least(1.0, len({category}_h) / 2.0)"


PHRASES = f"""
hit_1 as (select *, {", ".join(f"{_hits(c)} as {c}_h" for c in L.PHRASES)} from style),
hit_2 as (select *, list_sort(list_distinct(flatten([{", ".join(f"{c}_h" for c in L.PHRASES)}]))) as phrases,
  list_sort(list_distinct(list_filter([{", ".join(f"case when len({c}_h) > 0 then {text(L.CANONICAL[c])} end" for c in L.PHRASES)}], lambda x: x is not null))) as categories,
  {_half("empty_transition")} as empty_transition, {_half("framework_boilerplate")} as framework_boilerplate,
  greatest({_half("unsupported_confidence")}, {_half("novelty_inflation")}) as unsupported_confidence, {_half("balanced_but_empty_summary")} as balanced_summary from hit_1),
hit as (select *, least(1.0, len(phrases) / 3.0) as phrase_score from hit_2),
told as (select *, least(1.0, greatest(0.0, 0.5 * phrase_score + 0.3 * thinness + 0.2 * style_shift)) as classifier,
  list_sort([{{'n': -x.v, 'label': x.k, 'v': x.v}} for x in [{{'k': 'empty_transition', 'v': empty_transition}}, {{'k': 'framework_boilerplate', 'v': framework_boilerplate}}, {{'k': 'unsupported_confidence', 'v': unsupported_confidence}}, {{'k': 'balanced_summary', 'v': balanced_summary}}, {{'k': 'low_specificity', 'v': low_specificity}}]]) as ranked from hit),
rhet as (select *, least(1.0, greatest(0.0, 0.35 * phrase_score + 0.25 * thinness + 0.20 * style_shift + 0.10 * smoothness + 0.10 * classifier)) as rhetoric,
  array_to_string([x.label || '=' || printf('%.2f', x.v) for x in case when ranked[1].v >= 0.25 then list_filter(ranked, lambda r: r.v >= 0.25) else list_filter(ranked[1:1], lambda r: r.v > 0) end], '|') as finding_summary from told)"""


def _grams(tok: str, n: int, by: str) -> str:
    return f"list_transform(range(1, len({tok}) - {n - 2}), lambda i: array_to_string({tok}[i:i + {n - 1}], {text(by)}))"


def plain(col: str) -> str:
    return f"regexp_extract_all(lower({col}), '[a-z0-9]+')"


def grams(tok: str) -> str:
    """Distinct word 3- to 5-grams of a column of five plain tokens or more."""
    return f"case when len({tok}) >= 5 then list_distinct(list_concat({_grams(tok, 3, ' ')}, {_grams(tok, 4, ' ')}, {_grams(tok, 5, ' ')})) else [] end"


FEATURE_LIST = f"list_concat(tok, {_grams('tok', 2, '_')}, {_grams('tok', 3, '_')})"

CORPUS = f"""{split("select item_id, printf('%010d', item_id) as path, text from benchmark", "ccut", "item_id, path")},
corp as (select row_number() over (order by path, pos) - 1 as cid, path, cast(item_id as varchar) as label, s, regexp_extract_all(lower(s), '[a-z0-9'']+') as tok from ccut),
csize as (select count(*)::double as n from corp),
cf as (select cid, len(f) as total, unnest(f) as feature from (select cid, {FEATURE_LIST} as f from corp)),
ctf as (select cid, feature, count(*)::double / any_value(total) as tf from cf group by cid, feature),
fdf as (select feature, count(*) as df from ctf group by feature),
cw_1 as (select cid, feature, tf * (ln((1.0::double + n) / (1 + df)) + 1) as w from ctf join fdf using (feature), csize),
cw as (select cid, feature, w / sqrt(sum(w * w) over (partition by cid)) as w from cw_1),
cg_1 as (select cid, {plain("s")} as ptok from corp),
cg as (select cid, {grams("ptok")} as grams from cg_1),
pdf as (select phrase, count(*) as df from (select unnest(grams) as phrase from cg) group by phrase)"""


def long_tokens(tok: str) -> str:
    return f"list_distinct(list_filter({tok}, lambda x: len(x) > 2))"


MATCHES = f"""
uniq as (select row_number() over () as q, text, any_value(tok) as tok from sent group by text),
qf as (select q, len(f) as total, unnest(f) as feature from (select q, {FEATURE_LIST} as f from uniq)),
qtf as (select q, feature, count(*)::double / any_value(total) as tf from qf group by q, feature),
qw_1 as (select q, feature, tf * (ln((1.0::double + n) / (1 + coalesce(df, 0))) + 1) as w from qtf left join fdf using (feature), csize),
qw as (select q, feature, w / sqrt(sum(w * w) over (partition by q)) as w from qw_1),
cosines as (select q, cid, sum(qw.w * cw.w) as cosine from qw join cw using (feature) group by q, cid),
best as (select * from (select *, row_number() over (partition by q order by round(cosine, 12) desc, cid) as rank from cosines) where rank <= 3),
ug_1 as (select q, {plain("text")} as ptok from uniq),
ug as (select q, {grams("ptok")} as grams from ug_1),
pair_1 as (select b.q, b.rank, b.cid, least(b.cosine, 1.0) as cosine, c.path, c.label, c.s as matched_text, u.text,
  {long_tokens("u.tok")} as x, {long_tokens("c.tok")} as y, list_intersect(ug.grams, cg.grams) as shared from best b join uniq u using (q) join corp c using (cid) join ug using (q) join cg using (cid)),
pair_2 as (select *, case when len(x) >= 5 and len(y) >= 5 then len(list_intersect(x, y))::double / greatest(1, len(list_distinct(list_concat(x, y)))) else 0.0 end as lexical from pair_1),
rare as (select q, rank, max(0.5 * (1.0 - least(1.0, coalesce(df, 1) / n)) + 0.5 * least(1.0, len(string_split(phrase, ' ')) / 5.0)) as rare
  from (select q, rank, unnest(shared) as phrase from pair_2) left join pdf using (phrase), csize group by q, rank),
pair as (select pair_2.*, coalesce(r.rare, 0.0) as rare, list_transform(list_sort(list_transform(shared, lambda p: {{'n': -len(p), 'p': p}})), lambda s: s.p)[1:5] as shown from pair_2 left join rare r using (q, rank)),
evid as (select q, max(cosine) as vector, max(lexical) as lexical, max(rare) as rare, min_by(label, rank) as match_label, min_by(matched_text, rank) as match_text from pair group by q),
over_1 as (select u.text, coalesce(vector, 0.0) as vector, coalesce(lexical, 0.0) as lexical, coalesce(rare, 0.0) as rare, match_label, match_text,
  least(0.35, 4.0 * ({" + ".join(f"contains(lower(text), {text(p)})::integer" for p in L.BOILERPLATE)}) / greatest(1, len(tok))) as discount from uniq u left join evid using (q)),
overl as (select *, least(1.0, greatest(0.0, 0.45 * vector + 0.25 * lexical + 0.25 * rare - 0.15 * discount)) as overlap from over_1)"""

FACT = f"fact as (select * from rhet join overl using (text))"
REVIEW = f"""
rev_1 as (select *, {round_score("overlap")} as overlap_risk, {round_score("rhetoric")} as rhetoric_risk, match_label is not null and vector > 0 as has_match, len(phrases) > 0 as has_trigger from fact),
rev as (select *, greatest(overlap_risk, rhetoric_risk) as combined_risk, overlap_risk >= 0.6 or rhetoric_risk >= 0.6 as is_flagged from rev_1),
para as (select doc_id, paragraph_id, any_value(paragraph_index) as paragraph_index, min_by(section, sentence_index) as section, max(combined_risk) as combined_risk, max(overlap_risk) as overlap_risk, max(rhetoric_risk) as rhetoric_risk,
  count(*) as sentence_count, bool_or(has_match) as has_match, bool_or(has_trigger) as has_trigger, bool_or(is_flagged) as is_flagged, string_agg(text, ' ' order by sentence_index) as display_text from rev group by doc_id, paragraph_id),
isl as (select *, paragraph_index - row_number() over (partition by doc_id, section order by paragraph_index) as island from para where combined_risk >= 0.45 or has_match or has_trigger),
span_1 as (select doc_id, section, min(paragraph_index) as start_paragraph, max(paragraph_index) as end_paragraph, max(combined_risk) as max_combined_risk, max(overlap_risk) as max_overlap_risk, max(rhetoric_risk) as max_rhetoric_risk,
  cast(count_if(is_flagged) as bigint) as flagged_count, count(*) as paragraph_count from isl group by doc_id, section, island),
span as (select * from (select *, cast(row_number() over (partition by doc_id order by start_paragraph) as integer) as position from span_1) where position <= 24)"""


def rhetoric(source: str) -> str:
    return f"{sentences(source)}, {FEATURES}, {STYLE}, {PHRASES}"


def facts(source: str) -> str:
    return f"{rhetoric(source)}, {CORPUS}, {MATCHES}, {FACT}"


def reviews(source: str) -> str:
    return f"{facts(source)}, {REVIEW}"


def band(x: str) -> str:
    return f"case when {x} >= 0.75 then 'high' when {x} >= 0.45 then 'medium' else 'low' end"


REASON = """case when overlap_risk >= 0.6 and rhetoric_risk >= 0.6 then 'Review required for overlap and AI-assisted tell signals.' when overlap_risk >= 0.6 then 'Review required for elevated overlap evidence.'
  when rhetoric_risk >= 0.6 then 'Review required for elevated AI-assisted tell signals.' when has_match then 'External match evidence is available for review.' when has_trigger then 'AI-assisted tell triggers are available for review.' else 'No elevated review flag.' end"""

SUMMARY = """case when overlap >= 0.6 and match_label is not null then 'Elevated overlap signal with strongest local match in ' || match_label || '.'
  when rhetoric >= 0.6 and len(phrases) > 0 then 'Elevated AI-assisted tell signal with triggers such as ' || array_to_string(phrases[1:2], ', ') || '.' when finding_summary <> '' then 'AI-assisted tell evidence available: ' || finding_summary || '.'
  when match_label is not null then 'Overlap evidence available from ' || match_label || ' for reviewer inspection.' when len(phrases) > 0 then 'AI-assisted tell triggers detected: ' || array_to_string(phrases[1:2], ', ') || '.' else 'Lower-signal sentence; review only if needed in context.' end"""
