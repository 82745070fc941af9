"""The same queries in SQL for DuckDB, written independently of the Spark expressions.

The fixture texts are ASCII unless noted, so plain lower-casing stands in for Unicode normalisation,
and numbers are found by splitting on spaces (the engine's patterns have no lookaround).
"""

from __future__ import annotations

from answerproof.config import (
    ANSWER_STOPWORDS,
    KEYWORD_STOPWORDS,
    UNAVAILABILITY_CUES,
)
from answerproof.operators.schema import INSTRUCTION
from answerproof.plans import fixtures, views

QA = views.plain_sql(views.QA)
NLI = views.plain_sql(views.NLI)
REVIEW = views.plain_sql(views.REVIEW)


def _quoted(word: str) -> str:
    return "'" + word.replace("'", "''") + "'"


def _in(words: tuple[str, ...]) -> str:
    return "(" + ", ".join(map(_quoted, words)) + ")"


def _can(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[^a-z0-9_\\-./^+:=]+', ' ', 'g'))"


def _toks(c: str) -> str:
    return f"case when {c} = '' then [] else string_split({c}, ' ') end"


def _content(toks: str) -> str:
    number = r"[+-]?(nan|inf|infinity|([0-9]+(_[0-9]+)*[.]?([0-9]+(_[0-9]+)*)?|[.][0-9]+(_[0-9]+)*)(e[+-]?[0-9]+)?)"
    return (
        f"list_filter({toks}, lambda t: t not in {_in(ANSWER_STOPWORDS)} and length(t) >= 2 "
        f"and not regexp_full_match(t, '{number}'))"
    )


def _same(x: str, g: str) -> str:
    return (
        f"case when {x} = round({x}) and {g} = round({g}) and (abs({x}) >= 100 or abs({g}) >= 100) "
        f"then {x} = {g} else abs({x} - {g}) <= greatest(0.005 * greatest(abs({x}), abs({g})), 0.05) end"
    )


def _signals(qa: str = "qa") -> str:
    """CTEs s0..s4 over a relation with model_response and correct_answer."""
    cues = " or ".join(f"contains(' ' || r || ' ', {_quoted(' ' + c + ' ')})" for c in UNAVAILABILITY_CUES)
    numbers = (
        "list_transform(list_filter({t}, lambda t: regexp_full_match(t, '[+-]?[0-9]+([.][0-9]+)?')),"
        " lambda t: cast(t as double))"
    )
    return f"""
s0 as (select *, {_can('model_response')} as r, {_can('correct_answer')} as g from {qa}),
s1 as (select *, {_toks('r')} as rt, {_toks('g')} as gt,
  regexp_matches(g, '[0-9]') and not regexp_matches(g, '[^0-9 .\\-+^/e]') as gold_numeric from s0),
s2 as (select *, case when gold_numeric then {numbers.format(t='gt')}[1] end as gn,
  case when gold_numeric then {numbers.format(t='rt')} else [] end as rn,
  {_content('rt')} as rc, {_content('gt')} as gc from s1),
s3 as (select *, r = g as exact, r <> '' and g <> '' and contains(r, g) as substr,
  case when len(rt) = 0 and len(gt) = 0 then 1.0 when len(rt) = 0 or len(gt) = 0 then 0.0
   else len(list_intersect(rt, gt)) / cast(len(list_distinct(list_concat(rt, gt))) as double) end as jaccard,
  length(g) >= 4 and length(r) <= 5000 and case len(gt) when 0 then false
   when 1 then list_contains(rt, gt[1])
   when 2 then list_contains(rt, gt[1]) and list_contains(rt[list_position(rt, gt[1]) + 1:], gt[2])
   else null end as subseq,
  coalesce(case when gold_numeric then {_same('rn[1]', 'gn')} end, false) as num_ok,
  gold_numeric and len(rn) > 0 and len(list_filter(rn, lambda x: {_same('x', 'gn')})) = 0 as num_conflict,
  case when gold_numeric and len(rn) >= 2 and regexp_matches(' ' || r || ' ', ' (or|either) ')
   then list_filter(rn, lambda x: not ({_same('x', 'gn')})) else [] end as alts,
  r <> '' and g <> '' and (regexp_matches(r, '\\b(not|isn''t|isnt|no)\\s+' || regexp_escape(g) || '\\b')
   or regexp_matches(r, '\\b' || regexp_escape(g) || '\\s+(is|was|are|were)\\s+(not|no)\\b')) as negated,
  r <> '' and ({cues}) as unavailable,
  g <> '' and length(g) <= 48 and len(gt) <= 2
   and (not contains(trim(correct_answer), ' ') or len(gc) = len(gt)) as atomic,
  len(list_intersect(rc, gc)) as shared from s2),
s4 as (select *, unavailable and not substr and not exact and not num_ok as unavail_conflict,
  atomic and len(rt) <= 5 and not exact and not substr and not num_ok and shared = 0 as mismatch from s3)"""


def _decide(nli: str = "false", support: str = "false", score: str = "null", cut: float = 0.72) -> str:
    """CTE s5: the decision over s4."""
    return f"""
s5 as (select *, {score} as score,
 case when r = '' then 'empty_response' when negated then 'contradiction_cue'
  when {nli} then 'nli_contradiction_veto' when len(alts) > 0 then 'numeric_alternative_conflict'
  when num_conflict then 'numeric_conflict'
  when unavail_conflict then 'unavailability_claim_conflicts_with_gold'
  when mismatch then 'atomic_entity_mismatch' end as bad,
 case when exact then 'exact_match' when num_ok then 'numeric_match' when substr then 'substring_match'
  when subseq then 'token_subsequence_match' when {support} then 'embedding_support'
  else 'no_contradiction_evidence' end as good from s4),
decided as (select *, bad is not null as hallucinated, bad is null as accepted, coalesce(bad, good) as reason,
 r <> '' and exact as baseline_exact,
 r <> '' and case when score is null then jaccard >= 0.4 else score >= {cut} end as baseline_embed,
 case when r <> '' then coalesce(score, jaccard) end as baseline_embed_score,
 case when r = '' then 'none' when score is null then 'jaccard' else 'embedding' end as baseline_embed_method
 from s5)"""


DECISION = (
    "select id, hallucinated, accepted, reason, baseline_exact, baseline_embed, "
    "round(baseline_embed_score, 9) as baseline_embed_score, baseline_embed_method from decided"
)

WITH_SIGNALS = f"with qa as ({QA}), {_signals()}"
WITH_DECISION = f"{WITH_SIGNALS}, {_decide()}"
LABELLED = f"""{WITH_DECISION}, labelled as (select * replace (
 case when trim(model_response) = '' then false else hallucinated end as hallucinated) from decided)"""

NUMBERED = f"""with qa as ({QA}), vecs as (select vec_id, embedding from embeddings),
pairs as (select q.*, list_transform(u.embedding, lambda x: cast(x as double)) as u,
  list_transform(v.embedding, lambda x: cast(x as double)) as v
 from (select *, id % (select count(*) from vecs) as rv, (id * 7) % (select count(*) from vecs) as gv from qa) q
 join vecs u on q.rv = u.vec_id join vecs v on q.gv = v.vec_id),
cosines as (select * exclude (u, v), list_dot_product(u, v) / (sqrt(list_dot_product(u, u)) * sqrt(list_dot_product(v, v))) as cosine from pairs)"""
LEAST = f"""nli as ({NLI}), least_nli as (select id, min(entailment) as ent, max(contradiction) as con from nli group by id)"""

WORDS = f"""list_filter(regexp_extract_all(lower({{c}}), '[\\p{{{{L}}}}\\p{{{{N}}}}_]+'),
 lambda t: regexp_full_match(t, '[a-z]{{{{2,}}}}') and t not in {_in(KEYWORD_STOPWORDS)})"""


def _words(c: str) -> str:
    return WORDS.format(c=c).replace("{{", "{").replace("}}", "}")


def _keywords(rows: str, key: str, text: str, label: str) -> str:
    """CTEs ending in top10 (keyword, weight) over a relation of rows."""
    return f"""
exploded as (select {key} as k, {label} as label, unnest({_words(text)}) as term from {rows}),
tf as (select k, label, term, count(*) as tf from exploded group by all),
vocab as (select term, sum(tf) as total, count(*) as df from tf group by term order by total desc, term limit 50),
docs as (select count(*) as n, count(*) filter (where {label}) as pos from {rows}),
cells as (select k, term, tf * (ln((1.0 + n) / (1 + df)) + 1) as w from tf join vocab using (term), docs where label),
norms as (select k, sqrt(sum(w * w)) as norm from cells group by k),
top10 as (select term as keyword, coalesce(sum(w / norm), 0.0) / max(pos) as weight
 from vocab left join cells using (term) left join norms using (k), docs
 where pos > 0 group by term order by round(weight, 12) desc, keyword limit 10),
hits as (select distinct k, label, term as keyword from tf)"""


KEYWORD_RATES = """select keyword, avg(cast(label as double)) as hallucination_rate, count(*) as n
 from hits join top10 using (keyword) group by keyword"""

TOXIC = "select d.doc_id, d.text, coalesce(l.toxic = 1, false) as toxic from documents d left join labels l using (doc_id)"

FILES = f"""files as (select *, 'responses_labeled_' || lpad(cast(cluster_id % 50 as varchar), 2, '0') || '.csv' as source_file
 from review)"""
COUNTED = """counted as (select source_file, count(*) filter (where detector_hallucinated) as positives,
 count(*) filter (where not detector_hallucinated) as negatives from files group by source_file),
running as (select *, cast(coalesce(sum(positives) over before, 0) as bigint) as positives_before,
 cast(coalesce(sum(negatives) over before, 0) as bigint) as negatives_before from counted
 window before as (order by source_file rows between unbounded preceding and 1 preceding)),
pool as (select * from running where positives_before < 800 or negatives_before < 800)"""
WITH_POOL = f"with review as ({REVIEW}), {FILES}, {COUNTED}"



def _balanced(rows: str, n: int) -> str:
    """CTEs ending in drawn: half of each stratum, the shortfall of one made up by the other."""
    half, rest = n // 2, n - n // 2
    return f"""
avail as (select count(*) filter (where detector_hallucinated) as pos, count(*) filter (where not detector_hallucinated) as neg from {rows}),
quota as (select case when pos < {half} or neg >= {rest} then least(pos, {half}) else least(pos, {n} - neg) end as n_pos,
 case when neg < {rest} or pos >= {half} then least(neg, {rest}) else least(neg, {n} - pos) end as n_neg from avail),
picked as (select *, row_number() over (partition by detector_hallucinated order by md5('1337|' || cast(id as varchar))) as rn from {rows}),
drawn as (select p.* from picked p, quota where rn <= case when detector_hallucinated then n_pos else n_neg end)"""


PLAN = """plan as (select category, positives, negatives, audited_negatives,
 cast(audited_negatives as double) / negatives as p_negative from (
 select *, greatest(least(negatives, cast(ceil((positives + negatives) * 0.3) as bigint) - positives), 0) as audited_negatives from (
 select category, count(*) filter (where detector_hallucinated) as positives,
  count(*) filter (where not detector_hallucinated) as negatives from review group by category)))"""
AUDITED = """ranked as (select *, row_number() over (partition by category, detector_hallucinated
  order by md5('42|' || cast(id as varchar))) as rn from review),
audited as (select r.* exclude (rn), case when detector_hallucinated then 1.0 else 1.0 / p_negative end as weight
 from ranked r join plan using (category) where detector_hallucinated or rn <= audited_negatives)"""
WITH_AUDIT = f"with review as (select *, rater_a as final_label from ({REVIEW})), {PLAN}, {AUDITED}"

QUALITY = """case when tp + fp > 0 then tp / cast(tp + fp as double) end as precision,
 case when tp + fn > 0 then tp / cast(tp + fn as double) end as recall,
 case when 2 * tp + fp + fn > 0 then 2 * tp / cast(2 * tp + fp + fn as double) end as f1,
 case when tn + fp > 0 then tn / cast(tn + fp as double) end as specificity,
 case when tn + fp > 0 then fp / cast(tn + fp as double) end as fpr"""


def _cells(measure: str) -> str:
    hit = "final_label = 'contradiction'"
    return ", ".join(
        measure.format(f"{d} detector_hallucinated and {c} ({hit})") + f" as {name}"
        for name, d, c in (("tp", "", ""), ("fp", "", "not"), ("fn", "not", ""), ("tn", "not", "not"))
    )


GROUP = "case when grouping(category) = 1 then 'ALL' else category end as \"group\""
COUNT_CELLS = _cells("count(*) filter (where {})")
SUM_CELLS = _cells("sum(case when {} then weight else 0.0 end)")


def _kappa(a: str, b: str) -> str:
    return f"""with review as ({REVIEW}),
rows as (select category as grp, {a} as a, {b} as b from review union all select 'ALL', {a}, {b} from review),
n as (select grp, count(*) as n, count(*) filter (where a = b) as agree from rows group by grp),
ma as (select grp, a as l, count(*) as na from rows group by all),
mb as (select grp, b as l, count(*) as nb from rows group by all),
chance as (select grp, sum(cast(na as double) * nb) as c from ma join mb using (grp, l) group by grp)
select grp as "group", n, agree, agree / cast(n as double) as agreement,
 case when coalesce(c, 0) / (cast(n as double) * n) < 1 then
  round((agree / cast(n as double) - coalesce(c, 0) / (cast(n as double) * n)) / (1 - coalesce(c, 0) / (cast(n as double) * n)), 9) end as kappa
from n left join chance using (grp)"""


def _uniform(text: str) -> str:
    return f"cast(cast('0x' || substr(md5({text}), 1, 13) as bigint) as double) / 4503599627370496.0"


CLEANED = r"regexp_replace(trim(regexp_extract(trim({0}, chr(10) || ' '), '^[^\n]*')), '[.\s]+$', '')"


ORACLES: dict[str, str] = {
    "canonical_pairs": f"""with qa as ({QA}) select id, {_can('model_response')} as normalized_response,
 {_can('correct_answer')} as normalized_correct_answer from qa""",
    # accented Latin letters: removing accents is all that normalisation does to them
    "canonical_documents": r"""with c as (select doc_id,
 trim(regexp_replace(lower(strip_accents(text)), '[^\p{L}\p{N}_\-./^+:=]+', ' ', 'g')) as can from documents)
select doc_id, md5(can) as digest, cast(length(can) as int) as n_chars,
 cast(case when can = '' then 0 else len(string_split(can, ' ')) end as int) as n_tokens from c""",
    "lexical_signals": f"""{WITH_SIGNALS} select id, exact as baseline_exact, substr as normalized_substring,
 subseq as token_subsequence, round(jaccard, 9) as jaccard, cast(shared as int) as shared_content from s4""",
    "cue_signals": f"""{WITH_SIGNALS} select id, negated as contradiction_heuristic,
 unavailable as unavailability_claim, unavail_conflict as unavailability_conflict from s4""",
    "atomic_signals": f"{WITH_SIGNALS} select id, atomic as atomic_gold, mismatch as atomic_mismatch from s4",
    "numeric_signals": f"""{WITH_SIGNALS} select id, gn as gold_number, rn[1] as first_number,
 cast(len(rn) as int) as n_numbers, num_ok as numeric_match from s4""",
    "numeric_conflicts": f"""{WITH_SIGNALS} select id, case when r <> '' then num_conflict end as numeric_conflict,
 case when r = '' or not gold_numeric then null when len(rn) = 0 then 'no_response_numbers'
  else 'numbers_present' end as mode from s4""",
    "numeric_alternatives": f"""{WITH_SIGNALS} select id, len(alts) > 0 as alternative_conflict,
 cast(len(alts) as int) as n_differing, alts[1] as first_differing from s4""",
    "scientific_values": """with x as (select o_orderkey as id, o_orderkey % 90 + 10 as m, o_orderkey % 13 - 3 as p,
  o_orderkey % 4 as v from orders),
y as (select id, v, p, round(case v when 0 then m * power(10.0::double, p) when 1 then (m + 0.5::double) * power(10.0::double, p)
  else power(10.0::double, p) end, 9) as scientific, m from x)
-- besides the value itself, the digits count again where they stand free: none in 12e3; after a minus or
-- a caret, the exponent and the 10 do
select id, scientific, cast(case v when 0 then 1 + (case when p < 0 then 1 else 0 end) when 1 then 4 else 3 end as int) as n_numbers from y""",
    "coordinate_values": """select o_orderkey as id, case o_orderkey % 5 when 0 then -(o_orderkey % 90 + 0.5::double)
 when 1 then cast(o_orderkey % 90 as double) when 2 then -cast(o_orderkey % 90 as double)
 when 3 then cast(o_orderkey % 90 as double) end as degrees from orders""",
    "label_pairs": f"{WITH_DECISION} {DECISION}",
    "flag_pairs": f"{WITH_DECISION} select id, hallucinated from decided",
    "weak_signals": f"""{WITH_DECISION} select id,
 case when bad is null then cast(subseq as int) + cast(jaccard >= 0.4 as int) + cast(baseline_embed as int) end as weak_passes,
 case when bad is null then 2 end as weak_required from decided""",
    "reason_counts": f"""{WITH_DECISION} select reason, hallucinated, count(*) as n from decided
 group by reason, hallucinated""",
    "label_responses": f"""with base as ({QA}),
qa as (select * replace (case when trim(model_response) = '' then (case when id % 4 = 3 then 'second line' else '' end)
  else trim(model_response) end as model_response) from base), {_signals()}, {_decide()}
select model as run, template, id, prompt, model_response, correct_answer,
 case when trim(model_response) = '' then false else hallucinated end as hallucinated, baseline_exact, baseline_embed,
 round(baseline_embed_score, 9) as baseline_embed_score, baseline_embed_method, reason as reasoning from decided""",
    "pair_cosine": f"{NUMBERED} select id, round(cosine, 9) as embed_score from cosines",
    "baseline_similarity": f"""{NUMBERED}, half as (select * replace (case when id % 3 > 0 then cosine end as cosine) from cosines),
{_signals('half')}, {_decide(score='cosine', cut=0.1)} select id, baseline_embed,
 round(baseline_embed_score, 9) as baseline_embed_score, baseline_embed_method from decided""",
    "embedding_support": f"""{NUMBERED}, {_signals('cosines')},
{_decide(score='cosine', cut=0.1, support='cosine >= 0.1 and len(gt) > 1 and shared >= 1')}
select id, case when r = '' then null when len(gt) <= 1 then 'gold_too_short' when shared < 1 then 'insufficient_shared_content' end as embedding_gate,
 case when r <> '' then cosine >= 0.1 and len(gt) > 1 and shared >= 1 end as embedding_match, reason from decided""",
    "nli_veto": f"""{WITH_SIGNALS}, {LEAST}, j as (select *, r <> '' and len(rt) >= 3 and len(gt) >= 3 as ok from s4 join least_nli using (id))
select id, case when ok then round(ent, 9) end as nli_entail_min, case when ok then round(con, 9) end as nli_contradiction_max,
 case when r <> '' then ok and con >= 0.75 and ent <= 0.3 end as nli_contradiction_veto from j""",
    "label_with_scores": f"""{NUMBERED}, {LEAST}, scored as (select * from cosines join least_nli using (id)),
{_signals('scored')}, {_decide(nli='len(rt) >= 3 and len(gt) >= 3 and con >= 0.75 and ent <= 0.3', score='cosine', support='cosine >= 0.72 and len(gt) > 1 and shared >= 1')}
{DECISION}""",
    "missing_scores": f"""{WITH_SIGNALS}, {LEAST}, j as (select s4.model, r <> '' and len(rt) >= 3 and len(gt) >= 3 as ok, l.ent
 from s4 left join (select * from least_nli where id % 5 > 0) l using (id))
select model, count(*) filter (where ok) as eligible, count(*) filter (where ok and ent is null) as missing from j group by model""",
    "scorer_hook": f"""with qa as ({QA}), c as (select id, length({_can('model_response')}) as a, length({_can('correct_answer')}) as b from qa)
select id, round(least(a, b) / cast(greatest(a, b, 1) as double), 9) as embed_score from c""",
    "normalize_prompts": f"""with raw as ({fixtures.PROMPT_FILES.replace('`', '"').format(orders='orders')}),
ids as (select source, __position, "Topic" as template, "Question" as prompt, "Gold" as correct_answer,
 case when regexp_matches("QID", '[a-z]') then 0 else cast(trunc(cast(trim("QID") as double)) as bigint) end as id
 from raw where trim("Question") <> ''),
dup as (select distinct source from (select source, id from ids group by source, id having count(*) > 1))
select source, template, case when source in (select source from dup)
  then row_number() over (partition by source order by __position) else id end as id, prompt, correct_answer from ids""",
    "sequential_ids": f"""with raw as ({fixtures.PROMPT_FILES.replace('`', '"').format(orders='orders')}),
ids as (select source, regexp_extract(source, 'prompts_(.*)[.]csv', 1) as template,
 row_number() over (partition by source order by __position) as id, "Question" as prompt, "Gold" as correct_answer from raw)
select * from ids where trim(prompt) <> ''""",
    "wrap_prompts": f"""with qa as ({QA}) select id, concat({_quoted(INSTRUCTION)}, 'Question: ', prompt, chr(10), 'Answer:') as wrapped_prompt from qa""",
    "clean_responses": f"""with qa as ({QA}) select id, case when trim(model_response) = ''
  then (case when id % 4 = 3 then 'second line' else '' end) else trim(model_response) end as model_response from qa""",
    "clean_conversations": f"""select a.conv_id, a.turn, case when starts_with(first, p.text) then
  regexp_replace(trim(substr(first, length(p.text) + 1)), '[.\\s]+$', '') else regexp_replace(first, '[.\\s]+$', '') end as model_response
 from (select *, trim(regexp_extract(trim(text, chr(10) || ' '), '^[^\\n]*')) as first from conversations where role = 'assistant') a
 left join (select * from conversations where role = 'user') p on a.conv_id = p.conv_id and a.turn = p.turn + 1""",
    "attach_generations": f"""with qa as ({QA}) select model as run, id, case when id % 11 > 0 then model_response end as model_response_raw
 from qa where model not in (select model from qa where model = 'm3' and id % 100 = 1 and id % 11 > 0)""",
    "one_to_one_violations": f"""with review as ({REVIEW}) select category, cluster_id, count(*) as rows from review
 group by category, cluster_id having count(*) > 1""",
    "features": f"""with qa as (select * replace ({fixtures.LABEL_TEXT} is not null and lower(trim({fixtures.LABEL_TEXT})) in ('true', '1', 'yes', 'y') as model)
 from ({QA}))
select id, cast(length(prompt) as int) as prompt_length,
 cast(case when model_response = '' then 3 else length(model_response) end as int) as response_length,
 model as hallucinated, cast(not model as int) as is_correct from qa""",
    "validate_prompts": f"""with qa as ({QA}) select bool_or(trim(prompt) <> '') as ok,
 case when bool_or(trim(prompt) <> '') then 'ok' else 'every prompt is blank' end as message from qa""",
    "prompt_files": f"with qa as ({QA}) select template, id, prompt, correct_answer from qa",
    "labelled_files": f"""{LABELLED} select id, template, prompt, nullif(model_response, '') as model_response, correct_answer,
 hallucinated, reason as reasoning, cast(length(model_response) as int) as response_length from labelled""",
    "rate_overall": f"""{LABELLED} select avg(cast(hallucinated as double)) as hallucination_rate,
 count(*) filter (where hallucinated) as hallucinations, count(*) as n from labelled""",
    "rate_by_model": f"""{LABELLED} select model, avg(cast(hallucinated as double)) as hallucination_rate,
 count(*) filter (where hallucinated) as hallucinations, count(*) as n from labelled group by model""",
    "rate_by_template": f"""{LABELLED} select template, avg(cast(hallucinated as double)) as hallucination_rate
 from labelled group by template""",
    "rate_grouping_sets": f"""{LABELLED}, runs as (select *, model || '_r' || cast(id % 3 as varchar) as run, template as category from labelled)
select model, run, category, avg(cast(hallucinated as double)) as hallucination_rate,
 count(*) filter (where hallucinated) as hallucinations, count(*) as n,
 case grouping(model, run, category) when 0 then 'category' when 1 then 'run' else 'model' end as level
from runs group by grouping sets ((model, run, category), (model, run), (model))""",
    "coverage": f"""{LABELLED} select model, count(*) as n, count(*) filter (where trim(model_response) <> '') as answered,
 avg(cast(trim(model_response) <> '' as double)) as coverage, avg(cast(hallucinated as double)) as hallucination_rate,
 avg(cast(hallucinated as double)) filter (where trim(model_response) <> '') as rate_if_answered from labelled group by model""",
    "length_correlation": f"""{LABELLED}, f as (select id, 'prompt_length' as x, cast(length(prompt) as double) as v from labelled
 union all select id, 'response_length', cast(length(model_response) as double) from labelled
 union all select id, 'hallucinated', cast(hallucinated as double) from labelled)
select a.x as x, b.x as y, round(corr(a.v, b.v), 9) as r from f a join f b using (id) group by a.x, b.x""",
    "template_extremes": f"""{LABELLED}, g as (select model, template, avg(cast(hallucinated as double)) as hallucination_rate,
 count(*) filter (where hallucinated) as hallucinations, count(*) as n from labelled group by model, template),
k as (select *, cast(row_number() over (partition by model order by hallucination_rate desc, template) as int) as rank_high,
 cast(row_number() over (partition by model order by hallucination_rate, template) as int) as rank_low from g)
select * from k where rank_high <= 2 or rank_low <= 2""",
    "tfidf_keywords": f"""{LABELLED}, {_keywords('labelled', 'id', 'prompt', 'hallucinated')}
select keyword, round(weight, 9) as weight from top10""",
    "rate_by_keyword": f"{LABELLED}, {_keywords('labelled', 'id', 'prompt', 'hallucinated')} {KEYWORD_RATES}",
    "tfidf_documents": f"""with docs_in as ({TOXIC}), {_keywords('docs_in', 'doc_id', 'text', 'toxic')}
select keyword, round(weight, 9) as weight from top10""",
    "rate_by_keyword_documents": f"with docs_in as ({TOXIC}), {_keywords('docs_in', 'doc_id', 'text', 'toxic')} {KEYWORD_RATES}",
    "strata_counts": f"{WITH_POOL} select * from counted",
    "file_pool": f"{WITH_POOL} select * from pool",
    "balanced_audit_sample": f"""{WITH_POOL}, drawn_from as (select f.* from files f join pool using (source_file)),
{_balanced('drawn_from', 800)} select source_file, id, detector_hallucinated, '' as human_hallucinated, '' as human_notes from drawn""",
    "audit_set": f"""{LABELLED}, review as (select id, cluster_id, template, prompt, correct_answer, model_response,
  hallucinated as detector_hallucinated from labelled), {FILES}, {COUNTED},
drawn_from as (select f.* from files f join pool using (source_file)), {_balanced('drawn_from', 800)}
select source_file, template, id, prompt, correct_answer, model_response, detector_hallucinated,
 '' as human_hallucinated, '' as human_notes from drawn""",
    "lopsided_audit_sample": f"""with review as (select * replace (id % 401 = 0 as detector_hallucinated) from ({REVIEW})),
{_balanced('review', 800)} select id, detector_hallucinated from drawn""",
    "sample_per_stratum": f"""with review as ({REVIEW}), p as (select *, row_number() over (partition by category
 order by md5('1337|' || cast(id as varchar))) as rn from review) select category, id from p where rn <= 50""",
    "sampling_plan": f"{WITH_AUDIT} select * from plan",
    "audit_weights": f"{WITH_AUDIT} select id, category, detector_hallucinated, round(weight, 9) as weight from audited",
    "sampling_design": f"""{WITH_AUDIT},
f as (select category, count(*) filter (where detector_hallucinated) as frame_positives,
 count(*) filter (where not detector_hallucinated) as frame_negatives, count(distinct cluster_id) as frame_prompts from review group by category),
a as (select category, count(*) filter (where detector_hallucinated) as audited_positives,
 count(*) filter (where not detector_hallucinated) as audited_negatives, count(distinct cluster_id) as audited_prompts from audited group by category)
select *, audited_negatives / cast(frame_negatives as double) as p_negative from f join a using (category)""",
    "audit_composition": f"""{WITH_AUDIT}, told as (select *, id % 13 > 0 and detector_hallucinated as told,
 case when category = '5-LOW' then 'other' else category end as shown from audited)
select 'm' || cast(cluster_id % 4 as varchar) as model, """
    + ", ".join(
        f"concat(count(*) filter (where shown = '{c}' and told), '/', "
        f"count(*) filter (where shown = '{c}' and not told)) as \"{c}\""
        for c in (*fixtures.PRIORITIES[:4], "other")
    )
    + " from told group by 1",
    "reason_attribution": f"{WITH_DECISION} select reason, "
    + ", ".join(f"count(*) filter (where template = '{c}') as \"{c}\"" for c in fixtures.PRIORITIES)
    + ", count(*) as total from decided where hallucinated group by reason",
    "confusion_rollup": f"""{WITH_AUDIT}, c as (select {GROUP}, count(*) as n, {COUNT_CELLS} from review group by rollup(category))
select *, {QUALITY} from c""",
    "weighted_confusion": f"""{WITH_AUDIT}, c as (select {GROUP}, count(*) as n, {SUM_CELLS} from audited group by rollup(category)),
q as (select *, {QUALITY} from c)
select "group", n, """
    + ", ".join(
        f"round({c}, 6) as {c}"
        for c in ("tp", "fp", "fn", "tn", "precision", "recall", "f1", "specificity", "fpr")
    )
    + " from q",
    "wilson_recall": f"""{WITH_AUDIT}, c as (select {GROUP}, {COUNT_CELLS} from review group by rollup(category)),
k as (select "group", tp as k, tp + fn as n, cast(tp as double) / (tp + fn) as p, 1.959963984540054::double as z from c)
select "group", k, n, p as recall,
 round(greatest(0, (p + z*z/(2*n) - z*sqrt(p*(1-p)/n + z*z/(4.0::double*n*n))) / (1 + z*z/n)), 9) as wilson_low,
 round(least(1, (p + z*z/(2*n) + z*sqrt(p*(1-p)/n + z*z/(4.0::double*n*n))) / (1 + z*z/n)), 9) as wilson_high from k""",
    "kappa_multiclass": _kappa("rater_a", "rater_b"),
    "kappa_binary": _kappa("rater_a = 'contradiction'", "rater_b = 'contradiction'"),
    "audit_structure": f"""{WITH_AUDIT} select {GROUP}, count(*) as n, count(distinct cluster_id) as prompts,
 count(distinct concat(cluster_id, '/', rater_a)) as pairs, count(*) filter (where detector_hallucinated) as positives
 from review group by rollup(category)""",
    "error_labels": f"""{WITH_AUDIT} select case when detector_hallucinated then 'false_positive' else 'false_negative' end as error,
 final_label as label, count(*) as n from review where detector_hallucinated <> (final_label = 'contradiction') group by 1, 2""",
    "bootstrap_rate_ci": f"""{LABELLED}, g as (select model, count(*) filter (where hallucinated) as k, count(*) as n from labelled group by model),
u as (select model, {_uniform("'7|' || model || '|' || cast(r as varchar)")} as u from g, range(1, 1001) t(r)),
o as (select model, u, row_number() over (partition by model order by u) as rk from u),
b as (select model, max(u) filter (where rk = 26) as lo, max(u) filter (where rk = 975) as hi from o group by model),
s as (select model, k, n, unnest(range(0, n + 1)) as s from g),
l as (select *, sum(case when s = 0 then 0.0 else ln((n - s + 1) * k / (s * (n - k)::double)) end)
  over (partition by model order by s) as lg from s),
p as (select *, exp(lg - max(lg) over (partition by model)) as p from l),
c as (select *, sum(p) over (partition by model order by s) / sum(p) over (partition by model) as cdf from p)
select model, k / n::double as hallucination_rate, k as hallucinations, n,
 min(s) filter (where cdf >= lo) / n::double as ci_low, min(s) filter (where cdf >= hi) / n::double as ci_high,
 1000 as bootstrap_samples, 7 as bootstrap_seed from c join b using (model) group by model, k, n""",
    "cluster_profiles": f"""{WITH_AUDIT}, cl as (select category, cluster_id, 0.0 as fp, 0.0 as neg from review
 union all select category, cluster_id, case when detector_hallucinated then weight else 0.0 end, weight
 from audited where final_label <> 'contradiction'),
s as (select category, cluster_id, round(sum(fp), 6) as fp, round(sum(neg), 6) as neg from cl group by all)
select category, fp, neg, count(*) as clusters from s group by all""",
    "resize_down": """with k as (select *, row_number() over (order by md5('42|' || cast(o_orderkey as varchar))) as id from orders)
select o_orderpriority as template, concat('order ', o_orderkey) as prompt, id from k where id <= (select count(*) // 2 from orders)""",
    "resize_up": f"""with k as (select *, row_number() over (order by o_orderkey) as rn from orders), n as (select count(*) as n from orders),
slots as (select id, case when id <= n then id else cast(floor({_uniform("'42|extra|' || cast(id as varchar)")} * n) as bigint) + 1 end as rn
 from n, (select unnest(range(1, (select n * 3 // 2 + 1 from n))) as id))
select o_orderpriority as template, concat('order ', o_orderkey) as prompt, id from slots join k using (rn)""",
    "harvest_questions": """with q as (select o_orderkey as id, concat('Who is ', o_custkey, '?') as a,
 concat('Why not ', o_orderkey, '?') as b, o_orderkey % 5 as v from orders)
select id, 0 as question_no, case when v = 3 then a else a end as question from q
union all select id, 1, b from q""",
    "harvest_conversations": r"""with l as (select conv_id, turn, unnest(list_filter(list_transform(string_split(text, chr(10)),
  lambda x: trim(regexp_replace(trim(regexp_replace(rtrim(x, ','), '\s+', ' ', 'g')), '^\d+[.)]\s*', ''))),
  lambda x: x <> '')) as question, generate_subscripts(list_filter(list_transform(string_split(text, chr(10)),
  lambda x: trim(regexp_replace(trim(regexp_replace(rtrim(x, ','), '\s+', ' ', 'g')), '^\d+[.)]\s*', ''))),
  lambda x: x <> ''), 1) as i from conversations where role = 'assistant')
select conv_id, turn, cast(i - 1 as int) as question_no, question from l""",
    "dedupe_questions": f"""with asked as ({fixtures.ASKED.format(orders='orders')}),
f as (select seed, trim(question) as question, min(position) as position from asked group by 1, 2),
k as (select *, cast(row_number() over (partition by seed order by position) as int) as question_no from f)
select seed, question, position, question_no from k where question_no <= 40""",
    "incomplete_seeds": f"""with asked as ({fixtures.ASKED.format(orders='orders')})
select seed, count(distinct nullif(trim(question), '')) as found, 40 as expected from asked group by seed having count(distinct nullif(trim(question), '')) < 40""",
    "blank_answers": f"""with votes as ({fixtures.VOTES.format(orders='orders')})
select question, vote_no from votes where trim(answer) = ''""",
    "majority_vote": f"""with votes as ({fixtures.VOTES.format(orders='orders')}),
v as (select question, vote_no, lower(regexp_replace(trim(regexp_replace(regexp_extract(trim(answer, ' ' || chr(10)), '^[^\\n]*'), '\\s+', ' ', 'g')), '[.\\s]+$', '')) as a from votes),
c as (select question, a, count(*) as votes, min(vote_no) as first from v where a <> '' group by question, a),
k as (select *, sum(votes) over (partition by question) as ballots,
  row_number() over (partition by question order by votes desc, first) as rn from c)
select question, a as answer, votes, cast(ballots as bigint) as ballots from k where rn = 1""",
    "stream_running_rates": f"""{LABELLED} select model, avg(cast(hallucinated as double)) as hallucination_rate,
 count(*) filter (where hallucinated) as hallucinations, count(*) as n from labelled group by model""",
}

STORE_SCORES = f"""{WITH_SIGNALS}, lengths as (select *, length(r) as lr, length(g) as lg, r <> '' and len(rt) >= 3 and len(gt) >= 3 as ok from s4),
cons as (select *, (lr * 37 + lg * 11) % 101 / 100.0::double as cf, (lg * 37 + lr * 11) % 101 / 100.0::double as cr from lengths),
probs as (select *, (1 - cf) * ((lr * 53 + lg * 7) % 101 / 100.0::double) as ef, (1 - cr) * ((lg * 53 + lr * 7) % 101 / 100.0::double) as er from cons),
vetoed as (select *, ok and greatest(cf, cr) >= 0.75 and least(ef, er) <= 0.3 as veto from probs)"""

ORACLES["score_store"] = f"""{STORE_SCORES},
{_decide(nli='veto').replace('from s4)', 'from vetoed)')},
n as (select count(distinct (r, g)) filter (where id % 3 = 0) as n_part, count(distinct (r, g)) as n_all
 from vetoed where ok and not negated),
kept as (select distinct r as kr, g as kg from vetoed where ok and not negated)
select id, reason, case when r <> '' then ok and kr is not null and veto end as nli_contradiction_veto,
 case when kr is not null then round(ef, 9) end as nli_entailment, case when kr is not null then round(cf, 9) end as nli_contradiction,
 case when kr is not null then round(er, 9) end as nli_entailment_reverse, case when kr is not null then round(cr, 9) end as nli_contradiction_reverse,
 n_part as scored_1, n_all - n_part as scored_2, cast(0 as bigint) as scored_3
from decided left join kept on r = kr and g = kg, n"""

ORACLES["flags_from_store"] = f"""{STORE_SCORES},
{_decide(nli='veto').replace('from s4)', 'from vetoed)')},
n as (select count(distinct (r, g)) as scored from vetoed where ok and not negated and len(alts) = 0 and not num_conflict
 and not unavail_conflict and not mismatch)
select id, hallucinated, scored from decided, n"""



def _grid(name: str, values: tuple[float, ...], measure: str, positive: str) -> str:
    """One comparison of every row with every value of a grid."""
    grid = ", ".join(f"({v!r}::double)" for v in values)
    return f"""select model, '{name}' as threshold, t as value, '{measure}' as measure, count(*) as n,
 count(*) filter (where {positive}) as positives, count(*) filter (where {positive}) / count(*)::double as rate
 from flags, (values {grid}) g(t) group by model, t"""


VETO = "r <> '' and len(rt) >= 3 and len(gt) >= 3 and con >= {} and ent <= {}"
SWEEPS = (
    ("nli_contradiction_veto", (0.0, 0.25, 0.5, 0.6, 0.7, 0.75, 0.8, 0.9, 0.95, 1.0), "hallucinated", f"by_rule or {VETO.format('t', 0.3)}"),
    ("nli_entailment_veto_floor", (0.0, 0.1, 0.2, 0.3, 0.5, 0.9), "hallucinated", f"by_rule or {VETO.format(0.75, 't')}"),
    ("embed_min_similarity", (-0.2, 0.0, 0.1, 0.2, 0.5, 0.72), "baseline_embed",
     "r <> '' and case when c is null then jaccard >= 0.4 else c >= t end"),
    ("embed_min_similarity", (-0.2, 0.0, 0.1, 0.2, 0.5, 0.72), "embedding_support",
     f"not by_rule and not ({VETO.format(0.75, 0.3)}) and good = 'no_contradiction_evidence' and coalesce(c >= t, false) and len(gt) > 1 and shared >= 1"),
    ("jaccard_min", (0.0, 0.1, 0.2, 0.25, 0.4, 0.5, 1.0), "baseline_embed",
     "r <> '' and case when c is null then jaccard >= t else c >= 0.72 end"),
)
ORACLES["threshold_sweep"] = f"""{NUMBERED}, {LEAST},
scored as (select * exclude (cosine), case when id % 3 > 0 then round(cosine, 9) end as c from cosines join least_nli using (id)),
{_signals('scored')}, {_decide()}, flags as (select *, bad is not null as by_rule from decided)
""" + " union all ".join(_grid(*x) for x in SWEEPS)

ORACLES["coordinate_signals"] = """with x as (select o_orderkey as id, o_orderkey % 5 as v, o_orderkey % 90 + 0.5::double as deg from orders)
select id, v in (0, 2, 3) as numeric_match, -deg as gold,
 case v when 0 then -deg when 1 then deg when 2 then -deg when 3 then -deg end as resp,
 v in (0, 1) as conflict, v = 3 as alternatives, cast(case v when 3 then 1 else 0 end as int) as n_differing,
 case v when 0 then 'numeric_conflict' when 1 then 'numeric_conflict' when 2 then 'numeric_match'
  when 3 then 'numeric_alternative_conflict' else 'no_contradiction_evidence' end as reason from x"""
ORACLES["label_pairs_of_a_model"] = f"{WITH_DECISION} {DECISION} where model = 'm1' and id % 2 = 0 and hallucinated"
ORACLES["attach_keyed_generations"] = f"""with qa as ({QA})
select model as run, template as source, id, case when id % 11 > 0 then model_response end as model_response_raw from qa"""
ORACLES["audit_files"] = ORACLES["audit_set"]
ORACLES["processed_files"] = f"""{LABELLED} select prompt, model_response, cast(not hallucinated as int) as is_correct, hallucinated from labelled"""
FEATURES = ("dollars", "customer", "nation", "order", "placed", "absent")
ORACLES["sparse_correlation"] = (
    f"""{LABELLED}, f as (select id, 'prompt_length' as x, cast(length(prompt) as double) as v from labelled
 union all select id, 'response_length', cast(length(model_response) as double) from labelled
 union all select id, 'hallucinated', cast(hallucinated as double) from labelled"""
    + "".join(
        f" union all select id, 'contains_{t}', cast(regexp_matches(lower(prompt), '\\b{t}\\b') as double) from labelled"
        for t in FEATURES
    )
    + """),
m as (select x from f group by x having min(v) < max(v)),
p as (select a.x as x, b.x as y, corr(a.v, b.v) as r from f a join f b using (id) where a.x in (from m) and b.x in (from m) group by a.x, b.x),
names as (select distinct x from f)
select a.x as x, b.x as y, round(p.r, 9) as r from names a cross join names b left join p on p.x = a.x and p.y = b.x"""
)
ORACLES["rate_by_phrase"] = f"""{LABELLED}, k as (select unnest([{", ".join(map(_quoted, fixtures.PHRASES))}]) as keyword)
select keyword, avg(cast(hallucinated as double)) as hallucination_rate, count(*) as n
from labelled join k on regexp_matches(prompt, '(?i)' || case when regexp_matches(keyword, '^\\w') then '\\b' else '\\B' end
 || regexp_escape(keyword) || case when regexp_matches(keyword, '\\w$') then '\\b' else '\\b' end) group by keyword"""

ORACLES["metric_files"] = ORACLES["bootstrap_rate_ci"]


def _stirling(x: str) -> str:
    return f"((1 / 12.0::double - (1 / 360.0::double - 1 / 1260.0::double / (({x} + 1) ** 2)) / (({x} + 1) ** 2)) / ({x} + 1))"


def _cluster_bootstrap(replicates: int, height: int) -> str:
    """The splits level by level; a level above the highest number has one node that passes all to the left.

    Means below ten look their uniform number up in a table of the distribution, others take the first of
    sixteen proposals that transformed rejection accepts.
    """
    levels = []
    for h in range(height, 0, -1):
        text = f"'42|' || j.category || '|' || cast(replicate as varchar) || '|{h}|' || cast(no as varchar)"
        second = f"cast(cast('0x' || substr(md5({text} || '|' || cast(i as varchar)), 14, 13) as bigint) as double) / 4503599627370496.0"
        levels.append(f"""
w{h} as (select category, no >> {h} as no, sum(clusters) as below,
  sum(case when (no >> {h - 1}) % 2 = 0 then clusters else 0 end) as lft from numbered group by all),
i{h} as (select d.*, lft, below, least(lft, below - lft) as small, least(lft, below - lft) / below::double as p
  from d{h} d join w{h} w on d.category = w.category and d.no = w.no),
j{h} as (select *, n::double as x, n * p as mean, sqrt(n * p * (1 - p)) as sd, p / (1 - p) as odds from i{h}),
k{h} as (select distinct n, p from j{h} where p > 0 and mean < 10),
s{h} as (select n, p, unnest(range(0, cast(least(n, 150) as bigint) + 1)) as s from k{h}),
g{h} as (select *, sum(case when s = 0 then n * ln(1 - p) else ln((n - s + 1) * p / (s * (1 - p))) end) over (partition by n, p order by s) as lg from s{h}),
c{h} as (select n, p, s, sum(exp(lg)) over (partition by n, p order by s) as cdf from g{h}),
u{h} as (select *, {_uniform(text + " || '|0'")} as u from j{h} j where p > 0 and mean < 10),
v{h} as (select u.category, replicate, no, coalesce(c.s, u.n) as k from u{h} u asof left join c{h} c on u.n = c.n and u.p = c.p and u.u <= c.cdf),
e{h} as (select j.*, i, {_uniform(text + " || '|' || cast(i as varchar)")} - 0.5 as u, {second} as w, 1.15 + 2.53 * sd as b from j{h} j, range(1, 17) t(i) where p > 0 and mean >= 10),
f{h} as (select *, 0.5 - abs(u) as us, -0.0873 + 0.0248 * b + 0.01 * p as a, floor((x + 1) * p) as m from e{h}),
p{h} as (select *, floor((2 * a / us + b) * u + mean + 0.5) as k from f{h}),
a{h} as (select category, replicate, no, cast(arg_min(k, i) as bigint) as k from p{h} where us >= 0.07 and w <= 0.92 - 4.2 / b
  or case when k < 0 or k > x then false else ln(w * (2.83 + 5.1 / b) * sd / (a / (us * us) + b)) <=
  (m + 0.5) * ln((m + 1) / (odds * (x - m + 1))) + (x + 1) * ln((x - m + 1) / (x - k + 1)) + (k + 0.5) * ln(odds * (x - k + 1) / (k + 1))
  + {_stirling('m')} + {_stirling('(x - m)')} - {_stirling('k')} - {_stirling('(x - k)')} end group by all),
q{h} as (select category, replicate, no, 0 as k from j{h} where p = 0 union all select * from v{h} union all select * from a{h}),
t{h} as (select category, replicate, no, n, case when lft <= below - lft then k else n - k end as l from j{h} join q{h} using (category, replicate, no)),
d{h - 1} as (select category, replicate, no * 2 as no, l as n from t{h} where l > 0
 union all select category, replicate, no * 2 + 1, n - l from t{h} where n > l)""")
    low, high = (replicates * 25) // 1000 + 1, (replicates * 975) // 1000
    return f"""{WITH_AUDIT}, cl as (select category, cluster_id, 0.0 as fp, 0.0 as neg from review
 union all select category, cluster_id, case when detector_hallucinated then weight else 0.0 end, weight
 from audited where final_label <> 'contradiction'),
sm as (select category, cluster_id, round(sum(fp), 9) as fp, round(sum(neg), 9) as neg from cl group by all),
profiles as (select category, fp, neg, count(*) as clusters from sm group by all),
numbered as (select *, row_number() over (partition by category order by
 md5('0|' || cast(cast(fp as decimal(38,9)) as varchar) || '|' || cast(cast(neg as decimal(38,9)) as varchar))) - 1 as no from profiles),
d{height} as (select category, replicate, 0 as no, sum(clusters) as n from numbered, range({replicates}) t(replicate) group by all),
{",".join(levels)},
drawn as (select category, replicate, sum(n * fp) as fp, sum(n * neg) as neg from d0 join numbered using (category, no) group by all
 union all select category, -1, sum(clusters * fp), sum(clusters * neg) from numbered group by all),
rates as (select category as g, replicate, fp / nullif(neg, 0) as rate from drawn
 union all select 'ALL', replicate, sum(fp) / nullif(sum(neg), 0) from drawn group by replicate),
o as (select *, row_number() over (partition by g, replicate < 0 order by rate, replicate) as rk from rates),
b as (select g, max(rate) filter (where replicate < 0) as fpr, max(rate) filter (where replicate >= 0 and rk = {low}) as ci_low,
 max(rate) filter (where replicate >= 0 and rk = {high}) as ci_high from o group by g)
select g as "group", round(fpr, 9) as fpr, round(ci_low, 9) as ci_low, round(ci_high, 9) as ci_high, round(1 - fpr, 9) as specificity,
 round(1 - ci_high, 9) as specificity_low, round(1 - ci_low, 9) as specificity_high from b"""


ORACLES["cluster_bootstrap_fpr"] = _cluster_bootstrap(2000, 8)
