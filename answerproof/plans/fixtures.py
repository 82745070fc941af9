"""Texts derived from the orders table that exercise operators the qa view does not reach.

SQL that both Spark and DuckDB read; ``{orders}`` is the table.
"""

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")

# A raw generation around a qa response: as it is, behind a marker, echoing the prompt, below blanks.
RAW_GENERATION = """case id % 4
 when 0 then model_response
 when 1 then concat('Let me think.', chr(10), 'ANSWER:  ', model_response, '.', chr(10), 'That is all.')
 when 2 then concat(prompt, ' ', model_response, ' . ')
 else concat(chr(10), ' ', chr(10), '  ', model_response, chr(10), 'second line') end"""

# Spellings of a label column.
LABEL_TEXT = """case id % 7 when 0 then 'TRUE' when 1 then ' yes ' when 2 then '0' when 3 then '1.0'
 when 4 then 'Y' when 5 then null else 'false' end"""

# Powers of ten in four notations.
POWERS = """
select o_orderkey as id, case o_orderkey % 4
 when 0 then concat('about ', cast(m as varchar(20)), 'e', cast(p as varchar(20)), ' units')
 when 1 then concat(cast(m as varchar(20)), '.5 × 10^', cast(p as varchar(20)))
 when 2 then concat('(10^', cast(p as varchar(20)), ')')
 else concat('roughly 10', translate(cast(p as varchar(20)), '-0123456789', '⁻⁰¹²³⁴⁵⁶⁷⁸⁹')) end as answer
from (select o_orderkey, o_orderkey % 90 + 10 as m, o_orderkey % 13 - 3 as p from {orders}) x
"""

# Coordinates in five notations.
PLACES = """
select o_orderkey as id, case o_orderkey % 5
 when 0 then concat(cast(m as varchar(20)), '.5 S')
 when 1 then concat('at ', cast(m as varchar(20)), ' degrees north')
 when 2 then concat('-', cast(m as varchar(20)), ' West')
 when 3 then concat(cast(m as varchar(20)), '°E')
 else concat(cast(m as varchar(20)), ' metres') end as answer
from (select o_orderkey, o_orderkey % 90 as m from {orders}) x
"""

# Prompt files with odd headers: unique ids, repeated ids, ids that are no numbers, fractional ids.
PROMPT_FILES = """
select concat('data/prompts_set', cast(o_custkey % 4 as varchar(20)), '.csv') as source,
 o_orderkey as __position, o_orderpriority as "Topic",
 case o_custkey % 4 when 0 then cast(o_orderkey as varchar(20))
  when 1 then cast(cast(floor(o_orderkey / 2) as bigint) as varchar(20))
  when 2 then concat('q', cast(o_orderkey as varchar(20)))
  else concat(' ', cast(o_orderkey as varchar(20)), '.9 ') end as "QID",
 case when o_orderkey % 10 = 3 then '  ' else concat('What of order ', cast(o_orderkey as varchar(20)), '?') end as "Question",
 o_orderstatus as "Gold"
from {orders}
""".replace('"', "`")

# Generations that list two questions: fenced, bare JSON, JSON in prose, numbered lines.
GENERATIONS = """
select o_orderkey as id, case o_orderkey % 5
 when 0 then concat('```json', chr(10), '["Who is ', cast(o_custkey as varchar(20)), '?", "Why   not ', cast(o_orderkey as varchar(20)), '?"]', chr(10), '```')
 when 1 then concat('["Who is ', cast(o_custkey as varchar(20)), '?", 7, null, {{"a": "b"}}, "  ", "Why not ', cast(o_orderkey as varchar(20)), '?"]')
 when 2 then concat('Sure! ["Who is ', cast(o_custkey as varchar(20)), '?", "Why not ', cast(o_orderkey as varchar(20)), '?"] Enjoy [them].')
 when 3 then concat('1. Who is ', cast(o_custkey as varchar(20)), '?,', chr(10), '[', chr(10), '  2)  Why  not ', cast(o_orderkey as varchar(20)), '?', chr(10), '],')
 else concat('```', chr(10), '[["x"], "Who is ', cast(o_custkey as varchar(20)), '?", "Why not ', cast(o_orderkey as varchar(20)), '?"]```') end as generation
from {orders}
"""

# Questions per seed with many repeats; one seed asks most of them.
ASKED = """
select case when o_custkey % 3 > 0 then 'common' else concat('seed', cast(o_custkey % 60 as varchar(20))) end as seed,
 concat(' Question ', cast(o_custkey % 211 as varchar(20)), case when o_orderkey % 2 = 0 then ' ' else '' end) as question,
 o_orderkey as position
from {orders}
"""

# Three ballots per question and noise in their spelling.
VOTES = """
select concat('q', cast(cast(floor(o_orderkey / 3) as bigint) as varchar(20))) as question, o_orderkey % 3 as vote_no,
 case o_custkey % 4 when 0 then 'Paris.' when 1 then concat('  paris ', chr(10), 'because')
  when 2 then concat('New   ', o_orderstatus, ' . ') else ' ' end as answer
from {orders}
"""

# Coordinates south of the equator as answers, and five kinds of responses.
COORDINATES = """
select o_orderkey as id, concat(cast(m as varchar(20)), '.5 S') as correct_answer, case o_orderkey % 5
 when 0 then concat(cast(m as varchar(20)), '.5 S')
 when 1 then concat(cast(m as varchar(20)), '.5 N')
 when 2 then concat('-', cast(m as varchar(20)), '.5')
 when 3 then concat('-', cast(m as varchar(20)), '.5 or ', cast(m as varchar(20)), '.9')
 else 'somewhere warm' end as model_response
from (select o_orderkey, o_orderkey % 90 as m from {orders}) x
"""

# Phrases of several words or with signs, some in other case than the prompts.
PHRASES = ("which customer", "PLACED ORDER", "rounded down, did", "in which nation", "live?", "order 1", "customer which")
