"""SQL that says the same as the queries, for another engine."""

from __future__ import annotations

from functools import partial

from .. import lexicon as lx
from ..functions.checks import OUTCOMES
from ..functions.notes import DOCUMENTS, PAIR_REASONS, STATES
from . import name_sql
from .people import CITIES, COUNTRIES, EVENTS, GIVEN, NAMES, OTHERS, STEPS, STREETS, SURNAMES, ZONE_FAMILY, ZONE_GIVEN
from .registry import RULES
from .people import family_name as spark_family_name
from .people import name_text as spark_name_text

TODAY = "2026-07-21"
family_name = partial(spark_family_name, array="([{}])[{}]", div="//")
name_text = partial(spark_name_text, array="([{}])[{}]", div="//")


def sql_list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_pick = lambda values, at: f"({sql_list(values)})[({at}) % {len(values)} + 1]"
_date = lambda n: f"(cast(1950 + ({n}) % 50 as varchar) || '-' || lpad(cast(1 + ({n}) % 12 as varchar), 2, '0') || '-' || lpad(cast(1 + ({n}) % 28 as varchar), 2, '0'))"
_number = lambda k: f"lpad(cast(({k}) * 7919 % 1000000000 as varchar), 9, '0')"
#: Persons as the library derives them, each with what its travel zone says: z_num, z_born, z_exp, z_sex, z_land, latin.
_persons = f"""p0 as (select c_custkey as query_id, case when c_custkey % 97 = 5 then null when c_custkey % 97 = 6 then ' ' else {name_text('c_custkey', NAMES, 0)} end as fullName,
    case when c_custkey % 11 != 0 then {_date('c_custkey')} end as dob, {_pick(('M', 'F', ''), 'c_custkey')} as sex,
    {_pick(COUNTRIES, 'c_custkey')} as nationality, {_pick(('passport', 'national_id', 'drivers_license'), 'c_custkey')} as docType,
    if(c_custkey % 53 = 7, '12-X', {_number('c_custkey')}) as docNumber, cast(2020 + c_custkey % 15 as varchar) || '-06-30' as expiry,
    {_pick(COUNTRIES, 'c_custkey')} as country,
    cast(c_custkey % 90 + 1 as varchar) || ' ' || {_pick(STREETS, 'c_custkey')} || ', ' || {_pick(CITIES, 'c_custkey * 3')} as address,
    left({_pick(ZONE_FAMILY, 'c_custkey * 7')} || ' ' || upper({family_name('c_custkey', 0)}) || '<<' || {_pick(ZONE_GIVEN, 'c_custkey * 7')}, 39) as zone_name from customer),
    p as (select *, if(query_id % 10 = 3, {_number('query_id + 1')}, {_number('query_id')}) as z_num, {_date('query_id')} as z_born, expiry as z_exp, nullif(sex, '') as z_sex,
        if(country in ('SY', 'EG', 'JO', 'IL'), country, 'UTO') as z_land, split_part(zone_name, '<<', 2) || ' ' || split_part(zone_name, '<<', 1) as latin from p0)"""
_israeli = lambda c, t: f"({c} = 'IL' and {t} in ('national_id', 'drivers_license'))"
_luhn = lambda n: f"(list_sum(list_transform(range(1, 10), lambda k: (try_cast({n}[k] as int) * (2 - k % 2)) // 10 + (try_cast({n}[k] as int) * (2 - k % 2)) % 10)) % 10 = 0)"
#: Pairs of records: sides a and b of name, dob, expiry, sex, type, number, country, address, and whose zone b has.
_pairs = f"""{_persons}, o as (select *, row_number() over (order by query_id) - 1 as place, count(*) over () as total from p),
    os as (select *, (place + ({list(STEPS)})[(query_id // 2) % {len(STEPS)} + 1]) % total as other from o),
    j as (select a.query_id as k, a.query_id % 6 = 0 as clean, b.query_id as k2, a.fullName as fa, b.fullName as fb, a.dob as da, b.dob as db, a.expiry as ea, b.expiry as eb, a.sex as sa, b.sex as sb, a.docType as ta, b.docType as tb, a.docNumber as na, b.docNumber as nb, a.country as ca, b.country as cb, a.address as aa, b.address as ab from os a join o b on b.place = a.other),
    q as (select k as query_id, if(clean, k, k2) as kb, fa, case when k % 97 = 5 then fb when k % 3 = 0 then {name_text('k', OTHERS, 1)} else fb end as fb,
        case when not clean and k % 8 = 3 then da[1:4] || '-01-01' else da end as da,
        case when clean or k % 8 = 0 then da when k % 8 = 1 then da[1:4] || '-' || da[9:10] || '-' || da[6:7] when k % 8 = 2 then da[1:4] || '-12-31' when k % 8 = 3 then da[1:4] || '-01-01' when k % 8 = 4 then da[1:4] || '-02-30' else db end as db,
        case when not clean and k % 18 = 1 then null else ea end as ea, case when clean or k % 9 = 0 then ea when k % 9 = 1 then null when k % 9 = 2 then '2030-13-01' else eb end as eb,
        sa, if(clean, sa, sb) as sb, ta, if(clean or k % 4 = 1, ta, tb) as tb, na, case when clean or k % 7 = 0 then na when k % 7 = 1 then '' else nb end as nb,
        if(not clean and k % 4 = 0, 'IL', ca) as ca, case when clean then ca when k % 4 = 0 then 'IL' else cb end as cb, aa,
        case k % 6 when 0 then aa when 1 then '7 Road' when 2 then '5, ' || {_pick(CITIES, 'k * 3')} else ab end as ab from j)"""
_dob = f"""dob_rows as (select query_id, (['info', 'info', 'ok', 'warn', 'warn', 'bad', 'bad'])[k + 1] as status, (['MISS-1', 'DOB-1,DOB-4', 'DOB-1', 'DOB-SWAP', 'DOB-2', 'DOB-3', 'DATE-1'])[k + 1] as rules, case when k in (1, 2) then null else 'REFER' end as cap
    from (select *, case when (da is not null and try_strptime(da, '%Y-%m-%d') is null) or (db is not null and try_strptime(db, '%Y-%m-%d') is null) then 6
        when da is null or db is null then 0 when da = db and da[6:10] = '01-01' then 1 when da = db then 2 when da = db[1:5] || db[9:10] || '-' || db[6:7] then 3 when da[1:4] = db[1:4] then 4 else 5 end as k from q))"""
_expiry = f"""expiry_rows as (select query_id, (['bad', 'info', 'warn', 'ok', 'bad', 'info', 'info'])[k + 1] as status, (['EXP-1', 'EXP-4', 'EXP-2', 'EXP-3', 'DATE-1', 'MISS-1', 'EXP-3'])[k + 1] as rules, case when k in (0, 2, 4) then 'REFER' end as cap
    from (select *, case when eb = '2030-13-01' then 4 when ea is null and eb is null then 5 when ea < '{TODAY}' or eb < '{TODAY}' then 0
        when ea != eb and ta != tb then 1 when ea != eb then 2 when ea is null or eb is null then 6 else 3 end as k from q))"""
_doc_number = f"""number_rows as (select query_id, (['ok', 'ok', 'warn', 'info', 'warn', 'info'])[k + 1] as status, (['NUM-1,NUM-4', 'NUM-1', 'NUM-2,NUM-4', 'NUM-3', 'NUM-2', 'MISS-1'])[k + 1] as rules, case when k in (2, 4, 5) then 'REFER' end as cap
    from (select query_id, case when nb = '' then 5 when na = nb and shared then 0 when na = nb then 1 when shared then 2 when ta != tb then 3 else 4 end as k from (select *, ta != tb and {_israeli('ca', 'ta')} and {_israeli('cb', 'tb')} as shared from q)))"""
_validated = lambda side: f"""select query_id, 'docNumber {side}' as field, if({_israeli(f'c{side}', f't{side}')} and length(n{side}) = 9 and {_luhn(f'n{side}')}, 'ok', if({_israeli(f'c{side}', f't{side}')} and length(n{side}) = 9, 'bad', 'warn')) as status,
    case when not {_israeli(f'c{side}', f't{side}')} then 'FMT-1' when length(n{side}) = 9 then 'ID-CHK' else 'ID-CHK,FMT-1' end as rules, if({_israeli(f'c{side}', f't{side}')} and length(n{side}) = 9 and {_luhn(f'n{side}')}, null, 'REFER') as cap
    from q where n{side} != '' and ({_israeli(f'c{side}', f't{side}')} or t{side} = 'passport' and not regexp_full_match(n{side}, '[A-Z0-9]{{6,9}}'))"""  # noqa: E731
_sex = "sex_rows as (select query_id, case when sa = sb then 'ok' else 'bad' end as status, 'SEX-1' as rules, case when sa != sb then 'REFER' end as cap from q where sa != '' and sb != '')"
#: Check rows of both records' fields but addresses, zones and provenance.
_checks = f"""{_dob}, {_expiry}, {_doc_number}, {_sex}, checks as (select query_id, 'dob' as field, status, rules, cap from dob_rows union all select query_id, 'expiry', status, rules, cap from expiry_rows union all select query_id, 'docNumber', status, rules, cap from number_rows
    union all {_validated('a')} union all {_validated('b')} union all select query_id, 'sex', status, rules, cap from sex_rows
    union all select query_id, 'docType', if(ta = tb, 'ok', 'info'), 'TYPE-1', null from q union all select query_id, 'country', if(ca = cb, 'ok', 'warn'), 'CTRY-1', null from q)"""
#: Rows of zones: table ``zoned`` has query_id, side, owner, and the printed n, d, e, s, c and name beside the zone's z_ columns and latin.
_zones = f"""compared as (select *, list_filter([if(n != '', z_num = regexp_replace(upper(n), '[^A-Z0-9]', '', 'g'), null), z_born = d, z_exp = e, if(s != '', z_sex = s, null), if(c in ('SY', 'EG', 'JO', 'IL'), z_land = c, null)], lambda x: x is not null) as agree from zoned where owner % 13 != 0),
    zone_rows as (select query_id, side, 'zone' as field, 'warn' as status, 'MRZ-4' as rules, 'REFER' as cap from compared where owner % 10 = 9
        union all select query_id, side, 'zone digits', 'ok', 'MRZ-1', null from compared where owner % 10 != 9
        union all select query_id, side, 'zone composite', if(owner % 10 = 7, 'bad', 'ok'), 'MRZ-2', if(owner % 10 = 7, 'REFER', null) from compared where owner % 10 != 9
        union all select query_id, side, 'zone against print', if(list_contains(agree, false), 'bad', 'ok'), 'MRZ-3', if(list_contains(agree, false), 'REFER', null) from compared where owner % 10 != 9 and len(agree) > 0)"""
_zone_names = """zone_name_rows as (select query_id, side, 'zone name' as field, case when score >= 85 then 'ok' when score >= 60 then 'warn' else 'bad' end as status, 'MRZ-3' as rules, if(score < 60, 'REFER', null) as cap
    from compared join scores on a = latin and b = name where owner % 10 != 9 and trim(name) != '')"""
_own_zones = "zoned as (select query_id, '' as side, query_id as owner, docNumber as n, dob as d, expiry as e, sex as s, country as c, fullName as name, z_num, z_born, z_exp, z_sex, z_land, latin from p)"
_both_zones = """zoned as (select q.query_id, ' a' as side, q.query_id as owner, na as n, da as d, ea as e, sa as s, ca as c, fa as name, z_num, z_born, z_exp, z_sex, z_land, latin from q join p on p.query_id = q.query_id
    union all select q.query_id, ' b', kb, nb, db, eb, sb, cb, fb, z_num, z_born, z_exp, z_sex, z_land, latin from q join p on p.query_id = kb)"""
_locality = lambda x: f"trim(regexp_replace(trim(regexp_replace({x}, '[0-9]+|,', '', 'g')), '^(King) St\\.|^شارع |^Road ?|^Flat ', '\\1'))"
_localities = f"side as (select query_id, {_locality('aa')} as la, {_locality('ab')} as lb from q)"
_sounds = """sounds as (select w.a, w.b, array_to_string(p.ts, '') as x, array_to_string(q.ts, '') as y from (select distinct la as a, lb as b from side) w join name_parts p on p.name = w.a join name_parts q on q.name = w.b),
    percents as (select sounds.a as la, sounds.b as lb, if(s1 = s2, 100, cast(floor(greatest(0.0::double, 1.0::double - (r[-1] / 4.0::double) / greatest(length(s1), length(s2), 1)) * 100 + 0.5) as int)) as percent
        from sounds join recursive_rows d on d.a = x and d.b = y and d.i = length(d.s1)),
    address_rows as (select query_id, case when percent >= 80 then 'ok' when percent >= 50 then 'warn' else 'info' end as status, if(la = '' or lb = '', 'MISS-1', 'ADDR-1') as rules, cast(null as varchar) as cap from side left join percents using (la, lb))"""
_sound_tokens = name_sql.score_tables("union select array_to_string(ts, '') from name_parts", "union select array_to_string(p.ts, ''), array_to_string(q.ts, '') from side join name_parts p on p.name = la join name_parts q on q.name = lb")
#: All of a comparison of records with addresses, zones and provenance: ``every`` (query_id, field, status, rules, cap).
_every = f"""{_sounds}, {_zones}, {_zone_names},
    every as (select * from checks union all select query_id, field || side, status, rules, cap from zone_rows union all select query_id, field || side, status, rules, cap from zone_name_rows
        union all select query_id, 'address', status, rules, cap from address_rows
        union all select query_id, 'provenance a', if(query_id % 5 = 0, 'ok', 'warn'), if(query_id % 5 = 0, 'OCR-2', 'OCR-1'), if(query_id % 5 = 0, null, 'REFER') from q where query_id % 5 < 2
        union all select query_id, 'provenance b', s, if(s = 'ok', 'OCR-2', 'OCR-1'), if(s = 'ok', null, 'REFER') from q, (values ('ok'), ('warn')) v(s) where query_id % 7 = 2)"""
_document_names = "select fa as a, fb as b from q union select latin, name from zoned where trim(name) != ''"
_documents = f"""{_pairs}, {_checks}, {_localities}, {_both_zones}, wanted as ({_document_names}), names as (select a as name from wanted union select b from wanted union select la from side union select lb from side),
    {_sound_tokens}, {_every}"""
#: ``every`` with the records' values and what each outcome is called and why it came about.
_outcomes = f"""outcomes as (select unnest([{", ".join(f"{{'rules': {name_sql.quoted(r)}, 'status': '{s}', 'label': {name_sql.quoted(label)}, 'reason': {name_sql.quoted(why)}}}" for (r, s), (label, why) in OUTCOMES.items())}], recursive := true)),
    full_rows as (select e.*, label, reason, coalesce(case field when 'dob' then da when 'expiry' then ea when 'docNumber' then na when 'sex' then sa when 'docType' then ta when 'country' then ca when 'address' then aa when 'docNumber a' then na end, '') as a,
        coalesce(case field when 'dob' then db when 'expiry' then eb when 'docNumber' then nb when 'sex' then sb when 'docType' then tb when 'country' then cb when 'address' then ab when 'docNumber b' then nb end, '') as b
        from every e join q using (query_id) left join outcomes o on o.rules = e.rules and o.status = e.status)"""
_verdicts = lambda checks: f"""stops as (select query_id, count(*) as n_checks, count(cap) as stops from {checks} group by query_id),
    verdicts as (select q.query_id, fa, fb, coalesce(s.score, 0) as score, n_checks, stops, case when coalesce(s.score, 0) >= 85 then 2 when coalesce(s.score, 0) >= 60 then 1 else 0 end as v from q join stops using (query_id) left join scores s on s.a is not distinct from fa and s.b is not distinct from fb),
    final as (select *, if(stops > 0, least(v, 1), v) as f, if(stops > 0 and v > 1, 'CAP-1', null) as cap_rule from verdicts)"""  # noqa: E731
_verdict = lambda v: f"(['NO_MATCH', 'REFER', 'MATCH'])[{v} + 1]"



def wrapped(text: str, indent: str = "", hang: int = 0, width: int = 76) -> str:
    """SQL text for words filled into lines."""
    first, more = name_sql.quoted(indent), name_sql.quoted(indent + " " * hang)
    prefix = f"if(acc.done = '', {first}, {more})"
    fold = f"""list_reduce(list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w != ''), lambda acc, w: case when acc.line = '' then {{'done': acc.done, 'line': w}}
        when length({prefix}) + length(acc.line) + 1 + length(w) > {width} then {{'done': acc.done || {prefix} || acc.line || chr(10), 'line': w}} else {{'done': acc.done, 'line': acc.line || ' ' || w}} end, {{'done': '', 'line': ''}})"""
    return f"list_transform([{fold}], lambda acc: acc.done || {prefix} || acc.line)[1]"


_section = lambda title, body: f"'{title}' || chr(10) || repeat('-', 60) || chr(10) || {body}"
_FIELDS = ("dob", "expiry", "docNumber", "docNumber a", "docNumber b", *[f"{z} {s}" for s in "ab" for z in ("zone", "zone digits", "zone composite", "zone against print", "zone name")], "sex", "docType", "country", "address", "provenance a", "provenance b")
_bracketed = lambda rules: f"'[' || replace({rules}, ',', ' ') || ']'"
_pair_reason = "case " + " ".join(f"when string_split(rules, ',')[1] = '{rule}' then replace(replace(replace({name_sql.quoted(why)}, '{{a}}', x), '{{b}}', y), '{{e}}', array_to_string(edits[1:4], ', ') || if(len(edits) > 4, ', …', ''))" for rule, why in PAIR_REASONS.items()) + " else '' end || if(contains(rules, 'VOW-1'), ' Their first vowels differ.', '') || if(contains(rules, 'ORD-1'), ' They stand at different places.', '')"
_case = lambda x, values: f"case {x} " + " ".join(f"when '{k}' then {name_sql.quoted(v)}" for k, v in values.items()) + " end"
_record = lambda s: f"concat_ws(', ', coalesce(nullif(trim(f{s}), ''), '(no name)'), 'born ' || d{s}, 'sex ' || nullif(s{s}, ''), {_case('t' + s, DOCUMENTS)}, 'no. ' || nullif(n{s}, ''), c{s})"
_reads = [("a", "query_id % 5 = 0", "dob", "mrz-validated"), ("a", "query_id % 5 = 1", "dob", "ocr-unconfirmed"), ("a", "query_id % 5 = 2", "dob", "confirmed"), ("b", "query_id % 7 = 2", "sex", "mrz-validated"), ("b", "query_id % 7 = 2", "dob", "ocr-unconfirmed")]
_read = "concat_ws(chr(10), " + ", ".join(f"if({when}, '  {side.upper()}: {field} {STATES[state]}', null)" for side, when, field, state in _reads) + ")"
#: ``notes`` (query_id, note) from ``full_rows``, ``final`` and ``pair_rows``.
_notes = f"""check_texts as (select query_id, string_agg('  ' || field || ': ' || label || chr(10) || text, chr(10) order by spot, status) as checks, string_agg(if(cap is null, null, '  ' || field || ' ' || {_bracketed('rules')}), chr(10) order by spot, status) as stopped
        from (select *, list_position({sql_list(_FIELDS)}, field) as spot, {wrapped(_bracketed('rules') + " || ' ' || replace(replace(reason, '{a}', a), '{b}', b)", '     ')} as text from full_rows) group by query_id),
    pair_texts as (select a, b, string_agg(head || chr(10) || text, chr(10) order by place) as names from (select a, b, place, {wrapped("coalesce(nullif(x, ''), '-') || ' with ' || coalesce(nullif(y, ''), '-') || if(role != '', ' (' || role || coalesce(', ' || cents, '') || ')', '')", '  ', 2)} as head,
        {wrapped(_bracketed('rules') + " || ' ' || " + _pair_reason, '     ')} as text from pair_rows) group by a, b),
    rewritten as (select query_id, concat_ws(',', nullif(r1.rules, ''), nullif(r2.rules, '')) as rules from q left join name_rules r1 on r1.name = fa left join name_rules r2 on r2.name = fb),
    rewritten_once as (select query_id, list_reduce(string_split(rules, ','), lambda acc, r: if(contains(acc || ' ', ' ' || r || ' '), acc, acc || ' ' || r), '') as rules from rewritten where rules != ''),
    notes as (select q.query_id, concat_ws(chr(10) || chr(10), 'Identity comparison: ' || (['NO MATCH', 'REVIEW', 'MATCH'])[f + 1] || chr(10) || repeat('=', 60) || chr(10) || 'Evaluated on {TODAY}; match from 85, review from 60' || chr(10) || 'Name score ' || score || ' of 100',
        {_section('Finding', wrapped("'The name score of ' || score || ' ' || (['is below 60.', 'lies from 60 up but below 85.', 'reaches 85, from which names match.'])[v + 1] || ' ' || if(f = v, (['The records are taken for two persons.', 'Someone should look at the documents.', 'No check speaks against one person.'])[v + 1], 'A check lowered the verdict from match to review.')"))},
        {_section('Records', wrapped("'A: ' || " + _record('a'), '', 3) + " || chr(10) || " + wrapped("'B: ' || " + _record('b'), '', 3))},
        {_section('Machine-read values', f"nullif({_read}, '')")}, {_section('Rewritten names', "'  [' || trim(o.rules) || ']'")},
        {_section('Names', "if(n > 1 or m > 1, '  [AGG-1] given and family names weigh more than middle ones' || chr(10), '') || names")}, {_section('Checks', 'checks')},
        if(cap_rule is null, 'No check lowered the verdict', {_section('What lowered the verdict [CAP-1]', 'stopped')})) as note
        from q join (select query_id, score, v, f, cap_rule from final) using (query_id) join check_texts using (query_id) left join rewritten_once o using (query_id) left join pair_texts t on t.a is not distinct from q.fa and t.b is not distinct from q.fb left join taken k on k.a = q.fa and k.b = q.fb)"""

_fold_from = "".join(g for g in lx.LATIN_FOLD.values())
_fold_to = "".join(b * len(g) for b, g in lx.LATIN_FOLD.items())
_words = r"w as (select unnest(regexp_split_to_array(text, '[\s]+')) as word from documents)"
_norm = f"translate(translate(replace(lower(word), 'š', 'sh'), '{_fold_from}', '{_fold_to}'), '.,;:_\"“”()[]', '')"
_classes = ", ".join(f"'{k}': '{v}'" for k, v in (lx.letters({c: g.replace("'", "") for c, g in lx.LATIN.items()}) | lx.LATIN_PAIRS).items())
_units = ", ".join(f"'{k}': '{v}'" for k, v in ({u: c for u, c in lx.unit_classes().items() if u != "'"} | {"''": "A"}).items())
_groups = "|".join(lx.LATIN_PAIRS) + "|[" + "".join(lx.HEBREW_GERESH) + "]" + lx.GERESH + "|."
_watchlist = f"""e as (select s_suppkey as idx, if(s_suppkey % 8 = 3, [{_pick(NAMES, 's_suppkey * 11')}], []) || [{name_text('(s_suppkey * 5)', OTHERS, 1)}] || if(s_suppkey % 3 = 0, [{name_text('(s_suppkey * 5)', NAMES, 0)}], []) || if(s_suppkey % 7 = 1, [{_pick(NAMES, 's_suppkey * 5 + 2')}], []) as names,
    case when s_suppkey % 2 = 0 then {_date('s_suppkey * 5')} when s_suppkey % 3 = 0 then {_date('s_suppkey * 3')} end as e_dob, {_pick(('M', 'F', ''), 's_suppkey * 5 + if(s_suppkey % 4 = 1, 1, 0)')} as e_sex,
    case when s_suppkey % 5 != 0 then {_pick(COUNTRIES, 's_suppkey * 5')} end as e_nat, if(s_suppkey % 13 != 0 and s_suppkey % 4 = 0, 'pep', 'sanction') as kind from supplier)"""
#: Block keys of each distinct name of the table ``names``: skeletons of its parts in any script, and those less one letter.
_plain_part = rf"""case when regexp_matches(part, '[\x{{0600}}-\x{{06FF}}]') then regexp_replace(part, '{lx.ARABIC_MARKS}|[-’`ʿʼ]', '', 'g')
        when regexp_matches(part, '[\x{{0590}}-\x{{05FF}}]') then translate(regexp_replace(part, '{lx.HEBREW_MARKS}', '', 'g'), '’-`ʿʼ', '{lx.GERESH}')
        else regexp_replace({_norm.replace("word", "part")}, '[-’`ʿʼ]', chr(39), 'g') end"""
_keys = rf"""bt as (select distinct name, unnest(regexp_split_to_array(name, '[\s،؛]+')) as part from names),
    bs as (select name, {_plain_part} as plain from bt),
    bu as (select name, list_transform(regexp_extract_all(plain, '{_groups}'), lambda x: (map {{{_units}}})[x]) as c from bs),
    bf as (select name, list_filter(c, lambda x: x is not null) as c from bu),
    br as (select name, list_filter(c, lambda x, i: i = 1 or x != c[i - 1]) as c from bf),
    bk as (select name, coalesce(array_to_string(list_filter(c, lambda x, i: x != 'A' and (x not in ('W', 'Y') or i = 1)), ''), '') as cons from br),
    keys as (select distinct name, unnest([cons] || list_transform(range(1, length(cons) + 1), lambda i: left(cons, i - 1) || substr(cons, i + 1))) as block_key from bk where cons != '')"""
_met = "i as (select distinct idx, block_key from (select idx, unnest(names) as name from e) join keys using (name)), met as (select distinct q.name, idx from keys q join i using (block_key) where q.name in (select fullName from p))"
_named = "named as (select name, idx, unnest(names) as other, generate_subscripts(names, 1) as position from met join e using (idx))"
_ranked = lambda least: f"""ranked as (select name, idx, other, position, score, row_number() over (partition by name, idx order by score desc, position) as r from named join scores on a = name and b = other),
    seen as (select query_id, fullName, idx, other, position, score, kind, [case when dob is null or e_dob is null then 'u' when dob = e_dob or dob = e_dob[1:5] || e_dob[9:10] || '-' || e_dob[6:7] then 'a' else 'c' end,
        case when sex = '' or e_sex = '' then 'u' when sex = e_sex then 'a' else 'c' end, case when e_nat is null then 'u' when nationality = e_nat then 'a' else 'c' end] as f
        from p join ranked on ranked.name = p.fullName and r = 1 and score >= {least} join e using (idx)),
    hits as (select *, if(list_contains(f, 'c'), 'DISCOUNTED', if(list_contains(f, 'a'), 'STRONG', 'POTENTIAL')) as classification from seen),
    listed as (select query_id, fullName, kind, cast(row_number() over (partition by query_id order by case classification when 'STRONG' then 0 when 'POTENTIAL' then 1 else 2 end, score desc, idx) as int) as rank, idx, other as matched_name, position > 1 as via_alias, score as name_score, classification,
        concat_ws(',', 'SCR-1', if(position > 1, 'SCR-5', null), case classification when 'DISCOUNTED' then 'SCR-3' when 'STRONG' then 'SCR-2' end, if(kind = 'pep', 'SCR-6', null)) as rules from hits)"""  # noqa: E731
_hits = lambda least: f"""{_persons}, {_watchlist}, names as (select fullName as name from p union select unnest(names) from e), {_keys}, {_met}, {_named},
    wanted as (select distinct name as a, other as b from named), {name_sql.SCORES}, {_ranked(least)}"""  # noqa: E731
_counts = ", ".join(f"count(*) filter (where classification = '{c}') as {c.lower()}" for c in ("STRONG", "POTENTIAL", "DISCOUNTED"))
_told = lambda hit: f"""if(hits = 0, 'NO_MATCH', 'POTENTIAL_MATCH') as disposition, if(hits = 0, 'no name or alias reached ' || {hit}, hits || if(hits = 1, ' hit', ' hits') || ' from ' || {hit} || ': ' || concat_ws(', ', if(strong > 0, strong || ' corroborated', null), if(potential > 0, potential || ' potential', null), if(discounted > 0, discounted || ' discounted', null))
    || if(discounted = hits, '; look at each before dismissing it', '')) as reason"""  # noqa: E731
_risk = "case nationality when 'SY' then 'high' when 'IR' then 'high' when 'EG' then 'medium' end"

ORACLE_SQL = {
    "screen_hits": f"with recursive {_hits(75)} select * exclude (fullName, kind) from listed",
    "hit_evidence": f"with recursive {_hits(75)}, {name_sql.row_tables()} select query_id, idx, kind as list_type, place, x as a, y as b, role, cents as score, r.rules from listed join pair_rows r on r.a = fullName and r.b = matched_name",
    "streamed_hits": f"with recursive {_hits(75)} select query_id, rank, idx, matched_name, name_score, classification from listed",
    "screen_disposition": f"""with recursive {_hits(75)}, c as (select query_id, count(*) as hits, {_counts} from listed group by query_id),
        d as (select query_id, coalesce(hits, 0) as hits, coalesce(strong, 0) as strong, coalesce(potential, 0) as potential, coalesce(discounted, 0) as discounted, {_risk} as country_risk, case nationality when 'SY' then 'list A; list B' when 'IR' then 'list A' when 'EG' then '' end as country_risk_sources,
            (select count(*) from met where name = fullName) as candidates, (select count(*) from e) as screened from p left join c using (query_id))
        select *, concat_ws(',', if(hits = 0, 'SCR-4', null), if(country_risk is not null, 'CRISK-1', null)) as rules, {_told('75')} from d""",
    "threshold_sweep": f"""with recursive {_hits(50)}, d as (select query_id, hit, count(classification) as hits, {_counts} from (select p.query_id, hit, classification from p, (select unnest(range(50, 101)) as hit) left join listed on listed.query_id = p.query_id and name_score >= hit) group by query_id, hit)
        select query_id, cast(hit as int) as hit, hits, strong, potential, discounted, if(hits = 0, 'SCR-4', '') as rules, {_told('hit')} from d""",
    "blocking_recall": f"""with recursive {_persons}, {_watchlist}, names as (select fullName as name from p where fullName is not null union select unnest(names) from e), {_keys}, l as (select distinct names from e),
        pairs as (select distinct fullName as name, names from p, l where fullName is not null), wanted as (select distinct name as a, other as b from (select name, unnest(names) as other from pairs)), {name_sql.SCORES},
        best as (select name, names, max(score) as score from (select name, names, unnest(names) as other from pairs) join scores on a = name and b = other group by name, names),
        tokens as (select name, unnest(ts) as token from name_parts), strong as (select c.a as x, c.b as y from cents c where cents >= 75),
        parts_of as (select names, token from (select names, unnest(names) as name from l) join tokens using (name)),
        wide as (select name, block_key as k from keys union select name, unnest([cons] || list_transform(range(1, length(cons) + 1), lambda i: left(cons, i - 1) || substr(cons, i + 1))) from tokens join t using (token) where cons != '' union select name, '=' || known from tokens join t using (token) where known is not null),
        asked as (select distinct 'reference' as blocking, a.name, names from keys a join (select names, unnest(names) as name from l) o on true join keys b on b.name = o.name and a.block_key = b.block_key where a.name in (select fullName from p)
            union all select distinct 'wide', a.name, names from wide a join wide b on a.k = b.k join (select names, unnest(names) as name from l) o on o.name = b.name where a.name in (select fullName from p)
            union all select distinct 'exhaustive', a.name, names from tokens a join strong on x = a.token join parts_of b on b.token = y where a.name in (select fullName from p))
        select blocking, (select count(*) from pairs) as pairs, count(*) as candidates, count(*) filter (where score >= 75) as hits, (select count(*) from best where score >= 75) - count(*) filter (where score >= 75) as missed from asked join best using (name, names) group by blocking""",
    "name_pair_scores": f"""with recursive {_pairs}, wanted as (select distinct fa as a, fb as b from q), names as (select a as name from wanted union select b from wanted), {name_sql.SCORES}
        select a, b, score, unmatched_middles, coalesce(rules, '') as rules_a from scores left join name_rules on name = a""",
    "name_pair_rows": f"""with recursive {_pairs}, wanted as (select distinct fa as a, fb as b from q), names as (select a as name from wanted union select b from wanted), {name_sql.SCORES}, {name_sql.row_tables()}
        select r.a as name_a, r.b as name_b, place, x as a, y as b, role, cents as score, rules from pair_rows r""",
    "case_notes": f"with recursive {_documents}, {_outcomes}, {_verdicts('every')}, {name_sql.row_tables()}, {_notes} select query_id, note from notes",
    "check_rows": f"""with recursive {_documents}, {_outcomes} select query_id, field, a, b, status, label, rules, replace(replace(reason, '{{a}}', a), '{{b}}', b) as reason, cap from full_rows""",
    "address_check": f"""with recursive {_pairs}, {_localities}, wanted as (select la as a, lb as b from side), names as (select a as name from wanted union select b from wanted), {_sound_tokens}, {_sounds} select * from address_rows""",
    "zone_checks": f"with {_persons}, {_own_zones}, {_zones} select * exclude (side) from zone_rows",
    "zone_name_checks": f"""with recursive {_persons}, {_own_zones}, {_zones}, wanted as (select distinct latin as a, name as b from zoned), names as (select a as name from wanted union select b from wanted), {name_sql.SCORES}, {_zone_names}
        select * exclude (side) from zone_name_rows""",
    "document_verdicts": f"with recursive {_documents}, {_verdicts('every')} select query_id, score as name_score, {_verdict('f')} as verdict, n_checks, stops, cap_rule from final",
    "record_verdicts": f"""with recursive {_pairs}, {_checks}, wanted as (select distinct fa as a, fb as b from q), names as (select a as name from wanted union select b from wanted), {name_sql.SCORES}, {_verdicts('checks')}
        select query_id, score as name_score, {_verdict('v')} as provisional_verdict, {_verdict('f')} as verdict, cap_rule, stops from final""",
    "rules_cited": f"""with recursive {_pairs}, {_checks}, {_localities}, {_both_zones}, {_watchlist},
        names as (select fullName as name from p union select unnest(names) from e union select fb from q union select latin from zoned union select la from side union select lb from side), {_keys}, {_met}, {_named},
        wanted as ({_document_names} union select name, other from named), {_sound_tokens}, {_every}, {_verdicts('every')}, {_ranked(75)}, {name_sql.row_tables()},
        texts as (select rules from every union all select r.rules from q join pair_rows r on r.a is not distinct from fa and r.b is not distinct from fb
            union all select r.rules from q join name_rules r on r.name = fa union all select r.rules from q join name_rules r on r.name = fb
            union all select 'AGG-1' from q join taken on taken.a = fa and taken.b = fb where n > 1 or m > 1 union all select cap_rule from final where cap_rule is not null
            union all select rules from listed union all select r.rules from listed join pair_rows r on r.a = fullName and r.b = matched_name
            union all select 'SCR-4' from p where query_id not in (select query_id from listed) union all select 'CRISK-1' from p where {_risk} is not null),
        cited as (select rule, count(*) as n from (select unnest(string_split(rules, ',')) as rule from texts where rules != '') group by rule),
        known as (select unnest(string_split(rules, ' ')) as rule, about from (values {", ".join(f"('{about}', '{' '.join(rules)}')" for about, rules in RULES.items())}) v(about, rules))
        select rule, about, coalesce(n, 0) as n, case when about is null then 'unregistered' when n is null then 'never cited' else 'cited' end as standing from known full join cited using (rule)""",
    "block_candidates": f"""with {_persons}, {_watchlist}, names as (select fullName as name from p union select unnest(names) from e), {_keys}, {_met}
        select query_id, (select count(*) from met where name = fullName) as candidates from p""",
    "country_risk": f"with {_persons} select query_id, nationality as code, {_risk} as risk from p",
    "script_counts": f"with {_persons} select case when regexp_matches(fullName, '[\\x{{0600}}-\\x{{06FF}}]') then 'arabic' when regexp_matches(fullName, '[\\x{{0590}}-\\x{{05FF}}]') then 'hebrew' when fullName is not null then 'latin' end as script, count(*) as n from p group by 1",
    "normalize_words": f"with {_words} select {_norm} as token, count(*) as n from w where word != '' group by 1",
    "first_vowel_words": f"with {_words} select nullif(translate(regexp_extract({_norm}, '[aeiou]'), 'eo', 'iu'), '') as vowel, count(*) as n from w where word != '' group by 1",
    "skeleton_words": f"""with w as (select distinct unnest(string_split(p_name, ' ')) as word from part),
        u as (select word, list_transform(regexp_extract_all(lower(word), '{"|".join(lx.LATIN_PAIRS)}|[a-z]'), lambda x: (map {{{_classes}}})[x]) as c from w),
        r as (select word, list_filter(c, lambda x, i: i = 1 or x != c[i - 1]) as c from u)
        select word, array_to_string(c, '') as full, coalesce(array_to_string(list_filter(c, lambda x, i: x != 'A' and (x not in ('W', 'Y') or i = 1)), ''), '') as cons from r""",
    "dob_check": f"with {_pairs}, {_dob} select * from dob_rows",
    "expiry_check": f"with {_pairs}, {_expiry} select * from expiry_rows",
    "sex_check": f"with {_pairs}, {_sex} select * from sex_rows",
    "doc_number_check": f"with {_pairs}, {_doc_number} select * from number_rows",
    "id_check_digit": f"with {_persons} select query_id, docNumber, if(length(docNumber) = 9, {_luhn('docNumber')}, null) as valid from p",
    "mrz_check_digits": f"with {_persons} select query_id, if(length(docNumber) = 9, cast(cast(list_sum(list_transform(range(1, 10), lambda k: try_cast(docNumber[k] as int) * ([7, 3, 1])[(k - 1) % 3 + 1])) as bigint) % 10 as varchar), null) as digit from p",
    "mrz_build_parse": f"""with {_persons} select query_id, if(query_id % 2 = 0, 'TD3', 'TD1') as format, if(docNumber = '12-X', '12X', docNumber) as number, coalesce(dob, '2001-02-03') as dob, expiry, sex,
        {_pick(GIVEN, 'query_id')} || ' ' || {_pick(SURNAMES, 'query_id')} as name, if(query_id % 7 = 0, 'documentNumber,composite', '') as wrong from p""",
    "known_lookup": f"""with {_persons}, t as (select query_id, unnest(string_split(fullName, ' ')) as part, generate_subscripts(string_split(fullName, ' '), 1) - 1 as place from p where trim(fullName) != ''),
        k as (select unnest(string_split(spellings, ' ')) as spelling, name from (values {", ".join(f"('{n}', '{x}')" for n, x in lx.KNOWN.items())}) v(name, spellings))
        select query_id, cast(place as int) as place, part, name as known, upper(name[1]) || name[2:] as label from t left join k on spelling = replace(replace({name_sql.normal('part')}, '-', ''), chr(39), '')""",
    "watchlist_ingest": """select 'id' || s_suppkey as id, 'sanction' as type, 'd' as program, s_name || ', the "old"' || chr(10) || 'one' as name, 'SY' as nationality, 3 as n_aliases from supplier where s_suppkey % 9 != 0
        union all select 'p' || s_suppkey, 'pep', 'd', s_name || ', the "old"' || chr(10) || 'one', 'SY', 3 from supplier where s_suppkey % 9 != 0 and s_suppkey % 3 != 0""",
    "watchlist_dedup": """with r as (select s_suppkey as k, 'id' || cast(s_suppkey % 70 as varchar) as id, s_name as name from supplier where s_suppkey % 9 != 0),
        f as (select *, row_number() over (partition by id order by k) as n from r)
        select cast(row_number() over (order by k) - 1 as bigint) as idx, id, 'sanction' as type, name, case when k % 2 = 0 then '1970-01-02' end as dob, 'SY' as nationality, 2 as n_aliases from f where n = 1""",
    "loader_counts": f"with {_watchlist} select count(*) as total, count(*) filter (where kind = 'sanction') as sanction, count(*) filter (where kind = 'pep') as pep from e",
    "address_localities": f"""with {_persons} select query_id, trim({_pick(('King', 'الملك', '', 'B'), 'query_id')} || ' ' || {_pick(CITIES, 'query_id * 3')}) as locality from p""",
    "captured_fields": f"""with {_persons}, m as (select *, z_born[3:4] || z_born[6:7] || z_born[9:10] as six, 39 - length(zone_name) as filler from p),
        d as (select *, cast(list_sum(list_transform(range(1, 7), lambda k: cast(six[k] as int) * ([7, 3, 1])[(k - 1) % 3 + 1])) as bigint) % 10 as digit from m),
        n as (select *, cast(length(regexp_replace(six, '[^0158]', '', 'g')) as int) as corrections from d),
        f as (select query_id, corrections, unnest([
            {{'field': 'mrz', 'value': null, 'validated': true}}, {{'field': 'dob', 'value': z_born, 'validated': true}},
            {{'field': 'expiry', 'value': expiry, 'validated': true}}, {{'field': 'docNumber', 'value': z_num, 'validated': true}},
            {{'field': 'fullName', 'value': split_part(zone_name, '<<', 2) || if(filler < 4, repeat('K', filler), '') || ' ' || split_part(zone_name, '<<', 1), 'validated': false}},
            {{'field': 'sex', 'value': nullif(sex, ''), 'validated': false}},
            {{'field': 'country', 'value': case when country in ('SY', 'EG', 'JO', 'IL') then country else 'OTHER' end, 'validated': false}},
            {{'field': 'docType', 'value': 'passport', 'validated': false}}]) as r from n)
        select query_id, corrections, r.field as field, r.value as value, 'mrz' as source, r.validated as validated from f where r.value is not null or r.field = 'mrz'""",
    "printed_fields": f"with {_persons} select query_id, {_date('query_id')} as dob, expiry, nullif(regexp_extract(docNumber, '^[0-9]{{9}}$'), '') as number from p",
    "field_states": f"""with recursive e as (select user_id as record_id, if(event_id % 2 = 0, 'a', 'b') as side, (['dob', 'fullName', 'sex'])[event_id % 3 + 1] as field,
            {" ".join(["case event_type"] + [f"when '{a}' then '{b}'" for a, b in EVENTS.items()] + ["end"])} as event, (['x', 'y'])[(event_id // 2) % 2 + 1] as value, event_id % 5 < 2 as validated, event_id from events),
        o as (select *, row_number() over (partition by record_id, side, field order by event_id) as n, count(*) over (partition by record_id, side, field) as total from e),
        f as (select distinct record_id, side, field, cast(0 as bigint) as n, total, 'typed' as state, '' as value, cast(null as varchar) as read, false as sure from o
            union all select f.record_id, f.side, f.field, o.n, f.total,
                case when o.event = 'proposal' then if(o.validated, 'mrz-validated', 'ocr-unconfirmed') when o.event in ('edit', 'clear') then 'typed'
                    when o.event = 'confirm' and (f.state = 'ocr-unconfirmed' or (f.state = 'typed' and f.value = f.read)) then 'confirmed'
                    when o.event = 'restore' and f.state = 'typed' and f.value != f.read then if(f.sure, 'mrz-validated', 'ocr-unconfirmed') else f.state end,
                case when o.event in ('proposal', 'edit') then o.value when o.event = 'clear' then '' when o.event = 'restore' and f.state = 'typed' and f.value != f.read then f.read else f.value end,
                case when o.event = 'proposal' then o.value when o.event = 'clear' then null else f.read end,
                case when o.event = 'proposal' then o.validated when o.event = 'clear' then false else f.sure end
            from f join o on o.record_id = f.record_id and o.side = f.side and o.field = f.field and o.n = f.n + 1)
        select record_id, side, field, state, value from f where n = total""",
}

ORACLE_SQL["streamed_field_states"] = ORACLE_SQL["field_states"]
