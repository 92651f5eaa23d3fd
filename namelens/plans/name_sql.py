"""SQL that scores names as the library does, for holding its queries against another engine."""

from __future__ import annotations

from .. import lexicon as lx


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def members(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(map(quoted, values)) + ")"


FOLD_FROM = "".join(lx.LATIN_FOLD.values())
FOLD_TO = "".join(base * len(group) for base, group in lx.LATIN_FOLD.items())
PUNCTUATION = '.,;:_"“”()[]'
UNITS = "map {" + ", ".join(f"{quoted(u)}: '{c}'" for u, c in lx.unit_classes().items()) + "}"
GROUPS = "|".join(lx.LATIN_PAIRS) + "|[" + "".join(lx.HEBREW_GERESH) + "]" + lx.GERESH + "|."
NEAR = members((*lx.NEAR, *[p[::-1] for p in lx.NEAR]))
WEAK = members(lx.WEAK)


def script(t: str) -> str:
    return f"(case when regexp_matches({t}, '[\\x{{0600}}-\\x{{06FF}}]') then 'arabic' when regexp_matches({t}, '[\\x{{0590}}-\\x{{05FF}}]') then 'hebrew' else 'latin' end)"


def normal(t: str) -> str:
    latin = f"translate(replace(lower({t}), 'š', 'sh'), '{FOLD_FROM}', '{FOLD_TO}')"
    bare = f"case {script(t)} when 'arabic' then regexp_replace({t}, '{lx.ARABIC_MARKS}', '', 'g') when 'hebrew' then regexp_replace({t}, '{lx.HEBREW_MARKS}', '', 'g') else {latin} end"
    return f"trim(translate({bare}, '{PUNCTUATION}', ''))"


def indel(x: str, sure: str) -> str:
    return f"(case when {sure} or {x} in {WEAK} then 1 else 4 end)"


def substitution(x: str, y: str, unsure: str) -> str:
    return f"(case when {x} = {y} then 0 when {x} || {y} in {NEAR} then if({unsure}, 1, 2) when {x} in {WEAK} and {y} in {WEAK} then 1 else 4 end)"


def role(i: str, n: str) -> str:
    return f"(if({n} = 1 or {i} = 0, 0, if({i} = {n} - 1, 1, 2)))"


def weight(i: str) -> str:
    return f"(if({role(i, 'n')} < 2, 0.4::double, 0.2::double / greatest(1, n - 2)))"


LAYERS = "case when x.known = y.known then 100 when x.known != y.known then 0 when x.cons = '' and y.cons = '' then if(x.bare = y.bare, 100, 0)"


def chosen(x: str) -> str:
    """The first of three ways with the least cost: to put a class for another, to drop one, to add one."""
    return f"(if({x}[1].c <= {x}[2].c and {x}[1].c <= {x}[3].c, {x}[1], if({x}[2].c <= {x}[3].c, {x}[2], {x}[3])))"


def step(cell: str, cost: str, code: str, note: str) -> str:
    return f"{{'c': {cell}.c + {cost}, 'p': {cell}.p || {code}, 'e': {cell}.e || {note}}}"


def indel_code(x: str, sure: str) -> str:
    return f"(case when {sure} then 'H' when {x} in {WEAK} then 'W' else 'S' end)"


def substitution_code(x: str, y: str, unsure: str) -> str:
    return f"(case when {x} = {y} then 'C' when {x} || {y} in {NEAR} then if({unsure}, 'L', 'N') when {x} in {WEAK} and {y} in {WEAK} then 'W' else 'S' end)"


#: What the edits of a way are cited as, but for the last letter, whose rule a graded pair doesn't cite again.
CODES = {"C": "CLS-1", "N": "CLS-2", "L": "LAT-1", "W": "WEAK-1", "H": "HEB-2"}


def row_tables() -> str:
    """``pair_rows`` after ``score_tables``: (a, b, place, x, y, role, cents, rules, edits) of every pair of names in ``wanted``."""
    add = step("acc[-1]", indel("s2[j]", "w2[j]"), indel_code("s2[j]", "w2[j]"), "' +' || s2[j]")
    put = step("r[j]", substitution("s1[i + 1]", "s2[j]", "(w1[i + 1] or w2[j])"), substitution_code("s1[i + 1]", "s2[j]", "(w1[i + 1] or w2[j])"), "if(s1[i + 1] = s2[j], '', ' ' || s1[i + 1] || '/' || s2[j])")
    drop = lambda cell: step(cell, indel("s1[i + 1]", "w1[i + 1]"), indel_code("s1[i + 1]", "w1[i + 1]"), "' -' || s1[i + 1]")
    ways = f"[{put}, {drop('r[j + 1]')}, {add}]"
    told = ", ".join(f"{{'at': instr(reverse(way), '{k}'), 'rule': '{rule}'}}" for k, rule in CODES.items())
    return f"""met_pairs as (select distinct ta[p.i + 1] as x, tb[p.j + 1] as y from (select a, b, unnest(g.p) as p from taken) join lists using (a, b)),
    edit_rows as (select a, b, s1, s2, w1, w2, 0 as i, list_reduce(range(1, length(s2) + 1), lambda acc, j: acc || [{add}], [{{'c': 0, 'p': '', 'e': ''}}]) as r from token_pairs join met_pairs on x = a and y = b where sure is null and s1 != s2
        union all select a, b, s1, s2, w1, w2, i + 1, list_reduce(range(1, length(s2) + 1), lambda acc, j: acc || [list_transform([{ways}], lambda z: {chosen('z')})[1]], [{drop('r[1]')}]) from edit_rows where i < length(s1)),
    ways as (select a, b, r[-1].c as cost, r[-1].p as way, string_split(trim(r[-1].e), ' ') as edits from edit_rows where i = length(s1)),
    token_rules as (select t.a, t.b, c.cents, case when x.known = y.known then 'LEX-1' when x.known != y.known then 'LEX-2' when x.cons = '' and y.cons = '' then if(x.bare = y.bare, 'SKEL-1', 'MISS-1')
        else concat_ws(',', if(x.cons = y.cons, 'SKEL-1', if(greatest(0.0::double, 1.0::double - (cost / 4.0::double) / greatest(length(x.cons), length(y.cons))) >= 0.6, 'SKEL-2', 'SKEL-3')), if(x.cons = y.cons and x.whole != y.whole, 'WEAK-1', null),
            nullif(array_to_string(list_transform(list_sort(list_filter([{told}], lambda v: v.at > 0)), lambda v: v.rule), ','), ''), if(c.cents = 78 and conflict and (x.cons = y.cons or floor(greatest(0.0, 1.0::double - (cost / 4.0::double) / greatest(length(x.cons), length(y.cons))) * 100 + 0.5) >= 90), 'VOW-1', null)) end as rules, if(x.known is not null and y.known is not null or x.cons = y.cons, [], edits) as edits
        from (select a, b, conflict from token_pairs join met_pairs on x = a and y = b) t join cents c on c.a = t.a and c.b = t.b join t x on x.token = t.a join t y on y.token = t.b left join ways on ways.a = t.a and ways.b = t.b),
    both_sides as (select a, b, n, m, g, ta, tb from taken join lists using (a, b)),
    loose_rows as (select a, b, 0 as kind, p.i as i, ta[p.i + 1] as x, tb[p.j + 1] as y, {role('p.i', 'n')} as role, p.cents as cents, {role('p.i', 'n')} != {role('p.j', 'm')} as moved from (select *, unnest(g.p) as p from both_sides)
        union all select a, b, 1, i, ta[i + 1], '', {role('i', 'n')}, null, false from (select *, unnest(range(n)) as i from both_sides) where not list_contains(g.ui, i)
        union all select a, b, 2, j, '', tb[j + 1], {role('j', 'm')}, null, false from (select *, unnest(range(m)) as j from both_sides) where not list_contains(g.uj, j)
        union all select a, b, 3, 0, coalesce(a, ''), coalesce(b, ''), 3, null, false from wanted left join both_sides using (a, b) where n is null),
    pair_rows as (select r.a, r.b, cast(row_number() over (partition by r.a, r.b order by kind, i) as int) as place, x, y, (['given', 'family', 'middle', ''])[role + 1] as role, case when kind in (1, 2) and role < 2 then 0 else r.cents end as cents,
        case when kind = 0 then t.rules || if(moved, ',ORD-1', '') when kind = 3 then 'MISS-1' when role = 2 then 'TOK-1' else 'TOK-2' end as rules, coalesce(t.edits, []) as edits from loose_rows r left join token_rules t on t.a = x and t.b = y and kind = 0)"""


def score_tables(tokens: str = "", pairs: str = "") -> str:
    """Tokens, rules and attributes of the names in table ``names``, and every score of the pairs in table ``wanted`` (a, b).

    ``tokens`` and ``pairs`` add tokens and pairs of tokens whose skeletons are compared too.
    """
    return f"""known_spellings as (select unnest(string_split(s, ' ')) as spelling, k from (values {", ".join(f"('{n}', '{x}')" for n, x in lx.KNOWN.items())}) v(k, s)),
    raw_tokens as (select name, list_filter(regexp_split_to_array(name, '[\\s،؛]+'), lambda t: t != '') as raw from (select distinct name from names)),
    plain_tokens as (select name, list_filter(list_transform(raw, lambda t: {normal('t')}), lambda t: t != '') as ts,
        list_contains(list_transform(raw, lambda t: case {script('t')} when 'arabic' then regexp_matches(t, '{lx.ARABIC_MARKS}') when 'hebrew' then regexp_matches(t, '{lx.HEBREW_MARKS}') else regexp_matches(t, '[{FOLD_FROM}š]') end), true) as marks,
        list_contains(list_transform(raw, lambda t: {script('t')} = 'hebrew' and regexp_matches(t, '[''’{lx.GERESH}]')), true) as geresh from raw_tokens),
    joined_tokens as (select name, marks, geresh, list_reduce(ts, lambda acc, t: case when acc.held is not null then {{'out': acc.out || [translate(acc.held || t, '-''’', '')], 'held': cast(null as varchar), 'n': acc.n + 1}}
        when translate(t, '-''’', '') in {members(lx.JOINERS)} then {{'out': acc.out, 'held': t, 'n': acc.n}} else {{'out': acc.out || [t], 'held': cast(null as varchar), 'n': acc.n}} end,
        {{'out': cast([] as varchar[]), 'held': cast(null as varchar), 'n': 0}}) as j from plain_tokens),
    whole_tokens as (select name, marks, geresh, j.n as joined, if(j.held is null, j.out, j.out || [j.held]) as ts from joined_tokens),
    kept_tokens as (select name, marks, geresh, joined, if(len(ts) > 1, list_filter(ts, lambda t: t not in {members(lx.PATRONYMICS)}), ts) as ks, len(ts) as n from whole_tokens),
    parts as (select name, unnest(ks) as t, generate_subscripts(ks, 1) as i from kept_tokens),
    stripped as (select name, i, case when k is not null then t when {script('t')} = 'arabic' then if(t like 'ال%' and length(t) > 3, t[3:], t) when {script('t')} = 'hebrew' then if(t like 'אל%' and length(t) > 3, t[3:], t)
        when regexp_matches(t, '^[aeu](sh|th|[lnrstdz])-') then regexp_replace(t, '^[aeu](sh|th|[lnrstdz])-', '') when i > 1 and regexp_matches(t, '^[ae](ll|nn|rr|ss|tt|dd|zz)..') then t[3:]
        when i > 1 and regexp_matches(t, '^[ae]l...') then t[3:] else t end as t,
        case when k is not null then null when {script('t')} = 'arabic' then if(t like 'ال%' and length(t) > 3, 'ART-1', null) when {script('t')} = 'hebrew' then if(t like 'אל%' and length(t) > 3, 'ART-1', null)
        when regexp_matches(t, '^[aeu](sh|th|[lnrstdz])-') then if(regexp_matches(t, '^[aeu]l-'), 'ART-1', 'ART-2') when i > 1 and regexp_matches(t, '^[ae](ll|nn|rr|ss|tt|dd|zz)..') then 'ART-2'
        when i > 1 and regexp_matches(t, '^[ae]l...') then 'ART-1' end as rule from parts left join known_spellings on spelling = translate({normal('t')}, '-''’`ʿʼ ', '')),
    name_parts as (select name, list(t order by i) filter (where t != '') as ts, list(rule order by i) filter (where rule is not null) as articles from stripped group by name),
    name_rules as (select name, array_to_string(if(marks, ['NORM-1'], []) || if(geresh, ['HEB-1'], []) || list_transform(range(joined), lambda x: 'JOIN-1') || list_transform(range(n - len(ks)), lambda x: 'PAT-1') || coalesce(articles, []), ',') as rules from kept_tokens left join name_parts using (name)),
    all_tokens as (select distinct unnest(ts) as token from name_parts {tokens}),
    reduced as (select token, k as known, translate({normal('token')}, '-''’`ʿʼ. ', '') as bare, if({script('token')} = 'latin', nullif(translate(regexp_extract({normal('token')}, '[aeiou]'), 'eo', 'iu'), ''), null) as vowel,
        regexp_extract_all(case {script('token')} when 'arabic' then translate({normal('token')}, '-''’`ʿʼ', '') when 'hebrew' then translate(translate({normal('token')}, '''’', '{lx.GERESH}{lx.GERESH}'), '-`ʿʼ', '')
            else translate({normal('token')}, '-’`ʿʼ', repeat(chr(39), 5)) end, '{GROUPS}') as us from all_tokens left join known_spellings on spelling = translate({normal('token')}, '-''’`ʿʼ ', '')),
    classed as (select *, list_filter(list_transform(us, lambda u, i: {{'c': ({UNITS})[u], 'w': u = 'ch' or (i = len(us) and u in ('h', 'ה'))}}), lambda x: x.c is not null) as cs from reduced),
    runs as (select *, list_reduce(cs, lambda acc, x: if(len(acc) > 0 and acc[-1].c = x.c, acc[:-2] || [{{'c': x.c, 'w': x.w or acc[-1].w}}], acc || [x]), cast([] as struct(c varchar, w boolean)[])) as rs from classed),
    attributes as (select token, known, bare, vowel, coalesce(array_to_string(list_transform(rs, lambda x: x.c), ''), '') as whole, list_filter(rs, lambda x, i: x.c != 'A' and (x.c not in ('W', 'Y') or i = 1)) as kept from runs),
    t as (select token, known, bare, vowel, whole, coalesce(array_to_string(list_transform(kept, lambda x: x.c), ''), '') as cons, list_transform(kept, lambda x: x.w) as weak from attributes),
    lists as (select a, b, p.ts as ta, q.ts as tb from wanted left join name_parts p on p.name = a left join name_parts q on q.name = b),
    grid as (select a, b, i, unnest(tb) as y, generate_subscripts(tb, 1) - 1 as j, x, len(ta) as n, len(tb) as m from (select a, b, unnest(ta) as x, generate_subscripts(ta, 1) - 1 as i, ta, tb from lists)),
    token_pairs as (select x.token as a, y.token as b, x.cons as s1, y.cons as s2, x.weak as w1, y.weak as w2, {LAYERS} end as sure, x.vowel != y.vowel as conflict
        from (select x as p, y as q from grid union select cast(null as varchar), null {pairs}) join t x on x.token = p join t y on y.token = q),
    recursive_rows as (select a, b, s1, s2, w1, w2, 0 as i, list_reduce(range(1, length(s2) + 1), lambda acc, j: acc || [acc[-1] + {indel('s2[j]', 'w2[j]')}], [0]) as r from token_pairs
        union all select a, b, s1, s2, w1, w2, i + 1, list_reduce(range(1, length(s2) + 1), lambda acc, j: acc || [least(r[j] + {substitution('s1[i + 1]', 's2[j]', '(w1[i + 1] or w2[j])')}, r[j + 1] + {indel('s1[i + 1]', 'w1[i + 1]')}, acc[-1] + {indel('s2[j]', 'w2[j]')})], [r[1] + {indel('s1[i + 1]', 'w1[i + 1]')}])
        from recursive_rows where i < length(s1)),
    graded as (select p.a, p.b, case when sure is not null then sure when p.s1 = p.s2 then if(conflict, 78, 100) else cast(floor(greatest(0.0, 1.0::double - (r[-1] / 4.0::double) / greatest(length(p.s1), length(p.s2))) * 100 + 0.5) as int) end as cents, conflict, sure
        from token_pairs p left join recursive_rows d on d.a = p.a and d.b = p.b and d.i = length(d.s1)),
    cents as (select a, b, if(sure is null and cents >= 90 and conflict, 78, cents) as cents from graded),
    cells as (select g.a, g.b, n, m, list({{'cost': -cents, 'i': i, 'j': j, 'cents': cents, 'role': {role('i', 'n')}, 'role_b': {role('j', 'm')}}}) as cs from grid g join cents c on c.a = x and c.b = y group by g.a, g.b, n, m),
    queues as (select a, b, n, m, list_transform(list_filter(list_sort(cs), lambda x: x.cents >= 45), lambda x: {{'i': x.i, 'j': x.j, 'cents': x.cents}})
        || list_transform(list_sort(list_transform(list_filter(cs, lambda x: x.role = x.role_b), lambda x: {{'role': x.role, 'i': x.i, 'j': x.j, 'cents': x.cents}})), lambda x: {{'i': x.i, 'j': x.j, 'cents': x.cents}}) as q from cells),
    taken as (select a, b, n, m, list_reduce(q, lambda acc, x: if(list_contains(acc.ui, x.i) or list_contains(acc.uj, x.j), acc, {{'ui': acc.ui || [x.i], 'uj': acc.uj || [x.j], 'p': acc.p || [{{'i': x.i, 'j': x.j, 'cents': x.cents}}]}}),
        {{'ui': cast([] as bigint[]), 'uj': cast([] as bigint[]), 'p': cast([] as struct(i bigint, j bigint, cents int)[])}}) as g from queues),
    summed as (select a, b, list_reduce(list_sort(g.p), lambda s, x: s + (x.cents / 100.0::double) * {weight('x.i')}, 0.0::double) as weighted, list_reduce(list_sort(g.p), lambda s, x: s + {weight('x.i')}, 0.0::double) as used,
        len(list_filter(range(n), lambda i: not list_contains(g.ui, i) and {role('i', 'n')} = 2)) + len(list_filter(range(m), lambda j: not list_contains(g.uj, j) and {role('j', 'm')} = 2)) as unmatched_middles,
        len(list_filter(range(n), lambda i: not list_contains(g.ui, i) and {role('i', 'n')} < 2)) + len(list_filter(range(m), lambda j: not list_contains(g.uj, j) and {role('j', 'm')} < 2)) as others from taken),
    found_scores as (select a, b, unmatched_middles, cast(floor(greatest(0.0::double, weighted / (used + 0.4::double * others) * 100 - 4 * unmatched_middles) + 0.5) as int) as score from summed),
    scores as (select a, b, coalesce(score, 0) as score, cast(coalesce(unmatched_middles, 0) as int) as unmatched_middles from wanted left join found_scores using (a, b))"""


SCORES = score_tables()
