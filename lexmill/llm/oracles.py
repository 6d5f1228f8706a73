"""SQL twins of the queries that SQL can express, as DuckDB runs them over the same tables."""

from __future__ import annotations

from .secrets import KINDS

_WORDS = r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"

NEAR_DEDUP = f"""
with recursive d as (select doc_id, {_WORDS} as words from documents),
w as (select doc_id, len(words) as n, unnest(words) as word, generate_subscripts(words, 1) as pos from d),
s as (
    select doc_id, n, pos, list(word) over (partition by doc_id order by pos rows between current row and 4 following) as shingle from w
),
bag as (select doc_id, shingle, count(*) as c from s where pos <= greatest(n - 4, 1) group by all),
total as (select doc_id, sum(c) as t from bag group by all),
pair as (
    select a.doc_id as a, b.doc_id as b, sum(least(a.c, b.c)) as common
    from bag a join bag b on a.shingle = b.shingle and a.doc_id < b.doc_id group by all
),
link as (
    select a, b from pair join total x on x.doc_id = a join total y on y.doc_id = b where common >= 0.8 * (x.t + y.t - common)
),
both_ways as (select a, b from link union all select b, a from link),
reach as (
    select doc_id as a, doc_id as b from documents
    union
    select r.a, e.b from reach r join both_ways e on r.b = e.a
),
class as (select a as doc_id, min(b) as class_id, count(*) as copies from reach group by all)
select doc_id, class_id, copies, doc_id = class_id as kept from class
"""

LINE_DEDUP = r"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 as pos from documents),
w as (select doc_id, pos, regexp_extract_all(line, '[^\x20\x09-\x0D]+') as words from l),
lines as (select words, len(words) as n, min({'d': doc_id, 'a': pos}) as first from w where len(words) > 0 group by all),
v as (
    select words, n, first, i, list_concat(words[1 : i - 1], words[i + 1 :]) as rest
    from (select *, unnest(generate_series(1, n)) as i from lines where n >= 5)
),
replaced as (select v.words, e.first from v join (select rest, i, min(first) as first from v group by all) e using (rest, i)),
inserted as (select v.words, b.first from v join lines b on b.words = v.rest where b.n >= 5 union all select b.words, v.first from v join lines b on b.words = v.rest where b.n >= 5),
bound as (select words, min(first) as bound from (select words, first from lines union all from replaced union all from inserted) group by all),
gone as (select doc_id, pos from w join bound using (words) where {'d': doc_id, 'a': pos} > bound)
select d.doc_id, len(string_split(coalesce(text, ''), chr(10))) as n_lines, count(gone.pos) as n_removed,
    coalesce(list(gone.pos::int order by gone.pos) filter (gone.pos is not null), []) as removed
from documents d left join gone using (doc_id) group by d.doc_id, text
"""

SUBSTRING_DEDUP = f"""
with d as (select doc_id, {_WORDS} as words from documents),
w as (select doc_id, len(words) as n, unnest(words) as word, generate_subscripts(words, 1) as pos from d),
s as (select doc_id, n, pos, word, list(word) over (partition by doc_id order by pos rows between current row and 19 following) as words from w),
later as (
    select doc_id, pos, word, pos <= n - 19 and row_number() over (partition by case when pos <= n - 19 then words end order by doc_id, pos) > 1 as again from s
),
judged as (select *, bool_or(again) over (partition by doc_id order by pos rows between 19 preceding and current row) as gone from later)
select d.doc_id, len(d.words) as n_words, count(*) filter (gone) as n_removed,
    sha256(coalesce(string_agg(word, ' ' order by pos) filter (not gone), '')) as kept_sha256
from d left join judged using (doc_id) group by d.doc_id, len(d.words)
"""


def _secrets(copied_owners: int = 3, copied_repositories: int = 1000) -> str:
    kinds = " union all ".join(
        f"select text, {k} as rank, '{kind}' as kind, {least} as least, string_split_regex(text, '{pattern}') as gaps, "
        f"regexp_extract_all(text, '{pattern}', 0) as matches, regexp_extract_all(text, '{pattern}', {group}) as vals from t"
        for k, (kind, pattern, group, least) in enumerate((kind, pattern.replace("'", "''"), group, least) for kind, pattern, group, least in KINDS)
    )
    return f"""
with t as (select distinct text from documents where text is not null),
f as ({kinds}),
x as (
    select text, rank, kind, least, i, len(gaps[i]) as g, len(matches[i]) as m, vals[i] as v
    from (select *, unnest(generate_series(1, len(matches))) as i from f)
),
p as (select *, (sum(g + m) over (partition by text, rank order by i))::bigint as e from x),
spans as (
    select text, rank, kind, e - m as s, e, v,
        regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Za-z]') and len(list_distinct(string_split(v, ''))) >= 8 as live
    from p where len(v) >= least
),
kept as (
    select * from spans a where rank < 3
    or (live and not exists (select 1 from spans b where b.text = a.text and b.rank < 3 and b.s < a.e and a.s < b.e))
),
holders as (select distinct text, coalesce('s' || source, 'n') as owner, coalesce(doc_id::varchar, 't' || md5(text)) as repository from documents),
held as (select v, owner, repository from (select distinct text, v from kept) join holders using (text)),
counted as (select v, count(distinct owner) as owners, count(distinct repository) as repositories from held group by v),
judged as (
    select kept.*, owners, repositories,
        case when owners >= {copied_owners} or repositories >= {copied_repositories} then 'example' when live then 'live' else 'weak' end as verdict
    from kept join counted using (v)
),
per_text as (
    select text, count(*) filter (rank = 0) as n_assign, count(*) filter (rank = 1) as n_access, count(*) filter (rank = 2) as n_hex,
        coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) filter (rank < 3), '') as base,
        string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) as spans,
        count(*) filter (verdict = 'live') as n_live, count(*) filter (verdict = 'example') as n_example,
        max(repositories) as repositories, max(owners) as owners
    from judged where rank < 3 or verdict = 'live' group by text
)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256,
    coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live, coalesce(n_example, 0) as n_example,
    coalesce(repositories, 0) as repositories, coalesce(owners, 0) as owners
from documents left join per_text using (text)
"""


SECRET_OWNERS = _secrets()

DECONTAMINATION = r"""
with texts as (select distinct doc_id, text from documents where text is not null),
d as (select *, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as words from texts),
i as (
    select text as item, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as words
    from (select distinct text from benchmark where text is not null)
),
dw as (select doc_id, text, len(words) as dn, unnest(words) as word, generate_subscripts(words, 1) - 1 as pos from d),
iw as (select item, len(words) as n, unnest(words) as word, generate_subscripts(words, 1) - 1 as pos from i),
hit as (select doc_id, text, dn, item, n, dw.pos - iw.pos as shift, iw.pos from dw join iw using (word)),
close as (
    select *, count(*) over (partition by doc_id, text, item, shift) as same, row_number() over (partition by doc_id, text, item, shift order by pos) as k from hit
    qualify 5 * count(*) over (partition by doc_id, text, item, shift) >= 4 * least(n, 13)
),
stretch as (
    select doc_id, text, item, n, shift, 0 as low, n as high, same from close where n < 13 and k = 1 and shift >= 0 and shift + n <= dn and 5 * same >= 4 * n
    union all
    select a.doc_id, a.text, a.item, a.n, a.shift, a.pos as low, b.pos + 1 as high, b.k - a.k + 1 as same
    from close a join close b on a.doc_id = b.doc_id and a.text = b.text and a.item = b.item and a.shift = b.shift and a.pos <= b.pos
    where a.n >= 13 and b.pos + 1 - a.pos >= 13 and 5 * (b.k - a.k + 1) >= 4 * (b.pos + 1 - a.pos)
),
best as (select * from stretch qualify row_number() over (partition by doc_id, text, item order by high - low desc, shift desc, high) = 1)
select distinct doc_id, item_id, low + shift as doc_at, high - low as overlap_words, same as same_words, n as item_words
from best join benchmark on benchmark.text = best.item
"""

INFILL = r"""
with d as (
    select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u,
        sha256('42:' || coalesce(doc_id::varchar, 'null')) as d
    from documents
),
h as (
    select *, len(u) as n, ('0x' || d[1:8])::ubigint::bigint as h1, ('0x' || d[9:16])::ubigint::bigint as h2,
        ('0x' || d[17:24])::ubigint::bigint as h3, ('0x' || d[25:32])::ubigint::bigint as h4
    from d
),
f as (
    select *, case when n = 0 or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain'
        when h4 % 100 < 80 then 'spm' else 'psm' end as form, least(h1 % (n + 1), h2 % (n + 1)) as low, greatest(h1 % (n + 1), h2 % (n + 1)) as high
    from h
),
p as (
    select *, array_to_string(u[1:low], '') as prefix, array_to_string(u[low + 1 : high], '') as middle, array_to_string(u[high + 1 :], '') as suffix from f
)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
    sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256, sha256(text) as restored_sha256
from p
"""

#: CRC-32 by its table, over the UTF-8 bytes of letters up to U+00FF.
SPELLING = r"""
with recursive t as (
    select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) as crc
),
r as (select coalesce(doc_id::varchar, 'null') as id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) as run from documents),
l as (select id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as n from r where length(run) >= 6 group by all),
b as (
    select run, n, flatten(list_transform(string_split(id || ':' || run, ''), lambda c: case when ord(c) < 128 then [ord(c)] else [192 + ord(c) // 64, 128 + ord(c) % 64] end)) as bytes
    from l
),
h as (
    select run, n, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(bytes, lambda x: x::bigint)),
        lambda c, x: xor(c // 256, t.crc[(xor(c, x) % 256) + 1]))) as h
    from b, t
),
w as (
    select case when h % 199 = 0 then run[1 : h % length(run)] || run[h % length(run) + 2 :] else run end as word, sum(n)::bigint as n from h group by 1
),
v as (select word, n from w where length(word) >= 6 and n >= 5),
x as (select word, n, i, word[1 : i - 1] || word[i + 1 :] as rest from (select *, unnest(generate_series(1, length(word))) as i from v)),
pair as (
    select a.word as a, b.word as b, b.n from x a join x b on a.rest = b.rest and a.i = b.i and a.word <> b.word
    union select x.word, v.word, v.n from x join v on v.word = x.rest
    union select v.word, x.word, x.n from x join v on v.word = x.rest
),
best as (select a as word, count(*) as n_near, max(n) as most, arg_max(b, {'n': n, 'b': -rank}) as near from (select *, rank() over (order by b) as rank from pair) group by a),
f as (
    select v.word, v.n, coalesce(n_near, 0) as n_near, case when most >= 5 * n then near end as form, case when most >= 5 * n then most end as form_n
    from v left join best using (word)
),
chain as (
    select word, form as at from f where form is not null
    union all
    select c.word, f.form from chain c join f on f.word = c.at where f.form is not null
),
root as (select c.word, c.at as root from chain c join f on f.word = c.at where f.form is null)
select word, form, coalesce(root, word) as root, n, n_near, form_n from f left join root using (word)
"""
