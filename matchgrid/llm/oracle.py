"""SQL for the queries that SQL can express; it runs on DuckDB."""

from __future__ import annotations

from . import quality_rules as qr

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x20\x09-\x0D]+"


def _folded(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}')"


def near_dup(k: int = 4, percent: int = 80) -> str:
    return f"""with recursive d as (select doc_id, regexp_extract_all({_folded('text')}, '{_WORD}') as ws from documents),
n as (select doc_id, ws, least({k}, len(ws)) as k from d where len(ws) > 0),
s as (select distinct doc_id, array_to_string(ws[i:i + k - 1], ' ') as sh from n, unnest(generate_series(1, len(ws) - k + 1)) t(i)),
z as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as m from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join z x on x.doc_id = a join z y on y.doc_id = b where 100 * m >= {percent} * (x.n + y.n - m)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id as a, doc_id as b from d union select r.a, e.b from r join e on r.b = e.a),
c as (select a as doc_id, min(b) as component_id from r group by 1)
select d.doc_id, coalesce(z.n, 0) as n_shingles, component_id, d.doc_id = component_id as kept from d join c using (doc_id) left join z using (doc_id)"""


def contamination(width: int = 13) -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""with i as (select item_id, regexp_extract_all({_folded('text')}, '{word}') as ws from benchmark),
iw as (select distinct cast(item_id as varchar) as item, least({width}, len(ws)) as n, array_to_string(ws[a:a + least({width}, len(ws)) - 1], ' ') as k
  from i, unnest(generate_series(1, len(ws) - least({width}, len(ws)) + 1)) t(a) where len(ws) > 0),
d as (select doc_id, regexp_extract_all({_folded('text')}, '{word}') as ws from documents),
dw as (select doc_id, a, n, array_to_string(ws[a:a + n - 1], ' ') as k from d, (select distinct n from iw) w, unnest(generate_series(1, len(ws) - n + 1)) t(a) where len(ws) >= n),
h as (select dw.* from dw semi join iw using (n, k)),
c as (select doc_id, count(distinct p) as n_hit from h, unnest(generate_series(a, a + n - 1)) t(p) group by 1),
m as (select doc_id, list_sort(list(distinct item)) as items from h join iw using (n, k) group by 1)
select doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, cast(coalesce(len(items), 0) as bigint) as n_items,
sha256(coalesce(array_to_string(items, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from d left join c using (doc_id) left join m using (doc_id)"""


def hard_negatives() -> str:
    return """with e as (select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [floor(256 * cast(x as double)) for x in embedding] as v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.id as a, a.label = c.label as same, c.id as c, cast(coalesce(list_inner_product(a.v, c.v), 0) as bigint) as score from e a join e c on a.id <> c.id where a.id % 50 = 0),
p as (select a, c as p, score as ps from s where same qualify row_number() over (partition by a order by score desc, c) <= 5),
n as (select p.a, p.p, p.ps, s.c, s.score, row_number() over (partition by p.a, p.p order by s.score desc, s.c) as rank
  from p join s on s.a = p.a and not s.same and 50 * ps <= 100 * s.score and 100 * s.score <= 95 * ps)
select a as anchor_id, p as positive_id, cast(rank as int) as rank, c as negative_id, ps as positive_score, score as negative_score from n where rank <= 3"""


def source_divergence(least: int = 3, top: int = 200) -> str:
    p = "cast(1 + (1000000000 * cast({} + 1 as hugeint)) // ({} + v) as bigint)"
    f = "((p - q) * (p - q)) // q"
    return f"""with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
  regexp_extract_all({_folded('text')}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as ts from documents),
t as (select id, lang, source, unnest(ts) as term from d),
k as (select lang, term, cast(count(*) as bigint) as lang_n from t group by 1, 2 having count(distinct id) >= {least}),
c as (select t.lang, t.source, t.term, cast(count(*) as bigint) as n from t join k on t.lang = k.lang and t.term = k.term group by 1, 2, 3),
l as (select lang, cast(sum(lang_n) as bigint) as lang_size, count(*) as v from k group by 1),
g as (select d.lang, d.source, coalesce(size, 0) as size, coalesce(v, 0) as v, coalesce(lang_size, 0) as lang_size from (select distinct lang, source from d) d
  left join (select lang, source, cast(sum(n) as bigint) as size from c group by 1, 2) s on d.lang = s.lang and d.source = s.source left join l on d.lang = l.lang),
x as (select g.lang, g.source, k.term, coalesce(n, 0) as n, {p.format('coalesce(n, 0)', 'size')} as p, {p.format('lang_n', 'lang_size')} as pl
  from g join k on g.lang = k.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
pv as (select lang, a as source, b as item, sum({f}) as value from (select a.lang, a.source as a, b.source as b, a.p, b.p as q from x a join x b on a.lang = b.lang and a.term = b.term and a.source <> b.source) group by 1, 2, 3),
pr as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source
  left join pv on pv.lang = a.lang and pv.source = a.source and pv.item = b.source),
tv as (select lang, source, 'term' as part, term as item, {f} as value from (select lang, source, term, p, pl as q from x where n > 0 and p > pl)),
r as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from pr union all select * from tv))
select lang, source, part, item, cast(value as bigint) as value, cast(rank as int) as rank from r where part = 'pair' or rank <= {top}"""


def quality_rules() -> str:
    found = ", ".join(f"len(list_filter(ws, lambda x: x = '{w}'))" for w in qr.WORDS)
    some = ", ".join(f"'{w}'" for w in qr.WORDS)
    left = lambda others: f"length(regexp_replace(j, '{others}+', '', 'g'))"
    chars, words = 6, len(qr.WORDS) + 1
    part = "case when {0} > 0 then {0} * log2({0} / (({0} + {1}) / 2)) else 0 end"

    def distance(own: str, total: str, ref: str, n: int) -> str:
        p, q = f"{own}[i] / {total}", f"{ref}[i]"
        return f"sqrt(greatest(list_sum([{part.format(f'({p})', q)} + {part.format(q, f'({p})')} for i in generate_series(1, {n})]) / 2, 0))"

    return f"""with d as (select doc_id, lang, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{_WORD}') as ws from documents),
b as (select *, array_to_string(ws, '') as j, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) as ls from d),
w as (select doc_id, i, array_to_string(ws[i:i + 4], ' ') as k from d, unnest(generate_series(1, len(ws) - 4)) u(i)),
r as (select doc_id, i from w qualify count(*) over (partition by doc_id, k) > 1),
v as (select doc_id, count(distinct p) as n from r, unnest(generate_series(i, i + 4)) u(p) group by 1),
m as (select b.doc_id, lang, cast(len(ws) as bigint) as n_words, cast(length(j) as bigint) as word_chars, cast({left('[^#*$%&|<>]')} as bigint) as n_symbols,
  cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, coalesce(v.n, 0) as n_repeat_words,
  {left(r'\P{Lu}')} as up, {left('[^0-9]')} as dg, {left(r'[\p{L}\p{N}#*$%&|<>]')} as mk, [{found}, len(list_filter(ws, lambda x: x not in ({some})))] as wc from b left join v using (doc_id)),
f as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, [greatest(word_chars - up - dg - n_symbols - mk, 0), up, dg, n_symbols, mk, n_words] as cc from m),
g as (select * from f where not base_failed and lang is not null),
ru as (select lang, i, sum(cc[i]) as s from g, unnest(generate_series(1, {chars})) u(i) group by 1, 2), rc as (select lang, list(s order by i) as s from ru group by 1),
wu as (select lang, i, sum(wc[i]) as s from g, unnest(generate_series(1, {words})) u(i) group by 1, 2), rw as (select lang, list(s order by i) as s from wu group by 1),
q as (select rc.lang, [cast(x as double) / list_sum(rc.s) for x in rc.s] as cs, [cast(x as double) / list_sum(rw.s) for x in rw.s] as wsh from rc join rw on rc.lang = rw.lang),
o as (select f.*, case when word_chars >= {qr.LEAST_CHARS} and cs is not null then {distance('cc', '(word_chars + n_words)', 'cs', chars)} end as cd,
  case when n_words >= {qr.LEAST_WORDS} and wsh is not null then {distance('wc', 'n_words', 'wsh', words)} end as wd from f left join q on f.lang = q.lang)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
not base_failed and not coalesce(cd >= {qr.CHAR_DISTANCE}, false) and not coalesce(wd >= {qr.WORD_DISTANCE}, false) as kept from o"""
