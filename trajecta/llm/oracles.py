"""SQL twins (DuckDB) of the queries that SQL can say."""

from __future__ import annotations

from trajecta.llm import rules

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str, breaks: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{breaks}'), lambda x: x <> '')"


DECONTAMINATION = rf"""with d as (select doc_id, {_words(_FOLDED, r'[\x00-\x2F\x3A-\x60\x7B-\x7F]+')} w from documents),
 b as (select item_id, {_words(_FOLDED, r'[\x00-\x2F\x3A-\x60\x7B-\x7F]+')} w from benchmark),
 bi as (select item_id, w, least(13, len(w)) l, unnest(range(1, len(w) - least(13, len(w)) + 2)) i from b where len(w) > 0),
 bw as (select distinct item_id, l, array_to_string(w[i:i + l - 1], ' ') s from bi),
 di as (select doc_id, w, l, unnest(range(1, len(w) - l + 2)) i from d, (select distinct l from bw)),
 h as (select doc_id, di.l, i, item_id from di join bw on di.l = bw.l and array_to_string(w[i:i + di.l - 1], ' ') = s),
 n as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + l)) p from h) group by 1),
 k as (select doc_id, count(*) n_items, string_agg(t, ',' order by t) ids from (select distinct doc_id, cast(item_id as varchar) t from h) group by 1)
select doc_id, len(w) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join n using (doc_id) left join k using (doc_id)"""


def _jaccard(percent: int, more: str = "") -> str:
    return rf"""with recursive d as (select doc_id, {_words(_FOLDED, r'[\x20\x09-\x0D]+')} w from documents),
 g as (select doc_id, case when len(w) = 0 then []::varchar[] when len(w) < 3 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) end s from d),
 u as (select doc_id, len(s) n, unnest(s) x from g),
 p as (select a.doc_id a, b.doc_id b from u a join u b on a.x = b.x and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
 e as (select a, b from p union select b, a from p),
 r(a, c) as (select doc_id, doc_id from g union select e.b, r.c from r join e on r.a = e.a and r.c < e.b)
select g.doc_id, len(s) n_shingles, m component_id{more} from g join (select a, min(c) m from r group by 1) on a = doc_id"""


JACCARD, NEAR_DUPLICATES = _jaccard(90), _jaccard(85, ", doc_id = m kept")

HARD_NEGATIVES = """with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end l, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) e from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 s as (select a.vec_id a, b.vec_id b, a.l = b.l same, coalesce(list_sum(list_transform(range(1, least(len(a.e), len(b.e)) + 1), lambda i: a.e[i] * b.e[i])), 0)::bigint s from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
 p as (select a, b p, s ps from s where same qualify row_number() over (partition by a order by s desc, b) <= 5)
select p.a anchor_id, p positive_id, row_number() over (partition by p.a, p order by s desc, b)::integer as rank, b negative_id, ps positive_score, s negative_score
from p join s on p.a = s.a and not same and 50 * ps <= 100 * s and 100 * s <= 95 * ps qualify rank <= 3"""


def _quality_rules() -> str:
    classes = "".join(f", len(regexp_extract_all(t, '{p}')) {n}" for n, p in rules.CLASSES.items())
    names = ["n_symbols", "n_chars - word_chars", *rules.CLASSES]
    values = [*names, f"greatest(n_chars - ({' + '.join(names)}), 0)"]
    chars = " union all ".join(f"select doc_id, lang, 'chars' kind, {i} i, ({v})::double v from m" for i, v in enumerate(values))
    common = []
    for language, listed in rules.COMMON.items():
        listed = listed.split()
        common += [f"select doc_id, lang, 'common' kind, {i} i, len(list_filter(low, lambda x: x = '{w}'))::double v from m where lang = '{language}'" for i, w in enumerate(listed)]
        every = ", ".join(f"'{w}'" for w in listed)
        common.append(f"select doc_id, lang, 'common' kind, {len(listed)} i, len(list_filter(low, lambda x: x not in ({every})))::double v from m where lang = '{language}'")
    return rf"""with t as (select doc_id, lang, coalesce(text, '') t, {_words("coalesce(text, '')", r'[\x20\x09-\x0D]+')} w from documents),
 m as (select doc_id, lang, w, list_transform(w, lambda x: lower(x)) low, len(w) n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint word_chars, length(t) n_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls{classes} from t),
 gr as (select doc_id, i, count(*) over (partition by doc_id, s) n from (select doc_id, i, array_to_string(w[i:i + 2], ' ') s from (select doc_id, w, unnest(range(1, len(w) - 1)) i from m))),
 rp as (select doc_id, count(distinct p) n from (select doc_id, unnest(range(i, i + 3)) p from gr where n > 1) group by 1),
 v as ({chars} union all {" union all ".join(common)}),
 bf as (select m.doc_id, n_words < 50 or 100 * coalesce(rp.n, 0) > 50 * n_words f from m left join rp using (doc_id)),
 rf as (select lang, kind, i, sum(v) r from v join bf using (doc_id) where not f group by 1, 2, 3 having count(*) >= {rules.MIN_DOCS}),
 q as (select doc_id, v.kind, v / nullif(sum(v) over (partition by doc_id, v.kind), 0) a, r / nullif(sum(r) over (partition by doc_id, v.kind), 0) b from v left join rf on v.lang is not distinct from rf.lang and v.kind = rf.kind and v.i = rf.i),
 js as (select doc_id, kind, sqrt(greatest(sum(case when a > 0 then a * log2(2 * a / (a + b)) else 0 end + case when b > 0 then b * log2(2 * b / (a + b)) else 0 end) / 2, 0)) d from q where a is not null and b is not null group by 1, 2),
 o as (select m.doc_id, n_words, word_chars, n_symbols, len(ls) - len(list_distinct(ls)) n_dup_lines, coalesce(rp.n, 0) n_repeat_words, n_chars, x.d cd, y.d wd, n_words < 50 or 100 * coalesce(rp.n, 0) > 50 * n_words base_failed
  from m left join rp using (doc_id) left join js x on m.doc_id = x.doc_id and x.kind = 'chars' left join js y on m.doc_id = y.doc_id and y.kind = 'common')
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not coalesce(n_chars >= {rules.MIN_CHARS} and cd > {rules.MAX_CHAR_DISTANCE}, false) and not coalesce(n_words >= {rules.MIN_WORDS} and wd > {rules.MAX_WORD_DISTANCE}, false) kept,
 round(cd, 6) + 0.0 char_distance, round(wd, 6) + 0.0 word_distance from o"""


QUALITY_RULES = _quality_rules()
