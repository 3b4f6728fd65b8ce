"""Queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

from framelake.llm import bpe, cooccur, golden, mojibake, overlap, raking, splits, winnow

QUERIES = {
    "p1_found": splits.p1_found,
    "p1_splits": splits.p1_splits,
    "p1_shares": splits.p1_shares,
    "p3_found": cooccur.p3_found,
    "p3_pairs": cooccur.p3_pairs,
    "p4_sample": golden.p4_sample,
    "p5_found": raking.p5_found,
    "p5_report": raking.p5_report,
    "p5_sample": raking.p5_sample,
    "p5_minimums": raking.p5_minimums,
    "p5_available": raking.p5_available,
    "p7_found": overlap.p7_found,
    "p7_pairs": overlap.p7_pairs,
    "p7_counts": overlap.p7_counts,
    "p8_ids": bpe.p8_ids,
    "p8_lengths": bpe.p8_lengths,
    "p9_found": winnow.p9_found,
    "p9_items": winnow.p9_items,
    "p10_found": mojibake.p10_found,
    "p10_restored": mojibake.p10_restored,
}

_SQ = "regexp_replace(lower({0}), '[\\s\\x{{00A0}}_\\-./\\\\+]+', '', 'g')"
_REF = f"ref as (select {_SQ.format('category')} as k, category as nm from category_ref union select {_SQ.format('s')}, category from (select category, unnest(synonyms) as s from category_ref))"
_ITEMS = f"""with {_REF},
li as (select image_id, category, tags, row_number() over (partition by image_id order by ingested_at desc) as rn from image),
ld as (select detection_id, image_id, category, row_number() over (partition by detection_id order by ingested_at desc) as rn from detection),
raw as (select image_id, unnest(tags) as t from li where rn = 1 union all select d.image_id, d.category from ld d join li i on i.image_id = d.image_id and i.rn = 1 where d.rn = 1),
it as (select distinct image_id, nm from raw join ref on k = {_SQ.format('t')}),
tot as (select count(distinct image_id) as n from it), one as (select nm, count(*) as c from it group by nm),
pr as (select a.nm as item_a, b.nm as item_b, count(*) as n_ab from it a join it b on a.image_id = b.image_id and a.nm < b.nm group by all),
al as (select item_a, item_b, n_ab, x.c as n_a, y.c as n_b, n from pr join one x on x.nm = item_a join one y on y.nm = item_b, tot)
"""
_TERM = "case when {0} <= 0 then 0 else {0} * ln({0} * n::double / ({1}::double * {2})) end"
_LLR = "2 * (" + " + ".join(_TERM.format(*x) for x in [("n_ab", "n_a", "n_b"), ("(n_a - n_ab)", "n_a", "(n - n_b)"), ("(n_b - n_ab)", "(n - n_a)", "n_b"), ("(n - n_a - n_b + n_ab)", "(n - n_a)", "(n - n_b)")]) + ")"

#: Number of the identity a text names; wn: and other words before it, zeros and signs around it do not count.
_NUM = "try_cast(regexp_extract(lower(trim({0})), '^[^0-9a-z]*(?:[a-z]+[:_ -])?n?[-_ ]?([0-9]{{1,12}})[^0-9a-z]*$', 1) as bigint)"
_GROUPS = f"""with recursive who as (select {_NUM.format('wordnetid')} as id, {_SQ.format('person_name')} as person, {_NUM.format('same_as')} as same from face_identity),
one as (select distinct * exclude (ingested_at) from face),
fi as (select face_id, coalesce({_NUM.format('wordnetid')}, {_NUM.format('category')}, (select min(id) from who where person = {_SQ.format('category')} and {_NUM.format('category')} is null),
 case when regexp_matches(regexp_extract(lower(filename), '([^/\\\\]+)[/\\\\][^/\\\\]*$', 1), '^n[-_]?[0-9]+$') then {_NUM.format("regexp_extract(lower(filename), '([^/\\\\]+)[/\\\\][^/\\\\]*$', 1)")} end) as id,
 case when lower(trim(photo_id)) not in ('', 'none', 'null', 'unknown', 'n/a', 'nan', '-') and not regexp_matches(lower(trim(photo_id)), '^([a-z]+-)?[a-z]?0+$') then lower(trim(photo_id)) end as photo from one),
ok as (select * from fi where id is not null),
ed as (select a.id as u, b.id as v from ok a join ok b using (photo) where a.id <> b.id union select id, same from who where same is not null union select same, id from who where same is not null),
reach as (select distinct id, id as root from (select id from ok union select u from ed) union select ed.v, reach.root from reach join ed on ed.u = reach.id),
comp as (select id, min(root) as c from reach group by id),
sz as (select c, count(distinct ok.id) as k, min(ok.id) as least from ok join comp using (id) group by c) """


def _core_sql() -> str:
    """A file name's core: without folder, escapes, ending and marks of copying."""
    lit = lambda x: "'" + x.replace("'", "''") + "'"
    c = "regexp_replace(filename, '^.*[/\\\\]', '')"
    c = f"lower(trim(case when contains({c}, '%') then url_decode(replace({c}, '+', ' ')) else {c} end))"
    for pattern in [overlap.ENDING, overlap.ENDING, *[overlap.MARK, overlap.MARK_BEFORE] * 3]:
        c = f"regexp_replace({c}, {lit(pattern)}, '')"
    return c


_KEY = r"'^\s*([a-z][a-z0-9_.-]*?)\s*[:/#|]\s*(?:[a-z]+\s*[:/#|]\s*)?([0-9]{1,18})\s*$'"
_SAME = f"""with {_REF},
li as (select * from (select *, row_number() over (partition by image_id order by ingested_at desc) as rn from image) where rn = 1),
sp as (select image_id, source_name, case when {_SQ.format('split_name')} in ('train', 'trn', 'training') then 'train' when {_SQ.format('split_name')} in ('val', 'valid', 'validation', 'dev') then 'val' when {_SQ.format('split_name')} in ('test', 'tst', 'testing') then 'test' end as split,
 regexp_extract(lower(instanceid), {_KEY}, 1) as src, try_cast(regexp_extract(lower(instanceid), {_KEY}, 2) as bigint) as num, nm, regexp_replace({_core_sql()}, '[^\\p{{L}}\\p{{N}}]+', '', 'g') as flat from li left join ref on k = {_SQ.format('category')}),
im as (select *, regexp_replace(flat, '([0-9])', '\\1\\1\\1', 'g') as letters, regexp_replace(flat, '[^0-9]+', '', 'g') as digits from sp where split is not null),
pr as (select t.image_id as t, e.image_id as h from im t join im e on t.src = e.src and t.num = e.num where t.split = 'train' and e.split <> 'train'
 union select t.image_id, e.image_id from im t join im e on t.nm = e.nm and t.digits = e.digits and abs(length(t.letters) - length(e.letters)) <= 2 and levenshtein(t.letters, e.letters) <= 2 where t.split = 'train' and e.split <> 'train' and t.flat <> '' and e.flat <> '') """

ORACLES = {
    "p1_found": _GROUPS + "select ok.face_id, 'n' || lpad(least::varchar, 8, '0') as group_id from ok join comp using (id) join sz using (c) where k >= 2",
    "p7_found": _SAME + "select least(t, h) as image_id_a, greatest(t, h) as image_id_b from pr",
    "p7_counts": _SAME + "select split, source_name, count(*) as pairs, count(distinct h) as held_images, count(distinct t) as train_images from pr join im on im.image_id = pr.h group by 1, 2",
    "p1_shares": "select split_name, true as near, true as whole_groups from split_target where permille > 0",
    "p5_minimums": "select field_name, key_name, true as met from sample_target",
    "p5_available": f"""with {_REF},
li as (select image_id, category, tags, row_number() over (partition by image_id order by ingested_at desc) as rn from image),
m as (select count(*) // 10 as m from li where rn = 1),
have as (select 'category' as f, nm, count(*) as c from li join ref on k = {_SQ.format('category')} where rn = 1 group by all
 union all select 'tag', nm, count(distinct image_id) from (select image_id, unnest(tags) as t from li where rn = 1) join ref on k = {_SQ.format('t')} group by all)
select field_name, key_name, greatest(t.min_rows, t.target_permille * m // 1000)::bigint as required, coalesce(h.c, 0) as available from sample_target t cross join m left join have h on h.f = t.field_name and h.nm = t.key_name""",
    "p3_found": _ITEMS + "select item_a, item_b from al where n_ab >= 5 and n_ab * n >= 3 * n_a * n_b",
    "p3_pairs": _ITEMS
    + f"select item_a, item_b, n_ab, n_a, n_b, round(n_ab * n::double / (n_a::double * n_b), 6) as lift, round(case when n_ab * n::double / (n_a::double * n_b) >= 1 then 1 else -1 end * ({_LLR}), 4) as llr from al",
    "p4_sample": golden.ORACLE,
    "p5_found": f"""with {_REF},
li as (select image_id, category, tags, row_number() over (partition by image_id order by ingested_at desc) as rn from image),
m as (select count(*) // 10 as m from li where rn = 1),
have as (select 'category' as f, nm, count(*) as c from li join ref on k = {_SQ.format('category')} where rn = 1 group by all
 union all select 'tag', nm, count(distinct image_id) from (select image_id, unnest(tags) as t from li where rn = 1) join ref on k = {_SQ.format('t')} group by all)
select field_name, key_name from sample_target t cross join m left join have h on h.f = t.field_name and h.nm = t.key_name
where coalesce(h.c, 0) < greatest(t.min_rows, t.target_permille * m // 1000)""",
}
