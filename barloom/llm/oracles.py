"""DuckDB SQL for the queries that SQL can express. Each states its result from the contract, not from the operator's method."""

from __future__ import annotations

from .mixing import LONG

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_STRATUM = "case when source is null then '1' else '0' || source end"


def _lower(x: str) -> str:
    return f"translate({x}, '{_UPPER}', '{_LOWER}')"


def _crc_table() -> str:
    """The CRC of each half byte."""
    out = []
    for i in range(16):
        for _ in range(4):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        out.append(str(i))
    return f"[{', '.join(out)}]::bigint[]"


# A CRC by half bytes, the low half of each byte first.
_CRC = f"""xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, 2 * octet_length(encode(coalesce(text, '')))), lambda i:
    instr('123456789ABCDEF', substr(hex(encode(coalesce(text, ''))), (i + 1 - 2 * (i % 2) + 1)::int, 1))::bigint)), lambda acc, v: xor(acc >> 4, ({_crc_table()})[(xor(acc, v) & 15) + 1])))"""

SHARDING = f"""with k as (select doc_id, {_STRATUM} as st, octet_length(encode(coalesce(text, ''))) + 1 as size, {_CRC} as crc, md5('0:' || coalesce(doc_id::varchar, '-') || ':' || md5(coalesce(text, ''))) as key from documents),
    f as (select *, (row_number() over (partition by st order by key, crc, size) - 0.5::double) / count(*) over (partition by st) as f from k),
    p as (select *, row_number() over (order by f, key, st, crc, size) - 1 as pos, count(*) over () as n from f)
    select doc_id, size::bigint as size, crc as text_crc32, 'rows' as law, (pos * 16 // n)::int as shard, pos - ((pos * 16 // n) * n + 15) // 16 as slot, null::int as grown_shard from p"""

LINES = f"""with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents), l as (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as pos from d),
    k as (select *, {_lower(f"trim(line, {_SPACE})")} as key from l), f as (select key from k where length(key) >= 1 group by key having count(distinct doc_id) >= 10)
    select doc_id, count(*) as n_lines, count(f.key) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where f.key is null), '')) as kept_sha256 from k left join f using (key) group by 1"""

MIXING = f"""with d as (select doc_id, {_STRATUM} as st, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as size, md5('0:' || coalesce(doc_id::varchar, '-') || ':' || md5(coalesce(text, ''))) as key from documents),
    s as (select st, sum(size)::double as s, ((row_number() over (order by st) - 1) % 3 + 1)::double as w from d group by 1),
    r as (select *, 3 * s as cap, 3 * s / w as ratio, sum(s) over () as total, coalesce(sum(3 * s) over (order by 3 * s / w, st rows between unbounded preceding and 1 preceding), 0) as full_, sum(w) over (order by 3 * s / w, st rows between current row and unbounded following) as open_ from s),
    v as (select arg_min((total - full_) / open_, ratio) as at_ from r where ratio >= (total - full_) / open_),
    t as (select st, s, case when ratio <= at_ then cap else w * at_ end as target from r, v), q as (select *, floor(target / nullif(s, 0)) as q from t), e as (select *, least(coalesce(q, 0), 3) as times0, target - least(coalesce(q, 0), 3) * s as rest from q),
    x as (select d.*, s, target, times0, rest, size * {LONG} > s as long_ from d join e using (st)),
    y as (select *, sum(size) over (partition by st, long_) as kind_size, coalesce(sum(size) over (partition by st, long_ order by key, size rows between unbounded preceding and 1 preceding), 0) + size / 2 as middle from x),
    a as (select *, long_ and size > 0 and middle <= rest * kind_size / greatest(s, 1) as extra0 from y), g as (select *, rest - sum(case when extra0 then size else 0 end) over (partition by st) as left_ from a),
    z as (select *, case when size > 0 then least(times0 + (extra0 or (not long_ and middle <= left_))::int, 3) else 0 end::bigint as times from g)
    select doc_id, size::bigint as size, s::bigint as source_size, target, times * size as taken, times from z"""

_WORDS = "regexp_extract_all(" + _lower("coalesce(text, '')") + ", '[a-z0-9\\x{80}-\\x{10FFFF}]+')"
CONTAMINATION = f"""with b0 as (select coalesce(item_id::varchar, '') as item, {_WORDS} as w from benchmark), b as (select item, w, least(13, len(w)) as n from b0 where len(w) > 0),
    bw as (select distinct item, n, array_to_string(w[i:i + n - 1], ' ') as win from (select item, w, n, unnest(range(1, len(w) - n + 2)) as i from b)), ns as (select distinct n from b),
    d as (select doc_id, {_WORDS} as w from documents), dw as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as win from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, ns)),
    hit as (select doc_id, i, dw.n, item from dw join bw on dw.win = bw.win and dw.n = bw.n), cover as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hit) group by 1),
    items as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as names from hit group by 1)
    select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit > 0 and 20 * n_hit >= len(w), false) as contaminated from d left join cover using (doc_id) left join items using (doc_id)"""

_TOKENS = "regexp_extract_all(" + _lower("coalesce(text, '')") + ", '[^\\x20\\x09-\\x0D]+')"
NEAR = f"""with recursive d as (select doc_id, {_TOKENS} as w from documents), g as (select doc_id, w, least(4, len(w)) as k from d where len(w) > 0),
    s as (select distinct doc_id, array_to_string(w[i:i + k - 1], chr(10)) as s from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from g)), n as (select doc_id, count(*) as n from s group by 1),
    j as (select a.doc_id as a, b.doc_id as b, count(*) as both_ from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
    e as (select a, b from j join n x on x.doc_id = a join n y on y.doc_id = b where 100 * both_ >= 80 * (x.n + y.n - both_)), arcs as (select a, b from e union select b, a from e),
    reach as (select a as doc_id, b as other from arcs union select reach.doc_id, arcs.b from reach join arcs on arcs.a = reach.other), c as (select doc_id, least(doc_id, min(other)) as component_id from reach group by doc_id)
    select d.doc_id, coalesce(n, 0) as n_shingles, coalesce(component_id, d.doc_id) as component_id, d.doc_id = coalesce(component_id, d.doc_id) as kept from d left join n using (doc_id) left join c using (doc_id)"""

_PLAIN = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
AUDIT = f"""with k as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, {_PLAIN} as w from documents),
    l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by 1),
    f as (select part, (len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t))::int + 8 * regexp_matches(t, '[#$%&*|]')::int
        + 16 * (doc_id > min(doc_id) over (partition by t))::int as mask, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic from k left join l using (doc_id)),
    m as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by 1, 2), c as (select unnest(['A', 'B', 'C', 'D', 'E']) as f, unnest([1, 2, 4, 8, 16]) as bit),
    o as (select a.f || b.f || c.f || d.f || e.f as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits from c a, c b, c c, c d, c e where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and a.bit | b.bit | c.bit | d.bit | e.bit = 31),
    s as (select filter_order, step::int as step, bits[step] as own, coalesce(list_sum(bits[1:step - 1]), 0)::int as before_ from o, range(1, 6) r(step)),
    x as (select *, mask & own > 0 as hit, mask & before_ > 0 as gone from m, s),
    r as (select part, filter_order, step, own, sum(n) filter (where not hit and not gone) as kept, sum(n) filter (where hit and not gone) as removed, sum(n) filter (where hit and gone) as redundant, sum(n) filter (where mask = own) as unique_fails,
        sum(good) filter (where hit and not gone) as good_lost, sum(toxic) filter (where hit and not gone) as toxic_lost from x group by 1, 2, 3, 4)
    select part, filter_order, step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant, coalesce(unique_fails, 0)::bigint as unique_fails, coalesce(good_lost, 0)::bigint as good_lost,
        coalesce(toxic_lost, 0)::bigint as toxic_lost, coalesce(sum(removed) over (partition by part, own), 0)::bigint as shapley from r"""

_AFTER = "case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end"
_HOST = _lower("regexp_extract({0}, '^[^/?#]*')")
_RULES = "(values ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')) r(rule, rhost, rpath, action)"
# Absolute links as pages commonly write them; tests hold the rest of the markup.
_MARKUP = "regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<script.*?</script|<style.*?</style|<textarea.*?</textarea|<title.*?</title', '', 'g')"
URLS = f"""with recursive r as (select * from {_RULES}), tags as (select url, unnest(regexp_extract_all({_MARKUP}, '(?is)<(?:link|meta)\\b[^>]*>')) as tag from pages),
    links as (select url, regexp_extract(tag, '(?is)href\\s*=\\s*["'']?([^"''\\s>]+)', 1) as target from tags where regexp_matches(tag, '(?is)^<link\\b.*\\brel\\s*=\\s*["'']?[^"''>]*\\bcanonical\\b')
        union all select url, regexp_extract(tag, '(?is)url\\s*=\\s*["'']?([^"''\\s>]+)', 1) from tags where regexp_matches(tag, '(?is)^<meta\\b.*http-equiv\\s*=\\s*["'']?refresh')),
    pairs as (select regexp_replace(url, '#.*$', '', 's') as a, regexp_replace(target, '#.*$', '', 's') as b from links where position('://' in target) > 0), arcs as (select a, b from pairs where a <> b union select b, a from pairs where a <> b),
    reach as (select a as node, b as other from arcs union select reach.node, arcs.b from reach join arcs on arcs.a = reach.other),
    urls as (select url from pages union select a from arcs), u as (select url, {_HOST.format(_AFTER)} as host, regexp_extract({_AFTER}, '^[^/?#]*([^?#]*)', 1) as path from urls),
    best as (select url, arg_max(rule, length(rule)) as rule, arg_max(action, length(rule)) as action from u join r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by 1),
    passed as (select node, min(action) as action from reach join best on best.url = reach.other group by 1)
    select page_id, coalesce(host, '') as host, coalesce(path, '') as path, rule, coalesce(best.action, passed.action, 'allow') as verdict, case when best.action is not null then 'rule' when passed.action is not null then 'alias' else 'default' end as via
    from pages left join u using (url) left join best using (url) left join passed on passed.node = regexp_replace(pages.url, '#.*$', '', 's')"""

SEARCH = f"""with d as (select doc_id, {_WORDS} as w from documents), t as (select doc_id, len(w) as n, unnest(w) as term from d where len(w) > 0), f as (select doc_id, term, n, count(*) as tf from t group by 1, 2, 3),
    s as (select count(*) as n_docs, sum(len(w)) as l from d where len(w) > 0), df as (select term, count(*) as df from f group by 1), q as (select item_id, unnest({_WORDS}) as term from benchmark),
    p as (select item_id, term, count(*) as times from q group by 1, 2), w as (select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)))::bigint as w from df, s),
    x as (select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // l))))::bigint as score from p join w using (term) join f using (term), s group by 1, 2),
    r as (select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from x where score > 0) select * from r where rank <= 20"""

ORACLE_SQL = {"op1_sharding": SHARDING, "op2_line_dedup": LINES, "op3_mixing": MIXING, "op5_minhash_near_dedup": NEAR, "op6_decontamination": CONTAMINATION, "op11_filter_audit": AUDIT, "op12_url_filters": URLS, "op13_lexical_search": SEARCH}
