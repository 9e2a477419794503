"""DuckDB SQL for the rows of the operators that SQL can express."""

# every pair of a label by cosine, components by a recursive query
OP5_EMBEDDING_DUPS = r"""with recursive v as (select vec_id, label, cast(embedding as double[]) as e from embeddings),
pairs as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
          where list_cosine_similarity(a.e, b.e) >= 0.93),
reach(vec_id, other) as (select vec_id, vec_id from v union select r.vec_id, p.b from reach r join pairs p on p.a = r.other),
c as (select vec_id, min(other) as component_id from reach group by vec_id),
n as (select a as vec_id, count(*) as n_links from pairs group by a)
select c.vec_id, coalesce(n_links, 0) as n_links, component_id, c.vec_id = component_id as kept from c left join n on n.vec_id = c.vec_id
"""

# every 200-byte window as a hash of its hexadecimal digits
OP6_SUFFIX_DEDUP = r"""with d as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
win as (select doc_id, unnest(range(0, cast(length(x) / 2 as bigint) - 199)) as j,
        unnest(list_transform(range(0, cast(length(x) / 2 as bigint) - 199), lambda i: md5_number(substr(x, 2 * i + 1, 400)))) as h from d),
rep as (select doc_id, j from (select doc_id, j, count(*) over (partition by h) as c from win) where c > 1),
runs as (select doc_id, j, coalesce(j - lag(j) over (partition by doc_id order by j) > 200, true) as opens from rep),
grp as (select doc_id, j, sum(cast(opens as int)) over (partition by doc_id order by j) as g from runs),
span as (select doc_id, min(j) as lo, max(j) + 200 as hi from grp group by doc_id, g),
cut as (select doc_id, list(lo order by lo) as lo, list(hi order by lo) as hi, sum(hi - lo) as n_removed, count(*) as n_spans from span group by doc_id)
select d.doc_id, cast(length(x) / 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans,
sha256(unhex(case when lo is null then x else substr(x, 1, 2 * lo[1]) || array_to_string(list_transform(range(1, len(lo) + 1),
  lambda i: substr(x, 2 * hi[i] + 1, case when i < len(lo) then 2 * (lo[i + 1] - hi[i]) else length(x) end)), '') end)) as kept_sha256
from d left join cut on d.doc_id = cut.doc_id
"""

# every window of 35 words as a hash of its words
OP10_FM_SUBSTRINGS = r"""with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
u as (select doc_id, len(w) as n, unnest(range(1, len(w) + 1)) as j, w from d),
win as (select doc_id, j, w[j] as word, case when j + 34 <= n then md5(array_to_string(w[j:j + 34], ' ')) end as h from u),
rep as (select h from win where h is not null group by h having count(*) > 1),
cov as (select doc_id, j, word, coalesce(j - max(case when rep.h is not null then j end)
        over (partition by doc_id order by j) < 35, false) as gone from win left join rep on win.h = rep.h),
agg as (select doc_id, count(*) filter (gone) as n_removed, coalesce(string_agg(word, ' ' order by j) filter (not gone), '') as kept
        from cov group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join agg on d.doc_id = agg.doc_id
"""

# every beginning of every rebuilt conversation as a string of turn hashes
OP11_SPLITTER_TRIE = r"""with o as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), h) - 1 as pos, h, n
  from (select conv_id, turn, role, length(coalesce(text, '')) as n,
        md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as h from conversations where conv_id is not null)),
c as (select conv_id, conv_id - conv_id % 100 as base, count(*) as n,
  xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(conv_id as varchar), ''), lambda x: cast(ascii(x) as bigint))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda u, v: case when u & 1 = 1 then xor(u >> 1, 3988292384) else u >> 1 end)),
    4294967295) % 6 as k from o group by conv_id),
p as (select c.*, least(c.k, coalesce(b.n, 0)) as shared from c left join c b on b.conv_id = c.base),
t as (select p.conv_id, o.pos + 1 as d, h, o.n from p join o on o.conv_id = p.base and o.pos < p.shared
  union all select p.conv_id, o.pos - k + shared + 1, h, o.n from p join o on o.conv_id = p.conv_id and o.pos >= k),
w as (select conv_id, d, n, string_agg(h, '') over (partition by conv_id order by d) as path from t
  union all select conv_id, 0, 0, '' from p),
node as (select path, d, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * max(n) as saved from w group by path, d),
kids as (select substr(path, 1, 32 * (d - 1)) as path, count(*) as n_children from node where d > 0 group by 1),
sub as (select substr(a.path, 1, 32 * a.k) as path, sum(a.leaf) as n_leaves, sum(a.saved) as saved from
  (select n.path, n.saved, case when kids.path is null then 1 else 0 end as leaf, unnest(range(n.d + 1)) as k from node n left join kids on kids.path = n.path) a group by 1),
last as (select path, string_agg(cast(conv_id as varchar), ',' order by conv_id) as ids
  from (select conv_id, path from w qualify row_number() over (partition by conv_id order by d desc) = 1) group by path)
select n.conv_id, n.d as depth, up.conv_id as parent_conv_id, n.n_convs, coalesce(n_children, 0) as n_children, cast(sub.n_leaves as bigint) as n_leaves,
cast(sub.saved as bigint) as saved_tokens, sha256(coalesce(ids, '')) as ends_sha256
from node n left join node up on n.d > 0 and up.path = substr(n.path, 1, 32 * (n.d - 1)) left join kids on kids.path = n.path
left join sub on sub.path = n.path left join last on last.path = n.path
"""

# all phrases counted as strings
OP13_PHRASE_MINING = r"""with t as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as x from documents),
pieces as (select lang, unnest(regexp_split_to_array(x, '[.,;:!?\x0A-\x0D]')) as p from t),
w as (select lang, regexp_extract_all(p, '[^\x20\x09]+') as w from pieces),
g as (select lang, unnest(flatten(list_transform(range(1, 5), lambda k: list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))))) as phrase from w where len(w) > 0),
f as (select lang, phrase, count(*) as f from g group by all having count(*) >= 30),
n as (select lang, cast(sum(len(w)) as bigint) as n from w group by lang),
c as (select lang, phrase, f as a, string_split(phrase, ' ') as w from f where contains(phrase, ' ')),
cuts as (select lang, phrase, a, k, array_to_string(w[1:k], ' ') as x, array_to_string(w[k + 1:], ' ') as y from (select *, unnest(range(1, len(w))) as k from c)),
s as (select cuts.lang, cuts.phrase, a, k, l.f as l, r.f as r, cast((2000000 * cast(a as hugeint)) // (l.f + r.f) as bigint) as score
      from cuts join f l on l.lang = cuts.lang and l.phrase = x join f r on r.lang = cuts.lang and r.phrase = y),
m as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
parts as (select lang, a, len(w) as m, unnest(flatten(list_transform(range(2, len(w)), lambda k: list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))))) as phrase from c),
h as (select lang, phrase, max(a) as longer from parts group by all)
select m.lang, row_number() over (partition by m.lang order by score desc, m.a desc, encode(m.phrase)) as rank, m.phrase, m.a, m.l, m.r, n.n, score
from m left join h on h.lang = m.lang and h.phrase = m.phrase join n on n.lang = m.lang
where longer is null or 100 * longer < 80 * m.a qualify rank <= 2000
"""

ORACLES = {"op5_embedding_dups": OP5_EMBEDDING_DUPS, "op6_suffix_dedup": OP6_SUFFIX_DEDUP, "op10_fm_substrings": OP10_FM_SUBSTRINGS,
           "op11_splitter_trie": OP11_SPLITTER_TRIE, "op13_phrase_mining": OP13_PHRASE_MINING}
