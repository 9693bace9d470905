"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations


_WORDS = r"list_filter(regexp_split_to_array(coalesce({text}, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_LOWER = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Exact containment of every item's shingles in every text.
CONTAINMENT = f"""
with items as (
  select item_id, {_WORDS.format(text=_LOWER.format(text='text'))} w from benchmark),
sized as (select item_id, w, least(5, len(w)) k from items where len(w) > 0),
wanted as (
  select distinct item_id, k, array_to_string(w[i:i + k - 1], ' ') s
  from (select *, unnest(range(1, len(w) - k + 2)) i from sized)),
total as (select item_id, k, count(*) n from wanted group by all),
docs as (select doc_id, row_number() over () r, {_WORDS.format(text=_LOWER.format(text='text'))} w from documents),
grams as (
  select distinct r, doc_id, k, array_to_string(w[i:i + k - 1], ' ') s
  from (select *, unnest(range(1, len(w) - k + 2)) i from docs, (select distinct k from sized) where len(w) >= k)),
found as (
  select r, doc_id, item_id, count(*) m from grams join wanted using (k, s) group by all)
select doc_id, item_id, n as n_shingles, m as n_found, m / n as containment
from found join total using (item_id) where 5 * m >= 4 * n
"""

#: Every window of 20 words with the first place it starts; words of later ones go.
SUBSTRINGS = f"""
with docs as (
  select row_number() over () r, coalesce(doc_id, -9223372036854775808) d, doc_id, {_WORDS.format(text='text')} w from documents),
windows as (
  select r, d, i, sha256(array_to_string(w[i:i + 19], ' ')) s
  from (select *, unnest(range(1, len(w) - 18)) i from docs where len(w) >= 20)),
late as (
  select r, i from (select *, min((d, i)) over (partition by s) first from windows) where (d, i) <> first),
gone as (select distinct r, i + k as i from late, range(20) t(k)),
kept as (
  select r, list(w[i] order by i) kw from (select r, w, unnest(range(1, len(w) + 1)) i from docs) p
  where not exists (select 1 from gone g where g.r = p.r and g.i = p.i) group by r)
select doc_id, len(w) as n_words, len(w) - coalesce(len(kw), 0) as n_removed,
  sha256(coalesce(array_to_string(kw, ' '), '')) as kept_sha256
from docs left join kept using (r)
"""

#: zlib's crc32 of a number's decimal text.
_CRC32 = (
    "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({x}::varchar, ''), lambda c: ascii(c)::bigint)), "
    "lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda r, k: xor(r >> 1, 3988292384 * (r & 1)))), 4294967295)"
)


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::varchar) || ':' || {value}::varchar, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


#: One row for each node of a forest (tree, level, place, digest, n), from its leaves ``{base}``.
_FOREST = """(
  select tree, 0 as level, place, digest, n from {base}
  union all
  select tree, level + 1, place // 16, sha256(string_agg(digest, '' order by place)), (n + 15) // 16
  from {name} where n > 1 group by tree, level, place // 16, n)"""

#: Siblings of every leaf (tree, place, level, l, r) on the way up its tree.
_WAY = """(
  select a.tree, a.place, s.level,
    coalesce(string_agg(s.digest, '' order by s.place) filter (where s.place < a.place // (16 ** s.level)::bigint), '') l,
    coalesce(string_agg(s.digest, '' order by s.place) filter (where s.place > a.place // (16 ** s.level)::bigint), '') r
  from {base} a join {forest} s on s.tree = a.tree and s.n > 1 and s.place // 16 = a.place // (16 ** (s.level + 1))::bigint
  group by a.tree, a.place, s.level)"""

#: Trees by source, the tree of their subroots, proofs, and folds of what a verifier holds.
MERKLE = f"""
with recursive docs as (
  select row_number() over () r, doc_id, source, {_leaf('text')} leaf,
    case when {_CRC32.format(x='doc_id')} % 5 = 0 then {_leaf(_LOWER.format(text='text'))} end seen from documents),
leaves as materialized (
  select doc_id, leaf, coalesce(seen, leaf) seen, dense_rank() over (order by source nulls first) - 1 tree,
    row_number() over (partition by source order by doc_id nulls first, leaf) - 1 place, count(*) over (partition by source) n from docs),
base as (select tree, place, leaf digest, n from leaves),
forest as {_FOREST.format(base='base', name='forest')},
subroots as materialized (select tree, digest from forest where n = 1),
top as (select 0 tree, tree place, digest, (select count(*) from subroots) n from subroots),
crown as {_FOREST.format(base='top', name='crown')},
ways as {_WAY.format(base='base', forest='forest')},
above as {_WAY.format(base='top', forest='crown')},
steps as (
  select tree, place, level, l, r from ways union all
  select b.tree, b.place, 100 + a.level, a.l, a.r from base b join above a on a.place = b.tree),
paths as (select tree, place, list(struct_pack(l := l, r := r) order by level) p, string_agg(l || r, '' order by level) t from steps group by all),
folded as (
  select tree, place, list_reduce(list_prepend(struct_pack(l := seen, r := ''), coalesce(p, [])),
    lambda a, x: struct_pack(l := sha256(x.l || a.l || x.r), r := '')).l f
  from leaves left join paths using (tree, place))
select doc_id, leaf, s.digest subroot, root, sha256(coalesce(t, '')) proof_sha256, f folded_root, f = root verified
from leaves left join paths using (tree, place) join folded using (tree, place) join subroots s using (tree),
  (select digest root from crown where n = 1)
"""

#: Jaccard similarity of all pairs that share a shingle, and the components of the links.
NEAR_DUPLICATES = f"""
with recursive docs as (
  select row_number() over () r, doc_id, {_WORDS.format(text=_LOWER.format(text='text'))} w from documents),
shingles as materialized (
  select distinct r, array_to_string(w[i:i + 3], ' ') s
  from (select r, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) i from docs where len(w) > 0)),
sized as materialized (select r, count(*) n from shingles group by r),
shared as (select a.r x, b.r y, count(*) m from shingles a join shingles b on a.s = b.s and a.r < b.r group by all),
links as materialized (
  select x, y from shared join sized a on a.r = x join sized b on b.r = y where 100 * m >= 80 * (a.n + b.n - m)),
both_ways as materialized (select x, y from links union all select y, x from links),
reach as (select distinct x r, x other from both_ways union select reach.r, b.y from reach join both_ways b on b.x = reach.other),
least as (select reach.r, min(d.doc_id) c from reach join docs d on d.r = reach.other group by reach.r)
select doc_id, coalesce(n, 0) n_shingles, case when least.r is null then doc_id else c end component_id,
  doc_id is not distinct from (case when least.r is null then doc_id else c end) kept
from docs left join sized using (r) left join least using (r)
"""

#: Every prefix of every rebuilt conversation, and each node's sums over the nodes that it begins.
TRIE = f"""
with recursive turns as (
  select conv_id, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) d, length(coalesce(text, '')) l,
    row_number() over (partition by conv_id order by turn nulls first, d) - 1 p
  from conversations where conv_id is not null),
convs as (select conv_id c, ({_CRC32.format(x='conv_id')}) % 6 h from (select distinct conv_id from turns)),
placed as (
  select c, 0 part, p, d, l from convs join turns on conv_id = c - c % 100 and p < h
  union all select c, 1, p, d, l from convs join turns on conv_id = c and p >= h),
seqs as (
  select c, coalesce(list(d order by part, p) filter (where d is not null), []) s,
    coalesce(list(l order by part, p) filter (where d is not null), []) ls
  from convs left join placed using (c) group by c),
prefixes as (
  select c, k, array_to_string(s[1:k], '') node, ls[k] l, len(s) = k ending from (select *, unnest(range(0, len(s) + 1)) k from seqs)),
nodes as materialized (
  select node, k, min(c) conv_id, count(*) n, any_value(l) l,
    sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (where ending), '')) ends
  from prefixes group by node, k),
kids as (select left(node, (k - 1) * 64) parent, count(*) m from nodes where k > 0 group by 1),
sums as (
  select left(d.node, d.anc * 64) node, sum(case when m is null then 1 else 0 end) leaves, sum((d.n - 1) * coalesce(d.l, 0)) saved
  from (select x.*, m, unnest(range(0, x.k + 1)) anc from nodes x left join kids on kids.parent = x.node) d group by 1)
select x.conv_id, x.k depth, u.conv_id parent_conv_id, x.n n_convs, coalesce(m, 0) n_children, leaves::bigint n_leaves,
  saved::bigint saved_tokens, x.ends ends_sha256
from nodes x join sums using (node) left join kids on kids.parent = x.node
  left join nodes u on x.k > 0 and u.node = left(x.node, (x.k - 1) * 64)
"""

ORACLE_SQL: dict[str, str] = {
    "op5_substring_dedup": SUBSTRINGS,
    "op10_benchmark_decontamination": CONTAINMENT,
    "op11_merkle_manifest": MERKLE,
    "op12_minhash_near_dedup": NEAR_DUPLICATES,
    "op13_conversation_trie": TRIE,
}
