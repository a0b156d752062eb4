"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(pattern: str, text: str = "text") -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{pattern}')"


ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLANK = r"[^\x20\x09-\x0D]+"

OP6 = f"""
with d as (select doc_id, {words(ALNUM)} w from documents),
i as (select item_id, {words(ALNUM)} w from benchmark where item_id is not null),
iw as (select distinct item_id, least(10, len(w)) n, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') g
       from i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) u(p) where len(w) > 0),
lens as (select distinct n from iw),
dw as (select doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') g
       from d, lens, unnest(range(1, len(w) - n + 2)) u(p) where len(w) >= n),
m as (select doc_id, p, n, item_id from dw join iw using (n, g)),
hits as (select doc_id, count(distinct x) n_hit
         from (select distinct doc_id, p, n from m), unnest(range(p, p + n)) u(x) group by doc_id),
ids as (select doc_id, count(*) n_items, sha256(string_agg(item_id, ',' order by item_id)) s
        from (select distinct doc_id, cast(item_id as varchar) item_id from m) group by doc_id)
select doc_id, len(w) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
       coalesce(s, sha256('')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join hits using (doc_id) left join ids using (doc_id)"""

OP7 = f"""
with recursive d as (select doc_id, {words(BLANK)} w from documents),
s as materialized (select distinct doc_id, array_to_string(w[p:p + 4], ' ') g
     from d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) u(p) where len(w) > 0),
n as (select doc_id, count(*) n from s group by doc_id),
x as (select a.doc_id a, b.doc_id b, count(*) i from s a join s b using (g) where a.doc_id <> b.doc_id group by all),
l as materialized (select a, b from x join n na on na.doc_id = a join n nb on nb.doc_id = b
     where 100 * i >= 75 * (na.n + nb.n - i)),
r as (select doc_id, doc_id c from n union select b, c from r join l on a = r.doc_id)
select doc_id, coalesce(n.n, 0) n_shingles, coalesce(c, doc_id) component_id
from documents left join n using (doc_id) left join (select doc_id, min(c) c from r group by doc_id) using (doc_id)"""

OP10 = """
with p as (select page_id, coalesce(html, '') html, strlen(coalesce(html, '')) payload_bytes,
                  sha256(coalesce(html, '')) payload_digest from pages),
f as (select payload_digest, min(page_id) first from p where payload_bytes >= 100 group by 1)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 100 and page_id is distinct from first then 'revisit' else 'response' end record_type,
       case when payload_bytes >= 100 and page_id is distinct from first then first end refers_to
from p left join f using (payload_digest)"""



def crc_table() -> list[int]:
    """The table of the reflected CRC-32 polynomial."""
    out = []
    for i in range(256):
        for _ in range(8):
            i = (i >> 1) ^ (0xEDB88320 if i & 1 else 0)
        out.append(i)
    return out


def crc32(text: str) -> str:
    table = "[" + ",".join(map(str, crc_table())) + "]::bigint[]"
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::bigint)"
    return (f"xor(list_reduce([4294967295::bigint] || {data}, "
            f"lambda c, b: xor(c >> 8, ({table})[(xor(c, b) & 255) + 1])), 4294967295)")


OP12 = f"""
with t as (select doc_id, cast(strlen(coalesce(text, '')) + 1 as bigint) size, {crc32("coalesce(text, '')")} text_crc32 from documents),
r as (select *, coalesce(sum(size) over (o rows between unbounded preceding and 1 preceding), 0) before, sum(size) over () total,
             row_number() over o n from t window o as (order by doc_id nulls first, size, text_crc32)),
s as (select *, cast(least(7, (2 * before + size) * 8 // (2 * total)) as integer) shard from r)
select doc_id, size, text_crc32, 'bytes' as law, shard, row_number() over (partition by shard order by n) - 1 as slot,
       cast(null as integer) grown_shard from s"""


def _field(c: str) -> str:
    return f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"


_HEAD = " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars")))
#: Levels are lists by tree, "s" and the source or "-" for null; the tree "" has the sources' roots.
OP13 = f"""
with recursive t as materialized (
  select doc_id, coalesce('s' || source, '-') tree, sha256({_HEAD} || {_field("text")}) leaf,
         case when ({crc32("doc_id::varchar")}) & 1 = 0 then sha256({_HEAD} || {_field("replace(text, chr(10), '')")}) end bad
  from documents),
l as materialized (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 pos from t),
up as (select tree, 0 lev, list(leaf order by pos) h from l group by tree
       union all select tree, lev + 1, list_transform(range(0, len(h), 3), lambda i: sha256(array_to_string(h[i + 1:i + 3], '')))
       from up where len(h) > 1),
sub as materialized (select tree, h[1] subroot, row_number() over (order by encode(tree)) - 1 pos from up where len(h) = 1),
top as (select 0 lev, list(subroot order by pos) h from sub
        union all select lev + 1, list_transform(range(0, len(h), 3), lambda i: sha256(array_to_string(h[i + 1:i + 3], ''))) from top where len(h) > 1),
whole as materialized (select h[1] root from top where len(h) = 1),
steps as materialized (
  select tree, lev, lev step, h from up where len(h) > 1
  union all select tree, 1000 + lev, lev, h from sub, top where len(h) > 1),
flank as materialized (
  select l.tree, l.pos, s.lev,
         case when s.lev < 1000 then l.pos else sub.pos end // cast(pow(3, s.step) as bigint) node, s.h
  from l join steps s using (tree) join sub using (tree)),
side as materialized (select tree, pos, row_number() over (partition by tree, pos order by lev) k,
  array_to_string(h[node - node % 3 + 1:node], '') a, array_to_string(h[node + 2:node - node % 3 + 3], '') b from flank),
proof as (select tree, pos, sha256(string_agg(a || b, '' order by k)) p from side group by tree, pos),
fold as (select tree, pos, 0 k, coalesce(bad, leaf) f from l
         union all select fold.tree, fold.pos, fold.k + 1, sha256(a || f || b) from fold join side on side.tree = fold.tree and side.pos = fold.pos and side.k = fold.k + 1),
done as (select tree, pos, arg_max(f, k) folded_root from fold group by tree, pos)
select doc_id, leaf, subroot, root, coalesce(p, sha256('')) proof_sha256, folded_root, folded_root = root as verified
from l join sub using (tree) join done on done.tree = l.tree and done.pos = l.pos
left join proof on proof.tree = l.tree and proof.pos = l.pos, whole"""

SQL = {"op6_winnowing": OP6, "op7_parity_sketch": OP7, "op10_warc_archive": OP10, "op12_sampled_splitters": OP12, "op13_level_strings": OP13}
