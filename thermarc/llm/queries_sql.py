"""SQL of the queries on mixing, manifests and resampling."""

from __future__ import annotations

from thermarc.llm import merkle, mixing, resampling

#: Levels of a tree that the SQL spells out: 2**24 rows of a language.
LEVELS = 24

#: The remainders of the CRC-32 by their byte, from its polynomial.
CRC_TABLE = "crc_table as (select list_transform(range(256), lambda b: list_reduce(list_prepend(b::bigint, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as crc_of)"


def _crc(hex_text: str) -> str:
    """crc32 of the bytes that a column holds as hexadecimal text."""
    return f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length({hex_text}), 2), lambda i: (instr('0123456789ABCDEF', substr({hex_text}, i, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr({hex_text}, i + 1, 1)) - 1)), lambda c, b: xor(c >> 8, crc_of[xor(c & 255, b) + 1])), 4294967295)"


# ---- manifest


def _encoded(c: str) -> str:
    return f"coalesce(octet_length(encode(({c})::varchar)) || ':' || ({c})::varchar, '-')"


def _merkle() -> str:
    leaf = lambda n_chars: f"sha256({' || '.join(_encoded(n_chars if c == 'n_chars' else c) for c in merkle.FIELDS)})"
    parts = [f"""{CRC_TABLE},
d as (select *, {_crc("hex(encode(doc_id::varchar))")} % 7 = 0 as tampered from documents, crc_table),
e as (select doc_id, lang, {leaf("n_chars")} as leaf, case when tampered then {leaf("n_chars + 1")} else {leaf("n_chars")} end as seen from d),
r as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i, dense_rank() over (order by lang nulls first) - 1 as g from e),
l0 as materialized (select g, i, leaf as h from r)"""]
    up = lambda k, g: f"l{k} as materialized (select {g}, i // 2 as i, case when count(*) over (partition by {g}) > 0 then sha256(string_agg(h, '' order by i)) end as h from l{k - 1} where {g} in (select {g} from l{k - 1} group by {g} having count(*) > 1) group by {g}, i // 2)"
    parts += [up(k, "g").replace("case when count(*) over (partition by g) > 0 then sha256(string_agg(h, '' order by i)) end", "sha256(string_agg(h, '' order by i))") for k in range(1, LEVELS + 1)]
    parts.append("nodes as (" + " union all ".join(f"select {k} as level, g, i, h from l{k}" for k in range(LEVELS + 1)) + ")")
    parts.append("subs as (select g, arg_max(h, level) as h, max(level) as height from nodes group by g)")
    parts.append("t0 as materialized (select 0 as z, g as i, h from subs)")
    parts += [f"t{k} as materialized (select z, i // 2 as i, sha256(string_agg(h, '' order by i)) as h from t{k - 1} where (select count(*) from t{k - 1}) > 1 group by z, i // 2)" for k in range(1, 9)]
    parts.append("tops as (" + " union all ".join(f"select {k} as level, i, h from t{k}" for k in range(9)) + ")")
    parts.append("total as (select arg_max(h, level) as root, max(level) as height from tops)")
    return "with " + ",\n".join(parts) + f""",
steps as (
  select r.doc_id, r.leaf, k as level, case when n.h is null then '' when xor(r.i >> k, 1) < r.i >> k then 'L' || n.h else 'R' || n.h end as step
  from r join subs s using (g), (select unnest(range({LEVELS})) as k) left join nodes n on n.g = r.g and n.level = k and n.i = xor(r.i >> k, 1) where k < s.height
  union all
  select r.doc_id, r.leaf, 1000 + k, case when n.h is null then '' when xor(r.g >> k, 1) < r.g >> k then 'L' || n.h else 'R' || n.h end
  from r, total s, (select unnest(range(8)) as k) left join tops n on n.level = k and n.i = xor(r.g >> k, 1) where k < s.height),
paths as (select doc_id, leaf, list(step order by level) as path from steps group by doc_id, leaf),
f as (
  select r.doc_id, r.leaf, s.h as subroot, root, sha256(coalesce(list_aggregate(list_transform(path, lambda x: substr(x, 2)), 'string_agg', ''), '')) as proof_sha256,
    list_reduce(list_prepend(seen, coalesce(path, [])), lambda h, x: case when x = '' then sha256(h) when x[1] = 'L' then sha256(substr(x, 2) || h) else sha256(h || substr(x, 2)) end) as folded_root
  from r join subs s using (g) cross join total left join paths p on p.doc_id = r.doc_id and p.leaf = r.leaf)
select *, folded_root = root as verified from f"""


# ---- resampling

_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

RESAMPLING = f"""with {CRC_TABLE},
dw as (select doc_id, row_number() over () as k, {_WORDS} as ws from documents),
bw as (select {_WORDS} as ws from benchmark),
df as (select k, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) as f from dw),
dn as (select k, f, count(*) as n from df group by 1, 2),
bn as (select f, count(*) as n from (select unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) as f from bw) group by 1),
fs as materialized (select f, {_crc("hex(encode(f))")} % {resampling.BUCKETS} as b from (select f from dn union select f from bn), crc_table),
s as (select b, sum(n) as s from dn join fs using (f) group by 1), t as (select b, sum(n) as t from bn join fs using (f) group by 1),
st as (select (select coalesce(sum(s), 0) from s)::double as s_all, (select coalesce(sum(t), 0) from t)::double as t_all),
gain as (select b, floor({resampling.SCALE} * ln(((coalesce(t, 0) + 1)::double * (s_all + {resampling.BUCKETS})) / ((coalesce(s, 0) + 1)::double * (t_all + {resampling.BUCKETS}))))::bigint as gain
  from (select unnest(range({resampling.BUCKETS})) as b) left join s using (b) left join t using (b), st),
w as (select k, sum(n)::bigint as n, sum(n * gain)::bigint as total from dn join fs using (f) join gain using (b) group by 1),
x as (select doc_id, len(ws) as n_words, coalesce(n, 0) as n_features, coalesce((total - ((total % n) + n) % n) // n, 0)::bigint as weight, ('0x' || substr(sha256('{resampling.SEED}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint as h from dw left join w using (k)),
y as (select *, weight + floor(-{resampling.SCALE} * ln(-ln((h + 0.5::double) / 4294967296)))::bigint as score from x),
z as (select *, row_number() over (partition by n_words >= {resampling.MIN_WORDS} order by score desc, doc_id nulls first, n_features) as r, count(*) filter (n_words >= {resampling.MIN_WORDS}) over () as n_long from y)
select doc_id, n_features, weight, score, case when n_words >= {resampling.MIN_WORDS} and r <= {resampling.PERCENT} * n_long // 100 then r end as rank from z"""

# ---- mixing


def _scramble(x: str, key: str) -> str:
    a = f"((({x}) * {mixing.SPREAD} + {key}) % {mixing.PRIME})"
    return f"(({a} * {a} + {key}) % {mixing.PRIME})"


def _wide(x: str, key: int, below: str) -> str:
    first, second = (_scramble(_scramble(x, str(key + k)), str(key + k + 1)) for k in (0, 2))
    return f"(({first} * {2**30} + {second} % {2**30}) % ({below}))"


def _permuted(x: str, n: str, seed: str, turn: str) -> str:
    partner = f"((((keys_at[r] + {turn} * {mixing.STEP} - p) % ({n})) + ({n})) % ({n}))"
    bit = _scramble(f"greatest(p, {partner})", f"((keys_at[r] + {turn}) % {mixing.PRIME})")
    return f"case when {n} < 2 then {x} else list_reduce(list_prepend({x}, range(1, {mixing.ROUNDS + 1})), lambda p, r: case when {bit} // 128 % 2 = 1 then {partner} else p end) end"


def _keys(seed: str, n: str) -> str:
    key = _wide(f"({seed}) * {mixing.ROUNDS} + r", 11, f"greatest({n}, 1)")
    return f"list_transform(range(1, {mixing.ROUNDS + 1}), lambda r: {key})"


MIXING = f"""with sized as (
  select doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::bigint as size, row_number() over () as k from documents),
per as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as source_no from sized group by source),
pw as (select *, [{", ".join(map(str, map(float, mixing.WEIGHTS)))}][source_no % {len(mixing.WEIGHTS)} + 1]::double as weight, {mixing.MOST} * source_size as room from per),
lv as (select *, row_number() over o as place, (sum(source_size) over () - coalesce(sum(room) over (o rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (o rows between current row and unbounded following) as level from pw window o as (order by room / weight, source_no)),
tg as (select *, least(room::double, coalesce((select arg_min(level, place) from lv where level * weight <= room) * weight, room::double)) as target from lv),
q0 as (select source, source_no, source_size, target, source_size // {mixing.BLOCK} as full_blocks, source_size % {mixing.BLOCK} as tail, floor(target)::bigint // greatest(source_size, 1) as turns, floor(target)::bigint % greatest(source_size, 1) as rest from tg),
q1 as (select *, full_blocks + (tail > 0)::bigint as blocks, (rest + {mixing.BLOCK} - 1) // {mixing.BLOCK} as rest_slots from q0),
q2 as (select *, turns * blocks + rest_slots as slots, {_keys("source_no", "full_blocks")} as keys_at from q1),
qs as materialized (select *, coalesce(sum(slots) over (order by source_no rows between unbounded preceding and 1 preceding), 0)::bigint as first, (sum(slots) over ())::bigint as n from q2),
ids as (select unnest(range((select coalesce(max(n), 0) from qs)::bigint)) as id),
dr as (select id, id // {mixing.SHARD_BLOCKS} as shard, {_wide("id", 5, "(select max(n) from qs)")} as draw from ids),
ds as (select dr.*, source_no from dr join qs on draw >= first and draw < first + slots),
ct as (select shard, source_no, count(*) as n_drawn from ds group by 1, 2),
cf as (select *, coalesce(sum(n_drawn) over (partition by source_no order by shard rows between unbounded preceding and 1 preceding), 0)::bigint as own from ct),
sl as (select shard, source_no, own + j as idx from cf, lateral (select unnest(range(n_drawn)) as j)),
hs as (select source_no, slots, coalesce(n_all, 0) as has from qs left join (select source_no, sum(n_drawn)::bigint as n_all from ct group by 1) using (source_no)),
sp as (select *, greatest(has - slots, 0) as over_n, greatest(slots - has, 0) as short_n, coalesce(sum(greatest(has - slots, 0)) over o, 0)::bigint as over_first, coalesce(sum(greatest(slots - has, 0)) over o, 0)::bigint as short_first from hs window o as (order by source_no rows between unbounded preceding and 1 preceding)),
mv as (select shard, over_first + idx - slots as value from sl join sp using (source_no) where idx >= slots),
al as (select shard, source_no, idx from sl join sp using (source_no) where idx < slots union all select shard, sp.source_no, has + value - short_first from mv join sp on value >= short_first and value < short_first + short_n),
bl as (select shard, al.source_no, idx // blocks as turn, idx % blocks as spot, full_blocks, tail, turns, rest, rest_slots, keys_at from al join qs using (source_no)),
bk as (select *, case when spot = full_blocks then spot else {_permuted("spot", "full_blocks", "source_no", "turn")} end as block from bl),
us as (select source_no, block, shard, case when block = full_blocks then tail else {mixing.BLOCK} end as length, case when turn = turns and spot = rest_slots - 1 then rest - spot * {mixing.BLOCK} else case when block = full_blocks then tail else {mixing.BLOCK} end end as n_words from bk),
ub as (select source_no, block, count(*) filter (n_words >= length) as times, coalesce(max(n_words) filter (n_words < length), 0) as cut, min(shard) as any_shard, min(shard) filter (n_words >= length) as whole_shard from us group by 1, 2),
ld as (select k, doc_id, size, source_no, qs.source_size, target, coalesce(sum(size) over (partition by source_no order by md5(coalesce(doc_id::varchar, 'null') || ':' || size), k rows between unbounded preceding and 1 preceding), 0)::bigint as start from sized join qs on sized.source is not distinct from qs.source),
pc as (select k, source_no, block, greatest(start - block * {mixing.BLOCK}, 0) as a, least(start + size - block * {mixing.BLOCK}, {mixing.BLOCK}) as b from ld, lateral (select unnest(range(start // {mixing.BLOCK}, (start + size - 1) // {mixing.BLOCK} + 1)) as block) where size > 0),
tk as (select k, sum(times * (b - a) + greatest(least(b, cut) - a, 0))::bigint as taken, min(case when greatest(least(b, cut) - a, 0) > 0 then any_shard else whole_shard end) as first_shard from pc join ub using (source_no, block) group by 1)
select doc_id, size, source_size, target, coalesce(taken, 0) as taken, first_shard from ld left join tk using (k)"""

ORACLES: dict[str, str] = {"op11_source_mix": MIXING, "op12_merkle_manifest": _merkle(), "op13_importance_resampling": RESAMPLING}
