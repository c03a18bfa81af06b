"""DuckDB SQL of the longer oracles, with no step taken from the Spark code."""

from __future__ import annotations


def _put(value: str, cost: int | str, letter: str, line: str = "''") -> str:
    """A path "cost, letters, chr(1), text" with one more edit."""
    cut = f"instr({value}, chr(1))"
    return (f"(lpad((left({value}, 6)::int + {cost})::varchar, 6, '0') || substr({value}, 7, {cut} - 7) || '{letter}'"
            f" || substr({value}, {cut}) || {line})")


def _edited(state: int) -> str:
    """The least path into a state by an edit of the row: delete, keep, rerole."""
    own, stays = "role || ':' || text || chr(10)", "fault not in ('blank', 'duplicate')"
    ways = [_put(f"v{state}", 4, "D")]
    keeps = {1: [(0, "s")], 2: [(0, "u"), (1, "u"), (3, "u")], 3: [(2, "a")], 0: []}[state]
    ways += [f"case when {stays} and initial = '{i}' then {_put(f'v{s}', 'more', 'K', own)} end" for s, i in keeps]
    new = {2: "user", 3: "assistant"}.get(state)
    ways += [f"case when {stays} then {_put(f'v{s}', '3 + more', 'R', f'''{new!r} || ':' || text || chr(10)''')} end"
             for s, _ in keeps if new]
    return f"list_min([{', '.join(ways)}])"


_USER, _ASSISTANT = "'user:' || chr(10)", "'assistant:' || chr(10)"
_INSERT_USER = f"list_min([e2, {', '.join(_put(f'e{s}', 3, 'I', _USER) for s in (0, 1, 3))}])"

#: rows one by one for all conversations at once; a path is one string, so the least string is the answer
STRUCTURE_REPAIR = rf"""
with recursive named as (
  select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') text,
         coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') nm from conversations),
hit as (
  select *, xor(list_reduce([ord(c)::bigint for c in string_split(nm, '')],
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::bigint[],
        lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end), 4294967295::bigint), 4294967295) % 20 hit
  from named),
damaged as (
  select conv_id, turn, case when hit = 4 then 'user' else role end as role,
         case hit when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
         unnest(case when hit = 3 then [0, 1] else [0] end) copy_no
  from hit where hit <> 0),
marked as (
  select *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) seen, left(role, 1) initial,
         row_number() over (partition by conv_id order by turn nulls first, role, text, copy_no) pos from damaged),
twice as (select *, row_number() over (partition by conv_id, role, text order by pos) nth,
                 lag(initial) over (partition by conv_id order by pos) before from marked),
faults as (select *, case when seen = '' then 'blank' when nth > 1 then 'duplicate'
                          when right(seen, 1) not in ('.', '!', '?') then 'truncated' else '' end fault from twice),
ready as (select conv_id, pos, role, text, initial, fault, case when fault = 'truncated' then 3 else 0 end more from faults),
per as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint gaps,
         count(*) filter (where fault = 'blank') blank, count(*) filter (where fault = 'duplicate') duplicate,
         count(*) filter (where fault = 'truncated') truncated,
         count(*) filter (where before is not null and before || initial not in ('su', 'ua', 'au')) illegal,
         count(*) n from faults group by conv_id),
paths as (
  select conv_id, 0::bigint pos, '000000' || chr(1) v0, null::varchar v1,
         {_put("('000000' || chr(1))", 3, 'I', _USER)} v2,
         {_put(_put("('000000' || chr(1))", 3, 'I', _USER), 3, 'I', _ASSISTANT)} v3 from per
  union all
  select conv_id, pos, v0, v1, v2, list_min([e3, {_put('v2', 3, 'I', _ASSISTANT)}]) v3 from (
    select conv_id, pos, e0 v0, e1 v1, e3, {_INSERT_USER} v2 from (
      select p.conv_id, r.pos, {', '.join(f'{_edited(s)} e{s}' for s in range(4))}
      from paths p join ready r on r.conv_id is not distinct from p.conv_id and r.pos = p.pos + 1))),
ends as (select p.conv_id, list_min([v0, v3]) v from paths p
         join per on per.conv_id is not distinct from p.conv_id and per.n = p.pos),
ids as (select distinct conv_id from conversations)
select ids.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate,
       coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal, coalesce(left(v, 6)::bigint, 0) as cost,
       coalesce(substr(v, 7, instr(v, chr(1)) - 7), '') audit,
       sha256(coalesce(substr(v, instr(v, chr(1)) + 1, greatest(length(v) - instr(v, chr(1)) - 1, 0)), '')) repaired_sha256
from ids left join per on per.conv_id is not distinct from ids.conv_id
left join ends on ends.conv_id is not distinct from ids.conv_id"""


def _tier(i: int) -> str:
    """Rows of one tier in hash order against its budget, and what is left over."""
    owed = "0.0" if i == 0 else "o.owed"
    join = "" if i == 0 else f"join left{i - 1} o using (src)"
    return f"""
budget{i} as (select per.src, share * coalesce((select sum(size) from placed p where p.src = per.src and tier = {i}), 0) + {owed} budget
              from per {join}),
run{i} as (select src, h, rn, size, budget, sum(size) over (partition by src order by h, rn) upto
           from placed join budget{i} using (src) where tier = {i} and size > 0),
edge{i} as (select *, budget - (upto - size) need, row_number() over (partition by src order by h, rn) nth
            from run{i} where upto > budget),
took{i} as (select src, h, rn, size from run{i} where upto <= budget
            union all select src, h, rn, size from edge{i} where nth = 1 and size - need < need),
left{i} as (select src, budget - coalesce((select sum(size) from took{i} t where t.src = b.src), 0) owed from budget{i} b)"""


SOURCE_MIX = rf"""
with d as (select doc_id, coalesce('=' || source, '') src,
             len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
             left(md5(coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')), 30) h, row_number() over () rn from documents),
sums as (select src, sum(size)::bigint s, ([5, 2, 1])[(row_number() over (order by src = '', src) - 1) % 3 + 1]::bigint w
         from d group by src),
lim as (select *, row_number() over o n,
          sum(s) over () - 3 * coalesce(sum(s) over (o rows between unbounded preceding and 1 preceding), 0) l,
          sum(w) over () - coalesce(sum(w) over (o rows between unbounded preceding and 1 preceding), 0) lw
        from sums window o as (order by s * (10 // w), src)),
free as (select l, lw, n from lim where l * w < 3 * s * lw order by n limit 1),
aimed as (select src, s, case when f.n is null or lim.n < f.n then (3 * s)::double
                              else f.l::double * w / f.lw end target from lim left join free f on true),
per as (select *, coalesce(floor(target / nullif(s, 0)), 0)::bigint copies,
          coalesce((target - coalesce(floor(target / nullif(s, 0)), 0)::bigint * s) / nullif(s, 0), 0) share from aimed),
placed as (select d.*, s, target, copies,
             case when size * 16 > target then 0 when size * 256 > target then 1 else 2 end tier from d join per using (src)),
{_tier(0)},{_tier(1)},{_tier(2)},
took as (select * from took0 union all select * from took1 union all select * from took2)
select doc_id, p.size, s source_size, target, p.size * (copies + case when t.rn is null then 0 else 1 end) taken
from placed p left join took t on t.rn = p.rn"""

LEXICAL_TOPK = r"""
with words as (
  select doc_id, row_number() over () no, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') t from documents),
wanted as (
  select item_no, item_id, term, count(*) times from (
    select row_number() over () item_no, item_id, unnest(regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term from benchmark) group by all),
size as (select count(*) filter (where len(t) > 0) n_docs, sum(len(t))::bigint n_terms from words),
held as (select no, term, count(*) tf from (select no, unnest(t) term from words)
         where term in (select term from wanted) group by all),
weight as (select term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::bigint w from held, size group by term, n_docs),
norm as (select no, doc_id, 100 - 75 + (75 * len(t) * n_docs) // n_terms m from words, size where len(t) > 0),
scores as (
  select item_no, any_value(item_id) item_id, h.no, any_value(doc_id) doc_id,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint score
  from held h join norm using (no) join weight using (term) join wanted using (term) group by item_no, h.no),
ranked as (select *, row_number() over (partition by item_no order by score desc, doc_id nulls last)::int as rank
           from scores where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 10"""
