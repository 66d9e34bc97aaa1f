"""The SQL side of the queries: fragments that state the same results in plain SQL."""

from __future__ import annotations

from ..config import NO_DEPENDENCY, Settings
from ..functions import hints
from ..operators import reviewer
from ..operators.units import LONG_IMPORTS, OPEN_IMPORT

GRAPH = """with u as (select distinct * from code_units where path is not null and source_name is not null and target_name is not null),
  src as (select path || '|' || source_name as id, * from u), tgt as (select path || '|' || target_name as id, * from u),
  last_src as (select * from (select *, row_number() over (partition by id order by unit_id desc) as rn from src) t where rn = 1),
  first_tgt as (select * from (select *, row_number() over (partition by id order by unit_id) as rn from tgt) t where rn = 1),
  ords as (select id, min(o) as node_ord from (select id, unit_id * 2 as o from src union all select id, unit_id * 2 + 1 from tgt) t group by id),
  raw_nodes as (select id, coalesce(source_code, '') as source_code, target_name, source_name, coalesce(source_desc, '') as descr, start_code_line as start_line, end_code_line as end_line, coalesce(name, '') as name, path from last_src
    union all select id, '', '', target_name, '', 0, 0, coalesce(name, ''), path from first_tgt where id not in (select id from last_src)),
  nodes as (select r.*, node_ord from raw_nodes r join ords using (id)),
  edges as (select path || '|' || source_name as src, path || '|' || target_name as dst, path, min(unit_id) as edge_ord from u group by 1, 2, 3),
  deg as (select n.id, (select count(*) from edges e where e.dst = n.id) as in_degree, (select count(*) from edges e where e.src = n.id) as out_degree from nodes n)
"""

_LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e]|\\x{85}|\\x{2028}|\\x{2029}"


def _lines(c: str) -> str:
    return f"case when length({c}) = 0 then [] else string_split_regex(regexp_replace({c}, '(?:{_LINE_BREAK})\\z', ''), '{_LINE_BREAK}') end"


LINES = f"with f as (select file_id, first, {_lines('source_code')} as ls, path from (select distinct file_id, path, source_code, greatest(coalesce(start_line, 1), 1) as first from source_files where source_code is not null) t) "


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _hits(kind: str) -> str:
    def every(ext: str) -> str:
        return " || ".join(f"regexp_extract_all(corpus, {_quote('(?i)' + p)})" for p in hints.patterns(ext, kind))

    cases = " ".join(f"when '{e}' then {every(e)}" for e in hints.BY_EXTENSION)
    return f"case ext {cases} else {every('')} end"


_FIRST_SEEN = "list_filter(list_transform({x}, lambda h : trim(h)), lambda h, k : h <> '' and list_position(list_transform({x}, lambda g : trim(g)), h) = k)"
HINTS = GRAPH + """, texts as (select id, path, node_ord, source_code, lower(regexp_extract(path, '[^/.][^/]*?(\\.[^./]*)$', 1)) as ext,
    concat_ws(chr(10), nullif(source_name, ''), nullif(target_name, ''), nullif(descr, ''), nullif(source_code, '')) as corpus from nodes),
  all_hits as (select id, path, source_code, """ + ", ".join(f"{_hits(k)} as {k}_all" for k in hints.KINDS) + """ from texts),
  hit_lists as (select id, path, source_code, """ + ", ".join(f"{_FIRST_SEEN.format(x=k + '_all')} as {k}_hits" for k in hints.KINDS) + """ from all_hits),
  hit_list as (""" + " union all ".join(f"select id, '{k}' as kind, {k}_hits as hits from hit_lists" for k in hints.KINDS) + """),
  profile as (select id, path, source_code <> '' as has_source, len(input_hits) as input_count, len(sink_hits) as sink_count, len(validation_hits) as validation_count, len(safety_hits) as safety_count,
    4 * len(input_hits) + 6 * len(sink_hits) + 2 * len(validation_hits) + len(safety_hits) as hint_score, greatest(1, len(""" + _lines("source_code") + """)) as n_lines from hit_lists),
  prio as (select p.*, in_degree, out_degree, 120 * (input_count > 0)::int + 160 * (sink_count > 0)::int + 70 * (validation_count > 0)::int + 50 * (safety_count > 0)::int + 5 * hint_score + in_degree + out_degree + n_lines as priority from profile p join deg using (id))
"""

PATHS = HINTS + """, one as (select src as root, dst as target, [src, dst] as nodes, [] as via from edges where src <> dst),
  two as (select a.src as root, b.dst as target, [a.src, a.dst, b.dst] as nodes, [a.dst] as via from edges a join edges b on b.src = a.dst
    where a.src <> a.dst and b.dst <> a.src and not exists (select 1 from edges c where c.src = a.src and c.dst = b.dst)),
  cand as (select * from one union all select * from two),
  steps as (select root, target, nodes, via, unnest(nodes) as id from cand),
  sums as (select s.root, s.target, s.nodes, s.via, sum(input_count) as ic, sum(sink_count) as sc, sum(validation_count) as vc, sum(safety_count) as fc, sum(priority) as pr from steps s join prio p on p.id = s.id group by 1, 2, 3, 4),
  valued as (select *, 80 * (ic > 0)::int + 100 * (sc > 0)::int + 180 * (ic > 0 and sc > 0)::int + 140 * (ic > 0 and sc > 0 and vc = 0 and fc = 0)::int + 40 * sc + 25 * ic + 8 * vc + 5 * fc + 10 * len(nodes) + pr as value from sums),
  placed as (select v.*, row_number() over (partition by v.root, v.target order by value desc, p.priority desc nulls last, encode(v.via[1]) nulls last) as rn from valued v left join prio p on p.id = v.via[1]),
  best as (select root, target, cast(len(nodes) as bigint) as n_nodes, array_to_string(nodes, ' -> ') as chain, cast(value as bigint) as priority, cast(ic as bigint) as ic, cast(sc as bigint) as sc, cast(vc as bigint) as vc, cast(fc as bigint) as fc from placed where rn = 1)
"""


# Level by level against the edges, each node at its distance; ties go to the first neighbour by priority and name, then to the second.
INBOUND = HINTS + """, e as (select distinct src, dst from edges where src <> dst),
  lv1 as (select dst as root, src as t from e),
  lv2 as (select distinct a.root, e.src as t from lv1 a join e on e.dst = a.t where e.src <> a.root and not exists (select 1 from lv1 x where x.root = a.root and x.t = e.src)),
  lv3 as (select distinct a.root, e.src as t from lv2 a join e on e.dst = a.t where e.src <> a.root and not exists (select 1 from lv1 x where x.root = a.root and x.t = e.src) and not exists (select 1 from lv2 x where x.root = a.root and x.t = e.src)),
  cand as (select root, t as target, [t, root] as nodes, cast(null as varchar) as v1, cast(null as varchar) as v2 from lv1
    union all select b.root, b.t, [b.t, a.t, b.root], a.t, null from lv2 b join e on e.src = b.t join lv1 a on a.root = b.root and a.t = e.dst
    union all select c.root, c.t, [c.t, b.t, a.t, c.root], a.t, b.t from lv3 c join e on e.src = c.t join lv2 b on b.root = c.root and b.t = e.dst join e f on f.src = b.t join lv1 a on a.root = c.root and a.t = f.dst),
  steps as (select *, unnest(nodes) as id from cand),
  sums as (select root, target, nodes, v1, v2, sum(input_count) as ic, sum(sink_count) as sc, sum(validation_count) as vc, sum(safety_count) as fc, sum(priority) as pr from steps join prio using (id) group by 1, 2, 3, 4, 5),
  valued as (select *, 80 * (ic > 0)::int + 100 * (sc > 0)::int + 180 * (ic > 0 and sc > 0)::int + 140 * (ic > 0 and sc > 0 and vc = 0 and fc = 0)::int + 40 * sc + 25 * ic + 8 * vc + 5 * fc + 10 * len(nodes) + pr as value from sums),
  placed as (select v.*, row_number() over (partition by v.root, v.target order by value desc, p.priority desc nulls last, encode(v1) nulls last, q.priority desc nulls last, encode(v2) nulls last) as rn from valued v left join prio p on p.id = v1 left join prio q on q.id = v2)
select root, target, cast(len(nodes) as bigint) as n_nodes, array_to_string(nodes, ' -> ') as chain, cast(ic as bigint) as input_count, cast(sc as bigint) as sink_count, cast(vc as bigint) as validation_count, cast(fc as bigint) as safety_count, cast(value as bigint) as priority from placed where rn = 1
"""


def sections(boundaries: dict[str, tuple[str, ...]]) -> str:
    def hit(rules: tuple[str, ...]) -> str:
        return " or ".join(f"regexp_matches(line, {_quote(r.replace('[^;]', '[^;]'))})" for r in rules)

    cases = " ".join(f"when '{e}' then {hit(r)}" for e, r in boundaries.items())
    return LINES + f""", l as (select file_id, n, len(ls) as total, ls[n] as line, lower(regexp_extract(path, '[^/.][^/]*?(\\.[^./]*)$', 1)) as ext from f, unnest(range(1, len(ls) + 1)) as u(n)),
  m as (select file_id, n, total from l where n = 1 or (case ext {cases} else false end))
select file_id, cast(n as int) as start_line, cast(coalesce(lead(n) over (partition by file_id order by n) - 1, total) as int) as end_line from m"""


def packed(boundaries: dict[str, tuple[str, ...]], budget: int, isolate: bool) -> str:
    """Chunks as a fold: sections that fit and the lines of those that do not, one after the other."""
    tokens = "cast(ceil(length(array_to_string(ls[{a}:{b}], chr(10))) / 4.0) as bigint)"
    new = f"(n.split <> r.split or n.split = 1 and n.s <> r.s or r.held + n.cost > {budget}{' or n.split = 0' if isolate else ''})"
    return sections(boundaries).replace("with f as", "with recursive f as", 1).replace("select file_id, cast(n as int)", ", sec as (select file_id, cast(n as int)").rstrip() + f"""),
  sect as (select file_id, start_line as a, end_line as b, {tokens.format(a='start_line', b='end_line')} as cost from sec join f using (file_id)),
  pieces as (select file_id, a, b, cost, 0 as split, a as s from sect where cost <= {budget} union all
    select file_id, k, k, cast(ceil((length(ls[k]) + 1) / 4.0) as bigint), 1, a from (select file_id, a, cost, ls, unnest(range(a, b + 1)) as k from sect join f using (file_id) where cost > {budget}) t),
  num as (select *, row_number() over (partition by file_id order by a) as i from pieces),
  r as (select file_id, i, a, b, split, s, cost as held, 0 as chunk_no from num where i = 1 union all
    select n.file_id, n.i, n.a, n.b, n.split, n.s, case when {new} then n.cost else r.held + n.cost end, r.chunk_no + {new}::int from r join num n on n.file_id = r.file_id and n.i = r.i + 1),
  c as (select file_id, chunk_no, min(a) as a, max(b) as b from r group by 1, 2)
select file_id, cast(chunk_no as int) as chunk_no, cast(first + a - 1 as int) as start_line, cast(b - a + 1 as int) as n_lines, {tokens.format(a='a', b='b')} as n_tokens from c join f using (file_id)"""


def chunk_budget(reviewer_module, s: Settings) -> str:
    rule = "case ext " + " ".join(f"when '{e}' then {_quote(r)}" for e, r in reviewer_module.LANGUAGE_RULES.items()) + " end"
    exts = ", ".join(f"'{e}'" for e in (*s.source_extensions, *s.config_extensions))
    return f"select cast(min(greatest(128, {s.max_input_tokens} - cast(ceil(length(concat_ws(chr(10), {_quote(reviewer_module.EXTRACT_BASE)}, {rule})) / 4.0) as bigint) - {s.overhead_tokens})) as bigint) as chunk_tokens from (select unnest([{exts}]) as ext) t"


def flattened(boundaries: dict[str, tuple[str, ...]], budget: int) -> str:
    """Files of parsed extensions whole, the others as the chunks of ``packed``."""
    whole = f"lower(regexp_extract(path, '[^/.][^/]*?(\\.[^./]*)$', 1)) in ({', '.join(repr(e) for e in boundaries)})"
    cut = packed(boundaries, budget, False).rsplit("select file_id, cast(chunk_no as int)", 1)[0]
    return cut + f"""select file_id, cast(first + a - 1 as int) as start_line, md5(array_to_string(ls[a:b], chr(10))) as md5 from c join f using (file_id) where not {whole}
union all select file_id, cast(greatest(coalesce(start_line, 1), 1) as int), md5(source_code) from (select distinct file_id, path, start_line, source_code from source_files where length(source_code) > 0) t where {whole}"""


def scan_filters(s: Settings) -> str:
    exts = ", ".join(f"'{e}'" for e in (*s.source_extensions, *s.config_extensions))
    parts = ", ".join(f"'{p}'" for p in s.excluded_parts)
    return f"""select file_id from (select distinct file_id, path, coalesce(source_code, '') as code from source_files) t
where regexp_extract(path, '[^/.][^/]*?(\\.[^./]*)$', 1) in ({exts}) and octet_length(encode(code)) <= 4096 and not list_has_any(string_split(path, '/'), [{parts}])"""


def _long_imports() -> str:
    def found(e: str) -> str:
        return f"regexp_extract_all(array_to_string(ls, chr(10)), {_quote(LONG_IMPORTS[e])})"

    return f"list_transform(list_filter(case when ext = '.py' then {found('.py')} when ext in ('.js', '.ts') then {found('.js')} else [] end, lambda x : contains(x, chr(10))), lambda x : regexp_replace(x, '#[^\n]*', '', 'g'))"


_STRIP = "trim(regexp_replace(trim(raw, ' '), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"
IMPORTS = LINES + f""", l as (select file_id, lower(regexp_extract(path, '[^/.][^/]*?(\\.[^./]*)$', 1)) as ext, unnest(list_filter(list_transform(ls || {_long_imports()}, lambda x : trim(x, ' ')), lambda x : x <> '')) as raw from f),
  k as (select file_id, ext, {_STRIP} as flat, raw from l where case ext when '.py' then regexp_matches(raw, '^(?:import|from)\\s') and not regexp_matches(raw, {_quote(OPEN_IMPORT)}) when '.js' then regexp_matches(raw, '^import\\s|require\\s*\\(') when '.ts' then regexp_matches(raw, '^import\\s|require\\s*\\(')
    when '.java' then regexp_matches(raw, '^import\\s') when '.go' then regexp_matches(raw, '^(?:package\\s|import\\s|"[^"]+"$)') when '.php' then regexp_matches(raw, '^(?:include|require|use\\s)')
    when '.c' then regexp_matches(raw, '^#include') when '.cpp' then regexp_matches(raw, '^#include') when '.cs' then regexp_matches(raw, '^using\\s') else false end),
  t as (select file_id, unnest(case ext
    when '.py' then case when starts_with(flat, 'import ') then list_transform(list_filter(list_transform(string_split(substr(flat, 8), ','), lambda c : trim(split_part(trim(c), ' as ', 1))), lambda c : c <> ''), lambda c : 'import:' || c)
      when regexp_matches(flat, '^from .* import ') then list_transform(list_filter(list_transform(string_split(trim(trim(regexp_extract(flat, '^from .*? import (.*)$', 1)), '()'), ','), lambda c : trim(split_part(trim(c), ' as ', 1))), lambda c : c <> ''), lambda c : 'import:' || trim(regexp_extract(flat, '^from (.*?) import ', 1)) || '.' || c) else [] end
    when '.java' then list_transform(regexp_extract_all(flat, 'import\\s+(?:static\\s+)?([a-zA-Z0-9_.*]+)\\s*;', 1), lambda c : 'import:' || c)
    when '.go' then case when starts_with(flat, 'package ') then ['import:' || trim(substr(flat, 9))] else list_transform(regexp_extract_all(flat, '"([^"]+)"', 1), lambda c : 'import:' || c) end
    when '.php' then list_transform(regexp_extract_all(flat, '(?:include|include_once|require|require_once)\\s*\\(?\\s*[''"]([^''"]+)[''"]', 1) || regexp_extract_all(flat, 'use\\s+([a-zA-Z0-9_\\\\]+)', 1), lambda c : 'import:' || c)
    when '.cs' then list_transform(regexp_extract_all(flat, 'using\\s+([a-zA-Z0-9_.]+)\\s*;', 1), lambda c : 'import:' || c)
    when '.c' then list_transform(regexp_extract_all(flat, '#include\\s*[<"]([^>"]+)[>"]', 1), lambda c : 'import:' || c)
    when '.cpp' then list_transform(regexp_extract_all(flat, '#include\\s*[<"]([^>"]+)[>"]', 1), lambda c : 'import:' || c)
    else list_transform(regexp_extract_all(flat, 'import\\s+(?:.+?\\s+from\\s+)?["'']([^"'']+)["'']', 1) || regexp_extract_all(flat, 'require\\s*\\(\\s*["'']([^"'']+)["'']\\s*\\)', 1), lambda c : 'import:' || c) end) as target from k)
select distinct file_id, target from t"""

UNIT_LINES = """select unit_id, trim(source_name) as caller, trim(target_name) as callee, trim(coalesce(source_desc, '')) as summary,
  case when unit_id % 7 <> 0 then start_code_line end as first_line, case when unit_id % 7 <> 0 then end_code_line end as last_line, unit_id % 7 = 0 as parse_error
from (select distinct unit_id, source_name, target_name, source_desc, start_code_line, end_code_line from code_units) t"""

_TAIL = "list_slice(list_filter(list_transform(string_split_regex(target_name, '[.:/\\\\]+'), lambda x : trim(x)), lambda x : x <> ''), -2, -1)"
SUPPORT = f"""case when target_name in ('{NO_DEPENDENCY}', '') then true when starts_with(target_name, 'import:') then (substr(target_name, 8) <> '' and contains(source_code, substr(target_name, 8)))
  or contains(source_code, string_split(substr(target_name, 8), '.')[-1]) or contains(source_code, string_split(substr(target_name, 8), '/')[-1])
  else len(list_filter({_TAIL}, lambda x : contains(source_code, x))) > 0 end"""


def natural(c: str) -> str:
    return f"select unit_id, (length({c}) = 0 or length({c}) > 120 or length({c}) - length(translate({c}, ' ，。', '')) >= 4 or (length({c}) >= 12 and regexp_full_match({c}, '[一-鿿_a-zA-Z0-9]+')))"


def _natural(c: str) -> str:
    return natural(c).replace("select unit_id, ", "")


VALIDATION = f"""select unit_id from (select *, row_number() over (partition by path, source_name, target_name, start_code_line, end_code_line order by unit_id) as rn from (select distinct * from code_units) u
  where coalesce(source_name, '') <> '' and coalesce(target_name, '') <> '' and not {_natural('source_name')} and not {_natural('target_name')} and start_code_line <= end_code_line and start_code_line >= 1 and trim(source_code) <> '' and {SUPPORT}) t where rn = 1"""

FINDINGS = "with f as (select * from (select *, row_number() over (partition by finding_id) as rn from findings) t where rn = 1) "
LEVEL = "['高危', '中危', '低危', 'low'][finding_id % 4 + 1]"
SEVERITY = "case when contains(t, '高危') or contains(lower(t), 'critical') or contains(lower(t), 'high') then 'high' when contains(t, '中危') or contains(lower(t), 'medium') then 'medium' when contains(t, '低危') or contains(lower(t), 'low') then 'low' else 'info' end"


def prompts(reviewer) -> str:
    rule = "case ext " + " ".join(f"when '{e}' then {_quote(r)}" for e, r in reviewer.LANGUAGE_RULES.items()) + " end"
    return f"""select ext, concat_ws(chr(10), {_quote(reviewer.EXTRACT_BASE)}, {rule}) as prompt, concat_ws(chr(10), {_quote(reviewer.AUDIT_BASE)}, coalesce({rule}, '')) as audit
from (select distinct lower(regexp_extract(path, '[^/.][^/]*?(\\.[^./]*)$', 1)) as ext from source_files) t"""

_VALUE = "80 * (ic > 0)::int + 100 * (sc > 0)::int + 180 * (ic > 0 and sc > 0)::int + 140 * (ic > 0 and sc > 0 and vc = 0 and fc = 0)::int + 40 * sc + 25 * ic + 8 * vc + 5 * fc + 10 * len(nodes) + pr"


def _valued(name: str, rows: str) -> str:
    """name: rows (kind, root, nodes, target, via) with the value of their nodes, every position counted."""
    return f"""{name}_s as (select kind, root, nodes, target, via, unnest(nodes) as id from {rows}),
  {name} as (select *, cast({_VALUE} as bigint) as value, '[''' || array_to_string(nodes, ''', ''') || ''']' as said from
    (select kind, root, nodes, target, via, sum(input_count) as ic, sum(sink_count) as sc, sum(validation_count) as vc, sum(safety_count) as fc, sum(priority) as pr from {name}_s join prio using (id) group by 1, 2, 3, 4, 5) t)"""


RANKED = HINTS + f""", steps2 as (
    select 'downstream' as kind, src as root, [src, dst] as nodes, dst as target, cast(null as varchar) as via from edges where src <> dst
    union all select 'upstream', dst, [src, dst], src, null from edges where src <> dst
    union all select 'downstream', a.src, [a.src, a.dst, b.dst], b.dst, a.dst from edges a join edges b on b.src = a.dst where a.src <> a.dst and b.dst <> a.src and not exists (select 1 from edges c where c.src = a.src and c.dst = b.dst)
    union all select 'upstream', b.dst, [a.src, a.dst, b.dst], a.src, a.dst from edges a join edges b on b.src = a.dst where a.dst <> b.dst and a.src <> b.dst and not exists (select 1 from edges c where c.src = a.src and c.dst = b.dst)),
  {_valued('sides', 'steps2')},
  chosen as (select * from (select x.*, row_number() over (partition by x.kind, x.root, x.target order by value desc, p.priority desc nulls last, encode(x.via) nulls last) as rn from sides x left join prio p on p.id = x.via) t where rn = 1),
  ordered as (select *, row_number() over (partition by kind, root order by value desc, encode(said)) as rk from chosen),
  spliced as (select 'through' as kind, a.root, list_concat(a.nodes, b.nodes[2:]) as nodes, a.target || '>' || b.target as target, cast(null as varchar) as via from ordered a join ordered b on a.root = b.root and a.kind = 'upstream' and b.kind = 'downstream' and a.rk <= 6 and b.rk <= 6),
  {_valued('through', 'spliced')},
  chains as (select kind, root, nodes, value, said from chosen union all select kind, root, nodes, value, said from through),
  ranked as (select * from (select c.*, row_number() over (partition by c.root order by value desc, (kind <> 'through')::int, encode(said)) as rank from chains c join profile p on p.id = c.root and p.has_source) t where rank <= 6)
"""

LOCAL = RANKED + """, ranked_nodes as (select root, rank, generate_subscripts(nodes, 1) as pos, unnest(nodes) as id from ranked),
  near as (select src as a, dst as b from edges union select dst, src from edges),
  roots as (select id as root from profile where has_source),
  taken as (select root, id, min(rank * 1000 + pos) as o from ranked_nodes group by 1, 2 union all select root, root, 900000 from roots where root not in (select root from ranked_nodes)),
  ring1 as (select t.root, n.b as id, row_number() over (partition by t.root order by p.priority desc, encode(n.b)) as o1 from roots t join near n on n.a = t.root join prio p on p.id = n.b
    where not exists (select 1 from taken x where x.root = t.root and x.id = n.b)),
  ring2 as (select root, id, min(o2) as o2 from (select r.root, n.b as id, r.o1 * 100000 + row_number() over (partition by r.root, r.id order by p.priority desc, encode(n.b)) as o2 from ring1 r join near n on n.a = r.id join prio p on p.id = n.b
    where not exists (select 1 from taken x where x.root = r.root and x.id = n.b) and not exists (select 1 from ring1 x where x.root = r.root and x.id = n.b)) t group by 1, 2),
  all_local as (select root, id, o from taken union all select root, id, 1000000 + o1 from ring1 union all select root, id, 2000000 + o2 from ring2),
  local as (select * from (select root, id, row_number() over (partition by root order by o) - 1 as ord from all_local) t where ord < 12),
  summary as (select root, count(*) as n_nodes, sum((input_count > 0)::int) as input_nodes, sum((sink_count > 0)::int) as sink_nodes, sum((validation_count > 0)::int) as validation_nodes, sum((safety_count > 0)::int) as safety_nodes, sum((input_count > 0 and sink_count > 0)::int) as combined_nodes
    from local join profile using (id) group by root),
  screened as (select id, n_nodes, hint_score, in_degree, out_degree, n_lines, 8 * input_count + 10 * sink_count + 3 * validation_count + 2 * safety_count + 4 * input_nodes + 5 * sink_nodes + 12 * combined_nodes + least(6, in_degree + out_degree) as score,
    input_count + sink_count + validation_count + safety_count > 0 or combined_nodes > 0 or (input_nodes > 0 and sink_nodes > 0) as signal from prio p join summary s on s.root = p.id)
"""


def _audit_prompt(ext: str) -> str:
    rule = f"case {ext} " + " ".join(f"when '{e}' then {_quote(r)}" for e, r in reviewer.LANGUAGE_RULES.items()) + " else '' end"
    return f"{_quote(reviewer.AUDIT_BASE)} || chr(10) || {rule}"


def _hint_line(kind: str) -> str:
    return f"case when len({kind}_hits) = 0 then '{kind}: none' else '{kind}: ' || array_to_string({kind}_hits[1:8], ' | ') end"


CONTEXTS = LOCAL + f""", says as (select n.id, coalesce(nullif(n.source_name, ''), nullif(n.target_name, ''), n.id) as label,
    concat_ws(chr(10), 'path: ' || n.path, 'file: ' || n.name, 'caller: ' || n.source_name, 'target: ' || n.target_name, 'lines: ' || n.start_line || '-' || n.end_line, 'code:' || chr(10) || n.source_code, 'summary: ' || n.descr, {', '.join(_hint_line(k) for k in hints.KINDS)}) as body,
    ceil(length('system: ' || {_audit_prompt("lower(regexp_extract(n.path, '[^/.][^/]*?([.][^./]*)$', 1))")}) / 4.0) as prompt_tokens from nodes n join hit_lists h on h.id = n.id),
  chain_nodes as (select root, rank, kind, generate_subscripts(nodes, 1) as pos, unnest(nodes) as id from ranked),
  chain_texts as (select root, rank, '<chain_' || (rank - 1) || '>' || chr(10) || 'kind: ' || kind || chr(10) || 'path: ' || string_agg(label, ' -> ' order by pos) || chr(10) || 'input_count: ' || sum(input_count) || chr(10) || 'sink_count: ' || sum(sink_count) || chr(10)
    || 'validation_count: ' || sum(validation_count) || chr(10) || 'safety_count: ' || sum(safety_count) || chr(10) || '<chain_' || (rank - 1) || '>' as t from chain_nodes join says using (id) join profile using (id) group by root, rank, kind),
  heads as (select root, '<context_summary>' || chr(10) || string_agg(t, chr(10) order by rank) || chr(10) || '<context_summary>' || chr(10) as head from chain_texts group by root),
  blocks as (select root, count(*) as n_nodes, string_agg('<node_' || ord || '>' || chr(10) || body || chr(10) || '<node_' || ord || '>', chr(10) order by ord) as b from local join says using (id) group by root),
  written as (select root, n_nodes, coalesce(head, '') || b as payload, cast(prompt_tokens + ceil(length('user: ' || coalesce(head, '') || b) / 4.0) as bigint) as tokens from blocks left join heads using (root) join says on says.id = root)
"""

# The two limits bind one another, so rows are walked in order with what was kept so far.
DEDUP_BOTH = CONTEXTS.replace("with u as", "with recursive u as", 1) + """, own as (select root, string_agg(id, ',' order by encode(id)) as ids from local group by root),
  sig as (select n.path, n.node_ord as ord, n.id, sha256(w.payload) as payload_sig, sha256(concat_ws('||', n.path, n.source_name, n.target_name, n.descr, n.source_code, ids)) as context_sig from nodes n join written w on w.root = n.id join own on own.root = n.id),
  num as (select *, row_number() over (partition by path order by ord) as i from sig),
  r as (select path, ord, id, payload_sig, context_sig, i, true as keep, [payload_sig] as a, [context_sig] as b from num where i = 1 union all
    select n.path, n.ord, n.id, n.payload_sig, n.context_sig, n.i, k, case when k then list_append(a, n.payload_sig) else a end, case when k then list_append(b, n.context_sig) else b end
    from (select r.path, r.i, a, b, n as n, not list_contains(a, n.payload_sig) and not list_contains(b, n.context_sig) as k from r join num n on n.path = r.path and n.i = r.i + 1) x)
select path, ord, id, payload_sig, context_sig from r where keep
"""
