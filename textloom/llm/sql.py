"""DuckDB SQL of the llm queries that SQL can express on whole tables.

The other operators (fingerprints, language model, pieces, classifier, shards, packing,
pages) have none; ``tests/llm`` holds them against brute force.
"""

from __future__ import annotations

_WORDS = "list_filter(string_split_regex({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DUPLICATES = f"""
with recursive w as (select doc_id, {_WORDS.format(text=_LOWER)} as ws from documents),
  s as (select distinct doc_id, array_to_string(ws[i : i + 2], ' ') as g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) as i from w where len(ws) > 0)),
  n as (select doc_id, count(*) as n from s group by doc_id),
  p as (select a.doc_id as x, b.doc_id as y, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
  e as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * k >= 85 * (nx.n + ny.n - k)),
  both_ways as (select x, y from e union select y, x from e),
  reach(doc_id, root) as (select doc_id, doc_id from documents union select b.y, r.root from reach r join both_ways b on b.x = r.doc_id),
  c as (select doc_id, min(root) as component_id from reach group by doc_id)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id, d.doc_id = c.component_id as kept
from documents d join c on c.doc_id = d.doc_id left join n on n.doc_id = d.doc_id
"""

HOST_RULES = f"""
with w as (select doc_id, source, coalesce(text, '') as text, {_WORDS.format(text="coalesce(text, '')")} as ws from documents),
  g as (select doc_id, i, array_to_string(ws[i : i + 7], ' ') as k from (select doc_id, ws, unnest(range(1, len(ws) - 6)) as i from w where len(ws) > 7)),
  twice as (select doc_id, i from (select *, count(*) over (partition by doc_id, k) as n from g) where n > 1),
  covered as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 8)) as p from twice) group by doc_id),
  lines as (select doc_id, sum(n - 1) as n from (select doc_id, line, count(*) as n from (select doc_id, unnest(string_split(text, chr(10))) as line from w)
    where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by doc_id, line) group by doc_id),
  m as (select w.doc_id, source, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(lines.n, 0)::bigint as n_dup_lines, coalesce(covered.n, 0)::bigint as n_repeat_words
    from w left join covered on covered.doc_id = w.doc_id left join lines on lines.doc_id = w.doc_id),
  b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m),
  h as (select source, count(*)::double as n, (count(*) filter (base_failed))::double as f from b where source is not null group by source),
  t as (select sum(n) as n, count(*) as h, least(greatest(sum(f) / sum(n), 1e-6), 1 - 1e-6) as m from h),
  v as (select any_value(t.n) as n, any_value(t.m) as m, greatest(sum(h.n * power(h.f / h.n - t.m, 2)) / any_value(t.n) - any_value(t.m * (1 - t.m) * t.h / t.n), 1e-9) as between_hosts from h, t),
  prior as (select m * strength as a, (1 - m) * strength as b from (select m, least(greatest(m * (1 - m) / between_hosts - 1, 1.0), 1e6) as strength from v)),
  bad as (select source from h, prior where (f + a) / (n + a + b) > 0.5)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and (source is null or source not in (select source from bad)) as kept from b
"""

REPEATS = """
with b as (select doc_id, encode(coalesce(text, '')) as t, octet_length(encode(coalesce(text, ''))) as n from documents),
  w as (select doc_id, i, array_slice(t, i, i + 49) as s from (select doc_id, t, unnest(range(1, n - 48)) as i from b where n >= 50)),
  f as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by s) as first from w) where first < doc_id),
  g as (select doc_id, i, case when i > lag(i) over (partition by doc_id order by i) + 50 then 1 else 0 end as fresh from f),
  r as (select doc_id, run, min(i) as lo, max(i) + 50 as hi from (select *, sum(fresh) over (partition by doc_id order by i) as run from g) group by doc_id, run),
  k as (select doc_id, hi as lo, lead(lo) over (partition by doc_id order by lo) as hi from r union all select doc_id, 1, min(lo) from r group by doc_id),
  c as (select b.doc_id, list(array_slice(b.t, k.lo, coalesce(k.hi - 1, b.n)) order by k.lo) as parts from k join b on b.doc_id = k.doc_id where coalesce(k.hi - 1, b.n) >= k.lo group by b.doc_id)
select b.doc_id, b.n::bigint as n_bytes, coalesce(x.removed, 0)::bigint as n_removed, coalesce(x.spans, 0)::bigint as n_spans,
  sha256(case when x.doc_id is null then b.t else coalesce(list_reduce(parts, lambda p, q: p || q), ''::blob) end) as kept_sha256
from b left join (select doc_id, sum(hi - lo) as removed, count(*) as spans from r group by doc_id) x on x.doc_id = b.doc_id left join c on c.doc_id = b.doc_id
"""

SQL = {"op7_neardup": NEAR_DUPLICATES, "op8_substrings": REPEATS, "op10_rules": HOST_RULES}
