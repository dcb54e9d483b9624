"""DuckDB SQL for the queries of ``plans.queries`` that SQL can express."""

from __future__ import annotations

REFUSAL = "(?i)\\bdo(?:es)? not contain (?:this|the|that) information\\b"


def _windows(size: int, overlap: int, source: str = "documents", cols: str = "doc_id, text") -> str:
    step = size - overlap
    return f"""select *, (seq * {step})::int as start_char, least(seq * {step} + {size}, length(text))::int as end_char, printf('A-%03d', seq) as id,
        substring(text, seq * {step} + 1, {size}) as body, ceil(length(substring(text, seq * {step} + 1, {size})) / 4.0)::int as est_tokens
      from (select {cols}, unnest(range(case when length(text) = 0 then 0 when length(text) <= {size} then 1 else 1 + ceil((length(text) - {size}) / {step}.0)::int end))::int as seq from {source})"""


def _fixed(size: int, overlap: int) -> str:
    return f"select doc_id, seq, id, start_char, end_char, est_tokens, sha256(body) as sha from ({_windows(size, overlap)})"


RUNS = [("A-300", 300, 30), ("A-500", 500, 50), ("A-800", 800, 80)]
ALL_RUNS = " union all ".join(f"select '{run}' as run_id, lang, doc_id, est_tokens from ({_windows(s, o, cols='doc_id, lang, text')})" for run, s, o in RUNS)

CONVERSATIONS = """select conv_id as doc_id, rtrim('# Conversation ' || conv_id || chr(10) || chr(10) || string_agg('## Turn ' || turn || ' ' || role || chr(10) || chr(10) || text || chr(10) || chr(10), '' order by turn), chr(10)) || chr(10) as text from conversations group by conv_id"""


def _cuts(size: int, overlap: int, source: str, cols: str) -> str:
    """Cuts with their line, tail and kind."""
    return f"""
    with w as ({_windows(size, overlap, source, cols)}),
    e as (select *, unnest(['start', 'end']) as side, unnest([start_char, end_char]) as position from w),
    i as (select * from e where position > 0 and position < length(rtrim(text, chr(10)))),
    l as (select *, ltrim(string_split(left(text, position), chr(10))[-1] || string_split(substring(text, position + 1), chr(10))[1]) as line,
            rtrim(string_split(substring(text, greatest(position - 1, 1), least(position, 2)), chr(10))[-1], ' ') as tail from i)
    select *, case when substring(text, position, 1) = chr(10) or substring(text, position + 1, 1) = chr(10) then 'clean'
        when starts_with(line, '|') then 'table-row' when starts_with(line, '- ') or starts_with(line, '* ') then 'list-item'
        when starts_with(line, '#') then 'heading' when regexp_matches(tail, '[.?!]$') then 'sentence-end' else 'mid-sentence' end as kind,
        regexp_matches(substring(text, position, 2), '^[\\p{{L}}\\p{{N}}]{{2}}$') as mid_word from l"""


_KINDS = ", ".join(f"count(*) filter (kind = '{k}') as {k.replace('-', '_')}" for k in ["table-row", "list-item", "heading", "mid-sentence", "sentence-end", "clean"]) + ", count(*) filter (mid_word) as mid_word"

TURNS = """
    parts as (select conv_id as doc_id, turn, role, text, 'Turn ' || turn || ' ' || role as title, length('# Conversation ' || conv_id) + 2 as head,
        length('## Turn ' || turn || ' ' || role) + 2 as prefix_len, length(text) as n from conversations),
    placed as (select *, (head + coalesce(sum(prefix_len + n + 2) over (partition by doc_id order by turn rows between unbounded preceding and 1 preceding), 0))::int as heading_start,
        row_number() over (partition by doc_id order by turn)::int as k from parts)"""

UNITS = """
    r as (select *, heading_start + prefix_len as b0, heading_start + prefix_len + n as b1 from placed),
    g as (select *, row_number() over w as pos, first_value(heading_start) over w as h0, first_value(b0) over w as f0, lag(b1) over w as prev_end from r window w as (partition by doc_id order by turn)),
    m as (select *, case when pos = 1 or (ceil((b1 - b0) / 4.0) >= {least} and ceil((prev_end - case when pos = 2 then f0 else h0 end) / 4.0) >= {least}) then 1 else 0 end as fresh from g),
    u as (select *, sum(fresh) over (partition by doc_id order by turn) as unit_no from m),
    units as (select doc_id, unit_no::int as unit_no, count(*)::int as sections,
        case when count(*) = 1 then 'Conversation ' || doc_id || ' > ' || min(title) else 'Conversation ' || doc_id end as path,
        case when count(*) = 1 then min(title) else 'Conversation ' || doc_id end as last,
        (case when count(*) = 1 then min(b0) else min(heading_start) end)::int as start_char, max(b1)::int as end_char from u group by doc_id, unit_no)"""

VECTORS = """
    q as (select vec_id as question_id, embedding as v, label as ql from embeddings where vec_id % 50 = 0),
    s as (select question_id, ql, vec_id as chunk_id, label as cl, list_dot_product(q.v::double[], e.embedding::double[]) as score from q, embeddings e),
    h as (select *, row_number() over (partition by question_id order by score desc, chunk_id)::int as rank from s)"""
SIZED = VECTORS + ", hit as (select h.*, coalesce(ceil(d.n_chars / 4.0)::int, 1) as est_tokens from h left join documents d on d.doc_id = h.chunk_id)"
BUDGET = SIZED + ", run as (select *, rank = 1 or sum(est_tokens) over (partition by question_id order by rank) <= 4000 as in_context from hit)"


def _norm(x: str) -> str:
    """Match form of an expression; ranges by three patterns, each twice, in place of a lookahead."""
    out = f"lower(trim(regexp_replace(regexp_replace({x}, '[\\x{{2010}}-\\x{{2015}}\\x{{2212}}]', '-', 'g'), '\\s+', ' ', 'g')))"
    for pattern in ("(\\d%?)\\s+(?:-|to)\\s*(\\d)", "(\\d%?)(?:-|to)\\s+(\\d)", "(\\d%?)to(\\d)"):
        for _ in range(2):
            out = f"regexp_replace({out}, '{pattern}', '\\1-\\2', 'g')"
    return out


KEY = f"""
    questions as (select 'Q' || n as question_id, n, 7 <> n % 7 + 1 as answerable from (select distinct item_id // 4 as n from benchmark)),
    facts as (select 'Q' || (item_id // 4) as question_id, (item_id % 4)::int as fact_ord, 'item ' || item_id as name, 'S' || (item_id % 2) as section, {_norm("text")} as accept
        from benchmark where 7 <> (item_id // 4) % 7 + 1),
    texts as (select 'Q' || (doc_id % (select count(*) from questions)) as question_id, doc_id, {_norm("text")} as hay from documents),
    hits as (select t.question_id, t.doc_id, f.fact_ord, f.name, f.section from texts t join facts f on f.question_id = t.question_id and contains(t.hay, f.accept))"""

REVIEW = """
    rv as (select d.source as run_id, d.lang, d.doc_id as question_id,
        case when quality = 1 then 'yes' when quality = 0 then 'no' else '' end as fin,
        case when d.doc_id % 4 = 0 then ['yes', 'partial', 'no'][(d.doc_id + 1) % 3 + 1] else '' end as sug,
        ['yes', 'partial', 'no'][d.doc_id % 3 + 1] as aut,
        case when d.doc_id % 6 = 0 then 'no' else '' end as afin, case when d.doc_id % 5 = 0 then 'partial' else '' end as asug, ['yes', 'partial', 'no'][(d.doc_id + 2) % 3 + 1] as aaut
        from documents d left join labels l on l.doc_id = d.doc_id),
    res as (select *, case when fin <> '' then fin when sug <> '' then sug else aut end as retrieval, case when fin <> '' then 'final' when sug <> '' then 'suggested' else 'auto' end as retrieval_source,
        case when afin <> '' then afin when asug <> '' then asug else aaut end as answer, case when afin <> '' then 'final' when asug <> '' then 'suggested' else 'auto' end as answer_source from rv)"""
SCORE = "case {c} when 'yes' then 1.0 when 'partial' then 0.5 when 'no' then 0.0 end::double"

ANSWERS = """
    a as (select 'run' || (conv_id % 3) as run_id, conv_id * 100 + turn as number, 'Q' || (conv_id * 100 + turn) as question_id, conv_id::varchar as context_ids,
        case when turn % 3 = 0 then 'The document does not contain this information.' else text end as answer_1,
        case when conv_id % 5 = 0 then 'Again: ' || text when turn % 3 = 0 then 'The document does not contain this information.' else text end as answer_2
        from conversations where role = 'assistant')"""

_DIRTY = "replace(text, chr(10), ' ' || chr(9) || chr(13) || chr(10) || chr(13) || chr(10) || chr(10) || chr(13)) || '  ' || repeat(chr(10), 5) || ' end' || chr(9) || chr(13)"
_NORMAL = f"rtrim(regexp_replace(regexp_replace(regexp_replace({_DIRTY}, '\\r\\n?', chr(10), 'g'), '[ \\t]+(\\n|$)', '\\1', 'g'), '\\n{{4,}}', repeat(chr(10), 3), 'g'), chr(10)) || chr(10)"

SQL = {
    "token_estimate": "select doc_id, ceil(length(text) / 4.0)::int as est_tokens from documents",
    "normalize_text": f"select doc_id, sha256(t) as sha, length(t)::int as n_chars from (select doc_id, {_NORMAL} as t from documents)",
    "match_normalize": f"""select doc_id, sha256({_norm("text || '  5 – 7%  to 9 − 11 to  12 x'")}) as sha from documents""",
    "text_sha256": "select doc_id, sha256(text) as sha from documents",
    "text_shapes": """select doc_id, sha256(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-')) as slug,
        case when length(flat) > 70 then rtrim(substring(flat, 1, 69)) || '…' else flat end as preview,
        sha256(replace(text, chr(10), '⏎')) as shown, sha256('title: none | text: ' || text) as filled, lang || '_model_' || source as safe
        from (select *, trim(regexp_replace(text, '\\s+', ' ', 'g')) as flat from documents)""",
    "fixed_chunks_500_50": _fixed(500, 50),
    "fixed_chunks_300_30": _fixed(300, 30),
    "fixed_chunks_800_80": _fixed(800, 80),
    "fixed_reconstruct": "select doc_id, sha256(text) as sha from documents where length(text) > 0",
    "chunk_stats_by_run": f"""select run_id, c.lang, count(*) as chunks, min(est_tokens)::int as min_tokens, max(est_tokens)::int as max_tokens, sum(est_tokens)::bigint as total_tokens, any_value(doc_tokens)::bigint as doc_tokens,
        avg(est_tokens) as mean_tokens, sum(est_tokens) / any_value(doc_tokens)::double as redundancy
        from ({ALL_RUNS}) c join (select lang, sum(ceil(length(text) / 4.0)::int) as doc_tokens from documents group by lang) d on d.lang = c.lang group by run_id, c.lang""",
    "cut_classification": f"""select doc_id, id, side, position, kind, mid_word, replace(substring(text, greatest(position - 25, 0) + 1, position - greatest(position - 25, 0)) || '|' || substring(text, position + 1, 25), chr(10), '⏎') as context
        from ({_cuts(500, 50, "documents", "doc_id, text")})""",
    "cut_summary": f"select lang, {_KINDS} from ({_cuts(500, 50, 'documents', 'doc_id, lang, text')}) group by lang",
    "noteworthy_cuts": f"select kind, count(*) as n, count(*) filter (mid_word) as in_word from ({_cuts(500, 50, 'documents', 'doc_id, text')}) where side = 'end' and (kind <> 'clean' or mid_word) group by kind",
    "markdown_cuts": f"select 'A-300' as run_id, {_KINDS} from ({_cuts(300, 30, f'({CONVERSATIONS})', 'doc_id, text')})",
    "md_sections": f"""with {TURNS} select doc_id, 0::int as sec_no, 1::int as level, 'Conversation ' || doc_id as title, 0::int as heading_start, any_value(head)::int as body_start, any_value(head)::int as body_end from parts group by doc_id
        union all select doc_id, k, 2, title, heading_start, (heading_start + prefix_len)::int, (heading_start + prefix_len + n)::int from placed""",
    "md_heading_paths": """select doc_id, unnest([0, 1, 2])::int as sec_no, unnest([source, source || ' > ' || lang, source || ' > ' || lang || ' > Doc ' || doc_id]) as path from documents""",
    "section_map": f"""with {TURNS} select doc_id, 'Conversation ' || doc_id as heading, 2::int as n_chars from parts group by doc_id
        union all select doc_id, title, (2 + n + case when k = max(k) over (partition by doc_id) then 1 else 2 end)::int from placed""",
    "md_merge_min100": f"with {TURNS}, {UNITS.format(least=100)} select doc_id, unit_no, sections, path, start_char, end_char from units",
    "md_merge_min40": f"with {TURNS}, {UNITS.format(least=40)} select doc_id, unit_no, sections, path, start_char, end_char from units",
    "structure_chunks_fast": f"""with {TURNS}, {UNITS.format(least=100)}, docs as ({CONVERSATIONS}),
        b as (select u.*, path || chr(10) || chr(10) || substring(d.text, start_char + 1, end_char - start_char) as t, trim(regexp_replace(lower(last), '[^a-z0-9]+', '-', 'g'), '-') as slug from units u join docs d on d.doc_id = u.doc_id),
        n as (select *, row_number() over (partition by doc_id, slug order by unit_no) as again from b)
        select doc_id, (unit_no - 1)::int as seq, 'B-' || slug || case when again > 1 then '-' || again else '' end as id, path, start_char, end_char, ceil(length(t) / 4.0)::int as est_tokens, sha256(t) as sha from n""",
    "prefix_toggle": f"""with {TURNS}, {UNITS.format(least=100)} select doc_id, (unit_no - 1)::int as seq, true as same_bounds, ceil((length(path) + 2 + end_char - start_char) / 4.0)::int as with_path, ceil((end_char - start_char) / 4.0)::int as without_path from units""",
    "split_coverage": "select doc_id, true as fits, length(regexp_replace(text, '\\s', '', 'g'))::int as n_solid from documents",
    "split_tables": """with d as (select doc_id, (doc_id % 60 + 1)::int as n from documents), c as (select *, case when n <= 7 then 1 else ceil(n / 7.0)::int end as m from d),
        r as (select *, least(m - 1, floor((21 * (i - 1) + 10.5) / (21.0 * n / m)))::int as g from (select *, unnest(range(1, n + 1))::int as i from c)),
        p as (select doc_id, any_value(n) as n, any_value(m) as m, g, min(i)::int as first, max(i)::int as last from r group by doc_id, g)
        select doc_id, (row_number() over (partition by doc_id order by g) - 1)::int as k, first, last, first > 1 as repeated, true as headed,
          case when first = 1 then 0 else 22 + 21 * (first - 1) end::int as start, (22 + 21 * last - 1)::int as "end" from p""",
    "split_code": """with d as (select doc_id, (doc_id % 40 + 2)::int as n from documents), l as (select doc_id, n, i, (i - 1) // 5 as g from (select *, unnest(range(1, n + 1)) as i from d))
        select doc_id, g::int as k, '```py' || chr(10) || string_agg('line_' || lpad(i::varchar, 5, '0'), chr(10) || chr(10) order by i) || chr(10) || '```' as text, any_value(n) >= 5 as repeated from l group by doc_id, g
        """,
    "cosine_topk": f"with {VECTORS} select question_id, chunk_id, rank from h where rank <= 5",
    "context_topk": f"with {SIZED} select question_id, string_agg(chunk_id::varchar, ' ' order by rank) as context_ids, sum(est_tokens)::bigint as context_tokens from hit where rank <= 3 group by question_id",
    "context_token_budget": f"with {BUDGET} select question_id, string_agg(chunk_id::varchar, ' ' order by rank) as context_ids, sum(est_tokens)::bigint as context_tokens from run where in_context group by question_id",
    "logged_hits": f"with {BUDGET} select question_id, chunk_id, rank, est_tokens, in_context from (select *, count(*) filter (in_context) over (partition by question_id) as size from run) where rank <= greatest(5, size)",
    "rank_metrics": f"""with {VECTORS}, o as (select question_id, min(rank - 1) filter (cl = ql) as first from h where rank <= 6 and chunk_id <> question_id group by question_id)
        select count(*) as questions, count(*) filter (first = 1) as hits_at_1, avg(case when first = 1 then 1.0 else 0.0 end) as hit_at_1, avg(coalesce(1.0 / first, 0)) as mrr from o""",
    "fact_match": f"with {KEY} select distinct question_id, doc_id, fact_ord, name, section from hits",
    "fact_labels": f"""with {KEY}, f as (select question_id, count(distinct fact_ord) as n, count(distinct section) as sections, string_agg(distinct name, '; ' order by name) as facts from hits group by question_id)
        select q.question_id, case when not answerable then 'N/A' when f.n >= 2 and sections = 2 then 'yes' when f.n >= 1 then 'partial' else 'no' end as label, coalesce(facts, '') as facts
        from questions q left join f on f.question_id = q.question_id where q.question_id in (select question_id from texts)""",
    "answer_checks": f"""with {KEY}, f as (select question_id, doc_id, count(distinct fact_ord) as n, count(distinct section) as sections from hits group by question_id, doc_id)
        select t.question_id, t.doc_id, case when not answerable then case when t.doc_id % 7 = 6 then 'yes' else 'no' end when t.doc_id % 7 = 6 then 'no' when f.n >= 2 and sections = 2 then 'yes' when f.n >= 1 then 'partial' else 'no' end as label
        from texts t join questions q on q.question_id = t.question_id left join f on f.question_id = t.question_id and f.doc_id = t.doc_id""",
    "refusal_rate": f"with {ANSWERS} select run_id, count(*) as answers, count(*) filter (regexp_matches(answer_1, '{REFUSAL}')) as refusals from a group by run_id",
    "accuracy_by_lang": f"with {REVIEW} select lang, count(*) as n, sum({SCORE.format(c='retrieval')}) as score, 100 * avg({SCORE.format(c='retrieval')}) as accuracy from res group by lang",
    "label_resolution": f"with {REVIEW} select question_id, retrieval, retrieval_source, answer, answer_source from res",
    "label_sources": f"""with {REVIEW} select run_id, count(*) filter (retrieval_source = 'final') as final_labels, count(*) filter (retrieval_source = 'suggested') as suggested_labels,
        count(*) filter (retrieval_source = 'auto') as auto_labels, bool_or(retrieval_source <> 'final') as provisional from res group by run_id""",
    "stale_suggestions": f"""with {ANSWERS}, s as (select *, number % 9 <> 0 as same_context, answer_1 = answer_2 as same_answer, case when number % 4 = 0 then '' else 'yes' end as given from a)
        select run_id, question_id, case when same_context then 'partial' else '' end as retrieval_label_suggested, case when same_answer then given else '' end as answer_label_suggested,
        case when not same_context and given <> '' and not same_answer then '[not applied: the context and answer changed since review] read' when not same_context then '[not applied: the context changed since review] read'
          when given <> '' and not same_answer then '[not applied: the answer changed since review] read' else 'read' end as suggestion_reason from s""",
    "manual_warnings": f"with {ANSWERS} select run_id, question_id, 'answer' as changed from a where number % 2 = 0 and answer_1 <> answer_2",
    "key_validation_errors": f"""with f as (select 'Q' || (item_id // 4) as question_id, 'S' || (item_id % 2) as section, text as accepted from benchmark where 7 <> (item_id // 4) % 7 + 1),
        s as materialized (select 'S' || (doc_id % 2) as section, {_norm("text")} as hay from documents where text is not null),
        n as materialized (select distinct section, accepted, {_norm("accepted")} as needle from f),
        hit as (select distinct n.section, n.accepted from n join s on n.section = s.section and contains(s.hay, n.needle))
        select distinct question_id, 'no section: ' || section as error from f where section not in (select section from s)
        union all select question_id, 'not in section ' || section || ': ' || accepted from f where section in (select section from s) and (section, accepted) not in (select (section, accepted) from hit)""",
    "key_rule_errors": """with q as (select n, 'Q' || n as question_id, 7 <> n % 7 + 1 as answerable, n_facts, two from (select item_id // 4 as n, count(*) as n_facts, count(distinct item_id % 2) as two from benchmark group by 1))
        select question_id, 'min_facts_for_yes is out of range' as error from q where answerable and n % 3 = 0
        union all select question_id, 'unanswerable question has facts, sections or a minimum' from q where not answerable and n % 3 = 0
        union all select question_id, 'section without a fact: S9' from q where answerable and n % 4 = 1
        union all select question_id, 'fact of an unlisted section: S1' from q where answerable and n % 4 = 1""",
    "stability_flips": f"""with {ANSWERS} select run_id, count(*) as questions, count(*) filter (answer_1 <> answer_2) as changed_texts,
        count(*) filter (regexp_matches(answer_1, '{REFUSAL}') <> regexp_matches(answer_2, '{REFUSAL}')) as flips from a group by run_id""",
    "ablation_pivot": f"""select doc_id, count(*) filter (run_id = 'A-300') as a_300, count(*) filter (run_id = 'A-500') as a_500, count(*) filter (run_id = 'A-800') as a_800 from ({ALL_RUNS}) group by doc_id""",
    "prompt_context": f"""with {VECTORS}, t as (select question_id, string_agg('[' || k || ']' || chr(10) || text, chr(10) || chr(10) order by rank) as c
        from (select h.question_id, h.rank, row_number() over (partition by h.question_id order by h.rank) as k, trim(d.text) as text from h join documents d on d.doc_id = h.chunk_id where rank <= 3) group by question_id)
        select question_id, sha256(c) as sha, length(c)::int as n_chars from t""",
    "embed_dedupe": "select lang, count(*) as texts, count(distinct text) as to_embed from documents group by lang",
    "cache_hit_miss": "with k as (select text, bool_or(lang = 'en') as hit from documents group by text) select count(*) filter (hit) as hits, count(*) filter (not hit) as misses from k",
    "rate_window_60s": """select event_id, count(*) over w as requests_60s, (sum(floor(value)::bigint) over w)::bigint as tokens_60s from events
        window w as (order by ts range between interval 59999999 microseconds preceding and current row)""",
    "unit_vectors": "select vec_id, len(embedding)::int as dims, true as unit from embeddings",
    "citation_map": f"with {SIZED} select question_id, string_agg(rank::varchar, ' ' order by rank) as numbers, string_agg(chunk_id::varchar, ' ' order by rank) as chunk_ids from hit where rank <= 3 group by question_id",
    "review_rows": f"""with {KEY}, f as (select question_id, count(distinct fact_ord) as n, count(distinct section) as sections, string_agg(distinct name, '; ' order by name) as facts from hits group by question_id),
        c as (select question_id, sha256(string_agg(t.doc_id::varchar, ' ' order by t.doc_id)) as context_sha, sum(ceil(length(text) / 4.0)::int)::varchar as context_tokens, min(t.doc_id) as first from texts t join documents d on d.doc_id = t.doc_id group by question_id),
        a as (select c.question_id, count(distinct fact_ord) as n, count(distinct section) as sections, string_agg(distinct name, '; ' order by name) as facts from c left join hits h on h.question_id = c.question_id and h.doc_id = c.first group by c.question_id)
        select c.question_id, 'What does passage group ' || q.n || ' say?' as question, context_sha, context_tokens,
          case when not answerable then 'N/A' when f.n >= 2 and f.sections = 2 then 'yes' when f.n >= 1 then 'partial' else 'no' end as retrieval_auto, coalesce(f.facts, '') as facts_in_context,
          case when not answerable then case when first % 3 = 0 then 'yes' else 'no' end when first % 3 = 0 then 'no' when a.n >= 2 and a.sections = 2 then 'yes' when a.n >= 1 then 'partial' else 'no' end as answer_auto,
          case when first % 3 = 0 then '' else coalesce(a.facts, '') end as facts_in_answer
        from c join questions q on q.question_id = c.question_id left join f on f.question_id = c.question_id left join a on a.question_id = c.question_id""",
    "run_metrics": f"""with {REVIEW}, x as (select res.*, question_id % 10 <> 0 as can, d.n_chars, {SCORE.format(c='retrieval')} as rs, {SCORE.format(c='aut')} as ras, {SCORE.format(c='answer')} as ans from res join documents d on d.doc_id = res.question_id),
        y as (select *, (select min(r) from range(1, 6) t(r) where (question_id + r) % 7 = 0) as first from x)
        select run_id, count(*) as chunks, 100 * avg(rs) filter (can) as retrieval_accuracy, 100 * avg(ras) filter (can) as retrieval_accuracy_auto, case when run_id <> 'src1' then 100 * avg(ans) end as answer_accuracy, run_id <> 'src1' as answered,
          count(*) filter (can and retrieval_source = 'final') as retrieval_final, count(*) filter (can and retrieval_source = 'suggested') as retrieval_suggested, count(*) filter (can and retrieval_source = 'auto') as retrieval_auto,
          avg(case when first = 1 then 1.0 else 0.0 end) filter (can) as hit_at_1, avg(coalesce(1.0 / first, 0)) filter (can) as mrr,
          avg(ceil(n_chars / 4.0)) as mean_context_tokens, bool_or(can and retrieval_source <> 'final') or (run_id <> 'src1' and bool_or(answer_source <> 'final')) as provisional, count(*)::int as questions
        from y group by run_id""",
}
