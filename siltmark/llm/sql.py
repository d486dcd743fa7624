"""SQL (DuckDB) of the queries that it can express whole."""

_ESCAPED = "replace(replace({}, '\\', '\\\\'), '<', '\\l')"
_TURNS = (
    "c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all "
    "select -7, x.turn, x.role, '</s>[INST] ok [/INST]' from (values (0, 'user'), (1, 'assistant')) x(turn, role)), "
    f"e as (select *, length({_ESCAPED.format('role')}) + length(role) - length(replace(role, chr(10), '')) + length({_ESCAPED.format('text')}) + 8 as n from c)"
)
_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = {
    "op9_benchmark_decontamination": f"""with d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
        b as (select item_id, w, least(10, len(w)) as n from (select item_id, {_WORDS} as w from benchmark) where len(w) > 0),
        bw as (select distinct item_id, n, array_to_string(w[i : i + n - 1], ' ') as k from (select *, unnest(range(1, len(w) - n + 2)) as i from b)),
        dw as (select r, i, n, array_to_string(w[i : i + n - 1], ' ') as k from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from b) where len(w) >= n)),
        h as (select distinct r, i, n from dw semi join bw using (n, k)),
        c as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from h) group by r),
        t as (select r, count(*) as n_items, string_agg(cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from (select distinct r, item_id from dw join bw using (n, k)) group by r)
        select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, n_hit is not null as contaminated
        from d left join c using (r) left join t using (r)""",
    "op5_chat_formatting": f"""with {_TURNS}, g as (select conv_id, cast(count(*) as bigint) as n_turns, cast(sum(n) as bigint) as formatted_chars,
        string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as every_text,
        coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '') as loss from e group by conv_id)
        select conv_id, n_turns, sha256(every_text) as turns_sha256, cast(length(loss) as bigint) as loss_chars, sha256(loss) as loss_sha256, formatted_chars from g""",
}
