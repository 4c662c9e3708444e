"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _centroids(clusters: int = 16, rounds: int = 3, dims: int = 64) -> str:
    """k-means with a full comparison of every vector with every centroid."""
    square = "list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [
        f"""p as materialized (
            select row_number() over () as row, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v
            from embeddings
            where len(embedding) = {dims} and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))
        )""",
        f"""c0 as materialized (
            select (row_number() over (order by h, v) - 1)::int as cluster, v
            from (select sha256('1:' || vec_id::varchar) as h, v from p order by h nulls last, v limit {clusters})
        )""",
    ]
    for turn in range(rounds + 1):
        steps.append(f"""a{turn} as materialized (
            select row, vec_id, p.v, arg_min(c.cluster, d * {clusters} + c.cluster) as cluster, min(d)::bigint as distance
            from (select p.*, c.cluster, {square} as d from p cross join c{turn} c) as s(row, vec_id, v, cluster, d)
            group by row, vec_id, v
        )""".replace("p.v, arg_min", "v, arg_min").replace("arg_min(c.cluster", "arg_min(cluster").replace("+ c.cluster)", "+ cluster)"))
        if turn < rounds:
            steps.append(f"""c{turn + 1} as materialized (
                select c.cluster, coalesce(n.v, c.v) as v from c{turn} c left join (
                    select cluster, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as v
                    from (
                        select cluster, i, sum(x) as s, count(*) as n
                        from (select cluster, unnest(v) as x, generate_subscripts(v, 1) as i from a{turn}) group by cluster, i
                    ) group by cluster
                ) n using (cluster)
            )""")
    return f"""
        with {", ".join(steps)}
        select vec_id, cluster, distance,
               (sum(distance) over (partition by cluster))::bigint as cluster_inertia,
               (sum(distance) over ())::bigint as inertia,
               sha256(array_to_string(c.v, ',')) as centroid_sha256
        from a{rounds} a join c{rounds} c using (cluster)
    """


def _spelling(depth: int = 30) -> str:
    """Near words share a mask (one letter blanked), or one is the other with a letter left out.

    crc32 is worked out bit by bit. n grows fivefold with every form, so ``depth`` steps reach any root.
    """
    digits = "0123456789ABCDEF"
    octet = " + ".join(f"(strpos('{digits}', substr(code, 2 * i + {k}, 1)) - 1) * {w}" for k, w in ((1, 16), (2, 1)))
    bits = "list_reduce(list_prepend(xor(c, b), repeat([0::ubigint], 8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))"
    return f"""
        with recursive runs as (
            select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all({_LOWER}, '[a-z\u00C0-\u00FF]+')) as run from documents
        ),
        counted as (select id, run, count(*) as m from runs where length(run) >= 6 group by id, run),
        coded as (select run, m, hex(encode(id || ':' || run)) as code from counted),
        hashed as (
            select run, m, xor(4294967295, list_reduce(
                list_prepend(4294967295::ubigint, list_transform(range(length(code) // 2), lambda i: ({octet})::ubigint)),
                lambda c, b: {bits}
            ))::bigint as h
            from coded
        ),
        spelt as (
            select m, case when h % 199 = 0
                then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word
            from hashed
        ),
        v as materialized (select word, sum(m)::bigint as n from spelt where length(word) >= 6 group by word having sum(m) >= 5),
        places as (select word, unnest(range(length(word))) as p from v),
        cut as materialized (select word, p, substr(word, 1, p) || substr(word, p + 2) as rest from places),
        pairs as (
            select a.word, b.word as other from cut a join cut b using (p, rest)
            where a.word <> b.word and length(a.word) = length(b.word)
            union select c.word, v.word from cut c join v on c.rest = v.word
            union select v.word, c.word from cut c join v on c.rest = v.word
        ),
        best as (
            select pairs.word, count(*) as n_near, max(o.n) as best_n, arg_min(other, (-o.n, other)) as best
            from pairs join v o on o.word = other group by pairs.word
        ),
        forms as materialized (
            select word, n, coalesce(n_near, 0)::bigint as n_near, case when best_n >= 5 * n then best end as form,
                   case when best_n >= 5 * n then best_n end as form_n
            from v left join best using (word)
        ),
        walk as (
            select word, word as now, 0 as step from v
            union all
            select walk.word, form, step + 1 from walk join forms f on f.word = now where form is not null and step < {depth}
        )
        select word, form, arg_max(now, step) as root, n, n_near, form_n from forms join walk using (word)
        group by word, form, n, n_near, form_n
    """


#: Bytes as two hexadecimal digits each; a string of 50 bytes is 100 digits.
_SUFFIXES = """
    with d as materialized (
        select row_number() over () as row, doc_id, hex(encode(coalesce(text, ''))) as digits from documents
    ),
    strings as materialized (
        select row, doc_id, p, substr(digits, 2 * p + 1, 100) as s
        from (select row, doc_id, digits, unnest(range(length(digits) // 2 - 49)) as p from d)
    ),
    twice as (select s, min(doc_id) as first from strings group by s having min(doc_id) < max(doc_id)),
    hit as (select row, p from strings join twice using (s) where first < doc_id),
    runs as (
        select row, p, sum(new) over (partition by row order by p) as run
        from (select row, p, case when p <= lag(p) over (partition by row order by p) + 50 then 0 else 1 end as new from hit)
    ),
    spans as materialized (select row, run, min(p) as a, max(p) + 50 as b from runs group by row, run),
    parts as (
        select row, a, substr(digits, 2 * coalesce(lag(b) over (partition by row order by a), 0) + 1,
                              2 * (a - coalesce(lag(b) over (partition by row order by a), 0))) as part
        from spans join d using (row)
    ),
    heads as (select row, string_agg(part, '' order by a) as head from parts group by row),
    counts as (select row, count(*) as n_spans, sum(b - a) as n_removed, max(b) as last from spans group by row)
    select doc_id, length(digits) // 2 as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0) as n_spans,
           sha256(unhex(coalesce(head, '') || substr(digits, 2 * coalesce(last, 0) + 1))) as kept_sha256
    from d left join heads using (row) left join counts using (row)
"""


ORACLE_SQL: dict[str, str] = {
    "op13_suffix_dedup": _SUFFIXES,
    "op12_spelling": _spelling(),
    "op11_centroids": _centroids(),
    "op2_exact_dedup": f"""
        with n as (select doc_id, {_LOWER} as norm from documents),
        g as (select norm, max(doc_id) as keep_id, count(*) as group_size from n group by norm)
        select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, sha256(norm) as text_sha256
        from n join g using (norm)
    """,
    "op3_decontamination": f"""
        with d as (
            select doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents
        ),
        i as (
            select item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark
        ),
        windows as (
            select distinct cast(item_id as varchar) as item, least(len(w), 13) as size,
                   unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1),
                                         lambda p: array_to_string(w[p : p + 12], ' '))) as gram
            from i where len(w) > 0
        ),
        sizes as (select distinct size from windows),
        places as (
            select doc_id, size, unnest(range(1, len(w) - size + 2)) as p,
                   unnest(list_transform(range(1, len(w) - size + 2),
                                         lambda p: array_to_string(w[p : p + size - 1], ' '))) as gram
            from d cross join sizes where len(w) >= size
        ),
        found as (select doc_id, p, size, item from places join windows using (gram, size)),
        hit as (
            select doc_id, count(distinct q) as n_hit
            from (select doc_id, unnest(range(p, p + size)) as q from found) group by doc_id
        ),
        named as (
            select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
            from (select distinct doc_id, item from found) group by doc_id
        )
        select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
               sha256(coalesce(items, '')) as items_sha256,
               coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
        from d left join hit using (doc_id) left join named using (doc_id)
    """,
}
