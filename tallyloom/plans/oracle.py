"""SQL counterparts of the queries, for an independent engine on the same tables.

Written from the definitions, not from the operators: window functions where those use joins,
one row number per segment where those use buckets, ``quantile_cont`` where those use
frequencies. The dialect is DuckDB's.
"""

from __future__ import annotations

from tallyloom.plans.settings import CHOICES, EXPECTED, MIN_CLASS, MIN_DEPARTMENT, SAME_NAMES, SWEEP

ORACLE_SQL: dict[str, str] = {}

SPACE_CODES = [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
SPACES = " || ".join(f"chr({c})" for c in SPACE_CODES)
NON_WORD = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def words(column: str) -> str:
    return (
        f"case when trim({column}, {SPACES}) in ('', 'No Review Text', 'Untitled Review') then 0 "
        f"else len(regexp_split_to_array(trim({column}, {SPACES}), '{NON_WORD}')) end"
    )


def rate(part: str, whole: str) -> str:
    return f"coalesce(cast({part} as double) / nullif(cast({whole} as double), 0) * 100, 0)"


def mean(total: str, count: str) -> str:
    return f"coalesce(cast({total} as double) / nullif({count}, 0), 0)"


def literal(values) -> str:
    return ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)


BASE = f"""
with li as (select l_orderkey, min(l_partkey) pk, count(*) nl from lineitem group by l_orderkey),
nd as (select cast(floor(count(*) * 1.1) as bigint) m from documents),
derived as (
  select o.o_orderkey as row_id, cast(li.pk as double) as clothing_id,
    case when c.c_custkey % 97 = 0 then null else cast(15 + c.c_custkey % 60 as double) end as age,
    p.p_name as title,
    case when o.o_orderkey % 20 = 0 then d.text
         else d.text || ' #' || cast(o.o_orderkey as varchar) end as review_text,
    case when o.o_orderkey % 211 = 0 then cast(7 as double)
         when o.o_orderkey % 223 = 0 then null
         else cast(substr(o.o_orderpriority, 1, 1) as double) end as rating,
    case when o.o_orderkey % 149 = 0 then cast(2 as double)
         when o.o_orderkey % 151 = 0 then null
         when cast(substr(o.o_orderpriority, 1, 1) as int)
              + (case when o.o_orderstatus = 'F' then 1 else 0 end) >= 4
         then cast(1 as double) else cast(0 as double) end as recommended_ind,
    cast(li.nl as double) as positive_feedback_count,
    r.r_name as division_name,
    case when o.o_orderkey % 131 = 0 then null else c.c_mktsegment end as department_name,
    n.n_name as class_name
  from orders o cross join nd
  left join li on li.l_orderkey = o.o_orderkey
  left join part p on p.p_partkey = li.pk and p.p_type <> 'ECONOMY'
  left join customer c on c.c_custkey = o.o_custkey
  left join nation n on n.n_nationkey = c.c_nationkey
  left join region r on r.r_regionkey = n.n_regionkey
  left join documents d on d.doc_id = o.o_orderkey % nd.m),
raw as (
  select row_id, clothing_id, age, nullif(trim(title, {SPACES}), '') as title,
    nullif(trim(review_text, {SPACES}), '') as review_text, rating, recommended_ind,
    positive_feedback_count, nullif(trim(division_name, {SPACES}), '') as division_name,
    nullif(trim(department_name, {SPACES}), '') as department_name,
    nullif(trim(class_name, {SPACES}), '') as class_name
  from derived),
filled as (
  select row_id, clothing_id, age, coalesce(title, 'Untitled Review') as title,
    coalesce(review_text, 'No Review Text') as review_text, rating, recommended_ind,
    positive_feedback_count, coalesce(division_name, 'Unknown') as division_name,
    coalesce(department_name, 'Unknown') as department_name,
    coalesce(class_name, 'Unknown') as class_name,
    review_text is not null as has_review_text, title is not null as has_title
  from raw),
clean as (
  select *,
    coalesce(rating in (1, 2, 3, 4, 5), false) as valid_rating,
    coalesce(recommended_ind in (0, 1), false) as valid_recommendation,
    case when trunc(rating) in (1, 2) then 'Negative' when trunc(rating) = 3 then 'Neutral'
         when trunc(rating) in (4, 5) then 'Positive' else 'Unknown' end as sentiment,
    case when trunc(recommended_ind) = 1 then 'Recommended'
         when trunc(recommended_ind) = 0 then 'Not Recommended' else 'Unknown' end as recommendation_label,
    case when age is null then 'Unknown' when age <= 29 then '18-29' when age <= 39 then '30-39'
         when age <= 49 then '40-49' when age <= 59 then '50-59' else '60+' end as age_band,
    cast({words('review_text')} as int) as review_length_words,
    cast({words('title')} as int) as title_length_words,
    has_review_text and count(*) over (partition by lower(trim(review_text, {SPACES}))) > 1
      as is_duplicate_review_text
  from filled)"""

CHOSEN = " and ".join(
    [
        f"division_name in ({literal(CHOICES['divisions'])})",
        f"sentiment in ({literal(CHOICES['sentiments'])})",
        f"recommendation_label in ({literal(CHOICES['recommendations'])})",
        f"age_band in ({literal(CHOICES['age_bands'])})",
        f"rating in ({literal(CHOICES['ratings'])})",
    ]
)
TERM = "contains(lower(review_text || ' ' || title), '{}')"


def add(name: str, query: str, ctes: str = "") -> None:
    ORACLE_SQL[name] = f"{BASE}{',' if ctes else ''}\n{ctes}\n{query}".strip()


# Rows --------------------------------------------------------------------------------------
add("clean_reviews", "select * exclude (title, review_text) from clean")
add(
    "clean_texts",
    "select row_id, md5(title) as title_md5, md5(review_text) as text_md5, review_length_words, "
    "title_length_words, has_review_text, has_title from clean",
)
add(
    "stored_sketches",
    """
    select department_name as department, x.m as measure, x.n as n, true as within from (
        select department_name, unnest([
            {'m': 'rating', 'n': count(rating)}, {'m': 'age', 'n': count(age)},
            {'m': 'positive_feedback_count', 'n': count(positive_feedback_count)},
            {'m': 'review_length_words', 'n': count(*) filter (has_review_text)},
            {'m': 'products', 'n': count(distinct clothing_id)}
        ]) as x from clean group by department_name)
    """,
)
ORDERS = {
    "Helpful votes (high to low)": "positive_feedback_count desc", "Rating (low to high)": "rating", "Rating (high to low)": "rating desc",
    "Review length (long to short)": "review_length_words desc", "Age (young to old)": "age", "Clothing ID": "clothing_id",
}
add(
    "review_pages_sorted",
    " union all ".join(
        f"select * from (select '{name}' as sort, row_number() over (order by {order} nulls last, row_id) as position, row_id "
        "from clean where has_review_text and coalesce(positive_feedback_count, 0) >= 2) where position between 51 and 75"
        for name, order in ORDERS.items()
    ),
)
add(
    "review_page_deep",
    "select position, row_id from (select row_number() over (order by rating desc nulls last, row_id) as position, row_id, "
    "greatest(1, count(*) over () // 25) as page from clean where has_review_text) "
    "where position between (page - 1) * 25 + 1 and page * 25",
)
add("layer_appended", "select row_id, department_name, sentiment from clean where is_duplicate_review_text")
add("duplicate_review_flags", "select row_id, department_name from clean where is_duplicate_review_text")
add(
    "displayable_reviews",
    "select row_id, rating, sentiment from clean where has_review_text and valid_rating and sentiment <> 'Unknown'",
)
add("filtered_reviews_multi", f"select row_id, rating, class_name from clean where {CHOSEN}")
add("filtered_text_availability", "select row_id, title, sentiment from clean where not has_review_text")
add(
    "keyword_search",
    f"select row_id, title, rating from clean where has_review_text and {TERM.format('blue')}",
)
add(
    "keyword_search_indexed",
    " union all ".join(
        f"select '{term}' as term, row_id, title, rating from clean where has_review_text and {TERM.format(term.strip().lower())}"
        for term in (" Blue ", "#1203")
    ),
)
add(
    "filtered_reviews_text",
    "select row_id, department_name, class_name from clean where department_name in ('BUILDING', 'MACHINERY') "
    f"and class_name in ('NATION_1', 'NATION_7', 'NATION_12') and has_review_text and {TERM.format('the')}",
)
add(
    "review_excerpts",
    "select row_id, md5(case when length(review_text) > 260 then rtrim(substr(review_text, 1, 257), " + SPACES + ") || '...' "
    "else review_text end) as excerpt_md5 from clean",
)
add("index_column_dropped", "select row_id, rating, class_name from raw")
add(
    "csv_mixed_files",
    "select row_id, clothing_id, rating, class_name, case when row_id % 3 = 0 then 'plain' else 'café' end as title from raw",
)
add(
    "csv_quoted_records",
    "select row_id, rating, md5('\"' || coalesce(title, '') || E',\"\\n\\n\"\",' || coalesce(review_text, 'none') || E'\\n,') as text_md5 from raw",
)
add(
    "default_file",
    "select row_id as key, rating, department_name, 'Womens Clothing E-Commerce Reviews.csv' as source from raw",
)
add(
    "layer_replaced",
    """
    , half as (select * from clean where row_id % 2 = 0),
    texts as (select md5(lower(trim(review_text, """ + SPACES + """))) as t, count(*) as n from half where has_review_text group by t)
    select department_name, 1 as version, 1 as after_refusal, count(*) as reviews, count(*) filter (n > 1) as repeated
    from half left join texts on has_review_text and t = md5(lower(trim(review_text, """ + SPACES + """))) group by department_name
    union all select department_name, 2, 1, count(*), count(*) filter (is_duplicate_review_text) from clean group by department_name
    """,
)
SHEET = """
    select '{name}' as sheet, unnest([
        {{'p': 'Source', 'v': '{name}'}}, {{'p': 'Rows', 'v': cast(count(*) as varchar)}}, {{'p': 'Source columns', 'v': '10'}},
        {{'p': 'Matches expected schema', 'v': '{fits}'}}, {{'p': 'Missing required columns', 'v': '{missing}'}},
        {{'p': 'Unrecognised columns', 'v': '{extra}'}}
    ]) as x from raw
"""
add(
    "property_sheet",
    "select sheet, x.p as property, x.v as value from ("
    + SHEET.format(name="reviews", fits="Yes", missing="None", extra="None")
    + " union all " + SHEET.format(name="other", fits="No", missing="age", extra="store") + ")",
)
add(
    "helpful_negative_filter",
    "select row_id, positive_feedback_count, sentiment from clean "
    "where sentiment = 'Negative' and coalesce(positive_feedback_count, 0) >= 5",
)
add("scope_reviews", "select row_id, department_name from clean where department_name in ('BUILDING', 'Unknown')")
add("age_distribution", "select age from clean where age is not null")
add(
    "csv_round_trip",
    "select row_id, rating, sentiment, age_band, has_review_text, review_length_words, department_name, "
    "md5(review_text) as text_md5 from clean",
)

# Cleaning audit and facets -----------------------------------------------------------------
STEPS = [
    ("Remove export index", "0"), ("Note text availability", "nt + ni"), ("Fill titles", "ni"),
    ("Fill review texts", "nt"), ("Fill product taxonomy", "tax"), ("Check ratings", "br"),
    ("Check recommendation flags", "bf"), ("Derive sentiment", "n"),
    ("Derive recommendation label", "n"), ("Derive age band", "n"), ("Count words", "n"),
    ("Flag repeated texts", "dup"), ("Limit text display", "nt"),
]
add(
    "cleaning_audit",
    " union all ".join(
        f"select cast({i} as int) as step, '{name}' as name, cast({rows} as bigint) as rows_affected from a"
        for i, (name, rows) in enumerate(STEPS, start=1)
    ),
    """a as (select count(*) n, count(*) filter (not has_review_text) nt, count(*) filter (not has_title) ni,
      count(*) filter (not valid_rating) br, count(*) filter (not valid_recommendation) bf,
      count(*) filter (is_duplicate_review_text) dup,
      (select sum((division_name is null)::int + (department_name is null)::int + (class_name is null)::int) from raw) tax
      from clean)""",
)
FACETS = """select distinct 'division' as facet, division_name as value from clean
union all select distinct 'department', department_name from clean where {divisions}
union all select distinct 'class', class_name from clean where {divisions} and {departments}
union all select distinct 'rating', cast(cast(trunc(rating) as bigint) as varchar) from clean where rating is not null
union all select distinct 'sentiment', sentiment from clean where sentiment <> 'Unknown'
union all select distinct 'recommendation', recommendation_label from clean where recommendation_label <> 'Unknown'
union all select distinct 'age_band', age_band from clean"""
add(
    "facet_values",
    FACETS.format(
        divisions="division_name in ('ASIA', 'EUROPE')", departments="department_name in ('BUILDING', 'MACHINERY')"
    ),
)
add(
    "kept_selections",
    "select facet, value from f where (facet = 'class' and value in ('NATION_1', 'NATION_7', 'NATION_99')) "
    "or (facet = 'rating' and value in ('1', '9'))",
    f"f as ({FACETS.format(divisions=chr(39).join(['division_name = ', 'ASIA', '']), departments='true')})",
)
add(
    "scope_size",
    f"select *, {rate('rows_in_scope', 'rows_total')} as share from "
    f"(select count(*) filter ({CHOSEN}) as rows_in_scope, count(*) as rows_total from clean)",
)
add("scope_categories", "select distinct class_name as category from clean where trim(class_name) <> ''")


# KPIs --------------------------------------------------------------------------------------
def kpis(source: str) -> str:
    classified = "(pos + neu + neg)"
    return f"""(select n as total_records, wt as records_with_text, n - wt as missing_review_text,
      n - ti as missing_title, {rate('wt', 'n')} as text_coverage_rate,
      coalesce(ar, 0) as average_rating, case when n = 0 then 0 else mr end as median_rating,
      {rate('yes', 'flags')} as recommendation_rate, yes as recommended_count, no as not_recommended_count,
      pos as positive_reviews, {rate('pos', classified)} as positive_rate,
      neu as neutral_reviews, {rate('neu', classified)} as neutral_rate,
      neg as negative_reviews, {rate('neg', classified)} as negative_rate,
      cast(coalesce(votes, 0) as bigint) as total_positive_feedback,
      coalesce(av, 0) as average_positive_feedback, coalesce(aa, 0) as average_age,
      case when n = 0 then 0 else ma end as median_age, coalesce(al, 0) as average_review_length,
      dup as duplicate_review_rows, ids as unique_clothing_ids
    from (select count(*) n, count(*) filter (has_review_text) wt, count(*) filter (has_title) ti,
      avg(rating) ar, median(rating) mr, count(*) filter (valid_recommendation) flags,
      count(*) filter (recommended_ind = 1) yes, count(*) filter (recommended_ind = 0) no,
      count(*) filter (sentiment = 'Positive') pos, count(*) filter (sentiment = 'Neutral') neu,
      count(*) filter (sentiment = 'Negative') neg, sum(positive_feedback_count) votes,
      avg(positive_feedback_count) av, avg(age) aa, median(age) ma,
      avg(review_length_words) filter (has_review_text) al,
      count(*) filter (is_duplicate_review_text) dup, count(distinct clothing_id) ids
    from {source}))"""


add("kpis", f"select * from {kpis('clean')}")
add("kpis_filtered", f"select * from {kpis('x')}", f"x as (select * from clean where {CHOSEN})")
add("kpis_empty", f"select * from {kpis('x')}", "x as (select * from clean where division_name = 'ATLANTIS')")
add(
    "largest_vote_count",
    "select cast(coalesce(max(positive_feedback_count), 0) as bigint) as largest_vote_count from clean",
)
add(
    "domain_validity",
    "select count(*) filter (not valid_rating) as invalid_ratings, count(*) filter (not valid_recommendation) "
    "as invalid_recommendations, bool_and(valid_rating and valid_recommendation) as passed from clean",
)

# Distributions -----------------------------------------------------------------------------
for name, column, labels, alias in (
    ("sentiment_distribution", "sentiment", ("Negative", "Neutral", "Positive"), "sentiment"),
    ("recommendation_distribution", "recommendation_label", ("Not Recommended", "Recommended"), "recommendation"),
):
    add(
        name,
        f"select label as {alias}, n as reviews, {rate('n', 'sum(n) over ()')} as share from c",
        f"""d as (select unnest([{literal(labels)}]) as label),
        c as (select label, count(clean.row_id) n from d left join clean on {column} = label group by label)""",
    )
add(
    "rating_distribution",
    f"""select cast(r as int) as rating, r || case when r = 1 then ' star' else ' stars' end as rating_label,
    n as reviews, {rate('n', 'sum(n) over ()')} as share from c""",
    """d as (select unnest([1, 2, 3, 4, 5]) as r),
    c as (select r, count(clean.row_id) n from d left join clean on rating = r group by r)""",
)
CELLS = """d as (select s, r from (select unnest(['Negative', 'Neutral', 'Positive']) as s),
  (select unnest(['Not Recommended', 'Recommended']) as r)),
cells as (select s, r, count(clean.row_id) n from d
  left join clean on sentiment = s and recommendation_label = r group by s, r),
shares as (select s, r, n, """ + rate("n", "sum(n) over (partition by s)") + " as p from cells)"
add(
    "recommendation_by_sentiment",
    "select s as sentiment, r as recommendation, n as reviews, p as share from shares",
    CELLS,
)
LABEL = "case when {0} >= 6 then format('{{:.1f}}%', {0}) else '' end"
add(
    "recommendation_stack",
    f"""select a.s as sentiment, a.n as not_recommended_reviews, b.n as recommended_reviews,
    a.p as not_recommended_share, b.p as recommended_share, {LABEL.format('a.p')} as not_recommended_label,
    {LABEL.format('b.p')} as recommended_label from shares a join shares b on a.s = b.s
    where a.r = 'Not Recommended' and b.r = 'Recommended'""",
    CELLS,
)
HELPFUL = f"""v as (select sentiment, coalesce(positive_feedback_count, 0) v from clean),
d as (select unnest(['Negative', 'Neutral', 'Positive']) as s),
h as (select s as sentiment, count(v) as reviews, cast(coalesce(sum(v), 0) as bigint) as total_helpful_votes,
  coalesce(avg(v), 0) as avg_helpful_votes, coalesce(median(v), 0) as median_helpful_votes,
  count(*) filter (v >= 1) as reviews_with_votes from d left join v on v.sentiment = s group by s),
helpful as (select *, {rate('total_helpful_votes', 'sum(total_helpful_votes) over ()')} as share_of_votes from h)"""
add("helpful_by_sentiment", "select * from helpful", HELPFUL)
add(
    "numeric_summary",
    """select measure, count(v) as count, avg(v) as mean, median(v) as median,
    round(coalesce(stddev_samp(v), 0), 6) as std_dev, min(v) as min, quantile_cont(v, 0.25) as p25,
    quantile_cont(v, 0.75) as p75, max(v) as max from x where v is not null group by measure""",
    "x as ("
    + " union all ".join(
        f"select '{c}' as measure, cast({c} as double) as v from clean"
        for c in ("age", "rating", "positive_feedback_count", "review_length_words")
    )
    + ")",
)
add(
    "age_histogram",
    """select low + floor((age - low) / 5) * 5 as bin_start, low + floor((age - low) / 5) * 5 + 5 as bin_end,
    count(*) as reviews, any_value(mean) as mean_age, any_value(med) as median_age
    from clean, m where age is not null group by 1, 2""",
    "m as (select min(age) low, avg(age) mean, median(age) med from clean)",
)
add(
    "review_length_box",
    """select q.*, min(v) as lower_fence, max(v) as upper_fence from q join x using (sentiment)
    where v >= q1 - 1.5 * (q3 - q1) and v <= q3 + 1.5 * (q3 - q1) group by all""",
    """x as (select sentiment, cast(review_length_words as double) v from clean
      where has_review_text and sentiment <> 'Unknown'),
    q as (select sentiment, count(*) as reviews, avg(v) as mean, quantile_cont(v, 0.25) as q1,
      median(v) as median, quantile_cont(v, 0.75) as q3 from x group by sentiment)""",
)


# Segments ----------------------------------------------------------------------------------
def segments(by: str, alias: str | None = None) -> str:
    classified = "count(*) filter (sentiment <> 'Unknown')"
    counted = lambda s: f"count(*) filter (sentiment = '{s}')"
    yes = "count(*) filter (recommended_ind = 1)"
    return f"""(select {by} as {alias or by}, count(*) as reviews, {rate('count(*)', '(select count(*) from clean)')} as share,
      coalesce(avg(rating), 0) as avg_rating, {yes} as recommended_reviews,
      count(*) filter (recommended_ind = 0) as not_recommended_reviews,
      {rate(yes, 'count(recommended_ind)')} as recommendation_rate,
      {counted('Positive')} as positive_reviews, {rate(counted('Positive'), classified)} as positive_rate,
      {counted('Neutral')} as neutral_reviews, {rate(counted('Neutral'), classified)} as neutral_rate,
      {counted('Negative')} as negative_reviews, {rate(counted('Negative'), classified)} as negative_rate,
      cast(sum(coalesce(positive_feedback_count, 0)) as bigint) as helpful_votes,
      avg(coalesce(positive_feedback_count, 0)) as avg_helpful_votes,
      count(*) filter (has_review_text) as reviews_with_text from clean group by {by})"""


BASELINE = f"base as (select * from {kpis('clean')})"
for name, column in (("segment_division", "division_name"), ("segment_age_band", "age_band")):
    add(name, f"select * from {segments(column)}")
add("segment_department", f"select * from {segments('department_name')} where reviews >= {MIN_DEPARTMENT}")
add("segment_product", f"select * from {segments('clothing_id')}")
add("segment_class", f"select * from {segments('class_name')} where reviews >= {MIN_CLASS}")
add(
    "segments_all",
    " union all ".join(
        f"select '{d}' as dimension, * from {segments(d, 'segment')}"
        for d in ("division_name", "department_name", "class_name", "age_band")
    ),
)
add("top_classes", f"select * from {segments('class_name')} order by reviews desc, class_name limit 10")
add(
    "helpful_by_class",
    f"""select class_name as product_class, reviews, helpful_votes, avg_helpful_votes, negative_rate, avg_rating
    from {segments('class_name')} order by helpful_votes desc, class_name limit 10""",
)
add(
    "advocacy_vs_criticism",
    """select class_name, reviews, 'recommendation_rate' as measure, recommendation_rate as rate from t
    union all select class_name, reviews, 'negative_rate', negative_rate from t""",
    f"t as (select * from {segments('class_name')} order by reviews desc, class_name limit 8)",
)
add(
    "segment_overview",
    f"""select division_name, reviews, recommendation_rate, negative_rate, avg_rating * 20 as rating_on_100
    from {segments('division_name')}""",
)


def bands(good: str, poor: str) -> str:
    return f"case when {good} then 'Strong' when {poor} then 'Needs Attention' else 'Average' end"


add(
    "worst_classes",
    f"""select class_name, reviews, s.negative_reviews, s.negative_rate, b.negative_rate as baseline_negative_rate,
    {bands('s.negative_rate - b.negative_rate <= -2', 's.negative_rate - b.negative_rate >= 5')} as band
    from {segments('class_name')} s, base b where reviews >= {MIN_CLASS}
    order by s.negative_rate desc, class_name limit 15""",
    BASELINE,
)
add(
    "class_performance_matrix",
    f"""select class_name as product_class, reviews as review_count, avg_rating, recommended_reviews,
    s.recommendation_rate, s.negative_reviews, s.negative_rate, helpful_votes as total_helpful_votes,
    case when s.negative_rate - b.negative_rate >= 5 then 'Needs Attention'
         when s.negative_rate - b.negative_rate <= -2 and s.recommendation_rate >= b.recommendation_rate
         then 'Strong' else 'Average' end as performance,
    {bands('avg_rating - average_rating >= 0.1', 'avg_rating - average_rating <= -0.2')} as rating_band,
    {bands('s.recommendation_rate - b.recommendation_rate >= 2', 's.recommendation_rate - b.recommendation_rate <= -5')} as recommendation_band,
    {bands('s.negative_rate - b.negative_rate < 2', 's.negative_rate - b.negative_rate >= 5')} as negative_band
    from {segments('class_name')} s, base b where reviews >= {MIN_CLASS}""",
    BASELINE,
)
UNIT = "greatest(abs(average_rating), 1)"
add(
    "department_vs_baseline",
    f"""select department_name, reviews, avg_rating, s.recommendation_rate, average_rating as baseline_rating,
    b.recommendation_rate as baseline_recommendation_rate,
    {bands(f'avg_rating - average_rating >= 0.02 * {UNIT}', f'avg_rating - average_rating <= -0.05 * {UNIT}')} as rating_band,
    {bands('s.recommendation_rate - b.recommendation_rate >= 2', 's.recommendation_rate - b.recommendation_rate <= -5')} as recommendation_band
    from {segments('department_name')} s, base b""",
    BASELINE,
)

# Quality -----------------------------------------------------------------------------------
RAW_COLUMNS = (
    "clothing_id", "age", "title", "review_text", "rating", "recommended_ind",
    "positive_feedback_count", "division_name", "department_name", "class_name",
)
NUMBERS = ("clothing_id", "age", "rating", "recommended_ind", "positive_feedback_count")
PRESENT = "p as (" + " union all ".join(
    f"select '{c}' as field, count(*) as n, count({c}) as present from raw" for c in RAW_COLUMNS
) + ")"
add(
    "missing_by_field",
    f"""select field, n as rows, present, n - present as missing, {rate('n - present', 'n')} as missing_rate,
    case when n = present then 'Strong' when (n - present) / n < 0.1 then 'Average' else 'Needs Attention' end as band
    from p""",
    PRESENT,
)
add(
    "column_completeness",
    f"""select field as column, present, n - present as missing, {rate('present', 'n')} as completeness_rate,
    case when {rate('present', 'n')} >= 99 then 'Strong' when {rate('present', 'n')} >= 90 then 'Average'
    else 'Needs Attention' end as band from p""",
    PRESENT,
)
GAPS = " + ".join(f"({c} is null)::int" for c in RAW_COLUMNS)
COMPLETE = f"""completeness as (select cast(n * 10 as bigint) as total_cells, cast(gaps as bigint) as missing_cells,
  {rate('n * 10 - gaps', 'n * 10')} as completeness_rate, full_rows as complete_rows,
  {rate('full_rows', 'n')} as complete_row_rate
  from (select count(*) n, sum({GAPS}) gaps, count(*) filter (({GAPS}) = 0) full_rows from raw))"""
add("completeness_metrics", "select * from completeness", COMPLETE)
SUMMARY = COMPLETE + """,
summary as (select count(*) as total_rows, count(*) filter (not has_title) as missing_titles,
  count(*) filter (not has_review_text) as missing_review_texts,
  count(*) filter (is_duplicate_review_text) as duplicate_review_rows,
  count(distinct review_text) filter (is_duplicate_review_text) as duplicate_review_texts,
  count(*) filter (not valid_rating) as invalid_ratings,
  count(*) filter (not valid_recommendation) as invalid_recommendations,
  count(*) filter (division_name = 'Unknown') as missing_division,
  count(*) filter (department_name = 'Unknown') as missing_department,
  count(*) filter (class_name = 'Unknown') as missing_class from clean)"""
add("quality_summary", "select * from summary, completeness", SUMMARY)
ISSUES = [
    ("Missing title", "missing_titles", "'Low'"), ("Missing review text", "missing_review_texts", "'Medium'"),
    ("Missing division name", "missing_division", "'Low'"),
    ("Missing department name", "missing_department", "'Low'"),
    ("Missing class name", "missing_class", "'Low'"),
    ("Repeated review text", "duplicate_review_rows", "'Low'"),
    ("Invalid rating", "invalid_ratings", "case when invalid_ratings > 0 then 'High' else 'None' end"),
    ("Invalid recommendation flag", "invalid_recommendations",
     "case when invalid_recommendations > 0 then 'High' else 'None' end"),
]
add(
    "quality_report",
    " union all ".join(
        f"select cast({i} as int) as position, '{issue}' as issue, {rows} as affected_rows, "
        f"{rate(rows, 'total_rows')} as percentage, {severity} as severity from summary"
        for i, (issue, rows, severity) in enumerate(ISSUES, start=1)
    ),
    SUMMARY,
)


def sample(column: str) -> str:
    text = f"cast({column} as varchar)"
    first = f"(select {text} from raw where {column} is not null order by row_id limit 1)"
    return f"case when length({first}) > 70 then substr({first}, 1, 67) || '...' else coalesce({first}, '') end"


add(
    "column_profile",
    " union all ".join(
        f"select '{c}' as column, '{'double' if c in NUMBERS else 'string'}' as dtype, count({c}) as non_null, count(*) - count({c}) as missing, "
        f"{rate(f'count(*) - count({c})', 'count(*)')} as missing_rate, count(distinct {c}) as \"unique\", "
        f"{sample(c)} as sample from raw"
        for c in RAW_COLUMNS
    ),
)

# Validation --------------------------------------------------------------------------------
CHECKS = "checks as (" + " union all ".join(
    f"select '{e.label}' as metric, cast({e.kpi} as double) as calculated, cast({e.expected} as double) as expected, "
    f"cast({e.tolerance} as double) as tolerance, '{e.kind}' as kind from base"
    for e in EXPECTED
) + """),
verdicts as (select *, calculated - expected as difference,
  case when tolerance > 0 then abs(calculated - expected) <= tolerance else calculated = expected end as passed from checks)"""


def shown(value: str) -> str:
    return (
        f"case kind when 'percent' then format('{{:,.2f}}%', {value}) when 'rating' then format('{{:,.3f}}', {value}) "
        f"else format('{{:,}}', cast({value} as bigint)) end"
    )


add(
    "validation_table",
    f"""select metric, calculated, expected, difference, case when passed then 'Match' else 'Deviation' end as status,
    passed, {shown('calculated')} as calculated_text, {shown('expected')} as expected_text,
    case when difference < 0 then '-' else '+' end || case when tolerance > 0 then format('{{:,.3f}}', abs(difference))
    else format('{{:,}}', cast(abs(difference) as bigint)) end as difference_text from verdicts""",
    f"{BASELINE}, {CHECKS}",
)
add(
    "validation_summary",
    """select count(*) as checks, count(*) filter (passed) as passed, count(*) filter (not passed) as failed,
    coalesce(string_agg(metric, '; ' order by metric) filter (not passed), '') as failed_metrics,
    bool_and(passed) as all_passed from verdicts""",
    f"{BASELINE}, {CHECKS}",
)

# Lists of reviews --------------------------------------------------------------------------
SHOWN = """clothing_id, age, age_band, title, review_text, rating, sentiment,
recommendation_label as recommendation, {votes} as helpful_votes, division_name as division,
department_name as department, class_name as class"""
TOP = """select row_number() over (order by coalesce(positive_feedback_count, 0) desc, review_length_words desc, row_id)
as rank, row_id, """ + SHOWN.format(votes="cast(coalesce(positive_feedback_count, 0) as bigint)") + """
from clean where has_review_text{more} order by rank limit 25"""
add("most_helpful_reviews", TOP.format(more=""))
add("most_helpful_negative", TOP.format(more=" and sentiment = 'Negative'"))
MATCHES = f"m as (select * from clean where has_review_text and {TERM.format('the')} and coalesce(positive_feedback_count, 0) >= 2)"
add(
    "review_page",
    f"""select row_number() over (order by age asc nulls last, row_id) as position, row_id,
    {SHOWN.format(votes='positive_feedback_count')} from m order by position limit 25 offset 50""",
    MATCHES,
)
add(
    "review_page_after",
    f"""select row_number() over (order by rating desc nulls last, row_id) as position, row_id,
    {SHOWN.format(votes='positive_feedback_count')} from clean
    where has_review_text and sentiment = 'Negative' and (rating < 2 or (rating = 2 and row_id > 5000))
    order by position limit 25""",
)
add(
    "page_summary",
    """select count(*) as matches, greatest(1, cast(ceil(count(*) / 25) as bigint)) as pages,
    cast(51 as bigint) as first_row, greatest(50, least(count(*), 75)) as last_row from m""",
    MATCHES,
)


# Scenarios ---------------------------------------------------------------------------------
def scenario(assumptions, by: str | None, source: str = "clean") -> str:
    """CTE ``result``: one row per scenario and segment, with plain row numbers for the ratings."""
    values = ", ".join(
        f"({place}, '{a.name}', {a.negative_reached / 100.0!r}::double, {a.intervention_success / 100.0!r}::double, "
        f"{a.success_to_positive / 100.0!r}::double, {a.neutral_to_positive / 100.0!r}::double, "
        f"{a.advocacy_conversion / 100.0!r}::double)"
        for place, a in enumerate(assumptions)
    )
    part = lambda count, fraction: f"least(cast(round_even({count} * {fraction}, 0) as bigint), {count})"
    seg = by or "'all'"
    return f"""assumed(place, scenario, reached, success, topos, neutral, advocacy) as (values {values}),
rows_ as (select {seg} as seg, row_id, sentiment, rating, recommended_ind,
  row_number() over (partition by {seg}, sentiment order by row_id) as rn from {source}),
b0 as (select seg, count(*) n, count(*) filter (sentiment = 'Negative') neg, count(*) filter (sentiment = 'Neutral') neu,
  count(*) filter (recommended_ind = 1) r1, count(*) filter (recommended_ind = 0) not_recommended,
  coalesce(avg(rating), 0) avg_rating, coalesce(sum(rating), 0) rating_sum from rows_ group by seg),
b1 as (select *, n - neg - neu as pos, case when r1 + not_recommended > 0 and r1 + not_recommended < n
  then n - not_recommended else r1 end as recommended from b0),
m1 as (select *, {part('neg', 'reached')} as reached_neg, {part('neu', 'neutral')} as neu_to_pos,
  {part('not_recommended', 'advocacy')} as advocacy_conversions from b1, assumed),
m2 as (select *, {part('reached_neg', 'success')} as successful_neg from m1),
m3 as (select *, {part('successful_neg', 'topos')} as neg_to_pos from m2),
m4 as (select *, successful_neg - neg_to_pos as neg_to_neu from m3),
change as (select m4.place, m4.seg, sum(case when sentiment = 'Negative' and rn <= neg_to_pos then 4 - rating
    when sentiment = 'Negative' and rn <= successful_neg then 3 - rating
    when sentiment = 'Neutral' and rn <= neu_to_pos then 4 - rating else 0 end) as d
  from m4 join rows_ on m4.seg is not distinct from rows_.seg group by all),
m5 as (select m4.*, rating_sum + coalesce(d, 0) as sim_rating_sum from m4 join change c on m4.place = c.place and m4.seg is not distinct from c.seg),
m6 as (select *, neg - successful_neg as sim_neg, neu + neg_to_neu - neu_to_pos as sim_neu,
  pos + neg_to_pos + neu_to_pos as sim_pos, recommended + advocacy_conversions as sim_recommended,
  not_recommended - advocacy_conversions as sim_not_recommended,
  sim_rating_sum / n as sim_avg_rating, successful_neg + neu_to_pos as successfully_improved_reviews from m5),
result as (select place, scenario, seg, n, neg, neu, pos, recommended, not_recommended, avg_rating, rating_sum, reached_neg,
  successful_neg, neg_to_pos, neg_to_neu, neu_to_pos, advocacy_conversions, sim_neg, sim_neu, sim_pos,
  sim_recommended, sim_not_recommended, sim_avg_rating, sim_rating_sum, successfully_improved_reviews,
  {rate('pos', 'n')} as baseline_positive_rate, {rate('neu', 'n')} as baseline_neutral_rate,
  {rate('neg', 'n')} as baseline_negative_rate, {rate('recommended', 'n')} as baseline_recommendation_rate,
  {rate('sim_pos', 'n')} as sim_positive_rate, {rate('sim_neu', 'n')} as sim_neutral_rate,
  {rate('sim_neg', 'n')} as sim_negative_rate, {rate('sim_recommended', 'n')} as sim_recommendation_rate from m6)"""


DEFAULT_ONLY = [a for a in SWEEP if a.name == "default"]
add("scenario_overall", "select * exclude (place, seg) from result", scenario(SWEEP, None))
add(
    "scenario_scoped",
    "select * exclude (place, seg), true as finite from result",
    "scoped as (select * from clean where division_name in ('ASIA', 'EUROPE')),\n"
    + scenario(DEFAULT_ONLY, None, "scoped"),
)
add("scenario_by_class", "select * exclude (place) rename (seg as class_name) from result", scenario(SWEEP, "class_name"))

add("scenario_by_product", "select * exclude (place) rename (seg as clothing_id) from result", scenario(DEFAULT_ONLY, "clothing_id"))
add("scenario_same_names", "select * exclude (place, seg) from result", scenario(SAME_NAMES, None))


def departments(assumptions, min_reviews: int) -> str:
    """CTE ``departments`` on top of ``result``; the overall rate is rounded on the whole table."""
    part = lambda count, fraction: f"least(cast(round_even({count} * {fraction}, 0) as bigint), {count})"
    improved = part(part("w.neg", "a.reached"), "a.success")
    share = rate("r.n", "w.n")
    return scenario(assumptions, "department_name") + f""",
w as (select count(*) n, count(*) filter (sentiment = 'Negative') neg from clean),
overall as (select scenario, {rate(f'w.neg - {improved}', 'w.n')} as remaining from w, assumed a),
departments as (select r.scenario, seg as department, r.n as reviews, avg_rating as baseline_avg_rating, sim_avg_rating,
  baseline_positive_rate, sim_positive_rate, baseline_negative_rate, sim_negative_rate,
  baseline_recommendation_rate, sim_recommendation_rate, successful_neg as successful_negative_cases,
  sim_neg as remaining_negative_reviews,
  case when sim_negative_rate > remaining and {share} >= 5 then 'High'
       when sim_negative_rate > remaining or {share} >= 5 then 'Medium' else 'Low' end as priority,
  successfully_improved_reviews as improved_cases, {share} as share
  from result r join overall o on o.scenario = r.scenario, w where r.n >= {min_reviews})"""


add("scenario_department", "select * from departments", departments(SWEEP, MIN_DEPARTMENT))
add(
    "scenario_impact",
    "select *, successful_negative_cases as negative_reduction from departments",
    departments(DEFAULT_ONLY, 50),
)
add(
    "scenario_sentiment_comparison",
    " union all ".join(
        f"select '{label}' as sentiment, '{series}' as series, {prefix}{short} as reviews, "
        f"{rate(f'{prefix}{short}', 'n')} as share from result"
        for label, short in (("Negative", "neg"), ("Neutral", "neu"), ("Positive", "pos"))
        for series, prefix in (("Dataset Baseline", ""), ("Simulated Scenario", "sim_"))
    ),
    scenario(DEFAULT_ONLY, None),
)
KPI_CHANGES = [
    ("Average Rating", "rating", "avg_rating", "sim_avg_rating", 1, 1e-12),
    ("Positive Rate", "percent", "baseline_positive_rate", "sim_positive_rate", 1, 1e-12),
    ("Negative Rate", "percent", "baseline_negative_rate", "sim_negative_rate", -1, 1e-12),
    ("Recommendation Rate", "percent", "baseline_recommendation_rate", "sim_recommendation_rate", 1, 1e-12),
    ("Neutral Rate", "percent", "baseline_neutral_rate", "sim_neutral_rate", -1, 1e-9),
]
add(
    "scenario_kpi_change",
    " union all ".join(
        f"select '{label}' as metric, '{kind}' as kind, {before} as baseline, {after} as simulated, "
        f"{after} - {before} as change, case when abs({after} - {before}) < {tolerance} then 'unchanged' "
        f"when ({after} - {before}) * {sign} > 0 then 'improved' else 'deteriorated' end as direction from result"
        for label, kind, before, after, sign, tolerance in KPI_CHANGES
    ),
    scenario(DEFAULT_ONLY, None),
)
add(
    "scenario_movement",
    " union all ".join(
        f"select '{step}' as step, {column} as reviews, '{direction}' as direction from result"
        for step, column, direction in (
            ("Negative cases improved", "successful_neg", "outflow"),
            ("Negative to Neutral", "neg_to_neu", "shift"),
            ("Negative to Positive", "neg_to_pos", "shift"),
            ("Neutral to Positive", "neu_to_pos", "shift"),
        )
    ),
    scenario(DEFAULT_ONLY, None),
)


# Insights ----------------------------------------------------------------------------------
def fact(position, insight, source, segment, metric, value, tone="'neutral'", baseline="null", reviews="null") -> str:
    number = lambda v: f"cast({v} as double)"
    return (
        f"select * from (select cast({position} as int) as position, '{insight}' as insight, "
        f"cast({segment} as varchar) as segment, '{metric}' as metric, {number(value)} as value, "
        f"{number(baseline)} as baseline, {number(value)} - {number(baseline)} as delta, "
        f"cast({reviews} as bigint) as reviews, {tone} as tone from {source})"
    )


# When no segment has enough reviews.
NOTHING = fact(1, "Too few reviews", "(select count(*) n from s) where n = 0", "null", "reviews", "null")


def first(table: str, order: str) -> str:
    return f"(select * from {table} order by {order} limit 1) x, base"


add(
    "insights_empty",
    fact(1, "Too few reviews", "(select 1)", "null", "reviews", "null"),
)
add(
    "insights_executive",
    " union all ".join(
        [
            fact(1, "Largest department", first("s", "reviews desc, department_name"), "department_name",
                 "reviews", "reviews", reviews="reviews"),
            fact(2, "Best rated department", first("s", "avg_rating desc, department_name"), "department_name",
                 "avg_rating", "avg_rating", "'positive'", "average_rating", "reviews"),
            fact(3, "Most negative department", first("s", "negative_rate desc, department_name"),
                 "department_name", "negative_rate", "x.negative_rate", "'negative'", "base.negative_rate", "reviews"),
            fact(4, "Most recommended department", first("s", "recommendation_rate desc, department_name"),
                 "department_name", "recommendation_rate", "x.recommendation_rate", "'positive'",
                 "base.recommendation_rate", "reviews"),
            fact(5, "Text coverage", "base where (select count(*) from s) > 0", "null", "text_coverage_rate",
                 "text_coverage_rate", reviews="records_with_text"),
            NOTHING,
        ]
    ),
    f"{BASELINE}, s as (select * from {segments('department_name')} where reviews >= {MIN_DEPARTMENT})",
)
add(
    "insights_product",
    " union all ".join(
        [
            fact(1, "Largest class", first("s", "reviews desc, class_name"), "class_name", "reviews", "reviews",
                 reviews="reviews"),
            fact(2, "Lowest rated class", first("s", "avg_rating, class_name"), "class_name", "avg_rating",
                 "avg_rating", "'negative'", reviews="reviews"),
            fact(3, "Most negative class", first("s", "negative_rate desc, class_name"), "class_name",
                 "negative_rate", "x.negative_rate", "'negative'", "base.negative_rate", "reviews"),
            fact(4, "Most recommended class", first("s", "recommendation_rate desc, class_name"), "class_name",
                 "recommendation_rate", "x.recommendation_rate", "'positive'", reviews="reviews"),
            fact(5, "Classes that need attention",
                 "(select count(*) n, sum(negative_reviews) negatives from flagged), "
                 "(select string_agg(class_name || format(' ({:.1f}%)', negative_rate), ', ' "
                 "order by negative_rate desc, class_name) names "
                 "from (select * from flagged order by negative_rate desc, class_name limit 5)) where n > 0",
                 "names", "flagged_classes", "n", "'negative'", reviews="negatives"),
            NOTHING,
        ]
    ),
    f"""{BASELINE}, s as (select * from {segments('class_name')} where reviews >= {MIN_CLASS}),
    flagged as (select s.* from s, base where s.negative_rate - base.negative_rate >= 5)""",
)
add(
    "insights_customer",
    " union all ".join(
        [
            fact(1, "Age band that recommends most",
                 "(select * from s order by recommendation_rate desc, age_band limit 1) x, "
                 "(select min(recommendation_rate) low from s)",
                 "age_band", "recommendation_rate", "recommendation_rate", "'positive'", "low", "reviews"),
            fact(2, "Age band with the lowest rating", first("s", "avg_rating, age_band"), "age_band", "avg_rating",
                 "avg_rating", "'negative'", reviews="reviews"),
            fact(3, "Sentiment with most helpful votes", first("helpful", "total_helpful_votes desc, sentiment"),
                 "sentiment", "total_helpful_votes", "total_helpful_votes", reviews="reviews"),
            fact(4, "Most helpful negative review",
                 "(select * from clean where has_review_text and sentiment = 'Negative' order by "
                 "coalesce(positive_feedback_count, 0) desc, review_length_words desc, row_id limit 1)",
                 "class_name", "helpful_votes", "coalesce(positive_feedback_count, 0)", "'negative'", reviews="1"),
        ]
    ),
    f"{BASELINE}, {HELPFUL}, s as (select * from {segments('age_band')} where reviews >= 50)",
)


def change(position: int, kind: str, sign: str) -> str:
    before, after = f"baseline_{kind}_rate", f"sim_{kind}_rate"
    tone = f"case when {sign}({after} - {before}) > 0 then 'positive' else 'neutral' end"
    return fact(position, f"Change of the {kind} rate", "whole", "null", after, after, tone, before, "n")


SCENARIO_ALL = scenario(DEFAULT_ONLY, None)
add(
    "insights_scenario",
    " union all ".join(
        [
            change(1, "negative", "-"),
            change(2, "positive", "+"),
            change(3, "recommendation", "+"),
            fact(4, "Largest improvable volume",
                 "(select * from departments order by successful_negative_cases desc, department limit 1)",
                 "department", "successful_negative_cases", "successful_negative_cases", reviews="reviews"),
            fact(5, "Highest remaining risk",
                 "(select * from departments order by sim_negative_rate desc, remaining_negative_reviews desc, "
                 "department limit 1) x, whole",
                 "department", "sim_negative_rate", "x.sim_negative_rate", "'negative'", "whole.sim_negative_rate",
                 "remaining_negative_reviews"),
        ]
    ),
    departments(DEFAULT_ONLY, 0)
    + ",\nwhole as (with "
    + SCENARIO_ALL
    + " select * from result)",
)
