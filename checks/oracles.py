"""The SQL each registered query is checked against, for DuckDB."""

from __future__ import annotations

from catalith import fixed
from checks.items import items_sql

# Whitespace as the engine collapses it, spelled out: DuckDB's \s is ASCII-only.
_SPACE = (
    r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _collapsed(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_SPACE}+', ' ', 'g'))"


def _stripped(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _rint(x: str) -> str:
    x = f"({x})"
    return f"CASE WHEN abs({x} - trunc({x})) = 0.5 THEN 2 * round({x} / 2) ELSE round({x}) END"


def _number(x: str) -> str:
    shape = r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf(inity)?))\s*$"
    # What is too large for a double is infinite.
    read = f"coalesce(TRY_CAST(trim({x}) AS DOUBLE), CAST('inf' AS DOUBLE))"
    return f"CASE WHEN regexp_matches({x}, '{shape}') THEN {read} END"


_SENTINELS = ", ".join(quoted(s) for s in fixed.SENTINELS)
_RAW_TEXT = {
    "title": "Title",
    "major_genre": "Major_Genre",
    "mpaa_rating": "MPAA_Rating",
    "director": "Director",
    "distributor": "Distributor",
    "creative_type": "Creative_Type",
    "source": "Source",
}
_RAW_NUMBERS = {
    "imdb_rating": "IMDB_Rating",
    "rt_rating": "Rotten_Tomatoes_Rating",
    "imdb_votes": "IMDB_Votes",
    "production_budget": "Production_Budget",
    "us_gross": "US_Gross",
    "worldwide_gross": "Worldwide_Gross",
    "us_dvd_sales": "US_DVD_Sales",
    "running_time_min": "Running_Time_min",
}


def _standard(column: str, raw: str) -> str:
    text = f"CASE WHEN lower({_collapsed(raw)}) NOT IN ({_SENTINELS}) THEN {_collapsed(raw)} END"
    if column != "mpaa_rating":
        return text
    cases = " ".join(
        f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in fixed.RATING_ALIASES.items()
    )
    return f"CASE lower({_collapsed(raw)}) {cases} ELSE {text} END"


_STD = "SELECT row_pos, {}, Release_Date AS raw_date, {} FROM items".format(
    ", ".join(f"{_standard(c, r)} AS {c}" for c, r in _RAW_TEXT.items()),
    ", ".join(f"{r} AS raw_{c}" for c, r in _RAW_NUMBERS.items()),
)

_LAYOUTS = ("%b %d %Y", "%d-%b-%Y", "%Y%m%d", "%m/%d/%Y", "%Y")
_PARSED = "SELECT *, CAST(coalesce({}) AS DATE) AS parsed FROM std".format(
    ", ".join(f"try_strptime(raw_date, '{layout}')" for layout in _LAYOUTS)
)

_DATED = """SELECT * EXCLUDE (parsed), parsed,
  CASE WHEN year(parsed) > 2011 THEN CAST(parsed - INTERVAL 100 YEAR AS DATE)
       ELSE parsed END AS release_date,
  CASE WHEN year(parsed) > 2011 THEN year(parsed) - 100 ELSE year(parsed) END AS release_year
FROM parsed_dates"""

_CELLS = [*_RAW_TEXT, "release_date", *[f"raw_{c}" for c in _RAW_NUMBERS], "release_year"]
_MARKED = """SELECT *, lower({key}) AS title_key,
  title IS NOT NULL AND release_year IS NOT NULL AS has_key,
  {filled} AS filled, coalesce({votes}, -1) AS votes
FROM dated""".format(
    key=_collapsed("title"),
    filled=" + ".join(f"CAST({c} IS NOT NULL AS INT)" for c in _CELLS),
    votes=_number("raw_imdb_votes"),
)

_RANKED = """SELECT *, CASE WHEN has_key THEN row_number() OVER (
    PARTITION BY has_key, title_key, release_year ORDER BY filled DESC, votes DESC, row_pos)
  ELSE 1 END AS place FROM marked"""

_KEPT = "SELECT * FROM ranked WHERE place = 1"


def _valid(column: str, zero: bool = True) -> str:
    low, high = fixed.NUMERIC_BOUNDS[column]
    x = f"num_{column}"
    tests = [f"{x} >= {low}", f"abs({x}) < CAST('inf' AS DOUBLE)"]
    tests += [f"{x} <= {high}"] if high is not None else []
    if zero and column in fixed.ZERO_MEANS_MISSING:
        tests.append(f"{x} <> 0")
    return " AND ".join(tests)


_NUMBERS = "SELECT *, {} FROM kept".format(
    ", ".join(f"{_number('raw_' + c)} AS num_{c}" for c in _RAW_NUMBERS)
)
_CLEANED = "SELECT row_pos, {}, release_date, release_year, {} FROM numbers".format(
    ", ".join(_RAW_TEXT),
    ", ".join(f"CASE WHEN {_valid(c)} THEN num_{c} END AS {c}" for c in _RAW_NUMBERS),
)


def _group(column: str) -> str:
    key = fixed.MEDIAN_GROUPS[column]
    return "release_year // 10 * 10" if key == "decade" else key


_MEDIANS = "SELECT *, {} FROM cleaned".format(
    ", ".join(
        f"CASE WHEN {_group(c)} IS NOT NULL AND count({c}) OVER (PARTITION BY {_group(c)}) >= "
        f"{fixed.MIN_GROUP_SIZE} THEN median({c}) OVER (PARTITION BY {_group(c)}) END AS group_{c},"
        f" median({c}) OVER () AS global_{c}"
        for c in fixed.MEDIAN_GROUPS
    )
)


def _filled(column: str) -> str:
    x = f"coalesce({column}, group_{column}, global_{column})"
    if fixed.IMPUTED_DECIMALS[column]:
        return f"({_rint(x + ' * 10')}) / 10"
    return f"CAST({_rint(x)} AS BIGINT)"


_IMPUTED = "SELECT row_pos, title, major_genre, {}, release_date, release_year, {}, {} FROM medians"
_IMPUTED = _IMPUTED.format(
    ", ".join(f"coalesce({c}, 'Unknown') AS {c}" for c in fixed.UNKNOWN_COLUMNS),
    ", ".join(
        f"{_filled(c)} AS {c}, {c} IS NULL AS {c}_imputed" for c in fixed.MEDIAN_GROUPS
    ),
    ", ".join(
        f"CAST({_rint(c)} AS BIGINT) AS {c}" for c in ("imdb_votes", "us_gross", "worldwide_gross")
    ),
)


def _seen(column: str) -> str:
    if column in fixed.MEDIAN_GROUPS:
        return f"CASE WHEN NOT {column}_imputed THEN {column} END"
    if column in fixed.UNKNOWN_COLUMNS or column in ("title", "major_genre"):
        return f"CASE WHEN {column} <> 'Unknown' THEN {column} END"
    return column


_DERIVED = f"""SELECT *, release_year // 10 * 10 AS decade,
  CASE WHEN ({_seen('production_budget')}) < 15000000 THEN 'indie'
       WHEN ({_seen('production_budget')}) < 50000000 THEN 'mid'
       WHEN ({_seen('production_budget')}) < 100000000 THEN 'major'
       WHEN ({_seen('production_budget')}) IS NOT NULL THEN 'blockbuster' END AS budget_tier,
  ({_seen('imdb_rating')}) * 10 - ({_seen('rt_rating')}) AS rating_score_delta,
  worldwide_gross >= greatest(100000000,
    coalesce(2 * ({_seen('production_budget')}), 100000000)) AS blockbuster_flag
FROM imputed"""

_AUGMENTED = f"""SELECT *, concat_ws(chr(10),
  'Title: ' || ({_seen('title')}), 'Genre: ' || ({_seen('major_genre')}),
  'Director: ' || ({_seen('director')}), 'MPAA Rating: ' || ({_seen('mpaa_rating')}),
  'Release Year: ' || release_year,
  'Runtime: ' || ({_seen('running_time_min')}) || ' minutes',
  'IMDB Rating: ' || printf('%.1f', {_seen('imdb_rating')}) || '/10' ||
    coalesce(' (' || format('{{:,}}', imdb_votes) || ' votes)', ''),
  'Rotten Tomatoes: ' || ({_seen('rt_rating')}) || '%',
  'Budget: $' || format('{{:,}}', {_seen('production_budget')}),
  'Distributor: ' || ({_seen('distributor')}), 'Creative Type: ' || ({_seen('creative_type')}),
  'Source: ' || ({_seen('source')})) AS augmented_text
FROM derived"""


def _uuid(key: str) -> str:
    return (
        f"regexp_replace(md5({key}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', "
        r"'\1-\2-\3-\4-\5')"
    )


_CORPUS = f"""SELECT {_uuid("lower(title) || '#' || release_year")} AS id, a.*,
  CAST(embedding AS DOUBLE[]) AS v, embedding
FROM augmented a LEFT JOIN embeddings ON row_pos = vec_id
WHERE title IS NOT NULL AND release_year IS NOT NULL"""


def _dot(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b})"


def cosine(a: str, b: str) -> str:
    return f"{_dot(a, b)} / (sqrt({_dot(a, a)}) * sqrt({_dot(b, b)}))"


# Each step reads only the ones before it.
_STEPS = {
    "items": items_sql(),
    "std": _STD,
    "parsed_dates": _PARSED,
    "dated": _DATED,
    "marked": _MARKED,
    "ranked": _RANKED,
    "kept": _KEPT,
    "numbers": _NUMBERS,
    "cleaned": _CLEANED,
    "medians": _MEDIANS,
    "imputed": _IMPUTED,
    "derived": _DERIVED,
    "augmented": _AUGMENTED,
    "corpus": _CORPUS,
}


def after(step: str, select: str, **more: str) -> str:
    """The steps up to ``step``, then further named ones, then a select."""
    names = list(_STEPS)
    named = {n: _STEPS[n] for n in names[: names.index(step) + 1]} | more
    body = ",\n".join(f"{name} AS ({sql})" for name, sql in named.items())
    return f"WITH {body}\n{select}"


_RESULT = """{id} AS id, coalesce({t}title, '') AS title, {t}release_year, {t}major_genre,
  {t}mpaa_rating, {t}director, {t}distributor, {t}imdb_rating, {t}rt_rating,
  {similarity} AS similarity, '{kind}' AS match_type"""


def _result(similarity: str, kind: str, t: str = "") -> str:
    return _RESULT.format(id=f"{t}id", t=t, similarity=similarity, kind=kind)


_EMBEDDED = "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings"


def counters(stage: str, source: str, rows: list[tuple[str, str, str]]) -> str:
    """Long report rows, one select each."""
    return " UNION ALL ".join(
        f"SELECT {quoted(stage)} AS stage, {quoted(metric)} AS metric, {quoted(field)} AS field, "
        f"CAST({value} AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS note FROM {source}"
        for metric, field, value in rows
    )


def notes(stage: str, rows: list[tuple[str, str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT {quoted(stage)}, {quoted(metric)}, {quoted(field)}, CAST(NULL AS DOUBLE), "
        f"{quoted(note)}"
        for metric, field, note in rows
    )


def _count(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


def _cleaning_report() -> str:
    text = [
        row
        for c, raw in _RAW_TEXT.items()
        for row in (
            ("strings_normalized", c, _count(f"i.{raw} IS DISTINCT FROM s.{c}")),
            ("sentinels_nulled", c, _count(f"i.{raw} IS NOT NULL AND s.{c} IS NULL")),
        )
    ]
    text.append(
        ("titles_stringified", "", _count(r"regexp_matches(i.Title, '^-?[0-9]+(\.[0-9]+)?$')"))
    )
    dates = [
        ("dates_parsed", "", _count("parsed IS NOT NULL")),
        (
            "dates_by_fallback",
            "",
            _count("parsed IS NOT NULL AND try_strptime(raw_date, '%b %d %Y') IS NULL"),
        ),
        ("dates_unparseable", "", _count("trim(raw_date) <> '' AND parsed IS NULL")),
        ("dates_century_corrected", "", _count("year(parsed) > 2011")),
    ]
    numbers = [("rows_out", "", "count(*)")]
    for c in fixed.NUMERIC_BOUNDS:
        numbers.append(("numeric_coerced", c, _count(f"raw_{c} IS NOT NULL AND num_{c} IS NULL")))
        numbers.append(("numeric_out_of_range", c, _count(f"NOT ({_valid(c, zero=False)})")))
        if c in fixed.ZERO_MEANS_MISSING:
            numbers.append(("numeric_zero_as_missing", c, _count(f"num_{c} = 0")))
    renamed = [
        ("columns_renamed", raw, c)
        for c, raw in {**_RAW_TEXT, **_RAW_NUMBERS, "release_date": "Release_Date"}.items()
    ]
    return after(
        "numbers",
        " UNION ALL ".join(
            [
                counters("cleaning", "items", [("rows_in", "", "count(*)")]),
                counters("cleaning", "items i JOIN std s USING (row_pos)", text),
                counters("cleaning", "parsed_dates", dates),
                counters(
                    "cleaning",
                    "ranked",
                    [
                        ("duplicates_removed", "", _count("place > 1")),
                        ("rows_missing_dedup_key", "", _count("NOT has_key")),
                    ],
                ),
                counters("cleaning", "numbers", numbers),
                notes("cleaning", renamed),
            ]
        ),
    )


def _imputation_report() -> str:
    rows, said = [], []
    for c, group in fixed.MEDIAN_GROUPS.items():
        rows += [
            ("imputed_counts", c, _count(f"{c} IS NULL")),
            ("group_median_fills", c, _count(f"{c} IS NULL AND group_{c} IS NOT NULL")),
            ("global_median_fills", c, _count(f"{c} IS NULL AND group_{c} IS NULL")),
            (
                "global_medians",
                c,
                f"CASE WHEN {_count(f'{c} IS NULL AND group_{c} IS NULL')} > 0 "
                f"THEN any_value(global_{c}) END",
            ),
        ]
        said.append(
            (
                "strategy_by_field",
                c,
                f"median of its {group} where that has 10 values, else of all rows; "
                f"marked by {c}_imputed",
            )
        )
    for c in fixed.UNKNOWN_COLUMNS:
        rows.append(("imputed_counts", c, _count(f"{c} IS NULL")))
        said.append(("strategy_by_field", c, "filled with Unknown"))
    rows.append(("imputed_counts", "major_genre", "0 * count(*)"))
    said.append(
        (
            "strategy_by_field",
            "major_genre",
            "stays NULL: searches list and filter by it",
        )
    )
    return after(
        "medians",
        counters("imputation", "medians", rows) + " UNION ALL " + notes("imputation", said),
    )


def _augmentation_report() -> str:
    rows = [("feature_coverage", c, f"count({c})") for c in fixed.DERIVED_FEATURES]
    rows += [
        ("budget_tier_counts", t, _count(f"budget_tier = '{t}'"))
        for t in ("indie", "mid", "major", "blockbuster")
    ]
    rows += [
        ("augmented_text_rows", "", _count("augmented_text <> ''")),
        ("augmented_text_empty", "", _count("augmented_text = ''")),
        (
            "mean_text_lines",
            "",
            "round(avg(CASE WHEN augmented_text = '' THEN 0 "
            "ELSE len(string_split(augmented_text, chr(10))) END), 2)",
        ),
    ]
    return after("augmented", counters("augmentation", "augmented", rows))


# The second batch of the load queries: every item again, under another spelling,
# some a year later and thus new, with another director.
_SECOND = """SELECT * REPLACE (upper(title) AS title, director || ' II' AS director,
  release_year + CASE WHEN row_pos % 5 = 0 THEN 1 ELSE 0 END AS release_year) FROM corpus"""
_LOADED = (
    """SELECT * FROM (SELECT *, row_number() OVER (
  PARTITION BY lower(title), release_year ORDER BY row_pos DESC) AS place FROM {source}
  WHERE embedding IS NOT NULL) WHERE place = 1"""
)
_STORED = f"""SELECT coalesce(o.title, n.title) AS title,
  coalesce(o.release_year, n.release_year) AS release_year,
  {_uuid("lower(coalesce(o.title, n.title)) || '#' || coalesce(o.release_year, n.release_year)")}
    AS id,
  CASE WHEN n.row_pos IS NOT NULL THEN n.director ELSE o.director END AS director,
  CASE WHEN n.row_pos IS NOT NULL THEN n.rt_rating ELSE o.rt_rating END AS rt_rating,
  CASE WHEN n.row_pos IS NOT NULL THEN n.augmented_text ELSE o.augmented_text END
    AS augmented_text,
  CASE WHEN n.row_pos IS NOT NULL THEN '0.2.0' ELSE '0.1.0' END AS pipeline_version,
  o.row_pos IS NOT NULL AS created_first,
  n.row_pos IS NOT NULL AS updated_second
FROM first_batch o FULL OUTER JOIN second_batch n
  ON lower(o.title) = lower(n.title) AND o.release_year = n.release_year"""


def _loaded(select: str) -> str:
    return after(
        "corpus",
        select,
        second=_SECOND,
        first_batch=_LOADED.format(source="corpus"),
        second_batch=_LOADED.format(source="second"),
        stored=_STORED,
    )


# Sentences over ``part``; the same text rules build them on both sides.
SENTENCE_RULE = (
    "CASE p_partkey % 13 WHEN 0 THEN 'action movies from the 90s with high IMDB ratings about ' "
    "WHEN 1 THEN 'critically acclaimed drama films on ' "
    "WHEN 2 THEN 'animated family movies of the ' WHEN 3 THEN 'a Romantic  Comedies night: ' "
    "WHEN 4 THEN 'dark psychological thrillers, unrated, ' "
    "WHEN 5 THEN 'PG-13 comedies from the 1980s with ' WHEN 6 THEN 'highly rated westerns: ' "
    "WHEN 7 THEN 'nc-17 horror of the seventies ' WHEN 8 THEN 'concert / performance 05s ' "
    "WHEN 9 THEN 'r rated adventures 85s ' WHEN 10 THEN 'not  rated documentary 2010s ' "
    "WHEN 11 THEN 'reactions to musicals of the sixties ' ELSE 'g-rated suspense, rating R ' END "
    "|| p_name || ' ' || p_type"
)
TITLE_RULE = (
    "CASE p_partkey % 4 WHEN 0 THEN upper(p_name) "
    "WHEN 1 THEN substr(p_name, 1, 1) || substr(p_name, 3) "
    "WHEN 2 THEN p_name || ' ' || p_brand ELSE reverse(p_name) END"
)


# Distinct titles over ``customer``, and the same with a letter left out or none that match.
NAME_RULE = "c_mktsegment || ' ' || reverse(CAST(c_custkey * 7919 + 10007 AS STRING)) || ' ' || c_name"
ASKED_NAME_RULE = (
    "CASE c_custkey % 3 WHEN 0 THEN lower(c_mktsegment) || ' ' || "
    "reverse(CAST(c_custkey * 7919 + 10007 AS STRING)) || ' ' || substr(c_name, 2) "
    "WHEN 1 THEN upper(c_mktsegment || ' ' || reverse(CAST(c_custkey * 7919 + 10007 AS STRING)) "
    "|| ' ' || c_name) ELSE 'zz' || CAST(c_custkey * 31 AS STRING) || 'qq' END"
)


def _sentence_filters(source: str) -> str:
    s = "query"

    def says(pattern: str) -> str:
        return f"regexp_matches({s}, {quoted(pattern)}, 'i')"

    def first(pairs) -> str:
        return "CASE " + " ".join(f"WHEN {says(p)} THEN {v}" for p, v in pairs) + " END"

    genre = first([(rf"\b{p}\b", quoted(g)) for p, g in fixed.GENRE_PHRASES])
    label = first([(p, quoted(v)) for p, v in fixed.RATING_PHRASES])
    named = first([(rf"\b{n}\b", d) for n, d in fixed.DECADE_NAMES])
    four = f"TRY_CAST(regexp_extract({s}, {quoted(fixed.DECADE_FOUR_DIGITS)}, 1, 'i') AS INT)"
    two = f"TRY_CAST(regexp_extract({s}, {quoted(fixed.DECADE_TWO_DIGITS)}, 1, 'i') AS INT)"
    short = f"CASE WHEN {two} >= 20 THEN 1900 + {two} ELSE 2000 + {two} END"
    return f"""SELECT query_id, query, {genre} AS genre_filter,
  coalesce({four}, {named}, {short}) AS decade,
  CASE WHEN {says(fixed.HIGH_RATING_PHRASE)} THEN CAST(7.5 AS DOUBLE) END AS min_imdb_rating,
  {label} AS mpaa_rating FROM {source}"""


_GRAMS = (
    "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), "
    "'[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), "
    "lambda i: substr('  ' || w || ' ', i, 3)))))"
)


def _similar_text(a: str, b: str) -> str:
    shared = f"len(list_intersect({a}, {b}))"
    return f"{shared} / CAST(len({a}) + len({b}) - {shared} AS DOUBLE)"


def _hashed(ident: str, text: str, source: str, dim: int) -> str:
    """Place and sign of every word of every text."""
    words = (
        f"SELECT {ident}, unnest(list_filter(regexp_split_to_array({text}, '{_SPACE}+'), "
        f"lambda w: w <> '')) AS word FROM {source}"
    )
    return (
        f"SELECT {ident}, ('0x' || substr(md5(word), 1, 8))::BIGINT % {dim} AS place, "
        "CASE WHEN ('0x' || substr(md5(word), 9, 2))::BIGINT % 2 = 1 THEN 1 ELSE -1 END AS sign "
        f"FROM ({words})"
    )


def _vectors(source: str, ident: str, text: str, dim: int) -> str:
    """Dense vectors of hashed words, as the stand-in model counts them."""
    words = _hashed(ident, text, source, dim)
    return f"""SELECT {ident}, list(coalesce(total, 0) ORDER BY place) AS v FROM
  (SELECT {ident}, place FROM {source}, (SELECT unnest(range({dim})) AS place))
  LEFT JOIN (SELECT {ident}, place, CAST(sum(sign) AS DOUBLE) AS total FROM ({words})
    GROUP BY ALL) USING ({ident}, place) GROUP BY {ident}"""


def _prefixed(x: str, prefix: str) -> str:
    body = _stripped(x)
    return (
        f"CASE WHEN starts_with({body}, '{prefix}') THEN {body} ELSE '{prefix}' || {body} END"
    )


# Requests of the batch search, one per embedding.
BATCH_RULE = {
    "genre_filter": "CASE label WHEN 0 THEN 'SMALL' WHEN 1 THEN 'LARGE' END",
    "decade": "CASE label WHEN 2 THEN 1990 WHEN 3 THEN 1980 END",
    "min_imdb_rating": "CASE label WHEN 1 THEN 4.0 WHEN 4 THEN 6.5 END",
    "mpaa_rating": "CASE label WHEN 5 THEN 'R' WHEN 6 THEN 'PG-13' END",
    "top_k": "label * 9 - 5",
}


_LOG = """SELECT event_id AS request_id, ts, user_id, event_type AS tool, value / 1000 AS seconds,
  event_type = 'error' AS failed FROM events"""
_BUCKETS = ", ".join(
    f"count(*) FILTER (WHERE seconds <= {b}) AS le{i}" for i, b in enumerate(fixed.LATENCY_BOUNDS)
)


def _bucket_quantile(p: float) -> str:
    cases, low, below = [], 0.0, "0"
    for i, bound in enumerate(fixed.LATENCY_BOUNDS):
        cases.append(
            f"WHEN le{i} >= n * {p}::DOUBLE THEN {low}::DOUBLE + ({bound}::DOUBLE - {low}::DOUBLE)"
            f" * ((n * {p}::DOUBLE - {below}) / (le{i} - {below}))"
        )
        low, below = bound, f"le{i}"
    return f"CASE {' '.join(cases)} ELSE {low} END"


def _slid(window: int, slide: int) -> str:
    """Requests with the start of every sliding window (in minutes) they are in."""
    return f"""SELECT log.*, time_bucket(INTERVAL {slide} MINUTE, ts)
    - INTERVAL {slide} MINUTE * step AS window_start
  FROM log, (SELECT unnest(range({window // slide})) AS step)"""


def _windowed(select: str, minutes: int = 5, slide: int = 1, closed: bool = False) -> str:
    late = (
        f"WHERE window_start + INTERVAL {minutes} MINUTE <= "
        "(SELECT max(ts) FROM log) - INTERVAL 10 MINUTE"
        if closed
        else ""
    )
    return (
        f"WITH log AS ({_LOG}), slid AS ({_slid(minutes, slide)}) "
        f"SELECT * FROM ({select}) {late}"
    )


_RATE = """SELECT window_start, count(*) AS requests, round(count(*) / 300.0, 6) AS per_second
FROM slid GROUP BY window_start"""
_ERRORS = """SELECT window_start, count(*) AS requests, count(*) FILTER (WHERE failed) AS errors,
  round(count(*) FILTER (WHERE failed) / 300.0, 6) AS errors_per_second
FROM slid GROUP BY window_start"""


def _quantile_windows(by: str, ps: tuple[float, ...]) -> str:
    shown = ", ".join(f"round({_bucket_quantile(p)}, 9) AS p{p * 100:g}" for p in ps)
    return f"""SELECT window_start, {by} n AS requests, {shown} FROM (
  SELECT window_start, {by} count(*) AS n, {_BUCKETS} FROM slid GROUP BY ALL)"""


_QUOTA = """SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS requests,
  count(*) - 4 AS rejected FROM log GROUP BY ALL HAVING count(*) > 4"""


_ALERTS = f"""WITH log AS ({_LOG}), periods AS (
  SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, count(*) AS n,
    count(*) FILTER (WHERE failed) AS errors, {_BUCKETS} FROM log GROUP BY 1),
measured AS (SELECT *, {_bucket_quantile(0.95)} AS p95 FROM periods),
breaches AS (SELECT 'p95_latency' AS alarm, w FROM measured WHERE p95 > 0.2 UNION ALL
  SELECT 'backend_errors', w FROM measured WHERE errors > 4 UNION ALL
  SELECT 'balancer_errors', w FROM measured WHERE errors > 2)
SELECT alarm, w + INTERVAL 1 HOUR * step AS period_start, count(*) AS breaches
FROM breaches, (SELECT unnest(range(5)) AS step) GROUP BY ALL HAVING count(*) >= 3"""

_CHANGES = f"""WITH alerts AS ({_ALERTS}), beside AS (
  SELECT *, lag(period_start) OVER w AS earlier, lead(period_start) OVER w AS later
  FROM alerts WINDOW w AS (PARTITION BY alarm ORDER BY period_start))
SELECT alarm, period_start AS at, 'on' AS state FROM beside
WHERE earlier IS NULL OR earlier < period_start - INTERVAL 1 HOUR UNION ALL
SELECT alarm, period_start + INTERVAL 1 HOUR, 'off' FROM beside
WHERE later IS NULL OR later > period_start + INTERVAL 1 HOUR"""

_REJECTIONS = f"""WITH log AS ({_LOG}) SELECT request_id, user_id, ts, window_start
FROM (SELECT *, time_bucket(INTERVAL 1 DAY, ts) AS window_start, row_number() OVER (
  PARTITION BY user_id, time_bucket(INTERVAL 1 DAY, ts) ORDER BY ts, request_id) AS place
  FROM log) WHERE place > 4"""

_CLOSED = f"(SELECT max(ts) FROM ({_LOG})) - INTERVAL 10 MINUTE"


def oracle_sql() -> dict[str, str]:
    numbers = ", ".join(f"{c}" for c in _RAW_NUMBERS)
    text = ", ".join(_RAW_TEXT)
    flags = ", ".join(f"{c}_imputed" for c in fixed.MEDIAN_GROUPS)
    flat = "SELECT row_pos, {} FROM (SELECT *, {} FROM std)".format(
        ", ".join(f"CASE WHEN {_valid(c)} THEN num_{c} END AS {c}" for c in _RAW_NUMBERS),
        ", ".join(f"{_number('raw_' + c)} AS num_{c}" for c in _RAW_NUMBERS),
    )
    grams_of_titles = f"SELECT *, {_GRAMS.format('title')} AS grams FROM corpus"
    best_title = _similar_text("c.grams", "q.grams")
    sentences = f"SELECT p_partkey AS query_id, {SENTENCE_RULE} AS query FROM part"
    resolved = _sentence_filters("sentences")
    requests = "SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv, {} FROM embeddings"
    requests = requests.format(", ".join(f"{sql} AS q_{name}" for name, sql in BATCH_RULE.items()))
    batch = f"""SELECT query_id, rank, {_result('round(similarity, 6)', 'semantic')}
FROM (SELECT q.query_id, q.q_top_k, c.*, {cosine('c.v', 'q.qv')} AS similarity,
    row_number() OVER (PARTITION BY q.query_id ORDER BY similarity DESC, c.id) AS rank
  FROM requests q JOIN corpus c ON c.v IS NOT NULL
    AND (q_genre_filter IS NULL OR c.major_genre = q_genre_filter)
    AND (q_decade IS NULL OR c.decade = q_decade)
    AND (q_min_imdb_rating IS NULL OR c.imdb_rating >= q_min_imdb_rating)
    AND (q_mpaa_rating IS NULL OR c.mpaa_rating = q_mpaa_rating))
WHERE rank <= greatest(1, least(q_top_k, 50))"""
    neighbours = f"""SELECT id, rank, neighbour_id, round(similarity, 6) AS similarity FROM (
  SELECT a.id, b.id AS neighbour_id, {cosine('a.v', 'b.v')} AS similarity,
    row_number() OVER (PARTITION BY a.id ORDER BY similarity DESC, b.id) AS rank
  FROM e a JOIN e b ON a.id <> b.id) WHERE rank <= 10"""
    sql = {
        "clean_strings": after("std", f"SELECT row_pos, {text} FROM std"),
        "clean_dates": after(
            "dated",
            "SELECT row_pos, CAST(release_date AS VARCHAR) AS release_date, release_year "
            "FROM dated",
        ),
        "clean_numerics": after("std", flat),
        "cleaning_report": _cleaning_report(),
        "century_examples": after(
            "dated",
            "SELECT coalesce(title, '') AS title, raw_date AS raw, "
            "CAST(year(parsed) AS VARCHAR) AS from_year, "
            "CAST(year(parsed) - 100 AS VARCHAR) AS to_year FROM dated "
            "WHERE year(parsed) > 2011 ORDER BY row_pos LIMIT 10",
        ),
        "dedup_items": after(
            "cleaned",
            f"SELECT row_pos, {text}, CAST(release_date AS VARCHAR) AS release_date, "
            f"release_year, {numbers} FROM cleaned",
        ),
        "dedup_examples": after(
            "ranked",
            "SELECT title, CAST(release_year AS VARCHAR) AS release_year FROM ranked "
            "WHERE place > 1 ORDER BY filled DESC, votes DESC, row_pos LIMIT 10",
        ),
        "dedup_documents": f"""SELECT doc_id, lang, source, n_chars FROM (SELECT *, row_number()
    OVER (PARTITION BY lower({_collapsed('text')}) ORDER BY doc_id) AS place FROM documents)
  WHERE place = 1 OR trim({_collapsed('text')}) = ''""",
        "impute_numeric": after(
            "imputed",
            f"SELECT row_pos, {', '.join(fixed.MEDIAN_GROUPS)}, {flags} FROM imputed",
        ),
        "impute_categorical": after(
            "imputed",
            f"SELECT row_pos, major_genre, {', '.join(fixed.UNKNOWN_COLUMNS)} FROM imputed",
        ),
        "group_medians": after(
            "medians",
            " UNION ALL ".join(
                [
                    f"SELECT '{c}' AS \"column\", '{g}' AS scope, CAST({_group(c)} AS VARCHAR) "
                    f"AS key, round(median({c}), 6) AS median, count({c}) AS n FROM cleaned "
                    f"WHERE {_group(c)} IS NOT NULL GROUP BY {_group(c)} HAVING count({c}) > 0"
                    for c, g in fixed.MEDIAN_GROUPS.items()
                ]
                + [
                    f"SELECT '{c}', 'everything', 'everything', round(median({c}), 6), count({c}) "
                    "FROM cleaned"
                    for c in fixed.MEDIAN_GROUPS
                ]
                + ["SELECT '*', 'everything', 'everything', 0.0, count(*) FROM cleaned"]
            ),
        ),
        "imputation_report": _imputation_report(),
        "derived_features": after(
            "derived",
            "SELECT row_pos, decade, budget_tier, round(rating_score_delta, 6) "
            "AS rating_score_delta, blockbuster_flag FROM derived",
        ),
        "render_text": after("augmented", "SELECT row_pos, augmented_text FROM augmented"),
        "augmentation_report": _augmentation_report(),
        "value_counts": after(
            "augmented",
            "SELECT budget_tier AS value, count(*) AS n FROM augmented "
            "WHERE budget_tier IS NOT NULL GROUP BY budget_tier",
        ),
        "prefix_texts": "SELECT doc_id, md5({}) AS digest, length({}) AS chars FROM documents".format(
            _prefixed("text", fixed.DOCUMENT_PREFIX), _prefixed("text", fixed.DOCUMENT_PREFIX)
        ),
        "embed_documents": f"""WITH asked AS (SELECT doc_id,
    {_prefixed('text', fixed.DOCUMENT_PREFIX)} AS body FROM documents),
  words AS ({_hashed('doc_id', 'body', 'asked', 64)}),
  cells AS (SELECT doc_id, place, sum(sign) AS total FROM words GROUP BY ALL)
SELECT doc_id, 64 AS dim, CAST(sum(total) AS DOUBLE) AS total,
  CAST(sum(total * (place + 1)) AS DOUBLE) AS weighted,
  CAST(sum(total * total) AS DOUBLE) AS squares FROM cells GROUP BY doc_id""",
        "embed_incremental": f"""WITH asked AS (SELECT doc_id,
    {_prefixed('text', fixed.DOCUMENT_PREFIX)} AS body FROM documents),
  words AS ({_hashed('doc_id', 'body', 'asked', 64)}),
  cells AS (SELECT doc_id, place, sum(sign) AS total FROM words GROUP BY ALL),
  early AS (SELECT DISTINCT text FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL)
SELECT doc_id, 64 AS dim, CAST(sum(total * (place + 1)) AS DOUBLE) AS weighted,
  (SELECT count(*) FROM early) AS asked_first,
  (SELECT count(DISTINCT text) FROM documents) - (SELECT count(*) FROM early) AS asked_second
FROM cells GROUP BY doc_id""",
        "upsert_items": _loaded(
            "SELECT id, title, release_year, director, rt_rating, augmented_text, "
            "pipeline_version, created_first, updated_second FROM stored"
        ),
        "stream_upsert": _loaded(
            "SELECT id, title, release_year, director, rt_rating, augmented_text FROM stored"
        ),
        "load_report": _loaded(
            counters(
                "load",
                "second",
                [
                    ("rows_in", "", "count(*)"),
                    ("rows_written", "", _count("embedding IS NOT NULL")),
                    ("rows_skipped_no_key", "", "0 * count(*)"),
                    ("rows_skipped_no_embedding", "", _count("embedding IS NULL")),
                ],
            )
            + " UNION ALL "
            + notes("load", [("pipeline_version", "", "0.2.0")])
            + " UNION ALL "
            + counters("load", "stored", [("table_total_after", "", "count(*)")])
        ),
        "skipped_examples": after(
            "augmented",
            "SELECT coalesce(title, '') AS title, coalesce(CAST(release_year AS VARCHAR), '') "
            "AS release_year, 'no natural key (title/release_year)' AS reason FROM augmented "
            "WHERE title IS NULL OR release_year IS NULL ORDER BY row_pos LIMIT 10",
        ),
        "load_audit": _loaded(
            "SELECT count(*) AS rows, count(*) AS embedded, 64 AS dim, true AS ok FROM stored"
        ),
        "dimension_counts": "SELECT len(embedding) AS dim, count(*) AS n FROM embeddings "
        "GROUP BY 1",
        "repeated_keys": _loaded(
            "SELECT lower(title) AS title_key, release_year, count(*) AS n FROM stored "
            "GROUP BY ALL HAVING count(*) > 1"
        ),
        "repeated_offers": after(
            "corpus",
            "SELECT lower(title) AS title_key, release_year, count(*) AS n FROM (SELECT title, release_year "
            "FROM corpus UNION ALL SELECT title, release_year FROM second) "
            "WHERE title IS NOT NULL AND release_year IS NOT NULL GROUP BY ALL HAVING count(*) > 1",
            second=_SECOND,
        ),
        "load_changes": after(
            "corpus",
            "SELECT 'added' AS side, count(*) AS n FROM second_batch HAVING count(*) > 0 UNION ALL "
            "SELECT 'removed', count(*) FROM second_batch n JOIN first_batch o "
            "ON lower(o.title) = lower(n.title) AND o.release_year = n.release_year HAVING count(*) > 0",
            second=_SECOND,
            first_batch=_LOADED.format(source="corpus"),
            second_batch=_LOADED.format(source="(SELECT * FROM second WHERE row_pos % 40 = 0)"),
        ),
        "rerun_changes": "SELECT 'none' AS side, 0 AS n WHERE false",
        "hybrid_search": after(
            "corpus",
            f"""SELECT {_result('round(score, 6)', 'semantic')} FROM (
  SELECT c.*, {cosine('c.v', 'q.qv')} AS score FROM corpus c,
    (SELECT CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id = 7) q
  WHERE v IS NOT NULL AND decade = 1990 AND imdb_rating >= 3.5 AND mpaa_rating = 'PG-13')
ORDER BY score DESC, id LIMIT 10""",
        ),
        "hybrid_search_batch": after("corpus", batch, requests=requests),
        "hybrid_search_grid": after("corpus", batch, requests=requests),
        "similar_items": after(
            "corpus",
            f"""SELECT {_result('round(score, 6)', 'semantic')} FROM (
  SELECT c.*, {cosine('c.v', 's.v')} AS score FROM corpus c JOIN corpus s
    ON s.title = 'blue bolt' AND s.release_year = 1982 AND c.id <> s.id
  WHERE c.v IS NOT NULL AND s.v IS NOT NULL) ORDER BY score DESC, id LIMIT 5""",
        ),
        "knn_all": f"WITH e AS ({_EMBEDDED}) {neighbours}",
        "knn_index": f"""WITH e AS ({_EMBEDDED})
SELECT b.id, b.label, round({cosine('a.v', 'b.v')}, 6) AS similarity
FROM e a JOIN e b ON a.id = 11 ORDER BY {cosine('a.v', 'b.v')} DESC, b.id LIMIT 10""",
        "lookup_by_id": after(
            "corpus",
            f"SELECT {_result('CAST(NULL AS DOUBLE)', 'lookup')} FROM corpus "
            "WHERE title = 'blue bolt' AND release_year = 1982",
        ),
        "lookup_many": after(
            "corpus",
            f"""SELECT a.row_pos AS request_id, {_result('CAST(NULL AS DOUBLE)', 'lookup', 'c.')}
FROM corpus a JOIN corpus c USING (id) WHERE a.row_pos % 3 <> 2""",
        ),
        "reject_bad_requests": """SELECT * FROM (SELECT event_id AS query_id,
    CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS query,
    user_id - 5 AS top_k, round(value / 10, 3) AS min_imdb_rating, 1870 + user_id AS decade,
    CASE WHEN event_type = 'error' THEN 'query must not be empty'
      WHEN round(value / 10, 3) NOT BETWEEN 0 AND 10 THEN
        'min_imdb_rating must be between 0 and 10'
      WHEN 1870 + user_id NOT BETWEEN 1880 AND 2100 THEN 'decade must be between 1880 and 2100'
    END AS reason FROM events) WHERE reason IS NOT NULL""",
        "title_exact": after(
            "corpus",
            f"SELECT {_result('CAST(1.0 AS DOUBLE)', 'exact')} FROM corpus WHERE lower(title) = 'hot gear' "
            "ORDER BY release_year, id LIMIT 1",
        ),
        "title_fuzzy": after(
            "corpus",
            f"""SELECT {_result('round(score, 6)', 'fuzzy')} FROM (
  SELECT c.*, {best_title} AS score FROM g c,
    (SELECT {_GRAMS.format("'smal gizmos'")} AS grams) q)
WHERE score >= 0.3 ORDER BY score DESC, release_year, id LIMIT 1""",
            g=grams_of_titles,
        ),
        "title_lookup": after(
            "corpus",
            f"""SELECT {_result('round(score, 6)', 'fuzzy')} FROM (
  SELECT c.*, {best_title} AS score FROM g c,
    (SELECT {_GRAMS.format("'hott gear'")} AS grams) q)
WHERE score >= 0.3 ORDER BY score DESC, release_year, id LIMIT 1""",
            g=grams_of_titles,
        ),
        "title_match_batch": after(
            "corpus",
            f"""SELECT a.query_id, coalesce(e.id, f.id) AS id,
  coalesce(e.title, f.title) AS title, coalesce(e.release_year, f.release_year) AS release_year,
  CASE WHEN e.id IS NULL THEN round(f.score, 6) ELSE 1.0 END AS similarity,
  CASE WHEN e.id IS NULL THEN 'fuzzy' ELSE 'exact' END AS match_type
FROM asked a LEFT JOIN exact e ON e.wanted = lower(a.title)
  LEFT JOIN fuzzy f ON f.wanted = lower(a.title)
WHERE e.id IS NOT NULL OR f.id IS NOT NULL""",
            asked=f"SELECT p_partkey AS query_id, {TITLE_RULE} AS title FROM part",
            firsts="""SELECT * FROM (SELECT id, title, release_year, lower(title) AS wanted,
  row_number() OVER (PARTITION BY lower(title) ORDER BY release_year, id) AS place FROM corpus)
  WHERE place = 1""",
            exact="SELECT * FROM firsts",
            g=f"SELECT *, {_GRAMS.format('wanted')} AS grams FROM firsts",
            q=f"""SELECT wanted, {_GRAMS.format('wanted')} AS grams FROM
  (SELECT DISTINCT lower(title) AS wanted FROM asked)""",
            fuzzy=f"""SELECT * FROM (SELECT q.wanted, c.id, c.title, c.release_year,
  {best_title} AS score, row_number() OVER (PARTITION BY q.wanted
    ORDER BY {best_title} DESC, c.release_year, c.id) AS place
  FROM q, g c WHERE {best_title} >= 0.3) WHERE place = 1""",
        ),
        "title_match_names": f"""WITH names AS (SELECT CAST(c_custkey AS VARCHAR) AS id, {NAME_RULE} AS title,
  c_nationkey AS release_year FROM customer),
asked AS (SELECT c_custkey AS query_id, {ASKED_NAME_RULE} AS title FROM customer),
g AS (SELECT *, {_GRAMS.format('lower(title)')} AS grams FROM names),
q AS (SELECT a.*, {_GRAMS.format('lower(title)')} AS grams FROM asked a
  WHERE lower(title) NOT IN (SELECT lower(title) FROM names)),
held AS (SELECT id, unnest(grams) AS gram FROM g), wanted AS (SELECT query_id, unnest(grams) AS gram FROM q),
shared AS (SELECT query_id, id, count(*) AS n FROM wanted JOIN held USING (gram) GROUP BY ALL),
scored AS (SELECT query_id, g.id, g.title, g.release_year,
  n / (len(q.grams) + len(g.grams) - n) AS score
  FROM shared JOIN q USING (query_id) JOIN g ON g.id = shared.id),
best AS (SELECT * FROM scored WHERE score >= 0.3 QUALIFY row_number() OVER (
  PARTITION BY query_id ORDER BY score DESC, release_year, id) = 1)
SELECT query_id, id, title, round(score, 6) AS similarity, 'fuzzy' AS match_type FROM best
UNION ALL SELECT query_id, id, n.title, 1.0, 'exact' FROM asked a JOIN names n ON lower(a.title) = lower(n.title)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY release_year, id) = 1""",
        "given_filters": f"""WITH sentences AS ({sentences}), said AS ({resolved})
SELECT query_id, query, CASE WHEN query_id % 3 = 0 THEN 'Given' ELSE genre_filter END AS genre_filter,
  CASE WHEN query_id % 4 = 0 THEN 1930 ELSE decade END AS decade,
  CASE WHEN query_id % 5 = 0 THEN 1.5 ELSE min_imdb_rating END AS min_imdb_rating, mpaa_rating FROM said""",
        "two_writers": after(
            "corpus",
            "SELECT id, title, release_year, director FROM batch",
            batch=_LOADED.format(source="corpus"),
        ),
        "load_vectors": after(
            "corpus",
            "SELECT id, title, round(list_sum(list_transform(v, lambda x: x)), 4) AS total FROM batch",
            batch=_LOADED.format(source="corpus"),
        ),
        "stored_lookups": after(
            "corpus",
            "SELECT 'id' AS kind, id, title FROM batch WHERE title = 'blue bolt' AND release_year = 1982 "
            "UNION ALL SELECT 'title', id, title FROM batch WHERE lower(title) = 'hot gear'",
            batch=_LOADED.format(source="corpus"),
        ),
        "raw_files": after("std", "SELECT row_pos AS key, title, true AS ordered FROM std"),
        "embedded_rows": after(
            "corpus",
            "SELECT major_genre, count(embedding) AS embedded, "
            "sum(count(embedding)) OVER ()::BIGINT AS in_all FROM corpus GROUP BY major_genre",
        ),
        "similar_many": f"""WITH e AS ({_EMBEDDED})
SELECT id, rank, neighbour_id, round(similarity, 6) AS similarity FROM (
  SELECT a.id, b.id AS neighbour_id, {cosine('a.v', 'b.v')} AS similarity,
    row_number() OVER (PARTITION BY a.id ORDER BY similarity DESC, b.id) AS rank
  FROM e a JOIN e b ON a.id <> b.id WHERE a.id IN (SELECT o_orderkey FROM orders)) WHERE rank <= 5""",
        "extract_filters": f"WITH sentences AS ({sentences}) {resolved}",
        "nl_search": after(
            "corpus",
            f"""SELECT query_id, rank, {_result('round(similarity, 6)', 'semantic')} FROM (
  SELECT q.query_id, c.*, {cosine('c.cv', 'q.v')} AS similarity, row_number() OVER (
    PARTITION BY q.query_id ORDER BY round({cosine('c.cv', 'q.v')}, 12) DESC, c.id) AS rank
  FROM (SELECT * FROM resolved JOIN asked_vectors USING (query_id)) q
  JOIN (SELECT corpus.*, t.v AS cv FROM corpus JOIN text_vectors t USING (id)) c
  ON (q.decade IS NULL OR c.decade = q.decade)
    AND (q.min_imdb_rating IS NULL OR c.imdb_rating >= q.min_imdb_rating)
    AND (q.mpaa_rating IS NULL OR c.mpaa_rating = q.mpaa_rating)
    AND (q.genre_filter IS NULL OR c.major_genre = q.genre_filter))
WHERE rank <= 10""",
            sentences=sentences,
            resolved=resolved,
            texts=f"SELECT id, {_prefixed('augmented_text', fixed.DOCUMENT_PREFIX)} AS body "
            "FROM corpus",
            text_vectors=_vectors("texts", "id", "body", 64),
            asked_texts=f"SELECT query_id, {_prefixed('query', fixed.QUERY_PREFIX)} AS body "
            "FROM sentences",
            asked_vectors=_vectors("asked_texts", "query_id", "body", 64),
        ),
        "dataset_stats": after(
            "augmented",
            "SELECT count(*) AS total_movies, count(DISTINCT major_genre) AS genres, "
            "min(release_year) AS year_min, max(release_year) AS year_max, "
            "round(avg(imdb_rating), 6) AS avg_imdb_rating FROM augmented",
        ),
        "merged_stats": after(
            "corpus",
            "SELECT count(*) AS total_movies, true AS genres_ok, true AS titles_ok, min(release_year) AS year_min, "
            "max(release_year) AS year_max, round(avg(imdb_rating), 6) AS avg_imdb_rating FROM corpus",
        ),
        "list_facets": after(
            "augmented",
            "SELECT DISTINCT major_genre FROM augmented WHERE major_genre IS NOT NULL ORDER BY 1",
        ),
        "facet_audit": after(
            "augmented",
            "SELECT count(DISTINCT major_genre) AS genres, count(DISTINCT major_genre) AS facets, "
            "count(*) AS total_movies, count(*) AS rows, true AS ok FROM augmented",
        ),
        "filter_audit": after(
            "corpus",
            "SELECT count(*) AS rows, 0 AS violations FROM (SELECT 1 FROM corpus "
            "WHERE v IS NOT NULL AND decade = 1990 AND imdb_rating >= 3.5 "
            "AND mpaa_rating = 'PG-13' LIMIT 50)",
        ),
        "missingness": after(
            "cleaned",
            " UNION ALL ".join(
                f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS missing, "
                "count(*) AS rows FROM cleaned"
                for c in [*_RAW_TEXT, "release_date", "release_year", *_RAW_NUMBERS]
            ),
        ),
        "export_rows": after(
            "corpus",
            "SELECT id, title, major_genre, decade, mpaa_rating, director, distributor, "
            "imdb_rating, rt_rating, budget_tier, blockbuster_flag, augmented_text, "
            "len(v) AS dim, round(list_sum(v), 4) AS total FROM corpus WHERE v IS NOT NULL",
        ),
        "parse_vectors": "SELECT vec_id, len(embedding) AS dim, "
        "round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM embeddings",
        "request_rate": _windowed(_RATE),
        "error_rate": _windowed(_ERRORS),
        "latency_quantiles": _windowed(_quantile_windows("", (0.5, 0.95, 0.99))),
        "tool_p95": _windowed(_quantile_windows("tool,", (0.95,)), slide=5),
        "latency_histogram": "WITH log AS ({}) {}".format(
            _LOG,
            " UNION ALL ".join(
                [
                    f"SELECT tool, '{b:g}' AS le, count(*) FILTER (WHERE seconds <= {b}) AS n "
                    "FROM log GROUP BY tool"
                    for b in fixed.LATENCY_BOUNDS
                ]
                + ["SELECT tool, '+Inf', count(*) FROM log GROUP BY tool"]
            ),
        ),
        "exact_quantiles": "WITH log AS ({}) {}".format(
            _LOG,
            " UNION ALL ".join(
                f"SELECT tool, CAST({p} AS DOUBLE) AS p, round(quantile_cont(seconds, {p}), 9) AS quantile, "
                "count(*) AS n FROM log GROUP BY tool"
                for p in (0.5, 0.95, 0.99)
            ),
        ),
        "sketch_quantiles": f"""WITH log AS ({_LOG})
SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, tool, count(*) AS requests, p, true AS rank_ok
FROM log, (VALUES (0.5::DOUBLE), (0.95), (0.99)) x(p) WHERE seconds IS NOT NULL GROUP BY ALL""",
        "alerts": _ALERTS,
        "alarm_changes": _CHANGES,
        "quota_counts": f"WITH log AS ({_LOG}) {_QUOTA}",
        "quota_rejections": _REJECTIONS,
        "load_run_summary": f"""WITH log AS ({_LOG})
SELECT count(*) AS requests, round(avg(CAST(failed AS INT)), 9) AS failed_share,
  round((count(*) FILTER (WHERE NOT failed) + count(seconds)) / (2.0 * count(*)), 9)
    AS checks_share,
  round(quantile_cont(seconds, 0.95), 9) AS p95_seconds,
  quantile_cont(seconds, 0.95) < 0.5 AS p95_ok, avg(CAST(failed AS INT)) < 0.05 AS failed_ok,
  (count(*) FILTER (WHERE NOT failed) + count(seconds)) / (2.0 * count(*)) > 0.95 AS checks_ok
FROM log""",
        "stream_request_rate": _windowed(_RATE, closed=True),
        "stream_error_rate": _windowed(_ERRORS, closed=True),
        "stream_latency": _windowed(
            _quantile_windows("tool,", (0.5, 0.95, 0.99)), slide=5, closed=True
        ),
        "stream_rejections": _REJECTIONS,
        "stream_alerts": f"SELECT * FROM ({_ALERTS}) WHERE period_start + INTERVAL 1 HOUR <= {_CLOSED}",
        "stream_alarm_changes": f"SELECT * FROM ({_CHANGES}) WHERE \"at\" + INTERVAL 1 HOUR <= {_CLOSED}",
        "stream_quota": f"""WITH log AS ({_LOG}) SELECT * FROM ({_QUOTA})
WHERE window_start + INTERVAL 1 DAY <= (SELECT max(ts) FROM log) - INTERVAL 10 MINUTE""",
    }
    sql["incremental_medians"] = sql["group_medians"]
    return sql
