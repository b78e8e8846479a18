"""Names, bounds and word lists that decide the results.

Everything in this module is a fixed value of the data model: results are only
right when these are exactly as stated.
"""

from __future__ import annotations

# The headers of the raw table as displayed. A header may also
# arrive with underscores instead of spaces.
RAW_HEADERS = (
    "Title",
    "US Gross",
    "Worldwide Gross",
    "US DVD Sales",
    "Production Budget",
    "Release Date",
    "MPAA Rating",
    "Running Time min",
    "Distributor",
    "Source",
    "Major Genre",
    "Creative Type",
    "Director",
    "Rotten Tomatoes Rating",
    "IMDB Rating",
    "IMDB Votes",
)

# Fixed value: the one header whose stored name is not its snake_case form.
SHORT_NAMES = {"Rotten Tomatoes Rating": "rt_rating"}

# Text columns that are standardised.
STRING_COLUMNS = (
    "title",
    "major_genre",
    "mpaa_rating",
    "director",
    "distributor",
    "creative_type",
    "source",
)

# Spellings of "no value", compared in lower case.
SENTINELS = ("", "none", "n/a", "na", "null", "unknown", "nan")

# Rating label aliases, compared in lower case.
RATING_ALIASES = {
    "g": "G",
    "pg": "PG",
    "pg13": "PG-13",
    "pg-13": "PG-13",
    "pg 13": "PG-13",
    "r": "R",
    "nc17": "NC-17",
    "nc-17": "NC-17",
    "nc 17": "NC-17",
    "not rated": "Not Rated",
    "not-rated": "Not Rated",
    "unrated": "Not Rated",
    "nr": "Not Rated",
    "open": "Open",
}

# Fixed value: newest genuine release year; a later one was encoded +100.
LAST_GENUINE_YEAR = 2011

# Date layouts tried in this order. The first is the layout of the raw table; the others
# stand in for open-ended inference. Cleaning takes another list as a parameter.
DATE_LAYOUTS = (
    "MMM d yyyy",
    "yyyy-MM-dd",
    "yyyy/MM/dd",
    "yyyyMMdd",
    "M/d/yyyy",
    "M-d-yyyy",
    "M/d/yy",
    "MMMM d yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "MMM-d-yyyy",
    "d MMM yyyy",
    "d MMMM yyyy",
    "d-MMM-yyyy",
    "d.M.yyyy",
    "MMMM yyyy",
    "MMM yyyy",
    "yyyy-MM",
    "yyyy",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
)

# Inclusive bounds, None where a side is open.
NUMERIC_BOUNDS = {
    "imdb_rating": (0.0, 10.0),
    "rt_rating": (0.0, 100.0),
    "imdb_votes": (0.0, None),
    "production_budget": (0.0, None),
    "us_gross": (0.0, None),
    "worldwide_gross": (0.0, None),
    "us_dvd_sales": (0.0, None),
    "running_time_min": (30.0, 300.0),
}

# Money columns in which 0 stands for "not recorded".
ZERO_MEANS_MISSING = ("production_budget", "us_gross", "worldwide_gross", "us_dvd_sales")

# The word written into missing descriptive columns, and those columns.
UNKNOWN = "Unknown"
UNKNOWN_COLUMNS = ("mpaa_rating", "director", "distributor", "creative_type", "source")

# Fixed value: facet columns, which stay NULL.
FACET_COLUMNS = ("major_genre",)

# Imputed column -> column whose groups give the median.
MEDIAN_GROUPS = {
    "imdb_rating": "major_genre",
    "rt_rating": "major_genre",
    "running_time_min": "major_genre",
    "production_budget": "decade",
}

# Fixed value: observed values a group needs before its median is used.
MIN_GROUP_SIZE = 10

# Decimals kept in an imputed column.
IMPUTED_DECIMALS = {
    "imdb_rating": 1,
    "rt_rating": 0,
    "running_time_min": 0,
    "production_budget": 0,
}

# Columns that hold whole numbers after imputation.
WHOLE_COLUMNS = (
    "rt_rating",
    "running_time_min",
    "production_budget",
    "imdb_votes",
    "us_gross",
    "worldwide_gross",
    "release_year",
)

# Budget bands (upper bound, exclusive) and the band above them.
BUDGET_BANDS = ((15_000_000, "indie"), (50_000_000, "mid"), (100_000_000, "major"))
TOP_BAND = "blockbuster"

# What a gross must reach to count as a hit.
HIT_FLOOR = 100_000_000.0
HIT_MULTIPLE = 2.0

# Derived columns, in report order.
DERIVED_FEATURES = ("decade", "budget_tier", "rating_score_delta", "blockbuster_flag")

# Task prefixes the embedding model expects.
DOCUMENT_PREFIX = "search_document: "
QUERY_PREFIX = "search_query: "

# Embedding defaults.
EMBEDDING_DIM = 768
EMBEDDING_BATCH = 32

# Columns of every search result.
RESULT_COLUMNS = (
    "id",
    "title",
    "release_year",
    "major_genre",
    "mpaa_rating",
    "director",
    "distributor",
    "imdb_rating",
    "rt_rating",
    "similarity",
    "match_type",
)

# Result counts.
TOP_K_DEFAULT = 10
TOP_K_SIMILAR = 5
TOP_K_MAX = 50

# Ranges a request must keep.
RATING_RANGE = (0.0, 10.0)
DECADE_RANGE = (1880, 2100)

# Trigram similarity a fuzzy match must reach.
TRIGRAM_THRESHOLD = 0.3

# Genre phrases, first match wins.
GENRE_PHRASES = (
    (r"psychological\s+thrillers?", "Thriller/Suspense"),
    (r"romantic\s+comed(?:y|ies)", "Romantic Comedy"),
    (r"black\s+comed(?:y|ies)", "Black Comedy"),
    (r"concerts?(?:\s*/\s*performances?)?", "Concert/Performance"),
    (r"thrillers?", "Thriller/Suspense"),
    (r"suspense", "Thriller/Suspense"),
    (r"documentar(?:y|ies)", "Documentary"),
    (r"adventures?", "Adventure"),
    (r"westerns?", "Western"),
    (r"musicals?", "Musical"),
    (r"horrors?", "Horror"),
    (r"comed(?:y|ies)", "Comedy"),
    (r"dramas?", "Drama"),
    (r"actions?", "Action"),
)

# Rating phrases, first match wins.
RATING_PHRASES = (
    (r"\bnc[-\s]?17\b", "NC-17"),
    (r"\bpg[-\s]?13\b", "PG-13"),
    (r"\bnot\s+rated\b|\bunrated\b", "Not Rated"),
    (r"\br[-\s]?rated\b|\brating\s+r\b", "R"),
    (r"\bpg[-\s]?rated\b", "PG"),
    (r"\bg[-\s]?rated\b", "G"),
)

# Decade phrases.
DECADE_FOUR_DIGITS = r"\b((?:19|20)\d0)s\b"
DECADE_TWO_DIGITS = r"\b(\d{2})s\b"
DECADE_NAMES = (
    ("nineties", 1990),
    ("eighties", 1980),
    ("seventies", 1970),
    ("sixties", 1960),
    ("fifties", 1950),
)

# Phrase that asks for a high rating, and what it means.
HIGH_RATING_PHRASE = r"\b(?:high(?:ly)?\s+rated|high\s+imdb|critically\s+acclaimed)\b"
HIGH_RATING = 7.5

# Columns of the analytics export.
EXPORT_COLUMNS = (
    "id",
    "title",
    "major_genre",
    "decade",
    "mpaa_rating",
    "director",
    "distributor",
    "imdb_rating",
    "rt_rating",
    "budget_tier",
    "blockbuster_flag",
    "augmented_text",
    "embedding",
)

# Columns of the stored table and their types.
STORED_TYPES = {
    "id": "string",
    "title": "string",
    "release_date": "date",
    "release_year": "int",
    "major_genre": "string",
    "mpaa_rating": "string",
    "director": "string",
    "distributor": "string",
    "creative_type": "string",
    "source": "string",
    "imdb_rating": "decimal(3,1)",
    "imdb_votes": "int",
    "rt_rating": "int",
    "production_budget": "bigint",
    "us_gross": "bigint",
    "worldwide_gross": "bigint",
    "running_time_min": "int",
    "budget_tier": "string",
    "decade": "int",
    "rating_score_delta": "double",
    "blockbuster_flag": "boolean",
    "imdb_rating_imputed": "boolean",
    "rt_rating_imputed": "boolean",
    "production_budget_imputed": "boolean",
    "running_time_min_imputed": "boolean",
    "augmented_text": "string",
    "embedding": "array<float>",
    "pipeline_version": "string",
    "created_at": "timestamp",
    "updated_at": "timestamp",
}

# Bounds of the latency histogram, in seconds.
LATENCY_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1, 2.5, 5, 7.5, 10)

# Request-log windows, quota and alert limits.
RATE_WINDOW = "5 minutes"
QUOTA_PER_MINUTE = 60
P95_LIMIT_SECONDS = 0.5
BACKEND_ERROR_LIMIT = 10
BALANCER_ERROR_LIMIT = 5
FAILED_SHARE_LIMIT = 0.05
CHECKS_SHARE_LIMIT = 0.95
