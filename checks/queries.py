"""The registered queries. Each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith import fixed
from catalith.functions.text import with_prefix
from catalith.functions.vectors import parse_vector
from catalith.operators import clean, dedup, features, impute, nearest, search, stats
from catalith.operators import titles, traffic, upsert, validate
from catalith.operators.embed import embed_documents, spread
from catalith.operators.vector_store import VectorStore
from catalith.plans.curate import load, prepare
from catalith.session import scratch_path, settle, tune
from catalith.sources.export import embedded_count, export_rows
from catalith.sources.raw import read_raw
from catalith.sources.snapshots import SnapshotTable, StaleBase
from catalith.sources.states import CountStates, LoadStates
from catalith.streaming.load import upsert_batch, upsert_stream
from catalith.streaming import traffic as stream
from checks.items import items
from checks.model import hashing_model
from checks.oracles import ASKED_NAME_RULE, BATCH_RULE, NAME_RULE, SENTENCE_RULE, TITLE_RULE

Query = Callable[[SparkSession, str], DataFrame]

DIM = 64
_FIRST_RUN = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
_SECOND_RUN = dt.datetime(2024, 2, 1, tzinfo=dt.timezone.utc)
_FILTERS = search.Filters(decade=1990, min_imdb_rating=3.5, mpaa_rating="PG-13")
_TEXT = list(fixed.STRING_COLUMNS)
_NUMBERS = list(fixed.NUMERIC_BOUNDS)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf}/{name}.parquet")


def _standard(spark: SparkSession, sf: str) -> DataFrame:
    return clean.standardize_strings(clean.rename_headers(items(spark, sf)))


def _dated(spark: SparkSession, sf: str) -> DataFrame:
    return clean.parse_release_dates(_standard(spark, sf))


def _cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return clean.clean(items(spark, sf))


def _augmented(spark: SparkSession, sf: str) -> DataFrame:
    return prepare(items(spark, sf))


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Curated items under their ids, with the given vectors where there is one."""
    rows = _augmented(spark, sf).where(upsert.has_natural_key())
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_pos"), "embedding")
    return rows.join(vectors, "row_pos", "left").withColumn(
        "id", upsert.item_id(F.col("title"), F.col("release_year"))
    )


def _stored_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus written down, for queries that read it more than once."""
    return settle(corpus(spark, sf), "corpus")


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").withColumnRenamed("vec_id", "id")


def _dates_as_text(df: DataFrame) -> DataFrame:
    return df.withColumn("release_date", F.col("release_date").cast("string"))


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _results(df: DataFrame) -> DataFrame:
    return _rounded(df, "similarity")


# Cleaning


def clean_strings(spark: SparkSession, sf: str) -> DataFrame:
    return _standard(spark, sf).select("row_pos", *_TEXT)


def clean_dates(spark: SparkSession, sf: str) -> DataFrame:
    return _dates_as_text(_dated(spark, sf).select("row_pos", "release_date", "release_year"))


def clean_numerics(spark: SparkSession, sf: str) -> DataFrame:
    return clean.validate_numerics(_standard(spark, sf)).select("row_pos", *_NUMBERS)


def cleaning_report(spark: SparkSession, sf: str) -> DataFrame:
    return clean.cleaning_report(items(spark, sf))


def century_examples(spark: SparkSession, sf: str) -> DataFrame:
    return clean.century_examples(_standard(spark, sf))


def dedup_items(spark: SparkSession, sf: str) -> DataFrame:
    kept = _cleaned(spark, sf)
    return _dates_as_text(
        kept.select("row_pos", *_TEXT, "release_date", "release_year", *_NUMBERS)
    )


def dedup_examples(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.dropped_examples(_dated(spark, sf))


def dedup_documents(spark: SparkSession, sf: str) -> DataFrame:
    kept = dedup.keep_one_text(table(spark, sf, "documents"), "text", "doc_id")
    return kept.select("doc_id", "lang", "source", "n_chars")


# Imputation


def impute_numeric(spark: SparkSession, sf: str) -> DataFrame:
    columns = list(fixed.MEDIAN_GROUPS)
    flags = [impute.flag_name(c) for c in columns]
    cleaned = settle(_cleaned(spark, sf), "cleaned")
    return impute.impute_numeric(cleaned).select("row_pos", *columns, *flags)


def impute_categorical(spark: SparkSession, sf: str) -> DataFrame:
    filled = impute.impute_categorical(_cleaned(spark, sf))
    return filled.select("row_pos", "major_genre", *fixed.UNKNOWN_COLUMNS)


def group_medians(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(impute.medians(_cleaned(spark, sf)), "median")


def incremental_medians(spark: SparkSession, sf: str) -> DataFrame:
    """Medians from the states that three loads of the catalog left, two of them summed up."""
    cleaned = settle(_cleaned(spark, sf), "cleaned")
    states = CountStates(spark, scratch_path(spark, "states"), [*impute.MEDIAN_KEYS, "value"])
    for number in range(3):
        states.add(number, impute.observed_values(cleaned.where(F.col("row_pos") % 3 == number)))
        if number == 1:
            states.compact()
    return _rounded(impute.medians_of_counts(states.read()), "median")


def imputation_report(spark: SparkSession, sf: str) -> DataFrame:
    return impute.imputation_report(settle(_cleaned(spark, sf), "cleaned"))


# Features


def derived_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = _augmented(spark, sf).select("row_pos", *fixed.DERIVED_FEATURES)
    return _rounded(rows, "rating_score_delta")


def render_text(spark: SparkSession, sf: str) -> DataFrame:
    return _augmented(spark, sf).select("row_pos", "augmented_text")


def augmentation_report(spark: SparkSession, sf: str) -> DataFrame:
    return features.augmentation_report(_augmented(spark, sf))


def value_counts(spark: SparkSession, sf: str) -> DataFrame:
    return features.value_counts(_augmented(spark, sf), "budget_tier")


# Embedding


def prefix_texts(spark: SparkSession, sf: str) -> DataFrame:
    text = with_prefix(F.col("text"), fixed.DOCUMENT_PREFIX)
    documents = table(spark, sf, "documents").select("doc_id", text.alias("text"))
    return documents.select(
        "doc_id", F.md5("text").alias("digest"), F.length("text").alias("chars")
    )


def _sum(vector: Column, weight: Callable[[Column, Column], Column]) -> Column:
    """Sum over a vector of weight(value, 1-based place)."""
    terms = F.transform(vector, lambda x, i: weight(x.cast("double"), i + 1))
    return F.aggregate(terms, F.lit(0.0), lambda total, x: total + x)


def embedded_texts(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents").select("doc_id", "text")
    rows = embed_documents(
        spread(documents), text="text", factory=hashing_model(DIM), dim=DIM
    )
    v = F.col("embedding")
    return rows.select(
        "doc_id",
        F.size(v).alias("dim"),
        _sum(v, lambda x, i: x).alias("total"),
        _sum(v, lambda x, i: x * i).alias("weighted"),
        _sum(v, lambda x, i: x * x).alias("squares"),
    )


def embed_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """The documents in two loads, the second with all of them again: it asks for the new texts only."""
    documents = table(spark, sf, "documents").select("doc_id", "text")
    store = VectorStore(spark, scratch_path(spark, "vectors"), f"hashing-{DIM}")
    options = {"text": "text", "factory": hashing_model(DIM), "dim": DIM}
    first = store.add_missing(documents.where(F.col("doc_id") % 2 == 0), **options)
    second = store.add_missing(documents, **options)
    v = F.col("embedding")
    return store.embed(documents, **options).select(
        "doc_id",
        F.size(v).alias("dim"),
        _sum(v, lambda x, i: x * i).alias("weighted"),
        F.lit(first).alias("asked_first"),
        F.lit(second).alias("asked_second"),
    )


def parse_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors written as text and read back."""
    text = F.concat(
        F.lit("["),
        F.concat_ws(", ", F.transform("embedding", lambda x: x.cast("string"))),
        F.lit("]"),
    )
    rows = table(spark, sf, "embeddings").select("vec_id", text.alias("text"))
    vector = parse_vector(F.col("text"), DIM)
    rows = rows.select("vec_id", vector.alias("v"))
    return rows.select(
        "vec_id",
        F.size("v").alias("dim"),
        F.round(_sum(F.col("v"), lambda x, i: x), 4).alias("total"),
    )


# Load


def _second_batch(rows: DataFrame) -> DataFrame:
    """Every item again: other spelling, other director, some a year later."""
    later = F.when(F.col("row_pos") % 5 == 0, 1).otherwise(0)
    return rows.withColumns(
        {
            "title": F.upper("title"),
            "director": F.concat("director", F.lit(" II")),
            "release_year": F.col("release_year") + later,
        }
    )


def _two_loads(spark: SparkSession, sf: str) -> tuple[SnapshotTable, DataFrame]:
    first = _stored_corpus(spark, sf)
    second = _second_batch(first)
    stored = SnapshotTable(spark, scratch_path(spark, "table"))
    load(first, stored, "0.1.0", _FIRST_RUN)
    _, report = load(second, stored, "0.2.0", _SECOND_RUN)
    return stored, report


def upsert_items(spark: SparkSession, sf: str) -> DataFrame:
    return _two_loads(spark, sf)[0].read().select(
        "id",
        "title",
        "release_year",
        "director",
        "rt_rating",
        "augmented_text",
        "pipeline_version",
        (F.col("created_at") == F.lit(_FIRST_RUN)).alias("created_first"),
        (F.col("updated_at") == F.lit(_SECOND_RUN)).alias("updated_second"),
    )


def stream_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Both loads as they arrive, in several micro-batches each; the last one is offered again."""
    first = _stored_corpus(spark, sf)
    arrived, state = scratch_path(spark, "arrived"), scratch_path(spark, "state")
    stored = SnapshotTable(spark, scratch_path(spark, "table"))
    for rows in (first, _second_batch(first)):
        # Rows of one key share a file, so they come in one micro-batch.
        rows.withColumn("_key", F.lower("title")).repartition(3, "_key").drop("_key").write.mode(
            "append"
        ).parquet(arrived)
    source = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 2).parquet(arrived)
    upsert_stream(source, stored, state, "0.1.0", source="arrivals").awaitTermination()
    upsert_batch(stored, "0.1.0", source="arrivals")(first, stored.manifest(stored.latest())["ledger"]["arrivals"])
    return stored.read().select("id", "title", "release_year", "director", "rt_rating", "augmented_text")


def two_writers(spark: SparkSession, sf: str) -> DataFrame:
    """Halves of the catalog planned on one base: the later one is refused and merged again."""
    rows = _stored_corpus(spark, sf)
    stored = SnapshotTable(spark, scratch_path(spark, "table"))
    halves = [rows.where(F.col("row_pos") % 2 == k) for k in (0, 1)]
    batches = [upsert.bind(upsert.loadable(half), "0.1.0") for half in halves]
    base = stored.latest()
    for half, batch in zip(halves, batches):
        try:
            stored.write(upsert.merge(None, batch, _FIRST_RUN), base)
        except StaleBase:
            load(half, stored, "0.1.0", _SECOND_RUN)
    return stored.read().select("id", "title", "release_year", "director")


def load_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and vectors that come apart, joined by the load."""
    rows = _stored_corpus(spark, sf).where(F.col("embedding").isNotNull())
    stored = SnapshotTable(spark, scratch_path(spark, "table"))
    vectors = rows.select("row_pos", "embedding")
    load(rows.drop("embedding"), stored, "0.1.0", _FIRST_RUN, vectors=vectors)
    total = F.round(_sum(F.col("embedding"), lambda x, i: x), 4)
    return stored.read().select("id", "title", total.alias("total"))


def stored_lookups(spark: SparkSession, sf: str) -> DataFrame:
    """Point lookups in the stored table, by id and by title in another case."""
    rows = _stored_corpus(spark, sf)
    stored = SnapshotTable(spark, scratch_path(spark, "table"))
    load(rows, stored, "0.1.0", _FIRST_RUN)
    found = stored.by_id(_bolt(rows)).select(F.lit("id").alias("kind"), "id", "title")
    return found.union(stored.by_title("hOT gEAR").select(F.lit("title"), "id", "title"))


def raw_files(spark: SparkSession, sf: str) -> DataFrame:
    """Raw rows in several files: each position comes before that of the next key."""
    path = scratch_path(spark, "raw")
    given = items(spark, sf).select(
        F.col("row_pos").alias("key"), "Title", F.col("row_pos").cast("string").alias("Director")
    )
    given.repartitionByRange(7, "key").sortWithinPartitions("key").drop("key").write.json(path)
    read = read_raw(spark, path, headers=("Title", "Director"))
    cleaned = settle(
        clean.standardize_strings(clean.rename_headers(read)).select(
            F.col("director").cast("bigint").alias("key"), "title", "row_pos"
        ),
        "cleaned",
    )
    after = cleaned.select((F.col("key") - 1).alias("key"), F.col("row_pos").alias("next"))
    ordered = F.coalesce(F.col("row_pos") < F.col("next"), F.lit(True))
    return cleaned.join(after, "key", "left").select("key", "title", ordered.alias("ordered"))


def embedded_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Embedded rows per genre of the corpus, and their count as the export probes it."""
    rows = _stored_corpus(spark, sf)
    genres = rows.groupBy("major_genre").agg(F.count("embedding").alias("embedded"))
    return genres.withColumn("in_all", F.lit(embedded_count(rows)))


def load_report(spark: SparkSession, sf: str) -> DataFrame:
    return _two_loads(spark, sf)[1]


def skipped_examples(spark: SparkSession, sf: str) -> DataFrame:
    return upsert.skipped_examples(_augmented(spark, sf))


def load_audit(spark: SparkSession, sf: str) -> DataFrame:
    return stats.load_audit(_two_loads(spark, sf)[0].read(), DIM)


def dimension_counts(spark: SparkSession, sf: str) -> DataFrame:
    return stats.dimension_counts(table(spark, sf, "embeddings"))


def repeated_keys(spark: SparkSession, sf: str) -> DataFrame:
    return stats.repeated_keys(_two_loads(spark, sf)[0].read())


def repeated_offers(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that two batches offer more than once between them, before they are loaded."""
    rows = _stored_corpus(spark, sf)
    return stats.repeated_keys(rows.unionByName(_second_batch(rows)))


def rerun_changes(spark: SparkSession, sf: str) -> DataFrame:
    """The same batch loaded twice changes nothing but the time of the update."""
    rows = _stored_corpus(spark, sf)
    stored = SnapshotTable(spark, scratch_path(spark, "table"))
    load(rows, stored, "0.1.0", _FIRST_RUN)
    load(rows, stored, "0.1.0", _SECOND_RUN)
    return stats.snapshot_changes(stored.read(1), stored.read(2))


def load_changes(spark: SparkSession, sf: str) -> DataFrame:
    """What the second load of some items changed, from the buckets that differ alone."""
    rows = _stored_corpus(spark, sf)
    stored = SnapshotTable(spark, scratch_path(spark, "table"))
    load(rows, stored, "0.1.0", _FIRST_RUN)
    load(_second_batch(rows).where(F.col("row_pos") % 40 == 0), stored, "0.1.0", _SECOND_RUN)
    return stored.changes(1, 2)


# Search


def _query_vector(spark: SparkSession, sf: str) -> list[float]:
    return search.vector_of(_vectors(spark, sf), 7)


def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    found = search.hybrid_search(corpus(spark, sf), _query_vector(spark, sf), _FILTERS)
    return _results(found)


def _batch_requests(spark: SparkSession, sf: str) -> DataFrame:
    rules = [f"{sql} AS {name}" for name, sql in BATCH_RULE.items()]
    return table(spark, sf, "embeddings").selectExpr("vec_id AS query_id", "embedding", *rules)


def hybrid_search_batch(spark: SparkSession, sf: str) -> DataFrame:
    return _results(search.search_many(_stored_corpus(spark, sf), _batch_requests(spark, sf)))


def hybrid_search_grid(spark: SparkSession, sf: str) -> DataFrame:
    """The same in many blocks of queries, as for a query table of any size."""
    found = search.search_many(_stored_corpus(spark, sf), _batch_requests(spark, sf), block=64)
    return _results(found)


def _bolt(rows: DataFrame) -> str:
    """Id of the item (blue bolt, 1982): it depends on the key alone."""
    key = F.lit("blue bolt"), F.lit(1982)
    return rows.sparkSession.range(1).select(upsert.item_id(*key)).first()[0]


def similar_items(spark: SparkSession, sf: str) -> DataFrame:
    rows = _stored_corpus(spark, sf)
    return _results(search.similar_items(rows, _bolt(rows)))


def knn_all(spark: SparkSession, sf: str) -> DataFrame:
    vectors = _vectors(spark, sf)
    return _rounded(nearest.similar_many(vectors, vectors, 10), "similarity")


def similar_many(spark: SparkSession, sf: str) -> DataFrame:
    """Similar items of a table of ids: those of the first orders, some of which are unknown."""
    vectors = _vectors(spark, sf)
    wanted = table(spark, sf, "orders").selectExpr("o_orderkey AS id")
    return _rounded(nearest.similar_many(vectors, wanted, 5), "similarity")


def knn_index(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours of one vector in a stored table."""
    vectors = settle(_vectors(spark, sf), "vectors")
    found = nearest.nearest_rows(vectors, search.vector_of(vectors, 11), 10)
    return _rounded(found.select("id", "label", "similarity"), "similarity")


def lookup_by_id(spark: SparkSession, sf: str) -> DataFrame:
    rows = corpus(spark, sf)
    return search.lookup_by_id(rows, _bolt(rows).upper())


def lookup_many(spark: SparkSession, sf: str) -> DataFrame:
    """Every item asked for; a third of the ids in braces, a third malformed."""
    rows = _stored_corpus(spark, sf)
    kind = F.col("row_pos") % 3
    asked = rows.select(
        F.col("row_pos").alias("request_id"),
        F.when(kind == 0, F.concat(F.lit("{"), F.upper("id"), F.lit("}")))
        .when(kind == 1, F.col("id"))
        .otherwise(F.concat(F.col("id"), F.lit("x")))
        .alias("movie_id"),
    )
    return search.lookup_many(rows, asked)


def reject_bad_requests(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "events").select(
        F.col("event_id").alias("query_id"),
        F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("query"),
        (F.col("user_id") - 5).alias("top_k"),
        F.round(F.col("value") / 10, 3).alias("min_imdb_rating"),
        (F.col("user_id") + 1870).alias("decade"),
    )
    return validate.split_requests(asked)[1]


def title_exact(spark: SparkSession, sf: str) -> DataFrame:
    return titles.title_exact(corpus(spark, sf), "Hot Gear")


def title_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    return _results(titles.title_fuzzy(corpus(spark, sf), "smal gizmos"))


def title_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return _results(titles.title_lookup(_stored_corpus(spark, sf), "Hott Gear"))


def title_match_batch(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "part").selectExpr(
        "p_partkey AS query_id", f"{TITLE_RULE} AS title"
    )
    found = titles.title_match(_stored_corpus(spark, sf), asked)
    return _results(
        found.select("query_id", "id", "title", "release_year", "similarity", "match_type")
    )


def _sentences(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr(
        "p_partkey AS query_id", f"{SENTENCE_RULE} AS query"
    )


def extract_filters(spark: SparkSession, sf: str) -> DataFrame:
    return search.extract_filters(_sentences(spark, sf))


def given_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Filters that a request gives win over those of its sentence."""
    key = F.col("query_id")
    return search.extract_filters(
        _sentences(spark, sf).select(
            "*",
            F.when(key % 3 == 0, "Given").alias("genre_filter"),
            F.when(key % 4 == 0, F.lit(1930)).alias("decade"),
            F.when(key % 5 == 0, F.lit(1.5)).alias("min_imdb_rating"),
        )
    )


def title_match_names(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct titles: each customer's name and address asked with a letter left out."""
    people = table(spark, sf, "customer")
    named = people.selectExpr(
        "cast(c_custkey AS string) AS id", f"{NAME_RULE} AS title", "cast(c_nationkey AS int) AS release_year"
    )
    for column, kind in fixed.STORED_TYPES.items():
        if column not in named.columns:
            named = named.withColumn(column, F.lit(None).cast(kind))
    asked = people.selectExpr("c_custkey AS query_id", f"{ASKED_NAME_RULE} AS title")
    found = titles.title_match(settle(named, "names"), asked)
    return _results(found.select("query_id", "id", "title", "similarity", "match_type"))


def nl_search(spark: SparkSession, sf: str) -> DataFrame:
    rows = corpus(spark, sf).drop("embedding")
    embedded = settle(embed_documents(rows, factory=hashing_model(DIM), dim=DIM), "embedded")
    return _results(search.search_sentences(embedded, _sentences(spark, sf), hashing_model(DIM), DIM))


# Statistics and audits


def dataset_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(stats.dataset_stats(_augmented(spark, sf)), "avg_imdb_rating")


def merged_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics from the states of three loads; distinct counts within 2 % of the true ones."""
    rows = settle(corpus(spark, sf), "rows")
    states = LoadStates(spark, scratch_path(spark, "states"))
    for number in range(3):
        states.add(number, stats.stats_state(rows.where(F.col("row_pos") % 3 == number)))
    key = F.concat_ws("#", F.lower("title"), F.col("release_year").cast("string"))
    true = rows.agg(F.count_distinct("major_genre").alias("genres"), F.count_distinct(key).alias("titles")).first()
    near = [
        (F.abs(F.col(name) - true[name]) <= 0.02 * true[name]).alias(f"{name}_ok") for name in ("genres", "titles")
    ]
    merged = stats.merged_stats(states.read())
    return _rounded(merged.select("total_movies", *near, "year_min", "year_max", "avg_imdb_rating"), "avg_imdb_rating")


def list_facets(spark: SparkSession, sf: str) -> DataFrame:
    return stats.list_facets(_augmented(spark, sf))


def facet_audit(spark: SparkSession, sf: str) -> DataFrame:
    return stats.facet_audit(settle(_augmented(spark, sf), "augmented"))


def filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    found = search.hybrid_search(
        corpus(spark, sf), _query_vector(spark, sf), _FILTERS, top_k=fixed.TOP_K_MAX
    )
    return stats.filter_violations(found, _FILTERS)


def missingness(spark: SparkSession, sf: str) -> DataFrame:
    columns = [*_TEXT, "release_date", "release_year", *_NUMBERS]
    return stats.missingness(_cleaned(spark, sf), columns)


def exported(spark: SparkSession, sf: str) -> DataFrame:
    rows = export_rows(corpus(spark, sf), DIM)
    return rows.withColumns(
        {
            "dim": F.size("embedding"),
            "total": F.round(_sum(F.col("embedding"), lambda x, i: x), 4),
        }
    ).drop("embedding")


# Request log


def _log(spark: SparkSession, sf: str) -> DataFrame:
    return traffic.requests_of(table(spark, sf, "events"))


def request_rate(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(traffic.request_rate(_log(spark, sf)), "per_second")


def error_rate(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(traffic.error_rate(_log(spark, sf)), "errors_per_second")


def latency_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    found = traffic.latency_quantiles(_log(spark, sf), slide="1 minute")
    return _rounded(found, "p50", "p95", "p99", digits=9)


def tool_p95(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(traffic.tool_p95(_log(spark, sf)), "p95", digits=9)


def latency_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return traffic.latency_histogram(_log(spark, sf))


def exact_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(traffic.exact_quantiles(_log(spark, sf)), "quantile", digits=9)


def sketch_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Daily quantiles merged from hourly sketches, and whether their ranks are within 1 %."""
    log = _log(spark, sf)
    panes = settle(traffic.latency_sketches(log, pane="1 hour"), "panes")
    found = settle(traffic.sketched_quantiles(traffic.merged_sketches(panes)), "found")
    day = log.select("tool", "seconds", F.window("ts", "1 day")["start"].alias("window_start"))
    ranked = day.join(found, ["tool", "window_start"]).groupBy("window_start", "tool", "requests", "p")
    below = F.avg((F.col("seconds") < F.col("quantile")).cast("double"))
    upto = F.avg((F.col("seconds") <= F.col("quantile")).cast("double"))
    # A rank may be off by what one request weighs where there are few.
    slack = F.lit(0.01) + F.lit(1.0) / F.first("requests")
    return ranked.agg(((below - slack <= F.col("p")) & (F.col("p") <= upto + slack)).alias("rank_ok"))


def alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly periods and lower limits: the test log is sparse."""
    limits = (("p95_latency", "p95", 0.2), ("backend_errors", "errors", 4))
    limits += (("balancer_errors", "errors", 2),)
    return traffic.alerts(_log(spark, sf), period="1 hour", alarms=limits)


def _hourly(operator: Callable[..., DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """The operator with the alarms and periods of ``alerts``."""
    limits = (("p95_latency", "p95", 0.2), ("backend_errors", "errors", 4))
    limits += (("balancer_errors", "errors", 2),)
    return lambda log: operator(log, period="1 hour", alarms=limits)


def alarm_changes(spark: SparkSession, sf: str) -> DataFrame:
    return traffic.alarm_changes(alerts(spark, sf), period="1 hour")


def quota_counts(spark: SparkSession, sf: str) -> DataFrame:
    return traffic.quota_counts(_log(spark, sf), limit=4, window="1 day")


def quota_rejections(spark: SparkSession, sf: str) -> DataFrame:
    return traffic.quota_rejections(_log(spark, sf), limit=4, window="1 day")


def load_run_summary(spark: SparkSession, sf: str) -> DataFrame:
    found = traffic.load_run_summary(_log(spark, sf))
    return _rounded(found, "failed_share", "checks_share", "p95_seconds", digits=9)


def _streamed(
    spark: SparkSession, sf: str, name: str, operator: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Run an operator over the event table as a stream, and read what it wrote, with its time unzoned."""
    schema = table(spark, sf, "events").schema
    source = stream.stream_events(spark, sf, schema, glob="events.parquet")
    out = operator(traffic.requests_of(source))
    path = scratch_path(spark, name)
    stream.run_available(out, path, scratch_path(spark, f"{name}-state"))
    written = spark.read.schema(out.schema).parquet(path)
    return written.withColumns(
        {
            name: F.col(name).cast("timestamp_ntz")
            for name in ("window_start", "period_start", "at")
            if name in written.columns
        }
    )


def stream_request_rate(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_streamed(spark, sf, "rate", stream.request_rate), "per_second")


def stream_error_rate(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_streamed(spark, sf, "errors", stream.error_rate), "errors_per_second")


def stream_latency(spark: SparkSession, sf: str) -> DataFrame:
    found = _streamed(
        spark, sf, "latency", lambda log: stream.latency_quantiles(log, by=("tool",))
    )
    return _rounded(found, "p50", "p95", "p99", digits=9)


def stream_quota(spark: SparkSession, sf: str) -> DataFrame:
    return _streamed(
        spark, sf, "quota", lambda log: stream.quota_counts(log, limit=4, window="1 day")
    )


def stream_rejections(spark: SparkSession, sf: str) -> DataFrame:
    """Which requests are refused, told as they arrive."""
    return _streamed(
        spark, sf, "rejections", lambda log: stream.quota_rejections(log, limit=4, window="1 day")
    )


def stream_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return _streamed(spark, sf, "alerts", _hourly(stream.alerts))


def stream_alarm_changes(spark: SparkSession, sf: str) -> DataFrame:
    return _streamed(spark, sf, "changes", _hourly(stream.alarm_changes))


def queries() -> dict[str, Query]:
    listed = [
        clean_strings,
        clean_dates,
        clean_numerics,
        cleaning_report,
        century_examples,
        dedup_items,
        dedup_examples,
        dedup_documents,
        impute_numeric,
        impute_categorical,
        group_medians,
        incremental_medians,
        imputation_report,
        derived_features,
        render_text,
        augmentation_report,
        value_counts,
        prefix_texts,
        embed_incremental,
        parse_vectors,
        upsert_items,
        stream_upsert,
        two_writers,
        load_vectors,
        stored_lookups,
        raw_files,
        embedded_rows,
        load_report,
        skipped_examples,
        load_audit,
        dimension_counts,
        repeated_keys,
        repeated_offers,
        rerun_changes,
        load_changes,
        hybrid_search,
        hybrid_search_batch,
        hybrid_search_grid,
        similar_items,
        knn_all,
        knn_index,
        similar_many,
        lookup_by_id,
        lookup_many,
        reject_bad_requests,
        title_exact,
        title_fuzzy,
        title_lookup,
        title_match_batch,
        title_match_names,
        extract_filters,
        given_filters,
        nl_search,
        dataset_stats,
        merged_stats,
        list_facets,
        facet_audit,
        filter_audit,
        missingness,
        request_rate,
        error_rate,
        latency_quantiles,
        tool_p95,
        latency_histogram,
        exact_quantiles,
        sketch_quantiles,
        alerts,
        alarm_changes,
        quota_counts,
        quota_rejections,
        load_run_summary,
        stream_request_rate,
        stream_error_rate,
        stream_latency,
        stream_quota,
        stream_rejections,
        stream_alerts,
        stream_alarm_changes,
    ]
    named = {query.__name__: query for query in listed}
    return named | {"embed_documents": embedded_texts, "export_rows": exported}
