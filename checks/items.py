"""The dirty catalog view over ``part``: one rule list for Spark and DuckDB.

Integer arithmetic and concatenation only, so both engines give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catalith.session import tune

_MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"

# column, rule; {div} is the engine's integer division.
_RULES = (
    ("row_pos", "p_partkey"),
    (
        "Title",
        "CASE WHEN p_partkey % 97 = 0 THEN NULL WHEN p_partkey % 89 = 0 THEN 'N/A' "
        "WHEN p_partkey % 67 = 0 THEN CAST(p_size * 100 AS STRING) "
        "WHEN p_partkey % 7 = 0 THEN upper(p_name) "
        "WHEN p_partkey % 5 = 0 THEN '  ' || replace(p_name, ' ', '  ') || ' ' ELSE p_name END",
    ),
    (
        "Release_Date",
        "CASE WHEN p_partkey % 61 = 0 THEN NULL WHEN p_partkey % 59 = 0 THEN 'not-a-date' "
        "WHEN p_partkey % 53 = 0 THEN '18-Jun-1998' WHEN p_partkey % 47 = 0 THEN '1997' "
        "WHEN p_partkey % 43 = 0 THEN '19960618' WHEN p_partkey % 41 = 0 THEN '6/18/1995' "
        f"ELSE substr('{_MONTHS}', CAST((p_partkey % 12) * 3 + 1 AS INT), 3) || ' ' || "
        "CASE WHEN p_partkey % 2 = 0 THEN lpad(CAST(p_partkey % 28 + 1 AS STRING), 2, '0') "
        "ELSE CAST(p_partkey % 28 + 1 AS STRING) END || ' ' || "
        "CAST(1980 + p_partkey % 36 AS STRING) END",
    ),
    (
        "Major_Genre",
        "CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 83 = 0 THEN 'Unknown' "
        "ELSE p_type END",
    ),
    (
        "MPAA_Rating",
        "CASE p_partkey % 8 WHEN 0 THEN 'pg13' WHEN 1 THEN 'PG-13' WHEN 2 THEN 'R' "
        "WHEN 3 THEN 'unrated' WHEN 4 THEN 'G' WHEN 5 THEN 'nc 17' WHEN 6 THEN 'NR' END",
    ),
    ("Director", "CASE WHEN p_partkey % 4 = 0 THEN 'None' ELSE p_brand END"),
    (
        "Distributor",
        "CASE WHEN p_partkey % 9 = 0 THEN NULL "
        "ELSE '20th  Studio ' || CAST(p_partkey % 5 AS STRING) END",
    ),
    (
        "Creative_Type",
        "CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE 'Type ' || CAST(p_partkey % 4 AS STRING) END",
    ),
    (
        "Source",
        "CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE 'Source ' || CAST(p_partkey % 3 AS STRING) END",
    ),
    (
        "IMDB_Rating",
        "CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE "
        "CAST(((p_partkey * 37) % 110) {div} 10 AS STRING) || '.' || "
        "CAST((p_partkey * 37) % 10 AS STRING) END",
    ),
    (
        "IMDB_Votes",
        "CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 71 = 0 THEN '1e-300' "
        "WHEN p_partkey % 73 = 0 THEN 'inf' WHEN p_partkey % 79 = 0 THEN '1e400' "
        "ELSE CAST((p_partkey * 7919) % 500000 - 5 AS STRING) END",
    ),
    (
        "Rotten_Tomatoes_Rating",
        "CASE WHEN p_partkey % 4 = 1 THEN NULL "
        "ELSE CAST((p_partkey * 53) % 108 - 3 AS STRING) END",
    ),
    (
        "Running_Time_min",
        "CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 29 = 0 THEN '12x' "
        "ELSE CAST((p_partkey * 17) % 300 + 20 AS STRING) END",
    ),
    (
        "Production_Budget",
        "CASE WHEN p_partkey % 101 = 0 THEN NULL WHEN p_partkey % 103 = 0 THEN '0' "
        "ELSE CAST(p_size * 4000000 AS STRING) END",
    ),
    (
        "US_Gross",
        "CASE WHEN p_partkey % 17 = 0 THEN '0' "
        "ELSE CAST((p_partkey % 250) * 1000000 AS STRING) END",
    ),
    (
        "Worldwide_Gross",
        "CASE WHEN p_partkey % 17 = 0 THEN '0' "
        "ELSE CAST((p_partkey % 400) * 1000000 AS STRING) END",
    ),
    (
        "US_DVD_Sales",
        "CASE WHEN p_partkey % 10 = 0 THEN CAST((p_partkey % 50) * 100000 AS STRING) END",
    ),
)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = tune(spark).read.parquet(f"{sf_dir}/part.parquet")
    return part.selectExpr(*[f"{rule.format(div='div')} AS `{name}`" for name, rule in _RULES])


def items_sql() -> str:
    chosen = ",\n  ".join(f"{rule.format(div='//')} AS {name}" for name, rule in _RULES)
    return f"SELECT {chosen}\nFROM part"
