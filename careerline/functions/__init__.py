"""Column expressions. All of them are built-in Spark functions, so they stay in codegen."""

from careerline.functions.scalars import (  # noqa: F401
    age_year,
    blank_to_null,
    full_name,
    half_away_round,
    joined_key,
    lenient_date,
    mentions_any,
    ratio,
    strict_date,
    try_number,
    years_between,
)
