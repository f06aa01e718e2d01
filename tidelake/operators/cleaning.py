"""Cleaning of raw tables. Each takes raw rows and returns one tagged frame or a triple (valid, rejected, duplicates)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import ISO_TIME, LOCAL_TIME, PLAIN_TIME, blank_to_null, lenient_int, normalize_state, parse_first
from .joins import lookup, with_exists
from .keys import latest_per_key, mode_per_key
from .routing import REASON, split_corrupt, tag

# Categories that the translation table lacks.
EXTRA_CATEGORIES = {"pc_gamer": "pc_gamer", "portateis_cozinha_e_preparadores_de_alimentos": "kitchen_portables_and_food_preparers"}
UNKNOWN_CATEGORY = "unknown"
Triple = tuple[DataFrame, DataFrame, DataFrame]


def _routed(tagged: DataFrame, raw: list[str], valid: list[Column | str], corrupt: DataFrame, duplicates: DataFrame) -> Triple:
    """Rejected rows keep every raw column."""
    rejected = tagged.where(F.col(REASON).isNotNull()).select(*[F.col(f"_raw.{c}").alias(c) for c in raw], REASON)
    return tagged.where(F.col(REASON).isNull()).select(*valid), rejected.unionByName(corrupt.select(*raw, REASON)), duplicates


def _deduplicated(good: DataFrame, keys: list[str], order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(latest row of each key, one row with the count of the others)."""
    n = good.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicates"))
    return latest_per_key(good, keys, order), n


def clean_customer_changes(raw: DataFrame, geolocation: DataFrame, customers: DataFrame) -> Triple:
    """(valid changes, rejected raw rows with _reason, one row ``duplicates``).

    Of rows with one change_id the newest partition's, then file's, stays. States are normalised; a missing city comes
    from the zip code. Rules in order: missing_required_field, unparseable_timestamp, invalid_state, unfixable_city,
    unknown_customer.
    """
    good, corrupt = split_corrupt(raw)
    latest, duplicates = _deduplicated(good, ["change_id"], [F.desc("_bronze_ingest_date"), F.desc("_source_file")])
    zips = geolocation.select(F.col("zip_code_prefix").alias("new_zip_code_prefix"), F.col("city").alias("_zip_city"))
    kept = latest.withColumn("_raw", F.struct(*raw.columns))
    kept = with_exists(lookup(kept, zips, ["new_zip_code_prefix"]), customers, ["customer_unique_id"])
    state, city = normalize_state("new_state"), F.lower(blank_to_null("new_city"))
    fixed = kept.withColumns({"_state": state, "_city": F.coalesce(city, F.lower("_zip_city")), "_at": parse_first("requested_at", PLAIN_TIME, ISO_TIME, LOCAL_TIME), "_city_filled": city.isNull() & F.col("_zip_city").isNotNull()})
    required = [F.col(c).isNull() for c in ("change_id", "customer_unique_id", "requested_at")]
    tagged = tag(fixed, [
        ("missing_required_field", required[0] | required[1] | required[2]),
        ("unparseable_timestamp", F.col("_at").isNull()),
        ("invalid_state", F.col("_state").isNull()),
        ("unfixable_city", F.col("_city").isNull()),
        ("unknown_customer", ~F.col("_known")),
    ])
    valid = [
        "change_id", "customer_unique_id", "new_zip_code_prefix", F.col("_city").alias("new_city"), F.col("_state").alias("new_state"), F.col("_at").alias("requested_at"), "source",
        (~F.col("_state").eqNullSafe(F.col("new_state"))).alias("_state_fixed"), "_city_filled", "_source_file", "_bronze_ingest_date", F.to_date("_at").alias("requested_date"),
    ]
    return _routed(tagged, raw.columns, valid, corrupt, duplicates)


def clean_customer_activity(raw: DataFrame, customers: DataFrame) -> Triple:
    """(valid activity, rejected raw rows with _reason, one row ``duplicates``).

    Of rows with one customer and date the newest partition's, then page's, stays. page_views and device may be missing.
    Rules in order: missing_required_field, invalid_date, invalid_number, negative_sessions, negative_count,
    unparseable_timestamp, unknown_customer.
    """
    good, corrupt = split_corrupt(raw)
    latest, duplicates = _deduplicated(good, ["customer_unique_id", "activity_date"], [F.desc("_bronze_ingest_date"), F.desc("_page"), F.desc("_source_file")])
    counts = ["sessions", "page_views", "cart_adds", "support_tickets"]
    kept = with_exists(latest.withColumn("_raw", F.struct(*raw.columns)), customers, ["customer_unique_id"])
    fixed = kept.withColumns({f"_{c}": lenient_int(c) for c in counts} | {"_day": F.try_to_date("activity_date", "yyyy-MM-dd"), "_at": parse_first("last_seen_at", ISO_TIME, LOCAL_TIME)})
    any_of = lambda found: F.greatest(*found)  # noqa: E731  of booleans: whether one is true, nulls aside
    required = [F.col(c).isNull() for c in ("customer_unique_id", "activity_date", "sessions")]
    tagged = tag(fixed, [
        ("missing_required_field", any_of(required)),
        ("invalid_date", F.col("_day").isNull()),
        ("invalid_number", any_of([F.col(c).isNotNull() & F.col(f"_{c}").isNull() for c in counts])),
        ("negative_sessions", F.col("_sessions") < 0),
        ("negative_count", any_of([F.coalesce(F.col(f"_{c}") < 0, F.lit(False)) for c in counts[1:]])),
        ("unparseable_timestamp", F.col("last_seen_at").isNotNull() & F.col("_at").isNull()),
        ("unknown_customer", ~F.col("_known")),
    ])
    valid = [
        "customer_unique_id", *[F.col(f"_{c}").alias(c) for c in counts], F.col("_at").alias("last_seen_at"), "device",
        F.coalesce(F.col("last_seen_at").rlike(r"^\d{2}/"), F.lit(False)).alias("_timestamp_reformatted"), "_page", "_source_file", "_bronze_ingest_date", F.col("_day").alias("activity_date"),
    ]
    return _routed(tagged, raw.columns, valid, corrupt, duplicates)


def build_geolocation(raw: DataFrame) -> DataFrame:
    """Per zip code: exact medians of latitude and longitude, the most frequent city and state, and the source rows."""
    rows = raw.select(F.col("geolocation_zip_code_prefix").alias("zip_code_prefix"), F.col("geolocation_lat").alias("lat"), F.col("geolocation_lng").alias("lng"), F.col("geolocation_city").alias("city"), F.col("geolocation_state").alias("state"))
    middle = rows.groupBy("zip_code_prefix").agg(F.median("lat").alias("lat"), F.median("lng").alias("lng"), F.count("*").alias("source_rows"))
    out = middle.join(mode_per_key(rows, ["zip_code_prefix"], "city"), "zip_code_prefix").join(mode_per_key(rows, ["zip_code_prefix"], "state"), "zip_code_prefix")
    return out.select("zip_code_prefix", "lat", "lng", "city", "state", "source_rows")


def build_products(raw: DataFrame, translation: DataFrame, extra: Mapping[str, str] = EXTRA_CATEGORIES) -> DataFrame:
    """Products with their English category: the translation, else an extra entry, else ``unknown``; a missing category is
    unknown too. Misspelt column names of the source are put right."""
    named = translation.select("product_category_name", F.col("product_category_name_english").alias("_english"))
    more = F.element_at(F.create_map(*[F.lit(x) for pair in extra.items() for x in pair]), F.col("product_category_name"))
    joined = lookup(raw, named, ["product_category_name"])
    return joined.select(
        "product_id", F.coalesce("product_category_name", F.lit(UNKNOWN_CATEGORY)).alias("product_category_name"),
        F.coalesce("_english", more, F.lit(UNKNOWN_CATEGORY)).alias("product_category_name_english"),
        F.col("product_name_lenght").alias("product_name_length"), F.col("product_description_lenght").alias("product_description_length"), "product_photos_qty",
        "product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm",
    )


def tag_customers(latest: DataFrame) -> DataFrame:
    return tag(latest, [("missing_required_field", F.col("customer_id").isNull() | F.col("customer_unique_id").isNull() | F.col("customer_state").isNull())])


def tag_orders(latest: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders with the day of purchase; without a known customer they are orphans."""
    found = with_exists(latest, customers, ["customer_id"]).withColumn("order_purchase_date", F.to_date("order_purchase_timestamp"))
    missing = F.col("order_id").isNull() | F.col("customer_id").isNull() | F.col("order_status").isNull() | F.col("order_purchase_timestamp").isNull()
    return tag(found, [("missing_required_field", missing), ("orphan_customer", ~F.col("_known"))]).drop("_known")


def tag_order_children(latest: DataFrame, orders: DataFrame, keys: list[str]) -> DataFrame:
    """Items or payments with the day of purchase of their order; without one they are orphans."""
    days = orders.select("order_id", F.to_date("order_purchase_timestamp").alias("order_purchase_date"))
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    return tag(lookup(latest, days, ["order_id"]), [("missing_required_field", missing), ("orphan_order", F.col("order_purchase_date").isNull())])


def tag_reviews(latest: DataFrame, orders: DataFrame) -> DataFrame:
    found = with_exists(latest, orders, ["order_id"]).withColumn("review_date", F.to_date("review_creation_date"))
    missing = F.col("review_id").isNull() | F.col("order_id").isNull() | F.col("review_creation_date").isNull()
    return tag(found, [("missing_required_field", missing), ("orphan_order", ~F.col("_known"))]).drop("_known")


def add_row_metadata(df: DataFrame, batch_date: Column, processed_at: Column) -> DataFrame:
    """_batch_date, _first_batch_date and _processed_at of rows that this batch writes."""
    return df.withColumns({"_batch_date": batch_date.cast("date"), "_first_batch_date": batch_date.cast("date"), "_processed_at": processed_at.cast("timestamp")})


def merge_versions(new: DataFrame, existing: DataFrame | None, keys: list[str], order: list[Column]) -> DataFrame:
    """New rows over existing ones: the latest of each key, with the earliest first batch of its versions."""
    both = new if existing is None else existing.select(*new.columns).unionByName(new)
    return latest_per_key(both.withColumn("_first_batch_date", F.min("_first_batch_date").over(Window.partitionBy(*keys))), keys, order)
