"""The generic operators over the given tables, each over whole tables."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from careerline.functions import (
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
from careerline.operators import (
    as_role,
    cohort_pairs,
    counts_up_to_point,
    head_to_head,
    keep_first,
    ordered_list,
    quality,
    running_totals,
    small_side,
    trailing_upsert,
    two_sided,
    with_positions,
)
from careerline.sources import ingest
from careerline.sources.files import discover, file_prints
from careerline.sources.records import read_quoted_csv
from registry.feed import feed_for


def _given(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return feed_for(spark, sf_dir).given(table)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _given(spark, sf_dir, "orders")
    return orders.withColumn("o_orderdate", F.col("o_orderdate").cast("date"))


def _cents(amount: str) -> Column:
    return F.round(F.col(amount) * 100).cast("long")


def _day_text(date: str) -> Column:
    return F.date_format(date, "yyyyMMdd")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem without its repeated (order, line) rows."""
    items = _given(spark, sf_dir, "lineitem")
    order = ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
             "l_tax", "l_returnflag", "l_linestatus")
    return keep_first(
        items, ["l_orderkey", "l_linenumber"], [F.col(c).asc_nulls_last() for c in order]
    )


def _trades(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    """Every line from the buying and from the selling nation's side."""
    orders = _given(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    buyers = as_role(
        _given(spark, sf_dir, "customer"), {"o_custkey": "c_custkey", "buyer": "c_nationkey"}
    )
    sellers = as_role(
        _given(spark, sf_dir, "supplier"), {"l_suppkey": "s_suppkey", "seller": "s_nationkey"}
    )
    deals = (
        lines.withColumnRenamed("l_orderkey", "o_orderkey")
        .join(orders, "o_orderkey")
        .join(buyers, "o_custkey")
        .join(sellers, "l_suppkey")
        .withColumn("trade_id", joined_key("o_orderkey", "l_linenumber"))
    )
    return two_sided(
        deals,
        common=["trade_id", "l_quantity", "l_returnflag"],
        first={"nation": "buyer", "partner": "seller"},
        second={"nation": "seller", "partner": "buyer"},
        flag="is_buyer",
    )


def keep_first_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).withColumn("l_shipdate", F.col("l_shipdate").cast("date"))


def keep_best_rank_per_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's dearest order of every month."""
    monthly = _orders(spark, sf_dir).withColumn("month", F.date_format("o_orderdate", "yyyyMM"))
    order = [F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey").asc_nulls_last()]
    best = keep_first(monthly, ["month", "o_custkey"], order)
    return best.select("month", "o_custkey", "o_orderkey", "o_totalprice")


def two_sided_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trades(spark, sf_dir, _lines(spark, sf_dir))


def trade_balance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the de-duplication, repeated lines do not have one buyer and one seller."""
    trades = _trades(spark, sf_dir, _given(spark, sf_dir, "lineitem"))
    return quality.one_of_each(trades, "trade_id", "is_buyer")


def tenure_at_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders by years since their first order, with running totals.

    Orders are summed per customer and day before any window, so a window walks through days.
    """
    daily = (
        _orders(spark, sf_dir)
        .groupBy("o_custkey", "o_orderdate")
        .agg(F.count("*").alias("orders"), F.sum(_cents("o_totalprice")).alias("cents"))
    )
    first = F.min("o_orderdate").over(Window.partitionBy("o_custkey"))
    by_year = (
        daily.withColumn("tenure_year", age_year(years_between(first, "o_orderdate")))
        .groupBy("o_custkey", "tenure_year")
        .agg(F.sum("orders").alias("orders"), F.sum("cents").alias("cents"))
    )
    return running_totals(
        by_year,
        ["o_custkey"],
        [F.col("tenure_year").asc_nulls_last()],
        {"cum_orders": F.col("orders"), "cum_cents": F.col("cents")},
    )


def conditional_counts_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent and open orders per market segment, counted per customer before the join."""
    per_customer = (
        _given(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(
            F.count("*").alias("orders"),
            F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
            F.count_if(F.col("o_orderstatus") == "O").alias("open"),
        )
    )
    return (
        _given(spark, sf_dir, "customer")
        .join(per_customer, "c_custkey")
        .groupBy("c_mktsegment")
        .agg(*[F.sum(c).alias(c) for c in ("orders", "urgent", "open")])
        .withColumn("urgent_share", ratio("urgent", "orders", 4))
    )


def same_tenure_pace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of Asian nations up to their dearest order, next to European ones at that point."""
    customers = _given(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = _orders(spark, sf_dir).join(
        customers.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey"
    )
    dearest = F.max_by("o_orderdate", F.struct("o_totalprice", "o_orderkey"))
    starts = orders.groupBy("c_nationkey").agg(
        F.min("o_orderdate").alias("first_day"), dearest.alias("dear_day")
    )
    regions = _given(spark, sf_dir, "region")
    members = (
        _given(spark, sf_dir, "nation")
        .join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
        .join(starts, F.col("n_nationkey") == F.col("c_nationkey"))
        .select(
            "n_nationkey",
            "n_name",
            "r_name",
            "first_day",
            F.datediff("dear_day", "first_day").alias("tenure"),
        )
    )
    pairs = cohort_pairs(
        members,
        "r_name",
        [("ASIA", "EUROPE")],
        anchor={"anchor": "n_name", "tenure": "tenure"},
        compared={"nation": "n_nationkey", "name": "n_name", "first_day": "first_day"},
    )
    events = orders.select(
        F.col("c_nationkey").alias("nation"),
        "o_orderdate",
        (F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
    )
    limits = pairs.withColumn("last_day", F.date_add("first_day", F.col("tenure")))
    return counts_up_to_point(
        limits,
        _given(spark, sf_dir, "nation").count() ** 2,
        events,
        key="nation",
        point="o_orderdate",
        limit="last_day",
        counts={"orders": F.lit(True), "urgent": F.col("urgent")},
    ).select("anchor", "tenure", "name", "orders", "urgent")


def nation_head_to_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade lines between African and American nations."""
    nation, region = (_given(spark, sf_dir, t) for t in ("nation", "region"))
    nation_rows = nation.count()
    same_region = F.col("n_regionkey") == F.col("r_regionkey")
    nations = nation.join(small_side(region, region.count()), same_region)
    returned, bought = F.col("l_returnflag") == "R", F.col("is_buyer")
    return head_to_head(
        two_sided_trade(spark, sf_dir),
        as_role(
            nations.where(F.col("r_name") == "AFRICA"), {"nation": "n_nationkey", "own": "n_name"}
        ),
        nation_rows,
        "nation",
        as_role(
            nations.where(F.col("r_name") == "AMERICA"),
            {"partner": "n_nationkey", "other": "n_name"},
        ),
        nation_rows,
        "partner",
        group=["own", "other"],
        counts={"lines": F.lit(True), "bought": bought, "returned": returned & bought},
    ).withColumn("bought_share", ratio("bought", "lines", 3))


def ordered_list_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user and day the kinds of events in order of appearance.

    Events are counted per kind first: the lists hold kinds, not events.
    """
    kinds = (
        _given(spark, sf_dir, "events")
        .groupBy("user_id", F.col("ts").cast("date").alias("day"), "event_type")
        .agg(F.count("*").alias("n"), F.min("ts").alias("since"))
        .withColumn("label", F.format_string("%s (%d)", "event_type", "n"))
    )
    return kinds.groupBy("user_id", "day").agg(
        F.count("*").alias("kinds"), ordered_list("label", "since", "event_type").alias("trail")
    )


def trailing_365_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders after a late load: priorities corrected since, cancelled ones gone from the source."""
    now = _orders(spark, sf_dir).select("o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    known = now.where(F.col("o_orderdate") <= F.lit(datetime.date(2001, 3, 31)))
    target = known.withColumn("o_orderpriority", F.lit("unknown"))
    source = now.where(F.col("o_orderstatus") != "P")
    return trailing_upsert(target, source, "o_orderkey", "o_orderdate", days=365)


def _season_file(date: str) -> Column:
    return F.concat(F.lit("atp_matches_"), F.year(date).cast("string"), F.lit(".csv"))


#: Order keys per text file of orders.
ORDERS_PER_FILE = 20_000


def _order_files(spark: SparkSession, sf_dir: str, corrected: bool) -> DataFrame:
    """Prints of real text files, one for every 20,000 order keys, a line per order.

    Before the correction some files have other lines, and some are not there yet.
    """
    number = F.floor(F.col("o_orderkey") / ORDERS_PER_FILE)
    priority = F.col("o_orderpriority")
    orders = _orders(spark, sf_dir).withColumn("number", number)
    if not corrected:
        orders = orders.where("number % 5 <> 4")
        priority = F.when(F.col("number") % 3 == 1, F.lit("unknown")).otherwise(priority)
    line = F.concat_ws(",", "o_orderkey", "o_custkey", priority)
    folder = f"{feed_for(spark, sf_dir).folder}/order_files-{uuid.uuid4().hex}"
    (
        orders.select("number", "o_orderkey", line.alias("line"))
        .repartition("number")
        .sortWithinPartitions("number", "o_orderkey")
        .select("number", "line")
        .write.partitionBy("number")
        .text(folder)
    )
    name = F.concat(F.lit("orders_"), F.regexp_extract("path", r"number=(\d+)", 1), F.lit(".csv"))
    return file_prints(spark, [folder]).select(name.alias("source_file"), "file_hash")


def file_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_files(spark, sf_dir, corrected=True)


def _load_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Today's files against the manifest of a load before a correction."""
    today = _order_files(spark, sf_dir, corrected=True)
    return ingest.plan_load(today, _order_files(spark, sf_dir, corrected=False))


def load_plan_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _load_plan(spark, sf_dir).select("source_file", "outcome")


def load_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.summarise(_load_plan(spark, sf_dir))


def _name_in_folder(path: Column) -> Column:
    """The name of a file that a partitioned write has put into a folder of that name."""
    return F.regexp_extract(path, "source_file=([^/]+)", 1)


def _written_files(spark: SparkSession, sf_dir: str, frame: DataFrame) -> str:
    """The folder with one CSV file per ``source_file`` of ``frame``, a line for each of its rows."""
    folder = f"{feed_for(spark, sf_dir).folder}/named_files-{uuid.uuid4().hex}"
    lines = frame.repartition("source_file")
    lines.write.partitionBy("source_file").csv(folder)
    return folder


def _lines_per_file(spark: SparkSession, folder: str) -> DataFrame:
    path = F.col("_metadata.file_path")
    lines = spark.read.option("recursiveFileLookup", "true").text(folder)
    return lines.groupBy(_name_in_folder(path).alias("source_file")).agg(F.count("*").alias("n"))


def manifest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts of written files: those until 2000, with 2000 and later written and counted again."""
    orders = _orders(spark, sf_dir)
    year = F.year("o_orderdate")

    def counted(part: DataFrame, day: str) -> DataFrame:
        files = part.select("o_orderkey", "o_custkey", _season_file("o_orderdate").alias("source_file"))
        rows = _lines_per_file(spark, _written_files(spark, sf_dir, files))
        return rows.select("source_file", F.col("n").alias("row_count"), F.lit(day).alias("loaded"))

    old = counted(orders.where((year <= 2000) & (F.col("o_orderstatus") != "P")), "before")
    return ingest.upsert_manifest(old, counted(orders.where(year >= 2000), "now"))


def classified_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files of a folder: the recognised ones from 1998 on, with their entity and lines."""
    year = F.year("o_orderdate").cast("string")
    decade = F.concat(F.substring(year, 3, 1), F.lit("0s"))
    status = F.col("o_orderstatus")
    name = (
        F.when(status == "O", F.concat(F.lit("atp_matches_"), year, F.lit(".csv")))
        .when(status == "F", F.concat(F.lit("atp_rankings_"), decade, F.lit(".csv")))
        .when(F.col("o_orderpriority") == "1-URGENT", F.lit("atp_players.csv"))
        .otherwise(F.concat(F.lit("atp_matches_doubles_"), year, F.lit(".csv")))
    )
    folder = _written_files(spark, sf_dir, _orders(spark, sf_dir).select("o_orderkey", "o_custkey", name.alias("source_file")))
    found = discover(spark, folder, 1998, _name_in_folder).select("source_file", "entity")
    return found.join(_lines_per_file(spark, folder), "source_file")


def orders_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order with its place by priority, price and key."""
    order = [F.asc_nulls_last("o_orderpriority"), F.desc_nulls_last("o_totalprice"), F.asc_nulls_last("o_orderkey")]
    orders = _given(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    placed = with_positions(orders, order, feed_for(spark, sf_dir).keep)
    return placed.select("o_orderkey", "o_orderpriority", "position")


def insert_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Older orders without a status column, in another column order, appended to newer ones."""
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
    texts = _orders(spark, sf_dir).select(
        *[F.col(c).cast("string").alias(c) for c in columns], "o_orderdate"
    )
    cut = F.col("o_orderdate") < F.lit(datetime.date(1998, 1, 1))
    older = texts.where(cut).select("o_orderpriority", "o_custkey", "o_orderkey")
    newer = texts.where(~cut).select(*columns)
    return ingest.conform(newer, columns).unionByName(ingest.conform(older, columns))


def _documents_csv(spark: SparkSession, sf_dir: str) -> tuple[str, list[str]]:
    """The folder of all documents as CSV files, quotes and line ends included, and the columns."""
    documents = _given(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    folder = f"{feed_for(spark, sf_dir).folder}/documents_csv-{uuid.uuid4().hex}"
    (
        documents.write.option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(folder)
    )
    return folder, documents.columns


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as CSV and read back as text, each file as a whole, with length and digest of the text."""
    folder, columns = _documents_csv(spark, sf_dir)
    text = ingest.read_text_csv(spark, [folder], columns, whole=True, exact=True)
    return text.select(
        try_number("doc_id", "bigint").alias("doc_id"),
        "lang",
        "source",
        "text",
        F.length("text").cast("long").alias("n_chars"),
        F.md5("text").alias("text_md5"),
    )


def csv_round_trip_in_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as CSV and read back as text, the records put together by splits."""
    folder, columns = _documents_csv(spark, sf_dir)
    text = read_quoted_csv(spark, [folder], columns, "file_name").drop("file_name")
    return text.withColumn("doc_id", try_number("doc_id", "bigint"))


def text_typing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders turned to text, with blemishes by status, and typed again."""
    status, key = F.col("o_orderstatus"), F.col("o_orderkey").cast("string")
    number = (
        F.when(status == "F", F.concat(key, F.lit(".0")))
        .when(status == "P", F.concat(key, F.lit(".5")))
        .when(F.col("o_orderpriority") == "5-LOW", F.lit("n/a"))
        .when(F.col("o_orderpriority") == "2-HIGH", F.lit(""))
        .otherwise(F.concat(F.lit(" "), key, F.lit(" ")))
    )
    day = _day_text("o_orderdate")
    text = _orders(spark, sf_dir).select(
        "o_orderkey",
        number.alias("number"),
        day.alias("day"),
        F.when(status == "P", F.lit("19000000")).otherwise(day).alias("shaky_day"),
        F.when(status == "F", F.lit("")).otherwise(status).alias("status"),
        F.when(status == "O", F.col("o_orderpriority")).alias("priority"),
        "o_totalprice",
    )
    return text.select(
        "o_orderkey",
        try_number("number").alias("whole"),
        try_number("number", "bigint").alias("long_whole"),
        strict_date("day").alias("day"),
        lenient_date("shaky_day").alias("shaky_day"),
        blank_to_null("status").alias("status"),
        full_name("priority", blank_to_null("status")).alias("name"),
        joined_key("o_orderkey", "priority").alias("key"),
        mentions_any("priority", "urg", "LOW").alias("marked"),
        F.upper("priority").alias("upper_priority"),
        F.replace("priority", F.lit("LOW"), F.lit("Low")).alias("renamed"),
        half_away_round(F.col("o_totalprice") / 7, 2).alias("share"),
        F.date_format(strict_date("day"), "dd MMM yyyy").alias("label"),
        F.format_string("%+d", F.lit(50000) - F.col("o_orderkey")).alias("gap"),
    )


def null_logic_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language: a missing label is neither good nor bad."""
    labels = _given(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    documents = _given(spark, sf_dir, "documents").select("doc_id", "lang")
    flagged = documents.join(labels, "doc_id", "left").select(
        "lang",
        (F.col("quality") == 1).alias("good"),
        (F.col("quality") == 1).isNotNull().alias("labelled"),
        ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("usable"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic"),
        (~F.col("quality").eqNullSafe(1)).alias("kept"),
    )
    return flagged.groupBy("lang").agg(
        F.count("*").alias("documents"),
        F.count_if(F.col("good")).alias("good"),
        F.count_if(~F.col("good")).alias("bad"),
        F.count_if(F.col("labelled")).alias("labelled"),
        F.count_if(F.col("usable")).alias("usable"),
        F.count_if(F.col("toxic")).alias("toxic"),
        F.count_if(F.col("kept")).alias("kept"),
    )


def first_and_last_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's first and last event, from one aggregate; a missing time comes last."""
    events = _given(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    event = F.struct("event_id", "event_type")
    untimed = F.struct(F.col("ts").isNull(), "ts", "event_id")
    timed = F.struct(F.col("ts").isNotNull(), "ts", "event_id")
    ends = events.groupBy("user_id").agg(
        F.min_by(event, untimed).alias("first"), F.max_by(event, timed).alias("last")
    )
    return ends.select(
        "user_id",
        F.col("first.event_id").alias("first_event"),
        F.col("first.event_type").alias("first_type"),
        F.col("last.event_id").alias("last_event"),
        F.col("last.event_type").alias("last_type"),
    )


def era_split_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders since 1998: urgent ones, the others, and the share."""
    since = _orders(spark, sf_dir).where(
        F.col("o_orderdate") >= F.lit(datetime.date(1998, 1, 1))
    )
    return since.agg(
        F.count("*").alias("orders"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
        F.countDistinct("o_orderstatus").alias("states"),
        F.max("o_orderdate").alias("newest"),
    ).withColumn("urgent_share", ratio("urgent", "orders", 4))


def accepted_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return flags outside the accepted list."""
    return quality.accepted_values(_given(spark, sf_dir, "lineitem"), "l_returnflag", ["A", "N"])


def orphan_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' keys that are no supplier keys."""
    return quality.relationships(
        _given(spark, sf_dir, "orders"), "o_custkey", _given(spark, sf_dir, "supplier"), "s_suppkey"
    )


OPERATOR_QUERIES = {
    f.__name__: f
    for f in (
        keep_first_lineitem,
        keep_best_rank_per_period,
        two_sided_trade,
        trade_balance_check,
        tenure_at_order,
        conditional_counts_by_segment,
        same_tenure_pace,
        nation_head_to_head,
        ordered_list_per_group,
        trailing_365_upsert,
        file_fingerprints,
        load_plan_outcomes,
        load_summary,
        manifest_upsert,
        classified_files,
        orders_in_order,
        insert_by_name,
        csv_round_trip,
        csv_round_trip_in_splits,
        text_typing,
        null_logic_flags,
        first_and_last_per_group,
        era_split_share,
        accepted_flags,
        orphan_suppliers,
    )
}
