"""Header detection and mapping to the canonical fields, for batches of uploads.

An upload is identified by ``upload_id``; its headers are rows (upload_id, position,
header) and its values rows (upload_id, position, row order, value as text).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark import schema
from riskspark.functions.columns import normalise_header, parse_time, slug, strip, to_double
from riskspark.functions.similarity import best_alias
from riskspark.operators.ordering import first_per_key

# Confidences and acceptance limits.
EXACT, HIGH, MEDIUM = 0.95, 0.85, 0.60
SAVED_MATCH = 0.7


def normalised(headers: DataFrame) -> DataFrame:
    return headers.withColumn("norm", normalise_header(F.col("header")))


def exact_matches(headers: DataFrame) -> DataFrame:
    """Adds ``exact``: the field whose alias the header is, or null."""
    table = headers.sparkSession.createDataFrame(schema.aliases(), "norm string, exact string")
    # the alias table is a constant of the program
    return normalised(headers).join(F.broadcast(table), "norm", "left")


def fuzzy_matches(headers: DataFrame) -> DataFrame:
    """Adds ``fuzzy`` and ``fuzzy_score``: the closest alias, null below 0.60.

    Each distinct normalised header is scored once, against all aliases in one call.
    """
    named = normalised(headers) if "norm" not in headers.columns else headers
    match = F.pandas_udf(best_alias, "field string, score double")
    scored = named.select("norm").distinct().withColumn("m", match("norm")).select(
        "norm", F.col("m.field").alias("fuzzy"), F.col("m.score").alias("fuzzy_score")
    ).filter(F.col("fuzzy_score") >= MEDIUM)
    return named.join(scored, "norm", "left")


_DOMAINS = {
    "transport": schema.TRANSPORT_MODES,
    "inspection": schema.INSPECTION_VALUES,
    "shipment": schema.SHIPMENT_STATUSES,
}


_FLAG = 32


def _may_be_number(text: Column) -> Column:
    """False for texts that no number is written like. A failed cast costs an exception."""
    never = F.rlike(text, F.lit("(?i)[g-oq-wyz/:,]|[0-9][-+]"))  # hexadecimal numbers have the other letters
    return ~never | F.rlike(text, F.lit("(?i)inf|nan"))


def profile(values: DataFrame) -> DataFrame:
    """Facts about each column (upload_id, position) that inference needs, over all its values.

    values: upload_id, position, value. One combinable aggregate; distinct values are not
    collected: a column fits a domain when no value lies outside and the values seen, kept as one
    bit each, are at least two. A number is in no domain and is no date, so only other values
    are compared and parsed.
    """
    v = F.col("value")
    # per known word: one bit for the word and, from _FLAG on, one bit per domain it is in
    codes: dict[str, int] = {}
    masks = {}
    start = 0
    for i, (name, domain) in enumerate(_DOMAINS.items()):
        for j, known in enumerate(domain):
            codes[known] = codes.get(known, 0) | 1 << (start + j) | 1 << (_FLAG + i)
        masks[name] = ((1 << len(domain)) - 1) << start
        start += len(domain)
    table = F.create_map(*[F.lit(x) for known, code in codes.items() for x in (known, F.lit(code).cast("bigint"))])
    read = values.select("upload_id", "position", "value", F.when(_may_be_number(v), to_double(v)).alias("number"))
    read = read.withColumn("word", F.when(F.col("number").isNull(), strip(F.lower(v))))
    # one hashed test turns away values of no domain
    code = F.when(v.isNotNull(), F.when(F.col("word").isin(list(codes)), F.element_at(table, F.col("word")))
                  .otherwise(F.lit(0).cast("bigint")))
    time = F.when(F.col("word").isNotNull() & F.rlike("word", F.lit("[0-9]")), parse_time(v))
    facts = read.withColumns({"code": code, "time": time}).groupBy("upload_id", "position").agg(
        F.count(v).alias("filled"),
        F.count("number").alias("numbers"),
        F.min("number").alias("low"),
        F.max("number").alias("high"),
        F.stddev_samp("number").alias("std"),
        (F.count("time") / F.count(v)).alias("date_share"),
        F.coalesce(F.bit_and("code"), F.lit(0)).alias("common"),
        F.coalesce(F.bit_or("code"), F.lit(0)).alias("seen"),
    )
    per_domain = {}
    for i, name in enumerate(_DOMAINS):
        per_domain[f"{name}_only"] = F.col("common").bitwiseAND(F.lit(1 << (_FLAG + i))) != 0
        per_domain[f"{name}_seen"] = F.bit_count(F.col("seen").bitwiseAND(F.lit(masks[name])))
    return facts.withColumns(per_domain).drop("common", "seen")


def _hint(norm: Column, words: list[str]) -> Column:
    return norm.rlike("|".join(words))


def inferred(profiled: DataFrame) -> DataFrame:
    """Adds ``inferred`` (field), ``inferred_score`` and ``inferred_transform`` from a profile
    that carries the normalised header ``norm``."""
    low, high, std, norm = F.col("low"), F.col("high"), F.col("std"), F.col("norm")
    enough, numeric = F.col("filled") >= 3, F.col("numbers") >= 3
    text = F.col("filled") > F.col("numbers")

    def domain(name: str) -> Column:
        return enough & F.col(f"{name}_only") & (F.col(f"{name}_seen") >= 2)

    def result(field: str, score: float, transform: str = "direct") -> Column:
        return F.struct(F.lit(field).alias("field"), F.lit(score).alias("score"),
                        F.lit(transform).alias("transform"))

    percent = numeric & (low >= 0) & (high <= 100) & (std < 20) & (high > 1)
    large = numeric & (low >= 0) & (high > 10_000)
    short = numeric & (low >= 0) & (high <= 365) & (std < 30)
    found = (
        F.when(domain("transport"), result("transportation_mode", 0.92))
        .when(domain("inspection"), result("inspection_status", 0.92))
        .when(domain("shipment"), result("shipment_status", 0.90))
        .when(numeric & (low >= 0) & (high <= 1) & (high > 0), result("defect_rate", 0.80))
        .when(
            percent & _hint(norm, ["defect", "reject", "fail", "quality", "error", "rate"]),
            result("defect_rate", 0.75, "divide_by_100"))
        .when(large & _hint(norm, ["revenue", "sales", "income", "earning"]), result("revenue", 0.70))
        .when(
            large & _hint(norm, ["transport", "shipping", "freight", "logistics"]),
            result("transportation_cost", 0.70))
        .when(large & _hint(norm, ["manufactur", "production", "unit cost"]), result("manufacturing_cost", 0.70))
        .when(short & _hint(norm, ["lead", "lt"]), result("lead_time_days", 0.70))
        .when(short & _hint(norm, ["delay", "late", "overdue"]), result("delivery_delay_days", 0.70))
        .when(text & (F.col("date_share") > 0.8), result("timestamp", 0.85, "date_parse"))
    )
    return profiled.withColumn("_found", found).select(
        "*",
        F.col("_found.field").alias("inferred"),
        F.col("_found.score").alias("inferred_score"),
        F.col("_found.transform").alias("inferred_transform"),
    ).drop("_found")


def combine(df: DataFrame) -> DataFrame:
    """Adds ``field``, ``confidence``, ``transform``, ``layer`` from exact, fuzzy and inferred votes."""
    both = F.col("fuzzy").isNotNull() & F.col("inferred").isNotNull()
    agree = both & (F.col("fuzzy") == F.col("inferred"))
    use_inferred = F.col("inferred").isNotNull() & (F.col("fuzzy").isNull() | (F.col("inferred_score") >= HIGH))
    boosted = F.least(F.greatest("inferred_score", "fuzzy_score") + 0.05, F.lit(1.0))

    def pick(exact: Column, agreed: Column, inferred_: Column, fuzzy: Column) -> Column:
        return (
            F.when(F.col("exact").isNotNull(), exact).when(agree, agreed).when(use_inferred, inferred_)
            .when(F.col("fuzzy").isNotNull(), fuzzy)
        )

    inf, fuz = F.col("inferred"), F.col("fuzzy")
    return df.withColumns(
        {
            "field": pick(F.col("exact"), inf, inf, fuz),
            "confidence": pick(F.lit(EXACT), boosted, F.col("inferred_score"), F.col("fuzzy_score")),
            "transform": pick(
                F.lit("direct"), F.col("inferred_transform"), F.col("inferred_transform"), F.lit("direct")),
            "layer": pick(F.lit("exact"), F.lit("fuzzy+dtype"), F.lit("dtype"), F.lit("fuzzy")),
        }
    )


def assign(votes: DataFrame) -> DataFrame:
    """One source column per field and upload: highest confidence, then first column."""
    return first_per_key(
        votes.filter(F.col("field").isNotNull()), ["upload_id", "field"], [F.col("confidence").desc(), "position"])


def mapping_report(uploads: DataFrame, assigned: DataFrame) -> DataFrame:
    """All 23 fields for every upload, with defaults for the unmapped ones."""
    every = uploads.select("upload_id").distinct().withColumn(
        "f", F.explode(F.array(*[F.struct(F.lit(i).alias("field_no"), F.lit(n).alias("field"),
                                          F.lit(r).alias("required"))
                                 for i, (n, _, r) in enumerate(schema.CANONICAL)])))
    return every.select("upload_id", "f.*").join(
        assigned.select("upload_id", "field", "header", "confidence", "transform", "layer"),
        ["upload_id", "field"], "left",
    ).select(
        "upload_id", "field_no", "field", "required",
        F.col("header").alias("source_column"),
        F.coalesce("transform", F.lit("derive")).alias("transform"),
        F.when(F.col("header").isNull(), "use_default").alias("derive_formula"),
        F.round(F.coalesce("confidence", F.lit(0.0)), 3).alias("confidence"),
        F.coalesce("layer", F.lit("none")).alias("match_layer"),
    )


def mapping_notes(report: DataFrame) -> DataFrame:
    """Per upload: mapped fields, missing required fields in declaration order, a note."""
    mapped = F.col("source_column").isNotNull()
    gone = F.collect_list(F.when(~mapped & F.col("required"), F.struct("field_no", "field")))
    by = report.groupBy("upload_id").agg(F.count_if(mapped).alias("mapped"), F.array_sort(gone).alias("g"))
    missing = F.array_join(F.transform("g", lambda x: x["field"]), ", ")
    return by.select(
        "upload_id",
        "mapped",
        missing.alias("missing_fields"),
        F.concat(
            F.lit("Rule-based detection: "), F.col("mapped").cast("string"),
            F.lit(f"/{len(schema.FIELDS)} fields mapped. "),
            F.when(missing == "", "All required fields found.").otherwise(
                F.concat(F.lit("Missing required fields: "), missing, F.lit("."))),
        ).alias("notes"),
    )


def detect(headers: DataFrame, values: DataFrame) -> DataFrame:
    """Votes for every source column: exact, else fuzzy combined with inference."""
    named = exact_matches(headers)
    votes = fuzzy_matches(named)
    return combine(inferred(votes.join(profile(values), ["upload_id", "position"], "left")))


def detect_frame(raw: DataFrame, order: list[str], sample_rows: int | None = None) -> DataFrame:
    """Mapping report of one frame from all its rows, or from the first ``sample_rows`` if asked."""
    spark = raw.sparkSession
    columns = [c for c in raw.columns if c not in order]
    headers = spark.createDataFrame(
        [("frame", i, c) for i, c in enumerate(columns)], "upload_id string, position int, header string")
    sample = raw.orderBy(*order).limit(sample_rows) if sample_rows else raw
    cells = F.array(*[F.struct(F.lit(i).alias("position"), F.col(f"`{c}`").cast("string").alias("value"))
                      for i, c in enumerate(columns)])
    values = sample.select(F.lit("frame").alias("upload_id"), F.inline(cells))
    return mapping_report(headers, assign(detect(headers, values)))


# --- applying a mapping ----------------------------------------------------------


def transformed(c: Column, transform: str) -> Column:
    text = c.cast("string")
    if transform == "divide_by_100":
        return to_double(text) / 100.0
    if transform == "negate":
        return -to_double(text)
    if transform == "date_parse":
        return F.date_format(parse_time(text), "yyyy-MM-dd HH:mm:ss")
    if transform == "slugify":
        return slug(text)
    return c


def apply_mapping(raw: DataFrame, mapping: dict[str, dict], keep: list[str] | None = None) -> DataFrame:
    """Canonical frame: {field: {source_column, transform}}. Source columns are carried along as
    ``_raw_<name>`` unless their name is a mapped field; ``keep`` passes through unchanged."""
    keep = keep or []
    out = []
    for field, spec in mapping.items():
        if field not in schema.FIELD_TYPES:
            continue
        source = spec.get("source_column")
        if source and source in raw.columns:
            out.append(transformed(F.col(f"`{source}`"), spec.get("transform", "direct")).alias(field))
        else:
            out.append(F.lit(None).cast(schema.FIELD_TYPES[field]).alias(field))
    carried = [
        F.col(f"`{c}`").alias(f"_raw_{c}")
        for c in raw.columns
        if c not in keep and not (c in mapping and c in schema.FIELD_TYPES)
    ]
    return raw.select(*keep, *out, *carried)


def mapping_from_report(report: DataFrame) -> dict[str, dict]:
    """The 23 rows of one upload's report as the argument of ``apply_mapping``."""
    return {
        r.field: {"source_column": r.source_column, "transform": r.transform, "confidence": r.confidence}
        for r in report.orderBy("field_no").collect()
    }


def upload_key(header: Column) -> Column:
    return F.replace(F.replace(F.lower(header), F.lit(" "), F.lit("_")), F.lit("_"), F.lit(""))


def pipeline_headers(headers: DataFrame) -> DataFrame:
    """Adds ``pipeline_name`` for headers of the fixed upload layout."""
    table = headers.sparkSession.createDataFrame(
        list(schema.UPLOAD_HEADERS.items()), "key string, pipeline_name string")
    return headers.withColumn("key", upload_key(F.col("header"))).join(F.broadcast(table), "key", "left").drop("key")


def rename_upload(df: DataFrame) -> DataFrame:
    names = {}
    for c in df.columns:
        key = c.lower().replace(" ", "").replace("_", "")
        if key in schema.UPLOAD_HEADERS:
            names[c] = schema.UPLOAD_HEADERS[key]
    return df.withColumnsRenamed(names)


def missing_groups(headers: DataFrame) -> DataFrame:
    """(upload_id, missing_group) for every required group no header covers."""
    have = pipeline_headers(headers).groupBy("upload_id").agg(F.collect_set("pipeline_name").alias("have"))
    # at most one entry per pipeline column
    groups = F.array(*[F.struct(F.lit(g).alias("missing_group"), F.lit(p).alias("covered_by"))
                       for g, p in schema.UPLOAD_GROUPS.items()])
    return have.select("upload_id", "have", F.inline(groups)).filter(
        ~F.array_contains("have", F.col("covered_by"))).select("upload_id", "missing_group")


# --- saved mappings --------------------------------------------------------------


def header_sets(headers: DataFrame) -> DataFrame:
    """(upload_id, columns): the distinct headers of each upload, sorted."""
    return headers.groupBy("upload_id").agg(F.sort_array(F.collect_set("header")).alias("columns"))


def _rare_headers(sets: DataFrame, name: str, counts: DataFrame, threshold: float) -> DataFrame:
    """Of each set the headers that a set alike enough must share one of: its rarest n - ceil(t n) + 1."""
    ordered = F.array_sort(F.collect_list(F.struct("n", "header")))
    sized = (sets.select(name, F.explode(name).alias("header")).join(counts, "header")
             .groupBy(name).agg(ordered.alias("ordered")).withColumn(f"{name}_size", F.size("ordered")))
    # the margin keeps a product such as 0.7 * 10 from being rounded up past its value
    least = F.ceil(F.col(f"{name}_size") * threshold - 1e-9)
    rare = F.slice("ordered", 1, (F.col(f"{name}_size") - least + 1).cast("int"))
    return sized.select(name, f"{name}_size", F.explode(rare).alias("of")).select(name, f"{name}_size", "of.header")


def alike_candidates(up: DataFrame, saved: DataFrame, threshold: float) -> DataFrame:
    """(up, saved): pairs of the distinct header sets of two frames that may overlap by the threshold or
    more. Two sets of n and m headers that do share one of their rarest n - ceil(t n) + 1 and
    m - ceil(t m) + 1, in an order common to all, and neither is much longer; so a header that
    most sets have brings no pairs about."""
    both = up.select(F.explode("up").alias("header")).unionAll(saved.select(F.explode("saved").alias("header")))
    counts = both.groupBy("header").agg(F.count("*").alias("n"))
    pairs = _rare_headers(up, "up", counts, threshold).join(_rare_headers(saved, "saved", counts, threshold), "header")
    near = ((F.col("up_size") >= F.col("saved_size") * threshold - 1e-9)
            & (F.col("saved_size") >= F.col("up_size") * threshold - 1e-9))
    return pairs.filter(near).select("up", "saved").distinct()


def match_saved(uploads: DataFrame, registry: DataFrame, threshold: float = SAVED_MATCH) -> DataFrame:
    """(upload_id, company_id, overlap): the most recently used mapping whose headers overlap
    by more than the threshold.

    uploads: upload_id, columns; registry: company_id, source_columns, last_used_at.
    Uploads and mappings with equal header sets are handled once, and only sets that share
    a rare header are compared.
    """
    up = uploads.select("upload_id", F.sort_array(F.array_distinct("columns")).alias("up"))
    saved = registry.select(
        F.sort_array(F.array_distinct("source_columns")).alias("saved"), "last_used_at", "company_id")
    newest = saved.groupBy("saved").agg(
        F.max_by(F.struct("last_used_at", "company_id"), F.struct("last_used_at", "company_id")).alias("m"))
    shared = alike_candidates(up.select("up").distinct(), newest.select("saved"), threshold).withColumn(
        "both", F.size(F.array_intersect("up", "saved")))
    overlap = F.col("both") / (F.size("up") + F.size("saved") - F.col("both"))
    close = shared.withColumn("overlap", overlap).filter(F.col("overlap") > threshold)
    best = close.join(newest, "saved").groupBy("up").agg(
        F.max_by(F.struct("m.company_id", "overlap"), F.struct("m.last_used_at", "m.company_id")).alias("b"))
    return up.join(best, "up").select("upload_id", "b.company_id", "b.overlap")


def save_mappings(registry: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by company; a known company keeps its id and creation time."""
    o, n = registry.alias("o"), new.alias("n")
    kept = ["id", "created_at"]
    return o.join(n, "company_id", "full_outer").select(
        *[
            F.col(c) if c == "company_id"
            else F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c) if c in kept
            else F.when(F.col("n.id").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
            for c in registry.columns
        ]
    )


def get_mapping(registry: DataFrame, company_id: str) -> DataFrame:
    return registry.filter(F.col("company_id") == company_id)


def touch_mapping(registry: DataFrame, company_id: str, now: datetime) -> DataFrame:
    used = F.when(F.col("company_id") == company_id, F.lit(now).cast("timestamp_ntz"))
    return registry.withColumn("last_used_at", F.coalesce(used, F.col("last_used_at")))


def list_mappings(registry: DataFrame) -> DataFrame:
    return registry.orderBy(F.col("last_used_at").desc(), "company_id")


def delete_mapping(registry: DataFrame, mapping_id: str) -> DataFrame:
    return registry.filter(F.col("id") != mapping_id)
