"""Registered queries: sources and sinks, mapping, derivation, validation, anomalies, documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskspark import schema
from riskspark.functions import rules
from riskspark.functions.columns import float_or, iso_time, text_or
from riskspark.operators import anomaly, derive, documents, incidents, mapping, retrieval, validate
from riskspark.operators.ordering import number_rows
from riskspark.plans import etl, frames, sql
from riskspark.plans.registry import query
from riskspark.plans.sql import oracle
from riskspark.session import landed, scratch_path
from riskspark.sources import files, store
from riskspark.sources import fixtures as fx

sql.define_uploads(fx.UPLOAD_HEADERS, fx.VALUE_HEADERS, schema.aliases())
R6 = lambda c: F.round(c, 6).alias(c)


# --- A: sources and sinks --------------------------------------------------------

_CSV = ["sku", "supplier_id", "inventory_level", "delivery_delay_days", "inspection_status", "timestamp"]


def _landed_csv(spark, sf, columns=None, ordered=False):
    path = scratch_path(spark, "csv")
    df = fx.canonical(spark, sf, columns or _CSV)
    # a range sort keeps the rows of consecutive files in row order
    df = df.orderBy("row_key") if ordered else df
    files.write_csv(df.drop("row_key"), path)
    return files.read_csv(spark, path)


@query("io_csv_scan", oracle("""
SELECT sku, supplier_id, inventory_level, delivery_delay_days, inspection_status, ts_text AS timestamp FROM canonical"""))
def io_csv_scan(spark, sf):
    raw = _landed_csv(spark, sf)
    return raw.select(
        "sku", "supplier_id", float_or(F.col("inventory_level")).alias("inventory_level"),
        float_or(F.col("delivery_delay_days")).alias("delivery_delay_days"), "inspection_status", "timestamp")


@query("io_csv_quoted", oracle("""
SELECT sku, 'first line' || chr(10) || 'the "second", ' || supplier_id AS note,
  CASE WHEN row_seq % 3 = 0 THEN NULL ELSE supplier_id END AS supplier_id FROM canonical"""))
def io_csv_quoted(spark, sf):
    """Cells with quoted line breaks, quotes and commas, and words that mean no value."""
    words = F.array(*[F.lit(w) for w in files.NULL_WORDS])
    gone = F.element_at(words, F.pmod(F.xxhash64("sku"), F.lit(len(files.NULL_WORDS))).cast("int") + 1)
    df = number_rows(fx.canonical(spark, sf, ["sku", "supplier_id"]), fx.ORDER).select(
        "sku", F.concat(F.lit('first line\nthe "second", '), "supplier_id").alias("note"),
        F.when(F.col("row_seq") % 3 == 0, gone).otherwise(F.col("supplier_id")).alias("supplier_id"))
    path = scratch_path(spark, "quoted")
    files.write_csv(df, path)
    return files.read_csv(spark, path).select("sku", "note", "supplier_id")


@query("io_profile_sample", oracle("SELECT sku, supplier_id FROM canonical ORDER BY row_seq LIMIT 200"))
def io_profile_sample(spark, sf):
    raw = _landed_csv(spark, sf, ordered=True)
    return files.sample(raw, files.FILE_ORDER).select("sku", "supplier_id")


@query("io_preview", oracle(f"""
SELECT sku, {sql.status('delivery_delay_days')} AS shipment_status, {sql.SEVERITY} AS severity, {sql.RISK} AS risk_score
FROM (SELECT * FROM canonical ORDER BY row_seq LIMIT 10), ({sql.STATS} (SELECT * FROM canonical ORDER BY row_seq LIMIT 10))"""))
def io_preview(spark, sf):
    columns = ["sku", "supplier_id", "inventory_level", "delivery_delay_days", "transportation_cost",
               "defect_rate", "timestamp"]
    raw = fx.canonical(spark, sf, columns)
    same = {c: {"source_column": c, "transform": "direct"} for c in columns}
    return etl.preview(raw, same, fx.AS_OF, fx.ORDER).select("sku", "shipment_status", "severity", "risk_score")


def _halves(df):
    """Closed lines as the loaded table, open lines as the new batch."""
    return df.filter(F.col("line_status") == "F"), df.filter(F.col("line_status") == "O")


def _formatted_with_status(spark, sf):
    return frames.formatted(spark, sf, ["line_status"])


_HALF_SUPPLIERS = f"""
SELECT supplier_id, name, region, category, CAST(printf('%.2f', avg_reliability) AS DOUBLE) AS reliability_score,
  CAST(printf('%.2f', avg_delay) AS DOUBLE) AS avg_delay_days, total AS active_orders, {sql.RISK_LEVEL} AS risk_level
FROM ({sql.SUPPLIER_AGG} WHERE l_linestatus = '{{}}' GROUP BY supplier_id)"""


@query("upsert_suppliers", oracle(f"""
SELECT supplier_id, coalesce(o.name, n.name) AS name, coalesce(o.region, n.region) AS region,
  coalesce(o.category, n.category) AS category, coalesce(n.reliability_score, o.reliability_score) AS reliability_score,
  coalesce(n.avg_delay_days, o.avg_delay_days) AS avg_delay_days,
  coalesce(n.active_orders, o.active_orders) AS active_orders, coalesce(n.risk_level, o.risk_level) AS risk_level
FROM ({_HALF_SUPPLIERS.format('F')}) o FULL JOIN ({_HALF_SUPPLIERS.format('O')}) n USING (supplier_id)"""))
def upsert_suppliers(spark, sf):
    old, new = (incidents.supplier_rows(h, fx.ORDER) for h in _halves(_formatted_with_status(spark, sf)))
    return incidents.upsert_suppliers(old, new).drop("id")


@query("upsert_incidents", oracle("""
SELECT incident_code, supplier_ref, severity, category, resolution_status FROM (
  SELECT sku AS incident_code, supplier_id AS supplier_ref, rule_severity AS severity, category, resolution_status
  FROM formatted QUALIFY row_number() OVER (PARTITION BY sku ORDER BY l_linestatus, row_seq) = 1)"""))
def upsert_incidents(spark, sf):
    old, new = (incidents.incident_rows(h, fx.ORDER) for h in _halves(_formatted_with_status(spark, sf)))
    return incidents.insert_new(old, new).select(
        "incident_code", "supplier_ref", "severity", "category", "resolution_status")


@query("upsert_documents", oracle("""
SELECT 'record_' || sku || '_' || supplier_id AS chunk_id, max(l_linestatus) AS status, 'record' AS chunk_type
FROM canonical GROUP BY 1"""))
def upsert_documents(spark, sf):
    df = fx.canonical(spark, sf, ["sku", "supplier_id", "line_status"])
    chunks = df.select(
        F.concat(F.lit("record_"), "sku", F.lit("_"), "supplier_id").alias("chunk_id"),
        F.col("line_status").alias("status"), "line_status", F.lit("record").alias("chunk_type"), "row_key")
    old, new = (h.drop("line_status") for h in _halves(chunks))
    # the batch brings each of its chunks twice, first as it was
    new = new.withColumn("pass", F.lit(2)).unionByName(new.withColumns({"pass": F.lit(1), "status": F.lit("old")}))
    home = store.Store(spark, scratch_path(spark, "chunks"))
    chunk_table = home.table("chunks", key="chunk_id", partition_by=("chunk_type",))
    for batch, order in ((old, ["row_key"]), (new, ["pass", "row_key"])):
        load = home.begin()
        load.write(chunk_table, incidents.latest(batch, "chunk_id", order).drop(*order))
        load.finish()
    return chunk_table.read().select("chunk_id", "status", "chunk_type")


@query("io_document_store", oracle("""
SELECT chunk_type, count(*) AS n, CAST(sum(chars) AS BIGINT) AS chars FROM (
  SELECT 'record' AS chunk_type, length(title) + length(description) AS chars FROM formatted
  UNION ALL SELECT 'supplier_summary', length(name) + length(region) FROM supplier_stats) GROUP BY chunk_type"""))
def io_document_store(spark, sf):
    df = frames.formatted(spark, sf)
    # one row per supplier, written first: its shuffles are gone when the texts are made
    s = landed(documents.supplier_stats(df, fx.ORDER), "supplier_stats")
    rows = df.select(F.concat("Title", "Description").alias("text"), F.lit("record").alias("chunk_type")).unionByName(
        s.select(F.concat("name", "region").alias("text"), F.lit("supplier_summary").alias("chunk_type")))
    home = store.Store(spark, scratch_path(spark, "store"))
    chunks, load = home.table("chunks", partition_by=("chunk_type",), writer=store.DENSE), home.begin()
    load.write(chunks, rows)
    load.finish()
    return chunks.read().groupBy("chunk_type").agg(
        F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("index_bm25_tables", oracle("""
SELECT 'terms' AS part, term, NULL::BIGINT AS doc_id, df::BIGINT AS n, NULL::BIGINT AS dl, round(idf, 6) AS idf FROM terms
UNION ALL SELECT 'postings', term, doc_id, tf, dl, NULL FROM postings
UNION ALL SELECT 'lengths', NULL, doc_id, NULL, dl, NULL FROM doc_tokens"""))
def index_bm25_tables(spark, sf):
    path = scratch_path(spark, "index")
    retrieval.build_index(fx.documents(spark, sf), path)
    loaded = retrieval.KeywordIndex.load(spark, path)
    parts = {"terms": (loaded.term_stats, {"term": "term", "n": "df", "idf": "idf"}),
             "postings": (loaded.postings, {"term": "term", "doc_id": "doc_id", "n": "tf", "dl": "dl"}),
             "lengths": (loaded.doc_stats, {"doc_id": "doc_id", "dl": "dl"})}
    types = {"term": "string", "doc_id": "bigint", "n": "bigint", "dl": "bigint", "idf": "double"}
    rows = [df.select(F.lit(part).alias("part"), *[
        (F.col(names[c]) if c in names else F.lit(None)).cast(kind).alias(c) for c, kind in types.items()])
        for part, (df, names) in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).withColumn("idf", F.round("idf", 6))


@query("io_job_history", oracle("""
SELECT 'events-' || strftime(ts, '%Y-%m-%d') AS job_id, CAST(NULL AS VARCHAR) AS source, count(*) AS total_records,
  max(ts) AS created_at FROM events GROUP BY 1
UNION ALL
SELECT 'lines-' || strftime(l_shipdate, '%Y-%m'), 'etl', count(*), max(l_shipdate) FROM lineitem GROUP BY 1"""))
def io_job_history(spark, sf):
    simple = fx.table(spark, sf, "events").groupBy(
        F.concat(F.lit("events-"), F.date_format("ts", "yyyy-MM-dd")).alias("job_id")).agg(
        F.count("*").alias("total_records"), F.max("ts").alias("created_at"))
    runs = fx.table(spark, sf, "lineitem").groupBy(
        F.concat(F.lit("lines-"), F.date_format("l_shipdate", "yyyy-MM")).alias("job_id")).agg(
        F.count("*").alias("total_records"), F.max("l_shipdate").alias("created_at")).withColumn(
        "source", F.lit("etl"))
    return files.job_history(simple, runs)


@query("io_eval_export", oracle("""
SELECT result_id, session_id, average_score, passed, verdict FROM judged"""))
def io_eval_export(spark, sf):
    path = scratch_path(spark, "export")
    rows = _judged(spark, sf).select(
        "result_id", "session_id", "average_score", "passed", "verdict", F.lit("x").alias("eval_result"),
        F.col("verdict").alias("judge_verdict_enum"))
    files.export_json(rows, path)
    # fields that are null in every row would be missing, so the schema is given
    return spark.read.schema(
        "result_id string, session_id string, average_score double, passed boolean, verdict string").json(path)


def _judged(spark, sf):
    from riskspark.operators import querylog

    return querylog.metric_rollup(querylog.judge(fx.evaluations(spark, sf)))


@query("io_ingest_summary", oracle("""
SELECT count(*) AS rows_read, count(DISTINCT (sku, supplier_id)) + count(DISTINCT supplier_id) AS chunks_created,
  count(DISTINCT (sku, supplier_id)) + count(DISTINCT supplier_id) AS chunks_total,
  count(DISTINCT supplier_id) AS suppliers_upserted, count(DISTINCT supplier_id) AS suppliers_total,
  count(DISTINCT sku) AS incidents_inserted FROM canonical"""))
def io_ingest_summary(spark, sf):
    """A load of the whole fixture, counted by its writes."""
    warehouse = etl.Warehouse.at(spark, scratch_path(spark, "warehouse"))
    counts = etl.load_pipeline(frames.formatted(spark, sf), fx.ORDER, warehouse)
    return spark.createDataFrame([tuple(counts.values())], ", ".join(f"{c} long" for c in counts))


@query("io_reset_ingest", oracle("""
SELECT 'chunk' AS part, 'record_' || sku || '_' || supplier_id AS name FROM canonical WHERE l_linestatus = 'O' GROUP BY 2
UNION ALL SELECT 'chunk', 'supplier_summary_' || supplier_id FROM canonical WHERE l_linestatus = 'O' GROUP BY 2
UNION ALL SELECT 'vector', 'record_' || sku || '_' || supplier_id FROM canonical WHERE l_linestatus = 'O' GROUP BY 2
UNION ALL SELECT 'vector', 'supplier_summary_' || supplier_id FROM canonical WHERE l_linestatus = 'O' GROUP BY 2
UNION ALL SELECT 'incident', sku FROM canonical GROUP BY 2
UNION ALL SELECT 'supplier', supplier_id FROM canonical GROUP BY 2"""))
def io_reset_ingest(spark, sf):
    """Of two loads the second resets the documents; incidents and suppliers stay."""
    warehouse = etl.Warehouse.at(spark, scratch_path(spark, "warehouse"))
    old, new = (half.drop("line_status") for half in _halves(_formatted_with_status(spark, sf)))
    etl.load_pipeline(old, fx.ORDER, warehouse)
    etl.load_pipeline(new, fx.ORDER, warehouse, reset_documents=True)
    parts = [("chunk", warehouse.chunks, "chunk_id"), ("vector", warehouse.vectors, "doc_id"),
             ("incident", warehouse.incidents, "incident_code"), ("supplier", warehouse.suppliers, "supplier_id")]
    rows = [t.read().select(F.lit(part).alias("part"), F.col(c).alias("name")) for part, t, c in parts]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


# --- B: mapping ------------------------------------------------------------------


@query("map_normalise", oracle("SELECT upload_id, position, header, norm FROM norm_headers"))
def map_normalise(spark, sf):
    return mapping.normalised(fx.upload_headers(spark, sf))


@query("map_exact", oracle("""
SELECT upload_id, position, header, exact, CAST(0.95 AS DOUBLE) AS confidence FROM exact_headers WHERE exact IS NOT NULL"""))
def map_exact(spark, sf):
    found = mapping.exact_matches(fx.upload_headers(spark, sf)).filter("exact is not null")
    return found.select("upload_id", "position", "header", "exact", F.lit(mapping.EXACT).alias("confidence"))


@query("map_fuzzy", oracle("""
SELECT upload_id, position, header, fuzzy, round(fuzzy_score, 6) AS fuzzy_score
FROM norm_headers LEFT JOIN fuzzy_headers USING (norm)"""))
def map_fuzzy(spark, sf):
    found = mapping.fuzzy_matches(mapping.exact_matches(fx.upload_headers(spark, sf)))
    return found.select("upload_id", "position", "header", "fuzzy", F.round("fuzzy_score", 6).alias("fuzzy_score"))


def _profiled(spark, sf):
    facts = mapping.profile(fx.upload_values(spark, sf))
    named = mapping.normalised(fx.value_headers(spark, sf))
    return facts.join(named, ["upload_id", "position"])


@query("map_profile", oracle("""
SELECT upload_id, position, filled, numbers, low, high, round(std, 6) AS std, transport_only, transport_seen,
  inspection_only, inspection_seen, shipment_only, shipment_seen, round(date_share, 6) AS date_share FROM profiles"""))
def map_profile(spark, sf):
    facts = mapping.profile(fx.upload_values(spark, sf))
    return facts.withColumns({c: F.round(c, 6) for c in ("std", "date_share")}).withColumns(
        {f"{n}_seen": F.col(f"{n}_seen").cast("bigint") for n in ("transport", "inspection", "shipment")})


_INFER = """
SELECT upload_id, position, header, inferred, inferred_score, inferred_transform FROM (
SELECT *, CASE
    WHEN filled >= 3 AND transport_only AND transport_seen >= 2 THEN 'transportation_mode'
    WHEN filled >= 3 AND inspection_only AND inspection_seen >= 2 THEN 'inspection_status'
    WHEN filled >= 3 AND shipment_only AND shipment_seen >= 2 THEN 'shipment_status'
    WHEN numbers >= 3 AND low >= 0 AND high <= 1 AND high > 0 THEN 'defect_rate'
    WHEN numbers >= 3 AND low >= 0 AND high <= 100 AND std < 20 AND high > 1
      AND regexp_matches(header, 'defect|reject|fail|quality|error|rate') THEN 'defect_rate%'
    WHEN numbers >= 3 AND low >= 0 AND high > 10000 AND regexp_matches(header, 'revenue|sales|income|earning')
      THEN 'revenue'
    WHEN numbers >= 3 AND low >= 0 AND high > 10000
      AND regexp_matches(header, 'transport|shipping|freight|logistics') THEN 'transportation_cost'
    WHEN numbers >= 3 AND low >= 0 AND high > 10000 AND regexp_matches(header, 'manufactur|production|unit cost')
      THEN 'manufacturing_cost'
    WHEN numbers >= 3 AND low >= 0 AND high <= 365 AND std < 30 AND regexp_matches(header, 'lead|lt')
      THEN 'lead_time_days'
    WHEN numbers >= 3 AND low >= 0 AND high <= 365 AND std < 30 AND regexp_matches(header, 'delay|late|overdue')
      THEN 'delivery_delay_days'
    WHEN filled > numbers AND date_share > 0.8 THEN 'timestamp' END AS code,
  rtrim(code, '%') AS inferred,
  CAST(CASE code WHEN 'transportation_mode' THEN 0.92 WHEN 'inspection_status' THEN 0.92 WHEN 'shipment_status' THEN 0.90
    WHEN 'defect_rate' THEN 0.80 WHEN 'defect_rate%' THEN 0.75 WHEN 'timestamp' THEN 0.85 ELSE
      CASE WHEN code IS NOT NULL THEN 0.70 END END AS DOUBLE) AS inferred_score,
  CASE WHEN code IS NULL THEN NULL WHEN code = 'defect_rate%' THEN 'divide_by_100'
    WHEN code = 'timestamp' THEN 'date_parse' ELSE 'direct' END AS inferred_transform
FROM value_headers JOIN profiles USING (upload_id, position))"""


@query("map_infer", oracle(_INFER))
def map_infer(spark, sf):
    return mapping.inferred(_profiled(spark, sf)).select(
        "upload_id", "position", "header", "inferred", "inferred_score", "inferred_transform")


def _votes(spark, sf):
    """Exact matches win; the other headers are judged by content, without fuzzy votes."""
    exact = mapping.exact_matches(fx.value_headers(spark, sf))
    inferred = mapping.inferred(mapping.profile(fx.upload_values(spark, sf)).join(exact, ["upload_id", "position"]))
    none = inferred.withColumns({"fuzzy": F.lit(None).cast("string"), "fuzzy_score": F.lit(None).cast("double")})
    return mapping.combine(none)


@query("map_assign", oracle(f"""
SELECT upload_id, inferred AS field, header, inferred_score AS confidence FROM ({_INFER})
WHERE inferred IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY upload_id, inferred ORDER BY inferred_score DESC, position) = 1"""))
def map_assign(spark, sf):
    return mapping.assign(_votes(spark, sf)).select("upload_id", "field", "header", "confidence")


_REPORT = """
SELECT s.s_suppkey AS upload_id, f.field_no, f.field, e.header AS source_column,
  CASE WHEN e.header IS NULL THEN 'derive' ELSE 'direct' END AS transform,
  CASE WHEN e.header IS NULL THEN 0.0 ELSE 0.95 END::DOUBLE AS confidence,
  CASE WHEN e.header IS NULL THEN 'none' ELSE 'exact' END AS match_layer, f.required
FROM supplier s CROSS JOIN (VALUES {fields}) f(field_no, field, required)
LEFT JOIN (SELECT * FROM exact_headers WHERE exact IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY upload_id, exact ORDER BY position) = 1) e
  ON e.upload_id = s.s_suppkey AND e.exact = f.field""".format(
    fields=", ".join(f"({i}, '{n}', {str(r).lower()})" for i, (n, _, r) in enumerate(schema.CANONICAL)))


def _exact_report(spark, sf):
    headers = fx.upload_headers(spark, sf)
    votes = mapping.exact_matches(headers).filter("exact is not null").select(
        "upload_id", "position", "header", F.col("exact").alias("field"), F.lit(mapping.EXACT).alias("confidence"),
        F.lit("direct").alias("transform"), F.lit("exact").alias("layer"))
    return mapping.mapping_report(headers, mapping.assign(votes))


@query("map_report", oracle(
    f"SELECT upload_id, field, source_column, transform, confidence, match_layer FROM ({_REPORT})"))
def map_report(spark, sf):
    return _exact_report(spark, sf).select(
        "upload_id", "field", "source_column", "transform", "confidence", "match_layer")


@query("map_missing", oracle(f"""
SELECT upload_id, count(source_column) AS mapped, coalesce(string_agg(field, ', ' ORDER BY field_no)
    FILTER (required AND source_column IS NULL), '') AS missing_fields FROM ({_REPORT}) GROUP BY upload_id"""))
def map_missing(spark, sf):
    return mapping.mapping_notes(_exact_report(spark, sf)).select("upload_id", "mapped", "missing_fields")


_DETECT = """
WITH votes AS (
  SELECT v.upload_id, v.position, v.header, a.field AS exact, f.fuzzy, f.fuzzy_score, i.inferred, i.inferred_score,
    i.inferred_transform, f.fuzzy IS NOT NULL AND f.fuzzy = i.inferred AS agree,
    i.inferred IS NOT NULL AND (f.fuzzy IS NULL OR i.inferred_score >= 0.85) AS by_values
  FROM (SELECT *, {norm} AS norm FROM value_headers) v
  LEFT JOIN aliases a USING (norm) LEFT JOIN fuzzy_headers f USING (norm)
  LEFT JOIN ({infer}) i ON i.upload_id = v.upload_id AND i.position = v.position),
picked AS (
  SELECT upload_id, position, header,
    CASE WHEN exact IS NOT NULL THEN exact WHEN agree OR by_values THEN inferred ELSE fuzzy END AS field,
    CASE WHEN exact IS NOT NULL THEN 0.95 WHEN agree THEN least(greatest(inferred_score, fuzzy_score) + 0.05, 1.0)
      WHEN by_values THEN inferred_score ELSE fuzzy_score END AS confidence,
    CASE WHEN exact IS NULL AND (agree OR by_values) THEN inferred_transform ELSE 'direct' END AS transform,
    CASE WHEN exact IS NOT NULL THEN 'exact' WHEN agree THEN 'fuzzy+dtype' WHEN by_values THEN 'dtype'
      ELSE 'fuzzy' END AS layer
  FROM votes),
assigned AS (
  SELECT * FROM picked WHERE field IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY upload_id, field ORDER BY confidence DESC, position) = 1)
SELECT s.s_suppkey AS upload_id, f.field_no, f.field, f.required, p.header AS source_column,
  coalesce(p.transform, 'derive') AS transform, CASE WHEN p.header IS NULL THEN 'use_default' END AS derive_formula,
  round(coalesce(p.confidence, 0.0), 3)::DOUBLE AS confidence, coalesce(p.layer, 'none') AS match_layer
FROM supplier s CROSS JOIN (VALUES {fields}) f(field_no, field, required)
LEFT JOIN assigned p ON p.upload_id = s.s_suppkey AND p.field = f.field""".format(
    norm=sql.NORM.format("header"), infer=_INFER,
    fields=", ".join(f"({i}, '{n}', {str(r).lower()})" for i, (n, _, r) in enumerate(schema.CANONICAL)))


@query("map_detect", oracle(_DETECT))
def map_detect(spark, sf):
    """All layers: exact, fuzzy and inferred votes combined, one column per field."""
    votes = mapping.detect(fx.value_headers(spark, sf), fx.upload_values(spark, sf))
    return mapping.mapping_report(fx.value_headers(spark, sf), mapping.assign(votes))


@query("map_registry_match", oracle("""
SELECT upload_id, company_id, overlap FROM (
  SELECT u.upload_id, r.company_id, r.last_used_at,
    len(list_intersect(u.columns, r.source_columns)) /
      len(list_distinct(list_concat(u.columns, r.source_columns))) AS overlap
  FROM (SELECT upload_id, list(DISTINCT header) AS columns FROM headers GROUP BY upload_id) u CROSS JOIN registry r)
WHERE overlap > 0.7 QUALIFY row_number() OVER (PARTITION BY upload_id ORDER BY last_used_at DESC, company_id DESC) = 1"""))
def map_registry_match(spark, sf):
    return mapping.match_saved(
        mapping.header_sets(fx.upload_headers(spark, sf)), fx.saved_mappings(spark, sf))


def _raw_lines(spark, sf):
    return fx.canonical(spark, sf, ["supplier_name", "inventory_level", "defect_rate", "delivery_delay_days",
                                    "timestamp", "sku"]).select(
        "row_key", F.col("supplier_name").alias("Vendor"), F.col("inventory_level").alias("Stock"),
        (F.col("defect_rate") * 100).alias("Scrap %"), F.col("delivery_delay_days").alias("Slack"),
        F.col("timestamp").alias("Date"), "sku")


_MAPPING = {
    "supplier_id": {"source_column": "Vendor", "transform": "slugify"},
    "supplier_name": {"source_column": "Vendor", "transform": "direct"},
    "sku": {"source_column": "sku", "transform": "direct"},
    "inventory_level": {"source_column": "Stock", "transform": "direct"},
    "defect_rate": {"source_column": "Scrap %", "transform": "divide_by_100"},
    "delivery_delay_days": {"source_column": "Slack", "transform": "negate"},
    "timestamp": {"source_column": "Date", "transform": "date_parse"},
    "severity": {"source_column": None, "transform": "derive"},
}


@query("map_apply", oracle("""
SELECT trim(regexp_replace(lower(supplier_name), '[^a-z0-9]+', '-', 'g'), '-') AS supplier_id, supplier_name, sku,
  inventory_level, round(defect_rate * 100 / 100.0, 6) AS defect_rate, -delivery_delay_days AS delivery_delay_days,
  strftime(occurred_at, '%Y-%m-%d %H:%M:%S') AS timestamp, CAST(NULL AS VARCHAR) AS severity,
  supplier_name AS _raw_Vendor, inventory_level AS _raw_Stock FROM canonical"""))
def map_apply(spark, sf):
    out = mapping.apply_mapping(_raw_lines(spark, sf), _MAPPING, keep=["row_key"])
    return out.select(
        "supplier_id", "supplier_name", "sku", "inventory_level", R6("defect_rate"), "delivery_delay_days",
        "timestamp", "severity", "_raw_Vendor", "_raw_Stock")


_UPLOAD_NAMES = ", ".join(f"('{k}', '{v}')" for k, v in schema.UPLOAD_HEADERS.items())
_PIPELINE_HEADERS = f"""
SELECT upload_id, position, header, p.name AS pipeline_name FROM headers
LEFT JOIN (VALUES {_UPLOAD_NAMES}) p(key, name) ON replace(replace(lower(header), ' ', ''), '_', '') = p.key"""


@query("map_rename", oracle(_PIPELINE_HEADERS))
def map_rename(spark, sf):
    return mapping.pipeline_headers(fx.upload_headers(spark, sf))


@query("map_required_groups", oracle(f"""
SELECT s_suppkey AS upload_id, g AS missing_group
FROM supplier CROSS JOIN (VALUES {", ".join(f"('{g}', '{p}')" for g, p in schema.UPLOAD_GROUPS.items())}) t(g, p)
WHERE NOT EXISTS (SELECT 1 FROM ({_PIPELINE_HEADERS}) h WHERE h.upload_id = s_suppkey AND h.pipeline_name = p)"""))
def map_required_groups(spark, sf):
    return mapping.missing_groups(fx.upload_headers(spark, sf))


def _new_mappings(spark, sf):
    """Every company of a region saves its mapping again; regions without a mapping are new."""
    s = fx.table(spark, sf, "supplier").join(
        fx.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    names = s.groupBy("n_regionkey").agg(F.max("n_name").alias("n_name"), F.count("*").alias("n"))
    both = names.select("n_name", "n").unionByName(
        names.select(F.concat(F.lit("REGION-"), F.col("n_regionkey").cast("string")).alias("n_name"), "n"))
    return both.select(
        F.sha2(F.concat(F.lit("new-"), "n_name"), 256).alias("id"), F.col("n_name").alias("company_id"),
        F.array(F.lit("stock"), F.lit("vendor")).alias("source_columns"),
        (F.col("n") / 1000.0).alias("confidence_score"),
        F.lit(fx.AS_OF).cast("timestamp_ntz").alias("created_at"),
        F.lit(fx.AS_OF).cast("timestamp_ntz").alias("last_used_at"))


@query("map_registry_upsert", oracle(f"""
WITH names AS (SELECT n_regionkey, max(n_name) AS n_name, count(*) AS n
  FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_regionkey),
fresh AS (SELECT n_name AS company_id, n / 1000.0 AS confidence_score FROM names
  UNION ALL SELECT 'REGION-' || n_regionkey, n / 1000.0 FROM names),
known AS (SELECT n_name AS company_id, n_nationkey / 25.0 AS confidence_score,
    TIMESTAMP '2024-01-01' AS created_at, TIMESTAMP '2024-01-01' + to_days(n_nationkey * 7 % 25) AS last_used_at
  FROM nation)
SELECT company_id, round(coalesce(f.confidence_score, k.confidence_score), 6) AS confidence_score,
  coalesce(k.created_at, {sql.AS_OF}) AS created_at,
  CASE WHEN f.company_id IS NOT NULL THEN {sql.AS_OF} ELSE k.last_used_at END AS last_used_at
FROM known k FULL JOIN fresh f USING (company_id)"""))
def map_registry_upsert(spark, sf):
    saved = mapping.save_mappings(fx.saved_mappings(spark, sf), _new_mappings(spark, sf))
    return mapping.list_mappings(saved).select(
        "company_id", R6("confidence_score"), "created_at", "last_used_at")


# --- C: derivations --------------------------------------------------------------


@query("derive_cast", oracle("""
SELECT sku, CASE WHEN l_linenumber = 1 THEN 0.0 ELSE inventory_level END AS inventory_level,
  CASE WHEN l_linenumber = 2 THEN '' ELSE supplier_name END AS supplier_name, warehouse_location FROM canonical"""))
def derive_cast(spark, sf):
    raw = fx.canonical(spark, sf, ["sku", "inventory_level", "supplier_name", "warehouse_location"])
    line = fx.key("l_linenumber")
    rough = raw.withColumns(
        {
            "inventory_level": F.when(line == 1, "n/a").otherwise(
                F.concat(F.lit(" "), F.col("inventory_level").cast("string"))),
            "supplier_name": F.when(line != 2, F.concat("supplier_name", F.lit("  "))),
            "warehouse_location": F.concat(F.lit("\t"), "warehouse_location"),
        }
    )
    return derive.cast_types(rough).drop("row_key")


@query("derive_defect_scale", oracle("""
SELECT sku, CASE WHEN (SELECT max(defect_rate * 100) FROM canonical) > 1
  THEN round_even(defect_rate * 100 / (SELECT max(defect_rate * 100) FROM canonical) * 1e6, 0) / 1e6
  ELSE defect_rate * 100 END AS defect_rate FROM canonical"""))
def derive_defect_scale(spark, sf):
    df = fx.canonical(spark, sf, ["sku", "supplier_id", "timestamp", "defect_rate"])
    scaled = df.withColumn("defect_rate", F.col("defect_rate") * 100)
    return derive.derive_fields(scaled, fx.AS_OF, fx.ORDER)[0].select("sku", "defect_rate")


@query("derive_thresholds", oracle("""
SELECT round(d50, 6) AS delay_p50, round(d75, 6) AS delay_p75, round(d90, 6) AS delay_p90, round(f50, 6) AS defect_p50,
  round(f75, 6) AS defect_p75, round(f90, 6) AS defect_p90, round(s10, 6) AS stock_p10, round(s25, 6) AS stock_p25,
  round(s50, 6) AS stock_p50, n, round(mean_cost, 6) AS mean_cost, max_stock FROM stats"""))
def derive_thresholds(spark, sf):
    s = derive.batch_stats(fx.canonical(spark, sf, frames.CORE))
    row = {k: round(v, 6) for k, v in s.thresholds.items()}
    row |= {"n": s.n, "mean_cost": round(s.mean_cost, 6), "max_stock": s.max_inventory}
    return spark.createDataFrame([row])


@query("derive_quantiles", oracle("""
SELECT round(quantile_cont(l_extendedprice, 0.05), 6) AS p05, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50,
  round(quantile_cont(l_extendedprice, 0.95), 6) AS p95 FROM lineitem"""))
def derive_quantiles(spark, sf):
    """Exact quantiles of a column with many distinct values."""
    from riskspark.operators.quantiles import interpolated, order_statistics

    df = fx.table(spark, sf, "lineitem")
    points = {p: interpolated(df.count(), p) for p in (0.05, 0.5, 0.95)}
    found = order_statistics(
        df, {"price": F.col("l_extendedprice")}, {"price": [r for a, b, _ in points.values() for r in (a, b)]})
    values = {
        f"p{round(p * 100):02d}": round(found["price", a] + (found["price", b] - found["price", a]) * w, 6)
        for p, (a, b, w) in points.items()
    }
    return spark.createDataFrame([values])


@query("derive_supplier_slug", oracle("""
SELECT sku, trim(regexp_replace(lower(supplier_name), '[^a-z0-9]+', '-', 'g'), '-') AS supplier_id FROM canonical"""))
def derive_supplier_slug(spark, sf):
    df = fx.canonical(spark, sf, ["sku", "supplier_name", "timestamp"]).withColumn("supplier_id", F.lit(""))
    return derive.derive_fields(df, fx.AS_OF, fx.ORDER)[0].select("sku", "supplier_id")


@query("derive_row_numbers", oracle("""
SELECT row_seq, printf('SUP-%04d', row_seq) AS supplier_id, printf('INC-ETL-%05d', row_seq) AS sku, revenue
FROM canonical"""))
def derive_row_numbers(spark, sf):
    """Supplier ids and incident codes of a batch that has neither ids, names nor codes."""
    df = fx.canonical(spark, sf, ["revenue", "timestamp"])
    return derive.derive_fields(df, fx.AS_OF, fx.ORDER)[0].select("row_seq", "supplier_id", "sku", "revenue")


@query("derive_delay", oracle("""
SELECT sku, round_even((lead_time_days - lead_time_days * 0.80) * 100, 0) / 100 AS delivery_delay_days FROM canonical"""))
def derive_delay(spark, sf):
    df = fx.canonical(spark, sf, ["sku", "supplier_id", "lead_time_days", "timestamp"]).withColumn(
        "delivery_delay_days", F.lit(0.0))
    return derive.derive_fields(df, fx.AS_OF, fx.ORDER)[0].select("sku", "delivery_delay_days")


@query("derive_status", oracle("SELECT sku, delivery_delay_days, shipment_status FROM enriched"))
def derive_status(spark, sf):
    return frames.enriched(spark, sf).select("sku", "delivery_delay_days", "shipment_status")


@query("derive_severity", oracle("SELECT sku, severity FROM enriched"))
def derive_severity(spark, sf):
    return frames.enriched(spark, sf).select("sku", "severity")


@query("derive_risk_score", oracle("SELECT sku, risk_score FROM enriched"))
def derive_risk_score(spark, sf):
    return frames.enriched(spark, sf).select("sku", "risk_score")


@query("derive_timestamp_spread", oracle(f"""
SELECT sku, strftime({sql.AS_OF} - to_days(CAST(floor((row_seq - 1) / (SELECT max(row_seq) - 1 FROM canonical) * 30) AS INT))
  - to_hours((row_seq - 1) % 24), '%Y-%m-%dT%H:%M:%S') AS timestamp FROM canonical"""))
def derive_timestamp_spread(spark, sf):
    df = fx.canonical(spark, sf, ["sku", "supplier_id"])
    return derive.derive_fields(df, fx.AS_OF, fx.ORDER)[0].select("sku", "timestamp")


@query("derive_timestamp_parse", oracle(f"""
SELECT sku, CASE WHEN l_linenumber = 2 THEN strftime({sql.AS_OF}, '%Y-%m-%dT%H:%M:%S') ELSE ts_text END AS timestamp
FROM canonical"""))
def derive_timestamp_parse(spark, sf):
    line = fx.key("l_linenumber")
    when = F.col("row_key.l_shipdate")
    df = fx.canonical(spark, sf, ["sku", "supplier_id"]).withColumn(
        "timestamp",
        F.when(line == 1, F.date_format(when, "yyyy-MM-dd")).when(line == 2, "not a date")
        .when(line == 3, F.date_format(when, "M/d/yyyy")).otherwise(iso_time(when)))
    return derive.derive_fields(df, fx.AS_OF, fx.ORDER)[0].select("sku", "timestamp")


@query("derive_distributions", oracle("""
SELECT 'severity' AS field, severity AS value, count(*) AS n FROM enriched GROUP BY severity
UNION ALL SELECT 'shipment_status', shipment_status, count(*) FROM enriched GROUP BY shipment_status"""))
def derive_distributions(spark, sf):
    return derive.distributions(frames.enriched(spark, sf))


@query("derive_format", oracle("""
SELECT sku AS "IncidentCode", supplier_id AS "SupplierID", supplier_name AS "SupplierName",
  product_type AS "SupplierCategory", inventory_level AS "InventoryLevel", risk_score AS "ImpactScore",
  'open' AS "ResolutionStatus", '' AS "Region" FROM enriched"""))
def derive_format(spark, sf):
    df = derive.to_pipeline(frames.enriched(spark, sf, frames.TEXTS))
    return df.select("IncidentCode", "SupplierID", "SupplierName", "SupplierCategory", "InventoryLevel",
                     "ImpactScore", "ResolutionStatus", "Region")


@query("derive_title", oracle("SELECT sku AS \"IncidentCode\", title AS \"Title\" FROM formatted"))
def derive_title(spark, sf):
    return frames.formatted(spark, sf).select("IncidentCode", "Title")


@query("derive_description", oracle("SELECT sku AS \"IncidentCode\", description AS \"Description\" FROM formatted"))
def derive_description(spark, sf):
    return frames.formatted(spark, sf).select("IncidentCode", "Description")


@query("derive_category", oracle(
    "SELECT sku AS \"IncidentCode\", category AS \"IncidentCategory\" FROM formatted"))
def derive_category(spark, sf):
    return frames.formatted(spark, sf).select("IncidentCode", "IncidentCategory")


@query("derive_rule_severity", oracle(f"""
SELECT sku, {sql.rule_severity('delivery_delay_days', 'inventory_level', 'demand_forecast')} AS severity FROM canonical"""))
def derive_rule_severity(spark, sf):
    df = fx.canonical(spark, sf, ["sku", "delivery_delay_days", "inventory_level", "demand_forecast"])
    return df.select("sku", F.expr(
        rules.rule_severity("delivery_delay_days", "inventory_level", "demand_forecast")).alias("severity"))


_COVER = sql.coverage("inventory_level", "demand_forecast")


@query("derive_static_rules", oracle(f"""
SELECT sku, CASE WHEN delivery_delay_days > 14 THEN 'Critical' WHEN delivery_delay_days > 7 THEN 'Delayed'
    WHEN delivery_delay_days > 0 THEN 'In-Transit' ELSE 'On-Time' END AS shipment_status,
  CASE WHEN defect_rate > 0.10 OR delivery_delay_days > 14 OR {_COVER} < 0.20 THEN 'critical'
    WHEN defect_rate > 0.05 OR delivery_delay_days > 7 OR {_COVER} < 0.50 THEN 'high'
    WHEN defect_rate > 0.02 OR delivery_delay_days > 3 OR {_COVER} < 0.70 THEN 'medium' ELSE 'low' END AS severity,
  CAST(printf('%.2f', (least(delivery_delay_days / 20.0, 1.0) * 0.35 + greatest(0.0, 1.0 - {_COVER}) * 0.25
    + least(defect_rate / 0.15, 1.0) * 0.20
    + least(greatest(transportation_cost / mean_cost - 1.0, 0.0) / 2.0, 1.0) * 0.20) * 100) AS DOUBLE) AS risk_score
FROM canonical, stats"""))
def derive_static_rules(spark, sf):
    df = fx.canonical(spark, sf, [
        "sku", "delivery_delay_days", "inventory_level", "demand_forecast", "defect_rate", "transportation_cost"])
    lines = fx.canonical(spark, sf, ["transportation_cost"])
    mean = lines.agg(F.avg("transportation_cost")).first()[0]
    d, i, m, x, t = (
        "delivery_delay_days", "inventory_level", "demand_forecast", "defect_rate", "transportation_cost")
    return df.select(
        "sku", F.expr(rules.static_status(d)).alias("shipment_status"),
        F.expr(rules.static_severity(d, i, m, x)).alias("severity"),
        F.expr(rules.static_risk(d, i, m, x, t, mean)).alias("risk_score"))


@query("derive_safe_values", oracle("""
SELECT sku, CASE WHEN l_linenumber = 1 THEN 100.0 ELSE inventory_level END AS inventory_level,
  CASE WHEN l_linenumber = 2 THEN 0.0 ELSE delivery_delay_days END AS delivery_delay_days,
  CASE WHEN l_linenumber = 3 THEN 'N/A' ELSE supplier_name END AS supplier_name FROM canonical"""))
def derive_safe_values(spark, sf):
    df = fx.canonical(spark, sf, ["sku", "inventory_level", "delivery_delay_days", "supplier_name"])
    line = fx.key("l_linenumber")
    return df.select(
        "sku",
        float_or(F.when(line == 1, "?").otherwise(F.col("inventory_level").cast("string")), 100.0)
        .alias("inventory_level"),
        float_or(F.when(line != 2, F.col("delivery_delay_days").cast("string"))).alias("delivery_delay_days"),
        text_or(F.when(line == 3, "  ").otherwise(F.col("supplier_name"))).alias("supplier_name"))


@query("derive_enums", oracle("""
SELECT sku, CASE WHEN l_linenumber = 1 THEN 'medium' ELSE severity END AS severity,
  CASE WHEN l_linenumber = 2 THEN 'open' ELSE resolution_status END AS resolution_status FROM enriched"""))
def derive_enums(spark, sf):
    from riskspark.functions.columns import one_of

    df = frames.enriched(spark, sf, ["resolution_status"])
    line = fx.key("l_linenumber")
    return df.select(
        "sku",
        one_of(F.when(line == 1, "severe").otherwise(F.upper("severity")), incidents.SEVERITIES, "medium")
        .alias("severity"),
        one_of(F.when(line == 2, "").otherwise(F.col("resolution_status")), incidents.RESOLUTIONS, "open")
        .alias("resolution_status"))


def _per_field(fields, view, test):
    """SQL with a row (field, flag) per field, from the values of its column in a view."""
    column = {"timestamp": "ts_text"}
    return " UNION ALL ".join(
        f"SELECT '{f}' AS field, coalesce({test.format(column.get(f, f))}, true) AS flag FROM {view}" for f in fields)


_BLANK = "bool_and(coalesce(CAST({} AS VARCHAR), '') = '')"


@query("derive_field_audit", oracle(f"SELECT field, flag AS is_empty FROM ({_per_field(schema.FIELDS, 'enriched', _BLANK)})"))
def derive_field_audit(spark, sf):
    return derive.field_audit(frames.enriched(spark, sf, schema.FIELDS))


# --- D: validation ---------------------------------------------------------------

_CHECKED = ["supplier_id", "supplier_name", "sku", "inventory_level", "demand_forecast", "warehouse_location",
            "delivery_delay_days", "defect_rate", "inspection_status"]


def _checked(spark, sf):
    return validate.check_rows(fx.with_faults(fx.canonical(spark, sf, _CHECKED)))


@query("validate_rows", oracle("SELECT sku, errors, warnings FROM checked"))
def validate_rows(spark, sf):
    return _checked(spark, sf).select(
        "sku", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"))


@query("validate_repair", oracle("""
SELECT sku, CASE WHEN defect_rate < 0 THEN 0.0 WHEN defect_rate > 1 THEN 1.0 ELSE defect_rate END AS defect_rate,
  CASE WHEN severity = 'Extreme' THEN 'medium' ELSE severity END AS severity FROM checked"""))
def validate_repair(spark, sf):
    return _checked(spark, sf).select("sku", "defect_rate", "severity")


@query("validate_summary", oracle("""
SELECT total, failed_count, warning_count, total - failed_count - warning_count AS valid_count,
  round((total - failed_count) / total * 100, 6) AS pass_rate, total > failed_count AS is_valid FROM (
  SELECT count(*) AS total, count(*) FILTER (no_identity) AS failed_count,
    count(*) FILTER (NOT no_identity AND warnings <> '') AS warning_count FROM checked)"""))
def validate_summary(spark, sf):
    return validate.summary(_checked(spark, sf)).withColumn("pass_rate", F.round("pass_rate", 6))


#: with an optional field that has no value in any row, and one that has
_SEEN = [*_CHECKED, "shipping_carrier", "product_type"]
_ABSENT = [f for f in schema.FIELDS if f not in [*_SEEN, "severity"]]
_NEEDED = ", ".join(f"'{f}'" for f in schema.REQUIRED)


@query("validate_dataset", oracle(f"""
SELECT field, CASE WHEN needed THEN 'error' ELSE 'warning' END AS level,
  CASE WHEN needed THEN 'Required field ' || chr(39) || field || chr(39) || ' missing after transformation.'
    ELSE 'Optional field ' || chr(39) || field || chr(39) || ' absent — defaults applied.' END AS message
FROM (
  SELECT field, field IN ({_NEEDED}) AS needed, false AS gone
  FROM ({_per_field([*_SEEN, "severity"], "faulty", "count({}) = 0")}) WHERE flag
  UNION ALL SELECT field, field IN ({_NEEDED}), true FROM (SELECT unnest({_ABSENT}) AS field))
WHERE gone OR NOT needed"""))
def validate_dataset(spark, sf):
    return validate.dataset_messages(fx.with_faults(fx.canonical(spark, sf, _SEEN)))


@query("validate_keep", oracle("SELECT sku, supplier_id FROM checked WHERE NOT no_identity"))
def validate_keep(spark, sf):
    return validate.keep_valid(_checked(spark, sf)).select("sku", "supplier_id")


@query("validate_sample", oracle("""
(SELECT 'error' AS level, sku FROM checked WHERE no_identity ORDER BY row_seq LIMIT 50)
UNION ALL
(SELECT 'warning', sku FROM checked WHERE NOT no_identity AND warnings <> '' ORDER BY row_seq LIMIT 50)"""))
def validate_sample(spark, sf):
    return validate.issue_sample(_checked(spark, sf), fx.ORDER).select("level", "sku")


# --- E: anomalies ----------------------------------------------------------------

_ODD = ["supplier_id", "supplier_name", "sku", "warehouse_location", "inventory_level", "demand_forecast",
        "delivery_delay_days", "transportation_cost", "defect_rate"]

_OUTLIERS = """
SELECT field, supplier_name, sku, location, CAST(printf('%.4f', raw) AS DOUBLE) AS value, abs(z) AS az,
  CASE WHEN abs(z) > 3.5 THEN 'critical' ELSE 'high' END AS severity FROM (
  SELECT 'delivery_delay_days' AS field, supplier_name, sku, warehouse_location AS location, delivery_delay_days AS raw,
    (delivery_delay_days - avg(delivery_delay_days) OVER ()) / nullif(stddev_samp(delivery_delay_days) OVER (), 0) AS z
  FROM odd
  UNION ALL SELECT 'transportation_cost', supplier_name, sku, warehouse_location, transportation_cost,
    (transportation_cost - avg(transportation_cost) OVER ()) / nullif(stddev_samp(transportation_cost) OVER (), 0) FROM odd
  UNION ALL SELECT 'defect_rate', supplier_name, sku, warehouse_location, defect_rate,
    (defect_rate - avg(defect_rate) OVER ()) / nullif(stddev_samp(defect_rate) OVER (), 0) FROM odd)
WHERE abs(z) > 2.5"""
_STOCKOUTS = """
SELECT supplier_name, sku, warehouse_location AS location, inventory_level AS value,
  CASE WHEN inventory_level <= 2 THEN 'critical' ELSE 'high' END AS severity,
  CAST(printf('%.1f', inventory_level / CASE WHEN demand_forecast = 0 THEN 1.0 ELSE demand_forecast END) AS DOUBLE) AS days_to_stockout
FROM odd WHERE inventory_level < (SELECT greatest(avg(inventory_level) * 0.10, 5.0) FROM odd)"""
_TREND = """
SELECT max(d) AS value FROM (SELECT d, lag(d) OVER (ORDER BY row_seq) AS p FROM (
  SELECT row_seq, greatest(delivery_delay_days, 0.0) AS d FROM odd ORDER BY row_seq DESC LIMIT 10))
HAVING count(*) = 10 AND bool_and(p IS NULL OR d >= p) AND max(d) > min(d)"""
_SPIKES = """
SELECT supplier_name, CAST(printf('%.4f', m) AS DOUBLE) AS value, round(m / overall, 6) AS ratio,
  CASE WHEN m > overall * 3 THEN 'critical' ELSE 'high' END AS severity
FROM (SELECT supplier_name, avg(defect_rate) AS m FROM odd GROUP BY supplier_name),
  (SELECT avg(defect_rate) AS overall FROM odd) WHERE m > overall * 2"""


def _odd(spark, sf):
    return fx.with_anomalies(fx.canonical(spark, sf, _ODD))


@query("anomaly_outliers", oracle(
    f"SELECT field, supplier_name, sku, location, value, severity, round(az, 6) AS z FROM ({_OUTLIERS})"))
def anomaly_outliers(spark, sf):
    return anomaly.outliers(_odd(spark, sf)).select(
        "field", "supplier_name", "sku", "location", "value", "severity", F.round(F.abs("z"), 6).alias("z"))


@query("anomaly_stockouts", oracle(_STOCKOUTS))
def anomaly_stockouts(spark, sf):
    return anomaly.stockouts(_odd(spark, sf)).select(
        "supplier_name", "sku", "location", "value", "severity", "days_to_stockout")


@query("anomaly_trend", oracle(_TREND))
def anomaly_trend(spark, sf):
    return anomaly.delay_trend(_odd(spark, sf), fx.ORDER).select("value")


@query("anomaly_defect_spikes", oracle(_SPIKES))
def anomaly_defect_spikes(spark, sf):
    return anomaly.defect_spikes(_odd(spark, sf)).select("supplier_name", "value", R6("ratio"), "severity")


_ALL_EVENTS = f"""
SELECT 'statistical_outlier' AS anomaly_type, field, supplier_name, sku, severity FROM ({_OUTLIERS})
UNION ALL SELECT 'stockout_risk', 'inventory_level', supplier_name, sku, severity FROM ({_STOCKOUTS})
UNION ALL SELECT 'trend', 'delivery_delay_days', 'Multiple', 'Multiple', 'high' FROM ({_TREND})
UNION ALL SELECT 'defect_spike', 'defect_rate', supplier_name, 'Multiple', severity FROM ({_SPIKES})"""


@query("anomaly_all", oracle(_ALL_EVENTS))
def anomaly_all(spark, sf):
    return anomaly.detect(_odd(spark, sf), fx.ORDER).select(
        "anomaly_type", "field", "supplier_name", "sku", "severity")


@query("anomaly_incidents", oracle(f"""
SELECT CASE anomaly_type WHEN 'stockout_risk' THEN 'inventory' WHEN 'trend' THEN 'shipment' ELSE 'supplier' END AS category,
  severity, CASE WHEN supplier_name <> 'Multiple' THEN supplier_name END AS supplier_ref,
  CAST(CASE WHEN severity = 'critical' THEN 90 ELSE 70 END AS DOUBLE) AS impact_score, 'open' AS resolution_status,
  'ANO-' || upper(substr(sku, 1, 6)) AS code_start,
  count(*) OVER (PARTITION BY anomaly_type, field, supplier_name, sku, severity) AS same_code, 64 AS digest_chars
FROM ({_ALL_EVENTS})"""))
def anomaly_incidents(spark, sf):
    found = anomaly.to_incidents(anomaly.detect(_odd(spark, sf), fx.ORDER), fx.AS_OF)
    return found.select(
        "category", "severity", "supplier_ref", "impact_score", "resolution_status",
        F.regexp_replace("incident_code", "-[0-9A-F]+$", "").alias("code_start"),
        F.count("*").over(Window.partitionBy("incident_code")).alias("same_code"),
        F.length(F.regexp_extract("incident_code", "-([0-9A-F]+)$", 1)).alias("digest_chars"))


# --- F: documents ----------------------------------------------------------------

_N = "chr(10)"


def _sql_lines(lines: list[str]) -> str:
    return " || ".join(f"{line} || {_N}" for line in lines)


_RECORD_TEXT = _sql_lines([
    "'SUPPLY CHAIN INCIDENT REPORT'", "'Incident Code: ' || sku",
    "'Supplier: ' || supplier_name || ' (ID: ' || supplier_id || ')'",
    "'Region: ' || region || ' | Category: ' || product_type",
    "'Reliability Score: ' || printf('%.1f', reliability_score) || '/100'", "''", "'Logistics:'",
    "'  Warehouse Location: ' || warehouse_location", "'  Shipment Status: ' || shipment_status",
    "'  Delivery Delay: ' || printf('%.1f', delivery_delay_days) || ' days'",
    "'  Transportation Cost: $' || format('{:,.2f}', transportation_cost)", "''", "'Inventory:'",
    "'  Current Level: ' || printf('%.0f', inventory_level) || ' units'",
    "'  Demand Forecast: ' || printf('%.0f', demand_forecast) || ' units'",
    "'  Coverage Ratio: ' || printf('%.2f', cover) || ' (' || CASE WHEN cover < 0.5 THEN 'STOCKOUT RISK' ELSE 'ADEQUATE' END || ')'",
    "''", "'Incident:'", "'  Title: ' || title", "'  Description: ' || description",
    "'  Severity: ' || upper(rule_severity)", "'  Category: ' || category", "'  Date: ' || ts_text",
    "'  Resolution: ' || resolution_status"])


@query("docs_record_text", oracle(
    f"SELECT 'record_' || sku || '_' || supplier_id AS chunk_id, {_RECORD_TEXT} AS text FROM formatted"))
def docs_record_text(spark, sf):
    return documents.record_documents(frames.formatted(spark, sf)).select("chunk_id", "text")


@query("docs_record_metadata", oracle("""
SELECT 'record_' || sku || '_' || supplier_id AS chunk_id, supplier_id, region, rule_severity AS severity,
  category AS incident_category, warehouse_location, shipment_status, CAST(printf('%.4f', cover) AS DOUBLE) AS coverage_ratio,
  CAST(printf('%.2f', transportation_cost) AS DOUBLE) AS transportation_cost, resolution_status, ts_text AS occurred_at,
  CAST(year(occurred_at) AS INT) AS year, CAST(month(occurred_at) AS INT) AS month
FROM formatted"""))
def docs_record_metadata(spark, sf):
    m = documents.record_documents(frames.formatted(spark, sf)).select("chunk_id", "metadata.*")
    return m.select(
        "chunk_id", "supplier_id", "region", "severity", "incident_category", "warehouse_location",
        "shipment_status", "coverage_ratio", "transportation_cost", "resolution_status", "occurred_at", "year", "month")


@query("docs_supplier_stats", oracle("""
SELECT supplier_id, name, region, category, round(avg_delay, 6) AS avg_delay, round(avg_reliability, 6) AS avg_reliability,
  critical_count, high_count, total FROM supplier_stats"""))
def docs_supplier_stats(spark, sf):
    return documents.supplier_stats(frames.formatted(spark, sf), fx.ORDER).select(
        "supplier_id", "name", "region", "category", R6("avg_delay"), R6("avg_reliability"), "critical_count",
        "high_count", "total")


_RECENT = """
SELECT supplier_id, string_agg('  [' || ts_text || '] ' || title || ' (' || upper(rule_severity) || ')', chr(10)
  ORDER BY row_seq) AS recent
FROM (SELECT * FROM formatted QUALIFY row_number() OVER (PARTITION BY supplier_id ORDER BY row_seq) <= 5)
GROUP BY supplier_id"""


@query("docs_recent", oracle(_RECENT))
def docs_recent(spark, sf):
    return documents.recent_incidents(frames.formatted(spark, sf), fx.ORDER)


@query("docs_risk_label", oracle("SELECT supplier_id, risk_level FROM supplier_stats"))
def docs_risk_label(spark, sf):
    return documents.supplier_stats(frames.formatted(spark, sf), fx.ORDER).select("supplier_id", "risk_level")


_LABEL = "CASE risk_level " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in documents.RISK_LABELS.items()) + " END"
_SUMMARY_TEXT = _sql_lines([
    "'SUPPLIER PERFORMANCE SUMMARY'", "'Supplier: ' || name || ' (ID: ' || supplier_id || ')'",
    "'Region: ' || region || ' | Category: ' || category", "'Total Incidents on Record: ' || total", "''",
    "'Performance Metrics:'", "'  Average Reliability Score: ' || printf('%.1f', avg_reliability) || '/100'",
    "'  Average Delivery Delay: ' || printf('%.1f', avg_delay) || ' days'",
    "'  Critical Incidents: ' || critical_count", "'  High-Severity Incidents: ' || high_count", "''",
    "'Recent Incident History:'", "recent", "''", f"'Risk Assessment: ' || {_LABEL}"])


@query("docs_summary_text", oracle(f"""
SELECT 'supplier_summary_' || supplier_id AS chunk_id, {_SUMMARY_TEXT} AS text
FROM supplier_stats JOIN ({_RECENT}) USING (supplier_id)"""))
def docs_summary_text(spark, sf):
    return documents.supplier_documents(frames.formatted(spark, sf), fx.ORDER).select("chunk_id", "text")


@query("docs_union", oracle("""
SELECT 'record_' || sku || '_' || supplier_id AS chunk_id, 'record' AS chunk_type, supplier_id AS supplier_ref
FROM formatted UNION ALL
SELECT 'supplier_summary_' || supplier_id, 'supplier_summary', supplier_id FROM supplier_stats"""))
def docs_union(spark, sf):
    return documents.documents(frames.formatted(spark, sf), fx.ORDER).select("chunk_id", "chunk_type", "supplier_ref")


@query("docs_link", oracle("""
SELECT incident_code, 'record_' || incident_code || '_' || supplier_ref AS document_id FROM incidents"""))
def docs_link(spark, sf):
    df = frames.formatted(spark, sf)
    return documents.link_incidents(incidents.incident_rows(df, fx.ORDER), df, fx.ORDER).select(
        "incident_code", "document_id")


@query("order_row_numbers", oracle("SELECT row_seq, sku FROM canonical"))
def order_row_numbers(spark, sf):
    return number_rows(fx.canonical(spark, sf, ["sku"]), fx.ORDER).select("row_seq", "sku")
