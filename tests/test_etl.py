from datetime import datetime

import pytest
from pyspark.sql import functions as F

from riskspark.functions.columns import parse_time, to_double
from riskspark.operators import anomaly, derive, documents, incidents, mapping, validate
from riskspark.plans import etl
from riskspark.session import scratch_path
from riskspark.sources import files

AS_OF = datetime(2024, 6, 30, 12, 0, 0)

SAMPLE = [
    ("INC-00001", "SUP-A7", "Northwind Parts", "Baltic", "Valves", 64.0, "Riga", "Delayed", 18.0, 38250.0,
     120.0, 800.0, "supplier", "Late sea leg", "Vessel held at port", "2024-03-11", "open"),
    ("INC-00002", "SUP-A7", "Northwind Parts", "Baltic", "Valves", 64.0, "Tallinn", "In-Transit", 3.0,
     9100.0, 500.0, 600.0, "inventory", "Thin stock", "Below target", "2024-03-12", "in_progress"),
]
SAMPLE_COLUMNS = (
    "IncidentCode string, SupplierID string, SupplierName string, Region string, SupplierCategory string, "
    "ReliabilityScore double, WarehouseLocation string, ShipmentStatus string, DeliveryDelayDays double, "
    "TransportationCost double, InventoryLevel double, DemandForecast double, IncidentCategory string, Title string, "
    "Description string, OccurredAt string, ResolutionStatus string")


@pytest.fixture
def sample(spark):
    return spark.createDataFrame(SAMPLE, SAMPLE_COLUMNS)


def test_documents_of_the_sample(sample):
    chunks = documents.documents(sample, ["IncidentCode"]).collect()
    records = [c for c in chunks if c.chunk_type == "record"]
    summaries = [c for c in chunks if c.chunk_type == "supplier_summary"]
    assert (len(records), len(summaries)) == (2, 1)
    first = next(r for r in records if r.chunk_id == "record_INC-00001_SUP-A7")
    assert first.metadata.severity == "critical" and first.metadata.coverage_ratio == 0.15
    assert (first.metadata.year, first.metadata.month) == (2024, 3)
    assert "  Transportation Cost: $38,250.00\n" in first.text
    assert "  Coverage Ratio: 0.15 (STOCKOUT RISK)\n" in first.text
    assert first.text.startswith("SUPPLY CHAIN INCIDENT REPORT\nIncident Code: INC-00001\n")
    text = summaries[0].text
    assert "Average Delivery Delay: 10.5 days" in text and "HIGH RISK SUPPLIER" in text
    assert "  [2024-03-11] Late sea leg (CRITICAL)\n  [2024-03-12] Thin stock (LOW)\n" in text
    assert summaries[0].metadata.total_incidents == 2


def test_missing_supplier_has_no_summary(sample):
    df = sample.withColumn("SupplierID", F.when(F.col("IncidentCode") == "INC-00001", F.col("SupplierID")))
    ids = [c.chunk_id for c in documents.documents(df, ["IncidentCode"]).collect()]
    assert "record_INC-00002_N/A" in ids and "supplier_summary_SUP-A7" in ids and len(ids) == 3


def test_missing_codes_are_numbered(spark):
    rows = [(i, None if i % 2 else f"C{i}") for i in range(6)]
    df = spark.createDataFrame(rows, "n int, IncidentCode string").withColumn("SupplierID", F.lit("S"))
    got = documents.fill_codes(df, ["n"]).orderBy("n").collect()
    assert [r.IncidentCode for r in got] == ["C0", "INC-00001", "C2", "INC-00003", "C4", "INC-00005"]


def test_incidents_keep_the_first_row_of_a_code(sample):
    twice = sample.withColumn("n", F.lit(1)).unionByName(
        sample.withColumn("n", F.lit(2)).withColumn("Title", F.lit("again")))
    rows = incidents.incident_rows(twice, ["n"]).collect()
    assert len(rows) == 2 and all(r.title != "again" for r in rows)
    new = incidents.incident_rows(sample, ["IncidentCode"])
    table = incidents.insert_new(new.filter("incident_code = 'INC-00001'"), new)
    assert table.count() == 2
    assert incidents.rejected(table, new).count() == 2 and incidents.accepted(table, new).count() == 0


def test_supplier_upsert_keeps_names(spark):
    cols = "id string, supplier_id string, name string, region string, category string, reliability_score double, " \
           "avg_delay_days double, active_orders long, risk_level string"
    old = spark.createDataFrame([("1", "A", "Old", "EU", "c", 50.0, 1.0, 3, "low")], cols)
    new = spark.createDataFrame(
        [("9", "A", "New", "US", "d", 60.0, 2.0, 4, "high"), ("2", "B", "Bee", "US", "d", 1.0, 1.0, 1, "low")], cols)
    rows = {r.supplier_id: r for r in incidents.upsert_suppliers(old, new).collect()}
    assert rows["A"].asDict() == {
        "id": "1", "supplier_id": "A", "name": "Old", "region": "EU", "category": "c", "reliability_score": 60.0,
        "avg_delay_days": 2.0, "active_orders": 4, "risk_level": "high"}
    assert rows["B"].name == "Bee"


def test_patch_and_delete(spark):
    table = spark.createDataFrame([("1", "a", "open"), ("2", "b", "open")], "id string, t string, s string")
    changes = spark.createDataFrame([("1", None, "closed")], "id string, t string, s string")
    got = {r.id: (r.t, r.s) for r in incidents.patch(table, changes).collect()}
    assert got == {"1": ("a", "closed"), "2": ("b", "open")}
    assert [r.id for r in incidents.delete_rows(table, changes).collect()] == ["2"]


def derived(spark, rows, cols, **kw):
    df = derive.cast_types(spark.createDataFrame(rows, cols))
    return derive.derive_fields(df, AS_OF, ["n"], **kw)


def test_defect_rate_is_divided_by_its_maximum(spark):
    out, names = derived(spark, [(1, "50"), (2, "10"), (3, None)], "n int, defect_rate string")
    assert [r.defect_rate for r in out.orderBy("n").collect()] == [1.0, 0.2, 0.0]
    assert any(n.startswith("defect_rate (normalised") for n in names)


def test_identity_from_name_or_position(spark):
    out, _ = derived(spark, [(1, "Acme & Co"), (2, "B")], "n int, supplier_name string")
    assert [r.supplier_id for r in out.orderBy("n").collect()] == ["acme-co", "b"]
    out, _ = derived(spark, [(5, ""), (3, "")], "n int, supplier_name string")
    rows = out.orderBy("n").collect()
    assert [r.supplier_id for r in rows] == ["SUP-0001", "SUP-0002"]
    assert [r.sku for r in rows] == ["INC-ETL-00001", "INC-ETL-00002"]


def test_timestamps_spread_over_thirty_days(spark):
    out, _ = derived(spark, [(i, "x") for i in range(4)], "n int, sku string")
    got = [r.timestamp for r in out.orderBy("n").collect()]
    # row i: int(i / 3 * 30) days and i hours back
    assert got == ["2024-06-30T12:00:00", "2024-06-20T11:00:00", "2024-06-10T10:00:00", "2024-05-31T09:00:00"]


def test_delay_derived_after_thresholds(spark):
    rows = [(1, "10", "0"), (2, "20", "0"), (3, "0", "0")]
    out, _ = derived(spark, rows, "n int, lead_time_days string, delivery_delay_days string")
    got = {r.n: (r.delivery_delay_days, r.severity, r.shipment_status) for r in out.collect()}
    assert got[1] == (2.0, "critical", "In-Transit") and got[2] == (4.0, "critical", "Delayed")
    assert got[3] == (0.0, "low", "On-Time")
    out, _ = derived(spark, rows, "n int, lead_time_days string, delivery_delay_days string", recompute=True)
    assert {r.n: r.severity for r in out.collect()} == {1: "low", 2: "critical", 3: "low"}


def test_empty_batch(spark):
    out, _ = derived(spark, [], "n int, sku string, supplier_name string, delivery_delay_days string")
    assert out.count() == 0


def test_pipeline_texts(spark):
    df = spark.createDataFrame(
        [(1, "K1", "Acme", "Oslo", 0.02, 50.0, 0.0, 0.0, -2.0, 1234.5, ""),
         (2, "K2", "", "N/A", 0.0, 10.0, 100.0, 25.0, 9.0, 0.0, "Failed"),
         (3, "K3", "Bee", "", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, "")],
        "n int, sku string, supplier_name string, warehouse_location string, defect_rate double, inventory_level double, "
        "demand_forecast double, lead_time_days double, delivery_delay_days double, transportation_cost double, "
        "inspection_status string")
    a, b, c = derive.to_pipeline(df).orderBy("n").collect()
    assert a.Title == "K1: Supply chain risk detected — Acme, Oslo"
    assert a.Description == ("Defect rate: 2.00%. Stock: 50 units vs 1 forecast (ratio: 50.00). "
                             "Early delivery: 2.0 days ahead. Transport cost: $1,234.")
    assert b.Title == "K2: Defect rate 0.0% critical — Unknown" and b.IncidentCategory == "supplier"
    assert c.Title == "K3: Stock level 0 units, stockout imminent — Bee" and c.IncidentCategory == "inventory"
    assert a.ResolutionStatus == "open" and a.Region == ""


def test_validation(spark):
    df = spark.createDataFrame(
        [(1, "S", "N", "X", 5.0, 1.0, -1.0, 0.5, "low", "Pass"), (2, "", "", "X", 5.0, 1.0, 0.0, 2.0, "weird", "Odd"),
         (3, "", "", "", 0.0, 0.0, 0.0, 0.0, "low", ""), (4, "S", "", "", 0.0, 0.0, 1.0, -0.5, "HIGH", "PASS")],
        "n int, supplier_id string, supplier_name string, warehouse_location string, inventory_level double, "
        "demand_forecast double, delivery_delay_days double, defect_rate double, severity string, "
        "inspection_status string")
    checked = validate.check_rows(df)
    rows = {r.n: r for r in checked.collect()}
    assert rows[1].errors == [] and "early delivery" in rows[1].warnings[0]
    assert len(rows[2].errors) == 1 and rows[2].defect_rate == 1.0 and rows[2].severity == "medium"
    assert len(rows[3].errors) == 2
    assert rows[4].defect_rate == 0.0 and rows[4].severity == "HIGH" and len(rows[4].warnings) == 2
    s = validate.summary(checked).first()
    assert (s.total, s.failed_count, s.warning_count, s.valid_count, s.pass_rate, s.is_valid) == (4, 2, 2, 0, 50.0, True)
    assert validate.keep_valid(checked).count() == 2
    messages = validate.dataset_messages(df.drop("inventory_level")).collect()
    assert {m.field for m in messages if m.level == "error"} == {"inventory_level"}


def frame(spark, delays, stock=None, defects=None, names=None):
    n = len(delays)
    rows = [
        (i, (names or ["s"] * n)[i], f"k{i}", "loc", float(delays[i]), 10.0, float((defects or [0.1] * n)[i]),
         float((stock or [100] * n)[i]), 50.0)
        for i in range(n)
    ]
    return spark.createDataFrame(
        rows, "n int, supplier_name string, sku string, warehouse_location string, delivery_delay_days double, "
              "transportation_cost double, defect_rate double, inventory_level double, demand_forecast double")


def test_outliers_skip_constant_columns(spark):
    df = frame(spark, [0] * 30 + [50])
    rows = anomaly.outliers(df).collect()
    assert [(r.field, r.severity, r.value) for r in rows] == [("delivery_delay_days", "critical", 50.0)]
    assert rows[0].description == "Delivery Delay Days is 5.4σ above normal (value: 50.00, avg: 1.61)"


def test_trend(spark):
    assert anomaly.delay_trend(frame(spark, [9, *range(10)]), ["n"]).count() == 1
    assert anomaly.delay_trend(frame(spark, [9, *range(8), 3, 9]), ["n"]).count() == 0
    assert anomaly.delay_trend(frame(spark, [5] * 12), ["n"]).count() == 0
    assert anomaly.delay_trend(frame(spark, range(9)), ["n"]).count() == 0
    # early deliveries count as 0
    assert anomaly.delay_trend(frame(spark, [-3, -9, -1, 0, 1, 2, 3, 4, 5, 6]), ["n"]).count() == 1


def test_stockouts_and_spikes(spark):
    df = frame(spark, [0] * 20, stock=[2, 3] + [100] * 18)
    assert sorted((r.sku, r.severity) for r in anomaly.stockouts(df).collect()) == [("k0", "critical"), ("k1", "high")]
    df = frame(spark, [0] * 10, defects=[0.9] + [0.0] * 9, names=["bad"] + ["ok"] * 9)
    spike = anomaly.defect_spikes(df).collect()
    assert [(r.supplier_name, r.severity) for r in spike] == [("bad", "critical")]
    assert anomaly.defect_spikes(frame(spark, [0] * 3, defects=[0, 0, 0])).count() == 0
    found = anomaly.to_incidents(anomaly.detect(df, ["n"]), AS_OF).collect()
    assert {r.category for r in found} <= {"supplier", "inventory", "shipment"}
    assert all(r.incident_code.startswith("ANO-") for r in found)


def test_all_anomalies_in_three_scans(spark, tmp_path):
    stock = [2, 3] + [100] * 28
    frame(spark, [0] * 20 + list(range(9)) + [90], stock=stock, defects=[0.9] + [0.0] * 29,
          names=["bad"] + ["ok"] * 27 + [None] * 2).write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    every = anomaly.detect(df, ["n"])
    # two scans are left: the means come from what the first one wrote
    assert every._jdf.queryExecution().executedPlan().toString().count("/rows]") == 2
    parts = [anomaly.outliers(df), anomaly.stockouts(df), anomaly.delay_trend(df, ["n"]), anomaly.defect_spikes(df)]
    want = sorted(str(r) for p in parts for r in p.select(*anomaly.EVENT_COLUMNS).collect())
    assert every.columns == anomaly.EVENT_COLUMNS
    assert sorted(str(r) for r in every.collect()) == want and len({r.split(",")[0] for r in want}) == 4
    assert anomaly.detect(df.limit(0), ["n"]).count() == 0


def test_detect_and_apply_mapping(spark):
    rows = [(i, f"v{i}", "Road" if i % 2 else "Air", str(i / 100), f"2024-01-{i + 1:02d}", str(i * 7), "zz")
            for i in range(12)]
    raw = spark.createDataFrame(
        rows, "n int, `Vendor ID` string, how string, zq string, booked string, `Stok Level` string, xx string")
    report = mapping.detect_frame(raw, ["n"])
    got = {r.field: (r.source_column, r.match_layer, r.transform) for r in report.collect() if r.source_column}
    assert got["supplier_id"] == ("Vendor ID", "exact", "direct")
    assert got["transportation_mode"] == ("how", "dtype", "direct")
    assert got["timestamp"] == ("booked", "dtype", "date_parse")
    assert got["defect_rate"] == ("zq", "dtype", "direct")
    assert got["inventory_level"] == ("Stok Level", "fuzzy", "direct")
    assert report.count() == 23
    out = mapping.apply_mapping(raw, mapping.mapping_from_report(report), keep=["n"]).orderBy("n").first()
    assert out.supplier_id == "v0" and out.timestamp == "2024-01-01 00:00:00" and out["_raw_Vendor ID"] == "v0"


def test_vote_combination(spark):
    rows = [(1, "a", None, None, None, None), (2, None, "x", 0.9, "x", 0.92), (3, None, "x", 0.9, "y", 0.85),
            (4, None, "x", 0.7, "y", 0.8), (5, None, None, None, "y", 0.7), (6, None, "x", 0.99, "x", 0.92),
            (7, None, None, None, None, None)]
    df = spark.createDataFrame(
        rows, "n int, exact string, fuzzy string, fuzzy_score double, inferred string, inferred_score double"
    ).withColumn("inferred_transform", F.lit("direct"))
    got = {r.n: (r.field, None if r.confidence is None else round(r.confidence, 3), r.layer)
           for r in mapping.combine(df).collect()}
    assert got == {
        1: ("a", 0.95, "exact"), 2: ("x", 0.97, "fuzzy+dtype"), 3: ("y", 0.85, "dtype"), 4: ("x", 0.7, "fuzzy"),
        5: ("y", 0.7, "dtype"), 6: ("x", 1.0, "fuzzy+dtype"), 7: (None, None, None)}


def test_registry(spark):
    reg = spark.createDataFrame(
        [("1", "A", ["a", "b", "c", "d"], 0.5, datetime(2024, 1, 1), datetime(2024, 1, 1)),
         ("2", "B", ["a", "b", "c", "e"], 0.5, datetime(2024, 1, 1), datetime(2024, 1, 2))],
        "id string, company_id string, source_columns array<string>, confidence_score double, "
        "created_at timestamp_ntz, last_used_at timestamp_ntz")
    up = spark.createDataFrame([("u", ["a", "b", "c", "d", "e"]), ("v", ["a", "x"])], "upload_id string, columns array<string>")
    # both overlap by 4 of 5; the more recently used wins
    assert [(r.upload_id, r.company_id, r.overlap) for r in mapping.match_saved(up, reg).collect()] == [("u", "B", 0.8)]
    touched = mapping.touch_mapping(reg, "A", datetime(2024, 5, 1))
    assert [r.company_id for r in mapping.list_mappings(touched).collect()] == ["A", "B"]
    assert mapping.delete_mapping(reg, "1").count() == 1 and mapping.get_mapping(reg, "B").count() == 1


CSV = """Vendor ID,Supplier,Stock,Demand,Warehouse,Delay Days,Shipping Cost,Defect Rate,SKU,Date
V1,Acme,10,100,Oslo,9,100,0.01,K1,2024-01-05
V1,Acme,90,100,Oslo,-1,120,0.02,K2,2024-01-06
V2,Bee,70,100,Rome,2,90,0.03,K2,2024-01-07
,,,,,,,,K4,
"""


def test_csv_to_warehouse(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(CSV)
    home = etl.Warehouse.at(spark, str(tmp_path / "home"))
    first = etl.ingest_csv(spark, str(tmp_path / "in"), home, AS_OF)
    assert first["suppliers_total"] == 2 and first["chunks_total"] == 5
    again = etl.ingest_csv(spark, str(tmp_path / "in"), home, AS_OF)
    assert again == {**first, "incidents_inserted": 0}
    assert home.index().doc_stats.count() == home.vectors.count() == 5
    codes = {r.incident_code: r.supplier_ref for r in home.incidents.read().collect()}
    assert codes["K2"] == "V1" and "K4" not in codes


def test_csv_rows_keep_their_order(spark, tmp_path):
    for f in range(3):
        lines = "\n".join(str(f * 1000 + i) for i in range(1000))
        (tmp_path / f"part-{f}.csv").write_text(f"x\n{lines}\n")
    df = files.read_csv(spark, str(tmp_path))
    got = [int(r.x) for r in df.orderBy(*files.FILE_ORDER).collect()]
    assert got == list(range(3000))


def test_repeated_chunk_ids_and_null_words(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(
        "Vendor ID,Supplier,Stock,Demand,Warehouse,Delay Days,SKU,Note\n"
        'V1,Acme,10,100,Oslo,9,K1,"two\nlines"\nV1,Acme,20,100,Oslo,9,K1,x\nN/A,NA,5,5,Oslo,1,K9,y\n')
    home = etl.Warehouse.at(spark, str(tmp_path / "home"))
    counts = etl.ingest_csv(spark, str(tmp_path / "in"), home, AS_OF)
    chunks = home.chunks.read().collect()
    assert counts["chunks_total"] == len({c.chunk_id for c in chunks}) == len(chunks) == 2
    record = next(c for c in chunks if c.chunk_type == "record")
    assert record.metadata.inventory_level == 20.0
    assert home.suppliers.count() == 1
    etl.replace_documents(home.chunks.read().limit(1), home, reset=True)
    assert home.chunks.count() == home.vectors.count() == 1


def test_events_of_equal_prefix_have_their_own_codes(spark):
    events = spark.createDataFrame(
        [("stockout_risk", "inventory_level", 1.0, "a", f"SKU-00{i}", "x", "high", f"d{i}") for i in range(50)],
        ", ".join(f"{c} {'double' if c == 'value' else 'string'}" for c in anomaly.EVENT_COLUMNS))
    codes = [r.incident_code for r in anomaly.to_incidents(events, AS_OF).collect()]
    assert len(set(codes)) == 50 and len({c[:10] for c in codes}) == 1


@pytest.mark.parametrize("text", ["Jan 5, 2024", "January 5, 2024", "5 January 2024", "5 Jan 2024", "05.01.2024", "20240105",
                                  "2024-01-05", "1/5/2024", "5-Jan-2024"])
def test_date_layouts(spark, text):
    row = spark.range(1).select(parse_time(F.lit(text)).alias("t")).first()
    assert row.t == datetime(2024, 1, 5)


def test_preview_uses_its_own_thresholds(spark):
    raw = spark.createDataFrame([(i, str(i % 4)) for i in range(100)], "n int, delay string")
    same = {"delivery_delay_days": {"source_column": "delay", "transform": "direct"}}
    assert etl.preview(raw, same, AS_OF, ["n"]).count() == 10


def test_saved_mappings_are_found_through_rare_headers(spark):
    import random

    rng = random.Random(6)
    common = [f"common {i}" for i in range(6)]
    draw = lambda g: common + [f"g{g} {i}" for i in range(8) if rng.random() < 0.85] + [f"x{rng.randrange(9)}"]
    saved = [(f"c{i}", draw(i % 40), datetime(2024, 1, 1 + i % 28)) for i in range(160)]
    up = [(f"u{i}", draw(i % 50)) for i in range(100)] + [("none", []), ("same", saved[7][1])]
    uploads = spark.createDataFrame(up, "upload_id string, columns array<string>")
    registry = spark.createDataFrame(saved, "company_id string, source_columns array<string>, last_used_at timestamp")
    want = set()
    for u, headers in up:
        near = [(t, c, len(set(headers) & set(s)) / len(set(headers) | set(s))) for c, s, t in saved]
        near = [x for x in near if x[2] > 0.7]
        if near:
            want.add((u, max(near)[1], max(near)[2]))
    got = mapping.match_saved(uploads, registry)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 60
    # 40 of 50 groups have mappings, 4 each: pairs that share only the six common headers are not built
    sets = mapping.alike_candidates(
        uploads.select(F.sort_array("columns").alias("up")).distinct(),
        registry.select(F.sort_array("source_columns").alias("saved")).distinct(), 0.7)
    rare = F.filter(F.array_intersect("up", "saved"), lambda h: ~h.startswith("common"))
    assert sets.filter(F.size(rare) == 0).count() == 0
    assert sets.count() < 102 * 160 / 10


def test_profile_casts_only_what_may_be_a_number(spark):
    texts = ["1", " 7 ", "-2.5", "+3", "1e5", "1E-5", "1e+5", ".5", "5.", "1d", "2F", "0x1p3", "0x1.8P-1", "inf", "-Infinity", "+inf",
             "NaN", "nan", "Road", "Fail", "Pending", "2024-01-05", "note 3", "1,000", "3/4", "12:30", "", "-", "1-2", "e5"]
    values = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "upload_id int, position int, value string")
    numbers = {r.position: (r.numbers, r.low) for r in mapping.profile(values).collect()}
    every = values.select("position", to_double(F.col("value")).alias("x")).collect()
    assert numbers == {r.position: (int(r.x is not None), r.x) for r in every}
    tried = {r.value for r in values.filter(mapping._may_be_number(F.col("value"))).collect()}
    assert tried.isdisjoint({"Road", "Fail", "2024-01-05", "note 3", "1-2"})


def test_first_line_of_a_code_is_chosen_before_the_joins(spark, tmp_path):
    from riskspark.plans import frames
    from riskspark.sources import fixtures as fx

    def put(name, rows):
        spark.createDataFrame(rows, fx.LAYOUTS[name]).write.parquet(str(tmp_path / f"{name}.parquet"))

    day = datetime(2024, 1, 2)
    line = lambda order, number, price, part=1: (
        order, part, 1, number, 5.0, price, 0.01, 0.02, "R", "F", day)
    put("lineitem", [line(1, 1, 30.0), line(1, 1, 20.0), line(1, 1, 20.0), line(1, 2, 10.0), line(2, 1, 10.0),
                     line(9, 1, 10.0), line(1, 3, 10.0, None), line(1, None, 40.0), line(1, None, 50.0)])
    put("orders", [(1, 1, "O", 1.0, day, "x"), (1, 1, "O", 1.0, day, "x"), (2, 1, "F", 1.0, day, "x")])
    put("part", [(1, "p", "b", "t", 3, 2.0)] * 2)
    put("supplier", [(1, "one", 1, 0.0)] * 2)
    put("nation", [(1, "N", 1)])
    put("region", [(1, "R")])
    found = frames.incident_table(spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Window")  # the joins are above
    rows = {r.incident_code: (r.resolution_status, r.transportation_cost) for r in found.collect()}
    assert found.count() == 4
    assert rows == {"INC-1-1-1-1": ("open", 0.4), "INC-1-2-1-1": ("open", 0.2), "INC-2-1-1-1": ("closed", 0.2),
                    "INC-1-1-1": ("open", 0.8)}


def test_search_makes_each_text_once(spark):
    from riskspark.operators import analytics

    rows = spark.createDataFrame([("Early", "x"), ("b", "so EARLY"), ("c", None), (None, "early"), (None, None)], "a string, b string")
    texts = rows.select(F.initcap("a").alias("title"), F.initcap("b").alias("description"))
    found = analytics.filter_incidents(texts, search="eaRly")
    assert found.columns == ["title", "description"]
    assert sorted(map(str, map(tuple, found.collect()))) == ["('B', 'So Early')", "('Early', 'X')", "(None, 'Early')"]
    # the condition is not moved below the step that makes the texts, where it would make them again
    assert found._jdf.queryExecution().optimizedPlan().toString().count("initcap") == 2


def test_large_files_are_not_dealt_out_before_the_joins(spark, tmp_path):
    from riskspark.sources import fixtures as fx

    spark.range(40_000).repartitionByRange(1, "id").write.parquet(str(tmp_path / "one"))
    rows = lambda: spark.read.parquet(str(tmp_path / "one"))
    assert len(rows().inputFiles()) == 1
    before = {key: spark.conf.get(key, None) for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    plan = lambda: fx.spread(rows())._jdf.queryExecution().toString()
    assert "Repartition" in plan()
    try:
        # as for a file of many blocks
        spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert "Repartition" not in plan()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_lines_are_not_shuffled_to_small_suppliers(spark):
    from riskspark.sources import fixtures as fx

    df = fx.canonical(spark, "/root/testdata/sf0.01", ["sku", "supplier_name", "warehouse_location", "region"])
    assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 60_000
