import pytest

from tidemark.config import Config
from tidemark.schema import COLUMNS
from tidemark.sources import csv

GOOGLE = "campaign_id, segments_date ,metrics_clicks,metrics_conversions,metrics_cost_micros,metrics_impressions,metrics_video_views,metrics_conversions_value,campaign_advertising_channel_type,campaign_budget_amount,campaign_name\n"
META = "campaign_id,date_start,cpc,spend,clicks,impressions,conversion,daily_budget,campaign_name\n"
BING = "CampaignId,TimePeriod,Revenue,Spend,Clicks,Impressions,Conversions,CampaignType,DailyBudget,CampaignName\n"


@pytest.fixture
def exports(tmp_path):
    (tmp_path / "google_ads.csv").write_text(GOOGLE + "11,2024-01-02,5,1.5,46980000,100,0,12.5, SEARCH   , 90.0 ,Name\n12,2024-01-02,bad,,oops,7.9,0,,SEARCH,,nan\n")
    (tmp_path / "meta.csv").write_text(META + "120210000000000001,2024-01-03,0.1,9.5,3.0,50,20.5,,Prospecting_US_1\n7,2024-01-03,0.1,nan,3.7,50,1,,\n")
    (tmp_path / "bing.csv").write_text(BING + "  42 , 2024-01-04 ,8,4,2,10,1, Search ,15,B\n")
    return str(tmp_path)


def test_ingest_reads_all_dialects(spark, exports):
    rows = {r.campaign_id: r for r in csv.ingest(spark, exports).collect()}
    assert set(rows) == {"google_11", "google_12", "meta_120210000000000001", "meta_7", "bing_42"}
    g = rows["google_11"]
    assert (g.spend, g.revenue, g.clicks, g.campaign_type, g.daily_budget, str(g.date)) == (46.98, 12.5, 5, "SEARCH", 90.0, "2024-01-02")
    bad = rows["google_12"]
    assert (bad.spend, bad.revenue, bad.clicks, bad.impressions, bad.campaign_name) == (None, 0.0, 0, 7, None)
    m = rows["meta_120210000000000001"]
    assert (m.spend, m.revenue, m.conversions, m.campaign_type, m.daily_budget) == (9.5, 20.5, 0.0, "Prospecting", 0.0)
    assert rows["meta_7"].campaign_type == "unknown" and rows["meta_7"].spend == 0.0 and rows["meta_7"].clicks == 3
    assert rows["bing_42"].campaign_type == "Search" and str(rows["bing_42"].date) == "2024-01-04"


def test_files_are_found_in_order(spark, exports):
    assert [p.rsplit("/", 1)[1] for p in csv.discover(spark, exports)] == ["bing.csv", "google_ads.csv", "meta.csv"]


def test_missing_directory_and_unknown_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        csv.discover(spark, str(tmp_path / "none"))
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    with pytest.raises(csv.IngestionError):
        csv.ingest(spark, str(tmp_path))


def test_a_missing_column_is_told(spark):
    df = spark.createDataFrame([("1", "2024-01-01", "1", "2", "x", "Search")], "CampaignId string, TimePeriod string, Revenue string, Spend string, CampaignName string, CampaignType string")
    with pytest.raises(ValueError, match="Clicks"):
        csv.BING(df)


def test_own_dialects_can_be_added(spark, tmp_path):
    (tmp_path / "own.csv").write_text("day,money\n2024-01-01,3\n")
    registry = csv.Registry()
    registry.add(csv.Dialect("own", frozenset({"day", "money"}), lambda raw: raw.selectExpr("to_date(day) AS date", "'meta' AS channel", "'meta_1' AS campaign_id", "'n' AS campaign_name", "'t' AS campaign_type", "cast(money AS double) AS spend", "0D AS revenue", "0L AS clicks", "0L AS impressions", "0D AS conversions", "0D AS daily_budget")))
    assert csv.ingest(spark, str(tmp_path), registry).select("spend").first()[0] == 3.0
    assert tuple(csv.ingest(spark, str(tmp_path), registry).columns) == COLUMNS


def test_config_layers(tmp_path):
    (tmp_path / "c.yaml").write_text("decision:\n  min_roas_target: 2.0\nreport:\n  decimal_places: null\n")
    config = Config(str(tmp_path / "c.yaml"), environ={"FC_DECISION__VOLATILITY_THRESHOLD": "0.7"})
    assert config.get("decision.min_roas_target") == 2.0
    assert config.get("decision.volatility_threshold") == 0.7
    assert config.get("decision.concentration_threshold") == 0.6
    assert config.get("report.decimal_places", 3) == 3
    assert config.get("no.such.name", 5) == 5


def rows_of(df):
    return sorted(map(repr, df.collect()))


def test_data_source_equals_ingest(spark, exports):
    from tidemark.sources import exports as source

    source.register(spark)
    got = spark.read.format("campaign_exports").load(exports)
    assert tuple(got.columns) == COLUMNS and got.rdd.getNumPartitions() == 3
    assert rows_of(got) == rows_of(csv.ingest(spark, exports))


def test_data_source_parses_as_the_expressions_do(spark, tmp_path):
    """Odd numbers and texts, quotes, empty files with a header alone."""
    from tidemark.sources import exports as source

    odd = ["1", " 2.5 ", "+3", "-.5", "1e3", "1E-2", "nan", "NaN", "", "n/a", "1,5", "--1", "7.", "0x10", "12 3", '"4"', '""']
    lines = "".join(f'" 4{i}",2024-01-04,{q},{q},{q},1,{q}, Search ,"{v.strip(chr(34))}",{n}\n' for i, v in enumerate(odd) for q in [f'"{v.strip(chr(34))}"'] for n in ["nan" if i % 2 else '"a, b"'])
    (tmp_path / "bing.csv").write_text(BING + lines)
    (tmp_path / "meta.csv").write_text(META)
    (tmp_path / "meta2.csv").write_text(META + "".join(f"{i},2024-01-03,1,1,1,1,1,1,{n}\n" for i, n in enumerate(["_x", "a_b", "", "nan", " p_q "])))
    source.register(spark)
    assert rows_of(spark.read.format("campaign_exports").load(str(tmp_path))) == rows_of(csv.ingest(spark, str(tmp_path)))


def test_data_source_tells_what_is_wrong(spark, tmp_path):
    from tidemark.sources import exports as source

    source.register(spark)
    (tmp_path / "a").mkdir()
    with pytest.raises(Exception, match="no CSV files"):
        spark.read.format("campaign_exports").load(str(tmp_path / "a")).count()
    (tmp_path / "a" / "x.csv").write_text("a,b\n1,2\n")
    with pytest.raises(Exception, match="no dialect fits"):
        spark.read.format("campaign_exports").load(str(tmp_path / "a")).count()
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.csv").write_text(BING.replace("Clicks,", "") + "4,2024-01-04,8,4,10,1,Search,15,B\n")
    with pytest.raises(Exception, match="missing required columns.*Clicks"):
        spark.read.format("campaign_exports").load(str(tmp_path / "b")).count()
    with pytest.raises(Exception, match="needs a folder"):
        spark.read.format("campaign_exports").load().count()


def test_data_source_takes_own_layouts(spark, tmp_path):
    from tidemark.sources import exports as source

    own = source.Layout("meta", frozenset({"day", "money"}), frozenset({"day", "money"}), {"channel": source.Field(None, constant="meta"), "date": source.Field("day", "date"), "spend": source.Field("money", "number", 100.0)} | {c: source.Field(None) for c in COLUMNS if c not in ("channel", "date", "spend")})

    class Mine(source.ExportSource):
        layouts = (*source.LAYOUTS, own)

    (tmp_path / "own.csv").write_text("day,money\n2024-01-01,300\n")
    try:
        source.register(spark, Mine)
        assert spark.read.format("campaign_exports").load(str(tmp_path)).select("spend", "channel", "clicks").first() == (3.0, "meta", None)
    finally:
        source.register(spark)


def test_stream_of_exports(spark, exports, tmp_path_factory):
    """What comes later is read once; a restart goes on."""
    import pathlib

    from tidemark.sources import exports as source

    source.register(spark)
    out, checkpoint = (str(tmp_path_factory.mktemp(n)) for n in ("out", "checkpoint"))

    def run():
        stream = spark.readStream.format("campaign_exports").load(exports)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return rows_of(spark.read.parquet(out))

    assert run() == rows_of(csv.ingest(spark, exports))
    (pathlib.Path(exports) / "a_later.csv").write_text(BING + "43,2024-01-04,8,4,2,10,1,Search,15,B\n")
    assert run() == run() == rows_of(csv.ingest(spark, exports))
