"""Provenance, geo, event log, timelines, sources and sinks on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from citeloom.functions import geo as GF
from citeloom.functions.discharge import parse_event_date
from citeloom.functions.provenance import humanize
from citeloom.operators import geo as G, provenance as P
from citeloom.operators.sections import prefix_words, sections
from citeloom.plans import index_build, search
from citeloom.catalog.fixtures import letter_embedder
from citeloom.sources import readers as S, sinks as K
from citeloom.sources.markdown_tables import table_rows

LEDGER = """intro
| not | a table |

| Title | Source URL | File (held) | Note |
|:--|---|---|--:|
| `Plan` | <https://x.org/a> | a.pdf | also b.pdf |
| |---| |
| Other | none | see a.pdf and c.txt | |
text ends it
| Title | File |
"""


def test_ledger_first_wins_and_note_column(spark):
    docs = spark.createDataFrame([("L1", LEDGER), ("L0", LEDGER.replace("`Plan`", "**First**"))], "slug string, text string")
    index = {(r["kind"], r["basename"]): (r["title"], r["url"], r["ledger"]) for r in P.ledger_index(P.ledger_entries(table_rows(docs))).collect()}
    assert index[("p", "a.pdf")] == ("First", "https://x.org/a", "L0")
    assert index[("s", "b.pdf")][0] == "First" and index[("p", "c.txt")] == ("Other", "", "L0")


def test_companions(spark):
    files = [("d", "d/a.pdf"), ("d", "d/a.txt"), ("d", "d/lone.txt"), ("d", "d/e.pdf"), ("d", "d/e.txt"), ("x", "x/a.txt")]
    index = [("p", "a.pdf", "Plan", "u", "L"), ("p", "e.pdf", "", "u2", "L")]
    rows = {r["file"]: (r["title"], r["tier"]) for r in P.manifest(
        spark.createDataFrame(files, "folder string, file string"),
        spark.createDataFrame(index, "kind string, basename string, title string, url string, ledger string")).collect()}
    assert rows["d/a.txt"] == ("Plan", "c") and rows["x/a.txt"] == ("A", None)
    assert rows["d/e.pdf"] == ("E", "p") and rows["d/e.txt"] == ("E", None) and rows["d/lone.txt"] == ("Lone", None)


def test_humanize(spark):
    name = spark.range(1).select(humanize(F.lit("2019-07_mwrd-tarp__status-v2-12.pdf"))).first()[0]
    assert name == "MWRD TARP Status V2 12"


@pytest.mark.parametrize("cell,iso,span,flags", [
    ("4/30-5/1/19", dt.date(2019, 4, 30), 1, ["range"]), ("12/31-1/2/20", dt.date(2019, 12, 31), 2, ["range"]),
    ("5/17-21/2020", dt.date(2020, 5, 17), 4, ["range"]), ("11/1713", dt.date(2013, 11, 17), 0, ["missing-slash"]),
    ("6/29/31", dt.date(1931, 6, 29), 0, []), ("41000", dt.date(2012, 4, 1), 0, ["serial"]), ("", None, None, ["no-date"]),
    ("2/30/19", None, None, ["unreadable"]), ("soon", None, None, ["unreadable"]),
])
def test_event_dates(spark, cell, iso, span, flags):
    row = spark.createDataFrame([(cell,)], "c string").select(parse_event_date(F.col("c")).alias("d")).first()["d"]
    assert (row["date_iso"], row["span_days"], row["flags"]) == (iso, span, flags)


def test_validity_edges(spark):
    rows = [(1900, 1950), (1951, None), (1800, 1899)]
    feats = spark.createDataFrame([(i, *r, "c") for i, r in enumerate(rows)], "id int, `from` int, `to` int, category string")
    at = lambda y: sorted(r["id"] for r in G.visible(feats, y).collect())
    assert (at(1900), at(1950), at(1951), at(1899)) == ([0], [0], [1], [2])
    by_rows = G.active_over_years(feats, 1890, 1960).groupBy("category", "year").agg(F.count("*").alias("active"))
    assert G.active_counts(feats, "category", 1890, 1960).exceptAll(by_rows).count() == 0
    assert by_rows.count() == 71


def test_cells_dedupe_against_first_source_only(spark):
    point = "id string, name string, lat double, lng double, `from` int, approx boolean, source string"
    first = spark.createDataFrame([("a", "A", 41.1, -87.1, None, None, "s" * 200)], point)
    second = spark.createDataFrame([("", n, 41.1001 if n == "Near A" else 41.5, -87.1, None, None, None) for n in ("Near A", "B one", "B two")], point)
    rows = {r["id"]: r for r in G.merge_shafts(first, second, second.limit(1)).collect()}
    assert set(rows) == {"a", "news-b-one", "news-b-two", "vent-near-a"}
    assert rows["a"]["from"] == 1985 and len(rows["a"]["note"]) == 200 and rows["vent-near-a"]["type"] == "air-vent"


def test_schematic_needs_three_km(spark):
    def check(points, traced=False, approx=True):
        df = spark.createDataFrame([(points, traced, approx)], "g array<array<double>>, t boolean, a boolean")
        return df.select(GF.is_schematic(F.col("t"), F.col("a"), F.col("g"))).first()[0]

    far, near = [[41.0, -87.0], [41.03, -87.0]], [[41.0, -87.0], [41.02, -87.0]]
    assert check(far) and not check(near) and not check(far, traced=True) and not check(far, approx=None)
    assert not check(far[:1]) and not check(far + far + far[:1])


def test_first_flow_spec_wins(spark):
    feats = spark.createDataFrame([("r", [[0.0, 0.0], [1.0, 1.0]])], "id string, geometry array<array<double>>")
    specs = spark.createDataFrame([("r", 0, 1850, 1899, 0.0, 0.0), ("r", 1, 1899, None, 1.0, 1.0)],
                                  "id string, ordinal int, `from` int, `to` int, dest_lat double, dest_lng double")
    at = lambda y: [(r["ordinal"], r["forward"]) for r in G.flow_at(feats, specs, F.lit(y)).collect()]
    assert (at(1899), at(1900), at(1840)) == ([(0, False)], [(1, True)], [])


def test_sections_of_a_document(spark):
    text = "---\ntitle: \"T\"\n---\n" + "intro " * 20 + "\n## A & B\n" + "body " * 10 + "\n### Short\nno\n## A & B\n" + "again " * 10
    rows = sections(spark.createDataFrame([("03-x", text)], "slug string, text string")).orderBy("ordinal").collect()
    assert [(r["id"], r["section"]) for r in rows] == [("03-x#top", "Overview"), ("03-x#a--b", "A & B"), ("03-x#short", "Short"), ("03-x#a--b", "A & B")]


def test_long_sections_are_whole(spark):
    rows = sections(spark.createDataFrame([("s", "## H\n" + "word " * 2000)], "slug string, text string")).collect()
    assert [len(r["text"]) for r in rows] == [9999]


def test_cut_off_files_fail(spark, tmp_path):
    (tmp_path / "layer.json").write_text('[{"id": "a"}, {"id')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        S.scan_json_layer(spark, str(tmp_path / "layer.json"), "features", "id string").collect()
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.js").write_text("window.X = {\"events\": [")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        S.scan_timeline_bundles(spark, str(tmp_path / "b")).collect()


def test_a_long_term_gives_few_prefixes(spark):
    words = spark.createDataFrame([(1, "xxa", 1.0), (2, "yyyy", 1.0)], "qid long, term string, times double")
    terms = spark.createDataFrame([("x" * 20_000,), ("xxab",), ("xx",), ("yyyyz",)], "term string")
    assert sorted((r.qid, r.term) for r in prefix_words(words, terms).collect()) == [(1, "xxab"), (2, "yyyyz")]


def test_listing_rules(spark, tmp_path):
    for name in ("a.pdf", "b.TXT", ".c.md", "MANUAL-RETRIEVAL.md", "_new/d.pdf", "e.png", "sub/f.htm"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text("x")
    got = {r["path"].rsplit("/", 1)[1] for r in S.scan_corpus_listing(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf", "b.TXT", "f.htm"}


def test_logs_strict_and_lenient(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"file":"a","status":"done"}\n{"file": "b"\n')
    assert [r["file"] for r in S.scan_manifest(spark, str(tmp_path)).collect()] == ["a"]
    assert S.scan_manifest(spark, str(tmp_path)).count() == 1
    assert S.scan_pages(spark, str(tmp_path), strict=False).count() == 1
    with pytest.raises(Exception):
        S.scan_chunks(spark, str(tmp_path)).collect()


def test_upsert_version_is_repeatable(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int")
    K.upsert_version(spark, str(tmp_path), 0, rows)
    for _ in range(2):
        path = K.upsert_version(spark, str(tmp_path), 1, spark.createDataFrame([("b", 2), ("c", 2)], "id string, v int"))
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", 1), ("b", 2), ("c", 2)]


def test_index_and_search_end_to_end(spark, tmp_path):
    index = index_build.Index(str(tmp_path))
    synthesis = spark.createDataFrame([("docs/01-x.md", "The river lock opened in 1938 near the harbor. " * 5)], "file string, text string")
    pages = spark.createDataFrame([("sources/a.pdf", 1, "Pump station lifts sewage into the deep tunnel. " * 5), ("sources/a.pdf", 2, "Reservoir. " * 20),
                                   ("docs/01-x.md", 1, "a copy that must not win " * 5)], "file string, page int, text string")
    figs = spark.createDataFrame([("fig:1", "sources/a.pdf", 2, "figure", "Map of the reservoir and its shafts")],
                                 "id string, file string, page int, status string, description string")
    index_build.build_chunks(index, synthesis, pages, figs)
    index_build.build_chunks(index, synthesis, pages)  # a text rebuild keeps the figure
    assert spark.read.parquet(index.chunks).groupBy("origin").count().count() == 3
    built = spark.read.parquet(index.chunks)
    index_build.add_keywords(index, built.filter("origin = 'source'"), 0)
    index_build.add_keywords(index, built.filter("origin <> 'source'"), 1)
    embed = letter_embedder("abcdefghijklmnop")
    path = index_build.build_vectors(index, spark, 0, embed, 16)
    assert spark.read.parquet(index_build.build_vectors(index, spark, 1, embed, 16)).count() == spark.read.parquet(path).count() == 3
    text = "reservoir map shafts"
    queries = spark.createDataFrame([(1, text, embed([text])[0])], "qid int, text string, vector array<double>")
    hits = search.search(spark, index, path, queries, 2).orderBy("rank0").collect()
    assert hits[0]["is_figure"] and hits[0]["link"] == "/sources/a.pdf#page=2"
