"""Record schemas of the data model, as DDL strings (field names are fixed by the file formats)."""

PAGE = "page int, method string, text string"
MANIFEST = "file string, status string, pages int, ocr_pages int, chars int, error string"
CHUNK = "id string, file string, page_start int, page_end int, text string"
FIGURE_CANDIDATE = "id string, file string, page int, why string, ocr_snippet string"
FIGURE = "id string, file string, page int, why string, status string, description string"
CLAIM = (
    "cid string, doc string, claim string, cites array<int>, cited_files array<string>, "
    "passages array<struct<file string, p int, text string>>"
)
VERDICT = (
    "cid string, doc string, claim string, cites array<int>, cited_files array<string>, "
    "verdict string, confidence double, evidence string, issue string"
)
FACILITY = (
    "id string, name string, type string, lat double, lng double, `from` int, `to` int, activeTo int, "
    "approx boolean, note string, doc string, owner string, source string"
)
LINE_FEATURE = (
    "id string, name string, kind string, `from` int, `to` int, approx boolean, "
    "geometry array<array<double>>, note string, doc string"
)
CONNECTION = (
    "id string, kind string, `from` int, `to` int, approx boolean, traced boolean, "
    "waypoints array<array<double>>, label string, source string, note string, sourcePlant string"
)
OUTFALL_FEATURE = (
    "type string, id int, geometry struct<type string, coordinates array<double>>, "
    "properties struct<LOCATION string, TARP_CONNECTION string, OWNER string, WATERWAY_REACH string>"
)
TIMELINE_EVENT = (
    "year int, title string, kind string, body string, weight string, date string, doc string, "
    "system array<string>, sources array<string>, srclinks array<struct<label string, href string>>, "
    "quote struct<text string, attribution string, source string, href string>, "
    "image struct<src string, caption string, credit string, href string, source_url string>"
)
TIMELINE = (
    "title string, kicker string, lede string, stats array<struct<n string, l string>>, "
    f"eras array<struct<`range` string, title string, lede string, events array<struct<{TIMELINE_EVENT}>>>>, "
    "footer string"
)
DISCHARGE = (
    "station string, year string, date string, volume string, date_iso date, span_days int, "
    "volume_mg double, row_type string, flags string"
)
