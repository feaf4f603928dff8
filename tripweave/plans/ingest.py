"""Manifest, file ledger and page parsing queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import run_folder
from ..sources import manifest as M
from ..sources import pages as P
from ..sources.network import load, read, six_digits
from .registry import query

BASE = "https://timetables.example"

_PATHS = {"published": """
    SELECT c_custkey AS listing_pos, n_name, r_name, c_mktsegment AS seg, c_custkey AS k,
           'Pdf/' || substr(n_name, 1, 1) || 'pdf/' || n_name || '___' || replace(r_name, ' ', '_')
           || CASE c_mktsegment
                WHEN 'MACHINERY' THEN '-v2-'
                WHEN 'HOUSEHOLD' THEN '___PH_20260622_'
                ELSE '_from_20260622_to_' || CASE WHEN c_custkey % 3 = 0 THEN '99999999'
                                                  ELSE '20261231' END || '_' END
           || lpad(CAST(c_custkey % 400 AS VARCHAR), 6, '0') || '.pdf' AS pdf_path
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "listed": """
    SELECT *, split_part(pdf_path, '/', 3) AS pdf_filename FROM published
    QUALIFY row_number() OVER (PARTITION BY split_part(pdf_path, '/', 3)
                               ORDER BY listing_pos, pdf_path) = 1"""}


def published(spark, sf):
    """One published path per customer, in listing order; a fifth have a bad name."""
    c, n, r = (read(spark, sf, x) for x in ("customer", "nation", "region"))
    seg, k = F.col("c_mktsegment"), F.col("c_custkey")
    tail = (F.when(seg == "MACHINERY", "-v2-").when(seg == "HOUSEHOLD", "___PH_20260622_")
            .otherwise(F.concat(F.lit("_from_20260622_to_"), F.when(k % 3 == 0, "99999999")
                                .otherwise("20261231"), F.lit("_"))))
    return (c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(k.alias("listing_pos"), F.concat(
                F.lit("Pdf/"), F.substring("n_name", 1, 1), F.lit("pdf/"), "n_name", F.lit("___"),
                F.replace(F.col("r_name"), F.lit(" "), F.lit("_")), tail, six_digits(k % 400),
                F.lit(".pdf")).alias("pdf_path")))


_MANIFEST = """
    SELECT replace(n_name, '_', ' ') || '-' || r_name AS route_name,
           replace(n_name, '_', ' ') AS origin, r_name AS destination,
           substr(n_name, 1, 1) AS letter_group,
           lpad(CAST(k % 400 AS VARCHAR), 6, '0') AS timetable_number,
           seg = 'HOUSEHOLD' AS is_public_holiday, '2026-06-22' AS effective_from,
           CASE WHEN seg <> 'HOUSEHOLD' AND k % 3 <> 0 THEN '2026-12-31' END AS effective_to,
           pdf_path, 'https://timetables.example/' || pdf_path AS pdf_url, pdf_filename
    FROM listed WHERE seg <> 'MACHINERY'"""


@query(_MANIFEST, _PATHS)
def manifest_rows(spark, sf):
    return M.manifest_rows(published(spark, sf), BASE)


@query(_MANIFEST, _PATHS)
def manifest_round_trip(spark, sf):
    """The manifest written as JSON in order of its files, and read back."""
    path = f"{run_folder(spark)}/manifest-{uuid.uuid4().hex}"
    M.write_manifest(M.manifest_rows(published(spark, sf), BASE), path)
    return M.read_manifest(spark, path)


@query("""
    SELECT pdf_path, 'Unrecognized PDF filename: ' || pdf_filename AS reason
    FROM listed WHERE seg = 'MACHINERY'""", _PATHS)
def manifest_rejects(spark, sf):
    return M.rejected_paths(published(spark, sf))


@query("""
    SELECT pdf_filename FROM listed WHERE seg <> 'MACHINERY' ORDER BY pdf_filename LIMIT 40""", _PATHS)
def limited_manifest(spark, sf):
    return M.limited(M.manifest_rows(published(spark, sf), BASE), 40).select("pdf_filename")


_FILES = {"fetched": """
    SELECT url AS pdf_filename, html, CASE WHEN length(html) % 2 = 0 THEN '%PDF-' || html
                                           ELSE html END AS content FROM pages
    QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1""",
    "ledger": """
    SELECT pdf_filename, pdf_filename AS path, sha256(content) AS sha256, true AS ok,
           CAST(strlen(content) AS BIGINT) AS size, CAST(NULL AS VARCHAR) AS error,
           contains(html, '<p') AS held
    FROM fetched WHERE content LIKE '\\%PDF%' ESCAPE '\\'
    UNION ALL
    SELECT pdf_filename, NULL, NULL, false, 0, 'response is not a PDF', false
    FROM fetched WHERE NOT content LIKE '\\%PDF%' ESCAPE '\\'"""}


def _ledger(spark, sf):
    """Web pages stand in for fetched files; half carry the file magic. Pages with a
    paragraph were held before."""
    from ..operators.blocks import first_per
    pages = first_per(read(spark, sf, "pages"), ["url"], ["page_id"])
    text = F.when(F.length("html") % 2 == 0, F.concat(F.lit("%PDF-"), "html")).otherwise(F.col("html"))
    files = pages.select(F.col("url").alias("pdf_filename"), F.col("url").alias("path"),
                         F.encode(text, "UTF-8").alias("content"))
    before = pages.filter(F.contains("html", F.lit("<p"))).select(
        F.col("url").alias("pdf_filename"), F.lit(True).alias("ok"), F.lit(1).alias("size"))
    return M.file_ledger(files.select("pdf_filename"), files, before)


@query("SELECT pdf_filename, path, sha256, size, ok, ok AND held AS skipped, error FROM ledger", _FILES)
def file_ledger(spark, sf):
    return _ledger(spark, sf)


@query("""
    SELECT CASE WHEN ok AND held THEN 'skipped' WHEN ok THEN 'ok' ELSE 'failed' END AS status,
           count(*) AS files FROM ledger GROUP BY 1""", _FILES)
def stage_summary(spark, sf):
    return M.stage_summary(_ledger(spark, sf))


@query("""
    SELECT pdf_filename, error FROM ledger WHERE NOT ok ORDER BY pdf_filename LIMIT 20""", _FILES)
def first_failures(spark, sf):
    return M.first_failures(_ledger(spark, sf))


@query("""
    SELECT count(*) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes
    FROM ledger WHERE pdf_filename NOT IN (SELECT url FROM pages WHERE page_id IN (
        SELECT doc_id FROM labels WHERE quality = 1))""", _FILES)
def unpublished_files(spark, sf):
    """Files whose page has no good label are no longer published."""
    good = read(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("page_id"))
    listed = read(spark, sf, "pages").join(good, "page_id", "left_semi").select(
        F.col("url").alias("pdf_filename"))
    return M.unpublished_files(listed, _ledger(spark, sf))


@query(r"""
    SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, md5(parts[i]) AS line_md5
    FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
          FROM (SELECT doc_id, regexp_split_to_array(text,
                    '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]') AS parts FROM documents))""")
def page_lines(spark, sf):
    """Whole documents as lines."""
    docs = read(spark, sf, "documents").select("doc_id", F.col("text").alias("page_text"))
    return P.page_lines(docs, "doc_id").select("doc_id", "line_no", F.md5("line").alias("line_md5"))


def network_lines(t):
    """The network printed as timetable lines, one page per schedule.

    A page holds a title, a section with the first two trips and a stacked block with the
    others, a second section with no service, a note block and a disclaimer.
    """
    sc = t.schedule.select(
        F.col("id").alias("schedule_id"), F.concat(F.lit("T"), F.col("timetable_id").cast("string"),
                                                   F.lit(".pdf")).alias("pdf_filename"),
        (F.col("id") + 1).alias("page_number"), "timetable_id", "direction_label", "day_label",
        F.concat(F.lit(" EFFECTIVE DATE: "), F.date_format("section_effective_date", "yyyy/MM/dd"),
                 F.lit(" TIMETABLE NUMBER: "), F.substring("section_timetable_number", 1, 4),
                 F.lit(" "), F.substring("section_timetable_number", 5, 2)).alias("tail"))
    n = t.schedule_stop.groupBy("schedule_id").agg(F.count(F.lit(1)).alias("n"))
    wide = (F.col("schedule_id") % 4) > 1
    head = sc.join(n, "schedule_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    notes = t.timetable_note.select("timetable_id", F.concat_ws(" - ", "code", "description").alias("note"))
    after = F.col("n") * 2 + 3
    printed = [
        (F.lit(0), F.col("direction_label")), (F.lit(1), F.concat("day_label", "tail")),
        (F.col("n") + 2, F.when(wide, "|--------|-------|-------|").otherwise("")),
        (after, F.concat(F.lit("SUNDAYS - NO SERVICE"), "tail")), (after + 1, F.lit("ABBREVIATIONS")),
        (after + 2, F.col("note")), (after + 3, F.lit("Every effort has been made to be exact."))]
    fixed = head.join(notes, "timetable_id").select("pdf_filename", "page_number", F.explode(F.array(*[
        F.struct(at.cast("bigint").alias("line_no"), text.alias("line"))
        for at, text in printed])).alias("x")).select("pdf_filename", "page_number", "x.*")
    st = t.stop.select(F.col("id").alias("stop_id"), "name")
    # The page's columns come first: both sides lie by schedule there. Rows move for names only.
    rows = (t.stop_time.groupBy("schedule_id", "stop_sequence", "stop_id").agg(*[
        F.max(F.when(F.col("trip_index") == i, F.col("raw_value"))).alias(f"c{i}") for i in range(4)])
        .join(head.select("schedule_id", "pdf_filename", "page_number", "n"), "schedule_id").join(st, "stop_id"))

    def row(at, *cells):
        return F.struct(at.alias("line_no"), F.concat(
            F.lit("| "), F.concat_ws(" | ", "name", *cells), F.lit(" |")).alias("line"))
    grid = rows.select("pdf_filename", "page_number", F.explode(F.filter(F.array(
        row(F.col("stop_sequence") + 2, "c0", "c1"),
        F.when(wide, row(F.col("n") + 3 + F.col("stop_sequence"), "c2", "c3"))), lambda x: x.isNotNull())).alias("x")
    ).select("pdf_filename", "page_number", "x.*")
    # Files of two blank pages, and files dated with a day there is not.
    k = F.col("id")
    blank = t.timetable.filter(k % 10 == 3).select(
        F.concat(F.lit("BLANK"), k.cast("string"), F.lit(".pdf")).alias("pdf_filename"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(2).cast("bigint"))).alias("page_number"),
        F.lit(0).cast("bigint").alias("line_no"), F.lit(" ").alias("line"))
    wrong = t.timetable.filter(k % 10 == 7).select(
        F.concat(F.lit("BAD"), k.cast("string"), F.lit(".pdf")).alias("pdf_filename"),
        F.lit(1).cast("bigint").alias("page_number"), F.lit(0).cast("bigint").alias("line_no"),
        F.lit("SUNDAYS EFFECTIVE DATE: 2026/02/30 TIMETABLE NUMBER: 0012 34").alias("line"))
    return fixed.unionByName(grid).unionByName(blank).unionByName(wrong)


PARSED = {"live": """
    SELECT schedule_id, trip_index,
           row_number() OVER (PARTITION BY schedule_id ORDER BY trip_index) - 1 AS new_index
    FROM (SELECT DISTINCT schedule_id, trip_index FROM stop_time WHERE cell_type <> 'NONE')"""}


_DONE: dict[tuple[str, str], P.Parsed] = {}


def parsed(spark, sf) -> P.Parsed:
    """The printed network, parsed once per session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _DONE:
        _DONE[key] = P.parse(network_lines(load(spark, sf)))
    return _DONE[key]


@query("""
    SELECT 'T' || sc.timetable_id || '.pdf' AS pdf_filename, sc.id + 1 AS page_number,
           l.new_index AS trip_index, st.stop_sequence, s.name AS stop_name, st.cell_type, st.dep_min,
           st.note_code, st.raw_value
    FROM stop_time st JOIN live l ON l.schedule_id = st.schedule_id AND l.trip_index = st.trip_index
    JOIN schedule sc ON sc.id = st.schedule_id JOIN stop s ON s.id = st.stop_id""", PARSED)
def parse_round_trip(spark, sf):
    """Every cell of the network, printed as text and parsed back."""
    return parsed(spark, sf).cells.select(
        "pdf_filename", "page_number", "trip_index", "stop_sequence", "stop_name", "cell_type",
        "dep_min", "note_code", "raw_value")


@query("""
    SELECT 'T' || timetable_id || '.pdf' AS pdf_filename, id + 1 AS page_number, id AS direction_index,
           direction_label, day_type, day_label, section_timetable_number,
           CAST(section_effective_date AS VARCHAR) AS section_effective_date,
           id NOT IN (SELECT schedule_id FROM live) AS no_service
    FROM schedule
    UNION ALL
    SELECT 'T' || timetable_id || '.pdf', id + 1, id, direction_label, 'SUNDAY', 'SUNDAYS',
           section_timetable_number, CAST(section_effective_date AS VARCHAR), true
    FROM schedule""", PARSED)
def parsed_schedules(spark, sf):
    return parsed(spark, sf).schedules.select(
        "pdf_filename", "page_number", "direction_index", "direction_label", "day_type", "day_label",
        "section_timetable_number", F.date_format("section_effective_date", "yyyy-MM-dd")
        .alias("section_effective_date"), "no_service")


@query("""
    SELECT 'T' || sc.timetable_id || '.pdf' AS pdf_filename, sc.id + 1 AS page_number,
           l.new_index AS trip_index,
           CASE WHEN bool_or(st.note_code IS NOT NULL) THEN 'a' END AS note_codes
    FROM live l JOIN stop_time st ON l.schedule_id = st.schedule_id AND l.trip_index = st.trip_index
    JOIN schedule sc ON sc.id = l.schedule_id
    GROUP BY sc.timetable_id, sc.id, l.new_index""", PARSED)
def parsed_trips(spark, sf):
    return parsed(spark, sf).trips.select(
        "pdf_filename", "page_number", "trip_index",
        F.when(F.col("note_codes").isNotNull(), F.array_join("note_codes", ",")).alias("note_codes"))


@query("""
    SELECT DISTINCT 'T' || n.timetable_id || '.pdf' AS pdf_filename, n.code, n.description
    FROM timetable_note n JOIN schedule sc ON sc.timetable_id = n.timetable_id""")
def parsed_notes(spark, sf):
    return parsed(spark, sf).notes


@query("""
    SELECT 'T' || timetable_id || '.pdf' AS pdf_filename, 'parsed' AS parse_status,
           CAST(NULL AS VARCHAR) AS parse_error, CAST(count(*) AS INTEGER) AS page_count,
           min(section_timetable_number) AS timetable_number
    FROM schedule GROUP BY timetable_id
    UNION ALL
    SELECT 'BLANK' || id || '.pdf', 'parsed', NULL, 2, NULL FROM timetable WHERE id % 10 = 3
    UNION ALL
    SELECT 'BAD' || id || '.pdf', 'failed', 'impossible effective date: 2026-02-30', 1, '001234'
    FROM timetable WHERE id % 10 = 7""")
def parsed_files(spark, sf):
    return parsed(spark, sf).files


@query("""
    SELECT raw_value, cell_type, CAST(dep_min AS INTEGER) AS dep_min, note_code, count(*) AS cells
    FROM stop_time GROUP BY raw_value, cell_type, dep_min, note_code""")
def parse_cells(spark, sf):
    """Cell texts read back, against the cells they were printed from."""
    return (load(spark, sf).stop_time.select("raw_value", P.cell_parts("raw_value").alias("c"))
            .groupBy("raw_value", "c").agg(F.count(F.lit(1)).alias("cells"))
            .select("raw_value", "c.*", "cells"))
