"""From records to files: names without collisions, moves, checks, report, undo and manifest, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioforge.functions.text import STANDALONE, UNKNOWN_AUTHOR, clean, extract_isbns, format_volume, sanitize_component, trim_title, with_genre
from folioforge.functions.titles import first_labels, series_index
from folioforge.operators.records import needs_review

# Statuses of a finished file, formats whose metadata can be written, the column order of the report.
DONE = ["copied", "copied+archived", "moved", "renamed", "unchanged"]
WRITABLE = ["azw", "azw1", "azw3", "azw4", "docx", "epub", "fb2", "fbz", "htmlz", "kepub", "lrf", "mobi", "odt", "pdb", "pdf", "prc", "rtf", "tpz", "txtz"]
REPORT = """source_name target_name source_folder target_folder old_name new_name author series tom title genre source identifiers notes confidence review
review_reasons decision_reasons online_checked online_applied change_status execution_status operation archive_source_name archive_source_folder
embedded_metadata_status mode""".split()
COLLISION = "kolizja-nazwy"


def file_name(author: Column, series: Column, volume: Column, title: Column, genre: Column, suffix: Column, folder: Column, ext: Column) -> Column:
    """Output file name of a record: sanitised parts, the title cut to the budget of the path."""
    a, s, v = sanitize_component(author), sanitize_component(F.when(F.coalesce(series, F.lit("")) == "", STANDALONE).otherwise(series)), format_volume(volume)
    shown = with_genre(F.when(F.coalesce(suffix, F.lit("")) == "", title).otherwise(F.concat_ws(" ", title, suffix)), genre)
    t = sanitize_component(trim_title(folder, a, s, v, sanitize_component(shown)))
    return F.concat(a, F.lit(" - "), s, F.lit(" - "), v, F.lit(" - "), t, F.lit("."), F.lower(ext))


def free_numbers(rows: DataFrame, folder: str, stem: str, order: str, taken: DataFrame, ext: str | None = None) -> DataFrame:
    """``rows`` with ``number``: 0 for the row that keeps its name, else the ``(n)`` its name gets.

    Names are equal if their folder, lower-case stem and extension are. ``taken``
    has the (folder, stem, extension) that are not free. A row whose own name
    ends in ``(n)`` keeps it, so no numbered copy takes the name of another row.
    The first row by ``order`` keeps a name, unless it is taken.
    """
    c = F.col
    low = lambda x: F.lower(F.coalesce(c(x), F.lit("")))
    e = low(ext) if ext else F.lit("")
    keyed = rows.withColumns({"_s": low(stem), "_e": e})
    claimed = taken.select(c(folder), low(stem).alias("_s"), e.alias("_e"), F.lit(True).alias("_held")).unionByName(keyed.select(folder, "_s", "_e", F.lit(False).alias("_held")))
    claimed = claimed.groupBy(folder, "_s", "_e").agg(F.max("_held").alias("_held"))
    numbered = claimed.select(folder, "_e", F.regexp_extract("_s", r"(?s)^(.*) \((\d{1,9})\)$", 1).alias("_s"), F.regexp_extract("_s", r"(?s)^(.*) \((\d{1,9})\)$", 2).alias("m")).where("m <> '' AND m not like '0%'")
    blocked = numbered.groupBy(folder, "_s", "_e").agg(F.array_sort(F.collect_set(c("m").cast("int"))).alias("_m"))
    place = F.row_number().over(Window.partitionBy(folder, "_s", "_e").orderBy(order)) - 1
    ranked = keyed.withColumn("_r", place).join(claimed.where("_held"), [folder, "_s", "_e"], "left").join(blocked, [folder, "_s", "_e"], "left")
    want = c("_r") + F.when(c("_held"), 1).otherwise(0)
    free = F.aggregate(F.coalesce("_m", F.array().cast("array<int>")), want, lambda n, m: F.when(m <= n, n + 1).otherwise(n))
    return ranked.withColumn("number", F.when(want == 0, 0).otherwise(free)).drop("_s", "_e", "_r", "_held", "_m")


def assign_names(rows: DataFrame, existing: DataFrame, output: str, order: str) -> DataFrame:
    """``rows`` (folder, stem, ext, confidence) with the folder and number that keep them apart from ``existing`` (folder, stem, ext) files.

    A name that exists in the output folder goes to its folder ``dubel``; names
    taken there, or by earlier rows, get a number. Each step costs confidence,
    never below 0, and a review reason.
    """
    c = F.col
    held = existing.select("folder", F.lower("stem").alias("_s"), F.lower("ext").alias("_e")).distinct().withColumn("_held", F.lit(True))
    met = rows.withColumns({"_s": F.lower("stem"), "_e": F.lower("ext")}).join(held, ["folder", "_s", "_e"], "left").drop("_s", "_e")
    double = F.coalesce(c("_held"), F.lit(False)) & (c("folder") == output)
    moved = met.withColumns({"moved": double, "folder": F.when(double, F.concat(c("folder"), F.lit("/dubel"))).otherwise(c("folder"))}).drop("_held")
    named = free_numbers(moved, "folder", "stem", order, existing, "ext")
    cost = F.when(c("moved"), 3).otherwise(0)
    left = F.greatest(F.lit(0), c("confidence") - cost)
    return named.withColumns({
        "confidence": F.greatest(F.lit(0), left - 5 * c("number")), "final_stem": F.when(c("number") > 0, F.concat("stem", F.lit(" ("), c("number").cast("string"), F.lit(")"))).otherwise(c("stem")),
        "collision_reasons": F.when(c("moved") | (c("number") > 0), F.array(F.lit(COLLISION))).otherwise(F.array().cast("array<string>"))})


def build_moves(rows: DataFrame, key: str, stamp: str, archive: bool = False) -> DataFrame:
    """(key, step, operation, source, temp, destination) of each record whose file gets another place.

    Rows have source and target folder and name. In one folder a file is renamed
    over a temporary name; else it is copied, and with ``archive`` the original
    is then moved to its archive path. A record already in its place needs none.
    """
    c = F.col
    path = lambda folder, name: F.concat(c(folder), F.lit("/"), c(name))
    same = c("source_folder") == c("target_folder")
    temp = F.concat(c("source_folder"), F.lit(f"/__tmp_rename_{stamp}_"), c(key).cast("string"), F.lit("."), F.lower(F.regexp_extract("source_name", r"\.([^.]+)$", 1)))
    step = lambda n, op, t, dst: F.struct(F.lit(n).alias("step"), F.lit(op).alias("operation"), path("source_folder", "source_name").alias("source"), t.alias("temp"), dst.alias("destination"))
    none = F.lit(None).cast("string")
    copied = F.array(step(1, "copy", none, path("target_folder", "target_name")), *([step(2, "move", none, c("archive_path"))] if archive else []))
    steps = F.when(same, F.array(step(1, "rename", temp, path("target_folder", "target_name")))).otherwise(copied)
    moving = ~(same & (c("source_name") == c("target_name")))
    return rows.where(moving).select(key, F.explode(steps).alias("m")).select(key, "m.*")


def check_moves(moves: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """(key, step, error) of moves that would collide: two to one place, a place or temporary name that exists.

    A rename may go where another file of the plan leaves. ``existing`` has one path per file.
    """
    c = F.col
    low = lambda x: F.lower(c(x))
    base = lambda x: F.regexp_extract(x, r"([^/\\]+)$", 1)
    going = moves.where("operation <> 'delete'").withColumn("_d", low("destination"))
    first = going.groupBy("_d").agg(F.min(F.struct(key, "step")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
    double = going.join(first, "_d").where((c(key) != c(f"f.{key}")) | (c("step") != c("f.step"))).select(key, "step", F.concat(F.lit("duplicate-destination:"), base("destination")).alias("error"))
    there = existing.select(low("path").alias("_d")).distinct()
    leaving = moves.select(low("source").alias("_d")).distinct()
    hits = going.join(double.select(key, "step"), [key, "step"], "left_anti").join(there, "_d", "left_semi")
    free = hits.where("operation = 'rename'").join(leaving, "_d", "left_semi").select(key, "step")
    exists = hits.join(free, [key, "step"], "left_anti").select(key, "step", F.concat(F.lit("destination-exists:"), base("destination")).alias("error"))
    temps = moves.where("temp is not null").withColumn("_d", low("temp")).join(there, "_d", "left_semi").join(leaving, "_d", "left_anti").select(key, "step", F.concat(F.lit("temp-exists:"), base("temp")).alias("error"))
    return double.unionByName(exists).unionByName(temps)


def metadata_status(ext: Column, enabled: bool) -> Column:
    """Whether metadata is planned for a file, by its extension."""
    return F.when(F.lower(ext).isin(WRITABLE), "planned").otherwise("skip-not-writable") if enabled else F.lit("disabled")


def report(rows: DataFrame, operation: str, dry_run: bool) -> DataFrame:
    """The report of a run in its 27 columns, all text; NULL texts and lists are empty.

    Rows are records with source and target folder and name, ``status`` (NULL
    before a run) and ``metadata_status``.
    """
    c = F.col
    text = lambda x: F.coalesce(c(x).cast("string"), F.lit(""))
    joined = lambda x, sep: F.coalesce(F.array_join(x, sep), F.lit(""))
    review = needs_review(c("confidence"), F.coalesce("review_reasons", F.array().cast("array<string>")))
    same = (c("source_folder") == c("target_folder")) & (c("source_name") == c("target_name"))
    status = F.when(F.coalesce("status", F.lit("")) != "", c("status")).when(review, "review-required").when(same, "unchanged").otherwise("planned")
    yes = lambda x: F.when(F.coalesce(c(x), F.lit(False)), "yes").otherwise("no")
    archive = F.coalesce("archive_source_path", F.lit(""))
    cells = {
        "source_name": text("source_name"), "target_name": text("target_name"), "source_folder": text("source_folder"), "target_folder": text("target_folder"), "old_name": text("source_name"),
        "new_name": text("target_name"), "author": text("author"), "series": text("series"), "tom": format_volume(c("volume")), "title": text("title"), "genre": text("genre"), "source": text("source"),
        "identifiers": joined("identifiers", ","), "notes": joined("notes", " | "), "confidence": text("confidence"), "review": F.when(review, "CHECK").otherwise("OK"),
        "review_reasons": joined("review_reasons", " | "), "decision_reasons": joined("decision_reasons", " | "), "online_checked": yes("online_checked"), "online_applied": yes("online_applied"),
        "change_status": F.when(same, "unchanged").otherwise(operation), "execution_status": status, "operation": F.lit(operation),
        "archive_source_name": F.regexp_extract(archive, r"([^/\\]+)$", 1), "archive_source_folder": F.regexp_extract(archive, r"^(.*)[/\\][^/\\]+$", 1),
        "embedded_metadata_status": text("metadata_status"), "mode": F.lit("dry-run" if dry_run else "apply"),
    }
    return rows.select(*[cells[n].alias(n) for n in REPORT])


def write_report(rows: DataFrame, path: str) -> None:
    """Semicolon-separated text with a header, one file per partition."""
    rows.write.mode("overwrite").csv(path, sep=";", header=True, quote='"', escape='"', encoding="UTF-8")


def undo_plan(log: DataFrame, key: str) -> DataFrame:
    """(key, step, operation, source, destination) that takes back what a report says was done.

    Only rows of mode ``apply`` whose status fits their operation; copies are
    deleted, an archived original is first moved back, all else is renamed back.
    """
    missing = {"source_name", "target_name", "mode", "execution_status"} - set(log.columns)
    if missing:
        raise ValueError(f"columns missing in the log: {', '.join(sorted(missing))}")
    c = F.col
    held = lambda x: F.coalesce(c(x), F.lit("")) if x in log.columns else F.lit("")
    op = F.when(F.lower(F.trim(held("operation"))) == "", "rename").otherwise(F.lower(F.trim(held("operation"))))
    want = F.when(op == "copy", "copied").when(op == "move", "moved").when(op == "copy+archive", "copied+archived").otherwise("renamed")
    rows = log.where((F.lower(F.trim(held("mode"))) == "apply") & (held("source_name") != "") & (held("target_name") != "") & (held("source_name") != held("target_name")) & (F.lower(F.trim(held("execution_status"))) == want))
    path = lambda folder, name: F.concat_ws("/", F.nullif(held(folder), F.lit("")), held(name))
    step = lambda n, o, src: F.struct(F.lit(n).alias("step"), F.lit(o).alias("operation"), src.alias("source"), path("source_folder", "source_name").alias("destination"))
    now = path("target_folder", "target_name")
    archived = (held("archive_source_name") != "") & (held("archive_source_folder") != "")
    steps = F.when(op == "copy", F.array(step(1, "delete", now))).when((op == "copy+archive") & archived, F.array(step(1, "move", path("archive_source_folder", "archive_source_name")), step(2, "delete", now))).when(
        op == "copy+archive", F.array(step(1, "delete", now))).otherwise(F.array(step(1, "rename", now)))
    return rows.select(key, F.explode(steps).alias("u")).select(key, "u.*")


def skip_processed(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (name, size, mtime_ns) the manifest does not hold as done with the same size and time."""
    done = manifest.where(F.lower(F.trim(F.coalesce("status", F.lit("")))).isin(DONE)).select(F.lower("source_name").alias("_n"), "size", "mtime_ns").distinct()
    return files.withColumn("_n", F.lower("name")).join(done, ["_n", "size", "mtime_ns"], "left_anti").drop("_n")


def upsert_manifest(old: DataFrame, done: DataFrame) -> DataFrame:
    """Manifest after a run: entries of finished files replace those of the same lower-case name; others are not entered."""
    new = done.where(F.col("status").isin(DONE)).withColumn("key", F.lower("source_name"))
    return old.join(new.select("key"), "key", "left_anti").unionByName(new.select(*old.columns))


def read_manifest(entries: DataFrame, body: str = "value") -> DataFrame:
    """(key, source_name, target_name, status, size, mtime_ns) of manifest JSON; older entries keyed by path are keyed by name.

    Broken JSON gives no entries, entries that are no objects are left out.
    """
    c = F.col
    shape = "version int, entries map<string,struct<source_name:string,target_name:string,status:string,size:long,mtime_ns:long>>"
    rows = entries.select(F.explode(F.from_json(body, shape)["entries"]).alias("k", "e")).where("e is not null")
    name = F.when(F.trim(F.coalesce("e.source_name", F.lit(""))) != "", F.trim("e.source_name")).otherwise(F.regexp_extract("k", r"([^/\\]*)$", 1))
    return rows.select(F.lower(name).alias("key"), name.alias("source_name"), "e.target_name", "e.status", "e.size", "e.mtime_ns").where("key <> ''").groupBy("key").agg(
        *[F.max_by(n, F.struct(F.coalesce("mtime_ns", F.lit(0)), "source_name")).alias(n) for n in ("source_name", "target_name", "status", "size", "mtime_ns")])


def conversion_source(files: DataFrame, folder: str, stem: str) -> DataFrame:
    """(folder, stem, path, action) per book of several formats: the EPUB if there is one, else the best to convert.

    Better formats first, then the larger file, then the path.
    """
    # How well a format converts.
    rank = {"azw3": 90, "azw": 86, "mobi": 82, "fb2": 74, "rtf": 60, "lit": 54, "pdf": 46, "txt": 32}
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    worth = F.when(ext == "epub", 100).otherwise(F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in rank.items() for x in kv]), ext), F.lit(0)))
    low = F.lower(F.col(stem))
    best = files.groupBy(folder, low.alias("stem")).agg(F.max_by("path", F.struct(worth, "size", F.lower("path"))).alias("path"))
    return best.withColumn("action", F.when(F.lower("path").endswith(".epub"), "move").otherwise("convert"))



def metadata_updates(records: DataFrame, key: str, tags: str | None = None) -> DataFrame:
    """(key, title, creators, series, series_index, subjects, isbns, other_ids) to be written into each record's file.

    Creators are the ``&`` parts of the author; a standalone has no series;
    subjects are the genre and the extra ``tags`` (a text of labels), each once.
    """
    c = F.col
    none = F.array().cast("array<string>")
    people = F.filter(F.transform(F.split(F.coalesce("author", F.lit("")), "&"), clean), lambda x: (x != "") & (x != UNKNOWN_AUTHOR))
    alone = F.coalesce("series", F.lit("")).isin("", STANDALONE)
    labels = F.concat(F.array(F.coalesce("genre", F.lit(""))), F.split(F.coalesce(c(tags), F.lit("")), r"[,;|\n]+") if tags else none)
    return records.select(key, clean(c("title")).alias("title"), people.alias("creators"), F.when(~alone, c("series")).alias("series"), F.when(~alone, F.nullif(series_index(c("volume")), F.lit(""))).alias("series_index"),
                          first_labels(labels).alias("subjects"), extract_isbns(F.coalesce("identifiers", none)).alias("isbns"),
                          F.filter(F.coalesce("identifiers", none), lambda x: (F.size(extract_isbns(F.array(x))) == 0) & x.contains(":")).alias("other_ids"))
