"""Record sets and documents from files. What can't be read is a status or a text, never a crash of the others."""

from __future__ import annotations

import fnmatch
import io
import os
import re
from collections.abc import Iterator

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions import exprs as E
from attestra.operators.carry import carried
from attestra.operators.text import windows
from attestra.plans.catalog import Catalog

#: Folders and files that a scan leaves out; extensions of documents; the greatest size. Fixed values.
SKIPPED_FOLDERS = [".git", "node_modules", ".venv", "venv", "__pycache__", ".idea", ".vscode", "site-packages", "sample_evidence", "evidence", "data", "backups", "graphify-out", ".cache"]
SKIPPED_FILES = ["playbook_assessed_*.xlsx", "assessments*.json", "*.bak", ".demo_manifest.json"]
DOCUMENTS = [".txt", ".md", ".csv", ".json", ".yaml", ".yml", ".pdf", ".docx", ".xlsx", ".html", ".log"]
MOST_BYTES = 25_000_000
MOST_ROWS = 2001
#: Files of which MARKED or more make a folder a copy of the tool. Fixed values.
MARKERS, MARKED = ["app.py", "assessor.py", "pipeline.py", "scanner.py", "playbook.py"], 4
#: (file pattern, kind of signal, controls), the first that fits counts. Fixed values.
SIGNALS = [
    ("*.tf", "iac", ["M3", "S3.1", "A.6"]),
    ("Dockerfile", "container", ["M3", "S3.1"]),
    ("docker-compose*.yml", "container", ["M3"]),
    (".github/workflows/*.yml", "ci", ["M3", "D3.2", "S3.2"]),
    ("*.gitlab-ci.yml", "ci", ["M3", "D3.2", "S3.2"]),
    ("*model_card*", "model-doc", ["D1.1", "M2", "A.6.2", "MAP 1.1"]),
    ("*MODEL_CARD*", "model-doc", ["D1.1", "M2", "A.6.2"]),
    ("*eval*", "evaluation", ["D3.1", "M4", "MEASURE 2"]),
    ("*test*", "evaluation", ["D3.1", "M4"]),
    ("*logging*", "logging", ["S4.1", "D4.1", "M5"]),
    ("*log4j*", "logging", ["S4.1", "D4.1"]),
    ("*iam*", "access", ["S1.2", "S2.1", "D2.1"]),
    ("*rbac*", "access", ["S1.2", "D2.1"]),
    ("*.env", "secrets", ["S1.3", "D2.2"]),
    ("*secret*", "secrets", ["S1.3", "D2.2"]),
    ("*prompt*", "prompt", ["D2.3", "S2.2", "M2"]),
    ("*guardrail*", "guardrail", ["S2.1", "D2.3"]),
    ("*policy*.json", "policy", ["S2.1", "S1.1"]),
    ("*incident*", "incident", ["D4.3", "S4.3", "M6"]),
    ("*runbook*", "incident", ["D4.3", "S4.3"]),
    ("*inventory*", "inventory", ["S1.1", "M1.3", "A.9"]),
    ("*register*", "inventory", ["S1.1", "M1.3"]),
    ("*dpia*", "privacy", ["M2", "A.8"]),
    ("*pdpa*", "privacy", ["M2", "A.8"]),
    ("requirements*.txt", "dependencies", ["M3", "A.10"]),
    ("package.json", "dependencies", ["M3", "A.10"]),
    ("*sbom*", "dependencies", ["M3", "A.10"]),
]
EXAMPLES = (".example", ".template", ".sample")


class OwnFilesError(RuntimeError):
    """The folder to scan is the tool's installation, holds it or lies in it."""


def refused(folder: str, installation: str) -> str | None:
    """Why a folder must not be scanned; None if it may be."""
    parts = lambda p: [x for x in os.path.realpath(p).split(os.sep) if x]
    a, b = parts(folder), parts(installation)
    if a == b:
        return "this folder is the installation itself: its files are the tool's own, no evidence"
    if b[: len(a)] == a:
        return f"this folder contains the installation ({installation}): scan the folder of the evidence instead"
    if a[: len(b)] == b:
        return "this folder lies in the installation: its files are the tool's own, no evidence"
    return None


def files(spark: SparkSession, folder: str, installation: str | None = None) -> DataFrame:
    """path, rel, name, length, content of a folder's files; content is read only by plans that use it.

    Skipped files and folders are left out, and so are folders below it that are copies of the tool, by
    their markers. With an installation given, a folder that is, holds or lies in it is refused.
    """
    if installation is not None and "://" not in folder and (why := refused(folder, installation)):
        raise OwnFilesError(why)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = folder.rstrip("/") + "/"
    bare = F.regexp_replace("path", "^file:/+", "/")
    rel = F.regexp_replace(F.when(bare.startswith(root), F.substring(bare, len(root) + 1, 1 << 20)).otherwise(F.element_at(F.split("path", root.split("://")[-1].lstrip("/"), 2), -1)), "^/+", "")
    rows = found.withColumn("rel", rel).withColumn("name", F.element_at(F.split("rel", "/"), -1))
    inside = F.arrays_overlap(F.slice(F.split("rel", "/"), F.lit(1), F.size(F.split("rel", "/")) - 1), F.array(*map(F.lit, SKIPPED_FOLDERS)))
    skipped = "|".join(fnmatch.translate(p) for p in SKIPPED_FILES)
    rows = rows.where(~F.coalesce(inside, F.lit(False)) & ~F.col("name").rlike(skipped.replace(r"\z", r"$").replace(r"\Z", "$")))
    if installation is None:
        return rows
    marked = rows.where(F.col("name").isin(MARKERS)).select(F.regexp_replace("rel", "[^/]*$", "").alias("at"), "name").distinct()
    copies = [r["at"] for r in marked.groupBy("at").count().where((F.col("count") >= MARKED) & (F.col("at") != "")).collect()]  # as many as there are copies
    return rows.where(~F.array_contains(F.array(*(F.col("rel").startswith(c) for c in copies)), True)) if copies else rows


def _docx(body) -> list[str]:
    """Paragraphs outside tables, then the rows of the tables, cells divided by bars."""
    word = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    text = lambda p: "".join("\t" if x.tag == f"{word}tab" else "\n" if x.tag in (f"{word}br", f"{word}cr") else x.text or "" for x in p.iter() if x.tag in (f"{word}t", f"{word}tab", f"{word}br", f"{word}cr"))
    out = [text(p) for p in body.findall(f"{word}p")]
    for table in body.findall(f"{word}tbl"):
        for row in table.findall(f"{word}tr"):
            cells: list[str] = []
            for cell in row.findall(f"{word}tc"):
                wide = cell.find(f"{word}tcPr/{word}gridSpan")
                shown = "\n".join(text(p) for p in cell.findall(f"{word}p"))
                cells += [shown] * int(wide.get(f"{word}val", "1") if wide is not None else 1)  # a merged cell counts for each column
            out.append(" | ".join(cells))
    return out


def _dated(formats: list[bool], cell) -> bool:
    style = cell.get("s")
    return style is not None and int(style) < len(formats) and formats[int(style)]


def _xlsx(z) -> list[str]:
    """Sheets in the workbook's order, with the values of their rows."""
    from datetime import datetime, timedelta
    from xml.etree import ElementTree

    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    link = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    parsed = lambda path: ElementTree.fromstring(z.read(path))
    names = set(z.namelist())
    text = lambda node: "".join(x.text or "" for x in node.iter(f"{main}t"))
    shared = [text(x) for x in parsed("xl/sharedStrings.xml").findall(f"{main}si")] if "xl/sharedStrings.xml" in names else []
    dated: list[bool] = []
    if "xl/styles.xml" in names:
        styles = parsed("xl/styles.xml")
        own = {int(x.get("numFmtId", "0")): x.get("formatCode", "") for x in styles.iter(f"{main}numFmt")}
        is_date = lambda n: 14 <= n <= 22 or 45 <= n <= 47 or any(c in re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(n, "")).lower() for c in "ymdhs")
        dated = [is_date(int(x.get("numFmtId", "0"))) for g in styles.findall(f"{main}cellXfs") for x in g]
    targets = {x.get("Id"): x.get("Target", "") for x in parsed("xl/_rels/workbook.xml.rels")}
    out = []
    for sheet in parsed("xl/workbook.xml").iter(f"{main}sheet"):
        out.append(f"## Sheet: {sheet.get('name')}")
        target = targets.get(sheet.get(link), "")
        path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        for row in list(parsed(path).iter(f"{main}row"))[:MOST_ROWS] if path in names else []:
            cells = []
            for c in row.findall(f"{main}c"):
                kind, value = c.get("t", "n"), c.findtext(f"{main}v")
                if kind == "inlineStr":
                    cells.append(text(c))
                elif value is not None and kind == "s":
                    cells.append(shared[int(value)])
                elif value is not None and kind == "b":
                    cells.append(str(value == "1"))
                elif value is not None and kind == "n":
                    number = float(value)
                    if _dated(dated, c):
                        cells.append(str(datetime(1899, 12, 30) + timedelta(days=number)))
                    else:
                        cells.append(str(int(number)) if number.is_integer() and "." not in value and "E" not in value.upper() else str(number))
                elif value is not None:
                    cells.append(value)
            if cells:
                out.append(" | ".join(cells))
    return out


def _unzip(raw: bytes, kind: str) -> str:
    """Text of an office file, from the XML in it."""
    import zipfile
    from xml.etree import ElementTree

    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        if kind == ".docx":
            return "\n".join(_docx(ElementTree.fromstring(z.read("word/document.xml"))[0]))
        return "\n".join(_xlsx(z))


def extract(name: str, raw: bytes) -> str:
    """A file's text by its extension; what can't be read says so."""
    kind = os.path.splitext(name)[1].lower()
    try:
        if kind in (".docx", ".xlsx"):
            return _unzip(raw, kind)
        if kind == ".pdf":
            import pypdf

            return "\n".join(p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(raw)).pages)
        return raw.decode("utf-8-sig", "replace")
    except Exception as e:  # noqa: BLE001  the text says what went wrong
        return f"[unreadable: {name}: {type(e).__name__}]"


def documents(spark: SparkSession, folder: str, extensions: list[str] = DOCUMENTS, installation: str | None = None) -> DataFrame:
    """doc_id (relative path) and text of a folder's documents."""
    rows = files(spark, folder, installation)
    rows = rows.where((F.col("length") < MOST_BYTES) & F.lower(F.regexp_extract("name", r"(\.[^.]+)$", 1)).isin(extensions))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["rel"], "text": [extract(n, bytes(c)) for n, c in zip(pdf["name"], pdf["content"], strict=True)]})

    return rows.select("rel", "name", "content").mapInPandas(run, "doc_id string, text string")


def document_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, chunk_idx, chunk: windows over each document with its name before it."""
    docs = documents(spark, folder)
    return windows(docs.withColumn("text", F.concat(F.lit("["), F.element_at(F.split("doc_id", "/"), -1), F.lit("]\n"), F.col("text")))).select("doc_id", "chunk_idx", "chunk")


def signals(listing: DataFrame) -> DataFrame:
    """path, kind, controls: the first rule that a file's name or relative path fits, without regard to case; listing: rel, name."""
    kind, controls = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    for pattern, k, c in reversed(SIGNALS):
        regex = "(?i)^" + "".join(".*" if x == "*" else "." if x == "?" else f"\\{x}" if not x.isalnum() else x for x in pattern) + "$"
        fits = F.col("name").rlike(regex) | F.col("rel").rlike(regex)
        kind = F.when(fits, F.lit(k)).otherwise(kind)
        controls = F.when(fits, F.array(*map(F.lit, c))).otherwise(controls)
    sample = F.lower("name").rlike("(" + "|".join(e.replace(".", r"\.") for e in EXAMPLES) + ")$")
    return listing.where(~sample).select(F.col("rel").alias("path"), kind.alias("kind"), controls.alias("controls")).where("kind IS NOT NULL").distinct()


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a CSV export, all values text, names and values trimmed."""
    df = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("encoding", "UTF-8").csv(path)
    return df.toDF(*(c.strip().lstrip("﻿") for c in df.columns))


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON file: a list, an object with `records`, or one object; or JSON lines."""
    df = spark.read.option("multiLine", not path.endswith(".jsonl")).json(path)
    if df.columns == ["records"]:
        return df.select(F.explode("records").alias("r")).select("r.*")
    return df


def yaml_records(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """Records of a YAML document, which is small: it is read on the driver."""
    with open(path, encoding="utf-8") as file:
        found = yaml.safe_load(file) or []
    for part in (key or "").split(".") if key else []:
        found = (found or {}).get(part) or []
    found = found if isinstance(found, list) else found.get("records", [found])
    names = sorted({k for r in found for k in r})
    text = lambda v: None if v is None else str(v).lower() if isinstance(v, bool) else str(v)
    return spark.createDataFrame([tuple(text(r.get(k)) for k in names) for r in found], ", ".join(f"`{n}` string" for n in names) or "empty string")


def records(spark: SparkSession, path: str) -> DataFrame:
    if "://" not in path and not os.path.exists(path):
        raise FileNotFoundError(path)
    kind = os.path.splitext(path)[1].lower()
    return {".csv": csv_records, ".json": json_records, ".jsonl": json_records, ".yaml": yaml_records, ".yml": yaml_records}.get(kind, lambda s, p: s.read.parquet(p))(spark, path)


def catalog_of(spark: SparkSession, paths: dict[str, str]) -> Catalog:
    """A catalog from named files; those that aren't there are missing."""
    out = Catalog(spark)
    for name, path in paths.items():
        out.load(name, lambda p=path: records(spark, p))
    return out


def lock_file(spark: SparkSession, path: str) -> DataFrame:
    """package, version, pinned, raw of requirement lines."""
    line = F.trim(F.regexp_replace("value", r"\s*#.*$", ""))
    rows = spark.read.text(path).select(line.alias("raw")).where("raw <> '' AND raw NOT LIKE '-%'")
    m = lambda i: F.regexp_extract("raw", r"^([A-Za-z0-9._\[\]-]+)\s*(?:(==|>=|<=|~=|!=|>|<)\s*([^\s;,]+))?", i)
    return rows.select(m(1).alias("package"), F.when(m(3) != "", m(3)).alias("version"), (m(2) == "==").alias("pinned"), "raw")


def commits(spark: SparkSession, path: str, ticket: str, governed: list[str]) -> DataFrame:
    """Exported commits (JSON lines) with the ticket they name and whether they touch governed paths."""
    rows = json_records(spark, path)
    found = F.regexp_extract("message", ticket, 0)
    touches = F.exists("paths", lambda p: F.array_contains(F.array(*(p.startswith(g) for g in governed)), True)) if governed else F.lit(False)
    return rows.withColumn("ticket_ref", F.when(found != "", found)).withColumn("touches_governed_paths", F.coalesce(touches, F.lit(False)))


def cadence_days(c: Column) -> Column:
    """Days of a cadence by the first word it holds, in this order."""
    low = F.lower(F.coalesce(c, F.lit("")))
    words = [("quarter", 92), ("semi", 183), ("half", 183), ("month", 31), ("week", 7), ("annual", 366), ("year", 366), ("daily", 1)]
    return E.one_of([(low.contains(w), F.lit(n)) for w, n in words])


def overrides(decisions: DataFrame) -> DataFrame:
    """Decisions with override (a proposal was there and differs) and unnamed."""
    differs = ~F.col("sufficiency").eqNullSafe(F.col("ai_sufficiency")) | ~F.col("maturity").eqNullSafe(F.col("ai_maturity"))
    return decisions.withColumn("override", F.col("ai_sufficiency").isNotNull() & differs).withColumn("unnamed", E.empty(F.trim("reviewer")))


def artefact_status(models: DataFrame, required: DataFrame, listing: DataFrame) -> DataFrame:
    """Each model with the artefacts that all, or its tier, need: where the first of their locations is, and what lacks.

    required: artefact, scope (all or a tier), locations (array, by preference); listing: path.
    """
    wanted = models.select("model_id", "risk_tier", F.explode(F.array(F.lit("all"), F.col("risk_tier"))).alias("scope")).join(required, "scope")
    places = wanted.select("model_id", "risk_tier", "artefact", "scope", F.posexplode_outer("locations").alias("i", "path"))
    there = places.join(listing.select("path").distinct().withColumn("_there", F.lit(True)), "path", "left")
    rows = there.groupBy("model_id", "risk_tier", "artefact", "scope").agg(F.min_by("path", F.when(F.col("_there"), F.col("i"))).alias("location"), F.coalesce(F.bool_or("_there"), F.lit(False)).alias("present"))
    return rows.withColumn("universal_gap", ~F.col("present") & (F.col("scope") == "all")).withColumn("tier_gap", ~F.col("present") & (F.col("scope") != "all"))


def exception_status(register: DataFrame, required: list[str], max_days: int, today: str) -> DataFrame:
    """Open exceptions with the fields they lack and whether they end within so many calendar days; an unreadable end doesn't."""
    rows = register.where(F.lower(F.trim("status")) == "open")
    missing = F.array_compact(F.array(*(F.when(F.trim(F.coalesce(E.field(rows, f).cast("string"), F.lit(""))) == "", F.lit(f)) for f in required)))
    left = F.datediff(F.to_date(E.moment(rows, "expires_on")), F.lit(today[:10]).cast("date"))
    rows = rows.withColumn("missing_fields", missing).withColumn("complete", F.size("missing_fields") == 0).withColumn("within_max_life", F.coalesce(left <= max_days, F.lit(False)))
    return rows.withColumn("ok", F.col("complete") & F.col("within_max_life"))


def plays(rows: DataFrame, block: int = 10_000) -> DataFrame:
    """Steps of a sheet (ordinal, head, text) with the play above them: rows whose head is PLAY n begin one. A task sorts `block` rows at most."""
    number = F.regexp_extract("head", r"(?i)^\s*PLAY\s+(\d+)", 1)
    marked = rows.withColumn("_play", F.when(number != "", number))
    filled = carried(marked, ["ordinal"], F.col("_play"), F.floor(F.col("ordinal") / block), "play")
    return filled.where("_play IS NULL AND play IS NOT NULL").drop("_play")


def control_references(rows: DataFrame, column: str) -> DataFrame:
    """rows with ref: each id that a text such as `LIB: A.1 (x), A.3-A.5 | LIB2: B` names; ranges of up to 40 are written out."""
    parts = rows.withColumn("_lib", F.explode(F.split(F.coalesce(column, F.lit("")), r"\|")))
    lib, ids = F.trim(F.regexp_extract("_lib", r"^\s*([A-Za-z0-9 ]+):", 1)), F.regexp_replace(F.regexp_replace("_lib", r"^\s*[A-Za-z0-9 ]+:", ""), r"\([^)]*\)", "")
    items = parts.withColumn("lib", lib).withColumn("_id", F.explode(F.split(ids, ","))).withColumn("_id", F.trim("_id")).where("_id <> ''")
    m = lambda i: F.regexp_extract("_id", r"^(.*?)(\d+)\s*(?:-|–|to)\s*(?:(.*?)(\d+))$", i)
    lo, hi = m(2).try_cast("int"), m(4).try_cast("int")
    span = (F.col("_id").rlike(r"\d\s*(-|–|to)\s*\S*\d$")) & ((m(1) == m(3)) | (m(3) == "")) & (hi >= lo) & (hi - lo <= 40)
    listed = F.when(F.coalesce(span, F.lit(False)), F.transform(F.sequence(F.coalesce(lo, F.lit(0)), F.greatest(F.coalesce(hi, F.lit(0)), F.coalesce(lo, F.lit(0)))), lambda i: F.concat(m(1), i.cast("string")))).otherwise(F.array("_id"))
    return items.withColumn("ref", F.explode(listed)).drop("_lib", "_id")


def probe_report(spark: SparkSession, path: str) -> DataFrame:
    """probe, detector, cases, passed, failed of a scanner's report (JSON lines): its eval entries; without any, one row that counts the attempts."""
    rows = spark.read.text(path).select(F.from_json("value", "entry_type string, probe string, detector string, total long, passed long").alias("e"), "value")
    evals = rows.where("e.entry_type = 'eval'").select("e.probe", "e.detector", F.coalesce("e.total", F.lit(0)).alias("cases"), F.coalesce("e.passed", F.lit(0)).alias("passed"))
    evals = evals.withColumn("failed", F.col("cases") - F.col("passed"))
    counts = rows.agg(F.count_if(F.col("e.entry_type") == "eval").alias("n"), F.count_if(F.col("e.entry_type") == "attempt").alias("cases")).where("n = 0")
    old = counts.select(F.lit("all").alias("probe"), F.lit("?").alias("detector"), "cases", F.lit(None).cast("long").alias("passed"), F.lit(None).cast("long").alias("failed"))
    return evals.unionByName(old)


def agent_report(spark: SparkSession, path: str) -> DataFrame:
    """id, plugin, success, reason of an agent test's report: its results, nested or not."""
    case = "struct<id:string,success:boolean,testCase:struct<description:string>,metadata:struct<pluginId:string>,gradingResult:struct<reason:string>>"
    raw = spark.read.text(path, wholetext=True)
    nested = F.from_json("value", f"results struct<results:array<{case}>>")["results"]["results"]
    flat = F.from_json("value", f"results array<{case}>")["results"]
    rows = raw.select(F.explode(F.coalesce(nested, flat)).alias("r"))
    return rows.select(F.coalesce("r.id", "r.testCase.description", F.lit("case")).alias("id"), F.col("r.metadata.pluginId").alias("plugin"), F.coalesce("r.success", F.lit(False)).alias("success"), F.substring(F.coalesce("r.gradingResult.reason", F.lit("")), 1, 160).alias("reason"))


def texts(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """label (a file's name without its ending), text of the files of a folder."""
    rows = spark.read.text(f"{folder.rstrip('/')}/{pattern}", wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"), F.col("value").alias("text"))
    return rows.select(F.regexp_replace("name", r"\.[^.]+$", "").alias("label"), "text")
