"""Files from a tree: listing, ignore rules, bounded heads, extraction by kind of file."""

from __future__ import annotations

import io
import os
import re
import shutil
import subprocess
import tempfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import IGNORED, MEDIA_EXTENSIONS, OFFICE_EXTENSIONS, PROFILE_TOKENS
from ..functions import text as T
from ..operators.geo import nearest_place
from ..shipping import ship
from .corpus import under

OFFICE_CHARS = 200_000


def glob_pattern(globs) -> str:
    """One regular expression for ignore globs: a trailing slash names a directory at any depth,
    anything else a file name."""
    parts = []
    for g in globs:
        body = re.escape(g.rstrip("/")).replace(r"\*", "[^/]*")
        parts.append(f"(^|/){body}/" if g.endswith("/") else f"(^|/){body}$")
    return "|".join(parts) or r"(?!)"


def is_ignored(path: Column, extra: tuple = (), unignore: tuple = (), hidden: bool = False) -> Column:
    """Whether a walk leaves a path out.  `extra` globs are added, built-in ones in `unignore`
    dropped; hidden files and folders are left out unless `hidden`."""
    out = path.rlike(glob_pattern([g for g in IGNORED if g not in unignore] + list(extra)))
    return out if hidden else out | path.rlike(r"(^|/)\.[^/]+")


def ignore_file_rules(lines: list[str]) -> list[tuple[str, bool]]:
    """(rule, whether it keeps again) of an ignore file, in order; comments and blank lines go."""
    rules = [line.strip() for line in lines if line.strip() and not line.lstrip().startswith("#")]
    return [(r.removeprefix("!"), r.startswith("!")) for r in rules]


#: Names of the files whose rules hold for the folder they lie in and all below.
IGNORE_FILES = (".gitignore", ".ignore")


def rule_pattern(rule: str) -> str:
    """Regular expression of one rule over paths relative to its file's folder: `*` and `?` stay
    inside a name, `**` passes folders, a rule with a slash inside is anchored, one that ends in a
    slash names folders alone, and what it names takes all below along."""
    anchored, folder = "/" in rule.rstrip("/"), rule.endswith("/")
    out = ""
    for part in re.findall(r"\*\*/|\*\*|\*|\?|\[[^\]]+\]|.", rule.strip("/")):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or (part if part.startswith("[") and len(part) > 1 else re.escape(part))
    return ("^" if anchored else "(?:^|/)") + out + ("/" if folder else "(?:/|$)")


def ignored_by(path: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """Whether ignore files (folder, lines; outer folders first) leave a path out: the last rule that
    fits decides."""
    out = F.lit(False)
    for folder, lines in rules:
        inside = F.startswith(path, F.lit(folder.rstrip("/") + "/"))
        relative = F.substr(path, F.lit(len(folder.rstrip("/")) + 2))
        for rule, keeps in ignore_file_rules(lines):
            out = F.when(inside & relative.rlike(rule_pattern(rule)), F.lit(not keeps)).otherwise(out)
    return out


@dataclass
class Survey:
    """What a look at the entries of a local tree says, before any file is read."""

    unreadable: list[str] = field(default_factory=list)
    links: list[str] = field(default_factory=list)
    rules: list[tuple[str, list[str]]] = field(default_factory=list)
    #: Files that Spark's listing passes over, since their or a folder's name begins with `_`.
    passed_over: list[str] = field(default_factory=list)


def survey(root: str) -> Survey:
    """Walks a local root; another file system is left to Spark's listing alone."""
    out = Survey()
    if "://" in root:
        return out
    for folder, dirs, names in os.walk(root, onerror=lambda e: out.unreadable.append(e.filename)):
        full = [os.path.join(folder, n) for n in names]
        out.links += [p for p in (*full, *(os.path.join(folder, d) for d in dirs)) if os.path.islink(p)]
        out.unreadable += [p for p in full if not os.access(p, os.R_OK)]
        hidden = any(part.startswith("_") for part in os.path.relpath(folder, root).split("/"))
        out.passed_over += [p for p, n in zip(full, names, strict=True) if (hidden or n.startswith("_")) and os.access(p, os.R_OK)]
        for name in (n for n in IGNORE_FILES if n in names and os.access(os.path.join(folder, n), os.R_OK)):
            with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
                out.rules.append((folder, f.read().splitlines()))
    out.rules.sort(key=lambda r: r[0].count("/"))
    return out


def dedupe_nested(roots: list[str]) -> list[str]:
    """Roots that lie inside no other; a configuration has a handful of them."""
    clean = sorted({r.rstrip("/") or "/" for r in roots})
    return [r for r in clean if not any(r != o and r.startswith(o.rstrip("/") + "/") for o in clean)]


def list_files(spark: SparkSession, root: str, max_mb: int = 100, ignore_files: bool = True, symlinks: bool = False, seen: Survey | None = None, **rules) -> DataFrame:
    """path, name, parent, size, mtime_ns, content of the files below a root.  The content column
    is only read where a plan uses it.  Ignore files in the tree hold; what symbolic links lead to
    is left out unless `symlinks`; entries that cannot be read are left out (`survey` counts them)."""
    seen = survey(root) if seen is None else seen
    read = lambda: spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True)
    raw = read().load(root)
    if seen.passed_over:
        raw = raw.unionByName(read().load(seen.passed_over))
    path = F.regexp_replace("path", "^[a-z][a-z0-9+.-]*:/*", "/")
    inside = F.substr(path, F.lit(len(root.rstrip("/")) + 1))
    kept = raw.where(F.col("length") <= max_mb << 20).withColumn("p", path).where(~is_ignored(inside, **rules))
    if ignore_files and seen.rules:
        kept = kept.where(~ignored_by(F.col("p"), seen.rules))
    if out := [*seen.unreadable, *([] if symlinks else seen.links)]:
        kept = kept.where(~F.col("p").isin(out) & ~under(F.col("p"), out))
    return kept.select(F.col("p").alias("path"), T.file_name(F.col("p")).alias("name"), T.parent_path(F.col("p")).alias("parent"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), "content")


def read_bytes(budget: int, max_read_kb: int = 64) -> int:
    """Bytes of a file's head for a body of `budget` characters; the ceiling wins over the floor."""
    return min(max(8 * budget, 4096), max_read_kb * 1024, 1 << 20)


def text_head(content: Column, budget: int, max_read_kb: int = 64) -> Column:
    """Decoded head of a file, invalid bytes replaced; null where it looks binary."""
    head = F.substring(content, 1, read_bytes(budget, max_read_kb))
    return F.when(~T.looks_binary(head), F.make_valid_utf8(head.cast("string")))


def xml_text(xml: bytes) -> str:
    """Character data of an XML document: runs separated by blanks, a new line after each
    paragraph element; what comes before an error is kept."""
    out: list[str] = []
    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.CharacterDataHandler = lambda s: out.append(s.strip() + " ") if s.strip() else None
    parser.EndElementHandler = lambda tag: out.append("\n") if tag.endswith("p") else None
    try:
        parser.Parse(xml, True)
    except expat.ExpatError:
        pass
    return "".join(out)


def xml_texts(rows: DataFrame, key: str, column: str) -> DataFrame:
    """key, text of a column of XML documents; a null one has no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [xml_text(x.encode()) if x else "" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    ship(rows.sparkSession)
    return rows.select(key, column).mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, text string")


def office_text(content: bytes) -> str:
    """Text of the document parts of an office file; nothing for what is no such file."""
    wanted = re.compile(r"word/document\.xml|content\.xml|xl/sharedStrings\.xml|ppt/slides/slide.*\.xml")
    out = ""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for name in z.namelist():
                if wanted.fullmatch(name):
                    out += xml_text(z.read(name)) + " "
                    if len(out) > OFFICE_CHARS:
                        break
    except (zipfile.BadZipFile, OSError, RuntimeError):
        return ""
    return out


def _tool(args: list[str], content: bytes, timeout: int = 30) -> str:
    """Output of an external program over a file; nothing where the program is missing or fails."""
    if shutil.which(args[0]) is None:
        return ""
    with tempfile.NamedTemporaryFile() as f:
        f.write(content)
        f.flush()
        try:
            done = subprocess.run([a if a != "{}" else f.name for a in args], capture_output=True, timeout=timeout)
        except (OSError, subprocess.TimeoutExpired):
            return ""
    return done.stdout.decode("utf-8", "replace") if done.returncode == 0 else ""


def tool_gaps() -> list[str]:
    """What cannot be extracted here, for want of a program."""
    return [f"{kind}: {tool} is not installed" for tool, kind in (("pdftotext", "PDF text"), ("exiftool", "media data")) if shutil.which(tool) is None]


def with_places(files: DataFrame, places: DataFrame) -> DataFrame:
    """Extracted rows with the nearest city of a picture's coordinates (the last two lines of its raw
    text, which then go) at the end of the text."""
    pair = T.gps_pair(F.col("raw"))
    marked = files.withColumn("lat", pair["lat"]).withColumn("lon", pair["lon"])
    bare = F.regexp_replace("raw", r"(?:\s*\n)?[^\n]*\n[^\n]*\s*$", "")
    named = nearest_place(marked.where("lat IS NOT NULL").withColumn("raw", bare), places)
    placed = named.withColumn("raw", F.concat_ws("\n", F.nullif("raw", F.lit("")), "place")).select(*files.columns)
    return marked.where("lat IS NULL").select(*files.columns).unionByName(placed)


def extract(files: DataFrame, profile: str = "content", media: bool = False, pdf_pages: int = 5, places: DataFrame | None = None, max_read_kb: int = 64) -> DataFrame:
    """path, name, parent, size, mtime_ns, extract_kind, body, snippet per file.

    With a city table, pictures with coordinates get the nearest city's name.  Plain text is decoded by Column expressions; only PDF, office and media files go to Python.
    A file that cannot be read has an empty body and counts as name-only."""
    budget = PROFILE_TOKENS[profile] * 4
    ext = T.extension(F.col("path"))
    special = ext.isin("pdf", *OFFICE_EXTENSIONS, *(MEDIA_EXTENSIONS if media else []))
    keep = ["path", "name", "parent", "size", "mtime_ns"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for e, content in zip(batch.column("ext").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if e in OFFICE_EXTENSIONS:
                    texts.append(office_text(content))
                elif e == "pdf":
                    texts.append(_tool(["pdftotext", "-q", "-l", str(pdf_pages), "{}", "-"], content))
                else:
                    texts.append(_tool(["exiftool", "-s", "-s", "-s", "-n", "-Title", "-Description", "-Keywords", "-Artist", "-Album", "-GPSLatitude", "-GPSLongitude", "{}"], content))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, "raw"])

    ship(files.sparkSession)
    others = F.when(ext.isin(*MEDIA_EXTENSIONS) | F.lit(budget == 0), F.lit("")).otherwise(F.coalesce(text_head(F.col("content"), budget, max_read_kb), F.lit("")))
    plain = files.where(~special).select(*keep, others.alias("raw"))
    other = files.where(special).select(*keep, ext.alias("ext"), "content").mapInArrow(run, "path string, name string, parent string, size long, mtime_ns long, raw string")
    if media and places is not None:
        other = with_places(other, places)
    both = plain.unionByName(other).withColumn("body", T.normalize_ws(F.col("raw"), budget)).drop("raw")
    return both.select(*keep, T.extract_kind(F.col("path"), F.col("body"), F.lit(profile), media).alias("extract_kind"), "body", T.snippet(F.col("body")).alias("snippet"))
