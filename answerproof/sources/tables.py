"""Readers and writers of the CSV and JSON files the jobs exchange."""

from __future__ import annotations

import csv
import fnmatch
import io
import uuid
from collections import defaultdict
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerproof.config import MISSING_WORDS
from answerproof.functions.text import as_col
from answerproof.operators.ranking import join_on
from answerproof.operators.schema import (
    POSITION,
    find_header,
    normalize_prompts,
    validate_prompts,
)
from answerproof.operators.small import is_empty, settle

# Delimiters and columns of the files.
DELIMITERS = ",\t;|"
SAMPLE_CHARS = 4096
SAMPLE_LINES = 400
LABELED_REQUIRED = ("prompt", "model_response", "correct_answer", "hallucinated")
LABELED_COLUMNS = (
    "template",
    "id",
    "prompt",
    "model_response",
    "correct_answer",
    "hallucinated",
    "baseline_exact",
    "baseline_embed",
    "baseline_embed_score",
    "baseline_embed_method",
    "reasoning",
)
PROMPT_COLUMNS = ("template", "id", "prompt", "correct_answer")

_CORRUPT = "__corrupt"
_PATH = "__path"


# ---- reading --------------------------------------------------------------------------------


def discover(spark: SparkSession, root: str, pattern: str = "responses_labeled_*.csv") -> DataFrame:
    """Paths of all files under ``root`` whose name, or whose folder's source, matches; sorted.

    The writers below put a table of part files where other tools put one file, in a folder
    ``source=<name of that file>``. File contents are not read.
    """
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*" + pattern[pattern.rfind(".") :])
        .load(root)
    )
    name = fnmatch.translate(pattern).removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z")
    own = F.regexp_extract("path", "/([^/]+)$", 1).rlike(f"^{name}$")
    return found.select("path").filter(own | _folder_value("source", "path").rlike(f"^{name}$")).orderBy("path")


def _folder_value(column: str, path: Column | str) -> Column:
    """Value of a ``column=value`` folder of a path, as it was written; empty if there is none."""
    raw = F.regexp_extract(as_col(path), f"/{column}=([^/]*)/", 1)
    return F.url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))


def file_path() -> Column:
    """Path of the file a row comes from, as it is (the metadata column has it URL-encoded)."""
    encoded = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
    return F.url_decode(encoded)


def sample_file(spark: SparkSession, path: str) -> str | None:
    """The whole first line of a file, and what else there is of its first 4,096 characters.

    None if there is no such file. Only the first lines are read, however large the file is.
    """
    try:
        lines = spark.read.text(path)
    except AnalysisException:
        return None
    # the header counts whole, however long; delimiters are guessed from the beginning
    head = F.monotonically_increasing_id() == 0
    told = lines.select(F.when(head, F.col("value")).otherwise(F.substring("value", 1, SAMPLE_CHARS)))
    first, *rest = [r[0] for r in told.limit(SAMPLE_LINES).collect()] or [""]
    return "\n".join([first, *rest])[: max(SAMPLE_CHARS, len(first))]


def sample_files(spark: SparkSession, paths: Sequence[str]) -> dict[str, str | None]:
    """Samples of many files, a few at a time: one very small job each."""
    with ThreadPoolExecutor(8) as pool:
        return dict(zip(paths, pool.map(lambda p: sample_file(spark, p), paths)))


def sniff_delimiter(sample: str) -> str:
    """Delimiter guessed from a sample; a comma when in doubt."""
    try:
        return csv.Sniffer().sniff(sample[:SAMPLE_CHARS], delimiters=DELIMITERS).delimiter
    except csv.Error:
        return ","


def header_of(sample: str, sep: str = ",") -> list[str]:
    """Column names in the first row of a sample."""
    return next(csv.reader(io.StringIO(sample.removeprefix("\ufeff")), delimiter=sep), [])


def read_cells(
    spark: SparkSession,
    paths: Sequence[str],
    columns: Sequence[str],
    sep: str = ",",
    multi_line: bool = True,
) -> DataFrame:
    """All cells as text (absent ones empty), file path, position and whether a row is too long.

    Quoted line breaks need ``multi_line``, which reads each file in one task. Turn it off for large
    files without them: those are then split.
    """
    fields = [T.StructField(c, T.StringType()) for c in [*columns, _CORRUPT]]
    frame = (
        spark.read.schema(T.StructType(fields))
        .option("columnNameOfCorruptRecord", _CORRUPT)
        .csv(
            list(paths), header=True, sep=sep, quote='"', escape='"', multiLine=multi_line,
            mode="PERMISSIVE", enforceSchema=True,
        )
    )
    # rows of another width come with their text; quoted parts aside, delimiters tell how wide
    bare = F.regexp_replace(F.col(_CORRUPT), '"[^"]*"', "")
    width = F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) + 1
    # Spark refuses queries that read that text alone, hence the (always true) look at a cell
    cell = F.length(F.coalesce(columns[0], F.lit(""))) >= 0
    too_long = F.coalesce((width > len(columns)) & cell, F.lit(False))
    return frame.select(
        *[F.coalesce(c, F.lit("")).alias(c) for c in columns],
        file_path().alias(_PATH),
        F.monotonically_increasing_id().alias(POSITION),
        too_long.alias("__too_long"),
    )


def read_prompts(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """One prompt file, cells as text (no cell is taken for missing), bad lines skipped."""
    sample = sample_file(spark, path)
    if not sample:
        raise FileNotFoundError(f"{path} is missing or empty")
    sep = sep or sniff_delimiter(sample)
    return _read_prompts(spark, [path], header_of(sample, sep), sep)


def _read_prompts(
    spark: SparkSession, paths: Sequence[str], header: Sequence[str], sep: str
) -> DataFrame:
    cells = read_cells(spark, paths, header, sep)
    return cells.filter(~F.col("__too_long")).drop("__too_long").withColumnRenamed(_PATH, "source")


def load_prompt_sets(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Prompt files in any accepted header spelling as one normalised table, by ``source``.

    Files that are missing, empty or lack a prompt or answer column are skipped. Files with the same
    header and delimiter are read and normalised together.
    """
    groups: dict[tuple[str, ...], list[str]] = defaultdict(list)
    for path, sample in sample_files(spark, paths).items():
        if not sample:
            continue
        sep = sniff_delimiter(sample)
        header = header_of(sample, sep)
        if find_header(header, "prompt") and find_header(header, "correct_answer"):
            groups[(sep, *header)].append(path)
    sets = [
        normalize_prompts(_read_prompts(spark, members, header, sep))
        for (sep, *header), members in groups.items()
    ]
    return _union(spark, sets, ("source", *PROMPT_COLUMNS, POSITION))


def validate_prompt_file(spark: SparkSession, path: str) -> DataFrame:
    """One row (ok, message) on a prompt file: there, not empty, and with a filled prompt column."""
    sample = sample_file(spark, path)
    name = path.rsplit("/", 1)[-1]
    if sample:
        return validate_prompts(read_prompts(spark, path))
    problem = f"no file {name}" if sample is None else f"nothing in {name}"
    return spark.createDataFrame([(False, problem)], "ok boolean, message string")


def _union(spark: SparkSession, frames: list[DataFrame], columns: Sequence[str]) -> DataFrame:
    if not frames:
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def blank_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cells that analysis readers take for missing become NULL."""
    return df.withColumns({c: F.when(~F.col(c).isin(*MISSING_WORDS), F.col(c)) for c in columns})


def read_labeled(
    spark: SparkSession,
    paths: Sequence[str],
    required: Sequence[str] = LABELED_REQUIRED,
    on_problem: str = "skip",
    missing_words: bool = True,
    multi_line: bool = True,
) -> DataFrame:
    """Labelled CSV files as one table, with ``run``, ``source_file`` and ``source``.

    Files are read per distinct header in one scan each. With ``on_problem="skip"`` files that are
    missing, malformed or lack a required column are left out; with ``"fail"`` they raise.
    """
    groups: dict[tuple[str, ...], list[str]] = defaultdict(list)
    for path, sample in sample_files(spark, paths).items():
        header = header_of(sample or "")
        lacking = sorted(set(required) - set(header))
        if on_problem == "fail" and not sample:
            raise FileNotFoundError(f"{path} is missing or empty")
        if on_problem == "fail" and lacking:
            raise ValueError(f"{path} missing required columns: {lacking}")
        if not lacking:
            groups[tuple(header)].append(path)
    frames = []
    for header, members in groups.items():
        cells = read_cells(spark, members, header, multi_line=multi_line)
        malformed = settle(cells.filter("__too_long").select(_PATH).distinct())
        if not is_empty(malformed):
            if on_problem == "fail":
                named = sorted(r[0] for r in malformed.limit(20).collect())
                raise ValueError(f"malformed rows in {named}")
            cells = join_on(cells, malformed, [_PATH], "left_anti")
        cells = cells.drop("__too_long")
        frames.append(blank_missing(cells, header) if missing_words else cells)
    table = _union(spark, frames, [*required, _PATH, POSITION])
    # tables written by write_labeled keep run and file name in their folders
    folder, run = _folder_value("source", _PATH), _folder_value("run", _PATH)
    name = F.when(folder != "", folder).otherwise(F.substring_index(_PATH, "/", -1))
    above = F.regexp_extract(_PATH, "([^/]+)/(?:processed|raw)/[^/]*$", 1)
    return table.withColumns(
        {
            "run": F.when(run != "", run).otherwise(above),
            "source_file": name,
            "source": source_name(name),
        }
    ).drop(_PATH)


def source_name(file_name: Column | str) -> Column:
    """File name without a literal ``_labeled.csv``."""
    return F.replace(as_col(file_name), F.lit("_labeled.csv"), F.lit(""))


# ---- writing --------------------------------------------------------------------------------


def labeled_name(prompt_file: Column | str) -> Column:
    """Name of the labelled file that belongs to a prompt file."""
    return F.replace(as_col(prompt_file), F.lit("prompts"), F.lit("responses_labeled"))


def _write_csv(writer: DataFrameWriter, out: str, mode: str, **options: bool) -> None:
    """CSV that the readers above read back cell for cell, outer blanks included."""
    writer.csv(
        out, mode=mode, header=True, quote='"', escape='"', emptyValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, **options,
    )


def write_labeled(df: DataFrame, out: str, by: Sequence[str] = ("run", "source")) -> None:
    """Labelled rows as CSV, one folder per run and source, named after the prompt file.

    Rows are clustered by neither run nor source first: a hot run would then be written by one
    task. Every task writes its own part file of each folder instead.
    """
    kept = [c for c in LABELED_COLUMNS if c in df.columns]
    renamed = df.withColumn("source", labeled_name("source")) if "source" in by else df
    _write_csv(renamed.select(*by, *kept).write.partitionBy(*by), out, "errorifexists")


def write_prompts(df: DataFrame, out: str) -> None:
    """A prompt set, every cell quoted, columns in order; replaces an earlier one, refuses none.

    The new set is complete before the earlier one is renamed aside, and that one is dropped when the
    new set is in its place: at any moment one of them is there whole. A name with ``.old-`` that is left
    behind is an earlier set whose replacement was cut short.
    """
    ordered = df.select(*PROMPT_COLUMNS)
    if is_empty(ordered):
        raise ValueError("refusing to write an empty prompt set")
    place, tag = out.rstrip("/"), uuid.uuid4().hex
    fresh, aside = f"{place}.new-{tag}", f"{place}.old-{tag}"
    _write_csv(ordered.write, fresh, "errorifexists", quoteAll=True)
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    old, new, earlier = (jvm.org.apache.hadoop.fs.Path(p) for p in (place, fresh, aside))
    store = old.getFileSystem(conf)
    replaced = store.exists(old)
    if replaced and not store.rename(old, earlier):
        raise OSError(f"the new set is in {fresh}; {out} could not be renamed")
    moved = False
    try:
        moved = store.rename(new, old)
    finally:
        if replaced and not moved:
            store.rename(earlier, old)
    if not moved:
        raise OSError(f"the new set is in {fresh}, but could not be renamed to {out}")
    if replaced:
        store.delete(earlier, True)


def write_audit(df: DataFrame, out: str) -> None:
    """An audit sample; an existing one is never overwritten, it may hold reviews."""
    _write_csv(df.write, out, "errorifexists")


def write_metrics(df: DataFrame, out: str, by: str = "source") -> None:
    """Metric records as JSON, one folder per source."""
    df.write.partitionBy(by).json(out, mode="overwrite")


def write_processed(df: DataFrame, out: str) -> None:
    """The table behind the report page."""
    kept = df.select("prompt", "model_response", "is_correct", "hallucinated")
    _write_csv(kept.write, out, "overwrite")
