"""Paths, argument lists and captured tool output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_library(path: Column) -> Column:
    """The path has the segment pair of the installed library, in either spelling."""
    # The library's folder and, below, the file endings.
    return path.contains("/site-packages/sage/") | path.contains("\\site-packages\\sage\\")


def is_stub(path: Column) -> Column:
    """S3."""
    return is_library(path) & path.endswith(".pyi")


def shortened(text: Column, size: int = 60) -> Column:
    """L4: the first characters of a text, 60 for what a message shows of an expression."""
    return F.left(text, F.lit(size))


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def is_namespace_stub(path: Column) -> Column:
    """S4."""
    return is_stub(path) & (basename(path) == "all.pyi")


def wsl_path(path: Column) -> Column:
    """M6: a drive path as its mount; any other path only with forward slashes."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    drive = plain.rlike(r"(?s)^[A-Za-z]:/[^\n\r]*$")
    return F.when(drive, F.concat(F.lit("/mnt/"), F.lower(F.left(plain, F.lit(1))), F.substr(plain, F.lit(3)))).otherwise(plain)


def arguments(text: Column) -> Column:
    """Split at single spaces, blank parts dropped, no quoting."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), " ", -1), lambda x: x.rlike(r"\S"))


def execution_mode(mode: Column) -> Column:
    """An unknown stored mode is NATIVE."""
    return F.when(mode.isin("NATIVE", "WSL", "DOCKER"), mode).otherwise(F.lit("NATIVE"))


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"\S")


def wsl_executable_missing(executable: Column) -> Column:
    """P16."""
    return is_blank(executable) | executable.startswith("~")


def _lines(stdout: Column) -> Column:
    return F.split(F.regexp_replace(F.regexp_replace(stdout, r"^\s+|\s+$", ""), "\r\n?", "\n"), "\n", -1)


def detected_executable(stdout: Column) -> Column:
    """First line of the trimmed output, null if blank."""
    first = F.element_at(_lines(stdout), 1)
    return F.when(~is_blank(first), first)


def detected_image(stdout: Column) -> Column:
    """First line that contains the product's name in any case."""
    return F.get(F.filter(_lines(stdout), lambda x: F.lower(x).contains("sage")), F.lit(0))


def home_of(stdout: Column) -> Column:
    """L2: last line of the trimmed output."""
    last = F.element_at(_lines(stdout), -1)
    return F.when(~is_blank(last), F.trim(last))


def expand_home(path: Column, home: Column) -> Column:
    """M12."""
    return F.when(path.startswith("~/") & home.isNotNull(), F.concat(home, F.substr(path, F.lit(2)))).otherwise(path)


def strip_category(name: Column) -> Column:
    """M15."""
    return F.regexp_replace(name, "_with_category$", "")


def is_type_attribute(annotation: Column) -> Column:
    """M16."""
    return annotation.startswith("_Type_")


def display(name: Column, text: Column) -> Column:
    """M18."""
    return F.coalesce(name, text)


def new_file_label(language: Column) -> Column:
    """M19. Fixed values."""
    return F.when(language == "zh", F.lit("Sage 文件")).otherwise(F.lit("Sage File"))
