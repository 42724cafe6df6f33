"""Path predicates and path algebra as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions by language.
LANGUAGE_EXTENSIONS = {
    "typescript": [".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs"],
    "python": [".py"],
    "go": [".go"],
    "rust": [".rs"],
}

# Directories never scanned.
IGNORED_DIRS = [
    "node_modules", ".git", "dist", "build", "out", "coverage", ".next", ".nuxt",
    ".svelte-kit", ".vercel", ".turbo", ".cache", ".parcel-cache", ".output", ".astro",
    ".vinxi", ".wrangler", "vendor", "third_party", "bower_components", "jspm_packages",
    ".yarn", "storybook-static", "target", "__generated__",
]

# Generated files, declaration files and test files.
GENERATED_NAMES = [
    r"(?i)\.(?:min|bundle|generated|gen)\.[cm]?[jt]sx?$",
    r"(?i)(?:\.pb\.go|_pb2\.py|\.generated\.\w+)$",
]
DECLARATION_NAMES = r"\.d\.[cm]?ts$|\.pyi$"
SCRIPT_TEST_NAMES = r"\.(?:test|spec)\.[cm]?[jt]sx?$"
SCRIPT_TEST_DIRS = ["test", "tests", "__tests__", "spec", "e2e"]
PYTHON_TEST_DIRS = ["test", "tests", "__tests__"]


def known_extensions() -> list[str]:
    return sorted({ext for group in LANGUAGE_EXTENSIONS.values() for ext in group})


def in_locale_order(path: Column) -> Column:
    """Sort key for orders people read; plain columns sort by code unit."""
    return F.collate(path, "UNICODE")


def segments(path: Column) -> Column:
    return F.split(path, "/")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_of(path: Column) -> Column:
    """Directory of a path; the empty string is the root, which has no parent."""
    cut = F.length(path) - F.length(base_name(path)) - 1
    return F.when(path == "", F.lit(None).cast("string")).otherwise(
        F.substring(path, F.lit(1), F.greatest(cut, F.lit(0)))
    )


def depth_of(path: Column) -> Column:
    return F.when(path == "", F.lit(0)).otherwise(F.size(segments(path)))


def prefixes(path: Column) -> Column:
    """The path itself and every directory above it, the root left out."""
    parts = segments(path)
    return F.when(path == "", F.array().cast("array<string>")).otherwise(
        F.transform(
            F.sequence(F.lit(1), F.size(parts)),
            lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
        )
    )


def ancestors(path: Column) -> Column:
    """All areas that contain a path: the root first, then each directory."""
    parts = segments(path)
    above = F.when(
        F.size(parts) > 1,
        F.transform(
            F.sequence(F.lit(1), F.size(parts) - 1),
            lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
        ),
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(F.lit("")), above)


def in_scope(path: Column, area: str | None) -> Column:
    if not area or area == ".":
        return F.lit(True)
    return (path == area) | path.startswith(area + "/")


def is_below(path: Column, area: str) -> Column:
    return path != "" if area == "" else path.startswith(area + "/")


def relative_to(area: Column, path: Column) -> Column:
    inside = (area != "") & F.startswith(path, F.concat(area, F.lit("/")))
    return F.when(inside, F.substring(path, F.length(area) + 2, F.length(path))).otherwise(path)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^.]*$", 0))


def language(path: Column) -> Column:
    """Language id by the last extension, null where the language is not scanned."""
    found = F.lit(None).cast("string")
    for name, extensions in LANGUAGE_EXTENSIONS.items():
        found = F.when(extension(path).isin(extensions), F.lit(name)).otherwise(found)
    return found


def is_source_path(path: Column) -> Column:
    return language(path).isNotNull() & ~path.rlike(DECLARATION_NAMES)


def _has_segment(path: Column, names: list[str]) -> Column:
    return F.arrays_overlap(segments(path), F.array(*[F.lit(name) for name in names]))


def is_test_path(path: Column) -> Column:
    name = base_name(path)
    lang = language(path)
    return (
        F.when(
            lang == "typescript",
            path.rlike(SCRIPT_TEST_NAMES) | _has_segment(path, SCRIPT_TEST_DIRS),
        )
        .when(
            lang == "python",
            name.startswith("test_")
            | name.endswith("_test.py")
            | _has_segment(path, PYTHON_TEST_DIRS),
        )
        .when(lang == "go", path.endswith("_test.go"))
        .when(lang == "rust", _has_segment(path, ["tests"]) & (path != "tests"))
        .otherwise(F.lit(False))
    )


def is_candidate(path: Column, ignored_dirs: list[str] | None = None) -> Column:
    """Scannable source path; pattern files are applied on top of this."""
    names = IGNORED_DIRS if ignored_dirs is None else ignored_dirs
    keep = ~path.startswith("/") & ~path.contains("..") & is_source_path(path)
    for pattern in GENERATED_NAMES:
        keep = keep & ~base_name(path).rlike(pattern)
    hidden = F.exists(segments(path), lambda part: part.startswith("."))
    return keep & ~hidden & ~_has_segment(path, names)
