"""Repository trees: documentation folder, English branch, file choice, license gate.

``tree`` is ``(repo, pos, path, type)`` and a repository may hold a third of all
rows, so folders and languages are found by aggregates over distinct folder names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweir import params
from docweir.functions import markdown, paths
from docweir.operators.blocks import first_rows

# Fixed values.
FOLDER_PRIORITY = ("docs", "doc", "documentation", "guide", "guides", "content")
DOC_ENDINGS = ("md", "mdx", "rst")
SKIP_STEMS = (
    "changelog", "changes", "contributing", "contributors", "code_of_conduct", "license", "licence", "security",
    "pull_request_template", "issue_template",
)
SKIP_FOLDERS = (
    ".github", ".git", ".vscode", ".idea", "node_modules", "__pycache__", ".mypy_cache", ".pytest_cache",
    ".ruff_cache", "venv", ".venv", "test", "tests", "benchmarks", "bench", "examples", "example",
)
LICENSE_STEMS = ("license", "licence")
ALLOWED_LICENSES = (
    "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Unlicense", "Zlib", "PostgreSQL", "0BSD",
    "BlueOak-1.0.0", "BSL-1.0", "MPL-2.0", "EPL-2.0", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only",
    "LGPL-3.0-or-later", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "AGPL-3.0-only",
    "AGPL-3.0-or-later", "CC0-1.0", "CC-BY-3.0", "CC-BY-4.0", "CC-BY-SA-4.0", "Artistic-2.0",
)


def files(tree: DataFrame) -> DataFrame:
    return tree.where(F.col("type") == "blob").drop("type")


def doc_folder(tree: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """``(repo, doc_folder)``: the top-level folder that ranks first, null when none does.

    A request ``(repo, subpath)`` whose address names a path inside the repository, as
    ``urls.repo_address`` reads it, takes that path instead.
    """
    top = F.when(F.contains("path", F.lit("/")), F.substring_index("path", "/", 1))
    names = files(tree).groupBy("repo", top.alias("top")).agg(F.min("pos").alias("_pos"))
    order = F.array_position(F.array(*[F.lit(p) for p in FOLDER_PRIORITY]), F.lower("top"))
    found = names.groupBy("repo").agg(
        F.min_by(
            F.when(order > 0, F.col("top")),
            F.struct(
                F.when(order > 0, order).otherwise(99), F.lower("top") != F.col("top"), F.col("top")
            ),
        ).alias("doc_folder")
    )
    if requests is None:
        return found
    named = requests.where(F.col("subpath").isNotNull()).groupBy("repo").agg(F.min("subpath").alias("_named"))
    return found.join(named, "repo", "left").select("repo", F.coalesce("_named", "doc_folder").alias("doc_folder"))


def english_branch(tree: DataFrame, folders: DataFrame) -> DataFrame:
    """``(repo, doc_folder, excluded)``: narrow to an English child, or list foreign children."""
    rows = files(tree).join(folders, "repo")
    low, head = F.lower("path"), F.concat(F.lower("doc_folder"), F.lit("/"))
    rest = F.when(F.startswith(low, head), F.substring(low, F.length(head) + 1, F.length(low)))
    child = F.when(rest.rlike("^[^/]+/"), F.substring_index(rest, "/", 1))
    children = rows.groupBy("repo", "doc_folder", child.alias("child")).agg(F.lit(1).alias("_one"))
    english = F.coalesce(*[F.max(F.when(F.col("child") == e, F.lit(e))) for e in paths.ENGLISH])
    foreign = F.collect_set(F.when(paths.is_language(F.col("child")), F.col("child")))
    found = children.groupBy("repo", "doc_folder").agg(english.alias("_en"), foreign.alias("_foreign"))
    return found.select(
        "repo",
        F.when(F.col("_en").isNotNull(), F.concat("doc_folder", F.lit("/"), "_en"))
        .otherwise(F.col("doc_folder")).alias("doc_folder"),
        F.when(
            F.col("_en").isNull() & (F.size("_foreign") >= 2),
            F.transform("_foreign", lambda d: F.concat(F.col("doc_folder"), F.lit("/"), d)),
        ).otherwise(F.array().cast("array<string>")).alias("excluded"),
    )


def is_doc_file(path: Column, folder: Column) -> Column:
    low = F.lower(path)
    parts = F.split(low, "/")
    name = F.element_at(parts, -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    parents = F.slice(parts, F.lit(1), F.size(parts) - 1)
    inside = F.when(
        folder.isNotNull(), F.startswith(low, F.concat(F.lower(folder), F.lit("/")))
    ).otherwise(F.size(parts) == 1)
    return (
        name.rlike(r"\.(" + "|".join(DOC_ENDINGS) + ")$")
        & ~F.arrays_overlap(parents, F.array(*[F.lit(s) for s in SKIP_FOLDERS]))
        & ~stem.isin(*SKIP_STEMS)
        & inside
    )


def doc_files(tree: DataFrame, branches: DataFrame, max_files: int = params.REPO_FILE_CAP) -> DataFrame:
    """The first ``max_files`` documentation files of each repository, in tree order."""
    low = F.lower("path")
    kept = (
        files(tree)
        .join(branches, "repo", "left")
        .where(is_doc_file(F.col("path"), F.col("doc_folder")))
        .where(
            ~F.exists(
                F.coalesce("excluded", F.array().cast("array<string>")),
                lambda ex: F.startswith(low, F.concat(F.lower(ex), F.lit("/"))),
            )
        )
        .drop("excluded")
    )
    return first_rows(kept, "repo", [F.col("pos")], max_files, "rank", "pos")


def license_warnings(tree: DataFrame, branches: DataFrame) -> DataFrame:
    """License files in the documentation folder or a folder above it."""
    low = F.lower("path")
    stem = F.regexp_replace(F.element_at(F.split(low, "/"), -1), r"\.[^.]*$", "")
    parent = F.when(F.contains(low, F.lit("/")), F.regexp_replace(low, "/[^/]*$", ""))
    return (
        files(tree)
        .where(stem.isin(*LICENSE_STEMS))
        .join(branches.select("repo", "doc_folder"), "repo")
        .where(F.startswith(F.concat(F.lower("doc_folder"), F.lit("/")), F.concat(parent, F.lit("/"))))
        .select("repo", "pos", "path", "doc_folder")
    )


def license_gate(meta: DataFrame, fair_use: bool = True) -> DataFrame:
    """Add ``may_fetch``: fair use passes all, else the license must be a listed one."""
    listed = F.coalesce(F.col("spdx_id").isin(*ALLOWED_LICENSES), F.lit(False))
    return meta.withColumn("may_fetch", F.lit(True) if fair_use else listed)


def resolve_branch(requests: DataFrame, meta: DataFrame) -> DataFrame:
    """The branch named by the request, else the default one; repositories without either drop out."""
    return (
        requests.join(meta.select("repo", "spdx_id", "default_branch"), "repo", "left")
        .withColumn("branch", F.coalesce("branch", "default_branch"))
        .where(F.col("branch").isNotNull())
        .drop("default_branch")
    )


def repo_pages(chosen: DataFrame, branches: DataFrame, contents: DataFrame) -> DataFrame:
    """Fetched files as pages: address, path as title, JSX stripped from ``.mdx``."""
    rows = chosen.join(branches.select("repo", "owner", "branch"), "repo").join(contents, ["repo", "path"])
    return rows.select(
        "repo",
        "rank",
        F.concat(
            F.lit("https://github.com/"), "owner", F.lit("/"), "repo", F.lit("/blob/"), "branch", F.lit("/"), "path"
        ).alias("url"),
        F.col("path").alias("title"),
        F.when(F.endswith("path", F.lit(".mdx")), markdown.strip_jsx(F.col("content")))
        .otherwise(F.col("content")).alias("content"),
    )


def until_rate_limit(fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keep what was fetched before a repository's first rate-limit marker.

    ``fetched`` is ``(repo, rank, ..., rate_limited)``. Returns the kept rows and
    ``(repo, partial)`` flags.
    """
    first = fetched.groupBy("repo").agg(
        F.min(F.when(F.col("rate_limited"), F.col("rank"))).alias("_stop")
    )
    kept = (
        fetched.join(first, "repo")
        .where(F.col("_stop").isNull() | (F.col("rank") < F.col("_stop")))
        .drop("_stop", "rate_limited")
    )
    return kept, first.select("repo", F.col("_stop").isNotNull().alias("partial"))
