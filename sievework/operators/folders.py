"""Chosen and skipped folders, repositories, and the gates that a crawled file passes."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rules

#: The header of a cache folder's tag; size limits of code; marks of generated code.
CACHE_TAG = "Signature: 8a477f597d28d172789f06886806bc55"
CODE_BYTES, NOTEBOOK_BYTES = 1 << 20, 20 << 20
GENERATED = ["DO NOT EDIT", "@generated", "Code generated by", "Autogenerated by", "Generated by the protocol"]
LIBRARIES, BUNDLES = ["photoslibrary", "photolibrary"], ["app", "bundle", "framework", "photoslibrary", "photolibrary", "rtfd", "pages", "numbers", "key", "xcodeproj", "xcworkspace", "playground"]


#: What may be said of a folder. Kept folders are searched like chosen ones.
CHOSEN, SKIPPED, KEPT = "chosen", "skipped", "kept"
CHOICES = "folder string, choice string"


def parent(path: str) -> str:
    return path.rstrip("/").rpartition("/")[0] or "/"


def _closed(name: str) -> bool:
    """A folder's name into which no walk goes from above."""
    return name.startswith(".") or name.endswith(".noindex") or name in rules.SKIPPED_FOLDERS


def _depth(path: Column) -> Column:
    """Components of a path; none for the root."""
    return F.when(path == "/", 0).otherwise(F.size(F.split(path, "/")) - 1)


def _closed_depth(path: Column) -> Column:
    """The depth of the last component of a path into which no walk goes."""
    names = F.split(path, "/")
    closed = F.transform(names, lambda p, i: F.when(p.startswith(".") | p.isin(rules.SKIPPED_FOLDERS) | p.endswith(".noindex"), i).otherwise(0))
    return F.array_max(closed)


def _above(choices: DataFrame, folders: DataFrame, strict: bool = False) -> DataFrame:
    """folder, on, off: of each folder the depth of the deepest chosen and of the deepest skipped folder that holds it or is
    it (strict: that holds it, for the chosen ones). A row for each folder that has any."""
    known = choices.select(F.col("folder").alias("top"), F.when(F.col("choice") == SKIPPED, SKIPPED).otherwise(CHOSEN).alias("choice")).distinct()
    up = F.concat(F.when(F.col("folder") == "/", F.array().cast("array<string>")).otherwise(F.transform(rules.ancestors(F.col("folder")), lambda x: F.when(x == "", "/").otherwise(x))), F.array("folder"))
    met = folders.select("folder", F.explode(up).alias("top")).join(known, "top")
    use = (F.col("choice") == CHOSEN) & (F.col("top") != F.col("folder")) if strict else F.col("choice") == CHOSEN
    depth = _depth(F.col("top"))
    return met.groupBy("folder").agg(F.max(F.when(use, depth)).alias("on"), F.max(F.when(F.col("choice") == SKIPPED, depth)).alias("off"))


def standing(paths: DataFrame, choices: DataFrame) -> DataFrame:
    """paths (path, and other columns) with `searched` and `searched_as`, the closest folder that searches it.

    A path is searched by the deepest chosen folder on its way or not at all: any skip or closed component below that
    one is below all others too. So two depths decide, that of the deepest chosen folder against those of the deepest
    skip and closed component. They are found once for each folder of paths, by a join on the folders above it, however many
    choices (folder, choice) there are; repeated choices count once, null ones not at all."""
    folder, own = F.coalesce(F.nullif(rules.folder_of(F.col("path")), F.lit("")), F.lit("/")), F.col("path")
    rows = paths.withColumn("__folder", folder)
    tops = _above(choices, rows.select(F.col("__folder").alias("folder")).where("folder is not null").distinct()).select(F.col("folder").alias("__folder"), F.col("on").alias("__on"), F.col("off").alias("__off"))
    # A path may itself be a folder that was chosen or skipped.
    said = choices.groupBy(F.col("folder").alias("__said")).agg(F.max(F.col("choice") != SKIPPED).alias("__chosen"), F.max(F.col("choice") == SKIPPED).alias("__left"))
    both = rows.join(tops, "__folder", "left").join(said, F.col("path") == F.col("__said"), "left")
    depth = _depth(own)
    on = F.coalesce(F.when(F.col("__chosen"), depth), F.col("__on"))
    off = F.greatest(F.when(F.col("__left"), depth), F.col("__off"), _closed_depth(own))
    searched = F.coalesce(on >= F.coalesce(off, F.lit(0)), F.lit(False))
    top = F.when(on == 0, "/").otherwise(F.array_join(F.slice(F.split(own, "/"), F.lit(1), on + 1), "/"))
    return both.withColumns({"searched": searched, "searched_as": F.when(searched, top)}).drop("__folder", "__on", "__off", "__said", "__chosen", "__left")


def effective(choices: DataFrame) -> DataFrame:
    """Of choices (folder, choice) those that make a difference: chosen folders that no other one searches, and skips
    below a chosen folder."""
    above = _above(choices, choices.select("folder").distinct(), strict=True)
    rows = choices.distinct().join(above, "folder", "left")
    covered = F.coalesce(F.col("on") >= F.greatest(F.coalesce("off", F.lit(0)), _closed_depth(F.col("folder"))), F.lit(False))
    return rows.where(F.when(F.col("choice") == SKIPPED, F.col("on").isNotNull()).otherwise(~covered)).select("folder", "choice")


def marks(folders: DataFrame, choices: DataFrame) -> DataFrame:
    """folder, mark: on, mixed or off, by the folder itself and the choices just below it."""
    all_ = standing(choices.select(F.col("folder").alias("path"), "choice"), choices)
    up = F.coalesce(F.nullif(rules.folder_of(F.col("path")), F.lit("")), F.lit("/"))
    below = all_.where("path <> '/'").groupBy(up.alias("path")).agg(F.max((F.col("choice") == SKIPPED) & ~F.col("searched")).alias("less"), F.max(F.col("choice") != SKIPPED).alias("more"))
    rows = standing(folders.select(F.col("folder").alias("path")), choices).join(below, "path", "left")
    mixed = F.when(F.col("searched"), F.coalesce("less", F.lit(False))).otherwise(F.coalesce("more", F.lit(False)))
    return rows.select(F.col("path").alias("folder"), F.when(mixed, "mixed").when(F.col("searched"), "on").otherwise("off").alias("mark"))


@dataclass(frozen=True)
class Selection:
    """A short list of choices, as one person makes them; edits give a new selection. `table` gives them for `standing`."""

    chosen: tuple[str, ...] = ()
    skipped: tuple[str, ...] = ()
    kept: tuple[str, ...] = ()

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(f, choice) for choice, these in ((CHOSEN, self.chosen), (SKIPPED, self.skipped), (KEPT, self.kept)) for f in these], CHOICES)

    def _way(self, path: str, strict: bool = False) -> tuple[str | None, bool]:
        """The deepest chosen folder on the way to a path, and whether a skip or closed component lies below it."""
        way, name = ["/"], ""
        for part in path.strip("/").split("/") if path != "/" else ():
            name += f"/{part}"
            way.append(name)
        tops = {*self.chosen, *self.kept}
        on = max((k for k, f in enumerate(way) if f in tops and not (strict and f == path)), default=-1)
        off = max((k for k, f in enumerate(way) if f in self.skipped or _closed(f.rpartition("/")[2])), default=-1)
        return (way[on], off > on) if on >= 0 else (None, True)

    def searched(self, path: str) -> bool:
        return not self._way(path)[1]

    def searched_as(self, path: str) -> str | None:
        """The closest folder that searches the path."""
        folder, cut = self._way(path)
        return None if cut else folder

    def folders(self) -> list[str]:
        """Kept and chosen folders, without those that another one searches."""
        return [f for f in dict.fromkeys((*self.kept, *self.chosen)) if self._way(f, strict=True)[1]]

    def effective_skips(self) -> list[str]:
        """Skips that leave something out."""
        return [s for s in self.skipped if self._way(s, strict=True)[0] is not None]

    def mark(self, folder: str) -> str:
        """on, mixed or off, by the folder itself and the choices just below it."""
        on = self.searched(folder)
        near = [f for f in (self.skipped if on else (*self.kept, *self.chosen)) if f != "/" and parent(f) == folder]
        return "mixed" if any(not on or not self.searched(f) for f in near) else "on" if on else "off"

    def with_folder(self, folder: str, on: bool) -> Selection:
        """The folder with its subfolders, or none of it."""
        far = lambda these: tuple(f for f in these if f == "/" or parent(f) != folder)
        return replace(self, chosen=far(self.chosen), skipped=far(self.skipped)).with_subfolder(folder, on)

    def with_subfolder(self, folder: str, on: bool) -> Selection:
        """One folder; choices inside it stay. What says the opposite goes, and the choice is added where that is not
        enough."""
        against, added = (SKIPPED, CHOSEN) if on else (CHOSEN, SKIPPED)
        left = replace(self, **{against: tuple(f for f in getattr(self, against) if f != folder)})
        return left if left.searched(folder) == on else replace(left, **{added: (*getattr(left, added), folder)})


def is_searched(path: Column, folders: list[str], skipped: list[str] = ()) -> Column:
    """`standing` of a column for a short list of folders: prefix tests, which the scan can use."""
    below = lambda skip, folder: skip.startswith(folder.rstrip("/") + "/")
    apart = lambda skip: (path != skip) & ~rules.is_inside(path, F.lit(skip))
    ways = [reduce(lambda a, b: a & b, [apart(s) for s in skipped if below(s, f)], rules.is_walked(path, F.lit(f))) for f in folders]
    return reduce(lambda a, b: a | b, ways, F.lit(False))


def post_filter(hits: DataFrame, folders: list[str], skipped: list[str] = (), types: list[str] = (), present: DataFrame | None = None) -> DataFrame:
    """Hits under searched folders, of types that aren't left out, whose files are there. After the limit, so fewer may
    come back."""
    kept = hits.where(is_searched(F.col("path"), folders, skipped) & ~rules.extension_of(F.col("path")).isin(list(types)))
    return kept if present is None else kept.join(present.select("path"), "path", "left_semi")


def in_bundle(path: Column) -> Column:
    """Whether a folder on the way is a bundle, which is never entered."""
    return F.exists(F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), lambda p: F.lower(F.regexp_extract(p, r"[^.]\.([^.]+)$", 1)).isin(BUNDLES))


def change_may_matter(path: Column, is_folder: Column, excluded: list[str] = ()) -> Column:
    """A change of a folder, or of a file of a type that is indexed, outside bundles."""
    bundle = F.lower(rules.extension_of(path)).isin(BUNDLES) & is_folder
    return ~in_bundle(path) & ~bundle & (is_folder | (rules.classify(path, excluded)["action"] == "index"))


def is_cache_tag(name: Column, head: Column) -> Column:
    """A CACHEDIR.TAG with the header that its specification asks for."""
    return (name == "CACHEDIR.TAG") & (F.substring(head, 1, len(CACHE_TAG)).cast("string") == CACHE_TAG)


def folder_skip_reason(folder: Column, home: Column, excluded: list[str] = (), cached: Column | None = None) -> Column:
    """Why a crawl doesn't enter a folder, or null."""
    name, out = rules.name_of(folder), F.lit(False)
    for e in excluded:
        out = out | (folder == e) | rules.is_inside(folder, F.lit(e))
    return (
        F.when(name.isin(rules.SKIPPED_FOLDERS), "developer folder")
        .when(name.endswith(".noindex"), ".noindex folder")
        .when(F.lit(False) if cached is None else cached, "cache folder")
        .when(folder == F.concat(home, F.lit("/Library")), "~/Library")
        .when(out, "excluded folder")
    )


def code_folder_skip_reason(folder: Column, git_is_file: Column) -> Column:
    """The same for code search: built or vendored code, submodules and worktrees (whose .git is a file)."""
    return F.when(rules.name_of(folder).isin(rules.CODE_SKIPPED_FOLDERS), "vendored or built code").when(git_is_file, "submodule or worktree")


def file_gate(path: Column, regular: Column, in_cloud: Column, is_package: Column) -> Column:
    """Why a file is left out before its type is looked at, or null."""
    package = F.when(rules.extension_of(path).isin(LIBRARIES), "Photos library").otherwise("app or bundle")
    return F.when(is_package, package).when(~regular, "link or special file").when(in_cloud, "in the cloud, not downloaded")


def code_size_gate(path: Column, size: Column) -> Column:
    limit = F.when(rules.extension_of(path) == "ipynb", NOTEBOOK_BYTES).otherwise(CODE_BYTES)
    return F.when(size > limit, "too big to be written by hand")


def code_text_gate(text: Column, is_source: Column) -> Column:
    """Why code isn't read: a private key, generated or minified code; or null."""
    made = F.coalesce(*[F.when(F.substring(text, 1, 1000).contains(m), F.lit(f"made by a program (“{m}”)")) for m in GENERATED])
    lines = F.greatest(F.lit(1), F.regexp_count(text, F.lit("\n")) + F.when((F.length(text) > 0) & ~text.endswith("\n"), 1).otherwise(0))
    average = F.floor(F.length(text) / lines)
    long = F.exists(F.split(text, "\n"), lambda x: F.length(x) > 3000)
    minified = F.when((average > 300) & long, F.concat(F.lit("minified ("), average.cast("string"), F.lit(" characters a line)")))
    return F.when(text.contains("PRIVATE KEY-----"), "holds a private key").when(is_source, F.coalesce(made, minified))


def is_text(head: Column) -> Column:
    """No zero byte in a file's first 8,000."""
    return ~F.hex(F.substring(head, 1, 8000)).rlike("^(..)*?00")


def nearest_repo(paths: DataFrame, repos: DataFrame) -> DataFrame:
    """paths with `repo`: the deepest of repos (folder) that holds them, by an equi-join on their folders."""
    above = paths.select("path", F.explode(rules.ancestors(F.col("path"))).alias("folder"))
    own = above.join(repos.select("folder").distinct(), "folder").groupBy("path").agg(F.max_by("folder", F.length("folder")).alias("repo"))
    return paths.join(own, "path", "left")


def git_kept(files: DataFrame, repos: DataFrame, listed: DataFrame) -> DataFrame:
    """Files that git keeps: those of listed (repo, relative) in their nearest repository, and all outside any. A
    repository that isn't listed counts whole."""
    placed = nearest_repo(files, repos)
    known = listed.select(F.col("repo").alias("has")).distinct()
    placed = placed.join(known, placed["repo"] == known["has"], "left").withColumn("relative", F.substring("path", F.length("repo") + 2, F.lit(1 << 30)))
    free = placed.where("has is null")
    kept = placed.where("has is not null").join(listed.select("repo", "relative").distinct(), ["repo", "relative"], "left_semi")
    return free.select(*files.columns, "repo").unionByName(kept.select(*files.columns, "repo"))


def code_place(paths: DataFrame, projects: DataFrame) -> DataFrame:
    """path, repo, title: a file's path from its project's own name on; outside any, its folder's name and its own."""
    placed = nearest_repo(paths.select("path"), projects)
    below = F.substring("path", F.length(rules.folder_of(F.col("repo"))) + 2, F.lit(1 << 30))
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    return placed.select("path", "repo", F.when(F.col("repo").isNotNull(), below).otherwise(F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), "/")).alias("title"))
