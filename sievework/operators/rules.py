"""Classification rules over file paths, as Column expressions, and rules over whole folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of files by extension and name.
DOC = "txt text md markdown typ rtf docx doc odt html htm xlsx pptx ods odp".split()
IMAGE = "jpg jpeg jpe jfif png gif bmp tif tiff webp heic heif avif psd tga pnm ppm pgm cr2 nef arw dng raf orf rw2".split()
AUDIO = "mp3 m4a m4b aac wav wave flac ogg oga opus aiff aif wma amr caf mka".split()
VIDEO = "mp4 m4v mov mkv webm avi wmv flv 3gp 3g2 mpg mpeg m2v ogv mxf".split()
CODE = (
    "py ipynb c h cc cpp cxx hpp hh m mm swift tsx cts js jsx mjs cjs go rs java kt kts scala rb php cs fs sh bash zsh "
    "fish ps1 lua pl r jl dart sql vue svelte css scss sass less json jsonl yaml yml toml xml plist gradle cmake mk lock "
    "log csv tsv ini cfg conf proto graphql tf nix zig hs ex exs erl clj elm ml vim el asm metal glsl hlsl wgsl cu pyi pyc"
).split()
SOURCE = (
    "py pyi pyx c h cc cpp cxx hpp hh hxx m mm swift ts tsx mts cts js jsx mjs cjs go rs java kt kts scala groovy rb php "
    "cs fs sh bash zsh fish ps1 lua pl pm r jl dart sql vue svelte astro html htm css scss sass less gradle cmake mk proto "
    "graphql gql tf hcl nix zig hs ex exs erl clj cljs elm ml mli vim el lisp asm s metal glsl hlsl wgsl cu cuh ino v sv tex"
).split()
CODE_TEXT = "md markdown rst adoc org typ txt yaml yml toml".split()
CODE_NAMES = "Makefile makefile GNUmakefile Dockerfile Containerfile Justfile justfile Rakefile Gemfile Podfile Brewfile Procfile Vagrantfile Jenkinsfile".split()
SECRET = "pem key p12 pfx keystore jks ppk kdbx gpg asc crt cer der p8 mobileprovision".split()
SECRET_NAMES = "id_rsa id_dsa id_ecdsa id_ed25519 .env secret credential .netrc .npmrc .pypirc htpasswd .htpasswd".split()
SKIPPED_FOLDERS = "node_modules bower_components venv site-packages __pycache__ DerivedData Pods Carthage".split()
CODE_SKIPPED_FOLDERS = (
    "vendor Vendor vendored third_party third-party thirdparty 3rdparty external extern deps build Build dist out target "
    "obj coverage htmlcov generated __generated__ wandb mlruns lightning_logs"
).split()
PROJECT_MARKERS = ".git package.json Package.swift pyproject.toml setup.py requirements.txt Cargo.toml go.mod pom.xml build.gradle build.gradle.kts Gemfile composer.json CMakeLists.txt".split()
CAMERA = "img dsc pxl mvimg vid gopr dji photo whatsapp screenshot".split()
HEX_NAME = r"^[0-9a-f]{8,}([-_][0-9a-f]{4,})*$"
COUNTED_NAME = r"^[a-z]{0,16}[-_. ]?\d{3,}([-_.]\d+)*$"
DATED_NAME = r"^(19|20)\d{2}[-_.]?(0[1-9]|1[0-2])[-_.]?(0[1-9]|[12]\d|3[01])([-_. (]|$)"
SCREENSHOT = r"^(Screenshot|Screen Shot|CleanShot|SCR-)"
DATASET_LEAST, DATASET_SHARE = 300, 0.7


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def extension_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(name_of(path), r"[^/]\.([^./]+)$", 1))


def stem_of(path: Column) -> Column:
    return F.regexp_replace(name_of(path), r"(?<=.)\.[^.]*$", "")


def _result(action: str, kind: str | None = None, reason: str | None = None) -> Column:
    return F.struct(F.lit(action).alias("action"), F.lit(kind).cast("string").alias("kind"), F.lit(reason).cast("string").alias("reason"))


def is_transport_stream(head: Column) -> Column:
    """MPEG-TS packets in a file's first 600 bytes."""
    at = lambda i: F.hex(F.substring(head, i + 1, 1)) == "47"
    return (F.octet_length(head) >= 400) & ((at(0) & at(188) & at(376)) | (at(4) & at(196) & at(388)))


def is_screenshot(path: Column) -> Column:
    return name_of(path).rlike(SCREENSHOT) | (F.lower(name_of(folder_of(path))) == "screenshots")


def is_secret(path: Column) -> Column:
    name = F.lower(name_of(path))
    starts = F.lit(False)
    for prefix in SECRET_NAMES:
        starts = starts | name.startswith(prefix)
    return extension_of(path).isin(SECRET) | starts


def classify(path: Column, excluded: list[str] = (), include_code: bool = False, stream: Column | None = None) -> Column:
    """struct(action, kind, reason): index, skip or ignore, by the first rule that holds."""
    ext, stream = extension_of(path), F.lit(False) if stream is None else stream
    code = _result("index", "doc") if include_code else _result("skip", reason="code")
    return (
        F.when(ext.isin(list(excluded)), _result("skip", reason="excluded type"))
        .when(ext == "m4p", _result("skip", reason="copy-protected"))
        .when(ext.isin("ts", "mts", "m2ts"), F.when(stream, _result("index", "video")).otherwise(code))
        .when(ext.isin(DOC), _result("index", "doc"))
        .when(ext.isin(CODE), code)
        .when(ext == "pdf", _result("index", "pdf"))
        .when(ext.isin(IMAGE), F.when(is_screenshot(path), _result("index", "screenshot")).otherwise(_result("index", "image")))
        .when(ext.isin(VIDEO), _result("index", "video"))
        .when(ext.isin(AUDIO), _result("index", "audio"))
        .otherwise(_result("ignore"))
    )


def classify_code(path: Column, excluded: list[str] = (), stream: Column | None = None) -> Column:
    """The same for the code index."""
    name, ext, stream = name_of(path), extension_of(path), F.lit(False) if stream is None else stream
    return (
        F.when(ext.isin(list(excluded)), _result("skip", reason="excluded type"))
        .when(is_secret(path), _result("skip", reason="key or password file"))
        .when(F.lower(name).rlike(r"\.min\.(js|mjs|css)$"), _result("skip", reason="minified"))
        .when(F.lower(name).rlike(r"^(license|licence|copying|notice)"), _result("skip", reason="license"))
        .when(ext.isin("ts", "mts") & stream, _result("ignore"))
        .when(ext.isin(SOURCE + CODE_TEXT + ["ipynb"]) | name.isin(CODE_NAMES) | name.startswith("Dockerfile"), _result("index", "code"))
        .when(ext.isin(CODE), _result("skip", reason="data file"))
        .otherwise(_result("ignore"))
    )


def looks_machine_named(stem: Column) -> Column:
    name = F.lower(stem)
    return ~name.rlike("^(" + "|".join(CAMERA) + ")") & ~name.rlike(DATED_NAME) & (name.rlike(HEX_NAME) | name.rlike(COUNTED_NAME))


def is_walked(path: Column, root: Column) -> Column:
    """Whether a crawl of root goes to path: no hidden or skipped component below the root."""
    below = F.split(F.substring(path, F.length(root) + 2, F.lit(1 << 30)), "/")
    fine = F.forall(below, lambda p: ~p.startswith(".") & ~p.isin(SKIPPED_FOLDERS) & ~p.endswith(".noindex"))
    return (path == root) | (is_inside(path, root) & fine)


def is_inside(path: Column, folder: Column) -> Column:
    """Whole components: /ab is not inside /a."""
    return path.startswith(F.concat(folder, F.lit("/")))


def ancestors(path: Column) -> Column:
    """All folders above a path, nearest last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def dataset_folders(files: DataFrame, roots: list[str] = (), least: int = DATASET_LEAST, share: float = DATASET_SHARE) -> DataFrame:
    """Folders (path, kind -> folder, n) that hold hundreds of machine-named media files of one kind."""
    media = files.where(F.col("kind").isin("image", "audio", "video")).withColumn("folder", folder_of(F.col("path")))
    media = media.where(~F.col("folder").isin(list(roots)))
    named = media.groupBy("folder", "kind").agg(F.count(F.lit(1)).alias("n"), F.avg(looks_machine_named(stem_of(F.col("path"))).cast("int")).alias("machine"))
    return named.where((F.col("n") >= least) & (F.col("machine") >= share)).groupBy("folder").agg(F.sum("n").alias("n"))


def project_folders(paths: DataFrame) -> DataFrame:
    """Folders that hold a project's marker file."""
    marked = F.when(name_of(F.col("path")).isin(PROJECT_MARKERS), folder_of(F.col("path")))
    bundle = F.when(F.col("path").rlike(r"\.(xcodeproj|xcworkspace)(/|$)"), F.regexp_extract("path", r"^(.*?)/[^/]*\.(?:xcodeproj|xcworkspace)(?:/|$)", 1))
    return paths.select(F.coalesce(marked, bundle).alias("folder")).where("folder is not null").distinct()


def outside_projects(files: DataFrame, projects: DataFrame, root: str) -> DataFrame:
    """Files that aren't in a project; in one, only screenshots. The chosen root itself is never one."""
    above = files.select("path", F.explode(ancestors(F.col("path"))).alias("folder")).where(F.col("folder") != root)
    inside = above.join(projects, "folder", "left_semi").select("path").distinct()
    return files.where("kind = 'screenshot'").unionByName(files.where("kind <> 'screenshot'").join(inside, "path", "left_anti"))


def searched_as(path: Column, folders: Column) -> Column:
    """The longest folder that covers a path."""
    fit = F.filter(folders, lambda f: (path == f) | is_inside(path, f))
    return F.reduce(fit, F.lit(None).cast("string"), lambda a, b: F.when(a.isNull() | (F.length(b) > F.length(a)), b).otherwise(a))
