"""What a result says about itself: groups, places, reasons, details, passages. All are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import STOPWORDS, clock

# Titles of groups and kinds, and languages by extension.
GROUPS = {"screenshot": "Screenshots", "image": "Images", "pdf": "Documents", "doc": "Documents", "video": "Video", "audio": "Audio", "code": "Code"}
KINDS = {"screenshot": "Screenshot", "image": "Image", "pdf": "PDF", "doc": "Document", "audio": "Audio", "video": "Video", "code": "Code"}
LANGUAGES = {
    "Python": "py pyi", "Cython": "pyx", "Notebook": "ipynb", "C": "c", "C header": "h", "C++": "cc cpp cxx", "C++ header": "hpp hh hxx", "Objective-C": "m",
    "Objective-C++": "mm", "Swift": "swift", "TypeScript": "ts tsx mts cts", "JavaScript": "js jsx mjs cjs", "Go": "go", "Rust": "rs", "Java": "java", "Kotlin": "kt kts",
    "Scala": "scala", "Groovy": "groovy", "Ruby": "rb", "PHP": "php", "C#": "cs", "F#": "fs", "Shell": "sh bash zsh fish", "PowerShell": "ps1", "Lua": "lua", "Perl": "pl pm",
    "R": "r", "Julia": "jl", "Dart": "dart", "SQL": "sql", "Vue": "vue", "Svelte": "svelte", "Astro": "astro", "HTML": "html htm", "CSS": "css", "SCSS": "scss", "Sass": "sass",
    "Less": "less", "Gradle": "gradle", "CMake": "cmake", "Makefile": "mk", "Protocol Buffers": "proto", "GraphQL": "graphql gql", "Terraform": "tf", "HCL": "hcl", "Nix": "nix",
    "Zig": "zig", "Haskell": "hs", "Elixir": "ex exs", "Erlang": "erl", "Clojure": "clj", "ClojureScript": "cljs", "Elm": "elm", "OCaml": "ml mli", "Vim script": "vim",
    "Emacs Lisp": "el", "Lisp": "lisp", "Assembly": "asm s", "Metal": "metal", "GLSL": "glsl", "HLSL": "hlsl", "WGSL": "wgsl", "CUDA": "cu cuh", "Arduino": "ino",
    "Verilog": "v", "SystemVerilog": "sv", "LaTeX": "tex", "Markdown": "md markdown", "reStructuredText": "rst", "AsciiDoc": "adoc", "Org": "org", "Text": "txt", "YAML": "yaml yml", "TOML": "toml",
}
MEANING_GATE, PASSAGE, LEAD, BEFORE = 2.0, 900, 200, 160
MODEL_TEXT = 4000


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def group_of(kind: Column) -> Column:
    return _map(GROUPS)[kind]


def kind_title(kind: Column) -> Column:
    return F.coalesce(_map(KINDS)[kind], F.lit("File"))


def language_of(path: Column) -> Column:
    """What a file's extension, or else its name, says it is written in."""
    from sievework.operators.rules import CODE_NAMES, extension_of, name_of

    by_ext = _map({ext: language for language, own in LANGUAGES.items() for ext in own.split()})
    name, ext = name_of(path), extension_of(path)
    return F.coalesce(by_ext[ext], F.when(name.isin(CODE_NAMES) | name.startswith("Dockerfile"), name), F.when(ext == "", "Text"), F.upper(ext))


def _whole(x: Column) -> Column:
    return x.cast("long").cast("string")


def span(segment: Column, loc: Column, loc_end: Column) -> Column:
    """"lines 12–40", "cell 3"."""
    what = F.when(segment == "cells", "cell").otherwise("line")
    last = F.coalesce(loc_end, loc)
    return F.when(loc.cast("long") == last.cast("long"), F.concat(what, F.lit(" "), _whole(loc))).otherwise(F.concat(what, F.lit("s "), _whole(loc), F.lit("–"), _whole(last)))


def place(kind: Column, segment: Column, loc: Column, loc_end: Column) -> Column:
    """The badge of the page, moment or lines that matched."""
    sound = F.when(kind == "video", F.lit("♪ ")).otherwise("")
    lines = F.regexp_replace(span(segment, loc, loc_end), "^lines? ", "L")
    badge = (
        F.when(segment.isin("page", "page_image"), F.concat(F.lit("p. "), _whole(loc)))
        .when(segment == "frame", clock(loc))
        .when(segment == "audio", F.concat(sound, clock(loc)))
        .when(segment == "lines", lines)
        .when(segment == "cells", span(segment, loc, loc_end))
    )
    return F.when(loc.isNotNull(), badge)


def location(segment: Column, loc: Column, loc_end: Column, focus: Column) -> Column:
    """The place in a printed result; empty where there is none."""
    moment = F.concat(F.lit("at "), clock(loc), F.when(segment == "audio", " (sound)").otherwise(""))
    opens = F.when(focus.isNotNull(), F.concat(F.lit(", opens at "), _whole(focus))).otherwise("")
    last = F.coalesce(loc_end, loc)
    cells = F.when(loc == loc_end, F.concat(F.lit("cell "), _whole(loc))).otherwise(F.concat(F.lit("cells "), _whole(loc), F.lit("–"), _whole(last)))
    found = (
        F.when(segment.isin("page", "page_image"), F.concat(F.lit("p. "), _whole(loc)))
        .when(segment.isin("audio", "frame"), moment)
        .when(segment == "chunk", F.concat(F.lit("part "), _whole(loc)))
        .when(segment == "lines", F.concat(F.lit("lines "), _whole(loc), F.lit("–"), _whole(last), opens))
        .when(segment == "cells", cells)
    )
    return F.when(segment == "ocr", "text in image").otherwise(F.coalesce(found, F.lit("")))


def reason(kind: Column, segment: Column, loc: Column, loc_end: Column, z: Column, keyword_rank: Column) -> Column:
    """Why a result is there: by its words or its name, or by what its segment means."""
    at = F.when(loc.isNotNull(), clock(loc)).otherwise("")
    page = F.coalesce(F.concat(F.lit("page "), _whole(loc)), F.lit("a page"))
    meant = (
        F.when(segment == "image", F.when(kind == "screenshot", "Matches what's on screen").otherwise("Matches the picture"))
        .when(segment == "ocr", "Matches the text in it")
        .when(segment == "frame", F.concat(F.lit("Matches the frame at "), at))
        .when(segment == "audio", F.concat(F.when(kind == "video", "Matches the sound at ").otherwise("Matches what's heard at "), at))
        .when(segment == "page", F.concat(F.lit("Matches the text on "), page))
        .when(segment == "page_image", F.concat(F.lit("Matches "), page))
        .when(segment == "chunk", "Matches its text")
        .when(segment.isin("lines", "cells"), F.concat(F.lit("Matches "), F.coalesce(span(segment, loc, loc_end), F.lit("the code"))))
        .otherwise("Matches its name")
    )
    worded = F.when(keyword_rank.isNotNull(), "Has your words").otherwise("Matches its name")
    return F.when(F.coalesce(z, F.lit(0.0)) >= MEANING_GATE, meant).otherwise(worded)


def opens_at(kind: Column, segment: Column, loc: Column, focus: Column) -> Column:
    """struct(page, seconds, line): where a result opens, nulls where it opens plainly."""
    page = F.when((kind == "pdf") & segment.isin("page", "page_image") & (loc > 1), loc.cast("long"))
    seconds = F.when(kind.isin("video", "audio") & segment.isin("frame", "audio") & (loc >= 1), loc.cast("double"))
    line = F.when(kind == "code", F.when(segment == "lines", F.greatest(F.lit(1), F.coalesce(focus, loc, F.lit(1)).cast("long"))).otherwise(1).cast("long"))
    return F.struct(page.alias("page"), seconds.alias("seconds"), line.alias("line"))


def byte_size(count: Column) -> Column:
    """"62 KB", "2.1 MB": a KB is 1,000 bytes."""
    text = F.concat(count.cast("string"), F.lit(" bytes"))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        value = count / F.lit(float(1000**power))
        rounded = F.floor(value + 0.5).cast("long").cast("string")
        shown = rounded if power == 1 else F.when(value >= 10, rounded).otherwise(F.format_string("%.1f", value))
        text = F.when(count >= 1000**power, F.concat(shown, F.lit(f" {unit}"))).otherwise(text)
    return text


def duration(seconds: Column) -> Column:
    """"40 s", "12 min", "1.5 h"."""
    half_up = lambda x: F.floor(x + 0.5).cast("long").cast("string")
    return F.when(seconds < 90, F.concat(half_up(seconds), F.lit(" s"))).when(seconds < 5400, F.concat(half_up(seconds / 60), F.lit(" min"))).otherwise(F.format_string("%.1f h", F.floor(seconds / 360 + 0.5) / 10))


def details(kind: Column, day: Column, size: Column, info: Column) -> Column:
    """Kind, day, dimensions, pages or lines, length and size of a file, as far as its info says."""
    number = lambda key: info[key].cast("double")
    plural = lambda key, word: F.when(number(key) == 1, f"1 {word}").otherwise(F.concat(F.format_number(number(key), 0), F.lit(f" {word}s")))
    read = F.when(info["read_to"].isNotNull(), F.concat(F.lit(", "), _whole(number("read_to")), F.lit(" read so far"))).otherwise("")
    pages = F.when(info["pages"].isNotNull(), F.concat(plural("pages", "page"), read)).when(info["read_to"].isNotNull(), "partly read so far")
    parts = [
        kind_title(kind),
        day,
        F.when(info["width"].isNotNull() & info["height"].isNotNull(), F.concat(info["width"], F.lit(" × "), info["height"])),
        pages,
        F.when(info["lines"].isNotNull(), plural("lines", "line")),
        F.when(info["duration"].isNotNull(), clock(number("duration"))),
        F.when(size > 0, byte_size(size)),
    ]
    return F.concat_ws(" · ", *parts)


def folder_text(path: Column, home: Column) -> Column:
    """The folder as people write it: below the home folder from "~"."""
    folder = F.regexp_replace(path, r"[\\/][^\\/]*$", "")
    return F.when((F.length(home) > 0) & folder.startswith(home), F.concat(F.lit("~"), F.substring(folder, F.length(home) + 1, F.lit(1 << 30)))).otherwise(folder)


def folder_words(path: Column, home: Column) -> Column:
    """A file's folders below home as keywords."""
    folder = F.regexp_replace(path, r"/[^/]*$", "")
    below = F.when(folder.startswith(home), F.substring(folder, F.length(home) + 1, F.lit(1 << 30))).otherwise(folder)
    return F.array_join(F.filter(F.split(below, "/"), lambda p: p != ""), " ")


def found_words(excerpt: Column) -> Column:
    """What an excerpt marks, each once."""
    return F.filter(F.array_distinct(F.regexp_extract_all(F.coalesce(excerpt, F.lit("")), F.lit("«([^»]*)»"), 1)), lambda w: w != "")


def marked_words(query: Column) -> Column:
    """The words of a query that a preview marks."""
    words = F.array_distinct(F.split(F.lower(query), r"[^\p{L}\p{N}_]+"))
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(STOPWORDS))


def passage_around(text: Column, words: Column) -> Column:
    """Some 900 letters of a text from just before the first of the words, at a word's beginning."""
    low = F.lower(text)
    places = F.filter(F.transform(words, lambda w: F.position(F.lower(w), low)), lambda p: p > 0)
    first = F.array_min(places) - 1
    lead = F.substring(text, first - BEFORE + 1, F.lit(BEFORE))
    skipped = F.length(F.regexp_extract(lead, r"^(\S*)", 1))
    start = F.when(first > LEAD, first - BEFORE + skipped).otherwise(0)
    shown = F.substring(text, start + 1, F.lit(PASSAGE))
    return F.concat(F.when(start > 0, "…").otherwise(""), shown, F.when(F.length(text) - start > PASSAGE, "…").otherwise(""))


def highlighted(text: Column, words: list[str]) -> Column:
    """HTML with words marked where they begin a word."""
    import re

    html = text
    for letter, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        html = F.replace(html, F.lit(letter), F.lit(name))
    asked = [w for w in dict.fromkeys(w.lower() for w in words) if len(w) > 1]
    return F.regexp_replace(html, r"(?iu)(?<![\p{L}\p{N}])(" + "|".join(map(re.escape, asked)) + ")", "<mark>$1</mark>") if asked else html


def model_text(text: Column) -> Column:
    """What a model is given of a page."""
    return F.substring(text, 1, MODEL_TEXT)
