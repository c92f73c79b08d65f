"""Row layouts and the parameters in which the two dialects differ."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

ENTRY_TYPES = ("App", "File", "Setting", "Command")

# Classes searched together: settings and commands share one class.
CLASSES = ("App", "File", "Setting")

FEATURES = (
    "is_exact_prefix",
    "is_trigram_match",
    "is_levenshtein_match",
    "frecency",
    "recency_hours",
    "access_count",
    "edit_distance",
    "time_hour_bucket",
    "day_of_week",
    "active_app_match",
    "same_directory",
    "file_type_popularity",
)

METADATA = T.StructType(
    [
        T.StructField("file_type", T.StringType()),
        T.StructField("file_size", T.LongType()),
        T.StructField("is_dir", T.BooleanType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("category", T.StringType()),
    ]
)

# ``position`` is the place of the entry in catalog order; it decides which of several
# entries owns an exact term. Where it is null, the id stands in for it.
CATALOG = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("entry_type", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("icon_path", T.StringType()),
        T.StructField("frecency_score", T.DoubleType()),
        T.StructField("last_accessed", T.LongType()),
        T.StructField("access_count", T.LongType()),
        T.StructField("metadata", METADATA),
        T.StructField("position", T.LongType()),
        T.StructField("generation", T.LongType()),
    ]
)

USAGE = T.StructType(
    [
        T.StructField("entry_id", T.LongType()),
        T.StructField("access_count", T.LongType()),
        T.StructField("last_accessed", T.LongType()),
    ]
)

QUERY = T.StructType(
    [
        T.StructField("query_id", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("active_app", T.StringType()),
        T.StructField("cwd", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("hour_of_day", T.IntegerType()),
        T.StructField("day_of_week", T.IntegerType()),
    ]
)

CONTEXT = T.StructType(
    [
        T.StructField("active_app", T.StringType()),
        T.StructField("cwd", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("hour_of_day", T.IntegerType()),
        T.StructField("day_of_week", T.IntegerType()),
    ]
)

CHANGE = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("is_dir", T.BooleanType()),
        T.StructField("size", T.LongType()),
    ]
)

# Limits that a stored catalog has to keep (fixed values).
MAX_ENTRIES = 10_000_000
MAX_TAGS = 10_000
MAX_TEXT = 32_768
MAX_REQUEST = 1_048_576

# Which classes a query searches, by intent (fixed values). One line per lookup:
# intent, class, searched text (whole query or matched keyword), least overlap.
UNIX_ROUTES = """
ExactApp       App      query    0.8
FileExtension  File     keyword  0.6
Setting        Setting  keyword  0.8
Setting        App      query    0.8
Mixed          App      query    0.8
Mixed          File     query    0.7
Mixed          Setting  query    0.8
"""

WINDOWS_ROUTES = """
ExactApp       App      query    0.72
FileExtension  File     keyword  0.60
Setting        Setting  query    0.68
Setting        App      query    0.78
Mixed          App      query    0.72
Mixed          File     query    0.65
Mixed          Setting  query    0.72
"""

# Lookup made for a chosen class, whatever the intent (fixed values).
WINDOWS_CLASS_ROUTES = """
Apps           App      query    0.72
Files          File     query    0.65
Settings       Setting  query    0.72
"""

# Words that make a query a settings query (fixed values).
WINDOWS_SETTING_WORDS = tuple(
    "settings setting bluetooth display network privacy update sound keyboard mouse power account apps".split()
)

# Applications and the file types they work on (fixed values):
# application names | file types, one group per line.
UNIX_APP_GROUPS = """
code, vscode, codium, zed, idea, vim, emacs | rs, py, js, ts, tsx, jsx, c, cpp, h, go, java, toml, yaml, yml, json
libreoffice, writer, word | odt, doc, docx, rtf
calc, excel | ods, xls, xlsx, csv
evince, okular, document viewer | pdf, djvu, epub
gimp, inkscape, krita | png, jpg, jpeg, gif, svg, webp, xcf
"""

WINDOWS_APP_GROUPS = """
code, vscode, codium, visual studio, idea, vim, emacs | rs, py, js, ts, tsx, jsx, c, cpp, h, go, java, toml, yaml, yml, json
word, writer, wordpad | odt, doc, docx, rtf
excel, calc | ods, xls, xlsx, csv
acrobat, pdf, edge | pdf, djvu, epub
paint, photos, gimp, inkscape, krita | png, jpg, jpeg, gif, svg, webp, bmp
"""

# Directory and file names left out of a file catalog (fixed values).
UNIX_EXCLUDES = (".git", ".cache", "__pycache__", "node_modules", "target")
WINDOWS_EXCLUDES = UNIX_EXCLUDES + ("bin", "obj", "AppData", "$Recycle.Bin", "System Volume Information")

CLASS_FILTERS = ("All", "Apps", "Files", "Settings")


def parse_routes(text: str) -> dict[str, list[tuple[str, str, float]]]:
    """Routing text to ``{intent: [(class, text source, least overlap), ...]}``."""
    routes: dict[str, list[tuple[str, str, float]]] = {}
    for line in text.strip().splitlines():
        intent, group, source, least = line.split()
        routes.setdefault(intent, []).append((group, source, float(least)))
    return routes


def parse_app_groups(text: str) -> list[tuple[list[str], list[str]]]:
    groups = []
    for line in text.strip().splitlines():
        apps, kinds = line.split("|")
        groups.append(([a.strip() for a in apps.split(",")], [k.strip() for k in kinds.split(",")]))
    return groups


@dataclass(frozen=True)
class Profile:
    """The points in which the two dialects of the search differ."""

    name: str = "unix"
    routes: str = UNIX_ROUTES
    class_routes: str | None = None  # set: a class filter replaces the intent's routes
    stage1_limit: int | None = 10  # None: as many as max_candidates
    candidate_bounds: tuple[int, int | None] = (1, None)
    setting_words: tuple[str, ...] | None = None  # None: words of the setting names
    exact_scope: str = "routed"  # or "filter": every class the filter allows
    quality: str = "prefix"  # or "contains"
    zero_count_uses_score: bool = False
    name_order: str = "binary"  # or "caseless"
    trim_app_terms: bool = False
    class_filter_stage: str = "post"  # or "pre"
    app_groups: str = field(default=UNIX_APP_GROUPS, repr=False)
    app_like_types: tuple[str, ...] = ("App",)
    caseless_paths: bool = False
    tail_alias: bool = True
    nan_goes_left: bool = True  # side taken by a missing value without a decision type
    batch_interval_ms: int = 500
    stored_limits: bool = False  # a stored catalog has to keep the limits

    def max_candidates(self, wanted: int) -> int:
        low, high = self.candidate_bounds
        if wanted < low or (high is not None and wanted > high):
            raise ValueError(f"max_candidates is {wanted}, outside {low} to {'any' if high is None else high}")
        return int(wanted)


UNIX = Profile()
WINDOWS = Profile(
    name="windows",
    routes=WINDOWS_ROUTES,
    class_routes=WINDOWS_CLASS_ROUTES,
    stage1_limit=None,
    candidate_bounds=(10, 1000),
    setting_words=WINDOWS_SETTING_WORDS,
    exact_scope="filter",
    quality="contains",
    zero_count_uses_score=True,
    name_order="caseless",
    trim_app_terms=True,
    class_filter_stage="pre",
    app_groups=WINDOWS_APP_GROUPS,
    app_like_types=("App", "Command"),
    caseless_paths=True,
    tail_alias=False,
    nan_goes_left=False,
    batch_interval_ms=350,
    stored_limits=True,
)
PROFILES = {"default": UNIX, "unix": UNIX, "windows": WINDOWS}


def profile_of(profile: str | Profile) -> Profile:
    return profile if isinstance(profile, Profile) else PROFILES[profile]
