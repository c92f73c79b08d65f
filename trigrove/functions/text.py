"""Text functions on columns: trigrams, distances, aliases, match grades.

All are plain column expressions. Array functions are evaluated outside whole-stage
code generation, so callers apply them to distinct texts and keep the result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDIT_CAP = 999
MATCH_EDITS = 2
MATCH_OVERLAP = 0.6


def bound(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim_space(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalise(text: Column) -> Column:
    return F.lower(trim_space(F.coalesce(text, F.lit(""))))


def trigrams(text: Column) -> Column:
    """Distinct three-character windows of the lower-cased text between two blanks each side."""
    padded = F.concat(F.lit("  "), F.lower(text), F.lit("  "))
    return bound(
        padded,
        lambda p: F.array_distinct(
            F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3)))
        ),
    )


def terms_trigrams(terms: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(terms, trigrams)))


def overlap(query_grams: Column, entry_grams: Column) -> Column:
    """Share of the query's grams that the entry holds; 0 for a query without grams."""
    found = F.size(F.array_intersect(query_grams, entry_grams))
    return F.when(F.size(query_grams) > 0, found / F.size(query_grams)).otherwise(F.lit(0.0))


def bounded_distance(left: Column, right: Column, most: int = MATCH_EDITS) -> Column:
    """Edit distance of the lower-cased texts, null when above ``most``."""
    distance = F.levenshtein(F.lower(left), F.lower(right), most)
    return F.when(distance >= 0, distance)


def within_distance(text: Column, terms: Column, most: int = MATCH_EDITS) -> Column:
    """Any of the lower-cased ``terms`` within ``most`` edits of ``text``."""
    return F.exists(terms, lambda term: F.levenshtein(text, term, most) >= 0)


def least_distance(text: Column, terms: Column) -> Column:
    """Smallest edit distance from ``text`` to one of the lower-cased ``terms``, at most 999."""
    return F.array_min(F.transform(terms, lambda term: F.least(F.levenshtein(text, term), F.lit(EDIT_CAP))))


def search_terms(name: Column, tags: Column) -> Column:
    """The name, then the tags."""
    return F.concat(F.array(name), F.coalesce(tags, F.array().cast("array<string>")))


def lower_terms(name: Column, tags: Column) -> Column:
    return F.transform(search_terms(name, tags), F.lower)


def has_prefix(text: Column, terms: Column) -> Column:
    return (text != "") & F.exists(terms, lambda term: term.startswith(text))


def match_quality(text: Column, terms: Column, kind: str = "prefix") -> Column:
    """Grade of the best of the lower-cased ``terms``.

    ``prefix``: 2 equal, 1 starts with the text, else 0. ``contains``: 3 equal, 2 starts
    with it, 1 contains it, else 0.
    """
    exact, prefix = (2, 1) if kind == "prefix" else (3, 2)

    def grade(term: Column) -> Column:
        graded = F.when(term == text, F.lit(exact)).when(term.startswith(text), F.lit(prefix))
        if kind == "contains":
            graded = graded.when(term.contains(text), F.lit(1))
        return graded.otherwise(F.lit(0))

    return F.coalesce(F.array_max(F.transform(terms, grade)), F.lit(0))


# Other names under which well-known programs are looked for (fixed values):
# part of the lower-cased name | other names.
KNOWN_ALIASES = """
visual studio code       | vs code, vscode, code editor
nvidia x server settings | nvidia settings, gpu settings, graphics settings
system monitor           | task manager, process manager
file manager             | files, explorer
terminal                 | console, shell
libreoffice writer       | word processor, writer
libreoffice calc         | spreadsheet, excel, calc
mozilla firefox          | firefox
google chrome            | chrome
"""
SETTINGS_NAMES = ("settings", "cosmic settings")
SETTINGS_ALIASES = ("preferences", "control panel", "system settings", "general settings")

WINDOWS_KNOWN_ALIASES = """
visual studio code | vs code, vscode, code editor
file explorer      | files, file manager
system information | msinfo
"""


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def aliases(name: Column, windows: bool = False) -> Column:
    """Further tags of a name: initials, initials plus last word, and known other names."""
    splitter = r"[ \-_&]+" if windows else r"[^\p{IsAlphabetic}\p{N}]+"
    words = F.filter(F.split(name, splitter), lambda w: w != "")
    none = F.array().cast("array<string>")

    def initials(ws: Column) -> Column:
        return F.array_join(F.transform(ws, lambda w: F.substring(w, F.lit(1), F.lit(1))), "")

    def from_words(ws: Column) -> Column:
        made = F.when(F.size(ws) >= 2, F.array(initials(ws))).otherwise(none)
        if windows:
            return made
        head = F.slice(ws, F.lit(1), F.size(ws) - 1)
        tail = F.concat(initials(head), F.lit(" "), F.element_at(ws, -1))
        return F.concat(made, F.when(F.size(ws) >= 3, F.array(tail)).otherwise(none))

    def known(low: Column) -> Column:
        found = []
        for line in (WINDOWS_KNOWN_ALIASES if windows else KNOWN_ALIASES).strip().splitlines():
            needle, others = line.split("|")
            values = _strings(v.strip() for v in others.split(","))
            found.append(F.when(low.contains(needle.strip()), values).otherwise(none))
        if not windows:
            found.append(F.when(low.isin(*SETTINGS_NAMES), _strings(SETTINGS_ALIASES)).otherwise(none))
        return F.concat(*found)

    return F.concat(bound(words, from_words), bound(F.lower(name), known))


def distinct_tags(tags: Column, name: Column, windows: bool = False) -> Column:
    """Tags without blanks, without the name and without repeats; case and outer space are
    ignored when comparing and the first spelling stays. In the windows dialect outer space counts."""
    def key(tag: Column) -> Column:
        return F.lower(tag if windows else trim_space(tag))

    def keep(made: Column) -> Column:
        keys = made["keys"]
        first = F.filter(
            F.sequence(F.lit(1), F.greatest(F.size(keys), F.lit(1))),
            lambda i: (F.get(keys, i - 1) != made["name"])
            & (trim_space(F.get(keys, i - 1)) != "")
            & (F.array_position(keys, F.get(keys, i - 1)) == i),
        )
        return F.transform(first, lambda i: F.get(made["tags"], i - 1))

    # Tags, keys and name are worked out once; inside the lambdas they would be for every tag.
    return bound(tags, lambda all_tags: bound(F.struct(all_tags.alias("tags"), F.transform(all_tags, key).alias("keys"), key(name).alias("name")), keep))
