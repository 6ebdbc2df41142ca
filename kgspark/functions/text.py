"""Name, link, path and identifier expressions (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kgspark import fixed

# Unicode white space as Python's str.strip / str.split see it: a pattern, and the characters.
SPACE = r"(?U)[\s\x1c-\x1f]"
SPACE_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _literal(value) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value}D" if isinstance(value, float) else str(value)


def literal_map(values: dict) -> Column:
    """A constant lookup map."""
    return F.expr("map(" + ", ".join(_literal(x) for pair in values.items() for x in pair) + ")")


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(SPACE_CHARS))


def words(c: Column) -> Column:
    """Whitespace-separated tokens; none for a blank text."""
    bare = strip(c)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"{SPACE}+"))


def word_count(c: Column) -> Column:
    return F.size(words(c)).cast("bigint")


def normalize_name(c: Column) -> Column:
    """Canonical key of an entity name; double spaces are halved once."""
    flat = F.translate(strip(F.lower(c)), "_-", "  ")
    return F.ltrim(F.replace(flat, F.lit("  "), F.lit(" ")), F.lit("@"))


def _target(part: Column) -> Column:
    """Target of a link whose text after ``[[`` this is; null when no link ends there or it has no target or an empty label."""
    inside = F.substring_index(part, "]]", 1)
    target = F.substring_index(inside, "|", 1)
    closed = part.contains("]]") & ~inside.contains("]") & (target != "") & (F.length(inside) != F.length(target) + 1)
    return F.when(closed, target)


def unlinked(c: Column) -> Column:
    """The text with each ``[[target|label]]`` replaced by its target."""
    parts = F.split(c, r"\[\[")
    plain = lambda p: F.concat(F.lit("[["), p)
    after = lambda p: F.substring(p, F.instr(p, F.lit("]]")) + 2, F.length(p))
    shown = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.coalesce(F.concat(_target(p), after(p)), plain(p)))
    return F.when(c.contains("[["), F.concat(F.get(parts, F.lit(0)), F.array_join(shown, ""))).otherwise(c)


def normalize_alias(c: Column) -> Column:
    """Link target of ``[[path/name|label]]`` or the plain text, lower-cased."""
    return strip(F.lower(F.substring_index(unlinked(c), "/", -1)))


def significant_token(norm: Column, stopwords: list[str]) -> Column:
    """First token outside the stop words, else the first token, else ''."""
    tokens = words(norm)
    kept = F.filter(tokens, lambda t: ~t.isin(stopwords))
    return F.coalesce(F.get(kept, F.lit(0)), F.get(tokens, F.lit(0)), F.lit(""))


def fold_phonetic(token: Column) -> Column:
    low = F.lower(token)
    return F.coalesce(F.element_at(literal_map(fixed.PHONETIC_NAMES), low), low)


def overlap_count(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(words(F.lower(a)), words(F.lower(b))))


def overlap_ratio(a: Column, b: Column) -> Column:
    shorter = F.least(
        F.size(F.array_distinct(words(F.lower(a)))), F.size(F.array_distinct(words(F.lower(b))))
    )
    return F.when(shorter == 0, F.lit(0.0)).otherwise(overlap_count(a, b) / shorter)


def passes_overlap(a: Column, b: Column, required: Column) -> Column:
    """Token-overlap rule; types that do not require it, and one-word names, pass."""
    single = (F.size(words(a)) == 1) | (F.size(words(b)) == 1)
    enough = (overlap_ratio(a, b) >= fixed.MIN_OVERLAP_RATIO) & (
        overlap_count(a, b) >= fixed.MIN_OVERLAP_COUNT
    )
    return ~required | single | enough


def entity_uri(name: Column, entity_type: Column) -> Column:
    norm = normalize_name(name)
    slug = F.substring(F.translate(F.replace(norm, F.lit(" "), F.lit("-")), "'", ""), 1, 50)
    digest = F.substring(F.sha2(F.concat(entity_type, F.lit(":"), norm), 256), 1, 12)
    return F.concat(
        F.lit(fixed.ENTITY_URI_PREFIX), F.lower(entity_type), F.lit("-"), slug, F.lit("-"), digest
    )


def slug(c: Column) -> Column:
    kept = F.regexp_replace(strip(F.lower(c)), r"[^\p{L}\p{N}_\s-]", "")
    dashed = F.regexp_replace(F.regexp_replace(kept, r"[\s_]+", "-"), "-+", "-")
    return F.regexp_replace(dashed, "^-+|-+$", "")


def network_rid(entity_type: Column, norm: Column, uri: Column) -> Column:
    s = slug(norm)
    return F.concat(
        F.lit(fixed.NETWORK_RID_PREFIX),
        F.coalesce(F.nullif(F.lower(entity_type), F.lit("")), F.lit("entity")),
        F.lit(":"),
        F.when(s == "", F.lit("unnamed")).otherwise(s),
        F.lit("+"),
        F.substring(F.sha2(uri, 256), 1, 16),
    )


def url_authority(url: Column) -> Column:
    """Network location with port and user part, '' when there is none."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def web_rid(url: Column) -> Column:
    return F.concat(
        F.lit(fixed.WEB_RID_PREFIX),
        F.translate(url_authority(url), ".:", "__"),
        F.lit("/"),
        F.substring(F.sha2(url, 256), 1, 16),
    )


def monitor_rid(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 12)


def rid_type(rid: Column) -> Column:
    """Capitalised type inside an identifier, null when the format is unknown."""
    raw = F.coalesce(*[F.nullif(F.regexp_extract(rid, p, 1), F.lit("")) for p in fixed.RID_TYPE_PATTERNS])
    return F.concat(F.upper(F.substring(raw, 1, 1)), F.lower(F.substring(raw, 2, 1_000_000)))


def canonical_type(label: Column) -> Column:
    """Type table spelling of a label, ignoring case; null when unknown."""
    return F.element_at(literal_map({t.name.lower(): t.name for t in fixed.ENTITY_TYPES}), F.lower(label))


def link_path(c: Column) -> Column:
    text = F.regexp_replace(strip(c), "^\"+|\"+$", "")
    text = F.regexp_replace(text, "^'+|'+$", "")
    return F.when(text.startswith("[["), F.coalesce(_target(F.substring(text, 3, F.length(text))), text)).otherwise(text)


def link_name(c: Column) -> Column:
    return strip(F.replace(F.substring_index(link_path(c), "/", -1), F.lit("-"), F.lit(" ")))


def link_type(c: Column) -> Column:
    path = link_path(c)
    folder = F.lower(F.regexp_extract(path, r"^(.*)/[^/]*$", 1))
    return F.element_at(literal_map(fixed.LINK_FOLDERS), F.nullif(folder, F.lit("")))


def split_values(c: Column) -> Column:
    """Field text to values: link lists split after ``]]``, others on commas."""
    links = F.transform(
        F.filter(F.split(c, r"\]\]\s*,\s*"), lambda p: p != ""),
        lambda p: F.when(p.endswith("]]"), p).otherwise(F.concat(p, F.lit("]]"))),
    )
    plain = F.filter(F.transform(F.split(c, ","), strip), lambda p: p != "")
    is_links = c.contains("[[") & c.contains("]]")
    return F.when(c.isNull(), F.array().cast("array<string>")).when(is_links, links).otherwise(plain)


def note_path(rid: Column) -> Column:
    """Document identifier to note path: known prefixes and ``.md`` dropped."""
    out = rid
    for prefix in reversed(fixed.NOTE_RID_PREFIXES):
        out = F.when(rid.startswith(prefix), F.replace(rid, F.lit(prefix), F.lit(""))).otherwise(out)
    return F.regexp_replace(out, r"\.md$", "")


def note_date(path: Column) -> Column:
    return F.nullif(
        F.regexp_extract(F.substring_index(path, "/", -1), r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("")
    )


def page_slug(name: Column, folder: Column) -> Column:
    clean = F.replace(F.translate(name, "/\\", "--"), F.lit(" "), F.lit("-"))
    return F.concat(folder, F.lit("/"), clean)


def hit_slug(rid: Column) -> Column:
    """Site path of a search hit, null when it has none."""
    repo_path = F.get(F.split(rid, ":", 3), F.lit(2))
    return F.when(
        rid.startswith("github:"),
        F.when(repo_path.endswith(".md"), F.regexp_replace(repo_path, r"\.md$", "")),
    ).when(
        rid.startswith("vault:"),
        F.replace(
            F.regexp_replace(F.regexp_replace(rid, "^vault:", ""), r"\.md$", ""), F.lit(" "), F.lit("-")
        ),
    )


def zulu(ts: Column) -> Column:
    return F.regexp_replace(ts, r"\+00:00$", "Z")


def type_label(entity_type: Column) -> Column:
    return (
        F.when(
            F.element_at(literal_map(fixed.SCHEMA_LABELS), entity_type).isNotNull(),
            F.concat(F.lit('"'), F.element_at(literal_map(fixed.SCHEMA_LABELS), entity_type), F.lit('"')),
        )
        .when(
            entity_type.isin(fixed.PREFIXED_TYPES),
            F.concat(F.lit('"' + fixed.TYPE_PREFIX), entity_type, F.lit('"')),
        )
        .otherwise(entity_type)
    )


def type_folder(entity_type: Column) -> Column:
    table = literal_map({t.name.lower(): t.folder for t in fixed.ENTITY_TYPES})
    return F.coalesce(F.element_at(table, F.lower(entity_type)), F.lit(fixed.UNKNOWN_TYPE.folder))


def folder_type(folder: Column) -> Column:
    table = literal_map({t.folder.rstrip("s"): t.name for t in fixed.ENTITY_TYPES})
    return F.element_at(table, F.regexp_replace(folder, "s+$", ""))


def repo_name(url: Column) -> Column:
    """``owner/name`` of a hosted repository, the last part of any other address."""
    host = F.lit("github.com")
    rest = F.when(F.contains(url, host), F.substring(url, F.instr(url, host) + 10, F.length(url)))
    steps = F.split(F.substring(rest, 2, F.length(rest)), "/")
    user, name = F.get(steps, F.lit(0)), F.substring_index(F.get(steps, F.lit(1)), ".", 1)
    hosted = F.substring(rest, 1, 1).isin("/", ":") & (user != "") & (name != "")
    owner = F.when(hosted, F.concat_ws("/", user, name))
    last = F.regexp_replace(F.substring_index(F.regexp_replace(url, "/+$", ""), "/", -1), r"\.git$", "")
    return F.coalesce(owner, last)


def backoff_seconds(failures: Column) -> Column:
    return F.least(F.lit(fixed.BACKOFF_BASE_SECONDS) * F.pow(F.lit(2.0), failures - 1), F.lit(fixed.BACKOFF_MAX_SECONDS))


def confidence_changed(old: Column, new: Column) -> Column:
    return F.abs(F.coalesce(old, F.lit(0.0)) - F.coalesce(new, F.lit(0.0))) > fixed.CONFIDENCE_EPSILON


def public_url(url: Column) -> Column:
    """True for http(s) addresses that do not name a local or private host."""
    host = F.lower(F.regexp_replace(F.regexp_replace(url_authority(url), r"^.*@", ""), r":\d+$", ""))
    private = (
        r"^(localhost|0\.0\.0\.0|127\..*|10\..*|192\.168\..*|169\.254\..*"
        r"|172\.(1[6-9]|2\d|3[01])\..*|\[?::1\]?|\[?f[cd].*:.*|\[?fe80:.*|.*\.local|.*\.internal)$"
    )
    return F.lower(url).rlike(r"^https?://") & (host != "") & ~host.rlike(private)
