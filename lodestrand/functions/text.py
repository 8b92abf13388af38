"""Text, name and identity expressions: plain Column functions that stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed pattern: a term is a run of letters, numbers or underscores of any script.
TERM = r"([\p{L}\p{N}_]+)"
PUNCTUATION = r"[!-/:-@\[-`{-~]"
ARTICLES = ("a", "an", "the")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def folded(x: Column | str) -> Column:
    """Lower case with sharp s as ss; of full case folding only that differs in the scripts handled here."""
    return F.replace(F.lower(F.coalesce(col(x), F.lit(""))), F.lit("ß"), F.lit("ss"))


def terms(x: Column | str) -> Column:
    return F.regexp_extract_all(folded(x), F.lit(TERM), F.lit(1))


def words(x: Column | str) -> Column:
    """What stands between white space."""
    return F.regexp_extract_all(F.coalesce(col(x), F.lit("")), F.lit(r"(\S+)"), F.lit(1))


def normalize_name(x: Column | str) -> Column:
    return F.array_join(terms(x), " ")


def normalize_answer(x: Column | str) -> Column:
    bare = F.regexp_replace(folded(x), PUNCTUATION, "")
    return F.array_join(F.filter(F.split(bare, r"\s+"), lambda w: (w != "") & ~w.isin(*ARTICLES)), " ")


def clean_text(x: Column | str) -> Column:
    """Without NUL, blanks at line ends and more than one empty line in a row; trimmed."""
    out = F.replace(F.coalesce(col(x), F.lit("")), F.lit("\0"), F.lit(""))
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(out, r"^[ \t\n\r]+|[ \t\n\r]+$", "")


def valid_text(x: Column | str) -> Column:
    """Bytes that are no UTF-8, unpaired surrogates among them, become replacement characters."""
    return F.make_valid_utf8(col(x))


def document_text(title: Column | str, text: Column | str) -> Column:
    return F.trim(F.concat_ws("\n", F.coalesce(col(title), F.lit("")), F.coalesce(col(text), F.lit(""))))


def entity_text(name: Column | str, aliases: Column | str) -> Column:
    tidy = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(col(aliases), F.array().cast("array<string>")), lambda a: F.trim(a)), lambda a: a != "")))
    return F.concat_ws("\n", col(name), F.array_join(tidy, "\n"))


def content_hash(x: Column) -> Column:
    return F.sha2(x, 256)


def hash_id(prefix: Column | str, content: Column, length: int) -> Column:
    """prefix and the first hex digits of the content's digest."""
    lead = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.concat(lead, F.substring(F.sha2(content, 256), 1, length))


def entity_id(kind: Column, name: Column) -> Column:
    """Stable id of an entity; fails on a name without a term."""
    normal = normalize_name(name)
    checked = F.when(normal == "", F.raise_error(F.lit("an entity name must hold a term"))).otherwise(normal)
    return hash_id(F.concat(F.lower(kind), F.lit("_")), F.concat_ws(":", kind, checked), 20)


def edge_id(subject: Column, predicate: Column, obj: Column) -> Column:
    return hash_id("edge_", F.concat_ws("\n", subject, predicate, obj), 20)


def mention_id(chunk: Column, subject: Column, predicate: Column, obj: Column) -> Column:
    return hash_id("edge_", F.concat_ws(":", chunk, subject, predicate, obj), 20)


def evidence_id(edge: Column, chunk: Column) -> Column:
    return hash_id("evidence_", F.concat_ws(":", edge, chunk), 24)


def audit_id(edge: Column, chunk: Column) -> Column:
    return hash_id("audit_", F.concat_ws(":", edge, chunk), 20)


def passage_id(paper: Column, page: Column, index: Column, text: Column) -> Column:
    return hash_id("passage_", F.concat_ws(":", paper, page.cast("string"), index.cast("string"), text), 24)


def paragraph_id(title: Column, text: Column) -> Column:
    return hash_id("para_", F.concat_ws("\n", title, text), 20)


def chunk_id(document: Column, start: Column, text: Column) -> Column:
    return hash_id("chunk_", F.concat_ws(":", document, start.cast("string"), text), 16)


def cache_key(version: Column, model: Column, key: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("\n", version, model, key, F.sha2(text, 256)), 256)


def excerpt(x: Column, size: int, mark: str = "") -> Column:
    """The first characters, and a mark if anything was cut."""
    return F.when(F.length(x) > size, F.concat(F.substring(x, 1, size), F.lit(mark))).otherwise(x)


def ascii_only(x: Column) -> Column:
    return F.regexp_replace(x, r"[^\x00-\x7F]", "?")


def year_of(identifier: Column) -> Column:
    """The year of a yymm.number id; fails on other forms."""
    yy = F.regexp_extract(identifier, r"^(\d{2})\d{2}\.", 1)
    return F.when(yy == "", F.raise_error(F.concat(F.lit("no yymm id: "), identifier))).otherwise(F.lit(2000) + yy.cast("int"))


def fallback_query(query: Column, question: Column, least: int = 3) -> Column:
    return F.when(F.size(terms(query)) < least, question).otherwise(query)


def loopback(url: Column) -> Column:
    """Whether a URL is plain http to this machine without credentials, path or query."""
    return F.coalesce((F.parse_url(url, F.lit("PROTOCOL")) == "http") & F.parse_url(url, F.lit("HOST")).isin("localhost", "127.0.0.1", "[::1]") & F.parse_url(url, F.lit("USERINFO")).isNull() & F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit("")).isin("", "/") & F.parse_url(url, F.lit("QUERY")).isNull(), F.lit(False))


def number(x: Column, places: int = 3) -> Column:
    return F.coalesce(F.format_string(f"%.{places}f", x), F.lit("—"))
