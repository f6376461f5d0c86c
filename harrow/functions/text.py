"""Text and identity as column expressions; none of them leaves the JVM."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Namespace of chunk ids.
CHUNK_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_DNS, "harrow.chunks")
WORD_BREAK = r"[^\p{L}\p{N}]+"
_EDGE = r"(?U)^\s+|\s+$"

# Headings that open the back matter of an encyclopedia article.
BACK_MATTER = ["See also", "References", "Notes", "Citations", "Sources", "Bibliography", "Further reading", "External links"]
# Fixed value: a top-level section heading.
SECTION_LINE = r"^==[^=].*==\s*$"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def content_hash(title: Column | str, text: Column | str) -> Column:
    """SHA-256 of ``title LF text``; metadata and address don't count. Null if either is null."""
    return F.sha2(F.concat(col(title), F.lit("\n"), col(text)), 256)


def uuid5(name: Column | str, namespace: uuid.UUID = CHUNK_NAMESPACE) -> Column:
    """RFC 4122 version 5 id of ``name``, as text."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(col(name), "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(63)).bitwiseOR(128)))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(19, 2), F.lit("-"), part(21, 12))


def chunk_id(doc_id: Column | str, doc_hash: Column | str, index: Column | str) -> Column:
    """Deterministic: a changed document gets new chunk ids."""
    return uuid5(F.concat_ws(":", col(doc_id).cast("string"), col(doc_hash), col(index).cast("string")))


def strip(x: Column | str) -> Column:
    """Without white space at both ends, by Unicode's notion of it."""
    return F.regexp_replace(col(x), _EDGE, "")


def squash(x: Column | str) -> Column:
    """Runs of white space become one space; ends are stripped."""
    return strip(F.regexp_replace(col(x), r"(?U)\s+", " "))


def header(title: Column | str, section: Column | str) -> Column:
    """``title — section``; an empty section counts as none."""
    s = F.nullif(col(section), F.lit(""))
    return F.coalesce(F.concat(col(title), F.lit(" — "), s), col(title))


def embedding_text(title: Column | str, section: Column | str, text: Column | str) -> Column:
    """What is embedded and indexed for a chunk: its header, a blank line, its text."""
    return F.concat(header(title, section), F.lit("\n\n"), col(text))


def strip_back_matter(text: Column | str) -> Column:
    """Cut at the first level-two heading of back matter."""
    names = "|".join(BACK_MATTER)
    return strip(F.regexp_replace(col(text), rf"(?mi)^==\s*(?:{names})\s*==\s*$(?s:.*)", ""))


def cap_at_sections(text: Column | str, max_chars: int) -> Column:
    """The lead, and whole top-level sections as long as they end within ``max_chars``."""
    t = col(text)
    pieces = F.split(t, f"(?m)(?={SECTION_LINE})")
    ends = F.aggregate(
        pieces,
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("keep")),
        lambda s, p: F.struct(
            (s["at"] + F.length(p)).alias("at"),
            F.when((s["at"] + F.length(p) <= max_chars) | ((s["at"] == 0) & ~p.rlike(f"(?m)\\A{SECTION_LINE}")), s["at"] + F.length(p)).otherwise(s["keep"]).alias("keep"),
        ),
    )
    return strip(F.substring(t, F.lit(1), ends["keep"]))


def tokens(text: Column | str) -> Column:
    """Lower-cased runs of letters and digits, in order; null text has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(col(text), F.lit(""))), WORD_BREAK), "")


def canonical_id(doc_id: Column | str, duplicate_of: Column | str) -> Column:
    """A mirror counts as its original."""
    return F.coalesce(F.nullif(col(duplicate_of), F.lit("")), col(doc_id).cast("string"))
