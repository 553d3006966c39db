"""Text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Words of a question that say nothing of its subject, by kind.
STOP_WORDS = tuple(
    dict.fromkeys(
        (
            "what which when where who whom whose why how "
            "is are was were be been being do does did can could should would may might must shall will "
            "the a an and or but nor yet so "
            "to of in on at by for from with about against between into through during before after above below under over within without across behind beyond around near "
            "this that these those some any each every either neither much many few several all both such "
            "i me my mine you your yours he him his she her hers it its we us our ours they them their theirs "
            "have has had make makes made get gets got know knows knew see sees saw want wants need needs use uses used "
            "tell explain describe show give provide find search look help guide "
            "today latest recent current now currently recently update updated "
            "example examples information details difference differences overview introduction basics"
        ).split()
    )
)
#: Fixed value: citations of snippets and of snapshots.
CITATION = r"\((?:P[^:()\s]+:S\d+|SNAP:[A-Za-z0-9_.-]+:S\d+)\)"
NUMBER = r"\b\d+(?:\.\d+)?\b"


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits; found first, lower-cased then."""
    return F.transform(F.regexp_extract_all(text, F.lit("[a-zA-Z0-9]+"), 0), F.lower)


def token_set(text: Column, least: int = 3) -> Column:
    return F.array_distinct(F.filter(tokens(text), lambda t: F.length(t) >= least))


def compact(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip_html(html: Column) -> Column:
    """Without scripts, styles and tags, white space collapsed."""
    out = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", " ")
    out = F.regexp_replace(out, r"(?is)<style[^>]*>.*?</style>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"(?s)<[^>]+>", " "), r"\s+", " "))


def canonical_claim(text: Column) -> Column:
    out = F.regexp_replace(F.lower(F.trim(text)), r"\b(\d+)\.0\b", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[^a-z0-9\s]", " "), r"\s+", " "))


def normal_doi(raw: Column) -> Column:
    """Without the resolver's address, the prefix doi: and slashes at the ends, in lower case; empty becomes null."""
    out = F.trim(F.regexp_replace(F.trim(raw), r"(?i)^https?://(dx\.)?doi\.org/", ""))
    out = F.regexp_replace(F.trim(F.regexp_replace(out, "(?i)^doi:", "")), "^/+|/+$", "")
    return F.nullif(F.lower(out), F.lit(""))


def citations(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CITATION), 0)


def without_citations(text: Column) -> Column:
    return F.regexp_replace(text, CITATION, "")


def question_tokens(text: Column) -> Column:
    """Distinct tokens of three letters or more that aren't stop words."""
    return F.array_except(token_set(text), F.array(*[F.lit(w) for w in STOP_WORDS]))


def full_lines(text: Column) -> Column:
    """The lines that aren't blank, trimmed; their places are the line numbers of reports."""
    return F.filter(F.transform(F.split(text, r"\r\n|\n|\r"), lambda x: F.trim(x)), lambda x: x != "")


def shard(key: Column, n: int) -> Column:
    """The first 8 bytes of the key's SHA-1 as an unsigned number, modulo n."""
    return F.pmod(F.conv(F.substring(F.sha1(key.cast("binary")), 1, 16), 16, 10).cast("decimal(20,0)"), F.lit(n)).cast("int")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def paper_of(snippet_id: Column) -> Column:
    """What stands before :S in a snippet's id, without the P before it."""
    return F.regexp_extract(snippet_id, r"^\(?P?(.*?):S\d+\)?$", 1)
