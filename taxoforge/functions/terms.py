"""Column functions over RDF terms: IRIs as prefixed names, literals with language or datatype."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The namespace table. The first namespace that begins an IRI names its prefix, in this order.
PREFIXES: list[tuple[str, str]] = [
    ("yago", "http://yago-knowledge.org/resource/"),
    ("rdf", "http://www.w3.org/1999/02/22-rdf-syntax-ns#"),
    ("xsd", "http://www.w3.org/2001/XMLSchema#"),
    ("ontolex", "http://www.w3.org/ns/lemon/ontolex#"),
    ("dct", "http://purl.org/dc/terms/"),
    ("rdfs", "http://www.w3.org/2000/01/rdf-schema#"),
    ("owl", "http://www.w3.org/2002/07/owl#"),
    ("wikibase", "http://wikiba.se/ontology#"),
    ("skos", "http://www.w3.org/2004/02/skos/core#"),
    ("schema", "http://schema.org/"),
    ("cc", "http://creativecommons.org/ns#"),
    ("geo", "http://www.opengis.net/ont/geosparql#"),
    ("prov", "http://www.w3.org/ns/prov#"),
    ("wd", "http://www.wikidata.org/entity/"),
    ("data", "https://www.wikidata.org/wiki/Special:EntityData/"),
    ("sh", "http://www.w3.org/ns/shacl#"),
    ("s", "http://www.wikidata.org/entity/statement/"),
    ("ref", "http://www.wikidata.org/reference/"),
    ("v", "http://www.wikidata.org/value/"),
    ("wdt", "http://www.wikidata.org/prop/direct/"),
    ("wpq", "http://www.wikidata.org/prop/quant/"),
    ("wdtn", "http://www.wikidata.org/prop/direct-normalized/"),
    ("p", "http://www.wikidata.org/prop/"),
    ("ps", "http://www.wikidata.org/prop/statement/"),
    ("psv", "http://www.wikidata.org/prop/statement/value/"),
    ("psn", "http://www.wikidata.org/prop/statement/value-normalized/"),
    ("pq", "http://www.wikidata.org/prop/qualifier/"),
    ("pqv", "http://www.wikidata.org/prop/qualifier/value/"),
    ("pqn", "http://www.wikidata.org/prop/qualifier/value-normalized/"),
    ("pr", "http://www.wikidata.org/prop/reference/"),
    ("prv", "http://www.wikidata.org/prop/reference/value/"),
    ("prn", "http://www.wikidata.org/prop/reference/value-normalized/"),
    ("wdno", "http://www.wikidata.org/prop/novalue/"),
    ("ys", "http://yago-knowledge.org/schema#"),
]

# Predicates whose objects count only in English.
LABEL_LIKE = ["rdfs:label", "schema:name", "skos:prefLabel", "schema:description", "skos:altLabel"]

LITERAL = r'^"([^"]*)"(@([a-z-]+))?(\^\^(.*))?'


def compact_iri(iri: Column, prefixes: list[tuple[str, str]] = PREFIXES) -> Column:
    """An IRI with its namespace replaced by the prefix; unknown namespaces leave it as it is, in angle brackets.

    One pattern finds the namespace, its alternatives in the table's order, and a map has its prefix."""
    first: dict[str, str] = {}
    for name, space in prefixes:
        first.setdefault(space, name)
    space = F.regexp_extract(iri, "^(" + "|".join(re.escape(x) for x in first) + ")", 1)
    names = F.create_map(*(F.lit(x) for pair in first.items() for x in pair))
    return F.when(space != "", F.concat(names[space], F.lit(":"), F.substring(iri, F.length(space) + 1, F.length(iri)))).otherwise(F.concat(F.lit("<"), iri, F.lit(">")))


def is_literal(term: Column) -> Column:
    return term.startswith('"')


def literal_value(term: Column) -> Column:
    return F.when(is_literal(term), F.regexp_extract(term, LITERAL, 1))


def literal_language(term: Column) -> Column:
    """The language tag's leading lower-case letters and hyphens, null without any."""
    return F.when(is_literal(term), F.nullif(F.regexp_extract(term, LITERAL, 3), F.lit("")))


def literal_datatype(term: Column) -> Column:
    return F.when(is_literal(term), F.nullif(F.regexp_extract(term, LITERAL, 5), F.lit("")))


def literal_integer(term: Column) -> Column:
    return F.when(is_literal(term), literal_value(term).try_cast("bigint"))


def in_english(term: Column) -> Column:
    """A literal without a language or in English; other terms pass."""
    return ~is_literal(term) | F.coalesce(literal_language(term), F.lit("en")).eqNullSafe("en")


def accepted(s: Column, p: Column, o: Column) -> Column:
    """Triples about items, their label-like ones in English only, no statement nodes as objects."""
    return s.startswith("wd:Q") & ~o.startswith("s:Q") & ~o.startswith("s:q") & (~p.isin(LABEL_LIKE) | o.endswith("@en"))


def strip_english(label: Column) -> Column:
    return F.regexp_replace(label, "@en$", "")


def strip_quotes(label: Column) -> Column:
    """Outer quotes go where both are there."""
    return F.when((F.length(label) >= 2) & label.startswith('"') & label.endswith('"'), F.substring(label, F.lit(2), F.length(label) - 2)).otherwise(label)


def normalize_literal(o: Column) -> Column:
    """Replacement characters go; the old tag of classical Chinese becomes the standard one."""
    return F.regexp_replace(F.regexp_replace(o, "�", ""), "@zh-classical$", "@lzh")


def entity_id(x: Column) -> Column:
    """The last part of an IRI or prefixed name, in upper case, trimmed."""
    return F.upper(F.trim(F.element_at(F.split(F.element_at(F.split(x, "/"), -1), ":"), -1)))


#: What an escaped string consists of: runs of UTF-16 units, code points, single escapes, plain text, a lone backslash.
_PIECE = r"(?s)(?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+|\\"
#: Halves of surrogate pairs without their other half.
_LONE = r"(?i)(?<!\\ud[89ab][0-9a-f]{2})\\ud[c-f][0-9a-f]{2}|\\ud[89ab][0-9a-f]{2}(?!\\ud[c-f][0-9a-f]{2})"
_ONE = {"\\t": "\t", "\\b": "\b", "\\n": "\n", "\\r": "\r", "\\f": "\f", '\\"': "'", "\\'": "'", "\\\\": "\\"}


def unescape(text: Column) -> Column:
    """Escapes of N-Triples strings, each decoded where it stands; an escaped quote becomes an apostrophe, bare carriage
    returns go, halves of surrogate pairs and numbers beyond Unicode become the replacement character, unknown escapes stay."""
    one = F.create_map(*(F.lit(x) for pair in _ONE.items() for x in pair))

    def decoded(x: Column) -> Column:
        units = F.decode(F.unhex(F.replace(F.regexp_replace(x, _LONE, r"\\ufffd"), F.lit("\\u"), F.lit(""))), "UTF-16BE")
        code = F.conv(F.substring(x, 3, 8), 16, 10).cast("bigint")
        sound = (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        point = F.decode(F.unhex(F.when(sound, F.substring(x, 3, 8)).otherwise("0000FFFD")), "UTF-32")
        sign = F.when(x.rlike(r"^\\u[0-9A-Fa-f]{4}"), units).when(x.rlike(r"^\\U[0-9A-Fa-f]{8}"), point)
        return F.coalesce(F.replace(sign, F.lit('"'), F.lit("'")), one[x], x)

    plain = F.replace(text, F.lit("\r"), F.lit(""))
    return F.when(F.contains(text, F.lit("\\")), F.array_join(F.transform(F.regexp_extract_all(plain, F.lit(_PIECE), 0), decoded), "")).otherwise(plain)


def escape_lines(o: Column) -> Column:
    """Line ends and tabs inside a literal, escaped so that a row stays one line of four fields."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(o, "\r", ""), "\n", "\\\\n"), "\t", "\\\\t")
