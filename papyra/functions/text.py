"""Text segmentation, parsing and normalisation as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import policy as P


#: White space that ends of texts lose: ASCII, separators and the Unicode blanks.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.trim(F.col(c) if isinstance(c, str) else c, F.lit(BLANKS))


def sentences(text: Column) -> Column:
    """Trimmed sentences: split after ``. ! ?`` before white space, blanks dropped."""
    parts = F.split(strip(text), r"(?U)(?<=[.!?])\s+")
    return F.filter(F.transform(parts, lambda s: strip(s)), lambda s: s != "")


def blocks(
    text: Column,
    per_block: int = P.SENTENCES_PER_BLOCK,
    tokens: int = P.TOKENS_PER_BLOCK,
    chars_per_token: float = P.CHARS_PER_TOKEN,
) -> Column:
    """Greedy blocks of whole sentences.

    A block closes before a sentence that would be one too many or push the token
    estimate over the limit; a sentence is never cut. Blank text has no blocks.
    """
    start = F.struct(
        F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0.0).alias("size")
    )

    def add(acc: Column, s: Column) -> Column:
        cost = F.length(s) / F.lit(chars_per_token)
        full = (F.size(acc["open"]) > 0) & ((F.size(acc["open"]) >= per_block) | (acc["size"] + cost > tokens))
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(F.array_join(acc["open"], " ")))).otherwise(acc["done"]).alias("done"),
            F.when(full, F.array(s)).otherwise(F.concat(acc["open"], F.array(s))).alias("open"),
            F.when(full, cost).otherwise(acc["size"] + cost).alias("size"),
        )

    def close(acc: Column) -> Column:
        return F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(F.array_join(acc["open"], " ")))).otherwise(acc["done"])

    return F.aggregate(sentences(text), start, add, close)


def triple_like(line: Column) -> Column:
    """Exactly two pipes."""
    return F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit(""))) == 2


def unquote(part: Column) -> Column:
    """A stripped text without one matching pair of quotes around it."""
    first = F.substring(part, 1, 1)
    paired = (F.length(part) >= 2) & first.isin('"', "'") & (F.substring(part, -1, 1) == first)
    return F.when(paired, F.substring(part, F.lit(2), F.length(part) - 2)).otherwise(part)


def parse_triples(response: Column) -> Column:
    """Triples of a model response: the lines of exactly two pipes whose three parts are good.

    Parts lose blanks, a pair of quotes and blanks again. Every step runs once a part: a
    line is cut once, and a variable of a lambda is not computed again where it is read.
    """
    cut = F.filter(F.transform(F.split(response, "\n"), lambda s: F.split(s, r"\|")), lambda t: F.size(t) == 3)
    stripped = F.transform(cut, lambda t: F.transform(t, lambda p: strip(p)))
    bare = F.transform(stripped, lambda t: F.transform(t, unquote))
    good = F.filter(bare, lambda t: F.forall(t, lambda p: (p != "") & (F.length(p) <= P.TRIPLE_PART_CHARS)))
    return F.transform(good, lambda t: F.transform(t, lambda p: strip(p)))


def normalize_component(s: Column) -> Column:
    """Lower case, single blanks, no trailing ``. , ; :``, no quotes around; null gives an empty string."""
    out = F.regexp_replace(strip(F.lower(s)), r"\s+", " ")
    out = strip(F.regexp_replace(out, r"[.,;:]+$", ""))
    return F.coalesce(F.regexp_replace(out, "^[\"'“”‘’]+|[\"'“”‘’]+$", ""), F.lit(""))


def acronym(s: Column) -> Column:
    """The first acronym in brackets, without a plural s; empty if none."""
    return F.regexp_extract(s, r"\(([A-Z0-9]{2,})s?\)", 1)


def project_subject(s: Column, entity: Column | None = None, head: Column | None = None) -> Column:
    """Acronym, else the provider's entity, else its head noun, else the text without articles, lower case."""
    plain = F.lower(strip(F.regexp_replace(s, r"(?iU)\b(the|a|an)\b", "")))
    options = [F.nullif(acronym(s), F.lit(""))] + [x for x in (entity, head) if x is not None] + [plain]
    return F.lower(F.coalesce(*options))


def predicate_keys() -> list[tuple[str, str]]:
    return sorted(P.PREDICATE_MAP.items(), key=lambda kv: -len(kv[0]))


def project_predicate(p: Column, verb: Column | None = None) -> Column:
    """The relation of the longest key that the predicate contains, else the provider's verb, else a fallback."""
    low = F.lower(F.coalesce(p, F.lit("")))
    out = F.coalesce(verb, F.lit(P.FALLBACK_PREDICATE)) if verb is not None else F.lit(P.FALLBACK_PREDICATE)
    for key, relation in reversed(predicate_keys()):
        out = F.when(low.contains(key), relation).otherwise(out)
    return F.when(strip(low) == "", P.FALLBACK_PREDICATE).otherwise(out)


def clean_object(o: Column) -> Column:
    """Without leading fillers, contrast tails and trailing punctuation; single blanks."""
    out = F.regexp_replace(strip(o), "(?iU)" + P.LEADING_FILLER, "")
    out = F.regexp_replace(out, "(?i)" + P.CONTRAST_TAIL, "")
    out = strip(F.regexp_replace(out, r"\s+", " "))
    return strip(F.regexp_replace(out, P.OBJECT_TAIL_PUNCTUATION, ""))


def project_object(o: Column, chunk: Column | None = None, head: Column | None = None, noun: Column | None = None) -> Column:
    """The provider's head noun if it is a known kind, its noun chunk without ``of``, its noun, else the cleaned text; lower case."""
    cleaned = F.lower(clean_object(o))
    options = []
    if chunk is not None:
        known = F.when(F.lower(head).isin(P.OBJECT_WORDS), head) if head is not None else F.lit(None)
        options += [known, F.regexp_replace(chunk, "(?i)" + P.OF_PREFIX, "")]
    if noun is not None:
        options.append(noun)
    return F.lower(F.coalesce(*options, cleaned))


#: Blanks, stop words and the noise patterns as one pattern, so that a node's text is computed and read once.
NOISE = "(?iU)^(?:" + "|".join(re.escape(w) for w in P.NOISE_WORDS) + ")$|" + "|".join(f"(?:{p})" for p in P.NOISE_PATTERNS)


def is_noise(node: Column) -> Column:
    """True for nodes that graphs drop: null, blanks, stop words and bare numbers, dates, ids and links."""
    return strip(F.coalesce(node, F.lit(""))).rlike(NOISE)


def classify_node(node: Column) -> Column:
    return F.when(is_noise(node), "noise").otherwise("concept")


def is_impactful(node: Column) -> Column:
    """Acronyms, phrases, proper nouns and names with a hyphen or digit, unless noise or shorter than 2."""
    shape = (
        node.rlike(r"^\p{Lu}+$") | node.contains(" ") | node.rlike(r"^\p{Lu}") | node.contains("-") | node.rlike(r"\d")
    )
    return F.coalesce((F.length(node) >= 2) & ~is_noise(node) & shape, F.lit(False))


def metadata_attribute(node: Column) -> Column:
    """Which kind of metadata a node is, or null. A bare year is none (its reading never succeeds)."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(P.METADATA_PATTERNS.items()):
        out = F.when(node.rlike("(?i)" + pattern), name).otherwise(out)
    return out


def metadata_value(node: Column) -> Column:
    kind = metadata_attribute(node)
    patterns = {k: "(?i)" + v for k, v in P.METADATA_PATTERNS.items()}
    issn = F.concat_ws("-", F.regexp_extract(node, patterns["issn"], 1), F.regexp_extract(node, patterns["issn"], 2))
    return (
        F.when(kind == "doi", F.replace(F.replace(node, F.lit("doi:"), F.lit("")), F.lit("DOI:"), F.lit("")))
        .when(kind == "issn", issn)
        .when(kind == "arxiv_id", F.regexp_extract(node, patterns["arxiv_id"], 1))
        .when(kind == "pmid", F.regexp_extract(node, patterns["pmid"], 1).cast("long").cast("string"))
        .when(kind == "url", F.regexp_extract(node, patterns["url"], 1))
    )


def fingerprint_text(s: Column) -> Column:
    """Lower case, letters, digits and single blanks only."""
    return strip(F.regexp_replace(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))


def fingerprint(*parts: Column, algorithm: str = "sha256") -> Column:
    """Hex digest of the normalised parts that are not blank, joined by `` | ``."""
    kept = F.filter(F.array(*(fingerprint_text(p) for p in parts)), lambda x: x.isNotNull() & (x != ""))
    joined = F.array_join(kept, " | ")
    return F.sha2(joined, 256) if algorithm == "sha256" else F.md5(joined.cast("binary"))


def hex_distance(a: Column, b: Column) -> Column:
    """Places at which two hex strings differ; of unequal lengths, the longer length."""
    same_size = F.aggregate(
        F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda s, x: s + x
    )
    return F.when(F.length(a) == F.length(b), same_size).otherwise(F.greatest(F.length(a), F.length(b)))


def fingerprint_similarity(a: Column, b: Column) -> Column:
    """1 - distance / (4 * length), between 0 and 1; 0 if either is blank."""
    longest = F.greatest(F.length(a), F.length(b))
    value = 1 - hex_distance(a, b) / (4 * longest)
    blank = a.isNull() | b.isNull() | (a == "") | (b == "")
    return F.when(blank, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def hypothesis_signature(source: Column, target: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lower(source), F.lit("→"), F.lower(target)), 256), 1, 64)


def entities_hash(entities: Column) -> Column:
    """Order-sensitive digest of the lower-cased entities."""
    return F.substring(F.sha2(F.array_join(F.transform(entities, lambda e: F.lower(e)), "|"), 256), 1, 16)


def query_text(source: Column, target: Column, focus: Column | None = None) -> Column:
    """The search text of a pair (or of one entity), narrowed by any focus entities."""
    base = F.when(target.isNull(), F.concat(F.lit("related to "), source)).otherwise(
        F.concat(F.lit("relationship between "), source, F.lit(" and "), target)
    )
    if focus is None:
        return base
    return F.when(F.size(focus) > 0, F.concat(F.lit("("), base, F.lit(") AND ("), F.array_join(focus, " OR "), F.lit(")"))).otherwise(base)


def preview(text: Column) -> Column:
    """Long input as its length, its first and its last characters; short input whole."""
    size = F.length(text)
    tail = F.substring(text, F.greatest(size - P.PREVIEW_TAIL + 1, F.lit(1)), F.lit(P.PREVIEW_TAIL))
    wrapped = F.concat(
        F.lit("[LARGE INPUT PREVIEW]\nTotal characters: "),
        size.cast("string"),
        F.lit("\nSnippet: "),
        F.substring(text, 1, P.PREVIEW_HEAD),
        F.lit("...\nEnd of input: ..."),
        tail,
        F.lit("\n[END PREVIEW]"),
    )
    return F.when(size > P.PREVIEW_OVER, wrapped).otherwise(text)


def intent(response: Column) -> Column:
    """label, topic, domain and entities of the last line with a pipe (else of the whole text)."""
    lines = F.filter(F.split(response, "\n"), lambda s: s.contains("|"))
    line = F.coalesce(F.get(lines, F.size(lines) - 1), response)
    part = F.transform(F.split(line, r"\|"), lambda p: strip(unquote(strip(p))))
    seed = F.upper(F.get(part, 0)) == "RESEARCH_SEED"

    def at(k: int) -> Column:
        return F.coalesce(F.get(part, k), F.lit(""))

    entities = F.filter(F.transform(F.split(at(3), ","), lambda e: strip(e)), lambda e: e != "")
    return F.struct(
        F.upper(F.get(part, 0)).alias("label"),
        F.when(seed, at(1)).alias("topic"),
        F.when(seed, at(2)).alias("domain"),
        F.when(seed, entities).alias("entities"),
    )


def seed_endpoints(entities: Column, topic: Column) -> Column:
    """source, target and focus of a research seed."""
    n = F.size(entities)
    return F.struct(
        F.coalesce(F.get(entities, 0), topic).alias("source"),
        F.when(n >= 2, F.get(entities, n - 1)).otherwise(topic).alias("target"),
        F.when(n > 2, F.slice(entities, 2, F.greatest(n - 2, F.lit(1)))).otherwise(F.array().cast("array<string>")).alias("focus"),
    )


def source_ref_id(ref: Column, kind: str = "paper") -> Column:
    """The number in ``kind:number``, null for anything else."""
    return F.when(F.startswith(ref, F.lit(kind + ":")), F.split_part(ref, F.lit(":"), F.lit(2)).try_cast("bigint"))


def arrow_path(path: Column) -> Column:
    return F.array_join(path, " -> ")
