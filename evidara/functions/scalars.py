"""Column expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track readers.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "msclkid")
#: Endings that don't change what a keyword names, longest first.
SUFFIXES = (" signaling pathway", " signaling", " pathway")
#: Licences that permit sharing, and those that do under conditions.
PERMISSIVE = ("cc-by", "cc-by-sa", "cc0", "public-domain", "pd")
CONDITIONAL = ("cc-by-nc", "cc-by-nd", "cc-by-nc-nd", "cc-by-nc-sa")


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def without_tracking(url: Column) -> Column:
    """The URL without tracking parameters and parameters without a value; the order of the others stays."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (F.split_part(p, F.lit("="), F.lit(2)) != "") & ~F.split_part(p, F.lit("="), F.lit(1)).isin(*TRACKING))
    joined = F.array_join(kept, "&")
    bare = F.regexp_replace(url, r"\?[^#]*", "?")
    cut = F.regexp_replace(bare, r"\?", "")
    filled = F.concat(F.regexp_extract(url, r"^([^?#]*)", 1), F.lit("?"), joined, F.regexp_extract(url, r"(#.*)$", 1))
    return F.when(F.instr(url, "?") == 0, url).when(joined == "", cut).otherwise(filled)


def url_hash(url: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the URL without fragment."""
    return F.substring(F.sha2(without_fragment(url), 256), 1, 16)


def url_hash36(url: Column) -> Column:
    """The same 8 bytes as an unsigned number in base 36."""
    return F.lower(F.conv(url_hash(url), 16, 36))


def resource_id(counter: Column, url: Column) -> Column:
    """'{counter}_{first 8 digits of the hash, left-padded}'."""
    return F.concat(counter.cast("string"), F.lit("_"), F.substring(F.lpad(url_hash36(url), 8, "0"), 1, 8))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]*)", 1))


def is_pdf(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([^?#]*)", 1)).rlike(r"\.pdf$|/pdf/|/pdf$")


def pubmed_id(url: Column) -> Column:
    """(id, kind) of a PubMed or PMC address, else null."""
    pmid, pmc = F.regexp_extract(url, r"pubmed\.ncbi\.nlm\.nih\.gov/(\d+)", 1), F.regexp_extract(url, r"(PMC\d+)", 1)
    return F.when(pmid != "", F.struct(pmid.alias("id"), F.lit("pmid").alias("kind"))).when(pmc != "", F.struct(pmc.alias("id"), F.lit("pmcid").alias("kind")))


def fold_spelling(text: Column) -> Column:
    """British and American spellings made one."""
    return F.replace(F.replace(F.replace(text, F.lit("ae"), F.lit("e")), F.lit("oe"), F.lit("e")), F.lit("our"), F.lit("or"))


def without_kind(name: Column) -> Column:
    """The name without a trailing ' (kind)'."""
    return F.trim(F.regexp_replace(name, r"\s+\([a-zA-Z0-9_\s-]+\)\s*$", ""))


def without_abbreviation(term: Column) -> Column:
    """The term without capital abbreviations in parentheses."""
    return F.trim(F.regexp_replace(term, r"\s*\([A-Z0-9-]+\)", ""))


def without_suffix(term: Column) -> Column:
    """The term without one ending that names a kind of thing, the longest that fits."""
    out = term
    for s in reversed(SUFFIXES):
        out = F.when(F.lower(term).endswith(s), F.trim(F.substring(term, F.lit(1), F.length(term) - len(s)))).otherwise(out)
    return out


def singular(text: Column) -> Column:
    """Each word without a plural ending, by spelling alone."""

    def one(w: Column) -> Column:
        n = F.length(w)
        cut = lambda k: F.substring(w, F.lit(1), n - k)
        return (
            F.when(n <= 3, w)
            .when(w.endswith("ies") & (n > 4), F.concat(cut(3), F.lit("y")))
            .when(w.endswith("ses") & (n > 5), cut(1))
            .when(w.rlike("(xes|zes|ches|shes)$") & (n > 4), cut(2))
            .when(w.endswith("es") & (n > 4), cut(1))
            .when(w.endswith("s") & ~w.endswith("ss"), cut(1))
            .otherwise(w)
        )

    return F.array_join(F.transform(F.filter(F.split(text, r"\s+"), lambda x: x != ""), one), " ")


def citation_ids(text: Column) -> Column:
    """Distinct document ids cited in square brackets, in order of first citation."""
    brackets = F.regexp_extract_all(text, F.lit(r"\[([^\]]*\d+_[a-z0-9]{4,12}[^\]]*)\]"), 1)
    ids = F.flatten(F.transform(brackets, lambda b: F.regexp_extract_all(b, F.lit(r"(?<![a-z0-9_])(\d+_[a-z0-9]{8})(?![a-z0-9])"), 1)))
    return F.array_distinct(ids)


def is_list(name: Column) -> Column:
    """Whether a name lists several things: two commas, or one with ', and ' or a trailing parenthesis."""
    commas = F.length(name) - F.length(F.replace(name, F.lit(","), F.lit("")))
    return (commas >= 2) | ((commas == 1) & (name.rlike(r"\([^)]*\)\s*$") | F.lower(name).contains(", and ")))


def is_valid_form(form: Column) -> Column:
    """Whether a text can stand for an entity by itself."""
    letters = F.length(F.regexp_replace(form, r"[^\p{L}]", ""))
    n = F.length(form)
    bad = (n < 3) | form.rlike(r"[()]") | form.rlike(r"^\d") | form.rlike(r"[,;]")
    return ~bad & (letters >= F.when(n <= 4, 1).otherwise(2))


def pair_key(name1: Column, kind1: Column, name2: Column, kind2: Column) -> Column:
    """The two ends ordered by kind, then name."""
    a, b = F.struct(kind1.alias("kind"), name1.alias("name")), F.struct(kind2.alias("kind"), name2.alias("name"))
    return F.struct(F.least(a, b).alias("first"), F.greatest(a, b).alias("second"))


def permitted_kinds(kinds: Column) -> Column:
    """kind -> kinds it may pair with: all others, and itself if listed twice or alone."""
    distinct = F.array_distinct(kinds)
    twice = lambda k: (F.size(F.filter(kinds, lambda x: x == k)) >= 2) | (F.size(distinct) == 1)
    allowed = F.transform(distinct, lambda k: F.filter(distinct, lambda o: (o != k) | twice(k)))
    return F.map_from_arrays(distinct, allowed)


def matches_pattern(url: Column, pattern: Column) -> Column:
    """A pattern with * is a glob, any other a part of the URL; case doesn't count."""
    glob = F.concat(F.lit("(?s)^"), F.replace(F.regexp_replace(F.lower(pattern), r"([.\\+^$()\[\]{}|?])", r"\\$1"), F.lit("*"), F.lit(".*")), F.lit("$"))
    return F.when(F.instr(pattern, "*") > 0, F.regexp_like(F.lower(url), glob)).otherwise(F.contains(F.lower(url), F.lower(pattern)))


def slug(topic: Column) -> Column:
    """A file name: word characters joined by _, at most 80."""
    return F.trim(F.substring(F.regexp_replace(F.regexp_replace(F.lower(topic), r"[^\w\s-]", ""), r"[\s-]+", "_"), 1, 80), F.lit("_"))


def alpha_label(index: Column) -> Column:
    """0 -> A, 25 -> Z, 26 -> AA, ..."""
    letter = lambda k: F.char(F.lit(65) + F.pmod(k, F.lit(26)))
    two = F.floor(index / 26) - 1
    three = F.floor(two / 26) - 1
    return F.concat(F.when(index >= 702, letter(three)).otherwise(""), F.when(index >= 26, letter(two)).otherwise(""), letter(index))


def licence_verdict(licences: Column, error: Column) -> Column:
    """What a set of licences permits; the alphabetically first of the best class counts."""
    named = F.array_sort(F.array_distinct(F.filter(licences, lambda x: x.isNotNull())))
    first = lambda names: F.try_element_at(F.filter(named, lambda x: x.isin(*names)), F.lit(1))
    free, bound = first(PERMISSIVE), first(CONDITIONAL)
    verdict = F.when(error.isNotNull(), "unknown").when(free.isNotNull(), "redistributable").when(bound.isNotNull(), "share-alike").otherwise("restricted")
    return F.struct(verdict.alias("verdict"), F.when(error.isNull(), F.coalesce(free, bound, F.try_element_at(named, F.lit(1)))).alias("licence"))


def term_line(line: Column) -> Column:
    """(name, kind, attributes) of 'name # remark &key=value, &key2=value2'; null for an empty line or name."""
    name = F.trim(F.split_part(line, F.lit("#"), F.lit(1)))
    remark = F.when(F.instr(line, "#") > 0, F.substring(line, F.instr(line, "#") + 1, F.length(line))).otherwise("")
    parts = F.regexp_extract_all(remark, F.lit(r"&(\w+=[^&]*)"), 1)
    pairs = F.transform(parts, lambda p: F.struct(F.split_part(p, F.lit("="), F.lit(1)).alias("key"), F.regexp_replace(F.trim(F.substring(p, F.instr(p, "=") + 1, F.length(p))), r"\s*,\s*$", "").alias("value")))
    filled = F.filter(pairs, lambda p: p["value"] != "")
    keys = F.array_distinct(F.transform(filled, lambda p: p["key"]))
    last = F.transform(keys, lambda k: F.element_at(F.filter(filled, lambda p: p["key"] == k), -1)["value"])
    attributes = F.map_from_arrays(keys, last)
    return F.when(name != "", F.struct(name.alias("name"), F.try_element_at(attributes, F.lit("kind")).alias("kind"), F.map_filter(attributes, lambda k, _: k != "kind").alias("attributes")))


def context(text: Column, start: Column, end: Column, around: int) -> Column:
    """``around`` characters on both sides of [start, end), which is set off by asterisks."""
    low = F.greatest(start - around, F.lit(0))
    return F.concat(F.substring(text, low + 1, start - low), F.lit("**"), F.substring(text, start + 1, end - start), F.lit("**"), F.substring(text, end + 1, F.lit(around)))
