"""The filter language of reports: options are parsed on the driver and compiled to one predicate."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of the option on whether a pair's subject belongs to the topic, and its values.
TRUST_OPTIONS = ("on_topic", "on-topic", "on_subject", "on-subject", "subject_trust", "subject")
TRUST = {"yes": "pass", "on": "pass", "pass": "pass", "no": "fail", "off": "fail", "fail": "fail", "unjudged": "unjudged", "na": "unjudged", "none": "unjudged", "any": "any"}
#: Values of the option on acceptance.
ACCEPTED = {"yes": "yes", "true": "yes", "no": "no", "false": "no", "any": "any"}


@dataclass(frozen=True)
class Filters:
    accepted: str = "any"
    level: int = 1
    trust: str = "any"
    entities: tuple[tuple[str, str], ...] = field(default=())


def options(args: Iterable[str]) -> dict[str, str]:
    """'key:value' or 'key=value', by whichever sign comes first; of a repeated key the last counts."""
    out = {}
    for arg in args:
        at = min((i for i in (arg.find(":"), arg.find("=")) if i > 0), default=-1)
        if at < 0 or not arg[at + 1 :].strip():
            raise ValueError(f"not an option: {arg!r}")
        out[arg[:at].strip()] = arg[at + 1 :].strip()
    return out


def level(value: str) -> int:
    """The least evidence level of 'any', '7' or '7+'."""
    plain = value.strip().lower()
    if plain == "any":
        return 1
    number = plain.removesuffix("+")
    if not number.isdigit() or not 1 <= int(number) <= 9:
        raise ValueError("the evidence level is a number from 1 to 9, with or without +, or 'any'")
    return int(number)


def parse(spec: Mapping[str, str], kinds: Sequence[str] = ()) -> Filters:
    """Keys are accepted, evidence, on_topic (and its other names) or an entity kind; an unknown value or kind raises."""
    accepted, least, trust, entities = "any", 1, "any", []
    for key, raw in spec.items():
        name, value = key.lower(), raw.strip().lower()
        if name in TRUST_OPTIONS:
            if value not in TRUST:
                raise ValueError(f"{key} is yes, no, unjudged or any")
            trust = TRUST[value]
        elif name == "accepted":
            if value not in ACCEPTED:
                raise ValueError("accepted is yes, no or any")
            accepted = ACCEPTED[value]
        elif name == "evidence":
            least = level(value)
        elif kinds and name not in {k.lower() for k in kinds}:
            raise ValueError(f"unknown kind {key!r}; known are {', '.join(sorted(kinds))}")
        else:
            entities.append((name, value))
    return Filters(accepted, least, trust, tuple(entities))


def predicate(filters: Filters, accepted: Column, overall: Column, trusted: Column, ends: Sequence[tuple[Column, Column]]) -> Column:
    """One predicate of all filters. ``trusted`` is null for a pair that wasn't judged; ``ends`` are (kind, name). An entity
    filter asks for kind and whole canonical name of either end, regardless of case."""
    parts = [F.coalesce(overall >= filters.level, F.lit(False))]
    if filters.accepted != "any":
        parts.append(F.coalesce(accepted, F.lit(False)) == (filters.accepted == "yes"))
    if filters.trust != "any":
        parts.append(trusted.isNull() if filters.trust == "unjudged" else F.coalesce(trusted == (filters.trust == "pass"), F.lit(False)))
    for kind, name in filters.entities:
        parts.append(reduce(lambda x, y: x | y, [(F.lower(k) == kind) & (F.lower(n) == name) for k, n in ends]))
    return reduce(lambda x, y: x & y, parts)


def pruned(pairs: DataFrame, keep: Column, rows: DataFrame, keys: Sequence[str], documents: DataFrame, doc: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, rows, documents): the kept pairs, their rows and the documents these refer to."""
    kept = pairs.where(keep)
    of = rows.join(kept.select(*keys), list(keys), "left_semi")
    return kept, of, documents.join(of.select(doc).distinct(), doc, "left_semi")


def totals(pairs: DataFrame, accepted: str, ends: Sequence[tuple[str, str]], rows: DataFrame, quotes: str) -> DataFrame:
    """One row (pairs, accepted, rejected, entities, quotes) on what is left after filtering."""
    named = pairs.select(F.explode(F.array(*[F.struct(F.col(k).alias("kind"), F.col(n).alias("name")) for k, n in ends])).alias("e"))
    entities = named.agg(F.countDistinct("e").alias("entities"))
    yes = F.count_if(F.coalesce(F.col(accepted), F.lit(False)))
    counts = pairs.agg(F.count(F.lit(1)).alias("pairs"), yes.alias("accepted"), (F.count(F.lit(1)) - yes).alias("rejected"))
    quoted = rows.agg(F.coalesce(F.sum(quotes), F.lit(0)).cast("long").alias("quotes"))
    return counts.join(entities).join(quoted)  # one row each
