"""The core of an article in Markdown: title, relevant sections, nothing of the site around it."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of headings that mark content.
RELEVANT = (
    "abstract",
    "graphical abstract",
    "summary",
    "introduction",
    "background",
    "objectives",
    "methods",
    "methodology",
    "materials",
    "procedure",
    "approach",
    "experimental",
    "study design",
    "statistical analysis",
    "data analysis",
    "results",
    "findings",
    "analysis",
    "discussion",
    "conclusion",
    "conclusions",
    "implications",
    "clinical description",
    "genetic study",
    "case report",
    "case study",
    "patient description",
    "clinical features",
    "clinical presentation",
    "phenotype",
    "genotype",
    "molecular analysis",
    "genetic analysis",
    "molecular characterization",
    "diagnostic workup",
    "clinical data",
    "pathology",
    "histopathology",
    "imaging",
    "radiology",
    "treatment",
    "therapy",
    "outcome",
    "outcomes",
    "clinical outcome",
    "follow-up",
    "appendix",
    "appendices",
    "figures",
    "supplementary information",
    "supporting information",
    "additional information",
    "supplementary materials",
    "author contributions",
    "contributions",
    "data availability statement",
    "availability statement",
    "data availability",
    "competing interests",
    "conflict of interest",
    "conflicts of interest",
)
#: Parts of headings that mark everything else.
IRRELEVANT = (
    "references",
    "keywords",
    "bibliography",
    "citations",
    "citing literature",
    "citing",
    "cite",
    "how to cite",
    "cite this",
    "cited by",
    "reprints",
    "authors",
    "author information",
    "author details",
    "corresponding author",
    "affiliations",
    "corresponding",
    "availability",
    "conflicts",
    "main text",
    "limitations",
    "future work",
    "share",
    "sharing",
    "content link",
    "copyright",
    "license",
    "licence",
    "permissions",
    "rights",
    "related articles",
    "related publications",
    "related papers",
    "related content",
    "similar articles",
    "suggested articles",
    "suggested papers",
    "suggested content",
    "suggested publications",
    "publication history",
    "publication types",
    "editorial notes",
    "author notes",
    "editor comments",
    "reviewer comments",
    "help",
    "support",
    "opportunities",
    "connect",
    "additional links",
    "links",
    "article metrics",
    "articles & issues",
    "collections",
    "for authors",
    "follow us",
    "acknowledgements",
    "acknowledgments",
    "funding",
    "ethics statement",
    "ethical considerations",
)
#: Patterns at the start of headings of sites.
SITE = (
    r".*cookies?.*",
    r".*privacy.*",
    r"\bterms\b(?:\s+(?:of|and))?",
    r".*subscribe.*",
    r".*newsletter.*",
    r"\bfollow\b",
    r"social\s+(media|networks?|sharing)",
    r".*menu.*",
    r".*navigation.*",
    r".*footer.*",
    r".*header.*",
    r"\bsearch\b",
    r"\bcontact\b(?:\s+us)?",
    r"\babout\b(?:\s+us)?",
    r".*read.*content.*",
    r"similar content.*",
    r".*viewed by others",
    r"recommended.*",
    r"supplementary\s+.*",
    r"supplemental\s+.*",
    r"(site|view|page)\s+metrics|altmetrics?",
    r".*altmetric.*",
    r"declaration\s+.*",
    r"(check|service|system)\s+availability",
    r".*privacy.*",
    r".*password.*",
    r".*username.*",
    r"comment\s?.*",
    r"(article|paper)\s+metrics",
    r"(social|share).*media",
    r"download\s+(options?|links?)",
    r"article\s+information",
)
#: Patterns at the start of headings of pay walls.
PAYWALL = (
    r".*log ?in.*",
    r".*sign\s*in.*",
    r".*sign\s*up.*",
    r".*register.*",
    r".*create.*account.*",
    r".*free.*account.*",
    r".*subscription.*",
    r".*paywall.*",
    r".*access.*denied.*",
    r".*get\s+.*access.*",
    r".*premium.*content.*",
    r".*unlock.*content.*",
    r".*full.*access.*",
    r".*purchase.*",
)
#: Headings that are no titles.
METADATA = (
    "affiliations",
    "affiliation",
    "author",
    "authors",
    "author information",
    "author contributions",
    "contributions",
    "contributed equally",
    "equal contribution",
    "corresponding author",
    "correspondence",
    "conflict of interest",
    "conflicts of interest",
    "competing interests",
    "disclosure",
    "disclosures",
    "funding",
    "acknowledgments",
    "acknowledgements",
    "author details",
    "author notes",
)
#: Words of short lines that belong to a site.
CHROME = (
    "sign in",
    "sign up",
    "log in",
    "log-in",
    "register",
    "subscribe",
    "forgot password",
    "username",
    "password",
    "privacy",
    "terms",
    "cookie",
    "cookies",
    "share on",
    "facebook",
    "twitter",
    "linkedin",
    "email",
    "site chrome",
    "settings",
)
#: Headings that belong to an article among other sections of one.
AMBIGUOUS = ("supplementary information", "supporting information", "additional information", "competing interests", "conflict of interest", "conflicts of interest", "data availability", "author contributions")
#: Headings of sites that other texts use for content.
ELSEWHERE_CONTENT = ("contact", "privacy", "about")
#: Words in headings that show a study; three are needed.
STUDY_SIGNS = ("abstract", "introduction", "methodology", "methods", "results", "discussion", "conclusion", "references", "bibliography", "experimental", "statistical", "analysis", "data", "findings", "background")
#: Parts of a study's headings.
STUDY_PARTS = ("abstract", "introduction", "methods", "results", "discussion", "conclusion", "figures")
#: Words of headings of substance.
SUBSTANCE = ("method", "approach", "design", "protocol", "background", "context", "rationale", "motivation", "overview", "summary", "framework", "scope")
#: Words of texts on research, and of lines about authors and publication.
RESEARCH = ("abstract", "summary", "introduction", "background", "study", "research", "analysis", "method", "result", "patient", "clinical", "mutation", "gene", "protein", "syndrome", "disease", "treatment", "diagnosis")
PUBLICATION = ("affiliations", "affiliation", "department", "university", "correspondence", "corresponding author", "author information", "search for articles by this author", "article info", "publication history", "received", "accepted", "published", "doi:", "download pdf", "outline")
#: Labels on lines of their own, of articles and of sites, and what ends an article without headings.
LABELS = ("abstract", "introduction", "methods", "results", "discussion", "conclusion", "background", "objectives", "findings", "analysis")
SITE_LABEL = re.compile(r"(?:authors?|corresponding author|article information|download options?|article metrics|social media|related articles?|advertisement|footer):?")
OPENING_LABELS = ("abstract", "summary", "introduction", "background")
SITE_LINES = ("article metrics:", "social media:", "related articles:", "advertisement", "footer:", "terms of use", "privacy policy")
REFERENCES = ("references", "bibliography", "citations")
STARTERS = ("abstract", "summary", "introduction")
#: A core under this share of the text is taken for cut too far, and of a text that is no study.
LEAST_SHARE, LEAST_SHARE_PLAIN = 0.3, 0.5
SHORT_LINE = 140
_HEADING = re.compile(r"^(#{1,6})\s*([^\s#].*?)(?:\s*\{[^}]*\})?\s*$")


def _any(parts: Iterable[str]) -> str:
    return "|".join(map(re.escape, parts))


_RELEVANT, _IRRELEVANT, _CHROME = re.compile(_any(RELEVANT)), re.compile(_any(IRRELEVANT)), re.compile(rf"\b(?:{_any(CHROME)})\b")
_SITE, _PAYWALL = re.compile("|".join(f"(?:{p})" for p in SITE)), re.compile("|".join(f"(?:{p})" for p in PAYWALL))


@dataclass
class Head:
    """A heading: its line, level, lower-cased name and kind."""

    at: int
    level: int
    name: str
    kind: str

    def has(self, words: Iterable[str]) -> bool:
        return any(w in self.name for w in words)

    @property
    def off(self) -> bool:
        return self.kind in ("irrelevant", "paywall")

    @property
    def is_metadata(self) -> bool:
        return re.sub(r"[^\w\s]", "", self.name) in METADATA


def kind_of(heading: str) -> str:
    """paywall before relevant before irrelevant; neutral if none."""
    low = heading.lower()
    if _PAYWALL.match(low):
        return "paywall"
    if _RELEVANT.search(low):
        return "relevant"
    return "irrelevant" if _IRRELEVANT.search(low) or _SITE.match(low) else "neutral"


def kind_column(heading: Column) -> Column:
    """The same inside the JVM."""
    low = F.lower(heading)
    parts = lambda names: "|".join(re.sub(r"([.&+*?()\[\]{}|^$-])", r"\\\1", p) for p in names)
    opening = lambda patterns: "^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"
    irrelevant = low.rlike(parts(IRRELEVANT)) | low.rlike(opening(SITE))
    return F.when(low.rlike(opening(PAYWALL)), "paywall").when(low.rlike(parts(RELEVANT)), "relevant").when(irrelevant, "irrelevant").otherwise("neutral")


def heads_of(lines: list[str]) -> list[Head]:
    found = [(i, m) for i, line in enumerate(lines) if (m := _HEADING.match(line))]
    return [Head(i, len(m.group(1)), m.group(2).lower(), kind_of(m.group(2))) for i, m in found]


def in_context(heads: list[Head]) -> list[Head]:
    """Kinds settled by the other headings: among sections of a study, statements of authors are content; in other texts
    headings such as "About" may be."""
    study = sum(sign in h.name for h in heads for sign in STUDY_SIGNS) >= 3
    for h in heads:
        if h.kind != "paywall" and study and h.has(AMBIGUOUS):
            h.kind = "relevant"
        elif h.kind == "irrelevant" and not study and h.has(ELSEWHERE_CONTENT):
            h.kind = "neutral"
    return heads


def is_study(heads: list[Head], lines: list[str] = ()) -> bool:
    """Whether sections show a study, or, failing that, a line that is nothing but the name of such a section."""
    relevant = [h for h in heads if h.kind == "relevant"]
    return len(relevant) > 1 or any(h.has(STUDY_PARTS) for h in relevant) or any(x.strip().lower() in STUDY_PARTS for x in lines)


def second_start(heads: list[Head]) -> int:
    """The line a page shown twice starts again at: the larger heading over a repeated first section, else a second title
    after an abstract, else a second abstract; 0 if it is shown once."""
    relevant = [h for h in heads if h.kind == "relevant"]
    if len(relevant) < 2:
        return 0
    first, second = relevant[:2]
    if first.name == second.name and (over := larger_before(heads, second)) and over.at > first.at:
        return over.at
    titles = [h for h in heads if h.level == 1]
    if len(titles) > 1 and not titles[1].off:
        at = titles[1].at
        if any("abstract" in h.name for h in relevant if h.at < at) and any(h.at >= at for h in relevant):
            return at
    abstracts = [h for h in relevant if h.name == "abstract"]
    return abstracts[1].at if len(abstracts) > 1 else 0


def larger_before(heads: list[Head], head: Head) -> Head | None:
    """The nearest heading of a higher level before this one."""
    return next((h for h in reversed(heads) if h.at < head.at and h.level < head.level), None)


def opening_of(heads: list[Head]) -> Head:
    """The relevant heading an article opens with: the first abstract, summary or introduction, else the first."""
    relevant = [h for h in heads if h.kind == "relevant"]
    return next((h for h in relevant if h.has(STARTERS)), relevant[0])


def title_of(heads: list[Head], opening: Head) -> Head:
    """The last level-1 heading before the opening that is no metadata, else the last one at all, else a larger heading."""
    titles = [h for h in heads if h.level == 1 and h.at < opening.at]
    return next((h for h in reversed(titles) if not h.is_metadata), titles[-1] if titles else larger_before(heads, opening) or opening)


def core_end(heads: list[Head], lines: int) -> int:
    """The first irrelevant heading after the last relevant one, else the end."""
    last = max(h.at for h in heads if h.kind == "relevant")
    return next((h.at for h in heads if h.at > last and h.off), lines)


def tells_something(gap: str) -> bool:
    """Whether what stands between a title and the first section is content: long enough, not about authors and
    publication, and with words of research or at least two whole sentences."""
    if len(gap) < 50 or len(gap.split()) < 20:
        return False
    low = gap.lower()
    if sum(w in low for w in PUBLICATION) >= 2:
        return False
    return sum(w in low for w in RESEARCH) >= 3 or sum(len(s.split()) > 5 for s in gap.split(".")) >= 2


def has_major(heads: list[Head], title: Head, opening: Head) -> bool:
    """Whether a heading between title and opening outranks the opening, or equals it and has substance."""
    for h in heads:
        if title.at < h.at < opening.at and not h.off and not h.is_metadata:
            closed = any(o.at > h.at and o.level <= h.level for o in heads)
            if h.level < opening.level or h.level == opening.level and (h.kind == "relevant" or closed and h.has(SUBSTANCE)):
                return True
    return False


def without(lines: list[str], goes) -> list[str]:  # noqa: ANN001
    """The lines outside sections whose heading ``goes``, which reach to the next heading of their level or above."""
    heads, gone = heads_of(lines), set()
    for k, h in enumerate(heads):
        if goes(h):
            gone.update(range(h.at, next((o.at for o in heads[k + 1 :] if o.level <= h.level), len(lines))))
    return [line for i, line in enumerate(lines) if i not in gone]


def without_tail(lines: list[str]) -> list[str]:
    """The lines before a run of headings at the end that holds no relevant one and starts with an irrelevant one."""
    start = len(lines)
    for h in reversed(heads_of(lines)):
        if h.kind == "relevant":
            break
        start = h.at if h.off else start
    return lines[:start]


def from_labels(lines: list[str], title: Head, end: int) -> list[str]:
    """Title and what follows a line such as "Abstract", up to a line of the site; nothing without such a line."""
    body = lines[title.at + 1 : end]
    start = next((i for i, x in enumerate(body) if x.strip().lower() in OPENING_LABELS), None)
    if start is None:
        return []
    stop = next((i for i in range(start + 1, len(body)) if any(s in body[i].lower() for s in SITE_LINES)), len(body))
    return [lines[title.at], "", *body[start:stop]]


def core_of(lines: list[str], heads: list[Head]) -> tuple[list[str], int]:
    """The core before sections are cut from it, and the line it ends at. What stands between the title and the opening
    stays if it tells something, goes if no major heading is in it, and leaves all as it is otherwise."""
    opening = opening_of(heads)
    title, end = title_of(heads, opening), core_end(heads, len(lines))
    if title.level == 1 and title.at < opening.at:
        gap = lines[title.at + 1 : opening.at]
        if tells_something("\n".join(gap).strip()):
            return [lines[title.at], "", *"\n".join(gap).strip().split("\n"), "", *lines[opening.at : end]], end
        if not has_major(heads, title, opening):
            return ([] if title.off else [lines[title.at], ""]) + lines[opening.at : end], end
    if heads[0].at == title.at and heads[0].off:
        start = next(h.at for h in heads if h.kind == "relevant")
        return lines[start:end], end
    if title is opening and sum(h.kind == "relevant" for h in heads) == 1 and (labelled := from_labels(lines, title, end)):
        return labelled, end
    return lines[title.at : end], end


def refine(text: str) -> str:
    """The article in a page: shown once, from its title to the first irrelevant heading after the last relevant one,
    with relevant sections after that, without irrelevant sections, references and short lines of the site.

    A text without headings stays. One without relevant sections becomes empty if it has a pay wall, else loses its
    irrelevant sections. What would be left too little of stays whole, unless it is a study.
    """
    lines = text.split("\n")
    heads = heads_of(lines)
    if not heads:
        return text
    lines = lines[second_start(heads) :]
    whole, heads = "\n".join(lines), in_context(heads_of(lines))
    if not any(h.kind == "relevant" for h in heads):
        if any(h.kind == "paywall" for h in heads):
            return ""
        off = {h.at for h in heads if h.off}
        left = without_site([x for x in without(lines, lambda h: h.at in off)])
        study = is_study(heads, lines)
        return whole.strip() if not study and len(left) < LEAST_SHARE_PLAIN * len(whole) else left
    core, end = core_of(lines, heads)
    core = without(core, lambda h: h.off)
    if is_study(heads):
        core = without(core, lambda h: h.has(REFERENCES))
    core += without(without_tail(lines[end:]), lambda h: h.off)
    left = "\n".join(core)
    if len(left) < LEAST_SHARE * len(whole) and not is_study(heads, lines):
        return whole
    return without_site(core)


def without_site(lines: list[str]) -> str:
    """The lines without those of the site: short ones with its words, labels such as "Related articles" with what follows
    them, and irrelevant headings with theirs, up to the next heading or label of an article."""
    kinds = {h.at: h for h in in_context(heads_of(lines))}
    kept, skipping = [], False
    for i, line in enumerate(lines):
        plain = line.strip().lower()
        if i in kinds:
            skipping = kinds[i].off
        elif plain in LABELS:
            skipping = False
        elif SITE_LABEL.fullmatch(plain):
            skipping = True
        elif plain and len(plain) <= SHORT_LINE and _CHROME.search(plain):
            continue
        if not skipping:
            kept.append(line)
    return "\n".join(kept).strip()


def refined(documents: DataFrame, text: str) -> DataFrame:
    """Adds ``refined``. Texts without a heading stay in the JVM; null stays null."""

    def rewrite(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else refine(v))

    marked = F.when(F.col(text).rlike(r"(?m)^#{1,6}\s*[^\s#]"), F.col(text))
    return documents.withColumn("refined", F.coalesce(F.pandas_udf(rewrite, "string")(marked), F.col(text)))
