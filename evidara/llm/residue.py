"""Problem 9: unfilled templates, filler, error messages and notices that scripts are needed.

Character n-gram models of filler, of notices and of placeholders are fitted on general samples, generated below from forms
and word lists that were written for this purpose and not taken from the tables. The model of natural prose is a mixture of
all texts, each sentence counted once, so that residue copied often doesn't become prose, and of technical prose, so that
sentences which speak of servers, scripts or errors count as prose. Windows in which a residue model is likelier than
prose localise residue; it stays if the model is likelier over the whole line that holds it, clearly likelier over the
sentence, or if it runs on for long. A text is excluded by how much of it such stretches cover. Placeholders are modelled on shapes
(letters made equal), so unseen field names count as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from http import HTTPStatus
from itertools import product
from pydoc_data.topics import topics

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of the usual dummy text.
DUMMY = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
#: Words typed where text is to come.
TYPED = ("foo bar baz qux test blah asdf qwerty", "todo tbd tbc tba n/a ??? xxx fixme", "xxx xx xxxx xxxxx", "abc abcd aaa zzz asd jkl hjkl")
#: Forms of phrases that stand where text is to come, and what is to come.
STAND_INS = (
    (
        ("put your {} here.", "write {} here.", "{} will be placed here.", "this is where the {} goes.", "example {} for layout only.", "dummy {} to fill the page.", "{} placeholder.", "{} coming soon.", "{} to follow.", "sample {} only.", "click to add {}.", "type your {} here.", "replace this {}.", "your own {} here.", "insert your {} here.", "[insert {} here]", "[your {}]", "[enter your {}]", "the {} goes here."),
        ("headline", "heading", "paragraph", "content", "copy", "summary", "description", "caption text", "body", "subtitle", "name", "abstract text", "title text"),
    ),
    (
        ("hier {} einfügen.", "hier steht dein {}.", "hier folgt der {}.", "{} folgt.", "beispiel {} zum ausfüllen.", "{} als platzhalter.", "blindtext für {}."),
        ("blindtext", "titel", "inhalt", "absatz", "beispieltext", "text", "titeltext"),
    ),
    (
        ("escriba aquí su {}.", "aquí irá su {}.", "{} de relleno.", "{} de ejemplo aquí.", "{} pendiente de añadir.", "inserte su {} aquí."),
        ("título", "texto", "contenido", "párrafo", "resumen breve"),
    ),
    (
        ("insérez votre {} ici.", "ici votre {}.", "{} à venir.", "{} de remplissage à remplacer.", "{} d'exemple.", "exemple de {} à compléter."),
        ("titre", "texte", "contenu", "paragraphe", "résumé bref"),
    ),
)
#: Openings and closings of placeholders.
BRACKETS = (("{{", "}}"), ("{{ ", " }}"), ("{{ page.", " }}"), ("{", "}"), ("${", "}"), ("#{", "}"), ("<%= ", " %>"), ("<% ", " %>"), ("{% ", " %}"), ("{% block ", " %}"), ("[[", "]]"), ("<<", ">>"), ("__", "__"), ("&lt;", "&gt;"), ("%(", ")s"), ("[insert ", " here]"), ("[insert ", "]"), ("<insert ", ">"), ("[", " to be added]"), ("[", " goes here]"), ("[your ", "]"), ("[enter ", "]"), ("@@", "@@"), ("%%", "%%"))
#: What such placeholders stand for.
FIELDS = ("title", "heading", "address", "company", "customer_name", "summary_text", "body", "email address", "first_name", "last_name", "order number", "phone", "date", "year", "short_description", "link_url", "image caption", "item count", "subject", "discussion", "conclusions", "department")

THINGS = ("page", "article", "document", "file", "content", "site", "item", "link")
SCRIPTS = ("JavaScript", "scripts", "scripting", "cookies", "JavaScript and cookies", "active content", "JS")
#: Forms of notices of pages that run on scripts ({} is JavaScript or the like).
NEEDED = """Please enable {} and reload.
Please turn on {} in your browser settings to use this site.
Turn {} on and try again.
You need to enable {} to run this app.
You must allow {} in your web browser to continue.
{} must be switched on for this page to work.
{} is required to display this page.
This page requires {}.
This website needs {} to function.
Our site does not work without {} enabled.
This service doesn't work properly without {}.
It looks like {} is disabled in your browser.
{} is turned off or blocked in your browser.
Your browser does not support {}.
We could not start the application because {} is disabled.
noscript: {} is off.
Without {} the full text cannot be shown.""".split("\n")
#: Other notices of browsers and applications.
BROWSER = """Your browser is not supported. Please upgrade to a newer version.
You are using an outdated browser. Update it to view this site.
The page cannot be displayed in your browser.
Please wait while the page is loading...
Loading, please wait.
This application works best in a modern browser.
One moment please, checking your connection.
We are verifying that you are human. This may take a few seconds.
Checking whether the connection to the site is secure.
Your browser will redirect you before the page opens.""".split("\n")
#: Forms of messages about something that can't be had ({} is the thing).
FAILED = """Sorry, we couldn't find that {}.
The {} you requested could not be found.
The requested {} was not found on our server.
This {} cannot be found. It may have been removed or renamed.
This {} no longer exists or has been moved to another address.
The {} you are looking for is not available.
The {} is no longer available here.
The {} was deleted or withdrawn.
The {} could not be loaded. Please reload.
Failed to load the {}.
The {} failed to load (error code 0).
Unable to retrieve the {} at this time.
You don't have permission to access this {}.
You are not authorized to view this {}.
Access to this {} is denied.
The {} has moved permanently.
You may have typed the address of the {} incorrectly.
The {} can't be displayed right now.""".split("\n")
#: Other messages of servers and applications.
SERVER = """Error 0: something went wrong.
Oops, an unexpected error has occurred. Please try again later.
Sorry, there was a problem on our end.
Something went wrong while processing the request.
Internal error. Error code 0.
The server encountered an error and could not complete your request.
The server is temporarily unavailable. Please try again in a few minutes.
The service is temporarily down for maintenance.
The service is overloaded, try again later.
The server took too long to answer. Connection timed out.
The connection was reset. Request timed out.
Your session has timed out. Please sign in again.
Your login expired. Log in again to continue.
Please log in or register to continue reading.
Sign in to read the full text.
You have been logged out.
Your subscription has expired. Please renew your subscription.
Your library does not subscribe to this journal. Ask your librarian for access.
Subscription required to access the full text.
You have made too many requests within a short time. Slow down.
Rate limit exceeded. Wait a minute before the next call.
Your address was blocked because of unusual traffic from your network.
Request blocked. Incident number 0.
Reference id: 0
Request number: 0
Error establishing a database connection to host
Could not connect to the database: timeout.
Fatal error: uncaught exception in line 0
If the problem persists, report the problem to the help desk.
Contact support
Contact the administrator
Report this problem
Go back to the previous page
Go to the home page
Return to the start page
Back to the homepage
Try searching for it instead.
Reload the page
Retry now or try again""".split("\n")
#: The same in other languages.
ABROAD = """Bitte aktivieren Sie JavaScript in Ihrem Browser. JavaScript ist in Ihrem Browser deaktiviert.
Diese Seite benötigt JavaScript. Für diese Anwendung muss JavaScript aktiviert sein.
Ihr Browser ist veraltet und wird nicht mehr unterstützt.
Die Seite konnte nicht gefunden werden. Die angeforderte Seite existiert nicht.
Fehler 0: Seite nicht gefunden. Zugriff nicht erlaubt. Der Zugriff wurde verweigert.
Sie haben keine Berechtigung, diese Seite anzuzeigen. Bitte melden Sie sich erneut an.
Ihre Sitzung ist beendet. Die Sitzung ist abgelaufen.
Der Inhalt ist zurzeit nicht verfügbar. Bitte versuchen Sie es in einigen Minuten noch einmal.
Es ist ein Fehler aufgetreten. Der Server ist vorübergehend nicht erreichbar.
Veuillez activer JavaScript dans votre navigateur. JavaScript est désactivé dans votre navigateur.
Cette page nécessite JavaScript. Pour afficher cet article, activez les scripts.
Votre navigateur est obsolète et n'est plus pris en charge.
La page demandée n'existe pas. Page introuvable. Erreur 0.
Vous n'avez pas accès à cette page. Veuillez vous connecter. L'accès est refusé.
Votre session est terminée. Reconnectez-vous pour continuer.
Le service est momentanément indisponible. Merci de réessayer plus tard. Une erreur est survenue.
Por favor, active JavaScript en su navegador. JavaScript está desactivado en su navegador.
Esta página requiere JavaScript. Para ver este artículo debe permitir los scripts.
Su navegador no es compatible o está anticuado.
La página solicitada no existe. No se encontró la página. Error 0.
No tiene permiso para ver esta página. Inicie sesión de nuevo. El acceso fue denegado.
Su sesión ha terminado. La sesión ha caducado.
El servicio no está disponible en este momento. Inténtelo de nuevo más tarde. Se produjo un error.""".split("\n")
#: How an interpreter reports an exception.
EXCEPTIONS = ("ValueError: invalid literal", "TypeError: unsupported operand", "KeyError: 'id'", "AttributeError: 'NoneType' object has no attribute", "IndexError: list index out of range", "RuntimeError: failed", "NullPointerException", "ImportError: no module named")

#: What a sign is called where a sentence speaks of it.
SIGNS = "marker markers field fields tag tags token tokens placeholder placeholders variable variables symbol symbols notation syntax string strings macro macros brackets braces delimiter delimiters".split()

ORDER = 5
TEXT_BUCKETS, SHAPE_BUCKETS = 1 << 20, 1 << 16
FLOOR, CEILING = -4.0, 6.0
#: (window in n-grams, least mean log-ratio in it) for text and for shapes.
TEXT_WINDOW, SHAPE_WINDOW = (16, 1.2), (4, 2.4)
#: Characters that must be covered.
LEAST_COVER = 5
#: Least mean log-ratio of the whole line or of the whole sentence around a window, and the length of a run of windows
#: that needs neither.
LINE_RATIO, SENTENCE_RATIO, LONG_RUN = 0.2, 1.0, 24
#: Least mean log-ratio of a line shorter than a window.
SHORT_RATIO = 0.5
#: Characters looked at around a window for the ends of its line and sentence.
REACH = 2000
#: Weight of technical prose in the model of prose (not of shapes: it shows signs of its own).
TECHNICAL = 0.3
#: Longest stretch within a placeholder that windows leave out.
LONGEST_NAME = 40
#: Least mean log-ratio, against technical prose, that keeps a sentence out of the model of prose.
KEPT_OUT = 0.8
AT_ONCE = 4_000_000
#: A line shorter than a window of text.
_LINE = re.compile(rf"(?m)^[^\S\n]*(\S(?:[^\n]{{0,{TEXT_WINDOW[0] + ORDER - 4}}}\S)?)[^\S\n]*$")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_NEWLINES = re.compile(r"\n+")
_DIGIT = re.compile(r"\d")
_WORD_BEFORE, _WORD_AFTER = re.compile(r"([^\W\d_]+)[\s'\"]+$"), re.compile(r"[\s'\"]+([^\W\d_]+)")
#: A sign that one of BRACKETS has.
_OPENS = re.compile(r"[{\[<_@]|&lt;|%[%(]")
_SIGN = re.compile(r"[{}\[\]<>%@_$#&;]")


def _notices() -> list[str]:
    out = [form.format(what) for form, what in product(NEEDED, SCRIPTS)] + [form.format(what) for form, what in product(FAILED, THINGS)]
    out += (BROWSER + SERVER + ABROAD) * 6
    statuses = [s for s in HTTPStatus if s.value >= 400]
    out += [f"HTTP status {s.value} {s.phrase}: {s.description}" for s in statuses] * 2 + [f"HTTP {s.value} error ({s.phrase})" for s in statuses] * 2
    return out + [f'traceback (most recent call last): file "main.py", line {i}, in run {e}' for i, e in enumerate(EXCEPTIONS)] * 4


@cache
def _samples() -> tuple[list[str], list[str], list[str]]:
    """(filler, notices, placeholders) to fit the models on."""
    rng = np.random.default_rng(0)
    filler = [" ".join(rng.choice(DUMMY, 12)) + "." for _ in range(150)]
    filler += [" ".join(rng.choice(words.split(), 12)) for words in TYPED for _ in range(40)]
    filler += [form.format(what) for forms, words in STAND_INS for form, what in product(forms, words)]
    fields = [f.replace(a, b) for f in FIELDS for a, b in (("_", " "), (" ", "_"))]
    return filler, _notices(), [f"a {a}{f}{b} a" for (a, b), f in product(BRACKETS, fields)]


def _technical() -> list[str]:
    """Paragraphs of prose from the language reference in the standard library."""
    paragraphs = [p for text in topics.values() for p in re.split(r"\n\s*\n", text)]
    flat = [re.sub(r'["*]', "", " ".join(p.split())) for p in paragraphs if "::=" not in p and ">>>" not in p and not p.startswith("   ")]
    return [_DIGIT.sub("0", p) for p in flat if p.endswith(".") and len(p) > 60]


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points with digits made equal, ORDER zeros after each text; where each text begins."""
    lower = [t.lower() if len(t.lower()) == len(t) else "".join(c if len(c.lower()) != 1 else c.lower() for c in t) for t in texts]
    flat = np.frombuffer((("\0" * ORDER).join(lower) + "\0" * ORDER).encode("utf-32-le", "surrogatepass"), np.uint32)
    flat = np.where((flat >= 48) & (flat <= 57), 48, flat).astype(np.uint64)
    starts = np.cumsum([0, *(len(t) + ORDER for t in texts)])[:-1]
    return flat, starts


def _shape(flat: np.ndarray) -> np.ndarray:
    """Letters made equal."""
    letter = ((flat >= 97) & (flat <= 122)) | (flat >= 0xC0)
    return np.where(letter, 97, flat).astype(np.uint64)


def _buckets(flat: np.ndarray, buckets: int) -> np.ndarray:
    count = max(0, flat.size - ORDER + 1)
    gram = np.zeros(count, np.uint64)
    for k in range(ORDER):
        gram = (gram ^ flat[k : k + count]) * np.uint64(0x9E3779B97F4A7C15)
        gram ^= gram >> np.uint64(29)
    return ((gram * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int64)


def _valid(size: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """True where an n-gram lies within one text."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + np.maximum(lengths - ORDER + 1, 0), size), -1)
    return np.cumsum(edge)[:size] > 0


def _runs(texts: pd.Series) -> Iterator[tuple[int, list[str]]]:
    start, run, size = 0, [], 0
    for i, t in enumerate(texts):
        if run and size + len(t) > AT_ONCE:
            yield start, run
            start, run, size = i, [], 0
        run.append(t)
        size += len(t) + ORDER
    if run:
        yield start, run


def _counts(texts: list[str], without: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """n-grams by bucket, of text and of shapes, but not of texts whose mean in a table of ``without`` is KEPT_OUT or more."""
    flat, starts = _points(texts)
    size = max(0, flat.size - ORDER + 1)
    ok = _valid(size, starts, np.array([len(t) for t in texts]))
    text = _buckets(flat, TEXT_BUCKETS)
    if without is not None and size:
        # Texts begin one after the other, each followed by ORDER zeros, so n-grams of a text lie from its start to the next.
        first = np.minimum(starts, size - 1)
        n = np.maximum(1, np.add.reduceat(ok, first, dtype=np.int64))
        best = np.max([np.add.reduceat(np.where(ok, table[text], 0.0), first) / n for table in without], axis=0)
        ok &= np.repeat(best < KEPT_OUT, np.diff(np.append(starts, size)))[:size]
    return (
        np.bincount(text[ok], minlength=TEXT_BUCKETS),
        np.bincount(_buckets(_shape(flat), SHAPE_BUCKETS)[ok], minlength=SHAPE_BUCKETS),
    )


def pieces(documents: DataFrame) -> DataFrame:
    """(text): the distinct sentences and lines of all texts, lower-cased with digits made equal, and what is around each
    cut between two of them."""
    plain = F.split(F.translate(F.lower("text"), "123456789", "0" * 9), _SENTENCE.pattern)
    cuts = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.concat(F.substring(F.element_at("p", i), 1 - ORDER, ORDER - 1), F.lit(" "), F.substring(F.element_at("p", i + 1), 1, ORDER - 1)))
    both = F.when(F.size("p") > 1, F.concat("p", cuts)).otherwise(F.col("p"))
    return documents.select(plain.alias("p")).select(F.explode(both).alias("text")).distinct()


def prose_counts(documents: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How often each n-gram bucket occurs in the distinct pieces of all texts, without those a first fit of the residue
    models against technical prose takes for residue, however often they are copied; the tables' sizes are fixed, so
    little comes to the driver."""
    none = (np.zeros(TEXT_BUCKETS, np.int64), np.zeros(SHAPE_BUCKETS, np.int64))
    held = documents.sparkSession.sparkContext.broadcast(fit(none)[:2])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        text, shape = np.zeros(TEXT_BUCKETS, np.int64), np.zeros(SHAPE_BUCKETS, np.int64)
        for b in batches:
            for _, run in _runs(b["text"]):
                t, s = _counts(run, held.value)
                text += t
                shape += s
        for base, table in ((0, text), (TEXT_BUCKETS, shape)):
            full = np.flatnonzero(table)
            yield pd.DataFrame({"bucket": (full + base).astype(np.int32), "n": table[full]})

    got = pieces(documents).mapInPandas(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(TEXT_BUCKETS + SHAPE_BUCKETS, np.int64)
    table[got["bucket"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return table[:TEXT_BUCKETS], table[TEXT_BUCKETS:]


def _ratio(sample: np.ndarray, prose: np.ndarray, technical: np.ndarray | None = None) -> np.ndarray:
    """Log of how much likelier the sample's model makes each bucket than prose does."""
    a, b = sample / max(1, sample.sum()), prose / max(1, prose.sum())
    if technical is not None:
        share = TECHNICAL if prose.any() else 1.0
        b = (1 - share) * b + share * technical / technical.sum()
    return np.clip(np.log(np.maximum(a, 1e-6)) - np.log(np.maximum(b, 1e-6)), FLOOR, CEILING).astype(np.float32)


def fit(prose: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Log-ratio tables of filler, notices and placeholders."""
    filler, notices, holders = _samples()
    text = _counts([s for p in _technical() for s in _SENTENCE.split(p)])[0]
    return [_ratio(_counts(filler)[0], prose[0], text), _ratio(_counts(notices)[0], prose[0], text), _ratio(_counts(holders)[1], prose[1])]


def _plain(sentence: str) -> str:
    return re.sub(r"0+", "0", _DIGIT.sub("0", sentence.lower()))


@cache
def _short() -> frozenset[str]:
    """What is residue where it is all of a line, however short."""
    filler, notices, _ = _samples()
    return frozenset(_bare(p) for x in (*filler, *notices, *(w for words in TYPED for w in words.split())) for p in (x, *_SENTENCE.split(x)))


def _bare(line: str) -> str:
    return _plain(line).strip(" .,:;!()[]<>*#-–")


def _is_short(line: str) -> bool:
    return bool(_bare(line)) and _bare(line) in _short()


def _cover(score: np.ndarray, total: np.ndarray, window: int, least: float) -> np.ndarray:
    """True at the n-grams of windows whose mean is at least ``least`` and that are positive themselves; ``total`` holds
    the sums of all before each."""
    if score.size < window:
        return np.zeros(score.size, bool)
    at = np.flatnonzero(total[window:] - total[:-window] >= least * window)
    edge = np.zeros(score.size + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return (np.cumsum(edge)[:-1] > 0) & (score > 0)


def _shape_hits(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams in windows of placeholders, where each text begins)."""
    flat, starts = _points(texts)
    size = max(0, flat.size - ORDER + 1)
    ok = _valid(size, starts, np.array([len(t) for t in texts]))
    score = np.where(ok, table[_buckets(_shape(flat), SHAPE_BUCKETS)], np.float32(FLOOR))
    return np.flatnonzero(_cover(score, np.concatenate(([0.0], np.cumsum(score, dtype=np.float64))), *SHAPE_WINDOW) & ok), starts


def _runs_of(at: np.ndarray, gap: int) -> list[tuple[int, int]]:
    """(first, last) n-gram of each run of hits with gaps of no more than ``gap``."""
    cuts = np.flatnonzero(np.diff(at) > gap)
    return list(zip(at[np.concatenate(([0], cuts + 1))].tolist(), at[np.concatenate((cuts, [at.size - 1]))].tolist(), strict=True))


def _around(pattern: re.Pattern, text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The stretches between cuts that a span touches, looked at up to REACH characters beyond it."""
    low, high = max(0, start - REACH), min(len(text), end + REACH)
    out = []
    for m in pattern.finditer(text, low, high):
        if m.end() <= start:
            low = m.end()
        else:
            out.append((low, m.start()))
            low = m.end()
            if m.start() >= end:
                break
    else:
        out.append((low, high))
    return out


def locate(texts: list[str], tables: list[np.ndarray]) -> list[list[tuple[int, int]]]:
    """For each text the (start, end) of its residue."""
    flat, starts = _points(texts)
    size = max(0, flat.size - ORDER + 1)
    ok = _valid(size, starts, np.array([len(t) for t in texts]))
    text = _buckets(flat, TEXT_BUCKETS)
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    scores = [np.where(ok, table[text], np.float32(FLOOR)) for table in tables[:2]]
    sums = [np.concatenate(([0.0], np.cumsum(score, dtype=np.float64))) for score in scores]

    def mean(kind: int, i: int, low: int, high: int) -> float:
        a, b = starts[i] + low, starts[i] + high - ORDER + 1
        return (sums[kind][b] - sums[kind][a]) / (b - a) if b > a else FLOOR

    def stays(kind: int, i: int, low: int, high: int) -> bool:
        t = texts[i]
        if kind == 2:
            return not _spoken_of(t, low, high)
        if kind == 0 and high - low >= LONG_RUN:
            return True
        return any(mean(kind, i, *x) >= least for pattern, least in ((_NEWLINES, LINE_RATIO), (_SENTENCE, SENTENCE_RATIO)) for x in _around(pattern, t, low, high))

    def keep(kind: int, marks: np.ndarray, begins: np.ndarray, numbers: list[int] | range) -> None:
        owner = np.searchsorted(begins, marks, side="right") - 1
        for k in np.unique(owner):
            i = numbers[k]
            for a, b in _runs_of(marks[owner == k] - begins[k], LONGEST_NAME if kind == 2 else ORDER):
                span = _signed(texts[i], a, b + ORDER) if kind == 2 else (a, b + ORDER)
                if stays(kind, i, *span):
                    out[i].append(span)

    for kind in (0, 1):
        keep(kind, np.flatnonzero(_cover(scores[kind], sums[kind], *TEXT_WINDOW) & ok), starts, range(len(texts)))
    # Placeholders are sought in texts that hold one of their signs.
    signed = [i for i, t in enumerate(texts) if _OPENS.search(t)]
    if signed:
        keep(2, *_shape_hits([texts[i] for i in signed], tables[2]), signed)
    # A line shorter than a window is judged by its own n-grams.
    for i, t in enumerate(texts):
        for m in _LINE.finditer(t):
            if _is_short(m.group(1)) or max(mean(0, i, *m.span(1)), mean(1, i, *m.span(1))) >= SHORT_RATIO:
                out[i].append(m.span(1))
        out[i] = _joined(out[i])
    return out


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _signed(text: str, start: int, end: int) -> tuple[int, int]:
    """The span from its first sign to its last; empty if it has fewer than two."""
    at = [m.start() for m in _SIGN.finditer(text, start, end)]
    return (at[0], at[-1] + 1) if len(at) > 1 else (start, start)


def _spoken_of(text: str, start: int, end: int) -> bool:
    """Whether a placeholder is no whole one, or is called a sign by a word next to it."""
    if end - start < LEAST_COVER - 2:
        return True
    before, after = _WORD_BEFORE.search(text[max(0, start - 40) : start]), _WORD_AFTER.match(text, end)
    return any(m is not None and m.group(1).lower() in SIGNS for m in (before, after))


def find_residue(documents: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, start, end): the stretches of each text that are residue, at least LEAST_COVER characters in all unless one is
    a line like "TBD". A text or line shorter than a window counts as a whole; one too short for that many n-grams (about
    eight characters) must be one of the samples.

    Null and empty texts give no row, nor does an empty table. Copies are judged alike; repeated ids each for itself;
    other columns are ignored. Whole texts are read, twice: once for the model of prose, once for the windows.
    """
    rows = documents.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    held = documents.sparkSession.sparkContext.broadcast(fit(prose_counts(rows)))
    kind = dict(rows.dtypes)["id"]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = b["id"].tolist()
            for start, run in _runs(b["text"]):
                found = [(ids[start + i], s, e) for i, spans in enumerate(locate(run, held.value)) if sum(e - s for s, e in spans) >= LEAST_COVER or any(_is_short(run[i][s:e]) for s, e in spans) for s, e in spans]
                yield pd.DataFrame({"id": pd.Series([f[0] for f in found], dtype=b["id"].dtype), "start": pd.Series([f[1] for f in found], dtype="int32"), "end": pd.Series([f[2] for f in found], dtype="int32")})

    return rows.mapInPandas(find, f"id {kind}, start int, end int").withColumnRenamed("id", id_col)


def exclude_residue(documents: DataFrame, id_col: str, text: str) -> DataFrame:
    """The documents without residue; null and empty texts stay."""
    return documents.join(find_residue(documents, id_col, text).select(id_col).distinct(), id_col, "left_anti")
