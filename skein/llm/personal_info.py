"""Personal information in free text, found by bootstrapped contextual extraction and replaced by typed placeholders.

1. Candidates. One pass over the texts takes out everything that has the shape of a person's name or of an
   identity number, with the context it stands in: the two words before it and the two after it.
2. Bootstrapping. Seeds (common given names; numbers that carry their own label) score the contexts they stand
   in, the contexts score the other instances in them, and so on for ROUNDS rounds. The graph is a table of
   counts by (kind, context, instance); every round is two aggregations over it.
3. Extraction. A second pass marks e-mail addresses, phone numbers and street addresses by their shape, and
   names and numbers by shape together with what was learned: names whose given name or surname scored high,
   in any order and letter case, initials with known surnames or in trusted contexts, and numbers that carry a
   label or stand in a trusted context.
4. Redaction. Marked spans become [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS] or [PERSON]; all else is unchanged.

What was learned (trusted contexts and name parts) is broadcast to the second pass where it has at most MAX_LEXICON
entries. A larger lexicon stays a table: every text asks it by join for the name parts it holds, then for the
contexts those leave open, and is marked once by all the entries found, with the same result. Texts are read whole.

Defined results: null and empty texts hold nothing and stay as they are; repeated rows are each marked; spans
that overlap count as the longer one; other columns are kept untouched.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import materialize

KINDS = ("email", "phone", "id_number", "address", "person")
ROUNDS = 3
#: A context is trusted from this share of scored instances and this many different instances on.
TRUST, SUPPORT = 0.6, 3
#: A name part is known from this score on.
KNOWN = 0.6
#: Entries of what was learned that are broadcast; more stay a table that texts are joined with.
MAX_LEXICON = 1_000_000

# Seeds. Given names that are common in many countries.
SEED_NAMES = """
adam alexander ali amara amelia amir ana andrea andrei anna anneke antonio aisha beatriz bram carlos carmen
charlotte chen claire daniel david diego dmitri elena elias emily emma eva farah fatima felix francesca gabriel
george giulia greta hanna hans hassan heinrich helen henrik hugo ibrahim igor ines ingrid isabella ivan jack
james jan javier joan joaquin johan john jonas jose juan julia karl katrin kenji klaus lars laura lea leon
lena linda lucas lucia lucien luis maria marie marta martin mary matteo max mehmet michael miguel mina mohamed
nadia natalia nikolai nina noah nora olga oliver omar oscar pablo paul paulo pedro peter pierre priya rafael
renata richard robert rosa sara sarah simon simone sofia stefan susan svetlana thomas tobias tom victor viktor
wei william yuki yusuf zofia
""".split()

# Labels of identity numbers.
ID_LABELS = (
    r"SSN|social security (?:number|no\.?)|tax (?:id|number)|TIN|passport(?: number| no\.?)?|ID card(?: number| no\.?)?|identity card(?: number| no\.?)?"
    r"|DNI|NIE|NIF|CPF|Steuer-?ID|Steueridentifikationsnummer|Steuernummer|Personalausweis(?:nummer)?|Ausweisnummer|Reisepass(?:nummer)?"
    r"|NI number|NINO|national insurance (?:number|no\.?)|NHS (?:number|no\.?)|driver'?s licen[cs]e(?: number| no\.?)?|driving licen[cs]e(?: number| no\.?)?|Führerschein(?:nummer)?"
    r"|numéro de sécurité sociale|carte d'identité|passeport|permis de conduire|pasaporte|carné de conducir|número de seguridad social"
)
_ID_VALUE = r"(?=[A-Z \-]{0,4}\d|[A-Z]\d)[A-Z]{0,3}[ -]?\d[A-Z\d]*(?:[ -][A-Z\d]{1,6}){0,4}\b"

_TITLE = r"(?:(?:Dr|Mr|Mrs|Ms|Prof|Herr|Frau|Sr|Sra|Mme|M)\.? )?"
#: Digits that are part of versions, times, hosts, paths or longer numbers don't begin or end a number.
_NO_LEFT, _NO_RIGHT = r"(?<![\w.:/+#-])", r"(?![\w:/]|[.-]\d)"

EMAIL = re.compile(
    r"(?<![\w.+/-])[A-Za-z0-9][\w.+-]*(?:@|%40|\s?(?:\[at\]|\(at\)|\{at\})\s?)(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w-]|:[\w~/])"
    r"|(?<![\w.+/-])[A-Za-z0-9][\w.+-]*(?: at | \[at\] | \(at\) |@)[A-Za-z0-9-]+(?: (?:dot|\[dot\]|\(dot\)) [A-Za-z0-9-]+)+\b",
    re.I,
)
PHONE = re.compile(
    _NO_LEFT
    + r"(?:(?:\+?1[ .-])?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?: ?(?:ext|x)\.? ?\d{1,5})?"
    r"|\+\d{1,3}(?:[ .-]?\(?\d{1,5}\)?){2,6}"
    r"|\+\d{10,14}"
    r"|00\d{2}(?: \d{1,4}){3,6}"
    r"|0\d{4} \d{6}"
    r"|0\d{2,4}/\d{5,9}(?:-\d{1,4})?"
    r"|0\d(?: \d{2}){4}"
    r"|0\d{2,4} \d{3,4} \d{3,5})" + _NO_RIGHT
)
ID_LABELLED = re.compile(rf"(?<![\w-])(?:{ID_LABELS})(?: is|:| =|=)? ?({_ID_VALUE})", re.I)
#: Formats that hardly mean anything else.
ID_FORMAT = re.compile(_NO_LEFT + r"(?:\d{3}-\d{2}-\d{4}|[A-CEGHJ-PR-TW-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D])" + _NO_RIGHT)
ID_WEAK = re.compile(_NO_LEFT + r"(?=[A-Z]{0,3}\d[A-Z\d -]*\d[A-Z\d -]*\d[A-Z\d -]*\d[A-Z\d -]*\d[A-Z\d -]*\d)[A-Z]{0,3}[ -]?\d[A-Z\d]*(?:[ -][A-Z\d]{1,6}){0,4}" + _NO_RIGHT)

_CAP = r"[A-ZÄÖÜÉÈÁÍÓÚÑÇ][\w'’äöüßéèêáíóúñç-]*"
_TYPE = r"(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Close|Way|Terrace|Ter|Court|Ct|Square|Sq|Crescent|Place|Pl|Boulevard|Blvd|Row|Hill|Walk|Gardens|Grove|Parade|Highway|Hwy|Alley|Mews|Quay)\b\.?"
ADDRESS = re.compile(
    rf"(?:\b(?:Apt|Apartment|Unit|Suite|Flat)\.? \w{{1,5}}, ?)?(?<![\w./-])(?<!\d:)\d{{1,5}}[a-zA-Z]? (?:{_CAP} ){{1,3}}{_TYPE}(?:,?[ \n]{_CAP}(?:[ -]{_CAP})?(?: \d{{4,5}})?)?"
    rf"|\b(?:PO|P\.O\.|P\. O\.|P O) ?Box \d+(?:, {_CAP}(?:[ -]{_CAP})?(?: \d{{4,5}})?)?|\b(?:Postfach|Apartado(?: de correos)?|Boîte postale|B\.?P\.?) \d{{2,}}(?:, \d{{4,5}} {_CAP})?"
    rf"|\b(?:[A-ZÄÖÜ][\wäöüß-]*(?:straße|strasse|str\.|weg|allee|gasse|platz|ring|damm|ufer|hof|berg|markt|graben|rain)|(?:{_CAP} ){{1,2}}(?:Str\.|Straße|Strasse|Weg|Allee|Gasse|\w*gasse|Platz|\w*platz|Ring|Damm|Ufer)|(?:Am|An der|An den|Im|In der|Zum|Zur|Auf dem|Auf der|Unter den|Hinter der) {_CAP}) \d{{1,4}} ?[a-z]?,? \d{{4,5}} {_CAP}(?: {_CAP})?"
    rf"|\b(?:Calle|C/|Plaza|Avenida|Avda\.?|Camino|Paseo|Ronda|Travesía|Carrera|Cuesta) (?:(?:de|del|la|las|los|el) )*{_CAP}(?: (?:(?:de|del|la|las|los|el) )*{_CAP})*,? \d{{1,4}}(?:, \d{{1,2}}º(?: [A-Z])?)?(?:,? \d{{5}} {_CAP}(?:[ -]{_CAP})?)?"
    rf"|(?<![\w./-])(?<!\d:)\d{{1,4}}(?: (?:bis|ter|quater))?,? (?:rue|avenue|place|chemin|quai|allée|impasse|boulevard|cours|route|square|passage) (?:(?:de|des|du|la|le|les|aux|au|à|l'|d') ?)*{_CAP}(?:[ -]{_CAP})*(?:,? \d{{5}} {_CAP}(?:[ -]{_CAP})?)?"
)

#: Strings without which a text can't hold an address, a label or an e-mail address; looked for before the long patterns are tried.
ADDRESS_HINTS = (
    "Street", "St", "Ave", "Road", "Rd", "Lane", "Ln", "Drive", "Dr", "Close", "Way", "Ter", "Court", "Ct", "Sq", "Crescent", "Place", "Pl", "Boulevard", "Blvd", "Row", "Hill", "Walk", "Gardens", "Grove", "Parade", "Highway", "Hwy", "Alley", "Mews", "Quay",
    "Box", "Postfach", "Apartado", "Boîte", "BP", "B.P", "str", "Str", "weg", "Weg", "allee", "Allee", "gasse", "Gasse", "platz", "Platz", "ring ", "Ring", "damm", "Damm", "ufer", "Ufer", "hof ", "berg ", "markt ", "graben", "rain ",
    "Am ", "An de", "Im ", "In der ", "Zum ", "Zur ", "Auf de", "Unter den ", "Hinter der ", "Calle", "C/ ", "Plaza", "Avda", "Camino", "Paseo", "Ronda", "Travesía", "Carrera", "Cuesta",
    "rue ", "avenue ", "place ", "chemin ", "quai ", "allée ", "impasse ", "boulevard ", "cours ", "route ", "square ", "passage ",
)
ID_HINTS = ("ssn", "social security", "tax id", "tax number", "tin", "passport", "id card", "identity card", "dni", "nie", "nif", "cpf", "steuer", "ausweis", "reisepass", "ni number", "nino", "insurance", "nhs", "licen", "führerschein", "sécurité sociale", "identité", "passeport", "permis", "pasaporte", "carné", "seguridad social")
EMAIL_HINTS = ("@", "%40", "[at]", "(at)", "{at}")
_DIGITS = re.compile(r"\d[\d ().\-/]{6,}\d")

_W = r"[A-ZÄÖÜÉÁÍÓÚÑÇ](?:['’][A-Z])?[a-zäöüßéèêáíóúñç]+"
_U = r"[A-ZÄÖÜÉÁÍÓÚÑÇ]{2,}"
#: Shapes of cased names: given and surname, surname and given, initial and surname.
NAME = re.compile(
    rf"(?<![\w@.%+/-]){_TITLE}(?:(?P<g>{_W}) (?:[A-Z]\. )?(?P<s>{_W})(?:-(?P<s2>{_W}))?|(?P<ug>{_U}) (?:[A-Z]\. )?(?P<us>{_U})(?:-(?P<us2>{_U}))?"
    rf"|(?P<rs>{_W})(?:-(?P<rs2>{_W}))?, (?P<rg>{_W})(?: [A-Z]\.)?|(?P<i>[A-Z])\. (?P<is>{_W})(?:-(?P<is2>{_W}))?)(?![\w@%]|\.\w|[-+]\w)"
)
_LOWER = re.compile(r"(?<![\w@.%+/-])([a-zäöüßéèêáíóúñç]{2,}) (?:[a-z]\. )?([a-zäöüßéèêáíóúñç]{3,})(?:-([a-zäöüßéèêáíóúñç]{3,}))?(?![\w@%]|\.\w|[-+]\w)")
_LOWER_WORD = re.compile(r"[a-zäöüßéèêáíóúñç]{2,}")
_TOKEN = re.compile(r"\w+|[^\w\s]|\n")


def context(text: str, start: int, end: int) -> tuple[str, str]:
    """(left, right): the tokens before and after a span up to the first word, two at least and four at most.

    Digits are 0, line ends ⏎; to the right, capitalised words are Xx, as what follows a name is often a name.
    """
    left = _TOKEN.findall(text[max(0, start - 32) : start])
    right = _TOKEN.findall(text[end : end + 32])
    left = (left if start > 32 else ["\n", *left])[-4:]
    right = (right if end + 32 < len(text) else [*right, "\n"])[:4]
    n = next((i + 1 for i, t in enumerate(reversed(left)) if t[0].isalpha()), 2)
    m = next((i + 1 for i, t in enumerate(right) if t[0].isalpha()), 2)
    plain = lambda t: "0" if t[0].isdigit() else "⏎" if t == "\n" else t.lower()
    return "L " + " ".join(map(plain, left[-max(2, n) :])), "R " + " ".join("Xx" if t[0].isupper() else plain(t) for t in right[: max(2, m)])


def name_parts(m: re.Match) -> tuple[str, list[str]]:
    """(given name or '', surnames), in lower case."""
    given = m["g"] or m["ug"] or m["rg"] or ""
    return given.lower(), [x.lower() for x in (m["s"], m["s2"], m["us"], m["us2"], m["rs"], m["rs2"], m["is"], m["is2"]) if x]


def candidates(text: str) -> Iterator[tuple[str, str, str, bool]]:
    """(kind, context, instance, seed) of everything with the shape of a name or an identity number, outside addresses."""
    streets = [m.span() for m in ADDRESS.finditer(text)] if _hinted(ADDRESS_HINTS, text) else []
    for m in NAME.finditer(text):
        given, surnames = name_parts(m)
        if given and not any(a < m.end() and m.start() < b for a, b in streets):
            for c in context(text, m.start(), m.end()):
                yield "person", c, given, False
            for s in surnames:
                yield "surname", given, s, False
    labelled = [m.span(1) for m in ID_LABELLED.finditer(text)] if _hinted(ID_HINTS, _lowered(text)) else []
    labelled += [m.span() for m in ID_FORMAT.finditer(text)]
    for a, b in labelled:
        yield "id_number", context(text, a, b)[0], "seed", True
    for m in ID_WEAK.finditer(text):
        if not any(a < m.end() and m.start() < b for a, b in labelled):
            yield "id_number", context(text, m.start(), m.end())[0], m[0], False


def gather(texts: DataFrame) -> DataFrame:
    """(kind, context, instance, seed, n): the pattern-instance graph, counted. texts: a column text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: Counter = Counter()
            for t in b.column(0):
                text = t.as_py()
                if text:
                    counts.update(candidates(text))
            if counts:
                kind, ctx, inst, seed = zip(*counts)
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(ctx), pa.array(inst), pa.array(seed), pa.array(list(counts.values()), pa.int64())], ["kind", "context", "instance", "seed", "n"])

    return texts.select("text").mapInArrow(run, "kind string, context string, instance string, seed boolean, n bigint").groupBy("kind", "context", "instance", "seed").agg(F.sum("n").alias("n"))


def bootstrap(graph: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(contexts, parts): trusted contexts (kind, context) and known name parts (kind, part, score).

    A context's score is the mean score of the instances in it, an instance's score the mean over the contexts it
    stands in (1 for seeds); instances are counted once a context, so that one busy instance proves nothing.
    """
    spark = graph.sparkSession
    seeds = spark.createDataFrame([(n,) for n in SEED_NAMES], "instance string").withColumn("__seed", F.lit(1.0))
    # a context of nothing but line ends, digits and punctuation says nothing about what stands in it
    telling = F.col("context").rlike(r"^[LR] .*\p{L}{2}")
    edges = graph.where((F.col("kind") != "surname") & telling).join(F.broadcast(seeds), "instance", "left")
    seed = F.when(F.col("seed"), 1.0).when((F.col("kind") == "person") & F.col("__seed").isNotNull(), 1.0)
    edges = materialize(edges.select("kind", "context", "instance", "n", seed.alias("fixed")), "graph")
    scored = edges.withColumn("score", F.coalesce("fixed", F.lit(0.0)))
    for _ in range(rounds):
        # several occurrences of labelled numbers are several instances: they are only counted under one name
        many = F.when(F.col("instance") == "seed", F.least(F.col("n"), F.lit(SUPPORT))).otherwise(1)
        contexts = scored.groupBy("kind", "context").agg((F.sum(F.col("score") * many) / F.sum(many)).alias("trust"), F.sum(many).alias("support"))
        good = contexts.where(F.col("support") >= SUPPORT)
        rated = edges.join(good, ["kind", "context"], "left").groupBy("kind", "instance").agg(F.avg(F.coalesce("trust", F.lit(0.0))).alias("mean"), F.count_if(F.col("trust") >= TRUST).alias("good"), F.max("trust").alias("best"))
        # a name stands in many places that tell nothing; two trusted contexts make it a name
        value = rated.select("kind", "instance", F.when((F.col("kind") == "person") & (F.col("good") >= 2), F.col("best") * 0.9).otherwise(F.col("mean")).alias("__v"))
        scored = materialize(edges.join(value, ["kind", "instance"], "left").withColumn("score", F.coalesce("fixed", "__v", F.lit(0.0))).select("kind", "context", "instance", "n", "fixed", "score"), "scores")
    many = F.when(F.col("instance") == "seed", F.least(F.col("n"), F.lit(SUPPORT))).otherwise(1)
    trusted = scored.groupBy("kind", "context").agg((F.sum(F.col("score") * many) / F.sum(many)).alias("trust"), F.sum(many).alias("support")).where((F.col("trust") >= TRUST) & (F.col("support") >= SUPPORT)).select("kind", "context")
    given = scored.where(F.col("kind") == "person").groupBy("instance").agg(F.max("score").alias("score")).where(F.col("score") >= KNOWN).select(F.lit("given").alias("kind"), F.col("instance").alias("part"), "score")
    # a surname is known if most of the different given names before it are
    pairs = graph.where(F.col("kind") == "surname").select(F.col("context").alias("part"), F.col("instance").alias("surname")).distinct()
    surnames = pairs.join(given.select("part", "score"), "part", "left").groupBy("surname").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("score")).where(F.col("score") >= KNOWN)
    return trusted, given.unionByName(surnames.select(F.lit("surname").alias("kind"), F.col("surname").alias("part"), "score"))


class Marker:
    """Marks spans of one text by what was learned."""

    def __init__(self, contexts: set[tuple[str, str]], given: set[str], surnames: set[str]):
        self.contexts, self.given, self.surnames = contexts, given, surnames

    def trusted(self, kind: str, text: str, start: int, end: int) -> bool:
        left, right = context(text, start, end)
        return (kind, left) in self.contexts or (kind, right) in self.contexts

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """Non-overlapping (start, end, kind) in order; of overlapping ones the longer stays."""
        found: list[tuple[int, int, str]] = []
        low = _lowered(text)
        if _hinted(EMAIL_HINTS, low) or " at " in low and "dot" in low:
            for m in EMAIL.finditer(text):
                if not _version_like(m[0]):
                    found.append((*m.span(), "email"))
        if _hinted(ADDRESS_HINTS, text):
            for m in ADDRESS.finditer(text):
                found.append((*m.span(), "address"))
        if _hinted(ID_HINTS, low):
            for m in ID_LABELLED.finditer(text):
                if sum(c.isdigit() for c in m[1]) >= 5:
                    found.append((*m.span(1), "id_number"))
        for m in ID_FORMAT.finditer(text):
            found.append((*m.span(), "id_number"))
        if _DIGITS.search(text):
            for m in PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0].split("x")[0]) <= 15:
                    found.append((*m.span(), "phone"))
        for m in ID_WEAK.finditer(text):
            if self.trusted("id_number", text, *m.span()):
                found.append((*m.span(), "id_number"))
        for m in NAME.finditer(text):
            given, surnames = name_parts(m)
            if given in self.given or any(s in self.surnames for s in surnames) and (not given or self.trusted("person", text, *m.span())):
                found.append((*m.span(), "person"))
            elif not given and self.trusted("person", text, *m.span()):
                found.append((*m.span(), "person"))
        if not self.given.isdisjoint(_LOWER_WORD.findall(text)):
            for m in _LOWER_WORD.finditer(text):
                if m[0] in self.given and (n := _LOWER.match(text, m.start())) and (n[2] in self.surnames or self.trusted("person", text, *n.span())):
                    found.append((*n.span(), "person"))
        found.sort(key=lambda x: (x[0] - x[1], x[0]))
        kept: list[tuple[int, int, str]] = []
        for s in found:
            if not any(a < s[1] and s[0] < b for a, b, _ in kept):
                kept.append(s)
        return sorted(kept)


def _hinted(hints: tuple[str, ...], text: str) -> bool:
    return any(h in text for h in hints)


def _lowered(text: str) -> str:
    """The text in lower case, with the letters that patterns without case take for s, i or k as these."""
    return (text if text.isascii() else text.translate(_SAME)).lower()


_SAME = str.maketrans("ſıİK", "siik")


def _version_like(email: str) -> bool:
    """name@1.2.3 and repository remotes are no addresses."""
    host = re.split(r"@|%40", email)[-1]
    return host[:1].isdigit() or email.lower().startswith("git@")


class Lexicon:
    """What was learned as a table (kind, what) of distinct entries, for any number of them."""

    def __init__(self, entries: DataFrame):
        self.entries = entries

    def known(self, texts: DataFrame) -> DataFrame:
        """(__h, __known): the entries that texts (a column text) can ask for, by the text's hash.

        Texts that share a hash share entries; more entries than a text asks for change nothing.
        """
        texts = texts.where(F.col("text") != "").select(F.xxhash64("text").alias("__h"), "text")
        parts = materialize(self._held(texts.mapInArrow(_asking(_parts_asked), _ASKED)), "parts")
        rest = self._held(_with_known(texts, parts).mapInArrow(_asking(_rest_asked), _ASKED))
        return _together(parts.unionByName(rest))

    def _held(self, asked: DataFrame) -> DataFrame:
        return asked.distinct().join(self.entries, ["kind", "what"], "left_semi").select("__h", "kind", "what")


_ASKED = "__h bigint, kind string, what string"


def _together(found: DataFrame) -> DataFrame:
    return found.groupBy("__h").agg(F.collect_set(F.struct("kind", "what")).alias("__known"))


def _with_known(texts: DataFrame, found: DataFrame) -> DataFrame:
    return texts.join(_together(found), "__h", "left").select("__h", "text", "__known")


def _marker(entries: Iterable[dict] | None) -> Marker:
    """A marker of (kind, what)."""
    ctx, given, surnames = set(), set(), set()
    for e in entries if entries is not None else ():
        kind, what = e["kind"], e["what"]
        if kind == "given":
            given.add(what)
        elif kind == "surname":
            surnames.add(what)
        else:
            ctx.add((kind, what))
    return Marker(ctx, given, surnames)


def _parts_asked(text: str, marker: Marker) -> Iterator[tuple[str, str]]:
    """The name parts that Marker.spans may look up, but for surnames in lower case."""
    for m in NAME.finditer(text):
        given, surnames = name_parts(m)
        if given:
            yield "given", given
        for s in surnames:
            yield "surname", s
    for m in _LOWER_WORD.finditer(text):
        if _LOWER.match(text, m.start()):
            yield "given", m[0]


def _rest_asked(text: str, marker: Marker) -> Iterator[tuple[str, str]]:
    """What Marker.spans may look up besides, once the text's name parts are known."""
    for m in ID_WEAK.finditer(text):
        for c in context(text, *m.span()):
            yield "id_number", c
    for m in NAME.finditer(text):
        given, surnames = name_parts(m)
        if not given or given not in marker.given and any(s in marker.surnames for s in surnames):
            for c in context(text, *m.span()):
                yield "person", c
    for m in _LOWER_WORD.finditer(text):
        if m[0] in marker.given and (n := _LOWER.match(text, m.start())):
            yield "surname", n[2]
            for c in context(text, *n.span()):
                yield "person", c


def _asking(ask: Callable[[str, Marker], Iterator[tuple[str, str]]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(__h, text[, __known]) to what the texts ask for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(b.column(0)[i].as_py(), *x) for i, t in enumerate(b.column(1)) for x in set(ask(t.as_py(), _marker(b.column(2)[i].as_py() if b.num_columns > 2 else None)))]
            h, kind, what = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(kind, pa.string()), pa.array(what, pa.string())], ["__h", "kind", "what"])

    return run


def learn(texts: DataFrame, most: int = MAX_LEXICON) -> list[Marker] | Lexicon:
    """What all texts (column text) teach: one marker, or the lexicon as a table where it has more than `most` entries."""
    graph = materialize(gather(texts), "counts")
    contexts, parts = bootstrap(graph)
    entries = materialize(contexts.select("kind", F.col("context").alias("what")).unionByName(parts.select("kind", F.col("part").alias("what"))), "lexicon")
    if entries.limit(most + 1).count() > most:
        return Lexicon(entries)
    return [_marker(r.asDict() for r in entries.toLocalIterator(prefetchPartitions=True))]


def _marks(items: DataFrame, learned: list[Marker] | Lexicon, column: str) -> tuple[DataFrame, Callable]:
    """(items with a last column __known, marks): marks(text, known) are the spans of a text of this column."""
    if isinstance(learned, Lexicon):
        known = learned.known(items.select(F.col(column).alias("text")))
        keyed = items.withColumn("__h", F.when(F.col(column) != "", F.xxhash64(column)))
        return keyed.join(known, "__h", "left").select(*(F.col(f"`{c}`") for c in items.columns), "__known"), lambda text, known: _marker(known).spans(text)
    (marker,) = learned
    shared = items.sparkSession.sparkContext.broadcast(marker)
    return items.withColumn("__known", F.lit(None).cast("array<struct<kind:string,what:string>>")), lambda text, known: shared.value.spans(text)


def mentions(items: DataFrame, keys: list[str], learned: list[Marker] | Lexicon) -> DataFrame:
    """(keys, start, end, kind): the marked spans of items (keys, text), in code points."""
    schema = ", ".join(f"`{k}` {items.schema[k].dataType.simpleString()}" for k in keys)
    n = len(keys)
    ready, marks = _marks(items.select(*keys, "text").where(F.col("text") != ""), learned, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, start, end, kind = [], [], [], []
            for i, t in enumerate(b.column(n)):
                for s, e, k in marks(t.as_py(), b.column(n + 1)[i].as_py()):
                    at.append(i)
                    start.append(s)
                    end.append(e)
                    kind.append(k)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(j).take(take) for j in range(n)), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(kind, pa.string())], [*keys, "start", "end", "kind"])

    return ready.mapInArrow(run, f"{schema}, start int, end int, kind string")


def _cleaner(marks: Callable) -> Callable:
    """A function of a text column and what is known of it, to the redacted texts."""

    def clean(text: str, known: list[dict] | None) -> str:
        parts, at = [], 0
        for s, e, kind in marks(text, known):
            parts += [text[at:s], f"[{kind.upper()}]"]
            at = e
        return "".join([*parts, text[at:]])

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([t if not t else clean(t, k) for t, k in zip(texts, known)], dtype=object)

    return cleaned


def redact(items: DataFrame, learned: list[Marker] | Lexicon, columns: list[str]) -> DataFrame:
    """items with the given text columns redacted; all other columns are left as they are."""
    out = items
    for c in columns:
        out, marks = _marks(out, learned, c)
        out = out.withColumn(c, _cleaner(marks)(F.col(c), F.col("__known"))).drop("__known")
    return out
