"""Problem 10: personal information inside free text.

Method: offset-preserving deobfuscation. A chain of small transducers rewrites the text (full-width
and look-alike characters, zero-width characters, spelled digits, ``at``/``dot`` disguises) and keeps,
for every normalised character, the place of its source character. Identifiers are detected in the
normalised text and their spans mapped back, so that the rest of the text stays as it was.

One pass without a shuffle; a text is handled whole, whatever its length, and only its spans leave
the Python worker.

Defined results: null and blank texts have no spans and stay as they are. Overlapping spans are
resolved in favour of the earlier and then the longer one, types in the order e-mail, id number,
phone, address, name. Spans never include surrounding white space.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

SPANS = T.ArrayType(T.StructType([T.StructField("pii_type", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))

# Letters of other scripts that look like Latin ones.
LOOKALIKE = dict(zip("аеорсухіѕјԁԛԝһАВЕКМНОРСТУХІЅЈαορνΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxisjdqwhABEKMHOPCTYXISJaopvABEZHIKMNOPTYX"))
# Digit words of the corpus' languages.
DIGIT_WORDS = {
    w: str(d)
    for words in (
        "zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve",
        "zero um dois três quatro cinco seis sete oito nove",
    )
    for d, w in enumerate(words.split())
}
DIGIT_WORDS["oh"] = "0"
_word = "(?:" + "|".join(sorted(map(re.escape, DIGIT_WORDS), key=len, reverse=True)) + ")"
_SPELLED = re.compile(rf"(?i)\b{_word}(?:[ \-]+{_word}){{3,}}\b")
_SPELLED_HINT = re.compile(rf"[ \-]{_word}[ \-]+{_word}[ \-]")  # two digit words in a row
_AT = re.compile(r"(?i)(?<=[\w+\-])\s*[\[({<]\s*(?:at|arroba|ät|chez|@)\s*[\])}>]\s*(?=\w)")
_DOT = re.compile(r"(?i)(?<=\w)\s*[\[({<]\s*(?:dot|punto|punkt|point|ponto)\s*[\])}>]\s*(?=\w)")
_D = r"(?:dot|punto|punkt|point|ponto)"
_AT_WORDS = re.compile(rf"(?i)(?<![\w.+\-])([\w.+\-]+(?:\s+{_D}\s+[\w.+\-]+)*)\s+(?:at|arroba|ät|chez)\s+((?:[\w\-]+)(?:\s+{_D}\s+[\w\-]+|\.[\w\-]+(?=[\w.\-]*\s+{_D}\b))+)(?!\w)")
_DOT_WORD = re.compile(r"(?i)\s+(?:dot|punto|punkt|point|ponto)\s+")


_DOTS = ("dot", "punto", "punkt", "point", "ponto")
_AT_HINTS = tuple(w + g + c for w in ("at", "arroba", "ät", "chez", "@") for g in ("", " ") for c in ")]}>")
_DOT_HINTS = tuple(w + g + c for w in _DOTS for g in ("", " ") for c in ")]}>")
SPACES = "\u00a0\u2002\u2003\u2007\u2009\u202f\u3000"


class Mapped:
    """A text with the source place of each of its characters; ``at`` is None while both agree."""

    def __init__(self, text: str):
        self.text, self.at, self.source = text, None, text

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace the sorted, disjoint ranges; a replacement's characters all point to the range's start."""
        if not edits:
            return
        at = self.at if self.at is not None else list(range(len(self.text)))
        out, where, last = [], [], 0
        for s, e, new in edits:
            out += [self.text[last:s], new]
            where += at[last:s]
            where += [at[s]] * len(new)
            last = e
        out.append(self.text[last:])
        where += at[last:]
        self.text, self.at = "".join(out), where

    def span(self, s: int, e: int) -> tuple[int, int]:
        if self.at is None:
            return s, e
        stop = self.at[e] if e < len(self.at) else len(self.source)
        return self.at[s], max(stop, self.at[e - 1] + 1)


@lru_cache(maxsize=1)
def _odd() -> frozenset[str]:
    """The characters that the first transducer rewrites: look-alikes, invisible, full-width and mathematical ones, spaces, hyphens."""
    unseen = {c for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.category(c) == "Cf"}
    return frozenset(unseen | set(LOOKALIKE) | set(SPACES) | {"\u2010", "\u2011"} | set(map(chr, range(0xFF01, 0xFF5F))) | set(map(chr, range(0x1D400, 0x1D800))))


def normalise(text: str) -> Mapped:
    m = Mapped(text)
    here = set() if text.isascii() else _odd().intersection(text)
    if here:
        edits = []
        for x in re.finditer(f"[{re.escape(''.join(sorted(here)))}]", text):
            i, c = x.start(), x.group()
            if c in LOOKALIKE:
                near = text[max(0, i - 1) : i] + text[i + 1 : i + 2]
                if any(y.isascii() and y.isalnum() for y in near):
                    edits.append((i, i + 1, LOOKALIKE[c]))
            elif unicodedata.category(c) == "Cf":
                edits.append((i, i + 1, ""))
            else:
                edits.append((i, i + 1, "-" if c in "\u2010\u2011" else " " if c in SPACES else unicodedata.normalize("NFKC", c)))
        m.rewrite(edits)
    # each disguise is looked for only where a word of it occurs
    low = m.text.lower()
    if _SPELLED_HINT.search(low):
        m.rewrite([(x.start(), x.end(), "".join(DIGIT_WORDS[w.lower()] for w in re.split(r"[ \-]+", x.group()))) for x in _SPELLED.finditer(m.text)])
    if any(k in low for k in _AT_HINTS):
        m.rewrite([(x.start(), x.end(), "@") for x in _AT.finditer(m.text)])
    if any(k in low for k in _DOT_HINTS):
        m.rewrite([(x.start(), x.end(), ".") for x in _DOT.finditer(m.text)])
    if any(f" {k} " in low for k in _DOTS):
        edits = []
        for x in _AT_WORDS.finditer(m.text):
            edits += [(d.start(), d.end(), ".") for d in _DOT_WORD.finditer(m.text, x.start(1), x.end(1))]
            edits.append((x.end(1), x.start(2), "@"))
            edits += [(x.start(2) + d.start(), x.start(2) + d.end(), ".") for d in _DOT_WORD.finditer(x.group(2))]
        m.rewrite(edits)
    return m


EMAIL = re.compile(r"(?<![\w.+\-@])[\w][\w.%+\-]*@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.(?!(?i:png|jpe?g|gif|svg|webp|csv|json|py)\b)[A-Za-z]{2,}(?![\w@])")

# What announces a person's number, and the forms such numbers have.
_ID_KEY = (
    r"(?:SSN|SIN|social security(?: (?:number|no\.?))?|national id(?:entity)?(?: (?:number|no\.?|card))?|identity card(?: (?:number|no\.?))?|ID card(?: (?:number|no\.?))?|passport(?: (?:number|no\.?))?"
    r"|NI number|NINO|national insurance(?: (?:number|no\.?))?|tax(?:payer)? id(?:entification)?(?: (?:number|no\.?))?|TIN|Steuer-?ID(?:entifikationsnummer)?|(?:steuerliche |Steueri|I)dentifikationsnummer|Steuernummer|IdNr\.?|Sozialversicherungsnummer|SV-Nummer|Rentenversicherungsnummer"
    r"|Personalausweis(?:-?(?:nummer|nr\.?))?|Ausweis(?:-?(?:nummer|nr\.?))?|Reisepass(?:-?(?:nummer|nr\.?))?|numéro de sécurité sociale|n[°º]\s?(?:de )?(?:SS|sécu(?:rité sociale)?)|NIR|carte d[’']identité|passeport"
    r"|DNI|NIE|NIF|documento de identidad|n[.úu]*m?(?:ero)?[.º]* de (?:la )?seguridad social|pasaporte|CPF|cartão de cidadão|passaporte)"
)
_ID_VALUE = r"[A-Z]{0,2}[ ]?\d(?:[ .\-/]?\d){5,16}(?:-?[A-Z](?![A-Za-z]))?"
IDS = [
    re.compile(rf"(?i:(?<![A-Za-z]){_ID_KEY})\s*(?i:no\.?|n[°º]|nr\.?|number|is|lautet|:|=|#|\s){{0,3}}\s*({_ID_VALUE}|[A-Z]{{1,3}}\d{{5,9}}[A-Z0-9]*)"),
    re.compile(r"(?<!\d )(?<![\w.,/\-])((?!000|666|9\d\d)\d{3}[ \-]\d{2}[ \-]\d{4})(?![\w/]|[\-.,]\d| \d)"),
    re.compile(r"(?<!\d )(?<![\w\-])([A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D])(?!\w)"),
    re.compile(r"(?<!\d )(?<![\w.,\-])(\d{2}\.?\d{3}\.?\d{3}-?[TRWAGMYFPDXBNJZSQVHLCKE])(?!\w)"),
    re.compile(r"(?<!\d )(?<![\w.,\-])([12] ?\d{2} ?(?:0[1-9]|1[0-2]|[2-9]\d) ?\d{2} ?\d{3} ?\d{3} ?\d{2})(?![\w]| ?\d)"),
    re.compile(r"(?<!\d )(?<![\w.,\-])([XYZ]-?\d{7}-?[A-Z])(?!\w)"),
]

# Words before a number of goods or versions, which is no phone and no identity number.
_GOODS = re.compile(r"(?i)(?<!\w)(?:order|item|batch|invoice|lot|lote|charge|auftrag|rechnung|facture|commande|factura|pedido|bestellung|artikel|article|artículo|sku|part|serial|checksum|build|version|ticket|case|row|window|runs|to|version|release|catalogue|katalog|encomenda|fatura|nota|isbn|ref)(?:\s+(?:no\.?|number|nr\.?|n[.°º]+|num\.?|id))?\s*[:#]?\s*$")
PHONES = [
    re.compile(r"(?<!\d )(?<![\w.,/\-+])\(?\+\s?\d{1,3}\)?(?:[ .\-/]?\(?\d{1,5}\)?){2,6}(?:\s*(?i:ext\.?|x|durchwahl|poste)\s*\d{1,5})?(?![\w/]|[.\-,]\d)"),
    re.compile(r"(?<!\d )(?<![\w.,/\-])00\d{2}[ .\-/]?\d{1,3}(?:[ .\-/]?\d{2,4}){2,5}(?![\w/]|[.\-,]\d)"),
    re.compile(r"(?<!\d )(?<![\w.,/\-])(?:1[ .\-]?)?\(?[2-9]\d{2}\)?[ .\-]?[2-9]\d{2}[ .\-]\d{4}(?:\s*(?i:ext\.?|x)\s*\d{1,5})?(?![\w/]|[.\-,]\d| \d)"),
    re.compile(r"(?<!\d )(?<![\w.,/\-])1?[2-9]\d{2}555\d{4}(?![\w/]|[.\-,]\d)"),
    re.compile(r"(?<!\d )(?<![\w.,/\-])555[ .\-]\d{4}(?:\s*(?i:ext\.?|x)\s*\d{1,5})?(?![\w/]|[.\-,]\d| \d)"),
    re.compile(r"(?<!\d )(?<![\w.,/\-])555[ .\-]?\d{3}[ .\-]?\d{3}(?![\w/]|[.\-,]\d| \d)"),
    re.compile(r"(?<!\d )(?<![\w.,/\-])\(?0\d{2,4}\)?[ /\-]\d{3,8}(?:[ \-]\d{2,5}){0,2}(?![\w/]|[.\-,]\d| \d)"),
    re.compile(r"(?<!\d )(?<![\w.,/\-])0[1-9](?:[ .\-]?\d{2}){4}(?![\w/]|[.\-,]\d| \d)"),
    re.compile(r"(?<!\d )(?<![\w.,/\-])[6-9]\d{2}[ ]\d{3}[ ]\d{3}(?![\w/]|[.\-,]\d| \d)"),
    re.compile(r"(?i:(?<![a-zé])(?:tel|tél|phone|fax|mobile|cell|call|text|ring|telefon|teléfono|téléphone|handy|mobil|móvil|whatsapp|callback number|llame al|joignable au)\b)\.?\s*(?i:no\.?|number|nr\.?)?\s*[:.]?\s*(\(?\+?\d(?:[ .\-/()]{0,2}\d){6,14})(?![\w/]|[.\-,]\d)"),
]
# What must occur near a number for a pattern to be tried (in lower case); the other patterns are tried at every run.
_ID_STEMS = ("ssn", "sin", "social", "sociale", "national", "identi", "card", "pass", "pasap", "ni number", "nino", "tax", "tin", "steuer", "idnr", "versicherung", "sv-", "ausweis", "sécu", "ss", "nir", "dni", "nie", "nif", "documento", "seguridad", "cpf", "cidadão")
_PHONE_NEEDS = {0: "+", 1: "00", 3: "555", 4: "555", 5: "555", 6: "0", 7: "0"}
_CALL_STEMS = ("tel", "tél", "phone", "fax", "mobil", "cell", "call", "text", "ring", "handy", "móvil", "whatsapp", "llame", "joignable", "téléphone")
_RUN = re.compile(r"\d(?:[^\d]{0,3}\d){5,}")
_PLAIN_DATE = re.compile(r"\d{4}-\d{2}-\d{2}|\d{2}[./-]\d{2}[./-]\d{4}")
_DATE = re.compile(r"\d{4}-\d{2}-\d{2}$|\d{2}[./-]\d{2}[./-]\d{4}$|(?:\d{1,3}\.){3}\d{1,3}$")

_C = r"[A-ZÀ-ÖØ-Þ]"
_W = rf"{_C}[\wÀ-ÿ’'\-]+"
ADDRESSES = [
    re.compile(rf"(?<![\w,.\-])\d{{1,5}}[A-Za-z]?,? (?:(?:North|South|East|West|[NSEW]\.?) )?(?:{_W} ){{1,3}}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Court|Ct|Way|Boulevard|Blvd|Place|Pl|Terrace|Close|Crescent|Square|Sq|Parkway|Pkwy|Row|Mews)\b\.?(?:(?:,| )? ?(?:Apt|Unit|Suite|Ste|Flat|No)\.? ?#?\d+[A-Za-z]?| #\d+[A-Za-z]?)?(?:(?:, |\n){_W}(?: (?!(?:{_C}[\wÀ-ÿ]*)? ?(?:The|Between|After|When|What|Even|Both|Only)\b){_W})?)?(?:,? \d{{5}}(?:-\d{{4}})?)?"),
    re.compile(rf"(?i:(?<!\w)P\.? ?O\.? ?Box|(?<!\w)Post(?:al)? Box|(?<!\w)Postfach|(?<!\w)Apartado(?: de Correos)?|(?<!\w)Boîte postale|(?<!\w)BP|(?<!\w)Caixa Postal) (?:n[.°º]+ )?\d{{1,6}}(?: ?\d{{2,4}}(?!\d))?(?:, (?:\d{{4,5}} )?{_W}(?: {_W})?)?"),
    re.compile(rf"(?<!\w)(?:(?:Am|An der|Auf dem|Im|Zum|Zur|Alte[rn]?|Neue[rn]?|Obere|Untere) )?{_C}[a-zäöüß\-]*(?:straße|strasse|str\.|weg|allee|gasse|platz|ring|ufer|damm|steig|chaussee|markt|hof|pfad|stieg)(?: Nr\.?)? \d{{1,4}} ?[a-z]?(?![\w%])(?:, \d{{5}} {_W}(?: {_W})?)?"),
    re.compile(rf"(?<!\w)(?:Am|An der|Auf dem|Im|Zum|Zur|Unter den) {_C}[a-zäöüß]+ \d{{1,4}}[a-z]?, \d{{5}} {_W}(?: {_W})?"),
    re.compile(rf"(?<![\w,.\-])\d{{1,4}}(?: ?(?:bis|ter|quater|[a-dA-D]))?,? (?i:rue|avenue|av\.|boulevard|bd\.?|place|pl\.|chemin|allée|impasse|quai|cours|route|square|passage|villa) (?:(?:de la|de l[’']|du|des|de|d[’']|la|le|les|aux?) ?)?{_W}(?:[ \-](?:(?:de|des|du|la|sur|les) )?{_W}){{0,3}}(?:,? \d{{5}} {_W}(?:[ \-]{_W})*)?"),
    re.compile(rf"(?<!\w)(?:Calle|C/|C\.|Avenida|Avda?\.|Plaza|Pza\.|Paseo|Camino|Carrer|Ronda|Travesía|Rua|R\.|Praça|Travessa|Via|Viale|Piazza) ?(?:(?:de la|de las|de los|del|dos|das|da|do|de|la|el) )?{_W}(?: (?:(?:de|del|la|las|los) )?{_W}){{0,3}},? (?:n[.úu]*m?[.°º]* ?)?\d{{1,4}} ?[a-z]?(?![\w%])(?:, \d{{4,5}}(?:-\d{{3}})? {_W}(?: {_W})?)?"),
]

# What each of the address patterns can't do without, in lower case.
_STREETS = [
    tuple(f" {w}" for w in "street st avenue ave road rd lane ln drive dr court ct way boulevard blvd place pl terrace close crescent square sq parkway pkwy row mews".split()),
    ("box", "postfach", "apartado", "postale", "bp ", "postal"),
    ("straße ", "strasse ", "str. ", "weg ", "allee ", "gasse ", "platz ", "ring ", "ufer ", "damm ", "steig ", "chaussee ", "markt ", "hof ", "pfad ", "stieg "),
    ("am ", "an der ", "auf dem ", "im ", "zum ", "zur ", "unter den "),
    ("rue", "avenue", "av.", "boulevard", "bd", "place", "pl.", "chemin", "allée", "impasse", "quai", "cours", "route", "square", "passage", "villa"),
    ("calle", "c/", "c.", "avenida", "avda", "plaza", "pza", "paseo", "camino", "carrer", "ronda", "travesía", "rua", "r.", "praça", "travessa", "via", "piazza"),
]
# Common given names, in the languages of the corpus.
GIVEN = set(
    "Aaron Ada Adam Adele Adrian Agnes Ahmed Aisha Akira Alan Albert Alejandro Alex Alexander Ali Alice Alicia Alina Amanda Amélie Amelie Amina Amy Ana Anders Andrea Andreas Andrew Andrés Anita Anja Anna Anne Anton Antonio Arjun Arthur Astrid Barbara Beatriz Ben Benjamin Bernd Björn Brian Bruno Camille Carl Carla Carlos Carmen Caroline Catherine Cécile Charles Charlotte Chen Chloé Chloe Chris Christian Christine Claire Clara Claudia Daniel Daniela David Deborah Diana Diego Dieter Dmitri Eduardo Edward Elena Elias Elisa Elise Elizabeth Ella Ellen Emil Emily Emma Eric Erik Ernesto Esther Eva Evelyn Fatima Felix Fernando Fiona Florian Francesca Francisco Frank François Frida Gabriel Georg George Gerd Giulia Grace Greta Guillaume Gustav Hana Hanna Hannah Hans Harry Hassan Heike Heinz Helen Helena Helga Henri Henrik Henry Hugo Ian Ibrahim Ida Ines Inés Inga Ingrid Irene Iris Isaac Isabel Ivan Jack Jacob Jacques James Jan Jana Jane Javier Jean Jennifer Jens Jessica Jin Joana João Joan Johan Johanna Johannes John Jonas Jonathan Jorge José Jose Joseph Juan Judith Julia Julian Julie Julien Jürgen Juergen Kai Karim Karin Karl Katarina Kate Katharina Katrin Kenji Kevin Klaus Kofi Lars Laura Laurent Lea Léa Lena Leo Leon Leonie Li Liam Lina Linda Lisa Lola Louis Louise Luca Lucas Lucia Lucía Lucy Luis Luisa Lukas Luke Magda Manon Manuel Marc Marcel Marco Marek Margaret Maria María Mariana Marie Marina Mario Mark Marlene Marta Martha Martin Martina Mary Mateo Mathieu Matteo Matthew Max Maya Mei Mia Michael Michel Miguel Mikhail Mina Mohamed Monica Monika Nadia Natalia Nathalie Nicolas Nicole Niko Nikolai Nils Nina Noah Noor Nora Olaf Olga Oliver Olivia Omar Oscar Otto Pablo Paola Patricia Paul Paula Paulo Pedro Peter Petra Philip Philippe Pia Pierre Priya Rafael Rahul Raj Ralf Raquel Raúl Rebecca Renate René Ricardo Richard Rita Robert Roberto Rosa Ruth Ryan Sabine Samir Samuel Sandra Sara Sarah Sebastian Selma Sergio Silvia Simon Sofia Sofía Sophia Sophie Stefan Stella Stephen Susan Susanne Sven Sylvie Tamara Tanja Tara Tatjana Teresa Tessa Theo Thomas Tim Tobias Tom Tomas Tomás Uwe Valentina Vera Victor Victoria Viktor Vincent Walter Wei Werner William Wolfgang Xavier Yara Yasmin Yuki Yusuf Yves Zoe Zoé Zoë".split()
)
# Capitalised words that follow a name-like word in names of teams, products and places.
NOT_SURNAME = set(
    "Team Project Group Desk Squad Crew Pool Operations Analytics Platform Quartz Index Loader Report Release Server Engine Model Dataset Suite Board Office Street Road Lane Avenue Drive Court Bridge River Lake Valley Park Bay Cluster Pipeline Studio Systems Labs Lab Foundation Institute University Hospital Award Prize Day Week Edition Protocol Standard Framework Version Data Steward Stewards Quality Review Audit Score".split()
)
_T = r"(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Sir|Herr|Herrn|Frau|M|MM|Mme|Mlle|Monsieur|Madame|Sr|Sra|Srta|Señor|Señora|Don|Doña|D|D\.ª|Dª|Dña|Dott|Signor|Signora)"
_SUR = r"[A-ZÀ-ÖØ-Þ](?:[a-zà-öø-ÿ’']*[a-zà-öø-ÿ]{2,}(?:[\-’'][A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]+)?|[A-ZÀ-ÖØ-Þ'’\-]{3,})"
TITLED = re.compile(rf"(?<![\w.]){_T}\.? (?:{_T}\.? )?(?:{_C}\. )?({_SUR})(?: ({_SUR}))?(?!\w)")
FULL = re.compile(rf"(?<![\w@.])(?=({_C}[\wÀ-ÿ]+(?:-{_C}[\wÀ-ÿ]+)?) (?:{_C}\. ?|(?:van|von|de|der|da|dos|del|di|la|le) )*({_SUR})(?![\w@]))")  # looks ahead, so that matches may overlap
LASTFIRST = re.compile(rf"(?<![\w@.])(?=({_SUR}), ({_C}[\wÀ-ÿ]+)((?: {_C}\.)?)(?![\w@]))")
INITIAL = re.compile(rf"(?<![\w.@])(?:{_C}\. ?){{1,2}}({_SUR})(?![\w@.]?\w)")
# Words after an initial and a full stop that begin a sentence.
_STARTERS = set("The This That These Those There When While Where Without With Within What Every Each Some Many Most Half Both Only Once Rows Read Seen Nobody Group Column Columns Missing Values Value Units Older Rare Please About After Before Between According Even Oddly Scores Three Model Data Project Questions Mail Send Call Text Found Caller Proof Labels From Order Batch Catalogue Version Checksum Room Tuesday Monday Friday Street Join Build Box Contact Owner Harbor Team Meridian Lantern".split())
# Words before a comma and a given name that are no surname.
GREETING = set("thanks thank regards best cheers sincerely cordially greetings hello hi hey dear saludos hola gracias estimado estimada atentamente cordialmente cordialement bonjour salut merci amitiés grüße gruß grüßen hallo danke liebe lieber atenciosamente obrigado obrigada olá however therefore also then yes no well so today finally meanwhile otherwise instead still please maybe perhaps sure okay and or but con avec mit with".split())
# What announces a person, so that two capitalised words after it are a name whether known or not.
CUED = re.compile(rf"(?<!\w)(?=[A-Za-z])(?i:contact|contacted|caller|(?:called|signed|written|reported|reviewed|approved|prepared|submitted|sent) by|attn|regards|thanks|dear|hello|hi|kontakt|contacto|gezeichnet|firmado por|signé|assinado por)[:,.]?\s+(?=({_C}[a-zà-ÿ’'\-]+) (?:{_C}\. ?)?({_SUR})(?![\w@]))")


_CUES = ("contact", "caller", " by", "attn", "regards", "thanks", "dear", "hello", "hi", "kontakt", "gezeichnet", "firmado", "signé", "assinado")


@lru_cache(maxsize=50_000)
def _bare(w: str) -> str:
    """A word without accents and case."""
    return "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c)).lower()


_GIVEN_BARE = {_bare(g) for g in GIVEN}
# Articles and openers that may follow a cue in capitals.
_OPENERS = set("the this that these those please all my our your der die das den dem als in im le la les el los las o os as un une una ein eine for on at we i it".split())


def _given(w: str) -> bool:
    """A known given name, with or without its accents, in capitals or not; double names by their parts."""
    return all(_bare(p) in _GIVEN_BARE for p in w.split("-"))


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """(type, start, stop) of every personal datum, in source characters."""
    if not text or not text.strip():
        return []
    m = normalise(text)
    t, found = m.text, []
    add = lambda kind, s, e: found.append((kind, s, e))
    if "@" in t:
        for x in EMAIL.finditer(t):
            add("email", x.start(), x.end())
    # numbers are looked for around runs of digits only; a run ends where four characters hold none
    low = t.lower()
    if len(low) != len(t):  # a few letters grow in lower case; places must agree
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in t)
    for run in _RUN.finditer(t):
        lo, hi = max(0, run.start() - 64), min(len(t), run.end() + 24)
        near = max(0, run.start() - 8)
        around = low[lo:hi]
        named = any(k in around for k in _ID_STEMS)
        if not named and _PLAIN_DATE.fullmatch(run.group()):
            continue
        called = any(k in around for k in _CALL_STEMS)
        for i, rx in enumerate(IDS):
            if i == 0 and not named:
                continue
            for x in rx.finditer(t, lo if i == 0 else near, hi):
                if i == 0 or not _GOODS.search(t, max(0, x.start(1) - 24), x.start(1)):
                    add("id_number", x.start(1), x.end(1))
        for i, rx in enumerate(PHONES):
            if (rx is PHONES[-1] and not called) or t.find(_PHONE_NEEDS.get(i, ""), near, hi) < 0:
                continue
            for x in rx.finditer(t, lo if rx is PHONES[-1] else near, hi):
                s, e = x.span(rx.groups)
                if sum(c.isdigit() for c in t[s:e]) >= 7 and not _DATE.match(t[s:e]) and not _GOODS.search(t, max(0, s - 24), s):
                    add("phone", s, e)
    for rx, hints in zip(ADDRESSES, _STREETS):
        if any(k in low for k in hints):
            for x in rx.finditer(t):
                add("address", x.start(), x.end())
    for x in TITLED.finditer(t):
        if x.group(1) not in NOT_SURNAME and x.group(1) not in _STARTERS:
            add("person_name", x.start(), x.end(2) if x.group(2) and x.group(1) in GIVEN else x.end(1))
    for x in FULL.finditer(t):
        if _given(x.group(1)) and x.group(2) not in NOT_SURNAME and x.group(2) not in _STARTERS:
            add("person_name", x.start(1), x.end(2))
    for x in CUED.finditer(t) if any(k in low for k in _CUES) else ():
        if not {x.group(1), x.group(2)} & (NOT_SURNAME | _STARTERS) and _bare(x.group(1)) not in _OPENERS:
            add("person_name", x.start(1), x.end(2))
    for x in LASTFIRST.finditer(t):
        if _given(x.group(2)) and not _given(x.group(1)) and x.group(1) not in NOT_SURNAME and x.group(1).lower() not in GREETING:
            add("person_name", x.start(1), x.end(3))
    for x in INITIAL.finditer(t):
        if x.group(1) not in _STARTERS and x.group(1) not in NOT_SURNAME:
            add("person_name", x.start(), x.end())
    order = {k: i for i, k in enumerate(("email", "id_number", "phone", "address", "person_name"))}
    found.sort(key=lambda f: (order[f[0]], f[1], -f[2]))
    taken: list[tuple[str, int, int]] = []
    starts: list[int] = []
    for kind, s, e in found:
        i = bisect_left(starts, s)
        if (i < len(taken) and taken[i][1] < e) or (i and taken[i - 1][2] > s):
            continue
        starts.insert(i, s)
        taken.insert(i, (kind, s, e))
    return [(k, *m.span(s, e)) for k, s, e in taken]


@F.pandas_udf(SPANS)
def find_spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: [{"pii_type": k, "start": s, "stop": e} for k, s, e in spans(t)])


@F.pandas_udf(T.StringType())
def redact(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def one(t: str | None) -> str | None:
        if not t:
            return t
        out, last = [], 0
        for k, s, e in spans(t):
            out += [t[last:s], f"[{k.upper()}]"]
            last = e
        return "".join(out) + t[last:]

    for texts in batches:
        yield texts.map(one)


def found(documents: DataFrame) -> DataFrame:
    """(doc_id, pii_type): one row per type a document holds."""
    kinds = F.array_distinct(F.transform(find_spans("text"), lambda s: s["pii_type"]))
    return documents.select("doc_id", F.explode(kinds).alias("pii_type"))


def redacted(documents: DataFrame) -> DataFrame:
    """(doc_id, text): the texts with typed placeholders."""
    return documents.select("doc_id", redact("text").alias("text"))
