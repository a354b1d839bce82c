"""What a line of page text is by its own words; shared by the page operators (problems 2, 4 and 5)."""

from __future__ import annotations

import re
from functools import lru_cache

# Navigation labels in the four languages of the crawl, without case.
NAV_LABELS = frozenset(
    """home|start|news|blog|forum|forums|search|archive|archives|events|shop|store|press|contact|contact us|support|help|help centre|help center|faq|
    topics|team|careers|jobs|downloads|download|guides|about|about us|sign in|log in|login|register|account|my account|cart|sitemap|menu|services|products|
    startseite|neuigkeiten|aktuelles|suche|archiv|hilfe|kontakt|themen|anmelden|anleitungen|presse|über uns|termine|karriere|laden|veranstaltungen|
    accueil|actualités|rechercher|recherche|aide|thèmes|connexion|à propos|boutique|équipe|évènements|carrières|téléchargements|
    inicio|noticias|buscar|archivo|ayuda|contacto|temas|entrar|guías|prensa|quiénes somos|tienda|equipo|eventos|descargas|empleo|
    privacy|imprint|accessibility|terms|terms of use|impressum|datenschutz|agb|mentions légales|confidentialité|plan du site|aviso legal|privacidad|mapa del sitio""".replace("\n", "").replace("    ", "").split("|")
)
_MAX_LABEL_WORDS = max(len(x.split()) for x in NAV_LABELS)
_SEPARATORS = re.compile(r"\s*[|/·»>•›–]\s*|\s{2,}|\s-\s")

_CUES = [
    (
        "cookie",
        r"\bcookies?\b.{0,80}(\bok\b|accept|manage|preferences|policy|settings|sets|uses?\b|utilis|usamos|verwendet|einverstanden|paramétrer|configurar)|\btrackers\b"
        r"|(store small files|speichert daten|conserve des données|guarda datos)|this site sets cookies|your privacy matters",
    ),
    (
        "share",
        r"^(share (this|on|via)\b|shared \d+|send this to|liked it\?|tweet\b.*\bpin\b|follow [^.]*$|folgen sie\b|artikel teilen|schon \d+ mal geteilt|partager\b|partagé \d+|suivez\b"
        r"|comparte\b|compartido \d+|sigue a\b|tell a friend|pass it on)",
    ),
    (
        "advert",
        r"^(advertisements?|sponsored( content)?|anzeige|werbung|publicidad|publicité)$|^subscribe\b|without adverts$|^you have \d+ free articles|log in to continue"
        r"|^get the .{1,40} (letter|newsletter)|newsletter\b.{0,60}(abonnieren|subscribe|sign up)|^suscríbete\b|^recevez la lettre|^abonnez-vous|^sign up (for|to)\b|^abonnieren",
    ),
    (
        "legal",
        r"^(©|\(c\)|copyright\b)|all rights reserved\.?$|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados|is not responsible for the content|haftet .{1,60} nicht\.$"
        r"|^für inhalte .{0,40} haftet|no responde del contenido|décline toute responsabilité|^reproduction of any part|without written consent|^all trademarks|prices may change without notice"
        r"|may be copied as long as|is free to reuse\.?$|^(impressum|mentions légales|aviso legal|terms of use|privacy policy)\b",
    ),
    ("contact", r"^questions\?\s|write to \S+@\S+|\bcall extension \d+|^(fragen|preguntas)\?\s|^des questions\s?\?\s|^(tel|phone|telefon|e-?mail|fax)\s?[:.]"),
    ("top", r"^(back to top|nach oben|volver arriba|haut de page|retour en haut|to the top|zum seitenanfang)$"),
]
# patterns that only fit at the start of a line aren't tried elsewhere
_CUES = [(k, re.compile(p, re.I).match if k in ("share", "top") else re.compile(p, re.I).search) for k, p in _CUES]
# Words without which a pattern can't match; most lines have none of them.
_HINT_WORDS = {
    "cookie": "cookie cookies trackers store speichert conserve guarda sets privacy",
    "share": "share shared send liked tweet follow folgen teilen mal partager partagé suivez comparte compartido sigue tell pass",
    "advert": "advertisement advertisements sponsored anzeige werbung publicidad publicité subscribe adverts free log get newsletter suscríbete recevez abonnez sign abonnieren",
    "legal": "c copyright rights rechte droits derechos responsible haftet responde décline reproduction consent trademarks prices copied reuse impressum mentions aviso terms privacy",
    "contact": "questions fragen preguntas write call tel phone telefon mail email fax",
    "top": "back nach volver haut retour top seitenanfang",
}
_HINTS: dict[str, frozenset] = {}
for _kind, _hint_words in _HINT_WORDS.items():
    for _w in _hint_words.split():
        _HINTS[_w] = _HINTS.get(_w, frozenset()) | {_kind}
_HINT_SET = frozenset(_HINTS)
_TOPICS = _HINT_SET - frozenset("c log get free pass tell call write mal back nach top terms questions consent retour haut".split())
_POINTS = frozenset("you related read most more in see meistgelesen mehr lesen das à sur les lo te más".split())
_BETWEEN = ",.;:!?()\"'-/|·»>•–—’“”„«…‹›¿¡©®→*+=#%&@[]{}<$^`~\\"
_SENTENCES = re.compile(r"(?<=[.!?;])\s+")
#: Characters from which a line is read sentence by sentence.
STATEMENT = 240
_POINTER = re.compile(
    r"^(you may also like|related (articles|stories|posts)|read (more|next|also)|most read|most popular|more from\b[^.!?]{0,40}|more on this|in this section|see also"
    r"|meistgelesen|mehr zum thema|lesen sie auch|das könnte sie auch interessieren|à lire aussi|les plus lus|sur le même thème|lo más leído|te puede interesar|más sobre el tema)\s*(:\s*(?P<rest>.+))?$",
    re.I,
)
_BYLINE = re.compile(
    r"^((words|text|texte|redacción|author|autor|auteur)\s?:|(by|posted by|written by|von|par|por|redaktion)\s+\w|(geschrieben|escrito|écrit)\b)|.*(\breports|\|\s*staff writer)$",
    re.I,
)
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december|januar|februar|märz|mai|juni|juli|oktober|dezember|janvier|février|mars|avril|juin|juillet|août|septembre|octobre|novembre|décembre|enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre"
_DATE = re.compile(rf"^(published|last updated|updated|stand|publié le|actualizado|publicado|veröffentlicht)\b[^.]{{0,40}}\d|^\d{{1,2}}\.?\s+(de\s+)?({MONTHS})\b|^({MONTHS})\s+\d{{1,2}}\b|^\d{{4}}-\d\d-\d\d\b|^le \d{{1,2}} ({MONTHS})", re.I)
_ENDS = frozenset(".!?…")
_LIST = re.compile(r"^([-–•*+]|\d{1,3}[.)])\s+\S")
_CODE = re.compile(r"[;{}]\s*$|^(let|const|var|def|fn|export|import|return|if|for|#include|\$)\b.*[=({]|\w+\.\w+\([^)]*\)|^\s*</?\w+|^\S+\s*=\s*\S+$")
_BREADCRUMB_SEP = re.compile(r"\s*[>›»]\s*")

#: Kinds that are never main text.
SURROUNDINGS = frozenset({"nav", "cookie", "share", "advert", "legal", "contact", "top", "pointer", "pointer_to"})


def ends_sentence(line: str) -> bool:
    return line.rstrip("\"'»”)]")[-1:] in _ENDS


@lru_cache(maxsize=8)
def words_of(line: str) -> list[str]:
    """Words of a line in lower case, without punctuation; several readers of one line share them."""
    low = line.lower()
    for mark in _BETWEEN:
        if mark in low:
            low = low.replace(mark, " ")
    return low.split()


def clean(line: str) -> str:
    return " ".join(line.split())


def _covered(words: list[str]) -> bool:
    """Whether a row of words is made of navigation labels only."""
    i = 0
    while i < len(words):
        for n in range(min(_MAX_LABEL_WORDS, len(words) - i), 0, -1):
            if " ".join(words[i : i + n]) in NAV_LABELS:
                i += n
                break
        else:
            return False
    return True


def navigation(line: str) -> bool:
    """A label, a row of labels, or a breadcrumb."""
    if line[-1:] in ".!?":
        return False
    low = line.lower()
    while low[:1] in "*-•·»>|" and low[1:2] == " ":
        low = low[2:].lstrip()
    if low in NAV_LABELS:
        return True
    parts = [p for p in _SEPARATORS.split(low) if p]
    if len(parts) > 1:
        hits = sum(p in NAV_LABELS for p in parts)
        if hits >= 2 and hits >= 0.6 * len(parts):
            return True
        crumbs = [p for p in _BREADCRUMB_SEP.split(low) if p]
        if len(crumbs) > 1 and hits and len(max(crumbs, key=len).split()) <= 3:
            return True
    words = low.split()
    return len(words) > 1 and _covered(words)


def cue(line: str, words: list[str]) -> str | None:
    """Surroundings named by the words of a line that is one statement."""
    known = _HINT_SET.intersection(words)
    if known or "©" in line:
        possible = frozenset().union(*(_HINTS[w] for w in known), ("legal",) if "©" in line else ())
        for name, pattern in _CUES:
            if name in possible and pattern(line):
                return name
    m = _POINTER.match(line) if words and words[0] in _POINTS else None
    return ("pointer_to" if m["rest"] else "pointer") if m else None


def _spoken(line: str) -> str | None:
    """:func:`cue` of a line of several sentences, however long: half of its words have to be in sentences of one kind, a third when it starts with them."""
    shares: dict[str, int] = {}
    sentences = _SENTENCES.split(line)
    cues = [cue(x, words_of(x)) for x in sentences]
    for sentence, name in zip(sentences, cues):
        if name:
            shares[name] = shares.get(name, 0) + sentence.count(" ") + 1
    best = max(shares, key=shares.get, default=None)
    return best if best and (3 if cues[0] == best else 2) * shares[best] >= line.count(" ") + 1 else None


def kind(line: str) -> str:
    """Kind of a cleaned, non-empty line by its own words."""
    long, words = len(line) > STATEMENT, words_of(line)
    name = cue(line, words) if not long else _spoken(line) if "©" in line or not _TOPICS.isdisjoint(words) else None
    if name:
        return name
    if navigation(line):
        return "nav"
    if len(line) <= 90:
        if _BYLINE.match(line) and not ends_sentence(line):
            return "byline"
        if _DATE.match(line):
            return "date"
    if ends_sentence(line) and (len(line) > 60 or line.count(" ") >= 3):
        return "sentence"
    if _LIST.match(line):
        return "list"
    if _CODE.search(line):
        return "code"
    return "sentence" if ends_sentence(line) else "short"


class Kinds:
    """:func:`kind` with a bounded memory, as most lines that need the patterns recur."""

    def __init__(self, most: int = 50_000):
        self.seen: dict[str, str] = {}
        self.most = most

    def __call__(self, line: str) -> str:
        if len(line) > STATEMENT:
            return kind(line)
        k = self.seen.get(line)
        if k is None:
            if len(self.seen) >= self.most:
                self.seen.clear()
            k = self.seen[line] = kind(line)
        return k
