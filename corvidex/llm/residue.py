"""Pages that were never filled in or never delivered.

A text is cut into segments (sentences and lines). A linear classifier over
hashed n-grams, length and title features gives each segment the probabilities
of being content, page frame, error or script notice, filler, or prose with
unfilled placeholders. A second linear classifier over what these sum up to in
a document (how much content there is beside its first segment, how much notice
and filler) says whether the document is anything else than residue. A text is
also residue if a segment of its own prose holds a placeholder.

Both are trained here. Weak labels of a bounded sample of the table come from
response statuses and the phrases that go with them, the syntax of template
languages, and what the rest of a document says (an error message among
sentences that no rule knows is talk about an error); each labelled notice is
also shown with those phrases masked, so that the words around them must count.
Seed examples (``seed_documents``), the same for every table, are trained on
with it, so that a small or unlike table does not change what is known of
notices. Hosts are split into seen and unseen ones, and the report is made on
the unseen.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from http import HTTPStatus

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvidex.llm.features import Softmax, hash_sample, train_softmax
from corvidex.llm.tokens import text_slices
from corvidex.session import ship

CONTENT, FRAME, NOTICE, FILLER, UNFILLED = range(5)
#: Long and short documents the classifier is fitted on, about, and segments of plain content in longer documents; fewer are all used.
TRAIN_DOCS, TRAIN_SHORT, TRAIN_CONTENT = 1200, 5000, 8000
#: Characters below which a segment is a remark and no sentence.
REMARK = 55
#: Characters beyond which a sentence with placeholders is cut around them.
AROUND = 90
#: Characters below which a document counts as short when rows are chosen for fitting.
SHORT = 600
#: Weight of a segment that is repeated in the sample, at most.
MOST_WEIGHT = 6.0
#: Share of hosts kept out of training, in eighths.
UNSEEN_EIGHTHS = 1
#: Weight of a seed example.
SEED_WEIGHT = 2.0

# The syntax of unfilled template fields and of unset values.
# Fields whose two ends can't be mistaken may be of any length within a line; their classes keep a scan linear.
PLACEHOLDER = re.compile(
    r"\{\{[^{}\n]*\}\}|\$\{[^{}\n]+\}|#\{[^{}\n]+\}|\{%[^{}\n]+%\}|<%=?[^<>\n]+%>|%%[^\s%][^%\n]{0,60}%%|<<[^<>\n]{1,60}>>"
    r"|\[\[\+?[^\[\]\n]+\]\]|\*\|[^|\n]{1,60}\|\*|@@[^@\n]{1,60}@@|\b__\w{1,60}?__\b|\?\?\?\w[^?\n]{0,60}\?\?\?|\{[^\W\d][^{}\n;=]{0,60}\}|\{\d\}|\[[^\W\d][^\[\]\n;=]{1,60}\]"
    r"|%[sd]\b|\(null\)|\bundefined\b|\bNaN\b|\bNone\b|\[object Object\]"
)
_MAYBE = re.compile(r"[{%\[*@?#]|<<|<%|__|\(null\)|undefined|NaN|None").search
# Rules: marks of program text, in which placeholders are at home.
_CODE = re.compile(r"[;{]\s*$|^\s*[}<]|\w\s*=\s*[\w\"'\[({]|\w\(\"|^\s*(?:def|return|for|if|while|public|SELECT|FROM|WHERE|GROUP BY|echo|print\w*)\b|</\w+>|->|::")
_QUOTED = re.compile(r"`[^`\n]*`|\"[^\"\n]*\"|“[^”\n]*”|«[^»\n]*»|„[^“\n]*“|'[^'\n]{0,3}[{%$<\[][^'\n]*'")
# Rules: phrases around template fields of notices, in four languages.
_FIELD_FRAME = re.compile(
    r"^(?:dear|hello|hi|hallo|bonjour|hola)\b.*,|^(?:welcome to|willkommen bei|bienvenue sur|bienvenid[oa] a)\b|^(?:posted|written|created) by|^(?:erstellt|verfasst) von|^publié par|^publicado por"
    r"|^to reach us|^short description|^(?:description|beschreibung|descripción) ?:|\basked\b.*\babout\b|was answered by|wurde von\b.*\bbeantwortet|a reçu une réponse de|fue respondida por"
)
# Rules: what error, denial, maintenance and script notices say, in four languages.
_NOTICE = re.compile(
    r"\b[45]\d\d\b.{0,12}\b(?:not found|forbidden|bad gateway|internal|service|unauthorized|gone|gateway|error)|\b(?:error|fehler|erreur|http)\W{0,3}[45]\d\d\b"
    r"|enable javascript|aktivieren sie javascript|activer javascript|active javascript|javascript is (?:disabled|required|off)|(?:requires|needs?|support|braucht|besoin de|necesita) (?:java)?s[ck]ripts?\b|braucht skripte|scripts must be allowed"
    r"|(?:page|question|content) (?:you asked for )?(?:was|could) not (?:be )?(?:found|loaded)|could not find that page|(?:page|content|question) (?:does not exist|has been removed|is not available)|nothing lives at this address"
    r"|access denied|permission to open|not allowed to see|zugriff verweigert|accès refusé|acceso denegado|session has expired|too many requests"
    r"|temporarily unavailable|over capacity|down for maintenance|gateway time-?out|bad gateway|connection to \S+ was reset|application failed to start|unexpected condition|something went wrong|request could not be completed|database connection|uncaught|exception in thread|mysql_connect\(|internal server error"
    r"|nicht gefunden|nicht erreichbar|gibt es nicht mehr|nicht geladen werden|interner (?:server)?fehler|überlastet|introuvable|n'existe plus|n'a pas pu être|momentanément indisponible|erreur interne|surchargés|ya no existe|no se (?:encontró|pudo)|no está disponible|error interno|están saturados|checking your browser|^(?:please )?(?:reload the page|try again|go back|come back later|slow down|log in again)|return to the start page|contact the administrator|noch einmal versuchen|später wieder|zurück zur startseite|^réessayez|^revenez plus|retour(?:nez)? à l'accueil|^vuelva más|^inténtelo|ir a la página de inicio"
)
# Rules: pseudo-Latin, keyboard mash and dummy sentences.
_LATIN = frozenset("lorem ipsum dolor sit amet consectetur adipiscing elit sed tempor vitae velit felis quam orci nulla massa magna justo eros urna libero arcu morbi nisi porta mattis sodales cursus viverra pulvinar tellus integer".split())
_MASH = re.compile(r"\b(?:asdf|qwer|hjkl|jkl|sdfg|blah|foo bar|xxx+)")
_DUMMY = re.compile(
    r"\byour text goes here|type something here|content coming soon|sample text|\bis a dummy\b|placeholder for layout|heading example|^test test test|blindtext|platzhalter für das|inhalt folgt|hier steht ihr text|texte (?:d'exemple|fictif)|votre texte ici|contenu à venir"
    r"|texto de (?:muestra|ejemplo|relleno)|su texto va aquí|contenido próximamente|prueba prueba"
)
# Rules: lines of a page's frame.
_FRAME = re.compile(
    r"^©|all rights reserved|tous droits réservés|alle rechte|todos los derechos|^(?:back to top|nach oben|haut de page|volver arriba)|terms of use|impressum|mentions légales|aviso legal|powered by|läuft mit|propulsé par|funciona con"
    r"|mobile view|site design and logo|share licence|unter der lizenz|sous la licence|\blicencia\b"
)
_SEPARATED = re.compile(r"(?:[^|·»/]{2,24}\s[|·»/-]\s){3,}|(?:\S{3,14}(?: \S{3,12})?  +){3,}")
_LINES = re.compile(r"[\r\n  ]+").split
_DIGITS = re.compile(r"\d+").sub
_SENTENCES = re.compile(r"(?<=[.!?])\s+").split


def segments(text: str | None) -> list[str]:
    """The non-blank sentences of the lines of ``text``.

    A long sentence with placeholders is cut around them, so that what was joined
    to a notice without a full stop is looked at by itself.
    """
    out = [s for line in _LINES(text or "") for s in _SENTENCES(line.strip()) if s]
    if not _MAYBE(text or ""):
        return out
    cut = []
    for s in out:
        found = [m.span() for m in PLACEHOLDER.finditer(s)] if len(s) > AROUND and _MAYBE(s) else []
        if found:
            a, b = s.rfind(" ", 0, max(0, found[0][0] - AROUND // 2)) + 1, s.find(" ", found[-1][1] + AROUND // 4)
            b = len(s) if b < 0 else b
            cut += [x for x in (s[:a].strip(), s[a:b].strip(), s[b:].strip()) if x]
        else:
            cut.append(s)
    return cut


def placeholders(segment: str) -> int:
    """Placeholders in the segment's own prose: not in program text and not in quotes."""
    if not _MAYBE(segment) or not PLACEHOLDER.search(segment):
        return 0
    bare = PLACEHOLDER.sub(" \x00 ", _QUOTED.sub(" ", segment))
    return 0 if _CODE.search(bare) else bare.count("\x00")


def shown(segment: str) -> str:
    """The segment as the classifier sees it: fields of any syntax alike, quoted ones told apart."""
    if _MAYBE(segment):
        segment = _QUOTED.sub(lambda m: " quotedfield " if PLACEHOLDER.search(m[0]) else m[0], segment)
        segment = PLACEHOLDER.sub(" unfilledfield ", segment)
    return segment


def phrase_label(segment: str) -> int | None:
    """What the rules say of a segment by itself; None where they say nothing."""
    low = segment.lower()
    if placeholders(segment) and (_FIELD_FRAME.search(low) or re.search(r"[{%<\[*@_#?$(]", "".join(PLACEHOLDER.findall(segment)))):
        return UNFILLED
    if _FRAME.search(low) or _SEPARATED.search(segment):
        return FRAME
    low = _QUOTED.sub(" ", low)  # what is quoted is talked about
    words = re.findall(r"[^\W\d_]+", low)
    if words and sum(w in _LATIN for w in words) >= 0.7 * len(words):
        return FILLER
    if _DUMMY.search(low) or len(_MASH.findall(low)) >= max(2, len(words) // 3):
        return FILLER
    if _NOTICE.search(low):
        return NOTICE
    return None


def weak_labels(parts: list[str], said: list[int | None]) -> list[tuple[int, float, bool]]:
    """(class, weight, by a rule) of each segment of a document, given what the rules say of each; weight 0 where nothing is known.

    A phrase counts as residue only if the document has nothing else to say:
    besides a title and the frame, at most remarks shorter than a sentence. In a
    document with several sentences that no rule knows, an error or filler
    phrase is what it talks about; in between, nothing is known.
    """
    bad, title, free = _beside(parts, said)
    if bad and 0 < free < 3:
        return [(x or CONTENT, 0.0 if x in (None, NOTICE, FILLER) else 1.0, True) for x in said]
    if bad and not free:
        main = NOTICE if NOTICE in said else FILLER
        return [(CONTENT, 0.5, False) if i == 0 and title else (main, 0.5, True) if x is None else (x, 1.0, True) for i, x in enumerate(said)]
    return [(CONTENT if x in (None, NOTICE, FILLER) else x, 1.0, x is not None) for x in said]


# Seed examples: notices as servers and scripts of the web word them, six languages.
_SEED_NOTICES = """The page you are looking for could not be found.|This page isn't working right now. Please try again later.|You do not have permission to view this page.|You have been blocked from this site.|The server took too long to respond.|We are down for maintenance and will be back shortly.|Your session has expired. Please log in again.|This site needs scripts to run. Turn them on and reload the page.|JavaScript is turned off in your browser.|Something broke on our side. We have been told about it.|The link you followed may be broken, or the page may have been removed.|Too many requests from your address. Slow down.
Die Seite wurde nicht gefunden.|Diese Seite ist zurzeit nicht erreichbar.|Sie haben keine Berechtigung, diese Seite zu sehen.|Bitte aktivieren Sie JavaScript in Ihrem Browser.|Der Server antwortet nicht. Versuchen Sie es später noch einmal.|Wegen Wartungsarbeiten ist die Seite nicht verfügbar.
La page que vous cherchez est introuvable.|Cette page est indisponible pour le moment.|Vous n'avez pas le droit d'ouvrir cette page.|Veuillez activer JavaScript dans votre navigateur.|Le serveur ne répond pas. Réessayez plus tard.|Le site est en maintenance.
No se ha encontrado la página que busca.|Esta página no está disponible en este momento.|No tiene permiso para ver esta página.|Active JavaScript en su navegador para continuar.|El servidor no responde. Inténtelo más tarde.|El sitio está en mantenimiento.
La pagina che cerchi non è stata trovata.|Pagina non trovata|Questa pagina non è disponibile al momento.|Accesso negato. Non hai il permesso di vedere questa pagina.|Per continuare attiva JavaScript nel tuo browser.|Il server non risponde. Riprova più tardi.|Sito in manutenzione.
A página que procura não foi encontrada.|Página não encontrada|Esta página não está disponível no momento.|Acesso negado. Não tem permissão para ver esta página.|Ative o JavaScript no seu navegador para continuar.|O servidor não responde. Tente novamente mais tarde.|O site está em manutenção.""".replace("\n", "|").split("|")
# Seed examples: dummy sentences, prose with fields, and talk about either.
_SEED_FILLER = "This is a sample paragraph.|Replace this text with your own.|Write something here.|Add your description here.|Coming soon.|Text to come.|Hier kommt Ihr Text hin.|Votre texte ici.|Escriba su texto aquí.|Inserisci qui il tuo testo.|Insira aqui o seu texto.|TODO: write this section.|TBD".split("|")
_SEED_PROSE = "Dear @, your order is on its way.|Hello @, thank you for joining @.|Welcome to @!|This page was written by @ on @.|Your ticket @ was answered by @.|We have @ items for you, @.|Hallo @, Ihre Bestellung ist unterwegs.|Bonjour @, merci de votre visite.|Hola @, gracias por su pregunta.|Contact us at @ or call @.".split("|")
_SEED_FIELDS = "{{ % }}|{{%}}|${%}|[%]|%%%%%|<<%>>|{%}|<%= % %>|[[%]]|*|%|*|@@%@@|__%__".replace("*|%|*", "*!%!*").split("|")
_SEED_NAMES = ("customer_name", "title", "NAME", "your name", "site")
_SEED_MENU = "Home|Help|Contact|Log in|Startseite|Hilfe|Accueil|Aide|Inicio|Ayuda|Inizio|Aiuto|Início|Ajuda|Tags|Forum".split("|")
_SEED_REFERENCES = "Reference|Code|ID:|Kennung|Référence|Referencia|Riferimento|Referência".split("|")
_SEED_TALK = """A 404 Not Found means that no route matched.|The proxy answers 502 Bad Gateway when the worker is gone.|If you see "Access denied", check who owns the file.|Send 503 with a Retry-After header while the site is under maintenance.|Users without scripts get a notice that JavaScript is required.|"Lorem ipsum" has been the printers' dummy text for centuries.|The log says "Internal Server Error", which tells you nothing.|Eine 404 bedeutet, dass es die Seite nicht gibt.|Une erreur 500 vient toujours du serveur.|Un error 403 significa que falta un permiso.|Un errore 404 dice che la pagina manca.|Um erro 404 diz que a página não existe.""".split("|")
_SEED_FACTS = "Water boils at 100 degrees.|It has two modes.|Routes are matched in order.|The cache is small.|Keys are sorted first.|Das Werkzeug ist frei.|Le port est ouvert.|El archivo es corto.|A worker reads the queue and writes the result to disk.|The parser keeps a stack of open elements and closes them in order.".split("|")


def seed_documents() -> list[tuple[str, int]]:
    """(text, class) of made-up documents, always the same: notices, filler, prose with fields, and content that talks about them."""
    rnd = random.Random(8)
    out = [(n, NOTICE) for n in _SEED_NOTICES]
    for s in HTTPStatus:
        if s >= 400:
            out += [(f"{s.value} {s.phrase}", NOTICE), (f"Error {s.value}: {s.phrase}", NOTICE), (f"{s.phrase}\n{s.description or s.phrase}.\n{rnd.choice(_SEED_NOTICES)}", NOTICE)]
    out += [(f"{a}\n{b}", NOTICE) for a, b in zip(_SEED_NOTICES, rnd.sample(_SEED_NOTICES, len(_SEED_NOTICES)))]
    for n in _SEED_NOTICES:  # as sites show them: menu, title, reference number, footer
        menu = " | ".join(rnd.sample(_SEED_MENU, 4))
        reference = f"{rnd.choice(_SEED_REFERENCES)} {rnd.getrandbits(32):08x}{rnd.choice(('', '.'))}" if rnd.random() < 0.7 else f"{rnd.choice(_SEED_NAMES[2:])}/{rnd.randint(1, 999)}"
        out += [(f"{menu}\n{n}", NOTICE), (f"{n}\n{reference}", NOTICE), (f"{menu}\n{n.upper()}\n{reference}", NOTICE)]
    for k in range(240):  # no words, or none that are known: no notice, no filler
        low, high = rnd.choice(((33, 126), (97, 122), (0x400, 0x44F), (0x5D0, 0x5EA), (0x915, 0x939), (0x4E00, 0x4FFF), (0xAC00, 0xB000)))
        word = lambda n: "".join(chr(rnd.randint(low, high)) for _ in range(rnd.randint(1, n)))  # noqa: B023, E731
        out.append((word(1) * rnd.randint(1, 300) if k % 4 == 0 else " ".join(word(9) for _ in range(rnd.randint(1, 30))), CONTENT))
    out += [(f"{a}\n\n {b}", CONTENT) for a, b in zip("abxyz.-*", "yzabc...")]
    latin = sorted(_LATIN)
    out += [(f, FILLER) for f in _SEED_FILLER] + [(" ".join(rnd.sample(_SEED_FILLER, 2)), FILLER) for _ in range(12)]
    out += [(" ".join(rnd.choices(latin, k=rnd.randint(5, 12))).capitalize() + ".", FILLER) for _ in range(40)]
    for f in _SEED_FIELDS:
        for p in _SEED_PROSE:
            out.append((re.sub("@", lambda _: f.replace("!", "|").replace("%", rnd.choice(_SEED_NAMES), 1) if f.count("%") == 1 else f"%%{rnd.choice(_SEED_NAMES)}%%" if set(f) == {"%"} else f"<%= {rnd.choice(_SEED_NAMES)} %>", p), UNFILLED))  # noqa: B023
    for t in _SEED_TALK:
        out += [(" ".join([*rnd.sample(_SEED_FACTS, k), t]), CONTENT) for k in (1, 2, 3, 3)] + [("\n".join([*rnd.sample(_SEED_FACTS, 3), t]), CONTENT), (t, CONTENT)]
    return out


def masked(segment: str) -> str:
    """A segment without the phrases that made it a notice."""
    return _NOTICE.sub(" ", segment.lower()).strip()


def dense_features(docs: list[list[str]]) -> np.ndarray:
    """Length and title features of the segments of documents, all in a row."""
    flat = [p for parts in docs for p in parts]
    counts = np.fromiter(map(len, docs), np.int64, len(docs))
    n = np.repeat(counts, counts)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
    stop = np.fromiter((p[-1] == "." for p in flat), bool, len(flat))
    first = at == 0
    out = np.zeros((len(flat), 8), np.float32)
    out[:, 0] = np.log1p(np.fromiter(map(len, flat), np.float32, len(flat))) / 4
    out[:, 1] = first
    out[:, 2] = at == n - 1
    out[:, 3] = [p[-1] in ".!?" for p in flat]
    out[:, 4] = [p.isupper() for p in flat]
    out[:, 5] = np.log1p(n) / 4
    out[:, 6] = ["|" in p and p.count("|") > 1 or "·" in p and p.count("·") > 1 or "»" in p and p.count("»") > 1 for p in flat]
    out[:, 7] = first & (n > 1) & ~stop
    return out


def document_features(counts: np.ndarray, parts: list[str], p: np.ndarray) -> np.ndarray:
    """What the classes of its segments come to in each document: a row per document with segments.

    ``counts`` segments a document, ``p`` class probabilities a segment. The first
    segment of several may be a title and is looked at apart; reference numbers
    and names are told from sentences by how they end.
    """
    lengths = np.fromiter(map(len, parts), float, len(parts))
    ended = np.fromiter((x[-1] in ".!?…:" for x in parts), float, len(parts))
    starts = np.cumsum(counts) - counts
    first = np.zeros(len(lengths), bool)
    first[starts] = True
    several = np.repeat(counts, counts) > 1
    content = p[:, CONTENT] + p[:, UNFILLED]
    rest = content * ~(first & several)
    add, top = (lambda x: np.add.reduceat(x, starts)), (lambda x: np.maximum.reduceat(x, starts))
    chars = add(lengths)
    return np.stack([
        np.log1p(add(rest * lengths)),
        np.log1p(add(rest)),
        np.log1p(add(rest * ended * lengths)),
        np.log1p(add(rest * ended)),
        np.log1p(top(rest * lengths)),
        content[starts] * (counts > 1),
        np.log1p(lengths[starts]) * content[starts] * (counts > 1),
        np.log1p(add(p[:, NOTICE])),
        np.log1p(add(p[:, FILLER])),
        add(p[:, NOTICE] * lengths) / chars,
        add(p[:, FILLER] * lengths) / chars,
        np.maximum(top(p[:, NOTICE]), top(p[:, FILLER])),
        add(p[:, FRAME] * lengths) / chars,
        counts == 1,
    ], 1)


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, l2: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights and bias of a logistic classifier, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    a = np.zeros(x.shape[1])
    ridge = l2 * np.eye(len(a))
    ridge[-1, -1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        a = a - np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (w * (p - y)) + ridge @ a)
    return a


@dataclass
class ResidueModel:
    softmax: Softmax
    document: np.ndarray  # weights of the document features, and the bias
    report: dict

    def decide(self, docs: list[list[str]]) -> list[bool]:
        """Whether each document, given by its segments, is residue; one without segments is not."""
        parts = [p for d in docs for p in d]
        out = [False] * len(docs)
        if not parts:
            return out
        p = self.softmax.probabilities([shown(x) for x in parts], dense_features(docs))
        classes = p.argmax(axis=1)
        counts = np.fromiter(map(len, docs), np.int64, len(docs))
        some = counts > 0
        z = document_features(counts[some], parts, p) @ self.document[:-1] + self.document[-1]
        at = np.cumsum(counts) - counts
        for i, z_i in zip(np.flatnonzero(some), z):
            out[i] = bool(z_i > 0)
            # an unfilled field is in the document's own prose (exact check), however much else there is
            if not out[i]:
                out[i] = any(classes[j] == UNFILLED and placeholders(parts[j]) for j in range(at[i], at[i] + counts[i]))
        return out


def _beside(parts: list[str], said: list[int | None]) -> tuple[bool, bool, int]:
    """(a notice or filler is there, the first segment is like a title, sentences that no rule knows)."""
    bad = any(x in (NOTICE, FILLER) for x in said)
    title = len(parts) > 1 and said[0] is None and not parts[0].endswith(".")
    return bad, title, sum(x is None and len(p) >= REMARK for p, x in zip(parts[title:], said[title:]))


def weak_document_label(parts: list[str], said: list[int | None]) -> int | None:
    """1 nothing but residue, 0 not, None in between: what ``weak_labels`` knows of a document as a whole."""
    bad, _, free = _beside(parts, said)
    return 0 if not bad or free >= 3 else None if free else 1


def fit(sample: list[tuple[str | None, str | None]]) -> ResidueModel:
    """A model from (text, host) rows and the seed examples; the report is on hosts that were not trained on.

    Hosts are told apart by their lower-cased name; rows without one are trained on.
    """
    seen, unseen = ([], [], [], []), ([], [], [], [])
    done: dict[tuple, int] = {}
    documents: list[tuple[list[str], int, float, bool]] = []  # segments, label, weight, unseen
    about = sum(text.count(". ") + text.count("\n") + 1 for text, _ in sample if text)
    content_share = min(1.0, TRAIN_CONTENT / max(1, about))

    def learn(p: str, d: np.ndarray, c: int, w: float) -> None:
        key = (_DIGITS("0", p), c)
        if key in done:  # a repeated one weighs more, up to MOST_WEIGHT
            seen[3][done[key]] = min(MOST_WEIGHT, seen[3][done[key]] + w)
            return
        done[key] = len(seen[0])
        for column, value in zip(seen, (shown(p), d, c, w)):
            column.append(value)

    for text, c in seed_documents():
        parts = segments(text)
        documents.append((parts, int(c in (NOTICE, FILLER)), SEED_WEIGHT, False))
        for p, d in zip(parts, dense_features([parts])):
            learn(p, d, FRAME if p.count(" | ") > 2 else CONTENT if c == UNFILLED and not placeholders(p) else c, SEED_WEIGHT)
    for text, host in sample:
        parts = segments(text)
        if not parts:
            continue
        held = host is not None and zlib.crc32(host.strip().lower().encode()) % 8 < UNSEEN_EIGHTHS
        said = [phrase_label(p) for p in parts]
        whole = weak_document_label(parts, said)
        if whole is not None and (whole or len(parts) < 12 or zlib.crc32(parts[0].encode()) % 4 == 0):
            documents.append((parts, whole, 1.0, held))
        for p, d, (c, w, by_rule) in zip(parts, dense_features([parts]), weak_labels(parts, said)):
            if not w or (not by_rule and len(parts) > 4 and zlib.crc32(p.encode()) > content_share * 2**32):
                continue
            if held:
                for column, value in zip(unseen, (p, d, c, w)):
                    column.append(value)
                continue
            learn(p, d, c, w)
            if c == NOTICE and by_rule and (rest := masked(p)):
                learn(rest, d, c, w / 2)
    labels = np.array(seen[2])
    softmax = train_softmax(seen[0], np.array(seen[1]), labels, 5, np.array(seen[3]), rounds=70)
    fitted = [x for x in documents if not x[3]]

    def rows(docs: list[tuple]) -> np.ndarray:
        parts = [p for d in docs for p in d[0]]
        p = softmax.probabilities([shown(x) for x in parts], dense_features([d[0] for d in docs]))
        return document_features(np.array([len(d[0]) for d in docs]), parts, p)

    y, w = np.array([d[1] for d in fitted], float), np.array([d[2] for d in fitted])
    w = w * np.where(y > 0, 0.5 / (w * y).sum(), 0.5 / (w * (1 - y)).sum()) * w.sum()  # both classes weigh alike
    document = fit_logistic(rows(fitted), y, w)
    report = {"segments": len(labels), "documents": len(fitted)}
    if unseen[0]:
        want = np.array(unseen[2])
        got = softmax.logits([shown(p) for p in unseen[0]], np.array(unseen[1])).argmax(axis=1)
        report |= {"unseen_segments": len(want), "unseen_accuracy": float((got == want).mean())}
        report |= {f"unseen_recall_{c}": float((got[want == c] == c).mean()) for c in range(5) if (want == c).any()}
        at = [i for i in np.flatnonzero(want == NOTICE) if _NOTICE.search(unseen[0][i].lower()) and masked(unseen[0][i])]
        if at:
            bare = softmax.logits([masked(unseen[0][i]) for i in at], np.array(unseen[1])[at]).argmax(axis=1)
            report["unseen_recall_masked_notice"] = float((bare == NOTICE).mean())
    test = [x for x in documents if x[3]]
    if test:
        got, want = rows(test) @ document[:-1] + document[-1] > 0, np.array([d[1] for d in test]) > 0
        report |= {"unseen_documents": len(test), "unseen_document_accuracy": float((got == want).mean())}
        if want.any():
            report["unseen_document_recall"] = float(got[want].mean())
    return ResidueModel(softmax, document, report)


def training_rows(docs: DataFrame, id_col: str, text_col: str, host_col: str | None) -> list[tuple]:
    """(text, host) rows for fitting, chosen by a hash of the text: TRAIN_SHORT short ones and TRAIN_DOCS longer ones, about.

    Short texts are where whole pages are residue. A smaller table gives all
    rows; no table gives more than twice the numbers.
    """
    host = docs[f"`{host_col}`"].cast("string") if host_col else F.lit(None).cast("string")
    rows = docs.select(docs[f"`{text_col}`"].alias("text"), host.alias("host"))
    short = F.length("text") < SHORT
    return [(r["text"], r["host"]) for part, most in ((short, TRAIN_SHORT), (~short, TRAIN_DOCS)) for r in hash_sample(rows, "text", most, part)[0]]


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str | None = "source", model: ResidueModel | None = None) -> DataFrame:
    """(``id_col``, residue BOOLEAN) of every row, in the order and number of ``docs``.

    Null, empty and blank texts are not residue. A model can be given; else one is
    fitted on a bounded sample of ``docs`` (TRAIN_DOCS), which is read in a pass
    of its own. Whole texts are read. Repeated rows and null ids stay. Other
    columns are not read. No shuffle. An empty table gives no rows.
    """
    rows = docs.select(docs[f"`{id_col}`"].alias("id_"), docs[f"`{text_col}`"].alias("text_"))
    decide = _decider(docs, id_col, text_col, host_col, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "text_"):
                yield pa.RecordBatch.from_arrays([batch.column("id_"), decide(batch.column("text_"))], names=["id_", "residue"])

    return rows.mapInArrow(run, f"id_ {dict(rows.dtypes)['id_']}, residue boolean").withColumnRenamed("id_", id_col)


def exclude(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str | None = "source", model: ResidueModel | None = None) -> DataFrame:
    """``docs`` with all its columns, without the rows that ``detect`` calls residue."""
    decide = _decider(docs, id_col, text_col, host_col, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, text_col):
                yield batch.filter(pc.invert(decide(batch.column(text_col))))

    return docs.mapInArrow(run, docs.schema)


def _decider(docs: DataFrame, id_col: str, text_col: str, host_col: str | None, model: ResidueModel | None):
    """A function for workers: a column of texts to a column of decisions."""
    model = model or fit(training_rows(docs, id_col, text_col, host_col))
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def decide(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.decide([segments(t) for t in texts.to_pylist()]), pa.bool_())

    return decide
