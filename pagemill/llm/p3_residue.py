"""Problem 3: template residue, filler text, error messages and demands for scripts.

Every line of every record, whatever its length, is masked (numbers, references and addresses become a wildcard) and counted
over all records: how many hold it, on how many hosts, with an error status, and with no prose beside it. Lines are then
mined in a fixed-depth prefix tree (number of tokens, then the first three): lines with wording evidence that agree in
enough places share a template, and a line without evidence joins a template only if it differs from it in wildcard places
alone, so that a verdict reaches other fillings of a slot but no other sentence. A template is classified once:

* a short line of a known wording (``MESSAGES``, the labelled seed) is a message;
* a long line of a known wording, or a line of ``GENERAL`` wording (what HTTP reason phrases and error pages say), is one if
  half of the records that hold it have no prose beside it (or, of a known wording, an error status or a second copy);
* a line of any wording, in any language, is one if several hosts have it only with an error status and no prose beside it.

The verdict goes to the lines of the template and from them to the records. A line is a message only as a whole, so that an
article about errors is none.

Slots and filler are looked for inside ordinary records: a placeholder that no quotation, back tick or markup surrounds,
or a line made of the words of the usual dummy text.

Defined results: the content is text, or html without its tags where text is null or empty. A noscript element counts only
where html has no other line of prose. Rows without content are never a case. Repeated rows give one row per id; metadata or
url may be missing. A content that is nothing but an HTTP error code is an error message.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from http import HTTPStatus

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import host_of, meet, written

#: Tokens up to which a line of a known wording needs no support by its counts.
LONGEST = 30
DEPTH, AGREE = 3, 0.6
#: Words from which on a line is prose.
PROSE = 12
#: Records and hosts from which on a line of unknown wording is a message if all of them, or nearly, answered with an error.
SEVERAL, HOSTS, NEARLY = 3, 2, 0.9
WILD = "<*>"

#: Message kinds by wording; each pattern is tried at the beginning of a masked lower-case line.
MESSAGES = {
    "missing": (
        r"(?:oops! )?(?:we looked everywhere|page not found|(?:error )?404|not found|the (?:requested )?(?:page|url|address|resource) .*(?:not exist|not be found|was not found|has been moved))",
        r"this (?:item|page|product|article|content) (?:is no longer available|has been removed|does not exist|cannot be found)",
        r"(?:diese )?seite (?:nicht gefunden|ist leider verschwunden|existiert nicht)",
        r"page (?:introuvable|non trouv\w+)|cette page n'existe",
        r"página no (?:encontrada|existe)|la página no existe",
        r"pagina non trovata|la pagina non esiste",
        r"página não (?:encontrada|existe)",
        r"pagina niet gevonden|deze pagina bestaat niet",
    ),
    "denied": (
        r"(?:access denied|403 forbidden|forbidden\b|permission denied)",
        r"zugriff verweigert|accès (?:refusé|interdit)|acceso denegado|accesso negato|acesso negado|toegang geweigerd",
    ),
    "session": (
        r"your session has (?:expired|timed out)|ihre sitzung ist abgelaufen|votre session a expiré|su sesión ha (?:caducado|expirado)",
        r"la (?:vostra|sua|tua) sessione è scaduta|(?:la )?sessione scaduta|a sua sessão expirou|uw sessie is verlopen",
    ),
    "failed": (
        r"(?:sorry, |oops[,!] )?something went wrong|(?:50[0234] |http )?(?:bad gateway|internal server error|service unavailable|gateway time-?out)\b",
        r"leider ist (?:bei uns )?etwas schiefgelaufen|(?:désolé, )?une erreur est survenue|(?:lo sentimos, )?algo ha (?:fallado|salido mal)",
        r"(?:spiacenti, )?qualcosa è andato storto|(?:lamentamos, )?algo correu mal|(?:sorry, )?er (?:ging|is) (?:bij ons )?iets mis",
    ),
    "maintenance": (
        r"(?:we are|this site is|the site is) (?:currently )?(?:down for|under|undergoing) maintenance|wegen wartung(?:sarbeiten)? ",
        r"le site est en maintenance|el sitio está en mantenimiento|il sito è in manutenzione|o s[ií]t(?:io|e) está em manutenção|de(?:ze)? (?:web)?site is in onderhoud",
    ),
    "scripts": (
        r"(?:please |you need to |you must )?(?:turn on|enable|activate|allow) (?:scripts|javascript)|javascript (?:is required|is disabled|must be enabled)",
        r"this (?:site|page|app\w*) (?:works only|needs|requires) .*(?:scripts?|javascript)|checking your browser before",
        r"(?:bitte )?aktivieren sie javascript|diese seite benötigt (?:skripte|javascript)|(?:veuillez )?activer? javascript|cette page a besoin de (?:scripts|javascript)",
        r"(?:por favor, )?active javascript|esta página necesita (?:scripts|javascript)|(?:attivate|attiva|abilita\w*) javascript|questa pagina richiede (?:gli script|javascript)",
        r"ative o javascript|esta página (?:precisa|necessita) de (?:scripts|javascript)|schakel javascript in|deze pagina heeft (?:scripts|javascript) nodig",
        r"(?:der|ihr) browser wird geprüft|vérification de votre navigateur|(?:estamos )?comprobando su navegador|verifica del (?:vostro )?browser|a verificar o (?:seu )?navegador|uw browser wordt gecontroleerd",
    ),
    "filler": (
        r"your (?:headline|title|text|tagline|subtitle) (?:goes )?here|(?:sample|placeholder|dummy) text\b|text block \w+, to be supplied|insert (?:caption|text|title|headline|image)\b",
        r"(?:replace|delete|edit) this (?:paragraph|text|sentence) |add a short description of your (?:business|company)|to be supplied by the client",
        r"hier steht ihre? |blindtext|beispieltext|ersetzen sie diesen (?:absatz|text)|beschreiben sie hier kurz ihr|textblock \w+, |bildunterschrift (?:hier )?einfügen",
        r"votre titre ici|texte d'exemple|remplacez ce (?:paragraphe|texte)|ajoutez une courte description de votre|bloc de texte \w+, |insérer? (?:la |une )?légende",
        r"su (?:título|titular) (?:va )?aquí|texto de (?:muestra|ejemplo)|sustituya este (?:párrafo|texto)|añada una breve descripción de su|bloque de texto \w+, |insert(?:e|ar) (?:el |un )?pie",
        r"(?:qui il vostro titolo|il vostro titolo qui)|testo (?:di esempio|segnaposto)|sostituite questo (?:paragrafo|testo)|aggiungete una breve descrizione della vostra|blocco di testo \w+, |inserire? (?:la )?didascalia",
        r"o seu título aqui|texto de exemplo|substitua este (?:parágrafo|texto)|acrescente uma breve descrição|adicione uma breve descrição|bloco de texto \w+, |inserir (?:a )?legenda",
        r"(?:hier komt uw|uw (?:kop|titel) hier)|voorbeeldtekst|vervang deze (?:alinea|tekst)|voeg een korte beschrijving van uw|tekstblok \w+, |bijschrift invoegen",
    ),
}
_KINDS = [(kind, re.compile("|".join(f"(?:{p})" for p in patterns))) for kind, patterns in MESSAGES.items()]

_SORRY = r"(?:(?:sorry|we're sorry|we are sorry|oops|whoops|uh[- ]oh|error|warning|attention|achtung|fehler|entschuldigung|désolé|erreur|lo sentimos|atención|spiacenti|errore|lamentamos|erro|fout|helaas)[,!:.]* )?"
_REASONS = "|".join(sorted({re.escape(x.phrase.lower()) for x in HTTPStatus if x >= 400}))
#: What error pages say in general.
GENERAL = {
    "failed": (
        rf"(?:http |error |status )?(?:<\*> )?(?:{_REASONS})\b",
        r"(?:an? )?(?:\w+ )?error (?:has )?occurred|(?:uncaught|unhandled) (?:exception|error)|fatal error|(?:the )?(?:connection|request|server) (?:has )?(?:timed out|was refused|was reset)",
        r"we (?:could ?n[o']t|can ?n[o']t|were unable to|are unable to) (?:find|load|display|process|open|reach|complete)|(?:this|the|your) (?:page|request|site|service|server|resource|content) (?:could not|cannot|can't|couldn't) be|(?:this|the) (?:page|site|service|server|resource) is (?:temporarily |currently )?(?:unavailable|not available|down)",
        r"(?:ein|es ist ein) (?:\w+ )?fehler (?:ist )?aufgetreten|(?:diese|die) (?:seite|anfrage) (?:konnte|kann) (?:leider )?nicht|(?:der )?dienst (?:ist )?nicht verfügbar",
        r"une erreur (?:\w+ )?(?:est survenue|s'est produite)|impossible d(?:e |')(?:trouver|charger|afficher)|(?:le )?service (?:est )?(?:temporairement )?indisponible",
        r"(?:se ha producido|ha ocurrido|ocurrió) un error|no (?:se pudo|hemos podido|pudimos) (?:encontrar|cargar|mostrar)|(?:el )?servicio no (?:está )?disponible",
        r"si è verificato un errore|impossibile (?:trovare|caricare|visualizzare)|(?:il )?servizio (?:è )?non disponibile|ocorreu um erro|não foi possível (?:encontrar|carregar|mostrar)|(?:o )?serviço (?:está )?indisponível",
        r"er is een (?:\w+ )?fout opgetreden|(?:deze|de) pagina (?:kan|kon) niet|(?:de )?dienst (?:is )?niet beschikbaar",
    ),
    "denied": (
        r"(?:you|your (?:ip|address|account|request|access)) (?:have|has|was|were|is|are) (?:been )?(?:temporarily |permanently )?(?:blocked|denied|banned|suspended|limited)|too many (?:requests|attempts|redirects)|rate limit",
        r"(?:please )?(?:complete|solve|pass) (?:the|this|a) (?:security check|captcha|challenge)|(?:please )?(?:verify|confirm|prove) (?:that )?you are (?:a )?(?:human|not a robot)|are you (?:a )?(?:human|robot)",
        r"zu viele anfragen|sie wurden (?:gesperrt|blockiert)|trop de requêtes|vous avez été bloqué|demasiadas (?:solicitudes|peticiones)|(?:ha|has) sido bloquead|troppe richieste|sei stato bloccat|(?:demasiados|muitos) pedidos|muitas solicitações|foi bloquead|te veel (?:verzoeken|aanvragen)|u bent geblokkeerd",
    ),
}
_GENERAL = [(kind, re.compile(_SORRY + "(?:" + "|".join(f"(?:{p})" for p in patterns) + ")")) for kind, patterns in GENERAL.items()]
_CODE = re.compile(r"\s*(?:http |error |status )?[45]\d\d[.!]?\s*", re.I)

#: The usual dummy text.
DUMMY = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
_RARE = r"\b(?:lorem|consectetur|adipisci|eiusmod|incididunt|nostrud|exercitation|ullamco|aliquip|reprehenderit|cillum|excepteur|occaecat|cupidatat|deserunt|fugiat)"

#: Slots that a template engine, mail merge or form letter would have filled.
SLOT = re.compile(
    r"\{\{\{?[^{}\n]{1,60}\}?\}\}|[$#]\{[^{}\n]{1,60}\}|<%=?[^%\n]{1,60}%>|\{%[^%\n]{1,60}%\}|\[\[[^\[\]\n]{1,60}\]\]|@@\w{2,40}@@|\*\|[^|\n]{2,40}\|\*"
    r"|(?<![\w%])%[A-Z][A-Z_]{2,40}%|(?<![\w$])\$[A-Z][A-Z_]{2,40}\$|(?<!\w)__[A-Z][A-Z_]{2,40}__(?!\w)"
    r"|\[object Object\]|\bundefined undefined\b|<insert [^<>\n]{2,60}>|\[(?!OBJECT)[A-Z]{3,20}(?: [A-Z]{2,20}){0,4}\](?!\()|(?<![\w$#{%.\])])\{[a-z]{2,30}(?:[._-][a-z]{1,30}){0,3}\}(?![\w}])"
)
_MAY_SLOT = r"\{\{|\$\{|#\{|<%|\{%|\[\[|@@|\*\||%[A-Z_]{3,}%|\$[A-Z_]{3,}\$|__[A-Z_]{3,}__|\[object|undefined undefined|<insert |\[[A-Z ]{3,}\]|\{[a-z_.-]{2,}\}"
_SHUT = "`\"'”“»’‘›"


def visible(page: str) -> str:
    """Text of html, a line per block; a noscript element only where no other line is prose."""
    page = re.sub(r"(?is)<(script|style|template)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<head\b.*?(?:</head\s*>|(?=<body\b))", " ", page)

    def text(part: str) -> str:
        part = re.sub(r"(?i)<(?:br|/?(?:p|div|h[1-6]|li|ul|ol|tr|table|section|article|main|nav|header|footer|aside|pre|noscript|blockquote|title))\b[^<>]*>", "\n", part)
        part = re.sub(r"<(?:/?[A-Za-z]|!)[^<>]*>?", " ", part)
        return "\n".join(x for line in entities.unescape(part).split("\n") if (x := " ".join(line.split())))

    without = text(re.sub(r"(?is)<noscript\b.*?(?:</noscript\s*>|\Z)", " ", page))
    return without if any(line.count(" ") + 1 >= PROSE for line in without.split("\n")) else text(page)


_LEAD, _TAIL = re.compile(r"^[\s#>*_-]+"), re.compile(r"(?:\s*\([^()]{0,12}\)|[\s.…»›*_!:]+)\Z")
_SLOTTED = re.compile(r"[^\s\d.:]*+(?:[.:](?![a-z/])[^\s\d.:]*+)*+(?:\d|\.[a-z]|:/)")


class Mask:
    """Tokens of a line in lower case, marks at the ends off, addresses and whatever holds a digit a wildcard; each token is masked once."""

    def __init__(self) -> None:
        self.known: dict[str, str] = {}

    def __call__(self, line: str) -> list[str]:
        line = _LEAD.sub("", " ".join(line.split()))
        while line and (line[-1] in " .…»›*_!:)") and (m := _TAIL.search(line, max(0, len(line) - 200))):
            line = line[: m.start()]
        if len(self.known) > 300_000:
            self.known.clear()
        known, out = self.known, []
        for token in line.split(" "):
            x = known.get(token)
            if x is None:
                x = known[token] = WILD if _SLOTTED.match(token) else token.lower()
            out.append(x)
        return out


def evidence(tokens: list[str]) -> tuple[str | None, bool]:
    """(kind, sure) by the wording of a masked line; what is not sure needs the support of its counts."""
    line = " ".join(tokens)
    if kind := next((kind for kind, pattern in _KINDS if pattern.match(line)), None):
        return kind, len(tokens) <= LONGEST
    return next((kind for kind, pattern in _GENERAL if pattern.match(line)), None), False


def verdict(tokens: list[str]) -> str | None:
    """Kind of a line of a known wording."""
    return next((kind for kind, pattern in _KINDS if pattern.match(" ".join(tokens))), None)


def scan(records: DataFrame, id_col: str) -> DataFrame:
    """One pass over the records: (id, residue) rows of records with slots, filler or an error code, and a row for each distinct line.

    Rows of lines: line (hash), leaf (hash of number of tokens and first tokens), kind and sure of the evidence, whether the
    wording is a seed's, host (hash), error (status from 400 on), alone (no prose beside it), text (masked; null where this
    task has given the text of the line before).
    """
    fields = {f.name for f in records.schema["metadata"].dataType.fields} if "metadata" in records.columns and hasattr(records.schema["metadata"].dataType, "fields") else set()
    status = F.col("metadata.status_code") if "status_code" in fields else F.lit(None).cast("int")
    host = host_of(F.col("url")) if "url" in records.columns else F.lit(None).cast("string")
    rows = records.select(F.col(id_col).alias("id"), "text", F.when(F.col("text").isNull() | (F.col("text") == ""), F.col("html")).alias("html"), F.xxhash64(host).alias("host"), F.coalesce(status >= 400, F.lit(False)).alias("error"))
    rows = rows.where((F.col("text") != "") | (F.col("html") != ""))
    schema = f"id {records.schema[id_col].dataType.simpleString()}, residue string, line long, leaf long, kind string, sure boolean, host long, error boolean, alone boolean, text string"
    names = ["id", "residue", "line", "leaf", "kind", "sure", "host", "error", "alone", "text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_64_intdigest

        mask, seen = Mask(), {}
        for batch in batches:
            out = []
            for key, text, page, host, error in zip(batch["id"], batch["text"], batch["html"], batch["host"], batch["error"]):
                content = text or visible(page)
                if not content or content.isspace():
                    continue
                if residue := residue_of(content):
                    out.append((key, residue, None, None, None, None, None, None, None, None))
                found: dict[int, tuple] = {}
                prose = 0
                for line in dict.fromkeys(content.split("\n")):
                    tokens = mask(line)
                    if not tokens[0]:
                        continue
                    whole = " ".join(tokens)
                    h = xxh3_64_intdigest(whole.encode()) - (1 << 63)
                    if h in found:
                        continue
                    is_prose = len(tokens) >= PROSE
                    prose += is_prose
                    known = seen.get(h)
                    if known is None:
                        if len(seen) > 300_000:
                            seen.clear()
                        leaf = xxh3_64_intdigest(f"{len(tokens)} {' '.join(tokens[:DEPTH])}".encode()) - (1 << 63)
                        known = seen[h] = (leaf, *evidence(tokens))
                        found[h] = (*known, is_prose, whole)
                    else:
                        found[h] = (*known, is_prose, None)
                out += [(key, None, h, leaf, kind, sure, host, error, prose - is_prose == 0, whole) for h, (leaf, kind, sure, is_prose, whole) in found.items()]
            frame = pd.DataFrame(out, columns=names)
            yield frame.assign(**{c: pd.array(frame[c].to_list(), "Int64") for c in ("line", "leaf", "host")}, **{c: pd.array(frame[c].to_list(), "boolean") for c in ("sure", "error", "alone")})

    return rows.mapInPandas(run, schema)


def counted(lines: DataFrame) -> DataFrame:
    """(line, leaf, kind, sure, n, hosts, errors, alone) of every distinct line; no text is shuffled."""
    first = [F.first(c).alias(c) for c in ("leaf", "kind", "sure")]
    fine = lines.groupBy("line", "host").agg(*first, F.count("*").alias("n"), F.sum(F.col("error").cast("long")).alias("errors"), F.sum(F.col("alone").cast("long")).alias("alone"))
    return fine.groupBy("line").agg(*first, F.sum("n").alias("n"), F.count("host").alias("hosts"), F.sum("errors").alias("errors"), F.sum("alone").alias("alone"))


class Template:
    __slots__ = ("tokens", "kind", "sure", "members", "n", "errors", "alone")

    def __init__(self, tokens: list[str], kind: str):
        self.tokens, self.kind, self.sure, self.members, self.n, self.errors, self.alone = list(tokens), kind, False, 0, 0, 0, 0

    def agrees(self, tokens: list[str]) -> int:
        return sum(a == b or a == WILD for a, b in zip(self.tokens, tokens))

    def add(self, tokens: list[str], sure: bool, n: int, errors: int, alone: int) -> None:
        self.tokens = [a if a == b else WILD for a, b in zip(self.tokens, tokens)]
        self.sure, self.members = self.sure or sure, self.members + 1
        self.n, self.errors, self.alone = self.n + n, self.errors + errors, self.alone + alone

    def verdict(self) -> str | None:
        """Kind of the template's lines: by their wording, or by it and their counts."""
        seed = verdict(self.tokens) is not None
        support = 2 * self.alone >= self.n or seed and (2 * self.errors >= self.n or self.n > 1)
        return self.kind if self.sure or support else None


class Leaf:
    """Templates of one leaf of the tree: lines with evidence, of equal length and first tokens. There are as many as wordings of messages."""

    def __init__(self) -> None:
        self.templates: list[Template] = []

    def place(self, tokens: list[str], kind: str | None, sure: bool, n: int, errors: int, alone: int) -> Template | None:
        """The template that the line joins; lines with evidence come first. None for a line that is of no template."""
        if kind is None:
            return next((t for t in self.templates if t.agrees(tokens) == len(tokens)), None)
        found = next((t for t in self.templates if t.kind == kind and t.agrees(tokens) >= AGREE * len(tokens)), None)
        if found is None:
            self.templates.append(found := Template(tokens, kind))
        found.add(tokens, sure, n, errors, alone)
        return found


def mine(distinct: DataFrame, texts: DataFrame) -> DataFrame:
    """(line, verdict) of the lines that are messages; distinct as counted() gives it, texts (line, text).

    Only leaves that hold a line with evidence are mined. A leaf goes through one task: its lines with evidence are kept as
    templates, the others pass by.
    """
    leaves = distinct.where("kind is not null").select("leaf").distinct()
    wanted = distinct.join(leaves, "leaf", "left_semi")
    text = texts.where("text is not null").join(wanted.select("line"), "line", "left_semi").groupBy("line").agg(F.first("text").alias("text"))
    ordered = wanted.join(text, "line").repartition("leaf").sortWithinPartitions("leaf", F.col("kind").isNull(), "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, leaf, held = None, Leaf(), []

        def close() -> list[tuple[int, str]]:
            out = [(line, kind) for line, t in held if (kind := t.verdict())]
            held.clear()
            return out

        for batch in batches:
            out = []
            for key, line, text, kind, sure, n, errors, alone in zip(*(batch[c] for c in ("leaf", "line", "text", "kind", "sure", "n", "errors", "alone"))):
                if key != at:
                    out += close()
                    at, leaf = key, Leaf()
                t = leaf.place(text.split(" "), kind, bool(sure), n, errors, alone)
                if kind is not None:
                    held.append((line, t))
                    continue
                out += close()  # the leaf's templates are complete
                if t is not None and (v := t.verdict()):
                    out.append((line, v))
            yield pd.DataFrame(out, columns=["line", "verdict"])
        yield pd.DataFrame(close(), columns=["line", "verdict"])

    mined = ordered.select("leaf", "line", "text", "kind", "sure", "n", "errors", "alone").mapInPandas(run, "line long, verdict string")
    unknown = distinct.where((F.col("n") >= SEVERAL) & (F.col("hosts") >= HOSTS) & (F.col("errors") >= NEARLY * F.col("n")) & (F.col("alone") >= NEARLY * F.col("n")))
    return mined.union(unknown.select("line", F.coalesce("kind", F.lit("failed")).alias("verdict"))).groupBy("line").agg(F.min("verdict").alias("verdict"))


def slots(text: str) -> list[str]:
    """Unfilled slots of text, without those quoted or shown in a piece of markup or code."""
    out = []
    for m in SLOT.finditer(text):
        before, after = text[max(0, m.start() - 1) : m.start()], text[m.end() : m.end() + 1]
        if before and after and before in _SHUT + "„«‹" and after in _SHUT:
            continue
        a = text.rfind("\n", 0, m.start()) + 1
        b = text.find("\n", m.end())
        line = text[a : b if b >= 0 else len(text)]
        if re.search(r"</\w+>|\w\(.*[{}].*\)|[;{]\s*$", SLOT.sub("", line)):
            continue
        out.append(m[0])
    return out


def filler(text: str) -> bool:
    """A line that is made of dummy text, not one that quotes it."""
    for line in text.split("\n"):
        words = re.findall(r"[^\W\d_]+", line.lower())
        if len(words) >= 4 and sum(w in DUMMY for w in words) >= 0.8 * len(words):
            return True
    return False


_MAY_INSIDE = re.compile(_MAY_SLOT)
_MAY_FILLER = re.compile(_RARE, re.I)


def residue_of(content: str) -> str | None:
    """Residue inside a record."""
    if _MAY_INSIDE.search(content) and slots(content):
        return "slot"
    if _MAY_FILLER.search(content) and filler(content):
        return "filler"
    return "failed" if _CODE.fullmatch(content) else None


def cases(records: DataFrame, id_col: str = "scrape_id") -> DataFrame:
    """(id, kind) of the records with residue, one row for each kind. metadata.status_code and url are used where there are any."""
    scanned = written(scan(records, id_col))
    lines = scanned.where("line is not null")
    distinct = written(counted(lines))
    verdicts = written(mine(distinct, lines.select("line", "text")))
    held = distinct.join(verdicts, "line").select("line", "verdict", "n")
    messages = meet(lines.select("id", "line"), held, ["line"], "n").select(F.col("id").alias(id_col), F.col("verdict").alias("kind"))
    inside = scanned.where("residue is not null").select(F.col("id").alias(id_col), F.col("residue").alias("kind"))
    return messages.union(inside).distinct()


def found(records: DataFrame) -> DataFrame:
    return cases(records.where("scrape_id is not null")).select("scrape_id").distinct()
