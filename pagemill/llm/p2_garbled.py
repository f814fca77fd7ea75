"""Problem 2: text decoded with the wrong character encoding.

Garbled forms are computed once, by rule, for pairs (written as, read as) of encodings, and found by Aho-Corasick automata:

* UTF-8 read as each of SINGLE: the form of each character that Western texts hold, also garbled twice. It is garbled wherever
  it stands; of a Central European letter, wherever it stands inside a word.
* Text of other scripts (RUNS: Cyrillic, Greek, kana, Han, Hangul) in UTF-8, or in an encoding of its own, read as a single-byte
  encoding: a form by itself may be correct text, so a run of forms of one pair is needed, as long as the pair says; shorter
  runs count in a text that has a long one. The run is decoded whole.
* Single-byte text read as another single-byte encoding (all ordered pairs of SINGLE): the form is one character, which is
  garbled only where its neighbours say so (``misplaced``: a capital in a word of small letters, a symbol between letters, box
  drawing beside a letter, a lone letter in place of a dash). The pair that explains most such places restores them.

Only matched spans are replaced, longest match first, until nothing changes. Texts without a possible first character of a
garbled form never reach Python. Pairs whose forms are plain letters in plain places (cp1252 read as cp1250, one Cyrillic
encoding read as another) cannot be told from text of another language and are not looked for.

Lossy damage has no original: replacement characters, and question marks inside words that are not two words of a language
that a question mark may part, are reported and left as they are.

Defined results: null and empty fields are unaffected. A span that stands alone between quotation marks or back ticks is
quoted, not garbled; a field is affected if a span outside quotations remains. Correct text beside a span is untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that texts in the languages at hand hold beyond ASCII.
EXPECTED = "äöüßÄÖÜéèêëàâáãåçñíìîïóòôõøúùûýÿæœÉÈÊËÀÂÁÃÅÇÑÍÌÎÏÓÒÔÕØÚÙÛÝÆŒŠšŽž“”„‘’‚«»‹›–—…·•©®™€£§°ºª¿¡´ "
#: Single-byte encodings that UTF-8 is commonly taken for.
SINGLE = ("cp1252", "latin-1", "iso8859-15", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "cp1254", "koi8-r", "cp866")
#: (written as, read as) of single-byte text taken for another single-byte encoding; the common ones come first.
CROSSED = tuple(dict.fromkeys([("cp1252", "cp850"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp1251"), ("cp850", "cp1252"), ("cp437", "cp1252"), *permutations(SINGLE, 2)]))
#: Letters of Central European texts beyond EXPECTED.
CENTRAL = "".join(c for c in map(chr, range(0x100, 0x17F)) if c.isalpha() and c not in EXPECTED)
#: First and last code points of other scripts.
SCRIPTS = {"greek": (0x386, 0x3CE), "cyrillic": (0x401, 0x45F), "kana": (0x3041, 0x30FC), "han": (0x4E00, 0x9FA5), "hangul": (0xAC00, 0xD7A3)}
#: Encodings of RUNS with one byte for a letter, and letters that their runs must have together, half of them frequent ones.
LETTERS = 10
ONE_BYTE = ("cp1251", "koi8-r", "cp866", "iso8859-5", "iso8859-7")
#: Frequent letters of Cyrillic, Greek, Japanese, Chinese and Korean texts.
FREQUENT = frozenset("оеаинтсрвлкмдпуя" "αοιετσνηυρκπμλως" "のにはをたがでてとしいなるれさっもらかこりま" "的一是不了人在有我他这中大来上国个到说们为子和地出道也时年得就要下以生会自过家学对可里后小多天能好都没日于" "이다는의에을를가한고로은지하정사리기도부법오새승인")
#: (written as, read as, scripts, least forms in a run).
RUNS = (
    *(("utf-8", x, ("greek", "cyrillic"), 3) for x in SINGLE),
    *(("utf-8", x, ("kana", "han", "hangul"), 2) for x in ("cp1252", "latin-1")),
    *((w, r, (script,), 4) for w, script in (("cp1251", "cyrillic"), ("koi8-r", "cyrillic"), ("cp866", "cyrillic"), ("iso8859-5", "cyrillic"), ("iso8859-7", "greek")) for r in ("cp1252", "latin-1")),
    *((w, r, scripts, 3) for w, scripts in (("shift_jis", ("kana", "han")), ("euc_jp", ("kana", "han")), ("gb2312", ("han",)), ("big5", ("han",)), ("euc_kr", ("hangul",))) for r in ("cp1252", "latin-1")),
)
#: Common words, by language, that a question mark may part without a space.
COMMON = {
    "en": "what no yes it is he she you they we who how why when where do not this that so then well and but or",
    "de": "was nein ja es ist er sie du wir wer wie warum wann wo nicht das so und aber oder",
    "fr": "quoi non oui il elle est tu nous vous qui comment pourquoi quand pas cela et mais ou",
    "es": "que no si es el ella quien como porque cuando donde eso pero",
    "it": "che no si è lui lei chi come quando dove non ma questo",
    "pt": "que não sim é ele ela quem como quando onde mas isso",
    "nl": "wat nee ja het is hij zij wie hoe waarom wanneer waar niet dat maar of",
}
_COMMON = [frozenset(x.split()) for x in COMMON.values()]
REPLACEMENT = "�"
_OPEN, _CLOSE = "“„«‘‚`\"'‹", "”“»’‘`\"'›"


def _read(data: bytes, encoding: str) -> str | None:
    """data read as encoding; bytes that the encoding leaves undefined become control characters, as browsers do."""
    try:
        return data.decode(encoding)
    except UnicodeDecodeError:
        if not encoding.startswith("cp125"):
            return None
        return "".join(chr(b) if (d := bytes([b]).decode(encoding, "ignore")) == "" else d for b in data)


@lru_cache(maxsize=1)
def garbled_forms() -> dict[str, str]:
    """Garbled form -> original, for UTF-8 read as a single-byte encoding, once or twice."""
    forms: dict[str, str] = {}
    for encoding in SINGLE:
        for c in EXPECTED:
            once = _read(c.encode(), encoding)
            if once is None or once == c:
                continue
            forms.setdefault(once, c)
            twice = _read(once.encode(), encoding)
            if twice:
                forms.setdefault(twice, c)
            if encoding in ("cp1252", "latin-1", "iso8859-15"):  # a byte lost or a no-break space made plain on the way
                if once.endswith(" ") and len(once) == 2:
                    forms.setdefault(once[:-1] + " ", c)
    return forms


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for form, original in garbled_forms().items():
        found.add_word(form, (len(form), original))
    for encoding in SINGLE:
        for c in CENTRAL:
            form = _read(c.encode(), encoding)
            if form and form not in found:
                found.add_word(form, (-len(form), c))  # negative: only inside a word
    for form in ("â€", REPLACEMENT):  # what is left where a byte was lost: the original is not known
        if form not in found:
            found.add_word(form, (len(form), None))
    found.make_automaton()
    return found


@lru_cache(maxsize=1)
def _crossed_maps() -> list[dict[str, str]]:
    return [{g: c for c in EXPECTED if (b := _bytes(c, written_as)) and (g := _read(b, read_as)) and g != c} for written_as, read_as in CROSSED]


def _bytes(c: str, encoding: str) -> bytes | None:
    try:
        return c.encode(encoding)
    except UnicodeEncodeError:
        return None


#: Places that correct text of these languages does not have: a capital beyond ASCII after a small letter, a symbol between
#: letters, box drawing or another script beside Latin letters, a lone letter where a dash or quotation mark belongs.
_MISPLACED = re.compile(
    r"(?<=[a-zß-öø-ÿœ])[À-ÖØ-ÞŠŸŽŒ](?![A-ZÀ-ÖØ-Þ])"
    r"|(?<=[^\W\d_])[‡ˆ‰†§¶³¾½´¨™¼¢¤¥¦¬±²¹˜•›‹¸ƒ\x80-\x9f](?=[^\W\d_])"
    r"|(?<=[A-Za-zß-ÿ])[─-▟⌐⌠⌡√∞≈≡≤≥∂∑∏∫◊ΓΣΦΩαδεπστφﬁﬂ]|[─-▟⌐⌠⌡√∞≈≡≤≥∂∑∏∫◊ΓΣΦΩαδεπστφﬁﬂ](?=[A-Za-zß-ÿ])"
    r"|(?<=[A-Za-z])[Ѐ-ӿ]|[Ѐ-ӿ](?=[A-Za-z])"
    r"|(?:(?<=\w )|(?<=\n))[ÐÝûøÞþ¶Û³Õ╗└](?= [^\W\d_]|\n|$)|(?:(?<=[^\W\d_] )|(?<=\d{4} ))½(?= [^\W\d_])"
    r"|(?:(?<=[a-z] )|(?<=\d{4} ))[ÀÇá](?= [A-Z][a-z])|(?<=[a-zß-ÿ])[šž](?=[a-zß-ÿ])"
)
#: Where something misplaced may stand; this first test is cheap.
_MAY = re.compile(r"[À-ÖØ-ÞŠŸŽŒ‡ˆ‰†§¶³¾½´¨™¼¢¤¥¦¬±²¹˜•›‹¸ƒ\x80-\x9fΑ-ωЀ-ӿﬁﬂ⌐⌠⌡√∞≈≡≤≥∂∑∏∫◊─-▟šž]|(?<= )[ûøþá](?= )")
_LOST = re.compile(r"(?<=[a-zß-ÿ])\?+(?=[a-zß-ÿ])")
_FIRST = "[" + "".join(sorted({re.escape(f[0]) for f in garbled_forms()} | {re.escape(f[0]) for e in SINGLE for c in CENTRAL if (f := _read(c.encode(), e))})) + REPLACEMENT + "\\?" + r"─-▟⌐⌠⌡√∞≈≡≤≥∂∑∏∫◊Α-ωﬁﬂЀ-ӿ\x80-\x9f‡ˆ‰†§¶³¾½´¨™¼¢¤¥¦¬±²¹˜•›‹¸ƒŠŸŽŒÐÝûøÞþÛÕšž]|[a-zß-öø-ÿœ][À-ÖØ-Þ]| [ÀÇá] [A-Z]"


_BEGINS = re.compile("[" + "".join(sorted({re.escape(f[0]) for f in garbled_forms()} | {re.escape(f[0]) for e in SINGLE for c in CENTRAL if (f := _read(c.encode(), e))})) + REPLACEMENT + "]")
#: What every run of RUNS holds: four characters beyond ASCII, or three each with a second byte of a two-byte encoding.
_HIGH, _SECOND = r"[^\x00-\x7f]", r"[^\x00-\x3f\x7f]"
_MAY_RUN = re.compile(f"{_HIGH}(?:{_HIGH}{_HIGH}{_HIGH}|{_SECOND}{_HIGH}{_SECOND}{_HIGH}{_SECOND})")


@lru_cache(maxsize=1)
def _runs():
    """Forms of each pair of RUNS, and an automaton of all of them that says in which pairs a form is."""
    import ahocorasick

    tables, where = [], {}
    for k, (written_as, read_as, scripts, _) in enumerate(RUNS):
        table = {}
        for script in scripts:
            for code in range(SCRIPTS[script][0], SCRIPTS[script][1] + 1):
                data = _bytes(chr(code), written_as)
                form = _read(data, read_as) if data and len(data) < 4 else None  # some codecs spell out what they lack
                if form and form != chr(code) and not form.isascii():
                    table[form] = chr(code)
        tables.append((table, sorted({len(f) for f in table}, reverse=True)))
        for form in table:
            where[form] = where.get(form, 0) | 1 << k
    found = ahocorasick.Automaton()
    for form, pairs in where.items():
        found.add_word(form, pairs)
    found.make_automaton()
    return tables, found


def runs(text: str) -> list[tuple[int, int, str]]:
    """(start, end, original) of the runs of forms of one pair, outside quotations."""
    if not _MAY_RUN.search(text):
        return []
    tables, automaton = _runs()
    seen: dict[int, int] = {}
    for _, pairs in automaton.iter(text):
        seen[pairs] = seen.get(pairs, 0) + 1
    high = [m.start() for m in re.finditer(_HIGH, text)]
    sure = [(a, b) for a, b, original in spans(text) if original is not None]
    times = [sum(n for pairs, n in seen.items() if pairs >> k & 1) for k in range(len(RUNS))]
    best: tuple[tuple[int, float], list[tuple[int, int, str]]] = ((0, 0.0), [])
    for k, (written_as, _, _, least) in enumerate(RUNS):
        if times[k] < least:
            continue
        (table, sizes), parts, i, size = tables[k], [], 0, len(text)
        single = written_as in ONE_BYTE
        for a in high:
            if a < i:
                continue
            i, letters = a, []
            while i < size and (n := next((n for n in sizes if i + n <= size and text[i : i + n] in table), 0)):
                letters.append(table[text[i : i + n]])
                i += n
            if letters:
                if not _quoted(text, a, i) and (not single or all(c.isalpha() or c in "×÷" for c in text[a:i])):
                    parts.append((a, i, "".join(letters)))
        # Short runs count beside a long one only.
        kept = [len(x) >= least and (not single or len(set(x)) > 2) for _, _, x in parts]
        for order in (range(1, len(parts)), range(len(parts) - 2, -1, -1)):
            for j in order:
                other = j - order.step
                a, b = sorted((parts[j], parts[other]))
                kept[j] = kept[j] or kept[other] and b[0] - a[1] <= 2 and not any(c.isalpha() for c in text[a[1] : b[0]])
        out = [x for x, y in zip(parts, kept) if y]
        covered = sum(b - a for a, b, _ in out)
        if written_as != "utf-8" and 2 * sum(min(b, y) - max(a, x) for a, b, _ in out for x, y in sure if a < y and x < b) > covered:
            continue  # forms that need no run explain it
        # Encodings of one alphabet cover the same: letters that are frequent in its languages decide.
        letters = "".join(x for _, _, x in out)
        score = covered, sum(c in FREQUENT for c in letters) / max(1, len(letters))
        if single and (len(letters) < LETTERS or len(set(letters.lower())) < LETTERS // 2 or score[1] < 0.5):
            continue  # accented letters in a row
        if not single and written_as != "utf-8" and score[1] < 0.1:
            continue  # high and low characters by turns
        if out and score > best[0]:
            best = score, out
    return best[1]


def _quoted(text: str, a: int, b: int) -> bool:
    """text[a:b] alone between quotation marks or back ticks."""
    left, right = text[max(0, a - 2) : a].rstrip("  "), text[b : b + 2].lstrip("  ")
    return bool(left and right and left[-1] in _OPEN and right[0] in _CLOSE)


def spans(text: str) -> list[tuple[int, int, str | None]]:
    """(start, end, original or None) of the garbled spans outside quotations."""
    if not _BEGINS.search(text):
        return []
    out, last = [], 0
    for a, minus, n, original in sorted((end + 1 - abs(n), -abs(n), n, original) for end, (n, original) in _automaton().iter(text)):
        central, b = n < 0, a - minus
        if a < last:
            continue
        last = b
        if central and not (a and text[a - 1].islower() or text[b : b + 1].islower() or any("\x80" <= c <= "\x9f" for c in text[a:b])):
            continue
        if n == 2 and text[b - 1] == " " and a and text[a - 1].isupper():
            continue  # a word of capitals before a space
        if not _quoted(text, a, b):
            out.append((a, b, original))
    return out


def misplaced(text: str) -> Iterator[re.Match[str]]:
    for m in _MAY.finditer(text):
        if place := _MISPLACED.match(text, m.start()):
            if "Α" <= m[0] <= "ω" and _symbol(text, m.start()) or m[0] in "šž" and _CENTRAL.search(text):
                continue
            yield place


_CENTRAL = re.compile(f"[{CENTRAL}]")


def _symbol(text: str, at: int) -> bool:
    """A Greek letter beside at most one Latin letter: a sign of a formula."""
    a, b = at, at + 1
    while a and text[a - 1].isalpha():
        a -= 1
    while b < len(text) and text[b].isalpha():
        b += 1
    return b - a <= 2


def crossed(text: str) -> dict[str, str] | None:
    """The single-byte mix-up that explains the misplaced characters of text; an empty map if none does; None without any."""
    seen = [m[0] for m in misplaced(text) if not _quoted(text, m.start(), m.end())]
    if not seen:
        return None
    best = max(_crossed_maps(), key=lambda m: sum(c in m for c in seen))
    return best if any(c in best for c in seen) else {}


def affected(text: str | None) -> bool:
    if not text:
        return False
    if spans(text) or crossed(text) is not None or runs(text):
        return True
    return any(_lost(text, m) for m in _LOST.finditer(text))


def _lost(text: str, m: re.Match[str]) -> bool:
    """Whether a question mark between small letters stands for a lost one."""
    token = _token(text, m.start())
    if "=" in token or "/" in token:
        return False
    left, right = (re.search(r"[^\W\d_]+\Z", text[max(0, m.start() - 30) : m.start()])[0].lower(), re.match(r"[^\W\d_]+", text[m.end() : m.end() + 30])[0].lower())
    return not (len(left) > 1 and len(right) > 1 and any(left in x and right in x for x in _COMMON))


def _token(text: str, at: int) -> str:
    a = max(text.rfind(" ", 0, at), text.rfind("\n", 0, at)) + 1
    b = min(x if x >= 0 else len(text) for x in (text.find(" ", at), text.find("\n", at)))
    return text[a:b]


def restore(text: str | None) -> str | None:
    """text with every garbled span of known original put right; the rest is left as it is."""
    if not text:
        return text
    for _ in range(3):
        found = runs(text) or [s for s in spans(text) if s[2] is not None]
        if not found:
            break
        parts, at = [], 0
        for a, b, original in found:
            parts += (text[at:a], original)
            at = b
        text = "".join([*parts, text[at:]])
    mapping = crossed(text)
    if mapping:
        parts, at = [], 0
        for m in misplaced(text):
            if m[0] in mapping and not _quoted(text, m.start(), m.end()):
                parts += (text[at : m.start()], mapping[m[0]])
                at = m.end()
        text = "".join([*parts, text[at:]])
    return text


def suspicious(field: Column) -> Column:
    """Native test: false only for texts that cannot be affected."""
    return field.rlike(_FIRST) | field.rlike(_MAY_RUN.pattern)


@F.pandas_udf(T.BooleanType())
def _affected(texts: pd.Series) -> pd.Series:
    return texts.map(affected).astype(bool)


def fields(records: DataFrame, id_col: str = "scrape_id") -> DataFrame:
    """(id, field, value) of the fields that may be affected."""
    kinds = F.array(F.struct(F.lit("text").alias("field"), F.col("text").alias("value")), F.struct(F.lit("title").alias("field"), F.col("metadata.title").alias("value")))
    return records.select(F.col(id_col), F.inline(F.filter(kinds, lambda k: suspicious(k["value"]))))


def found(records: DataFrame) -> DataFrame:
    """(scrape_id, field) of the affected fields."""
    return fields(records.where("scrape_id is not null")).where(_affected("value")).select("scrape_id", "field")


def repaired(records: DataFrame, id_col: str = "scrape_id") -> DataFrame:
    """(id, field, restored, known) of the affected fields; known is false where damage remains."""
    schema = f"{id_col} {records.schema[id_col].dataType.simpleString()}, field string, restored string, known boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[batch["value"].map(affected).astype(bool)]
            restored = batch["value"].map(restore)
            yield pd.DataFrame({id_col: batch[id_col], "field": batch["field"], "restored": restored, "known": ~restored.map(affected).astype(bool)})

    return fields(records, id_col).mapInPandas(run, schema)
